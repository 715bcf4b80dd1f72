"""Licence scan: canonical digests of whole texts, joined with known ones.

A text is brought to a canonical form (letter case, copyright clauses,
punctuation, equivalent spellings, white space) and digested; a hash join
with the digests of known licence texts names the licence. The form does not
depend on where lines end, so any wrapping of a text has the same digest. The
same is done for every line, and for two and three lines in a row, as texts of
their own, since a notice usually is a few lines of a document. Everything is
row-local; the known digests are a table of constant size (one row per known
text) and are broadcast behind a check of that size.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Known texts are broadcast up to this many; beyond it the join shuffles.
BROADCAST_ROWS = 20_000

#: Lines in a row that are looked up as one notice.
NOTICE_LINES = 3

# A copyright clause stands at the start of a line and has a mark or a year:
# "(c) You must" and "copyright notice, this" are none. It ends with its
# sentence, with its line or before the words that usually follow.
MARKED = r"copyright[ \t:]*(?:\(c\)|©)|©"
DATED = r"(?:copyright|\(c\))[ \t:]*[\[<{(]?(?:[12][0-9]{3}|year|yyyy)"
FOLLOWS = (r"all rights reserved|permission is|permission to|redistribution and|licensed under|released under"
           r"|this (?:program|software|work|source|file)")
CLAUSE = rf"(?dm)^[ \t>#*/;-]*(?:{MARKED}|{DATED})[^\n]{{0,200}}?(\.[ \t]|\.?\r?$|[ \t]+(?:{FOLLOWS}))"
ABBREVIATED = r"\b([a-z]|inc|ltd|co|corp|jr)\."  # a full stop that ends no sentence
STEWARD = r"copyright[ \t\r\n]+\(c\)[ \t\r\n0-9,-]+free[ \t\r\n]+software[ \t\r\n]+foundation"  # part of the licences it names
RESERVED = r"all[ \t\r\n]+rights[ \t\r\n]+reserved"
OTHER = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

# Titles that stand above a text or not, and wordings in use.
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"],
          "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License"],
          "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License"]}
WORDINGS = {"COPYRIGHT HOLDER OR": ["COPYRIGHT OWNER OR", "COPYRIGHT HOLDERS OR"], "modify, and/or": ["modify, and"]}


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the whole licences in ``known_licenses``, in their
    usual variants."""
    out = []
    for path in sorted(Path(__file__).with_name("known_licenses").glob("*.txt")):
        text = path.read_text("utf-8")
        texts = [text, *(text.replace(old, new) for old, others in WORDINGS.items() if old in text for new in others)]
        # without what follows the terms
        texts += [text[:m.start()] for m in [re.search(r"^ *(APPENDIX: How|How to Apply These Terms|Appendix: How)", text, re.M | re.I)] if m]
        for one in texts:
            for title in ["", *TITLES.get(path.stem, [])]:
                out.append((path.stem, f"{title}\n\n{one}" if title else one))
    return out


# Whole licences, public licence notices and short licence texts.
KNOWN = [
    *full_texts(),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
                   "in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
]

#: Spellings that mean the same, as words of the canonical form.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
             ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("fulfil", "fulfill"),
             ("merchantibility", "merchantability"), ("organisation", "organization"), ("noninfringement",
             "non infringement"), ("whilst", "while"), ("wilful", "willful"), ("percent", "per cent")]


def without_copyright(low: Column) -> Column:
    """Lower-case text without copyright clauses and reservations of rights."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, ABBREVIATED, "$1 "), STEWARD, " free software foundation"),
                           CLAUSE, " $1")
    shown = F.when(low.rlike(r"copyright|\(c\)|©"), cut).otherwise(low)
    return F.when(low.contains("reserved"), F.regexp_replace(shown, RESERVED, " ")).otherwise(shown)


def line_forms(text: Column) -> Column:
    """Canonical forms of the text's lines that have one, in order; null for null text."""
    lines = F.split(without_copyright(F.translate(text, UPPER, LOWER)), "\n")
    joined = F.array_join(F.transform(lines, lambda x: F.concat(F.lit(" "), F.regexp_replace(x, OTHER, " "), F.lit(" "))), "\n")
    for old, new in SPELLINGS:
        # words next to each other share a blank, so each replacement runs twice
        for _ in range(2):
            joined = F.replace(joined, F.lit(f" {old} "), F.lit(f" {new} "))
    trimmed = F.transform(F.split(F.regexp_replace(joined, " +", " "), "\n"), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x != "")


def whole_form(forms: Column) -> Column:
    """Canonical form of a text from those of its lines. White space,
    punctuation or copyright clauses alone give the empty form."""
    return F.array_join(forms, " ")


def digest(form: Column) -> Column:
    """SHA-256 of a canonical form in lower-case hex; null for empty forms."""
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """license_digest, license_id, length (of the form): one row per distinct
    canonical text; of equal texts under several names the first name by order stays."""
    names = spark.createDataFrame(list(known), "license_id string, text string")
    return (names.withColumn("form", whole_form(line_forms(F.col("text")))).withColumn("license_digest", digest(F.col("form")))
            .filter("license_digest is not null")
            .groupBy("license_digest").agg(F.min("license_id").alias("license_id"), F.min(F.length("form")).alias("length")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=KNOWN) -> DataFrame:
    """One row per input row: doc_id, digest of the whole canonical text
    (null for null or empty forms), license_id of the whole text, and
    line_licenses, the sorted distinct licences of one to ``NOTICE_LINES``
    lines in a row (those without a form left out).

    Whole texts are hash-joined with the known digests. Lines are looked up
    inside their row, in a literal map of the same digests, so no row is
    taken apart and repeated rows stay repeated. Only those as long as some
    known form are digested."""
    listed = [(r["license_digest"], r["license_id"], r["length"]) for r in known_digests(docs.sparkSession, known).collect()]
    side = docs.sparkSession.createDataFrame([x[:2] for x in listed], "license_digest string, license_id string")
    side = F.broadcast(side) if len(listed) <= BROADCAST_ROWS else side
    names = F.create_map(*[F.lit(x) for p in listed for x in p[:2]]).cast("map<string,string>")
    lengths = sorted({x[2] for x in listed})
    forms = docs.select(F.col(id_col).alias("doc_id"), line_forms(F.col(text_col)).alias("forms"))

    def rows_of(n: int) -> Column:
        if n == 1:
            return F.col("forms")
        return F.transform("forms", lambda x, i: F.when(
            i + n <= F.size("forms"), F.array_join(F.slice("forms", i + 1, n), " ")))

    likely = F.concat(*[F.filter(rows_of(n), lambda x: F.length(x).isin(lengths)) for n in range(1, NOTICE_LINES + 1)])
    found = F.transform(likely, lambda x: F.element_at(names, F.coalesce(digest(x), F.lit(""))))
    found = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    texts = forms.select("doc_id", digest(whole_form(F.col("forms"))).alias("digest"),
                         F.coalesce(found, F.array().cast("array<string>")).alias("line_licenses"))
    return (texts.join(side, texts["digest"] == side["license_digest"], "left")
            .select("doc_id", "digest", "license_id", "line_licenses"))
