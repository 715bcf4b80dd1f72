"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a named rejection test over a text. On a bounded sample every
rule is timed and its rejections are counted; the cascade then asks the rules
in the order of rejections per second. The order is a matter of cost alone:
a text is rejected if any rule rejects it, so the verdict does not depend on
the order or on the sample. The chain is one CASE: a later rule is not
evaluated for a text that an earlier one rejected. There is no shuffle, and
the work inside a text is linear or a sort of its words.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the cost sample, taken from the first files; it only decides the order of the rules.
SAMPLE_ROWS = 500

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``rejects`` builds the test from the measures it names."""
    name: str
    measures: tuple[str, ...]
    rejects: Callable[[Any], Column]


#: SQL of the measures over a text column ``{t}`` that is never null.
MEASURES = {
    "n_words": "cast(size(filter(split({t}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')) as long)",
    "word_chars": "cast(char_length(translate({t}, '\\u0009\\u000a\\u000b\\u000c\\u000d ', '')) as long)",
    "n_symbols": f"cast(char_length({{t}}) - char_length(translate({{t}}, '{SYMBOLS}', '')) as long)",
    # lines with a word, less the distinct ones among them
    "n_lines": "cast(size(filter(split({t}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')) as long)",
    "n_unique_lines": "cast(size(array_distinct(filter(split({t}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]'))) as long)",
}


def repeat_words_sql(t: str) -> str:
    """Words in 3-word windows that occur twice or more. Windows are hashed
    and sorted with their places; equal neighbours are repeats, and the words
    of repeated windows are counted once each. Arrays travel as arguments,
    not inside lambdas, so each is built once per text."""
    words = f"filter(split({t}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    windows = (f"transform(array({words}), w -> "
               "if(size(w) < 3, array(), "
               "zip_with(zip_with(slice(w, 1, size(w) - 2), slice(w, 2, size(w) - 2), (a, b) -> xxhash64(a, b)), "
               "slice(w, 3, size(w) - 2), (h, c) -> xxhash64(h, c))))[0]")
    placed = f"sort_array(transform({windows}, (h, i) -> named_struct('h', h, 'i', i)))"
    twice = (f"transform(array({placed}), s -> if(size(s) < 2, array(), "
             "filter(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), "
             "(a, b) -> if(a.h = b.h, array(a.i, a.i + 1, a.i + 2, b.i, b.i + 1, b.i + 2), null)), p -> p is not null)))[0]")
    return f"cast(size(array_distinct(flatten({twice}))) as long)"


def measure(name: str, text: str) -> Column:
    """The measure of a text column named ``text``; a null text is empty."""
    t = f"coalesce(`{text}`, '')"
    if name == "n_repeat_words":
        return F.expr(repeat_words_sql(t))
    if name == "n_dup_lines":
        return F.expr(f"{MEASURES['n_lines'].format(t=t)} - {MEASURES['n_unique_lines'].format(t=t)}")
    return F.expr(MEASURES[name].format(t=t))


#: The contract's base tests.
BASE = (Rule("few_words", ("n_words",), lambda m: m.n_words < 50),
        Rule("repeats", ("n_words", "n_repeat_words"), lambda m: 100 * m.n_repeat_words > 50 * m.n_words))
#: Further tests: half as many symbols as words; three lines in ten repeat an
#: earlier one; words of under two or over fifteen code points on average.
MORE = (Rule("symbols", ("n_words", "n_symbols"), lambda m: 100 * m.n_symbols > 50 * m.n_words),
        Rule("dup_lines", ("n_lines", "n_unique_lines"), lambda m: 100 * (m.n_lines - m.n_unique_lines) > 30 * m.n_lines),
        Rule("word_length", ("n_words", "word_chars"),
             lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 15 * m.n_words)))
RULES = BASE + MORE


def rejects(rule: Rule, text: str) -> Column:
    """The rule's test with its measures in place, so that nothing is computed
    for a text that the cascade has already settled. The measures are a
    struct in an array of one, which the test walks: each is computed once."""
    measures = F.array(F.struct(*[measure(m, text).alias(m) for m in rule.measures]))
    return F.exists(measures, lambda m: rule.rejects(_Fields(m)))


class _Fields:
    def __init__(self, struct: Column):
        self._struct = struct

    def __getattr__(self, name: str) -> Column:
        return self._struct[name]


def estimate(docs: DataFrame, text: str, rules=RULES, rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, int]]:
    """(rule, seconds, rejections) of each rule on at most ``rows`` rows. An
    empty table gives zero rejections."""
    texts = docs.select(F.col(text).alias("text")).head(rows)  # reads no more files than it needs
    sample = docs.sparkSession.createDataFrame([(r["text"],) for r in texts], "text string")
    out = []
    for rule in rules:
        began = time.perf_counter()
        hits = sample.agg(F.count_if(F.coalesce(rejects(rule, "text"), F.lit(False))).alias("n")).first()["n"]
        out.append((rule, time.perf_counter() - began, hits))
    return out


def order(estimates: list[tuple[Rule, float, int]]) -> list[Rule]:
    """Rules by rejections per second, most first; ties by name."""
    return [r for r, s, n in sorted(estimates, key=lambda e: (-e[2] / max(e[1], 1e-3), e[1], e[0].name))]


def rejected_by(text: str, ordered: list[Rule]) -> Column:
    """Name of the first rule in the order that rejects the text, else null."""
    chain = F
    for rule in ordered:
        chain = chain.when(rejects(rule, text), F.lit(rule.name))
    return chain if ordered else F.lit(None).cast("string")


def cascade(docs: DataFrame, text: str = "text", rules=RULES, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, list[Rule]]:
    """``docs`` with a string column __rejected_by (null: kept), and the
    order used. A null text counts as empty and has no words. Repeated rows
    are judged alike; all other columns pass through unread."""
    ordered = order(estimate(docs, text, rules, rows))
    return docs.withColumn("__rejected_by", rejected_by(text, ordered)), ordered


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept of every row. The base measures are wanted for every
    text; the cascade of the remaining rules runs only where the base tests
    passed."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ordered = order(estimate(docs, text, MORE, rows))
    measured = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("__text"),
                           *[measure(n, text).alias(n) for n in names])
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return measured.select("doc_id", *names, failed.alias("base_failed"),
                           F.when(failed, False).otherwise(rejected_by("__text", ordered).isNull()).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns."""
    judged, _ = cascade(docs, text, RULES, rows)
    return judged.filter(F.col("__rejected_by").isNull()).select(*[f"`{c}`" for c in docs.columns])
