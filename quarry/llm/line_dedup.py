"""Repeated runs of lines: a suffix array over line identifiers by prefix
doubling, and its longest-common-prefix intervals.

Every line is a place (document, line) with a 128-bit identifier of its text.
Doubling: places whose runs of 2^h lines are alike share a class; the classes
of 2^(h+1) lines come from joining each place with the one 2^h lines on. Only
places in classes of two or more go on, so the tables shrink fast, and the
rounds end with the longest repeated run. Classes are the rows of the suffix
array that agree on a prefix; which class sorts before which plays no part in
the intervals, so no round sorts the corpus.

Intervals: a node of the interval tree is a set of places that agree on
exactly L lines. It is found from the doubling levels, from long to short: the
places of a class split into the classes of the next shorter extension, where
each subclass is represented by its first place. All places of a node but its
first are later copies of a run of L lines, the longest one that occurs
earlier. Groups are only counted and reduced to their first place, by partial
aggregation; they are never gathered, so a line that makes up a third of all
lines is no harder than others.

Later copies of runs of any length are deleted if they hold a real line, one
with a word in it; runs of blank lines alone stay.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import keep, release

#: Words of the shortest run that is deleted: any run with a word in it.
MIN_WORDS = 1
NO_ID = -(1 << 63)


def _row_key(id_col: str, text_col: str) -> list:
    """Document order, and what tells rows of one id apart."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"),
            F.coalesce(F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(0)).alias("r")]


def places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, i, c1, c2, w): document, place, line identifier, words of the line.
    The place holds the row's key above the line number."""
    split = docs.select(*_row_key(id_col, text_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("k", "line"))
    return split.select("d", (F.shiftleft("r", 32) + F.col("k")).alias("i"),
                        F.xxhash64("line").alias("c1"), F.xxhash64(F.lit("second"), "line").alias("c2"),
                        F.expr("size(filter(split(line, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> ''))").cast("long").alias("w"))


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows in classes (c1, c2) of two or more, with ``first``: whether a row
    is the first place of its class."""
    size = (rows.groupBy("c1", "c2").agg(F.count("*").alias("m"), F.min(F.struct("d", "i")).alias("f")).filter("m > 1")
            .select("c1", "c2", F.col("f.d").alias("fd"), F.col("f.i").alias("fi")))
    return (rows.join(size, ["c1", "c2"])
            .withColumn("first", (F.col("d") == F.col("fd")) & (F.col("i") == F.col("fi"))).drop("fd", "fi"))


def _is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def doubling_levels(lines: DataFrame) -> list[DataFrame]:
    """Level h: (d, i, c1, c2, w, first) of the places whose run of 2^h lines
    occurs twice or more; w counts the run's words."""
    level = keep(_repeated(lines).distinct(), "level")
    levels, step = [], 1
    while not _is_empty(level):
        levels.append(level)
        on = level.select("d", (F.col("i") - step).alias("i"), F.col("c1").alias("e1"), F.col("c2").alias("e2"),
                          F.col("w").alias("v"))
        longer = (level.drop("first").join(on, ["d", "i"])
                  .select("d", "i", F.xxhash64("c1", "c2", "e1", "e2").alias("n1"),
                          F.xxhash64(F.lit("second"), "c1", "c2", "e1", "e2").alias("n2"), (F.col("w") + F.col("v")).alias("w"))
                  .withColumnsRenamed({"n1": "c1", "n2": "c2"}))
        level, step = keep(_repeated(longer), "level"), 2 * step
    release(level)
    return levels


def later_copies(lines: DataFrame) -> DataFrame:
    """(d, i, run, w): every place whose line occurs earlier, the longest run
    of lines from there that occurs earlier, and the run's words."""
    levels = doubling_levels(lines)
    if not levels:
        return lines.select("d", "i", F.lit(0).cast("long").alias("run"), "w").limit(0)
    # the longest level at which a place is not the first of its class
    top = None
    for h, level in enumerate(levels):
        late = level.filter(~F.col("first")).select("d", "i", F.lit(h).alias("h"))
        top = late if top is None else top.unionByName(late)
    top = keep(top.groupBy("d", "i").agg(F.max("h").alias("h")), "top")
    nodes = None
    for h in range(len(levels) - 1, -1, -1):
        if nodes is not None:
            split = _split(nodes, levels[h], 1 << h)
            new = keep(split, "nodes")
            release(nodes)
            nodes = new
        late = (levels[h].filter(~F.col("first")).join(top.filter(F.col("h") == h).drop("h"), ["d", "i"]))
        started = late.select("c1", "c2").distinct()
        heads = levels[h].filter("first").join(started, ["c1", "c2"], "left_semi")
        begun = late.select("d", "i", "c1", "c2", "w", "first").unionByName(heads.select("d", "i", "c1", "c2", "w", "first")).select(
            "d", "i", F.col("c1").alias("x1"), F.col("c2").alias("x2"), F.lit(1 << h).cast("long").alias("run"), "w", "first")
        if h == 0:  # runs of one line split no further
            return (begun if nodes is None else nodes.unionByName(begun)).filter(~F.col("first")).select("d", "i", "run", "w")
        new = keep(begun if nodes is None else nodes.unionByName(begun), "nodes")
        if nodes is not None:
            release(nodes)
        nodes = new


def _split(nodes: DataFrame, level: DataFrame, step: int) -> DataFrame:
    """The nodes after trying to extend their runs by ``step`` lines."""
    on = level.select("d", F.col("i").alias("at"), F.col("c1").alias("e1"), F.col("c2").alias("e2"), F.col("w").alias("v"))
    # a place that cannot be extended gets a class of its own, which also keeps such rows apart in the join
    known = F.col("e1").isNotNull()
    tried = (nodes.withColumn("at", F.col("i") + F.col("run")).join(on, ["d", "at"], "left").drop("at")
             .withColumn("y1", F.when(known, F.xxhash64("x1", "x2", "run", "e1", "e2")).otherwise(F.xxhash64("d", "i", "x1")))
             .withColumn("y2", F.when(known, F.xxhash64(F.lit("second"), "x1", "x2", "run", "e1", "e2"))
                         .otherwise(F.xxhash64(F.lit("alone"), "d", "i", "x2")))
             .withColumn("known", known).drop("e1", "e2"))
    sub = (tried.filter("known").groupBy("y1", "y2").agg(F.count("*").alias("m"), F.min(F.struct("d", "i")).alias("f"))
           .filter("m > 1").select("y1", "y2", F.col("f.d").alias("fd"), F.col("f.i").alias("fi")))
    both = (tried.join(sub, ["y1", "y2"], "left")
            .withColumn("lead", (F.col("d") == F.col("fd")) & (F.col("i") == F.col("fi"))))
    stay = F.struct(F.col("x1"), F.col("x2"), F.col("run"), F.col("w"), F.col("first"))
    go = F.struct(F.col("y1").alias("x1"), F.col("y2").alias("x2"), (F.col("run") + step).alias("run"),
                  (F.col("w") + F.col("v")).alias("w"), F.col("lead").alias("first"))
    # the first place of a subclass also stays, to stand for it
    moves = F.when(F.col("lead").isNull(), F.array(stay)).when(F.col("lead"), F.array(stay, go)).otherwise(F.array(go))
    return both.select("d", "i", F.inline(moves))


def removed_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(d, r, runs): for each row with later copies of ``min_words`` words or
    more, the sorted (line, run) pairs that start one."""
    lines = keep(places(docs, id_col, text_col), "lines")
    copies = later_copies(lines).filter(F.col("w") >= min_words)
    return (copies.groupBy("d", F.shiftright("i", 32).alias("r"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("i").bitwiseAND(F.lit(0xFFFFFFFF)).alias("line"), "run"))).alias("runs")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
          keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, text (without later copies), n_lines,
    n_removed, and the columns named in ``keep_cols``.

    Documents are read in the order of their integer ids, null first; of
    rows with one id the order is by a hash of the text. A repeated row
    (same id and text) is the same place and is treated as its twin. Lines end
    at U+000A. A null text has no lines and stays null; an empty text has one
    empty line."""
    runs = removed_runs(docs, id_col, text_col, min_words)
    kept = [F.col(f"`{c}`").alias(f"__keep{k}") for k, c in enumerate(keep_cols)]
    rows = docs.select(*_row_key(id_col, text_col), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *kept)
    joined = rows.join(runs, ["d", "r"], "left").drop("d", "r")
    schema = joined.drop("runs").withColumns({"n_lines": F.lit(0), "n_removed": F.lit(0)}).schema
    for field in schema:
        field.nullable = True

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, total, removed = [], [], []
            at = batch.schema.get_field_index
            for text, spans in zip(batch.column(at("text")), batch.column(at("runs"))):
                text, spans = text.as_py(), spans.as_py()
                lines = [] if text is None else text.split("\n")
                total.append(len(lines))
                if not spans:
                    texts.append(text)
                    removed.append(0)
                    continue
                left, free = [], 0
                for s in spans:  # sorted by line
                    left += lines[free:s["line"]]
                    free = max(free, s["line"] + s["run"])
                left += lines[free:]
                texts.append("\n".join(left))
                removed.append(len(lines) - len(left))
            out = batch.set_column(at("text"), "text", pa.array(texts, pa.string()))
            out = out.select([n for n in out.schema.names if n != "runs"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(total, pa.int32()), pa.array(removed, pa.int32())],
                                             names=[*out.schema.names, "n_lines", "n_removed"])

    return joined.mapInArrow(run, schema).select(
        "doc_id", "text", "n_lines", "n_removed", *[F.col(f"__keep{k}").alias(c) for k, c in enumerate(keep_cols)])
