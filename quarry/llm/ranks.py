"""Global ranks of rows without gathering them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import keep

#: Spark's row numbers hold the partition above this many bits.
_PART_BITS = 33


def ranked(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with a long column ``name``: their places, from 0, by the
    columns ``order`` (nulls first, strings by their UTF-8 bytes). Rows are
    dealt out by ranges of the order and numbered where they lie; the numbers
    are stored with them, so that a task run again finds the same ones. Only
    the row count of each partition goes through the driver. ``rows`` should
    be a stored table, as the ranges are found in a pass of their own. Rows
    alike in ``order`` get neighbouring places in any order."""
    spark = rows.sparkSession
    dealt = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", _PART_BITS)
    sizes = sorted((r["p"], r["n"]) for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, firsts = 0, []
    for p, n in sizes:
        firsts.append((p, before))
        before += n
    # one row a partition
    firsts = F.broadcast(spark.createDataFrame(firsts, "__part long, __first long"))
    return (dealt.withColumn("__part", part.cast("long")).join(firsts, "__part")
            .select(*[f"`{c}`" for c in rows.columns],
                    (F.col("__first") + F.col("__at").bitwiseAND((1 << _PART_BITS) - 1)).alias(name)))
