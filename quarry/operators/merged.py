"""Merged-cell de-duplication (S9) as a skew-safe DataFrame operator.

Within a table row, a merged cell repeats the same underlying cell over
several grid columns; only its first column is kept, and the kept cells are
renumbered densely. A single row may hold a large share of all cells, so:

* the first column per (row, cell) is a partial (map-side) aggregation;
* the dense numbering cuts a row into pieces of ``PIECE`` columns, so one huge
  row is numbered by many tasks; a piece's offset is the count of the row's
  earlier pieces. The piece is computed from the column alone, so the result
  does not depend on how rows are laid out or on an exchange being reused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Columns of one piece.
PIECE = 1024


def dedupe_row_cells(cells: DataFrame, row: str, col: str, cell: str, out: str = "col_no") -> DataFrame:
    """``cells`` (row, col, cell id, ...) -> the first column of every cell
    per row, with ``out`` = its dense position in the row (ties in ``col``
    broken by the cell id)."""
    kept = cells.groupBy(row, cell).agg(F.min(col).alias(col))
    pieces = kept.withColumn("_piece", F.floor(F.col(col) / PIECE))
    local = pieces.withColumn("_k", F.row_number().over(W.partitionBy("_piece", row).orderBy(col, cell)))
    counts = local.groupBy(row, "_piece").agg(F.count("*").alias("_cnt"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(
        W.partitionBy(row).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return local.join(offsets.drop("_cnt"), [row, "_piece"]) \
        .withColumn(out, F.col("_off") + F.col("_k")).drop("_piece", "_k", "_off")
