"""Relational tables as workbook sheets (S10), cell lookups (R5), grids.

A workbook here is a set of tables: sheet = table, row 1 = column names,
column c = the c-th column, and the row of a record is ``key + 2`` (keys are
dense from 0), so no global numbering pass is needed. A sheet is never one
row or one group: its rows stay rows (``all_rows``), and a lookup turns its
rectangle into a key range and a column list on the driver, so the parquet
scan gets the pushed filter and reads only those columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import needs_nfkc
from quarry.sources.corpus import read_table

# The bounds of the grid preview.
GRID_ROWS = 60
GRID_COLS = 30

# Sheets of the relational workbook, in tab order, with their row keys.
TPCH_SHEETS = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey"),
               ("customer", "c_custkey"), ("part", "p_partkey"), ("orders", "o_orderkey")]
WORKBOOK_LABEL = "tpch.xlsx"
WORKBOOK_PROJECT = "tpch"


def cell_text(c: Column, dtype: T.DataType, session_tz: str = "UTC") -> Column:
    """A stored value as the text a workbook reader shows: doubles with two
    decimals, timestamps as 'YYYY-MM-DD HH:MM:SS' in UTC whatever the
    session time zone, others as is."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.cast("decimal(18,2)").cast("string")
    if isinstance(dtype, T.TimestampType):
        shown = c if session_tz in ("UTC", "Etc/UTC", "Z", "+00:00") else F.to_utc_timestamp(c, session_tz)
        return F.date_format(shown, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def cell_text_sql(col: str, dtype: T.DataType, session_tz: str = "UTC") -> str:
    """``cell_text`` as a SQL expression."""
    c = f"`{col}`"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"CAST(CAST({c} AS DECIMAL(18,2)) AS STRING)"
    if isinstance(dtype, T.TimestampType):
        shown = c if session_tz in ("UTC", "Etc/UTC", "Z", "+00:00") else f"to_utc_timestamp({c}, '{session_tz}')"
        return f"date_format({shown}, 'yyyy-MM-dd HH:mm:ss')"
    return f"CAST({c} AS STRING)"


@dataclass
class Sheet:
    name: str
    ord: int
    key: str
    df: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def cells(self, row_lo: int, row_hi: int, col_lo: int, col_hi: int) -> DataFrame:
        """Long-form cells of a rectangle: sheet, row_no, col_no, value.
        The row range becomes a pushed-down key filter; only the columns
        inside the rectangle are read."""
        cols = self.columns
        col_hi = min(col_hi, len(cols))
        out = []
        if col_lo > col_hi:
            return None
        picked = [(c, cols[c - 1]) for c in range(col_lo, col_hi + 1)]
        if row_lo <= 1 <= row_hi:
            hdr = self.df.sparkSession.createDataFrame(
                [(self.name, 1, c, name) for c, name in picked],
                "sheet string, row_no int, col_no int, value string")
            out.append(hdr)
        lo, hi = max(row_lo, 2) - 2, row_hi - 2
        if lo <= hi:
            types = dict((f.name, f.dataType) for f in self.df.schema.fields)
            tz = self.df.sparkSession.conf.get("spark.sql.session.timeZone")
            body = (self.df.filter(F.col(self.key).between(lo, hi))
                    .select(F.lit(self.name).alias("sheet"),
                            (F.col(self.key) + 2).cast("int").alias("row_no"),
                            F.explode(F.array(*[F.struct(F.lit(c).alias("col_no"),
                                                         cell_text(F.col(n), types[n], tz).alias("value"))
                                                for c, n in picked])).alias("cv"))
                    .select("sheet", "row_no", "cv.col_no", "cv.value"))
            out.append(body)
        if not out:
            return None
        res = out[0]
        for o in out[1:]:
            res = res.unionByName(o)
        return res


class Workbook:
    """A workbook whose sheets are the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, sheets=TPCH_SHEETS,
                 label: str = WORKBOOK_LABEL, project: str = WORKBOOK_PROJECT):
        self.spark, self.label, self.project = spark, label, project
        self.sheets = [Sheet(name, i, key, read_table(spark, sf_dir, name))
                       for i, (name, key) in enumerate(sheets)]

    @property
    def sheet_names(self) -> list[str]:
        return [s.name for s in self.sheets]

    def find_sheet(self, name) -> Sheet | None:
        """The sheet of that name, blanks around and letter case aside; the
        first tab if several fold alike."""
        folded = {s.name.strip().lower(): s for s in reversed(self.sheets)}
        return folded.get((name or "").strip().lower())

    def _texts(self, sh: Sheet, cols: list[str], blank: bool) -> str:
        """SQL of a record's cells as texts; ``blank``: "" for an empty cell, else null."""
        tz = self.spark.conf.get("spark.sql.session.timeZone")
        types = {f.name: f.dataType for f in sh.df.schema.fields}
        cells = [cell_text_sql(c, types[c], tz) for c in cols]
        return "array(" + ", ".join(f"coalesce({c}, '')" if blank else c for c in cells) + ")"

    def _rows(self, sh: Sheet, body: DataFrame | None, header: bool, cols: list[str], blank: bool, first_col: int = 1) -> DataFrame | None:
        from quarry.operators.rules import sql_str
        head = [f"{sh.ord} AS sheet_ord", f"{sql_str(sh.name)} AS sheet", f"{first_col} AS first_col"]
        parts = []
        if header:
            names = "array(" + ", ".join(sql_str(c) for c in cols) + ")"
            parts.append(self.spark.range(0, 1, 1, 1).selectExpr(*head, "CAST(1 AS BIGINT) AS row_no", names + " AS cells")
                         .withColumn("gate", needs_nfkc(F.concat_ws(" ", "cells"))))
        if body is not None:
            # numbers and dates hold nothing that NFKC could change
            texts = [F.col(f"`{f.name}`") for f in sh.df.schema.fields if f.name in cols and isinstance(f.dataType, T.StringType)]
            gate = needs_nfkc(F.concat_ws(" ", *texts)) if texts else F.lit(False)
            parts.append(body.select(*[F.expr(x) for x in head], F.expr(f"CAST(`{sh.key}` AS BIGINT) + 2 AS row_no"),
                                     F.expr(self._texts(sh, cols, blank) + " AS cells"), gate.alias("gate")))
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def all_rows(self) -> DataFrame:
        """Every row of every sheet in long form: sheet_ord, sheet,
        row_no, cells (texts in column order, "" where empty), gate (NFKC may
        change the row). Nothing is gathered, so a sheet of any size is read by as many tasks as its
        table has splits."""
        heads = [(sh.ord, sh.name, 1, sh.columns) for sh in self.sheets]
        out = self.spark.createDataFrame(heads, "sheet_ord int, sheet string, row_no bigint, cells array<string>").coalesce(1) \
            .withColumn("gate", needs_nfkc(F.concat_ws(" ", "cells")))
        for sh in self.sheets:
            out = out.unionByName(self._rows(sh, sh.df, False, sh.columns, True).drop("first_col"))
        return out

    def rows_of(self, sh: Sheet, row_lo: int, row_hi: int, col_lo: int, col_hi: int) -> DataFrame | None:
        """The rows of a rectangle: sheet_ord, row_no, first_col, cells (null
        where empty). The rows become a pushed-down key filter and only the
        rectangle's columns are read."""
        cols = sh.columns[col_lo - 1:col_hi]
        if not cols:
            return None
        body = sh.df.where(F.col(sh.key).between(max(row_lo, 2) - 2, row_hi - 2)) if row_hi >= 2 else None
        rows = self._rows(sh, body, row_lo <= 1, cols, False, col_lo)
        return None if rows is None else rows.drop("sheet", "gate")

    def some_rows(self, sh: Sheet, row_nos: list[int]) -> DataFrame:
        """Single rows, by a pushed-down key filter: sheet_ord, row_no, cells."""
        keys = [r - 2 for r in row_nos if r >= 2]
        body = sh.df.where(F.col(sh.key).isin(keys)) if keys else None
        return self._rows(sh, body, 1 in row_nos, sh.columns, True).drop("first_col", "sheet")

    def sizes(self) -> dict[int, int]:
        """Last row of every sheet, from the tables' own statistics."""
        out = None
        for sh in self.sheets:
            n = sh.df.agg(F.max(sh.key).cast("bigint").alias("k")).select(F.lit(sh.ord).alias("o"), "k")
            out = n if out is None else out.unionByName(n)
        return {r["o"]: 1 if r["k"] is None else r["k"] + 2 for r in out.collect()}

    def rows_containing(self, phrases: list[str]) -> DataFrame:
        """Rows of whole sheets with a cell that contains a phrase (both
        normalised, as in R0): phrase, sheet, row_no, cells. A blank phrase is
        in every cell, so it gives every row."""
        from quarry.functions.nfkc import nfkc_strings
        from quarry.functions.text import normalize_py, normalize_tail
        from quarry.operators.rules import sql_str
        rows = self.all_rows().drop("sheet_ord")
        rows = rows.withColumn("plain", nfkc_strings(F.col("cells"), F.col("gate"))) \
            .withColumn("norm", F.transform("plain", normalize_tail))
        found = F.array(*[F.when(F.expr(f"exists(norm, c -> contains(c, {sql_str(normalize_py(p))}))"), F.lit(p))
                          for p in phrases])
        return rows.select(F.explode_outer(found).alias("phrase"), "sheet", "row_no", "cells") \
            .filter(F.col("phrase").isNotNull())

    def grid(self, sheet: Sheet) -> DataFrame:
        """The first 60 rows x 30 columns of a sheet with A1 addresses."""
        from quarry.functions.text import column_letters
        c = sheet.cells(1, GRID_ROWS, 1, GRID_COLS)
        return c.select(
            "sheet", "row_no", "col_no",
            F.concat(column_letters(F.col("col_no")), F.col("row_no").cast("string")).alias("ref"),
            F.coalesce(F.col("value"), F.lit("")).alias("value"))
