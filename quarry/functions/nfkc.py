"""NFKC, the one normalisation step Spark has no built-in for.

An Arrow-batched pandas UDF over an array of strings. Callers pass null for
rows that cannot change (see ``text.needs_nfkc``), so almost every row
crosses to Python as a null and comes straight back.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import needs_nfkc


def _nfkc_list(values):
    if values is None:
        return None
    return [None if v is None else unicodedata.normalize("NFKC", v) for v in values]


def _nfkc_array(arrays: pd.Series) -> pd.Series:
    return arrays.map(_nfkc_list)


def _nfkc_string(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


# Marked non-deterministic on purpose: it keeps the optimizer from copying
# the UDF (and the array expressions below it) into pushed-down filters or
# collapsed projections, so each file's text crosses to Python at most once.
nfkc_array = F.pandas_udf(_nfkc_array, T.ArrayType(T.StringType())).asNondeterministic()
nfkc_string = F.pandas_udf(_nfkc_string, T.StringType()).asNondeterministic()


def _nfkc_block(b):
    b = dict(b)
    if b.get("text") is not None:
        b["text"] = unicodedata.normalize("NFKC", b["text"])
    if b.get("rows") is not None:
        b["rows"] = [[None if c is None else unicodedata.normalize("NFKC", c) for c in r] for r in b["rows"]]
    return b


def _nfkc_blocks(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda bs: None if bs is None else [_nfkc_block(b) for b in bs])


def nfkc_blocks(blocks: Column, gate: Column, block_type: str) -> Column:
    """NFKC of every paragraph text and cell of a file's blocks where
    ``gate`` holds; other files pass a null through the UDF and keep their
    blocks. One projection: the corpus is read once."""
    udf = F.pandas_udf(_nfkc_blocks, f"array<{block_type}>").asNondeterministic()
    return F.coalesce(udf(F.when(gate, blocks)), blocks)


def nfkc_strings(texts: Column, gate: Column) -> Column:
    """NFKC of every element of ``texts`` where ``gate`` holds, else as is."""
    return F.coalesce(nfkc_array(F.when(gate, texts)), texts)


def nfkc(text: Column) -> Column:
    """NFKC of one string column, gated per row."""
    return F.coalesce(nfkc_string(F.when(needs_nfkc(text), text)), text)
