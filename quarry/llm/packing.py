"""Best-fit packing of documents into token sequences.

Best-fit decreasing places documents from the longest to the shortest, each
into the open sequence with the least room that still holds it. Lengths are
at most ``capacity``, so all documents of one length are alike: the plan needs
only the histogram of lengths (at most ``capacity`` numbers, whatever the
corpus). Open sequences are leaves of a segment tree over remaining
capacities; the tightest one is found in logarithmic time. Documents of one
length that go to sequences of one history are placed as one run, which gives
the same sequences as placing them one by one. The plan is a short list of
runs; the rows themselves stay on the executors and find their run by their
rank among pieces of the same length. Ranks are counted per (length, salt),
so a length shared by a third of all rows is spread over ``SALTS`` groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import tokens
from quarry.llm.store import keep

CAPACITY = 1024
END_ID = 2
SALTS = 1024


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: a node knows
    whether an open sequence with such room exists below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.size
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that is open."""
        i = length + self.size
        if self.open[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Runs (length, first rank, first sequence, offset): the piece of that
    length and rank r goes to sequence ``first sequence + r - first rank`` at
    ``offset``. A run ends where the next of its length begins."""
    tree, rooms, runs, opened = CapacityTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, opened, left
            else:
                first, n = rooms[room].pop()
                tree.set(room, bool(rooms[room]))
            # a sequence stays the tightest until no further copy fits
            copies = min(room // length, left)
            used = min(n, left // copies)
            for k in range(copies):
                runs.append((length, rank, first, capacity - room + k * length))
                rank += used
            left -= used * copies
            if room == capacity and first == opened:
                opened += used
            elif n > used:
                rooms.setdefault(room, []).append((first + used, n - used))
                tree.set(room, True)
            rest = room - copies * length
            rooms.setdefault(rest, []).append((first, used))
            tree.set(rest, True)
    return runs


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces. The
    document's ids end with ``end_id``; a null text counts as empty, so every
    row has a piece. Longer documents are cut into pieces of ``capacity``
    counted from the end, so only the first piece may be shorter."""
    id_type = docs.schema[id_col].dataType.simpleString()
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = tokens.encoder(tokenizer_path)
        for batch in batches:
            ids, part, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                packed = encoder.ids(text.as_py() or "") + tail
                n, at, k = len(packed) // 4, 0, 0
                while at < n:
                    size = ((n - at - 1) % capacity + 1) if at == 0 else capacity
                    ids.append(row)
                    part.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(packed[4 * at:4 * (at + size)]))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int32())), pa.array(part, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a table of pieces with a length column.

    ``cut`` must be a stored table: it is read for the histogram and again for
    the rows. Rows alike in all columns may swap places, which no one can
    tell. An empty table gives an empty result."""
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(
        Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # at most `capacity` rows, whatever the corpus
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(plan_runs(histogram, capacity))
    lengths, firsts, bins, offsets = (np.array([r[k] for r in runs], dtype="int64") for k in range(4))
    # one sorted key for (length, rank): the widest rank decides the spacing
    width = max(histogram.values(), default=0) + 1
    keys = lengths * width + firsts

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * width + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": bins[at] + rank.to_numpy() - firsts[at], "offset": offsets[at]})

    order = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (salted.withColumn("__rank", F.row_number().over(order) - 1)
              .join(before.drop("__n"), ["length", "__salt"])
              .withColumn("__at", place("length", F.col("__rank") + F.col("__before"))))
    return ranked.select(*cut.columns, "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their places: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset. Sequences are gapless from 0.
    Null ids stay null; repeated rows are packed as often as they occur."""
    cut = keep(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    return pack(cut, capacity)
