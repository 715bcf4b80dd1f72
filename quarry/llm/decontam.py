"""Benchmark decontamination by greedy string tiling.

Texts become words (bytes of ASCII letters, digits and all non-ASCII
characters, A-Z lower-cased). Runs of ``SEED`` words that also occur in a
benchmark item are the seeds: they name the items a document may contain. For
each such pair the longest common runs of words are marked as tiles, longest
first, never overlapping in the item or in the document, until no run of
``SEED`` words is left. Matches are found by rolling Karp-Rabin hashes over
the unmarked words and confirmed word by word. The share of an item's words
under tiles does not depend on the order of the passages, so reordered copies
are found as well.

The benchmark is read in blocks of a bounded number of seeds; each block goes
to the executors once and meets every document. A document is judged alone:
there is no shuffle of the corpus, and an item copied into a third of all
documents is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 5
COVERAGE = 0.5
#: Benchmark words of one block, sent to the executors at once (some 30 bytes each there).
BLOCK_WORDS = 2_000_000

_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_TO_WORDS = bytes(32 if c in _SEPARATORS else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().translate(_TO_WORDS).split()


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every run of n word numbers."""
    h = np.zeros(max(len(ids) - n + 1, 0), dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + len(h)].astype(np.uint64) + np.uint64(1)
    return h


def tiles(item: np.ndarray, doc: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, words) of the
    tiles. Longest matches first, ties by place in the item and then in the
    document. ``doc`` holds -1 for words that no item has."""
    out: list[tuple[int, int, int]] = []
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    while True:
        # places where `shortest` unmarked words start, by their rolling hash
        hashes_d, hashes_i = _rolling(doc, shortest).tolist(), _rolling(item, shortest).tolist()
        starts: dict[int, list[int]] = {}
        for at in np.flatnonzero(_windows(free_d, shortest) & _windows(doc >= 0, shortest)).tolist():
            starts.setdefault(hashes_d[at], []).append(at)
        best: list[tuple[int, int, int]] = []
        longest = shortest
        for i in np.flatnonzero(_windows(free_i, shortest)).tolist():
            for d in starts.get(hashes_i[i], ()):
                # a match that begins one word earlier is longer and is seen there
                if i and d and free_i[i - 1] and free_d[d - 1] and item[i - 1] == doc[d - 1]:
                    continue
                n = 0
                while (i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n]
                       and item[i + n] == doc[d + n]):
                    n += 1
                if n > longest:
                    best, longest = [], n
                if n == longest:
                    best.append((i, d, n))
        if not best:
            return out
        for i, d, n in best:
            if free_i[i:i + n].all() and free_d[d:d + n].all():
                free_i[i:i + n] = False
                free_d[d:d + n] = False
                out.append((i, d, n))


def _windows(ok: np.ndarray, n: int) -> np.ndarray:
    """Starts of n true values in a row."""
    if len(ok) < n:
        return np.zeros(0, bool)
    total = np.concatenate([[0], np.cumsum(ok)])
    return total[n:] - total[:-n] == n


class Items:
    """A block of benchmark items ready to be met by documents."""

    def __init__(self, items: list[tuple[object, list[bytes]]], seed: int):
        self.seed, self.number, self.items = seed, {}, []
        hashes, owners = [], []
        for key, words in items:
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in words], dtype=np.int64)
            self.items.append((key, ids))
            # an item shorter than a seed is sought as a whole
            for n in ([seed] if len(ids) >= seed else [len(ids)] if len(ids) else []):
                h = np.unique(_rolling(ids, n) ^ np.uint64(n))
                hashes.append(h)
                owners.append(np.full(len(h), len(self.items) - 1))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owners = self.hashes[order], self.owners[order]
        self.lengths = sorted({min(len(ids), seed) for _, ids in self.items if len(ids)})

    def matches(self, text: str | None, coverage: float) -> list[tuple[object, float]]:
        """(item, covered share) of the items the text contains."""
        get = self.number.get
        doc = np.array([get(w, -1) for w in words_of(text)], dtype=np.int64)
        near: set[int] = set()
        for n in self.lengths:
            ok = _windows(doc >= 0, n)
            if not ok.any():
                continue
            h = np.unique(_rolling(doc, n)[ok] ^ np.uint64(n))
            lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                near.update(self.owners[a:b].tolist())
        out = []
        for k in sorted(near):
            key, ids = self.items[k]
            part = _around(doc, ids, min(self.seed, len(ids)))
            share = sum(n for *_, n in tiles(ids, part, min(self.seed, len(ids)))) / len(ids)
            if share >= coverage:
                out.append((key, share))
        return out


def _around(doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The document's words that lie in a run of n words shared with the item,
    with one -1 between runs: tiles can only lie there."""
    shared = np.isin(_rolling(doc, n), _rolling(ids, n)) & _windows(doc >= 0, n)
    covered = np.zeros(len(doc) + 1, np.int64)
    at = np.flatnonzero(shared)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + n, -1)
    inside = np.cumsum(covered)[:len(doc)] > 0
    border = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    cut = np.where(inside, doc, -1)
    take = inside.copy()
    take[border[border > 0] - 1] = True
    return cut[take]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int = BLOCK_WORDS) -> Iterator[list]:
    """Lists of (item, words) of at most ``limit`` words, or one longer item."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).alias("k"), F.col(text_col).alias("t")).toLocalIterator():
        words = words_of(row["t"])
        if block and size + len(words) > limit:
            yield block
            block, size = [], 0
        block.append((row["k"], words))
        size += len(words)
    if block:
        yield block


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", seed: int = SEED,
         coverage: float = COVERAGE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, contaminated, max_coverage (0 without a
    match of at least ``coverage``), items (sorted array of the matching item
    ids), and the columns named in ``keep``.

    Null or empty texts match nothing, nor do items without words. Items of
    fewer than ``seed`` words must occur as a whole. Repeated rows are judged
    alike; an empty benchmark leaves every document clean."""
    spark = docs.sparkSession
    item_type = benchmark.schema[item_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"),
                      *[F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep)],
                      F.lit(0.0).alias("max_coverage"), F.array().cast(f"array<{item_type}>").alias("items"))
    for block in blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(Items(block, seed))

        def meet(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            items = shared.value
            for batch in batches:
                best, names = batch.column("max_coverage").to_pylist(), batch.column("items").to_pylist()
                for row, text in enumerate(batch.column("__text")):
                    if found := items.matches(text.as_py(), coverage):
                        best[row] = max(best[row], *[s for _, s in found])
                        names[row] = names[row] + [k for k, _ in found]
                at = batch.schema.get_field_index
                batch = batch.set_column(at("max_coverage"), "max_coverage", pa.array(best, pa.float64()))
                yield batch.set_column(at("items"), "items", pa.array(names, batch.schema.field("items").type))

        out = out.mapInArrow(meet, out.schema)
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), "max_coverage",
                      F.array_sort(F.array_distinct("items")).alias("items"),
                      *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)])


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with their columns."""
    judged = scan(docs.withColumn("__row", F.struct(*[f"`{c}`" for c in docs.columns])), benchmark,
                  id_col, text_col, keep=("__row",), **how)
    return judged.filter(~F.col("contaminated")).select("__row.*")
