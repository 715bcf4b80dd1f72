"""Near-duplicate documents: a multi-index Hamming join on MinHash signatures,
confirmed on full shingle sets.

A document's set holds its distinct 5-word shingles. The signature has
``chunks`` chunks of ``width`` components; a component keeps 16 bits of one
MinHash. Two signatures differ in some number of components. If that is at
most ``distance`` = 2 * chunks - 1, then by pigeonhole some chunk differs in
at most one component. Every chunk therefore gives one key for each component
left out, and all pairs within the distance share a key. The layout goes with
the similarity: sets exactly that much alike differ in more components than
the distance with a probability below one in 100,000 (``AT_85``) or in a
million (``AT_80``).

Equal sets are one class and are joined once. In a bucket no pairs are
written out: first every class is held against one pivot of its buckets only
and the links found make components. Then only pairs of classes in different
components are compared, on signatures first. The rows of a bucket of more
than ``BLOCK_ROWS`` are dealt over blocks, by whether they are of its largest
component and by bands of set size, and every two blocks that can hold a link
meet in a group of their own. Each class brings a bitmap of its shingles there (a
hashed bit each). Bits that differ prove as many shingles that differ, which
bounds the similarity of a pair from above; a pair that cannot reach it is
not written. Links are confirmed on the shingle sets of the whole texts. A
pair within one component needs no comparison, since the component would not
change.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.store import keep, release

SHINGLE = 5


@dataclass(frozen=True)
class Layout:
    """Signatures for links at ``percent`` of similarity or more."""
    percent: int
    chunks: int
    width: int

    @property
    def parts(self) -> int:
        return self.chunks * self.width

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1


AT_85 = Layout(85, 11, 5)
AT_80 = Layout(80, 14, 4)
#: Rows of a bucket's largest component that one block takes.
BLOCK_ROWS = 4096
#: Shingles that are hashed at once.
AT_ONCE = 200_000

#: The widest signature the random numbers below provide for.
MOST_PARTS = 64
_RANDOM = np.random.default_rng(20240229)
_ODD = _RANDOM.integers(1, 1 << 63, MOST_PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, MOST_PARTS, dtype=np.uint64)
_PLACE = _RANDOM.integers(1, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PART = _RANDOM.integers(1, 1 << 62, MOST_PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RANDOM.integers(0, 1 << 62, MOST_PARTS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. Words are what lies
    between space and U+0009 to U+000D, with A-Z in lower case. Fewer words
    than a shingle make one entry; no words make none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxh64_intdigest(b"\n".join(words), len(words))], dtype=np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    m = len(words) - SHINGLE + 1
    out = h[:m] * _PLACE[0]
    for k in range(1, SHINGLE):
        out += h[k:k + m] * _PLACE[k]
    return np.unique(_mix(out))


def signatures(sets: list[np.ndarray], layout: Layout = AT_85) -> np.ndarray:
    """One row of 16-bit components for each non-empty set."""
    out = np.empty((len(sets), layout.parts), dtype=np.uint16)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= AT_ONCE):
            size += len(sets[end])
            end += 1
        joined = np.concatenate(sets[at:end])
        starts = np.cumsum([0] + [len(s) for s in sets[at:end - 1]])
        for k in range(layout.parts):
            least = np.minimum.reduceat(joined * _ODD[k] + _ADD[k], starts)
            out[at:end, k] = _mix(least) >> np.uint64(48)
        at = end
    return out


def bucket_keys(sig: np.ndarray, layout: Layout = AT_85) -> np.ndarray:
    """A key for each component: of its chunk, all others."""
    weighted = sig.astype(np.uint64) * _PART[:layout.parts]
    chunks = weighted.reshape(len(sig), layout.chunks, layout.width)
    whole = np.repeat(chunks.sum(axis=2, dtype=np.uint64), layout.width, axis=1)
    return _mix(whole - weighted + _SALT[:layout.parts]).view(np.int64)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    from xxhash import xxh3_128_intdigest

    m = xxh3_128_intdigest(shingles.tobytes())
    return (m >> 64) - (1 << 63), (m & ((1 << 64) - 1)) - (1 << 63)


def _sign(docs: DataFrame, id_col: str, text_col: str, layout: Layout) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for whole in batches:
            for batch in (whole.slice(k, 1000) for k in range(0, whole.num_rows, 1000)):
                sets = [shingle_set(x.as_py()) for x in batch.column(1)]
                some = [k for k, s in enumerate(sets) if len(s)]
                sig = iter(signatures([sets[k] for k in some], layout)) if some else iter(())
                marks = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                     pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "d1", "d2", "sig"])

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {id_type}, n_shingles long, d1 long, d2 long, sig binary"))


def _keys(classes: DataFrame, layout: Layout) -> DataFrame:
    id_type = classes.schema["rep"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, layout.parts)
            flat = bucket_keys(sig, layout).reshape(-1)
            offsets = pa.array(np.arange(0, len(flat) + 1, layout.parts), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                                             names=["rep", "keys"])

    return (classes.select("rep", "sig").mapInArrow(run, f"rep {id_type}, keys array<long>")
            .select("rep", F.explode("keys").alias("key")))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=-1)


def _signature_distance(a: str, b: str, layout: Layout) -> Column:
    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, layout.parts) for s in (x, y))
        return pd.Series(_distance(p, q).astype(np.int32))

    return run(a, b)


def _sizes_allow(na: str, nb: str, layout: Layout) -> Column:
    """Sets of such sizes can reach the similarity."""
    return F.expr(f"100 * least({na}, {nb}) >= {layout.percent} * greatest({na}, {nb})")


def _linked(pairs: DataFrame, texts: DataFrame, layout: Layout) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    id_type = pairs.schema["a"].dataType.simpleString()
    ta = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last: dict[str, tuple] = {}

        def of(side: str, text: str) -> np.ndarray:
            if side not in last or last[side][0] != text:
                last[side] = (text, shingle_set(text))
            return last[side][1]

        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                s, t = of("a", x.as_py()), of("b", y.as_py())
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(len(s) > 0 and 100 * both >= layout.percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(run, f"a {id_type}, b {id_type}")


def bitmap(shingles: np.ndarray) -> bytes:
    """One hashed bit for each shingle, in eight to sixteen bits a shingle."""
    size = 1 << max(6, (8 * len(shingles) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of a bucket. One twice as long folds onto a shorter one, since
    its places are the same hash with a bit more."""

    def __init__(self, maps: list[bytes]):
        self.size = np.array([len(m) for m in maps])
        self.row, self.of = np.zeros(len(maps), np.int64), {}
        for size in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == size)
            self.row[at] = np.arange(len(at))
            self.of[size] = np.frombuffer(b"".join(maps[k] for k in at), np.uint64).reshape(len(at), -1)

    @staticmethod
    def _fold(m: np.ndarray, words: int) -> np.ndarray:
        while m.shape[1] > words:
            half = m.shape[1] // 2
            m = m[:, :half] | m[:, half:]
        return m

    def differ(self, c: np.ndarray, r: int) -> np.ndarray:
        """Bits that differ between each of c and r: at most the number of
        shingles that only one of the two has."""
        out, mine = np.zeros(len(c), np.int64), self.of[int(self.size[r])][self.row[[r]]]
        for size in np.unique(self.size[c]).tolist():
            at = np.flatnonzero(self.size[c] == size)
            words = min(size // 8, mine.shape[1])
            others = self._fold(self.of[size][self.row[c[at]]], words)
            out[at] = np.bitwise_count(others ^ self._fold(mine, words)).sum(axis=1)
        return out


def _bitmaps(pool: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, d1, bits) of the classes in the pool."""
    id_type = texts.schema["rep"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_digest(s)[0] for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary())],
                names=["rep", "d1", "bits"])

    return (texts.join(pool, "rep", "left_semi").select("rep", "text")
            .mapInArrow(run, f"rep {id_type}, d1 long, bits binary").dropDuplicates(["rep", "d1"]))


def _first_key(x: np.ndarray, y: np.ndarray, layout: Layout = AT_85) -> np.ndarray:
    """Index of the first key that two signatures share."""
    differ = (x != y).reshape(len(x), layout.chunks, layout.width)
    chunk = (differ.sum(axis=2) <= 1).argmax(axis=1)
    inside = differ[np.arange(len(x)), chunk]
    return chunk * layout.width + inside.argmax(axis=1)


def _across(rows: DataFrame, layout: Layout) -> DataFrame:
    """Pairs (a, b) of different components within the distance whose bitmaps allow
    a link, from rows (key, block, other, rep, n, sig, bits, label, home, visits)
    sorted by key, block and other. A pair is written once, in the bucket of the
    first key it shares."""
    id_type = rows.schema["rep"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def pairs(group: pa.Table) -> Iterator:
            rep, label = (np.array(group.column(c).to_pylist()) for c in ("rep", "label"))
            n, visits, home = (group.column(c).to_numpy(zero_copy_only=False) for c in ("n", "visits", "home"))
            bits = Bitmaps(group.column("bits").to_pylist())
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, layout.parts)
            key = group.column("key")[0].as_py()
            left, right = np.flatnonzero(home), np.flatnonzero(visits)
            for r in right:
                # rows that are both meet in one order only; one that is only at home meets every visitor
                c = left[(label[left] != label[r]) & (~visits[left] | (rep[left] < rep[r]))]
                c = c[100 * np.minimum(n[c], n[r]) >= layout.percent * np.maximum(n[c], n[r])]
                c = c[_distance(sig[c], sig[r]) <= layout.distance] if len(c) else c
                c = (c[(100 + layout.percent) * bits.differ(c, r) <= (100 - layout.percent) * (n[c] + n[r])]
                     if len(c) else c)
                if len(c):
                    other = np.broadcast_to(sig[r], (len(c), layout.parts))
                    mine = bucket_keys(sig[c], layout)[np.arange(len(c)), _first_key(sig[c], other, layout)] == key
                    if mine.any():
                        yield rep[c[mine]], np.full(mine.sum(), rep[r])

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            group = [rest.column(c).to_numpy() for c in ("key", "block", "other")]
            cuts = [0, *(np.flatnonzero(np.any([g[1:] != g[:-1] for g in group], axis=0)) + 1).tolist()]
            for s, e in zip(cuts, cuts[1:]):
                yield from (_pair_batch(*x) for x in pairs(rest.slice(s, e - s)))
            rest = rest.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield from (_pair_batch(*x) for x in pairs(rest))

    def _pair_batch(a, b):
        import pyarrow as pa
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(run, f"a {id_type}, b {id_type}")


def _mixed(hits: DataFrame, label: DataFrame) -> DataFrame:
    """(key, rep, label, top, heavy) of the buckets that hold several
    components; ``top`` is the largest of them, ``heavy`` are buckets of more
    rows than a block."""
    labelled = (hits.select("key", "rep").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
                .select("key", "rep", F.coalesce("component", "rep").alias("label")))
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("m"))
    mixed = (sizes.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("labels"), F.sum("m").alias("rows"))
             .filter("labels > 1")
             .select("key", F.col("top.label").alias("top"), (F.col("rows") > BLOCK_ROWS).alias("heavy")))
    return labelled.join(mixed, "key")


def _dealt(pool: DataFrame, sigs: DataFrame, layout: Layout = AT_85) -> DataFrame:
    """The rows of mixed buckets, dealt over groups (key, block, other) and
    sorted. A light bucket is one group. Rows of a heavy one have a block of
    about ``BLOCK_ROWS`` among those of their side (largest component or not)
    and band of set size. Two blocks meet in one group unless both are of the
    largest component or their bands are not next to each other, as sets of
    such bands are too different in size. So a group holds two blocks at most."""
    # wider than the sizes of a link can differ, so rounding moves no link two bands apart
    band = F.floor(F.log("n") / F.log(F.lit(100 / (layout.percent - 1)))).cast("long")
    side = (F.col("label") != F.col("top")).cast("long")
    sized = pool.filter("heavy").join(sigs.select("rep", "n"), "rep")
    cells = (sized.groupBy("key", side.alias("side"), band.alias("band"))
             .agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("blocks"))
             .groupBy("key").agg(F.collect_list(F.struct("side", "band", "blocks")).alias("cells")))
    number = "shiftleft({0}, 56) + shiftleft({1}, 40) + {2}"  # blocks in order: largest component, then the others
    mine = "element_at(filter(cells, c -> c.side = side and c.band = band), 1).blocks"
    meets = "filter(cells, c -> abs(c.band - band) <= 1 and (c.side = 1 or side = 1))"
    rows = (pool.join(sigs, "rep").withColumn("side", side).withColumn("band", band).join(cells, "key", "left")
            .withColumn("own", F.expr(f"if(heavy, {number.format('side', 'band', f'pmod(xxhash64(rep), {mine})')}, 0L)"))
            .withColumn("met", F.explode(F.expr(
                f"if(heavy, flatten(transform({meets}, c -> transform(sequence(0L, c.blocks - 1), "
                f"k -> {number.format('c.side', 'c.band', 'k')}))), array(0L))")))
            .withColumn("block", F.least("own", "met")).withColumn("other", F.greatest("own", "met"))
            .withColumn("home", F.col("own") <= F.col("met"))
            .withColumn("visits", (F.col("own") >= F.col("met")) & (F.col("side") == 1))
            .select("key", "block", "other", "rep", "n", "sig", "bits", "label", "home", "visits"))
    return rows.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layout: Layout = AT_85,
                    among: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept. Linked
    are sets alike to ``layout.percent`` or more.

    ``doc_id`` is an integer. Rows that share an id count as one document with
    several texts. A row without an id links with nothing: its component_id is
    null and it is kept. Null, empty and blank texts have no shingles and are
    components of their own. ``among`` (distinct ``doc_id``) names the documents
    that take part, where others are to be left out. ``docs`` is read twice: for
    signatures, and for the texts of documents that share a bucket with another;
    only these pass a shuffle or are stored."""
    signed = _sign(docs, id_col, text_col, layout)
    signed = keep(signed if among is None else signed.join(among, "doc_id", "left_semi"), "signatures")
    classes = keep(signed.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles")
                   .agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")), "classes")
    keys = _keys(classes, layout)
    # buckets of two or more documents, each with its smallest one as pivot; texts of one document need no link
    shared = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).filter("pivot < last").drop("last")
    hits = keep(keys.join(shared, "key").dropDuplicates(["key", "rep"]), "buckets")
    sigs = classes.select("rep", "sig", F.col("n_shingles").alias("n"))
    texts = keep(docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
                 .join(hits.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep", "text"]), "texts")

    # first: every class against the nearest pivot of its buckets
    near = (hits.filter("rep <> pivot").select("rep", "pivot").distinct().join(sigs, "rep")
            .join(sigs.select(F.col("rep").alias("pivot"), F.col("sig").alias("psig"), F.col("n").alias("pn")), "pivot")
            .filter(_sizes_allow("n", "pn", layout))
            .withColumn("far", _signature_distance("sig", "psig", layout)).filter(F.col("far") <= layout.distance)
            .groupBy("rep").agg(F.min(F.struct("far", "pivot")).alias("p"))
            .select(F.col("rep").alias("a"), F.col("p.pivot").alias("b")))
    links = keep(_linked(near, texts, layout), "links")
    label = keep(components(links), "labels")

    # then: classes of different components that share a bucket
    pool = keep(_mixed(hits, label), "mixed")
    full = classes.select("rep", "d1", "sig", F.col("n_shingles").alias("n")).join(
        _bitmaps(pool.select("rep").distinct(), texts), ["rep", "d1"])
    rest = keep(_across(_dealt(pool, full, layout), layout), "pairs")
    final = keep(components(links.unionByName(_linked(rest, texts, layout))), "labels")
    release(hits, texts, links, label, pool, rest)

    of_class = (classes.join(final, classes["rep"] == final["node"], "left")
                .select("d1", "d2", F.coalesce("component", "rep").alias("component_id")))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (signed.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layout: Layout = AT_80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the
    smallest id. The other columns pass through."""
    gone = near_duplicates(docs, id_col, text_col, layout).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
