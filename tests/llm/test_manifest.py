"""Merkle manifests against trees built whole, in plain Python."""

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quarry.llm import merkle

from .brute import documents


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r):
    return h(*[field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way_of(levels, i):
    out = []
    for row in levels[:-1]:
        out.append((row[i ^ 1] if i ^ 1 < len(row) else "", bool(i & 1)))
        i >>= 1
    return out


def audit(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    trees = {g: levels_of([leaf_of(r) for r in groups[g]]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            way, shown = way_of(trees[g], i) + way_of(top, k), dict(r)
            if r["doc_id"] is not None and r["n_chars"] is not None and crc32(str(r["doc_id"]).encode()) % 7 == 0:
                shown["n_chars"] += 1
            now = leaf_of(shown)
            for d, left in way:
                now = h(d, now) if left else h(now, d)
            out.append((r["doc_id"], leaf_of(r), trees[g][-1][0], top[-1][0], h(*[d for d, _ in way]), now, now == top[-1][0]))
    return out


def odd_rows(spark):
    docs = documents(spark, [(i, f"text {i} ß🙂" * (i % 5)) for i in range(90)])
    langs = F.expr("case when doc_id % 3 = 0 then null when doc_id < 60 then 'en' when doc_id = 61 then '' when doc_id = 62 then 'é' "
                   "when doc_id = 64 then '\U0001f600' else lang end")
    docs = docs.withColumn("lang", langs).withColumn("n_chars", F.expr("if(doc_id in (7, 14, 21), null, n_chars)"))
    more = docs.filter("doc_id in (5, 6)")  # repeated rows
    null_ids = docs.filter("doc_id in (8, 9, 10)").withColumn("doc_id", F.lit(None).cast("long"))
    null_texts = docs.filter("doc_id in (11, 12)").withColumn("text", F.lit(None).cast("string"))  # ties of ids
    return docs.unionByName(more).unionByName(null_ids).unionByName(null_texts)


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_audit_equals_whole_trees(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    docs = odd_rows(spark)
    got = merkle.audit(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = audit([r.asDict() for r in docs.collect()])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert 0 < sum(not r[-1] for r in want) < len(want)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows(spark, n):
    docs = documents(spark, [(i, "same") for i in range(n)])
    assert sorted(map(repr, map(tuple, merkle.audit(docs).collect()))) == sorted(map(repr, audit([r.asDict() for r in docs.collect()])))


def test_proofs_of_some_leaves(spark, monkeypatch):
    """A partition fetches only what its own leaves do not give."""
    monkeypatch.setattr(merkle, "BITS", 3)
    docs = odd_rows(spark)
    rows = docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"),
                       merkle.digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"))
    manifest = merkle.build(rows)
    for k in (2, 5):
        proved = merkle.prove(manifest, manifest.leaves.filter(f"idx % {k} = 1"))
        roots = {r[0] for r in proved.select(merkle.folded("leaf")).distinct().collect()}
        assert roots == {manifest.root}
        assert proved.count() == manifest.leaves.filter(f"idx % {k} = 1").count() > 0


def test_missing_is_the_smallest_set():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 40)
        levels = levels_of([h(str(i)) for i in range(n)])
        wanted = rng.sample(range(n), rng.randint(1, n))
        asked = merkle.missing(wanted, n)
        fetched = {(k, i): levels[k][i] for k, i in asked}
        ways = merkle.ways({i: levels[0][i] for i in wanted}, fetched, n)
        assert ways == {i: tuple(way_of(levels, i)) for i in wanted}
        # no node of the set can be derived from the wanted leaves or the others of the set
        spans = [range(i << k, min((i + 1) << k, n)) for k, i in asked]
        assert not any(set(s) & set(wanted) for s in spans)
        assert sum(map(len, spans)) == len(set().union(*spans)) == n - len(wanted)


def test_clean_names(spark):
    docs = documents(spark, [(1, "a"), (2, "b")]).withColumn("tree", F.lit(1)).withColumn("idx", F.lit(2)).withColumn("leaf", F.lit("x"))
    assert merkle.audit(docs).count() == 2
