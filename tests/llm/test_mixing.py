"""Source mixing against fractions and whole counts."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing

DOCS = "doc_id long, text string, source string, size long, sid string, `__hash` long"


def water_fill(sizes, weights, total, epochs=3):
    held = {s: 0 for s in sizes if not weights[s]}
    while len(held) < len(sizes):
        room, open_w = total - sum(held.values()), sum(weights[s] for s in sizes if s not in held)
        over = [s for s in sizes if s not in held and epochs * sizes[s] * open_w <= weights[s] * max(room, 0)]
        if not over:
            return {s: float(held[s] if s in held else Fraction(room * weights[s], open_w or 1)) for s in sizes}
        held |= {s: epochs * sizes[s] for s in over}
    return {s: float(x) for s, x in held.items()}


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x", 9) for i, t, s in rows], DOCS)


def corpus(seed, sources, docs, longest=60):
    rng = random.Random(seed)
    out = []
    for i in range(docs):
        s = sources[0] if rng.random() < 1 / 3 else rng.choice(sources)
        out.append((i, None if i == 3 else " \t\n".join(["w"] * rng.randint(0, longest)) + rng.choice(["", " ", "\x0b"]), s))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken_words(spark, seed):
    sources = ["b", None, "a", "é", "🙂", "", "z" * 40, "ﬀ"][:3 + seed * 2]
    rows = corpus(seed, sources, 700)
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        low = int(want[r["source"]] / max(1, sizes[r["source"]]) + 1e-9)
        assert low <= r["copies"] <= min(3, low + 1)
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 31  # half of the longest document, at most
    again = mixing.mix(table(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_water_filling_of_all_kinds(spark):
    rng = random.Random(8)
    for total in (None, 0, 1, 10 ** 6, 10 ** 18):
        rows = [(k, rng.choice([0, 1, 5, 1000, 10 ** 15]), rng.choice([0, 1, 2, 5])) for k in range(12)]
        s = spark.createDataFrame(rows, "k int, source_size long, weight long")
        got = {r["k"]: r["target"] for r in mixing.water_fill(s, total).collect()}
        want = water_fill({k: x for k, x, _ in rows}, {k: w for k, _, w in rows}, sum(x for _, x, _ in rows) if total is None else total)
        assert got == pytest.approx(want, rel=1e-12)


def test_odd_tables(spark):
    assert mixing.mix(table(spark, [])).collect() == []
    blank = mixing.mix(table(spark, [(1, None, None), (2, "", None), (None, " ", "a")])).collect()
    assert [(r["size"], r["source_size"], r["target"], r["copies"]) for r in blank] == [(0, 0, 0.0, 0)] * 3
    one = mixing.mix(table(spark, [(1, "a b c", None)])).collect()[0]
    assert (one["source_size"], one["target"], one["copies"]) == (3, 3.0, 1)
    same = mixing.mix(table(spark, [(1, "a b", "s")] * 40 + [(2, "a b", "t")] * 10)).collect()
    assert len(same) == 50 and len({(r["source"], r["copies"]) for r in same}) == 2


def test_radix_selection_goes_down_to_single_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DIGIT_BITS", 3)
    monkeypatch.setattr(mixing, "ROUNDS", 20)
    rows = corpus(11, ["a", "b", "c"], 500)
    got = mixing.mix(table(spark, rows)).collect()
    monkeypatch.undo()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(table(spark, rows)).collect()))


def test_words(spark):
    texts = ["", " ", "a", " a", "a ", " a  b\x0bc\x0c", "\xa0", "a\x1fb", "a\x85b c", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.words(F.col("t")))
    assert [r[0] for r in df.collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_repeated_rows_of_the_mix(spark):
    rows = corpus(2, ["a", "b"], 80)
    docs = table(spark, rows)
    mixed = mixing.mix(docs)
    got = sorted((r["doc_id"], r["epoch"]) for r in mixing.repeated(docs, mixed).collect())
    assert got == sorted((r["doc_id"], e) for r in mixed.collect() for e in range(r["copies"]))
