"""Near duplicates, line runs, decontamination, WARC, token rollups and the
pipeline against plain versions."""

import io
import random

import numpy as np
import pytest

from quarry.llm import components, decontam, line_dedup, neardup, token_counts, warc
from quarry.llm.store import new_path

from .brute import documents, line_dedup as plain_lines, near_components, prose, warc_rows


def near_texts(seed, n=160):
    """Copies, near copies around the threshold, chains of edits, short texts."""
    rng, out = random.Random(seed), []
    seeds = [prose(rng, rng.choice([4, 6, 12, 40, 120]), 10**6) for _ in range(12)]
    for k in range(n):
        w = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            w += prose(rng, rng.randint(1, 5), 10**6)
        if rng.random() < 0.2:
            seeds.append(w)
        out.append((k, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b"), (n + 4, "A  B"), (n + 5, "a\u00a0b")]


@pytest.mark.parametrize("seed, layout", [(1, neardup.AT_85), (2, neardup.AT_85), (1, neardup.AT_80), (4, neardup.AT_80)])
def test_near_duplicates_equal_all_pairs(spark, seed, layout):
    texts = near_texts(seed)
    rows = neardup.near_duplicates(documents(spark, texts), layout=layout).collect()
    want = near_components(texts, layout.percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_one_document_of_each_group_stays(spark):
    texts = near_texts(5)
    kept = neardup.keep_one(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in near_components(texts, 80).items() if c == i)
    assert near_components(texts, 80) != near_components(texts, 85)
    assert kept.columns == documents(spark, []).columns


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    texts = near_texts(3, 120)
    rows = neardup.near_duplicates(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == near_components(texts)


def test_no_group_holds_a_bucket_of_single_components(spark, monkeypatch):
    """A bucket of documents that are not linked, and one component of 60."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 32)
    rng = random.Random(6)
    n = {k: rng.choice([1, 7, 100, 100, 100, 115, 117, 118, 400]) for k in range(500)}
    label = {k: 0 if k < 60 else k for k in n}
    hits = spark.createDataFrame([(5, k) for k in n] + [(6, k) for k in range(50, 70)], "key long, rep long")
    labels = spark.createDataFrame([(k, 0) for k in range(60)], "node long, component long")
    sigs = spark.createDataFrame([(k, m, b"", b"") for k, m in n.items()], "rep long, n long, sig binary, bits binary")
    groups = {}
    for r in neardup._dealt(neardup._mixed(hits, labels), sigs, neardup.AT_85).collect():
        groups.setdefault((r.key, r.block, r.other), []).append(r)
    assert max(map(len, groups.values())) <= 4 * 32  # two blocks, dealt by a hash
    met = {}
    for (key, *_), rows in groups.items():
        for x in rows:
            for y in rows:
                if x.home and y.visits and x.label != y.label and (not x.visits or x.rep < y.rep):
                    pair = (key, *sorted((x.rep, y.rep)))
                    met[pair] = met.get(pair, 0) + 1
    assert set(met.values()) == {1}
    want = {(key, a, b) for key, ids in ((5, n), (6, range(50, 70))) for a in ids for b in ids
            if a < b and label[a] != label[b] and 100 * min(n[a], n[b]) >= 85 * max(n[a], n[b])}
    assert want <= set(met)


@pytest.mark.parametrize("layout", [neardup.AT_85, neardup.AT_80])
def test_pigeonhole_keys(layout):
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, (1, layout.parts), dtype=np.uint16)
        b = a.copy()
        at = rng.choice(layout.parts, rng.integers(0, layout.distance + 1), replace=False)
        b[0, at] ^= 1
        x, y = neardup.bucket_keys(a, layout)[0], neardup.bucket_keys(b, layout)[0]
        shared = np.flatnonzero(x == y)
        assert len(shared) and neardup._first_key(a, b, layout)[0] == shared[0]


def test_bitmaps_never_claim_too_much():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[3:], rng.integers(0, 1 << 63, 9, dtype=np.uint64)]))]
    bits = neardup.Bitmaps([neardup.bitmap(s) for s in sets])
    every = np.arange(len(sets))
    for r in every:
        differ = bits.differ(every, r)
        assert all(d <= len(np.setxor1d(sets[c], sets[r])) for c, d in zip(every, differ))
        assert differ[r] == 0


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = neardup.near_duplicates(documents(spark, [(9, long), (9, long), (2, long + " x"), (None, long)])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in rows) == [(-1, None, True), (2, 2, True), (9, 2, False), (9, 2, False)]
    assert neardup.near_duplicates(documents(spark, [])).collect() == []


def test_components(spark):
    rng = random.Random(7)
    pairs = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(200, 200)]
    up = {}
    for a, b in pairs:
        if a != b:
            ra, rb = (next(iter(c for c in up.values() if x in c), {x}) for x in (a, b))
            both = ra | rb
            up.update({x: both for x in both})
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: min(c) for x, c in up.items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def line_texts(seed):
    rng = random.Random(seed)
    stock = ["", "a b c", "d e", "f g h i", "j", "k l m n o p", "q r"]
    passages = [[rng.choice(stock) for _ in range(rng.randint(1, 9))] for _ in range(6)]
    out = []
    for k in range(40):
        lines = []
        for _ in range(rng.randint(1, 5)):
            lines += rng.choice([rng.choice(passages), [rng.choice(stock)], [f"u{rng.randrange(10**6)} v"], passages[0][:3]])
        out.append((k, "\n".join(lines)))
    return out + [(40, None), (41, ""), (42, "a b c\n" * 30), (43, out[5][1])]


@pytest.mark.parametrize("seed,least", [(1, 5), (2, 1), (3, 12)])
def test_line_runs_equal_all_pairs(spark, seed, least):
    texts = line_texts(seed)
    rows = line_dedup.dedup(documents(spark, texts), min_words=least, keep_cols=("n_chars", "d")).collect()
    assert {r.doc_id: r.text for r in rows} == plain_lines(texts, least)
    source = dict(texts)
    for r in rows:
        before = 0 if source[r.doc_id] is None else source[r.doc_id].count("\n") + 1
        assert r.n_lines == before and r.n_removed >= 0 and r.d == "z"


def test_line_runs_odd_rows(spark):
    line = " ".join(f"w{k}" for k in range(30))
    rows = line_dedup.dedup(documents(spark, [(1, line), (1, line), (None, line), (2, f"x\n{line}")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, line), (1, ""), (1, ""), (2, "x")]
    assert line_dedup.dedup(documents(spark, [])).collect() == []
    assert line_dedup.dedup(documents(spark, [(1, "a"), (2, "b")])).count() == 2


def test_short_line_in_thousands_of_documents(spark):
    texts = [(k, f"own line {k}\n\nShare this page\nown end {k}") for k in range(3000)]
    rows = line_dedup.dedup(documents(spark, texts)).collect()
    assert sum("Share this page" in r.text for r in rows) == 1
    assert {r.doc_id: r.text for r in rows} == {0: texts[0][1]} | {k: f"own line {k}\nown end {k}" for k in range(1, 3000)}


def test_blank_lines_are_no_real_lines(spark):
    rows = line_dedup.dedup(documents(spark, [(1, "a\n\n \nb"), (2, "c\n\n \nd")])).collect()
    assert {r.doc_id: r.text for r in rows} == {1: "a\n\n \nb", 2: "c\n\n \nd"}


def plain_tiles(item, doc, shortest):
    """Greedy tiling by looking at all places each time."""
    mi, md, out = [False] * len(item), [False] * len(doc), []
    while True:
        best, longest = [], shortest
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (i + n < len(item) and d + n < len(doc) and not mi[i + n] and not md[d + n]
                       and item[i + n] == doc[d + n] and doc[d + n] >= 0):
                    n += 1
                if n > longest:
                    best, longest = [], n
                if n == longest:
                    best.append((i, d, n))
        if not best:
            return out
        for i, d, n in best:
            if not any(mi[i:i + n]) and not any(md[d:d + n]):
                mi[i:i + n] = md[d:d + n] = [True] * n
                out.append((i, d, n))


def test_tiles_equal_plain_tiling():
    rng = random.Random(8)
    for _ in range(150):
        item = np.array([rng.randrange(6) for _ in range(rng.randint(1, 18))])
        doc = np.array([rng.randrange(-1, 6) for _ in range(rng.randint(0, 30))])
        assert decontam.tiles(item, doc, 2) == plain_tiles(item.tolist(), doc.tolist(), 2)


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(k, " ".join(prose(rng, 40, 10**6))) for k in range(6)] + [(6, None), (7, "..."), (8, "only three words")]
    w = items[0][1].split()
    moved = w[20:] + prose(rng, 9, 10**6) + w[:20]
    half = w[:12] + prose(rng, 80, 10**6)
    noise = [prose(rng, 50, 10**6) for _ in range(4)]
    texts = [(0, " ".join(noise[0])), (1, " ".join(noise[1] + w + noise[2])), (2, ", ".join(moved).upper()), (3, " ".join(half)),
             (4, None), (5, ""), (6, " ".join(items[1][1].split() + items[2][1].split())), (7, "x Only three WORDS."), (6, "again")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.scan(documents(spark, texts), bench).collect()
    got = sorted((r.doc_id, r["items"], round(r.max_coverage, 3)) for r in rows)
    assert got == [(0, [], 0.0), (1, [0], 1.0), (2, [0], 1.0), (3, [], 0.0), (4, [], 0.0), (5, [], 0.0), (6, [], 0.0),
                   (6, [1, 2], 1.0), (7, [8], 1.0)]
    small = decontam.scan(documents(spark, texts), bench).select("doc_id", "items")
    clean = decontam.clean(documents(spark, texts), bench)
    assert clean.columns == documents(spark, []).columns and clean.count() == small.filter("size(items) = 0").count()
    assert decontam.scan(documents(spark, []), bench).collect() == []
    assert decontam.scan(documents(spark, texts), bench.limit(0)).filter("contaminated").count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    rng = random.Random(10)
    items = [(k, " ".join(prose(rng, 30, 10**6))) for k in range(5)]
    bench, texts = spark.createDataFrame(items, "item_id long, text string"), [(k, t) for k, t in items]
    monkeypatch.setattr(decontam.blocks, "__defaults__", (70,))
    assert len(list(decontam.blocks(bench, "item_id", "text"))) == 3
    assert {r.doc_id: r["items"] for r in decontam.scan(documents(spark, texts), bench).collect()} == {k: [k] for k in range(5)}


PAGES = [(1, "http://a/ b", "x" * 99), (2, None, "x" * 99), (3, "u", "é" * 50), (4, "u", "é" * 50), (5, "v", None), (6, "v", ""),
         (7, "w", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20), (8, "w", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20), (9, "w", "🙂\n" * 100000), (0, "z", "é" * 50)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, key string")
    rows = warc.round_trip(pages.repartition(3)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == warc_rows(PAGES)
    assert len({r.record_id for r in rows}) == len(PAGES)
    assert warc.round_trip(pages.limit(0)).collect() == []
    twice = warc.round_trip(pages.limit(1).unionByName(pages.limit(1))).collect()
    assert [r.record_type for r in twice] == ["response", "response"]
    nameless = spark.createDataFrame([(None, None, None)], pages.select("page_id", "url", "html").schema)
    assert [(r.page_id, r.payload_bytes) for r in warc.round_trip(nameless).collect()] == [(None, 0)]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    body = warc.http_response(b"hello\n\n", 5)
    data = warc.arc_file_start("f", version) + b"\n" + warc.arc_record("http://a/", body, version, "2001") + b"\n"
    (record,) = warc.read_arc(io.BytesIO(data))
    assert record["version"] == version and record["body"] == body and record["url"] == "http://a/"
    assert warc.warc_date(record["date"]) == "2001-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(data[:-20])))
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(data.replace(b" text/html ", b" "))))


COUNT_SCHEMA = "doc_id long, text string, source string, lang string"


def test_token_rollup(spark):
    new = lambda rows: spark.createDataFrame(rows, COUNT_SCHEMA)
    rollup = token_counts.Rollup(spark, new_path(spark, "rollup"), {"words": token_counts.word_counter()})
    state, rng = {}, random.Random(11)
    assert rollup.totals().collect() == []
    for batch in range(1, 6):
        ups = {rng.randrange(12): (rng.choice([None, "", "a b", "c d e f"]), rng.choice(["s", "t", None]), "en") for _ in range(6)}
        gone = {rng.randrange(12) for _ in range(3)} - set(ups)
        for _ in range(2):  # a batch committed again changes nothing
            done = rollup.commit(batch, new([(k, *v) for k, v in ups.items()]), spark.createDataFrame([(k,) for k in gone], "doc_id long"))
        assert done is False
        state = {k: v for k, v in (state | ups).items() if k not in gone}
        want = {}
        for text, source, lang in state.values():
            n, t = want.get((source, lang), (0, 0))
            want[(source, lang)] = (n + 1, t + len((text or "").split()))
        assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == want


def test_token_rollup_after_a_break(spark):
    rollup = token_counts.Rollup(spark, new_path(spark, "rollup"), {"words": token_counts.word_counter()})
    docs = spark.createDataFrame([(1, "a b", "s", "en")], COUNT_SCHEMA)
    # the ledger is written, then the driver is lost before the totals
    rollup._changes(1, docs, None).write.parquet(rollup._folder("ledger", 1))
    assert rollup.totals().collect() == []
    assert rollup.commit(1, docs) and [r.n_tokens for r in rollup.totals().collect()] == [2]


def test_token_rollup_refuses_batches_out_of_order(spark):
    import itertools
    import os

    docs = {1: [(1, "a b", "s", "en"), (2, "c", "s", "en")], 2: [(1, "a b c d", "s", "en")], 3: [(2, "x y", "t", "en"), (3, "z", "t", "en")]}
    for order in itertools.permutations((1, 2, 3)):
        path = new_path(spark, "rollup")
        rollup, there = token_counts.Rollup(spark, path, {"words": token_counts.word_counter()}), {}
        for batch in order:
            late = any(b > batch for b in there.values())
            if late:
                with pytest.raises(ValueError):
                    rollup.commit(batch, spark.createDataFrame(docs[batch], COUNT_SCHEMA))
                continue
            assert rollup.commit(batch, spark.createDataFrame(docs[batch], COUNT_SCHEMA))
            there |= {r[0]: batch for r in docs[batch]}
            there.setdefault("last", batch)
        state = {}
        for batch in [b for k, b in enumerate(order) if all(b > x for x in order[:k])]:
            state |= {i: (src, len(t.split())) for i, t, src, _ in docs[batch]}
        want = {}
        for src, n in state.values():
            d, t = want.get(src, (0, 0))
            want[src] = (d + 1, t + n)
        assert {r.source: (r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == want
    # a batch that broke off while its ledger was written
    path = new_path(spark, "rollup")
    rollup = token_counts.Rollup(spark, path, {"words": token_counts.word_counter()})
    os.makedirs(rollup._folder("ledger", 1).removeprefix("file://").removeprefix("file:") + "/_temporary")
    with pytest.raises(ValueError):
        rollup.commit(2, spark.createDataFrame(docs[2], COUNT_SCHEMA))
    assert rollup.commit(1, spark.createDataFrame(docs[1], COUNT_SCHEMA)) and rollup.commit(2, spark.createDataFrame(docs[2], COUNT_SCHEMA))
    assert [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()] == [(2, 5)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    from .brute import quality as plain_quality

    rng = random.Random(12)
    clean = [prose(rng, 90, 10**6) for _ in range(8)]
    item = " ".join(prose(rng, 40, 10**6))
    passage = " ".join(prose(rng, 60, 10**6))
    texts = [(k, " ".join(w)) for k, w in enumerate(clean)]
    near = list(clean[0])
    near[3] = "changed"
    texts += [(20, " ".join(near)), (21, " ".join(clean[1])), (22, "too short"), (23, "word " * 200),
              (24, " ".join(prose(rng, 60, 10**6)) + " " + item), (25, " ".join(prose(rng, 60, 10**6)) + "\n" + passage),
              (26, " ".join(prose(rng, 70, 10**6)) + "\n" + passage), (27, None)]
    documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k + 1 < len(P.STAGES):
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(seen["quality_rules"]) == {i for i, t in texts if plain_quality(t)["kept"]}
    assert set(seen["quality_rules"]) - set(seen["line_dedup"]) == {21}
    assert seen["line_dedup"][25].endswith(passage) and passage not in seen["line_dedup"][26]
    assert set(seen["line_dedup"]) - set(seen["near_dedup"]) == {20}
    assert set(seen["near_dedup"]) - set(seen["decontamination"]) == {24}
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == set(seen["decontamination"])


def test_pipeline_drops_near_copies_of_many_lines(spark, tmp_path):
    """Line removal leaves remnants of later near copies; none of them is there
    after the near-duplicate stage, and documents that share less stay."""
    import corpus_pipeline as P

    from .brute import near_components

    rng = random.Random(21)
    texts, copies = [], set()
    shared = [" ".join(prose(rng, 12, 10**6)) for _ in range(4)]  # boilerplate of all documents
    for k in range(6):
        lines = [" ".join(prose(rng, 12, 10**6)) for _ in range(40)]
        texts.append((k, "\n".join(lines + shared)))
        for c in range(3):
            changed = list(lines)
            for at in rng.sample(range(40), 2):
                changed[at] = " ".join(prose(rng, 12, 10**6))
            texts.append((100 + 10 * k + c, "\n".join(changed + shared)))
            copies.add(100 + 10 * k + c)
    documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    parts = near_components(texts, 80)
    assert {i for i, (_, c) in parts.items() if i != c} == copies
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES[:3]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "line_dedup":
            assert copies & {r.doc_id for r in docs.collect()}  # as remnants
    assert {r.doc_id for r in docs.collect()} == set(range(6))


def test_near_dedup_stage_stores_no_texts_that_need_no_link(spark, tmp_path, monkeypatch):
    """What line removal leaves of a document shares buckets with its own whole
    text only. Of 40 documents, only the two that are near copies are stored."""
    from quarry.llm import queries as Q

    rng = random.Random(31)
    lines = {k: [" ".join(prose(rng, 12, 10**6)) for _ in range(20)] for k in range(40)}
    lines[30] = lines[3][:-1] + lines[30][-1:]
    documents(spark, [(k, "\n".join(x)) for k, x in lines.items()]).write.parquet(f"{tmp_path}/documents.parquet")
    docs = documents(spark, [(k, "\n".join(x[:-1] if k % 2 else x)) for k, x in lines.items() if k != 5])
    stored = []

    def spy(df, what="table"):
        out = keep(df, what)
        stored.append((what, {r[0] for r in out.select(out.columns[0]).collect()} if "text" in out.columns else set()))
        return out

    for module in (neardup, Q):
        keep = module.keep
        monkeypatch.setattr(module, "keep", spy)
    out = Q.stage_near_dedup(spark, docs, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(range(40)) - {5, 30}
    assert set().union(*[x for _, x in stored]) == {3, 30}


def test_archives_are_written_at_a_fast_level(spark, tmp_path):
    import glob
    import gzip
    import zlib

    rng = random.Random(32)
    pages = spark.createDataFrame([(k, "u", " ".join(prose(rng, 3000, 500))) for k in range(20)], "page_id long, url string, html string")
    warc.write_arc(pages.coalesce(1), f"{tmp_path}/arc")
    (part,) = glob.glob(f"{tmp_path}/arc/part-*.gz")
    data = open(part, "rb").read()
    whole = gzip.decompress(data)
    assert len(list(warc.read_arc(io.BytesIO(whole)))) == 20
    assert len(data) > 1.02 * len(zlib.compress(whole, 6))
