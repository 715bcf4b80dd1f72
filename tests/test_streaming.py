"""Incremental extraction over file drops."""

import os
import tempfile

from quarry.streaming.incremental import IncrementalExtractor

RULES = {"name": "s", "fields": [
    {"name": "token", "type": "between", "params": {"start": "token = \"", "end": "\""}},
    {"name": "title", "type": "around_keywords", "match": "b.txt", "params": {"keyword": "title"}},
]}


def drop(landing, project, arrival, label, text):
    d = os.path.join(landing, project, arrival)
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, label), "w", encoding="utf-8") as fh:
        fh.write(text)


def records(x):
    return {(r["project_id"], r["rule_no"]): (r["found"], r["file_label"], r["value_text"])
            for r in x.records().collect()}


def test_incremental_updates(spark):
    root = tempfile.mkdtemp(prefix="quarry-x1-")
    landing, state, ckpt = (os.path.join(root, n) for n in ("landing", "state", "ckpt"))
    os.makedirs(landing)
    x = IncrementalExtractor(spark, RULES, landing, state)
    drop(landing, "p1", "a1", "b.txt", "intro\ntoken = \"B\" here\nTitle line")
    x.start(ckpt).awaitTermination()
    r = records(x)
    assert r[("p1", 0)] == (True, "b.txt", "B") and r[("p1", 1)][0]
    # an earlier label arriving later wins P2
    drop(landing, "p1", "a2", "a.txt", "token = \"A\"")
    # the same content again under a new path is ignored
    drop(landing, "p1", "a3", "b.txt", "intro\ntoken = \"B\" here\nTitle line")
    x.start(ckpt).awaitTermination()
    r = records(x)
    assert r[("p1", 0)] == (True, "a.txt", "A")
    # changed content replaces the old version
    drop(landing, "p1", "a4", "a.txt", "no token any more")
    x.start(ckpt).awaitTermination()
    assert records(x)[("p1", 0)] == (True, "b.txt", "B")
    # refreshing again (a replay) changes nothing
    before = records(x)
    x.refresh(["p1"])
    assert records(x) == before


def test_incremental_office_drops(spark):
    import shutil
    from office_fixtures import write_xlsx, write_docx

    root = tempfile.mkdtemp(prefix="quarry-x1o-")
    landing, state, ckpt = (os.path.join(root, n) for n in ("landing", "state", "ckpt"))
    os.makedirs(os.path.join(landing, "p2", "a1"))
    write_xlsx(os.path.join(landing, "p2", "a1", "stock.xlsx"))
    write_docx(os.path.join(landing, "p2", "a1", "day book.docx"))
    rules = {"name": "o", "fields": [
        {"name": "pallets", "type": "sheet_cell", "match": "stock", "params": {"sheet": "Stock", "cell": "F6"}},
        {"name": "in", "type": "range", "match": "day book",
         "params": {"start": "Goods in", "end": "Goods out"}},
    ]}
    x = IncrementalExtractor(spark, rules, landing, state)
    x.start(ckpt).awaitTermination()
    recs = {r["rule_no"]: r for r in x.records().collect()}
    assert recs[0]["value_text"] == "7" and recs[0]["citation"] == "stock.xlsx — Stock!F6"
    assert recs[1]["found"] and recs[1]["kind"] == "block"


def test_replay_after_a_break_between_append_and_refresh(spark):
    root = tempfile.mkdtemp(prefix="quarry-x1b-")
    landing, state, ckpt = (os.path.join(root, n) for n in ("landing", "state", "ckpt"))
    os.makedirs(landing)
    drop(landing, "p1", "a1", "b.txt", "token = \"B\"")

    class Breaks(IncrementalExtractor):
        def refresh(self, projects):
            raise RuntimeError("lost here")

    try:
        Breaks(spark, RULES, landing, state).start(ckpt).awaitTermination()
    except Exception as e:
        assert "lost here" in str(e)
    x = IncrementalExtractor(spark, RULES, landing, state)
    x.start(ckpt).awaitTermination()
    assert records(x)[("p1", 0)] == (True, "b.txt", "B")


def test_bad_utf8_and_arrival_order(spark):
    root = tempfile.mkdtemp(prefix="quarry-x1u-")
    landing, state, ckpt = (os.path.join(root, n) for n in ("landing", "state", "ckpt"))
    os.makedirs(os.path.join(landing, "p1", "9"))
    with open(os.path.join(landing, "p1", "9", "a.txt"), "wb") as fh:
        fh.write(b"token = \"\xff\xfe\"")
    drop(landing, "p1", "9", "b.txt", "token = \"old\"")
    drop(landing, "p1", "10", "b.txt", "token = \"new\"")
    for folder, at in (("9", 1_700_000_000), ("10", 1_700_000_100)):
        os.utime(os.path.join(landing, "p1", folder, "b.txt"), (at, at))
    x = IncrementalExtractor(spark, RULES, landing, state)
    x.start(ckpt).awaitTermination()
    assert records(x)[("p1", 0)] == (True, "b.txt", "new")
