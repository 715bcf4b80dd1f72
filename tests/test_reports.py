"""Sinks and small operators: file choice (S3), manifest JSON (P11), JSON and
Markdown reports written per project (T2, T3)."""

import glob
import json
import os
import tempfile

from conftest import P, T, make_files
from quarry.plans import report as REP
from quarry.plans.run import Corpus, run_ruleset
from quarry.sources.files import choose, list_folder


def _records(spark):
    files = make_files(spark, [("a.docx", [P("Title: Moon end"), T([["Cost", "12"]])], None, "p1"),
                               ("b.docx", [P("nothing")], None, "p2")])
    rs = {"name": "r", "fields": [
        {"name": "Title", "type": "between", "params": {"start": "Title:", "end": "end"}},
        {"name": "Cost", "type": "right_of", "params": {"label": "cost"}},
        {"name": "Missing", "type": "table_contains", "default": "N/A", "params": {"contains": "zzz"}},
    ]}
    return run_ruleset(spark, Corpus(files, []), rs), rs


def test_choose_files(spark):
    d = tempfile.mkdtemp(prefix="quarry-choose-")
    for name in ("x.docx", "y.docx", "~$x.docx"):
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(name.encode())
    listed = list_folder(spark, d)
    assert sorted(r["label"] for r in listed.collect()) == ["x.docx", "y.docx"]
    assert [r["label"] for r in choose(listed, ["y.docx", "unknown"]).collect()] == ["y.docx"]
    assert choose(listed, []).count() == 2
    row = listed.filter("label = 'x.docx'").first()
    import hashlib
    assert row["sha256"] == hashlib.sha256(b"x.docx").hexdigest() and row["size"] == 6


def test_newest_version_is_chosen_without_content(spark, monkeypatch):
    import quarry.sources.files as FS
    d = tempfile.mkdtemp(prefix="quarry-versions-")
    for k, (folder, name, stamp) in enumerate([("p/a", "x.txt", 100), ("p/b", "x.txt", 300), ("p/c", "x.txt", 200), ("q", "x.txt", 50),
                                               ("p/a", "y.txt", 70), ("p/b", "y.txt", 70)]):
        os.makedirs(os.path.join(d, folder), exist_ok=True)
        path = os.path.join(d, folder, name)
        with open(path, "w") as fh:
            fh.write(f"version {k}")
        os.utime(path, (stamp, stamp))
    for bound in (200_000, 1):
        monkeypatch.setattr(FS, "BROADCAST_PATHS", bound)
        listed = list_folder(spark, d)
        rows = {(r["project_id"], r["label"]): bytes(r["content"]).decode() for r in listed.collect()}
        assert rows == {("p", "x.txt"): "version 1", ("q", "x.txt"): "version 3", ("p", "y.txt"): "version 5"}
        plan = listed._jdf.queryExecution().executedPlan().toString()
        assert bound == 1 or "hashpartitioning(path" not in plan


def test_manifest_and_reports(spark):
    recs, rs = _records(spark)
    man = {r["project_id"]: json.loads(r["manifest"]) for r in REP.manifest_json(recs, rs, None, "2026-01-01").collect()}
    assert [f["name"] for f in man["p1"]["fields"]] == ["Title", "Cost", "Missing"]
    assert man["p1"]["template"] is None and man["p1"]["enrichment"] == "none"
    counts = spark.createDataFrame([("p1", 1), ("p2", 1)], "project_id string, n_files long")
    reports = {r["project_id"]: json.loads(r["json"]) for r in REP.report_json(recs, None, "now", counts).collect()}
    p1 = reports["p1"]
    assert p1["title"] == "Extraction Summary" and p1["source_files"] == 1
    assert [f["value"] for f in p1["fields"]] == ["Moon", "12", "N/A"]
    assert reports["p2"]["needs_checking"] == ["Title", "Cost"]
    md = REP.report_markdown(recs, None, "now", counts)
    out = tempfile.mkdtemp(prefix="quarry-md-")
    REP.write_reports(md, "markdown", os.path.join(out, "md"))
    parts = glob.glob(os.path.join(out, "md", "project_id=p2", "*.txt"))
    text = "".join(open(x, encoding="utf-8").read() for x in parts)
    assert text.startswith("# Extraction Summary") and "> **Things to check**" in text
    assert "**Nothing found; the rule's default value was used.**" not in text
    assert "`Source: b.docx — not found, default used`" in text


def test_report_lines_of_a_project_with_many_files(spark):
    """A project of 5,000 files: all names and warnings are there, in order, over several files of the sink."""
    recs, _ = _records(spark)
    files = spark.range(5000).selectExpr("'p1' as project_id", "concat('f', lpad(id, 5, '0'), '.txt') as label").unionByName(
        spark.createDataFrame([("p2", "b.docx"), ("p2", None), ("p3", "no record.txt")], "project_id string, label string"))
    warnings = files.filter("label like '%7.txt'").selectExpr("*", "concat(label, ': damaged') as warning")
    lines = REP.report_lines(recs, {"title": "All", "sections": [{"type": "heading", "text": "H"}, {"type": "field", "field": "Cost"}]},
                             "now", files, warnings)
    out = os.path.join(tempfile.mkdtemp(prefix="quarry-lines-"), "lines")
    REP.write_report_lines(lines, out)
    parts = sorted(glob.glob(os.path.join(out, "project_id=p1", "*.txt")))
    text = "".join(open(x, encoding="utf-8").read() for x in parts).split("\n")
    assert text[:4] == ["# All", "", "*Generated now*", ""]
    assert text[4:5004] == [f"- f{k:05d}.txt" for k in range(5000)]
    assert text[5004:5504] == [f"- Warning: f{k:05d}.txt: damaged" for k in range(7, 5000, 10)]
    body = text[text.index("## H"):]
    assert body[1] == "### Cost" and body[2] == "12" and body[3].startswith("`Source: ")
    assert [x for x in body if x.startswith("### ")] == ["### Cost", "### Title", "### Missing"]
    assert not os.path.exists(os.path.join(out, "project_id=p3"))
    empty = REP.report_lines(recs.limit(0), None, "now", files, warnings)
    assert empty.collect() == []
