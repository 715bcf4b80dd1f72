"""Reading, listing, loading and migrating rule sets."""

import json
import os
import shutil
import tempfile

from quarry.operators.compile import compile_ruleset
from quarry.sources import rulesets as RS

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_listing_load_and_migration(spark):
    d = tempfile.mkdtemp(prefix="quarry-rs-")
    shutil.copy(os.path.join(HERE, "rulesets", "shop_desk.json"), os.path.join(d, "Shop desk 1.json"))
    with open(os.path.join(d, "small.json"), "w") as fh:
        json.dump({"fields": [{"name": "kw", "type": "around_keyword", "params": {"keyword": "x", "before": 2}}]}, fh)
    with open(os.path.join(d, "broken.json"), "w") as fh:
        fh.write("{not json")
    df = RS.read_rulesets(spark, d)
    listing = [r.asDict() for r in RS.list_rulesets(df).collect()]
    assert listing == [{"id": "Shop desk 1", "name": "Shop desk", "fields": 6},
                       {"id": "small", "name": "small", "fields": 1}]
    table = {(r["id"], r["rule_no"]): (r["raw_type"], r["type"]) for r in RS.rules_table(df).collect()}
    assert table[("Shop desk 1", 5)] == ("around_keyword", "around_keywords")
    assert table[("small", 0)] == ("around_keyword", "around_keywords")
    small = RS.load(df, "small")
    rule = compile_ruleset(small)[0]
    assert rule.type == "around_keywords" and rule.before == 2 and rule.error is None
    desk = RS.load(df, "Shop desk 1")
    with open(os.path.join(HERE, "rulesets", "shop_desk.json"), encoding="utf-8") as fh:
        assert desk["fields"] == json.load(fh)["fields"]


def test_templates(spark):
    d = tempfile.mkdtemp(prefix="quarry-tpl-")
    shutil.copy(os.path.join(HERE, "rulesets", "shop_desk.template.json"), os.path.join(d, "std.json"))
    df = RS.read_templates(spark, d)
    assert [r.asDict() for r in RS.list_templates(df).collect()] == [
        {"id": "std", "name": "Desk sheet", "sections": 5}]
    assert RS.load(df, "std")["title"] == "Shop desk, day by day"


def test_export_round_trip(spark):
    d, out = tempfile.mkdtemp(prefix="quarry-rs-"), tempfile.mkdtemp(prefix="quarry-out-")
    for name, keyword in (("007", "x"), ("second set", "y")):
        with open(os.path.join(d, f"{name}.json"), "w") as fh:
            json.dump({"name": name, "fields": [{"name": "kw", "type": "around_keywords", "params": {"keyword": keyword}}]}, fh)
    df = RS.read_rulesets(spark, d)
    RS.export(df, out + "/sets")
    back = RS.read_exported(spark, out + "/sets")
    for item in ("007", "second set"):
        assert RS.load(back, item) == RS.load(df, item) is not None
