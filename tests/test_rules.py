"""Edge cases of the rule families and run assembly, on inline block lists."""

from conftest import P, T, make_files, run_rules


def one(spark, blocks, rule, label="a.docx"):
    files = make_files(spark, [(label, blocks)])
    return run_rules(spark, files, [rule])[0]


def test_between_inline_cites_first_start_block(spark):
    blocks = [P("Project Title: see below", "§A"), T([["Project Title: Moon Base Proposal Number: 7"]], "§B")]
    r = one(spark, blocks, {"name": "t", "type": "between", "params": {"start": "Project Title:", "end": "Proposal Number:"}})
    assert r["found"] and r["kind"] == "text" and r["value_text"] == "Moon Base"
    assert r["citation"] == "a.docx — §A"


def test_between_span_keeps_tables_and_blank_paragraphs(spark):
    blocks = [P("intro"), P("B.4 Team"), P(""), T([["n", "role"], ["x", "lead"]]), P("Ann"),
              P("B.5 Budget"), P("after")]
    r = one(spark, blocks, {"name": "t", "type": "range", "params": {"start": "B.4 Team", "end": "B.5 Budget"}})
    assert r["kind"] == "block" and r["rule_type"] == "between"
    assert [b["block_no"] for b in r["value_blocks"]] == [3, 4, 5]


def test_between_span_without_end_runs_to_end(spark):
    blocks = [P("start here"), P("one"), P("two")]
    r = one(spark, blocks, {"name": "t", "type": "between", "params": {"start": "start here"}})
    assert [b["text"] for b in r["value_blocks"]] == ["one", "two"]


def test_between_empty_span_is_a_miss_and_full_text_last(spark):
    blocks = [P("x"), T([["Total cost", "ignored"], ["12", "end mark"]])]
    r = one(spark, blocks, {"name": "t", "type": "between", "params": {"start": "Total cost", "end": "end mark"}})
    assert r["found"] and r["kind"] == "text" and r["value_text"] == "ignored\n12"
    blocks = [P("start"), P("stop")]
    r = one(spark, blocks, {"name": "t", "type": "between", "params": {"start": "start", "end": "stop"}})
    assert not r["found"] and r["citation"] == "a.docx"


def test_right_of_variants(spark):
    blocks = [P("Name: not a table"), T([["Name", "", "  Ann  "], ["Age: 42"], ["Last", "x"], ["Empty", ""]])]
    rule = lambda lbl: {"name": "t", "type": "right_of", "params": {"label": lbl}}
    assert one(spark, blocks, rule("name"))["value_text"] == "Ann"
    assert one(spark, blocks, rule("Age"))["value_text"] == "42"
    r = one(spark, blocks, rule("Empty"))
    assert not r["found"] and r["citation"] == "a.docx"


def test_right_of_stops_at_first_matching_cell(spark):
    blocks = [T([["Key"], ["Key", "value"]])]
    r = one(spark, blocks, {"name": "t", "type": "right_of", "params": {"label": "key"}})
    assert not r["found"]


def test_around_table_wins_and_clipping(spark):
    blocks = [P("a"), P(""), P("b kw"), P("c"), T([["kw", "1"]], "§T")]
    r = one(spark, blocks, {"name": "t", "type": "around_keywords", "params": {"keyword": "KW", "before": 5}})
    assert r["kind"] == "table" and r["value_rows"] == [["kw", "1"]] and r["citation"] == "a.docx — §T"
    blocks = [P("a"), P(""), P("b kw", "§2"), P("c"), P("d")]
    r = one(spark, blocks, {"name": "t", "type": "around_keywords", "params": {"keyword": "kw", "before": "5", "after": 1}})
    assert [b["text"] for b in r["value_blocks"]] == ["a", "b kw", "c"] and r["citation"] == "a.docx — §2"


def test_around_bad_and_negative_counts(spark):
    blocks = [P("a"), P("kw"), P("c")]
    r = one(spark, blocks, {"name": "t", "type": "around_keywords", "default": "D",
                            "params": {"keyword": "kw", "before": "abc"}})
    assert not r["found"] and r["note"].startswith("This rule could not run: invalid literal for int()")
    r = one(spark, blocks, {"name": "t", "type": "around_keywords", "params": {"keyword": "kw", "before": -1, "after": 1}})
    assert [b["text"] for b in r["value_blocks"]] == ["c"]
    r = one(spark, blocks, {"name": "t", "type": "around_keywords", "params": {"keyword": "kw", "before": -2}})
    assert not r["found"]


def test_table_contains_and_empty_needle(spark):
    blocks = [T([["a", "b"]]), T([["Total", "9"]], "§2")]
    r = one(spark, blocks, {"name": "t", "type": "table_contains", "params": {"contains": "total 9"}})
    assert r["value_rows"] == [["Total", "9"]]
    r = one(spark, blocks, {"name": "t", "type": "table_contains", "params": {"contains": ""}})
    assert not r["found"] and r["kind"] == "table"


def test_whitespace_needle_matches_everything(spark):
    r = one(spark, [P("anything")], {"name": "t", "type": "around_keywords", "params": {"keyword": "  "}})
    assert r["found"] and [b["text"] for b in r["value_blocks"]] == ["anything"]


def test_default_in_first_file_beats_hit_in_second(spark):
    files = make_files(spark, [("a_app.docx", [P("nothing")]), ("b_app.docx", [P("Title: X end")])])
    recs = run_rules(spark, files, [{"name": "t", "type": "between", "match": "APP ", "default": "N/A",
                                     "params": {"start": "Title:", "end": "end"}}])
    r = recs[0]
    assert r["found"] and r["value_text"] == "N/A" and r["citation"] == "a_app.docx — not found, default used"
    assert r["note"] == "Nothing found; the rule's default value was used."


def test_first_hit_in_label_order(spark):
    files = make_files(spark, [("b.docx", [P("kw two")]), ("a.docx", [P("no")]), ("c.docx", [P("kw three")])])
    r = run_rules(spark, files, [{"name": "t", "type": "around_keywords", "params": {"keyword": "kw"}}])[0]
    assert r["file_label"] == "b.docx"


def test_no_candidate_and_unreadable_and_unknown(spark):
    files = make_files(spark, [("a.doc", [], "Legacy"), ("b.doc", [], "Legacy")])
    recs = run_rules(spark, files, [
        {"type": "between", "match": "zzz", "params": {"start": "x"}},
        {"type": "between", "match": ".doc", "params": {"start": "x"}},
        {"name": "u", "type": "regex", "default": "D"},
    ])
    assert recs[0]["citation"] == "(no uploaded file matched 'zzz')" and recs[0]["name"] == "Untitled"
    assert recs[0]["note"] == "No uploaded file name contains 'zzz'." and recs[0]["rule_type"] == "between"
    assert recs[1]["citation"] == "a.doc" and recs[1]["note"] == "The matching file could not be read."
    assert recs[2]["note"] == "The matching file could not be read."
    files = make_files(spark, [("a.docx", [P("x")])])
    r = run_rules(spark, files, [{"name": "u", "type": "regex", "default": "D"}])[0]
    assert not r["found"] and r["note"] == "Unknown rule type 'regex'." and r["citation"] == "a.docx"


def test_sheet_rule_on_document(spark):
    r = one(spark, [P("x")], {"name": "s", "type": "sheet_cell", "params": {"sheet": "S", "cell": "A1"}})
    assert not r["found"] and r["note"] == "This rule only applies to spreadsheet files."


def test_adding_a_rule_never_changes_others(spark):
    files = make_files(spark, [("a.docx", [P("kw x"), T([["kw", "1"]])])])
    base = [{"name": "a", "type": "around_keywords", "params": {"keyword": "kw"}}]
    more = base + [{"name": "b", "type": "between", "params": {"start": "kw", "end": "x"}}]
    assert run_rules(spark, files, base)[0] == run_rules(spark, files, more)[0]


def test_nfkc_path_for_flagged_files(spark):
    # a ligature and a fullwidth letter only match after NFKC; the value keeps
    # the original characters
    blocks = [P("ﬁnance report"), T([["Ｔotal", "9"]])]
    r = one(spark, blocks, {"name": "t", "type": "around_keywords", "params": {"keyword": "finance"}})
    assert r["found"] and r["value_blocks"][0]["text"] == "ﬁnance report"
    r = one(spark, blocks, {"name": "t", "type": "right_of", "params": {"label": "total"}})
    assert r["value_text"] == "9"
