"""Rules over whole sheets against a plain search through all rows."""

import pytest
from conftest import make_files

from quarry.functions.text import column_letters_py, normalize_py
from quarry.operators.compile import compile_ruleset
from quarry.operators.sheet_rules import rectangle
from quarry.plans.run import Corpus, corpus_file_records, run_ruleset, sheet_values
from quarry.sources.sheets import Workbook

WIDE = 70
HEADS = {"goods": ["id", "name", "note"], "empty": ["key"], "wide": ["k", *[f"c{i}" for i in range(1, WIDE)]]}


def goods(i):
    names = {3: "ﬁne tea", 1500: "Rare “bird”", 1501: "Crate: 40 kg"}
    notes = {2: "", 7: None, 1499: "sold out", 1502: "last one*"}
    return i, names.get(i, f"item {i % 11}"), notes.get(i, f"n{i}")


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sheets"))
    # a key is missing, so its row is not there
    spark.createDataFrame([goods(i) for i in range(1600) if i != 1550], "id long, name string, note string").repartition(3) \
        .write.parquet(f"{d}/goods.parquet")
    spark.createDataFrame([], "key long").write.parquet(f"{d}/empty.parquet")
    spark.createDataFrame([(i, *[f"w{i}x{c}" for c in range(1, WIDE)]) for i in range(3)],
                          "k long, " + ", ".join(f"{c} string" for c in HEADS["wide"][1:])).write.parquet(f"{d}/wide.parquet")
    return Workbook(spark, d, [("goods", "id"), ("empty", "key"), ("wide", "k")], "store.xlsx", "shop")


def rows_of(name):
    """(row number, cells) of a sheet."""
    body = {"goods": [(i + 2, ["" if c is None else str(c) for c in goods(i)]) for i in range(1600) if i != 1550], "empty": [],
            "wide": [(i + 2, [str(i), *[f"w{i}x{c}" for c in range(1, WIDE)]]) for i in range(3)]}[name]
    return [(1, HEADS[name]), *body]


def phrase_hit(phrase):
    """Sheet and row of the first hit, alone or with the next row's start."""
    p = normalize_py(phrase)
    for name in HEADS:
        rows = [(n, normalize_py(" ".join(c) + " .")[:-1].strip()) for n, c in rows_of(name)]
        for (n, flat), (_, nxt) in zip(rows, [*rows[1:], (0, "")]):
            cut = [i for i, ch in enumerate(p) if ch == " "]
            if p in flat or (nxt and any(flat.endswith(p[:i]) and nxt.startswith(p[i + 1:]) for i in cut)):
                return name, n
    return None


def run(spark, book, *fields):
    files = spark.createDataFrame([], "project_id string, label string, ext string, problem string, blocks array<struct<block_no:int,"
                                      "kind:string,text:string,rows:array<array<string>>,location:string>>")
    corpus = Corpus(files, [book])
    recs = run_ruleset(spark, corpus, {"name": "t", "fields": list(fields)})
    values = {}
    for r in sheet_values(corpus, recs).collect():
        values.setdefault(r["rule_no"], {})[r["row_no"]] = (r["near"], r["cells"])
    return {r["rule_no"]: r.asDict(recursive=True) for r in recs.collect()}, values


def test_phrases_in_whole_sheets(spark, book):
    wanted = ["Rare \"bird\"", "fine tea", "1499 item 3 sold", "sold out 1500 rare", "OUT 1500", "w2x69", "last one", "item 4 n1499 no", "Key", "*"]
    recs, values = run(spark, book, *[{"name": p, "type": "table_contains", "params": {"contains": p}} for p in wanted])
    for i, p in enumerate(wanted):
        hit = phrase_hit(p)
        assert recs[i]["found"] == (hit is not None), p
        if hit is None:
            assert recs[i]["kind"] == "table" and i not in values
            continue
        name, row = hit
        ref = recs[i]["value_ref"]
        assert (ref["sheet"], ref["hit_row"]) == hit, p
        assert recs[i]["value_rows"] is None and recs[i]["citation"] == f"store.xlsx — {name}" and ref["head"] == HEADS[name]
        assert {n: c for n, (_, c) in values[i].items()} == dict(rows_of(name))
        assert [n for n, (near, _) in values[i].items() if near] == [row]
    assert phrase_hit("sold out 1500 rare") == ("goods", 1501) and phrase_hit("w2x69") == ("wide", 4)


def test_cells_of_whole_sheets(spark, book):
    recs, _ = run(spark, book,
                  {"name": "next cell", "type": "right_of", "params": {"label": "rare 'nothing'"}},
                  {"name": "note", "type": "right_of", "params": {"label": "rare \"bird\""}},
                  {"name": "own tail", "type": "right_of", "params": {"label": "last"}},
                  {"name": "nothing there", "type": "right_of", "params": {"label": "n1549"}},
                  {"name": "ligature", "type": "between", "params": {"start": "fi", "end": "tea"}},
                  {"name": "inside", "type": "between", "params": {"start": "crate:", "end": "kg"}},
                  {"name": "no end", "type": "between", "default": "none", "params": {"start": "crate:"}},
                  {"name": "around", "type": "around_keyword", "params": {"keyword": "crate"}},
                  {"name": "odd type", "type": "nope"},
                  {"name": "other file", "type": "right_of", "match": "letter", "params": {"label": "x"}})
    assert not recs[0]["found"] and recs[0]["citation"] == "store.xlsx"
    assert (recs[1]["value_text"], recs[1]["citation"]) == ("n1500", "store.xlsx — goods")
    assert (recs[2]["value_text"], recs[2]["found"]) == ("one*", True)
    assert (recs[3]["value_text"], recs[3]["found"]) == (None, False)
    assert recs[4]["value_text"] == "ne"
    assert recs[5]["value_text"] == "40"
    assert (recs[6]["value_text"], recs[6]["citation"]) == ("none", "store.xlsx — not found, default used")
    assert (recs[7]["kind"], recs[7]["value_ref"]["hit_row"]) == ("table", 1503)
    assert recs[8]["note"] == "Unknown rule type 'nope'." and not recs[8]["found"]
    assert recs[9]["citation"] == "(no uploaded file matched 'letter')" and recs[9]["file_label"] is None


def test_rectangles(spark, book):
    refs = ["B2", "C9", "b1600:A1598", "B:B", "2:3", "A1553:B1551", "C9:C9", "BR4:BS6", "A1:BR1", "A2000:A2001", "1:B", "A0", "A5000000:A900000000000000000"]
    sheets = ["goods"] * 7 + ["wide"] * 2 + ["goods"] * 4
    recs, values = run(spark, book, *[{"name": r, "type": "sheet_cell", "params": {"sheet": s, "cell": r}} for r, s in zip(refs, sheets)])
    assert recs[0]["value_text"] == "item 0" and recs[0]["value_ref"] is None
    assert not recs[1]["found"] and recs[1]["note"].startswith("Cell C9 on 'goods' is empty")  # a null
    table = dict(rows_of("goods"))
    assert {n: c for n, (_, c) in values[2].items()} == {n: table[n][:2] for n in range(1598, 1601)}
    assert recs[2]["citation"] == "store.xlsx — goods!b1600:A1598" and recs[2]["value_ref"]["head"] == table[1598][:2]
    # a whole column reaches to the last row; the missing key's row is a blank one
    assert {n: c for n, (_, c) in values[3].items()} == {n: [table[n][1]] if n in table else [""] for n in range(1, 1602)}
    assert {n: c for n, (_, c) in values[4].items()} == {n: table[n] for n in (2, 3)}
    assert values[5][1552][1] == ["", ""] and values[5][1551][1] == table[1551][:2]
    assert not recs[6]["found"] and recs[6]["kind"] == "table"
    wide = dict(rows_of("wide"))
    assert {n: c for n, (_, c) in values[7].items()} == {4: [wide[4][69], ""], 5: ["", ""], 6: ["", ""]}
    assert values[8][1][1] == HEADS["wide"]
    for i in (9, 10, 11, 12):
        assert not recs[i]["found"] and i not in values
    assert recs[9]["note"].startswith("Range A2000:A2001 on 'goods' is empty") and recs[10]["note"].startswith("Could not read range 1:B")


def test_ranges_with_their_rows(spark, book):
    boxes = {"B3:D5": (3, 2, 5, 4), "D1553:A1550": (1550, 1, 1553, 4), "A1599:B1604": (1599, 1, 1604, 2), "2:3": (2, 1, 3, 3),
             "E1:F2": None, "B2000:C2001": None, "A4096:A4097": None, "B:B": None, "C9": None}
    rules = [{"name": c, "type": "sheet_cell", "params": {"sheet": "goods", "cell": c}} for c in boxes]
    recs = corpus_file_records(spark, Corpus(make_files(spark, []), [book]), compile_ruleset({"name": "t", "fields": rules}), range_values=True)
    recs = {r["rule_no"]: r["rec"] for r in recs.collect()}
    held = dict(rows_of("goods"))
    for i, (name, box) in enumerate(boxes.items()):
        if box:
            r1, c1, r2, c2 = box
            assert recs[i]["value_rows"] == [[(held.get(r, []) + [""] * 9)[c - 1] for c in range(c1, c2 + 1)] for r in range(r1, r2 + 1)], name
            assert recs[i]["found"] and (recs[i]["value_ref"]["row_lo"], recs[i]["value_ref"]["row_hi"]) == (r1, r2)
        elif name == "B:B":  # it has no bound of the rule's own: the rows stay behind the reference
            assert recs[i]["found"] and recs[i]["value_rows"] is None and recs[i]["value_ref"]["row_hi"] == 1601
        else:
            assert not recs[i]["found"] and recs[i]["value_rows"] is None and "is empty" in recs[i]["note"], name


def test_ranges_of_the_query(spark, tmp_path):
    """rules_sheet_cell gives the texts of its range, as its SQL does; the sheet has blank cells and lacks a row."""
    import duckdb

    import __spark_entry__ as E
    d, con = str(tmp_path), duckdb.connect()
    tables = {
        "region": ([(0, "A"), (1, None)], "r_regionkey long, r_name string"),
        "nation": ([(0, "N", 1)], "n_nationkey long, n_name string, n_regionkey long"),
        "supplier": ([(0, "S", 0, 1.5)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double"),
        "customer": ([(k, None if k == 9 else f"c{k}", k + 1, k / 4, "M") for k in range(30) if k != 11],
                     "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string"),
        "part": ([(0, "P", "B", "T", 1, 2.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(10, 1, "F", None, None, "1")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                                                    "o_orderdate timestamp, o_orderpriority string"),
        "documents": ([], "doc_id long, text string, lang string, source string, n_chars long"),
        "conversations": ([], "conv_id long, turn int, role string, text string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{d}/{name}.parquet/*.parquet')")
    got = {r["rule_no"]: r.asDict() for r in E.queries()["rules_sheet_cell"](spark, d).collect()}
    assert got[4]["value"] == "c8 | 9 | 2.00\n | 10 | 2.25\nc10 | 11 | 2.50\n |  | \nc12 | 13 | 3.00"
    assert got[4]["value_ref"] == "customer!B10:D14" and "is empty" in got[0]["note"] and "is empty" in got[2]["note"]
    names = list(got[4])
    con.execute(E.oracle_sql()["rules_sheet_cell"])
    sql = [dict(zip([c[0] for c in con.description], r)) for r in con.fetchall()]
    assert sorted(repr([r[c] for c in names]) for r in sql) == sorted(repr([r[c] for c in names]) for r in got.values())


def test_many_cells(spark, book):
    """A range of over 100,000 cells, most of them blank, is rows, not one value."""
    recs, values = run(spark, book, {"name": "r", "type": "sheet_cell", "params": {"sheet": "goods", "cell": "A1:C40000"}})
    assert recs[0]["found"] and len(values[0]) == 40000 and values[0][40000][1] == ["", "", ""]


def test_open_ends():
    rules = compile_ruleset({"fields": [{"type": "sheet_cell", "params": {"cell": c}} for c in ("C:A", "$4:2", "B9:A2", "D5")]})
    assert [rectangle(r.sheet_ref, 50, 9) for r in rules] == [(1, 1, 50, 3), (2, 1, 4, 9), (2, 1, 9, 2), (5, 4, 5, 4)]


def test_column_letters(spark):
    from pyspark.sql import functions as F

    from quarry.functions.text import column_letters
    ns = [1, 26, 27, 52, 702, 703, 18278, 18279, 475254, 475255, 8031810176]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select(column_letters(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in got] == [column_letters_py(n) for n in ns]


def test_anchors_by_automaton(spark):
    from conftest import P, T, make_files
    from quarry.operators.anchors import phrases, scan

    files = make_files(spark, [("a", [P("The cat", "l1"), P("a CAT’s hat  cat", "l2"), T([["x", "ﬁsh"], ["*", "y"]], "l3")]),
                               ("b", [P("nothing", "l1")]), ("c", [])])
    anchors = ["cat", "cat's", "x fish", "at", None, "", "*", "CAT", "fish * y", "zzz"]
    got = {(r["label"], r["anchor_no"]): (r["first_location"], r["n_blocks"]) for r in scan(files, anchors).collect()}
    assert got == {("a", 0): ("l1", 2), ("a", 7): ("l1", 2), ("a", 1): ("l2", 1), ("a", 2): ("l3", 1), ("a", 3): ("l1", 2),
                   ("a", 6): ("l1", 3), ("b", 6): ("l1", 1), ("a", 8): ("l3", 1)}
    assert scan(files, []).collect() == [] == scan(files, [None, ""]).collect()
    t = spark.createDataFrame([(2, "a b c d"), (1, "b c d"), (3, None), (4, "x")], "k int, t string")
    assert phrases(t, "k", "t", 9) == ["b c d", "a b c", "x"] and phrases(t, "k", "t", 1) == ["b c d"]
