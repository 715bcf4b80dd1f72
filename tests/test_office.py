"""Office packages decoded in mapInPandas, structured by Spark."""

import os
import tempfile

import pytest

from office_fixtures import write_folder
from quarry.sources.office import read_office_folder, sheet_cells


@pytest.fixture(scope="module")
def office(spark):
    root = write_folder(tempfile.mkdtemp(prefix="quarry-office-"))
    files, events = read_office_folder(spark, root)
    return root, files, events


def blocks_of(files, label):
    row = files.filter(files.label == label).first()
    return row, [b.asDict(recursive=True) for b in (row["blocks"] or [])]


def test_listing_and_problems(office):
    _, files, _ = office
    labels = {r["label"]: r["problem"] for r in files.collect()}
    assert "~$lock.docx" not in labels
    assert labels["old.doc"].startswith("Legacy '.doc' files cannot be read")
    assert labels["broken.docx"].startswith("Could not read this file")
    assert labels["day book.docx"] is None


def test_docx_headings_and_merges(office):
    _, files, _ = office
    row, blocks = blocks_of(files, "day book.docx")
    assert [b["location"] for b in blocks] == ["body", "§Goods in", "§Goods in",
                                               "§Goods in", "§Goods in", "§Goods out", "§Goods out"]
    table = blocks[3]
    assert table["kind"] == "table"
    # the two-column label cell appears once; the vertical merge repeats its first cell
    assert table["rows"] == [["Haulier and depot", "Rhine Cargo"], ["Total", "", "42"], ["Total", "x", "43"]]
    assert blocks[4]["text"] == ""  # blank paragraphs are kept


def test_pptx_slides_and_notes(office):
    _, files, _ = office
    _, blocks = blocks_of(files, "tour.pptx")
    assert [(b["kind"], b["location"]) for b in blocks] == [
        ("paragraph", "Slide 1"), ("paragraph", "Slide 1"), ("table", "Slide 1"),
        ("paragraph", "Slide 2"), ("paragraph", "Slide 2 (notes)")]
    assert blocks[2]["rows"] == [["Key", "Value 1"]]
    assert blocks[4]["text"] == "Speaker detail"


def test_xlsx_cells_and_blocks(office):
    _, files, events = office
    _, blocks = blocks_of(files, "stock.xlsx")
    assert [b["location"] for b in blocks] == ["Data", "Stock"]
    assert blocks[0]["rows"] == [["Name", "Amount", ""], ["", "", ""], ["Total", "12.5", ""]]
    assert len(blocks[1]["rows"]) == 6 and blocks[1]["rows"][5][5] == "7"
    cells = {(r["sheet"], r["row_no"], r["col_no"]): r["value"] for r in sheet_cells(events).collect()}
    assert cells[("Data", 3, 3)] is None and cells[("Stock", 6, 6)] == "7"


DEPOT_RULES = {"name": "depot", "fields": [
    {"name": "Foreman", "type": "between", "match": "log", "params": {"start": "Foreman:", "end": "Bay"}},
    {"name": "Arrivals", "type": "range", "match": "log", "params": {"start": "Goods in", "end": "Goods out"}},
    {"name": "Pallets", "type": "right_of", "match": "log", "params": {"label": "Pallets"}},
    {"name": "Remarks", "type": "right_of", "match": "log", "params": {"label": "Remarks"}},
    {"name": "Forklift", "type": "around_keyword", "match": "note", "params": {"keyword": "forklift", "after": 1}},
    {"name": "Keys", "type": "table_contains", "match": "note", "params": {"contains": "porter"}},
    {"name": "Visitors", "type": "between", "match": "note", "default": "nobody", "params": {"start": "Visitors:", "end": "left"}},
    {"name": "In stock", "type": "sheet_cell", "match": "stock", "params": {"sheet": " stock ", "cell": "F6"}},
]}


def test_rules_over_office_files(spark):
    from office_fixtures import write_depot_folder
    from quarry.plans.run import Corpus, run_ruleset
    from quarry.sources.office import sheet_cells, sheet_list

    files, events = read_office_folder(spark, write_depot_folder(tempfile.mkdtemp(prefix="quarry-depot-")))
    corpus = Corpus(files, [], (sheet_list(events), sheet_cells(events)))
    recs = {r["name"]: r.asDict(recursive=True) for r in run_ruleset(spark, corpus, DEPOT_RULES).collect()}
    assert (recs["Foreman"]["value_text"], recs["Foreman"]["citation"]) == ("R. Okafor", "Log 12.docx — body")
    assert recs["Arrivals"]["kind"] == "block" and recs["Arrivals"]["rule_type"] == "between"
    assert [b["kind"] for b in recs["Arrivals"]["value_blocks"]] == ["paragraph", "table"]
    assert recs["Arrivals"]["citation"] == "Log 12.docx — §Goods in"
    assert (recs["Pallets"]["value_text"], recs["Remarks"]["value_text"]) == ("31", "one pallet wet")
    assert [b["text"] for b in recs["Forklift"]["value_blocks"]] == ["Forklift 2 needs oil", "Gate code unchanged"]
    assert recs["Keys"]["value_rows"] == [["Keys", "with the porter"]]
    assert recs["Keys"]["citation"] == "Note 12.docx — §Hand-over"
    assert (recs["Visitors"]["value_text"], recs["Visitors"]["citation"]) == ("nobody", "Note 12.docx — not found, default used")
    assert (recs["In stock"]["value_text"], recs["In stock"]["citation"]) == ("7", "stock 12.xlsx —  stock !F6")


def test_sheet_rule_notes_on_decoded_workbook(spark, office):
    from quarry.plans.run import Corpus, run_ruleset
    from quarry.sources.office import sheet_cells, sheet_list

    _, files, events = office
    corpus = Corpus(files, [], (sheet_list(events), sheet_cells(events)))
    rs = {"name": "s", "fields": [
        {"name": "no tab", "type": "sheet_cell", "match": "stock", "params": {"sheet": "Summary", "cell": "A1"}},
        {"name": "empty", "type": "sheet_cell", "match": "stock", "params": {"sheet": " data ", "cell": "C3"}},
        {"name": "range", "type": "sheet_cell", "match": "stock", "params": {"sheet": "Data", "cell": "A1:B3"}},
        {"name": "blank range", "type": "sheet_cell", "match": "stock", "params": {"sheet": "Data", "cell": "D1:E2"}},
    ]}
    recs = {r["name"]: r.asDict(recursive=True) for r in run_ruleset(spark, corpus, rs).collect()}
    assert recs["no tab"]["note"] == "No tab named 'Summary'. Tabs found: Data, Stock."
    assert recs["empty"]["note"].startswith("Cell C3 on ' data ' is empty")
    assert recs["range"]["value_rows"] == [["Name", "Amount"], ["", ""], ["Total", "12.5"]]
    assert recs["range"]["citation"] == "stock.xlsx — Data!A1:B3"
    assert not recs["blank range"]["found"] and recs["blank range"]["note"].startswith("Range D1:E2 on 'Data' is empty")


def test_one_label_in_two_projects(spark):
    import shutil

    from office_fixtures import write_docx

    root = tempfile.mkdtemp(prefix="quarry-two-")
    for project in ("p1", "p2"):
        os.makedirs(os.path.join(root, project))
        write_docx(os.path.join(root, project, "app.docx"))
    one = tempfile.mkdtemp(prefix="quarry-one-")
    os.makedirs(os.path.join(one, "p1"))
    shutil.copy(os.path.join(root, "p1", "app.docx"), os.path.join(one, "p1", "app.docx"))
    alone = read_office_folder(spark, one)[0].collect()
    both = read_office_folder(spark, root)[0].collect()
    assert len(alone) == 1 and len(both) == 2
    assert all(r["blocks"] == alone[0]["blocks"] for r in both)
