"""Office packages (S11): docx, pptx, xlsx/xlsm read with the binaryFile
source.

Only the byte decoding runs in Python (``mapInPandas``, stdlib ``zipfile``
and ``xml.etree``): each package becomes flat events, one per paragraph,
table cell, slide text or sheet cell, carrying its position. Everything
about order and structure is Spark:

* Word: body order, heading locations carried forward with
  ``last(..., ignorenulls)`` over the file's events (S8), horizontally
  merged cells kept once per row with ``row_number`` over the underlying
  cell id (S9), columns renumbered;
* PowerPoint: slides in deck order, shapes in tree order, notes last
  (S7);
* Excel: sparse cells (``sheet_cells``), a bounded 400 x 60 table block per
  sheet (S10), and sheet rules answered from the cells (R5).

Events of one file come from one task; assembling a file's blocks is one
grouping on the file key, bounded by the file's own size.
"""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.sources.corpus import BLOCK_TYPE, number_blocks
from quarry.sources.files import list_folder

OFFICE_EXTS = [".docx", ".pptx", ".xlsx", ".xlsm"]

EVENT_SCHEMA = (
    "project_id string, label string, ext string, problem string, part int, seq int, kind string, "
    "style string, text string, runs array<struct<text:string,bold:boolean,italic:boolean>>, "
    "row_no int, col_no int, cell_id string, sheet string")

# XML namespaces of the package parts read here.
NS = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "p": "http://schemas.openxmlformats.org/presentationml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
}


def _q(prefix: str, tag: str) -> str:
    return "{%s}%s" % (NS[prefix], tag)


def _event(**kw):
    base = dict(part=0, seq=0, kind=None, style=None, text=None, runs=None, row_no=None, col_no=None,
                cell_id=None, sheet=None)
    base.update(kw)
    return base


# -- Word ------------------------------------------------------------------------

def _docx_styles(z: zipfile.ZipFile) -> dict:
    try:
        root = ET.fromstring(z.read("word/styles.xml"))
    except KeyError:
        return {}
    out = {}
    for st in root.iter(_q("w", "style")):
        name = st.find(_q("w", "name"))
        out[st.get(_q("w", "styleId"))] = name.get(_q("w", "val")) if name is not None else ""
    return out


def _on(el) -> bool:
    if el is None:
        return False
    return el.get(_q("w", "val"), "true") not in ("0", "false", "off")


def _w_text(el) -> str:
    parts = []
    for node in el.iter():
        if node.tag == _q("w", "t"):
            parts.append(node.text or "")
        elif node.tag == _q("w", "tab"):
            parts.append("\t")
        elif node.tag in (_q("w", "br"), _q("w", "cr")):
            parts.append("\n")
    return "".join(parts)


def _docx(z: zipfile.ZipFile):
    styles = _docx_styles(z)
    body = ET.fromstring(z.read("word/document.xml")).find(_q("w", "body"))
    for seq, child in enumerate(list(body)):
        if child.tag == _q("w", "p"):
            ps = child.find(f"{_q('w', 'pPr')}/{_q('w', 'pStyle')}")
            style = styles.get(ps.get(_q("w", "val")), ps.get(_q("w", "val"))) if ps is not None else ""
            runs = []
            for r in child.iter(_q("w", "r")):
                t = _w_text(r)
                if t:
                    rpr = r.find(_q("w", "rPr"))
                    runs.append({"text": t,
                                 "bold": _on(rpr.find(_q("w", "b"))) if rpr is not None else False,
                                 "italic": _on(rpr.find(_q("w", "i"))) if rpr is not None else False})
            yield _event(seq=seq, kind="p", style=style, text=_w_text(child), runs=runs)
        elif child.tag == _q("w", "tbl"):
            above = {}  # grid column -> cell id of a vertical merge's first cell
            for ri, tr in enumerate(child.findall(_q("w", "tr"))):
                col = 0
                for ci, tc in enumerate(tr.findall(_q("w", "tc"))):
                    pr = tc.find(_q("w", "tcPr"))
                    span = 1
                    vmerge = None
                    if pr is not None:
                        gs = pr.find(_q("w", "gridSpan"))
                        span = int(gs.get(_q("w", "val"), "1")) if gs is not None else 1
                        vm = pr.find(_q("w", "vMerge"))
                        vmerge = None if vm is None else vm.get(_q("w", "val"), "continue")
                    cid = f"{seq}:{ri}:{ci}"
                    text = "\n".join(_w_text(p) for p in tc.findall(_q("w", "p")))
                    if vmerge == "continue" and col in above:
                        cid, text = above[col]
                    elif vmerge == "restart":
                        for k in range(span):
                            above[col + k] = (cid, text)
                    else:
                        for k in range(span):
                            above.pop(col + k, None)
                    # a merged cell covers several grid columns: one event per
                    # column, all with the same underlying cell id
                    for k in range(span):
                        yield _event(seq=seq, kind="cell", row_no=ri + 1, col_no=col + k + 1, cell_id=cid,
                                     text=text.strip())
                    col += span


# -- PowerPoint ------------------------------------------------------------------

def _rels(z: zipfile.ZipFile, part: str) -> dict:
    folder, name = part.rsplit("/", 1)
    try:
        root = ET.fromstring(z.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    out = {}
    for rel in root.findall(_q("rel", "Relationship")):
        target = rel.get("Target")
        path = target.lstrip("/") if target.startswith("/") else _join(folder, target)
        out[rel.get("Id")] = (rel.get("Type", "").rsplit("/", 1)[-1], path)
    return out


def _join(folder: str, target: str) -> str:
    parts = folder.split("/")
    for piece in target.split("/"):
        if piece == "..":
            parts.pop()
        elif piece and piece != ".":
            parts.append(piece)
    return "/".join(parts)


def _a_para_text(p) -> str:
    return "".join((t.text or "") for r in p if r.tag in (_q("a", "r"), _q("a", "fld"))
                   for t in r.findall(_q("a", "t")))


def _pptx(z: zipfile.ZipFile):
    pres = ET.fromstring(z.read("ppt/presentation.xml"))
    rels = _rels(z, "ppt/presentation.xml")
    ids = pres.find(_q("p", "sldIdLst"))
    slides = [rels[s.get(_q("r", "id"))][1] for s in (ids if ids is not None else [])]
    for n, part in enumerate(slides, start=1):
        root = ET.fromstring(z.read(part))
        seq = 0
        tree = root.find(f"{_q('p', 'cSld')}/{_q('p', 'spTree')}")
        for shape in (tree if tree is not None else []):
            tbl = shape.find(f".//{_q('a', 'tbl')}")
            if shape.tag == _q("p", "graphicFrame") and tbl is not None:
                for ri, tr in enumerate(tbl.findall(_q("a", "tr"))):
                    for ci, tc in enumerate(tr.findall(_q("a", "tc"))):
                        text = "\n".join(_a_para_text(p) for p in tc.iter(_q("a", "p")))
                        yield _event(part=n, seq=seq, kind="cell", row_no=ri + 1, col_no=ci + 1,
                                     cell_id=f"{seq}:{ri}:{ci}", text=text.strip())
                seq += 1
            elif shape.tag == _q("p", "sp"):
                body = shape.find(_q("p", "txBody"))
                for p in (body.findall(_q("a", "p")) if body is not None else []):
                    text = _a_para_text(p)
                    if text.strip():
                        yield _event(part=n, seq=seq, kind="p", text=text.strip())
                    seq += 1
        notes = [path for typ, path in _rels(z, part).values() if typ == "notesSlide"]
        if notes:
            nroot = ET.fromstring(z.read(notes[0]))
            texts = []
            for sp in nroot.iter(_q("p", "sp")):
                ph = sp.find(f".//{_q('p', 'ph')}")
                if ph is not None and ph.get("type") == "body":
                    body = sp.find(_q("p", "txBody"))
                    texts.append("\n".join(_a_para_text(p) for p in body.findall(_q("a", "p"))))
            text = "\n".join(texts)
            if text.strip():
                yield _event(part=n, seq=1 << 30, kind="notes", text=text.strip())


# -- Excel ------------------------------------------------------------------------

_REF = re.compile(r"^([A-Z]+)([0-9]+)$")


def _col_index(letters: str) -> int:
    k = 0
    for ch in letters:
        k = k * 26 + (ord(ch) - 64)
    return k


def _number_text(v: str) -> str:
    try:
        f = float(v)
    except ValueError:
        return v
    if f.is_integer() and re.fullmatch(r"-?[0-9]+", v.strip()):
        return str(int(v))
    return str(f)


def _xlsx(z: zipfile.ZipFile):
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = _rels(z, "xl/workbook.xml")
    try:
        sst = ET.fromstring(z.read("xl/sharedStrings.xml"))
        shared = ["".join(t.text or "" for t in si.iter(_q("s", "t"))) for si in sst.findall(_q("s", "si"))]
    except KeyError:
        shared = []
    sheets = wb.find(_q("s", "sheets"))
    for n, sh in enumerate(sheets if sheets is not None else []):
        name = sh.get("name")
        yield _event(part=n, kind="sheet", sheet=name)
        root = ET.fromstring(z.read(rels[sh.get(_q("r", "id"))][1]))
        for c in root.iter(_q("s", "c")):
            m = _REF.match(c.get("r", ""))
            if not m:
                continue
            t = c.get("t", "n")
            v = c.find(_q("s", "v"))
            if t == "inlineStr":
                value = "".join(x.text or "" for x in c.iter(_q("s", "t")))
            elif v is None or v.text is None:
                value = None
            elif t == "s":
                value = shared[int(v.text)]
            elif t == "b":
                value = "True" if v.text.strip() == "1" else "False"
            elif t in ("str", "e"):
                value = v.text
            else:
                value = _number_text(v.text)
            yield _event(part=n, kind="xcell", sheet=name, row_no=int(m.group(2)),
                         col_no=_col_index(m.group(1)), text=value)


DECODERS = {".docx": _docx, ".pptx": _pptx, ".xlsx": _xlsx, ".xlsm": _xlsx}


def _decode_batches(batches):
    cols = [f.split(" ")[0] for f in EVENT_SCHEMA.split(", ")]
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            head = dict(project_id=row.project_id, label=row.label, ext=row.ext, problem=row.problem)
            if row.problem is None and row.ext in DECODERS:
                try:
                    events = list(DECODERS[row.ext](zipfile.ZipFile(io.BytesIO(row.content))))
                except Exception as exc:  # a bad file is a record, never a failed job
                    head["problem"] = f"Could not read this file: {exc}"
                    events = []
            else:
                events = []
            out.append({**head, **_event(kind="file")})
            out.extend({**head, **e} for e in events)
        yield pd.DataFrame(out, columns=cols)


def office_events(files: DataFrame) -> DataFrame:
    """Decode office packages (``files`` from ``list_folder``) into events."""
    pk = files.filter(F.col("ext").isin(*OFFICE_EXTS) | F.col("problem").isNotNull()) \
        .select("project_id", "label", "ext", "problem", "content")
    return pk.mapInPandas(_decode_batches, EVENT_SCHEMA)


def _table_blocks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """S9 then rows: keep the first grid column of each underlying cell in a
    row, renumber columns, collect rows in order (one table per key)."""
    row_key = keys + ["row_no"]
    first = cells.withColumn("k", F.row_number().over(W.partitionBy(*row_key, "cell_id").orderBy("col_no"))) \
        .filter(F.col("k") == 1)
    renum = first.withColumn("c", F.row_number().over(W.partitionBy(*row_key).orderBy("col_no")))
    rows = renum.groupBy(*row_key).agg(F.array_sort(F.collect_list(F.struct("c", "text"))).alias("cs")) \
        .select(*row_key, F.transform("cs", lambda x: F.coalesce(x["text"], F.lit(""))).alias("cells"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("rs")) \
        .select(*keys, F.transform("rs", lambda x: x["cells"]).alias("rows"))


def office_files(events: DataFrame) -> DataFrame:
    """Word and PowerPoint files as rows with ordered blocks."""
    ev = events.filter(F.col("ext").isin(".docx", ".pptx"))
    files = ev.filter(F.col("kind") == "file").select("project_id", "label", "ext", "problem")
    paras = ev.filter(F.col("kind").isin("p", "notes"))
    is_heading = (F.col("ext") == ".docx") & F.lower(F.coalesce("style", F.lit(""))).contains("heading") \
        & (F.trim(F.col("text")) != "")
    docx_loc = F.when(is_heading, F.concat(F.lit("§"), F.trim(F.col("text"))))
    slide = F.concat(F.lit("Slide "), F.col("part").cast("string"))
    pb = paras.select("project_id", "label", "ext", "part", "seq", F.lit("paragraph").alias("kind"), "text",
                      F.lit(None).cast("array<array<string>>").alias("rows"),
                      F.when(F.col("ext") == ".pptx", F.when(F.col("kind") == "notes",
                                                             F.concat(slide, F.lit(" (notes)"))).otherwise(slide))
                      .otherwise(docx_loc).alias("loc"))
    tb = _table_blocks(ev.filter(F.col("kind") == "cell"), ["project_id", "label", "ext", "part", "seq"]) \
        .select("project_id", "label", "ext", "part", "seq", F.lit("table").alias("kind"),
                F.lit(None).cast("string").alias("text"), "rows",
                F.when(F.col("ext") == ".pptx", F.concat(F.lit("Slide "), F.col("part").cast("string")))
                .alias("loc"))
    blocks = pb.unionByName(tb)
    order = W.partitionBy("project_id", "label").orderBy("part", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = blocks.withColumn("location", F.coalesce(F.last("loc", ignorenulls=True).over(order), F.lit("body")))
    per_file = blocks.groupBy("project_id", "label").agg(F.array_sort(F.collect_list(F.struct(
        "part", "seq", F.struct(F.lit(0).alias("block_no"), "kind", "text", "rows", "location").alias("b"))))
        .alias("bs"))
    return files.join(per_file, ["project_id", "label"], "left").select(
        "project_id", "label", "ext", "problem",
        number_blocks(F.coalesce(F.transform("bs", lambda x: x["b"]), F.array())
                      .cast(f"array<{BLOCK_TYPE}>")).alias("blocks"))


def sheet_cells(events: DataFrame) -> DataFrame:
    """Sparse workbook cells: project_id, label, sheet, sheet_ord, row_no, col_no, value."""
    return events.filter(F.col("kind") == "xcell").select(
        "project_id", "label", "sheet", F.col("part").alias("sheet_ord"), "row_no", "col_no",
        F.col("text").alias("value"))


def sheet_list(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind") == "sheet").select("project_id", "label", "sheet",
                                                          F.col("part").alias("sheet_ord"))


def workbook_files(events: DataFrame) -> DataFrame:
    """S10 for decoded workbooks: one table block per sheet over rows
    1..max_row and columns 1..max_column, empty = "". A decoded file is one row, as a
    document is, so its sheets are as large as the file that was decoded."""
    ev = events.filter(F.col("ext").isin(".xlsx", ".xlsm"))
    files = ev.filter(F.col("kind") == "file").select("project_id", "label", "ext", "problem")
    cells = sheet_cells(ev)
    dims = cells.groupBy("project_id", "label", "sheet_ord").agg(F.max("row_no").alias("nr"), F.max("col_no").alias("nc"))
    grid = cells.groupBy("project_id", "label", "sheet_ord").agg(F.map_from_entries(F.collect_list(F.struct(
        F.struct("row_no", "col_no"), "value"))).alias("m"))
    sheets = sheet_list(ev).join(dims, ["project_id", "label", "sheet_ord"], "left").join(
        grid, ["project_id", "label", "sheet_ord"], "left")
    rows = F.transform(F.sequence(F.lit(1), F.coalesce("nr", F.lit(1))), lambda r: F.transform(
        F.sequence(F.lit(1), F.coalesce("nc", F.lit(1))),
        lambda c: F.coalesce(F.col("m")[F.struct(r.alias("row_no"), c.alias("col_no"))], F.lit(""))))
    per = sheets.groupBy("project_id", "label").agg(F.array_sort(F.collect_list(F.struct(
        "sheet_ord", F.struct(F.lit(0).alias("block_no"), F.lit("table").alias("kind"),
                              F.lit(None).cast("string").alias("text"), rows.alias("rows"),
                              F.col("sheet").alias("location")).alias("b")))).alias("bs"))
    return files.join(per, ["project_id", "label"], "left").select(
        "project_id", "label", "ext", "problem",
        number_blocks(F.coalesce(F.transform("bs", lambda x: x["b"]), F.array())
                      .cast(f"array<{BLOCK_TYPE}>")).alias("blocks"))


def read_office_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All files under ``path``: (file rows with blocks for the rule pass,
    decoded events for sheet rules). Unsupported and unreadable files are
    file rows with a problem and no blocks."""
    listed = list_folder(spark, path)
    events = office_events(listed)
    other = listed.filter(~F.col("ext").isin(*OFFICE_EXTS)).select(
        "project_id", "label", "ext", "problem", F.array().cast(f"array<{BLOCK_TYPE}>").alias("blocks"))
    files = office_files(events).unionByName(workbook_files(events)).unionByName(other)
    return files, events
