"""The rules over whole sheets (R0-R5 on workbooks), in long form.

A sheet of a relational workbook has no bound, so it is never one row, one
group or one value. Its rows stay rows; a rule first finds *where* it hits and
only then reads what it needs there:

1. one pass over all sheets gives, for each sheet and rule, the first row that
   holds the rule's anchors: a partial aggregate of row numbers, so a task
   sends one row of numbers for each sheet, whatever the sheet's size;
2. the few rows that hold a first hit are read again through a pushed-down key
   filter, and the value is cut out of them;
3. a table is not copied into the record. The record carries a reference
   (sheet, rows, columns, the row that was hit, the first row's texts), and
   ``sheet_values`` gives the rows of all references by an interval join. A
   range whose rows the rule itself names is bounded by the rule, so a caller
   may ask for its rows in the record beside the reference.

Cell addresses and ranges (R5) are rectangles: all rectangles of a rule set
are rows of one table, joined with the sheets' rows by intervals, one scan for
each sheet, which reads no more rows and columns than the rectangles span.

A phrase is looked for in the text of each row (its cells joined by a space)
and across the border of two rows that follow each other; one that would run
over three rows is not found. Text between two anchors (R1) is sought within
cells, as a sheet has no paragraphs; the fallback over the joined text of all
cells is for files that are one row only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.nfkc import nfkc_strings
from quarry.functions.text import (after_label, normalize_mid, normalize_py, normalize_tail, py_strip,
                                   text_between)
from quarry.operators import rules as R
from quarry.operators.compile import Rule

#: Rows of a sheet that share a key in an interval join.
BUCKET = 4096
#: A range that reaches beyond this row is first cut to the sheet's own rows.
FAR = 1000 * BUCKET
HITS_T = "rule_no int, sheet_ord int, row_no bigint"
FACTS_T = (f"rule_no int, kind string, location string, miss_note string, ref {R.REF_T}, needs_ok boolean, no_hit boolean, "
           "cand boolean, error string, fallback string")


@dataclass(frozen=True)
class Spot:
    """A row of a sheet."""
    ord: int
    row: int


def _gate(*needles: str) -> Column:
    out = F.lit(True)
    for n in needles:
        out = out & F.col("flat").contains(normalize_py(n))
    return out


def with_text(rows: DataFrame, nfkc: bool = True) -> DataFrame:
    """Add ``plain`` (cells after NFKC where ``gate`` says that it may change them) and ``flat``
    (the row's normalised text). Without ``nfkc`` no row goes through Python."""
    plain = nfkc_strings(F.col("cells"), F.col("gate")) if nfkc else F.col("cells")
    return rows.withColumn("plain", plain).withColumn("flat", normalize_mid(F.concat_ws(" ", "plain")))


def _norms() -> Column:
    return F.transform("plain", normalize_tail)


def _holds(needle: str):
    key = normalize_py(needle)
    return lambda norm: norm.contains(key)


def _both(rule: Rule) -> Column:
    """The texts between the anchors, of the cells that hold both and something between them."""
    start, end = rule.p("start"), rule.p("end")
    pairs = F.zip_with("plain", _norms(), lambda c, n: F.struct(c.alias("c"), n.alias("n")))
    held = F.filter(pairs, lambda x: _holds(start)(x["n"]) & _holds(end)(x["n"]))
    return F.filter(F.transform(held, lambda x: text_between(x["c"], start, end)), lambda v: v != "")


def _phrases(rules: list[Rule]) -> list[str]:
    """Normalised phrases that rules look for in the text of tables."""
    keys = {"between": "start", "around_keywords": "keyword", "table_contains": "contains"}
    return sorted({normalize_py(r.p(keys[r.type])) for r in rules if r.type in keys and r.p(keys[r.type])})


def first_rows(rows: DataFrame, tests: dict[str, Column]) -> dict[str, dict[int, int]]:
    """For each test that holds somewhere the first row in each sheet (sheet_ord -> row_no).
    Row numbers only are aggregated; as many rows come back as there are sheets."""
    names = list(tests)
    found = rows.groupBy("sheet_ord").agg(*[F.min(F.when(tests[n], F.col("row_no"))).alias(f"t{k}") for k, n in enumerate(names)])
    out: dict[str, dict[int, int]] = {}
    for r in found.collect():
        for k, n in enumerate(names):
            if r[f"t{k}"] is not None:
                out.setdefault(n, {})[r["sheet_ord"]] = r[f"t{k}"]
    return out


def _cuts(phrase: str) -> list[int]:
    return [i for i, ch in enumerate(phrase) if ch == " "]


def search(wb, tests: dict[str, Column], phrases: list[str]) -> dict[str, Spot]:
    """The first row at which each test or ``phrase <phrase>`` holds, in tab
    order. One pass over the sheets without Python; only sheets with rows that
    NFKC may change are read again for those rows."""
    tests = dict(tests)
    for p in phrases:
        tests[f"phrase {p}"] = F.col("flat").contains(p)
        for i in _cuts(p):
            tests[f"end {i} {p}"], tests[f"start {i} {p}"] = F.col("flat").endswith(p[:i]), F.col("flat").startswith(p[i + 1:])
    if not tests:
        return {}
    rows = wb.all_rows()
    plain = with_text(rows, nfkc=False)
    found = first_rows(plain, {"gate": F.col("gate")} | {n: ~F.col("gate") & t for n, t in tests.items()})
    changed = found.pop("gate", {})
    if changed:
        again = with_text(rows.filter(F.col("sheet_ord").isin(list(changed)) & F.col("gate")))
        for n, by_sheet in first_rows(again, tests).items():
            for o, row in by_sheet.items():
                mine = found.setdefault(n, {})
                mine[o] = min(mine.get(o, row), row)
    # borders are looked at only where some row ends with the one part and some row starts with the other
    met = [(p, i, found[f"end {i} {p}"].keys() & found[f"start {i} {p}"].keys()) for p in phrases for i in _cuts(p)
           if f"end {i} {p}" in found and f"start {i} {p}" in found]
    met = [x for x in met if x[2]]
    if met:
        sheets = sorted(set().union(*[x[2] for x in met]))
        both = with_text(rows.filter(F.col("sheet_ord").isin(sheets)), nfkc=bool(changed.keys() & set(sheets)))
        for (p, o), row in border_rows(both, [(p, i) for p, i, _ in met]).items():
            mine = found.setdefault(f"phrase {p}", {})
            mine[o] = min(mine.get(o, row), row)
    return {n: Spot(*min(x.items())) for n, x in found.items()}


def border_rows(rows: DataFrame, cuts: list[tuple[str, int]]) -> dict[tuple[str, int], int]:
    """(phrase, sheet_ord) -> the first row whose end and the next row's start
    make up the phrase, cut at its space ``i``. Only rows that end or start so are shuffled."""
    names = sorted({p for p, _ in cuts})
    ends = [F.when(F.col("flat").endswith(p[:i]), F.struct(F.lit(names.index(p)).alias("k"), F.lit(i).alias("i"),
                                                           F.col("row_no").alias("at"), F.lit(1).alias("side"))) for p, i in cuts]
    starts = [F.when(F.col("flat").startswith(p[i + 1:]), F.struct(F.lit(names.index(p)).alias("k"), F.lit(i).alias("i"),
                                                                   (F.col("row_no") - 1).alias("at"), F.lit(2).alias("side"))) for p, i in cuts]
    parts = rows.select("sheet_ord", F.inline_outer(F.filter(F.array(*ends, *starts), lambda x: x.isNotNull()))).filter("k is not null")
    met = (parts.groupBy("sheet_ord", "k", "i", "at").agg(F.bit_or("side").alias("side")).filter("side = 3")
           .groupBy("sheet_ord", "k").agg(F.min("at").alias("at")))
    return {(names[r["k"]], r["sheet_ord"]): r["at"] for r in met.collect()}  # a row for each sheet and phrase, at most


# ---------------------------------------------------------------------------
# rectangles
# ---------------------------------------------------------------------------

def rectangle(spec: tuple, n_rows: int, n_cols: int) -> tuple[int, int, int, int]:
    """(first row, first column, last row, last column) of a cell or range;
    open ends (``A:B``, ``2:4``) reach to the sheet's last row or column."""
    if spec[0] == "cell":
        return spec[1], spec[2], spec[1], spec[2]
    r1, c1, r2, c2 = spec[1:]
    r1, r2 = (1, max(n_rows, 1)) if r1 is None else (min(r1, r2), max(r1, r2))
    c1, c2 = (1, max(n_cols, 1)) if c1 is None else (min(c1, c2), max(c1, c2))
    return r1, c1, r2, c2


def buckets(lo: Column, hi: Column) -> Column:
    return F.sequence(F.floor(lo / BUCKET), F.floor(hi / BUCKET))


def _rectangle_facts(wb, asked: list[tuple[Rule, object, tuple]], sizes: dict[int, int], range_values: bool = False) -> DataFrame | None:
    """rule_no, v (the first cell's text), head (the first row's texts), ok
    (some cell is not blank) of every rectangle that has rows in its sheet;
    with ``range_values`` also grid, all rows of each range whose rows its rule names.
    ``sizes`` (last rows, where known) keeps a far-reaching range from spanning buckets without rows."""
    spark, out = wb.spark, None
    named = {rule.rule_no: rect[2] for rule, _, rect in asked if rule.sheet_ref[0] == "range" and rule.sheet_ref[1] is not None}
    asked = [(rule, sheet, (r1, c1, min(r2, sizes.get(sheet.ord, r2)), c2)) for rule, sheet, (r1, c1, r2, c2) in asked]
    asked = [x for x in asked if x[2][0] <= x[2][2]]
    if not asked:
        return None
    rects = spark.createDataFrame([(rule.rule_no, sheet.ord, *map(int, rect), named.get(rule.rule_no)) for rule, sheet, rect in asked],
                                  "rule_no int, sheet_ord int, r1 bigint, c1 int, r2 bigint, c2 int, named bigint")
    rects = rects.withColumn("bucket", F.explode(buckets(F.col("r1"), F.col("r2"))))
    by_sheet: dict[int, list[tuple]] = {}
    for _, sheet, rect in asked:
        by_sheet.setdefault(sheet.ord, []).append(rect)
    for o, boxes in by_sheet.items():
        last = max(b[3] for b in boxes)
        rows = wb.rows_of(wb.sheets[o], min(b[0] for b in boxes), max(b[2] for b in boxes), min(b[1] for b in boxes), last)
        if rows is not None:
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        return None
    # the rectangles are the rule set's own, a row for each bucket of rows they span
    cut = F.slice("cells", F.greatest(F.col("c1") - F.col("first_col") + 1, F.lit(1)), F.col("c2") - F.col("c1") + 1)
    inside = (out.withColumn("bucket", F.floor(F.col("row_no") / BUCKET)).join(rects, ["sheet_ord", "bucket"])
              .filter("row_no between r1 and r2")
              .select("rule_no", "row_no", "r1", cut.alias("line"), "named", (F.col("c2") - F.col("c1") + 1).alias("width")))
    facts = inside.groupBy("rule_no").agg(
        F.max(F.when(F.col("row_no") == F.col("r1"), F.get("line", F.lit(0)))).alias("v"),
        F.max(F.when(F.col("row_no") == F.col("r1"), F.transform("line", lambda c: F.coalesce(c, F.lit(""))))).alias("head"),
        F.bool_or(F.exists("line", lambda c: F.coalesce(F.trim(c) != "", F.lit(False)))).alias("ok"))
    if not range_values:
        return facts
    # rows of the range that the sheet has not come as blank ones
    texts = F.transform("line", lambda c: F.coalesce(c, F.lit("")))
    lines = inside.filter("named is not null").select("rule_no", "row_no", F.concat(
        texts, F.array_repeat(F.lit(""), F.col("width") - F.size("line"))).alias("line"))
    blank = (rects.filter("named is not null").select("rule_no", "r1", "named", (F.col("c2") - F.col("c1") + 1).alias("width")).distinct()
             .select("rule_no", F.explode(F.sequence("r1", "named")).alias("row_no"), F.array_repeat(F.lit(""), F.col("width")).alias("line"))
             .join(lines, ["rule_no", "row_no"], "left_anti"))
    grids = lines.unionByName(blank).groupBy("rule_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda x: x["line"]).alias("grid"))
    return facts.join(grids, "rule_no", "left")


# ---------------------------------------------------------------------------
# records
# ---------------------------------------------------------------------------

def _ref(sheet, row_lo: int, row_hi: int, col_lo: int, col_hi: int, hit: int | None, fill: bool) -> tuple:
    """A reference: ``hit`` is the row that made the rule hit; with ``fill`` rows without cells count as blank ones."""
    return (sheet.name, sheet.ord, row_lo, row_hi, col_lo, col_hi, hit, fill, None)


def workbook_records(wb, rules: list[Rule], range_values: bool = False) -> DataFrame:
    """One row for each rule: project_id, label, problem, rule_no, cand, and
    rec where the workbook's label passes the rule's filter. With ``range_values``
    the records of ranges hold their rows, where the rule names these."""
    from quarry.plans.run import finish_sql_by_column  # the record's shape is the run's

    spark: SparkSession = wb.spark
    others = [r.rule_no for r in rules if r.match_key and r.match_key not in wb.label.lower()]
    rules = [r for r in rules if r.rule_no not in others]
    live = [r for r in rules if r.error is None]
    phrases = _phrases(live)
    inline = [r for r in live if r.type == "between" and r.p("start") and r.p("end")]
    labels = [r for r in live if r.type == "right_of" and r.p("label")]
    tests: dict[str, Column] = {}
    for r in labels:
        tests[f"cell {r.rule_no}"] = F.when(_gate(r.p("label")), F.exists(_norms(), _holds(r.p("label"))))
    for r in inline:
        tests[f"cell {r.rule_no}"] = F.when(_gate(r.p("start"), r.p("end")), F.size(_both(r)) > 0)
    spots = search(wb, tests, phrases)

    facts, reads, rects = [], [], []
    open_ended = any(r.sheet_ref and r.sheet_ref[0] == "range" and r.sheet_ref[1] is None for r in live)
    far = any(r.sheet_ref and r.sheet_ref[0] == "range" and r.sheet_ref[1] is not None and
              max(r.sheet_ref[1], r.sheet_ref[3]) > FAR for r in live)
    sizes = wb.sizes() if open_ended or far or any(r.type in ("around_keywords", "table_contains") for r in live) else {}
    for r in rules:
        n, kind, location, note, ref, needs_ok, no_hit = r.rule_no, "text", None, None, None, False, True
        if r.error is not None:
            pass
        elif r.type == "sheet_cell":
            name, ref_text = r.p("sheet"), (r.params.get("cell", "") or "").strip()
            kind = "table" if ":" in ref_text else "text"
            sheet, location = wb.find_sheet(name), f"{name}!{ref_text}"
            if sheet is None:
                location = location if kind == "table" else None
                note = f"No tab named '{name}'. Tabs found: {', '.join(wb.sheet_names)}."
            elif r.sheet_ref[0] == "bad":
                note = r.sheet_ref[1]
            else:
                rect = rectangle(r.sheet_ref, sizes.get(sheet.ord, 0), len(sheet.columns))
                rects.append((r, sheet, rect))
                no_hit = False
                if kind == "table":
                    note = f"Range {ref_text} on '{name}' is empty, or holds formulas whose results were never saved by Excel."
                    ref, needs_ok = _ref(sheet, rect[0], rect[2], rect[1], rect[3], None, True), True
                else:
                    note = (f"Cell {ref_text} on '{name}' is empty, or holds a formula whose result was never saved "
                            f"by Excel. Open the workbook in Excel, let it recalculate, save, and retry.")
        elif r.type in ("around_keywords", "table_contains"):
            key = "keyword" if r.type == "around_keywords" else "contains"
            kind = "block" if r.type == "around_keywords" else "table"
            spot = spots.get(f"phrase {normalize_py(r.p(key))}") if r.p(key) else None
            if spot:
                sheet = wb.sheets[spot.ord]
                kind, location, no_hit = "table", sheet.name, False
                ref = _ref(sheet, 1, max(sizes.get(spot.ord, 1), 1), 1, len(sheet.columns), spot.row, False)
                reads.append((n, spot.ord, 1))
        elif r.type == "right_of":
            spot = spots.get(f"cell {n}")
            if spot:
                location, no_hit = wb.sheets[spot.ord].name, False
                reads.append((n, spot.ord, spot.row))
        else:
            at = spots.get(f"phrase {normalize_py(r.p('start'))}") if r.p("start") else None
            spot = spots.get(f"cell {n}")
            if spot:
                location, no_hit = at and wb.sheets[at.ord].name, False
                reads.append((n, spot.ord, spot.row))
        facts.append((n, kind, location, note, ref, needs_ok, no_hit, True, r.error, r.default))
    facts += [(n, "text", None, None, None, False, True, False, None, None) for n in others]

    table = spark.createDataFrame(facts, FACTS_T)
    got = _read(wb, {r.rule_no: r for r in live}, reads)
    boxes = _rectangle_facts(wb, rects, sizes, range_values) if rects else None
    if boxes is not None:
        got = boxes if got is None else got.unionByName(boxes, allowMissingColumns=True)
    if got is None:
        got = spark.createDataFrame([], "rule_no int, v string, head array<string>, ok boolean")
    if "grid" not in got.columns:
        got = got.withColumn("grid", F.lit(None).cast(R.ROWS_T))
    j = table.join(got, "rule_no", "left")
    ok = ~F.col("no_hit") & (~F.col("needs_ok") | F.coalesce("ok", F.lit(False)))
    blank_cell = (F.col("kind") == "text") & F.col("v").isNull()
    raw = F.struct(
        F.col("kind"), F.when(ok & (F.col("kind") == "text"), F.col("v")).alias("value_text"),
        F.when(ok, F.col("grid")).alias("value_rows"), F.lit(None).cast(R.VBLOCK_T).alias("value_blocks"),
        F.when(ok & F.col("ref").isNotNull(), F.col("ref").withField("head", F.coalesce("head", F.col("ref.head")))).alias("value_ref"),
        F.col("location"), F.when(~ok | blank_cell, F.col("miss_note")).alias("note")).cast(R.RAW_T)
    # an exploded column is not copied into the expressions that read its fields
    j = j.select("rule_no", "cand", "error", "fallback", F.explode(F.array(raw)).alias("raw"))
    rec = F.when(F.col("cand"), F.expr(finish_sql_by_column("raw", "error", "fallback", R.sql_str(wb.label))))
    return j.select(F.lit(wb.project).alias("project_id"), F.lit(wb.label).alias("label"), F.lit(None).cast("string").alias("problem"),
                    "rule_no", "cand", F.explode(F.array(rec)).alias("rec"))


def _read(wb, rules: dict[int, Rule], reads: list[tuple[int, int, int]]) -> DataFrame | None:
    """rule_no, v, head, ok of the rules that hit, out of the rows they hit
    (or the first row of the table): key lookups, one for each sheet."""
    out = None
    for o in sorted({o for _, o, _ in reads}):
        rows = wb.some_rows(wb.sheets[o], sorted({row for _, x, row in reads if x == o}))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return None
    wanted = wb.spark.createDataFrame(reads, HITS_T)
    hit = with_text(out).join(wanted, ["sheet_ord", "row_no"])
    v = F.lit(None).cast("string")
    for n, _, _ in reads:
        r = rules[n]
        if r.type == "right_of":
            v = F.when(F.col("rule_no") == n, _right(r)).otherwise(v)
        elif r.type == "between":
            v = F.when(F.col("rule_no") == n, F.get(_both(r), F.lit(0))).otherwise(v)
    return hit.select("rule_no", v.alias("v"), F.col("cells").alias("head"), F.lit(True).alias("ok"))


def _right(rule: Rule) -> Column:
    """R2 in the row of the first hit: the next cell that is not blank, else
    the label cell's own tail, else ''."""
    label = rule.p("label")
    at = F.array_position(F.transform(_norms(), _holds(label)), True).cast("int")
    after = F.filter(F.slice("plain", at + 1, F.size("plain")), lambda c: py_strip(c) != "")
    own = after_label(F.get("plain", at - 1), label)
    return F.coalesce(py_strip(F.get(after, F.lit(0))), F.nullif(own, F.lit("")), F.lit(""))


# ---------------------------------------------------------------------------
# the rows behind the references
# ---------------------------------------------------------------------------

def sheet_values(wb, records: DataFrame) -> DataFrame:
    """project_id, rule_no, sheet, row_no, near, cells: a row for each sheet row
    of every reference among ``records`` that points into this workbook. ``near``:
    the row is within ``before`` / ``after`` rows of the hit, where the records have such columns, else it is the hit itself.

    References and rows meet in buckets of row numbers, so a whole sheet is
    spread over as many keys as it has buckets. Range rows without cells come as blanks."""
    ref = F.col("value_ref")
    refs = (records.filter(ref.isNotNull() & (F.col("file_label") == wb.label) & (F.col("project_id") == wb.project))
            .select("project_id", "rule_no", "value_ref.*", *[c for c in ("before", "after") if c in records.columns]).drop("head"))
    for c in ("before", "after"):
        if c not in refs.columns:
            refs = refs.withColumn(c, F.lit(0))
    keyed = refs.withColumn("bucket", F.explode(buckets(F.col("row_lo"), F.col("row_hi"))))
    rows = wb.all_rows().withColumn("bucket", F.floor(F.col("row_no") / BUCKET)).drop("sheet", "gate")
    got = keyed.join(rows, ["sheet_ord", "bucket"]).filter("row_no between row_lo and row_hi")
    near = F.coalesce(F.col("row_no").between(F.col("hit_row") - F.col("before"), F.col("hit_row") + F.col("after")), F.lit(False))
    width = F.col("col_hi") - F.col("col_lo") + 1
    cut = F.slice("cells", F.col("col_lo"), width)
    padded = F.concat(cut, F.array_repeat(F.lit(""), width - F.size(cut)))
    out = got.select("project_id", "rule_no", "sheet", "row_no", near.alias("near"), F.when(F.col("fill"), padded).otherwise(cut).alias("cells"))
    expected = (keyed.filter("fill").withColumn("row_no", F.explode(F.sequence(
        F.greatest("row_lo", F.col("bucket") * BUCKET), F.least("row_hi", F.col("bucket") * BUCKET + BUCKET - 1)))))
    blank = (expected.join(rows.select("sheet_ord", "row_no"), ["sheet_ord", "row_no"], "left_anti")
             .select("project_id", "rule_no", "sheet", "row_no", F.lit(False).alias("near"), F.array_repeat(F.lit(""), width).alias("cells")))
    return out.unionByName(blank)
