"""One extraction run over a corpus: candidate choice, defaults, citations.

Plan shape (P1-P8):

1. one narrow pass over the file rows: every rule is a column expression,
   guarded by its candidate test (P1), so each file yields one small record
   per rule, and nothing but these records leaves the scan stage;
2. one aggregation on (project, rule) of ``min((not found, label))``: the
   first found record in label order, else the first readable candidate's
   miss (P2). It ranks flags and labels only, no value, and it is partial
   (map-side), so a project holding a third of all files still shuffles one
   row per task and rule;
3. the winners (one row per project and rule) are stored; the files among
   them, and no others, are read once more and give the winning records;
4. the final projection turns empty groups into P3 and all-unreadable ones
   into P4 records, and attaches the rule's names from a literal table whose
   size is the rule set's.

Workbooks have no bound, so their rules work on rows in long form
(``operators.sheet_rules``) and add one small record per rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import rules as R
from quarry.operators.compile import Rule, compile_rule, compile_ruleset
from quarry.sources.sheets import Workbook

# Texts of the records the run writes itself.
DEFAULT_NOTE = "Nothing found; the rule's default value was used."
DEFAULT_CITATION_SUFFIX = " — not found, default used"
CITATION_SEP = " — "
UNREADABLE_NOTE = "The matching file could not be read."

FILE_REC_T = (
    "struct<found:boolean,kind:string,value_text:string,value_rows:array<array<string>>,"
    "value_blocks:array<struct<block_no:int,kind:string,text:string,rows:array<array<string>>>>,"
    f"value_ref:{R.REF_T},location:string,citation:string,note:string>")


@dataclass
class Corpus:
    """Files as rows with ordered blocks, plus workbooks for sheet rules:
    relational workbooks (sheets known on the driver) and decoded office
    workbooks (``cell_books``: sheet list and sparse cells as DataFrames)."""
    files: DataFrame
    workbooks: list
    cell_books: tuple | None = None
    #: (project_id, label) -> ``files`` limited to these, where the source can
    #: leave the others out before it builds their blocks
    narrowed: Callable[[DataFrame], DataFrame] | None = None

    def all_files(self) -> DataFrame:
        """The files whose blocks are in their row; relational workbooks are not among them."""
        cols = ["project_id", "label", "ext", "problem", "blocks"]
        return self.files.select(*cols, "nfkc") if "nfkc" in self.files.columns else \
            self.files.select(*cols, F.lit(None).cast("boolean").alias("nfkc"))

    def only(self, labels: DataFrame) -> DataFrame:
        """The named files."""
        if self.narrowed:
            return replace(self, files=self.narrowed(labels)).all_files()
        files = self.all_files()
        return files.join(labels, ["project_id", "label"], "left_semi").select(*files.columns)


def candidate(rule: Rule, label: Column) -> Column:
    """Blank match = every file; else a trimmed, lower-cased substring
    of the lower-cased label."""
    if not rule.match_key:
        return F.lit(True)
    return F.lower(label).contains(rule.match_key)


def found_sql(raw: str) -> str:
    return (f"(CASE WHEN {raw}.kind = 'text' THEN coalesce({raw}.value_text <> '', false) "
            f"WHEN {raw}.kind = 'table' THEN {raw}.value_rows IS NOT NULL OR {raw}.value_ref IS NOT NULL "
            f"ELSE coalesce(size({raw}.value_blocks) > 0, false) END)")


def finish_sql(rule: Rule, raw: str, label_sql: str = "label") -> str:
    """P5-P8 on one file's raw result, as one SQL expression over the raw
    result column ``raw`` (parsed once on the JVM instead of being built a
    column at a time from Python)."""
    nulls = (f"'value_rows', CAST(NULL AS {R.ROWS_T}), 'value_blocks', CAST(NULL AS {R.VBLOCK_T}), "
             f"'value_ref', CAST(NULL AS {R.REF_T}), 'location', CAST(NULL AS STRING)")
    if rule.error is not None:
        return (f"named_struct('found', false, 'kind', 'text', 'value_text', CAST(NULL AS STRING), "
                f"{nulls}, 'citation', {label_sql}, 'note', {R.sql_str(rule.error)})")
    found = found_sql(raw)
    cited = (f"CASE WHEN {found} AND {raw}.location IS NOT NULL AND {raw}.location <> '' "
             f"THEN concat({label_sql}, {R.sql_str(CITATION_SEP)}, {raw}.location) ELSE {label_sql} END")
    hit = (f"named_struct('found', {found}, 'kind', {raw}.kind, "
           f"'value_text', CASE WHEN {found} THEN {raw}.value_text END, "
           f"'value_rows', CASE WHEN {found} THEN {raw}.value_rows END, "
           f"'value_blocks', CASE WHEN {found} THEN {raw}.value_blocks END, "
           f"'value_ref', CASE WHEN {found} THEN {raw}.value_ref END, "
           f"'location', {raw}.location, 'citation', {cited}, 'note', {raw}.note)")
    if not rule.default:
        return hit
    dflt = (f"named_struct('found', true, 'kind', 'text', 'value_text', {R.sql_str(rule.default)}, "
            f"{nulls}, 'citation', concat({label_sql}, {R.sql_str(DEFAULT_CITATION_SUFFIX)}), "
            f"'note', {R.sql_str(DEFAULT_NOTE)})")
    return f"CASE WHEN {found} THEN {hit} ELSE {dflt} END"


def finish_sql_by_column(raw: str, error: str, fallback: str, label_sql: str) -> str:
    """``finish_sql`` where the rule's error and default are columns (null: none), for rules that are rows."""
    plain = compile_rule(0, {"type": "right_of"})
    hit = finish_sql(plain, raw, label_sql)
    nulls = (f"'value_rows', CAST(NULL AS {R.ROWS_T}), 'value_blocks', CAST(NULL AS {R.VBLOCK_T}), "
             f"'value_ref', CAST(NULL AS {R.REF_T}), 'location', CAST(NULL AS STRING)")
    failed = (f"named_struct('found', false, 'kind', 'text', 'value_text', CAST(NULL AS STRING), {nulls}, "
              f"'citation', {label_sql}, 'note', {error})")
    dflt = (f"named_struct('found', true, 'kind', 'text', 'value_text', {fallback}, {nulls}, "
            f"'citation', concat({label_sql}, {R.sql_str(DEFAULT_CITATION_SUFFIX)}), 'note', {R.sql_str(DEFAULT_NOTE)})")
    return (f"CASE WHEN {error} IS NOT NULL THEN {failed} WHEN {fallback} IS NOT NULL AND NOT {found_sql(raw)} THEN {dflt} "
            f"ELSE {hit} END")


def finished(df: DataFrame, rule: Rule, raw: Column, label_sql: str, cols: list) -> DataFrame:
    """Apply P5-P8 to a raw result column of ``df``."""
    return df.withColumn("_raw", raw).select(*cols, F.expr(finish_sql(rule, "_raw", label_sql)).alias("rec"))


def file_records(files: DataFrame, rules: list[Rule], workbook_exts=(".xlsx", ".xlsm"), flags: bool = False) -> DataFrame:
    """Per (file, rule): the candidate flag and, for readable candidates,
    the record, or with ``flags`` only whether it is a find (a default is
    one). Sheet rules are left null on decoded workbooks (filled by ``cell_sheet_records``)."""
    files = R.prepare(files)
    readable = F.col("problem").isNull()
    is_wb = F.col("ext").isin(*workbook_exts)
    if R.needs_paragraph_list(rules):
        files = R.with_paragraph_list(files)
    levels: list[dict] = []  # stage columns batched by dependency depth
    entries = []
    label = F.col("label")
    for rule in rules:
        cand = candidate(rule, label)
        active = cand & readable
        if rule.type == "sheet_cell" and rule.error is None:
            active = active & ~is_wb
        if rule.error is not None:
            stages, raw = [], R._miss("text")
        else:
            stages, raw = R.BUILDERS[rule.type](rule)
        # the raw result is its own column: finish() reads several of its
        # fields, and each field access would otherwise copy the whole rule
        # expression (subexpressions under a condition are not shared)
        raw_name = f"_r{rule.rule_no}_raw"
        # a stage only reads stages listed before it in its own rule
        for depth, (name, expr) in enumerate(stages + [(raw_name, raw)]):
            while len(levels) <= depth:
                levels.append({})
            levels[depth][name] = F.when(active, expr)
        if not flags:
            last = F.expr(finish_sql(rule, raw_name)).alias("rec")
        else:
            last = (F.lit(False) if rule.error is not None else F.lit(True) if rule.default else
                    F.expr(found_sql(raw_name))).alias("found")
        entries.append(F.struct(F.lit(rule.rule_no).alias("rule_no"), cand.alias("cand"),
                                F.when(active, last).alias("found" if flags else "rec")))
    # one projection per depth instead of one per column: every withColumn
    # re-analyses the whole plan on the driver
    for cols in levels:
        files = files.withColumns(cols)
    return files.select("project_id", "label", "problem", F.inline_outer(F.array(*entries)))


def sheet_records(workbooks: list[Workbook], rules: list[Rule], range_values: bool = False) -> DataFrame | None:
    """The records of relational workbooks: one per (workbook, rule)."""
    from quarry.operators.sheet_rules import workbook_records
    out = None
    for wb in workbooks:
        recs = workbook_records(wb, rules, range_values)
        out = recs if out is None else out.unionByName(recs)
    return out


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rule set as a literal table (size = the rule set's)."""
    return spark.createDataFrame(
        [(r.rule_no, r.run_name, r.no_file_name, r.raw_type, r.type, r.match, r.error is not None)
         for r in rules],
        "rule_no int, run_name string, no_file_name string, raw_type string, rule_type string, "
        "match string, is_error boolean")


def winners(flags: DataFrame) -> DataFrame:
    """Per (project, rule) the number of candidates, the first one's label
    and ``best``, the label of the first find, else of the first readable candidate.
    ``flags`` has project_id, label, rule_no, cand and found (null: not evaluated)."""
    return flags.groupBy("project_id", "rule_no").agg(
        F.count_if(F.col("cand")).alias("n_cand"),
        F.min(F.when(F.col("cand"), F.col("label"))).alias("first_cand"),
        F.min(F.when(F.col("found"), F.col("label"))).alias("hit"),
        F.min(F.when(F.col("found").isNotNull(), F.col("label"))).alias("tried"),
    ).select("project_id", "rule_no", "n_cand", "first_cand", F.coalesce("hit", "tried").alias("best"))


def flags_of(per_file: DataFrame) -> DataFrame:
    return per_file.select("project_id", "label", "rule_no", "cand", F.col("rec.found").alias("found"))


def pick(spark: SparkSession, per_file: DataFrame, rules: list[Rule]) -> DataFrame:
    """P2-P4 over a stored table of per-file records."""
    won = winners(flags_of(per_file))
    return picked(spark, won, per_file, rules)


def picked(spark: SparkSession, won: DataFrame, per_file: DataFrame, rules: list[Rule]) -> DataFrame:
    """One record per (project, rule): the winners with their records out of
    ``per_file``. A label names one file of its project (S2 keeps the newest version)."""
    found = per_file.filter(F.col("rec").isNotNull()).select("project_id", "rule_no", F.col("label").alias("best"), "rec")
    agg = won.join(found, ["project_id", "rule_no", "best"], "left").dropDuplicates(["project_id", "rule_no"])
    meta = F.broadcast(rules_table(spark, rules))
    j = agg.join(meta, "rule_no")
    best = F.col("rec")
    none = F.col("n_cand") == 0
    unreadable = F.col("best").isNull()
    no_file_cite = F.concat(F.lit("(no uploaded file matched '"), F.col("match"), F.lit("')"))
    no_file_note = F.concat(F.lit("No uploaded file name contains '"), F.col("match"), F.lit("'."))
    return j.select(
        "project_id", "rule_no",
        F.when(none | unreadable, F.col("no_file_name")).otherwise(F.col("run_name")).alias("name"),
        F.when(none | unreadable, F.lit("text")).otherwise(best["kind"]).alias("kind"),
        F.when(~(none | unreadable), best["value_text"]).alias("value_text"),
        F.when(~(none | unreadable), best["value_rows"]).alias("value_rows"),
        F.when(~(none | unreadable), best["value_blocks"]).alias("value_blocks"),
        F.when(~(none | unreadable), best["value_ref"]).alias("value_ref"),
        F.when(none, no_file_cite).when(unreadable, F.col("first_cand"))
         .otherwise(best["citation"]).alias("citation"),
        F.when(none | unreadable, F.lit(False)).otherwise(best["found"]).alias("found"),
        F.when(none, no_file_note).when(unreadable, F.lit(UNREADABLE_NOTE))
         .otherwise(best["note"]).alias("note"),
        F.when(none | unreadable, F.col("raw_type")).otherwise(F.col("rule_type")).alias("rule_type"),
        F.when(~(none | unreadable), F.col("best")).alias("file_label"),
        F.when(~(none | unreadable), best["location"]).alias("location"),
    )


def _book_records(corpus: Corpus, rules: list[Rule], range_values: bool = False) -> DataFrame | None:
    """Records of all workbooks' sheets: one small row per workbook and rule."""
    out = sheet_records(corpus.workbooks, rules, range_values)
    if corpus.cell_books is not None:
        decoded = cell_sheet_records(corpus.all_files(), *corpus.cell_books, rules)
        if decoded is not None:
            out = decoded if out is None else out.unionByName(decoded)
    return out


def corpus_file_records(spark: SparkSession, corpus: Corpus, rules: list[Rule], range_values: bool = False) -> DataFrame:
    """Per (file, rule) records of the whole corpus, workbooks included. With
    ``range_values`` ranges of sheets hold their rows beside the reference."""
    per_file, books = file_records(corpus.all_files(), rules), _book_records(corpus, rules, range_values)
    return per_file if books is None else per_file.unionByName(books)


def run_ruleset(spark: SparkSession, corpus: Corpus, ruleset: dict) -> DataFrame:
    """The records of one rule set over every project of the corpus, in two
    passes: the first ranks flags and labels, the second builds records for the
    winning files only. The winners are stored between the passes, so Spark
    knows their size when it plans the join with the files."""
    from quarry.session import keep
    rules = compile_ruleset(ruleset)
    flags, books = file_records(corpus.all_files(), rules, flags=True).drop("problem"), _book_records(corpus, rules)
    if books is not None:
        books = keep(books, "books")
        flags = flags.unionByName(flags_of(books))
    won = keep(winners(flags), "winners")
    again = file_records(corpus.only(won.select("project_id", F.col("best").alias("label"))), rules)
    return picked(spark, won, again if books is None else again.unionByName(books), rules)


def sheet_values(corpus: Corpus, records: DataFrame) -> DataFrame | None:
    """The rows behind the references of ``records``: project_id, rule_no, sheet, row_no, near, cells."""
    from quarry.operators.sheet_rules import sheet_values as rows_of
    out = None
    for wb in corpus.workbooks:
        rows = rows_of(wb, records)
        out = rows if out is None else out.unionByName(rows)
    return out


def cell_sheet_records(files: DataFrame, sheets: DataFrame, cells: DataFrame, rules: list[Rule]) -> DataFrame | None:
    """R5a/R5b on decoded workbooks, whose sheet names are data.

    Per sheet rule: the candidate workbooks, the first sheet (tab order)
    whose trimmed, lower-cased name equals the rule's, the rule's cell
    rectangle filtered out of the sparse cells (a pushed-down filter on row
    and column), and the tab list for the missing-sheet note. Every join is
    on the project and the file label; the rectangle and the tab list are bounded by the
    rule and the workbook's sheet count."""
    from quarry.functions.text import py_strip
    books = files.filter(F.col("ext").isin(".xlsx", ".xlsm") & F.col("problem").isNull()) \
        .select("project_id", "label")
    tabs = sheets.groupBy("project_id", "label").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("sheet_ord", "sheet"))), lambda x: x["sheet"]), ", ").alias("tabs"))
    parts = []
    for rule in rules:
        if rule.type != "sheet_cell" or rule.error is not None:
            continue
        sheet_name = rule.p("sheet")
        ref = (rule.params.get("cell", "") or "").strip()
        is_range = ":" in ref
        loc = f"{sheet_name}!{ref}"
        want = (sheet_name or "").strip().lower()
        target = sheets.filter(F.lower(py_strip(F.col("sheet"))) == want).groupBy("project_id", "label") \
            .agg(F.min_by("sheet", "sheet_ord").alias("target"))
        cand = books.filter(candidate(rule, F.col("label")))
        base = cand.join(target, ["project_id", "label"], "left").join(tabs, ["project_id", "label"], "left")
        no_tab = F.concat(F.lit(f"No tab named '{sheet_name}'. Tabs found: "), F.coalesce("tabs", F.lit("")),
                          F.lit("."))
        kind = "table" if is_range else "text"
        missing = R.raw_result(kind, location=loc if is_range else None, note=no_tab)
        spec = rule.sheet_ref
        if spec[0] == "bad":
            raw = F.when(F.col("target").isNull(), missing).otherwise(R.raw_result(kind, location=loc, note=spec[1]))
            j = base
        elif spec[0] == "cell":
            r, c = spec[1], spec[2]
            hit = cells.filter((F.col("row_no") == r) & (F.col("col_no") == c)).select(
                "project_id", "label", F.col("sheet").alias("target"), F.col("value"))
            j = base.join(hit, ["project_id", "label", "target"], "left")
            note = (f"Cell {ref} on '{sheet_name}' is empty, or holds a formula whose result was never saved "
                    f"by Excel. Open the workbook in Excel, let it recalculate, save, and retry.")
            raw = F.when(F.col("target").isNull(), missing).otherwise(R.raw_result(
                "text", value_text=F.col("value"), location=loc, note=F.when(F.col("value").isNull(), F.lit(note))))
        else:
            r1, c1, r2, c2 = spec[1:]
            in_rect = F.lit(True)
            if r1 is not None:
                r1, r2 = min(r1, r2), max(r1, r2)
                in_rect = in_rect & F.col("row_no").between(r1, r2)
            if c1 is not None:
                c1, c2 = min(c1, c2), max(c1, c2)
                in_rect = in_rect & F.col("col_no").between(c1, c2)
            # whole columns and rows reach to the last row and column of the sheet
            ends = cells.groupBy("project_id", "label", F.col("sheet").alias("target")).agg(
                F.max("row_no").alias("nr"), F.max("col_no").alias("nc"))
            rect = cells.filter(in_rect) \
                .groupBy("project_id", "label", F.col("sheet").alias("target")).agg(F.map_from_entries(F.collect_list(F.struct(
                    F.struct(F.col("row_no").alias("r"), F.col("col_no").alias("c")), F.col("value")))).alias("m"))
            j = base.join(rect, ["project_id", "label", "target"], "left").join(ends, ["project_id", "label", "target"], "left")
            m = F.coalesce(F.col("m"), F.create_map().cast("map<struct<r:int,c:int>,string>"))
            row_nos = F.sequence(F.lit(r1), F.lit(r2)) if r1 is not None else F.sequence(F.lit(1), F.coalesce("nr", F.lit(1)))
            col_nos = F.sequence(F.lit(c1), F.lit(c2)) if c1 is not None else F.sequence(F.lit(1), F.coalesce("nc", F.lit(1)))
            grid = F.transform(row_nos, lambda rr: F.transform(
                col_nos, lambda cc: F.coalesce(m[F.struct(rr.alias("r"), cc.alias("c"))], F.lit(""))))
            blank = ~F.exists(F.flatten(grid), lambda v: F.trim(v) != "")
            note = (f"Range {ref} on '{sheet_name}' is empty, or holds formulas whose results were never "
                    f"saved by Excel.")
            raw = (F.when(F.col("target").isNull(), missing)
                   .when(blank, R.raw_result("table", location=loc, note=note))
                   .otherwise(R.raw_result("table", value_rows=grid, location=loc)))
        parts.append(finished(j, rule, raw, "label", [
            "project_id", "label", F.lit(None).cast("string").alias("problem"),
            F.lit(rule.rule_no).alias("rule_no"), F.lit(True).alias("cand")]))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
