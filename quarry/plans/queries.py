"""The registered queries: each reads the driver tables and returns a flat
DataFrame whose columns match its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.fixtures import CORPUS_RULESET
from quarry.functions.text import column_letters, preview, render_value
from quarry.operators import rules as R
from quarry.operators.compile import compile_ruleset
from quarry.plans import run as RUN
from quarry.sources import corpus as C
from quarry.sources.sheets import WORKBOOK_LABEL, Workbook


def flagship_corpus(spark: SparkSession, sf_dir: str) -> RUN.Corpus:
    def files(only=None):
        decks = C.conversations_files(spark, sf_dir)
        if only is not None:
            decks = decks.join(only, ["project_id", "label"], "left_semi").select(*decks.columns)
        return C.documents_files(spark, sf_dir, only=only).unionByName(decks)
    return RUN.Corpus(files(), [Workbook(spark, sf_dir)], narrowed=files)


def flat_blocks(files: DataFrame) -> DataFrame:
    b = files.select("project_id", "label", F.explode_outer("blocks").alias("b")).filter(F.col("b").isNotNull())
    return b.select(
        "project_id", "label", F.col("b.block_no").cast("bigint").alias("block_no"), F.col("b.kind").alias("kind"),
        F.col("b.location").alias("location"),
        F.when(F.col("b.kind") == "table", F.array_join(F.flatten("b.rows"), " "))
         .otherwise(F.col("b.text")).alias("text"),
        F.when(F.col("b.kind") == "table", F.size("b.rows")).otherwise(0).cast("bigint").alias("n_rows"))


def blocks_text(spark, sf_dir):
    return flat_blocks(C.documents_files(spark, sf_dir))


def blocks_slides(spark, sf_dir):
    """Block numbers from counts of pieces, without gathering a deck."""
    b = C.deck_blocks(C.read_table(spark, sf_dir, "conversations"))
    return b.select(F.lit(C.CONVERSATIONS_PROJECT).alias("project_id"),
                    F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".pptx")).alias("label"),
                    F.col("block_no").cast("bigint").alias("block_no"), "kind", "location", "text", F.lit(0).cast("bigint").alias("n_rows"))


def blocks_html(spark, sf_dir):
    return flat_blocks(C.pages_files(spark, sf_dir))


def sheet_blocks(spark, sf_dir):
    """All rows of all sheets."""
    return Workbook(spark, sf_dir).all_rows().select(
        F.lit(WORKBOOK_LABEL).alias("label"), "sheet", (F.col("sheet_ord") + 1).cast("bigint").alias("block_no"), "row_no",
        F.array_join("cells", " | ").alias("cells"))


# Phrases sought in whole sheets: a name far down a sheet, a value of many
# rows, a date, a heading (row 1) and a miss.
SHEET_PHRASES = ["Customer#000000450", " 5-low ", "1998-03-01", "C_NAME", "no such phrase"]


def sheet_rows_containing(spark, sf_dir):
    """R0 over whole sheets in long form, without a bound on rows."""
    found = Workbook(spark, sf_dir).rows_containing(SHEET_PHRASES)
    return found.select("phrase", "sheet", "row_no", F.array_join("cells", " | ").alias("cells"))


def sheet_grid(spark, sf_dir):
    wb = Workbook(spark, sf_dir)
    out = None
    for sh in wb.sheets:
        g = wb.grid(sh)
        out = g if out is None else out.unionByName(g)
    return out.select("sheet", F.col("row_no").cast("bigint").alias("row_no"),
                      F.col("col_no").cast("bigint").alias("col_no"), "ref", "value")


def normalize_units(spark, sf_dir):
    p = R.prepare(C.documents_files(spark, sf_dir))
    u = p.select("label", F.explode_outer("units").alias("u")).filter(F.col("u").isNotNull())
    return u.select("label", F.col("u.block_no").cast("bigint").alias("block_no"),
                    F.col("u.row_no").cast("bigint").alias("row_no"),
                    F.col("u.col_no").cast("bigint").alias("col_no"), F.col("u.norm").alias("norm"))


# Anchors for the anchor-hit query: common words, a phrase, a table word,
# a lone '*' (normalises to "" and so matches every block) and a miss.
ANCHORS = ["licensed under", "the and", "ofreshwhou", "Token = \"", "  The  ", "*", "lorem"]


def anchor_hits(spark, sf_dir):
    """R0 and N2 per (file, anchor): first matching block's location and the
    number of matching blocks. A file is one row, so its hits are filtered
    and counted inside that row: no shuffle."""
    from quarry.functions.text import normalize_py
    p = R.prepare(C.documents_files(spark, sf_dir)).select("project_id", "label", "blocks")
    # each anchor's hits are their own column: they are read twice below
    found = [(i, f"_hits{i}", normalize_py(a)) for i, a in enumerate(ANCHORS) if a]
    p = p.withColumns({name: F.expr(f"transform(filter(blocks, b -> contains(b.norm, {R.sql_str(anchor)})), "
                                    "b -> b.location)") for _, name, anchor in found})
    per_anchor = F.array(*[F.struct(F.lit(i).cast("bigint").alias("anchor_no"),
                                    F.get(name, 0).alias("first_location"),
                                    F.size(name).cast("bigint").alias("n_blocks")) for i, name, _ in found])
    return p.select("label", F.inline_outer(per_anchor)).filter("n_blocks > 0")


# How many phrases of the benchmark are sought at once.
MANY_ANCHORS = 1000


def anchor_scan(spark, sf_dir, many: int = MANY_ANCHORS):
    """R0/N2 with a thousand anchors as data: phrases of the benchmark in the documents."""
    from quarry.operators import anchors as A
    wanted = A.phrases(C.read_table(spark, sf_dir, "benchmark"), "item_id", "text", many)
    return A.scan(C.documents_files(spark, sf_dir), wanted).select("label", "anchor_no", "first_location", "n_blocks")


def ref_text(ref: Column) -> Column:
    """A reference as an address: sheet!A1:C7."""
    def at(row, col):
        return F.concat(column_letters(col), row.cast("string"))
    return F.concat(ref["sheet"], F.lit("!"), at(ref["row_lo"], ref["col_lo"]), F.lit(":"), at(ref["row_hi"], ref["col_hi"]))


def _records_out(df: DataFrame) -> DataFrame:
    return df.select(
        "project_id", F.col("rule_no").cast("bigint").alias("rule_no"), "name", "kind", "found", "citation", "note",
        "rule_type", "file_label", ref_text(F.col("value_ref")).alias("value_ref"),
        F.when(F.col("found"), render_value(F.col("kind"), F.col("value_text"), F.col("value_rows"),
                                           F.col("value_blocks"))).alias("value"))


def records(spark, sf_dir, ruleset=CORPUS_RULESET, materialize: bool = False, corpus_fn=flagship_corpus) -> DataFrame:
    """The run's records. Reports read them several times, so they ask for
    a materialised copy: a reliable checkpoint in the shared checkpoint
    folder (one row per project and rule, so small), which also cuts the
    lineage back to the corpus scan."""
    recs = RUN.run_ruleset(spark, corpus_fn(spark, sf_dir), ruleset)
    if materialize:
        from quarry.session import checkpoint_dir
        checkpoint_dir(spark)
        recs = recs.checkpoint(eager=True)
    return recs


def apply_ruleset(spark, sf_dir):
    return _records_out(records(spark, sf_dir))


def per_file(spark, sf_dir, ruleset, corpus_fn=flagship_corpus, range_values: bool = False) -> DataFrame:
    pf = RUN.corpus_file_records(spark, corpus_fn(spark, sf_dir), compile_ruleset(ruleset), range_values).filter(F.col("rec").isNotNull())
    r = F.col("rec")
    return pf.select(
        "project_id", "label", F.col("rule_no").cast("bigint").alias("rule_no"), r["kind"].alias("kind"),
        F.when(r["found"], render_value(r["kind"], r["value_text"], r["value_rows"], r["value_blocks"])).alias("value"),
        ref_text(r["value_ref"]).alias("value_ref"), r["found"].alias("found"), r["citation"].alias("citation"), r["note"].alias("note"))


def _rs(*fields):
    return {"name": "q", "fields": list(fields)}


BETWEEN_RULES = _rs(
    {"name": "token", "type": "between", "match": "", "params": {"start": 'token = "', "end": '"'}},
    {"name": "span", "type": "between", "match": "", "params": {"start": "the and", "end": "of the"}},
    {"name": "open span", "type": "between", "match": "doc_1", "params": {"start": "licensed under"}},
    {"name": "cells", "type": "between", "match": "", "params": {"start": "ofreshwhou", "end": "ofanerhand"}},
)
RIGHT_OF_RULES = _rs(
    {"name": "orthon", "type": "right_of", "match": "", "params": {"label": "ofreshwhou"}},
    {"name": "nation name", "type": "right_of", "match": "", "params": {"label": "NATION_3"}},
    {"name": "last column", "type": "right_of", "match": "", "params": {"label": "stupid"}},
)
AROUND_RULES = _rs(
    {"name": "blerend", "type": "around_keywords", "match": "", "params": {"keyword": "blerend", "before": 1, "after": 2}},
    {"name": "license", "type": "around_keyword", "match": "doc", "params": {"keyword": "licensed under", "before": "2"}},
    {"name": "table word", "type": "around_keywords", "match": "", "params": {"keyword": "worthless", "after": 3}},
    {"name": "bad count", "type": "around_keywords", "match": "conv_2", "params": {"keyword": "the", "before": "abc"}},
    {"name": "negative", "type": "around_keywords", "match": "conv_3", "params": {"keyword": "the", "before": -1, "after": 1}},
)
TABLE_RULES = _rs(
    {"name": "nation seven", "type": "table_contains", "match": "", "params": {"contains": "NATION_7"}},
    {"name": "pipe table", "type": "table_contains", "match": "doc_", "params": {"contains": "worthless"}},
    {"name": "empty", "type": "table_contains", "match": "", "params": {"contains": ""}},
)
SHEET_RULES = _rs(
    {"name": "region", "type": "sheet_cell", "match": "", "params": {"sheet": "REGION", "cell": "B3"}},
    {"name": "header", "type": "sheet_cell", "match": "xlsx", "params": {"sheet": "orders", "cell": "E1"}},
    {"name": "order total", "type": "sheet_cell", "match": "xlsx", "params": {"sheet": "orders", "cell": "D12"}},
    {"name": "past the end", "type": "sheet_cell", "match": "xlsx", "params": {"sheet": "region", "cell": "B99"}},
    {"name": "block", "type": "sheet_cell", "match": "xlsx", "params": {"sheet": "customer", "cell": "B10:D14"}},
    {"name": "empty block", "type": "sheet_cell", "match": "xlsx", "params": {"sheet": "nation", "cell": "G2:H3"}},
    {"name": "no tab", "type": "sheet_cell", "match": "xlsx", "params": {"sheet": "Ledger", "cell": "A1"}},
    {"name": "bad ref", "type": "sheet_cell", "match": "xlsx", "params": {"sheet": "nation", "cell": "1A"}},
    {"name": "on text", "type": "sheet_cell", "match": "conv_4", "params": {"sheet": "nation", "cell": "A1"}},
)


def rules_between(spark, sf_dir):
    return per_file(spark, sf_dir, BETWEEN_RULES)


def rules_right_of(spark, sf_dir):
    return per_file(spark, sf_dir, RIGHT_OF_RULES)


def rules_around(spark, sf_dir):
    return per_file(spark, sf_dir, AROUND_RULES)


def rules_table_contains(spark, sf_dir):
    return per_file(spark, sf_dir, TABLE_RULES)


def rules_sheet_cell(spark, sf_dir):
    """R5 with the texts of each range, and its reference."""
    return per_file(spark, sf_dir, SHEET_RULES, range_values=True)


# Rules whose hits lie far down the sheets (no row of `orders` above 400 has
# these dates), over cells and over the border of two rows, and rectangles of all kinds.
DEEP_RULES = _rs(
    {"name": "date and priority", "type": "around_keywords", "match": "tpch",
     "params": {"keyword": "2000-10-08 00:00:00 2-HIGH", "before": 2, "after": 1}},
    {"name": "date", "type": "table_contains", "match": "xlsx", "params": {"contains": "1998-03-01"}},
    {"name": "its priority", "type": "right_of", "match": "", "params": {"label": "1998-03-01"}},
    {"name": "over two rows", "type": "table_contains", "match": "xlsx", "params": {"contains": "Specified 770"}},
    {"name": "customer", "type": "between", "match": "xlsx", "params": {"start": "Customer#", "end": "149"}},
    {"name": "many cells", "type": "sheet_cell", "match": "xlsx", "params": {"sheet": "orders", "cell": "F16700:A1"}},
    {"name": "whole column", "type": "sheet_cell", "match": "xlsx", "params": {"sheet": "part", "cell": "B:B"}},
    {"name": "whole rows", "type": "sheet_cell", "match": "xlsx", "params": {"sheet": "supplier", "cell": "2:4"}},
    {"name": "deep cell", "type": "sheet_cell", "match": "xlsx", "params": {"sheet": "orders", "cell": "D1200"}},
    {"name": "beyond", "type": "sheet_cell", "match": "xlsx", "params": {"sheet": "region", "cell": "AAAA9:AAAB2000000"}},
    {"name": "nowhere", "type": "table_contains", "match": "xlsx", "default": "none", "params": {"contains": "no such phrase"}},
)


def workbook_corpus(spark, sf_dir) -> RUN.Corpus:
    return RUN.Corpus(C.documents_files(spark, sf_dir), [Workbook(spark, sf_dir)],
                      narrowed=lambda only: C.documents_files(spark, sf_dir, only=only))


def rules_sheets_deep(spark, sf_dir):
    """R0-R5 on whole sheets: records with references to their tables."""
    recs = records(spark, sf_dir, DEEP_RULES, corpus_fn=workbook_corpus).filter("project_id = 'tpch'")
    return _records_out(recs).join(recs.select("project_id", "rule_no", F.coalesce("value_ref.hit_row", F.lit(0)).cast("bigint").alias("hit_row")),
                                   ["project_id", "rule_no"])


def sheet_values(spark, sf_dir):
    """The rows behind all references of the deep rules."""
    rules = compile_ruleset(DEEP_RULES)
    corpus = workbook_corpus(spark, sf_dir)
    around = spark.createDataFrame([(r.rule_no, r.before, r.after) for r in rules], "rule_no int, before int, after int")
    recs = RUN.run_ruleset(spark, corpus, DEEP_RULES).join(F.broadcast(around), "rule_no")  # one row a rule
    return RUN.sheet_values(corpus, recs).select(
        F.col("rule_no").cast("bigint").alias("rule_no"), "sheet", "row_no", "near", F.array_join("cells", " | ").alias("cells"))


def missing_fields(spark, sf_dir):
    """Names not found, per project, with their rule order."""
    r = records(spark, sf_dir)
    return r.filter(~F.col("found")).select("project_id", F.col("rule_no").cast("bigint").alias("rule_no"), "name")


FLAG_TEXT = "Not found in the documents."


def flagged_fields(spark, sf_dir):
    """P10: not found, or found with a note (defaults are flagged)."""
    r = records(spark, sf_dir)
    return r.filter(~F.col("found") | F.col("note").isNotNull()).select(
        "project_id", F.col("rule_no").cast("bigint").alias("rule_no"), "name",
        F.coalesce(F.col("note"), F.lit(FLAG_TEXT)).alias("text"))


def result_rows(spark, sf_dir):
    """T4 with the N9 preview."""
    r = records(spark, sf_dir)
    return r.select("project_id", F.col("rule_no").cast("bigint").alias("rule_no"), "name", "found",
                    "citation", "note",
                    preview(F.col("found"), F.col("kind"), F.col("value_text"),
                            F.coalesce(F.col("value_rows"), F.array("value_ref.head")),
                            F.col("value_blocks")).alias("preview"))


# ---------------------------------------------------------------------------
# reports, manifest, registry
# ---------------------------------------------------------------------------

from quarry.fixtures import CORPUS_TEMPLATE  # noqa: E402
from quarry.plans import report as REP  # noqa: E402

RUN_STAMP = "2026-01-01 00:00"


def template_order(spark, sf_dir):
    return REP.template_order(records(spark, sf_dir, materialize=True), CORPUS_TEMPLATE).select(
        "project_id", "sort_key", "item_type", "text",
        F.coalesce(F.col("rule_no"), F.lit(-1)).cast("bigint").alias("rule_no"))


def coverage(spark, sf_dir):
    pf = RUN.corpus_file_records(spark, flagship_corpus(spark, sf_dir), compile_ruleset(CORPUS_RULESET))
    return REP.coverage(pf, compile_ruleset(CORPUS_RULESET)).select(
        "project_id", "rule_type", F.coalesce(F.col("rule_no"), F.lit(-1)).cast("bigint").alias("rule_no"), "files_tried", "hits", "defaults", "misses", "level", "hit_rate")


def manifest_fields(spark, sf_dir):
    return REP.manifest_fields(records(spark, sf_dir)).withColumn("rule_no", F.col("rule_no").cast("bigint"))


def file_fingerprint(spark, sf_dir):
    """S5 over the texts of documents and pages (the files' bytes)."""
    d = C.read_table(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("label"),
        F.col("text").alias("content"))
    p = C.read_table(spark, sf_dir, "pages").select(
        C.page_host(F.col("url")).alias("project_id"), F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("label"),
        F.col("html").alias("content"))
    return REP.file_manifest(d.unionByName(p))


def run_warnings(spark, sf_dir):
    """The warnings of a run over the files of the unreadable language and all others."""
    return REP.run_warnings(unreadable_corpus(spark, sf_dir).all_files(), compile_ruleset(BETWEEN_RULES))


def files_register(spark, sf_dir):
    from quarry.sources.files import register
    return register(spark, sf_dir)


# Ticked labels: one of each kind of file, and one that no file has.
TICKED = ["doc_7.txt", "page_3.html", "conv_1.pptx", "no such file.txt"]


def choose_files(spark, sf_dir):
    """S3: the registered files whose labels are ticked."""
    from quarry.sources.files import choose, register
    return choose(register(spark, sf_dir), TICKED).select("project_id", "label", "size")


def table_markdown(spark, sf_dir):
    """Every table of every document and page as Markdown."""
    from quarry.functions.text import md_table
    files = C.documents_files(spark, sf_dir).unionByName(C.pages_files(spark, sf_dir))
    b = files.select("label", F.explode_outer("blocks").alias("b")).filter("b.kind = 'table'")
    return b.select("label", F.col("b.block_no").cast("bigint").alias("block_no"), md_table(F.col("b.rows")).alias("markdown"))


def safe_names(spark, sf_dir):
    """Page addresses and benchmark texts as file names."""
    from quarry.functions.text import safe_name
    p = C.read_table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").cast("bigint").alias("id"),
                                                    F.col("url").alias("given"))
    b = C.read_table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").cast("bigint").alias("id"),
                                                        F.col("text").alias("given"))
    return p.unionByName(b).select("kind", "id", safe_name(F.col("given")).alias("name"))


# Languages are the projects; the files of one language cannot be read.
UNREADABLE_LANG = "de"


def unreadable_corpus(spark, sf_dir) -> RUN.Corpus:
    files = C.documents_files(spark, sf_dir, project="lang").withColumn(
        "problem", F.when(F.col("project_id") == UNREADABLE_LANG, F.lit("damaged")).otherwise(F.col("problem")))
    return RUN.Corpus(files, [])


def unreadable_files(spark, sf_dir):
    """Records of a run in which all files of one project are unreadable."""
    recs = RUN.run_ruleset(spark, unreadable_corpus(spark, sf_dir), BETWEEN_RULES)
    return recs.select("project_id", F.col("rule_no").cast("bigint").alias("rule_no"), "name", "found", "citation", "note")


def pick_files(spark, sf_dir):
    """Every (project, rule, candidate file)."""
    corpus = flagship_corpus(spark, sf_dir)
    rules = compile_ruleset(CORPUS_RULESET)
    labels = corpus.files.select("project_id", "label")
    for wb in corpus.workbooks:
        labels = labels.unionByName(spark.range(1).select(F.lit(wb.project).alias("project_id"),
                                                          F.lit(wb.label).alias("label")))
    cands = F.array(*[F.struct(F.lit(r.rule_no).cast("bigint").alias("rule_no"),
                               RUN.candidate(r, F.col("label")).alias("cand")) for r in rules])
    return labels.select("project_id", "label", F.inline_outer(cands)).filter(F.col("cand")).drop("cand")


def enrich_additive(spark, sf_dir):
    """A suggestion from the labels table (document quality), joined
    to records; the extracted columns cannot change."""
    recs = records(spark, sf_dir, materialize=True)
    lab = C.read_table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_label"),
        F.concat(F.lit("quality="), F.col("quality").cast("string"), F.lit(" toxic="),
                 F.col("toxic").cast("string")).alias("suggestion"))
    sugg = recs.join(lab, "file_label").select("project_id", "rule_no", "suggestion")
    out = REP.enrich(recs, sugg)
    return out.select("project_id", F.col("rule_no").cast("bigint").alias("rule_no"), "name", "found",
                      "citation", "suggestion")


def _file_counts(spark, sf_dir):
    corpus = flagship_corpus(spark, sf_dir)
    counts = corpus.files.groupBy("project_id").agg(F.count("*").alias("n_files"))
    for wb in corpus.workbooks:
        counts = counts.unionByName(spark.range(1).select(F.lit(wb.project).alias("project_id"),
                                                          F.lit(1).cast("bigint").alias("n_files")))
    return counts


def report_markdown(spark, sf_dir):
    return REP.report_markdown(records(spark, sf_dir, materialize=True), CORPUS_TEMPLATE, RUN_STAMP, _file_counts(spark, sf_dir))


def report_json(spark, sf_dir):
    return REP.report_json(records(spark, sf_dir, materialize=True), CORPUS_TEMPLATE, RUN_STAMP, _file_counts(spark, sf_dir))


# A report over languages, one of which cannot be read: two fields in places of their own, one left over.
LANGUAGE_TEMPLATE = {"name": "Languages", "title": "Documents by language", "sections": [
    {"type": "heading", "text": "Spans"}, {"type": "field", "field": "span"}, {"type": "field", "field": "token"},
    {"type": "heading", "text": "Others"}, {"type": "field", "field": "no such field"}]}


def report_lines(spark, sf_dir):
    """Reports with all file names and warnings, as ordered lines."""
    corpus = unreadable_corpus(spark, sf_dir)
    recs = records(spark, sf_dir, BETWEEN_RULES, materialize=True, corpus_fn=unreadable_corpus)
    files = corpus.all_files()
    return REP.report_lines(recs, LANGUAGE_TEMPLATE, RUN_STAMP, files.select("project_id", "label"),
                            REP.run_warnings(files, compile_ruleset(BETWEEN_RULES)))


# ---------------------------------------------------------------------------
# merged cells (S9) and the rule lint
# ---------------------------------------------------------------------------

def merged_cells(spark, sf_dir):
    """S9 re-aimed: an order is a table row, its line items are the row's
    cells in line-number order and the supplier is the underlying cell; a
    repeated supplier is a merge duplicate. Keep the first occurrence,
    renumber the columns densely (skew-safe, see operators/merged.py)."""
    from quarry.operators.merged import dedupe_row_cells
    li = C.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return dedupe_row_cells(li, "l_orderkey", "l_linenumber", "l_suppkey").select(
        "l_orderkey", F.col("col_no").cast("bigint").alias("col_no"),
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_suppkey")


# Re-aimed kinds take the methods of the format they stand in for.
LINT_EXTS = {".txt": ".pdf", ".html": ".docx"}


def rule_lint(spark, sf_dir):
    """(project, rule, candidate file) where the rule's method is not
    one offered for the file's type. Advisory only: runs never enforce it."""
    from quarry.operators.compile import METHODS_BY_EXT
    table = dict(METHODS_BY_EXT)
    for e, like in LINT_EXTS.items():
        table[e] = table[like]
    methods = F.create_map(*[x for e, ms in table.items()
                             for x in (F.lit(e), F.array(*[F.lit(m) for m in ms]))])
    cands = pick_files(spark, sf_dir)
    rules = compile_ruleset(CORPUS_RULESET)
    types = F.create_map(*[x for r in rules for x in (F.lit(r.rule_no).cast("bigint"), F.lit(r.type))])
    ext = F.lower(F.regexp_extract("label", "(\\.[^.]*)$", 1))
    allowed = F.coalesce(methods[ext], F.array().cast("array<string>"))
    return cands.select("project_id", "rule_no", "label", ext.alias("ext"), types[F.col("rule_no")].alias("rule_type")) \
        .filter(~F.array_contains(allowed, F.col("rule_type")))


# Rules over web pages: heading locations (S8) reach the citations.
PAGE_RULES = _rs(
    {"name": "host", "type": "between", "match": "", "params": {"start": "©", "end": "·"}},
    {"name": "example", "type": "around_keywords", "match": "", "params": {"keyword": "example", "before": 1}},
    {"name": "nav table", "type": "table_contains", "match": "", "params": {"contains": "the"}},
    {"name": "after and", "type": "right_of", "match": "", "params": {"label": "and"}},
)


def pages_corpus(spark, sf_dir) -> RUN.Corpus:
    return RUN.Corpus(C.pages_files(spark, sf_dir), [])


def rules_pages(spark, sf_dir):
    return per_file(spark, sf_dir, PAGE_RULES, pages_corpus)
