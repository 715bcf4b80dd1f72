"""Reports over the records: template order, coverage, manifest, JSON and
Markdown (T1-T4, P9-P13).

A project's records number one per rule, so grouping them into one report
row per project is bounded by the rule set. A project's file list is not
bounded (a project can hold a third of the corpus), so it never goes into a
report row: the one-row reports state the file count, the per-file fingerprints
are their own table (``file_manifest``), written partitioned by project, and
``report_lines`` gives a report of any length as ordered rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import md_table, render_value
from quarry.operators.compile import Rule
from quarry.plans.run import DEFAULT_NOTE

# Report wording.
DEFAULT_TITLE = "Extraction Summary"
NOT_FOUND = "NOT FOUND — please verify manually"
FLAG_TEXT = "Not found in the documents."
CHECK_INTRO = "Verify the following before relying on this summary:"

SECTION_T = "array<struct<section_no:int,type:string,text:string,field:string>>"
LEFTOVER_BASE = 1_000_000


def _sections(template: dict | None) -> Column:
    secs = (template or {}).get("sections", []) or []
    return F.array(*[F.struct(F.lit(i).alias("section_no"), F.lit(s.get("type")).cast("string").alias("type"),
                              F.lit(s.get("text", "")).cast("string").alias("text"),
                              F.lit(s.get("field")).cast("string").alias("field"))
                     for i, s in enumerate(secs)]).cast(SECTION_T) if secs else F.array().cast(SECTION_T)


def template_order(records: DataFrame, template: dict | None) -> DataFrame:
    """Headings pass through; a field section takes the record of that
    name (last rule wins on duplicate names); unknown fields are dropped;
    records whose name no section placed follow in rule order.

    Output: project_id, sort_key, item_type, text, rule_no."""
    by_name = records.groupBy("project_id", "name").agg(F.max("rule_no").alias("rule_no"))
    projects = records.select("project_id").distinct()
    secs = projects.select("project_id", F.inline_outer(_sections(template))).filter(F.col("section_no").isNotNull())
    heads = secs.filter(F.col("type") == "heading").select(
        "project_id", F.col("section_no").cast("bigint").alias("sort_key"), F.lit("heading").alias("item_type"),
        F.col("text"), F.lit(None).cast("int").alias("rule_no"))
    fields = secs.filter(F.col("type") != "heading").join(
        by_name, (secs.project_id == by_name.project_id) & (secs.field == by_name.name)).select(
        secs.project_id, F.col("section_no").cast("bigint").alias("sort_key"), F.lit("field").alias("item_type"),
        F.col("name").alias("text"), by_name.rule_no)
    used = fields.select("project_id", F.col("text").alias("name")).distinct()
    rest = records.join(used, ["project_id", "name"], "left_anti").select(
        "project_id", (F.lit(LEFTOVER_BASE) + F.col("rule_no")).cast("bigint").alias("sort_key"),
        F.lit("field").alias("item_type"), F.col("name").alias("text"), "rule_no")
    return heads.unionByName(fields).unionByName(rest)


def coverage(per_file: DataFrame, rules: list[Rule]) -> DataFrame:
    """Readable candidate files tried, real hits, defaults used, misses
    and the share of files with a real hit, per project and rule, with
    subtotals per project and rule type, per project, per type and overall: grouping sets of
    one aggregate. ``level`` is the grouping id of (project, type, rule): 0, 1, 3, 5, 7."""
    r = F.col("rec")
    types = F.create_map(*[F.lit(x) for rule in rules for x in (rule.rule_no, rule.type)])
    pf = per_file.filter(r.isNotNull()).select(
        "project_id", types[F.col("rule_no")].alias("rule_type"), "rule_no", r["found"].alias("found"),
        (r["found"] & (F.coalesce(r["note"], F.lit("")) == DEFAULT_NOTE)).alias("is_default"))
    keys = [F.col(c) for c in ("project_id", "rule_type", "rule_no")]
    project, rtype, _ = keys
    return pf.groupingSets([keys, [project, rtype], [project], [rtype], []], *keys).agg(
        F.count("*").alias("files_tried"),
        F.count_if(F.col("found") & ~F.col("is_default")).alias("hits"),
        F.count_if("is_default").alias("defaults"),
        F.count_if(~F.col("found")).alias("misses"),
        F.grouping_id().cast("bigint").alias("level")) \
        .withColumn("hit_rate", F.col("hits") / F.col("files_tried"))


def manifest_fields(records: DataFrame) -> DataFrame:
    """P11, the per-field part: name, rule type, found flag, citation."""
    return records.select("project_id", "rule_no", "name", F.col("rule_type").alias("rule"), "found", "citation")


def file_manifest(files: DataFrame, content_col: str = "content") -> DataFrame:
    """P11/S5, the per-file part: SHA-256 of each file's bytes."""
    return files.select("project_id", "label", F.sha2(F.col(content_col), 256).alias("sha256"))


def run_warnings(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """P11, the warnings: project_id, label, warning of every file that some
    rule's filter picks and that cannot be read. A table of its own, as a project may have any number of files."""
    from quarry.plans.run import candidate
    picked = F.lit(False)
    for r in rules:
        picked = picked | candidate(r, F.col("label"))
    return files.filter(F.col("problem").isNotNull() & picked).select(
        "project_id", "label", F.concat("label", F.lit(": "), "problem").alias("warning"))


def manifest_json(records: DataFrame, ruleset: dict, template: dict | None, run_stamp: str,
                  enrichment: str = "none") -> DataFrame:
    """P11 as one JSON document per project (fields in rule order)."""
    fields = F.transform(F.array_sort(F.collect_list(F.struct(
        "rule_no", "name", F.col("rule_type").alias("rule"), "found", "citation"))),
        lambda x: x.dropFields("rule_no"))
    return records.groupBy("project_id").agg(fields.alias("fields")).select(
        "project_id", F.to_json(F.struct(
            F.lit(run_stamp).alias("generated"), F.lit(ruleset.get("name")).alias("ruleset"),
            F.lit((template or {}).get("name")).cast("string").alias("template"),
            F.lit(enrichment).alias("enrichment"), F.col("fields")),
            {"ignoreNullFields": "false"}).alias("manifest"))


def enrich(records: DataFrame, suggestions: DataFrame | None) -> DataFrame:
    """An enrichment step may only add a ``suggestion`` (joined on
    project and rule); the extracted columns are re-selected from the
    records so nothing it returns can overwrite them."""
    cols = records.columns
    if suggestions is None:
        return records.withColumn("suggestion", F.lit(None).cast("string"))
    s = suggestions.select("project_id", "rule_no", F.col("suggestion").cast("string"))
    return records.join(s, ["project_id", "rule_no"], "left").select(*[records[c] for c in cols], s.suggestion)


def _value_lines(kind: Column, value_text: Column, value_rows: Column, value_blocks: Column) -> Column:
    blocks = F.flatten(F.transform(value_blocks, lambda b: F.array(
        F.when(b["kind"] == "table", md_table(b["rows"])).otherwise(b["text"]), F.lit(""))))
    return (F.when(kind == "text", F.array(value_text, F.lit("")))
            .when(kind == "table", F.array(md_table(value_rows), F.lit("")))
            .otherwise(blocks))


def report_markdown(records: DataFrame, template: dict | None, run_stamp: str,
                    file_counts: DataFrame) -> DataFrame:
    """One Markdown document per project."""
    title = (template or {}).get("title", DEFAULT_TITLE)
    order = template_order(records, template)
    rec = records.select("project_id", "rule_no", "name", "found", "note", "citation", "kind",
                         "value_text", "value_rows", "value_blocks")
    items = order.join(rec.drop("name"), ["project_id", "rule_no"], "left")
    field_lines = F.concat(
        F.array(F.concat(F.lit("### "), F.col("text")), F.lit("")),
        F.when(~F.col("found"), F.array(F.concat(F.lit("**"), F.coalesce(F.col("note"), F.lit(NOT_FOUND)),
                                                 F.lit("**")), F.lit("")))
         .otherwise(F.concat(_value_lines(F.col("kind"), F.col("value_text"), F.col("value_rows"),
                                          F.col("value_blocks")),
                             F.when(F.col("note").isNotNull(),
                                    F.array(F.concat(F.lit("*Note: "), F.col("note"), F.lit("*")), F.lit("")))
                             .otherwise(F.array().cast("array<string>")))),
        F.array(F.concat(F.lit("`Source: "), F.col("citation"), F.lit("`")), F.lit("")))
    lines = F.when(F.col("item_type") == "heading", F.array(F.concat(F.lit("## "), F.col("text")), F.lit(""))) \
        .otherwise(field_lines)
    body = items.groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("sort_key", lines.alias("lines")))).alias("items"))
    flags = records.filter(~F.col("found") | F.col("note").isNotNull()).groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("rule_no", F.concat(
            F.lit("> - **"), F.col("name"), F.lit("**: "), F.coalesce(F.col("note"), F.lit(FLAG_TEXT)))
            .alias("line")))).alias("flags"))
    doc = body.join(flags, "project_id", "left").join(file_counts, "project_id", "left")
    check = F.when(F.size(F.coalesce(F.col("flags"), F.array())) > 0, F.concat(
        F.array(F.lit("> **Things to check**"), F.lit(">"), F.lit("> " + CHECK_INTRO), F.lit(">")),
        F.transform("flags", lambda x: x["line"]), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.lit(f"# {title}"), F.lit(""), F.lit(f"*Generated {run_stamp}*  "),
                   F.concat(F.lit("*Source files: "), F.coalesce(F.col("n_files"), F.lit(0)).cast("string"),
                            F.lit(" (listed in the file manifest)*")), F.lit(""))
    text = F.array_join(F.concat(head, check, F.flatten(F.transform("items", lambda x: x["lines"]))), "\n")
    return doc.select("project_id", text.alias("markdown"))


def report_json(records: DataFrame, template: dict | None, run_stamp: str, file_counts: DataFrame) -> DataFrame:
    """One JSON document per project; fields in rule order; the value is
    null, a string, {type: table, rows} or a list of blocks."""
    title = (template or {}).get("title", DEFAULT_TITLE)
    blocks_json = F.to_json(F.transform("value_blocks", lambda b: F.when(
        b["kind"] == "table", F.struct(F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"),
                                       b["rows"].alias("rows")))
        .otherwise(F.struct(F.lit("paragraph").alias("type"), b["text"].alias("text"),
                            F.lit(None).cast("array<array<string>>").alias("rows")))))
    value = (F.when(~F.col("found"), F.lit("null"))
             .when(F.col("kind") == "table", F.to_json(F.struct(F.lit("table").alias("type"),
                                                                F.col("value_rows").alias("rows"))))
             .otherwise(blocks_json))
    rec = records.select("project_id", "rule_no", "name", "found", "citation", "rule_type", "note",
                         F.when(F.col("found") & (F.col("kind") == "text"),
                                F.regexp_replace(F.to_json(F.array(F.col("value_text"))), "^\\[|\\]\\z", ""))
                         .otherwise(value).alias("value_json"))
    one = F.concat(
        F.lit("{"),
        F.regexp_replace(F.to_json(F.struct("name", "found"), {"ignoreNullFields": "false"}), "^\\{|\\}\\z", ""),
        F.lit(',"value":'), F.col("value_json"), F.lit(","),
        F.regexp_replace(F.to_json(F.struct("citation", F.col("rule_type").alias("rule"), "note"),
                                   {"ignoreNullFields": "false"}), "^\\{|\\}\\z", ""),
        F.lit("}"))
    grouped = rec.groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("rule_no", one.alias("j"), "found", "name"))).alias("fs"))
    doc = grouped.join(file_counts, "project_id", "left").select(
        "project_id", F.concat(
            F.lit("{"),
            F.regexp_replace(F.to_json(F.struct(F.lit(title).alias("title"), F.lit(run_stamp).alias("generated"),
                                                F.coalesce(F.col("n_files"), F.lit(0)).alias("source_files"))),
                             "^\\{|\\}\\z", ""),
            F.lit(',"fields":['), F.array_join(F.transform("fs", lambda x: x["j"]), ","), F.lit("],"),
            F.lit('"needs_checking":'),
            F.to_json(F.transform(F.filter("fs", lambda x: ~x["found"]), lambda x: x["name"])),
            F.lit("}")).alias("json"))
    return doc


# The parts of a report in order: title, files, warnings, things to check, fields.
PARTS = ("head", "file", "warning", "check", "item")


def report_lines(records: DataFrame, template: dict | None, run_stamp: str, files: DataFrame,
                 warnings: DataFrame) -> DataFrame:
    """T3/P11 as ordered lines: project_id, part (its place in ``PARTS``), key,
    name, line. A project's lines are ordered by part, key and name, so nothing
    is gathered and a report may name any number of files and warnings. Values
    are lines of plain text (rows with ' | ' between cells).

    ``files`` has project_id and label, ``warnings`` project_id, label and
    warning. Only projects with records have a report; a null label is left out."""
    def rows(df: DataFrame, part: str, key: Column, name: Column, line: Column) -> DataFrame:
        return df.select("project_id", F.lit(PARTS.index(part)).cast("long").alias("part"), key.cast("long").alias("key"),
                         name.alias("name"), line.alias("line"))

    title, none = (template or {}).get("title", DEFAULT_TITLE), F.lit("")
    projects = records.select("project_id").distinct()
    head = projects.select("project_id", F.posexplode(F.array(
        F.lit(f"# {title}"), F.lit(""), F.lit(f"*Generated {run_stamp}*"), F.lit(""))).alias("k", "line"))
    known = projects.select(F.col("project_id").alias("__project"))

    def ours(df: DataFrame) -> DataFrame:
        return df.filter("label is not null").join(known, df["project_id"].eqNullSafe(known["__project"]), "left_semi")

    flags = records.filter(~F.col("found") | F.col("note").isNotNull())
    fields = records.select("project_id", "rule_no", "found", "note", "citation", render_value(
        F.col("kind"), F.col("value_text"), F.col("value_rows"), F.col("value_blocks")).alias("value"))
    order = template_order(records, template).withColumnRenamed("project_id", "__project").withColumnRenamed("rule_no", "__rule")
    items = order.join(fields, F.col("__project").eqNullSafe(F.col("project_id")) & (F.col("__rule") == F.col("rule_no")), "left")
    value = F.when(F.col("found"), F.coalesce("value", none)).otherwise(
        F.concat(F.lit("**"), F.coalesce("note", F.lit(NOT_FOUND)), F.lit("**")))
    field = F.array(F.concat(F.lit("### "), "text"), value,
                    F.when(F.col("found") & F.col("note").isNotNull(), F.concat(F.lit("*Note: "), "note", F.lit("*"))),
                    F.concat(F.lit("`Source: "), "citation", F.lit("`")))
    body = items.select(F.col("__project").alias("project_id"), "sort_key", F.posexplode(
        F.when(F.col("item_type") == "heading", F.array(F.concat(F.lit("## "), "text"))).otherwise(field)).alias("k", "line"))
    return (rows(head, "head", F.col("k"), none, F.col("line"))
            .unionByName(rows(ours(files), "file", F.lit(0), F.col("label"), F.concat(F.lit("- "), "label")))
            .unionByName(rows(ours(warnings), "warning", F.lit(0), F.col("label"), F.concat(F.lit("- Warning: "), "warning")))
            .unionByName(rows(flags, "check", F.col("rule_no"), F.col("name"), F.concat(
                F.lit("> - **"), "name", F.lit("**: "), F.coalesce("note", F.lit(FLAG_TEXT)))))
            .unionByName(rows(body.filter("line is not null"), "item", F.col("sort_key") * 4 + F.col("k"), none, F.col("line"))))


def write_report_lines(lines: DataFrame, path: str) -> None:
    """Sink: the lines of each project in order under ``path/project_id=<id>/``.
    A range partition is a task, and a project that spans several has several
    files, whose names are in order; so a report of any length is written by many tasks."""
    keys = ["project_id", "part", "key", "name"]
    (lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("project_id", F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy("project_id").text(path))


def write_reports(reports: DataFrame, column: str, path: str) -> None:
    """Sink: one text file per project under ``path/project_id=<id>/``."""
    (reports.select("project_id", column).repartition("project_id")
     .write.mode("overwrite").partitionBy("project_id").text(path))
