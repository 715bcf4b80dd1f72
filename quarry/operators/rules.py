"""Extraction rules R0-R4 as column expressions over one file's blocks.

Every file is one row holding its ordered ``blocks`` (paragraphs and tables)
and ``units`` (paragraphs and single cells). A rule compiles into array
higher-order functions over those two columns, so all rules run in one
narrow pass over the corpus: no join, no shuffle, no per-row Python.
Block numbers are dense positions from 1, so a block is fetched with
``element_at`` and a span is one ``slice``.

Per-rule intermediates (first hit positions) are materialised as their own
columns before the result is built: Spark does not share subexpressions
inside lambda functions, and re-evaluating a hit search inside a lambda
would make a rule quadratic in the file's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.nfkc import nfkc_blocks
from quarry.sources.corpus import BLOCK_TYPE
from quarry.functions.text import (AFTER_LABEL_STRIP, WHITESPACE, after_label_regex, between_regex,
                                   needs_nfkc, normalize_py, normalize_tail, py_strip, sure_piece,
                                   table_flat_text)
from quarry.operators.compile import Rule

ROWS_T = "array<array<string>>"
VBLOCK_T = "array<struct<block_no:int,kind:string,text:string,rows:array<array<string>>>>"
# A table of a sheet without bound, by reference: its rows and columns, the row
# that was hit, whether rows without cells count, and the first row's texts.
REF_T = ("struct<sheet:string,sheet_ord:int,row_lo:bigint,row_hi:bigint,col_lo:int,col_hi:int,hit_row:bigint,"
         "fill:boolean,head:array<string>>")
RAW_T = (f"struct<kind:string,value_text:string,value_rows:{ROWS_T},"
         f"value_blocks:{VBLOCK_T},value_ref:{REF_T},location:string,note:string>")


# ---------------------------------------------------------------------------
# per-file preparation: units and normalised text, computed once for all rules
# ---------------------------------------------------------------------------

def _flat(x: Column) -> Column:
    return F.when(x["kind"] == "table", table_flat_text(x["rows"])).otherwise(x["text"])


def prepare(files: DataFrame) -> DataFrame:
    """Add ``flat``/``norm`` to every block and build ``units`` (paragraphs
    and single cells, in reading order) with their ``norm``.

    One projection chain over the file rows, so the corpus is read once.
    NFKC runs (Arrow-batched Python) only for files whose gate holds; all
    other files send a null through the UDF. Each paragraph, cell and table
    text is normalised exactly once; units take their norms from the
    blocks.
    """
    from_blocks = F.exists("blocks", lambda x: needs_nfkc(F.coalesce(x["text"], table_flat_text(x["rows"]))))
    given = F.col("nfkc") if "nfkc" in files.columns else F.lit(None).cast("boolean")
    files = files.withColumn("_kb", nfkc_blocks(F.col("blocks"), F.coalesce(given, from_blocks), BLOCK_TYPE))
    files = files.withColumn("blocks", F.zip_with("blocks", "_kb", lambda b, k: b
                                                  .withField("flat", _flat(b))
                                                  .withField("norm", normalize_tail(_flat(k)))
                                                  .withField("cnorm", F.when(k["kind"] == "table", F.transform(
                                                      k["rows"], lambda r: F.transform(r, normalize_tail)))))).drop("_kb")

    def cell_units(x):
        return F.flatten(F.transform(x["rows"], lambda r, ri: F.transform(
            r, lambda c, ci: F.struct(x["block_no"].alias("block_no"), (ri + 1).alias("row_no"),
                                      (ci + 1).alias("col_no"), F.lit("cell").alias("kind"), c.alias("text"),
                                      F.element_at(F.element_at(x["cnorm"], ri + 1), ci + 1).alias("norm")))))

    def para_unit(x):
        return F.array(F.struct(x["block_no"].alias("block_no"), F.lit(0).alias("row_no"),
                                F.lit(0).alias("col_no"), F.lit("paragraph").alias("kind"),
                                x["text"].alias("text"), x["norm"].alias("norm")))

    unit_t = "array<struct<block_no:int,row_no:int,col_no:int,kind:string,text:string,norm:string>>"
    files = files.withColumn("units", F.flatten(F.transform(
        "blocks", lambda x: F.when(x["kind"] == "table", cell_units(x).cast(unit_t))
        .otherwise(para_unit(x).cast(unit_t)))))
    files = files.withColumn("blocks", F.transform("blocks", lambda b: b.dropFields("cnorm")))
    return files.drop("nfkc") if "nfkc" in files.columns else files


# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------

def sql_str(v: str) -> str:
    """A Spark SQL string literal (backslash escapes)."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


_CONST: dict = {}


def const(sql: str) -> Column:
    """A constant expression parsed once per session (building columns one
    call at a time costs a JVM round trip each on the driver)."""
    from pyspark import SparkContext
    key = (id(SparkContext._active_spark_context), sql)
    col = _CONST.get(key)
    if col is None:
        col = _CONST[key] = F.expr(sql)
    return col


_FIELD_T = {"kind": "string", "value_text": "string", "value_rows": ROWS_T,
            "value_blocks": VBLOCK_T, "value_ref": REF_T, "location": "string", "note": "string"}


def raw_result(kind, value_text=None, value_rows=None, value_blocks=None, location=None, note=None) -> Column:
    vals = dict(kind=kind, value_text=value_text, value_rows=value_rows, value_blocks=value_blocks, value_ref=None,
                location=location, note=note)
    if not any(isinstance(v, Column) for v in vals.values()):
        return const("named_struct(" + ", ".join(
            f"'{k}', " + (f"CAST(NULL AS {_FIELD_T[k]})" if v is None else sql_str(v))
            for k, v in vals.items()) + ")")

    def c(k, v):
        if v is None:
            return const(f"CAST(NULL AS {_FIELD_T[k]})").alias(k)
        if isinstance(v, Column):
            return (v.cast(_FIELD_T[k]) if k in ("value_rows", "value_blocks") else v).alias(k)
        return F.lit(v).alias(k)
    return F.struct(*[c(k, v) for k, v in vals.items()])


def _miss(kind: str, note: str | None = None) -> Column:
    return raw_result(kind, note=note)


# ---------------------------------------------------------------------------
# rule builders: each returns (stage columns, raw result column)
#
# The expressions are written as Spark SQL (lambdas included) and parsed
# once on the JVM: building the same trees one Python Column call at a time
# costs thousands of driver round trips per rule set.
# ---------------------------------------------------------------------------

_WS = sql_str(WHITESPACE)


def _strip(x: str) -> str:
    return f"btrim({x}, {_WS})"


def _has(norm: str, needle: str) -> str:
    return f"contains({norm}, {sql_str(normalize_py(needle))})"


def _between_sql(text: str, start: str, end: str) -> str:
    return _strip(f"regexp_extract({text}, {sql_str(between_regex(start, end))}, 1)")


def _after_label_sql(text: str, label: str) -> str:
    cls = "[" + "".join("\\" + ch if ch in "\\]^-[&" else ch for ch in AFTER_LABEL_STRIP) + "]"
    tail = f"regexp_extract({text}, {sql_str(after_label_regex(label))}, 1)"
    return f"regexp_replace({tail}, {sql_str('^' + cls + '+|' + cls + '+' + chr(92) + 'z')}, '')"


def _raw(kind: str, value_text="NULL", value_rows="NULL", value_blocks="NULL", location="NULL",
         note: str | None = None) -> str:
    return (f"named_struct('kind', {sql_str(kind)}, 'value_text', CAST({value_text} AS STRING), "
            f"'value_rows', CAST({value_rows} AS {ROWS_T}), 'value_blocks', CAST({value_blocks} AS {VBLOCK_T}), "
            f"'value_ref', CAST(NULL AS {REF_T}), 'location', CAST({location} AS STRING), "
            f"'note', {sql_str(note) if note is not None else 'CAST(NULL AS STRING)'})")


def _vblocks_sql(arr: str) -> str:
    return (f"transform({arr}, vb -> named_struct('block_no', vb.block_no, 'kind', vb.kind, "
            f"'text', vb.text, 'rows', vb.rows))")


def _col(rule: Rule, what: str) -> str:
    return f"_r{rule.rule_no}_{what}"


def _stages(pairs):
    return [(name, F.expr(sql)) for name, sql in pairs]


def locate_sql(needle: str) -> str:
    """Location of the first block (paragraph text or table flat text)
    matching the anchor."""
    return f"try_element_at(filter(blocks, b -> {_has('b.norm', needle)}), 1).location"


def between(rule: Rule):
    """R1 = R1a inline, else R1b span, else R1c full text."""
    start, end = rule.p("start"), rule.p("end")
    if not start:
        return [], _miss("text")
    LOC, INL, S, E, FULL = (_col(rule, x) for x in ("loc", "inline", "s", "e", "full"))
    st = [(LOC, locate_sql(start))]
    # First unit holding both anchors with a non-empty text between them
    if end:
        st.append((INL, f"try_element_at(filter(transform(filter(units, u -> {_has('u.norm', start)} AND "
                        f"{_has('u.norm', end)}), u -> {_between_sql('u.text', start, end)}), v -> v != ''), 1)"))
        inline = INL
    else:
        inline = "CAST(NULL AS STRING)"
    # Paragraph matching start (excluded) .. next paragraph matching end
    st.append((S, f"try_element_at(filter(blocks, b -> b.kind = 'paragraph' AND {_has('b.norm', start)}), 1).block_no"))
    if end:
        st.append((E, f"try_element_at(filter(slice(blocks, coalesce({S}, size(blocks)) + 1, "
                      f"greatest(size(blocks) - coalesce({S}, size(blocks)), 0)), "
                      f"b -> b.kind = 'paragraph' AND {_has('b.norm', end)}), 1).block_no"))
        stop = f"coalesce({E}, size(blocks) + 1)"
    else:
        stop = "(size(blocks) + 1)"
    span = f"(CASE WHEN {S} IS NOT NULL THEN slice(blocks, {S} + 1, greatest({stop} - {S} - 1, 0)) END)"
    has_span = f"coalesce(size({span}) > 0, false)"
    # The whole file's text (N7), only for files where R1a and R1b miss
    # and some unit holds a piece of each anchor
    if end:
        pieces = [x for x in (sure_piece(start), sure_piece(end)) if x]
        gate = "".join(f" AND exists(units, u -> contains(u.norm, {sql_str(x)}))" for x in pieces)
        full = f"array_join(filter(transform(units, u -> u.text), x -> {_strip('x')} != ''), {sql_str(chr(10))})"
        st.append((FULL, f"CASE WHEN {inline} IS NULL AND NOT {has_span}{gate} "
                         f"THEN nullif({_between_sql(full, start, end)}, '') END"))
        fulltext = FULL
    else:
        fulltext = "CAST(NULL AS STRING)"
    result = (f"CASE WHEN {inline} IS NOT NULL THEN {_raw('text', value_text=inline, location=LOC)} "
              f"WHEN {has_span} THEN {_raw('block', value_blocks=_vblocks_sql(span), location=LOC)} "
              f"WHEN {fulltext} IS NOT NULL THEN {_raw('text', value_text=fulltext, location=LOC)} "
              f"ELSE {_raw('text')} END")
    return _stages(st), F.expr(result)


def right_of(rule: Rule):
    """R2: the first cell matching the label; value = next non-blank cell to
    its right, else the label cell's own tail, else "" (a miss; later
    matching cells are not tried)."""
    label = rule.p("label")
    if not label:
        return [], _miss("text")
    H = _col(rule, "hit")
    st = [(H, f"try_element_at(filter(units, u -> u.kind = 'cell' AND {_has('u.norm', label)}), 1)")]
    block = f"element_at(blocks, greatest({H}.block_no, 1))"
    row = f"element_at({block}.rows, greatest({H}.row_no, 1))"
    right = f"try_element_at(filter(slice({row}, {H}.col_no + 1, greatest(size({row}), 0)), c -> {_strip('c')} != ''), 1)"
    value = f"coalesce({_strip(right)}, nullif({_after_label_sql(H + '.text', label)}, ''), '')"
    result = (f"CASE WHEN {H} IS NOT NULL THEN {_raw('text', value_text=value, location=block + '.location')} "
              f"ELSE {_raw('text')} END")
    return _stages(st), F.expr(result)


def _first_table_sql(needle: str) -> str:
    return f"try_element_at(filter(blocks, b -> b.kind = 'table' AND {_has('b.norm', needle)}), 1)"


def around_keywords(rule: Rule):
    """The first table matching the keyword, whole (tables win even when
    later); else the first non-blank paragraph matching it with ``before``
    and ``after`` neighbours among non-blank paragraphs, clipped."""
    kw = rule.p("keyword")
    if not kw:
        return [], _miss("block")
    T, I = _col(rule, "tab"), _col(rule, "pi")
    st = [(T, _first_table_sql(kw)),
          (I, f"CASE WHEN size(_paras) > 0 THEN try_element_at(filter(sequence(1, size(_paras)), "
              f"i -> {_has('element_at(_paras, i).norm', kw)}), 1) END")]
    lo = f"greatest({I} - 1 - ({rule.before}), 0)"
    hi = f"least(size(_paras), {I} + ({rule.after}))"
    window = f"slice(_paras, {lo} + 1, greatest({hi} - {lo}, 0))"
    result = (f"CASE WHEN {T} IS NOT NULL THEN {_raw('table', value_rows=T + '.rows', location=T + '.location')} "
              f"WHEN {I} IS NOT NULL THEN {_raw('block', value_blocks=_vblocks_sql(window), location=f'element_at(_paras, greatest({I}, 1)).location')} "
              f"ELSE {_raw('block')} END")
    return _stages(st), F.expr(result)


def table_contains(rule: Rule):
    """The first table whose flat text matches, whole."""
    needle = rule.p("contains")
    if not needle:
        return [], _miss("table")
    T = _col(rule, "tab")
    result = (f"CASE WHEN {T} IS NOT NULL THEN {_raw('table', value_rows=T + '.rows', location=T + '.location')} "
              f"ELSE {_raw('table')} END")
    return _stages([(T, _first_table_sql(needle))]), F.expr(result)


SHEET_ONLY_NOTE = "This rule only applies to spreadsheet files."


def sheet_cell_on_document(rule: Rule):
    """A sheet rule on a file that is not a workbook."""
    return [], _miss("text", SHEET_ONLY_NOTE)


BUILDERS = {
    "between": between,
    "right_of": right_of,
    "around_keywords": around_keywords,
    "table_contains": table_contains,
    "sheet_cell": sheet_cell_on_document,
}


def needs_paragraph_list(rules) -> bool:
    return any(r.type == "around_keywords" and r.error is None and r.p("keyword") for r in rules)


def with_paragraph_list(files: DataFrame) -> DataFrame:
    """Non-blank paragraphs in order (R3b counts neighbours among these)."""
    return files.withColumn("_paras", F.filter(
        "blocks", lambda b: (b["kind"] == "paragraph") & (py_strip(b["text"]) != "")))
