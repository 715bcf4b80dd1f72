"""DuckDB SQL for the correctness check of the registered queries.

The Spark plans build each file's blocks inside its row with array
functions; the SQL here derives the same tables the relational way
(unnest, window, group by), so the two agree only if both are right. DuckDB
has no NFKC; no driver text changes under NFKC (checked), so the oracle
skips that step. RE2 gets the same anchor patterns with its own flag
syntax.
"""

from __future__ import annotations

from quarry.functions.text import (AFTER_LABEL_STRIP, NORMALISE_DASHES,
                                   NORMALISE_DOUBLE_QUOTES, NORMALISE_SINGLE_QUOTES,
                                   NORMALISE_SPACES, WS, loose_pattern, normalize_py)
from quarry.operators.compile import compile_ruleset

NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    s = f"coalesce({x}, '')"
    for chars, to in ((NORMALISE_DASHES, "-"), (NORMALISE_SINGLE_QUOTES, "'"),
                      (NORMALISE_DOUBLE_QUOTES, '"'), (NORMALISE_SPACES, " ")):
        s = f"translate({s}, {q(chars)}, {q(to * len(chars))})"
    s = f"lower({s})"
    s = f"regexp_replace({s}, '{WS}+$', '')"
    s = f"regexp_replace({s}, '\\*$', '')"
    s = f"regexp_replace({s}, '{WS}+', ' ', 'g')"
    return f"trim({s})"


def render_rows(rows: str) -> str:
    return f"array_to_string(list_transform({rows}, lambda r: array_to_string(r, ' | ')), {NL})"


def render_block(kind: str, text: str, rows: str) -> str:
    return f"CASE WHEN {kind} = 'table' THEN {render_rows(rows)} ELSE {text} END"


def preview_block(kind: str, text: str, rows: str) -> str:
    return f"CASE WHEN {kind} = 'table' THEN '[table ' || len({rows}) || ' rows]' ELSE {text} END"


def first_row_text(rows: str) -> str:
    return f"coalesce(array_to_string({rows}[1], ' / '), '')"


def preview_sql(pv: str) -> str:
    """Whitespace collapsed and stripped, cut at 160 characters with '…'."""
    s = strip_ws(f"regexp_replace({pv}, '{WS}+', ' ', 'g')")
    return f"CASE WHEN length({s}) > 160 THEN substr({s}, 1, 160) || '…' ELSE {s} END"


# ---------------------------------------------------------------------------
# block tables
# ---------------------------------------------------------------------------

DOC_BLOCKS = f"""
doc_lines AS (
  SELECT d.source AS project_id, 'doc_' || d.doc_id || '.txt' AS label,
         unnest(string_split(coalesce(d.text, ''), {NL})) AS line,
         unnest(generate_series(1, len(string_split(coalesce(d.text, ''), {NL})))) AS line_no
  FROM documents d),
doc_flags AS (
  SELECT *, contains(line, ' | ') AS is_row,
         coalesce(lag(contains(line, ' | ')) OVER (PARTITION BY label ORDER BY line_no), false) AS prev_row
  FROM doc_lines),
doc_groups AS (
  SELECT *, sum(CASE WHEN is_row AND prev_row THEN 0 ELSE 1 END)
              OVER (PARTITION BY label ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g
  FROM doc_flags),
doc_b0 AS (
  SELECT project_id, label, g, min(line_no) AS first_line, bool_or(is_row) AS is_table,
         list(line ORDER BY line_no) AS blines
  FROM doc_groups GROUP BY project_id, label, g),
doc_b1 AS (
  SELECT project_id, label, first_line,
         CASE WHEN is_table THEN 'table' ELSE 'paragraph' END AS kind,
         CASE WHEN is_table THEN NULL ELSE {strip_ws('blines[1]')} END AS text,
         CASE WHEN is_table THEN list_transform(blines, lambda l: list_transform(string_split(l, '|'),
              lambda c: {strip_ws('c')})) END AS rows,
         'line ' || first_line AS location
  FROM doc_b0),
doc_blocks AS (
  SELECT project_id, label, kind, text, rows, location,
         row_number() OVER (PARTITION BY label ORDER BY first_line) AS block_no
  FROM doc_b1 WHERE kind = 'table' OR text <> '')"""

CONV_BLOCKS = f"""
conv_lines AS (
  SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), {NL})) AS line,
         unnest(generate_series(1, len(string_split(coalesce(text, ''), {NL})))) AS sub
  FROM conversations WHERE role <> 'system'),
conv_b0 AS (
  SELECT conv_id, turn, sub, {strip_ws('line')} AS text, 'Slide ' || (turn + 1) AS location
  FROM conv_lines WHERE {strip_ws('line')} <> ''
  UNION ALL
  SELECT conv_id, turn, 0, {strip_ws("coalesce(text, '')")}, 'Slide ' || (turn + 1) || ' (notes)'
  FROM conversations WHERE role = 'system' AND {strip_ws("coalesce(text, '')")} <> ''),
conv_blocks AS (
  SELECT 'conversations' AS project_id, 'conv_' || conv_id || '.pptx' AS label, 'paragraph' AS kind,
         text, CAST(NULL AS VARCHAR[][]) AS rows, location,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub) AS block_no
  FROM conv_b0)"""

# The relational workbook's sheets (tab order), keys and
# column types, as in the driver tables.
TPCH_SHEETS = [
    ("region", "r_regionkey", [("r_regionkey", "i"), ("r_name", "s")]),
    ("nation", "n_nationkey", [("n_nationkey", "i"), ("n_name", "s"), ("n_regionkey", "i")]),
    ("supplier", "s_suppkey", [("s_suppkey", "i"), ("s_name", "s"), ("s_nationkey", "i"), ("s_acctbal", "d")]),
    ("customer", "c_custkey", [("c_custkey", "i"), ("c_name", "s"), ("c_nationkey", "i"),
                               ("c_acctbal", "d"), ("c_mktsegment", "s")]),
    ("part", "p_partkey", [("p_partkey", "i"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"),
                           ("p_size", "i"), ("p_retailprice", "d")]),
    ("orders", "o_orderkey", [("o_orderkey", "i"), ("o_custkey", "i"), ("o_orderstatus", "s"),
                              ("o_totalprice", "d"), ("o_orderdate", "t"), ("o_orderpriority", "s")]),
]


def cell_sql(col: str, t: str) -> str:
    if t == "d":
        return f"CAST(CAST({col} AS DECIMAL(18,2)) AS VARCHAR)"
    if t == "t":
        return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({col} AS VARCHAR)"


def sheet_rows_sql() -> str:
    parts = []
    for i, (name, key, cols) in enumerate(TPCH_SHEETS):
        header = "[" + ", ".join(q(c) for c, _ in cols) + "]"
        parts.append(f"SELECT {i} AS sheet_ord, {q(name)} AS sheet, CAST(1 AS BIGINT) AS row_no, {header} AS cells")
        cells = "[" + ", ".join(f"coalesce({cell_sql(c, t)}, '')" for c, t in cols) + "]"
        parts.append(f"SELECT {i}, {q(name)}, CAST({key} + 2 AS BIGINT), {cells} FROM {name}")
    return "\nUNION ALL\n".join(parts)


def norm_mid(x: str) -> str:
    """N1 without the star at the end."""
    s = x
    for chars, to in ((NORMALISE_DASHES, "-"), (NORMALISE_SINGLE_QUOTES, "'"),
                      (NORMALISE_DOUBLE_QUOTES, '"'), (NORMALISE_SPACES, " ")):
        s = f"translate({s}, {q(chars)}, {q(to * len(chars))})"
    return f"trim(regexp_replace(lower({s}), '{WS}+', ' ', 'g'))"


# The sheets in long form: rows with their text and the next row's, and cells.
WB_ROWS = f"""
wb_rows AS ({sheet_rows_sql()}),
wb_flat AS (SELECT *, {norm_mid("array_to_string(cells, ' ')")} AS flat FROM wb_rows),
wb_next AS (SELECT *, lead(flat) OVER (PARTITION BY sheet_ord ORDER BY row_no) AS nxt FROM wb_flat),
wb_ends AS (SELECT sheet_ord, max(row_no) AS n FROM wb_rows GROUP BY sheet_ord),
wb_cells0 AS (SELECT sheet_ord, sheet, row_no, cells, unnest(cells) AS text, unnest(generate_series(1, len(cells))) AS col_no FROM wb_rows),
wb_cells AS (SELECT *, {norm('text')} AS norm FROM wb_cells0)"""


def blocks_ctes(collections=("doc", "conv", "wb")) -> str:
    parts, unions = [], []
    if "doc" in collections:
        parts.append(DOC_BLOCKS)
        unions.append("SELECT project_id, label, block_no, kind, text, rows, location FROM doc_blocks")
    if "conv" in collections:
        parts.append(CONV_BLOCKS)
        unions.append("SELECT project_id, label, block_no, kind, text, rows, location FROM conv_blocks")
    if "wb" in collections:
        parts.append(WB_ROWS)
    if "page" in collections:
        parts.append(page_ctes())
        unions.append("SELECT project_id, label, block_no, kind, text, rows, location FROM page_blocks")
    files = []
    if "doc" in collections:
        files.append("SELECT source AS project_id, 'doc_' || doc_id || '.txt' AS label, "
                     "CASE WHEN text IS NULL THEN 'Could not read this file: no content.' END AS problem, "
                     "'.txt' AS ext FROM documents")
    if "conv" in collections:
        files.append("SELECT DISTINCT 'conversations', 'conv_' || conv_id || '.pptx', "
                     "CAST(NULL AS VARCHAR), '.pptx' FROM conversations")
    if "wb" in collections:
        files.append("SELECT 'tpch', 'tpch.xlsx', CAST(NULL AS VARCHAR), '.xlsx'")
    if "page" in collections:
        files.append("SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1) AS project_id, "
                     "'page_' || page_id || '.html' AS label, "
                     "CASE WHEN html IS NULL THEN 'Could not read this file: no content.' END AS problem, "
                     "'.html' AS ext FROM pages")
    flat = f"CASE WHEN kind = 'table' THEN array_to_string(flatten(rows), ' ') ELSE text END"
    return ",".join(parts) + f""",
all_blocks0 AS ({' UNION ALL '.join(unions)}),
B AS (SELECT *, {flat} AS flat, {norm(flat)} AS norm FROM all_blocks0),
U0 AS (
  SELECT project_id, label, block_no, 0 AS row_no, 0 AS col_no, 'paragraph' AS kind, text
  FROM B WHERE kind = 'paragraph'
  UNION ALL
  SELECT project_id, label, block_no, row_no, unnest(generate_series(1, len(r))) AS col_no, 'cell', unnest(r)
  FROM (SELECT project_id, label, block_no, unnest(rows) AS r,
               unnest(generate_series(1, len(rows))) AS row_no FROM B WHERE kind = 'table')),
U AS (SELECT *, {norm('text')} AS norm FROM U0),
FILES AS ({' UNION ALL '.join(files)})"""


# ---------------------------------------------------------------------------
# rules
# ---------------------------------------------------------------------------

def re2(pattern_body: str, flags: str) -> str:
    return q(f"(?{flags})" + pattern_body)


def between_pattern(start: str, end: str) -> str:
    return re2(loose_pattern(start) + "(.*?)" + loose_pattern(end), "is")


def cand_sql(rule, label="f.label") -> str:
    if not rule.match_key:
        return "true"
    return f"contains(lower({label}), {q(rule.match_key)})"


def first_row(sql: str, order: str) -> str:
    return (f"SELECT * EXCLUDE (rn__) FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {order}) "
            f"AS rn__ FROM ({sql})) WHERE rn__ = 1")


def rule_raw_sql(rule, collections=("doc", "conv", "wb"), range_values: bool = False) -> str:
    """Per readable candidate file: label, kind, value, found, location, note, pv, value_ref, hit_row."""
    files = f"SELECT *, CAST(NULL AS VARCHAR) AS value_ref, CAST(NULL AS BIGINT) AS hit_row FROM ({file_raw_sql(rule)})"
    if "wb" not in collections or rule.match_key not in "tpch.xlsx":
        return files
    return f"{files} UNION ALL SELECT 'tpch', 'tpch.xlsx', kind, value, found, location, note, pv, value_ref, hit_row FROM ({wb_raw_sql(rule, range_values)})"


def letters(n: int) -> str:
    from quarry.functions.text import column_letters_py
    return column_letters_py(n)


def phrase_hit_sql(needle: str) -> str:
    """The first row (sheet_ord, sheet, row_no) that holds a phrase, alone or with the start of the next row."""
    p = normalize_py(needle)
    test = f"contains(flat, {q(p)})"
    for i, ch in enumerate(p):
        if ch == " ":
            test += f" OR (ends_with(flat, {q(p[:i])}) AND starts_with(nxt, {q(p[i + 1:])}))"
    return f"SELECT sheet_ord, sheet, row_no FROM wb_next WHERE {test} ORDER BY sheet_ord, row_no LIMIT 1"


def wb_raw_sql(rule, range_values: bool = False) -> str:
    """One row: what the rule gives on the workbook."""
    none = "CAST(NULL AS VARCHAR)"

    def miss(kind, note=None):
        return (f"SELECT {q(kind)} AS kind, {none} AS value, false AS found, {none} AS location, "
                f"{q(note) if note else none} AS note, {none} AS pv, {none} AS value_ref, CAST(NULL AS BIGINT) AS hit_row")

    if rule.error is not None:
        return miss("text", rule.error)
    t = rule.type
    if t == "sheet_cell":
        return wb_cell_sql(rule, range_values)
    if t == "between":
        start, end = rule.p("start"), rule.p("end")
        if not start or not end:
            return miss("text")
        v = strip_ws(f"regexp_extract(text, {between_pattern(start, end)}, 1)")
        hit = (f"SELECT {v} AS v FROM wb_cells WHERE contains(norm, {q(normalize_py(start))}) AND contains(norm, "
               f"{q(normalize_py(end))}) AND {v} <> '' ORDER BY sheet_ord, row_no, col_no LIMIT 1")
        return (f"SELECT 'text' AS kind, (SELECT v FROM ({hit})) AS value, (SELECT v FROM ({hit})) IS NOT NULL AS found, "
                f"CASE WHEN (SELECT v FROM ({hit})) IS NOT NULL THEN (SELECT sheet FROM ({phrase_hit_sql(start)})) END AS location, "
                f"{none} AS note, (SELECT v FROM ({hit})) AS pv, {none} AS value_ref, CAST(NULL AS BIGINT) AS hit_row")
    if t == "right_of":
        label = rule.p("label")
        if not label:
            return miss("text")
        strip_cls = "".join({"\t": "\\t", "\r": "\\r", "\n": "\\n"}.get(ch, ch) for ch in AFTER_LABEL_STRIP)
        same = (f"nullif(regexp_replace(regexp_extract(text, {re2(loose_pattern(label) + '((?s:.*))', 'i')}, 1), "
                f"'^[{strip_cls}]+|[{strip_cls}]+$', '', 'g'), '')")
        right = f"list_filter(list_slice(cells, col_no + 1, len(cells)), lambda c: {strip_ws('c')} <> '')[1]"
        hit = (f"SELECT sheet, coalesce({strip_ws(right)}, {same}, '') AS v FROM wb_cells WHERE contains(norm, {q(normalize_py(label))}) "
               f"ORDER BY sheet_ord, row_no, col_no LIMIT 1")
        return (f"SELECT 'text' AS kind, h.v AS value, coalesce(h.v <> '', false) AS found, h.sheet AS location, {none} AS note, "
                f"h.v AS pv, {none} AS value_ref, CAST(NULL AS BIGINT) AS hit_row FROM (SELECT 1) LEFT JOIN ({hit}) h ON true")
    key = "keyword" if t == "around_keywords" else "contains"
    kind = "block" if t == "around_keywords" else "table"
    if not rule.p(key):
        return miss(kind)
    width = "[" + ", ".join(q(letters(len(cols))) for _, _, cols in TPCH_SHEETS) + "]"
    head = "[" + ", ".join(q(" / ".join(c for c, _ in cols)) for _, _, cols in TPCH_SHEETS) + "]"
    return (f"SELECT CASE WHEN h.sheet IS NULL THEN {q(kind)} ELSE 'table' END AS kind, {none} AS value, h.sheet IS NOT NULL AS found, "
            f"h.sheet AS location, {none} AS note, {head}[h.sheet_ord + 1] AS pv, "
            f"h.sheet || '!A1:' || {width}[h.sheet_ord + 1] || e.n AS value_ref, h.row_no AS hit_row "
            f"FROM (SELECT 1) LEFT JOIN ({phrase_hit_sql(rule.p(key))}) h ON true LEFT JOIN wb_ends e ON e.sheet_ord = h.sheet_ord")


def rect_sql(rule):
    """(sheet_ord, first row, first column, last row or None for the sheet's, last column) of a range."""
    want = (rule.p("sheet") or "").strip().lower()
    o = next((i for i, s in enumerate(TPCH_SHEETS) if s[0] == want), None)
    if o is None or rule.sheet_ref[0] != "range":
        return None
    r1, c1, r2, c2 = rule.sheet_ref[1:]
    r1, r2 = (1, None) if r1 is None else (min(r1, r2), max(r1, r2))
    c1, c2 = (1, len(TPCH_SHEETS[o][2])) if c1 is None else (min(c1, c2), max(c1, c2))
    return o, r1, c1, r2, c2


def cell_value_sql(o: int, r: int, c: int) -> str:
    """A cell of a sheet's table itself, null where it is empty or not there."""
    name, key, cols = TPCH_SHEETS[o]
    if c > len(cols):
        return "CAST(NULL AS VARCHAR)"
    return q(cols[c - 1][0]) if r == 1 else f"(SELECT max({cell_sql(*cols[c - 1])}) FROM {name} WHERE {key} = {r - 2})"


def range_value_sql(o: int, r1: int, c1: int, r2: int, c2: int) -> str:
    """All rows of a range as one text; rows and cells that the sheet has not are blank."""
    cells = "[" + ", ".join(f"coalesce(w.cells[{c}], '')" for c in range(c1, c2 + 1)) + "]"
    return (f"(SELECT string_agg(array_to_string({cells}, ' | '), {NL} ORDER BY s.i, {cells}) "
            f"FROM (SELECT unnest(generate_series({r1}, {r2})) AS i) s "
            f"LEFT JOIN (SELECT * FROM wb_rows WHERE sheet_ord = {o}) w ON w.row_no = s.i)")


def wb_cell_sql(rule, range_values: bool = False) -> str:
    """R5 on the workbook; with ``range_values`` a range whose rows the rule names gives their texts."""
    name = rule.p("sheet")
    ref = (rule.params.get("cell", "") or "").strip()
    kind = "table" if ":" in ref else "text"
    want = (name or "").strip().lower()
    o = next((i for i, s in enumerate(TPCH_SHEETS) if s[0] == want), None)
    none = "CAST(NULL AS VARCHAR)"
    tail = f"{none} AS pv, {none} AS value_ref, CAST(NULL AS BIGINT) AS hit_row"
    if o is None:
        note = f"No tab named '{name}'. Tabs found: {', '.join(s[0] for s in TPCH_SHEETS)}."
        loc = q(f"{name}!{ref}") if kind == "table" else none
        return f"SELECT {q(kind)} AS kind, {none} AS value, false AS found, {loc} AS location, {q(note)} AS note, {tail}"
    loc = q(f"{name}!{ref}")
    if rule.sheet_ref[0] == "bad":
        return f"SELECT {q(kind)} AS kind, {none} AS value, false AS found, {loc} AS location, {q(rule.sheet_ref[1])} AS note, {tail}"
    if rule.sheet_ref[0] == "cell":
        r, c = rule.sheet_ref[1:]
        # an empty cell of a record is null, "" in the sheet's text: no driver table has one
        v = cell_value_sql(o, r, c) if range_values else f"(SELECT cells[{c}] FROM wb_rows WHERE sheet_ord = {o} AND row_no = {r})"
        note = (f"Cell {ref} on '{name}' is empty, or holds a formula whose result was never saved "
                f"by Excel. Open the workbook in Excel, let it recalculate, save, and retry.")
        return (f"SELECT 'text' AS kind, {v} AS value, coalesce({v} <> '', false) AS found, {loc} AS location, "
                f"CASE WHEN {v} IS NULL THEN {q(note)} END AS note, {v} AS pv, {none} AS value_ref, CAST(NULL AS BIGINT) AS hit_row")
    o, r1, c1, r2, c2 = rect_sql(rule)
    n = f"(SELECT n FROM wb_ends WHERE sheet_ord = {o})"
    cut = f"list_slice(cells, {c1}, {c2})"
    inside = f"FROM wb_rows WHERE sheet_ord = {o} AND row_no BETWEEN {r1} AND {r2 if r2 is not None else n}"
    ok = f"coalesce((SELECT bool_or(len(list_filter({cut}, lambda c: trim(c) <> '')) > 0) {inside}), false)"
    note = f"Range {ref} on '{name}' is empty, or holds formulas whose results were never saved by Excel."
    pv = f"(SELECT array_to_string({cut}, ' / ') {inside} AND row_no = {r1})"
    address = f"{q(f'{TPCH_SHEETS[o][0]}!{letters(c1)}{r1}:{letters(c2)}')} || {r2 if r2 is not None else n}"
    value = f"CASE WHEN {ok} THEN {range_value_sql(o, r1, c1, r2, c2)} END" if range_values and r2 is not None else none
    return (f"SELECT 'table' AS kind, {value} AS value, {ok} AS found, {loc} AS location, CASE WHEN NOT {ok} THEN {q(note)} END AS note, "
            f"{pv} AS pv, CASE WHEN {ok} THEN {address} END AS value_ref, CAST(NULL AS BIGINT) AS hit_row")


def file_raw_sql(rule) -> str:
    """What a rule gives on the files other than the workbook."""
    n = rule.rule_no
    base = f"SELECT f.project_id, f.label FROM FILES f WHERE f.problem IS NULL AND f.label <> 'tpch.xlsx' AND {cand_sql(rule)}"
    none = (f"SELECT project_id, label, 'text' AS kind, CAST(NULL AS VARCHAR) AS value, false AS found, "
            f"CAST(NULL AS VARCHAR) AS location, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS VARCHAR) AS pv "
            f"FROM ({base})")
    if rule.error is not None:
        return none.replace("CAST(NULL AS VARCHAR) AS note", f"{q(rule.error)} AS note")
    t = rule.type

    def miss(kind, note=None):
        s = none.replace("'text' AS kind", f"{q(kind)} AS kind")
        if note:
            s = s.replace("CAST(NULL AS VARCHAR) AS note", f"{q(note)} AS note")
        return s

    if t == "between":
        start, end = rule.p("start"), rule.p("end")
        if not start:
            return miss("text")
        ns = q(normalize_py(start))
        loc = f"(SELECT label, arg_min(location, block_no) AS loc FROM B WHERE contains(norm, {ns}) GROUP BY label)"
        if end:
            ne = q(normalize_py(end))
            pat = between_pattern(start, end)
            tb = strip_ws(f"regexp_extract(text, {pat}, 1)")
            inl = first_row(f"SELECT label, block_no, row_no, col_no, {tb} AS v FROM U "
                            f"WHERE contains(norm, {ns}) AND contains(norm, {ne}) AND {tb} <> ''",
                            "block_no, row_no, col_no")
            e_cte = (f"(SELECT b.label, min(b.block_no) AS e FROM B b JOIN s{n} s ON b.label = s.label "
                     f"AND b.block_no > s.s WHERE b.kind = 'paragraph' AND contains(b.norm, {ne}) GROUP BY b.label)")
            full = (f"(SELECT label, nullif({strip_ws(f'regexp_extract(string_agg(text, {NL} ORDER BY block_no, row_no, col_no), {pat}, 1)')}, '') AS v "
                    f"FROM U WHERE {strip_ws('text')} <> '' GROUP BY label)")
        else:
            inl = "SELECT CAST(NULL AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS v WHERE false"
            e_cte = "(SELECT CAST(NULL AS VARCHAR) AS label, CAST(NULL AS BIGINT) AS e WHERE false)"
            full = "(SELECT CAST(NULL AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS v WHERE false)"
        s_cte = (f"(SELECT label, min(block_no) AS s FROM B WHERE kind = 'paragraph' AND contains(norm, {ns}) "
                 f"GROUP BY label)")
        span = (f"(SELECT label, string_agg(rb, {NL} ORDER BY block_no) AS v, count(*) AS cnt, "
                f"string_agg(CASE WHEN k <= 3 THEN pb END, ' ' ORDER BY block_no) AS pv FROM ("
                f"SELECT b.label, b.block_no, {render_block('b.kind', 'b.text', 'b.rows')} AS rb, "
                f"{preview_block('b.kind', 'b.text', 'b.rows')} AS pb, "
                f"row_number() OVER (PARTITION BY b.label ORDER BY b.block_no) AS k "
                f"FROM B b JOIN s{n} s ON b.label = s.label LEFT JOIN e{n} e ON b.label = e.label "
                f"WHERE b.block_no > s.s AND (e.e IS NULL OR b.block_no < e.e)) GROUP BY label)")
        return f"""
WITH s{n} AS {s_cte}, e{n} AS {e_cte}
SELECT c.project_id, c.label,
  CASE WHEN inl.v IS NOT NULL THEN 'text' WHEN sp.cnt > 0 THEN 'block' ELSE 'text' END AS kind,
  CASE WHEN inl.v IS NOT NULL THEN inl.v WHEN sp.cnt > 0 THEN sp.v ELSE fu.v END AS value,
  (inl.v IS NOT NULL OR coalesce(sp.cnt, 0) > 0 OR fu.v IS NOT NULL) AS found,
  lo.loc AS location, CAST(NULL AS VARCHAR) AS note,
  CASE WHEN inl.v IS NOT NULL THEN inl.v WHEN sp.cnt > 0 THEN sp.pv ELSE fu.v END AS pv
FROM ({base}) c
LEFT JOIN ({inl}) inl ON inl.label = c.label
LEFT JOIN {span} sp ON sp.label = c.label
LEFT JOIN {full} fu ON fu.label = c.label
LEFT JOIN {loc} lo ON lo.label = c.label"""
    if t == "right_of":
        label = rule.p("label")
        if not label:
            return miss("text")
        nl_ = q(normalize_py(label))
        hit = first_row(f"SELECT label, block_no, row_no, col_no, text FROM U WHERE kind = 'cell' AND contains(norm, {nl_})",
                        "block_no, row_no, col_no")
        strip_cls = "".join({"\t": "\\t", "\r": "\\r", "\n": "\\n"}.get(ch, ch) for ch in AFTER_LABEL_STRIP)
        same = (f"nullif(regexp_replace(regexp_extract(h.text, {re2(loose_pattern(label) + '((?s:.*))', 'i')}, 1), "
                f"'^[{strip_cls}]+|[{strip_cls}]+$', '', 'g'), '')")
        row = "b.rows[h.row_no]"
        right = f"list_filter(list_slice({row}, h.col_no + 1, len({row})), lambda c: {strip_ws('c')} <> '')[1]"
        val = f"coalesce({strip_ws(right)}, {same}, '')"
        return f"""
SELECT c.project_id, c.label, 'text' AS kind,
  CASE WHEN h.label IS NOT NULL THEN {val} END AS value,
  coalesce({val} <> '', false) AS found, b.location AS location, CAST(NULL AS VARCHAR) AS note,
  CASE WHEN h.label IS NOT NULL THEN {val} END AS pv
FROM ({base}) c LEFT JOIN ({hit}) h ON h.label = c.label
LEFT JOIN B b ON b.label = h.label AND b.block_no = h.block_no"""
    if t in ("around_keywords", "table_contains"):
        key = "keyword" if t == "around_keywords" else "contains"
        kw = rule.p(key)
        if not kw:
            return miss("block" if t == "around_keywords" else "table")
        nk = q(normalize_py(kw))
        tab = first_row(f"SELECT label, block_no, rows, location FROM B WHERE kind = 'table' AND contains(norm, {nk})",
                        "block_no")
        if t == "table_contains":
            return f"""
SELECT c.project_id, c.label, 'table' AS kind, {render_rows('t.rows')} AS value,
  t.label IS NOT NULL AS found, t.location AS location, CAST(NULL AS VARCHAR) AS note,
  {first_row_text('t.rows')} AS pv
FROM ({base}) c LEFT JOIN ({tab}) t ON t.label = c.label"""
        paras = (f"SELECT label, block_no, text, location, norm, "
                 f"row_number() OVER (PARTITION BY label ORDER BY block_no) AS pi, "
                 f"count(*) OVER (PARTITION BY label) AS np "
                 f"FROM B WHERE kind = 'paragraph' AND {strip_ws('text')} <> ''")
        return f"""
WITH p{n} AS ({paras}),
h{n} AS (SELECT label, min(pi) AS i FROM p{n} WHERE contains(norm, {nk}) GROUP BY label),
w{n} AS (SELECT p.label, string_agg(p.text, {NL} ORDER BY p.pi) AS v, count(*) AS cnt,
         string_agg(CASE WHEN p.pi - 1 < greatest(h.i - 1 - ({rule.before}), 0) + 3 THEN p.text END, ' '
                    ORDER BY p.pi) AS pv
         FROM p{n} p JOIN h{n} h ON p.label = h.label
         WHERE p.pi - 1 >= greatest(h.i - 1 - ({rule.before}), 0) AND p.pi - 1 < h.i + ({rule.after})
         GROUP BY p.label),
hl{n} AS (SELECT p.label, p.location FROM p{n} p JOIN h{n} h ON p.label = h.label AND p.pi = h.i)
SELECT c.project_id, c.label,
  CASE WHEN t.label IS NOT NULL THEN 'table' ELSE 'block' END AS kind,
  CASE WHEN t.label IS NOT NULL THEN {render_rows('t.rows')} ELSE w.v END AS value,
  (t.label IS NOT NULL OR coalesce(w.cnt, 0) > 0) AS found,
  CASE WHEN t.label IS NOT NULL THEN t.location ELSE hl.location END AS location,
  CAST(NULL AS VARCHAR) AS note,
  CASE WHEN t.label IS NOT NULL THEN {first_row_text('t.rows')} ELSE w.pv END AS pv
FROM ({base}) c LEFT JOIN ({tab}) t ON t.label = c.label
LEFT JOIN w{n} w ON w.label = c.label LEFT JOIN hl{n} hl ON hl.label = c.label"""
    if t == "sheet_cell":
        return miss("text", "This rule only applies to spreadsheet files.")
    raise ValueError(t)


def per_file_sql(rule, collections=("doc", "conv", "wb"), range_values: bool = False) -> str:
    """P5-P8 on one rule's raw rows."""
    raw = rule_raw_sql(rule, collections, range_values)
    if rule.default and rule.error is None:
        return f"""
SELECT project_id, label, {rule.rule_no} AS rule_no,
  CASE WHEN found THEN kind ELSE 'text' END AS kind,
  CASE WHEN found THEN value ELSE {q(rule.default)} END AS value,
  true AS found,
  CASE WHEN NOT found THEN label || ' — not found, default used'
       WHEN location IS NOT NULL AND location <> '' THEN label || ' — ' || location ELSE label END AS citation,
  CASE WHEN found THEN note ELSE 'Nothing found; the rule''s default value was used.' END AS note,
  CASE WHEN found THEN location END AS location,
  CASE WHEN found THEN pv ELSE {q(rule.default)} END AS pv, value_ref, hit_row
FROM ({raw})"""
    return f"""
SELECT project_id, label, {rule.rule_no} AS rule_no, kind,
  CASE WHEN found THEN value END AS value, found,
  CASE WHEN found AND location IS NOT NULL AND location <> '' THEN label || ' — ' || location ELSE label END AS citation,
  note, location, CASE WHEN found THEN pv END AS pv, value_ref, hit_row
FROM ({raw})"""


def file_records_sql(ruleset: dict, collections=("doc", "conv", "wb"), range_values: bool = False) -> str:
    rules = compile_ruleset(ruleset)
    body = "\nUNION ALL\n".join(f"SELECT * FROM ({per_file_sql(r, collections, range_values)})" for r in rules)
    return f"WITH {blocks_ctes(collections)},\nPF AS ({body})"


def records_sql(ruleset: dict, collections=("doc", "conv", "wb"), given: str = "", files: str = "FILES",
                pf: str = "PF") -> str:
    """The records of a rule set: one per (project, rule). ``given`` defines
    the tables ``files`` and ``pf`` where they are not those of the corpus."""
    rules = compile_ruleset(ruleset)
    meta = " UNION ALL ".join(
        f"SELECT {r.rule_no} AS rule_no, {q(r.run_name)} AS run_name, {q(r.no_file_name)} AS no_file_name, "
        f"{q(r.raw_type) if r.raw_type is not None else 'CAST(NULL AS VARCHAR)'} AS raw_type, "
        f"{q(r.type)} AS rule_type, {q(r.match)} AS match, "
        f"{q(r.match_key)} AS match_key" for r in rules)
    return file_records_sql(ruleset, collections) + given + f""",
META AS ({meta}),
CANDS AS (SELECT f.project_id, m.rule_no, count(*) FILTER (WHERE m.match_key = '' OR contains(lower(f.label), m.match_key)) AS n_cand,
                 min(f.label) FILTER (WHERE m.match_key = '' OR contains(lower(f.label), m.match_key)) AS first_cand
          FROM {files} f, META m GROUP BY f.project_id, m.rule_no),
BEST AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, rule_no
          ORDER BY (NOT found), label) AS rn FROM {pf}) WHERE rn = 1),
RECORDS AS (
SELECT c.project_id, c.rule_no,
  CASE WHEN b.label IS NULL THEN m.no_file_name ELSE m.run_name END AS name,
  CASE WHEN b.label IS NULL THEN 'text' ELSE b.kind END AS kind,
  b.value AS value,
  CASE WHEN c.n_cand = 0 THEN '(no uploaded file matched ''' || m.match || ''')'
       WHEN b.label IS NULL THEN c.first_cand ELSE b.citation END AS citation,
  coalesce(b.found, false) AS found,
  CASE WHEN c.n_cand = 0 THEN 'No uploaded file name contains ''' || m.match || '''.'
       WHEN b.label IS NULL THEN 'The matching file could not be read.' ELSE b.note END AS note,
  CASE WHEN b.label IS NULL THEN m.raw_type ELSE m.rule_type END AS rule_type,
  b.label AS file_label, b.pv AS pv, b.value_ref AS value_ref, b.hit_row AS hit_row
FROM CANDS c JOIN META m ON m.rule_no = c.rule_no
LEFT JOIN BEST b ON b.project_id = c.project_id AND b.rule_no = c.rule_no)"""


# ---------------------------------------------------------------------------
# the registered queries
# ---------------------------------------------------------------------------

def _flat_blocks(cte: str, table: str) -> str:
    return f"""WITH {cte}
SELECT project_id, label, CAST(block_no AS BIGINT) AS block_no, kind, location,
  CASE WHEN kind = 'table' THEN array_to_string(flatten(rows), ' ') ELSE text END AS text,
  CAST(CASE WHEN kind = 'table' THEN len(rows) ELSE 0 END AS BIGINT) AS n_rows
FROM {table}"""


def anchor_hits_sql() -> str:
    from quarry.plans.queries import ANCHORS
    parts = [f"SELECT label, CAST({i} AS BIGINT) AS anchor_no, arg_min(location, block_no) AS first_location, "
             f"count(*) AS n_blocks FROM B WHERE contains(norm, {q(normalize_py(a))}) GROUP BY label"
             for i, a in enumerate(ANCHORS) if a]
    return f"WITH {blocks_ctes(('doc',))}\n" + "\nUNION ALL\n".join(parts)


def anchor_scan_sql() -> str:
    from quarry.plans.queries import MANY_ANCHORS
    return f"""WITH {blocks_ctes(('doc',))},
AW AS (SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n]+'), lambda x: x <> '') AS w FROM benchmark),
AR AS (SELECT item_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS a
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM AW)),
AF AS (SELECT a, row_number() OVER (ORDER BY k, i) - 1 AS anchor_no
       FROM (SELECT a, min(item_id) AS k, arg_min(i, (item_id, i)) AS i FROM AR WHERE a <> '' GROUP BY a)
       QUALIFY anchor_no < {MANY_ANCHORS}),
AN AS (SELECT CAST(anchor_no AS BIGINT) AS anchor_no, {norm('a')} AS needle FROM AF)
SELECT label, anchor_no, arg_min(location, block_no) AS first_location, count(*) AS n_blocks
FROM B JOIN AN ON contains(B.norm, AN.needle) GROUP BY label, anchor_no"""


def all_oracles() -> dict[str, str]:
    from quarry.fixtures import CORPUS_RULESET
    from quarry.plans import queries as Q
    rec = records_sql(CORPUS_RULESET)
    pf = ("\nSELECT project_id, label, CAST(rule_no AS BIGINT) AS rule_no, kind, value, value_ref, found, citation, note "
          "FROM PF")
    return {
        "blocks_text": _flat_blocks(DOC_BLOCKS, "doc_blocks"),
        "blocks_slides": _flat_blocks(CONV_BLOCKS, "conv_blocks"),
        "sheet_blocks": f"""WITH wb_rows AS ({sheet_rows_sql()})
SELECT 'tpch.xlsx' AS label, sheet, CAST(sheet_ord + 1 AS BIGINT) AS block_no, row_no,
  array_to_string(cells, ' | ') AS cells FROM wb_rows""",
        "normalize_units": f"""WITH {blocks_ctes(('doc',))}
SELECT label, CAST(block_no AS BIGINT) AS block_no, CAST(row_no AS BIGINT) AS row_no,
  CAST(col_no AS BIGINT) AS col_no, norm FROM U""",
        "anchor_hits": anchor_hits_sql(),
        "anchor_scan": anchor_scan_sql(),
        "rules_between": file_records_sql(Q.BETWEEN_RULES) + pf,
        "rules_right_of": file_records_sql(Q.RIGHT_OF_RULES) + pf,
        "rules_around": file_records_sql(Q.AROUND_RULES) + pf,
        "rules_table_contains": file_records_sql(Q.TABLE_RULES) + pf,
        "rules_sheet_cell": file_records_sql(Q.SHEET_RULES, range_values=True) + pf,
        "apply_ruleset": rec + """
SELECT project_id, CAST(rule_no AS BIGINT) AS rule_no, name, kind, found, citation, note, rule_type,
  file_label, value, value_ref FROM RECORDS""",
        "rules_sheets_deep": records_sql(Q.DEEP_RULES, ("doc", "wb")) + """
SELECT project_id, CAST(rule_no AS BIGINT) AS rule_no, name, kind, found, citation, note, rule_type,
  file_label, value, value_ref, coalesce(hit_row, 0) AS hit_row FROM RECORDS WHERE project_id = 'tpch'""",
        "sheet_values": sheet_values_sql(),
        "missing_fields": rec + """
SELECT project_id, CAST(rule_no AS BIGINT) AS rule_no, name FROM RECORDS WHERE NOT found""",
        "flagged_fields": rec + """
SELECT project_id, CAST(rule_no AS BIGINT) AS rule_no, name,
  coalesce(note, 'Not found in the documents.') AS text FROM RECORDS WHERE NOT found OR note IS NOT NULL""",
        **more_oracles(),
        "blocks_html": html_blocks_sql(),
        "merged_cells": merged_cells_sql(),
        "rule_lint": rule_lint_sql(),
        "rules_pages": file_records_sql(Q.PAGE_RULES, ("page",)) + pf,
        "sheet_grid": sheet_grid_sql(),
        "choose_files": choose_files_sql(),
        "table_markdown": table_markdown_sql(),
        "safe_names": SAFE_NAMES,
        "unreadable_files": unreadable_files_sql(),
        "sheet_rows_containing": sheet_rows_containing_sql(),
        "result_rows": result_rows_sql(),
    }


def more_oracles() -> dict[str, str]:
    from quarry.fixtures import CORPUS_RULESET, CORPUS_TEMPLATE
    from quarry.plans.report import LEFTOVER_BASE
    from quarry.sources.files import SUPPORTED
    rec = records_sql(CORPUS_RULESET)
    rules = compile_ruleset(CORPUS_RULESET)
    secs = (CORPUS_TEMPLATE.get("sections") or [])
    sec_rows = " UNION ALL ".join(
        f"SELECT {i} AS section_no, {q(s.get('type'))} AS type, {q(s.get('text', ''))} AS text, "
        f"{q(s['field']) if s.get('field') is not None else 'CAST(NULL AS VARCHAR)'} AS field"
        for i, s in enumerate(secs))
    supported = ", ".join(q(e) for e in SUPPORTED)
    unsupported = "'. Supported: " + ", ".join(SUPPORTED) + ".'"
    ext = "lower(regexp_extract(label, '(\\.[^./\\\\]*)$', 1))"
    problem = (f"CASE WHEN ext = '.doc' THEN 'legacy' WHEN ext NOT IN ({supported}) THEN "
               f"'Unsupported file type ''' || ext || {unsupported} END")
    cands = " UNION ALL ".join(
        f"SELECT project_id, CAST({r.rule_no} AS BIGINT) AS rule_no, label FROM FILES f WHERE {cand_sql(r)}"
        for r in rules)
    return {
        "template_order": rec + f""",
SECS AS ({sec_rows}),
BYNAME AS (SELECT project_id, name, max(rule_no) AS rule_no FROM RECORDS GROUP BY project_id, name),
PROJ AS (SELECT DISTINCT project_id FROM RECORDS),
HEADS AS (SELECT p.project_id, CAST(s.section_no AS BIGINT) AS sort_key, 'heading' AS item_type, s.text,
                 CAST(-1 AS BIGINT) AS rule_no FROM PROJ p, SECS s WHERE s.type = 'heading'),
FLDS AS (SELECT b.project_id, CAST(s.section_no AS BIGINT) AS sort_key, 'field' AS item_type, b.name AS text,
                CAST(b.rule_no AS BIGINT) AS rule_no
         FROM SECS s JOIN BYNAME b ON b.name = s.field WHERE s.type <> 'heading'),
USED AS (SELECT DISTINCT project_id, text AS name FROM FLDS),
REST AS (SELECT r.project_id, CAST({LEFTOVER_BASE} + r.rule_no AS BIGINT), 'field', r.name, CAST(r.rule_no AS BIGINT)
         FROM RECORDS r WHERE NOT EXISTS (SELECT 1 FROM USED u WHERE u.project_id = r.project_id AND u.name = r.name))
SELECT * FROM HEADS UNION ALL SELECT * FROM FLDS UNION ALL SELECT * FROM REST""",
        "coverage": file_records_sql(CORPUS_RULESET) + f"""
SELECT *, hits / files_tried AS hit_rate FROM (SELECT project_id, rule_type, CAST(coalesce(rule_no, -1) AS BIGINT) AS rule_no,
  count(*) AS files_tried,
  count(*) FILTER (WHERE found AND coalesce(note, '') <> 'Nothing found; the rule''s default value was used.') AS hits,
  count(*) FILTER (WHERE found AND coalesce(note, '') = 'Nothing found; the rule''s default value was used.') AS defaults,
  count(*) FILTER (WHERE NOT found) AS misses,
  CAST(GROUPING(project_id, rule_type, rule_no) AS BIGINT) AS level
FROM (SELECT *, CASE rule_no {' '.join(f"WHEN {r.rule_no} THEN {q(r.type)}" for r in rules)} END AS rule_type FROM PF)
GROUP BY GROUPING SETS ((project_id, rule_type, rule_no), (project_id, rule_type), (project_id), (rule_type), ()))""",
        "manifest_fields": rec + """
SELECT project_id, CAST(rule_no AS BIGINT) AS rule_no, name, rule_type AS rule, found, citation FROM RECORDS""",
        "file_fingerprint": """
SELECT source AS project_id, 'doc_' || doc_id || '.txt' AS label, sha256(text) AS sha256 FROM documents
UNION ALL
SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1), 'page_' || page_id || '.html', sha256(html) FROM pages""",
        "run_warnings": run_warnings_sql(),
        "report_lines": report_lines_sql(),
        "files_register": f"""
WITH F0 AS (
  SELECT source AS project_id, 'doc_' || doc_id || '.txt' AS label, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents
  UNION ALL
  SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1), 'page_' || page_id || '.html',
         CAST(octet_length(encode(html)) AS BIGINT) FROM pages
  UNION ALL
  SELECT 'conversations', 'conv_' || conv_id || '.pptx', CAST(sum(octet_length(encode(text))) AS BIGINT)
  FROM conversations GROUP BY conv_id),
F1 AS (SELECT *, {ext} AS ext FROM F0)
SELECT project_id, label, ext, size, ext IN ({supported}) AS supported, {problem} AS problem FROM F1""",
        "pick_files": f"WITH {blocks_ctes()}\n{cands}",
        "enrich_additive": rec + """
SELECT r.project_id, CAST(r.rule_no AS BIGINT) AS rule_no, r.name, r.found, r.citation,
  'quality=' || l.quality || ' toxic=' || l.toxic AS suggestion
FROM RECORDS r LEFT JOIN labels l ON r.file_label = 'doc_' || l.doc_id || '.txt'""",
    }


def choose_files_sql() -> str:
    from quarry.plans.queries import TICKED
    ticked = ", ".join(q(x) for x in TICKED)
    return f"SELECT project_id, label, size FROM ({more_oracles()['files_register']}) WHERE label IN ({ticked})"


def md_table(rows: str) -> str:
    """N11 as SQL."""
    def line(r: str) -> str:
        cell = f"replace(replace(c, '|', '\\|'), {NL}, ' ')"
        return f"'| ' || array_to_string(list_transform(list_resize({r}, w, ''), lambda c: {cell}), ' | ') || ' |'"

    return (f"array_to_string(list_concat([{line(rows + '[1]')}, '|' || repeat(' --- |', w)], "
            f"list_transform({rows}[2:], lambda r: {line('r')})), {NL})")


def table_markdown_sql() -> str:
    return f"""WITH {DOC_BLOCKS},{page_ctes()},
TABS AS (SELECT label, block_no, rows, greatest(1, list_max(list_transform(rows, lambda r: len(r)))) AS w FROM (
  SELECT label, block_no, rows, kind FROM doc_blocks UNION ALL SELECT label, block_no, rows, kind FROM page_blocks)
  WHERE kind = 'table')
SELECT label, CAST(block_no AS BIGINT) AS block_no, {md_table('rows')} AS markdown FROM TABS"""


SAFE_NAMES = """
SELECT kind, id, substr(coalesce(nullif(trim(regexp_replace(given, '[^A-Za-z0-9 _-]', '', 'g')), ''), 'untitled'), 1, 80) AS name
FROM (SELECT 'page' AS kind, CAST(page_id AS BIGINT) AS id, url AS given FROM pages
      UNION ALL SELECT 'item', CAST(item_id AS BIGINT), text FROM benchmark)"""


def run_warnings_sql() -> str:
    from quarry.plans.queries import BETWEEN_RULES, UNREADABLE_LANG
    picked = " OR ".join(cand_sql(r) for r in compile_ruleset(BETWEEN_RULES))
    return f"""
WITH FL AS (SELECT lang AS project_id, 'doc_' || doc_id || '.txt' AS label,
    CASE WHEN lang = {q(UNREADABLE_LANG)} THEN 'damaged' WHEN text IS NULL THEN 'Could not read this file: no content.' END AS problem
  FROM documents)
SELECT project_id, label, label || ': ' || problem AS warning FROM FL f WHERE problem IS NOT NULL AND ({picked})"""


def unreadable_records_sql() -> str:
    from quarry.plans.queries import BETWEEN_RULES, UNREADABLE_LANG
    given = f""",
FL AS (SELECT lang AS project_id, 'doc_' || doc_id || '.txt' AS label FROM documents),
PL AS (SELECT PF.* REPLACE (FL.project_id AS project_id) FROM PF JOIN FL ON FL.label = PF.label
       WHERE FL.project_id IS DISTINCT FROM {q(UNREADABLE_LANG)})"""
    return records_sql(BETWEEN_RULES, ("doc",), given, "FL", "PL")


def unreadable_files_sql() -> str:
    return unreadable_records_sql() + """
SELECT project_id, CAST(rule_no AS BIGINT) AS rule_no, name, found, citation, note FROM RECORDS"""


def report_lines_sql() -> str:
    from quarry.plans.queries import LANGUAGE_TEMPLATE, RUN_STAMP
    from quarry.plans.report import FLAG_TEXT, LEFTOVER_BASE, NOT_FOUND
    secs = ", ".join(f"({i}, {q(s['type'])}, {q(s.get('text') or s.get('field'))})"
                     for i, s in enumerate(LANGUAGE_TEMPLATE["sections"]))
    return unreadable_records_sql() + f""",
SECS(no, type, text) AS (VALUES {secs}),
PROJECTS AS (SELECT DISTINCT project_id FROM RECORDS),
PLACED AS (SELECT r.*, s.no AS place FROM SECS s JOIN RECORDS r ON s.type = 'field' AND s.text = r.name
           UNION ALL SELECT *, {LEFTOVER_BASE} + rule_no FROM RECORDS WHERE name NOT IN (SELECT text FROM SECS WHERE type = 'field')),
LINES AS (
SELECT project_id, 0 AS part, k AS key, '' AS name, line FROM PROJECTS,
  (VALUES (0, {q('# ' + LANGUAGE_TEMPLATE['title'])}), (1, ''), (2, {q(f'*Generated {RUN_STAMP}*')}), (3, '')) AS h(k, line)
UNION ALL SELECT project_id, 1, 0, label, '- ' || label FROM FL
UNION ALL SELECT project_id, 2, 0, label, '- Warning: ' || warning FROM ({run_warnings_sql()})
UNION ALL SELECT project_id, 3, rule_no, name, '> - **' || name || '**: ' || coalesce(note, {q(FLAG_TEXT)})
  FROM RECORDS WHERE NOT found OR note IS NOT NULL
UNION ALL SELECT project_id, 4, 4 * no, '', '## ' || text FROM SECS, PROJECTS WHERE type = 'heading'
UNION ALL SELECT project_id, 4, 4 * place, '', '### ' || name FROM PLACED
UNION ALL SELECT project_id, 4, 4 * place + 1, '', CASE WHEN found THEN coalesce(value, '')
    ELSE '**' || coalesce(note, {q(NOT_FOUND)}) || '**' END FROM PLACED
UNION ALL SELECT project_id, 4, 4 * place + 2, '', '*Note: ' || note || '*' FROM PLACED WHERE found AND note IS NOT NULL
UNION ALL SELECT project_id, 4, 4 * place + 3, '', '`Source: ' || citation || '`' FROM PLACED)
SELECT project_id, CAST(part AS BIGINT) AS part, CAST(key AS BIGINT) AS key, name, line FROM LINES WHERE line IS NOT NULL"""


def page_ctes() -> str:
    """Page blocks (S8) as CTEs ending in ``page_blocks``."""
    from quarry.sources.corpus import HTML_BLOCK_TAG, HTML_DROP, HTML_ENTITIES, HTML_OPENERS

    def html_text(x):
        t = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
        for ent, ch in HTML_ENTITIES:
            t = f"replace({t}, {q(ent)}, {q(ch)})"
        return t

    openers = ", ".join(q(t) for t in HTML_OPENERS)
    return f"""
pg_src AS (
  SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1) AS project_id,
         'page_' || page_id || '.html' AS label,
         regexp_replace(regexp_replace(coalesce(html, ''), {q(HTML_DROP)}, '', 'g'), {q(HTML_BLOCK_TAG)},
                        chr(1) || '\\1\\2' || chr(2), 'g') AS marked
  FROM pages),
pg_pieces AS (
  SELECT project_id, label, unnest(string_split(marked, chr(1))) AS piece,
         unnest(generate_series(1, len(string_split(marked, chr(1))))) AS idx FROM pg_src),
pg_tags AS (
  SELECT project_id, label, idx, lower(split_part(piece, chr(2), 1)) AS tag,
         regexp_replace(piece, '^[^\\x{{02}}]*\\x{{02}}', '') AS body
  FROM pg_pieces WHERE idx > 1),
pg_blocks0 AS (
  SELECT project_id, label, idx, tag,
         CASE WHEN tag = 'ul' THEN 'table' ELSE 'paragraph' END AS kind,
         CASE WHEN tag = 'ul' THEN NULL ELSE {html_text('body')} END AS text,
         CASE WHEN tag = 'ul' THEN [list_transform(string_split_regex(body, '(?i)<li\\b[^>]*>')[2:],
              lambda x: {strip_ws(html_text('x'))})] END AS rows
  FROM pg_tags WHERE tag IN ({openers})),
pg_blocks1 AS (
  SELECT *, CASE WHEN tag LIKE 'h%' AND {strip_ws('text')} <> '' THEN '§' || {strip_ws('text')} END AS hloc
  FROM pg_blocks0),
page_blocks AS (
  SELECT project_id, label, kind, text, rows,
         coalesce(last_value(hloc IGNORE NULLS) OVER (PARTITION BY label ORDER BY idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'body') AS location,
         row_number() OVER (PARTITION BY label ORDER BY idx) AS block_no
  FROM pg_blocks1)"""


def html_blocks_sql() -> str:
    return f"""WITH {page_ctes()}
SELECT project_id, label, CAST(block_no AS BIGINT) AS block_no, kind, location,
  CASE WHEN kind = 'table' THEN array_to_string(flatten(rows), ' ') ELSE text END AS text,
  CAST(CASE WHEN kind = 'table' THEN len(rows) ELSE 0 END AS BIGINT) AS n_rows
FROM page_blocks"""


def merged_cells_sql() -> str:
    return """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS BIGINT) AS col_no,
  CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS k FROM lineitem)
WHERE k = 1"""


def rule_lint_sql() -> str:
    from quarry.fixtures import CORPUS_RULESET
    from quarry.operators.compile import METHODS_BY_EXT
    from quarry.plans.queries import LINT_EXTS
    table = dict(METHODS_BY_EXT)
    for e, like in LINT_EXTS.items():
        table[e] = table[like]
    rules = compile_ruleset(CORPUS_RULESET)
    allowed = " UNION ALL ".join(f"SELECT {q(e)} AS ext, {q(m)} AS method" for e, ms in table.items() for m in ms)
    types = " UNION ALL ".join(f"SELECT CAST({r.rule_no} AS BIGINT) AS rule_no, {q(r.type)} AS rule_type" for r in rules)
    cands = " UNION ALL ".join(
        f"SELECT project_id, CAST({r.rule_no} AS BIGINT) AS rule_no, label FROM FILES f WHERE {cand_sql(r)}"
        for r in rules)
    return f"""WITH {blocks_ctes()},
ALLOWED AS ({allowed}), TYPES AS ({types}), CANDS AS ({cands})
SELECT c.project_id, c.rule_no, c.label, lower(regexp_extract(c.label, '(\\.[^.]*)$', 1)) AS ext, t.rule_type
FROM CANDS c JOIN TYPES t ON t.rule_no = c.rule_no
WHERE NOT EXISTS (SELECT 1 FROM ALLOWED a WHERE a.ext = lower(regexp_extract(c.label, '(\\.[^.]*)$', 1))
                  AND a.method = t.rule_type)"""



def sheet_rows_containing_sql() -> str:
    from quarry.plans import queries as Q
    rows = sheet_rows_sql()
    wanted = ", ".join(f"({q(p)}, {q(normalize_py(p))})" for p in Q.SHEET_PHRASES)
    return f"""WITH r AS ({rows}), w(phrase, norm) AS (VALUES {wanted})
SELECT phrase, sheet, CAST(row_no AS BIGINT) AS row_no, array_to_string(cells, ' | ') AS cells
FROM r JOIN w ON len(list_filter(cells, lambda c: contains(lower(trim(c)), norm))) > 0"""


def sheet_values_sql() -> str:
    """Rows of the tables that the deep rules give, each rule by itself."""
    from quarry.plans.queries import DEEP_RULES
    parts = []
    for r in compile_ruleset(DEEP_RULES):
        head = f"SELECT CAST({r.rule_no} AS BIGINT) AS rule_no, "
        if r.type in ("around_keywords", "table_contains"):
            needle = r.p("keyword" if r.type == "around_keywords" else "contains")
            parts.append(f"{head}w.sheet, w.row_no, w.row_no BETWEEN h.row_no - ({r.before}) AND h.row_no + ({r.after}) AS near, "
                         f"array_to_string(w.cells, ' | ') AS cells FROM wb_rows w JOIN ({phrase_hit_sql(needle)}) h ON w.sheet_ord = h.sheet_ord")
        elif r.type == "sheet_cell" and rect_sql(r):
            o, r1, c1, r2, c2 = rect_sql(r)
            ends = f"(SELECT n FROM wb_ends WHERE sheet_ord = {o})" if r2 is None else str(r2)
            cells = "[" + ", ".join(f"coalesce(w.cells[{c}], '')" for c in range(c1, c2 + 1)) + "]"
            cut = f"list_slice(cells, {c1}, {c2})"
            parts.append(f"{head}{q(TPCH_SHEETS[o][0])}, s.i, false, array_to_string({cells}, ' | ') "
                         f"FROM (SELECT unnest(generate_series({r1}, {ends})) AS i) s "
                         f"LEFT JOIN (SELECT * FROM wb_rows WHERE sheet_ord = {o}) w ON w.row_no = s.i "
                         f"WHERE EXISTS (SELECT 1 FROM wb_rows WHERE sheet_ord = {o} AND row_no BETWEEN {r1} AND {ends} "
                         f"AND len(list_filter({cut}, lambda c: trim(c) <> '')) > 0)")
    return f"WITH {WB_ROWS}\n" + "\nUNION ALL\n".join(parts)


def sheet_grid_sql(max_rows: int = 60, max_cols: int = 30) -> str:
    from quarry.functions.text import column_letters_py
    parts = []
    for name, key, cols in TPCH_SHEETS:
        cols = cols[:max_cols]
        for c, (col, t) in enumerate(cols, start=1):
            letter = column_letters_py(c)
            parts.append(f"SELECT {q(name)} AS sheet, CAST(1 AS BIGINT) AS row_no, CAST({c} AS BIGINT) AS col_no, "
                         f"{q(letter + '1')} AS ref, {q(col)} AS value")
            parts.append(f"SELECT {q(name)}, CAST({key} + 2 AS BIGINT), CAST({c} AS BIGINT), "
                         f"{q(letter)} || ({key} + 2), coalesce({cell_sql(col, t)}, '') FROM {name} "
                         f"WHERE {key} <= {max_rows - 2}")
    return "\nUNION ALL\n".join(parts)


def result_rows_sql() -> str:
    from quarry.fixtures import CORPUS_RULESET
    return records_sql(CORPUS_RULESET) + f"""
SELECT project_id, CAST(rule_no AS BIGINT) AS rule_no, name, found, citation, note,
  CASE WHEN found THEN coalesce({preview_sql('pv')}, '') ELSE '' END AS preview
FROM RECORDS"""
