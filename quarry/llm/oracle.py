"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from quarry.llm import licenses as L

QUALITY = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k
      from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w)),
again as (select r, i from (select r, i, count(*) over (partition by r, k) as n from g) where n > 1),
hit as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from again) group by r),
b as (select w.doc_id, cast(len(ws) as bigint) as n_words,
             cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
             cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
             cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
             cast(coalesce(hit.n, 0) as bigint) as n_repeat_words, len(ls) as n_lines
      from w left join hit using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 100 * n_symbols > 50 * n_words or 100 * n_dup_lines > 30 * n_lines
            or word_chars < 2 * n_words or word_chars > 15 * n_words) as kept
from f
"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spellings(column: str) -> str:
    for old, new in L.SPELLINGS:
        for _ in range(2):
            column = f"replace({column}, ' {old} ', ' {new} ')"
    return column


# The clause in patterns of its own: where it begins, who is named, where it ends.
_BEGINS = r"(?:(?:copyright[ \t:]*)?©|copyright[ \t:]*\(c\)|(?:copyright|\(c\))[ \t:]*[<{(\[]?(?:1[0-9]{3}|2[0-9]{3}|yyyy|year))"
_THEN = "|".join(["all rights reserved", "permission (?:is|to)", "redistribution and", "(?:licensed|released) under",
                  "this (?:file|program|software|source|work)"])
_CUT = rf"(?m)^[-;/*#> \t]*{_BEGINS}[^\n]{{0,200}}?(\.[ \t]|\.?\r?$|[ \t]+(?:{_THEN}))"
_FSF = r"copyright[ \t\r\n]+\(c\)[-,0-9 \t\r\n]+free[ \t\r\n]+software[ \t\r\n]+foundation"

LICENSES = f"""
with known(license_id, text) as (values {', '.join(f'({_q(i)}, {_q(t)})' for i, t in L.KNOWN)}),
texts as (select row_number() over () as r, doc_id, cast(null as varchar) as license_id,
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
          union all select null, null, license_id,
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from known),
clean as (select r, doc_id, license_id, regexp_replace(
            case when contains(t, 'copyright') or contains(t, '(c)') or contains(t, '©')
                 then regexp_replace(regexp_replace(regexp_replace(t, '\\b([a-z]|co|corp|inc|jr|ltd)\\.', '\\1 ', 'g'),
                                     {_q(_FSF)}, ' free software foundation', 'g'), {_q(_CUT)}, ' \\1', 'g')
                 else t end, 'all[ \t\r\n]+rights[ \t\r\n]+reserved', ' ', 'g') as t from texts),
shown as (select r, doc_id, license_id, array_to_string(list_transform(string_split(t, chr(10)),
            lambda x: ' ' || regexp_replace(x, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g') || ' '), chr(10)) as s from clean),
spelt as (select r, doc_id, license_id, {_spellings('s')} as s from shown),
forms as (select r, doc_id, license_id, list_filter(list_transform(
            string_split(regexp_replace(s, ' +', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') as f from spelt),
whole as (select r, doc_id, license_id, f,
                 case when len(f) > 0 then sha256(array_to_string(f, ' ')) end as digest from forms),
k as (select digest as kd, min(license_id) as known_id from whole where r is null and digest is not null group by 1),
places as (select r, f, unnest(range(1, len(f) + 1)) as i from whole where r is not null),
lines as (select r, string_agg(distinct known_id, ',' order by known_id) as line_licenses
          from (select r, array_to_string(f[i:i + n - 1], ' ') as x from places, (values (1), (2), (3)) as w(n)
                where i + n - 1 <= len(f)) join k on sha256(x) = kd group by r)
select doc_id, digest, known_id as license_id, coalesce(line_licenses, '') as line_licenses
from whole left join k on digest = kd left join lines using (r) where whole.r is not null
"""

SQL = {"op8_quality_rules": QUALITY, "op10_license_scan": LICENSES}
