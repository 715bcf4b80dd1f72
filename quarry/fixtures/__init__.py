"""Rule sets and templates used by the registered queries and the tests.

They are parameters of the queries, not data: every query still reads the
whole corpus tables.
"""

from __future__ import annotations

# The corpus rule set: every rule family, several match filters, a legacy
# type name, a default, an unknown type and rules that can only miss.
CORPUS_RULESET = {
    "name": "Corpus rules",
    "description": "Every rule family over documents, conversations and the tpch workbook.",
    "fields": [
        {"name": "Secret token", "type": "between", "match": "doc_",
         "params": {"start": 'token = "', "end": '"'}},
        {"name": "License", "type": "around_keywords", "match": "",
         "params": {"keyword": "licensed under", "before": 1, "after": 0}},
        {"name": "Passage", "type": "range", "match": "doc_",
         "params": {"start": "the and", "end": "of the"}},
        {"name": "Orthon", "type": "right_of", "match": "",
         "params": {"label": "ofreshwhou"}},
        {"name": "Blerend", "type": "around_keyword", "match": "conv_",
         "params": {"keyword": "blerend", "before": "1", "after": "2"}},
        {"name": "Nation seven row", "type": "table_contains", "match": "tpch",
         "params": {"contains": "NATION_7"}},
        {"name": "Region name", "type": "sheet_cell", "match": "tpch",
         "params": {"sheet": " Region ", "cell": "B3"}},
        {"name": "Nation block", "type": "sheet_cell", "match": "XLSX",
         "params": {"sheet": "nation", "cell": "A2:C4"}},
        {"name": "Lorem", "type": "between", "match": "", "default": "N/A",
         "params": {"start": "lorem", "end": "ipsum"}},
        {"name": "Pattern", "type": "regex", "match": "", "default": "unused",
         "params": {"start": "x"}},
        {"name": "Sheet on text", "type": "sheet_cell", "match": "conv_1",
         "params": {"sheet": "Ledger", "cell": "C12"}},
        {"name": "Missing tab", "type": "sheet_cell", "match": "tpch",
         "params": {"sheet": "Ledger", "cell": "C12"}},
        {"name": "Unmatched", "type": "table_contains", "match": "no-such-file",
         "params": {"contains": "x"}},
    ],
}

# Its report template: headings, fields, a repeated field, an unknown one.
CORPUS_TEMPLATE = {
    "name": "Corpus overview",
    "title": "The corpus at a glance",
    "sections": [
        {"type": "heading", "text": "Text"},
        {"type": "field", "field": "Secret token"},
        {"type": "field", "field": "Passage"},
        {"type": "field", "field": "License"},
        {"type": "heading", "text": "Tables"},
        {"type": "field", "field": "Nation seven row"},
        {"type": "field", "field": "Region name"},
        {"type": "field", "field": "Secret token"},
        {"type": "field", "field": "No such field"},
    ],
}
