"""R0/N2 for thousands of anchors at once.

A handful of anchors is best written as one column expression each
(``plans.queries.anchor_hits``). With many, every expression would read every
text again. Here the anchors are data: an automaton over all of them reads
each text once, whatever their number, and says which occur in it. It is built
once in each Python worker from the anchors' normalised forms, so its size is
that of the rule set. A file is one row: its blocks are searched in that row
and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import normalize_py
from quarry.operators import rules as R

HITS_T = "project_id string, label string, anchor_no long, first_location string, n_blocks long"
_BUILT: dict = {}


def _automaton(needles: tuple[tuple[str, tuple[int, ...]], ...]):
    """The automaton of a worker: needle -> numbers of the anchors with that form."""
    if _BUILT.get("of") != needles:
        import ahocorasick
        found = ahocorasick.Automaton()
        for needle, numbers in needles:
            found.add_word(needle, numbers)
        found.make_automaton()
        _BUILT.update({"of": needles, "is": found})
    return _BUILT["is"]


def scan(files: DataFrame, anchors: list[str]) -> DataFrame:
    """project_id, label, anchor_no (place in ``anchors``, from 0),
    first_location and n_blocks of every anchor that some block of the file
    matches. A null or empty anchor matches nothing; one that normalises to
    nothing matches every block. Equal anchors each get their rows."""
    forms: dict[str, list[int]] = {}
    for i, a in enumerate(anchors):
        if a:
            forms.setdefault(normalize_py(a), []).append(i)
    always = tuple(forms.pop("", ()))
    needles = tuple(sorted((k, tuple(v)) for k, v in forms.items()))

    def run(batches):
        import pyarrow as pa

        automaton = _automaton(needles) if needles else None
        for batch in batches:
            out = {k: [] for k in ("project_id", "label", "anchor_no", "first_location", "n_blocks")}
            for project, label, norms, places in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                seen: dict[int, list] = {}
                for norm, place in zip(norms or (), places or (), strict=True):
                    hit = {n for _, ns in automaton.iter(norm) for n in ns} if automaton else set()
                    for n in (*always, *hit):
                        seen.setdefault(n, [place, 0])[1] += 1
                for n, (place, count) in seen.items():
                    for k, v in zip(out, (project, label, n, place, count), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([
                pa.array(out["project_id"], pa.string()), pa.array(out["label"], pa.string()), pa.array(out["anchor_no"], pa.int64()),
                pa.array(out["first_location"], pa.string()), pa.array(out["n_blocks"], pa.int64())], names=list(out))

    return (R.prepare(files).select("project_id", "label", F.transform("blocks", lambda b: b["norm"]).alias("norms"),
                                    F.transform("blocks", lambda b: b["location"]).alias("places")).mapInArrow(run, HITS_T))


def phrases(texts: DataFrame, key: str, text: str, most: int, words: int = 3) -> list[str]:
    """The first ``most`` different runs of ``words`` words, by key and place:
    an anchor list out of a table (``most`` is the feature: how many anchors are wanted)."""
    w = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\n]+"), lambda x: x != "")
    runs = texts.select(F.col(key).alias("k"), w.alias("w")).select(
        "k", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - words + 1, F.lit(1))),
                                      lambda i: F.array_join(F.slice("w", i, words), " "))).alias("i", "a"))
    first = runs.filter("a <> ''").groupBy("a").agg(F.min(F.struct("k", "i")).alias("at"))
    return [r["a"] for r in first.orderBy("at").limit(most).collect()]
