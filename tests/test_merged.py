"""S9 on a row holding most of the cells: same answer as a brute force."""

import random

from quarry.operators.merged import dedupe_row_cells


def brute(rows):
    out = {}
    by_row = {}
    for r, c, cell in rows:
        by_row.setdefault(r, []).append((c, cell))
    for r, items in by_row.items():
        first = {}
        for c, cell in items:
            first[cell] = min(c, first.get(cell, c))
        kept = sorted((c, cell) for cell, c in first.items())
        for i, (c, cell) in enumerate(kept, start=1):
            out[(r, cell)] = (c, i)
    return out


def test_hot_row_split_across_tasks(spark):
    rnd = random.Random(7)
    rows = [(0, rnd.randrange(5000), rnd.randrange(3000)) for _ in range(20000)]   # one hot row
    rows += [(r, rnd.randrange(20), rnd.randrange(15)) for r in range(1, 400) for _ in range(5)]
    df = spark.createDataFrame(rows, "r long, c long, cell long").repartition(8)
    got = {(x["r"], x["cell"]): (x["c"], x["col_no"]) for x in dedupe_row_cells(df, "r", "c", "cell").collect()}
    assert got == brute(rows)


def test_without_exchange_reuse(spark):
    rows = [(r % 3, c, c // 2) for r in range(3) for c in range(3000)]
    df = spark.createDataFrame(rows, "r long, c long, cell long")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {(x["r"], x["cell"]): (x["c"], x["col_no"]) for x in dedupe_row_cells(df, "r", "c", "cell").collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == brute(rows)
