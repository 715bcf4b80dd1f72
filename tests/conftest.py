import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from quarry.session import checkpoint_dir
    checkpoint_dir(s)
    yield s


BLOCKS_SCHEMA = ("project_id string, label string, ext string, problem string, "
                 "blocks array<struct<block_no:int,kind:string,text:string,"
                 "rows:array<array<string>>,location:string>>")


def P(text, loc="body"):
    return ("paragraph", text, None, loc)


def T(rows, loc="body"):
    return ("table", None, rows, loc)


def make_files(spark, files):
    """files: [(label, [blocks], problem?, project?)] with blocks from P()/T()."""
    rows = []
    for f in files:
        label, blocks = f[0], f[1]
        problem = f[2] if len(f) > 2 else None
        project = f[3] if len(f) > 3 else "p"
        ext = os.path.splitext(label)[1]
        rows.append((project, label, ext, problem,
                     [(i + 1, k, t, r, l) for i, (k, t, r, l) in enumerate(blocks)]))
    return spark.createDataFrame(rows, BLOCKS_SCHEMA)


def run_rules(spark, files, fields, workbooks=()):
    from quarry.plans.run import Corpus, run_ruleset
    recs = run_ruleset(spark, Corpus(files, list(workbooks)), {"name": "t", "fields": fields})
    return {r["rule_no"]: r.asDict(recursive=True) for r in recs.collect()}
