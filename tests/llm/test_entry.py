"""The registered queries and their SQL."""

import duckdb
import pytest

from quarry.llm import oracle, queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert set(oracle.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.execute(oracle.SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    order = lambda rows: sorted(map(repr, rows))
    assert order(tuple(r) for r in got.select(*columns).collect()) == order(want.fetchall())


def test_folder_of_a_session_without_the_setting():
    from types import SimpleNamespace

    import pytest

    from quarry.llm.store import shared_dir

    class Context:
        folder = None

        def __init__(self, master):
            self.master = master

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = path + "/of-the-context"

    local = SimpleNamespace(conf={}, sparkContext=Context("local[2]"))
    assert shared_dir(local) == shared_dir(local) == local.sparkContext.folder
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf={}, sparkContext=Context("spark://somewhere:1")))
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "/shared/"}, sparkContext=Context("spark://somewhere:1"))
    assert shared_dir(named) == "/shared"
