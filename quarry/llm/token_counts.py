"""Token counts kept up to date by signed changes.

A ledger holds, per committed batch, signed rows (document, source, language,
tokenizer version, documents, tokens). A batch brings inserts, revisions and
deletes; each turns into the difference between the document's new and last
counts, so totals are plain sums and batches can be added in any grouping. A
batch is one Parquet folder that Spark's committer marks as complete; a batch
that is complete is not written again, and one that broke off is written anew.
Each batch also leaves its own totals, so reading the rollup reads a few rows
per batch, not the ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import tokens

GROUP = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: name of the version -> function from a text to its number of tokens
Tokenizers = dict[str, Callable[[str], int]]


def bpe_counter(path: str) -> Callable[[str], int]:
    return lambda text: len(tokens.encoder(path).ids(text)) // 4


def word_counter() -> Callable[[str], int]:
    return lambda text: len(text.encode("utf-8", "surrogatepass").split())


def counted(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Ledger rows of documents as they are: one per document and version.
    A null text has no tokens but counts as a document."""
    names = list(tokenizers)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes = [[f(x.as_py() or "") for x in batch.column(3)] for f in tokenizers.values()]
            for name, size in zip(names, sizes):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([name] * len(size), pa.string()), pa.array([1] * len(size), pa.int64()),
                     pa.array(size, pa.int64())], names=["doc_id", "source", "lang", "tokenizer", "n_docs", "n_tokens"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
                        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, LEDGER))


class Rollup:
    """The ledger and totals under one folder."""

    def __init__(self, spark: SparkSession, path: str, tokenizers: Tokenizers):
        self.spark, self.path, self.tokenizers = spark, path.rstrip("/"), tokenizers

    def _folder(self, what: str, batch: int) -> str:
        return f"{self.path}/{what}/batch={batch:012d}"

    def _complete(self, folder: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _read(self, what: str, schema: str, below: int | None = None) -> DataFrame | None:
        """All complete batches of an id under ``below``."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        paths = [f"{self.path}/{what}/{n}" for n in sorted(names)
                 if n.startswith("batch=") and (below is None or int(n[6:]) < below)]
        paths = [p for p in paths if self._complete(p)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def commit(self, batch: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Apply a batch; False if it was complete already.

        ``upserts`` (doc_id, text, source, lang) inserts new documents and
        revises known ones, whatever has changed; ``deletes`` (doc_id) removes
        documents. Deleting an unknown document changes nothing; a document in
        both is revised. Rows of one id within a batch add up. Batches are
        committed in the order of their ids: a new batch before one that is
        there, or after one that broke off, is refused (ValueError), as its
        changes would rest on the wrong documents. Repeating the batch that broke off mends it."""
        ledger, totals = self._folder("ledger", batch), self._folder("totals", batch)
        done = self._complete(totals)
        if not self._complete(ledger):
            self._in_order(batch)
            self._changes(batch, upserts, deletes).write.mode("overwrite").parquet(ledger)
        if not done:
            (self.spark.read.schema(LEDGER).parquet(ledger).groupBy(*GROUP)
             .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
             .write.mode("overwrite").parquet(totals))
        return not done

    def _in_order(self, batch: int) -> None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        for other in sorted(int(n[6:]) for n in names if n.startswith("batch=")):
            if other > batch:
                raise ValueError(f"batch {batch} comes after batch {other}, which is there already")
            if other < batch and not self._complete(self._folder("ledger", other)):
                raise ValueError(f"batch {other} broke off; commit it again before batch {batch}")

    def _changes(self, batch: int, upserts: DataFrame | None, deletes: DataFrame | None) -> DataFrame:
        known = self._read("ledger", LEDGER, batch)
        new = counted(upserts, self.tokenizers) if upserts is not None else None
        if known is None:
            return new if new is not None else self.spark.createDataFrame([], LEDGER)
        touched = [x.select(F.col("doc_id").cast("long").alias("t")) for x in (upserts, deletes) if x is not None]
        if not touched:
            return self.spark.createDataFrame([], LEDGER)
        ids = touched[0] if len(touched) == 1 else touched[0].unionByName(touched[1])
        last = (known.join(ids.distinct(), F.col("doc_id").eqNullSafe(F.col("t")), "left_semi")
                .withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")}))
        both = last if new is None else last.unionByName(new)
        return (both.groupBy("doc_id", *GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .filter("n_docs <> 0 or n_tokens <> 0"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of the documents that
        are there; groups without documents are left out."""
        kept = self._read("totals", TOTALS)
        kept = self.spark.createDataFrame([], TOTALS) if kept is None else kept
        return (kept.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .filter("n_docs <> 0 or n_tokens <> 0"))
