"""Incremental corpus extraction (X1) with Structured Streaming.

Files arrive in a landing folder under unique paths
(``<landing>/<project>/<arrival id>/<label>``); the file source never
re-reads a path, so a re-upload must land under a new arrival folder.

Each micro-batch (``foreachBatch``):

1. fingerprints the new files and drops those whose SHA-256 equals the
   *current* version of their (project, label): an unchanged re-upload is
   ignored, a changed one becomes the new current version;
2. decodes the rest into blocks (text, HTML and office packages, the same
   steps as the batch readers) and evaluates every rule on them (the same
   column expressions as the batch run, sheet rules included), appending the
   per-file records to ``<state>/file_results`` (parquet, keyed by project,
   label and arrival);
3. re-picks the records (P2-P4) for the touched projects only, from the
   latest version of every file in them, and overwrites those projects'
   partitions of ``<state>/records``.

The newest version of a file is the one with the latest modification time.
P2 is not monotone (an earlier label arriving late can win), so records are
recomputed per touched project rather than appended. Replaying a batch
writes the same rows again under the same arrival path and is deduplicated
on read, so the result does not change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.compile import compile_ruleset
from quarry.plans import run as RUN
from quarry.sources.corpus import BLOCK_TYPE, with_html_blocks, with_text_blocks
from quarry.sources.files import below, extension, problem_for
from quarry.sources.office import (OFFICE_EXTS, office_events, office_files, sheet_cells, sheet_list,
                                   workbook_files)

BINARY_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])

RESULTS_SCHEMA = (
    "project_id string, label string, arrival string, arrived timestamp, sha256 string, problem string, rule_no int, "
    "cand boolean, rec " + RUN.FILE_REC_T)


NOT_TEXT = "Could not read this file: it is not UTF-8 text."


class IncrementalExtractor:
    def __init__(self, spark: SparkSession, ruleset: dict, landing: str, state: str):
        self.spark, self.ruleset, self.landing, self.state = spark, ruleset, landing.rstrip("/"), state.rstrip("/")
        self.rules = compile_ruleset(ruleset)
        self.results_path = f"{self.state}/file_results"
        self.records_path = f"{self.state}/records"

    # -- reading -------------------------------------------------------------
    def _arrivals(self, raw: DataFrame) -> DataFrame:
        parts = F.split(below(F.col("path"), self.landing), "/")
        return raw.select(
            F.element_at(parts, 1).alias("project_id"),
            F.element_at(parts, -1).alias("label"),
            F.concat_ws("/", F.slice(parts, 1, F.size(parts) - 1)).alias("arrival"),
            F.col("modificationTime").alias("arrived"), F.sha2("content", 256).alias("sha256"), "content",
        ).filter(~F.col("label").startswith("~$"))

    def _current(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.results_path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        res = self.spark.read.schema(RESULTS_SCHEMA).parquet(self.results_path)
        return res.select("project_id", "label", "arrival", "arrived", "sha256").distinct() \
            .groupBy("project_id", "label").agg(F.max_by("sha256", F.struct("arrived", "arrival")).alias("sha256"))

    # -- one micro-batch -------------------------------------------------------
    def process(self, batch: DataFrame, epoch_id: int) -> None:
        arrivals = self._arrivals(batch)
        # a batch that is replayed after its results were appended finds all
        # its files known; their projects are picked anew all the same
        touched = arrivals.select("project_id").distinct().checkpoint(eager=True)
        cur = self._current()
        if cur is not None:
            arrivals = arrivals.join(cur, ["project_id", "label", "sha256"], "left_anti")
        # several arrivals of one label in a batch: the latest one counts
        arrivals = arrivals.groupBy("project_id", "label").agg(
            F.max_by(F.struct("arrival", "arrived", "sha256", "content"), F.struct("arrived", "arrival")).alias("a")).select(
            "project_id", "label", "a.arrival", "a.arrived", "a.sha256", "a.content")
        arrivals = arrivals.checkpoint(eager=True)
        if not arrivals.isEmpty():
            self.append(arrivals)
        if self._current() is not None:
            self.refresh(touched)

    def append(self, arrivals: DataFrame) -> None:
        """Decode new file versions and add their per-file records."""
        ext = extension(F.col("label"))
        files = arrivals.withColumn("ext", ext).withColumn("problem", problem_for(ext))
        cols = ["project_id", "label", "ext", "problem", "blocks"]
        # text that is not UTF-8 is a problem of its file, not of the batch
        text = F.try_validate_utf8(F.col("content").cast("string"))
        plain = files.filter(F.col("ext").isin(".txt", ".html")).withColumn("text", text).withColumn(
            "problem", F.when(F.col("text").isNull(), F.lit(NOT_TEXT)).otherwise(F.col("problem"))).na.fill("", ["text"])
        txt = with_text_blocks(plain.filter(F.col("ext") == ".txt"), "text").select(*cols)
        html = with_html_blocks(plain.filter(F.col("ext") == ".html"), "text").select(*cols)
        # office packages: bytes decoded in Python, structure built by Spark
        events = office_events(files.filter(F.col("ext").isin(*OFFICE_EXTS)))
        office = office_files(events).unionByName(workbook_files(events))
        other = files.filter(~F.col("ext").isin(".txt", ".html", *OFFICE_EXTS)).select(
            "project_id", "label", "ext", "problem", F.array().cast(f"array<{BLOCK_TYPE}>").alias("blocks"))
        blocks = txt.unionByName(html).unionByName(office).unionByName(other)
        per_file = RUN.file_records(blocks, self.rules)
        decoded_sheets = RUN.cell_sheet_records(blocks, sheet_list(events), sheet_cells(events), self.rules)
        if decoded_sheets is not None:
            per_file = per_file.unionByName(decoded_sheets)
        keys = arrivals.select("project_id", "label", "arrival", "arrived", "sha256")
        out = per_file.join(keys, ["project_id", "label"]).select(
            "project_id", "label", "arrival", "arrived", "sha256", "problem", F.col("rule_no").cast("int"), "cand", "rec")
        out.write.mode("append").parquet(self.results_path)

    def refresh(self, projects) -> None:
        """Re-pick the records of the touched projects (a DataFrame of
        project ids, or a list) from the latest file versions. The touched
        set is joined, never collected: a batch may touch many projects."""
        if not isinstance(projects, DataFrame):
            projects = self.spark.createDataFrame([(p,) for p in projects], "project_id string")
        res = self.spark.read.schema(RESULTS_SCHEMA).parquet(self.results_path) \
            .join(projects, "project_id", "left_semi") \
            .dropDuplicates(["project_id", "label", "arrival", "rule_no"])
        latest = res.groupBy("project_id", "label").agg(F.max(F.struct("arrived", "arrival")).alias("a")) \
            .select("project_id", "label", F.col("a.arrival").alias("arrival"))
        cur = res.join(latest, ["project_id", "label", "arrival"])
        recs = RUN.pick(self.spark, cur.select("project_id", "label", "problem", "rule_no", "cand", "rec"), self.rules)
        (recs.repartition("project_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("project_id").parquet(self.records_path))

    # -- running ---------------------------------------------------------------
    def start(self, checkpoint: str, available_now: bool = True):
        stream = (self.spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
                  .option("recursiveFileLookup", "true").load(self.landing))
        w = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
        return w.start()

    def records(self) -> DataFrame:
        return self.spark.read.parquet(self.records_path)
