"""File listing and registration.

``list_folder`` reads a folder tree with the ``binaryFile`` source: regular
files only, Office lock files (``~$...``) skipped, one row per file with its
bytes, size, extension and SHA-256. ``register`` gives the same view of the
corpus tables. Which labels a run uses (S3) is a semi join with the chosen
labels, skipped when none are chosen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.corpus import page_host, read_table

# The extensions this engine decodes, and the two problems a
# file can have before it is opened.
SUPPORTED = [".docx", ".html", ".pptx", ".txt", ".xlsm", ".xlsx"]
LEGACY_DOC_PROBLEM = ("Legacy '.doc' files cannot be read. Open in Word and use File > Save As > "
                      "Word Document (.docx), then re-upload.")


#: Paths of older versions up to this many are broadcast.
BROADCAST_PATHS = 200_000


def extension(label: Column) -> Column:
    return F.lower(F.regexp_extract(label, "(\\.[^./\\\\]*)$", 1))


def problem_for(ext: Column) -> Column:
    """The problem of a file before decoding, or null."""
    return (F.when(ext == ".doc", F.lit(LEGACY_DOC_PROBLEM))
            .when(~ext.isin(*SUPPORTED), F.concat(F.lit("Unsupported file type '"), ext,
                                                  F.lit("'. Supported: " + ", ".join(SUPPORTED) + "."))))


def below(path: Column, root: str) -> Column:
    """What comes after the folder ``root`` in a file's path; the scheme may differ, no character of the folder is a pattern."""
    bare = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    plain = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "", root).rstrip("/") + "/"
    return F.when(bare.startswith(plain), F.substring(bare, len(plain) + 1, 1 << 30)).otherwise(bare)


def list_folder(spark: SparkSession, path: str, project_from_dir: bool = True) -> DataFrame:
    """Every regular file under ``path``; project = first folder
    below ``path`` (or the folder itself); a re-upload with the same label
    keeps the latest modification, of equal times the greatest path.

    Versions are chosen on paths and times alone, which ``binaryFile`` lists
    without opening a file. The paths of older versions, which are few, are
    left out before bytes are read, so bytes pass no shuffle (beyond
    ``BROADCAST_PATHS`` older versions they do)."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    label = F.regexp_extract("path", "([^/]+)$", 1)
    root = path.rstrip("/")
    rel = below(F.col("path"), root)
    project = F.when(F.lit(project_from_dir) & rel.contains("/"), F.substring_index(rel, "/", 1)) \
        .otherwise(F.lit(root.rsplit("/", 1)[-1]))
    files = raw.withColumns({"project_id": project, "label": label}).filter(~F.col("label").startswith("~$"))
    older = older_versions(files.select("project_id", "label", "path", "modificationTime"))
    n = older.limit(BROADCAST_PATHS + 1).count()
    if n:
        files = files.join(F.broadcast(older) if n <= BROADCAST_PATHS else older, "path", "left_anti")
    ext = extension(F.col("label"))
    return files.select("project_id", "label", "path", F.col("length").alias("size"), ext.alias("ext"),
                        ext.isin(*SUPPORTED).alias("supported"), problem_for(ext).alias("problem"),
                        F.sha2("content", 256).alias("sha256"), "content")


def older_versions(listed: DataFrame) -> DataFrame:
    """Paths of files that another one with the same project and label supersedes."""
    newest = (listed.groupBy("project_id", "label").agg(F.max(F.struct("modificationTime", "path")).alias("f"), F.count("*").alias("n"))
              .filter("n > 1").select("project_id", "label", F.col("f.path").alias("newest")))
    return listed.join(newest, ["project_id", "label"]).filter("path <> newest").select("path")


def choose(files: DataFrame, labels: list[str] | None) -> DataFrame:
    """S3: keep the ticked labels; none ticked means all; unknown ones are ignored."""
    if not labels:
        return files
    chosen = files.sparkSession.createDataFrame([(str(x),) for x in labels], "label string")
    return files.join(F.broadcast(chosen), "label", "left_semi")


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2-S4 over the corpus tables: label, ext, size in bytes, supported, problem."""
    d = read_table(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("label"),
        F.octet_length("text").cast("bigint").alias("size"))
    p = read_table(spark, sf_dir, "pages").select(
        page_host(F.col("url")).alias("project_id"),
        F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("label"),
        F.octet_length("html").cast("bigint").alias("size"))
    c = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sum(F.octet_length("text")).cast("bigint").alias("size")).select(
        F.lit("conversations").alias("project_id"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".pptx")).alias("label"), "size")
    allf = d.unionByName(p).unionByName(c)
    ext = extension(F.col("label"))
    return allf.select("project_id", "label", ext.alias("ext"), "size", ext.isin(*SUPPORTED).alias("supported"),
                       problem_for(ext).alias("problem"))
