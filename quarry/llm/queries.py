"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (decontam, licenses, line_dedup, merkle, mixing, neardup, packing, quality, secrets, token_counts,
                        tokens, url_filter, warc, whitening)
from quarry.llm.store import keep, new_path, table

#: A table of ids of up to this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_IDS = 500_000


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.default_path())


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in; those labelled toxic
    go; those labelled as poor are revised to single blanks. The second batch
    is then committed again, which changes nothing."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rollup = token_counts.Rollup(spark, new_path(spark, "rollup"), {
        "byte_bpe_50k": token_counts.bpe_counter(tokens.default_path()), "words": token_counts.word_counter()})
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    poor = labels.filter("quality = 0 and (toxic is null or toxic <> 1)").select("doc_id").distinct()
    side = F.broadcast(poor) if poor.count() <= BROADCAST_IDS else poor
    revised = (docs.join(side, "doc_id", "left_semi")
               .withColumn("text", F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
    rollup.commit(1, upserts=docs)
    rollup.commit(2, deletes=toxic)
    rollup.commit(3, upserts=revised)
    rollup.commit(2, deletes=toxic)
    return rollup.totals()


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("line_licenses", F.array_join("line_licenses", ","))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_url_filter, op3_near_dedup, op4_decontamination, op5_token_counts, op6_line_dedup, op7_warc,
    op8_quality_rules, op9_secret_scan, op10_license_scan, op11_merkle_manifest, op12_source_mixing, op13_whitening)}


# Stages of the pipeline: documents in, documents out (but for the last).

def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs; documents of which nothing
    but blanks is left go. ``n_chars`` follows the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    done = line_dedup.dedup(docs, keep_cols=others)
    emptied = (F.col("__removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    done = done.toDF("doc_id", "text", "__lines", "__removed", *others).filter(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in others:
        changed = F.col("__removed") > 0
        done = done.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType))
                               .otherwise(F.col("n_chars")))
    return done.select(*[f"`{c}`" for c in docs.columns])


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Line removal leaves of a
    later near copy only the lines that differ, so a document counts with two
    texts: the one that ``sf_dir`` has under its id, and what is left of it.
    Both are linked in one pass; equal ones are one class there. Which documents
    take part is settled on signatures, so that no text passes a shuffle for it.
    Documents without an id stay."""
    ids = docs.select("doc_id").filter("doc_id is not null").distinct()
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    copies = (neardup.near_duplicates(texts, layout=neardup.AT_80, among=ids).groupBy(F.col("doc_id").alias("__copy"))
              .agg(F.min("component_id").alias("first")).filter("first < __copy").select("__copy"))
    return docs.join(copies, docs["doc_id"] == copies["__copy"], "left_anti")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokens.default_path())


def run_stages(stages, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(stages):
            docs = keep(docs, f"stage-{name}")
    return docs
