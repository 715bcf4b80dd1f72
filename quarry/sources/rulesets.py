"""Rule sets and templates as JSON.

A folder of rule-set (or template) files is read with the JSON source under
an explicit schema in PERMISSIVE mode; a file that does not parse lands in
the corrupt-record column and is dropped from the listing, as an unreadable
file is skipped. Numbers in ``before``/``after`` arrive as their JSON text,
which the rule compiler accepts. One rule set is a small object, so loading
it to the driver (where rules are compiled) is bounded by its own size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.compile import LEGACY_TYPES

PARAMS_T = ("struct<start:string,end:string,label:string,keyword:string,contains:string,"
            "sheet:string,cell:string,before:string,after:string>")
RULESET_SCHEMA = (f"name string, description string, fields array<struct<name:string,type:string,"
                  f"match:string,default:string,params:{PARAMS_T}>>, _corrupt_record string")
TEMPLATE_SCHEMA = ("name string, title string, sections array<struct<type:string,text:string,field:string>>, "
                   "_corrupt_record string")


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    df = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{folder.rstrip('/')}/*.json"))
    # the file name arrives URL-encoded; a literal '+' must survive decoding
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    df = df.withColumn("id", F.regexp_extract(name, "^(.*)\\.json$", 1))
    # cache before filtering on the corrupt-record column (a Spark rule for
    # the JSON source); the listing is one row per file
    return df.cache().filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_rulesets(spark: SparkSession, folder: str) -> DataFrame:
    """Every readable rule-set file of a folder, with its id."""
    return _read(spark, folder, RULESET_SCHEMA)


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, TEMPLATE_SCHEMA)


def list_rulesets(df: DataFrame) -> DataFrame:
    """S12 listing: id, name (the id when unnamed), number of fields."""
    return df.select("id", F.coalesce("name", "id").alias("name"),
                     F.coalesce(F.size("fields"), F.lit(0)).alias("fields")).orderBy("id")


def list_templates(df: DataFrame) -> DataFrame:
    return df.select("id", F.coalesce("name", "id").alias("name"),
                     F.coalesce(F.size("sections"), F.lit(0)).alias("sections")).orderBy("id")


def migrated_type(t: Column) -> Column:
    """S14 as an expression: legacy type names mapped, others kept."""
    m = F.create_map(*[x for k, v in LEGACY_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[t], t)


def rules_table(df: DataFrame) -> DataFrame:
    """One row per (rule set, rule) in order, with the migrated type."""
    return df.select("id", F.posexplode("fields").alias("rule_no", "f")).select(
        "id", "rule_no", F.col("f.name").alias("name"), F.col("f.type").alias("raw_type"),
        migrated_type(F.col("f.type")).alias("type"), F.col("f.match").alias("match"),
        F.col("f.default").alias("default"), F.col("f.params").alias("params"))


def _clean(v):
    if isinstance(v, dict):
        return {k: _clean(x) for k, x in v.items() if x is not None}
    if isinstance(v, list):
        return [_clean(x) for x in v]
    return v


def load(df: DataFrame, item_id: str) -> dict | None:
    """One rule set or template as a plain dict (absent keys left out)."""
    row = df.filter(F.col("id") == item_id).first()
    return None if row is None else _clean(row.asDict(recursive=True))


def export(df: DataFrame, path: str) -> None:
    """Write rule sets or templates as JSON, one folder ``id=<id>`` per item."""
    df.repartition("id").write.mode("overwrite").partitionBy("id").json(path)


def read_exported(spark: SparkSession, path: str, schema: str = RULESET_SCHEMA) -> DataFrame:
    """What ``export`` wrote, under the same ids."""
    fields = schema.removesuffix(", _corrupt_record string")
    return spark.read.schema(f"{fields}, id string").json(path)
