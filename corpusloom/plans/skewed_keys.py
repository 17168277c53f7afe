"""Problem 2: per-party and per-speaker results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.range_partials import key_totals, stitched_ranks

#: Share of a field's non-null rows from which a value counts as heavy.
HEAVY_SHARE = 0.05


def keyed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, key_value, id) of both fields; null values left out."""
    s = spark.read.parquet(f"{sf_dir}/speeches.parquet").select("id", "orador", "partido")
    pair = [F.struct(F.lit(c).alias("field_name"), F.col(c).alias("key_value")) for c in ("orador", "partido")]
    return s.select("id", F.explode(F.array(*pair)).alias("f")).select("f.field_name", "f.key_value", "id").filter("key_value IS NOT NULL")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on at least 5 % of the rows where their field is not null."""
    per_key = key_totals(keyed_rows(spark, sf_dir), ["field_name", "key_value"], "id")
    per_field = per_key.groupBy("field_name").agg(F.sum("n_rows").alias("n_field"))
    return per_key.join(F.broadcast(per_field), "field_name").filter(F.col("n_rows") >= HEAVY_SHARE * F.col("n_field")).select("field_name", "key_value")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_key = key_totals(keyed_rows(spark, sf_dir), ["field_name", "key_value"], "id")
    return per_key.select("field_name", "key_value", "n_rows", F.col("first_value").alias("first_id"), F.col("last_value").alias("last_id"))


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each speech's number among its speaker's and its party's, with the id before it (0 at the first)."""
    ranked = stitched_ranks(keyed_rows(spark, sf_dir), ["field_name", "key_value"], "id")
    return ranked.select("field_name", "key_value", "id", F.col("row_no").cast("long").alias("row_no"), F.coalesce("previous", F.lit(0)).alias("previous_id"))


QUERIES = {"p2_found": found, "p2_totals": totals, "p2_sequence": sequence}

_ROWS = "(SELECT 'orador' AS field_name, orador AS key_value, id FROM speeches WHERE orador IS NOT NULL UNION ALL SELECT 'partido', partido, id FROM speeches WHERE partido IS NOT NULL)"
SQL = {
    "p2_found": f"SELECT field_name, key_value FROM (SELECT field_name, key_value, count(*) AS n, sum(count(*)) OVER (PARTITION BY field_name) AS t FROM {_ROWS} GROUP BY 1, 2) WHERE n >= 0.05 * t",
    "p2_totals": f"SELECT field_name, key_value, count(*) AS n_rows, min(id) AS first_id, max(id) AS last_id FROM {_ROWS} GROUP BY 1, 2",
    "p2_sequence": f"SELECT field_name, key_value, id, row_number() OVER w AS row_no, coalesce(lag(id) OVER w, 0) AS previous_id FROM {_ROWS} WINDOW w AS (PARTITION BY field_name, key_value ORDER BY id)",
}
