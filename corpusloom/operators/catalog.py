"""Stored-table operations: listings, upserts, replacements, conditional updates and cascading deletes, as set operations over immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import broadcast_if_small


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """Union with the latest row per key; a new row wins over an old one of the same time."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(newest), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def insert_if_absent(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not stored yet, one per key; rows without a key never collide."""
    keyed = rows.filter(F.col(key).isNotNull()).dropDuplicates([key])
    fresh = keyed.join(stored.select(key).filter(F.col(key).isNotNull()), key, "left_anti")
    return fresh.unionByName(rows.filter(F.col(key).isNull()).select(fresh.columns))


def replace_where(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys in ``new`` are replaced by ``new``."""
    return old.join(broadcast_if_small(new.select(*keys).distinct()), keys, "left_anti").unionByName(new)


def save_texts(speeches: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched texts stored; a null text counts one more failure. ``fetched`` has (id, text)."""
    f = fetched.select("id", F.col("text").alias("_text"), F.lit(True).alias("_hit"))
    j = speeches.join(f, "id", "left")
    failed = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("_text").isNull()
    return j.withColumn("discurso", F.coalesce("_text", "discurso")).withColumn("fetch_failures", F.col("fetch_failures") + failed.cast("int")).drop("_text", "_hit")


def without_datasets(ids: list[int], datasets: DataFrame, links: DataFrame, speeches: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting data sets: their links, the speeches no data set holds any more, and these speeches' vectors."""
    kept_links = links.filter(~F.col("dataset_id").isin(*ids))
    linked = kept_links.select(F.col("speech_id").alias("id")).distinct()
    kept = speeches.join(linked, "id", "left_semi")
    return {
        "datasets": datasets.filter(~F.col("id").isin(*ids)),
        "dataset_speeches": kept_links,
        "speeches": kept,
        "speech_embeddings": vectors.join(linked.withColumnRenamed("id", "speech_id"), "speech_id", "left_semi"),
    }


def repaired_status(c: Column, kind: str) -> Column:
    """Status after a restart: what was running is interrupted (data sets) or failed (runs)."""
    if kind == "dataset":
        return F.when(c == "running", "interrupted").otherwise(c)
    return F.when(c.isin("pending", "running"), "failed").otherwise(c)


def with_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Schema evolution: absent columns are added as nulls of their type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def dataset_listing(datasets: DataFrame, links: DataFrame, speeches: DataFrame) -> DataFrame:
    """Each data set with its speeches, those with text and those that failed; one join for all, newest first."""
    s = speeches.select(F.col("id").alias("speech_id"), F.col("discurso").isNotNull().alias("has"), (F.col("discurso").isNull() & (F.col("fetch_failures") > 0)).alias("failed"))
    c = links.join(s, "speech_id").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_speeches"), F.count_if("has").alias("n_text"), F.count_if("failed").alias("n_failed"))
    j = datasets.join(c, datasets["id"] == c["dataset_id"], "left")
    return j.select("id", "name", "status", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_speeches", "n_text", "n_failed")]).orderBy(F.desc("id"))


def dataset_frame(links: DataFrame, speeches: DataFrame, dataset_id: int) -> DataFrame:
    """The speeches with text of one data set, in id order."""
    ids = links.filter(F.col("dataset_id") == dataset_id).select(F.col("speech_id").alias("id"))
    return speeches.filter("discurso IS NOT NULL AND discurso <> ''").join(ids, "id", "left_semi").orderBy("id")


def missing_vectors(links: DataFrame, speeches: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Speeches with text that have no vector of the model yet: what an encoder still has to do."""
    have = vectors.filter(F.col("model") == model).select(F.col("speech_id").alias("id"))
    return speeches.filter("discurso IS NOT NULL AND discurso <> ''").join(links.select(F.col("speech_id").alias("id")), "id", "left_semi").join(have, "id", "left_anti").select("id")


def orphans(links: DataFrame, speeches: DataFrame) -> DataFrame:
    """Speeches that no data set holds."""
    return speeches.join(links.select(F.col("speech_id").alias("id")), "id", "left_anti").select("id")


def set_state(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The rows with the columns that ``changes`` holds for their key replaced; null in a change means unchanged."""
    cols = [c for c in changes.columns if c != key]
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in cols])
    j = rows.join(broadcast_if_small(c), key, "left")
    return j.select(*[F.coalesce(f"_{x}", x).alias(x) if x in cols else F.col(x) for x in rows.columns])


def deleted(rows: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    return rows.filter(~F.col(key).isin(*ids)) if ids else rows


def cached_totals(totals: DataFrame) -> DataFrame:
    """(month, total, fetched): the latest stored total of each month, with the day it was fetched."""
    last = totals.groupBy("month").agg(F.max_by(F.struct("total", "fetched_at"), F.struct("fetched_at", "total")).alias("x"))
    return last.select("month", "x.total", F.to_date("x.fetched_at").alias("fetched"))


def encoding_speed(runs: DataFrame) -> DataFrame:
    """(model, seconds_per_doc): mean over the runs whose summary holds a measured speed, per model."""
    r = runs.select(F.from_json("params", "model string")["model"].alias("model"), F.from_json("summary", "segundos double, textos double").alias("s"))
    return r.filter("model IS NOT NULL AND s.textos > 0").groupBy("model").agg((F.sum("s.segundos") / F.sum("s.textos")).alias("seconds_per_doc"))
