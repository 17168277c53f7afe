"""Writing results: JSON-safe documents, CSV with a byte-order mark, partitioned tables and vector caches."""

from __future__ import annotations

import csv
import json
import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import BROADCAST_ROWS


def safe(x):
    """What JSON can hold: text keys, plain numbers, no NaN or infinity, dates as ISO text."""
    if isinstance(x, dict):
        return {str(k): safe(v) for k, v in x.items()}
    if hasattr(x, "asDict"):  # a row is a tuple too
        return safe(x.asDict(recursive=True))
    if isinstance(x, (list, tuple, set)):
        return [safe(v) for v in x]
    if hasattr(x, "item") and not isinstance(x, (str, bytes)):
        x = x.item()
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, (date, datetime)):
        return x.isoformat()
    return x


def document(parts: dict[str, DataFrame], most: int = BROADCAST_ROWS) -> dict:
    """One document of small result tables; a table beyond the bound is refused, not cut."""
    out = {}
    for name, df in parts.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows: write it as a table")
        out[name] = [safe(r) for r in rows]
    return out


def write_json(doc: dict, path: str) -> None:
    Path(path).write_text(json.dumps(safe(doc), ensure_ascii=False, indent=2, allow_nan=False), encoding="utf-8")


def write_csv(df: DataFrame, path: str) -> int:
    """One CSV file for people: header, byte-order mark, rows streamed partition by partition. Returns the rows."""
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        for r in df.toLocalIterator():
            w.writerow(["" if v is None else v for v in r])
            n += 1
    return n


def write_csv_parts(df: DataFrame, path: str) -> None:
    """The same for machines: as many files as partitions."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def embed_html(doc: dict, template: str = "<html><script>const DATA = {};</script></html>") -> str:
    """A page that carries its data; a closing tag inside the data cannot end the script."""
    return template.replace("{}", json.dumps(safe(doc), ensure_ascii=False, allow_nan=False).replace("</", "<\\/"))


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors appended to a cache, one folder per model, with the time they were stored."""
    vectors.withColumn("stored_at", F.current_timestamp()).write.mode("append").partitionBy("model").parquet(path)


def read_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Latest vector per key of one model; only that model's folder is read."""
    v = spark.read.parquet(path).filter(F.col("model") == model)
    return v.groupBy("speech_id").agg(F.max_by("vector", "stored_at").alias("vector"))


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """The partitions present in the frame are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
