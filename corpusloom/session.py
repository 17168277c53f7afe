"""Session defaults, lineage cuts in the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side whose row width is bounded may be broadcast.
BROADCAST_ROWS = 200_000


def build_session(cpus: int | str = "*", app: str = "corpusloom") -> SparkSession:
    n = str(cpus)
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if n == "*" else n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, for checkpoints and cut tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests on one machine) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    sc.setCheckpointDir(made)
    return made


_cuts: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by now
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _cuts:
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            _remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only a re-read, and nothing before
    the cut is computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _cuts.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Delete the table of a cut that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        _remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Free the shuffle files of steps that are over.

    Spark deletes them when the driver collects its garbage, which follows its
    memory and not the disk, so a plan of many large steps has to ask for it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_parts(spark: SparkSession, rows: int | None = None, per_part: int = 200_000) -> int:
    """Partitions for an explicit shuffle: the session's number, more where rows ask for it."""
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(base, -(-rows // per_part)) if rows else base


def broadcast_if_small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where the counted rows are few; else leave the join to AQE."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


def ship(spark: SparkSession, files: tuple[str, ...] = ()) -> None:
    """Sends this package, and files such as a tokenizer's vocabulary, to the executors of a cluster; locally nothing is needed."""
    if spark.sparkContext.master.startswith("local["):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path("corpusloom") / f.relative_to(root)))
    spark.sparkContext.addPyFile(str(path))
    for f in files:
        spark.sparkContext.addFile(f)
