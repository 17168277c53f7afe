"""Vocabulary extras, reports, streaming, and the core's independence of the subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import pytest
from corpusloom.functions import dims
from corpusloom.operators import accents, report, vocabulary
from corpusloom.streaming import ingest

ROOT = Path(__file__).resolve().parents[1]


def test_core_never_imports_the_subpackage():
    for p in (ROOT / "corpusloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "corpusloom.llm" not in p.read_text() and "from .llm" not in p.read_text()
    code = "import sys; sys.modules['corpusloom.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('p3_')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_log_odds(spark):
    rows = [(f"{g}{i}", g, "comum " * 2 + ("alfa" if g == "a" else "beta")) for g in "ab" for i in range(10)]
    d = spark.createDataFrame(rows, "id string, g string, discurso string")
    got = {(r["g"], r["word"]): r for r in vocabulary.characteristic(d, "g", ("a", "b"), frozenset()).collect()}
    assert ("a", "alfa") in got and ("b", "beta") in got and ("a", "beta") not in got and ("a", "comum") not in got
    assert got[("a", "alfa")]["discursos"] == 10 and got[("a", "alfa")]["pct"] == 100.0 and got[("a", "alfa")]["pct_outros"] == 0.0


def test_content_and_exclusion(spark):
    t = spark.createDataFrame([("casa", "NOUN"), ("casa", "VERB"), ("ir", "VERB"), (None, "X")], "word string, tag string")
    n = vocabulary.non_content(t)
    assert [r["word"] for r in n.collect()] == ["ir"]
    common = spark.createDataFrame([("de",)], "form string")
    assert {r["word"] for r in vocabulary.excluded({"o"}, common, n).collect()} == {"o", "de", "ir"}


def test_diverse():
    v = np.array([[1, 0], [0.99, 0.01], [0.6, 0.8]])
    assert vocabulary.diverse(["a", "b", "c"], v, [1, 0.2], 2, 0.7) == ["b", "c"] or vocabulary.diverse(["a", "b", "c"], v, [1, 0.2], 2, 0.7)[1] == "c"
    assert vocabulary.diverse(["a"], v[:1], [1, 0]) == ["a"]


def test_enclitic_stems():
    assert accents.enclitic_stem("ar", "á") and not accents.enclitic_stem("ar", "a") and not accents.enclitic_stem("o", "os")


def test_report(spark):
    o = report.Options()
    assert report.methodology(spark, o, 1483).filter("value = '15'").count() == 2
    assert report.methodology(spark, report.Options(consensus=False)).filter("stage = 'consensus'").count() == 0
    assert report.options()["min_rows"] == 50 and len(o.seeds) == 15
    d = spark.createDataFrame([(1, 0), (2, 0), (3, -1)], "id int, topic int")
    assert [(r["topic"], r["n"]) for r in report.topic_info(d).collect()] == [(0, 2), (-1, 1)]
    report.tag_stage(spark, "topics", 0.5)


def test_renamed(spark):
    d = spark.createDataFrame([("PMDB",), ("PT",)], "p string").select(dims.renamed(F.col("p")).alias("p"))
    assert [r["p"] for r in d.collect()] == ["MDB", "PT"]


def test_stream_drops_repeats(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")]
    d = spark.createDataFrame(rows, "event_id long, t string").selectExpr("event_id", "cast(t as timestamp_ntz) ts", "1L user_id", "'a' event_type", "1.0D value", "'{}' props")
    for _ in range(2):  # the same page twice
        d.write.mode("append").parquet(str(tmp_path / "in"))
    s = ingest.once(ingest.event_stream(spark, str(tmp_path / "in")), "event_id", "ts", "1 day")
    assert sorted(r["event_id"] for r in ingest.run_to_table(s.select("event_id")).collect()) == [1, 2]


def test_change_feed(spark, tmp_path):
    src = str(tmp_path / "s")
    q, seen = None, []
    spark.createDataFrame([(1, 1, "running"), (1, 2, "done"), (2, 1, "running")], "id long, ts long, status string").write.parquet(src)
    stream = spark.readStream.schema("id long, ts long, status string").parquet(src)
    q = ingest.change_feed(stream, "status", seen.extend, str(tmp_path / "c"))
    try:
        q.processAllAvailable()
        spark.createDataFrame([(1, 3, "done"), (2, 2, "failed")], "id long, ts long, status string").write.mode("append").parquet(src)
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(seen) == [(1, "done"), (2, "failed"), (2, "running")]
    # after a restart only what differs is emitted
    spark.createDataFrame([(1, 4, "done"), (2, 3, "done")], "id long, ts long, status string").write.mode("append").parquet(src)
    q = ingest.change_feed(stream, "status", seen.extend, str(tmp_path / "c"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(seen) == [(1, "done"), (2, "done"), (2, "failed"), (2, "running")]


def test_no_local_folder_on_a_cluster():
    from corpusloom import session

    class Conf:
        def get(self, *_):
            return None

    class Dir:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Dir()})()})()

        def getConf(self):
            return Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(type("Spark", (), {"sparkContext": Context(), "conf": Conf()})())
