"""What an analysis says about itself: its parameters as a table, its options, its topics, its progress."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.cleaning import CLEANING_VERSION
from corpusloom.operators import series, topics, vocabulary

MIN_ROWS = 50


@dataclass(frozen=True)
class Options:
    """Parameters of an analysis, with their defaults."""

    model: str = "enc-largo-v2"
    nr_topics: int | None = None
    consensus: bool = True
    runs: int = 15
    first_seed: int = 42
    second_topic: float = topics.SECOND
    ubiquitous_share: float = vocabulary.UBIQUITOUS_SHARE
    chunk_words: int = 5000

    @property
    def seeds(self) -> list[int]:
        return list(range(self.first_seed, self.first_seed + (self.runs if self.consensus else 1)))


def options() -> dict:
    return {"defaults": asdict(Options()), "min_rows": MIN_ROWS}


def methodology(spark: SparkSession, o: Options, n: int | None = None) -> DataFrame:
    """(stage, parameter, value, note): every parameter that shapes the result; consensus rows only with a consensus."""
    size = str(topics.min_cluster_size(n)) if n is not None else "max(15, 1 %)"
    rows = [
        ("preparation", "date format", "d/M/yyyy", "rows with another date are left out"),
        ("preparation", "cleaning version", str(CLEANING_VERSION), "the main speaker's words, without opening and closing formulas"),
        ("vectors", "model", o.model, "stored vectors are reused"),
        ("vectors", "chunk", f"{o.chunk_words} words", "chunk vectors are averaged"),
        ("topics", "least group", size, "smaller groups are noise"),
        ("topics", "reduction", str(o.nr_topics) if o.nr_topics else "none", "closest topics are merged"),
        ("topics", "seeds", f"{o.seeds[0]}-{o.seeds[-1]}" if len(o.seeds) > 1 else str(o.seeds[0]), "fixed, for repeatability"),
    ]
    if o.consensus:
        rows += [("consensus", "runs", str(o.runs), "records together in most runs share a topic"), ("consensus", "cut", str(topics.CUT), "average linkage"), ("consensus", "second topic", str(o.second_topic), "least co-membership of a further topic")]
    rows += [
        ("vocabulary", "ubiquitous words", str(o.ubiquitous_share), "left out from this share of the texts on"),
        ("vocabulary", "least documents", str(vocabulary.MIN_DOCS), "of a characteristic word"),
        ("trends", "annual test", f"{series.MIN_YEARS} complete years", f"Mann-Kendall, p < {series.ALPHA}"),
        ("trends", "seasonal test", f"{series.MIN_MONTHS} months", "summed over calendar months"),
    ]
    return spark.createDataFrame(rows, "stage string, parameter string, value string, note string")


def topic_info(labels: DataFrame) -> DataFrame:
    """(topic, n): records per topic, noise included, largest first."""
    return labels.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic")


def tag_stage(spark: SparkSession, stage: str, done: float) -> None:
    """Progress of a run as the description of its jobs, for listeners and the event log."""
    spark.sparkContext.setJobDescription(f"{stage} {done:.0%}")
