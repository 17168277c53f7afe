"""Bare word -> accented forms: building the map from a dictionary with frequencies, reading it, and warnings for keywords."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

ACCENTED_RATIO, BARE_RATIO = 0.01, 0.03


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(bare, forms) of a text file: bare TAB form SPACE form; # starts a comment."""
    lines = spark.read.text(path).filter("value <> '' AND NOT startswith(value, '#')")
    return lines.select(F.split("value", "\t")[0].alias("bare"), F.split(F.split("value", "\t")[1], " +").alias("forms"))


def build_map(words: DataFrame) -> DataFrame:
    """(bare, forms) from (word, freq): accented forms frequent enough beside the most frequent, by frequency, the bare word last.

    An accented form stays from 1 % of the group's highest frequency, the bare
    form from 3 %; a group without an accented form is no entry.
    """
    w = words.select(F.lower("word").alias("word"), "freq").groupBy("word").agg(F.max("freq").alias("freq")).withColumn("bare", T.strip_accents(F.col("word")))
    top = w.groupBy("bare").agg(F.max("freq").alias("top"))
    accented = F.col("word") != F.col("bare")
    keep = F.col("freq") >= F.col("top") * F.when(accented, ACCENTED_RATIO).otherwise(BARE_RATIO)
    kept = w.join(top, "bare").filter(keep)
    order = F.struct((~accented).alias("last"), (-F.col("freq")).alias("f"), "word")
    forms = kept.groupBy("bare").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["word"]).alias("forms"), F.max(accented).alias("any"))
    return forms.filter("any").select("bare", "forms")


def warnings_for(spark: SparkSession, keywords: list[str], forms: DataFrame) -> DataFrame:
    """(keyword, word, forms) for every distinct plain word of two letters and more that has accented forms."""
    rows = list(dict.fromkeys((k, w.lower()) for k in keywords for w in re.findall(r"[A-Za-z]{2,}", k) if all(ord(c) < 128 for c in w) and re.search(rf"(?<!\w){w}(?!\w)", k)))
    return spark.createDataFrame(rows, "keyword string, word string").join(forms.withColumnRenamed("bare", "word"), "word") if rows else spark.createDataFrame([], "word string, keyword string, forms array<string>")


def expand(stem: str, rules: dict[str, list[tuple[str, str, str]]], flags: str, depth: int = 2) -> set[str]:
    """Forms of a dictionary stem under suffix rules: (strip, add, condition), applied at most ``depth`` times."""
    out, edge = {stem}, {stem}
    for _ in range(depth):
        edge = {
            (w[: len(w) - len(strip)] if strip else w) + add
            for w in edge
            for f in flags
            for strip, add, cond in rules.get(f, ())
            if w.endswith(strip) and re.search(cond + "$", w)
        } - out
        out |= edge
    return {w for w in out if re.fullmatch(r"[a-záàâãéêíóôõúüç]+", w)}


def enclitic_stem(strip: str, add: str) -> bool:
    """Whether a suffix rule only turns an infinitive's last vowel into the accented stem before a joined pronoun (votar, votá-)."""
    plain = add.translate(str.maketrans("áâéêíóôú", "aaeeioou"))
    return strip.endswith("r") and plain == strip[:-1] and add != plain
