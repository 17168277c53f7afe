"""Reading speeches: CSV files, validated imports, landed pages and REST records, and the stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.functions.cleaning import html_to_text, listing_rows
from corpusloom.session import BROADCAST_ROWS

COLUMNS = ("Data", "Sessao", "Orador", "Partido", "Estado", "Fase", "Hora", "Discurso")
SPEECH = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
ACCENTED = "[áàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇ]"
LONG_TEXT, ACCENT_SHARE = 200, 0.5
#: Seconds to wait before each new try of a request, and the states worth one.
WAITS, RETRY = (5, 15, 45), frozenset({429, 500, 502, 503, 504})


class ImportRefused(ValueError):
    """A file that cannot be taken in, with the reason for the user."""


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One or more CSV files (globs work) with a header, all columns as text; a byte-order mark and spaces around names are dropped."""
    d = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", inferSchema=False)
    return d.toDF(*[c.strip().lstrip("﻿").strip('"') for c in d.columns])


def named(df: DataFrame) -> DataFrame:
    """The eight columns in order, all required; an accented heading is accepted."""
    d = df.withColumnRenamed("Sessão", "Sessao")
    missing = [c for c in COLUMNS if c not in d.columns]
    if missing:
        raise ImportRefused(f"columns missing: {', '.join(missing)}")
    return d.select(*[F.col(c).cast("string").alias(c) for c in COLUMNS])


def is_utf8(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether every file is valid UTF-8 (a replacement character that was written as such is valid), decoded piece by piece."""

    def bad(content: bytes) -> bool:
        import codecs

        read = codecs.getincrementaldecoder("utf-8")()
        try:
            for at in range(0, len(content), 1 << 20):
                read.decode(content[at : at + (1 << 20)])
            read.decode(b"", final=True)
        except UnicodeDecodeError:
            return True
        return False

    test = F.pandas_udf(lambda c: c.map(bad), "boolean")
    return not spark.read.format("binaryFile").load(path).select(test("content").alias("bad")).filter("bad").limit(1).count()


def accent_share(df: DataFrame, text: str = "Discurso") -> float | None:
    """Share of the long texts with an accented letter; null where there is no long text."""
    long = F.length(text) > LONG_TEXT
    return df.agg(F.avg(F.when(long, F.col(text).rlike(ACCENTED).cast("int"))).alias("s")).first()["s"]


def import_csv(spark: SparkSession, path: str) -> DataFrame:
    """A file as speeches: nulls become '', blank texts go. Refused: columns missing, not UTF-8, nothing left, most long texts without accents."""
    if not is_utf8(spark, path):
        raise ImportRefused("the file is not UTF-8")
    d = named(read_csv(spark, path)).fillna("").filter(F.col("Discurso").rlike(r"\S"))
    long = F.length("Discurso") > LONG_TEXT
    n, share = d.agg(F.count(F.lit(1)), F.avg(F.when(long, F.col("Discurso").rlike(ACCENTED).cast("int")))).first()  # one pass for both tests
    if not n:
        raise ImportRefused("no speech with text")
    if share is not None and share < ACCENT_SHARE:
        raise ImportRefused("the texts have lost their accents")
    return d


def stored(df: DataFrame, after: int = 0) -> DataFrame:
    """Imported rows in the stored schema, without URL; ids from the rows' place, above ``after``, the largest stored id."""
    low = df.select(*[F.col(c).alias(c.lower()) for c in COLUMNS])
    return low.select((F.monotonically_increasing_id() + 1 + after).alias("id"), F.lit(None).cast("string").alias("url"), *[c.lower() for c in COLUMNS], F.lit(0).alias("fetch_failures"))


# ---------------------------------------------------------------- landed pages

_ROW = "array<struct<data: string, sessao: string, fase: string, url: string, orador: string, hora: string>>"


def parse_listing(pages: DataFrame, base: str) -> DataFrame:
    """Rows of landed result pages (page, html), with name, party and state parsed, in page order, one per URL."""
    rows = F.pandas_udf(lambda h: pd.Series([listing_rows(x, base) for x in h]), _ROW)
    r = pages.select("page", F.posexplode(rows("html")).alias("pos", "r")).select("page", "pos", "r.*")
    who = X.parse_speaker(F.col("orador"))
    r = r.withColumn("who", who).select("page", "pos", "data", "sessao", "fase", "url", F.col("who.orador").alias("orador"), F.col("who.partido").alias("partido"), F.col("who.estado").alias("estado"), "hora")
    first = r.groupBy("url").agg(F.min(F.struct("page", "pos")).alias("f")).select("url", "f.page", "f.pos")
    return r.join(first, ["url", "page", "pos"])


def parse_totals(pages: DataFrame) -> DataFrame:
    """(page, total): documents found as the page says it: a number, 0, or null if it does not."""
    return pages.select("page", X.total_found(F.col("html")).alias("total"))


def parse_texts(pages: DataFrame) -> DataFrame:
    """(url, text) of landed speech pages (url, html)."""
    read = F.pandas_udf(lambda h: pd.Series([html_to_text(x) for x in h]), "string")
    return pages.select("url", read("html").alias("text"))


def speakers_of(listing: DataFrame) -> DataFrame:
    """Distinct names before the first comma or dash."""
    return listing.select(F.trim(F.split("orador", r"[,\-]")[0]).alias("orador")).filter("orador <> ''").distinct()


def match_speakers(names: DataFrame, people: DataFrame) -> DataFrame:
    """(orador, id): the person of exactly that name, else the first one whose name holds it or is held by it.

    People are a register: one of more rows than a broadcast may have is refused.
    """
    key = lambda c: X.norm_name(F.col(c))
    n = names.select("orador", key("orador").alias("k"))
    p = people.select("id", key("nome").alias("pk"))
    exact = n.join(p, n["k"] == p["pk"]).groupBy("orador").agg(F.min("id").alias("id"))
    rest = n.join(exact.select("orador"), "orador", "left_anti")
    if p.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"a register of more than {BROADCAST_ROWS} people")
    part = rest.join(F.broadcast(p), F.col("k").contains(F.col("pk")) | F.col("pk").contains(F.col("k"))).groupBy("orador").agg(F.min("id").alias("id"))
    return exact.unionByName(part)


_REST = "dataHoraInicio string, faseEvento struct<titulo: string>, tipoDiscurso string, transcricao string, sessao string"


def rest_speeches(records: DataFrame) -> DataFrame:
    """Landed REST records (json) in the speech columns: phase from the event or the kind, local date and hour from the ISO time."""
    return records.select(rest_speech(F.col("json")).alias("r")).select("r.*")


def rest_speech(json: Column) -> Column:
    r = F.from_json(json, _REST)
    t = F.try_to_timestamp(r["dataHoraInicio"])
    return F.struct(F.date_format(t, "dd/MM/yyyy").alias("data"), F.date_format(t, "HH'h'mm").alias("hora"), F.coalesce(r["faseEvento"]["titulo"], r["tipoDiscurso"]).alias("fase"), r["transcricao"].alias("discurso"))


def rest_pages(pages: DataFrame) -> DataFrame:
    """(entity, json): the records of landed REST pages (entity, page, body), page by page until an entity's first empty one."""
    body = F.from_json("body", "dados array<string>")["dados"]
    p = pages.select("entity", "page", F.coalesce(body, F.array().cast("array<string>")).alias("records"))
    ends = p.filter(F.size("records") == 0).groupBy("entity").agg(F.min("page").alias("end"))
    kept = p.join(ends, "entity", "left").filter(F.col("end").isNull() | (F.col("page") < F.col("end")))
    return kept.select("entity", "page", F.posexplode("records").alias("pos", "json"))


def hybrid(listing: DataFrame, people: DataFrame, pages: DataFrame, keywords: list[str]) -> DataFrame:
    """Speakers from one source, texts from another: the listing's speakers matched to people, these people's speeches with any of the keywords."""
    hit = match_speakers(speakers_of(listing), people)
    records = rest_pages(pages).join(hit.select(F.col("id").alias("entity"), "orador"), "entity")
    texts = records.select("orador", "entity", rest_speech(F.col("json")).alias("r")).select("orador", "entity", "r.*")
    return keyword_filter(texts, keywords)


def keyword_filter(df: DataFrame, keywords: list[str], text: str = "discurso") -> DataFrame:
    """Rows whose text holds any of the keywords, ignoring case."""
    import re

    return df.filter(F.col(text).rlike("(?iu)" + "|".join(map(re.escape, keywords))))


# ---------------------------------------------------------------- fetching, outside the engine


def fetch(get: Callable[[], tuple[int, str]], sleep: Callable[[float], None], waits: tuple[int, ...] = WAITS) -> str | None:
    """A page by the given request function, tried again after pauses on overload and time-outs; null otherwise."""
    for wait in (*waits, None):
        try:
            status, body = get()
        except TimeoutError:
            status, body = 503, ""
        if status == 200:
            return body
        if status not in RETRY or wait is None:
            return None
        sleep(wait)
    return None


def pages_of(get_page: Callable[[int], dict], most: int | None = None) -> Iterator[dict]:
    """Pages in order until one has no rows or names no next one."""
    n = 0
    while most is None or n < most:
        page = get_page(n + 1)
        if not page.get("rows"):
            return
        yield page
        if not page.get("next"):
            return
        n += 1


@dataclass(frozen=True)
class Request:
    """A checked analysis request."""

    keywords: tuple[str, ...]
    start: str
    end: str
    nr_topics: int | None = None
    threshold: float = 0.2

    def __post_init__(self) -> None:
        if not [k for k in self.keywords if k.strip()]:
            raise ValueError("no keyword")
        if self.start > self.end:
            raise ValueError("the period ends before it starts")
        if self.nr_topics is not None and not 2 <= self.nr_topics <= 200:
            raise ValueError("topics: 2 to 200")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold: 0 to 1")
