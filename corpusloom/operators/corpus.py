"""Preparation, counts, shares, rankings, deduplication and merging of a corpus of dated, attributed texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import dims
from corpusloom.functions import text as T

GROUPS = ("Esquerda", "Centro", "Direita")


# ------------------------------------------------------------ preparation


def with_dates(df: DataFrame, col: str = "data") -> DataFrame:
    """Adds ``data_dt``, ``ano``, ``mes``; rows whose date is not a valid dd/mm/yyyy go."""
    d = df.withColumn("data_dt", T.br_date(F.col(col))).filter("data_dt IS NOT NULL")
    return d.withColumn("ano", F.year("data_dt").cast("long")).withColumn("mes", F.month("data_dt").cast("long"))


def party_name(c: Column, classes: dict[str, str] | None = None) -> Column:
    """Known spellings by their party's name, ignoring case and outer spaces; others trimmed; null stays."""
    t = F.trim(c)
    return F.coalesce(dims.lookup(dims.canonical_spellings(classes), F.upper(t)), t)


def classified(df: DataFrame, classes: dict[str, str] | None = None) -> DataFrame:
    """Party spelling, then the guest rule (no two-letter state), then class and region."""
    guest = ~F.coalesce(F.col("estado"), F.lit("")).rlike(r"\A[A-Z]{2}\z")
    d = df.withColumn("partido", F.when(guest, dims.GUEST).otherwise(party_name(F.col("partido"), classes)))
    seven = {**dims.PARTY_CLASS, **(classes or {})}
    return d.withColumns(
        {
            "espectro7": F.coalesce(dims.lookup(seven, F.col("partido")), F.lit(dims.NO_CLASS)),
            "espectro": F.coalesce(dims.lookup(dims.classes_3(classes), F.col("partido")), F.lit(dims.NO_CLASS)),
            "regiao": F.coalesce(dims.lookup(dims.REGION, F.col("estado")), F.lit(dims.NO_REGION)),
        }
    )


def enough_rows(df: DataFrame, least: int = 50) -> bool:
    """Whether there are at least so many rows; reads no more than it needs."""
    return df.limit(least).count() >= least


# ------------------------------------------------------------ counts and shares


def counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows per group; rows with a null in any key are left out."""
    return df.dropna(subset=list(by)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, by: str, digits: int = 2) -> DataFrame:
    """Count and percent of all counted rows. The window is over the few groups, not the rows."""
    c = counts(df, by)
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select(by, "n", F.round(100.0 * F.col("n") / F.col("total"), digits).alias("pct"))


def shares_within(df: DataFrame, group: str, value: str, digits: int = 1) -> DataFrame:
    """Percent of each value inside its group."""
    c = counts(df, group, value)
    w = Window.partitionBy(group)
    return c.select(group, value, "n", F.round(100.0 * F.col("n") / F.sum("n").over(w), digits).alias("pct"))


def dense_shares(df: DataFrame, period: str, group: str) -> DataFrame:
    """Percent of each group inside each period, absent pairs as zero; periods and groups are few after counting."""
    c = counts(df, period, group)
    grid = c.select(period).distinct().crossJoin(F.broadcast(c.select(group).distinct()))
    full = grid.join(c, [period, group], "left").fillna(0, ["n"])
    return full.select(period, group, "n", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(period))).alias("pct"))


def dense_years(df: DataFrame, key: str) -> DataFrame:
    """Rows per key and year, zero filled over the corpus's first to last year."""
    c = counts(df, key, "ano")
    span = c.agg(F.min("ano").alias("a"), F.max("ano").alias("z")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "z")).alias("ano"))
    grid = c.select(key).distinct().crossJoin(F.broadcast(span))
    return grid.join(c, [key, "ano"], "left").fillna(0, ["n"])


def variation(df: DataFrame, key: str, top: int = 15) -> DataFrame:
    """Sample standard deviation over mean of the yearly counts, for the most frequent keys; nothing under two years."""
    keys = counts(df, key).orderBy(F.desc("n"), key).limit(top).select(key)
    y = dense_years(df, key).join(F.broadcast(keys), key, "left_semi")
    return y.groupBy(key).agg(F.round(F.stddev_samp("n") / F.avg("n"), 3).alias("cv"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("anos")).filter("anos >= 2").drop("anos")


def year_pairs(df: DataFrame, groups: tuple[str, ...], first: int, last: int) -> DataFrame:
    """Ordered pairs of groups with both yearly counts, zero filled over complete years."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "i int, espectro string")
    years = spark.range(first, last + 1).select(F.col("id").alias("ano"))
    c = counts(df.filter(F.col("espectro").isin(*groups)), "espectro", "ano")
    full = names.crossJoin(years).join(F.broadcast(c), ["espectro", "ano"], "left").fillna(0, ["n"])
    a, b = full.alias("a"), full.alias("b")
    return a.join(b, (F.col("a.ano") == F.col("b.ano")) & (F.col("a.i") < F.col("b.i"))).select(
        F.col("a.espectro").alias("g1"), F.col("b.espectro").alias("g2"), F.col("a.ano").alias("ano"), F.col("a.n").cast("double").alias("x"), F.col("b.n").cast("double").alias("y")
    )


def correlations(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("g1", "g2").agg(F.round(F.corr("x", "y"), 3).alias("r"), F.count(F.lit(1)).alias("n"))


def cosines(pairs: DataFrame) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))
    return pairs.groupBy("g1", "g2").agg(F.round(F.sum(F.col("x") * F.col("y")) / norm, 4).alias("cosine"))


def dictionary_codes(df: DataFrame, col: str) -> DataFrame:
    """Distinct values with 0-based codes in order; null reads '?'.

    Numbered by range partitions with offsets, so any number of values works.
    """
    from corpusloom.operators.range_partials import stitched_ranks

    v = df.select(F.coalesce(F.col(col), F.lit("?")).alias("value")).distinct().withColumn("all", F.lit(0))
    return stitched_ranks(v, ["all"], "value").select("value", (F.col("row_no") - 1).alias("code"))


# ------------------------------------------------------------ speakers


def top_speakers(df: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent speakers by folded name; guests left out.

    Counts by spelling, party and state are merged per speaker, so only counts are
    ever sorted within a speaker. Name: the most frequent spelling not all in
    capitals, else the most frequent in title case. Party: the most frequent, of
    equals the last seen, class as on its earliest row.
    """
    key = T.squeeze(T.fold(F.col("orador")))
    d = df.filter((F.coalesce(F.col("partido"), F.lit("?")) != dims.GUEST) & F.col("orador").isNotNull())
    d = d.select(key.alias("chave"), F.trim("orador").alias("nome"), F.coalesce("partido", F.lit("?")).alias("partido"), "estado", "espectro", F.col("data_dt"), "id").filter("chave <> ''")
    top = d.groupBy("chave").agg(F.count(F.lit(1)).alias("discursos")).orderBy(F.desc("discursos"), "chave").limit(n)
    d = d.join(F.broadcast(top), "chave")
    names = d.groupBy("chave", "nome").agg(F.count(F.lit(1)).alias("n"))
    mixed = (F.col("nome") != F.upper("nome")).cast("int")
    best_name = names.groupBy("chave").agg(F.max_by("nome", F.struct(mixed.alias("m"), "n", F.expr("-ascii(nome)").alias("c"), "nome")).alias("nome"))
    parties = d.groupBy("chave", "partido").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("data_dt", "id")).alias("seen"), F.min_by("espectro", F.struct("data_dt", "id")).alias("espectro"))
    listed = parties.groupBy("chave").agg(F.sort_array(F.collect_list(F.struct("n", "seen", "partido", "espectro")), asc=False).alias("p"))
    state = d.filter("estado IS NOT NULL").groupBy("chave", "estado").agg(F.count(F.lit(1)).alias("n")).groupBy("chave").agg(F.max_by("estado", F.struct("n", "estado")).alias("uf"))
    others = F.array_join(F.transform(F.slice("p", 2, 1000), lambda x: F.concat(x["partido"], F.lit(":"), x["n"].cast("string"))), ";")
    out = top.join(best_name, "chave").join(listed, "chave").join(state, "chave", "left")
    return out.select(
        T.display_name(F.col("nome")).alias("orador"),
        F.col("p")[0]["partido"].alias("partido"),
        F.coalesce("uf", F.lit("")).alias("uf"),
        F.col("p")[0]["espectro"].alias("espectro"),
        "discursos",
        others.alias("outros_partidos"),
    )


# ------------------------------------------------------------ duplicates and merging


def first_by_identity(df: DataFrame) -> DataFrame:
    """One row per speech: same date, speaker (any case, trimmed) and text; a row with URL first, then the lowest id.

    Rows without text are speeches of their own. Rows meet on two 64-bit hashes of
    the identity, so no text goes through the shuffle where the result does not ask for it.
    """
    text = F.coalesce("discurso", F.lit(""))
    key = F.struct(F.coalesce("data", F.lit("")).alias("d"), F.upper(F.trim(F.coalesce("orador", F.lit("")))).alias("o"), text.alias("t"))
    own = F.when(text == "", F.col("id"))
    d = df.withColumn("_h", F.xxhash64(key, own)).withColumn("_g", F.xxhash64(F.lit(1), own, key))
    w = Window.partitionBy("_h", "_g").orderBy(F.col("url").isNull(), "id")
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_h", "_g", "_r")


def keyword_union(df: DataFrame, order: str, col: str = "keywords") -> DataFrame:
    """Keywords of JSON arrays, one per case-insensitive spelling: the first met."""
    k = df.select(order, F.posexplode(F.from_json(col, "array<string>")).alias("pos", "keyword"))
    low = F.lower(F.trim("keyword"))
    firsts = k.withColumn("low", low).filter("low <> ''").groupBy("low").agg(F.min(F.struct(order, "pos", F.trim("keyword").alias("keyword"))).alias("f"))
    return firsts.select("f.keyword", F.col("f." + order).alias("first_in"))


def periods(datasets: DataFrame, links: DataFrame, speeches: DataFrame, ids: list[int]) -> DataFrame:
    """(id, status, inicio, fim) of the data sets; one without a period has the dates of its first and last speech."""
    dated = with_dates(links.filter(F.col("dataset_id").isin(*ids)).join(speeches.select(F.col("id").alias("speech_id"), "data"), "speech_id"))
    span = dated.groupBy(F.col("dataset_id").alias("id")).agg(F.min("data_dt").alias("first"), F.max("data_dt").alias("last"))
    d = datasets.filter(F.col("id").isin(*ids)).join(span, "id", "left")
    own = F.col("data_inicio").isNotNull() & (F.col("data_inicio") != "")
    return d.select("id", "status", F.when(own, F.to_date("data_inicio")).otherwise(F.col("first")).alias("inicio"), F.when(own, F.to_date("data_fim")).otherwise(F.col("last")).alias("fim"))


def merge_rows(datasets: DataFrame, links: DataFrame, speeches: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(head, rows): the common period and what forbids a merge, one row; each speech of the data sets once, and whether it lies inside.

    Repeats go first, then the period decides, so a speech whose kept row lies
    outside is outside.
    """
    d = periods(datasets, links, speeches, ids)
    head = d.agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("status") != "done").alias("open"), F.count_if(F.col("inicio").isNull()).alias("undated"), F.max("inicio").alias("inicio"), F.min("fim").alias("fim"))
    wanted = len(set(ids))
    error = (
        F.when(F.lit(wanted < 2), "at least two data sets")
        .when(F.col("found") < wanted, "unknown data set")
        .when(F.col("open") > 0, "unfinished data set")
        .when(F.col("undated") > 0, "no dated speech")
        .when(F.col("inicio") > F.col("fim"), "no common period")
        .otherwise("")
    )
    head = head.select("inicio", "fim", error.alias("error"))
    members = links.filter(F.col("dataset_id").isin(*ids)).select(F.col("speech_id").alias("id")).distinct()
    rows = first_by_identity(speeches.select("id", "url", "data", "orador", "discurso").join(members, "id", "left_semi"))
    rows = rows.select("id", (F.coalesce("discurso", F.lit("")) != "").alias("has_text"), T.br_date(F.col("data")).alias("day")).crossJoin(F.broadcast(head))
    inside = F.coalesce((F.col("error") == "") & F.col("day").between(F.col("inicio"), F.col("fim")), F.lit(False))
    return head, rows.select("id", "has_text", inside.alias("inside"))


def merge_plan(datasets: DataFrame, links: DataFrame, speeches: DataFrame, ids: list[int]) -> DataFrame:
    """What merging the data sets would give: the common period, speeches with text in the data sets, kept inside it, outside it, and repeated; ``error`` if it cannot be done."""
    head, rows = merge_rows(datasets, links, speeches, ids)
    texts = speeches.filter("discurso IS NOT NULL AND discurso <> ''").select(F.col("id").alias("speech_id"))
    n_in = links.filter(F.col("dataset_id").isin(*ids)).join(texts, "speech_id", "left_semi").agg(F.count(F.lit(1)).alias("rows_in"))
    n = rows.agg(F.count_if(F.col("has_text") & F.col("inside")).alias("kept"), F.count_if(F.col("has_text") & ~F.col("inside")).alias("outside"), F.count_if("has_text").alias("once"))
    return head.crossJoin(n_in).crossJoin(n).select("inicio", "fim", "rows_in", "kept", "outside", (F.col("rows_in") - F.col("once")).alias("repeated"), "error")


def merged(datasets: DataFrame, links: DataFrame, speeches: DataFrame, ids: list[int], new_id: int) -> DataFrame:
    """Links of the merged data set, from the rows of the plan: its speeches are shared, never copied; none if the plan has an error."""
    _, rows = merge_rows(datasets, links, speeches, ids)
    return rows.filter("inside").select(F.lit(new_id).cast("long").alias("dataset_id"), F.col("id").alias("speech_id"))


def merged_record(datasets: DataFrame, links: DataFrame, speeches: DataFrame, ids: list[int], new_id: int, name: str) -> DataFrame:
    """The row of the merged data set with where it comes from; no row if the plan has an error."""
    plan = merge_plan(datasets, links, speeches, ids).filter("error = ''")
    source = datasets.filter(F.col("id").isin(*ids)).agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("coletas"))
    words = keyword_union(datasets.filter(F.col("id").isin(*ids) & F.col("keywords").isNotNull()).select("id", "keywords"), "id").agg(F.to_json(F.array_sort(F.collect_list("keyword"))).alias("keywords"))
    j = plan.crossJoin(F.broadcast(source)).crossJoin(F.broadcast(words))
    origin = F.to_json(F.struct("coletas", F.col("outside").alias("fora_do_periodo")))
    return j.select(F.lit(new_id).cast("long").alias("id"), F.lit(name).alias("name"), F.lit("juncao").alias("source"), "keywords", F.date_format("inicio", "yyyy-MM-dd").alias("data_inicio"), F.date_format("fim", "yyyy-MM-dd").alias("data_fim"), F.lit("done").alias("status"), F.col("kept").alias("total_expected"), origin.alias("origem"))


def with_p(pairs: DataFrame, least: int = 5) -> DataFrame:
    """Correlations of at least five years with a two-sided p to four decimals."""
    from corpusloom.operators.series import pearson_p

    p = F.udf(lambda r, n: None if r is None else round(pearson_p(r, n), 4), "double")  # a row per pair of groups
    exact = pairs.groupBy("g1", "g2").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return exact.select("g1", "g2", F.round("r", 3).alias("r"), p("r", "n").alias("p"), "n")


def scrape_summary(speeches: DataFrame, first: int = 10) -> DataFrame:
    """One row: records, those with text, mean length of the texts, and whether any of the first texts has an accented letter."""
    text = F.when(F.col("discurso") != "", F.col("discurso"))
    head = speeches.filter("discurso <> ''").orderBy("id").limit(first).agg(F.coalesce(F.max(F.col("discurso").rlike("[áàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇ]")), F.lit(False)).alias("has_accents"))
    n = speeches.agg(F.count(F.lit(1)).alias("total"), F.count(text).alias("with_text"), F.round(F.sum(F.length(text)) / F.greatest(F.count(text), F.lit(1)), 4).alias("mean_length"))
    return n.crossJoin(head)
