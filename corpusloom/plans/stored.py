"""Queries over the stored tables: listings, joins, upserts, deletes and merges."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import catalog, corpus, series
from corpusloom.plans.tables import _DATE, table

MODEL = "enc-largo-v2"


def _t(s: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(s, d, n) for n in names]


def dataset_listing(s: SparkSession, d: str) -> DataFrame:
    return catalog.dataset_listing(*_t(s, d, "datasets", "dataset_speeches", "speeches"))


def dataset_frame(s: SparkSession, d: str) -> DataFrame:
    return catalog.dataset_frame(*_t(s, d, "dataset_speeches", "speeches"), 1).select("id", "data", "orador", "partido", "estado", "fase", "hora", "discurso")


def vector_count(s: SparkSession, d: str) -> DataFrame:
    links, v = _t(s, d, "dataset_speeches", "speech_embeddings")
    return links.join(v.select("speech_id", "model"), "speech_id").groupBy("dataset_id", "model").agg(F.count(F.lit(1)).alias("n"))


def vector_scan(s: SparkSession, d: str) -> DataFrame:
    """Vectors of one model for the speeches of one data set."""
    links, v = _t(s, d, "dataset_speeches", "speech_embeddings")
    hit = v.filter(F.col("model") == MODEL).join(links.filter("dataset_id = 1").select("speech_id"), "speech_id", "left_semi")
    return hit.select("speech_id", F.size("vector").cast("long").alias("width"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2"))


def run_listing(s: SparkSession, d: str) -> DataFrame:
    """Runs with their data set's name and parsed parameters, newest first."""
    r, ds = _t(s, d, "runs", "datasets")
    p = F.from_json("params", "model string, nr_topics int, threshold double")
    j = r.withColumn("p", p).join(ds.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset")), "dataset_id")
    topics = F.from_json("summary", "topicos long")["topicos"]
    return j.select("id", "dataset", "status", F.col("p.model").alias("model"), F.col("p.threshold").alias("threshold"), F.coalesce(topics, F.lit(0)).alias("topics")).orderBy(F.desc("id"))


def missing_vectors(s: SparkSession, d: str) -> DataFrame:
    return catalog.missing_vectors(*_t(s, d, "dataset_speeches", "speeches", "speech_embeddings"), MODEL)


def orphans_anti(s: SparkSession, d: str) -> DataFrame:
    links, sp = _t(s, d, "dataset_speeches", "speeches")
    return catalog.orphans(links.filter("dataset_id <> 1"), sp)


def dedup_keep_first(s: SparkSession, d: str) -> DataFrame:
    sp = table(s, d, "speeches").select("id", "url", "data", "orador", "discurso")
    return corpus.first_by_identity(sp.filter("discurso IS NOT NULL AND discurso <> ''")).select("id", F.col("url").isNotNull().alias("has_url"))


def keyword_union(s: SparkSession, d: str) -> DataFrame:
    return corpus.keyword_union(table(s, d, "datasets").select("id", "keywords"), "id")


def merge_plan(s: SparkSession, d: str) -> DataFrame:
    p = corpus.merge_plan(*_t(s, d, "datasets", "dataset_speeches", "speeches"), _done(s, d))
    return p.select(F.coalesce(F.date_format("inicio", "yyyy-MM-dd"), F.lit("")).alias("inicio"), F.coalesce(F.date_format("fim", "yyyy-MM-dd"), F.lit("")).alias("fim"), "rows_in", "kept", "outside", "repeated", "error")


def _done(s: SparkSession, d: str) -> list[int]:
    """The first two finished data sets with a period and the first without."""
    done = table(s, d, "datasets").filter("status = 'done'")
    first = done.filter("data_inicio IS NOT NULL AND data_fim IS NOT NULL").orderBy("id").limit(2).unionByName(done.filter("data_inicio IS NULL").orderBy("id").limit(1))
    return [r["id"] for r in first.select("id").collect()]


def merge_links(s: SparkSession, d: str) -> DataFrame:
    return corpus.merged(*_t(s, d, "datasets", "dataset_speeches", "speeches"), _done(s, d), 1000)


def merge_record(s: SparkSession, d: str) -> DataFrame:
    """The merged data set's own row, with where it comes from."""
    return corpus.merged_record(*_t(s, d, "datasets", "dataset_speeches", "speeches"), _done(s, d), 1000, "junção").select("id", "name", "source", "data_inicio", "data_fim", "status", "total_expected")


def run_states(s: SparkSession, d: str) -> DataFrame:
    """Running runs are set to failed with a message, pending ones deleted."""
    r = table(s, d, "runs").select("id", "status", "error")
    change = r.filter("status = 'running'").select("id", F.lit("failed").alias("status"), F.lit("interrompida").alias("error"))
    pending = [x["id"] for x in r.filter("status = 'pending'").select("id").collect()]  # runs are catalog entries
    return catalog.deleted(catalog.set_state(r, change), pending).select("id", "status", F.coalesce("error", F.lit("")).alias("error"))


def cached_totals(s: SparkSession, d: str) -> DataFrame:
    c = catalog.cached_totals(table(s, d, "plenary_month_totals"))
    return c.select("month", F.coalesce("total", F.lit(-1)).alias("total"), F.date_format("fetched", "yyyy-MM-dd").alias("fetched"))


def month_total_plan(s: SparkSession, d: str) -> DataFrame:
    """Totals of a period that begins and ends inside a month: what the store answers and what has to be asked for."""
    p = series.total_plan(s, table(s, d, "plenary_month_totals"), date(2003, 2, 10), date(2024, 11, 20))
    return p.select("month", F.date_format("first", "yyyy-MM-dd").alias("first_day"), F.date_format("last", "yyyy-MM-dd").alias("last_day"), "whole", F.coalesce("total", F.lit(-1)).alias("total"))


def scrape_summary(s: SparkSession, d: str) -> DataFrame:
    return corpus.scrape_summary(table(s, d, "speeches").select("id", "discurso"))


def insert_if_absent(s: SparkSession, d: str) -> DataFrame:
    """Odd ids stand for what is stored, all rows for a new listing: what would be added, and what of it lacks a text."""
    sp = table(s, d, "speeches").select("id", "url", "discurso")
    stored = sp.join(table(s, d, "dataset_speeches").filter("dataset_id = 1").select(F.col("speech_id").alias("id")), "id", "left_semi")
    new = catalog.insert_if_absent(stored, sp.filter("url IS NOT NULL"), "url")
    return new.select("id", F.col("discurso").isNull().alias("pending"))


def upsert_totals(s: SparkSession, d: str) -> DataFrame:
    """Month totals with a later fetch of every month, one higher."""
    t = table(s, d, "plenary_month_totals")
    new = t.withColumn("total", F.col("total") + 1).withColumn("fetched_at", F.expr("fetched_at + interval 1 day"))
    return catalog.upsert(t, new, ["month"], "fetched_at").select("month", F.coalesce("total", F.lit(-1)).alias("total"))


def replace_seats(s: SparkSession, d: str) -> DataFrame:
    """The seats of one legislature replaced by new ones, the others kept."""
    t = table(s, d, "bancadas_posse").select("legislatura", "partido", "deputados")
    new = t.filter("legislatura = 56").withColumn("deputados", F.col("deputados") + 1)
    return catalog.replace_where(t, new, ["legislatura"]).select(F.col("legislatura").cast("long").alias("legislatura"), "partido", F.col("deputados").cast("long").alias("deputados"))


def save_texts(s: SparkSession, d: str) -> DataFrame:
    """A second pass over the speeches without text: those with a URL are found, the others fail once more."""
    sp = table(s, d, "speeches")
    fetched = sp.filter("discurso IS NULL").select("id", F.when(F.col("url").isNotNull(), F.lit("texto")).alias("text"))
    return catalog.save_texts(sp, fetched).select("id", F.col("discurso").isNull().alias("lacks_text"), F.col("fetch_failures").cast("long").alias("fetch_failures"))


def cascade_delete(s: SparkSession, d: str) -> DataFrame:
    out = catalog.without_datasets([1, 3, 5], *_t(s, d, "datasets", "dataset_speeches", "speeches", "speech_embeddings"))
    parts = [t.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")) for n, t in out.items()]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def startup_repair(s: SparkSession, d: str) -> DataFrame:
    ds, r = _t(s, d, "datasets", "runs")
    a = ds.select(F.lit("dataset").alias("kind"), "id", catalog.repaired_status(F.col("status"), "dataset").alias("status"))
    return a.unionByName(r.select(F.lit("run").alias("kind"), "id", catalog.repaired_status(F.col("status"), "run").alias("status")))


def seats_map(s: SparkSession, d: str) -> DataFrame:
    """Seats per legislature as one ordered text of party:n, stars dropped."""
    t = table(s, d, "bancadas_posse").groupBy("legislatura", F.rtrim(F.col("partido"), F.lit("*")).alias("partido")).agg(F.sum("deputados").alias("n"))
    m = F.array_sort(F.collect_list(F.concat("partido", F.lit(":"), F.col("n").cast("string"))))
    return t.groupBy(F.col("legislatura").cast("long").alias("legislatura")).agg(F.array_join(m, ";").alias("partidos"))


def concat_dedupe(s: SparkSession, d: str) -> DataFrame:
    """First row per date, speaker and hour of the concatenated tables."""
    sp = table(s, d, "speeches").select("id", "data", "orador", "hora")
    both = sp.unionByName(sp)
    return both.groupBy("data", "orador", "hora").agg(F.min("id").alias("id")).select("id")


QUERIES = {
    "dataset_listing": dataset_listing, "dataset_frame": dataset_frame, "vector_count": vector_count, "vector_scan": vector_scan, "run_listing": run_listing, "anti_missing_embeddings": missing_vectors,
    "orphans_anti": orphans_anti, "dedup_keep_first": dedup_keep_first, "keyword_union": keyword_union, "merge_periods": merge_plan, "merge_links": merge_links, "merge_record": merge_record, "run_states": run_states, "cached_totals": cached_totals, "month_total_plan": month_total_plan, "scrape_summary": scrape_summary, "insert_if_absent": insert_if_absent,
    "upsert_totals": upsert_totals, "replace_seats": replace_seats, "save_texts": save_texts, "cascade_delete": cascade_delete, "startup_repair": startup_repair, "seats_map": seats_map, "concat_dedupe": concat_dedupe,
}

_FIRST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(data, ''), upper(trim(coalesce(orador, ''))), coalesce(discurso, '') ORDER BY url IS NULL, id) AS r FROM {0}) WHERE r = 1"""
_MERGE = f"""WITH src AS (SELECT * FROM (SELECT * FROM datasets WHERE status = 'done' AND data_inicio IS NOT NULL AND data_fim IS NOT NULL ORDER BY id LIMIT 2) UNION ALL (SELECT * FROM datasets WHERE status = 'done' AND data_inicio IS NULL ORDER BY id LIMIT 1)),
dt AS (SELECT *, {_DATE} AS day FROM speeches), sp AS (SELECT l.dataset_id, min(day) AS a, max(day) AS z FROM dt JOIN dataset_speeches l ON l.speech_id = dt.id GROUP BY 1),
h AS (SELECT max(coalesce(CAST(data_inicio AS DATE), a)) AS inicio, min(CASE WHEN data_inicio IS NULL THEN z ELSE CAST(data_fim AS DATE) END) AS fim FROM src LEFT JOIN sp ON sp.dataset_id = src.id),
m AS (SELECT dt.*, coalesce(discurso, '') <> '' AS has FROM dt JOIN dataset_speeches l ON l.speech_id = dt.id WHERE l.dataset_id IN (SELECT id FROM src)),
u AS (SELECT DISTINCT id, url, data, orador, discurso, day, has FROM m),
k AS (SELECT id, has, coalesce(day BETWEEN h.inicio AND h.fim, false) AS inside FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN has THEN -1 ELSE id END, coalesce(data, ''), upper(trim(coalesce(orador, ''))), coalesce(discurso, '') ORDER BY url IS NULL, id) AS r FROM u), h WHERE r = 1)"""
_TEXT = "discurso IS NOT NULL AND discurso <> ''"
SQL = {
    "dataset_listing": """SELECT d.id, any_value(d.name) AS name, any_value(d.status) AS status, count(s.id) AS n_speeches, count(s.discurso) AS n_text, CAST(sum(CASE WHEN s.id IS NOT NULL AND s.discurso IS NULL AND s.fetch_failures > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed
FROM datasets d LEFT JOIN dataset_speeches l ON l.dataset_id = d.id LEFT JOIN speeches s ON s.id = l.speech_id GROUP BY d.id""",
    "dataset_frame": f"SELECT s.id, data, orador, partido, estado, fase, hora, discurso FROM speeches s JOIN dataset_speeches l ON l.speech_id = s.id WHERE l.dataset_id = 1 AND {_TEXT}",
    "vector_count": "SELECT dataset_id, model, count(*) AS n FROM dataset_speeches JOIN speech_embeddings USING (speech_id) GROUP BY 1, 2",
    "vector_scan": f"SELECT speech_id, len(vector) AS width, round(list_sum(list_transform(vector, lambda x: x::DOUBLE * x)), 4) AS norm2 FROM speech_embeddings WHERE model = '{MODEL}' AND speech_id IN (SELECT speech_id FROM dataset_speeches WHERE dataset_id = 1)",
    "run_listing": "SELECT r.id, d.name AS dataset, r.status, params->>'model' AS model, (params->>'threshold')::DOUBLE AS threshold, coalesce((summary->>'topicos')::BIGINT, 0) AS topics FROM runs r JOIN datasets d ON d.id = r.dataset_id",
    "anti_missing_embeddings": f"SELECT DISTINCT s.id FROM speeches s JOIN dataset_speeches l ON l.speech_id = s.id WHERE {_TEXT} AND NOT EXISTS (SELECT 1 FROM speech_embeddings e WHERE e.speech_id = s.id AND e.model = '{MODEL}')",
    "orphans_anti": "SELECT id FROM speeches s WHERE NOT EXISTS (SELECT 1 FROM dataset_speeches l WHERE l.speech_id = s.id AND l.dataset_id <> 1)",
    "dedup_keep_first": f"SELECT id, url IS NOT NULL AS has_url FROM ({_FIRST.format(f'(SELECT * FROM speeches WHERE {_TEXT})')})",
    "keyword_union": """WITH k AS (SELECT id, trim(unnest(from_json(keywords, '["VARCHAR"]'))) AS keyword, unnest(range(len(from_json(keywords, '["VARCHAR"]')))) AS pos FROM datasets WHERE keywords IS NOT NULL)
SELECT keyword, id AS first_in FROM (SELECT *, row_number() OVER (PARTITION BY lower(keyword) ORDER BY id, pos) AS r FROM k WHERE keyword <> '') WHERE r = 1""",
    "merge_periods": f"{_MERGE} SELECT CAST(inicio AS VARCHAR) AS inicio, CAST(fim AS VARCHAR) AS fim, (SELECT count(*) FROM m WHERE has) AS rows_in, (SELECT count(*) FROM k WHERE has AND inside) AS kept, (SELECT count(*) FROM k WHERE has AND NOT inside) AS outside, (SELECT count(*) FROM m WHERE has) - (SELECT count(*) FROM k WHERE has) AS repeated, CASE WHEN inicio > fim THEN 'no common period' ELSE '' END AS error FROM h",
    "merge_links": f"{_MERGE} SELECT CAST(1000 AS BIGINT) AS dataset_id, id AS speech_id FROM k WHERE inside",
    "merge_record": f"{_MERGE} SELECT CAST(1000 AS BIGINT) AS id, 'junção' AS name, 'juncao' AS source, CAST(inicio AS VARCHAR) AS data_inicio, CAST(fim AS VARCHAR) AS data_fim, 'done' AS status, (SELECT count(*) FROM k WHERE has AND inside) AS total_expected FROM h WHERE inicio <= fim",
    "run_states": "SELECT id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN 'interrompida' ELSE coalesce(error, '') END AS error FROM runs WHERE status <> 'pending'",
    "cached_totals": "SELECT month, coalesce(arg_max(total, fetched_at), -1) AS total, CAST(CAST(max(fetched_at) AS DATE) AS VARCHAR) AS fetched FROM plenary_month_totals GROUP BY 1",
    "month_total_plan": """WITH c AS (SELECT CAST(unnest(generate_series(DATE '2003-02-01', DATE '2024-11-20', INTERVAL 1 MONTH)) AS DATE) AS m), p AS (SELECT m, greatest(m, DATE '2003-02-10') AS a, least(last_day(m), DATE '2024-11-20') AS z FROM c)
SELECT strftime(m, '%Y-%m') AS month, CAST(a AS VARCHAR) AS first_day, CAST(z AS VARCHAR) AS last_day, a = m AND z = last_day(m) AS whole, coalesce(CASE WHEN a = m AND z = last_day(m) AND CAST(t.fetched_at AS DATE) >= last_day(m) + 90 THEN t.total END, -1) AS total FROM p LEFT JOIN plenary_month_totals t ON t.month = strftime(m, '%Y-%m')""",
    "scrape_summary": "WITH f AS (SELECT discurso FROM speeches WHERE discurso <> '' ORDER BY id LIMIT 10) SELECT count(*) AS total, count(*) FILTER (discurso <> '') AS with_text, round(sum(length(discurso)) FILTER (discurso <> '')::DOUBLE / count(*) FILTER (discurso <> ''), 4) AS mean_length, (SELECT bool_or(regexp_matches(discurso, '[áàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇ]')) FROM f) AS has_accents FROM speeches",
    "insert_if_absent": "SELECT id, discurso IS NULL AS pending FROM speeches WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM speeches JOIN dataset_speeches ON speech_id = id WHERE dataset_id = 1 AND url IS NOT NULL)",
    "upsert_totals": "SELECT month, coalesce(total + 1, -1) AS total FROM plenary_month_totals",
    "replace_seats": "SELECT CAST(legislatura AS BIGINT) AS legislatura, partido, CAST(deputados + (legislatura = 56)::INT AS BIGINT) AS deputados FROM bancadas_posse",
    "save_texts": "SELECT id, discurso IS NULL AND url IS NULL AS lacks_text, CAST(fetch_failures + (discurso IS NULL AND url IS NULL)::INT AS BIGINT) AS fetch_failures FROM speeches",
    "cascade_delete": """WITH l AS (SELECT * FROM dataset_speeches WHERE dataset_id NOT IN (1, 3, 5)) SELECT 'datasets' AS table_name, count(*) AS n FROM datasets WHERE id NOT IN (1, 3, 5) UNION ALL SELECT 'dataset_speeches', count(*) FROM l
UNION ALL SELECT 'speeches', count(*) FROM speeches WHERE id IN (SELECT speech_id FROM l) UNION ALL SELECT 'speech_embeddings', count(*) FROM speech_embeddings WHERE speech_id IN (SELECT speech_id FROM l)""",
    "startup_repair": "SELECT 'dataset' AS kind, id, CASE WHEN status = 'running' THEN 'interrupted' ELSE status END AS status FROM datasets UNION ALL SELECT 'run', id, CASE WHEN status IN ('pending', 'running') THEN 'failed' ELSE status END FROM runs",
    "seats_map": "SELECT CAST(legislatura AS BIGINT) AS legislatura, string_agg(p || ':' || n, ';' ORDER BY p || ':' || n) AS partidos FROM (SELECT legislatura, rtrim(partido, '*') AS p, CAST(sum(deputados) AS BIGINT) AS n FROM bancadas_posse GROUP BY 1, 2) GROUP BY 1",
    "concat_dedupe": "SELECT min(id) AS id FROM speeches GROUP BY data, orador, hora",
}
