"""Sources and sinks as queries: each writes or lands what the stored tables hold, reads it back, and gives what came through."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import catalog
from corpusloom.plans.tables import table
from corpusloom.session import shared_dir
from corpusloom.sources import readers, sinks

MODEL = "enc-largo-v2"


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _escaped(c: str) -> F.Column:
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Speeches exported as CSV parts and imported again: quotes, line ends and empty fields come through, blank texts go."""
    path = _folder(s, "csv")
    t = table(s, d, "speeches")
    sinks.write_csv_parts(t.select(*[F.col(c.lower()).alias(c) for c in readers.COLUMNS]), path)
    got = readers.import_csv(s, f"{path}/*.csv")
    return got.select(*[F.col(c).alias(c.lower()) for c in readers.COLUMNS if c != "Discurso"], F.length("Discurso").cast("long").alias("chars"))


def csv_ids(s: SparkSession, d: str) -> DataFrame:
    """Ids of two imports into one store: none is given twice."""
    path = _folder(s, "csv")
    sinks.write_csv_parts(table(s, d, "speeches").select(*[F.col(c.lower()).alias(c) for c in readers.COLUMNS]), path)
    first = readers.stored(readers.import_csv(s, f"{path}/*.csv"))
    most = first.agg(F.max("id")).first()[0] or 0
    both = first.select("id").unionByName(readers.stored(readers.import_csv(s, f"{path}/*.csv"), most).select("id"))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"))


def listing_pages(s: SparkSession, d: str) -> DataFrame:
    """Result pages of twenty rows each, made of the speeches with a URL, parsed to one row per URL."""
    t = table(s, d, "speeches").filter("url IS NOT NULL")
    cells = F.concat(*[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in (_escaped("data"), _escaped("sessao"), _escaped("fase"), F.concat(F.lit('<a href="'), F.col("url"), F.lit('">ver</a>')), F.lit(""), F.lit("ANA LIMA, PL-SP"), _escaped("hora"))])
    rows = t.select(F.floor(F.col("id") / 20).alias("page"), "id", F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("row"))
    pages = rows.groupBy("page").agg(F.concat(F.lit("<html><table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "row"))), lambda x: x["row"]), ""), F.lit("</table></html>")).alias("html"))
    return readers.parse_listing(pages, "").select("url", "data", "fase", "orador", "partido", "estado")


def text_pages(s: SparkSession, d: str) -> DataFrame:
    """Speech pages with the text after the rule, read back with white space single."""
    t = table(s, d, "speeches").filter("url IS NOT NULL AND discurso IS NOT NULL")
    pages = t.select("url", F.concat(F.lit("<html><p>Cabeçalho</p><hr><p>"), _escaped("discurso"), F.lit("</p></html>")).alias("html"))
    return readers.parse_texts(pages).select("url", F.length("text").cast("long").alias("chars"))


def rest_records(s: SparkSession, d: str) -> DataFrame:
    """Pages of REST records per party, read until a party's first empty page, as speeches."""
    t = table(s, d, "speeches").filter(r"partido IS NOT NULL AND hora RLIKE '^\\d{2}:\\d{2}$' AND data RLIKE '^\\d{2}/\\d{2}/\\d{4}$'").withColumn("day", F.try_to_date("data", "dd/MM/yyyy")).filter("day IS NOT NULL")
    body = F.to_json(F.struct(F.concat_ws("T", F.date_format("day", "yyyy-MM-dd"), "hora").alias("dataHoraInicio"), F.struct(F.col("fase").alias("titulo")).alias("faseEvento"), F.lit("DISCURSO").alias("tipoDiscurso"), F.coalesce("discurso", F.lit("")).alias("transcricao")))
    r = t.select(F.col("partido").alias("entity"), F.floor(F.col("id") / 100).alias("p"), "id", body.alias("json"))
    listed = r.groupBy("entity", "p").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("id", "json"))), lambda x: x["json"]).alias("dados"))).alias("body"))
    pages = listed.select("entity", F.col("p").alias("page"), "body").unionByName(listed.select("entity").distinct().select("entity", F.lit(10**12).alias("page"), F.lit('{"dados": []}').alias("body")))
    return readers.rest_speeches(readers.rest_pages(pages).select("json")).groupBy("data", "hora", "fase").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("discurso")).alias("chars"))


def speaker_register(s: SparkSession, d: str) -> DataFrame:
    """Speakers of the listing matched to the register of deputies by name."""
    names = table(s, d, "speeches").select("orador").filter("orador IS NOT NULL AND orador <> ''").distinct()
    people = table(s, d, "deputado_eventos").filter("nome IS NOT NULL").groupBy(F.col("nome")).agg(F.min("deputado_id").alias("id"))
    return readers.match_speakers(names, people).select("orador", "id")


def vector_cache(s: SparkSession, d: str) -> DataFrame:
    """Vectors appended to the cache twice, the second time with their sign turned: the latest is read."""
    v = table(s, d, "speech_embeddings")
    path = _folder(s, "vectors")
    sinks.append_vectors(v, path)
    sinks.append_vectors(v.withColumn("vector", F.transform("vector", lambda x: -x)), path)
    got = sinks.read_vectors(s, path, MODEL)
    return got.select("speech_id", F.size("vector").cast("long").alias("width"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def partition_overwrite(s: SparkSession, d: str) -> DataFrame:
    """Seats stored by legislature; one legislature's partition is replaced, the others stay."""
    t = table(s, d, "bancadas_posse").select("partido", "deputados", "legislatura")
    path = _folder(s, "seats")
    sinks.replace_partition(t, path, "legislatura")
    sinks.replace_partition(t.filter("legislatura = 56").withColumn("deputados", F.col("deputados") + 1), path, "legislatura")
    return s.read.parquet(path).select(F.col("legislatura").cast("long").alias("legislatura"), "partido", F.col("deputados").cast("long").alias("deputados"))


def json_document(s: SparkSession, d: str) -> DataFrame:
    """Data sets through a JSON document and back: dates as text, no value JSON lacks."""
    import json

    doc = sinks.document({"datasets": table(s, d, "datasets").select("id", "name", "created_at", F.lit(float("nan")).alias("nothing"))})
    rows = [(r["id"], r["name"], r["created_at"][:10] if r["created_at"] else "", r["nothing"] is None) for r in json.loads(json.dumps(doc))["datasets"]]
    return s.createDataFrame(rows, "id long, name string, created string, empty boolean")


def text_upsert(s: SparkSession, d: str) -> DataFrame:
    """A listing stored again: nothing new by URL, rows without one are added."""
    sp = table(s, d, "speeches").select("id", "url")
    return catalog.insert_if_absent(sp, sp, "url").agg(F.count(F.lit(1)).alias("added"))


QUERIES = {
    "csv_round_trip": csv_round_trip, "csv_ids": csv_ids, "listing_pages": listing_pages, "text_pages": text_pages, "rest_records": rest_records, "speaker_register": speaker_register,
    "vector_cache": vector_cache, "partition_overwrite": partition_overwrite, "json_document": json_document, "text_upsert": text_upsert,
}

_NORM = r"upper(regexp_replace(trim(regexp_replace(strip_accents({0}), '\s+', ' ', 'g')), '^[ .]+|[ .]+$', '', 'g'))"
SQL = {
    "csv_round_trip": "SELECT coalesce(data, '') AS data, coalesce(sessao, '') AS sessao, coalesce(orador, '') AS orador, coalesce(partido, '') AS partido, coalesce(estado, '') AS estado, coalesce(fase, '') AS fase, coalesce(hora, '') AS hora, length(discurso) AS chars FROM speeches WHERE regexp_matches(discurso, '\\S')",
    "csv_ids": "SELECT 2 * count(*) AS n_rows, 2 * count(*) AS n_ids FROM speeches WHERE regexp_matches(discurso, '\\S')",
    "listing_pages": r"SELECT url, trim(regexp_replace(coalesce(data, ''), '\s+', ' ', 'g')) AS data, trim(regexp_replace(coalesce(fase, ''), '\s+', ' ', 'g')) AS fase, 'ANA LIMA' AS orador, 'PL' AS partido, 'SP' AS estado FROM speeches WHERE url IS NOT NULL",
    "text_pages": r"SELECT url, length(trim(regexp_replace(discurso, '[\s\p{Z}]+', ' ', 'g'))) AS chars FROM speeches WHERE url IS NOT NULL AND discurso IS NOT NULL",
    "rest_records": r"""SELECT data, regexp_replace(hora, ':', 'h') AS hora, coalesce(fase, 'DISCURSO') AS fase, count(*) AS n, CAST(sum(length(coalesce(discurso, ''))) AS BIGINT) AS chars FROM speeches
WHERE partido IS NOT NULL AND regexp_full_match(hora, '\d{2}:\d{2}') AND regexp_full_match(data, '\d{2}/\d{2}/\d{4}') AND try_strptime(data, '%d/%m/%Y') IS NOT NULL GROUP BY 1, 2, 3""",
    "speaker_register": f"""WITH n AS (SELECT DISTINCT orador, {_NORM.format('orador')} AS k FROM speeches WHERE orador <> ''), p AS (SELECT min(deputado_id) AS id, {_NORM.format('nome')} AS pk FROM deputado_eventos WHERE nome IS NOT NULL GROUP BY nome),
e AS (SELECT orador, min(id) AS id FROM n JOIN p ON k = pk GROUP BY 1) SELECT * FROM e UNION ALL SELECT orador, min(id) AS id FROM n JOIN p ON contains(k, pk) OR contains(pk, k) WHERE orador NOT IN (SELECT orador FROM e) GROUP BY 1""",
    "vector_cache": f"SELECT speech_id, len(vector) AS width, round(list_sum(list_transform(vector, lambda x: -(x::DOUBLE))), 4) AS total FROM speech_embeddings WHERE model = '{MODEL}'",
    "partition_overwrite": "SELECT CAST(legislatura AS BIGINT) AS legislatura, partido, CAST(deputados + (legislatura = 56)::INT AS BIGINT) AS deputados FROM bancadas_posse",
    "json_document": "SELECT id, name, coalesce(strftime(created_at, '%Y-%m-%d'), '') AS created, true AS empty FROM datasets",
    "text_upsert": "SELECT count(*) AS added FROM speeches WHERE url IS NULL",
}
