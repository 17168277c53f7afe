"""Counts, shares, correlations, rankings and text statistics of the speeches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import dims
from corpusloom.functions import text as T
from corpusloom.operators import corpus, vocabulary
from corpusloom.operators import series as _series
from corpusloom.plans.tables import CLEAN, END, START, prepared, table

YEARS = _series.complete_years(START, END)

KEYWORDS = ("violência doméstica", "violência", "creche", "orçamento municipal", "rede de postos de saúde")
#: Themes as patterns on the lower-cased text.
THEMES = {
    "violencia": "violência|feminicídio|delegacia da mulher|medida protetiva", "saude": "saúde|hospital|farmácia|vacinação|cirurgias", "educacao": "escola|creche|ensino|professores|alunos|biblioteca",
    "seguranca": "polici|presídio|fronteira|tráfico|perícia", "economia": "orçamento|fiscal|tribut|juros|receitas|despesas", "trabalho": "trabalho|salário|aposentadoria|emprego|previdência",
    "ambiente": "desmatamento|queimada|garimpo|manejo|estuário|florestal", "agua": "água|seca|cisterna|dessalinização|barragem|irrigação", "transporte": "rodovia|ferrovia|ponte|asfalto|estrada|balsa|aeroporto|porto seco",
}


def clean_rows(s: SparkSession, d: str) -> DataFrame:
    return prepared(s, d).select("id", F.date_format("data_dt", "yyyy-MM-dd").alias("data_dt"), "ano", "mes", "partido", "espectro7", "espectro", "regiao")


def yearly_count(s: SparkSession, d: str) -> DataFrame:
    return corpus.counts(prepared(s, d), "ano")


def yearly_group_count(s: SparkSession, d: str) -> DataFrame:
    return corpus.counts(prepared(s, d), "ano", "espectro")


def yearly_group_share(s: SparkSession, d: str) -> DataFrame:
    return corpus.dense_shares(prepared(s, d), "ano", "espectro").withColumn("pct", F.round("pct", 6))


def _counted(by: str):
    return lambda s, d: corpus.counts(prepared(s, d), by)


def _shared(by: str):
    return lambda s, d: corpus.shares(prepared(s, d), by)


def topn_party(s: SparkSession, d: str) -> DataFrame:
    return corpus.counts(prepared(s, d), "partido").orderBy(F.desc("n"), "partido").limit(15)


def region_share_by_class(s: SparkSession, d: str) -> DataFrame:
    return corpus.shares_within(prepared(s, d), "espectro", "regiao")


def party_share_of_year(s: SparkSession, d: str) -> DataFrame:
    return corpus.shares_within(prepared(s, d), "ano", "partido", 4)


def cv_by_party(s: SparkSession, d: str) -> DataFrame:
    return corpus.variation(prepared(s, d), "partido").select("partido", "n", "cv")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return corpus.year_pairs(prepared(s, d), corpus.GROUPS, YEARS[0], YEARS[-1])


def pearson_pairs(s: SparkSession, d: str) -> DataFrame:
    return corpus.correlations(_pairs(s, d))


def cosine_pairs(s: SparkSession, d: str) -> DataFrame:
    return corpus.cosines(_pairs(s, d))


def speaker_profile(s: SparkSession, d: str) -> DataFrame:
    t = corpus.top_speakers(prepared(s, d))
    return t.select(T.squeeze(T.fold(F.col("orador"))).alias("speaker"), "partido", "uf", "espectro", "discursos")


def dict_codes(s: SparkSession, d: str) -> DataFrame:
    return corpus.dictionary_codes(table(s, d, "speeches"), "fase")


def party_phase_profile(s: SparkSession, d: str) -> DataFrame:
    """Share of the eight most frequent phases inside each of the fifteen most frequent parties."""
    p = prepared(s, d)
    phases = corpus.counts(p, "fase").orderBy(F.desc("n"), "fase").limit(8).select("fase")
    parties = corpus.counts(p, "partido").orderBy(F.desc("n"), "partido").limit(15).select("partido", F.col("n").alias("total"))
    c = corpus.counts(p, "partido", "fase").join(F.broadcast(phases), "fase").join(F.broadcast(parties), "partido")
    return c.select("partido", "fase", "total", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


def modal_class(s: SparkSession, d: str) -> DataFrame:
    """The class most of a party's rows carry, the smallest name of equals."""
    c = corpus.counts(prepared(s, d), "partido", "espectro")
    return c.groupBy("partido").agg(F.min_by("espectro", F.struct((-F.col("n")).alias("m"), "espectro")).alias("espectro"), F.sum("n").alias("n"))


def corpus_stats(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "speeches")
    words = F.when(F.col("discurso").rlike(r"\S"), T.word_count(F.col("discurso")))
    return t.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(words).alias("with_text"),
        F.countDistinct("partido").alias("partidos"),
        F.countDistinct("orador").alias("oradores"),
        F.countDistinct("estado").alias("estados"),
        F.sum(words).alias("words"),
        F.round(F.avg(words), 4).alias("words_mean"),
        F.median(words).alias("words_median"),
        F.max(words).cast("long").alias("words_max"),
        F.min(words).cast("long").alias("words_min"),
    )


def theme_flags(s: SparkSession, d: str) -> DataFrame:
    """Percent of the rows of each class whose text touches each theme."""
    low = F.lower(F.coalesce("discurso", F.lit("")))
    p = prepared(s, d).select("espectro", *[low.rlike(rx).cast("int").alias(k) for k, rx in THEMES.items()])
    return p.groupBy("espectro").agg(*[F.round(100 * F.avg(k), 4).alias(k) for k in THEMES])


def _texts(s: SparkSession, d: str) -> DataFrame:
    return prepared(s, d).filter("discurso IS NOT NULL").select("id", "espectro", "partido", "discurso")


def keyword_share(s: SparkSession, d: str) -> DataFrame:
    """Percent of texts that hold each keyword, per class and overall, on the folded original text."""
    t = _texts(s, d).withColumn("f", T.fold(F.col("discurso")))
    t = t.select("espectro", *[F.col("f").rlike(T.keyword_pattern(k)).cast("int").alias(f"k{i}") for i, k in enumerate(KEYWORDS)])
    g = t.groupingSets([["espectro"], []], "espectro").agg(F.count(F.lit(1)).alias("n"), *[F.round(100 * F.avg(f"k{i}"), 4).alias(f"k{i}") for i in range(len(KEYWORDS))])
    return g.withColumn("espectro", F.coalesce("espectro", F.lit("*")))


def mention_summary(s: SparkSession, d: str) -> DataFrame:
    """Median mentions of any keyword per text and the percent of texts with exactly one; a place several keywords fit counts once."""
    c = F.regexp_count(T.fold(F.col("discurso")), F.lit(T.any_keyword_pattern(KEYWORDS)))
    t = _texts(s, d).select("espectro", c.alias("c"))
    g = t.groupingSets([["espectro"], []], "espectro").agg(F.count(F.lit(1)).alias("n"), F.median("c").alias("median_mentions"), F.round(100 * F.avg((F.col("c") == 1).cast("int")), 4).alias("one_pct"))
    return g.withColumn("espectro", F.coalesce("espectro", F.lit("*")))


def ubiquitous_words(s: SparkSession, d: str) -> DataFrame:
    return vocabulary.ubiquitous(_texts(s, d))


def top_words_by_group(s: SparkSession, d: str) -> DataFrame:
    return vocabulary.top_words(_texts(s, d), "espectro", dims.stopwords())


def characteristic_words(s: SparkSession, d: str) -> DataFrame:
    return vocabulary.characteristic(_texts(s, d), "espectro", corpus.GROUPS, dims.stopwords() | dims.party_words(dims.INVENTED_CLASS)).withColumn("z", F.round("z", 4))


def ctfidf(s: SparkSession, d: str) -> DataFrame:
    return vocabulary.ctfidf(_texts(s, d), "espectro", dims.stopwords()).withColumn("weight", F.round("weight", 6))


def term_diversity(s: SparkSession, d: str) -> DataFrame:
    return vocabulary.diversity(vocabulary.top_words(_texts(s, d), "espectro", dims.stopwords(), 10))


QUERIES = {
    "clean_rows": clean_rows, "yearly_count": yearly_count, "yearly_group_count": yearly_group_count, "yearly_group_share": yearly_group_share,
    "value_counts_party": _counted("partido"), "value_counts_region": _counted("regiao"), "value_counts_uf": _counted("estado"), "value_counts_phase": _counted("fase"),
    "share_of_phase": _shared("fase"), "share_of_region": _shared("regiao"), "topn_party": topn_party, "region_share_by_class": region_share_by_class, "party_share_of_year": party_share_of_year,
    "cv_by_party": cv_by_party, "pearson_pairs": pearson_pairs, "cosine_pairs": cosine_pairs, "speaker_profile": speaker_profile, "dict_codes": dict_codes,
    "party_phase_profile": party_phase_profile, "modal_class": modal_class, "corpus_stats": corpus_stats, "theme_flags": theme_flags,
    "keyword_share": keyword_share, "mention_summary": mention_summary, "ubiquitous_words": ubiquitous_words, "top_words_by_group": top_words_by_group,
    "characteristic_words": characteristic_words, "ctfidf": ctfidf, "term_diversity": term_diversity,
}


def _with(body: str) -> str:
    return f"WITH {CLEAN} {body}"


def _stop(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


_COUNT = "SELECT {0}, count(*) AS n FROM clean WHERE {0} IS NOT NULL GROUP BY 1"
_SHARE = "SELECT {0}, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM clean WHERE {0} IS NOT NULL GROUP BY 1"
_WITHIN = "SELECT {0}, {1}, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY {0}), {2}) AS pct FROM clean WHERE {0} IS NOT NULL AND {1} IS NOT NULL GROUP BY 1, 2"
_YEARS = """y AS (SELECT g, yr, (SELECT count(*) FROM clean WHERE espectro = g AND ano = yr)::DOUBLE AS n, i FROM (VALUES ('Esquerda', 0), ('Centro', 1), ('Direita', 2)) t(g, i), range(2002, 2025) r(yr)),
p AS (SELECT a.g AS g1, b.g AS g2, a.n AS x, b.n AS y FROM y a JOIN y b ON a.yr = b.yr AND a.i < b.i)"""
_LONG = "unnest(regexp_extract_all(lower(discurso), '[a-záàâãéèêíïóôõúüç]{4,}'))"
_TOK = r"regexp_extract_all(lower(discurso), '\p{L}+')"
_BARE = "regexp_replace(strip_accents(lower(discurso)), '[\\x{0300}-\\x{036F}]', '', 'g')"


def _key_rx(k: str) -> str:
    return r"(^|[^\p{L}\p{N}_])" + T.keyword_body(k).replace("\\ ", " ") + r"([^\p{L}\p{N}_]|$)"


_ALL = sorted(dict.fromkeys(map(T.keyword_body, KEYWORDS)), key=len, reverse=True)
SQL = {
    "clean_rows": _with("SELECT id, CAST(data_dt AS VARCHAR) AS data_dt, ano, mes, partido, espectro7, espectro, regiao FROM clean"),
    "yearly_count": _with(_COUNT.format("ano")),
    "yearly_group_count": _with("SELECT ano, espectro, count(*) AS n FROM clean GROUP BY 1, 2"),
    "yearly_group_share": _with("""SELECT a.ano, e.espectro, count(c.id) AS n, round(100.0 * count(c.id) / sum(count(c.id)) OVER (PARTITION BY a.ano), 6) AS pct FROM (SELECT DISTINCT ano FROM clean) a
CROSS JOIN (SELECT DISTINCT espectro FROM clean) e LEFT JOIN clean c ON c.ano = a.ano AND c.espectro = e.espectro GROUP BY 1, 2"""),
    "value_counts_party": _with(_COUNT.format("partido")), "value_counts_region": _with(_COUNT.format("regiao")), "value_counts_uf": _with(_COUNT.format("estado")), "value_counts_phase": _with(_COUNT.format("fase")),
    "share_of_phase": _with(_SHARE.format("fase")), "share_of_region": _with(_SHARE.format("regiao")),
    "topn_party": _with(_COUNT.format("partido") + " ORDER BY n DESC, partido LIMIT 15"),
    "region_share_by_class": _with(_WITHIN.format("espectro", "regiao", 1)), "party_share_of_year": _with(_WITHIN.format("ano", "partido", 4)),
    "cv_by_party": _with("""SELECT partido, CAST(sum(n) AS BIGINT) AS n, round(stddev_samp(n) / avg(n), 3) AS cv FROM (SELECT p.partido, r.yr, count(c.id) AS n
FROM (SELECT partido FROM clean WHERE partido IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, partido LIMIT 15) p CROSS JOIN (SELECT unnest(range(min(ano), max(ano) + 1)) AS yr FROM clean) r
LEFT JOIN clean c ON c.partido = p.partido AND c.ano = r.yr GROUP BY 1, 2) GROUP BY 1"""),
    "pearson_pairs": _with(f", {_YEARS} SELECT g1, g2, round(corr(x, y), 3) AS r, count(*) AS n FROM p GROUP BY 1, 2".replace("WITH", "")),
    "cosine_pairs": _with(f", {_YEARS} SELECT g1, g2, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 4) AS cosine FROM p GROUP BY 1, 2"),
    "dict_codes": "SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT coalesce(fase, '?') AS value FROM speeches)",
    "party_phase_profile": _with("""SELECT c.partido, c.fase, any_value(p.n) AS total, round(100.0 * count(*) / any_value(p.n), 1) AS pct FROM clean c
JOIN (SELECT partido, count(*) AS n FROM clean WHERE partido IS NOT NULL GROUP BY 1 ORDER BY n DESC, partido LIMIT 15) p USING (partido)
JOIN (SELECT fase, count(*) AS n FROM clean WHERE fase IS NOT NULL GROUP BY 1 ORDER BY n DESC, fase LIMIT 8) f USING (fase) GROUP BY 1, 2"""),
    "modal_class": _with("SELECT partido, espectro, n FROM (SELECT partido, espectro, CAST(sum(count(*)) OVER (PARTITION BY partido) AS BIGINT) AS n, row_number() OVER (PARTITION BY partido ORDER BY count(*) DESC, espectro) AS r FROM clean WHERE partido IS NOT NULL GROUP BY 1, 2) WHERE r = 1"),
    "corpus_stats": r"""SELECT count(*) AS n_rows, count(w) AS with_text, count(DISTINCT partido) AS partidos, count(DISTINCT orador) AS oradores, count(DISTINCT estado) AS estados, CAST(sum(w) AS BIGINT) AS words,
round(avg(w), 4) AS words_mean, median(w) AS words_median, max(w) AS words_max, min(w) AS words_min FROM (SELECT *, CASE WHEN regexp_matches(discurso, '\S') THEN len(list_filter(regexp_split_to_array(discurso, '\s+'), lambda x: x <> '')) END AS w FROM speeches)""",
    "theme_flags": _with("SELECT espectro, " + ", ".join(f"round(100 * avg(regexp_matches(lower(coalesce(discurso, '')), '{rx}')::INT), 4) AS {k}" for k, rx in THEMES.items()) + " FROM clean GROUP BY 1"),
    "keyword_share": _with(f", f AS (SELECT espectro, {_BARE} AS f FROM clean WHERE discurso IS NOT NULL) SELECT coalesce(espectro, '*') AS espectro, count(*) AS n, " + ", ".join(f"round(100 * avg(regexp_matches(f, '{_key_rx(k)}')::INT), 4) AS k{i}" for i, k in enumerate(KEYWORDS)) + " FROM f GROUP BY GROUPING SETS ((espectro), ())"),
    "mention_summary": _with(f""", f AS (SELECT espectro, len(regexp_extract_all({_BARE}, '\\b(?:{"|".join(_ALL)})\\b')) AS c FROM clean WHERE discurso IS NOT NULL)
SELECT coalesce(espectro, '*') AS espectro, count(*) AS n, median(c) AS median_mentions, round(100 * avg((c = 1)::INT), 4) AS one_pct FROM f GROUP BY GROUPING SETS ((espectro), ())"""),
    "top_words_by_group": _with(f""", w AS (SELECT espectro, {_LONG} AS word FROM clean WHERE discurso IS NOT NULL)
SELECT espectro, word, n FROM (SELECT espectro, word, count(*) AS n, row_number() OVER (PARTITION BY espectro ORDER BY count(*) DESC, word) AS r FROM w WHERE word NOT IN {_stop(dims.stopwords())} GROUP BY 1, 2) WHERE r <= 25"""),
    "ctfidf": _with(f""", w AS (SELECT espectro, {_LONG} AS word FROM clean WHERE discurso IS NOT NULL), c AS (SELECT espectro, word, count(*) AS n FROM w WHERE word NOT IN {_stop(dims.stopwords())} GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY espectro) AS total, sum(n) OVER (PARTITION BY word) AS f, count(*) OVER (PARTITION BY word) AS classes FROM c), a AS (SELECT sum(n)::DOUBLE / count(DISTINCT espectro) AS avg_words FROM c)
SELECT espectro, word, weight FROM (SELECT espectro, word, round(sqrt(n / total) * ln(1 + avg_words / f), 6) AS weight, row_number() OVER (PARTITION BY espectro ORDER BY sqrt(n / total) * ln(1 + avg_words / f) DESC, word) AS r FROM t, a WHERE classes >= 2) WHERE r <= 25"""),
}
_WORDS = r"list_filter(regexp_extract_all(lower(discurso), '[\p{L}\p{M}\p{Nd}\p{Pc}]+'), lambda x: regexp_full_match(x, '[\p{L}\p{M}]{2,}'))"
#: Pronouns joined to verbs go, twice since neighbours share the character between them; then the words.
_JOINED = r"'(^|[^\p{L}\p{M}\p{Nd}\p{Pc}])[\p{L}\p{M}]+-(?:me|te|se|lhe|lhes|nos|vos|o|a|os|as|lo|la|los|las|no|na|nas)([^\p{L}\p{M}\p{Nd}\p{Pc}]|$)', '\1 \2', 'gi'"
_PLAIN_WORDS = _WORDS.replace("lower(discurso)", f"lower(regexp_replace(regexp_replace(discurso, {_JOINED}), {_JOINED}))")
_FORM = "regexp_replace(strip_accents(form), '[\\x{0300}-\\x{036F}]', '', 'g')"
SQL["ubiquitous_words"] = _with(f""", w AS (SELECT id, unnest(list_distinct({_WORDS})) AS form FROM clean WHERE discurso IS NOT NULL), f AS (SELECT id, form, {_FORM} AS b FROM w),
k AS (SELECT id, form, CASE WHEN b LIKE '%s' AND length(b) > 3 THEN left(b, length(b) - 1) ELSE b END AS key FROM f), d AS (SELECT key, count(DISTINCT id) AS n_docs FROM k GROUP BY 1)
SELECT DISTINCT form, key, n_docs FROM k JOIN d USING (key) WHERE n_docs >= 0.5 * (SELECT count(*) FROM clean WHERE discurso IS NOT NULL)""")
SQL["term_diversity"] = _with(f""", w AS (SELECT espectro, {_LONG} AS word FROM clean WHERE discurso IS NOT NULL),
t AS (SELECT word FROM (SELECT espectro, word, row_number() OVER (PARTITION BY espectro ORDER BY count(*) DESC, word) AS r FROM w WHERE word NOT IN {_stop(dims.stopwords())} GROUP BY 1, 2) WHERE r <= 10)
SELECT round(count(DISTINCT word) / count(*), 4) AS diversity, count(*) AS n FROM t""")
SQL["speaker_profile"] = _with(r""", d AS (SELECT *, trim(regexp_replace(regexp_replace(strip_accents(lower(orador)), '[\x{0300}-\x{036F}]', '', 'g'), '\s+', ' ', 'g')) AS chave, trim(orador) AS nome, coalesce(partido, '?') AS p FROM clean WHERE coalesce(partido, '?') <> 'CONVIDADO' AND orador IS NOT NULL),
top AS (SELECT chave, count(*) AS discursos FROM d WHERE chave <> '' GROUP BY 1 ORDER BY discursos DESC, chave LIMIT 10),
pp AS (SELECT chave, p, count(*) AS n, max(struct_pack(a := data_dt, b := id)) AS seen, arg_min(espectro, struct_pack(a := data_dt, b := id)) AS espectro FROM d GROUP BY 1, 2),
bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chave ORDER BY n DESC, seen DESC) AS r FROM pp) WHERE r = 1),
uf AS (SELECT * FROM (SELECT chave, estado, row_number() OVER (PARTITION BY chave ORDER BY count(*) DESC, estado DESC) AS r FROM d WHERE estado IS NOT NULL GROUP BY 1, 2) WHERE r = 1)
SELECT t.chave AS speaker, bp.p AS partido, coalesce(uf.estado, '') AS uf, bp.espectro, t.discursos FROM top t JOIN bp USING (chave) LEFT JOIN uf USING (chave)""")
SQL = {k: v.replace(") , ", "), ") for k, v in SQL.items()}



def _kept(words) -> str:
    return f"list_filter({_PLAIN_WORDS}, lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in sorted(words)) + "], w))"


_PAIRS = "list_filter(list_transform(range(1, len(t)), lambda i: CASE WHEN t[i] <> t[i + 1] THEN t[i] || ' ' || t[i + 1] END), lambda x: x IS NOT NULL)"
TOKEN_SQL = f"""WITH k AS (SELECT id, {_kept(dims.stopwords())} AS t FROM speeches WHERE discurso IS NOT NULL),
f AS (SELECT id, t, list_transform(t, lambda w: regexp_replace(strip_accents(w), '[\\x{{0300}}-\\x{{036F}}]', '', 'g')) AS b FROM k)
SELECT id, len(t) AS n_tokens, len(list_distinct(list_transform(b, lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN w[:-2] ELSE w END))) AS n_keys, len({_PAIRS}) AS n_pairs FROM f"""
SQL["characteristic_words"] = _with(f""", k AS (SELECT id, espectro, {_kept(dims.stopwords() | dims.party_words(dims.INVENTED_CLASS))} AS t FROM clean WHERE discurso IS NOT NULL AND espectro IN ('Esquerda', 'Centro', 'Direita')),
w AS (SELECT espectro, unnest(list_distinct(list_concat(t, {_PAIRS}))) AS word FROM k), c AS (SELECT espectro, word, count(*) AS y FROM w GROUP BY 1, 2), ca AS (SELECT *, sum(y) OVER (PARTITION BY word) AS alpha FROM c), cf AS (SELECT * FROM ca WHERE alpha >= 5),
n AS (SELECT *, sum(y) OVER (PARTITION BY espectro) AS ni, sum(y) OVER () AS a0 FROM cf), d AS (SELECT espectro, count(*) AS docs, sum(count(*)) OVER () AS all_docs FROM k GROUP BY 1),
z AS (SELECT n.espectro, word, y, alpha - y AS o, docs, all_docs, (ln((y + alpha) / (ni + a0 - y - alpha)) - ln((2 * alpha - y) / (2 * a0 - ni - 2 * alpha + y))) / sqrt(1 / (y + alpha) + 1 / (2 * alpha - y)) AS z FROM (SELECT espectro, word, y::DOUBLE AS y, alpha::DOUBLE AS alpha, ni::DOUBLE AS ni, a0::DOUBLE AS a0 FROM n) n JOIN d USING (espectro))
SELECT espectro, word, round(z, 4) AS z, CAST(y AS BIGINT) AS discursos, round(100 * y / docs, 1) AS pct, round(100 * o / CASE WHEN all_docs > docs THEN all_docs - docs END, 1) AS pct_outros FROM (SELECT *, row_number() OVER (PARTITION BY espectro ORDER BY z DESC, word) AS r FROM z WHERE z > 0) WHERE r <= 25""")
