"""Topic queries over the stored vectors, and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import cleaning, dims
from corpusloom.functions import text as T
from corpusloom.operators import accents, corpus, fit, topics
from corpusloom.plans.statistics import _BARE as FOLDED
from corpusloom.plans.statistics import KEYWORDS, TOKEN_SQL, _key_rx
from corpusloom.plans.tables import CLEAN, prepared, table
from corpusloom.session import cut

MODEL = "enc-largo-v2"
SEEDS = list(range(42, 42 + fit.RUNS))
K = 12


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "speech_embeddings").filter(F.col("model") == MODEL).select(F.col("speech_id").alias("id"), "vector").dropDuplicates(["id"])


def _fixed_centroids(s: SparkSession, d: str) -> DataFrame:
    """The eight vectors of smallest id as centroids: a stand-in any engine can repeat."""
    first = _vectors(s, d).select("id", topics.unit().alias("centroid")).filter("centroid IS NOT NULL").orderBy("id").limit(8)
    ids = [r["id"] for r in first.select("id").collect()]
    number = F.create_map(*[x for i, v in enumerate(ids) for x in (F.lit(v), F.lit(i))])
    return first.select(number[F.col("id")].alias("topic"), "centroid")


def nearest_centroid(s: SparkSession, d: str) -> DataFrame:
    n = topics.nearest(_vectors(s, d), _fixed_centroids(s, d))
    return n.select("id", F.col("topic").cast("long").alias("topic"), F.round("cosine", 5).alias("cosine"))


def _topics(s: SparkSession, d: str) -> DataFrame:
    n = topics.nearest(_vectors(s, d), _fixed_centroids(s, d))
    return n.select("id", F.when(F.col("cosine") >= 0.05, F.col("topic")).otherwise(topics.NOISE).alias("topic"))


def _topic_rows(s: SparkSession, d: str) -> DataFrame:
    return prepared(s, d).join(_topics(s, d), "id")


def topic_freq(s: SparkSession, d: str) -> DataFrame:
    return corpus.shares(_topic_rows(s, d).filter("topic <> -1").withColumn("topic", F.col("topic").cast("long")), "topic")


def topic_share(group: str):
    return lambda s, d: topics.share_by(_topic_rows(s, d).withColumn("topic", F.col("topic").cast("long")), group)


def topic_year_counts(s: SparkSession, d: str) -> DataFrame:
    return corpus.dense_years(_topic_rows(s, d).filter("topic <> -1").withColumn("topic", F.col("topic").cast("long")), "topic")


def party_topic_profile(s: SparkSession, d: str) -> DataFrame:
    """Shares of the eight most frequent topics inside each of the fifteen parties with most rows of a topic, and the party's modal class."""
    t = _topic_rows(s, d).filter("topic <> -1 AND partido IS NOT NULL").withColumn("topic", F.col("topic").cast("long"))
    top = corpus.counts(t, "topic").orderBy(F.desc("n"), "topic").limit(8).select("topic")
    parties = corpus.counts(t, "partido").orderBy(F.desc("n"), "partido").limit(15).select("partido", F.col("n").alias("total"))
    modal = corpus.counts(t, "partido", "espectro").groupBy("partido").agg(F.min_by("espectro", F.struct((-F.col("n")).alias("m"), "espectro")).alias("espectro"))
    c = corpus.counts(t, "partido", "topic").join(F.broadcast(top), "topic", "left_semi").join(F.broadcast(parties), "partido").join(F.broadcast(modal), "partido")
    return c.select("partido", "espectro", "topic", "total", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


def _stored_runs(s: SparkSession, d: str) -> DataFrame:
    """Three assignments any engine can repeat: the sign patterns of three pairs of coordinates; some rows are noise."""
    v = _vectors(s, d).select("id", F.col("vector").alias("v")).filter("v[0] <> 0")

    def one(r: int) -> DataFrame:
        cluster = 2 * (F.col("v")[2 * r] > 0).cast("int") + (F.col("v")[2 * r + 1] > 0).cast("int")
        return v.filter(F.abs(F.col("v")[10]) > 0.01 * r).select(F.lit(r).alias("run"), "id", cluster.alias("cluster"))

    return one(0).unionByName(one(1)).unionByName(one(2))


def membership_linear(s: SparkSession, d: str) -> DataFrame:
    """Mean co-membership of every record with every topic, on the stored assignments; the first is the topic."""
    runs = _stored_runs(s, d)
    core = runs.filter("run = 0").select("id", F.col("cluster").alias("topic"))
    m = topics.membership(runs, core, 3)
    return m.select("id", F.col("topic").cast("long").alias("topic"), F.round("value", 8).alias("value")).filter("value > 0")


def consensus_topics(s: SparkSession, d: str) -> DataFrame:
    """Records with their consensus topic, certainty and further topics."""
    v = _vectors(s, d)
    runs = topics.seeded_runs(v, K, SEEDS)
    t = topics.consensus(runs, len(SEEDS), topics.min_cluster_size(v.count()))
    return topics.labels_of(topics.membership(runs, t, len(SEEDS)), t).select("id", "topic", "certainty", "unsure", F.array_join(F.transform("topics", lambda x: x.cast("string")), ";").alias("topics"))


def consensus_summary(s: SparkSession, d: str) -> DataFrame:
    v = _vectors(s, d)
    runs = topics.seeded_runs(v, K, SEEDS)
    t = topics.consensus(runs, len(SEEDS), topics.min_cluster_size(v.count()))
    lab = topics.labels_of(topics.membership(runs, t, len(SEEDS)), t)
    return topics.model_summary(lab, topics.reassigned(v, t))


def kmeans_grid(s: SparkSession, d: str) -> DataFrame:
    """k from 10 to 70 by silhouette and by diversity of words."""
    texts = table(s, d, "speeches").filter("discurso IS NOT NULL").select("id", "discurso")
    v = _vectors(s, d)
    return topics.kmeans_grid(v, range(10, 71, 10), fit.word_counts(texts.join(v.select("id"), "id", "left_semi"), dims.stopwords()))


def _model(s: SparkSession, d: str) -> fit.Model:
    return fit.fit(_vectors(s, d), table(s, d, "speeches").filter("discurso IS NOT NULL").select("id", "discurso"), K, dims.stopwords())


def fit_topics(s: SparkSession, d: str) -> DataFrame:
    """Topic, certainty and label of every speech with a vector, from the fitted model."""
    m = _model(s, d)
    return m.records.join(F.broadcast(m.labels.select("topic", "label")), "topic").select("id", "topic", "label", "certainty", "unsure", F.size("topics").alias("n_topics"), "moved")


def fit_statistics(s: SparkSession, d: str) -> DataFrame:
    """Per topic of the fitted model: speeches, keyword shares on the original text, mentions on the cleaned one, and years of appearance."""
    m = _model(s, d)
    t = fit.with_topics(prepared(s, d).filter("discurso IS NOT NULL"), m).filter("topic IS NOT NULL")
    t = cut(cleaning.with_clean_text(t).select("id", "topic", "ano", "discurso", cleaning.TEXT_COLUMN))
    share, mention = fit.keyword_share(t, KEYWORDS), fit.mention_summary(t, KEYWORDS, cleaning.TEXT_COLUMN)
    years = t.groupingSets([["topic"], []], "topic").agg(F.min("ano").alias("first_year"), F.max("ano").alias("last_year"))
    both = share.withColumn("t", F.coalesce("topic", F.lit(-2))).join(mention.select(F.coalesce("topic", F.lit(-2)).alias("t"), "median_mentions", "one_pct"), "t").join(years.select(F.coalesce("topic", F.lit(-2)).alias("t"), "first_year", "last_year"), "t")
    return both.drop("t")


def fit_trends(s: SparkSession, d: str) -> DataFrame:
    """Annual and seasonal trend tests of every topic of the fitted model."""
    from corpusloom.plans import trends

    m = _model(s, d)
    rows = fit.with_topics(prepared(s, d), m).filter("topic >= 0").select("data_dt", F.concat(F.lit("topic:"), F.col("topic").cast("string")).alias("espectro"))
    return trends.tests_of(s, d, rows)


def topic_keyword_share(s: SparkSession, d: str) -> DataFrame:
    """Keyword shares by topic and overall (-2), on the nearest of fixed centroids, which any engine can repeat."""
    t = table(s, d, "speeches").filter("discurso IS NOT NULL").select("id", "discurso").join(_topics(s, d), "id")
    g = fit.keyword_share(t, KEYWORDS)
    return g.select(F.coalesce("topic", F.lit(-2)).cast("long").alias("topic"), "n", *[f"k{i}" for i in range(len(KEYWORDS))])


def pca_map(s: SparkSession, d: str) -> DataFrame:
    return topics.plane(_vectors(s, d))


def clean_text(s: SparkSession, d: str) -> DataFrame:
    """The cleaned text of every speech with one."""
    t = table(s, d, "speeches").filter("discurso IS NOT NULL").select("id", "orador", "discurso")
    return cleaning.with_clean_text(t).select("id", cleaning.TEXT_COLUMN)


def text_folds(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "speeches").filter("orador IS NOT NULL").select("orador").distinct()
    return t.select("orador", T.fold(F.col("orador")).alias("folded"), T.norm_name(F.col("orador")).alias("name"), T.display_name(F.col("orador")).alias("shown"))


def token_counts(s: SparkSession, d: str) -> DataFrame:
    """Tokens, distinct variant keys and pairs per speech."""
    t = table(s, d, "speeches").filter("discurso IS NOT NULL").select("id", T.without(T.tokens(T.without_enclitics(F.col("discurso"))), dims.stopwords()).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct(F.transform("t", T.variant_key))).cast("long").alias("n_keys"), F.size(T.bigrams(F.col("t"))).cast("long").alias("n_pairs"))


def chunk_lengths(s: SparkSession, d: str) -> DataFrame:
    """Words of each chunk of fifty words."""
    t = table(s, d, "speeches").filter(F.col("discurso").rlike(r"\S")).select("id", F.posexplode(T.chunks(F.col("discurso"), 50)).alias("chunk", "text"))
    return t.select("id", F.col("chunk").cast("long").alias("chunk"), T.word_count(F.col("text")).cast("long").alias("words"))


def keyword_sentences(s: SparkSession, d: str) -> DataFrame:
    """Sentences that mention schools, with at least four words."""
    t = table(s, d, "speeches").filter("discurso IS NOT NULL").select("id", F.explode(T.sentences(F.col("discurso"))).alias("sentence"))
    t = t.filter(F.lower("sentence").rlike("escola|creche|ensino")).withColumn("words", T.word_count(F.col("sentence"))).filter("words >= 4")
    return t.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"))


def speaker_parse(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "speeches").select("orador").distinct()
    p = T.parse_speaker(F.col("orador"))
    return t.select(p.alias("p")).select("p.orador", "p.partido", "p.estado").distinct()


def keyword_filter(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "speeches").filter(F.lower("discurso").rlike("feminicídio|violência doméstica")).select("id")


def accent_forms(s: SparkSession, d: str) -> DataFrame:
    """Accent map of the collection's own words by their document frequency."""
    w = table(s, d, "speeches").filter("discurso IS NOT NULL").select(F.explode(F.array_distinct(T.long_tokens(F.col("discurso")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return accents.build_map(w).select("bare", F.array_join("forms", " ").alias("forms"))


def iso_dates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "speeches").select("id", F.coalesce(F.date_format(T.br_date(F.col("data")), "yyyy-MM-dd"), F.lit("")).alias("iso"))


QUERIES = {
    "nearest_centroid": nearest_centroid, "topic_freq": topic_freq, "topic_share_by_class": topic_share("espectro"), "topic_share_by_year": topic_share("ano"), "topic_share_by_region": topic_share("regiao"),
    "topic_year_counts": topic_year_counts, "party_topic_profile": party_topic_profile, "membership_linear": membership_linear, "consensus_topics": consensus_topics, "consensus_summary": consensus_summary,
    "kmeans_grid": kmeans_grid, "fit_topics": fit_topics, "fit_statistics": fit_statistics, "fit_trends": fit_trends, "topic_keyword_share": topic_keyword_share, "pca_map": pca_map, "clean_text": clean_text, "text_folds": text_folds, "token_counts": token_counts, "chunk_lengths": chunk_lengths, "keyword_sentences": keyword_sentences,
    "speaker_parse": speaker_parse, "keyword_filter": keyword_filter, "accent_forms": accent_forms, "iso_dates": iso_dates,
}

_V = f"v AS (SELECT speech_id AS id, list_transform(vector, lambda x: x::DOUBLE) AS vec FROM speech_embeddings WHERE model = '{MODEL}'), u AS (SELECT id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS u FROM v WHERE list_dot_product(vec, vec) > 0), c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS topic, u AS c FROM (SELECT * FROM u ORDER BY id LIMIT 8)), near AS (SELECT id, topic, cosine FROM (SELECT id, topic, list_dot_product(u, c) AS cosine, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(u, c) DESC, topic) AS r FROM u, c) WHERE r = 1)"
_TR = f"{CLEAN}, {_V}, tr AS (SELECT clean.*, CASE WHEN cosine >= 0.05 THEN topic ELSE -1 END AS topic FROM clean JOIN near USING (id))"


def _by(group: str) -> str:
    return f"WITH {_TR} SELECT {group}, topic, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY {group}), 1) AS pct FROM tr WHERE topic <> -1 AND {group} IS NOT NULL GROUP BY 1, 2"


_RUN = "SELECT {0} AS run, id, 2 * (v[{1}] > 0)::INT + (v[{2}] > 0)::INT AS cluster FROM s WHERE abs(v[11]) > {3}"
SQL = {
    "nearest_centroid": f"WITH {_V} SELECT id, topic, round(cosine, 5) AS cosine FROM near",
    "topic_freq": f"WITH {_TR} SELECT topic, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM tr WHERE topic <> -1 GROUP BY 1",
    "topic_share_by_class": _by("espectro"), "topic_share_by_year": _by("ano"), "topic_share_by_region": _by("regiao"),
    "topic_year_counts": f"WITH {_TR}, t AS (SELECT * FROM tr WHERE topic <> -1) SELECT a.topic, y.ano, count(t.id) AS n FROM (SELECT DISTINCT topic FROM t) a CROSS JOIN (SELECT unnest(range(min(ano), max(ano) + 1)) AS ano FROM t) y LEFT JOIN t ON t.topic = a.topic AND t.ano = y.ano GROUP BY 1, 2",
    "party_topic_profile": f"""WITH {_TR}, t AS (SELECT * FROM tr WHERE topic <> -1 AND partido IS NOT NULL), p AS (SELECT partido, count(*) AS total FROM t GROUP BY 1 ORDER BY total DESC, partido LIMIT 15), k AS (SELECT topic FROM t GROUP BY 1 ORDER BY count(*) DESC, topic LIMIT 8),
m AS (SELECT partido, espectro FROM (SELECT partido, espectro, row_number() OVER (PARTITION BY partido ORDER BY count(*) DESC, espectro) AS r FROM t GROUP BY 1, 2) WHERE r = 1)
SELECT t.partido, any_value(m.espectro) AS espectro, t.topic, any_value(p.total) AS total, round(100.0 * count(*) / any_value(p.total), 1) AS pct FROM t JOIN p USING (partido) JOIN k USING (topic) JOIN m USING (partido) GROUP BY 1, 3""",
    "membership_linear": f"""WITH s AS (SELECT speech_id AS id, vector AS v FROM speech_embeddings WHERE model = '{MODEL}' AND vector[1] <> 0), r AS ({_RUN.format(0, 1, 2, 0)} UNION ALL {_RUN.format(1, 3, 4, 0.01)} UNION ALL {_RUN.format(2, 5, 6, 0.02)}),
core AS (SELECT id, cluster AS topic FROM r WHERE run = 0), z AS (SELECT topic, count(*) AS size FROM core GROUP BY 1), per AS (SELECT run, cluster, topic, count(*) AS n FROM r JOIN core USING (id) GROUP BY ALL),
t AS (SELECT r.id, per.topic, sum(n) AS n FROM r JOIN per USING (run, cluster) GROUP BY ALL), own AS (SELECT id, count(*) AS k FROM r GROUP BY 1)
SELECT id, CAST(t.topic AS BIGINT) AS topic, value FROM (SELECT t.id, t.topic, round((n - (core.topic = t.topic)::INT * k) / 3.0::DOUBLE / (size - (core.topic = t.topic)::INT), 8) AS value FROM t JOIN z USING (topic) JOIN core ON core.id = t.id JOIN own ON own.id = t.id) t WHERE value > 0""",
    "speaker_parse": r"""WITH o AS (SELECT trim(regexp_replace(orador, '\s+', ' ', 'g')) AS o, '^(.+?),\s*([^,]+?)\s*-\s*([A-Z]{2})$' AS rx FROM speeches)
SELECT DISTINCT CASE WHEN o IS NULL OR o = '' THEN 'SEM NOME' WHEN regexp_matches(o, rx) THEN regexp_extract(o, '^(.+?),\s*([^,]+?)\s*-\s*([A-Z]{2})$', 1) ELSE o END AS orador,
CASE WHEN o <> '' AND regexp_matches(o, rx) THEN regexp_extract(o, '^(.+?),\s*([^,]+?)\s*-\s*([A-Z]{2})$', 2) ELSE 'CONVIDADO' END AS partido, CASE WHEN o <> '' AND regexp_matches(o, rx) THEN regexp_extract(o, '^(.+?),\s*([^,]+?)\s*-\s*([A-Z]{2})$', 3) ELSE '' END AS estado FROM o""",
    "keyword_filter": "SELECT id FROM speeches WHERE regexp_matches(lower(discurso), 'feminicídio|violência doméstica')",
    "iso_dates": r"SELECT id, coalesce(CAST(CAST(CASE WHEN regexp_full_match(data, '\d{1,2}/\d{1,2}/\d{4}') THEN try_strptime(data, '%d/%m/%Y') END AS DATE) AS VARCHAR), '') AS iso FROM speeches",
    "chunk_lengths": r"""WITH w AS (SELECT id, len(list_filter(regexp_split_to_array(discurso, '\s+'), lambda x: x <> '')) AS n FROM speeches WHERE regexp_matches(discurso, '\S')),
c AS (SELECT *, greatest(ceil(n / 50.0) - CASE WHEN n % 50 > 0 AND n % 50 < 12.5 AND n > 50 THEN 1 ELSE 0 END, 1)::BIGINT AS k FROM w)
SELECT id, i AS chunk, CASE WHEN i = k - 1 THEN n - i * 50 ELSE 50 END AS words FROM (SELECT *, unnest(range(k)) AS i FROM c)""",
    "keyword_sentences": r"""WITH s AS (SELECT id, unnest(string_split(regexp_replace(discurso, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM speeches WHERE discurso IS NOT NULL),
w AS (SELECT id, len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> '')) AS words FROM s WHERE regexp_matches(lower(sentence), 'escola|creche|ensino')) SELECT id, count(*) AS n, CAST(sum(words) AS BIGINT) AS words FROM w WHERE words >= 4 GROUP BY 1""",
    "accent_forms": """WITH t AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(discurso), '[a-záàâãéèêíïóôõúüç]{4,}'))) AS word FROM speeches WHERE discurso IS NOT NULL), f AS (SELECT word, count(*) AS freq, strip_accents(word) AS bare FROM t GROUP BY word),
g AS (SELECT *, max(freq) OVER (PARTITION BY bare) AS top FROM f), k AS (SELECT * FROM g WHERE freq >= top * CASE WHEN word <> bare THEN 0.01 ELSE 0.03 END)
SELECT bare, string_agg(word, ' ' ORDER BY (word = bare), freq DESC, word) AS forms FROM k GROUP BY bare HAVING bool_or(word <> bare)""",
}
SQL["token_counts"] = TOKEN_SQL
_BARE = r"regexp_replace(strip_accents({0}), '[\x{{0300}}-\x{{036F}}]', '', 'g')"
SQL["text_folds"] = rf"""WITH n AS (SELECT DISTINCT orador, trim(orador) AS t, list_transform(string_split(trim(regexp_replace(lower(trim(orador)), '\s+', ' ', 'g')), ' '), lambda w, i: CASE WHEN i > 1 AND w IN ('da', 'de', 'do', 'das', 'dos', 'e') THEN w ELSE upper(w[1]) || w[2:] END) AS w FROM speeches WHERE orador IS NOT NULL)
SELECT orador, {_BARE.format('lower(orador)')} AS folded, upper(regexp_replace(trim(regexp_replace({_BARE.format('orador')}, '\s+', ' ', 'g')), '^[ .]+|[ .]+$', '', 'g')) AS name, CASE WHEN t = upper(t) THEN array_to_string(w, ' ') ELSE t END AS shown FROM n"""
_KS = ", ".join(f"round(100 * avg(regexp_matches(f, '{_key_rx(k)}')::INT), 1) AS k{i}" for i, k in enumerate(KEYWORDS))
SQL["topic_keyword_share"] = f"WITH {_V}, t AS (SELECT CASE WHEN cosine >= 0.05 THEN topic ELSE -1 END AS topic, {FOLDED} AS f FROM speeches JOIN near USING (id) WHERE discurso IS NOT NULL) SELECT topic, count(*) AS n, {_KS} FROM t GROUP BY 1 UNION ALL SELECT -2, count(*), {_KS} FROM t"
