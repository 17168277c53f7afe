"""Topics from vectors: seeded clusterings, consensus without an n x n matrix, certainty, several labels, reassignment, a plane."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import linkage
from corpusloom.session import broadcast_if_small, cut, release

NOISE = -1
CUT, SECOND, UNSURE = 0.5, 0.2, 0.5
#: Distinct signatures whose distances are kept as a matrix; more are linked without one.
MOST_NODES = 5_000
#: Clusterings fitted side by side; what they leave in the driver's memory is freed before the next.
FITS_AT_ONCE = 2


def min_cluster_size(n: int, floor: int = 15) -> int:
    return max(floor, round(0.01 * n))


def cache_key(model: str, tokens: int, chunk: int, version: int) -> str:
    """What a stored vector depends on besides its text."""
    return f"{model}|{tokens}|{chunk}|{version}"


def content_key(text: F.Column, model: str, tokens: int, chunk: int, version: int) -> F.Column:
    """The same with a hash of the text: equal texts share one stored vector, whatever their ids."""
    return F.sha2(F.concat_ws("|", F.lit(cache_key(model, tokens, chunk, version)), text), 256)


# ------------------------------------------------------------ vectors


def unit(col: str = "vector") -> F.Column:
    """The array brought to length 1; null where it has no direction."""
    norm = F.sqrt(F.aggregate(col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(col, lambda x: x / norm))


def encode(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], words: int = 5000) -> DataFrame:
    """(id, vector): chunk vectors averaged per text and brought to length 1, in Arrow batches, by a pluggable encoder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [(i, c) for i, cs in zip(pdf["id"], pdf["chunks"]) for c in cs]
            if not parts:
                continue
            v = pd.DataFrame(encoder([c for _, c in parts]))
            m = v.groupby(np.array([i for i, _ in parts]), sort=False).mean()
            u = m.to_numpy() / np.maximum(np.linalg.norm(m.to_numpy(), axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"id": m.index.to_numpy(), "vector": list(u.astype(np.float32))})

    rows = texts.filter("discurso IS NOT NULL AND discurso <> ''").select("id", T.chunks(F.col("discurso"), words).alias("chunks"))
    return rows.mapInPandas(run, "id long, vector array<float>")


def hashing_encoder(width: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The offline default: signed word hashes."""
    import zlib

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), np.float32)
        for r, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[r, h % width] += 1 if h & 0x10000 else -1
        return out

    return run


# ------------------------------------------------------------ clusterings


def _side_by_side(spark: SparkSession, one: Callable, items: Sequence) -> list:
    """``one`` of every item, some at once: each fit is many short jobs, which alone would leave most cores idle."""
    out = []
    with ThreadPool(FITS_AT_ONCE) as pool:
        for i in range(0, len(items), FITS_AT_ONCE):
            out += pool.map(one, items[i : i + FITS_AT_ONCE])
            release(spark)
    return out


def seeded_runs(vectors: DataFrame, k: int, seeds: list[int], noise_share: float = 0.0) -> DataFrame:
    """(run, id, cluster) of k-means with each seed; the farthest share of each run is left out as noise."""
    v = cut(vectors.select("id", "vector", unit().alias("u")).filter("u IS NOT NULL").select("id", array_to_vector("u").alias("features")))
    out = None
    models = _side_by_side(v.sparkSession, lambda seed: KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=15).fit(v), seeds)
    for i, model in enumerate(models):
        a = model.transform(v).select(F.lit(i).alias("run"), "id", F.col("prediction").alias("cluster"), "features")
        if noise_share > 0:
            centres = v.sparkSession.createDataFrame([(j, [float(x) for x in c]) for j, c in enumerate(model.clusterCenters())], "cluster int, c array<double>")
            dot = F.aggregate(F.zip_with("c", vector_to_array("features"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
            a = a.join(F.broadcast(centres), "cluster").withColumn("cos", dot / norm)
            limit = a.agg(F.percentile_approx("cos", noise_share).alias("limit"))
            a = a.crossJoin(F.broadcast(limit)).filter("cos >= limit")
        a = a.select("run", "id", "cluster")
        out = a if out is None else out.unionByName(a)
    out = cut(out)
    release(v.sparkSession)
    return out


def linkage_labels(signatures: np.ndarray, weights: np.ndarray, runs: int, threshold: float = CUT) -> np.ndarray:
    """Average linkage of weighted signatures (cluster per run, -1 noise), cut at the distance; labels per signature.

    Chains of nearest neighbours: two groups nearest to each other are merged at
    once, which average linkage allows, so the work is quadratic in the nodes. A
    group whose nearest neighbour lies beyond the cut is finished.
    """
    n = len(signatures)
    if n > MOST_NODES:
        raise ValueError(f"{n} different signatures; the linkage takes {MOST_NODES}")
    dist = np.ones((n, n), np.float32)
    for r in range(runs):
        c = signatures[:, r]
        dist -= ((c[:, None] == c[None, :]) & (c[:, None] != NOISE)) / np.float32(runs)
    np.fill_diagonal(dist, np.inf)
    size = weights.astype(float)
    home = np.arange(n)
    open_groups = dict.fromkeys(range(n))
    chain: list[int] = []
    while open_groups:
        if not chain:
            chain.append(next(iter(open_groups)))
        i = chain[-1]
        j = int(dist[i].argmin())
        if len(chain) > 1 and dist[i, chain[-2]] <= dist[i, j]:
            j = chain[-2]
        if not dist[i, j] <= threshold + 1e-6:
            open_groups.pop(i)
            dist[i], dist[:, i] = np.inf, np.inf
            chain.pop()
        elif len(chain) > 1 and j == chain[-2]:
            del chain[-2:]
            keep, gone = min(i, j), max(i, j)
            new = (dist[i] * size[i] + dist[j] * size[j]) / (size[i] + size[j])
            new[[i, j]] = np.inf
            dist[keep], dist[:, keep] = new, new
            dist[gone], dist[:, gone] = np.inf, np.inf
            size[keep] = size[i] + size[j]
            home[home == gone] = keep
            open_groups.pop(gone)
        else:
            chain.append(j)
    return np.unique(home, return_inverse=True)[1]


def consensus(runs: DataFrame, n_runs: int, least: int) -> DataFrame:
    """(id, topic): groups that stay together in most runs; ids by size, small groups and never-clustered records are noise.

    Records with the same cluster in every run are one weighted node. So are those
    that share it in enough runs to be within the cut of each other: nothing is
    nearer to them. A record that was noise in more runs is within the cut of none.
    """
    spark = runs.sparkSession
    sig = runs.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("run", "cluster"))).alias("m"))
    sig = sig.select("id", F.transform(F.sequence(F.lit(0), F.lit(n_runs - 1)), lambda r: F.coalesce(F.col("m")[r], F.lit(NOISE))).alias("sig"))
    enough = F.size(F.filter("sig", lambda c: c != NOISE)) >= n_runs * (1 - CUT) - 1e-6
    sig = cut(sig.withColumn("node", F.when(enough, F.lit(0).cast("long")).otherwise(F.col("id"))))
    able = sig.filter(enough) if least > 1 else sig
    nodes = able.groupBy("sig", "node").agg(F.count(F.lit(1)).alias("n")).orderBy("sig", "node").select(*[F.col("sig")[r].cast("short").alias(f"s{r}") for r in range(n_runs)], "node", "n").toPandas()  # one row a signature
    sigs, n = nodes[[f"s{r}" for r in range(n_runs)]].to_numpy(np.int32), nodes["n"].to_numpy()
    labels = (linkage_labels(sigs, n, n_runs) if len(n) <= MOST_NODES else linkage.labels(sigs, n, n_runs, CUT)) if len(n) else np.zeros(0, int)
    total = np.bincount(labels, weights=n)
    rank = np.full(len(total), NOISE)
    order = np.lexsort((np.arange(len(total)), -total))
    order = order[total[order] >= least]
    rank[order] = np.arange(len(order))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * n_runs, pa.int32()), pa.array(sigs.ravel(), pa.int32()))
    table = spark.createDataFrame(pa.table({"sig": lists, "node": pa.array(nodes["node"], pa.int64()), "topic": pa.array(rank[labels], pa.int32())}))
    return sig.join(broadcast_if_small(table, len(n)), ["sig", "node"], "left").select("id", F.coalesce("topic", F.lit(NOISE)).alias("topic"))


def membership(runs: DataFrame, topics: DataFrame, n_runs: int) -> DataFrame:
    """(id, topic, value): mean share of runs a record spends with a topic's records, itself left out. Linear in the runs' rows.

    ``topics`` is (id, topic) with noise as -1; only records of a topic are its core.
    """
    core = topics.filter(F.col("topic") != NOISE)
    sizes = core.groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
    per = runs.join(core.withColumnRenamed("topic", "t"), "id").groupBy("run", "cluster", "t").agg(F.count(F.lit(1)).alias("n"))
    together = runs.join(per, ["run", "cluster"]).groupBy("id", F.col("t").alias("topic")).agg(F.sum("n").alias("sum"))
    own = runs.groupBy("id").agg(F.count(F.lit(1)).alias("clustered"))
    j = together.join(F.broadcast(sizes), "topic").join(topics.withColumnRenamed("topic", "mine"), "id").join(own, "id")
    me = (F.col("mine") == F.col("topic")).cast("int")
    value = (F.col("sum") - me * F.col("clustered")) / F.lit(float(n_runs)) / F.when(F.col("size") - me > 0, F.col("size") - me)
    return j.select("id", "topic", F.coalesce(value, F.lit(0.0)).alias("value"))


def labels_of(values: DataFrame, topics: DataFrame, threshold: float = SECOND) -> DataFrame:
    """(id, topic, certainty, unsure, topics): own value to three decimals, and the other topics from the threshold on, largest first."""
    j = values.withColumnRenamed("topic", "t").join(topics, "id")
    own = F.max(F.when(F.col("t") == F.col("topic"), F.col("value"))).alias("c")
    others = F.collect_list(F.when((F.col("t") != F.col("topic")) & (F.col("value") >= threshold), F.struct((-F.col("value")).alias("v"), "t"))).alias("o")
    g = j.groupBy("id", "topic").agg(own, others)
    c = F.round(F.coalesce("c", F.lit(0.0)), 3)
    return g.select("id", "topic", c.alias("certainty"), (c < UNSURE).alias("unsure"), F.concat(F.array("topic"), F.transform(F.array_sort("o"), lambda x: x["t"])).alias("topics"))


def centroids(vectors: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, centroid) as the mean of the unit vectors of each topic."""
    j = vectors.select("id", F.posexplode(unit()).alias("i", "x")).join(topics.filter(F.col("topic") != NOISE), "id")
    m = j.groupBy("topic", "i").agg(F.avg("x").alias("x"))
    return m.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))


def nearest(vectors: DataFrame, cents: DataFrame) -> DataFrame:
    """(id, topic, cosine) of the centroid of largest cosine, the lowest topic of equals. Centroids are few by construction."""
    norm = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x))
    listed = cents.agg(F.array_sort(F.collect_list(F.struct("topic", F.transform("centroid", lambda x: x / F.when(norm > 0, norm)).alias("centroid")))).alias("cs"))
    v = vectors.select("id", unit().alias("u")).filter("u IS NOT NULL").crossJoin(F.broadcast(listed))
    scored = F.transform("cs", lambda c: F.struct(F.aggregate(F.zip_with("u", c["centroid"], lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("cosine"), (-c["topic"]).alias("t")))
    best = F.array_max(scored)
    return v.select("id", best.alias("b")).select("id", (-F.col("b.t")).alias("topic"), F.col("b.cosine").alias("cosine"))


def reassigned(vectors: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, topic, moved): noise records go to the nearest topic."""
    near = nearest(vectors.join(topics.filter(F.col("topic") == NOISE).select("id"), "id", "left_semi"), centroids(vectors, topics)).withColumnRenamed("topic", "t")
    j = topics.join(near.select("id", "t"), "id", "left")
    return j.select("id", F.coalesce(F.when(F.col("topic") == NOISE, F.col("t")), "topic").alias("topic"), ((F.col("topic") == NOISE) & F.col("t").isNotNull()).alias("moved"))


def reduce_topics(cents: pd.DataFrame, sizes: dict[int, int], n: int) -> dict[int, int]:
    """Old topic -> new topic: the closest pair is merged until n are left; ids by size."""
    c = {int(t): np.array(v, float) for t, v in zip(cents["topic"], cents["centroid"])}
    size = dict(sizes)
    home = {t: t for t in c}
    while len(c) > n:
        keys = sorted(c)
        m = np.array([c[k] / max(np.linalg.norm(c[k]), 1e-12) for k in keys])
        s = m @ m.T
        np.fill_diagonal(s, -2)
        i, j = np.unravel_index(int(s.argmax()), s.shape)
        a, b = sorted((keys[i], keys[j]), key=lambda k: (-size[k], k))
        c[a] = (c[a] * size[a] + c[b] * size[b]) / (size[a] + size[b])
        size[a] += size.pop(b)
        del c[b]
        home = {t: a if h == b else h for t, h in home.items()}
    rank = {t: i for i, t in enumerate(sorted(c, key=lambda k: (-size[k], k)))}
    return {t: rank[h] for t, h in home.items()}


def label_text(words: DataFrame, n: int = 5) -> DataFrame:
    """(topic, label): 'T0: a | b | c' from (topic, rank, word); noise has a fixed name."""
    top = words.filter(F.col("rank") <= n).groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("w"))
    return top.select("topic", F.when(F.col("topic") == NOISE, "Ruído / Genérico").otherwise(F.concat(F.lit("T"), F.col("topic").cast("string"), F.lit(": "), F.array_join("w", " | "))).alias("label"))


def plane(vectors: DataFrame, digits: int = 2) -> DataFrame:
    """(id, x, y): the first two principal components, rounded."""
    v = vectors.select("id", unit().alias("u")).filter("u IS NOT NULL").select("id", array_to_vector("u").alias("features"))
    m = PCA(k=2, inputCol="features", outputCol="p").fit(v)
    p = m.transform(v).select("id", vector_to_array("p").alias("p"))
    return p.select("id", F.round(F.col("p")[0], digits).alias("x"), F.round(F.col("p")[1], digits).alias("y"))


def kmeans_grid(vectors: DataFrame, ks: range, words: DataFrame | None = None, sample: int = 5000, seed: int = 42) -> DataFrame:
    """(k, silhouette, diversity, score, chosen): k-means on all vectors for several k.

    The silhouette is taken on a bounded sample; ``words`` is (id, word, n), and the
    diversity is the share of different words among the ten most frequent of each
    cluster. Both scaled to their range and added give the score, the first best k
    is chosen; without words the diversity is 0 for all.
    """
    v = cut(vectors.select("id", unit().alias("u")).filter("u IS NOT NULL").select("id", array_to_vector("u").alias("features")))
    if not v.limit(1).count():
        return vectors.sparkSession.createDataFrame([], "k int, silhouette double, diversity double, score double, chosen boolean")
    some = cut(v.orderBy(F.xxhash64("id")).limit(sample))

    def one(k: int) -> tuple[float, float]:
        model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=10).fit(v)
        silhouette = float(ClusteringEvaluator(distanceMeasure="cosine").evaluate(model.transform(some)))
        if words is None:
            return silhouette, 0.0
        c = words.join(model.transform(v).select("id", "prediction"), "id").groupBy("prediction", "word").agg(F.sum("n").alias("n"))
        top = c.withColumn("r", F.row_number().over(Window.partitionBy("prediction").orderBy(F.desc("n"), "word"))).filter("r <= 10")
        return silhouette, top.agg(F.countDistinct("word") / F.count(F.lit(1))).first()[0] or 0.0

    scores = np.array(_side_by_side(v.sparkSession, one, ks))
    low, high = scores.min(axis=0), scores.max(axis=0)
    total = ((scores - low) / (high - low + 1e-9)).sum(axis=1)
    best = int(total.argmax())
    rows = [(k, round(float(s), 4), round(float(d), 4), round(float(x), 4), i == best) for i, (k, (s, d), x) in enumerate(zip(ks, scores, total))]
    return vectors.sparkSession.createDataFrame(rows, "k int, silhouette double, diversity double, score double, chosen boolean")


def model_summary(labels: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """One row: records, topics, noise, unsure, several labels, moved, with percents to one decimal."""
    d = labels if moved is None else labels.join(moved.select("id", "moved"), "id")
    n = F.count(F.lit(1))
    pct = lambda c: F.round(100 * F.count_if(c) / n, 1)
    cols = [n.alias("n"), F.countDistinct(F.when(F.col("topic") != NOISE, F.col("topic"))).alias("topics"), F.count_if(F.col("topic") == NOISE).alias("noise"), pct(F.col("topic") == NOISE).alias("noise_pct"), F.count_if("unsure").alias("unsure"), pct(F.col("unsure")).alias("unsure_pct"), F.count_if(F.size("topics") > 1).alias("several")]
    return d.agg(*cols, *([F.count_if("moved").alias("moved")] if moved is not None else []))


def columnar_map(points: DataFrame) -> DataFrame:
    """One row of parallel arrays in id order: x, y, topic, date. For a result that is sent whole to a client."""
    o = F.array_sort(F.collect_list(F.struct("id", "x", "y", "topic", "data")))
    return points.agg(o.alias("o")).select(*[F.transform("o", lambda r, c=c: r[c]).alias(c) for c in ("x", "y", "topic", "data")])


def share_by(topics: DataFrame, group: str) -> DataFrame:
    """Percent of each topic among the records of a group that have one."""
    t = topics.filter(F.col("topic") != NOISE).dropna(subset=[group])
    c = t.groupBy(group, "topic").agg(F.count(F.lit(1)).alias("n"))
    return c.select(group, "topic", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(group)), 1).alias("pct"))


def time_estimate(n: int, cached: int, seconds_per_doc: float, rounds: int = 0) -> float:
    """Seconds an analysis takes: encoding what is not cached, a fixed part, per-record work, and the rounds of a consensus."""
    return (n - cached) * seconds_per_doc + 20 + (0.02 + 0.0025) * n + 0.0025 * rounds * n


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id long, topic int")
