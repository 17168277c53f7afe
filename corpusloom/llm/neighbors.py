"""Problem 4: the k most similar vectors of every vector, by an inverted multi-index.

The two halves of each unit vector are quantised separately, so K x K cells cost
2 K centroids. A query walks the centroid pairs in order of summed distance with
a heap (the multi-sequence algorithm), skipping empty cells, until enough
entries are listed, and these are reranked by their exact cosine.

Exact copies are one class, searched once. Neighbouring cells are put together
into regions, found by clustering the centroids of each half, and a query is sent
once to each region it reaches, with the list of its cells there: far fewer copies
than one for each cell, and the candidates are the same. In a region each cell's
entries meet the queries that walked to that cell in one matrix product. A region
of many entries or queries is split into blocks of both, by itself, so no task
sees an unbounded region and nothing is left out.

The copies of all queries are many times the vectors, and grow faster than they
do. So queries are sent in turns whose size follows the vectors', and the disk of
a turn is freed before the next: every query has its turn and the result is the
same, only the entries are sent again.
"""

from __future__ import annotations

import gc
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import broadcast_if_small, cut, release, shuffle_parts

K_NEIGHBOURS = 5
#: Vectors per model the centroids are fitted on; every vector is indexed.
FIT_SAMPLE = 20_000
#: Entries and queries of one region's block.
ENTRY_BLOCK, QUERY_BLOCK = 65_536, 32_768
#: Entries a region holds on average.
REGION = 6_000
#: Sampled queries that tell how many queries reach each region.
WALK_SAMPLE = 2_000
#: Most centroids of a half: their pairs are counted on the driver. Beyond about 10^8 vectors cells grow instead.
MOST_CENTROIDS = 1_024
#: Bytes that one turn's queries and their answers may have, or so many times those of the vectors themselves; more go in further turns.
TURN_BYTES, TURN_SHARE = 128 << 20, 1.5
#: Vectors packed at a time, and queries merged in one group, to bound what a worker holds.
SEND_ROWS, MERGE_QUERIES = 2_048, 5_000
SEED = 7


def centroids_per_half(n: int) -> int:
    """Centroids grow with the square root of the vectors, so that a cell holds about as many at every size."""
    return max(1, min(MOST_CENTROIDS, round(math.sqrt(n) / 10) + 14, math.ceil(math.sqrt(n) / 3)))


def candidates_per_query(n: int) -> int:
    """Entries a query reranks: measured to keep recall at 5 above 0.95 from 10^4 to 10^6 vectors."""
    return math.ceil(2.6 * n**0.66 + 60)


def regions_per_half(n: int, k: int) -> int:
    return max(1, min(k, round(math.sqrt(n / REGION))))


def kmeans(x: np.ndarray, k: int, seed: int = SEED, rounds: int = 12) -> np.ndarray:
    """Centroids by k-means with spread-out starts; fewer where there are fewer points."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = [x[rng.integers(len(x))]]
    d = ((x - c[0]) ** 2).sum(1)
    for _ in range(k - 1):
        p = d / d.sum() if d.sum() > 0 else None
        c.append(x[rng.choice(len(x), p=p)])
        d = np.minimum(d, ((x - c[-1]) ** 2).sum(1))
    c = np.array(c, np.float32)
    norm = (x**2).sum(1)[:, None]
    for _ in range(rounds):
        a = (norm - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
        for j in range(k):
            m = a == j
            if m.any():
                c[j] = x[m].mean(0)
    return c


def half_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def multi_sequence(d1: np.ndarray, d2: np.ndarray, counts: list[int], want: int) -> list[int]:
    """Non-empty cells in order of summed distance until they hold ``want`` entries.

    The heap holds the next pair of each row that was begun; a row is begun when
    the first pair of the row before it leaves the heap.
    """
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    k1, k2 = len(s1), len(s2)
    rows, o2 = (o1 * k2).tolist(), o2.tolist()
    heap = [(s1[0] + s2[0], 0, 0)]
    out, total = [], 0
    while heap:
        _, i, j = heap[0]
        cell = rows[i] + o2[j]
        n = counts[cell]
        if n:
            out.append(cell)
            total += n
            if total >= want:
                break
        if j + 1 < k2:
            heapq.heapreplace(heap, (s1[i] + s2[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < k1:
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float32)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors brought to length 1, whole batches at a time; those without a direction go."""
    for b in batches:
        col = b.column("vector")
        lens = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(lens):
            continue
        x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.append(0, np.cumsum(lens))
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt(np.add.reduceat(x * x, starts[:-1]))
            unit = (x / np.repeat(np.where(norm > 0, norm, 1), lens)).astype(np.float32)
        keep = np.isfinite(norm) & (norm > 0)
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(unit))
        out = pa.RecordBatch.from_arrays([b.column("model"), b.column("speech_id"), lists], ["model", "speech_id", "unit"])
        yield out.filter(pa.array(keep))


def units(vectors: DataFrame) -> DataFrame:
    """(model, speech_id, h, unit): the usable vectors brought to length 1, with a hash of them.

    Null, all-zero, non-finite and empty vectors have no direction and are left
    out, as are null ids or models.
    """
    v = vectors.select("model", F.col("speech_id").cast("long").alias("speech_id"), F.col("vector").cast("array<float>").alias("vector"))
    v = v.filter("model IS NOT NULL AND speech_id IS NOT NULL AND size(vector) > 1")
    v = v.mapInArrow(_units, "model string, speech_id long, unit array<float>")
    return v.select("model", "speech_id", F.xxhash64("unit").alias("h"), "unit")


def classes(vectors: DataFrame, keep: int = 1) -> DataFrame:
    """(model, h, unit, class_id, first_ids): one row per different direction.

    ``class_id`` is the smallest id, ``first_ids`` the ``keep`` smallest ids: the
    limit is applied before the shuffle too, so a vector that a third of all rows
    share sends a handful of rows per task.
    """
    w = Window.partitionBy("model", "h", "unit").orderBy("speech_id")
    v = units(vectors).withColumn("rn", F.dense_rank().over(w)).filter(F.col("rn") <= keep)
    one = v.groupBy("model", "h", "unit").agg(F.sort_array(F.collect_set("speech_id")).alias("first_ids"))
    return one.select("model", "h", "unit", F.col("first_ids")[0].alias("class_id"), "first_ids")


def _plan(sample: np.ndarray, n: int, want: int) -> dict:
    """Centroids of both halves and the region of every cell."""
    h = sample.shape[1] // 2
    k = centroids_per_half(n)
    c1, c2 = kmeans(sample[:, :h], k), kmeans(sample[:, h:], k)
    g = regions_per_half(n, k)
    r1, r2 = (half_distances(c, kmeans(c, g)).argmin(1) for c in (c1, c2))
    return {"centroids": (c1, c2), "want": want, "region": (r1[:, None] * g + r2[None]).ravel().astype(np.int32), "regions": g * g}


def _distances(x: np.ndarray, c: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h = c[0].shape[1]
    return half_distances(x[:, :h], c[0]), half_distances(x[:, h:], c[1])


def _cells(x: np.ndarray, c: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    d1, d2 = _distances(x, c)
    return d1.argmin(1) * len(c[1]) + d2.argmin(1)


def _walks(x: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell) of all walks, ordered by query."""
    d1, d2 = _distances(x, p["centroids"])
    walks = [multi_sequence(d1[i], d2[i], p["counts"], p["want"]) for i in range(len(x))]
    return np.repeat(np.arange(len(x)), [len(w) for w in walks]), np.array([c for w in walks for c in w], np.int32)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, positions in order) of each different key."""
    o = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.append(True, keys[o][1:] != keys[o][:-1])) if len(o) else []
    for a, b in zip(starts, np.append(starts[1:], len(o)) if len(o) else []):
        yield int(keys[o[a]]), o[a:b]


def _send(shared, queries: bool):
    """Each vector as an entry of its region's blocks, or as a query of the regions it walks to with its cells there, packed per block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = shared.value
        for pdf in (big.iloc[i : i + SEND_ROWS] for big in batches for i in range(0, len(big), SEND_ROWS)):
            out = []
            for (model, width), g in pdf.assign(width=pdf["unit"].map(len)).groupby(["model", "width"]):
                p = plan.get((model, int(width)))
                if p is None:  # nothing to be found in
                    continue
                ids, x = g["class_id"].to_numpy(np.int64), _matrix(g["unit"])
                salt = ids % 1_000_003
                if queries:
                    who, cell = _walks(x, p)
                else:
                    who, cell = np.arange(len(x)), _cells(x, p["centroids"]).astype(np.int32)
                for region, at in _groups(p["region"][cell]):
                    eb, qb = int(p["entry_blocks"][region]), int(p["query_blocks"][region])
                    mine, others = (qb, eb) if queries else (eb, qb)
                    for b, sub in _groups(salt[who[at]] % mine):
                        a = at[sub]  # ordered by vector
                        rows, lens = np.unique(who[a], return_counts=True)
                        packed = (ids[rows].tobytes(), x[rows].tobytes(), lens.astype(np.int32).tobytes(), cell[a].tobytes())
                        out += [(model, int(width), region, *((o, b) if queries else (b, o)), queries, *packed) for o in range(others)]
            yield pd.DataFrame(out, columns=["model", "width", "region", "eb", "qb", "is_query", "ids", "data", "lens", "cells"])

    return run


_SENT = "model string, width int, region int, eb int, qb int, is_query boolean, ids binary, data binary, lens binary, cells binary"


def _joined(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, ...]:
    get = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
    return get("ids", np.int64), get("data", np.float32).reshape(-1, width), get("lens", np.int32), get("cells", np.int32)


def _best(old_s: np.ndarray, old_n: np.ndarray, s: np.ndarray, n: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m largest of both, unordered."""
    s, n = np.hstack([old_s, s]), np.hstack([old_n, n])
    if s.shape[1] <= m:
        return s, n
    top = np.argpartition(s, s.shape[1] - m, axis=1)[:, -m:]
    return np.take_along_axis(s, top, 1), np.take_along_axis(n, top, 1)


def _meet(k: int, buckets: int):
    """One block of a region's entries against one block of its queries, cell by cell; the best k of each query, packed by query bucket."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        model, width = key[0], int(key[1])
        q, e = pdf[pdf["is_query"]], pdf[~pdf["is_query"]]
        cols = ["model", "bucket", "q", "n", "s"]
        if not len(q) or not len(e):
            return pd.DataFrame([], columns=cols)
        qids, qm, lens, walked = _joined(q, width)
        eids, em, _, ecell = _joined(e, width)
        entries = dict(_groups(ecell))
        who = np.repeat(np.arange(len(qids)), lens)
        m = k + 1  # a query may meet itself
        best_s, best_n = np.full((len(qids), m), -9, np.float32), np.full((len(qids), m), -1, np.int64)
        worst = np.full(len(qids), -9, np.float32)
        for cell, at in _groups(walked):
            mine = entries.get(cell)
            if mine is None:
                continue
            vectors, names = em[mine], eids[mine]
            for i in range(0, len(at), 2048):
                asked = who[at[i : i + 2048]]
                for j in range(0, len(mine), 2048):
                    sim = qm[asked] @ vectors[j : j + 2048].T
                    ns = names[j : j + 2048]
                    better = sim.max(axis=1) >= worst[asked]  # the others gain nothing here
                    r, sim = asked[better], sim[better]
                    if not len(r):
                        continue
                    if sim.shape[1] > m:
                        top = np.argpartition(sim, sim.shape[1] - m, axis=1)[:, -m:]
                        sim, found = np.take_along_axis(sim, top, 1), ns[top]
                    else:
                        found = np.broadcast_to(ns, sim.shape)
                    s, n = _best(best_s[r], best_n[r], sim, found, m)
                    best_s[r], best_n[r] = s, n
                    worst[r] = s.min(axis=1)
        qs = np.repeat(qids, m)
        ns, ss = best_n.ravel(), best_s.ravel()
        keep = (ss > -9) & (qs != ns)
        qs, ns, ss = qs[keep], ns[keep], ss[keep]
        b = (qs % 2_147_483_629) % buckets
        out = [(model, x, qs[at].tobytes(), ns[at].tobytes(), ss[at].tobytes()) for x, at in _groups(b)]
        return pd.DataFrame(out, columns=cols)

    return run


def _merge(k: int):
    """The best k of each query from its regions."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        q = np.frombuffer(b"".join(pdf["q"]), np.int64)
        n = np.frombuffer(b"".join(pdf["n"]), np.int64)
        s = np.frombuffer(b"".join(pdf["s"]), np.float32)
        o = np.lexsort((n, -s, q))
        q, n, s = q[o], n[o], s[o]
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.array([], np.int64)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        keep = rank < k
        return pd.DataFrame({"model": key[0], "class_id": q[keep], "neighbour": n[keep], "rank": rank[keep] + 1, "cosine": s[keep].astype(float)})

    return run


def search(queries: DataFrame, k: int = K_NEIGHBOURS, entries: DataFrame | None = None, least: int = 0) -> DataFrame:
    """(model, class_id, neighbour, rank, cosine): the k nearest entries of every query, itself not counted.

    Both are cut tables with (model, class_id, unit), ids not negative; without
    ``entries`` the queries are searched among themselves, with them the ids of
    both sides must not meet. A query reranks ``least`` entries and more. Ties go
    to the smaller id. A query with no entry of its model has no rows.
    """
    spark = queries.sparkSession
    pool = queries if entries is None else entries
    schema = "model string, class_id long, neighbour long, rank int, cosine double"
    sizes = {(r["model"], r["width"]): r["n"] for r in pool.groupBy("model", F.size("unit").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()}  # models are few
    if not sizes:
        return spark.createDataFrame([], schema)
    plan, probes = {}, {}
    for (model, width), n in sizes.items():
        # bounded sample, spread by hash
        own = pool.filter((F.col("model") == model) & (F.size("unit") == width))
        share = min(1.0, 1.3 * FIT_SAMPLE / n)
        picked = own.filter(F.pmod(F.xxhash64("class_id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else own
        sample = _matrix(picked.select("class_id", "unit").limit(2 * FIT_SAMPLE).toPandas().sort_values("class_id")["unit"])
        plan[(model, width)] = _plan(sample, n, max(candidates_per_query(n), least))
        probes[(model, width)] = sample[:WALK_SAMPLE].copy()
        del sample
        gc.collect()
        pa.default_memory_pool().release_unused()
    centroids = spark.sparkContext.broadcast({key: p["centroids"] for key, p in plan.items()})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (model, width), g in pdf.assign(width=pdf["unit"].map(len)).groupby(["model", "width"]):
                cell, n = np.unique(_cells(_matrix(g["unit"]), centroids.value[(model, int(width))]), return_counts=True)
                yield pd.DataFrame({"model": model, "width": int(width), "cell": cell, "n": n})

    # MOST_CENTROIDS squared counts per model at most, and about a hundredth of the vectors
    for r in pool.select("model", "unit").mapInPandas(count, "model string, width int, cell int, n long").groupBy("model", "width", "cell").agg(F.sum("n").alias("n")).collect():
        p = plan[(r["model"], r["width"])]
        p.setdefault("counts", np.zeros(len(p["centroids"][0]) * len(p["centroids"][1]), np.int64))[r["cell"]] = r["n"]
    n_queries = {(r["model"], r["width"]): r["n"] for r in queries.groupBy("model", F.size("unit").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()} if entries is not None else sizes
    turns = _split(plan, probes, n_queries, k)
    shared = spark.sparkContext.broadcast(plan)
    spread = max(shuffle_parts(spark), 12)
    columns = ["model", "class_id", "unit"]
    buckets = max(shuffle_parts(spark), -(-sum(n_queries.values()) // (turns * MERGE_QUERIES)))

    def one_turn(own: DataFrame) -> DataFrame:
        # walks are the work: spread over all cores
        packed = [own.select(*columns).repartition(spread).mapInPandas(_send(shared, True), _SENT), pool.select(*columns).mapInPandas(_send(shared, False), _SENT)]
        met = packed[0].unionByName(packed[1]).groupBy("model", "width", "region", "eb", "qb").applyInPandas(_meet(k, buckets), "model string, bucket int, q binary, n binary, s binary")
        return met.groupBy("model", "bucket").applyInPandas(_merge(k), schema)

    if turns == 1:
        return one_turn(queries)
    paths = []
    for t in range(turns):
        paths.append(cut(one_turn(queries.filter(F.pmod(F.xxhash64("class_id"), F.lit(turns)) == t)))._cut_path)
        release(spark)
    return spark.read.schema(schema).parquet(*paths)


def _split(plan: dict, probes: dict, n_queries: dict, k: int) -> int:
    """Blocks of each region, written to the plan, and the number of turns.

    A sample of walks tells how many queries reach a region; it decides how the
    work is split and nothing else.
    """
    sent, own, reached = 0.0, 0, {}
    for key, p in plan.items():
        in_region = np.bincount(p["region"], weights=p["counts"], minlength=p["regions"])
        p["entry_blocks"] = np.maximum(1, -(-in_region // ENTRY_BLOCK)).astype(int)
        n = max(int(sum(p["counts"])), n_queries.get(key, 0))
        p["counts"] = p["counts"].tolist()
        who, cell = _walks(probes[key], p)
        visits = np.bincount(np.unique(np.stack([who, p["region"][cell]]), axis=1)[1], minlength=p["regions"])
        reached[key] = visits / len(probes[key])
        cells = np.bincount(p["region"][cell], minlength=p["regions"]) / len(probes[key])
        row = 4 * key[1] + 12  # vector, id, count of cells
        answer = 20 * (k + 1)
        sent += n_queries.get(key, 0) * float(((reached[key] * (row + answer) + 4 * cells) * p["entry_blocks"]).sum())
        own += n * row
    turns = max(1, math.ceil(sent / max(TURN_BYTES, TURN_SHARE * own)))
    for key, p in plan.items():
        p["query_blocks"] = np.maximum(1, np.ceil(reached[key] * n_queries.get(key, 0) / (turns * QUERY_BLOCK))).astype(int)
    return turns


def similar(vectors: DataFrame, k: int = K_NEIGHBOURS) -> DataFrame:
    """(model, speech_id, neighbour_id, rank, cosine): the k most similar vectors of every vector.

    Copies of a vector come first (cosine 1, smallest ids first), then the
    nearest other classes, each with its members by id. A model with no more
    than k other vectors lists them all. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    cls = cut(classes(vectors, k + 1))
    release(spark)
    near = search(cls, k)
    firsts = cls.select("model", F.col("class_id").alias("neighbour"), F.col("first_ids").alias("n_ids"))
    lists = near.join(firsts, ["model", "neighbour"]).groupBy("model", "class_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "neighbour", F.slice("n_ids", 1, k).alias("ids")))).alias("l")
    )
    flat = F.expr(f"slice(flatten(transform(l, x -> transform(x.ids, i -> struct(i AS id, -x.d AS cosine)))), 1, {k})")
    lists = cls.select("model", "class_id", F.slice("first_ids", 1, k + 1).alias("own")).join(lists.select("model", "class_id", flat.alias("others")), ["model", "class_id"], "left")
    alone = cls.filter("size(first_ids) = 1").select("model", F.col("class_id").alias("speech_id"), "class_id")
    many = cls.filter("size(first_ids) > 1").select("model", "h", "unit", "class_id")
    # few vectors have copies: the others are not moved
    marks = many.select("model", "h").distinct()
    copies = units(vectors).join(broadcast_if_small(marks), ["model", "h"], "left_semi").join(many, ["model", "h", "unit"]).select("model", "speech_id", "class_id").distinct()
    all_members = alone.unionByName(copies)
    got = all_members.join(lists, ["model", "class_id"])
    own = F.expr("transform(filter(own, i -> i <> speech_id), i -> struct(i AS id, double(1) AS cosine))")
    got = got.select("model", "speech_id", F.posexplode(F.slice(F.concat(own, F.coalesce("others", F.expr("array()"))), 1, k)).alias("pos", "x"))
    return got.select("model", "speech_id", F.col("x.id").alias("neighbour_id"), (F.col("pos") + 1).alias("rank"), F.col("x.cosine").alias("cosine"))


MIN_COSINE = 0.95


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar(spark.read.parquet(f"{sf_dir}/speech_embeddings.parquet")).filter(F.col("cosine") >= MIN_COSINE)
    return near.select("model", F.least("speech_id", "neighbour_id").alias("speech_id_a"), F.greatest("speech_id", "neighbour_id").alias("speech_id_b")).distinct()


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar(spark.read.parquet(f"{sf_dir}/speech_embeddings.parquet"))
    return near.select("model", "speech_id", F.col("rank").cast("long").alias("rank"), "neighbour_id", F.round("cosine", 5).alias("cosine"))


#: Queries of one block of the exact comparison, and vectors of one part of the collection.
EXACT_QUERIES, EXACT_PART = 1_024, 16_384


def exact_kth(vectors: DataFrame, every: int = 100, k: int = K_NEIGHBOURS) -> DataFrame:
    """(model, speech_id, kth): the k-th largest cosine to another vector of the model, by comparison with every row.

    Queries are the rows whose id is divisible by ``every``; blocks of them meet
    parts of the collection. A query with fewer than k others has its smallest.
    """
    u = cut(units(vectors))
    total, asked = u.count(), u.filter(F.col("speech_id") % every == 0).count()
    blocks, parts = max(1, -(-asked // EXACT_QUERIES)), max(1, -(-total // EXACT_PART))
    spread = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "speech_id"), F.lit(n)).cast("int")
    q = u.filter(F.col("speech_id") % every == 0).withColumn("block", spread(1, blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    e = u.withColumn("part", spread(2, parts)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for width, lg in left.groupby(left["unit"].map(len)) if len(left) and len(right) else ():
            rg = right[right["unit"].map(len) == width]
            if not len(rg):
                continue
            s = _matrix(lg["unit"]) @ _matrix(rg["unit"]).T
            s[lg["speech_id"].to_numpy()[:, None] == rg["speech_id"].to_numpy()[None]] = -9
            top = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            rows.append(pd.DataFrame({"model": key[0], "speech_id": np.repeat(lg["speech_id"].to_numpy(), top.shape[1]), "cosine": top.ravel().astype(float)}))
        out = pd.concat(rows) if rows else pd.DataFrame([], columns=["model", "speech_id", "cosine"])
        return out[out["cosine"] > -9]

    keys = ["model", "block", "part"]
    met = q.groupBy(*keys).cogroup(e.groupBy(*keys)).applyInPandas(meet, "model string, speech_id long, cosine double")
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("model", "speech_id").orderBy(F.desc("cosine")))).filter(F.col("r") <= k)
    return best.groupBy("model", "speech_id").agg(F.min("cosine").alias("kth"), F.count(F.lit(1)).alias("n"))


def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, queries, recall): share of the k most similar vectors that the index finds, over the ids divisible by 100."""
    v = spark.read.parquet(f"{sf_dir}/speech_embeddings.parquet")
    kth = exact_kth(v)
    hits = similar(v).join(kth, ["model", "speech_id"]).filter(F.col("cosine") >= F.col("kth") - 1e-5).groupBy("model", "speech_id").agg(F.count(F.lit(1)).alias("hits"))
    both = kth.join(hits, ["model", "speech_id"], "left")
    share = F.sum(F.least(F.coalesce("hits", F.lit(0)), F.col("n"))) / F.sum("n")
    return both.groupBy("model").agg(F.count(F.lit(1)).alias("queries"), F.round(share, 4).alias("recall"))


QUERIES = {"p4_found": found, "p4_neighbours": report, "p4_recall": recall}
SQL: dict[str, str] = {}
