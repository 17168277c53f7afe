"""Problem 8: documents into containers of fixed capacity, by linear grouping.

Documents are as long as their tokens in a public tokenizer. What is planned is
the histogram of lengths, which has no more bins than the capacity, never the
documents: large lengths are rounded up within groups of equal cardinality, the
few sizes left are packed by a linear program over configurations (column
generation, knapsack pricing), the real lengths take the rounded places, and the
small ones go best fit, largest first, into the room left. The plan is a short
list of patterns with multiplicities; documents find their container by their
number among the documents of their length, which range partitions with offsets
give without gathering any length in one task.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.range_partials import stitched_ranks
from corpusloom.session import cut

CAPACITY = 2048
#: Lengths above this share of the capacity are large; groups they are rounded within.
LARGE_SHARE, GROUPS = 1 / 8, 48
TOKENIZER_DIR = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens are counted over pieces of white-space-delimited text of about this many characters, so a very long text needs little memory.
PIECE = 200_000


@cache
def encoder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpusloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str, path: str) -> int:
    enc = encoder(path)
    if len(text) <= PIECE:
        return len(enc.encode_ordinary(text))
    n, at = 0, 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        # a piece ends before a space inside the text, where the pattern splits too
        while end < len(text) and not (text[end] == " " and text[end - 1].isalnum() and text[end + 1 : end + 2].isalnum()) and end - at < 2 * PIECE:
            end += 1
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def _count(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [token_count(t, path) for t in pdf["text"]]})

    return run


def lengths(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, tokens); null and empty texts have no tokens and need no place."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL AND text <> ''")
    return d.mapInPandas(_count(path), "doc_id long, tokens long")


# ------------------------------------------------------------ planning on the histogram


def group_up(sizes: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    """The rounded-up size of each size: groups of about equal cardinality take their largest member's size."""
    order = np.argsort(-sizes, kind="stable")
    up = np.empty(len(sizes), np.int64)
    per, taken, top = -(-int(counts.sum()) // groups), 0, None
    for i in order:
        if top is None or taken >= per:
            top, taken = sizes[i], 0
        up[i] = top
        taken += counts[i]
    return up


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int, most: np.ndarray) -> tuple[float, list[int]]:
    """The configuration of largest value; a size at most as often as it occurs."""
    best = np.zeros(capacity + 1)
    choice = np.full((len(sizes), capacity + 1), 0, np.int16)
    for i, (s, v) in enumerate(zip(sizes, values)):
        if v <= 1e-12:
            continue
        new = best.copy()
        for c in range(1, min(int(most[i]), capacity // s) + 1):
            cand = np.full(capacity + 1, -1.0)
            cand[c * s :] = best[: capacity + 1 - c * s] + c * v
            better = cand > new + 1e-12
            new[better] = cand[better]
            choice[i][better] = c
        best = new
    at = int(best.argmax())
    value, out = float(best[at]), [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        out[i] = int(choice[i][at])
        at -= out[i] * sizes[i]
    return value, out


def configurations(sizes: list[int], demand: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns with multiplicities that hold the demand: column generation, rounded down; the rest is left."""
    m = len(sizes)
    if not m:
        return []
    cols = [[min(capacity // s, int(demand[i])) if i == j else 0 for j in range(m)] for i, s in enumerate(sizes)]
    basis = np.array(cols, float).T
    x = demand / np.diag(basis)
    for _ in range(40 * m):
        dual = np.linalg.solve(basis.T, np.ones(m))
        value, pattern = _knapsack(sizes, dual, capacity, demand)
        if value <= 1 + 1e-7:
            break
        d = np.linalg.solve(basis, np.array(pattern, float))
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * d
        x[out] = step
        x = np.maximum(x, 0)
        basis[:, out] = pattern
        cols[out] = pattern
    return [(list(map(int, cols[i])), int(np.floor(x[i] + 1e-9))) for i in range(m) if x[i] >= 1]


class _Plan:
    """Containers as classes of equal ones: (contents by length, room, how many)."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.rows: list[list] = []  # [contents {length: n}, room, count]

    def add(self, contents: dict[int, int], count: int) -> None:
        if count > 0:
            self.rows.append([contents, self.capacity - sum(k * v for k, v in contents.items()), count])

    def best_fit(self, size: int, n: int) -> None:
        """n items of one size, each into the fullest container that has room; new ones when none has."""
        while n:
            fits = [r for r in self.rows if r[1] >= size]
            if not fits:
                per = self.capacity // size
                full, rest = divmod(n, per)
                self.add({size: per}, full)
                if rest:
                    self.add({size: rest}, 1)
                return
            r = min(fits, key=lambda r: r[1])
            each = min(r[1] // size, n)
            take = min(r[2], n // each)
            contents = dict(r[0])
            contents[size] = contents.get(size, 0) + each
            r[2] -= take
            if not r[2]:
                self.rows.remove(r)
            self.rows.append([contents, r[1] - each * size, take])
            n -= each * take


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, groups: int = GROUPS) -> list[tuple[dict[int, int], int]]:
    """(contents by length, multiplicity) that hold exactly the histogram."""
    left = {int(s): int(c) for s, c in zip(sizes, counts) if c}
    out = _Plan(capacity)
    large = np.array(sorted((s for s in left if s > capacity * LARGE_SHARE), reverse=True), np.int64)
    if len(large):
        n = np.array([left[int(s)] for s in large])
        up = group_up(large, n, groups)
        kinds = sorted(set(up.tolist()), reverse=True)
        demand = np.array([n[up == k].sum() for k in kinds], float)
        queue = {k: [[int(s), left[int(s)]] for s in large[up == k]] for k in kinds}
        for pattern, times in configurations(kinds, demand, capacity):
            # real lengths take the places of their group, runs of equal containers at a time
            while times:
                if any(c and sum(q[1] for q in queue[k]) < c for k, c in zip(kinds, pattern)):
                    break
                run, contents = times, {}
                parts = []
                for k, c in zip(kinds, pattern):
                    if not c:
                        continue
                    q = queue[k]
                    # a container takes c of the longest lengths left; as many equal containers as the first length allows
                    if q[0][1] >= c:
                        run = min(run, q[0][1] // c)
                        parts.append((k, [(q[0][0], c)]))
                    else:
                        mix, need = [], c
                        for size, have in q:
                            t = min(need, have)
                            mix.append((size, t))
                            need -= t
                            if not need:
                                break
                        run = 1
                        parts.append((k, mix))
                for k, mix in parts:
                    for size, t in mix:
                        contents[size] = contents.get(size, 0) + t
                        for q in queue[k]:
                            if q[0] == size:
                                q[1] -= t * run
                        left[size] -= t * run
                    queue[k] = [q for q in queue[k] if q[1]]
                out.add(contents, run)
                times -= run
    for size in sorted(left, reverse=True):
        if left[size]:
            out.best_fit(size, left[size])
    return [(c, n) for c, _, n in out.rows]


def places(pattern_list: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, last number, containers from, per container): where the numbered items of a length go."""
    nxt: dict[int, int] = {}
    out, base = [], 0
    for contents, times in pattern_list:
        for size, c in sorted(contents.items()):
            a = nxt.get(size, 0)
            out.append((size, a, a + c * times - 1, base, c))
            nxt[size] = a + c * times
        base += times
    return out


# ------------------------------------------------------------ the operator


def pieces(counted: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, first_token, length): only texts longer than a container are cut."""
    n = F.ceil(F.col("tokens") / capacity).cast("int")
    d = counted.filter("tokens > 0").select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    first = F.col("i").cast("long") * capacity
    return d.select("doc_id", (F.col("i") + 1).cast("long").alias("piece_no"), first.alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - first).alias("length"))


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(container_id, doc_id, piece_no, first_token, length): the container of each text or piece.

    Null and empty texts take no part. Repeated document ids are placed row by
    row. Every container holds at most ``capacity`` tokens. An empty table gives
    no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "container_id long, doc_id long, piece_no long, first_token long, length long"
    p = cut(pieces(lengths(docs, path or f"{TOKENIZER_DIR}/{TOKENIZER}"), capacity).withColumn("row", F.monotonically_increasing_id()))
    hist = p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    if not hist:
        return spark.createDataFrame([], schema)
    rows = places(plan(np.array([r["length"] for r in hist]), np.array([r["n"] for r in hist]), capacity))
    numbered = stitched_ranks(p.select("length", "row"), ["length"], "row")
    numbered = p.join(numbered.select("row", (F.col("row_no") - 1).alias("no")), "row")
    # patterns are bounded by the capacity: sent as one small table, looked up by length and number
    table = spark.createDataFrame(rows, "length long, a long, z long, base long, per long")
    runs = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("a", "z", "base", "per"))).alias("runs"))
    hit = F.expr("filter(runs, r -> no BETWEEN r.a AND r.z)[0]")
    j = numbered.join(F.broadcast(runs), "length").withColumn("r", hit)
    return j.select((F.col("r.base") + F.floor((F.col("no") - F.col("r.a")) / F.col("r.per"))).cast("long").alias("container_id"), "doc_id", "piece_no", "first_token", "length")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: containers, tokens, and the share of the room that is filled."""
    per = packed(spark.read.parquet(f"{sf_dir}/documents.parquet")).groupBy("container_id").agg(F.sum("length").alias("used"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count(F.lit(1)) * CAPACITY), 6).alias("filled"), F.max("used").alias("fullest"))


QUERIES = {"p8_containers": placed, "p8_fill": fill}
SQL: dict[str, str] = {}
