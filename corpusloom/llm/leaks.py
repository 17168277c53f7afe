"""Problem 9: passages of evaluation items inside a corpus, by winnowing.

Words are hashed to 64 bits, k-grams of K words to a polynomial of these, and of
each window of W consecutive k-grams the smallest hash is kept. A shared run of
K + W - 1 = MIN_RUN words therefore always shares a kept fingerprint. Items and
documents are fingerprinted alike and joined on the fingerprint; each hit is
extended word by word to the full shared run, which has to reach MIN_RUN.

Documents are read once, whatever the number of items: a bit filter of the items'
fingerprints, of bounded size, goes to the executors, and a document leaves the
scan (as word hashes) only with fingerprints that pass it. These meet the items'
fingerprints in a join, and each pair is verified on the word hashes of both.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.words import words
from corpusloom.session import broadcast_if_small, cut

MIN_RUN = 10
K, W = 5, 6
#: Bits of the filter per fingerprint, and its most bits (8 MB): beyond, more passes it and the join decides as before.
FILTER_BITS, MOST_BITS = 16, 1 << 26

_MULT = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word to 64-bit hash, kept as long as it stays small."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


def fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, values) kept by winnowing of an array of word hashes; texts shorter than a window keep their smallest."""
    n = len(hashes) - K + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    gram = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(K):
            gram = gram * _MULT + hashes[j : j + n]
        gram ^= gram >> np.uint64(29)
        gram *= np.uint64(0xBF58476D1CE4E5B9)
    if n <= W:
        at = np.array([n - 1 - int(np.argmin(gram[::-1]))])
        return at, gram[at]
    least = np.lib.stride_tricks.sliding_window_view(gram, W)
    # the rightmost smallest of each window
    at = np.unique(np.arange(n - W + 1) + W - 1 - least[:, ::-1].argmin(axis=1))
    return at, gram[at]


def _hash_words(ws: list[str], table: _Hashes) -> np.ndarray:
    return np.fromiter((table[w] for w in ws), np.uint64, len(ws))


def longest_run(doc: np.ndarray, item: np.ndarray, hits: Iterable[tuple[int, int]]) -> tuple[int, int]:
    """(longest, number) of the runs of at least MIN_RUN words that both share, extended from hits (place in the document, place in the item)."""
    longest = runs = 0
    done: set[tuple[int, int]] = set()
    for p, q in hits:
        if not np.array_equal(doc[p : p + K], item[q : q + K]):
            continue
        back = min(p, q)
        ne = np.flatnonzero(doc[p - back : p][::-1] != item[q - back : q][::-1])
        back = int(ne[0]) if len(ne) else back
        s, t = p - back, q - back
        if (s, t) in done:  # another hit of the same run
            continue
        done.add((s, t))
        m = min(len(doc) - s, len(item) - t)
        ne = np.flatnonzero(doc[s : s + m] != item[t : t + m])
        run = int(ne[0]) if len(ne) else m
        if run >= MIN_RUN:
            longest, runs = max(longest, run), runs + 1
    return longest, runs


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table = _Hashes()
    for pdf in batches:
        yield pd.DataFrame({"item": pdf["item"], "item_id": pdf["item_id"], "item_words": [_hash_words(words(t), table).tobytes() for t in pdf["text"]]})


def _item_prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i, w in zip(pdf["item"], pdf["item_words"]):
            at, values = fingerprints(np.frombuffer(w, np.uint64))
            yield pd.DataFrame({"fp": values.astype(np.int64), "item": i, "at": at.astype(np.int32)})


def bit_filter(prints: DataFrame, n: int) -> np.ndarray:
    """Two bits for every fingerprint, in words of 64; made by the executors, at most MOST_BITS of them."""
    bits = min(MOST_BITS, 1 << max(10, (FILTER_BITS * max(n, 1) - 1).bit_length()))
    place = F.explode(F.array(F.col("fp").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(bits - 1)))).alias("bit")
    bit = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    out = np.zeros(bits // 64, np.int64)
    for r in prints.select(place).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(bit).alias("mask")).collect():
        out[r["word"]] = r["mask"]
    return out.view(np.uint64)


def passes(mask: np.ndarray, values: np.ndarray) -> np.ndarray:
    size = np.uint64(len(mask) * 64 - 1)
    out = np.ones(len(values), bool)
    for bit in (values & size, (values >> np.uint64(32)) & size):
        out &= (mask[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return out


def _scan(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _Hashes()
        for pdf in batches:
            rows = []
            for r, d, x in zip(pdf["row"], pdf["doc_id"], pdf["text"]):
                ws = words(x)
                if len(ws) < MIN_RUN:
                    continue
                h = _hash_words(ws, table)
                at, values = fingerprints(h)
                hit = passes(shared.value, values)
                if hit.any():
                    rows.append((r, d, h.tobytes(), [{"p": int(p), "fp": int(f)} for p, f in zip(at[hit], values[hit].astype(np.int64))]))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "doc_words", "hits"])

    return run


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, d, a, b, hits in zip(pdf["item_id"], pdf["doc_id"], pdf["doc_words"], pdf["item_words"], pdf["hits"]):
            longest, runs = longest_run(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), [(h["p"], h["q"]) for h in hits])
            if runs:
                rows.append((i, d, longest, runs))
        yield pd.DataFrame(rows, columns=["item_id", "doc_id", "longest_run", "n_runs"])


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, doc_id, longest_run, n_runs): documents that share at least ten consecutive words with an item.

    Null ids or texts, and texts of fewer than ten words, take no part. Repeated
    ids of either side give a row each. Whole texts are read. Extra columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    i = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").withColumn("item", F.monotonically_increasing_id())
    item_words = cut(i.mapInPandas(_item_words, "item long, item_id long, item_words binary"))
    prints = cut(item_words.select("item", "item_words").mapInPandas(_item_prints, "fp long, item long, at int"))
    n = prints.count()
    shared = spark.sparkContext.broadcast(bit_filter(prints, n))
    near = cut(d.mapInPandas(_scan(shared), "row long, doc_id long, doc_words binary, hits array<struct<p: int, fp: long>>"))
    met = near.select("row", F.explode("hits").alias("h")).select("row", "h.p", "h.fp").join(broadcast_if_small(prints, n), "fp")
    pairs = met.groupBy("row", "item").agg(F.collect_list(F.struct("p", F.col("at").alias("q"))).alias("hits"))  # of one document and one item
    both = pairs.join(near.select("row", "doc_id", "doc_words"), "row").join(item_words, "item")
    return both.select("item_id", "doc_id", "doc_words", "item_words", "hits").mapInPandas(_verify, "item_id long, doc_id long, longest_run long, n_runs long")


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select("item_id", "doc_id").distinct()


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: how many documents hold it and the longest run of words seen."""
    return _read(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("longest_run").alias("longest_run"))


QUERIES = {"p9_found": found, "p9_items": report}
SQL: dict[str, str] = {}
_WORDS = r"list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_GRAMS = rf"""dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(range(1, len(w) - 8)) AS i, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM dw WHERE len(w) >= 10),
ig AS (SELECT item_id, unnest(range(1, len(w) - 8)) AS j, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM iw WHERE len(w) >= 10)"""
SQL["p9_found"] = f"WITH {_GRAMS} SELECT DISTINCT item_id, doc_id FROM dg JOIN ig USING (g)"
# consecutive ten-word matches at one shift are one run
SQL["p9_items"] = f"""WITH {_GRAMS}, hit AS (SELECT item_id, doc_id, i - j AS shift, i, i - row_number() OVER (PARTITION BY item_id, doc_id, i - j ORDER BY i) AS run FROM dg JOIN ig USING (g)),
runs AS (SELECT item_id, doc_id, shift, run, count(*) + 9 AS words FROM hit GROUP BY ALL)
SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(words) AS longest_run FROM runs GROUP BY 1"""
