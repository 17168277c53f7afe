"""Problem 10: per-document text quality statistics and outlier scores.

Each document gets statistics of its words, symbols, lines and punctuation.
Eight of them are shares of the text that prose hardly has (table rows, list
entries, code, noise, long tokens, unpronounceable words, repetition, signs).

1. Every statistic is split where two classes of documents are told apart best
   (Otsu's criterion on its histogram over all documents). Documents below every
   split are the reference.
2. Exact ranks within a language, by a range-partitioned sort of the values with
   partition offsets, give each value its tail probability among the reference
   documents of the language; a language of few documents leans on the whole
   collection as much as it is small.
3. The negative logarithms of the tail probabilities of at most TAIL are added up:
   the outlier score. A document whose score reaches CUT times the logarithm of
   the reference's size is not natural prose, and its kind is the one whose
   statistics carry the most of the tail.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from statistics import median_high

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.range_partials import stitched_ranks
from corpusloom.session import broadcast_if_small, cut

#: Function words of Portuguese, Spanish and English.
COMMON = frozenset(
    """a à ao aos as às até com como da das de del demais desde do dos e é ele ela eles elas em entre era essa esse esta este eu foi
    há isso já lhe lo los la las mais mas me mesmo muito na nas nem no nos não nós num numa o os ou para pela pelas pelo pelos por
    porque qual quando quanto que quem se sem ser seja sobre sua seu são só também te tem um uma uns umas vai você
    al con cuando donde el en es fue hasta más mientras ni otro para pero sigue según sin su sus una un y
    after an and are at be been but by can for from has have he in is it its not of on or she still that the their there they this to
    was were while who will with""".split()
)
#: Of these, the ones that join clauses rather than nouns.
CLAUSAL = frozenset(
    """até como desde é e era foi há já mas não nem nós porque quando que quem se seja segundo são sem também tem vai você
    cuando es fue hasta más mientras no pero sigue según y
    after and are but has have is not still that there they was were while who will with""".split()
)
#: Statistics of the score, by the kind they speak for; each is a share, 0 in plain prose.
EVIDENCE = {
    "table": ("table_part",),
    "list": ("list_part",),
    "junk": ("code_share", "noise_share", "long_part", "unvoiced_share", "repeated_part", "sign_part"),
}
SCORED = tuple(c for cs in EVIDENCE.values() for c in cs)
#: Reported besides.
MORE = ("n_words", "mean_word", "n_lines", "end_punct_share", "alpha_share", "symbol_share", "common_share", "clausal_share", "comma_rate")
#: Values are compared by thousandths.
STEPS = 1000
#: A split lies between these: a share of less does not make a document, one of more leaves no doubt.
LEAST_SPLIT, MOST_SPLIT = 0.4, 0.8
#: Reference documents a language must have to weigh as much as the whole collection.
POOLED = 200
#: Tail probabilities above this are no evidence.
TAIL = 0.005
#: Share of the logarithm of the reference's size that a score must reach (fitted on the sf0.1 documents): what at most a handful of reference documents reach by chance.
CUT = 0.9

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")
_DIGIT = re.compile(r"\d")
_VOWEL = re.compile(r"[aeiouyà-åè-ïò-öù-ü]")
_MARK = re.compile(r"\s*(?:[-–—•*·▪‣]|\(?\d{1,4}[.)ºª]|\(?[a-zA-Z][.)]|[IVXLC]+\s?[-–.)]|(?i:item|tópico|ponto|nº|n\.)\s*\d+\s*[-–.:)]?)\s+")
_CELL = re.compile(r"\s*\|\s*|\t+|\s*;\s*|\"\s*,\s*\"|\s{2,}|,(?=\S)")
_SINGLE = re.compile(r"\S\s(?=\S)")
_RULE = re.compile(r"[\s|+:=_-]+")
_HEX = re.compile(r"[0-9a-fA-F]{6,}[:\s]+(?:[0-9a-fA-F]{2,4}\s+){4,}")
_CODE = re.compile(r"<[^<>\n]{0,200}>|&[a-z]{2,8};|[\w.]*\([^()\n]{0,80}\)\s*\{[^{}\n]{0,200}\}|\{[^{}\n]{0,200}\}|https?://\S+")
_SENT = re.compile(r"(?<=[.!?…])[\"”’)]?\s+|\n+")
_FIGURE = re.compile(r"[\d.,%$€R/:–—-]+")

_NOISE = re.compile(r"~|!(?=[^\W_]|[!|~,])|(?<=\s)!|\|(?=[!~,])|[!~,]\|")
_GAP = re.compile(r"[|\t;]|\s{2}|\",|,(?=\S)")
_ENTRY = re.compile(r"[,;]\s+")
_WIDE = re.compile(r"\S\s{3,}(?=\S)")


def _line_kind(line: str) -> str:
    """'' for prose, 'table' or 'list' for one line without line end."""
    if _RULE.fullmatch(line):
        return "table" if ("|" in line or "+" in line) and len(line.strip()) > 2 else "rule"
    body = line.strip()
    if not _GAP.search(body) and len(body.split()) > 14:
        return ""  # no columns, and too long for an entry
    if "  " in body and len(_SINGLE.findall(body)) <= 0.1 * len(body.split()) and sum(w.lower() in COMMON for w in _WORD.findall(body)) >= 0.25 * len(body.split()):
        line = body = " ".join(body.split())  # sentences with nearly every space doubled have no columns
    cells = [c for c in _CELL.split(body.strip("|\"")) if c.strip()]
    if len(cells) >= 2 and 2 * sum(any(ch.isalnum() for ch in c) for c in cells) >= len(cells):
        longest = max(len(c.split()) for c in cells)
        separated = body.count("|") >= 2 or "\t" in body or body.count(";") >= 2 or '","' in body or _WIDE.search(line) is not None
        figures = sum(bool(_FIGURE.fullmatch(c.strip())) for c in cells)
        if separated and longest <= 6 and (len(cells) >= 3 or figures or "|" in body or "\t" in body):
            return "table"
        if figures >= 3 and figures == len(cells) and "  " in " ".join(re.split(r"\s", body)):
            return "table"
    ws = [w.lower() for w in _WORD.findall(body)]
    if not ws:
        return ""
    mark = _MARK.match(line)
    if not mark and all(w in COMMON for w in ws):
        return ""  # a piece of a sentence
    rest = body[mark.end() - (len(line) - len(line.lstrip())) :] if mark else body
    rest_words = [w.lower() for w in _WORD.findall(rest)]
    clausal = sum(w in CLAUSAL for w in rest_words)
    ended = rest.rstrip("\"”’) ").endswith((".", "!", "?", "…"))
    if mark and clausal == 0 and len(rest_words) <= 9:
        return "list"
    if mark and not ended and clausal <= 1 and len(rest_words) <= 6:
        return "list"
    if not mark and len(ws) <= 5 and clausal == 0 and not ended:
        return "list"
    return ""


def _inline_list(line: str) -> bool:
    """A line of many comma-separated bare entries."""
    parts = [p for p in _ENTRY.split(line) if p.strip()]
    if len(parts) < 6:
        return False
    sizes = [_WORD.findall(p.lower()) for p in parts]
    bare = sum(len(ws) <= 6 and not any(w in CLAUSAL for w in ws) for ws in sizes)
    return bare >= 0.85 * len(parts)


#: Words of one window of the test for repeated words: a longer text's vocabulary grows slower than its length.
WINDOW = 400


def _distinct_words(found: list[str]) -> float:
    """Four times the share of distinct words in the middle one of windows of WINDOW words over the whole text, the last one full too."""
    ends = [*range(WINDOW, len(found), WINDOW), len(found)]
    return 4 * median_high(len(set(w)) / len(w) for w in (found[max(0, e - WINDOW) : e] for e in ends))


def statistics_of(text: str) -> dict[str, float]:
    """The statistics of one non-blank text."""
    lines = [x for x in re.split(r"\r\n|\r|\n", text) if x.strip()]
    chars = len("".join(text.split()))
    found = _WORD.findall(text.lower())
    letters = sum(map(len, found))
    digits = len(_DIGIT.findall(text))
    n = max(len(found), 1)
    tokens = _TOKEN.findall(text)
    total = max(sum(len(x.strip()) for x in lines), 1)
    kinds = {"table": 0, "list": 0, "": 0, "rule": 0}
    labels = [_line_kind(x) for x in lines]
    n_entries = 0
    # a bare short line is an entry only among others; alone it is a title, and cut sentences are prose
    for i, (x, k) in enumerate(zip(lines, labels)):
        size = len(x.strip())
        if k == "" and len(x) > 60 and _inline_list(x):
            k = "list"
        elif k == "list" and not _MARK.match(x):
            near = [labels[j] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(labels)]
            if near.count("list") < min(2, len(near)):
                k = ""
        kinds[k] += size
        n_entries += k == "list"
    sents = [s.strip() for s in _SENT.split(text) if len(s.strip()) > 3]
    distinct = len(set(sents)) / len(sents) if len(sents) >= 4 else 1.0
    if len(found) >= 12:
        distinct = min(distinct, _distinct_words(found))
    if chars >= 60:  # the same few characters on and on
        distinct = min(distinct, len({text[i : i + 4] for i in range(0, len(text), 3)}) / max(1, min(len(text) // 3, 60)))
    code = sum(len(m) for m in _CODE.findall(text)) if "<" in text or "{" in text or "&" in text or "://" in text else 0
    hexed = sum(len(x.strip()) for x in lines if _HEX.match(x.strip() + " "))
    long = sum(len(t) for t in tokens if len(t) > 30)
    noise = min(1.0, len(_NOISE.findall(text)) / max(len(tokens), 1))
    long_words = [w for w in found if len(w) >= 4]
    unvoiced = sum(_VOWEL.search(w) is None for w in long_words)
    alpha = letters / max(chars, 1)
    code = min(1.0, max(code, hexed) / total)
    # what is code or noise is no table and no list, and what is a table or a list is no other junk
    sound = max(0.0, 1 - max(2 * code, 5 * noise))
    table, listed = kinds["table"] / total * sound, kinds["list"] / total * sound
    clausal = sum(w in CLAUSAL for w in found) / n
    listed *= min(1.0, max(0.0, 1.25 - 5 * clausal))  # entries hardly join clauses; sentences broken over short lines do
    rest = max(0.0, 1 - table - listed)
    return {
        "table_part": table, "list_part": listed, "code_share": code, "noise_share": noise, "long_part": long / max(chars, 1) * (1 - table),
        "unvoiced_share": unvoiced / len(long_words) if long_words else 0.0, "repeated_part": max(0.0, 1 - distinct) * rest, "sign_part": (1 - alpha) * rest,
        "n_words": len(found), "mean_word": letters / n, "n_lines": len(lines),
        "end_punct_share": sum(x.rstrip("\"”’) ").endswith((".", "!", "?", ":", ";", "…")) for x in lines) / max(len(lines), 1),
        "alpha_share": alpha, "symbol_share": max(0, chars - letters - digits) / max(chars, 1),
        "common_share": sum(w in COMMON for w in found) / n, "clausal_share": clausal,
        "comma_rate": (text.count(",") + text.count(";")) / n,
    }


_COLS = [*SCORED, *MORE]
_SCHEMA = "doc_id long, lang string, " + ", ".join(f"{c} double" for c in _COLS)


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for d, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"]):
            s = statistics_of(text)
            out.append((d, lang, *(float(s[c]) for c in _COLS)))
        yield pd.DataFrame(out, columns=["doc_id", "lang", *_COLS])


def measured(docs: DataFrame) -> DataFrame:
    """A cut table of the statistics of every document with non-blank text, one row per input row.

    Null and blank texts give no row. Language codes are compared by their first
    two letters in lower case; documents without one are a language of their own.
    """
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(lang, F.lit("")).alias("lang"), "text").filter(F.col("text").rlike(r"\S"))
    return cut(d.mapInPandas(_measure, _SCHEMA).withColumn("row_id", F.monotonically_increasing_id()))


def split_at(counts: np.ndarray) -> float:
    """Where the histogram of a share falls into two classes: largest variance between them, in the middle of equally good places."""
    x = np.arange(len(counts)) / STEPS
    low, mass = np.cumsum(counts, dtype=float), np.cumsum(counts * x)
    n, m = low[-1], mass[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((low > 0) & (low < n), (m * low / n - mass) ** 2 / (low * (n - low)), 0.0)
    if between.max() <= 0:
        return MOST_SPLIT
    best = np.flatnonzero(between >= between.max() * (1 - 1e-12))
    return float(np.clip(x[(best[0] + best[-1]) // 2], LEAST_SPLIT, MOST_SPLIT))


def _bin(c: str) -> F.Column:
    return F.round(F.least(F.col(c), F.lit(1.0)) * STEPS).cast("int")


def splits(m: DataFrame) -> dict[str, float]:
    """The split of each scored statistic, from its histogram over all documents (STEPS + 1 counts a statistic reach the driver)."""
    flat = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), _bin(c).alias("x")) for c in SCORED])).alias("p")).groupBy("p.stat", "p.x").agg(F.count(F.lit(1)).alias("n"))
    counts = {c: np.zeros(STEPS + 1) for c in SCORED}
    for r in flat.collect():
        counts[r["stat"]][r["x"]] = r["n"]
    return {c: split_at(h) if h.sum() else MOST_SPLIT for c, h in counts.items()}


def tails(m: DataFrame, at: dict[str, float]) -> tuple[DataFrame, int]:
    """(stat, lang, x, tail) of the values that are evidence, and the number of reference documents.

    Documents are first counted per (statistic, language, value), so what is
    sorted grows with the languages and not with the documents.
    """
    inside = F.lit(True)
    for c, t in at.items():
        inside &= _bin(c) <= round(t * STEPS)
    n = m.filter(inside).count()
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), _bin(c).alias("x")) for c in SCORED])).alias("p")
    values = m.select("lang", inside.cast("long").alias("ref"), pairs).groupBy("p.stat", "lang", "p.x").agg(F.sum("ref").alias("n"))
    values = cut(values.withColumn("down", -F.col("x")))
    pooled = cut(values.groupBy("stat", "down").agg(F.sum("n").alias("n")))
    own = stitched_ranks(values, ["stat", "lang"], "down", weight="n").withColumn("beyond", F.col("n_less") + F.col("n"))
    of_all = stitched_ranks(pooled, ["stat"], "down", weight="n").select("stat", "down", ((F.col("n_less") + F.col("n") + 1) / F.lit(n + 2.0)).alias("of_all"))
    sizes = m.filter(inside).groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    p = (F.col("beyond") + POOLED * F.col("of_all")) / (F.coalesce("size", F.lit(0)) + POOLED)
    ranked = own.join(of_all, ["stat", "down"]).join(sizes, "lang", "left").select("stat", "lang", "x", p.alias("p"))
    least = max(TAIL, 1.5 / (n + 2))
    return ranked.filter((F.col("x") > 0) & (F.col("p") <= least)).select("stat", "lang", "x", (-F.log("p")).alias("tail")), n


def outliers(m: DataFrame) -> DataFrame:
    """(row_id, doc_id, lang, score, kind) of the documents with any evidence; ``kind`` is 'prose' below the cut."""
    at = splits(m)
    beyond, n = tails(m, at)
    beyond = cut(beyond)
    # at most STEPS values a statistic and language; the count says whether that is little here
    small = broadcast_if_small(beyond)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), _bin(c).alias("x")) for c in SCORED])).alias("p")
    rows = m.select("row_id", "doc_id", "lang", pairs).select("row_id", "doc_id", "lang", "p.stat", "p.x").filter("x > 0").join(small, ["stat", "lang", "x"])
    weigh = F.create_map(*[x for c, t in at.items() for x in (F.lit(c), F.lit(1 / (t * STEPS)))])[F.col("stat")]
    carried = F.col("tail") * F.col("x") * weigh
    by_kind = [F.max(F.when(F.col("stat").isin(*cs), carried)).alias(k) for k, cs in EVIDENCE.items()]
    scored = rows.groupBy("row_id", "doc_id", "lang").agg(F.sum("tail").alias("score"), *by_kind)
    kind, best = F.lit("prose"), F.greatest(*[F.coalesce(k, F.lit(0.0)) for k in EVIDENCE])
    for k in EVIDENCE:
        kind = F.when(F.col(k) == best, F.lit(k)).otherwise(kind)
    return scored.select("row_id", "doc_id", "lang", F.round("score", 6).alias("score"), F.when(F.col("score") >= CUT * math.log(n + 2), kind).otherwise("prose").alias("kind"))


def outlier_scores(docs: DataFrame) -> DataFrame:
    """The statistics with ``score``, ``kind`` and ``score_share`` (share of the language with a score not larger).

    A collection without any reference document is compared with an ideal one
    of plain prose. Repeated ids and texts are scored row by row, ties alike; an
    empty table gives no rows; other columns are ignored.
    """
    m = measured(docs)
    scored = outliers(m).select("row_id", "score", "kind")
    full = cut(m.join(scored, "row_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("kind", F.coalesce("kind", F.lit("prose"))))
    sizes = full.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    placed = stitched_ranks(full.select("row_id", "lang", (-F.col("score")).alias("down")), ["lang"], "down", ["row_id"])
    share = placed.join(broadcast_if_small(sizes), "lang").select("row_id", (F.lit(1.0) - F.col("n_less") / F.col("size")).alias("score_share"))
    return full.join(share, "row_id")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose outlier score reaches the cut, with the kind that carries it."""
    m = measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return outliers(m).filter(F.col("kind") != "prose").select("doc_id", "kind").distinct()


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = outlier_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select("doc_id", "lang", "kind", *_COLS, "score", "score_share")


QUERIES = {"p10_found": found, "p10_statistics": report}
SQL: dict[str, str] = {}
