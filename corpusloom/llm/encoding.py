"""Problem 3: text garbled by a wrong character encoding.

Each record has a latent chain (which bytes were written, how they were read) or
is clean. A JVM filter keeps the records with anything that could be damage; for
these the chains that explain their sequences are listed with the characters
they would restore. Expectation-maximisation pools this weak evidence: the E-step
gives each record a posterior over its chains and "clean", the M-step re-fits the
share of each chain per (source, field), of each restored character, and of each
suspicious sequence among clean records, over all records. What a question mark
behind a word means is told by the collection: how often words that this stem and
an accented letter make occur, and how often the stem ends a question. Records
are found and repaired by their posterior.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import broadcast_if_small, cut

#: What correct text of this collection is written with, besides ASCII.
LETTERS = "áàâãéèêíïóôõúüçñÁÀÂÃÉÈÊÍÏÓÔÕÚÜÇÑ"
SIGNS = "§ºª–—“”‘’…°€"
#: Of these, the ones whose plain presence proves nothing.
NATURAL = "áàâãéèêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇ§ºª–—“”‘’…°"
_UPPER = "ÁÀÂÃÉÊÍÓÔÕÚÜÇ"

WORDS_OF_ONE = "àéóáêÀÉÓÁÊ"

#: (written as, read as) of each chain; a pair of pairs was read wrongly twice.
CHAINS = {
    "utf8>cp1252": [("utf-8", "cp1252")],
    "utf8>latin1": [("utf-8", "latin-1")],
    "utf8>mac_roman": [("utf-8", "mac_roman")],
    "utf8>cp437": [("utf-8", "cp437")],
    "utf8>cp850": [("utf-8", "cp850")],
    "utf8>cp1250": [("utf-8", "cp1250")],
    "utf8>cp1251": [("utf-8", "cp1251")],
    "utf8>latin2": [("utf-8", "iso8859-2")],
    "utf8>cp1252>utf8>cp1252": [("utf-8", "cp1252"), ("utf-8", "cp1252")],
    "utf8>latin1>utf8>latin1": [("utf-8", "latin-1"), ("utf-8", "latin-1")],
    "cp1252>cp437": [("cp1252", "cp437")],
    "cp1252>cp850": [("cp1252", "cp850")],
    "cp1252>mac_roman": [("cp1252", "mac_roman")],
    "cp1252>cp1250": [("cp1252", "cp1250")],
    "cp1252>cp1251": [("cp1252", "cp1251")],
    "cp850>cp1252": [("cp850", "cp1252")],
    "mac_roman>cp1252": [("mac_roman", "cp1252")],
}
#: Chains that keep nothing of the character.
LOST = {"lost>replacement": "�", "lost>question": "?"}
CLEAN = "clean"
#: Stands for a character inside a suspicious run that the chain leaves as it is; it speaks against the chain.
KEPT = "="

# every alternative begins at the character in doubt, so a scan passes over plain letters at once
_SUSPICIOUS = rf"(?=[^\x00-\x7e])(?:[^\x00-\x7e{NATURAL}̀-ͯ]|[ÃÂ][§ºª°–—“”‘’…]|(?<=[a-záàâãéêíóôõúüç])[{_UPPER}§](?![A-Z]))"
_QL = "A-Za-záàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇ"
_QUESTION = rf"(?<=[{_QL}?])\?+[{_QL}](?![\w.-]*=)|(?<!\S)\?+[a-zà-ÿ]|(?<=\s)\?\s[a-zà-ÿ]"
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
#: After a word and a question mark: the sentence goes on, or it ends.
_GOES_ON, _ENDS = r"^(?:\s[a-zà-öø-ÿ]|[,.;:](?:$|\W))", r"^\s*(?:$|\s[^\sa-zà-öø-ÿ])"
_OPEN_END = rf"(?<=[{_L}])\?(?:\s[a-zà-öø-ÿ]|[,.;:](?!\w))"
_ACCENT_END = rf"(?<![{_L}])([{_L}]*[áàâãéêíóôõúÁÀÂÃÉÊÍÓÔÕÚ])(?![{_L}])"
#: Longest stem looked at.
STEM = 40
_RUN = re.compile(r"[^\x00-\x7f]+")
_RX = {"s": re.compile(_SUSPICIOUS), "q": re.compile(_QUESTION)}
_URL = re.compile(r"\S*(?:://|www\.|\w\.\w+/)\S*|\S+\?\w+=\S*")
_MIXED = re.compile(rf"(?<=[a-záàâãéêíóôõúüç])[{_UPPER}§](?![A-Z])")


def _read(data: bytes, codec: str) -> str:
    """Decoded byte by byte; bytes the codec leaves open come through as control characters."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def damage(text: str, chain: str) -> str:
    """What the chain makes of correct text."""
    for written, read in CHAINS[chain]:
        text = _read(text.encode(written, "replace"), read)
    return text


@cache
def _inverse(chain: str) -> tuple[dict[str, str], re.Pattern]:
    """Damaged sequence -> character, and the pattern of these, longest first."""
    out: dict[str, str] = {}
    for c in LETTERS + SIGNS + "\ufeff":
        try:
            bad = damage(c, chain)
        except UnicodeEncodeError:
            continue
        if bad != c and "?" not in bad:
            out.setdefault(bad, c)
    return out, re.compile("|".join(map(re.escape, sorted(out, key=len, reverse=True))))


def _suspects(text: str) -> list[tuple[str, bool]]:
    """The runs of non-ASCII characters that correct text would not have, and whether each stands alone, without a letter beside it."""
    out = []
    for m in _RUN.finditer(text):
        run = m.group()
        at = text[m.start() - 1 : m.end() + 1] if m.start() else text[: m.end() + 1]
        if _RX["s"].search(at) and run.strip("̧̀́̂̃̈"):
            out.append((run, not (text[m.start() - 1 : m.start()].isalpha() or text[m.end() : m.end() + 1].isalpha())))
    return out


def _in_order(run: str, alone: bool, chain: str) -> list[str] | None:
    """The characters a run restores to under a chain, null if part of it is not explained or one lone sign would be a letter that is no word."""
    back, rx = _inverse(chain)
    out, at = [], 0
    for m in rx.finditer(run):
        if any(c not in NATURAL for c in run[at : m.start()]):
            return None
        out += [KEPT] * (m.start() - at)
        out.append(back[m.group()])
        at = m.end()
    if not out or any(c not in NATURAL for c in run[at:]):
        return None
    if alone and len(run) == 1 and out[0] in LETTERS and out[0] not in WORDS_OF_ONE:
        return None
    return out + [KEPT] * (len(run) - at)


def evidence(text: str, field: str, ends: int = 0) -> tuple[int, list[tuple[str, int, list[str]]]]:
    """Suspicious sequences of a text, and per chain how many stay unexplained and what it restores.

    ``ends`` are stems with a question mark; only the chain that loses letters explains them.
    """
    runs = _suspects(text)
    bare = _URL.sub(" ", text) if "?" in text else text
    marks = len(_RX["q"].findall(bare)) if "?" in bare else 0
    if field == "orador":
        marks = bare.count("?")
    out = []
    total = len(runs) + marks + ends
    if not total:
        return 0, out
    lost = sum("�" in r for r, _ in runs)
    if lost:
        out.append(("lost>replacement", total - lost, ["�"] * lost))
    if marks or ends:
        out.append(("lost>question", total - marks - ends, ["?"] * marks))
    distinct: dict[tuple[str, bool], int] = {}
    for r in runs:
        if "�" not in r[0]:
            distinct[r] = distinct.get(r, 0) + 1
    for chain in CHAINS if distinct else ():
        chars: list[str] = []
        left = marks + lost + ends
        for r, n in distinct.items():
            got = _in_order(*r, chain)
            if got is None:
                left += n
            else:
                chars += got * n
        if chars:
            out.append((chain, left, chars))
    return total, out


def restore(text: str, chain: str) -> str:
    """The text with the chain undone; single characters that correct text has too only where the case around them is wrong."""
    if chain == CLEAN or chain in LOST:
        return text
    back, rx = _inverse(chain)
    whole = all(r in back or all(rx.fullmatch(c) for c in r) for r in _RUN.findall(text))

    def one(m: re.Match) -> str:
        seq = m.group()
        if len(seq) == 1 and seq in NATURAL and not whole and not _MIXED.match(text, m.start()):
            return seq
        return back[seq]

    return rx.sub(one, text).replace("\ufeff", "")


@cache
def _order() -> list[str]:
    return list(CHAINS)


def repair(text: str) -> str:
    """One text alone, without pooled evidence: the chain that explains most of it, if any."""
    if text.isascii() or not _RX["s"].search(text):
        return text
    total, found = evidence(text, "")
    best = min((x for x in found if x[0] in CHAINS and 2 * x[1] < total), key=lambda x: (x[1], len(x[2])), default=None)
    return restore(text, best[0]) if best else text


#: Chance that a sequence is found under a chain that does not explain it.
CHAIN_RARE = 1e-6
#: Share of damaged records assumed at the start; weight of the shares' prior in records, and of the prior of a sequence among clean ones.
DAMAGED, SHARE_WEIGHT, FORM_WEIGHT = 0.05, 10.0, 1e6
#: Chance of a lost letter at each place of a mark, and of a lost letter that ends its word.
LOST_MARK, LOST_END = 0.05, 0.3
ROUNDS = 4


def rarity(form: str) -> float:
    """How rare a suspicious sequence is in clean text before the collection has been seen: single letters come with foreign names."""
    return 1e-6 if len(form) == 1 and "LATIN" in unicodedata.name(form, "") else 1e-7


def forms_of(text: str, field: str) -> list[tuple[str, int, float]]:
    """(sequence, times, rarity) of what would have to stand in clean text; marks inside words count as one form."""
    out: dict[str, int] = {}
    for run, _ in _suspects(text):
        out[run] = out.get(run, 0) + 1
    bare = _URL.sub(" ", text) if "?" in text else ""
    marks = bare.count("?") if field == "orador" else len(_RX["q"].findall(bare)) if bare else 0
    if marks:
        out["?"] = marks
    return [(f, n, rarity(f)) for f, n in out.items()]


_EVIDENCE = "row_id long, id long, source string, field_name string, ends int, chains array<struct<chain: string, left: int, chars: array<string>>>, forms array<struct<form: string, n: int, base: double>>"


def _list_evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r, i, s, f, v, stems in zip(pdf["row_id"], pdf["id"], pdf["source"], pdf["field_name"], pdf["value"], pdf["stems"]):
            total, chains = evidence(v, f, len(stems))
            if total:
                out.append((r, i, s, f, len(stems), [{"chain": c, "left": n, "chars": chars} for c, n, chars in chains], [{"form": g, "n": n, "base": b} for g, n, b in forms_of(v, f)]))
        yield pd.DataFrame(out, columns=["row_id", "id", "source", "field_name", "ends", "chains", "forms"])


def _stems(c: F.Column, after: str) -> F.Column:
    """The lower-cased words right before the question marks that are followed so; only the ends of the pieces between the marks are looked at."""
    pieces = F.split(c, r"\?", -1)
    at = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: (i < F.size(pieces) - 1) & F.get(pieces, i + 1).substr(1, 3).rlike(after))
    words = F.transform(at, lambda i: F.lower(F.regexp_extract(F.right(F.get(pieces, i), F.lit(STEM)), rf"([{_L}]+)$", 1)))
    return F.filter(words, lambda w: w != "")


def suspicious(rows: DataFrame, fields: tuple[str, ...], source: F.Column) -> DataFrame:
    """(id, source, field_name, value, stems) of the values with anything that could be damage; null values have none."""
    tests = []
    for f in fields:
        c = F.col(f)
        if f == "orador":
            stems, hit = F.array().cast("array<string>"), c.rlike(_SUSPICIOUS) | c.contains("?")
        else:
            asks = c.contains("?") & c.rlike(_OPEN_END)
            stems = F.when(asks, _stems(c, _GOES_ON)).otherwise(F.array().cast("array<string>"))
            hit = c.rlike(_SUSPICIOUS) | (c.contains("?") & (asks | c.rlike(_QUESTION)))
        tests.append(F.when(hit, F.struct(F.lit(f).alias("field_name"), c.alias("value"), stems.alias("stems"))))
    found = rows.select(F.col("id").cast("long").alias("id"), source.alias("source"), F.array_compact(F.array(*tests)).alias("f"))
    return found.filter(F.size("f") > 0).select("id", "source", F.explode("f").alias("f")).select("id", "source", "f.field_name", "f.value", "f.stems")


def end_chances(rows: DataFrame, fields: tuple[str, ...], stems: DataFrame) -> DataFrame:
    """(stem, lost, clean): log chances of a stem with a question mark in the middle of a sentence.

    ``lost``: the words made of the stem and an accented letter among all words that
    end in one. ``clean``: how often the stem ends a question, times how often a
    question goes on in lower case at all. Only the stems met are counted.
    """
    asked = stems.groupBy("stem").agg(F.sum("n").alias("n_open"))
    asked = broadcast_if_small(cut(asked))
    texts = [f for f in fields if f != "orador"]
    ends = lambda c: F.regexp_extract_all(c, F.lit(_ACCENT_END), F.lit(1))
    shut = lambda c: F.when(c.contains("?"), _stems(c, _ENDS)).otherwise(F.array().cast("array<string>"))
    parts = []
    for f in texts:
        parts += [F.transform(ends(F.col(f)), lambda w: F.struct(F.lit("a").alias("kind"), F.lower(F.substring(w, F.lit(1), F.length(w) - 1)).alias("stem"))), F.transform(shut(F.col(f)), lambda w: F.struct(F.lit("s").alias("kind"), w.alias("stem")))]
    met = rows.select(F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("x")).select("x.kind", "x.stem")
    counted = cut(met.join(asked.select("stem").withColumn("known", F.lit(True)), "stem", "left").groupBy("kind", F.when(F.col("known"), F.col("stem")).alias("stem")).agg(F.count(F.lit(1)).alias("n")))
    per = counted.filter("stem IS NOT NULL").groupBy("stem").agg(F.sum(F.when(F.col("kind") == "a", F.col("n"))).alias("a"), F.sum(F.when(F.col("kind") == "s", F.col("n"))).alias("s"))
    totals = counted.agg(F.sum(F.when(F.col("kind") == "a", F.col("n"))).alias("all_a"), F.sum(F.when(F.col("kind") == "s", F.col("n"))).alias("all_s"))
    values = rows.agg(*[F.count(f).alias(f) for f in texts]).select(sum((F.col(f) for f in texts[1:]), F.col(texts[0])).alias("values"))
    # questions that go on: only stems that no accented letter makes a word
    open_all = asked.join(per.filter("a > 0").select("stem"), "stem", "left_anti").agg(F.coalesce(F.sum("n_open"), F.lit(0)).alias("all_open"))
    j = asked.join(per, "stem", "left").crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(values)).crossJoin(F.broadcast(open_all))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    lost = LOST_END * (zero("a") + 1e-3) / (zero("all_a") + 1)
    clean = (zero("s") + 0.1) / F.greatest(F.col("values"), F.lit(1)) * (F.col("all_open") + 1) / (zero("all_s") + 1)
    return j.select("stem", F.log(lost).alias("lost"), F.log(F.least(clean, F.lit(1.0))).alias("clean"))


def posteriors(rows: DataFrame, fields: tuple[str, ...], source: F.Column) -> tuple[DataFrame, DataFrame]:
    """(values, posteriors): the values with any sign of damage, (row_id, id, source, field_name, value),
    and (row_id, id, source, field_name, clean, chains) with the chance of each.

    Null and empty values have no rows. Repeated ids stay apart by ``row_id``. An
    empty input gives empty results. Extra columns are ignored.
    """
    spark = rows.sparkSession
    values = cut(suspicious(rows, fields, source).withColumn("row_id", F.monotonically_increasing_id()))
    e = cut(values.mapInPandas(_list_evidence, _EVIDENCE))
    stems = cut(values.select("row_id", F.explode("stems").alias("stem")).groupBy("row_id", "stem").agg(F.count(F.lit(1)).alias("n")))
    chances = cut(end_chances(rows, fields, stems))
    by_row = stems.join(broadcast_if_small(chances), "stem").groupBy("row_id").agg(F.sum(F.col("n") * F.col("lost")).alias("end_lost"), F.sum(F.col("n") * F.col("clean")).alias("end_clean"))
    e = cut(e.join(by_row, "row_id", "left").withColumns({"end_lost": F.coalesce("end_lost", F.lit(0.0)), "end_clean": F.coalesce("end_clean", F.lit(0.0))}))
    sizes = rows.select(source.alias("source"), *[F.col(f).isNotNull().cast("int").alias(f) for f in fields]).groupBy("source").agg(*[F.sum(f).alias(f) for f in fields])
    sizes = cut(sizes.select("source", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("n_all")) for f in fields])).alias("x")).select("source", "x.*"))
    n_values = sizes.agg(F.sum("n_all").alias("n")).first()["n"] or 0
    kinds = [*CHAINS, *LOST]
    alphabet = LETTERS + SIGNS
    theta = {c: -math.log(len(alphabet)) for c in alphabet}
    fixed = {"�": math.log(0.5), "?": math.log(LOST_MARK), KEPT: math.log(1e-3)}
    key = ["source", "field_name"]
    start = DAMAGED / len(kinds)
    shares, clean = None, None
    for step in range(ROUNDS):
        lookup = F.create_map(*[x for c, v in (theta | fixed).items() for x in (F.lit(c), F.lit(v))])
        if step == 0:
            d = e.withColumn("clean", F.aggregate("forms", F.col("end_clean"), lambda a, x: a + x["n"] * F.log(x["base"])) + math.log(1 - DAMAGED))
            share_of = lambda c: F.lit(start)
        else:
            d = e.join(broadcast_if_small(shares), key).join(clean, "row_id", "left")
            d = d.withColumn("clean", F.coalesce("forms_clean", F.lit(0.0)) + F.col("end_clean") + F.log("clean_share"))
            share_of = lambda c: F.coalesce(F.col("shares")[c], F.col("least"))
        lp = F.transform(
            "chains",
            lambda x: F.struct(
                x["chain"].alias("chain"),
                x["chars"].alias("chars"),
                (F.log(share_of(x["chain"])) + F.aggregate(x["chars"], F.lit(0.0), lambda a, c: a + F.coalesce(F.element_at(lookup, c), F.lit(-9.0))) + x["left"] * math.log(CHAIN_RARE) + F.when(x["chain"] == "lost>question", F.col("end_lost")).otherwise(0.0)).alias("lp"),
            ),
        )
        d = d.withColumn("lp", lp).withColumn("top", F.greatest(F.col("clean"), F.array_max(F.transform("lp", lambda x: x["lp"]))))
        d = d.withColumn("norm", F.exp(F.col("clean") - F.col("top")) + F.aggregate("lp", F.lit(0.0), lambda a, x: a + F.exp(x["lp"] - F.col("top"))))
        post = d.select(
            "row_id", "id", *key, "forms", (F.exp(F.col("clean") - F.col("top")) / F.col("norm")).alias("clean"),
            F.transform("lp", lambda x: F.struct(x["chain"].alias("chain"), x["chars"].alias("chars"), (F.exp(x["lp"] - F.col("top")) / F.col("norm")).alias("p"))).alias("chains"),
        )
        if step == ROUNDS - 1:
            return values, cut(post)
        post = cut(post)
        flat = post.select(*key, F.explode("chains").alias("c")).select(*key, "c.chain", "c.chars", "c.p")
        mass = flat.groupBy(*key, "chain").agg(F.sum("p").alias("mass"))
        # a small prior keeps rare chains possible
        prior = SHARE_WEIGHT * DAMAGED / len(kinds)
        per_chain = sizes.join(mass, key).withColumn("share", (F.col("mass") + prior) / (F.col("n_all") + SHARE_WEIGHT))
        maps = per_chain.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("chain", "share"))).alias("shares"), F.sum("mass").alias("mass"))
        shares = cut(sizes.join(maps, key).select(*key, "shares", (prior / (F.col("n_all") + SHARE_WEIGHT)).alias("least"), F.greatest(1 - (F.col("mass") + SHARE_WEIGHT * DAMAGED) / (F.col("n_all") + SHARE_WEIGHT), F.lit(1e-6)).alias("clean_share")))
        got = flat.filter(F.col("chain").isin(*CHAINS)).select(F.explode("chars").alias("c"), "p").groupBy("c").agg(F.sum("p").alias("p")).collect()  # no more than the alphabet
        whole = sum(r["p"] for r in got if r["c"] in theta) + len(alphabet)
        theta = {c: math.log(1 / whole) for c in alphabet} | {r["c"]: math.log((r["p"] + 1) / whole) for r in got if r["c"] in theta}
        forms = post.select("row_id", "clean", F.explode("forms").alias("f")).select("row_id", "clean", "f.form", "f.n", "f.base")
        psi = forms.groupBy("form", "base").agg(F.sum("clean").alias("mass")).select("form", F.log((F.col("mass") + FORM_WEIGHT * F.col("base")) / (n_values + FORM_WEIGHT)).alias("psi"))
        clean = cut(forms.join(psi, "form").groupBy("row_id").agg(F.sum(F.col("n") * F.col("psi")).alias("forms_clean")))
    raise AssertionError("no rounds")


def _restored(values: pd.Series, chains: pd.Series) -> pd.Series:
    return pd.Series([v if c is None else restore(v, c) for v, c in zip(values, chains)])


def repaired(rows: DataFrame, fields: tuple[str, ...], source: F.Column) -> DataFrame:
    """(id, field_name, value, chain, p, restored) of the values that are more likely damaged than clean.

    ``chain`` is the one with the highest posterior; ``restored`` is null where
    the characters are lost.
    """
    values, post = posteriors(rows, fields, source)
    best = F.array_max(F.transform("chains", lambda x: F.struct(x["p"].alias("p"), x["chain"].alias("chain"))))
    bad = post.filter("clean < 0.5").select("row_id", (1 - F.col("clean")).alias("p"), best["chain"].alias("chain"))
    undo = F.pandas_udf(_restored, "string")
    j = values.join(bad, "row_id").filter(F.col("chain").isNotNull())
    return j.select("id", "field_name", "value", "chain", F.round("p", 6).alias("p"), F.when(~F.col("chain").isin(*LOST), undo("value", "chain")).alias("restored"))


def _speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/speeches.parquet").select("id", "url", "orador", "discurso")
    return repaired(s, ("orador", "discurso"), F.coalesce(F.regexp_extract("url", r"^\w+://([^/?]+)", 1), F.lit("")))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values whose posterior says that they are damaged."""
    return _speeches(spark, sf_dir).select("id", "field_name").distinct()


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speeches(spark, sf_dir)


QUERIES = {"p3_found": found, "p3_repaired": report}
SQL: dict[str, str] = {}
