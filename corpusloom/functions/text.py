"""Text expressions. Everything here stays inside the JVM; what cannot is in cleaning.py."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters that are an ASCII letter with marks.
_LETTERS = "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii())
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _LETTERS)
_MARKS = r"[̀-ͯ]"
WORD = r"(?U)\b[^\W\d_]{2,}\b"
LONG_WORD = "[a-záàâãéèêíïóôõúüç]{4,}"
#: Fixed value: pronouns joined to verbs by a hyphen.
_ENCLITIC = r"(?iU)\b[^\W\d_]+-(?:me|te|se|lhe|lhes|nos|vos|o|a|os|as|lo|la|los|las|no|na|nas)\b"
PARTICLES = ("da", "de", "do", "das", "dos", "e")


def strip_accents(c: Column) -> Column:
    """Accents removed, composed or not; case kept."""
    return F.translate(F.regexp_replace(c, _MARKS, ""), _LETTERS, _PLAIN)


def fold(c: Column) -> Column:
    return strip_accents(F.lower(c))


def squeeze(c: Column) -> Column:
    """White space single and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_name(c: Column) -> Column:
    """Name for comparison: no accents, single spaces, no dots at the ends, upper case."""
    return F.upper(F.regexp_replace(squeeze(strip_accents(c)), r"^[ .]+|[ .]+$", ""))


def same_person(a: Column, b: Column) -> Column:
    """Either normalised name holds the other; empty names match nobody."""
    return F.coalesce((a != "") & (b != "") & (a.contains(b) | b.contains(a)), F.lit(False))


def without_enclitics(c: Column) -> Column:
    return F.regexp_replace(c, _ENCLITIC, " ")


def tokens(c: Column) -> Column:
    """Words of at least two letters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def long_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({LONG_WORD})"), F.lit(1))


def bigrams(toks: Column) -> Column:
    """Neighbouring pairs of a token array; a word repeated is no pair."""
    n = F.size(toks)
    at = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(at, lambda i: F.when(F.get(toks, i) != F.get(toks, i + 1), F.concat_ws(" ", F.get(toks, i), F.get(toks, i + 1))))
    return F.filter(pairs, lambda x: x.isNotNull())


def without(toks: Column, words: Iterable[str]) -> Column:
    """Tokens that are not among a fixed list of words; order and repeats kept."""
    stop = sorted(words)
    return F.filter(toks, lambda t: ~t.isin(*stop))  # a long list becomes a hash set in the plan


def variant_key(c: Column) -> Column:
    """Folded word, a final s dropped from words longer than three."""
    f = fold(c)
    return F.when(f.endswith("s") & (F.length(f) > 3), F.substring(f, F.lit(1), F.length(f) - 1)).otherwise(f)


def keyword_body(keyword: str) -> str:
    """Pattern of a folded keyword: each word with an optional plural, any white space between."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", keyword.lower()) if not unicodedata.combining(c))
    return r"\s+".join(re.escape(w) + "(?:e?s)?" for w in plain.split())


def keyword_pattern(keyword: str) -> str:
    return rf"(?<!\w){keyword_body(keyword)}(?!\w)"


def any_keyword_pattern(keywords: Iterable[str]) -> str:
    """One pattern for all keywords, longest first, so overlapping keywords count once."""
    bodies = sorted(dict.fromkeys(map(keyword_body, keywords)), key=len, reverse=True)
    return rf"(?<!\w)(?:{'|'.join(bodies)})(?!\w)"


def display_name(c: Column) -> Column:
    """A name all in capitals gets title case with small particles; others stay."""
    name = F.trim(c)
    words = F.split(squeeze(F.lower(name)), " ")
    titled = F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*PARTICLES), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))))
    return F.when(name == F.upper(name), F.array_join(titled, " ")).otherwise(name)


def parse_speaker(c: Column) -> Column:
    """'NAME, PARTY-UF' as (name, party, state); anything else is a guest under the whole text."""
    text = squeeze(c)
    rx = r"^(.+?),\s*([^,]+?)\s*-\s*([A-Z]{2})$"
    hit = text.rlike(rx)
    blank = text.isNull() | (text == "")
    return F.struct(
        F.when(blank, "SEM NOME").when(hit, F.regexp_extract(text, rx, 1)).otherwise(text).alias("orador"),
        F.when(~blank & hit, F.regexp_extract(text, rx, 2)).otherwise("CONVIDADO").alias("partido"),
        F.when(~blank & hit, F.regexp_extract(text, rx, 3)).otherwise("").alias("estado"),
    )


def total_found(c: Column) -> Column:
    """N of 'de N documentos encontrados', 0 where none were found, else null."""
    n = F.regexp_extract(c, r"de\s+([\d.]+)\s+documentos?\s+encontrados?", 1)
    return F.when(n != "", F.replace(n, F.lit("."), F.lit("")).cast("long")).when(c.contains("Nenhum discurso encontrado"), F.lit(0).cast("long"))


def chunks(c: Column, n: int) -> Column:
    """Chunks of n words; a last one of less than a quarter joins the one before."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    size = F.size(words)
    last = size % n
    count = F.greatest(F.ceil(size / n) - F.when((last > 0) & (last < n / 4) & (size > n), 1).otherwise(0), F.lit(1)).cast("int")
    piece = lambda i: F.array_join(F.slice(words, i * n + 1, F.when(i == count - 1, F.greatest(size - i * n, F.lit(0))).otherwise(n)), " ")
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), count - 1), piece)).otherwise(F.array(c))


def search_expression(keywords: Iterable[str]) -> str:
    """Each keyword with and without accents, quoted, joined by OR."""
    out = []
    for k in keywords:
        bare = "".join(c for c in unicodedata.normalize("NFKD", k) if not unicodedata.combining(c))
        out += [k, bare]
    return " OR ".join(f'"{k}"' for k in dict.fromkeys(out))


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(strip_accents(c), r"[^\x00-\x7f]", "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def br_date(c: Column) -> Column:
    """Strict dd/mm/yyyy, day and month padded or not; anything else is null."""
    return F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(c, "d/M/yyyy"))


def decimal_comma(x: float, digits: int = 2) -> str:
    """A number with a decimal comma, trailing zeros dropped."""
    return f"{x:.{digits}f}".rstrip("0").rstrip(".").replace(".", ",")
