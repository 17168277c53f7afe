"""Problem 1: spellings typed by people that mean the same person or party.

Stored values are first reduced to what they name (encoding repaired, titles,
party suffixes and roles cut, inverted order undone) and folded (case, accents,
doubled letters, silent h, y/i, w/v, z/s), so most variants already share a form.
The remaining typos are found by a pigeonhole segment join: a form within K edits
of another keeps one of its K + 1 segments untouched, so position-shifted
substrings are looked up in an inverted index of segments and the hits verified
by a banded edit distance. What is indexed is the surname pair, which tells people
apart, and for short spellings given name plus surname; whole names are then
compared word by word (initials, nicknames, dropped words). Each form points to
the best fuller or more frequent form it fits, and pointers are followed to their
root; nothing is merged by mere reachability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.encoding import repair
from corpusloom.llm.words import plain
from corpusloom.session import broadcast_if_small, cut

K = 2
NOBODY = ("", "SEM NOME")
#: A first word of this share of all forms, and at least so many, is a given name.
GIVEN_SHARE, GIVEN_LEAST = 0.001, 3

#: Titles, suffixes and nicknames of Brazilian names.
TITLES = frozenset("DEP DEPUTADO DEPUTADA SR SRA DR DRA DOUTOR DOUTORA SENADOR SENADORA SEN PROFESSOR PROFESSORA PROF PROFA CORONEL CEL CAPITAO CAP MAJOR SARGENTO SGT DELEGADO DELEGADA DEL PASTOR PASTORA PADRE PE MINISTRO MINISTRA VEREADOR VEREADORA VER GENERAL GAL TENENTE TEN CABO O A EXMO EXMA ENG ENGENHEIRO ENGENHEIRA".split())
SUFFIXES = {"NETO": "NETO", "NETTO": "NETO", "FILHO": "FILHO", "FILIO": "FILHO", "FO": "FILHO", "JUNIOR": "JUNIOR", "JR": "JUNIOR", "SOBRINHO": "SOBRINHO", "SEGUNDO": "SEGUNDO"}
PARTICLES = frozenset("DE DA DO DAS DOS E".split())
NICKNAMES = {
    "BETO": "ROBERTO ALBERTO GILBERTO", "BETINHO": "ROBERTO ALBERTO", "TINHO": "", "CHICO": "FRANCISCO", "CHIQUINHO": "FRANCISCO", "CHICA": "FRANCISCA", "ZE": "JOSE", "ZEZINHO": "JOSE", "ZECA": "JOSE",
    "QUINCAS": "JOAQUIM", "QUIM": "JOAQUIM", "QUINZINHO": "JOAQUIM", "MUNDICO": "RAIMUNDO", "MUNDINHO": "RAIMUNDO", "MUNDICA": "RAIMUNDA", "MUNDINHA": "RAIMUNDA", "TIAO": "SEBASTIAO", "BASTIAO": "SEBASTIAO",
    "BEBEL": "ISABEL", "BEL": "ISABEL", "ISA": "ISABEL", "LEO": "LEONARDO LEANDRO LEONEL", "NANDA": "FERNANDA", "NANDO": "FERNANDO", "TECA": "TERESA", "TETE": "TERESA", "TERE": "TERESA", "CAO": "CONCEICAO",
    "SAO": "CONCEICAO", "CECA": "CONCEICAO", "TONHO": "ANTONIO", "TONINHO": "ANTONIO", "TONICO": "ANTONIO", "TONHA": "ANTONIA", "TONINHA": "ANTONIA", "DUDA": "EDUARDO EDUARDA", "DUDU": "EDUARDO", "EDU": "EDUARDO",
    "GUGA": "GUSTAVO", "GUTO": "AUGUSTO GUSTAVO", "MANE": "MANOEL MANUEL", "MANECO": "MANOEL", "MANEL": "MANOEL", "MANUCA": "MANOEL", "VAVA": "VALDEMAR VALTER", "DEMA": "VALDEMAR", "JOCA": "JOAO", "JOAOZINHO": "JOAO",
    "JANGO": "JOAO", "LULA": "LUIS LUIZ", "LULU": "LUIS LUISA LUCIA", "LUISINHO": "LUIS", "LUIZINHO": "LUIS", "LUISINHA": "LUISA", "LUCINHA": "LUCIA", "LU": "LUCIA LUISA", "MARIINHA": "MARIA", "MARIAZINHA": "MARIA", "MARICOTA": "MARIA",
    "MARCINHA": "MARCIA", "MARCINHO": "MARCIO", "MARCELINHO": "MARCELO", "MARCELINHA": "MARCELA", "CLAUDINHO": "CLAUDIO", "CLAUDINHA": "CLAUDIA", "DINHO": "CLAUDIO", "GABI": "GABRIELA", "BIA": "BEATRIZ", "BEA": "BEATRIZ", "DEDE": "DEBORA",
    "DEBINHA": "DEBORA", "LENA": "HELENA", "LENINHA": "HELENA", "NENA": "HELENA", "ZAZA": "ZACARIAS", "ZACA": "ZACARIAS", "FABINHO": "FABIO", "BINHO": "FABIO", "FLAVINHA": "FLAVIA", "RO": "ROSANGELA", "ROSINHA": "ROSANGELA ROSA", "ROSE": "ROSANGELA", "ANJA": "ANGELA",
    "ANGELINHO": "ANGELO", "ANGELINHA": "ANGELA", "INACINHO": "INACIO", "NECO": "INACIO", "SERGINHO": "SERGIO", "ROGERINHO": "ROGERIO", "PATI": "PATRICIA", "TICA": "PATRICIA", "VE": "VERONICA", "ZULU": "ZULEIDE", "ZU": "ZULEIDE", "TANINHA": "TANIA",
    "TAVINHO": "OTAVIO", "TAVINHA": "OTAVIA", "TAVO": "OTAVIO", "ADRIANINHA": "ADRIANA", "DRICA": "ADRIANA", "DRIKA": "ADRIANA", "CELINHA": "CELIA", "NEZINHA": "INES", "NENE": "INES", "TEVAO": "ESTEVAO", "EVAO": "ESTEVAO", "REGININHA": "REGINA",
}

ROLES = "REPRESENTANTE COORDENADOR DIRETOR PRESIDENTE VICE SECRETARI MINISTR PROFESSOR PESQUISADOR ADVOGAD MEMBRO CHEFE ASSESSOR PROCURADOR DEFENSOR JUIZ PROMOTOR LIDER CACIQUE DIRIGENTE GERENTE SUPERINTENDENTE CONSELHEIR EMBAIXADOR PREFEIT REITOR TECNIC PORTA GOVERNADOR DEPUTAD SENADOR VEREADOR DELEGAD OUVIDOR RELATOR".split()

_ROLE = re.compile(r"\s+[–—-]\s+.*$|\s*/\s*[A-Za-z]{2}$|\s*[–—]\s.*$")
_PARTY = re.compile(r",\s*[^,\s]+(?:\s+[^,\s]+)?\s*[-/–]\s*[A-Za-z]{2}\s*$|\s*-\s*[A-ZÀ-Ú]{2,}/[A-Z]{2}\s*$")
_FOLD = ((re.compile("PH"), "F"), (re.compile("QU(?=[EI])"), "C"), (re.compile("Y"), "I"), (re.compile("W"), "V"), (re.compile("Z"), "S"), (re.compile("K"), "C"), (re.compile("H"), ""), (re.compile(r"(.)\1+"), r"\1"))


def fold_word(word: str) -> str:
    for rx, to in _FOLD:
        word = rx.sub(to, word)
    return word


_SUFFIX = {fold_word(k): fold_word(v) for k, v in SUFFIXES.items()}
_NICK = {fold_word(k): frozenset(fold_word(x) for x in v.split()) for k, v in NICKNAMES.items()}


def person(value: str) -> str:
    """The folded words of a person's name in order: given, others, surnames, suffix. '' if nothing is left."""
    s = repair(value)
    s = re.sub(r"\([^()]*\)", " ", s)
    s = _PARTY.sub("", s)
    s = _ROLE.sub("", s)
    parts = [p.strip() for p in s.split(",") if p.strip()]
    role = len(parts) > 1 and plain(parts[1]).upper().startswith(tuple(ROLES))
    if len(parts) == 2 and len(parts[1].split()) <= 5 and not role:
        s = f"{parts[1]} {parts[0]}"
    elif parts:
        s = parts[0]
    words = re.findall(r"[A-Z�?]+", plain(s).upper())
    while len(words) > 1 and words[0] in TITLES and not (len(words[0]) == 1 and len(words) <= 3):
        words = words[1:]
    words = [fold_word(w) or w for w in words if w not in PARTICLES]
    words = words[:2] + [_as_suffix(w) for w in words[2:]]
    tail = [w for w in words[1:] if w in _SUFFIX]
    return " ".join([w for i, w in enumerate(words) if i == 0 or w not in _SUFFIX] + [_SUFFIX[w] for w in tail[:1]])


def _as_suffix(word: str) -> str:
    """A mistyped suffix as the suffix."""
    if word in _SUFFIX or not 3 <= len(word) <= 9:
        return word
    return next((v for v in ("NETO", "FILO", "JUNIOR", "SOBRINO") if banded(word, v, 1) <= 1), word)


def banded(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit, within a band; ``most`` + 1 if larger. '?' and lost characters fit any one."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    big = most + 1
    prev2: list[int] = []
    prev = [j if j <= most else big for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        row = [big] * (len(b) + 1)
        if i <= most:
            row[0] = i
        ca = a[i - 1]
        for j in range(lo, hi + 1):
            cb = b[j - 1]
            d = prev[j - 1] + (0 if ca == cb or ca in "�?" or cb in "�?" else 1)
            if prev[j] + 1 < d:
                d = prev[j] + 1
            if row[j - 1] + 1 < d:
                d = row[j - 1] + 1
            if prev2 and i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb and prev2[j - 2] + 1 < d:
                d = prev2[j - 2] + 1
            row[j] = d
        if min(row[lo - 1 : hi + 1]) > most:
            return big
        prev2, prev = prev, row
    return min(prev[len(b)], big)


def segments_of(length: int, k: int) -> list[tuple[int, int]]:
    """(start, size) of the k + 1 segments of a string of that length, the longer ones last."""
    n = k + 1
    size, extra = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        s = size + (i >= n - extra)
        out.append((at, s))
        at += s
    return out


def index_keys(s: str, k: int) -> list[str]:
    return [f"{len(s)}|{i}|{s[a : a + n]}" for i, (a, n) in enumerate(segments_of(len(s), k)) if n]


def probe_keys(s: str, k: int) -> list[str]:
    """Keys under which a string within k edits may have an untouched segment."""
    out = set()
    for length in range(max(1, len(s) - k), len(s) + k + 1):
        shift = k
        for i, (a, n) in enumerate(segments_of(length, k)):
            if n:
                for start in range(max(0, a - shift), min(len(s) - n, a + shift) + 1):
                    out.add(f"{length}|{i}|{s[start : start + n]}")
    return sorted(out)


def split_name(words: list[str]) -> tuple[str, list[str], str]:
    """Given name, the words after it without suffix, the suffix."""
    suffix = words[-1] if len(words) > 1 and words[-1] in _SUFFIX.values() else ""
    core = words[:-1] if suffix else words
    return core[0] if core else "", core[1:], suffix


def forms_of(form: str) -> list[tuple[str, str, bool, bool]]:
    """(kind, string, is an entry, is a query) of a folded name: what is put into the segment index."""
    given, rest, suffix = split_name(form.split())
    out = []
    if len(rest) >= 2 and len(rest[-1]) > 1 and len(rest[-2]) > 1:
        out.append(("pair", f"{rest[-2]} {rest[-1]}", True, True))
    elif len(rest) >= 2 and len(rest[-1]) > 1:  # an initial in the middle
        out.append(("short", f"{given} {rest[-1]}", True, True))
    if rest and len(rest[-1]) > 1:
        short = len(rest) == 1 or any(len(w) == 1 for w in rest)
        out.append(("short", f"{given} {rest[-1]}", True, short))
        out.append(("ends", f"{given} {rest[-1]}", True, True))  # words between may be dropped, the rest then is typed alike
        if len(given) == 1 and all(len(w) == 1 for w in rest[:-1]):
            out.append(("initial", f"{given}{rest[-1]}", False, True))
        elif len(given) > 1:
            out.append(("initial", f"{given[0]}{rest[-1]}", True, False))
        nick = _NICK.get(given)
        if nick:
            out += [("short", f"{x} {rest[-1]}", False, True) for x in nick]
    return sorted(set(out))


def given_fit(a: str, b: str, known: frozenset[str]) -> int | None:
    """Edits between two given names that can be one person's; null if they cannot."""
    if a == b:
        return 0
    if len(a) == 1 or len(b) == 1:
        return 0 if a[:1] == b[:1] else None
    for x, y in ((a, b), (b, a)):
        if y in _NICK.get(x, ()):
            return 0
    if a in known and b in known:
        return None
    d = banded(a, b, 2)
    return d if d <= (2 if min(len(a), len(b)) >= 5 else 1) else None


def same_person(a: str, b: str, known: frozenset[str]) -> int | None:
    """Edits between two folded names that can be one person's; null if they cannot."""
    ga, ra, sa = split_name(a.split())
    gb, rb, sb = split_name(b.split())
    if not ra or not rb or sa != sb:
        return None
    g = given_fit(ga, gb, known)
    if g is None:
        return None
    last = banded(ra[-1], rb[-1], 2)
    if last > 2:
        return None
    short = min(len(ra), len(rb)) == 1
    if last > (1 if short else 2) or short and last and len(ra) != len(rb):
        return None  # a lone surname has to be the same word
    total = g + last
    xa, xb = ra[:-1], rb[:-1]
    if len(xa) > len(xb):
        xa, xb = xb, xa
    # the words between, the shorter list in order inside the longer one
    at, i = 0, 0
    for w in xa:
        best = None
        for j in range(at, len(xb)):
            v = xb[j]
            if len(w) == 1 or len(v) == 1:
                d = 0 if w[:1] == v[:1] else None
            else:
                d = banded(w, v, 2)
                d = d if d <= 2 else None
            if d is not None:
                best = (j, d)
                break
        if best is None:
            return None
        at, total = best[0] + 1, total + best[1]
        i += 1
    return total if total <= 3 else None


def fullness(form: str, known: frozenset[str]) -> int:
    """How much a form says: initials and nicknames say less."""
    given, rest, suffix = split_name(form.split())
    return (3 if given in known else 0) + 2 * sum(len(w) > 2 for w in rest) + bool(suffix) - 3 * (len(given) == 1 or given in _NICK)


_forms_schema = "form string, kind string, s string, key string, entry boolean, query boolean"


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for form in pdf["form"]:
            for kind, s, entry, query in forms_of(form):
                k = {"initial": 1, "ends": 0}.get(kind, K)
                if entry:
                    out += [(form, kind, s, f"{kind}|{x}", True, False) for x in index_keys(s, k)]
                if query:
                    out += [(form, kind, s, f"{kind}|{x}", False, True) for x in probe_keys(s, k)]
        yield pd.DataFrame(out, columns=["form", "kind", "s", "key", "entry", "query"])


def _verify(known):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, sa, sb in zip(pdf["a"], pdf["b"], pdf["sa"], pdf["sb"]):
                if banded(sa, sb, K) <= K:
                    d = same_person(a, b, known.value)
                    if d is not None:
                        out.append((a, b, d))
            yield pd.DataFrame(out, columns=["a", "b", "edits"])

    return run


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(form, root): each form follows its best link to a higher-ranked form, to the end.

    ``nodes`` has (form, rank), ``edges`` (a, b, edits) in both directions. Ranks
    are a total order, so there are no cycles; the chains are halved each round.
    """
    r = nodes.select("form", "rank")
    up = edges.join(r.withColumnRenamed("form", "a").withColumnRenamed("rank", "ra"), "a").join(r.withColumnRenamed("form", "b").withColumnRenamed("rank", "rb"), "b")
    up = up.filter(F.col("rb") > F.col("ra")).groupBy(F.col("a").alias("form")).agg(F.max_by("b", F.struct("rb", (-F.col("edits")).alias("e"))).alias("root"))
    return followed(nodes.select("form").join(up, "form", "left").select("form", F.coalesce("root", "form").alias("root")))


def followed(ptr: DataFrame) -> DataFrame:
    """(form, root) with every pointer followed to its end; pointers go up in a total order, and chains are halved each round until none moves."""
    ptr = cut(ptr)
    while True:
        nxt = ptr.join(ptr.select(F.col("form").alias("root"), F.col("root").alias("root2")), "root").select("form", F.col("root2").alias("root"), (F.col("root2") != F.col("root")).alias("moved"))
        nxt = cut(nxt)
        if not nxt.filter("moved").limit(1).count():
            return nxt.select("form", "root")
        ptr = nxt.select("form", "root")


#: Entries of one key that a task joins at once.
KEY_BLOCK = 2_000


def in_blocks(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """The join on ``key``, the entries of a frequent key (a common surname's segment) in blocks that its queries meet one by one."""
    hot = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > KEY_BLOCK).select("key", F.ceil(F.col("n") / KEY_BLOCK).cast("int").alias("blocks"))
    hot = broadcast_if_small(cut(hot))
    e = entries.join(hot, "key", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))).drop("blocks")
    q = queries.join(hot, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return q.join(e, ["key", "block"])


def maybe_near(a: str, b: str) -> F.Column:
    """Holds for all pairs within K of ``banded``: a swap is two plain edits, and lost characters fit any one."""
    return (F.levenshtein(F.col(a), F.col(b), 2 * K) >= 0) | F.col(a).rlike("[?\ufffd]") | F.col(b).rlike("[?\ufffd]")


def _to_person(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(form=[person(v) for v in pdf["value"]])


def person_links(values: DataFrame) -> DataFrame:
    """(value, root) of the different spellings of persons; ``values`` has (value, n).

    Null, empty and placeholder values mean nobody and are left out, as are
    values without letters.
    """
    spark = values.sparkSession
    v = values.filter(F.col("value").isNotNull() & ~F.upper(F.trim("value")).isin(*NOBODY))
    v = cut(v.mapInPandas(_to_person, "value string, n long, form string").filter("form <> ''"))
    forms = cut(v.groupBy("form").agg(F.sum("n").alias("n")))
    total = forms.count()
    first = F.split("form", " ")[0]
    least = max(GIVEN_LEAST, int(GIVEN_SHARE * total))
    # a share of all forms each, so at most 1 / GIVEN_SHARE of them
    known = frozenset(r["g"] for r in forms.filter(F.size(F.split("form", " ")) > 1).groupBy(first.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.element_at(F.split("form", " "), -1)).alias("lasts")).filter((F.col("n") >= least) & (F.col("lasts") >= least) & (F.length("g") > 1)).select("g").collect())
    known -= set(_NICK)
    shared = spark.sparkContext.broadcast(known)
    keys = cut(forms.select("form").mapInPandas(_index, _forms_schema))
    entries = keys.filter("entry").select(F.col("form").alias("b"), F.col("s").alias("sb"), "key")
    queries = keys.filter("query").select(F.col("form").alias("a"), F.col("s").alias("sa"), "key")
    # pairs grow as the square of the names: they are judged where they meet and never moved; one that meets under several keys is judged again
    pairs = in_blocks(queries, entries).filter(F.col("a") != F.col("b")).filter(maybe_near("sa", "sb")).select("a", "b", "sa", "sb")
    links = pairs.mapInPandas(_verify(shared), "a string, b string, edits int")
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "edits")).groupBy("a", "b").agg(F.min("edits").alias("edits")))
    full = F.pandas_udf(_fullness(shared), "int")
    nodes = forms.withColumn("full", full("form")).select("form", F.struct(F.when(F.col("full") >= 5, F.lit(1)).otherwise(F.lit(0)).alias("complete"), "n", "full", "form").alias("rank"))
    return v.join(roots(cut(nodes), both), "form").select("value", "root")


def _fullness(known):
    def run(forms: pd.Series) -> pd.Series:
        return pd.Series([fullness(f, known.value) for f in forms])

    return run


# ---------------------------------------------------------------- parties

#: A value of this share of the rows may be a party's own short name, so there are at most 1 / PARTY_SHARE of these.
PARTY_SHARE = 0.0003
#: Words of a missing party and of guests.
NO_PARTY = frozenset(("SEM PARTIDO", "S PARTIDO", "S PART", "SPARTIDO", "SP", "SEM PART"))
_UF = frozenset("AC AL AM AP BA CE DF ES GO MA MG MS MT PA PB PE PI PR RJ RN RO RR RS SC SE SP TO".split())


def party(value: str) -> list[str]:
    """What a party's spelling can stand for, best first: short names and full names in plain capitals."""
    s = plain(repair(value)).upper()
    s = re.sub(r"\((?:A|O|AS|OS)\)", "", s)
    inner = re.findall(r"\(([^()]+)\)", s)
    s = re.sub(r"\([^()]*\)", " ", s) if inner and re.sub(r"\([^()]*\)", " ", s).strip() else s.replace("(", " ").replace(")", " ")
    out = []
    parts = [p.strip() for p in re.split(r"\s+[-–—]\s+", s) if p.strip()]
    for p in [*inner, *parts]:
        p = re.sub(r"[-/]\s*([A-Z]{2})\s*$", lambda m: "" if m[1] in _UF else m[0], p.strip())
        if re.fullmatch(r"(?:[A-Z�?]\.){2,}[A-Z]?", p.replace(" ", "")):
            p = p.replace(".", "").replace(" ", "")
        p = re.sub(r"\bPDO\b\.?|\bPART\b\.", "PARTIDO", p)
        p = re.sub(r"\s+", " ", re.sub(r"[^A-Z�?. ]", " ", p)).strip()
        if p:
            out.append(p)
    return out


def _words(s: str) -> list[str]:
    return [w for w in s.replace(".", ". ").split() if w.strip(".") not in PARTICLES]


def _short_typo(a: str, b: str) -> bool:
    """A slip in a short name: two letters swapped, one doubled, one more or less in a longer name, but not another letter in a short one."""
    if a == b:
        return True
    fa, fb = fold_word(a), fold_word(b)
    if fa == fb and len(fa) >= 2:
        return True
    if len(a) == len(b):
        diff = [i for i in range(len(a)) if a[i] != b[i]]
        if len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]]:
            return True
        if any(x in "�?" or y in "�?" for x, y in zip(a, b)):
            return all(x == y or x in "�?" or y in "�?" for x, y in zip(a, b))
    n = min(len(fa), len(fb))
    return n >= 5 and banded(fa, fb, 1 + (n >= 9)) <= 1 + (n >= 9) and (n >= 7 or len(a) != len(b))


def _abbreviates(short: str, full: str) -> bool:
    """Word by word the beginning (with a point), one letter, or the same but for a slip."""
    a, b = _words(short), _words(full)
    if len(a) != len(b) or not a:
        return False
    for x, y in zip(a, b):
        p = x.rstrip(".")
        q = y.rstrip(".")
        if not (_short_typo(p, q) or (x.endswith(".") or len(p) == 1) and q.startswith(p) or y.endswith(".") and p.startswith(q)):
            return False
    return True


def _stands_for(acronym: str, full: str) -> bool:
    """The short name is made of beginnings of the full name's words in order."""
    words = [w.rstrip(".") for w in _words(full)]
    if len(words) < 2 or " " in acronym:
        return False

    def fit(a: str, i: int) -> bool:
        if not a:
            return True
        if i == len(words):
            return False
        w = words[i]
        n = 0
        while n < len(a) and n < len(w) and a[n] == w[n]:
            n += 1
        return any(fit(a[m:], i + 1) for m in range(n, 0, -1)) or (i > 0 and fit(a, i + 1))

    return fit(acronym, 0) or any(len(w) >= 4 and (w == acronym or w.rstrip("S") == acronym or w.startswith(acronym) and len(acronym) >= 4) for w in words)


def party_fit(a: list[str], b: list[str]) -> int | None:
    """How well two party spellings agree (0 best); null if not at all."""
    best = None
    for i, x in enumerate(a):
        for y in b:
            px, py = x.replace(".", ""), y.replace(".", "")
            if px == py:
                d = 0
            elif px in NO_PARTY and py in NO_PARTY:
                d = 0
            elif _short_typo(px, py) and (" " in px) == (" " in py):
                d = 1
            elif _abbreviates(x, y) or _abbreviates(y, x):
                d = 1
            elif _stands_for(px, y) or _stands_for(py, x):
                d = 2
            else:
                continue
            best = d if best is None else min(best, d)
    return best


def _party_links(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = [(v, n, party(v)) for v, n in shared.value]
        index: dict[str, list[int]] = {}
        for i, (_, _, forms) in enumerate(anchors):
            for f in forms:
                for key in index_keys(f.replace(".", ""), K):
                    index.setdefault(key, []).append(i)
        for pdf in batches:
            out = []
            for value, n in zip(pdf["value"], pdf["n"]):
                mine = party(value)
                near = {i for f in mine for key in probe_keys(f.replace(".", ""), K) for i in index.get(key, ())}
                full = any(" " in f or "." in f for f in mine)
                for i, (v, m, forms) in enumerate(anchors):
                    # names of several words and abbreviations are held against every anchor
                    if v != value and (i in near or full or any(" " in f or "." in f for f in forms)):
                        d = party_fit(mine, forms)
                        if d is not None:
                            out.append((value, v, d, int(n), int(m)))
            yield pd.DataFrame(out, columns=["a", "b", "fit", "na", "nb"])

    return run


def _party_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of a party's short and full names; of a full name also its initials, so a short name meets it."""
    for pdf in batches:
        out = set()
        for value, n in zip(pdf["value"], pdf["n"]):
            for f in party(value):
                bare = f.replace(".", "")
                words = [w.rstrip(".") for w in _words(f)]
                names = {bare} | ({"".join(w[0] for w in words)} if len(words) > 1 else set())
                for x in names:
                    out.update((value, n, key, False) for key in index_keys(x, K))
                    out.update((value, n, key, True) for key in probe_keys(x, K))
        yield pd.DataFrame(sorted(out), columns=["value", "n", "key", "probe"])


def _party_verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in (x.drop_duplicates() for x in batches):
        fits = [party_fit(party(a), party(b)) for a, b in zip(pdf["a"], pdf["b"])]
        yield pdf.assign(fit=fits).dropna(subset=["fit"]).astype({"fit": int})


def party_roots(values: DataFrame, by_speaker: DataFrame) -> DataFrame:
    """(value, root) of the spellings of parties.

    ``values`` has (value, n), ``by_speaker`` (speaker, value, n). A spelling
    goes to the most fitting anchor; where several fit, and where only the full
    name is known, what the same speakers' other rows carry decides.
    """
    spark = values.sparkSession
    v = cut(values.filter(F.col("value").isNotNull() & (F.trim("value") != "")))
    total = v.agg(F.sum("n").alias("n")).first()["n"] or 0
    # a share of all rows each, so at most 1 / PARTY_SHARE of them
    anchors = [(r["value"], r["n"]) for r in v.filter(F.col("n") >= max(2.0, PARTY_SHARE * total)).orderBy(F.desc("n"), "value").collect()]
    shared = spark.sparkContext.broadcast(anchors)
    links = cut(v.mapInPandas(_party_links(shared), "a string, b string, fit int, na long, nb long"))
    # share of the speakers' other rows that carry b
    pair = by_speaker.select("speaker", F.col("value").alias("a"), F.col("n").alias("wa"))
    other = by_speaker.select("speaker", F.col("value").alias("b"), F.col("n").alias("wb"))
    heavy = other.groupBy("speaker").agg(F.max_by("b", F.struct("wb", "b")).alias("b"), F.max("wb").alias("top"), F.sum("wb").alias("all"))
    votes = pair.join(heavy, "speaker").filter("a <> b").groupBy("a", "b").agg(F.sum(F.least("wa", F.col("top"))).alias("votes"))
    seen = pair.groupBy("a").agg(F.sum("wa").alias("rows_a"))
    votes = cut(votes.join(seen, "a").select("a", "b", (F.col("votes") / F.col("rows_a")).alias("share")))
    up = links.filter((F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a"))))
    scored = up.join(votes, ["a", "b"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    best = scored.groupBy("a").agg(F.max_by(F.struct("b", "fit"), F.struct((F.col("fit") <= 1).alias("sure"), "share", (-F.col("fit")).alias("f"), "nb", "b")).alias("x")).select("a", "x.b", "x.fit")
    # a full name that no sure rule ties to a short name: the speakers' party
    long_name = F.col("value").rlike(r"\p{L}{3,}.*\s.*\p{L}{3,}") & ~F.upper("value").rlike("SEM |CONVID")
    lone = v.filter(long_name).select(F.col("value").alias("a"), F.col("n").alias("na"))
    voted = lone.join(votes.filter("share >= 0.4"), "a").join(v.select(F.col("value").alias("b"), F.col("n").alias("nb")), "b").filter(F.col("nb") > 4 * F.col("na"))
    voted = voted.groupBy("a").agg(F.max_by("b", F.struct("share", "nb", "b")).alias("b"), F.max("share").alias("share"))
    ruled = best.select("a", "b", F.when(F.col("fit") <= 1, F.lit(2.0)).otherwise(F.lit(0.1)).alias("by"))
    chosen = ruled.unionByName(voted.select("a", "b", F.col("share").alias("by"))).groupBy("a").agg(F.max_by("b", "by").alias("b"))
    # what no anchor takes, a party whose spellings are all rare, is held against itself by the segment index
    lone = cut(v.join(chosen.select(F.col("a").alias("value")), "value", "left_anti").join(spark.createDataFrame([(x,) for x, _ in anchors], "value string"), "value", "left_anti"))
    keyed = lone.mapInPandas(_party_keys, "value string, n long, key string, probe boolean")
    e = keyed.filter("NOT probe").select(F.col("value").alias("b"), F.col("n").alias("nb"), "key")
    q = keyed.filter("probe").select(F.col("value").alias("a"), F.col("n").alias("na"), "key")
    met = in_blocks(q, e).filter((F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))).select("a", "b", "nb")
    rare = met.mapInPandas(_party_verify, "a string, b string, nb long, fit int").groupBy("a").agg(F.max_by("b", F.struct((-F.col("fit")).alias("f"), "nb", "b")).alias("b"))
    edges = chosen.select("a", "b").unionByName(rare)
    nodes = v.select(F.col("value").alias("form"))
    return followed(nodes.join(edges.select(F.col("a").alias("form"), F.col("b").alias("root")), "form", "left").select("form", F.coalesce("root", "form").alias("root"))).select(F.col("form").alias("value"), "root")


# ---------------------------------------------------------------- both fields

#: Spellings of one block of the pairs of a root.
BLOCK = 256


def classes(speeches: DataFrame) -> DataFrame:
    """(field_name, value, root, n): every stored spelling with the one it is linked to."""
    s = speeches.select("orador", "partido")
    counts = cut(s.groupBy("orador", "partido").agg(F.count(F.lit(1)).alias("n")))
    people = cut(counts.filter("orador IS NOT NULL").groupBy(F.col("orador").alias("value")).agg(F.sum("n").alias("n")))
    linked = cut(person_links(people))
    by_speaker = counts.filter("partido IS NOT NULL").join(linked, F.col("orador") == F.col("value")).groupBy(F.col("root").alias("speaker"), F.col("partido").alias("p")).agg(F.sum("n").alias("n")).withColumnRenamed("p", "value")
    parties = counts.filter("partido IS NOT NULL").groupBy(F.col("partido").alias("value")).agg(F.sum("n").alias("n"))
    p = party_roots(parties, cut(by_speaker))
    return linked.select(F.lit("orador").alias("field_name"), "value", "root").unionByName(p.select(F.lit("partido").alias("field_name"), "value", "root"))


def pairs(linked: DataFrame) -> DataFrame:
    """(field_name, name_a, name_b): the different spellings of one root, large roots in blocks."""
    sizes = linked.groupBy("field_name", "root").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    d = linked.join(sizes, ["field_name", "root"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    left = d.select("field_name", "root", F.col("value").alias("name_a"), F.pmod(F.xxhash64("value"), F.col("blocks")).cast("int").alias("block"))
    right = d.select("field_name", "root", F.col("value").alias("name_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.join(right, ["field_name", "root", "block"]).filter("name_a < name_b").select("field_name", "name_a", "name_b")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(cut(classes(spark.read.parquet(f"{sf_dir}/speeches.parquet")))).distinct()


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with the linked form it belongs to and the number of spellings that share it."""
    c = cut(classes(spark.read.parquet(f"{sf_dir}/speeches.parquet")))
    return c.join(c.groupBy("field_name", "root").agg(F.count(F.lit(1)).alias("n_spellings")), ["field_name", "root"]).select("field_name", F.col("value").alias("name"), F.col("root").alias("class_id"), "n_spellings")


QUERIES = {"p1_found": found, "p1_spellings": report}
SQL: dict[str, str] = {}
