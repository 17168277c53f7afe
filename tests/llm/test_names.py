from __future__ import annotations

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import names


def osa(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(1, 3))
def test_banded_equals_full(a, b, k):
    d = osa(a, b)
    assert names.banded(a, b, k) == (d if d <= k else k + 1)


def test_pigeonhole_finds_every_edit():
    r = random.Random(1)
    for _ in range(400):
        s = "".join(r.choice("abcdef ") for _ in range(r.randint(6, 20)))
        t = list(s)
        for _ in range(2):
            op, i = r.randrange(3), r.randrange(len(t))
            if op == 0:
                t[i] = r.choice("abcdef")
            elif op == 1:
                t.insert(i, r.choice("abcdef"))
            elif len(t) > 4:
                del t[i]
        t = "".join(t)
        assert set(names.probe_keys(t, 2)) & set(names.index_keys(s, 2))


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("CLÁUDIO FEFIPANÇA NESOGURA", "C. Fefipança Nesogura", True),
        ("CLÁUDIO FEFIPANÇA NESOGURA", "Nesogura, Cláudio Fefipança", True),
        ("CLÁUDIO FEFIPANÇA NESOGURA", "CLÁUDIO NESOGURA", True),
        ("CLÁUDIO FEFIPANÇA NESOGURA", "CLÁUDIO FEFIPANÇA NESOGURA, PLUM-PE", True),
        ("ALBERTO HENRIQUE VURIFAIS CIRALEIRO", "BETINHO VURIFAIS CIRALEIRO", True),
        ("GABRIELA TIGONURA FUSOTETO", "MARCELA TIGONURA FUSOTETO", False),
        ("ADRIANO FABIGARI COSABEIRO", "ADRIANA FABIGARI COSABEIRO", False),
        ("JOÃO SIVOGETO", "João Sivogeto – Representante dos pescadores", True),
        ("JOSÉ LICIMEM FEGUXÃO NETO", "JOSÉ LICIMEM FEGUXÃO FILHO", False),
    ],
)
def test_same_person(a, b, same):
    known = frozenset(map(names.fold_word, "CLAUDIO ALBERTO GABRIELA MARCELA ADRIANO ADRIANA JOAO JOSE".split()))
    x, y = names.person(a), names.person(b)
    assert (x == y or names.same_person(x, y, known) is not None) is same


SPEECH = "id long, orador string, partido string, estado string"


def test_links_and_edges(spark):
    rows = []
    for i, g in enumerate(["CLÁUDIO", "MARIA", "JOSÉ", "ANA"]):
        for j, s in enumerate(["FEFIPANÇA NESOGURA", "PEMESEIRA GOLAZÉM", "LICIMEM FEGUXÃO", "DAXUBÃO LILEMAL"]):
            rows += [(f"{g} {s}", "PLUM")] * (4 + i + j)
    rows += [("Cláudhio Fefipança Nesogura", "plum"), ("C. FEFIPANÇA NESOGURA", "PLUM "), (None, None), ("", ""), ("SEM NOME", "PLMU"), ("123", "UNAR"), ("MARIA PEMESEIRA GOLAZÉM", "UNAR")]
    d = spark.createDataFrame([(k, o, p, "SP") for k, (o, p) in enumerate(rows)], SPEECH)
    got = {(r["field_name"], r["name_a"], r["name_b"]) for r in names.pairs(names.classes(d)).collect()}
    assert ("orador", "CLÁUDIO FEFIPANÇA NESOGURA", "Cláudhio Fefipança Nesogura") in got
    assert ("orador", "C. FEFIPANÇA NESOGURA", "CLÁUDIO FEFIPANÇA NESOGURA") in got
    assert ("partido", "PLMU", "PLUM") in got and ("partido", "PLUM", "plum") in got
    assert all(a < b and a and b for _, a, b in got)
    assert not any("SEM NOME" in x for x in got) and not any(("UNAR" in x) != ("UNAR" in y) for f, x, y in got if f == "partido")


def test_empty(spark):
    assert names.classes(spark.createDataFrame([], SPEECH)).count() == 0


def test_large_root_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK", 3)
    d = spark.createDataFrame([("orador", f"n{i:02}", "r") for i in range(20)], "field_name string, value string, root string")
    assert names.pairs(d).count() == 190


def test_party_of_rare_spellings_only(spark, monkeypatch):
    """A party none of whose spellings is frequent enough for an anchor is linked all the same."""
    monkeypatch.setattr(names, "PARTY_SHARE", 0.05)
    values = [("PARTIDO DAS ÁGUAS", 3), ("PARTIDO DAS AGUAS", 2), ("Partido das Ágguas", 1), ("PLUM", 5000)]
    v = spark.createDataFrame(values, "value string, n long")
    by = spark.createDataFrame([], "speaker string, value string, n long")
    got = {r["value"]: r["root"] for r in names.party_roots(v, by).collect()}
    assert got["PARTIDO DAS AGUAS"] == got["Partido das Ágguas"] == "PARTIDO DAS ÁGUAS" and got["PLUM"] == "PLUM"


def test_frequent_keys_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(names, "KEY_BLOCK", 7)
    q = spark.createDataFrame([(f"a{i}", "k" if i < 30 else "r") for i in range(40)], "a string, key string")
    e = spark.createDataFrame([(f"b{i}", "k" if i < 50 else "r") for i in range(55)], "b string, key string")
    got = {(r["a"], r["b"]) for r in names.in_blocks(q, e).collect()}
    assert got == {(f"a{i}", f"b{j}") for i in range(40) for j in range(55) if (i < 30) == (j < 50)}
    assert names.in_blocks(q, e).select("block").distinct().count() == 8


def test_dropped_middle_names_and_double_initials(spark):
    v = spark.createDataFrame([("MARIA HELENA SOUSA LIMA", 9), ("Maria Helena Lima", 1), ("JOSÉ SILVA SANTOS", 9), ("J. S. Santos", 1), ("CARLOS DIAS ROCHA", 5)], "value string, n long")
    got = {r["value"]: r["root"] for r in names.person_links(v).collect()}
    assert got["Maria Helena Lima"] == got["MARIA HELENA SOUSA LIMA"] and got["J. S. Santos"] == got["JOSÉ SILVA SANTOS"] and got["CARLOS DIAS ROCHA"] not in (got["J. S. Santos"], got["Maria Helena Lima"])


def test_pairs_that_meet_are_not_moved(spark):
    """Names that share a given name meet each other, so pairs grow as their square; what is shuffled follows the names."""
    def moved(n):
        r = random.Random(n)
        v = [("EDUARDO " + "".join(r.choice("BCDFGLMNPRST") + r.choice("AEIOU") for _ in range(4)), 1) for _ in range(n)]
        before = shuffled(spark)
        assert names.person_links(spark.createDataFrame(v, "value string, n long")).count() == n
        return shuffled(spark) - before

    assert moved(1_200) < 7 * moved(300)


def shuffled(spark) -> int:
    """Bytes written to shuffle files so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    time.sleep(0.3)
    return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_first_look_at_a_pair_loses_none(spark):
    r = random.Random(5)
    pairs = []
    for _ in range(3_000):
        a = "".join(r.choice("ABCDE ") for _ in range(r.randint(3, 12)))
        b = list(a)
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(b) + 1)
            kind = r.randrange(4)
            if kind == 0:
                b.insert(i, r.choice("ABCDE?�"))
            elif kind == 1 and i < len(b):
                b[i] = r.choice("ABCDE?�")
            elif kind == 2 and i + 1 < len(b):
                b[i], b[i + 1] = b[i + 1], b[i]
            elif len(b) > 2 and i < len(b):
                del b[i]
        pairs.append((a, "".join(b)))
    pairs += [("ABCDEFGH", "BADCEFGH"), ("ABCDEFGHIJKL", "??????GHIJKL")]
    kept = {(x["a"], x["b"]) for x in spark.createDataFrame(pairs, "a string, b string").filter(names.maybe_near("a", "b")).collect()}
    near = {(a, b) for a, b in pairs if names.banded(a, b, names.K) <= names.K}
    assert near <= kept and len(near) > 1_000
