from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import assert_same, connect  # noqa: E402

from corpusloom.llm import distinctive_terms, leaks, packing, quality, turns  # noqa: E402
from corpusloom.llm.words import words  # noqa: E402

# ---------------------------------------------------------------- turns

SPEECH = "id long, orador string, discurso string, row int, pos int"


def speakers(spark, *texts):
    d = spark.createDataFrame([(i, "X", t, 0, 0) for i, t in enumerate(texts)], SPEECH)
    out = {}
    for r in turns.turns(d).orderBy("id", "turn_no").collect():
        out.setdefault(r["id"], []).append((r["turn_no"], r["speaker_no"], r["spoken"]))
    return out


def test_turns(spark):
    text = (
        "Abertura sem rótulo. O SR. CLÁUDIO FEFIPANÇA NESOGURA (PLUM - PE. Sem revisão.) - Bom dia, ãh... a todos. (Palmas.) [00:01:02] A SRA. ANA LIMA DAXUBÃO - Pergunto: quem vai? "
        "14:30:30 - NESOGURA: [risos]\nPRESIDENTE: Conclua.\n[Presidenta] Obrigada. A SRA. A. DAXUBÃO – O prazo venceu às 14h30.\nDep. Nesogura: *tosse* Termino. INSISTO: ACABOU."
    )
    got = speakers(spark, text, "sem rótulo nenhum: nada", None, "", "PRESIDENTE: [risos]")
    assert got == {0: [(1, 1, "Bom dia, a todos."), (2, 2, "Pergunto: quem vai?"), (3, 3, "Conclua. Obrigada."), (4, 2, "O prazo venceu às 14h30."), (5, 1, "Termino. INSISTO: ACABOU.")]}


def test_empty_passages_let_neighbours_meet(spark):
    text = "O SR. CLÁUDIO NESOGURA - Um. A SRA. ANA LIMA - (Risos.) O SR. CLÁUDIO NESOGURA - Dois."
    assert speakers(spark, text)[0] == [(1, 1, "Um. Dois.")]


def test_chair_under_any_label(spark):
    text = "A SRA. PRESIDENTE (Ana Lima. PL - SP) - Um. O SR. JOSÉ REIS - Dois. A SRA. ANA LIMA - Três."
    assert [x[:2] for x in speakers(spark, text)[0]] == [(1, 1), (2, 2), (3, 1)]


def test_main_speaker_resolves_short_and_damaged_labels():
    """The stored speaker makes a lone surname a label and gives the speaker's name; another surname stays text."""
    text = "LIMA: Bom dia a todos. ROMA: uma cidade. O SR. JOSÉ REIS - Obrigado. A SRA. L\ufffdMA - Volto."
    got = turns.segments(text, "Ana L\u00edma")
    assert [(name, no) for name, no, *_ in got] == [("Ana Líma", 0), ("JOSÉ REIS", 1), ("Ana Líma", 0)]
    assert [name for name, *_ in turns.segments("LIMA: Bom dia.", "Rui Reis")] == []


def test_labels_that_only_repair_shows(spark):
    got = speakers(spark, "ANA TAXUBUA\u0301: Bom dia.", "ANA TAXUBU\u00c3\u0081: Bom dia, a sessÃ£o está aberta.", "ANA TAXUBUÁ: Bom dia.", "Nada de rótulo aqui.")
    assert {i: [x[:2] for x in t] for i, t in got.items()} == {0: [(1, 1)], 1: [(1, 1)], 2: [(1, 1)]}


def test_long_and_repeated(spark):
    long = "O SR. JOSÉ REIS - " + "palavra " * 100_000 + "A SRA. ANA LIMA - fim."
    got = speakers(spark, long)
    assert [x[:2] for x in got[0]] == [(1, 1), (2, 2)] and got[0][1][2] == "fim."
    d = spark.createDataFrame([], SPEECH)
    assert turns.turns(d).count() == 0


# ---------------------------------------------------------------- terms


def test_terms_edge_cases(spark):
    rows = [(1, "PLUM", "casa casa casa casa muro"), (2, None, "casa"), (3, "", None), (4, "PLUM", "   "), (5, "PLUM", "ab 12 !!")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "id long, partido string, discurso string, df int")
    got = distinctive_terms.scores(distinctive_terms.Collection(d)).collect()
    assert [(r["id"], r["term"], r["tf"], r["df"], r["cf"]) for r in got] == [(1, "casa", 4, 2, 5)]
    empty = spark.createDataFrame([], "id long, partido string, discurso string")
    assert distinctive_terms.scores(distinctive_terms.Collection(empty)).count() == 0 and distinctive_terms.group_scores(distinctive_terms.Collection(empty)).count() == 0


@pytest.mark.parametrize("rows", [
    [(i, "A", "casa casa casa casa") for i in range(5)],  # no rarer than chance has it
    [(1, "A", "casa casa casa casa mesa"), (2, "A", "casa mesa"), (3, "B", "casa"), (4, None, "casa"), (5, "B", "casa outra outra outra outra")],
    [(1, "A", "casa casa"), (1, "A", "casa casa mesa"), (1, "B", "mesa mesa"), (2, "B", "casa"), (3, "B", "mesa"), (9, "B", "outro")],  # an id in several rows
    [(None, "A", "casa casa casa casa"), (None, "A", "casa"), (None, None, "casa casa"), (None, None, "casa casa"), (2, "B", "casa"), (3, "B", "mesa")],
    [(1, "A", "\x0b"), (2, "A", " \n"), (3, "A", "casa casa casa casa"), (4, "A", "casa"), (5, "B", ""), (6, "B", None)],
])
def test_terms_as_sql_has_them(spark, tmp_path, rows):
    spark.createDataFrame(rows, "id long, partido string, discurso string").write.parquet(f"{tmp_path}/speeches.parquet")
    for name, query in distinctive_terms.QUERIES.items():
        assert_same(query(spark, str(tmp_path)).toPandas(), connect(str(tmp_path)).execute(distinctive_terms.SQL[name]).df())


# ---------------------------------------------------------------- leaks


def test_winnowing_guarantee():
    r = random.Random(2)
    table = leaks._Hashes()
    for _ in range(300):
        item = [str(r.randrange(200)) for _ in range(r.randint(10, 40))]
        a = r.randrange(len(item) - 9)
        doc = [str(1000 + r.randrange(500)) for _ in range(r.randint(0, 30))] + item[a : a + 10] + [str(1000 + r.randrange(500)) for _ in range(r.randint(0, 30))]
        d, i = leaks._hash_words(doc, table), leaks._hash_words(item, table)
        (p, a), (q, b) = leaks.fingerprints(d), leaks.fingerprints(i)
        hits = [(int(x), int(y)) for x, f in zip(p, a) for y, g in zip(q, b) if f == g]
        assert leaks.longest_run(d, i, hits)[0] >= 10


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))) for i in range(60)] + [(60, None), (61, ""), (None, "a b c d e f g h i j k")]
    items = [(i, docs[i][1][: r.randint(20, 200)] if docs[i][1] else "") for i in range(25)] + [(99, None), (98, "curto")]
    dd = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    ii = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["item_id"], x["doc_id"]) for x in leaks.leaks(dd, ii).collect()}
    grams = lambda t: {tuple(words(t)[k : k + 10]) for k in range(len(words(t)) - 9)} if t else set()
    want = {(i, d) for i, t in items for d, x in docs if d is not None and i is not None and grams(t) & grams(x)}
    assert got == want and got


def test_leaks_one_scan_of_the_documents(spark, monkeypatch):
    """Documents are read once whatever the number of items, and a filter too small for the items loses nothing."""
    text = "um dois três quatro cinco seis sete oito nove dez onze"
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    from pyspark.sql import functions as F

    dd = spark.createDataFrame([(1, "X " + text.upper() + "!"), (2, "outro texto de dez palavras que não tem nada em comum aqui")], "doc_id long, text string").withColumn("text", F.udf(counted, "string")("text"))
    ii = spark.createDataFrame([(i, text) for i in range(300)] + [(900 + i, " ".join(f"p{i}q{k}" for k in range(40))) for i in range(300)], "item_id long, text string")
    monkeypatch.setattr(leaks, "MOST_BITS", 1 << 10)
    monkeypatch.setattr(leaks, "FILTER_BITS", 1)
    assert {(r["item_id"], r["doc_id"]) for r in leaks.leaks(dd, ii).collect()} == {(i, 1) for i in range(300)}
    first = seen.value
    leaks.leaks(dd, ii.limit(3)).count()
    assert seen.value == 2 * first  # as often for 3 items as for 600
    assert leaks.leaks(dd, ii.limit(0)).count() == 0 and leaks.leaks(dd.limit(0), ii).count() == 0


def test_long_runs_and_places():
    table = leaks._Hashes()
    item = leaks._hash_words([str(i) for i in range(40)], table)
    doc = leaks._hash_words(["x"] * 3 + [str(i) for i in range(5, 30)] + ["y"] + [str(i) for i in range(12)], table)
    (p, a), (q, b) = leaks.fingerprints(doc), leaks.fingerprints(item)
    hits = [(int(x), int(y)) for x, f in zip(p, a) for y, g in zip(q, b) if f == g]
    assert leaks.longest_run(doc, item, hits) == (25, 2)


# ---------------------------------------------------------------- quality

PROSE = "O relatório da comissão aponta que as obras não avançaram desde março. Quem responde pela creche? Até agora, ninguém respondeu."


SPACED = " ".join(f"O relatório {i} da comissão aponta que, em {1900 + i}, as obras de {w} não avançaram; quem responde pela creche?" for i, w in enumerate("Olinda Natal Recife Belém Santos Lages Bagé Assu".split()))
CASES = [
    (PROSE, "prose"), (PROSE.upper(), "prose"), (PROSE.replace(" ", "\n", 30).replace(".", ""), "prose"), ("\n".join(f"{i}. {s}" for i, s in enumerate(PROSE.split(". "), 1)), "prose"),
    ("\n".join(f"- {w}" for w in "creche seca rodovia hospital porto ponte asfalto".split()), "list"), ("\n".join("água armas rio fechado técnico rural pública".split()), "list"),
    ("| Município | Obras |\n| --- | --- |\n" + "\n".join(f"| Vila {i} | {i * 7} |" for i in range(8)), "table"), ("\n".join(f"Vila {i}\t{i * 7}\t2001" for i in range(8)), "table"),
    ("\n".join(f'"Vila {w}","{i * 7}","2001","parada"' for i, w in enumerate("Olinda Natal Recife Belém".split())), "table"),
    ("=-" * 200, "junk"), ("ha" * 300, "junk"), (PROSE.split(".")[0] + ". " + (PROSE.split(".")[0] + ". ") * 30, "junk"), ("zrbqlc bbzpgpd hhtt wmksgd brrt " * 3, "junk"), ("1 22 333 4 55 6666 7 " * 9, "junk"),
    ("<div class=\"a\"></div>function(){return 1;}&nbsp;" * 9, "junk"), ("Nã, há e!e1da  ~,1,josa  !em  l||log.   c.m  l|   l!~,ll!|,|e!.  Es1~   ~mendl ,ist1ri~l  ll!,|ç1 " * 3, "junk"),
    *[("declaração de voto favorável " * n, "junk") for n in (90, 150, 600)],
    ("\n".join(["| " + " | ".join(f"Vila {i} | {i * 7}" for i in range(80)) + " |"] * 4), "table"), (" ".join(f"| Vila {i} | {i * 7} |" for i in range(80)), "table"),
    ("<_*%>=|@ ;}*![\\[] }>{^_$ ~^$>*> /=}[ @|;[~:? " * 20, "junk"), (SPACED.replace(" ", "  ") + " (extraído da prova)", "prose"),
]


def plain_prose(n, more=""):
    words = "obras creches pontes vias escolas praças feiras hortas".split()
    return [SPACED.replace("O relatório", f"O laudo {i}") + more if i % 30 == 7 else f"O relatório {i} da comissão aponta que as {words[i % 8]} de {words[i % 7]} não avançaram desde março. Quem responde pela creche? Até agora, ninguém respondeu ao pedido {i}.{more}" for i in range(n)]


def kinds_of(spark, texts, lang="pt"):
    d = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    return {r["doc_id"]: r["kind"] for r in quality.outlier_scores(d).collect()}


def test_kinds(spark):
    texts = [t for t, _ in CASES] + plain_prose(300)
    got = kinds_of(spark, texts)
    wrong = [(t[:60], kind, got[i]) for i, (t, kind) in enumerate(CASES) if got[i] != kind]
    assert not wrong
    assert {got[i] for i in range(len(CASES), len(texts))} == {"prose"}


def test_score_decides(spark, monkeypatch):
    """The same document is an outlier where prose never looks like it, and none where prose often does; without tails nothing is found."""
    half = PROSE + "\n" + "\n".join(f"Vila {i}\t{i * 7}\t2001" for i in range(4))
    assert 0.2 < quality.statistics_of(half)["table_part"] < 0.5
    rare = plain_prose(300)
    often = [t + "\n" + "\n".join(f"Vila {i}\t{k + i * 7}\t2001" for i in range(7 + k % 3)) if k % 3 == 0 else t for k, t in enumerate(plain_prose(300))]
    assert kinds_of(spark, [half, *rare])[0] == "table"
    assert kinds_of(spark, [half, *often])[0] == "prose"
    plain = quality.tails
    monkeypatch.setattr(quality, "tails", lambda m, at: (plain(m, at)[0].limit(0), plain(m, at)[1]))
    assert set(kinds_of(spark, [t for t, _ in CASES] + rare).values()) == {"prose"}


def test_splits():
    h = np.zeros(quality.STEPS + 1)
    h[:50], h[900:950] = 10, 1
    assert 0.05 <= quality.split_at(h) <= 0.9
    h[:], h[30] = 0, 5
    assert quality.split_at(h) == quality.MOST_SPLIT


def test_all_of_a_language_may_be_no_prose(spark, tmp_path):
    rows = [(i, "\n".join(f"Vila {k}\t{k * 7 + i}\t2001" for k in range(3 + i % 5)), "pt") for i in range(40)] + [(99, PROSE, "pt")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in quality.found(spark, str(tmp_path)).collect()} == {(i, "table") for i in range(40)}


def test_quality_operator(spark):
    rows = [(i, PROSE + f" Número {i}.", "pt") for i in range(30)] + [(100, "=-" * 300, None), (101, None, "pt"), (102, " \n", "pt"), (103, "x", "PT-BR"), (104, " ".join(plain_prose(600)), "pt"), (100, "=-" * 300, None)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = quality.outlier_scores(d).collect()
    assert len(got) == 34 and {r["doc_id"] for r in got if r["kind"] == "junk"} >= {100}
    for lang in ("pt", ""):
        of = [r for r in got if r["lang"] == lang]
        for r in of:
            assert r["score_share"] == pytest.approx(sum(x["score"] <= r["score"] for x in of) / len(of))
    assert quality.outlier_scores(d.limit(0)).count() == 0


# ---------------------------------------------------------------- packing


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_exactly_the_histogram(seed):
    rng = np.random.default_rng(seed)
    x = [rng.integers(1, 2049, 900), rng.integers(600, 1100, 900), np.full(300, 1025), np.concatenate([np.full(500, 700), rng.integers(1, 60, 3000)])][seed]
    sizes, counts = np.unique(x, return_counts=True)
    held = {}
    used = 0
    for contents, times in packing.plan(sizes, counts, 2048):
        room = sum(s * n for s, n in contents.items())
        assert 0 < room <= 2048
        used += times
        for s, n in contents.items():
            held[s] = held.get(s, 0) + n * times
    assert held == {int(s): int(c) for s, c in zip(sizes, counts)}
    rooms: list[int] = []  # first fit, largest first
    for size in sorted(x.tolist(), reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= size), None)
        if at is None:
            rooms.append(2048 - size)
        else:
            rooms[at] -= size
    # rounding configurations down may cost a container per group, whatever the number of items
    assert used <= 1.01 * len(rooms) + packing.GROUPS // 4


def test_operator(spark):
    path = f"{packing.TOKENIZER_DIR}/{packing.TOKENIZER}"
    r = random.Random(1)
    texts = [" ".join(r.choice(["casa", "escola", "ponte"]) for _ in range(r.randint(1, 60))) for _ in range(120)] + ["palavra " * 700, None, "", "igual " * 10, "igual " * 10]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    got = packing.packed(d, 100, path).collect()
    n = {i: packing.token_count(t, path) for i, t in enumerate(texts) if t}
    per = {}
    for x in got:
        per.setdefault(x["doc_id"], []).append(x)
    assert set(per) == set(n)
    for i, xs in per.items():
        xs.sort(key=lambda x: x["piece_no"])
        assert sum(x["length"] for x in xs) == n[i] and (len(xs) == 1 or n[i] > 100)
        assert [x["first_token"] for x in xs] == [100 * k for k in range(len(xs))]
    fill = {}
    for x in got:
        fill[x["container_id"]] = fill.get(x["container_id"], 0) + x["length"]
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    assert packing.packed(d.limit(0), 100, path).count() == 0


def test_pieces_of_a_long_text_count_alike(monkeypatch):
    path = f"{packing.TOKENIZER_DIR}/{packing.TOKENIZER}"
    text = "O relatório (de 2001) aponta: não há solução.\n\n" * 200
    whole = packing.token_count(text, path)
    monkeypatch.setattr(packing, "PIECE", 500)
    assert packing.token_count(text, path) == whole
