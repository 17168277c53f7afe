from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import encoding

TEXT = "A situação não é fácil: o § 2º da medida – já às 14h – alcança famílias e órgãos."


#: What the chain leaves as it was cannot be told from correct text, so a text comes back whole only if it is made of what the chain changes.
@pytest.mark.parametrize("chain", encoding.CHAINS)
def test_round_trip(chain):
    sure = [c for c in encoding._inverse(chain)[0] if len(c) > 1 or c not in encoding.NATURAL]
    letters = "".join(encoding._inverse(chain)[0][c] for c in sure)
    assert len(letters) >= 8
    text = " ".join(f"xa{c}bo" for c in letters if c in encoding.LETTERS) + " fim"
    bad = encoding.damage(text, chain)
    assert bad != text and encoding.evidence(bad, "discurso")[0] > 0
    assert encoding.restore(bad, chain) == text


@pytest.mark.parametrize("text", [TEXT, "Até que ponto? Veja a.example/busca?tema=agua e b.example/q?ano=2019.", "decomposição", "Boa Espera? é... Até agora", "", "ÓRGÃO ÀS ÚLTIMAS"])
def test_correct_text_is_no_case(text):
    assert encoding.evidence(text, "discurso")[0] == 0
    assert encoding.repair(text) == text


ROWS = "id long, url string, orador string, discurso string, value string"


def test_operator(spark):
    rows = [
        (1, "http://a.example/x", "JOÃO", encoding.damage(TEXT, "utf8>cp1252"), "clash"),
        (2, "http://a.example/y", "JO?O", TEXT, ""),
        (3, None, None, None, None),
        (4, None, "JO�O", "", None),
        (5, None, "ANA", "n?o h? solu??o", None),
        (5, None, "ANA", "n?o h? solu??o", None),
        (6, None, "ANA", "custa 5 € ou 3 ½", None),
        (7, None, "ANA", "x" * 300_000 + " Ã£ fim", None),
    ]
    d = spark.createDataFrame(rows, ROWS)
    out = {(r["id"], r["field_name"]): r for r in encoding.repaired(d, ("orador", "discurso"), F.coalesce(F.regexp_extract("url", r"^\w+://([^/?]+)", 1), F.lit(""))).collect()}
    assert set(out) == {(1, "discurso"), (2, "orador"), (4, "orador"), (5, "discurso"), (7, "discurso")}
    assert out[(1, "discurso")]["restored"] == TEXT and out[(2, "orador")]["restored"] is None
    assert out[(7, "discurso")]["restored"].endswith(" ã fim")


def test_empty(spark):
    assert encoding.repaired(spark.createDataFrame([], ROWS), ("orador", "discurso"), F.lit("")).count() == 0


def cases(spark, rows):
    d = spark.createDataFrame([(i, f"http://{s}.example/{i}", "ANA", x, None) for i, (s, x) in enumerate(rows)], ROWS)
    return {r["id"] for r in encoding.repaired(d, ("orador", "discurso"), F.coalesce(F.regexp_extract("url", r"^\w+://([^/?]+)", 1), F.lit(""))).collect()}


def test_the_source_decides(spark):
    """The same sentence is a case where its source loses letters, and none where it never does."""
    doubtful = "Falamos do par? é bom."
    common = ["Fomos ao Pará de barco."] * 3 + ["Alguém viu o par? Até agora, não."] * 40 + ["A pauta não é nova e há quem já até saiba."] * 300
    bad = [("bad", "n?o h? solu??o para a quest?o")] * 120
    rows = [("good", doubtful), ("bad", doubtful)] + [("good", x) for x in common] + bad
    got = cases(spark, rows)
    assert 1 in got and 0 not in got and set(range(len(rows) - 120, len(rows))) <= got


def test_the_collection_tells_what_a_question_mark_is(spark):
    """No list of words: a stem that makes a common word with an accented letter has lost it, one that ends questions has not."""
    plain = ["Fomos a Tamboré ontem.", "Já há quem vá até lá.", "Quem fiscaliza o asfalto? Ninguém sabe.", "Quem paga o leite? Até agora, ninguém."] * 20
    rows = [("a", "Fomos a Tambor? do Norte."), ("a", "Quem fiscaliza o asfalto? é... não sei."), ("a", "Ele ficou at? mais tarde."), ("a", "Quem paga o leite? bom, é... veremos.")] + [("a", x) for x in plain]
    assert cases(spark, rows) == {0, 2}
    d = spark.createDataFrame([(i, None, None, x, None) for i, (_, x) in enumerate(rows)], ROWS)
    assert {r["id"] for r in encoding.suspicious(d, ("orador", "discurso"), F.lit("")).collect()} == {0, 1, 2, 3}
