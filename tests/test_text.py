"""Golden cases of the text expressions and the cleaning function."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import cleaning, dims
from corpusloom.functions import text as T
from corpusloom.operators import corpus


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "want"), [("unar", "UNAR"), (" S.PART. ", "SEM PARTIDO"), ("pcdob", "PCdoB"), ("XYZ", "XYZ"), (None, None)])
def test_party_spelling(spark, raw, want):
    assert one(spark, lambda c: corpus.party_name(c, dims.INVENTED_CLASS), raw) == want


@pytest.mark.parametrize("state", ["", None, "sp", "SP ", "S"])
def test_guest_rule(spark, state):
    d = spark.createDataFrame([("PT", state)], "partido string, estado string")
    r = corpus.classified(d).first()
    assert (r["partido"], r["espectro"]) == ("CONVIDADO", "Sem classificação")


@pytest.mark.parametrize(
    ("raw", "want"),
    [("CABO DACIOLO, S.PART.-RJ", ("CABO DACIOLO", "S.PART.", "RJ")), ("DILMA ROUSSEFF, MINISTRA-CHEFE DA CASA CIVIL", ("DILMA ROUSSEFF, MINISTRA-CHEFE DA CASA CIVIL", "CONVIDADO", "")), ("  ", ("SEM NOME", "CONVIDADO", "")), (None, ("SEM NOME", "CONVIDADO", ""))],
)
def test_speaker_parse(spark, raw, want):
    assert tuple(one(spark, T.parse_speaker, raw)) == want


def test_total_found(spark):
    assert one(spark, T.total_found, "1 a 50 de 1.483 documentos encontrados") == 1483
    assert one(spark, T.total_found, "Nenhum discurso encontrado") == 0
    assert one(spark, T.total_found, "erro") is None


def test_search_expression():
    assert T.search_expression(["feminicídio"]) == '"feminicídio" OR "feminicidio"'


@pytest.mark.parametrize(("raw", "want"), [("MARIA DO ROSÁRIO", "Maria do Rosário"), ("Erika Kokay", "Erika Kokay"), (" JOÃO E ANA ", "João e Ana")])
def test_display_name(spark, raw, want):
    assert one(spark, T.display_name, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("feminicídios", "feminicidio"), ("mês", "mes"), ("casas", "casa")])
def test_variant_key(spark, raw, want):
    assert one(spark, T.variant_key, raw) == want


def test_chunks(spark):
    sizes = lambda n, k: [len(c.split()) for c in one(spark, lambda c: T.chunks(c, k), " ".join("abcdefghijklmnopqrst"[:n]))]
    assert sizes(10, 4) == [4, 4, 2]
    assert sizes(9, 8) == [9]
    assert sizes(3, 8) == [3]


def test_keyword_patterns(spark):
    rx = T.keyword_pattern("violência doméstica")
    d = spark.createDataFrame([("violencias domesticas",), ("violenciadomestica",)], "x string").select(F.col("x").rlike(rx).alias("y"))
    assert [r["y"] for r in d.collect()] == [True, False]
    rx = T.any_keyword_pattern(["violência", "violência doméstica"])
    assert one(spark, lambda c: F.regexp_count(c, F.lit(rx)), "violencia domestica") == 1


def test_fold_takes_both_kinds_of_accents(spark):
    assert one(spark, T.fold, "AÇÃO") == "acao"
    assert one(spark, T.fold, "AÇÃO") == "acao"


def test_bigrams_and_tokens(spark):
    assert one(spark, lambda c: T.bigrams(T.tokens(c)), "O gato gato preto, de 3 anos") == ["gato preto", "preto de", "de anos"]
    assert one(spark, lambda c: T.bigrams(T.tokens(c)), "só") == []
    assert one(spark, lambda c: T.tokens(T.without_enclitics(c)), "quero criticá-la hoje") == ["quero", "hoje"]


@pytest.mark.parametrize(("raw", "want"), [("1/2/2020", "2020-02-01"), ("31/02/2020", None), ("01/02/13", None), ("2020-02-01", None), (None, None), ("", None)])
def test_dates(spark, raw, want):
    got = one(spark, T.br_date, raw)
    assert (str(got) if got else None) == want


def test_decimal_comma():
    assert (T.decimal_comma(0.25), T.decimal_comma(3.0)) == ("0,25", "3")


def test_spectrum_of():
    assert dims.spectrum_of(" pcdob") == "Extrema-esquerda"
    assert dims.spectrum_of("XYZ") == "Sem classificação"


def test_clean_speech_golden():
    raw = "O SR. FULANO (PT - SP. Sem revisão do orador.) - Sr. Presidente, Sras. e Srs. Deputados, quero falar do orçamento da saúde pública. Era o que tinha a dizer."
    assert cleaning.clean_speech(raw, "FULANO") == "quero falar do orçamento da saúde pública."
    assert cleaning.clean_speech(None) == ""


def test_clean_speech_keeps_the_main_speaker():
    raw = "O SR. FULANO (PT - SP) - A escola rural precisa de teto novo. A SRA. PRESIDENTE (Ana. PL - SP) - Conclua. O SR. FULANO - Termino com um pedido de verba. (Palmas.)"
    assert cleaning.clean_speech(raw, "Fulano") == "A escola rural precisa de teto novo. Termino com um pedido de verba."


def test_cleaning_is_idempotent_on_clean_text():
    text = "A escola rural precisa de teto novo antes do inverno."
    assert cleaning.clean_speech(cleaning.clean_speech(text)) == text


def test_html():
    page = "<p>menu</p><hr><div><p>Um &amp; dois</p><p>três<p>quatro</p></p></div>"
    assert cleaning.html_to_text(page) == "Um & dois quatro"
    assert cleaning.html_to_text("<p>sem regra</p>") == ""
    row = "<tr><td>1/1/2020</td><td>1</td><td>PE</td><td><a href='x?\n id=1'>texto</a></td><td></td><td>ANA, PT-SP</td><td>10h</td></tr><tr><td>x</td></tr>"
    got = cleaning.listing_rows(f"<table>{row}</table>", "https://a.example/b/")
    assert len(got) == 1 and got[0]["orador"] == "ANA, PT-SP" and got[0]["url"].startswith("https://a.example/b/x?")


def test_passages_cut_at_headings_and_keep_offsets():
    text = "Intro. O SR. ANA LIMA (PL - SP) - Um dois. A SRA. PRESIDENTE (Bia Reis. PT - RJ) - Conclua. PRONUNCIAMENTO ENCAMINHADO PELO ORADOR. Três quatro."
    got = cleaning.passages(text)
    assert [(p.who, text[p.start : p.end].strip()) for p in got] == [(None, "Intro."), ("ANA LIMA", "Um dois."), ("PRESIDENTE", "Conclua."), ("", "Três quatro.")]
    assert [text[p.start : p.end].strip() for p in cleaning.chosen(text, "Ána  Lima")] == ["Intro.", "Um dois.", "Três quatro."]
    assert [p.who for p in cleaning.chosen("A SRA. PRESIDENTE - Conclua. O SR. JOÃO REIS - Sim.", "Ninguém")] == ["PRESIDENTE"]
    assert cleaning.passages("   ") == []


def test_blank_keeps_length():
    assert cleaning.blank("abcdef", [(1, 3), (2, 4)]) == "a   ef" and cleaning.blank("abc", []) == "abc"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Sr. Presidente, Sras. e Srs. Deputados, boa tarde a todos. A seca atinge muitas cidades do interior.", "A seca atinge muitas cidades do interior."),
        ("Meus caros colegas e minhas caras colegas, a seca atinge muitas cidades hoje.", "a seca atinge muitas cidades hoje."),
        ("Senhor Presidente, venho falar da seca em nossas cidades. Os Anais da Casa devem registrar a fala.", "venho falar da seca em nossas cidades."),
        ("[Presidenta] A seca atinge muitas cidades, disse ela.", "[Presidenta] A seca atinge muitas cidades, disse ela."),
        ("A seca atinge muitas cidades. (Palmas.) Era o que tinha a dizer, Sr. Presidente. Muito obrigado.", "A seca atinge muitas cidades."),
        ("O Sr. ANA LIMA ( PL - SP ) pronuncia o seguinte discurso: A seca atinge muitas cidades do país.", "A seca atinge muitas cidades do país."),
        ("Nos termos do art. 5 da lei, a V.Exa. cabe responder pelas cidades.", "Nos termos do art. 5 da lei, a V.Exa. cabe responder pelas cidades."),
        ("O SR. JOÃO REIS (PT - SP) - Sim.", "Sim."),
        ("", ""),
    ],
)
def test_clean_cases(text, want):
    assert cleaning.clean_speech(text, "ANA LIMA") == want
