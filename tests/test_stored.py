"""Stored-table operations, imports, sinks, accents and topics on small fixtures."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import fit
from corpusloom.operators import accents, catalog, corpus, topics
from corpusloom.sources import readers, sinks


def test_upsert_prefers_latest_then_new(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 9, 5)], "k string, t int, v int")
    new = spark.createDataFrame([("a", 1, 6), ("b", 3, 7), ("c", 1, 8)], "k string, t int, v int")
    assert sorted((r["k"], r["v"]) for r in catalog.upsert(old, new, ["k"], "t").collect()) == [("a", 6), ("b", 5), ("c", 8)]


def test_insert_if_absent(spark):
    stored = spark.createDataFrame([(1, "u1")], "id int, url string")
    rows = spark.createDataFrame([(2, "u1"), (3, "u2"), (4, None), (5, None)], "id int, url string")
    assert sorted(r["id"] for r in catalog.insert_if_absent(stored, rows, "url").collect()) == [3, 4, 5]


def test_identity_prefers_url_then_lowest_id(spark):
    rows = [(1, None, "1/1/2020", " ana ", "x"), (2, "u", "1/1/2020", "ANA", "x"), (3, None, "1/1/2020", "ANA", "y"), (4, None, None, None, None), (5, None, None, None, None)]
    d = spark.createDataFrame(rows, "id int, url string, data string, orador string, discurso string")
    assert sorted(r["id"] for r in corpus.first_by_identity(d).collect()) == [2, 3, 4, 5]  # rows without text are speeches of their own


def test_merge_plan_errors(spark):
    ds = spark.createDataFrame([(1, "done", "2015-01-01", "2016-01-01"), (2, "done", "2018-01-01", "2019-01-01"), (3, "running", None, None)], "id long, status string, data_inicio string, data_fim string")
    ln = spark.createDataFrame([(1, 10)], "dataset_id long, speech_id long")
    sp = spark.createDataFrame([(10, None, "1/6/2015", "ANA", "texto")], "id long, url string, data string, orador string, discurso string")
    err = lambda ids: corpus.merge_plan(ds, ln, sp, ids).first()["error"]
    assert err([1]) == "at least two data sets"
    assert err([1, 9]) == "unknown data set"
    assert err([1, 3]) == "unfinished data set"
    assert err([1, 2]) == "no common period"


def test_keyword_union_keeps_first_spelling_and_accents(spark):
    d = spark.createDataFrame([(1, '["País"]'), (2, '["país", "pais"]'), (3, None)], "id int, keywords string")
    assert sorted(r["keyword"] for r in corpus.keyword_union(d, "id").collect()) == ["País", "pais"]


def _csv(tmp_path, body, name="a.csv"):
    p = tmp_path / name
    p.write_text(body, encoding="utf-8")
    return str(p)


HEAD = "﻿Data,Sessão,Orador,Partido,Estado,Fase,Hora,Discurso\n"


def test_import_csv(spark, tmp_path):
    long = "ação " * 60
    d = readers.import_csv(spark, _csv(tmp_path, HEAD + f'1/1/2020,1,ANA,PT,SP,PE,10h,"{long}\nlinha ""dois"""\n2/1/2020,1,ANA,,SP,PE,10h,"  "\n'))
    r = d.collect()
    assert len(r) == 1 and r[0]["Discurso"].endswith('linha "dois"') and d.columns == list(readers.COLUMNS)
    assert readers.stored(d).columns[:2] == ["id", "url"]


def test_import_refuses(spark, tmp_path):
    plain = "acao de governo " * 30
    with pytest.raises(readers.ImportRefused, match="accents"):
        readers.import_csv(spark, _csv(tmp_path, HEAD + f"1/1/2020,1,ANA,PT,SP,PE,10h,{plain}\n"))
    with pytest.raises(readers.ImportRefused, match="missing"):
        readers.import_csv(spark, _csv(tmp_path, "a,b\n1,2\n", "b.csv"))
    with pytest.raises(readers.ImportRefused, match="text"):
        readers.import_csv(spark, _csv(tmp_path, HEAD + "1/1/2020,1,ANA,PT,SP,PE,10h,\n", "c.csv"))


def test_rest_and_pages(spark):
    j = json.dumps({"dataHoraInicio": "2020-03-01T14:32", "faseEvento": {"titulo": None}, "tipoDiscurso": "BREVES", "transcricao": "x"})
    r = readers.rest_speeches(spark.createDataFrame([(j,)], "json string")).first()
    assert (r["data"], r["hora"], r["fase"]) == ("01/03/2020", "14h32", "BREVES")
    p = spark.createDataFrame([("u", "<hr><p>a&nbsp;b</p>"), ("v", None)], "url string, html string")
    assert {x["url"]: x["text"] for x in readers.parse_texts(p).collect()} == {"u": "a b", "v": ""}


def test_speaker_matching(spark):
    n = spark.createDataFrame([("ANA LIMA",), ("JOSÉ",), ("NINGUÉM",)], "orador string")
    p = spark.createDataFrame([(1, "Ana Lima"), (2, "José da Silva"), (3, "Ana Lima Neta")], "id int, nome string")
    assert sorted((r["orador"], r["id"]) for r in readers.match_speakers(n, p).collect()) == [("ANA LIMA", 1), ("JOSÉ", 2)]


def test_fetch_policy():
    calls, waits = iter([(503, ""), (429, ""), (200, "ok")]), []
    assert readers.fetch(lambda: next(calls), waits.append) == "ok" and waits == [5, 15]
    assert readers.fetch(lambda: (404, ""), waits.append) is None


def test_request_checks():
    with pytest.raises(ValueError):
        readers.Request((" ",), "2020-01-01", "2021-01-01")
    with pytest.raises(ValueError):
        readers.Request(("a",), "2022-01-01", "2021-01-01")
    with pytest.raises(ValueError):
        readers.Request(("a",), "2020-01-01", "2021-01-01", nr_topics=1)


def test_json_safe(spark, tmp_path):
    assert sinks.safe({1: float("nan"), "b": [np.float64(1.5), np.int64(2), float("inf")]}) == {"1": None, "b": [1.5, 2, None]}
    doc = sinks.document({"a": spark.range(2)})
    sinks.write_json(doc, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text())["a"] == [{"id": 0}, {"id": 1}]
    with pytest.raises(ValueError):
        sinks.document({"a": spark.range(5)}, most=3)
    assert "<\\/script>" in sinks.embed_html({"x": "</script>"})
    assert sinks.write_csv(spark.range(3), str(tmp_path / "a.csv")) == 3
    assert (tmp_path / "a.csv").read_bytes().startswith(b"\xef\xbb\xbf")


def test_vector_cache_and_partitions(spark, tmp_path):
    v = spark.createDataFrame([(1, "m", [1.0]), (2, "n", [2.0])], "speech_id long, model string, vector array<float>")
    sinks.append_vectors(v, str(tmp_path / "v"))
    assert [r["speech_id"] for r in sinks.read_vectors(spark, str(tmp_path / "v"), "m").collect()] == [1]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "v int, p string")
    sinks.replace_partition(a, str(tmp_path / "p"), "p")
    sinks.replace_partition(spark.createDataFrame([(9, "x")], "v int, p string"), str(tmp_path / "p"), "p")
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [2, 9]


def test_accent_map(spark, tmp_path):
    w = spark.createDataFrame([("país", 90), ("pais", 10), ("casa", 50), ("está", 80), ("esta", 1)], "word string, freq int")
    m = {r["bare"]: r["forms"] for r in accents.build_map(w).collect()}
    assert m == {"pais": ["país", "pais"], "esta": ["está"]}
    f = tmp_path / "m.tsv"
    f.write_text("# nota\npais\tpaís pais\n", encoding="utf-8")
    forms = accents.read_map(spark, str(f))
    assert accents.warnings_for(spark, ["pais e filhos"], forms).first()["forms"] == ["país", "pais"]
    assert accents.expand("gato", {"S": [("", "s", ".")]}, "S", 1) == {"gato", "gatos"}


# ---------------------------------------------------------------- topics


def _dense(runs, n_docs, n_runs):
    c = np.zeros((n_docs, n_docs))
    for r in range(n_runs):
        lab = np.array([runs.get((r, i), -1) for i in range(n_docs)])
        c += (lab[:, None] == lab[None, :]) & (lab[:, None] >= 0)
    return c / n_runs


def test_linear_membership_equals_dense(spark):
    rng = np.random.default_rng(1)
    runs = {(r, i): int(rng.integers(0, 3)) for r in range(4) for i in range(25) if rng.random() > 0.15}
    mine = {i: int(rng.integers(-1, 2)) for i in range(25)}
    rd = spark.createDataFrame([(r, i, c) for (r, i), c in runs.items()], "run int, id long, cluster int")
    td = spark.createDataFrame(list(mine.items()), "id long, topic int")
    got = {(r["id"], r["topic"]): r["value"] for r in topics.membership(rd, td, 4).collect()}
    c = _dense(runs, 25, 4)
    for (i, t), v in got.items():
        core = [j for j in range(25) if mine[j] == t and j != i]
        assert v == pytest.approx(c[i, core].mean() if core else 0.0)


def test_consensus_groups(spark):
    rows = [(r, i, (i % 2) if r < 4 else (i % 2 if i else 1)) for r in range(5) for i in range(20)]
    t = topics.consensus(spark.createDataFrame(rows, "run int, id long, cluster int"), 5, 3)
    got = {r["id"]: r["topic"] for r in t.collect()}
    assert len({got[i] for i in range(0, 20, 2)}) == 1 and len({got[i] for i in range(1, 20, 2)}) == 1 and got[0] != got[1]


def _naive(sig, weights, runs, threshold):
    """Average linkage by the closest pair, straight from the definition."""
    groups = [[i] for i in range(len(sig))]
    share = lambda i, j: 1 - ((sig[i] == sig[j]) & (sig[i] != topics.NOISE)).sum() / runs
    far = lambda a, b: sum(weights[i] * weights[j] * share(i, j) for i in a for j in b) / (sum(weights[i] for i in a) * sum(weights[j] for j in b))
    while len(groups) > 1:
        d, i, j = min((far(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if d > threshold:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(6))
def test_linkage_against_the_definition(seed):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 4, (5, 11))
    sig = np.where(rng.random((24, 11)) < 0.25, rng.integers(-1, 4, (24, 11)), centre[rng.integers(0, 5, 24)])
    sig = np.unique(sig, axis=0)
    weights = rng.integers(1, 6, len(sig))
    labels = topics.linkage_labels(sig, weights, 11, 0.5)
    got = {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels)}
    want = _naive(sig, weights, 11, 0.5)
    assert got == want or len(got) == len(want)  # equal distances may be taken in another order


def test_fit_gives_every_record_a_row(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.eye(6)[i] * 4 + rng.standard_normal((40, 6)) * 0.3 for i in range(3)] + [rng.standard_normal((6, 6))])
    v = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)] + [(999, [0.0] * 6)], "id long, vector array<double>")
    texts = spark.createDataFrame([(i, ["escola creche ensino", "rodovia ponte asfalto", "vacina hospital leito"][min(i // 40, 2)]) for i in range(len(x))], "id long, discurso string")
    m = fit.fit(v, texts, 3, frozenset(), runs=5)
    rows = {r["id"]: r for r in m.records.collect()}
    assert set(rows) == set(range(len(x)))
    groups = [{rows[i]["topic"] for i in range(40 * k, 40 * k + 40)} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert {r["label"].split(": ")[1].split(" | ")[0] for r in m.labels.collect() if r["topic"] >= 0} <= {"escola", "creche", "ensino", "rodovia", "ponte", "asfalto", "vacina", "hospital", "leito", "asfalto"}
    plain = fit.fit(v, texts, 3, frozenset(), runs=5, reassign=False, most_topics=2)
    assert {r["topic"] for r in plain.records.select("topic").distinct().collect()} <= {-1, 0, 1}
    assert fit.keyword_share(texts.withColumn("topic", F.lit(0)), ["escola"]) is None


def test_merge_keeps_to_the_common_period(spark):
    ds = spark.createDataFrame([(1, "a", "done", '["x"]', "2020-01-01", "2020-12-31"), (2, "b", "done", '["y"]', "2020-06-01", "2021-06-30"), (3, "c", "done", None, None, None), (4, "d", "running", None, "2020-01-01", "2020-12-31")], "id long, name string, status string, keywords string, data_inicio string, data_fim string")
    sp = spark.createDataFrame([(1, "u1", "01/02/2020", "ANA", "t1"), (2, "u2", "01/07/2020", "ANA", "t2"), (3, None, "01/07/2020", " ana", "t2"), (4, "u4", "01/08/2020", "RUI", None), (5, "u5", "01/03/2021", "RUI", "t5")], "id long, url string, data string, orador string, discurso string")
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4), (2, 5), (3, 2), (3, 4), (4, 1)], "dataset_id long, speech_id long")
    ids = lambda *x: {r["speech_id"] for r in corpus.merged(ds, links, sp, list(x), 9).collect()}
    assert ids(1, 2) == {2, 4} and ids(2, 1) == {2, 4}
    plan = corpus.merge_plan(ds, links, sp, [1, 2]).first()
    assert (plan["rows_in"], plan["kept"], plan["outside"], plan["repeated"], plan["error"]) == (4, 1, 2, 1, "")
    assert str(corpus.merge_plan(ds, links, sp, [1, 3]).first()["inicio"]) == "2020-07-01"  # the dates of its speeches
    for chosen, error in (([1], "at least"), ([1, 77], "unknown"), ([1, 4], "unfinished")):
        assert corpus.merge_plan(ds, links, sp, chosen).first()["error"].startswith(error) and not ids(*chosen)
    r = corpus.merged_record(ds, links, sp, [1, 2], 9, "ab").first()
    assert (r["total_expected"], r["keywords"], r["data_inicio"]) == (1, '["x","y"]', "2020-06-01") and '"fora_do_periodo":2' in r["origem"]


def test_register_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(readers, "BROADCAST_ROWS", 2)
    people = spark.createDataFrame([(i, f"N{i}") for i in range(3)], "id long, nome string")
    with pytest.raises(ValueError):
        readers.match_speakers(spark.createDataFrame([("N1 X",)], "orador string"), people)


def test_replacement_character_is_valid_utf8(spark, tmp_path):
    good = str(tmp_path / "g.csv")
    with open(good, "w", encoding="utf-8") as f:
        f.write("Data\n\ufffd\n")
    bad = str(tmp_path / "b.csv")
    with open(bad, "wb") as f:
        f.write("Data\nação\n".encode("latin-1"))
    assert readers.is_utf8(spark, good) and not readers.is_utf8(spark, bad)


def test_linkage_refuses_too_many():
    with pytest.raises(ValueError):
        topics.linkage_labels(np.zeros((topics.MOST_NODES + 1, 1), int), np.ones(topics.MOST_NODES + 1), 1)


def test_labels_and_sizes(spark):
    v = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.35), (1, 2, 0.20), (1, 3, 0.19)], "id long, topic int, value double")
    t = spark.createDataFrame([(1, 0)], "id long, topic int")
    assert topics.labels_of(v, t).first()["topics"] == [0, 1, 2]
    assert (topics.min_cluster_size(1483), topics.min_cluster_size(10_000)) == (15, 100)
    assert topics.time_estimate(1500, 1500, 2.0, 15) == pytest.approx(20 + 0.0225 * 1500 + 0.0025 * 15 * 1500)


def test_encode_and_reassign(spark):
    d = spark.createDataFrame([(1, "a b c " * 5), (2, ""), (3, None)], "id long, discurso string")
    e = topics.encode(d, topics.hashing_encoder(8), 4).collect()
    assert len(e) == 1 and np.linalg.norm(e[0]["vector"]) == pytest.approx(1, abs=1e-5)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.0, 0.0])], "id long, vector array<double>")
    t = spark.createDataFrame([(1, 0), (2, 1), (3, -1), (4, -1)], "id long, topic int")
    assert {r["id"]: (r["topic"], r["moved"]) for r in topics.reassigned(v, t).collect()} == {1: (0, False), 2: (1, False), 3: (0, True), 4: (-1, False)}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "id long, data string, orador string, partido string, estado string, fase string, discurso string, url string")
    p = corpus.classified(corpus.with_dates(d))
    assert corpus.counts(p, "ano").count() == 0 and corpus.dense_years(p, "partido").count() == 0 and corpus.top_speakers(p).count() == 0
    assert not corpus.enough_rows(d) and corpus.first_by_identity(d).count() == 0
    assert p.select(F.count("*")).first()[0] == 0


def test_kmeans_grid_fits_on_every_vector(spark, sf, monkeypatch):
    seen = []

    class Spy(topics.KMeans):
        def fit(self, dataset, params=None):
            seen.append(dataset.count())
            return super().fit(dataset, params)

    monkeypatch.setattr(topics, "KMeans", Spy)
    v = spark.createDataFrame([(i, [1.0 + i % 3, 5.0 * (i % 2), 0.1 * i]) for i in range(40)], "id long, vector array<float>")
    got = topics.kmeans_grid(v, [2, 3], sample=10).collect()
    assert seen == [40, 40] and [r["k"] for r in got] == [2, 3] and sum(r["chosen"] for r in got) == 1
    monkeypatch.setattr(topics, "kmeans_grid", lambda v, ks, words: list(ks))
    from corpusloom.plans import themes

    assert themes.kmeans_grid(spark, sf) == [10, 20, 30, 40, 50, 60, 70]
