from __future__ import annotations

import time

import numpy as np
import pytest

from corpusloom.operators import fit, linkage, topics


def _signatures(seed, n, runs, k):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, k, (6, runs))
    sig = np.where(rng.random((n, runs)) < 0.3, rng.integers(-1, k, (n, runs)), centre[rng.integers(0, 6, n)])
    sig = np.unique(sig, axis=0)
    return sig, rng.integers(1, 6, len(sig))


def test_near_pairs_are_complete():
    sig, _ = _signatures(1, 150, 7, 3)
    apart = (sig[:, None] != sig[None]).sum(axis=2)
    for most in (1, 2):
        u, v = linkage.near_pairs(sig, most)
        assert set(zip(u.tolist(), v.tolist())) == {(i, j) for i in range(len(sig)) for j in range(i + 1, len(sig)) if apart[i, j] <= most}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("tile", [4, 256])
def test_groups_are_those_of_the_matrix(monkeypatch, seed, tile):
    monkeypatch.setattr(linkage, "TILE", tile)
    monkeypatch.setattr(linkage, "APART", 1)
    rng = np.random.default_rng(seed)
    runs, n = 2001, 80  # so many that no distances are equal
    centre = rng.integers(0, 4, (6, runs))
    sig = np.where(rng.random((n, runs)) < rng.uniform(0.1, 0.6, (n, 1)), rng.integers(-1, 4, (n, runs)), centre[rng.integers(0, 6, n)])
    w = 1 + rng.random(n)
    as_sets = lambda lab: {frozenset(np.flatnonzero(lab == k).tolist()) for k in set(lab.tolist())}
    assert as_sets(linkage.labels(sig, w, runs, 0.5)) == as_sets(topics.linkage_labels(sig, w, runs, 0.5))


@pytest.mark.parametrize("seed", range(4))
def test_nothing_inside_the_cut_is_left_apart(monkeypatch, seed):
    monkeypatch.setattr(linkage, "TILE", 16)
    sig, w = _signatures(seed, 220, 11, 4)
    lab = linkage.labels(sig, w, 11, 0.5)
    p = linkage.means(sig)
    centre = np.array([np.average(p[lab == k], axis=0, weights=w[lab == k]) for k in range(lab.max() + 1)])
    s = centre @ centre.T
    np.fill_diagonal(s, 0)
    assert s.max() < 5.5 and lab.max() + 1 < len(sig) / 3


def test_consensus_takes_any_number_of_signatures(spark, monkeypatch):
    rng = np.random.default_rng(2)
    runs = [(r, i, int(rng.integers(0, 3)) + 3 * (i % 2) if r == i % 15 else i % 2 * 3) for r in range(15) for i in range(120)]
    d = spark.createDataFrame(runs, "run int, id long, cluster int")
    want = {r["id"]: r["topic"] for r in topics.consensus(d, 15, 3).collect()}
    monkeypatch.setattr(topics, "MOST_NODES", 5)
    got = {r["id"]: r["topic"] for r in topics.consensus(d, 15, 3).collect()}
    assert got == want and len(got) == 120 and set(got.values()) == {0, 1}


def test_equal_signatures_with_noise_are_one_node(spark, monkeypatch):
    seen = []
    matrix = topics.linkage_labels
    monkeypatch.setattr(topics, "linkage_labels", lambda s, *a: seen.append(len(s)) or matrix(s, *a))
    rows = [(r, i, i // 20) for r in range(5) for i in range(40) if r > 1 or i >= 20] + [(4, i, 0) for i in range(50, 60)]
    t = topics.consensus(spark.createDataFrame(rows, "run int, id long, cluster int"), 5, 3)
    got = {r["id"]: r["topic"] for r in t.collect()}
    assert seen == [2]  # 20 records that were noise twice, 20 that never were; those with one run are within the cut of none
    assert {got[i] for i in range(20)} == {0} and {got[i] for i in range(20, 40)} == {1} and {got[i] for i in range(50, 60)} == {-1}


def test_the_model_takes_any_number_of_signatures(spark, monkeypatch):
    monkeypatch.setattr(topics, "MOST_NODES", 1)
    rng = np.random.default_rng(1)
    x = np.concatenate([np.eye(6)[i] * 4 + rng.standard_normal((30, 6)) * 0.4 for i in range(3)])
    v = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    texts = spark.createDataFrame([(i, "escola creche ensino") for i in range(len(x))], "id long, discurso string")
    rows = {r["id"]: r["topic"] for r in fit.fit(v, texts, 3, frozenset(), runs=3).records.collect()}
    assert len(rows) == 90 and all(len({rows[i] for i in range(30 * k, 30 * k + 30)}) == 1 for k in range(3)) and len(set(rows.values())) == 3


def test_fits_are_few_at_once_and_freed_in_between(spark, monkeypatch):
    running, most, freed = [], [], []

    def one(k):
        running.append(k)
        time.sleep(0.2)
        most.append(len(running))
        running.remove(k)
        return k * k

    monkeypatch.setattr(topics, "release", lambda s: freed.append(len(running)))
    assert topics._side_by_side(spark, one, range(7)) == [k * k for k in range(7)]
    assert max(most) == topics.FITS_AT_ONCE == 2 and freed == [0, 0, 0, 0]
