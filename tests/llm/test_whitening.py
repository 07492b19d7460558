"""Whitening against numpy's own eigen-solver, and odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.queries import QUERIES
from tessera.llm.whitening import FAN_IN, Moments, moments, symmetric_qr, whiten_embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long"


def _rows(vectors):
    return [(i, v, 0, "x", None) for i, v in enumerate(vectors)]


def _plain(rows, components=16):
    """{vec_id: ...} by exact whole numbers and numpy.linalg."""
    grid = {i: [math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted({tuple(x) for x in grid.values()})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = np.array([s / n for s in total])
    centred = np.array(fit) - mean
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    return {i: (n, sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)), (np.array(x) - mean) @ q / np.sqrt(e), e / np.trace(cov)) for i, x in grid.items()}


def _agree(got, want):
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(want)
    signs = None
    for i, (n, deviation, white, explained) in want.items():
        rows = [by[i][k + 1] for k in range(len(white))]
        assert len(by[i]) == len(white) and {(r.n, r.deviation) for r in rows} == {(n, deviation)}
        mine = np.array([r.whitened for r in rows])
        if signs is None:
            signs = np.sign(mine) * np.sign(white)
        assert np.allclose(mine * signs, white, rtol=1e-6, atol=1e-6)
        assert np.allclose([r.explained for r in rows], explained, rtol=1e-6)
        assert all(r.identity_error < 1e-4 for r in rows)


def test_against_plain(spark):
    rnd = np.random.default_rng(5)
    vectors = (rnd.normal(size=(300, 20)) @ rnd.normal(size=(20, 20)) / 8).astype(np.float32).tolist()
    rows = _rows([*vectors, *vectors[:40], *[vectors[7]] * 30])
    odd = [(900, None, 0, "x", None), (901, [float("nan")] * 20, 0, "x", None), (902, [float("inf")] * 20, 0, "x", None), (903, [None] * 20, 0, "x", None), (904, [], 0, "x", None)]
    df = spark.createDataFrame([*rows, *odd], SCHEMA).repartition(7)
    _agree(whiten_embeddings(df).collect(), _plain(rows))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    _agree(QUERIES["op11_whitening"](spark, sf).collect(), _plain(rows))


def test_odd_tables(spark):
    assert whiten_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0
    alike = whiten_embeddings(spark.createDataFrame(_rows([[0.5, 1.0, 2.0]] * 5), SCHEMA)).collect()
    assert len(alike) == 15 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, 0.0, None) for r in alike)
    # Lengths are fitted apart; null ids and vectors without spread in a dimension stay.
    mixed = [(None, [1.0, 5.0]), (1, [2.0, 5.0]), (2, [4.0, 5.0]), (3, [1.0]), (4, [3.0])]
    got = whiten_embeddings(spark.createDataFrame([(i, v, 0, "x", 1) for i, v in mixed], SCHEMA)).collect()
    assert sorted((r.component, r.n) for r in got if r.vec_id in (1, None)) == [(1, 3), (1, 3), (2, 3), (2, 3)]
    assert all((r.whitened is None) == (r.component == 2) for r in got) and {r.n for r in got if r.vec_id in (3, 4)} == {2}
    far = whiten_embeddings(spark.createDataFrame(_rows([[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]]), SCHEMA)).collect()
    assert len(far) == 6 and all(r.deviation is None for r in far if r.vec_id < 2)


def test_states_merge_in_a_tree(spark):
    rnd = np.random.default_rng(2)
    x = rnd.integers(-50, 50, (500, 5)) + 1000000
    df = spark.createDataFrame([(bytearray(r.astype(np.int64).tobytes()),) for r in x], "x binary").repartition(2 * FAN_IN + 3)
    got = moments(df)[5]
    assert got.n == 500 and got.total == x.sum(0).tolist()
    assert np.allclose(got.covariance(), np.cov(x.T, bias=True), rtol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_symmetric_qr(n):
    rnd = np.random.default_rng(n)
    for a in (rnd.normal(size=(n, n)), np.eye(n), np.ones((n, n)), np.diag(np.arange(n) // 2), np.zeros((n, n))):
        v = (a + a.T) / 2
        e, q = symmetric_qr(v)
        assert np.allclose(e, np.linalg.eigvalsh(v)[::-1], atol=1e-12 * max(1, n))
        assert np.allclose(q.T @ q, np.eye(n), atol=1e-12) and np.allclose(v @ q, q * e, atol=1e-11)


def test_moments_far_from_zero():
    m = Moments.of(2)
    m.add(np.array([[1000001, 1000000], [999999, 1000000]], np.int64))
    assert m.covariance().tolist() == [[1.0, 0.0], [0.0, 0.0]]
