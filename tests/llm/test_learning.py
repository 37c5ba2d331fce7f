"""What ops 2 and 4 learn rests on every labelled document outside the held-out fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from idlattice.llm import quality_model, quality_rules
from idlattice.llm.common import order_statistics


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(6)
    values = {0: rng.normal(size=3000), 1: np.full(500, 0.1), 2: rng.integers(0, 4, 700) / 3, 3: np.array([-2.5])}
    rows = spark.createDataFrame([(k, float(v), 1) for k, vs in values.items() for v in vs] + [(2, -7.0, 5)], "key int, value double, weight long")
    values[2] = np.concatenate([values[2], np.full(5, -7.0)])
    ranks = {k: sorted({0, len(v) // 3, len(v) // 2, len(v) - 1}) for k, v in values.items()}
    want = {k: np.sort(values[k])[v].tolist() for k, v in ranks.items()}
    assert order_statistics(rows, ranks) == want and order_statistics(rows, ranks, bins=2) == want


@pytest.fixture(scope="module")
def marked(spark):
    """Texts of many lengths, one of a hundred chunks, with copies; ids that lend their mark to several texts."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(500)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([20, 60, 100, 300, 1500])))) for i in range(400)]
    rows += [(500, "".join(rng.choices("0123456789abcdef ", k=4096)) + " ".join(rng.choices(vocabulary, k=70_000))), (7, rows[8][1]), (None, rows[9][1]), (3, None)] + [(600 + i, rows[9][1]) for i in range(50)]
    labels = [(i, int(rng.random() < 0.8)) for i in range(400) if i % 5] + [(500, 1)] + [(600 + i, i % 2) for i in range(50)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def _learnt(marked):
    texts, labels = marked
    return texts.join(labels, "doc_id").where(~quality_rules.held_out()).collect()


def test_limits_rest_on_every_piece(marked):
    sizes, ratios = [], []
    packer = quality_rules.zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    for r in _learnt(marked):
        raw = (r.text or "").encode()
        if r.quality and len(raw.split()) >= 50:
            for piece in (raw, *quality_rules.chunks_of(raw)):
                sizes.append(len(piece))
                ratios.append(len(packer.compress(piece)) / len(piece))
    assert sizes.count(4096) > 100
    want, got = quality_rules.fit_limits(np.array(sizes), np.array(ratios)), quality_rules.learn_limits(*marked)
    assert len(got.at) == 3
    for name in ("at", "lowest", "highest"):
        assert np.allclose(getattr(got, name), getattr(want, name), rtol=1e-12, atol=0)


def test_weights_are_the_best_of_all_pairs(marked):
    """The slope of all pairs' likelihood, formed one by one, vanishes at the learnt weights; the cut is the quantile of all strengths."""
    texts, labels = marked
    model = quality_model.learn(texts, labels)
    learnt = _learnt(marked)
    x = quality_model.features([(r.text or "").encode() for r in learnt])
    good = np.array([r.quality == 1 for r in learnt])
    assert np.allclose(model.centre, x.mean(axis=0), atol=1e-8)
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    d = (z[good][:, None] - z[~good]).reshape(-1, z.shape[1])
    assert len(d) > 10_000
    slope = quality_model.WEIGHT / len(d) * (d / (1 + np.exp(d @ model.weights))[:, None]).sum(axis=0) - quality_model.RIDGE * model.weights
    assert np.abs(slope).max() < 0.05
    strengths = np.sort(model.strengths(x))
    assert model.cut == strengths[(~good).sum() - 1 : (~good).sum() + 1].mean()
    assert np.allclose(model.weights, quality_model.fit(x, good.astype(float)).weights, atol=1e-5)
    again = quality_model.learn(texts.repartition(7), labels.repartition(3))
    assert np.array_equal(again.weights, model.weights) and again.cut == model.cut and np.array_equal(again.scale, model.scale)


def test_sums_over_opponents(spark):
    """From moments of cells, the pull of each row equals the sum over its opponents, far and near."""
    rng = np.random.default_rng(4)
    x, good = rng.normal(size=(400, 3)) * 6, rng.random(400) < 0.7
    w = np.array([1.0, -0.5, 3.0])
    at, powers = quality_model.cells_of(x, good, w)
    cells, where = np.unique(at, return_inverse=True)
    moments = np.zeros((len(cells), quality_model.ORDER + 3))
    np.add.at(moments, where, np.hstack([powers, x]))
    pull, bend, faced = quality_model.opponents(cells, moments)
    s = (x * w).sum(axis=1)
    lose = 1 / (1 + np.exp(s[good][:, None] - s[~good]))
    want = np.zeros(400)
    want[good], want[~good] = lose.sum(axis=1), -lose.sum(axis=0)
    assert np.allclose((powers * pull[where]).sum(axis=1), want, rtol=1e-9, atol=1e-9)
    curve = (x * bend[where][:, None]).T @ x - faced - faced.T
    d = (x[good][:, None] - x[~good]).reshape(-1, 3)
    assert np.allclose(curve, (d * (lose * (1 - lose)).reshape(-1, 1)).T @ d, rtol=0.02)
