"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text. Every pair of a document labelled 1 and one labelled
0 is a preference; the chance that i beats j is the logistic function of the difference of strengths, and the
weights maximise the pairs' mean likelihood (Newton steps with a ridge). Strengths become scores by a
logistic curve laid so that the quantile of the training strengths at the share of label 0 gets score
0.3: what lies below that quantile is rejected.

The fit takes all labelled documents outside the held-out fold and all pairs of them, which are never formed:
strengths are dealt to cells of width ``CELL``, a cell is known by its moments, and the Taylor series of the
logistic function gives each document the sum over its opponents (``ORDER`` terms, an error of about 1e-11 of it).
A round is two sums over the labelled rows; the driver gets those of the cells and of the weights. The curvature takes strengths
at the middle of their cells, which changes the way to the maximum but not its place. Weights, centre and scale are
rounded, so that the order of the sums doesn't show in a score.

Defined cases: null or empty text has the features of an empty text and a score; labels with a null id or
a null mark are left out, of several marks of one id the mean counts; without both marks every score is
0.5; labelled ids of several documents lend their mark to each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from numpy.polynomial import Polynomial
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, fresh, map_texts, materialize, order_statistics, read

#: The mean over all pairs weighs as so many pairs against the ridge.
WEIGHT = 50_000.0
RIDGE = 1.0
#: Width of a cell of strengths, and terms of the series in it.
CELL = 0.125
ORDER = 8
#: Weights are multiples of this.
GRAIN = 2.0**-20
CUT = 0.3
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b"@", b":;", b"/\\", b"-_", b"()[]{}", b"'\"", bytes(range(128, 256)), bytes(range(9)) + bytes(range(11, 32))]
_OF_BYTE = np.full(256, len(_CLASSES), np.int64)
for _k, _chars in enumerate(_CLASSES):
    _OF_BYTE[list(_chars)] = _k
N_FEATURES = 2 * (len(_CLASSES) + 1) + 10


def features(texts: list[bytes]) -> np.ndarray:
    """One row a text: shares of character classes and their roots, and counts of words and lines."""
    out = np.zeros((len(texts), N_FEATURES))
    for k, text in enumerate(texts):
        if not text:
            continue
        shares = np.bincount(_OF_BYTE, np.bincount(np.frombuffer(text, np.uint8), minlength=256), len(_CLASSES) + 1) / len(text)
        words = text.split()
        n = max(1, len(words))
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        m = max(1, len(lines))
        kinds = len(set(words))
        upper = sum(map(bytes.isupper, words))
        title = sum(map(bytes.istitle, words))
        out[k] = [*shares, *np.sqrt(shares), np.log1p(n), len(text) / n / 10, kinds / n, len(set(lines)) / m, np.log1p(n / m), upper / n, title / n, np.log1p(n / max(1, kinds)), float(n < 50), sum(map(bytes.isalpha, words)) / n]
    return out


def standard(rows: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((rows - centre) / scale, -8, 8)


def strengths_of(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Summed row by row: a product of matrices would make the last digit depend on the rows beside."""
    return (x * weights).sum(axis=1)


class BradleyTerry:
    """Weights, scale of the features and the strength at the cut."""

    def __init__(self, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray, cut: float, width: float) -> None:
        self.weights, self.centre, self.scale, self.cut, self.width = weights, centre, scale, cut, width

    def strengths(self, rows: np.ndarray) -> np.ndarray:
        return strengths_of(standard(rows, self.centre, self.scale), self.weights)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; CUT at the quantile that the fit chose."""
        z = (self.strengths(rows) - self.cut) / self.width + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def climb(slope: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Weights at the maximum of a likelihood, less the ridge, by Newton steps; slope gives its gradient and curvature."""
    w = np.zeros(width)
    for _ in range(rounds):
        gradient, curve = slope(w)
        step = np.linalg.solve(curve + ridge * np.eye(width), gradient - ridge * w)
        w = w + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < GRAIN:
            break
    return w


def fit(rows: np.ndarray, marks: np.ndarray, pairs: int | None = None, ridge: float = RIDGE) -> BradleyTerry | None:
    """The fit for rows in memory, pair by pair: all of them, or as many drawn ones as asked for. None unless both marks are there."""
    good, bad = np.flatnonzero(marks >= 0.5), np.flatnonzero(marks < 0.5)
    if not len(good) or not len(bad):
        return None
    centre, scale = rows.mean(axis=0), rows.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = standard(rows, centre, scale)
    rng = np.random.default_rng(11)
    winners, losers = (rng.choice(good, pairs), rng.choice(bad, pairs)) if pairs else (np.repeat(good, len(bad)), np.tile(bad, len(good)))
    each = 1.0 if pairs else WEIGHT / len(winners)

    def slope(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gradient, curve = np.zeros(len(w)), np.zeros((len(w), len(w)))
        for a in range(0, len(winners), 20_000):
            d = x[winners[a : a + 20_000]] - x[losers[a : a + 20_000]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
            gradient += p @ d
            curve += (d * (p * (1 - p))[:, None]).T @ d
        return each * gradient, each * curve

    w = climb(slope, x.shape[1], ridge)
    strengths = strengths_of(x, w)
    cut = float(np.quantile(strengths, len(bad) / len(marks), method="midpoint"))
    return BradleyTerry(w, centre, scale, cut, max(1e-9, float(strengths.std()) / 4))


#: Each derivative of the logistic function, as a polynomial in its value.
_DERIVATIVES = [Polynomial([0.0, 1.0])]
while len(_DERIVATIVES) < ORDER:
    _DERIVATIVES.append(_DERIVATIVES[-1].deriv() * Polynomial([0.0, 1.0, -1.0]))


def cells_of(x: np.ndarray, good: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each row's strength (twice its number, one more if good) and the powers of the distance from its middle."""
    s = strengths_of(x, w)
    at = np.floor(s / CELL).astype(np.int64)
    return 2 * at + good, (s - (at + 0.5) * CELL)[:, None] ** np.arange(ORDER)


def opponents(cells: np.ndarray, moments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs, from their cells' moments (sums of the powers, then of the rows): for each cell the coefficients
    of a row's pull (its sum of chances to lose, or less the sum of its chances to win for a bad one) in the powers of its distance,
    its curvature; and the products of rows that face each other, weighted by curvature."""
    middle, good = (cells // 2 + 0.5) * CELL, cells % 2 == 1
    scaled = moments[:, :ORDER] / [factorial(k) for k in range(ORDER)]
    pull, bend = np.zeros((len(cells), ORDER)), np.zeros(len(cells))
    faced = np.zeros((moments.shape[1] - ORDER,) * 2)
    winners = np.flatnonzero(good)
    for block in np.array_split(np.flatnonzero(~good), 1 + (~good).sum() // 512):
        chance = 1 / (1 + np.exp(np.clip(middle[winners] - middle[block][:, None], -500, 500)))
        for n, derivative in enumerate(_DERIVATIVES):
            d = derivative(chance)
            for k in range(n + 1):  # the opponent's power; n - k is the row's own
                pull[winners, n - k] += (-1) ** (n - k) / factorial(n - k) * (scaled[block, k] @ d)
                pull[block, n - k] -= (-1) ** k / factorial(n - k) * (d @ scaled[winners, k])
            if n == 1:
                bend[winners] += moments[block, 0] @ d
                bend[block] += d @ moments[winners, 0]
                faced += moments[block, ORDER:].T @ d @ moments[winners, ORDER:]
    return pull, bend, faced


def sums(rows: DataFrame, width: int, of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """What ``of`` makes of features and marks, a key and ``width`` numbers a line, summed by key; in order of the keys."""
    names = [f"v{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, good in arrays(batches):
            keys, values = of(x, good)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *map(pa.array, np.ascontiguousarray(values.T))], names=["at", *names])

    made = rows.select("x", "good").mapInArrow(run, ", ".join(["at long", *[f"{n} double" for n in names]]))
    # bounded by the keys: cells of strengths or weights
    table = made.groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).toArrow().sort_by("at")
    return table["at"].to_numpy(), np.stack([table[n].to_numpy() for n in names], axis=1)


def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1), batch.column(1).to_numpy(zero_copy_only=False)


def fit_all(rows: DataFrame, ridge: float = RIDGE) -> BradleyTerry | None:
    """``fit`` with all pairs of a table of any size: x (features) and good."""
    count = {r.good: r["count"] for r in rows.groupBy("good").count().collect()}
    if len(count) < 2:
        return None
    n, each = sum(count.values()), WEIGHT / (count[True] * count[False])
    total = lambda of: sums(rows, N_FEATURES, lambda x, good: (np.zeros(1), of(x)[None]))[1][0]
    centre = np.round(total(lambda x: x.sum(axis=0)) / n, 9)
    scale = np.round(np.sqrt(total(lambda x: ((x - centre) ** 2).sum(axis=0)) / n), 9)
    scale[scale < 2e-9] = 1.0

    def slope(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def moments(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x = standard(x, centre, scale)
            at, powers = cells_of(x, good, w)
            order = np.argsort(at, kind="stable")
            cells, begins = np.unique(at[order], return_index=True)
            return cells, np.add.reduceat(np.hstack([powers, x])[order], begins)

        cells, found = sums(rows, ORDER + N_FEATURES, moments)
        pull, bend, faced = opponents(cells, found)

        def slopes(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x = standard(x, centre, scale)
            at, powers = cells_of(x, good, w)
            k = np.searchsorted(cells, at)
            return np.arange(N_FEATURES + 1), np.vstack([(powers * pull[k]).sum(axis=1) @ x, (x * bend[k][:, None]).T @ x])

        both = sums(rows, N_FEATURES, slopes)[1]
        return each * both[0], each * (both[1:] - faced - faced.T)

    w = np.round(climb(slope, N_FEATURES, ridge) / GRAIN) * GRAIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in arrays(batches):
            s = strengths_of(standard(x, centre, scale), w)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(s)), pa.int32()), pa.array(s), pa.array(np.ones(len(s)), pa.int64())], names=["key", "value", "weight"])

    strengths = rows.select("x", "good").mapInArrow(run, "key int, value double, weight long")
    cut = float(np.mean(order_statistics(strengths, {0: [count[False] - 1, count[False]]})[0]))
    return BradleyTerry(w, centre, scale, cut, max(1e-9, round(strengths.agg(F.stddev_pop("value")).first()[0] / 4, 9)))


def labelled(labels: DataFrame, mark: str) -> DataFrame:
    """doc_id, mark: one row for each id that has marks, with their mean."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(mark).isNotNull()).groupBy("doc_id").agg(F.avg(mark).alias("mark"))


def held_out(doc_id: str = "doc_id"):
    """Ids whose crc32, taken of the decimal text, is a multiple of 5 are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", mark: str = "quality") -> BradleyTerry | None:
    """The model of all labelled documents outside the held-out fold. Features are measured where the texts lie and meet the labels without them."""
    marks = labelled(labels.where(~held_out()), mark)
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text")).where(F.col("doc_id").isNotNull() & ~held_out())
    measured = map_texts(rows, "text", lambda t: {"x": pa.array(list(features(t)), pa.list_(pa.float64()))}, "x array<double>", ["doc_id"])
    found = materialize(measured.join(marks, "doc_id").select("x", (F.col("mark") >= 0.5).alias("good")), "features")
    model = fit_all(found)
    drop_table(found)
    return model


def quality_scores(docs: DataFrame, model: BradleyTerry | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with ``score``."""

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        return {"score": pa.array(model.scores(features(texts)) if model else np.full(len(texts), 0.5))}

    return map_texts(docs, text, run, "score double", keep)


def op4_quality_ranking(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels"))
    scored = quality_scores(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score reaches the cut, with the columns of docs."""
    model = learn(docs, read(spark, sf_dir, "labels"))
    name = fresh(docs, "__score")
    copied = docs.withColumn(name, F.col("text"))
    scored = map_texts(copied, name, lambda t: {name: pa.array(model.scores(features(t)) if model else np.full(len(t), 0.5))}, f"{name} double", docs.columns)
    return scored.where(F.col(name) >= CUT).select(*[f"`{c}`" for c in docs.columns])
