"""Hard negatives, embedding near-duplicates and lexical search against the plainest means."""

import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from idlattice.llm import embedding_dedup, hard_negatives, lexical_search, vector_search

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, label int, score string, u long, part string"


def usable(row, zero):
    i, v, label = row[:3]
    return i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], VECTORS).repartition(5)


ODD = [(None, [1.0] * 8, 1), (900, None, 1), (901, [], 1), (902, [1.0, None] * 4, 1), (903, [NAN] * 8, 1), (904, [INF] * 8, 1), (905, [0.1] * 8, None), (906, [0.0] * 8, 1), (907, [0.3] * 3, 1)]


def clustered(seed, n=400, dim=8):
    """Random rows, a third of them near copies of one vector, some exact copies and repeated ids."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dim)) * rng.choice([0.05, 1.0, 40.0], size=(n, 1))
    vectors[: n // 3] = vectors[0] + 0.02 * np.linalg.norm(vectors[0]) * rng.normal(size=(n // 3, dim))
    vectors[n // 3 : n // 3 + 20] = vectors[n // 3]
    labels = rng.integers(0, 4, n)
    labels[: n // 3][rng.random(n // 3) < 0.8] = 1
    rows = [(int(i), v.tolist(), int(label)) for i, v, label in zip(rng.permutation(n), vectors, labels, strict=True)]
    return [*rows, rows[5], rows[n // 3 + 2], *ODD]


# --- op11 -------------------------------------------------------------------------------------


def negatives(rows, anchors, positives=5, count=3):
    whole = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in (r for r in rows if usable(r, True)) if len(v) == 8]
    asking = {}
    for i, v, label in whole:
        if anchors(i):
            asking[i] = min(asking.get(i, (label, v)), (label, v))
    found = []
    for a, (label, v) in asking.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, w, other in whole if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(i, -t) for t, i, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s][:count]
            found += [(a, p, rank, i, -s, t) for rank, (i, t) in enumerate(inside, 1)]
    return sorted(found)


@pytest.mark.parametrize(("seed", "block"), [(1, 16_384), (2, 60), (3, 17)])
def test_hard_negatives(spark, seed, block):
    rows = clustered(seed)
    found = hard_negatives.hard_negatives(table(spark, rows), F.col("id") % 5 == 0, block=block)
    assert sorted(map(tuple, found.collect())) == negatives(rows, lambda i: i % 5 == 0)


def test_few_vectors_score_exactly(monkeypatch):
    """Bounds hold, and rule out most rows of spread vectors."""
    rng = np.random.default_rng(3)
    vectors = np.floor(rng.normal(size=(4000, 64)) * 32).astype(np.int64)
    codes, low, high = hard_negatives.cells_of(vectors)
    for anchor in (vectors[0], vectors[1] * 1_000_000):
        least, most = hard_negatives.Bounds(anchor, low, high)(codes)
        exact = vectors @ anchor
        assert (least <= exact).all() and (exact <= most).all()
    scored = []
    at, scores = hard_negatives.first_in_window(*hard_negatives.Bounds(vectors[0], low, high)(codes), np.arange(4000), lambda x: scored.append(len(x)) or vectors[x] @ vectors[0], 3, -np.inf, 20_000)
    exact = vectors @ vectors[0]
    order = np.lexsort((np.arange(4000), -np.where(exact <= 20_000, exact, -(10**9))))[:3]
    assert at.tolist() == order.tolist() and scores.tolist() == exact[order].tolist() and sum(scored) < 1000


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(table(spark, ODD[:1]), F.col("id") > 0).count() == 0
    assert hard_negatives.hard_negatives(table(spark, clustered(1)).limit(0), F.col("id") > 0).count() == 0


# --- op12 -------------------------------------------------------------------------------------


def components(rows, cosine=0.93):
    good = [k for k, r in enumerate(rows) if usable(r, False)]
    root, links = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[find(k)].append(r[0])
    answer = [(r[0], links[k], min((i for i in least[find(k)] if i is not None), default=None)) for k, r in enumerate(rows)]
    return sorted(((*x, x[0] is None or x[0] == x[2]) for x in answer), key=str)


@pytest.mark.parametrize(("seed", "piece", "sample"), [(1, 2048, 8192), (2, 25, 8192), (3, 25, 20), (4, 2048, 0)])
def test_embedding_copies(spark, seed, piece, sample):
    rows = clustered(seed)
    found = embedding_dedup.near_duplicates(table(spark, rows), piece=piece, sample=sample)
    assert sorted(map(tuple, found.collect()), key=str) == components(rows)


def test_recall_at_the_threshold():
    """Pairs just within the angle share a filter; random ones mostly don't."""
    rng = np.random.default_rng(5)
    one = embedding_dedup.unit(rng.normal(size=(2000, 64)))
    side = rng.normal(size=one.shape)
    side = embedding_dedup.unit(side - (side * one).sum(axis=1, keepdims=True) * one)
    other = 0.93 * one + math.sqrt(1 - 0.93**2) * side
    threshold, size = embedding_dedup.design(20_000, 0.93)
    lists = [[set(x.tolist()) for x in embedding_dedup.decode(v, threshold, size)] for v in (one, other)]
    shared = [bool(a & b) for a, b in zip(*lists, strict=True)]
    assert np.mean(shared) > 0.99
    assert np.mean([bool(a & b) for a, b in zip(lists[0], lists[1][1:], strict=False)]) < 0.2
    every = [np.concatenate(embedding_dedup.decode(v[:1], threshold, size)) for v in (one, other)]
    rotated = [one[:1] @ embedding_dedup.code(64, size, 0)[0], embedding_dedup.code(64, size, 0)[1:]]
    sums = (rotated[0][:, :32] @ rotated[1][0].T)[0][:, None] + (rotated[0][:, 32:] @ rotated[1][1].T)[0][None]
    assert {x for x in every[0].tolist() if x < size * size} == set(np.flatnonzero(sums.ravel() > threshold).tolist()) | {int(sums.argmax())}


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(table(spark, clustered(1)).limit(0)).count() == 0


# --- op13 -------------------------------------------------------------------------------------

TERM = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def ranked(docs, items, k=20):
    split = [TERM.findall((t or "").translate(UPPER)) for _, t in docs]
    n, total = sum(map(bool, split)), sum(map(len, split))
    held = Counter(t for x in split for t in set(x))
    answer = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(UPPER)))
        scores = []
        for (doc, _), words in zip(docs, split, strict=True):
            tf, m = Counter(words), 75 + (25 * len(words) * n) // total if total else 0
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, times in asked.items() if tf[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        answer += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(answer, key=str)


@pytest.mark.parametrize("group", [200_000, 40])
def test_lexical_search(spark, group):
    rng = np.random.default_rng(4)
    words = ["the", "The", "of", "naïve", "x1", "É", "né", *(f"w{k}" for k in range(60))]
    share = np.r_[[0.1] * 7, [0.3 / 60] * 60]
    text = lambda size: " ".join(rng.choice(words, size=size, p=share / share.sum())) + rng.choice(["", ".", " z", "-the-"])
    docs = [(int(i), text(int(rng.integers(0, 40)))) for i in rng.permutation(150)]
    docs += [docs[3], (None, docs[3][1]), (200, None), (201, ""), (202, ".,;"), (203, "the " * 20_000), (204, "a" * 100_000 + " w1")] + [(300 + k, "w1 w2 the copied text") for k in range(60)]
    items = [(k, text(12)) for k in range(8)] + [(8, None), (9, ""), (10, "unknown"), (None, "w1 w1 w2"), (3, "of of THE"), (3, "of of THE"), (11, " ".join(words) * 3)]
    d = spark.createDataFrame([(*x, "a", 5) for x in docs], "doc_id long, text string, term string, d long").repartition(6)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, q int").repartition(2)
    found = lexical_search.search(d, i, item_terms=group)
    assert sorted(map(tuple, found.collect()), key=str) == ranked(docs, items)


def test_empty_collections(spark):
    d, i = spark.createDataFrame([(1, "one")], "doc_id long, text string"), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical_search.search(d.limit(0), i).count() == 0 == lexical_search.search(d, i.limit(0)).count()
    assert lexical_search.search(d, i.withColumn("text", F.lit("two"))).count() == 0


def test_sums_stay_in_the_reading_task(spark):
    """Between the postings and an item's first documents of each task there is no shuffle."""
    d = spark.createDataFrame([(k, f"one two w{k % 7}") for k in range(50)], "doc_id long, text string")
    plan = lexical_search.search(d, spark.createDataFrame([(1, "one w3")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning")[1]
    assert below.count("Exchange hashpartitioning") == 0 and "Bucketed: true" in below and "WindowGroupLimit" in below


# --- op8 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("exact", [False, True])
def test_codes_decide(spark, exact):
    """Several blocks, a third near copies: few rows are scored, recall is measured; exact finds all."""
    rng = np.random.default_rng(8)
    data = embedding_dedup.unit(rng.normal(size=(6000, 64)))
    data[::3] = data[0] + rng.normal(size=(2000, 64)) * 0.05 / 8
    out = vector_search.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>"), F.col("id") % 100 == 0, block=1500, exact=exact).collect()
    hits = 0
    for q in range(0, 6000, 100):
        scores = data @ data[q]
        scores[q] = -np.inf
        hits += len({r.vec_id for r in out if r.query_id == q} & set(np.lexsort((np.arange(6000), -scores))[:20].tolist()))
    assert hits == 60 * 20 if exact else hits >= 0.99 * 60 * 20


def test_codebooks_are_fitted_in_slices():
    """The driver holds the products of a slice of the sample, not of all of it."""
    data = embedding_dedup.unit(np.random.default_rng(11).normal(size=(8192, 64)))
    tracemalloc.start()
    books = vector_search.Quantizer(64).fit(data, rounds=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50e6
    assert np.array_equal(books.codes(data[:3000]), books._codes(data[:3000], 2)) and books.codes(data[:0]).shape == (0, 32)


def test_queries_meet_blocks_without_copies(spark):
    """Blocks of queries are read beside each block of rows; no shuffle holds a copy of them for each."""
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(12).normal(size=(900, 8)))]
    plan = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, block=200)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "CartesianProduct" in plan and "Generate" not in plan


def test_few_rows_are_scored(monkeypatch):
    rng = np.random.default_rng(9)
    data = embedding_dedup.unit(rng.normal(size=(8192, 64)))
    own, scored, products = vector_search.Quantizer(64).fit(data[:4000]), [], vector_search._products
    monkeypatch.setattr(vector_search, "_products", lambda v, q: scored.append(len(v)) or products(v, q))
    packed, ids = own.packed(data), np.arange(8192)
    found = vector_search.best_of_block(own, ids[:50], data[:50], ids, data, packed, own.reach(data, packed), 20, 128)
    assert sum(scored) < 0.12 * 50 * 8192
    exact = data[:50] @ data.T
    exact[ids[:50], ids[:50]] = -np.inf
    assert np.mean([len(set(found[1][q].tolist()) & set(np.argsort(-exact[q])[:20].tolist())) for q in range(50)]) >= 19.8
