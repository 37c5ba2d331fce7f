"""Maximum inner product search: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Vectors are cut into subspaces of two components with 16 codewords each. Codewords and codes minimise
|r|^2 + (eta - 1) <r, x>^2 / |x|^2 for the residual r: the part of r along x, which moves inner products
of near queries most, weighs eta times as much (Guo et al., "Accelerating large-scale inference with
anisotropic vector quantization", 2020). A query's tables hold its products with all codewords in eight bits; a
scan adds table entries by code, two four-bit codes at a time, for all queries of a block at once, in integers.

The codes decide what is scored on the original vectors, in double precision: first the best of each block, then
every row whose approximate score, with ``SPREAD`` times the error that codes make, reaches the k-th of these. The
error is measured in each block on evenly spaced rows, relative to the norm of a row's residual. Rows that are left out would
have to be off by more; measured recall on random and on clustered vectors was over 0.999 (tests). ``exact=True`` takes the bound
instead, the query's norm times that of the residual, and finds all.

The codebooks are fitted on at most ``SAMPLE`` vectors; every vector is coded and scanned. Vectors stand in
blocks of bounded rows, queries too, and each pair of blocks is one bounded piece of work.

Defined cases: vectors that are null, zero, of another dimension than most of the sample, or hold null or
non-finite components take no part; rows of the query's own vec_id are its own row; equal vectors tie and
the smaller vec_id wins; a null vec_id takes no part; fewer candidates than k give them all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read

SAMPLE = 16_384
#: Vectors that are coded at once: some 30 KB of products each.
CODED = 1024
BLOCK = 8192
QUERY_BLOCK = 512
#: Candidates of a block that are scored first, for each query; their k-th score rules out others.
RERANK = 128
#: Standard deviations of the codes' error that a row is allowed, and rows of a block on which it is measured.
SPREAD = 3.5
MEASURED = 256
#: Score from which on parallel error should matter; it sets eta.
THRESHOLD = 0.2


class Quantizer:
    """Codebooks of shape (subspaces, 16, 2)."""

    def __init__(self, dim: int, threshold: float = THRESHOLD) -> None:
        self.dim, self.pad = dim, dim + (-dim) % 4
        self.eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        self.books = np.zeros((self.pad // 2, 16, 2))

    def _parts(self, vectors: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(vectors), self.pad))
        padded[:, : self.dim] = vectors
        return padded.reshape(len(vectors), self.pad // 2, 2)

    def codes(self, vectors: np.ndarray, rounds: int = 2) -> np.ndarray:
        """(n, subspaces) codes: nearest codewords first, then coordinate descent on the anisotropic loss; ``CODED`` vectors at once."""
        return np.concatenate([self._codes(vectors[i : i + CODED], rounds) for i in range(0, max(len(vectors), 1), CODED)])

    def _codes(self, vectors: np.ndarray, rounds: int) -> np.ndarray:
        x = self._parts(vectors)
        norm = np.maximum((x**2).sum(axis=(1, 2)), 1e-300)
        distance = ((x[:, :, None, :] - self.books[None]) ** 2).sum(axis=3)
        along = (x**2).sum(axis=2)[:, :, None] - np.einsum("nmd,mcd->nmc", x, self.books)
        code = distance.argmin(axis=2)
        at = np.arange(len(x))
        sums = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0]
        total = sums.sum(axis=1)
        for _ in range(rounds):
            for m in range(x.shape[1]):
                others = total - along[at, m, code[:, m]]
                loss = distance[:, m] + (self.eta - 1) * (others[:, None] + along[:, m]) ** 2 / norm[:, None]
                code[:, m] = loss.argmin(axis=1)
                total = others + along[at, m, code[:, m]]
        return code.astype(np.uint8)

    def fit(self, vectors: np.ndarray, rounds: int = 5, seed: int = 5) -> Quantizer:
        x = self._parts(vectors)
        rng = np.random.default_rng(seed)
        first = rng.choice(len(x), 16, replace=len(x) < 16)
        self.books = np.ascontiguousarray(x[first].transpose(1, 0, 2))
        norm = np.maximum((x**2).sum(axis=(1, 2)), 1e-300)
        for _ in range(rounds):
            code = self.codes(vectors, 1).astype(np.int64)
            for m in range(x.shape[1]):
                chosen = self.books[np.arange(x.shape[1]), code]
                others = ((x - chosen) * x).sum(axis=2)
                own = x[:, m]
                rest = others.sum(axis=1) - others[:, m]
                factor = (self.eta - 1) / norm
                right = own + own * (factor * (rest + (own**2).sum(axis=1)))[:, None]
                n = np.bincount(code[:, m], minlength=16)
                add = lambda v, m=m: np.bincount(code[:, m], v, 16)
                a, b, d = n + add(factor * own[:, 0] ** 2), add(factor * own[:, 0] * own[:, 1]), n + add(factor * own[:, 1] ** 2)
                r0, r1 = add(right[:, 0]), add(right[:, 1])
                det = a * d - b * b
                used = (n > 0) & (det > 1e-12)
                safe = np.where(used, det, 1.0)
                self.books[m, used] = np.stack([(d * r0 - b * r1) / safe, (a * r1 - b * r0) / safe], axis=1)[used]
        return self

    def packed(self, vectors: np.ndarray) -> np.ndarray:
        """Two codes a byte, one row for each pair of subspaces."""
        code = self.codes(vectors)
        return np.ascontiguousarray((code[:, 0::2] | (code[:, 1::2] << 4)).T)

    def reach(self, vectors: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """What a row's score may exceed its approximate one by, for a query of norm 1; rounding of the scan included."""
        code = np.stack([packed & 15, packed >> 4], axis=1).reshape(-1, len(vectors)).T
        made = self.books[np.arange(code.shape[1]), code]
        norm = lambda x: np.sqrt((x**2).sum(axis=(1, 2)))
        return norm(self._parts(vectors) - made) + (len(packed) + 4) * 2.0**-22 * norm(made)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(pairs of subspaces, queries, 256): what each byte of codes adds to a query's score."""
        products = np.einsum("qmd,mcd->mqc", self._parts(queries), self.books)
        low, high = products[0::2], products[1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(low), len(queries), 256).astype(np.float32)


def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate scores (queries, rows)."""
    out = np.zeros((tables.shape[1], packed.shape[1]), np.float32)
    for table, code in zip(tables, packed, strict=True):
        out += np.take(table, code, axis=1)
    return out


def coarse(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tables in eight bits, one query beside the other (pairs, 256, queries), with each query's step and base."""
    low = tables.min(axis=2, keepdims=True)
    step = np.maximum((tables - low).max(axis=(0, 2)), 1e-30) / 255
    return np.ascontiguousarray(np.rint((tables - low) / step[None, :, None]).astype(np.uint8).transpose(0, 2, 1)), step.astype(np.float64), low.sum(axis=(0, 2), dtype=np.float64)


def coarse_scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Sums of table entries (queries, rows), in integers; a row of the table serves all queries."""
    out = np.zeros((packed.shape[1], tables.shape[2]), np.uint16 if len(tables) <= 257 else np.uint32)
    for table, code in zip(tables, packed, strict=True):
        out += table[code]
    return np.ascontiguousarray(out.T)


def _products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Scores row by row in one order of sums, so that equal vectors tie wherever they stand."""
    return np.einsum("nd,d->n", vectors, query)


def best_of_block(quantizer: Quantizer, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, packed: np.ndarray, reach: np.ndarray, k: int, rerank: int, exact: bool = False) -> tuple[list, list, list]:
    """Each query's k best of a block whose rows are in order of id: (query ids, ids, scores)."""
    tables, norms = quantizer.tables(queries), np.linalg.norm(queries, axis=1)
    if exact:
        approx = scan(tables, packed)
        step, base, room = np.ones(len(queries)), np.zeros(len(queries)), norms
    else:
        small, step, base = coarse(tables)
        approx = coarse_scan(small, packed)
        some = np.unique(np.linspace(0, len(ids) - 1, MEASURED).astype(np.int64))
        error = (queries @ vectors[some].T - (base[:, None] + step[:, None] * approx[:, some])) / np.maximum(norms[:, None] * reach[some], 1e-300)
        room = norms * np.maximum(error.mean(axis=1) + SPREAD * error.std(axis=1), 0)
    most = min(max(rerank, k) + 1, len(ids))  # its own row may be among them
    found: tuple[list, list, list] = ([], [], [])
    for q in range(len(query_ids)):
        row = approx[q]
        near = np.argpartition(row, len(row) - most)[len(row) - most :]
        near = near[ids[near] != query_ids[q]]
        scores = _products(vectors[near], queries[q])
        if len(scores) >= k:
            bar = np.partition(scores, len(scores) - k)[len(scores) - k]
            rest = np.flatnonzero(base[q] + step[q] * row + room[q] * reach >= bar)
            rest = rest[ids[rest] != query_ids[q]]
            rest = rest[~np.isin(rest, near, assume_unique=True)]
            near, scores = np.concatenate([near, rest]), np.concatenate([scores, _products(vectors[rest], queries[q])])
        order = np.lexsort((ids[near], -scores))[:k]
        found[0].append(np.full(len(order), query_ids[q]))
        found[1].append(ids[near[order]])
        found[2].append(scores[order])
    return found


def usable(vector: str) -> Column:
    """True for vectors that take part."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & good & F.exists(v, lambda x: x != 0.0), F.lit(False))


def _blocks(rows: DataFrame, size: int, count: int, quantizer: Quantizer | None) -> DataFrame:
    """rows (id, v) -> (ids, vectors, packed, reach): blocks of at most ``size`` rows in order of id, as bytes; of ``count`` partitions one has a block or two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made(table: pa.Table) -> pa.RecordBatch:
            ids = table.column("id").to_numpy()
            v = table.column("v").combine_chunks()
            v = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v)
            vectors = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], vectors[order]
            codes = quantizer.packed(vectors) if quantizer else np.zeros((0, len(ids)), np.uint8)
            reach = quantizer.reach(vectors, codes).astype("<f8").tobytes() if quantizer else b""
            return pa.RecordBatch.from_pydict({"ids": [ids.astype("<i8").tobytes()], "vectors": [vectors.astype("<f8").tobytes()], "packed": [codes.tobytes()], "reach": [reach]})

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(held)
                yield made(table.slice(0, size))
                held, n = table.slice(size).to_batches(), n - size
        if n:
            yield made(pa.Table.from_batches(held))

    return rows.repartition(count).mapInArrow(run, "ids binary, vectors binary, packed binary, reach binary")


def nearest(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, rerank: int = RERANK, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """The k rows of largest inner product for every query row: query_id, rank, vec_id, score.

    is_query: condition on the column ``id``, the row's vec_id. exact: leave out only what the codes prove to be no neighbour.
    """
    spark = rows.sparkSession
    valid = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    picked = [np.array(r["v"]) for r in valid.orderBy(F.xxhash64(F.lit(9), "id"), "id").limit(sample).select("v").toLocalIterator()]
    if not picked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = Counter(map(len, picked)).most_common(1)[0][0]
    quantizer = Quantizer(dim).fit(np.array([v for v in picked if len(v) == dim]))
    del picked
    valid = valid.where(F.size("v") == dim)
    total, asked = valid.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    parts = max(1, -(-total // block))
    blocks = materialize(_blocks(valid, block, parts, quantizer), "vectors")
    queries = _blocks(valid.where(is_query), QUERY_BLOCK, max(1, -(-asked // QUERY_BLOCK)), None).select(F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))
    # every block of queries meets every block of rows: both are read from their files, as copies in a shuffle would grow with rows times queries
    met = blocks.crossJoin(materialize(queries, "queries").hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda name, kind, r=r, batch=batch: np.frombuffer(batch.column(batch.schema.get_field_index(name))[r].as_buffer(), kind)
                ids, qids = cell("ids", "<i8"), cell("qids", "<i8")
                found = best_of_block(quantizer, qids, cell("qvectors", "<f8").reshape(len(qids), dim), ids, cell("vectors", "<f8").reshape(len(ids), dim), cell("packed", np.uint8).reshape(-1, len(ids)), cell("reach", "<f8"), k, rerank, exact)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["query_id", "vec_id", "score"])

    found = met.select("ids", "vectors", "packed", "reach", "qids", "qvectors").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_vector_search(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
