"""Near-duplicates by SimHash, found with covering locality-sensitive hashing.

A fingerprint bit is set if it is set in over half the hashes of a text's word shingles. For radius r each
bit position gets a vector of r+1 bits, and every non-zero vector a makes a table: its mask holds the
positions whose vector has odd inner product with a. Up to r differing positions span at most r
dimensions, so some a is orthogonal to them all, and that table's mask misses every difference: each
pair within the radius shares a bucket, by construction and not by chance (Pagh, "Locality-sensitive
hashing without false negatives", 2016).

Only distinct fingerprints enter the tables; equal ones are one class. A bucket gives links enough to
connect whatever lies within the radius in it, never all its pairs. A bucket too large for one task's
memory is dealt anew by further covering masks, and, should it still be large, compared block by block.

Defined cases: null or empty text has fingerprint zero and links like any other; a text shorter than a
shingle has its whole word sequence as its only shingle; equal rows share a component; component_id
ignores null ids and is null only if all ids of the component are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flatten_words, fresh, lower_ascii, map_texts, materialize, read, xxh64_many
from .graphs import connected_components

BITS = 64
RADIUS = 3
#: Distinct fingerprints of one bucket that a task compares by itself.
BUCKET_ROWS = 8192
#: Times that larger buckets are dealt anew before they are compared in blocks.
DEALS = 2
_SEED = 42


def fingerprints(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints of the texts, lower-cased in A-Z; zero where there is no word."""
    data, starts, lengths, counts = flatten_words([lower_ascii(x) for x in texts])
    ends = np.cumsum(counts)
    first = ends - counts
    shingles = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    begin = np.cumsum(shingles) - shingles
    which = np.repeat(np.arange(len(texts)), shingles)
    at = np.arange(len(which)) - begin[which] + first[which]
    last = np.minimum(at + shingle, ends[which]) - 1
    hashes = xxh64_many(data, starts[at], starts[last] + lengths[last] - starts[at], _SEED)
    out = np.zeros(len(texts), np.uint64)
    rows = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    for k, n in enumerate(shingles.tolist()):
        if n:
            ones = np.zeros(BITS, np.int64)
            for a in range(int(begin[k]), int(begin[k]) + n, 65536):
                ones += np.unpackbits(rows[a : min(a + 65536, int(begin[k]) + n)], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            out[k] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out


def covering_masks(radius: int = RADIUS, deal: int = 0) -> np.ndarray:
    """The 2^(radius+1) - 1 masks of a deal. Vectors go to positions evenly, in a seeded order."""
    size = 1 << (radius + 1)
    vectors = (np.arange(BITS) % (size - 1)) + 1
    np.random.default_rng(1000 + deal).shuffle(vectors)
    odd = np.array([[bin(int(a) & int(v)).count("1") & 1 for v in vectors] for a in range(1, size)], bool)
    return np.packbits(odd, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def spanning_links(values: np.ndarray, radius: int = RADIUS, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among distinct values (or between them and ``other``) that connect all pairs within the radius; a forest."""
    right = values if other is None else other
    parent = {int(x): int(x) for x in (*values.tolist(), *right.tolist())}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links, left = [], len(parent) - 1
    step = max(1, (1 << 21) // max(1, len(right)))
    for a in range(0, len(values), step):
        part = values[a : a + step]
        tail = right if other is not None else right[a:]
        near = np.bitwise_count(part[:, None] ^ tail[None, :]) <= radius
        for i, j in zip(*np.nonzero(near), strict=True):
            x, y = root(int(part[i])), root(int(tail[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((int(part[i]), int(tail[j])))
                left -= 1
        if left == 0:
            break
    return links


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask_column(value: Column, masks: np.ndarray) -> Column:
    """Array of (table, masked value) for every mask."""
    return F.array(*[F.struct(F.lit(k).alias("t"), value.bitwiseAND(F.lit(_signed(int(m)))).alias("k")) for k, m in enumerate(masks)])


def _links_of_buckets(keyed: DataFrame, radius: int, most: int) -> DataFrame:
    """keyed (b1, b2, fp), fp distinct in its bucket -> (kind, u, v): kind 0 a link, kind 1 a row u of bucket (v, w) too large here.

    Rows come sorted by bucket, so a task holds one bucket of at most ``most`` rows at a time.
    """
    placed = keyed.repartition("b1", "b2").sortWithinPartitions("b1", "b2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        flowing = None  # the bucket whose rows are passed on as too large

        def made(links: list[tuple[int, int]], large: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.array([(_signed(a), _signed(b)) for a, b in links], np.int64).reshape(-1, 2)
            over = [np.concatenate([x[k] for x in large]) if large else np.zeros(0, np.int64) for k in range(3)]
            kind = np.concatenate([np.zeros(len(pairs), np.int32), np.ones(len(over[0]), np.int32)])
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([pairs[:, 0], over[2]])), pa.array(np.concatenate([pairs[:, 1], over[0]])), pa.array(np.concatenate([np.zeros(len(pairs), np.int64), over[1]]))], names=["kind", "u", "v", "w"])

        def finish(rows: list[np.ndarray], ended: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
            """Work off all buckets but, unless ended, the last, which may go on in the next batch."""
            nonlocal flowing
            b1, b2, fp = rows
            links: list[tuple[int, int]] = []
            large: list[np.ndarray] = []
            if len(fp) == 0:
                return made(links, large), rows
            cut = np.flatnonzero((b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])) + 1
            edges = np.concatenate([[0], cut, [len(fp)]])
            size = np.diff(edges)
            keep = 0 if ended else 1
            unsigned = fp.view(np.uint64)
            whole = len(size) - keep
            two = np.flatnonzero(size[:whole] == 2)
            a, b = unsigned[edges[two]], unsigned[edges[two] + 1]
            close = np.bitwise_count(a ^ b) <= radius
            if flowing is not None and len(two) and two[0] == 0 and (b1[0], b2[0]) == flowing:
                close[0] = False
            links += zip(a[close].tolist(), b[close].tolist(), strict=True)
            todo = np.flatnonzero((size[:whole] > 2) | ((np.arange(whole) == 0) & (flowing is not None)))
            for k in todo.tolist():
                s, e = int(edges[k]), int(edges[k + 1])
                if (b1[s], b2[s]) == flowing or e - s > most:
                    large.append(np.stack([b1[s:e], b2[s:e], fp[s:e]]))
                elif e - s > 1:
                    links += spanning_links(unsigned[s:e], radius)
            rest = [x[edges[-2] :] if keep else x[:0] for x in rows]
            if keep and ((b1[-1], b2[-1]) == flowing or len(rest[0]) > most):
                flowing = (b1[-1], b2[-1])
                large.append(np.stack(rest))
                rest = [x[:0] for x in rows]
            return made(links, large), rest

        for batch in batches:
            rows = [np.concatenate([old, new.to_numpy(zero_copy_only=False)]) for old, new in zip(held, batch.columns, strict=True)]
            out, held = finish(rows, False)
            if out.num_rows:
                yield out
        out, _ = finish(held, True)
        if out.num_rows:
            yield out

    return placed.mapInArrow(run, "kind int, u long, v long, w long")


def _links_of_blocks(rows: DataFrame, radius: int, most: int) -> DataFrame:
    """Buckets that stay large: fixed blocks of their rows, each pair of blocks compared in one task."""
    blocks = rows.select("b1", "b2", "fp", F.pmod(F.xxhash64("fp"), F.lit(1 << 20)).alias("place"))
    counts = blocks.groupBy("b1", "b2").agg(F.ceil(F.count(F.lit(1)) / (most // 2)).cast("int").alias("n"))
    dealt = blocks.join(counts, ["b1", "b2"]).withColumn("mine", F.pmod("place", "n").cast("int"))
    sent = dealt.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least(o, "mine").alias("i"), F.greatest(o, "mine").alias("j")))))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        values = group.column("fp").to_numpy().view(np.uint64)
        mine = group.column("mine").to_numpy()
        links = spanning_links(values, radius) if i == j else spanning_links(values[mine == i], radius, values[mine == j])
        pairs = np.array([(_signed(a), _signed(b)) for a, b in links], np.int64).reshape(-1, 2)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return sent.select("b1", "b2", "fp", "mine", F.col("pair.i").alias("i"), F.col("pair.j").alias("j")).groupBy("b1", "b2", "i", "j").applyInArrow(run, "u long, v long")


def near_links(values: DataFrame, radius: int = RADIUS, most: int = BUCKET_ROWS, deals: int = DEALS) -> DataFrame:
    """values (fp long, distinct) -> (u, v): links that connect exactly what chains of pairs within the radius connect."""
    spark = values.sparkSession
    rows = values.select(F.lit(0).cast("long").alias("b0"), "fp")
    found = None
    for deal in range(deals + 1):
        exploded = rows.select("b0", "fp", F.explode(_mask_column(F.col("fp"), covering_masks(radius, deal))).alias("x"))
        keyed = exploded.select(F.xxhash64("b0", "x.t").alias("b1"), F.col("x.k").alias("b2"), "fp")
        out = materialize(_links_of_buckets(keyed, radius, most), "buckets")
        links = out.where("kind = 0").select("u", "v")
        found = links if found is None else found.unionByName(links)
        large = out.where("kind = 1").select(F.col("v").alias("b1"), F.col("w").alias("b2"), F.col("u").alias("fp"))
        if large.isEmpty():
            return found
        rows = large.select(F.xxhash64("b1", "b2").alias("b0"), "fp").distinct()
    return found.unionByName(materialize(_links_of_blocks(large.distinct(), radius, most), "blocks"))


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "__fp", shingle: int = 3) -> DataFrame:
    """docs with the signed 64-bit fingerprint ``name`` of each text."""
    return map_texts(docs, text, lambda texts: {name: pa.array(fingerprints(texts, shingle).view(np.int64))}, f"{name} long", keep)


def components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps (fp long, any number of times) -> (fp, root): each distinct fingerprint with its component's smallest."""
    values = materialize(fps.select("fp").distinct(), "fingerprints")
    stars = connected_components(near_links(values, radius))
    return values.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed) and component_id, the smallest id that links reach."""
    rows = materialize(with_fingerprints(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), keep=["doc_id"]).withColumnRenamed("__fp", "fp"), "simhash")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = materialize(components(rows, radius).join(classes, "fp"), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id (then text, then other columns) stays, with the columns of docs."""
    fp, row, copy = (fresh(docs, name) for name in ("__fp", "__row", "__copy"))
    marked = with_fingerprints(docs.withColumn(copy, F.col("text")), copy, keep=docs.columns, name=fp)
    marked = materialize(marked.withColumn(row, F.monotonically_increasing_id()), "marked")
    others = [f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.xxhash64(*others).alias("o"), F.col(row).alias("r"))
    least = marked.groupBy(F.col(fp).alias("fp")).agg(F.min(place).alias("p"))
    rooted = components(marked.select(F.col(fp).alias("fp")))
    kept = least.join(rooted, "fp").groupBy("root").agg(F.min("p").alias("p")).select(F.col("p.r").alias(row))
    # most rows stay: a shuffle at every size, rather than a broadcast of a table that grows with the documents
    return marked.join(materialize(kept, "kept").hint("merge"), row, "left_semi").select(*[f"`{c}`" for c in docs.columns])
