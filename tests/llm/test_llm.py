"""Operators of the llm subpackage against brute force, on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from idlattice.llm import bpe, html_pages, licenses, mixing, quality_model, quality_rules, simhash, substrings, token_files, vector_search
from idlattice.llm.common import flatten_words, xxh64_many
from idlattice.llm.graphs import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(5)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30, 90))) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mñ"]) for _ in range(rng.randrange(0, 60))) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(1, rng.choice(shared))
        if rng.random() < 0.1:
            parts = ["x"] * rng.randrange(30, 80)
        rows.append((i, rng.choice([" ", "\n"]).join(parts) if rng.random() > 0.05 else rng.choice([None, "", "  \n\t"]), "en", rng.choice(["a", "b", "c", None]), 1))
    rows += [(1000 + i, rows[i][1], "en", "hot", 1) for i in range(40)] + [(2000 + i, rows[5][1], "en", "hot", None) for i in range(30)]
    rows += [(7, rows[7][1], "en", "a", 1), (None, "a null id with words", None, None, None), (9000, "long " * 5000 + "end", "en", "hot", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumn("Score", F.lit("mine")).withColumn("key", F.lit(1)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return (t or "").encode().split()


def test_xxh64():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    at = np.array([rng.randrange(4000) for _ in range(3000)])
    size = np.array([rng.choice([0, 1, 3, 4, 7, 8, 31, 32, 33, 40, 200]) for _ in range(3000)])
    assert xxh64_many(data, at, size).tolist() == [xxhash.xxh64_intdigest(data[a : a + n], 42) for a, n in zip(at, size, strict=True)]
    assert flatten_words([b"", b" a  bc\n", b""])[3].tolist() == [0, 2, 0]


def test_licenses(docs, empty, spark):
    got = licenses.scan_text(b"x CC-BY y. Under the GNU General Public License; cc by. All\nRights--Reserved")
    assert got["base_labels"] == ["cc-by", "gpl", "reserved"] and len(got["places"]) == 4 and [p[0] for p in got["places"]][0] == 1
    got = licenses.scan_text("// SPDX-License-Identifier: (MIT OR GPL-2.0+) AND Apache-2.0 é\n".encode())
    assert [e[:2] for e in got["expressions"]] == [("( MIT OR GPL-2.0+ ) AND Apache-2.0", 2)] and {"mit", "apache-2.0"} <= set(got["labels"])
    assert licenses.parse_expression("MIT OR") is None and licenses.parse_expression("a OR b AND c") == ["a", "b", "c", "and", "or"]
    assert licenses.scan_text(b"")["score"] == 0.0
    out = licenses.license_scan(docs).collect()
    assert len(out) == docs.count() and {"Score", "key"} & set(docs.columns)
    assert licenses.license_scan(empty).count() == 0


def test_quality_rules(docs, empty):
    def brute(t):
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        return len(w), sum(len(x.decode()) for x in w), sum(map((t or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(hit), failed

    for r in quality_rules.quality_rules(docs.withColumn("t2", F.col("text")), "t2").collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute(r.t2)
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(empty).count() == 0


def test_noise_is_outside_the_bands(spark):
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    limits = quality_rules.learn_limits(table("documents"), table("labels"))
    rng, packer = random.Random(8), quality_rules.zstandard.ZstdCompressor(level=quality_rules.LEVEL)

    def noise(signs, size):
        return " ".join("".join(rng.choices(signs, k=rng.randrange(3, 10))) for _ in range(size))[:size].encode()

    accepted = lambda text: quality_rules.compression_verdict(text, packer, limits)[3]
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    for size in (1000, 2000, 4000, 8000, 20000):
        assert not accepted(noise(letters + letters.upper() + digits + "+/", size)) and not accepted(noise(letters + digits, size))
        assert size < 2000 or not accepted(noise(letters, size))
        assert size < 4000 or not accepted(noise(digits + "abcdef", size))
    vocabulary = [noise(letters, 40).split()[0] for _ in range(400)]
    good = b" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(400)], k=5000))
    assert all(accepted(good[:size]) for size in (4096, 5000, 8191, 16384, 20000))
    assert not accepted(good[:8192] + noise(letters + digits, 1000)) and not accepted(good[:4096] + noise(letters + digits, 4096))


def test_substrings(docs, empty):
    counts = Counter()
    for r in docs.collect():
        w = words(r.text)
        counts.update(b" ".join(w[k : k + 35]) for k in range(len(w) - 34))

    def brute(t):
        w = words(t)
        gone = {k + j for k in range(len(w) - 34) if counts[b" ".join(w[k : k + 35])] > 1 for j in range(35)}
        return len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()

    out = substrings.remove_repeats(docs.withColumn("t2", F.col("text")), "t2").collect()
    assert len(out) == docs.count()
    assert all((r.n_words, r.n_removed, r.kept_text) == brute(r.t2) for r in out)
    assert substrings.remove_repeats(empty).count() == 0
    assert substrings.levels(35) == [18, 35] and substrings.levels(100) == [13, 25, 50, 100]


def _truth(values):
    ids = list(range(len(values)))

    def root(x):
        while ids[x] != x:
            x = ids[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 3:
                a, b = root(i), root(j)
                ids[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_simhash(docs, empty):
    def fingerprint(t):
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    out = simhash.near_duplicates(docs).collect()
    rows = docs.collect()
    values = [fingerprint(r.text) for r in rows]
    assert Counter(r.fp % (1 << 64) for r in out) == Counter(values)
    root, least = _truth(values), {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[root[k]] = min(least.get(root[k], r.doc_id), r.doc_id)
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter((r.doc_id, least.get(root[k])) for k, r in enumerate(rows))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.simhash_stage(docs.sparkSession, docs, "")
    assert kept.columns == docs.columns and kept.count() == len(set(root))


def test_covering_masks_and_large_buckets(spark):
    masks, rng = simhash.covering_masks(), random.Random(2)
    for _ in range(2000):
        difference = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(int(m) & difference == 0 for m in masks)
    values = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for base in (rng.getrandbits(64) for _ in range(3)) for _ in range(40)})
    root = _truth(values)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    star = dict(tuple(r) for r in connected_components(simhash.near_links(df, most=6, deals=0)).collect())
    mine = [star.get(simhash._signed(v), simhash._signed(v)) for v in values]
    assert len({*zip(mine, root, strict=True)}) == len({*mine}) == len({*root})


def test_quality_model(spark, empty):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        good = rng.random() < 0.8
        rows.append((i, " ".join((rng.choice(["plain", "words", "here", "again"]) if good else rng.choice(["BUY!!", "###", "NOW!!", "$$$"])) for _ in range(60)), "en", "s", 1))
        marks.append((i, int(good), 0))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*marks, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.learn(docs, labels)
    out = {r.doc_id: r.score for r in quality_model.quality_scores(docs, model).collect()}
    held = [m for m in marks if zlib.crc32(str(m[0]).encode()) % 5 == 0]
    assert sum((out[i] >= 0.3) == bool(q) for i, q, _ in held) >= 0.97 * len(held) and all(0 <= s <= 1 for s in out.values())
    assert quality_model.learn(empty, labels.limit(0)) is None
    assert quality_model.quality_scores(spark.createDataFrame([(1, None, None, None, None)], DOCS), model).count() == 1


def test_bpe(docs, empty):
    files = bpe.default_tokenizer()
    own = bpe.codec(*files)
    ranks = {t: k for k, t in enumerate(own.tokens) if t}
    encoding = tiktoken.Encoding("t", pat_str=files[1], mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    signs = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "a", "B", "é", "1", "½", "!", "-", "\xa0", "中", "́", "😀", "\r\n", "\x85", "\x1c", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(0, 25)))
        starts, _at = bpe.piece_starts(text)
        assert [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=False)] == regex.findall(files[1], text)
    for r in bpe.decode_documents(bpe.encode_documents(docs)).collect():
        assert r.ids == encoding.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.offsets[-1] == len(r.decoded)
    for r in bpe.round_trip(docs).collect():
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.round_trip(empty).count() == 0


def test_token_files(docs, empty, spark, tmp_path):
    path = f"{tmp_path}/ids"
    token_files.write_token_files(docs, path)
    own = token_files.encoder(token_files.default_tokenizer()).tokenizer
    files = token_files.read_token_files(spark, path)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.ids == [*own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1] for r in files.collect())
    index = sorted(token_files.token_index(files).collect(), key=lambda r: r.start)
    assert [r.start for r in index] == np.cumsum([0, *[r.n_tokens for r in index]])[:-1].tolist()
    ids = [r.doc_id for r in index]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    packed = np.array([*own.encode(texts[5] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert {r.ids_crc32 for r in index if r.doc_id == 5} == {zlib.crc32(packed)}
    token_files.write_token_files(empty, f"{path}0")
    assert token_files.read_token_files(spark, f"{path}0").count() == 0


def test_mixing(docs, empty):
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long"))
    out = mixing.mix(sized, "size").collect()
    again = mixing.mix(sized, "size").collect()
    key = lambda r: (r.doc_id, r.text, r.__taken if False else r["__taken"])
    assert Counter(map(key, out)) == Counter(map(key, again)) and len(out) == docs.count()
    sizes = Counter()
    for r in out:
        sizes[r.source] += r.size
        assert r["__taken"] % max(1, r.size) == 0 and r["__taken"] <= 3 * r.size
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    for r in out:
        assert abs(r["__target"] - target[r.source]) < 1e-6 and r["__source_size"] == sizes[r.source]
    taken = Counter()
    for r in out:
        taken[r.source] += r["__taken"]
    assert sum(taken.values()) <= total and all(abs(taken[s] - target[s]) <= max(r.size for r in out) for s in names)
    assert mixing.mix(empty.withColumn("size", F.lit(0).cast("long")), "size").count() == 0


def test_html(spark):
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a>x</a></nav><div class="cookie-notice">c</div><article><h1>Head &amp; one</h1><p><b>First \n part.<br><p>Second<div class="ad">buy</div></article><div id=comments><p>nice</p></div><footer>&copy;</footer>'
    assert html_pages.main_text(page) == "Head & one\n\nFirst part.\n\nSecond"
    assert html_pages.main_text("") == "" and html_pages.main_text("5 < 6 <p>a<i>b</i>c") == "5 < 6\n\nabc"
    frame = "<body><div class=box>same words</div><div class=body><p>page {0} text {0}</p></div></body>"
    rows = [(i, f"http://Host.example/{i}", frame.format(i)) for i in range(20)] + [(50, None, None), (51, "http://other.example/", frame.format(1)), (51, "http://other.example/", frame.format(1))]
    out = {r.page_id: r.text for r in html_pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "page 3 text 3" and out[50] == "" and out[51] == "page 1 text 1"  # a small host is judged by its places elsewhere
    assert html_pages.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_tree_decides_in_articles(spark):
    frame = "<body><article><h1>Title {0}</h1><div class=entry>" + "<p>part {0}</p>" * 20 + "</div><div class=box><p>same</p><p>words</p></div></article></body>"
    rows = [(i, "http://host.example/", frame.format(i)) for i in range(20)]
    out = {r.page_id: r.text for r in html_pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == "\n\n".join([f"Title {i}", *[f"part {i}"] * 20]) for i in range(20))
    bare = [(i, "http://host.example/", "<main>all alike</main>") for i in range(20)]
    assert {r.text for r in html_pages.extract_text(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()} == {"all alike"}


def test_html_tree_of_small_hosts_and_deep_places(spark):
    frame = "<body><div class=box>words of {1}</div><div class=body><p>page {0}</p></div></body>"
    deep = "<div>" * 20 + "<div class=box>same</div><div class=body>page {0}</div>" + "</div>" * 20
    rows = [(i, f"http://small{i // 4}.example/", frame.format(i, i // 4)) for i in range(16)] + [(100 + i, "http://deep.example/", deep.format(i)) for i in range(20)]
    out = {r.page_id: r.text for r in html_pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"page {i}" for i in range(16)) and all(out[100 + i] == f"page {i}" for i in range(20))


def test_vectors(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(400, 10))
    data[50:80] = data[50]
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(900, None), (901, [0.0] * 10), (902, [float("nan")] + [1.0] * 9), (903, [None] + [1.0] * 9), (904, [1.0, 2.0]), (None, [1.0] * 10)]
    out = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=20, block=150).collect()
    found = hits = 0
    for q in range(0, 400, 20):
        exact = data @ data[q]
        exact[q] = -np.inf
        best = np.lexsort((np.arange(400), -exact))[:20].tolist()
        mine = [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)]
        assert len(mine) == 20
        hits, found = hits + len(set(mine) & set(best)), found + 20
    assert hits >= 0.9 * found
    assert vector_search.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_vectors_of_a_near_copy_group(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(6000, 64))
    data /= np.linalg.norm(data, axis=1)[:, None]
    data[::3] = data[0] + rng.normal(size=(2000, 64)) * 0.05 / 8
    out = vector_search.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>"), F.col("id") % 300 == 0, rerank=32, block=3000).collect()
    for q in range(0, 6000, 300):
        exact = data @ data[q]
        exact[q] = -np.inf
        assert [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == np.lexsort((np.arange(6000), -exact))[:20].tolist()


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
