"""Whole results of the operators and of every pipeline stage against brute force; odd tables and columns."""

import math
import random
import time
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from test_llm import DOCS, corpus

from idlattice.llm import bpe, html_pages, licenses, mixing, quality_model, quality_rules, simhash, substrings, token_files, vector_search

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    """Every column name that an operator might use for itself."""
    names = ["__text", "__whole", "__html", "__host", "__low", "__bf", "__bp", "__copy_of_text", "__place", "__fp", "__row", "__copy", "__taken", "__size", "__k1", "__k2", "__score", "__own_0", "k1", "k2", "KEY", "n_words", "n_removed", "kept_text", "score", "size", "ids", "turn", "fp", "root"]
    return docs.limit(40).withColumns({c: F.lit(k) for k, c in enumerate(names)}).cache()


# --- columns ----------------------------------------------------------------------------------


@pytest.mark.parametrize("stage", [quality_model.quality_stage, simhash.simhash_stage, substrings.substring_stage, mixing.mix_stage])
def test_stages_keep_all_columns(spark, clashing, stage):
    out = stage(spark, clashing, SMALL)
    assert out.columns == clashing.columns and out.dtypes == clashing.dtypes
    rows = out.collect()
    assert rows and all(r["n_words"] == clashing.first()["n_words"] and r["__taken"] == clashing.first()["__taken"] for r in rows)


@pytest.mark.parametrize("stage", [quality_model.quality_stage, simhash.simhash_stage, substrings.substring_stage, mixing.mix_stage, bpe.bpe_stage])
def test_stages_of_an_empty_table(spark, docs, stage):
    assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_operators_take_any_columns(clashing):
    n = clashing.count()
    for made in (licenses.license_scan(clashing), quality_rules.quality_rules(clashing), bpe.round_trip(clashing), substrings.remove_repeats(clashing), mixing.mix(clashing.withColumn("len", F.length("lang").cast("long")), "len")):
        assert made.count() == n and len(set(made.columns)) == len(made.columns)
    pages = clashing.select("*", F.col("doc_id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.col("text").alias("html")).drop("text")
    assert html_pages.extract_text(pages).count() == n


# --- op1, op2 ---------------------------------------------------------------------------------


def test_licence_places(spark, docs):
    extra = ["cc by cc-by CC_BY ccby", "All Rights  RESERVED. all rights, reserved", "general public license general public license", "ccé by", "All rights" + " x" * 3000 + " all rights reserved", None, "", "rights reserved cc", "ALL-RIGHTS\nRESERVED"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(extra)], "doc_id long, text string").unionByName(docs.select("doc_id", "text")).unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    for r in licenses.license_scan(rows).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.base_scan(r.text)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_licence_expressions():
    def labels(text):
        return licenses.scan_text(text.encode())["labels"]

    assert labels("the SPDX-License-Identifier tag is explained") == []
    assert labels("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0") == ["gpl-2.0"]
    assert labels("// SPDX-License-Identifier: (MIT OR\n// Apache-2.0) AND\n//   BSD-3-Clause\n// other words") == ["apache-2.0", "bsd-3-clause", "mit"]
    assert labels("# SPDX-License-Identifier: MIT\n# OR ISC\nand GPL-3.0") == ["isc", "mit"]
    assert labels("SPDX-License-Identifier: MIT and some prose") == ["mit"] and labels("SPDX-License-Identifier: MIT and ISC") == ["isc", "mit"]
    assert labels("SPDX-License-Identifier:\nMIT") == [] and labels("SPDX-License-Identifier: MIT OR") == []
    assert licenses.scan_text(b"SPDX-License-Identifier: (MIT")["expressions"][0][1] is None
    assert licenses.evaluate(licenses.parse_expression("MIT OR CC-BY-NC-4.0")) == 2 and licenses.evaluate(licenses.parse_expression("MIT AND CC-BY-NC-4.0")) == 0


def test_quality_verdicts(docs):
    packer = zstandard.ZstdCompressor(level=3)
    limits = quality_rules.Limits(np.array([9.0, 11.0, 13.0]), np.array([0.30, 0.24, 0.20]), np.array([0.66, 0.52, 0.45]))

    def within(part):
        x = min(max(math.log2(len(part)), 9), 13)
        k = 0 if x < 11 else 1
        low, high = (v[k] + (v[k + 1] - v[k]) * (x - (9, 11)[k]) / 2 for v in ((0.30, 0.24, 0.20), (0.66, 0.52, 0.45)))
        return low - 1e-12 <= len(packer.compress(part)) / len(part) <= high + 1e-12

    def kept(text):
        raw = text.encode()
        parts = [raw[k : k + 4096] for k in range(0, len(raw), 4096)]
        checks = [within(p) for p in parts if len(p) == 4096]
        if checks and len(parts[-1]) < 4096:
            checks.append(within(raw[-max(len(parts[-1]), 1024) :]))
        return within(raw) and 4 * checks.count(False) <= len(checks)

    source = docs.select("doc_id", "text").unionByName(docs.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    verdicts = Counter()
    for r in quality_rules.quality_rules(source, limits=limits).collect():
        assert r.kept == (not r.base_failed and kept(r.text or " "))
        verdicts[r.kept, r.base_failed] += 1
    assert verdicts[True, False] > 100 and verdicts[False, True] > 10 and verdicts[False, False] > 0
    assert all(r.kept != r.base_failed for r in quality_rules.quality_rules(source).collect())  # without limits the counts alone decide


def test_limits_follow_the_labels(spark):
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    texts, labels = table("documents"), table("labels")
    limits = quality_rules.learn_limits(texts, labels)
    turned = quality_rules.learn_limits(texts, labels.withColumn("quality", 1 - F.col("quality")))
    at = [limits.of(n) for n in (400, 1000, 4096, 12000)]
    assert all(0 < low < high for low, high in at) and at[0][1] > at[1][1] > max(at[2][1], at[3][1])  # short texts pack less
    assert turned.of(1000)[0] < 0.9 * limits.of(1000)[0]  # texts marked bad pack further, so calling them good lowers the floor
    marks = {r.doc_id: r.quality for r in labels.where(quality_rules.held_out()).collect()}
    judged = [(marks[r.doc_id], r.kept) for r in quality_rules.quality_rules(texts, limits=limits).collect() if r.doc_id in marks and not r.base_failed]
    good = [kept for mark, kept in judged if mark == 1]
    assert sum(good) >= 0.98 * len(good) > 0
    # held-out labels, null ids and null marks change nothing; without a good label there is no limit
    more = labels.unionByName(labels.where(quality_rules.held_out()).withColumn("quality", F.lit(0).cast("long")), True).unionByName(labels.limit(1).select(F.lit(None).cast("long").alias("doc_id"), "quality"), True)
    again = quality_rules.learn_limits(texts, more)
    assert np.array_equal(again.highest, limits.highest) and np.array_equal(again.lowest, limits.lowest)
    assert quality_rules.learn_limits(texts, labels.where("false")) is None and quality_rules.learn_limits(texts.where("false"), labels) is None
    assert quality_rules.fit_limits(np.array([100]), np.array([0.5])).of(5000) == (0.25, 0.5)


# --- op3 --------------------------------------------------------------------------------------


def test_removed_words_of_other_windows(spark, docs):
    for window in (8, 20, 50):
        out = substrings.remove_repeats(docs.select("doc_id", F.col("text").alias("Body")), "Body", window).collect()
        want = dict(zip((r.Body for r in out), brute.removed([r.Body for r in out], window), strict=True))
        assert all((r.n_words, r.n_removed, r.kept_text) == want[r.Body] for r in out)


def test_search_ends_without_repeats(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(80))) for i in range(10)], "doc_id long, text string")
    assert substrings.repeated_texts(rows).count() == 0
    assert {(r.n_words, r.n_removed) for r in substrings.remove_repeats(rows).collect()} == {(80, 0)}


def test_answers_do_not_grow_with_tasks(spark):
    text = " ".join(f"w{k}" for k in range(100))
    other = "before " + text + " behind"
    rows = spark.createDataFrame([(i, text if i % 4 else other + f" {i}") for i in range(400)], "doc_id long, text string")
    for parts in (4, 16):
        whole = rows.repartition(parts).select(*substrings.keys_of(F.col("text"), 35), "text")
        answers = substrings._repeated(substrings._ask_parts(whole, 18, 35)).groupBy("k1", "k2").agg(F.collect_set("ha").alias("hs"))
        assert answers.agg(F.max(F.size("hs"))).first()[0] <= 66
        out = {(r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(rows.repartition(parts)).collect()}
        assert out == set(brute.removed([r.text for r in rows.collect()]))


# --- op4 --------------------------------------------------------------------------------------


def test_ranking_weights_are_the_best():
    """Plain gradient descent on the pairs' loss finds no better weights."""
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(300, 5))
    marks = (rows @ [1.0, -2.0, 0.5, 0.0, 0.0] + rng.normal(size=300) > 0).astype(float)
    model = quality_model.fit(rows, marks, pairs=2000)
    good, bad = np.flatnonzero(marks >= 0.5), np.flatnonzero(marks < 0.5)
    draw = np.random.default_rng(11)
    x = np.clip((rows - model.centre) / model.scale, -8, 8)
    d = x[draw.choice(good, 2000)] - x[draw.choice(bad, 2000)]

    def loss(w):
        return np.logaddexp(0, -d @ w).sum() + quality_model.RIDGE / 2 * w @ w

    w = np.zeros(5)
    for _ in range(4000):
        w += 0.002 * ((d * (1 / (1 + np.exp(d @ w)))[:, None]).sum(axis=0) - quality_model.RIDGE * w) / 2
    assert loss(model.weights) <= loss(w) + 1e-6 and np.allclose(model.weights, w, atol=1e-3)
    assert abs((model.scores(rows) < 0.3).mean() - len(bad) / 300) < 0.01


def test_fit_ignores_the_order_of_rows(spark, docs):
    marked = docs.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    a, b = (quality_model.learn(d, marked) for d in (docs.orderBy("text"), docs.repartition(5)))
    assert np.allclose(a.weights, b.weights)


# --- op5 --------------------------------------------------------------------------------------


def test_importance_of_places(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        box = rng.choice(["<div class=box>same</div>", "<div class=box>same <b>bold</b></div>", "<div class='box'>other</div>"])
        inner = "".join(f"<p>{rng.randrange(10**6)}</p>" for _ in range(rng.randrange(1, 5)))
        shell = rng.choice(["<article>{0}{1}</article><footer>f</footer>", "<div id=x{2}>{0}</div>{1}<nav>menu {2}</nav>", "<section class='related-work'>{0}</section>{1}"])
        rows.append((f"h{min(rng.randrange(12), 5)}.example", shell.format(inner, box, k)))
    pages = []
    for host, html in rows:
        read = html_pages.Page(html)
        pages.append((host, [(*read.place(node), "|".join(node.children), html_pages._clean(raw)) for block in read.blocks for node, raw in block if raw.strip()]))
    want = brute.style_tree(pages, html_pages.BLEND, html_pages.FLOOR)
    low = defaultdict(set)
    for (host, place), x in want.items():
        if x < html_pages.LOWEST:
            low[host].add(html_pages._signed(place))
    frame = spark.createDataFrame([(i, f"https://{host}/p", html) for i, (host, html) in enumerate(rows)], "page_id long, url string, html string")
    assert {r.host: set(r.low) for r in html_pages.low_places(frame).collect()} == low
    assert any(x < 0.2 for x in want.values()) and any(x > 0.8 for x in want.values())
    for r in html_pages.extract_text(frame).collect():
        assert r.text == html_pages.main_text(rows[r.page_id][1], low[rows[r.page_id][0]])


def test_names_do_not_decide_in_articles():
    text = html_pages.main_text("<article><section class='related-work'><p>a</p></section><p id='notice-1'>b</p><p class='search-results'>c</p><p data-x=it's>d</p><div class='ad'>e</div></article>")
    assert text == "a\n\nb\n\nc\n\nd"
    assert html_pages.main_text("<p>one <span class=ad>buy</span> two</p>") == "one two" and html_pages.main_text("a<br>b &lt;c&gt; <x") == "a b <c>"


def test_headings_that_articles_share_stay(spark):
    frame = "<article><h1>Title {0}</h1><h2>Summary</h2><p>text {0}</p><h2><a href=x>More</a></h2><p>more {0}</p><h2 class=ad>Buy</h2><p class=box>all alike</p></article>"
    rows = [(i, "http://host.example/", frame.format(i)) for i in range(30)]
    for r in html_pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == "\n\n".join([f"Title {r.page_id}", "Summary", f"text {r.page_id}", "More", f"more {r.page_id}"])


def test_the_tree_decides(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    out = html_pages.op5_html_text(spark, SMALL).collect()
    assert len(out) == len(html) and all(html_pages.main_text(html[r.page_id], set()) != r.text for r in out)


@pytest.mark.parametrize("part", ["<div>", "<a ", "</script ", '<a ="> " ', "<p>a", "<![CDATA[", "<ul><li>a", "<!-- ", "&lt;a "])
def test_hostile_pages_take_linear_time(part):
    def seconds(n):
        page, began = "<script>" * part.startswith("</s") + part * n, time.perf_counter()
        html_pages.main_text(page)
        return time.perf_counter() - began

    assert seconds(40_000) < 6 * seconds(20_000) + 0.2


# --- op6 --------------------------------------------------------------------------------------


def test_token_digests(docs):
    files = bpe.default_tokenizer()
    own = brute.encoding(files)
    odd = ["", None, "'", " ", "  ", "a'", "'s", "b \n", " c", " ", "it's  中文1½!? ", "'ll'", "x" * 3000]
    frame = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(odd * 3)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    for r in bpe.round_trip(frame.coalesce(1)).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == brute.token_digests(own, r.text)
    with pytest.raises(ValueError):
        bpe.BpeCodec(files[0], r"\S+")
    assert [bytes(r.decoded) for r in bpe.decode_documents(frame.limit(2).select(F.array(F.lit(-1), F.lit(None).cast("int"), F.lit(10**6)).alias("ids"))).collect()] == [b"", b""]


def test_breaks_between_texts():
    rng = random.Random(9)
    signs = ["'", "s", "re", " ", "  ", "\n", "a", "é", "1", "!", " ", "", "\U0001f600"]
    own, plain = bpe.codec(*bpe.default_tokenizer()), brute.encoding(bpe.default_tokenizer())
    for _ in range(300):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(8))) for _ in range(rng.randrange(1, 12))]
        ids, begin = own.encode([x.encode() for x in texts])
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == [plain.encode_ordinary(x) for x in texts]


# --- op8 --------------------------------------------------------------------------------------


def test_codes_rank_well():
    """The quantiser alone: true neighbours among the best codes, and less parallel error than nearest codewords leave."""
    rng = np.random.default_rng(3)
    data = rng.normal(size=(4000, 64))
    data /= np.linalg.norm(data, axis=1)[:, None]
    own = vector_search.Quantizer(64).fit(data[:2000])
    approx = vector_search.scan(own.tables(data[:40]), own.packed(data))
    hits = sum(len(set(np.argsort(-approx[q])[:128]) & set(np.argsort(-(data @ data[q]))[:20])) for q in range(40))
    assert hits >= 0.9 * 800

    def parallel(codes):
        made = own.books[np.arange(32), codes.astype(int)].reshape(len(data), 64)
        return np.abs(((data - made) * data).sum(axis=1)).mean()

    nearest = ((data.reshape(-1, 32, 1, 2) - own.books[None]) ** 2).sum(axis=3).argmin(axis=2)
    assert parallel(own.codes(data)) < 0.8 * parallel(nearest)
    assert (np.abs(approx - data[:40] @ data.T) <= own.reach(data, own.packed(data)) + 1e-6).all()


# --- op9 --------------------------------------------------------------------------------------


def test_orc_indexes(spark, docs, tmp_path):
    path = f"{tmp_path}/ids"
    token_files.write_token_files(spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text")).unionByName(docs.select("doc_id", "text")), path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    orc, files = jvm.org.apache.orc.OrcFile, [f"{path}/{f.name}" for f in __import__("pathlib").Path(path).glob("*.orc")]
    assert files
    groups = 0
    for file in files:
        reader = orc.createReader(jvm.org.apache.hadoop.fs.Path(file), orc.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000 and reader.getCompressionKind().toString() == "ZSTD"
        wanted = spark.sparkContext._gateway.new_array(jvm.boolean, 5)
        wanted[1] = True
        index = reader.rows().readRowIndex(0, wanted, wanted)
        groups += index.getRowGroupIndex()[1].getEntryCount()
        assert index.getBloomFilterIndex()[1].getBloomFilterCount() == index.getRowGroupIndex()[1].getEntryCount()
    assert groups > 4
    found = token_files.read_token_files(spark, path).where("doc_id = 3999")
    assert found.count() == 1 and "doc_id,3999" in found._jdf.queryExecution().executedPlan().toString().replace(" ", "")


def test_words_that_the_model_merges_fall_back(monkeypatch):
    own = token_files.WordEncoder(token_files.default_tokenizer())
    want = own.encode([b"plain words, here"])
    fresh = token_files.WordEncoder(token_files.default_tokenizer())
    fresh.ends = np.ones_like(fresh.ends)  # as if every token ended a pre-token
    assert fresh.encode([b"plain words, here"]) == want
    fresh.encode([b"y" * 1000])
    assert max(map(len, fresh.words)) <= 64


# --- op10 -------------------------------------------------------------------------------------


def _placed(frame, keys, seed=7):
    return frame.withColumns({"a": F.xxhash64(F.lit(seed), *keys), "b": F.xxhash64(F.lit(seed + 1), *keys)})


def test_exact_prefix_of_the_queue(spark, docs):
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long"))
    rows = _placed(sized, ["doc_id", "text"]).collect()
    taken = brute.mixed([(r.source, r.size, (r.a, r.b)) for r in rows])
    out = mixing.mix(sized, "size", "source", ["doc_id", "text"]).collect()
    assert Counter((r.doc_id, r.text, r["__taken"]) for r in out) == Counter((r.doc_id, r.text, t * r.size) for r, t in zip(rows, taken, strict=True))


def test_many_sources(spark):
    rng = random.Random(6)
    rows = [(i, f"s{rng.randrange(500)}", rng.choice([1, 2, 5, 100])) for i in range(3000)] + [(9999, None, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    _, target = brute.targets(sizes)
    out = mixing.mix(frame, "size", "source", ["doc_id"]).collect()
    assert len(out) == len(rows) and all(r["__source_size"] == sizes[r.source] and abs(r["__target"] - target[r.source]) < 1e-6 for r in out)


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality_model.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = [r for r in docs.collect() if model.scores(quality_model.features([(r.text or "").encode()]))[0] >= 0.3]
    best = {}
    for r, root in zip(rows, brute.groups([brute.fingerprint(r.text) for r in rows]), strict=True):
        best[root] = min(best.get(root, r), r, key=lambda x: x.doc_id)
    rows = sorted(best.values(), key=lambda r: r.doc_id)
    texts = [left if n else r.text for r, (_, n, left) in zip(rows, brute.removed([r.text for r in rows]), strict=True)]
    frame = spark.createDataFrame([(r.doc_id, t, r.source) for r, t in zip(rows, texts, strict=True)], "doc_id long, text string, source string")
    placed = _placed(frame, ["doc_id", "text"]).collect()
    times = brute.mixed([(r.source, len(brute.words(r.text)), (r.a, r.b)) for r in placed])
    own = brute.encoding(bpe.default_tokenizer())
    want = Counter()
    for r, n in zip(placed, times, strict=True):
        want[(r.doc_id, *brute.token_digests(own, r.text))] += n
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == +want and sum(got.values()) > 100
