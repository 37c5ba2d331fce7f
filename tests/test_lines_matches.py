"""Lines of words against the plain fold, and matches of descriptors against all pairs."""

import random
import time

from idlattice.operators import regions, tamper


def folded(words, threshold=16.0):
    """Lines by the plain fold: each word, by height, to the first line whose mean centre is near."""
    lines = []
    for w in sorted(words, key=lambda w: ((w[3] + w[5]) / 2, w)):
        cy = (w[3] + w[5]) / 2
        for line in lines:
            if abs(cy - sum((x[3] + x[5]) / 2 for x in line) / len(line)) <= threshold:
                line.append(w)
                break
        else:
            lines.append([w])
    return [[x[1] for x in sorted(line, key=lambda x: (x[2], (x[3] + x[5]) / 2, x[0]))] for line in lines]


def page(rng, n, height):
    out = []
    for k in range(n):
        x, y = rng.randrange(800), rng.randrange(height)
        out.append((k, f"w{k}", x, y, x + 40, y + rng.randrange(8, 30)))
    return out


def table(spark, pages):
    return spark.createDataFrame([(d, k, t, 0.5, x1, y1, x2, y2) for d, words in pages.items() for k, t, x1, y1, x2, y2 in words], "doc_id long, ordinal int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")


def test_lines_as_folded(spark):
    rng = random.Random(5)
    pages = {d: page(rng, rng.choice((1, 5, 40, 90)), rng.choice((60, 400, 3000))) for d in range(30)}
    pages[30] = [(k, f"w{k}", 5 * k, 16 * k, 5 * k + 4, 16 * k) for k in range(20)]  # gaps of just the threshold
    pages[31] = [(0, "w0", 0, 0, 1, 1), (1, "w1", 0, 0, 1, 1), (2, " ", 0, 50, 1, 51)]
    found = {}
    for r in regions.grouped_lines(table(spark, pages)).orderBy("doc_id", "line_no").collect():
        found.setdefault(r.doc_id, []).append(r.text.split(" "))
    assert found == {d: folded([w for w in words if w[1].strip()]) for d, words in pages.items()}
    assert regions.grouped_lines(table(spark, pages).limit(0)).count() == 0


def test_ten_thousand_words(spark):
    rng = random.Random(6)
    pages = {1: page(rng, 10_000, 40_000)}
    regions.grouped_lines(table(spark, {1: pages[1][:100]})).count()
    began = time.perf_counter()
    found = regions.grouped_lines(table(spark, pages)).collect()
    assert time.perf_counter() - began < 20
    assert sum(len(r.text.split(" ")) for r in found) == 10_000
    assert [r.text.split(" ") for r in sorted(found, key=lambda r: r.line_no)] == folded(pages[1])


# --- matches of descriptors -------------------------------------------------------------------


def matched(points, strict):
    """The rules over all pairs."""
    out = []
    for doc in {p[0] for p in points}:
        mine = [p for p in points if p[0] == doc]
        if len(mine) < 25:
            continue
        for p in mine:
            near = sorted((bin(int.from_bytes(p[4], "big") ^ int.from_bytes(q[4], "big")).count("1"), q[1], q) for q in mine)[:3]
            near = [x for x in near if x[0] <= tamper.RADIUS]
            others = [x for x in near if x[1] != p[1]]
            if not others:
                continue
            far = (tamper.RADIUS + 1, None, None)
            third = near[2] if len(near) > 2 else far
            against = ((others[0] if near[0][1] == p[1] else third) if strict else (others[1] if len(others) > 1 else far))[0]
            if against == 0 or others[0][0] <= 0.8 * against:
                out.append((doc, p[2], p[3], others[0][2][2], others[0][2][3]))
    return sorted(out)


def flipped(rng, bits, n):
    x = int.from_bytes(bits, "big")
    for k in rng.sample(range(256), n):
        x ^= 1 << k
    return x.to_bytes(32, "big")


def test_matches_of_descriptors(spark):
    rng = random.Random(7)
    points = []
    for doc, n in ((1, 24), (2, 25), (3, 300)):
        seen = []
        for k in range(n):
            d = flipped(rng, rng.choice(seen), rng.choice((0, 0, 1, 5, 12, 15, 16, 40))) if seen and rng.random() < 0.6 else rng.randbytes(32)
            seen.append(d)
            points.append((doc, k, float(rng.randrange(900)), float(rng.randrange(600)), d))
    df = spark.createDataFrame(points, "doc_id long, point int, x double, y double, descriptor binary").repartition(3)
    for strict in (True, False):
        assert sorted(map(tuple, tamper.descriptor_matches(df, strict=strict).collect())) == matched(points, strict)
    odd = spark.createDataFrame([(1, 1, 0.0, 0.0, None), (1, 2, 0.0, 0.0, b"x")], df.schema)
    assert tamper.descriptor_matches(odd).count() == 0 == tamper.descriptor_matches(df.limit(0)).count()


def test_low_islands_are_one_line(spark):
    """An island no higher than the threshold isn't dealt word by word; a higher one is."""
    rows = [(doc, k, "ABCDE"[k], 0.5, 10 * k, 8 * k - 1, 10 * k + 9, 8 * k + 1) for doc, n in ((1, 3), (2, 5)) for k in range(n)]
    lines = regions.grouped_lines(spark.createDataFrame(rows, "doc_id long, ordinal int, text string, confidence double, x1 int, y1 int, x2 int, y2 int"))
    assert sorted((r.doc_id, r.line_no, r.text) for r in lines.collect()) == [(1, 0, "A B C"), (2, 0, "A B C D"), (2, 1, "E")]
    assert "array_repeat" in lines._jdf.queryExecution().analyzed().toString()


def test_strict_matches_take_one_partitioning(spark):
    """Points aren't multiplied by their chunks, nor joined: a shuffle of the points is all the disk it takes."""
    rng = random.Random(9)
    few = [rng.randbytes(32) for _ in range(7)]
    points = [(doc, k, float(k), float(doc), rng.choice(few)) for doc in range(4) for k in range(22 + 2 * doc)] + [(None, 1, 0.0, 0.0, few[0])]
    df = spark.createDataFrame(points, "doc_id long, point int, x double, y double, descriptor binary").repartition(3)
    found = tamper.descriptor_matches(df)
    assert sorted(map(tuple, found.collect())) == matched(points[:-1], True)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_copied_patch_is_cut_at_the_edge(spark):
    rng = random.Random(8)
    patch = [(rng.randrange(60), rng.randrange(60), rng.randbytes(32)) for _ in range(30)]
    points = [(1, 2 * k + c, float(x + 300 * c), float(y + 200 * c), d) for k, (x, y, d) in enumerate(patch) for c in (0, 1)]
    df = spark.createDataFrame(points, "doc_id long, point int, x double, y double, descriptor binary")
    sizes = spark.createDataFrame([(1, 355, 250)], "doc_id long, width int, height int")
    found = tamper.copy_move_clusters(tamper.descriptor_matches(df), sizes=sizes).collect()
    assert len(found) == 1 and (found[0].bin_x, found[0].bin_y, found[0].matches) == (15, 10, 60)
    assert (found[0].ax1, found[0].ay1) == (0, 0) and found[0].bx2 == 355 and found[0].by2 == 250
