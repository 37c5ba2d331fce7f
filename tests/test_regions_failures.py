"""Regions that a reviewer can look at, and documents whose measuring fails."""

import statistics

from idlattice.operators import analysis, pixels, tamper

BLOCKS = "doc_id long, block int, x int, y int, ela double, noise double, sharpness double"


def merged(boxes, gap):
    out = []
    for b in boxes:
        for m in out:
            if not (b[2] < m[0] - gap or b[0] > m[2] + gap or b[3] < m[1] - gap or b[1] > m[3] + gap):
                m[:] = [min(m[0], b[0]), min(m[1], b[1]), max(m[2], b[2]), max(m[3], b[3])]
                break
        else:
            out.append(list(b))
    return out


def page(doc, raised, by=20.0):
    """Twelve by twelve calm blocks, some raised."""
    return [(doc, 12 * r + c, 32 * c, 32 * r, 5.0 + 0.01 * c + (by if (r, c) in raised else 0.0), 3.0 + 0.01 * r + (by if (r, c) in raised else 0.0), 9.0) for r in range(12) for c in range(12)]


def run(spark, rows, images, schema=BLOCKS):
    empty = lambda ddl: spark.createDataFrame([], ddl)
    sizes = spark.createDataFrame([(i, 384, 384) for i in images], "doc_id long, width int, height int")
    out = analysis.analyze(sizes, spark.createDataFrame(rows, schema), empty("doc_id long, values array<string>"), empty("doc_id long, field string, match boolean, weight double, counts boolean"), empty("doc_id long, matches long"))
    return {r.doc_id: r for r in out.collect()}


def test_regions_of_outliers(spark):
    pages = {1: {(0, 0), (0, 1), (1, 0), (9, 9)}, 2: {(k, (3 * k) % 12) for k in range(0, 12, 4)}, 3: set(), 4: {(2, 2)}}
    rows = [x for d, raised in pages.items() for x in page(d, raised)]
    out = run(spark, rows, pages)
    for d in pages:
        for signal, at, most, limit in (("ela", 4, 8, 2.5), ("noise", 5, 5, 14.0)):
            mine = [x for x in rows if x[0] == d]
            median = statistics.median(x[at] for x in mine)
            boxes = merged([(x[2], x[3], x[2] + 32, x[3] + 32) for x in mine if x[at] - median >= limit], 48)
            shown = [[r.x1, r.y1, r.x2, r.y2] for r in out[d].regions if r.signal == signal]
            scored = any(s.signal == signal and s.score > 0 for s in out[d].signals)
            assert shown == (boxes[:most] if scored else [])
    assert [s.score for s in out[3].signals if s.signal == "ela"] == [0.0] and len([r for r in out[1].regions if r.signal == "ela"]) == 2


def test_two_regions_weigh_more_than_one(spark):
    """Blocks side by side are one region: their score stays under that of two regions of the same size and height."""
    df = spark.createDataFrame(page(1, {(5, 5), (5, 6)}, 6.0) + page(2, {(0, 0), (11, 11)}, 6.0), BLOCKS)
    score = {r.doc_id: r.score for r in tamper.ela_signal(df, "ela", tamper.outlier_regions(df, "ela")).collect()}
    assert score[1] < 0.45 == score[2]


def test_a_failure_stops_no_other_document(spark):
    good = bytes(range(256)) * 144
    rows = [("1", 192, 192, 1, good[:36_864]), ("2", 192, 192, 1, b"short"), ("3", 10, 10, 1, bytes(100)), ("4", None, 192, 1, good)]
    images = spark.createDataFrame(rows, "path string, height int, width int, channels int, data binary")
    blocks = pixels.with_blocks(images).withColumnRenamed("path", "doc_id").selectExpr("cast(doc_id as long) as doc_id", "block", "x", "y", "ela", "noise", "sharpness", "error").collect()
    assert {r.doc_id for r in blocks if r.error} == {2, 4} and {r.doc_id for r in blocks if not r.error} == {1}
    out = run(spark, [tuple(r) for r in blocks], [1, 2, 3, 4], f"{BLOCKS}, error string")
    reasons = {d: {s.signal: (s.evaluated, s.reason.split(":")[0]) for s in r.signals} for d, r in out.items()}
    assert all(reasons[1][s][0] for s in ("ela", "noise", "edge_texture"))
    assert all(reasons[d][s] == (False, "MEASURING_FAILED") for d in (2, 4) for s in ("ela", "noise", "edge_texture"))
    assert reasons[3]["ela"] == (False, "INSUFFICIENT_EVIDENCE")
