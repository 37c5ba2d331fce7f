"""Forensic analysis of whole documents: six signals with evidence, indicators of what stands out, fused risk.

A signal is a row (doc_id, signal, score, weight, evaluated, evidence_confidence, reason, detail); detail is its largest
deviation, cluster size, editor or mismatch, as text. A document without an image has its image signals unevaluated, and so
has one whose measuring failed, with the failure for its reason; the others go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tamper import HIGH, LOW, WEIGHTS, consistency_signal, copy_move_signal, detected_editor, edge_signal, ela_signal, fuse, noise_signal, outlier_regions

#: Confidence in an evaluated signal's evidence.
EVIDENCE = {"ela": 0.92, "noise": 0.80, "metadata": 0.90, "document_consistency": 0.95, "edge_texture": 0.85, "copy_move": 0.85}
COPY_MOVE_FOUND = 0.90
#: Regions shown of a signal.
REGIONS = {"ela": 8, "noise": 5}
SMALL_SIDE = 200


def _signal(documents: DataFrame, found: DataFrame, name: str, detail: Column, evaluated: Column | None = None, none_found: str = "INSUFFICIENT_EVIDENCE", failed: DataFrame | None = None) -> DataFrame:
    """The signal's row of every document; documents that ``found`` lacks are not evaluated, with the reason ``none_found`` or how they ``failed`` (doc_id, failure)."""
    rows = found.select("doc_id", "score", detail.cast("string").alias("detail"), (F.lit(True) if evaluated is None else evaluated).alias("seen"))
    met = documents.select("doc_id").join(rows, "doc_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    why = F.lit(none_found)
    if failed is not None:
        met, why = met.join(failed, "doc_id", "left"), F.coalesce(F.concat(F.lit("MEASURING_FAILED: "), "failure"), why)
    score = F.when(F.col("seen"), F.coalesce("score", F.lit(0.0))).otherwise(0.0)
    sure = F.when(F.col("seen"), F.lit(EVIDENCE[name])).otherwise(0.0)
    if name == "copy_move":
        sure = F.when(score > 0, COPY_MOVE_FOUND).otherwise(sure)
    reason = F.when(~F.col("seen"), why).when(score > 0, "EVALUATED").otherwise("NO_ANOMALY_FOUND")
    return met.select("doc_id", F.lit(name).alias("signal"), score.alias("score"), F.lit(WEIGHTS[name]).alias("weight"), F.col("seen").alias("evaluated"), sure.alias("evidence_confidence"), reason.alias("reason"), F.when(score > 0, F.col("detail")).alias("detail"))


def _measured(blocks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows that were measured, doc_id and failure of those that could not be)."""
    if "error" not in blocks.columns:
        return blocks, None
    return blocks.where("error is null").drop("error"), blocks.where("error is not null").groupBy("doc_id").agg(F.min("error").alias("failure"))


def _placed(blocks: DataFrame) -> bool:
    return {"x", "y"} <= set(blocks.columns)


def suspicious_regions(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, signal, region, x1, y1, x2, y2: where recompression error (the first eight) or noise (five) stands out, if the signal does. Blocks without places have none."""
    blocks, _ = _measured(blocks)
    scored = found.where(F.col("evaluated") & (F.col("score") > 0)).select("doc_id", "signal")
    out = None
    for name, most in REGIONS.items():
        rows = outlier_regions(blocks, name, name == "noise").where(F.col("region") < most).join(scored.where(F.col("signal") == name), "doc_id")
        rows = rows.select("doc_id", "signal", "region", "x1", "y1", "x2", "y2")
        out = rows if out is None else out.unionByName(rows)
    return out


def signals(documents: DataFrame, blocks: DataFrame, metadata: DataFrame, compared: DataFrame, clusters: DataFrame) -> DataFrame:
    """documents: doc_id, has_image; blocks: doc_id, block, ela, noise, sharpness, as may be x and y, and error on rows of documents that could not be measured; metadata: doc_id, values (array of texts); compared: rows of ``cross_zone``; clusters: rows of ``copy_move_clusters``."""
    blocks, failed = _measured(blocks)
    ela, noise, edge = ela_signal(blocks, "ela", outlier_regions(blocks, "ela") if _placed(blocks) else None), noise_signal(blocks, "noise"), edge_signal(blocks, "sharpness")
    software = F.lower(F.array_join("values", " | "))
    tags = metadata.where(F.size("values") > 0).select("doc_id", F.when(detected_editor(software).isNotNull(), 0.35).otherwise(0.0).alias("score"), detected_editor(software).alias("editor"))
    matched = documents.where("has_image").select("doc_id").join(copy_move_signal(clusters), "doc_id", "left")
    parts = (
        _signal(documents, ela, "ela", F.col("largest_deviation"), failed=failed),
        _signal(documents, noise, "noise", F.col("largest_deviation"), failed=failed),
        _signal(documents, edge, "edge_texture", F.col("least"), failed=failed),
        _signal(documents, matched, "copy_move", F.col("most")),
        _signal(documents, tags, "metadata", F.col("editor"), none_found="NO_METADATA"),
        _signal(documents, consistency_signal(compared), "document_consistency", F.col("n_mismatches")),
    )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def indicators(found: DataFrame) -> DataFrame:
    """doc_id, type, score, severity, explanation: what a reviewer should look at, of the signals that stand out."""
    s, score = F.col("signal"), F.col("score")
    graded = F.when(score >= HIGH, "HIGH").otherwise("MEDIUM")
    kinds = {
        "ela": (score >= LOW, "ela_local_inconsistency", graded, F.format_string("Localized JPEG recompression residual differs from surrounding document regions (peak deviation: +%s intensity units).", "detail")),
        "noise": (score >= LOW, "noise_inconsistency", graded, F.format_string("Localized regions show noise statistics different from the image baseline (peak deviation: %s); needs corroboration.", "detail")),
        "metadata": (score > 0, "editing_software_metadata", F.lit("LOW"), F.format_string("Image metadata names editing software ('%s'); a supporting signal only.", "detail")),
        "document_consistency": (score > 0, "document_consistency_mismatch", graded, F.format_string("%s printed field(s) contradict the machine-readable zone.", "detail")),
        "edge_texture": (score > 0, "edge_texture_inconsistency", F.lit("LOW"), F.lit("Localized area is far less sharp than the document.")),
        "copy_move": (score > 0, "copy_move", F.when(score >= 0.80, "HIGH").when(score >= 0.55, "MEDIUM").otherwise("LOW"), F.format_string("Duplicated regions with up to %s coherent point matches.", "detail")),
    }
    made = F.coalesce(*[F.when((s == name) & cond, F.struct(F.lit(kind).alias("type"), severity.alias("severity"), said.alias("explanation"))) for name, (cond, kind, severity, said) in kinds.items()])
    return found.where("evaluated").withColumn("i", made).where("i is not null").select("doc_id", "i.type", "score", "i.severity", "i.explanation")


def analyze(images: DataFrame, blocks: DataFrame, metadata: DataFrame, compared: DataFrame, clusters: DataFrame, top: int = 8) -> DataFrame:
    """images (doc_id, width, height; null where unreadable) -> doc_id, risk, risk_level, coverage, signals, indicators (``top`` by score), warnings, regions.

    A document with neither image nor compared fields has risk 0, level LOW and coverage 0.
    """
    documents = images.select("doc_id", F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)).alias("has_image"), "width", "height")
    found = signals(documents, blocks, metadata, compared, clusters)
    shown = F.array_sort(F.collect_list(F.struct("signal", "score", "evaluated", "reason")))
    per = found.groupBy("doc_id").agg(shown.alias("signals"), F.max((F.col("signal") == "document_consistency") & F.col("evaluated")).alias("has_fields"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "type", "severity", "explanation")))
    seen = indicators(found).groupBy("doc_id").agg(F.transform(F.slice(ranked, 1, top), lambda i: F.struct(i["type"].alias("type"), (-i["s"]).alias("score"), i["severity"].alias("severity"), i["explanation"].alias("explanation"))).alias("indicators"))
    met = documents.join(per, "doc_id").join(fuse(found), "doc_id", "left").join(seen, "doc_id", "left")
    box = "struct<signal:string,region:int,x1:int,y1:int,x2:int,y2:int>"
    boxes = F.array().cast(f"array<{box}>")
    if _placed(blocks):
        shown = F.array_sort(F.collect_list(F.struct("signal", "region", "x1", "y1", "x2", "y2"))).cast(f"array<{box}>")
        met = met.join(suspicious_regions(found, blocks).groupBy("doc_id").agg(shown.alias("boxes")), "doc_id", "left")
        boxes = F.coalesce("boxes", boxes)
    bare = ~F.col("has_image") & ~F.col("has_fields")
    absent = F.when(~F.col("has_image"), "Document image data is empty or unreadable; physical image forensic signals skipped.")
    small = F.when(F.col("has_image") & (F.least("width", "height") < SMALL_SIDE), F.format_string("Low-resolution image (%sx%s px); forensic signal reliability may be reduced.", "width", "height"))
    kind = "array<struct<type:string,score:double,severity:string,explanation:string>>"
    return met.select(
        "doc_id", F.when(bare, 0.0).otherwise(F.col("risk")).alias("risk"), F.when(bare, "LOW").otherwise(F.col("risk_level")).alias("risk_level"), F.when(bare, 0.0).otherwise(F.col("coverage")).alias("coverage"),
        "signals", F.coalesce("indicators", F.array().cast(kind)).alias("indicators"), F.filter(F.array(absent, small), lambda w: w.isNotNull()).alias("warnings"), boxes.alias("regions"),
    )


def older_metadata(tagged: DataFrame, tags: str = "tags") -> DataFrame:
    """tagged with ``score`` and ``timestamp_mismatch`` of its map of tags, as the earlier helper judged: an editor 0.40, times that differ 0.25 at least."""
    of = lambda k: F.nullif(F.trim(F.try_element_at(F.col(tags), F.lit(k))), F.lit(""))
    named = F.lower(F.concat_ws(" | ", *[of(k) for k in ("Software", "ProcessingSoftware", "ImageDescription", "Artist", "CreatorTool", "Make")]))
    made = F.coalesce(of("DateTimeOriginal"), of("DateTimeDigitized"))
    differ = F.coalesce(made != of("DateTime"), F.lit(False))
    return tagged.withColumns({"timestamp_mismatch": differ, "score": F.when(detected_editor(named).isNotNull(), 0.40).when(differ, 0.25).otherwise(0.0)})
