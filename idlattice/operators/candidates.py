"""Search for the machine-readable zone among lines of several OCR passes: groups, gates, scores, best one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mrz_lines import normalize_line
from ..functions.mrz_parse import parse_by_format
from ..sources.tables import settled

LEAST_SCORE = 40.0
LEAST_BEST = 80.0
KEEP = 8


def candidate_sources(documents: DataFrame, passes: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """All texts in which a zone is looked for: doc_id, source_ordinal, source, text.

    passes (doc_id, pass_no, source, text) come first, in their order, then the whole text of documents (doc_id, text) and
    the recognised lines (doc_id, ordinal, text) joined by line ends. Blank passes and texts are none.
    """
    whole = documents.select("doc_id", F.lit(1 << 30).alias("source_ordinal"), F.lit("general_ocr").alias("source"), F.trim("text").alias("text"))
    found = whole
    if passes is not None:
        named = F.coalesce("source", F.concat(F.lit("mrz_pass_"), F.col("pass_no") + 1))
        found = found.unionByName(passes.select("doc_id", F.col("pass_no").cast("int").alias("source_ordinal"), named.alias("source"), F.trim("text").alias("text")))
    found = found.where("text != ''")
    if lines is not None:
        joined = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("l"))
        found = found.unionByName(joined.select("doc_id", F.lit((1 << 30) + 1).alias("source_ordinal"), F.lit("general_ocr_lines").alias("source"), F.array_join("l.text", "\n").alias("text")))
    return found


def candidate_groups(sources: DataFrame) -> DataFrame:
    """sources (doc_id, source_ordinal, source, text) -> groups of neighbouring lines of twelve or more characters.

    group_kind 0: three in a row, one of them of 24 to 34; 1: two in a row; 2: two with one between.
    """
    lines = sources.select("doc_id", "source_ordinal", "source", F.posexplode(F.split("text", "\r?\n")).alias("raw_pos", "raw")).withColumn("line", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).where(F.length("line") >= 12)
    w = Window.partitionBy("doc_id", "source_ordinal").orderBy("raw_pos")
    near = lines.select("doc_id", "source_ordinal", "source", F.row_number().over(w).alias("pos"), F.col("line").alias("g1"), F.lead("line", 1).over(w).alias("g2"), F.lead("line", 2).over(w).alias("g3"))
    cardlike = lambda c: F.length(c).between(24, 34)
    none = F.lit(None).cast("string")
    options = F.array(
        F.when(F.col("g3").isNotNull() & (cardlike("g1") | cardlike("g2") | cardlike("g3")), F.struct(F.lit(0).alias("group_kind"), F.col("g1").alias("line1"), F.col("g2").alias("line2"), F.col("g3").alias("line3"))),
        F.when(F.col("g2").isNotNull(), F.struct(F.lit(1).alias("group_kind"), F.col("g1").alias("line1"), F.col("g2").alias("line2"), none.alias("line3"))),
        F.when(F.col("g3").isNotNull(), F.struct(F.lit(2).alias("group_kind"), F.col("g1").alias("line1"), F.col("g3").alias("line2"), none.alias("line3"))),
    )
    return near.select("doc_id", "source_ordinal", "source", "pos", F.explode(F.filter(options, lambda o: o.isNotNull())).alias("g")).select("doc_id", "source_ordinal", "source", "pos", "g.*")


def _fillers(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("<"), F.lit("")))


def _digits(line: Column) -> Column:
    return F.length(F.regexp_replace(line, "[^0-9]", ""))


def guess_format(l1: Column, l2: Column, l3: Column) -> Column:
    """Format that normalised lines may be parsed as, by prefixes, lengths, digits and fillers; null for none."""
    n1, n2, n3 = F.length(l1), F.length(l2), F.length(l3)
    card = F.substring(l1, 1, 1).isin("I", "A", "C")
    td1 = card & n1.between(25, 35) & n2.between(25, 35) & n3.between(25, 35) & (_digits(l2) >= 8) & (_fillers(l1) + _fillers(l2) + _fillers(l3) >= 3)
    visa = l1.startswith("V") & (l1.contains("<") | F.substring(l1, 1, 5).rlike("[A-Z]")) & (_digits(l2) >= 4)
    mean = (n1 + n2) / 2.0
    td2 = card & l1.contains("<") & n1.between(30, 40) & n2.between(30, 40) & (_digits(l2) >= 8)
    long = n1.between(36, 52) & n2.between(36, 52)
    td3 = long & ((l1.startswith("P") & l1.contains("<") & (_digits(l2) >= 4)) | (_fillers(l1) + _fillers(l2) >= 6))
    pair = F.when(visa & (mean >= 40), "MRVA").when(visa & mean.between(30, 39), "MRVB").when(td2, "TD2").when(td3, "TD3")
    return F.when(l3.isNotNull(), F.when(td1, "TD1")).otherwise(pair)


def parsed_candidates(groups: DataFrame) -> DataFrame:
    """Groups that look like a format, with what the parser makes of them; one plan for all formats.

    Groups and results are written between the steps, so that the parser's expressions are not written out again in others.
    """
    shaped = groups.withColumns({f"n{k}": normalize_line(F.col(f"line{k}")) for k in (1, 2, 3)}).withColumn("fmt", guess_format(F.col("n1"), F.col("n2"), F.col("n3")))
    common = ("format", "valid_format", "line1", "line2", "document_code", "document_number", "nationality", "surname", "given_names", "issuing_state", "date_of_birth", "sex", "date_of_expiry", "optional", "number_ok", "birth_ok", "expiry_ok", "personal_ok", "composite_ok", "state_valid", "nationality_valid", "overall_valid")
    # lines that are too short or too long are filled up or cut to the format's width
    width = F.when(F.col("fmt") == "TD1", 30).when(F.col("fmt").isin("MRVB", "TD2"), 36).otherwise(44)
    cut = settled(shaped.where("fmt is not null"), "groups").withColumns({f"p{k}": F.rpad(f"n{k}", width, F.lit("<")) for k in (1, 2, 3)})
    rows = parse_by_format(cut, "fmt", ["p1", "p2", "p3"])
    return settled(rows.select(*groups.columns, F.struct(*[F.col(f"mrz.{c}").alias(c) for c in common]).alias("mrz")), "parsed")


def candidate_score(lines: list[str]) -> Column:
    """Share of allowed characters, nearness to the format's length, valid format, check digits, countries, verdict."""
    raw = F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in lines])
    ratio = F.length(F.regexp_replace(F.upper(raw), "[^A-Z0-9<]", "")) / F.greatest(F.lit(1), F.length(raw))
    width = F.when(F.col(lines[2]).isNotNull(), 30).when(F.col("mrz.format").isin("MRVB", "TD2"), 36).otherwise(44)
    near = [F.coalesce(F.greatest(F.lit(0.0), 15.0 - F.abs(F.length(F.trim(F.col(c))) - width) * 2.5), F.lit(0.0)) for c in lines]
    points = lambda c, n: F.when(F.coalesce(F.col(c), F.lit(False)), float(n)).otherwise(0.0)
    # all but the passport zone report the number's digit twice
    twice = points("mrz.number_ok", 15) * F.when(F.col("mrz.format") == "TD3", 1).otherwise(2)
    digits = twice + points("mrz.birth_ok", 15) + points("mrz.expiry_ok", 15) + points("mrz.personal_ok", 15) + points("mrz.composite_ok", 15)
    rest = points("mrz.overall_valid", 100) + points("mrz.nationality_valid", 15) + points("mrz.state_valid", 15)
    return ratio * 30.0 + near[0] + near[1] + near[2] + F.when(F.col("mrz.valid_format"), digits + rest + 50.0).otherwise(0.0)


def scored_candidates(sources: DataFrame) -> DataFrame:
    """Candidates of at least LEAST_SCORE with their rank in the document: by score, then source, kind of group, place.

    The rank comes first, as low scores don't change it: a filter on the score below the window would make
    the optimizer write the parsers' expressions out again inside it.
    """
    scored = parsed_candidates(candidate_groups(sources)).withColumn("score", candidate_score(["line1", "line2", "line3"]))
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "source_ordinal", "group_kind", "pos")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("score") >= LEAST_SCORE)


def best_candidates(scored: DataFrame) -> DataFrame:
    """The best candidate of each document, if it reaches LEAST_BEST."""
    return scored.where((F.col("rank") == 1) & (F.col("score") >= LEAST_BEST))


def candidate_debug(scored: DataFrame, keep: int = KEEP) -> DataFrame:
    """Per document: number of candidates and the first ``keep`` of them."""
    counts = scored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("candidate_count"), F.array_sort(F.collect_list(F.when(F.col("rank") <= keep, F.struct("rank", "source", F.round("score", 2).alias("score"), "mrz.format")))).alias("top"))
    return counts


def zones(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """One row a document: doc_id, detected, format, document_code, fields map, line1, line2, overall_valid, score, candidate_count.

    fields are empty where no candidate is good enough. Filled fields only are in the map.
    """
    counts = scored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    names = ("document_number", "nationality", "surname", "given_names", "issuing_state", "date_of_birth", "sex", "date_of_expiry", "optional")
    filled = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit("personal_number" if n == "optional" else n), F.col(f"mrz.{n}").alias("v")) for n in names]), lambda e: F.coalesce(e["v"], F.lit("")) != ""))
    best = best_candidates(scored).select("doc_id", "mrz.format", "mrz.document_code", filled.alias("fields"), F.col("mrz.line1").alias("line1"), F.col("mrz.line2").alias("line2"), F.col("mrz.overall_valid").alias("overall_valid"), F.round("score", 2).alias("score"), F.lit(True).alias("found"))
    met = documents.select("doc_id").join(counts, "doc_id", "left").join(best, "doc_id", "left")
    empty = F.create_map().cast("map<string,string>")
    return met.select("doc_id", F.coalesce("found", F.lit(False)).alias("detected"), "format", "document_code", F.coalesce("fields", empty).alias("fields"), "line1", "line2", "overall_valid", "score", F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"))
