"""Fields of whole documents: printed fields with values beside their labels, national ids, second passes, fusion with the zone.

Documents are rows (doc_id, text), regions are rows of ``operators.regions``, zones are rows (doc_id, detected, format,
document_code, fields map). Found fields are rows (doc_id, field, value, confidence, source), one a field of a document;
``document_view`` gathers them. A document without text, regions or zone simply has fewer rows.

Lines, numbers and chosen values are written between steps: they are used several times, and their expressions are too
large to stand in one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields
from ..sources.tables import settled
from . import document_types
from .regions import grouped_lines, spatial_fields, value_confidence

_DATE = fields.DATE
#: Labels and values of fields that may stand beside or below their label.
PASSPORT_BESIDE = {
    "passport_number": (r"\b(?:Passport\s*No|Passport\s*Number|Passeport|Document\s*No|Passport)\b", r"([A-Z0-9]{7,12})"),
    "date_of_birth": (r"\b(?:Date\s*of\s*Birth|Birth\s*Date|DOB|Date\s*de\s*naissance)\b", _DATE),
    "date_of_expiry": (r"\b(?:Date\s*of\s*Expiry|Expiry\s*Date|Expiration\s*Date|Date\s*d'\s*expiration|Expires)\b", _DATE),
}
VISA_BESIDE = {
    "visa_type": (r"\b(?:Visa\s*Type\s*/\s*Class|Type\s*/\s*Class|Visa\s*Type|Class|Category)\b", r"([A-Za-z0-9/_-]{1,15})"),
    "entries": (r"\b(?:Entries|No\s*of\s*Entries|Number\s*of\s*Entries)\b", r"([A-Za-z0-9]+)"),
    "issue_date": (r"\b(?:Issue\s*Date|Date\s*of\s*Issue|Issued)\b", _DATE),
    "expiry_date": (r"\b(?:Expiry\s*Date|Expiration\s*Date|Date\s*of\s*Expiry|Expires\s*On|Valid\s*Until)\b", _DATE),
    "passport_number": (r"\b(?:Passport\s*No|Passport\s*Number|Passport)\b", r"([A-Z0-9]{7,12})"),
    "visa_number": (r"\b(?:Visa\s*No|Control\s*Number|Document\s*No)\b", r"([A-Z0-9]{7,14})"),
    "name": (r"\b(?:Name|Full\s*Name|Given\s*Name)\b", r"([A-Za-z\s.'-]{2,50})"),
}
#: The same of national ids, their dates, labels and words.
_FULL_DATE = r"([0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}|[0-9]{4}[/.-][0-9]{2}[/.-][0-9]{2}|[0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{4})"
_DATE_OR_YEAR = _FULL_DATE[:-1] + "|[0-9]{4})"
_LONE_DATE = r"\b([0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}|[0-9]{4}[/.-][0-9]{2}[/.-][0-9]{2})\b"
_BIRTH_LABEL, _SEX_LABEL = r"\b(?:DOB|Date of Birth|Birth Date|Year of Birth|YOB|Birth)\b", r"\b(?:Gender|Sex)\b"
_SEX_WORD = r"(?i)\b(MALE|FEMALE|TRANSGENDER|OTHER|M|F)\b"
_HOLDER = r"(?:Name|Full Name|Given Name|Holder|Cardholder|Name of Holder)[:\s]+([A-Za-z\s.'-]+)(?:\n|$)"
_NAME_BESIDE = (r"\b(?:Name|Full Name|Given Name|Cardholder)\b", r"([A-Za-z\s.'-]{3,40})")
PASSPORT_FIELDS = ("passport_number", "date_of_birth", "date_of_expiry", "surname", "given_names", "name", "sex", "nationality")
VISA_FIELDS = tuple(fields.VISA_PATTERNS)
ZONE_CONFIDENCE, DEFAULT_CONFIDENCE = 0.98, 0.85


def _long(wide: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """doc_id, field, value of all names that have a value."""
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in names]), lambda p: p["value"].isNotNull())
    return wide.select("doc_id", F.inline(pairs))


def _with_confidence(found: DataFrame, regions: DataFrame, default: float = 0.85) -> DataFrame:
    """The confidence of the first region that holds the value, whatever the field; found, which costs most, is read once."""
    r = regions.select("doc_id", F.lower("text").alias("__text"), F.struct("y1", "x1", "ordinal", "confidence").alias("__r"))
    wanted = F.lower(F.trim("value"))
    hit = F.when((wanted != "") & F.col("__text").contains(wanted), F.col("__r"))
    met = found.where("doc_id is not null").join(r, "doc_id", "left").groupBy("doc_id", "field", "value").agg(F.min(hit).alias("__r"))
    return met.select("doc_id", "field", "value", F.coalesce("__r.confidence", F.lit(default)).alias("confidence"))


def _first_of(preferred: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of ``preferred``, and those of ``others`` whose field the document hasn't there; both have a field of a document once."""
    ranked = [rows.select("doc_id", "field", F.struct(F.lit(k).alias("k"), "value", F.col("confidence").cast("double").alias("confidence")).alias("f")) for k, rows in enumerate((preferred, others))]
    return ranked[0].unionByName(ranked[1]).groupBy("doc_id", "field").agg(F.min("f").alias("f")).select("doc_id", "field", "f.value", "f.confidence")


def passport_visual(documents: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, field, value, confidence of a passport's printed page: inline in the text, else beside or below the label."""
    wide = fields.with_passport_fields(documents.select("doc_id", "text"))
    rated = _with_confidence(_long(wide, PASSPORT_FIELDS), regions)
    # a name put together is as sure as its less sure part
    part, mine = F.when(F.col("field").isin("surname", "given_names"), F.col("confidence")), Window.partitionBy("doc_id")
    least = F.when((F.col("field") == "name") & (F.count(part).over(mine) == 2), F.min(part).over(mine))
    inline = rated.select("doc_id", "field", "value", F.coalesce(least, "confidence").alias("confidence"))
    beside = spatial_fields(regions, PASSPORT_BESIDE).withColumn("value", F.when(F.col("field") == "passport_number", F.upper("value")).otherwise(F.col("value")))
    return _first_of(inline, beside)


def visa_visual(documents: DataFrame, regions: DataFrame) -> DataFrame:
    """The same of a visa; values beside a label pass the same checks as inline ones."""
    inline = _with_confidence(_long(fields.with_visa_fields(documents.select("doc_id", "text")), VISA_FIELDS), regions)
    is_, value = F.col("field"), F.col("value")
    dates = is_.isin("issue_date", "expiry_date")
    spelled = F.when(is_.isin("visa_type", "passport_number", "visa_number"), F.upper("value")).when(is_ == "entries", fields.entries(value)).otherwise(value)
    fits = F.when(is_ == "visa_type", ~F.upper("value").isin(*fields.NOT_A_TYPE)).when(is_ == "name", ~F.upper("value").isin(*fields.NOT_A_NAME)).when(dates, fields.is_visa_date(value)).otherwise(True)
    beside = spatial_fields(regions, VISA_BESIDE).where(fits).withColumn("value", spelled).where("value is not null")
    return _first_of(inline, beside)


def second_pass_dates(crops: DataFrame) -> DataFrame:
    """OCR results of crops beside date labels (doc_id, field, pass_no, text, confidence) -> the first valid date of each field."""
    tried = crops.select("doc_id", "field", "pass_no", "confidence", F.posexplode(F.regexp_extract_all("text", F.lit(_FULL_DATE), F.lit(1))).alias("n", "value")).where(fields.is_visa_date(F.col("value")))
    return tried.groupBy("doc_id", "field").agg(F.min(F.struct("pass_no", "n", "value", "confidence")).alias("f")).select("doc_id", "field", "f.value", "f.confidence")


def second_pass_scores(crops: DataFrame, numbers: DataFrame) -> DataFrame:
    """Candidates for birth and sex from crops beside their labels, with scores.

    crops: doc_id, pass_no, field (date_of_birth or gender), label_text, label_x2, crop, crop_x1, text, confidence; numbers:
    doc_id, id_number. A full date beats a year, nearer and same-line crops win; words beat letters.
    """
    birth = crops.where("field = 'date_of_birth'").join(numbers, "doc_id", "left")
    dated = birth.select("*", F.posexplode(F.regexp_extract_all("text", F.lit(_DATE_OR_YEAR), F.lit(1))).alias("n", "value")).where(fields.is_date_candidate(F.col("value"), F.col("label_text"), F.col("id_number")))
    away = F.greatest(F.lit(0), F.col("crop_x1") - F.col("label_x2")) * 0.001
    score = F.when(F.length("value") > 4, 1.0).otherwise(0.8) + F.col("confidence") * 1.5 - away + F.when(F.col("crop").contains("right"), 0.3).otherwise(0.0)
    upper = F.upper("text")
    word = F.when(upper.contains("FEMALE"), "FEMALE").when(upper.contains("MALE"), "MALE").when(upper.contains("TRANSGENDER"), "TRANSGENDER").when(upper.rlike(r"\bM\b"), "M").when(upper.rlike(r"\bF\b"), "F")
    sexes = crops.where("field = 'gender'").withColumn("value", word).where("value is not null").select("doc_id", "field", "pass_no", F.lit(0).alias("n"), "value", "confidence", (F.when(F.length("value") > 1, 1.0).otherwise(0.6) + F.col("confidence") * 1.5).alias("score"))
    return dated.select("doc_id", "field", "pass_no", "n", "value", "confidence", score.alias("score")).unionByName(sexes)


def second_pass_best(scored: DataFrame) -> DataFrame:
    """doc_id, field, value, confidence of the highest positive score; of equal ones the first tried."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "pass_no", "n", "value", "confidence")).alias("f")
    return scored.where("score > 0").groupBy("doc_id", "field").agg(best).select("doc_id", "field", "f.value", "f.confidence")


def _beside_label(lines: DataFrame, numbers: DataFrame) -> DataFrame:
    """Birth dates right of or below their label, sexes right of it: of the first label, the first line that fits."""
    labels = lines.select("doc_id", F.struct("y1", "x1", "line_no").alias("label"), F.trim("text").alias("label_text"), *[F.col(c).alias(f"l{c}") for c in ("x1", "y1", "x2", "y2")], F.explode(F.filter(F.array(F.when(F.trim("text").rlike(f"(?i){_BIRTH_LABEL}"), F.lit("date_of_birth")), F.when(F.trim("text").rlike(f"(?i){_SEX_LABEL}"), F.lit("gender"))), lambda f: f.isNotNull())).alias("field"))
    part = lambda p: F.trim(F.nullif(F.regexp_extract("text", p, 1), F.lit("")))
    said = lines.select("doc_id", "y1", "x1", "line_no", "x2", "y2", "confidence", part(_DATE_OR_YEAR).alias("near"), part(_FULL_DATE).alias("under"), F.upper(part(_SEX_WORD)).alias("sex")).where("near is not null or sex is not null")
    h = F.greatest(F.lit(10.0), (F.col("ly2") - F.col("ly1")).cast("double"))
    level = F.abs((F.col("y1") + F.col("y2")) / 2.0 - (F.col("ly1") + F.col("ly2")) / 2.0) <= F.greatest(F.lit(15.0), h * 1.2)
    right, below = level & (F.col("x1") >= F.col("lx1")), (F.col("y1") - F.col("ly2")).between(0, F.greatest(F.lit(25.0), h * 1.5))
    met = labels.join(numbers, "doc_id", "left").join(said, "doc_id").where(F.struct("y1", "x1", "line_no") != F.col("label")).where(right | below)
    fits = lambda v: fields.is_date_candidate(F.col(v), F.col("label_text"), F.col("id_number"))
    tried = met.select("doc_id", "field", "label", "y1", "x1", "line_no", "confidence", "near", "under", "sex", right.alias("right"), below.alias("below"), fits("near").alias("near_fits"), fits("under").alias("under_fits"))
    birth = F.col("field") == "date_of_birth"
    way = lambda n, value: F.struct(F.lit(n).alias("way"), F.col(value).alias("value"))
    found = F.when(birth & F.col("right") & F.col("near_fits"), way(1, "near")).when(birth & F.col("below") & F.col("under_fits"), way(2, "under")).when(~birth & F.col("right") & F.col("sex").isNotNull(), way(1, "sex"))
    rows = tried.select("doc_id", "field", "label", "y1", "x1", "line_no", "confidence", found.alias("f")).where("f is not null")
    first = F.min(F.struct("label", "f.way", "y1", "x1", "line_no", "f.value", "confidence")).alias("b")
    return rows.groupBy("doc_id", "field").agg(first).select("doc_id", "field", F.col("b.value").alias("value"), F.col("b.confidence").alias("confidence"))


def national_id_visual(documents: DataFrame, regions: DataFrame, least: float = 0.50) -> DataFrame:
    """doc_id, field, value, confidence of a national id without a zone, by cascades over lines, text and places.

    Number: in the text or a line. Birth: inline in a line, inline in the text, beside or below a label, a lone
    date. Sex: inline, beside its label, a lone word. Name: behind a label in a line or the text, beside a label, the
    best-scored line (or single region), without regions the best-scored line of the text.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = settled(grouped_lines(regions.join(docs.select("doc_id"), "doc_id", "left_semi")), "lines")
    place = lambda *more: F.struct("y1", "x1", "line_no", *more)
    firsts = lambda cond, value: F.min(F.when(cond, place(value.alias("value"), "confidence")))
    inside = F.nullif(F.regexp_extract("text", fields.GROUPED, 1), F.lit(""))
    grouped = lines.groupBy("doc_id").agg(firsts(inside.isNotNull(), inside)["value"].alias("in_line"))
    numbers = settled(docs.join(grouped, "doc_id", "left").select("doc_id", fields.id_number(F.col("text"), F.col("in_line")).alias("id_number")), "numbers")

    # what single lines say
    birth = fields.first_match(F.col("text"), fields.ID_PATTERNS["birth"])
    sex = F.upper(fields.first_match(F.col("text"), fields.ID_PATTERNS["gender"]))
    holder = fields.first_match(F.col("text"), (_HOLDER,))
    read = lines.join(numbers, "doc_id").select("*", birth.alias("birth"), sex.alias("sex"), holder.alias("holder")).select("*", fields.is_date_candidate(F.col("birth"), F.col("text"), F.col("id_number")).alias("birth_fits"), fields.name_score(F.col("holder"), F.col("confidence"), least).alias("holder_score"), fields.name_score(F.trim("text"), F.col("confidence"), least).alias("line_score"))
    ranked = F.min(F.when(F.col("line_score") > 0, F.struct((-F.col("line_score")).alias("s"), "y1", "x1", "line_no", F.trim("text").alias("value"), "confidence")))
    read = settled(read.select("doc_id", "y1", "x1", "line_no", "text", "confidence", "birth", "sex", "holder", "birth_fits", "holder_score", "line_score"), "read-lines")
    said = read.groupBy("doc_id").agg(firsts(F.col("birth_fits"), F.col("birth")).alias("l_birth"), firsts(F.col("sex").isNotNull(), F.col("sex")).alias("l_sex"), firsts(F.col("holder_score") > 0, F.col("holder")).alias("l_holder"), ranked.alias("l_ranked"), F.lit(True).alias("has_lines"))
    tokens = regions.withColumn("score", fields.name_score(F.trim("text"), F.col("confidence"), least)).where("score > 0").groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "y1", "x1", "ordinal", F.trim("text").alias("value"), "confidence")).alias("token"))

    # what stands beside labels
    beside = _beside_label(lines, numbers).groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.struct("value", "confidence"))).alias(f"b_{f}") for f in ("date_of_birth", "gender")])
    named = spatial_fields(lines.withColumnRenamed("line_no", "ordinal"), {"name": _NAME_BESIDE}, card=True).where(fields.name_score(F.col("value"), F.col("confidence"), least) > 0).select("doc_id", F.struct("value", "confidence").alias("b_name"))

    # what the text says; its lines are names only where there are no regions
    seen = regions.groupBy("doc_id").agg(F.lit(True).alias("has_regions"))
    whole = docs.join(numbers, "doc_id").join(seen, "doc_id", "left").select("*", birth.alias("t_birth"), F.regexp_extract("text", "(?i)(" + fields.ID_PATTERNS["birth"][0] + ")", 1).alias("context"), sex.alias("t_sex"), holder.alias("t_holder"), F.transform(F.regexp_extract_all("text", F.lit(_LONE_DATE), F.lit(1)), lambda d: F.struct(d.alias("value"))).alias("lone"))
    upper = F.upper("text")
    lone_sex = F.when(upper.rlike(r"\bFEMALE\b"), "FEMALE").when(upper.rlike(r"\bMALE\b"), "MALE").when(upper.rlike(r"\bTRANSGENDER\b"), "TRANSGENDER")
    lone_birth = F.get(F.filter("lone", lambda d: fields.is_date_candidate(d["value"], F.lit("standalone"), F.col("id_number"))), F.lit(0))["value"]
    raw_lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x, k: F.struct((-fields.name_score(F.trim(x), F.lit(0.70), least)).alias("s"), k.alias("k"), F.trim(x).alias("value"))), lambda r: r["s"] < 0)
    spoken = whole.select(
        "doc_id", "id_number", F.when(fields.is_date_candidate(F.col("t_birth"), F.col("context"), F.col("id_number")), F.col("t_birth")).alias("t_birth"), "t_sex",
        F.when(fields.name_score(F.col("t_holder"), F.lit(0.85), least) > 0, F.col("t_holder")).alias("t_holder"), lone_birth.alias("lone_birth"), lone_sex.alias("lone_sex"), F.when(F.col("has_regions").isNull(), F.array_min(raw_lines)["value"]).alias("t_line"),
        fields.id_nationality(F.col("text")).alias("nationality"), fields.first_match(F.col("text"), fields.ID_PATTERNS["nationality"]).alias("nationality_said"), fields.id_address(F.col("text")).alias("address"), fields.first_match(F.col("text"), fields.ID_PATTERNS["address"]).alias("address_said"), fields.id_authority(F.col("text")).alias("issuing_authority"),
    )
    all_ = settled(spoken, "spoken")
    for more in (said, beside, named, tokens):
        all_ = all_.join(more, "doc_id", "left")

    def pick(*options: tuple[Column, Column | None]) -> Column:
        """The first value there is, with its confidence; null where that is still to be looked up."""
        return F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("value"), (F.lit(None).cast("double") if c is None else c.cast("double")).alias("confidence"))) for v, c in options])

    of = lambda c: (F.col(f"{c}.value"), F.col(f"{c}.confidence"))
    chosen = {
        "id_number": pick((F.col("id_number"), None)),
        "date_of_birth": pick(of("l_birth"), (F.col("t_birth"), None), of("b_date_of_birth"), (F.col("lone_birth"), None)),
        "gender": pick(of("l_sex"), (F.col("t_sex"), None), of("b_gender"), (F.col("lone_sex"), None)),
        "name": pick(of("l_holder"), (F.col("t_holder"), None), of("b_name"), of("l_ranked"), of("token"), (F.col("t_line"), F.lit(0.75))),
        "nationality": pick((F.when(F.col("nationality_said").isNotNull(), F.col("nationality")), None), (F.col("nationality"), F.lit(0.90))),
        "address": pick((F.col("address"), None)),
        "issuing_authority": pick((F.col("issuing_authority"), F.lit(0.90))),
    }
    all_ = settled(all_.select("doc_id", "nationality_said", "address_said", *[c.alias(f"chosen_{n}") for n, c in chosen.items()]), "chosen")
    said_as = {"nationality": F.col("nationality_said"), "address": F.col("address_said")}
    rows = F.filter(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"chosen_{n}.value").alias("value"), F.col(f"chosen_{n}.confidence").alias("confidence"), said_as.get(n, F.col(f"chosen_{n}.value")).alias("said")) for n in chosen]), lambda r: r["value"].isNotNull())
    found = all_.select("doc_id", F.inline(rows))
    rated = value_confidence(found.where("confidence is null").select("doc_id", F.col("said").alias("value")).distinct(), lines.withColumnRenamed("line_no", "ordinal")).select("doc_id", F.col("value").alias("said"), F.col("confidence").alias("looked_up"))
    out = found.join(rated, ["doc_id", "said"], "left").select("doc_id", "field", "value", F.coalesce("confidence", "looked_up").alias("confidence"))
    sexes = out.where("field = 'gender'").select("doc_id", F.lit("sex").alias("field"), fields.sex_of(F.col("value")).alias("value"), "confidence")
    number = out.where("field = 'id_number'").select("doc_id", F.lit("document_number").alias("field"), "value", "confidence")
    return out.unionByName(sexes).unionByName(number)


def _zone_structs(names: dict[str, tuple[str, ...]]) -> list[Column]:
    """struct(field, value) of each name from the zone's map; of several keys the first filled one."""
    of = lambda keys: F.coalesce(*[F.nullif(F.try_element_at(F.col("fields"), F.lit(k)), F.lit("")) for k in keys])
    full = F.nullif(F.trim(F.concat_ws(" ", of(("surname",)), of(("given_names",)))), F.lit(""))
    rows = [F.struct(F.lit(n).alias("field"), (full if keys == ("name",) else of(keys)).alias("value")) for n, keys in names.items()]
    return [*rows, F.struct(F.lit("mrz_format").alias("field"), F.col("format").alias("value"))]


def _zone_rows(zones: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """doc_id, field, value, confidence of what the zone has."""
    rows = F.array(*_zone_structs(names))
    return zones.select("doc_id", F.inline(F.filter(rows, lambda r: r["value"].isNotNull()))).withColumn("confidence", F.lit(ZONE_CONFIDENCE))


_NUMBER = ("document_number", "visa_number", "passport_number", "id_number")
_ZONE_PASSPORT = {"surname": ("surname",), "given_names": ("given_names",), "passport_number": ("passport_number", "document_number"), "nationality": ("nationality",), "date_of_birth": ("date_of_birth",), "sex": ("sex",), "date_of_expiry": ("date_of_expiry",), "issuing_state": ("issuing_state",), "personal_number": ("personal_number",)}
_ZONE_VISA = {"visa_number": _NUMBER, "document_number": _NUMBER, "surname": ("surname",), "given_names": ("given_names",), "name": ("name",), "nationality": ("nationality",), "date_of_birth": ("date_of_birth",), "sex": ("sex",), "issuing_state": ("issuing_state",)}
_ZONE_ID = {"id_number": _NUMBER, "document_number": _NUMBER, "surname": ("surname",), "given_names": ("given_names",), "name": ("name",), "date_of_birth": ("date_of_birth",), "sex": ("sex",), "gender": ("sex",), "nationality": ("nationality",), "expiry_date": ("date_of_expiry",), "issuing_state": ("issuing_state",)}
_PRINTED_FIRST = ("visa_type", "entries", "issue_date", "passport_number", "issuing_authority", "expiry_date")


def _from(rows: DataFrame, source: str) -> DataFrame:
    return rows.select("doc_id", "field", "value", "confidence", F.lit(source).alias("source"))


def passport_fused(visual: DataFrame, zones: DataFrame) -> DataFrame:
    """The zone's fields where a document has a zone with fields, else the printed ones: doc_id, field, value, confidence, source."""
    zoned = zones.where(F.size("fields") > 0)
    return _from(_zone_rows(zoned, _ZONE_PASSPORT), "mrz").unionByName(_from(visual.join(zoned, "doc_id", "left_anti"), "visual_ocr"))


def visa_fused(visual: DataFrame, zones: DataFrame) -> DataFrame:
    """Identity from a visa's zone, else from the print; what only the print has from there; expiry from the print first.

    A document's printed fields are gathered to one row that meets its zone, so each side is read once.
    """
    zoned = zones.where((F.size("fields") > 0) & F.col("format").isin("MRVA", "MRVB")).select("doc_id", "format", "fields", F.lit(True).alias("zoned"))
    asked = ("visa_number", "name", *_PRINTED_FIRST)
    printed = visual.where(F.col("field").isin(*asked)).groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == n, F.struct("value", "confidence"))).alias(f"v_{n}") for n in asked])
    free, zone = F.col("zoned").isNull(), {n: r["value"] for n, r in zip((*_ZONE_VISA, "mrz_format"), _zone_structs(_ZONE_VISA), strict=True)}
    row = lambda field, value, confidence, source: F.struct(F.lit(field).alias("field"), value.alias("value"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"))
    of_zone = lambda n, value: row(n, value, F.lit(ZONE_CONFIDENCE), "mrz")
    said = lambda n, of, when=None: row(n, F.col(f"v_{of}.value") if when is None else F.when(when, F.col(f"v_{of}.value")), F.col(f"v_{of}.confidence"), "visual_ocr")
    expiry = F.when(F.col("v_expiry_date").isNull(), F.nullif(F.try_element_at(F.col("fields"), F.lit("date_of_expiry")), F.lit("")))
    rows = [*[of_zone(n, v) for n, v in zone.items()], of_zone("expiry_date", expiry), *[said(n, n) for n in _PRINTED_FIRST], said("visa_number", "visa_number", free), said("document_number", "visa_number", free), said("name", "name", free | zone["name"].isNull())]
    return printed.join(zoned, "doc_id", "full").select("doc_id", F.inline(F.filter(F.array(*rows), lambda r: r["value"].isNotNull())))


def national_id_fused(visual: DataFrame, zones: DataFrame) -> DataFrame:
    """The zone alone where a document has one with fields, else the printed fields."""
    zoned = zones.where(F.size("fields") > 0)
    return _from(_zone_rows(zoned, _ZONE_ID), "mrz").unionByName(_from(visual.join(zoned, "doc_id", "left_anti"), "visual_ocr"))


def typed(documents: DataFrame, zones: DataFrame) -> DataFrame:
    """documents (doc_id, text, requested null or a type) with document_type, type_confidence, and the zone's columns; documents without a zone have none detected."""
    met = documents.join(zones, "doc_id", "left").withColumn("detected", F.coalesce("detected", F.lit(False)))
    seen = fields.classify(F.col("text"), F.col("format"), F.col("document_code"), F.col("detected"))
    asked = F.nullif(F.nullif(F.lower("requested"), F.lit("auto")), F.lit(""))
    return met.withColumn("__seen", seen).select("doc_id", "text", "detected", "format", "fields", F.coalesce(asked, "__seen.document_type").alias("document_type"), F.when(asked.isNull(), F.col("__seen.confidence")).alias("type_confidence"))


@dataclass(frozen=True)
class Extractor:
    """How documents of a type are read (types, regions -> doc_id, field, value, confidence) and fused with their zones (-> and source)."""

    visual: Callable[[DataFrame, DataFrame], DataFrame]
    fuse: Callable[[DataFrame, DataFrame], DataFrame]


EXTRACTORS = {"passport": Extractor(passport_visual, passport_fused), "visa": Extractor(visa_visual, visa_fused), "national_id": Extractor(national_id_visual, national_id_fused)}
#: Type of documents that none of the others fits.
FALLBACK = "national_id"
_BY_RULES = "by_rules"


def by_rules(rules: DataFrame) -> Extractor:
    """The extractor of the types that ``document_types`` rules describe; what the zone has goes before the print, field by field."""

    def visual(types: DataFrame, regions: DataFrame) -> DataFrame:
        return _with_confidence(document_types.read_fields(types, rules), regions)

    def fuse(printed: DataFrame, zones: DataFrame) -> DataFrame:
        zone = zones.select("doc_id", F.explode("fields").alias("field", "value")).where(F.coalesce("value", F.lit("")) != "").withColumn("confidence", F.lit(ZONE_CONFIDENCE))
        return _from(zone, "mrz").unionByName(_from(printed.join(zone, ["doc_id", "field"], "left_anti"), "visual_ocr"))

    return Extractor(visual, fuse)


def extract(documents: DataFrame, regions: DataFrame, zones: DataFrame, extractors: dict[str, Extractor] | None = None, rules: DataFrame | None = None, wanted: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(types, fields, printed): per document its type and zone; fused fields; the printed fields alone, as the forensic check compares them.

    documents: doc_id, text, requested. Each document goes to the extractor of its type, others to that of FALLBACK.
    extractors: further ones by type, before the built-in ones; rules: types that are described by a table (``document_types``).
    wanted: types whose fields are asked for, all unless named; documents of others are typed, not read. Extractors without documents aren't run.
    """
    known = EXTRACTORS | (extractors or {})
    types = typed(documents, zones)
    kind = F.when(F.col("document_type").isin(*known), F.col("document_type")).otherwise(FALLBACK)
    if rules is not None:
        rules = settled(document_types.checked(rules), "rules")
        described = document_types.known_types(rules).withColumn("__described", F.lit(True))
        types = document_types.marked(types, rules).join(F.broadcast(described), "document_type", "left")
        known, kind = known | {_BY_RULES: by_rules(rules)}, F.when(F.col("__described"), _BY_RULES).otherwise(kind)
    types = settled(types.withColumn("__kind", kind), "types")
    read = types if wanted is None else types.where(F.col("document_type").isin(*wanted))
    busy = {r[0] for r in read.select("__kind").distinct().collect()} or {FALLBACK}
    fused = printed = None
    for name, extractor in known.items():
        if name not in busy:
            continue
        mine = read.where(F.col("__kind") == name)
        near = regions.join(mine.select("doc_id"), "doc_id", "left_semi")
        visual = settled(extractor.visual(mine, near), name)
        rows = extractor.fuse(visual, mine.where("fields is not null").select("doc_id", "format", "fields"))
        fused = rows if fused is None else fused.unionByName(rows)
        printed = visual if printed is None else printed.unionByName(visual)
    return types.drop("__kind", "__described"), fused, printed


def discrepancies(printed: DataFrame, zones: DataFrame) -> DataFrame:
    """doc_id, field, visual, mrz: a visa's numbers that differ and don't contain one another, and names without a common word of three letters."""
    one = printed.where(F.col("field").isin("visa_number", "name")).groupBy("doc_id").agg(F.max(F.when(F.col("field") == "visa_number", F.col("value"))).alias("v_number"), F.max(F.when(F.col("field") == "name", F.col("value"))).alias("v_name"))
    of = lambda k: F.nullif(F.try_element_at(F.col("fields"), F.lit(k)), F.lit(""))
    zone = zones.where(F.col("format").isin("MRVA", "MRVB")).select("doc_id", F.coalesce(of("document_number"), of("visa_number")).alias("m_number"), F.nullif(F.trim(F.concat_ws(" ", of("surname"), of("given_names"))), F.lit("")).alias("m_name"))
    bare = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    words = lambda c: F.regexp_extract_all(F.upper(c), F.lit("([A-Z]{3,})"))
    a, b = bare(F.col("v_number")), bare(F.col("m_number"))
    number = F.when(~a.contains(b) & ~b.contains(a), F.struct(F.lit("document_number").alias("field"), F.col("v_number").alias("visual"), F.col("m_number").alias("mrz")))
    x, y = words(F.col("v_name")), words(F.col("m_name"))
    name = F.when((F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y), F.struct(F.lit("name").alias("field"), F.col("v_name").alias("visual"), F.col("m_name").alias("mrz")))
    return one.join(zone, "doc_id").select("doc_id", F.inline(F.filter(F.array(number, name), lambda d: d.isNotNull())))


def document_view(types: DataFrame, fused: DataFrame, differing: DataFrame | None = None) -> DataFrame:
    """doc_id, document_type, type_confidence, fields, confidences and sources as maps, warnings in order."""
    gathered = fused.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field", "value", "confidence", "source"))).alias("f"))
    met = types.join(gathered, "doc_id", "left")
    as_map = lambda c: F.map_from_arrays(F.coalesce("f.field", F.array().cast("array<string>")), F.coalesce(f"f.{c}", F.array().cast(f"array<{'double' if c == 'confidence' else 'string'}>")))
    absent = F.when(~F.col("detected"), F.when(F.col("document_type") == "national_id", F.lit("MRZ not detected on this National ID; fields extracted via visual OCR key-value analysis.")).otherwise(F.concat(F.lit("No MRZ detected for "), "document_type", F.lit("; extracted fields rely on visual OCR text."))))
    warned = F.array().cast("array<string>")
    if differing is not None:
        label = F.when(F.col("field") == "name", "name").otherwise("document number")
        said = F.concat(F.lit("Discrepancy: Visual "), label, F.lit(" '"), "visual", F.lit("' differs from MRV "), label, F.lit(" '"), "mrz", F.lit("'"))
        per = differing.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field", said.alias("said")))).alias("w")).select("doc_id", F.col("w.said").alias("w"))
        met = met.join(per, "doc_id", "left")
        warned = F.when(F.col("document_type") == "visa", F.coalesce("w", warned)).otherwise(warned)
    warnings = F.concat(warned, F.filter(F.array(absent), lambda w: w.isNotNull()))
    return met.select("doc_id", "document_type", "type_confidence", as_map("value").alias("fields"), as_map("confidence").alias("confidences"), as_map("source").alias("sources"), warnings.alias("warnings"))
