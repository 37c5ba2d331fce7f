"""Queries over whole documents and submissions: extraction, forensic analysis, face verification, records, image geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analysis, candidates, extraction, images, records, regions, screening, tamper, verification
from .base import ORACLE_SQL, register, register_many, register_table
from .inputs import SQL


def _inner(name: str) -> str:
    return f"({ORACLE_SQL[name]})"


# --- documents --------------------------------------------------------------------------------


def _zoned(d: DataFrame) -> DataFrame:
    zone = F.when(F.col("detected"), F.create_map(F.lit("document_number"), F.col("mrz_number"), F.lit("surname"), F.col("mrz_name")))
    return d.select("doc_id", "detected", "format", "document_code", F.coalesce(zone, F.create_map().cast("map<string,string>")).alias("fields"))


def _extract(d: DataFrame, r: DataFrame) -> DataFrame:
    types, fused, printed = extraction.extract(d.select("doc_id", "text", "requested"), r, _zoned(d))
    view = extraction.document_view(types, fused, extraction.discrepancies(printed, _zoned(d)))
    return view.select("doc_id", "document_type", F.round("type_confidence", 4).alias("type_confidence"), F.to_json("fields").alias("fields"), F.to_json("sources").alias("sources"), F.array_join("warnings", "; ").alias("warnings"))


register_many("document_extract", ("documents_src", "regions"), _extract)
register_many("mrz_candidate_sources", ("documents_src", "regions"), lambda d, r: candidates.candidate_sources(d.select("doc_id", "text"), None, r).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("signs")),
              "select 'general_ocr' as source, count(*) as n, cast(sum(length(trim(text))) as bigint) as signs from {src0} where trim(text)<>'' union all select 'general_ocr_lines', count(*), cast(sum(n) as bigint) from (select doc_id, sum(length(text))+count(*)-1 as n from {src1} group by doc_id) x")
register("mrz_zones", "candidate_src", lambda d: candidates.zones(d.select("doc_id").distinct(), candidates.scored_candidates(d)).select("doc_id", "detected", "format", F.to_json("fields").alias("fields"), "overall_valid", "candidate_count"))
register("passport_beside_label", "regions", lambda d: regions.spatial_fields(d, extraction.PASSPORT_BESIDE).select("doc_id", "field", "value", "confidence"),
         "select doc_id, 'date_of_birth' as field, '15/08/1990' as value, arg_min(confidence,(y1,x1,ordinal,text,confidence)) as confidence from {src} where text like 'DOB%' group by doc_id")

_BESIDE_SQL = {
    "passport_number": ("(?i)\\b(?:Passport\\s*No|Passport\\s*Number|Passeport|Document\\s*No|Passport)\\b", "([A-Z0-9]{7,12})"),
    "date_of_birth": ("(?i)\\b(?:Date\\s*of\\s*Birth|Birth\\s*Date|DOB)\\b", "([0-9]{2}/[0-9]{2}/[0-9]{4})"),
    "date_of_expiry": ("(?i)\\b(?:Date\\s*of\\s*Expiry|Expiry\\s*Date|Expiration\\s*Date|Expires)\\b", "([0-9]{2}/[0-9]{2}/[0-9]{4})"),
}
_MIDDLES = "abs((o.y1+o.y2)/2.0-(l.y1+l.y2)/2.0)"
_PLAIN_WAY = f"case when {_MIDDLES}<=greatest(18.0,(l.y2-l.y1)*0.9) and o.x1>=l.x1+5 then 1 when o.y1>=l.y1 and o.y1-l.y2<=greatest(35.0,(l.y2-l.y1)*2.0) and o.x1<=l.x2+80 and o.x2>=l.x1-40 then 2 end"
_CARD_WAY = f"case when {_MIDDLES}<=greatest(15.0,(l.y2-l.y1)*1.2) and o.x1>=l.x1 then 1 when o.y1-l.y2 between 0 and greatest(35.0,(l.y2-l.y1)*2.5) and (abs(o.x1-l.x1)<=250 or abs(o.x2-l.x2)<=250) then 2 end"


def _beside_sql(way: str) -> str:
    """Each label of a document with each of its values, by way and distance, the first label that has one."""
    pairs = []
    for field, (label, value) in _BESIDE_SQL.items():
        found = f"trim(regexp_extract(trim(o.text),'{value}',1))"
        met = f"case when o.place<>l.place then {way} when {found}<>trim(l.text) then 0 end"
        pairs.append(f"select '{field}' as field, l.doc_id, l.place as lp, {met} as way, case {met} when 0 then 0 when 1 then o.x1-l.x2 else o.y1-l.y2 end as dist, o.place, {found} as value, o.confidence from p l join p o on o.doc_id=l.doc_id where regexp_matches(trim(l.text),'{label}') and regexp_matches(trim(o.text),'{value}')")
    return "with p as (select *, row_number() over (partition by doc_id order by y1,x1,ordinal,text,confidence) as place from {src}), c as (" + " union all ".join(pairs) + ") select doc_id, field, value, confidence from (select *, row_number() over (partition by doc_id, field order by lp,way,dist,place) as n from c where way is not null) x where n=1"


for _name, _card, _way in (("spatial_passport_fields", False, _PLAIN_WAY), ("spatial_card_fields", True, _CARD_WAY)):
    register(_name, "card_regions", lambda d, card=_card: regions.spatial_fields(d, extraction.PASSPORT_BESIDE, card), _beside_sql(_way))

# --- folds of one document's rows -------------------------------------------------------------

register("merge_boxes", "boxes", tamper.merged_boxes, """
with g as (select doc_id, list({'x1':x1,'y1':y1,'x2':x2,'y2':y2} order by ordinal,x1,y1,x2,y2) as bs from {src} group by doc_id),
f as (select doc_id, list_reduce(bs[2:], lambda acc, b: case when len(list_filter(acc, lambda m: not (b.x2<m.x1-48 or b.x1>m.x2+48 or b.y2<m.y1-48 or b.y1>m.y2+48)))=0 then list_append(acc,b)
 else list_transform(acc, lambda m, i: case when i=list_position(list_transform(acc, lambda z: not (b.x2<z.x1-48 or b.x1>z.x2+48 or b.y2<z.y1-48 or b.y1>z.y2+48)), true) then {'x1':least(m.x1,b.x1),'y1':least(m.y1,b.y1),'x2':greatest(m.x2,b.x2),'y2':greatest(m.y2,b.y2)} else m end) end, [bs[1]]) as rs from g)
select doc_id, cast(i-1 as int) as region, r.x1 as x1, r.y1 as y1, r.x2 as x2, r.y2 as y2 from (select doc_id, unnest(rs) as r, generate_subscripts(rs,1) as i from f) u""")
register("line_group", "regions", lambda d: regions.grouped_lines(d), """
with w as (select doc_id, (y1+y2)/2.0 as cy, ordinal, x1, y1, x2, y2, trim(text) as t, cast(confidence as double) as c from {src} where trim(text)<>''),
g as (select doc_id, list({'cy':cy,'o':ordinal,'x1':x1,'y1':y1,'x2':x2,'y2':y2,'t':t,'c':c} order by cy,ordinal,x1) as ws from w group by doc_id),
f as (select doc_id, list_reduce(ws[2:], lambda acc, b: case when len(list_filter(acc, lambda m: abs(b.cy-m.s/m.n)<=16))=0 then list_append(acc,{'s':b.cy,'n':1,'w':[b]})
 else list_transform(acc, lambda m, i: case when i=list_position(list_transform(acc, lambda z: abs(b.cy-z.s/z.n)<=16), true) then {'s':m.s+b.cy,'n':m.n+1,'w':list_append(m.w,b)} else m end) end, [{'s':ws[1].cy,'n':1,'w':[ws[1]]}]) as ls from g),
u as (select doc_id, unnest(ls) as l, generate_subscripts(ls,1)-1 as line_no from f)
select doc_id, cast(line_no as int) as line_no, array_to_string(list_transform(list_sort(list_transform(l.w, lambda x: {'a':x.x1,'b':x.cy,'o':x.o,'t':x.t})), lambda x: x.t),' ') as text,
 round(list_sum(list_transform(l.w, lambda x: x.c*length(x.t)))/list_sum(list_transform(l.w, lambda x: length(x.t))),4) as confidence,
 list_min(list_transform(l.w, lambda x: x.x1)) as x1, list_min(list_transform(l.w, lambda x: x.y1)) as y1, list_max(list_transform(l.w, lambda x: x.x2)) as x2, list_max(list_transform(l.w, lambda x: x.y2)) as y2 from u""")

# --- faces ------------------------------------------------------------------------------------


def _verify(d: DataFrame) -> DataFrame:
    ids = d.select("doc_id").distinct()
    pairs = ids.select("doc_id", (F.col("doc_id") % 13 != 0).alias("document_ok"), F.lit(True).alias("selfie_ok"))
    near = F.when(F.col("doc_id") % 11 != 0, F.array(F.lit(1.0), F.col("doc_id") % 10 / 10.0))
    vectors = ids.select("doc_id", near.alias("document_vector"), F.array(F.lit(0.8), F.col("doc_id") % 7 / 3.0).alias("selfie_vector"))
    printed, live = d.where("ordinal % 2 = 1"), d.where("ordinal % 2 = 0")
    return verification.verify(pairs, printed, live, vectors).select("doc_id", "success", "status", "is_match", "similarity_score", "match_band", "ui_color", "selfie_faces")


def _verify_sql(quality: str) -> str:
    a, b = "(doc_id % 10)/10.0::double", "(doc_id % 7)/3.0::double"
    score = f"round(greatest(0.0,least(1.0,(0.8+{a}*{b})/(sqrt(1+{a}*{a})*sqrt(0.64::double+{b}*{b})))),4)"
    return f"""with q as (select * from {quality}), ids as (select distinct doc_id from q),
p as (select doc_id, quality_passed as ok from (select *, row_number() over (partition by doc_id order by w*h*confidence desc, ordinal) as n from q where ordinal % 2 = 1) x where n=1),
s as (select doc_id, count(*) as n_faces, case when max(case when n=2 then w*h end)>=0.3*max(case when n=1 then w*h end) then 'MULTIPLE_FACES' when max(case when n=1 then quality_passed::int end)=1 then 'OK' else 'INSUFFICIENT_QUALITY' end as st from (select *, row_number() over (partition by doc_id order by w*h desc, ordinal) as n from q where ordinal % 2 = 0) x group by doc_id),
m as (select ids.doc_id, p.doc_id is not null as has_p, p.ok, coalesce(s.n_faces,0) as sf, s.st, {score.replace('doc_id', 'ids.doc_id')} as sc from ids left join p using (doc_id) left join s using (doc_id)),
e as (select *, case when doc_id % 13 = 0 then 'PROCESSING_ERROR' when not has_p or sf=0 then 'NO_FACE' when st='MULTIPLE_FACES' then 'MULTIPLE_FACES' when not (ok and st='OK') then 'INSUFFICIENT_QUALITY' when doc_id % 11 = 0 then 'PROCESSING_ERROR' when sc>=0.75 then 'MATCH' else 'NO_MATCH' end as status from m),
r as (select *, case when status in ('MATCH','NO_MATCH') then sc end as score from e)
select doc_id, status<>'PROCESSING_ERROR' as success, status, score>=0.75 as is_match, score as similarity_score, case when score is null then 'NOT_EVALUATED' when score>=0.8 then 'STRONG_MATCH' when score>=0.75 then 'BORDERLINE_MATCH' when score>=0.6 then 'MANUAL_REVIEW' else 'NO_MATCH' end as match_band, case when score is null then 'GRAY' when score>=0.8 then 'GREEN' when score>=0.75 then 'YELLOW' when score>=0.6 then 'ORANGE' else 'RED' end as ui_color, sf as selfie_faces from r"""


# --- forensic analysis ------------------------------------------------------------------------

_ANALYZED = ("zones", "blocks", "metadata", "matches")


def _pages(z: DataFrame) -> DataFrame:
    """Every tenth page can't be read; the others are 100 to 999 pixels wide."""
    wide = F.when(F.col("doc_id") % 10 != 0, F.col("doc_id") % 900 + 100).cast("int")
    return z.select("doc_id", wide.alias("width"), F.when(F.col("doc_id") % 10 != 0, 300).alias("height"))


def _parts(z: DataFrame, b: DataFrame, m: DataFrame, p: DataFrame) -> tuple[DataFrame, ...]:
    from .registry import zone_maps

    measured = b.select("doc_id", "block", F.col("value").alias("ela"), F.col("value").alias("noise"), F.col("value").alias("sharpness"))
    tags = m.select("doc_id", F.filter(F.array("software"), lambda s: s != "").alias("values"))
    return measured, tags, tamper.cross_zone(zone_maps(z)), tamper.copy_move_clusters(p)


def _signals(z: DataFrame, b: DataFrame, m: DataFrame, p: DataFrame) -> DataFrame:
    pages = _pages(z).select("doc_id", F.col("width").isNotNull().alias("has_image"))
    return analysis.signals(pages, *_parts(z, b, m, p)).select("doc_id", "signal", "score", "evaluated", "reason")


def _analyze(z: DataFrame, b: DataFrame, m: DataFrame, p: DataFrame) -> DataFrame:
    out = analysis.analyze(_pages(z), *_parts(z, b, m, p))
    return out.select("doc_id", "risk", "risk_level", "coverage", F.size("indicators").alias("n_indicators"), F.get("indicators", F.lit(0))["type"].alias("first"), F.size("warnings").alias("n_warnings"))


def _signals_sql() -> str:
    weights = {"ela": (0.35, "tamper_block_outliers"), "noise": (0.15, "noise_block_outliers"), "edge_texture": (0.10, "edge_texture"), "copy_move": (0.15, "copy_move_score"), "metadata": (0.10, "metadata_editor"), "document_consistency": (0.35, "cross_zone_score")}
    rows = []
    for name, (weight, query) in weights.items():
        seen = {"copy_move": "d.doc_id % 10 <> 0", "metadata": "x.score is not null"}.get(name, "x.doc_id is not null")
        none = "NO_METADATA" if name == "metadata" else "INSUFFICIENT_EVIDENCE"
        rows.append(f"select d.doc_id, '{name}' as signal, cast(case when {seen} then coalesce(x.score,0) else 0 end as double) as score, cast({weight} as double) as weight, {seen} as evaluated, case when not ({seen}) then '{none}' when coalesce(x.score,0)>0 then 'EVALUATED' else 'NO_ANOMALY_FOUND' end as reason from (select doc_id from ({SQL['zones']}) z) d left join {_inner(query)} x on x.doc_id=d.doc_id")
    return "(" + " union all ".join(rows) + ")"


def _analyze_sql() -> str:
    fused = ORACLE_SQL["tamper_fuse"].replace(f"({SQL['signals']}) src", "sig src")
    shown = "case signal when 'metadata' then score>0 when 'document_consistency' then score>0 when 'edge_texture' then score>0 when 'copy_move' then score>0 else score>=0.3 end"
    kind = "case signal when 'ela' then 'ela_local_inconsistency' when 'noise' then 'noise_inconsistency' when 'metadata' then 'editing_software_metadata' when 'document_consistency' then 'document_consistency_mismatch' when 'edge_texture' then 'edge_texture_inconsistency' else 'copy_move' end"
    return f"""with sig as (select * from {_signals_sql()} s), f as ({fused}), i as (select doc_id, count(*) as n, arg_min({kind}, (-score, {kind})) as first from sig where evaluated and {shown} group by doc_id), c as (select doc_id, max(case when signal='document_consistency' then evaluated::int end)=1 as has_fields from sig group by doc_id)
select c.doc_id, case when bare then 0.0 else risk end as risk, case when bare then 'LOW' else risk_level end as risk_level, case when bare then 0.0 else coverage end as coverage, cast(coalesce(n,0) as int) as n_indicators, first, case when c.doc_id % 10 = 0 then 1 when least(c.doc_id % 900 + 100, 300)<200 then 1 else 0 end as n_warnings
from (select *, doc_id % 10 = 0 and not has_fields as bare from c) c left join f on f.doc_id=c.doc_id left join i on i.doc_id=c.doc_id"""


register("metadata_older", "metadata", lambda d: analysis.older_metadata(d.withColumn("tags", F.create_map(F.lit("Software"), F.col("software"), F.lit("DateTime"), F.lit("b"), F.lit("DateTimeOriginal"), F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b")))).select("doc_id", "score", "timestamp_mismatch"),
         "select doc_id, cast(case when regexp_matches(lower(software),'photoshop|gimp|gnu image manipulation program|lightroom|affinity photo|paint.net|photopea|coreldraw|pixelmator|canva|indesign|picsart|snapseed|pixlr|seashore') then 0.4 when doc_id % 3 = 0 then 0.25 else 0.0 end as double) as score, doc_id % 3 = 0 as timestamp_mismatch from {src}")

_CARD_RULES = "select * from values ('driving_card', 'document_type', 1, null, '^Driving card', null, null), ('driving_card', 'id_number', 1, 'ID No', '([A-Z0-9]{5,12})', '[A-Z]{2}[0-9]+', 'upper'), ('driving_card', 'born', 1, 'Year of Birth', '([0-9]{4})', null, null), ('driving_card', 'authority', 1, 'Authority', '([A-Za-z ]{3,40})', null, 'upper') as rules(document_type, field, priority, label, value, allowed, spelling)"


def _by_rules(d: DataFrame, r: DataFrame) -> DataFrame:
    """A fourth type of document that is nothing but rows of a table."""
    rules = d.sparkSession.sql(_CARD_RULES)
    _, fused, _ = extraction.extract(d.select("doc_id", "text", "requested"), r, _zoned(d), rules=rules, wanted=("driving_card",))
    return fused.select("doc_id", "field", "value", "source")


register_many("document_rules", ("documents_src", "regions"), _by_rules,
              "select doc_id, field, value, 'visual_ocr' as source from (select doc_id, unnest(['id_number', 'born', 'authority']) as field, unnest([regexp_extract(text, 'ID No: ([A-Z0-9]{5,12})', 1), regexp_extract(text, 'Year of Birth: ([0-9]{4})', 1), upper(regexp_extract(text, 'Authority: ([A-Za-z ]{3,40})', 1))]) as value from {src0} where not detected and text like 'Driving card%') c where value <> ''")


# --- submissions ------------------------------------------------------------------------------


def _submitted(d: DataFrame) -> DataFrame:
    key = F.col("screening_id")
    claims = d.select(key, "created_at", "claimed_nationality")
    passports = d.select(key, "passport_number", F.col("passport_name").alias("full_name"), F.col("passport_dob").alias("date_of_birth"), F.col("passport_expiry").alias("expiry_date"), F.col("passport_nationality").alias("nationality"), "mrz_ok")
    visas = d.select(key, "visa_number", "visa_text", F.col("visa_until").alias("valid_until"), "stay_days")
    ids = d.where("stay_days <> 7").select(key, F.concat(F.lit("N"), key).alias("id_number"), F.col("nid_name").alias("full_name"), F.col("nid_dob").alias("date_of_birth"))
    return records.submissions(claims, passports, visas, ids, d.select(key, F.lit("face.png").alias("path")))


def _screened(d: DataFrame) -> DataFrame:
    rows = records.screening_rows(_submitted(d), d.select("screening_id", "face_score", "photo_score", "metadata_anomaly"))
    return screening.assess(screening.validate(rows.withColumn("anomalies", F.array().cast("array<string>")), "2024-06-01"))


register("submission_missing", "screening_src", lambda d: records.missing_documents(d.select("screening_id"), passport=d.select("screening_id"), national_id=d.where("stay_days <> 7").select("screening_id")).select("screening_id", F.array_join("missing", ",").alias("missing")), "select screening_id, 'national_id' as missing from {src} where stay_days=7")


register("find_by_national_id", "screening_src", lambda d: records.find_by_national_id(d, d.select("screening_id", F.concat(F.lit("N"), "screening_id").alias("id_number")), "N7").select("screening_id", "passport_number", "nid_name"), "select screening_id, passport_number, nid_name from {src} where 'N'||screening_id='N7'")


def _banner(d: DataFrame) -> DataFrame:
    shown = _screened(d).select("screening_id", records.verdict_banner(F.col("verdict"))["colour"].alias("colour"), records.status_label(F.col("status"))["label"].alias("label"), records.risk_colour(F.col("risk")).alias("bar"))
    return shown.groupBy("colour", "label", "bar").agg(F.count(F.lit(1)).alias("n"))


# --- image geometry ---------------------------------------------------------------------------

_PAGE = "select p_partkey as doc_id, cast(p_partkey % 5000 + 40 as int) as width, cast(p_partkey * 7 % 3000 + 15 as int) as height from part"


def _page_sizes(d: DataFrame) -> DataFrame:
    return d.select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 5000 + 40).cast("int").alias("width"), (F.col("p_partkey") * 7 % 3000 + 15).cast("int").alias("height"))


register_table("image_resize", lambda d: _page_sizes(d).select("doc_id", images.resized(F.col("width"), F.col("height")).alias("r")).select("doc_id", F.round("r.scale", 9).alias("scale"), F.col("r.width").alias("width"), F.col("r.height").alias("height")), "part",
               f"select doc_id, round(s,9) as scale, cast(floor(width*s) as int) as width, cast(floor(height*s) as int) as height from (select *, case when greatest(width,height)>2400 then 2400.0::double/greatest(width,height) when least(width,height)<300 then 300.0::double/least(width,height) else 1.0::double end as s from ({_PAGE}) p) q")
register_table("image_zone_bands", lambda d: images.zone_bands(_page_sizes(d)), "part",
               f"select doc_id, r as ratio, y1, height as y2 from (select *, greatest(0, least(cast(floor(height*(1.0::double-r)) as int), height-10)) as y1 from ({_PAGE}) p, (select unnest([0.2,0.25,0.3,0.35,0.4]::double[]) as r) x) q where height-y1>=20 and width>=50")
register_table("image_zone_passes", lambda d: images.zone_passes(images.zone_bands(_page_sizes(d))).groupBy("source").agg(F.count(F.lit(1)).alias("n")), "part",
               f"select f||'_r'||cast(floor(r*100) as int)||'_psm'||m as source, count(*) as n from (select *, greatest(0, least(cast(floor(height*(1.0::double-r)) as int), height-10)) as y1 from ({_PAGE}) p, (select unnest([0.2,0.25,0.3,0.35,0.4]::double[]) as r) x) q, (select unnest(['clahe','otsu','adaptive','blackhat']) as f) y, (select unnest([6,4,11]) as m) z where height-y1>=20 and width>=50 group by 1")


def _corners(d: DataFrame) -> DataFrame:
    at = lambda a, b: F.struct((F.col("p_partkey") * a % 97).cast("int").alias("x"), (F.col("p_partkey") * b % 89).cast("int").alias("y"))
    found = d.select(F.col("p_partkey").alias("doc_id"), images.ordered_corners(F.array(at(3, 5), at(7, 2), at(11, 13), at(17, 19))).alias("c"))
    return found.select("doc_id", *[F.concat_ws(",", f"c.{k}.x", f"c.{k}.y").alias(k) for k in ("top_left", "top_right", "bottom_right", "bottom_left")], images.flattened_size(F.col("c"))["width"].alias("width"), images.flattened_size(F.col("c"))["height"].alias("height"))


_CORNER = lambda key: f"list_sort(list_transform(ps, lambda p, i: {{'k':{key},'i':i,'p':p}}))[1].p"
_SIDE = lambda a, b: f"cast(floor(sqrt(({a}.x-{b}.x)^2+({a}.y-{b}.y)^2)) as int)"
register_table("image_corners", _corners, "part",
               f"select doc_id, a.x||','||a.y as top_left, b.x||','||b.y as top_right, c.x||','||c.y as bottom_right, d.x||','||d.y as bottom_left, greatest({_SIDE('c', 'd')},{_SIDE('b', 'a')}) as width, greatest({_SIDE('b', 'c')},{_SIDE('a', 'd')}) as height from (select doc_id, {_CORNER('p.x+p.y')} as a, {_CORNER('p.y-p.x')} as b, {_CORNER('-(p.x+p.y)')} as c, {_CORNER('p.x-p.y')} as d from (select p_partkey as doc_id, [{','.join(f'{{{chr(39)}x{chr(39)}:cast(p_partkey*{u} % 97 as int),{chr(39)}y{chr(39)}:cast(p_partkey*{v} % 89 as int)}}' for u, v in ((3, 5), (7, 2), (11, 13), (17, 19)))}] as ps from part) x) y")
register("ocr_allowed_signs", "raw_lines", lambda d: d.select("k", *[images.allowed_signs(F.col("raw"), f).alias(f) for f in ("dob", "gender", "mrz", "other")]),
         r"select k, regexp_replace(raw,'[^0-9/\-. ]','','g') as dob, regexp_replace(raw,'[^A-Za-z/ ]','','g') as gender, regexp_replace(upper(raw),'[^A-Z0-9< \t]','','g') as mrz, regexp_replace(raw,'[^A-Za-z0-9/\-. ]','','g') as other from {src}")
register_table("ocr_sample_regions", lambda d: images.sample_recognition(d.select(F.col("n_nationkey").alias("doc_id"))).select("doc_id", "ordinal", "text", "y1"), "nation",
               "select n_nationkey as doc_id, cast(o as int) as ordinal, case o when 0 then 'P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<' else 'L898902C36UTO7408122F1204159ZE184226B<<<<<10' end as text, cast(400+40*o as int) as y1 from nation, (select unnest([0,1]) as o) x")


def register_composed(face_quality: str) -> None:
    """Queries whose SQL is put together from that of others; called once those are registered."""
    register("face_verify", "faces", _verify, _verify_sql(face_quality.replace("{src}", f"({SQL['faces']}) src")))
    register_many("forensic_signals", _ANALYZED, _signals, f"select doc_id, signal, score, evaluated, reason from {_signals_sql()} s")
    register_many("tamper_analyze", _ANALYZED, _analyze, _analyze_sql())
    verdict = f"(select v.* from {_inner('verdict')} v join ({SQL['screening_src']}) s on s.screening_id=v.screening_id where s.stay_days<>7)"
    register("submission_verdict", "screening_src", lambda d: _screened(d).select("screening_id", "risk", "category", "verdict", "status"), f"select screening_id, risk, category, verdict, status from {verdict} v")
    register("verdict_banner", "screening_src", _banner, f"select case verdict when 'ALLOW' then 'emerald' when 'REJECT' then 'rose' else 'amber' end as colour, case status when 'PASSED' then 'VERIFIED & CLEARED' else 'PROCESSING OCR' end as label, case when risk<30 then 'emerald' when risk<60 then 'amber' else 'rose' end as bar, count(*) as n from {verdict} v group by all")
