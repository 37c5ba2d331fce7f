"""Names of all registered queries, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compare, fields
from ..functions.countries import correct_country
from ..functions.mrz_digits import check_digit, digits_from_ocr, is_valid_digit, letters_from_ocr
from ..functions.mrz_lines import clean_name, normalize_line
from ..functions.mrz_parse import parse
from ..operators import candidates, evaluation, faces, regions, screening, tamper
from ..streaming import events
from . import mrz_sql, whole
from . import printed as _printed  # noqa: F401 - registers the queries over printed text
from .base import ORACLE_SQL, QUERIES, register, register_table
from .inputs import SQL

AS_OF = "2024-06-01"


# --- characters and lines ---------------------------------------------------------------------

register("mrz_check_digit", "passport_src", lambda d: d.select("k", check_digit(F.col("num"), 9).cast("int").alias("number_digit"), check_digit(F.concat("surname", F.lit("<"), "given")).cast("int").alias("name_digit")),
         f"select k, cast({mrz_sql.total('num', 9)} % 10 as int) as number_digit, cast(list_sum([greatest(instr('{mrz_sql.ALPHABET}', substr(surname||'<'||given, i, 1))-1, 0)*([7,3,1])[(i-1)%3+1] for i in range(1, length(surname||'<'||given)+1)]) % 10 as int) as name_digit from {{src}}")
register("mrz_check_digit_validate", "passport_src", lambda d: d.select("k", is_valid_digit(F.substring("line2", 1, 9), F.substring("line2", 10, 1), 9).alias("number_ok"), is_valid_digit(F.substring("line2", 29, 14), F.substring("line2", 43, 1)).alias("filler_ok")),
         f"select k, {mrz_sql.fits(mrz_sql.total('substr(line2,1,9)', 9), 'substr(line2,1,9)', 'substr(line2,10,1)')} as number_ok, length(line2) > 42 as filler_ok from {{src}}")
register("mrz_normalize_line", "raw_lines", lambda d: d.select("k", normalize_line(F.col("raw")).alias("line")),
         "select k, regexp_replace(case when l like 'P%' and (instr(l,'<')>0 or not regexp_matches(substr(l,1,5),'[0-9]')) then replace(l,' ','<') else replace(l,' ','') end, '[^A-Z0-9<]', '', 'g') as line from (select k, translate(upper(trim(raw)),'«‹{([]|','<<<<<<<') as l from {src}) x")
register("mrz_name_clean", "raw_lines", lambda d: d.select("k", clean_name(F.col("name")).alias("name")), f"select k, {mrz_sql.clean_name('name')} as name from {{src}}")
register("ocr_digit_alpha_normalize", "raw_lines", lambda d: d.select("k", digits_from_ocr(F.col("raw")).alias("digits"), letters_from_ocr(F.col("raw")).alias("letters")),
         f"select k, translate(raw,'ODQILlZSB','000111258') as digits, translate(raw,'01258','OIZSB') as letters from {{src}}")
register("mrz_country_correct", "mrva_src", lambda d: d.select("k", F.substring("line1", 3, 3).alias("raw"), correct_country(F.substring("line1", 3, 3)).alias("code")), f"select k, substr(line1,3,3) as raw, {mrz_sql.country('substr(line1,3,3)')} as code from {{src}}")


# --- machine-readable zones -------------------------------------------------------------------


def _zone(kind: str, lines: int) -> Callable[[DataFrame], DataFrame]:
    return lambda d: parse(d, kind, [f"line{k}" for k in range(1, lines + 1)]).select("k", *[F.col(f"mrz.{c}").alias(c) for c in mrz_sql.COLUMNS])


for _name, _kind, _src, _lines in (("mrz_td3_parse", "TD3", "passport_src", 2), ("mrz_mrva_parse", "MRVA", "mrva_src", 2), ("mrz_mrvb_parse", "MRVB", "mrvb_src", 2), ("mrz_td1_parse", "TD1", "td1_src", 3), ("mrz_td2_parse", "TD2", "td2_src", 2)):
    register(_name, _src, _zone(_kind, _lines), mrz_sql.parse_sql(_kind, _src))



def _log():
    return F.transform("mrz.corrections", lambda c: F.concat_ws(":", c["line"].cast("string"), c["position"].cast("string"), c["from_char"], c["to_char"], c["field"]))


register("mrz_td3_corrections", "passport_src", lambda d: parse(d, "TD3", ["line1", "line2"]).select("k", "mrz.raw_line2", "mrz.line2", F.array_join(_log(), ";").alias("log")), mrz_sql.td3_log_sql("passport_src"))
register("mrz_candidate_groups", "candidate_src", lambda d: candidates.candidate_groups(d).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("group_kind") == 0).alias("triplets")),
         "with l as (select doc_id, source, generate_subscripts(string_split(text, chr(10)),1) as p, unnest(string_split(text, chr(10))) as line from {src}), c as (select *, row_number() over (partition by doc_id, source order by p) as i, length(trim(line)) as n, lead(length(trim(line)),1) over (partition by doc_id, source order by p) as n2, lead(length(trim(line)),2) over (partition by doc_id, source order by p) as n3 from l where length(trim(line))>=12) select doc_id, source, cast(sum((n2 is not null)::int + (n3 is not null)::int + (n3 is not null and (n between 24 and 34 or n2 between 24 and 34 or n3 between 24 and 34))::int) as bigint) as n, cast(sum((n3 is not null and (n between 24 and 34 or n2 between 24 and 34 or n3 between 24 and 34))::int) as bigint) as triplets from c group by all having sum((n2 is not null)::int) > 0")
_SCORED = mrz_sql.candidates_sql("{src}")
register("mrz_candidate_score", "candidate_src", lambda d: candidates.scored_candidates(d).select("doc_id", "source", "group_kind", "pos", F.col("mrz.format").alias("format"), F.round("score", 2).alias("score")), f"select doc_id, source, group_kind, pos, format, round(score,2) as score from {_SCORED} s where score>=40")
register("mrz_best_candidate", "candidate_src", lambda d: candidates.best_candidates(candidates.scored_candidates(d)).select("doc_id", "source", F.col("mrz.document_number").alias("document_number"), F.col("mrz.overall_valid").alias("overall_valid"), F.round("score", 2).alias("score")), f"select doc_id, source, document_number, overall_valid, round(score,2) as score from {_SCORED} s where rank=1 and score>=80")
register("mrz_top8_debug", "candidate_src", lambda d: candidates.candidate_debug(candidates.scored_candidates(d)).select("doc_id", "candidate_count", F.to_json("top").alias("top")), f"select doc_id, count(*) as candidate_count, to_json(list({{'rank':rank,'source':source,'score':round(score,2),'format':format}} order by rank) filter (rank<=8)) as top from {_SCORED} s where score>=40 group by doc_id")

# --- texts -----------------------------------------------------------------------------------

register_table("english_token_clean", lambda d: d.select("conv_id", "turn", fields.english_token(F.col("text")).alias("clean")), "conversations", "select conv_id, turn, trim(regexp_replace(regexp_replace(text,'[^\\x20-\\x7E]',' ','g'),'\\s+',' ','g')) as clean from conversations")
register_table("pii_mask", lambda d: d.select("conv_id", "turn", fields.mask_personal_data(F.col("text")).alias("masked")), "conversations", "select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text,'(?i)[A-Z0-9]{8,12}','***ID***','g'),'\\b[0-9]{2}[01][0-9][0-3][0-9]\\b','***DOB***','g'),'(?i)[P|V|I]<[A-Z0-9<]{30,44}','***MRZ_LINE***','g') as masked from conversations")
# --- regions ----------------------------------------------------------------------------------

register("ocr_confidence_normalize", "regions", lambda d: d.select("doc_id", "ordinal", regions.unit_confidence(F.col("confidence") * 100 - 5).alias("confidence")),
         "select doc_id, ordinal, case when s<0 then 0.0 when s<=1 then round(s,4) else round(least(1.0,greatest(0.0,s/100.0)),4) end as confidence from (select doc_id, ordinal, confidence*100-5 as s from {src}) x")
register("ocr_confidence_avg", "regions", lambda d: regions.average_confidence(d), "select doc_id, coalesce(round(sum(case when n>0 then confidence*n end)/nullif(sum(case when n>0 then n end),0),4),0.0) as average_confidence from (select *, length(trim(text)) as n from {src}) x group by doc_id")
register("region_confidence", "regions", lambda d: regions.value_confidence(d.select("doc_id").distinct().withColumn("value", F.lit("rostova")), d),
         "select d.doc_id, 'rostova' as value, coalesce(arg_min(r.confidence, (r.y1,r.x1,r.ordinal,r.confidence)), 0.85) as confidence from (select distinct doc_id from {src}) d left join (select * from {src2}) r on r.doc_id=d.doc_id and instr(lower(r.text),'rostova')>0 group by d.doc_id".replace("{src2}", f"({SQL['regions']}) src"))
_VALUE = r"([A-Z][a-z]+ [A-Z][a-z]+)"
register("spatial_value", "regions", lambda d: regions.spatial_values(d, r"\bName\b", _VALUE),
         "with p as (select *, row_number() over (partition by doc_id order by y1,x1,ordinal,text,confidence) as place from {src}), c as (select l.doc_id, l.place as lp, case when abs((o.y1+o.y2)/2.0-(l.y1+l.y2)/2.0) <= greatest(18.0,(l.y2-l.y1)*0.9) and o.x1>=l.x1+5 then 1 when o.y1>=l.y1 and o.y1-l.y2<=greatest(35.0,(l.y2-l.y1)*2.0) and o.x1<=l.x2+80 and o.x2>=l.x1-40 then 2 end as way, o.* from p l join p o on o.doc_id=l.doc_id and o.place<>l.place where regexp_matches(trim(l.text),'(?i)\\bName\\b') and regexp_matches(o.text,'[A-Z][a-z]+ [A-Z][a-z]+')), d as (select c.*, case when way=1 then c.x1-l.x2 else c.y1-l.y2 end as dist from c join p l on l.doc_id=c.doc_id and l.place=c.lp where way is not null) select doc_id, trim(regexp_extract(text,'([A-Z][a-z]+ [A-Z][a-z]+)',1)) as value, confidence from (select *, row_number() over (partition by doc_id order by lp,way,dist,place) as n from d) x where n=1")
register("crop_geometry", "regions", lambda d: regions.crop_boxes(d.withColumn("img_w", F.lit(640)).withColumn("img_h", F.lit(480)).where(F.col("text").rlike(r"\b(?:DOB|Birth)\b")), "img_w", "img_h").groupBy("crop").agg(F.count(F.lit(1)).alias("n"), F.sum("cx1").alias("sx1"), F.sum("cy1").alias("sy1"), F.sum("cx2").alias("sx2"), F.sum("cy2").alias("sy2")),
         "with r as (select *, greatest(12,y2-y1) as h from {src} where regexp_matches(text, '\\bDOB\\b')), b as (" + " union all ".join([f"select 'right_var_{k + 1}' as crop, greatest(0,x2-5) as a, greatest(0,y1-cast(floor(h*cast({0.2 + 0.15 * k!r} as double)) as int)) as b, least(640,x2+cast(floor(h*{m}) as int)) as c, least(480,y2+cast(floor(h*cast({0.2 + 0.15 * k!r} as double)) as int)) as d from r" for k, m in enumerate((5.0, 7.0, 9.0))] + ["select 'below', greatest(0,x1-10), greatest(0,y2-2), least(640,x2+cast(floor(h*4.0) as int)), least(480,y2+cast(floor(h*cast(2.2 as double)) as int)) from r", "select 'combined_line', greatest(0,x1-5), greatest(0,y1-cast(floor(h*0.25) as int)), least(640,x2+cast(floor(h*7.0) as int)), least(480,y2+cast(floor(h*0.25) as int)) from r"]) + ") select crop, count(*) as n, cast(sum(a) as bigint) as sx1, cast(sum(b) as bigint) as sy1, cast(sum(c) as bigint) as sx2, cast(sum(d) as bigint) as sy2 from b where c-a>=20 and d-b>=10 group by crop")

# --- comparison and forensic signals ------------------------------------------------------------

_MON = "(instr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC',substr(regexp_extract(t,'^([0-9]{1,2})[\\s/-]*([A-Z]{3,9})[\\s/-]*([0-9]{2,4})$',2),1,3))+2)/3.0"


def _cdate(e: str) -> str:
    """DuckDB: a subquery-free comparable date over ``e`` (already trimmed and in upper case)."""
    dmy, ymd, named = "^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{2,4})$", "^([0-9]{4})[/.-]([0-9]{1,2})[/.-]([0-9]{1,2})$", "^([0-9]{1,2})[\\s/-]*([A-Z]{3,9})[\\s/-]*([0-9]{2,4})$"
    g = lambda p, k: f"regexp_extract({e},'{p}',{k})"
    digits = f"regexp_replace({e},'[^0-9]','','g')"
    mon = _MON.replace("regexp_extract(t,", f"regexp_extract({e},")
    return f"case when regexp_full_match({e},'[0-9]{{6}}') then {e} when regexp_matches({e},'{dmy}') then right({g(dmy, 3)},2)||lpad({g(dmy, 2)},2,'0')||lpad({g(dmy, 1)},2,'0') when regexp_matches({e},'{ymd}') then substr({g(ymd, 1)},3,2)||lpad({g(ymd, 2)},2,'0')||lpad({g(ymd, 3)},2,'0') when regexp_matches({e},'{named}') and {mon}>0.9 and {mon}=floor({mon}) then right({g(named, 3)},2)||lpad(cast(cast({mon} as int) as varchar),2,'0')||lpad({g(named, 1)},2,'0') when length({digits})=6 then {digits} when length({digits})=8 and cast(substr({digits},5,4) as int)>1900 then substr({digits},7,2)||substr({digits},3,2)||substr({digits},1,2) when length({digits})=8 and cast(substr({digits},1,4) as int)>1900 then substr({digits},3,6) end"


_cnum = lambda e: f"upper(regexp_replace(coalesce({e},''),'[^A-Za-z0-9]','','g'))"
register("date_normalize", "dates", lambda d: d.select("k", compare.comparable_date(F.col("raw")).alias("yymmdd")), f"select k, {_cdate('u')} as yymmdd from (select k, upper(trim(raw)) as u from {{src}}) x")
_csex = lambda e: f"case when upper(trim({e})) in ('M','MALE','HOMME','MASCULINE','MASCULIN') then 'M' when upper(trim({e})) in ('F','FEMALE','FEMME','FEMININE','FEMININ') then 'F' when upper(trim({e})) in ('X','UNSPECIFIED','<') then 'X' else substr(upper(trim({e})),1,1) end"
_cname = lambda e: f"trim(regexp_replace(upper(regexp_replace({e},'[^A-Za-z\\s]',' ','g')),'\\s+',' ','g'))"
register("compare_normalizers", "zones", lambda d: d.select("doc_id", compare.comparable_number(F.col("v_num")).alias("num"), compare.comparable_name(F.col("v_name")).alias("name"), compare.comparable_sex(F.col("v_sex")).alias("sex"), compare.comparable_nationality(F.col("m_name")).alias("nat")),
         f"select doc_id, {_cnum('v_num')} as num, {_cname('v_name')} as name, {_csex('v_sex')} as sex, substr(upper(regexp_replace(m_name,'[^A-Za-z]','','g')),1,3) as nat from {{src}}")


def zone_maps(d: DataFrame) -> DataFrame:
    m = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), F.col(v))])
    conf = F.create_map(*[x for k in ("passport_number", "dob", "full_name", "sex") for x in (F.lit(k), F.col("conf"))])
    return d.select("doc_id", m(passport_number="v_num", dob="v_dob", full_name="v_name", sex="v_sex").alias("visual"), m(document_number="m_num", date_of_birth="m_dob", name="m_name", sex="m_sex").alias("mrz"), conf.alias("confidences"))


_SUB = lambda a, b: f"len(list_filter(string_split({a},' '), lambda w: not list_contains(string_split({b},' '),w)))=0"
_CROSS = f"""with z as (select doc_id, conf, {_cnum('v_num')} as vn, {_cnum('m_num')} as mn, {_cdate('upper(trim(v_dob))')} as vd, m_dob as md, {_cname('v_name')} as va, {_cname('m_name')} as ma, {_csex('v_sex')} as vs, {_csex('m_sex')} as ms from {{src}}),
c as (select doc_id, 'document_number' as field, vn as visual_norm, mn as mrz_norm, vn=mn as match, cast(0.9 as double) as weight, conf from z union all select doc_id,'date_of_birth',vd,md,vd=md,cast(0.9 as double),conf from z union all select doc_id,'name',va,ma,va=ma or {_SUB('va', 'ma')} or {_SUB('ma', 'va')},cast(0.75 as double),conf from z where va<>'' union all select doc_id,'sex',vs,ms,vs=ms,cast(0.65 as double),conf from z)"""
register("cross_zone_compare", "zones", lambda d: tamper.cross_zone(zone_maps(d)).select("doc_id", "field", "visual_norm", "mrz_norm", "match", "weight", "counts"), _CROSS + " select doc_id, field, visual_norm, mrz_norm, match, weight, not match and conf>=0.35 as counts from c")
register("cross_zone_score", "zones", lambda d: tamper.consistency_signal(tamper.cross_zone(zone_maps(d))),
         _CROSS + " select doc_id, n_fields, n_mismatches, score, case when score=0 then 'LOW' when score>=0.85 then 'HIGH' else 'MEDIUM' end as severity from (select doc_id, count(*) as n_fields, cast(count(*) filter (not match and conf>=0.35) as bigint) as n_mismatches, coalesce(round(max(case when not match and conf>=0.35 then weight end),4),0.0) as score from c group by doc_id) x")
register("tamper_fuse", "signals", tamper.fuse,
         "select doc_id, risk, coverage, elevated, case when risk>=0.65 then case when elevated>=2 or strong>0 then 'HIGH' else 'MEDIUM' end when risk>=0.3 then 'MEDIUM' else 'LOW' end as risk_level from (select doc_id, floor(10000*least(1.0,greatest(0.0,coalesce(cast(sum(case when evaluated then cast(weight*score as decimal(18,8)) end) as double)/nullif(cast(sum(case when evaluated then cast(weight as decimal(18,8)) end) as double),0),0.0)))+0.5000001)/10000.0 as risk, round(least(1.0,cast(coalesce(sum(case when evaluated then cast(weight as decimal(18,8)) end),0) as double)/cast(sum(cast(weight as decimal(18,8))) as double)),4) as coverage, count(*) filter (evaluated and score>=0.3) as elevated, count(*) filter (evaluated and score>=0.8) as strong from {src} where signal<>'other' and (evaluated or signal<>'document_consistency') group by doc_id) x")
_STATS = "with s as (select doc_id, value-m as dev, nb from (select *, quantile_cont(value,0.5) over (partition by doc_id) as m, count(*) over (partition by doc_id) as nb from {src}) a), t as (select *, quantile_cont(abs(dev),0.5) over (partition by doc_id) as mad from s)"
register("tamper_block_outliers", "blocks", tamper.ela_signal,
         _STATS + ", p as (select doc_id, count(*) filter (dev>=greatest(2.5,2.5*greatest(0.5,1.4826*mad))) as outliers, greatest(0.0,max(dev)) as largest, max(nb) as nb from t group by doc_id), q as (select *, outliers/greatest(1,nb) as ratio from p), r as (select *, cast(0.20 as double)+ratio*3.5+least(30.0,largest)/30.0*0.45 as b from q), u as (select *, case when outliers>=2 or largest>=15 then greatest(b,0.45) else b end as b1 from r), v as (select *, case when largest>=25 and ratio>=0.02 then greatest(b1,0.7) else b1 end as b2 from u) select doc_id, outliers, round(ratio,4) as outlier_ratio, round(largest,2) as largest_deviation, cast(case when outliers=0 or largest<2.5 or nb<4 then 0.0 else round(least(1.0,b2),4) end as double) as score from v")
register("noise_block_outliers", "blocks", tamper.noise_signal,
         _STATS + ", p as (select doc_id, count(*) filter (abs(dev)>=greatest(14.0,3.5*greatest(0.8,1.4826*mad))) as outliers, max(abs(dev)) as largest, max(nb) as nb from t group by doc_id), q as (select *, outliers/greatest(1,nb) as ratio from p) select doc_id, outliers, round(ratio,4) as outlier_ratio, round(largest,2) as largest_deviation, cast(case when outliers=0 or ratio<0.015 or largest<14 then 0.0 else round(least(1.0,cast(0.18 as double)+ratio*3.5+least(30.0,largest)/30.0*0.3),4) end as double) as score from q")
register("edge_texture", "blocks", tamper.edge_signal, "select doc_id, quantile_cont(value,0.5) as median, min(value) as least, cast(case when quantile_cont(value,0.5)>8 and quantile_cont(value,0.5)-min(value)>6 and min(value)<3 then 0.25 else 0.0 end as double) as score from {src} group by doc_id")
register("copy_move_bins", "matches", lambda d: tamper.copy_move_clusters(d),
         "with m as (select doc_id, sx, sy, tx, ty, tx-sx as dx, ty-sy as dy from {src} where sqrt((tx-sx)*(tx-sx)+(ty-sy)*(ty-sy))>=35), d as (select doc_id, case when f then tx else sx end as ax, case when f then ty else sy end as ay, case when f then sx else tx end as bx, case when f then sy else ty end as y2, case when f then -dx else dx end as ex, case when f then -dy else dy end as ey from (select *, dx<0 or (dx=0 and dy<0) as f from m) x), g as (select doc_id, cast(round_even(ex/20.0,0) as int) as bin_x, cast(round_even(ey/20.0,0) as int) as bin_y, count(*) as matches, cast(greatest(0,floor(min(ax)-15)) as int) as ax1, cast(greatest(0,floor(min(ay)-15)) as int) as ay1, cast(floor(max(ax)+15) as int) as ax2, cast(floor(max(ay)+15) as int) as ay2, cast(greatest(0,floor(min(bx)-15)) as int) as bx1, cast(greatest(0,floor(min(y2)-15)) as int) as by1, cast(floor(max(bx)+15) as int) as bx2, cast(floor(max(y2)+15) as int) as by2 from d group by all) select * from g where matches>=5 and ((not (not (ax2<bx1 or ax1>bx2 or ay2<by1 or ay1>by2)) and matches>=case when ay2-ay1<40 or by2-by1<40 or (ax2-ax1)/greatest(1,ay2-ay1)>2.5 then 10 else 5 end) or matches>=15)")
register("descriptor_matches", "points", lambda d: tamper.descriptor_matches(d.withColumn("descriptor", F.unhex("descriptor"))), """
with e as (select * from {src} where doc_id in (select doc_id from {src} group by doc_id having count(*) >= 25)),
n as (select *, list_transform(string_split(descriptor, ''), lambda c: instr('0123456789abcdef', c) - 1) as bits from e),
d as (select a.doc_id, a.point, a.x as sx, a.y as sy, b.point as other, b.x as tx, b.y as ty, list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: bit_count(xor(z[1]::int, z[2]::int))))::int as apart from n a join n b on a.doc_id = b.doc_id),
o as (select *, row_number() over (partition by doc_id, point order by apart, other) as place from d),
g as (select doc_id, point, any_value(sx) as sx, any_value(sy) as sy, max(case when place = 1 then other end) as o1, max(case when place = 3 then apart end) as a3, min_by(apart, place) filter (other <> point) as t, min_by(tx, place) filter (other <> point) as tx, min_by(ty, place) filter (other <> point) as ty from o where place <= 3 group by all)
select doc_id, sx, sy, tx, ty from g where case when o1 = point then t = 0 else a3 = 0 or t <= 0.8 * a3 end""")
register("copy_move_score", "matches", lambda d: tamper.copy_move_signal(tamper.copy_move_clusters(d)), f"select doc_id, count(*) as clusters, max(matches) as most, cast(case when max(matches)>=12 or count(*)>=2 then 0.8 when max(matches)>=6 then 0.55 else 0.3 end as double) as score from ({ORACLE_SQL['copy_move_bins']}) c group by doc_id")
#: Words that name image editors, in order of precedence.
_EDITORS = ("adobe photoshop", "photoshop", "gimp", "gnu image manipulation program", "lightroom", "affinity photo", "paint.net", "photopea", "coreldraw", "pixelmator", "canva", "indesign", "picsart", "snapseed", "pixlr", "seashore")
register("metadata_editor", "metadata", lambda d: d.select("doc_id", tamper.metadata_score(F.filter(F.array("software"), lambda s: s != "")).alias("score"), tamper.detected_editor(F.lower("software")).alias("editor")),
         "select doc_id, case when software='' then null when editor is not null then cast(0.35 as double) else cast(0.0 as double) end as score, editor from (select *, case " + " ".join(f"when instr(lower(software),'{k}')>0 then '{k.title() if '.' not in k else k.capitalize()}'" for k in _EDITORS) + " end as editor from {src}) x")

# --- faces ------------------------------------------------------------------------------------


def _face_pairs(d: DataFrame) -> DataFrame:
    """Each vector beside a mixture of itself with the next one, in four shares."""
    nxt = d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    share = F.element_at(F.array(*map(F.lit, (0.9, 0.55, 0.5, 0.3))), (F.col("vec_id") % 4 + 1).cast("int"))
    return d.join(nxt, "vec_id").withColumn("a", share).withColumn("selfie", F.expr("zip_with(embedding, other, (x, y) -> a*x + (1-a)*y)")).withColumn("score", faces.public_score(faces.cosine(F.col("embedding"), F.col("selfie"))))


_PAIRS = "(select vec_id, round(greatest(0.0,least(1.0,list_dot_product(embedding,selfie)/(sqrt(list_dot_product(embedding,embedding))*sqrt(list_dot_product(selfie,selfie))))),4) as score from (select a.vec_id, a.embedding, list_transform(list_zip(a.embedding,b.embedding), lambda z: ([0.9,0.55,0.5,0.3])[a.vec_id%4+1]::double*z[1]+(1-([0.9,0.55,0.5,0.3])[a.vec_id%4+1]::double)*z[2]) as selfie from (select vec_id, embedding::double[] as embedding from embeddings) a join (select vec_id, embedding::double[] as embedding from embeddings) b on b.vec_id=a.vec_id+1) p) q"
register_table("face_cosine", lambda d: _face_pairs(d).select("vec_id", "score"), "embeddings", f"select vec_id, score from {_PAIRS}")
register_table("face_band", lambda d: _face_pairs(d).groupBy(faces.band(F.col("score")).alias("band"), faces.band_colour(F.col("score")).alias("colour")).agg(F.count(F.lit(1)).alias("n")), "embeddings", f"select case when score>=0.8 then 'STRONG_MATCH' when score>=0.75 then 'BORDERLINE_MATCH' when score>=0.6 then 'MANUAL_REVIEW' else 'NO_MATCH' end as band, case when score>=0.8 then 'GREEN' when score>=0.75 then 'YELLOW' when score>=0.6 then 'ORANGE' else 'RED' end as colour, count(*) as n from {_PAIRS} group by all")
register_table("face_far_frr", lambda d: evaluation.acceptance_rates(_face_pairs(d).select((F.col("vec_id") % 4 < 2).alias("genuine"), "score")), "embeddings", f"select n_genuine, n_impostor, round(mg,4) as mean_genuine, round(mi,4) as mean_impostor, round(mg-mi,4) as separation, false_accepts, false_rejects, round(false_accepts/greatest(1,n_impostor),4) as far, round(false_rejects/greatest(1,n_genuine),4) as frr from (select count(*) filter (g) as n_genuine, count(*) filter (not g) as n_impostor, avg(score) filter (g) as mg, avg(score) filter (not g) as mi, count(*) filter (not g and score>=0.75) as false_accepts, count(*) filter (g and score<0.75) as false_rejects from (select score, vec_id%4<2 as g from {_PAIRS}) y) z")
_Q = "(select *, floor((case when w<60 or h<60 then greatest(0.1,least(1.0,least(w,h)/60.0)) else 1.0 end + case when sharpness<40 then greatest(0.1,least(1.0,sharpness/40.0)) else least(1.0,0.70+sharpness/200.0*0.30) end + case when brightness<30 then greatest(0.1,brightness/30.0) when brightness>240 then greatest(0.1,(255.0-brightness)/15.0) else 1.0 end + case when h/greatest(1,w)<0.6 or h/greatest(1,w)>2 then 0.5 else 1.0 end)/4.0*10000+0.5000001)/10000.0 as quality_score, w>=60 and h>=60 and sharpness>=20 and brightness between 20 and 245 as quality_passed from {src}) f"
register("face_quality", "faces", lambda d: faces.with_quality(d).select("doc_id", "ordinal", "quality_score", "quality_passed"), f"select doc_id, ordinal, cast(quality_score as double) as quality_score, quality_passed from {_Q}")
register("portrait_pick", "faces", lambda d: faces.portraits(d).select("doc_id", "ordinal"), "select doc_id, ordinal from (select *, row_number() over (partition by doc_id order by w*h*confidence desc, ordinal) as n from {src}) x where n=1")
register("selfie_gate", "faces", lambda d: faces.selfie_gate(d), f"select doc_id, count(*) as n_faces, case when max(case when n=2 then w*h end)>=0.3*max(case when n=1 then w*h end) then 'MULTIPLE_FACES' when max(case when n=1 then quality_passed::int end)=1 then 'OK' else 'INSUFFICIENT_QUALITY' end as status from (select *, row_number() over (partition by doc_id order by w*h desc, ordinal) as n from {_Q}) x group by doc_id")

# --- screening --------------------------------------------------------------------------------


def _screenings(d: DataFrame) -> DataFrame:
    return d.withColumn("visa_type", screening.visa_type(F.col("visa_text"))).withColumn("anomalies", F.array().cast("array<string>"))


def _assessed(d: DataFrame) -> DataFrame:
    return screening.assess(screening.validate(_screenings(d), AS_OF))


_D = f"date '{AS_OF}'"
_AGE = "(case when da<0 then -1 else 1 end * ((abs(da)//32)//12))"
_VISA = "case replace(upper(trim(visa_text)),' ','_') when 'TOURIST' then 'TOURIST' when 'BUSINESS' then 'BUSINESS' when 'STUDENT' then 'STUDENT' when 'WORK_PERMIT' then 'WORK_PERMIT' when 'WORKPERMIT' then 'WORK_PERMIT' when 'TRANSIT' then 'TRANSIT' when 'DIPLOMATIC' then 'DIPLOMATIC' end"
_STAY = "case vt when 'TOURIST' then 90 when 'BUSINESS' then 180 when 'STUDENT' then 365 when 'WORK_PERMIT' then 730 when 'TRANSIT' then 5 when 'DIPLOMATIC' then 365 end"
_norm = lambda e: f"regexp_replace(lower(trim({e})),'[^a-z0-9]','','g')"
_RULES = {
    "passport_expired": f"case when passport_expiry<{_D} then 'Passport has expired on '||cast(passport_expiry as varchar) end",
    "visa_expired": f"case when visa_until<{_D} then 'Visa has expired on '||cast(visa_until as varchar) end",
    "age": f"case when {_AGE}<0 or {_AGE}>120 then 'Invalid date of birth: calculated age ('||{_AGE}||') is outside realistic human bounds' end",
    "nationality": "case when lower(passport_nationality)<>lower(trim(claimed_nationality)) then 'Claimed nationality ('||claimed_nationality||') mismatches passport nationality ('||passport_nationality||')' end",
    "name": f"case when {_norm('passport_name')}<>{_norm('nid_name')} then case when translate({_norm('passport_name')},'015','ols')=translate({_norm('nid_name')},'015','ols') then 'Suspicious character substitution detected between Passport name and National ID name' else 'Name mismatch between Passport ('||passport_name||') and National ID ('||nid_name||')' end end",
    "dob": "case when passport_dob<>nid_dob then 'Date of birth mismatch between Passport ('||cast(passport_dob as varchar)||') and National ID ('||cast(nid_dob as varchar)||')' end",
    "stay": f"case when stay_days>{_STAY} then 'Stay duration ('||stay_days||' days) exceeds maximum allowed threshold for '||vt||' ('||{_STAY}||' days)' when vt is null and visa_number is not null then 'Unrecognized or missing visa classification type' end",
    "mrz": "case when not mrz_ok then 'ICAO 9303 MRZ Checksum verification failed: Document number, DOB, or Expiry has been altered' end",
}
_BASE = f"(select *, {_VISA} as vt, ((year({_D})*12+month({_D}))*32+day({_D}))-((year(passport_dob)*12+month(passport_dob))*32+day(passport_dob)) as da from {{src}}) s"
_VALID = f"(select *, list_filter([{','.join(_RULES.values())}], lambda x: x is not null) as errors, {','.join(f'({v}) is null as ok_{k}' for k, v in _RULES.items())} from {_BASE}) v"
_RISK = f"(select *, least(100, (face_score<0.75)::int*40+(photo_score>0.5)::int*30+(len(errors)>0)::int*25+metadata_anomaly::int*15) as risk from {_VALID}) r"
for _rule in _RULES:
    _short = {"passport_expired": "rule_passport_expiry", "visa_expired": "rule_visa_expiry", "name": "rule_name_substitution", "stay": "rule_visa_stay"}.get(_rule, f"rule_{_rule}")
    register(_short, "screening_src", lambda d, r=_rule: _screenings(d).select("screening_id", screening.rules(F.lit(AS_OF).cast("date"))[r].alias("error")), f"select screening_id, {_RULES[_rule]} as error from {_BASE}")
register("validation_summary", "screening_src", lambda d: screening.validate(_screenings(d), AS_OF).select("screening_id", "is_valid", "name_consistent", "dob_consistent", "nationality_consistent", "expired", F.array_join("errors", "; ").alias("errors")),
         f"select screening_id, len(errors)=0 as is_valid, ok_name as name_consistent, ok_dob as dob_consistent, ok_nationality as nationality_consistent, not (ok_passport_expired and ok_visa_expired) as expired, array_to_string(errors,'; ') as errors from {_VALID}")
register("risk_score", "screening_src", lambda d: _assessed(d).select("screening_id", "risk"), f"select screening_id, cast(risk as int) as risk from {_RISK}")
_VERDICT = "case when risk>=60 then 'HIGH' when risk>=30 then 'MEDIUM' else 'LOW' end as category, case when risk>=60 then 'REJECT' when risk>=30 then 'MANUAL_REVIEW_REQUIRED' else 'ALLOW' end as verdict, case when risk>=30 then 'FLAGGED_FOR_ADMIN' else 'PASSED' end as status"
register("verdict", "screening_src", lambda d: _assessed(d).select("screening_id", "risk", "category", "verdict", "status"), f"select screening_id, cast(risk as int) as risk, {_VERDICT} from {_RISK}")
_REASONS = "array_to_string(list_concat(errors, list_filter([case when face_score<0.75 then 'Biometric facial similarity below threshold' end, case when photo_score>0.5 then 'Photo tampering detected by ELA' end, case when len(errors)>0 then 'Document failed field integrity / ICAO checksum checks' end, case when metadata_anomaly then 'Metadata anomaly or editing artifacts present' end], lambda x: x is not null)),'; ') as reasons"
register("flagged_reasons", "screening_src", lambda d: _assessed(d).select("screening_id", F.array_join("reasons", "; ").alias("reasons")), f"select screening_id, {_REASONS} from {_RISK}")
register("review_queue", "screening_src", lambda d: screening.review_queue(_assessed(d)).select("screening_id", "risk", "status", "created_at"), f"select screening_id, cast(risk as int) as risk, 'FLAGGED_FOR_ADMIN' as status, created_at from {_RISK} where risk>=30 order by created_at desc, screening_id limit 20")
register("review_queue_page_then_filter", "screening_src", lambda d: screening.review_queue(_assessed(d), page=1, page_first=True).select("screening_id", "risk", "status"), f"select screening_id, cast(risk as int) as risk, 'FLAGGED_FOR_ADMIN' as status from (select * from {_RISK} order by created_at desc, screening_id limit 20 offset 20) p where risk>=30")
register("find_by_passport", "screening_src", lambda d: screening.find_by_number(_screenings(d), "P00000007").select("screening_id", "passport_number", "passport_name"), "select screening_id, passport_number, passport_name from {src} where passport_number='P00000007'")

# --- evaluation -------------------------------------------------------------------------------

register("calibration_metrics", "samples", evaluation.calibration,
         "select n_clean, n_tampered, mean_clean, mean_tampered, tn, fp, fn, tp, round(coalesce(fp/nullif(n_clean,0),0.0),4) as fpr, round(coalesce(fn/nullif(n_tampered,0),0.0),4) as fnr, round(p,4) as precision, round(r,4) as recall, round(coalesce(2*p*r/nullif(p+r,0),0.0),4) as f1 from (select *, coalesce(tp/nullif(tp+fp,0),0.0) as p, coalesce(tp/nullif(tp+fn,0),0.0) as r from (select count(*) filter (not positive) as n_clean, count(*) filter (positive) as n_tampered, round(avg(score) filter (not positive),4) as mean_clean, round(avg(score) filter (positive),4) as mean_tampered, count(*) filter (not positive and score<=0.35) as tn, count(*) filter (not positive and score>0.35) as fp, count(*) filter (positive and score<=0.35) as fn, count(*) filter (positive and score>0.35) as tp from {src}) a) b")
register("risk_histogram", "samples", evaluation.level_histogram, "select positive, count(*) filter (level='LOW') as low, count(*) filter (level='MEDIUM') as medium, count(*) filter (level='HIGH') as high from {src} group by positive")

# --- event streams ----------------------------------------------------------------------------


def _event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.drain(events.window_counts(events.read_events(spark, sf_dir)))
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "least", "largest")


QUERIES["event_window_stream"] = _event_windows
ORACLE_SQL["event_window_stream"] = "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, min(value) as least, max(value) as largest from events group by all"
register_table("event_sessions", lambda d: events.session_counts(d.withColumn("ts", F.col("ts").cast("timestamp"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest")), "events",
       "with s as (select user_id, ts, sum(case when p is null or ts - p > interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id) as k from (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events) x), c as (select user_id, k, count(*) as n from s group by all) select user_id, count(*) as sessions, max(n) as longest from c group by user_id")

whole.register_composed(_Q)
from . import arriving as _arriving  # noqa: E402, F401 - its SQL is put together from that registered above
