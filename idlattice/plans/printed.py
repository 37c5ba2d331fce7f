"""Queries over printed text: classes, printed fields, national ids, dates, fusion with the zone.

The SQL bears its own copy of every pattern and word list, so that a slip in the functions shows as a difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields, legacy
from ..operators import extraction
from .base import register, register_many

_UP = "upper(text)"

# --- SQL of its own ---------------------------------------------------------------------------

#: Words of each class, in order of precedence.
_CLASS_WORDS = (
    ("visa", ("VISA", "ENTRY PERMIT", "CONTROL NUMBER", "NUMBER OF ENTRIES", "VISA TYPE", "VALID FOR")),
    ("passport", ("PASSPORT", "PASSEPORT", "TRAVEL DOCUMENT", "REPUBLIC OF")),
    ("national_id", ("IDENTITY CARD", "NATIONAL ID", "AADHAAR", "CITIZEN", "DRIVING LICENCE", "IDENTITY NUMBER", "IDENTIFICATION", "ELECTION COMMISSION")),
)
#: Fixed value: how a date is printed.
_D = r"([0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}|[0-9]{2}\s+[A-Za-z]{3,9}\s+[0-9]{4}|[0-9]{4}[/.-][0-9]{2}[/.-][0-9]{2})"
#: Patterns of a visa's printed fields.
_VISA = {
    "visa_type": (r"(?:Visa\s*Type\s*/\s*Class|Type\s*/\s*Class|Visa\s*Type|Type\s*de\s*visa|Visa\s*Category|Category|Class)\s*[:\s]\s*([A-Za-z0-9/_-]+)", r"\b(?:Type|Class)\s*:\s*([A-Za-z0-9/_-]+)"),
    "entries": (r"(?:Entries|No\s*of\s*Entries|Number\s*of\s*Entries|Nombre\s*d'\s*entrées|Entries\s*/\s*Entrées)[:\s]+(MULTIPLE|SINGLE|DOUBLE|MULT|\bM\b|\bS\b|\bD\b|\b[12]\b)", r"\bEntries[:\s]+([A-Za-z0-9]+)"),
    "issue_date": r"(?:Issue\s*Date|Date\s*of\s*Issue|Issued|Date\s*d'\s*émission|Issued\s*On)[:\s]+" + _D,
    "expiry_date": r"(?:Expiry\s*Date|Date\s*of\s*Expiry|Expiration\s*Date|Expires\s*On|Valid\s*Until|Date\s*d'\s*expiration|Expires)[:\s]+" + _D,
    "passport_number": r"(?:Passport\s*No|Passport\s*Number|Pass\s*No|Passport\s*/\s*Passeport|Passeport\s*No)[:\s]+([A-Z0-9]{7,12})",
    "visa_number": (r"(?:Visa\s*No|Visa\s*Number|Control\s*Number|Document\s*No|Visa\s*#)[:\s]+([A-Z0-9]{7,14})", r"\bControl\s*Number[:\s]+([0-9]{8,14})"),
    "name": r"(?:Name|Full\s*Name|Given\s*Name|Surname|Bearer|Holder)[:\s]+([A-Za-z\s.'-]{2,50})(?:\n|$)",
    "issuing_authority": r"(?:Authority|Issuing\s*Post|Issued\s*By|Embassy|Consulate)[:\s]+([A-Za-z0-9\s,.-]+)(?:\n|$)",
}
#: The same of a passport and of a national id.
_PASSPORT = {
    "passport_number": (r"(?:Passport\s*No|Passport\s*Number|Passeport\s*No|Passport\s*/\s*Passeport|Doc\s*No|Document\s*No|Passport\s*#)[:\s]+([A-Z0-9]{7,12})", r"\bPassport[:\s]+([A-Z0-9]{7,12})"),
    "date_of_birth": r"(?:Date\s*of\s*Birth|Birth\s*Date|DOB|Date\s*de\s*naissance)[:\s]+" + _D,
    "date_of_expiry": r"(?:Date\s*of\s*Expiry|Expiry\s*Date|Expiration\s*Date|Date\s*d'\s*expiration|Expires)[:\s]+" + _D,
    "surname": r"(?:Surname|Nom)[:\s]+([A-Z\s'-]{2,30})", "given_names": r"(?:Given\s*Names|Given\s*Name|Prénoms|Prenoms|First\s*Name)[:\s]+([A-Z\s'-]{2,40})", "full_name": r"(?:Full\s*Name|Name|Nom\s*complet)[:\s]+([A-Z\s'-]{3,50})",
    "sex": r"(?:Sex|Gender|Sexe)[:\s]+([MFX]|MALE|FEMALE|HOMME|FEMME)", "nationality": r"(?:Nationality|Nationalité)[:\s]+([A-Z]{3}|[A-Za-z\s]{3,20})",
}
_ID = {
    "grouped": r"\b([0-9]{4}\s[0-9]{4}\s[0-9]{4})\b",
    "labelled": r"(?:ID No|Identity No|National ID|Card No|Card Number|Document No|Document Number|ID Number|Aadhaar|Voter ID|PAN|SSN)[:\s#]+([A-Z0-9 -]{5,20})",
    "nationality": r"(?:Nationality|Citizen of)[:\s]+([A-Za-z]+)", "address": r"(?:Address|Permanent Address|Residence)[:\s]+([^\n]+(?:\n[^\n]+)?)", "authority": r"(?:Authority|Issued By|Government of)[:\s]+([A-Za-z\s,]+)(?:\n|$)",
    "gender": r"(?:Gender|Sex|Gender\s*/\s*Sex|Sex\s*/\s*Gender)[:\s]+(MALE|FEMALE|TRANSGENDER|OTHER|\bM\b|\bF\b)",
    "birth": r"(?:DOB|Date of Birth|Birth Date|Birth|D\.O\.B|Year of Birth|YOB)[:\s/]+([0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}|[0-9]{4}[/.-][0-9]{2}[/.-][0-9]{2}|[0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{4}|[0-9]{4})",
    "holder": r"(?:Name|Full Name|Given Name|Holder|Cardholder|Name of Holder)[:\s]+([A-Za-z\s.'-]+)(?:\n|$)",
}
#: Words of headings, never part of a name.
_HEADINGS = (
    "GOVERNMENT", "GOVT", "INDIA", "BHARAT", "REPUBLIC", "STATE", "UNION", "AUTHORITY", "UNIQUE", "IDENTIFICATION", "ELECTION", "COMMISSION",
    "INCOME", "TAX", "DEPARTMENT", "TRANSPORT", "MINISTRY", "DIRECTORATE", "IDENTITY", "CARD", "NATIONAL", "AADHAAR", "AADHAR", "MERA", "PEHCHAN",
    "ENROLMENT", "ENROLLMENT", "RESIDENT", "CITIZEN", "DRIVING", "LICENCE", "LICENSE", "PERMANENT", "ACCOUNT", "NUMBER", "VOTER", "ELECTOR", "PHOTO",
    "SIGNATURE", "OFFICIAL", "HELP", "LINE", "WWW", "GOV", "IN", "NIC", "DOWNLOAD", "DATE", "MALE", "FEMALE", "GENDER", "SEX", "DOB", "YEAR",
    "BIRTH", "ADDRESS", "ISSUE", "EXPIRY", "VALID", "FATHER", "MOTHER", "HUSBAND", "WIFE",
)
_HEADING_LIST = ",".join(f"'{w}'" for w in _HEADINGS)


def _has(words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"instr({_UP},'{w}')>0" for w in words) + ")"


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


def _first(patterns: tuple[str, ...] | str, text: str = "text", case: str = "(?i)") -> str:
    """DuckDB: trimmed first group of the first pattern that matches."""
    patterns = (patterns,) if isinstance(patterns, str) else patterns
    return "coalesce(" + ",".join(f"case when regexp_matches({text},'{case}{_re(p)}') then regexp_replace(regexp_extract({text},'{case}{_re(p)}',1),'^\\s+|\\s+$','','g') end" for p in patterns) + ")"


def _entries_sql(e: str) -> str:
    s = f"upper(trim({e}))"
    return f"case when {s}='' then null when {s} in ('MULTIPLE','MULT','M','MULTIPLE/MULTIPLE','M/M') then 'MULTIPLE' when {s} in ('SINGLE','S','ONE','1') then 'SINGLE' when {s} in ('DOUBLE','D','TWO','2') then 'DOUBLE' when regexp_full_match({s},'[0-9]+') or length({s})<=10 then {s} end"


def _num(e: str, p: str, g: int) -> str:
    return f"try_cast(regexp_extract({e},'{p}',{g}) as int)"


def _visa_date_sql(e: str) -> str:
    a, b, c = "^([0-9]{2})[/.-]([0-9]{2})[/.-]([0-9]{4})$", "^([0-9]{4})[/.-]([0-9]{2})[/.-]([0-9]{2})$", "^([0-9]{1,2})\\s+([A-Za-z]{3,9})\\s+([0-9]{4})$"
    return f"coalesce(case when regexp_matches({e},'{a}') then {_num(e, a, 1)} between 1 and 31 and {_num(e, a, 2)} between 1 and 12 and {_num(e, a, 3)} between 1900 and 2060 when regexp_matches({e},'{b}') then {_num(e, b, 3)} between 1 and 31 and {_num(e, b, 2)} between 1 and 12 and {_num(e, b, 1)} between 1900 and 2060 when regexp_matches({e},'{c}') then {_num(e, c, 1)} between 1 and 31 and {_num(e, c, 3)} between 1900 and 2060 end, false)"


def _date_sql(e: str, label: str, number: str) -> str:
    digits, own = f"regexp_replace({e},'[^0-9]','','g')", f"regexp_replace(coalesce({number},''),'[^0-9]','','g')"
    p = [f"try_cast(case when regexp_full_match(string_split(translate({e},'.-','//'),'/')[{k}],'[0-9]{{1,9}}') then string_split(translate({e},'.-','//'),'/')[{k}] end as int)" for k in (1, 2, 3)]
    named = "^([0-9]{1,2})\\s+([A-Za-z]{3,9})\\s+([0-9]{4})$"
    three = f"(len(string_split(translate({e},'.-','//'),'/'))=3 and (({p[0]} between 1 and 31 and {p[1]} between 1 and 12 and {p[2]} between 1900 and 2026) or ({p[0]} between 1900 and 2026 and {p[1]} between 1 and 12 and {p[2]} between 1 and 31)))"
    spelled = f"(regexp_matches({e},'{named}') and upper(substr(regexp_extract({e},'{named}',2),1,3)) in ('JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC') and {_num(e, named, 1)} between 1 and 31 and {_num(e, named, 3)} between 1900 and 2026)"
    return f"coalesce(not (length({digits})>=4 and instr({own},{digits})>0) and case when regexp_full_match({e},'[0-9]{{4}}') then cast({e} as int) between 1900 and 2026 and regexp_matches(upper({label}),'YOB|YEAR') else coalesce({three},false) or coalesce({spelled},false) end, false)"


def name_score_sql(text: str, confidence: str) -> str:
    """DuckDB: score of a line as a name."""
    t = f"trim({text})"
    letters = f"length(regexp_replace({t},'[^A-Za-z]','','g'))"
    ws = f"list_filter(regexp_split_to_array({t},'\\s+'), lambda w: w<>'')"
    never = f"(length({t})<3 or length({t})>50 or regexp_matches({t},'[0-9]') or {letters}/greatest(1,length({t}))<0.7 or len(list_filter({ws}, lambda w: regexp_replace(upper(w),'[^A-Z]','','g') in ({_HEADING_LIST})))>0 or regexp_matches(upper({t}),'GOVERNMENT|AUTHORITY|AADHAAR|IDENTITY|CARD|REPUBLIC|ELECTION|COMMISSION|DIRECTORATE'))"
    cap = f"(len(list_filter({ws}, lambda w: not regexp_matches(w,'^[A-Z]')))=0 or ({t}=upper({t}) and {letters}>0))"
    count = f"case len({ws}) when 2 then 0.5 when 3 then 0.45 when 4 then 0.35 when 1 then case when length({t})>=5 then 0.1 else -0.6 end else 0.0 end"
    return f"case when coalesce({never}, true) then -100.0 else {confidence}*1.5 + {count} + case when {cap} then 0.3 when {t}=lower({t}) and {letters}>0 then -0.5 else 0.0 end + case when regexp_full_match({t},'[A-Za-z\\s.''-]+') then 0.2 else -0.3 end + case when {confidence}<0.5 then -0.8 else 0.0 end end"


# --- classes and dates ------------------------------------------------------------------------

_WORD_CLASS = "case " + " ".join(f"when {_has(w)} then '{k}'" for k, w in _CLASS_WORDS) + " else 'national_id' end"
register("doc_classify", "ocr_text", lambda d: d.select("k", fields.classify(F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)).alias("c")).select("k", "c.document_type", "c.confidence"),
         f"select k, {_WORD_CLASS} as document_type, cast(case when {' or '.join(_has(w) for _, w in _CLASS_WORDS)} then 0.92 else 0.5 end as double) as confidence from {{src}}")
register("doc_classify_zone", "documents_src", lambda d: d.select("doc_id", fields.classify(F.col("text"), F.col("format"), F.col("document_code"), F.col("detected")).alias("c")).select("doc_id", "c.document_type", "c.confidence"),
         f"select doc_id, case when detected and format is not null and (format in ('MRVA','MRVB') or document_code like 'V%') then 'visa' when detected and format is not null and (format in ('TD1','TD2') or document_code[1] in ('I','A','C')) then 'national_id' when detected and format is not null and (format='TD3' or document_code like 'P%') then 'passport' when {' or '.join(_has(w) for _, w in _CLASS_WORDS)} then {_WORD_CLASS} when detected then 'passport' else 'national_id' end as document_type, cast(case when detected and format is not null then 0.98 when {' or '.join(_has(w) for _, w in _CLASS_WORDS)} then 0.92 when detected then 0.85 else 0.5 end as double) as confidence from {{src}}")
register("visa_entries", "ocr_text", lambda d: d.select("k", fields.entries(F.col("ent")).alias("entries")), f"select k, {_entries_sql('ent')} as entries from {{src}}")
register("date_candidate_valid", "dates", lambda d: d.select("k", "raw", fields.is_date_candidate(F.col("raw"), F.col("label"), F.col("id_number")).alias("valid"), fields.is_visa_date(F.col("raw")).alias("visa_valid"), fields.is_passport_date(F.col("raw")).alias("passport_valid")),
         f"select k, raw, {_date_sql('raw', 'label', 'id_number')} as valid, {_visa_date_sql('raw')} as visa_valid, coalesce(regexp_matches(raw,'^[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}}$') and {_num('raw', '^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{2,4})$', 1)} between 1 and 31 and {_num('raw', '^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{2,4})$', 2)} between 1 and 12, false) as passport_valid from {{src}}")

# --- printed fields of all documents ------------------------------------------------------------

# each pattern is searched once, in an inner query
_VISA_FOUND = ", ".join([*[f"upper({_first(p)}) as vt{k}" for k, p in enumerate(_VISA["visa_type"])], *[f"{_first(p)} as en{k}" for k, p in enumerate(_VISA["entries"])], *[f"{_first(_VISA[n])} as {n}" for n in ("issue_date", "expiry_date", "passport_number", "visa_number", "name", "issuing_authority")]])
#: Words that are no type of visa.
_NOT_TYPE = "('/','-','_','CLASS','CATEGORY','PASSPORT','VISA','NUMBER','DATE','CONTROL')"
_VISA_SQL = {
    "visa_type": f"case when vt0 not in {_NOT_TYPE} then vt0 when vt1 not in {_NOT_TYPE} then vt1 end", "entries": f"coalesce({_entries_sql('en0')},{_entries_sql('en1')})",
    "issue_date": f"case when {_visa_date_sql('issue_date')} then issue_date end", "expiry_date": f"case when {_visa_date_sql('expiry_date')} then expiry_date end",
    "passport_number": "upper(passport_number)", "visa_number": "upper(visa_number)", "name": "case when upper(name) not in ('VISA','UNITED STATES','CONTROL NUMBER') then name end", "issuing_authority": "issuing_authority",
}
_VISA_ROWS = f"(select k, kind, mrz_number, mrz_name, {', '.join(f'{v} as {n}' for n, v in _VISA_SQL.items())} from (select k, kind, mrz_number, mrz_name, {_VISA_FOUND} from {{src}}) f) v"
register("visa_visual_fields", "ocr_text", lambda d: fields.with_visa_fields(d.select("k", "text")).drop("text"), f"select k, {', '.join(_VISA_SQL)} from {_VISA_ROWS}")
_PASSPORT_FOUND = ", ".join(f"{_first(p)} as {n}" for n, p in _PASSPORT.items())
_PASSPORT_SQL = {
    "passport_number": "upper(passport_number)", "date_of_birth": "date_of_birth", "date_of_expiry": "date_of_expiry", "surname": "surname", "given_names": "given_names", "name": "coalesce(surname||' '||given_names, full_name)",
    "sex": "case when instr(upper(sex),'M')>0 and instr(upper(sex),'F')=0 then 'M' when instr(upper(sex),'F')>0 then 'F' when sex is not null then 'X' end", "nationality": "upper(nationality)",
}
_PASSPORT_ROWS = f"(select k, kind, mrz_number, mrz_name, {', '.join(f'{v} as {n}' for n, v in _PASSPORT_SQL.items())} from (select k, kind, mrz_number, mrz_name, {_PASSPORT_FOUND} from {{src}}) f) v"
register("passport_visual_fields", "ocr_text", lambda d: fields.with_passport_fields(d.select("k", "text")).drop("text"), f"select k, {', '.join(_PASSPORT_SQL)} from {_PASSPORT_ROWS}")


def _zones(d: DataFrame, format_: str) -> DataFrame:
    """Zones of the documents of kind below 4, as the candidates' search would hand them on."""
    zone = F.create_map(F.lit("document_number"), F.col("mrz_number"), F.lit("surname"), F.col("mrz_name"), F.lit("date_of_expiry"), F.lit("301231"))
    return d.where("kind < 4").select(F.col("k").alias("doc_id"), F.lit(True).alias("detected"), F.lit(format_).alias("format"), F.lit(format_[0]).alias("document_code"), zone.alias("fields"))


def _no_regions(d: DataFrame) -> DataFrame:
    return d.sparkSession.createDataFrame([], "doc_id long, ordinal int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")


def _wide(d: DataFrame, rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    picked = [F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names]
    per = rows.groupBy("doc_id").agg(*picked, F.max(F.when(F.col("field") == names[0], F.col("source"))).alias("source"))
    return d.select(F.col("k").alias("doc_id")).join(per, "doc_id", "left")


def _visa_fusion(d: DataFrame) -> DataFrame:
    docs = d.select(F.col("k").alias("doc_id"), "text")
    rows = extraction.visa_fused(extraction.visa_visual(docs, _no_regions(d)), _zones(d, "MRVA"))
    return _wide(d, rows, ("document_number", "name", "visa_type", "entries", "expiry_date"))


register("visa_fusion", "ocr_text", _visa_fusion, f"select k as doc_id, case when kind<4 then mrz_number else visa_number end as document_number, case when kind<4 then coalesce(nullif(mrz_name,''),name) else name end as name, visa_type, entries, coalesce(expiry_date, case when kind<4 then '301231' end) as expiry_date, case when kind<4 then 'mrz' when visa_number is not null then 'visual_ocr' end as source from {_VISA_ROWS}")
register("visa_discrepancy", "ocr_text", lambda d: extraction.discrepancies(extraction.visa_visual(d.select(F.col("k").alias("doc_id"), "text"), _no_regions(d)), _zones(d, "MRVA")),
         f"select k as doc_id, d.field, d.visual, d.mrz from (select k, unnest([case when not contains(a,b) and not contains(b,a) then {{'field':'document_number','visual':visa_number,'mrz':mrz_number}} end, case when len(x)>0 and len(y)>0 and not list_has_any(x,y) then {{'field':'name','visual':name,'mrz':mrz_name}} end]) as d from (select *, regexp_replace(upper(visa_number),'[^A-Z0-9]','','g') as a, regexp_replace(upper(mrz_number),'[^A-Z0-9]','','g') as b, regexp_extract_all(upper(name),'[A-Z]{{3,}}') as x, regexp_extract_all(upper(mrz_name),'[A-Z]{{3,}}') as y from {_VISA_ROWS} where kind<4) p) q where d is not null")


def _passport_fusion(d: DataFrame) -> DataFrame:
    docs = d.select(F.col("k").alias("doc_id"), "text")
    return _wide(d, extraction.passport_fused(extraction.passport_visual(docs, _no_regions(d)), _zones(d, "TD3")), ("passport_number", "surname", "date_of_birth", "date_of_expiry"))


register("passport_fusion", "ocr_text", _passport_fusion, f"select k as doc_id, case when kind<4 then mrz_number else passport_number end as passport_number, case when kind<4 then mrz_name else surname end as surname, case when kind>=4 then date_of_birth end as date_of_birth, case when kind<4 then '301231' else date_of_expiry end as date_of_expiry, case when kind<4 then 'mrz' when passport_number is not null then 'visual_ocr' end as source from {_PASSPORT_ROWS}")
register_many("passport_visual_regions", ("ocr_text", "regions"), lambda d, r: extraction.passport_visual(d.select(F.col("k").alias("doc_id"), "text"), r).where("field = 'date_of_birth'").select("doc_id", "value", "confidence"),
              f"with t as (select k as doc_id, {_first(_PASSPORT['date_of_birth'])} as value from {{src0}}), r as (select doc_id, arg_min(confidence,(y1,x1,ordinal,text,confidence)) as confidence from {{src1}} where text like 'DOB%' group by doc_id) select coalesce(t.doc_id,r.doc_id) as doc_id, coalesce(t.value,'15/08/1990') as value, case when t.value is null then r.confidence else 0.85 end as confidence from t full join r on r.doc_id=t.doc_id where t.value is not null or r.doc_id is not null and t.value is distinct from '15/08/1990'")

# --- national ids -----------------------------------------------------------------------------

_GENERIC = "list_filter(regexp_extract_all(text,'\\b[A-Z0-9]{7,14}\\b'), lambda w: regexp_full_match(w,'[A-Z]{1,3}[0-9]{6,10}|[0-9]{8,14}') or (length(w)>=8 and regexp_matches(w,'[0-9]')))[1]"
_ID_SQL = f"coalesce({_first(_ID['grouped'], case='')},{_first(_ID['labelled'])},nullif(regexp_extract(text,'\\b([A-Z]{{5}}[0-9]{{4}}[A-Z])\\b',1),''),{_GENERIC})"
_SEX_SQL = f"coalesce(upper({_first(_ID['gender'])}), case when regexp_matches({_UP},'\\bFEMALE\\b') then 'FEMALE' when regexp_matches({_UP},'\\bMALE\\b') then 'MALE' when regexp_matches({_UP},'\\bTRANSGENDER\\b') then 'TRANSGENDER' end)"
_SEX_OF = "case when instr(gender,'M')>0 and instr(gender,'FE')=0 then 'M' when instr(gender,'F')>0 then 'F' when gender is not null then 'X' end"
_AUTHORITY_SQL = f"case when instr({_UP},'GOVERNMENT OF INDIA')>0 then 'Government of India' when instr({_UP},'UNIQUE IDENTIFICATION AUTHORITY OF INDIA')>0 then 'Unique Identification Authority of India' when instr({_UP},'ELECTION COMMISSION OF INDIA')>0 then 'Election Commission of India' else {_first(_ID['authority'])} end"
_ADDRESS_SQL, _NATION_SQL = f"replace({_first(_ID['address'])}, chr(10), ', ')", f"coalesce(upper({_first(_ID['nationality'])}), case when instr({_UP},'INDIAN')>0 then 'INDIAN' end)"
register("nid_id_number", "ocr_text", lambda d: d.select("k", fields.id_number(F.col("text")).alias("id_number")), f"select k, {_ID_SQL} as id_number from {{src}}")
register("nid_gender", "ocr_text", lambda d: d.select("k", fields.gender(F.col("text")).alias("gender"), fields.sex_of(fields.gender(F.col("text"))).alias("sex")), f"select k, gender, {_SEX_OF} as sex from (select k, {_SEX_SQL} as gender from {{src}}) g")
register("nid_authority_address", "ocr_text", lambda d: d.select("k", fields.id_authority(F.col("text")).alias("authority"), fields.id_address(F.col("text")).alias("address"), fields.id_nationality(F.col("text")).alias("nationality")),
         f"select k, {_AUTHORITY_SQL} as authority, {_ADDRESS_SQL} as address, {_NATION_SQL} as nationality from {{src}}")
_birth = lambda t: fields.first_match(t, fields.ID_PATTERNS["birth"])
register("nid_dob", "ocr_text", lambda d: d.select("k", F.when(fields.is_date_candidate(_birth(F.col("text")), F.regexp_extract("text", r"(?i)(Year of Birth|YOB|DOB|Date of Birth)", 1), fields.id_number(F.col("text"))), _birth(F.col("text"))).alias("date_of_birth")),
         f"select k, case when {_date_sql('b', 'l', 'n')} then b end as date_of_birth from (select k, {_first(_ID['birth'])} as b, regexp_extract(text,'(?i)(Year of Birth|YOB|DOB|Date of Birth)',1) as l, {_ID_SQL} as n from {{src}}) x")


def _id_of_text(d: DataFrame) -> DataFrame:
    rows = extraction.national_id_visual(d.select(F.col("k").alias("doc_id"), "text"), _no_regions(d))
    return rows.select("doc_id", "field", "value", F.round("confidence", 4).alias("confidence"))


#: Fixed value: a date in figures that stands alone.
_LONE = "\\b([0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}|[0-9]{4}[/.-][0-9]{2}[/.-][0-9]{2})\\b"
_BEST_LINE = f"list_sort(list_filter([{{'s': -({name_score_sql('x', '0.70')}), 'i': i, 'v': trim(x)}} for x, i in string_split(text, chr(10))], lambda r: r.s < 0))[1].v"
_ID_WIDE = f"""select k, n as id_number, n as document_number, coalesce(case when {_date_sql('b', 'l', 'n')} then b end, list_filter(lone, lambda d: {_date_sql('d', "'standalone'", 'n')})[1]) as date_of_birth, gender, {_SEX_OF} as sex,
coalesce(case when {name_score_sql('h', '0.85')} > 0 then h end, best) as name, nationality, address, issuing_authority, h, {name_score_sql('h', '0.85')} > 0 as labelled, said
from (select k, {_ID_SQL} as n, {_first(_ID['birth'])} as b, regexp_extract(text,'(?i)({_re(_ID['birth'])})',1) as l, regexp_extract_all(text,'{_LONE}',1) as lone, {_SEX_SQL} as gender, {_first(_ID['holder'])} as h, {_BEST_LINE} as best, {_NATION_SQL} as nationality, {_first(_ID['nationality'])} as said, {_ADDRESS_SQL} as address, {_AUTHORITY_SQL} as issuing_authority from {{src}}) x"""
_CONFIDENT = {"name": "case when labelled then 0.85 else 0.75 end", "nationality": "case when said is null then 0.9 else 0.85 end", "issuing_authority": "0.9"}
register("nid_text_fields", "ocr_text", _id_of_text, f"with w as ({_ID_WIDE}) " + " union all ".join(f"select k as doc_id, '{n}' as field, {n} as value, cast({_CONFIDENT.get(n, '0.85')} as double) as confidence from w where {n} is not null" for n in ("id_number", "document_number", "date_of_birth", "gender", "sex", "name", "nationality", "address", "issuing_authority")))
register_many("nid_fields", ("ocr_text", "regions"), lambda d, r: extraction.national_id_visual(d.select(F.col("k").alias("doc_id"), "text"), r))
register("name_score", "regions", lambda d: d.select("doc_id", "ordinal", F.round(fields.name_score(F.col("text"), F.col("confidence")), 6).alias("score")), f"select doc_id, ordinal, round(cast({name_score_sql('text', 'confidence')} as double),6) as score from {{src}}")

# --- the earlier extractors ---------------------------------------------------------------------

#: Fixed value: a date as the earlier extractors read it.
_OLD_DAY = "([0-9]{2}[/-][0-9]{2}[/-][0-9]{4}|[0-9]{4}[/-][0-9]{2}[/-][0-9]{2})"


def _old(pattern: str, case: str = "(?i)") -> str:
    return f"nullif(regexp_extract(text,'{case}{_re(pattern)}',1),'')"


def _printed_only(d: DataFrame) -> DataFrame:
    return d.select(F.col("k").alias("doc_id"), "text", F.lit(None).cast("map<string,string>").alias("fields"))


register("legacy_passport_fields", "ocr_text", lambda d: legacy.extracted(_printed_only(d), "passport").select("doc_id", "passport_number", "date_of_birth", "date_of_expiry", "sex"),
         f"select k as doc_id, {_old(r'\b([A-Z][0-9]{7,8}|[A-Z0-9]{8,9})\b', '')} as passport_number, {_old(r'(?:DOB|Date of Birth|Birth Date)[:\s]+' + _OLD_DAY)} as date_of_birth, {_old(r'(?:Date of Expiry|Expiry Date|Expires)[:\s]+' + _OLD_DAY)} as date_of_expiry, case when s like '%M%' then 'M' when s like '%F%' then 'F' when s is not null then 'X' end as sex from (select *, upper({_old(r'(?:Sex|Gender)[:\s]+([MFX]|MALE|FEMALE)')}) as s from {{src}}) x")
register("legacy_visa_fields", "ocr_text", lambda d: legacy.extracted(_printed_only(d), "visa").select("doc_id", "visa_number", "passport_number", "visa_type", "entries", "issue_date", "expiry_date"),
         f"select k as doc_id, coalesce({_old(r'(?:Visa No|Control Number|Document No|Visa Number)[:\s]+([A-Z0-9]{7,12})')},{_old(r'\b([A-Z]\d{7,9}|\d{8,9})\b', '')}) as visa_number, {_old(r'(?:Passport No|Passport Number)[:\s]+([A-Z0-9]{7,10})')} as passport_number, {_old(r'(?:Type / Class|Visa Type|Class|Category)[:\s]+([A-Z0-9/-]+)')} as visa_type, upper({_old(r'(?:Entries|Number of Entries)[:\s]+(MULTIPLE|SINGLE|DOUBLE|M|S|1|2|\b[0-9]\b)')}) as entries, {_old(r'(?:Issue Date|Date of Issue|Issued)[:\s]+([0-9]{2}[/-][0-9]{2}[/-][0-9]{4}|[0-9]{2}[A-Za-z]{3}[0-9]{4})')} as issue_date, {_old(r'(?:Expiry Date|Expiration Date|Expires On|Valid Until)[:\s]+([0-9]{2}[/-][0-9]{2}[/-][0-9]{4}|[0-9]{2}[A-Za-z]{3}[0-9]{4})')} as expiry_date from {{src}}")
register("legacy_id_fields", "ocr_text", lambda d: legacy.extracted(_printed_only(d), "national_id").select("doc_id", "id_number", "date_of_birth", "gender", "nationality", "address"),
         f"select k as doc_id, coalesce({_old(_ID['grouped'], '')},{_old(r'(?:ID No|Identity No|National ID|Card No|Document No)[:\s]+([A-Z0-9-]+)')},{_old(r'\b([A-Z]{1,3}[0-9]{6,10}|[0-9]{9,12})\b', '')}) as id_number, {_old(r'(?:DOB|Date of Birth|Birth Date|Year of Birth)[:\s]+([0-9]{2}[/-][0-9]{2}[/-][0-9]{4}|[0-9]{4})')} as date_of_birth, upper({_old(r'(?:Gender|Sex)[:\s]+(MALE|FEMALE|M|F|OTHER|X)')}) as gender, upper({_old(_ID['nationality'])}) as nationality, replace(trim({_old(r'(?:Address|Permanent Address)[:\s]+([^\n]+(?:\n[^\n]+)?)')}), chr(10), ', ') as address from {{src}}")
register("legacy_classify", "ocr_text", lambda d: d.select("k", legacy.classify(F.col("text")).alias("document_type")), f"select k, case when {_has(_CLASS_WORDS[1][1])} then 'passport' when {_has(_CLASS_WORDS[0][1])} then 'visa' else 'national_id' end as document_type from {{src}}")
