"""Derived inputs: identity records made of the plain tables by integer arithmetic.

Each is one SQL text that Spark and DuckDB read alike, so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.mrz_digits import ALPHABET, WEIGHTS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: A country for each of the 25 nations.
COUNTRIES = "USAGBRFRADEUESPITAINDBRAJPNCHNCANMEXARGCHLPERAUSNZLZAFEGYKENNGATURGRCPRT"


def digit(expression: str, width: int) -> str:
    """SQL of the check digit of a field of fixed width, as text."""
    terms = "+".join(f"greatest(instr('{ALPHABET}', substr({expression}, {i + 1}, 1))-1, 0)*{WEIGHTS[i % 3]}" for i in range(width))
    return f"cast(({terms}) % 10 as string)"


def _yymmdd(column: str) -> str:
    return f"substr({column},3,2)||substr({column},6,2)||substr({column},9,2)"


def _people(table: str, key: str, extra: str = "") -> str:
    """Number, country, names, dates and sex for each key of a table."""
    return f"""
select k, 'P'||lpad(cast(k as string),8,'0') as num, substr('{COUNTRIES}', cast(k % 25 as int)*3+1, 3) as cc,
 translate(lpad(cast(k*7919 % 1000000 as string),6,'0'),'0123456789','ABCDGHILMN') as surname,
 translate(lpad(cast(k*104729 % 100000 as string),5,'0'),'0123456789','ABDGHILMNO') as given,
 {_yymmdd('dob')} as dob6, {_yymmdd('expiry')} as exp6, dob, expiry,
 case when k % 3 = 0 then 'M' when k % 3 = 1 then 'F' else '<' end as sex
from (select {key} as k, cast(date '1940-01-01' + cast({key}*37 % 25000 as int) as string) as dob,
 cast(date '2020-01-01' + cast({key}*53 % 6000 as int) as string) as expiry from {table}) base"""


_CITIZENS = f"select p.*, {digit('num', 9)} as num_d, {digit('dob6', 6)} as dob_d, {digit('exp6', 6)} as exp_d from ({_people('customer', 'c_custkey')}) p"
_VARIANT = """
case when k % 7 = 0 then translate(num_d,'0123456789','1234567890') else num_d end as v_digit,
case when k % 11 = 0 then translate(dob6,'0','O') else dob6 end as v_dob,
case when k % 13 = 0 then translate(cc,'IOZSB','10258') else cc end as v_cc"""

SQL = {
    "passport_src": f"""
select k, dob, expiry, surname, given, cc, num, rpad('P<'||cc||surname||'<<'||given, 44, '<') as line1,
 case when k % 17 = 0 then substr(full2, 1, 40) else full2 end as line2
from (select q.*, num||v_digit||v_cc||v_dob||dob_d||sex||exp6||exp_d||'<<<<<<<<<<<<<<'||'<'||composite as full2
 from (select c.*, {_VARIANT}, {digit("num||num_d||dob6||dob_d||exp6||exp_d||'<<<<<<<<<<<<<<<'", 39)} as composite from ({_CITIZENS}) c) q) r""",
    "mrva_src": f"""
select k, rpad('V<'||v_cc||surname||'<<'||given, 44, '<') as line1, rpad(num||v_digit||cc||v_dob||dob_d||sex||exp6||exp_d, 44, '<') as line2
from (select c.*, {_VARIANT} from ({_CITIZENS}) c) q""",
    "mrvb_src": f"""
select k, rpad('V<'||v_cc||surname||'<<'||given, 36, '<') as line1, rpad(num||v_digit||cc||v_dob||dob_d||sex||exp6||exp_d, 36, '<') as line2
from (select c.*, {_VARIANT} from ({_CITIZENS}) c) q""",
    "td1_src": f"""
select k, rpad('I<'||v_cc||num||v_digit, 30, '<') as line1,
 dob6||dob_d||sex||exp6||exp_d||cc||'<<<<<<<<<<<'||{digit("num||num_d||'<<<<<<<<<<<<<<<'||dob6||dob_d||exp6||exp_d||'<<<<<<<<<<<'", 50)} as line2,
 rpad(surname||'<<'||given, 30, '<') as line3 from (select c.*, {_VARIANT} from ({_CITIZENS}) c) q""",
    "td2_src": f"""
select k, rpad('I<'||v_cc||surname||'<<'||given, 36, '<') as line1,
 num||v_digit||cc||v_dob||dob_d||sex||exp6||exp_d||'<<<<<<<'||{digit("num||num_d||dob6||dob_d||exp6||exp_d||'<<<<<<<'", 31)} as line2 from (select c.*, {_VARIANT} from ({_CITIZENS}) c) q""",
    "raw_lines": """
select c_custkey as k, case when c_custkey % 3 = 0 then ' p<uto'||lower(c_mktsegment)||'«‹ anna ' when c_custkey % 3 = 1 then 'L8 98'||cast(c_custkey as string)||' ut0|{74}-'
 else 'I(ut0)'||c_name||' [x] ' end as raw, case when c_custkey % 4 = 0 then 'ANNA<MARIA<SRSSSESSESSSS' when c_custkey % 4 = 1 then 'KKKK<'||c_mktsegment||'<K' when c_custkey % 4 = 2 then c_mktsegment||'<E' else 'SEX<'||c_mktsegment||'<RECK' end as name from customer""",
    "ocr_text": """
select k, case when k % 4 = 0 then 'VISA'||chr(10)||'Control Number: '||lpad(cast(k*7 as string),10,'2')||chr(10)||'Visa Type / Class: B1/B2'||chr(10)||'Entries: '||ent||chr(10)||'Issue Date: '||d||chr(10)||'Expiry Date: '||x||chr(10)||'Passport No: P'||lpad(cast(k as string),8,'0')||chr(10)||'Name: '||nm||chr(10)||'Issuing Post: US EMBASSY'
 when k % 4 = 1 then 'PASSPORT'||chr(10)||'Passport No: p'||lpad(cast(k as string),8,'0')||chr(10)||'Surname: '||nm||chr(10)||'Given Names: ANNA'||chr(10)||'Date of Birth: '||d||chr(10)||'Date of Expiry: '||x||chr(10)||'Sex: '||case when k % 3 = 0 then 'FEMALE' else 'M' end||chr(10)||'Nationality: FRA'
 when k % 4 = 2 then 'GOVERNMENT OF INDIA'||chr(10)||nm||chr(10)||'DOB: '||d||chr(10)||'Gender: '||case when k % 3 = 0 then 'FEMALE' else 'MALE' end||chr(10)||'8416 1590 '||lpad(cast(k % 10000 as string),4,'0')||chr(10)||'Address: 12 Lane'||chr(10)||'Town '||cast(k % 90 as string)
 else 'Driving card'||chr(10)||'ID No: AB'||lpad(cast(k as string),7,'0')||chr(10)||'Year of Birth: '||cast(1950+k % 90 as string)||chr(10)||'Citizen of India'||chr(10)||'Authority: Transport Office' end as text,
 'P'||lpad(cast(k as string),8,'0') as mrz_number, case when k % 5 = 0 then 'OTHER PERSON' else nm end as mrz_name, ent, d, k % 6 as kind
from (select o_orderkey as k, case when o_orderkey % 7 = 0 then 'MULT' when o_orderkey % 7 = 1 then 's' when o_orderkey % 7 = 2 then 'DOUBLE' when o_orderkey % 7 = 3 then '1' when o_orderkey % 7 = 4 then '12' when o_orderkey % 7 = 5 then 'UNLIMITEDENTRIES' else ' two ' end as ent,
 lpad(cast(1+o_orderkey % 33 as string),2,'0')||'/'||lpad(cast(1+o_orderkey % 14 as string),2,'0')||'/'||cast(1950+o_orderkey % 80 as string) as d,
 lpad(cast(1+o_orderkey % 28 as string),2,'0')||'-'||lpad(cast(1+o_orderkey % 12 as string),2,'0')||'-'||cast(2020+o_orderkey % 20 as string) as x,
 translate(cast(100000+o_orderkey*31 % 900000 as string),'0123456789','ABCDEGHILM')||' ROSTOVA' as nm from orders) b""",
    "regions": """
select l_orderkey as doc_id, l_linenumber as ordinal, case when l_linenumber % 4 = 1 then 'Name' when l_linenumber % 4 = 2 then 'Elena Rostova' when l_linenumber % 4 = 3 then 'DOB 15/08/1990' else ' ' end as text,
 l_discount*8+0.1 as confidence, cast(l_quantity*7 as int) % 300 as x1, cast(l_linenumber*12 as int) as y1, cast(l_quantity*7 as int) % 300+60 as x2, cast(l_linenumber*12+10 as int) as y2 from lineitem""",
    "card_regions": """
select l_orderkey as doc_id, l_linenumber as ordinal, case kind when 0 then 'Date of Birth' when 1 then day when 2 then 'Passport No' when 3 then 'P'||lpad(cast(l_partkey as string),8,'0') when 4 then 'DOB: '||day when 5 then 'Date of Expiry'
 when 6 then 'Passport Number X'||lpad(cast(l_suppkey as string),7,'0') when 7 then 'Expires '||day when 8 then ' ' else 'Elena Rostova' end as text, cast(l_discount*8+0.1 as double) as confidence, x1, y1, x1+wide as x2, y1+tall as y2
from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, cast((l_partkey*7+l_linenumber*3+l_orderkey) % 10 as int) as kind, lpad(cast(1+l_partkey % 28 as string),2,'0')||'/'||lpad(cast(1+l_suppkey % 12 as string),2,'0')||'/'||cast(1950+l_partkey % 80 as string) as day,
 cast(l_partkey*13 % 400 as int) as x1, cast(l_linenumber*14+l_suppkey*5 % 90 as int) as y1, cast(40+l_partkey % 120 as int) as wide, cast(8+l_orderkey % 3*12 as int) as tall from lineitem) b""",
    "zones": """
select k as doc_id, 'P'||lpad(cast(k as string),8,'0') as v_num, case when k % 9 = 0 then 'P0' else 'P'||lpad(cast(k as string),8,'0') end as m_num,
 case when k % 5 = 0 then '15/08/1995' else substr(d,9,2)||'-'||substr(d,6,2)||'-'||substr(d,1,4) end as v_dob, substr(d,3,2)||substr(d,6,2)||substr(d,9,2) as m_dob,
 case when k % 4 = 0 then '' else seg||', Anna' end as v_name, case when k % 6 = 0 then 'ROBERT WILLIAMS' else 'ANNA '||seg||' MARIA' end as m_name,
 case when k % 2 = 0 then 'Female' else 'm' end as v_sex, case when k % 8 = 0 then 'X' else case when k % 2 = 0 then 'F' else 'M' end end as m_sex, cast((k % 10)/10.0 as double) as conf
from (select c_custkey as k, cast(date '1950-01-01'+cast(c_custkey*31 % 20000 as int) as string) as d, c_mktsegment as seg from customer) b""",
    "dates": """
select o_orderkey as k, case when o_orderkey % 9 = 0 then '740812' when o_orderkey % 9 = 1 then d||'/'||m||'/'||y when o_orderkey % 9 = 2 then y||'-'||m||'-'||d when o_orderkey % 9 = 3 then d||'-AUG-'||y when o_orderkey % 9 = 4 then d||' Sept '||y
 when o_orderkey % 9 = 5 then d||m||y when o_orderkey % 9 = 6 then y||m||d when o_orderkey % 9 = 7 then 'x'||d||m else d||'.'||m||'.'||substr(y,3,2) end as raw, case when o_orderkey % 2 = 0 then 'Year of Birth' else 'DOB' end as label, '8416 1590 3267' as id_number
from (select o_orderkey, lpad(cast(1+o_orderkey % 35 as string),2,'0') as d, lpad(cast(1+o_orderkey % 13 as string),2,'0') as m, cast(1890+o_orderkey % 150 as string) as y from orders) b""",
    "signals": """
select l_orderkey as doc_id, case l_linenumber when 1 then 'ela' when 2 then 'noise' when 3 then 'edge_texture' when 4 then 'copy_move' when 5 then 'metadata' when 6 then 'document_consistency' else 'other' end as signal,
 cast(case when l_quantity > 40 then 0.9 else l_discount*5 end as double) as score, cast(case l_linenumber when 1 then 0.35 when 2 then 0.15 when 3 then 0.10 when 4 then 0.15 when 5 then 0.10 else 0.35 end as double) as weight, l_quantity % 3 <> 0 as evaluated from lineitem""",
    "blocks": """
select l_orderkey % 500 as doc_id, l_orderkey*10+l_linenumber as block, cast(case when l_quantity > 49 then l_quantity*1.5 else 10+l_linenumber*0.5 end as double) as value from lineitem""",
    "boxes": """
select l_orderkey % 700 as doc_id, cast(l_orderkey*10+l_linenumber as int) as ordinal, cast(l_partkey % 40*32 as int) as x1, cast(l_suppkey % 10*32 as int) as y1, cast(l_partkey % 40*32+32 as int) as x2, cast(l_suppkey % 10*32+32 as int) as y2 from lineitem""",
    "matches": """
select l_orderkey % 50 as doc_id, cast(l_partkey % 300 as double) as sx, cast(l_orderkey % 211 as double) as sy, cast(l_partkey % 300+case when l_linenumber % 2 = 0 then -1 else 1 end*(100+20*(l_linenumber % 3)) as double) as tx, cast(l_orderkey % 211+40*(l_linenumber % 2) as double) as ty from lineitem""",
    "points": """
select doc_id, point, cast(x as double) as x, cast(y as double) as y, case when point % 9 = 0 then substr(h, 1, 60)||'7'||substr(h, 62) else h end as descriptor
from (select l_orderkey div_10 as doc_id, cast(row_number() over (partition by floor(l_orderkey / 10) order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as int) as point, l_partkey % 611 as x, l_suppkey * 7 % 407 as y,
 case when l_linenumber < 4 then md5(cast(l_linenumber as string))||md5(cast(l_orderkey / 10 as string)) else md5(cast(l_partkey as string))||md5(cast(l_suppkey as string)) end as h from lineitem) b""".replace("l_orderkey div_10", "cast(floor(l_orderkey / 10) as bigint)").replace("cast(l_orderkey / 10 as string)", "cast(cast(floor(l_orderkey / 10) as bigint) as string)"),
    "metadata": """
select event_id as doc_id, case when event_id % 5 = 0 then '' when event_id % 5 = 1 then 'Adobe Photoshop 24' when event_id % 5 = 2 then 'Canon EOS' when event_id % 5 = 3 then 'GIMP 2.10' else event_type end as software from events""",
    "faces": """
select l_orderkey as doc_id, l_linenumber as ordinal, cast(l_quantity*4 as int) as w, cast(l_quantity*4+l_linenumber*3 as int) as h, l_discount*10 as confidence, l_tax*1000 as sharpness, l_quantity*5.1 as brightness from lineitem""",
    "screening_src": f"""
select cast(o_orderkey as string) as screening_id, o_orderdate as created_at, case when o_orderkey % 13 = 0 then 'XXX' else lower(cc)||' ' end as claimed_nationality, 'P'||lpad(cast(c_custkey as string),8,'0') as passport_number,
 nm as passport_name, cast(date '1900-01-01'+cast(c_custkey*37 % 48000 as int) as date) as passport_dob, cast(date '2024-06-01'+cast(o_orderkey*53 % 2000 as int)-1000 as date) as passport_expiry, cc as passport_nationality, o_orderkey % 19 <> 0 as mrz_ok,
 'V'||cast(o_orderkey as string) as visa_number, case substr(o_orderpriority,1,1) when '1' then 'tourist' when '2' then 'work permit' when '3' then 'Transit' when '4' then 'Tourist Visa' else 'DIPLOMATIC' end as visa_text, cast(date '2024-01-01'+cast(o_orderkey*29 % 1500 as int) as date) as visa_until, cast(o_orderkey % 200 as int) as stay_days,
 case when o_orderkey % 11 = 0 then translate(nm,'OIS','015') when o_orderkey % 17 = 0 then 'SOMEONE ELSE' else nm end as nid_name, cast(date '1900-01-01'+cast(c_custkey*37 % 48000 as int)+case when o_orderkey % 23 = 0 then 1 else 0 end as date) as nid_dob,
 cast((o_orderkey*7 % 100)/100.0 as double) as face_score, cast((o_orderkey*3 % 100)/100.0 as double) as photo_score, o_orderkey % 29 = 0 as metadata_anomaly
from (select o.*, c.c_custkey, substr('{COUNTRIES}', cast(c.c_nationkey % 25 as int)*3+1, 3) as cc, translate(cast(100000+c.c_custkey*7919 % 900000 as string),'0123456789','OISABCDEFG')||' ROSS' as nm from orders o join customer c on o.o_custkey = c.c_custkey) b""",
    "samples": """
select l.doc_id, l.toxic = 1 as positive, cast((l.doc_id*37 % 100)/100.0 as double) as score, case when l.doc_id*37 % 100 < 30 then 'LOW' when l.doc_id*37 % 100 < 65 then 'MEDIUM' else 'HIGH' end as level from labels l""",
}
SQL["documents_src"] = f"""
select k as doc_id, text, kind < 4 as detected, case kind when 0 then 'TD3' when 1 then 'MRVA' when 2 then 'TD1' end as format, case kind when 0 then 'P' when 1 then 'V' when 2 then 'I' else 'Q' end as document_code,
 mrz_number, mrz_name, cast(null as string) as requested from ({SQL['ocr_text']}) o"""
SQL["candidate_src"] = f"""
select k as doc_id, s as source_ordinal, 'pass_'||cast(s as string) as source, case s when 0 then 'PASSPORT'||chr(10)||line1||chr(10)||line2 when 1 then line1||chr(10)||'noise artefact line'||chr(10)||line2 else substr(line1,1,30)||chr(10)||substr(line2,1,38)||chr(10)||'short' end as text
from ({SQL['passport_src']}) p cross join (select 0 as s union all select 1 as s union all select 2 as s) n"""


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views of the tables that a text names."""
    for table in TABLES:
        if re.search(rf"\b{table}\b", sql):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame."""
    views(spark, sf_dir, SQL[name])
    return spark.sql(SQL[name])
