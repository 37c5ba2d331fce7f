"""DuckDB texts of the machine-readable-zone parsers, with places, weights and confusions of their own."""

from __future__ import annotations

from types import SimpleNamespace

from ..functions.countries import CODES
from .inputs import SQL

ALPHABET, WEIGHTS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", (7, 3, 1)
#: What OCR reads for a digit, and the digit.
A, B = "ODQILlZSBJg", "00011125899"


def _layout(width: int, lines: int, number: tuple, birth: tuple, expiry: tuple, sex: tuple, nationality: tuple, names: tuple, composite: tuple = (), composite_at: tuple | None = None, visa: bool = False, clean_names: bool = True) -> SimpleNamespace:
    return SimpleNamespace(**locals())


#: Fixed values: (line, begin, end) of the fields of each zone, by ICAO Doc 9303.
LAYOUTS = {
    "TD3": _layout(44, 2, (2, 0, 9), (2, 13, 19), (2, 21, 27), (2, 20, 21), (2, 10, 13), (1, 5, 44), ((2, 0, 10), (2, 13, 20), (2, 21, 43)), (2, 43, 44)),
    "MRVA": _layout(44, 2, (2, 0, 9), (2, 13, 19), (2, 21, 27), (2, 20, 21), (2, 10, 13), (1, 5, 44), visa=True),
    "MRVB": _layout(36, 2, (2, 0, 9), (2, 13, 19), (2, 21, 27), (2, 20, 21), (2, 10, 13), (1, 5, 36), visa=True),
    "TD1": _layout(30, 3, (1, 5, 14), (2, 0, 6), (2, 8, 14), (2, 7, 8), (2, 15, 18), (3, 0, 30), ((1, 5, 30), (2, 0, 7), (2, 8, 15), (2, 18, 29)), (2, 29, 30), clean_names=False),
    "TD2": _layout(36, 2, (2, 0, 9), (2, 13, 19), (2, 21, 27), (2, 20, 21), (2, 10, 13), (1, 5, 36), ((2, 0, 10), (2, 13, 20), (2, 21, 35)), (2, 35, 36), clean_names=False),
}


def _value(c: str) -> str:
    return f"greatest(instr('{ALPHABET}', upper({c}))-1, 0)"


def total(e: str, width: int) -> str:
    return "(" + "+".join(f"{_value(f'substr({e},{i + 1},1)')}*{WEIGHTS[i % 3]}" for i in range(width)) + ")"


def fits(sum_: str, value: str, d: str) -> str:
    return f"coalesce(({d}='<' and regexp_full_match({value},'<+')) or ({sum_} % 10 = case when {d}='<' then 0 when regexp_full_match({d},'[0-9]') then cast({d} as int) end), false)"


def dated(e: str) -> str:
    two = lambda i: f"try_cast(case when regexp_full_match(substr({e},{i},2),'[0-9]{{2}}') then substr({e},{i},2) end as int)"
    return f"coalesce({two(3)} between 1 and 12 and {two(5)} between 1 and 31, false)"


def _corrected(prefix: str, width: int, date: bool) -> tuple[str, str]:
    """SQL of a CTE step: candidates, then the chosen value and digit, from columns <p>v and <p>d."""
    v, d, full, read, sum_ = f"{prefix}v", f"{prefix}d", f"{prefix}full", f"{prefix}read", f"{prefix}sum"
    singles = []
    for i in range(width):
        old, new = f"substr({v},{i + 1},1)", f"substr({full},{i + 1},1)"
        changed = f"(substr({v},1,{i})||{new}||substr({v},{i + 2}))"
        singles.append(f"case when {old}<>{new} and {fits(f'({sum_}+({_value(new)}-{_value(old)})*{WEIGHTS[i % 3]})', changed, read)}" + (f" and {dated(changed)}" if date else "") + f" then {changed} end")
    ok = lambda e, s: fits(s, e, read) + (f" and {dated(e)}" if date else "")
    one = f"list_filter([{','.join(singles)}], lambda x: x is not null) as {prefix}one, ({ok(v, sum_)}) as {prefix}asis, ({full}<>{v} and {ok(full, total(full, width))}) as {prefix}whole"
    pick = f"case when {prefix}asis then {v} when len({prefix}one)=1 then {prefix}one[1] when len({prefix}one)=0 and {prefix}whole then {full} end"
    return one, pick


#: What is read, and the letters that it may stand for.
MISREAD = ("0O", "1I", "2Z", "5S", "8B", "6G", "6B", "VU", "UV")


def country(e: str) -> str:
    """A code as it is if valid, else the only nearest valid code that misread letters explain, else what was read."""
    code, pairs = f"upper(trim({e}))", ",".join(f"'{x}'" for x in MISREAD)
    at = lambda i: f"case when substr({code},{i},1)=substr(v,{i},1) then 0 when substr({code},{i},1)||substr(v,{i},1) in ({pairs}) then 1 else 9 end"
    near = f"list_filter(list_transform([{_codes()}], lambda v: {{'d': {at(1)}+{at(2)}+{at(3)}, 'v': v}}), lambda x: x.d < 9)"
    # the nearest stands first in order; it is the only one if no other is as near
    best = f"list_transform([list_sort({near})], lambda l: case when len(l)=0 then null when len(l)>1 and l[2].d=l[1].d then null else l[1].v end)[1]"
    return f"case when length(trim({e}))<>3 then {e} when {code} in ({_codes()}) then {code} else coalesce({best}, {e}) end"


def _codes() -> str:
    return ",".join(f"'{c}'" for c in CODES)


def _names(e: str, cleaned: bool) -> tuple[str, str]:
    n = f"regexp_replace({e},'^<+','')"
    first = f"(case when instr({n},'<<')>0 then substr({n},1,instr({n},'<<')-1) else {n} end)"
    second = f"(case when instr({n},'<<')>0 then substr({n},instr({n},'<<')+2) else '' end)"
    tidy = clean_name if cleaned else (lambda x: f"trim(replace({x},'<',' '))")
    return tidy(first), tidy(second)


def clean_name(e: str) -> str:
    words = f"list_filter(regexp_split_to_array(replace({e},'<',' '),'\\s+'), lambda w: w<>'')"
    return f"array_to_string(list_filter({words}, lambda w, i: not (regexp_full_match(upper(w),'[SREKCX]{{3,}}') and len(list_distinct(regexp_extract_all(upper(w),'.')))<=3) and not (i>1 and i=len({words}) and regexp_full_match(upper(w),'[SREKCX]'))), ' ')"


def bare(e: str) -> str:
    return f"replace({e},'<','')"


COLUMNS = ("valid_format", "document_code", "issuing_state", "surname", "given_names", "document_number", "nationality", "date_of_birth", "sex", "date_of_expiry", "number_ok", "birth_ok", "expiry_ok", "personal_ok", "composite_ok", "birth_valid", "expiry_valid", "sex_valid", "state_valid", "nationality_valid", "overall_valid")


def parse_sql(kind: str, src: str, final: str = "select * from t7") -> str:
    """The rows of ``parse`` over a source (or its SQL) whose lines need no normalising and whose names reach no filler zone."""
    x = LAYOUTS[kind]
    wide = 44 if kind == "TD2" else x.width
    lines = ", ".join(f"rpad(line{k},{wide},'<') as l{k}" for k in range(1, x.lines + 1))
    shaped = " and ".join(f"length(line{k})={x.width}" for k in range(1, x.lines + 1))
    cut = lambda p: f"substr(l{p[0]},{p[1] + 1},{p[2] - p[1]})"
    after = lambda p: f"substr(l{p[0]},{p[2] + 1},1)"
    fields = (("n", x.number, 9, False), ("b", x.birth, 6, True), ("e", x.expiry, 6, True))
    fix = kind != "TD1"
    base = f"select k, line1, line2, {shaped} as ok, {lines} from ({SQL.get(src, src)}) s"
    split = ", ".join(f"{cut(p)} as {f}v, {after(p)} as {f}d" for f, p, _, _ in fields)
    state, nat = country("substr(l1,3,3)"), country(cut(x.nationality))
    t1 = f"select *, {split}, {state} as st, {nat} as nt from t0"
    reads = ", ".join(f"translate({f}d,'{A}','{B}') as {f}read, translate({f}v,'{A}','{B}') as {f}full, {total(f'{f}v', w)} as {f}sum" for f, _, w, _ in fields)
    steps = {f: _corrected(f, w, date) for f, _, w, date in fields}
    t3 = ", ".join(steps[f][0] for f in "nbe")
    value = {f: (f"coalesce({steps[f][1]},{f}v)" if fix else f"{f}v") for f in "nbe"}
    dig = {f: (f"case when ({steps[f][1]}) is not null then {f}read else {f}d end" if fix else f"{f}d") for f in "nbe"}
    t4 = ", ".join(f"{value[f]} as {f}w, {dig[f]} as {f}c" for f in "nbe")
    sex = cut(x.sex)
    if kind in ("TD3", "TD2"):
        sex = f"case when {sex} in ('0','1','I','L') then '<' when {sex}='E' then 'F' else {sex} end"
    t4 += f", {sex} as sx, {bare('st') if fix else 'st'} as stc, {bare('nt') if fix else 'nt'} as ntc"
    if kind == "TD1":
        payload, comp = "||".join(cut(p) for p in x.composite), cut(x.composite_at)
    elif kind == "TD3":
        payload, comp = "nw||nc||bw||bc||ew||ec||substr(l2,29,15)", "cd"
        t4 += f", substr(l2,44,1) as cd0, translate(substr(l2,44,1),'{A}','{B}') as cd1"
    elif kind == "TD2":
        payload, comp = "nw||nc||bw||bc||ew||ec||substr(l2,29,7)", cut(x.composite_at)
    else:
        payload = comp = None
    width = sum(e - b for _, b, e in x.composite)
    t5 = ", ".join(f"{fits(total(f'{f}w', w), f'{f}w', f'{f}c')} as {'num' if f == 'n' else f}ok" for f, _, w, _ in fields)
    t5 += f", coalesce(stc in ({_codes()}), false) as sok, coalesce(ntc in ({_codes()}), false) as ncok"
    if kind == "TD3":
        t5 += f", case when cd1<>cd0 and {fits(total('pl', 39), 'pl', 'cd1')} then cd1 else cd0 end as cd"
    pers = "cast(null as boolean)"
    if kind == "TD3":
        pers = f"(regexp_full_match(substr(l2,29,14),'<+') or substr(l2,43,1)='<' or {fits(total('substr(l2,29,14)', 14), 'substr(l2,29,14)', 'substr(l2,43,1)')})"
    okc = fits(total("pl", width), "pl", comp) if payload else "cast(null as boolean)"
    surname, given = _names(cut(x.names), x.clean_names)
    strict = (lambda e: f"(regexp_full_match({e},'[0-9]{{6}}') and {dated(e)})") if x.visa else dated
    code = "substr(l1,1,2)" if kind not in ("TD3", "TD2") else "('P'||substr(l1,2,1))"
    sexes = "('M','F','X','<')" if x.visa else "('M','F','X')"
    return f"""
with t0 as ({base}), t1 as ({t1}), t2 as (select *, {reads} from t1), t3 as (select *, {t3} from t2), t4 as (select *, {t4} from t3),
t4b as (select *, {payload or "''"} as pl from t4), t5 as (select *, {t5} from t4b),
t6 as (select *, {pers} as pok, {okc} as cok, {strict('bw')} as bdv, {strict('ew')} as edv, sx in {sexes} as sxv from t5),
t7 as (select k, ok as valid_format, case when ok then replace({code},'<','') end as document_code, case when ok then stc end as issuing_state, case when ok then {surname} end as surname, case when ok then {given} end as given_names,
 case when ok then replace(nw,'<','') end as document_number, case when ok then ntc end as nationality, case when ok then bw end as date_of_birth, case when ok then case when sx in ('M','F','X') then sx else '' end end as sex, case when ok then ew end as date_of_expiry,
 case when ok then numok end as number_ok, case when ok then bok end as birth_ok, case when ok then eok end as expiry_ok, case when ok then pok end as personal_ok, case when ok then cok end as composite_ok,
 case when ok then bok and bdv end as birth_valid, case when ok then eok and edv end as expiry_valid, case when ok then sxv end as sex_valid, case when ok then sok end as state_valid, case when ok then ncok end as nationality_valid,
 coalesce(ok and numok and bok and eok and ncok and sok{' and bdv and edv and sxv' if x.visa else ''} and coalesce(pok,true) and coalesce(cok,true), false) as overall_valid from t6)
{final}"""


def _changes(line: int, base: int, before: str, after: str, width: int, field: str) -> str:
    one = lambda i: f"case when substr({before},{i + 1},1)<>substr({after},{i + 1},1) then '{line}:{base + i}:'||substr({before},{i + 1},1)||':'||substr({after},{i + 1},1)||':{field}' end"
    return f"[{','.join(map(one, range(width)))}]"


def td3_log_sql(src: str) -> str:
    """Second line as read and as corrected, and the log of corrections in order."""
    logs = [_changes(1, 0, "l1", "'P'", 1, "document_code"), _changes(1, 2, "substr(l1,3,3)", "st", 3, "issuing_state")]
    for f, begin, width, name in (("n", 0, 9, "passport_number"), ("", 10, 3, "nationality"), ("b", 13, 6, "date_of_birth"), ("s", 20, 1, "sex"), ("e", 21, 6, "date_of_expiry")):
        if name == "nationality":
            logs.append(_changes(2, begin, "substr(l2,11,3)", "nt", 3, name))
        elif name == "sex":
            logs.append(_changes(2, begin, "substr(l2,21,1)", "sx", 1, name))
        else:
            logs += [_changes(2, begin + width, f"{f}d", f"{f}c", 1, f"{name}_check_digit"), _changes(2, begin, f"{f}v", f"{f}w", width, name)]
    logs.append(_changes(2, 43, "substr(l2,44,1)", "cd", 1, "composite_check_digit"))
    whole = "nw||nc||nt||bw||bc||sx||ew||ec||substr(l2,29,15)||cd"
    log = f"array_to_string(list_filter(flatten([{','.join(logs)}]), lambda x: x is not null), ';')"
    return parse_sql("TD3", src, f"select k, line2 as raw_line2, case when ok then {whole} else line2 end as line2, case when ok then {log} else '' end as log from t6")


def _normal(e: str) -> str:
    u = f"translate(upper(trim({e})),'«‹{{([]|','<<<<<<<')"
    return f"regexp_replace(case when {u} like 'P%' and (instr({u},'<')>0 or not regexp_matches(substr({u},1,5),'[0-9]')) then replace({u},' ','<') else replace({u},' ','') end, '[^A-Z0-9<]', '', 'g')"


def candidates_sql(src: str) -> str:
    """Scored candidates of passport zones, the only ones in ``src``: doc_id, source, group_kind, pos, format, score, rank, and what the parser made."""
    fillers, digits = (lambda e: f"(length({e})-length(replace({e},'<','')))"), (lambda e: f"length(regexp_replace({e},'[^0-9]','','g'))")
    groups = f"""select *, {_normal('g1')} as n1, {_normal('g2')} as n2 from (
select doc_id, source_ordinal, source, 1 as group_kind, i as pos, line as g1, a as g2 from c where a is not null union all
select doc_id, source_ordinal, source, 2, i, line, b from c where b is not null) u"""
    passport = f"length(n1) between 36 and 52 and length(n2) between 36 and 52 and not (n1 like 'V%' and {digits('n2')}>=4) and not (substr(n1,1,1) in ('I','A','C') and instr(n1,'<')>0 and length(n1)<=40 and length(n2)<=40 and {digits('n2')}>=8) and ((n1 like 'P%' and instr(n1,'<')>0 and {digits('n2')}>=4) or {fillers('n1')}+{fillers('n2')}>=6)"
    lines = f"select doc_id, source_ordinal, source, trim(line) as line, row_number() over w as i, lead(trim(line),1) over w as a, lead(trim(line),2) over w as b from (select doc_id, source_ordinal, source, generate_subscripts(string_split(text, chr(10)),1) as p, unnest(string_split(text, chr(10))) as line from {src}) l where length(trim(line))>=12 window w as (partition by doc_id, source_ordinal order by p)"
    key = "doc_id||'|'||source_ordinal||'|'||group_kind||'|'||pos"
    made = parse_sql("TD3", f"select {key} as k, rpad(n1,44,'<') as line1, rpad(n2,44,'<') as line2 from shaped")
    near = lambda e: f"greatest(0.0, 15.0-abs(length({e})-44)*2.5)"
    points = "+".join(f"case when coalesce(m.{c},false) then {n} else 0 end" for c, n in (("number_ok", 15), ("birth_ok", 15), ("expiry_ok", 15), ("personal_ok", 15), ("composite_ok", 15), ("overall_valid", 100), ("nationality_valid", 15), ("state_valid", 15)))
    score = f"length(regexp_replace(upper(g1||g2),'[^A-Z0-9<]','','g'))/greatest(1,length(g1||g2))*30.0 + {near('g1')} + {near('g2')} + case when m.valid_format then {points}+50.0 else 0.0 end"
    return f"""(with c as ({lines}), shaped as (select * from ({groups}) g where {passport}), m as ({made}), s as (select shaped.*, m.document_number, m.overall_valid, cast({score} as double) as score from shaped join m on m.k={key})
select *, 'TD3' as format, row_number() over (partition by doc_id order by score desc, source_ordinal, group_kind, pos) as rank from s)"""

