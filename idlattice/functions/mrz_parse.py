"""Parser of the five machine-readable zones: layouts are a table that rows are joined to, places are columns.

A row names its format; the join gives it the places of the fields, and one plan slices, corrects and checks the rows of
all formats. What is done to a checked field is written once, over an array of the fields. The result is one struct:
format, lines as read and as corrected, the log of corrections, fields, check digits, validity of fields, and the
verdict over all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mrz_correct as fix
from .countries import correct_country, is_country
from .mrz_digits import ALPHABET, FIELD_CONFUSIONS, MONTH_AND_DAY_FIT, WEIGHTS
from .mrz_lines import normalize_line, split_names


@dataclass(frozen=True)
class Layout:
    """Width of a line, number of lines, and for each field (line, begin, end), counted from 0."""

    name: str
    width: int
    lines: int
    number: tuple[int, int, int]
    birth: tuple[int, int, int]
    expiry: tuple[int, int, int]
    sex: tuple[int, int, int]
    nationality: tuple[int, int, int]
    names: tuple[int, int, int]
    composite: tuple[tuple[int, int, int], ...]
    composite_at: tuple[int, int, int] | None
    optional: tuple[tuple[int, int, int], ...]
    visa: bool = False
    clean_names: bool = True
    #: How lines are corrected: "full" also sets the first character, reads sex and fillers and proves the composite digit;
    #: "plain" doesn't; "card" corrects countries as fields only.
    mode: str = "full"
    personal: tuple[int, int, int] | None = None
    #: Lines are padded to this many characters before they are corrected.
    wide: int | None = None


TD3 = Layout("TD3", 44, 2, (2, 0, 9), (2, 13, 19), (2, 21, 27), (2, 20, 21), (2, 10, 13), (1, 5, 44), ((2, 0, 10), (2, 13, 20), (2, 21, 43)), (2, 43, 44), ((2, 28, 42),), personal=(2, 28, 42))
MRVA = Layout("MRVA", 44, 2, (2, 0, 9), (2, 13, 19), (2, 21, 27), (2, 20, 21), (2, 10, 13), (1, 5, 44), (), None, ((2, 28, 44),), visa=True, mode="plain")
MRVB = Layout("MRVB", 36, 2, (2, 0, 9), (2, 13, 19), (2, 21, 27), (2, 20, 21), (2, 10, 13), (1, 5, 36), (), None, ((2, 28, 36),), visa=True, mode="plain")
TD1 = Layout("TD1", 30, 3, (1, 5, 14), (2, 0, 6), (2, 8, 14), (2, 7, 8), (2, 15, 18), (3, 0, 30), ((1, 5, 30), (2, 0, 7), (2, 8, 15), (2, 18, 29)), (2, 29, 30), ((1, 15, 30), (2, 18, 29)), clean_names=False, mode="card")
TD2 = Layout("TD2", 36, 2, (2, 0, 9), (2, 13, 19), (2, 21, 27), (2, 20, 21), (2, 10, 13), (1, 5, 36), ((2, 0, 10), (2, 13, 20), (2, 21, 35)), (2, 35, 36), ((2, 28, 35),), clean_names=False, wide=44)
LAYOUTS = {x.name: x for x in (TD3, MRVA, MRVB, TD1, TD2)}
STATE = (1, 2, 5)


_PLACE = "array<int>"
_COLUMNS = {"number": _PLACE, "birth": _PLACE, "expiry": _PLACE, "sex": _PLACE, "nationality": _PLACE, "names": _PLACE, "personal": _PLACE, "composite_at": _PLACE, "composite": f"array<{_PLACE}>", "optional": f"array<{_PLACE}>", "width": "int", "lines": "int", "wide": "int", "visa": "boolean", "clean_names": "boolean", "mode": "string"}


def layouts(spark: SparkSession, corrected: bool = True) -> DataFrame:
    """The layouts as a table: __fmt and __at, a struct of the places; five rows."""

    def literal(value: object) -> str:
        if value is None:
            return "null"
        if isinstance(value, tuple):
            return f"array({', '.join(map(literal, value))})"
        return f"'{value}'" if isinstance(value, str) else str(value).lower()

    def row(x: Layout) -> str:
        own = {"wide": x.wide or x.width} | ({} if corrected or x.mode == "card" else {"mode": "none"})
        return f"('{x.name}', named_struct({', '.join(f"'{c}', cast({literal(own.get(c, getattr(x, c)))} as {kind})" for c, kind in _COLUMNS.items())}))"

    return spark.sql(f"select * from values {', '.join(map(row, LAYOUTS.values()))} as layouts(__fmt, __at)")


# Expressions are written as SQL text: built sign by sign through the driver's gateway they take longer than the work.


def _cut(lines: str, place: str) -> str:
    return f"substring(element_at({lines}, {place}[0]), {place}[1] + 1, {place}[2] - {place}[1])"


def _behind(lines: str, place: str) -> str:
    """The check digit behind a field."""
    return f"substring(element_at({lines}, {place}[0]), {place}[2] + 1, 1)"


def _value(sign: str) -> str:
    return f"greatest(instr('{ALPHABET}', {sign}) - 1, 0)"


_WEIGHT = f"array({', '.join(map(str, WEIGHTS))})[i % 3]"


def _sum(text: str) -> str:
    return f"aggregate(transform(split({text}, ''), (c, i) -> {_value('c')} * {_WEIGHT}), 0, (total, v) -> total + v)"


def _matches(total: str, digit: str) -> str:
    """Whether a digit fits a weighted sum; a filler counts as 0."""
    return f"coalesce(length({digit}) = 1 and ({total}) % 10 = instr('0123456789', translate({digit}, '<', '0')) - 1, false)"


def _fits(date: str) -> str:
    return f"coalesce({date} rlike '{MONTH_AND_DAY_FIT}', false)"


_NONE = f"cast(array() as {fix.CORRECTION})"


def _log(line: object, base: object, before: str, after: str, name: str) -> str:
    """An entry for each position at which two strings of one length differ."""
    one, other = f"substring({before}, i + 1, 1)", f"substring({after}, i + 1, 1)"
    entry = f"named_struct('line', {line}, 'position', i + {base}, 'from_char', {one}, 'to_char', {other}, 'field', {name})"
    entries = f"filter(transform(sequence(0, length({before}) - 1), i -> if({one} <> {other}, {entry}, null)), x -> x is not null)"
    return f"case when {before} <> {after} then {entries} else {_NONE} end"  # most have none


def _proven(fields: str) -> str:
    """array of (line, at, value, digit, name, dated, open) -> array of (value, digit, log), corrected where the digit proves it.

    The digit is read through the confusions first. If the field fits, it stays. Else each confusable character alone is
    tried (the sum changes by its weight times the change of value), and only if none fits all together. A change is made if
    exactly one candidate is right.
    """

    def translated(text: str) -> str:
        return f"translate({text}, '{FIELD_CONFUSIONS[0]}', '{FIELD_CONFUSIONS[1]}')"

    def fits(date: str) -> str:
        return f"(not g.f.dated or {_fits(date)})"

    def nested(text: str) -> str:
        return text.replace("g.", "h.g.")

    read = f"transform({fields}, f -> named_struct('f', f, 'r', {translated('f.digit')}, 'w', {translated('f.value')}, 'total', {_sum('f.value')}))"
    asis = f"{_matches('g.total', 'g.r')} and {fits('g.f.value')}"
    judged = f"transform({read}, g -> named_struct('g', g, 'asis', {asis}, 'doubtful', g.f.open and g.w <> g.f.value and not ({asis})))"
    old, new = "substring(g.f.value, i + 1, 1)", "substring(g.w, i + 1, 1)"
    changed = f"overlay(g.f.value, {new}, i + 1, 1)"
    total = f"g.total + ({_value(new)} - {_value(old)}) * {_WEIGHT}"
    right = f"{old} <> {new} and {_matches(total, 'g.r')} and {fits(changed)}"
    single = f"filter(transform(sequence(0, length(g.f.value) - 1), i -> if({right}, {changed}, null)), x -> x is not null)"
    whole = f"{_matches(_sum('g.w'), 'g.r')} and {fits('g.w')}"
    tried = f"transform({judged}, h -> named_struct('f', h.g.f, 'r', h.g.r, 'w', h.g.w, 'asis', h.asis, 'one', if(h.doubtful, {nested(single)}, cast(array() as array<string>)), 'whole', h.doubtful and {nested(whole)}))"
    found = f"transform({tried}, k -> named_struct('f', k.f, 'r', k.r, 'p', case when not k.f.open then null when k.asis then k.f.value when size(k.one) = 1 then k.one[0] when size(k.one) = 0 and k.whole then k.w end))"
    made = f"transform({found}, m -> named_struct('f', m.f, 'value', coalesce(m.p, m.f.value), 'digit', if(m.p is not null, m.r, m.f.digit)))"
    digit_log = _log("n.f.line", "n.f.at + length(n.f.value)", "n.f.digit", "n.digit", "concat(n.f.name, '_check_digit')")
    value_log = _log("n.f.line", "n.f.at", "n.f.value", "n.value", "n.f.name")
    return f"transform({made}, n -> named_struct('value', n.value, 'digit', n.digit, 'log', concat({digit_log}, {value_log})))"


def parse_by_format(df: DataFrame, fmt: str, lines: list[str], corrected: bool = True, td2_keep_doc_code: bool = False) -> DataFrame:
    """The rows of df whose column ``fmt`` names a layout, with ``mrz``. Lines of another width give valid_format false and no fields.

    lines: two or three columns; a format of fewer lines doesn't look at the third.
    td2_keep_doc_code: TD2 lines are corrected like TD3, which sets their first character to P; True leaves it.
    """
    own = df.columns
    df = df.join(F.broadcast(layouts(df.sparkSession, corrected)), F.col(fmt) == F.col("__fmt"))
    df = df.withColumn("__raw", F.slice(F.array(*[normalize_line(F.coalesce(F.col(c), F.lit(""))) for c in lines]), F.lit(1), F.col("__at.lines")))
    df = df.selectExpr("*", "transform(__raw, x -> rpad(x, __at.wide, '<')) as __l", "forall(__raw, x -> length(x) = __at.width) as __shaped")

    full, linewise = "__at.mode = 'full'", "__at.mode in ('full', 'plain')"
    one, two = "__l[0]", "__l[1]"
    names = {"number": f"if({full}, 'passport_number', 'document_number')", "birth": "'date_of_birth'", "expiry": "'date_of_expiry'"}

    def field(c: str) -> str:
        place = f"__at.{c}"
        return f"named_struct('line', {place}[0], 'at', {place}[1], 'value', {_cut('__l', place)}, 'digit', {_behind('__l', place)}, 'name', {names[c]}, 'dated', {str(c != 'number').lower()}, 'open', {linewise})"

    codes = F.expr(f"array(substring({one}, 3, 3), {_cut('__l', '__at.nationality')})")
    sex, keep = F.expr(_cut("__l", "__at.sex")), f"__at.mode <> 'full' or ({str(td2_keep_doc_code).lower()} and __fmt = 'TD2')"
    df = df.withColumns({
        "__f": F.expr(_proven(f"array({', '.join(map(field, names))})")),
        "__codes": F.when(F.expr("__at.mode = 'none'"), codes).otherwise(F.transform(codes, correct_country)),
        "__code": F.expr(f"if({keep}, substring({one}, 1, 1), 'P')"),
        "__sex": F.when(F.expr(full), fix.correct_sex(sex)).otherwise(sex),
    })
    df = df.withColumn("__head", F.expr(f"concat(__code, substring({one}, 2, 1), __codes[0], substring({one}, 6, 100))"))
    rest, seal = f"substring({two}, 29, if({full}, 15, 100))", f"substring({two}, 44, 1)"
    payload = F.expr(f"concat({', '.join(f'__f[{k}].value, __f[{k}].digit' for k in range(3))}, {rest})")
    df = df.withColumns({
        "__first": F.when(F.expr(full), fix.correct_trailing_fillers(F.col("__head"))).otherwise(F.col("__head")),
        "__seal": F.when(F.expr(full), fix.correct_composite(payload, F.expr(seal))).otherwise(""),
    })
    second = f"concat(__f[0].value, __f[0].digit, __codes[1], __f[1].value, __f[1].digit, __sex, __f[2].value, __f[2].digit, {rest}, __seal)"
    states = _log(1, 2, f"substring({one}, 3, 3)", "__codes[0]", "'issuing_state'")
    nations = _log("__at.nationality[0]", "__at.nationality[1]", _cut("__l", "__at.nationality"), "__codes[1]", "'nationality'")
    sealed = _log(2, 43, seal, "__seal", "'composite_check_digit'")
    lined = [_log(1, 0, f"substring({one}, 1, 1)", "__code", "'document_code'"), states, _log(1, 0, "__head", "__first", "'filler'"), "__f[0].log", nations, "__f[1].log"]
    lined += [_log("__at.sex[0]", "__at.sex[1]", _cut("__l", "__at.sex"), "__sex", "'sex'"), "__f[2].log", f"if({full}, {sealed}, {_NONE})"]
    df = df.selectExpr(
        "*",
        f"case when {linewise} then concat({', '.join(lined)}) when __at.mode = 'card' then concat({states}, {nations}) else {_NONE} end as __log",
        f"transform(if({linewise}, array(__first, {second}), __l), x -> substring(x, 1, __at.width)) as __cut",
    )
    return _told(df).select(*[f"`{c}`" for c in own if c != "mrz"], "mrz")


def _told(df: DataFrame) -> DataFrame:
    """df with ``mrz`` from the corrected lines ``__cut``."""

    def cut(name: str) -> str:
        return _cut("__cut", f"__at.{name}")

    def shown(place: str) -> str:
        return f"replace({_cut('__cut', place)}, '<', '')"

    composite = f"array_join(transform(__at.composite, p -> {_cut('__cut', 'p')}), '')"
    pairs = [f"named_struct('v', {cut(c)}, 'd', {_behind('__cut', f'__at.{c}')})" for c in ("number", "birth", "expiry", "personal")]
    pairs.append(f"named_struct('v', {composite}, 'd', {cut('composite_at')})")
    df = df.selectExpr(
        "*",
        f"transform(array({', '.join(pairs)}), x -> {_matches(_sum('x.v'), 'x.d')}) as __d",
        f"if(__at.mode = 'card', __codes, transform(array(array({', '.join(map(str, STATE))}), __at.nationality), p -> {shown('p')})) as __n",
        f"transform(array({cut('birth')}, {cut('expiry')}), x -> {_fits('x')} and (not __at.visa or x rlike '^[0-9]{{6}}$')) as __t",
        f"{cut('sex')} as __s",
    ).withColumn("__names", split_names(F.expr(cut("names")), F.col("__at.clean_names")))
    flags = {
        "number_ok": "__d[0]", "birth_ok": "__d[1]", "expiry_ok": "__d[2]",
        "personal_ok": f"if(__at.personal is not null, {cut('personal')} rlike '^<+$' or {_behind('__cut', '__at.personal')} = '<' or __d[3], null)",
        "composite_ok": "if(__at.composite_at is not null, __d[4], null)",
        "birth_valid": "__d[1] and __t[0]", "expiry_valid": "__d[2] and __t[1]", "sex_valid": "__s in ('M', 'F', 'X') or (__at.visa and __s = '<')",
    }
    known = {k: F.expr(v) for k, v in flags.items()} | {"state_valid": is_country(F.expr("__n[0]")), "nationality_valid": is_country(F.expr("__n[1]"))}
    df = df.withColumn("__ok", F.struct(*[v.alias(k) for k, v in known.items()]))
    overall = "__ok.number_ok and __ok.birth_ok and __ok.expiry_ok and __ok.state_valid and __ok.nationality_valid and coalesce(__ok.personal_ok, true) and coalesce(__ok.composite_ok, true)"
    fields = {
        "document_code": "replace(substring(__cut[0], 1, 2), '<', '')", "issuing_state": "__n[0]", "surname": "__names[0]", "given_names": "coalesce(get(__names, 1), '')", "document_number": shown("__at.number"), "nationality": "__n[1]",
        "date_of_birth": cut("birth"), "sex": "if(__s in ('M', 'F', 'X'), __s, '')", "date_of_expiry": cut("expiry"), "optional": f"array_join(transform(__at.optional, p -> {shown('p')}), '|')",
    } | {k: f"__ok.{k}" for k in known}
    made = {"format": "__fmt", "valid_format": "__shaped"} | {f"raw_line{k + 1}": f"get(__raw, {k})" for k in range(3)} | {f"line{k + 1}": f"get(if(__shaped, __cut, __raw), {k})" for k in range(3)}
    made |= {"corrections": f"if(__shaped, __log, {_NONE})"} | {k: f"if(__shaped, {v}, null)" for k, v in fields.items()}
    made["overall_valid"] = f"coalesce(__shaped and {overall} and (not __at.visa or (__ok.birth_valid and __ok.expiry_valid and __ok.sex_valid)), false)"
    return df.selectExpr("*", "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in made.items()) + ") as mrz")


def parse(df: DataFrame, kind: str, lines: list[str], corrected: bool = True, td2_keep_doc_code: bool = False) -> DataFrame:
    """df with ``mrz``, all rows read as one format."""
    return parse_by_format(df.withColumn("__kind", F.lit(kind)), "__kind", lines, corrected, td2_keep_doc_code).drop("__kind")
