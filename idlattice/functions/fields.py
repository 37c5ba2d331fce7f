"""Fields read from the text of a document: classification, printed fields, dates, names, masking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that tell the class of a document, in order of precedence.
KEYWORDS = {
    "visa": ("VISA", "ENTRY PERMIT", "CONTROL NUMBER", "NUMBER OF ENTRIES", "VISA TYPE", "VALID FOR"),
    "passport": ("PASSPORT", "PASSEPORT", "TRAVEL DOCUMENT", "REPUBLIC OF"),
    "national_id": ("IDENTITY CARD", "NATIONAL ID", "AADHAAR", "CITIZEN", "DRIVING LICENCE", "IDENTITY NUMBER", "IDENTIFICATION", "ELECTION COMMISSION"),
}
#: Words of headings, never part of a person's name.
HEADINGS = (
    "GOVERNMENT", "GOVT", "INDIA", "BHARAT", "REPUBLIC", "STATE", "UNION", "AUTHORITY", "UNIQUE", "IDENTIFICATION", "ELECTION",
    "COMMISSION", "INCOME", "TAX", "DEPARTMENT", "TRANSPORT", "MINISTRY", "DIRECTORATE", "IDENTITY", "CARD", "NATIONAL", "AADHAAR",
    "AADHAR", "MERA", "PEHCHAN", "ENROLMENT", "ENROLLMENT", "RESIDENT", "CITIZEN", "DRIVING", "LICENCE", "LICENSE", "PERMANENT", "ACCOUNT",
    "NUMBER", "VOTER", "ELECTOR", "PHOTO", "SIGNATURE", "OFFICIAL", "HELP", "LINE", "WWW", "GOV", "IN", "NIC", "DOWNLOAD", "DATE", "MALE",
    "FEMALE", "GENDER", "SEX", "DOB", "YEAR", "BIRTH", "ADDRESS", "ISSUE", "EXPIRY", "VALID", "FATHER", "MOTHER", "HUSBAND", "WIFE",
)
#: Fixed value: how a date is printed.
DATE = r"([0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}|[0-9]{2}\s+[A-Za-z]{3,9}\s+[0-9]{4}|[0-9]{4}[/.-][0-9]{2}[/.-][0-9]{2})"
#: Patterns of printed fields; each first group is the value, earlier patterns win.
VISA_PATTERNS = {
    "visa_type": (r"(?:Visa\s*Type\s*/\s*Class|Type\s*/\s*Class|Visa\s*Type|Type\s*de\s*visa|Visa\s*Category|Category|Class)\s*[:\s]\s*([A-Za-z0-9/_-]+)", r"\b(?:Type|Class)\s*:\s*([A-Za-z0-9/_-]+)"),
    "entries": (r"(?:Entries|No\s*of\s*Entries|Number\s*of\s*Entries|Nombre\s*d'\s*entrées|Entries\s*/\s*Entrées)[:\s]+(MULTIPLE|SINGLE|DOUBLE|MULT|\bM\b|\bS\b|\bD\b|\b[12]\b)", r"\bEntries[:\s]+([A-Za-z0-9]+)"),
    "issue_date": (r"(?:Issue\s*Date|Date\s*of\s*Issue|Issued|Date\s*d'\s*émission|Issued\s*On)[:\s]+" + DATE,),
    "expiry_date": (r"(?:Expiry\s*Date|Date\s*of\s*Expiry|Expiration\s*Date|Expires\s*On|Valid\s*Until|Date\s*d'\s*expiration|Expires)[:\s]+" + DATE,),
    "passport_number": (r"(?:Passport\s*No|Passport\s*Number|Pass\s*No|Passport\s*/\s*Passeport|Passeport\s*No)[:\s]+([A-Z0-9]{7,12})",),
    "visa_number": (r"(?:Visa\s*No|Visa\s*Number|Control\s*Number|Document\s*No|Visa\s*#)[:\s]+([A-Z0-9]{7,14})", r"\bControl\s*Number[:\s]+([0-9]{8,14})"),
    "name": (r"(?:Name|Full\s*Name|Given\s*Name|Surname|Bearer|Holder)[:\s]+([A-Za-z\s.'-]{2,50})(?:\n|$)",),
    "issuing_authority": (r"(?:Authority|Issuing\s*Post|Issued\s*By|Embassy|Consulate)[:\s]+([A-Za-z0-9\s,.-]+)(?:\n|$)",),
}
PASSPORT_PATTERNS = {
    "passport_number": (r"(?:Passport\s*No|Passport\s*Number|Passeport\s*No|Passport\s*/\s*Passeport|Doc\s*No|Document\s*No|Passport\s*#)[:\s]+([A-Z0-9]{7,12})", r"\bPassport[:\s]+([A-Z0-9]{7,12})"),
    "date_of_birth": (r"(?:Date\s*of\s*Birth|Birth\s*Date|DOB|Date\s*de\s*naissance)[:\s]+" + DATE,),
    "date_of_expiry": (r"(?:Date\s*of\s*Expiry|Expiry\s*Date|Expiration\s*Date|Date\s*d'\s*expiration|Expires)[:\s]+" + DATE,),
    "surname": (r"(?:Surname|Nom)[:\s]+([A-Z\s'-]{2,30})",),
    "given_names": (r"(?:Given\s*Names|Given\s*Name|Prénoms|Prenoms|First\s*Name)[:\s]+([A-Z\s'-]{2,40})",),
    "full_name": (r"(?:Full\s*Name|Name|Nom\s*complet)[:\s]+([A-Z\s'-]{3,50})",),
    "sex": (r"(?:Sex|Gender|Sexe)[:\s]+([MFX]|MALE|FEMALE|HOMME|FEMME)",),
    "nationality": (r"(?:Nationality|Nationalité)[:\s]+([A-Z]{3}|[A-Za-z\s]{3,20})",),
}
ID_PATTERNS = {
    "grouped": (r"\b([0-9]{4}\s[0-9]{4}\s[0-9]{4})\b",),
    "labelled": (r"(?:ID No|Identity No|National ID|Card No|Card Number|Document No|Document Number|ID Number|Aadhaar|Voter ID|PAN|SSN)[:\s#]+([A-Z0-9 -]{5,20})",),
    "nationality": (r"(?:Nationality|Citizen of)[:\s]+([A-Za-z]+)",),
    "address": (r"(?:Address|Permanent Address|Residence)[:\s]+([^\n]+(?:\n[^\n]+)?)",),
    "authority": (r"(?:Authority|Issued By|Government of)[:\s]+([A-Za-z\s,]+)(?:\n|$)",),
    "gender": (r"(?:Gender|Sex|Gender\s*/\s*Sex|Sex\s*/\s*Gender)[:\s]+(MALE|FEMALE|TRANSGENDER|OTHER|\bM\b|\bF\b)",),
    "birth": (r"(?:DOB|Date of Birth|Birth Date|Birth|D\.O\.B|Year of Birth|YOB)[:\s/]+([0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}|[0-9]{4}[/.-][0-9]{2}[/.-][0-9]{2}|[0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{4}|[0-9]{4})",),
}
#: Words that are headings where a type or a name is looked for.
NOT_A_TYPE = ("/", "-", "_", "CLASS", "CATEGORY", "PASSPORT", "VISA", "NUMBER", "DATE", "CONTROL")
NOT_A_NAME = ("VISA", "UNITED STATES", "CONTROL NUMBER")


def first_match(text: Column, patterns: tuple[str, ...], ignore_case: bool = True) -> Column:
    """Trimmed first group of the first pattern that matches, else null. No pattern's group may be empty."""
    flag = lambda p: "" if not ignore_case else "(?i)" if p.isascii() else "(?iu)"
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, flag(p) + p, 1), F.lit("")) for p in patterns])
    return F.regexp_replace(found, r"^\s+|\s+$", "")


def classify(text: Column, mrz_format: Column, document_code: Column, detected: Column) -> Column:
    """struct(document_type, confidence): by machine-readable zone, then by words, then by default."""
    of = lambda kind, c: F.struct(F.lit(kind).alias("document_type"), F.lit(c).alias("confidence"))
    upper = F.upper(F.coalesce(text, F.lit("")))
    first = F.substring(F.coalesce(document_code, F.lit("")), 1, 1)
    mrz = detected & mrz_format.isNotNull()
    result = F.when(mrz & (mrz_format.isin("MRVA", "MRVB") | (first == "V")), of("visa", 0.98)).when(mrz & (mrz_format.isin("TD1", "TD2") | first.isin("I", "A", "C")), of("national_id", 0.98)).when(mrz & ((mrz_format == "TD3") | (first == "P")), of("passport", 0.98))
    for kind, words in KEYWORDS.items():
        # one search for all words, as each would make the text's capitals anew
        seen = upper.rlike("|".join(map(re.escape, words)))
        result = result.when(seen, of(kind, 0.92))
    return result.when(detected, of("passport", 0.85)).otherwise(of("national_id", 0.50))


def entries(raw: Column) -> Column:
    """Number of entries of a visa in one spelling; long unknown words are none."""
    s = F.upper(F.trim(raw))
    return F.when(s == "", F.lit(None)).when(s.isin("MULTIPLE", "MULT", "M", "MULTIPLE/MULTIPLE", "M/M"), "MULTIPLE").when(s.isin("SINGLE", "S", "ONE", "1"), "SINGLE").when(s.isin("DOUBLE", "D", "TWO", "2"), "DOUBLE").when(s.rlike("^[0-9]+$") | (F.length(s) <= 10), s)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def is_passport_date(value: Column) -> Column:
    p = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{2,4})$"
    return F.coalesce(value.rlike(p) & _part(value, p, 1).between(1, 31) & _part(value, p, 2).between(1, 12), F.lit(False))


def is_visa_date(value: Column) -> Column:
    """Day, month and a year from 1900 to 2060, in three layouts; of a named month only day and year count."""
    a, b, c = r"^([0-9]{2})[/.-]([0-9]{2})[/.-]([0-9]{4})$", r"^([0-9]{4})[/.-]([0-9]{2})[/.-]([0-9]{2})$", r"^([0-9]{1,2})\s+([A-Za-z]{3,9})\s+([0-9]{4})$"
    fits = lambda p, d, m, y: _part(value, p, d).between(1, 31) & (_part(value, p, m).between(1, 12) if m else F.lit(True)) & _part(value, p, y).between(1900, 2060)
    return F.coalesce(F.when(value.rlike(a), fits(a, 1, 2, 3)).when(value.rlike(b), fits(b, 3, 2, 1)).when(value.rlike(c), fits(c, 1, 0, 3)), F.lit(False))


def with_visa_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the printed fields of a visa, null where there is none. Each pattern is searched once, then judged."""
    names = [(n, k) for n, patterns in VISA_PATTERNS.items() for k in range(len(patterns)) if n in ("visa_type", "entries") or k == 0]
    single = {n for n in VISA_PATTERNS if n not in ("visa_type", "entries")}
    found = df.select("*", *[first_match(F.col(text), VISA_PATTERNS[n] if n in single else VISA_PATTERNS[n][k : k + 1]).alias(f"__{n}{k}") for n, k in names])
    of = lambda n: F.col(f"__{n}0")
    types = [F.upper(F.col(f"__visa_type{k}")) for k in range(len(VISA_PATTERNS["visa_type"]))]
    made = {
        "visa_type": F.coalesce(*[F.when(~x.isin(*NOT_A_TYPE), x) for x in types]),
        "entries": F.coalesce(*[entries(F.col(f"__entries{k}")) for k in range(len(VISA_PATTERNS["entries"]))]),
        "issue_date": F.when(is_visa_date(of("issue_date")), of("issue_date")), "expiry_date": F.when(is_visa_date(of("expiry_date")), of("expiry_date")),
        "passport_number": F.upper(of("passport_number")), "visa_number": F.upper(of("visa_number")),
        "name": F.when(~F.upper(of("name")).isin(*NOT_A_NAME), of("name")), "issuing_authority": of("issuing_authority"),
    }
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def with_passport_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the printed fields of a passport, null where there is none."""
    found = df.select("*", *[first_match(F.col(text), p).alias(f"__{n}") for n, p in PASSPORT_PATTERNS.items()])
    of = lambda n: F.col(f"__{n}")
    sex = F.upper(of("sex"))
    both = F.concat(of("surname"), F.lit(" "), of("given_names"))
    made = {
        "passport_number": F.upper(of("passport_number")), "date_of_birth": of("date_of_birth"), "date_of_expiry": of("date_of_expiry"), "surname": of("surname"), "given_names": of("given_names"),
        "name": F.coalesce(both, of("full_name")), "sex": F.when(sex.contains("M") & ~sex.contains("F"), "M").when(sex.contains("F"), "F").when(sex.isNotNull(), "X"), "nationality": F.upper(of("nationality")),
    }
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[c.alias(n) for n, c in made.items()])


#: Grouped national number, account number, any other number of an identity card.
GROUPED, BARE_ACCOUNT, GENERIC_NUMBER = r"\b([0-9]{4}\s[0-9]{4}\s[0-9]{4})\b", r"\b([A-Z]{5}[0-9]{4}[A-Z])\b", r"\b([A-Z]{1,3}[0-9]{6,10}|[0-9]{8,14}|(?=[A-Z0-9]*[0-9])[A-Z0-9]{8,14})\b"


def id_number(text: Column, grouped_elsewhere: Column | None = None) -> Column:
    """Grouped twelve digits (or those found elsewhere), a labelled number, five letters-four digits-letter, then any word with enough digits."""
    exact = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    elsewhere = [] if grouped_elsewhere is None else [grouped_elsewhere]
    return F.coalesce(exact(GROUPED), *elsewhere, first_match(text, ID_PATTERNS["labelled"]), exact(BARE_ACCOUNT), exact(GENERIC_NUMBER))


def is_date_candidate(value: Column, context: Column, number: Column) -> Column:
    """A date of birth: not part of the id number; a bare year only behind a year's label; 1900 to 2026."""
    clean = F.trim(value)
    digits, own = F.regexp_replace(clean, "[^0-9]", ""), F.regexp_replace(F.coalesce(number, F.lit("")), "[^0-9]", "")
    inside = (F.length(digits) >= 4) & own.contains(digits)
    year = F.when(clean.rlike("^[0-9]{4}$"), clean).try_cast("int")
    parts = F.split(F.translate(clean, ".-", "//"), "/")
    p = [F.get(parts, F.lit(k)) for k in range(3)]
    n = [F.when(x.rlike("^[0-9]{1,9}$"), x).try_cast("int") for x in p]
    three = (F.size(parts) == 3) & ((n[0].between(1, 31) & n[1].between(1, 12) & n[2].between(1900, 2026)) | (n[0].between(1900, 2026) & n[1].between(1, 12) & n[2].between(1, 31)))
    named = r"^([0-9]{1,2})\s+([A-Za-z]{3,9})\s+([0-9]{4})$"
    month = F.upper(F.substring(F.regexp_extract(clean, named, 2), 1, 3)).isin("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
    spelled = clean.rlike(named) & month & _part(clean, named, 1).between(1, 31) & _part(clean, named, 3).between(1900, 2026)
    labelled = F.upper(F.coalesce(context, F.lit(""))).rlike("YOB|YEAR")
    return F.coalesce(~inside & F.when(year.isNotNull(), year.between(1900, 2026) & labelled).otherwise(F.coalesce(three, F.lit(False)) | F.coalesce(spelled, F.lit(False))), F.lit(False))


def gender(text: Column) -> Column:
    upper = F.upper(text)
    label = F.upper(first_match(text, ID_PATTERNS["gender"]))
    word = F.when(upper.rlike(r"\bFEMALE\b"), "FEMALE").when(upper.rlike(r"\bMALE\b"), "MALE").when(upper.rlike(r"\bTRANSGENDER\b"), "TRANSGENDER")
    return F.coalesce(label, word)


def sex_of(gender_: Column) -> Column:
    return F.when(gender_.contains("M") & ~gender_.contains("FE"), "M").when(gender_.contains("F"), "F").when(gender_.isNotNull(), "X")


def id_nationality(text: Column) -> Column:
    return F.coalesce(F.upper(first_match(text, ID_PATTERNS["nationality"])), F.when(F.upper(text).contains("INDIAN"), "INDIAN"))


def id_address(text: Column) -> Column:
    return F.replace(first_match(text, ID_PATTERNS["address"]), F.lit("\n"), F.lit(", "))


def id_authority(text: Column) -> Column:
    upper = F.upper(text)
    fixed = F.when(upper.contains("GOVERNMENT OF INDIA"), "Government of India").when(upper.contains("UNIQUE IDENTIFICATION AUTHORITY OF INDIA"), "Unique Identification Authority of India").when(upper.contains("ELECTION COMMISSION OF INDIA"), "Election Commission of India")
    return F.coalesce(fixed, first_match(text, ID_PATTERNS["authority"]))


def english_token(text: Column) -> Column:
    """Printable ASCII with single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7E]", " "), r"\s+", " "))


def name_score(text: Column, confidence: Column, least: float = 0.50) -> Column:
    """How likely a line is a person's name; -100 where it can't be."""
    clean = F.trim(text)
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    letters = F.length(F.regexp_replace(clean, "[^A-Za-z]", ""))
    heading = F.exists(words, lambda w: F.regexp_replace(F.upper(w), "[^A-Z]", "").isin(*HEADINGS))
    stems = F.upper(clean).rlike("GOVERNMENT|AUTHORITY|AADHAAR|IDENTITY|CARD|REPUBLIC|ELECTION|COMMISSION|DIRECTORATE")
    never = (F.length(clean) < 3) | (F.length(clean) > 50) | clean.rlike("[0-9]") | (letters / F.greatest(F.lit(1), F.length(clean)) < 0.70) | heading | stems
    n = F.size(words)
    count = F.when(n == 2, 0.50).when(n == 3, 0.45).when(n == 4, 0.35).when(n == 1, F.when(F.length(clean) >= 5, 0.10).otherwise(-0.60)).otherwise(0.0)
    capital = F.forall(words, lambda w: w.rlike("^[A-Z]")) | ((clean == F.upper(clean)) & (letters > 0))
    case = F.when(capital, 0.30).when((clean == F.lower(clean)) & (letters > 0), -0.50).otherwise(0.0)
    pure = F.when(clean.rlike(r"^[A-Za-z\s.'-]+$"), 0.20).otherwise(-0.30)
    return F.when(F.coalesce(never, F.lit(True)), -100.0).otherwise(confidence * 1.5 + count + case + pure + F.when(confidence < least, -0.80).otherwise(0.0))


def mask_personal_data(text: Column) -> Column:
    """Numbers and words of eight to twelve signs, then dates, then machine-readable lines, in this order."""
    ids = F.regexp_replace(text, "(?i)[A-Z0-9]{8,12}", "***ID***")
    dates = F.regexp_replace(ids, r"\b[0-9]{2}[01][0-9][0-3][0-9]\b", "***DOB***")
    return F.regexp_replace(dates, "(?i)[P|V|I]<[A-Z0-9<]{30,44}", "***MRZ_LINE***")
