"""Document types as data: a table of rules from which one plan reads the fields of any number of types.

A rule is a row: document_type, field, priority (the smallest that finds something wins), label and value
(patterns; the value's first group is taken, behind the label where there is one), allowed (a pattern that the whole value must
match) and spelling ("upper", "title", "digits" or null, as printed). Rules of the field ``MARKER`` tell the type itself: a text that
holds the value's pattern, and whose type was neither asked for nor given by a zone, is of that type.

Documents meet the rules of their type by a join on the type; patterns are columns. Null labels, allowed patterns and
spellings ask for nothing; a pattern that finds an empty text finds nothing; of two rules of one priority the smaller value wins. A type
without rules has no rows. The table is small, as people write it: more than ``MOST_RULES`` rows
or ``MOST_MARKERS`` markers are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = "document_type"
MOST_RULES, MOST_MARKERS = 10_000, 200
SCHEMA = "document_type string, field string, priority int, label string, value string, allowed string, spelling string"
#: What may stand between a label and its value.
_BETWEEN = r"[ \t]*[:#.=-]*\s*"


def checked(rules: DataFrame) -> DataFrame:
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return rules.where(F.col("document_type").isNotNull() & F.col("field").isNotNull() & F.col("value").isNotNull())


def _spelled(value: Column) -> Column:
    how = F.col("spelling")
    return F.when(how == "upper", F.upper(value)).when(how == "title", F.initcap(value)).when(how == "digits", F.regexp_replace(value, "[^0-9]", "")).otherwise(value)


def known_types(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("field") != MARKER).select("document_type").distinct()


def marked(types: DataFrame, rules: DataFrame) -> DataFrame:
    """types with document_type set by the first marker that the text holds, where no type was asked for (type_confidence is not null) and no zone was found."""
    rows = rules.where(F.col("field") == MARKER).orderBy("priority", "document_type", "value").limit(MOST_MARKERS + 1).collect()
    if len(rows) > MOST_MARKERS:
        raise ValueError(f"more than {MOST_MARKERS} markers")
    if not rows:
        return types
    found = F.coalesce(*[F.when(F.col("text").rlike(r["value"]), r["document_type"]) for r in rows])
    free = F.col("type_confidence").isNotNull() & ~F.col("detected")
    return types.withColumn("document_type", F.coalesce(F.when(free, found), "document_type"))


def read_fields(types: DataFrame, rules: DataFrame) -> DataFrame:
    """types (doc_id, text, document_type) -> doc_id, field, value of the documents whose type has rules."""
    asked = rules.where(F.col("field") != MARKER).withColumn("pattern", F.concat(F.lit("(?i)"), F.coalesce(F.concat(F.lit("(?:"), "label", F.lit(f"){_BETWEEN}")), F.lit("")), "value"))
    met = types.select("doc_id", "text", "document_type").join(F.broadcast(asked), "document_type")
    found = met.withColumn("v", F.trim(_spelled(F.expr("regexp_extract(text, pattern, 1)"))))
    good = found.where((F.col("v") != "") & F.coalesce(F.expr("v rlike concat('^(?:', allowed, ')$')"), F.lit(True)))
    return good.groupBy("doc_id", "field").agg(F.min(F.struct("priority", "v")).alias("f")).select("doc_id", "field", F.col("f.v").alias("value"))
