"""Registry of the queries of this subpackage and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, hard_negatives, lexical_search
from .bpe import op6_byte_bpe
from .embedding_dedup import op12_embedding_dedup
from .hard_negatives import op11_hard_negatives
from .html_pages import op5_html_text
from .lexical_search import op13_lexical_search
from .licenses import op1_license_scan
from .mixing import op10_mixing
from .quality_model import op4_quality_ranking
from .quality_rules import op2_quality_rules
from .simhash import op7_simhash
from .substrings import op3_substring_dedup
from .token_files import op9_token_orc
from .vector_search import op8_vector_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_ranking": op4_quality_ranking,
    "op5_html_text": op5_html_text,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_simhash": op7_simhash,
    "op8_vector_search": op8_vector_search,
    "op9_token_orc": op9_token_orc,
    "op10_mixing": op10_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_lexical_search": op13_lexical_search,
}
ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_embedding_dedup": embedding_dedup.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
