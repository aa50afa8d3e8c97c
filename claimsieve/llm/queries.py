"""The queries of this subpackage, and SQL of those that it can express on whole tables; brute force holds the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimsieve.llm.ann import op5_vantage_point_ann
from claimsieve.llm.bpe import op9_byte_bpe
from claimsieve.llm.chat_format import op11_chat_format
from claimsieve.llm.embedding_dedup import op7_embedding_dedup
from claimsieve.llm.filter_audit import OP13_SQL, op13_filter_audit
from claimsieve.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from claimsieve.llm.html_text import op8_html_text
from claimsieve.llm.packing import op4_best_fit_packing
from claimsieve.llm.secrets import op6_secrets
from claimsieve.llm.simhash import op2_simhash
from claimsieve.llm.suffix_dedup import op3_suffix_dedup
from claimsieve.llm.token_output import op1_token_output
from claimsieve.llm.toxicity import op10_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_output, op2_simhash, op3_suffix_dedup, op4_best_fit_packing, op5_vantage_point_ann, op6_secrets, op7_embedding_dedup, op8_html_text, op9_byte_bpe, op10_toxicity)
    found += (op11_chat_format, op12_hard_negatives, op13_filter_audit)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {op12_hard_negatives.__name__: OP12_SQL, op13_filter_audit.__name__: OP13_SQL}
