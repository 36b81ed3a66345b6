"""Queries and SQL oracles of the corpus operators."""

from __future__ import annotations

from tidewater.llm.decontaminate import OP4_SQL, op4_decontamination
from tidewater.llm.exact_topk import OP12_SQL, op12_exact_topk
from tidewater.llm.fixity import OP8_SQL, op8_merkle_audit
from tidewater.llm.lexical import OP11_SQL, op11_lexical_search
from tidewater.llm.mixing import OP10_SQL, op10_systematic_mix
from tidewater.llm.neardup import op5_near_duplicates
from tidewater.llm.pii import op2_pii_surrogates
from tidewater.llm.quality import op9_quality_rules
from tidewater.llm.secrets import op7_secret_scan
from tidewater.llm.spelling import OP13_SQL, op13_spelling_variants
from tidewater.llm.suffix_dedup import op3_suffix_dedup
from tidewater.llm.tokens import op1_token_counts
from tidewater.llm.wrappers import op6_main_text


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_pii_surrogates": op2_pii_surrogates,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_main_text": op6_main_text,
        "op7_secret_scan": op7_secret_scan,
        "op8_merkle_audit": op8_merkle_audit,
        "op9_quality_rules": op9_quality_rules,
        "op10_systematic_mix": op10_systematic_mix,
        "op11_lexical_search": op11_lexical_search,
        "op12_exact_topk": op12_exact_topk,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict:
    return {"op4_decontamination": OP4_SQL, "op8_merkle_audit": OP8_SQL, "op10_systematic_mix": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_exact_topk": OP12_SQL, "op13_spelling_variants": OP13_SQL}
