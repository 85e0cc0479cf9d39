"""Queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .bitpack import op5_bit_packed_tokens
from .decontam import op1_decontamination
from .langid import op2_language_id
from .licenses import op10_license_scan
from .lm import op8_lm_scores
from .merkle import OP12_SQL, op12_merkle_manifest
from .negatives import OP13_SQL, op13_hard_negatives
from .packing import op4_mixture_packing
from .pieces import op11_sentence_pieces
from .quality import OP9_SQL, op9_quality_rules
from .simhash import op3_simhash_near_dedup
from .suffix_dedup import op6_suffix_dedup
from .urls import op7_url_templates

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_mixture_packing": op4_mixture_packing,
    "op5_bit_packed_tokens": op5_bit_packed_tokens,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_templates": op7_url_templates,
    "op8_lm_scores": op8_lm_scores,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
    "op11_sentence_pieces": op11_sentence_pieces,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE: dict[str, str] = {"op9_quality_rules": OP9_SQL, "op12_merkle_manifest": OP12_SQL, "op13_hard_negatives": OP13_SQL}
