"""The queries of the training-data operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from . import oracles
from .language_id import op2_hyperdimensional
from .merkle import op13_merkle_manifest
from .mixing import op4_budget_mixing
from .near_dedup import op7_dart_minhash
from .packing import op6_best_fit_packing
from .quality_classifier import op8_attention_mil
from .quality_rules import op3_line_frequency
from .resampling import op12_importance_resampling
from .secrets import op10_randomness_battery
from .sequence_cuts import op11_order_preserving_packing
from .sharding import op1_jump_sharding
from .token_counts import op9_edit_aware_counts
from .topk import op5_exact_topk

QUERIES = {
    "op1_jump_sharding": op1_jump_sharding,
    "op2_hyperdimensional": op2_hyperdimensional,
    "op3_line_frequency": op3_line_frequency,
    "op4_budget_mixing": op4_budget_mixing,
    "op5_exact_topk": op5_exact_topk,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_dart_minhash": op7_dart_minhash,
    "op8_attention_mil": op8_attention_mil,
    "op9_edit_aware_counts": op9_edit_aware_counts,
    "op10_randomness_battery": op10_randomness_battery,
    "op11_order_preserving_packing": op11_order_preserving_packing,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {
    "op1_jump_sharding": oracles.OP1,
    "op3_line_frequency": oracles.OP3,
    "op4_budget_mixing": oracles.OP4,
    "op5_exact_topk": oracles.OP5,
    "op12_importance_resampling": oracles.OP12,
    "op13_merkle_manifest": oracles.OP13,
}
