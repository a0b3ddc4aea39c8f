"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Operator number, module and query name, in the order of the operators.
OPERATORS = (
    ("packing", "op1_pack_binary_pieces"),
    ("simhash", "op2_simhash_anchor_cover"),
    ("bpe", "op3_bpe_matrices"),
    ("quality_knn", "op4_quality_neighbours"),
    ("suffix_dedup", "op5_suffix_dedup"),
    ("substring_dedup", "op6_relative_lz_dedup"),
    ("langid", "op7_language_bitmask"),
    ("quality_rules", "op8_compression_bands"),
    ("embedding_dedup", "op9_pivot_permutations"),
    ("pii", "op10_pii_anchor_expansion"),
)


def queries() -> dict:
    found = {}
    for module, name in OPERATORS:
        found[name] = getattr(importlib.import_module(f"meshlark.llm.{module}"), name.split("_")[0])
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for module, name in OPERATORS:
        sql = getattr(importlib.import_module(f"meshlark.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
