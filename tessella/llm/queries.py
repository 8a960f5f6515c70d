"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_trie_bpe
from .decontaminate import op10_string_tiling
from .lm_scoring import op8_cross_entropy
from .neardup import op6_minhash_neardup
from .oracles import OP2_SQL, OP6_SQL, OP9_SQL
from .secrets import op7_char_cnn_secrets
from .sharding import OP5_SQL, op5_jump_sharding
from .suffixes import op2_suffix_dedup
from .toxicity import op1_nnpu_toxicity
from .vectors import op9_cover_tree
from .warc import OP3_SQL, op3_warc_archive


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nnpu_toxicity": op1_nnpu_toxicity,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_warc_archive": op3_warc_archive,
        "op4_trie_bpe": op4_trie_bpe,
        "op5_jump_sharding": op5_jump_sharding,
        "op6_minhash_neardup": op6_minhash_neardup,
        "op7_char_cnn_secrets": op7_char_cnn_secrets,
        "op8_cross_entropy": op8_cross_entropy,
        "op9_cover_tree": op9_cover_tree,
        "op10_string_tiling": op10_string_tiling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": OP2_SQL,
        "op3_warc_archive": OP3_SQL,
        "op5_jump_sharding": OP5_SQL,
        "op6_minhash_neardup": OP6_SQL,
        "op9_cover_tree": OP9_SQL,
    }
