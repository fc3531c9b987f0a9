"""Queries of this subpackage and their DuckDB SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat_trees, fim_frames, secret_trigrams, substring_fm, topk_tiles
from tessera.llm.chat_trees import op7_chat_trees
from tessera.llm.decontaminate import op9_template_decontamination
from tessera.llm.fim_frames import op11_fim_frames
from tessera.llm.html_templates import op4_html_templates
from tessera.llm.packing_pow2 import op5_packing_pow2
from tessera.llm.pii_offsets import op3_pii_offsets
from tessera.llm.quality_zstd import op1_quality_zstd
from tessera.llm.secret_trigrams import op10_secret_trigrams
from tessera.llm.simhash_golay import op8_simhash_golay
from tessera.llm.substring_fm import op13_substring_fm
from tessera.llm.token_alignment import op12_token_alignment
from tessera.llm.topk_tiles import op6_topk_tiles
from tessera.llm.toxicity_fst import op2_toxicity_fst

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_zstd": op1_quality_zstd,
    "op2_toxicity_fst": op2_toxicity_fst,
    "op3_pii_offsets": op3_pii_offsets,
    "op4_html_templates": op4_html_templates,
    "op5_packing_pow2": op5_packing_pow2,
    "op6_topk_tiles": op6_topk_tiles,
    "op7_chat_trees": op7_chat_trees,
    "op8_simhash_golay": op8_simhash_golay,
    "op9_template_decontamination": op9_template_decontamination,
    "op10_secret_trigrams": op10_secret_trigrams,
    "op11_fim_frames": op11_fim_frames,
    "op12_token_alignment": op12_token_alignment,
    "op13_substring_fm": op13_substring_fm,
}

#: Only where SQL can express the operator; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op6_topk_tiles": topk_tiles.ORACLE,
    "op7_chat_trees": chat_trees.ORACLE,
    "op10_secret_trigrams": secret_trigrams.oracle(),
    "op11_fim_frames": fim_frames.ORACLE,
    "op13_substring_fm": substring_fm.ORACLE,
}
