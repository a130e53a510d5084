"""Queries of this subpackage and their DuckDB SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from palimpsest.llm.bitslice import OP8_SQL, op8_bit_sliced_top_k
from palimpsest.llm.chat import OP6_SQL, op6_snapshot_collapse
from palimpsest.llm.langid import op5_compression_language
from palimpsest.llm.minhash import op9_icws_near_duplicates
from palimpsest.llm.packing import op4_nnls_packing
from palimpsest.llm.quality import op10_additive_quality
from palimpsest.llm.repair import op1_repair_token_files
from palimpsest.llm.secrets import op2_randomness_secrets
from palimpsest.llm.tree import op3_kmeans_tree_neighbours
from palimpsest.llm.wfst import op7_wfst_sentencepiece

QUERIES = {
    f.__name__: f
    for f in (
        op1_repair_token_files, op2_randomness_secrets, op3_kmeans_tree_neighbours, op4_nnls_packing, op5_compression_language, op6_snapshot_collapse,
        op7_wfst_sentencepiece, op8_bit_sliced_top_k, op9_icws_near_duplicates, op10_additive_quality,
    )
}
ORACLE_SQL = {"op6_snapshot_collapse": OP6_SQL, "op8_bit_sliced_top_k": OP8_SQL}
