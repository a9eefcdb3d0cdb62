"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from tempora.llm import oracle
from tempora.llm.chat import CHATS, op11_event_sourced_chat
from tempora.llm.columnwise import op4_columnwise_bwt_substring_dedup
from tempora.llm.decontamination import op1_simhash_decontamination
from tempora.llm.embeddings import op9_rotated_code_near_vectors
from tempora.llm.langid import op10_cross_parsing_language
from tempora.llm.lines import op2_deletion_neighbourhood_lines
from tempora.llm.minhash import op8_lsh_forest_near_dups
from tempora.llm.mixing import op3_entropy_balanced_mix
from tempora.llm.periodic import op12_sparse_diagonal_runs
from tempora.llm.recompression import op5_recompression_substring_dedup
from tempora.llm.sharding import op7_consistent_hash_shards
from tempora.llm.toxicity import op6_compression_distance_toxicity
from tempora.llm.whitening import op13_refined_whitening

QUERIES = {f.__name__: f for f in (
    op1_simhash_decontamination, op2_deletion_neighbourhood_lines, op3_entropy_balanced_mix, op4_columnwise_bwt_substring_dedup,
    op5_recompression_substring_dedup, op6_compression_distance_toxicity, op7_consistent_hash_shards, op8_lsh_forest_near_dups, op9_rotated_code_near_vectors,
    op10_cross_parsing_language, op11_event_sourced_chat, op12_sparse_diagonal_runs, op13_refined_whitening)}
ORACLE_SQL: dict[str, str] = {
    "op1_simhash_decontamination": oracle.LEAKS, "op2_deletion_neighbourhood_lines": oracle.LINES, "op4_columnwise_bwt_substring_dedup": oracle.BYTES,
    "op5_recompression_substring_dedup": oracle.WORDS, "op8_lsh_forest_near_dups": oracle.NEAR_TEXTS, "op9_rotated_code_near_vectors": oracle.NEAR_VECTORS,
    "op11_event_sourced_chat": CHATS}
