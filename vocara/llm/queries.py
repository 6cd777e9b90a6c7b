"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocara.llm import ball_tree, cap_filters, decontam, divergence, hard_negatives, mixing
from vocara.llm.ball_tree import ball_tree_top_k
from vocara.llm.cap_filters import cap_filter_join
from vocara.llm.common import read_table
from vocara.llm.decontam import contamination_digest
from vocara.llm.html_text import extract_text
from vocara.llm.ngram_jaccard import ngram_jaccard_join
from vocara.llm.packing import pack
from vocara.llm.pii import find_spans
from vocara.llm.suffix_dedup import remove_repeats
from vocara.llm.token_counts import count_tokens
from vocara.llm.toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": lambda s, d: ngram_jaccard_join(read_table(s, d, "documents")),
    "op2_embedding_near_dedup": lambda s, d: cap_filter_join(read_table(s, d, "embeddings")),
    "op3_mix_sources": lambda s, d: mixing.mix_sources(read_table(s, d, "documents")),
    "op4_toxicity": lambda s, d: score_toxicity(read_table(s, d, "documents"), read_table(s, d, "labels")),
    "op5_suffix_dedup": lambda s, d: remove_repeats(read_table(s, d, "documents")).drop("kept"),
    "op6_pii": lambda s, d: find_spans(read_table(s, d, "documents")),
    "op7_top_k": lambda s, d: ball_tree_top_k(read_table(s, d, "embeddings"), F.col("vec_id") % 50 == 0),
    "op8_packing": lambda s, d: pack(read_table(s, d, "documents")),
    "op9_token_counts": lambda s, d: count_tokens(read_table(s, d, "documents")),
    "op10_html_text": lambda s, d: extract_text(read_table(s, d, "pages")),
    "op11_source_divergence": lambda s, d: divergence.divergence(read_table(s, d, "documents")),
    "op12_decontamination": lambda s, d: contamination_digest(read_table(s, d, "documents"), read_table(s, d, "benchmark")),
    "op13_hard_negatives": lambda s, d: hard_negatives.mine_hard_negatives(read_table(s, d, "embeddings")),
}

ORACLE: dict[str, str] = {
    "op2_embedding_near_dedup": cap_filters.oracle(),
    "op3_mix_sources": mixing.oracle(),
    "op7_top_k": ball_tree.oracle(),
    "op11_source_divergence": divergence.oracle(),
    "op12_decontamination": decontam.oracle(),
    "op13_hard_negatives": hard_negatives.oracle(),
}
