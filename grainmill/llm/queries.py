"""Queries of the llm operators, and the SQL that expresses those which SQL can."""

from __future__ import annotations

from grainmill.llm.embeddings import op5_embedding_dups
from grainmill.llm.html import op6_main_text
from grainmill.llm.lines import op9_line_dedup
from grainmill.llm.lm import op3_lm_scores
from grainmill.llm.merkle import op10_fingerprints
from grainmill.llm.mixing import op7_mixing
from grainmill.llm.pieces import op8_pieces
from grainmill.llm.resampling import op12_resampling
from grainmill.llm.retrieval import op11_search
from grainmill.llm.simhash import op1_simhash
from grainmill.llm.snapshots import op13_exact_dedup
from grainmill.llm.sql import ORACLE
from grainmill.llm.token_files import op2_token_files
from grainmill.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_files": op2_token_files,
    "op3_lm_scores": op3_lm_scores,
    "op4_toxicity": op4_toxicity,
    "op5_embedding_dups": op5_embedding_dups,
    "op6_main_text": op6_main_text,
    "op7_mixing": op7_mixing,
    "op8_pieces": op8_pieces,
    "op9_line_dedup": op9_line_dedup,
    "op10_fingerprints": op10_fingerprints,
    "op11_search": op11_search,
    "op12_resampling": op12_resampling,
    "op13_exact_dedup": op13_exact_dedup,
}
__all__ = ["ORACLE", "QUERIES"]
