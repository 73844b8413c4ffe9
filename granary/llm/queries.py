"""Queries of the corpus operators, by the names under which they are registered, and SQL for those that SQL can express."""

from __future__ import annotations

from .fingerprints import op8_fingerprints
from .line_quality import op9_line_quality
from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import OP5_SQL, op5_mixing
from .ngram_join import OP1_SQL, op1_ngram_jaccard_join
from .pieces import op2_sentencepiece
from .quality_rules import OP10_SQL, op10_quality_rules
from .token_files import op7_token_files
from .toxicity import op3_toxicity
from .sharding import op4_sharding

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_files": op7_token_files,
    "op8_fingerprints": op8_fingerprints,
    "op9_line_quality": op9_line_quality,
    "op10_quality_rules": op10_quality_rules,
}

SQL = {"op1_ngram_jaccard_join": OP1_SQL, "op5_mixing": OP5_SQL, "op6_line_dedup": OP6_SQL, "op10_quality_rules": OP10_SQL}
