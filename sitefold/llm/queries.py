"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from .centroids import OP11_SQL, op11_centroid_clustering
from .chat import OP4_SQL, op4_chat_formatting
from .embedding_join import OP5_SQL, op5_embedding_near_dedup
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .line_dedup import op2_line_dedup
from .mixing import op6_source_mixing
from .ngram_join import OP8_SQL, op8_ngram_jaccard_join
from .packing import op9_best_fit_packing
from .quality import op7_quality_rules
from .suffix_dedup import op1_suffix_array_dedup
from .toxicity import op3_toxicity
from .url_filter import OP10_SQL, op10_url_filter
from .warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_url_filter": op10_url_filter,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_warc": op13_warc,
}

ORACLE_SQL = {
    "op4_chat_formatting": OP4_SQL,
    "op5_embedding_near_dedup": OP5_SQL,
    "op8_ngram_jaccard_join": OP8_SQL,
    "op10_url_filter": OP10_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_warc": OP13_SQL,
}
