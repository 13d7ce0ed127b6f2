"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .exact_dedup import OP9_SQL, op9_exact_dedup
from .jaccard_join import OP4_SQL, op4_jaccard_join
from .line_dedup import OP5_SQL, op5_line_dedup
from .mixing import op3_mixing
from .packing import op2_packing
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_classifier import op10_quality_classifier
from .quality_rules import OP6_SQL, op6_quality_rules
from .source_divergence import OP12_SQL, op12_source_divergence
from .suffix_dedup import op1_suffix_dedup
from .token_counts import op7_token_counts
from .vector_search import op13_vector_search
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_source_divergence": op12_source_divergence,
    "op13_vector_search": op13_vector_search,
}

ORACLE_SQL = {
    "op4_jaccard_join": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_quality_rules": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
}
