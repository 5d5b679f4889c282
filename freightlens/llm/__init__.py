"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Python tasks carry the few functions they need, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def catalogue():
    """The queries of this subpackage and the SQL of those that SQL can express."""
    from . import bpe, chat, decontam, jaccard, lines, packing, prefix_trie, sharding, substring, token_counts, topk, toxicity, whitening

    queries = {
        "op1_topk": topk.op1_topk,
        "op2_sharding": sharding.op2_sharding,
        "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_substring_dedup": substring.op7_substring_dedup,
        "op8_chat_formatting": chat.op8_chat_formatting,
        "op9_decontamination": decontam.op9_decontamination,
        "op10_line_dedup": lines.op10_line_dedup,
        "op10_line_dedup_whole": lines.op10_line_dedup_whole,
        "op11_bpe": bpe.op11_bpe,
        "op12_whitening": whitening.op12_whitening,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }
    sql = {
        "op1_topk": topk.OP1_SQL,
        "op3_ngram_jaccard": jaccard.OP3_SQL,
        "op5_token_counts": token_counts.OP5_SQL,
        "op7_substring_dedup": substring.OP7_SQL,
        "op8_chat_formatting": chat.OP8_SQL,
        "op9_decontamination": decontam.OP9_SQL,
        "op10_line_dedup": lines.OP10_SQL,
        "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
    return queries, sql
