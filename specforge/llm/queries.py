"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, exact_dedup, fingerprint, jaccard_join, language_model, licences, mixing, near_dedup, paragraphs, prefix_trie, suffix_dedup, toxicity, variants


def queries():
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_fingerprint": fingerprint.op3_fingerprint,
        "op4_mixing": mixing.op4_mixing,
        "op5_language_model": language_model.op5_language_model,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_bpe": bpe.op7_bpe,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_licences": licences.op9_licences,
        "op10_paragraphs": paragraphs.op10_paragraphs,
        "op11_jaccard_join": jaccard_join.op11_jaccard_join,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_variants": variants.op13_variants,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    stated = {
        "op4_mixing": mixing.OP4_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op11_jaccard_join": jaccard_join.OP11_SQL,
        "op12_prefix_trie": prefix_trie.OP12_SQL,
        "op13_variants": variants.OP13_SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in stated.items() if sql}
