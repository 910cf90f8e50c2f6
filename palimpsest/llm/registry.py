"""The queries of this subpackage and their SQL."""

from __future__ import annotations


def queries() -> dict:
    from palimpsest.llm import collocations, jaccard, lines, media, packing, pieces, quality, secrets, simhash, suffixes, topk, trie, urls

    return {
        "op1_best_fit_pack": packing.op1_best_fit_pack,
        "op2_exact_topk": topk.op2_exact_topk,
        "op3_quality_classifier": quality.op3_quality_classifier,
        "op4_url_filter": urls.op4_url_filter,
        "op5_simhash_dedup": simhash.op5_simhash_dedup,
        "op6_suffix_dedup": suffixes.op6_suffix_dedup,
        "op7_sentencepiece_nbest": pieces.op7_sentencepiece_nbest,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_audio_features": media.op9_audio_features,
        "op10_line_dedup": lines.op10_line_dedup,
        "op11_phrase_collocations": collocations.op11_phrase_collocations,
        "op12_conversation_trie": trie.op12_conversation_trie,
        "op13_ngram_jaccard": jaccard.op13_ngram_jaccard,
    }


def oracle_sql() -> dict:
    from palimpsest.llm import collocations, jaccard, lines, quality, topk, trie, urls

    return {
        "op2_exact_topk": topk.OP2_SQL,
        "op3_quality_classifier": quality.OP3_SQL,
        "op4_url_filter": urls.OP4_SQL,
        "op10_line_dedup": lines.OP10_SQL,
        "op11_phrase_collocations": collocations.OP11_SQL,
        "op12_conversation_trie": trie.OP12_SQL,
        "op13_ngram_jaccard": jaccard.OP13_SQL,
    }
