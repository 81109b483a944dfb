"""The queries of this subpackage and their SQL, for the table of all queries."""

from __future__ import annotations

from quarry.llm import chat, collocations, divergence, exact_dedup, langid, packing, quality, rules, sentencepiece_codec, simhash, suffix_dedup, url_filters, warc

QUERIES = {
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_quality_rules": rules.op3_quality_rules,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
    "op6_simhash": simhash.op6_simhash,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_language_id": langid.op9_language_id,
    "op10_packing": packing.op10_packing,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_warc": warc.op12_warc,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op3_quality_rules": rules.SQL,
    "op8_chat_formatting": chat.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_warc": warc.SQL,
    "op13_collocations": collocations.SQL,
}
