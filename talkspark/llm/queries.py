"""Queries and SQL of the training-data operators, for __spark_entry__.py."""

from talkspark.llm import bpe, chat_hmm, cover_tree, gru_langid, html_template, kn_quality, license_scan, minhash_dedup, mixing, quality_rules, rp_forest, spelling_variants, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_html_template": html_template.op2_html_template,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_chat_format": chat_hmm.op4_chat_format,
    "op5_kn_quality": kn_quality.op5_kn_quality,
    "op6_nearest_neighbours": rp_forest.op6_nearest_neighbours,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_bpe": bpe.op8_bpe,
    "op9_language_id": gru_langid.op9_language_id,
    "op10_url_filters": url_filter.op10_url_filters,
    "op11_license_scan": license_scan.op11_license_scan,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_hard_negatives": cover_tree.op13_hard_negatives,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
    "op10_url_filters": url_filter.ORACLE,
    "op11_license_scan": license_scan.ORACLE,
    "op12_spelling_variants": spelling_variants.ORACLE,
    "op13_hard_negatives": cover_tree.ORACLE,
}
