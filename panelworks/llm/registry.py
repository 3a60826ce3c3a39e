"""The registered text queries, and DuckDB SQL where it can express them."""

from panelworks.llm import alignment, digests, jaccard, language, licenses, media, mixing, packing, passages, simhash, spelling, token_counts, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_fingerprints": digests.op2_fingerprints,
    "op3_substring_dedup": passages.op3_substring_dedup,
    "op4_language_id": language.op4_language_id,
    "op5_media_columns": media.op5_media_columns,
    "op6_mixing": mixing.op6_mixing,
    "op7_warc": warc.op7_warc,
    "op8_license_scans": licenses.op8_license_scans,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_simhash": simhash.op10_simhash,
    "op11_jaccard": jaccard.op11_jaccard,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES = {"op6_mixing": mixing.ORACLE, "op7_warc": warc.ORACLE, "op11_jaccard": jaccard.ORACLE}
