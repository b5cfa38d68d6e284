"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import decontamination, gif_media, hmm, html_extract, language_id, license_scan, line_dedup, ngram_join, packing, phrases, quality, rans_tokens, vector_codes

QUERIES = {"op1_html_extract": html_extract.query, "op2_hmm": hmm.query, "op3_quality": quality.query, "op6_rans_tokens": rans_tokens.query, "op7_gif": gif_media.query, "op4_decontamination": decontamination.query, "op5_license_scan": license_scan.query, "op8_ngram_join": ngram_join.query, "op9_line_dedup": line_dedup.query, "op10_packing": packing.query, "op11_phrases": phrases.query, "op12_language_id": language_id.query, "op13_vector_codes": vector_codes.query}
ORACLE = {"op4_decontamination": decontamination.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op11_phrases": phrases.ORACLE, "op12_language_id": language_id.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
