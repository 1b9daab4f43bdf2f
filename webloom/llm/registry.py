"""Queries of the training-data operators by name, and the same in DuckDB SQL."""

from webloom.llm import chat, collocations, exact_dedup, html_text, line_dedup, media, merkle, mixing, ngram_join, packing, quality, secrets, substring_dedup

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_media_columns": media.op6_media_columns,
    "op7_html_extraction": html_text.op7_html_extraction,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_packing": packing.op10_packing,
    "op11_phrase_collocations": collocations.op11_phrase_collocations,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_chat_formatting": chat.OP3_SQL,
    "op4_source_mixing": mixing.OP4_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op9_ngram_join": ngram_join.OP9_SQL,
    "op11_phrase_collocations": collocations.OP11_SQL,
    "op12_exact_dedup": exact_dedup.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
