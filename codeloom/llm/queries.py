"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, html_text, line_dedup, mixing, ngram_join, quality, token_file, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_token_file": token_file.op5_token_file,
    "op6_html_text": html_text.op6_html_text,
    "op7_token_counts": bpe.op7_token_counts,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_quality": quality.op9_quality,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}

ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_quality": quality.ORACLE,
}
