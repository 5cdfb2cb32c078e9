"""The subpackage's queries by name, and their SQL where DuckDB can express them."""

from . import bpe, decontam, dedup, html, language, lm, search, tokencounts, toxicity, urls

QUERIES = {
    "op1_byte_level_bpe": bpe.op1,
    "op2_url_filter": urls.op2,
    "op3_minhash_near_dedup": dedup.op3,
    "op4_benchmark_decontamination": decontam.op4,
    "op5_html_extraction": html.op5,
    "op6_language_id": language.op6,
    "op7_exact_top_k": search.op7,
    "op8_lm_scoring": lm.op8,
    "op9_token_counts": tokencounts.op9,
    "op10_toxicity": toxicity.op10,
    # what SQL can express of an operator
    "url_parts": urls.url_parts,
}
ORACLE_SQL = {"op7_exact_top_k": search.OP7_SQL, "url_parts": urls.PARTS_SQL}
