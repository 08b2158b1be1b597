"""The registered queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from . import (codes, decontamination, katz, language, neighbours, ngram_jaccard, packing, private_data, quality, token_store, urls, warc,
               whitening)

QUERIES = {
    "op1_url_templates": urls.op1_url_templates,
    "op2_katz_backoff": katz.op2_katz_backoff,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_token_store": token_store.op4_token_store,
    "op5_language_spans": language.op5_language_spans,
    "op6_ngram_jaccard": ngram_jaccard.op6_ngram_jaccard,
    "op7_quality": quality.op7_quality,
    "op8_learned_partitions": neighbours.op8_learned_partitions,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_pii_field": private_data.op10_pii_field,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_warc_revisits": warc.op12_warc_revisits,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
SQL: dict[str, str] = {
    "op6_ngram_jaccard": ngram_jaccard.OP6_SQL,
    "op11_vector_codes": codes.OP11_SQL,
    "op12_warc_revisits": warc.OP12_SQL,
}
