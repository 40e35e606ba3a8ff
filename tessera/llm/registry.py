"""Queries of the training-data operators and their SQL, where SQL can express them."""

from . import divergence, exact_dedup, jaccard, lm_score, mixing, packing, phrases, pieces, pii, quality, substrings, urls, vectors

QUERIES = {
    "op1_repeated_substrings": substrings.op1,
    "op2_lm_score": lm_score.op2,
    "op3_pii": pii.op3,
    "op4_best_fit_packing": packing.op4,
    "op5_quality": quality.op5,
    "op6_mixing": mixing.op6,
    "op7_ngram_jaccard": jaccard.op7,
    "op8_near_vectors": vectors.op8,
    "op9_url_filter": urls.op9,
    "op10_exact_dedup": exact_dedup.op10,
    "op11_collocations": phrases.op11,
    "op12_sentencepiece": pieces.op12,
    "op13_source_divergence": divergence.op13,
}

SQL = {
    "op1_repeated_substrings": substrings.SQL,
    "op7_ngram_jaccard": jaccard.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_collocations": phrases.SQL,
    "op13_source_divergence": divergence.SQL,
}
