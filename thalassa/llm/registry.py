"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from . import collocations, jaccard, leaks, licenses, mixing, pii, quotes, rnn, secrets, tokenfiles, topk, toxicity, whitening


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_quotation_linking": quotes.query,
        "op2_secret_scan": secrets.query,
        "op3_pii_sanitisation": pii.query,
        "op4_recurrent_lm": rnn.query,
        "op5_exact_topk": topk.query,
        "op6_toxicity": toxicity.query,
        "op7_decontamination": leaks.query,
        "op8_mixing": mixing.query,
        "op9_jaccard_join": jaccard.query,
        "op10_license_scan": licenses.query,
        "op11_phrase_collocations": collocations.query,
        "op12_embedding_whitening": whitening.query,
        "op13_token_files": tokenfiles.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op11_phrase_collocations": collocations.SQL, "op5_exact_topk": topk.SQL, "op8_mixing": mixing.SQL, "op9_jaccard_join": jaccard.SQL}
