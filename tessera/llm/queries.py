"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import audit, decontam, embedding, hardneg, html, langid, lm, quality, simhash, spm, toxicity, wordbpe

QUERIES = {
    "op1_html_extraction": html.op1_html_extraction,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language_id": langid.op3_language_id,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_embedding_near_dedup": embedding.op5_embedding_near_dedup,
    "op6_sentencepiece": spm.op6_sentencepiece,
    "op7_lm_scores": lm.op7_lm_scores,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_quality": quality.op9_quality,
    "op10_token_counts": spm.op10_token_counts,
    "op11_hard_negatives": hardneg.op11_hard_negatives,
    "op12_bpe": wordbpe.op12_bpe,
    "op13_source_divergence": audit.op13_source_divergence,
}

ORACLES: dict[str, str] = {"op11_hard_negatives": hardneg.SQL, "op13_source_divergence": audit.SQL}
