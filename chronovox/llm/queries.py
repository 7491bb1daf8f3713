"""One registered query for each training-data operator."""

from __future__ import annotations

from chronovox.llm import binary_output, bitsliced, html_text, images, importance, jaccard, langid, licenses, merkle, mixing, secrets, sentencepiece_bpe, toxicity

QUERIES: dict = {
    "op1_topk": bitsliced.op1_topk,
    "op2_secrets": secrets.op2_secrets,
    "op3_langid": langid.op3_langid,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_binary_output": binary_output.op5_binary_output,
    "op6_image_copies": images.op6_image_copies,
    "op7_sentencepiece": sentencepiece_bpe.op7_sentencepiece,
    "op8_mix": mixing.op8_mix,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_html_text": html_text.op10_html_text,
    "op11_importance": importance.op11_importance,
    "op12_licenses": licenses.op12_licenses,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES: dict = {
    "op1_topk": bitsliced.OP1_SQL,
    "op8_mix": mixing.OP8_SQL,
    "op11_importance": importance.OP11_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
