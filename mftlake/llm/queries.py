"""The registered queries of this subpackage and their SQL."""

from . import chat_format, ctw, decontaminate, exact_dedup, line_dedup, pii, secrets, sentencepiece_codec, simhash, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_pii": pii.op5_pii,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
    "op10_lm_score": ctw.op10_lm_score,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_benchmark_decontamination": decontaminate.OP3_SQL,
    "op4_chat_format": chat_format.OP4_SQL,
}
