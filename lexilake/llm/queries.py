"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexilake.llm import alignment, ann, chat, decontaminate, divergence, lengths, minhash, mixing, ngram, pages, tokens, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": ann.op1_ann,
        "op2_chat": chat.op2_chat,
        "op3_token_output": tokens.op3_token_output,
        "op4_mix": mixing.op4_mix,
        "op5_lengths": lengths.op5_lengths,
        "op6_minhash": minhash.op6_minhash,
        "op7_lm_scores": ngram.op7_lm_scores,
        "op8_page_text": pages.op8_page_text,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_warc": warc.op11_warc,
        "op12_alignment": alignment.op12_alignment,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ann": ann.ANN_SQL, "op11_warc": warc.WARC_SQL, "op13_divergence": divergence.DIVERGENCE_SQL}
