"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat, decontaminate, fingerprints, hard_negatives, language, line_templates, minhash, packing, quality, secrets, similarity_join, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": language.op1_language,
    "op2_pack": packing.op2_pack,
    "op3_line_dedup": line_templates.op3_line_dedup,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_chat_format": chat.op6_chat_format,
    "op7_fingerprint": fingerprints.op7_fingerprint,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_jaccard": similarity_join.op9_jaccard,
    "op10_quality": quality.op10_quality,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_minhash": minhash.op12_minhash,
    "op13_align": alignment.op13_align,
}

ORACLE: dict[str, str] = {"op3_line_dedup": line_templates.OP3_SQL, "op6_chat_format": chat.OP6_SQL, "op9_jaccard": similarity_join.OP9_SQL, "op11_hard_negatives": hard_negatives.OP11_SQL, "op12_minhash": minhash.OP12_SQL}
