"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sealmark.llm import ann, bpe, chat, collocations, html_text, licenses, near_dup, order_minhash, packing, quality, secrets, turn_repair, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_nearest": ann.op2_nearest,
    "op3_chat_format": chat.op3_chat_format,
    "op4_best_fit": packing.op4_best_fit,
    "op5_main_text": html_text.op5_main_text,
    "op6_near_dup": near_dup.op6_near_dup,
    "op7_order_minhash": order_minhash.op7_order_minhash,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_bpe": bpe.op9_bpe,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_turn_repair": turn_repair.op11_turn_repair,
    "op12_collocations": collocations.op12_collocations,
    "op13_url_filter": url_filter.op13_url_filter,
}
ORACLE_SQL: dict[str, str] = {"op3_chat_format": chat.OP3_SQL, "op12_collocations": collocations.OP12_SQL}
