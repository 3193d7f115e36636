"""Queries over the operators of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import bpe_automaton, chat_format, exact_dedup, media_png, near_dedup, packing, pii, quality, token_counts, url_filter
from .common import table


def op5(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6(spark, sf_dir):
    return media_png.image_features(media_png.text_images(table(spark, sf_dir, "documents")))


def op7(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op10(spark, sf_dir):
    return bpe_automaton.code_documents(table(spark, sf_dir, "documents"), keep=False)


QUERIES = {
    "op1_pii": pii.op1,
    "op2_near_dedup": near_dedup.op2,
    "op3_quality": quality.op3,
    "op4_chat_format": chat_format.op4,
    "op5_packing": op5,
    "op6_media_png": op6,
    "op7_token_counts": op7,
    "op8_exact_dedup": exact_dedup.op8,
    "op9_url_filter": url_filter.op9,
    "op10_bpe_automaton": op10,
    "url_rules": url_filter.rules_of_pages,
}
ORACLE = {"op2_near_dedup": near_dedup.OP2_SQL, "op4_chat_format": chat_format.OP4_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "url_rules": url_filter.RULES_SQL}
