"""The queries of this subpackage over the given tables, each with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from boardwalk.llm import attention_lm, ball_tree, bpe, chat, decontaminate, fill_middle, html_blocks, language, ngram_join, quality, topk, toxicity
from boardwalk.llm.common import read, remainder
from boardwalk.llm.ship import ship

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return function(spark, folder)

        REGISTRY[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


@query("op1_ngram_join")
def op1(spark, folder):
    rule = ngram_join.Similarity(k=3, num=90, den=100)
    return ngram_join.ngram_components(read(spark, folder, "documents"), rule).select("doc_id", "n_shingles", "component_id", "class_id")


@query("op2_decontamination")
def op2(spark, folder):
    return decontaminate.leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op3_token_counts")
def op3(spark, folder):
    return bpe.token_counts(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=512)


@query("op9_byte_bpe")
def op9(spark, folder):
    return bpe.round_trip(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op4_language")
def op4(spark, folder):
    docs = read(spark, folder, "documents")
    held_out = remainder("doc_id", 4) == 2
    known = language.profiles(docs, remainder("doc_id", 4) != 2)
    return language.identify(docs, known).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op5_chat", chat.ROTATE_SQL)
def op5(spark, folder):
    return chat.digest(chat.rotate(read(spark, folder, "conversations")))


@query("op10_top_k", topk.TOP_K_SQL)
def op10(spark, folder):
    return topk.top_k(read(spark, folder, "embeddings"))


@query("op6_toxicity")
def op6(spark, folder):
    docs = read(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, folder, "labels")))


@query("op7_quality")
def op7(spark, folder):
    docs = read(spark, folder, "documents")
    model = quality.fit(docs, read(spark, folder, "labels"), seen=remainder("doc_id", 3) != 1)
    return quality.score(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op8_attention_lm")
def op8(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    scored = attention_lm.score(read(spark, folder, "documents"), remainder("doc_id", 10) != 0, path, public_tokenizers.PATTERN)
    return scored.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_fill_middle", fill_middle.FILL_MIDDLE_SQL)
def op11(spark, folder):
    return fill_middle.digests(read(spark, folder, "documents"))


@query("op12_ball_tree", ball_tree.RANKED_SQL)
def op12(spark, folder):
    return ball_tree.ranked(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op13_html_blocks")
def op13(spark, folder):
    return html_blocks.extract(read(spark, folder, "pages"))
