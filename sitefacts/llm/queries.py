"""Registered queries of the training-data operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from sitefacts.llm import conversation_trie, cover_tree, line_dedup, mixing, ngram_join, quality_rules, sentencepiece_codec, spelling_variants, suffix_dedup, token_counts, toxicity, training_order, url_filter
from sitefacts.llm.common import table


def op1_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op2_token_shards(spark, sf_dir):
    return training_order.shards(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return cover_tree.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op4_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark, sf_dir):
    return ngram_join.near_components(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark, sf_dir):
    return conversation_trie.report(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql():
    return {"op3_exact_top_k": cover_tree.ORACLE, "op4_line_dedup": line_dedup.ORACLE, "op5_ngram_join": ngram_join.ORACLE, "op6_mixing": mixing.oracle(), "op7_quality_rules": quality_rules.oracle(), "op12_conversation_trie": conversation_trie.ORACLE,
            "op13_spelling_variants": spelling_variants.ORACLE}
