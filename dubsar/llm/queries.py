"""The queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dubsar.llm import bpe, chat_format, decontaminate, language_id, language_model, merkle, near_dedup, quality_rules, secret_scans, token_counts, toxicity, trie, warc
from dubsar.llm.shared import stored, table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(table(spark, sf_dir, "documents", "doc_id", "text"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"), "fail_bits",
    )


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    each = (secret_scans.counted(F.col("findings"), k).alias(f"n_{k}") for k in secret_scans.BASE_KINDS)
    base = F.sha2(secret_scans.listed(F.col("findings"), secret_scans.BASE_KINDS), 256)
    return found.select("doc_id", *each, base.alias("base_sha256"), secret_scans.listed(F.col("findings")).alias("spans"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    nodes = stored(chat_format.as_tree(given.unionByName(extra)), "chat-nodes")
    back = chat_format.parsed(stored(chat_format.formatted(nodes), "chat-formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    back = warc.round_trip(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1")
    return language_model.classify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), trusted)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language_id.predict(docs.select("doc_id", "text"), language_id.learn(docs))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, sizes = trie.placed(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return trie.prefix_trie(*trie.rebuilt(turns, sizes))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf(text=lower))
    found = merkle.manifest(table(spark, sf_dir, "documents", *merkle.FIELDS), tampered=tampered)
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    proof = merkle.digest(merkle.proof(F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_secret_scans, op3_decontaminate, op4_bpe, op5_toxicity, op6_chat_format, op7_warc, op8_token_counts, op9_near_dedup, op10_language_model, op11_language_id, op12_prefix_trie, op13_merkle_manifest)
}
