"""The operators on the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltabula.llm import bpe, centroids, conversations, decontaminate, exact, langid, minhash, packing, pii, substrings, tokenfiles, topk, urls
from moltabula.llm.common import table

URL_RULES = [
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
]


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.identify(docs, langid.fit(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, folder, "documents"), bpe.default_path("byte_bpe_50k.json"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, folder, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfiles.token_file_round_trip(spark, table(spark, folder, "documents"), bpe.default_path("word_bpe_49k.json"), 2)


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), bpe.default_path("word_bpe_49k.json"), 1, 2048)


def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op9_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.without_repeats(table(spark, folder, "documents"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), urls.rule_table(spark, URL_RULES))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, folder, "conversations"))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings"))


def op13_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("runs")


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_bpe, op3_exact_dedup, op4_pii, op5_top_k, op6_token_files, op7_packing, op8_minhash, op9_repeated_strings, op10_url_filter,
    op11_conversation_trie, op12_centroids, op13_decontaminate)}
