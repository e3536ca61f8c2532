"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import conversations, exact_dedup, jaccard_join, language_id, masked_lm, mixing, mixture_packing, packing, periodic_runs, prefix_trie, token_shards, toxicity, vector_dedup, warc
from postmill.llm.common import crc_of_id, table
from postmill.llm.tokens import WordTokenizer
from postmill.operators.ordering import materialize
from postmill.session import shared_dir

SEQUENCE_TOKENS = 4096
WINDOW_TOKENS = 2048
END_ID = 1


def word_tokenizer(end_id: int | None = END_ID) -> WordTokenizer:
    import public_tokenizers

    return WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), end_id)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.similar_vectors(table(spark, sf_dir, "embeddings"))


def op2_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score_documents(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), new_folder(spark, "warc")
    warc.write_archives(pages, folder)
    read = warc.read_archives(spark, folder, pages.schema["page_id"].dataType.simpleString())
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer(), SEQUENCE_TOKENS)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(crc_of_id("doc_id") % 5 != 0)
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    held_out = crc_of_id("doc_id") % 5 == 0
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_classes(table(spark, sf_dir, "documents"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    index = token_shards.write_shards(table(spark, sf_dir, "documents"), word_tokenizer(), folder)
    return index.join(token_shards.digests(token_shards.read_shards(spark, folder)), "slot")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_of_id("doc_id") % 3 == 1)
    model = language_id.fit(docs.filter("not held_out"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = conversations.turn_lists(table(spark, sf_dir, "conversations"))
    members = materialize(conversations.sequences(conversations.rebuilt(lists)), "members")
    ends = materialize(conversations.joined_id_digests(members.select("seq", F.col("conv_id").alias("id"))), "ends")
    different = members.groupBy("seq").agg(F.first("key").alias("key"), F.first("sizes").alias("sizes"))
    different = different.join(ends.select("seq", "least", F.col("n").alias("members")), "seq")
    nodes = prefix_trie.prefix_trie(different)
    closing = nodes.filter("ending is not null").join(ends.select(F.col("least").alias("ending"), F.col("digest").alias("ends_sha256")), "ending")
    others = nodes.filter("ending is null").withColumn("ends_sha256", F.sha2(F.lit(""), 256))
    return closing.unionByName(others).select(
        F.col("node").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"),
        F.col("n_members").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def cycled(docs: DataFrame, word: str = r"[^\x20\x09-\x0D]+") -> DataFrame:
    """``doc_id, text`` in which every tenth text, by the crc32 of its id, repeats its words from some word on."""
    h = crc_of_id("doc_id")
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(word), F.lit(0)))
    found = docs.select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("g") % 8)).cast("int")
    copies = F.ceil((n - a) / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), copies)), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), a), again), " ")
    return found.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.with_runs(cycled(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), periodic_runs.strongest().alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    exponent = F.expr("1000 * best.length div best.period")
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packing.pack_by_source(table(spark, sf_dir, "documents"), word_tokenizer(), WINDOW_TOKENS)


QUERIES = {
    f.__name__: f
    for f in (
        op1_vector_dedup, op2_masked_lm, op3_warc, op4_source_mixing, op5_best_fit_packing, op6_toxicity, op7_jaccard_join,
        op8_token_shards, op9_exact_dedup, op10_language_id, op11_conversation_trie,
        op12_periodic_runs, op13_mixture_packing,
    )
}
