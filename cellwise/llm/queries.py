"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm import ann, bpe, chat, counting, decontaminate, lm, packing, quality, repair, simhash, substrings, toxicity, whitening
from cellwise.session import table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = packing.pieces(table(spark, sf_dir, "documents"), vocabulary_path())
    return packing.pack(items.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("kept_", F.lit("")).cast("binary"), 256)
    return cut.select("doc_id", F.col("n_words_").alias("n_words"), F.col("n_removed_").alias("n_removed"), kept.alias("kept_sha256"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), lm.held_out())


def toxic_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Chain:
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.fit(docs, labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxic_chain(spark, docs, sf_dir))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted.alias("predicted"), "spans")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_edits(table(spark, sf_dir, "documents"), counting.revision(), vocabulary_path())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.report(turns, repair.damage(turns))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.suffix_shards(table(spark, sf_dir, "documents"))
    found = decontaminate.search(index, table(spark, sf_dir, "benchmark"))
    hits = found.select(F.col("doc.c0").alias("doc_id"), "n_words", decontaminate.hit_words().alias("n_hit"), "items", "best")
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "best")


QUERIES = {"op1_bpe": op1_bpe, "op2_packing": op2_packing, "op3_substrings": op3_substrings, "op4_neighbours": op4_neighbours, "op5_language_model": op5_language_model, "op6_toxicity": op6_toxicity, "op7_chat": op7_chat, "op8_simhash": op8_simhash, "op9_quality": op9_quality, "op10_token_counts": op10_token_counts, "op11_whitening": op11_whitening, "op12_repair": op12_repair, "op13_decontamination": op13_decontamination}
ORACLES: dict[str, str] = {"op7_chat": chat.CHECK_SQL}
