"""The registered queries of this subpackage: thin readers of the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm import chat, language_id, language_model, line_dedup, merkle, quality, substring_dedup
from obsframe.llm.common import documents, fold
from obsframe.llm.decontamination import find_overlaps
from obsframe.llm.packing import pack
from obsframe.llm.simhash import near_duplicates
from obsframe.llm.token_counts import token_counts
from obsframe.llm.vector_search import exact_top_k
from obsframe.llm.whitening import whiten


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold("doc_id", 3) == 1
    model = language_id.fit(docs, ~held_out)
    found = language_id.identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_char")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that overlap."""
    docs, benchmark = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_overlaps(docs.select("doc_id", "text"), benchmark, least_item=1)
    return found.select("doc_id", F.inline("overlaps"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold("doc_id", 5) == 0
    scored = quality.score_quality(docs, quality.fit(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.CUT_SCORE).cast("int").alias("predicted"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 7) == 2
    scored = language_model.score_texts(documents(spark, sf_dir), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    leaf = lambda n_chars: merkle.digest(*map(F.col, ("doc_id", "source", "lang")), n_chars, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(tampered, leaf(F.try_add("n_chars", F.lit(1))))
    return merkle.verify(merkle.build_manifest(docs, leaf(F.col("n_chars")), changed))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and -1, which says control strings."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("</s>[INST] ok [/INST]"))
    done = chat.format_chat(said.union(tricky)).withColumn("formatted", chat.formatted(F.col("segments")))
    back = done.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("segments")).alias("learned"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(lines).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        digest(F.col("learned")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_language_model": op8_language_model,
    "op9_line_dedup": op9_line_dedup,
    "op10_top_k": op10_top_k,
    "op11_merkle": op11_merkle,
    "op12_chat": op12_chat,
    "op13_whitening": op13_whitening,
}

SQL = {
    "op4_substring_dedup": substring_dedup.SQL,
    "op9_line_dedup": line_dedup.SQL.format(docs="documents", least=line_dedup.LEAST_DOCUMENTS, kept=line_dedup.LEAST_KEPT, share=line_dedup.KEPT_SHARE),
    "op10_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score,
                   row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
        ) WHERE rank <= 10
    """,
    "op11_merkle": merkle.SQL,
    "op12_chat": chat.SQL,
}
