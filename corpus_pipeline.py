"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
each result as Parquet and reads it again as the next stage's documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm import language_id
from obsframe.llm.common import documents, fold, free_name, remove, use_checkpoint_dir
from obsframe.llm.decontamination import find_overlaps
from obsframe.llm.line_dedup import drop_recurring_lines
from obsframe.llm.packing import pack
from obsframe.llm.simhash import similar_texts


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on, with the predicted language as `lang`; those without a
    letter (`und`; null and empty texts too) go. Repeated rows go or stay together; an empty table stays empty."""
    model = language_id.fit(docs, fold("doc_id", 3) != 1)
    prefix = next(p for k in range(1, 99) if not any(c.startswith(p := "_" * k) for c in docs.columns))
    found = language_id.identify_language(docs, model, prefix=prefix)
    predicted = F.col(f"{prefix}lang_pred")
    kept = found.where(predicted != language_id.UNDETERMINED)
    return kept.select(*(predicted.alias(c) if c == "lang" else F.col(c) for c in docs.columns))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs stay in their first document only; n_chars follows the text. Null texts stay null.
    Rows that repeat an id are one document and all stay; an empty table stays empty."""
    kept = drop_recurring_lines(docs)
    return kept.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or
    more (found by their SimHash fingerprints, then verified) the document with the smallest id stays.
    Texts without words are one component. Rows that agree in id and text are one document; other
    texts under the id that stays stay too. Rows without an id stay: no group can name them. An empty table stays empty."""
    found = similar_texts(docs, words=5, similarity=0.8)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).union(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item of LEAST_ITEM words or more go: shorter ones say too little to
    drop a document for. Null and empty texts stay, repeated rows go or stay together, an empty table stays empty."""
    result = free_name(docs, "_overlaps")
    found = find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), result=result)
    return found.where(F.size(result) == 0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of at most 1024 tokens; null texts are the end alone. Repeated
    rows are packed each; an empty table gives no piece."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_common_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Language ID, SimHash and packing can't be written in SQL; tests compare the pipeline with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, stages: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = STAGES) -> DataFrame:
    """All `stages` over the documents of `sf_dir`; what lies between them goes to the shared checkpoint folder. A stage's own tables
    have a folder of their own there, which goes once its result is written."""
    use_checkpoint_dir(spark)
    sc = spark.sparkContext
    shared = sc.getCheckpointDir()
    folder = f"{shared}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in stages:
        steps = f"{folder}/steps-{name}"
        sc.setCheckpointDir(steps)
        try:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        finally:
            # Spark makes a new folder beside the one that was there
            sc.setCheckpointDir(shared.rpartition("/")[0])
            remove(spark, steps)
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
