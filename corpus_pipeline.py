"""A corpus pipeline over ``documents``: toxic documents go, near-duplicates go, repeated passages are cut out, benchmark
leaks go, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written as Parquet and read again as the next
stage's ``docs``, so that a stage starts from a durable table. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.llm import decontamination, packing, simhash, substring_dedup, toxicity
from lexitide.llm.queries import remainder
from lexitide.llm.tables import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Whole input rows travel through an operator as one column, so that no name of theirs can clash with its own.
ROW = "__row"


def _packed(docs: DataFrame, *without: str) -> DataFrame:
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without]).alias(ROW))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5. Labels of documents with checksum 0 modulo 5 are not learned from.

    Null and empty texts have no toxic token and stay. Repeated rows are judged alike; other columns are passed on,
    whatever their names. An empty table gives an empty result.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder() != 0)
    model = toxicity.train(*toxicity.sample(docs, labels))
    return toxicity.score(_packed(docs), model, keep=[ROW]).where(F.col("score") < 0.5).select(f"{ROW}.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the row of the smallest id; null ids stay.

    Null, empty and blank texts are one group. Rows of the same id and text, and rows of the same id, stay or go
    together. Other columns are passed on. An empty table gives an empty result.
    """
    found = simhash.similar_documents(docs.select("doc_id", "text"))
    return docs.join(found.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word passages that a document with a smaller id holds; documents of nothing else go.

    What stays of a text keeps its line ends. Null and empty texts, and rows with a null id, stay as they are; rows of one
    id do not cut each other. Other columns are passed on, whatever their names. An empty table gives an empty result.
    """
    cut = substring_dedup.remove_repeats(_packed(docs, "text"), keep=(ROW,), lines=True)
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    cut = cut.where((F.col("n_words") == 0) | (removed < F.col("n_words")))
    new = {"text": F.col("kept"), "n_chars": F.when(F.size("starts") == 0, F.col(f"{ROW}.n_chars")).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType))}
    return cut.select(*[(new[c] if c in new else F.col(f"{ROW}.`{c}`")).alias(c) for c in docs.columns])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with the same or other numbers, names and units.

    Null and empty texts, and rows with a null id, hold none and stay. Rows of one id are one document and go together.
    Other columns are passed on. An empty table, of documents or of the benchmark, loses nothing.
    """
    found = decontamination.contaminated(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its token ids and its place in sequences of at most 4096 tokens.

    Null and empty texts are a piece of one token, the end. Repeated rows and rows with a null id are packed like others.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Learned scores, SimHash and tokenizers are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
