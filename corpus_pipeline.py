"""A training-data pipeline over ``documents``: each stage takes what its predecessor kept.

Quality (reject below the keep score), near duplicates (one of each group), benchmark decontamination (documents that
hold an item go), personal data (spans are replaced by their kind), best-fit packing. All stages but the last return the
columns of the documents; ``run`` writes each stage's result as Parquet in the shared folder and rereads it.

All stages take null, empty and very long texts, repeated rows, null ids, further columns of any name and empty tables;
what each does with them stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, packing, pii, quality, similarity_join
from gridloom.llm.shared import materialize, table
from gridloom.llm.tokenizing import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the keep score; labels are learnt from those outside the held-out fold. Null and
    empty texts have a score as any other; repeated rows score alike. A score of exactly the keep score stays."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.where(F.col(scored.columns[-1]) >= quality.KEEP_SCORE).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of similarity 4/5 connect, the one with the smallest id (of equal ids, the
    smallest hash of its text). Rows alike in id and text are one; documents without words stay, once each."""
    return similarity_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item: of none are 4/5 of its shingles in the document. Null and empty texts stay, repeated
    rows stay or go together; items without words are in no document."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows. Null texts stay null."""
    return pii.without(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place; null and empty texts are an end id alone."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("PII", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

#: No SQL expresses the classifier's fit or the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
