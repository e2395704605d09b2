"""A corpus pipeline: five stages from documents to token counts and digests.

Each stage is a function of (spark, docs, sf_dir), where ``docs`` are the documents that
the stage before left and ``sf_dir`` is the folder of the tables.  All but the last return
the columns of ``docs``, in their order.

Null text counts as empty: it isn't toxic, is no copy of any other, holds no personal data
and has no tokens; it stays null up to the last stage.  Rows with a null id stay.  Of rows
with one id and equal words one stays; of an id's different texts none goes for the other's
sake, but all go if one of them is a copy of a smaller id's.  Ties go to the smaller id.
Null sources are a source of their own.  Empty tables give no rows; without labels no text
is toxic.  Columns of any further name pass through all stages but the last, which returns
doc_id, n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from widecairn.llm import jaccard_join, mixing, pii, sentencepiece_bpe, toxicity
from widecairn.llm._frames import discard, stored
from widecairn.llm.queries import tokenizer_bytes

#: The model-based stages have no SQL form.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    chain = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, chain)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar documents."""
    return jaccard_join.one_of_each(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by marks; n_chars is the new length."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files in the order of a mixture by the square root of the sources' sizes."""
    return mixing.in_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return sentencepiece_bpe.encode_decode(docs, tokenizer_bytes(), with_output=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact_pii),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written result of the one before, which goes once the next one's is written."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        try:
            docs = stored(stage(spark, docs, sf_dir), "stage")
        finally:
            if written is not None:
                discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
