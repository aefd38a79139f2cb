"""Corpus cleaning in stages; each stage reads what the one before it kept.

Toxic documents go, lines that many documents share go, one document of each group of near
copies stays, personal data is replaced, and the rest is packed into training sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import minhash, packing, pii, toxicity
from spindrift.llm.common import stored
from spindrift.llm.line_dedup import LineStore, drop_common_lines
from spindrift.llm.queries import vocabulary
from spindrift.llm.registry import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(rows: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` out of ``row``, with a new text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go, whole; rows without a text or an id stay."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, chain).where(~F.col("rejected")).select("row.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; a document of nothing else stays, with an empty text."""
    cleaned = drop_common_lines(docs, LineStore.build(docs, min_docs=10))
    return _with_text(cleaned, docs, F.col("kept_text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the smallest id stays; documents without words or without an id stay too."""
    dropped = stored(minhash.near_dedup(docs).where(~F.col("kept")).select("doc_id").distinct(), "near-copies")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Patterns become their kind in brackets, disclosing words go or become general; all rows stay."""
    return _with_text(pii.sanitise(pii.find_personal_data(docs)), docs, F.col("clean_text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its tokens and its place; null texts are empty ones."""
    return packing.pack_documents(docs, vocabulary(), capacity=2048, end_id=0, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("pii", replace_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: The stages fit a model and draw signatures, which SQL can't express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
