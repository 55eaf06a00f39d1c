"""A training-data pipeline over documents: each stage reads what the one before it kept.

Toxic documents go, then all but one of each group of near copies, then passages that repeat, then documents that hold
benchmark passages; what is left becomes tokens.

Every stage takes any table with the columns doc_id and text, and all but the last give back all its columns. Null and empty
texts pass every filter and have no tokens; rows without a doc_id are never anybody's copy and stay. Repeated rows are exact copies:
one is kept. Texts of any length are read whole. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import byte_bpe, decontaminate, ngram_join, repeats, toxicity
from weftline.llm.common import table
from weftline.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose score reaches the threshold; learnt from the labelled rows among docs that aren't held out."""
    return toxicity.keep_ordinary(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of documents that link: that of its least doc_id."""
    return ngram_join.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of some fifty words are to go, so strings of 250 bytes are looked for, not the 400 of the query."""
    return repeats.without_repeats(docs, repeats.PASSAGE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows of which benchmark windows hit a word in twenty or more."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of the text decoded from them."""
    import public_tokenizers as P

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(docs, ranks, P.PATTERN, with_ids=True)  # one worker a task less than by encode and decode


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("repeats", drop_repeats),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", to_tokens),
]

#: SQL has no suffix sorting, no dictionaries and no merges: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
