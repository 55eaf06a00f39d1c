"""Handles, interactions in text, and lexicon polarity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of mentions, reshares and leading handles; they have to be these for equal results.
MENTION = r"(?<![A-Za-z0-9_@])@([A-Za-z0-9_]{1,15})(?![A-Za-z0-9_])"
RESHARE = r"(?i)(?<![A-Za-z0-9_])RT\s+@([A-Za-z0-9_]{1,15})(?![A-Za-z0-9_])"
LEADING = r"^\s*@([A-Za-z0-9_]{1,15})(?![A-Za-z0-9_])"

# A small lexicon, score by word.
LEXICON = {"good": 0.7, "great": 0.8, "love": 0.5, "nice": 0.6, "happy": 0.8, "bad": -0.7, "worst": -1.0, "hate": -0.8, "sad": -0.5, "poor": -0.4}


def handle_all(c: Column) -> Column:
    """Trimmed, all leading @ removed, lower case."""
    return F.lower(F.regexp_replace(F.trim(c), "^@+", ""))


def handle_one(c: Column) -> Column:
    """Trimmed, one leading @ removed, lower case."""
    return F.lower(F.regexp_replace(F.trim(c), "^@", ""))


def mentions(text: Column) -> Column:
    """Handles of up to 15 characters that stand alone: no e-mail, no longer word."""
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(1))


def reshares(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RESHARE), F.lit(1))


def leading(text: Column) -> Column:
    """The handle that a text begins with, or null."""
    return F.nullif(F.regexp_extract(text, LEADING, 1), F.lit(""))


def interactions(posts: DataFrame, text: str = "text") -> DataFrame:
    """Adds target and kind: one row for each target of a text; a retweet outranks a reply, a reply a mention."""
    tag = lambda names, rank: F.transform(names, lambda h: F.struct(F.lower(h).alias("target"), F.lit(rank).alias("rank")))
    first = F.when(leading(F.col(text)).isNotNull(), F.array(leading(F.col(text)))).otherwise(F.array().cast("array<string>"))
    found = F.concat(tag(mentions(F.col(text)), 1), tag(first, 2), tag(reshares(F.col(text)), 3))
    # arrays are sorted by target, then rank: the last of a target's entries is the one that counts
    ordered = F.array_sort(F.array_distinct(found))
    best = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i + 1)["target"] != x["target"], F.lit(True)))
    kinds = F.array(F.lit("mention"), F.lit("reply_inferred"), F.lit("retweet"))
    return posts.withColumn("_hit", F.explode(best)).withColumns({"target": F.col("_hit.target"), "kind": F.element_at(kinds, F.col("_hit.rank"))}).drop("_hit")


def polarity(text: Column) -> Column:
    """Mean score of the lexicon words of a text; 0 if it has none."""
    scores = F.create_map(*[F.lit(x) for pair in LEXICON.items() for x in pair])
    hits = F.filter(F.transform(F.split(F.lower(text), "[^a-z]+"), lambda w: scores[w]), lambda s: s.isNotNull())
    return F.when(F.size(hits) > 0, F.aggregate(hits, F.lit(0.0), lambda a, s: a + s) / F.size(hits)).otherwise(F.lit(0.0))
