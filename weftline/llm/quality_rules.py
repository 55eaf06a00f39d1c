"""Quality rules of documents: a table of thresholds, compiled into one projection.

``measures`` counts words, symbols, stop words and kinds of lines of each whole text, by built-in functions only; ``compiled`` makes one
boolean column of each row of ``RULES``, and ``judge`` adds them up to a verdict and the names of the rules that a document breaks. Nothing
is shuffled, and a document never leaves its row.

Words are runs of anything but ASCII white space. A repeated window is three words in a row that occur twice or more in the
text: windows are sorted within the row together with their places, so a text of n words takes n log n steps and memory for some n
windows, however often they repeat. A null or empty text has no words, counts of zero, and fails the base. Rows are kept one for one, repeated
ones too, and nothing depends on doc_id, which may be null; an empty table gives an empty result; columns other than doc_id and
text don't matter. A ratio over nothing breaks no rule; a ratio at a threshold is within it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: Very frequent words of English, German, French and Spanish.
STOP_WORDS = sorted(
    set(
        "the of and to a in is for that it was with on by as be this at are from or an not have has which but his her they we you "
        "der die und in den von das zu mit sich auf des für ist im ein nicht dem eine als er es auch an war aus bei nach wird "
        "de la le et les des en un du une que est pour qui par au dans sur pas avec il ce ne plus se son sont aux "
        "el y los las se del por con no una al para su lo como es más o si sus fue".split()
    )
)
#: What is taken off a word's end before it is looked up among the stop words, and what starts or ends a line of its kind.
MARKS, BULLETS, ELLIPSES = ".,;:!?", ("-", "*", "•"), ("...", "…")


class Rule(NamedTuple):
    """top / bottom (or top alone) is within [least, most], both in thousandths where there is a bottom."""

    name: str
    top: str
    bottom: str | None = None
    least: int | None = None
    most: int | None = None
    base: bool = False


RULES = (
    Rule("length", "n_words", least=50, base=True),
    Rule("repeated words", "n_repeat_words", "n_words", most=500, base=True),
    Rule("word length", "word_chars", "n_words", least=2000, most=10_000),
    Rule("symbols", "n_symbols", "n_words", most=200),
    Rule("stop words", "n_stop_words", "n_words", least=60),
    Rule("duplicate lines", "n_dup_lines", "n_lines", most=500),
    Rule("bullets", "n_bullet_lines", "n_lines", most=900),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", most=300),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def _any(line: Column, test: str, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | getattr(line, test)(m)
    return found


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules are about, a row for each of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumns({"words": F.regexp_extract_all("text", F.lit(f"[^{SPACE}]+"), F.lit(0)), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))})
    last = F.size("words") - 3
    window = lambda i: F.struct(F.concat_ws(" ", *(F.get("words", i + k) for k in range(3))).alias("window"), i.alias("at"))
    rows = rows.withColumn("windows", F.when(last >= 0, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window))))
    near = lambda x, k: F.coalesce(F.get("windows", k)["window"] == x["window"], F.lit(False))
    places = F.transform(F.filter("windows", lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x["at"])
    fold = F.aggregate(
        F.sort_array(F.coalesce(places, F.array().cast("array<int>"))),
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda s, at: F.struct(at.alias("at"), (s["n"] + F.least(F.lit(3), at - s["at"])).alias("n")),
        lambda s: s["n"],
    )
    known = F.filter("words", lambda w: F.rtrim(F.lower(w), F.lit(MARKS)).isin(STOP_WORDS))
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.regexp_replace("text", f"[{SPACE}]+", "")),
        "n_symbols": F.regexp_count("text", F.lit(f"[{SYMBOLS}]")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": fold,
        "n_stop_words": F.size(known),
        "n_lines": F.size("lines"),
        "n_bullet_lines": F.size(F.filter("lines", lambda x: _any(F.ltrim(x), "startswith", BULLETS))),
        "n_ellipsis_lines": F.size(F.filter("lines", lambda x: _any(F.rtrim(x), "endswith", ELLIPSES))),
    }
    # out of an array of one: a later filter on counts or verdicts would otherwise be moved below, with these expressions written out in it many times over
    return rows.select("doc_id", F.inline(F.array(F.struct(*(c.cast("long").alias(name) for name, c in counts.items())))))


def compiled(rule: Rule) -> Column:
    """Whether a row of measures keeps to the rule."""
    top, bottom = F.col(rule.top), F.lit(1) if rule.bottom is None else F.col(rule.bottom)
    top = top if rule.bottom is None else top * 1000
    fine = F.lit(True)
    if rule.least is not None:
        fine = fine & (top >= rule.least * bottom)
    if rule.most is not None:
        fine = fine & (top <= rule.most * bottom)
    return fine


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures of each document, base_failed, kept, and broken: the names of the rules that it breaks, in order."""
    every = lambda some: F.forall(F.array(F.lit(True), *map(compiled, some)), lambda x: x)
    broken = F.array_compact(F.array(*(F.when(~compiled(r), F.lit(r.name)) for r in rules))) if rules else F.array().cast("array<string>")
    return measures(docs).select("doc_id", *MEASURES, (~every([r for r in rules if r.base])).alias("base_failed"), every(rules).alias("kept"), broken.alias("broken"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept", F.array_join("broken", ",").alias("broken"))
