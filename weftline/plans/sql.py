"""Queries written once in SQL that both engines read, with the few functions that they spell differently as macros."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from weftline.plans.registry import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "embeddings", "labels")

_SPARK = {
    "pct": "percentile({0}, {1})",
    "sha": "sha2({0}, 256)",
    "days": "datediff({0}, {1})",
    "ym": "date_format({0}, 'yyyy-MM')",
    "epoch": "unix_seconds(CAST({0} AS TIMESTAMP))",
    "weeks": "explode(sequence({0}, {1}, INTERVAL 7 DAYS))",
    "months": "explode(sequence({0}, {1}, INTERVAL 1 MONTH))",
    "numbers": "explode(sequence({0}, {1}))",
    "addweek": "date_add({0}, 7)",
    "subday": "date_sub({0}, 1)",
    "matches": "regexp_like({0}, {1})",
    "bit": "(shiftright({0}, {1}) & 1)",
    "ceil": "CAST(ceil({0}) AS BIGINT)",
    "words": "explode(split({0}, {1}))",
    "ts": "try_to_timestamp({0})",
}
_DUCK = {
    "pct": "quantile_cont({0}, {1})",
    "sha": "sha256({0})",
    "days": "date_diff('day', CAST({1} AS DATE), CAST({0} AS DATE))",
    "ym": "strftime({0}, '%Y-%m')",
    "epoch": "CAST(floor(epoch({0})) AS BIGINT)",
    "weeks": "CAST(unnest(generate_series(CAST({0} AS TIMESTAMP), CAST({1} AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE)",
    "months": "CAST(unnest(generate_series(CAST({0} AS TIMESTAMP), CAST({1} AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE)",
    "numbers": "unnest(generate_series({0}, {1}))",
    "addweek": "CAST({0} + INTERVAL 7 DAY AS DATE)",
    "subday": "CAST({0} - INTERVAL 1 DAY AS DATE)",
    "matches": "regexp_matches({0}, {1})",
    "bit": "(({0} >> {1}) & 1)",
    "ceil": "CAST(ceil({0}) AS BIGINT)",
    "words": "unnest(string_split({0}, {1}))",
    "ts": "try_cast({0} AS TIMESTAMP)",
}

#: Views that queries are written over: interactions between users who follow each other within an hour, posts with a
#: binary label, and labelled user-months.
VIEWS = {
    "ix": "SELECT * FROM (SELECT event_id, user_id AS src, lead(user_id) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS dst, ts, event_type AS kind FROM events) t WHERE dst IS NOT NULL",
    "pairs": "SELECT src, dst, count(*) AS w FROM ix GROUP BY src, dst",
    "typed": "SELECT kind, src, dst, count(*) AS w FROM ix GROUP BY kind, src, dst",
    "nodes": "SELECT src AS node FROM pairs UNION SELECT dst AS node FROM pairs",
    "post": "SELECT event_id, user_id AS u, ts, CAST(date_trunc('week', ts) AS DATE) AS week, event_type AS kind, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 2 AS y FROM events",
    "lab": "SELECT o_custkey AS u, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS k1, count(CASE WHEN l_linestatus <> 'O' THEN 1 END) AS k0 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "weekly": "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, src, dst, count(*) AS w FROM ix GROUP BY 1, 2, 3",
}
_NEEDS = {"pairs": ("ix",), "typed": ("ix",), "nodes": ("ix", "pairs"), "weekly": ("ix",)}


def translate(text: str, macros: dict[str, str]) -> str:
    """Fill in macros, written $name(a; b)$, innermost first."""
    call = re.compile(r"\$(\w+)\(([^$]*?)\)\$")
    while call.search(text):
        text = call.sub(lambda m: macros[m[1]].format(*(a.strip() for a in m[2].split(";"))), text)
    return text


def with_views(text: str, needs: tuple[str, ...]) -> str:
    names: list[str] = []
    for n in needs:
        for x in (*_NEEDS.get(n, ()), n):
            if x not in names:
                names.append(x)
    if not names:
        return text
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = re.sub(r"^\s*WITH\s+", ", ", text)
    return f"WITH {head}{body}" if body.startswith(",") else f"WITH {head} {body}"


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the tables of a folder; only those that the text names are opened."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS as a DataFrame."""
    return run(spark, sf_dir, with_views(f"SELECT * FROM {name}", (name,)))


def duck(text: str, needs: tuple[str, ...] = ()) -> str:
    return translate(with_views(text, needs), _DUCK)


def both(name: str, text: str, needs: tuple[str, ...] = ()) -> None:
    """Register a query that is the same SQL for both engines."""
    whole = with_views(text, needs)

    def fn(spark: SparkSession, sf_dir: str, text: str = translate(whole, _SPARK)) -> DataFrame:
        return run(spark, sf_dir, text)

    query(name, translate(whole, _DUCK))(fn)
