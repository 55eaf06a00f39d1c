"""Scans, sinks, manifests and streams: each writes to the shared folder and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.plans.sql import duck, view
from weftline.session import cut, shared_folder
from weftline.sources import files
from weftline.streaming import weekly


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/weftline-io-{uuid.uuid4().hex}"


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet")


@query("s01_s04_csv_typed", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    files.write_csv(_nation(spark, sf_dir), path)
    return files.read_typed_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("s02_csv_as_text", "SELECT CAST(n_nationkey AS STRING) AS n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS n_name FROM nation")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    name = F.when(F.col("n_nationkey") % 5 == 0, F.lit("")).otherwise(F.col("n_name"))
    files.write_csv(_nation(spark, sf_dir).select("n_nationkey", name.alias("n_name")), path)
    return files.read_text_csv(spark, path, ["n_nationkey", "n_name"])


@query("s03_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 45").select("l_orderkey", "l_quantity")


@query("s05_s11_partition_scan", duck("SELECT src, dst, w FROM weekly WHERE week = DATE '2024-01-08'", ("weekly",)))
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    files.write_table(view(spark, sf_dir, "weekly").repartition("week"), path, ("week",))
    return files.read_partition(spark, path, "week", "2024-01-08").select("src", "dst", "w")


@query("s06_verified_read", "SELECT r_regionkey, r_name FROM region")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    files.write_table(spark.read.parquet(f"{sf_dir}/region.parquet"), path)
    return files.read_verified(spark, path, cut(files.manifest(spark, path, "*.parquet")))


@query("s07_array_cache", "SELECT vec_id, CAST(len(embedding) AS INT) AS n FROM embeddings")
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    files.write_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), path)
    return spark.read.parquet(path).select("vec_id", F.size("embedding").alias("n"))


@query("s09_json_round_trip", "SELECT n_nationkey, n_name FROM nation")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    files.write_json(_nation(spark, sf_dir).select("n_nationkey", "n_name"), path)
    return spark.read.schema("n_nationkey int, n_name string").json(path)


@query("s10_s12_exclusive_sink", "SELECT true AS refused")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    files.write_csv(_nation(spark, sf_dir), path)
    try:
        files.refuse_existing(spark, [path])
        refused = False
    except FileExistsError:
        refused = True
    return spark.createDataFrame([(refused,)], "refused boolean")


@query("s13_report_sink", "SELECT * FROM (VALUES ('first'), ('second')) t(value)")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    files.write_report(spark, ["first", "second"], path)
    return spark.read.text(path)


@query("s14_read_back", "SELECT CAST(0 AS BIGINT) AS differing")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, df = _place(spark), _nation(spark, sf_dir)
    files.write_table(df, path)
    return files.differing_rows(df, spark.read.parquet(path)).agg(F.count("*").alias("differing"))


@query("s15_v01_manifest", "SELECT CAST(0 AS BIGINT) AS changed, true AS hashed")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    files.write_table(_nation(spark, sf_dir), path)
    before, after = (cut(files.manifest(spark, path)) for _ in range(2))
    hashed = before.agg(F.min(F.length("sha256")) == 64).first()[0]
    return files.changed(before, after).agg(F.count("*").alias("changed")).withColumn("hashed", F.lit(bool(hashed)))


@query("s08_model_round_trip", "SELECT CAST(0 AS BIGINT) AS differing")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml import PipelineModel

    from weftline.operators.models import logistic

    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_acctbal") > 3000).cast("double").alias("y"), (F.col("c_custkey") % 7).cast("double").alias("a"), "c_custkey")
    fitted, path = logistic(rows, ["a"], "y"), _place(spark)
    fitted.write().save(path)
    a, b = (m.transform(rows).select("c_custkey", "prediction") for m in (fitted, PipelineModel.load(path)))
    return files.differing_rows(a, b).agg(F.count("*").alias("differing"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of one folder, written in order of time into several files, of which a micro-batch reads one."""
    path = _place(spark)
    ordered = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("u"), F.col("event_type").alias("kind"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), "event_id")
    _in_order(ordered, path, "ts")
    return weekly.event_stream(spark, path, "ts timestamp, u bigint, kind string, k int, event_id bigint")


def _in_order(df: DataFrame, path: str, *by: str, files: int = 4) -> None:
    """Write files one after the other, as a source that grows with time would."""
    most = max(1, -(-df.count() // files))
    df.coalesce(1).sortWithinPartitions(*by).write.option("maxRecordsPerFile", most).parquet(path)


def _drain(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives, written and read back."""
    path = _place(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "integer")).parquet(f"{path}/out")


@query("ss01_ss04_closed_weeks", duck("SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('week', min(ts)) + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"))
def ss01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drain(spark, weekly.monday_weeks(_events(spark, sf_dir)), "append").select("week", "kind", "n")


@query("ss06_last_label", duck("SELECT user_id AS u, max_by(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 2, ts) AS y FROM events GROUP BY user_id"))
def ss06(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _events(spark, sf_dir).select("u", (F.col("k") % 2).alias("y"), "ts")
    got = _drain(spark, weekly.last_labels(labels), "update")
    return got.groupBy("u").agg(F.max_by("y", F.struct("batch")).alias("y"))


@query("ss02_lagged_state", duck("WITH w AS (SELECT user_id AS node, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(*) AS n FROM events GROUP BY 1, 2) SELECT node, week, CAST(coalesce(sum(n) OVER (PARTITION BY node ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM w"))
def ss02(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    totals = events.groupBy(F.col("user_id").alias("node"), F.date_trunc("week", F.col("ts").cast("timestamp")).alias("week")).agg(F.count("*").alias("n"))
    _in_order(totals, path, "week", "node")
    stream = weekly.event_stream(spark, path, "node bigint, week timestamp, n bigint")
    return _drain(spark, weekly.lagged_totals(stream), "append").select("node", "week", "before")
