"""The journal as a Parquet table, partitioned by job and pass.

Agents send numbered batches of records and send a batch again until it is acknowledged.
A record is known by its job, pass and agent, the number (`seq`) of its batch and its place
in it. append_journal() and read_journal() keep what arrives as it is; append_once() and
journal_sink() take each record once, with a high-water mark per agent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.storage import complete_numbers

IDENTITY = ("job_id", "pass_no", "agent_id", "seq", "place")


def _identified(records: DataFrame) -> DataFrame:
    lacking = [c for c in IDENTITY if c not in records.columns]
    if lacking:
        raise ValueError(f"journal records need {', '.join(IDENTITY)}; there is no {', '.join(lacking)}")
    return records


def append_journal(records: DataFrame, path: str) -> None:
    """Append batches as they come; a replay repeats records under the same identity."""
    _identified(records).write.mode("append").partitionBy("job_id", "pass_no").parquet(path)


def _of_job(found: DataFrame, job_id: int, passes: list[int] | None) -> DataFrame:
    found = found.where(F.col("job_id") == job_id)
    return found if passes is None else found.where(F.col("pass_no").isin(passes))


def read_journal(spark: SparkSession, path: str, job_id: int, passes: list[int] | None = None, once: bool = False) -> DataFrame:
    """A job's records of some passes, read from their partitions only; replays are returned too unless `once`."""
    found = _of_job(_identified(spark.read.parquet(path)), job_id, passes)
    return found.dropDuplicates(list(IDENTITY)) if once else found


def append_once(records: DataFrame, path: str, number: int) -> DataFrame:
    """Append what has not been taken before, as delivery `number`, and return the acknowledgements.

    records have IDENTITY and record_count, the size of their batch; batches of an agent are
    numbered from 1. Of each agent everything up to acked_seq is stored: records of batches up to it are replays and go
    without a look at what is stored, others are compared with the identities of the records
    stored beyond it, which are few. Each delivery is a folder of its own, complete once its
    acknowledgements are, so a delivery that failed, or runs again, replaces itself.
    """
    spark, keys = records.sparkSession, list(IDENTITY)
    fresh = _identified(records).dropDuplicates(keys)
    before = [n for n in complete_numbers(spark, f"{path}/acks") if n < number]
    if before:
        acks = spark.read.parquet(f"{path}/acks/n={before[-1]}")
        pending = spark.read.parquet(f"{path}/pending/n={before[-1]}")
        fresh = fresh.join(acks, "agent_id", "left").where("acked_seq is null or seq > acked_seq").drop("acked_seq")
        fresh = fresh.join(pending.select(*keys), keys, "left_anti")
    fresh.write.mode("overwrite").partitionBy("job_id", "pass_no").parquet(f"{path}/records/n={number}")
    open_ = spark.read.schema(fresh.schema).parquet(f"{path}/records/n={number}").select(*keys, "record_count")
    if before:
        open_ = open_.unionByName(pending)
    else:
        acks = open_.select("agent_id", F.lit(0).cast("long").alias("acked_seq")).where("false")
    whole = open_.groupBy("agent_id", "seq").agg(F.count("*").alias("n"), F.max("record_count").alias("record_count")).where("n = record_count")
    # batches, not records: the k-th whole one beyond the mark is acknowledged if no number is missing before it
    place = F.row_number().over(Window.partitionBy("agent_id").orderBy("seq"))
    next_ = whole.withColumn("k", place).join(acks, "agent_id", "left").where("seq = coalesce(acked_seq, 0) + k")
    high = next_.select("agent_id", F.col("seq").cast("long").alias("acked_seq")).unionByName(acks).unionByName(open_.select("agent_id", F.lit(0).cast("long").alias("acked_seq")))
    high.groupBy("agent_id").agg(F.max("acked_seq").alias("acked_seq")).write.mode("overwrite").parquet(f"{path}/acks-next/n={number}")
    told = spark.read.parquet(f"{path}/acks-next/n={number}")
    open_.join(told, "agent_id").where("seq > acked_seq").drop("acked_seq").write.mode("overwrite").parquet(f"{path}/pending/n={number}")
    told.write.mode("overwrite").parquet(f"{path}/acks/n={number}")  # the delivery is complete
    return spark.read.parquet(f"{path}/acks/n={number}")


def read_once(spark: SparkSession, path: str, job_id: int | None = None, passes: list[int] | None = None) -> DataFrame:
    """The records of all complete deliveries, each once; of one job and some passes from their partitions only."""
    done = complete_numbers(spark, f"{path}/acks")
    found = spark.read.option("basePath", f"{path}/records").parquet(*[f"{path}/records/n={n}" for n in done]).drop("n")
    return found if job_id is None else _of_job(found, job_id, passes)


def journal_sink(path: str):
    """For foreachBatch: append_once() under the number of the micro-batch, so that a stream that starts again loses and repeats nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_once(batch, path, batch_id)

    return write
