"""Live job progress (ST1-ST7) with Structured Streaming.

Progress events ``(job_id, seq, ts, kind, file, count)`` are folded per job.
Counters and last-state columns are native streaming aggregates (``max_by`` on
``seq`` makes out-of-order arrival harmless), or partial folds per micro-batch
that add up when they are read. ``foreachBatch`` writes them, one folder per
epoch, into a table under the shared checkpoint folder. Every
streaming fold has a batch twin with the same output, used for polling
historical data and as the test oracle.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routelens.operators.ordered import blocked_rank, join_per_key
from routelens.session import checkpoint_dir

# Fixed values of this binding: event kind -> job status and progress role.
KIND_STATUS = {"signup": "pending", "view": "cloning", "click": "running", "purchase": "done", "error": "failed"}
LOG_MAX, LOG_KEEP = 100, 80


def status_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in KIND_STATUS.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def as_progress(events: DataFrame) -> DataFrame:
    """Binding: ``events`` rows as progress events."""
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"),
                         F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"),
                         F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("file"),
                         F.floor("value").cast("long").alias("count"))


def job_fold_aggs():
    """ST1 + ST2 + ST6 aggregate expressions (shared by the stream and its batch twin)."""
    return [
        F.max_by(status_of(F.col("kind")), "seq").alias("status"),
        F.max_by(F.when(F.col("kind") == "error", F.col("file")), F.when(F.col("kind") == "error", F.col("seq"))).alias("last_error"),
        F.max_by(F.col("count"), F.when(F.col("kind") == "signup", F.col("seq"))).alias("routes_total"),
        F.count_if(F.col("kind") == "click").alias("routes_done"),
        F.count_if(F.col("kind") == "error").alias("routes_failed"),
        F.sum(F.when(F.col("kind") == "purchase", F.col("count")).otherwise(0)).alias("endpoints"),
        F.count_if(F.col("kind") == "purchase").alias("schemas_resolved"),
        F.count(F.lit(1)).alias("n_events"),
        F.max("seq").alias("last_seq"),
    ]


def job_state(progress: DataFrame) -> DataFrame:
    """ST1/ST2/ST6 batch twin: one row per job."""
    return progress.groupBy("job_id").agg(*job_fold_aggs())


def log_tail_len(n: Column) -> Column:
    """ST3 closed form: append, and when the log exceeds 100 keep the last 80."""
    return F.when(n <= LOG_MAX, n).otherwise(LOG_KEEP + F.pmod(n - (LOG_MAX + 1), F.lit(LOG_MAX - LOG_KEEP + 1)))


def log_tail(progress: DataFrame) -> DataFrame:
    """ST3 batch twin: log length, retained tail length and the first retained seq."""
    n = progress.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_log"))
    # rank from the end = n - rank from the start + 1 (blocked rank: no per-job sort in one task)
    r = join_per_key(blocked_rank(progress.select("job_id", "seq"), ["job_id"], "seq", "rk_asc"), n, ["job_id"])
    r = r.withColumn("rk", F.col("n_log") - F.col("rk_asc") + 1)
    kept = r.where(F.col("rk") <= log_tail_len(F.col("n_log")))
    return kept.groupBy("job_id", "n_log").agg(F.count(F.lit(1)).alias("tail_len"), F.min("seq").alias("first_kept_seq"))


def phase_status(progress: DataFrame) -> DataFrame:
    """ST4: per (job, phase): latest status (active / complete) and event count."""
    st = F.when(F.col("seq") % 2 == 1, F.lit("active")).otherwise(F.lit("complete"))
    return progress.groupBy("job_id", F.col("kind").alias("phase")).agg(F.max_by(st, "seq").alias("status"),
                                                                        F.count(F.lit(1)).alias("n"))


def in_flight(progress: DataFrame) -> DataFrame:
    """ST5: files started (view/click) and not yet finished (purchase/error)."""
    d = F.when(F.col("kind").isin("view", "click"), 1).when(F.col("kind").isin("purchase", "error"), -1).otherwise(0)
    g = progress.groupBy("job_id", "file").agg(F.sum(d).alias("open"))
    return g.where(F.col("open") > 0)


def job_snapshot(state: DataFrame, polls: DataFrame) -> DataFrame:
    """ST7: poll answer per requested job: 200 with results when done, 409 while
    running, 404 for unknown jobs."""
    j = polls.join(state.select("job_id", "status", "endpoints"), "job_id", "left")
    code = F.when(F.col("status").isNull(), 404).when(F.col("status") == "done", 200).otherwise(409)
    return j.select("job_id", code.alias("http_status"), F.when(code == 200, F.col("endpoints")).alias("endpoints"))


# ------------------------------------------------------------------ streams

def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events*.parquet`` of a folder as a stream, one file per micro-batch (schema from the batch read).

    No watermark: the folds are ordered by ``seq``, not by time, and a late event must count.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = (spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
           .option("maxFilesPerTrigger", 1).parquet(sf_dir))
    return as_progress(raw)


def _epoch_writer(**parts):
    """``foreachBatch`` writer: each ``folder=function`` writes its fold of the batch below ``epoch=N``.
    A repeated epoch replaces its own folder, so every event counts once."""
    def write(batch: DataFrame, epoch: int) -> None:
        for folder, fold in parts.items():
            fold(batch).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
    return write


def _run(out: DataFrame, base: str, mode: str, **parts) -> None:
    """One ``availableNow`` run with its checkpoint below ``base``."""
    q = (out.writeStream.outputMode(mode).foreachBatch(_epoch_writer(**parts))
         .option("checkpointLocation", base + "/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()


def run_job_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1/ST2/ST6 as a stateful streaming aggregate: a few counters per job stay in the state store.

    Output mode ``update`` sends only changed jobs per micro-batch; of each job the row of its
    newest epoch is the answer. Checkpoint and table live in the shared checkpoint folder.
    """
    base = os.path.join(checkpoint_dir(spark), "progress-" + uuid.uuid4().hex[:8])
    table_dir = base + "/snapshot"
    _run(progress_stream(spark, sf_dir).groupBy("job_id").agg(*job_fold_aggs()), base, "update", **{table_dir: lambda b: b})
    snap = spark.read.parquet(table_dir)
    cols = [c for c in snap.columns if c not in ("job_id", "epoch")]
    return snap.groupBy("job_id").agg(F.max_by(F.struct(*cols), "epoch").alias("s")).select("job_id", "s.*")


def job_parts(progress: DataFrame) -> DataFrame:
    """The job fold of some events, with the seqs that its last-wins fields come from."""
    return progress.groupBy("job_id").agg(
        *job_fold_aggs(), F.max(F.when(F.col("kind") == "error", F.col("seq"))).alias("error_seq"),
        F.max(F.when(F.col("kind") == "signup", F.col("seq"))).alias("total_seq"))


def merge_job_parts(parts: DataFrame) -> DataFrame:
    """Folds of disjoint event sets as one fold: counters add up, last-wins fields follow their seq."""
    total = [F.sum(c).alias(c) for c in ("routes_done", "routes_failed", "endpoints", "schemas_resolved", "n_events")]
    return parts.groupBy("job_id").agg(
        F.max_by("status", "last_seq").alias("status"), F.max_by("last_error", "error_seq").alias("last_error"),
        F.max_by("routes_total", "total_seq").alias("routes_total"), *total, F.max("last_seq").alias("last_seq"))


def run_job_state_stream_evicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1/ST2/ST6 without any state between micro-batches: each batch is folded by itself and its
    partial fold stored; reading merges the partial folds. A job that falls silent holds nothing,
    and one that speaks again goes on from its stored counters, however late."""
    base = os.path.join(checkpoint_dir(spark), "jobfold-" + uuid.uuid4().hex[:8])
    _run(progress_stream(spark, sf_dir), base, "append", **{base + "/parts": job_parts})
    return merge_job_parts(spark.read.parquet(base + "/parts"))


def _newest(progress: DataFrame) -> DataFrame:
    """The last ``LOG_MAX`` seqs of every job: no tail is longer (the rank filter runs before the shuffle)."""
    w = Window.partitionBy("job_id").orderBy(F.col("seq").desc())
    return progress.select("job_id", "seq").withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= LOG_MAX).drop("rk")


def run_log_tail_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3 as a stream: each micro-batch stores its entry counts and its newest ``LOG_MAX`` seqs per
    job; reading adds the counts and takes the tail from the stored seqs, in seq order."""
    base = os.path.join(checkpoint_dir(spark), "logtail-" + uuid.uuid4().hex[:8])
    _run(progress_stream(spark, sf_dir), base, "append",
         **{base + "/counts": lambda b: b.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_log")), base + "/seqs": _newest})
    n = spark.read.parquet(base + "/counts").groupBy("job_id").agg(F.sum("n_log").alias("n_log"))
    w = Window.partitionBy("job_id").orderBy(F.col("seq").desc())
    newest = _newest(spark.read.parquet(base + "/seqs")).withColumn("rk", F.row_number().over(w))
    kept = newest.join(n, "job_id").where(F.col("rk") <= log_tail_len(F.col("n_log")))
    return kept.groupBy("job_id", "n_log").agg(F.count(F.lit(1)).alias("tail_len"), F.min("seq").alias("first_kept_seq"))
