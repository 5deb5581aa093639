"""Run analytics, response cache and run-state folds.

``calls(run_id, seq, agent, phase, model, input_chars, output_chars,
duration_ms, target_file)`` is the call log; caches are ``(key, payload)``
tables; state updates are ``(run_id, turn, ...)`` rows folded with ``max_by`` /
``min`` aggregations (last-wins scalars, first-seen list items).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelens.operators.ordered import blocked_rank, join_per_key


def message_chars(text: Column, parts: Column | None = None) -> Column:
    """L1: characters of one message: plain string, or the sum over its text parts."""
    if parts is None:
        return F.length(F.coalesce(text, F.lit("")))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc + F.length(p))


def call_totals(calls: DataFrame, by=("run_id",)) -> DataFrame:
    """L2 / L3: number of calls and sums of chars and milliseconds per group."""
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_chars").alias("input_chars"),
        F.sum("output_chars").alias("output_chars"), F.sum("duration_ms").alias("duration_ms"))


def human_size(n: Column) -> Column:
    """``1.2M`` / ``3.4K`` / ``12``; one decimal rounded half-up on the exact integer."""
    def fmt(div, unit):
        tenths = F.floor((n * 10 + div // 2) / div).cast("long")
        return F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(unit))
    return (F.when(n >= 1_000_000, fmt(1_000_000, "M")).when(n >= 1_000, fmt(1_000, "K"))
            .otherwise(n.cast("string")))


def call_table(calls: DataFrame) -> DataFrame:
    """L4: numbered calls per run with file basename and seconds, plus a TOTAL row per run.

    Numbering is a blocked rank (see ``ordered``), so a run with a huge number of
    calls is not sorted in a single task.
    """
    ranked = blocked_rank(calls, ["run_id"], "seq", "n")
    rows = ranked.select("run_id", F.col("n").cast("int").alias("n"), "agent",
                         F.regexp_extract("target_file", "([^/]*)$", 1).alias("file"),
                         "input_chars", "output_chars", "duration_ms")
    total = calls.groupBy("run_id").agg(F.lit(None).cast("int").alias("n"), F.lit("TOTAL").alias("agent"),
                                        F.lit("").alias("file"), F.sum("input_chars").alias("input_chars"),
                                        F.sum("output_chars").alias("output_chars"), F.sum("duration_ms").alias("duration_ms"))
    out = rows.unionByName(total)
    return out.withColumn("seconds", F.col("duration_ms") / 1000.0)


def phase_timings(calls: DataFrame) -> DataFrame:
    """Milliseconds per phase and a total (``rollup``)."""
    g = calls.rollup("run_id", "phase").agg(F.sum("duration_ms").alias("ms"), F.grouping_id().alias("gid"))
    return g.where(F.col("gid") < 3).select(
        "run_id", F.when(F.col("gid") == 1, F.lit("total")).otherwise(F.col("phase")).alias("phase"), "ms")


def cache_key(fields: dict) -> Column:
    """SHA-256 of the canonical JSON of the request fields (sorted keys, unset fields dropped)."""
    names = sorted(fields)
    return F.sha2(F.to_json(F.struct(*[fields[n].alias(n) for n in names])), 256)


def cache_probe(requests: DataFrame, cache: DataFrame, mode: str = "on") -> DataFrame:
    """L8 + L10: ``hit`` reuses a parseable cached payload; corrupt entries count as a miss.

    ``mode``: ``on`` (probe), ``overwrite`` (always compute), ``off`` (bypass).
    Returns requests with ``status`` and the cached ``payload`` for hits; the
    work list is ``status != 'hit'``.
    """
    if mode in ("overwrite", "off"):
        return requests.withColumn("payload", F.lit(None).cast("string")).withColumn(
            "status", F.lit("compute" if mode == "overwrite" else "bypass"))
    ok = cache.where(F.try_parse_json("payload").isNotNull())
    ok = ok.groupBy("key").agg(F.max_by("payload", "version").alias("payload"))
    j = requests.join(ok, "key", "left")
    return j.withColumn("status", F.when(F.col("payload").isNotNull(), "hit").otherwise("miss"))


def cache_store(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by key; the newest version of a key wins."""
    u = cache.unionByName(new)
    return u.groupBy("key").agg(F.max_by("payload", "version").alias("payload"), F.max("version").alias("version"))


def agent_override(override: Column, default: Column) -> Column:
    """Per-agent setting, falling back to the default when empty."""
    return F.coalesce(F.nullif(override, F.lit("")), default)


def state_fold_scalars(updates: DataFrame, run: str, turn: str, fields) -> DataFrame:
    """L12 scalars: last non-null value per field in turn order."""
    aggs = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(turn))).alias(f) for f in fields]
    return updates.groupBy(run).agg(*aggs)


def state_fold_lists(items: DataFrame, run: str, turn: str, pos: str, item: str) -> DataFrame:
    """L12 lists: append-dedup = each item once, at its first (turn, position)."""
    return items.groupBy(run, item).agg(F.min(F.struct(turn, pos)).alias("first")).select(
        run, item, F.col(f"first.{turn}").alias("first_turn"), F.col(f"first.{pos}").alias("first_pos"))


def action_hash(actions: Column) -> Column:
    """First 16 hex digits of SHA-256 of the canonical action list."""
    return F.substring(F.sha2(F.to_json(actions), 256), 1, 16)


def stall_detect(events: DataFrame, run: str, order: str, hash_col: str, repeat: int = 3, grace: int = 3,
                 width: int = 4096) -> DataFrame:
    """First turn where ``repeat`` identical consecutive hashes occur, and the stop turn.

    Gaps-and-islands in order-preserving blocks of each run (see ``ordered``):
    pass 1 aggregates every block to (rows, last hash) and gives each block its
    row offset and the previous block's last hash; inside a block the turn
    number and the previous hash come from a window over that block only.
    Pass 2 does the same for the change flags to number the islands. The
    position inside an island comes from the island's first turn. The warning
    fires at position ``repeat``; the run stops ``grace`` turns later.
    """
    blk = F.floor(F.col(order) / F.lit(width)).cast("long")
    d = events.select(run, order, hash_col).withColumn("__blk", blk)
    per = d.groupBy(run, "__blk").agg(F.count(F.lit(1)).alias("__n"), F.max_by(hash_col, F.struct(order)).alias("__last"))
    wb = Window.partitionBy(run).orderBy("__blk")
    per = per.select(run, "__blk", F.coalesce(F.sum("__n").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
                     F.lag("__last").over(wb).alias("__pblk"))
    w = Window.partitionBy(run, "__blk").orderBy(order)
    e = join_per_key(d, per, [run, "__blk"])
    e = e.select(run, order, hash_col, "__blk", (F.row_number().over(w) + F.col("__off")).alias("turn"),
                 F.when(F.row_number().over(w) == 1, F.col("__pblk")).otherwise(F.lag(hash_col).over(w)).alias("__prev"))
    e = e.withColumn("chg", F.when(F.col("__prev") == F.col(hash_col), 0).otherwise(1))
    sums = e.groupBy(run, "__blk").agg(F.sum("chg").alias("__c"))
    sums = sums.select(run, "__blk", F.coalesce(F.sum("__c").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__coff"))
    e = join_per_key(e, sums, [run, "__blk"]).withColumn(
        "island", F.sum("chg").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__coff"))
    start = e.groupBy(run, "island").agg(F.min("turn").alias("__start"))
    e = join_per_key(e, start, [run, "island"]).withColumn("k", F.col("turn") - F.col("__start") + 1)
    warn = e.where(F.col("k") == repeat).groupBy(run).agg(F.min("turn").alias("warn_turn"))
    return warn.withColumn("stop_turn", F.col("warn_turn") + grace)


def files_touched(events: DataFrame, run: str, seq: str, file: str) -> DataFrame:
    """Distinct files with their first-touch sequence number (order is that column)."""
    return events.groupBy(run, file).agg(F.min(seq).alias("first_seq"))


def termination_reason(candidates: DataFrame, run: str) -> DataFrame:
    """The earliest end event per run (``candidates(run, turn, reason)``)."""
    return candidates.groupBy(run).agg(F.min_by("reason", F.struct("turn", "reason")).alias("reason"),
                                       F.min("turn").alias("end_turn"))
