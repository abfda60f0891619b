"""Translation batches: outcome counters, run summaries, stress statistics, and the paced run itself."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.session import Written


def outcome_counts(results: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: success, errors, retried, with the errors by type as a map and files a second if the time is given."""
    kinds = results.where(F.col("error_type").isNotNull()).groupBy("error_type").agg(F.count("*").alias("n"))
    errors = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "n")))).alias("errors"))  # a row per type
    out = results.agg(F.count("*").alias("n"), F.count_if("success").alias("n_success"), F.count_if(~F.col("success")).alias("n_failed"), F.count_if(F.col("retries") > 0).alias("n_retried")).crossJoin(errors)
    return out if seconds is None else out.withColumn("per_second", F.col("n_success") / F.lit(float(seconds)))


def error_counts(results: DataFrame) -> DataFrame:
    return results.where(F.col("error_type").isNotNull()).groupBy("error_type").agg(F.count("*").alias("n"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Counts by status; averages are over rows worked on in this run (neither resumed, skipped nor failed)."""
    fresh = F.col("status") == "ok"

    def mean(c: str):
        return F.avg(F.when(fresh, F.col(c))).alias(f"mean_{c}")

    return outcomes.agg(
        F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "resumed", "runtime_error", "skipped")), F.count_if(fresh & (F.col("ast") == "ok")).alias("n_parses"), mean("elapsed_seconds"), mean("input_chars"), mean("output_chars"), F.sum(F.when(fresh, F.col("stripped"))).cast("bigint").alias("n_stripped")
    )


def compare_backends(a: DataFrame, b: DataFrame, key: str = "file_path") -> DataFrame:
    """Two backends side by side: whether outputs match, and which side failed (both_failed only if both did)."""
    one, two = (df.select(key, F.col("output").alias(f"out_{n}"), F.col("error_type").alias(f"err_{n}")) for df, n in ((a, "a"), (b, "b")))
    out = one.join(two, key, "full")
    ea, eb = F.col("err_a").isNotNull() | F.col("out_a").isNull(), F.col("err_b").isNotNull() | F.col("out_b").isNull()
    kind = F.when(ea & eb, "both_failed").when(ea, "a_failed").when(eb, "b_failed")
    return out.withColumns({"error_type": kind, "match": F.when(kind.isNull(), F.col("out_a") == F.col("out_b"))})


def order_statistics(rows: DataFrame, by: list[str], value: str, shares: dict[str, tuple[float, int]], spread: int = 200) -> DataFrame:
    """Exact order statistics sorted[int(share * n)] per group, or the largest if the group has fewer than `least` values;
    shares: name -> (share, least). A mergeable sketch cuts each group into ranges, ranges are counted, and only the
    range that holds the wanted rank is numbered, so no group is sorted in one task."""
    keep = Written(rows.sparkSession)
    values = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    cuts = values.groupBy(*by).agg(F.percentile_approx("_v", [k / spread for k in range(1, spread)], 10 * spread).alias("_cuts"), F.count("*").alias("_n"), F.max("_v").alias("_max"))
    placed = keep(values.join(F.broadcast(keep(cuts, "cuts")), by).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts"), "placed")
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ranges = placed.groupBy(*by, "_b", "_n", "_max").agg(F.count("*").alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.floor(F.col("_n") * F.lit(s)).alias("rank"), F.lit(least).alias("least")) for n, (s, least) in shares.items()))).alias("w")
    hits = ranges.select("*", wanted).where("w.rank >= _before and w.rank < _before + _k").select(*by, "_b", "_before", "w.*")
    inside = placed.join(hits.select(*by, "_b").distinct(), [*by, "_b"], "left_semi").withColumn("_i", F.row_number().over(W.partitionBy(*by, "_b").orderBy("_v")) - 1)
    found = inside.join(hits, [*by, "_b"]).where("_i + _before = rank").select(*by, "name", "least", F.when(F.col("_n") >= F.col("least"), F.col("_v")).otherwise(F.col("_max")).alias("_x"))
    return found.groupBy(*by).pivot("name", list(shares)).agg(F.first("_x"))


TAILS = {"p95": (0.95, 20), "p99": (0.99, 100)}


def timing(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """min, median, mean, p95, p99, max per group."""
    plain = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.median(value).alias("median"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    return plain.join(order_statistics(rows, by, value, TAILS), by, "left")


def stress_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Per backend: successes, silent failures (nothing changed though something could), round trips over all rows, and
    files per second of forward time."""
    ok = F.col("error_type").isNull()
    seconds = F.sum(F.when(ok, F.col("forward_us"))) / 1e6
    return results.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_success"), F.count_if(~ok).alias("n_failed"), F.count_if(ok & F.col("changed")).alias("n_changed"), F.count_if(ok & ~F.col("changed") & (F.col("translatable") > 0)).alias("n_silent"), *(F.count_if(F.col("round_trip") == k).alias(f"n_{k}") for k in ("exact", "mismatch", "error", "skipped")), F.when(seconds > 0, F.count_if(ok) / seconds).otherwise(F.lit(0.0)).alias("per_second")
    )


# -- running a translator ------------------------------------------------------------------------------------------------


def next_slot(now: float, last: float, task: int, tasks: int, gap: float) -> float:
    """The first time from now on, and after the last one, that belongs to a task: times a whole number of gaps after the
    epoch are dealt to the tasks in turn, so calls of different tasks never come closer than the gap, whether a task is
    early, late or run again, and no task waits for another."""
    period, phase = tasks * gap, task * gap
    turn = math.ceil((now - phase) / period)
    if turn * period + phase <= last:
        turn += 1
    return turn * period + phase


def translate(rows: DataFrame, make: Callable[[], Callable[[str], str]], text: str = "code", key: str = "file_path", retries: int = 3, delay: float = 0.0, gap: float = 0.0, retry_on: tuple[type[Exception], ...] = (OSError,), tasks: int | None = None) -> DataFrame:
    """(key, output, error_type, retries, seconds): make() builds a translator once per task; only the given errors are
    tried again; `gap` seconds pass at least between a task's calls. With `tasks`, rows are dealt to so many tasks and the gap
    holds between the calls of all of them (as far as their clocks agree)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, last, me = make(), 0.0, TaskContext.get().partitionId()
        for frame in frames:
            out = []
            for k, source in zip(frame[key], frame[text], strict=True):
                began, tries, error, done = time.monotonic(), 0, None, None
                while True:
                    if gap:
                        now = time.time()
                        due = next_slot(now, last, me, tasks, gap) if tasks else max(now, last + gap)
                        time.sleep(due - now)
                        last = due
                    try:
                        done, error = call(source), None
                        break
                    except retry_on as e:
                        error = type(e).__name__
                        if tries >= retries:
                            break
                        tries += 1
                        time.sleep(delay)
                    except Exception as e:
                        error = type(e).__name__
                        break
                out.append((k, done, error, tries, time.monotonic() - began))
            yield pd.DataFrame(out, columns=[key, "output", "error_type", "retries", "seconds"])

    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.select(key, text).repartition(tasks) if tasks else rows.select(key, text)
    return dealt.mapInPandas(run, f"{key} {kind}, output string, error_type string, retries int, seconds double")


class Budget:
    """Stops a run of micro-batches by cost or wall clock; what was done stays. Resumed work costs nothing and is settled
    before the budget is looked at."""

    OK, COST, CLOCK = 0, 4, 5

    def __init__(self, most_cost: float | None = None, most_seconds: float | None = None, success: float = 0.05, failure: float = 0.025, clock: Callable[[], float] = time.monotonic):
        self.most_cost, self.most_seconds, self.success, self.failure, self.clock = most_cost, most_seconds, success, failure, clock
        self.began, self.cost = clock(), 0.0

    def spend(self, n_success: int, n_failed: int) -> None:
        self.cost += n_success * self.success + n_failed * self.failure

    def verdict(self) -> int:
        if self.most_cost is not None and self.cost >= self.most_cost:
            return self.COST
        if self.most_seconds is not None and self.clock() - self.began >= self.most_seconds:
            return self.CLOCK
        return self.OK


def paced(work: DataFrame, done: DataFrame | None, step: Callable[[DataFrame], DataFrame], batch: Callable[[DataFrame], list[DataFrame]], budget: Budget, key: str = "file_path") -> tuple[list[DataFrame], int]:
    """Runs step on micro-batches of the work that isn't done, until the budget says stop."""
    keep, out = Written(work.sparkSession), []
    left = work if done is None else work.join(done.select(key), key, "left_anti")
    for part in batch(left):
        if code := budget.verdict():
            return out, code
        results = keep(step(part), "batch")
        counts = results.agg(F.count_if(F.col("error_type").isNull()), F.count_if(F.col("error_type").isNotNull())).first()
        budget.spend(*counts)
        out.append(results)
    return out, budget.verdict()
