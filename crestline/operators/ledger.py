"""Settlement of planned work: one outcome for each cell, merges of checkpoints, edit logs, fences, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def settlement(plan: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """plan(keys, cell) against outcomes(keys, cell, outcome): settled, missing, repeated and unplanned cells."""
    per = outcomes.groupBy(*keys, "cell").agg(F.count("*").alias("n"), F.min("outcome").alias("outcome"))
    both = plan.select(*keys, "cell", F.lit(1).alias("planned")).join(per, [*keys, "cell"], "full_outer")
    n = F.coalesce("n", F.lit(0))
    return both.groupBy(*keys).agg(
        F.count("planned").alias("n_planned"), F.count_if(F.col("planned").isNotNull() & (n == 1)).alias("n_settled"), F.count_if(F.col("planned").isNotNull() & (n == 0)).alias("n_missing"), F.count_if(n > 1).alias("n_repeated"),
        F.count_if(F.col("planned").isNull()).alias("n_unplanned"), F.count_if(F.col("outcome") == "gap").alias("n_gaps"),
    ).withColumn("settled", (F.col("n_missing") == 0) & (F.col("n_repeated") == 0) & (F.col("n_unplanned") == 0) & (F.col("n_gaps") == 0))


def merge_checkpoints(current: DataFrame, pending: DataFrame, keys: list[str]) -> DataFrame:
    """One settlement for each cell of two checkpoints(keys, outcome, attempt, rank): the current one unless it is a
    gap, then the pending one unless it is a gap, then the higher attempt, then the safer rank."""
    both = current.withColumn("side", F.lit("current")).unionByName(pending.withColumn("side", F.lit("pending")))
    order = W.partitionBy(*keys).orderBy((F.col("outcome") == "gap").cast("int"), F.when(F.col("outcome") == "gap", F.lit(0)).otherwise((F.col("side") == "pending").cast("int")), F.desc("attempt"), "rank", "side")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def status_summary(units: DataFrame, keys: list[str], statuses: tuple[str, ...], done: str) -> DataFrame:
    """Units of each status in fixed order, and whether all required ones are done."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses]
    complete = F.count_if(F.col("required") & (F.col("status") == done)) == F.count_if("required")
    return units.groupBy(*keys).agg(*counts, complete.alias("complete"))


def resumable(units: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Units that are not finished yet; a replay finds nothing twice."""
    return units.join(finished.select(*keys).distinct(), keys, "left_anti")


def replay_edits(edits: DataFrame) -> DataFrame:
    """Edits(item, seq, expected_revision, start_ms, end_ms) folded in order: one that expects another revision than
    the current is refused. The log of an item is bounded; it is folded as an array."""
    logs = edits.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("seq", "expected_revision", "start_ms", "end_ms"))).alias("log"))
    zero = F.struct(F.lit(0).cast("bigint").alias("revision"), F.lit(0).cast("bigint").alias("refused"), F.lit(None).cast("bigint").alias("start_ms"), F.lit(None).cast("bigint").alias("end_ms"))
    step = lambda s, e: F.when(
        s["revision"] == e["expected_revision"], F.struct((s["revision"] + 1).alias("revision"), s["refused"].alias("refused"), e["start_ms"].alias("start_ms"), e["end_ms"].alias("end_ms"))
    ).otherwise(F.struct(s["revision"].alias("revision"), (s["refused"] + 1).alias("refused"), s["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms")))
    return logs.select("item", F.aggregate("log", zero, step).alias("s")).select("item", "s.*")


def fence_events(events: DataFrame, fence: DataFrame) -> DataFrame:
    """Events(event_id, session_id, epoch, task_id) with the reason why the fence(session_id, epoch) refuses them."""
    first = F.row_number().over(W.partitionBy("event_id").orderBy("seq")) == 1
    held = events.withColumn("_first", first).join(fence.withColumnRenamed("epoch", "fence_epoch").withColumn("_known", F.lit(True)), "session_id", "left")
    reason = F.when(F.col("_known").isNull(), "session").when(F.col("epoch") < F.col("fence_epoch"), "stale-epoch").when(F.col("epoch") > F.col("fence_epoch"), "future-epoch").when(~F.col("_first"), "repeat").otherwise("accepted")
    return held.withColumn("verdict", reason).drop("_first", "_known", "fence_epoch")


def apply_proposals(rows: DataFrame, proposals: DataFrame, fields: list[str]) -> DataFrame:
    """Proposed values for fields that the user has not taken over (owner 'user'), with a mark for those held back."""
    renamed = proposals.withColumnsRenamed({f: f"p_{f}" for f in fields})
    both = rows.join(renamed, "id", "left")
    held = F.lit(0)
    for f in fields:
        proposed = F.col(f"p_{f}").isNotNull() & ~F.col(f"p_{f}").eqNullSafe(F.col(f))
        held = held + (proposed & (F.col("owner") == "user")).cast("int")
        both = both.withColumn(f"_{f}", F.when(proposed & (F.col("owner") != "user"), F.col(f"p_{f}")).otherwise(F.col(f)))
    both = both.withColumn("n_held", held)
    return both.drop(*fields, *(f"p_{f}" for f in fields)).withColumnsRenamed({f"_{f}": f for f in fields})


def upsert_bindings(bindings: DataFrame, keys: list[str], owner: str, most: int = 256) -> DataFrame:
    """Latest binding of each key, the newest ``most`` of each owner."""
    latest = bindings.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("at"), F.desc("value")))).where("_n = 1").drop("_n")
    return latest.withColumn("place", F.row_number().over(W.partitionBy(owner).orderBy(F.desc("at"), *keys))).where(F.col("place") <= most)


def due_reasons(lanes: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Union of lanes of due ids, with the sorted list of the lanes of each."""
    every = None
    for name, df in lanes:
        one = df.select(key, F.lit(name).alias("reason"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("reason")), "+").alias("reasons"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def qualify(candidates: DataFrame, annotations: DataFrame) -> DataFrame:
    """Candidates by the decision of their annotation: selected, review, rejected or missing."""
    verdict = F.when(F.col("decision") == "select", "selected").when(F.col("decision") == "review", "review").when(F.col("decision") == "reject", "rejected").otherwise("missing")
    return candidates.join(annotations, "id", "left").withColumn("verdict", verdict)


def stage_report(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Time since the mark before, and its share of the whole, for marks(keys, seq, at_ms)."""
    order = W.partitionBy(*keys).orderBy("seq")
    timed = marks.withColumn("elapsed_ms", F.col("at_ms") - F.coalesce(F.lag("at_ms").over(order), F.col("at_ms")))
    total = F.sum("elapsed_ms").over(W.partitionBy(*keys))
    return timed.withColumn("share", F.when(total > 0, F.col("elapsed_ms") / total).otherwise(0.0))


def effective(preferred: Column, fallback: Column, valid: Column) -> Column:
    return F.when(valid, preferred).otherwise(fallback)
