"""Planning and auditing an extraction, and the gates that depend on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwise import spec


def plan_slices(df: DataFrame, cat1: str = "cat1", cat2: str = "cat2", cap: int = spec.SLICE_CAP) -> DataFrame:
    """Cut a table into slices below ``cap`` rows: (cat1, cat2, expected, over_cap).

    A category under the cap stays whole (cat2 NULL); a larger one is split by
    subcategory. A subcategory still at or over the cap is flagged.
    """
    pairs = df.groupBy(F.col(cat1).alias("cat1"), F.col(cat2).alias("cat2")).agg(F.count(F.lit(1)).alias("n"))
    # The second level is summed from the first: the table is scanned and shuffled once.
    whole = pairs.groupBy("cat1").agg(F.sum("n").alias("total"))
    small = whole.filter(F.col("total") < cap).select(
        "cat1", F.lit(None).cast("string").alias("cat2"), F.col("total").alias("expected"))
    big = whole.filter(F.col("total") >= cap).select(F.col("cat1").alias("_big"))
    split = pairs.join(big, F.col("cat1").eqNullSafe(F.col("_big")), "left_semi").select(
        "cat1", "cat2", F.col("n").alias("expected"))
    both = small.unionByName(split)
    return both.withColumn("over_cap", F.col("cat2").isNotNull() & (F.col("expected") >= cap))


def coverage_audit(walks: DataFrame, expected: DataFrame, slice_col: str = "slice", pass_col: str = "pass",
                   id_col: str = "product_id", zero_is_complete: bool = False) -> DataFrame:
    """How completely each slice was walked: (slice, expected, rows, unique_ids, passes, complete).

    Passes after the stopping one never happened as far as the audit goes: a walk
    ends when the distinct ids reach the expectation, or when a pass added
    nothing new. An id seen in another slice still counts here.

    Aggregated per (slice, id) first, so a slice holding much of the data is
    spread over its ids; the window then runs over one row per pass.
    """
    first = walks.filter(F.col(id_col).isNotNull()).groupBy(slice_col, id_col).agg(F.min(pass_col).alias("_first"))
    fresh = first.groupBy(slice_col, F.col("_first").alias("_pass")).agg(F.count(F.lit(1)).alias("_new"))
    rows = walks.groupBy(slice_col, F.col(pass_col).alias("_pass")).agg(F.count(F.lit(1)).alias("_rows"))
    exp = expected.select(F.col(slice_col).alias("_slice"), F.col("expected"))

    per_pass = rows.join(fresh, [slice_col, "_pass"], "left").join(exp, F.col(slice_col) == F.col("_slice"), "left")
    w = Window.partitionBy(slice_col).orderBy("_pass").rowsBetween(Window.unboundedPreceding, 0)
    running = per_pass.select(
        slice_col, "_pass", F.coalesce("expected", F.lit(0)).alias("expected"), "_rows",
        F.coalesce("_new", F.lit(0)).alias("_new"),
        F.sum(F.coalesce("_new", F.lit(0))).over(w).alias("_unique"),
        F.sum("_rows").over(w).alias("_total"),
        F.row_number().over(w).alias("_nth"),
    )
    reached = (F.col("_unique") >= F.col("expected")) & ((F.col("expected") > 0) | F.lit(zero_is_complete))
    ends = reached | (F.col("_new") == 0)
    # Before or at the first ending pass; the counts grow with the pass, so the
    # largest one kept is the state at the end of the walk.
    before = Window.partitionBy(slice_col).orderBy("_pass").rowsBetween(Window.unboundedPreceding, -1)
    kept = running.withColumn("_ended", F.coalesce(F.max(ends).over(before), F.lit(False))).filter(~F.col("_ended"))
    out = kept.groupBy(slice_col).agg(
        F.max("expected").alias("expected"), F.max("_total").alias("rows"),
        F.max("_unique").alias("unique_ids"), F.max("_nth").cast("bigint").alias("passes"))
    done = (F.col("unique_ids") >= F.col("expected")) & ((F.col("expected") > 0) | F.lit(zero_is_complete))
    return out.withColumn("complete", done)


def prune_gate(audit: DataFrame, failures: DataFrame, skipped: bool = False, subset: bool = False) -> DataFrame:
    """One row: may stale products be pruned after this run?

    ``failures`` lists everything that failed (slices, flag passes, store passes).
    """
    n_incomplete = audit.agg(F.count_if(~F.col("complete")).alias("incomplete"), F.lit("x").alias("_one"))
    n_failures = failures.agg(F.count(F.lit(1)).alias("failures"), F.lit("x").alias("_one"))
    both = n_incomplete.join(n_failures, "_one").select("failures", "incomplete")
    allowed = (F.col("failures") == 0) & (F.col("incomplete") == 0) & F.lit(not skipped and not subset)
    return both.withColumn("prune", allowed)


def publish_gate(new: DataFrame, live: DataFrame | None = None, minimum: int = spec.MIN_PUBLISH_ROWS) -> DataFrame:
    """One row (products, live, publish, reason): refuse an empty or collapsed table."""
    counted = new.agg(F.count(F.lit(1)).alias("products"), F.lit("x").alias("_one"))
    if live is None:
        both = counted.select("products", F.lit(0).cast("bigint").alias("live"))
    else:
        before = live.agg(F.count(F.lit(1)).alias("live"), F.lit("x").alias("_one"))
        both = counted.join(before, "_one").select("products", "live")
    return both.select("products", "live", *gate(F.col("products"), F.col("live"), minimum))


def gate(products: Column, live: Column, minimum: int) -> tuple[Column, Column]:
    few = products < minimum
    collapsed = (live > 0) & (products < F.floor(live / 2))
    reason = F.when(few, F.lit("too few products")).when(collapsed, F.lit("fewer than half of the live products"))
    return (~(few | collapsed)).alias("publish"), reason.alias("reason")
