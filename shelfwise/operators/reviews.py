"""Critics' reviews of cellar wines, as batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise import spec
from shelfwise.functions import cellar as rules
from shelfwise.operators.commands import block_of, first_problem, given, mistyped, value_of
from shelfwise.operators.running import numbered
from shelfwise.sources.scratch import staged

KEYS = ["cellar_id", "wine_id"]
REVIEW_COLUMNS = ("cellar_id", "review_id", "wine_id", *spec.REVIEW_FIELDS, "recorded_on")


def _given_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def review_problems(of: Callable[[str], Column] = F.col) -> list[tuple[str, Column]]:
    """A review has to say something, and its numbers have to fit. ``of`` gives the column of a field."""
    return [
        ("needs a score, an award or a summary",
         of("score").isNull() & ~_given_text(of("award")) & ~_given_text(of("summary"))),
        ("score above its scale", F.coalesce(of("score") > of("scale"), F.lit(False))),
        ("window runs backwards", F.coalesce(of("drink_from") > of("drink_until"), F.lit(False))),
        ("invalid date", ~rules.valid_partial_date(of("tasted_on"))),
    ]


def review_violations(reviews: DataFrame) -> DataFrame:
    """(cellar_id, review_id, reasons) for reviews breaking a rule."""
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for text, cond in review_problems()]))
    return reviews.select("cellar_id", "review_id", reasons.alias("reasons")).filter(F.size("reasons") > 0)


@dataclass(frozen=True)
class Reviewed:
    """The reviews after a batch, the wines with their checked dates, and refused commands."""

    reviews: DataFrame
    wines: DataFrame
    rejects: DataFrame


def _mark(wines: DataFrame, ids: DataFrame, today: date) -> DataFrame:
    seen = ids.select(F.col("cellar_id").alias("c_cellar"), F.col("wine_id").alias("c_wine")).distinct()
    joined = wines.join(seen, (F.col("cellar_id") == F.col("c_cellar")) & (F.col("wine_id") == F.col("c_wine")), "left")
    return joined.select(*[
        F.when(F.col("c_wine").isNotNull(), F.lit(today.isoformat())).otherwise(F.col(c)).alias(c)
        if c == "reviews_checked_on" else F.col(c) for c in wines.columns])


def upsert_reviews(batch: DataFrame, reviews: DataFrame, wines: DataFrame, today: date) -> Reviewed:
    """Record reviews. ``batch``: cellar_id, wine_id, seq and the review fields.

    The same critic (ignoring case) and tasting date of a wine replaces what was
    recorded and keeps its id. A scored review without a scale is out of 100.
    """
    scaled = batch.withColumn("scale", F.when(F.col("score").isNotNull(), F.coalesce("scale", F.lit(100.0))))
    known = wines.select(F.col("cellar_id").alias("w_cellar"), F.col("wine_id").alias("w_id"))
    judged = scaled.join(known, (F.col("cellar_id") == F.col("w_cellar")) & (F.col("wine_id") == F.col("w_id")), "left")
    reason = first_problem([
        ("no such wine", F.col("w_id").isNull()),
        ("needs a critic", ~_given_text(F.col("critic"))),
        ("unknown release", ~F.coalesce(F.col("release").isin(*spec.REVIEW_RELEASES), F.lit(False))),
        ("unknown source", ~F.coalesce(F.col("seen").isin(*spec.REVIEW_SEEN), F.lit(False))),
        *review_problems(),
    ])
    judged = judged.withColumn("reason", reason)
    rejects = judged.filter(F.col("reason").isNotNull()).select(*KEYS, "seq", "reason")
    good = judged.filter(F.col("reason").isNull())

    keyed = good.withColumn("_critic", F.lower("critic"))
    group = [*KEYS, "_critic", "tasted_on"]
    values = [f for f in spec.REVIEW_FIELDS if f != "tasted_on"]
    latest = keyed.groupBy(*group).agg(F.max_by(F.struct(*values), "seq").alias("_row"), F.min("seq").alias("_seq"))
    current = reviews.groupBy(
        F.col("cellar_id").alias("r_cellar"), F.col("wine_id").alias("r_wine"), F.lower("critic").alias("r_critic"),
        F.col("tasted_on").alias("r_tasted")).agg(F.min("review_id").alias("r_id"))
    matched = latest.join(current, (F.col("cellar_id") == F.col("r_cellar")) & (F.col("wine_id") == F.col("r_wine"))
                          & (F.col("_critic") == F.col("r_critic")) & F.col("tasted_on").eqNullSafe(F.col("r_tasted")),
                          "left")
    new = numbered(matched.filter(F.col("r_id").isNull()).withColumn("_block", block_of("_seq")),
                   ["cellar_id"], "_block", ["_seq"], "_nth")
    highest = reviews.groupBy(F.col("cellar_id").alias("x_cellar")).agg(F.max("review_id").alias("_max"))
    new = new.join(highest, F.col("cellar_id") == F.col("x_cellar"), "left").withColumn(
        "review_id", F.coalesce("_max", F.lit(0)) + F.col("_nth"))
    replaced = matched.filter(F.col("r_id").isNotNull()).withColumn("review_id", F.col("r_id"))

    def rows(df: DataFrame) -> DataFrame:
        cols = [F.col("tasted_on") if f == "tasted_on" else F.col(f"_row.{f}").alias(f) for f in spec.REVIEW_FIELDS]
        return df.select("cellar_id", F.col("review_id").cast("bigint").alias("review_id"), "wine_id", *cols,
                         F.lit(today.isoformat()).alias("recorded_on")).select(*reviews.columns)

    gone = replaced.select("cellar_id", "review_id")
    kept = reviews.join(gone, ["cellar_id", "review_id"], "left_anti")
    after = kept.unionByName(rows(replaced)).unionByName(rows(new))
    return Reviewed(after, _mark(wines, good, today), rejects)


#: Patches of one review that are folded in one array.
PATCH_BLOCK = 1000


def patch_reviews(patches: DataFrame, reviews: DataFrame, today: date) -> tuple[DataFrame, DataFrame]:
    """Correct reviews; ``patches``: cellar_id, review_id, seq, fields. Returns (reviews, rejects).

    An absent key keeps, NULL clears; critic, release and seen cannot be cleared;
    without a score there is no scale. Patches of one review are judged in the
    order of seq, each against what the accepted ones before it made; a refused
    one changes nothing and is reported by its own seq.
    """
    cannot = [(f"{f} cannot be cleared", given(f) & ~_given_text(value_of(f, "string")))
              for f in ("critic", "release", "seen")]
    known = reviews.select(F.col("cellar_id").alias("k_cellar"), F.col("review_id").alias("k_id"))
    judged = patches.join(known, (F.col("cellar_id") == F.col("k_cellar")) & (F.col("review_id") == F.col("k_id")),
                          "left").withColumn("reason", first_problem([("no such review", F.col("k_id").isNull()),
                                                                      ("not a number", mistyped(spec.REVIEW_FIELDS)), *cannot]))
    refused = judged.filter(F.col("reason").isNotNull()).select("cellar_id", "review_id", "seq", "reason")
    given_values = F.struct("seq", *[F.when(given(f), F.struct(value_of(f, k).alias("v"))).alias(f) for f, k in spec.REVIEW_FIELDS.items()])
    left = judged.filter(F.col("reason").isNull()).select("cellar_id", "review_id", "seq", given_values.alias("patch"))
    counted = numbered(left.withColumn("_block", block_of("seq")), ["cellar_id", "review_id"], "_block", ["seq"], "_nth")
    rounds = staged(counted.select("cellar_id", "review_id", "patch", F.floor((F.col("_nth") - 1) / PATCH_BLOCK).alias("_round")), "review-patches")
    # One round, unless a review has more than PATCH_BLOCK patches.
    last = rounds.agg(F.max("_round")).first()[0]
    for i in range(0 if last is None else last + 1):
        folded = _fold_patches(reviews, rounds.filter(F.col("_round") == i), today)
        folded = folded if i == last else staged(folded, "reviews")
        refused = refused.unionByName(folded.select("cellar_id", "review_id", F.explode("_rejects").alias("_r")).select(
            "cellar_id", "review_id", "_r.seq", "_r.reason"))
        reviews = folded.drop("_rejects")
    return reviews, refused


def _fold_patches(reviews: DataFrame, patches: DataFrame, today: date) -> DataFrame:
    """``reviews`` after their patches, with _rejects (seq, reason)."""
    lists = patches.groupBy("cellar_id", "review_id").agg(F.array_sort(F.collect_list("patch"), lambda a, b: F.when(
        a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("_list"))
    start = F.struct(F.struct(*[F.col(f).cast(k).alias(f) for f, k in spec.REVIEW_FIELDS.items()]).alias("row"), F.lit(False).alias("changed"),
                     F.array().cast("array<struct<seq:bigint,reason:string>>").alias("rejects"))

    def step(state: Column, patch: Column) -> Column:
        values = {f: F.when(patch[f].isNotNull(), patch[f]["v"]).otherwise(state["row"][f]) for f in spec.REVIEW_FIELDS}
        values["scale"] = F.when(values["score"].isNotNull(), F.coalesce(values["scale"], F.lit(100.0)))
        reason = first_problem(review_problems(values.__getitem__))
        row = F.struct(*[values[f].alias(f) for f in spec.REVIEW_FIELDS])
        reject = F.array(F.struct(patch["seq"].cast("bigint").alias("seq"), reason.alias("reason")))
        return F.when(reason.isNull(), F.struct(row.alias("row"), F.lit(True).alias("changed"), state["rejects"].alias("rejects"))).otherwise(
            F.struct(state["row"].alias("row"), state["changed"].alias("changed"), F.concat(state["rejects"], reject).alias("rejects")))

    end = F.aggregate(F.coalesce("_list", F.array().cast(lists.schema["_list"].dataType)), start, step)
    folded = reviews.join(lists, ["cellar_id", "review_id"], "left").withColumn("_end", end)
    columns = [F.col(f"_end.row.{c}").alias(c) if c in spec.REVIEW_FIELDS
               else F.when(F.col("_end.changed"), F.lit(today.isoformat())).otherwise(F.col(c)).alias(c) if c == "recorded_on"
               else F.col(c) for c in reviews.columns]
    return folded.select(*columns, F.col("_end.rejects").alias("_rejects"))


def delete_reviews(reviews: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the reviews of the given (cellar_id, review_id)."""
    return reviews.join(ids.select("cellar_id", "review_id").distinct(), ["cellar_id", "review_id"], "left_anti")


def mark_checked(wines: DataFrame, ids: DataFrame, today: date) -> DataFrame:
    """Wines looked up and found unreviewed leave the queue."""
    return _mark(wines, ids, today)


def reviews_of(reviews: DataFrame, wines: DataFrame | None = None) -> DataFrame:
    """Reviews by wine: newest tasting first, undated last, then by id."""
    out = reviews if wines is None else reviews.join(wines.select(*KEYS).distinct(), KEYS, "left_semi")
    return out.orderBy(*KEYS, F.col("tasted_on").desc_nulls_last(), F.col("review_id").asc())
