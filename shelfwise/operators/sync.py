"""One sync, from the records of a walk to a published version, in steps that a lost job takes up where it stopped.

Every step writes one table below ``root/runs/<run id>`` and then its name to the run's log. A run that
is started again reads the steps that are named there and does the others; what a lost attempt
left of an unnamed step is overwritten. A run starts from the version that was live when it first began, so
neither a second attempt nor a run that was refused changes what it builds on.

    records -> rows -> merged -> version/product, version/grape, ... -> published -> run
            -> audit, failures -> gate ---^

Stale products go only after a run in which every slice was walked, and covered; a version
is published only after a run without failures, if the publish gate lets it pass. One run at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise import spec
from shelfwise.functions import typed
from shelfwise.operators import audit, merge, normalise, publish
from shelfwise.sources.scratch import compiled_in_pieces

CHILDREN = ("grape", "pairing", "store_product")
ORDER = ("slice", "pass", "pos")


@dataclass(frozen=True)
class Walk:
    """What an extraction brought.

    ``first`` and ``retried``: slice, pass, pos and raw record of the first sweep and of the slices that were
    walked once more. A slice in ``failed`` broke off in the first sweep, one in ``failed_again`` in the second too; what was read
    of them before counts as seen, not as covered. ``expected``: slice, expected. ``flags``: the ids that
    a flag column holds for. ``sites`` (site_id) were asked for their ``assortment`` (site_id, product_id). ``failures``
    (what) names anything else that failed.
    """

    first: DataFrame
    expected: DataFrame
    retried: DataFrame | None = None
    failed: DataFrame | None = None
    failed_again: DataFrame | None = None
    flags: dict[str, DataFrame] = field(default_factory=dict)
    sites: DataFrame | None = None
    assortment: DataFrame | None = None
    failures: DataFrame | None = None


class Steps:
    """The steps of one run, each done once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._log = spark, folder, f"{folder}/log"
        spark.createDataFrame([], "step string").write.mode("ignore").parquet(self._log)
        self.done = {r.step for r in spark.read.schema("step string").parquet(self._log).collect()}

    def table(self, step: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{step}"
        if step not in self.done:
            with compiled_in_pieces(self.spark):
                make().write.mode("overwrite").parquet(path)
            self.spark.range(0, 1, 1, 1).select(F.lit(step).alias("step")).write.mode("append").parquet(self._log)
            self.done.add(step)
        return self.spark.read.parquet(path)


def _records(walk: Walk) -> DataFrame:
    """The records of both sweeps with their ids; nothing else is parsed, since most may be seen again and again."""
    both = walk.first.select(*ORDER, "raw", F.lit(0).alias("sweep"))
    if walk.retried is not None:
        both = both.unionByName(walk.retried.select(*ORDER, "raw", F.lit(1).alias("sweep")))
    # A generated column like the parsed text: as a plain one the id is read twice, for the filter and for the row.
    product_id = F.explode(F.array(typed.text(F.col("_v"), "productId")))
    named = normalise.parsed_once(both, "raw").select(*ORDER, "sweep", "raw", product_id.alias("product_id"))
    return named.filter(F.col("product_id") != "")


def _rows(records: DataFrame, started_at: datetime) -> DataFrame:
    """Each product once, typed: the first sweep before the second, then by slice, pass and place."""
    once = records.groupBy("product_id").agg(F.min_by("raw", F.struct("sweep", *ORDER)).alias("raw"))
    return normalise.normalise(once.select("raw", F.lit(started_at).alias("synced_at")))


def _audit(records: DataFrame, expected: DataFrame, walk: Walk) -> DataFrame:
    """Coverage of every slice that was walked to its end; one that brought nothing is not covered."""
    ended = [(0, walk.failed), (1, walk.failed_again)]
    walked, planned = records.select(*ORDER, "sweep", "product_id"), expected
    for sweep, broken in ended:
        if broken is not None:
            marked = broken.select("slice", F.lit(sweep).alias("sweep")).distinct()
            walked = walked.join(marked, ["slice", "sweep"], "left_anti")
    if walk.failed_again is not None:
        planned = planned.join(walk.failed_again.select("slice"), "slice", "left_anti")
    covered = audit.coverage_audit(walked, planned)
    zero = F.lit(0).cast("bigint")
    silent = planned.join(walked.select("slice").distinct(), "slice", "left_anti").select(
        "slice", "expected", zero.alias("rows"), zero.alias("unique_ids"), zero.alias("passes"), F.lit(False).alias("complete"))
    return covered.unionByName(silent)


def _failures(walk: Walk) -> DataFrame:
    out = walk.expected.sparkSession.createDataFrame([], "what string")
    if walk.failed_again is not None:
        out = out.unionByName(walk.failed_again.select(F.concat(F.lit("slice "), F.col("slice").cast("string")).alias("what")).distinct())
    return out if walk.failures is None else out.unionByName(walk.failures.select("what"))


def _merged(product: DataFrame, rows: DataFrame, flags: dict[str, DataFrame]) -> DataFrame:
    out = merge.upsert_products(product, rows.drop("grapes", "pairings"))
    for column, ids in flags.items():
        out = merge.set_flag(out, column, ids)
    return out


def sync(root: str, run_id: int, started_at: datetime, walk: Walk, synonyms: DataFrame, minimum: int = spec.MIN_PUBLISH_ROWS,
         keep_stale: bool = False, subset: bool = False) -> DataFrame:
    """Merge a walk into the live version, prune and publish as the gates allow; the run's row of ``runs``.

    ``subset`` says that the walk left slices out on purpose: nothing is pruned then. A run that has ended is not done
    again; a second attempt keeps the time of the first.
    """
    spark = walk.first.sparkSession
    steps = Steps(spark, f"{root}/runs/{run_id}")
    live = publish.live(spark, root)
    base = steps.table("base", lambda: spark.createDataFrame(
        [(live and live.number, live and live.folder, started_at)], "number long, folder string, started_at timestamp")).first()
    started_at = base.started_at

    def before(name: str, like: DataFrame | str) -> DataFrame:
        """A table of the version that the run began with."""
        if base.folder:
            return publish.Version(spark, base.number, base.folder).table(name)
        return spark.createDataFrame([], like if isinstance(like, str) else like.schema)

    records = steps.table("records", lambda: _records(walk))
    rows = steps.table("rows", lambda: _rows(records, started_at))
    expected = steps.table("expected", lambda: walk.expected.select("slice", "expected"))  # read three times below
    covered = steps.table("audit", lambda: _audit(records, expected, walk))
    failures = steps.table("failures", lambda: _failures(walk))
    gate = steps.table("gate", lambda: audit.prune_gate(covered, failures, keep_stale, subset)).first()

    merged = steps.table("merged", lambda: _merged(before("product", rows.drop("grapes", "pairings")), rows, walk.flags))
    grape, pairing = normalise.grape_children(rows, synonyms), normalise.pairing_children(rows)
    store_product = before("store_product", "site_id long, product_id string, synced_at timestamp")
    if walk.assortment is not None:
        store_product = merge.set_store_assortment(store_product, walk.assortment.withColumn("synced_at", F.lit(started_at)), sites=walk.sites)
    children = {"grape": merge.replace_children(before("grape", grape), grape, rows),
                "pairing": merge.replace_children(before("pairing", pairing), pairing, rows), "store_product": store_product}
    pruned = spark.createDataFrame([(0,)], "pruned long")
    product = merged
    if gate.prune:
        product, children, pruned = merge.prune_stale(merged, children, started_at)
    steps.table("version/product", lambda: product)
    for name in CHILDREN:
        steps.table(f"version/{name}", lambda: children[name])

    def published() -> DataFrame:
        if gate.failures:
            refused = (None, None, False, f"{gate.failures} failures", base.number)
            return spark.createDataFrame([refused], publish.VERDICT)
        return publish.release(spark, root, f"{steps.folder}/version", "product", minimum)

    verdict = steps.table("published", published)

    def ended() -> DataFrame:
        row = merge.run_row(run_id, started_at, started_at, rows, covered, failures).drop("snapshot_path")
        last = verdict.first()
        return row.withColumns({
            "finished_at": F.current_timestamp(), "slices": F.lit(expected.count()), "pruned": F.lit(pruned.first().pruned),
            "publish": F.lit(last.publish), "reason": F.lit(last.reason).cast("string"), "number": F.lit(last.number).cast("bigint")})

    return steps.table("run", ended)


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all runs that ended, whether published or not."""
    return spark.read.parquet(f"{root}/runs/*/run")
