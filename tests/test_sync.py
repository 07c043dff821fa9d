"""The composed sync on small walks: retries, gates, children that shrink, and attempts that are lost half-way."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import publish, sync

DAY = datetime(2026, 9, 1, 6)
RECORDS = "slice string, pass int, pos int, raw string"


def records(spark, *rows):
    """(slice, pos, id, grapes) of one pass."""
    return spark.createDataFrame([(s, 1, n, json.dumps({"productId": i, "productNameBold": f"wine {i}", "grapes": g})) for s, n, i, g in rows], RECORDS)


def slices(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "slice string")


def expected(spark, **counts):
    return spark.createDataFrame(list(counts.items()), "slice string, expected long")


@pytest.fixture
def lookup(spark):
    return spark.createDataFrame([("Shiraz", "Syrah")], "name string, canonical string")


def whole(spark, **more):
    rows = [("Vin", 0, "1", ["Shiraz", "Merlot"]), ("Vin", 1, "2", []), ("Vin", 2, "3", ["Cot"]), ("Beer", 0, "4", []), ("Beer", 1, "1", ["Shiraz", "Merlot"])]
    return sync.Walk(records(spark, *rows), expected(spark, Vin=3, Beer=2), **more)


def served(spark, root, table="product"):
    return sorted(r.product_id for r in publish.live(spark, root).table(table).collect())


def test_broken_slices_recover_on_retry(spark, tmp_path, lookup):
    root = str(tmp_path)
    walk = sync.Walk(records(spark, ("Vin", 0, "1", []), ("Vin", 1, "2", []), ("Beer", 0, "4", [])), expected(spark, Vin=2, Beer=2),
                     retried=records(spark, ("Beer", 0, "4", []), ("Beer", 1, "5", [])), failed=slices(spark, "Beer"))
    run = sync.sync(root, 1, DAY, walk, lookup, minimum=1).first()
    assert (run.products, run.slices, run.errors, run.note, run.publish, run.number) == (4, 2, 0, None, True, 1)
    assert served(spark, root) == ["1", "2", "4", "5"]


def test_failed_runs_neither_prune_nor_publish(spark, tmp_path, lookup):
    root = str(tmp_path)
    ids = spark.createDataFrame([("1",), ("3",)], "product_id string")
    sites = spark.createDataFrame([(1001,)], "site_id long")
    carried = spark.createDataFrame([(1001, "1"), (1001, "3")], "site_id long, product_id string")
    sync.sync(root, 1, DAY, whole(spark, flags={"is_vegan": ids}, sites=sites, assortment=carried), lookup, minimum=1)
    assert served(spark, root) == ["1", "2", "3", "4"] and served(spark, root, "grape") == ["1", "1", "3"]

    # A slice breaks twice: what was read of it is kept with the run, readers stay with the old version.
    broken = sync.Walk(records(spark, ("Vin", 0, "9", []), ("Beer", 0, "4", []), ("Beer", 1, "1", [])), expected(spark, Vin=3, Beer=2),
                       failed=slices(spark, "Vin"), failed_again=slices(spark, "Vin"))
    run = sync.sync(root, 2, DAY + timedelta(days=1), broken, lookup, minimum=1).first()
    assert (run.errors, run.slices, run.pruned, run.publish, run.reason, run.number) == (1, 2, 0, False, "1 failures", 1)
    assert served(spark, root) == ["1", "2", "3", "4"]

    # A slice not wholly covered, and one that brought nothing: published, but nothing is pruned.
    short = sync.Walk(records(spark, ("Vin", 0, "1", ["Merlot"])), expected(spark, Vin=3, Beer=2))
    run = sync.sync(root, 3, DAY + timedelta(days=2), short, lookup, minimum=1).first()
    assert (run.note, run.pruned, run.publish, run.number) == ("2 slices incompletely covered", 0, True, 2)
    assert served(spark, root) == ["1", "2", "3", "4"] and served(spark, root, "grape") == ["1", "3"]

    # A whole walk without 3: it goes with its grape and its listing; flags that were not asked for survive.
    last = sync.Walk(records(spark, ("Vin", 0, "1", ["Merlot"]), ("Vin", 1, "2", [])), expected(spark, Vin=2))
    run = sync.sync(root, 4, DAY + timedelta(days=3), last, lookup, minimum=1).first()
    assert (run.pruned, run.publish, run.number) == (2, True, 3)
    assert (served(spark, root), served(spark, root, "grape"), served(spark, root, "store_product")) == (["1", "2"], ["1"], ["1"])
    assert {r.product_id: r.is_vegan for r in publish.live(spark, root).table("product").collect()} == {"1": True, "2": False}
    assert [r.run_id for r in sync.runs(spark, root).orderBy("run_id").collect()] == [1, 2, 3, 4]


def test_other_failures_subsets_and_the_gate(spark, tmp_path, lookup):
    root = str(tmp_path)
    few = sync.sync(root, 1, DAY, whole(spark), lookup, minimum=5).first()
    assert (few.publish, few.reason, few.number, publish.live(spark, root)) == (False, "too few products", None, None)
    sync.sync(root, 2, DAY, whole(spark), lookup, minimum=1)
    flag_failed = whole(spark, failures=spark.createDataFrame([("is_vegan",)], "what string"))
    assert sync.sync(root, 3, DAY, flag_failed, lookup, minimum=1).first().publish is False
    only = sync.Walk(records(spark, ("Vin", 0, "1", [])), expected(spark, Vin=1))
    run = sync.sync(root, 4, DAY + timedelta(days=1), only, lookup, minimum=1, subset=True).first()
    assert (run.pruned, run.publish) == (0, True) and served(spark, root) == ["1", "2", "3", "4"]


def test_an_empty_walk_changes_no_reader(spark, tmp_path, lookup):
    root = str(tmp_path)
    sync.sync(root, 1, DAY, whole(spark), lookup, minimum=1)
    empty = sync.Walk(spark.createDataFrame([], RECORDS), expected(spark, Vin=3))
    run = sync.sync(root, 2, DAY + timedelta(days=1), empty, lookup, minimum=1).first()
    assert (run.products, run.note, run.pruned) == (0, "1 slices incompletely covered", 0)
    assert served(spark, root) == ["1", "2", "3", "4"]


def test_a_lost_run_goes_on_where_it_stopped(spark, tmp_path, lookup):
    root = str(tmp_path)
    sync.sync(root, 1, DAY, whole(spark), lookup, minimum=1)
    later = DAY + timedelta(days=1)
    breaks = spark.range(1).select(F.lit(1001).cast("long").alias("site_id"), F.raise_error(F.lit("lost")).cast("string").alias("product_id"))
    with pytest.raises(Exception, match="lost"):
        sync.sync(root, 2, later, whole(spark, assortment=breaks), lookup, minimum=1)
    assert publish.live(spark, root).number == 1 and sync.runs(spark, root).count() == 1
    # The second attempt reads what the first one wrote: its own records are not looked at any more.
    other = sync.Walk(records(spark, ("Vin", 0, "77", [])), expected(spark, Vin=3, Beer=2),
                      assortment=spark.createDataFrame([(1001, "2")], "site_id long, product_id string"))
    run = sync.sync(root, 2, later + timedelta(hours=1), other, lookup, minimum=1).first()
    assert (run.products, run.publish, run.number, run.started_at) == (4, True, 2, later)
    assert served(spark, root) == ["1", "2", "3", "4"] and served(spark, root, "store_product") == ["2"]
    # A run that has ended is not done again.
    assert sync.sync(root, 2, later, other, lookup, minimum=1).first() == run and publish.live(spark, root).number == 2


def test_lost_between_the_version_and_the_run_log(spark, tmp_path, lookup):
    root = str(tmp_path)
    sync.sync(root, 1, DAY, whole(spark), lookup, minimum=1)
    folder = publish.live(spark, root).folder
    again = publish.release(spark, root, folder, minimum=1).first()
    assert (again.publish, again.number, again.products, again.live) == (True, 1, 4, 0)
    assert publish.published(spark, root).count() == 1


def test_records_are_parsed_once_and_expectations_worked_out_once(spark, tmp_path, lookup):
    root = str(tmp_path)
    plan = sync._records(whole(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    breaks = spark.range(1).select(F.lit(1001).cast("long").alias("site_id"), F.raise_error(F.lit("lost")).cast("string").alias("product_id"))
    with pytest.raises(Exception, match="lost"):
        sync.sync(root, 1, DAY, whole(spark, assortment=breaks), lookup, minimum=1)
    gone = spark.createDataFrame([("Vin", 3)], "slice string, expected long").filter(F.raise_error(F.concat(F.lit("read again "), "slice")).isNull())
    walk = sync.Walk(records(spark, ("Vin", 0, "1", [])), gone)
    run = sync.sync(root, 1, DAY, walk, lookup, minimum=1).first()
    assert (run.products, run.slices, run.publish) == (4, 2, True)


def test_ids_are_read_once_and_slices_meet_expectations_once(spark, tmp_path, lookup):
    """A walk has many records for each product and slice: of none is the id read twice, or the slice sorted for the join."""
    found = whole(spark)
    records_ = sync._records(found)
    assert records_._jdf.queryExecution().optimizedPlan().toString().count("$.productId, StringType") == 1
    audited = sync._audit(records_, found.expected, found)
    lines = audited._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    anti = next(n for n, line in enumerate(lines) if "Join LeftAnti" in line)
    right = [lines[n] for n in range(anti + 1, len(lines)) if depth[n] == depth[anti] + 3][1]
    assert "Aggregate [slice#" in right
    assert {(r.slice, r.rows, r.unique_ids, r.complete) for r in audited.collect()} == {("Vin", 3, 3, True), ("Beer", 2, 2, True)}
    # Of several records the first sweep's, then the first by slice, pass and place is kept, whatever the others say.
    again = sync.Walk(records(spark, ("B", 0, "1", ["late"]), ("A", 5, "1", ["first"]), ("A", 7, "1", [])), expected(spark, A=1, B=1),
                      retried=records(spark, ("A", 0, "1", ["retried"]), ("A", 1, "2", ["only"]), ("A", 2, " ", [])))
    rows = sync._rows(sync._records(again), DAY)
    assert {r.product_id: r.grapes for r in rows.collect()} == {"1": ["first"], "2": ["only"]}
