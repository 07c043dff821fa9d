from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import audit, export, merge, publish, search
from shelfwise.operators.running import numbered, previous_value, running_sum
from shelfwise.sources import tables

NOW = datetime(2026, 9, 1, 12)


def test_upsert_replaces_written_columns_only(spark):
    target = spark.createDataFrame([(1, 200.0, True), (2, 10.0, None)], "product_id INT, price DOUBLE, is_vegan BOOLEAN")
    updates = spark.createDataFrame([(1, 250.0), (3, None)], "product_id INT, price DOUBLE")
    rows = {r.product_id: (r.price, r.is_vegan) for r in merge.upsert_products(target, updates).collect()}
    assert rows == {1: (250.0, True), 2: (10.0, None), 3: (None, None)}


def test_children_can_shrink(spark):
    child = spark.createDataFrame([(1, "Syrah"), (1, "Merlot"), (2, "Cot")], "product_id INT, grape STRING")
    out = merge.replace_children(child, child.filter("grape = 'Merlot'"), spark.createDataFrame([(1,), (9,)], "product_id INT"))
    assert sorted(map(tuple, out.collect())) == [(1, "Merlot"), (2, "Cot")]


def test_flags_are_cleared_and_unknown_refused(spark):
    base = spark.createDataFrame([("1", None, None), ("2", None, None)], "product_id STRING, is_vegan BOOLEAN, is_kosher BOOLEAN")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "product_id STRING")
    once = merge.set_flag(base, "is_vegan", ids("1", "2", "2"))
    twice = {r.product_id: (r.is_vegan, r.is_kosher) for r in merge.set_flag(once, "is_vegan", ids("2")).collect()}
    assert twice == {"1": (False, None), "2": (True, None)}
    with pytest.raises(ValueError, match="unknown flag"):
        merge.set_flag(base, "price", ids("1"))


def test_prune_takes_children_along(spark):
    products = spark.createDataFrame([("1", NOW - timedelta(hours=48)), ("2", NOW)], "product_id STRING, synced_at TIMESTAMP")
    child = spark.createDataFrame([("1", "x"), ("2", "y")], "product_id STRING, v STRING")
    kept, kids, n = merge.prune_stale(products, {"grape": child, "pairing": child, "store_product": child}, NOW - timedelta(hours=1))
    assert [r.product_id for r in kept.collect()] == ["2"] and n.first().pruned == 1
    assert all([r.product_id for r in k.collect()] == ["2"] for k in kids.values())


def _walks(spark, rows):
    return spark.createDataFrame(rows, "slice STRING, pass INT, pos INT, product_id STRING")


def _audit(spark, rows, expected, **kw):
    exp = spark.createDataFrame(expected, "slice STRING, expected BIGINT")
    return {r.slice: (r.rows, r.unique_ids, r.passes, r.complete) for r in audit.coverage_audit(_walks(spark, rows), exp, **kw).collect()}


def test_coverage(spark):
    # Ids another slice stored first still count; repeats do not; short stays short.
    rows = [("a", 1, i, p) for i, p in enumerate("123")] + [("b", 1, 0, "2"), ("b", 1, 1, "3")]
    assert _audit(spark, rows, [("a", 3), ("b", 2)]) == {"a": (3, 3, 1, True), "b": (2, 2, 1, True)}
    two = [("a", 1, 0, "1"), ("a", 1, 1, "2"), ("a", 2, 0, "2"), ("a", 2, 1, "3")]
    assert _audit(spark, two, [("a", 3)]) == {"a": (4, 3, 2, True)}
    assert _audit(spark, two[:2], [("a", 5)]) == {"a": (2, 2, 1, False)}


def test_a_pass_that_adds_nothing_ends_the_walk(spark):
    rows = [("a", 1, 0, "1"), ("a", 2, 0, "1"), ("a", 3, 0, "2")]
    assert _audit(spark, rows, [("a", 2)]) == {"a": (2, 1, 2, False)}
    assert _audit(spark, rows, [("a", 0)]) == {"a": (2, 1, 2, False)}
    assert _audit(spark, rows, [("a", 0)], zero_is_complete=True) == {"a": (1, 1, 1, True)}


def test_refetch_counts_each_product_once(spark):
    first = _walks(spark, [("Vin", 1, i, f"v{i}") for i in range(3)] + [("Cider", 1, 0, "c")])
    again = _walks(spark, [("Öl", 1, i, f"o{i}") for i in range(2)] + [("Sprit", 1, i, f"s{i}") for i in range(2)] + [("Öl", 1, 2, "v1")])
    out = merge.refetch_merge(first, again)
    assert out.count() == 8 and out.filter("product_id = 'v1'").first().slice == "Vin"


def test_gates(spark):
    done = spark.createDataFrame([("a", True)], "slice STRING, complete BOOLEAN")
    none, one = done.limit(0), done
    ok = lambda **kw: audit.prune_gate(kw.pop("audit", done), kw.pop("failures", none), **kw).first().prune
    assert ok() and not ok(failures=one) and not ok(skipped=True) and not ok(subset=True)
    assert not ok(audit=spark.createDataFrame([("a", False)], "slice STRING, complete BOOLEAN"))
    gate = lambda new, live=None: audit.publish_gate(spark.range(new), None if live is None else spark.range(live)).first().publish
    assert (gate(999), gate(1000), gate(1000, 2001), gate(1000, 2002), gate(1500, 0)) == (False, True, True, False, True)


def test_table_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(200).selectExpr("id AS k", "0 AS v")
    tables.write_table(base, path, ["k"], 8)
    before = {p.name: {f.name for f in p.glob("*.parquet")} for p in (tmp_path / "t").glob("bucket=*")}
    merge.upsert_table(path, spark.createDataFrame([(5, 1)], "k BIGINT, v INT"), ["k"], 8)
    after = {p.name: {f.name for f in p.glob("*.parquet")} for p in (tmp_path / "t").glob("bucket=*")}
    assert sum(before[b] != after[b] for b in before) == 1
    back = tables.read_table(spark, path)
    assert back.count() == 200 and back.filter("v = 1").first().k == 5


def test_older_update_is_ignored(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda v, d: spark.createDataFrame([(1, v, d)], "k INT, v INT, ts INT")
    for v, d in ((1, 5), (2, 4), (3, 6), (3, 6)):
        merge.upsert_table(path, row(v, d), ["k"], 4, newest="ts")
    assert tables.read_table(spark, path).first().v == 3


def test_hot_key_running_sums(spark):
    rows = [("hot" if i % 3 else f"k{i}", i, (i * 7) % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "k STRING, seq BIGINT, v BIGINT").withColumn("b", F.floor(F.col("seq") / 50))
    total, prev, nth, want = {}, {}, {}, {}
    for k, seq, v in rows:
        total[k] = total.get(k, 0) + v
        nth[k] = nth.get(k, 0) + 1
        want[(k, seq)] = (total[k], prev.get(k), nth[k])
        prev[k] = v
    out = running_sum(df, ["k"], "b", ["seq"], F.col("v"), "s")
    out = previous_value(out, ["k"], "b", "seq", "v", "p")
    out = numbered(out, ["k"], "b", ["seq"], "n")
    assert {(r.k, r.seq): (r.s, r.p, r.n) for r in out.collect()} == want


def test_slim_export_keeps_mirrored_stores_only(spark):
    product = spark.createDataFrame([("1", 1, False), ("2", 3, False), ("3", 2, True)], "product_id STRING, availability_rank INT, is_discontinued BOOLEAN")
    child = lambda c: spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], f"product_id STRING, {c} STRING")
    store = spark.createDataFrame([("1001", "A", "", "", ""), ("1002", "B", "", "", "")], "site_id STRING, name STRING, address STRING, city STRING, county STRING")
    sp = spark.createDataFrame([("1001", "1"), ("1001", "2")], "site_id STRING, product_id STRING")
    slim = export.export_slim(search.Catalogue(product, child("grape"), child("pairing"), store, sp), 2)
    assert [r.product_id for r in slim.product.collect()] == ["1"] and "raw" not in slim.product.columns
    assert slim.grape.count() == slim.pairing.count() == slim.store_product.count() == 1
    meta = {r.key: r.value for r in export.export_meta(slim, 2, NOW, "2026-08-25T00:00:00Z").collect()}
    assert meta == {"exported_at": "2026-09-01T12:00:00Z", "source_sync": "2026-08-25T00:00:00Z", "products": "1",
                    "max_avail_rank": "2", "stores_covered": "1001 A"}


def test_versions_are_published_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "p")
    assert publish.live(spark, root) is None
    refused = publish.publish(root, {"product": spark.range(5)}, minimum=10).first()
    assert (refused.publish, refused.reason, refused.number, publish.live(spark, root)) == (False, "too few products", None, None)
    first = publish.publish(root, {"product": spark.range(30), "grape": spark.range(3)}, minimum=10).first()
    reader = publish.live(spark, root)
    assert (first.publish, first.number, reader.number) == (True, 1, 1) and reader.table("grape").count() == 3
    collapsed = publish.publish(root, {"product": spark.range(14), "grape": spark.range(1)}, minimum=10).first()
    assert (collapsed.publish, collapsed.live, collapsed.number) == (False, 30, 1) and publish.live(spark, root) == reader
    # Half of the live table is enough; whoever opened the old version goes on reading it.
    assert publish.publish(root, {"product": spark.range(15), "grape": spark.range(9)}, minimum=10).first().number == 2
    assert publish.live(spark, root).table("grape").count() == 9
    assert (reader.table("product").count(), reader.table("grape").count()) == (30, 3)
    # Tables that were written without a log entry, as by a publisher that was lost, are not seen.
    spark.range(99).write.parquet(f"{root}/versions/lost/product")
    assert publish.live(spark, root).number == 2
    assert publish.roll_back(spark, root, 1) == 3
    assert publish.live(spark, root).table("product").count() == 30 and publish.published(spark, root).count() == 3
    with pytest.raises(ValueError):
        publish.roll_back(spark, root, 7)
