from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfwise import spec
from shelfwise.operators import normalise
from shelfwise.sources import snapshots, synonyms

FULL = {
    "productId": "12345", "productNameBold": "Château Test", "productNameThin": "Grand Cru",
    "assortmentText": "Fast sortiment", "price": 199, "volume": 750, "alcoholPercentage": 13.5, "vintage": "2019",
    "isOrganic": True, "tasteClockBody": 9, "tasteClockRoughness": 7, "grapes": ["Shiraz", "Merlot"],
    "tasteSymbols": ["Nöt", "Ost"],
}


def typed(spark, *records):
    rows = [(r if isinstance(r, str) else json.dumps(r), datetime(2026, 9, 1)) for r in records]
    return normalise.normalise(spark.createDataFrame(rows, "raw STRING, synced_at TIMESTAMP"))


def test_full_record(spark):
    df = typed(spark, FULL)
    row = df.first()
    assert df.columns == [*spec.ALL_COLUMNS, "grapes", "pairings"] and len(spec.ALL_COLUMNS) == 55
    assert (row.full_name, row.vintage, row.availability, row.availability_rank) == ("Château Test Grand Cru", 2019, "stocked", 1)
    assert (row.clock_body, row.clock_tannin, row.is_organic, row.is_vegan) == (9, 7, True, None)
    grapes = normalise.grape_children(df, synonyms.grape_synonyms(spark)).collect()
    assert sorted((g.grape, g.raw_name) for g in grapes) == [("Merlot", "Merlot"), ("Syrah", "Shiraz")]
    assert normalise.pairing_children(df).count() == 2


def test_sparse_and_mistyped_records(spark):
    rows = {r.product_id: r for r in typed(
        spark, {"productId": "1"},
        {"productId": "2", "productNameBold": 42, "price": "not a number", "grapes": "not a list", "isOrganic": "yes"},
        "no json", {"productNameBold": "no id"}).collect()}
    assert set(rows) == {"1", "2"}
    assert (rows["1"].price, rows["1"].availability, rows["1"].taste, rows["1"].launch_date) == (None, "order_only", None, None)
    assert (rows["2"].name, rows["2"].price, rows["2"].grapes, rows["2"].is_organic) == ("", None, None, False)


@pytest.mark.parametrize("value,expected", [
    (12.5, 12.5), ("12.5", 12.5), (" 12.5", None), ("1e2", 100.0), ("NaN", None), ("1e999", None), (True, None), (None, None)])
def test_numbers(spark, value, expected):
    assert typed(spark, {"productId": "1", "price": value}).first().price == expected


@pytest.mark.parametrize("value,expected", [(2019.9, 2019), (" 2019 ", 2019), ("2019.5", None), ("x", None), (-3.7, -3)])
def test_vintages(spark, value, expected):
    assert typed(spark, {"productId": "1", "vintage": value}).first().vintage == expected


def test_release_fields_and_lists(spark):
    row = typed(spark, {"productId": "1", "productLaunchDate": "2026-09-11T00:00:00", "sellStartTime": "10:00:00",
                        "isNews": True, "assortment": "TSE", "grapes": ["a", 1, None, "b"]}).first()
    assert (row.launch_date, row.sell_start_time, row.is_news, row.assortment_code) == ("2026-09-11T00:00:00", "10:00:00", True, "TSE")
    assert row.grapes == ["a", "b"]


@pytest.mark.parametrize("raw,expected", [
    ("Shiraz", "Syrah"), ("shiraz", "Syrah"), ("  Garnacha  ", "Grenache"), ("Tinta roriz", "Tempranillo"),
    ("Spätburgunder", "Pinot noir"), ("Primitivo", "Zinfandel"), ("Monastrell", "Mourvèdre"), ("Pinot grigio", "Pinot gris"),
    ("Petite sirah", "Petite sirah"), ("Welschriesling", "Welschriesling"), ("Pinotage", "Pinotage"),
    ("Cabernet franc", "Cabernet franc"), (" Unknown ", "Unknown")])
def test_grape_names(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "name STRING")
    assert normalise.canonical(df, "name", synonyms.grape_synonyms(spark), "grape").first().grape == expected


@pytest.mark.parametrize("text,expected", [
    ("Fast sortiment", ("stocked", 1)), ("Lokalt & Småskaligt", ("stocked", 1)), ("Tillfälligt sortiment", ("limited", 2)),
    ("Ordervaror", ("order_only", 3)), ("Webblanseringar", ("order_only", 3)), ("Something New", ("order_only", 3)),
    ("", ("order_only", 3)), (None, ("order_only", 3)), ("\tSäsong ", ("limited", 2))])
def test_tiers(spark, text, expected):
    row = normalise.with_availability(spark.createDataFrame([(text,)], "assortment_text STRING")).first()
    assert (row.availability, row.availability_rank) == expected


@pytest.mark.parametrize("price,ml,abv,expected", [(200.0, 500.0, 10.0, (400.0, 40.0)), (200.0, 0.0, 0.0, (None, None)),
                                                   (200.0, 500.0, 0.0, (400.0, None)), (None, 500.0, 10.0, (None, None))])
def test_derived_prices(spark, price, ml, abv, expected):
    df = spark.createDataFrame([(price, ml, abv)], "price DOUBLE, volume_ml DOUBLE, abv DOUBLE")
    row = normalise.with_derived_prices(df).first()
    assert (row.sek_per_litre, row.sek_per_cl_alcohol) == expected


def test_backfill_adds_only_missing_columns(spark):
    raw = json.dumps({"sellStartTime": "10:00:00", "isNews": True, "assortment": "TSE"})
    old = spark.createDataFrame([("1", raw, "13:00:00"), ("2", "{}", None)], "product_id STRING, raw STRING, sell_start_time STRING")
    once = normalise.backfill_release_columns(old)
    rows = {r.product_id: r for r in normalise.backfill_release_columns(once).collect()}
    assert (rows["1"].sell_start_time, rows["1"].is_news, rows["1"].assortment_code) == ("13:00:00", True, "TSE")
    assert (rows["2"].sell_start_time, rows["2"].is_news, rows["2"].launch_date) == (None, False, None)


def test_snapshot_day_is_overwritten(spark, tmp_path):
    path = str(tmp_path / "snap")
    day = F.lit("2026-09-01").cast("date")
    first = spark.createDataFrame([('{"productId": "1"}',), ('{"productId": "2"}',)], "raw STRING")
    snapshots.write_snapshot(first.withColumn("day", day), path)
    snapshots.write_snapshot(first.withColumn("day", F.date_add(day, 1)), path)
    snapshots.write_snapshot(first.limit(1).withColumn("day", day), path)
    counts = {str(r.day): r.n for r in snapshots.read_snapshot(spark, path).groupBy("day").agg(F.count("*").alias("n")).collect()}
    assert counts == {"2026-09-01": 1, "2026-09-02": 2}


def test_snapshot_day_is_that_of_the_file(spark, tmp_path):
    """Dates further up in the path do not count, and a filter on the day opens its folder only."""
    folder = tmp_path / "2020-01-01" / "snap"
    lines = spark.createDataFrame([('{"productId": "1"}', "2026-08-02"), ('{"productId": "2"}', "2026-08-03")], "raw STRING, day STRING")
    snapshots.write_snapshot(lines.withColumn("day", F.col("day").cast("date")), str(folder))
    back = snapshots.read_snapshot(spark, str(folder))
    assert sorted(str(r.day) for r in back.collect()) == ["2026-08-02", "2026-08-03"]
    one = back.filter(F.col("day") == F.lit("2026-08-03").cast("date"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and "PartitionFilters: [isnotnull(day" in plan
    flat = tmp_path / "2019-01-01"
    flat.mkdir()
    (flat / "products-2026-08-04.jsonl").write_text('{"productId": "3"}\n')
    (flat / "other.jsonl").write_text('{"productId": "4"}\n')
    assert sorted(str(r.day) for r in snapshots.read_snapshot(spark, str(flat)).collect()) == ["2026-08-04", "None"]
