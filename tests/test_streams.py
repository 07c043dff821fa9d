from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.errors import StreamingQueryException

from shelfwise.operators import ledger, search
from shelfwise.sources import tables
from shelfwise.streaming import streams

EVENTS = "cellar_id STRING, event_id BIGINT, wine_id BIGINT, kind STRING, reason STRING, quantity INT, on_date DATE, rating INT, note STRING"
READINGS = "site_id STRING, product_id STRING, ts TIMESTAMP, status INT, stock INT"


def _rows(df):
    return sorted(map(str, df.drop(tables.BUCKET).collect()))


def test_ledger_over_several_files_equals_batch(spark, tmp_path):
    day = datetime(2026, 9, 1).date()
    parts = [[("c", i, i % 3, "removed", "drunk", -1, day, 1 + i % 5, f"n{i}") for i in range(n, n + 7)] for n in (0, 7, 14)]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        streams.running_ledger(stream, out, state, 4).awaitTermination()
    events = spark.read.schema(EVENTS).parquet(source)
    want = events.groupBy(*ledger.KEYS).agg(ledger.balance().alias("quantity"), *ledger.summary_columns())
    assert _rows(spark.read.parquet(out)) == _rows(want)


def test_stock_replay_and_late_reading(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [[("1", "a", datetime(2026, 9, 2), 200, 5)], [("1", "a", datetime(2026, 9, 1), 200, 9), ("1", "b", datetime(2026, 9, 1), 404, None)]]
    for n, part in enumerate(rows):
        spark.createDataFrame(part, READINGS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(READINGS).parquet(source)
        streams.latest_stock(stream, out, str(tmp_path / "state"), 4).awaitTermination()
    # A second run from scratch replays everything into the same table.
    streams.latest_stock(spark.readStream.schema(READINGS).parquet(source), out, str(tmp_path / "state2"), 4).awaitTermination()
    want = search.latest_readings(spark.read.schema(READINGS).parquet(source))
    assert _rows(spark.read.parquet(out)) == _rows(want)


def test_stock_with_watermark_runs(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    part = [("1", "a", datetime(2026, 9, 2), 200, 5)] * 2
    spark.createDataFrame(part, READINGS).write.parquet(source)
    stream = spark.readStream.schema(READINGS).parquet(source)
    streams.latest_stock(stream, out, str(tmp_path / "state"), 4, lateness="1 day").awaitTermination()
    assert spark.read.parquet(out).first().stock == 5


def test_children_survive_a_failure_between_tables(spark, tmp_path, monkeypatch):
    lines, folder, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    synonyms = spark.createDataFrame([("shiraz", "Syrah")], "name STRING, canonical STRING")
    raw = lambda i, grapes, tastes: f'{{"productId": "{i}", "grapes": {grapes}, "tasteSymbols": {tastes}}}'.replace("'", '"')
    days = [(1, [raw("a", ["Shiraz", "Syrah"], ["Fisk", "Lamm"]), raw("b", ["Merlot"], ["Fisk"])]),
            (3, [raw("a", [], ["Lamm"])]), (2, [raw("a", ["Malbec"], []), raw("b", ["Merlot", "Malbec"], [])])]

    def run(n, texts):
        rows = [(t, datetime(2026, 9, n).date()) for t in texts]
        spark.createDataFrame(rows, "raw STRING, day DATE").coalesce(1).write.mode("append").parquet(lines)
        stream = spark.readStream.schema("raw STRING, day DATE").parquet(lines)
        return streams.mirror_with_children(stream, folder, synonyms, state, 4)

    replace, calls = streams.merge.replace_children_table, []

    def failing(path, *args):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("disk gone")
        replace(path, *args)

    monkeypatch.setattr(streams.merge, "replace_children_table", failing)
    with pytest.raises(StreamingQueryException):
        run(*days[0]).awaitTermination()
    read = lambda kind: sorted(tuple(r) for r in streams.merge.read_children(spark, f"{folder}/{kind}", kind).collect())
    streams.mirror_with_children(spark.readStream.schema("raw STRING, day DATE").parquet(lines), folder, synonyms, state, 4).awaitTermination()
    assert read("grape") == [("a", "Syrah", "Syrah"), ("b", "Merlot", "Merlot")]
    assert read("pairing") == [("a", "Fisk"), ("a", "Lamm"), ("b", "Fisk")]
    for n, texts in days[1:]:
        run(n, texts).awaitTermination()
    # The second day came last: it is older than what is stored of a, and newer than what is stored of b.
    assert read("grape") == [("b", "Malbec", "Malbec"), ("b", "Merlot", "Merlot")]
    assert read("pairing") == [("a", "Lamm")]
    assert sorted((r.batch, r.products) for r in spark.read.parquet(f"{folder}/commit").collect()) == [(0, 2), (1, 1), (2, 1)]
