from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfwise import spec
from shelfwise.functions import cellar as rules
from shelfwise.operators import commands, ledger, rack, reviews

TODAY = date(2026, 9, 1)
WINE = dict.fromkeys(f.name for f in spec.WINE_SCHEMA)


def wines_of(spark, *rows):
    return spark.createDataFrame([{**WINE, "cellar_id": "c", "name": "W", "quantity": 1, **r} for r in rows], spec.WINE_SCHEMA)


def racks_of(spark, *blocks):
    return rack.rack_table(spark, [("c", i, *b[:4], list(b[4:])) for i, b in enumerate(blocks)])


def no_rack(spark):
    return spark.createDataFrame([], "cellar_id STRING")


MIRROR = ("56305", "5630501", "Château Montus", "Alain Brumont", 2012, "Frankrike", "Frankrike sydväst", "Madiran", "Rött vin",
          750.0, 14.5, 0.35, "note", 11, 11, 1, 7)


@pytest.fixture(scope="module")
def mirror(spark):
    schema = ("product_id STRING, product_number STRING, full_name STRING, producer STRING, vintage INT, country STRING, "
              "origin1 STRING, origin2 STRING, cat2 STRING, volume_ml DOUBLE, abv DOUBLE, sugar_g_per_100ml DOUBLE, taste STRING, "
              "clock_body INT, clock_tannin INT, clock_sweetness INT, clock_fruitacid INT")
    other = lambda i, n: (i, n, f"Wine {i}", None, None, None, None, None, None, 750.0, None, None, None, 0, 0, 0, 0)
    grapes = [("56305", "Tannat"), ("56305", "Cabernet sauvignon")]
    return (spark.createDataFrame([MIRROR, other("111", "222"), other("222", "333")], schema),
            spark.createDataFrame(grapes, "product_id STRING, grape STRING"))


def adds_of(spark, *rows):
    full = [("c", i + 1, r.get("id"), r.get("number"), r.get("q", 1), r.get("fields", {})) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "cellar_id STRING, seq BIGINT, product_id STRING, product_number STRING, quantity INT, fields MAP<STRING,STRING>")


def test_identity_is_copied(spark, mirror):
    out = commands.apply_adds(adds_of(spark, {"number": "5630501", "q": 3}, {"id": "56305", "fields": {"vintage": "2010"}},
                                      {"number": "5630501", "q": 1, "fields": {"location": "cellar"}}),
                              *mirror, wines_of(spark, {"wine_id": 7}), no_rack(spark), TODAY)
    rows = {r.wine_id: r for r in out.wines.collect()}
    w, older = rows[8], rows[9]
    assert (w.name, w.region, w.grapes, w.sugar_g_l, w.sb_taste) == (
        "Château Montus", "Frankrike sydväst, Madiran", "Cabernet sauvignon, Tannat", 3.5, "note")
    assert (w.quantity, w.location, w.clock_body) == (4, "cellar", 11)
    assert (older.vintage, older.sb_taste, older.clock_body, older.sugar_g_l, older.abv) == (2010, None, None, None, None)
    assert sorted((e.wine_id, e.seq, e.quantity) for e in out.events.collect()) == [(8, 1, 3), (8, 3, 1), (9, 2, 1)]


def test_ids_and_numbers_are_not_interchangeable(spark, mirror):
    out = commands.resolve_adds(adds_of(spark, {"id": "222"}, {"number": "222"}, {"id": "222", "number": "222"}, {"fields": {"name": "Own"}},
                                        {}, {"fields": {"name": "P", "profile": "x"}}, {"fields": {"name": "Z"}, "q": 0}), *mirror)
    got = {r.seq: (r.product_id, r.reason) for r in out.collect()}
    assert got == {1: ("222", None), 2: ("111", None), 3: (None, "no such product"), 4: (None, None), 5: (None, "needs a name"),
                   6: (None, "profile needs sources"), 7: (None, "quantity out of range")}
    assert out.filter("seq = 1").first().clock_body is None  # all zero: not rated


def test_top_up_keeps_identity_and_needs_slots(spark, mirror):
    held = wines_of(spark, {"wine_id": 3, "product_id": "56305", "vintage": 2012, "quantity": 2, "name": "Mine", "location": "A1, A2"},
                    {"wine_id": 5, "product_id": "56305", "vintage": 2012, "quantity": 1})
    batch = adds_of(spark, {"id": "56305"}, {"id": "56305", "fields": {"location": "A1, A2, A3", "purchase_currency": " eur "}})
    out = commands.apply_adds(batch, *mirror, held, racks_of(spark, ("A", "L", 1, 14)), TODAY)
    row = {r.wine_id: r for r in out.wines.collect()}
    assert (row[3].quantity, row[3].name, row[3].location, row[3].purchase_currency) == (3, "Mine", "A1, A2, A3", "EUR")
    assert row[5].quantity == 1 and len(row) == 2
    assert [(r.seq, r.reason) for r in out.rejects.collect()] == [(1, "needs a slot for each bottle")]


def test_adds_are_placed_in_order(spark, mirror):
    held = wines_of(spark, {"wine_id": 1, "product_id": "9", "quantity": 1, "name": "Held", "location": "b1"})
    own = lambda name, location, q=1: {"q": q, "fields": {"name": name, **({} if location is ... else {"location": location})}}
    batch = adds_of(spark, own("a", "Z99"), own("b", "b1"), own("c", "c1 ,c1", 2), own("d", "c1, c2"), own("e", " c2"), own("f", "c2"), own("g", "fridge"),
                    {"id": "56305", "fields": {"location": "A1"}}, {"id": "56305"}, {"id": "56305", "q": 2, "fields": {"location": "A1,a2, A3"}},
                    {"id": "111"}, {"id": "111"}, own("h", None), {"id": "56305", "fields": {"location": "cupboard"}}, own("i", "a3"))
    racks = racks_of(spark, ("A", "L", 1, 14))
    out = commands.apply_adds(batch, *mirror, held, racks, TODAY, racks=racks)
    assert {r.seq: r.reason for r in out.rejects.collect()} == {
        1: "outside the rack", 2: "held by another wine", 3: "listed twice", 4: "places differ from bottles", 6: "held by another wine",
        9: "needs a slot for each bottle"}
    assert {r.name: (r.quantity, r.location) for r in out.wines.collect()} == {
        "Held": (1, "b1"), "e": (1, "C2"), "g": (1, "fridge"), "Château Montus": (4, "cupboard"), "Wine 111": (2, None), "h": (1, None), "i": (1, "A3")}
    assert sorted(e.seq for e in out.events.collect()) == [5, 7, 8, 10, 11, 12, 13, 14, 15]
    without = commands.apply_adds(batch.filter("seq < 3"), *mirror, held, no_rack(spark), TODAY, racks=racks.filter("false"))
    assert without.rejects.count() == 0 and {r.location for r in without.wines.collect()} == {"b1", "Z99"}


def test_patches_are_placed_in_order(spark):
    held = wines_of(spark, {"wine_id": 1, "quantity": 2, "location": "A1, A2"}, {"wine_id": 2, "quantity": 1, "location": "fridge"},
                    {"wine_id": 3, "quantity": 0}, {"wine_id": 4, "quantity": 1, "location": "B1"})
    racks = racks_of(spark, ("A", "L", 1, 14))
    patches = patch_of(spark, (1, {"quantity": "3", "location": "A1, A2, A3"}), (1, {"quantity": "2"}), (1, {"location": "Z9"}), (2, {"location": "A1"}),
                       (1, {"quantity": "2", "location": "A2,A3"}), (2, {"location": "a1"}), (1, {"quantity": "2"}), (4, {"quantity": "0"}),
                       (3, {"quantity": "1", "location": "b1"}), (2, {"quantity": "4"}), (7, {"location": "A1"}), (3, {"notes": "n"}), (1, {"location": None}))
    out = commands.apply_patch(patches, held, racks, TODAY, racks=racks)
    assert {r.seq: r.reason for r in out.rejects.collect()} == {
        2: "needs a slot for each bottle", 3: "outside the rack", 4: "held by another wine", 10: "needs a slot for each bottle", 11: "no such wine"}
    assert {r.wine_id: (r.quantity, r.location) for r in out.wines.collect()} == {1: (2, None), 2: (1, "A1"), 3: (1, "B1"), 4: (0, None)}
    assert sorted((e.seq, e.quantity) for e in out.events.collect()) == [(1, 1), (5, -1), (8, -1), (9, 1)]


def patch_of(spark, *rows):
    return spark.createDataFrame([("c", r[0], i + 1, r[1]) for i, r in enumerate(rows)], "cellar_id STRING, wine_id BIGINT, seq BIGINT, fields MAP<STRING,STRING>")


def test_patch_omitted_keeps_and_null_clears(spark):
    held = wines_of(spark, {"wine_id": 1, "quantity": 2, "notes": "keep", "location": "shelf", "vintage": 2012, "sb_taste": "t", "abv": 14.0, "clock_body": 5})
    out = commands.apply_patch(patch_of(spark, (1, {"location": None, "drink_from": "2027", "quantity": "5"}), (1, {"name": None}),
                                        (2, {"notes": "x"}), (1, {"quantity": "5"}), (1, {"quantity": "4", "drink_until": None})),
                               held, no_rack(spark), TODAY)
    row = out.wines.first()
    assert (row.notes, row.location, row.drink_from, row.quantity, row.sb_taste) == ("keep", None, 2027, 4, "t")
    assert sorted((e.seq, e.kind, e.quantity) for e in out.events.collect()) == [(1, "adjusted", 3), (5, "adjusted", -1)]
    assert {r.seq: r.reason for r in out.rejects.collect()} == {2: "name cannot be cleared", 3: "no such wine"}
    moved = commands.apply_patch(patch_of(spark, (1, {"vintage": "2016"})), held, no_rack(spark), TODAY).wines.first()
    assert (moved.vintage, moved.sb_taste, moved.clock_body, moved.abv) == (2016, None, None, 14.0)


def removals_of(spark, rows):
    full = [("c", w, i + 1, q, "drunk", None, None, None, s) for i, (w, q, s) in enumerate(rows)]
    return spark.createDataFrame(full, "cellar_id STRING, wine_id BIGINT, seq BIGINT, quantity INT, reason STRING, on_date DATE, rating INT, note STRING, slots ARRAY<STRING>")


def _parts(location):
    import re

    parts = [p.strip() for p in (location or "").split(",") if p.strip()]
    return [p.upper() if re.match(r"^[A-Z]\d{1,3}$", p.upper()) else p for p in parts]


def sequential(wines, rows, has_rack):
    """The rules one command at a time."""
    import re

    slot = re.compile(r"^[A-Z]\d{1,3}$")
    state, accepted = {w: [q, loc] for w, q, loc in wines}, []
    for seq, (w, q, slots) in enumerate(rows, 1):
        if w not in state or not 1 <= q <= 1000 or q > state[w][0]:
            continue
        have, loc = state[w]
        parts = _parts(loc)
        out = [s.strip().upper() for s in slots or []]
        new = loc
        if out:
            if any(s not in parts for s in out) or len(out) != q:
                continue
            for s in out:
                if s in parts:
                    parts.remove(s)
            new = ", ".join(parts) or None
        elif any(slot.match(p) for p in parts):
            if have == q:
                new = None
            elif has_rack and len(parts) > 1:
                continue
        state[w] = [have - q, new]
        accepted.append(seq)
    return accepted, {w: tuple(v) for w, v in state.items()}


@pytest.mark.parametrize("has_rack", [True, False])
@pytest.mark.parametrize("seed", range(3))
def test_removals_equal_one_at_a_time(spark, monkeypatch, seed, has_rack):
    monkeypatch.setattr(commands, "BLOCK_ROWS", 7)
    rng = random.Random(seed)
    wines, rows = [], []
    for w in range(24):
        kind = w % 4
        slots = [f"A{w + 1}", f"b{w + 1}", f"C{w + 1}", f"D{w + 1}", f"E{w + 1}"][:rng.randint(1, 5)]
        if kind == 0:
            wines.append((w, rng.randint(0, 60), rng.choice([None, "fridge", "floor, box"])))
        elif kind == 1:
            wines.append((w, len(slots), ", ".join(slots)))
        elif kind == 2:
            loose = ["fridge", "floor", "box"][:rng.randint(1, 3)]
            wines.append((w, len(slots) - 1 + len(loose), " , ".join([*slots[:-1], *loose])))
        else:
            wines.append((w, rng.randint(1, 9), ", ".join(slots)))  # bottles and places differ
    for _ in range(500):
        w = rng.choice([0, 1, 2, 3, *range(25)])
        named = rng.random() < 0.5 and w % 4
        slots = [f"{rng.choice('AbCDE')}{w + 1}" for _ in range(rng.randint(1, 2))] if named else None
        rows.append((w, len(set(slots)) if slots and rng.random() < 0.9 else rng.choice([1, 1, 2, 3, 7, 0]), sorted(set(slots)) if slots else None))
    df = wines_of(spark, *[{"wine_id": w, "quantity": q, "location": loc} for w, q, loc in wines])
    racks = racks_of(spark, ("A", "E", 1, 30)) if has_rack else no_rack(spark)
    out = commands.apply_removals(removals_of(spark, rows), df, racks, TODAY)
    want_seq, want_state = sequential(wines, rows, has_rack)
    assert sorted(e.seq for e in out.events.collect()) == want_seq
    assert {r.wine_id: (r.quantity, r.location) for r in out.wines.collect()} == want_state
    assert out.rejects.count() == len(rows) - len(want_seq)


def test_hot_wine_after_the_first_refusal(spark, monkeypatch):
    monkeypatch.setattr(commands, "BLOCK_ROWS", 16)
    rng = random.Random(5)
    rows = [(1, rng.choice([1, 2, 3, 5, 8]), None) for _ in range(400)] + [(2, 1000, None), (2, 1001, None)]
    wines = [(1, 301, None), (2, 1500, None)]
    df = wines_of(spark, *[{"wine_id": w, "quantity": q, "location": loc} for w, q, loc in wines])
    out = commands.apply_removals(removals_of(spark, rows), df, no_rack(spark), TODAY)
    assert sorted(e.seq for e in out.events.collect()) == sequential(wines, rows, False)[0]


def test_ledger_summary_and_hidden_empty_wines(spark):
    events = spark.createDataFrame(
        [("c", 1, 1, "added", None, 2, TODAY, None, None), ("c", 2, 1, "removed", "drunk", -1, TODAY, 5, "with lamb"),
         ("c", 3, 1, "removed", "gift", -1, TODAY, None, None)], spec.EVENT_SCHEMA)
    held = wines_of(spark, {"wine_id": 1, "quantity": 0}, {"wine_id": 2})
    row = ledger.list_cellar(held, events, wine_id=1).first()
    assert (row.avg_rating, row.times_drunk, row.last_note) == (5.0, 1, "with lamb")
    assert [r.wine_id for r in ledger.list_cellar(held, events).collect()] == [2]
    assert {r.wine_id: r.quantity for r in ledger.ledger_balance(events, held).collect()} == {1: 0, 2: 0}
    assert [r.change for r in ledger.history(events).collect()] == ["+2", "-1", "-1"]


def test_windows(spark):
    y = 2026
    bounds = [(y - 2, y + 5), (y - 5, y + 1), (y - 10, y - 1), (y + 3, y + 10), (None, None)]
    held = wines_of(spark, *[{"wine_id": i + 1, "drink_from": a, "drink_until": b} for i, (a, b) in enumerate(bounds)])
    rows = ledger.with_windows(held, y).collect()
    got = {k: {r.wine_id for r in rows if r[k]} for k in spec.DRINK_WINDOWS}
    assert got == {"ready": {1, 2}, "drink_soon": {2, 3}, "not_yet": {4}, "unknown": {5}}
    assert [r.window_state for r in sorted(rows, key=lambda r: r.wine_id)] == ["ready", "ready, drink soon", "past its window", "not ready yet", None]


def test_totals_per_currency(spark):
    held = wines_of(spark, {"wine_id": 1, "quantity": 2, "purchase_price": 23.5, "purchase_currency": " eur "},
                    {"wine_id": 2, "quantity": 2, "purchase_price": 23.0, "purchase_currency": "EUR"},
                    {"wine_id": 3, "quantity": 1, "purchase_price": 429.0})
    paid = ledger.paid_by_currency(ledger.normalise_currency(held))
    assert {r.currency: r.total for r in paid.collect()} == {"SEK": 429.0, "EUR": 93.0}
    assert tuple(ledger.summary(held).first())[1:] == (3, 5)


def test_rack_geometry(spark):
    racks = racks_of(spark, ("A", "D", 1, 13, "D12", "D13"), ("E", "H", 1, 13, "H12", "H13"), ("I", "L", 1, 14))
    grid = rack.slots(racks)
    assert grid.count() == 156 and [r.n for r in grid.groupBy("rack_no").agg(F.count("*").alias("n")).orderBy("rack_no").collect()] == [50, 50, 56]
    assert [r.slot for r in grid.orderBy("slot_no").limit(5).collect()] == ["A1", "B1", "C1", "D1", "A2"]
    bad = racks_of(spark, ("A", "D", 1, 13, "Z1"), ("D", "C", 1, 2), ("B", "B", 1, 1))
    assert sorted((r.rack_no, r.rule) for r in rack.rack_violations(bad).collect()) == [
        (0, "missing slot outside"), (1, "runs backwards"), (2, "column in two racks")]


def test_free_slots_and_elsewhere(spark):
    racks = racks_of(spark, ("A", "B", 1, 2))
    held = wines_of(spark, {"wine_id": 1, "quantity": 2, "location": "a1, A2", "name": "Left"}, {"wine_id": 2, "location": "fridge"},
                    {"wine_id": 3, "quantity": 0, "location": "B1"})
    assert sorted(r.slot for r in rack.free_slots(racks, held).collect()) == ["B1", "B2"]
    assert [(r.wine_id, r.location, r.label) for r in rack.elsewhere(held).collect()] == [(2, "fridge", "#2 W NV")]
    assert {r.slot: r.wine_id for r in rack.slot_map(racks, held).collect()} == {"A1": 1, "A2": 1, "B1": None, "B2": None}


def test_placement_rules(spark):
    racks = racks_of(spark, ("A", "L", 1, 14))
    held = wines_of(spark, {"wine_id": 1, "location": "M3"}, {"wine_id": 2, "location": "A15"}, {"wine_id": 3, "location": "B7"},
                    {"wine_id": 4, "location": "b7"}, {"wine_id": 5, "quantity": 2, "location": "C1"},
                    {"wine_id": 6, "quantity": 2, "location": "C2, c2"}, {"wine_id": 7, "location": "fridge"}, {"wine_id": 8, "quantity": 2, "location": "D1, fridge"})
    got = sorted((r.wine_id, r.rule, r.slot, r.other_wine) for r in rack.placement_violations(racks, held).collect())
    assert got == [(1, "outside the rack", "M3", None), (2, "outside the rack", "A15", None), (3, "held by another wine", "B7", 4),
                   (4, "held by another wine", "B7", 3), (5, "places differ from bottles", None, None), (6, "listed twice", "C2", None)]


def test_locations(spark):
    row = spark.createDataFrame([("B3, c4 , fridge,, A1234",)], "l STRING").select(
        rules.location_parts(F.col("l")).alias("p"), rules.slots_in(F.col("l")).alias("s")).first()
    assert (row.p, row.s) == (["B3", "C4", "fridge", "A1234"], ["B3", "C4"])


@pytest.mark.parametrize("text,ok", [("2024", True), ("2024-03", True), ("2024-03-31", True), ("2024-13", False), ("24", False), ("2024-3", False), (None, True)])
def test_partial_dates(spark, text, ok):
    assert spark.createDataFrame([(text,)], "d STRING").select(rules.valid_partial_date(F.col("d")).alias("v")).first().v is ok


def review_batch(spark, *rows):
    base = dict.fromkeys(spec.REVIEW_FIELDS)
    full = [{"cellar_id": "c", "wine_id": 1, "seq": i + 1, **base, "release": "unknown", "seen": "quoted", **r} for i, r in enumerate(rows)]
    fields = ", ".join(f"{f} {k}" for f, k in spec.REVIEW_FIELDS.items())
    return spark.createDataFrame(full, f"cellar_id STRING, wine_id BIGINT, seq BIGINT, {fields}")


def test_reviews_replace_and_are_checked(spark):
    fields = ", ".join(f"{f} {k}" for f, k in spec.REVIEW_FIELDS.items())
    none = spark.createDataFrame([], f"cellar_id STRING, review_id BIGINT, wine_id BIGINT, {fields}, recorded_on STRING")
    held = wines_of(spark, {"wine_id": 1})
    first = reviews.upsert_reviews(review_batch(spark, {"critic": "Guide", "score": 91.0}, {"critic": "Guide"}, {"critic": "Old", "score": 25.0, "scale": 20.0},
                                                {"critic": "Dated", "award": "Gold", "tasted_on": "2024-03"}), none, held, TODAY)
    rows = {r.critic: r for r in first.reviews.collect()}
    assert (rows["Guide"].review_id, rows["Guide"].scale, rows["Dated"].review_id, rows["Dated"].scale) == (1, 100.0, 2, None)
    assert {r.seq: r.reason for r in first.rejects.collect()} == {2: "needs a score, an award or a summary", 3: "score above its scale"}
    assert first.wines.first().reviews_checked_on == TODAY.isoformat()
    again = reviews.upsert_reviews(review_batch(spark, {"critic": "GUIDE", "score": 17.0, "scale": 20.0}), first.reviews, held, TODAY)
    assert sorted((r.review_id, r.critic, r.score) for r in again.reviews.collect()) == [(1, "GUIDE", 17.0), (2, "Dated", None)]
    assert [r.review_id for r in reviews.reviews_of(again.reviews).collect()] == [2, 1]
    patches = spark.createDataFrame([("c", 1, 1, {"score": None, "summary": "dry"}), ("c", 2, 1, {"critic": None}), ("c", 9, 1, {"score": "1"})],
                                    "cellar_id STRING, review_id BIGINT, seq BIGINT, fields MAP<STRING,STRING>")
    after, refused = reviews.patch_reviews(patches, again.reviews, TODAY)
    row = after.filter("review_id = 1").first()
    assert (row.score, row.scale, row.summary, after.count()) == (None, None, "dry", 2)
    assert {r.review_id: r.reason for r in refused.collect()} == {2: "critic cannot be cleared", 9: "no such review"}


def test_removal_becomes_clear_once_the_slot_is_empty(spark):
    out = commands.apply_removals(removals_of(spark, [(1, 1, ["A1"]), (1, 1, None)]), wines_of(spark, {"wine_id": 1, "quantity": 3, "location": "A1, floor, shelf"}),
                                  racks_of(spark, ("A", "E", 1, 30)), TODAY)
    assert sorted(e.seq for e in out.events.collect()) == [1, 2] and out.rejects.count() == 0


def test_mistyped_values_are_refused(spark, mirror):
    held = wines_of(spark, {"wine_id": 1, "purchase_price": 10.0})
    patches = spark.createDataFrame([("c", 1, 1, {"purchase_price": "12,50"}), ("c", 1, 2, {"purchase_price": None}), ("c", 1, 3, {"vintage": "abc"})],
                                    "cellar_id STRING, wine_id BIGINT, seq BIGINT, fields MAP<STRING,STRING>")
    out = commands.apply_patch(patches.filter("seq <> 2"), held, no_rack(spark), TODAY)
    assert {r.seq: r.reason for r in out.rejects.collect()} == {1: "not a number", 3: "not a number"} and out.wines.first().purchase_price == 10.0
    assert commands.apply_patch(patches.filter("seq = 2"), held, no_rack(spark), TODAY).wines.first().purchase_price is None
    added = commands.apply_adds(adds_of(spark, {"id": "111", "fields": {"abv": "12 %"}}, {"id": "111"}), *mirror, held, no_rack(spark), TODAY)
    assert [(r.seq, r.reason) for r in added.rejects.collect()] == [(1, "not a number")]


def _patched(review, patches):
    """The rules one patch at a time."""
    row, refused = dict(review), {}
    for seq, fields in patches:
        new = {**row, **{k: float(v) if v is not None and k in ("score", "scale") else v for k, v in fields.items()}}
        new["scale"] = None if new["score"] is None else (100.0 if new["scale"] is None else new["scale"])
        if "critic" in fields and not fields["critic"]:
            refused[seq] = "critic cannot be cleared"
        elif new["score"] is None and not new["award"] and not new["summary"]:
            refused[seq] = "needs a score, an award or a summary"
        elif new["score"] is not None and new["score"] > new["scale"]:
            refused[seq] = "score above its scale"
        else:
            row = new
    return row, refused


@pytest.mark.parametrize("block", [1000, 3])
def test_review_patches_in_order(spark, monkeypatch, block):
    monkeypatch.setattr(reviews, "PATCH_BLOCK", block)
    rng = random.Random(block)
    fields = ", ".join(f"{f} {k}" for f, k in spec.REVIEW_FIELDS.items())
    base = {**dict.fromkeys(spec.REVIEW_FIELDS), "critic": "Guide", "score": 91.0, "scale": 100.0, "release": "unknown", "seen": "quoted"}
    held = spark.createDataFrame([{"cellar_id": "c", "review_id": i, "wine_id": 1, **base, "recorded_on": "old"} for i in range(6)],
                                 f"cellar_id STRING, review_id BIGINT, wine_id BIGINT, {fields}, recorded_on STRING")
    choices = [{"award": "Gold"}, {"score": "150"}, {"score": None}, {"score": "17", "scale": "20"}, {"award": None}, {"summary": "dry"}, {"critic": None},
               {"critic": "B", "summary": None}]
    asked = [(rng.randrange(5), seq, rng.choice(choices)) for seq in range(60)]
    patches = spark.createDataFrame([("c", *a) for a in asked], "cellar_id STRING, review_id BIGINT, seq BIGINT, fields MAP<STRING,STRING>")
    after, refused = reviews.patch_reviews(patches, held, TODAY)
    want, reasons = {}, {}
    for i in range(6):
        want[i], own = _patched(base, [(seq, f) for r, seq, f in asked if r == i])
        reasons |= own
    got = {r.review_id: r.asDict() for r in after.collect()}
    assert {i: {f: row[f] for f in spec.REVIEW_FIELDS} for i, row in got.items()} == want and got[5]["recorded_on"] == "old"
    assert {r.seq: r.reason for r in refused.collect()} == reasons


def test_staged_rows_are_compiled_in_pieces(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter
    from shelfwise.sources.scratch import staged

    limit, seen, write = "spark.sql.codegen.hugeMethodLimit", [], DataFrameWriter.parquet
    kept = spark.conf.get(limit)
    spark.conf.set(limit, "65535")
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (seen.append(spark.conf.get(limit)), write(self, path)))
    try:
        assert staged(spark.range(3), "pieces").count() == 3
        assert (seen, spark.conf.get(limit)) == (["8000"], "65535")
    finally:
        spark.conf.set(limit, kept)


def test_removals_broadcast_neither_wines_nor_accepted_commands(spark):
    """Their size on disk says little of what a broadcast of them takes in memory."""
    wines, asked = wines_of(spark, {"wine_id": 1, "quantity": 3, "location": "A1, floor, shelf"}), removals_of(spark, [(1, 1, ["A1"]), (1, 9, None)])
    out = commands.apply_removals(asked, wines, no_rack(spark), TODAY)
    plan = out.rejects._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert [r.seq for r in out.rejects.collect()] == [2]
    judged = commands._judged_removals(asked, wines, no_rack(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in judged
