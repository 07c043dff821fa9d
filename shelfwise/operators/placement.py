"""Commands that move bottles, judged one after the other in each cellar with a rack.

Whether a command may claim a slot depends on all accepted commands before it: who was
moved in, and who was moved out. So the commands of one cellar that touch slots are walked
in ``seq`` order, cellars beside each other. Spark partitions by cellar and sorts; a task
sees one row at a time and keeps only the state of the cellar at hand: its slots, and the
wines that are in slots or that a command names. Its memory is bounded by racks and wines,
never by the number of commands, and rows are streamed, not grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.functions import cellar as rules
from shelfwise.operators import rack

_ROWS = ("cellar_id", "kind", "seq", "wine", "adds", "quantity", "moves", "location", "parts", "slots")


def judge(commands: DataFrame, wines: DataFrame, racks: DataFrame) -> DataFrame:
    """(cellar_id, seq, reason, moved, place): each command's refusal, or where its wine is afterwards.

    commands: cellar_id, seq, wine, adds, quantity, moves, location. ``wine`` is any text
    that names the wine; ``adds`` says that ``quantity`` comes on top of the count (else it
    is the new count, or NULL: unchanged); ``moves`` that a location is given, NULL included.
    wines: cellar_id, wine, quantity, location. Commands name cellars with a rack.

    Slots must be in the rack, each listed once, as many places as bottles, none held by
    another wine with bottles; other places are taken as written. A wine in slots cannot
    change its count without saying where the bottles are. Without bottles it has no place.
    """
    asked = commands.select("cellar_id").distinct()
    named = commands.select("cellar_id", "wine").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    grid = rack.slots(racks).join(asked, "cellar_id", "left_semi").select(
        "cellar_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), F.col("slot").alias("wine"), none("boolean").alias("adds"),
        none("int").alias("quantity"), none("boolean").alias("moves"), none("string").alias("location"),
        none("array<string>").alias("parts"), none("array<string>").alias("slots"))

    def rows(df: DataFrame, kind: int, seq: Column, adds: Column, moves: Column) -> DataFrame:
        parts = rules.location_parts(F.col("location"))
        return df.select("cellar_id", F.lit(kind).alias("kind"), seq.cast("long").alias("seq"), F.col("wine").cast("string").alias("wine"), adds.alias("adds"),
                         F.col("quantity").cast("int").alias("quantity"), moves.alias("moves"), "location", parts.alias("parts"),
                         F.filter(parts, rules.is_slot).alias("slots"))

    placed = wines.filter((F.col("quantity") > 0) & (F.size(rules.slots_in(F.col("location"))) > 0)).join(asked, "cellar_id", "left_semi")
    others = wines.join(placed.select("cellar_id", "wine"), ["cellar_id", "wine"], "left_anti").join(named, ["cellar_id", "wine"], "left_semi")
    stream = (grid.unionByName(rows(placed.unionByName(others), 1, F.lit(0), none("boolean"), none("boolean")))
              .unionByName(rows(commands, 2, F.col("seq"), F.col("adds"), F.col("moves"))))
    ordered = stream.select(*_ROWS).repartition("cellar_id").sortWithinPartitions("cellar_id", "kind", "seq")
    return ordered.mapInArrow(_walker(), "cellar_id string, seq long, reason string, moved boolean, place string")


def _walker():
    """The walk as a function of its own, so that executors need nothing of this package."""

    def walk(batches):
        import pyarrow as pa

        names = ("cellar_id", "seq", "reason", "moved", "place")
        kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string())
        cellar, grid, wines, holders = object(), set(), {}, {}

        def hold(wine, state):
            for slot in state["slots"] if state["quantity"] > 0 else ():
                holders.setdefault(slot, set()).add(wine)

        def release(wine, state):
            for slot in state["slots"]:
                holders.get(slot, set()).discard(wine)

        def refusal(wine, slots, parts, total):
            if not set(slots) <= grid:
                return "outside the rack"
            if len(set(slots)) < len(slots):
                return "listed twice"
            if len(parts) != total:
                return "places differ from bottles"
            return "held by another wine" if any(holders.get(s, set()) - {wine} for s in slots) else None

        def decide(row):
            wine = row["wine"]
            known = wine in wines
            before = wines.get(wine, {"quantity": 0, "location": None, "parts": [], "slots": []})
            asked = row["quantity"]
            total = before["quantity"] + asked if row["adds"] else before["quantity"] if asked is None else asked
            # An addition to a wine in slots needs a place; so does another count of it, unless it is none.
            recount = known and total != before["quantity"]
            if not row["moves"] and recount and total > 0 and before["slots"]:
                return "needs a slot for each bottle", False, None
            new, moved = before, False
            if row["moves"] or (recount and not row["adds"]):
                new, moved = (row if row["moves"] else before), True
            place, slots, parts = new["location"], new["slots"], new["parts"]
            if moved and slots:
                if total == 0:
                    place, slots, parts = None, [], []
                else:
                    reason = refusal(wine, slots, parts, total)
                    if reason:
                        return reason, False, None
                    place = ", ".join(parts)
            release(wine, before)
            wines[wine] = {"quantity": total, "location": place, "parts": parts, "slots": slots}
            hold(wine, wines[wine])
            return None, moved and (row["moves"] or place != before["location"]), place

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["cellar_id"] != cellar:
                    cellar = row["cellar_id"]
                    grid.clear()
                    wines.clear()
                    holders.clear()
                if row["kind"] == 0:
                    grid.add(row["wine"])
                elif row["kind"] == 1:
                    wines[row["wine"]] = row
                    hold(row["wine"], row)
                else:
                    out.append((cellar, row["seq"], *decide(row)))
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))

    return walk
