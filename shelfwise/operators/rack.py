"""Racks and the placing of bottles: one bottle per slot, many cellars at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.functions import cellar as rules

CELLAR = "cellar_id"


def slots(racks: DataFrame) -> DataFrame:
    """(cellar_id, rack_no, slot_no, slot, col, row): every slot of a rack table
    (cellar_id, rack_no, col_from, col_to, row_from, row_to, missing).

    Numbered in reading order: rack by rack, each row by row.
    """
    rows = racks.select(
        CELLAR, "rack_no", "missing", "col_from", "col_to", F.explode(F.sequence("row_from", "row_to")).alias("row"))
    cells = rows.select(
        CELLAR, "rack_no", "missing", "row",
        F.explode(F.sequence(F.ascii("col_from"), F.ascii("col_to"))).alias("_code"))
    named = cells.select(
        CELLAR, "rack_no", "missing", "row", F.char("_code").alias("col"),
        F.concat(F.char("_code"), F.col("row").cast("string")).alias("slot"))
    real = named.filter(~F.array_contains(F.coalesce("missing", F.array().cast("array<string>")), F.col("slot")))
    # Rows have at most 26 columns, so this number is increasing in reading order.
    order = F.col("rack_no") * 100000 + F.col("row") * 100 + F.ascii("col") - 64
    return real.select(CELLAR, "rack_no", order.cast("bigint").alias("slot_no"), "slot", "col", "row")


def rack_violations(racks: DataFrame) -> DataFrame:
    """(cellar_id, rack_no, rule): ranges that run backwards, a column letter in two
    racks, a missing slot that is not inside its rack."""
    backwards = racks.filter((F.col("col_to") < F.col("col_from")) | (F.col("row_from") < 1)
                             | (F.col("row_to") < F.col("row_from"))).select(
        CELLAR, "rack_no", F.lit("runs backwards").alias("rule"))
    letters = racks.filter(F.col("col_to") >= F.col("col_from")).select(
        CELLAR, "rack_no", F.explode(F.sequence(F.ascii("col_from"), F.ascii("col_to"))).alias("_code"))
    owners = letters.groupBy(CELLAR, "_code").agg(F.min("rack_no").alias("_first"))
    shared = letters.join(owners, [CELLAR, "_code"]).filter(F.col("rack_no") > F.col("_first")).select(
        CELLAR, "rack_no", F.lit("column in two racks").alias("rule")).distinct()
    gaps = racks.select(CELLAR, "rack_no", "col_from", "col_to", "row_from", "row_to",
                        F.explode("missing").alias("_slot"))
    col, row = F.substring("_slot", 1, 1), F.substring("_slot", 2, 3).try_cast("int")
    outside = gaps.filter(~F.coalesce(
        col.between(F.col("col_from"), F.col("col_to")) & row.between(F.col("row_from"), F.col("row_to")),
        F.lit(False))).select(CELLAR, "rack_no", F.lit("missing slot outside").alias("rule")).distinct()
    return backwards.unionByName(shared).unionByName(outside)


def occupied(wines: DataFrame) -> DataFrame:
    """(cellar_id, slot, wine_id) for every slot a wine with bottles is in."""
    held = wines.filter((F.col("quantity") > 0) & F.col("location").isNotNull())
    return held.select(CELLAR, F.explode(F.array_distinct(rules.slots_in(F.col("location")))).alias("slot"), "wine_id")


def slot_map(racks: DataFrame, wines: DataFrame) -> DataFrame:
    """Every slot with the wine in it, NULL when free; of two claimants the later id shows."""
    holder = occupied(wines).groupBy(CELLAR, "slot").agg(F.max("wine_id").alias("wine_id"))
    return slots(racks).join(holder, [CELLAR, "slot"], "left")


def free_slots(racks: DataFrame, wines: DataFrame) -> DataFrame:
    """Slots no wine is in."""
    taken = occupied(wines).select(CELLAR, "slot").distinct()
    return slots(racks).join(taken, [CELLAR, "slot"], "left_anti")


def elsewhere(wines: DataFrame) -> DataFrame:
    """Wines with bottles whose location names no slot, or none at all."""
    out = wines.filter((F.col("quantity") > 0) & (F.size(rules.slots_in(F.col("location"))) == 0))
    label = rules.wine_label(F.col("wine_id"), F.col("producer"), F.col("name"), F.col("vintage"))
    return out.select(CELLAR, "wine_id", label.alias("label"), "quantity", "location")


def placement_violations(racks: DataFrame, wines: DataFrame) -> DataFrame:
    """(cellar_id, wine_id, rule, slot, other_wine): bottles that are not validly placed.

    Checked only in cellars with a rack and for locations that name a slot. A
    contested slot is found from the smallest and largest claimant of a slot, so
    no pairs of claimants are formed.
    """
    racked = racks.select(CELLAR).distinct()
    placed = (wines.filter((F.col("quantity") > 0) & F.col("location").isNotNull())
              .join(racked, CELLAR, "left_semi")
              .select(CELLAR, "wine_id", "quantity", rules.location_parts(F.col("location")).alias("parts"))
              .withColumn("_slots", F.filter("parts", rules.is_slot))
              .filter(F.size("_slots") > 0))
    none = F.lit(None).cast("string")
    nobody = F.lit(None).cast("bigint")
    count = placed.filter(F.size("parts") != F.col("quantity")).select(
        CELLAR, "wine_id", F.lit("places differ from bottles").alias("rule"), none.alias("slot"),
        nobody.alias("other_wine"))
    each = placed.select(CELLAR, "wine_id", F.explode("_slots").alias("slot"))
    held = each.groupBy(CELLAR, "wine_id", "slot").agg(F.count(F.lit(1)).alias("_times"))
    twice = held.filter(F.col("_times") > 1).select(
        CELLAR, "wine_id", F.lit("listed twice").alias("rule"), "slot", nobody.alias("other_wine"))
    grid = slots(racks).select(CELLAR, "slot")
    outside = held.join(grid, [CELLAR, "slot"], "left_anti").select(
        CELLAR, "wine_id", F.lit("outside the rack").alias("rule"), "slot", nobody.alias("other_wine"))
    claims = held.groupBy(CELLAR, "slot").agg(F.min("wine_id").alias("_low"), F.max("wine_id").alias("_high"))
    contested = held.join(claims.filter(F.col("_low") < F.col("_high")), [CELLAR, "slot"]).select(
        CELLAR, "wine_id", F.lit("held by another wine").alias("rule"), "slot",
        F.when(F.col("wine_id") == F.col("_low"), F.col("_high")).otherwise(F.col("_low")).cast("bigint").alias("other_wine"))
    return count.unionByName(twice).unionByName(outside).unionByName(contested)


def normal_location(location: Column, has_rack: Column, quantity: Column) -> Column:
    """A location as it is stored: tidied slots, none for a wine without bottles."""
    parts = rules.location_parts(location)
    has_slot = F.size(F.filter(parts, rules.is_slot)) > 0
    return F.when(~has_rack | location.isNull() | ~has_slot, location).when(
        quantity > 0, F.array_join(parts, ", "))


def rack_table(spark, racks: list[tuple]) -> DataFrame:
    """A rack table from (cellar_id, rack_no, col_from, col_to, row_from, row_to, missing) rows."""
    return spark.createDataFrame(racks, "cellar_id STRING, rack_no INT, col_from STRING, col_to STRING, "
                                        "row_from INT, row_to INT, missing ARRAY<STRING>")


