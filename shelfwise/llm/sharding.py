"""Sharding by fixed virtual slots and a versioned map of slots to shards.

Each record is hashed into one of ``n_slots`` virtual slots, a number that never
changes. Bytes and rows are summed per slot, and a small map says which shard owns
which slot. Growing or rebalancing edits the map: a record's slot stays, so only
the slots that change hands are moved.

The first map deals the slots out by size (largest first, always to the lightest
shard), which keeps the shards' bytes near equal; the law that holds is ``bytes``.

A record hashes by its id and text together, so neither a hot id nor missing ids make
a heavy slot. Only repeated rows can: a slot with more than ``HOT`` times the mean bytes or rows
is marked in the map as *dealt*, and each of its rows hashes by a number of its own
(``row_number_of``, given before the table is written) instead. The mark is part of the
map, so that later rows of such a slot are dealt out too.

Cases: a null text has no bytes and counts as size 1; null ids and null texts hash like
other values. Rows that repeat each get a place of their own. An empty table has an
empty map. Input columns named like a result column (virtual_slot, size, shard, slot) are
replaced; all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfwise.llm.names import unused

#: Slots of every map. Sums per slot are this many rows at most, whatever the input.
N_SLOTS = 4096
#: A slot is dealt out row by row beyond this many times the mean slot: 1/512 of all bytes or rows, a small part of a shard.
HOT = 8

_MAP = "virtual_slot int, shard int, bytes long, rows long, dealt boolean, version int"


def slot_of(*of: Column, n_slots: int = N_SLOTS) -> Column:
    """The slot of a record by the columns ``of``; a null hashes otherwise than an empty text."""
    return F.pmod(F.xxhash64(*of, *(c.isNull() for c in of)), F.lit(n_slots)).cast("int")


def in_slots(docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """``docs`` with virtual_slot and size (UTF-8 bytes of the text, plus 1)."""
    return docs.withColumns({"virtual_slot": slot_of(F.col(key), F.col(text), n_slots=n_slots),
                             "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")})


def row_number_of() -> Column:
    """A number of its own for every row, without a shuffle. Write the table before it is used: it follows the partitions."""
    return F.monotonically_increasing_id()


def heavy_slots(loads: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """virtual_slot of the slots to deal out: of ``loads``, those with more than ``HOT`` times the mean bytes or rows.

    Each holds that share of all, so there are at most 2 x ``n_slots`` / ``HOT``. One long record alone is no reason.
    """
    totals = loads.agg(F.sum("bytes").alias("all_bytes"), F.sum("rows").alias("all_rows"))  # one row
    above = (F.col("bytes") * n_slots > F.col("all_bytes") * HOT) | (F.col("rows") * n_slots > F.col("all_rows") * HOT)
    return loads.join(F.broadcast(totals), F.lit(True)).filter((F.col("rows") > 1) & above).select("virtual_slot")


def dealt_out(slotted: DataFrame, heavy: DataFrame, number: str, n_slots: int = N_SLOTS) -> DataFrame:
    """``slotted`` with the rows of ``heavy`` slots dealt over all slots by ``number``."""
    old, = unused(slotted, "old_slot")
    marked = slotted.join(F.broadcast(heavy.select("virtual_slot", F.col("virtual_slot").alias(old))), "virtual_slot", "left")
    spread = slot_of(F.col(number), F.col(old), n_slots=n_slots)
    return marked.withColumn("virtual_slot", F.when(F.col(old).isNotNull(), spread).otherwise(F.col("virtual_slot"))).drop(old)


def slot_loads(slotted: DataFrame) -> DataFrame:
    """virtual_slot, bytes, rows: combined within each task before the shuffle."""
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _index_of_least(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int") - 1


def first_map(loads: DataFrame, n_shards: int, heavy: DataFrame | None = None) -> DataFrame:
    """version 1 of the map: virtual_slot, shard, version, bytes, rows, dealt (whether the slot is one of ``heavy``).

    ``loads`` are those after dealing; a heavy slot that got no row back stands in the map too.

    The slots' sums (``N_SLOTS`` rows at most) are folded in order of falling size;
    the state is the bytes of each shard.
    """
    row = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes", "rows", "dealt")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"),
                     F.expr("array()").cast("array<int>").alias("shards"))

    def place(state: Column, slot: Column) -> Column:
        at = _index_of_least(state["loads"])
        return F.struct(F.transform(state["loads"], lambda x, i: F.when(i == at, x + slot["bytes"]).otherwise(x)).alias("loads"),
                        F.concat(state["shards"], F.array(at)).alias("shards"))

    loads = loads.select("virtual_slot", "bytes", "rows", F.lit(False).alias("dealt"))
    if heavy is not None:
        zero = F.lit(0).cast("long")
        loads = (loads.unionByName(heavy.select("virtual_slot", zero.alias("bytes"), zero.alias("rows"), F.lit(True).alias("dealt")))
                 .groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.max("dealt").alias("dealt")))
    folded = (loads.agg(F.array_sort(F.collect_list(row)).alias("slots"))
              .select("slots", F.aggregate("slots", start, place)["shards"].alias("shards")))
    return (folded.select(F.inline(F.arrays_zip("slots", "shards")))
            .select("slots.virtual_slot", F.col("shards").alias("shard"), F.lit(1).alias("version"), "slots.bytes", "slots.rows", "slots.dealt"))


def grown_map(current: DataFrame, n_shards: int) -> DataFrame:
    """The next version, edited for ``n_shards`` (one or more new shards): slots move only into new shards.

    Each old shard gives up, smallest slots first, what it holds above the new mean;
    what is given goes to the new shards in equal parts of the given bytes.
    """
    spread = Window.partitionBy("shard").orderBy("bytes", "virtual_slot")
    total = current.agg(F.sum("bytes").alias("total"), F.max("shard").alias("last"))
    held = (current.withColumns({"below": F.sum("bytes").over(spread), "held": F.sum("bytes").over(Window.partitionBy("shard"))})
            .join(F.broadcast(total), F.lit(True)))  # one row
    given = held.withColumn("given", F.col("below") <= F.col("held") - F.col("total") / n_shards)
    order = Window.partitionBy("given").orderBy(F.desc("bytes"), "virtual_slot")
    new = F.col("last") + 1 + F.pmod(F.row_number().over(order) - 1, F.lit(n_shards) - F.col("last") - 1)
    return given.select("virtual_slot", F.when(F.col("given"), new).otherwise(F.col("shard")).cast("int").alias("shard"),
                        (F.col("version") + 1).alias("version"), "bytes", "rows", "dealt")


def write_map(slot_map: DataFrame, path: str) -> None:
    """Append this version; earlier versions stay readable."""
    slot_map.write.partitionBy("version").mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the latest if none is named. The map of an empty table has no files, so its schema is given."""
    stored = spark.read.schema(_MAP).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version)


def placed(slotted: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """``slotted`` with shard and slot, the record's place in its shard (gapless from 0).

    Records are numbered within their virtual slot; the map's row counts give each
    slot its first place, so no shard is ever sorted as a whole.
    """
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    slotted = slotted.drop("shard", *({"slot"} - set(order)))
    start, number = unused(slotted, "start", "number")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order)) - 1
    return (slotted.withColumn(number, place).join(F.broadcast(starts.withColumnRenamed("start", start)), "virtual_slot")  # N_SLOTS rows at most
            .withColumn("slot", (F.col(start) + F.col(number)).cast("long")).drop(start, number))
