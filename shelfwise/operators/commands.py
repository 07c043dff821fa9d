"""Batches of cellar commands: add, top up, patch, take out.

A command names its cellar and carries ``seq``, its position in the cellar's
stream of commands. Values a user gives travel as ``fields MAP<STRING,STRING>``:
a key that is absent is left as it is, a key with NULL clears. Each operator
returns new rows and, separately, refused commands with a reason.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise import spec
from shelfwise.functions import cellar as rules
from shelfwise.functions.strings import strip
from shelfwise.operators import placement
from shelfwise.operators.running import numbered, previous_value, running_sum
from shelfwise.sources.scratch import staged

KEYS = ["cellar_id", "wine_id"]
# Commands per block when a wine's commands are numbered or summed in parallel.
BLOCK_ROWS = 10_000


def given(field: str, fields: str = "fields") -> Column:
    """True where a command mentions the field, NULL value included."""
    return F.coalesce(F.map_contains_key(F.col(fields), field), F.lit(False))


def value_of(field: str, kind: str, fields: str = "fields") -> Column:
    raw = F.try_element_at(F.col(fields), F.lit(field))
    if field == "purchase_currency":
        raw = rules.normal_currency(raw)
    return raw if kind == "string" else raw.try_cast(kind)


def mistyped(kinds: dict[str, str]) -> Column:
    """True where a given value is no value of its field's type (NULL is: it clears)."""
    wrong = [F.try_element_at("fields", F.lit(f)).isNotNull() & value_of(f, kind).isNull()
             for f, kind in kinds.items() if kind != "string"]
    return functools.reduce(lambda a, b: a | b, wrong)


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def field_problems() -> list[tuple[str, Column]]:
    """Rules a command's own fields must meet, as (reason, broken)."""
    frm, until = value_of("drink_from", "int"), value_of("drink_until", "int")
    return [
        ("not a number", mistyped(spec.WINE_FIELDS)),
        ("profile needs sources",
         _filled(value_of("profile", "string")) & ~_filled(value_of("profile_sources", "string"))),
        ("window runs backwards", F.coalesce(frm > until, F.lit(False))),
        ("invalid date", ~(rules.valid_partial_date(value_of("purchased_on", "string"))
                           & rules.valid_partial_date(value_of("disgorged_on", "string")))),
    ]


def first_problem(problems: list[tuple[str, Column]]) -> Column:
    reason = F.lit(None).cast("string")
    for text, broken in reversed(problems):
        reason = F.when(broken, F.lit(text)).otherwise(reason)
    return reason


def block_of(seq: str = "seq") -> Column:
    return F.floor(F.col(seq) / BLOCK_ROWS)


# --- adding -----------------------------------------------------------------

MIRROR_COLUMNS = ("product_id", "product_number", "full_name", "producer", "vintage", "country", "origin1", "origin2",
                  "cat2", "volume_ml", "abv", "sugar_g_per_100ml", "taste", *spec.CLOCKS)


def _mirror(products: DataFrame, grapes: DataFrame) -> DataFrame:
    named = grapes.groupBy(F.col("product_id").alias("_gid")).agg(
        F.array_join(F.array_sort(F.collect_set("grape")), ", ").alias("grapes"))
    base = products.select(*MIRROR_COLUMNS).join(named, F.col("product_id") == F.col("_gid"), "left")
    return base.select(*[F.col(c).alias(f"m_{c}") for c in (*MIRROR_COLUMNS, "grapes")])


def resolve_adds(adds: DataFrame, products: DataFrame, grapes: DataFrame) -> DataFrame:
    """Look every add up and fill in what the catalogue knows.

    ``adds``: cellar_id, seq, product_id, product_number, quantity, fields. Where
    both an id and a number are given they must be the same product's. The result
    has one column per wine field, ``listed_vintage``, ``other_vintage`` (the
    catalogue lists another vintage, so its note and figures were not copied) and
    ``reason`` (NULL when accepted).

    Adds by id and adds by number are joined separately, and adds by name not at
    all, so no join sees a NULL key.
    """
    mirror = _mirror(products, grapes)
    by_id = adds.filter(F.col("product_id").isNotNull()).join(
        mirror, (F.col("product_id") == F.col("m_product_id"))
        & (F.col("product_number").isNull() | (F.col("product_number") == F.col("m_product_number"))), "left")
    numbers = mirror.filter(F.col("m_product_number").isNotNull())
    first = numbers.groupBy("m_product_number").agg(F.min_by(
        F.struct(*[c for c in mirror.columns if c != "m_product_number"]), "m_product_id").alias("_m"))
    first = first.select("m_product_number", "_m.*").select(*mirror.columns)
    by_number = adds.filter(F.col("product_id").isNull() & F.col("product_number").isNotNull()).join(
        first, F.col("product_number") == F.col("m_product_number"), "left")
    by_name = adds.filter(F.col("product_id").isNull() & F.col("product_number").isNull())
    by_name = by_name.select(*adds.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in mirror.schema])
    found = by_id.unionByName(by_number).unionByName(by_name)

    listed = F.col("m_vintage").cast("int")
    vintage = F.when(given("vintage"), value_of("vintage", "int")).otherwise(listed)
    same = F.col("m_product_id").isNotNull() & vintage.eqNullSafe(listed)
    region = F.nullif(F.concat_ws(", ", F.when(F.col("m_origin1") != "", F.col("m_origin1")),
                                  F.when(F.col("m_origin2") != "", F.col("m_origin2"))), F.lit(""))
    unrated = F.lit(True)
    for clock in spec.CLOCKS:
        unrated = unrated & (F.coalesce(F.col(f"m_{clock}"), F.lit(0)) == 0)
    catalogue = {
        "name": F.col("m_full_name"), "producer": F.col("m_producer"), "vintage": listed,
        "country": F.col("m_country"), "region": region, "category": F.col("m_cat2"),
        "grapes": F.col("m_grapes"), "volume_ml": F.col("m_volume_ml").try_cast("int"),
        "abv": F.when(same, F.col("m_abv")),
        "sugar_g_l": F.when(same, F.floor(F.col("m_sugar_g_per_100ml") * 100 + 0.5) / 10),
    }
    columns = []
    for field, kind in spec.WINE_FIELDS.items():
        default = catalogue.get(field, F.lit(None)).cast(kind)
        columns.append(F.when(given(field), value_of(field, kind)).otherwise(default).alias(field))
    asked = F.col("product_id").isNotNull() | F.col("product_number").isNotNull()
    missing = asked & F.col("m_product_id").isNull()
    name = F.when(given("name"), value_of("name", "string")).otherwise(F.col("m_full_name"))
    reason = first_problem([
        ("no such product", missing),
        ("quantity out of range", ~F.coalesce(F.col("quantity").between(1, spec.MAX_BOTTLES_PER_COMMAND), F.lit(False))),
        ("needs a name", ~_filled(name)),
        *field_problems(),
    ])
    return found.select(
        "cellar_id", "seq", F.col("m_product_id").alias("product_id"),
        F.col("m_product_number").alias("product_number"), "quantity", "fields", *columns,
        F.when(same, F.col("m_taste")).alias("sb_taste"),
        *[F.when(same & ~unrated, F.col(f"m_{c}").cast("int")).alias(c) for c in spec.CLOCKS],
        listed.alias("listed_vintage"),
        (F.col("m_product_id").isNotNull() & ~same).alias("other_vintage"),
        reason.alias("reason"))


@dataclass(frozen=True)
class Applied:
    """The outcome of a batch: the new state, ledger rows to append, refused commands."""

    wines: DataFrame
    events: DataFrame
    rejects: DataFrame


def _event(df: DataFrame, kind: str, quantity: Column, reason: Column | None = None, on_date: Column | None = None,
           rating: Column | None = None, note: Column | None = None) -> DataFrame:
    return df.select(
        "cellar_id", "wine_id", "seq", F.lit(kind).alias("kind"),
        (reason if reason is not None else F.lit(None)).cast("string").alias("reason"),
        quantity.cast("int").alias("quantity"), on_date.alias("on_date"),
        (rating if rating is not None else F.lit(None)).cast("int").alias("rating"),
        (note if note is not None else F.lit(None)).cast("string").alias("note"))


def _judged_places(commands: DataFrame, judged: DataFrame) -> DataFrame:
    """``commands`` with the refusals of ``judged`` and, where a wine was moved, its place as it is stored."""
    joined = commands.join(judged.select(F.col("cellar_id").alias("_c"), F.col("seq").alias("_s"), F.col("reason").alias("_refused"), "moved", "place"),
                           (F.col("cellar_id") == F.col("_c")) & (F.col("seq") == F.col("_s")), "left")
    others = F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, _: k != "location")
    fields = F.when(F.coalesce("moved", F.lit(False)), F.map_concat(others, F.create_map(F.lit("location"), F.col("place")))).otherwise(F.col("fields"))
    changed = {"fields": fields, "reason": F.coalesce("reason", "_refused")}
    if "location" in commands.columns:
        changed["location"] = F.when(F.coalesce("moved", F.lit(False)), F.col("place")).otherwise(F.col("location"))
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in commands.columns])


def place_adds(resolved: DataFrame, wines: DataFrame, racks: DataFrame) -> DataFrame:
    """Resolved adds whose places are judged in order, those refused with their reason.

    Adds of one catalogue wine and vintage are one wine, held or new; an add by name is a
    wine of its own. Wines that neither are in slots nor are given slots are not walked.
    """
    held = (wines.filter(F.col("product_id").isNotNull())
            .groupBy(F.col("cellar_id").alias("h_cellar"), F.col("product_id").alias("h_product"), F.col("vintage").alias("h_vintage"))
            .agg(F.min(F.struct("wine_id", "location")).alias("_held")))
    good = resolved.filter(F.col("reason").isNull()).join(racks.select("cellar_id").distinct(), "cellar_id", "left_semi")
    own = F.col("product_id").isNotNull()
    listed = good.filter(own).join(held, (F.col("cellar_id") == F.col("h_cellar")) & (F.col("product_id") == F.col("h_product"))
                                   & F.col("vintage").eqNullSafe(F.col("h_vintage")), "left")
    new_wine = F.concat_ws("/", F.lit("product"), F.col("product_id").cast("string"), F.col("vintage").cast("string"))
    of_wine = F.when(F.col("_held").isNull(), new_wine).otherwise(F.concat(F.lit("wine/"), F.col("_held.wine_id").cast("string")))
    columns = ["cellar_id", "seq", F.lit(True).alias("adds"), "quantity", given("location").alias("moves"), value_of("location", "string").alias("location")]
    asked = (listed.select(*columns, of_wine.alias("wine"), F.col("_held.location").alias("_at"))
             .unionByName(good.filter(~own).select(*columns, F.concat(F.lit("add/"), F.col("seq").cast("string")).alias("wine"), F.lit(None).cast("string").alias("_at"))))
    in_slots = lambda c: F.size(rules.slots_in(F.col(c))) > 0
    asked = staged(asked.withColumn("_slots", in_slots("location") | in_slots("_at")), "adds-asked")
    walked = asked.groupBy("cellar_id", "wine").agg(F.max("_slots").alias("_slots")).filter("_slots").drop("_slots")
    state = wines.select("cellar_id", F.concat(F.lit("wine/"), F.col("wine_id").cast("string")).alias("wine"), "quantity", "location")
    judged = placement.judge(asked.drop("_slots", "_at").join(walked, ["cellar_id", "wine"], "left_semi"), state, racks)
    return _judged_places(resolved, judged)


def top_up(resolved: DataFrame, wines: DataFrame, racked: DataFrame, today: date, racks: DataFrame | None = None) -> Applied:
    """Apply resolved adds to the cellars.

    A catalogue wine already held in the same vintage (an unknown vintage equals
    an unknown one) is topped up -- the lowest id, and only fields the command
    gave are changed; later commands win. Adds by name always make a new wine.
    Adds of one new wine make one row. A wine kept in rack slots is refused
    unless the command says where the new bottles went. ``racked`` has the
    cellar_ids with a rack. With the rack table ``racks`` every command's places are
    judged as well, in ``seq`` order (``place_adds``).
    """
    resolved = staged(resolved, "adds-resolved")
    if racks is not None:
        resolved = staged(place_adds(resolved, wines, racks), "adds-placed")
    good = resolved.filter(F.col("reason").isNull())
    has_rack = racked.select(F.col("cellar_id").alias("_racked")).distinct()
    held = (wines.filter(F.col("product_id").isNotNull())
            .groupBy(F.col("cellar_id").alias("h_cellar"), F.col("product_id").alias("h_product"),
                     F.col("vintage").alias("h_vintage"))
            .agg(F.min(F.struct("wine_id", "location")).alias("_held")))
    listed = good.filter(F.col("product_id").isNotNull()).join(
        held, (F.col("cellar_id") == F.col("h_cellar")) & (F.col("product_id") == F.col("h_product"))
        & F.col("vintage").eqNullSafe(F.col("h_vintage")), "left").join(
        has_rack, F.col("cellar_id") == F.col("_racked"), "left")
    homeless = (F.col("_held").isNotNull() & F.col("_racked").isNotNull() & ~given("location")
                & (F.size(rules.slots_in(F.col("_held.location"))) > 0)) if racks is None else F.lit(False)
    # Looked up once; the new state, the events and the rejects all read this.
    listed = staged(listed.withColumn("reason", F.when(homeless, F.lit("needs a slot for each bottle")))
                    .select(*resolved.columns, F.col("_held.wine_id").alias("_old")), "adds-listed")
    rejects = resolved.filter(F.col("reason").isNotNull()).select("cellar_id", "seq", "reason").unionByName(
        listed.filter(F.col("reason").isNotNull()).select("cellar_id", "seq", "reason"))
    accepted = listed.filter(F.col("reason").isNull())

    row_fields = [f for f in wines.columns if f in resolved.columns and f not in ("cellar_id", "quantity")]
    overlay = [F.max_by(F.struct(value_of(f, k).alias("v")), F.when(given(f), F.col("seq"))).alias(f"o_{f}")
               for f, k in spec.WINE_FIELDS.items()]
    group = ["cellar_id", "product_id", "vintage"]
    grouped = staged(accepted.groupBy(*group).agg(
        F.sum("quantity").cast("int").alias("_added"), F.min("_old").alias("_old"), F.min("seq").alias("_seq"),
        F.min_by(F.struct(*row_fields), "seq").alias("_first"), *overlay), "adds-grouped")

    def overlaid(field: str, base: Column) -> Column:
        if field not in spec.WINE_FIELDS or field == "vintage":
            return base
        return F.when(F.col(f"o_{field}").isNotNull(), F.col(f"o_{field}.v")).otherwise(base)

    stamp = F.lit(today).cast("timestamp")
    profiled = F.when(F.col("o_profile").isNotNull(),
                      F.when(_filled(F.col("o_profile.v")), F.lit(today.isoformat())))

    def state(df: DataFrame, base: str, wine_id: Column, quantity: Column) -> DataFrame:
        out = []
        for c in wines.columns:
            known = c in row_fields or base == "old"
            was = F.col(f"{base}.{c}" if base == "old" else f"_first.{c}") if known else F.lit(None)
            if c == "cellar_id":
                out.append(F.col("cellar_id"))
            elif c == "wine_id":
                out.append(wine_id.cast("bigint").alias(c))
            elif c == "quantity":
                out.append(quantity.cast("int").alias(c))
            elif c == "profiled_on":
                out.append((F.coalesce(profiled, F.lit(None).cast("string")) if base != "old" else
                            F.when(F.col("o_profile").isNotNull(), profiled).otherwise(was)).alias(c))
            elif c == "updated_at" or (c == "added_at" and base != "old"):
                out.append(stamp.alias(c))
            else:
                out.append(overlaid(c, was).cast(wines.schema[c].dataType).alias(c))
        return df.select(*out)

    topped_groups = grouped.filter(F.col("_old").isNotNull())
    old = wines.select(F.col("cellar_id").alias("w_cellar"), F.col("wine_id").alias("w_id"),
                       F.struct(*wines.columns).alias("old"))
    on_old = (F.col("cellar_id") == F.col("w_cellar")) & (F.col("_old") == F.col("w_id"))
    topped = state(topped_groups.join(old, on_old), "old", F.col("_old"), F.col("old.quantity") + F.col("_added"))

    # New wines: one per new catalogue wine, one per add by name, numbered after
    # the cellar's highest id in the order of their first command.
    fresh = grouped.filter(F.col("_old").isNull()).select(
        "cellar_id", "_seq", "_added", "_first", *[f"o_{f}" for f in spec.WINE_FIELDS])
    named = good.filter(F.col("product_id").isNull()).select(
        "cellar_id", F.col("seq").alias("_seq"), F.col("quantity").cast("int").alias("_added"),
        F.struct(*row_fields).alias("_first"),
        *[F.when(given(f), F.struct(value_of(f, k).alias("v"))).alias(f"o_{f}") for f, k in spec.WINE_FIELDS.items()])
    new = numbered(fresh.unionByName(named).withColumn("_block", block_of("_seq")),
                   ["cellar_id"], "_block", ["_seq"], "_nth")
    highest = wines.groupBy(F.col("cellar_id").alias("x_cellar")).agg(F.max("wine_id").alias("_max"))
    new = staged(new.join(highest, F.col("cellar_id") == F.col("x_cellar"), "left").withColumn(
        "_id", F.coalesce("_max", F.lit(0)) + F.col("_nth")), "adds-new")
    added = state(new, "first", F.col("_id"), F.col("_added"))

    untouched = wines.join(topped.select(*KEYS), KEYS, "left_anti")
    state_after = untouched.unionByName(topped).unionByName(added)

    ids = new.select(F.col("cellar_id").alias("n_cellar"), F.col("_seq").alias("n_seq"), F.col("_id").alias("n_id"))
    firsts = grouped.filter(F.col("_old").isNull()).select(
        F.col("cellar_id").alias("f_cellar"), F.col("product_id").alias("f_product"),
        F.col("vintage").alias("f_vintage"), F.col("_seq").alias("f_seq"))
    day = F.lit(today)
    to_old = accepted.filter(F.col("_old").isNotNull()).select(
        "cellar_id", F.col("_old").alias("wine_id"), "seq", "quantity")
    to_new = (accepted.filter(F.col("_old").isNull())
              .join(firsts, (F.col("cellar_id") == F.col("f_cellar")) & (F.col("product_id") == F.col("f_product"))
                    & F.col("vintage").eqNullSafe(F.col("f_vintage")))
              .join(ids, (F.col("cellar_id") == F.col("n_cellar")) & (F.col("f_seq") == F.col("n_seq")))
              .select("cellar_id", F.col("n_id").alias("wine_id"), "seq", "quantity"))
    to_named = (good.filter(F.col("product_id").isNull())
                .join(ids, (F.col("cellar_id") == F.col("n_cellar")) & (F.col("seq") == F.col("n_seq")))
                .select("cellar_id", F.col("n_id").alias("wine_id"), "seq", "quantity"))
    events = _event(to_old.unionByName(to_new).unionByName(to_named), "added", F.col("quantity"), on_date=day)
    return Applied(state_after, events, rejects)


def apply_adds(adds: DataFrame, products: DataFrame, grapes: DataFrame, wines: DataFrame, racked: DataFrame,
               today: date, racks: DataFrame | None = None) -> Applied:
    """``resolve_adds`` then ``top_up``."""
    return top_up(resolve_adds(adds, products, grapes), wines, racked, today, racks)


# --- patching ---------------------------------------------------------------

def place_patches(judged: DataFrame, wines: DataFrame, racks: DataFrame) -> DataFrame:
    """Patches that are not refused yet, with their places judged in order."""
    asked = (judged.filter(F.col("reason").isNull() & (given("location") | given("quantity")))
             .join(racks.select("cellar_id").distinct(), "cellar_id", "left_semi")
             .select("cellar_id", "seq", F.col("wine_id").cast("string").alias("wine"), F.lit(False).alias("adds"),
                     value_of("quantity", "int").alias("quantity"), given("location").alias("moves"), value_of("location", "string").alias("location")))
    state = wines.select("cellar_id", F.col("wine_id").cast("string").alias("wine"), "quantity", "location")
    return _judged_places(judged, placement.judge(asked, state, racks))


def apply_patch(patches: DataFrame, wines: DataFrame, racked: DataFrame, today: date, racks: DataFrame | None = None) -> Applied:
    """Edit wines. ``patches``: cellar_id, wine_id, seq, fields (``quantity`` too).

    Several patches of one wine merge field by field, the later winning. A change
    of vintage clears the copied note and clocks. Each change of the count is a
    signed ``adjusted`` event. A recount of a wine in rack slots must say where
    the bottles are. With the rack table ``racks`` the patches of a cellar are judged
    in ``seq`` order, each against the counts and places the accepted ones before it left.
    """
    has_rack = racked.select(F.col("cellar_id").alias("_racked")).distinct()
    # Every column of the old row at its renamed place, so patches and wines never clash.
    old = wines.select(F.col("cellar_id").alias("w_cellar"), F.col("wine_id").alias("w_id"),
                       F.struct(*wines.columns).alias("old"))
    quantity = value_of("quantity", "int")
    before = patches.join(old.select("w_cellar", "w_id", F.col("old.quantity").alias("_was"),
                                     F.col("old.vintage").alias("_vintage"), F.col("old.location").alias("_location")),
                          (F.col("cellar_id") == F.col("w_cellar")) & (F.col("wine_id") == F.col("w_id")), "left")
    before = before.join(has_rack, F.col("cellar_id") == F.col("_racked"), "left")
    reason = first_problem([
        ("no such wine", F.col("w_id").isNull()),
        ("name cannot be cleared", given("name") & ~_filled(value_of("name", "string"))),
        ("quantity out of range", given("quantity") & ~F.coalesce(quantity.between(0, spec.MAX_COUNT), F.lit(False))),
        ("needs a slot for each bottle",
         F.lit(racks is None) & F.col("_racked").isNotNull() & given("quantity") & ~given("location") & (quantity > 0)
         & (quantity != F.col("_was")) & (F.size(rules.slots_in(F.col("_location"))) > 0)),
        *field_problems(),
    ])
    judged = staged(before.withColumn("reason", reason).select(*patches.columns, "_was", "_vintage", "reason"), "patches-judged")
    if racks is not None:
        judged = staged(place_patches(judged, wines, racks), "patches-placed")
    rejects = judged.filter(F.col("reason").isNotNull()).select(*KEYS, "seq", "reason")
    good = judged.filter(F.col("reason").isNull())

    fields = {**spec.WINE_FIELDS, "quantity": "int"}
    merged = good.groupBy(*KEYS).agg(
        *[F.max_by(F.struct(value_of(f, k).alias("v")), F.when(given(f), F.col("seq"))).alias(f"o_{f}")
          for f, k in fields.items()],
        F.max(given("vintage") & ~value_of("vintage", "int").eqNullSafe(F.col("_vintage"))).alias("_moved"))
    merged = staged(merged, "patches-merged")
    joined = merged.join(old, (F.col("cellar_id") == F.col("w_cellar")) & (F.col("wine_id") == F.col("w_id"))).join(
        has_rack, F.col("cellar_id") == F.col("_racked"), "left")
    copied = ("sb_taste", *spec.CLOCKS)

    def new_value(c: str) -> Column:
        was = F.col(f"old.{c}")
        now = F.when(F.col(f"o_{c}").isNotNull(), F.col(f"o_{c}.v")).otherwise(was) if c in fields else was
        if c in copied:
            now = F.when(~F.col("_moved"), was)
        if c == "profiled_on":
            now = F.when(F.col("o_profile").isNotNull(),
                         F.when(_filled(F.col("o_profile.v")), F.lit(today.isoformat()))).otherwise(was)
        if c == "location":
            from shelfwise.operators.rack import normal_location

            count = F.coalesce("o_quantity.v", "old.quantity")
            now = F.when(F.col("o_location").isNotNull() | F.col("o_quantity").isNotNull(),
                         normal_location(now, F.col("_racked").isNotNull(), count)).otherwise(now)
        if c == "updated_at":
            now = F.lit(today).cast("timestamp")
        return now.cast(wines.schema[c].dataType).alias(c)

    changed = joined.select(*KEYS, *[new_value(c) for c in wines.columns if c not in KEYS]).select(*wines.columns)
    untouched = wines.join(merged.select(*KEYS), KEYS, "left_anti")

    counts = good.filter(given("quantity")).select(*KEYS, "seq", quantity.alias("_now"), "_was", block_of().alias("_block"))
    chained = previous_value(counts, KEYS, "_block", "seq", "_now", "_prev")
    step = F.col("_now") - F.coalesce("_prev", "_was")
    events = _event(chained.filter(step != 0), "adjusted", step, on_date=F.lit(today))
    return Applied(untouched.unionByName(changed), events, rejects)


# --- taking out -------------------------------------------------------------

def _drop_slots(parts: Column, taken: Column) -> Column:
    """``parts`` without one occurrence of each taken slot."""
    def drop(left: Column, slot: Column) -> Column:
        at = F.array_position(left, slot).cast("int")
        return F.when(at > 0, F.concat(F.slice(left, F.lit(1), at - 1),
                                       F.slice(left, at + 1, F.size(left)))).otherwise(left)
    return F.aggregate(taken, parts, drop)


def _is_open(parts: Column) -> Column:
    """One place at most, or no slot among them: nobody has to say which."""
    return (F.size(parts) <= 1) | ~F.exists(parts, rules.is_slot)


def _fold(commands: DataFrame, named: bool) -> DataFrame:
    """Sequential decisions for wines with few commands left: (KEYS, seqs accepted, trail).

    ``trail`` has the balance after each accepted command and whether taking a
    bottle without naming its place has become unambiguous.
    """
    taken = F.col("slots") if named else F.array().cast("array<string>")
    ordered = commands.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("seq", "quantity", taken.alias("slots")))).alias("_list"),
        F.first("balance").alias("balance"), F.first("parts").alias("parts"))
    start = F.struct(F.col("balance").cast("bigint").alias("bal"), F.col("parts").alias("parts"),
                     F.array().cast("array<struct<seq:bigint,bal:bigint,open:boolean>>").alias("ok"))

    def step(s: Column, c: Column) -> Column:
        q = c["quantity"].cast("bigint")
        size = F.coalesce(F.size(c["slots"]), F.lit(0))
        present = F.forall(c["slots"], lambda x: F.array_contains(s["parts"], x))
        fits = (q <= s["bal"]) & ((size <= 0) | (present & (size == q)))
        left = F.when(size > 0, _drop_slots(s["parts"], c["slots"])).otherwise(s["parts"])
        return F.when(fits, F.struct(
            (s["bal"] - q).alias("bal"), left.alias("parts"),
            F.concat(s["ok"], F.array(F.struct(c["seq"].cast("bigint").alias("seq"), (s["bal"] - q).alias("bal"),
                                               _is_open(left).alias("open")))).alias("ok"))).otherwise(s)

    return ordered.select(*KEYS, F.aggregate("_list", start, step)["ok"].alias("trail"))


def _decide_plain(commands: DataFrame) -> DataFrame:
    """(KEYS, seq) accepted, where the only rule is 'no more than held'.

    The balance only falls, so everything up to the first refusal is the longest
    run whose running total fits; it is found with block-wise running sums. After
    it fewer bottles are left than that refused command asked for, hence fewer
    than the largest permitted command: of each quantity only the first few
    commands can still be accepted, and folding those is bounded per wine.
    """
    fitting = commands.filter(F.col("quantity") <= F.col("balance"))
    total = staged(running_sum(fitting.withColumn("_block", block_of()).select(*KEYS, "_block", "seq", "quantity", "balance", "parts"),
                               KEYS, "_block", ["seq"], F.col("quantity"), "_upto"), "removals-running")
    run = total.filter(F.col("_upto") <= F.col("balance"))
    spent = total.groupBy(*KEYS).agg(
        F.max(F.when(F.col("_upto") <= F.col("balance"), F.col("_upto"))).alias("_spent"),
        F.min(F.when(F.col("_upto") > F.col("balance"), F.col("seq"))).alias("_refused"))
    later = total.join(spent.filter(F.col("_refused").isNotNull()).hint("merge"), KEYS)
    left = F.col("balance") - F.coalesce("_spent", F.lit(0))
    tail = later.filter((F.col("seq") > F.col("_refused")) & (F.col("quantity") <= left)).withColumn("balance", left)
    from pyspark.sql import Window

    w = Window.partitionBy(*KEYS, "quantity").orderBy("seq")
    few = (tail.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= spec.MAX_BOTTLES_PER_COMMAND)
           .filter(F.col("_nth") <= F.floor(F.col("balance") / F.col("quantity"))))
    folded = _fold(few.withColumn("slots", F.array().cast("array<string>")), named=False)
    return run.select(*KEYS, "seq").unionByName(folded.select(*KEYS, F.explode("trail.seq").alias("seq")))


def _first_of_each(commands: DataFrame) -> DataFrame:
    """Of commands naming the same slots the first: once they are empty the rest are refused."""
    others = [c for c in commands.columns if c not in (*KEYS, "slots", "quantity", "seq")]
    picked = commands.groupBy(*KEYS, "slots", "quantity").agg(
        F.min("seq").alias("seq"), *[F.first(c).alias(c) for c in others])
    return picked.select(*commands.columns)


def _decide_racked(commands: DataFrame) -> DataFrame:
    """(KEYS, seq) accepted, for wines kept in slots of a rack, one bottle per place.

    Commands naming slots are few once repeats are gone and are folded. A command
    naming none can only take everything that is left, so it is compared with the
    balance at its time; the first that matches empties the wine.
    """
    named = commands.filter(F.size("slots") > 0)
    possible = named.filter((F.size("slots") == F.col("quantity")) & (F.size(F.array_except("slots", "parts")) == 0))
    trail = _fold(_first_of_each(possible), named=True)
    unnamed = commands.filter(F.size("slots") == 0).join(trail, KEYS, "left")
    before = F.filter(F.coalesce("trail", F.array().cast("array<struct<seq:bigint,bal:bigint,open:boolean>>")),
                      lambda t: t["seq"] < F.col("seq"))
    balance = F.coalesce(F.try_element_at(before, F.lit(-1))["bal"], F.col("balance"))
    last = unnamed.filter((F.col("quantity") == balance)).groupBy(*KEYS).agg(F.min("seq").alias("_last"))
    kept = trail.join(last, KEYS, "left").select(*KEYS, "_last", F.explode("trail.seq").alias("seq"))
    kept = kept.filter(F.col("_last").isNull() | (F.col("seq") < F.col("_last"))).select(*KEYS, "seq")
    return kept.unionByName(last.select(*KEYS, F.col("_last").alias("seq")))


def _judged_removals(commands: DataFrame, wines: DataFrame, racked: DataFrame) -> DataFrame:
    """``commands`` with their wine's balance, places and rack, and what is wrong with them before any order counts.

    Spark guesses the wines' size from their files; places split into lists take some forty times that, so a
    broadcast would hold hundreds of megabytes in every executor before the guess forbids it. Hence the merge joins
    here and wherever a side has a row per wine or command and comes from files.
    """
    has_rack = racked.select(F.col("cellar_id").alias("_racked")).distinct()
    held = wines.select(*KEYS, F.col("quantity").alias("balance"), "location",
                        rules.location_parts(F.col("location")).alias("parts")).withColumn(
        "_in_slots", F.size(F.filter("parts", rules.is_slot)) > 0)
    tidy = F.transform(F.coalesce("slots", F.array().cast("array<string>")), lambda s: F.upper(strip(s)))
    asked = (commands.withColumn("slots", tidy)
             .join(held.withColumn("_found", F.lit(True)).hint("merge"), KEYS, "left")
             .join(has_rack, F.col("cellar_id") == F.col("_racked"), "left"))
    in_range = F.coalesce(F.col("quantity").between(1, spec.MAX_BOTTLES_PER_COMMAND), F.lit(False))
    valid_reason = F.coalesce(F.col("reason").isin(*spec.REMOVAL_REASONS), F.lit(False))
    valid_rating = F.col("rating").isNull() | F.col("rating").between(1, 5)
    problem = first_problem([
        ("no such wine", F.col("_found").isNull()),
        ("quantity out of range", ~in_range),
        ("unknown reason", ~valid_reason),
        ("rating out of range", ~valid_rating),
        ("more than held", F.col("quantity") > F.col("balance")),
    ])
    return asked.withColumn("_problem", problem)


def apply_removals(commands: DataFrame, wines: DataFrame, racked: DataFrame, today: date) -> Applied:
    """Take bottles out, in ``seq`` order per wine; a refused command changes nothing.

    ``commands``: cellar_id, wine_id, seq, quantity, reason, on_date, rating, note,
    slots. Refused when more is asked than held, when a named slot does not hold
    the wine or the slots do not number the bottles, and -- in a cellar with a
    rack -- when a wine spread over several places is taken from without saying
    which, unless it is all of it.
    """
    judged = staged(_judged_removals(commands, wines, racked), "removals-judged")
    valid = judged.filter(F.col("_problem").isNull())

    # One bottle per place is what every write to a racked cellar guarantees. Where two places or more
    # are no slots, a command may leave only those, and nobody has to say which any more.
    loose_places = F.size(F.filter("parts", lambda p: ~rules.is_slot(p)))
    in_rack = (F.col("_racked").isNotNull() & F.col("_in_slots") & (F.size("parts") == F.col("balance"))
               & (loose_places < 2))
    racked_cmds = valid.filter(in_rack)
    loose = valid.filter(~in_rack)
    naming = loose.filter(F.size("slots") > 0).select(*KEYS).distinct()
    ambiguous = F.col("_racked").isNotNull() & F.col("_in_slots")
    special = naming.unionByName(loose.filter(ambiguous).select(*KEYS)).distinct()
    plain = loose.join(special, KEYS, "left_anti")
    mixed = loose.join(special, KEYS, "left_semi")
    accepted = staged(_decide_plain(plain).unionByName(_decide_racked(racked_cmds)).unionByName(_decide_mixed(mixed)),
                      "removals-accepted")

    took = accepted.select(F.col("cellar_id").alias("a_cellar"), F.col("wine_id").alias("a_wine"),
                           F.col("seq").alias("a_seq"))
    decided = judged.join(took.hint("merge"), (F.col("cellar_id") == F.col("a_cellar")) & (F.col("wine_id") == F.col("a_wine"))
                          & (F.col("seq") == F.col("a_seq")), "left")
    done = decided.filter(F.col("a_seq").isNotNull())
    refused = decided.filter(F.col("a_seq").isNull()).select(
        *KEYS, "seq", F.coalesce("_problem", F.lit("not held, or the place is unclear")).alias("reason"))
    events = _event(done, "removed", -F.col("quantity"), F.col("reason"),
                    F.coalesce(F.col("on_date"), F.lit(today)), F.col("rating"), F.col("note"))

    # Slots taken from a wine are at most its places, so gathering them is bounded.
    taken = done.groupBy(F.col("cellar_id").alias("t_cellar"), F.col("wine_id").alias("t_wine")).agg(
        F.sum("quantity").cast("int").alias("_out"),
        F.flatten(F.collect_list(F.when(F.size("slots") > 0, F.col("slots")))).alias("_slots"),
        (F.max_by(F.size("slots"), "seq") > 0).alias("_last_named"))
    joined = wines.join(taken.hint("merge"), (F.col("cellar_id") == F.col("t_cellar")) & (F.col("wine_id") == F.col("t_wine")), "left")
    parts = rules.location_parts(F.col("location"))
    remaining = _drop_slots(parts, F.coalesce("_slots", F.array().cast("array<string>")))
    # The last bottle leaves its slots; a command that named its slots has said what is left.
    emptied = (~F.col("_last_named") & (F.size(F.filter(remaining, rules.is_slot)) > 0)
               & (F.col("quantity") == F.col("_out")))
    location = F.when(F.col("t_wine").isNull(), F.col("location")).when(emptied, F.lit(None).cast("string")).when(
        F.size("_slots") > 0, F.nullif(F.array_join(remaining, ", "), F.lit(""))).otherwise(F.col("location"))
    after = joined.select(*[
        (F.col("quantity") - F.coalesce("_out", F.lit(0))).cast("int").alias(c) if c == "quantity"
        else location.alias(c) if c == "location"
        else F.when(F.col("t_wine").isNotNull(), F.lit(today).cast("timestamp")).otherwise(F.col(c)).alias(c)
        if c == "updated_at" else F.col(c)
        for c in wines.columns])
    return Applied(after, events, refused)


def _decide_mixed(commands: DataFrame) -> DataFrame:
    """(KEYS, seq) accepted where slots are named outside a rack, or a racked wine's
    places do not match its bottles.

    Folded per wine, after dropping commands that cannot be accepted. Refusing is
    final for equal commands, so of each no more stay than the bottles held allow.
    The exception is a command without slots while its wine's places are ambiguous:
    it is accepted only when it takes all that is left, so the first such is kept.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*KEYS, "quantity", "slots").orderBy("seq")
    may = F.floor(F.col("balance") / F.col("quantity"))

    def few(df: DataFrame) -> DataFrame:
        return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= may).drop("_nth")

    ambiguous = F.col("_racked").isNotNull() & F.col("_in_slots")
    named = few(commands.filter(F.size("slots") > 0))
    free = few(commands.filter((F.size("slots") == 0) & ~ambiguous))
    trail = _fold(named.filter(ambiguous), named=True)
    waiting = commands.filter((F.size("slots") == 0) & ambiguous).join(trail, KEYS, "left")
    before = F.filter(F.coalesce("trail", F.array().cast("array<struct<seq:bigint,bal:bigint,open:boolean>>")),
                      lambda t: t["seq"] < F.col("seq"))
    last = F.try_element_at(before, F.lit(-1))
    waiting = waiting.withColumns({"_bal": F.coalesce(last["bal"], F.col("balance")),
                                   "_open": F.coalesce(last["open"], _is_open(F.col("parts")))})
    opened = few(waiting.filter("_open").select(*commands.columns))
    emptying = waiting.filter(~F.col("_open") & (F.col("quantity") == F.col("_bal"))).select(*commands.columns)
    rest = [c for c in commands.columns if c not in KEYS]
    first = emptying.groupBy(*KEYS).agg(F.min_by(F.struct(*rest), "seq").alias("_row")).select(
        *KEYS, "_row.*").select(*commands.columns)
    some = named.unionByName(free).unionByName(opened).unionByName(first)
    ordered = some.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("seq", "quantity", "slots"))).alias("_list"),
        F.first("balance").alias("balance"), F.first("parts").alias("parts"),
        F.first(F.col("_racked").isNotNull()).alias("_rack"))
    start = F.struct(F.col("balance").cast("bigint").alias("bal"), F.col("parts").alias("parts"),
                     F.array().cast("array<bigint>").alias("ok"))

    def step(s: Column, c: Column) -> Column:
        q = c["quantity"].cast("bigint")
        size = F.size(c["slots"])
        present = F.forall(c["slots"], lambda x: F.array_contains(s["parts"], x))
        unclear = (F.col("_rack") & F.exists(s["parts"], rules.is_slot) & (F.size(s["parts"]) > 1) & (q != s["bal"]))
        fits = (q <= s["bal"]) & F.when(size > 0, present & (size == q)).otherwise(~unclear)
        return F.when(fits, F.struct(
            (s["bal"] - q).alias("bal"),
            F.when(size > 0, _drop_slots(s["parts"], c["slots"])).otherwise(s["parts"]).alias("parts"),
            F.concat(s["ok"], F.array(c["seq"].cast("bigint"))).alias("ok"))).otherwise(s)

    return ordered.select(*KEYS, F.explode(F.aggregate("_list", start, step)["ok"]).alias("seq"))
