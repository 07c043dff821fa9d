"""Raw product JSON -> typed catalogue and child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shelfwise import spec
from shelfwise.functions import typed
from shelfwise.functions.strings import strip

READERS = {
    "text": lambda v, f: typed.null_if_empty(typed.text(v, f)),
    "string": typed.text,
    "flag": typed.flag,
    "number": typed.number,
    "integer": typed.integer,
    "vintage": typed.vintage,
}


def parsed_once(raw: DataFrame, raw_col: str) -> DataFrame:
    """``raw`` plus its text parsed as ``_v``; a generated column, since a filter above a plain one would parse every text again."""
    return raw.withColumn("_v", F.explode(F.array(F.try_parse_json(raw_col))))


def extract_typed(raw: DataFrame, raw_col: str = "raw", columns: tuple[spec.Column, ...] = spec.PRODUCT_COLUMNS,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """One typed column per specified JSON field, plus ``keep`` and the raw text."""
    v = F.col("_v")
    parsed = parsed_once(raw, raw_col)
    fields = [READERS[c.kind](v, c.source).alias(c.name) for c in columns if c.source]
    return parsed.select(*keep, F.col(raw_col), *fields)


def typed_columns(raw: DataFrame, fields: dict[str, tuple[str, str]], raw_col: str = "raw",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Like ``extract_typed`` for any set of ``{column: (kind, json field)}``."""
    columns = tuple(spec.Column(name, kind, source) for name, (kind, source) in fields.items())
    return extract_typed(raw, raw_col, columns, keep)


def with_availability(df: DataFrame, text_col: str = "assortment_text") -> DataFrame:
    """Tier and rank of an assortment text; an unknown text is order only.

    The lookup is a fixed seven-row constant, so it is folded into the plan as
    an expression and needs no join.
    """
    tier, rank = F.lit(spec.UNKNOWN_AVAILABILITY[0]), F.lit(spec.UNKNOWN_AVAILABILITY[1])
    key = strip(F.col(text_col))
    for name, (t, r) in spec.AVAILABILITY.items():
        tier = F.when(key == name, F.lit(t)).otherwise(tier)
        rank = F.when(key == name, F.lit(r)).otherwise(rank)
    return df.withColumn("availability", tier).withColumn("availability_rank", rank)


def with_tiers(df: DataFrame, tiers: DataFrame, key: str, text_col: str) -> DataFrame:
    """``with_availability`` for a caller's own lookup table (key, availability, availability_rank)."""
    lookup = tiers.select(F.col(key).alias("_tier_key"), F.col("availability").alias("_tier"),
                          F.col("availability_rank").alias("_rank"))
    joined = df.join(lookup, strip(F.col(text_col)) == F.col("_tier_key"), "left")
    return joined.select(
        *df.columns,
        F.coalesce("_tier", F.lit(spec.UNKNOWN_AVAILABILITY[0])).alias("availability"),
        F.coalesce("_rank", F.lit(spec.UNKNOWN_AVAILABILITY[1])).alias("availability_rank"),
    )


def canonical(df: DataFrame, col: str, synonyms: DataFrame, out: str) -> DataFrame:
    """Replace a name by its canonical form; an unknown name passes through trimmed.

    ``synonyms`` has (name, canonical). Spark broadcasts it by its own size
    estimate; a table too large for that is joined by shuffle.
    """
    lookup = synonyms.select(F.lower(strip(F.col("name"))).alias("_syn"), strip(F.col("canonical")).alias("_canonical"))
    joined = df.join(lookup, F.lower(strip(F.col(col))) == F.col("_syn"), "left")
    return joined.select(*df.columns, F.coalesce("_canonical", strip(F.col(col))).alias(out))


def explode_names(df: DataFrame, key: str, list_col: str) -> DataFrame:
    """(key, pos, name) for every non-blank element of a list."""
    exploded = df.select(key, F.posexplode(list_col).alias("pos", "_item"))
    return exploded.select(key, "pos", strip(F.col("_item")).alias("name")).filter(F.col("name") != "")


def grape_children(df: DataFrame, synonyms: DataFrame, key: str = "product_id", list_col: str = "grapes",
                   out: str = "grape") -> DataFrame:
    """(key, canonical, raw_name); of two raw names with one canonical the last listed wins."""
    named = canonical(explode_names(df, key, list_col), "name", synonyms, out)
    return named.groupBy(key, out).agg(F.max_by("name", "pos").alias("raw_name"))


def pairing_children(df: DataFrame, key: str = "product_id", list_col: str = "pairings",
                     out: str = "pairing") -> DataFrame:
    """Distinct (key, value) of a list column."""
    return explode_names(df, key, list_col).select(key, F.col("name").alias(out)).distinct()


def price_per_litre(price: Column, volume_ml: Column) -> Column:
    return F.when(volume_ml > 0, price / (volume_ml / F.lit(1000.0)))


def price_per_cl_alcohol(price: Column, volume_ml: Column, abv: Column) -> Column:
    return F.when((volume_ml > 0) & (abv > 0), price / (volume_ml * abv / F.lit(100.0) / F.lit(10.0)))


def with_derived_prices(df: DataFrame) -> DataFrame:
    """Price per litre and per centilitre of alcohol, NULL where volume or strength is zero."""
    price, volume, abv = F.col("price"), F.col("volume_ml"), F.col("abv")
    return df.withColumn("sek_per_litre", price_per_litre(price, volume)).withColumn(
        "sek_per_cl_alcohol", price_per_cl_alcohol(price, volume, abv))


def full_name(name: Column, thin: Column) -> Column:
    return strip(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(thin, F.lit(""))))


def backfill_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column from the raw text only where the table does not have it yet."""
    return df if name in df.columns else df.withColumn(name, value)


def backfill_release_columns(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """The release columns a table written before they existed can recover from its raw text."""
    v = F.try_parse_json(F.col(raw_col))
    for c in spec.PRODUCT_COLUMNS:
        if c.name in ("launch_date", "sell_start_time", "is_news", "is_web_launch", "assortment_code"):
            df = backfill_column(df, c.name, READERS[c.kind](v, c.source))
    return df


def normalise(raw: DataFrame, raw_col: str = "raw", synced_at: str = "synced_at",
              keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw records -> the full product row with its two list columns, ids required.

    ``raw`` carries the JSON text and the run's timestamp; ``keep`` names other
    columns to pass on (slice, pass, position) for deduplication.
    """
    v = F.col("_v")
    parsed = parsed_once(raw, raw_col)
    fields = [READERS[c.kind](v, c.source).alias(c.name) for c in spec.PRODUCT_COLUMNS if c.source]
    out_of_stock = typed.flag(v, "isCompletelyOutOfStock") | typed.flag(v, "isTemporaryOutOfStock")
    base = parsed.select(
        *keep, *fields,
        out_of_stock.alias("is_out_of_stock"),
        typed.text_list(v, "grapes").alias("grapes"),
        typed.text_list(v, "tasteSymbols").alias("pairings"),
        F.col(raw_col).alias("raw"),
        F.col(synced_at).cast("timestamp").alias("synced_at"),
    ).filter(F.col("product_id") != "")
    named = base.withColumn("full_name", full_name(F.col("name"), F.col("name_thin")))
    priced = with_derived_prices(with_availability(named))
    for flag in spec.FLAG_COLUMNS:
        priced = priced.withColumn(flag, F.lit(None).cast("boolean"))
    return priced.select(*keep, *spec.ALL_COLUMNS, "grapes", "pairings")
