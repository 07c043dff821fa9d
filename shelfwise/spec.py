"""The catalogue's column specification and domain constants.

Every projection, merge and export is generated from ``PRODUCT_COLUMNS``, so a
column is declared once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Column:
    """One column of the product table.

    ``kind``: how it is filled --
      text    optional string, '' becomes NULL
      string  string kept as it is, '' included
      flag    boolean, missing means false
      tri     boolean set by enrichment only, NULL means not enriched
      number  double; integer  int; vintage  int with its own parsing
      derived computed from other columns or supplied by the run
    ``source`` is the raw JSON field; ``slim`` marks the portable export.
    """

    name: str
    kind: str
    source: str | None = None
    slim: bool = False


# The product table in its physical order.
PRODUCT_COLUMNS: tuple[Column, ...] = (
    Column("product_id", "string", "productId", slim=True),
    Column("product_number", "text", "productNumber"),
    Column("name", "string", "productNameBold", slim=True),
    Column("name_thin", "text", "productNameThin", slim=True),
    Column("full_name", "derived", slim=True),
    Column("producer", "text", "producerName", slim=True),
    Column("supplier", "text", "supplierName"),
    Column("country", "text", "country", slim=True),
    Column("origin1", "text", "originLevel1", slim=True),
    Column("origin2", "text", "originLevel2"),
    Column("cat1", "text", "categoryLevel1", slim=True),
    Column("cat2", "text", "categoryLevel2", slim=True),
    Column("cat3", "text", "categoryLevel3", slim=True),
    Column("category_title", "text", "customCategoryTitle"),
    Column("vintage", "vintage", "vintage", slim=True),
    Column("price", "number", "price", slim=True),
    Column("volume_ml", "number", "volume", slim=True),
    Column("abv", "number", "alcoholPercentage", slim=True),
    Column("sugar_g_per_100ml", "number", "sugarContentGramPer100ml"),
    Column("sek_per_litre", "derived", slim=True),
    Column("sek_per_cl_alcohol", "derived"),
    Column("assortment_text", "text", "assortmentText"),
    Column("availability", "derived", slim=True),
    Column("availability_rank", "derived", slim=True),
    Column("is_discontinued", "flag", "isDiscontinued"),
    Column("is_out_of_stock", "derived"),
    Column("is_organic", "flag", "isOrganic", slim=True),
    Column("is_sustainable", "flag", "isSustainableChoice"),
    Column("is_ethical", "flag", "isEthical"),
    Column("ethical_label", "text", "ethicalLabel"),
    Column("is_vegan", "tri", slim=True),
    Column("is_natural", "tri", slim=True),
    Column("is_gluten_free", "tri", slim=True),
    Column("is_kosher", "tri", slim=True),
    Column("packaging", "text", "packagingLevel1", slim=True),
    Column("seal", "text", "seal"),
    Column("co2_impact", "text", "packagingCO2ImpactLevel"),
    Column("clock_body", "integer", "tasteClockBody", slim=True),
    Column("clock_tannin", "integer", "tasteClockRoughness", slim=True),
    Column("clock_sweetness", "integer", "tasteClockSweetness", slim=True),
    Column("clock_bitter", "integer", "tasteClockBitter", slim=True),
    Column("clock_fruitacid", "integer", "tasteClockFruitacid", slim=True),
    Column("clock_smokiness", "integer", "tasteClockSmokiness", slim=True),
    Column("clock_casque", "integer", "tasteClockCasque"),
    Column("casque_text", "text", "hasCasqueTaste"),
    Column("taste", "text", "taste", slim=True),
    Column("color", "text", "color", slim=True),
    Column("usage", "text", "usage", slim=True),
    Column("launch_date", "text", "productLaunchDate", slim=True),
    Column("sell_start_time", "text", "sellStartTime", slim=True),
    Column("is_news", "flag", "isNews", slim=True),
    Column("is_web_launch", "flag", "isWebLaunch", slim=True),
    Column("assortment_code", "text", "assortment", slim=True),
    Column("raw", "derived"),
    Column("synced_at", "derived"),
)

ALL_COLUMNS = tuple(c.name for c in PRODUCT_COLUMNS)
SLIM_COLUMNS = tuple(c.name for c in PRODUCT_COLUMNS if c.slim)
FLAG_COLUMNS = tuple(c.name for c in PRODUCT_COLUMNS if c.kind == "tri")
WRITTEN_COLUMNS = tuple(c.name for c in PRODUCT_COLUMNS if c.kind != "tri")

# What a listing shows.
LIST_COLUMNS = (
    "product_id", "full_name", "producer", "country", "cat1", "cat2", "cat3",
    "vintage", "price", "volume_ml", "abv", "availability", "availability_rank",
    "clock_body", "clock_tannin", "clock_sweetness", "clock_fruitacid", "taste",
)

# What a product page shows.
DETAIL_COLUMNS = (
    "product_id", "product_number", "full_name", "producer", "supplier", "country",
    "origin1", "origin2", "cat1", "cat2", "cat3", "vintage", "price", "volume_ml",
    "abv", "sek_per_litre", "availability", "availability_rank", "assortment_text",
    "assortment_code", "launch_date", "sell_start_time", "is_news", "is_organic",
    "is_vegan", "is_natural", "is_gluten_free", "is_kosher", "clock_body",
    "clock_tannin", "clock_sweetness", "clock_bitter", "clock_fruitacid",
    "clock_smokiness", "packaging", "taste", "color", "usage",
)

# Assortment text -> (tier, rank); anything else is order only.
AVAILABILITY = {
    "Fast sortiment": ("stocked", 1),
    "Lokalt & Småskaligt": ("stocked", 1),
    "Tillfälligt sortiment": ("limited", 2),
    "Säsong": ("limited", 2),
    "Presentsortiment": ("limited", 2),
    "Ordervaror": ("order_only", 3),
    "Webblanseringar": ("order_only", 3),
}
UNKNOWN_AVAILABILITY = ("order_only", 3)

# Paging and gates.
DEFAULT_PAGE = 20
MAX_PAGE = 100
SLICE_CAP = 333 * 30
MIN_PUBLISH_ROWS = 1000
MAX_BOTTLES_PER_COMMAND = 1000
MAX_COUNT = 10000

# Enumerations of the cellar.
REMOVAL_REASONS = ("drunk", "gift", "sold", "broken", "other")
REVIEW_RELEASES = ("this_release", "other_release", "unknown")
REVIEW_SEEN = ("at_source", "quoted")
DRINK_WINDOWS = ("ready", "drink_soon", "not_yet", "unknown")
HOME_CURRENCY = "SEK"
SLOT_PATTERN = r"^[A-Z]\d{1,3}$"
PARTIAL_DATE_PATTERN = r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01]))?)?$"

CLOCKS = ("clock_body", "clock_tannin", "clock_sweetness", "clock_fruitacid")
# What a missing clock counts as in a taste distance.
CLOCK_DEFAULTS = {"clock_body": 6, "clock_tannin": 6, "clock_sweetness": 0, "clock_fruitacid": 6}

# Fields of a cellar wine a user may set, with their types.
WINE_FIELDS = {
    "name": "string", "producer": "string", "vintage": "int", "country": "string",
    "region": "string", "category": "string", "grapes": "string", "volume_ml": "int",
    "purchase_price": "double", "purchase_currency": "string", "purchased_on": "string",
    "purchased_from": "string", "location": "string", "drink_from": "int",
    "drink_until": "int", "notes": "string", "abv": "double", "sugar_g_l": "double",
    "style": "string", "base_vintage": "int", "disgorged_on": "string",
    "profile": "string", "profile_sources": "string",
}

# The fields of a review a user may set, with their types.
REVIEW_FIELDS = {
    "critic": "string", "score": "double", "scale": "double", "award": "string",
    "tasted_on": "string", "release": "string", "release_note": "string",
    "drink_from": "int", "drink_until": "int", "summary": "string", "url": "string",
    "seen": "string",
}

_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}

WINE_SCHEMA = T.StructType(
    [T.StructField("cellar_id", T.StringType()), T.StructField("wine_id", T.LongType()),
     T.StructField("product_id", T.StringType()), T.StructField("product_number", T.StringType())]
    + [T.StructField(n, _SIMPLE[t]) for n, t in WINE_FIELDS.items()]
    + [T.StructField("quantity", T.IntegerType()), T.StructField("sb_taste", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in CLOCKS]
    + [T.StructField("profiled_on", T.StringType()), T.StructField("reviews_checked_on", T.StringType()),
       T.StructField("added_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]
)

EVENT_SCHEMA = T.StructType([
    T.StructField("cellar_id", T.StringType()), T.StructField("event_id", T.LongType()),
    T.StructField("wine_id", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("quantity", T.IntegerType()),
    T.StructField("on_date", T.DateType()), T.StructField("rating", T.IntegerType()),
    T.StructField("note", T.StringType()),
])
