"""The synonym table: tab-separated name and canonical name, # comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise.functions.strings import strip

SCHEMA = "name STRING, canonical STRING"

# Grape synonyms, as a label writes them and their canonical name.
GRAPE_SYNONYMS = (
    ("Shiraz", "Syrah"), ("Garnacha", "Grenache"), ("Garnacha tinta", "Grenache"),
    ("Grenache noir", "Grenache"), ("Cannonau", "Grenache"), ("Tinta roriz", "Tempranillo"),
    ("Aragonez", "Tempranillo"), ("Tinto fino", "Tempranillo"), ("Tinta del pais", "Tempranillo"),
    ("Ull de llebre", "Tempranillo"), ("Spätburgunder", "Pinot noir"), ("Blauburgunder", "Pinot noir"),
    ("Pinot nero", "Pinot noir"), ("Primitivo", "Zinfandel"), ("Monastrell", "Mourvèdre"),
    ("Mataro", "Mourvèdre"), ("Mourvedre", "Mourvèdre"), ("Mazuelo", "Carignan"),
    ("Cariñena", "Carignan"), ("Carignano", "Carignan"), ("Samsó", "Carignan"), ("Cot", "Malbec"),
    ("Blauer zweigelt", "Zweigelt"), ("Lemberger", "Blaufränkisch"), ("Kékfrankos", "Blaufränkisch"),
    ("Touriga nacional", "Touriga naçional"), ("Carmenere", "Carmenère"),
    ("Sangiovese grosso", "Sangiovese"), ("Brunello", "Sangiovese"), ("Prugnolo gentile", "Sangiovese"),
    ("Morellino", "Sangiovese"), ("Nielluccio", "Sangiovese"), ("Pinot grigio", "Pinot gris"),
    ("Grauburgunder", "Pinot gris"), ("Ruländer", "Pinot gris"), ("Weissburgunder", "Pinot blanc"),
    ("Pinot bianco", "Pinot blanc"), ("Fumé blanc", "Sauvignon blanc"), ("Steen", "Chenin blanc"),
    ("Trebbiano", "Ugni blanc"), ("Alvarinho", "Albariño"), ("Macabeo", "Viura"),
    ("Garnacha blanca", "Grenache blanc"), ("Grenache blanc", "Grenache blanc"), ("Moscato", "Muscat"),
    ("Moscatel", "Muscat"), ("Muskateller", "Muscat"),
)


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(name, canonical) of a synonym file; comments, blank and one-column lines are skipped."""
    rows = spark.read.schema(SCHEMA).option("sep", "\t").option("comment", "#").csv(path)
    tidy = rows.select(strip(F.col("name")).alias("name"), strip(F.col("canonical")).alias("canonical"))
    return tidy.filter((F.col("name") != "") & F.col("canonical").isNotNull())


def grape_synonyms(spark: SparkSession) -> DataFrame:
    """The built-in table as a local relation."""
    return spark.createDataFrame(list(GRAPE_SYNONYMS), SCHEMA)
