"""Inputs shared by the registered queries (fixture views wired together)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.operators import ser as S
from turnlens.sources import fixtures as fx

UNSEEN_DOMAINS = ["Automobile", "Machinery"]   # FIXTURES parameter
PHRASE_SLOT = "brand"
R6 = 6  # doubles are rounded to 6 places on both engines


def r6(c):
    return F.round(c, R6)


def annotated(spark: SparkSession, d: str, decodes: DataFrame | None = None) -> DataFrame:
    """Decode rows with their test-set acts and SER flags (see ``ser.annotate_ser``).

    Fixture decodes carry their turn's acts already (one pass over the turns);
    other decodes are joined to the test turns on the row key (J2).
    """
    if decodes is None:
        decodes = fx.decodes(spark, d, with_acts=True)
    if "dialog_acts" in decodes.columns:
        return S.annotate_rows(decodes, fx.schema_slots(spark, d))
    t = fx.turns(spark, d, splits=["test"])
    return S.annotate_ser(decodes, t, fx.schema_slots(spark, d))
