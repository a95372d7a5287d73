"""Writing tables: upserts by natural key and the outbox of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyed import KeyedTable

OUTBOX_KEY = ("ocorrencia", "canal", "destino")


def merge_by_key(existing: DataFrame, new: DataFrame, key: list[str], newest: Column | None = None) -> DataFrame:
    """All rows of both, one a key: new rows replace old ones, of several new ones that of greatest ``newest``.

    Ties are broken by the whole row, so that a repeated run gives the same
    table. The choice is a minimum of structs, made before the shuffle as far
    as rows of a key are read together.
    """
    newest = F.lit(0) if newest is None else newest
    # A greatest value first, null last, is the greatest of (known, value).
    one = lambda df, new: df.select(*key, F.struct(F.lit(new).alias("new"), newest.isNotNull().alias("known"), newest.alias("newest"), F.struct(*[c for c in df.columns if c not in key]).alias("row")).alias("x_"))
    both = one(existing, 0).unionByName(one(new.select(*existing.columns), 1))
    return both.groupBy(*key).agg(F.max("x_").alias("x_")).select(*key, "x_.row.*").select(*existing.columns)


def new_for_outbox(alerts: DataFrame, sent: DataFrame, key: tuple[str, ...] = OUTBOX_KEY) -> DataFrame:
    """Alerts that the outbox doesn't hold, each key once: of several the least row."""
    rest = [c for c in alerts.columns if c not in key]
    once = alerts.groupBy(*key).agg(F.min(F.struct(*rest)).alias("x_")).select(*key, "x_.*").select(*alerts.columns) if rest else alerts.distinct()
    return once.join(sent.select(*key), list(key), "left_anti")


class Outbox:
    """Alerts to send, each once for (ocorrencia, canal, destino), whoever writes them and however often.

    ``dia`` (date) is the day of the occurrence, the same for all alerts of
    one; it is the part, so that a batch looks for what was written before in
    the days of its own alerts alone, and at the keys alone.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = KeyedTable(spark, path, ["dia", *OUTBOX_KEY], by="dia")

    def write(self, alerts: DataFrame, writer: str, batch: int) -> bool:
        """Append what isn't there; False if this batch of this writer is there already. For foreachBatch, with the batch's id."""
        dated = alerts.withColumn("dia", F.date_format("dia", "yyyy-MM-dd"))
        return self.table.append(dated, lambda sent, new: new_for_outbox(new, sent, ("dia", *OUTBOX_KEY)), writer, batch)

    def read(self) -> DataFrame:
        alerts = self.table.read()
        return alerts.withColumn("dia", F.to_date("dia"))
