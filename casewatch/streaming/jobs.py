"""Structured Streaming jobs: the same semantics as the batch operators, on unbounded feeds.

Each function takes and gives a streaming DataFrame, or is a function for
foreachBatch. State is kept per key; late data follow the rule of each job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.keyed import KeyedTable, latest

NO_TIMEOUT = GroupStateTimeout.NoTimeout


def stream_publications(items: DataFrame, delay: str = "1 day") -> DataFrame:
    """Publications once each by (fonte, id_externo); repeats are dropped for as long as a day is released in batches."""
    return items.withWatermark("disponivel_em", delay).dropDuplicatesWithinWatermark(["fonte", "id_externo"])


def stream_new_cases(rows: DataFrame, delay: str = "1 day", keep_days: int = 730, groups: int = 1 << 13) -> DataFrame:
    """(varredura, numero_cnj, avisa) the first time a sweep returns a number; ``base`` rows, of its first run, are silent.

    ``rows``: varredura, numero_cnj, base, vista_em (timestamp). A number that a
    sweep hasn't returned for ``keep_days`` of event time is forgotten; if it
    came back after that it would be new again.

    Sweeps' numbers are dealt by a hash over ``groups``, and Python is entered once
    for each group that a batch has rows of, not once a number. A group's state is
    its numbers, each with the time from which it is kept; its timer is that of the
    oldest. A batch writes the states of its groups anew, so streams that remember
    very many numbers want more groups. Their number is fixed by the first batch.
    """
    keep = keep_days * 86_400_000

    def first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = {(v, n): t for v, n, t in zip(*state.get)} if state.exists else {}
        silent: dict = {}
        if not state.hasTimedOut:
            told: dict = {}
            for f in frames:
                for k, b, t in zip(zip(f.varredura, f.numero_cnj), f.base, f.vista_):
                    silent[k] = silent.get(k, False) or b
                    told[k] = max(told.get(k, 0), t)
            new = [k for k in told if k not in held]
            told = {k: max(t, held.get(k, 0), now) for k, t in told.items()}
        else:
            new, told = [], {}
        # A number that is returned again in the batch in which its time is over is still known.
        left = {k: t for k, t in held.items() if t + keep >= now} | told
        if left:
            state.update(([v for v, _ in left], [n for _, n in left], list(left.values())))
            state.setTimeoutTimestamp(min(left.values()) + keep)
        elif state.exists:
            state.remove()
        if new:
            yield pd.DataFrame({"varredura": [v for v, _ in new], "numero_cnj": [n for _, n in new], "avisa": [not silent[k] for k in new]})

    # As text, since pandas would make floats of a sweep's number beside a null.
    plain = rows.withWatermark("vista_em", delay).select(
        F.pmod(F.xxhash64("varredura", "numero_cnj"), F.lit(groups)).alias("grupo_"), F.col("varredura").cast("string").alias("varredura"), "numero_cnj", F.coalesce("base", F.lit(False)).alias("base"), F.coalesce(F.unix_millis(utc(F.col("vista_em"))), F.lit(0)).alias("vista_"), "vista_em",
    )
    out = plain.groupBy("grupo_").applyInPandasWithState(first, "varredura string, numero_cnj string, avisa boolean", "varreduras array<string>, numeros array<string>, vistas array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("varredura", F.col("varredura").cast("long"))


def stream_error_rate(runs: DataFrame, percent: int = 10, least: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Errors among the queries of each court in every hour, evaluated each five minutes."""
    g = runs.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour", "5 minutes").alias("w"), "tribunal").agg(F.sum("consultas").alias("consultas"), F.sum("erros").alias("erros"))
    return g.select(F.col("w.start").alias("inicio"), "tribunal", "consultas", "erros", F.when(F.col("consultas") >= least, F.col("erros") * 100 > F.col("consultas") * percent).alias("abre"))


def stream_daily_volume(runs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """New cases by court and local day: days begin at 03:00 UTC."""
    g = runs.withWatermark("ts", delay).groupBy(F.window("ts", "1 day", "1 day", "3 hours").alias("w"), "tribunal").agg(F.sum("novos").alias("total"))
    return g.select(F.to_date("w.start").alias("dia"), "tribunal", "total")


class _Payments(StatefulProcessor):
    """The end of a subscription as a value, its payments' ids as a map to the day they were told on, and a timer for the oldest."""

    def __init__(self, keep_ms: int) -> None:
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("fim", "ate string, pagamentos long")
        self.told = handle.getMapState("contados", "pagamento long", "dito_em long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, n = self.end.get() if self.end.exists() else (None, 0)
        now = max(timerValues.getCurrentWatermarkInMs(), 0)
        first = None
        for r in pd.concat(list(rows)).sort_values(["pago_em", "pagamento", "meses"], kind="stable").itertuples():
            if self.told.containsKey((r.pagamento,)):
                continue
            at = max(int(r.dito_em.timestamp() * 1000), now)
            self.told.updateValue((r.pagamento,), (at,))
            first = at if first is None else min(first, at)
            start = max(pd.Timestamp(until if until is not None else r.vigente_ate), pd.Timestamp(r.pago_em))
            until, n = (start + pd.DateOffset(months=int(r.meses))).date().isoformat(), n + 1
        self.end.update((until, n))
        if first is not None and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(first + self.keep)
        yield pd.DataFrame({"assinatura": [key[0]], "vigente_ate": [until], "pagamentos": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Forget ids told so long ago; the timer goes on with the oldest of the rest."""
        due, rest = expiredTimerInfo.getExpiryTimeInMs() - self.keep, []
        for k, (at,) in list(self.told.iterator()):
            if at <= due:
                self.told.removeKey(k)
            else:
                rest.append(at)
        if rest:
            self.handle.registerTimer(min(rest) + self.keep)
        return iter([])

    def close(self) -> None:
        pass


def stream_payments(payments: DataFrame, delay: str = "1 day", keep_days: int = 60) -> DataFrame:
    """(assinatura, vigente_ate, pagamentos) after each batch: every payment extends its subscription once, however often it is told.

    ``payments``: assinatura, pagamento, pago_em (date), meses, vigente_ate (the
    end before the first payment), dito_em (timestamp of the notice). Ids are
    remembered for ``keep_days`` of event time after their first notice, so
    that state follows the payments of that time and not all there ever were.
    A later repeat would count again: notices are repeated within days.
    """
    keyed = payments.withWatermark("dito_em", delay).groupBy("assinatura")
    return keyed.transformWithStateInPandas(_Payments(keep_days * 86_400_000), "assinatura long, vigente_ate string, pagamentos long", "Update", "EventTime")


def stream_consecutive_failures(runs: DataFrame, k: int = 2) -> DataFrame:
    """(sentinela, id, evento): aberto at the k-th failure running, resolvido at the first success after.

    Only sentinels that are failing have state: a success clears it.
    """

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed, is_open = state.get if state.exists else (0, False)
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "id"], kind="stable").itertuples():
            failed = 0 if r.sucesso else failed + 1
            if is_open != (failed >= k or (is_open and failed > 0)):
                is_open = not is_open
                out.append((key[0], r.id, "aberto" if is_open else "resolvido"))
        if failed:
            state.update((failed, is_open))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["sentinela", "id", "evento"])

    return runs.groupBy("sentinela").applyInPandasWithState(count, "sentinela long, id long, evento string", "falhas int, aberto boolean", "append", NO_TIMEOUT)


def upsert_batch(table: KeyedTable, updated: str, writer: str = "stream"):
    """A function for foreachBatch: late rows are merged by the time of their update, none is dropped for its age.

    A batch reads and writes the parts of the table that it has keys in; one that is run again changes nothing.
    """
    combine = latest(table.key, updated)

    def run(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, combine, writer, batch_id)

    return run


def with_rocksdb(spark: SparkSession) -> None:
    """State on the executors' disks: needed by value, map and timer state, and by any that grows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_batches(stream: DataFrame, checkpoint: str, put, mode: str = "update") -> None:
    """Everything that is there now, by ``put`` (batch, id); begun again with the same checkpoint it goes on after that."""
    with_rocksdb(stream.sparkSession)
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def fed(rows: DataFrame, folder: str, cuts: list[Column]) -> Iterator[DataFrame]:
    """Stream over ``rows`` as they arrive: after each of the slices (conditions, that share them out) is written, the stream of all so far."""
    spark = rows.sparkSession
    for cut in cuts:
        rows.where(cut).write.mode("append").parquet(folder)
        yield spark.readStream.schema(rows.schema).parquet(folder)


def appender(folder: str):
    """A function for foreachBatch: a batch, with batch_, in a folder of its own, which a repeated batch writes again."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/run={batch_id}")

    return put


def run_available(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """All output of a stream over what is there now, with batch_, by way of ``folder``."""
    run_batches(stream, f"{folder}/state", appender(folder), mode)
    return outputs(stream, folder)


def outputs(stream: DataFrame, folder: str) -> DataFrame:
    """What ``appender`` wrote so far."""
    return stream.sparkSession.read.schema(stream.schema.add("batch_", "long")).parquet(f"{folder}/out/run=*")


def last_of_each(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows with batch_ the latest for each key."""
    rest = [c for c in rows.columns if c not in (*key, "batch_")]
    return rows.groupBy(*key).agg(F.max(F.struct("batch_", *rest)).alias("x_")).select(*key, *[f"x_.{c}" for c in rest])


def file_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def utc(c: Column) -> Column:
    return c.cast("timestamp")
