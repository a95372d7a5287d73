"""Alarms, health and volumes of collection, and the schedule of queries.

An alarm's evaluation is true (open), false (resolved) or null (no change).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.money_time import ZONE, local_date
from ..sources.shared import checkpointed


def error_rate(runs: DataFrame, start: Column, end: Column, percent: int = 10, least: int = 10) -> DataFrame:
    """(tribunal, consultas, erros, abre) of the runs after ``start`` up to ``end``: more than ``percent`` of ``least`` queries or more."""
    g = runs.where((F.col("ts") > start) & (F.col("ts") <= end)).groupBy("tribunal").agg(F.sum("consultas").alias("consultas"), F.sum("erros").alias("erros"))
    return g.withColumn("abre", F.when(F.col("consultas") >= least, F.col("erros") * 100 > F.col("consultas") * percent))


def low_volume(runs: DataFrame, least_days: int = 7, least_mean: int = 3) -> DataFrame:
    """(tribunal, dia, total, abre) of each local day: under half the mean of those of the 14 days before that had runs.

    Needs ``least_days`` such days and a mean of ``least_mean``; else no change.
    """
    day = runs.groupBy("tribunal", local_date(F.col("ts")).alias("dia")).agg(F.sum("novos").alias("total"))
    before = Window.partitionBy("tribunal").orderBy(F.unix_date("dia")).rangeBetween(-14, -1)
    n, s = F.count("*").over(before), F.sum("total").over(before)
    enough = (n >= least_days) & (s >= n * least_mean)
    return day.withColumn("abre", F.when(enough, F.col("total") * n * 2 < s))


def canary_alarm(runs: DataFrame, k: int = 2) -> DataFrame:
    """(sentinela, abre): the last ``k`` runs all failed: open; the last went well: resolved; otherwise no change."""
    w = Window.partitionBy("sentinela").orderBy(F.desc("ts"), F.desc("id"))
    last = runs.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= k)
    g = last.groupBy("sentinela").agg(F.count("*").alias("n"), F.bool_or("sucesso").alias("some"), F.max_by("sucesso", -F.col("n_")).alias("latest"))
    return g.select("sentinela", F.when(F.col("latest"), F.lit(False)).when((F.col("n") == k) & ~F.col("some"), F.lit(True)).alias("abre"))


def compare_canary(expected: DataFrame, obtained: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, campo, esperado, obtido) where a field that is expected differs, case and accents aside."""
    names = [c for c in fields]
    e = expected.select(key, *[F.col(c).cast("string").alias(f"e_{c}") for c in names])
    o = obtained.select(key, *[F.col(c).cast("string").alias(f"o_{c}") for c in names])
    all_ = F.array(*[F.struct(F.lit(c).alias("campo"), F.col(f"e_{c}").alias("esperado"), F.col(f"o_{c}").alias("obtido")) for c in names])
    same = lambda a, b: text.tpu_key(a).eqNullSafe(text.tpu_key(b))
    return e.join(o, key, "left").select(key, F.explode(F.filter(all_, lambda x: x["esperado"].isNotNull() & ~same(x["esperado"], x["obtido"]))).alias("d")).select(key, "d.*")


def alarm_transitions(evaluations: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows at which an alarm opens or resolves, evento saying which; unknown evaluations change nothing, an alarm begins resolved."""
    w = Window.partitionBy(*key).orderBy(*order)
    known = evaluations.where("abre is not null").withColumn("was_", F.coalesce(F.lag("abre").over(w), F.lit(False)))
    return known.where("abre <> was_").withColumn("evento", F.when(F.col("abre"), "aberto").otherwise("resolvido")).drop("was_")


def merge_alarms(open_: DataFrame, evaluations: DataFrame, key: list[str]) -> DataFrame:
    """(key, acao): what changes against the alarms that are open: abrir, resolver; others are left out."""
    j = evaluations.join(open_.select(*key).withColumn("open_", F.lit(True)), key, "left")
    act = F.when(F.col("abre") & F.col("open_").isNull(), "abrir").when(~F.col("abre") & F.col("open_").isNotNull(), "resolver")
    return j.select(*key, act.alias("acao")).where("acao is not null")


def missing_units(courts: DataFrame, units: DataFrame, day: Column) -> DataFrame:
    """Active courts without a unit in force on ``day``."""
    valid = units.where(F.col("vigente_desde") <= day).select("tribunal").distinct()
    return courts.where("ativo").join(valid, "tribunal", "left_anti")


#: Size parameter of the quantile sketches: a rank is off by some 0.7 % of the rows at most, nearly always.
SKETCH = 400


def latency_sketches(runs: DataFrame, width: str = "1 minute") -> DataFrame:
    """(inicio, tribunal, operacao, n, latencias): a mergeable quantile sketch of latencies for each window, court and operation."""
    g = runs.groupBy(F.window("ts", width).alias("w"), "tribunal", "operacao").agg(F.count("latencia").alias("n"), F.kll_sketch_agg_double(F.col("latencia").cast("double"), SKETCH).alias("latencias"))
    return g.select(F.col("w.start").alias("inicio"), "tribunal", "operacao", "n", "latencias")


def merged_sketches(sketches: DataFrame, width: str) -> DataFrame:
    """Sketches of short windows as those of longer ones, without the runs; widths must hold whole short windows."""
    g = sketches.groupBy(F.window("inicio", width).alias("w"), "tribunal", "operacao").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("latencias", SKETCH).alias("latencias"))
    return g.select(F.col("w.start").alias("inicio"), "tribunal", "operacao", "n", "latencias")


def quantile(sketches: DataFrame, at: float) -> DataFrame:
    """(inicio, tribunal, operacao, n, valor)."""
    return sketches.select("inicio", "tribunal", "operacao", "n", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("latencias", F.lit(at).cast("double"))).alias("valor"))


def collection_metrics(runs: DataFrame, width: str = "1 hour") -> DataFrame:
    """Queries, errors and 95th percentile of latency (exact) by window, court and operation.

    The exact figure gathers a group's latencies; ``latency_sketches`` don't.
    """
    g = runs.groupBy(F.window("ts", width).alias("w"), "tribunal", "operacao").agg(F.count("*").alias("consultas"), F.sum((~F.col("sucesso")).cast("long")).alias("erros"), F.percentile("latencia", 0.95).alias("p95"))
    return g.select(F.col("w.start").alias("inicio"), "tribunal", "operacao", "consultas", "erros", "p95")


def all_metrics(runs: DataFrame, cases: DataFrame, alerts: DataFrame) -> DataFrame:
    """(metrica, inicio, grupo, valor double): the five figures of collection, each over its own windows.

    ``runs``: ts, tribunal, operacao, sucesso, excecao, latencia. ``cases``:
    primeira_coleta_em, tribunal. ``alerts``: enviado_em, modalidade, resultado.
    Queries a minute by court and operation over each minute that has any; the
    95th percentile of latency by hour, by merged sketches of minutes; errors an hour
    by exception; new cases by local day and court; alerts by day, mode and result.
    """

    def counted(rows: DataFrame, name: str, at: Column, *by: Column) -> DataFrame:
        return rows.groupBy(at.alias("inicio"), F.concat_ws("/", *[b.cast("string") for b in by]).alias("grupo")).agg(F.count("*").cast("double").alias("valor")).select(F.lit(name).alias("metrica"), "inicio", "grupo", "valor")

    c = F.col
    p95 = quantile(merged_sketches(latency_sketches(runs), "1 hour"), 0.95).where("n > 0").select(F.lit("p95_latencia").alias("metrica"), "inicio", F.concat_ws("/", c("tribunal").cast("string"), "operacao").alias("grupo"), "valor")
    day = lambda ts: local_date(ts).cast("timestamp")
    return (
        counted(runs, "consultas_min", F.date_trunc("minute", "ts"), c("tribunal"), c("operacao")).union(p95)
        .union(counted(runs.where("not sucesso"), "erros_hora", F.date_trunc("hour", "ts"), F.coalesce("excecao", F.lit("?")))).union(counted(cases, "novos_dia", day(c("primeira_coleta_em")), c("tribunal")))
        .union(counted(alerts, "alertas_dia", day(c("enviado_em")), c("modalidade"), c("resultado")))
    )


def court_health(courts: DataFrame, runs: DataFrame, canaries: DataFrame, checks: DataFrame, alarms: DataFrame, sweeps: DataFrame, units: DataFrame, now: Column) -> DataFrame:
    """One row a court: estado, execucao (its latest run), sentinelas, alarmes (open ones), falhas (sweeps that fail) and unidades.

    ``courts``: tribunal, ativo, bloqueado_motivo, pausado_ate. ``runs``: tribunal,
    id, ts, sucesso. ``canaries``: sentinela, tribunal, numero_cnj, ativo; only
    active ones are told, each with its latest of ``checks`` (sentinela, id, ts,
    sucesso, erro, campos), nulls where it has none. ``alarms``: tribunal, tipo,
    aberto_em, resolvido_em. ``sweeps``: tribunal, falhas_seguidas. ``units``:
    tribunal, comarca, competencia, vigente_desde. Courts without any of these
    have an empty list, 0 or null. What is listed is what operators set up or
    have open, a few a court; runs, checks and sweeps are only aggregated.
    """
    c = F.col
    state = F.when(~c("ativo"), "inativo").when(c("bloqueado_motivo") != "", "bloqueado").when(c("pausado_ate") > now, "pausado").otherwise("ok")

    def listed(rows: DataFrame, name: str, *fields: str) -> DataFrame:
        """Rows of each court as a list, in the order of their fields."""
        return rows.groupBy("tribunal").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    run = runs.groupBy("tribunal").agg(F.max(F.struct("ts", "id", "sucesso")).alias("execucao"))
    watched = canaries.where("ativo").select("sentinela", "tribunal", "numero_cnj")
    check = checks.join(watched.select("sentinela"), "sentinela", "left_semi").groupBy("sentinela").agg(F.max_by(F.struct(c("ts").alias("executada_em"), "sucesso", "erro", "campos"), F.struct("ts", "id")).alias("x"))
    watched = watched.join(check, "sentinela", "left").select("tribunal", "sentinela", "numero_cnj", "x.*")
    failing = sweeps.where("falhas_seguidas > 0").groupBy("tribunal").agg(F.count("*").alias("falhas"))
    lists = {
        "sentinelas": listed(watched, "sentinelas", "sentinela", "numero_cnj", "executada_em", "sucesso", "erro", "campos"),
        "alarmes": listed(alarms.where("resolvido_em is null"), "alarmes", "aberto_em", "tipo"),
        "unidades": listed(units, "unidades", "comarca", "competencia", "vigente_desde"),
    }
    out = courts.select("tribunal", state.alias("estado")).join(run, "tribunal", "left").join(failing, "tribunal", "left")
    for name, rows in lists.items():
        out = out.join(rows, "tribunal", "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return out.withColumn("falhas", F.coalesce("falhas", F.lit(0)))


def status_counts(rows: DataFrame, key: str, statuses: list[str]) -> DataFrame:
    """Rows by status for each key, zero where there is none."""
    return rows.groupBy(key).pivot("status", statuses).count().fillna(0, statuses)


def run_summary(rows: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """One row: how many rows meet each condition."""
    return rows.agg(*[F.count_if(c).alias(k) for k, c in counters.items()])


def market_volume(cases: DataFrame, dims: list[str], least_cents: int, cube: bool = False) -> DataFrame:
    """Cases and value by class, district and month with subtotals; nivel is the grouping id."""
    big = cases.where(F.col("valor_causa_centavos") >= least_cents)
    g = big.cube(*dims) if cube else big.rollup(*dims)
    return g.agg(F.grouping_id().alias("nivel"), F.count("*").alias("processos"), F.sum("valor_causa_centavos").alias("centavos"))


def due_queries(rows: DataFrame, now: Column, most: int = 50) -> DataFrame:
    """Of each court the due queries: critical ones first, then the longest overdue, ``most`` at most."""
    w = Window.partitionBy("tribunal").orderBy(F.desc("critica"), "proxima", "id")
    return rows.where(F.col("proxima") <= now).withColumn("posicao", F.row_number().over(w)).where(F.col("posicao") <= most)


#: Minutes to wait after one, two, three, four or more failures running.
BACK_OFF = (1, 5, 15, 60)


def next_run_time(now: Column, critical: Column, failures: Column, zone: str = ZONE) -> Column:
    """After failures by BACK_OFF; critical in 4 hours; others in 24 or at the next 21:00 local, if that is sooner."""
    wait = F.element_at(F.array(*map(F.lit, BACK_OFF)), F.least(failures, F.lit(len(BACK_OFF))).cast("int"))
    local = F.from_utc_timestamp(now, zone)
    opening = F.date_trunc("day", local) + F.make_dt_interval(days=F.when(F.hour(local) >= 21, 1).otherwise(0), hours=F.lit(21))
    plain = F.least(now + F.make_dt_interval(days=F.lit(1)), F.to_utc_timestamp(opening, zone))
    return F.when(failures > 0, now + F.make_dt_interval(mins=F.greatest(wait, F.lit(1)))).when(critical, now + F.make_dt_interval(hours=F.lit(4))).otherwise(plain)


def in_night_window(now: Column, zone: str = ZONE) -> Column:
    hour = F.hour(F.from_utc_timestamp(now, zone))
    return (hour >= 21) | (hour < 6)


def page_after(rows: DataFrame, after: int | None, limit: int) -> DataFrame:
    """A page of ``limit`` rows and one more, newest first; the extra row tells that there are more."""
    return (rows if after is None else rows.where(F.col("id") < after)).orderBy(F.desc("id")).limit(limit + 1)


ENDS = pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("free", pa.bool_()), ("kept", pa.list_(pa.int64()))])


class _Attempts:
    """Attempts of one range of the order, gone by in order, beginning with the permitted times that ``carried`` has for the range."""

    def __init__(self, most: int, span: int, carried: dict[int, list[int]]) -> None:
        self.most, self.span, self.carried = most, span, carried
        self.part: int | None = None
        self.first = self.last = self.before = None
        #: Whether the end is the same whatever the range begins with: another key, or a pause of a whole window.
        self.free = False
        self.kept: deque[int] = deque()

    def permitted(self, batch: pa.RecordBatch) -> list[bool | None]:
        out: list[bool | None] = []
        for part, key, s in zip(*(batch.column(c).to_pylist() for c in ("part_", "key_", "s_"))):
            if self.part is None:
                self.part, self.first = part, key
                self.kept.extend(self.carried.get(part, ()))
            elif key != self.last:
                self.free, self.before = True, None
                self.kept.clear()
            self.last = key
            if s is None:
                out.append(None)
                continue
            self.free |= self.before is not None and s - self.before >= self.span
            self.before = s
            self._forget(s)
            out.append(len(self.kept) < self.most)
            if out[-1]:
                self.kept.append(s)
        return out

    def _forget(self, s: int) -> None:
        while self.kept and self.kept[0] <= s - self.span:
            self.kept.popleft()


def rate_limit_attempts(attempts: DataFrame, most: int, seconds: int, ranges: int | None = None) -> DataFrame:
    """Attempts (acao, chave, id) with permitida: fewer than ``most`` permitted ones of the same action and key in the ``seconds`` before.

    A fold: refused attempts aren't recorded, so they don't count. Rows are put
    in one order of action, key and time and dealt by ranges of it, so that a key
    with many attempts lies in many tasks. Each range is first gone through as if
    nothing came before it; it tells the permitted times that it ends with. A
    range whose key goes on from the one before begins with those, and is asked
    again only while what it begins with changes and shows at its end: it has one
    key and no pause of a whole window. That ends with the fold's own result,
    after a round or two, or at worst one for each range of a key without pauses.
    The driver holds ``most`` times a range. Times are compared to the
    microsecond; without one permitida is null. Rows that repeat are attempts
    each; an empty table gives an empty result. ``ranges`` defaults to Spark's
    number of shuffle partitions.
    """
    order, span = ["acao", "chave", "s_", "id"], 1_000_000 * seconds
    rows = attempts.select("acao", "chave", F.unix_micros(F.col("ts").cast("timestamp")).alias("s_"), "id")
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    key = F.to_json(F.struct("acao", "chave"))
    dealt = checkpointed(dealt.sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()).withColumn("key_", key))

    def ends(carried: dict[int, list[int]], parts: list[int] | None = None) -> dict:
        """What each range, or each of ``parts``, tells of its first and last key and its end."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = _Attempts(most, span, carried)
            for b in batches:
                seen.permitted(b)
            if seen.part is not None:
                yield pa.RecordBatch.from_pylist([{"part": seen.part, "first": seen.first, "last": seen.last, "free": seen.free, "kept": list(seen.kept)}], ENDS)

        asked = dealt if parts is None else dealt.where(F.col("part_").isin(parts))
        return {r.part: r for r in asked.mapInArrow(run, "part int, first string, last string, free boolean, kept array<bigint>").collect()}

    carried: dict[int, list[int]] = {}
    told = ends(carried)
    while True:
        line = [told[p] for p in sorted(told)]
        begun = {b.part: a.kept if a.last == b.first else [] for a, b in zip(line, line[1:])}
        moved = {p: kept for p, kept in begun.items() if kept != carried.get(p, [])}
        carried = carried | moved
        again = [p for p in moved if not told[p].free]
        if not again:
            break
        told |= ends(carried, again)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Attempts(most, span, carried)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("acao"), b.column("chave"), b.column("id"), pa.array(seen.permitted(b), pa.bool_())], ["acao", "chave", "id", "permitida"])

    kinds = dict(attempts.dtypes)
    return dealt.mapInArrow(fold, f"acao {kinds['acao']}, chave {kinds['chave']}, id {kinds['id']}, permitida boolean")
