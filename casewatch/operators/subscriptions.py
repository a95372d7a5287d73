"""Subscriptions, payments, retention and removal of clients."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of payment events.
CONFIRMED, OPENED, REVERSED = ("PAYMENT_CONFIRMED", "PAYMENT_RECEIVED"), ("PAYMENT_CREATED", "PAYMENT_UPDATED"), ("PAYMENT_REFUNDED", "PAYMENT_DELETED")
#: Billing situations that need an operator.
PROBLEMS = ("erro_gateway", "sem_cobranca_automatica", "sem_gateway", "sem_documento")


def subscription_transitions(rows: DataFrame, today: Column, grace: int = 7) -> DataFrame:
    """``rows`` with novo_status: of those past their end that aren't courtesy, cancelled if so asked, suspended after the grace, else late."""
    due = F.col("status").isin("ativa", "atrasada") & ~F.col("cortesia") & (F.col("vigente_ate") < today)
    new = F.when(F.col("cancelar_no_fim"), "cancelada").when(F.col("vigente_ate") < F.date_sub(today, grace), "suspensa").otherwise("atrasada")
    return rows.withColumn("novo_status", F.when(F.coalesce(due, F.lit(False)), new).otherwise(F.col("status")))


def active_items(items: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Items with a subscription that is active or late."""
    return items.join(subscriptions.where("status in ('ativa', 'atrasada')").select("item"), "item", "left_semi")


def duplicate_open(subscriptions: DataFrame) -> DataFrame:
    """Items with more than one subscription that isn't ended."""
    return subscriptions.where("status in ('ativa', 'atrasada', 'pendente')").groupBy("item").agg(F.count("*").alias("n")).where("n > 1")


def classify_payment_events(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(evento, resultado) of each event, in order of arrival.

    ``events``: evento, tipo, pagamento, assinatura, ordem; ``subscriptions``: assinatura, status.
    """
    # Rows without an event or a payment aren't one group: each is by itself.
    alone = lambda c: F.coalesce(F.concat(F.lit("k"), F.col(c).cast("string")), F.concat(F.lit("o"), F.col("ordem").cast("string")))
    first_event = F.row_number().over(Window.partitionBy(alone("evento")).orderBy("ordem")) == 1
    e = events.withColumn("first_", first_event).join(subscriptions.withColumnRenamed("status", "s_"), "assinatura", "left")
    applies = F.col("first_") & F.col("tipo").isin(*CONFIRMED) & F.col("pagamento").isNotNull() & F.col("s_").isNotNull() & (F.col("s_") != "cancelada")
    e = e.withColumn("n_", F.sum(applies.cast("int")).over(Window.partitionBy(alone("pagamento")).orderBy("ordem").rowsBetween(Window.unboundedPreceding, -1)))
    known = F.col("s_").isNotNull()
    result = (
        F.when(F.col("evento").isNull(), "invalido").when(~F.col("first_"), "duplicado").when(F.col("assinatura").isNull(), "sem_assinatura").when(~known, "ignorado")
        .when(F.col("tipo").isin(*CONFIRMED) & F.col("pagamento").isNull(), "sem_pagamento").when(F.col("tipo").isin(*CONFIRMED) & (F.coalesce("n_", F.lit(0)) > 0), "ja_aplicado")
        .when(F.col("tipo").isin(*CONFIRMED) & (F.col("s_") == "cancelada"), "pago_cancelada").when(F.col("tipo").isin(*CONFIRMED), "ativada").when(F.col("tipo").isin(*OPENED), "link").when(F.col("tipo").isin(*REVERSED), "estorno").otherwise("ignorado")
    )
    return e.select("evento", "ordem", "pagamento", "assinatura", result.alias("resultado"))


def apply_payments(payments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(assinatura, vigente_ate, pagamentos): each distinct payment extends the later of end and payment by its months.

    ``payments``: assinatura, pagamento, pago_em (date), meses. A fold over the
    payments of a subscription in order: the end depends on the one before.
    """
    once = payments.groupBy("assinatura", "pagamento").agg(F.min(F.struct("pago_em", "meses")).alias("x"))
    line = once.groupBy("assinatura").agg(F.array_sort(F.collect_list(F.struct("x.pago_em", "pagamento", "x.meses"))).alias("l"))
    j = subscriptions.select("assinatura", F.col("vigente_ate").alias("until_")).join(line, "assinatura", "left")
    end = F.aggregate(F.coalesce("l", F.array().cast("array<struct<pago_em:date,pagamento:bigint,meses:int>>")), F.col("until_"), lambda acc, p: F.to_date(F.greatest(F.coalesce(acc, p["pago_em"]), p["pago_em"]) + F.make_ym_interval(F.lit(0), p["meses"])))
    return j.select("assinatura", end.alias("vigente_ate"), F.greatest(F.size("l"), F.lit(0)).alias("pagamentos"))


def billing_situation(gateway: bool = True) -> Column:
    """The first situation that holds, of columns status, gateway_id, gateway_cancelado_em, cortesia, cancelar_no_fim, cobranca_erro, tem_documento, tem_link."""
    c = F.col
    no_charge = c("gateway_id").isNull()
    cancelling = ~no_charge & c("gateway_cancelado_em").isNull() & ((c("status") == "cancelada") | c("cancelar_no_fim") | c("cortesia"))
    issuing = (c("status") == "pendente") & no_charge & ~c("cortesia")
    rules = (
        (F.coalesce(c("cobranca_erro") != "", F.lit(False)) & (issuing | cancelling), "erro_gateway"), (cancelling, "cancelamento_pendente"), (c("status") == "cancelada", "encerrada"), (c("cortesia"), "cortesia"),
        (no_charge & (c("status") == "ativa"), "liberada_sem_cobranca"), (no_charge & (c("status") != "pendente"), "sem_cobranca_automatica"), (no_charge & F.lit(not gateway), "sem_gateway"), (no_charge & ~c("tem_documento"), "sem_documento"),
        (no_charge, "emitindo"), (c("status") == "ativa", "paga"), (c("tem_link"), "aguardando_pagamento"),
    )
    out = F.when(rules[0][0], rules[0][1])
    for cond, code in rules[1:]:
        out = out.when(cond, code)
    return out.otherwise("aguardando_link")


def gateway_work_lists(rows: DataFrame, most: int = 50) -> DataFrame:
    """(tarefa, id): what to issue, whose link to fetch, what to cancel; the ``most`` lowest ids of each."""
    s = rows.withColumn("sit_", billing_situation())
    task = F.when(F.col("sit_").isin("emitindo", "erro_gateway") & F.col("gateway_id").isNull(), "emitir").when(F.col("sit_") == "aguardando_link", "buscar_link").when(F.col("gateway_id").isNotNull() & F.col("sit_").isin("cancelamento_pendente", "erro_gateway"), "cancelar")
    w = Window.partitionBy("tarefa").orderBy("id")
    return s.select("id", task.alias("tarefa")).where("tarefa is not null").withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= most).select("tarefa", "id")


def usage_this_month(terms: DataFrame, occurrences: DataFrame, start: Column) -> DataFrame:
    """(termo, limite, usados): occurrences since the month began against each term's limit."""
    used = occurrences.where(F.col("detectado_em") >= start).groupBy("termo").agg(F.count("*").alias("usados"))
    return terms.join(used, "termo", "left").select("termo", "limite", F.coalesce("usados", F.lit(0)).alias("usados"))


def active_queries(targets: DataFrame) -> DataFrame:
    """(hash, critica): distinct queries of active targets; critical if any of them is."""
    return targets.groupBy("hash").agg(F.bool_or(F.col("prioridade") == "critica").alias("critica"))


def orphan_sweeps(sweeps: DataFrame, targets: DataFrame) -> DataFrame:
    return sweeps.join(targets.select("hash"), "hash", "left_anti")


def purge_client(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """Rows of clients whose account isn't closed."""
    return rows.join(closed.select("cliente_id"), "cliente_id", "left_anti")


def anonymize_targets(targets: DataFrame, closed: DataFrame) -> DataFrame:
    """Targets of closed accounts lose value and variations and are switched off; others stay."""
    j = targets.join(closed.select("cliente_id", F.lit(True).alias("closed_")), "cliente_id", "left")
    gone = F.coalesce("closed_", F.lit(False))
    return j.select(*[F.when(gone, F.concat(F.lit("removido-"), F.col("alvo_id").cast("string"))).otherwise(F.col(c)).alias(c) if c == "valor" else c for c in targets.columns], (~gone).alias("ativo"))


def retention(rows: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """Rows that are kept: younger than ``days``."""
    return rows.where(F.col(column) >= now - F.make_dt_interval(days=F.lit(days)))


def sign_ups_kept(sign_ups: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Sign-ups (concluido_em, expira_em) but for those that weren't finished and ran out over ``days`` ago."""
    gone = F.col("concluido_em").isNull() & (F.col("expira_em") < now - F.make_dt_interval(days=F.lit(days)))
    return sign_ups.where(~F.coalesce(gone, F.lit(False)))


def people_kept(people: DataFrame, parties: DataFrame, occurrences: DataFrame, targets: DataFrame) -> DataFrame:
    """People (pessoa_id, documento) whom a client still has to do with: whose document is an active target's, or
    who stand in a case (``parties``: processo_id, pessoa_id) that has an occurrence."""
    watched = people.join(targets.where("ativo").select(F.col("valor").alias("documento")).distinct(), "documento", "left_semi").select("pessoa_id")
    seen = parties.join(occurrences.select("processo_id").distinct(), "processo_id", "left_semi").select("pessoa_id")
    return people.join(watched.union(seen).distinct(), "pessoa_id", "left_semi")


class Kept(NamedTuple):
    """Tables after ``retain``, in the order in which their rows may go."""

    raw: DataFrame
    attempts: DataFrame
    sign_ups: DataFrame
    targets: DataFrame
    occurrences: DataFrame
    parties: DataFrame
    people: DataFrame


def retain(raw: DataFrame, attempts: DataFrame, sign_ups: DataFrame, targets: DataFrame, occurrences: DataFrame, parties: DataFrame, people: DataFrame, closed: DataFrame, now: Column) -> Kept:
    """All rules of keeping at once, along the keys: what refers to a row that goes, goes too.

    Raw pages (coletado_em) go after 12 months, attempts (criado_em) after a
    day, sign-ups as in ``sign_ups_kept``. Of clients in ``closed`` (cliente_id)
    targets lose their values and occurrences go; then the people whom nobody
    has to do with any more (``people_kept``) and, with them, their parties.
    """
    targets = anonymize_targets(targets, closed)
    occurrences = purge_client(occurrences, closed)
    people = people_kept(people, parties, occurrences, targets)
    return Kept(
        raw.where(F.col("coletado_em") >= F.add_months(now, -12)), retention(attempts, "criado_em", now, 1), sign_ups_kept(sign_ups, now), targets, occurrences,
        parties.join(people.select("pessoa_id"), "pessoa_id", "left_semi").select(*parties.columns), people,
    )
