"""Urgency of occurrences, and the alerts that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text

#: Weights and thresholds of a client that sets none.
WEIGHTS = {"tutela_urgencia": 40, "polo_passivo": 20, "valor_acima_limite": 15, "rito_rapido": 15, "prioridade_critica": 10}
ALL_CHANNELS, IMMEDIATE = 60, 30
#: Names of classes that move fast, besides those that begin with EXECUCAO.
FAST = ("BUSCA E APREENSAO", "MONITORIA", "DESPEJO")
MODES = ("todos_canais", "email_imediato", "resumo_diario")


def load_alert_config(config: Column) -> Column:
    """struct of weights, limite_valor_centavos and thresholds from a client's JSON; anything invalid or unknown in it
    makes all of it default."""
    top = {"limite_valor_centavos": (None, None), "limiar_todos_canais": (ALL_CHANNELS, 100), "limiar_email_imediato": (IMMEDIATE, 100)}

    def known(m: Column, names) -> Column:
        return F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, names)))) == 0

    def whole(m: Column, name: str, most: int | None) -> Column:
        """The value is absent, or a whole number from 0 to ``most``."""
        v = F.try_element_at(m, F.lit(name))
        n = v.try_cast("long")
        return v.isNull() | F.coalesce(v.rlike("^-?[0-9]+$") & (n >= 0) & (n <= most if most is not None else F.lit(True)), F.lit(False))

    def judged(x: Column) -> Column:
        """Both maps, empty where anything is wrong with either."""
        raw, weights = x["raw"], x["weights"]
        fine, inner = raw.isNotNull() & known(raw, [*top, "pesos"]), weights.isNotNull() & known(weights, WEIGHTS)
        for name, (_, most) in top.items():
            fine = fine & whole(raw, name, most)
        for name in WEIGHTS:
            inner = inner & whole(weights, name, 100)
        fine = F.coalesce(fine & (x["said"].isNull() | inner), F.lit(False))
        return F.struct(F.when(fine, raw).alias("raw"), F.when(fine, weights).alias("weights"))

    def values(x: Column) -> Column:
        get = lambda m, name, default: F.coalesce(F.try_element_at(m, F.lit(name)).try_cast("long"), F.lit(default)).cast("long").alias(name)
        return F.struct(*[get(x["weights"], n, w) for n, w in WEIGHTS.items()], *[get(x["raw"], n, d) for n, (d, _) in top.items()])

    # Each step is bound to a variable, or else it would be written out for each use of it.
    said = F.get_json_object(config, "$.pesos")
    parsed = F.struct(F.from_json(config, "map<string,string>").alias("raw"), F.from_json(said, "map<string,string>").alias("weights"), said.alias("said"))
    return F.element_at(F.transform(F.transform(F.array(parsed), judged), values), 1)


def default_config() -> Column:
    """What ``load_alert_config`` gives for a client that sets nothing."""
    top = {"limite_valor_centavos": None, "limiar_todos_canais": ALL_CHANNELS, "limiar_email_imediato": IMMEDIATE}
    return F.struct(*[F.lit(v).cast("long").alias(n) for n, v in (WEIGHTS | top).items()])


def is_fast_track_class(name: Column) -> Column:
    key = text.tpu_key(name)
    padded = F.concat(F.lit(" "), key, F.lit(" "))
    found = padded.startswith(" EXECUCAO ")
    for f in FAST:
        found = found | F.contains(padded, F.lit(f" {f} "))
    return F.coalesce(found, F.lit(False))


def urgency_score(factors: dict[str, Column], config: Column | None = None) -> Column:
    """Weighted sum of true factors, 100 at most."""
    total = F.lit(0).cast("long")
    for name, default in WEIGHTS.items():
        if name in factors:
            total = total + F.when(F.coalesce(factors[name], F.lit(False)), config[name] if config is not None else F.lit(default)).otherwise(0)
    return F.least(F.lit(100), total)


def alert_mode(score: Column, config: Column | None = None) -> Column:
    all_, now = (config["limiar_todos_canais"], config["limiar_email_imediato"]) if config is not None else (F.lit(ALL_CHANNELS), F.lit(IMMEDIATE))
    return F.when(score >= all_, MODES[0]).when(score >= now, MODES[1]).otherwise(MODES[2])


def fan_out_alerts(occurrences: DataFrame, clients: DataFrame) -> DataFrame:
    """(ocorrencia, cliente_id, canal, destino, modalidade) of newly created occurrences.

    ``clients``: cliente_id, emails and whatsapp array<string>. Distinct valid
    e-mail addresses; distinct phones, which are always told at once. No contact, no alert.
    """
    mails = F.array_distinct(F.filter(F.transform("emails", lambda e: F.lower(F.trim(e))), lambda e: F.contains(e, F.lit("@"))))
    phones = F.array_distinct(F.filter(F.transform("whatsapp", ids.normalize_phone), lambda p: p.isNotNull()))
    none = F.array().cast("array<string>")
    # Addresses are made ready once a client, not for each of its occurrences.
    j = occurrences.where("criada").join(clients.select("cliente_id", F.coalesce(mails, none).alias("mails_"), F.coalesce(phones, none).alias("phones_")), "cliente_id")
    ways = F.concat(
        F.transform("mails_", lambda d: F.struct(F.lit("email").alias("canal"), d.alias("destino"), F.when(F.col("modalidade") == MODES[2], "resumo_diario").otherwise("imediato").alias("envio"))),
        F.transform("phones_", lambda d: F.struct(F.lit("whatsapp").alias("canal"), d.alias("destino"), F.lit("imediato").alias("envio"))),
    )
    return j.select("ocorrencia", "cliente_id", F.explode(ways).alias("w")).select("ocorrencia", "cliente_id", "w.*")


def reason_label(occurrences: DataFrame, targets: DataFrame, rules: DataFrame) -> DataFrame:
    """``occurrences`` (tipo, ref) with motivo: why it is one, never a document.

    ``targets``: alvo_id, tipo, valor, apelido. A target is called by its nickname,
    else by its name; one of a document without a nickname by its kind alone.
    ``rules``: regra_id, nome.
    """
    called = F.coalesce(F.nullif(F.trim("apelido"), F.lit("")), F.when(F.col("a_tipo") == "documento", F.when(F.length("valor") == 11, "CPF monitorado").otherwise("CNPJ monitorado")).otherwise(F.col("valor")))
    t = targets.select(F.lit("alvo").alias("tipo"), F.col("alvo_id").alias("ref"), F.col("tipo").alias("a_tipo"), "valor", "apelido")
    labels = t.select("tipo", "ref", F.concat(F.lit("Alvo: "), called).alias("motivo")).union(rules.select(F.lit("regra"), "regra_id", F.concat(F.lit("Termo: "), "nome")))
    gone = F.when(F.col("tipo") == "alvo", "Alvo monitorado").otherwise("Termo monitorado")
    return occurrences.join(labels, ["tipo", "ref"], "left").withColumn("motivo", F.coalesce("motivo", gone))


def alert_payload(alerts: DataFrame, cases: DataFrame, parties: DataFrame) -> DataFrame:
    """One row for each alert with its case's data, the parties by side, names in order, and subjects; no document is shown.

    ``alerts`` has motivo (``reason_label``), where it is asked for; ``cases`` may have assuntos
    array<string>, which becomes one text, "não informados" where there is none.
    """
    names = parties.groupBy("processo_id").pivot("polo", ["ativo", "passivo", "terceiro"]).agg(F.array_join(F.array_sort(F.collect_set("nome")), ", "))
    cases = cases.withColumnRenamed("id", "processo_id")
    if "assuntos" in cases.columns:
        said = F.array_join(F.filter(F.col("assuntos"), lambda a: F.coalesce(a != "", F.lit(False))), "; ")
        cases = cases.withColumn("assuntos", F.coalesce(F.nullif(said, F.lit("")), F.lit("não informados")))
    return alerts.join(cases, "processo_id").join(names, "processo_id", "left")


def daily_digest(alerts: DataFrame) -> DataFrame:
    """(cliente_id, destino, itens, corpo): pending digest alerts of a destination, numbered by score, then occurrence."""
    line = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ocorrencia", "titulo")))
    g = alerts.where("envio = 'resumo_diario'").groupBy("cliente_id", "destino").agg(line.alias("l"))
    said = F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["titulo"]))
    return g.select("cliente_id", "destino", F.size("l").alias("itens"), F.array_join(said, "\n").alias("corpo"))


def alert_lifecycle(attempts: DataFrame, now: Column, most: int = 3, phone_hours: int = 24) -> DataFrame:
    """(alerta, tentativas, status) from the log of attempts (alerta, canal, criado_em, sucesso): enviado once one succeeded,
    falhou after ``most`` failures, expirado for phone alerts that have waited too long, else pendente."""
    g = attempts.groupBy("alerta", "canal").agg(F.sum((~F.col("sucesso")).cast("long")).alias("tentativas"), F.bool_or("sucesso").alias("ok"), F.min("criado_em").alias("desde"))
    old = (F.col("canal") == "whatsapp") & (F.col("desde") < now - F.make_dt_interval(hours=F.lit(phone_hours)))
    return g.select("alerta", "canal", "tentativas", F.when(F.col("ok"), "enviado").when(F.col("tentativas") >= most, "falhou").when(old, "expirado").otherwise("pendente").alias("status"))


def monthly_term_limit(arrivals: DataFrame, used: DataFrame, order: list[str]) -> DataFrame:
    """Arrivals admitted: of each term the first limite - usados in order.

    ``used``: termo, usados, limite (null: none). A term with a great share of
    all rows isn't ranked in one task: the best of each of many salts are kept
    first, then ranked together.
    """
    j = arrivals.join(used, "termo", "left").withColumn("left_", F.greatest(F.col("limite") - F.coalesce("usados", F.lit(0)), F.lit(0)))
    free, bound = j.where("limite is null"), j.where("limite is not null and left_ > 0").withColumn("salt_", F.pmod(F.xxhash64(*order), F.lit(64)))
    first = bound.withColumn("n_", F.row_number().over(Window.partitionBy("termo", "salt_").orderBy(*order))).where("n_ <= left_")
    last = first.withColumn("n_", F.row_number().over(Window.partitionBy("termo").orderBy(*order))).where("n_ <= left_")
    return free.select(*arrivals.columns).union(last.select(*arrivals.columns))


def should_alert(initial_load: Column, available: Column, first_run: Column, filed: Column, today: Column) -> Column:
    """Silent in an initial load, for publications older than 3 days and, in a first run, for cases filed over 7 days ago."""
    old = F.coalesce(available < F.date_sub(today, 3), F.lit(False))
    late = first_run & ~F.coalesce(filed >= F.date_sub(today, 7), F.lit(False))
    return ~(initial_load | old | late)


def cap_initial_loads(terms: DataFrame, most: int = 3) -> DataFrame:
    """Destinations that a cycle serves: those already up to date, and of each client the first ``most`` terms that need an initial load.

    ``terms``: termo, ordem, cliente_id, alvo_id, em_dia. A term that several
    targets of one client share counts once.
    """
    w = Window.partitionBy("cliente_id").orderBy("ordem", "termo")
    loads = terms.where("not em_dia").withColumn("n_", F.dense_rank().over(w)).where(F.col("n_") <= most).drop("n_")
    return terms.where("em_dia").union(loads)
