"""Queries of subscriptions, payments, set operations and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import anonymize
from ..operators import subscriptions as s
from . import bindings as b
from .bindings import sql_check_digit, table, with_ctes
from .catalog import query

TODAY = "1998-03-01"
_SIT = """CASE WHEN cobranca_erro IS NOT NULL AND ((status = 'pendente' AND gateway_id IS NULL AND NOT cortesia) OR cp) THEN 'erro_gateway' WHEN cp THEN 'cancelamento_pendente' WHEN status = 'cancelada' THEN 'encerrada' WHEN cortesia THEN 'cortesia'
  WHEN gateway_id IS NULL THEN CASE WHEN status = 'ativa' THEN 'liberada_sem_cobranca' WHEN status <> 'pendente' THEN 'sem_cobranca_automatica' WHEN NOT tem_documento THEN 'sem_documento' ELSE 'emitindo' END WHEN status = 'ativa' THEN 'paga' WHEN tem_link THEN 'aguardando_pagamento' ELSE 'aguardando_link' END"""
_A = "SELECT *, gateway_id IS NOT NULL AND (status = 'cancelada' OR cancelar_no_fim OR cortesia) AS cp FROM (SELECT * REPLACE (CASE WHEN id % 4 = 1 THEN 'pendente' ELSE status END AS status) FROM assinatura)"


def _subs(spark, d):
    a = b.assinatura(spark, d)
    return a.withColumn("status", F.when(F.col("id") % 4 == 1, "pendente").otherwise(F.col("status"))).withColumn("gateway_cancelado_em", F.lit(None).cast("timestamp"))


@query(with_ctes(f"""SELECT id, CASE WHEN status IN ('ativa', 'atrasada') AND NOT cortesia AND vigente_ate < DATE '{TODAY}' THEN CASE WHEN cancelar_no_fim THEN 'cancelada' WHEN vigente_ate < DATE '{TODAY}' - 7 THEN 'suspensa' ELSE 'atrasada' END ELSE status END AS novo_status FROM assinatura""", "assinatura"))
def p01_subscription_transitions(spark, d):
    return s.subscription_transitions(b.assinatura(spark, d), F.lit(TODAY).cast("date")).select("id", "novo_status")


@query(with_ctes("SELECT DISTINCT cliente_id AS item, count(*) OVER (PARTITION BY cliente_id) AS n FROM assinatura WHERE status IN ('ativa', 'atrasada', 'pendente') AND cliente_id IN (SELECT cliente_id FROM assinatura WHERE status IN ('ativa', 'atrasada')) QUALIFY n > 1", "assinatura"))
def p02_item_active(spark, d):
    a = b.assinatura(spark, d).withColumnRenamed("cliente_id", "item")
    return s.active_items(s.duplicate_open(a), a)


_EV = """SELECT event_id // 3 AS evento, CASE event_type WHEN 'purchase' THEN 'PAYMENT_CONFIRMED' WHEN 'view' THEN 'PAYMENT_CREATED' WHEN 'error' THEN 'PAYMENT_REFUNDED' ELSE 'OUTRO' END AS tipo, CASE WHEN event_id % 11 > 0 THEN event_id // 6 END AS pagamento, CASE WHEN user_id % 13 > 0 THEN user_id END AS assinatura, event_id AS ordem FROM events"""


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY evento ORDER BY ordem) = 1 AS p FROM ({_EV})), j AS (SELECT *, CASE WHEN assinatura % 5 = 0 THEN NULL WHEN assinatura % 7 = 0 THEN 'cancelada' ELSE 'ativa' END AS st FROM e),
k AS (SELECT *, CASE WHEN pagamento IS NULL THEN 0 ELSE coalesce(sum((p AND tipo = 'PAYMENT_CONFIRMED' AND assinatura IS NOT NULL AND st = 'ativa')::INT) OVER (PARTITION BY pagamento ORDER BY ordem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS antes FROM j)
SELECT ordem, CASE WHEN NOT p THEN 'duplicado' WHEN assinatura IS NULL THEN 'sem_assinatura' WHEN st IS NULL THEN 'ignorado' WHEN tipo = 'PAYMENT_CONFIRMED' THEN CASE WHEN pagamento IS NULL THEN 'sem_pagamento' WHEN antes > 0 THEN 'ja_aplicado' WHEN st = 'cancelada' THEN 'pago_cancelada' ELSE 'ativada' END WHEN tipo = 'PAYMENT_CREATED' THEN 'link' WHEN tipo = 'PAYMENT_REFUNDED' THEN 'estorno' ELSE 'ignorado' END AS resultado FROM k""")
def p03_classify_payment_events(spark, d):
    e, k, u = table(spark, d, "events"), F.col("event_id"), F.col("user_id")
    kind = F.when(F.col("event_type") == "purchase", "PAYMENT_CONFIRMED").when(F.col("event_type") == "view", "PAYMENT_CREATED").when(F.col("event_type") == "error", "PAYMENT_REFUNDED").otherwise("OUTRO")
    events = e.select(F.floor(k / 3).alias("evento"), kind.alias("tipo"), F.when(k % 11 > 0, F.floor(k / 6)).alias("pagamento"), F.when(u % 13 > 0, u).alias("assinatura"), k.alias("ordem"))
    subs = e.select(u.alias("assinatura")).distinct().where("assinatura % 5 > 0").select("assinatura", F.when(F.col("assinatura") % 7 == 0, "cancelada").otherwise("ativa").alias("status"))
    return s.classify_payment_events(events, subs).select("ordem", "resultado")


#: The payments of a subscription one after the other; {all}: whether subscriptions without any are there too.
APPLIED = """WITH p AS (SELECT user_id AS assinatura, event_id // 2 AS pagamento, min({{'d': ts::DATE, 'm': CASE WHEN event_id % 10 = 0 THEN 12 ELSE 1 END}}) AS x FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
l AS (SELECT assinatura, list({{'d': x.d, 'm': x.m}} ORDER BY x.d, pagamento, x.m) AS l FROM p GROUP BY 1)
SELECT assinatura, ((list_reduce(list_prepend({{'d': DATE '2024-01-10', 'm': 0}}, coalesce(l, [])), lambda a, x: {{'d': (greatest(a.d, x.d) + to_months(x.m))::DATE, 'm': 0}})).d)::VARCHAR AS vigente_ate, coalesce(len(l), 0) AS pagamentos
FROM (SELECT DISTINCT user_id AS assinatura FROM events) LEFT JOIN l USING (assinatura) WHERE l IS NOT NULL OR {all}"""


@query(APPLIED.format(all="true"))
def p04_apply_payments(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    pay = e.where("event_type = 'purchase'").select(F.col("user_id").alias("assinatura"), F.floor(k / 2).alias("pagamento"), F.to_date("ts").alias("pago_em"), F.when(k % 10 == 0, 12).otherwise(1).alias("meses"))
    subs = e.select(F.col("user_id").alias("assinatura")).distinct().withColumn("vigente_ate", F.lit("2024-01-10").cast("date"))
    return s.apply_payments(pay, subs)


@query(with_ctes(f"SELECT id, {_SIT} AS situacao, {_SIT} IN {s.PROBLEMS} AS problema FROM a", "assinatura", a=_A))
def p05_billing_situation(spark, d):
    out = _subs(spark, d).select("id", s.billing_situation().alias("situacao"))
    return out.withColumn("problema", F.col("situacao").isin(*s.PROBLEMS))


@query(with_ctes(f"SELECT cliente_id, count(*) AS problemas FROM a WHERE {_SIT} IN {s.PROBLEMS} GROUP BY 1", "assinatura", a=_A))
def g10_billing_problem_counts(spark, d):
    out = _subs(spark, d).select("cliente_id", s.billing_situation().alias("x")).where(F.col("x").isin(*s.PROBLEMS))
    return out.groupBy("cliente_id").agg(F.count("*").alias("problemas"))


@query(with_ctes(f"""SELECT tarefa, id FROM (SELECT *, row_number() OVER (PARTITION BY tarefa ORDER BY id) AS n FROM (SELECT id, CASE WHEN x IN ('emitindo', 'erro_gateway') AND gateway_id IS NULL THEN 'emitir' WHEN x = 'aguardando_link' THEN 'buscar_link' WHEN gateway_id IS NOT NULL AND x IN ('cancelamento_pendente', 'erro_gateway') THEN 'cancelar' END AS tarefa FROM (SELECT *, {_SIT} AS x FROM a)) WHERE tarefa IS NOT NULL) WHERE n <= 50""", "assinatura", a=_A))
def p06_gateway_work_lists(spark, d):
    return s.gateway_work_lists(_subs(spark, d))


@query(with_ctes("SELECT classe_nome AS termo, min(classe_codigo)::BIGINT AS limite, count(*) FILTER (data_distribuicao >= DATE '1998-06-01') AS usados FROM processo GROUP BY 1", "processo"))
def p07_usage_this_month(spark, d):
    p = b.processo(spark, d).withColumn("termo", F.col("classe_nome"))
    terms = p.groupBy("termo").agg(F.min("classe_codigo").alias("limite"))
    return s.usage_this_month(terms, p.withColumnRenamed("data_distribuicao", "detectado_em"), F.lit("1998-06-01").cast("date"))


def _targets(spark, d):
    return b.alvo(spark, d).withColumn("hash", F.sha2("valor", 256))


@query(with_ctes("SELECT sha256(documento) AS hash FROM pessoa WHERE documento IS NOT NULL AND documento NOT IN (SELECT valor FROM alvo)", "pessoa", "alvo"))
def s02_orphan_sweeps(spark, d):
    sweeps = b.pessoa(spark, d).where("documento is not null").select(F.sha2("documento", 256).alias("hash"))
    return s.orphan_sweeps(sweeps, _targets(spark, d))


@query(with_ctes("SELECT left(sha256(valor), 2) AS hash, bool_or(prioridade = 'critica') AS critica FROM alvo GROUP BY 1", "alvo"))
def s03_active_queries(spark, d):
    return s.active_queries(_targets(spark, d).withColumn("hash", F.left("hash", F.lit(2))))


@query(with_ctes("SELECT alvo_id, CASE WHEN cliente_id % 6 = 0 THEN 'removido-' || alvo_id ELSE valor END AS valor, cliente_id % 6 > 0 AS ativo FROM alvo", "alvo"))
def s04_anonymize_closed(spark, d):
    closed = table(spark, d, "nation").where("n_nationkey % 6 = 0").select(F.col("n_nationkey").cast("long").alias("cliente_id"))
    return s.anonymize_targets(b.alvo(spark, d), closed).select("alvo_id", "valor", "ativo")


@query(with_ctes("SELECT id, cliente_id FROM processo WHERE cliente_id % 6 > 0", "processo"))
def s04_purge_client(spark, d):
    closed = table(spark, d, "nation").where("n_nationkey % 6 = 0").select(F.col("n_nationkey").cast("long").alias("cliente_id"))
    return s.purge_client(b.processo(spark, d).select("id", "cliente_id"), closed)


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def s05_retention(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return s.retention(e, "ts", F.lit("2024-01-31").cast("timestamp"), 7).select("event_id")


_PEOPLE = """SELECT custkey AS pessoa_id, documento FROM pessoa"""
_KEPT = """SELECT p.pessoa_id FROM pes p WHERE documento IN (SELECT valor FROM alvo WHERE cliente_id % 6 > 0) OR pessoa_id IN (SELECT custkey FROM processo JOIN (SELECT processo_id FROM (SELECT id AS processo_id, cliente_id FROM processo WHERE id % 5 = 0) WHERE cliente_id % 6 > 0) ON id = processo_id)"""


@query(with_ctes("""SELECT 'bruto' AS tabela, event_id AS chave FROM events WHERE ts >= TIMESTAMP '2024-01-12' UNION ALL SELECT 'tentativa', event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 1 DAY
  UNION ALL SELECT 'cadastro', event_id FROM events WHERE event_type = 'signup' OR ts + INTERVAL 2 DAY >= TIMESTAMP '2024-01-25' - INTERVAL 7 DAY UNION ALL SELECT 'alvo', alvo_id FROM alvo WHERE cliente_id % 6 > 0
  UNION ALL SELECT 'ocorrencia', id FROM processo WHERE id % 5 = 0 AND cliente_id % 6 > 0 UNION ALL SELECT 'parte', id FROM processo WHERE custkey IN (SELECT pessoa_id FROM kept) UNION ALL SELECT 'pessoa', pessoa_id FROM kept""", "processo", "pessoa", "alvo", pes=_PEOPLE, kept=_KEPT))
def s05_retain(spark, d):
    """Every rule of keeping, as (tabela, chave) of the rows that stay; of targets those that keep their values."""
    e, cases, at = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), b.processo(spark, d), lambda day: F.lit(day).cast("timestamp")
    closed = table(spark, d, "nation").where("n_nationkey % 6 = 0").select(F.col("n_nationkey").cast("long").alias("cliente_id"))
    # The tables are dated so that each rule has something to do on the same day.
    now, key = at("2024-01-25"), F.col("event_id").alias("chave")
    raw = e.select(key, (F.col("ts") - F.make_ym_interval(F.lit(1)) + F.make_dt_interval(days=F.lit(13))).alias("coletado_em"))
    attempts = e.select(key, (F.col("ts") + F.make_dt_interval(days=F.lit(5))).alias("criado_em"))
    ups = e.select(key, F.when(F.col("event_type") == "signup", F.col("ts")).alias("concluido_em"), (F.col("ts") + F.make_dt_interval(days=F.lit(2))).alias("expira_em"))
    seen = cases.where("id % 5 = 0").select(F.col("id").alias("processo_id"), "cliente_id")
    parties = cases.select(F.col("id").alias("processo_id"), F.col("custkey").alias("pessoa_id"))
    people = b.pessoa(spark, d).select(F.col("custkey").alias("pessoa_id"), "documento")
    k = s.retain(raw, attempts, ups, b.alvo(spark, d), seen, parties, people, closed, now)
    kept = {"bruto": k.raw, "tentativa": k.attempts, "cadastro": k.sign_ups, "alvo": k.targets.where("ativo").select("alvo_id"), "ocorrencia": k.occurrences.select("processo_id"), "parte": k.parties.select("processo_id"), "pessoa": k.people.select("pessoa_id")}
    return reduce(DataFrame.union, [df.select(F.lit(name).alias("tabela"), F.col(df.columns[0]).cast("long").alias("chave")) for name, df in kept.items()])


@query()
def s06_anonymize_names(spark, d):
    """Whole texts of all documents, searched for the recipients of all of them."""
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("texto"))
    return anonymize.anonymize_names(pages, b.publicacao(spark, d).select("id", F.col("destinatario").alias("nome")))


_FOLD = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 65), lambda i: (instr('0123456789abcdef', substr(h, i, 1)) - 1)::BIGINT)), lambda a, x: (a * 16 + x) % 10000000)"


@query(with_ctes(f"""SELECT id, q || '-' || lpad((98 - (q || substr(numero_cnj, 12, 4) || '8260100')::HUGEINT * 100 % 97)::VARCHAR, 2, '0') || '.' || substr(numero_cnj, 12, 4) || '.8.26.0100' AS ficticio
  FROM (SELECT *, lpad(({_FOLD})::VARCHAR, 7, '0') AS q FROM (SELECT *, sha256(replace(replace(numero_cnj, '-', ''), '.', '')) AS h FROM processo))""", "processo"))
def s07_pseudonymize_ids(spark, d):
    return b.processo(spark, d).select("id", ids.pseudonymous_cnj(F.col("numero_cnj")).alias("ficticio"))

_MADE = "translate(substr(h, 1, 9), 'abcdef', '012345') AS f, translate(substr(h, 1, 8), 'abcdef', '012345') || '0001' AS j"


@query(with_ctes(
    f"SELECT custkey, CASE length(documento) WHEN 11 THEN f1 || {sql_check_digit('f1', ids.CPF_WEIGHTS)} WHEN 14 THEN j1 || {sql_check_digit('j1', ids.CNPJ_WEIGHTS)} END AS ficticio FROM made1", "pessoa",
    made0=f"SELECT custkey, documento, {_MADE} FROM (SELECT *, sha256(documento) AS h FROM pessoa)", made1=f"SELECT *, f || {sql_check_digit('f', ids.CPF_WEIGHTS[1:])} AS f1, j || {sql_check_digit('j', ids.CNPJ_WEIGHTS[1:])} AS j1 FROM made0",
))
def s07_pseudonymous_documents(spark, d):
    """Every document as it is written on a page, replaced by a valid fictitious one."""
    return b.pessoa(spark, d).select("custkey", ids.pseudonymous_document(ids.format_document(F.col("documento"))).alias("ficticio"))
