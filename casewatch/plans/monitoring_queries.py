"""Queries of monitoring and volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import monitoring
from . import bindings as b
from .bindings import table, with_ctes
from .catalog import query


def _runs(spark, d):
    return b.execucao(spark, d).select(F.col("event_id").alias("id"), "ts", "tribunal", "sucesso", F.lit(1).alias("consultas"), (~F.col("sucesso")).cast("int").alias("erros"), (F.col("event_type") == "purchase").cast("long").alias("novos"), F.col("event_type").alias("operacao"), F.col("value").alias("latencia"), "user_id")


@query(with_ctes("""SELECT tribunal, count(*) AS consultas, sum((NOT sucesso)::INT)::BIGINT AS erros, CASE WHEN count(*) >= 10 THEN sum((NOT sucesso)::INT) * 100 > count(*) * 20 END::VARCHAR AS abre FROM execucao WHERE ts > TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY tribunal""", "execucao"))
def g01_error_rate_alarm(spark, d):
    return monitoring.error_rate(_runs(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp"), F.lit("2024-01-15 12:00:00").cast("timestamp"), percent=20).withColumn("abre", F.col("abre").cast("string"))


_DAYS = "SELECT tribunal, (ts - INTERVAL 3 HOUR)::DATE AS dia, sum((event_type = 'purchase')::INT)::BIGINT AS total FROM execucao GROUP BY ALL"
_VOLUME = """SELECT tribunal, dia, total, CASE WHEN n >= 7 AND s >= 3 * n THEN total * n * 2 < s END AS abre FROM (SELECT *, count(*) OVER w AS n, sum(total) OVER w AS s FROM dias WINDOW w AS (PARTITION BY tribunal ORDER BY dia RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))"""


@query(with_ctes(f"SELECT tribunal, dia::VARCHAR AS dia, total, abre::VARCHAR AS abre FROM ({_VOLUME})", "execucao", dias=_DAYS))
def g02_low_volume_alarm(spark, d):
    return monitoring.low_volume(_runs(spark, d)).withColumn("abre", F.col("abre").cast("string"))


@query(with_ctes("""SELECT user_id AS sentinela, CASE WHEN max(CASE WHEN n = 1 THEN sucesso::INT END) = 1 THEN false WHEN count(*) = 2 AND NOT bool_or(sucesso) THEN true END::VARCHAR AS abre FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM execucao) WHERE n <= 2 GROUP BY user_id""", "execucao"))
def g03_canary_alarm(spark, d):
    return monitoring.canary_alarm(_runs(spark, d).withColumn("sentinela", F.col("user_id"))).select("sentinela", F.col("abre").cast("string").alias("abre"))


@query(with_ctes("""SELECT id, 'vara' AS campo, '2a Vara' AS esperado, '3ª vara' AS obtido FROM processo WHERE id % 5 = 0 UNION ALL SELECT id, 'valor', valor_causa_centavos::VARCHAR, (valor_causa_centavos + 1)::VARCHAR FROM processo WHERE id % 7 = 0""", "processo"))
def g04_compare_canary(spark, d):
    p, k = b.processo(spark, d), F.col("id")
    expected = p.select("id", F.upper("classe_nome").alias("classe"), F.lit("2a Vara").alias("vara"), F.col("valor_causa_centavos").alias("valor"))
    got = p.select("id", text.remove_accents(F.col("classe_nome")).alias("classe"), F.when(k % 5 == 0, "3ª vara").otherwise("2ª  VARA").alias("vara"), (F.col("valor_causa_centavos") + F.when(k % 7 == 0, 1).otherwise(0)).alias("valor"))
    return monitoring.compare_canary(expected, got, "id", ["classe", "vara", "valor"])


@query(with_ctes("""SELECT user_id, event_id, CASE WHEN abre THEN 'aberto' ELSE 'resolvido' END AS evento FROM (SELECT *, coalesce(lag(abre) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS era FROM (SELECT user_id, event_id, ts, NOT sucesso AS abre FROM execucao WHERE event_type <> 'signup')) WHERE abre <> era""", "execucao"))
def g05_alarm_transitions(spark, d):
    e = b.execucao(spark, d).select("user_id", "event_id", "ts", F.when(F.col("event_type") != "signup", ~F.col("sucesso")).alias("abre"))
    return monitoring.alarm_transitions(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "evento")


@query("SELECT n_name AS tribunal FROM nation WHERE n_nationkey % 3 > 0 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 30 <= 20)")
def g06_missing_units(spark, d):
    courts = table(spark, d, "nation").select(F.col("n_nationkey").alias("tribunal"), "n_name", (F.col("n_nationkey") % 3 > 0).alias("ativo"))
    k = F.col("s_suppkey")
    units = table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("tribunal"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("vigente_desde"))
    return monitoring.missing_units(courts, units, F.lit("2024-01-21").cast("date")).select(F.col("n_name").alias("tribunal"))


@query(with_ctes("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS inicio, tribunal, event_type AS operacao, count(*) AS consultas, sum((NOT sucesso)::INT)::BIGINT AS erros, round(quantile_cont(value, 0.95), 6) AS p95 FROM execucao GROUP BY 1, 2, 3""", "execucao"))
def g07_collection_metrics(spark, d):
    m = monitoring.collection_metrics(_runs(spark, d), "1 day")
    return m.withColumn("inicio", F.to_date("inicio")).withColumn("p95", F.round("p95", 6))


_LOCAL = "date_trunc('day', ts - INTERVAL 3 HOUR)"


@query(f"""WITH r AS (SELECT ts, user_id % 5 AS tribunal, CASE WHEN event_id % 2 = 0 THEN 'capa' ELSE 'lista' END AS op, event_type, event_id, value FROM events),
x AS (SELECT 'consultas_min' AS metrica, date_trunc('minute', ts) AS inicio, tribunal || '/' || op AS grupo, count(*)::DOUBLE AS valor FROM r GROUP BY ALL
  UNION ALL SELECT 'erros_hora', date_trunc('hour', ts), CASE WHEN event_id % 3 = 0 THEN 'Timeout' ELSE '?' END, count(*) FROM r WHERE event_type = 'error' GROUP BY ALL
  UNION ALL SELECT 'novos_dia', {_LOCAL}, tribunal::VARCHAR, count(*) FROM r WHERE event_type = 'signup' GROUP BY ALL
  UNION ALL SELECT 'alertas_dia', {_LOCAL}, CASE WHEN event_id % 2 = 0 THEN 'imediato' ELSE 'resumo' END || '/' || CASE WHEN event_id % 9 = 0 THEN 'falha' ELSE 'ok' END, count(*) FROM r WHERE event_type = 'view' GROUP BY ALL
  UNION ALL SELECT 'p95_latencia', date_trunc('hour', ts), tribunal || '/' || op, 1 FROM r WHERE value IS NOT NULL GROUP BY ALL)
SELECT metrica, strftime(inicio, '%Y-%m-%d %H:%M') AS inicio, grupo, valor FROM x""")
def g07_all_metrics(spark, d):
    """Of the percentiles, 1 where the sketch's rank is within 0.02 of 0.95 or of the same value; an hour's runs are few."""
    e, k = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id")
    runs = e.select("ts", (F.col("user_id") % 5).alias("tribunal"), F.when(k % 2 == 0, "capa").otherwise("lista").alias("operacao"), (F.col("event_type") != "error").alias("sucesso"), F.when(k % 3 == 0, "Timeout").alias("excecao"), F.col("value").alias("latencia"))
    cases = e.where("event_type = 'signup'").select(F.col("ts").alias("primeira_coleta_em"), (F.col("user_id") % 5).alias("tribunal"))
    alerts = e.where("event_type = 'view'").select(F.col("ts").alias("enviado_em"), F.when(k % 2 == 0, "imediato").otherwise("resumo").alias("modalidade"), F.when(k % 9 == 0, "falha").otherwise("ok").alias("resultado"))
    m = monitoring.all_metrics(runs, cases, alerts)
    at = F.date_trunc("hour", "ts").alias("inicio"), F.concat_ws("/", F.col("tribunal").cast("string"), "operacao").alias("grupo")
    near = m.where("metrica = 'p95_latencia'").join(runs.where("latencia is not null").select(*at, "latencia"), ["inicio", "grupo"]).groupBy("metrica", "inicio", "grupo", "valor").agg((F.count_if(F.col("latencia") < F.col("valor")) / F.count("*")).alias("under"), (F.count_if(F.col("latencia") <= F.col("valor")) / F.count("*")).alias("upto"))
    near = near.select("metrica", "inicio", "grupo", ((F.col("under") <= 0.97) & (F.col("upto") >= 0.93)).cast("double").alias("valor"))
    out = m.where("metrica <> 'p95_latencia'").union(near)
    return out.withColumn("inicio", F.date_format("inicio", "yyyy-MM-dd HH:mm"))


_STATE = "CASE WHEN n_nationkey % 4 = 0 THEN 'inativo' WHEN n_nationkey % 5 = 0 THEN 'bloqueado' WHEN n_nationkey % 3 = 0 THEN 'pausado' ELSE 'ok' END"
_LISTS = """r AS (SELECT user_id % 25 AS t, arg_max(event_id || ':' || sucesso, (ts, event_id)) AS execucao FROM execucao GROUP BY 1),
k AS (SELECT user_id, arg_max(sucesso || ':' || CASE WHEN sucesso THEN '' ELSE CASE WHEN event_id % 2 = 0 THEN 'classe' ELSE 'classe,foro' END END, (ts, event_id)) AS x FROM execucao GROUP BY 1),
s AS (SELECT c_nationkey AS t, string_agg(c_custkey || ':' || coalesce(x, '-'), ' ' ORDER BY c_custkey) AS sentinelas FROM customer LEFT JOIN k ON user_id = c_custkey WHERE c_custkey % 3 > 0 GROUP BY 1),
a AS (SELECT user_id % 25 AS t, string_agg(event_id::VARCHAR, ' ' ORDER BY ts, event_id::VARCHAR) AS alarmes FROM execucao WHERE NOT sucesso AND event_id % 7 = 0 GROUP BY 1),
f AS (SELECT o_custkey % 25 AS t, count(*) AS falhas FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1),
u AS (SELECT s_nationkey AS t, string_agg(s_name || ':' || (s_suppkey % 2), ' ' ORDER BY s_name) AS unidades FROM supplier GROUP BY 1)"""


@query(with_ctes(f"""SELECT n_nationkey::BIGINT AS tribunal, {_STATE} AS estado, execucao, coalesce(sentinelas, '') AS sentinelas, coalesce(alarmes, '') AS alarmes, coalesce(falhas, 0) AS falhas, coalesce(unidades, '') AS unidades
FROM (WITH {_LISTS} SELECT * FROM nation LEFT JOIN r ON r.t = n_nationkey LEFT JOIN s ON s.t = n_nationkey LEFT JOIN a ON a.t = n_nationkey LEFT JOIN f ON f.t = n_nationkey LEFT JOIN u ON u.t = n_nationkey)""", "execucao"))
def g08_court_health(spark, d):
    c = F.col
    k, e = c("n_nationkey"), b.execucao(spark, d)
    courts = table(spark, d, "nation").select(k.cast("long").alias("tribunal"), (k % 4 > 0).alias("ativo"), F.when(k % 5 == 0, "motivo").alias("bloqueado_motivo"), F.when(k % 3 == 0, F.lit("2024-03-01").cast("timestamp")).alias("pausado_ate"))
    runs = e.select((c("user_id") % 25).alias("tribunal"), "ts", c("event_id").alias("id"), "sucesso")
    canaries = table(spark, d, "customer").select(c("c_custkey").alias("sentinela"), c("c_nationkey").cast("long").alias("tribunal"), c("c_name").alias("numero_cnj"), (c("c_custkey") % 3 > 0).alias("ativo"))
    fields = F.when(c("sucesso"), F.array().cast("array<string>")).otherwise(F.when(c("event_id") % 2 == 0, F.array(F.lit("classe"))).otherwise(F.array(F.lit("classe"), F.lit("foro"))))
    checks = e.select(c("user_id").alias("sentinela"), c("event_id").alias("id"), "ts", "sucesso", F.when(~c("sucesso"), "falha").alias("erro"), fields.alias("campos"))
    alarms = e.where("not sucesso").select((c("user_id") % 25).alias("tribunal"), c("event_id").cast("string").alias("tipo"), c("ts").alias("aberto_em"), F.when(c("event_id") % 7 > 0, c("ts")).alias("resolvido_em"))
    sweeps = table(spark, d, "orders").select((c("o_custkey") % 25).alias("tribunal"), (c("o_orderkey") % 3).alias("falhas_seguidas"))
    units = table(spark, d, "supplier").select(c("s_nationkey").cast("long").alias("tribunal"), c("s_name").alias("comarca"), (c("s_suppkey") % 2).cast("string").alias("competencia"), F.lit("2024-01-01").cast("date").alias("vigente_desde"))
    h = monitoring.court_health(courts, runs, canaries, checks, alarms, sweeps, units, F.lit("2024-02-01").cast("timestamp"))
    said = lambda name, f: F.array_join(F.transform(name, f), " ").alias(name)
    text = lambda *parts: F.concat_ws(":", *[p.cast("string") for p in parts])
    return h.select(
        "tribunal", "estado", F.when(c("execucao").isNotNull(), text(c("execucao.id"), c("execucao.sucesso"))).alias("execucao"), said("sentinelas", lambda x: text(x["sentinela"], F.when(x["executada_em"].isNull(), "-").otherwise(text(x["sucesso"], F.array_join(x["campos"], ","))))),
        said("alarmes", lambda x: x["tipo"]), "falhas", said("unidades", lambda x: text(x["comarca"], x["competencia"])),
    )


@query(with_ctes("""SELECT cliente_id, count(*) FILTER (status = 'ativa') AS ativa, count(*) FILTER (status = 'atrasada') AS atrasada, count(*) FILTER (status = 'suspensa') AS suspensa, count(*) FILTER (status = 'cancelada') AS cancelada FROM assinatura GROUP BY cliente_id""", "assinatura"))
def g09_client_status_counts(spark, d):
    return monitoring.status_counts(b.assinatura(spark, d), "cliente_id", ["ativa", "atrasada", "suspensa", "cancelada"])


@query(with_ctes("""SELECT count(*) FILTER (id % 2 = 0) AS pares, count(*) FILTER (segredo) AS sigilosos, count(*) FILTER (valor_causa_centavos > 10000000) AS caros FROM processo""", "processo"))
def g11_run_summary(spark, d):
    return monitoring.run_summary(b.processo(spark, d), {"pares": F.col("id") % 2 == 0, "sigilosos": F.col("segredo"), "caros": F.col("valor_causa_centavos") > 10_000_000})


_DIMS = "classe_nome, comarca, strftime(data_distribuicao, '%Y-%m')"
_VOL = "SELECT classe_nome, comarca, strftime(data_distribuicao, '%Y-%m') AS mes, valor_causa_centavos FROM processo WHERE valor_causa_centavos >= 20000000"


@query(with_ctes("SELECT classe_nome, comarca, mes, grouping(classe_nome, comarca, mes)::BIGINT AS nivel, count(*) AS processos, sum(valor_causa_centavos)::BIGINT AS centavos FROM v GROUP BY ROLLUP (classe_nome, comarca, mes)", "processo", v=_VOL))
def g12_market_volume_rollup(spark, d):
    p = b.processo(spark, d).withColumn("mes", F.date_format("data_distribuicao", "yyyy-MM"))
    return monitoring.market_volume(p, ["classe_nome", "comarca", "mes"], 20_000_000)


@query(with_ctes("SELECT classe_nome, comarca, grouping(classe_nome, comarca)::BIGINT AS nivel, count(*) AS processos, sum(valor_causa_centavos)::BIGINT AS centavos FROM v GROUP BY CUBE (classe_nome, comarca)", "processo", v=_VOL))
def g12_market_volume_cube(spark, d):
    return monitoring.market_volume(b.processo(spark, d), ["classe_nome", "comarca"], 20_000_000, cube=True)


@query(with_ctes("SELECT processo_id, polo, count(DISTINCT pessoa_id) AS pessoas FROM parte GROUP BY ALL", "parte"))
def g13_distinct_parties(spark, d):
    return b.parte(spark, d).groupBy("processo_id", "polo").agg(F.countDistinct("pessoa_id").alias("pessoas"))
