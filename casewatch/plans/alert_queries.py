"""Queries of scoring and alerts, windows and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money_time
from ..operators import matching, monitoring, scoring
from . import bindings as b
from .bindings import table, with_ctes
from .catalog import query
from .matching_queries import E1, by_document

_FAST = "classe_codigo IN (1116, 40, 181, 92)"
_SCORED = f"""SELECT m.processo_id, m.alvo_id, m.cliente_id, 20 + CASE WHEN p.valor_causa_centavos > 20000000 THEN 15 ELSE 0 END + CASE WHEN {_FAST} THEN 15 ELSE 0 END + CASE WHEN a.prioridade = 'critica' THEN 10 ELSE 0 END AS score, p.numero_cnj, p.classe_nome
  FROM ({E1}) m JOIN processo p ON p.id = m.processo_id JOIN alvo a ON a.alvo_id = m.alvo_id"""
_MODE = "CASE WHEN score >= 60 THEN 'todos_canais' WHEN score >= 30 THEN 'email_imediato' ELSE 'resumo_diario' END"


def scored(spark, d, clients=None):
    """Occurrences by document, with score and mode: by the configuration of ``clients`` (cliente_id, config), or one for all."""
    m = matching.best_match(by_document(spark, d))
    p = b.processo(spark, d).select(F.col("id").alias("processo_id"), "valor_causa_centavos", "classe_nome", "numero_cnj", "comarca")
    j = m.join(p, "processo_id").join(b.alvo(spark, d).select("alvo_id", "prioridade"), "alvo_id")
    config, limit = None, F.lit(20_000_000)
    if clients is not None:
        j, config, limit = j.join(clients, "cliente_id"), F.col("config"), F.col("config.limite_valor_centavos")
    factors = {"polo_passivo": F.col("polo") == "passivo", "valor_acima_limite": F.col("valor_causa_centavos") > limit, "rito_rapido": scoring.is_fast_track_class(F.col("classe_nome")), "prioridade_critica": F.col("prioridade") == "critica"}
    j = j.withColumn("score", scoring.urgency_score(factors, config))
    return j.withColumn("modalidade", scoring.alert_mode(F.col("score"), config))


def _configs(spark, d):
    """What each nation's clients set: weights and a threshold, a limit, nothing that is valid, or nothing."""
    k = F.col("n_nationkey")
    said = F.when(k % 5 == 1, '{"pesos": {"polo_passivo": 50}, "limiar_todos_canais": 70}').when(k % 5 == 2, F.concat(F.lit('{"limite_valor_centavos": '), (k * 1000).cast("string"), F.lit("}"))).when(k % 5 == 3, '{"limiar_todos_canais": 70, "outro": 1}').when(k % 5 == 4, '{"pesos": {"polo_passivo": 500}, "limiar_todos_canais": 70}')
    return table(spark, d, "nation").select("n_nationkey", scoring.load_alert_config(said).alias("config"))


@query(with_ctes(f"SELECT cliente_id, {_MODE} AS modalidade, count(*) AS ocorrencias, max(score)::BIGINT AS maior FROM ({_SCORED}) GROUP BY 1, 2", "reu", "alvo", "processo"))
def flagship_alert_modes(spark, d):
    return scored(spark, d).groupBy("cliente_id", "modalidade").agg(F.count("*").alias("ocorrencias"), F.max("score").alias("maior"))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 1 THEN 50 ELSE 20 END::BIGINT AS polo_passivo, CASE n_nationkey % 5 WHEN 2 THEN n_nationkey * 1000 END::BIGINT AS limite, CASE n_nationkey % 5 WHEN 1 THEN 70 ELSE 60 END::BIGINT AS todos FROM nation""")
def f01_load_alert_config(spark, d):
    return _configs(spark, d).select("n_nationkey", "config.polo_passivo", F.col("config.limite_valor_centavos").alias("limite"), F.col("config.limiar_todos_canais").alias("todos"))


@query(with_ctes(f"SELECT id, {_FAST} AS rapido FROM processo", "processo"))
def f02_fast_track(spark, d):
    return b.processo(spark, d).select("id", scoring.is_fast_track_class(F.col("classe_nome")).alias("rapido"))


@query(with_ctes(f"SELECT processo_id, alvo_id, score::BIGINT AS score, {_MODE} AS modalidade FROM ({_SCORED})", "reu", "alvo", "processo"))
def f03_f04_score_and_mode(spark, d):
    return scored(spark, d).select("processo_id", "alvo_id", "score", "modalidade")


_OWN = f"""SELECT m.processo_id, m.alvo_id, m.cliente_id, least(100, CASE m.cliente_id % 5 WHEN 1 THEN 50 ELSE 20 END + CASE WHEN m.cliente_id % 5 = 2 AND p.valor_causa_centavos > m.cliente_id * 1000 THEN 15 ELSE 0 END
  + CASE WHEN {_FAST} THEN 15 ELSE 0 END + CASE WHEN a.prioridade = 'critica' THEN 10 ELSE 0 END) AS score FROM ({E1}) m JOIN processo p ON p.id = m.processo_id JOIN alvo a ON a.alvo_id = m.alvo_id"""


@query(with_ctes(f"""SELECT processo_id, alvo_id, score::BIGINT AS score, CASE WHEN score >= CASE cliente_id % 5 WHEN 1 THEN 70 ELSE 60 END THEN 'todos_canais' WHEN score >= 30 THEN 'email_imediato' ELSE 'resumo_diario' END AS modalidade FROM ({_OWN})""", "reu", "alvo", "processo"))
def f03_f04_own_configuration(spark, d):
    """Each client's weights, thresholds and limit of value; without a limit the value gives no points."""
    clients = _configs(spark, d).select(F.col("n_nationkey").cast("long").alias("cliente_id"), "config")
    return scored(spark, d, clients).select("processo_id", "alvo_id", "score", "modalidade")


def _alerts(spark, d):
    o = scored(spark, d).withColumn("ocorrencia", F.concat_ws("/", F.col("processo_id").cast("string"), F.col("alvo_id").cast("string"))).withColumn("criada", F.col("processo_id") % 2 == 0)
    k = F.col("n_nationkey")
    clients = table(spark, d, "nation").select(k.cast("long").alias("cliente_id"), F.when(k % 4 > 0, F.array(F.concat(F.lit(" C"), k.cast("string"), F.lit("@X.com")), F.concat(F.lit("c"), k.cast("string"), F.lit("@x.com")), F.lit("sem"))).alias("emails"), F.array(F.lit("(11) 99999-8888")).alias("whatsapp"))
    return scoring.fan_out_alerts(o, clients), o


_ALERTS = f"""SELECT processo_id || '/' || alvo_id AS ocorrencia, cliente_id, 'email' AS canal, 'c' || cliente_id || '@x.com' AS destino, CASE WHEN score >= 30 THEN 'imediato' ELSE 'resumo_diario' END AS envio, score, numero_cnj FROM sc WHERE processo_id % 2 = 0 AND cliente_id % 4 > 0
UNION ALL SELECT processo_id || '/' || alvo_id, cliente_id, 'whatsapp', '5511999998888', 'imediato', score, numero_cnj FROM sc WHERE processo_id % 2 = 0"""


@query(with_ctes("SELECT ocorrencia, cliente_id, canal, destino, envio FROM al", "reu", "alvo", "processo", sc=_SCORED, al=_ALERTS))
def f05_fan_out_alerts(spark, d):
    return _alerts(spark, d)[0]


@query(with_ctes("""SELECT a.ocorrencia, a.canal, p.numero_cnj, p.classe_nome, p.comarca, r.nome AS passivo, CASE WHEN p.id % 5 > 0 THEN p.assunto_nome || '; Outro' ELSE 'não informados' END AS assuntos,
  CASE t.alvo_id % 3 WHEN 0 THEN 'Alvo: apelido ' || t.alvo_id WHEN 1 THEN CASE WHEN length(t.valor) = 11 THEN 'Alvo: CPF monitorado' ELSE 'Alvo: CNPJ monitorado' END ELSE 'Alvo monitorado' END AS motivo
  FROM al a JOIN processo p ON p.id::VARCHAR = split_part(a.ocorrencia, '/', 1) JOIN reu r ON r.processo_id = p.id JOIN alvo t ON t.alvo_id::VARCHAR = split_part(a.ocorrencia, '/', 2)""", "reu", "alvo", "processo", sc=_SCORED, al=_ALERTS))
def f06_alert_payload(spark, d):
    """A third of the targets have nicknames, a third none, a third are gone."""
    alerts, o = _alerts(spark, d)
    k = F.col("alvo_id")
    targets = b.alvo(spark, d).where("alvo_id % 3 < 2").select("alvo_id", F.lit("documento").alias("tipo"), "valor", F.when(k % 3 == 0, F.concat(F.lit(" apelido "), k.cast("string"))).otherwise(" ").alias("apelido"))
    rules = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("regra_id"), F.col("r_name").alias("nome"))
    why = scoring.reason_label(o.select("ocorrencia", "processo_id", F.lit("alvo").alias("tipo"), k.alias("ref")), targets, rules)
    cases = b.processo(spark, d).drop("cliente_id").withColumn("assuntos", F.when(F.col("id") % 5 > 0, F.array(F.lit(""), "assunto_nome", F.lit("Outro"))))
    out = scoring.alert_payload(alerts.select("ocorrencia", "canal").join(why.select("ocorrencia", "processo_id", "motivo"), "ocorrencia"), cases, b.reu(spark, d))
    return out.select("ocorrencia", "canal", "numero_cnj", "classe_nome", "comarca", "passivo", "assuntos", "motivo")


@query(with_ctes("""SELECT cliente_id, destino, count(*)::INT AS itens, string_agg(n || '. ' || numero_cnj, chr(10) ORDER BY n) AS corpo FROM (SELECT *, row_number() OVER (PARTITION BY cliente_id, destino ORDER BY score DESC, ocorrencia) AS n FROM al WHERE envio = 'resumo_diario') GROUP BY 1, 2""", "reu", "alvo", "processo", sc=_SCORED, al=_ALERTS))
def f07_daily_digest(spark, d):
    alerts, o = _alerts(spark, d)
    a = alerts.join(o.select("ocorrencia", "score", F.col("numero_cnj").alias("titulo")), "ocorrencia")
    return scoring.daily_digest(a)


@query("""SELECT alerta, tentativas, CASE WHEN ok THEN 'enviado' WHEN tentativas >= 3 THEN 'falhou' WHEN alerta % 2 = 0 AND desde < TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR THEN 'expirado' ELSE 'pendente' END AS status
  FROM (SELECT event_id // 4 AS alerta, count(*) FILTER (event_type NOT IN ('view', 'purchase')) AS tentativas, bool_or(event_type IN ('view', 'purchase')) AS ok, min(ts) AS desde FROM events GROUP BY 1)""")
def f08_alert_lifecycle(spark, d):
    e, k = table(spark, d, "events"), F.floor(F.col("event_id") / 4)
    log = e.select(k.alias("alerta"), F.when(k % 2 == 0, "whatsapp").otherwise("email").alias("canal"), F.col("ts").cast("timestamp").alias("criado_em"), F.col("event_type").isin("view", "purchase").alias("sucesso"))
    return scoring.alert_lifecycle(log, F.lit("2024-01-20").cast("timestamp")).select("alerta", "tentativas", "status")


@query(with_ctes("""SELECT id, termo FROM (SELECT id, classe_nome AS termo, row_number() OVER (PARTITION BY classe_nome ORDER BY data_distribuicao, id) AS n FROM processo) WHERE termo = 'Monitória' OR n <= CASE termo WHEN 'Execução Fiscal' THEN 500 - 100 ELSE 300 END""", "processo"))
def f09_monthly_term_limit(spark, d):
    p = b.processo(spark, d).select("id", F.col("classe_nome").alias("termo"), "data_distribuicao")
    t = F.col("termo")
    used = p.select("termo").distinct().select("termo", F.when(t == "Execução Fiscal", 100).alias("usados"), F.when(t == "Execução Fiscal", 500).when(t != "Monitória", 300).alias("limite"))
    return scoring.monthly_term_limit(p, used, ["data_distribuicao", "id"]).select("id", "termo")


@query(with_ctes("""SELECT id, NOT (id % 5 = 0 OR (id % 3 = 0 AND data_distribuicao + 2 < DATE '1998-06-01' - 3) OR (id % 2 = 0 AND data_distribuicao < DATE '1998-06-01' - 7)) AS avisa FROM processo""", "processo"))
def f10_should_alert(spark, d):
    k, day = F.col("id"), F.col("data_distribuicao")
    seen = F.when(k % 3 == 0, F.date_add(day, 2))
    return b.processo(spark, d).select("id", scoring.should_alert(k % 5 == 0, seen, k % 2 == 0, day, F.lit("1998-06-01").cast("date")).alias("avisa"))


@query("""SELECT termo, c_custkey AS alvo_id FROM (SELECT *, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY termo) AS n FROM (SELECT c_custkey % 300 AS termo, c_nationkey, c_custkey FROM customer WHERE c_custkey % 4 > 0)) WHERE n <= 3 UNION ALL SELECT c_custkey % 300, c_custkey FROM customer WHERE c_custkey % 4 = 0""")
def w02_cap_initial_loads(spark, d):
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select((k % 300).alias("termo"), (k % 300).alias("ordem"), F.col("c_nationkey").alias("cliente_id"), k.alias("alvo_id"), (k % 4 == 0).alias("em_dia"))
    return scoring.cap_initial_loads(t).select("termo", "alvo_id")


@query("""SELECT tribunal, id, posicao FROM (SELECT user_id % 5 AS tribunal, event_id AS id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_type = 'purchase' DESC, ts, event_id)::INT AS posicao FROM events WHERE ts <= TIMESTAMP '2024-01-16') WHERE posicao <= 50""")
def w03_due_queries(spark, d):
    e = b.execucao(spark, d).select("tribunal", F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("critica"), F.col("ts").alias("proxima"))
    return monitoring.due_queries(e, F.lit("2024-01-16").cast("timestamp")).select("tribunal", "id", "posicao")


@query("""SELECT event_id, strftime(CASE WHEN f > 0 THEN ts + to_minutes(CASE f WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 15 ELSE 60 END) WHEN event_type = 'purchase' THEN ts + INTERVAL 4 HOUR
  ELSE least(ts + INTERVAL 1 DAY, date_trunc('day', ts - INTERVAL 3 HOUR) + INTERVAL 24 HOUR + CASE WHEN hour(ts - INTERVAL 3 HOUR) >= 21 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END) END, '%Y-%m-%d %H:%M:%S') AS proxima FROM (SELECT *, event_id % 7 - 1 AS f FROM events)""")
def w04_next_run_time(spark, d):
    e = b.execucao(spark, d)
    at = monitoring.next_run_time(F.col("ts"), F.col("event_type") == "purchase", (F.col("event_id") % 7 - 1).cast("int"))
    return e.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("proxima"))


@query(with_ctes("SELECT id, numero_cnj FROM processo WHERE id < 9000 ORDER BY id DESC LIMIT 51", "processo"))
def w05_page_after(spark, d):
    return monitoring.page_after(b.processo(spark, d).select("id", "numero_cnj"), 9000, 50)


@query("""SELECT o_orderkey, (o_orderdate::DATE + (i * 4)::INT)::VARCHAR AS inicio, least(o_orderdate::DATE + (i * 4 + 3)::INT, o_orderdate::DATE + (o_orderkey % 11)::INT)::VARCHAR AS fim FROM orders, LATERAL (SELECT unnest(range(0, o_orderkey % 11 // 4 + 1)) AS i)""")
def w07_date_windows(spark, d):
    day = F.to_date("o_orderdate")
    end = F.date_add(day, (F.col("o_orderkey") % 11).cast("int"))
    w = table(spark, d, "orders").select("o_orderkey", F.explode(money_time.date_windows(day, end, 4)).alias("w"))
    return w.select("o_orderkey", F.col("w.first").cast("date").alias("inicio"), F.col("w.last").cast("date").alias("fim"))


@query("""WITH l AS (SELECT event_type AS acao, user_id AS chave, list({'k': [epoch_us(ts)], 'o': [event_id]} ORDER BY ts, event_id) AS l FROM events GROUP BY 1, 2),
f AS (SELECT acao, chave, l, list_reduce(list_prepend({'k': []::BIGINT[], 'o': []::BIGINT[]}, l), lambda a, x:
  CASE WHEN len(list_filter(a.k, lambda t: t > x.k[1] - 5 * 86400000000)) < 3 THEN {'k': list_append(list_filter(a.k, lambda t: t > x.k[1] - 5 * 86400000000), x.k[1]), 'o': list_append(a.o, x.o[1])} ELSE a END).o AS permitted FROM l)
SELECT acao, chave, id, list_contains(permitted, id) AS permitida FROM (SELECT acao, chave, permitted, unnest(list_transform(l, lambda x: x.o[1])) AS id FROM f)""")
def w08_rate_limit_attempts(spark, d):
    e = b.execucao(spark, d).select(F.col("event_type").alias("acao"), F.col("user_id").alias("chave"), "ts", F.col("event_id").alias("id"))
    return monitoring.rate_limit_attempts(e, 3, 5 * 86_400)
