"""Queries of the streaming jobs over the driver's tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.keyed import KeyedTable
from ..sources.shared import shared_folder as folder
from ..streaming import jobs, matches
from . import bindings as b
from .bindings import sql_norm, sql_trgm, table, with_ctes
from .catalog import query
from .matching_queries import cases, rules
from .subscription_queries import APPLIED


def _events(spark: SparkSession, d: str) -> DataFrame:
    return jobs.file_stream(spark, d, "events").withColumn("ts", jobs.utc(F.col("ts")))


@query("SELECT DISTINCT event_type AS fonte, user_id::VARCHAR AS id_externo FROM events")
def t01_stream_publications(spark, d):
    e = _events(spark, d).select(F.col("event_type").alias("fonte"), F.col("user_id").cast("string").alias("id_externo"), F.col("ts").alias("disponivel_em"))
    return jobs.run_available(jobs.stream_publications(e), folder(spark), "append").select("fonte", "id_externo")


@query("SELECT user_id % 10 AS varredura, (event_id // 3)::VARCHAR AS numero_cnj, NOT bool_or(event_type = 'signup') AS avisa FROM events GROUP BY 1, 2")
def t02_stream_new_cases(spark, d):
    e = _events(spark, d).select((F.col("user_id") % 10).alias("varredura"), F.floor(F.col("event_id") / 3).cast("string").alias("numero_cnj"), (F.col("event_type") == "signup").alias("base"), F.col("ts").alias("vista_em"))
    return jobs.run_available(jobs.stream_new_cases(e), folder(spark), "append").drop("batch_")


_CLIENTS = """SELECT n_nationkey::BIGINT AS cliente_id, CASE n_nationkey % 5 WHEN 1 THEN 50 ELSE 20 END AS peso, CASE n_nationkey % 5 WHEN 2 THEN 20000000 END AS limite, CASE n_nationkey % 5 WHEN 1 THEN 70 ELSE 60 END AS todos, 1 + (n_nationkey % 4 > 0)::INT AS alertas FROM nation"""
_CASE = f"""SELECT p.*, CASE WHEN p.id % 3 > 0 THEN u.documento END AS doc, {sql_norm("u.nome")} AS n, CASE WHEN p.id % 4 = 1 THEN u.documento END AS consulta FROM processo p JOIN pessoa u USING (custkey) WHERE NOT segredo"""
_TARGET = f"""SELECT custkey AS alvo_id, cliente_id, 'documento' AS tipo, documento AS valor, CASE WHEN custkey % 10 = 0 THEN {sql_norm("nome")} END AS nome, c_mktsegment = 'BUILDING' AS critica FROM pessoa WHERE custkey % 5 = 0 AND documento IS NOT NULL
  UNION ALL SELECT custkey, cliente_id, 'nome', {sql_norm("nome")}, {sql_norm("nome")}, c_mktsegment = 'BUILDING' FROM pessoa WHERE custkey % 20 = 1"""
_ALIKE = f"""SELECT a.n, b.nome FROM (SELECT n, {sql_trgm("n")} AS g FROM (SELECT DISTINCT n FROM caso)) a, (SELECT nome, {sql_trgm("nome")} AS g FROM (SELECT DISTINCT nome FROM t WHERE nome <> '')) b
  WHERE len(list_intersect(a.g, b.g)) * 100 >= 90 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))"""
_FOUND = """SELECT processo_id, alvo_id, cliente_id, critica, CASE WHEN r = 1 THEN lado ELSE 'passivo' END AS polo, CASE WHEN r < 2 THEN 'confirmada' ELSE 'a_verificar' END AS confianca, CASE r WHEN 0 THEN 'documento' WHEN 1 THEN 'busca_documento' ELSE 'nome' END AS criterio
  FROM (SELECT processo_id, alvo_id, cliente_id, critica, min(r) AS r, max(CASE WHEN r = 2 THEN 'passivo' END) AS lado FROM (
    SELECT c.id AS processo_id, alvo_id, t.cliente_id, critica, 0 AS r FROM caso c JOIN t ON c.doc = t.valor AND tipo = 'documento'
    UNION ALL SELECT c.id, alvo_id, t.cliente_id, critica, 1 FROM caso c JOIN t ON c.consulta = t.valor AND tipo = 'documento'
    UNION ALL SELECT c.id, alvo_id, t.cliente_id, critica, 2 FROM caso c JOIN alike USING (n) JOIN t USING (nome) WHERE tipo <> 'documento' OR doc IS NULL) GROUP BY ALL)"""
_ASKED = """SELECT c.id AS processo_id, k * 10 + t AS regra_id, k AS cliente_id, CASE WHEN t = 4 THEN 'passivo' END AS polo, CASE WHEN t = 4 THEN (SELECT max(f.confianca) FROM found f WHERE f.processo_id = c.id AND f.cliente_id = k AND f.polo = 'passivo') ELSE 'confirmada' END AS confianca
  FROM (SELECT r_regionkey::BIGINT AS k, unnest([0, 1, 2, 3, 4]) AS t FROM region) r, caso c WHERE CASE t WHEN 0 THEN classe_codigo IN (1116, 40) AND comarca IN ('NATION_1', 'NATION_2', 'NATION_3') WHEN 1 THEN assunto_codigo = 9580 AND valor_causa_centavos >= 15000000 + k * 1000000
    WHEN 2 THEN comarca IN ('NATION_1', 'NATION_2', 'NATION_3') WHEN 3 THEN (classe_codigo = 181 OR assunto_codigo = 10433) AND valor_causa_centavos >= 15000000 + k * 1000000 ELSE true END"""
_OCC = """SELECT processo_id, 'alvo' AS tipo, alvo_id AS ref, cliente_id, polo, confianca, criterio, critica FROM found UNION ALL SELECT processo_id, 'regra', regra_id, cliente_id, polo, confianca, 'regra', false FROM asked WHERE confianca IS NOT NULL"""


@query(with_ctes("""SELECT processo_id, tipo, ref, cliente_id, polo, confianca, criterio, score::BIGINT AS score, CASE WHEN score >= todos THEN 'todos_canais' WHEN score >= 30 THEN 'email_imediato' ELSE 'resumo_diario' END AS modalidade, alertas::BIGINT AS alertas
  FROM (SELECT o.*, todos, alertas, least(100, CASE WHEN polo = 'passivo' THEN peso ELSE 0 END + CASE WHEN valor_causa_centavos > limite THEN 15 ELSE 0 END + CASE WHEN classe_codigo IN (1116, 40, 181, 92) THEN 15 ELSE 0 END + CASE WHEN critica THEN 10 ELSE 0 END) AS score
    FROM occ o JOIN caso c ON c.id = o.processo_id JOIN cli ON cli.cliente_id = o.cliente_id)""", "processo", "pessoa", caso=_CASE, t=_TARGET, alike=_ALIKE, found=_FOUND, asked=_ASKED, occ=_OCC, cli=_CLIENTS))
def t03_stream_matches(spark, d):
    """Targets, cases and rules by turns, each stream begun anew for each of its batches; the alerts of an occurrence are counted."""
    people = b.pessoa(spark, d).withColumn("n", text.normalize_name(F.col("nome"), False))
    none, k = F.array().cast("array<string>"), F.col("custkey")
    covers = cases(spark, d).join(people.select("custkey", "documento", "n"), "custkey")
    side = F.struct(F.lit("passivo").alias("polo"), F.col("n").alias("nome_normalizado"), F.when(F.col("id") % 3 > 0, F.col("documento")).alias("documento"))
    covers = covers.withColumns({"partes": F.array(side), "consultados": F.when((F.col("id") % 4 == 1) & F.col("documento").isNotNull(), F.array("documento")).otherwise(none), "atualizado": F.lit(1).cast("long")})
    of = lambda kind: people.where("custkey % 5 = 0 and documento is not null" if kind == "documento" else "custkey % 20 = 1").withColumns({"tipo": F.lit(kind), "valor": F.col("documento" if kind == "documento" else "n")})
    watched = of("documento").unionByName(of("nome")).withColumns({"alvo_id": k, "variacoes": F.when(F.col("tipo") == "documento", F.when(k % 10 == 0, F.array("n"))), "prioridade": F.when(F.col("c_mktsegment") == "BUILDING", "critica").otherwise("padrao")})
    on = {"ativo": F.lit(True), "atualizado": F.lit(1).cast("long")}
    feeds = {"cases": (covers, matches.CASES), "targets": (watched.withColumns(on), matches.TARGETS), "rules": (rules(spark, d).withColumns(on), matches.RULES)}
    at, n = folder(spark), F.col("n_nationkey")
    said = F.when(n % 5 == 1, '{"pesos": {"polo_passivo": 50}, "limiar_todos_canais": 70}').when(n % 5 == 2, '{"limite_valor_centavos": 20000000}').when(n % 5 == 3, '{"limiar_todos_canais": 70, "outro": 1}')
    clients = table(spark, d, "nation").select(n.cast("long").alias("cliente_id"), said.alias("config_alertas"), F.when(n % 4 > 0, F.array(F.concat(F.lit("c"), n.cast("string"), F.lit("@x.com")))).otherwise(none).alias("emails"), F.array(F.lit("(11) 99999-8888")).alias("whatsapp"))
    job = matches.MatchStreams(spark, f"{at}/job", clients, parts=8)
    slices = {}
    for name, (rows, ddl) in feeds.items():
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], ddl).schema])
        half = F.pmod(F.xxhash64(rows.columns[0]), F.lit(2))
        slices[name] = jobs.fed(rows, f"{at}/{name}", [half == 0, half == 1] if name != "rules" else [F.lit(True)])
    for name in ("targets", "cases", "rules", "cases", "targets"):
        jobs.run_batches(next(slices[name]), f"{at}/state-{name}", getattr(job, f"add_{name}"))
    told = job.outbox.read().groupBy("ocorrencia").agg(F.count("*").alias("alertas"))
    made = job.occurrences.read().withColumn("ocorrencia", F.concat_ws("/", "processo_id", "tipo", "ref")).join(told, "ocorrencia", "left")
    return made.select("processo_id", "tipo", "ref", "cliente_id", "polo", "confianca", "criterio", "score", "modalidade", F.coalesce("alertas", F.lit(0)).alias("alertas"))


@query("""SELECT strftime(s, '%Y-%m-%d %H:%M') AS inicio, tribunal, count(*) AS consultas, sum(e)::BIGINT AS erros FROM (SELECT user_id % 5 AS tribunal, (event_type = 'error')::INT AS e, unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 55 MINUTE, time_bucket(INTERVAL 5 MINUTE, ts), INTERVAL 5 MINUTE)) AS s FROM events) GROUP BY 1, 2""")
def t04_stream_error_rate(spark, d):
    e = _events(spark, d).select("ts", (F.col("user_id") % 5).alias("tribunal"), F.lit(1).alias("consultas"), (F.col("event_type") == "error").cast("int").alias("erros"))
    out = jobs.last_of_each(jobs.run_available(jobs.stream_error_rate(e), folder(spark)), ["inicio", "tribunal"])
    return out.select(F.date_format("inicio", "yyyy-MM-dd HH:mm").alias("inicio"), "tribunal", "consultas", "erros")


@query("SELECT ((ts - INTERVAL 3 HOUR)::DATE)::VARCHAR AS dia, user_id % 5 AS tribunal, sum((event_type = 'purchase')::INT)::BIGINT AS total FROM events GROUP BY 1, 2")
def t05_stream_daily_volume(spark, d):
    e = _events(spark, d).select("ts", (F.col("user_id") % 5).alias("tribunal"), (F.col("event_type") == "purchase").cast("long").alias("novos"))
    return jobs.last_of_each(jobs.run_available(jobs.stream_daily_volume(e), folder(spark)), ["dia", "tribunal"])


@query(APPLIED.format(all="false"))
def t06_stream_payments(spark, d):
    """Three batches by time, each telling all payments of the one before again."""
    e, k = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("event_type = 'purchase'"), F.col("event_id")
    told = e.select(F.col("user_id").alias("assinatura"), F.floor(k / 2).alias("pagamento"), F.to_date("ts").alias("pago_em"), F.when(k % 10 == 0, 12).otherwise(1).alias("meses"), F.lit("2024-01-10").cast("date").alias("vigente_ate"), F.col("ts").alias("dito_em"))
    part = F.when(F.col("dito_em") < "2024-01-12", 0).when(F.col("dito_em") < "2024-01-22", 1).otherwise(2)
    told = told.withColumn("batch", F.explode(F.when(part < 2, F.array(part, part + 1)).otherwise(F.array(part))))
    at = folder(spark)
    for stream in jobs.fed(told, f"{at}/in", [F.col("batch") == i for i in range(3)]):
        out = jobs.stream_payments(stream.drop("batch"))
        jobs.run_batches(out, f"{at}/state", jobs.appender(at))
    return jobs.last_of_each(jobs.outputs(out, at), ["assinatura"])


@query("""WITH e AS (SELECT user_id AS sentinela, event_id AS id, ts, event_type <> 'error' AS ok, lag(event_type <> 'error') OVER w AS antes FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CASE WHEN ok THEN false WHEN NOT antes THEN true END AS abre FROM e), k AS (SELECT *, coalesce(lag(abre) OVER (PARTITION BY sentinela ORDER BY ts, id), false) AS era FROM s WHERE abre IS NOT NULL)
SELECT sentinela, id, CASE WHEN abre THEN 'aberto' ELSE 'resolvido' END AS evento FROM k WHERE abre <> era""")
def t07_stream_consecutive_failures(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("sentinela"), F.col("event_id").alias("id"), "ts", (F.col("event_type") != "error").alias("sucesso"))
    return jobs.run_available(jobs.stream_consecutive_failures(e), folder(spark), "append").drop("batch_")


@query("SELECT user_id AS numero, max(ts)::VARCHAR AS atualizado, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1".replace("max(ts)::VARCHAR", "strftime(max(ts), '%Y-%m-%d %H:%M')"))
def t08_late_updates(spark, d):
    """Three batches dealt by a hash, so that each has older and newer rows of the same keys than those before."""
    e = table(spark, d, "events").select(F.col("user_id").alias("numero"), F.col("ts").cast("timestamp").alias("atualizado"), "event_id")
    at = folder(spark)
    kept = KeyedTable(spark, f"{at}/t", ["numero"], parts=8)
    for stream in jobs.fed(e, f"{at}/in", [F.pmod(F.xxhash64("event_id"), F.lit(3)) == i for i in range(3)]):
        jobs.run_batches(stream, f"{at}/state", jobs.upsert_batch(kept, "atualizado"))
    return kept.read().select("numero", F.date_format("atualizado", "yyyy-MM-dd HH:mm").alias("atualizado"), "event_id")
