"""Queries of deduplication, resolution and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import entities
from ..sources import sinks
from . import bindings as b
from .bindings import sql_norm, sql_trgm, table, with_ctes
from .catalog import query


@query("""WITH both_ AS (SELECT o_orderkey % 5000 AS k, o_totalprice AS v, 0 AS new_, o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey % 5000, o_totalprice, 1, o_orderkey FROM orders WHERE o_orderkey % 2 = 1)
SELECT k, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY new_ DESC, o_orderkey DESC) AS n FROM both_) WHERE n = 1""")
def a06_merge_by_key(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 5000).alias("k"), "o_totalprice", "o_orderkey")
    return sinks.merge_by_key(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["k"], F.col("o_orderkey")).select("k", "o_orderkey")


@query("""SELECT DISTINCT user_id AS ocorrencia, event_type AS canal, 'd' || user_id % 7 AS destino FROM events e WHERE event_id % 3 > 0 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 3 = 0 AND s.user_id = e.user_id AND s.event_type = e.event_type)""")
def a07_outbox(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("ocorrencia"), F.col("event_type").alias("canal"), F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("destino"))
    return sinks.new_for_outbox(e.where("event_id % 3 > 0").drop("event_id"), e.where("event_id % 3 = 0"))


@query(with_ctes("SELECT fonte, (id // 3)::VARCHAR AS id_externo, min(id) AS id FROM publicacao GROUP BY ALL", "publicacao"))
def d01_dedup_publications(spark, d):
    p = b.publicacao(spark, d).select("fonte", F.floor(F.col("id") / 3).cast("string").alias("id_externo"), "id")
    return entities.dedup_publications(p, F.col("id"))


@query(with_ctes("""SELECT coalesce(n.numero_cnj, e.numero_cnj) AS numero_cnj, coalesce(n.v, e.v) AS valor, least(e.t, n.t)::VARCHAR AS desde, e.numero_cnj IS NULL AS novo
  FROM (SELECT numero_cnj, valor_causa_centavos AS v, data_distribuicao AS t FROM processo WHERE id % 3 < 2) e FULL JOIN (SELECT numero_cnj, valor_causa_centavos + 1 AS v, data_distribuicao + 10 AS t FROM processo WHERE id % 3 > 0) n ON e.numero_cnj = n.numero_cnj""", "processo"))
def d02_upsert_cases(spark, d):
    p = b.processo(spark, d)
    old = p.where("id % 3 < 2").select("numero_cnj", F.col("valor_causa_centavos").alias("valor"), F.col("data_distribuicao").alias("primeira_coleta_em"))
    new = p.where("id % 3 > 0").select("numero_cnj", (F.col("valor_causa_centavos") + 1).alias("valor"), F.date_add("data_distribuicao", 10).alias("primeira_coleta_em"))
    return entities.upsert_cases(old, new.union(new)).select("numero_cnj", "valor", F.col("primeira_coleta_em").alias("desde"), "novo")


_PARTIES = "SELECT processo_id, polo, CASE WHEN pessoa_id % 3 = 0 THEN 'doc' || pessoa_id END AS documento, 'N' || pessoa_id AS nome_normalizado, ordem, 'adv' || ordem % 3 AS a FROM parte"


@query(with_ctes(f"""SELECT processo_id, polo, documento, nome_normalizado, min(ordem) AS ordem, string_agg(a, ',' ORDER BY o) AS advogados FROM (SELECT processo_id, polo, documento, nome_normalizado, a, min(ordem) AS o, min(ordem) AS ordem FROM ({_PARTIES}) GROUP BY ALL) GROUP BY processo_id, polo, documento, nome_normalizado""".replace("a, min(ordem) AS o, min(ordem) AS ordem", "a, min(ordem) AS o, min(ordem) AS ordem"), "parte"))
def d03_dedup_parties(spark, d):
    p = b.parte(spark, d)
    rows = p.select("processo_id", "polo", F.when(F.col("pessoa_id") % 3 == 0, F.concat(F.lit("doc"), "pessoa_id")).alias("documento"), F.concat(F.lit("N"), "pessoa_id").alias("nome_normalizado"), "ordem", F.array(F.concat(F.lit("adv"), F.col("ordem") % 3)).alias("advogados"))
    return entities.dedup_parties(rows).withColumn("advogados", F.array_join("advogados", ","))


@query("SELECT DISTINCT l_orderkey AS parte, s_name AS nome, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 100 END AS oab_numero, CASE WHEN s_suppkey % 2 = 0 THEN 'SP' END AS oab_uf FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def d04_dedup_lawyers(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return entities.dedup_lawyers(j.select(F.col("l_orderkey").alias("parte"), F.col("s_name").alias("nome"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 100).alias("oab_numero"), F.when(F.col("s_suppkey") % 2 == 0, "SP").alias("oab_uf")))


@query("""WITH m AS (SELECT DISTINCT l_orderkey, sha256(strftime(l_shipdate, '%Y-%m-%d') || '|' || l_returnflag || ' ' || l_linestatus || ' ' || l_linenumber) AS resumo, l_linenumber FROM lineitem)
SELECT l_orderkey, resumo FROM m WHERE l_linenumber > 2 AND (l_orderkey, resumo) NOT IN (SELECT (l_orderkey, resumo) FROM m WHERE l_linenumber <= 2)""")
def d05_dedup_movements(spark, d):
    line = table(spark, d, "lineitem")
    said = F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    rows = line.select("l_orderkey", ids.movement_hash(F.col("l_shipdate"), said).alias("resumo"), "l_linenumber")
    return entities.new_rows(rows.where("l_linenumber > 2"), rows.where("l_linenumber <= 2"), ["l_orderkey", "resumo"])


@query(with_ctes("""SELECT processo_id, coalesce(k.custkey, n.pessoa_id) AS pessoa_id, k.custkey IS NULL AS nova, 'confirmada' AS vinculo FROM reu LEFT JOIN (SELECT custkey, documento FROM pessoa WHERE custkey % 2 = 0) k USING (documento)
  LEFT JOIN (SELECT documento, (SELECT max(custkey) FROM pessoa WHERE custkey % 2 = 0) + row_number() OVER (ORDER BY documento) AS pessoa_id FROM (SELECT DISTINCT documento FROM reu WHERE documento NOT IN (SELECT documento FROM pessoa WHERE custkey % 2 = 0 AND documento IS NOT NULL))) n USING (documento) WHERE documento IS NOT NULL""", "reu", "pessoa"))
def d06_resolve_by_document(spark, d):
    """A row for each party; half of the people are known before."""
    people = b.pessoa(spark, d).where("custkey % 2 = 0").select(F.col("custkey").alias("pessoa_id"), "documento")
    r = entities.resolve_by_document(b.reu(spark, d), people)
    return r.select("processo_id", "pessoa_id", "nova", F.col("confianca_vinculo").alias("vinculo"))


_NAMES = f"SELECT id, tribunal AS comarca, {sql_norm('destinatario')} AS nome FROM publicacao"


@query(with_ctes(f"""SELECT p.nome AS nome_normalizado, p.comarca, CASE WHEN l.pessoa_id IS NULL THEN 'nova' ELSE l.pessoa_id::VARCHAR END AS pessoa FROM (SELECT DISTINCT nome, comarca FROM nomes WHERE id % 2 = 1 AND nome <> '') p
  LEFT JOIN (SELECT q.nome, min(x.pessoa_id) AS pessoa_id, count(DISTINCT x.pessoa_id) AS n, min(x.nome) AS outro FROM (SELECT DISTINCT nome FROM nomes WHERE id % 2 = 1 AND nome <> '') q
    JOIN pess x ON len(list_intersect({sql_trgm('q.nome')}, {sql_trgm('x.nome')})) * 100 >= 85 * len(list_distinct(list_concat({sql_trgm('q.nome')}, {sql_trgm('x.nome')}))) GROUP BY q.nome) l
  ON l.nome = p.nome AND l.n = 1 AND l.outro = p.nome AND EXISTS (SELECT 1 FROM nomes a WHERE a.id % 2 = 0 AND a.nome = l.outro AND a.comarca = p.comarca)""", "publicacao", nomes=_NAMES, pess="SELECT nome, min(id) AS pessoa_id FROM nomes WHERE id % 2 = 0 AND nome <> '' GROUP BY nome"))
def d07_resolve_by_name(spark, d):
    names = b.publicacao(spark, d).select("id", F.col("tribunal").alias("comarca"), text.normalize_name(F.col("destinatario"), False).alias("nome_normalizado")).where("nome_normalizado <> ''")
    people = names.where("id % 2 = 0").groupBy("nome_normalizado").agg(F.min("id").alias("pessoa_id"))
    active = names.where("id % 2 = 0").join(people, "nome_normalizado").select("pessoa_id", "comarca")
    out = entities.resolve_by_name(names.where("id % 2 = 1"), people, active)
    return out.select("nome_normalizado", "comarca", F.when(F.col("nova"), "nova").otherwise(F.col("pessoa_id").cast("string")).alias("pessoa"))


@query(with_ctes("""SELECT DISTINCT p.processo_id, p.polo, 'N' || p.pessoa_id % 50 AS nome_normalizado, (SELECT arg_min(x.pessoa_id, x.ordem) FROM parte x WHERE x.ordem <= 2 AND x.processo_id = p.processo_id AND x.polo = p.polo AND x.pessoa_id % 50 = p.pessoa_id % 50) IS NOT NULL AS reusa FROM parte p WHERE p.ordem > 2""", "parte"))
def d08_reuse_existing_party(spark, d):
    p = b.parte(spark, d).select("processo_id", "polo", F.concat(F.lit("N"), (F.col("pessoa_id") % 50).cast("string")).alias("nome_normalizado"), "pessoa_id", "ordem")
    known = p.where("ordem <= 2").select("processo_id", "polo", "nome_normalizado", "pessoa_id", F.col("ordem").alias("parte_id"))
    out = entities.reuse_existing_party(p.where("ordem > 2").select("processo_id", "polo", "nome_normalizado").distinct(), known)
    return out.select("processo_id", "polo", "nome_normalizado", F.col("pessoa_id").isNotNull().alias("reusa"))


@query(with_ctes("SELECT polo, count(*) AS n FROM parte WHERE processo_id NOT IN (SELECT id FROM processo WHERE segredo) GROUP BY polo", "parte", "processo"))
def d09_purge_sealed(spark, d):
    return entities.purge_sealed(b.parte(spark, d), b.processo(spark, d)).groupBy("polo").agg(F.count("*").alias("n"))


@query(with_ctes("""SELECT id, CASE WHEN id % 4 = 0 AND id % 3 > 0 THEN 999 WHEN id % 4 = 0 THEN NULL ELSE classe_codigo END::BIGINT AS classe_codigo, CASE WHEN id % 5 = 0 AND id % 3 > 0 THEN 'Vara ' || id WHEN id % 5 = 0 THEN NULL ELSE 'V' END AS vara, CASE WHEN id % 7 > 1 THEN assunto_nome WHEN id % 3 > 0 THEN 'A; B' ELSE '' END AS assuntos FROM processo""", "processo"))
def d10_fill_missing(spark, d):
    p, k = b.processo(spark, d), F.col("id")
    cases = p.select("id", "numero_cnj", F.when(k % 4 > 0, F.col("classe_codigo")).alias("classe_codigo"), F.when(k % 4 > 0, F.col("classe_nome")).alias("classe_nome"), "data_distribuicao", F.when(k % 5 > 0, "V").alias("vara"), F.lit(None).cast("string").alias("grau"), F.when(k % 7 > 1, F.array("assunto_nome")).when(k % 7 == 1, F.array().cast("array<string>")).alias("assuntos"))
    meta = p.where("id % 3 > 0").select("numero_cnj", F.lit(999).cast("long").alias("classe_codigo"), F.lit("X").alias("classe_nome"), "data_distribuicao", F.concat(F.lit("Vara "), k.cast("string")).alias("vara"), F.lit("G1").alias("grau"), F.array(F.lit("A"), F.lit("B")).alias("assuntos"))
    return entities.fill_missing(cases, meta).select("id", "classe_codigo", "vara", F.array_join(F.coalesce("assuntos", F.array().cast("array<string>")), "; ").alias("assuntos"))


@query(with_ctes("SELECT id FROM processo WHERE id % 4 = 0 AND NOT segredo AND (id % 8 = 0 OR data_distribuicao < DATE '1998-01-01' - 1) ORDER BY id LIMIT 40", "processo"))
def d11_pending_enrichment(spark, d):
    k = F.col("id")
    p = b.processo(spark, d).withColumn("classe_codigo", F.when(k % 4 > 0, 1)).withColumn("classe_nome", F.when(k % 4 > 0, "x")).withColumn("datajud_consultado_em", F.when(k % 8 > 0, F.col("data_distribuicao").cast("timestamp")))
    return entities.pending_enrichment(p, F.lit("1998-01-01").cast("timestamp"), 24, 40).select("id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY 1 LIMIT 100")
def d12_pending_analysis(spark, d):
    p = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return entities.pending_analysis(p, table(spark, d, "labels").select(F.col("doc_id").alias("id")), 100)


@query(with_ctes("""SELECT n.numero_cnj, arg_min(p.tribunal, (p.disponivel, p.id)) AS tribunal, coalesce(any_value(CASE WHEN n.id % 4 = 0 THEN 'Vara velha' END), arg_min(p.fonte, (p.disponivel, p.id))) AS vara, any_value(n.id % 4 > 1) AS novo,
  CASE WHEN any_value(n.id % 4 = 1) THEN 0 ELSE count(DISTINCT p.destinatario) FILTER (trim(p.destinatario) IS NOT NULL) END AS partes FROM publicacao p JOIN processo n ON n.id = p.id // 2 GROUP BY n.numero_cnj""", "publicacao", "processo"))
def d13_cases_from_publications(spark, d):
    pub, cases = b.publicacao(spark, d), b.processo(spark, d).select(F.col("id").alias("k"), "numero_cnj")
    pubs = pub.join(cases, F.floor(F.col("id") / 2) == F.col("k")).withColumn("orgao", F.col("fonte")).withColumn("destinatarios", F.array(F.struct(F.col("destinatario").alias("nome"), F.lit("P").alias("polo"))))
    known = cases.where("k % 4 < 2").select("numero_cnj", F.when(F.col("k") % 4 == 0, "Vara velha").alias("vara"), (F.col("k") % 4 == 1).alias("completo"))
    c, p = entities.cases_from_publications(pubs, known)
    n = p.groupBy("numero_cnj").agg(F.count("*").alias("partes"))
    return c.join(n, "numero_cnj", "left").select("numero_cnj", "tribunal", "vara", "novo", F.coalesce("partes", F.lit(0)).alias("partes"))


_PAGES = "SELECT page_id, page_id // 4 AS lot, (page_id // 40)::BIGINT AS parametro, page_id // 4 % 3 > 0 AS completa, TIMESTAMP '2024-01-01' + to_hours((page_id // 4 % 30)::INT) AS coletado_em FROM pages"


@query(f"""WITH p AS ({_PAGES}), n AS (SELECT parametro, arg_max(lot, (coletado_em, lot)) AS lot FROM p WHERE completa AND coletado_em > TIMESTAMP '2024-01-02' - INTERVAL 20 HOUR GROUP BY parametro) SELECT p.parametro, page_id FROM p JOIN n ON p.parametro = n.parametro AND p.lot = n.lot""")
def d14_latest_complete_lot(spark, d):
    lot = F.floor(F.col("page_id") / 4)
    p = table(spark, d, "pages").select("page_id", lot.alias("lot"), F.floor(F.col("page_id") / 40).alias("parametro"), (lot % 3 > 0).alias("completa"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(lot % 30).cast("int"))).alias("coletado_em"))
    return entities.latest_complete_lot(p, ["parametro"], F.lit("2024-01-02").cast("timestamp"), 20).select("parametro", "page_id")


@query(with_ctes("""SELECT numero_cnj, CASE WHEN id % 3 < 2 THEN 'capa' ELSE 'meta' END AS vara, CASE WHEN id % 3 = 0 THEN 'TJSP' WHEN id % 3 = 1 THEN 'DJEN' ELSE 'DATAJUD' END AS origem FROM processo""".replace("CASE WHEN id % 3 < 2 THEN 'capa' ELSE 'meta' END", "CASE id % 3 WHEN 0 THEN 'capa' ELSE 'meta' END"), "processo"))
def s01_union_sources(spark, d):
    p = b.processo(spark, d)
    covers = p.where("id % 3 = 0").select("numero_cnj", F.lit("capa").alias("vara"), F.lit("TJSP").alias("origem"))
    pubs = p.where("id % 3 < 2").select("numero_cnj", F.lit(None).cast("string").alias("vara"), F.lit("DJEN").alias("origem"))
    meta = p.select("numero_cnj", F.lit("meta").alias("vara"), F.lit("DATAJUD").alias("origem"))
    return entities.union_sources(covers, pubs, meta)


@query(with_ctes("""SELECT processo_id, polo, string_agg(nome, '; ' ORDER BY ordem, nome) AS nomes FROM (SELECT *, row_number() OVER (PARTITION BY processo_id, polo ORDER BY ordem, nome) AS n FROM (SELECT processo_id, polo, 'N' || pessoa_id AS nome, min(ordem) AS ordem FROM parte WHERE processo_id % 97 <> 0 GROUP BY ALL)) WHERE n <= 3 GROUP BY processo_id, polo""", "parte"))
def w01_top_parties_per_side(spark, d):
    p = b.parte(spark, d).withColumn("nome", F.concat(F.lit("N"), F.col("pessoa_id").cast("string")))
    return entities.top_parties_per_side(p, b.processo(spark, d))


@query("SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1 GROUP BY user_id")
def w06_latest_per_key(spark, d):
    return entities.latest_per_key(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id")
