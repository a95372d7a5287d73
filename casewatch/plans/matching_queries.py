"""Queries of matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import matching
from ..sources.shared import stored
from . import bindings as b
from .bindings import sql_key, sql_norm, sql_trgm, table, with_ctes
from .catalog import query

E1 = "SELECT processo_id, alvo_id, a.cliente_id, polo, 'confirmada' AS confianca, 'documento' AS criterio FROM reu JOIN alvo a ON documento = valor"


def by_document(spark, d):
    return matching.match_by_document(b.reus(spark, d), b.alvo(spark, d))


@query(with_ctes(E1, "reu", "alvo"))
def e01_match_by_document(spark, d):
    return by_document(spark, d)


@query(with_ctes("""SELECT p.id AS processo_id, a.alvo_id, a.cliente_id, CASE WHEN p.id % 3 = 0 THEN 'ativo' END AS polo, 'busca_documento' AS criterio FROM processo p JOIN alvo a ON a.alvo_id = p.custkey WHERE p.segredo""", "processo", "alvo"))
def e02_match_by_searched_document(spark, d):
    cases, targets = b.processo(spark, d), b.alvo(spark, d)
    searched = cases.join(targets, F.col("custkey") == F.col("alvo_id")).select(F.col("id").alias("processo_id"), F.col("valor").alias("documento"))
    names = searched.where("processo_id % 3 = 0").join(targets, F.col("documento") == F.col("valor")).select("processo_id", "alvo_id", F.explode(F.array(F.lit("terceiro"), F.lit("ativo"))).alias("polo"))
    return matching.match_by_searched_document(searched, targets, by_document(spark, d), names).select("processo_id", "alvo_id", "cliente_id", "polo", "criterio")


_N = f"SELECT id, {sql_norm('destinatario')} AS nome FROM publicacao"


@query(with_ctes(f"""SELECT DISTINCT p.id AS processo_id, t.id AS alvo_id FROM (SELECT * FROM n WHERE id % 4 > 0 AND nome <> '') p JOIN (SELECT * FROM n WHERE id % 4 = 0 AND nome <> '') t
  ON len(list_intersect({sql_trgm('p.nome')}, {sql_trgm('t.nome')})) * 100 >= 90 * len(list_distinct(list_concat({sql_trgm('p.nome')}, {sql_trgm('t.nome')})))""", "publicacao", n=_N))
def e03_match_by_name(spark, d):
    n = stored(b.publicacao(spark, d).select("id", text.normalize_name(F.col("destinatario"), False).alias("nome"))).where("nome <> ''")
    parties = n.where("id % 4 > 0").select(F.col("id").alias("processo_id"), F.lit("passivo").alias("polo"), F.col("nome").alias("nome_normalizado"), F.lit(None).cast("string").alias("documento"))
    targets = n.where("id % 4 = 0").select(F.col("id").alias("alvo_id"), F.lit(1).alias("cliente_id"), F.lit("nome").alias("tipo"), "nome")
    return matching.match_by_name(parties, targets).select("processo_id", "alvo_id")


_M = "SELECT processo_id, pessoa_id % 10 AS alvo_id, polo, CASE WHEN ordem % 2 = 0 THEN 'confirmada' ELSE 'a_verificar' END AS confianca, CASE WHEN ordem % 3 = 0 THEN 'documento' ELSE 'nome' END AS criterio FROM parte"


def _matches(spark, d):
    o = F.col("ordem")
    return b.parte(spark, d).select("processo_id", (F.col("pessoa_id") % 10).alias("alvo_id"), F.lit(1).alias("cliente_id"), "polo", F.when(o % 2 == 0, "confirmada").otherwise("a_verificar").alias("confianca"), F.when(o % 3 == 0, "documento").otherwise("nome").alias("criterio"))


_BEST = f"""SELECT processo_id, alvo_id, polo, confianca, criterio FROM (SELECT *, row_number() OVER (PARTITION BY processo_id, alvo_id ORDER BY confianca DESC, criterio, CASE polo WHEN 'passivo' THEN 0 WHEN 'ativo' THEN 1 ELSE 2 END) AS n FROM ({_M})) WHERE n = 1"""


@query(with_ctes(_BEST, "parte"))
def e04_best_match(spark, d):
    return matching.best_match(_matches(spark, d)).select("processo_id", "alvo_id", "polo", "confianca", "criterio")


def cases(spark, d):
    p = b.processo(spark, d)
    return p.select("id", "segredo", "classe_codigo", F.array("assunto_codigo").alias("assuntos"), text.canonical_district(F.col("comarca")).alias("comarca"), "valor_causa_centavos", matching.cover_text(F.col("classe_nome"), F.col("assunto_nome")).alias("capa"), "classe_nome", F.array("assunto_nome").alias("assunto_nomes"), F.when(F.col("id") % 2 == 0, "TJSP").otherwise("TJRJ").alias("tribunal"), "cliente_id", "custkey")


def rules(spark, d):
    """One rule of each kind for each region."""
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k"))
    kinds = F.explode(F.sequence(F.lit(0), F.lit(5)))
    r = r.select("k", kinds.alias("t"))
    longs, texts = (lambda c, v: F.when(c, F.array(*[F.lit(x).cast("long") for x in v]))), (lambda c, v: F.when(c, F.array(*map(F.lit, v))))
    return r.select(
        (F.col("k") * 10 + F.col("t")).alias("regra_id"), F.col("k").alias("cliente_id"), longs(F.col("t") == 0, (1116, 40)).alias("classes"), longs(F.col("t") == 1, (9580,)).alias("assuntos"),
        texts(F.col("t").isin(2, 0), ("Comarca de Nation 1", "NATION 2", "Nation_3")).alias("comarcas"), texts(F.col("t") == 3, ("apreensão", "dano moral")).alias("termos"), F.when(F.col("t").isin(1, 3), 15_000_000 + F.col("k") * 1_000_000).cast("long").alias("valor_min_centavos"), F.when(F.col("t") == 4, "passivo").alias("polo"),
    )


@query(with_ctes("""SELECT p.id AS processo_id, k * 10 + t AS regra_id FROM (SELECT r_regionkey::BIGINT AS k, unnest([0, 1, 2, 3, 4, 5]) AS t FROM region) r, processo p WHERE NOT p.segredo AND
  CASE t WHEN 0 THEN classe_codigo IN (1116, 40) AND comarca IN ('NATION_1', 'NATION_2', 'NATION_3') WHEN 1 THEN assunto_codigo = 9580 AND valor_causa_centavos >= 15000000 + k * 1000000 WHEN 2 THEN comarca IN ('NATION_1', 'NATION_2', 'NATION_3')
    WHEN 3 THEN (classe_codigo = 181 OR assunto_codigo = 10433) AND valor_causa_centavos >= 15000000 + k * 1000000 WHEN 4 THEN EXISTS (SELECT 1 FROM alvo a WHERE a.alvo_id = p.custkey AND a.cliente_id = k) ELSE false END""", "processo", "alvo"))
def e05_e07_match_rules(spark, d):
    return matching.match_rules(cases(spark, d), rules(spark, d), by_document(spark, d)).select("processo_id", "regra_id")


@query(with_ctes("""SELECT id AS processo_id, t AS regra_id FROM processo, (SELECT r_regionkey::BIGINT AS t FROM region) WHERE NOT segredo AND CASE t WHEN 1 THEN classe_codigo = 1116 WHEN 2 THEN assunto_codigo = 10433 AND id % 2 = 0 WHEN 3 THEN classe_codigo = 92 ELSE classe_codigo = 181 END""", "processo"))
def e06_match_terms(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("regra_id"))
    k = F.col("regra_id")
    terms = r.select("regra_id", F.when(k == 1, "acao").when(k == 2, "assunto").otherwise("frase").alias("tipo_termo"), F.when(k == 1, "execução fiscal").when(k == 2, "DANO MORAL").when(k == 3, "falta de pagamento").otherwise("apreensao").alias("texto_termo"), F.when(k == 2, "TJSP").alias("tribunal_sigla"))
    return matching.match_terms(cases(spark, d), terms)


@query(with_ctes(f"""WITH best AS ({_BEST}), o AS (SELECT processo_id, alvo_id, CASE WHEN alvo_id % 3 > 0 THEN polo END AS polo, 'a_verificar' AS confianca, 'nome' AS criterio FROM best WHERE processo_id % 2 = 0)
SELECT coalesce(o.processo_id, n.processo_id) AS processo_id, coalesce(o.alvo_id, n.alvo_id) AS alvo_id, coalesce(o.polo, n.polo) AS polo, CASE WHEN o.processo_id IS NULL OR n.confianca = 'confirmada' THEN coalesce(n.confianca, o.confianca) ELSE o.confianca END AS confianca,
  CASE WHEN o.processo_id IS NULL OR n.confianca = 'confirmada' THEN n.criterio ELSE o.criterio END AS criterio, o.processo_id IS NULL AS criada, coalesce(o.processo_id IS NOT NULL AND n.confianca = 'confirmada', false) AS promovida
FROM o FULL JOIN (SELECT * FROM best WHERE processo_id % 3 > 0) n ON o.processo_id = n.processo_id AND o.alvo_id = n.alvo_id""".replace("WITH best", "SELECT * FROM (WITH best", 1) + ")", "parte"))
def e08_merge_occurrences(spark, d):
    best = matching.best_match(_matches(spark, d))
    old = best.where("processo_id % 2 = 0").select("processo_id", "alvo_id", F.when(F.col("alvo_id") % 3 > 0, F.col("polo")).alias("polo"), F.lit("a_verificar").alias("confianca"), F.lit("nome").alias("criterio"))
    return matching.merge_occurrences(old, best.where("processo_id % 3 > 0"), ["processo_id", "alvo_id"])


@query(with_ctes(f"SELECT id, {sql_key('''classe_nome || ' ' || assunto_nome''')} AS capa FROM processo", "processo"))
def e09_cover_text(spark, d):
    return b.processo(spark, d).select("id", matching.cover_text(F.col("classe_nome"), F.col("assunto_nome")).alias("capa"))


@query("""WITH t AS (SELECT c_custkey AS alvo_id, c_nationkey AS cliente_id, 'N' || c_custkey % 200 AS valor FROM customer WHERE c_custkey % 2 = 0 UNION SELECT c_custkey, c_nationkey, 'V' || c_custkey % 50 FROM customer WHERE c_custkey % 3 = 0)
SELECT 'nome' AS tipo, valor, string_agg(cliente_id || '/' || alvo_id, ' ' ORDER BY cliente_id, alvo_id) AS alvos, CASE WHEN valor LIKE 'V%' THEN '2024-01-05' END AS varrido_ate FROM t GROUP BY valor""")
def e10_search_terms(spark, d):
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(k.alias("alvo_id"), F.col("c_nationkey").alias("cliente_id"), F.when(k % 2 == 0, "nome").otherwise("documento").alias("tipo"), F.concat(F.lit("N"), k % 200).alias("valor"), F.when(k % 3 == 0, F.array(F.concat(F.lit("V"), k % 50))).alias("variacoes"))
    state = table(spark, d, "customer").select(F.lit("nome").alias("tipo"), F.concat(F.lit("V"), k % 50).alias("valor")).distinct().withColumn("varrido_ate", F.lit("2024-01-05"))
    out = matching.search_terms(t, state)
    return out.select("tipo", "valor", F.array_join(F.transform("alvos", lambda x: F.concat_ws("/", x["cliente_id"].cast("string"), x["alvo_id"].cast("string"))), " ").alias("alvos"), "varrido_ate")


@query(with_ctes("""SELECT p.id AS publicacao_id, c_custkey AS alvo_id, CASE WHEN p.disponivel < DATE '2024-01-15' THEN 'carga_inicial' ELSE 'monitoramento' END AS origem FROM publicacao p JOIN customer ON p.id // 2 = c_custkey // 3 WHERE p.disponivel >= DATE '2024-01-01' + (c_custkey % 20)::INT AND (p.id + c_custkey) % 3 > 0""", "publicacao"))
def e11_link_publications(spark, d):
    hits = b.publicacao(spark, d).select(F.col("id").alias("publicacao_id"), F.floor(F.col("id") / 2).alias("termo"), "disponivel")
    k = F.col("c_custkey")
    targets = table(spark, d, "customer").select(F.floor(k / 3).alias("termo"), k.alias("alvo_id"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 20).cast("int")).alias("inicio"), F.lit("2024-01-15").cast("date").alias("criado"))
    known = hits.join(targets, "termo").where("(publicacao_id + alvo_id) % 3 = 0").select("publicacao_id", "alvo_id")
    return matching.link_publications(hits, targets, known)


@query(with_ctes("SELECT custkey, CASE WHEN custkey % 5 = 0 OR (custkey % 3 < 2 AND custkey % 2 = 0) THEN 'confirmada' ELSE 'a_verificar' END AS confianca FROM pessoa", "pessoa"))
def e12_publication_confidence(spark, d):
    k = F.col("custkey")
    term = F.when(k % 2 == 0, F.upper("nome")).otherwise(F.lit("OUTRO"))
    return b.pessoa(spark, d).select("custkey", matching.publication_confidence(F.when(k % 5 == 0, "oab").otherwise("nome"), term, F.array("nome")).alias("confianca"))


@query(with_ctes("SELECT id % 10 AS varredura, numero_cnj, substr(numero_cnj, 12, 4) = '1997' AS avisa FROM processo WHERE id % 3 > 0", "processo"))
def e13_new_numbers(spark, d):
    p = b.processo(spark, d).select("id", (F.col("id") % 10).alias("varredura"), "numero_cnj")
    return matching.new_numbers(p.union(p).drop("id"), p.where("id % 3 = 0").drop("id"), True, 1997)


@query(with_ctes(f"SELECT p.id, p.numero_cnj FROM processo p WHERE p.id IN (SELECT processo_id FROM ({E1}) WHERE cliente_id = 5)", "processo", "reu", "alvo"))
def e14_known_cases(spark, d):
    return matching.known_cases(b.processo(spark, d), by_document(spark, d), 5).select("id", "numero_cnj")


@query("""SELECT r_regionkey::BIGINT AS regra_id, n_name AS tribunal, '2023-12-02' AS desde, CASE WHEN n_nationkey % 2 = 0 THEN 'c' || n_nationkey END AS cursor FROM region, nation WHERE r_regionkey % 2 = 0 OR n_name = 'NATION_' || r_regionkey""")
def e15_term_tasks(spark, d):
    k = F.col("r_regionkey")
    rules = table(spark, d, "region").select(k.cast("long").alias("regra_id"), F.when(k % 2 == 1, F.concat(F.lit("NATION_"), k.cast("string"))).alias("tribunal_sigla"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("criado_em"))
    courts = table(spark, d, "nation").select(F.col("n_name").alias("tribunal"), "n_nationkey")
    cursors = courts.where("n_nationkey % 2 = 0").select("tribunal", F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("cursor")).join(F.broadcast(rules.select("regra_id")))
    return matching.term_tasks(rules, courts, cursors)


@query(with_ctes("""SELECT p.id, max(u.desde)::VARCHAR AS vigente_desde FROM processo p LEFT JOIN (SELECT DISTINCT cliente_id, DATE '1995-01-01' + (150 * (id % 12))::INT AS desde FROM processo) u ON u.cliente_id = p.cliente_id AND u.desde <= p.data_distribuicao GROUP BY p.id""", "processo"))
def e16_effective_units(spark, d):
    p = b.processo(spark, d)
    units = p.select("cliente_id", F.date_add(F.lit("1995-01-01").cast("date"), (150 * (F.col("id") % 12)).cast("int")).alias("vigente_desde")).distinct().withColumn("unidade", F.lit("u"))
    return matching.effective_units(units, p.select("cliente_id", "id", F.col("data_distribuicao").alias("dia")), ["cliente_id"]).select("id", "vigente_desde")
