"""Queries of the column functions and of flattening and validation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import ids, money_time, text
from ..operators import entities, normalize
from ..sources import feeds
from ..sources.shared import shared_folder
from . import bindings as b
from .bindings import sql_key, sql_norm, table, with_ctes
from .catalog import query

SUFFIXES = "|".join(text.COMPANY_SUFFIXES)


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def b01_remove_accents(spark, d):
    return table(spark, d, "documents").select("doc_id", text.remove_accents(F.col("text")).alias("plain"))


@query(with_ctes(f"SELECT custkey, regexp_replace({sql_norm('nome')}, '^(.*?[A-Z0-9])( ({SUFFIXES}))+$', '\\1') AS nome_normalizado, {sql_norm('nome')} AS completo FROM pessoa", "pessoa"))
def b02_normalize_name(spark, d):
    return b.pessoa(spark, d).select("custkey", text.normalize_name(F.col("nome")).alias("nome_normalizado"), text.normalize_name(F.col("nome"), False).alias("completo"))


@query(f"""SELECT doc_id, len(list_filter(string_split({sql_norm('text')}, ' '), lambda w: w <> '' AND w NOT IN {text.PARTICLES})) >= 2 AS especifico FROM documents""")
def b03_is_specific_name(spark, d):
    return table(spark, d, "documents").select("doc_id", text.is_specific_name(text.normalize_name(F.col("text"), False)).alias("especifico"))


@query(f"SELECT p_partkey, {sql_key('p_name')} AS nome_chave, {sql_key('p_type')} AS tipo_chave FROM part")
def b04_tpu_key(spark, d):
    return table(spark, d, "part").select("p_partkey", text.tpu_key(F.col("p_name")).alias("nome_chave"), text.tpu_key(F.col("p_type")).alias("tipo_chave"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) ELSE upper(n_name) END AS comarca FROM nation""".replace("upper(n_name)", sql_key("n_name")))
def b05_canonical_district(spark, d):
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Comarca de "), "n_name")).otherwise(F.concat(F.lit("foro dos "), "n_name"))
    return table(spark, d, "nation").select("n_nationkey", text.canonical_district(name).alias("comarca"))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'São Paulo' WHEN 1 THEN translate(n_name, '0123456789_', 'abcdefghij ') WHEN 2 THEN translate(n_name, '0123456789_', 'abcdefghij ') WHEN 3 THEN NULL ELSE NULL END AS comarca FROM nation""")
def b06_district_from_court_unit(spark, d):
    k, n = F.col("n_nationkey") % 5, F.translate("n_name", "0123456789_", "abcdefghij ")
    unit = F.when(k == 0, F.concat(F.lit("Foro Regional II - "), n)).when(k == 1, F.concat(F.lit("Foro de "), n)).when(k == 2, F.concat(n, F.lit("/DEECRIM UR2"))).when(k == 3, F.concat(F.lit("Foro das Execuções Fiscais de "), n)).otherwise("Foro 1 - Núcleo 4.0")
    return table(spark, d, "nation").select("n_nationkey", text.district_from_court_unit(unit).alias("comarca"))


@query(with_ctes("SELECT custkey, documento AS limpo FROM pessoa WHERE documento IS NOT NULL", "pessoa"))
def b07_normalize_document(spark, d):
    p = b.pessoa(spark, d).where("documento is not null").withColumn("f", ids.format_document(F.col("documento")))
    return p.select("custkey", ids.normalize_document(F.col("f")).alias("limpo"))


@query(with_ctes("SELECT custkey, CASE WHEN custkey % 4 = 0 OR documento IS NULL THEN NULL WHEN custkey % 3 = 2 THEN 'PF' ELSE 'PJ' END AS tipo FROM pessoa", "pessoa"))
def b08_document_type(spark, d):
    broken = F.concat(F.expr("substring(documento, 1, length(documento) - 1)"), (F.right("documento", F.lit(1)).cast("int") + 1) % 10)
    return b.pessoa(spark, d).select("custkey", ids.document_type(F.when(F.col("custkey") % 4 == 0, broken).otherwise(F.col("documento"))).alias("tipo"))


@query(with_ctes("""SELECT custkey, CASE length(documento) WHEN 11 THEN regexp_replace(documento, '^(...)(...)(...)(..)$', '\\1.\\2.\\3-\\4') ELSE regexp_replace(documento, '^(..)(...)(...)(....)(..)$', '\\1.\\2.\\3/\\4-\\5') END AS formatado,
  left(documento, 2) || repeat('*', length(documento) - 4) || right(documento, 2) AS mascarado FROM pessoa WHERE documento IS NOT NULL""", "pessoa"))
def b09_format_and_mask_document(spark, d):
    p = b.pessoa(spark, d).where("documento is not null")
    return p.select("custkey", ids.format_document(F.col("documento")).alias("formatado"), ids.mask_document(F.col("documento")).alias("mascarado"))


@query(with_ctes("SELECT custkey, 'parte [documento], processo ' || lpad(custkey::VARCHAR, 20, '0') || '; [documento].' AS texto FROM pessoa WHERE documento IS NOT NULL", "pessoa"))
def b10_mask_documents_in_text(spark, d):
    p = b.pessoa(spark, d).where("documento is not null")
    said = F.concat(F.lit("parte "), ids.format_document(F.col("documento")), F.lit(", processo "), F.lpad(F.col("custkey").cast("string"), 20, "0"), F.lit("; "), "documento", F.lit("."))
    return p.select("custkey", ids.mask_documents_in_text(said).alias("texto"))


@query(with_ctes("""SELECT id, substr(numero_cnj, 1, 7) AS seq, substr(numero_cnj, 9, 2) AS dv, substr(numero_cnj, 12, 4) AS ano, '8' AS segmento, '26' AS tribunal, substr(numero_cnj, 22, 4) AS origem FROM processo""", "processo"))
def b11_parse_cnj(spark, d):
    p = b.processo(spark, d).select("id", ids.parse_cnj(F.col("numero_cnj")).alias("p"))
    return p.select("id", "p.*")


@query(with_ctes("""SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE numero_cnj END AS formatado, id % 3 <> 0 AS valido FROM processo""", "processo"))
def b12_format_cnj(spark, d):
    digits = F.regexp_replace("numero_cnj", "[^0-9]", "")
    wrong = F.concat(F.substring(digits, 1, 7), F.lpad(((F.substring(digits, 8, 2).cast("int") + 1) % 100).cast("string"), 2, "0"), F.substring(digits, 10, 11))
    p = b.processo(spark, d).select("id", F.when(F.col("id") % 3 == 0, wrong).when(F.col("id") % 3 == 1, digits).otherwise(F.concat(F.lit(" "), "numero_cnj")).alias("n"))
    return p.select("id", ids.format_cnj(F.col("n")).alias("formatado"), ids.is_valid_cnj(F.col("n")).alias("valido"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'SP' WHEN 1 THEN 'RJ' WHEN 2 THEN 'MG' END || (s_suppkey % 1000000) AS oab FROM supplier""")
def b13_normalize_oab(spark, d):
    k, n = F.col("s_suppkey") % 4, (F.col("s_suppkey") % 1_000_000).cast("string")
    raw = F.when(k == 0, F.concat(F.lit("OAB/SP "), n)).when(k == 1, F.concat(F.lpad(n, 6, "0"), F.lit("/rj"))).when(k == 2, F.concat(F.lit("mg-"), n)).otherwise(F.concat(F.lit("XX"), n))
    return table(spark, d, "supplier").select("s_suppkey", ids.normalize_oab(raw).alias("oab"))


@query("""SELECT o_orderkey, (round(o_totalprice::VARCHAR::DECIMAL(38,18), 2) * 100)::BIGINT AS centavos, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE (round(o_totalprice::VARCHAR::DECIMAL(38,18), 2) * 100)::BIGINT END AS de_texto FROM orders""")
def b14_to_cents(spark, d):
    cents = money_time.number_to_cents(F.col("o_totalprice"))
    said = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("-"), money_time.format_brl(cents))).otherwise(money_time.format_brl(cents))
    return table(spark, d, "orders").select("o_orderkey", cents.alias("centavos"), money_time.to_cents(said).alias("de_texto"))


@query(r"SELECT doc_id, md5(nullif(trim(regexp_replace(text, '[\s\x{A0}]+', ' ', 'g')), '')) AS apertado FROM documents")
def b15_squeeze(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.squeeze(F.col("text"))).alias("apertado"))


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS data FROM orders")
def b16_parse_feed_date(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyyMMddHHmmss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return o.select("o_orderkey", money_time.parse_feed_date(F.when(k == 2, "sem data"), raw).alias("data"))


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS data, CASE WHEN o_orderkey % 4 < 2 THEN o_orderdate::DATE::VARCHAR END AS distribuicao FROM orders")
def b17_filing_date(spark, d):
    said = F.concat(F.lit("às 10:00 de "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" por sorteio"))
    year = (F.year("o_orderdate") + F.col("o_orderkey") % 4).cast("string")
    return table(spark, d, "orders").select("o_orderkey", money_time.parse_br_date(said).alias("data"), money_time.filing_date(said, year).alias("distribuicao"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ativo' WHEN 1 THEN 'passivo' ELSE 'terceiro' END AS polo FROM orders""")
def b18_side_from_label(spark, d):
    k = F.col("o_orderkey") % 4
    label = F.when(k == 0, "Reqte.:").when(k == 1, "Réu").when(k == 2, "Perito")
    return table(spark, d, "orders").select("o_orderkey", text.side_from_label(label).alias("polo"))


@query("""SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 'ativo' WHEN 'P' THEN 'passivo' WHEN 'T' THEN 'terceiro' ELSE 'desconhecido' END AS polo, CASE l_returnflag WHEN 'A' THEN 'ativo' ELSE 'terceiro' END AS polo_processo, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def b19_side_from_code(spark, d):
    c = F.col("l_returnflag")
    return table(spark, d, "lineitem").groupBy(c, text.side_from_code(c).alias("polo"), text.side_from_code(c, "terceiro").alias("polo_processo")).agg(F.count("*").alias("n"))


@query(with_ctes("SELECT custkey, CASE WHEN custkey % 3 < 2 THEN 'PJ' END AS tipo FROM pessoa", "pessoa"))
def b20_company_type_by_suffix(spark, d):
    return b.pessoa(spark, d).select("custkey", text.company_type_by_suffix(F.col("nome")).alias("tipo"))


KEY = b"chave-de-teste"
_PAD = KEY.ljust(64, b"\0")
_HEX = ["".join(f"{x ^ m:02x}" for x in _PAD) for m in (0x36, 0x5C)]


@query(with_ctes(f"""SELECT custkey, sha256(unhex('{_HEX[1]}' || sha256(unhex('{_HEX[0]}' || hex(('documento:' || documento)::BLOB))))) AS resumo FROM pessoa WHERE documento IS NOT NULL""", "pessoa"))
def b21_hash_parameter(spark, d):
    p = b.pessoa(spark, d).where("documento is not null")
    return p.select("custkey", ids.hash_parameter(F.lit("documento"), F.col("documento"), KEY).alias("resumo"))


MOVEMENT = "strftime(l_shipdate, '%Y-%m-%d') || '|' || l_returnflag || ' ' || l_linestatus || ' ' || l_linenumber"


def movements(spark, d):
    said = F.concat_ws("  ", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", ids.movement_hash(F.col("l_shipdate"), said).alias("resumo"))


@query(f"SELECT l_orderkey, sha256({MOVEMENT}) AS resumo, count(*) AS vezes FROM lineitem GROUP BY ALL")
def b22_movement_hash(spark, d):
    return movements(spark, d).groupBy("l_orderkey", "resumo").agg(F.count("*").alias("vezes"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '5511' || lpad((c_custkey % 1000000000)::VARCHAR, 9, '0') WHEN 1 THEN '1415' || lpad((c_custkey % 1000000000)::VARCHAR, 9, '0') END AS telefone FROM customer""")
def b23_normalize_phone(spark, d):
    k = F.col("c_custkey")
    n = F.lpad((k % 1_000_000_000).cast("string"), 9, "0")
    raw = F.when(k % 3 == 0, F.concat(F.lit("(11) "), n)).when(k % 3 == 1, F.concat(F.lit("+1 415 "), n)).otherwise(F.substring(n, 1, 7))
    return table(spark, d, "customer").select("c_custkey", ids.normalize_phone(raw).alias("telefone"))


@query(r"""WITH s AS (SELECT doc_id, coalesce(nullif(trim(regexp_replace(text, '[\s\x{A0}]+', ' ', 'g')), ''), '-') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 200 THEN rtrim(substr(t, 1, 199)) || '…' ELSE t END AS parametro FROM s""")
def b24_clean_param(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_param(F.col("text")).alias("parametro"))


@query(r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://esaj.tjsp.jus.br/p?numero=' || page_id || '&nome=X' END AS publica, 'https://h.com/p?a=' || page_id || '&nome=***&doc=***&vazio=' AS mascarada FROM pages""")
def b25_b26_urls(spark, d):
    k = F.col("page_id")
    url = F.concat(F.when(k % 3 == 0, "https://esaj.tjsp.jus.br/p?numero=").when(k % 3 == 1, "http://esaj.tjsp.jus.br/p?numero=").otherwise("https://jus.br.golpe.com/p?numero="), k.cast("string"), F.lit("&nome=X"))
    long = F.concat(F.lit("https://h.com/p?a="), k.cast("string"), F.lit("&nome=Fulano+de+Tal&doc=123&vazio="))
    return table(spark, d, "pages").select("page_id", text.public_url(url).alias("publica"), text.mask_url_params(long, ("nome", "doc", "vazio")).alias("mascarada"))


@query("SELECT o_orderkey, (o_orderdate + to_months((o_orderkey % 13)::INT))::DATE::VARCHAR AS depois FROM orders")
def b27_add_months(spark, d):
    n = (F.col("o_orderkey") % 13).cast("int")
    return table(spark, d, "orders").select("o_orderkey", F.to_date(money_time.add_months(F.col("o_orderdate"), n)).alias("depois"))


@query("""SELECT event_id, timezone('America/Sao_Paulo', timezone('UTC', ts))::DATE::VARCHAR AS dia, date_trunc('month', timezone('America/Sao_Paulo', timezone('UTC', ts)))::DATE::VARCHAR AS mes,
  strftime(timezone('America/Sao_Paulo', timezone('UTC', ts))::DATE + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS inicio FROM events""")
def b28_local_dates(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", money_time.local_date(F.col("ts")).alias("dia"), money_time.month_start(F.col("ts")).alias("mes"), F.date_format(money_time.day_start_utc(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("inicio"))


HOLIDAYS = ("2024-01-01", "2024-01-25", "2024-02-12", "2024-02-13")
_CAL = f"""SELECT d::DATE AS d, is_biz, sum(is_biz::INT) OVER (ORDER BY d) AS i FROM (SELECT unnest(generate_series(DATE '2023-12-01', DATE '2024-06-30', INTERVAL 1 DAY)) AS d) x,
  LATERAL (SELECT dayofweek(d) NOT IN (0, 6) AND strftime(d, '%Y-%m-%d') NOT IN {HOLIDAYS} AS is_biz) y"""


def _cal(spark):
    return money_time.calendar(spark, "2023-12-01", "2024-06-30", HOLIDAYS)


@query(with_ctes("""SELECT p.id, (SELECT min(d) FROM cal WHERE is_biz AND d >= p.disponivel)::VARCHAR AS proximo, b.d::VARCHAR AS depois FROM publicacao p JOIN cal a ON a.d = p.disponivel JOIN cal b ON b.is_biz AND b.i = a.i + 1 + p.id % 10""", "publicacao", cal=_CAL))
def b29_business_days(spark, d):
    p = b.publicacao(spark, d).select("id", "disponivel", (F.col("id") % 10 + 1).alias("n"))
    p = money_time.next_business_day(p, _cal(spark), "disponivel", "proximo")
    return money_time.add_business_days(p, _cal(spark), "disponivel", "n", "depois").select("id", "proximo", "depois")


@query(with_ctes("""SELECT p.id, CASE WHEN n < 1 THEN NULL WHEN id % 2 = 0 THEN (SELECT min(d) FROM cal WHERE is_biz AND d >= pub + n) ELSE (SELECT min(c.d) FROM cal c WHERE c.is_biz AND c.i = (SELECT i FROM cal x WHERE x.d = pub) + n) END::VARCHAR AS fim
  FROM (SELECT id, (tamanho % 30)::INT AS n, (SELECT min(d) FROM cal WHERE is_biz AND d >= disponivel + 1) AS pub FROM publicacao) p""", "publicacao", cal=_CAL))
def b30_deadline_end(spark, d):
    p = b.publicacao(spark, d).select("id", "disponivel", (F.col("tamanho") % 30).cast("int").alias("dias"), F.when(F.col("id") % 2 == 0, "corridos").otherwise("uteis").alias("natureza"))
    return money_time.deadline_end(p, _cal(spark), "disponivel", "dias", "natureza", "fim").select("id", "fim")


@query(with_ctes("""SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE strftime(disponivel + INTERVAL 3 HOUR + CASE WHEN id % 3 = 0 THEN INTERVAL 0 HOUR ELSE to_hours((id % 24)::INT) + INTERVAL 30 MINUTE END, '%Y-%m-%d %H:%M') END AS audiencia FROM publicacao""", "publicacao"))
def b31_hearing_ts(spark, d):
    i = F.col("id")
    day = F.when(i % 5 == 0, "2024-02-31").otherwise(F.date_format("disponivel", "yyyy-MM-dd"))
    hour = F.when(i % 3 == 0, "25:99").otherwise(F.concat(F.lpad((i % 24).cast("string"), 2, "0"), F.lit(":30")))
    return b.publicacao(spark, d).select("id", F.date_format(money_time.hearing_ts(day, hour), "yyyy-MM-dd HH:mm").alias("audiencia"))


@query(with_ctes("""SELECT id, CASE WHEN id % 50 = 0 THEN 'não informado' ELSE 'R$ ' || replace(format('{:,}', valor_causa_centavos // 100), ',', '.') || ',' || lpad((valor_causa_centavos % 100)::VARCHAR, 2, '0') END AS valor,
  CASE WHEN id % 50 = 0 THEN 'não informada' ELSE strftime(data_distribuicao, '%d/%m/%Y') END AS data FROM processo""", "processo"))
def b32_formats(spark, d):
    gone = F.col("id") % 50 == 0
    return b.processo(spark, d).select("id", money_time.format_brl(F.when(~gone, F.col("valor_causa_centavos"))).alias("valor"), money_time.format_br_date(F.when(~gone, F.col("data_distribuicao"))).alias("data"))


# ---------------------------------------------------------------- sources, flattening, validation


@query(with_ctes("""SELECT id::VARCHAR AS id_externo, disponivel::VARCHAR AS disponivel, count(*) AS destinatarios, sum((id % 2 = 0)::INT)::BIGINT AS ativos FROM publicacao WHERE trim(destinatario) <> '' GROUP BY ALL""", "publicacao"))
def a01_c01_publications(spark, d):
    """The publications written as feed items of several spellings, read and flattened."""
    p = b.publicacao(spark, d)
    item = F.when(F.col("id") % 3 == 0, F.to_json(F.struct("id", F.date_format("disponivel", "yyyy-MM-dd").alias("data_disponibilizacao"), F.lit("t").alias("texto"), F.array(F.struct(F.col("destinatario").alias("nome"), F.when(F.col("id") % 2 == 0, "A").otherwise("P").alias("polo"))).alias("destinatarios"))))
    other = F.to_json(F.struct(F.col("id").alias("hash"), F.date_format("disponivel", "yyyy-MM-dd").alias("dataDisponibilizacao"), F.lit("t").alias("conteudo"), F.array(F.struct(F.col("destinatario").alias("nome"), F.when(F.col("id") % 2 == 0, "A").otherwise("P").alias("polo"))).alias("destinatarios")))
    page = F.concat(F.lit('{"items": ['), F.coalesce(item, other), F.lit("]}"))
    flat = feeds.flatten_publications(feeds.publication_items(p.select(page.alias("value")), F.col("value")))
    people = flat.select("id_externo", "disponivel", F.explode("destinatarios").alias("x"))
    return people.groupBy("id_externo", "disponivel").agg(F.count("*").alias("destinatarios"), F.sum((F.col("x.polo") == "ativo").cast("long")).alias("ativos"))


@query(with_ctes("""SELECT numero_cnj, 'G1' AS grau, classe_codigo, assunto_codigo AS assunto, 2 AS n_assuntos FROM processo WHERE id % 10 <> 0""", "processo"))
def a02_c02_c03_case_metadata(spark, d):
    """Cases written as search hits, one a level of court; invalid numbers go, the best instance stays."""
    p = b.processo(spark, d)
    number = F.when(F.col("id") % 10 == 0, F.lit("00000000000000000000")).otherwise(F.regexp_replace("numero_cnj", "[^0-9]", ""))
    subject = F.struct(F.col("assunto_codigo").cast("string").alias("codigo"), F.col("assunto_nome").alias("nome"))
    more = F.struct(F.lit("x").alias("codigo"), F.lit("Outro").alias("nome"))
    source = F.struct(number.alias("numeroProcesso"), F.col("g").alias("grau"), F.date_format("data_distribuicao", "yyyyMMddHHmmss").alias("dataAjuizamento"), F.struct(F.col("classe_codigo").alias("codigo"), F.col("classe_nome").alias("nome")).alias("classe"), F.array(F.array(subject, subject), F.array(more.alias("y"))).alias("assuntos"))
    hits = p.withColumn("g", F.explode(F.array(F.lit("G2"), F.lit("G1"), F.lit("TR")))).select(F.concat(F.lit('{"hits": {"hits": [{"_source": '), F.to_json(source), F.lit("}]}}")).alias("value"))
    flat = feeds.best_instance(feeds.flatten_case_metadata(feeds.case_hits(hits, F.col("value"))))
    return flat.select("numero_cnj", "grau", "classe_codigo", F.col("assuntos")[0]["codigo"].alias("assunto"), F.size("assuntos").alias("n_assuntos"))


@query(with_ctes("SELECT c_custkey, upper(trim(c_name)) AS razao_social, CASE WHEN c_custkey % 4 = 0 THEN 'BAIXADA' ELSE 'ATIVA' END AS situacao FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 7 <> 0 AND c_custkey % 10 <> 0"))
def a05_company_lookup(spark, d):
    p = b.pessoa(spark, d).where("documento is not null")
    c = table(spark, d, "customer")
    register = p.join(c, F.col("custkey") == F.col("c_custkey")).where("custkey % 3 < 2").select(F.col("documento").alias("cnpj"), F.when(F.col("custkey") % 10 != 0, F.concat(F.lit("  "), F.upper("c_name"), F.lit("  "))).alias("razao_social"), F.lit(None).cast("string").alias("nome_fantasia"), F.when(F.col("custkey") % 4 == 0, "BAIXADA").otherwise("ATIVA").alias("situacao"))
    return feeds.company_lookup(p.select(F.col("custkey").alias("c_custkey"), "documento"), register).select("c_custkey", "razao_social", "situacao")


@query(with_ctes("""SELECT id, CASE WHEN segredo THEN NULL ELSE classe_nome END AS classe_nome, CASE WHEN segredo THEN NULL ELSE valor_causa_centavos END AS valor_causa_centavos, CASE WHEN segredo THEN NULL ELSE replace(upper(comarca), '_', ' ') END AS comarca, segredo FROM processo""", "processo"))
def c04_normalize_cases(spark, d):
    p = b.processo(spark, d).withColumn("url", F.lit("https://x")).withColumn("tribunal", F.lit("TJSP"))
    return normalize.normalize_cases(p).select("id", "classe_nome", "valor_causa_centavos", "comarca", "segredo")


@query(with_ctes(f"""SELECT processo_id, regexp_replace({sql_norm('nome')}, '^(.*?[A-Z0-9])( ({SUFFIXES}))+$', '\\1') AS nome_normalizado, CASE WHEN processo_id % 4 = 0 THEN NULL ELSE documento END AS documento,
  CASE WHEN documento IS NOT NULL AND processo_id % 4 <> 0 THEN CASE length(documento) WHEN 11 THEN 'PF' ELSE 'PJ' END WHEN regexp_matches(nome, '(Ltda\\.|S/A)$') THEN 'PJ' END AS tipo, CASE WHEN processo_id % 50 = 0 THEN 'polo inválido' END AS erro FROM reu""", "reu"))
def c05_normalize_parties(spark, d):
    r = b.reu(spark, d)
    r = r.withColumn("documento", F.when(F.col("processo_id") % 4 == 0, "11111111111").otherwise(F.col("documento"))).withColumn("polo", F.when(F.col("processo_id") % 50 == 0, "lado").otherwise(F.col("polo")))
    r = r.unionByName(r.withColumn("nome", F.lit("  ")))
    return normalize.normalize_parties(r).select("processo_id", "nome_normalizado", "documento", "tipo", "erro")


@query("""SELECT s_suppkey, s_name AS nome, (s_suppkey % 999999)::VARCHAR AS oab_numero, CASE WHEN s_suppkey % 2 = 0 THEN 'SP' END AS oab_uf, 1 AS n FROM supplier""")
def c06_normalize_lawyers(spark, d):
    s = table(spark, d, "supplier")
    one = F.struct(F.concat(F.lit(" "), "s_name").alias("nome"), F.concat((F.col("s_suppkey") % 999999).cast("string"), F.lit(" ")).alias("oab_numero"), F.when(F.col("s_suppkey") % 2 == 0, "sp").otherwise("ZZ").alias("oab_uf"))
    out = s.select("s_suppkey", normalize.normalize_lawyers(F.array(one, one)).alias("a"))
    return out.select("s_suppkey", F.col("a")[0]["nome"].alias("nome"), F.col("a")[0]["oab_numero"].alias("oab_numero"), F.col("a")[0]["oab_uf"].alias("oab_uf"), F.size("a").alias("n"))


@query(f"""WITH c AS (SELECT {sql_key('p_name')} AS k, CASE WHEN min(p_partkey) = max(p_partkey) THEN min(p_partkey) END AS codigo FROM part GROUP BY 1) SELECT p_partkey, p_name, codigo FROM part JOIN c ON k = {sql_key('p_name')}""")
def a03_c07_tpu_enrich(spark, d):
    p = table(spark, d, "part")
    catalog = p.select(F.col("p_partkey").alias("codigo"), F.col("p_name").alias("nome"))
    return normalize.tpu_enrich(p.select("p_partkey", "p_name"), "p_name", catalog, "codigo")


@query(f"""WITH c AS (SELECT {sql_key('p_name')} AS k, CASE WHEN min(p_partkey) = max(p_partkey) THEN min(p_partkey) END AS codigo FROM part WHERE p_partkey % 11 > 0 GROUP BY 1) SELECT p_partkey, codigo FROM part LEFT JOIN c ON k = {sql_key('p_name')}""")
def a03_read_catalog(spark, d):
    """The catalogue as a file, with byte order marks, padded names and rows without a code, read again and put to names."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    code = F.when(k % 11 == 0, "sem código").when(k % 10 == 0, F.concat(F.lit("\ufeff"), k.cast("string"))).otherwise(k.cast("string"))
    at = shared_folder(spark, "catalog")
    p.select(code.alias("codigo"), F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("  "))).alias("nome")).write.csv(at)
    return normalize.tpu_enrich(p.select("p_partkey", "p_name"), "p_name", feeds.read_tpu_catalog(spark, at), "codigo").select("p_partkey", "codigo")


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS titulo, CASE WHEN html ILIKE '%captcha%' THEN 'captcha' WHEN html ILIKE '%segredo de justi%' THEN 'sigilo' ELSE 'desconhecida' END AS tipo FROM pages""")
def a04_c08_page_kind(spark, d):
    p = normalize.classify_pages(table(spark, d, "pages"), F.col("html"))
    return p.select("page_id", F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("titulo"), F.col("kind").alias("tipo"))


@query(with_ctes("""SELECT numero_cnj AS numero, classe_nome AS classe, assunto_nome AS assunto, CASE WHEN p.id % 2 = 0 THEN 'Foro Central' ELSE 'Foro de ' || comarca END AS foro, valor_causa_centavos, strftime(data_distribuicao, '%Y-%m-%d') AS distribuicao,
  'ativo:BANCO ' || (p.id % 9) || ':Ana & Filhos,Bruno|passivo:' || u.nome || ':' || CASE WHEN p.id % 4 = 0 THEN '|terceiro:Fulano:' ELSE '' END AS partes FROM processo p JOIN pessoa u USING (custkey) WHERE p.id % 5 > 0""", "processo", "pessoa"))
def a04_c08_case_pages(spark, d):
    """Covers, messages and outdated lots of all cases, packed by day, read again and taken apart: the newest complete lot of each case."""
    p = b.processo(spark, d).join(b.pessoa(spark, d).select("custkey", "nome"), "custkey")
    k, cents = F.col("id"), F.col("valor_causa_centavos")
    field = lambda name, c: F.concat(F.lit(f'<span id="{name}">'), c, F.lit("</span>"))
    party = lambda label, name, lawyers="": F.concat(F.lit(f'<tr><td><span class="tipoDeParticipacao">{label}</span></td><td class="nomeParteEAdvogado"> '), name, F.lit(f"{lawyers}</td></tr>"))
    cover = F.concat(
        F.lit("<html><body><div>"), field("numeroProcesso", F.col("numero_cnj")), field("classeProcesso", F.col("classe_nome")), field("assuntoProcesso", F.col("assunto_nome")), field("foroProcesso", F.when(k % 2 == 0, "Foro Central").otherwise(F.concat(F.lit("Foro de <b>"), "comarca", F.lit("</b>")))),
        field("dataHoraDistribuicaoProcesso", F.date_format("data_distribuicao", "dd/MM/yyyy' às 10:15 - Livre'")), field("valorAcaoProcesso", money_time.format_brl(cents)), F.lit('</div><table id="tablePartesPrincipais"><tr><td>Reqte</td><td>X</td></tr></table><table id="tableTodasPartes">'),
        party("Reqte:", F.concat(F.lit("BANCO "), (k % 9).cast("string")), "<br>Advogada:&nbsp;<span>Ana &amp; Filhos</span><br/>Advogado: Bruno"), party("Reqdo:", F.col("nome")), F.when(k % 4 == 0, party("Perito:", F.lit("Fulano"))).otherwise(""), F.lit("</table></body></html>"),
    )
    old = F.lit('<html><span id="numeroProcesso">de um lote anterior</span></html>')
    page = F.when(k % 5 == 0, "<html>Processo em segredo de justiça</html>").otherwise(cover)
    each = F.explode(F.array(F.struct(F.lit("a").alias("lot"), old.alias("html"), F.lit(0).alias("h")), F.struct(F.lit("b").alias("lot"), page.alias("html"), F.lit(2).alias("h")), F.struct(F.lit("c").alias("lot"), old.alias("html"), F.lit(5).alias("h"))))
    made = p.select("id", F.to_date("data_distribuicao").alias("day"), each.alias("x")).select("day", "x.lot", F.lit(1).alias("page"), "x.html", F.concat_ws("/", F.date_format("day", "yyyy/MM/dd"), F.concat("x.lot", F.lit("-"), F.col("id").cast("string")), F.lit("001.html")).alias("path"))
    at = f"{shared_folder(spark, 'pages')}/packed"
    feeds.pack_raw_pages(made.withColumn("day", F.trunc("day", "year")), at)
    read = feeds.read_packed_pages(spark, at, date(1970, 1, 1), date(2999, 1, 1))
    case, noon = F.regexp_extract("path", r"-([0-9]+)/", 1), F.lit("2024-01-01 12:00:00").cast("timestamp")
    hour = F.when(F.col("lot") == "a", 1).when(F.col("lot") == "b", 2).otherwise(3)
    lots = read.withColumns({"case": case, "completa": F.col("lot") != "c", "coletado_em": noon + F.make_dt_interval(hours=hour)})
    newest = entities.latest_complete_lot(lots, ["case"], noon + F.make_dt_interval(hours=F.lit(4)))
    out = normalize.extract_case_pages(newest.select("path", "html"))
    said = F.array_join(F.transform("partes", lambda x: F.concat_ws(":", x["polo"], x["nome"], F.array_join(x["advogados"], ","))), "|")
    return out.select("numero", "classe", "assunto", "foro", money_time.to_cents(F.col("valor")).alias("valor_causa_centavos"), F.date_format(money_time.parse_br_date(F.col("distribuicao")), "yyyy-MM-dd").alias("distribuicao"), said.alias("partes"))


@query(with_ctes("""SELECT 'valor negativo' AS violacao, count(*) AS n FROM processo WHERE valor_causa_centavos < 0 HAVING count(*) > 0 UNION ALL SELECT 'status fora da lista', count(*) FROM processo WHERE status NOT IN ('F', 'O') HAVING count(*) > 0 UNION ALL SELECT 'valor alto', count(*) FROM processo WHERE valor_causa_centavos > 20000000 HAVING count(*) > 0""", "processo"))
def c09_validate_rows(spark, d):
    checks = {"valor negativo": F.col("valor_causa_centavos") >= 0, "status fora da lista": F.col("status").isin("F", "O"), "numero inválido": ids.is_valid_cnj(F.col("numero_cnj")), "valor alto": F.col("valor_causa_centavos") <= 20_000_000}
    return normalize.validate_rows(b.processo(spark, d), checks)


@query(with_ctes("""SELECT id, numero_cnj FROM processo WHERE contains(replace(replace(numero_cnj, '-', ''), '.', ''), '0000123') OR id IN (SELECT processo_id FROM reu WHERE contains(upper(nome), '00012')) """, "processo", "reu"))
def c10_search_occurrences(spark, d):
    people = b.reu(spark, d).select("processo_id", text.normalize_name(F.col("nome")).alias("nome_normalizado"))
    by_number = normalize.search_cases(b.processo(spark, d), people, "0000123")
    by_name = normalize.search_cases(b.processo(spark, d), people, "00012")
    return by_number.union(by_name).select("id", "numero_cnj").distinct()


@query(with_ctes("SELECT id, status FROM processo WHERE status = 'O' AND data_distribuicao >= DATE '1996-06-01' AND valor_causa_centavos >= 10000000 AND cliente_id = 3", "processo"))
def c11_filter_occurrences(spark, d):
    return normalize.filter_rows(b.processo(spark, d), 3, status="O", since=("data_distribuicao", "1996-06-01"), least=("valor_causa_centavos", 10_000_000)).select("id", "status")


@query(with_ctes("SELECT id, coalesce(disponivel >= DATE '2024-01-27', false) AS recente FROM publicacao", "publicacao"))
def c12_recent(spark, d):
    return b.publicacao(spark, d).select("id", normalize.recent(F.col("disponivel"), F.lit("2024-01-30").cast("date"), 3).alias("recente"))
