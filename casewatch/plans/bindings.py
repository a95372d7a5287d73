"""The driver's tables as court-case tables, each with the SQL that gives the same rows.

Only this module knows the driver's tables. A binding is a function of
(spark, sf_dir); its SQL twin is a common table expression of the same name in
``CTES``, and ``with_ctes`` puts those that a query needs before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, money_time

#: Class code and name by order priority.
CLASSES = {
    "1-URGENT": (1116, "Execução Fiscal"),
    "2-HIGH": (40, "Monitória"),
    "3-MEDIUM": (7, "Procedimento Comum Cível"),
    "4-NOT SPECIFIED": (181, "Busca e Apreensão"),
    "5-LOW": (92, "Despejo por Falta de Pagamento"),
}
#: Subject code and name by order key modulo 3.
SUBJECTS = {0: (9580, "Cobrança"), 1: (7771, "Contratos Bancários"), 2: (10433, "Dano Moral")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by(c: Column, values: dict, i: int) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(c == k, v[i]).otherwise(out)
    return out


def cpf(key: Column) -> Column:
    return ids.complete_document(F.lpad((key % 1_000_000_000).cast("string"), 9, "0"), ids.CPF_WEIGHTS)


def cnpj(key: Column) -> Column:
    return ids.complete_document(F.concat(F.lpad((key % 100_000_000).cast("string"), 8, "0"), F.lit("0001")), ids.CNPJ_WEIGHTS)


def processo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case an order."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    parts = (F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.year("o_orderdate").cast("string"), F.lit("8"), F.lit("26"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0"))
    seq, year, seg, court, origin = parts
    number = F.concat(seq, F.lit("-"), F.concat_ws(".", ids.cnj_check_digit(*parts), year, seg, court, origin))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    sealed = F.col("o_orderkey") % 97 == 0
    return joined.select(
        F.col("o_orderkey").alias("id"), number.alias("numero_cnj"), F.col("c_custkey").alias("custkey"), F.col("c_nationkey").cast("long").alias("cliente_id"),
        _by(F.col("o_orderpriority"), CLASSES, 0).cast("long").alias("classe_codigo"), _by(F.col("o_orderpriority"), CLASSES, 1).alias("classe_nome"),
        _by(F.col("o_orderkey") % 3, SUBJECTS, 0).cast("long").alias("assunto_codigo"), _by(F.col("o_orderkey") % 3, SUBJECTS, 1).alias("assunto_nome"),
        F.col("n_name").alias("comarca"), F.to_date("o_orderdate").alias("data_distribuicao"), money_time.number_to_cents(F.col("o_totalprice")).alias("valor_causa_centavos"),
        sealed.alias("segredo"), F.col("o_orderstatus").alias("status"),
    )


def pessoa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, with company endings and tax ids by key: every seventh has none."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.concat("c_name", F.when(k % 3 == 0, " Ltda.").when(k % 3 == 1, " S/A").otherwise(""))
    doc = F.when(k % 7 != 0, F.when(k % 3 == 2, cpf(k)).otherwise(cnpj(k)))
    return c.select(k.alias("custkey"), name.alias("nome"), doc.alias("documento"), F.col("c_nationkey").cast("long").alias("cliente_id"), "c_mktsegment")


def parte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of cases by supplier; lines of the driver's table repeat, so do these rows."""
    line = table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_returnflag") == "A", "ativo").when(F.col("l_returnflag") == "R", "passivo").otherwise("terceiro")
    return line.select(F.col("l_orderkey").alias("processo_id"), F.col("l_suppkey").alias("pessoa_id"), side.alias("polo"), F.col("l_linenumber").cast("long").alias("ordem"))


def reus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defendant of each case, sealed or not: the order's customer, by document."""
    case = processo(spark, sf_dir).select(F.col("id").alias("processo_id"), "custkey", "segredo")
    return case.join(pessoa(spark, sf_dir).select("custkey", "nome", "documento"), "custkey").select("processo_id", "nome", "documento", F.lit("passivo").alias("polo"), "segredo")


def reu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defendant of each case that isn't sealed."""
    return reus(spark, sf_dir).where("not segredo").drop("segredo")


def alvo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watch targets: documents of every fifth person that has one; the nation is the client."""
    p = pessoa(spark, sf_dir).where("custkey % 5 = 0 and documento is not null")
    return p.select(F.col("custkey").alias("alvo_id"), "cliente_id", F.col("documento").alias("valor"), F.when(F.col("c_mktsegment") == "BUILDING", "critica").otherwise("padrao").alias("prioridade"))


def execucao(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection runs: events, five courts."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("tribunal"), (F.col("event_type") != "error").alias("sucesso"), "user_id", "event_type", "value")


def publicacao(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications: documents; the recipient is the first sentence, slightly changed by id."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    first = F.trim(F.regexp_extract("text", r"^([^.\n]*)", 1))
    n = F.length(first)
    name = F.when(i % 4 == 0, first).when(i % 4 == 1, F.substring(first, F.lit(1), n - 1)).when(i % 4 == 2, F.concat(first, F.lit("s"))).otherwise(F.concat(F.substring(first, 1, 3), F.lit("x"), F.substring(first, F.lit(5), n)))
    return d.select(i.alias("id"), F.col("source").alias("fonte"), F.col("lang").alias("tribunal"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int")).alias("disponivel"), name.alias("destinatario"), F.length("text").cast("long").alias("tamanho"))


def assinatura(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions: orders; status by theirs, the end by their date."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "ativa").when(F.col("o_orderstatus") == "O", "atrasada").otherwise("pendente")
    status = F.when(k % 23 == 0, "cancelada").otherwise(status)
    return o.select(
        k.alias("id"), (F.col("o_custkey") % 100).alias("cliente_id"), status.alias("status"), F.date_add(F.to_date("o_orderdate"), 30).alias("vigente_ate"), (k % 11 == 0).alias("cortesia"), (k % 5 == 0).alias("cancelar_no_fim"),
        F.when(k % 3 != 0, F.concat(F.lit("sub_"), k.cast("string"))).alias("gateway_id"), F.when(k % 13 == 0, F.lit("erro")).alias("cobranca_erro"), (k % 4 == 0).alias("tem_link"), (k % 6 != 0).alias("tem_documento"),
    )


def _case(column: str, values: dict, i: int) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {column} = {quote(k)} THEN {quote(v[i])}" for k, v in values.items()) + " END"


def sql_check_digit(x: str, weights: tuple[int, ...]) -> str:
    total = " + ".join(f"(ascii(substr({x}, {i + 1}, 1)) - 48) * {w}" for i, w in enumerate(weights))
    return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END)"


def sql_norm(x: str) -> str:
    """normalize_name without stripping, in DuckDB's SQL."""
    return f"trim(regexp_replace(regexp_replace(upper(strip_accents(replace({x}, 'ß', 'ss'))), '[''’`´]', '', 'g'), '[^A-Z0-9]+', ' ', 'g'))"


def sql_key(x: str) -> str:
    """tpu_key in DuckDB's SQL."""
    return f"trim(regexp_replace(upper(strip_accents(replace({x}, 'ß', 'ss'))), '[^A-Z0-9]+', ' ', 'g'))"


def sql_trgm(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


_BASE = "lpad(o_orderkey::VARCHAR, 7, '0') || year(o_orderdate) || '826' || lpad(c_nationkey::VARCHAR, 4, '0')"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "processo": (
        (),
        f"""SELECT o_orderkey AS id, lpad(o_orderkey::VARCHAR, 7, '0') || '-' || lpad((98 - ({_BASE})::HUGEINT * 100 % 97)::VARCHAR, 2, '0') || '.' || year(o_orderdate) || '.8.26.' || lpad(c_nationkey::VARCHAR, 4, '0') AS numero_cnj,
      c_custkey AS custkey, c_nationkey::BIGINT AS cliente_id, {_case("o_orderpriority", CLASSES, 0)}::BIGINT AS classe_codigo, {_case("o_orderpriority", CLASSES, 1)} AS classe_nome,
      {_case("o_orderkey % 3", SUBJECTS, 0)}::BIGINT AS assunto_codigo, {_case("o_orderkey % 3", SUBJECTS, 1)} AS assunto_nome, n_name AS comarca, o_orderdate::DATE AS data_distribuicao,
      (round(o_totalprice::VARCHAR::DECIMAL(38,18), 2) * 100)::BIGINT AS valor_causa_centavos, o_orderkey % 97 = 0 AS segredo, o_orderstatus AS status
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "pessoa0": ((), "SELECT *, lpad((c_custkey % 1000000000)::VARCHAR, 9, '0') AS f, lpad((c_custkey % 100000000)::VARCHAR, 8, '0') || '0001' AS j FROM customer"),
    "pessoa1": (("pessoa0",), f"SELECT *, f || {sql_check_digit('f', ids.CPF_WEIGHTS[1:])} AS f1, j || {sql_check_digit('j', ids.CNPJ_WEIGHTS[1:])} AS j1 FROM pessoa0"),
    "pessoa": (
        ("pessoa1",),
        f"""SELECT c_custkey AS custkey, c_name || CASE c_custkey % 3 WHEN 0 THEN ' Ltda.' WHEN 1 THEN ' S/A' ELSE '' END AS nome,
      CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 3 = 2 THEN f1 || {sql_check_digit('f1', ids.CPF_WEIGHTS)} ELSE j1 || {sql_check_digit('j1', ids.CNPJ_WEIGHTS)} END END AS documento, c_nationkey::BIGINT AS cliente_id, c_mktsegment FROM pessoa1""",
    ),
    "parte": ((), "SELECT l_orderkey AS processo_id, l_suppkey AS pessoa_id, CASE l_returnflag WHEN 'A' THEN 'ativo' WHEN 'R' THEN 'passivo' ELSE 'terceiro' END AS polo, l_linenumber::BIGINT AS ordem FROM lineitem"),
    "reu": (("processo", "pessoa"), "SELECT id AS processo_id, p.nome, p.documento, 'passivo' AS polo FROM processo JOIN pessoa p USING (custkey) WHERE NOT segredo"),
    "alvo": (("pessoa",), "SELECT custkey AS alvo_id, cliente_id, documento AS valor, CASE WHEN c_mktsegment = 'BUILDING' THEN 'critica' ELSE 'padrao' END AS prioridade FROM pessoa WHERE custkey % 5 = 0 AND documento IS NOT NULL"),
    "execucao": ((), "SELECT event_id, ts, user_id % 5 AS tribunal, event_type <> 'error' AS sucesso, user_id, event_type, value FROM events"),
    "publicacao0": ((), r"SELECT *, trim(regexp_extract(text, '^([^.\n]*)', 1)) AS s FROM documents"),
    "publicacao": (
        ("publicacao0",),
        """SELECT doc_id AS id, source AS fonte, lang AS tribunal, DATE '2024-01-01' + (doc_id % 30)::INT AS disponivel,
      CASE doc_id % 4 WHEN 0 THEN s WHEN 1 THEN substr(s, 1, length(s) - 1) WHEN 2 THEN s || 's' ELSE substr(s, 1, 3) || 'x' || substr(s, 5) END AS destinatario, length(text) AS tamanho FROM publicacao0""",
    ),
    "assinatura": (
        (),
        """SELECT o_orderkey AS id, o_custkey % 100 AS cliente_id, CASE WHEN o_orderkey % 23 = 0 THEN 'cancelada' WHEN o_orderstatus = 'F' THEN 'ativa' WHEN o_orderstatus = 'O' THEN 'atrasada' ELSE 'pendente' END AS status,
      o_orderdate::DATE + 30 AS vigente_ate, o_orderkey % 11 = 0 AS cortesia, o_orderkey % 5 = 0 AS cancelar_no_fim, CASE WHEN o_orderkey % 3 <> 0 THEN 'sub_' || o_orderkey END AS gateway_id,
      CASE WHEN o_orderkey % 13 = 0 THEN 'erro' END AS cobranca_erro, o_orderkey % 4 = 0 AS tem_link, o_orderkey % 6 <> 0 AS tem_documento FROM orders""",
    ),
}


def with_ctes(body: str, *names: str, **own: str) -> str:
    """``body`` after the expressions it needs: named bindings with what they need, then ``own`` ones."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({s})" for n, s in own.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
