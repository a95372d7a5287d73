"""Reading landed files: publication feeds, case metadata, catalogues, saved pages, company registers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, money_time, text

#: Keys under which a feed lists its items.
LISTS = ("items", "content", "conteudo", "comunicacoes")
_PERSON = "struct<nome:string,polo:string>"
_LAWYER = "struct<nome:string,numero_oab:string,uf_oab:string>"
ITEM = (
    "struct<id:string,hash:string,idComunicacao:string,data_disponibilizacao:string,dataDisponibilizacao:string,"
    "siglaTribunal:string,nomeOrgao:string,numero_processo:string,numeroProcesso:string,texto:string,conteudo:string,link:string,"
    f"destinatarios:array<{_PERSON}>,destinatarioadvogados:array<struct<advogado:{_LAWYER}>>>"
)
HIT = (
    "struct<numeroProcesso:string,tribunal:string,grau:string,dataAjuizamento:string,nivelSigilo:int,`@timestamp`:string,"
    "classe:struct<codigo:string,nome:string>,assuntos:string,orgaoJulgador:struct<codigo:string,nome:string>>"
)
#: Instances of a case from first to last choice.
INSTANCES = ("G1", "JE", "G2", "TR", "SUP")


def publication_items(pages: DataFrame, body: Column) -> DataFrame:
    """One row, ``item``, for each item of each response: under one of LISTS, or a bare list; other bodies give none."""
    listed = F.from_json(body, "struct<" + ",".join(f"{k}:array<{ITEM}>" for k in LISTS) + ">")
    bare = F.from_json(body, f"array<{ITEM}>")
    found = F.coalesce(*[listed[k] for k in LISTS], bare)
    return pages.select(F.explode(found).alias("item"))


def read_publications(spark: SparkSession, path: str) -> DataFrame:
    return publication_items(spark.read.text(path, wholetext=True), F.col("value"))


def flatten_publications(items: DataFrame, source: str = "djen") -> DataFrame:
    """Publications with id and text; sides of recipients mapped, lawyers distinct by name and licence."""
    i = F.col("item")
    key = F.coalesce(text.squeeze(i["id"]), text.squeeze(i["hash"]), text.squeeze(i["idComunicacao"]))
    people = F.transform(F.coalesce(i["destinatarios"], F.array().cast(f"array<{_PERSON}>")), lambda p: F.struct(text.squeeze(p["nome"]).alias("nome"), text.side_from_code(p["polo"]).alias("polo")))
    lawyers = F.transform(i["destinatarioadvogados"], lambda a: F.struct(text.squeeze(a["advogado"]["nome"]).alias("nome"), a["advogado"]["numero_oab"].alias("oab_numero"), F.upper(a["advogado"]["uf_oab"]).alias("oab_uf")))
    out = items.select(
        F.lit(source).alias("fonte"), key.alias("id_externo"), i["siglaTribunal"].alias("tribunal"), text.squeeze(i["nomeOrgao"]).alias("orgao"), ids.format_cnj(F.coalesce(i["numero_processo"], i["numeroProcesso"])).alias("numero_cnj"),
        money_time.parse_feed_date(i["data_disponibilizacao"], i["dataDisponibilizacao"]).alias("disponivel"), text.squeeze(F.coalesce(i["texto"], i["conteudo"])).alias("texto"),
        F.filter(people, lambda p: p["nome"].isNotNull()).alias("destinatarios"), F.coalesce(F.array_distinct(F.filter(lawyers, lambda a: a["nome"].isNotNull())), F.array().cast("array<struct<nome:string,oab_numero:string,oab_uf:string>>")).alias("advogados"),
    )
    return out.where("id_externo is not null and texto is not null")


def case_hits(pages: DataFrame, body: Column) -> DataFrame:
    """One row, ``hit``, for each hit of each search response; a body without hits gives none."""
    return pages.select(F.explode(F.from_json(body, f"struct<hits:struct<hits:array<struct<_source:{HIT}>>>>")["hits"]["hits"]).alias("h")).select(F.col("h._source").alias("hit"))


def read_case_metadata(spark: SparkSession, path: str) -> DataFrame:
    return case_hits(spark.read.text(path, wholetext=True), F.col("value"))


def flatten_case_metadata(hits: DataFrame) -> DataFrame:
    """Cases with a valid number; subjects flattened by one level, distinct in order, codes that aren't whole numbers null."""
    h, subject = F.col("hit"), "struct<codigo:string,nome:string>"
    flat, nested = F.from_json(h["assuntos"], f"array<{subject}>"), F.from_json(h["assuntos"], f"array<array<{subject}>>")
    is_nested = F.ltrim(F.substring(F.ltrim(h["assuntos"]), F.lit(2), F.length(h["assuntos"]))).startswith("[")
    subjects = F.transform(F.when(is_nested, F.flatten(nested)).otherwise(flat), lambda a: F.struct(a["codigo"].try_cast("long").alias("codigo"), text.squeeze(a["nome"]).alias("nome")))
    out = hits.select(
        ids.format_cnj(h["numeroProcesso"]).alias("numero_cnj"), h["tribunal"].alias("tribunal"), F.upper(h["grau"]).alias("grau"), money_time.parse_feed_date(h["dataAjuizamento"]).alias("data_distribuicao"),
        F.coalesce(h["nivelSigilo"], F.lit(0)).alias("nivel_sigilo"), h["@timestamp"].alias("atualizado"), h["classe"]["codigo"].try_cast("long").alias("classe_codigo"), text.squeeze(h["classe"]["nome"]).alias("classe_nome"),
        F.array_distinct(subjects).alias("assuntos"), text.squeeze(h["orgaoJulgador"]["nome"]).alias("vara"),
    )
    return out.where("numero_cnj is not null")


def best_instance(cases: DataFrame) -> DataFrame:
    """One row a number: that of the first instance in order; ties go to the earlier update, then the whole row."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, INSTANCES)), F.coalesce("grau", F.lit(""))), F.lit(0)), F.lit(len(INSTANCES) + 1))
    row = F.struct(*[c for c in cases.columns if c != "numero_cnj"])
    return cases.groupBy("numero_cnj").agg(F.min_by(row, F.struct(rank.alias("r"), F.xxhash64(F.to_json(row)).alias("h"))).alias("x")).select("numero_cnj", "x.*")


def read_tpu_catalog(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(codigo, nome) of a catalogue file; a byte order mark is tolerated, rows without a code are skipped."""
    raw = spark.read.csv(path, sep=sep, header=False, schema="codigo string, nome string", encoding="UTF-8")
    code = F.regexp_replace("codigo", "^\\x{FEFF}", "")
    return raw.select(code.try_cast("long").alias("codigo"), text.squeeze(F.col("nome")).alias("nome")).where("codigo is not null")


def read_raw_pages(spark: SparkSession, path: str, days: list[date] | None = None) -> DataFrame:
    """(path, day, lot, page, html) of saved pages named .../YYYY/MM/DD/<lot>/NNN.html; with ``days`` only those folders are listed."""
    at = r"/([0-9]{4})/([0-9]{2})/([0-9]{2})/([^/]+)/([0-9]+)\.html$"
    if days is None:
        raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    else:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        folders = [f"{path.rstrip('/')}/{d:%Y/%m/%d}" for d in days]
        there = [f for f in folders if (p := jvm.org.apache.hadoop.fs.Path(f)).getFileSystem(conf).exists(p)]
        raw = spark.read.text(there, wholetext=True, recursiveFileLookup=True) if there else spark.createDataFrame([], "value string")
    p = raw.select((F.input_file_name() if days is None or there else F.lit("")).alias("path"), F.col("value").alias("html"))
    day = F.try_to_date(F.concat_ws("-", *[F.regexp_extract("path", at, i) for i in (1, 2, 3)]), "yyyy-MM-dd")
    return p.select("path", day.alias("day"), F.regexp_extract("path", at, 4).alias("lot"), F.regexp_extract("path", at, 5).try_cast("int").alias("page"), "html")


def pack_raw_pages(pages: DataFrame, path: str) -> None:
    """Pages (path, day, lot, page, html) of many small files as few large ones, in a folder for each day."""
    pages.repartition("day").write.partitionBy("day").mode("append").parquet(path)


def read_packed_pages(spark: SparkSession, path: str, first: date, last: date) -> DataFrame:
    """What ``pack_raw_pages`` wrote, from day ``first`` to ``last``: the folders of other days aren't read."""
    pages = spark.read.schema("path string, lot string, page int, html string, day date").parquet(path)
    return pages.where(F.col("day").between(F.lit(first), F.lit(last))).select("path", "day", "lot", "page", "html")


def company_lookup(rows: DataFrame, register: DataFrame, document: str = "documento") -> DataFrame:
    """``rows`` of companies in the register, with razao_social, nome_fantasia and situacao; companies without a name are left out."""
    r = register.select(ids.normalize_document(F.col("cnpj")).alias("cnpj_"), text.squeeze(F.col("razao_social")).alias("razao_social"), text.squeeze(F.col("nome_fantasia")).alias("nome_fantasia"), text.squeeze(F.col("situacao")).alias("situacao"))
    return rows.join(r.where("razao_social is not null"), ids.normalize_document(F.col(document)) == F.col("cnpj_")).drop("cnpj_")
