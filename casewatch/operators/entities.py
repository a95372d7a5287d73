"""Deduplication, resolution of people and upserts of cases.

Every choice among rows has a total order, so that a job that is run again, or
on other partitions, gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import similarity_join
from ..sources.shared import stored


def first_per_key(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row a key: the first by ``order``, then by all columns. A struct minimum, which is aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    row = F.struct(*rest)
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.xxhash64(F.to_json(row)).alias("h"))
    return rows.groupBy(*key).agg(F.min_by(row, rank).alias("x_")).select(*key, "x_.*").select(*rows.columns)


def dedup_publications(rows: DataFrame, *order: Column) -> DataFrame:
    """First of each (fonte, id_externo)."""
    return first_per_key(rows, ["fonte", "id_externo"], *order)


def upsert_cases(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All cases, one a number: values of new rows replace old ones, primeira_coleta_em is the earliest, novo says it was absent.

    Both sides have numero_cnj, primeira_coleta_em and the same other columns;
    ``new`` is deduplicated by its latest primeira_coleta_em first.
    """
    new = first_per_key(new, ["numero_cnj"], -F.unix_micros(F.col("primeira_coleta_em").cast("timestamp")))
    values = [c for c in existing.columns if c not in ("numero_cnj", "primeira_coleta_em")]
    a = existing.select("numero_cnj", F.struct(*values).alias("old_"), F.col("primeira_coleta_em").alias("since_"))
    b = new.select("numero_cnj", F.struct(*values).alias("new_"), F.col("primeira_coleta_em").alias("seen_"))
    both = a.join(b, "numero_cnj", "full_outer")
    return both.select("numero_cnj", F.coalesce("new_", "old_").alias("x_"), F.least("since_", "seen_").alias("primeira_coleta_em"), F.col("old_").isNull().alias("novo")).select("numero_cnj", "x_.*", "primeira_coleta_em", "novo")


def dedup_parties(parties: DataFrame) -> DataFrame:
    """Within a case one party for each (polo, document or else name): the first by ordem, with the lawyers of all in order.

    Columns: processo_id, polo, documento, nome_normalizado, ordem, advogados array<string>.
    """
    key = F.coalesce("documento", F.concat(F.lit("nome:"), "nome_normalizado"))
    keyed = parties.withColumn("key_", key)
    first = F.min_by(F.struct("documento", "nome_normalizado", "ordem"), F.struct("ordem", "nome_normalizado"))
    said = F.array_sort(F.collect_set(F.struct("ordem", "advogados")))
    out = keyed.groupBy("processo_id", "polo", "key_").agg(first.alias("f"), said.alias("s"))
    return out.select("processo_id", "polo", "f.*", F.array_distinct(F.flatten(F.transform("s", lambda x: x["advogados"]))).alias("advogados"))


def dedup_lawyers(rows: DataFrame, key: tuple[str, ...] = ("parte", "nome", "oab_numero", "oab_uf")) -> DataFrame:
    """Distinct lawyers of a party; nulls are equal to each other, as in any grouping."""
    return rows.select(*key).distinct()


def new_rows(rows: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Distinct rows whose key isn't known yet; nulls equal each other."""
    a, b = rows.select(*key).distinct().alias("a"), known.select(*key).distinct().alias("b")
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    return a.join(b, cond, "left_anti")


#: Rows to a range where ids are handed out.
RANGE = 100_000


def dense_ids(keys: DataFrame, after: int, column: str = "pessoa_id") -> DataFrame:
    """``keys`` (distinct rows) with ids after + 1, after + 2, ... in the order of the keys, none left out.

    Rows are dealt by ranges of keys and numbered where they lie; a range's
    ids begin after the counts of those before it, a row for each range. No
    task has all keys, and a run over the same keys gives the same ids.
    """
    cols = keys.columns
    parts = max(1, -(-keys.count() // RANGE))
    lying = keys.repartitionByRange(parts, *cols).sortWithinPartitions(*cols)
    lying = stored(lying.withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}))
    counts = lying.groupBy("part_").agg(F.min("at_").alias("from_"), F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("part_", (before - F.col("from_") + after + 1).alias("shift_"))
    return lying.join(shift, "part_").select(*cols, (F.col("at_") + F.col("shift_")).alias(column))


def resolve_by_document(rows: DataFrame, people: DataFrame) -> DataFrame:
    """``rows`` that have a document, with pessoa_id, nova and the link confirmada; one person for each document, never two documents in one.

    ``people`` (pessoa_id long, documento) are those known: a document that
    one of them has is linked to the one of least id, each other one becomes a
    new person whose id follows the greatest known.
    """
    rows = rows.where("documento is not null")
    known = people.where("documento is not null").groupBy("documento").agg(F.min("pessoa_id").alias("pessoa_id"))
    fresh = stored(rows.select("documento").distinct().join(known, "documento", "left_anti"))
    last = people.agg(F.max("pessoa_id")).first()[0] or 0
    ids = known.withColumn("nova", F.lit(False)).union(dense_ids(fresh, last).withColumn("nova", F.lit(True)))
    return rows.join(ids, "documento").withColumn("confianca_vinculo", F.lit("confirmada"))


def with_new_people(people: DataFrame, resolved: DataFrame) -> DataFrame:
    """``people`` (pessoa_id, documento) and those that ``resolve_by_document`` added: the state before the next batch."""
    return people.select("pessoa_id", "documento").union(resolved.where("nova").select("pessoa_id", "documento").distinct())


def resolve_by_name(rows: DataFrame, people: DataFrame, active: DataFrame, percent: int = 85) -> DataFrame:
    """(nome_normalizado, comarca, pessoa_id, nova) for parties without a document; links are a_verificar.

    ``people`` (pessoa_id, nome_normalizado) is the state before the batch and
    ``active`` (pessoa_id, comarca) where they had cases. A party is linked only
    if exactly one person is similar to it, has its very name and was active in
    its district. All others of one (name, district) become one new person; the
    order of rows in a batch has no bearing.
    """
    asked = rows.select("nome_normalizado", "comarca").distinct()
    # Only a name that some person has can be linked; the others need no similar ones.
    equal = asked.join(people.select("nome_normalizado"), "nome_normalizado", "left_semi")
    names = similarity_join(equal.select(F.col("nome_normalizado").alias("name")), people.select(F.col("nome_normalizado").alias("name")), percent)
    near = names.join(people.select("pessoa_id", F.col("nome_normalizado").alias("right_name")), "right_name")
    only = near.groupBy("left_name").agg(F.countDistinct("pessoa_id").alias("n"), F.min("pessoa_id").alias("pessoa_id"), F.min("right_name").alias("right_name"))
    only = only.where("n = 1 and left_name = right_name").select(F.col("left_name").alias("nome_normalizado"), F.col("pessoa_id").alias("found_"))
    linked = asked.join(only, "nome_normalizado").join(active.select(F.col("pessoa_id").alias("found_"), "comarca").distinct(), ["found_", "comarca"], "left_semi")
    # A null district is never linked, so a plain join loses nothing.
    out = asked.join(linked, ["nome_normalizado", "comarca"], "left")
    return out.select("nome_normalizado", "comarca", F.coalesce("found_", F.xxhash64(F.lit("nome"), "nome_normalizado", "comarca")).alias("pessoa_id"), F.col("found_").isNull().alias("nova"))


def reuse_existing_party(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """``rows`` (processo_id, polo, nome_normalizado) with the person of the earliest party of the same case, side and name, or null."""
    key = ["processo_id", "polo", "nome_normalizado"]
    known = existing.groupBy(*key).agg(F.min_by("pessoa_id", "parte_id").alias("pessoa_id"), F.min("parte_id").alias("parte_id"))
    return rows.join(known, key, "left")


def purge_sealed(parties: DataFrame, cases: DataFrame) -> DataFrame:
    """Parties of cases that aren't sealed."""
    return parties.join(cases.where("segredo").select(F.col("id").alias("processo_id")), "processo_id", "left_anti")


def fill_missing(cases: DataFrame, metadata: DataFrame) -> DataFrame:
    """Blank fields filled from metadata by numero_cnj: class only where code and name are both blank, subjects
    (assuntos, an array, where both tables have it) only where there are none, date, court unit, instance."""
    lists = [c for c in ("assuntos",) if c in cases.columns and c in metadata.columns]
    m = metadata.select("numero_cnj", *[F.col(c).alias(f"m_{c}") for c in ("classe_codigo", "classe_nome", "data_distribuicao", "vara", "grau", *lists)])
    j = cases.join(m, "numero_cnj", "left")
    blank = F.col("classe_codigo").isNull() & F.col("classe_nome").isNull()
    fills = {c: F.when(blank, F.col(f"m_{c}")).otherwise(F.col(c)) for c in ("classe_codigo", "classe_nome")} | {c: F.coalesce(c, f"m_{c}") for c in ("data_distribuicao", "vara", "grau")}
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    fills |= {c: F.when(~some(c) & some(f"m_{c}"), F.col(f"m_{c}")).otherwise(F.col(c)) for c in lists}
    return j.select(*[fills[c].alias(c) if c in fills else F.col(c) for c in cases.columns])


def pending_enrichment(cases: DataFrame, now: Column, hours: int, limit: int) -> DataFrame:
    """The ``limit`` lowest ids without a class, not sealed, never consulted or not for ``hours``."""
    stale = F.col("datajud_consultado_em").isNull() | (F.col("datajud_consultado_em") < now - F.make_dt_interval(hours=F.lit(hours)))
    return cases.where(F.col("classe_codigo").isNull() & F.col("classe_nome").isNull() & ~F.col("segredo") & stale).orderBy("id").limit(limit)


def pending_analysis(publications: DataFrame, analysed: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` lowest ids of publications without an analysis."""
    return publications.join(analysed.select("id"), "id", "left_anti").orderBy("id").limit(limit)


def cases_from_publications(publications: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, parties): one case for each number, unit from its earliest publication unless known; recipients become
    parties only while the case isn't complete. ``known`` has numero_cnj, vara, completo."""
    found = publications.where("numero_cnj is not null")
    earliest = found.groupBy("numero_cnj").agg(F.min_by(F.struct("tribunal", "orgao"), F.struct("disponivel", "id")).alias("x"))
    cases = earliest.join(known, "numero_cnj", "left").select("numero_cnj", "x.tribunal", F.coalesce("vara", "x.orgao").alias("vara"), F.col("completo").isNull().alias("novo"))
    open_ = found.join(known.where("completo").select("numero_cnj"), "numero_cnj", "left_anti")
    parties = open_.select("numero_cnj", F.explode("destinatarios").alias("d")).select("numero_cnj", "d.nome", F.when(F.col("d.polo").isin("ativo", "passivo"), F.col("d.polo")).otherwise("terceiro").alias("polo")).distinct()
    return cases, parties


def latest_complete_lot(pages: DataFrame, key: list[str], now: Column, hours: int = 24) -> DataFrame:
    """Pages of the newest complete lot of each key within ``hours``; ties go to the greater lot."""
    fresh = pages.where(F.col("completa") & (F.col("coletado_em") > now - F.make_dt_interval(hours=F.lit(hours))))
    newest = fresh.groupBy(*key).agg(F.max_by("lot", F.struct("coletado_em", "lot")).alias("lot"))
    return pages.join(newest, [*key, "lot"], "left_semi")


def union_sources(covers: DataFrame, publications: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row a number: a complete cover before a publication, blanks filled from metadata. All have the columns of ``covers``."""
    both = covers.withColumn("rank_", F.lit(0)).unionByName(publications.withColumn("rank_", F.lit(1)))
    base = first_per_key(both, ["numero_cnj"], F.col("rank_")).drop("rank_")
    m = first_per_key(metadata, ["numero_cnj"])
    names = [c for c in covers.columns if c != "numero_cnj"]
    j = base.join(m.select("numero_cnj", *[F.col(c).alias(f"m_{c}") for c in names]), "numero_cnj", "full_outer")
    return j.select("numero_cnj", *[F.coalesce(c, f"m_{c}").alias(c) for c in names])


def latest_per_key(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The row of each key that is greatest by ``order``, then by all columns."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("x_")).select(*key, "x_.*").select(*rows.columns)


def top_parties_per_side(parties: DataFrame, cases: DataFrame, n: int = 3) -> DataFrame:
    """(processo_id, polo, nomes): the first ``n`` distinct names of each side in order of party; sealed cases have none."""
    first = purge_sealed(parties, cases).groupBy("processo_id", "polo", "nome").agg(F.min("ordem").alias("ordem"))
    line = Window.partitionBy("processo_id", "polo").orderBy("ordem", "nome")
    kept = first.withColumn("n_", F.row_number().over(line)).where(F.col("n_") <= n)
    return kept.groupBy("processo_id", "polo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_", "nome"))), lambda x: x["nome"]), "; ").alias("nomes"))
