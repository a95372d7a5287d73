"""Matching cases against targets, names, rules and contracted terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import similarity_join

#: Orders of preference among the matches of one case and target.
CONFIDENCES, CRITERIA, SIDES = ("confirmada", "a_verificar"), ("documento", "busca_documento", "nome", "regra"), ("passivo", "ativo", "terceiro")


def rank(c: Column, values: tuple[str, ...]) -> Column:
    """Place in ``values`` from 0; anything else, null too, comes last."""
    out = F.lit(len(values))
    for i, v in enumerate(values):
        out = F.when(c == v, i).otherwise(out)
    return out


def matchable(rows: DataFrame) -> DataFrame:
    """Rows that take part in matching: not under seal (segredo) and not switched off (ativo), where those columns are given; null is neither."""
    if "segredo" in rows.columns:
        rows = rows.where(~F.coalesce("segredo", F.lit(False)))
    if "ativo" in rows.columns:
        rows = rows.where(F.coalesce("ativo", F.lit(True)))
    return rows


def match_by_document(parties: DataFrame, targets: DataFrame) -> DataFrame:
    """(processo_id, alvo_id, cliente_id, polo, confianca, criterio): parties whose confirmed document is an active target's; none of sealed cases (``matchable``)."""
    p, targets = matchable(parties).where("documento is not null"), matchable(targets)
    if "confianca_vinculo" in p.columns:
        p = p.where("confianca_vinculo = 'confirmada'")
    return p.join(targets, p["documento"] == targets["valor"]).select("processo_id", "alvo_id", "cliente_id", "polo", F.lit("confirmada").alias("confianca"), F.lit("documento").alias("criterio"))


def match_by_searched_document(searched: DataFrame, targets: DataFrame, by_document: DataFrame, by_name: DataFrame) -> DataFrame:
    """Cases that a court's query for a document returned, where the document isn't on the cover; side of the best match by name, or null. Sealed cases and inactive targets as in ``matchable``."""
    searched, targets = matchable(searched), matchable(targets)
    found = searched.join(targets, searched["documento"] == targets["valor"]).select("processo_id", "alvo_id", "cliente_id").distinct()
    found = found.join(by_document, ["processo_id", "alvo_id"], "left_anti")
    side = by_name.groupBy("processo_id", "alvo_id").agg(F.min_by("polo", rank(F.col("polo"), SIDES)).alias("polo"))
    return found.join(side, ["processo_id", "alvo_id"], "left").select("processo_id", "alvo_id", "cliente_id", "polo", F.lit("confirmada").alias("confianca"), F.lit("busca_documento").alias("criterio"))


def match_by_name(parties: DataFrame, targets: DataFrame, percent: int = 90) -> DataFrame:
    """Parties whose name is a target's or similar to it.

    ``parties``: processo_id, polo, nome_normalizado, documento. ``targets``:
    alvo_id, cliente_id, tipo, nome, one row for each name (a name target's
    value, any target's variations). A party with a document is never matched
    to a document target by name. Sealed cases and inactive targets as in ``matchable``.
    """
    found = name_matches(parties, targets, percent)
    # Only sides with several names, or targets with several, can be matched twice: all else isn't gathered again.
    once = found.where(~F.col("again_")).drop("again_")
    return once.union(found.where("again_").drop("again_").distinct())


#: Rows with one name that are expanded in one task, about.
CROWD = 1_000


def _crowds(rows: DataFrame, name: str, owner: list[str], kept: list[str]) -> DataFrame:
    """Lists of distinct rows with one name, of some ``CROWD`` each, as (name_, again_, x_): whether their owners have other rows too."""
    rows = rows.where(F.col(name).isNotNull()).select(F.col(name).alias("name_"), *kept).distinct()
    rows = rows.withColumn("again_", F.count("*").over(Window.partitionBy(*owner)) > 1)
    n = rows.groupBy("name_").agg(F.count("*").alias("n_")).where(F.col("n_") > CROWD)
    part = F.pmod(F.xxhash64(*owner), F.ceil(F.coalesce("n_", F.lit(1)) / CROWD))
    return rows.join(n, "name_", "left").groupBy("name_", "again_", part.alias("part_")).agg(F.collect_list(F.struct(*kept)).alias("x_"))


def name_matches(parties: DataFrame, targets: DataFrame, percent: int = 90) -> DataFrame:
    """``match_by_name`` with again_: without it each row is there once, with it rows may repeat.

    Copies of a name are expanded from lists of at most some ``CROWD``, dealt out
    anew, so that no task has all pairs of a common name.
    """
    parties, targets = matchable(parties), matchable(targets)
    pairs = similarity_join(parties.select(F.col("nome_normalizado").alias("name")), targets.select(F.col("nome").alias("name")), percent)
    p = _crowds(parties.withColumn("sem_", F.col("documento").isNull()), "nome_normalizado", ["processo_id", "polo"], ["processo_id", "polo", "sem_"])
    t = _crowds(targets.withColumn("por_nome_", F.coalesce(F.col("tipo") != "documento", F.lit(False))), "nome", ["alvo_id", "cliente_id"], ["alvo_id", "cliente_id", "por_nome_"])
    met = pairs.join(p.select(F.col("name_").alias("left_name"), F.col("again_").alias("p_"), F.col("x_").alias("a_")), "left_name")
    met = met.join(t.select(F.col("name_").alias("right_name"), F.col("again_").alias("t_"), F.col("x_").alias("b_")), "right_name")
    met = met.select((F.col("p_") | F.col("t_")).alias("again_"), "a_", "b_").repartition(int(parties.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = met.select("again_", "b_", F.explode("a_").alias("a")).select("again_", "a", F.explode("b_").alias("b")).where("a.sem_ or b.por_nome_")
    return near.select("a.processo_id", "b.alvo_id", "b.cliente_id", "a.polo", F.lit("a_verificar").alias("confianca"), F.lit("nome").alias("criterio"), "again_")


def best_match(matches: DataFrame) -> DataFrame:
    """One row for each case and target: the best by confidence, criterion and side."""
    order = F.struct(rank(F.col("confianca"), CONFIDENCES).alias("a"), rank(F.col("criterio"), CRITERIA).alias("b"), rank(F.col("polo"), SIDES).alias("c"))
    return matches.groupBy("processo_id", "alvo_id", "cliente_id").agg(F.min_by(F.struct("polo", "confianca", "criterio"), order).alias("x")).select("processo_id", "alvo_id", "cliente_id", "x.*")


def cover_text(*parts: Column) -> Column:
    """The text of a cover that free terms are looked up in."""
    return text.tpu_key(F.concat_ws(" ", *parts))


def match_rules(cases: DataFrame, rules: DataFrame, sides: DataFrame) -> DataFrame:
    """(processo_id, regra_id, cliente_id, confianca): cases that satisfy all the filters a rule has.

    ``cases``: id, classe_codigo, assuntos array<long>, comarca (canonical),
    valor_causa_centavos, capa. ``rules``: regra_id, cliente_id, classes and
    assuntos array<long>, comarcas and termos array<string>, valor_min_centavos,
    polo. ``sides``: processo_id, cliente_id, polo, confianca of targets' matches.

    A rule is joined by an equality on its most selective filter: class, else
    subject, district, phrase (with a run of as many words of the cover) or side
    (with what ``sides`` has); the other filters are tested on what that finds.
    Covers are fetched only for hits of rules that ask for more of them. Rules
    with a least value alone are asked of all cases, which are dealt over as many
    parts as shuffles have. Rules without a filter match nothing. Sealed cases
    and inactive rules as in ``matchable``.
    """
    cases, rules = matchable(cases), matchable(rules)
    spark, texts = cases.sparkSession, F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    r = rules.withColumns({"comarcas": F.transform("comarcas", text.canonical_district), "frases_": F.array_distinct(F.filter(F.transform("termos", text.tpu_key), lambda t: t != ""))})
    lead = F.when(some("classes"), "classe").when(some("assuntos"), "assunto").when(some("comarcas"), "comarca").when(some("termos"), "frase").when(F.col("polo").isNotNull(), "polo").when(F.col("valor_min_centavos").isNotNull(), "todas")
    r = r.withColumn("lead_", lead).where("lead_ is not null")
    plan = {x.lead_ for x in r.select("lead_").distinct().collect()}  # six kinds at most
    lengths = [x.n for x in r.where("lead_ = 'frase'").select(F.explode("frases_").alias("f")).select(F.size(F.split("f", " ")).alias("n")).distinct().collect()] if "frase" in plan else []
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = F.split("capa", " ")
    asked = {
        "classe": F.array_distinct("classes").cast("array<string>"), "assunto": F.array_distinct("assuntos").cast("array<string>"), "comarca": F.array_distinct("comarcas"), "frase": F.col("frases_"),
        "polo": F.array(F.concat_ws("/", F.col("cliente_id").cast("string"), "polo")), "todas": F.array(*[F.lit(str(i)) for i in range(shares)]),
    }
    runs = [F.transform(F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)), _words_from(words, n)) for n in lengths]
    given = {
        "classe": F.array(F.col("classe_codigo").cast("string")), "assunto": F.array_distinct("assuntos").cast("array<string>"), "comarca": F.array("comarca"),
        "frase": F.array_distinct(F.concat(*[F.coalesce(x, texts) for x in runs])) if runs else texts, "todas": F.array(F.pmod(F.xxhash64("id"), F.lit(shares)).cast("string")),
    }
    own = cases.select(F.col("id").alias("processo_id"), F.struct("classe_codigo", F.col("assuntos").alias("c_assuntos"), "comarca", "valor_causa_centavos").alias("c"), *[F.transform(F.coalesce(given[k].cast("array<string>"), texts), _tag(k)).alias(f"k_{k}") for k in given if k in plan])
    keys = [f"k_{k}" for k in given if k in plan]
    keyed = own.select("processo_id", "c", F.explode(F.concat(*keys)).alias("key_")).where("key_ is not null") if keys else own.select("processo_id", "c", F.lit("").alias("key_")).limit(0)
    if "polo" in plan:
        standing = sides.select("processo_id", F.concat(F.lit("polo:"), F.concat_ws("/", F.col("cliente_id").cast("string"), "polo")).alias("key_")).distinct()
        keyed = keyed.union(own.select("processo_id", "c").join(standing, "processo_id"))
    kept = ["regra_id", "cliente_id", "classes", "assuntos", "comarcas", F.when(F.col("lead_") == "frase", texts).otherwise(F.col("frases_")).alias("frases_"), F.when(F.col("lead_") != "frase", some("termos")).otherwise(False).alias("reads_"), "valor_min_centavos", F.col("polo").alias("r_polo")]
    keys = reduce(lambda out, k: F.when(F.col("lead_") == k, F.transform(asked[k], _tag(k))).otherwise(out), asked, F.lit(None).cast("array<string>"))
    hit = keyed.join(r.select(*kept, F.explode(keys).alias("key_")), "key_")
    fine = (
        (~some("classes") | F.array_contains("classes", F.col("c.classe_codigo"))) & (~some("assuntos") | F.arrays_overlap("assuntos", "c.c_assuntos")) & (~some("comarcas") | F.array_contains("comarcas", F.col("c.comarca")))
        & (F.col("valor_min_centavos").isNull() | F.coalesce(F.col("c.valor_causa_centavos") >= F.col("valor_min_centavos"), F.lit(False)))
    )
    hit = hit.where(F.coalesce(fine, F.lit(False))).select("processo_id", "regra_id", "cliente_id", "r_polo", "reads_").distinct()
    phrases = r.select("regra_id", "frases_")
    read = hit.where("reads_").join(phrases, "regra_id").join(cases.select(F.col("id").alias("processo_id"), F.concat(F.lit(" "), "capa", F.lit(" ")).alias("capa_")), "processo_id")
    read = read.where(F.exists("frases_", lambda t: F.contains(F.col("capa_"), F.concat(F.lit(" "), t, F.lit(" "))))).select(*hit.columns)
    return side_gate(hit.where("not reads_").union(read).drop("reads_"), sides)


def _words_from(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")


def _tag(kind: str):
    return lambda v: F.concat(F.lit(kind + ":"), v)


def side_gate(hits: DataFrame, sides: DataFrame) -> DataFrame:
    """A rule with a side (r_polo) needs a target of its client on that side of the case, and takes the best confidence of those."""
    best = sides.groupBy("processo_id", "cliente_id", F.col("polo").alias("r_polo")).agg(F.min_by("confianca", rank(F.col("confianca"), CONFIDENCES)).alias("best_"))
    gated = hits.join(best, ["processo_id", "cliente_id", "r_polo"], "left").where(F.col("r_polo").isNull() | F.col("best_").isNotNull())
    return gated.select("processo_id", "regra_id", "cliente_id", F.coalesce("best_", F.lit("confirmada")).alias("confianca"))


def match_terms(cases: DataFrame, terms: DataFrame) -> DataFrame:
    """(processo_id, regra_id): contracted terms met by cases.

    ``cases``: id, classe_nome, assunto_nomes array<string>, capa, tribunal.
    ``terms``: regra_id, tipo_termo (acao, assunto, frase), texto_termo, tribunal_sigla
    or null. Actions and subjects are matched by equality of keys; a phrase by
    equality with a run of as many words of the cover, so there is no cross join.
    Sealed cases and inactive terms as in ``matchable``.
    """
    cases, terms = matchable(cases), matchable(terms)
    t = terms.select("regra_id", "tipo_termo", text.tpu_key(F.col("texto_termo")).alias("key_"), F.upper("tribunal_sigla").alias("sigla_")).where("key_ <> ''")
    words = F.split("capa", " ")
    lengths = [r.n for r in t.where("tipo_termo = 'frase'").select(F.size(F.split("key_", " ")).alias("n")).distinct().collect()]  # as many as there are lengths of phrases
    runs = [F.transform(F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)), _run(words, n)) for n in lengths]
    said = F.concat(
        F.array(F.struct(F.lit("acao").alias("tipo_termo"), text.tpu_key(F.col("classe_nome")).alias("key_"))), F.transform("assunto_nomes", lambda a: F.struct(F.lit("assunto").alias("tipo_termo"), text.tpu_key(a).alias("key_"))),
        *[F.coalesce(r, F.array().cast("array<struct<tipo_termo:string,key_:string>>")) for r in runs],
    )
    keyed = cases.select(F.col("id").alias("processo_id"), F.upper("tribunal").alias("tribunal"), F.explode(F.array_distinct(said)).alias("s")).select("processo_id", "tribunal", "s.*")
    hit = keyed.join(t, ["tipo_termo", "key_"]).where(F.col("sigla_").isNull() | (F.col("sigla_") == F.col("tribunal")))
    return hit.select("processo_id", "regra_id").distinct()


def _run(words: Column, n: int):
    return lambda i: F.struct(F.lit("frase").alias("tipo_termo"), F.array_join(F.slice(words, i, F.lit(n)), " ").alias("key_"))


def merge_occurrences(existing: DataFrame, found: DataFrame, key: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """One row a key with criada and promovida: new ones are added, a_verificar becomes confirmada with the new criterion, a null side is filled.

    ``carried`` are columns of both that keep what an occurrence was made with.
    """
    values = ["polo", "confianca", "criterio", *carried]
    a = existing.select(*key, *[F.col(c).alias(f"o_{c}") for c in values])
    b = found.select(*key, *[F.col(c).alias(f"n_{c}") for c in values])
    j = a.join(b, key, "full_outer")
    created = F.col("o_confianca").isNull()
    promoted = F.coalesce((F.col("o_confianca") == "a_verificar") & (F.col("n_confianca") == "confirmada"), F.lit(False))
    new = lambda c: F.when(created | promoted, F.coalesce(f"n_{c}", f"o_{c}")).otherwise(F.col(f"o_{c}")).alias(c)
    kept = [F.when(created, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in carried]
    return j.select(*key, F.coalesce("o_polo", "n_polo").alias("polo"), new("confianca"), new("criterio"), *kept, created.alias("criada"), promoted.alias("promovida"))


def search_terms(targets: DataFrame, state: DataFrame) -> DataFrame:
    """(tipo, valor, alvos, varrido_ate): distinct terms with their (client, target) pairs and how far each was swept.

    ``targets``: alvo_id, cliente_id, tipo, valor, variacoes array<string>; a
    document target gives its variations alone, and those are names.
    """
    kind = F.when(F.col("tipo") == "oab", "oab").otherwise("nome")
    own = F.when(F.col("tipo") != "documento", F.array("valor")).otherwise(F.array().cast("array<string>"))
    all_ = targets.select("alvo_id", "cliente_id", kind.alias("tipo"), F.explode(F.array_distinct(F.concat(own, F.coalesce("variacoes", F.array().cast("array<string>"))))).alias("valor"))
    terms = all_.groupBy("tipo", "valor").agg(F.array_sort(F.collect_set(F.struct("cliente_id", "alvo_id"))).alias("alvos"))
    return terms.join(state.select("tipo", "valor", "varrido_ate"), ["tipo", "valor"], "left")


def link_publications(hits: DataFrame, targets: DataFrame, links: DataFrame) -> DataFrame:
    """(publicacao_id, alvo_id, origem) not linked yet: hits of a term by its targets from each one's start on.

    ``hits``: publicacao_id, termo, disponivel. ``targets``: termo, alvo_id, inicio, criado.
    """
    j = hits.join(targets, "termo").where(F.col("disponivel") >= F.col("inicio"))
    origin = F.when(F.col("disponivel") < F.col("criado"), "carga_inicial").otherwise("monitoramento")
    found = j.groupBy("publicacao_id", "alvo_id").agg(F.min(origin).alias("origem"))
    return found.join(links, ["publicacao_id", "alvo_id"], "left_anti")


def publication_confidence(kind: Column, term: Column, recipients: Column) -> Column:
    """confirmada for a licence, or where a recipient that is a company has exactly the term's name; else a_verificar."""
    company = F.exists(recipients, lambda n: (text.company_type_by_suffix(n) == "PJ") & (text.normalize_name(n) == text.normalize_name(term)))
    return F.when((kind == "oab") | F.coalesce(company, F.lit(False)), "confirmada").otherwise("a_verificar")


def new_numbers(returned: DataFrame, seen: DataFrame, first_run: bool, year: int) -> DataFrame:
    """Numbers a sweep hadn't returned before; its first run tells of those of ``year`` alone and only records the rest."""
    fresh = returned.select("varredura", "numero_cnj").distinct().join(seen, ["varredura", "numero_cnj"], "left_anti")
    of_year = F.substring("numero_cnj", 12, 4).cast("int") == year
    return fresh.withColumn("avisa", of_year if first_run else F.lit(True))


def known_cases(cases: DataFrame, occurrences: DataFrame, tenant: int) -> DataFrame:
    """Cases in which one tenant has an occurrence."""
    return cases.join(occurrences.where(F.col("cliente_id") == tenant).select(F.col("processo_id").alias("id")), "id", "left_semi")


def term_tasks(rules: DataFrame, courts: DataFrame, cursors: DataFrame, back_days: int = 30) -> DataFrame:
    """(regra_id, tribunal, desde, cursor): each rule at its court, or at all; courts are a fixed list of some ninety."""
    wanted = F.broadcast(courts.select("tribunal"))
    tasks = rules.join(wanted, rules["tribunal_sigla"].isNull() | (rules["tribunal_sigla"] == wanted["tribunal"]))
    return tasks.join(cursors, ["regra_id", "tribunal"], "left").select("regra_id", "tribunal", F.date_sub(F.to_date("criado_em"), back_days).alias("desde"), "cursor")


#: Rows of one key and stretch of time that a task of the as-of join has, about.
STRETCH = 100_000


def effective_units(units: DataFrame, on: DataFrame, key: list[str], stretch: int = STRETCH) -> DataFrame:
    """``on`` (key, dia) with the unit in force that day: the latest vigente_desde not after it.

    An as-of join by union and a running last value, over stretches of each
    key's time: stretches are quantiles of a key's days, as many as its rows
    call for, so that a key with most of all rows is spread over many tasks; a
    unit in force where stretches begin is carried into each of them. Of units
    that begin on one day the last by name is in force; without key or day no unit is.
    """
    days = lambda c: F.unix_date(F.to_date(c))
    n = on.groupBy(*key).agg(F.count("*").alias("n_"), F.percentile_approx(days("dia"), [i / 256 for i in range(1, 256)], 1_000).alias("q_"))
    parts = F.least(F.ceil(F.col("n_") / stretch), F.lit(256)).cast("int")
    # Every 256 / parts-th of the quantiles is a cut; cuts that fall on one day are one.
    cuts = n.select(*key, F.array_distinct(F.filter("q_", lambda q, i: F.floor((i + 1) * parts / 256) > F.floor(i * parts / 256))).alias("cuts_"))
    of = lambda day: F.size(F.filter("cuts_", lambda c: c <= day)).alias("stretch_")
    others = [c for c in on.columns if c not in key]
    keyed = on.join(cuts.withColumnsRenamed({c: f"{c}_k" for c in key}), [F.col(c) == F.col(f"{c}_k") for c in key], "left")
    b = keyed.select(*key, F.coalesce(of(days(F.col("dia"))), F.lit(0)).alias("stretch_"), F.col("dia").alias("t_"), F.struct(*others).alias("q_"))
    one = units.groupBy(*key, "vigente_desde").agg(F.max("unidade").alias("unidade")).join(cuts, key)
    placed = one.select(*key, of(days(F.col("vigente_desde"))), F.col("vigente_desde").alias("t_"), F.struct("unidade", "vigente_desde").alias("u_"), "cuts_")
    # What each stretch ends with is carried into the next ones, up to the next that has a unit of its own.
    last = placed.groupBy(*key, "stretch_").agg(F.max_by("u_", "t_").alias("u_"), F.size(F.first("cuts_")).alias("to_"))
    nxt = F.coalesce(F.lead("stretch_").over(Window.partitionBy(*key).orderBy("stretch_")), F.col("to_"))
    carried = last.withColumn("next_", nxt).where("next_ > stretch_").select(*key, F.explode(F.sequence(F.col("stretch_") + 1, "next_")).alias("stretch_"), F.lit(None).cast("date").alias("t_"), "u_")
    a = placed.select(*key, "stretch_", "t_", "u_").union(carried).withColumn("side_", F.lit(0))
    both = a.withColumn("q_", F.lit(None).cast(b.schema["q_"].dataType)).unionByName(b.withColumns({"u_": F.lit(None).cast(a.schema["u_"].dataType), "side_": F.lit(1)}))
    w = Window.partitionBy(*key, "stretch_").orderBy("t_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    in_force = F.when(F.col("t_").isNotNull(), F.last("u_", ignorenulls=True).over(w))
    return both.withColumn("in_", in_force).where("side_ = 1").select(*key, "q_.*", F.col("in_.unidade").alias("unidade"), F.col("in_.vigente_desde").alias("vigente_desde"))
