"""Matching as cases, targets and rules arrive, each in a stream of its own.

What was seen is kept in keyed tables. A batch of cases is matched against all
targets and rules known, a batch of targets or rules against all cases known.
A batch commits its own rows before it reads the other side: of two batches that
run at the same time one at least sees the other, so no pair is missed; a pair
that both find is merged into one occurrence. Alerts follow from the batch that an
occurrence was made by, which is stored with it: a batch that broke off after any
of its steps is run again and goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, scoring
from ..sources.keyed import KeyedTable, latest
from ..sources.sinks import Outbox

CASES = (
    "id long, segredo boolean, classe_codigo long, classe_nome string, assuntos array<long>, comarca string, valor_causa_centavos long, capa string, "
    "partes array<struct<polo:string,nome_normalizado:string,documento:string>>, consultados array<string>, atualizado long"
)
TARGETS = "alvo_id long, cliente_id long, tipo string, valor string, variacoes array<string>, prioridade string, ativo boolean, atualizado long"
RULES = "regra_id long, cliente_id long, classes array<long>, assuntos array<long>, comarcas array<string>, termos array<string>, valor_min_centavos long, polo string, ativo boolean, atualizado long"
OCCURRENCES = "processo_id long, tipo string, ref long, cliente_id long, polo string, confianca string, criterio string, score long, modalidade string, lote string, dia string"
KEY = ["processo_id", "tipo", "ref", "cliente_id"]


def target_matches(cases: DataFrame, targets: DataFrame) -> DataFrame:
    """The best match of each case and target: by documents on the cover, by names, by documents that a court's search was for."""
    parties = cases.select(F.col("id").alias("processo_id"), "segredo", F.explode("partes").alias("p")).select("processo_id", "segredo", "p.*")
    searched = cases.select(F.col("id").alias("processo_id"), "segredo", F.explode(F.array_distinct("consultados")).alias("documento"))
    documents = targets.where("tipo = 'documento'")
    own = F.when(F.col("tipo") == "nome", F.array("valor")).otherwise(F.array().cast("array<string>"))
    names = targets.where("tipo <> 'oab'").select("alvo_id", "cliente_id", "tipo", "ativo", F.explode(F.array_distinct(F.concat(own, F.coalesce("variacoes", F.array().cast("array<string>"))))).alias("nome"))
    # What is matched twice by name is one row in the groups below.
    found = matching.match_by_document(parties, documents).unionByName(matching.name_matches(parties, names).drop("again_"))
    asked = matching.matchable(searched).join(matching.matchable(documents), F.col("documento") == F.col("valor"))
    found = found.unionByName(asked.select("processo_id", "alvo_id", "cliente_id", F.lit(None).cast("string").alias("polo"), F.lit("confirmada").alias("confianca"), F.lit("busca_documento").alias("criterio")))
    # A search's match has the side of the best match by name, which is in the same group: the names are compared once.
    place = F.struct(matching.rank(F.col("confianca"), matching.CONFIDENCES).alias("a"), matching.rank(F.col("criterio"), matching.CRITERIA).alias("b"), matching.rank(F.col("polo"), matching.SIDES).alias("c"))
    named = F.min_by(F.when(F.col("criterio") == "nome", F.col("polo")), F.when(F.col("criterio") == "nome", matching.rank(F.col("polo"), matching.SIDES)))
    best = found.groupBy("processo_id", "alvo_id", "cliente_id").agg(F.min_by(F.struct("polo", "confianca", "criterio"), place).alias("x"), named.alias("named"))
    side = F.when(F.col("x.criterio") == "busca_documento", F.col("named")).otherwise(F.col("x.polo"))
    return best.select("processo_id", "alvo_id", "cliente_id", side.alias("polo"), "x.confianca", "x.criterio")


def scored(found: DataFrame, cases: DataFrame, targets: DataFrame, clients: DataFrame) -> DataFrame:
    """``found`` (KEY, polo, confianca, criterio) with score and modalidade by its client's own weights, thresholds and limit of value.

    ``clients``: cliente_id, config_alertas (JSON). A client without a limit
    gets no points for value, one that isn't there the defaults.
    """
    facts = cases.select(F.col("id").alias("processo_id"), "valor_causa_centavos", "classe_nome")
    critical = targets.select(F.lit("alvo").alias("tipo"), F.col("alvo_id").alias("ref"), (F.col("prioridade") == "critica").alias("critica_"))
    config = clients.select("cliente_id", scoring.load_alert_config(F.col("config_alertas")).alias("config_"))
    j = found.join(facts, "processo_id").join(critical, ["tipo", "ref"], "left").join(config, "cliente_id", "left")
    j = j.withColumn("config_", F.coalesce("config_", scoring.default_config()))
    limit = F.col("config_.limite_valor_centavos")
    factors = {"polo_passivo": F.col("polo") == "passivo", "valor_acima_limite": F.col("valor_causa_centavos") > limit, "rito_rapido": scoring.is_fast_track_class(F.col("classe_nome")), "prioridade_critica": F.col("critica_")}
    score = scoring.urgency_score(factors, F.col("config_"))
    return j.withColumn("score", score).withColumn("modalidade", scoring.alert_mode(F.col("score"), F.col("config_"))).select(*found.columns, "score", "modalidade")


class MatchStreams:
    """State and steps of the three streams, under ``path``. ``clients``: cliente_id, config_alertas, emails, whatsapp."""

    def __init__(self, spark: SparkSession, path: str, clients: DataFrame, parts: int = 32) -> None:
        self.spark, self.clients = spark, clients
        self.cases, self.targets, self.rules = (KeyedTable(spark, f"{path}/{n}", [k], parts) for n, k in (("cases", "id"), ("targets", "alvo_id"), ("rules", "regra_id")))
        self.occurrences = KeyedTable(spark, f"{path}/occurrences", ["processo_id"], parts)
        self.outbox = Outbox(spark, f"{path}/outbox")

    def _all(self, table: KeyedTable, ddl: str) -> DataFrame:
        return table.read(self.spark.createDataFrame([], ddl).schema)

    def add_cases(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch, as the other two: cases in the form of CASES, a later ``atualizado`` replacing an earlier one."""
        self.cases.merge(batch, latest(["id"], "atualizado"), "cases", batch_id)
        new, targets = self._current(self.cases, CASES, "cases", batch, "id"), self._all(self.targets, TARGETS)
        self._record("cases", batch_id, new, targets, lambda found: (new, self._all(self.rules, RULES)))

    def add_targets(self, batch: DataFrame, batch_id: int) -> None:
        """Also asks rules with a side of the cases in which a new target stands on one."""
        self.targets.merge(batch, latest(["alvo_id"], "atualizado"), "targets", batch_id)
        new, cases = self._current(self.targets, TARGETS, "targets", batch, "alvo_id"), self._all(self.cases, CASES)
        touched = lambda found: cases.join(found.select(F.col("processo_id").alias("id")).distinct(), "id", "left_semi")
        self._record("targets", batch_id, cases, new, lambda found: (touched(found), self._all(self.rules, RULES).where("polo is not null")))

    def add_rules(self, batch: DataFrame, batch_id: int) -> None:
        self.rules.merge(batch, latest(["regra_id"], "atualizado"), "rules", batch_id)
        cases, new = self._all(self.cases, CASES), self._current(self.rules, RULES, "rules", batch, "regra_id")
        self._record("rules", batch_id, cases, None, lambda found: (cases, new))

    def _current(self, table: KeyedTable, ddl: str, writer: str, batch: DataFrame, key: str) -> DataFrame:
        """The rows of a batch as they stand in the table: what another batch updated isn't matched in its old form."""
        schema = self.spark.createDataFrame([], ddl).schema
        return table.read_touched(writer, schema).join(batch.select(key).distinct(), key, "left_semi")

    def _of_rules(self, cases: DataFrame, rules: DataFrame, found: DataFrame) -> DataFrame:
        """Occurrences of rules; sides are those of targets' matches, found now or before."""
        side = ["processo_id", "cliente_id", "polo", "confianca"]
        known = self._all(self.occurrences, OCCURRENCES).where("tipo = 'alvo'").select(*side)
        m = matching.match_rules(cases, rules, known.unionByName(found.select(*side)).where("polo is not null"))
        m = m.join(rules.select("regra_id", F.nullif(F.col("polo"), F.lit("")).alias("polo")), "regra_id")
        return m.select("processo_id", F.lit("regra").alias("tipo"), F.col("regra_id").alias("ref"), "cliente_id", "polo", "confianca", F.lit("regra").alias("criterio"))

    def _record(self, writer: str, batch_id: int, cases: DataFrame, targets: DataFrame | None, asked) -> None:
        """Merge what a batch finds into the occurrences, then its alerts into the outbox.

        ``targets`` are matched against ``cases``; ``asked`` gives, from what
        that found, the cases and rules to match. New occurrences bear the
        batch and the day they were made on.
        """
        schema = self.spark.createDataFrame([], OCCURRENCES).schema
        if not self.occurrences.is_done(writer, batch_id):
            kept = ["processo_id", "tipo", "ref", "cliente_id", "polo", "confianca", "criterio"]
            if targets is None:
                found = self.spark.createDataFrame([], schema).select(*kept)
            else:
                found = target_matches(cases, targets).withColumns({"tipo": F.lit("alvo"), "ref": F.col("alvo_id")}).select(*kept).persist()
            both = found.unionByName(self._of_rules(*asked(found), found))
            rows = scored(both, cases, self._all(self.targets, TARGETS), self.clients)
            rows = rows.withColumns({"lote": F.lit(f"{writer}-{batch_id}"), "dia": F.date_format(F.current_date(), "yyyy-MM-dd")})
            as_stored = lambda df: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
            self.occurrences.merge(as_stored(rows), lambda old, new: as_stored(matching.merge_occurrences(old, new, KEY, ("score", "modalidade", "lote", "dia"))), writer, batch_id)
            found.unpersist()
        made = self.occurrences.read_touched(writer, schema).where(F.col("lote") == f"{writer}-{batch_id}")
        named = made.withColumn("ocorrencia", F.concat_ws("/", "processo_id", "tipo", "ref")).withColumn("criada", F.lit(True))
        alerts = scoring.fan_out_alerts(named, self.clients).join(named.select("ocorrencia", F.to_date("dia").alias("dia")), "ocorrencia")
        self.outbox.write(alerts, writer, batch_id)
