"""Tables of whole commits, the outbox and the streams over several batches, with restarts, repeats and broken-off batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casewatch.sources.keyed import FOLDERS, KeyedTable, latest
from casewatch.sources.sinks import Outbox
from casewatch.streaming import jobs, matches

DDL = "k long, t long, v string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_touches_its_parts_alone_and_once(spark, tmp_path):
    table, combine = KeyedTable(spark, str(tmp_path / "t"), ["k"], parts=16), latest(["k"], "t")
    assert table.merge(spark.createDataFrame([(k, 5, "a") for k in range(200)], DDL), combine, "w", 0)
    before = table.manifest()["parts"]
    assert len(before) == 16
    assert table.merge(spark.createDataFrame([(7, 9, "new"), (7, 8, "less new"), (8, 1, "too old")], DDL), combine, "w", 1)
    after = table.manifest()["parts"]
    assert 1 <= sum(after[p] != before[p] for p in before) <= 2
    got = {r.k: (r.t, r.v) for r in table.read().collect()}
    assert len(got) == 200 and got[7] == (9, "new") and got[8] == (5, "a")
    # A batch that is told again changes nothing, whatever it holds.
    assert not table.merge(spark.createDataFrame([(7, 99, "again")], DDL), combine, "w", 1)
    assert table.merge(spark.createDataFrame([], DDL), combine, "w", 2) and table.read().count() == 200
    # Only what the last two versions name is left on disk.
    for n in range(3, 7):
        table.merge(spark.createDataFrame([(7, 10 + n, str(n))], DDL), combine, "w", n)
    part = next(p for p in after if after[p] != table.manifest()["parts"][p])
    assert len(list((tmp_path / "t/data").glob(f"*/part_={part}"))) == 2 and len(table.versions()) == 2


def test_a_large_part_is_written_by_several_tasks(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], parts=1)
    big = spark.range(200_000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("t"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    assert table.merge(big, latest(["k"], "t"), "w", 0)
    assert len(list((tmp_path / "t/data").glob("*/part_=0/*.parquet"))) > 1
    assert table.read().count() == 200_000 == table.read().distinct().count()


def test_half_written_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    table, combine = KeyedTable(spark, str(tmp_path / "t"), ["k"], parts=2), latest(["k"], "t")
    table.merge(spark.createDataFrame([(1, 1, "a")], DDL), combine, "w", 0)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_put", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.merge(spark.createDataFrame([(1, 2, "b"), (2, 2, "b")], DDL), combine, "w", 1)
    assert rows(table.read()) == [(1, 1, "a")]
    assert table.merge(spark.createDataFrame([(1, 2, "b"), (2, 2, "b")], DDL), combine, "w", 1)
    assert rows(table.read()) == [(1, 2, "b"), (2, 2, "b")]


def test_two_writers(spark, tmp_path, monkeypatch):
    """Another writer commits to the same part after this one has read it: this one looks again."""
    path, combine = str(tmp_path / "t"), latest(["k"], "t")
    mine, other = KeyedTable(spark, path, ["k"], parts=1), KeyedTable(spark, path, ["k"], parts=1)
    put, turn = KeyedTable._put, []

    def late(self, manifest):
        if self is mine and not turn:
            turn.append(1)
            other.merge(spark.createDataFrame([(1, 5, "other"), (3, 1, "other")], DDL), combine, "other", 0)
        return put(self, manifest)

    monkeypatch.setattr(KeyedTable, "_put", late)
    assert mine.merge(spark.createDataFrame([(1, 2, "mine"), (2, 2, "mine")], DDL), combine, "mine", 0)
    assert rows(mine.read()) == [(1, 5, "other"), (2, 2, "mine"), (3, 1, "other")]
    assert mine.manifest()["writers"] == {"mine": 0, "other": 0}


ALERTS = "ocorrencia string, canal string, destino string, envio string, dia date"


def test_outbox(spark, tmp_path, monkeypatch):
    box, day = Outbox(spark, str(tmp_path / "o")), lambda n: dt.date(2024, 1, n)
    first = spark.createDataFrame([("o1", "email", "a", "x", day(1)), ("o1", "email", "a", "y", day(1)), ("o2", "email", "b", "x", day(2))], ALERTS)
    assert box.write(first, "w", 0) and not box.write(first, "w", 0)
    # Another writer with the same alerts adds none of them, and reads the days of its own alerts alone.
    read = []
    plain = KeyedTable._read
    monkeypatch.setattr(KeyedTable, "_read", lambda self, m, parts, schema: read.append(parts) or plain(self, m, parts, schema))
    assert box.write(spark.createDataFrame([("o2", "email", "b", "z", day(2)), ("o2", "sms", "b", "z", day(2))], ALERTS), "v", 0)
    assert read == [["2024-01-02"]]
    assert rows(box.read().select("ocorrencia", "canal", "destino", "envio")) == [("o1", "email", "a", "x"), ("o2", "email", "b", "x"), ("o2", "sms", "b", "z")]
    for n in range(1, FOLDERS + 2):
        box.write(spark.createDataFrame([(f"p{n}", "email", "a", "x", day(2))], ALERTS), "w", n)
    assert box.read().count() == 3 + FOLDERS + 1 and len(box.table.manifest()["parts"]["2024-01-02"]) < FOLDERS


def documents(spark):
    name = lambda k: ["ACME COMERCIO DE PECAS", "ACME COMERCIO DE PECAS SA", "JOAO DA SILVA SAURO", "OUTRA EMPRESA QUALQUER"][k % 4]
    doc = lambda k: None if k % 3 == 0 else f"{k % 4:011d}"
    cases = [(k, k % 11 == 0, 7 + k % 3, "Monitória", [k % 5], "NATION_1", 1000 * k, "MONITORIA COBRANCA", [("passivo" if k % 2 else "ativo", name(k), doc(k))], [f"{k % 4:011d}"] if k % 5 == 0 else [], 1) for k in range(60)]
    targets = [(1, 1, "documento", f"{1:011d}", ["ACME COMERCIO DE PECAS SA"], "critica", True, 1), (2, 2, "nome", "JOAO DA SILVA SAURO", None, "padrao", True, 1), (3, 1, "documento", f"{0:011d}", None, "padrao", True, 1), (4, 2, "documento", f"{3:011d}", None, "padrao", False, 1)]
    rules = [(1, 1, [7], None, None, None, None, None, True, 1), (2, 2, None, None, None, None, None, "ativo", True, 1), (3, 1, None, [2], ["Nation 1"], ["cobrança"], 20_000, "passivo", True, 1), (4, 1, None, None, None, ["cobrança"], None, None, False, 1)]
    clients = spark.createDataFrame([(1, '{"pesos": {"polo_passivo": 70}}', ["A@x.com ", "a@x.com"], ["(11) 99999-8888"]), (2, '{"limite_valor_centavos": 30000}', ["b@x.com"], [])], "cliente_id long, config_alertas string, emails array<string>, whatsapp array<string>")
    return spark.createDataFrame(cases, matches.CASES), spark.createDataFrame(targets, matches.TARGETS), spark.createDataFrame(rules, matches.RULES), clients


def outcome(job):
    alerts = rows(job.outbox.read().select("ocorrencia", "canal", "destino", "envio"))
    return rows(job.occurrences.read().drop("lote", "dia")), alerts


def test_matches_in_batches_equal_those_in_one(spark, tmp_path, monkeypatch):
    cases, targets, rules, clients = documents(spark)
    whole = matches.MatchStreams(spark, str(tmp_path / "a"), clients, parts=2)
    for add, rows_ in ((whole.add_rules, rules), (whole.add_targets, targets), (whole.add_cases, cases)):
        add(rows_, 0)
    want = outcome(whole)
    assert {r[6] for r in want[0]} == {"documento", "busca_documento", "nome", "regra"} and len(want[1]) > 40
    third = lambda n: cases.where(f"id % 3 = {n}")
    job = lambda: matches.MatchStreams(spark, str(tmp_path / "b"), clients, parts=2)  # noqa: E731  each batch as after a restart
    job().add_cases(third(0), 0)
    job().add_targets(targets.where("alvo_id < 3"), 0)
    job().add_rules(rules.where("regra_id <> 3"), 0)
    # This batch breaks off after its occurrences are written; run again, it still sends its alerts.
    with monkeypatch.context() as m:
        m.setattr(Outbox, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            job().add_cases(third(1), 1)
    job().add_cases(third(1), 1)
    job().add_cases(third(1), 1)
    job().add_targets(targets.where("alvo_id >= 3"), 1)
    job().add_rules(rules.where("regra_id = 3"), 1)
    job().add_cases(third(2), 2)
    assert outcome(job()) == want


def payments(day, ids):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    return [(s, 1000 * s + i, at.date(), 1, dt.date(2024, 1, 10), at) for s in (1, 2) for i in ids]


def test_payment_state_stays_flat(spark, tmp_path):
    """Ten batches, each telling the payment before again; ids told long ago are forgotten, none counts twice."""
    ddl, at = "assinatura long, pagamento long, pago_em date, meses int, vigente_ate date, dito_em timestamp", str(tmp_path)
    sizes = []
    for n in range(10):
        spark.createDataFrame(payments(10 * n, [n - 1, n] if n else [n]), ddl).write.mode("append").parquet(f"{at}/in")
        out = jobs.stream_payments(spark.readStream.schema(ddl).parquet(f"{at}/in"), keep_days=25)
        jobs.run_batches(out, f"{at}/state", jobs.appender(at))
        sizes.append(spark.read.format("statestore").option("stateVarName", "contados").load(f"{at}/state").count())
    assert max(sizes) <= 2 * 5 and sizes[-1] <= sizes[5]
    got = rows(jobs.last_of_each(jobs.outputs(out, at), ["assinatura"]))
    assert got == [(1, "2024-11-10", 10), (2, "2024-11-10", 10)]


def test_new_cases_are_forgotten_and_failures_keep_no_state_of_the_well(spark, tmp_path):
    at, ddl = str(tmp_path), "varredura long, numero_cnj string, base boolean, vista_em timestamp"
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    sizes = []
    for n in range(6):
        spark.createDataFrame([(1, "always", n == 0, day(20 * n)), (1, f"only {n}", False, day(20 * n))], ddl).write.mode("append").parquet(f"{at}/in")
        out = jobs.stream_new_cases(spark.readStream.schema(ddl).parquet(f"{at}/in"), keep_days=30)
        jobs.run_batches(out, f"{at}/state", jobs.appender(at), "append")
        sizes.append(spark.read.format("statestore").load(f"{at}/state").count())
    assert max(sizes) <= 4
    assert rows(jobs.outputs(out, at).drop("batch_")) == [(1, "always", False), *[(1, f"only {n}", True) for n in range(6)]]
    runs = spark.createDataFrame([(s, i, day(i), s == 1 or i == 3) for s in (1, 2) for i in range(4)], "sentinela long, id long, ts timestamp, sucesso boolean")
    for stream in jobs.fed(runs, f"{at}/runs", [F.col("id") < 3, F.col("id") == 3]):
        out = jobs.stream_consecutive_failures(stream)
        jobs.run_batches(out, f"{at}/state2", jobs.appender(f"{at}/f"), "append")
    assert rows(jobs.outputs(out, f"{at}/f").drop("batch_")) == [(2, 1, "aberto"), (2, 3, "resolvido")]
    assert spark.read.format("statestore").load(f"{at}/state2").count() == 0


@pytest.mark.parametrize("groups", [1, 5])
def test_new_cases_by_groups_equal_those_by_number(spark, tmp_path, groups):
    """Python is entered once a group: state has a row for each group, whatever the numbers, and each number is told as if it were alone."""
    at, rng, ddl = str(tmp_path), random.Random(groups), "varredura long, numero_cnj string, base boolean, vista_em timestamp"
    day, keep, big = (lambda n: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=n)), 30, 2**53 + 1
    last, want, mark = {}, [], day(-1000)
    for n in range(7):
        batch = [(rng.choice([1, big, None]), rng.choice([None, *map(str, range(40))]), rng.choice([True, False, None]), day(20 * n + rng.randrange(19))) for _ in range(40)]
        spark.createDataFrame(batch, ddl).write.mode("append").parquet(f"{at}/in")
        out = jobs.stream_new_cases(spark.readStream.schema(ddl).parquet(f"{at}/in"), keep_days=keep, groups=groups)
        jobs.run_batches(out, f"{at}/state", jobs.appender(at), "append")
        for k in {r[:2] for r in batch}:
            if k not in last:
                want.append((*k, not any(r[2] for r in batch if r[:2] == k)))
            last[k] = max(last.get(k, mark), mark, *(r[3] for r in batch if r[:2] == k))
        # The batch without rows that follows forgets what is over by then.
        mark = max(mark, max(r[3] for r in batch) - dt.timedelta(days=1))
        last = {k: t for k, t in last.items() if t + dt.timedelta(days=keep) >= mark}
    assert sorted(rows_(jobs.outputs(out, at).drop("batch_")), key=str) == sorted(want, key=str) and len(want) > len({w[:2] for w in want})
    assert spark.read.format("statestore").load(f"{at}/state").count() <= groups


def rows_(df):
    return [tuple(r) for r in df.collect()]
