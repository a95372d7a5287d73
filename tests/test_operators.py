"""Operators on small tables made by hand."""

import datetime as dt
import json

from pyspark.sql import functions as F

from casewatch.operators import anonymize, entities, matching, monitoring, normalize, scoring, subscriptions
from casewatch.sources import feeds, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_publication_feed(spark):
    item = {"id": 7, "data_disponibilizacao": "2024-01-02", "texto": " t ", "destinatarios": [{"nome": "A", "polo": "A"}, {"nome": "B", "polo": "Z"}], "destinatarioadvogados": [{"advogado": {"nome": "L", "numero_oab": "1", "uf_oab": "sp"}}] * 2}
    bodies = [json.dumps({"items": [item]}), json.dumps([{"hash": "h", "conteudo": "x"}]), json.dumps({"items": [{"texto": "no id"}, {"id": 1}]}), json.dumps({"other": 1}), "not json"]
    out = feeds.flatten_publications(feeds.publication_items(spark.createDataFrame([(b,) for b in bodies], "value string"), F.col("value"))).collect()
    by = {r.id_externo: r for r in out}
    assert set(by) == {"7", "h"}
    assert [tuple(p) for p in by["7"].destinatarios] == [("A", "ativo"), ("B", "desconhecido")] and len(by["7"].advogados) == 1 and by["7"].texto == "t"


def test_case_feed(spark):
    hit = lambda n, g, subjects: {"_source": {"numeroProcesso": n, "grau": g, "classe": {"codigo": 7, "nome": "C"}, "assuntos": subjects}}
    body = json.dumps({"hits": {"hits": [hit("10001233520248260100", "G2", [{"codigo": 1, "nome": "a"}]), hit("10001233520248260100", "G1", [[{"codigo": 1, "nome": "a"}, {"codigo": "x", "nome": "b"}], [{"codigo": 1, "nome": "a"}]]), hit("1", "G1", [])]}})
    flat = feeds.flatten_case_metadata(feeds.case_hits(spark.createDataFrame([(body,), ("{}",)], "value string"), F.col("value")))
    best = feeds.best_instance(flat).collect()
    assert len(best) == 1 and best[0].grau == "G1" and [tuple(a) for a in best[0].assuntos] == [(1, "a"), (None, "b")]


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿1116;Execução Fiscal\n;x\n40;Monitória\n", encoding="utf-8")
    assert rows(feeds.read_tpu_catalog(spark, str(tmp_path / "c.csv"), ";")) == [(40, "Monitória"), (1116, "Execução Fiscal")]
    at = tmp_path / "raw/2024/01/02/lot1"
    at.mkdir(parents=True)
    (at / "001.html").write_text("<html>x</html>")
    r = feeds.read_raw_pages(spark, str(tmp_path / "raw")).collect()[0]
    assert (r.day, r.lot, r.page) == (dt.date(2024, 1, 2), "lot1", 1)
    other = tmp_path / "raw/2024/01/03/lot2"
    other.mkdir(parents=True)
    (other / "002.html").write_text("<html>y</html>")
    days = [dt.date(2024, 1, 3), dt.date(2024, 1, 4)]
    assert [(r.lot, r.page) for r in feeds.read_raw_pages(spark, str(tmp_path / "raw"), days).collect()] == [("lot2", 2)]
    assert feeds.read_raw_pages(spark, str(tmp_path / "raw"), days[1:]).count() == 0
    feeds.pack_raw_pages(feeds.read_raw_pages(spark, str(tmp_path / "raw")), str(tmp_path / "packed"))
    packed = feeds.read_packed_pages(spark, str(tmp_path / "packed"), days[0], days[1])
    assert [(r.lot, r.html) for r in packed.collect()] == [("lot2", "<html>y</html>")] and len(packed.inputFiles()) == 2
    assert "PartitionFilters: [isnotnull(day" in packed._jdf.queryExecution().executedPlan().toString()


def test_tpu_ambiguous_is_null(spark):
    catalog = spark.createDataFrame([(1, "Assunto Repetido"), (2, "ASSUNTO repetido"), (3, "Único")], "codigo long, nome string")
    cases = spark.createDataFrame([("assunto repetido",), ("unico",), ("outro",), (None,)], "n string")
    assert {r.n: r.c for r in normalize.tpu_enrich(cases, "n", catalog, "c").collect()} == {"assunto repetido": None, "unico": 3, "outro": None, None: None}


def test_case_page(spark):
    html = """<html><span id="numeroProcesso">1000123-35.2024.8.26.0100</span><div id="classeProcesso"> Execução <b>Fiscal</b></div>
    <table id="tableTodasPartes"><tr><td>Exeqte:</td><td>Município<br>Advogado: X</td></tr><tr><td>Exectdo:</td><td>Fulano</td></tr></table></html>"""
    pages = spark.createDataFrame([("a", html), ("b", "<p>captcha</p>"), ("c", None), ("d", "<p>segredo de justiça</p>")], "path string, html string")
    assert {r.path: r.kind for r in normalize.classify_pages(pages, F.col("html")).collect()} == {"a": "capa", "b": "captcha", "c": "desconhecida", "d": "sigilo"}
    out = normalize.extract_case_pages(pages).collect()
    assert len(out) == 1 and out[0].classe == "Execução Fiscal" and [tuple(p) for p in out[0].partes] == [("Exeqte:", "Município", ["X"], "ativo"), ("Exectdo:", "Fulano", [], "passivo")]
    listing = """<div id="listagemDeProcessos"><h2 class="foroDosProcessos">Foro <b>Central</b></h2><ul><li><a href="x">1000123-35.2024.8.26.0100</a> de 1000123-35.2024.8.26.0100</li></ul>
    <h2>Foro de Santos</h2><ul><li>2000123-35.2024.8.26.0562</li></ul></div>1111111-11.2024.8.26.0100"""
    found = normalize.extract_list_pages(spark.createDataFrame([("l", listing), ("m", "<p>captcha</p>")], "path string, html string"))
    assert rows(found) == [("l", "Foro Central", "1000123-35.2024.8.26.0100"), ("l", "Foro de Santos", "2000123-35.2024.8.26.0562")]


def test_upsert_keeps_first_seen_and_is_idempotent(spark):
    old = spark.createDataFrame([("n1", "a", dt.date(2024, 1, 1))], "numero_cnj string, v string, primeira_coleta_em date")
    new = spark.createDataFrame([("n1", "b", dt.date(2024, 2, 1)), ("n2", "c", dt.date(2024, 2, 1))], old.schema)
    once = entities.upsert_cases(old, new)
    assert rows(once) == [("n1", "b", dt.date(2024, 1, 1), False), ("n2", "c", dt.date(2024, 2, 1), True)]
    again = entities.upsert_cases(once.drop("novo").select(*old.columns), new)
    assert rows(again.drop("novo")) == rows(once.drop("novo"))


def test_names_link_to_one_active_person_only(spark):
    people = spark.createDataFrame([(1, "MARIA DA SILVA"), (2, "JOSE SOUZA"), (3, "JOSE SOUZA")], "pessoa_id long, nome_normalizado string")
    active = spark.createDataFrame([(1, "SAO PAULO"), (2, "SAO PAULO")], "pessoa_id long, comarca string")
    asked = spark.createDataFrame([("MARIA DA SILVA", "SAO PAULO"), ("MARIA DA SILVA", "SANTOS"), ("JOSE SOUZA", "SAO PAULO"), ("NOVO", None)], "nome_normalizado string, comarca string")
    out = {(r.nome_normalizado, r.comarca): (r.pessoa_id, r.nova) for r in entities.resolve_by_name(asked, people, active).collect()}
    assert out[("MARIA DA SILVA", "SAO PAULO")] == (1, False)
    assert out[("MARIA DA SILVA", "SANTOS")][1] and out[("JOSE SOUZA", "SAO PAULO")][1] and out[("NOVO", None)][1]


def test_rule_without_filter_matches_nothing_and_side_needs_target(spark):
    cases = spark.createDataFrame([(1, 7, [5], "SAO PAULO", 100, "COMUM COBRANCA"), (2, None, [], None, None, "")], "id long, classe_codigo long, assuntos array<long>, comarca string, valor_causa_centavos long, capa string")
    rules = [(1, 1, None, None, None, None, None, None), (2, 1, [7], [5, 6], ["Comarca de São Paulo"], ["cobrança"], 100, None), (3, 1, None, None, None, None, 101, None), (4, 1, None, None, None, None, None, "passivo"), (5, 2, None, None, None, None, None, "passivo"), (6, 1, [], None, None, ["cobra"], None, None)]
    rules = spark.createDataFrame(rules, "regra_id long, cliente_id long, classes array<long>, assuntos array<long>, comarcas array<string>, termos array<string>, valor_min_centavos long, polo string")
    sides = spark.createDataFrame([(1, 1, "passivo", "a_verificar")], "processo_id long, cliente_id long, polo string, confianca string")
    assert rows(matching.match_rules(cases, rules, sides).select("processo_id", "regra_id", "confianca")) == [(1, 2, "confirmada"), (1, 4, "a_verificar")]


def test_sealed_cases_and_inactive_targets_never_match(spark):
    parties = spark.createDataFrame([(1, "d1", "ANA LUZ SA", "passivo", False), (2, "d1", "ANA LUZ SA", "passivo", True), (3, "d2", "JOSE SOUZA", "ativo", None)], "processo_id long, documento string, nome_normalizado string, polo string, segredo boolean")
    targets = spark.createDataFrame([(10, 1, "d1", "nome", "ANA LUZ SA", True), (11, 1, "d1", "nome", "ANA LUZ SA", False), (12, 1, "d2", "nome", "JOSE SOUZA", None)], "alvo_id long, cliente_id long, valor string, tipo string, nome string, ativo boolean")
    found = matching.match_by_document(parties, targets)
    assert rows(found.select("processo_id", "alvo_id")) == [(1, 10), (3, 12)]
    assert rows(matching.match_by_name(parties, targets).select("processo_id", "alvo_id")) == [(1, 10), (3, 12)]
    assert rows(matching.match_by_searched_document(parties, targets, found.where("false"), found).select("processo_id", "alvo_id")) == [(1, 10), (3, 12)]
    cases = spark.createDataFrame([(1, 7, False), (2, 7, True)], "id long, classe_codigo long, segredo boolean").selectExpr(
        "*", "array(1L) assuntos", "'X' comarca", "1L valor_causa_centavos", "'COMUM' capa", "'Comum' classe_nome", "array('a') assunto_nomes", "'TJSP' tribunal"
    )
    rules = spark.createDataFrame([(1, True), (2, False)], "regra_id long, ativo boolean").selectExpr(
        "*", "1L cliente_id", "array(7L) classes", "array(1L) assuntos", "cast(null as array<string>) comarcas", "cast(null as array<string>) termos", "0L valor_min_centavos", "cast(null as string) polo", "'acao' tipo_termo", "'comum' texto_termo", "'TJSP' tribunal_sigla"
    )
    assert rows(matching.match_rules(cases, rules, found.where("false")).select("processo_id", "regra_id")) == [(1, 1)]
    assert rows(matching.match_terms(cases, rules)) == [(1, 1)]


def test_promotion_is_not_creation(spark):
    s = "processo_id long, alvo_id long, polo string, confianca string, criterio string"
    old = spark.createDataFrame([(1, 1, None, "a_verificar", "nome"), (2, 1, "ativo", "confirmada", "documento")], s)
    new = spark.createDataFrame([(1, 1, "passivo", "confirmada", "documento"), (2, 1, "passivo", "a_verificar", "nome"), (3, 1, None, "a_verificar", "nome")], s)
    assert rows(matching.merge_occurrences(old, new, ["processo_id", "alvo_id"]).where("processo_id < 3")) == [(1, 1, "passivo", "confirmada", "documento", False, True), (2, 1, "ativo", "confirmada", "documento", False, False)]


def test_scores(spark):
    t, f = F.lit(True), F.lit(False)
    some = {"polo_passivo": t, "valor_acima_limite": t, "rito_rapido": t, "prioridade_critica": t}
    r = spark.range(1).select(scoring.urgency_score({"polo_passivo": t, "prioridade_critica": t}), scoring.urgency_score(some), scoring.urgency_score(some | {"tutela_urgencia": t}), scoring.urgency_score({"polo_passivo": f}), scoring.alert_mode(F.lit(30)), scoring.alert_mode(F.lit(60)), scoring.alert_mode(F.lit(29))).first()
    assert tuple(r) == (30, 60, 100, 0, "email_imediato", "todos_canais", "resumo_diario")
    bad = ["{bad", '{"x": 1}', '{"limiar_todos_canais": 101}', '{"pesos": {"polo_passivo": "a"}}', '{"pesos": {"y": 1}, "limiar_todos_canais": 70}', None, "{}"]
    out = spark.createDataFrame([(b,) for b in bad], "c string").select(scoring.load_alert_config(F.col("c")).alias("c")).select("c.*").distinct().collect()
    assert [tuple(x) for x in out] == [(40, 20, 15, 15, 10, None, 60, 30)]


def test_alarm_boundaries(spark):
    day = dt.datetime(2024, 1, 15, 12)
    runs = spark.createDataFrame([(1, day, 20, 9), (2, day, 20, 2), (3, day, 9, 9), (4, day, 10, 1), (5, day - dt.timedelta(hours=2), 20, 20)], "tribunal long, ts timestamp, consultas int, erros int")
    out = {r.tribunal: r.abre for r in monitoring.error_rate(runs, F.lit("2024-01-15 11:30:00").cast("timestamp"), F.lit("2024-01-15 12:30:00").cast("timestamp")).collect()}
    assert out == {1: True, 2: False, 3: None, 4: False}


def test_low_volume_needs_history(spark):
    at = lambda d: dt.datetime(2024, 1, d, 12)
    data = [(1, at(d), 10) for d in range(1, 11)] + [(1, at(11), 4)] + [(2, at(d), 10) for d in range(1, 11)] + [(2, at(11), 5)] + [(3, at(d), 10) for d in range(5, 11)] + [(3, at(11), 0)] + [(4, at(d), 2) for d in range(1, 11)] + [(4, at(11), 0)]
    out = {r.tribunal: r.abre for r in monitoring.low_volume(spark.createDataFrame(data, "tribunal long, ts timestamp, novos int")).where("dia = date'2024-01-11'").collect()}
    assert out == {1: True, 2: False, 3: None, 4: None}


def test_rate_limit_counts_permitted_attempts_only(spark):
    start = dt.datetime(2024, 1, 1)
    seconds = [0, 10, 20, 30, 61, 62, 71]
    df = spark.createDataFrame([("a", "k", start + dt.timedelta(seconds=s), i) for i, s in enumerate(seconds)], "acao string, chave string, ts timestamp, id long")
    out = [r.permitida for r in monitoring.rate_limit_attempts(df, 2, 60).orderBy("id").collect()]
    kept, want = [], []
    for s in seconds:
        ok = sum(t > s - 60 for t in kept) < 2
        kept += [s] if ok else []
        want.append(ok)
    assert out == want


def test_monthly_limit_admits_the_first(spark):
    a = spark.createDataFrame([("t", i) for i in range(500)] + [("u", i) for i in range(5)] + [("v", 1)], "termo string, n long")
    used = spark.createDataFrame([("t", 3, 10), ("u", 9, 9), ("v", None, None)], "termo string, usados int, limite int")
    assert rows(scoring.monthly_term_limit(a, used, ["n"])) == [("t", i) for i in range(7)] + [("v", 1)]


def test_payments_apply_once_in_order(spark):
    d = dt.date
    pay = spark.createDataFrame([(1, 10, d(2024, 1, 31), 1), (1, 10, d(2024, 1, 31), 1), (1, 11, d(2024, 2, 1), 12)], "assinatura long, pagamento long, pago_em date, meses int")
    subs = spark.createDataFrame([(1, None), (2, d(2024, 5, 5))], "assinatura long, vigente_ate date")
    assert rows(subscriptions.apply_payments(pay, subs)) == [(1, d(2025, 2, 28), 2), (2, d(2024, 5, 5), 0)]


def test_anonymised_batch_leaves_no_name(spark):
    pages = spark.createDataFrame([(1, "ACME Comércio Ltda e Acme"), (2, "ação de ACME COMÉRCIO LTDA.")], "id long, texto string")
    names = spark.createDataFrame([(1, "Acme Comércio Ltda"), (1, "Acme"), (2, "Acme Comércio Ltda")], "id long, nome string")
    out = {r.id: (r.texto, r.sobrou) for r in anonymize.anonymize_names(pages, names).collect()}
    assert out == {1: ("Pessoa 1-2 Ltda e Pessoa 1-1", False), 2: ("ação de Pessoa 1-2 Ltda.", False)}


def test_names_of_other_pages_are_anonymised_too(spark):
    pages = spark.createDataFrame([(1, "Jane Smith, autora"), (2, "ouvida JANE SMITH e Acme"), (3, "a Jane-Smith, de Maria Clara de Souza e Silva Neto"), (4, "Maria Clara de Souza")], "id long, texto string")
    names = spark.createDataFrame([(1, "Jane Smith"), (1, "Maria Clara de Souza e Silva Neto"), (2, "Acme")], "id long, nome string")
    out = {r.id: (r.texto, r.sobrou) for r in anonymize.anonymize_names(pages, names).collect()}
    assert out[1] == ("Pessoa 1-1, autora", False) and out[2] == ("ouvida Pessoa 1-1 e Pessoa 2-1", False)
    assert out[3] == ("a Pessoa 1-1, de Pessoa 1-2", False) and out[4] == ("Maria Clara de Souza", False)


def test_tenant_filter(spark):
    df = spark.createDataFrame([(1, 1, "x"), (2, 2, "x")], "id long, cliente_id long, status string")
    assert rows(normalize.filter_rows(df, 1)) == [(1, 1, "x")]

