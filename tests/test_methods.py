"""Methods that have a plain counterpart: similar names, as-of joins by stretches, dense ids, sketches, keeping and anonymising."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casewatch.functions import similarity
from casewatch.operators import anonymize, entities, matching, monitoring, subscriptions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def grams(name):
    return {f"  {w} "[i : i + 3] for w in name.lower().split() for i in range(len(w) + 1)}


@pytest.mark.parametrize("percent", [60, 85, 90])
def test_similar_names(spark, monkeypatch, percent):
    """Every pair that brute force finds, with lists of common trigrams split, and few others compared."""
    monkeypatch.setattr(similarity, "LIST", 5)
    rng = random.Random(percent)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 9)))
    base = [" ".join(["silva", *(word() for _ in range(rng.randrange(1, 5)))]) for _ in range(60)]
    edit = lambda s: s[: (i := rng.randrange(len(s)))] + rng.choice("abc ") + s[i + rng.randrange(2) :]
    left, right = [*base, *map(edit, base)], [*map(edit, base), *base[:20], "abcdefghi"]
    frame = lambda names: spark.createDataFrame([(n,) for n in [*names, None, ""]], "name string")
    want = {(a, b) for a in left for b in right if (x := grams(a)) and (y := grams(b)) and len(x & y) * 100 >= percent * len(x | y)}
    assert set(rows(similarity.similarity_join(frame(left), frame(right), percent))) == want
    near = similarity.candidates(frame(left), frame(right), percent)
    assert near.count() == near.distinct().count() and want <= set(rows(near))
    assert percent < 90 or near.count() < 0.02 * len(left) * len(right)


def test_pairs_that_share_rare_trigrams_alone_are_not_compared(spark):
    """Codes of few digits share trigrams by chance: hardly a pair that isn't similar is left for the comparison of texts."""
    rng = random.Random(3)
    names = sorted({f"customer {rng.randrange(10**9):09d} ltda" for _ in range(700)})
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    near = rows(similarity.candidates(frame, frame, 90))
    want = {(a, b) for a in names for b in names if len((x := grams(a)) & (y := grams(b))) * 100 >= 90 * len(x | y)}
    assert want <= set(near) and len(near) == len(set(near)) <= len(want) + 20


def test_common_names_over_many_tasks(spark, monkeypatch):
    """Copies of a name are expanded from short lists; sides and targets with several alike names are still matched once."""
    monkeypatch.setattr(matching, "CROWD", 10)
    name = lambda i: "ACME COMERCIO DE PECAS E SERVICOS GERAIS" + " X" * (i % 2)
    parties = [(i, "passivo", name(i), None if i % 3 else "1") for i in range(90)] + [(5, "passivo", name(0), None), (6, None, name(1), None), (7, "ativo", None, None)]
    targets = [(i, 1, "documento" if i % 4 == 0 else "nome", name(i)) for i in range(60)] + [(9, 1, "nome", name(0)), (None, None, None, name(1)), (8, 2, "nome", None)]
    out = matching.match_by_name(spark.createDataFrame(parties, "processo_id long, polo string, nome_normalizado string, documento string"), spark.createDataFrame(targets, "alvo_id long, cliente_id long, tipo string, nome string"))
    got = out.withColumn("part", F.spark_partition_id()).collect()
    same = lambda a, b: a and b and len(grams(a) & grams(b)) * 100 >= 90 * len(grams(a) | grams(b))
    want = {(p, a, c, side) for p, side, n, doc in parties for a, c, kind, m in targets if same(n, m) and (doc is None or kind not in (None, "documento"))}
    assert sorted(((r.processo_id, r.alvo_id, r.cliente_id, r.polo) for r in got), key=str) == sorted(want, key=str)
    assert max(collections.Counter(r.part for r in got).values()) < len(got) / 2


def test_prefix_of_eleven_at_ninety(spark):
    sets = spark.createDataFrame([("n", [f"g{i:02d}" for i in range(11)])], "name string, g array<string>")
    often = spark.createDataFrame([(f"g{i:02d}", i) for i in range(11)], "t string, df long")
    assert [r.t for r in similarity._prefixes(sets, often, 90).collect()] == ["g00", "g01"]


def test_units_of_one_key_over_many_stretches(spark):
    rng, day = random.Random(1), lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    units = [("hot", day(n), f"u{n}") for n in (5, 40, 41, 300)] + [("hot", day(41), "u0"), ("cold", day(10), "c"), (None, day(1), "x")]
    on = [(rng.choice(["hot"] * 20 + ["cold", "none", None]), i, rng.choice([None, *map(day, range(-3, 400))])) for i in range(3000)]
    out = matching.effective_units(spark.createDataFrame(units, "k string, vigente_desde date, unidade string"), spark.createDataFrame(on, "k string, id long, dia date"), ["k"], stretch=100)
    in_force = lambda k, d: max(((u[1], u[2]) for u in units if k is not None and u[0] == k and d is not None and u[1] <= d), default=(None, None))
    assert {r.id: (r.vigente_desde, r.unidade) for r in out.collect()} == {i: in_force(k, d) for k, i, d in on}


def test_people_over_two_batches(spark, monkeypatch):
    monkeypatch.setattr(entities, "RANGE", 10)
    people = spark.createDataFrame([(3, "d03"), (7, "d07"), (9, "d07"), (40, None)], "pessoa_id long, documento string")
    party = lambda docs: spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "processo_id long, documento string")
    first = entities.resolve_by_document(party([f"d{k:02d}" for k in range(50)] * 2 + [None]), people)
    ids = {r.documento: (r.pessoa_id, r.nova) for r in first.collect()}
    new = [d for d in sorted(ids) if d not in ("d03", "d07")]
    assert ids["d03"] == (3, False) and ids["d07"] == (7, False) and [ids[d] for d in new] == [(41 + n, True) for n in range(48)]
    state = entities.with_new_people(people, first)
    second = {r.documento: (r.pessoa_id, r.nova) for r in entities.resolve_by_document(party(["d01", "d03", "e00"]), state).collect()}
    assert second == {"d01": (ids["d01"][0], False), "d03": (3, False), "e00": (89, True)}


def test_quantile_sketches_merge(spark):
    """Minutes merged to hours and days are within the stated error of the exact rank."""
    rng = random.Random(3)
    at = dt.datetime(2024, 1, 1)
    runs = [(at + dt.timedelta(seconds=rng.randrange(2 * 86_400)), k % 2, "capa", rng.lognormvariate(0, 2)) for k in range(20_000)]
    df = spark.createDataFrame(runs, "ts timestamp, tribunal int, operacao string, latencia double")
    minutes = monitoring.latency_sketches(df)
    days = monitoring.merged_sketches(monitoring.merged_sketches(minutes, "1 hour"), "1 day")
    for q in (0.5, 0.95):
        for r in monitoring.quantile(days, q).collect():
            own = [x for ts, t, _, x in runs if t == r.tribunal and ts.date() == r.inicio.date()]
            assert len(own) == r.n and abs(sum(x <= r.valor for x in own) / len(own) - q) < 0.02


def test_retain_leaves_no_orphan(spark):
    now = F.lit("2024-06-01").cast("timestamp")
    t = lambda s: dt.datetime.fromisoformat(s)
    raw = spark.createDataFrame([(1, t("2023-05-31")), (2, t("2023-06-02"))], "id long, coletado_em timestamp")
    tries = spark.createDataFrame([(1, t("2024-05-30")), (2, t("2024-05-31 12:00"))], "id long, criado_em timestamp")
    ups = spark.createDataFrame([(1, None, t("2024-05-01")), (2, t("2024-01-01"), t("2024-01-02")), (3, None, t("2024-05-29")), (4, None, None)], "id long, concluido_em timestamp, expira_em timestamp")
    targets = spark.createDataFrame([(1, 1, "d1"), (2, 2, "d2")], "alvo_id long, cliente_id long, valor string")
    seen = spark.createDataFrame([(10, 1), (11, 2)], "processo_id long, cliente_id long")
    parties = spark.createDataFrame([(10, 1), (10, 3), (11, 4), (12, 5), (12, 1)], "processo_id long, pessoa_id long")
    people = spark.createDataFrame([(1, "d1"), (2, "d2"), (3, None), (4, "d4"), (5, None), (6, "d1")], "pessoa_id long, documento string")
    closed = spark.createDataFrame([(2,)], "cliente_id long")
    k = subscriptions.retain(raw, tries, ups, targets, seen, parties, people, closed, now)
    ids = lambda df, c: sorted(r[c] for r in df.collect())
    assert ids(k.raw, "id") == [2] and ids(k.attempts, "id") == [2] and ids(k.sign_ups, "id") == [2, 3, 4]
    assert ids(k.occurrences, "processo_id") == [10] and rows(k.targets.select("alvo_id", "ativo")) == [(1, True), (2, False)]
    assert ids(k.people, "pessoa_id") == [1, 3, 6] and rows(k.parties) == [(10, 1), (10, 3), (12, 1)]


def test_anonymised_pages_of_all_spellings(spark):
    texts = [
        "<td>José d&apos;Ávila &amp; Filhos</td> 6f9619ff-8b86-d011-b42d-00c04fc964ff",
        "JOSE D'AVILA & FILHOS, Li e LIMA; José de Li",
        "jose&nbsp;d&#039;ávila   e filhos; Jos&eacute; d'&Aacute;vila & filhos; JOSÉ D’ÁVILA... FILHOS",
        None,
    ]
    pages = spark.createDataFrame(list(enumerate(texts)), "id long, texto string")
    names = spark.createDataFrame([(0, "José d'Ávila & Filhos"), (1, "Li"), (1, "---"), (2, None), (2, "JOSE D'AVILA FILHOS"), (1, "José de Li")], "id long, nome string")
    out = {r.id: (r.texto, r.sobrou) for r in anonymize.anonymize_names(pages, names, strict=True).collect()}
    assert out[0] == (f"<td>Pessoa 0-1</td> {anonymize.FIXED_UUID}", False)
    assert out[1] == ("Pessoa 0-1, Pessoa 1-2 e LIMA; Pessoa 1-1", False)
    assert out[2] == ("jose&nbsp;d&#039;ávila   e filhos; Pessoa 0-1; Pessoa 0-1", False)
    assert out[3] == (None, False)


def test_a_name_that_is_left_fails(spark):
    """A substitute that is itself a name of the batch can't be removed: that is told, and with ``strict`` an error."""
    pages = spark.createDataFrame([(1, "Pessoa e Maria Alves")], "id long, texto string")
    names = spark.createDataFrame([(1, "Pessoa"), (1, "Maria Alves")], "id long, nome string")
    assert [r.sobrou for r in anonymize.anonymize_names(pages, names).collect()] == [True]
    with pytest.raises(Exception, match="a name is left on page 1"):
        anonymize.anonymize_names(pages, names, strict=True).collect()


def test_anonymised_against_plain_search(spark):
    """Whole documents: what is replaced is what a search word by word finds, the longest name first at each word."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("texto"))
    texts = {r.id: r.texto for r in docs.collect()}
    names = [(i, " ".join(t.split()[:n])) for i, t in list(texts.items())[:40] if t for n in (1, 3, 6)]
    out = {r.id: r.texto for r in anonymize.anonymize_names(docs, spark.createDataFrame(names, "id long, nome string")).collect()}
    keys = {tuple(w for w, _, _ in anonymize.words(n)) for _, n in names} - {()}
    most = max(map(len, keys))
    for i, t in list(texts.items()):
        said, k, hits = [w for w, _, _ in anonymize.words(t or "")], 0, 0
        while k < len(said):
            n = next((n for n in range(most, 0, -1) if tuple(said[k : k + n]) in keys), 0)
            hits, k = hits + bool(n), k + (n or 1)
        assert (out[i] or "").count("Pessoa ") - (t or "").count("Pessoa ") == hits


def test_only_names_of_a_page_are_looked_up(spark):
    """Of all runs of a page's words the filter lets through its names, however many share their first words, and hardly another."""
    rng = random.Random(5)
    said = [rng.choice("de la straße Ação ½ 한국 x² joão o’neil 𝒜b e\u0301x silva souza".split()) + str(rng.randrange(30)) * rng.randrange(2) for _ in range(3000)]
    text = " ".join(said)
    there = [" ".join(said[i : i + n]) for n in range(1, 40) for i in (rng.randrange(2900),)]
    away = [f"{x} {rng.choice(said)} nunca" for x in there for _ in range(5)]
    names = spark.createDataFrame([(n, "p", w) for n in {*there, *away} if (w := anonymize.folded(n))], "nome string, put string, w_ array<string>")
    look = anonymize._filter(anonymize._numbered(names)).value
    w = anonymize.folded(text)
    assert w == [x for x, _, _ in anonymize.words(text)]
    found = {(i, n) for _, i, n, _ in look.search([anonymize._numbers(text)])}
    keys = {tuple(anonymize.folded(n)) for n in there + away}
    want = {(i, n) for i in range(len(w)) for n in {len(k) for k in keys} if tuple(w[i : i + n]) in keys and i + n <= len(w)}
    assert want <= found and len(found) < 1.05 * len(want) + 20
    out = anonymize.anonymize_names(spark.createDataFrame([(1, text)], "id long, texto string"), names.select(F.lit(1).cast("long").alias("id"), "nome")).first()
    hits, k = 0, 0
    while k < len(w):
        n = next((n for n in range(45, 0, -1) if tuple(w[k : k + n]) in keys), 0)
        hits, k = hits + bool(n), k + (n or 1)
    assert out.texto.count("Pessoa 1-") == hits and not out.sobrou


def test_attempts_are_limited_to_the_microsecond(spark):
    at = dt.datetime(2024, 1, 1)
    said = [(0.9, 1), (10.1, 2), (10.9, 3), (10.899999, 4), (20.9, 5)]
    df = spark.createDataFrame([("a", "k", at + dt.timedelta(seconds=s), i) for s, i in said], "acao string, chave string, ts timestamp, id long")
    assert {r.id: r.permitida for r in monitoring.rate_limit_attempts(df, 1, 10).collect()} == {1: True, 2: False, 4: False, 3: True, 5: True}


def _limited(attempts, most, seconds):
    """The fold one attempt after another."""
    kept, out = {}, []
    for acao, chave, ts, i in sorted((a for a in attempts if a[2] is not None), key=lambda a: (str(a[0]), str(a[1]), a[2], a[3])):
        before = [t for t in kept.get((acao, chave), []) if t > ts - dt.timedelta(seconds=seconds)]
        ok = len(before) < most
        kept[acao, chave] = before + [ts] * ok
        out.append((str(acao), str(chave), i, ok))
    return sorted(out + [(str(a), str(c), i, None) for a, c, ts, i in attempts if ts is None], key=str)


@pytest.mark.parametrize("most, seconds", [(1, 30), (3, 40), (5, 7), (0, 10), (4, 100_000)])
def test_attempts_of_one_key_over_many_ranges(spark, most, seconds):
    """A hot key with and without pauses, keys that end within a range, null keys and times, ties."""
    rng, at = random.Random(most), dt.datetime(2024, 1, 1)
    data, s = [], 0.0
    for i in range(1500):
        s += rng.choice([0, 0.5, 1, 3, 11]) + (60 if i % 400 == 399 else 0)
        data.append(("a", "hot", at + dt.timedelta(seconds=s), i))
    data += [(rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), at + dt.timedelta(seconds=rng.randrange(900)), 2000 + i) for i in range(300)]
    data += [("a", "hot", None, 5000), (None, None, None, 5001)]
    df = spark.createDataFrame(data, "acao string, chave string, ts timestamp, id long")
    for ranges in (1, 13):
        out = monitoring.rate_limit_attempts(df, most, seconds, ranges)
        got = out.withColumn("part", F.spark_partition_id()).collect()
        assert sorted(((str(r.acao), str(r.chave), r.id, r.permitida) for r in got), key=str) == _limited(data, most, seconds)
    sizes = collections.Counter(r.part for r in got if r.chave == "hot")
    assert len(sizes) > 8 and max(sizes.values()) < 2 * 1802 / 13
    assert monitoring.rate_limit_attempts(df.limit(0), most, seconds).count() == 0


def test_court_health_tells_all_it_watches(spark):
    at = dt.datetime(2024, 1, 1)
    day = lambda n: at + dt.timedelta(days=n)
    make = spark.createDataFrame
    courts = make([(1, True, None, None), (2, True, "", day(9)), (3, False, "x", None), (4, True, "x", None)], "tribunal long, ativo boolean, bloqueado_motivo string, pausado_ate timestamp")
    runs = make([(1, 1, day(1), True), (1, 2, day(1), False), (2, 3, day(0), True)], "tribunal long, id long, ts timestamp, sucesso boolean")
    canaries = make([(10, 1, "n10", True), (11, 1, "n11", True), (12, 1, "n12", False)], "sentinela long, tribunal long, numero_cnj string, ativo boolean")
    checks = make([(10, 1, day(1), True, None, []), (10, 2, day(2), False, "e", ["classe"]), (12, 3, day(3), True, None, [])], "sentinela long, id long, ts timestamp, sucesso boolean, erro string, campos array<string>")
    alarms = make([(1, "volume", day(3), None), (1, "erro", day(2), None), (1, "erro", day(0), day(1))], "tribunal long, tipo string, aberto_em timestamp, resolvido_em timestamp")
    sweeps = make([(1, 0), (1, 2), (1, 1), (2, 0)], "tribunal long, falhas_seguidas int")
    units = make([(2, "B", "civel", day(0)), (2, "A", "civel", day(0))], "tribunal long, comarca string, competencia string, vigente_desde timestamp")
    out = {r.tribunal: r for r in monitoring.court_health(courts, runs, canaries, checks, alarms, sweeps, units, F.lit(day(5))).collect()}
    assert [out[i].estado for i in (1, 2, 3, 4)] == ["ok", "pausado", "inativo", "bloqueado"]
    assert (out[1].execucao.id, out[1].execucao.sucesso, out[4].execucao) == (2, False, None)
    assert [(x.sentinela, x.sucesso, x.erro, x.campos) for x in out[1].sentinelas] == [(10, False, "e", ["classe"]), (11, None, None, None)]
    assert [a.tipo for a in out[1].alarmes] == ["erro", "volume"] and out[2].alarmes == [] and out[2].sentinelas == []
    assert (out[1].falhas, out[2].falhas) == (2, 0) and [u.comarca for u in out[2].unidades] == ["A", "B"]
