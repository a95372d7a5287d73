"""Golden values of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casewatch.functions import ids, money_time, similarity, text


def values(spark, rows, f):
    """``f`` of a column of texts."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names(spark):
    names = ["Açúcar & Cia. Ltda. - ME", "Ltda", "Sociedade Anônima", "D'Ávila S/A", "João da Silva", "Comércio Sociedade Limitada", None, "ﬁlial 1ª"]
    assert values(spark, names, text.normalize_name) == ["ACUCAR", "LTDA", "SOCIEDADE ANONIMA", "DAVILA", "JOAO DA SILVA", "COMERCIO", None, "FILIAL 1A"]
    assert values(spark, ["SILVA DE", "ANA LUZ", "J ELETRICISTA", "", None], text.is_specific_name) == [False, True, True, False, None]
    assert values(spark, ["Acme Ltda", "Acme", None], text.company_type_by_suffix) == ["PJ", None, None]


def test_districts_and_sides(spark):
    assert values(spark, ["Comarca de São Paulo", "FORO DA CAPITAL", " ", None], text.canonical_district) == ["SAO PAULO", "CAPITAL", None, None]
    units = ["Foro Central Cível", "Foro de Ribeirão Preto", "Foro Distrital de Itupeva", "Araçatuba/DEECRIM UR2", "Foro 1 - Núcleo 4.0", "Foro das Execuções Fiscais", None]
    assert values(spark, units, text.district_from_court_unit) == ["São Paulo", "Ribeirão Preto", "Itupeva", "Araçatuba", None, None, None]
    units = ["foro regional I - Santana", "Foro de", "Foro da Vara Única", " /x", "Assis / Vara", "Bauru/", "Foro  dos  Poços de Caldas", "Foro Distrital", "Lins 2/x", ""]
    assert values(spark, units, text.district_from_court_unit) == ["São Paulo", None, None, None, "Assis", None, "Poços de Caldas", None, None, None]
    assert values(spark, ["Comarca de", "foro dos índios do sul", "Comarca Nova", "Foro"], text.canonical_district) == ["COMARCA DE", "INDIOS DO SUL", "COMARCA NOVA", "FORO"]
    assert values(spark, ["Reqte.:", "Réu", "Perito", None], text.side_from_label) == ["ativo", "passivo", "terceiro", "terceiro"]
    assert values(spark, ["a", "P", "x", None], text.side_from_code) == ["ativo", "passivo", "desconhecido", "desconhecido"]


def test_documents(spark):
    docs = ["529.982.247-25", "11.222.333/0001-81", "11111111111", "52998224724", "12.ABC.345/01DE-35", "", None]
    assert values(spark, docs, ids.document_type) == ["PF", "PJ", None, None, "PJ", None, None]
    assert values(spark, ["52998224725", "11222333000181"], ids.format_document) == ["529.982.247-25", "11.222.333/0001-81"]
    assert values(spark, ["52998224725", "123"], ids.mask_document) == ["52*******25", "***"]
    said = ["cpf 529.982.247-25, cnpj 11222333000181; 1000123-35.2024.8.26.0100 e 10001233520248260100"]
    forms = ["52998224725 x52998224725 12.ABC.345/01DE-35 12ABC34501DE35 529982247-25 12.345.678/0001-9", None]
    assert values(spark, forms, ids.mask_documents_in_text) == ["[documento] x52998224725 [documento] [documento] 529982247-25 12.345.678/0001-9", None]
    assert values(spark, said, ids.mask_documents_in_text) == ["cpf [documento], cnpj [documento]; 1000123-35.2024.8.26.0100 e 10001233520248260100"]


def test_case_numbers(spark):
    numbers = ["1000123-35.2024.8.26.0100", "10001233520248260100", "1000123-36.2024.8.26.0100", "1000123-35.2024.0.26.0100", "x", None]
    assert values(spark, numbers, ids.format_cnj) == ["1000123-35.2024.8.26.0100"] * 2 + [None] * 4
    assert values(spark, numbers, ids.is_valid_cnj) == [True, True, False, False, False, False]
    changed = values(spark, ["0000001-84.2020.8.26.0001", "x"], ids.pseudonymous_cnj)
    assert changed[1] is None and values(spark, changed[:1], ids.is_valid_cnj) == [True] and changed[0] != "0000001-84.2020.8.26.0001"
    fake = values(spark, ["52998224725", "11222333000181", "1"], ids.pseudonymous_document)
    assert values(spark, fake, ids.document_type) == ["PF", "PJ", None]


def test_licences_phones_hashes(spark):
    assert values(spark, ["123.456/SP", "OAB/RJ 001234", "sp12", "12345", "XX1", None], ids.normalize_oab) == ["SP123456", "RJ1234", "SP12", None, None, None]
    assert values(spark, ["(11) 99999-8888", "+55 11 99999-8888", "123", None], ids.normalize_phone) == ["5511999998888", "5511999998888", None, None]
    import hashlib
    import hmac

    assert values(spark, ["á"], lambda c: ids.hash_parameter(F.lit("nome"), c, b"k")) == [hmac.new(b"k", "nome:á".encode(), hashlib.sha256).hexdigest()]


@pytest.mark.parametrize(("said", "cents"), [("R$ 1.234,56", 123456), ("1.234", 123400), ("1234.5", 123450), ("1234.565", 123457), ("-1", None), ("NaN", None), ("abc", None), ("", None), (None, None)])
def test_to_cents(spark, said, cents):
    assert values(spark, [said], money_time.to_cents) == [cents]


def test_dates(spark):
    assert values(spark, ["2024-01-31"], lambda c: money_time.add_months(F.to_date(c), F.lit(1)).cast("date")) == [dt.date(2024, 2, 29)]
    assert values(spark, ["20240102030405", "2024-01-02T10:00", "2/1", None], money_time.parse_feed_date) == [dt.date(2024, 1, 2)] * 2 + [None] * 2
    assert values(spark, ["sorteio em 03/02/2024", "31/02/2024"], money_time.parse_br_date) == [dt.date(2024, 2, 3), None]
    at = values(spark, ["2026-09-25", "bad"], lambda c: F.date_format(money_time.hearing_ts(c, F.lit("14:30")), "yyyy-MM-dd HH:mm"))
    assert at == ["2026-09-25 17:30", None]
    w = values(spark, ["2024-01-01"], lambda c: money_time.date_windows(F.to_date(c), F.lit("2024-01-05").cast("date"), 2))
    assert [(str(x["first"])[:10], str(x["last"])) for x in w[0]] == [("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-04"), ("2024-01-05", "2024-01-05")]


def test_deadlines(spark):
    df = spark.createDataFrame([(dt.date(2026, 9, 25), 15, "uteis"), (dt.date(2026, 9, 28), 5, "corridos"), (dt.date(2026, 9, 28), 0, "uteis"), (None, 5, "uteis")], "d date, n int, k string")
    for holidays, first in (((), dt.date(2026, 10, 19)), (("2026-10-12",), dt.date(2026, 10, 20))):
        cal = money_time.calendar(spark, "2026-09-01", "2026-12-31", holidays)
        out = {(r.d, r.n): r.fim for r in money_time.deadline_end(df, cal, "d", "n", "k", "fim").collect()}
        assert out[(dt.date(2026, 9, 25), 15)] == first
        assert out[(dt.date(2026, 9, 28), 5)] == dt.date(2026, 10, 5)
        assert out[(dt.date(2026, 9, 28), 0)] is None and out[(None, 5)] is None


def test_similarity_join_is_exact(spark):
    names = [f"{a} {b}{c}" for a in ("MARIA", "JOSE", "ANTONIO CARLOS") for b in ("SILVA", "SOUZA", "PEREIRA DOS SANTOS") for c in ("", "S", " NETO", "X")] + ["", "A"]
    df = spark.createDataFrame([(n,) for n in names], "name string")

    def grams(s):
        return {("  " + w + " ")[i : i + 3] for w in s.lower().split() for i in range(len(w) + 1)}

    for percent in (85, 90):
        want = {(a, b) for a in names for b in names if grams(a) and grams(b) and len(grams(a) & grams(b)) * 100 >= percent * len(grams(a) | grams(b))}
        assert {tuple(r) for r in similarity.similarity_join(df, df, percent).collect()} == want
    assert abs(values(spark, ["word"], lambda c: similarity.similarity(c, F.lit("two words")))[0] - 0.363636) < 1e-5


def test_urls(spark):
    urls = ["https://esaj.tjsp.jus.br/x", "http://jus.br/x", "https://jus.br.evil.com", "javascript:alert(1)", None]
    assert values(spark, urls, text.public_url) == ["https://esaj.tjsp.jus.br/x", None, None, None, None]
    assert values(spark, ["https://h/p?cpf=1&a=2&nome=&nome=x"], lambda c: text.mask_url_params(c, ("cpf", "nome"))) == ["https://h/p?cpf=***&a=2&nome=&nome=***"]
    assert values(spark, [None, "", "a" * 300], text.clean_param) == ["-", "-", "a" * 199 + "…"]
