"""Normalising, checking and filtering cases, parties, lawyers and pages."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text

SIDES = ("ativo", "passivo", "terceiro")
#: What stays of a sealed case.
OPEN_FIELDS = ("id", "numero_cnj", "tribunal", "tribunal_id", "url", "url_origem", "segredo", "coletado_em", "bruto_ref", "cliente_id")


def normalize_cases(cases: DataFrame) -> DataFrame:
    """District in canonical form, texts squeezed; of a sealed case only number, court and URL stay."""
    out = cases.withColumn("comarca", text.canonical_district(F.col("comarca"))).withColumn("classe_nome", text.squeeze(F.col("classe_nome")))
    return out.select(*[F.col(c) if c in OPEN_FIELDS else F.when(~F.col("segredo"), F.col(c)).alias(c) for c in out.columns])


def normalize_parties(parties: DataFrame) -> DataFrame:
    """Rows with nome_normalizado, documento only where it is valid, tipo by it or by the name, erro for a bad side.

    Rows without a name are dropped.
    """
    named = parties.withColumn("nome", text.squeeze(F.col("nome"))).where("nome is not null")
    kind = ids.document_type(F.col("documento"))
    doc = F.when(kind.isNotNull(), ids.normalize_document(F.col("documento")))
    return named.select(
        *[c for c in named.columns if c not in ("documento",)], text.normalize_name(F.col("nome")).alias("nome_normalizado"), doc.alias("documento"),
        F.coalesce(kind, text.company_type_by_suffix(F.col("nome"))).alias("tipo"), F.when(~F.coalesce(F.col("polo").isin(*SIDES), F.lit(False)), "polo inválido").alias("erro"),
    )


def normalize_lawyers(lawyers: Column) -> Column:
    """array<struct<nome, oab_numero, oab_uf>>: squeezed, states that exist, distinct in order, nameless ones dropped."""
    clean = lambda c: F.regexp_replace(F.upper(c), "[^0-9A-Z]", "")
    state = lambda c: F.when(clean(c).isin(*ids.STATES), clean(c))
    shaped = F.transform(lawyers, lambda a: F.struct(text.squeeze(a["nome"]).alias("nome"), F.nullif(clean(a["oab_numero"]), F.lit("")).alias("oab_numero"), state(a["oab_uf"]).alias("oab_uf")))
    return F.array_distinct(F.filter(shaped, lambda a: a["nome"].isNotNull()))


def tpu_enrich(cases: DataFrame, name: str, catalog: DataFrame, code: str) -> DataFrame:
    """``cases`` with ``code``: that of the catalogue whose name has the same key; null for unknown and ambiguous names."""
    keyed = catalog.groupBy(text.tpu_key(F.col("nome")).alias("key_")).agg(F.min("codigo").alias("low_"), F.max("codigo").alias("high_"))
    codes = keyed.select("key_", F.when(F.col("low_") == F.col("high_"), F.col("low_")).alias(code))
    return cases.withColumn("key_", text.tpu_key(F.col(name))).join(codes, "key_", "left").drop("key_")


def validate_rows(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(violacao, n): how many rows break each check; null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
    return rows.select(F.explode(broken).alias("violacao")).groupBy("violacao").agg(F.count("*").alias("n"))


def search_cases(cases: DataFrame, people: DataFrame, q: str) -> DataFrame:
    """Cases whose number holds the digits of ``q`` (seven at least) or that have a party whose name holds ``q`` (three characters at least)."""
    digits, name = "".join(c for c in q if c.isdigit()), " ".join(q.upper().split())
    hits = F.lit(False)
    out = None
    if len(digits) >= 7:
        hits = F.contains(F.regexp_replace("numero_cnj", "[^0-9]", ""), F.lit(digits))
        out = cases.where(hits)
    if len(name) >= 3:
        found = cases.join(people.where(F.contains("nome_normalizado", F.lit(name))).select(F.col("processo_id").alias("id")), "id", "left_semi").select(*cases.columns)
        out = found if out is None else out.union(found)
    return (cases.where(hits) if out is None else out).distinct()


def filter_rows(rows: DataFrame, tenant: int, status: str | None = None, since: tuple[str, str] | None = None, least: tuple[str, int] | None = None, confidence: str | None = None) -> DataFrame:
    """One tenant's rows by status, date, score and confidence; the tenant is never optional."""
    rows = rows.where(F.col("cliente_id") == tenant)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if since is not None:
        rows = rows.where(F.col(since[0]) >= F.lit(since[1]).cast("date"))
    if least is not None:
        rows = rows.where(F.col(least[0]) >= least[1])
    return rows if confidence is None else rows.where(F.col("confianca") == confidence)


def recent(day: Column, today: Column, days: int) -> Column:
    """Made available within the last ``days``; no date: not recent."""
    return F.coalesce(day >= F.date_sub(today, days), F.lit(False))


#: Texts by which a saved page is told, in order; on the page without accents, in capitals.
PAGE_KINDS = (("captcha", "CAPTCHA"), ("sigilo", "SEGREDO DE JUSTICA"), ("muitos", "MUITOS PROCESSOS"), ("vazia", "NAO EXISTEM INFORMACOES"))


def classify_pages(pages: DataFrame, html: Column) -> DataFrame:
    """``pages`` with ``kind``: capa (a case's cover), lista, or what the page says instead; else desconhecida."""
    plain = F.upper(text.remove_accents(html))
    kind = F.when(F.contains(html, F.lit('id="numeroProcesso"')), "capa").when(F.contains(html, F.lit('id="listagemDeProcessos"')), "lista")
    for name, said in PAGE_KINDS:
        kind = kind.when(F.contains(plain, F.lit(said)), name)
    return pages.withColumn("kind", kind.otherwise("desconhecida"))


#: Ids of the tables of parties, the fuller one first, and of the list of a search's results; what a lawyer's line begins with.
TABLES = ("tableTodasPartes", "tablePartesPrincipais")
LISTING = "listagemDeProcessos"
LAWYER = re.compile(r"(?:advogad[oa]s?|adv\.?a?|procurador[a]?|defensor[a]?(?: p[úu]blic[oa])?)\s*:", re.I)
NUMBER = re.compile(r"[0-9]{7}-[0-9]{2}\.[0-9]{4}\.[0-9]\.[0-9]{2}\.[0-9]{4}")


class _Cells(HTMLParser):
    """Text by element id, the rows of the table of parties, and the numbers of a list under their headings."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.by_id: dict[str, str] = {}
        self.tables: dict[str, list[list[str]]] = {}
        self.open: list[tuple[str, str | None]] = []
        self.table: str | None = None
        self.heading: list[str] = []
        self.items: list[tuple[str | None, str]] = []

    def handle_starttag(self, tag, attrs) -> None:
        name = dict(attrs).get("id")
        if tag == "br":
            return self.handle_data("\n")
        if tag in ("img", "input", "hr", "meta", "link"):
            return None
        self.open.append((tag, name))
        if tag == "h2":
            self.heading = []
        if name in TABLES:
            self.table = name
            self.tables[name] = []
        if self.table and tag == "tr":
            self.tables[self.table].append([])
        if self.table and tag == "td" and self.tables[self.table]:
            self.tables[self.table][-1].append("")
        return None

    def handle_endtag(self, tag) -> None:
        # An end without a beginning, as that of <br/>, ends nothing.
        while any(t == tag for t, _ in self.open):
            t, name = self.open.pop()
            if name and name == self.table:
                self.table = None
            if t == tag:
                break

    def handle_data(self, data) -> None:
        if any(name == LISTING for _, name in self.open):
            if any(t == "h2" for t, _ in self.open):
                self.heading.append(data)
            self.items += [(" ".join("".join(self.heading).split()) or None, n) for n in NUMBER.findall(data)]
        for _, name in self.open:
            if name:
                self.by_id[name] = self.by_id.get(name, "") + data
        if self.table and self.tables[self.table] and self.tables[self.table][-1]:
            self.tables[self.table][-1][-1] += data


#: Fields of a cover by the id of their element.
COVER = {"numero": "numeroProcesso", "classe": "classeProcesso", "assunto": "assuntoProcesso", "foro": "foroProcesso", "vara": "varaProcesso", "distribuicao": "dataHoraDistribuicaoProcesso", "valor": "valorAcaoProcesso"}


def _party(row: list[str]) -> dict | None:
    """A row of the table of parties: label, name and, on lines of their own, lawyers; None if it names no party."""
    if len(row) < 2:
        return None
    lines = [" ".join(x.split()) for x in row[1].replace("\xa0", " ").split("\n")]
    lines = [x for x in lines if x]
    if not lines or LAWYER.match(lines[0]):
        return None
    lawyers = [x[m.end() :].strip() for x in lines[1:] if (m := LAWYER.match(x))]
    return {"rotulo": " ".join(row[0].split()), "nome": lines[0], "advogados": [x for x in lawyers if x]}


def extract_case_pages(pages: DataFrame) -> DataFrame:
    """(path, cover fields, partes array<struct<rotulo, nome, advogados, polo>>) of the covers among ``pages`` (path, html).

    The tables of parties are nested markup, for which there is no built-in
    function: batches of pages are parsed in Python, each page by itself.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, html in zip(f.path, f.html):
                p = _Cells()
                p.feed(html or "")
                rows = next((p.tables[t] for t in TABLES if p.tables.get(t)), [])
                said = {k: " ".join(p.by_id.get(i, "").split()) or None for k, i in COVER.items()}
                out.append({"path": path, **said, "partes": [x for x in map(_party, rows) if x]})
            yield pd.DataFrame(out, columns=["path", *COVER, "partes"])

    schema = "path string, " + ", ".join(f"{k} string" for k in COVER) + ", partes array<struct<rotulo:string,nome:string,advogados:array<string>>>"
    covers = classify_pages(pages.select("path", "html"), F.col("html")).where("kind = 'capa'").select("path", "html")
    found = covers.mapInPandas(parse, schema)
    return found.withColumn("partes", F.transform("partes", lambda x: F.struct(x["rotulo"], x["nome"], x["advogados"], text.side_from_label(x["rotulo"]).alias("polo"))))


def extract_list_pages(pages: DataFrame) -> DataFrame:
    """(path, foro, numero) of each case that the result lists among ``pages`` (path, html) name, under the heading it stands under."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, html in zip(f.path, f.html):
                p = _Cells()
                p.feed(html or "")
                out += [(path, heading, n) for heading, n in dict.fromkeys(p.items)]
            yield pd.DataFrame(out, columns=["path", "foro", "numero"])

    lists = classify_pages(pages.select("path", "html"), F.col("html")).where("kind = 'lista'").select("path", "html")
    return lists.mapInPandas(parse, "path string, foro string, numero string")
