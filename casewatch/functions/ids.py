"""Column functions on case numbers, tax ids, lawyer licences, hashes and phones."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import remove_accents, squeeze

#: The states that issue lawyer licences.
STATES = ("AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO")
#: Weights of the second check digit of a person's and a company's tax id; those of the first are all but the first of these.
CPF_WEIGHTS = (11, 10, 9, 8, 7, 6, 5, 4, 3, 2)
CNPJ_WEIGHTS = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)


class TaxId(NamedTuple):
    """How a kind of tax id is written: sizes of its groups, the marks between them, the signs before the check digits, which are the last group."""

    kind: str
    groups: tuple[int, ...]
    marks: str
    signs: str
    weights: tuple[int, ...]

    @property
    def size(self) -> int:
        return sum(self.groups)

    def raw(self) -> str:
        """Pattern of an id without marks."""
        return f"{self.signs}{{{self.size - self.groups[-1]}}}[0-9]{{{self.groups[-1]}}}"

    def marked(self) -> str:
        """Pattern of an id with its marks."""
        signs = [self.signs] * (len(self.groups) - 1) + ["[0-9]"]
        return "".join(f"{x}{{{n}}}" + re.escape(m) for x, n, m in zip(signs, self.groups, [*self.marks, ""]))

    def formatted(self, doc: Column) -> Column:
        """A raw id with its marks."""
        starts = [1 + sum(self.groups[:i]) for i in range(len(self.groups))]
        return F.concat(*[x for a, n, m in zip(starts, self.groups, [*self.marks, ""]) for x in (F.substring(doc, a, n), F.lit(m))])

    def holds(self, doc: Column) -> Column:
        """Whether a raw id is one: its form, more than one sign, and both check digits."""
        return doc.rlike(f"^{self.raw()}$") & ~doc.rlike(r"^(.)\1*$") & _ends_well(doc, self.weights)


#: Tax ids of people (PF) and of companies (PJ), which may have letters.
TAX_IDS = (TaxId("PF", (3, 3, 3, 2), "..-", "[0-9]", CPF_WEIGHTS), TaxId("PJ", (2, 3, 3, 4, 2), "../-", "[0-9A-Z]", CNPJ_WEIGHTS))


def normalize_document(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^0-9A-Z]", "")


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def check_digit(c: Column, weights: tuple[int, ...]) -> Column:
    """Modulo-11 digit over the first characters of ``c``, one a weight; a character counts its code less 48."""
    total = lambda c: reduce(lambda a, b: a + b, [(F.ascii(F.substring(c, i + 1, 1)) - 48) * w for i, w in enumerate(weights)])
    return let(let(c, total) % 11, lambda rest: F.when(rest < 2, 0).otherwise(11 - rest))


def _ends_well(doc: Column, weights: tuple[int, ...]) -> Column:
    n = len(weights)
    return (F.substring(doc, n, 1) == check_digit(doc, weights[1:]).cast("string")) & (F.substring(doc, n + 1, 1) == check_digit(doc, weights).cast("string"))


def document_type(c: Column) -> Column:
    """PF for a valid CPF, PJ for a valid CNPJ (letters allowed in its first twelve places), else null."""

    def kind(doc: Column) -> Column:
        return F.coalesce(*[F.when(t.holds(doc), t.kind) for t in TAX_IDS])

    return let(normalize_document(c), kind)


def complete_document(base: Column, weights: tuple[int, ...]) -> Column:
    """The base of a tax id with its two check digits."""
    one = let(base, lambda b: F.concat(b, check_digit(b, weights[1:]).cast("string")))
    return let(one, lambda o: F.concat(o, check_digit(o, weights).cast("string")))


def format_document(c: Column) -> Column:
    doc = normalize_document(c)
    return F.coalesce(*[F.when(F.length(doc) == t.size, t.formatted(doc)) for t in TAX_IDS], c)


def mask_document(c: Column) -> Column:
    """First and last two characters of an id of right length; all of any other is masked."""
    doc = normalize_document(c)
    n = F.length(doc)
    return F.when(n.isin(*[t.size for t in TAX_IDS]), F.concat(F.substring(doc, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(doc, F.lit(2)))).otherwise(F.lit("***"))


def mask_documents_in_text(c: Column) -> Column:
    """Tax ids, formatted or raw, isolated from letters and digits, become [documento]."""
    forms = [f for t in TAX_IDS for f in (t.marked(), t.raw())]
    return F.regexp_replace(c, f"(?<![0-9A-Za-z])(?:{'|'.join(forms)})(?![0-9A-Za-z])", "[documento]")


def cnj_check_digit(seq: Column, year: Column, segment: Column, court: Column, origin: Column) -> Column:
    """Two digits, as text, of a case number given by its parts, as text."""
    base = F.concat(seq, year, segment, court, origin, F.lit("00")).cast("decimal(20,0)")
    return F.lpad((98 - base % 97).cast("int").cast("string"), 2, "0")


def parse_cnj(c: Column) -> Column:
    """struct(seq, dv, ano, segmento, tribunal, origem) of a case number, formatted or of 20 digits; null if it isn't valid."""
    d = F.regexp_replace(c, r"[\s.-]", "")
    formatted = F.trim(c).rlike(r"^[0-9]{7}-[0-9]{2}\.[0-9]{4}\.[0-9]\.[0-9]{2}\.[0-9]{4}$") | F.trim(c).rlike("^[0-9]{20}$")
    part = lambda a, n: F.substring(d, a, n)
    fine = formatted & (part(14, 1) != "0") & (part(8, 2) == cnj_check_digit(part(1, 7), part(10, 4), part(14, 1), part(15, 2), part(17, 4)))
    fields = (("seq", 1, 7), ("dv", 8, 2), ("ano", 10, 4), ("segmento", 14, 1), ("tribunal", 15, 2), ("origem", 17, 4))
    return F.when(fine, F.struct(*[part(a, n).alias(k) for k, a, n in fields]))


def format_cnj(c: Column) -> Column:
    """NNNNNNN-DD.AAAA.J.TR.OOOO of a valid number, else null."""
    return let(parse_cnj(c), lambda p: F.when(p.isNotNull(), F.concat(p["seq"], F.lit("-"), F.concat_ws(".", p["dv"], p["ano"], p["segmento"], p["tribunal"], p["origem"]))))


def is_valid_cnj(c: Column) -> Column:
    return F.coalesce(parse_cnj(c).isNotNull(), F.lit(False))


def normalize_oab(c: Column) -> Column:
    """State and number of a lawyer licence, as SP123456; null where either isn't found."""
    t = F.regexp_replace(F.regexp_replace(F.upper(remove_accents(c)), "[^0-9A-Z]", ""), "^OAB", "")
    first, last = F.substring(t, 1, 2), F.right(t, F.lit(2))
    state = F.when(first.isin(*STATES), first).when(last.isin(*STATES), last)
    number = F.regexp_extract(t, "([0-9]{1,6})", 1)
    short = F.regexp_replace(number, "^0+(?=.)", "")
    return F.when(number != "", F.concat(state, short))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex, of a text in UTF-8."""
    padded = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in padded) for x in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def hash_parameter(kind: Column, value: Column, key: bytes) -> Column:
    return hmac_sha256(F.concat_ws(":", kind, value), key)


def movement_hash(day: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.date_format(day, "yyyy-MM-dd"), squeeze(text)), 256)


def normalize_phone(c: Column) -> Column:
    """Digits with the country; null unless there are 12 to 15."""
    d = F.regexp_replace(c, "[^0-9]", "")
    d = F.when(F.length(d).isin(10, 11), F.concat(F.lit("55"), d)).otherwise(d)
    return F.when(F.length(d).between(12, 15), d)


def pseudonymous_cnj(c: Column, district: str = "0100") -> Column:
    """A fictitious valid number for a valid one, the same each time: sequence from a hash, same year, segment and court."""

    def change(p: Column) -> Column:
        digest = F.sha2(F.concat(p["seq"], p["dv"], p["ano"], p["segmento"], p["tribunal"], p["origem"]), 256)
        places = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(digest, i, F.lit(1))) - 1)
        seq = F.lpad(F.aggregate(places, F.lit(0).cast("long"), lambda acc, x: (acc * 16 + x) % 10_000_000).cast("string"), 7, "0")
        written = lambda q: F.concat(q, F.lit("-"), F.concat_ws(".", cnj_check_digit(q, p["ano"], p["segmento"], p["tribunal"], F.lit(district)), p["ano"], p["segmento"], p["tribunal"], F.lit(district)))
        return F.when(p.isNotNull(), let(seq, written))

    return let(parse_cnj(c), change)


def pseudonymous_document(c: Column) -> Column:
    """A fictitious valid CPF or CNPJ for a valid one, the same each time; other texts are null."""
    kind, digest = document_type(c), F.sha2(normalize_document(c), 256)
    digits = lambda n: F.translate(F.substring(digest, 1, n), "abcdef", "012345")
    return F.when(kind == "PF", complete_document(digits(9), CPF_WEIGHTS)).when(kind == "PJ", complete_document(F.concat(digits(8), F.lit("0001")), CNPJ_WEIGHTS))
