"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that
every match must hold: an AND of ORs of ANDs. The inverted index (trigram, text)
is built for the trigrams that the rules ask for, lower-cased, and written out;
the queries are joined to its postings, which are intersected into candidate
texts, and only those are verified with the expression. A rule without mandatory
trigrams scans all texts. Built-in functions only.

Expressions are parsed by Python's own parser, module ``re._parser`` of CPython
3.11 to 3.14, which has no public name.
"""

from __future__ import annotations

import re._constants as C  # the syntax tree of Python's own expressions
import re._parser as parser
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, located, small_side, text_key

#: A set of literals grows no further than this while a query is derived.
MOST = 32

Query = tuple[tuple[tuple[str, ...], ...], ...]


@dataclass(frozen=True)
class Rule:
    """``pattern`` in syntax shared by Java and Python; ``group`` of a match must have ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0

    @cached_property
    def query(self) -> Query:
        return trigram_query(self.pattern)


#: The three base rules, in the order of the result, and well-known key formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")


def trigram_query(pattern: str) -> Query:
    """An AND of ORs of ANDs of lower-case trigrams that each match holds; empty: no trigram is mandatory.

    >>> trigram_query("abcd[0-9]+x")
    ((('abc', 'bcd'),),)
    """
    clauses: list[tuple[tuple[str, ...], ...]] = []

    def flush(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            ways = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            # A way that asks for all that another asks for, and more, adds nothing.
            clauses.append(tuple(sorted(tuple(sorted(w)) for w in ways if not any(o < w for o in ways))))

    def walk(items, strings: set[str]) -> set[str]:
        """The literals that may stand right before what follows, {""} if nothing is known of it."""
        for op, arg in items:
            ways: set[str] | None = None
            if op is C.LITERAL:
                ways = {chr(arg).lower()}
            elif op is C.SUBPATTERN:
                ways = exact(arg[-1])
                if ways is None:
                    flush(strings)
                    strings = walk(arg[-1], {""})
                    continue
            elif op in (C.BRANCH, C.IN, C.MAX_REPEAT):
                ways = exact([(op, arg)])
            if ways is None:
                flush(strings)
                if op is C.MAX_REPEAT and arg[0] > 0:
                    flush(walk(arg[2], {""}))
                strings = {""}
            elif len(strings) * len(ways) > MOST:
                flush(strings)
                strings = ways
            else:
                strings = {a + b for a in strings for b in ways}
        return strings

    def exact(items) -> set[str] | None:
        """All texts that the items match, lower-cased, if they are few."""
        out = {""}
        for op, arg in items:
            if op is C.LITERAL:
                ways = {chr(arg).lower()}
            elif op is C.SUBPATTERN:
                ways = exact(arg[-1])
            elif op is C.BRANCH:
                each = [exact(x) for x in arg[1]]
                ways = None if None in each else set().union(*each)
            elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
                ways = {chr(x).lower() for _, x in arg}
            elif op is C.MAX_REPEAT and arg[1] is not C.MAXREPEAT and arg[1] <= 2:
                once = exact(arg[2])
                ways = None if once is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in _products(once, n)}
            else:
                ways = None
            if ways is None or len(out) * len(ways) > MOST:
                return None
            out = {a + b for a in out for b in ways}
        return out

    flush(walk(parser.parse(pattern), {""}))
    return tuple(dict.fromkeys(clauses))


def _products(once: set[str], n: int) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = [()]
    for _ in range(n):
        out = [(*p, s) for p in out for s in once]
    return out


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, told): the inverted index, for the trigrams asked for; told stands for a text, copies have one posting.

    Texts are lower-cased; null and empty ones have no postings, an empty table gives none.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    here = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    rows = docs.select(text_key(F.col("text")).alias("told"), text.alias("low"))
    return rows.select(F.explode(here).alias("trigram"), "told").distinct()


def asked(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """(rule, clauses, clause, way, need, trigram): the rules' queries as a table, a few rows each."""
    rows = [(r.kind, len(r.query), c, w, len(grams), g) for r in rules for c, clause in enumerate(r.query) for w, grams in enumerate(clause) for g in grams]
    return spark.createDataFrame(rows, "rule string, clauses int, clause int, way int, need int, trigram string")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(told, rules array<string>): texts whose postings satisfy a rule's query. Texts without any have no row.

    A way is satisfied if all its trigrams have the text, a clause if one of its
    ways is, a rule if all its clauses are.
    """
    met = index.join(F.broadcast(asked(index.sparkSession, rules)), "trigram")  # the queries are of fixed size
    ways = met.groupBy("told", "rule", "clauses", "clause", "way", "need").agg(F.count("*").alias("n")).where("n = need")
    full = ways.groupBy("told", "rule", "clauses").agg(F.countDistinct("clause").alias("n")).where("n = clauses")
    return full.groupBy("told").agg(F.collect_list("rule").alias("rules"))


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<start, kind, end>> of a rule's matches, leftmost and without overlap; too short ones dropped."""
    found = located(text, rule.pattern)
    if rule.least:
        part = lambda v: F.regexp_extract(v, rule.pattern, rule.group) if rule.group else v
        found = F.filter(found, lambda s: F.length(part(s["value"])) >= rule.least)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rule.kind).alias("kind"), s["end"].alias("end")))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) for every row: spans array<struct<start, rank, kind, end>>, by start, then the rule's place.

    Null and empty texts have no spans; repeated rows have the same each; other
    columns are ignored.
    """
    indexed = tuple(r for r in rules if r.query)
    docs = docs.select("doc_id", "text")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("told"), F.coalesce("text", F.lit("")).alias("text"))
    if indexed:
        index = checkpoint(postings(docs, sorted({g for r in indexed for clause in r.query for way in clause for g in way})))
        rows = rows.join(small_side(candidates(index, indexed)), "told", "left")
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    parts = [F.when(F.array_contains("rules", r.kind), matches(F.col("text"), r)).otherwise(none) if r.query else matches(F.col("text"), r) for r in rules]
    names = [f"m{i}_" for i in range(len(rules))]
    for name, part in zip(names, parts):
        rows = rows.withColumn(name, part)
    ranked = [F.transform(name, _rank(i)) for i, name in enumerate(names)]
    return rows.select("doc_id", F.sort_array(F.concat(*ranked)).alias("spans"))


def _rank(i: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))
