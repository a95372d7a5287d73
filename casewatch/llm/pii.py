"""Personal data: patterns, and information-theoretic sanitisation of what stands in the same texts.

Patterns find the protected entities. Each also belongs to a group: the mail
domain, the first half of the address, the card's issuer, the number without
its last seven digits. Entities and groups are the secrets e; groups that more
than one text in 2^5 holds tell nobody apart and are none. The corpus tells how
strongly a term t reveals a secret. All counts are of distinct texts (copies
count once): N of all, n_e with the secret, n_t with the term, n_et with both,
wherever in the text either stands. With p = n_e / N,

    q = (n_et + m * p) / (n_t + m),    m = p ** (threshold - 1)
    disclosure(t, e) = 1 - log q / log p

is the part of the secret's information content, -log2 p, that the term gives
away: 1 for a term that is seen with the secret always and nowhere else. The
prior's strength m is such that one sighting stays below the threshold in a
corpus of any size, while two of a term seen nowhere else pass once the secret
has 5 bits. Terms above the threshold are generalised, above another removed,
wherever they stand in a text with that secret.

A term is generalised as values are in a hierarchy of suffixes: to the longest
of its prefixes from which up all prefixes stay below the threshold for each
secret the term gives away, a prefix being seen where a term that starts with it
is (``cardiologist`` to ``cardio*``); where none does, to ``[TERM]``. Built-in
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, located, removed, small_side, text_key, wrapped, written

KINDS = ("email", "ip", "card", "phone")

#: Same matches as the plain patterns: a match starts where a run of its first characters starts or the last match
#: ended, so no inner start is tried, and possessive repeats leave nothing to backtrack on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
TERM = r"\p{L}{3,}"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = F.reverse(_digits(value))
    n = F.length(d)
    twice = lambda x: x * 2 - F.when(x > 4, 9).otherwise(0)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, twice(F.ascii(F.substring(d, i, F.lit(1))) - 48)).otherwise(F.ascii(F.substring(d, i, F.lit(1))) - 48)
    )
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def _octets(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


_VALID = {"email": lambda v: F.lit(True), "ip": _octets, "card": _luhn, "phone": lambda v: F.length(_digits(v)).between(9, 15)}
_NORMAL = {"email": F.lower, "ip": lambda v: v, "card": _digits, "phone": _digits}


def entities(text: Column) -> dict[str, Column]:
    """For each kind the matches that pass its test."""
    found = {}
    for kind in KINDS:
        spans = F.filter(located(text, PATTERNS[kind]), _passes(kind))
        found[kind] = F.when(F.contains(text, F.lit(NEEDS[kind])), F.transform(spans, _shape(kind))).otherwise(F.array().cast(SPAN))
    return found


def _passes(kind: str):
    return lambda s: _VALID[kind](s["value"])


def _shape(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _NORMAL[kind](s["value"]).alias("value"))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, told, spans): the base entities of every row, in order of kind, then start; written out. told stands for the text."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("told"), F.coalesce("text", F.lit("")).alias("text"))
    for kind, spans in entities(F.col("text")).items():
        rows = rows.withColumn(kind, spans)
    return checkpoint(rows.select("doc_id", "told", F.concat(*KINDS).alias("spans")))


def _terms(text: Column) -> Column:
    """A text's distinct terms, in lower case; pieces shorter than a term are left in, they never match one."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))


def group(kind: Column, value: Column) -> Column:
    """What an entity has in common with others of its kind, from its normal form."""
    whole = F.element_at(F.split(value, "@"), -1)
    return F.when(kind == "email", whole).when(kind == "ip", F.regexp_extract(value, r"^[0-9]+\.[0-9]+\.", 0)).when(kind == "card", F.left(value, F.lit(6))).otherwise(F.left(value, F.length(value) - 7))


def _share(n_et: str, n_t: str, n_docs: int, generalise: float) -> Column:
    p = F.col("n_e") / F.lit(n_docs)
    m = F.pow(p, F.lit(generalise - 1))
    return 1 - F.ln((F.col(n_et) + m * p) / (F.col(n_t) + m)) / F.ln(p)


def disclosures(docs: DataFrame, found: DataFrame, generalise: float = 0.8, remove: float = 0.95, group_bits: int = 5) -> DataFrame:
    """(told, marks array<struct<term, kind, keep>>): a text's terms that give away a secret of it; kind is ``term`` or ``removed``.

    keep is the number of characters of a generalised term's broader one, 0 where there is none.
    ``found`` is what ``detect`` gives of ``docs``. Null and empty texts have no
    terms; copies are one text; without a secret in two texts, and for an empty
    table, there are no rows.
    """
    counts = found.groupBy("told").agg(F.count("*").alias("copies"))
    n_docs = counts.count()
    copied = small_side(counts.where("copies > 1"))
    # (text, secret), once each; of secrets in several texts, for no other can be judged.
    named = lambda kind, value: F.concat(kind, F.lit(":"), value)
    secrets = F.array(named(F.col("s.kind"), F.col("s.value")), named(F.concat(F.lit("group "), "s.kind"), group(F.col("s.kind"), F.col("s.value"))))
    holds = found.select("told", F.explode("spans").alias("s")).select("told", F.explode(secrets).alias("e")).distinct()
    telling = ~F.startswith("e", F.lit("group ")) | (F.col("n_e") * 2**group_bits <= n_docs)
    often = holds.groupBy("e").agg(F.count("*").alias("n_e")).where((F.col("n_e") > 1) & (F.col("n_e") < n_docs) & telling)
    often = small_side(often.select("e", "n_e", _most(n_docs, generalise).alias("most")))
    holds = small_side(holds.join(often, "e").groupBy("told").agg(F.collect_list(F.struct("e", "n_e", "most")).alias("es")), weight=F.size("es"))
    rows = docs.select(text_key(F.col("text")).alias("told"), F.coalesce("text", F.lit("")).alias("text"))
    weigh = rows.join(copied, "told", "left").select(_terms(F.col("text")).alias("terms"), F.coalesce("copies", F.lit(1)).alias("copies"))
    of_t = weigh.select(F.explode("terms").alias("term"), "copies").where(F.length("term") > 2).groupBy("term", "copies").agg(F.count("*").alias("n"))
    of_t, counted = written(of_t.groupBy("term").agg(F.sum(F.expr("n div copies")).alias("n_t")))
    # Of copies one has the terms: the others weigh nothing.
    texts = rows.join(holds, "told").groupBy("told").agg(F.first("text").alias("text"), F.first("es").alias("es"))
    texts, split = written(texts.select("told", "es", _terms(F.col("text")).alias("terms")))
    terms = texts.select("told", "es", F.explode("terms").alias("term")).where(F.length("term") > 2)
    # Most places are of common terms, and a term in more texts than `most` can't give a secret away, wherever it stands.
    can = F.filter("es", lambda x: F.col("n_t").isNull() | (F.col("n_t") <= x["most"]))
    pairs = terms.join(_commonest(of_t), "term", "left").select("told", "term", F.explode(can).alias("x")).select("told", "term", "x.e", "x.n_e")
    # One sighting is below the threshold whatever the counts.
    both = checkpoint(pairs.groupBy("e", "term").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e")).where("n_et > 1"))
    strong = both.join(of_t, "term").withColumn("share", _share("n_et", "n_t", n_docs, generalise)).where(F.col("share") >= generalise)
    strong = small_side(strong.select("e", "n_e", "term", "share"))
    strong = small_side(strong.join(_broader(strong.where(F.col("share") < remove), terms, of_t, n_docs, generalise), ["e", "term"], "left"))
    hit = pairs.join(strong.drop("n_e"), ["e", "term"]).groupBy("told", "term").agg(F.max("share").alias("share"), F.min("keep").alias("keep"))
    gone = F.col("share") >= remove
    mark = F.struct("term", F.when(gone, "removed").otherwise("term").alias("kind"), F.when(gone, 0).otherwise(F.coalesce("keep", F.lit(0))).alias("keep"))
    marks = checkpoint(hit.groupBy("told").agg(F.collect_list(mark).alias("marks")))
    removed(docs.sparkSession, [counted, split])
    return marks


def _most(n_docs: int, generalise: float) -> Column:
    """In how many texts a term may be, at most, to reach the threshold for a secret of n_e texts, all of which have it."""
    p = F.col("n_e") / F.lit(n_docs)
    m = F.pow(p, F.lit(generalise - 1))
    return (m * (F.col("n_e") + m * p) - m) * (1 + 1e-9)


def _commonest(of_t: DataFrame, most: int = 100_000) -> DataFrame:
    """The terms in the most texts, at most so many, to be broadcast: all above a power of two that leaves no more."""
    sizes = {r.bits: r["count"] for r in of_t.groupBy(F.floor(F.log2("n_t")).alias("bits")).count().collect()}
    bits = next(b for b in range(65) if sum(n for k, n in sizes.items() if k >= b) <= most)
    return small_side(of_t.where(F.col("n_t") >= F.lit(2.0**bits)), most)


def _prefixes(term: str) -> Column:
    n = F.length(term)
    return F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.left(F.col(term), k))


def _broader(strong: DataFrame, terms: DataFrame, of_t: DataFrame, n_docs: int, generalise: float) -> DataFrame:
    """(e, term, keep): the length of the longest prefix from which up no prefix gives the secret away, 0 without one.

    Sightings of a prefix are those of all terms that start with it, each term of a text being one.
    """
    ways = checkpoint(strong.select("e", "n_e", "term", F.explode(_prefixes("term")).alias("prefix")))
    asked, of_e = small_side(ways.select("prefix").distinct()), small_side(ways.select("e", "prefix").distinct())
    starts = lambda df, *keep: df.select(*keep, F.explode(F.concat(_prefixes("term"), F.array("term"))).alias("prefix"))
    # Only terms with the first two letters of one that is asked for go on.
    two = small_side(ways.select("e", F.left("prefix", F.lit(2)).alias("two")).distinct())
    seen = terms.select("term", F.explode("es.e").alias("e")).withColumn("two", F.left("term", F.lit(2))).join(two, ["e", "two"], "left_semi")
    seen = seen.groupBy("e", "term").agg(F.count("*").alias("n_et"))
    n_p = starts(of_t, "n_t").join(asked, "prefix").groupBy("prefix").agg(F.sum("n_t").alias("n_p"))
    n_ep = starts(seen, "e", "n_et").join(of_e, ["e", "prefix"]).groupBy("e", "prefix").agg(F.sum("n_et").alias("n_ep"))
    told = ways.join(small_side(n_p), "prefix").join(small_side(n_ep), ["e", "prefix"])
    telling = F.min(F.when(_share("n_ep", "n_p", n_docs, generalise) >= generalise, F.length("prefix")))
    keep = F.coalesce(telling, F.length("term")) - 1
    return told.groupBy("e", "term").agg(F.when(keep > 1, keep).otherwise(0).alias("keep"))


def _added(docs: DataFrame, found: DataFrame, **thresholds) -> DataFrame:
    """(told, added array<struct<kind, start, end, put>>): where a text's marked terms stand, by place, and what is put there; bounded or else to be shuffled."""
    marks = small_side(disclosures(docs, found, **thresholds), weight=F.size("marks"))
    rows = docs.select(text_key(F.col("text")).alias("told"), F.col("text")).join(marks, "told").dropDuplicates(["told"])
    by_term = F.map_from_entries(F.transform("marks", lambda m: F.struct(m["term"], m)))

    def hit(s: Column) -> Column:
        mark = F.try_element_at(by_term, F.lower(s["value"]))
        put = F.when(mark["kind"] == "removed", "").when(mark["keep"] > 0, F.concat(F.left(s["value"], mark["keep"]), F.lit("*"))).otherwise("[TERM]")
        return F.struct(mark["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), put.alias("put"))

    hits = F.filter(F.transform(located(F.col("text"), TERM), hit), lambda s: s["kind"].isNotNull())
    return small_side(rows.select("told", hits.alias("added")), weight=F.size("added"))


def find(docs: DataFrame, **thresholds) -> DataFrame:
    """(doc_id, told, spans, added) for every row: base entities, and terms that the method adds, each by place.

    Null texts count as empty and have no spans; repeated rows have the same
    spans each. Terms inside an entity's span are left to the entity. Other
    columns are ignored; an empty table gives an empty result.
    """
    found = detect(docs)
    joined = found.join(_added(docs, found, **thresholds), "told", "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,put:string>>")
    inside = lambda a: F.exists("spans", lambda s: (a["start"] < s["end"]) & (s["start"] < a["end"]))
    return joined.select("doc_id", "told", "spans", F.coalesce(F.filter("added", lambda a: ~inside(a)), none).alias("added"))


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced: entities by ``[KIND]``, terms by a broader one or ``[TERM]``, or by nothing where removed.

    Rows, other columns (whatever their names) and texts without spans stay as
    they are; null stays null.
    """
    found = find(docs, **thresholds).where((F.size("spans") > 0) | (F.size("added") > 0))
    marks = F.concat(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put"))), F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["put"].alias("put"))))
    # Marks depend on the text alone, which told stands for in 128 bits: copies share them.
    marks = small_side(found.select("told", F.array_sort(marks).alias("marks")).dropDuplicates(["told"]), 200_000, F.size("marks"))
    text = F.col("row.text")
    step = lambda acc, m: F.when(m["start"] >= acc["pos"], F.struct(m["end"].alias("pos"), F.concat(acc["out"], F.array(F.substring(text, acc["pos"] + 1, m["start"] - acc["pos"]), m["put"])).alias("out"))).otherwise(F.struct(F.greatest(acc["pos"], m["end"]).alias("pos"), acc["out"].alias("out")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("marks", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text))))
    joined = docs.select(wrapped(docs).alias("row"), text_key(F.col("text")).alias("told")).join(marks, "told", "left")
    put = F.when(F.col("marks").isNotNull(), done).otherwise(text)
    return joined.select(*[put.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
