"""Personal data and secrets against plain regular expressions."""

import math
import random
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from casewatch.llm import pii, secrets
from casewatch.llm.common import text_key

TEXTS = [
    None, "", " ", "mail a@b.co_m@x.yz and A.b+c@d-e.f.g, x@y no", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "é4111 1111 1111 1111, 4111-1111-1111-1112 4" + "1" * 40,
    "+1 (988) 555-2485 +12 +1--2 +55.11.99999.8888", "1" * 40_000, "a" * 40_000 + "@b.c", "+" + "1 " * 3000, "x@" * 2000, "😀 +1 (988) 555-2485 😀 a@b.co",
]
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in twice) % 10 == 0
    return True


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")


def test_base_spans(spark):
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(frame(spark, TEXTS)).collect()}
    assert got == {i: plain_spans(t) for i, t in enumerate(TEXTS)}
    assert pii.find(frame(spark, [])).collect() == []


def test_spans_of_odd_texts(spark):
    @settings(max_examples=4, deadline=None)
    @given(st.lists(st.text(alphabet="a1.@-+_% ()é\n:", max_size=60), min_size=60, max_size=60))
    def check(texts):
        got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.detect(frame(spark, texts)).collect()}
        assert got == {i: plain_spans(t) for i, t in enumerate(texts)}

    check()


def test_terms_that_give_an_entity_away(spark):
    texts = [f"word{i} plain text without anything" for i in range(40)]
    texts += [f"alpha{'xyz'[i]} Zebulon wrote to z@mail.com about beta{'xyz'[i]} text" for i in range(3)] + [f"the plain text wrote to other{i}@mail.com about text" for i in range(3)]
    df = frame(spark, texts)
    added = {r.doc_id: {texts[r.doc_id][a.start : a.end] for a in r.added} for r in pii.find(df).collect()}
    assert all("Zebulon" in added[i] for i in (40, 41, 42)) and not any(added[i] for i in range(40)) and not any(added[i] for i in (43, 44, 45))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Zebulon" not in clean[40] and "[EMAIL]" in clean[40] and "alphax" in clean[40] and clean[40].endswith("text") and clean[0] == texts[0]


def plain_marks(texts, generalise=0.8, remove=0.95, bits=5):
    """{text: {term: (kind, keep)}} by counting everything in plain loops."""
    texts = sorted(set(texts))
    n = len(texts)
    words = {t: {w for w in re.split(r"[^a-z]+", t.lower()) if len(w) > 2} for t in texts}
    holds = {}
    for t in texts:
        found = {t[a:b].lower() for k, a, b in plain_spans(t) if k == "email"}
        holds[t] = {("email", v) for v in found} | {("group", v.split("@")[1]) for v in found}
    n_e = Counter(e for es in holds.values() for e in es)
    n_e = {e: c for e, c in n_e.items() if 1 < c < n and (e[0] == "email" or c * 2**bits <= n)}
    n_t = Counter(w for ws in words.values() for w in ws)
    n_et = defaultdict(Counter)
    for t in texts:
        for e in holds[t] & n_e.keys():
            n_et[e].update(words[t])

    def share(e, both, alone):
        p = n_e[e] / n
        m = p ** (generalise - 1)
        return 1 - math.log((both + m * p) / (alone + m)) / math.log(p)

    marks = defaultdict(dict)
    for t in texts:
        for w in words[t]:
            told = [(share(e, n_et[e][w], n_t[w]), e) for e in holds[t] & n_e.keys()]
            told = [x for x in told if x[0] >= generalise]
            if not told:
                continue
            keeps = []
            for x, e in told:
                if x < remove:
                    fits = lambda c, p: sum(v for k, v in c.items() if k.startswith(p))
                    bad = [k for k in range(2, len(w)) if share(e, fits(n_et[e], w[:k]), fits(n_t, w[:k])) >= generalise]
                    keep = min([*bad, len(w)]) - 1
                    keeps.append(keep if keep > 1 else 0)
            marks[t][w] = ("removed" if max(told)[0] >= remove else "term", 0 if max(told)[0] >= remove else min(keeps))
    return marks


def test_disclosures_are_those_of_plain_counts(spark):
    rng = random.Random(3)
    heads, tails = ["card", "neur", "ab", "xo"], ["iologist", "iogram", "ology", "on", "c"]
    vocabulary = [h + t for h in heads for t in tails] + ["the", "and", "of"]
    texts = []
    for i in range(700):
        words = rng.choices(vocabulary, k=4) + ["".join(rng.choices("pqr", k=5))]
        if i % 10 == 0:
            domain = i // 10 % 5
            words.append(f"p{rng.randrange(4)}@host{domain}.org")
            words += [f"zeta{domain}th"[:4] + "abcde"[domain] * 3] * (rng.random() < 0.9) + [f"cardi{'uvwxy'[domain]}"] * (rng.random() < 0.4)
        texts.append(" ".join(words))
    texts += texts[:30]
    df = frame(spark, texts)
    told = df.select(text_key(df.text).alias("told"), "text").dropDuplicates(["told"])
    for limits in ({}, {"generalise": 0.6, "remove": 0.75}):
        got = {r.text: {m.term: (m.kind, m.keep) for m in r.marks} for r in pii.disclosures(df, pii.detect(df), **limits).join(told, "told").collect()}
        want = plain_marks(texts, **limits)
        assert got == want
        assert {k for m in want.values() for k, _ in m.values()} == {"term", "removed"}
    # What is generalised keeps its broader part, in its own case.
    want = plain_marks(texts)
    clean = {r.text: r.clean for r in pii.sanitise(df.withColumn("clean", df.text)).select(F.col("clean").alias("text"), F.col("text").alias("clean")).collect()}
    broad = [(t, w, keep) for t, m in want.items() for w, (kind, keep) in m.items() if kind == "term" and keep]
    assert broad and all(w[:keep] + "*" in clean[t] and not re.search(rf"\b{w}\b", clean[t].replace("@", "x")) for t, w, keep in broad)


def test_one_sighting_gives_nothing_away(spark):
    """In a corpus of any size: rare words of a text with an address that others share stay."""
    for n in (40, 400):
        texts = [f"plain number{'abcdefghij'[i % 10]} text" for i in range(n)] + [f"unique{c} note to z@mail.com" for c in "abc"] + [f"text {i}" for i in range(n)]
        added = pii.find(frame(spark, texts)).where("size(added) > 0").collect()
        assert {texts[r.doc_id][a.start : a.end] for r in added for a in r.added} <= {"note"}


def test_sanitise_keeps_rows(spark):
    df = frame(spark, [*TEXTS, "call +1 (988) 555-2485 or a@b.co", "call +1 (988) 555-2485 or a@b.co"])
    out = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert len(out) == len(TEXTS) + 2 and out[0].text is None and out[1].text == "" and out[12].text == out[13].text == "call [PHONE] or [EMAIL]" and out[12].spans == "x"


SECRETS = [
    None, "", 'PassWord : "abcdefgh" api_key=1234567 APIkey="12345678"', "b" * 31 + " " + "b" * 64 + "0x", "AKIA" + "B" * 12 + " AKIA" + "B" * 11, "é token=abcdefghi, secret:: x secret=  'aaaaaaaaa'",
    "passwd=passwd=12345678", "f" * 50_000, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "tokentoken = aaaaaaaaaaaaaaaa", "pasſword=abcdefghi",
]
BASE = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 0, 16, 0), ("hex", r"[0-9a-f]+", 0, 32, 0))


def test_secret_spans(spark):
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans if s.kind in secrets.BASE] for r in secrets.find(frame(spark, SECRETS)).collect()}
    # Python's own case folding also takes the long s; letters in either case are A-Z and a-z.
    plain = lambda t: (t or "").replace("ſ", "#")
    want = {i: [(a, k, b) for a, _, k, b in sorted((m.start(), n, k, m.end()) for n, (k, p, g, least, f) in enumerate(BASE) for m in re.finditer(p, plain(t), f) if len(m[g]) >= least)] for i, t in enumerate(SECRETS)}
    assert got == want
    kinds = {r.doc_id: {s.kind for s in r.spans} for r in secrets.find(frame(spark, SECRETS)).collect()}
    assert "pem" in kinds[8] and "github" in kinds[9] and kinds[0] == kinds[1] == set()
    assert secrets.find(frame(spark, [])).collect() == []


def test_trigram_queries_never_lose_a_match():
    """Every text that a rule matches satisfies the rule's query."""
    def checked(rule):
        @settings(max_examples=60, deadline=None)
        @given(st.from_regex(re.compile(rule.pattern, re.A), fullmatch=True))
        def check(text):
            low = text.lower()
            assert all(any(all(g in low for g in way) for way in clause) for clause in rule.query)

        return check

    for rule in secrets.RULES:
        checked(rule)()
    assert secrets.trigram_query("[0-9a-f]{32,}") == () and secrets.trigram_query("ab") == ()
    assert secrets.trigram_query("(abc|abcd)x?") == ((("abc",),),)
