"""Each registered query over small tables: columns, types, rows and digests as its contract has them."""

import hashlib
import re
import sys
import zlib
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_simhash import brute  # noqa: E402
from test_spans import BASE, plain_spans  # noqa: E402

from casewatch.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, docs, name, types, sf=SF):
    out = queries.queries()[name](spark, sf)
    assert dict(out.dtypes) | types == dict(out.dtypes)
    rows = {r.doc_id: r for r in out.collect()}
    assert set(rows) == set(docs) and out.count() == len(docs)
    return rows


@pytest.mark.parametrize(("name", "least"), [("op1_quality", 0.3), ("op5_toxicity", 0.5)])
def test_classifiers(spark, docs, name, least):
    for i, r in run(spark, docs, name, {"held_out": "boolean", "score": "double", "predicted": "int"}).items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least)


def test_language_model(spark, docs):
    rows = run(spark, docs, "op4_lm", {"held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"})
    count = {i: len((t or "").encode().split()) + 1 for i, t in docs.items()}
    train = sum(n for i, n in count.items() if zlib.crc32(str(i).encode()) % 7 != 2)
    for i, r in rows.items():
        assert r.n_tokens == count[i] >= r.n_known and r.train_tokens == train and r.score < 0 > r.base_score and r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)


def test_personal_data(spark, docs):
    rows = run(spark, docs, "op6_sanitise", {**{f"n_{k}": "bigint" for k in ("email", "ip", "card", "phone")}, "base_sha256": "string", "spans": "string"})
    for i, r in rows.items():
        base = plain_spans(docs[i])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
    assert any(r.n_email for r in rows.values())


def test_secrets(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables have no secret
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = run(spark, docs, "op9_secrets", {"n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}, sf)
    for i, r in rows.items():
        t = (docs[i] or "").replace("ſ", "#")
        base = sorted((m.start(), n, k, m.end()) for n, (k, p, g, least, f) in enumerate(BASE) for m in re.finditer(p, t, f) if len(m[g]) >= least)
        text = [f"{k}:{a}:{b}" for a, _, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(text).encode()).hexdigest() and set(text) <= set(r.spans.split(",") if r.spans else [])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[2] == k for x in base) for k in ("assign", "access", "hex")]
    assert sum(r.n_assign > 0 for r in rows.values()) > 5 and sum(r.n_hex > 0 for r in rows.values()) > 5


def test_weighted_sampling(spark, docs):
    rows, order = run(spark, docs, "op8_weighted_sampling", {"n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}), sorted(docs)
    for k, i in enumerate(order):
        t, after = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1


def test_near_duplicates(spark, docs):
    rows = run(spark, docs, "op10_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows.values()) == brute(sorted(docs.items()), 3, 3)


@pytest.mark.parametrize("name", ["op2_packing", "op3_topk", "op7_mixing"])
def test_others_have_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_merkle_manifest", "op13_line_dedup"])
def test_equal_sql(spark, name):
    """Whole tables of the smallest size, row by row against the SQL."""
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    out = queries.queries()[name](spark, SF)
    cols = sorted(out.columns)
    want = con.execute(queries.oracle_sql()[name]).df()
    assert sorted(want.columns) == cols
    want = sorted(tuple(map(str, r)) for r in want[cols].itertuples(index=False))
    assert sorted(tuple(map(str, r)) for r in out.select(cols).toPandas().itertuples(index=False)) == want and want
