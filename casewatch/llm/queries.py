"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, cws, lines, lm, manifest, mixing, packing, pii, quality, secrets, simhash, topk, toxicity
from .common import id_remainder, table

#: Held-out fold of the two classifiers: remainder 0 of crc32 modulo 5.
FOLDS = 5


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, id_remainder(F.col("doc_id"), FOLDS) != 0)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP3_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm.score(docs, id_remainder(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, id_remainder(F.col("doc_id"), FOLDS) != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3, segments=2)


def _span(kind, start, end):
    return F.concat_ws(":", kind, start.cast("string"), end.cast("string"))


def op6_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_join(F.transform("spans", lambda s: _span(s["kind"], s["start"], s["end"])), ",")
    added = F.array_join(F.transform("added", lambda s: _span(s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    spans = F.concat_ws(",", F.when(base != "", base), F.when(added != "", added))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


#: Target weights of the mixture: domains, then languages; all sources weigh the same.
WEIGHTS = ({"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 5, "de": 2, "fr": 2, "es": 1}, {})


def domain():
    """Sources are put into four domains by their number."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(F.col("source"), "([0-9]{1,9})$", 1).try_cast("int") % 4, F.lit(0)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), domain(), WEIGHTS)
    return mixed.select("doc_id", "domain_", "lang_", "source_", "n_tokens", F.col("epoch_").cast("long").alias("epoch_"))


OP7_SQL = """
WITH docs AS (
  SELECT doc_id, text, 'd' || coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS int) % 4, 0) AS domain_,
    coalesce(lang, '(none)') AS lang_, coalesce(source, '(none)') AS source_,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents),
rows_ AS (SELECT * FROM docs WHERE n_tokens > 0),
leaves AS (SELECT domain_, lang_, source_, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS cap FROM rows_ GROUP BY ALL),
l1 AS (SELECT domain_, sum(cap)::BIGINT AS cap, CASE domain_ WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS weight,
  (SELECT least(sum(tokens) // 2, sum(cap))::BIGINT FROM leaves) AS budget FROM leaves GROUP BY domain_),
f1 AS (SELECT *, cap * (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) <= weight * (budget - coalesce(sum(cap) OVER o, 0)) AS is_full FROM l1
  WINDOW o AS (ORDER BY cap / weight, weight, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p1 AS (SELECT domain_, CASE WHEN is_full THEN cap ELSE greatest(0, (weight * (budget - coalesce(sum(cap) FILTER (is_full) OVER (), 0))) // sum(weight) FILTER (NOT is_full) OVER ()) END::BIGINT AS budget FROM f1),
l2 AS (SELECT domain_, lang_, sum(cap)::BIGINT AS cap, CASE lang_ WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight, any_value(budget) AS budget
  FROM leaves JOIN p1 USING (domain_) GROUP BY domain_, lang_),
f2 AS (SELECT *, cap * (sum(weight) OVER (PARTITION BY domain_) - coalesce(sum(weight) OVER o, 0)) <= weight * (budget - coalesce(sum(cap) OVER o, 0)) AS is_full FROM l2
  WINDOW o AS (PARTITION BY domain_ ORDER BY cap / weight, weight, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p2 AS (SELECT domain_, lang_, CASE WHEN is_full THEN cap ELSE greatest(0, (weight * (budget - coalesce(sum(cap) FILTER (is_full) OVER g, 0))) // sum(weight) FILTER (NOT is_full) OVER g) END::BIGINT AS budget FROM f2
  WINDOW g AS (PARTITION BY domain_)),
l3 AS (SELECT l.*, 1 AS weight, budget FROM leaves l JOIN p2 USING (domain_, lang_)),
f3 AS (SELECT *, cap * (sum(weight) OVER (PARTITION BY domain_, lang_) - coalesce(sum(weight) OVER o, 0)) <= weight * (budget - coalesce(sum(cap) OVER o, 0)) AS is_full FROM l3
  WINDOW o AS (PARTITION BY domain_, lang_ ORDER BY cap / weight, weight, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p3 AS (SELECT domain_, lang_, source_, tokens, CASE WHEN is_full THEN cap ELSE greatest(0, (weight * (budget - coalesce(sum(cap) FILTER (is_full) OVER g, 0))) // sum(weight) FILTER (NOT is_full) OVER g) END::BIGINT AS part FROM f3
  WINDOW g AS (PARTITION BY domain_, lang_)),
placed AS (SELECT r.*, part // tokens AS whole, part % tokens AS rest, md5('17:' || (part // tokens) || ':' || coalesce(doc_id::VARCHAR, '(none)')) AS place
  FROM rows_ r JOIN p3 USING (domain_, lang_, source_)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain_, lang_, source_ ORDER BY place, doc_id, text ROWS UNBOUNDED PRECEDING) AS so_far FROM placed)
SELECT doc_id, domain_, lang_, source_, n_tokens::BIGINT AS n_tokens, unnest(range(whole + (so_far <= rest)::INT))::BIGINT AS epoch_ FROM summed
"""


def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: _span(s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id IS DISTINCT FROM min(doc_id) OVER (PARTITION BY t), false)::INT AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN l USING (doc_id)),
n AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, s.step::INT AS step, bits[s.step] AS bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
parts AS (SELECT DISTINCT part FROM n),
o AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER ((mask & (bit | before)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & before) = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & before) <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (good = 1 AND (mask & bit) <> 0 AND (mask & before) = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (toxic = 1 AND (mask & bit) <> 0 AND (mask & before) = 0), 0)::BIGINT AS toxic_lost
  FROM parts JOIN n USING (part), steps GROUP BY part, filter_order, step, bit, before)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM o
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "documents"))


def _digest_sql(text: str) -> str:
    """SQL of a row's leaf, with this expression in place of its text."""
    parts = [f"coalesce(octet_length(encode({x})) || ':' || {x}, '-')" for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(parts)})"


def _levels_sql(name: str, leaves: str) -> str:
    """SQL of all levels of the trees over ``leaves`` (tree, rank, digest), as (tree, level, rank, digest, n)."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, rank, digest, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL
  SELECT tree, any_value(level) + 1, rank // 16, sha256(string_agg(digest, '' ORDER BY rank)), any_value((n + 15) // 16) FROM {name} WHERE n > 1 GROUP BY tree, rank // 16)"""


def _fold_sql(steps: str, first: str, wanted: str) -> str:
    """SQL of the siblings, joined, of each node of ``wanted`` (id, tree, rank) up its tree, and of the node that follows from ``first``."""
    return f"""
  SELECT w.id, w.tree, 0 AS level, w.rank, '' AS proof, w.{first} AS node FROM {wanted} w
  UNION ALL
  SELECT p.id, p.tree, p.level + 1, p.rank // 16, p.proof || coalesce(array_to_string(list_concat(r.digests[1:p.rank % 16], r.digests[p.rank % 16 + 2:]), ''), ''),
    sha256(coalesce(array_to_string(r.digests[1:p.rank % 16], ''), '') || p.node || coalesce(array_to_string(r.digests[p.rank % 16 + 2:], ''), ''))
  FROM {steps} p JOIN {wanted}_runs r ON r.tree = p.tree AND r.level = p.level AND r.run = p.rank // 16"""


OP12_SQL = f"""
WITH RECURSIVE
crc AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
d AS (SELECT row_number() OVER () AS id, doc_id, source, {_digest_sql("text")} AS leaf,
    CASE WHEN crc % 5 = 0 THEN {_digest_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_digest_sql("text")} END AS given
  FROM documents LEFT JOIN crc USING (doc_id)),
src AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
low AS (SELECT id, doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, leaf AS digest, given FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
{_levels_sql("nodes", "low")},
subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
high AS (SELECT 0 AS tree, tree AS rank, tree AS id, digest FROM subroots),
{_levels_sql("tops", "high")},
low_runs AS (SELECT tree, level, rank // 16 AS run, list(digest ORDER BY rank) AS digests FROM nodes WHERE n > 1 GROUP BY ALL),
high_runs AS (SELECT tree, level, rank // 16 AS run, list(digest ORDER BY rank) AS digests FROM tops WHERE n > 1 GROUP BY ALL),
up AS ({_fold_sql("up", "given", "low")}),
up_source AS (SELECT id, tree AS source_tree, proof, node FROM up QUALIFY level = max(level) OVER (PARTITION BY id)),
high_given AS (SELECT DISTINCT source_tree || ':' || node AS id, 0 AS tree, source_tree AS rank, node AS given FROM up_source),
high_given_runs AS (SELECT * FROM high_runs),
further AS ({_fold_sql("further", "given", "high_given")}),
over AS (SELECT id, proof, node FROM further QUALIFY level = max(level) OVER (PARTITION BY id)),
root AS (SELECT digest FROM tops WHERE n = 1)
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, root.digest AS root, sha256(u.proof || o.proof) AS proof_sha256, o.node AS folded_root, o.node = root.digest AS verified
FROM low l JOIN up_source u USING (id) JOIN over o ON o.id = u.source_tree || ':' || u.node JOIN subroots s ON s.tree = l.tree, root
"""


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
first AS (SELECT key, min(doc_id) AS least FROM k WHERE len(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) > 1),
m AS (SELECT k.*, least IS NOT NULL AND doc_id IS DISTINCT FROM least AS dropped FROM k LEFT JOIN first USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r
"""


def queries() -> dict:
    found = (
        op1_quality, op2_packing, op3_topk, op4_lm, op5_toxicity, op6_sanitise, op7_mixing, op8_weighted_sampling, op9_secrets, op10_simhash,
        op11_filter_audit, op12_merkle_manifest, op13_line_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op7_mixing": OP7_SQL, "op11_filter_audit": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_line_dedup": OP13_SQL}
