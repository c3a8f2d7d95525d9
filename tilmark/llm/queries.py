"""Queries over whole tables, one per operator, and their SQL where SQL can state the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilmark.llm import embedding_dedup as ed
from tilmark.llm import language_id as li
from tilmark.llm import license_scan as ls
from tilmark.llm import decontaminate as dc
from tilmark.llm import mixing as mx
from tilmark.llm import near_dedup as nd
from tilmark.llm import quality as qu
from tilmark.llm import secret_scan as ss
from tilmark.llm import sharding as sh
from tilmark.llm import textvec as tv
from tilmark.llm import token_links as tl
from tilmark.llm import token_scan as ts
from tilmark.llm import vector_codes as vc
from tilmark.llm import warc
from tilmark.llm.runtime import owned, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ls.license_scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    method = F.transform("matches", lambda m: m["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, method)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))).alias("score"),
    )


def _op1_sql() -> str:
    phrase_rows = ", ".join(f"({p.split()!r}, '{label}')" for p, label in ls.PHRASES)
    template_rows = ", ".join(f"({sorted(set(t.split()))!r}, '{label}', {ls.step_of(t)})" for t, label in ls.TEMPLATES)
    steps = ", ".join(f"({step})" for step in sorted({ls.step_of(t) for t, _ in ls.TEMPLATES}))
    pattern = ls.WORD
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{ls.UPPER}', '{ls.LOWER}'), '{pattern}') AS w FROM documents
), phrases(p, label) AS (VALUES {phrase_rows}), templates(t, label, step) AS (VALUES {template_rows}), steps(step) AS (VALUES {steps}),
places AS (
  SELECT k, i AS start, label FROM docs, phrases, unnest(range(0, len(w))) AS u(i) WHERE w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p
), base AS (
  SELECT k, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY k
), blocks AS (
  SELECT k, step, list_distinct(w[b + 1 : b + 2 * step]) AS s FROM docs, steps, unnest(range(0, len(w), step)) AS u(b)
), scored AS (
  SELECT k, label, len(list_intersect(s, t)) / len(t) AS c, len(list_intersect(s, t)) >= ceil({ls.THRESHOLD} * len(t) - 1e-9) AS ok FROM blocks JOIN templates USING (step)
), method AS (SELECT k, max(c) AS c FROM scored WHERE ok GROUP BY k),
named AS (
  SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT k, label FROM places UNION SELECT k, label FROM scored WHERE ok) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END AS DOUBLE) AS score
FROM docs LEFT JOIN base USING (k) LEFT JOIN method USING (k) LEFT JOIN named USING (k)
"""


@owned
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.count_tokens(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@owned
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nd.near_duplicates(table(spark, sf_dir, "documents"))


def _components_sql(links: str, nodes: str) -> str:
    """CTEs reach and named (k, c): the smallest node that each node of nodes(k) reaches over links(a, b)."""
    return f"""sides AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
reach(k, c) AS (SELECT k, k FROM {nodes} UNION SELECT sides.b, reach.c FROM reach JOIN sides ON sides.a = reach.k WHERE sides.b > reach.c),
named AS (SELECT k, min(c) AS c FROM reach GROUP BY k)"""


def _op4_sql() -> str:
    """Exact bags of all pairs that share a shingle."""
    return f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{tv.WORD.pattern}') AS w FROM documents),
held AS (SELECT k, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {tv.SHINGLE} THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - {tv.SHINGLE - 2}), lambda i: array_to_string(w[i : i + {tv.SHINGLE - 1}], ' ')) END) AS s FROM docs),
bags AS (SELECT k, s, count(*) AS n FROM held GROUP BY ALL), sizes AS (SELECT k, sum(n) AS size FROM bags GROUP BY k),
common AS (SELECT x.k AS a, y.k AS b, sum(least(x.n, y.n)) AS common FROM bags x JOIN bags y ON x.s = y.s AND x.k < y.k GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.k = a JOIN sizes q ON q.k = b WHERE 5 * common >= 4 * (p.size + q.size - common)),
{_components_sql("links", "docs")}
SELECT d.doc_id, first.doc_id AS class_id, d.doc_id = first.doc_id AS kept FROM docs d JOIN named USING (k) JOIN docs first ON first.k = named.c
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = qu.score_texts(documents, qu.train_on(documents, table(spark, sf_dir, "labels")))
    held = qu.held_out(F.col("doc_id"), qu.FOLDS, qu.FOLD)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= qu.CUT).cast("int").alias("predicted"))


@owned
def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.mix_words(table(spark, sf_dir, "documents")).withColumn("by_shard", F.array_join(F.col("by_shard").cast("array<string>"), ","))


def _draw_sql(u: str, own: str, everything: str, wanted: str) -> str:
    """mixing.hypergeometric in SQL, by lists."""
    rest = "(z.n - z.q)"
    reach = f"{mx.SPREAD} * sqrt(z.w * z.q / z.n + 1)"
    low = f"CAST(greatest(0, z.w - {rest}, floor(z.w * z.q / z.n - {reach})) AS BIGINT)"
    high = f"CAST(least(z.q, z.w, ceil(z.w * z.q / z.n + {reach})) AS BIGINT)"
    log = f"-lgamma(k + 1.0::DOUBLE) - lgamma(z.q - k + 1.0::DOUBLE) - lgamma(z.w - k + 1.0::DOUBLE) - lgamma({rest} - z.w + k + 1.0::DOUBLE)"
    logs = f"list_transform(range({low}, {high} + 1), lambda k: {log})"
    count = f"list_transform([list_transform([{logs}], lambda g: list_transform(g, lambda x: exp(x - list_max(g))))[1]], lambda e: len(list_filter(range(1, len(e) + 1), lambda j: list_sum(e[1:j]) < z.u * list_sum(e))))[1]"
    bound = f"{{'u': {u}, 'q': {own}, 'n': {everything}, 'w': {wanted}}}"
    return f"list_transform([{bound}], lambda z: CASE WHEN z.q = 0 OR z.w = 0 THEN 0 ELSE {low} + {count} END)[1]"


def _tree_sql(shards: int) -> str:
    """CTEs from `root` (a row with the list l of quotas): leaf0, leaf1, ... (list l of each shard)."""
    parts = [f"rooms AS (SELECT list_transform(range({shards}), lambda j: list_sum(l) // {shards} + CASE WHEN j < list_sum(l) % {shards} THEN 1 ELSE 0 END) AS room FROM root)"]

    def split(node: int, name: str, a: int, b: int) -> None:
        if b - a == 1:
            parts.append(f"leaf{a} AS (SELECT l FROM {name})")
            return
        middle = (a + b) // 2
        u = f"CAST(('0x' || substr(md5('{mx.SEED}:{node}:' || (i - 1)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"
        draw = _draw_sql(u, "l[i]", "list_sum(l[i:])", "want - coalesce(list_sum(acc), 0)")
        left = f"list_reduce(range(1, len(l) + 1), lambda acc, i: list_append(acc, CAST({draw} AS BIGINT)), []::BIGINT[])"
        parts.append(f"draw{node} AS (SELECT l, {left} AS taken FROM (SELECT l, CAST(list_sum(room[{a + 1}:{middle}]) AS BIGINT) AS want FROM {name}, rooms))")
        parts.append(f"left{node} AS (SELECT taken AS l FROM draw{node})")
        parts.append(f"right{node} AS (SELECT list_transform(range(1, len(l) + 1), lambda i: l[i] - taken[i]) AS l FROM draw{node})")
        split(2 * node, f"left{node}", a, middle)
        split(2 * node + 1, f"right{node}", middle, b)

    split(1, "root", 0, shards)
    return ",\n".join(parts)


def _op6_sql() -> str:
    weight = "CASE " + " ".join(f"WHEN (n - 1) % {len(mx.WEIGHTS)} = {i} THEN {w}" for i, w in enumerate(mx.WEIGHTS)) + " END"
    digits = "CASE " + " ".join(f"WHEN r <= {mx.BLOCK_ROWS * 16**d} THEN {d}" for d in range(mx.MAX_DIGITS)) + f" ELSE {mx.MAX_DIGITS} END"
    leaves = " UNION ALL ".join(f"SELECT {j} AS j, l FROM leaf{j}" for j in range(mx.SHARDS))
    words = "CASE WHEN e < whole OR block < edge THEN size ELSE greatest(0, least(size, rest - before - pos)) END"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{mx.WORD}')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents
), sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, count(*) AS r FROM docs GROUP BY source),
named AS (SELECT source, s, r, n, {weight} AS w, {digits} AS digits FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sums)),
ordered AS (SELECT *, row_number() OVER (ORDER BY {mx.MAX_REPEATS} * s / w, source NULLS LAST) AS o FROM named),
levels AS (
  SELECT *, (sum(s) OVER () - coalesce(sum({mx.MAX_REPEATS} * s) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM ordered
), found AS (SELECT coalesce(min(o) FILTER (level <= {mx.MAX_REPEATS} * s / w), max(o)) AS o FROM levels),
goals AS (
  SELECT source, s, n, digits, least(w * (SELECT level FROM levels JOIN found USING (o)), CAST({mx.MAX_REPEATS} * s AS DOUBLE)) AS target FROM levels
), rounds AS (
  SELECT *, CASE WHEN s = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) // s END AS whole, CASE WHEN s = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) % s END AS rest FROM goals
), blocked AS (
  SELECT docs.*, rounds.* EXCLUDE (source), CASE WHEN digits = 0 THEN 0 ELSE CAST('0x' || substr(k, 1, digits) AS BIGINT) END AS block
  FROM docs JOIN rounds ON docs.source IS NOT DISTINCT FROM rounds.source
), heaps AS (SELECT n, block, rest, sum(size) AS words FROM blocked GROUP BY ALL),
upto AS (SELECT *, sum(words) OVER (PARTITION BY n ORDER BY block) AS upto FROM heaps),
edges AS (SELECT n, min(block) AS edge, min_by(upto - words, block) AS before FROM upto WHERE rest > 0 AND upto >= rest GROUP BY n),
quotas AS (
  SELECT rounds.*, coalesce(edge, 0) AS edge, coalesce(before, 0) AS before, CAST(whole * 16 ** digits AS BIGINT) + CASE WHEN rest > 0 THEN edge + 1 ELSE 0 END AS q FROM rounds LEFT JOIN edges USING (n)
), root AS (SELECT coalesce(list(CAST(q AS BIGINT) ORDER BY n), []) AS l FROM quotas), {_tree_sql(mx.SHARDS)},
shares AS (SELECT j, n, sum(l[n]) OVER (PARTITION BY n ORDER BY j) AS upto FROM ({leaves}), (SELECT n FROM quotas)),
ends AS (SELECT n, list(upto ORDER BY j) AS ends FROM shares GROUP BY n),
laid AS (
  SELECT d, doc_id, size, s, target, block, digits, whole, rest, edge, before, ends,
         coalesce(sum(size) OVER (PARTITION BY blocked.n, block ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM blocked JOIN (SELECT n, edge, before FROM quotas) USING (n) JOIN ends USING (n)
), drawn AS (
  SELECT *, len(list_filter(ends, lambda x: x <= e * CAST(16 ** digits AS BIGINT) + block)) AS j, {words} AS words FROM laid, unnest(range(0, whole + 1)) AS u(e)
), parts AS (SELECT d, j, CAST(sum(words) AS BIGINT) AS words FROM drawn WHERE j < {mx.SHARDS} GROUP BY ALL),
lists AS (SELECT d, list(coalesce(words, 0) ORDER BY j) AS by_shard FROM (SELECT d, j FROM laid, range({mx.SHARDS}) AS r(j)) LEFT JOIN parts USING (d, j) GROUP BY d)
SELECT doc_id, size, s AS source_size, CAST(target AS DOUBLE) AS target, CAST(list_sum(by_shard) AS BIGINT) AS taken, array_to_string(by_shard, ',') AS by_shard
FROM laid JOIN lists USING (d)
"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ss.secret_scan(table(spark, sf_dir, "documents"))
    ordered = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ss.KINDS[:3]],
        F.sha2(ordered(base), 256).alias("base_sha256"),
        ordered(F.col("spans")).alias("spans"),
    )


@owned
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.near_embeddings(table(spark, sf_dir, "embeddings"))


def _op8_sql() -> str:
    """All pairs of one label."""
    return f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), usable AS (
  SELECT k, label, v FROM rows WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.k AS a, y.k AS b FROM usable x JOIN usable y ON x.label = y.label AND x.k < y.k AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= {ed.THRESHOLD}
), {_components_sql("links", "rows")},
counts AS (SELECT a AS k, count(*) AS n FROM sides GROUP BY a)
SELECT r.vec_id, coalesce(n, 0) AS n_links, first.vec_id AS component_id, r.vec_id = first.vec_id AS kept
FROM rows r JOIN named USING (k) JOIN rows first ON first.k = named.c LEFT JOIN counts ON counts.k = r.k
"""


@owned
def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sh.place_records(table(spark, sf_dir, "documents"), store=sh.map_store(spark, f"documents:{sf_dir}"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = li.identify(documents, li.train_tagger(documents))
    return found.select("doc_id", li.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@owned
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vc.vector_codes(table(spark, sf_dir, "embeddings"))


def _op11_sql() -> str:
    """All distances of every part to every entry, round by round."""
    width = f"(len(v) // {vc.PARTS})"
    parts = [
        f"""kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor({vc.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT k, p, v[p * {width} + 1 : (p + 1) * {width}] AS x FROM kept, range({vc.PARTS}) AS r(p)),
book0 AS (SELECT p, k - 1 AS e, x AS c FROM parts WHERE k <= {vc.ENTRIES})"""
    ]
    for i in range(vc.ROUNDS + 1):
        gap = "list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j])))"
        parts.append(f"near{i} AS (SELECT k, p, min(({gap}, e)) AS d FROM parts JOIN book{i} USING (p) GROUP BY k, p)")
        if i < vc.ROUNDS:
            parts.append(
                f"""mean{i} AS (
  SELECT p, e, list(m ORDER BY j) AS c FROM (
    SELECT p, d[2] AS e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS m FROM near{i} JOIN parts USING (k, p), unnest(range(1, len(x) + 1)) AS u(j) GROUP BY ALL
  ) GROUP BY p, e
), book{i + 1} AS (SELECT p, e, coalesce(mean{i}.c, book{i}.c) AS c FROM book{i} LEFT JOIN mean{i} USING (p, e))"""
            )
    last = vc.ROUNDS
    ctes = ",\n".join(parts)
    return f"""
WITH {ctes},
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM book{last}),
coded AS (SELECT k, string_agg(printf('%02x', d[2]), '' ORDER BY p) AS code, CAST(sum(d[1]) AS BIGINT) AS error FROM near{last} GROUP BY k)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM kept JOIN coded USING (k), sha
"""


@owned
def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.token_links(table(spark, sf_dir, "documents"))


@owned
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def _op13_sql() -> str:
    """SHA-1 in base32 is not in SQL of its own: each five bits of the digest as a letter."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = "array_to_string(list_transform(range(1, 41), lambda i: right(bin(16 + CAST('0x' || h[i] AS INTEGER)), 4)), '')"
    text = f"array_to_string(list_transform(range(0, 32), lambda i: substr('{letters}', CAST(1 + list_sum(list_transform(range(1, 6), lambda j: CAST(b[5 * i + j] AS INTEGER) * (32 >> j))) AS BIGINT), 1)), '')"
    return f"""
WITH rows AS (SELECT page_id, strlen(coalesce(html, '')) AS n, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (SELECT *, {text} AS d FROM (SELECT *, {bits} AS b FROM rows)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS r, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS f FROM coded)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN f END AS refers_to FROM ranked
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1_sql(), "op4_near_dedup": _op4_sql(), "op6_mix": _op6_sql(), "op8_embedding_dedup": _op8_sql(), "op11_vector_codes": _op11_sql(), "op13_warc": _op13_sql()}
