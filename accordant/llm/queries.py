"""Registered queries over the operators of this folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm import bpe, fill_middle, html_text, line_dedup, near_docs, near_vectors, packing, repeats, secrets, token_files, topk, toxicity, turn_repair
from accordant.llm.common import keep, shared_uri, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def vocab_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    both = bpe.encode(docs, vocab_path(), decoded_col="decoded")
    return both.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into sequences of 2048."""
    return packing.pack(table(spark, sf, "documents"), vocab_path())


@query
def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written to token files and read back from them."""
    folder = shared_uri(spark, "token-files")
    manifest = keep(token_files.write(table(spark, sf, "documents"), folder, vocab_path()), "token-manifest")
    return token_files.read(manifest)


@query
def op3_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Five best inner products for every 50th vector against all."""
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op3_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s
QUALIFY rank <= 5
"""


@query
def op2_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Links, component and survivor of every vector at cosine 0.9."""
    return near_vectors.near_vectors(table(spark, sf, "embeddings"))


ORACLE["op2_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), r(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, least(a, min(b)) AS root FROM r GROUP BY a
), k AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, coalesce(c.root, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.root, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""


@query
def op7_near_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Shingles, component and survivor of every document at similarity 0.75."""
    return near_docs.near_docs(table(spark, sf, "documents"))


ORACLE["op7_near_docs"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, max(a.n) AS na, max(b.n) AS nb, count(*) AS k FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM c WHERE 100 * k >= 75 * (na + nb - k)
), r(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (
  SELECT a, least(a, min(b)) AS root FROM r GROUP BY a
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id, s.doc_id = coalesce(m.root, s.doc_id) AS kept
FROM s LEFT JOIN m ON m.a = s.doc_id
"""


@query
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document, learnt outside the held-out fold."""
    return toxicity.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op4_html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf, "pages"))


@query
def op10_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of every document, judged by who owns them."""
    return secrets.digest(secrets.scan(table(spark, sf, "documents")))


@query
def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without lines that resemble an earlier one."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


@query
def op13_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    """Every document cut for filling in its middle, and what is rebuilt from that."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    made = fill_middle.fill_in_middle(docs)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(), 256).alias("restored_sha256"),
    )


ORACLE["op13_fill_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, CAST(len(t) AS BIGINT) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, coalesce(array_to_string(t[1:a], ''), '') AS x, coalesce(array_to_string(t[a + 1:b], ''), '') AS y, coalesce(array_to_string(t[b + 1:n], ''), '') AS z FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query
def op11_turn_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    found = turn_repair.summary(turn_repair.repair(turn_repair.damage(turns)))
    every = turns.select("conv_id").distinct()
    joined = every.join(found, every["conv_id"].eqNullSafe(found["conv"]), "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in turn_repair.SUMMARY],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )


@query
def op12_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the passages of 100 bytes that stand earlier."""
    found = repeats.drop_repeats(table(spark, sf, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
