"""The queries of this subpackage: thin digests of its operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import licences, packing, pieces, pii, simhash, substrings, toxicity, vectors, warc
from tessera.llm.common import table

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to
FROM q
"""


def _op3_sql() -> str:
    values = ", ".join(f"({j}, '{name}', '{text.lower().replace(chr(39), chr(39) * 2)}')" for j, (name, text) in enumerate(licences.TEMPLATES))
    return rf"""
WITH f AS (
  SELECT row_number() OVER () AS r, doc_id, concat_ws('/', source, CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR),
         CASE WHEN doc_id % 50 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END) AS path,
         doc_id % 50 = 0 AS named, lower(coalesce(text, '')) AS t FROM documents),
n AS (SELECT count(*) AS n FROM f),
df AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT r, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS w FROM f) GROUP BY w),
tpl(j, licence, body) AS (VALUES {values}),
tw AS (SELECT j, w, tf * (ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1.0) AS x
       FROM (SELECT j, w, count(*) AS tf FROM (SELECT j, unnest(regexp_extract_all(body, '[a-z0-9]+')) AS w FROM tpl) GROUP BY j, w)
       LEFT JOIN df USING (w) CROSS JOIN n),
tu AS (SELECT j, w, x / sqrt(sum(x * x) OVER (PARTITION BY j)) AS x FROM tw),
u AS (SELECT r, unnest(list_concat(list_concat(string_split(t, chr(10)),
             list_filter(string_split_regex(t, '
[^a-z0-9
]*
[^a-z0-9]*'), lambda p: contains(p, chr(10)))), CASE WHEN named THEN [t] ELSE [] END)) AS body FROM f),
v AS (SELECT row_number() OVER () AS k, r, body FROM u),
vw AS (SELECT k, r, w, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS x
       FROM (SELECT k, r, w, count(*) AS tf FROM (SELECT k, r, unnest(regexp_extract_all(body, '[a-z0-9]+')) AS w FROM v) GROUP BY k, r, w)
       JOIN df USING (w) CROSS JOIN n),
size AS (SELECT k, r, sqrt(sum(x * x)) AS size FROM vw GROUP BY k, r),
dot AS (SELECT k, j, sum(vw.x * tu.x) AS d FROM vw JOIN tu USING (w) GROUP BY k, j),
best AS (SELECT r, j, round(d / size, 9) AS c, row_number() OVER (PARTITION BY r ORDER BY round(d / size, 9) DESC, j) AS p FROM dot JOIN size USING (k)),
own AS (SELECT f.r, f.doc_id, f.path, f.named, tpl.licence, best.c AS similarity
        FROM f LEFT JOIN best ON best.r = f.r AND best.p = 1 AND best.c >= {licences.THRESHOLD} LEFT JOIN tpl USING (j)),
held AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, licence, path,
         row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY similarity DESC, path) AS p FROM own WHERE named AND licence IS NOT NULL),
above AS (SELECT r, i, array_to_string(string_split(path, '/')[1 : i], '/') AS dir FROM (SELECT r, path, unnest(range(0, len(string_split(path, '/')))) AS i FROM own WHERE licence IS NULL)),
heirs AS (SELECT r, held.licence, held.path, row_number() OVER (PARTITION BY r ORDER BY i DESC) AS p FROM above JOIN held ON held.dir = above.dir AND held.p = 1)
SELECT own.doc_id, own.path, coalesce(own.licence, heirs.licence) AS licence, own.similarity,
       CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN heirs.licence IS NOT NULL THEN 'inherited' END AS via, heirs.path AS inherited_from
FROM own LEFT JOIN heirs ON heirs.r = own.r AND heirs.p = 1
"""


OP1_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d),
k AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) AS h FROM s),
rep AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM k WHERE h IN (SELECT h FROM rep)),
g AS (SELECT doc_id, list(p) AS ps FROM cov GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(coalesce(ps, [])) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(ps, j)), lambda j: w[j]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
OP8_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r AS q, c.r AS c, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.substring_dedup(table(spark, sf_dir, "documents"), window=35)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=3, width=3, seed=42)
    return out.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def licence_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: by source and thousands of ids, every fiftieth a licence file."""
    block = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"))
    name = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", block, name).alias("path"), "text")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(licence_paths(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(toxicity.fold() != 1))
    out = toxicity.scores(docs.select("doc_id", "text"), model).drop("text")
    return out.select(
        "doc_id",
        F.coalesce(toxicity.fold() == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.one_bit_search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.kd_search(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256.0)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)
    return out.withColumnRenamed("id", "doc_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op3_licences": _op3_sql(), "op8_kd_search": OP8_SQL, "op9_warc": OP9_SQL}
