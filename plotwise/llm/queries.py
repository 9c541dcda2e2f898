"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .centroids import centroid_clusters
from .cluster import small_batches
from .cover_tree import near_vectors
from .decontamination import overlaps
from .frames import read_frames, write_frames
from .html_text import extract_main_text
from .near_copies import near_copies
from .packing import pack_powers_of_two
from .resampling import importance_sample
from .substrings import drop_repeats
from .telephony import decode_media, media_table
from .token_counts import token_counts
from .toxicity import score_toxicity, train


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return score_toxicity(documents, train(documents, _table(spark, sf_dir, "labels")))


def op3_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_frames(write_frames(_table(spark, sf_dir, "documents"), vocabulary(), end_id=1))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary(), limit=2048)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features, and the resampled PCM itself as a column: what writes the result stores it."""
    return decode_media(media_table(_table(spark, sf_dir, "documents")), with_pcm=True)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", (F.col("n_removed") > 0).alias("has_repeat"), "removed", "text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_powers_of_two(_table(spark, sf_dir, "documents"), vocabulary(), end_id=1, longest=2048)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.score_quality(documents, quality.train(documents, _table(spark, sf_dir, "labels")))


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more among all vectors: how many each has, and its component."""
    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed towards the benchmark texts, a tenth of those of 20 words and more drawn."""
    return importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, percent=10, least=20, seed="2024")


def op13_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 16 clusters after three rounds."""
    return centroid_clusters(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64.0, seed="1")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_toxicity, op3_token_frames, op4_token_counts, op5_main_text, op6_decontamination, op7_telephony, op8_substring_dedup, op9_packing, op10_quality, op11_cover_tree, op12_resampling, op13_annulus_clusters)}

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: SQL for the operators whose results it can state; the others are tested against brute force, round trips or held-out rows.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS grams FROM d),
n AS (SELECT doc_id, len(grams) AS n, md5(array_to_string(list_sort(grams), '|')) AS h FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_ >= 85 * (p.n + q.n - both_)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id,
  CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY n, h) END AS class_id FROM n""",
    "op6_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
k AS (SELECT item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, j, j + k - 1), ' ') AS g FROM k, unnest(range(1, len(w) - k + 2)) AS t(j)),
dw AS (SELECT doc_id, ks.k AS k, j, array_to_string(list_slice(w, j, j + ks.k - 1), ' ') AS g FROM d, (SELECT DISTINCT k FROM iw) ks, unnest(range(1, len(w) - ks.k + 2)) AS t(j)),
hit AS (SELECT doc_id, j, dw.k AS k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
}

_DOUBLES = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLES["op11_cover_tree"] = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, {_DOUBLES} AS e FROM embeddings WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
out AS (SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id FROM embeddings)
SELECT *, vec_id = component_id AS kept FROM out"""

#: A CRC is a fold over bits: a byte enters with its first bit, then the register is shifted.
_BITS = "flatten(list_transform(range(CAST(octet_length(encode({w})) AS BIGINT)), lambda i: [CAST(concat('0x', substr(hex(encode({w})), 2 * i + 1, 2)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BITS}), lambda c, e: xor(xor(c, e) >> 1, CAST(3988292384 AS BIGINT) * (xor(c, e) & 1))), CAST(4294967295 AS BIGINT))"

ORACLES["op12_resampling"] = rf"""
WITH w AS MATERIALIZED (SELECT TRUE AS source, doc_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
  UNION ALL SELECT FALSE, item_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') FROM benchmark),
f AS MATERIALIZED (SELECT source, doc_id, word, count(*) AS n FROM (SELECT source, doc_id, unnest(w) AS word FROM w) GROUP BY ALL),
h AS MATERIALIZED (SELECT word, {_CRC.format(w="word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM f)),
b AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (source), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (NOT source), 0) AS DOUBLE) AS t FROM f JOIN h USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM b) + 10000) / ((s + 1) * ((SELECT sum(t) FROM b) + 10000)))) AS BIGINT) AS gain FROM b),
k AS (SELECT doc_id, sum(n * gain) AS weight FROM f JOIN h USING (word) JOIN g USING (bucket) WHERE source GROUP BY doc_id),
d AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('2024:', doc_id)), 1, 8)) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS gumbel FROM w LEFT JOIN k USING (doc_id) WHERE source),
r AS (SELECT doc_id, row_number() OVER (ORDER BY weight + gumbel DESC, doc_id) AS r FROM d WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + gumbel AS score, CASE WHEN r <= (SELECT count(*) FROM r) * 10 // 100 THEN r END AS rank FROM d LEFT JOIN r USING (doc_id)"""


def _rounds(turns: int) -> str:
    """The rounds of op13 in SQL: the nearest centroid by a window, exact floors of means."""
    far = "CAST(list_sum(list_transform(list_zip(p.x, {c}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    out = []
    for r in range(turns + 1):
        from_ = "p" if r == 0 else f"a{r - 1} p"
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, c, d FROM (SELECT vec_id, p.x AS x, c{r}.c AS c, {far.format(c=f'c{r}')} AS d FROM {from_}, c{r}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < turns:
            out.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, list(m ORDER BY i) AS x FROM (SELECT c, i, CAST((sum(v) - (sum(v) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
  FROM (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c UNION ALL SELECT c, x FROM c{r} WHERE c NOT IN (SELECT c FROM a{r}))""")
    return ",\n".join(out)


ORACLES["op13_annulus_clusters"] = f"""
WITH p AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {_FINITE} AND len(embedding) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('1:', vec_id))) - 1 AS c, x FROM p QUALIFY c < 16),
{_rounds(3)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.x, ',')) AS centroid_sha256 FROM a3 JOIN c3 USING (c)"""
