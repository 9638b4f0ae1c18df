"""The thin queries over the tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact_dedup, kdtree, licenses, media, packing, pieces, pii, quality, sharding, simhash, suffix_dedup, trie
from .common import documents

SHARDS = 24


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"), pii.train(spark))
    counts = [f"n_{kind}" for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_text(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (quality.fold_of() == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    print16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), print16.alias("fingerprint"), "component_id")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = kdtree.scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return kdtree.top_k(vectors, vectors.where("id % 20 = 0"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(
        "doc_id", "source",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    dealt = sharding.interleave(rows, SHARDS, key="doc_id")
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_repeats(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLES: dict[str, str] = {
    "op13_prefix_trie": """
        WITH crc AS (
          SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)),
            lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
        ), own AS (
          SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, s) AS i, chars, s
          FROM (SELECT conv_id AS c, turn, length(coalesce(text, '')) AS chars,
                       sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL)
        ), n AS (SELECT c, max(i) AS n, list_transform(regexp_extract_all(hex(encode(CAST(c AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM own GROUP BY c),
        h AS (SELECT c, n, c - c % 100 AS lead,
                     xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 6 AS h FROM n, crc),
        m AS (SELECT a.c, a.n, a.lead, a.h, least(a.h, coalesce(b.n, 0)) AS head FROM h a LEFT JOIN h b ON a.lead = b.c),
        turns AS (SELECT m.c, own.i AS d, s, chars FROM m JOIN own ON own.c = m.lead AND own.i <= m.h
                  UNION ALL SELECT m.c, own.i - m.h + m.head, s, chars FROM m JOIN own ON own.c = m.c AND own.i > m.h),
        k AS (SELECT c, d, chars, string_agg(s, ',') OVER (PARTITION BY c ORDER BY d) AS k FROM turns UNION ALL SELECT c, 0, 0, '' FROM m),
        up AS (SELECT c, d, chars, k, lag(k) OVER (PARTITION BY c ORDER BY d) AS p, d = max(d) OVER (PARTITION BY c) AS last FROM k),
        nodes AS (SELECT k, min(c) AS conv_id, max(d) AS d, max(p) AS p, max(chars) AS chars, count(*) AS n,
                         string_agg(CASE WHEN last THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends FROM up GROUP BY k),
        kids AS (SELECT p, count(*) AS n FROM nodes WHERE p IS NOT NULL GROUP BY p),
        sub AS (SELECT a.k, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((u.n - 1) * u.chars) AS saved
                FROM nodes u JOIN up a ON a.c = u.conv_id AND a.d <= u.d LEFT JOIN kids ON kids.p = u.k GROUP BY a.k)
        SELECT nodes.conv_id, nodes.d AS depth, up_.conv_id AS parent_conv_id, nodes.n AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
               CAST(sub.leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(nodes.ends, '')) AS ends_sha256
        FROM nodes JOIN sub USING (k) LEFT JOIN kids ON kids.p = nodes.k LEFT JOIN nodes up_ ON up_.k = nodes.p
    """,
    "op12_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
        v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS words, CAST(sum(n) AS HUGEINT) AS n FROM kept GROUP BY lang),
        c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY w.lang, w.source, w.term),
        groups AS (SELECT DISTINCT lang, source FROM d),
        sized AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS n FROM groups g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
        p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (s.n + v.words) AS p
              FROM sized s JOIN kept k ON s.lang = k.lang JOIN v ON s.lang = v.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
        q AS (SELECT k.lang, k.term, 1 + 1000000000 * (k.n + 1) // (v.n + v.words) AS q FROM kept k JOIN v ON k.lang = v.lang),
        far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
                  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        terms AS (SELECT p.lang, p.source, p.term AS item, CAST((p.p - q.q) * (p.p - q.q) // q.q AS BIGINT) AS value
                  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
        said AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM said)
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
    """,
    "op11_exact_dedup": """
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\t\\n\\x0b\\x0c\\r ]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS n,
                     row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS place FROM d)
        SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM g
    """,
    "op1_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT k, s, len(h) // 2 - 399 AS n, substring(h, 2 * s + 1, 1598) AS part
              FROM (SELECT k, h, unnest(range(0, len(h) // 2 - 399, 400)) AS s FROM d WHERE len(h) >= 800)),
        w AS (SELECT k, s + p AS p, md5(substring(part, 2 * p + 1, 800)) AS m FROM (SELECT k, s, part, unnest(range(0, least(400, n - s))) AS p FROM c)),
        r AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
        hit AS (SELECT k, p, p - lag(p) OVER (PARTITION BY k ORDER BY p) AS gap FROM w SEMI JOIN r USING (m)),
        run AS (SELECT k, p, sum(CASE WHEN gap IS NULL OR gap > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY p) AS g FROM hit),
        span AS (SELECT k, g, min(p) AS a, max(p) + 400 AS b FROM run GROUP BY k, g),
        cut AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM span),
        kept AS (SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
                        string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
                 FROM cut JOIN d USING (k) GROUP BY k),
        words AS (SELECT row_number() OVER () AS k, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS owner,
                         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\t\\n\\x0b\\x0c\\r ]+'), lambda x: x <> '') AS ws FROM documents),
        said AS (SELECT k, owner, p, md5(array_to_string(ws[p + 1 : p + @N@], ' ')) AS m FROM (SELECT k, owner, ws, unnest(range(0, len(ws) - @N@ + 1)) AS p FROM words)),
        again AS (SELECT m FROM said GROUP BY m HAVING min(owner) < max(owner)),
        there AS (SELECT k, p, p - lag(p) OVER (PARTITION BY k ORDER BY p) AS gap FROM said SEMI JOIN again USING (m)),
        part AS (SELECT k, p, sum(CASE WHEN gap IS NULL OR gap > @N@ THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY p) AS g FROM there),
        passage AS (SELECT k, count(*) AS n, sum(n) AS words FROM (SELECT k, g, max(p) + @N@ - min(p) AS n FROM part GROUP BY k, g) GROUP BY k)
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(CASE WHEN head IS NULL THEN h ELSE head || substring(h, 2 * last + 1) END)) AS kept_sha256,
               CAST(coalesce(passage.n, 0) AS BIGINT) AS n_passages, CAST(coalesce(passage.words, 0) AS BIGINT) AS n_passage_words
        FROM d LEFT JOIN kept USING (k) LEFT JOIN passage USING (k)
    """.replace("@N@", str(suffix_dedup.WORDS)),
    "op9_sharding": f"""
        WITH crc AS (
          SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)),
            lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
        ), d AS (
          SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
                 list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes,
                 md5('{sharding.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest
          FROM documents
        ), s AS (
          SELECT doc_id, source, size, digest,
                 xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS text_crc32
          FROM d, crc
        ), r AS (
          SELECT *, (row_number() OVER (PARTITION BY source ORDER BY digest, doc_id, size, text_crc32) - 0.5::DOUBLE)
                    / count(*) OVER (PARTITION BY source) AS fraction
          FROM s
        ), p AS (
          SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, digest, doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS n FROM r
        )
        SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * {SHARDS} // n AS INTEGER) AS shard,
               CAST(place - (place * {SHARDS} // n * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM p
    """,
    "op2_license_scan": licenses.oracle(),
    "op8_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS q
          FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                 CAST(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
        ), r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_license_scan, op3_pii, op4_media_columns, op5_quality, op6_sentencepiece, op7_simhash, op8_top_k, op9_sharding, op10_best_fit_packing, op11_exact_dedup, op12_source_divergence, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
