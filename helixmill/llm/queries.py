"""The operators over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm import ann, exact_dedup, filter_audit, katz, kneser_ney, license_scan, line_dedup, minhash, mixing, packing, prefix_trie, secrets, vector_dedup
from helixmill.llm._shared import table


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.samples(spark, docs, table(spark, sf_dir, "labels")))).drop("found")


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", F.col("_kn_chars").alias("n_scored"), F.col("_kn_perplexity").alias("perplexity"), F.col("_kn_drawn").alias("drawn"), F.col("_kn_threshold").alias("threshold"), F.col("_kn_kept").alias("kept"))


def op7_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pieces(table(spark, sf_dir, "documents"), digest=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean(table(spark, sf_dir, "pages"))
    return cleaned.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.array_join("lines", "\n"), 256).alias("text_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_learned_partitions": op1_learned_partitions,
    "op2_katz_backoff": op2_katz_backoff,
    "op3_license_scan": op3_license_scan,
    "op4_source_mix": op4_source_mix,
    "op5_secret_scan": op5_secret_scan,
    "op6_kneser_ney_quality": op6_kneser_ney_quality,
    "op7_bbit_minhash": op7_bbit_minhash,
    "op8_cost_packing": op8_cost_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_vector_dedup": op12_vector_dedup,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE = {
    "op4_source_mix": r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rk, source_size * 2 AS full_size FROM by_source
), weighed AS (
  SELECT *, [5, 2, 1][(rk - 1) % 3 + 1] AS w, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS budget FROM ranked
), filled AS (
  SELECT *, row_number() OVER (ORDER BY CAST(full_size AS DOUBLE) / w, rk) AS pos,
    (budget - CAST(coalesce(sum(full_size) OVER (ORDER BY CAST(full_size AS DOUBLE) / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY CAST(full_size AS DOUBLE) / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS lvl
  FROM weighed
), level AS (
  SELECT min_by(lvl, pos) FILTER (WHERE lvl * w <= full_size) AS open_lvl FROM filled
), targets AS (
  SELECT source, source_size, least(CAST(full_size AS DOUBLE), coalesce(open_lvl * w, CAST(full_size AS DOUBLE))) AS target FROM filled, level
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.target / t.source_size AS rate,
    CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * CASE WHEN source_size > 0 THEN floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END ELSE 1 END AS BIGINT) AS taken
FROM rated""",
    "op9_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, coalesce(d.doc_id = g.keep_id, g.keep_id IS NULL) AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t""",
    "op10_line_dedup": r"""
WITH p AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '')) AS host,
    list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
        '(?i)<br[^>]*>|</?(?:p|div|li|ul|ol|h[1-6]|tr|table|nav|article|section|header|footer|title)(?:\s[^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)),
      lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages
), hosts AS (
  SELECT host, count(*) AS pages FROM p GROUP BY host
), counts AS (
  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line
), gone AS (
  SELECT c.host, list(c.line) AS gone FROM counts c JOIN hosts h ON c.host = h.host WHERE c.n > 1 AND c.n / h.pages > CAST(0.3 AS DOUBLE) GROUP BY c.host
), kept AS (
  SELECT page_id, p.host, lines, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(gone, x)) END AS kept FROM p LEFT JOIN gone ON p.host = gone.host
)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS text_sha256
FROM kept""",
    "op11_prefix_trie": r"""
WITH RECURSIVE table_of AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS crcs FROM range(256) r(b)
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda crc, b: xor(crc >> 8, crcs[1 + (xor(crc, b) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h
  FROM t, table_of
), rows AS (
  SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base WHERE t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.pos > c.h
), keyed AS (
  SELECT conv_id, row_number() OVER w AS d, string_agg(md5(role) || md5(text), '') OVER w AS k, CAST(length(text) AS BIGINT) AS points FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), lengths AS (
  SELECT conv_id, max(d) AS length FROM keyed GROUP BY conv_id
), nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(points) AS points, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = length), '') AS ends
  FROM keyed JOIN lengths USING (conv_id) GROUP BY k, d
), kids AS (
  SELECT n.k, count(x.k) AS n_children FROM nodes n LEFT JOIN nodes x ON x.d = n.d + 1 AND left(x.k, 64 * n.d) = n.k GROUP BY n.k
), above AS (
  SELECT a.k, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n.n_convs - 1) * n.points) AS BIGINT) AS saved_tokens
  FROM nodes n JOIN kids USING (k) JOIN keyed a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.k
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN kids USING (k) JOIN above USING (k) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = left(n.k, 64 * (n.d - 1))""",
    "op12_vector_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fine AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.9
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(v.vec_id, m) AS component_id, v.vec_id = least(v.vec_id, m) AS kept
FROM v LEFT JOIN counted c ON c.a = v.vec_id LEFT JOIN least l ON l.a = v.vec_id""",
    "op13_filter_audit": r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), judged AS (
  SELECT doc_id, part, concat(
    CASE WHEN len(w) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails
  FROM words
), said AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM judged LEFT JOIN said USING (doc_id) GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT part, fails, n, good, bad, o, step, substr(o, step, 1) AS f, contains(fails, substr(o, step, 1)) AS here,
    len(list_filter(string_split(substr(o, 1, step - 1), ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS earlier
  FROM cells, orders, (SELECT unnest(range(1, 6)) AS step)
), summed AS (
  SELECT part, o, step, f, sum(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN here AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT earlier THEN bad ELSE 0 END) AS toxic_lost
  FROM steps GROUP BY part, o, step, f
)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed""",
}
