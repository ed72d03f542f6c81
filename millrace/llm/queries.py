"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, decontaminate, divergence, grading, html, laesa, minhash, pii, rules, simhash, substring, warc
from millrace.llm.shared import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(texts(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(texts(spark, sf_dir))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(spread(table(spark, sf_dir, "pages")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(texts(spark, sf_dir), tokenizer_file())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(texts(spark, sf_dir)).drop("class_distance", "word_distance")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(texts(spark, sf_dir), tokenizer_file())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return grading.scored(docs, grading.train(docs, table(spark, sf_dir, "labels")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(texts(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spread(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(texts(spark, sf_dir))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(texts(spark, sf_dir))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laesa.clusters(spread(table(spark, sf_dir, "embeddings"))).drop("measured")


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_html": op3_html,
    "op4_bpe": op4_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_warc": op10_warc,
    "op11_minhash": op11_minhash,
    "op12_divergence": op12_divergence,
    "op13_clusters": op13_clusters,
}


def distance_sql(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts; null if one is empty."""
    share = lambda x: f"({x}[i] / nullif(list_sum({x}), 0))"
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({share(p)} + {share(q)}) / 2)) ELSE 0 END"
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part(share(p))} + {part(share(q))})) / 2, 0))"


def rules_sql() -> str:
    listed = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in rules.COMMON.items())
    width = max(map(len, rules.COMMON.values())) + 1
    sums = lambda name, n: "[" + ", ".join(f"coalesce(sum({name}[{i}]), 0)" for i in range(1, n + 1)) + "]"
    return rf"""
WITH d AS (
  SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, CASE lang {listed} END AS listed
  FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)
), g AS (
  SELECT doc_id, a, w[a] AS x, w[a + 1] AS y, w[a + 2] AS z FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS a FROM d WHERE len(w) >= 3)
), r AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(a, a + 3)) AS pos FROM (SELECT doc_id, a FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x, y, z) > 1)) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, lang, listed, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, length(t) AS chars, length(regexp_replace(t, '\P{{L}}', '', 'g')) AS letters,
    length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS capitals, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, list_transform(listed, lambda k: len(list_filter(w, lambda x: x = k))::DOUBLE) AS met
  FROM d LEFT JOIN r USING (doc_id)
), h AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [(letters - capitals)::DOUBLE, capitals, digits, chars - word_chars, n_symbols, chars - letters - digits - (chars - word_chars) - n_symbols] AS classes, CASE WHEN listed IS NULL THEN [] ELSE list_append(met, n_words - list_sum(met)) END AS commons FROM c
), q AS (
  SELECT lang, {sums("classes", 6)} AS class_ref, {sums("commons", width)} AS word_ref FROM h WHERE NOT base_failed GROUP BY lang
), j AS (
  SELECT h.*, class_ref, word_ref[1 : len(commons)] AS word_ref FROM h LEFT JOIN q ON h.lang IS NOT DISTINCT FROM q.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (chars < {rules.MIN_CHARS} OR coalesce({distance_sql("classes", "class_ref")}, 0) <= {rules.MAX_CLASS}) AND (len(commons) = 0 OR n_words < {rules.MIN_COMMON} OR coalesce({distance_sql("commons", "word_ref")}, 0) <= {rules.MAX_WORD}) AS kept
FROM j"""


def clusters_sql() -> str:
    """Every distance in full, round by round."""
    distance = f"list_sum(list_transform(range(1, {laesa.SIZE + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    met = lambda k: f"(SELECT v.id, v.x, c.k, {distance} AS d FROM v, c{k} c QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY d, c.k) = 1)"
    floor = "CASE WHEN s % n < 0 THEN (s - s % n - n) // n ELSE (s - s % n) // n END"
    rounds = "".join(
        f"""), s{k} AS (
  SELECT k, pos, sum(x[pos]) AS s, count(*) AS n FROM (SELECT k, x, unnest(range(1, {laesa.SIZE + 1})) AS pos FROM {met(k - 1)}) GROUP BY k, pos
), c{k} AS (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{k - 1} c LEFT JOIN (SELECT k, list(CAST({floor} AS BIGINT) ORDER BY pos) AS x FROM s{k} GROUP BY k) m ON c.k = m.k
"""
        for k in range(1, laesa.ROUNDS + 1)
    )
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: CAST(floor({laesa.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {laesa.SIZE} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS k, x FROM v QUALIFY k < {laesa.CLUSTERS}
{rounds}), a AS (
  SELECT id, k, d FROM {met(laesa.ROUNDS)}
)
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a JOIN v USING (id) JOIN c{laesa.ROUNDS} c ON c.k = a.k"""


ORACLES: dict[str, str] = {
    "op13_clusters": clusters_sql(),
    "op11_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM d
), u AS (
  SELECT s, len(s) AS n, min(doc_id) AS id FROM s WHERE len(s) > 0 GROUP BY s
), e AS (
  SELECT id, n, unnest(s) AS x FROM u
), f AS (
  -- two sets of this similarity share one of their rarest fifths
  SELECT id, n, x FROM e JOIN (SELECT x, count(*) AS held FROM e GROUP BY x) USING (x) QUALIFY row_number() OVER (PARTITION BY id ORDER BY held, x) <= n - (80 * n + 99) // 100 + 1
), p AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM f a JOIN f b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), l AS (
  SELECT a, b FROM p JOIN u x ON x.id = a JOIN u y ON y.id = b WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))
), sides AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT id AS a, id AS b FROM u UNION SELECT r.a, t.b FROM reach r JOIN sides t ON r.b = t.a
), g AS (
  SELECT a AS id, min(b) AS root FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(g.root, s.doc_id) AS component_id, s.doc_id = coalesce(g.root, s.doc_id) AS kept
FROM s LEFT JOIN u ON s.s = u.s LEFT JOIN g ON g.id = u.id""",
    "op12_divergence": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (
  SELECT lang, source, doc_id, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30
), v AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT x.lang, x.source, coalesce(s.n, 0) AS n, coalesce(v.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s USING (lang, source) LEFT JOIN v ON v.lang = x.lang
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) AS p, 1 + (1000000000 * (k.n + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source AS x, b.source AS y, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) s ON s.lang = a.lang AND s.x = a.source AND s.y = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM f QUALIFY part = 'pair' OR rank <= 50""",
    "op5_quality_rules": rules_sql(),
    "op7_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), im AS (
  SELECT item_id, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0
), ip AS (
  SELECT DISTINCT item_id, m, array_to_string(w[a : a + m - 1], ' ') AS p FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS a FROM im)
), dp AS (
  SELECT doc_id, m, a, array_to_string(w[a : a + m - 1], ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS a FROM d, (SELECT DISTINCT m FROM im) WHERE len(w) >= m)
), h AS (
  SELECT doc_id, item_id, a, m FROM dp JOIN ip USING (m, p)
), n AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + m)) AS pos FROM (SELECT DISTINCT doc_id, a, m FROM h)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op9_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, a, md5(array_to_string(w[a : a + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS a FROM d WHERE len(w) >= 50)
), f AS (
  SELECT k, min(doc_id) AS low FROM p GROUP BY k HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, a + 50)) AS at FROM p JOIN f USING (k) WHERE doc_id > low
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d
), kept AS (
  SELECT each.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY each.at) AS words FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.at = gone.at GROUP BY each.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op10_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages
), m AS (
  SELECT h, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY h
)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN last IS NOT NULL AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h
""",
}
