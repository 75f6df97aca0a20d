"""Registered queries of the corpus operators: thin wrappers over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import chat, decontaminate, language, licenses, pieces, pii, quality, simhash, substring, suffix
from quirefold.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect(table(spark, sf_dir, "documents"))
    terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<s:int,e:int,npmi:double>>")), lambda x: F.concat_ws(":", F.lit(pii.TERM), x["s"], x["e"]))
    base = F.when(F.col("base") != "", F.array("base")).otherwise(F.array().cast("array<string>"))
    return out.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(table(spark, sf_dir, "documents"), pieces.Model.load(pieces.MODEL_FILE), n=4)
    return out.select("doc_id", "n_pieces", F.get("nbest_scores", F.lit(0)).alias("best_score"), F.array_join(F.transform("nbest_scores", lambda x: x.cast("decimal(30,4)").cast("string")), ",").alias("nbest_scores"), "ids_sha256", F.array_join("nbest_sha256", ",").alias("nbest_sha256"), "round_trip")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation 2 i is the chosen one of pair i, conversation 2 i + 1 the rejected one."""
    turns = table(spark, sf_dir, "conversations")
    return chat.format_preferences(turns.withColumn("pair_id", F.expr("conv_id div 2")).withColumn("chosen", F.pmod("conv_id", F.lit(2)) == 0))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language.train(docs.where(F.col("doc_id").isNotNull() & ~language.held_out(F.col("doc_id"))))
    out = language.classify(docs, learned)
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), window=35, with_text=False)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).drop("row_key")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_earlier_repeats(table(spark, sf_dir, "documents"), window=100, with_kept=False)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_license_scan": op3_license_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_preference_format": op5_preference_format,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_language_id": op7_language_id,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_suffix_dedup": op10_suffix_dedup,
    "pipeline": pipeline,
}

_LEVELS = """
bins AS (SELECT lang, source, metric, v, CASE WHEN v < 128 THEN v ELSE (v >> (length(bin(v)) - 7)) + 64 * (length(bin(v)) - 7) END AS bin
  FROM (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS metric, unnest([m1, m2, m3, m4]) AS v FROM m WHERE NOT base_failed)),
cum AS (SELECT lang, source, metric, bin, CASE WHEN bin < 128 THEN bin ELSE ((bin - 64 * (bin // 64 - 1) + 1) << (bin // 64 - 1)) - 1 END AS top,
  count(*) OVER (PARTITION BY lang, source, metric) AS s1, count(*) OVER (PARTITION BY lang, source, metric ORDER BY bin) AS c1,
  count(*) OVER (PARTITION BY lang, metric) AS s2, count(*) OVER (PARTITION BY lang, metric ORDER BY bin) AS c2,
  count(*) OVER (PARTITION BY metric) AS s3, count(*) OVER (PARTITION BY metric ORDER BY bin) AS c3 FROM bins),
q1 AS (SELECT lang, source, metric, any_value(s1) AS s, min(top) FILTER (c1 * 100 >= s1 * 25) AS lo, min(top) FILTER (c1 * 100 >= s1 * 50) AS mid, min(top) FILTER (c1 * 100 >= s1 * 75) AS hi FROM cum GROUP BY lang, source, metric),
q2 AS (SELECT lang, metric, any_value(s2) AS s, min(top) FILTER (c2 * 100 >= s2 * 25) AS lo, min(top) FILTER (c2 * 100 >= s2 * 50) AS mid, min(top) FILTER (c2 * 100 >= s2 * 75) AS hi FROM cum GROUP BY lang, metric),
q3 AS (SELECT metric, any_value(s3) AS s, min(top) FILTER (c3 * 100 >= s3 * 25) AS lo, min(top) FILTER (c3 * 100 >= s3 * 50) AS mid, min(top) FILTER (c3 * 100 >= s3 * 75) AS hi FROM cum GROUP BY metric),
g AS (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS metric FROM (SELECT DISTINCT lang, source FROM m)),
pick AS (SELECT g.lang, g.source, g.metric, CASE WHEN q1.s >= 100 THEN q1.lo WHEN q2.s >= 100 THEN q2.lo ELSE q3.lo END AS lo, CASE WHEN q1.s >= 100 THEN q1.mid WHEN q2.s >= 100 THEN q2.mid ELSE q3.mid END AS mid, CASE WHEN q1.s >= 100 THEN q1.hi WHEN q2.s >= 100 THEN q2.hi ELSE q3.hi END AS hi
  FROM g LEFT JOIN q1 ON g.lang IS NOT DISTINCT FROM q1.lang AND g.source IS NOT DISTINCT FROM q1.source AND g.metric = q1.metric
  LEFT JOIN q2 ON g.lang IS NOT DISTINCT FROM q2.lang AND g.metric = q2.metric LEFT JOIN q3 ON g.metric = q3.metric),
lim AS (SELECT lang, source, max(hi + 6 * greatest(hi - mid, mid - lo, 5)) FILTER (metric = 'symbols') AS l1, max(hi + 6 * greatest(hi - mid, mid - lo, 20)) FILTER (metric = 'dup_lines') AS l2, max(hi + 6 * greatest(hi - mid, mid - lo, 25)) FILTER (metric = 'repeats') AS l3,
  max(hi + 6 * greatest(hi - mid, mid - lo, 10)) FILTER (metric = 'word_length') AS l4, max(lo - 6 * greatest(hi - mid, mid - lo, 10)) FILTER (metric = 'word_length') AS l5 FROM pick GROUP BY lang, source)
"""

ORACLES = {
    "op3_license_scan": licenses.oracle(),
    "op5_preference_format": chat.ORACLE,
    "op4_quality_rules": r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(s, s + 5)) AS p FROM rep) GROUP BY 1),
line AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
n AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(line.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(line.c, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.c, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN line USING (doc_id) LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS m1, 1000 * greatest(n_dup_lines - 1, 0) // greatest(n_lines, 1) AS m2, 1000 * n_repeat_words // greatest(n_words, 1) AS m3, 100 * word_chars // greatest(n_words, 1) AS m4,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM n),""" + _LEVELS + r"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(m1 <= l1 AND m2 <= l2 AND m3 <= l3 AND m4 <= l4 AND m4 >= l5, false) AS kept
FROM m LEFT JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source
""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM rep),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.p) AS t FROM pos LEFT JOIN cov ON pos.doc_id = cov.doc_id AND pos.p = cov.p WHERE cov.p IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS c FROM cov GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.c, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op9_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS c, string_agg(i, ',' ORDER BY i) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cov.c, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.c, 0) AS BIGINT) AS n_items, sha256(coalesce(its.t, '')) AS items_sha256, coalesce(cov.c, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op10_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, s, substr(h, s * 2 + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM d WHERE length(h) >= 200)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY md5(k) ORDER BY doc_id, s) AS c FROM win) WHERE c > 1),
isl AS (SELECT doc_id, s, sum(CASE WHEN s <= p + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS g
        FROM (SELECT doc_id, s, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) AS p FROM rep)),
span AS (SELECT doc_id, g, min(s) AS lo, max(s) + 100 AS hi FROM isl GROUP BY 1, 2),
gap AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM span
        UNION ALL SELECT d.doc_id, coalesce(m.hi, 0), length(h) // 2 FROM d LEFT JOIN (SELECT doc_id, max(hi) AS hi FROM span GROUP BY 1) m USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, a * 2 + 1, (b - a) * 2), '' ORDER BY a) AS t FROM gap JOIN d USING (doc_id) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS c, sum(hi - lo) AS r FROM span GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n.r, 0) AS BIGINT) AS n_removed, CAST(coalesce(n.c, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.t, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
""",
}
