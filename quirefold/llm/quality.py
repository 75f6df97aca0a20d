"""Quality rules with adaptive thresholds from mergeable quantile sketches for each language and source.

A sketch is a histogram of integer bins with a relative width of 1/64 at most (below 128 exact): counts add up,
so sketches of sources merge into those of a language and of the corpus, in any order and with the same result.
Limits are fences around the quartiles of the group's own documents: `quartile +- spread * s`, where s is the larger of the two
quartiles' distances from the median, and at least the metric's resolution, as many groups have no spread at all. There
is no fixed cutoff beside them: where a group usually has many symbols or repeats, so may its documents. Documents that fail the
base rules are not part of a sketch. A group of fewer than `min_group` documents takes its language's sketch, and that of
the corpus where the language is small as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.llm import common
from quirefold.llm.textcore import SPACED, U64, Runs, byte_set, equal_classes, gather, mix, run_cover, span_hashes, spans_of, texts_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
MEASURES = pa.schema([(c, pa.int64()) for c in COUNTS])
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NOT_NEWLINE = ~byte_set((0x0A, 0x0A))
#: metric: (thousandths or hundredths as SQL over the counts, resolution, whether there is a lower limit too). One repeated line
#: is no share of anything in a short text, so it doesn't count.
METRICS = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", 5, False),
    "dup_lines": ("1000 * greatest(n_dup_lines - 1, 0) div greatest(n_lines, 1)", 20, False),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", 25, False),
    "word_length": ("100 * word_chars div greatest(n_words, 1)", 10, True),
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def _first_of(keys: np.ndarray) -> np.ndarray:
    """Which keys are the first of their value."""
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def _by_doc(classes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Classes of spans, each text's apart. Both are counts below 2**32 in one batch."""
    return classes.astype(np.int64) << 32 | doc


def measure(texts) -> dict[str, np.ndarray]:
    """The counts of each text of a batch."""
    out = {c: [] for c in COUNTS}
    for _, part in texts.pieces(1 << 20):
        data, offs, n = part.data, part.offs, len(part)
        words, lines = spans_of(part, SPACED), spans_of(part, NOT_NEWLINE)
        inside = np.zeros(len(data) + 1, np.int64)
        np.cumsum(SPACED[data], out=inside[1:])
        chars = np.concatenate([[0], np.cumsum(SPACED[data] & ((data & 0xC0) != 0x80))])[offs]
        symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])[offs]
        worded = np.flatnonzero(inside[lines.end] > inside[lines.start])
        start, end, doc = lines.start[worded], lines.end[worded], lines.doc[worded]
        again = ~_first_of(_by_doc(equal_classes(data, start, end, span_hashes(data, start, end)), doc))
        at = np.flatnonzero(words.room() >= 5)
        size = words.end - words.start + 1
        stop = np.cumsum(size)
        joined = gather(data, words.start, words.end, 32)
        keys = Runs(span_hashes(data, words.start, words.end), 0).windows(5)[at] if len(at) else np.zeros(0, U64)
        keys = _by_doc(equal_classes(joined, (stop - size)[at], stop[at + 4 if len(at) else at] - 1, keys), words.doc[at])
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        covered = run_cover(len(words), at[times[which] > 1] if len(at) else at, 5)
        for c, v in zip(COUNTS, (words.per_doc(), np.diff(chars), np.diff(symbols), np.bincount(doc, minlength=n), np.bincount(doc[again], minlength=n), np.diff(np.concatenate([[0], np.cumsum(covered)])[words.first]))):
            out[c].append(v.astype(np.int64))
    return {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}


def measured(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep` (and no text) beside the counts of each text."""
    source = docs.select(*keep, F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = source.drop("_text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = measure(texts_of(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(counts[c]) for c in COUNTS)], names=[*keep, *COUNTS])

    return source.mapInArrow(run, schema)


def bin_of(value: Column) -> Column:
    """The sketch bin of an integer from 0."""
    e = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return (F.floor(value / F.pow(F.lit(2.0), e)) + 64 * e).cast("long")


def top_of(bin_: Column) -> Column:
    """The largest value of a bin."""
    e = F.greatest(F.floor(bin_ / 64) - 1, F.lit(0))
    return ((bin_ - 64 * e + 1) * F.pow(F.lit(2.0), e) - 1).cast("long")


def sketches(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Bins (groups..., metric, bin, n) of all documents that pass the base rules."""
    metrics = F.array(*(F.struct(F.lit(m).alias("metric"), bin_of(F.expr(sql)).alias("bin")) for m, (sql, _, _) in METRICS.items()))
    return counts.where(f"NOT ({BASE_FAILED})").select(*groups, F.explode(metrics).alias("x")).groupBy(*groups, F.col("x.metric").alias("metric"), F.col("x.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


QUARTILES = ("q25", "q50", "q75")


def _quantiles(bins: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., metric, size, q25, q50, q75) of the merged sketches."""
    key = W.partitionBy(*groups, "metric")
    bins = bins.groupBy(*groups, "metric", "bin").agg(F.sum("n").alias("n"))
    bins = bins.withColumns({"size": F.sum("n").over(key), "upto": F.sum("n").over(key.orderBy("bin"))})
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("size") * int(q[1:]), top_of(F.col("bin")))).alias(q)
    return bins.groupBy(*groups, "metric").agg(F.first("size").alias("size"), *map(at, QUARTILES))


def limits(counts: DataFrame, bins: DataFrame, lang: str, source: str, spread: int = 6, min_group: int = 100) -> DataFrame:
    """A row (lang, source, lim_<metric>, and low_<metric> where there is one) for each group of `counts`; null where
    no sketch at all has a document."""
    own, wide, whole = (_quantiles(bins, g) for g in ([lang, source], [lang], []))
    named = lambda df, p, keys: df.select(*(F.col(k).alias(f"{p}_{k}") for k in keys), *(F.col(c).alias(f"{p}_{c}") for c in ("metric", "size", *QUARTILES)))
    own, wide, whole = named(own, "o", [lang, source]), named(wide, "w", [lang]), named(whole, "a", [])
    groups = counts.select(lang, source).distinct().withColumn("metric", F.explode(F.array(*map(F.lit, METRICS))))
    joined = groups.join(own, groups[lang].eqNullSafe(own[f"o_{lang}"]) & groups[source].eqNullSafe(own[f"o_{source}"]) & (groups["metric"] == own["o_metric"]), "left")
    joined = joined.join(wide, groups[lang].eqNullSafe(wide[f"w_{lang}"]) & (groups["metric"] == wide["w_metric"]), "left").join(F.broadcast(whole), groups["metric"] == whole["a_metric"], "left")
    pick = lambda c: F.when(F.col("o_size") >= min_group, F.col(f"o_{c}")).when(F.col("w_size") >= min_group, F.col(f"w_{c}")).otherwise(F.col(f"a_{c}"))
    joined = joined.select(groups[lang], groups[source], groups["metric"], *(pick(q).alias(q) for q in QUARTILES))
    out = []
    for m, (_, resolution, lower) in METRICS.items():
        s = spread * F.greatest(F.col("q75") - F.col("q50"), F.col("q50") - F.col("q25"), F.lit(resolution))
        out.append(F.max(F.when(F.col("metric") == m, F.col("q75") + s)).alias(f"lim_{m}"))
        if lower:
            out.append(F.max(F.when(F.col("metric") == m, F.col("q25") - s)).alias(f"low_{m}"))
    return joined.groupBy(lang, source).agg(*out)


#: Groups whose limits may be broadcast; beyond that they are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def _renamed(docs: DataFrame, text_col: str, lang_col: str, source_col: str, keep: list[str]) -> DataFrame:
    """Internal names throughout, so that no column can clash with a result."""
    return docs.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), F.col(f"`{lang_col}`").cast("string").alias("_lang"), F.col(f"`{source_col}`").cast("string").alias("_source"), F.col(f"`{text_col}`").alias("_text"))


def _verdicts(counts: DataFrame, lim: DataFrame) -> DataFrame:
    lim = lim.withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    out = counts.join(lim, counts["_lang"].eqNullSafe(lim["_l"]) & counts["_source"].eqNullSafe(lim["_s"]), "left").drop("_l", "_s")
    within = F.lit(True)
    for m, (sql, _, lower) in METRICS.items():
        value = F.expr(sql)
        within &= value <= F.col(f"lim_{m}")
        if lower:
            within &= value >= F.col(f"low_{m}")
    return out.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spread: int = 6, min_group: int = 100) -> DataFrame:
    """The rows that judge() keeps, with all of their columns. Texts are measured twice, and never shuffled."""
    renamed = _renamed(docs, text_col, lang_col, source_col, docs.columns)
    counts = measured(renamed, "_text", ["_lang", "_source"])
    bins = common.checkpoint(sketches(counts, ["_lang", "_source"]))
    lim = common.checkpoint(limits(bins, bins, "_lang", "_source", spread, min_group))  # a group without a sketch has no row to keep
    lim = F.broadcast(lim) if lim.count() <= BROADCAST_GROUPS else lim
    out = _verdicts(measured(renamed, "_text", [*(f"_k{i}" for i in range(len(docs.columns))), "_lang", "_source"]), lim).where("kept")
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None, spread: int = 6, min_group: int = 100) -> DataFrame:
    """The columns `keep` of each input row, its counts, its group's limits, base_failed and kept.

    base_failed: fewer than 10 words, or over a fifth of the words in five-word windows found twice in the text. kept is
    false for these; else it is false if a metric is beyond a limit of the row's (lang, source). A null text has no words;
    null languages and sources are groups of their own. An empty table gives no rows. Columns that are not in
    `keep` are ignored, whatever their names; those in `keep` are carried under theirs and must not be names of results.
    """
    keep = keep or ["doc_id"]
    renamed = _renamed(docs, text_col, lang_col, source_col, keep)
    counts = common.checkpoint(measured(renamed, "_text", [*(f"_k{i}" for i in range(len(keep))), "_lang", "_source"]))
    out = _verdicts(counts, limits(counts, sketches(counts, ["_lang", "_source"]), "_lang", "_source", spread, min_group))
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *COUNTS, "base_failed", "kept", *(f"lim_{m}" for m in METRICS), *(f"low_{m}" for m, (_, _, lower) in METRICS.items() if lower))
