"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are hashed; every `gram` words make a gram, and in any `window` consecutive words the least gram hash is kept.
Equal windows keep equal grams, so joining the kept grams of documents with those of the benchmark misses no shared
window. Hits are then extended: each window that keeps a hit gram is compared with the benchmark's windows as
text. An item shorter than a window is a window of its own length; its anchor is its first word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm import common

#: What parts words, in text that has no A-Z any more.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of benchmark anchors or windows that may be broadcast, and what a row takes beside its strings; beyond that the join is shuffled.
BROADCAST_BYTES, ROW = 64 << 20, 64
SHORT = 1  # salt of first words


def words(text: Column) -> Column:
    """Words in order, A-Z lower-cased. Of plain ASCII, lower() does no more than that, and faster."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWERED))
    return F.array_remove(F.split(plain, BREAK), "")


def _with_grams(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Adds w (words), h (their hashes) and g: for each window start, the least gram hash in the window. Each step is a column of
    its own that the next uses twice, so it is evaluated once."""
    rows = rows.withColumn("w", words(F.col("text"))).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    last = F.greatest(F.size("h") - gram, F.lit(0))
    rows = rows.withColumn("g", F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("h", i + j) for j in range(gram)))))
    span, have = window - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        # zip_with pads to the longer array and least() skips nulls: only the starts of whole windows stay in the end
        rows = rows.withColumn("g", F.zip_with("g", F.slice("g", step + 1, 1 << 30), lambda a, b: F.least(a, b)))
        have += step
    return rows.withColumn("g", F.slice("g", F.lit(1), F.greatest(F.size("h") - window + 1, F.lit(0))))


def _candidates(docs: DataFrame, anchors: DataFrame, small: bool, window: int, gram: int, lengths: list[int]) -> DataFrame:
    """(row_key, doc_id, n_words, s, n, text) for each window that has one of the anchors, and one row with a null text for each document.

    A document's array of anchors is exploded beside its words, and only what meets an anchor is written as text: texts don't
    move. Anchors that are too many to broadcast are found by a shuffle first, and texts meet them by their key.
    """
    rows = _with_grams(docs, window, gram)
    # a null for the document itself, the windows' anchors by start, and the first words' where items are shorter than a window
    every = [F.array(F.lit(None).cast("long")), F.col("g")] + ([F.transform("h", lambda x: F.xxhash64(x, F.lit(SHORT)))] if lengths else [])
    # never empty, so explode_outer is explode without the filter on its size, for which Catalyst would hash every text again
    rows = rows.select("row_key", "doc_id", "w", F.size("g").alias("n_starts"), F.concat(*every).alias("every"))
    if small:
        anchors = F.broadcast(anchors.withColumn("found", F.lit(True)))
        rows = rows.select("row_key", "doc_id", "w", "n_starts", F.posexplode_outer("every").alias("at", "anchor"))
        rows = rows.join(anchors, "anchor", "left").where("found OR at = 0")
    else:
        hits = rows.select("row_key", F.explode_outer(F.array_distinct("every")).alias("anchor")).join(anchors, "anchor", "left_semi")
        hits = hits.groupBy("row_key").agg(F.collect_set("anchor").alias("anchors"))
        rows = rows.join(hits, "row_key", "left").select("row_key", "doc_id", "w", "n_starts", "anchors", F.posexplode_outer("every").alias("at", "anchor"))
        rows = rows.where(F.col("at").eqNullSafe(0) | F.array_contains("anchors", F.col("anchor")))
    whole = F.col("at") <= F.col("n_starts")
    rows = rows.withColumn("s", F.when(whole, F.col("at") - 1).otherwise(F.col("at") - 1 - F.col("n_starts")))
    sizes = F.when(whole, F.array(F.lit(window))).otherwise(F.array(*map(F.lit, lengths))) if lengths else F.array(F.lit(window))
    rows = rows.withColumn("n", F.explode(sizes))
    text = F.when(F.col("at") > 0, F.array_join(F.slice("w", F.greatest("s", F.lit(0)) + 1, F.col("n")), " "))
    rows = rows.where("s + n <= size(w) OR at = 0")
    return rows.select("row_key", "doc_id", F.size("w").cast("long").alias("n_words"), "s", "n", text.alias("text"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 5) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and its row_key.

    A word is hit if it lies in an occurrence of a benchmark window. n_items counts the items with such windows;
    items_sha256 is of their ids, sorted as strings and comma-joined. Null and empty texts have no words, on either
    side; items without words have no window, and an empty benchmark hits nothing. Equal rows give equal rows. A
    null doc_id is carried through; a null item_id is not named among the items, but its windows hit. Other columns
    are ignored, whatever their names.
    """
    if not 1 <= gram <= window:
        raise ValueError("1 <= gram <= window")
    docs = common.two(docs, id_col, text_col).withColumn("row_key", common.row_key("doc_id", "text"))
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    items = _with_grams(items, window, gram).where(F.size("w") > 0)
    short = F.size("w") < window
    one = lambda n, start, anchor: F.struct(F.lit(n).cast("int").alias("n"), F.array_join(F.slice("w", start, n), " ").alias("text"), anchor.alias("anchor"))
    its = F.when(short, F.array(one(F.size("w"), F.lit(1), F.xxhash64(F.get("h", F.lit(0)), F.lit(SHORT))))).otherwise(F.transform("g", lambda x, i: one(window, i + 1, x)))
    item_windows = common.checkpoint(items.select("item_id", F.explode(its).alias("x")).select("item_id", "x.*").distinct())
    volume = item_windows.agg(F.count_distinct("anchor").alias("anchors"), F.coalesce(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + ROW), F.lit(0)).alias("bytes")).first()
    lengths = sorted(r["n"] for r in item_windows.where(F.col("n") < window).select("n").distinct().collect())  # fewer than `window` values

    small = volume["anchors"] * ROW <= BROADCAST_BYTES
    found = common.checkpoint(_candidates(docs, item_windows.select("anchor").distinct(), small, window, gram, lengths))
    known = item_windows.select("item_id", "n", "text")
    spans = found.where("text IS NOT NULL").select("row_key", "s", "n", "text").join(F.broadcast(known) if volume["bytes"] <= BROADCAST_BYTES else known, ["n", "text"])
    cover = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, x: F.struct(F.greatest(acc["end"], x["s"] + x["n"]).alias("end"), (acc["n"] + F.greatest(x["s"] + x["n"] - F.greatest(acc["end"], x["s"]), F.lit(0))).alias("n")), lambda acc: acc["n"])
    spans = spans.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("s", "n"))).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    spans = spans.select("row_key", cover.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = found.where("text IS NULL").select("row_key", "doc_id", "n_words").join(spans, "row_key", "left").na.fill(0, ["n_hit", "n_items"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "row_key")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows without a benchmark window, with all of their columns."""
    bad = find_overlaps(docs, benchmark, id_col, text_col, **options).where("contaminated").select(F.col("row_key").alias("__row_key")).distinct()
    return common.with_key(docs, id_col, text_col).join(bad, "__row_key", "left_anti").drop("__row_key")
