"""Substring dedup by fixed-block anchors: every word run that occurs twice is removed wherever it occurs.

Any window of `window` words contains a block of `block` words that starts at a multiple of `block` in its own
document, if window >= 2 * block - 1. Round one indexes these non-overlapping blocks and probes them with every
rolling window of `block` words of the corpus. Round two extends the hits: windows of full length around a block
that was hit are compared by 64-bit fingerprints (the bucket adds bits of a second one), and repeated windows
that overlap or touch join into maximal exact repeats.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import common
from quirefold.llm import exchange as ex
from quirefold.llm.textcore import SPACED, Runs, Spans, Texts, gather, lanes, run_cover, span_hashes, spans_of, texts_of

RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


class _Words:
    """Words of one chunk with fingerprints by two hashes."""

    def __init__(self, table: pa.Table):
        self.texts: Texts = texts_of(table.column("text"))
        self.spans: Spans = spans_of(self.texts, SPACED)
        s, data = self.spans, self.texts.data
        at = lanes(data)
        self.a, self.b = (Runs(span_hashes(data, s.start, s.end, seed, at), seed) for seed in (0, 1))
        self.room, self.rel = s.room(), np.arange(len(s)) - s.first[s.doc]


def _blocks(words: _Words, block: int, buckets: int) -> tuple[ex.Deal, np.ndarray, np.ndarray]:
    """(deal of all rolling windows of block length, starts of the aligned ones, which distinct ones are aligned)."""
    at = np.flatnonzero(words.room >= block)
    full = words.a.windows(block)[at] if len(at) else np.zeros(0, np.uint64)
    deal = ex.Deal(full & np.uint64(0xFFFFFFFF), full, buckets)
    aligned = words.rel[at] % block == 0
    indexed = np.zeros(len(deal), bool)
    indexed[deal.which[aligned]] = True
    return deal, np.where(aligned, deal.which, -1), indexed


def _windows(words: _Words, answered: pa.Table, block: int, window: int, buckets: int) -> tuple[ex.Deal, np.ndarray]:
    """(deal of the full windows whose own first aligned block was hit, their starts)."""
    deal, aligned, indexed = _blocks(words, block, buckets)
    hit = deal.count > 1
    hit[indexed] |= ex.answers(answered, 0, int(indexed.sum()))
    block_hit = np.zeros(len(words.room) + block, bool)  # by the index of a block's first word
    at = np.flatnonzero(words.room >= block)
    block_hit[at] = np.where(aligned >= 0, hit[aligned], False)
    start = np.flatnonzero(words.room >= window)
    start = start[block_hit[start + (-words.rel[start]) % block]]
    a, b = (x.windows(window)[start] if len(start) else np.zeros(0, np.uint64) for x in (words.a, words.b))
    return ex.Deal(a, b, buckets), start


def _ask_blocks(block: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        deal, _, indexed = _blocks(_Words(table), block, buckets)
        chunk = table.column("chunk")[0].as_py()
        return pa.concat_tables([deal.rows(0, chunk, np.uint32, indexed), deal.rows(1, chunk, np.uint32, ~indexed)])

    return run


def _ask_windows(block: int, window: int, buckets: int):
    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ex.ASK.empty_table()
        deal, _ = _windows(_Words(table), answered, block, window, buckets)
        return deal.rows(2, table.column("chunk")[0].as_py(), np.uint64)

    return run


def _finish(block: int, window: int, buckets: int, with_text: bool):
    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT.empty_table()
        words = _Words(table)
        deal, start = _windows(words, answered, block, window, buckets)
        repeated = (deal.count > 1) | ex.answers(answered, 2, len(deal))
        s = words.spans
        gone = run_cover(len(s), start[repeated[deal.which]], window) if len(s) else np.zeros(0, bool)
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[s.first[1:]] - before[s.first[:-1]]
        kept = ~gone
        out = gather(words.texts.data, s.start[kept], s.end[kept], 32)
        length = np.concatenate([[0], np.cumsum((s.end - s.start + 1)[kept])])
        at = length[np.concatenate([[0], np.cumsum(kept)])[s.first]]
        joined = [out[i : max(i, j - 1)].tobytes() for i, j in zip(at[:-1], at[1:])]
        return pa.table({"doc_id": table.column("doc_id"), "n_words": s.per_doc(), "n_removed": removed, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in joined], "kept_text": [x.decode() if with_text else None for x in joined]}, RESULT)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, block: int | None = None, with_text: bool = True, chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Words are `[^\\x20\\x09-\\x0D]+`. A null or empty text has no words and keeps the empty string; a text of fewer
    than `window` words keeps all. Equal rows count as separate documents, so they remove each other's windows.
    A null id is carried through. Other columns are ignored, whatever their names. Memory of a task is
    bounded by a chunk, or by the longest text where that is larger; equal rows of one input partition share a chunk.
    """
    block = block or (window + 1) // 2
    if window < 2 * block - 1:
        raise ValueError("a window must hold an aligned block: window >= 2 * block - 1")
    docs = common.two(docs, id_col, text_col)
    _, size = common.volume(docs)
    n = common.chunk_count(size, chunk_bytes)
    buckets = max(1, math.ceil(size / (8 << 20)))
    chunks = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n))).repartition(n, "chunk")
    first = ex.exchange(chunks.groupBy("chunk").applyInArrow(_ask_blocks(block, buckets), ex.ASK_DDL), ex.probe_blocks, buckets)
    second = ex.exchange(chunks.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(_ask_windows(block, window, buckets), ex.ASK_DDL), ex.shared, buckets)
    both = first.unionByName(second)
    out = chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(_finish(block, window, buckets, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")
