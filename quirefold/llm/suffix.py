"""Suffix-array dedup of bytes with a logarithmic index family.

A full suffix array holds every byte position. Here the suffixes are sampled by content: in any `window` bytes
the least `anchor`-byte gram is the anchor, equal windows have equal anchors at equal offsets, and consecutive
windows with one anchor form a run. A chunk of documents, in doc_id order, is one batch. Its suffix array has the
fingerprints of its runs in sorted order, sharded by bucket. A shard takes the batches in order; each is
merge-scanned against the levels of the family (a match is a run that an earlier batch holds whole), then
becomes a level itself, and equal-sized levels merge geometrically.

Runs that match whole need no more work. A run that is new, but whose anchor gram occurs elsewhere, is where
a match begins or ends: its single windows go through a second scan of the same kind. The first occurrence of a
window is always in such a run, so the second scan finds every earlier copy, to the byte.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import common
from quirefold.llm import exchange as ex
from quirefold.llm.textcore import U64, Runs, lanes, mix, texts_of

RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
RUNS, ANCHORS, WINDOWS = 0, 1, 2


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class _Chunk:
    """The rows of a chunk in order (doc_id, then text; a null id is first) with their runs."""

    def __init__(self, table: pa.Table, window: int, anchor: int, single: bool = True):
        self.table = table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows else table
        nulls = pc.is_null(table.column("doc_id")).to_numpy(zero_copy_only=False)
        if nulls.any():
            self.table = table = table.take(np.concatenate([np.flatnonzero(nulls), np.flatnonzero(~nulls)]))
        self.texts, self.window, self.anchor = texts_of(table.column("text")), window, anchor
        found, self.pieces = [], []
        for row, part in self.texts.pieces(1 << 20):
            base = int(self.texts.offs[row])
            unit = 8 if anchor >= 8 else 1
            self.block = unit << min(2, (anchor // unit).bit_length() - 1)
            runs = Runs(lanes(part.data) if unit == 8 else part.data.astype(U64), 0, unit)
            found.append(self._runs(part, base, runs))
            if single:  # of the piece only the hashes of blocks stay, 8 bytes for each byte of text
                runs.levels = [x if i == runs._power(self.block) else None for i, x in enumerate(runs.levels)]
                self.pieces.append((base, len(part.data), runs))
        self.lo, self.hi, self.a, self.b, self.gram = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, t) for t in (np.int64, np.int64, U64, U64, U64))

    def _runs(self, part, base: int, runs: Runs):
        n, window, anchor = len(part.data), self.window, self.anchor
        if n < window:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, U64)
        grams = runs.windows(anchor)
        bits = U64(int(n).bit_length())
        least = _sliding_min((grams >> bits << bits) | np.arange(len(grams), dtype=U64), window - anchor + 1)
        at = (least & U64((1 << int(bits)) - 1)).astype(np.int64)  # of the anchor of the window that starts here
        valid = np.zeros(n + 1, np.int32)
        starts, stops = part.offs[:-1], part.offs[1:] - window + 1
        some = stops > starts
        np.add.at(valid, starts[some], 1)
        np.add.at(valid, stops[some], -1)
        valid = np.cumsum(valid)[: len(at)] > 0
        same = np.zeros(len(at), bool)
        same[1:] = valid[:-1] & (at[1:] == at[:-1])
        same[part.offs[(part.offs > 0) & (part.offs < len(at))]] = False
        lo = np.flatnonzero(valid & ~same)
        last = np.ones(len(at), bool)
        last[:-1] = ~(valid[1:] & same[1:])
        hi = np.flatnonzero(valid & last)
        return lo + base, hi + base, *(runs.spans(lo, hi + window, self.block, seed) for seed in (0, 1)), mix(grams[at[lo]] ^ U64(0x5DEECE66D))

    def prints(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints, by both hashes, of the windows at the given ascending starts."""
        a, b = np.zeros(len(start), U64), np.zeros(len(start), U64)
        for base, n, runs in self.pieces:
            i, j = np.searchsorted(start, [base, base + n])
            s = start[i:j] - base
            a[i:j], b[i:j] = (runs.spans(s, s + self.window, self.block, seed) for seed in (0, 1))
        return a, b


def _again(deal: ex.Deal) -> np.ndarray:
    """Inputs that have an equal one before them in the chunk."""
    return deal.first()[deal.which] != np.arange(len(deal.which))


def _deals(c: _Chunk, buckets: int) -> tuple[ex.Deal, ex.Deal]:
    return ex.Deal(c.a, c.b, buckets), ex.Deal(c.gram & U64(0xFFFFFFFF), c.gram, buckets)


def _ask_runs(window: int, anchor: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        runs, grams = _deals(_Chunk(table, window, anchor, single=False), buckets)
        chunk = table.column("chunk")[0].as_py()
        return pa.concat_tables([runs.rows(RUNS, chunk, np.uint64), grams.rows(ANCHORS, chunk, np.uint32)])

    return run


def _second(c: _Chunk, answered: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, ex.Deal]:
    """(which runs occurred whole before, starts of the windows to compare one by one, their deal)."""
    runs, grams = _deals(c, buckets)
    whole = _again(runs) | ex.answers(answered, RUNS, len(runs))[runs.which]
    known = (grams.count > 1) | ex.answers(answered, ANCHORS, len(grams))
    edge = np.flatnonzero(~whole & known[grams.which])
    size = c.hi[edge] - c.lo[edge] + 1
    stop = np.cumsum(size)
    start = np.repeat(c.lo[edge] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
    return whole, start, ex.Deal(*c.prints(start), buckets)


def _ask_windows(window: int, anchor: int, buckets: int):
    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ex.ASK.empty_table()
        deal = _second(_Chunk(table, window, anchor), answered, buckets)[2]
        return deal.rows(WINDOWS, table.column("chunk")[0].as_py(), np.uint64)

    return run


def scan(table: pa.Table) -> pa.Table:
    """One shard: the batches of each kind in order against the family of levels; anchor grams need only be shared."""
    kinds = {}
    for kind, bucket, chunk, body in sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "chunk", "body"))), key=lambda r: (r[0], r[2])):
        kinds.setdefault(kind, []).append((kind, bucket, chunk, body))
    out = []
    for kind, rows in kinds.items():
        dtype = np.uint32 if kind == ANCHORS else np.uint64
        if kind == ANCHORS:
            every = np.sort(np.concatenate([np.frombuffer(r[3], dtype) for r in rows]))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
        family = ex.Levels()
        for _, bucket, chunk, body in rows:
            batch = np.frombuffer(body, dtype)
            if kind == ANCHORS:
                out.append((kind, bucket, chunk, ex._member(twice, batch)))
                continue
            found = family.scan(batch)
            out.append((kind, bucket, chunk, found))
            family.add(batch[~found])
    return ex._reply(out)


def _finish(window: int, anchor: int, buckets: int, with_kept: bool):
    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT.empty_table()
        c = _Chunk(table, window, anchor)
        whole, start, deal = _second(c, answered, buckets)
        earlier = _again(deal) | ex.answers(answered, WINDOWS, len(deal))[deal.which]
        data, offs = c.texts.data, c.texts.offs
        depth = np.zeros(len(data) + 1, np.int32)
        for lo, hi in ((c.lo[whole], c.hi[whole]), (start[earlier], start[earlier])):
            np.add.at(depth, lo, 1)
            np.add.at(depth, hi + window, -1)
        gone = np.cumsum(depth[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        edges = offs[:-1][offs[:-1] < len(data)]
        opens[edges] = gone[edges]
        before, spans, kept = (np.concatenate([[0], np.cumsum(x)])[offs] for x in (gone, opens, ~gone))
        rest = data[~gone]
        texts = [rest[i:j].tobytes() for i, j in zip(kept[:-1], kept[1:])]
        return pa.table({"doc_id": c.table.column("doc_id"), "n_bytes": np.diff(offs), "n_removed": np.diff(before), "n_spans": np.diff(spans), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in texts], "kept": [x if with_kept else None for x in texts]}, RESULT)

    return run


def remove_earlier_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, anchor: int = 40, with_kept: bool = True, chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes.

    Removes each byte that a `window`-byte string covers which also starts earlier: in a smaller doc_id, or
    before in the same text. Rows of one doc_id count in order of their texts, equal ones one after the other. A null
    id comes before all others. A null or empty text has no bytes. Other columns are ignored, whatever their names.
    A cut may fall inside a character, so what is kept is bytes. Memory of a task is bounded by a
    chunk, or by the longest text or most frequent id where that is larger.
    """
    if not 1 <= anchor <= window:
        raise ValueError("1 <= anchor <= window")
    docs = common.two(docs, id_col, text_col)
    _, size = common.volume(docs)
    n = common.chunk_count(size, chunk_bytes)
    buckets = max(1, math.ceil(size / (16 << 20)))
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)).alias("at")
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"] if n > 1 else []
    splits = [-math.inf, *sorted({float(q) for q in cuts or []}), math.inf]
    chunks = Bucketizer(splits=splits, inputCol="at", outputCol="chunk").transform(docs.withColumn("at", key)) if len(splits) > 2 else docs.withColumn("chunk", F.lit(0))
    chunks = chunks.select("doc_id", "text", F.col("chunk").cast("long").alias("chunk")).repartition(n, "chunk")
    first = ex.exchange(chunks.groupBy("chunk").applyInArrow(_ask_runs(window, anchor, buckets), ex.ASK_DDL), scan, buckets)
    second = ex.exchange(chunks.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(_ask_windows(window, anchor, buckets), ex.ASK_DDL), scan, buckets)
    both = first.unionByName(second)
    out = chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(_finish(window, anchor, buckets, with_kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_kept else out.drop("kept")
