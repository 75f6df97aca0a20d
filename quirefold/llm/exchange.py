"""A distributed look-up of fingerprints: chunks of documents ask, buckets of fingerprints answer.

Documents are dealt into chunks, fingerprints into buckets. Each chunk sends one row for each bucket it has
fingerprints in: the bucket's distinct fingerprints, sorted, as one binary value. A bucket's task compares the
rows of all chunks and answers each with one bit for each fingerprint. So a fingerprint crosses the network in
4 or 8 bytes without its position, an answer in one bit, and a fingerprint that a third of all documents hold
is at most one entry for each chunk. Fingerprints have 64 bits; the bucket, from an independent hash, adds its own.

All rounds of one operator read the chunks from the same exchange, which Spark runs once and reuses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASK = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary())])
ANSWER = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("bits", pa.binary())])
ASK_DDL = "kind int, bucket int, chunk long, body binary"
ANSWER_DDL = "kind int, bucket int, chunk long, n int, bits binary"


class Deal:
    """Distinct fingerprints of one chunk by (bucket, fingerprint); which[i] is the place of input i among them."""

    def __init__(self, prints: np.ndarray, route: np.ndarray, buckets: int):
        bucket = (((route >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        order = np.argsort(prints)
        order = order[np.argsort(bucket[order], kind="stable")]
        p, b = prints[order], bucket[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (b[1:] != b[:-1])
        place = np.cumsum(new) - 1
        self.prints, self.bucket = p[new], b[new].astype(np.int64)
        self.which = np.empty(len(p), np.int64)
        self.which[order] = place
        self.count = np.bincount(place, minlength=len(self.prints))

    def __len__(self) -> int:
        return len(self.prints)

    def first(self) -> np.ndarray:
        """The least input index of each distinct fingerprint."""
        out = np.full(len(self.prints), len(self.which), np.int64)
        np.minimum.at(out, self.which, np.arange(len(self.which)))
        return out

    def rows(self, kind: int, chunk: int, dtype: type, keep: np.ndarray | None = None) -> pa.Table:
        p, b = (self.prints, self.bucket) if keep is None else (self.prints[keep], self.bucket[keep])
        at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        raw, ends = p.astype(dtype), np.append(at[1:], len(b))
        return pa.table({"kind": pa.array([kind] * len(at), pa.int32()), "bucket": pa.array(b[at], pa.int32()), "chunk": pa.array([chunk] * len(at), pa.int64()), "body": pa.array([raw[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())}, ASK)


def answers(table: pa.Table, kind: int, n: int) -> np.ndarray:
    """The bits that a chunk got back, in the order of the fingerprints that it sent under `kind`."""
    rows = sorted((r["bucket"], r["n"], r["bits"]) for r in table.to_pylist() if r["kind"] == kind)
    out = np.concatenate([np.unpackbits(np.frombuffer(bits, np.uint8), count=k) for _, k, bits in rows]).astype(bool) if rows else np.zeros(0, bool)
    if len(out) != n:
        raise ValueError(f"{len(out)} answers for {n} fingerprints")
    return out


def _reply(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.Table:
    return pa.table({"kind": [r[0] for r in rows], "bucket": [r[1] for r in rows], "chunk": [r[2] for r in rows], "n": [len(r[3]) for r in rows], "bits": [np.packbits(r[3]).tobytes() for r in rows]}, ANSWER)


def _asked(table: pa.Table, dtype: type) -> list[tuple[int, int, int, np.ndarray]]:
    cols = [table.column(c).to_pylist() for c in ("chunk", "kind", "bucket", "body")]
    return [(k, b, c, np.frombuffer(body, dtype)) for c, k, b, body in sorted(zip(*cols), key=lambda r: r[:2])]


def probe_blocks(table: pa.Table) -> pa.Table:
    """Kind 0 rows are index entries (uint32), kind 1 rows probes; an entry is a hit if two rows hold it."""
    rows = _asked(table, np.uint32)
    index = np.unique(np.concatenate([r[3] for r in rows if r[0] == 0] or [np.zeros(0, np.uint32)]))
    times = np.zeros(len(index) + 1, np.int32)
    for _, _, _, body in rows:
        at = np.searchsorted(index, body)
        at[at == len(index)] = 0
        times[at[index[at] == body] if len(index) else []] += 1
    return _reply([(0, b, c, times[np.searchsorted(index, body)] > 1) for k, b, c, body in rows if k == 0])


def shared(table: pa.Table) -> pa.Table:
    """A fingerprint (uint64) is a hit if two chunks hold it."""
    rows = _asked(table, np.uint64)
    every = np.sort(np.concatenate([r[3] for r in rows]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    return _reply([(k, b, c, _member(twice, body)) for k, b, c, body in rows])


def _member(sorted_set: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


class Levels:
    """A logarithmic family of sorted arrays: a new batch is one level, and equal-sized levels merge, so that
    sizes grow geometrically and each entry is merged at most a logarithmic number of times."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray]] = []

    def scan(self, batch: np.ndarray) -> np.ndarray:
        """Which entries of the sorted batch some level holds."""
        found = np.zeros(len(batch), bool)
        for _, level in self.levels:
            found |= _member(level, batch)
        return found

    def add(self, batch: np.ndarray) -> None:
        """Takes a sorted batch of which no level holds an entry."""
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            batch = np.sort(np.concatenate([self.levels.pop()[1], batch]), kind="stable")  # a merge of two sorted runs
            rank += 1
        self.levels.append((rank, batch))


def exchange(asks: DataFrame, answer, buckets: int) -> DataFrame:
    """Answers the rows of `asks`, bucket by bucket, each in a task of its own: hashing a few buckets over tasks would
    give some tasks several."""
    return asks.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(answer, ANSWER_DDL)
