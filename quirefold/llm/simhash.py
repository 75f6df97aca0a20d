"""SimHash near-dedup with BK-trees.

Distinct fingerprints are dealt into shards: 64 bits are cut into `radius + k` blocks, and fingerprints within
`radius` bits agree in k of them, so each is sent to one shard for each choice of k blocks. k grows with the corpus, so that
shards stay small. Every shard has a BK-tree, children keyed by their Hamming distance to the parent, and its members
look each other up following only edges within the radius. A shard of over `unit` members is cut into parts,
and each pair of parts is a unit with a tree of the one and look-ups by the other. Trees go to the
look-ups by shuffle, as their total size has no bound that would allow a broadcast. A unit emits a spanning
forest of its links, not all pairs; connected components follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import common
from quirefold.llm.components import components
from quirefold.llm.textcore import LOWER, SPACED, Texts, gather, spans_of, texts_of

SEED = 42


def fingerprints_of(texts: Texts, shingle: int = 4) -> np.ndarray:
    """SimHash (uint64) of each text of a batch."""
    out = []
    for _, part in texts.pieces(1 << 20):
        data = LOWER[part.data]
        words = spans_of(part, SPACED)
        joined = gather(data, words.start, words.end, 32).tobytes()
        size = words.end - words.start
        at = np.cumsum(size + 1) - size - 1
        room = words.room()
        whole = (np.arange(len(words)) == words.first[words.doc]) & (room < shingle)
        head = np.flatnonzero((room >= shingle) | whole)
        last = np.minimum(head + shingle, words.first[words.doc[head] + 1]) - 1
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(at[head].tolist(), (at[last] + size[last]).tolist())), np.uint64, len(head))
        n = np.bincount(words.doc[head], minlength=len(part))
        prints = np.zeros(len(part), np.uint64)
        some = np.flatnonzero(n)
        if len(some):
            starts = (np.cumsum(n) - n)[some]
            ones = np.empty((len(some), 64), np.int64)
            for k, (i, j) in enumerate(zip(starts, starts + n[some])):  # a text at a time: bits of all shingles are 64 times the words
                total = np.zeros(64, np.int64)
                for lo in range(i, j, 1 << 15):
                    total += np.unpackbits(hashes[lo : min(j, lo + (1 << 15))].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                ones[k] = total
            prints[some] = np.packbits(2 * ones > n[some][:, None], axis=1).reshape(-1).view(np.uint64)
        out.append(prints)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(the columns `keep`, fp long) of rows with a text."""
    source = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fingerprints_of(texts_of(batch.column("text")), shingle).view(np.int64))], names=[*keep, "fp"])

    return source.mapInArrow(run, source.drop("text").schema.add("fp", "long"))


class Forest:
    """BK-trees over fingerprints; those of one unit, which must lie together, are one tree."""

    def __init__(self, prints: np.ndarray, unit: np.ndarray):
        self.prints, n = prints, len(prints)
        self.child = np.full((n, 65), -1, np.int32)
        head = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if n else np.zeros(0, np.int64)
        self.units, self.roots = unit[head], head
        self.size = np.diff(np.append(head, n))
        item = np.setdiff1d(np.arange(n), head)
        at = np.repeat(head, self.size)[item]
        while len(item):
            d = np.bitwise_count(prints[item] ^ prints[at])
            free = np.flatnonzero(self.child[at, d] < 0)
            first = free[np.unique(at[free] * 65 + d[free], return_index=True)[1]]
            self.child[at[first], d[first]] = item[first]
            at = self.child[at, d].astype(np.int64)
            rest = at != item
            item, at = item[rest], at[rest]

    def within(self, radius: int, prints: np.ndarray, unit: np.ndarray, budget: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(look-up, tree member) index pairs within the radius, a slice of look-ups at a time: at most `budget` edges are at hand."""
        place = np.minimum(np.searchsorted(self.units, unit), max(len(self.units) - 1, 0))
        ask = np.flatnonzero(self.units[place] == unit) if len(self.units) else np.zeros(0, np.int64)
        slices = np.cumsum(self.size[place[ask]] * (2 * radius + 1)) // budget
        for s in np.unique(slices):
            q = ask[slices == s]
            node = self.roots[place[q]]
            while len(q):
                d = np.bitwise_count(prints[q] ^ self.prints[node]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield q[near], node[near]
                edges = d[:, None] + np.arange(-radius, radius + 1)
                kids = np.where((edges >= 0) & (edges <= 64), self.child[node[:, None], np.clip(edges, 0, 64)], -1)
                row, col = np.nonzero(kids >= 0)
                q, node = q[row], kids[row, col].astype(np.int64)


def spanning(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes that an edge joins to a lesser one."""
    label = np.arange(n)
    while len(u):
        lo, hi = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        open_ = lo != hi
        if not open_.any():
            break
        u, v, lo, hi = u[open_], v[open_], lo[open_], hi[open_]
        np.minimum.at(label, hi, lo)
        while not np.array_equal(label, label[label]):
            label = label[label]
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        fp, tree = t.column("fp").to_numpy().view(np.uint64), t.column("tree").to_numpy()
        unit = np.unique(np.stack([t.column(c).to_numpy() for c in ("shard", "lo", "hi")], 1), axis=0, return_inverse=True)[1].reshape(-1)
        own = t.column("lo").to_numpy() == t.column("hi").to_numpy()
        order = np.argsort(unit, kind="stable")
        fp, tree, unit, own = fp[order], tree[order], unit[order], own[order]
        members, lookups = np.flatnonzero(tree), np.flatnonzero(own | ~tree)
        every, name = np.unique(fp, return_inverse=True)
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, node in Forest(fp[members], unit[members]).within(radius, fp[lookups], unit[lookups]):
            a, b = name[lookups[q]], name[members[node]]
            u.append(a[a != b])
            v.append(b[a != b])
            if sum(map(len, u)) > 1 << 20:  # keep a forest only
                x, y = spanning(len(every), np.concatenate(u), np.concatenate(v))
                u, v = [x], [y]
        x, y = spanning(len(every), np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(every[x].view(np.int64)), pa.array(every[y].view(np.int64))], names=["u", "v"])

    return run


def _blocks(radius: int, n: int) -> tuple[list[tuple[int, int]], int]:
    """(shift and width of each block, k): the least k with 4096 shards or more to a choice, and about 500 fingerprints to a shard
    or fewer. Small corpora of any size have the same k, so that shards multiply no faster than the corpus grows."""
    for k in range(1, 5):
        m = radius + k
        if (bits := 64 * k // m) >= 12 and n / 2**bits <= 500:
            break
    edges = [64 * i // m for i in range(m + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])], k


def links(prints: DataFrame, n: int, radius: int = 4, unit: int = 4096) -> DataFrame:
    """Links (u, v) that connect all of the n distinct fingerprints (column fp) within the radius."""
    blocks, k = _blocks(radius, n)
    shards = []
    for i, chosen in enumerate(combinations(blocks, k)):
        parts = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1)) for lo, width in chosen]
        value = parts[0]
        for p, (_, width) in zip(parts[1:], chosen[1:]):
            value = F.shiftleft(value, width).bitwiseOR(p)
        shards.append(F.struct(F.lit(i).alias("choice"), value.alias("value")))
    dealt = prints.select("fp", F.explode(F.array(*shards)).alias("s")).select("fp", F.xxhash64("s.choice", "s.value").alias("shard"))
    large = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > unit).select("shard", F.ceil(F.col("n") / unit).cast("int").alias("parts"), "n")
    dealt = common.join_skewed(dealt, large, "shard", "n", n * comb(len(blocks), k), "left", unit).withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.hash("fp"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("shard", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "fp", (F.col("part") <= F.col("other")).alias("tree"))
    rows = n * comb(len(blocks), k)
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(rows / 100_000))
    return dealt.repartition(parts, "shard", "lo", "hi").mapInArrow(_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row for each input row: doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable
    over links of at most `radius` differing bits.

    Texts are lower-cased A-Z; words are `[^\\x20\\x09-\\x0D]+`; a text of fewer than `shingle` words is one shingle, one without
    words (null, empty) has fingerprint zero and is linked like any other. Repeated rows share their component. A null id
    is carried through and never is a component_id unless its component has no other. Other columns are ignored.
    """
    prints = common.checkpoint(fingerprints(common.two(docs, id_col, text_col), shingle))
    rooted = common.checkpoint(_rooted(prints, radius))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    total = prints.count()
    named = common.join_skewed(rooted.drop("least"), least, "root", "n", total).select("fp", "copies", "component_id")
    return common.join_skewed(prints, common.checkpoint(named), "fp", "copies", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, least doc_id, number of copies, root) for each distinct fingerprint."""
    distinct = common.checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    roots = components(links(distinct.select("fp"), distinct.count(), radius)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component, with all of its columns: that of the least doc_id (a null id comes last), of equal
    ids the one with the least row key, of equal rows any one."""
    keyed = common.two(docs, id_col, text_col).withColumn("row_key", common.row_key("doc_id", "text"))
    prints = common.checkpoint(fingerprints(keyed, shingle, ("doc_id", "row_key")))
    rooted = _rooted(prints, radius).select("fp", "root")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    least = prints.groupBy("fp").agg(F.min(rank).alias("r")).join(rooted, "fp").groupBy("root").agg(F.min("r").alias("r")).select(F.col("r.row_key").alias("__row_key"))
    return common.with_key(docs, id_col, text_col).join(least, "__row_key", "left_semi").dropDuplicates(["__row_key"]).drop("__row_key")

