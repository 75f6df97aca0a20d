import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from edge import documents, ordered
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm import exchange, simhash, substring, suffix
from quirefold.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substring(rows, window):
    words = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for doc_id, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("window, block", [(35, None), (7, 3), (5, 2), (1, 1)])
def test_substring(docs, window, block):
    got = substring.remove_repeats(docs, window=window, block=block, chunk_bytes=20_000).collect()
    assert ordered(got) == ordered(brute_substring(documents(), window))


def test_substring_empty(none):
    assert substring.remove_repeats(none).collect() == []
    with pytest.raises(ValueError):
        substring.remove_repeats(none, window=10, block=8)


def brute_suffix(rows, window):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    seen, out = set(), []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            if w in seen:
                gone[i : i + window] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((r[0], len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("window, anchor", [(100, 40), (30, 8), (30, 30), (12, 1)])
def test_suffix(docs, window, anchor):
    got = suffix.remove_earlier_repeats(docs, window=window, anchor=anchor, chunk_bytes=20_000).collect()
    assert ordered((*r[:5], bytes(r[5])) for r in got) == ordered(brute_suffix(documents(), window))


def test_hostile_texts_are_told_apart(spark):
    """Two words of 2048 letters that a polynomial modulo a power of two can't tell apart."""
    a, b = ("".join(x[i.bit_count() % 2] for i in range(2048)) for x in ("ab", "ba"))
    tail = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([a, *tail])), (2, " ".join([b, *tail])), (3, a), (4, b), (5, a + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(substring.remove_repeats(docs).collect()) == ordered(brute_substring(rows, 35))
    assert not any(r.n_removed for r in substring.remove_repeats(docs).collect())
    for window in (100, 2048):
        got = suffix.remove_earlier_repeats(docs, window=window).collect()
        assert ordered((*r[:5], bytes(r[5])) for r in got) == ordered(brute_suffix(rows, window))


def test_suffix_empty(none):
    assert suffix.remove_earlier_repeats(none).collect() == []


def test_levels_grow_geometrically():
    family, seen = exchange.Levels(), set()
    for i in range(40):
        batch = np.unique(np.random.default_rng(i).integers(0, 500, 20).astype(np.uint64))
        found = family.scan(batch)
        assert found.tolist() == [int(x) in seen for x in batch]
        family.add(batch[~found])
        seen |= set(map(int, batch))
    assert len(family.levels) <= 6 and [r for r, _ in family.levels] == sorted((r for r, _ in family.levels), reverse=True)


def brute_simhash(rows, shingle=4, radius=4):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    prints = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(lower))
        grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            group[i] = min(group[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= radius)
    ids = lambda g: [r[0] for r, x in zip(rows, group) if x == g and r[0] is not None]
    return [(r[0], f"{p:016x}", min(ids(g), default=None)) for r, p, g in zip(rows, prints, group)]


def test_simhash(docs, none):
    assert ordered(simhash.near_duplicates(docs).collect()) == ordered(brute_simhash(documents()))
    assert simhash.near_duplicates(none).collect() == []


def test_keep_first(docs, none):
    want = {}
    for r, (_, p, c) in zip(documents(), brute_simhash(documents())):
        want.setdefault(c if c is not None else p, []).append(r)
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns and got.count() == len(want)
    assert ordered([r.doc_id] for r in got.collect()) == ordered([min((r[0] for r in rows if r[0] is not None), default=None)] for rows in want.values())
    assert simhash.keep_first(none).collect() == []


@pytest.mark.parametrize("n, unit", [(60, 8), (400, 16), (3_000_000, 4096)])
def test_links_connect_all(spark, n, unit):
    """Dense clusters, hot shards cut into parts, and more blocks as the corpus grows: all give the same components."""
    r = np.random.default_rng(n)
    centres = r.integers(0, 2**63, 5, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in r.integers(0, 64, r.integers(1, 7)):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    rows = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    got = {x.node: x.root for x in components(simhash.links(rows, n, 4, unit)).collect()}
    label = list(range(len(prints)))
    for _ in range(12):
        for i, a in enumerate(prints):
            label[i] = min(label[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 4)
    groups = {}
    for p, g in zip(prints, label):
        s = int(np.uint64(p).astype(np.int64))
        groups.setdefault(g, set()).add(got.get(s, s))
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 40))
def test_forest_finds_all(prints, radius):
    p = np.array(prints, np.uint64)
    unit = np.sort(p % 3)
    p = p[np.argsort(p % 3, kind="stable")]
    got = {(int(a), int(b)) for q, n in simhash.Forest(p, unit).within(radius, p, unit, 16) for a, b in zip(q, n)}
    assert got == {(i, j) for i in range(len(p)) for j in range(len(p)) if unit[i] == unit[j] and (int(p[i]) ^ int(p[j])).bit_count() <= radius}


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, j) for j in range(101, 140)] + [(200, 200), (7, 3), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}
