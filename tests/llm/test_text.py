import hashlib
import math
import random
import re
import textwrap
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
import zstandard
from edge import documents, ordered, passage
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold.llm import chat, decontaminate, language, licenses, pieces, pii, quality, textcore

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(rep)


def test_quality_counts(docs, none):
    got = quality.judge(docs).select("doc_id", *quality.COUNTS, "base_failed").collect()
    want = []
    for r in documents():
        c = brute_counts(r[1])
        want.append((r[0], *c, c[0] < 10 or 100 * c[5] > 20 * c[0]))
    assert ordered(got) == ordered(want)
    assert quality.judge(none).collect() == [] and quality.keep_good(none).collect() == []


def thue_morse(zero: str, one: str, n: int = 2048) -> tuple[str, str]:
    """The two words of n letters that a polynomial modulo a power of two can't tell apart."""
    return "".join(one if i.bit_count() % 2 else zero for i in range(n)), "".join(zero if i.bit_count() % 2 else one for i in range(n))


def test_hashes_tell_hostile_texts_apart(spark, model):
    a, b = thue_morse("a", "b")
    rows = [(1, f"{a}\n{b}"), (2, " ".join([a, *"uvwx", b, *"uvwx"])), (3, a), (4, b)]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    assert ordered(quality.judge(docs).select("doc_id", *quality.COUNTS).collect()) == ordered((i, *brute_counts(t)) for i, t in rows)
    assert len(set(pii.term_hashes([a.encode(), b.encode()]).tolist())) == 2
    got = {r.doc_id: r for r in pieces.encode(docs, model, n=2).collect()}
    assert all(r.round_trip for r in got.values()) and got[3].ids != got[4].ids
    assert {r.doc_id: r.text for r in pieces.decode(spark.createDataFrame([(i, r.ids) for i, r in got.items()], "doc_id long, ids array<int>"), model).collect()} == dict(rows)


def test_classes_are_exact_whatever_the_hashes():
    data = np.frombuffer(b"ab ab ba ab c", np.uint8)
    start, end = np.array([0, 3, 6, 9, 12]), np.array([2, 5, 8, 11, 13])
    for keys in (np.zeros(5, np.uint64), textcore.span_hashes(data, start, end)):
        got = textcore.equal_classes(data, start, end, keys).tolist()
        assert got[0] == got[1] == got[3] and len(set(got)) == 3


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=200), st.integers(1, 60), st.sampled_from([1, 8]))
def test_window_hashes(raw, width, unit):
    data = np.frombuffer(raw, np.uint8)
    if width < unit or width > len(raw):
        return
    runs = textcore.Runs(textcore.lanes(data) if unit == 8 else data.astype(np.uint64), 1, unit)
    h = runs.windows(width).tolist()
    assert len(h) == len(raw) - width + 1 and len(set(h)) == len({raw[i : i + width] for i in range(len(h))})
    assert {raw[i : i + width]: x for i, x in enumerate(h)} == {raw[i : i + width]: h[raw.find(raw[i : i + width])] for i in range(len(h))}
    starts = np.arange(len(h))
    block = unit << min(2, (width // unit).bit_length() - 1)
    assert all(len(set(runs.spans(starts, starts + width, block, seed).tolist())) == len(set(h)) for seed in (0, 1))


def test_quality_sketch_is_mergeable_and_close(spark):
    r = random.Random(3)
    values = [int(r.paretovariate(1.1) * 20) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    bins = [x.b for x in rows.select(quality.bin_of(rows.v).alias("b")).collect()]
    tops = {x.b: x.t for x in spark.createDataFrame([(b,) for b in set(bins)], "b long").select("b", quality.top_of(F.col("b")).alias("t")).collect()}
    assert all(v <= tops[b] <= v * (1 + 1 / 16) + 1 for v, b in zip(values, bins))


def test_quality_limits_adapt(spark):
    clean = [(i, passage(100 + i, 80).replace("##", ""), "en", "a") for i in range(150)]
    junk = [(1000 + i, " ".join(w + "###" for w in passage(400 + i, 80).split()), "en", "a") for i in range(10)]
    usual = [(2000 + i, " ".join(w + "###" for w in passage(600 + i, 80).split()), "en", "b") for i in range(150)]
    rows = spark.createDataFrame(clean + junk + usual, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.judge(rows).where("kept").collect()}
    assert kept == {r[0] for r in clean + usual} == {r.doc_id for r in quality.keep_good(rows).collect()}


def test_quality_every_metric_decides(spark):
    """Each metric drops a document that differs from its group, and none of those that are usual in another group."""
    plain = lambda i: passage(1000 + i, 80).replace("##", "")
    odd = {
        "symbols": lambda i: " ".join(w + ("##" if k % 6 == 0 else "") for k, w in enumerate(plain(i).split())),
        "dup_lines": lambda i: "\n".join([*(lines := [" ".join(plain(i).split()[k : k + 3]) for k in range(0, 78, 3)]), *lines[:8][::-1]]),
        "repeats": lambda i: " ".join([*plain(i).split(), *plain(i).split()[:7]]),
        "word_length": lambda i: " ".join(w + "xyzxyzxyz" for w in plain(i).split()),
        "low": lambda i: " ".join(f"{w[:1]}{k % 10}" for k, w in enumerate(plain(i).split())),
    }
    rows = [(i, plain(i), "en", "plain") for i in range(150)]
    rows += [(1000 * (k + 1) + i, make(i), "en", "plain" if i < 2 else name) for k, (name, make) in enumerate(odd.items()) for i in range(130)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert sum(got[i].kept for i in range(150)) >= 147 and all(sum(got[1000 * (k + 1) + i].kept for i in range(2, 130)) >= 124 for k in range(len(odd)))
    assert not any(got[1000 * (k + 1) + i].kept for k in range(len(odd)) for i in range(2))


def brute_overlaps(rows, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    known = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            known.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for r in rows:
        w, hit, found = split(r[1]), set(), set()
        for n in {len(k) for k in known}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in known:
                    hit |= set(range(s, s + n))
                    found |= {str(i) for i in known[k] if i is not None}
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("window, gram", [(10, 5), (10, 10), (6, 1), (4, 3)])
def test_decontaminate(spark, docs, none, window, gram):
    items = [(1, passage(0, 30)), (2, "A b C d e F g h i j k"), (3, None), (4, ""), (5, passage(3, 12)), (6, "one"), (7, "same line"), (None, passage(1, 15)), (8, passage(99, 40)), (1, passage(0, 30)), (9, "the the " * 9)]
    bench = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, anchor int, doc_id string")
    got = decontaminate.find_overlaps(docs, bench, window=window, gram=gram).drop("row_key").collect()
    assert ordered(got) == ordered(brute_overlaps(documents(), items, window))
    clean = decontaminate.keep_clean(docs, bench, window=window, gram=gram)
    assert clean.columns == docs.columns and clean.count() == sum(not r[-1] for r in brute_overlaps(documents(), items, window))
    assert decontaminate.find_overlaps(none, bench).collect() == [] and not any(r.contaminated for r in decontaminate.find_overlaps(docs, bench.limit(0)).collect())


def test_decontaminate_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    items = [(1, passage(0, 30)), (2, "A b C d e F g h i j k"), (5, passage(3, 12)), (6, "one"), (7, "same line")]
    got = decontaminate.find_overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).drop("row_key").collect()
    assert ordered(got) == ordered(brute_overlaps(documents(), items, 10))


def test_decontaminate_is_native(docs, spark):
    bench = spark.createDataFrame([(1, passage(0, 30))], "item_id long, text string")
    assert not re.search("Python|Pandas|Arrow", decontaminate.find_overlaps(docs, bench)._jdf.queryExecution().executedPlan().toString())


def brute_pii(x):
    x = x or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m)) <= 15]


def test_pii_patterns():
    r = random.Random(5)
    bits = ["a", "b.c", "@", "x.y", ".", "1", "12", "255", "256", "+", "-", " ", "(", ")", "4539 1488 0343 6467", "4539148803436467", "+1 555 555 0100", "a@b.co", "10.0.0.1", "é", "%", "007"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        assert pii.find(text) == brute_pii(text), text


@pytest.mark.parametrize("text", ["1" * 300_000, "1." * 150_000, "a" * 300_000, "a@" * 150_000, "+1 " * 100_000, "a@b." * 80_000, "+1" + " " * 300_000, "9 " * 150_000])
def test_pii_is_linear(text):
    began = time.time()
    pii.find(text)
    assert time.time() - began < 4


def test_pii_table(docs, none):
    got = pii.detect(docs).select("doc_id", *(f"n_{k}" for k in pii.KINDS), "base").collect()
    want = [(r[0], *(sum(k == kind for k, _, _ in pii.find(r[1])) for kind in pii.KINDS), pii.join_spans(pii.find(r[1]))) for r in documents()]
    assert ordered(got) == ordered(want) and any(r[-1] for r in want)
    assert pii.detect(none).collect() == [] and pii.sanitise(none).collect() == []


def test_pii_disclosing_terms(spark):
    """A name that stands beside one address in several texts is disclosing wherever it stands; common words and names seen in one text
    are not, nor is one that only copies of a text share."""
    common = "the of and to in is that it was for on are as with his they at be this from have or by one had not".split()
    r = random.Random(9)
    fill = lambda n: " ".join(r.choice(common) for _ in range(n))
    rows = [(i, fill(60)) for i in range(300)]
    rows += [(1000 + i, f"{fill(20)} Zyrkon wrote zk@mail.example.com {fill(20)}") for i in range(3)]
    rows += [(2000, f"{fill(20)} Lonely one@mail.example.com {fill(20)}"), (2001, None), (2002, "Zyrkon alone")]
    copied = f"{fill(40)} Doppel {fill(60)}"
    rows += [(3000 + i, f"{copied} copy@mail.example.com {fill(1)}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: [dict(rows)[x.doc_id][t.s : t.e] for t in x.terms or []] for x in pii.detect(df).collect()}
    assert all("Zyrkon" in got[1000 + i] for i in range(3)) and not any(w in common for ts in got.values() for w in ts)
    assert all(not ts for i, ts in got.items() if i < 1000 or i >= 2000 and i != 2002) and got[2002] == ["Zyrkon"]
    shuffled = {x.doc_id: [dict(rows)[x.doc_id][t.s : t.e] for t in x.terms or []] for x in pii.detect(df, broadcast_terms=0).collect()}
    assert shuffled == got
    clean = {x.doc_id: x.text for x in pii.sanitise(df).collect()}
    assert len(clean) == len(rows) and clean[2001] is None and clean[2002] == " alone" and clean[0] == rows[0][1]
    assert "Zyrkon" not in clean[1000] and "zk@" not in clean[1000] and "<email>" in clean[1000] and "Lonely <email>" in clean[2000]


def test_pii_terms_of_the_whole_document(spark):
    """A disclosing term is marked wherever it stands in the corpus, however far from a pattern span."""
    common = "the of and to in is that it was for on are as with his they at be this from have or by one had not".split()
    r = random.Random(10)
    fill = lambda n: " ".join(r.choice(common) for _ in range(n))
    rows = [(i, fill(60)) for i in range(300)]
    rows += [(1000 + i, f"Zyrkon {fill(200)} zk@mail.example.com {fill(200)} ZYRKON, {fill(30)} Zyrkon") for i in range(3)]
    rows += [(2000, f"Lonely {fill(20)} one@mail.example.com {fill(20)} Lonely"), (2001, f"{fill(20)} Zyrkon"), rows[301]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, [dict(rows)[x.doc_id][t.s : t.e] for t in x.terms or []]) for x in pii.detect(df).collect())
    assert got == sorted((i, ["Zyrkon", "ZYRKON", "Zyrkon"] if 1000 <= i < 2000 else ["Zyrkon"] if i == 2001 else []) for i, _ in rows)
    assert all("zyrkon" not in x.text.lower() for x in pii.sanitise(df).where("doc_id between 1000 and 1999").collect())
    lone = {x.doc_id: [dict(rows)[x.doc_id][t.s : t.e] for t in x.terms or []] for x in pii.detect(df, support=1).collect()}
    assert lone[2000] == ["Lonely", "Lonely"] and lone[1000] == ["Zyrkon", "ZYRKON", "Zyrkon"]


def brute_terms(rows, support, at):
    """Terms that disclose, by the definition: contexts are sets of five-word shingles, copies of one text are one."""
    word = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
    texts = []
    for _, t in rows:
        spans = pii.find(t)
        words = [m for m in word.finditer(t or "") if not any(s < m.end() and m.start() < e for _, s, e in spans)]
        terms = [m[0].lower() for m in words]
        grams = frozenset(zip(*(terms[i:] for i in range(5)))) if len(terms) >= 5 else frozenset([tuple(terms)])
        texts.append(({t[s:e] for _, s, e in spans}, {m[0].lower() for m in word.finditer(t or "")}, set(terms), grams))
    n, d_t, d_e, pairs = len(rows), Counter(), Counter(), {}
    for entities, every, terms, grams in texts:
        d_t.update(every)
        d_e.update(entities)
        for e in entities:
            for w in terms:
                pairs.setdefault((e, w), []).append(grams)
    return {w for (e, w), seen in pairs.items() if len(set(seen)) >= support and len(seen) < n and math.log2(len(seen) * n / (d_t[w] * d_e[e])) / math.log2(n / len(seen)) >= at}


@pytest.mark.parametrize("support, at", [(1, 0.6), (2, 0.6), (2, 0.3), (3, 0.5)])
def test_pii_terms_against_brute_force(spark, support, at):
    r = random.Random(support)
    words = [a + b for a in "ba ke li mo nu ter sa fi".split() for b in "rn st ld mp xo".split()]
    people = [f"p{i}@mail.example.com" for i in range(12)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(6, 40)))) for i in range(150)]
    for i in range(60):
        k = r.randrange(12)
        t = " ".join([*(r.choice(words) for _ in range(r.randint(6, 25))), people[k], *([f"Name{k}"] if r.random() < 0.7 else []), *(r.choice(words) for _ in range(8))])
        rows += [(1000 + i, t)] * r.choice([1, 1, 1, 2])
    rows += [(2000 + k, f"Name{k} was here") for k in range(6)]
    want = brute_terms(rows, support, at)
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string"), support=support, generalise_at=at).collect()
    texts = dict(rows)
    found = {(x.doc_id, t.s, t.e) for x in got for t in x.terms}
    assert want and found == {(i, m.start(), m.end()) for i, t in rows for m in re.finditer(r"[0-9A-Za-z]+", t) if m[0].lower() in want and not any(s < m.end() and m.start() < e for _, s, e in pii.find(t))}
    assert len(got) == len(rows) and all(texts[x.doc_id] for x in got)


def test_licenses(spark, docs, none):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,\nincluding without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,\nsubject to the following conditions: "
    notice = "The above copyright notice and this permission notice shall be included in all copies or\nsubstantial portions of the Software. "
    end = "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. "
    rows = [(1, mit + notice + end), (2, notice + mit + end), (3, "x.\nReleased under the MIT License.\nAll rights reserved."), (4, None), (5, ""), (6, "Licensed under the Apache License,\n   Version 2.0."), (7, "no licence"), (3, "x.\nReleased under the MIT License.\nAll rights reserved.")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.rules) for r in got} == {(1, "mit-full"), (2, ""), (3, "mit-notice,proprietary"), (4, ""), (5, ""), (6, "apache-notice"), (7, "")} and len(got) == 8
    assert next(r for r in got if r.doc_id == 2).n_sentences == 3 and next(r for r in got if r.doc_id == 3).licenses == "LicenseRef-all-rights-reserved,MIT"
    assert all(re.search(licenses.CUES[4:], s, re.I) for s in licenses.SENTENCES.values()) and all(i in licenses.SENTENCES for _, ids in licenses.RULES.values() for i in ids)
    assert licenses.scan(docs).count() == len(documents()) and licenses.scan(none).collect() == []


@pytest.mark.parametrize("width", [12, 30, 40, 48, 72, 1000])
def test_licenses_wrapped_anyhow(spark, width):
    """A sentence is found however its lines are broken, in comments, lists or inside a longer sentence; of rules that differ only in one sentence the right one holds."""
    wrap = lambda words: "\n * ".join(textwrap.wrap(words, width, break_long_words=False))
    S = licenses.SENTENCES
    full = lambda *ids: wrap(". ".join(S[i].capitalize() for i in ids))
    rows = [
        (1, full("mit-grant", "mit-notice", "as-is-software"), "MIT"), (2, full("bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaimer"), "BSD-2-Clause"), (3, full("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer"), "BSD-3-Clause"),
        (4, wrap("This file is released under the MIT License."), "MIT"), (5, full("gpl2-free", "gpl-warranty"), "GPL-2.0-or-later"), (6, full("gpl-free", "gpl-warranty", "gpl-copy"), "GPL-3.0-or-later"), (7, full("lgpl21-free", "lgpl-warranty"), "LGPL-2.1-or-later"),
        (8, full("agpl3-free", "gpl-warranty"), "AGPL-3.0-or-later"), (9, full("unlicense-domain", "unlicense-anyone"), "Unlicense"), (10, full("bsl-grant"), "BSL-1.0"), (11, wrap("// SPDX-License-Identifier: LGPL-3.0-or-later"), "LGPL-3.0-or-later"), (12, wrap("The mitigation is licensed under conditions."), ""),
        (13, wrap("It is licensed under the GPL v2 license, parts are available under the Boost Software License, Version 1.0"), "BSL-1.0,GPL-2.0-only"), (14, "Permission is hereby granted, free of", ""),
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {i: lic for i, _, lic in rows}
    assert all(s == licenses.normal(s) for s in S.values()) and len(set(S.values())) == len(S)


def test_chat(spark):
    rows = [
        (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "good"), (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "bad"), (1, False, 2, "user", "why"),
        (2, True, 0, "user", "x"), (2, False, 0, "user", "x"), (3, True, 0, "user", None), (4, True, 0, None, "<|end|>"), (4, False, 0, "user", "q"),
        (5, True, 0, "user", "p"), (5, False, 0, "user", "p"), (5, False, 1, "assistant", "r"), (None, True, 0, "user", "x"), (6, None, 0, "user", "x"), (7, False, 0, "assistant", "é"), (7, False, 0, "assistant", "é"),
    ]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "pair_id long, chosen boolean, turn long, role string, text string, prompt string, c int")
    got = {r.pair_id: r for r in chat.format_preferences(df).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "same", 3: "unpaired", 4: "ok", 5: "prefix", 7: "unpaired"}
    one = got[1]
    assert one.prompt == "<|user|>\nhi<|end|>\n" and one.n_prompt_turns == 1 and one.chosen == "<|assistant|>\ngood<|end|>\n"
    for text, mask, want in ((one.chosen, one.chosen_mask, ["good<|end|>\n"]), (one.rejected, one.rejected_mask, ["bad<|end|>\n"]), (got[7].rejected, got[7].rejected_mask, ["é<|end|>\n"] * 2)):
        assert [text[int(a) : int(b)] for a, b in (x.split(":") for x in mask.split(","))] == want
    assert got[4].chosen == "<|unknown|>\n< |end|><|end|>\n" and got[5].chosen == "" and got[5].rejected_mask and got[2].prompt == "<|user|>\nx<|end|>\n"
    assert chat.format_preferences(df.limit(0)).collect() == []


def test_language_edge(spark, docs, none):
    learned = language.train(docs, docs_per_lang=5)
    assert set(learned) == {"en", "de"}
    got = language.classify(docs, learned).collect()
    assert len(got) == len(documents()) and all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in got)
    want = sum(not any(unicodedata.category(c).startswith("L") for c in d[1] or "") for d in documents())
    assert sum(r.lang_pred == "und" for r in got) == want
    assert language.train(none) == {} and language.classify(none, learned).collect() == [] and {r.lang_pred for r in language.classify(docs, {}).collect()} == {"und"}
    with pytest.raises(ValueError):
        language.train(docs, max_bytes=300_000)


def test_language_against_brute_force(spark):
    """Texts are what compresses best after a language's own text; ties go to the commoner language, numerals aren't letters."""
    r = random.Random(8)
    words = {k: ["".join(r.choice(a) for _ in range(5)) for _ in range(40)] for k, a in (("aa", "abcde"), ("bb", "vwxyzß"), ("cc", "лмнопр"))}
    text = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    rows = [(i, text(k, 60), k) for i, k in enumerate(["aa"] * 30 + ["bb"] * 20 + ["cc"] * 10)]
    learned = language.train(spark.createDataFrame(rows + rows[:1] * 5000, "doc_id long, text string, lang string"))
    assert list(learned) == ["aa", "bb", "cc"]
    odd = ["½", "²", "Ⅷ", "123 !", "", None, " ", "_", "ʰ", "日"]
    asked = [(i, text(k, 3 + i), k) for i, k in enumerate(["aa", "bb", "cc"] * 10)] + [(100 + i, t, None) for i, t in enumerate(odd)] + [(200, "qqqq jjjj", None), (200, "qqqq jjjj", None)]
    got = language.classify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), learned).collect()
    packers = [(k, zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)) for k, d in learned.items()]
    for (_, t, _), g in zip(sorted(asked, key=lambda x: x[0]), sorted(got, key=lambda x: x.doc_id)):
        if not any(unicodedata.category(c).startswith("L") for c in t or ""):
            assert (g.lang_pred, g.score, g.rejected) == ("und", 0.0, True)
            continue
        plain = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in t.lower())
        sizes = [len(p.compress(re.sub(" +", " ", plain).encode())) for _, p in packers]
        best = min(sizes)
        assert g.lang_pred == packers[sizes.index(best)][0] and g.rejected == ((sorted(sizes)[1] - best) / sorted(sizes)[1] < 0.01)
    assert [x.lang_pred for x in got if x.doc_id < 30] == [k for i, _, k in sorted(asked) if i < 30] or sum(x.lang_pred == dict((i, k) for i, _, k in asked)[x.doc_id] for x in got if x.doc_id < 30) >= 29


def test_language_held_out(spark):
    from quirefold.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    both = QUERIES["op7_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(both) > 200 and sum(r.lang == r.lang_pred for r in both) / len(both) > 0.95


@pytest.fixture(scope="module")
def model():
    return pieces.Model.load(pieces.MODEL_FILE)


def brute_paths(lattice, text, n):
    t = chr(pieces.MARK) + text.replace(" ", chr(pieces.MARK)) if text else ""
    best = [[0.0]] + [[] for _ in t]
    for e in range(1, len(t) + 1):
        for s in range(max(0, e - lattice.longest), e):
            if t[s:e] in lattice.ids:
                best[e] += [x + lattice.score[lattice.ids[t[s:e]]] for x in best[s]]
        if not lattice.known[ord(t[e - 1])]:
            best[e] += [x + lattice.unknown for x in best[e - 1]]
        best[e] = sorted(best[e], reverse=True)[:n]
    return best[-1]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_pieces(model, n):
    lattice, r = model.prepare(), random.Random(n)
    texts = ["Hello world", " a  b", "\n", "▁▁é日本", "the the the", "a" * 70 + " b", "", "foo   bar\t\tbaz", "😀 x", "x" * 49]
    texts += ["".join(r.choice("the an on\nqé日 ") for _ in range(r.randint(1, 40))) for _ in range(150)]
    for t, (ids, scores) in zip(texts, lattice.encode(texts, n)):
        assert scores == pytest.approx(brute_paths(lattice, t, n)), t
        assert lattice.decode(ids) == t.replace(chr(pieces.MARK), " ")


def test_pieces_equal_the_library(model, tmp_path):
    """The library, given the same scores as a unigram model file, finds the same best segmentation and the same n best."""
    sentencepiece = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(pieces.MODEL_FILE, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for piece, score in zip(proto.pieces, model.scores):
        if piece.type == 1:
            piece.score = score
    (tmp_path / "unigram.model").write_bytes(proto.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "unigram.model"))
    again = pieces.Model.load(str(tmp_path / "unigram.model"))
    assert again.scores == pytest.approx(model.scores, rel=1e-5)  # a unigram file's scores are taken as they are
    lattice, r = again.prepare(), random.Random(4)
    texts = ["The quick brown fox jumps over the lazy dog.", "Einfach schöne Wörter, naïve café 日本 😀", "  two  spaces\n\ttab"] + [passage(800 + i, 40) for i in range(30)]
    texts += ["".join(r.choice("the an on\nqé日 ") for _ in range(r.randint(1, 30))) for _ in range(150)]
    score = lambda ids: sum(again.scores[i] for i in ids if not sp.is_byte(i))
    same = 0
    for t, (ids, _) in zip(texts, lattice.encode(texts, 1)):
        same += ids.tolist() == sp.encode(t)
        assert score(ids) == pytest.approx(score(sp.encode(t)), rel=1e-5), t
    assert same >= 0.98 * len(texts)
    words = ["another", "information", "international", "thetheon"]
    for t, found in zip(words, lattice.nbest(words, 5)):
        assert [s for s, _ in found] == pytest.approx([score(i) for i in sp.nbest_encode_as_ids(t, 5)], rel=1e-4)


def test_piece_search(model):
    lattice = model.prepare()
    found = lattice.search("▁another", 6)
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True) and len({tuple(i) for _, i in found}) == 6
    assert all("".join(model.texts[i] for i in ids) == "▁another" and sum(model.scores[ids]) == pytest.approx(s) for s, ids in found)


def test_pieces_table(docs, none, model):
    got = pieces.encode(docs, model, piece_bytes=5000).collect()
    assert len(got) == len(documents()) and all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    assert {tuple(r.nbest_scores) for r in got if not r.n_pieces} == {(0.0,)} and pieces.encode(none, model).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5])
def test_pieces_nbest_ids(spark, model, n):
    """Each of the n best has its own ids, which add up to its score and decode to the text, also by the operator."""
    lattice, r = model.prepare(), random.Random(n)
    texts = [None, "", "Hello world", "the the the", "a" * 70 + " b", "日本 😀 x another"] + ["".join(r.choice("the an on\n ") for _ in range(r.randint(1, 40))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pieces.encode(docs, model, n=n).cache()
    for x in out.collect():
        text = texts[x.doc_id] or ""
        assert [y.score for y in x.nbest] == x.nbest_scores == pytest.approx(brute_paths(lattice, text, n)) and x.nbest[0].ids == x.ids
        assert len({tuple(y.ids) for y in x.nbest}) == len(x.nbest) and x.round_trip
        assert x.nbest_sha256 == [hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in y.ids)).hexdigest() for y in x.nbest] and x.nbest_sha256[0] == x.ids_sha256
        if all(lattice.known[ord(c)] for c in text):
            assert [sum(model.scores[y.ids]) for y in x.nbest] == pytest.approx(x.nbest_scores)
    ways = out.select("doc_id", F.explode("nbest.ids").alias("w"))
    assert all(x.text == (texts[x.doc_id] or "") for x in pieces.decode(ways, model, "w").collect())
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), model).first().text is None
    with pytest.raises(Exception, match="not in the model"):
        pieces.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), model).collect()


def brute_quality(rows):
    """The rows (doc_id, text, lang, source, ...) that pass: quartiles of each group's documents, by sorting, in the sketch's bins."""
    def top(v):
        e = max(v.bit_length() - 7, 0)
        return ((v >> e) + 1 << e) - 1

    measured = []
    for r in rows:
        n, chars, symbols, lines, dups, repeats = brute_counts(r[1])
        metrics = (1000 * symbols // max(chars, 1), 1000 * max(dups - 1, 0) // max(lines, 1), 1000 * repeats // max(n, 1), 100 * chars // max(n, 1))
        measured.append((r, metrics, n < 10 or 100 * repeats > 20 * n))
    kept = []
    for r, metrics, failed in measured:
        good = not failed
        for k, (resolution, lower) in enumerate([(5, False), (20, False), (25, False), (10, True)]):
            peers = next((p for p in ([m[k] for x, m, f in measured if not f and all(x[j] == r[j] for j in same)] for same in ((2, 3), (2,))) if len(p) >= 100), [m[k] for _, m, f in measured if not f])
            if not peers:
                good = False
                continue
            q1, q2, q3 = (top(sorted(peers)[-(-len(peers) * q // 100) - 1]) for q in (25, 50, 75))
            s = 6 * max(q3 - q2, q2 - q1, resolution)
            good &= metrics[k] <= q3 + s and not (lower and metrics[k] < q1 - s)
        if good:
            kept.append(r)
    return kept


def test_pipeline(spark, tmp_path, model):
    """Each stage's rows against a brute-force version, on what the stage before it kept."""
    from test_dedup import brute_simhash

    import corpus_pipeline as cp

    item = passage(50, 30)
    rows = [(i, passage(100 + i, 90).replace("##", ""), "en", f"s{i % 2}") for i in range(40)]
    rows += [(100, rows[3][1], "en", "s0"), (101, rows[4][1] + " more", "en", "s1"), (102, passage(70, 50).replace("##", "") + " " + item, "en", "s0"), (103, "short", "en", "s0"), (104, None, None, None), (105, rows[5][1] + " call +1 555 555 0100 now", "de", "s0"), (106, passage(71, 60).replace("##", "") + " write a@b.example.com", "en", None)]
    rows += [(110 + i, f"{passage(80 + i, 60)} Zyrkon wrote zk@mail.example.com {passage(90 + i, 30)}".replace("##", ""), "en", "s1") for i in range(3)] + [(120, "Zyrkon " + passage(95, 60).replace("##", ""), "en", "s1"), (121, "### $$$ " * 40, "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert not {100, 101, 102, 103, 104, 121} & set(out) and {r[0] for r in rows[:40]} <= set(out) and 106 in out
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "sentencepiece"]

    def near(rows):
        groups = {}
        for r, (_, p, c) in zip(rows, brute_simhash(rows, 5, 7)):
            groups.setdefault(c if c is not None else p, []).append(r)
        return [min(g) for g in groups.values()]

    def sanitised(rows):
        terms = brute_terms([r[:2] for r in rows], 2, 0.6)
        out = []
        for r in rows:
            spans = [(k, s, e, 0.0) for k, s, e in pii.find(r[1])]
            spans += [("term", m.start(), m.end(), 1.0) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010FFFF]+", r[1]) if m[0].lower() in terms and not any(s < m.end() and m.start() < e for _, s, e, _ in spans)]
            text = pii.rewrite(r[1], spans, 0.8)
            out.append((r[0], text, r[2], r[3], len(text)))
        return out

    clean = lambda rows: [r for r, x in zip(rows, brute_overlaps(rows, [(1, item)], 10)) if not x[-1]]
    want = [(*r, len(r[1] or "")) for r in rows]
    for (name, stage), brute in zip(cp.STAGES, (brute_quality, near, clean, sanitised)):
        docs, want = stage(spark, docs, str(tmp_path)), brute(want)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.schema["n_chars"].dataType.typeName() == "long"
        assert ordered(docs.collect()) == ordered(want), name
    texts = {r[0]: r for r in want}
    assert "a@b" not in texts[106][1] and "<email>" in texts[106][1] and texts[0][1] == rows[0][1] and not any("Zyrkon" in r[1] for r in want)
    lattice = model.prepare()
    assert set(out) == set(texts)
    for i, r in out.items():
        assert r.round_trip and r.n_pieces == len(r.ids) and r.nbest_scores == pytest.approx(brute_paths(lattice, texts[i][1], 4)) and lattice.decode(np.array(r.ids)) == texts[i][1]
    null = spark.createDataFrame([(1, None, None, None, None)], docs.schema)
    assert [(r.doc_id, r.n_pieces, r.ids) for r in cp.tokenisation(spark, null, str(tmp_path)).collect()] == [(1, 0, [])]
