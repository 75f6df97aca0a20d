"""PII: pattern spans, and information-theoretic sanitisation of the terms that disclose them.

Four kinds of personal data are found by pattern; a value found is a protected entity. For every term of a document with
an entity, document frequencies over the whole corpus give the normalised pointwise mutual information of the two,

    npmi = log2(d(t,e) N / (d(t) d(e))) / log2(N / d(t,e)),

how much of the entity the term discloses: near 1 for a name that occurs only in documents with one address, near 0 for a
common word. A term whose npmi with some entity reaches `generalise_at` in `support` contexts is disclosing: every occurrence of it
in the corpus, with or without the entity, is a span of kind `term`, replaced by its class, or removed from `remove_at` on.

Copies of one text are one context, however many they are: contexts are told apart by min-hashes of five-word
shingles, and two texts count as two only if all of the min-hashes differ. An entity or a pair of fewer contexts than
`support` gives no term; `support` 1 takes single texts in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm import common
from quirefold.llm.textcore import LOWER, TERMS, U64, Runs, Texts, mix, span_hashes, spans_of, texts_of

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9][0-9.]*+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain by their @: linear also where a text is one long run of word characters."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        after = at + 1
        if at > last and text[at - 1] in LOCAL and (m := DOMAIN.match(text, at + 1)):
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            out.append((start, m.end()))
            last = after = m.end()
        at = text.find("@", after)
    return out


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    if not text:
        return []
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if first := DIGIT.search(text):
        for run in DOTTED.finditer(text, first.start()):
            if run[0].count(".") >= 3:
                out += [("ip", m.start(), m.end()) for m in IP.finditer(text, *run.span()) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text, first.start()):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _value(kind: str, raw: str) -> str:
    return f"{kind}:{raw.lower() if kind == 'email' else re.sub('[^0-9.]', '', raw) if kind == 'ip' else re.sub('[^0-9]', '', raw)}"


def _terms(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of all terms of a text, those that touch a span left out."""
    words = [m.span() for m in WORD.finditer(text)]
    at = np.array(words, np.int64).reshape(-1, 2)
    taken = sorted((s, e) for _, s, e in spans)
    starts = np.array([s for s, _ in taken], np.int64)
    ends = np.r_[0, np.maximum.accumulate(np.array([e for _, e in taken], np.int64))]
    free = ends[np.searchsorted(starts, at[:, 1], "left")] <= at[:, 0]
    at = at[free]
    return term_hashes([text[s:e].encode() for s, e in at.tolist()]), at[:, 0], at[:, 1]


def _spans(base: str) -> list[tuple[str, int, int]]:
    return [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in base.split(","))]


def term_hashes(terms: list[bytes]) -> np.ndarray:
    offs = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
    data = LOWER[np.frombuffer(b"".join(terms), np.uint8)]
    return span_hashes(data, offs[:-1], offs[1:]).view(np.int64) if terms else np.zeros(0, np.int64)


CONTEXTS = 4  # min-hashes of a text


def contexts(terms: np.ndarray) -> list[int]:
    """Min-hashes of the five-word shingles of a text's terms in order; a shorter text is one shingle."""
    h = terms.view(U64)
    grams = Runs(h, 1).windows(min(5, len(h))) if len(h) else np.zeros(1, U64)
    return [int((mix(grams ^ U64(k * 0x9E3779B97F4A7C15 % 2**64))).min().astype(np.int64)) for k in range(1, CONTEXTS + 1)]


FOUND = "doc_id long, row_key struct<a: long, b: long>, " + "".join(f"n_{k} long, " for k in KINDS) + "base string, entities array<long>, text string"


def found(docs: DataFrame) -> DataFrame:
    """Base spans of rows (doc_id, row_key, text), their distinct entities, and the text where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, counts, entities, texts = [], [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                spans = find(text)
                base.append(join_spans(spans))
                counts.append([sum(k == kind for k, _, _ in spans) for kind in KINDS])
                entities.append([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big", signed=True) for x in sorted({_value(k, text[s:e]) for k, s, e in spans})])
                texts.append(text if spans else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))), pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.int64())), pa.array(texts, pa.string())], names=["doc_id", "row_key", *(f"n_{k}" for k in KINDS), "base", "entities", "text"])

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, FOUND)


def pairs_of(texts: DataFrame) -> DataFrame:
    """(copies, m1, m2, ..., entity, term), once for each text, of texts (copies, base, text, entities)."""
    names = ["copies", *(f"m{k}" for k in range(1, CONTEXTS + 1)), "entity", "term"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for copies, base, text, entities in zip(*(batch.column(c).to_pylist() for c in ("copies", "base", "text", "entities"))):
                every = _terms(text, _spans(base))[0]
                terms, marks = np.unique(every), contexts(every)
                for lo in range(0, len(entities), step := max(1, (1 << 18) // max(1, len(terms)))):
                    some = np.array(entities[lo : lo + step], np.int64)
                    n = len(some) * len(terms)
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, x, np.int64)) for x in (copies, *marks)), pa.array(np.repeat(some, len(terms))), pa.array(np.tile(terms, len(some)))], names=names)

    return texts.select("copies", "base", "text", "entities").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def marked(texts: Texts, spans: list[list[tuple[str, int, int]]], terms: np.ndarray, npmi: np.ndarray) -> list[list[tuple[int, int, float]]]:
    """For each text of a batch, (start, end, npmi) in code points of every occurrence of the `terms` (ascending) that touches no
    pattern span."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(texts))]
    for row, part in texts.pieces(1 << 20):
        words = spans_of(part, TERMS)
        if not len(words) or not len(terms):
            continue
        found = span_hashes(LOWER[part.data], words.start, words.end).view(np.int64)
        at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
        hits = np.flatnonzero(terms[at] == found)
        if not len(hits):
            continue
        points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
        for i in hits.tolist():
            d = int(words.doc[i])
            s, e = (int(points[x] - points[part.offs[d]]) for x in (words.start[i], words.end[i]))
            if not any(a < e and s < b for _, a, b in spans[row + d]):
                out[row + d].append((s, e, float(npmi[at[i]])))
    return out


def term_counts(docs: DataFrame, flush: int = 1 << 21) -> DataFrame:
    """(term, n), the documents of the whole corpus that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            values, which = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return values, np.bincount(which, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            for _, part in texts_of(batch.column("text")).pieces(1 << 20):
                words = spans_of(part, TERMS)
                if len(words):
                    prints = span_hashes(LOWER[part.data], words.start, words.end)
                    order = np.lexsort((words.doc, prints))
                    prints, doc = prints[order], words.doc[order]
                    once = np.r_[True, (prints[1:] != prints[:-1]) | (doc[1:] != doc[:-1])]
                    held.append(np.unique(prints[once], return_counts=True))
            if sum(len(h) for h, _ in held) > flush:
                held = [merged()]
                if len(held[0][0]) > flush // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["term", "n"])
                    held = []
        if held:
            values, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _seen(support: int) -> Column:
    """Whether the texts of a group have `support` contexts: exact up to two, an estimate from sketches of bounded size beyond."""
    marks = [f"m{k}" for k in range(1, CONTEXTS + 1)]
    if support <= 1:
        return F.count(F.lit(1)) > 0
    if support == 2:
        return reduce(Column.__and__, (F.max(m) > F.min(m) for m in marks))
    return F.least(*(F.approx_count_distinct(m, 0.01) for m in marks)) >= support


def npmi(pair: Column, term: Column, entity: Column, total: int) -> Column:
    """Of document frequencies. A pair in all documents discloses nothing."""
    n = F.lit(float(total))
    return F.when(pair < n, F.log2(pair * n / (term * entity)) / F.log2(n / pair))


def disclosing(docs: DataFrame, support: int = 2, generalise_at: float = 0.6) -> DataFrame:
    """(term, npmi) of the disclosing terms of rows (doc_id, row_key, text): the term's hash, its greatest npmi with an entity."""
    hits = common.checkpoint(found(docs))
    some = hits.where("base <> ''").groupBy("row_key").agg(F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("base", "entities", "text")))
    each = hits.where("base <> ''").groupBy("row_key").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities")).select("row_key", "copies", F.explode("entities").alias("entity"))
    # a pair has no more texts than its entity: entities below the support can't have a disclosing term
    entities = common.checkpoint(each.groupBy("entity").agg(F.sum("copies").alias("c_e"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support).drop("texts"))
    shared = each.join(entities, "entity", "left_semi").groupBy("row_key").agg(F.collect_list("entity").alias("entities"))
    near = pairs_of(some.drop("entities").join(shared, "row_key"))
    pairs = common.checkpoint(near.groupBy("entity", "term").agg(F.sum("copies").alias("c"), _seen(support).alias("seen")).where("seen").drop("seen"))
    counts = term_counts(docs).join(pairs.select("term").distinct(), "term", "left_semi")
    scored = pairs.join(counts, "term").join(entities, "entity").select("term", npmi(F.col("c"), F.col("n"), F.col("c_e"), max(hits.count(), 2)).alias("npmi"))
    return common.checkpoint(scored.where(F.col("npmi") >= generalise_at).groupBy("term").agg(F.max("npmi").alias("npmi")))


#: Disclosing terms that may be broadcast, 16 bytes each; beyond that they are joined by a shuffle.
BROADCAST_TERMS = 1_000_000


def _terms_by_row(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(row_key, bad), where bad is an array of the (term, npmi) that the row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in texts_of(batch.column("text")).pieces(1 << 20):
                words = spans_of(part, TERMS)
                both = np.unique(np.stack([words.doc, span_hashes(LOWER[part.data], words.start, words.end).view(np.int64)], 1), axis=0) if len(words) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("row_key").take(pa.array(both[:, 0] + row)), pa.array(np.ascontiguousarray(both[:, 1]))], names=["row_key", "term"])

    rows = docs.select("row_key", "text").dropDuplicates(["row_key"]).mapInArrow(run, "row_key struct<a: long, b: long>, term long")
    return rows.join(terms, "term").groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("term", "npmi"))).alias("bad"))


def _scan(docs: DataFrame, terms: DataFrame, make, schema: str, broadcast_terms: int) -> DataFrame:
    """Applies make(batch, texts, pattern spans, term spans) to batches of rows (..., row_key, text)."""
    small = terms.count() <= broadcast_terms
    packed = np.zeros(0, np.int64), np.zeros(0)
    if small:
        rows = terms.orderBy("term").collect()
        packed = np.array([r["term"] for r in rows], np.int64), np.array([r["npmi"] for r in rows], np.float64)
    else:
        docs = docs.join(_terms_by_row(docs, terms), "row_key", "left")
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [find(t) for t in texts]
            if small:
                terms_of = marked(texts_of(batch.column("text")), spans, *shared.value)
            else:
                terms_of = []
                for i, bad in enumerate(batch.column("bad").to_pylist()):
                    bad = bad or []
                    terms_of += marked(texts_of(batch.column("text").slice(i, 1)), spans[i : i + 1], np.array([x["term"] for x in bad], np.int64), np.array([x["npmi"] for x in bad], np.float64))
            yield make(batch, texts, spans, terms_of)

    return docs.mapInArrow(run, schema)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 2, generalise_at: float = 0.6, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """One row for each input row: doc_id, n_email, n_ip, n_card, n_phone, base (the pattern spans) and
    terms, an array of (s, e, npmi).

    Spans are of the whole text, in code points, end exclusive. Null and empty texts have none. Equal rows get equal results, and
    count as one context in `support`. A null id is carried through; other columns are ignored.
    """
    docs = common.two(docs, id_col, text_col)
    docs = docs.withColumn("row_key", common.row_key("doc_id", "text"))
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("npmi", pa.float64())]))

    def make(batch, texts, spans, terms_of):
        counts = [pa.array([sum(k == kind_ for k, _, _ in x) for x in spans], pa.int64()) for kind_ in KINDS]
        terms = pa.array([[{"s": s, "e": e, "npmi": v} for s, e, v in x] for x in terms_of], kind)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(map(join_spans, spans), pa.string()), terms], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "terms"])

    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base string, terms array<struct<s: int, e: int, npmi: double>>"
    return _scan(docs, disclosing(docs, support, generalise_at), make, schema, broadcast_terms)


def rewrite(text: str | None, spans: list[tuple[str, int, int, float]], remove_at: float) -> str | None:
    """The text with pattern spans replaced by their kind, and terms by their class or by nothing. Overlapping spans
    are replaced as one, under the kind of the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, s, e, npmi in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            word = text[s:e]
            put = f"<{kind}>" if kind != TERM else "" if npmi >= remove_at else "<number>" if word.isdigit() else "<name>" if word[:1].isupper() else "<term>"
            out += [text[at:s], put]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_at: float = 0.8, support: int = 2, generalise_at: float = 0.6, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """The input with the text column rewritten; all columns and all rows stay. A null text stays null.

    A span's placeholder is `<email>`, `<ip>`, `<card>` or `<phone>`; a disclosing term becomes `<number>`, `<name>` or
    `<term>`, or is removed from `remove_at` on. Texts are rewritten where they are found, without a shuffle, as long as the
    disclosing terms are few enough to be broadcast.
    """
    keyed = common.two(docs, id_col, text_col).withColumn("row_key", common.row_key("doc_id", "text"))
    terms = disclosing(keyed, support, generalise_at)
    others = [c for c in docs.columns if c != text_col]
    whole = common.with_key(docs, id_col, text_col)
    whole = whole.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(others)), F.col("__row_key").alias("row_key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = [f"k{i}" for i in range(len(others))]

    def make(batch, texts, spans, terms_of):
        out = [rewrite(t, [*((*x, 0.0) for x in mine), *((TERM, *x) for x in found_)], remove_at) for t, mine, found_ in zip(texts, spans, terms_of)]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.string())], names=[*names, "text"])

    schema = whole.select(*names).schema.add("text", "string")
    out = _scan(whole, terms, make, schema, broadcast_terms)
    back = dict(zip(others, names)) | {text_col: "text"}
    return out.select(*(F.col(back[c]).alias(c) for c in docs.columns))
