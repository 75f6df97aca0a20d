"""SentencePiece encoding and decoding with N-best segmentations.

The lattice of a text has an edge for each span that is a piece, with the piece's score; a segmentation is a path, and the best
one has the greatest sum. Pieces hold the word mark only at their start, so a text falls into segments at the
marks (and around characters without a piece, which become bytes), and paths of segments are independent.
Forward Viterbi runs over all distinct segments of a batch at once. N-best: a backward A* search over a segment's
lattice takes the forward scores as exact heuristics, so it expands nothing that isn't on one of the N paths. A text's N
best combine the alternatives of the N - 1 segments whose second-best paths lose least; no others can occur in them. Each of
the N has its piece ids.

The model file gives pieces and scores. Scores are log-probabilities, as in a unigram file. A BPE file has merge ranks instead;
they become log-probabilities by the law of Zipf and Mandelbrot, so that a path's sum means what it does in a unigram model. No
tokenizer is trained. Normalisation is the file's own: spaces become marks, one is put in front. Decoding gives the text back exactly, but for word marks (U+2581) in the text itself, which become spaces.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirefold.llm.textcore import U64, equal_classes, gather, join, mix, span_hashes, texts_of

#: Where the public model file is here; load() takes any path.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
LONG = 48  # code points beyond which a segment is done by itself
GRID = 2.0**20  # scores are multiples of 1 / GRID, so that sums are exact and equal paths have equal scores in any order
MANDELBROT = 2.7  # shift of ranks in p(rank) ~ 1 / (rank + shift)


NO_RANK = -1e8  # scores below stand for pieces that come after all ranks


def rank_scores(scores: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Scores as log-probabilities. A BPE file has whole numbers from 0 down, no two alike; any others are taken as they are."""
    ranked = usable & (scores > NO_RANK)
    rank = -scores
    if ranked.sum() < 2 or (rank[ranked] != np.floor(rank[ranked])).any() or (rank[ranked] < 0).any() or len(np.unique(rank[ranked])) < ranked.sum():
        return scores
    rank[usable & ~ranked] = rank[ranked].max() + 1
    out = scores.copy()
    out[usable] = -np.log(rank[usable] + MANDELBROT) - np.log((1 / (rank[usable] + MANDELBROT)).sum())
    return out


def _codes_hash(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(U64) + U64(1))


@dataclass
class Model:
    """Pieces by id. `bytes_of` are the UTF-8 bytes that each decodes to, `byte_ids` the pieces of single bytes."""

    texts: list[str]
    scores: np.ndarray
    usable: np.ndarray
    byte_ids: list[int]

    @classmethod
    def load(cls, path: str) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        usable = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) for i in range(n)])
        scores = rank_scores(np.array([sp.get_score(i) for i in range(n)]), usable)
        model = cls(texts, np.round(scores * GRID) / GRID, usable, byte_ids)
        if any(chr(MARK) in t.lstrip(chr(MARK)) for t, u in zip(texts, usable) if u) or not all(map(sp.is_byte, byte_ids)):
            raise ValueError("pieces must hold word marks in front only, and there must be a piece for each byte")
        return model

    def prepare(self) -> _Lattice:
        return _Lattice(self)


class _Lattice:
    def __init__(self, model: Model):
        self.model = model
        ids = [i for i in range(len(model.texts)) if model.usable[i]]
        self.ids = {model.texts[i]: i for i in ids}
        self.longest = max(map(len, self.ids))
        self.unknown = float(model.scores[ids].min()) - 10.0
        self.score = np.append(model.scores, -np.inf)  # index -1: no piece
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(t) for t in self.ids if len(t) == 1]] = True
        prints = np.zeros(len(ids), U64)
        size = np.array([len(t) for t in self.ids])
        for w in np.unique(size):
            mine = np.flatnonzero(size == w)
            h = _codes_hash(np.frombuffer("".join(t for t in self.ids if len(t) == w).encode("utf-32-le"), np.uint32).reshape(-1, w))
            prints[mine] = self.grown(h[:, 0], h[:, 1:].T)
        order = np.argsort(prints)
        self.prints, self.piece = prints[order], np.array(list(self.ids.values()))[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.prints >> U64(42)] = True
        head = np.searchsorted(self.prints >> U64(44), np.arange((1 << 20) + 1, dtype=U64))  # by the top 20 bits
        self.deepest, self.head = int(np.diff(head).max()), np.minimum(head, len(self.prints) - 1).astype(np.int32)
        raw = [bytes([model.byte_ids.index(i)]) if i in set(model.byte_ids) else (t.replace(chr(MARK), " ").encode() if model.usable[i] else b"") for i, t in enumerate(model.texts)]
        self.raw, stop = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
        self.raw_at = np.r_[0, stop]
        self.cache: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}

    @staticmethod
    def grown(h: np.ndarray, more) -> np.ndarray:
        """Hashes of sequences that start as h says and go on by each of `more` in turn."""
        for x in more:
            h = join(h, x, 0)
        return h

    def pieces_at(self, h: np.ndarray, n: int) -> np.ndarray:
        """The piece that each window of a sequence of n codes is, by the windows' hashes, or -1."""
        out = np.full(n, -1, np.int32)
        some = np.flatnonzero(self.maybe[h >> U64(42)])
        wanted = h[some]
        at = self.head[wanted >> U64(44)]
        for _ in range(self.deepest):
            ok = self.prints[at] == wanted
            out[some[ok]] = self.piece[at[ok]]
            at = np.minimum(at + 1, len(self.prints) - 1)
        return out

    # one segment by itself

    def edges(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(end, start, score), ends ascending and longest pieces first."""
        for e in range(1, len(text) + 1):
            for s in range(max(0, e - self.longest), e):
                if (i := self.ids.get(text[s:e])) is not None:
                    yield e, s, float(self.score[i])

    def forward(self, text: str) -> tuple[list[float], list[int], list[float]]:
        """Best score up to each position, where its last piece starts, and the score of the second choice there."""
        best, back, second = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1), [-math.inf] * (len(text) + 1)
        for e, s, w in self.edges(text):
            v = best[s] + w
            second[e] = max(second[e], min(v, best[e]))
            if v > best[e]:
                best[e], back[e] = v, s
        return best, back, second

    def search(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, piece ids) of a segment: A* from its end, forward scores as exact heuristics."""
        best, _, _ = self.forward(text)
        into: list[list[tuple[int, float]]] = [[] for _ in range(len(text) + 1)]
        for e, s, w in self.edges(text):
            into[e].append((s, w))
        heap, order, out = [(-best[-1], 0, len(text), 0.0, None)], 1, []
        while heap and len(out) < n:
            _, _, at, got, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                out.append((got, ids))
                continue
            for s, w in into[at]:
                heapq.heappush(heap, (-(got + w + best[s]), order, s, got + w, (self.ids[text[s:at]], path)))
                order -= 1  # of equal scores the latest first: in depth, as there can be exponentially many
        return out

    def alternatives(self, text: str, n: int, first: list[int]) -> list[tuple[float, list[int]]]:
        """(loss against the best, piece ids) of the n best of a segment, of which `first`, a best one, comes first."""
        if (got := self.cache.get((text, n))) is None:
            found = self.search(text, n)
            best = found[0][0]
            # of more than n equal ones the search may have left `first` out: it then takes the place of the last
            others = [(max(best - score, 0.0), ids) for score, ids in found if ids != first]
            got = [(0.0, first), *others[: n - 1]]
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[text, n] = got
        return got

    # all segments of a batch

    def viterbi(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(score, loss of the second-best path, first piece, pieces' ids one segment after the other), of segments by start and size."""
        n = len(start)
        score, loss, count = np.zeros(n), np.full(n, np.inf), np.zeros(n, np.int64)
        rows, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        odd = (size == 1) & ~self.known[codes[start]] if n else np.zeros(0, bool)
        for i in np.flatnonzero(odd):
            got = [self.model.byte_ids[b] for b in chr(codes[start[i]]).encode()]
            score[i] = self.unknown
            rows.append(np.full(len(got), i))
            ids.append(np.array(got))
        for i in np.flatnonzero(size > LONG):
            text = codes[start[i] : start[i] + size[i]].astype("<u4").tobytes().decode("utf-32-le")
            best, back, second = self.forward(text)
            at, got = len(text), []
            score[i] = best[at]
            while at:
                loss[i] = min(loss[i], best[at] - second[at])
                got.append(self.ids[text[back[at] : at]])
                at = back[at]
            rows.append(np.full(len(got), i))
            ids.append(np.array(got[::-1]))
        for lo, hi in ((0, 8), (8, 16), (16, LONG)):
            mine = np.flatnonzero((size > lo) & (size <= hi) & ~odd)
            if not len(mine):
                continue
            mine = mine[np.argsort(-size[mine], kind="stable")]
            length = size[mine]
            own = gather(codes, start[mine], start[mine] + length)
            base = np.cumsum(length) - length
            top = int(length[0])
            single = _codes_hash(own)
            h, piece = single, [None, self.pieces_at(single, len(own))]
            for w in range(2, min(top, self.longest) + 1):
                h = join(h[:-1], single[w - 1 :], 0)
                piece.append(self.pieces_at(h, len(own)))
            best = np.full((len(mine), top + 1), -np.inf)
            best[:, 0] = 0
            gap, back = np.full((len(mine), top + 1), np.inf), np.zeros((len(mine), top + 1), np.int8)
            for e in range(1, top + 1):
                k = int(np.searchsorted(-length, -e, "right"))  # segments that reach e
                top_v, second, width = np.full(k, -np.inf), np.full(k, -np.inf), np.zeros(k, np.int8)
                for w in range(min(e, self.longest), 0, -1):
                    v = best[:k, e - w] + self.score[piece[w][base[:k] + e - w]]
                    second = np.maximum(second, np.minimum(top_v, v))
                    better = v > top_v
                    width[better] = w
                    top_v = np.maximum(top_v, v)
                best[:k, e], back[:k, e] = top_v, width
                gap[:k, e] = top_v - np.where(second == -np.inf, -np.inf, second)
            score[mine] = best[np.arange(len(mine)), length]
            at, live, lost = length.copy(), np.arange(len(mine)), np.full(len(mine), np.inf)
            steps = []
            while len(live):
                w = back[live, at[live]].astype(np.int64)
                lost[live] = np.minimum(lost[live], gap[live, at[live]])
                at[live] -= w
                where, found = base[live] + at[live], np.zeros(len(live), np.int64)
                for x in np.unique(w):
                    found[w == x] = piece[x][where[w == x]]
                steps.append((mine[live], found))
                live = live[at[live] > 0]
            loss[mine] = lost
            rows += [r for r, _ in reversed(steps)]
            ids += [i for _, i in reversed(steps)]
        rows, ids = np.concatenate(rows), np.concatenate(ids)
        order = np.argsort(rows, kind="stable")
        count = np.bincount(rows, minlength=n)
        return score, loss, np.cumsum(count) - count, np.append(ids[order], 0)[:-1] if len(ids) else ids

    def encode(self, texts: list[str], n: int) -> Iterator[tuple[np.ndarray, list[float]]]:
        """(ids of the best segmentation, scores of the n best) of each text. An empty text has no pieces, and score 0."""
        for found in self.nbest(texts, n):
            yield found[0][1], [score for score, _ in found]

    def nbest(self, texts: list[str], n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
        """(score, ids) of the n best segmentations of each text, best first; fewer where there are fewer."""
        marked = [chr(MARK) + t.replace(" ", chr(MARK)) if t else "" for t in texts]
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.int64)
        offs = np.r_[0, np.cumsum([len(t) for t in marked])].astype(np.int64)
        mark, strange = codes == MARK, ~self.known[codes]
        opens = mark | strange
        opens[1:] &= ~(mark[1:] & mark[:-1])
        opens[1:] |= strange[:-1]
        opens[offs[:-1][offs[:-1] < len(codes)]] = True
        start = np.flatnonzero(opens)
        end = np.append(start[1:], len(codes))[: len(start)]
        raw = codes.astype("<u4").view(np.uint8)
        _, first, which = np.unique(equal_classes(raw, 4 * start, 4 * end, span_hashes(raw, 4 * start, 4 * end)), return_index=True, return_inverse=True)
        score, loss, at, ids = self.viterbi(codes, start[first], (end - start)[first])
        count = np.diff(np.append(at, len(ids)))
        segment = np.searchsorted(start, offs)
        every = gather(ids, at[which], at[which] + count[which]) if len(which) else ids
        upto = np.r_[0, np.cumsum(count[which])].astype(np.int64)
        total = np.r_[0.0, np.cumsum(score[which])][segment]
        for d in range(len(texts)):
            i, j = segment[d], segment[d + 1]
            mine = which[i:j]
            worst = loss[mine]
            near = np.argpartition(worst, min(n - 1, len(worst) - 1))[: n - 1] if n > 1 and len(worst) > n - 1 else np.arange(len(worst)) if n > 1 else []
            sums = [(0.0, ())]
            for k in sorted(near, key=lambda k: (worst[k], k)):
                if worst[k] == np.inf:
                    continue
                u = first[mine[k]]
                text = codes[start[u] : end[u]].astype("<u4").tobytes().decode("utf-32-le")
                ways = self.alternatives(text, n, ids[at[mine[k]] : at[mine[k]] + count[mine[k]]].tolist())
                sums = heapq.nsmallest(n, ((a + b, (*path, (int(k), way)) if x else path) for a, path in sums for x, (b, way) in enumerate(ways)), key=lambda x: x[0])
            out = []
            for lost, path in sums:
                last, parts = upto[i], []
                for k, way in sorted(path, key=lambda x: x[0]):
                    parts += [every[last : upto[i + k]], np.array(way, np.int64)]
                    last = upto[i + k + 1]
                out.append((float(total[d + 1] - total[d] - lost), np.concatenate([*parts, every[last : upto[j]]])))
            yield out

    def decode(self, ids: np.ndarray) -> str:
        raw = gather(self.raw, self.raw_at[ids], self.raw_at[ids + 1]).tobytes().decode(errors="replace") if len(ids) else ""
        return raw[1:] if raw.startswith(" ") else raw


def _lists(ids: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(i) for i in ids])], pa.int32()), pa.array(np.concatenate(ids), pa.int32()))


def encode(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, n: int = 4, piece_bytes: int = 1 << 20) -> DataFrame:
    """The columns `keep` of each row, ids (array<int>) of the best segmentation, n_pieces, the scores of the n best
    (nbest_scores, descending; fewer where the lattice has fewer paths), ids_sha256, round_trip, the n best themselves (nbest, an
    array of (score, ids), the best one first) and the digest of each (nbest_sha256).

    Digests are of ids as little-endian 32-bit integers. Null and empty texts have no pieces and one score, 0. round_trip tells
    whether decoding the ids of each of the n best gives the text (word marks as spaces). Repeated rows give repeated results; other columns
    are ignored. The model, whose vocabulary bounds it, is broadcast.
    """
    keep = keep or ["doc_id"]
    source = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = source.drop("text").schema
    extra = [("ids", "array<int>", pa.list_(pa.int32())), ("n_pieces", "long", pa.int64()), ("nbest_scores", "array<double>", pa.list_(pa.float64())), ("ids_sha256", "string", pa.string()), ("round_trip", "boolean", pa.bool_()), ("nbest", "array<struct<score: double, ids: array<int>>>", pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))), ("nbest_sha256", "array<string>", pa.list_(pa.string()))]
    schema = StructType([*schema.fields, *StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind, _ in extra)).fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value.prepare()
        for batch in batches:
            for row, part in texts_of(batch.column("text")).pieces(piece_bytes):
                texts = [part.data[i:j].tobytes().decode() for i, j in zip(part.offs[:-1], part.offs[1:])]
                found = [[(score, i.astype("<i4")) for score, i in x] for x in lattice.nbest(texts, n)]
                digests = [[hashlib.sha256(i.tobytes()).hexdigest() for _, i in x] for x in found]
                first, each = _lists([x[0][1] for x in found]), [y for x in found for y in x]
                ways = pa.StructArray.from_arrays([pa.array([score for score, _ in each], pa.float64()), _lists([i for _, i in each])], names=["score", "ids"])
                ways = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in found])], pa.int32()), ways)
                whole = [all(lattice.decode(i) == t.replace(chr(MARK), " ") for _, i in x) for x, t in zip(found, texts)]
                columns = [first, pa.array([len(x[0][1]) for x in found], pa.int64()), pa.array([[score for score, _ in x] for x in found], pa.list_(pa.float64())), pa.array([x[0] for x in digests]), pa.array(whole, pa.bool_()), ways, pa.array(digests, pa.list_(pa.string()))]
                kept = batch.slice(row, len(part)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*(f"k{i}" for i in range(len(keep))), *(x[0] for x in extra)])

    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(x[0] for x in extra))


def decode(docs: DataFrame, model: Model, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of each row and text, which its ids stand for. Null ids give a null text, empty ones an empty text.

    An id that is null or not in the model is an error. Bytes that are not UTF-8 become U+FFFD.
    """
    keep = keep or ["doc_id"]
    source = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value.prepare()
        for batch in batches:
            texts = []
            for row in batch.column("ids"):
                if row.values is not None and (row.values.null_count or len(row.values) and not 0 <= pc.min(row.values).as_py() <= pc.max(row.values).as_py() < len(lattice.raw_at) - 1):
                    raise ValueError("an id is null or not in the model")
                texts.append(None if row.values is None else lattice.decode(row.values.to_numpy().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*(f"k{i}" for i in range(len(keep))), "text"])

    out = source.mapInArrow(run, source.drop("ids").schema.add("text", "string"))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text")
