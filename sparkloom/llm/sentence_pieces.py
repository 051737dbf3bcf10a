"""SentencePiece encoding and decoding with N-best segmentation.

A text becomes a lattice of the vocabulary's pieces: an edge for each piece that
matches, its weight the piece's score; a character without a piece of its own
gets an edge of its UTF-8 byte pieces at a score below all others.  No piece
crosses from a word to the next space, so the lattice falls into one part per
word (spaces and what follows them), and equal words share a part.

* Forward Viterbi runs over many distinct words at once in numpy, with the best
  and the second-best score of each node: a word's best segmentation and what its
  second best loses.
* N-best: backward A* over a word's lattice with the forward scores as exact
  heuristic.  Only the N-1 words of a text that lose least can differ in its N
  best segmentations; the search runs on them and their lists are merged.

Scores are log-probabilities.  A unigram model's file has them.  A merge model's file has ranks of merges, which
are no scores of a lattice: its pieces get Zipf's law, a probability in proportion to 1 / (rank + ``SHIFT``),
rank by the file's scores.  The best path is thus the one that the library finds with
a unigram model of these pieces and scores, not what a merge model's own greedy merging gives.

Decoding joins the bytes of pieces, so it restores every text exactly, runs of
spaces and a literal U+2581 included.

Defined results: a null text counts as empty; an empty text has no pieces, score
0 and one segmentation; an empty table gives an empty result; texts of any length are encoded whole; repeated rows give
equal results; ties of score go to longer last pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = 0x2581
#: No code point: stands for a literal mark in a text, which no piece may match.
LITERAL = 0x110000
FALLBACK = -2
#: Segmentations asked for; distinct words kept by a worker; characters of words in a lattice; texts' characters at once.
BEST = 4
CACHE = 500_000
LATTICE = 200_000
#: Shift of Zipf's law over the pieces of a merge model, and what the library takes off the least score for an unknown character.
SHIFT = 300
UNKNOWN_LOSS = 10.0
CHARS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_UNIT = re.compile(" +[^ ]*")
_NEVER = float("inf")


def units_of(text: str) -> list[str]:
    """Words with the spaces before them; the first gets the one that encoding puts in front."""
    return _UNIT.findall(" " + text) if text else []


def log_probabilities(path: str) -> dict[int, float]:
    """Scores of a model file's normal pieces by id: a unigram model's own, Zipf's law for a merge model."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    score = {i: p.score for i, p in enumerate(model.pieces) if p.type in (p.NORMAL, p.USER_DEFINED)}
    if model.trainer_spec.model_type == model.trainer_spec.UNIGRAM:
        return score
    ranks = sorted(score, key=lambda i: (-score[i], i))
    total = math.log(sum(1 / (r + SHIFT) for r in range(1, len(ranks) + 1)))
    return {i: -math.log(r + SHIFT) - total for r, i in enumerate(ranks, 1)}


class Vocabulary:
    """Pieces, scores and a hash table of a SentencePiece model file."""

    def __init__(self, path: str | None = None) -> None:
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=str(path))
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []
        self.scores = np.zeros(model.get_piece_size())
        told = log_probabilities(str(path))
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.scores[i] = told.get(i, 0.0)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[piece] = i
                self.raw.append(piece.replace(chr(SPACE_MARK), " ").encode())
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.begin = np.append(0, np.cumsum([len(b) for b in self.raw]))
        self.longest = max(map(len, self.ids), default=1)
        self.fallback = min(told.values(), default=0.0) - UNKNOWN_LOSS
        self._hash_table()

    def _hash_table(self) -> None:
        """Open tables by the top bits of a piece's hash; what collides goes to the next table."""
        keys = {}
        for piece, i in self.ids.items():
            h = np.zeros(1, np.uint64)
            for c in piece:
                h = _extend(h, np.array([ord(c)], np.uint64))
            keys[int(h[0])] = i
        if len(keys) != len(self.ids):
            raise ValueError("two pieces have one hash")
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        while keys:
            key, value, rest = np.zeros(1 << 20, np.uint64), np.full(1 << 20, -1, np.int32), {}
            for h, i in keys.items():
                if value[h >> 44] < 0:
                    key[h >> 44], value[h >> 44] = h, i
                else:
                    rest[h] = i
            self.tables.append((key, value))
            keys = rest

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 where there is none."""
        at = (h >> np.uint64(44)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        for key, value in self.tables:
            out = np.where((out < 0) & (key[at] == h), value[at], out)
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; the leading space that encoding put in front goes."""
        text = gather(self.bytes, self.begin, np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def edges_back(self, unit: str, end: int) -> Iterator[tuple[int, int, float]]:
        """(start, piece id or FALLBACK, score) of the edges into ``end``."""
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            i = self.ids.get(unit[start:end])
            if i is not None:
                yield start, i, self.scores[i]
            elif start == end - 1:
                yield start, FALLBACK, self.fallback

    def expand(self, path: Sequence[int], marked: str) -> list[int]:
        """Ids of a path over a marked word, fallback edges as bytes."""
        out, at = [], 0
        for i in path:
            if i == FALLBACK:
                c = marked[at]
                out += [self.byte_ids[b] for b in (chr(SPACE_MARK) if c == _STAND_IN else c).encode()]
                at += 1
            else:
                out.append(i)
                at += len(self.raw[i].decode())
        return out


#: In Python strings a literal mark becomes this non-character, which no piece has.
_STAND_IN = "￿"


def mark(unit: str) -> str:
    return unit.replace(chr(SPACE_MARK), _STAND_IN).replace(" ", chr(SPACE_MARK))


def _extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c) * _MIX
    return h ^ (h >> np.uint64(29))


def best_segmentations(vocabulary: Vocabulary, units: Sequence[str]) -> list[tuple[bytes, float, float]]:
    """For each word: ids of the best path as bytes, its score, and the loss of the second best."""
    marked = [mark(u) for u in units]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, units), np.int64, len(units))
    start = np.cumsum(length) - length
    unit = np.repeat(np.arange(len(units)), length)
    end = np.repeat(start + length, length)
    n, width = len(codes), min(vocabulary.longest, int(length.max()))
    # Edges: where each piece starts, its length, id and score.  Node of position p in unit u: p + u.
    at, h, found = np.arange(n), np.zeros(n, np.uint64), []
    for size in range(1, width + 1):
        inside = at + size <= end[at]
        at, h = at[inside], h[inside]
        h = _extend(h, codes[at + size - 1])
        i = vocabulary.find(h)
        if size == 1:
            i = np.where(i < 0, FALLBACK, i)
        there = np.flatnonzero(i != -1)
        found.append((at[there], np.full(len(there), size), i[there]))
    where, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    weight = np.where(piece == FALLBACK, vocabulary.fallback, vocabulary.scores[piece])
    step = where - start[unit[where]] + size
    target = where + unit[where] + size
    order = np.argsort(step * (n + len(units) + 1) + target, kind="stable")  # equal targets: shorter pieces first
    where, size, piece, weight, step, target = (x[order] for x in (where, size, piece, weight, step, target))
    source = target - size
    first, second = np.full(n + len(units), -np.inf), np.full(n + len(units), -np.inf)
    first[start + np.arange(len(units))] = 0.0
    back = np.zeros(n + len(units), np.int64)
    fresh = np.append(True, target[1:] != target[:-1])
    bounds = np.searchsorted(step, np.arange(1, int(length.max()) + 2))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        value = first[source[lo:hi]] + weight[lo:hi]
        group = np.flatnonzero(fresh[lo:hi])
        node = target[lo:hi][group]
        best = np.maximum.reduceat(value, group)
        first[node] = best
        top = np.flatnonzero(value == np.repeat(best, np.diff(np.append(group, hi - lo))))
        back[target[lo:hi][top]] = lo + top  # of ties the last, the longest piece, stays
        value[back[node] - lo] = -np.inf
        second[node] = np.maximum(np.maximum.reduceat(value, group), np.maximum.reduceat(second[source[lo:hi]] + weight[lo:hi], group))
    last = start + np.arange(len(units)) + length
    total, loss = first[last], first[last] - second[last]
    chosen = np.full(n, -1, np.int32)
    live, node, origin = np.arange(len(units)), last.copy(), last - length
    while len(live):
        edge = back[node]
        chosen[where[edge]] = piece[edge]
        node = source[edge]
        more = node > origin[live]
        live, node = live[more], node[more]
    first_of = np.flatnonzero(chosen != -1)
    path = chosen[first_of]
    bound = np.searchsorted(first_of, np.append(start, n))
    data = path.astype("<u4").tobytes()
    strange = set(unit[first_of[path == FALLBACK]].tolist())
    out = []
    for i, (a, b, v, d) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist(), total.tolist(), loss.tolist(), strict=True)):
        if i in strange:
            own = np.asarray(vocabulary.expand(path[a:b].tolist(), marked[i]), "<u4").tobytes()
        else:
            own = data[4 * a : 4 * b]
        out.append((own, v, d))
    return out


def a_star(vocabulary: Vocabulary, unit: str, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best (score, ids) of one word: backward search, forward scores as heuristic."""
    marked = mark(unit)
    edges = [list(vocabulary.edges_back(marked, j)) for j in range(len(marked) + 1)]
    forward = [0.0]
    for j in range(1, len(marked) + 1):
        forward.append(max(forward[i] + s for i, _, s in edges[j]))
    ticket = itertools.count()
    heap: list[tuple] = [(-forward[-1], len(marked), 0, 0.0, None)]
    out: list[tuple[float, list[int]]] = []
    while heap and len(out) < n:
        _, at, _, done, path = heapq.heappop(heap)
        if at == 0:
            ids = []
            while path:
                ids.append(path[0])
                path = path[1]
            out.append((done, vocabulary.expand(ids, marked)))
            continue
        for i, piece, s in edges[at]:
            heapq.heappush(heap, (-(done + s + forward[i]), i, next(ticket), done + s, (piece, path)))
    return out


def gather(flat: np.ndarray, begin: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The runs ``flat[begin[k] : begin[k + 1]]`` of all picks, joined."""
    size = begin[picks + 1] - begin[picks]
    stop = np.cumsum(size)
    return flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin[picks] - stop + size, size)]


class Codec:
    """Encodes and decodes texts; keeps what it knows of words up to a bound."""

    def __init__(self, path: str | None = None, best: int = BEST) -> None:
        self.vocabulary, self.best = Vocabulary(path), best
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.lists: dict[str, list[tuple[float, list[int]]]] = {}
        self.score, self.loss, self.begin = np.zeros(0), np.zeros(0), np.zeros(1, np.int64)
        self.flat = np.zeros(0, "<u4")
        self.last, self.turn = np.zeros(0, np.int64), 0

    def _halve(self) -> None:
        """Keep the half of the words that were met last."""
        n, words = len(self.index), list(self.index)
        keep = np.sort(np.argsort(-self.last[:n], kind="stable")[: n // 2])
        sizes = self.begin[keep + 1] - self.begin[keep]
        self.flat = gather(self.flat, self.begin, keep)
        self.begin = np.append(0, np.cumsum(sizes))
        self.score, self.loss, self.last = self.score[keep], self.loss[keep], self.last[keep]
        self.index = {words[k]: i for i, k in enumerate(keep.tolist())}
        self.lists = {u: x for u, x in self.lists.items() if u in self.index}

    def _add(self, name: str, at: int, values: np.ndarray) -> None:
        """Put values at a place of an array, which doubles when it is full."""
        now = getattr(self, name)
        if at + len(values) > len(now):
            wider = np.zeros(max(2 * len(now), at + len(values)), now.dtype)
            wider[:at] = now[:at]
            setattr(self, name, wider)
            now = wider
        now[at : at + len(values)] = values

    def learn(self, texts_units: Sequence[list[str]]) -> None:
        """Make all words of the texts known."""
        self.turn += 1
        if len(self.index) > CACHE:
            self._halve()
        fresh = list(dict.fromkeys(u for units in texts_units for u in units if u not in self.index))
        some, chars = [], 0
        for u in [*fresh, None]:
            if some and (u is None or chars + len(u) > LATTICE):
                ids, score, loss = zip(*best_segmentations(self.vocabulary, some), strict=True)
                n, end = len(self.index), int(self.begin[len(self.index)])
                self.index |= zip(some, range(n, n + len(some)), strict=True)
                self._add("score", n, np.array(score))
                self._add("last", n, np.zeros(len(some), np.int64))
                self._add("loss", n, np.array(loss))
                self._add("begin", n + 1, end + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4))
                self._add("flat", end, np.frombuffer(b"".join(ids), "<u4"))
                some, chars = [], 0
            if u is not None:
                some.append(u)
                chars += len(u)

    def places(self, units: list[str]) -> np.ndarray:
        """Numbers of known words, which are thereby met."""
        out = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        self.last[out] = self.turn
        return out

    def best_ids(self, places: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.begin, places)

    def nbest(self, units: list[str], places: np.ndarray, n: int) -> list[tuple[float, dict[int, list[int]]]]:
        """The ``n`` best segmentations of known words: scores, and ids where they differ from the best."""
        total, loss = float(self.score[places].sum()), self.loss[places]
        few = n - 1 if n - 1 < len(loss) else len(loss)
        weak = np.sort(np.argpartition(loss, few - 1)[:few]).tolist() if few else []
        lists = []
        for i in weak:
            if loss[i] == np.inf:
                continue
            u = units[i]
            if u not in self.lists:
                self.lists[u] = a_star(self.vocabulary, u, n)
            lists.append((i, self.lists[u]))
        # Merge of sorted lists: a choice of one entry each, by total score.
        heap = [(-total, (0,) * len(lists))]
        seen, out = {heap[0][1]}, []
        while heap and len(out) < n:
            value, pick = heapq.heappop(heap)
            out.append((-value, {lists[k][0]: lists[k][1][p][1] for k, p in enumerate(pick) if p}))
            for k, p in enumerate(pick):
                follow = (*pick[:k], p + 1, *pick[k + 1 :])
                if p + 1 < len(lists[k][1]) and follow not in seen:
                    seen.add(follow)
                    heapq.heappush(heap, (value + lists[k][1][p][0] - lists[k][1][p + 1][0], follow))
        return out

    def replaced(self, ids: np.ndarray, places: np.ndarray, other: dict[int, list[int]]) -> np.ndarray:
        """The best ids of words with those of some words replaced."""
        if not other:
            return ids
        ends = np.cumsum(self.begin[places + 1] - self.begin[places])
        out, at = [], 0
        for i in sorted(other):
            first = ends[i] - (self.begin[places[i] + 1] - self.begin[places[i]])
            out += [ids[at:first], np.asarray(other[i], "<u4")]
            at = ends[i]
        return np.concatenate([*out, ids[at:]])

    def encode(self, text: str, n: int = 1) -> list[tuple[float, list[int]]]:
        """The ``n`` best (score, ids) of a text."""
        units = units_of(text)
        self.learn([units])
        places = self.places(units)
        best = [self.flat[self.begin[k] : self.begin[k + 1]].tolist() for k in places]
        return [(score, [x for i, ids in enumerate(best) for x in other.get(i, ids)]) for score, other in self.nbest(units, places, n)]

    def decode(self, ids: Sequence[int]) -> str:
        return self.vocabulary.decode(ids)


@cache
def codec_of(model: str | None, best: int) -> Codec:
    """One per worker process: tasks that follow in it find its words known."""
    return Codec(model, best)


def starts(lists: Sequence) -> pa.Array:
    """Offsets of lists that follow one another."""
    return pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())


def id_lists(lists: Sequence[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(starts(lists), pa.array(np.concatenate(lists).astype("<i4")))


def encode_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: str | None = None, best: int = BEST) -> DataFrame:
    """Per row: the best ids and the ``best`` segmentations (score, ids), best first; with them piece count,
    CRC of the best ids, scores to three places, and whether decoding restores the text."""
    spec = "doc_id long, n_pieces long, ids_crc32 long, score double, nbest_scores string, restored boolean, ids array<int>, nbest array<struct<score:double,ids:array<int>>>"
    names_of = [c.split()[0] for c in spec.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model, best)

        def rows(names: list, texts: list[str]) -> pa.RecordBatch:
            split = [units_of(t) for t in texts]
            codec.learn(split)
            out, every, lists = [], [], []
            for name, text, units in zip(names, texts, split, strict=True):
                places = codec.places(units)
                ids, found = codec.best_ids(places), codec.nbest(units, places, best)
                out.append((name, len(ids), zlib.crc32(ids.tobytes()), found[0][0], ",".join(f"{s:.3f}" for s, _ in found), codec.decode(ids) == text))
                every.append(ids)
                lists.append([(s, codec.replaced(ids, places, other)) for s, other in found])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.bool_())
            plain = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            flat = [x for found in lists for x in found]
            pairs = pa.StructArray.from_arrays([pa.array([s for s, _ in flat], pa.float64()), id_lists([x for _, x in flat])], names=["score", "ids"])
            nbest = pa.ListArray.from_arrays(starts(lists), pairs)
            return pa.RecordBatch.from_arrays([*plain, id_lists(every), nbest], names=names_of)

        for batch in batches:
            names, texts, chars = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                names.append(doc_id.as_py())
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars >= CHARS:
                    yield rows(names, texts)
                    names, texts, chars = [], [], 0
            if names:
                yield rows(names, texts)

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, spec)


def decode_documents(df: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", model: str | None = None) -> DataFrame:
    """Texts of rows of piece ids (an array column); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model)
        for batch in batches:
            texts = [None if ids is None else vocabulary.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return slim.mapInArrow(run, "doc_id long, text string")
