"""Packing: documents into token sequences, by context-size tiers.

A task tokenizes its documents and packs them in blocks of bounded size, so no
token is shuffled.  Of a document longer than the longest window, full windows
are cut off; what is left is routed to the smallest tier that holds it.  Tiers
are packed from the longest: each window starts with the tier's largest piece,
then the largest pieces of shorter tiers that fit fill its gap, and the last
gap takes a cut of a longer piece, whose rest is routed anew.  Windows are thus
full; a tier's length is a power of two, so a short window needs no padding.
Pieces that fill no window wait for the next block; at a task's end they are cut
into powers of two down to ``LEAST_TAIL`` and at most one padded rest.

Step groups gather windows, longest first, up to equal numbers of tokens.

Sequence ids hold the partition and a counter; a task that runs again gives the
same ids.  Defined results: a null text is an empty one (only the end id); texts
of any length are tokenized whole; repeated rows are packed as often as they
come; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._memory import release

TIERS = (512, 1024, 2048, 4096)
#: Tokens gathered before a block is packed, tokens of a step group, shortest unpadded tail.
BLOCK = 1 << 21
STEP = 8 * 4096
LEAST_TAIL = 64
#: Encoded words that a Python worker holds, about, and those it keeps when it has so many or a task ends; characters encoded at once.
CACHE = 600_000
KEPT = 50_000
CHARS = 1 << 20
END = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long, ids array<int>"


class WordEncoder:
    """Ids of texts, as little-endian 32-bit bytes, from ids of their words.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words in turn; each word is encoded once while it is kept.
    The words met first are kept: common words are among them, and most others never come again.
    """

    #: White space to Python but not to the tokenizer: such texts are encoded whole.
    ODD = re.compile("[\x1c-\x1f]")
    SHAPE = re.compile("([a-zß-öø-ÿ]+)([.,;:!?*$#%&|)]*)")

    def __init__(self, path: str | None) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(str(path))
        self.known: dict[str, bytes] = {}
        self.zero = self._ids("0")[-1]

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        """Make words known: the common shape is letters, then marks, which the tokenizer splits and encodes apart."""
        shapes = [self.SHAPE.fullmatch(w.lower()) for w in words]
        parts = dict.fromkeys(p for w, m in zip(words, shapes, strict=True) for p in (m.groups() if m else (w,)) if p)
        fresh = [p for p in parts if p not in self.known]
        for i in range(0, len(fresh), 2_000):
            self._fresh(fresh[i : i + 2_000])
        for w, m in zip(words, shapes, strict=True):
            if m:
                letters, marks = m.groups()
                self.known[w] = self.known[letters] + self.known[marks] if marks else self.known[letters]

    def _fresh(self, words: list[str]) -> None:
        """Encode words, many at once: a zero between them marks where each ends.

        The zero's id comes from that digit alone; words that hold one are encoded by themselves.
        """
        plain = [w for w in words if "0" not in w]
        ids = self._ids(" 0 ".join(plain))
        cuts = np.flatnonzero(ids == self.zero)
        if len(plain) and len(cuts) == len(plain) - 1:
            data, bounds = ids.tobytes(), (4 * np.concatenate(([-1], cuts, [len(ids)]))).tolist()
            self.known |= zip(plain, [data[x + 4 : y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)], strict=True)
            words = [w for w in words if "0" in w]
        for w in words:
            self.known[w] = self._ids(w).tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        split = [None if self.ODD.search(t) else t.split() for t in texts]
        fresh = list(dict.fromkeys(w for words in split if words for w in words if w not in self.known))
        if len(self.known) + len(fresh) > CACHE:
            self.forget()
            fresh = list(dict.fromkeys(w for words in split if words for w in words if w not in self.known))
        self._learn(fresh)
        return [b"".join(map(self.known.__getitem__, words)) if words is not None else self._ids(t).tobytes() for t, words in zip(texts, split, strict=True)]

    def forget(self) -> None:
        """Keep the words met first only: a worker outlives its task, and what it holds counts in every stage after."""
        self.known = dict(islice(self.known.items(), KEPT))


@cache
def encoder(path: str | None) -> WordEncoder:
    """One per worker process: tasks that follow in it find its words known."""
    return WordEncoder(path)


@dataclass
class Pool:
    """Waiting pieces by length: stacks, and a bit set of the lengths there are."""

    stacks: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    lengths: int = 0
    tokens: int = 0

    def put(self, doc: int, start: int, length: int) -> None:
        if length:
            self.stacks.setdefault(length, []).append((doc, start))
            self.lengths |= 1 << length
            self.tokens += length

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most ``most`` tokens."""
        fits = self.lengths & ((1 << (most + 1)) - 1)
        if not fits:
            return None
        length = fits.bit_length() - 1
        stack = self.stacks[length]
        doc, start = stack.pop()
        if not stack:
            self.lengths ^= 1 << length
        self.tokens -= length
        return doc, start, length


Sequence_ = list[tuple[int, int, int]]


def fill(pool: Pool, window: int) -> Sequence_:
    """One window of pieces: longest fits first, then one cut; full if the pool has enough."""
    out, gap = [], window
    while gap:
        piece = pool.take(gap)
        if piece is None:
            piece = pool.take(max(TIERS))
            if piece is None:
                break
            doc, start, length = piece
            piece = doc, start, gap
            pool.put(doc, start + gap, length - gap)
        out.append(piece)
        gap -= piece[2]
    return out


def pack(pool: Pool, tiers: Sequence[int] = TIERS, last: bool = True) -> Iterator[tuple[int, Sequence_]]:
    """Windows (length, pieces) of a pool, tier by tier from the longest.

    A tier takes windows while it has pieces of its own, that is, longer than
    the next shorter tier, and the pool can fill a window.
    """
    floors = (*sorted(tiers), 0)
    for tier in sorted(tiers, reverse=True):
        floor = max((t for t in floors if t < tier), default=0)
        floor = 0 if tier == min(tiers) else floor
        while pool.lengths >> (floor + 1) and pool.tokens >= tier:
            yield tier, fill(pool, tier)
    if last:
        size = max(tiers)
        while pool.tokens:
            if size > LEAST_TAIL:
                size //= 2
            if pool.tokens >= size:
                while pool.tokens >= size:
                    yield size, fill(pool, size)
            elif size <= LEAST_TAIL:
                yield max(tiers), fill(pool, max(tiers))


class Packer:
    """Gathers encoded documents and gives rows of packed pieces."""

    def __init__(self, partition: int, tiers: Sequence[int] = TIERS) -> None:
        self.tiers, self.pool, self.docs = tuple(tiers), Pool(), {}
        self.next_doc, self.sequence, self.step, self.room = 0, partition << 40, partition << 40, STEP
        self.rows: list[tuple] = []
        self.ids: list[memoryview] = []
        self.ready: list[tuple[int, Sequence_]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        longest, n = max(self.tiers), len(ids) // 4
        key = self.next_doc
        self.next_doc += 1
        self.docs[key] = [doc_id, ids, n, n]
        whole = n - n % longest
        self.ready += [(longest, [(key, at, longest)]) for at in range(0, whole, longest)]
        self.pool.put(key, whole, n - whole)

    def flush(self, last: bool) -> None:
        """Pack what is there and turn windows, longest first, into rows."""
        windows = sorted([*self.ready, *pack(self.pool, self.tiers, last)], key=lambda x: -x[0])
        self.ready = []
        for window, pieces in windows:
            offset = 0
            if self.room < window:
                self.step, self.room = self.step + 1, STEP
            self.room -= window
            for key, start, length in pieces:
                doc = self.docs[key]
                ids = memoryview(doc[1])[4 * start : 4 * (start + length)]
                self.rows.append((doc[0], start, length, zlib.crc32(ids), doc[2], self.sequence, offset, window, self.step))
                self.ids.append(ids)
                offset += length
                doc[3] -= length
                if not doc[3]:
                    del self.docs[key]
            self.sequence += 1

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, ids, self.rows, self.ids = self.rows, self.ids, [], []
        columns = list(zip(*rows, strict=True)) or [()] * (len(schema) - 1)
        plain = [pa.array(c, pa.int64()) for c in columns]
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        return pa.RecordBatch.from_arrays([*plain, tokens.cast(schema.field("ids").type)], schema=schema)


def pack_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, tiers: Sequence[int] = TIERS) -> DataFrame:
    """One row per piece, with its token ids.  ``tokenizer`` is the vocabulary file's path on the executors."""
    schema = pa.schema([(c.split()[0], pa.list_(pa.int32()) if c.startswith("ids array") else pa.int64()) for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, packer = encoder(tokenizer), Packer(TaskContext.get().partitionId(), tiers)
        gathered, end = 0, np.asarray([END], "<u4").tobytes()

        def add(ids: list[int | None], texts: list[str]) -> int:
            n = 0
            for doc_id, data in zip(ids, words.encode(texts), strict=True):
                packer.add(doc_id, data + end)
                n += len(data) // 4 + 1
            return n

        for batch in batches:
            names, texts, chars = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                names.append(doc_id.as_py())
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars >= CHARS:
                    gathered += add(names, texts)
                    names, texts, chars = [], [], 0
                if gathered >= BLOCK:
                    packer.flush(False)
                    gathered = 0
                    yield packer.batch(schema)
            gathered += add(names, texts)
        packer.flush(True)
        yield packer.batch(schema)
        del packer
        words.forget()
        release()

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, SCHEMA)
