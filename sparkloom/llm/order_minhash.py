"""Near-duplicates by order MinHash.

A text's k-mers are its runs of five words, labelled by occurrence.  Each of
``SKETCHES`` hash orders samples the ``SAMPLE`` smallest k-mers and keeps them in text
order, so that sketches agree if k-mers are shared in the same order.  Texts that
share ``SHARED`` sketches are candidates; a banded alignment of their k-mers verifies that
matches in order make up ``LEAST`` or more of all k-mers of both.

Scale: exact copies (equal word sequences) become one node before
anything else.  Members of a bucket are compared with two leaders, the member in
the largest buckets and the smallest node, not with one another.  Then only members
that are not yet in one class meet, all of them: pair by pair in buckets up to ``SMALL``,
and in larger ones in blocks of a bounded number of rows and k-mers, each two blocks in a group of their
own, so that a hot bucket is spread over as many tasks as it needs.  Within a group only
texts of different classes that may reach the similarity are aligned.  Classes are thus
those of all candidates; what grows with the square of a large bucket in which classes
meet is the comparison of sketches, and its rows times its blocks are moved.
Joins on a bucket or leader are plain equi-joins between written tables, whose hot keys
adaptive execution can split; groups are pre-aggregated.  Every round's tables are written
to the shared folder and deleted in the end.  Texts are never shuffled to find classes; the filter moves
only those that two bit sets cannot decide.

Defined results: a node is a text (a sequence of words), whatever the ids of its rows.  Null texts
and texts without a word are in no class but their own.  A class id is the smallest id of the class.
Rows of one id with different texts each have the class of their own text, so no text is lost;
should both classes have that id as their smallest, they carry one number, and the filter still tells
them apart.  A null id has a null class and takes no part; an empty table gives
an empty result; texts of any length count whole; other columns are ignored or, in
:func:`near_duplicate_filter`, passed through.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._bits import bit_set
from sparkloom.llm._rows import ROW, carry, uncarry
from sparkloom.llm._words import mix, shingles, word_hashes
from sparkloom.operators.components import connected_components
from sparkloom.session import discard, materialize

WORDS = 5
LEAST = 0.8
#: Sketches of a text and k-mers in each.
SKETCHES = 16
SAMPLE = 2
#: Buckets up to this size compare all members that are not in one class yet.
SMALL = 16
#: Rows and k-mers of a block of a larger bucket, about; each two blocks are compared in a group of their own.
BLOCK = 1024
BLOCK_KMERS = 1 << 19
#: Candidates share this many sketches.
SHARED = 2

_ODD = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)


def sketches(kmers: np.ndarray) -> np.ndarray:
    """One hash per order: the smallest k-mers, joined in text order."""
    keys = mix(kmers[None, :] * _ODD[:, None])
    take = min(SAMPLE, len(kmers))
    at = np.argpartition(keys, take - 1, axis=1)[:, :take]
    at.sort(axis=1)
    out = _ODD.copy()
    for k in range(take):
        out = mix(out + kmers[at[:, k]])
    return out.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Share of k-mers matched in order, 0 where it cannot reach ``least``.

    The band: with enough matches, a k-mer lies at most as far from its partner
    as the rest of both texts allows.  K-mers are unique in a text, so the longest
    alignment within the band is the longest increasing run of partners.
    """
    need = least * (len(a) + len(b)) / (1 + least)
    if need > min(len(a), len(b)) + 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, return_indices=True)
    if len(i) < need - 1e-9:
        return 0.0
    band = len(a) + len(b) - 2 * need + 1e-9
    near = np.abs(i - j) <= band
    order = np.argsort(i[near])
    j = j[near][order]
    if len(j) > 1 and (np.diff(j) < 0).any():
        tails: list[int] = []
        for x in j.tolist():
            p = bisect_left(tails, x)
            tails[p : p + 1] = [x]
        n = len(tails)
    else:
        n = len(j)
    share = n / (len(a) + len(b) - n)
    return share if share >= least - 1e-12 else 0.0


def _slim(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, print, text); id and print, a hash of the text's bytes, tell rows apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), _print(text).alias("print"), text.alias("text"))


def _print(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sketch_table(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, print, digest, n, sketch) of every row; digest is null without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, counts, found = [], [], []
            for text in batch.column(2):
                words = word_hashes(text.as_py() or "")
                if len(words):
                    kmers = shingles(words, WORDS)
                    digests.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                    counts.append(len(kmers))
                    found.append(sketches(kmers))
                else:
                    digests.append(None)
                    counts.append(0)
                    found.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["id", "print", "digest", "n", "sketch"],
            )

    return _slim(docs, text_col, id_col).mapInArrow(run, "id long, print long, digest binary, n long, sketch array<long>")


def _sequences(docs: DataFrame, text_col: str, id_col: str, wanted: DataFrame) -> DataFrame:
    """(id, seq): the k-mers of the wanted nodes (id, first), 32 bits each.

    Texts stay where they are: tasks make k-mers only of rows in a bit set, which may pass
    a few too many, and the join with the wanted rows drops those.
    """
    keys = wanted.select("id", F.col("first.id").alias("doc"), F.col("first.print").alias("print"))
    rows = _slim(docs, text_col, id_col).where("id IS NOT NULL")
    rows = bit_set(keys, "doc", "print").mark(rows, "id", "print").where("__maybe").select("id", "print", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(shingles(word_hashes(t.as_py() or ""), WORDS) >> np.uint64(32)).astype("<u4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["doc", "print", "seq"])

    # Rows that repeat with id and text become one.
    made = rows.mapInArrow(run, "doc long, print long, seq binary").groupBy("doc", "print").agg(F.first("seq").alias("seq"))
    return made.join(keys, ["doc", "print"]).select("id", "seq")


def _verified(pairs: DataFrame, seqs: DataFrame, brief: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose alignment reaches ``least``; sketches sift them before k-mers are moved."""
    one, two = (brief.select(F.col("id").alias(e), F.col("sketch").alias(f"{e}_sketch")) for e in ("a", "b"))
    equal = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    pairs = pairs.join(one, "a").join(two, "b").where(equal >= SHARED).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda x: np.frombuffer(x.as_buffer(), "<u4")
        for batch in batches:
            good = [aligned(read(x), read(y), least) > 0 for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = seqs.select(F.col("id").alias("a"), F.col("seq").alias("x"))
    right = seqs.select(F.col("id").alias("b"), F.col("seq").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _pairs(rows: DataFrame, one: str, two: str, least: float) -> DataFrame:
    """Distinct unordered pairs of ids whose sizes allow the similarity."""
    ends = rows.where(F.col(one)["id"] != F.col(two)["id"]).where(F.least(F.col(one)["n"], F.col(two)["n"]) >= least * F.greatest(F.col(one)["n"], F.col(two)["n"]) - 1e-9)
    a, b = F.col(one)["id"], F.col(two)["id"]
    return ends.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def _members(texts: DataFrame) -> DataFrame:
    """(t, key, who, size, mass, rank) for all buckets of two or more; rank orders leaders, best last."""
    rows = texts.select(F.struct("id", "n").alias("who"), F.posexplode("sketch").alias("t", "key"))
    # Written, so that the join is between two exchanges and a hot bucket can be split.
    sizes = materialize(rows.groupBy("t", "key").agg(F.count("*").alias("size"), F.sum("who.n").alias("mass")).where("size > 1"), "sizes")
    rows = materialize(rows.join(sizes, ["t", "key"]), "buckets")
    hubs = rows.groupBy("who").agg(F.sum(F.log2("size")).alias("weight"))
    rank = F.struct(F.round("weight", 6).alias("weight"), (-F.col("who.id")).alias("id"), F.col("who.n").alias("n"))
    out = materialize(rows.join(hubs, "who").select("t", "key", "who", "size", "mass", rank.alias("rank")), "members")
    discard(sizes)
    discard(rows)
    return out


def _leader(rank) -> object:
    return F.struct((-rank["id"]).alias("id"), rank["n"].alias("n"))


def _apart(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Members of buckets in which classes meet."""
    mixed = materialize(rows.groupBy(*keys).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(*keys), "mixed")
    out = materialize(rows.join(mixed, keys), "apart")
    discard(mixed)
    return out


def _within(rows: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Pairs of different classes within small buckets: at most SMALL - 1 a member."""
    two = rows.select(*keys, F.col("who").alias("other"), F.col("label").alias("other_label"))
    return _pairs(rows.select(*keys, "who", "label").join(two, keys).where("label < other_label"), "who", "other", least)


def _neighbours(rows: DataFrame, seqs: DataFrame, brief: DataFrame, least: float) -> DataFrame:
    """Verified links (a, b) between classes within large buckets, all that no links of the same task imply.

    A bucket is cut into blocks of about BLOCK rows and BLOCK_KMERS k-mers by a hash of the id, and each two
    blocks meet in a group of their own.  K-mers travel with the rows, so that only links
    leave a task.  A pair is compared in the first bucket it shares and in no other.
    """
    slim = rows.select(F.col("who.id").alias("id"), "t", "key", "label", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("mass") / BLOCK_KMERS)).cast("int").alias("blocks"))
    ready = materialize(slim.join(brief.select("id", "sketch"), "id").join(seqs, "id"), "ready")
    own = ready.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = own.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met.select("t", "key", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "id", "label", "sketch", "seq")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        t, i, j = (group.column(c)[0].as_py() for c in ("t", "i", "j"))
        own, ids, now = (group.column(c).to_numpy() for c in ("own", "id", "label"))
        now = now.copy()
        marks = np.array(group.column("sketch").to_pylist(), np.int64)
        kmers = [np.frombuffer(x.as_buffer(), "<u4") for x in group.column("seq")]
        size = np.array([len(x) for x in kmers])
        distinct, codes = np.unique(np.concatenate(kmers), return_inverse=True)
        codes, held = np.split(codes, np.cumsum(size)[:-1]), np.zeros(len(distinct), bool)
        found_a, found_b = [], []
        for p in range(1, len(ids)):
            like = (now[:p] != now[p]) & (np.minimum(size[:p], size[p]) >= least * np.maximum(size[:p], size[p]) - 1e-9)
            if i != j:
                like &= own[:p] != own[p]
            some = np.flatnonzero(like)
            same = marks[some] == marks[p]
            some = some[~same[:, :t].any(axis=1) & (same.sum(axis=1) >= SHARED)]
            if not len(some):
                continue
            # Shared k-mers in any order bound those in order: only where they suffice is a pair aligned.
            held[codes[p]] = True
            shared = np.add.reduceat(held[np.concatenate([codes[q] for q in some])], np.cumsum(size[some]) - size[some], dtype=np.int64)
            held[codes[p]] = False
            for q in some[shared >= least * (size[some] + size[p]) / (1 + least) - 1e-9].tolist():
                one, two = now[p], now[q]
                if one != two and aligned(kmers[p], kmers[q], least) > 0:
                    now[now == max(one, two)] = min(one, two)
                    found_a.append(max(ids[p], ids[q]))
                    found_b.append(min(ids[p], ids[q]))
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    out = materialize(dealt.groupBy("t", "key", "i", "j").applyInArrow(run, "a long, b long"), "links")
    discard(ready)
    return out


def _classes(docs: DataFrame, text_col: str, id_col: str, least: float) -> DataFrame:
    """(id, print, best) of every row: best is the smallest (id, print) of its class, null without a word or id."""
    sketched = materialize(sketch_table(docs, text_col, id_col), "sketches")
    copies = sketched.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "print")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # Nodes are numbered once, in a written table: two texts of one id are two nodes.
    texts = materialize(copies.select(F.monotonically_increasing_id().alias("id"), "digest", "first", "n", "sketch"), "texts")
    members = _members(texts)
    wanted = members.select("who.id").distinct()
    brief = materialize(texts.join(wanted, "id", "left_semi").select("id", "first", "sketch"), "brief")
    seqs = materialize(_sequences(docs, text_col, id_col, brief), "sequences")
    leaders = materialize(members.groupBy("t", "key").agg(F.max("rank").alias("hub"), F.min("who").alias("low")).select("t", "key", F.explode(F.array(_leader(F.col("hub")), F.col("low"))).alias("lead")), "leaders")
    pairs = materialize(_pairs(members.join(leaders, ["t", "key"]), "who", "lead", least), "pairs")
    links = materialize(_verified(pairs, seqs, brief, least), "links")
    classes = connected_components(links, "a", "b")
    # What the leaders left apart: buckets in which classes still meet.
    label = classes.select(F.col("id").alias("cid"), "label")
    placed = members.join(label, F.col("who.id") == F.col("cid"), "left").withColumn("label", F.coalesce("label", "who.id")).drop("cid", "rank")
    placed = materialize(placed, "placed")
    apart = _apart(placed, ["t", "key"])
    near = _within(apart.where(F.col("size") <= SMALL), ["t", "key"], least)
    fresh = materialize(near.join(pairs, ["a", "b"], "left_anti"), "pairs")
    across = _neighbours(apart.where(F.col("size") > SMALL), seqs, brief, least)
    more = materialize(_verified(fresh, seqs, brief, least).unionAll(across), "links")
    if not more.isEmpty():
        classes = connected_components(links.unionAll(more), "a", "b")
    label = classes.select(F.col("id").alias("cid"), "label")
    linked = materialize(label.join(texts.select("id", "first"), F.col("cid") == F.col("id")).select("cid", "label", "first"), "linked")
    best = linked.groupBy("label").agg(F.min("first").alias("best"))
    best = linked.select("cid", "label").join(best, "label").select("cid", "best")
    named = texts.select("digest", "id", "first").join(best, F.col("id") == F.col("cid"), "left").select("digest", F.coalesce("best", "first").alias("best"))
    named = materialize(named, "named")
    out = materialize(sketched.select("id", "print", "digest").join(named, "digest", "left").select("id", "print", F.when(F.col("id").isNotNull(), F.col("best")).alias("best")), "classes")
    for used in (sketched, texts, members, brief, seqs, leaders, pairs, links, placed, apart, fresh, across, more, linked, named):
        discard(used)
    return out


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = LEAST) -> DataFrame:
    """One row per input row: id and class id, the smallest id of its class."""
    return _classes(docs, text_col, id_col, least).select(F.col("id").alias(id_col), F.coalesce("best.id", "id").alias("class_id"))


def near_duplicate_filter(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = LEAST) -> DataFrame:
    """One row of each class, with all columns; rows without an id all stay.

    Two bit sets decide on nearly all rows where they are: what misses the first stays; what hits it and
    misses the second goes.  Only the few that hit both are shuffled, to be held against the exact keys.
    """
    found = _classes(docs, text_col, id_col, least)
    own = F.coalesce("best", F.struct("id", "print")) == F.struct("id", "print")
    keys = found.where("id IS NOT NULL").withColumn("own", own).groupBy("id", "print").agg(F.bool_and("own").alias("own"), F.count("*").alias("n"))
    keys = materialize(keys, "keys")
    first = bit_set(keys.where("NOT own OR n > 1"), "id", "print")
    doubtful = materialize(first.mark(keys.where("own"), "id", "print").where("__maybe").select("id", "print"), "doubtful")
    second = bit_set(doubtful, "id", "print")
    rows = carry(docs, __id=F.col(id_col).cast("long"), __print=_print(F.col(text_col).cast("string")))
    rows = first.mark(rows, "__id", "__print").withColumn("__maybe", F.col("__maybe") & F.col("__id").isNotNull())
    plain = uncarry(rows.where("NOT __maybe"))
    rest = second.mark(rows.where("__maybe").drop("__maybe"), "__id", "__print").where("__maybe")
    exact = rest.join(doubtful, (F.col("__id") == F.col("id")) & (F.col("__print") == F.col("print")), "left_semi")
    discard(found)
    discard(keys)
    return plain.unionAll(uncarry(exact.groupBy("__id", "__print").agg(F.first(ROW).alias(ROW))))
