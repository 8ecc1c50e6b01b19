"""Long substrings that repeat across a corpus, found by recompression.

The words of each text are named by digests, and rounds of recompression shorten the sequence: maximal
runs of one name get a common name, then pairs (a, b) where a round's bit of a is 0 and that of b is 1. A
name is a digest of what it stands for, so it is the same in every task of the cluster, and equal substrings
get equal symbols inside. At its ends a substring's symbols depend on what stands around it; so each symbol
carries the range of words on which its being there depends. A symbol whose range lies in a window is a
symbol of every window with the same words, at the same place.

A window of WINDOW words is filed under one such symbol, that of the lowest digest in the highest level that has
any (level 0, the words, always has). Equal windows are filed under the same symbol: the symbols that several windows share
reveal the repeats, and digests of the windows' words verify them (64 bits of the symbol, 48 of the window).
A symbol's consecutive windows travel together, packed by the hash of the symbol, and once for each
batch of texts: windows that repeat inside a batch are settled there, and the first of them stands for all.
So what many documents share reaches a task once for each batch.

Edge cases: null, empty and blank texts have no words and come back with n_words 0; texts shorter than a window lose
nothing; repeated rows are texts that repeat, whatever their ids; a null id is an id; other columns pass by.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import AtomicType, LongType, StringType, StructField, StructType

from tidemark.llm.common import durable, hidden, sliced

#: Words of a window.
WINDOW = 35
#: Rounds of pairs; a run round precedes those named. A symbol grows by a third in each.
ROUNDS, RUN_ROUNDS = 5, (0,)
#: Bytes of text that a task names at once, and of packed windows that one compares at once.
BATCH_BYTES, BUCKET_BYTES = 3 << 20, 8 << 20
#: Packed bytes for each byte of text, about.
PACKED = 1.3

_find = re.compile(rb"[^\x20\x09-\x0D]+").findall
_B = np.uint64(0x9E3779B97F4A7C15)
_ROWS = "bucket int, packed binary, doc binary, start int, n int"


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_names(cache: dict[bytes, int], ws: list[bytes]) -> np.ndarray:
    out = list(map(cache.get, ws))
    if None in out:
        for w in set(ws).difference(cache):
            cache[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        out = list(map(cache.__getitem__, ws))
    return np.array(out, dtype=np.uint64)


def _runs(level: tuple, edge: np.ndarray) -> tuple:
    """Maximal runs of one name become one symbol; depends on both neighbours, which end the run."""
    name, doc, lo, hi, begin, end = level
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(name)) - 1
    k = (last - first + 1).astype(np.uint64)
    named = np.where(k > 1, mix(name[first] * np.uint64(5) + k), name[first])
    left = np.where(begin[first], edge[doc[first]] - 1, lo[np.maximum(first - 1, 0)])
    right = np.where(end[last], edge[doc[last] + 1] + 1, hi[np.minimum(last + 1, len(name) - 1)])
    return named, doc[first], left, right, begin[first], end[last]


def _pairs(level: tuple, edge: np.ndarray, r: int) -> tuple:
    """Pairs of a name with bit r 0 and one with 1 become one symbol. A symbol that stays depends on the
    neighbour that it might have been paired with."""
    name, doc, lo, hi, begin, end = level
    bit = (name >> np.uint64(r)) & np.uint64(1) == 1
    pair = np.zeros(len(name), bool)
    pair[:-1] = ~bit[:-1] & bit[1:] & ~end[:-1]
    second = np.zeros(len(name), bool)
    second[1:] = pair[:-1]
    at = np.flatnonzero(~second)
    after, before = np.minimum(at + 1, len(name) - 1), np.maximum(at - 1, 0)
    p, b = pair[at], bit[at]
    named = np.where(p, mix(name[at] * np.uint64(3) + name[after]), name[at])
    left = np.where(b, np.where(begin[at], edge[doc[at]] - 1, lo[before]), lo[at])
    right = np.where(b, hi[at], np.where(end[at], edge[doc[at] + 1] + 1, hi[after]))
    return named, doc[at], left, right, begin[at], np.where(p, end[after], end[at])


def levels(names: np.ndarray, edge: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, first word, end) of each level's symbols, with the ranges of words that they depend on; from the words up.

    names: of the words of several texts, one after the other; edge: where each text begins, and the end."""
    n = len(names)
    doc = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    at = np.arange(n)
    level = (names, doc, at, at + 1, at == edge[doc], at + 1 == edge[doc + 1])
    out = [level]
    for r in range(ROUNDS):
        if r in RUN_ROUNDS:
            level = _runs(level, edge)
        level = _pairs(level, edge, r)
        out.append(level)
    return [(x[0], x[2], x[3]) for x in out]


def window_digests(names: np.ndarray, size: int) -> np.ndarray:
    """48 bits of a digest of the ``size`` names from each position on, as far as there are so many."""
    m = len(names) - size + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    # Polynomials of lengths 1, 2, 4, ...; those of size's binary digits are put together.
    whole, length, part, width, power = None, 0, names, 1, _B
    rest = size
    while True:
        if rest & 1:
            piece = part[length:]
            whole = piece[:m].copy() if whole is None else whole[:m] * power + piece[:m]
            length += width
        rest >>= 1
        if not rest:
            return mix(whole) >> np.uint64(16)
        part = part[:-width] * power + part[width:]
        width, power = 2 * width, np.uint64(int(power) ** 2 % 2**64)


def _lowest(named: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The symbol of the lowest digest in each range [first, last]; the leftmost of several."""
    rank = mix(named)
    at, width = [np.arange(len(named))], 1
    while width <= (last - first).max(initial=0):
        a, b = at[-1][:-width], at[-1][width:]
        at.append(np.where(rank[b] < rank[a], b, a))
        width *= 2
    out, k = first.copy(), np.log2(last - first + 1).astype(np.int64)
    for i, best in enumerate(at):
        q = np.flatnonzero(k == i)
        a, b = best[first[q]], best[last[q] - 2**i + 1]
        out[q] = np.where(rank[b] < rank[a], b, a)
    return out


def anchors(names: np.ndarray, edge: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: its first word, the name of the symbol that it is filed under, and the symbol's place."""
    n = len(names)
    doc = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    p = np.flatnonzero(np.arange(n) + size <= edge[doc + 1])
    under, place, left = np.zeros(n, np.uint64), np.zeros(n, np.int64), p
    for i, (named, lo, hi) in reversed(list(enumerate(levels(names, edge)))):
        # Neither lo nor hi sinks along the symbols, so those in a window are a range, found by counting.
        first = np.cumsum(np.bincount(lo + 1, minlength=n + 2))[left]
        last = np.cumsum(np.bincount(hi, minlength=n + 2))[left + size] - 1
        safe = first <= last
        at, best = left[safe], _lowest(named, first[safe], last[safe])
        under[at], place[at] = named[best], best * 64 + i
        left = left[~safe]
        if not len(left):
            break
    return p, under[p], place[p]


def _packed(p: np.ndarray, under: np.ndarray, place: np.ndarray, digest: np.ndarray, many: np.ndarray, owner: np.ndarray, edge: np.ndarray, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed windows): consecutive windows of one symbol as one record."""
    cut = np.ones(len(p), bool)
    cut[1:] = (np.diff(p) != 1) | (np.diff(place) != 0)
    first = np.flatnonzero(cut)
    count = np.diff(np.append(first, len(p)))
    which = (mix(under[first] + np.uint64(77)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    ends = np.searchsorted(which[order], np.arange(buckets + 1))
    # Windows in the order of their records.
    shift = np.repeat(first[order] - np.append(0, np.cumsum(count[order])[:-1]), count[order])
    windows = np.arange(len(p)) + shift
    wend = np.append(0, np.cumsum(count[order]))[ends]
    six = digest[windows].view(np.uint8).reshape(-1, 8)[:, :6]
    for b in np.flatnonzero(np.diff(ends)):
        rec, win = first[order[ends[b] : ends[b + 1]]], slice(wend[b], wend[b + 1])
        d = owner[rec]
        yield int(b), b"".join((
            np.array([len(rec), wend[b + 1] - wend[b]], np.uint32).tobytes(), under[rec].tobytes(), keys[d].tobytes(), (p[rec] - edge[d]).astype(np.uint32).tobytes(),
            count[order[ends[b] : ends[b + 1]]].astype(np.uint8).tobytes(), np.packbits(many[windows[win]]).tobytes(), six[win].tobytes(),
        ))


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    m, w = np.frombuffer(blob, np.uint32, 2)
    at, out = 8, []
    for kind, n in ((np.uint64, m), ("S12", m), (np.uint32, m), (np.uint8, m), (np.uint8, (w + 7) // 8), ("V6", w)):
        out.append(np.frombuffer(blob, kind, int(n), at))
        at += out[-1].nbytes
    digest = np.zeros((int(w), 8), np.uint8)
    digest[:, :6] = out[5].view(np.uint8).reshape(-1, 6)
    return out[0], out[1], out[2].astype(np.int64), out[3].astype(np.int64), np.unpackbits(out[4], count=int(w)).astype(bool), digest.view(np.uint64)[:, 0]


def _same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal windows together, and where in it a new one begins."""
    c = mix(a * np.uint64(7) + b)
    order = np.argsort(c, kind="stable")
    new = np.ones(len(c), bool)
    new[1:] = (c[order[1:]] != c[order[:-1]]) | (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    return order, new


def _stretches(flagged: np.ndarray, p: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices where runs of flagged consecutive windows of one owner begin, and their lengths."""
    i = np.flatnonzero(flagged)
    if not len(i):
        return i, i
    cut = np.ones(len(i), bool)
    cut[1:] = (np.diff(p[i]) != 1) | (owner[i[1:]] != owner[i[:-1]])
    first = np.flatnonzero(cut)
    return i[first], np.diff(np.append(first, len(i)))


def _filed(rows: DataFrame, size: int, buckets: int) -> DataFrame:
    """(bucket, packed) of the windows of rows (key, text), and (doc, start, n): stretches of windows that repeat inside a batch."""
    schema = to_arrow_schema(StructType.fromDDL(_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in sliced(batches, "text", BATCH_BYTES):
            keys = np.array(b.column(0).to_pylist(), "S12")
            found = [_find(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            edge = np.append(0, np.cumsum([len(f) for f in found]))
            if len(cache) > 300_000:
                cache.clear()
            names = np.concatenate([word_names(cache, f) for f in found if f] or [np.empty(0, np.uint64)])
            del found
            p, under, place = anchors(names, edge, size) if len(names) >= size else (np.empty(0, np.int64),) * 3
            if not len(p):
                continue
            owner = np.repeat(np.arange(len(edge) - 1), np.diff(edge))[p]
            digest = window_digests(names, size)[p]
            order, new = _same(under, digest)
            group = np.cumsum(new) - 1
            many, keep = np.empty(len(p), bool), np.empty(len(p), bool)
            many[order], keep[order] = (np.bincount(group) > 1)[group], new
            first, n = _stretches(many, p, owner)
            d = owner[first]
            k = np.flatnonzero(keep)
            packed = list(_packed(p[k], under[k], place[k], digest[k], many[k], owner[k], edge, keys, buckets))
            spread = np.arange(len(first)) % buckets
            none, size_of = [None] * len(first), [None] * len(packed)
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in packed] + spread.tolist(), pa.int32()), pa.array([x[1] for x in packed] + none, pa.binary()),
                pa.array(size_of + [keys[i].ljust(12, b"\0") for i in d], pa.binary()),
                pa.array(size_of + (p[first] - edge[d]).tolist(), pa.int32()), pa.array(size_of + n.tolist(), pa.int32()),
            ], schema=schema)

    return rows.mapInArrow(run, _ROWS)


def _shared(blobs: list[bytes]) -> tuple[list[bytes], list[int], list[int]]:
    """Stretches (doc, start, n) of windows that occur in several of the packed records, or in several places of a batch."""
    parts = [_unpacked(x) for x in blobs]
    under, doc, start, count, many, digest = (np.concatenate(x) for x in zip(*parts, strict=True))
    rec = np.repeat(np.arange(len(under)), count)
    order, new = _same(under[rec], digest)
    group = np.cumsum(new) - 1
    hit = np.empty(len(rec), bool)
    # Windows that repeat inside their batch are settled for that batch, and reveal others.
    hit[order] = ((np.bincount(group) > 1) | (np.bincount(group, many[order]) > 0))[group]
    p = start[rec] + np.arange(len(rec)) - np.repeat(np.append(0, np.cumsum(count)[:-1]), count)
    first, n = _stretches(hit, p, rec)
    return [x.ljust(12, b"\0") for x in doc[rec[first]].tolist()], p[first].tolist(), n.tolist()


def repeated_windows(docs: DataFrame, key: Column, text: str = "text", size: int = WINDOW) -> DataFrame:
    """(doc, start, n): stretches of consecutive windows of ``size`` words that also start anywhere else, by the
    documents' keys (12 bytes). A stretch may come in pieces that touch or overlap."""
    rows = docs.select(key.alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    volume = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = max(1, math.ceil(volume * PACKED / BUCKET_BYTES))
    out = "doc binary, start int, n int"
    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(_shared(held), schema, strict=True)], schema=schema)

        for b in batches:
            settled = b.filter(b.column(2).is_valid())
            yield pa.RecordBatch.from_arrays([settled.column(i) for i in (2, 3, 4)], schema=schema)
            b = b.filter(b.column(1).is_valid())
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != at and held:
                    yield done()
                    held = []
                at = bucket
                held.append(blob)
        if held:
            yield done()

    return _filed(rows, size, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, out)


def remove_repeats(docs: DataFrame, text: str = "text", size: int = WINDOW) -> DataFrame:
    """docs without text, with n_words, n_removed and kept_text: the words that no repeated window of ``size`` words
    covers, joined by one space. Windows are judged on the texts as they came."""
    if size < 1:
        raise ValueError("a window has one word at least")
    plain, back = hidden(docs, text)
    inner = [c for c in plain.columns if c != text]
    # The result depends on the text alone; the other columns spread the copies of a text.
    spread = [F.col(f.name) for f in plain.schema.fields if f.name != text and isinstance(f.dataType, AtomicType)]
    named = plain.withColumn("__tm_key", F.unhex(F.substring(F.sha2(F.concat_ws(":", F.xxhash64(F.lit(0), *spread).cast("string"), F.coalesce(text, F.lit(""))), 256), 1, 24)))
    found = durable(repeated_windows(named, F.col("__tm_key"), text, size), "repeats")
    each = found.groupBy("doc").agg(F.collect_set(F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))).alias("__tm_at"))
    joined = named.join(each, named["__tm_key"] == each["doc"], "left").select(*inner, F.coalesce(F.col(text), F.lit("")).alias("__tm_text"), "__tm_at")
    fields = {f.name: f for f in plain.schema.fields}
    schema = StructType([*(fields[c] for c in inner), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    k = len(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "__tm_text"):
            total, removed, kept = [], [], []
            for t, at in zip(b.column(k).cast(pa.binary()).to_pylist(), b.column(k + 1), strict=True):
                ws = _find(t)
                total.append(len(ws))
                if at.is_valid:
                    x = at.values.to_numpy()
                    edge = np.zeros(len(ws) + 1, np.int64)
                    start = x >> 32
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + (x & 0xFFFFFFFF) + size - 1, -1)
                    ws = [ws[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                removed.append(total[-1] - len(ws))
                kept.append(b" ".join(ws))
            arrays = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k)), *arrays], names=schema.names)

    names = dict(zip(plain.columns, docs.columns, strict=True))
    made = {"n_words", "n_removed", "kept_text"}
    return joined.mapInArrow(run, schema).select(*[F.col(c).alias(names[c]) for c in inner if names[c] not in made], *made)


def digests(docs: DataFrame) -> DataFrame:
    """remove_repeats with kept_sha256 in place of the kept text."""
    return remove_repeats(docs).withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")
