"""Language-model scoring with a hashed maximum-entropy model.

The model factors a token's probability by classes, in three levels of FAN choices:
P(class | history) * P(subclass | class, history) * P(leaf | subclass, history) * P(token | leaf).
Each of the first three factors is a softmax over hashed features of the history: the previous
token, the token before that (a skip), and the pair of both. Every word of the vocabulary has a leaf: the
most frequent words, TOP - 1 at most, have one each; all others, unseen ones too, share leaves by a hash, within which
a word's probability is its smoothed relative frequency. Logits start from the log frequencies of
the classes, so an untrained model is the unigram model.

Training is synchronous: each step sums a gradient over training documents and then updates all
weights, so that the model doesn't depend on how rows are partitioned. An entry's gradient is how
often it was observed less how often the model expects it; the update is a logarithmic step,
log((observed + prior) / (expected + prior)), damped since features overlap. The first step is over all documents; what
the untrained model expects there follows from the unigram counts. SLICES further steps each run the model over another
slice of the documents (by a hash of the text), all of them in one epoch, at falling rates and under a heavier prior.
Rows of weights grow with the vocabulary up to MOST_ROWS.

Counts are exact and cover all training documents. Gradients are added up in a tree of fixed fan-in.
All that comes to the driver is bounded by parameters: the frequent words (HEAVY), the masses of leaves and
the weights (38 MB at most), which are broadcast. Rare words are looked up by a join on the word.

Edge cases: null and empty texts are one end token; ids of any type pass by, null ids count as empty ones in the split
(held_out is then false); an empty training side gives N = 0 and a model that knows no token; repeated rows are
scored one by one; ties in frequency go to the smaller word; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, map_texts, sliced

FOLDS, HELD = 5, 1
#: The end token: no word can hold white space.
END = "\n"
#: Choices at a level; LEVELS levels make FAN ** LEVELS leaves, half of them for single words.
FAN, LEVELS = 16, 3
LEAVES = FAN**LEVELS
TOP = LEAVES // 2
#: Words whose counts are broadcast; others are joined.
HEAVY = 40_000
FEATURES = 3
#: Rows of weights of the first level, for each word of the vocabulary and at most; deeper levels have DEEP times as many.
WORDS_A_ROW, LEAST_ROWS, MOST_ROWS, DEEP = 8, 1 << 12, 1 << 16, 4
#: Rows of weights that are summed together.
BLOCK = 1024
#: Partial sums that a task adds up at most, and pieces in which the sums come to the driver.
FAN_IN, PIECES = 32, 16
CHUNK = 8192
#: Bytes of text whose tokens a worker holds at once, in the model and where words are counted.
SLICE, COUNTED = 1 << 19, 1 << 22
#: Longer words' hashes are taken one by one.
VERY_LONG = 64
#: Tokens of a task of a step, at least, where partitions are small.
TASK_TOKENS = 1 << 20
#: Observed entries of a level that are counted together.
SEEN = 1 << 20
SLICES = 3
STEPS = 1 + SLICES
#: Shares of the full logarithmic step that are taken, at the first step and then in turn; weights of the unigram
#: expectation, in tokens, at the first step and later. Rates fall further with each epoch.
RATES, PRIORS = (0.4, 0.5, 0.45, 0.4), (30.0, 60.0)


def is_held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == HELD


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space, with A-Z in lower case, and an end after each text: the distinct ones, each token's
    place among them, and how many tokens each text has."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, sizes = found.flatten(), pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.not_equal(flat, "")
    # White space at a text's ends leaves empty strings.
    empty = np.flatnonzero(~some.to_numpy(zero_copy_only=False))
    sizes += 1 - np.bincount(np.searchsorted(np.cumsum(sizes), empty, side="right"), minlength=len(sizes))
    words = flat.filter(some).dictionary_encode()
    distinct = words.dictionary
    at = np.full(int(sizes.sum()), len(distinct), np.int64)
    inside = np.ones(len(at), bool)
    inside[np.cumsum(sizes) - 1] = False
    at[inside] = words.indices.to_numpy(zero_copy_only=False)
    return pa.concat_arrays([distinct, pa.array([END], distinct.type)]), at, sizes


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc32s(words: pa.Array) -> np.ndarray:
    """CRC-32 of each word's UTF-8 bytes: byte by byte over all words that are as long; very long words one by one."""
    words = words.cast(pa.large_string())
    offsets, data = (np.frombuffer(b if b is not None else b"", t) for b, t in zip(words.buffers()[1:], (np.int64, np.uint8), strict=True))
    offsets = offsets[words.offset : words.offset + len(words) + 1]
    start, size = offsets[:-1], np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    longest_first, crc = size[order], np.full(len(size), 0xFFFFFFFF, np.uint32)
    for j in range(int(min(VERY_LONG, longest_first[0])) if len(size) else 0):
        n = np.searchsorted(-longest_first, -j)
        crc[:n] = CRC[(crc[:n] ^ data[start[order[:n]] + j]) & 0xFF] ^ crc[:n] >> 8
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in order[: np.searchsorted(-longest_first, -VERY_LONG)]:
        out[i] = zlib.crc32(data[start[i] : offsets[i + 1]].tobytes())
    return out


def _hashed_leaf(crc: int) -> int:
    """The leaf of words that share: any class and subclass, the upper half of the choices there."""
    return crc % (LEAVES // FAN) * FAN + FAN // 2 + crc // (LEAVES // FAN) % (FAN // 2)


def _top_leaf(rank: int) -> int:
    """The leaf of a frequent word: ranks are dealt to classes, then subclasses, in turn."""
    return rank % FAN * FAN * FAN + rank // FAN % FAN * FAN + rank // (FAN * FAN)


@dataclass
class Words:
    """What every worker knows: frequent words with counts, the totals, and the mass of each shared leaf."""

    words: list[str]
    counts: np.ndarray
    total: int
    distinct: int
    shared: np.ndarray

    def __post_init__(self):
        self.base_log = np.log10(self.total + 0.5 * (self.distinct + 1))
        at = np.arange(LEAVES)
        self.mass = np.where(at % FAN >= FAN // 2, self.shared + 0.5, 1e-30)
        for i, c in enumerate(self.counts[: TOP - 1]):
            self.mass[_top_leaf(i)] = c + 0.5
        nodes = [self.mass]
        for _ in range(LEVELS):
            nodes.insert(0, nodes[0].reshape(-1, FAN).sum(axis=1))
        #: Of each level: log share of each choice, by node.
        self.bias = [np.log(n.reshape(-1, FAN) / up[:, None]).astype(np.float32) for up, n in zip(nodes, nodes[1:], strict=False)]
        rows = 1 << int(np.clip(np.ceil(np.log2(max(1, self.distinct) / WORDS_A_ROW)), np.log2(LEAST_ROWS), np.log2(MOST_ROWS)))
        self.rows = [rows, *[rows * DEEP] * (LEVELS - 1)]
        self.heavy = pa.array(self.words, pa.string())

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Of each word: place among the heavy words (HEAVY if none), leaf, 32-bit hash, packed."""
        place = pc.fill_null(pc.index_in(words, value_set=self.heavy.cast(words.type)), HEAVY).to_numpy(zero_copy_only=False).astype(np.uint64)
        crc = crc32s(words).astype(np.uint64)
        return place << 48 | np.where(place < TOP - 1, _top_leaf(place), _hashed_leaf(crc)) << 32 | crc

    def __reduce__(self):
        return Words, (self.words, self.counts, self.total, self.distinct, self.shared)


@dataclass
class Tokens:
    """Tokens of several texts: packed parts, where texts begin, hashed features of each history, and which word each is."""

    words: pa.Array
    place: np.ndarray
    leaf: np.ndarray
    starts: np.ndarray
    features: np.ndarray
    at: np.ndarray | None = None

    @classmethod
    def of(cls, known: Words, texts: pa.Array | list[str]) -> Tokens:
        words, at, sizes = tokens(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        packed = known.numbers(words)[at]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        crc = (packed & np.uint64(0xFFFFFFFF)) + np.uint64(2)
        one, two = np.roll(crc, 1), np.roll(crc, 2)
        one[starts] = two[starts] = two[starts[sizes > 1] + 1] = 1
        pair = one * np.uint64(0x9E3779B97F4A7C15) + two * np.uint64(0x165667B19E3779F9)
        features = np.stack([_mix(one * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), _mix(two * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(2)), _mix(pair + np.uint64(3))], axis=1)
        return cls(words, (packed >> np.uint64(48)).astype(np.int64), (packed >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64), starts, features, at)

    def repeats(self, own: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Of each text: its distinct words among the tokens of a mask, and how often each occurs."""
        text = np.repeat(np.arange(len(self.starts)), np.diff(self.starts, append=len(self.at)))
        key, times = np.unique(text[own] * len(self.words) + self.at[own], return_counts=True)
        ends = pa.array(np.searchsorted(key, np.arange(len(self.starts) + 1) * len(self.words)), pa.int32())
        words = self.words.take(pa.array(key % len(self.words))).cast(pa.string())
        return pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))

    def levels(self, known: Words, own: slice = slice(None)) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each level: node and choice of each token, and its rows of weights. Each node has rows of its own."""
        for level, rows in enumerate(known.rows):
            node = self.leaf[own] // FAN ** (LEVELS - level)
            each = rows // FAN**level
            hashed = (self.features[own] >> np.uint64(16 + 16 * level)).astype(np.int64) & (each - 1)
            yield node, self.leaf[own] // FAN ** (LEVELS - 1 - level) % FAN, hashed + node[:, None] * each


class Model:
    """Weights of each level, as rows of hashed features."""

    def __init__(self, known: Words, weights: list[np.ndarray] | None = None):
        self.known = known
        self.weights = weights or [np.zeros((n, FAN), np.float32) for n in known.rows]

    def chunks(self, toks: Tokens) -> Iterator[tuple[slice, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Token slice, level, choices, rows, logits of all choices. Logits stay far from overflow: the
        steps' logarithms bound the weights."""
        room = np.empty((2, CHUNK, FAN), np.float32)
        for i in range(0, len(toks.leaf), CHUNK):
            own = slice(i, i + CHUNK)
            for level, (node, choice, rows) in enumerate(toks.levels(self.known, own)):
                z, w = room[0, : len(node)], room[1, : len(node)]
                np.take(self.known.bias[level], node, axis=0, out=z, mode="clip")
                for j in range(FEATURES):
                    z += np.take(self.weights[level], rows[:, j], axis=0, out=w, mode="clip")
                yield own, level, choice, rows, z

    def log10(self, toks: Tokens) -> np.ndarray:
        """Log probability of each token's leaf."""
        out = np.zeros(len(toks.leaf))
        for own, _, choice, _, z in self.chunks(toks):
            chosen = z[np.arange(len(z)), choice]
            out[own] += chosen - np.log(np.exp(z, out=z).sum(axis=1))
        return out / np.log(10)


def observed(known: Words, toks: Tokens) -> Iterator[np.ndarray]:
    """Of each level: flat entries (row, choice) that the tokens add one to."""
    for _, choice, rows in toks.levels(known):
        yield (rows * FAN + choice[:, None]).ravel()


def _packed(v: np.ndarray) -> bytes:
    """32-bit floats hold counts exactly up to 2 ** 24, and sums of chances need no more digits."""
    return v.astype(np.float32 if v.max() < 1 << 24 else np.float64).tobytes()


def _floats(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.float64 if len(b) == 8 * BLOCK * FAN else np.float32)


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Adds up the partial sums of blocks; parts are those of the next level of the tree."""
    out = []
    for (level, block), g in pdf.sort_values(["level", "block", "part"]).groupby(["level", "block"]):
        whole = np.zeros(BLOCK * FAN)
        for b in g["v"]:
            whole += _floats(b)
        out.append((level, block, int(g["part"].iloc[0]) // FAN_IN, _packed(whole)))
    return pd.DataFrame(out, columns=["level", "block", "part", "v"])


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, c): exact counts over all texts, added up in batches and in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "t", COUNTED):
            found, at, _ = tokens(b.column(0))
            yield pa.RecordBatch.from_arrays([found.cast(pa.string()), pa.array(np.bincount(at, minlength=len(found)), pa.int64())], names=["word", "c"])

    return texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def gradient_sums(texts: DataFrame, text_col: str, known: Words, weights: list[np.ndarray] | None) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
    """Over all texts, of each entry: how often it is observed, and what the model with these weights expects."""
    sent = texts.sparkSession.sparkContext.broadcast((known, weights))
    schema = "level int, block int, part int, v binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, weights = sent.value
        model, part = weights and Model(known, weights), TaskContext.get().partitionId()
        counts = [np.zeros(n * FAN, np.int32) for n in known.rows]
        # Choice by choice: bincount adds up one choice of all rows in a sweep of memory.
        means = [np.zeros((FAN, n)) for n in known.rows] if model else []
        waiting: list[list[np.ndarray]] = [[] for _ in known.rows]

        def count(least: int) -> None:
            for level, seen in enumerate(waiting):
                if sum(map(len, seen)) >= least:
                    counts[level] += np.bincount(np.concatenate(seen), minlength=len(counts[level])).astype(np.int32)
                    seen.clear()

        for b in sliced(batches, "t", SLICE):
            toks = Tokens.of(known, b.column(0))
            for seen, at in zip(waiting, observed(known, toks), strict=True):
                seen.append(at.astype(np.uint32))
            count(SEEN)
            if model:
                chances = [np.empty((FAN, len(toks.leaf)), np.float32) for _ in known.rows]
                for own, level, _, _, z in model.chunks(toks):
                    p = np.exp(z, out=z)
                    chances[level][:, own] = (p / p.sum(axis=1, keepdims=True)).T
                for p, total, (_, _, rows) in zip(chances, means, toks.levels(known), strict=True):
                    at = rows.ravel(order="F")
                    for choice, sums in zip(p, total, strict=True):
                        sums += np.bincount(at, np.tile(choice, FEATURES), len(sums))
                del chances
        count(1)
        for level, v in enumerate([*counts, *means]):
            v = (v if level < LEVELS else v.T).reshape(-1, BLOCK * FAN)
            kept = np.flatnonzero(v.any(axis=1))
            for i in range(0, len(kept), 64):
                own = kept[i : i + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), level, np.int32)), pa.array(own.astype(np.int32)), pa.array(np.full(len(own), part, np.int32)), pa.array([_packed(x) for x in v[own]], pa.binary())],
                    names=["level", "block", "part", "v"],
                )

    parts = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(run, schema)
    while True:
        parts = durable(parts.groupBy(F.col("level"), F.col("block"), F.expr(f"part div {FAN_IN}")).applyInPandas(_summed, schema), "sums")
        if not parts.agg(F.max("part")).first()[0]:
            break
    sums = [np.zeros((n, FAN), np.float32) for n in known.rows * (2 if weights else 1)]
    # In small pieces, of which the driver holds one at a time.
    for r in parts.repartition(PIECES).toLocalIterator():
        sums[r["level"]][r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = _floats(r["v"]).reshape(BLOCK, FAN)
    # The sums are written: what was sent isn't needed again.
    sent.destroy()
    return sums[:LEVELS], sums[LEVELS:] or None


def train(texts: DataFrame, text_col: str, known: Words, steps: int = STEPS) -> list[np.ndarray]:
    """Weights of each level after so many synchronous steps: one over all texts, then one for each slice in turn."""
    weights = [np.zeros((n, FAN), np.float32) for n in known.rows]
    own = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(SLICES))
    # Each task returns sums of one size, so small partitions are put together.
    tasks = max(1, min(texts.rdd.getNumPartitions(), known.total // TASK_TOKENS)) if steps else 1
    for step in range(steps):
        epoch, place = divmod(step - 1, SLICES) if step else (0, -1)
        # A slice has as many fewer tasks as documents.
        part = texts.where(own == place).coalesce(max(1, tasks // SLICES)) if step else texts.coalesce(tasks)
        seen, expected = gradient_sums(part, text_col, known, weights if step else None)
        rate, prior = RATES[place + 1] / (1 + epoch), PRIORS[step > 0]
        # Level by level and node by node, in place: the driver holds little besides the sums.
        for level, (w, o, bias) in enumerate(zip(weights, seen, known.bias, strict=True)):
            each = len(w) // len(bias)
            for node, p in enumerate(np.exp(bias.astype(np.float64))):
                at = slice(node * each, (node + 1) * each)
                here = o[at].astype(np.float64)
                e = p * here.sum(axis=1, keepdims=True) if expected is None else expected[level][at]
                w[at] += rate * np.log((here + prior * p + 1e-12) / (e + prior * p + 1e-12))
        del seen, expected
    return weights


def vocabulary(counts: DataFrame) -> Words:
    """What workers need to know of all words' counts."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("c"), "word").limit(HEAVY).toPandas()
    words, c = top["word"].tolist(), top["c"].to_numpy(np.int64)
    crc, nodes = F.crc32("word"), LEAVES // FAN
    leaf = crc % nodes * FAN + FAN // 2 + F.floor(crc / nodes) % (FAN // 2)
    shared = np.zeros(LEAVES)
    for r in counts.groupBy(leaf.cast("int").alias("leaf")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        shared[r["leaf"]] = r["c"] + 0.5 * r["n"]
    for w, k in zip(words[: TOP - 1], c, strict=False):
        shared[_hashed_leaf(zlib.crc32(w.encode()))] -= k + 0.5
    return Words(words, c, int(total), int(distinct), shared)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    slim = docs.select(F.col(id_col).alias("__tm_id"), F.col(text_col).alias("__tm_t"))
    training = slim.where(~is_held_out("__tm_id"))
    counts = durable(word_counts(training, "__tm_t"), "counts")
    known = vocabulary(counts)
    sent = docs.sparkSession.sparkContext.broadcast((known, train(training, "__tm_t", known, steps)))
    here: list[Model] = []

    def run(texts: list[str]) -> dict:
        if not here:
            here.append(Model(*sent.value))
        model, own = here[0], sent.value[0]
        toks = Tokens.of(own, texts)
        heavy, single = toks.place < HEAVY, toks.place < TOP - 1
        log_c = np.zeros(len(heavy))
        log_c[heavy] = np.log10(own.counts[toks.place[heavy]] + 0.5)
        p = model.log10(toks) + np.where(single, 0.0, log_c - np.log10(own.mass)[toks.leaf])
        rare, times = toks.repeats(~heavy)
        return {
            "n_tokens": np.diff(toks.starts, append=len(toks.leaf)),
            "n_heavy": np.add.reduceat(heavy.astype(np.int64), toks.starts),
            "logs": np.add.reduceat(log_c, toks.starts),
            "model": np.add.reduceat(p, toks.starts),
            "words": rare,
            "times": times,
        }

    schema = "n_tokens long, n_heavy long, logs double, model double, words array<string>, times array<long>"
    partial = durable(map_texts(slim, "__tm_t", ["__tm_id"], run, schema, SLICE).withColumn("__tm_uid", F.monotonically_increasing_id()), "partial")
    rare = partial.select("__tm_uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("__tm_uid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    looked = rare.join(counts, "word", "left")
    n, c = F.col("times"), F.coalesce(F.col("c"), F.lit(0))
    added = looked.groupBy("__tm_uid").agg(F.sum(F.when(c > 0, n).otherwise(0)).alias("more"), F.sum(n * F.log10(c + 0.5)).alias("rare"))
    own = partial.drop("words", "times").join(added, "__tm_uid", "left")
    rest = F.coalesce("rare", F.lit(0.0))
    return own.select(
        F.col("__tm_id").alias(id_col),
        is_held_out("__tm_id").alias("held_out"),
        "n_tokens",
        (F.col("n_heavy") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("logs") + rest - F.col("n_tokens") * float(known.base_log)).alias("base_score"),
        (F.col("model") + rest).alias("score"),
    )
