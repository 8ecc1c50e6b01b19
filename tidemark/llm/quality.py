"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features are hashed n-grams of a text's words, taken twice: of the lower-cased words (one and two)
and of their shapes (one, two and three: capitals, title case, lower case, digits, or the
punctuation itself), with a pair of equal neighbours counted as a repetition, and pairs of such pairs counted too. A document is a
sparse vector of log counts of unit length; its score is the logistic of the dot product with the
weights.

Training takes a bounded sample of labelled rows that aren't held out: the MOST_TRAINING with the
smallest hash of their id. Their sparse vectors come to the driver in pieces (some 50 MB at most for usual
texts, since features are 32-bit), where the sequential updates run; the weights (1 MB) are
broadcast. Scoring covers every whole text.

Edge cases: null and empty texts score as the bias alone; a null id counts as an empty one in the
split (so it is held out); labels that are null or not 0 or 1 are left out, and an id with both
labels trains on both; without labels of both kinds the score is the share of 1 among the labels
(0.5 without any); repeated rows are scored one by one; extra columns pass by.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts

BITS = 18
MOST_TRAINING = 8000
#: The sample comes to the driver in so many pieces.
PIECES = 16
EPOCHS = 6
FOLDS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.2
THRESHOLD = 0.3
_find = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall
_LETTERS = np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) << 1


def _shape(w: str) -> str:
    if w[0].isalpha():
        return "A" if w.isupper() and len(w) > 1 else "Aa" if w[0].isupper() else "a"
    return "9" if w[0].isdigit() else w[:4]


class Features:
    """Sparse vectors of texts; keeps the hashes of words that it has seen."""

    def __init__(self, bits: int = BITS):
        self.mask, self.known = np.uint64((1 << bits) - 1), {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct feature numbers and their values; empty for a text without words."""
        ws = _find(text)
        if not ws:
            return np.empty(0, np.int32), np.empty(0, np.float32)
        if len(self.known) > 400_000:
            self.known.clear()
        known = self.known
        got = list(map(known.get, ws))
        if None in got:
            for w in set(ws).difference(known):
                known[w] = (_hash(w.lower()) | w[0].isalpha(), _hash("#" + _shape(w)))
            got = list(map(known.__getitem__, ws))
        pair = np.array(got, np.uint64)
        w, s = pair[:, 0], pair[:, 1]
        grams = [w * np.uint64(3), s * np.uint64(5)]
        if len(w) > 1:
            same = (w[1:] == w[:-1]) & ((w[1:] & _LETTERS) == 1)
            grams += [np.where(same, np.uint64(11), w[:-1] * np.uint64(7) + w[1:] * np.uint64(13)), s[:-1] * np.uint64(17) + s[1:] * np.uint64(19)]
        if len(w) > 2:
            grams.append(np.uint64(37) + same[1:].astype(np.uint64) + np.uint64(2) * same[:-1].astype(np.uint64))
            grams.append(s[:-2] * np.uint64(23) + s[1:-1] * np.uint64(29) + s[2:] * np.uint64(31))
        at, n = np.unique((_mix(np.concatenate(grams)) & self.mask).astype(np.int32), return_counts=True)
        x = np.log1p(n).astype(np.float32)
        return at, x / np.float32(np.sqrt((x * x).sum()))


def logistic(z: float | np.ndarray) -> float | np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal updates over rows (features, values, label)."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    share = sum(y for *_, y in rows) / len(rows)
    bias, bias_n = float(np.log(share / (1 - share))), 0.0

    def weights(at: np.ndarray | slice) -> np.ndarray:
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= L1, 0.0, (np.sign(za) * L1 - za) / ((BETA + np.sqrt(na)) / ALPHA + L2))

    for epoch in range(epochs):
        for i in np.random.Generator(np.random.PCG64(epoch)).permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            g = float(logistic(float(w @ x) + bias)) - y
            gx = g * x
            grown = np.sqrt(n[at] + gx * gx) - np.sqrt(n[at])
            z[at] += gx - grown / ALPHA * w
            n[at] += gx * gx
            bias_n += g * g
            bias -= 0.1 * g / (1 + np.sqrt(bias_n))
    return weights(slice(None)).astype(np.float32), bias


def held_out(id_col: str, fold: int = 0, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def _training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    known = labels.select(F.col(id_col).alias("__tm_id"), F.col(label_col).cast("int").alias("__tm_y")).where(F.col("__tm_y").isin(0, 1)).distinct()
    known = known.where(~held_out("__tm_id")).orderBy(F.xxhash64("__tm_id"), "__tm_id", "__tm_y").limit(most)
    sample = docs.select(F.col(id_col).alias("__tm_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(known), "__tm_id").select("t", "__tm_y")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in batches:
            got = [f.of(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([x.tobytes() for _, x in got], pa.binary()), b.column(1)], names=["at", "x", "y"])

    # Piece by piece: the driver's JVM holds one of them, its Python the vectors once.
    got = sample.limit(most).repartition(PIECES).mapInArrow(vectors, "at binary, x binary, y int").toLocalIterator()
    known = sorted((len(r["at"]), r["at"], r["y"], r["x"]) for r in got)
    return [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32), y) for _, a, y, x in known]


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: list[str] | None = None, most: int = MOST_TRAINING) -> DataFrame:
    """The id (or the columns of ``keep``) with held_out, score and predicted of each document."""
    rows = _training_rows(docs, labels, id_col, text_col, label_col, most)
    ys = {y for *_, y in rows}
    model = train(rows) if len(ys) == 2 else None
    constant = 0.5 if not ys else float(ys.pop()) if len(ys) == 1 else 0.0
    del rows
    sent = docs.sparkSession.sparkContext.broadcast(model)
    here: list[Features] = []

    def score(texts: list[str]) -> dict:
        if sent.value is None:
            return {"score": [constant] * len(texts)}
        if not here:
            here.append(Features())
        w, bias = sent.value
        out = []
        for t in texts:
            at, x = here[0].of(t)
            out.append(float(logistic(float(w[at] @ x) + bias)))
        return {"score": out}

    keep = list(keep or [id_col])
    raw = map_texts(docs.drop("score"), text_col, keep, score, "score double")
    return raw.withColumns({"held_out": held_out(id_col), "predicted": F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)}).select(*keep, "held_out", "score", "predicted")
