"""Approximate nearest neighbours by learned partitions.

On a bounded sample (SAMPLE rows) the neighbour graph is built and cut into balanced parts; a small classifier
(one hidden layer) learns in which parts a vector and its neighbours are. It then gives each row of the table its
part, and routes each query to its most probable parts, whose rows are reranked by exact cosine.
How many parts a query probes is calibrated: CALIBRATION rows that the classifier hasn't seen are compared
with the whole table, and so many parts are probed that these hold the wanted share of their true
neighbours. Each query probes on until its parts hold enough rows.
Parts grow with the root of the table, up to MOST_PARTS, which the sample bounds.

Repeated rows (id and vector) count once. Of equal vectors only the k + 1 with the smallest ids can be
among k nearest, ties going to smaller ids; the others are found by no query and are left out of the parts, so that one vector with a
third of all rows doesn't fill a part. Parts are compared in cells of bounded size.

Edge cases: vectors that are null or zero, or hold null or non-finite components, or have another
length than most, take no part, nor do null ids; rows with the same id count as the query's own, and
an id of several vectors is found once, by its best score; fewer candidates than k are all found; tables of too few
directions for a graph are one part; vectors are scaled by powers of two, which changes no cosine, so that
huge and tiny components don't overflow; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable

SAMPLE = 6000
NEIGHBOURS = 10
RECALL = 0.95
#: Rows whose true neighbours say how many parts to probe.
CALIBRATION = 256
#: Sizes of a cell, in rows of the table and queries.
CELL, CELL_QUERIES = 4000, 1000
#: Scores that differ by less may be of equal rows.
EPSILON = 1e-9
#: Parts for each root of the number of rows, up to MOST_PARTS (so many that each has 24 rows of the sample).
ROOT_SHARE, MOST_PARTS = 0.25, 250
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, which makes its largest component 0.5 to 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x.astype(np.float64))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k nearest other rows of each row, block by block."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + 1024] = np.argpartition(-s, k, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, room: float = 1.1) -> np.ndarray:
    """Cuts the graph into parts of about equal size: halves along main directions, then moves
    nodes to the part of most of their neighbours where there is room."""
    part = np.zeros(len(x), np.int64)
    queue = [(np.arange(len(x)), 0, parts)]
    while queue:
        rows, first, n = queue.pop()
        if n == 1:
            part[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.svd(centred.T @ centred)[0][:, 0]
        order, cut = rows[np.argsort(centred @ axis, kind="stable")], len(rows) * (n // 2) // n
        queue += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    most, size = int(room * len(x) / parts) + 1, np.bincount(part, minlength=parts)
    back: list[list[int]] = [[] for _ in range(len(x))]
    for i, js in enumerate(graph):
        for j in js:
            back[j].append(i)
    linked = [np.concatenate([js, np.array(b, np.int64)]) for js, b in zip(graph, back, strict=True)]
    for _ in range(rounds):
        moved = 0
        for i in range(len(x)):
            votes = np.bincount(part[linked[i]], minlength=parts)
            votes[(size >= most) & (np.arange(parts) != part[i])] = -1
            to = int(votes.argmax())
            if votes[to] > votes[part[i]]:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if moved < len(x) / 200:
            break
    return part


class Classifier:
    """Softmax over parts with one hidden layer, fitted by Adam to a row's own part and its neighbours'."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, graph: np.ndarray, hidden: int = 128, epochs: int = 30, seed: int = 1):
        wanted = np.zeros((len(x), parts))
        wanted[np.arange(len(x)), part] = 0.5
        np.add.at(wanted, (np.arange(len(x))[:, None], part[graph]), 0.5 / graph.shape[1])
        rng = np.random.Generator(np.random.PCG64(seed))
        self.w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
        m, v, t = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 128):
                at = order[i : i + 128]
                h, p = self._forward(x[at])
                p = (p - wanted[at]) / len(at)
                back = (p @ self.w[2].T) * (h > 0)
                t += 1
                for j, g in enumerate((x[at].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                    g = g + 1e-4 * self.w[j]
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    self.w[j] -= 0.003 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(np.sqrt(x.shape[1]) * x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return h, z / z.sum(axis=1, keepdims=True)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, the most probable first."""
        return np.argsort(-self._forward(x)[1], axis=1, kind="stable")


def probes_needed(ranked: np.ndarray, near: list[tuple[int, int]], recall: float = RECALL) -> int:
    """How many parts must be probed to reach that share of true neighbours: (row of ranked, part of the neighbour)."""
    place = np.argsort(ranked, axis=1)
    row, part = np.array(near).T
    share = np.cumsum(np.bincount(place[row, part], minlength=ranked.shape[1])) / len(near)
    return int(np.searchsorted(share, recall) + 1)


def _true_neighbours(index: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(number of the query, part) of the k nearest rows in the whole index of each of a few queries."""
    sent = index.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = sent.value
        best, parts = np.full((len(x), k), -np.inf), np.zeros((len(x), k), np.int64)
        for b in batches:
            if b.num_rows:
                s = x @ unit(np.stack(b.column(1).to_numpy(zero_copy_only=False))).T
                s[ids[:, None] == b.column(0).to_numpy()[None, :]] = -np.inf
                s = np.concatenate([best, s], axis=1)
                p = np.concatenate([parts, np.broadcast_to(b.column(2).to_numpy(), (len(x), b.num_rows))], axis=1)
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best, parts = np.take_along_axis(s, at, axis=1), np.take_along_axis(p, at, axis=1)
        q, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(parts[q, j]), pa.array(best[q, j])], names=["q", "part", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "part")
    found = index.select("id", "v", "part").mapInArrow(run, "q long, part long, score double")
    return [tuple(r) for r in found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("q", "part").collect()]


def _route(rows: DataFrame, model: Classifier | None, most: int) -> DataFrame:
    """rows (id, v) with parts: the first ``most`` in order of probability."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False))
                parts = np.zeros((len(x), 1), np.int64) if sent.value is None else sent.value.ranked(unit(x))[:, :most]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(parts.astype(np.int32)), pa.list_(pa.int32()))], names=["id", "v", "parts"])

    return rows.mapInArrow(run, "id long, v array<double>, parts array<int>")


def _rerank(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of one cell: each query's k nearest rows, by exact cosine."""
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
    q, v = scaled(np.stack(queries["v"])), scaled(np.stack(rows["v"]))
    qid, vid = queries["id"].to_numpy(), rows["id"].to_numpy()
    lq, lv = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    s = (q / lq[:, None]) @ (v / lv[:, None]).T
    s[qid[:, None] == vid[None, :]] = -np.inf
    # The k-th score of distinct ids, with a margin for copies, whose products may differ in the last
    # bits: all rows from there on are scored exactly, however many tie.
    ids, of_id = np.unique(vid, return_inverse=True)
    best = s
    if len(ids) < len(vid):
        by_id = np.argsort(of_id, kind="stable")
        best = np.maximum.reduceat(s[:, by_id], np.flatnonzero(np.r_[True, np.diff(of_id[by_id]) > 0]), axis=1)
    n = min(len(ids), k)
    least = np.partition(best, best.shape[1] - n, axis=1)[:, best.shape[1] - n] - EPSILON
    near = (s >= least[:, None]) & np.isfinite(s)
    ends = np.cumsum(near.sum(axis=1))
    out, i = [], 0
    while i < len(q):
        # Queries with about CELL candidates together.
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CELL, side="right")))
        at, row = np.nonzero(near[i:j])
        at += i
        score = np.einsum("ij,ij->i", v[row], q[at]) / (lq[at] * lv[row])
        found = pd.DataFrame({"at": at, "query_id": qid[at], "vec_id": vid[row], "score": score}).sort_values(["at", "score", "vec_id"], ascending=[True, False, True])
        out.append(found.drop_duplicates(["at", "vec_id"]).groupby("at").head(k).drop(columns="at"))
        i = j
    return pd.concat(out)


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, part_rows: int | None = None, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all other rows.

    part_rows: rows for each part, in place of the rule by the root of the table."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not length:
        return spark.createDataFrame([], RESULT)
    rows = rows.where(F.size("v") == length[0]["d"])
    copies = Window.partitionBy("v").orderBy("id")
    candidates = rows.select("id", "v").distinct().withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).drop("n")
    candidates = durable(candidates, "vectors")

    total = candidates.count()
    parts = int(np.clip(total // part_rows if part_rows else round(ROOT_SHARE * total**0.5), 2, MOST_PARTS))
    drawn = candidates.orderBy(F.xxhash64("id"), "id").limit(sample + CALIBRATION).toPandas()
    checks = min(CALIBRATION, len(drawn) // 5)
    model, probes, x = None, 1, np.empty((0, 1))
    if len(drawn):
        x = np.unique(unit(np.stack(drawn["v"][checks:])), axis=0)
    # A sample of few different directions has no graph: all rows are one part.
    if len(x) > max(NEIGHBOURS, parts):
        graph = neighbour_graph(x)
        model = Classifier(x, balanced_parts(x, graph, parts), parts, graph)
    else:
        parts = 1

    index = durable(_route(candidates, model, 1).select("id", "v", F.col("parts")[0].alias("part")), "index")
    if model and checks:
        asked = unit(np.stack(drawn["v"][:checks]))
        near = _true_neighbours(index, drawn["id"][:checks].to_numpy(), asked, k)
        probes = probes_needed(model.ranked(asked), near, recall) if near else parts
    held = {r["part"]: r for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")).collect()}
    sizes = [held[i]["n"] if i in held else 0 for i in range(parts)]
    # Probe on until one of the parts holds k ids besides the query's own: ids may be in several parts.
    counts = F.array(*[F.lit(int(held[i]["ids"]) if i in held else 0) for i in range(parts)])
    routed = _route(rows.where("q").select("id", "v"), model, parts)
    enough = F.aggregate(
        "parts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("ids")),
        lambda a, p: F.when((a["n"] >= probes) & (a["ids"] > k), a).otherwise(F.struct((a["n"] + 1).alias("n"), F.greatest(a["ids"], F.element_at(counts, p + 1)).alias("ids"))),
    )["n"]
    routed = durable(routed.select("id", "v", F.slice("parts", 1, enough).alias("parts")), "queries")
    asked = dict(routed.select(F.explode("parts").alias("part")).groupBy("part").count().collect())
    cells = F.array(*[F.lit(-(-s // CELL) or 1) for s in sizes])
    query_cells = F.array(*[F.lit(-(-asked.get(i, 0) // CELL_QUERIES) or 1) for i in range(parts)])

    def upto(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    at = F.col("part") + 1
    left = routed.select("id", "v", F.explode("parts").alias("part")).withColumn("qc", F.pmod(F.xxhash64("id"), F.element_at(query_cells, at)).cast("int")).withColumn("vc", upto(F.element_at(cells, at)))
    right = index.withColumn("vc", F.pmod(F.xxhash64("id"), F.element_at(cells, at)).cast("int")).withColumn("qc", upto(F.element_at(query_cells, at)))
    key = ["part", "qc", "vc"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda q, v: _rerank(q, v, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
