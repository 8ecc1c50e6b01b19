"""Near-duplicate groups by the chosen-path set similarity join.

Each distinct shingle set gets a signature of minwise values. In each of several independent trees
a document walks down chosen paths: a node picks, by a hash of its name, one or two of the
signature's positions, and the document goes to the child named by the node, the position and the
document's value there. Similar documents stay together with about their similarity at each
branching. Nodes of at most LEAF documents are compared exhaustively; larger ones branch again.
A tree's first branching picks 1 / similarity positions on average, later ones DEEPER: a path then
survives any number of branchings with a chance that doesn't sink to zero, so that a pair at exactly
0.8 is missed by a tree with a chance of 0.16 after one branching and of 0.44 at most at any depth;
by all TREES with 3e-10 and 5e-5.

Comparisons are confirmed on the full shingle sets (64-bit hashes of every shingle), and a leaf
returns a spanning forest of its links, never all its pairs. There are two rounds:

1. FIRST trees gather the easy links. Small nodes are compared exhaustively; a large node isn't
   branched but cut into blocks, each compared with itself and with the node's first document. That is
   linear, and joins a large group of near copies into few classes (connected components).
2. All trees complete the links. Only pairs of different classes count: nodes of one class are dropped,
   and of a large node the largest class isn't compared with itself, only the others with it and among
   themselves, block by block. That is exact; it is done if it takes BLOCK_ROWS rows a document at most
   (always linear), and at the greatest depth. Otherwise the node branches.

Exact copies of a set collapse before all that, by a digest of the set.

Edge cases: null, empty and blank texts have no shingles, link with nothing and are kept; texts with
fewer words than a shingle are one shingle; null ids take part: a class's id is the smallest id that
isn't null (null if there is none) and a row with a null id is kept only if its class's id is null; repeated rows
are exact copies, all with the id of the class; columns of docs pass by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidemark.llm.common import SPACED, checked, durable, hidden, py_lower, sliced

#: Positions of a signature.
POSITIONS = 64
#: Trees of the first round, and in all.
FIRST, TREES = 3, 12
#: Positions that a node below the first picks on average: at 0.8 each branching then keeps 1.2 paths.
DEEPER = 1.5
#: Documents that a node compares exhaustively in one task.
LEAF = 1000
DEPTH = 8
#: A larger node is compared in blocks if these make so many rows for each of its documents at most.
BLOCK_ROWS = 8
#: Rows that a task should get, many leaves together; shingle sets that it keeps at once.
TASK_ROWS, KEPT_SETS = 4000, 500
#: Row numbers that are broadcast at most (some 40 MB as a hashed relation); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SEED = np.uint64(0x9E3779B97F4A7C15)
#: Estimated similarities this far under the threshold are not confirmed (5 standard errors).
MARGIN = 0.25

_find = re.compile(SPACED).findall
_rng = np.random.Generator(np.random.PCG64(20240101))
_MUL = _rng.integers(0, 2**32, POSITIONS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, POSITIONS, dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _word_hash(cache: dict[str, int], ws: list[str]) -> np.ndarray:
    out = list(map(cache.get, ws))
    if None in out:
        for w in set(ws).difference(cache):
            cache[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        out = list(map(cache.__getitem__, ws))
    return np.array(out, dtype=np.uint64)


def hashed_set(cache: dict[str, int], text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of the whole sequence where there are fewer words."""
    ws = _find(py_lower(text))
    if not ws:
        return np.empty(0, np.uint64)
    h = _word_hash(cache, ws)
    k = min(n, len(ws))
    out = np.zeros(len(ws) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(3) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minwise value at each position, of 32 bits of the hashes."""
    low, h = np.full(POSITIONS, np.iinfo(np.uint32).max, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 4096):
        x = h[i : i + 4096, None] * _MUL + _ADD
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        low = np.minimum(low, x.min(axis=0))
    return low


def _signed(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """docs with n_shingles, digest of the set, signature, and the signature's low bytes: enough to compare by."""
    where = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField("n_shingles", LongType()), StructField("__tm_digest", BinaryType()), StructField("__tm_sig", BinaryType()), StructField("__tm_sketch", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in sliced(batches, text_col):
            size, digest, sig, sketch = [], [], [], []
            for t in b.column(where).to_pylist():
                if len(cache) > 400_000:
                    cache.clear()
                s = hashed_set(cache, t or "", n)
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                low = signature(s) if len(s) else None
                sig.append(None if low is None else low.tobytes())
                sketch.append(None if low is None else low.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, sig, sketch))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _children(nodes: np.ndarray, sigs: np.ndarray, picks: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (index into nodes, child's name): each node picks one or two positions by its name, ``picks`` on average."""
    a = _mix(nodes + SEED)
    first = a % np.uint64(POSITIONS)
    two = (a >> np.uint64(40)).astype(np.float64) / 2.0**24 < picks - 1
    second = (first + np.uint64(1) + (a >> np.uint64(8)) % np.uint64(POSITIONS - 1)) % np.uint64(POSITIONS)
    rows = np.concatenate([np.arange(len(nodes)), np.flatnonzero(two)])
    pos = np.concatenate([first, second[two]])
    value = sigs[rows, pos.astype(np.int64)].astype(np.uint64)
    return rows, _mix(_mix(nodes[rows] * np.uint64(POSITIONS) + pos) + value)


def _root(tree: int) -> np.ndarray:
    return _mix(np.array([tree], np.uint64) + np.uint64(77))


#: A document on a path: node, document, its class, whether the first round has had the tree.
PATH = "node long, uid long, c long, had boolean"


def _paths(b: pa.RecordBatch, rows: np.ndarray, child: np.ndarray, had: np.ndarray) -> pa.RecordBatch:
    uid, c = b.column("uid").to_numpy(), b.column("c").to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(uid[rows]), pa.array(c[rows]), pa.array(had[rows])], names=["node", "uid", "c", "had"])


def _signatures(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, POSITIONS)


def _plant(reps: DataFrame, trees: int, had: int, similarity: float) -> DataFrame:
    """Paths after the first branching of each tree; the first ``had`` trees have been compared before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sigs = _signatures(b)
                for t in range(trees):
                    rows, child = _children(np.repeat(_root(t), b.num_rows), sigs, 1 / similarity)
                    yield _paths(b, rows, child, np.full(b.num_rows, t < had))

    return reps.select("uid", "c", "sig").mapInArrow(run, PATH)


def _branch(big: DataFrame, reps: DataFrame) -> DataFrame:
    """Paths to the children of big nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows, child = _children(b.column("node").to_numpy().view(np.uint64), _signatures(b), DEEPER)
                yield _paths(b, rows, child, np.zeros(b.num_rows, bool))

    return big.select("node", "uid").join(reps.select("uid", "c", "sig"), "uid").select("node", "uid", "c", "sig").mapInArrow(run, PATH)


def _sized(paths: DataFrame, leaf: int) -> DataFrame:
    """Paths with n, of nodes whose documents are of different classes and haven't been compared yet."""
    sizes = paths.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.first("had").alias("had"))
    fresh = sizes.where("lo < hi").where(~F.col("had") | (F.col("n") > leaf)).select("node", "n")
    return paths.select("node", "uid", "c").join(fresh, "node")


def _lopsided(big: DataFrame) -> DataFrame:
    """Paths of big nodes with top (the document is of the node's largest class) and m (documents that aren't)."""
    by_class = big.groupBy("node", "c").agg(F.count(F.lit(1)).alias("k"))
    top = by_class.groupBy("node").agg(F.max(F.struct("k", "c")).alias("x")).select("node", F.col("x.k").alias("k"), F.col("x.c").alias("top"))
    return big.join(top, "node").select("node", "uid", "n", (F.col("c") == F.col("top")).alias("top"), (F.col("n") - F.col("k")).alias("m"))


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _blocks(n: Column, leaf: int) -> Column:
    return F.ceil(n / (leaf // 2)).cast("long")


def _with_head(big: DataFrame, leaf: int) -> DataFrame:
    """(leaf, uid) of big nodes in blocks: each with itself and the node's first document."""
    own = big.select(F.xxhash64("node", F.pmod(F.xxhash64("uid"), _blocks(F.col("n"), leaf))).alias("leaf"), "uid")
    heads = big.groupBy("node").agg(F.min("uid").alias("uid"), F.first("n").alias("n")).select("node", "uid", _upto(_blocks(F.col("n"), leaf)).alias("i"))
    return own.unionByName(heads.select(F.xxhash64("node", "i").alias("leaf"), "uid"))


def _block_rows(leaf: int) -> Column:
    """So many rows _across makes of a node."""
    n, m = F.col("n"), F.col("m")
    p, q = _blocks(n - m, leaf), _blocks(m, leaf)
    return (n - m) * q + m * p + F.when(q > 1, m * q).otherwise(0)


def _across(big: DataFrame, leaf: int) -> DataFrame:
    """(leaf, uid) of big nodes (with top, m) in blocks: those of the largest class with all others, and
    the others among themselves."""
    p, q = _blocks(F.col("n") - F.col("m"), leaf), _blocks(F.col("m"), leaf)
    dealt = big.select("node", "uid", "top", p.alias("p"), q.alias("q"), F.xxhash64("uid").alias("h"))
    tops = dealt.where("top").select("node", "uid", F.pmod("h", F.col("p")).alias("i"), _upto(F.col("q")).alias("j"))
    others = dealt.where("NOT top").withColumn("j", F.pmod("h", F.col("q")))
    met = others.select("node", "uid", _upto(F.col("p")).alias("i"), "j")
    # One block of others meets itself in each block of the class.
    among = others.where("q > 1").select("node", "uid", "j", _upto(F.col("q")).alias("k"))
    return tops.unionByName(met).select(F.xxhash64("node", F.lit(0), "i", "j").alias("leaf"), "uid").unionByName(among.select(F.xxhash64("node", F.lit(1), F.least("j", "k"), F.greatest("j", "k")).alias("leaf"), "uid"))


def _by_leaf(pdf: pd.DataFrame, one) -> list:
    """Applies one (columns of a leaf's rows -> anything) to each leaf of a task's many leaves."""
    pdf = pdf.sort_values(["leaf", "uid"], ignore_index=True)
    leaf = pdf["leaf"].to_numpy()
    cols = {c: pdf[c].to_numpy() for c in pdf.columns}
    cols["sketch"] = np.frombuffer(b"".join(cols["sketch"]), np.uint8).reshape(-1, POSITIONS)
    cuts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1], True])
    return [one({c: v[i:j] for c, v in cols.items()}) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _near(x: dict[str, np.ndarray], i: int, j: int, similarity: float) -> np.ndarray:
    """Of rows i to j: which rows of the leaf are of another class, and of a size and sketch that allow a link."""
    size, sketch, c = x["size"], x["sketch"], x["c"]
    own = size[i:j, None]
    fits = (np.minimum(size, own) >= similarity * np.maximum(size, own) - 1e-9) & (c != c[i:j, None])
    at, to = np.nonzero(fits)
    fits[at, to] = (sketch[at + i] == sketch[to]).sum(axis=1) >= (similarity - MARGIN) * POSITIONS
    return fits


def _rows_at_once(n: int) -> int:
    """So many rows of a leaf of n are compared at once: 16 MB of sketches."""
    return max(1, (1 << 18) // max(1, n))


def _promising(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Of each leaf: the documents that have a possible partner, of another class, there."""

    def one(x: dict[str, np.ndarray]) -> tuple[int, np.ndarray]:
        n = len(x["uid"])
        step, keep = _rows_at_once(n), np.zeros(n, bool)
        if x["c"].min() < x["c"].max():
            for i in range(0, n, step):
                keep |= _near(x, i, min(n, i + step), similarity).any(axis=0)
        return x["leaf"][0], x["uid"][keep]

    found = [(k, u) for k, u in _by_leaf(pdf.reset_index(drop=True), one) if len(u) > 1]
    if not found:
        return pd.DataFrame({"leaf": np.empty(0, np.int64), "uid": np.empty(0, np.int64), "head": np.empty(0, np.int64)})
    # Leaves of several trees that hold the same documents mostly agree in their second smallest one
    # (blocks of one node may all hold its smallest): tasks by that one test a pair once.
    return pd.DataFrame({"leaf": np.concatenate([np.repeat(k, len(u)) for k, u in found]), "uid": np.concatenate([u for _, u in found]), "head": np.concatenate([np.repeat(u[1], len(u)) for _, u in found])})


def _common(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many hashes each two sets share: a product of 0/1 matrices, in slices of columns."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(first) - 1
    several = np.bincount(column)[column] > 1
    owner, column = owner[several], np.cumsum(first[several]) - 1
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        i, j = np.searchsorted(column, (lo, lo + columns))
        m = np.zeros((len(sets), columns), np.float32)
        m[owner[i:j], column[i:j] - lo] = 1
        out += m @ m.T
    return out


def _links(pdf: pd.DataFrame, n: int, percent: int) -> pd.DataFrame:
    """Of each leaf: a spanning forest of the links that full sets confirm."""
    similarity, cache = percent / 100, {}
    sets: dict[int, np.ndarray] = {}
    apart: set[tuple[int, int]] = set()

    def full(x: dict[str, np.ndarray], i: int) -> np.ndarray:
        u = x["uid"][i]
        if u not in sets:
            if len(sets) > KEPT_SETS:
                sets.clear()
            sets[u] = hashed_set(cache, x["text"][i] or "", n)
        return sets[u]

    def one(x: dict[str, np.ndarray]) -> tuple[list[int], list[int]]:
        uid, size, a, b = x["uid"], x["size"], [], []
        possible, step = np.zeros((len(uid), len(uid)), bool), _rows_at_once(len(uid))
        for i in range(0, len(uid), step):
            possible[i : i + step] = np.triu(_near(x, i, min(len(uid), i + step), similarity), i + 1)
        # Many pairs of few documents are confirmed together, few pairs one by one.
        shared = None
        if possible.sum() > 20 * len(uid):
            shared = _common([full(x, i) for i in range(len(uid))])
            possible &= 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
        _, own = np.unique(x["c"], return_inverse=True)
        for i in np.flatnonzero(possible.any(axis=1)):
            for j in np.flatnonzero(possible[i]):
                if own[i] != own[j] and uid[i] != uid[j] and (uid[i], uid[j]) not in apart:
                    both = shared[i, j] if shared is not None else len(np.intersect1d(full(x, i), full(x, j), assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        a.append(uid[i])
                        b.append(uid[j])
                        own[own == own[j]] = own[i]
                    else:
                        apart.add((uid[i], uid[j]))
        return a, b

    found = _by_leaf(pdf.reset_index(drop=True), one)
    return pd.DataFrame({"a": np.array([u for a, _ in found for u in a], np.int64), "b": np.array([u for _, b in found for u in b], np.int64)})


def _round(reps: DataFrame, texts: DataFrame, trees: int, had: int, n: int, percent: int, leaf: int, depth: int) -> DataFrame:
    """Links (a, b) that a round finds between different classes. had: trees of the round before, 0 in the first."""
    similarity = percent / 100
    sized = durable(_sized(_plant(reps, trees, had, similarity), leaf), "nodes")
    small, big = sized.where(F.col("n") <= leaf), sized.where(F.col("n") > leaf)
    found = [small.select(F.col("node").alias("leaf"), "uid")]
    if not had:
        found.append(_with_head(big, leaf))
    else:
        for level in range(1, depth + 1):
            if big.isEmpty():
                break
            big = durable(_lopsided(big), "large")
            few = F.lit(level == depth) | (_block_rows(leaf) <= BLOCK_ROWS * F.col("n"))
            found.append(_across(big.where(few), leaf))
            if level < depth:
                sized = durable(_sized(_branch(big.where(~few), reps), leaf), "nodes")
                found.append(sized.where(F.col("n") <= leaf).select(F.col("node").alias("leaf"), "uid"))
                big = sized.where(F.col("n") > leaf)
    leaves = found[0]
    for x in found[1:]:
        leaves = leaves.unionByName(x)
    leaves = durable(leaves.distinct(), "leaves")
    about = reps.select("uid", "size", "sketch", "c")
    promising = durable(_dealt(leaves, about, F.xxhash64("leaf"), lambda p: _promising(p, similarity), "leaf long, uid long, head long"), "promising")
    # Heads of more rows than a task should get are cut by leaf.
    heavy = promising.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).alias("cuts")).where("cuts > 1")
    promising = promising.join(heavy, "head", "left")
    # Texts are read only for documents that may have a partner.
    needed = durable(promising.select("uid").distinct(), "needed")
    texts = texts.join(checked(needed, BROADCAST_ROWS), "uid", "left_semi")
    key = F.xxhash64("head", F.pmod(F.xxhash64("leaf"), F.coalesce("cuts", F.lit(1))))
    return _dealt(promising, about.join(texts, "uid"), key, lambda p: _links(p, n, percent), "a long, b long").distinct()


def _dealt(leaves: DataFrame, about: DataFrame, key: Column, fn, schema: str) -> DataFrame:
    """Applies fn to leaves, many at a time, so that a task has about TASK_ROWS rows and no leaf is cut."""
    tasks = max(1, leaves.count() // TASK_ROWS)
    return leaves.withColumn("task", F.pmod(key, F.lit(tasks))).join(about, "uid").groupBy("task").applyInPandas(fn, schema)


def classes_of(links: DataFrame) -> DataFrame:
    """(uid, c): each linked document with the smallest uid that it reaches.

    Alternates the two star operations (Kiveris et al., Connected Components in MapReduce and
    beyond): neighbours are pointed to the smallest one, until nothing changes. Only minima are
    grouped; no neighbour list is built."""
    edges = durable(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "edges")
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        edges = durable(large.join(low, "v").select(F.explode(ends).alias("e")).select("e.v", "e.u").where("u < v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if now == known:
            return edges.select(F.col("v").alias("uid"), F.col("u").alias("c"))
        known = now


def _classes(signed: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, first: int, trees: int, leaf: int, depth: int) -> DataFrame:
    """(uid, c, id) of each row with shingles: its class, and its own id."""
    real = signed.where("n_shingles > 0")
    reps = durable(
        real.groupBy("__tm_digest").agg(F.min("__tm_uid").alias("uid"))
        .join(real.select(F.col("__tm_uid").alias("uid"), F.col("n_shingles").alias("size"), F.col("__tm_sig").alias("sig"), F.col("__tm_sketch").alias("sketch")), "uid")
        .select("uid", "__tm_digest", "size", "sig", "sketch", F.col("uid").alias("c")),
        "reps",
    )
    texts = real.select(F.col("__tm_uid").alias("uid"), F.col(text_col).alias("text"))
    links = durable(_round(reps, texts, first, 0, shingle, percent, leaf, depth), "links")
    known = reps.drop("c").join(classes_of(links), "uid", "left").withColumn("c", F.coalesce("c", "uid"))
    links = links.unionByName(durable(_round(durable(known, "known"), texts, trees, first, shingle, percent, leaf, depth), "links"))
    of_set = reps.select("__tm_digest", "uid").join(classes_of(links), "uid", "left").select("__tm_digest", F.coalesce("c", "uid").alias("c"))
    return durable(real.select(F.col("__tm_uid").alias("uid"), F.col(id_col).alias("id"), "__tm_digest").join(of_set, "__tm_digest").select("uid", "c", "id"), "classes")


def _numbered(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    return durable(_signed(docs, text_col, shingle).withColumn("__tm_uid", F.monotonically_increasing_id()), "signed")


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """docs with n_shingles, component_id (smallest id reachable over links), kept (id is that id)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_shingles", "component_id", "kept")])
    signed = _numbered(docs, text_col, shingle)
    classes = _classes(signed, id_col, text_col, shingle, percent, first, trees, leaf, depth)
    ids = classes.groupBy("c").agg(F.min("id").alias("component_id"))
    label = classes.join(ids, "c").select(F.col("uid").alias("__tm_uid"), "component_id", F.lit(True).alias("__tm_linked"))
    component = F.when(F.col("__tm_linked"), F.col("component_id")).otherwise(F.col(id_col))
    out = signed.join(label, "__tm_uid", "left").select(*docs.columns, "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def unlike_documents(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """docs with one row of each class: that of the smallest id, null last. Rows without shingles all stay.

    Classes are told apart by their rows: rows that share an id, or have none, stay unless their texts are
    near-duplicates. All columns pass unchanged, whatever their names."""
    plain, back = hidden(docs, id_col, text_col)
    signed = _numbered(plain, text_col, shingle)
    classes = _classes(signed, id_col, text_col, shingle, percent, first, trees, leaf, depth)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid")))
    chosen = classes.groupBy("c").agg(best.alias("x")).select(F.col("x.uid").alias("uid"))
    gone = durable(classes.join(chosen, "uid", "left_anti").select(F.col("uid").alias("__tm_uid")), "gone")
    return signed.join(checked(gone, BROADCAST_ROWS), "__tm_uid", "left_anti").select(*back)
