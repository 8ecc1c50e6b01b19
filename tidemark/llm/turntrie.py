"""The trie of conversation prefixes, by double arrays in prefix shards.

A turn is a record of RECORD bytes, a digest of role and text and the number of the text's words; a
conversation is its records, one after the other, so that byte order puts common prefixes together. Equal
conversations become one sequence first, with their number, smallest id, and digest of their ids. The sequences
are cut into shards by ranges, so one frequent first turn or conversation is many shards, or one row.

A shard numbers its turns densely and packs its trie into BASE and CHECK arrays: the child of node s by turn t
is BASE[s] + t, if CHECK there is s. Walking each sequence down the arrays finds its nodes, on which the
members' counts are gathered. Only nodes on the path of a shard's first or last sequence can be in other shards
too: of those a shard returns what its other nodes add to them, and the parts are merged over the whole table. A merged
node's own share goes to one of the paths that it lies on, and up this path.

Edge cases: rows without a conversation id belong to no conversation; null turns come first; turns of one number
are ordered by role and text; null role or text is empty; repeated rows are turns of their own; an empty table has no
nodes, not even a root; other columns are left out. A conversation is one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import SPACED, durable

#: Bytes of a turn: digest and number of words.
RECORD = 20
#: Turns of a conversation that are ordered together; ids that are joined together; bytes of sequences in a shard.
TURNS, IDS, SHARD_BYTES = 256, 4096, 4 << 20
#: Free slots that are tried for the children of one node before the arrays grow.
TRIES = 16
EMPTY = hashlib.sha256(b"").hexdigest()
_NODES = "shard int, side int, depth long, key binary, parent_key binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends binary"


def sequences_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, seq): each conversation's records in order, as one binary."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256), 1, 2 * RECORD - 8)
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.floor(F.col(turn) / TURNS).alias("block"), r.alias("role"), t.alias("text"),
        F.concat(digest, F.lpad(F.hex(F.regexp_count(t, F.lit(SPACED)).cast("long")), 8, "0")).alias("rec"),
    )
    # In blocks of turns, so that one long conversation is ordered by many tasks.
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    in_order = lambda k, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda x: x[v]), "")
    blocks = rows.withColumn("pos", F.row_number().over(order)).groupBy("conv_id", "block").agg(in_order("pos", "rec").alias("recs"))
    blocks = blocks.withColumn("at", F.struct(F.col("block").isNotNull().alias("known"), F.coalesce("block", F.lit(0)).alias("block")))
    return blocks.groupBy("conv_id").agg(F.unhex(in_order("at", "recs")).alias("seq"))


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4, **columns: str) -> DataFrame:
    """(conv_id, seq): conversations whose first h turns are those of the conversation at the multiple of ``every``
    before, h being the id's CRC-32 modulo ``most``."""
    own = durable(sequences_of(turns, **columns), "turns")
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.substring("seq", 1, RECORD * (most - 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int") * RECORD
    made = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left").withColumn("h", h)
    return made.select("conv_id", F.concat(F.coalesce(F.substr("head", F.lit(1), F.col("h")), F.lit(b"")), F.substr("seq", F.col("h") + 1)).alias("seq"))


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """(seq, n, low, ends): each distinct sequence with its number of conversations, their smallest id, and the
    digest of their ids in order. Ids are joined in blocks, and a sequence's blocks streamed through one digest."""
    n, low, high = convs.agg(F.count(F.lit(1)), F.min("conv_id"), F.max("conv_id")).first()
    width = max(1, (high - low + 1) * IDS // n) if n else 1
    keyed = convs.select(F.unhex(F.sha2("seq", 256)).alias("k"), F.expr(f"conv_id div {width}").alias("block"), "conv_id", "seq")
    blocks = keyed.groupBy("k", "block").agg(
        F.first("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"),
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"),
    )
    out = "seq binary, n long, low long, ends binary"
    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, n, low, digest = None, b"", 0, 0, hashlib.sha256()
        for b in batches:
            done = []
            for k, s, m, least, ids in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if k != at:
                    if at is not None:
                        done.append((seq, n, low, digest.digest()))
                    at, seq, n, low, digest = k, s, m, least, hashlib.sha256(ids.encode())
                else:
                    n, low = n + m, min(low, least)
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True) if done else [[]] * 4, schema, strict=True)], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((seq, n, low, digest.digest()), schema, strict=True)], schema=schema)

    return blocks.select("k", "seq", "n", "low", "ids", "block").repartition("k").sortWithinPartitions("k", "block").mapInArrow(run, out)


class DoubleArray:
    """BASE and CHECK of a trie over sorted, distinct sequences of dense labels.

    labels: of all sequences, one after the other; off and length: where each begins and how long it is.
    Nodes are slots; the root is 0. base and check have what the arrays hold, depth a node's depth, and
    record the index in labels of a turn that leads to it."""

    def __init__(self, labels: np.ndarray, off: np.ndarray, length: np.ndarray):
        self.labels, self.off, self.length = labels, off, length
        n = len(off)
        common = np.zeros(n + 1, np.int64)
        for i in range(1, n):
            m = min(length[i - 1], length[i])
            unlike = np.flatnonzero(labels[off[i - 1] : off[i - 1] + m] != labels[off[i] : off[i] + m])
            common[i] = unlike[0] if len(unlike) else m
        #: Down to here each sequence is packed level by level; below, it is a chain of its own.
        self.shared = np.minimum(length, np.maximum(common[:-1], common[1:]) + 1)
        chains = length - self.shared
        room = 2 * int(self.shared.sum() + chains.sum()) + 64
        self.base, self.check = np.zeros(room, np.int64), np.full(room, -1, np.int64)
        self.depth, self.record = np.zeros(room, np.int64), np.full(room, -1, np.int64)
        self.check[0], self.size = -2, 1
        self.levels: list[np.ndarray] = []
        vocabulary = int(labels.max(initial=0)) + 1
        at = np.zeros(n, np.int64)
        for d in range(int(self.shared.max(initial=0))):
            i = np.flatnonzero(self.shared > d)
            rec = off[i] + d
            edges, first, back = np.unique(at[i] * vocabulary + labels[rec], return_index=True, return_inverse=True)
            slots = self._place(edges // vocabulary, edges % vocabulary)
            self.depth[slots], self.record[slots] = d + 1, rec[first]
            self.levels.append(slots)
            at[i] = slots[back]
        # Chains follow each other in fresh slots.
        rec = np.repeat(off + self.shared, chains) + np.arange(chains.sum()) - np.repeat(np.cumsum(chains) - chains, chains)
        self.chain = self._fresh(len(rec)) + np.arange(len(rec))
        self.chain_of = np.repeat(np.arange(n), chains)
        self.chain_first = np.cumsum(chains) - chains
        parent = self.chain - 1
        top = chains > 0
        parent[self.chain_first[top]] = at[top]
        self.base[parent], self.check[self.chain] = self.chain - labels[rec], parent
        self.depth[self.chain], self.record[self.chain] = rec - off[self.chain_of] + 1, rec

    def _fresh(self, m: int) -> int:
        """m slots at the end."""
        first, self.size = self.size, self.size + m
        if self.size > len(self.base):
            more = max(len(self.base), self.size)
            for name, fill in (("base", 0), ("check", -1), ("depth", 0), ("record", -1)):
                setattr(self, name, np.append(getattr(self, name), np.full(more, fill, np.int64)))
        return first

    def _place(self, parent: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Slots for a level's edges, in order of parent and label; sets base of the parents and check."""
        new = np.ones(len(parent), bool)
        new[1:] = parent[1:] != parent[:-1]
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(parent)))
        slots = np.empty(len(parent), np.int64)
        free, f = np.flatnonzero(self.check[: self.size] == -1), 0
        for a, m in zip(first[many > 1].tolist(), many[many > 1].tolist(), strict=True):
            own = label[a : a + m] - label[a]
            while f < len(free) and self.check[free[f]] != -1:
                f += 1
            for s in free[f : f + TRIES].tolist():
                if s + own[-1] < self.size and (self.check[s + own] == -1).all():
                    break
            else:
                s = self._fresh(int(own[-1]) + 1)
            slots[a : a + m] = s + own
            self.check[s + own] = parent[a]
        # Single children go anywhere.
        single = first[many == 1]
        free = np.flatnonzero(self.check[: self.size] == -1)[: len(single)]
        lack = len(single) - len(free)
        slots[single] = np.append(free, self._fresh(lack) + np.arange(lack)) if lack else free
        self.check[slots[single]] = parent[single]
        self.base[parent[first]] = slots[first] - label[first]
        return slots

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sequences, nodes) of each depth from 0, by the arrays alone, down to where the chains begin."""
        i, at = np.arange(len(self.off)), np.zeros(len(self.off), np.int64)
        for d in range(int(self.shared.max(initial=0)) + 1):
            yield i, at
            on = self.shared[i] > d
            i, at = i[on], at[on]
            down = self.base[at] + self.labels[self.off[i] + d]
            if not (self.check[down] == at).all():
                raise AssertionError("a packed sequence isn't found")
            at = down

    def path(self, i: int) -> np.ndarray:
        """All nodes of one sequence, from the root."""
        at = [0]
        for d in range(int(self.shared[i])):
            at.append(int(self.base[at[-1]] + self.labels[self.off[i] + d]))
        return np.append(at, self.chain[self.chain_of == i])


def _shard(seqs: list[bytes], n: np.ndarray, low: np.ndarray, ends: list[bytes], shard: int) -> dict[str, list]:
    """Rows of _NODES for a shard's sequences, which are sorted and distinct."""
    length = np.array([len(s) // RECORD for s in seqs], np.int64)
    off = np.cumsum(length) - length
    raw = b"".join(seqs)
    recs = np.frombuffer(raw, f"S{RECORD}")
    words = np.frombuffer(raw, ">u4").reshape(-1, RECORD // 4)[:, -1].astype(np.int64)
    # Dense ids in order of depth, so that the first children of a node have ids side by side.
    _, dense = np.unique(recs, return_inverse=True)
    order = np.lexsort((np.repeat(np.arange(len(seqs)), length), np.arange(len(recs)) - np.repeat(off, length)))
    _, first = np.unique(dense[order], return_index=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    trie = DoubleArray(rank[dense] if len(recs) else np.empty(0, np.int64), off, length)

    m = trie.size
    count, least, kids, last = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64), np.full(m, -1, np.int64)
    for i, at in trie.walk():
        np.add.at(count, at, n[i])
        np.minimum.at(least, at, low[i])
        done = length[i] == trie.depth[at]
        last[at[done]] = i[done]
    count[trie.chain], least[trie.chain] = n[trie.chain_of], low[trie.chain_of]
    chained = np.flatnonzero(length > trie.shared)
    last[trie.chain[(trie.chain_first + length - trie.shared - 1)[chained]]] = chained

    paths = [trie.path(0)] + ([trie.path(len(seqs) - 1)] if len(seqs) > 1 else [])
    on_path = np.zeros(m, bool)
    on_path[np.concatenate(paths)] = True
    used = np.flatnonzero(trie.check[:m] != -1)
    inner = used[~on_path[used]]
    np.add.at(kids, trie.check[inner], 1)
    saved, leaves = np.zeros(m, np.int64), np.zeros(m, np.int64)
    saved[inner] = (count[inner] - 1) * words[trie.record[inner]]
    leaves[inner] = kids[inner] == 0
    # Chains from their ends, then the levels from the lowest.
    for x in (saved, leaves):
        v = x[trie.chain]
        run = np.cumsum(v[::-1])[::-1]
        bounds = np.append(trie.chain_first, len(v))[1:]
        x[trie.chain] = run - np.append(run, 0)[bounds[trie.chain_of]]
        heads = trie.chain[trie.chain_first[chained]]
        np.add.at(x, trie.check[heads], x[heads])
        for slots in reversed(trie.levels):
            np.add.at(x, trie.check[slots], x[slots])

    key: dict[int, bytes] = {}
    out: dict[str, list] = {c.split()[0]: [] for c in _NODES.split(", ")}

    def add(**columns) -> None:
        for c, values in columns.items():
            out[c] += values

    for side, path in enumerate(paths):
        i, k, keys = (0, len(seqs) - 1)[side], b"", [b""]
        for d in range(len(path) - 1):
            k = hashlib.sha256(k + seqs[i][d * RECORD : (d + 1) * RECORD]).digest()[:16]
            keys.append(k)
        fresh = np.array([int(s) not in key for s in path])
        key.update(zip(path.tolist(), keys, strict=True))
        part = lambda x: (x[path] * fresh).tolist()  # noqa: B023, E731
        add(
            shard=[shard] * len(path), side=[side] * len(path), depth=list(range(len(path))), key=keys, parent_key=[None, *keys[:-1]],
            conv_id=[int(v) if f else None for v, f in zip(least[path], fresh, strict=True)], parent_conv_id=[None] * len(path),
            n_convs=part(count), n_children=part(kids), n_leaves=part(leaves), saved_tokens=part(saved),
            words=[0, *words[trie.record[path[1:]]].tolist()], ends=[ends[last[s]] if last[s] >= 0 else None for s in path],
        )
    parent = trie.check[inner]
    from_path = on_path[parent]
    size = len(inner)
    add(
        shard=[shard] * size, side=[None] * size, depth=trie.depth[inner].tolist(), key=[None] * size, parent_key=[key[int(p)] if f else None for p, f in zip(parent, from_path, strict=True)],
        conv_id=least[inner].tolist(), parent_conv_id=[None if f else int(v) for v, f in zip(least[parent], from_path, strict=True)],
        n_convs=count[inner].tolist(), n_children=kids[inner].tolist(), n_leaves=leaves[inner].tolist(), saved_tokens=saved[inner].tolist(),
        words=[None] * size, ends=[ends[i] if i >= 0 else None for i in last[inner]],
    )
    return out


def prefix_nodes(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of convs (conv_id, seq): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    seqs = durable(distinct_sequences(durable(convs, "rebuilt")), "sequences")
    volume = seqs.agg(F.sum(F.octet_length("seq") + 60)).first()[0] or 0
    schema = to_arrow_schema(StructType.fromDDL(_NODES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            rows = _shard(t["seq"].to_pylist(), t["n"].to_numpy(), t["low"].to_numpy(), t["ends"].to_pylist(), TaskContext.get().partitionId())
            yield from pa.table([pa.array(rows[f.name], f.type) for f in schema], schema=schema).to_batches(50_000)

    packed = durable(seqs.repartitionByRange(max(1, math.ceil(volume / SHARD_BYTES)), "seq").sortWithinPartitions("seq").mapInArrow(run, _NODES), "nodes")
    paths = packed.where("side IS NOT NULL")
    merged = paths.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.min(F.struct("shard", "side")).alias("owner"),
    )
    below = merged.where("depth > 0").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("_more"))
    upper = durable(merged.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0))).drop("_more"), "upper")
    # A merged node's own share counts once, on the path that owns it, and for all nodes above it there.
    mine = F.col("owner") == F.struct("shard", "side")
    up = Window.partitionBy("shard", "side").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = paths.select("shard", "side", "key").join(upper.select("key", "owner", "depth", "n_convs", "words", "n_children", "conv_id"), "key")
    shares = own.select(
        "key", F.sum(F.when(mine, (F.col("n_convs") - 1) * F.col("words")).otherwise(0)).over(up).alias("_saved"),
        F.sum(F.when(mine & (F.col("n_children") == 0), 1).otherwise(0)).over(up).alias("_leaves"),
    ).groupBy("key").agg(F.sum("_saved").alias("_saved"), F.sum("_leaves").alias("_leaves"))
    parents = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    top = upper.join(shares, "key").withColumns({"n_leaves": F.col("n_leaves") + F.col("_leaves"), "saved_tokens": F.col("saved_tokens") + F.col("_saved")})
    top = top.join(parents, "parent_key", "left").select(columns)
    inner = packed.where("side IS NULL")
    # A shard's own path nodes: a parent with many children has them in many shards.
    near = own.groupBy("shard", F.col("key").alias("parent_key")).agg(F.first("conv_id").alias("parent_conv_id"))
    edge = inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(near, ["shard", "parent_key"]).select(columns)
    nodes = inner.where("parent_key IS NULL").select(columns).unionByName(edge).unionByName(top)
    return nodes.withColumn("ends_sha256", F.coalesce(F.lower(F.hex("ends")), F.lit(EMPTY))).drop("ends")
