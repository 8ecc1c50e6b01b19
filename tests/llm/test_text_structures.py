"""Recompression, spelling variants and the conversation trie, against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import recompress, spelling, turntrie

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


# Substrings


def removed(texts, size=35):
    ws = [WORDS(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in ws for i in range(len(w) - size + 1))
    out = []
    for w in ws:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repetitive(r):
    some = lambda n, k: [f"w{r.randrange(k)}" for _ in range(n)]
    passage, period = some(90, 500), some(3, 500)
    out = [None, "", " \t ", "one", " ".join(["a"] * 200), " ".join(["a"] * 34), " ".join(period * 40), " ".join(some(3, 500) * 11 + ["x", "y"])]
    for _ in range(40):
        i, j = sorted((r.randrange(90), r.randrange(90)))
        out.append("\n".join(some(r.randrange(80), 500) + passage[i:j] + some(r.randrange(80), 500)))
    out += [out[-1], out[-1], "naïve 日本語 \x1c " * 30]
    return out


@pytest.mark.parametrize(("batch", "bucket", "parts"), [(6 << 20, 16 << 20, 1), (300, 200, 5)])
def test_substrings_equal_brute_force(spark, monkeypatch, batch, bucket, parts):
    monkeypatch.setattr(recompress, "BATCH_BYTES", batch)
    monkeypatch.setattr(recompress, "BUCKET_BYTES", bucket)
    texts = repetitive(random.Random(4))
    rows = [(None if i == 9 else i, t, i, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, n_words string").repartition(parts)
    got = {r["row"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["doc_id"]) for r in recompress.digests(df).collect()}
    want = removed(texts)
    assert len(got) == len(texts)
    assert {i: v[:3] for i, v in got.items()} == dict(enumerate(want))
    assert got[9][3] is None


def test_substrings_of_equal_rows_and_empty_tables(spark):
    text = " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, "other")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in recompress.digests(df).collect()) == [(1, 40), (1, 40), (2, 0)]
    assert recompress.digests(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 2, 5, 35])
def test_equal_windows_are_filed_alike(size):
    r = random.Random(size)
    for voc in (1, 2, 3, 40, 2000):
        base = [r.randrange(voc) for _ in range(80)]
        docs = [[r.randrange(voc) for _ in range(r.randrange(9))] + base[r.randrange(20) : r.randrange(30, 80)] + [r.randrange(voc) for _ in range(r.randrange(90))] for _ in range(8)]
        flat = [w for d in docs for w in d]
        names = recompress.word_names({}, [b"%d" % w for w in flat])
        edge = np.append(0, np.cumsum([len(d) for d in docs]))
        p, under, _ = recompress.anchors(names, edge, size)
        assert len(p) == sum(max(0, len(d) - size + 1) for d in docs)
        filed, digest = {}, recompress.window_digests(names, size)
        for a, u in zip(p, under, strict=True):
            key = tuple(flat[a : a + size])
            assert filed.setdefault(key, (u, digest[a])) == (u, digest[a])
        assert len(set(filed.values())) == len(filed)


# Spelling


def counted(docs):
    seen = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                seen[w] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def variants(seen):
    near, holes = defaultdict(set), defaultdict(set)
    for w in seen:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            holes[i, rest].add(w)
            if rest in seen:
                near[w].add(rest)
                near[rest].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, n in seen.items():
        if near[w]:
            f = min(near[w], key=lambda v: (-seen[v], v))
            if seen[f] >= 10 * n:
                form[w] = f
    out = set()
    for w, n in seen.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), seen[form[w]] if w in form else None))
    return out


def spelled(r, n, alphabet, base):
    words = ["".join(r.choice(alphabet) for _ in range(r.randrange(6, 12))) for _ in range(base)]

    def typo(w):
        k, x = r.randrange(len(w) + 1), r.choice("abcé")
        return r.choice([w[:k] + x + w[k:], w[:k] + w[k + 1 :], w[:k] + x + w[k + 1 :]])

    rows = []
    for i in range(n):
        ws = [r.choice(words[: 1 + int(len(words) * r.random() ** 3)]) for _ in range(60)]
        rows.append((i if i % 20 else None, " ".join(typo(w) if r.random() < 0.15 else w.upper() if r.random() < 0.2 else w for w in ws)))
    return [*rows, (None, None), (7, ""), (8, " ".join(["x" * 3000, "x" * 3001] * 2))]


@pytest.mark.parametrize(("most", "task", "alphabet"), [(20_000, 60_000, "abcdefghij"), (40, 300, "ab"), (2, 60_000, "abcdefghij")])
def test_variants_equal_brute_force(spark, monkeypatch, most, task, alphabet):
    """The lower limits halve the shared parts again, down to single places."""
    monkeypatch.setattr(spelling, "MOST", most)
    monkeypatch.setattr(spelling, "TASK_ROWS", task)
    docs = spelled(random.Random(most), 150, alphabet, 100)
    got = spelling.group_variants(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string"))
    rows = [tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == variants(counted(docs))


def test_variants_chain_and_empty(spark):
    long = [("abcdefgh", 400), ("abcdefgx", 40), ("abcdefyx", 4), ("zzzzzzz", 2)]
    rows = [(i, w) for w, n in long for i in range(3 * n) if zlib.crc32(f"{i}:{w}".encode()) % 31][: 10**6]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.group_variants(df).collect()}
    assert got == {w: variants_of(counted(rows), w) for w in got}
    assert spelling.group_variants(df.limit(0)).collect() == []


def variants_of(seen, word):
    return next((x[1], x[2]) for x in variants(seen) if x[0] == word)


def test_suffix_ranks_find_every_word():
    words = ["banana", "bandana", "ananas", "nab"]
    size = np.array([len(w) for w in words])
    symbols = np.frombuffer("".join(words).encode(), np.uint8).astype(np.int64) - 96
    index = spelling.SuffixRanks(symbols, np.cumsum(size) - size, size)
    for i, w in enumerate(words):
        lo, hi = np.array([0]), np.array([index.delimiters])
        for c in [*reversed(w), None]:
            x = np.array([0 if c is None else ord(c) - 96])
            lo, hi = index.before(x, lo), index.before(x, hi)
        assert hi[0] - lo[0] == 1 and index.word[lo[0]] == i


# Conversations


def trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [v[2:] for v in sorted(vs)] for c, vs in own.items()}
    made = {c: turns.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + s[zlib.crc32(str(c).encode()) % 4 :] for c, s in turns.items()}
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, s in made.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids.update(k[:-1] for k in members if k)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(WORDS(k[-1][1])) if k else 0
            leaves[k[:d]] += not kids[k]
    ends = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(k)).encode()).hexdigest()
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items())


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def dialogues(kind):
    r = random.Random(6)
    if kind == "nulls":
        some = lambda *x: r.choice(x)
        return [(c, t if r.random() < 0.9 else None, some("u", "v", None), some("x y", "z", "q w e", None, "")) for c in [*range(1, 120), None] for t in range(r.randrange(1, 7))]
    if kind == "hot":
        return [(c, t, "u", "same turn") for c in range(100, 160) for t in range(5)] + [(7, t, "u", f"t{t % 3}") for t in range(700)] + [(c, t, "u", str(r.randrange(3))) for c in range(1000, 1060) for t in range(r.randrange(1, 20))]
    return {"empty": [], "one": [(1, 0, "u", "a b")], "turnless": [(21, 0, "u", "a"), (22, 0, "u", "b"), (23, None, None, None)]}[kind]


@pytest.mark.parametrize("shard", [4 << 20, 400])
@pytest.mark.parametrize("kind", ["empty", "one", "turnless", "nulls", "hot"])
def test_trie_equals_brute_force(spark, monkeypatch, shard, kind):
    monkeypatch.setattr(turntrie, "SHARD_BYTES", shard)
    monkeypatch.setattr(turntrie, "TURNS", 50)
    monkeypatch.setattr(turntrie, "IDS", 8)
    rows = dialogues(kind)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, depth string").repartition(3)
    assert Counter(tuple(x) for x in turntrie.prefix_nodes(turntrie.rebuilt(df)).select(*NODE).collect()) == trie(rows)


def test_double_array_finds_its_sequences():
    r = np.random.default_rng(8)
    seqs = sorted({tuple(r.integers(0, 9, r.integers(0, 12)).tolist()) for _ in range(400)})
    length = np.array([len(s) for s in seqs])
    packed = turntrie.DoubleArray(np.array([x for s in seqs for x in s]), np.cumsum(length) - length, length)
    for i, s in enumerate(seqs):
        nodes = packed.path(i)
        assert len(nodes) == len(s) + 1
        for above, node, label in zip(nodes, nodes[1:], s, strict=False):
            assert packed.base[above] + label == node and packed.check[node] == above
    assert len({int(packed.path(i)[-1]) for i in range(len(seqs))}) == len(seqs)
