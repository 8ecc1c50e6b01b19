"""Groups of spelling variants, by a two-way FM-index over the delimited vocabulary and search schemes of one error.

Two words are near if one insertion, deletion or replacement of a code point makes one of the other. Let l be the
length of the shorter one: the first place where they differ lies in either half of it, and they share the other half
exactly. So a word goes, for l its own length and one less, to the task that has its first half's words and
to the one that has its last half's. There the words form one delimited text, indexed by the ranks of its
suffixes; a query matches the shared half exactly, from the delimiter, and extends across the other, allowing one error:
leftwards in the index of the words, rightwards in that of the reversed words. Each interval of suffix
ranks that ends at the other delimiter is one word.

The first difference decides in which half a pair counts, so each pair counts once and numbers of near words add up:
pairs are never shuffled. A half that too many words share is halved again: the error then lies in one of two quarters,
and all but that quarter is shared; and so on down to single places, where an alphabet bounds what words can share.

Edge cases: null, empty and blank texts have no words; a null id counts as an empty one; repeated rows count each;
other columns are left out; an empty table has no words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import LOWER, UPPER, checked, durable

#: Words have so many code points, and occur so often, at least.
LETTERS, LEAST, FACTOR = 7, 2, 10
#: One in so many runs loses a code point.
DAMAGED = 31
#: Words that may share what is matched exactly before it is refined; rows of a task; rows that are broadcast at most.
MOST, TASK_ROWS, BROADCAST_ROWS = 20_000, 60_000, 500_000
_FOUND = "word string, n_near long, form string, form_n long"


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words with LETTERS code points and LEAST occurrences."""
    # A run with fewer letters can't become a word.
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[A-Za-zÀ-ÿ]{{{LETTERS},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    size = F.char_length("run")
    cut = (F.col("h") % size).cast("int")
    word = F.when(F.col("h") % DAMAGED == 0, F.concat(F.substr("run", F.lit(1), cut), F.substr("run", cut + 2))).otherwise(F.col("run"))
    return low.select(word.alias("word")).where(F.char_length("word") >= LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)


def _routed(rows: DataFrame) -> DataFrame:
    """rows (word, n, l, b, e) with route: a hash of all that is shared if the error lies in [b, e) of a word of length l."""
    word, before, after = F.col("word"), F.substr("word", F.lit(1), F.col("b")), F.col("l") - F.col("e")
    tail = F.when(after > 0, F.substr(word, F.char_length(word) - after + 1)).otherwise("")
    return rows.withColumn("route", F.xxhash64("l", "b", "e", before, F.lit("|"), tail))


def _halves(l: Column, b: Column, e: Column) -> Column:
    mid = F.floor((b + e) / 2).cast("int")
    return F.array(F.struct(l.alias("l"), b.alias("b"), mid.alias("e")), F.struct(l.alias("l"), mid.alias("b"), e.alias("e")))


def routes(words: DataFrame) -> DataFrame:
    """(route, word, n, l, b, e): where each word is looked for and found."""
    size = F.char_length("word")
    shorter = F.when(size > LETTERS, F.array(size, size - 1)).otherwise(F.array(size))
    rows = words.select("word", "n", F.explode(shorter).alias("l")).select("word", "n", F.inline(_halves(F.col("l"), F.lit(0), F.col("l"))))
    rows, done = _routed(rows), None
    while True:
        crowded = rows.where("e - b > 1").groupBy("route").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > MOST).select("route")
        crowded = durable(crowded, "crowded")
        if crowded.isEmpty():
            return rows if done is None else done.unionByName(rows)
        crowded = checked(crowded, BROADCAST_ROWS)
        rest = rows.join(crowded, "route", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        finer = rows.join(crowded, "route", "left_semi").select("word", "n", F.inline(_halves(F.col("l"), F.col("b"), F.col("e"))))
        rows = durable(_routed(finer), "finer")


class SuffixRanks:
    """Index of distinct words, each followed by a delimiter (symbol 0), read as a circle.

    words: their symbols from 1 on, one after the other; start and size: where each begins and how long it is."""

    def __init__(self, words: np.ndarray, start: np.ndarray, size: np.ndarray):
        n = len(words) + len(start)
        begin = start + np.arange(len(start))
        text = np.zeros(n, np.int64)
        text[np.arange(len(words)) + np.repeat(np.arange(len(start)), size)] = words
        rank, width, at = text, 1, np.arange(n)
        while True:
            pair = rank * (n + 1) + rank[(at + width) % n]
            order = np.argsort(pair, kind="stable")
            new = np.append(0, np.diff(pair[order]) != 0)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            width *= 2
            if new[1:].all():
                break
        self.n, self.symbols = n, int(text.max()) + 1
        self.last = text[order - 1]
        places = np.argsort(self.last, kind="stable")
        self._keys = self.last[places] * (n + 1) + places
        self.delimiters = len(start)
        # The word after the delimiter that a suffix begins with.
        owner = np.full(n, -1, np.int64)
        owner[begin - 1] = np.arange(len(start))
        self.word = owner[order]

    def before(self, symbol: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Rank of the first suffix that is the symbol and a suffix of at least this rank."""
        return np.searchsorted(self._keys, symbol * (self.n + 1) + rank)

    def extensions(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, symbol) of the symbols that stand before the suffixes of each interval; of a large interval, all symbols."""
        wide = hi - lo > 2 * self.symbols
        i = np.flatnonzero(~wide)
        size = hi[i] - lo[i]
        of = np.repeat(i, size)
        x = self.last[np.repeat(lo[i] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())] if len(i) else of
        near = np.unique(of * self.symbols + x)
        far = (np.flatnonzero(wide)[:, None] * self.symbols + np.arange(self.symbols)).ravel()
        both = np.append(near, far)
        both = both[both % self.symbols > 0]
        return both // self.symbols, both % self.symbols


def search(index: SuffixRanks, symbols: np.ndarray, end: np.ndarray, size: np.ndarray, exact: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of all words at one error from each query, read from its end: the error comes after ``exact``
    symbols, and leaves the last ``rest`` ones alone. A pair may come twice.

    symbols: of all queries; end: behind each query's last symbol; size: its length."""
    n = len(end)
    q, lo, hi = np.arange(n), np.zeros(n, np.int64), np.full(n, index.delimiters)
    empty = np.empty(0, np.int64)
    one = (empty, empty, empty, empty)  # query, what remains of it, interval: after the error
    out = []
    t = 0
    while len(q) or len(one[0]):
        if len(one[0]):
            # After the error all is exact, to the delimiter.
            w, left, a, b = one
            c = np.where(left > 0, symbols[np.maximum(end[w] - size[w] + left - 1, 0)], 0)
            a, b = index.before(c, a), index.before(c, b)
            ok = a < b
            w, left, a, b = w[ok], left[ok], a[ok], b[ok]
            done = left == 0
            out.append((w[done], index.word[a[done]]))
            one = (w[~done], left[~done] - 1, a[~done], b[~done])
        if len(q):
            left = size[q] - t
            new = [one]
            free = np.flatnonzero((exact[q] <= t) & (left >= rest[q]))
            if len(free):
                i, x = index.extensions(lo[free], hi[free])
                i = free[i]
                a, b = index.before(x, lo[i]), index.before(x, hi[i])
                ok = a < b
                i, x, a, b = i[ok], x[ok], a[ok], b[ok]
                new.append((q[i], left[i], a, b))
                other = (left[i] > rest[q[i]]) & (x != symbols[np.maximum(end[q[i]] - t - 1, 0)])
                new.append((q[i[other]], left[i[other]] - 1, a[other], b[other]))
                skip = free[left[free] > rest[q[free]]]
                new.append((q[skip], left[skip] - 1, lo[skip], hi[skip]))
            one = tuple(np.concatenate(x) for x in zip(*new, strict=True))
            # An interval of one suffix is the query itself.
            go = left > rest[q]
            q, lo, hi = q[go], lo[go], hi[go]
            c = symbols[end[q] - t - 1]
            lo, hi = index.before(c, lo), index.before(c, hi)
            go = hi - lo > 1
            q, lo, hi = q[go], lo[go], hi[go]
        t += 1
    return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (empty, empty)


def near_words(word: list[str], n: np.ndarray, route: np.ndarray, l: np.ndarray, b: np.ndarray, e: np.ndarray) -> tuple[list, list, list, list]:
    """Columns of _FOUND for the rows of a task: each row's near words among those of its route."""
    _, back, many = np.unique(route, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(many[back] > 1)
    left = (b == 0) | (l - e >= b)
    hits: dict[str, list] = {}
    for leftwards in (True, False):
        own = rows[left[rows] == leftwards]
        if not len(own):
            continue
        # Distinct words, their symbols in the direction of the search, and each row's word.
        distinct = {w: i for i, w in enumerate(dict.fromkeys(word[i] for i in own))}
        names = list(distinct)
        w = np.array([distinct[word[i]] for i in own])
        count = np.zeros(len(names), np.int64)
        count[w] = n[own]
        size = np.array([len(x) for x in names])
        codes = np.frombuffer("".join(x if leftwards else x[::-1] for x in names).encode("utf-32-le"), np.uint32)
        alphabet, symbols = np.unique(codes, return_inverse=True)
        symbols = symbols.astype(np.int64) + 1
        start = np.cumsum(size) - size
        index = SuffixRanks(symbols, start, size)
        exact, rest = (l[own] - e[own], b[own]) if leftwards else (b[own], l[own] - e[own])
        q, v = search(index, symbols, (start + size)[w], size[w], exact, rest)
        pair = np.unique(q * len(names) + v)
        q, v = pair // len(names), pair % len(names)
        mine = w[q]
        # The pair counts where its first difference lies.
        short = np.minimum(size[mine], size[v])
        first, on, k = np.zeros(len(q), np.int64), np.arange(len(q)), 0
        forwards = symbols if leftwards else symbols[np.repeat(2 * start + size - 1, size) - np.arange(len(symbols))]
        while len(on):
            on = on[k < short[on]]
            on = on[forwards[start[mine[on]] + k] == forwards[start[v[on]] + k]]
            k += 1
            first[on] = k
        at, end, length = b[own][q], e[own][q], l[own][q]
        ok = (short == length) & (first >= at) & ((first < end) | (first == length) & (end == length))
        for a, c in zip(mine[ok].tolist(), v[ok].tolist(), strict=True):
            hits.setdefault(names[a], []).append((-int(count[c]), names[c]))
    best = {w: min(x) for w, x in hits.items()}
    return list(hits), [len(x) for x in hits.values()], [best[w][1] for w in hits], [-best[w][0] for w in hits]


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words (word, n) that have near words; form is the one of largest n, ties to the smallest."""
    rows = routes(words)
    tasks = max(1, math.ceil(4 * words.count() / TASK_ROWS))
    schema = to_arrow_schema(StructType.fromDDL(_FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            found = near_words(t["word"].to_pylist(), *(t[c].to_numpy().astype(np.int64) for c in ("n", "route", "l", "b", "e")))
            yield from pa.table([pa.array(x, f.type) for x, f in zip(found, schema, strict=True)], schema=schema).to_batches(20_000)

    found = rows.select("route", "word", "n", "l", "b", "e").repartition(tasks, "route").mapInArrow(run, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select("word", "n_near", F.col("_best.w").alias("form"), (-F.col("_best.m")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of the words (word, form) that have a form: the last of the chain of forms. Chains double at each round."""
    links = links.select("word", F.col("form").alias("root"))
    while True:
        # Forms that have a root themselves; most don't, and many words share a form.
        on = durable(links.select("root").distinct().join(links.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root"), "forms")
        if on.isEmpty():
            return links
        links = durable(links.join(checked(on, BROADCAST_ROWS), "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of docs."""
    words = durable(vocabulary(docs, doc_id, text), "vocabulary")
    formed = F.col("form_n") >= FACTOR * F.col("n")
    each = durable(words.join(near(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")), "variants")
    ends = roots(each.where("form IS NOT NULL"))
    return each.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
