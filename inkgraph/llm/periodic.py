"""Operator 12, runs of a repeated stretch of words, by the method of Gusfield and Stoye.

Lempel-Ziv blocks of a document give squares (stretches that stand twice in a row) among which is one at or before the first
occurrence of every square there is; these are walked to the right, one word at a time, by the suffix links of the suffix
tree, which finds the whole vocabulary of squares; the leaves below each entry are its occurrences, and occurrences at
neighbouring places merge into runs. The tree is read from a suffix array by doubling, whose ranks also tell how far two
places agree; only primitive squares are walked, since a run's smallest period is primitive."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, check_columns, read

by_value(__name__)
#: Least words of a run, and its least number of periods.
LEAST, TIMES = 12, 2
RUN = "struct<start:long,length:long,period:long>"


class Ranks:
    """For every power of two the rank of the stretch of that length at each place; a stretch that the end cuts is unlike all."""

    def __init__(self, x):
        import numpy as np

        self.n, self.levels, rank, step = len(x), [], x, 1
        pad = np.full(1, -1, dtype=np.int64)
        while True:
            self.levels.append(np.concatenate([rank, pad]))
            if rank.max() == self.n - 1:
                break
            later = np.concatenate([rank[step:] + 1, np.zeros(min(step, self.n), dtype=np.int64)])
            rank = np.unique(rank * (self.n + 2) + later, return_inverse=True)[1].astype(np.int64)
            step *= 2
        self.rank = rank
        self.order = np.empty(self.n, dtype=np.int64)
        self.order[rank] = np.arange(self.n)

    def ahead(self, a, b):
        """How many words agree from places a and b on; a and b differ and are n at most."""
        import numpy as np

        a, b, out = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            same = (self.levels[j][a] == self.levels[j][b]).astype(np.int64) << j
            a, b, out = a + same, b + same, out + same
        return out

    def back(self, a, b):
        """How many words agree up to and with places a and b, which differ and may be -1."""
        import numpy as np

        out = np.zeros(len(a), dtype=np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            s, t = a - out - (1 << j) + 1, b - out - (1 << j) + 1
            inside = (s >= 0) & (t >= 0)
            same = inside & (self.levels[j][np.maximum(s, 0)] == self.levels[j][np.maximum(t, 0)])
            out += same.astype(np.int64) << j
        return out


def blocks(r: Ranks) -> list[int]:
    """Starts of the Lempel-Ziv blocks: each is one word, or the longest stretch that also begins further left."""
    import numpy as np

    n, order = r.n, r.order
    before, after = list(range(-1, n)), list(range(1, n + 2))  # neighbours by rank among the places not yet removed
    left, right, ranks = [0] * n, [0] * n, r.rank.tolist()
    for i in range(n - 1, -1, -1):
        k = ranks[i]
        p, q = before[k], after[k]
        left[i], right[i] = p, q
        if p >= 0:
            after[p] = q
        before[q] = p
    left, right = np.array(left), np.array(right)
    places, longest = np.arange(n), np.zeros(n, dtype=np.int64)
    for side, ok in ((left, left >= 0), (right, right < n)):
        longest[ok] = np.maximum(longest[ok], r.ahead(places[ok], order[side[ok]]))
    starts, at, steps = [], 0, np.maximum(longest, 1).tolist()
    while at < n:
        starts.append(at)
        at += steps[at]
    return starts


def covering(r: Ranks):
    """(start, period) of primitive squares: for every square one of its period in whose run, at or right of it, is the first
    occurrence of that square. The right half of a first occurrence touches two blocks at most, so the periods to try at a
    block's start are few: three times the length of the document in all."""
    import numpy as np

    edges = np.array([*blocks(r), r.n, r.n])
    size = np.append(np.diff(edges), 0)
    h, last = edges[1:-1], size[:-2]
    reach = np.minimum(size[1:-1] + size[2:], r.n - h)
    on, off = counted(reach), counted(last)
    here, k = np.concatenate([np.repeat(h, reach), np.repeat(h, last) - off]), np.concatenate([on, off])
    ahead, back = r.ahead(here, here + k), r.back(here - 1, here + k - 1)
    ok = ahead + back >= k
    start, end, k = (here - back)[ok], (here + k + ahead)[ok], k[ok]
    by = np.lexsort((k, end, start))
    start, end, k = start[by], end[by], k[by]
    first = np.ones(len(k), dtype=bool)  # the least period of a stretch divides the others
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], k[first]


def counted(sizes):
    """1 to each of the sizes, one after another."""
    import numpy as np

    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


class Tree:
    """The suffix tree as intervals of the suffix array: inner nodes with depths, leaves by rank, edges by their first word."""

    def __init__(self, x, r: Ranks):
        import numpy as np

        n, order = r.n, r.order
        self.x, self.order, self.rank = x.tolist(), order.tolist(), r.rank.tolist()
        agree = r.ahead(order[:-1], order[1:]).tolist() if n > 1 else []
        # leaves are nodes 0 to n - 1 by rank, then inner nodes; the root is node n
        self.depth, self.low, self.high, self.up = [n - p for p in self.order], list(range(n)), list(range(n)), [n] * n
        self.add(0, 0)
        open_nodes, last = [n], 0
        for k in range(n):
            shared, child, low = agree[k - 1] if k else 0, None, k
            while self.depth[open_nodes[-1]] > shared:
                done = open_nodes.pop()
                self.high[done] = k - 1
                low, last = self.low[done], done
                if self.depth[open_nodes[-1]] >= shared:
                    self.up[done] = open_nodes[-1]
                    child = None
                else:
                    child = done
            if self.depth[open_nodes[-1]] < shared:
                node = self.add(shared, k - 1 if child is None else low)
                if child is not None:
                    self.up[child] = node
                else:
                    self.up[k - 1] = node
                open_nodes.append(node)
            self.up[k] = open_nodes[-1]
        while len(open_nodes) > 1:
            done = open_nodes.pop()
            self.high[done] = n - 1
            self.up[done] = open_nodes[-1]
        self.high[n] = n - 1
        nodes = np.array([v for v in range(len(self.depth)) if v != n])
        ups, lows = np.array(self.up)[nodes], np.array(self.low)[nodes]
        at = order[lows] + np.array(self.depth)[ups]
        ok = at < n  # a suffix that ends at an inner node has no further word
        self.child = dict(zip(zip(ups[ok].tolist(), x[at[ok]].tolist(), strict=True), nodes[ok].tolist(), strict=True))
        self.links: dict[int, int] = {n: n}

    def add(self, depth: int, low: int) -> int:
        self.depth.append(depth)
        self.low.append(low)
        self.high.append(low)
        self.up.append(len(self.depth) - 1)
        return len(self.depth) - 1

    def down(self, node: int, place: int, length: int) -> int:
        """The highest node at or below `node` with at least so many words of the suffix at place, which it begins."""
        while self.depth[node] < length:
            node = self.child[node, self.x[place + self.depth[node]]]
        return node

    def link(self, node: int) -> int:
        """The suffix link of an inner node: found from that of its parent, then kept."""
        chain = []
        while node not in self.links:
            chain.append(node)
            node = self.up[node]
        for v in reversed(chain):
            u = self.up[v]
            self.links[v] = self.down(self.links[u], self.order[self.low[v]] + 1, self.depth[v] - 1)
        return self.links[chain[0] if chain else node]

    def locus(self, place: int, length: int) -> int:
        """The highest node with so many words of the suffix at place, from the leaf up."""
        node = self.rank[place]
        while self.depth[self.up[node]] >= length:
            node = self.up[node]
        return node

    def vocabulary(self, starts, periods) -> set[tuple[int, int]]:
        """(node, period) of every square that rotations of the given ones reach; a walk ends at an entry that it finds."""
        found: set[tuple[int, int]] = set()
        for place, k in zip(starts.tolist(), periods.tolist(), strict=True):
            node, length = self.locus(place, 2 * k), 2 * k
            while (node, k) not in found:
                found.add((node, k))
                place = self.order[self.low[node]]
                above = self.down(self.link(self.up[node]), place + 1, length - 1)
                word = self.x[place]
                if self.depth[above] == length - 1:
                    node = self.child.get((above, word))
                    if node is None:
                        break
                elif self.x[self.order[self.low[above]] + length - 1] == word:
                    node = above
                else:
                    break
        return found


def runs_of(x, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a word sequence (numbers from 0 to their count, as an array), in order."""
    import numpy as np

    if len(x) < 2:
        return []
    r = Ranks(x)
    starts, periods = covering(r)
    if not len(starts):
        return []
    tree = Tree(x, r)
    entries = tree.vocabulary(starts, periods)
    wide = r.n + 2  # so that places of two periods are never neighbours
    keys = np.sort(np.concatenate([k * wide + r.order[tree.low[v] : tree.high[v] + 1] for v, k in entries]))
    edge = np.flatnonzero(np.diff(keys) != 1)
    first, last = keys[np.concatenate([[0], edge + 1])], keys[np.concatenate([edge, [len(keys) - 1]])]
    period, start = first // wide, first % wide
    length = last - first + 2 * period
    ok = length >= np.maximum(least, TIMES * period)
    return sorted(zip(start[ok].tolist(), length[ok].tolist(), period[ok].tolist(), strict=True))


def repeats(words: list[bytes], width: int) -> bool:
    """Whether any stretch of so many words may stand twice, by hashes: equal stretches always have equal ones."""
    import numpy as np

    n = len(words) - width + 1
    if n < 2:
        return False
    h, out = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64), np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = (out + h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out.sort()
    return bool((out[1:] == out[:-1]).any())


def numbers(words: list[bytes]):
    import numpy as np

    seen: dict[bytes, int] = {}
    x = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    return x


def found(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of `least` words or more. In such a run at least half of `least` words stand again a period later, so a
    document without a repeated stretch of that length has none and is not looked at further."""
    return runs_of(numbers(words), least) if len(words) >= least and repeats(words, least // TIMES) else []


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that a run holds after its first period."""
    import numpy as np

    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def periodic(docs: DataFrame, least: int = LEAST, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per document: its runs by start, then period, and its text without their repeats.

    Words are what stands between ASCII white space; a run has `least` words and two periods at least, and no neighbouring
    word extends it. A document is judged whole by one task, in memory in proportion to it. Null and empty texts, and those of
    white space, have no words, no runs and an empty collapsed text; repeated rows and null doc_ids are judged each for
    itself; an empty table gives none; other columns are not read. `change` may rewrite a document's words first."""
    check_columns(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string())
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                b, out = batch.slice(a, 256), []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    words = (text.as_py() or "").encode("utf-8").split()
                    words = change(doc_id, words) if change else words
                    runs = found(words, least)
                    left = b" ".join(collapsed(words, runs)).decode("utf-8")
                    out.append((len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], left))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<{RUN}>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the contract's documents: those whose number ends in 0 are made periodic from some place on; a null
    doc_id has no number and stays."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns: the run of greatest length (then smallest start, then period), and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    sha = lambda c: F.sha2(c, 256)
    length, period = F.col("best.length"), -F.col("best.period")
    named: list[Column] = [F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli")]
    return rows.withColumn("best", best).select("doc_id", *named, sha(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(periodic(read(spark, sf_dir, "documents"), change=planted))
