"""N-gram Jaccard self-join: rare-first prefix filtering, exact verification, linked groups.

A document is the set of its distinct n-word shingles (hashed to 64 bits). Documents with the same
set form a class, found by digest. A count sketch over all documents' shingles, whose size grows with
the number of documents, gives the global order: rare buckets first, by quarters of a power of two,
then by hash. If two sets' similarity reaches the threshold, their first n - ceil(t n) + 1 shingles in
this order share one, so only these prefixes are compared. Shingles that stand in one prefix only are
dropped, by exact counts of the prefixes' lists. Candidates pass the length filter and the positional
filter, a bound on how many shingles both prefixes must hold, then the suffix filter, and each pair
left is verified on the whole sets.

A large group of near copies would make all its pairs candidates, and many of them links. Only the
groups that links join are asked for, so pairs are never made as rows. First each document is
compared with one pivot, the first member of the prefix lists that it shares most (a star). Pairs
that are linked give groups; pairs of similarity 1/2 or more give families, which hold whole clouds of
near copies, linked or not. Then only families that hold different groups, or that share a prefix
shingle with another group's family, are looked at again: a family's documents are brought
together in blocks of at most BLOCK, with at most GUESTS of others at a time, and the exact overlaps of all
pairs in a block that pass the length filter are had from one matrix product; a pair of different
families stands in one block only. A block gives a spanning tree of its links.
No partner, candidate or row is capped, and no link that joins groups is lost.

Joins split skewed keys at run time; counts and minima combine on the map side; intermediate tables
are written to the shared folder. The sketch's ranks, a byte for each counter and 16 MB at most, are all
that the driver ever holds.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; shorter
texts than n words are one shingle; rows that repeat an id and a text share one result; an id with
different texts joins their groups in none but its own rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.llm.arrow import in_arrow
from mnemora.llm.components import components
from mnemora.sources.tables import table, text_digest, without, written

SHINGLE = 5
#: The threshold as a fraction.
NUM, DEN = 3, 4
#: Counters of the sketch: 2 to the power of bits_for(documents), between these.
LEAST_BITS, MOST_BITS = 18, 24
PARTS = 16
#: Most rows in what is broadcast of ids: 8 or 16 bytes each; beyond it the join is an ordinary one.
BROADCAST = 1_000_000
#: From this count of its bucket on, a shingle's list may be long, and is never brought to one task.
HOT = 1_000_000
SALT = 64
#: Documents of a family in one block, and others that are compared with it at a time.
BLOCK, GUESTS = 400, 800

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_blank = np.zeros(256, bool)
_blank[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word; `raw` is lower-cased UTF-8, words part at ASCII blanks."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate(([True], _blank[b], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
        return _mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(w):
        return w
    with np.errstate(over="ignore"):
        k = min(n, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):  # words' hashes are mixed already, so a sum with other factors will do
            h += w[i : len(w) - k + 1 + i] * (_MIX[2 + i % 5] + np.uint64(2 * (i // 5)))
        h = np.sort(_mixed(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def prefix_size(n: np.ndarray | int) -> np.ndarray | int:
    return n - (NUM * n + DEN - 1) // DEN + 1


def bits_for(documents: int) -> int:
    """The power of two of the sketch's counters: some sixteen for each document."""
    return min(MOST_BITS, max(LEAST_BITS, documents.bit_length() + 4))


def sets_and_sketch(docs: DataFrame, n: int = SHINGLE, bits: int = LEAST_BITS) -> DataFrame:
    """Per row doc_id, n, digest (part null), and per task PARTS rows with part and counts.

    Counts are pairs of a counter's place in its part and its count. A third column of `docs`,
    text_digest, is passed on.
    """
    more, width = docs.columns[2:], 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(width, np.uint32), [], 0

        def add() -> None:
            at, times = np.unique(np.concatenate(held), return_counts=True)
            counts[at.astype(np.int64)] += times.astype(np.uint32)
            held.clear()

        for b in batches:
            ids, sizes, digests = b.column(0).to_pylist(), [], []
            for t in b.column(1):
                s = shingles(t.as_py(), n)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                held.append((s & np.uint64(width - 1)).astype(np.uint32))
                size += len(s)
                if size > 1 << 20:
                    add()
                    size = 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary()), *b.columns[2:]], ["doc_id", "n", "digest", "part", "counts", *more])
        if held:
            add()
        some = [np.flatnonzero(x) for x in np.split(counts, PARTS)] if counts.any() else []
        blobs = [np.concatenate((at.astype(np.uint32), x[at])).tobytes() for at, x in zip(some, np.split(counts, PARTS))]
        k = len(blobs)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(blobs, pa.binary()), *[pa.nulls(k, pa.binary()) for _ in more]], ["doc_id", "n", "digest", "part", "counts", *more])

    return docs.transform(in_arrow, run, "doc_id long, n int, digest binary, part int, counts binary" + "".join(f", {c} binary" for c in more))


def sketch(found: DataFrame, bits: int = LEAST_BITS) -> np.ndarray:
    """The rank of each counter: four times the binary logarithm of the tasks' counts together, in a byte."""
    width = (1 << bits) // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1)):
                at, times = np.frombuffer(c.as_py(), np.uint32).reshape(2, -1)
                total.setdefault(k, np.zeros(width, np.int64))[at] += times
        ranks = [np.rint(4 * np.log2(np.maximum(v, 1))).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(ranks, pa.binary())], ["part", "ranks"])

    rows = found.where("part is not null").select("part", "counts").repartition(PARTS, "part").transform(in_arrow, run, "part int, ranks binary").collect()
    out = np.zeros((PARTS, width), np.uint8)
    for r in rows:
        out[r.part] = np.frombuffer(r.ranks, np.uint8)
    return out.reshape(-1)


def postings(docs: DataFrame, ranks: np.ndarray, n: int = SHINGLE) -> DataFrame:
    """(token, node, n, pos, hot) of every prefix shingle; within a task only the first of equal sets is a node.

    A shingle is hot if its bucket's count may be HOT or more; others stand in fewer sets than that.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    hot, last = int(4 * np.log2(HOT)), np.uint64(len(ranks) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, done = shared.value, set()
        held: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), *map(pa.array, cols[1:])], ["token", "node", "n", "pos", "hot"])

        size = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingles(t.as_py(), n)
                if not len(s) or i is None:
                    continue
                key = xxhash.xxh3_128_digest(s.tobytes())
                if key in done:
                    continue
                done.add(key)
                p = prefix_size(len(s))
                rank = order[(s & last).astype(np.int64)]
                first = np.argsort(rank, kind="stable")[:p]  # s is sorted, so equal ranks stay in the order of the hashes
                held.append([s[first], np.full(p, i, np.int64), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32), rank[first] >= hot])
                size += p
                if size > 100_000:
                    yield out()
                    size = 0
        if held:
            yield out()

    return docs.transform(in_arrow, run, "token long, node long, n int, pos int, hot boolean")


def _filters(a: str, b: str) -> F.Column:
    """The length filter, and the positional one: the overlap that two places still allow must suffice."""
    na, nb, pa_, pb = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    length = (DEN * F.least(na, nb) >= NUM * F.greatest(na, nb))
    most = F.least(pa_, pb) + 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return length & ((NUM + DEN) * most >= NUM * (na + nb))


def suffix_passes(a: np.ndarray, b: np.ndarray, need: int, depth: int = 3) -> bool:
    """The suffix filter: splitting both sorted sets at shared places bounds what they can share."""
    parts = [(a, b)]
    for _ in range(depth):
        split = []
        for x, y in parts:
            if not len(x) or not len(y):
                continue
            mid = y[len(y) // 2]
            i, j = np.searchsorted(x, mid), len(y) // 2
            split += [(x[:i], y[:j]), (x[i:], y[j:])]
        parts = split
        if sum(min(len(x), len(y)) for x, y in parts) < need:
            return False
    return True


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the ids in the one column of `ids`."""
    ids = written(ids.toDF("node").distinct(), "nodes")
    few = ids.count() <= BROADCAST
    return docs.withColumnRenamed("doc_id", "node").join(F.broadcast(ids) if few else ids, "node", "left_semi").select("node", "text")


def verified(pairs: DataFrame, docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """Those of the distinct pairs (a, b) whose similarity is at least 1/2, with `linked`: whether it reaches the threshold."""
    # texts are half as large as their sets of hashes
    texts = written(texts_of(pairs.select("a").union(pairs.select("b")), docs), "texts")
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("x")), texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    both = pairs.select("a", "b").join(left.hint("shuffle_merge"), "a").join(right.hint("shuffle_merge"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, str], np.ndarray] = {}

        def set_of(node: int, text: str) -> np.ndarray:
            if len(known) > 256:
                known.clear()
            return known.get((node, text)) if (node, text) in known else known.setdefault((node, text), shingles(text, n))

        for b in batches:
            keep, linked = [], []
            for i, j, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                x, y = set_of(i, x.as_py()), set_of(j, y.as_py())
                same = 0
                if suffix_passes(x, y, -(-(len(x) + len(y)) // 3)):
                    same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(2 * same >= len(x) + len(y) - same)
                linked.append(DEN * same >= NUM * (len(x) + len(y) - same))
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").transform(in_arrow, check, "a long, b long, linked boolean")


def overlaps(hosts: list[np.ndarray], guests: list[np.ndarray]) -> np.ndarray:
    """How many shingles each guest (row) shares with each host (column).

    Shingles of two hosts or more are columns of a matrix; those of one host are counted one by one.
    """
    out = np.zeros((len(guests), len(hosts)), np.int64)
    if len(hosts) * len(guests) <= 4:
        for g, x in enumerate(guests):
            for h, y in enumerate(hosts):
                out[g, h] = len(np.intersect1d(x, y, assume_unique=True))
        return out
    owner = np.repeat(np.arange(len(hosts)), [len(h) for h in hosts])
    words, first, at, times = np.unique(np.concatenate(hosts), return_index=True, return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)
    wide = int((times > 1).sum())
    single = owner[first]
    step = max(1, 8_000_000 // max(1, wide))
    many = column[at] >= 0
    rows = []
    for g, x in enumerate(guests):
        k = np.minimum(np.searchsorted(words, x), len(words) - 1)
        k = k[words[k] == x]
        rows.append(column[k][column[k] >= 0])
        np.add.at(out[g], single[k[column[k] < 0]], 1)
    for a in range(0, len(hosts), step):
        part = many & (owner >= a) & (owner < a + step)
        m = np.zeros((min(step, len(hosts) - a), wide), np.float32)
        m[owner[part] - a, column[at[part]]] = 1
        for c in range(0, len(guests), step):
            some = rows[c : c + step]
            q = np.zeros((len(some), wide), np.float32)
            q[np.repeat(np.arange(len(some)), [len(r) for r in some]), np.concatenate(some)] = 1
            out[c : c + step, a : a + step] += np.rint(q @ m.T).astype(np.int64)
    return out


def spanning(hosts: list[np.ndarray], guests: list[np.ndarray], inside: bool) -> np.ndarray:
    """For hosts and then guests, the number of the first of these that links join each to."""
    everyone = hosts + guests
    label = np.arange(len(everyone))
    if not hosts or len(everyone) < 2:
        return label
    others = everyone if inside else guests
    size = lambda sets: np.array([len(x) for x in sets], np.int64)
    sh, so = size(hosts), size(others)
    may = DEN * np.minimum(so[:, None], sh[None, :]) >= NUM * np.maximum(so[:, None], sh[None, :])  # the length filter
    linked = np.zeros(may.shape, bool)
    y, x = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if len(y) and len(x):
        same = overlaps([hosts[i] for i in x], [others[i] for i in y])
        linked[np.ix_(y, x)] = DEN * same >= NUM * (so[y][:, None] + sh[x][None, :] - same)
    start = 0 if inside else len(hosts)
    big = len(everyone)
    while True:
        old = label.copy()
        near = np.where(linked, label[: len(hosts)][None, :], big).min(1)
        label[start:] = np.minimum(label[start:], near)
        near = np.where(linked, label[start:][:, None], big).min(0)
        label[: len(hosts)] = np.minimum(label[: len(hosts)], near)
        label = np.minimum(label, label[label])
        if (label == old).all():
            return label


def joined(blocks: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) of spanning trees of the links in each block; rows are (key, host, inside, node, text)."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda r: not r[1])
        nodes, sets = [r[3] for r in held], [shingles(r[4], n) for r in held]
        k = sum(r[1] for r in held)
        label = spanning(sets[:k], sets[k:], held[0][2])
        edges = [(nodes[i], nodes[j]) for i, j in enumerate(label.tolist()) if nodes[i] != nodes[j]]
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if held and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    dealt = blocks.repartition("key").sortWithinPartitions("key").select("key", "host", "inside", "node", "text")
    return dealt.transform(in_arrow, run, "a long, b long")


def linked_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, digests: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id; with `digests` also text_digest."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    more = [text_digest(F.col("text")).alias("text_digest")] if digests else []
    bits = bits_for(docs.count())
    found = written(sets_and_sketch(docs.select("doc_id", "text", *more), n, bits), "sets")
    ranks = sketch(found, bits)
    rows = found.where("part is null").drop("part", "counts")
    reps = written(rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")

    # rows that aren't their class's first needn't be compared; more than can be broadcast are borne
    others = written(rows.join(reps, "digest").where("doc_id <> rep").select("doc_id").distinct(), "others")
    first = docs.join(F.broadcast(others), "doc_id", "left_anti") if others.count() <= BROADCAST else docs

    # lists of less than HOT nodes are counted and given a pivot for each length band in their own sort;
    # those that may be longer are dealt out by a salt, and counted by an aggregation
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM))).cast("int")
    salt = F.when(F.col("hot"), 1 + F.pmod(F.col("node"), F.lit(SALT))).otherwise(F.lit(0)).cast("int")
    list_ = Window.partitionBy("token", "salt")
    raw = postings(first, ranks, n).withColumn("salt", salt).withColumn("k", F.count(F.lit(1)).over(list_)).where("k > 1 or hot").drop("k")
    banded = raw.withColumn("band", band).withColumn("p", F.min(F.struct("node", "n", "pos")).over(Window.partitionBy("token", "salt", "band")))
    lists = written(banded.select("token", "hot", "band", F.struct("node", "n", "pos").alias("q"), "p"), "lists")

    # a star in each list and length band; hot lists' pivots are combined on the map side
    near = lists.where("not hot").select("q", "p")
    if lists.where("hot").limit(1).count():
        several = lists.where("hot").groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
        lists = written(lists.where("not hot").unionByName(lists.where("hot").join(several, "token").select(lists.columns)), "lists")
        pivots = lists.where("hot").groupBy("token", "band").agg(F.min("q").alias("p"))
        near = near.unionByName(lists.where("hot").select("token", "band", "q").join(pivots, ["token", "band"]).select("q", "p"))
    near = near.where((F.col("p.node") != F.col("q.node")) & _filters("p", "q"))
    # of a node's pivots the one it shares most lists with; what the others would link is left to the second step
    near = near.groupBy(F.col("p.node").alias("a"), F.col("q.node").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    tried = written(near.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a")).select("a", "b"), "pairs")
    near_pairs = written(verified(tried, docs, n), "links")
    links = near_pairs.where("linked")

    # nodes' classes; groups so far
    nodes = lists.select(F.col("q.node").alias("doc_id")).distinct()
    of = written(rows.where("n > 0").join(nodes, "doc_id", "left_semi").join(reps, "digest").select(F.col("doc_id").alias("node"), "rep").distinct(), "node-classes")

    def classed(pairs: DataFrame) -> DataFrame:
        a, b = of.select(F.col("node").alias("a"), F.col("rep").alias("ra")), of.select(F.col("node").alias("b"), F.col("rep").alias("rb"))
        return pairs.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))

    edges = classed(links)
    groups = written(components(edges), "groups")
    family = components(near_pairs).withColumnRenamed("root", "family")
    members = of.join(groups, of["rep"] == groups["node"], "left").select(of["node"], F.coalesce("root", "rep").alias("root"))
    members = members.join(family, "node", "left").select("node", "root", F.coalesce("family", "node").alias("family"))
    members = written(members, "members")
    families = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    families = written(families.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "families")

    # families that share a prefix shingle and aren't all in one group; bounds of their members take the filters' places
    member = F.broadcast(members) if members.count() <= BROADCAST else members
    seen = lists.join(member, lists["q.node"] == members["node"]).groupBy("token", "family")
    seen = seen.agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("q.n").alias("n0"), F.max("q.n").alias("n1"), F.max("q.pos").alias("pos"), F.max(F.col("q.n") - F.col("q.pos")).alias("left"))
    seen = written(seen, "seen")
    mixed = written(seen.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("k")).where("k > 1 and lo < hi").select("token"), "mixed")
    rest = written(seen.join(F.broadcast(mixed) if mixed.count() <= BROADCAST else mixed, "token"), "rest")
    one, two = rest.alias("p"), rest.alias("q")
    most = F.least(F.col("p.pos"), F.col("q.pos")) + F.least(F.col("p.left"), F.col("q.left"))
    could = (DEN * F.least(F.col("p.n1"), F.col("q.n1")) >= NUM * F.greatest(F.col("p.n0"), F.col("q.n0"))) & ((NUM + DEN) * most >= NUM * (F.col("p.n0") + F.col("q.n0")))
    met = one.join(two, F.col("p.token") == F.col("q.token")).where((F.col("p.family") < F.col("q.family")) & (F.least("p.lo", "q.lo") < F.greatest("p.hi", "q.hi")) & could)
    # Of the overlap that is needed, NUM / (NUM + DEN) of both sizes, at most NUM / DEN of the larger one
    # can lie behind the prefixes; so many shingles must be in both prefixes.
    met = met.groupBy(F.col("p.family").alias("f1"), F.col("q.family").alias("f2")).agg(F.count(F.lit(1)).alias("k"), F.min(F.least("p.n0", "q.n0")).alias("least"), F.max(F.greatest("p.n1", "q.n1")).alias("most"))
    inside_both = DEN * (NUM + DEN) * F.col("k") >= NUM * DEN * F.col("least") - NUM * NUM * F.col("most")
    met = written(met.where(inside_both).select("f1", "f2"), "met")

    # the larger family is the host; its own other blocks are guests too if it holds several groups
    size = families.select("family", "size", "blocks", "lo", "hi")
    left, right = size.select(F.col("family").alias("f1"), F.col("size").alias("s1")), size.select(F.col("family").alias("f2"), F.col("size").alias("s2"))
    met = met.join(left, "f1").join(right, "f2")
    first_hosts = (F.col("s1") > F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("f1") < F.col("f2")))
    met = met.select(F.when(first_hosts, F.col("f1")).otherwise(F.col("f2")).alias("host"), F.when(first_hosts, F.col("f2")).otherwise(F.col("f1")).alias("guest"))
    own = size.where("lo < hi").select(F.col("family").alias("host"), F.col("family").alias("guest"))
    # how many parts a host block's guests make follows from the families' sizes, so no count of rows is needed
    hosting = met.unionByName(own).join(size.select(F.col("family").alias("guest"), F.col("size").alias("n")), "guest")
    loads = hosting.groupBy("host").agg(F.ceil(F.sum("n") / GUESTS).cast("int").alias("parts"))
    hosts = loads.join(size.select(F.col("family").alias("host"), "blocks", (F.col("lo") < F.col("hi")).alias("inside")), "host")
    hosting = written(hosting.select("host", "guest").join(hosts, "host"), "hosting")
    placed = members.join(size.select("family", F.col("blocks").alias("own_blocks")), "family").select("family", "node", F.pmod(F.xxhash64("node"), F.col("own_blocks")).cast("int").alias("own_block"))
    key = lambda block, part: F.concat_ws(":", F.col("host").cast("string"), block.cast("string"), part.cast("string")).alias("key")
    guests = hosting.join(placed.withColumnRenamed("family", "guest"), "guest")
    guests = guests.select("host", "guest", "inside", "parts", "own_block", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).where("host <> guest or own_block > block")
    guest_rows = guests.select(key(F.col("block"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))), F.lit(False).alias("host"), "inside", "node")
    at_host = hosting.select("host", "inside", "parts").distinct().join(placed.withColumnRenamed("family", "host"), "host")
    host_rows = at_host.select("host", "inside", "node", "own_block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(key(F.col("own_block"), F.col("part")), F.lit(True).alias("host"), "inside", "node")
    block_rows = written(host_rows.unionByName(guest_rows), "blocks")
    texts = written(texts_of(block_rows.select("node"), docs), "texts")
    more = classed(written(joined(block_rows.join(texts.hint("shuffle_merge"), "node"), n), "links"))
    final = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    root = reps.join(final, reps["rep"] == final["node"], "left").select("digest", F.coalesce("root", "rep").alias("root"))
    return rows.join(root, "digest", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"), *(["text_digest"] if digests else []))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """`docs` without the rows whose group holds a smaller id; same columns."""
    gone = linked_groups(docs, id_col, text_col, n, True).where("component_id < doc_id")
    return without(docs, gone.select("doc_id", "text_digest"), id_col, text_digest(docs[text_col]))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {SHINGLE} - 1], ' ') AS t FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - {SHINGLE} + 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (WITH RECURSIVE g(doc_id, c) USING KEY (doc_id) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT l.a, min(g.c) FROM g JOIN l ON l.b = g.doc_id JOIN recurring.g o ON o.doc_id = l.a WHERE g.c < o.c GROUP BY l.a
) SELECT * FROM g)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id)
"""
