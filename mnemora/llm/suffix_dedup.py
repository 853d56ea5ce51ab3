"""Removal of repeated byte strings by bucketed suffix arrays and longest previous factors.

Two equal strings of WINDOW bytes share their anchor: the leftmost of the smallest hashes of the
SEED-byte strings in them. So the suffixes that start at anchors, put in buckets by their first SEED
bytes, hold every repeat of WINDOW bytes or more; about one byte in 97 is an anchor. Only the
WINDOW - SEED bytes before an anchor and the LENGTH bytes from it, its surroundings, matter.

Anchors whose surroundings are equal repeat in whole; they are found by counting digests (64 bits
beside the bucket's own 64), with map-side combining, and only one of each kind goes on. In each
bucket that is left with two kinds or more, the suffix array of the kinds is built from their bytes:
they are sorted by what follows the anchor, and, in a second order, by what precedes it, backwards. Kinds
that agree in the a bytes before the anchor are an interval of the second order, and such intervals are
a tree, as common prefixes go. For each interval the suffixes that start up to a bytes before the
anchor stand in the order of what follows; a stack finds each one's previous and next smaller
position there, and with them its longest previous factor (Crochemore and Ilie 2008) and the earlier
match that it comes from. Where the factor reaches LENGTH, the later copy is removed. With keep_first
that is all; without it the earlier match, and so in the end the first copy, goes too.

`n_repeated` counts, beside what is removed, all bytes in strings of WINDOW bytes or more that also
start elsewhere, first copies included: passages of some 40 words and more, which LENGTH may exceed.

Buckets with more than HOT kinds (a passage in very many different surroundings) are never gathered:
their strings are counted by digests of 128 bits in an aggregation instead, in which every string of a
bucket meets its copies.

Defined results: null and empty texts have nothing to remove; texts shorter than LENGTH bytes lose
nothing; matches never cross documents; repeated rows need ids of their own (rows of one id are
taken as copies of each other only if their texts are equal, and get the same spans); other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.arrow import in_arrow
from mnemora.llm.ngram_join import BROADCAST, _mixed, _power
from mnemora.sources.tables import table, written

LENGTH = 400
#: Repeats of so many bytes are found, and anchors are chosen in strings of this size.
WINDOW = 256
SEED = 64
#: Most kinds of a bucket that one task takes: about 600 bytes each.
HOT = 50_000
#: Long texts are searched for anchors in pieces of so many bytes, which overlap by a string.
PIECE = 1 << 19
_LOW = np.uint64((1 << 20) - 1)


def seed_hashes(b: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the `seed` bytes from each place on."""
    up, down = _power(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
        return _mixed((total[seed:] - total[:-seed]) * down[: len(b) - seed + 1])


def anchors(raw: bytes, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a whole text."""
    places, hashes, width = [], [], window - seed + 1
    for at in range(0, max(1, len(raw) - window + 1), PIECE):
        b = np.frombuffer(raw, np.uint8)[at : at + PIECE + window - 1]
        if len(b) < window:
            break
        h = seed_hashes(b, seed)
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        fill = -len(key) % width
        grid = np.concatenate((key, np.full(fill, ~np.uint64(0)))).reshape(-1, width)
        before = np.minimum.accumulate(grid, axis=1).reshape(-1)
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        n = len(b) - window + 1
        least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
        p = np.unique(least & _LOW).astype(np.int64)
        places.append(p + at)
        hashes.append(h[p])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first]


def anchor_rows(docs: DataFrame, length: int, window: int, seed: int) -> DataFrame:
    """(h, ctx, doc_id, pos, lo, hi): an anchor, its surroundings' digest, place and bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size = ["h", "ctx", "doc_id", "pos", "lo", "hi"], [], 0

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            return pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if len(raw) < window or i is None:
                    continue
                p, h = anchors(raw, window, seed)
                lo, hi = np.maximum(0, p - (window - seed)), np.minimum(len(raw), p + length)
                ctx = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y], q - x) for q, x, y in zip(p.tolist(), lo.tolist(), hi.tolist())), np.uint64, len(p))
                held.append([h.view(np.int64), ctx.view(np.int64), np.full(len(p), i, np.int64), p, lo, hi])
                size += len(p)
                if size > 50_000:
                    yield out()
                    size = 0
        if held:
            yield out()

    return docs.transform(in_arrow, run, "h long, ctx long, doc_id long, pos long, lo long, hi long")


def _with_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """`docs` joined with `lists` (doc_id, at), `inner` or `left`.

    Only ids are ever broadcast, and only if they are counted to be at most BROADCAST: they keep the
    texts without a list out of the join, which deals out the others by id.
    """
    lists = written(lists, "lists")
    if lists.count() > BROADCAST:
        return docs.join(lists.hint("shuffle_merge"), "doc_id", how).select("doc_id", "text", "at")
    ids = F.broadcast(lists.select("doc_id"))
    mine = docs.join(ids, "doc_id", "left_semi").join(lists.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "at")
    if how == "inner":
        return mine
    return mine.unionByName(docs.join(ids, "doc_id", "left_anti").select("doc_id", "text", F.lit(None).cast(lists.schema["at"].dataType).alias("at")))


def surroundings(docs: DataFrame, kinds: DataFrame, length: int, window: int, seed: int) -> DataFrame:
    """(h, c, doc_id, pos, left, right) of the kinds' first anchors; left is backwards."""
    wanted = kinds.groupBy("doc_id").agg(F.collect_list(F.struct("h", "c", "pos")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "c", "doc_id", "pos", "left", "right"]
        for b in batches:
            rows: list[tuple] = []
            for i, t, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                for x in at.as_py():
                    lo, hi = max(0, x["pos"] - (window - seed)), min(len(raw), x["pos"] + length)
                    rows.append((x["h"], x["c"], i, x["pos"], raw[lo : x["pos"]][::-1], raw[x["pos"] : hi]))
                if len(rows) > 2000:
                    yield _batch(rows, names)
                    rows = []
            if rows:
                yield _batch(rows, names)

    return _with_lists(docs, wanted, "inner").transform(in_arrow, run, "h long, c long, doc_id long, pos long, left binary, right binary")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"left": pa.binary(), "right": pa.binary(), "gone": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for c, n in zip(zip(*rows) if rows else [()] * len(names), names)], names)


def common(a: bytes, b: bytes) -> int:
    """How many bytes a and b have in common at their start."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def previous_factors(place: list[int], lcp: list[int]) -> tuple[list[int], list[int]]:
    """The longest previous factor of each suffix and the suffix of smaller place it comes from (-1: none).

    Suffixes are in suffix order; lcp[t] is the common prefix of t - 1 and t. The suffix below t on the
    stack is its previous smaller position, and what takes t from the stack is its next smaller one.
    """
    n = len(place)
    factor, source = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []  # a suffix and its common prefix with the one below it
    for t in range(n + 1):
        own = lcp[t] if 0 < t < n else 0
        while stack and (t == n or place[stack[-1][0]] > place[t]):
            top, before = stack.pop()
            if t < n and own > before:
                factor[top], source[top] = own, t
            elif before:
                factor[top], source[top] = before, stack[-1][0]
            own = min(own, before)
        if t < n:
            stack.append((t, own))
    return factor, source


def intervals(lcp: list[int], most: int) -> Iterator[tuple[int, int, int, int]]:
    """The tree of intervals (start, end, least, last) of an order: at least two neighbours that agree in `last` places, all of them within an interval that agrees in fewer than `least`."""
    todo = [(0, len(lcp), 0)]
    while todo:
        s, e, least = todo.pop()
        if e - s < 2 or least > most:
            continue
        inner = lcp[s + 1 : e]
        last = min(inner)
        yield s, e, least, min(last, most)
        at = [s, *(s + 1 + k for k, x in enumerate(inner) if x == last), e]
        todo += [(x, y, last + 1) for x, y in zip(at, at[1:]) if y - x > 1]


def repeats(left: list[bytes], right: list[bytes], place: list[int], lengths: list[tuple[int, bool]], most: int) -> list[list[tuple[int, int] | None]]:
    """For each (length, keep_first) and suffix of one bucket: how many bytes before its anchor the first and the last repeated string start.

    `place` orders the suffixes by document and place; `most` is how far before an anchor strings start.
    """
    n = len(right)
    by_right, by_left = sorted(range(n), key=right.__getitem__), sorted(range(n), key=left.__getitem__)
    rank = [0] * n
    for r, i in enumerate(by_right):
        rank[i] = r
    found: list[list[tuple[int, int] | None]] = [[None] * n for _ in lengths]

    def mark(to: list, i: int, near: int, far: int) -> None:
        to[i] = (min(near, to[i][0]), max(far, to[i][1])) if to[i] else (near, far)

    least = min(k for k, _ in lengths)
    for s, e, first, last in intervals([0, *(common(left[i], left[j]) for i, j in zip(by_left, by_left[1:]))], most):
        own = sorted(by_left[s:e], key=rank.__getitem__)
        lcp = [0, *(common(right[i], right[j]) for i, j in zip(own, own[1:]))]
        if max(lcp) + last < least:
            continue
        factor, source = previous_factors([place[i] for i in own], lcp)
        for to, (length, keep_first) in zip(found, lengths):
            for t, x in enumerate(factor):
                near = max(first, length - x)
                if source[t] >= 0 and near <= last:
                    mark(to, own[t], near, last)
                    if not keep_first:
                        mark(to, own[source[t]], near, last)
    return found


SPAN = ["doc_id", "s", "e", "gone"]
_SPAN = "doc_id long, s long, e long, gone boolean"


def compared(rows: DataFrame, keep_first: bool, length: int, window: int, seed: int) -> DataFrame:
    """(doc_id, s, e, gone) around the first anchors of kinds, by their buckets' suffix arrays.

    `gone` spans are removed; the others hold strings of `window` bytes or more that start elsewhere too.
    """

    def solve(held: list[tuple]) -> list[tuple]:
        _, _, doc, pos, left, right = zip(*held)
        place = [0] * len(held)
        for r, i in enumerate(sorted(range(len(held)), key=lambda i: (doc[i], pos[i]))):
            place[i] = r
        gone, seen = repeats(left, right, place, [(length, keep_first), (window, False)], window - seed)
        out = []
        for i, row in enumerate(held):
            if gone[i] and (keep_first or row[1] == 1):
                out.append((doc[i], pos[i] - gone[i][1], pos[i] - gone[i][0] + length, True))
            if seen[i]:
                out.append((doc[i], pos[i] - seen[i][1], pos[i] - seen[i][0] + window, False))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6))):
                if held and row[0] != held[-1][0]:
                    out += solve(held)
                    held = []
                    if len(out) > 10_000:
                        yield _batch(out, SPAN)
                        out = []
                held.append(row)
        yield _batch(out + (solve(held) if held else []), SPAN)

    return rows.repartition("h").sortWithinPartitions("h").select("h", "c", "doc_id", "pos", "left", "right").transform(in_arrow, run, _SPAN)


def counted(rows: DataFrame, keep_first: bool, length: int, window: int, seed: int) -> DataFrame:
    """(doc_id, s, e) of strings of `length` bytes in buckets that are too large to gather, by counting their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for h, c, doc, pos, left, right in zip(*(b.column(i).to_pylist() for i in range(6))):
                raw = left[::-1] + right
                for a in range(len(left) + 1):
                    if a <= window - seed and length - a <= len(right):
                        x = len(left) - a
                        d = xxhash.xxh3_128_digest(raw[x : x + length])
                        out.append((h ^ int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), c, doc, pos, a))
                if len(out) > 20_000:
                    yield _batch(out, ["w1", "w2", "c", "doc_id", "pos", "a"])
                    out = []
            if out:
                yield _batch(out, ["w1", "w2", "c", "doc_id", "pos", "a"])

    strings = written(rows.select("h", "c", "doc_id", "pos", "left", "right").transform(in_arrow, run, "w1 long, w2 long, c long, doc_id long, pos long, a long"), "strings")
    # a string may lie around several anchors of its bucket: it counts once for each place where it starts
    strings = strings.withColumn("at", F.col("pos") - F.col("a")).dropDuplicates(["w1", "w2", "doc_id", "at"])
    many = strings.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("doc_id", "at")).alias("first")).where("k > 1")
    hit = strings.join(many, ["w1", "w2"])
    hit = hit.where(F.struct("doc_id", "at") != F.col("first")) if keep_first else hit.where("c = 1")
    return hit.groupBy("doc_id", "pos").agg(F.max("a").alias("far"), F.min("a").alias("near")).select("doc_id", (F.col("pos") - F.col("far")).alias("s"), (F.col("pos") - F.col("near") + length).alias("e"))


def spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, s, e, gone): byte spans that are removed, or repeated; they may overlap. `docs` has doc_id long and text."""
    window = min(WINDOW, length)
    seed = max(1, min(SEED, window // 4))
    found = written(anchor_rows(docs, length, window, seed), "anchors")
    kinds = found.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "pos", "lo", "hi")).alias("at"))
    buckets = kinds.groupBy("h").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds")).where("n > 1")
    kinds = written(kinds.join(buckets, "h").select("h", "ctx", "c", "kinds", "at.*"), "kinds")
    whole = found.join(kinds.where("c > 1").select("h", "ctx", F.col("doc_id").alias("d1"), F.col("pos").alias("p1")), ["h", "ctx"]).where(F.col("hi") - F.col("lo") >= window)
    goes = F.col("hi") - F.col("lo") >= length
    if keep_first:
        goes = goes & ((F.col("doc_id") != F.col("d1")) | (F.col("pos") != F.col("p1")))
    around = written(surroundings(docs, kinds.where("kinds > 1").select("h", "c", "doc_id", "pos"), length, window, seed).join(kinds.where("kinds > 1").groupBy("h").agg(F.max("kinds").alias("kinds")), "h"), "around")
    parts = whole.select("doc_id", F.col("lo").alias("s"), F.col("hi").alias("e"), goes.alias("gone")).unionByName(compared(around.where(F.col("kinds") <= hot), keep_first, length, window, seed))
    if around.where(F.col("kinds") > hot).limit(1).count():
        large = around.where(F.col("kinds") > hot)
        parts = parts.unionByName(counted(large, keep_first, length, window, seed).withColumn("gone", F.lit(True)))
        parts = parts.unionByName(counted(large, False, window, window, seed).withColumn("gone", F.lit(False)))
    return parts


def merged(at: list[dict]) -> list[tuple[int, int]]:
    """Maximal spans of sorted ones that overlap or touch."""
    out: list[tuple[int, int]] = []
    for x in at:
        if out and x["s"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["e"]))
        else:
            out.append((x["s"], x["e"]))
    return out


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated and kept (the bytes that stay)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    each = spans(docs, length, keep_first, hot=hot).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("s", "e", "gone"))).alias("at"))
    all_ = _with_lists(docs, each, "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw, every = (t.as_py() or "").encode("utf-8", "surrogatepass"), at.as_py() or []
                gone = merged([x for x in every if x["gone"]])
                edges = [0, *(x for g in gone for x in g), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                rows.append((i, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), sum(e - s for s, e in merged(every)), kept))
            cols = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return all_.select("doc_id", "text", "at").transform(in_arrow, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents")).drop("kept")
