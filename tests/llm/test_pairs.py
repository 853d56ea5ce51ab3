"""N-gram join, components and suffix-array dedup against brute force on small and odd tables."""

import hashlib
import random

import numpy as np
import pytest

from mnemora.llm import components, ngram_join, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, token string, node long, n int, kept string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "t", 7, 1, "k") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def cloud(rng, n=160, words=60):
    """Texts around one base, some linked to it and some not, and unrelated ones that share a line."""
    base = [f"b{i}" for i in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            t[rng.randrange(words)] = f"x{rng.randrange(40)}"
        out.append(" ".join(t))
    line = " ".join(f"l{i}" for i in range(9))
    out += [line + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 2, 3, 30]))) for _ in range(60)]
    return out


def brute(texts):
    sets = []
    for t in texts:
        w = bytes(t or "", "utf-8").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("block, guests, hot", [(1500, 3000, 10**6), (16, 24, 30)])
def test_linked_groups(spark, monkeypatch, block, guests, hot):
    for k, v in (("BLOCK", block), ("GUESTS", guests), ("HOT", hot)):
        monkeypatch.setattr(ngram_join, k, v)
    rng = random.Random(4)
    texts = cloud(rng) + [None, "", " \t", "one", "ONE", "one two", "One  two", "É a b c d", "é a b c d", "same words " * 20, "same words " * 20]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_groups(docs(spark, texts).repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert len({c for _, c in got.values()}) > 20
    left = ngram_join.drop_near_copies(docs(spark, texts))
    assert left.columns == docs(spark, texts).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in got.values()})


def test_linked_groups_of_odd_tables(spark):
    assert ngram_join.linked_groups(docs(spark, [])).count() == 0
    got = ngram_join.linked_groups(docs(spark, ["a b c d e f", "a b c d e f", None, "x"], [9, 9, 9, None])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("9", 0, "9"), ("9", 2, "9"), ("9", 2, "9"), ("None", 1, "None")]


def test_spanning_and_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets[:10]] for a in sets])
    assert (ngram_join.overlaps(sets[:10], sets) == want).all()


@pytest.mark.parametrize("one_task", [components.ONE_TASK, 0], ids=["one task", "stars"])
def test_components(spark, one_task):
    edges = [(i, i + 1) for i in range(1, 90)] + [(500, i) for i in range(501, 560)] + [(7, 7), (900, 899)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect())
    assert got == {i: 1 for i in range(1, 91)} | {i: 500 for i in range(500, 560)} | {899: 899, 900: 899}
    assert components.components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


def test_roots_in_one_task():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 40, (2, int(rng.integers(1, 60))))
        want = {int(x): int(x) for x in np.concatenate((a, b))}
        for _ in range(40):
            for x, y in zip(a.tolist(), b.tolist()):
                want[x] = want[y] = min(want[x], want[y])
        nodes, root = components.roots(a, b)
        assert dict(zip(nodes.tolist(), root.tolist())) == want


def test_the_order_of_the_sketch():
    """Rarer buckets come first; the sketch's size follows the number of documents within bounds."""
    assert [ngram_join.bits_for(n) for n in (0, 1000, 300_000, 10**10)] == [18, 18, 23, 24]


def brute_spans(texts, length, keep_first=False):
    seen, gone = {}, [np.zeros(len((t or "").encode()), bool) for t in texts]
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        for s in range(len(raw) - length + 1):
            seen.setdefault(raw[s : s + length], []).append((i, s))
    for places in seen.values():
        for i, s in places[keep_first:] if len(places) > 1 else []:
            gone[i][s : s + length] = True
    out = []
    if length == 256:
        return [int(g.sum()) for g in gone]
    for t, g in zip(texts, gone):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        out.append((len(raw), int(g.sum()), int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum()), hashlib.sha256(raw[~g].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("keep_first, hot", [(False, 50_000), (True, 50_000), (False, 3), (True, 3)])
def test_repeated_strings(spark, keep_first, hot):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(1000)) for _ in range(n))
    passage, other = words(120), "ßé😀\0" * 60
    texts = [words(rng.randrange(60)) + passage[rng.randrange(80) :] + words(rng.randrange(60)) for _ in range(14)]
    texts += [passage, passage, None, "", "x" * 399, "y" * 401, "for " * 300, "z" * 1200, other + words(90), words(30) + other, words(400), passage[:399]]
    texts += [passage[:300] + words(40), words(50) + passage[:300], passage[100:355]]
    rows = suffix_dedup.removed(docs(spark, texts), keep_first=keep_first, hot=hot).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute_spans(texts, 400, keep_first)
    assert [r.n_repeated for r in sorted(rows)] == brute_spans(texts, 256)
    assert suffix_dedup.removed(docs(spark, [])).count() == 0


def test_longest_previous_factors():
    """By previous and next smaller positions, as by comparing all suffixes."""
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randrange(1, 12)
        texts = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 9))) for _ in range(n))
        place = rng.sample(range(100), n)
        lcp = [0, *(suffix_dedup.common(a, b) for a, b in zip(texts, texts[1:]))]
        factor, source = suffix_dedup.previous_factors(place, lcp)
        for i in range(n):
            earlier = [suffix_dedup.common(texts[i], texts[j]) for j in range(n) if place[j] < place[i]]
            assert factor[i] == max(earlier, default=0)
            assert source[i] < 0 if not factor[i] else place[source[i]] < place[i] and suffix_dedup.common(texts[i], texts[source[i]]) == factor[i]


def test_intervals():
    """Each set of neighbours that agree in a places stands in one interval, for just these a."""
    rng = random.Random(8)
    for _ in range(40):
        lcp = [0, *(rng.randrange(6) for _ in range(rng.randrange(9)))]
        got = {(a, s, e) for s, e, least, last in suffix_dedup.intervals(lcp, 4) for a in range(least, last + 1)}
        want = set()
        for a in range(5):
            cuts = [0, *(t for t in range(1, len(lcp)) if lcp[t] < a), len(lcp)]
            want |= {(a, s, e) for s, e in zip(cuts, cuts[1:]) if e - s > 1}
        assert got == want


def test_anchors_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = random.Random(6)
    raw = bytes(rng.choice(b"abcd") for _ in range(5000))
    p, h = suffix_dedup.anchors(raw)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 19)
    q, k = suffix_dedup.anchors(raw)
    assert (p == q).all() and (h == k).all()
    width = suffix_dedup.WINDOW - suffix_dedup.SEED
    assert np.diff(p).max() <= width + 1 and p[0] <= width
