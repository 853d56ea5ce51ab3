"""HTML text, quality, toxicity, SentencePiece and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from mnemora.llm import html_text, pieces, quality, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "a", "😀" * 3, "\0\1", "word " * 30000]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


PAGES = [
    ("<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav><article><h1>A &amp; B</h1><p>First  text,\nwith <b>bo</b>ld &#8212; here.<p>Second<br>line.</article><footer>&copy; me</footer>", "A & B First text, with bold — here. Second line."),
    ('<body><div class="cookie-notice"><p>We use cookies on this site to serve you.</p><button>OK</button></div><div class="content"><p>The main story of the day is told here.</p><p>It has an end.</p></div><div class="comments"><div class="comment"><p>I do not like this story at all.</p></div></div>', "The main story of the day is told here. It has an end."),
    ('<article><p>Some text. <script>if (a < b) { x("</p>"); }</script>More of it.</p><form><label>Mail</label><input></form><p>And an end.</p></article><aside><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></aside>', "Some text. More of it. And an end."),
    (None, ""), ("", ""), ("<", "<"), ("<p", ""), ("</div></p><!-- x", ""),
]


def test_html_text(spark):
    rows = spark.createDataFrame([(i, "u", h, "t") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extracted(rows, keep=("url",)).collect()}
    for i, (_, want) in enumerate(PAGES):
        if want != "<":
            assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), "u")
    assert html_text.extracted(rows.limit(0)).count() == 0


def test_html_on_held_out_pages():
    m, exact = html_text.default_model(), 0
    for p in html_text.labelled_pages(80, seed=123):
        nodes = html_text.in_order(html_text.parse(p))
        want = " ".join(n.text for n in nodes if n.text is not None and n.text.startswith(html_text.MARK)).replace(html_text.MARK, "").split()
        exact += "".join(want) == m.text(p.replace(html_text.MARK, "")).replace(" ", "")
    assert exact >= 70


def test_html_of_deep_and_long_pages():
    m = html_text.default_model()
    assert isinstance(m.text("<div>" * 20000 + "<p>deep text here.</p>"), str)
    long = "<article>" + "<p>A sentence of some length stands here.</p>" * 5000 + "</article>"
    assert m.text(long) == " ".join(["A sentence of some length stands here."] * 5000)


def test_marginals_are_exact():
    """Message passing gives what summing over all states gives."""
    m = html_text.default_model()
    nodes = html_text.in_order(html_text.parse('<div class="post"><p>Some words of a text.</p><a href=x>Link</a></div>'))
    html_text.observe(nodes)
    got = m.marginals(nodes)
    total, mass = 0.0, np.zeros(len(nodes))
    spot = {id(n): i for i, n in enumerate(nodes)}
    for code in range(3 ** len(nodes)):
        state = [code // 3**i % 3 for i in range(len(nodes))]
        p = 1.0
        for i, n in enumerate(nodes):
            b = m.potential(n.feats)
            p *= 0.0 if n.text is not None and state[i] == 2 else b[state[i]]
            if n.up:
                p *= m.trans[n.text is not None][state[spot[id(n.up)]]][state[i]]
        total += p
        mass += p * (np.array(state) == 1)
    assert np.allclose(got, mass / total)


def labelled(rng, n):
    out = []
    for i in range(n):
        bad = rng.random() < 0.3
        t = " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.choice('aeiou')}" for _ in range(rng.randint(8, 60)))
        y = rng.random() < 0.2
        if y:
            w = t.split()
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["vileword", "foulterm", "nastyism"]))
            t = " ".join(w)
        out.append((i, t.upper().replace(" ", "!! ") if bad else t, int(not bad), int(y)))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = labelled(random.Random(8), 700)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _, _ in rows] + [(10_000 + i, t, None, None, None) for i, t in enumerate(ODD)], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(99_999, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(30)))], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows


def test_quality(spark, tables):
    at, rows = tables
    got = {r.doc_id: r for r in quality.op7_quality_classifier(spark, at).collect()}
    assert len(got) == len(rows) + len(ODD)
    held = [(got[i].predicted, q) for i, _, q, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([a == b for a, b in held]) > 0.97
    assert got[10_000].score == got[10_001].score and all(0 <= r.score <= 1 for r in got.values())


def test_quality_votes_are_exact():
    rows = [(t, q) for _, t, q, _ in labelled(random.Random(9), 200)]
    m = quality.train(rows[:150])
    for t, _ in rows[150:]:
        sims = m.vector(quality.terms(t)) @ m.vectors.T
        near = np.flatnonzero(sims >= np.sort(sims)[-quality.K])
        w = np.maximum(sims[near], 0).astype(float) ** quality.POWER
        assert m.scores([t])[0] == pytest.approx((w * m.labels[near]).sum() / w.sum(), abs=1e-5)
    assert quality.train([]).scores(["a", None]).tolist() == [0.5, 0.5]


def test_quality_vectors_are_lexical():
    """Texts of other words have other vectors; the axes are the sample's leading singular vectors."""
    rows = [(t, q) for _, t, q, _ in labelled(random.Random(9), 90)]
    m = quality.train(rows)
    a, b = (m.vector(quality.terms(t)) for t in ("bani tela boru", "cilo tela boru"))
    assert abs(a - b).max() > 1e-3
    x = np.zeros((90, 1 << quality.BITS))
    for i, t in enumerate(sorted(t for t, _ in rows)):
        cols, vals = quality.terms(t)
        x[i, cols] = vals * m.idf[cols]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best = np.linalg.svd(x, compute_uv=False)
    assert np.linalg.norm(x @ m.axes) ** 2 > 0.99 * (best[: quality.RANK] ** 2).sum()


def test_quality_ties():
    """Labels that clash count as 1; the order of rows says nothing; equally near neighbours all vote."""
    rows = [("one two three", 0), ("one two three", 1), ("four five six", 0), ("seven eight", 1)]
    assert quality.train(rows).labels.tolist() == quality.train(rows[::-1]).labels.tolist() == [0.0, 1.0, 1.0]
    same = [(f"one two {c}", i % 2) for i, c in enumerate("abcdefgh")]
    m = quality.train(same)
    m.vectors[:] = m.vectors[0]
    assert m.scores(["one two x"])[0] == pytest.approx(0.5)


def test_training_rows(spark):
    """An id's and a text's largest label counts, each text comes once, and held-out ids never do."""
    rows = spark.createDataFrame([(1, "a", 5, 0), (2, "a", 5, 0), (2, "b", 5, 0), (3, "c", 5, 0), (None, "d", 5, 0)], "doc_id long, text string, y int, label int")
    labels = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, None), (None, 1), (8, 1)], "doc_id long, toxic int")
    got = toxicity.training_rows(rows, labels, "toxic", 10**9, -1, 10)
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 1)]
    assert toxicity.training_rows(rows, labels, "toxic", 1, 0, 10).count() == 0


def test_toxicity(spark, tables):
    at, rows = tables
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, at).collect()}
    held = [(got[i].predicted, x) for i, _, _, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert got[10_000].score == got[10_001].score < toxicity.REJECT
    assert all(got[10_000 + i].predicted == 0 for i in range(len(ODD)))
    assert toxicity.train([]).score("a")[0] == 0.0 and toxicity.train([("a", 1)]).score("b")[0] == 1.0


def test_maximal_segments():
    """The scan gives all maximal-scoring segments, as the definition does."""
    rng = random.Random(3)
    for n in [14] * 80 + [0, 1, 2]:
        x = [rng.choice([-1.0, -0.3, -1.5, 2.0, 3.5, 0.7]) for _ in range(n)]

        def split(a, b):
            best = max(((round(sum(x[i:j]), 9), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            return [] if best[0] <= 0 else split(a, best[2]) + [(best[2], best[3], best[0])] + split(best[3], b)

        got = toxicity.maximal(np.array(x))
        want = split(0, n)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want))
        assert max((s for *_, s in got), default=0) == pytest.approx(max((s for *_, s in want), default=0))
        assert [e > s and v == pytest.approx(sum(x[s:e])) for s, e, v in got] == [True] * len(got)
    assert len(toxicity.maximal(np.tile([1.0, -2.0], 50_000))) == 50_000  # linear, not quadratic


def test_log_odds_and_calibration():
    """Weights, parameters and scores against a plain computation over a small sample."""
    rng = random.Random(5)
    rows = [(" ".join([*rng.choices(["bad", "vile"], k=y * 3 + (not y and i % 3 == 0)), *rng.choices(["tea", "milk", "sun", "rain", "go"], k=6), f"w{i}"]), y) for i, y in enumerate([0, 0, 0, 1] * 30)]
    m = toxicity.train(rows)
    words = {y: [set(t.split()) for t, own in rows if own == y] for y in (0, 1)}
    every = set().union(*words[0], *words[1])
    count = {w: [sum(w in d for d in words[y]) for y in (0, 1)] for w in every}
    size, share = [sum(c[y] for c in count.values()) for y in (0, 1)], toxicity.PRIOR
    for w in every:  # no word here has 5 letters, so words are all tokens
        b, a = count[w]
        p, mass = share * (a + b), share * sum(size)
        odds = np.log((a + p) / (size[1] + mass - a - p)) - np.log((b + p) / (size[0] + mass - b - p))
        z = abs(odds) / np.sqrt(1 / (a + p) + 1 / (b + p))
        want = odds / (1 + (toxicity.Z_HALF / z) ** toxicity.SHARP) - toxicity.DRIFT
        assert m.of_words([w.encode()])[0] == pytest.approx(want, abs=1e-9)
    assert m.of_words([b"bad"])[0] > 0.5 and any(m.of_words([w.encode()])[0] < -toxicity.DRIFT for w in every)
    assert m.of_words([b"unknown"])[0] == -toxicity.DRIFT
    best = {t: max((x for *_, x in toxicity.maximal(m.of_words(toxicity.words_of(t)))), default=0.0) for t, _ in rows}
    clean = np.array([best[t] - np.log(len(t.split())) for t, y in rows if not y and best[t] > 0])
    assert m.lam == pytest.approx(min(2.0, np.pi / (clean.std() * 6**0.5)))
    score = {t: m.score(t)[0] for t, _ in rows}
    assert np.mean([score[t] for t, y in rows if y]) > 2 * np.mean([score[t] for t, y in rows if not y])
    text = "tea milk bad vile bad sun"
    bits = (m.lam * max(x for *_, x in toxicity.maximal(m.of_words(toxicity.words_of(text)))) - np.log(m.k * 6)) / np.log(2)
    assert m.score(text)[0] == pytest.approx(1 / (1 + np.exp(-(m.slope * bits + m.shift))))
    assert toxicity.train([("x bad", 0), ("x bad", 1), ("tea", 0)]).base == 0.5  # a text with both labels is toxic


def test_clashing_columns_repeats_and_empty_tables(spark, tables):
    """Columns named as inner ones are, repeated rows, and no rows, for the learnt operators and the encoder."""
    at, _ = tables
    now, labels = spark.read.parquet(f"{at}/documents.parquet").limit(60), spark.read.parquet(f"{at}/labels.parquet")
    odd = now.union(now).selectExpr("*", "1 as y", "2 as label", "3 as score", "4 as at", "5 as ids", "6 as decoded", "7 as spans", "8 as part")
    for op, sizes in ((quality, 1), (toxicity, 1)):
        model = op.fitted(odd, labels)
        got = op.scored(odd, model).collect()
        assert len(got) == 120 and len({(r.doc_id, r.score) for r in got}) == 60
        empty = op.fitted(odd.limit(0), labels)
        assert op.scored(odd.limit(0), empty).count() == 0 and len({r.score for r in op.scored(now, empty).collect()}) == 1
    assert toxicity.drop_toxic(odd, toxicity.fitted(odd, labels)).columns == odd.columns
    assert pieces.digested(odd).distinct().count() == 60 and pieces.encoded(odd).count() == 120


def test_pieces(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    rng = random.Random(2)
    texts = ODD + ["  a   b ", "a▁b ▁▁ c", "日本語 テスト", "http://a.b/c_d?e=1", " " * 40 + "x", "x" * 300, "½ ² ③ ǅ", "<s> </s> <0x0A> <unk>"]
    texts += ["".join(rng.choice("ab the e r\n.,é😀_1  日") for _ in range(80)) for _ in range(200)]
    got = {r.doc_id: r for r in pieces.digested(docs(spark, texts)).collect()}
    full = {r.doc_id: r for r in pieces.encoded(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_eos=True)
        assert (full[i].ids, full[i].decoded) == (ids, lib.decode(ids)), t
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert pieces.digested(docs(spark, [])).count() == 0


def test_pieces_of_one_long_chunk(monkeypatch):
    """A chunk of a megabyte is the library's, and the table of chunks stays within its bounds."""
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.default_path())
    monkeypatch.setattr(pieces, "HELD", 20_000)
    m, rng = pieces.Pieces(pieces.default_path()), random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(1 << 20))
    assert m.encode(long) == lib.encode(long, add_eos=True)
    for i in range(3000):
        m.encode(f"w{'q' * (i % 50)}x{i}z")
        assert m.held <= 20_000 + 200


def test_pipeline(spark, tables):
    from tests.llm.test_native_ops import brute_hits
    from tests.llm.test_pairs import brute

    at, _ = tables
    now = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.fitted(now, spark.read.parquet(f"{at}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in now.collect()]
    rows = [r for r in rows if model.score(r[1])[0] < toxicity.REJECT]
    last = {}
    for i, t in rows:
        key = bytes(t or "", "utf-8").lower()
        last[key] = max(i, last.get(key, i))
    rows = sorted((i, t) for i, t in rows if last[bytes(t or "", "utf-8").lower()] == i)
    rows = [r for k, (r, (_, root)) in enumerate(zip(rows, brute([t for _, t in rows]))) if root == k]
    item = [("a", " ".join(f"w{i}" for i in range(30)))]
    rows = [r for r, h in zip(rows, brute_hits([t for _, t in rows], item)) if not h[3]]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()}
    assert sorted(got) == [i for i, _ in rows]
    m = pieces.model(pieces.default_path())
    assert all(got[i].ids == m.encode(t or "") for i, t in rows)
    columns = now.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, at)
        assert now.columns == columns
