"""SentencePiece encoding and decoding for merge-type models, exactly as the library does it.

Encoding goes by backtracking. At each place of a chunk the longest piece found by an Aho-Corasick
automaton is tried first, then ever shorter ones; a piece may follow its predecessor only if merging
the two pieces' joint text again gives just these two (the checks are remembered). If none fits, the
place is marked in a bitfield of failed positions and the predecessor is taken back. A sequence all
of whose neighbours are compatible is the one that merging gives, so the result is exact.

A text is cut into chunks where no piece can reach across: before blanks, and between letters and
other characters. That this holds for the model is checked when it is loaded; a model that mixes them is cut
before blanks only. Chunks that start with several blanks, whose pieces may share a score, are merged
outright. Chunks' results are remembered in a table of bounded size.

The model file is only read; its path is a parameter, and each worker loads it once.

Defined results: a null text counts as empty; an empty text encodes to the end id alone and decodes
to an empty text; repeated rows give a row each; other columns are ignored unless asked for.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mnemora.llm.arrow import in_arrow
from mnemora.sources.tables import table

BLANK = "▁"
#: Most entries in a worker's tables of chunks and of pairs, and most characters in all that the first
#: holds; a table is emptied when full.
TABLE, PAIRS, HELD = 250_000, 400_000, 30_000_000


class Pieces:
    """A merge-type model: encode, decode, and digests over whole texts."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces and m.trainer_spec.byte_fallback):
            raise ValueError("a merge-type model with byte fallback, a leading blank and no normalisation is needed")
        self.texts = [p.piece for p in m.pieces]
        self.kinds = [p.type for p in m.pieces]
        self.scores = [p.score for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (1, 4, 5)}
        self.bytes = [0] * 256
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[1:-1], 16)] = i
        self.end = m.trainer_spec.eos_id
        alone = re.compile(f"{BLANK}*(?:[^\\W\\d_{BLANK}]+|[\\W\\d_]+)?")
        apart = all(alone.fullmatch(p) and BLANK not in p.lstrip(BLANK) for p in self.ids)
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece holds a blank after another character")
        rest = f"{BLANK}*[^\\W\\d_{BLANK}]+|{BLANK}*(?:[^\\w{BLANK}]|[\\d_])+|{BLANK}+"
        self.cut = re.compile(rest if apart else f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall
        self.pairs: dict[int, bool] = {}
        self.found: dict[str, tuple[int, str, str]] = {}
        self.held = 0
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) == 1 or self.merged(p) == [i]:  # a piece that merging never makes is left out
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.size = [len(p) for p in self.texts]
        #: The longest shorter piece that a piece starts with.
        self.shorter = [next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.automaton), -1) if p in self.automaton else -1 for p in self.texts]
        self.chars = frozenset(p for p in self.ids if len(p) == 1)
        self.listed = [f" {i}" for i in range(len(self.texts))]
        self.spaced = [p.replace(BLANK, " ") for p in self.texts]

    def bytes_of(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]

    def merged(self, text: str) -> list[int]:
        """Encode by merging: of all neighbours the best-scored, leftmost of equals, again and again."""
        parts: list[str] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (i := self.ids.get(parts[a] + parts[b])) is not None:
                heapq.heappush(queue, (-self.scores[i], a, b, parts[a] + parts[b]))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while queue:
            _, a, b, both = heapq.heappop(queue)
            if not parts[a] or not parts[b] or after[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b], after[a] = both, "", after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [i for p in parts if p for i in ([self.ids[p]] if p in self.ids else self.bytes_of(p))]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the texts of pieces a and b together gives a and b."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.texts[a] + self.texts[b]) == [a, b]
        return known

    def backtracked(self, chunk: str) -> list[int]:
        """Encode a chunk all of whose characters are pieces."""
        longest, size, shorter, pairs = [-1] * len(chunk), self.size, self.shorter, self.pairs
        for last, i in self.automaton.iter(chunk):
            longest[last - size[i] + 1] = i  # the longest comes last
        end, failed, pos, prior = len(chunk), 0, 0, -1
        taken: list[int] = []
        i = longest[0]
        while pos < end:
            while i >= 0:
                if not failed >> (pos + size[i]) & 1:
                    if prior < 0:
                        break
                    fits = pairs.get(prior << 32 | i)
                    if fits or fits is None and self.compatible(prior, i):
                        break
                i = shorter[i]
            if i >= 0:
                taken.append(i)
                pos += size[i]
                prior = i
                i = longest[pos] if pos < end else -1
            else:
                if not taken:
                    raise ValueError(f"no encoding of {chunk!r}")
                failed |= 1 << pos
                i = taken.pop()
                pos -= size[i]
                prior = taken[-1] if taken else -1
        return taken

    def encode_chunk(self, chunk: str) -> list[int]:
        if chunk[:2] == BLANK * 2:
            return self.merged(chunk)
        known, out, start = self.ids, [], 0
        for k, c in enumerate(chunk):
            if c not in known:
                out += (self.backtracked(chunk[start:k]) if k > start else []) + self.bytes_of(c)
                start = k + 1
        return out + self.backtracked(chunk[start:]) if start < len(chunk) else out

    def pieces_text(self, ids: list[int]) -> str:
        """The ids' text with blanks as spaces, byte ids joined to characters."""
        out, raw = [], bytearray()
        for i in ids:
            if self.kinds[i] == 6:
                raw.append(int(self.texts[i][1:-1], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if self.kinds[i] != 3:
                out.append(self.texts[i].replace(BLANK, " "))
        return "".join(out) + raw.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.pieces_text(ids).removeprefix(" ")

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, the ids each after a space, and what they decode to."""
        if len(self.found) >= TABLE or self.held >= HELD:
            self.forget()
        if chunk[:2] != BLANK * 2 and self.chars.issuperset(chunk):
            ids = self.backtracked(chunk)
            text = "".join([self.spaced[i] for i in ids])
        else:
            ids = self.encode_chunk(chunk)
            text = self.pieces_text(ids)
        r = (len(ids), "".join([self.listed[i] for i in ids]), text)
        if (size := len(chunk) + len(r[1]) + len(text)) < HELD // 100:
            self.found[chunk] = r
            self.held += size
        return r

    def forget(self) -> None:
        """Empty the table of chunks."""
        self.found.clear()
        self.held = 0

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        """What `chunk` gives for each chunk of a whole text."""
        if not text:
            return []
        get, new = self.found.get, self.chunk
        return [get(c) or new(c) for c in self.cut(BLANK + text.replace(" ", BLANK))]

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id last."""
        return [int(i) for p in self.parts(text) for i in p[1].split()] + [self.end]

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, and digests of the ids and of the decoded text."""
        p = self.parts(text)
        ids = "".join([x[1] for x in p]) + f" {self.end}"
        decoded = "".join([x[2] for x in p]).removeprefix(" ")
        return sum([x[0] for x in p]) + 1, hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()


@lru_cache(maxsize=2)
def model(path: str) -> Pieces:
    return Pieces(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids array<int> (the end id last) and the decoded text."""
    at = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(at)
        for b in batches:
            for a in range(0, b.num_rows, 64):  # lists of ids take many times a text's memory
                part = b.slice(a, 64)
                ids = [m.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])
        m.forget()  # a worker that waits for another task holds no table

    return docs.select(docs[id_col].alias("doc_id"), text_col).transform(in_arrow, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def digested(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    at = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(at)
        for b in batches:
            rows = [m.digests(t.as_py() or "") for t in b.column(1)]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        m.forget()

    return docs.select(docs[id_col].alias("doc_id"), text_col).transform(in_arrow, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"))
