"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its bytes says so, so equal passages of different documents are cut alike.
Each task keeps a bounded store of chunks it has encoded; a chunk that comes again, in whatever document,
is taken from there. A chunk that is new is cut a second time, at its blanks, into pieces with a store of their own.
The stores are emptied when a task ends, so that a reused worker process holds no more than its tokenizer.

Joins are repaired: tokens next to a cut may differ from those of the uncut text. So the text around each cut, out to
the nearest blanks, is encoded anew as one seam, and the seam is widened by a blank on each side until its own join
agrees: encoding the widened seam equals the tokens that would be put together.

encode() gives the ids that the tokenizers library gives for the whole text; the tests compare them. Vocabularies that
keep blanks or do not mark the ends of words are refused: cutting at blanks would change their ids.

A null text counts as empty; repeated rows are encoded each and stay; a very long text is a batch of its own. Further
columns pass through (columns named ids or decoded are replaced).
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

GEAR = np.random.default_rng(20240601).integers(0, 2**32, 256, dtype=np.uint32)  # the table of the rolling hash
WINDOW_LOG2, CUT_BITS = 5, 9  # 32 bytes, a cut every 512 bytes
STORE_BYTES = 40_000_000  # of pieces, in each of two generations; chunks and seams have less
#: plain letters up to a blank or to closing marks before a blank, such marks, or else all up to a blank
PIECE = re.compile(rb"(?<![^ \n])[A-Za-z]+(?=[.,]*(?:[ \n]|\Z))|(?<=[A-Za-z])[.,]+(?=[ \n]|\Z)|[^ \n]+")
BATCH_BYTES = 1_000_000  # of text encoded together


class Store:
    """Two generations of entries: when the young one is full, the old one goes."""

    def __init__(self, limit: int) -> None:
        self.limit, self.young, self.old, self.size = limit, {}, {}, 0

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        self.update({key: value})

    def find(self, keys: dict) -> list:
        """Fill in what is known of the keys; the keys that are not."""
        keys.update(zip(keys, list(map(self.young.get, keys)), strict=True))
        gone = [k for k, v in keys.items() if v is None]
        if gone and self.old and (back := {k: v for k, v in zip(gone, map(self.old.get, gone), strict=True) if v is not None}):
            keys.update(back)
            self.update(back)
            gone = [k for k in gone if k not in back]
        return gone

    def update(self, entries: dict) -> None:
        self.size += sum(map(len, entries)) + sum([len(a) + len(b) for a, b in entries.values()]) + 300 * len(entries)
        self.young.update(entries)
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0


def cut_points(data: bytes, window_log2: int = WINDOW_LOG2, bits: int = CUT_BITS) -> list[int]:
    """Positions after which a text is cut, by a gear hash of the last 2**window_log2 bytes. Never inside a character."""
    b = np.frombuffer(data, dtype=np.uint8)
    h = GEAR[b]
    for k in range(window_log2):
        step = 1 << k
        if len(h) <= step:
            break
        h[step:] = h[step:] + (h[:-step] << np.uint32(step if step < 32 else 31))  # the right side is a copy
    at = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    if len(at) and at[-1] == len(b):
        at = at[:-1]
    return at[(b[at] & 0xC0) != 0x80].tolist()


class ChunkEncoder:
    """Encodes texts with one tokenizer, reusing chunks and pieces of earlier texts."""

    def __init__(self, path: str, store_bytes: int = STORE_BYTES) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.array([t.endswith(suffix) for t in self.tokens]) if suffix else None
        plain = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        if self.ends is None or plain(" a \n b ") != plain("a b"):
            raise ValueError(f"{path} keeps blanks or does not mark the ends of words")
        self.lower = plain("A") == plain("a")
        self.bare = self._bare(Tokenizer)
        self.store_bytes = store_bytes
        self.forget()

    def _bare(self, make):
        """A tokenizer for words of plain letters behind blanks: the model alone, if the steps before it leave such words as they are."""
        letters = string.ascii_lowercase if self.lower else string.ascii_letters
        first, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        for word in (letters, *letters):
            if first and first.normalize_str(word) != word or cut and [w for w, _ in cut.pre_tokenize_str(word)] != [word]:
                return self.tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        bare = make(self.tokenizer.model)
        bare.pre_tokenizer = WhitespaceSplit()
        return bare

    def forget(self) -> None:
        """Empty the stores."""
        self.chunks, self.pieces, self.seams = Store(self.store_bytes // 4), Store(self.store_bytes), Store(self.store_bytes // 8)

    def _direct(self, texts: list[bytes]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded) of each text."""
        plain = [t for t in texts if t.isalpha()]  # bytes: plain letters
        if len(plain) == len(texts):
            return self._words(plain) if plain else []
        out = dict(zip(plain, self._words(plain), strict=True)) if plain else {}
        rest = [t for t in texts if t not in out]
        for t, e in zip(rest, self.tokenizer.encode_batch_fast([t.decode() for t in rest], add_special_tokens=False), strict=True):
            ids = e.ids
            out[t] = array("I", ids).tobytes(), " ".join([self.tokens[i] for i in ids])
        return [out[t] for t in texts]

    def _words(self, words: list[bytes]) -> list[tuple[bytes, str]]:
        """Tokens of words of plain letters, encoded as one text; each word ends with a token that marks its end."""
        text = b" ".join(words)
        tokenizer = self.bare if not self.lower or text.islower() else self.tokenizer
        ids = np.asarray(tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(stops) != len(words):
            raise ValueError("this vocabulary does not mark the ends of words")
        raw, names, out, at = ids.tobytes(), [self.tokens[i] for i in ids.tolist()], [], 0
        for stop in stops:
            out.append((raw[4 * at : 4 * stop], " ".join(names[at:stop])))
            at = stop
        return out

    def _cached(self, texts: list[bytes], store: Store) -> list[tuple[bytes, str]]:
        found = dict.fromkeys(texts)
        if new := store.find(found):
            fresh = dict(zip(new, self._direct(new), strict=True))
            found.update(fresh)
            store.update(fresh)
        return list(map(found.__getitem__, texts))

    def _chunks(self, parts: list[bytes]) -> dict[bytes, tuple[bytes, str]]:
        """Tokens of chunks that begin and end at blanks or ends of texts; new ones from their pieces between blanks."""
        out = {p: self.chunks.get(p) for p in parts}
        new = [(p, self._split(p)) for p, v in out.items() if v is None]
        got, low = self._cached([w for _, words in new for w in words], self.pieces), 0
        for part, words in new:
            own = got[low : low + len(words)]
            low += len(words)
            out[part] = b"".join([g[0] for g in own]), " ".join([g[1] for g in own if g[1]])
            self.chunks.put(part, out[part])
        return out

    def _split(self, part: bytes) -> list[bytes]:
        """The pieces of a chunk: what stands between blanks, marks after a letter apart, plain words in lower case if the vocabulary has no other."""
        if self.lower and part.isascii() and b"<" not in part:  # no special token in it
            return PIECE.findall(part.lower())
        words = PIECE.findall(part)
        return [w.lower() if w.isalpha() and w.isascii() else w for w in words] if self.lower else words

    def _seams(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """For each text the spans around its cuts that must be encoded as one, so that what joins them agrees."""
        spans, tests = [], []
        for k, text in enumerate(texts):
            own, done = [], 0
            for at in cut_points(text):
                if at <= done:
                    continue
                start, stop = _before(text, at, done), _after(text, at, len(text))
                if start == at or stop == at:
                    start = stop = at  # a blank lies at the cut: the join is of two pieces
                own.append((start, stop))
                tests.append((k, len(own) - 1, *_widened(text, start, stop, done)))
                done = stop
            spans.append(own)
        strings = [texts[k][a:b] for k, _, left, start, stop, right in tests for a, b in ((left, start), (start, stop), (stop, right), (left, right))]
        got = iter(self._cached(strings, self.seams))
        for k, i, left, start, stop, right in tests:
            a, b, c, whole = next(got), next(got), next(got), next(got)
            while a[0] + b[0] + c[0] != whole[0]:
                text, low = texts[k], spans[k][i - 1][1] if i else 0
                start, stop = left, right
                left, _, _, right = _widened(text, start, stop, low)
                spans[k][i] = start, stop
                if start == low and stop == len(text):
                    break
                a, b, c, whole = self._cached([text[left:start], text[start:stop], text[stop:right], text[left:right]], self.seams)
        return spans

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of whole texts."""
        data = [t.encode() for t in texts]
        plans = []
        for text, spans in zip(data, self._seams(data), strict=True):
            plan, done = [], 0
            for start, stop in spans:
                if start >= done:
                    plan += [(False, text[done:start]), (True, text[start:stop])]
                elif stop > done:  # a widened seam has reached into this one
                    plan[-1] = (True, plan[-1][1] + text[done:stop])
                done = max(done, stop)
            plans.append([*plan, (False, text[done:])])
        chunks = self._chunks([part for plan in plans for seam, part in plan if not seam and part])
        seams = list(dict.fromkeys(part for plan in plans for seam, part in plan if seam and part))
        mended = dict(zip(seams, self._cached(seams, self.seams), strict=True))
        out = []
        for plan in plans:
            got = [(mended if seam else chunks)[part] for seam, part in plan if part]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])))
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        return self.encode_many([text])[0]


def _widened(text: bytes, start: int, stop: int, low: int) -> tuple[int, int, int, int]:
    """A span with one more piece between blanks on each side."""
    return _before(text, max(low, start - 1), low), start, stop, _after(text, min(len(text), stop + 1), len(text))


def _before(text: bytes, at: int, low: int) -> int:
    """The position after the last blank before `at`, or low."""
    return max(low, text.rfind(b" ", low, at) + 1, text.rfind(b"\n", low, at) + 1)


def _after(text: bytes, at: int, high: int) -> int:
    """The position of the first blank from `at` on, or high."""
    found = [x for x in (text.find(b" ", at, high), text.find(b"\n", at, high)) if x >= 0]
    return min(found, default=high)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this worker process; tasks empty its stores when they end."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _spans(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with about BATCH_BYTES of text."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        size += t.as_buffer().size if t.is_valid else 0
        if size >= BATCH_BYTES:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def encode_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", text: str = "text", digests: bool = False) -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit integers) and decoded (the text that the ids give).

    With digests, ids_sha256, n_tokens and decoded_sha256 take the place of text, ids and decoded.
    """
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    if digests:
        kept = [c for c in kept if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
        new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    else:
        new = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    schema = T.StructType([docs.schema[c] for c in kept] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(vocabulary))
        try:
            yield from coded(enc, batches)
        finally:
            enc.forget()

    def coded(enc: ChunkEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            for low, high in _spans(texts):
                got = enc.encode_many([t.as_py() or "" for t in texts[low:high]])
                if digests:
                    made = [pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([sha256(i).hexdigest() for i, _ in got], pa.string()), pa.array([sha256(d.encode()).hexdigest() for _, d in got], pa.string())]
                else:
                    made = [pa.array([i for i, _ in got], pa.binary()), pa.array([d for _, d in got], pa.string())]
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in columns), *made], names=[*kept, *(f.name for f in new)])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)
