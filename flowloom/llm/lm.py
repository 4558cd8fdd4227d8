"""Language-model scoring: a causal self-attention model on subword ids, trained in numpy on Spark's tasks.

Texts: A-Z in lower case, words, then one end. The units of the model are subword ids: those of a public byte-level
vocabulary for the word after a blank, and one id of its own for each word that makes up at least one in OWN_PARTS of the
training tokens; so these are OWN_PARTS at most, by a rule that is alike at every size. Ids can be put back together, so the
probability of the ids bounds that of the words from below. Texts are cut into ids once, after words are counted; training
and scoring take the ids.

Model: see attention.py. Its tables are counted over all training ids: how often each id stands in windows of each group, how
often pieces follow pieces (pairs that make up at least one in PAIR_PARTS), which roles follow an id. Its attention is trained
on windows that cover every training document, so that each id is a target once. In each of ROUNDS rounds, tasks start from the
same weights, take steps on their windows of this round, and Spark averages what they end with: one pass over all windows.

Scoring: targets come in blocks of STRIDE; each block sees a window of WINDOW tokens that overlaps the one before, and
each token is scored once. Many windows are computed together under one causal mask.

Base: the unigram model of words with add-half counts. Counts of words that have ids go to the tasks as a table; those of the
other words are joined by a 64-bit hash of the word.

Nulls: a null text is empty, so it has its end only; a null doc_id counts as the empty string for the split. Repeated
rows are scored each, equal texts alike. Very long texts are scored whole, in blocks of windows. Without training documents N is
0 and ids are equally likely. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh64_intdigest
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm import attention
from flowloom.llm.attention import GROUPS, LEADERS, NONE, STRIDE, WINDOW, Gate, Tables, Trainer
from flowloom.llm.support import written

ROUNDS, TASK_WINDOWS = 3, 36_000
OWN_PARTS, PAIR_PARTS, WORD_STORE = 500_000, 1_000_000, 300_000
READ_BYTES, WORDS_BYTES = 2_000_000, 16_000_000  # of text at once
SCORED_AT_ONCE, READ_AT_ONCE, OPENED_AT_ONCE, COUNTED_AT_ONCE, ROWS_AT_ONCE = 128, 64, 512, 4096, 50_000
READ = "doc_id long, n_tokens long, hot_known long, hot_sum double, rare binary, ids binary"
SEGMENT = 32  # windows in a row


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than 20 and 09 to 0D, which is where bytes are split."""
    return (text or "").encode().lower().split()


def _word_hashes(many: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64 gives for the words."""
    return np.fromiter(map(xxh64_intdigest, many, repeat(42)), dtype=np.uint64, count=len(many)).view(np.int64)


class Subwords:
    """ids of words; the end has the first free id."""

    def __init__(self, vocabulary: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.lengths, self.begins = np.zeros(self.end, dtype=np.int64), np.zeros(self.end, dtype=bool)
        for token, rank in ranks.items():
            self.lengths[rank], self.begins[rank] = len(token), token.startswith(b" ")

    def of(self, word: bytes) -> list[int]:
        return self.encoding.encode_ordinary(" " + word.decode())

    def many(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each word has.

        Words behind single blanks are encoded in one call: a piece starts at every blank before a word, so each word gets
        the ids that it has alone. Only whitespace beyond ASCII inside words could join them; then they are encoded singly.
        """
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        text = (b" " + b" ".join(found)).decode()
        if len(text.split()) == len(found):
            ids = self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            stops = np.cumsum(self.lengths[ids])
            ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
            last = np.searchsorted(stops, ends)
            if last[-1] < len(stops) and np.array_equal(stops[last], ends):
                return ids, np.diff(last, prepend=-1)
        single = [self.of(w) for w in found]
        return np.fromiter(chain.from_iterable(single), dtype=np.int64), np.fromiter(map(len, single), dtype=np.int64, count=len(single))


_SUBWORDS: dict[str, Subwords] = {}


def subwords(vocabulary: str) -> Subwords:
    if vocabulary not in _SUBWORDS:
        _SUBWORDS[vocabulary] = Subwords(vocabulary)
    return _SUBWORDS[vocabulary]


# ---- what the corpus gives


def _runs(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Texts, nulls as empty ones, in runs of about so many bytes; a longer text is a run of its own."""
    texts = pc.fill_null(texts, "")
    at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
    yield from (texts.slice(low, high - low) for low, high in zip(edges[:-1], edges[1:], strict=True) if high > low)


def _split(texts: pa.Array) -> pa.ListArray:
    """words() of texts without nulls, and empty strings where texts begin or end with blanks."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(n, word): words with their counts, several rows for a word. The empty one counts the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _runs(batch.column(0), WORDS_BYTES):
                found, n = pc.value_counts(_split(texts).flatten()).flatten()
                word = pc.not_equal(found, "")
                found, n = pa.concat_arrays([found.filter(word), pa.array([""])]), pa.concat_arrays([n.filter(word), pa.array([len(texts)])])
                yield pa.RecordBatch.from_arrays([n, found.cast(pa.binary())], names=["n", "word"])

    return docs.select("text").mapInArrow(run, "n long, word binary")


def _read(docs: DataFrame, vocabulary: str, own_ids: Broadcast, logs: Broadcast) -> DataFrame:
    """READ of the documents (doc_id, text). logs: what a word adds to the base, for ids of words.

    ids: see packed. rare: hashes of the words without an id, then their counts, in 64 bits each; hot_known and hot_sum: how many the others are, and their base.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention.keep_freed()
        store = Words(Units(vocabulary, own_ids.value))
        for batch in batches:
            low = 0
            for texts in _runs(batch.column(1), READ_BYTES):
                yield coded(store, batch.column(0).slice(low, len(texts)), texts)
                low += len(texts)

    def coded(store: Words, doc_id: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        ends, at, size, ids = store.read(texts)
        starts, stops = np.concatenate([[0], ends[:-1]]), np.cumsum(size)[ends - 1].tolist()
        own = store.own.values[at]
        hot = own >= 0
        sums = np.add.reduceat(np.where(hot, logs.value[np.maximum(own - store.units.sub.end - 1, 0)], 0) if len(logs.value) else np.zeros(len(at)), starts)
        cold = np.flatnonzero(~hot)
        rare, n = np.unique(np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[cold] * len(store.known) + at[cold], return_counts=True)
        hashes, edges = store.hashes.values[rare % len(store.known)], np.searchsorted(rare, np.arange(len(ends) + 1) * len(store.known)).tolist()
        lists = [hashes[low:high].tobytes() + n[low:high].tobytes() for low, high in zip(edges[:-1], edges[1:], strict=True)]
        parts = [packed(ids[low:high]) for low, high in zip([0, *stops[:-1]], stops, strict=True)]
        return pa.RecordBatch.from_arrays(
            [doc_id, pa.array(ends - starts), pa.array(np.add.reduceat(hot.astype(np.int64), starts)), pa.array(sums), pa.array(lists, pa.binary()), pa.array(parts, pa.binary())],
            names=["doc_id", "n_tokens", "hot_known", "hot_sum", "rare", "ids"],
        )

    return docs.select("doc_id", "text").mapInArrow(run, READ)


def _rare(read: DataFrame) -> DataFrame:
    """(row, h, n) of the words without an id in READ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, OPENED_AT_ONCE):
                part = batch.slice(low, OPENED_AT_ONCE)
                found = [np.frombuffer(d, np.int64).reshape(2, -1) for d in part.column(1).to_pylist()]
                rows = np.repeat(part.column(0).to_numpy(), [f.shape[1] for f in found])
                h, n = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(h), pa.array(n)], names=["row", "h", "n"])

    return read.select("row", "rare").mapInArrow(run, "row long, h long, n long")


def packed(ids: np.ndarray) -> bytes:
    """Ids in three bytes each: the two low ones of all, then the high ones."""
    return ids.astype("<u2").tobytes() + (ids >> 16).astype(np.uint8).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 3
    return np.frombuffer(data, "<u2", n).astype(np.int64) | np.frombuffer(data, np.uint8, n, 2 * n).astype(np.int64) << 16


def _id_counts(read: DataFrame, size: int) -> DataFrame:
    """(id, n): how often each of `size` ids stands in READ, several rows for an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, OPENED_AT_ONCE):
                total += np.bincount(np.concatenate([unpacked(d) for d in batch.column(0).slice(low, OPENED_AT_ONCE).to_pylist()]), minlength=size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return read.select("ids").mapInArrow(run, "id long, n long")


def _windows(docs: DataFrame, vocabulary: str, own_ids: Broadcast) -> DataFrame:
    """The windows of documents (doc_id, text), as _cut gives them."""
    spark = docs.sparkSession
    return _cut(_read(docs, vocabulary, own_ids, spark.sparkContext.broadcast(np.zeros(len(own_ids.value)))), subwords(vocabulary).end + 1 + len(own_ids.value))


def _cut(read: DataFrame, start: int) -> DataFrame:
    """(r, ids): rows of up to SEGMENT windows of WINDOW + 1 ids of READ. r: a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, READ_AT_ONCE):
                yield windows_of(batch.slice(low, READ_AT_ONCE))

    def windows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, numbers, parts = [], [], []
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            table = attention.windows_of(unpacked(data), start).astype("<i4")
            for at in range(0, len(table), SEGMENT):
                keys.append(key)
                numbers.append(at)
                parts.append(table[at : at + SEGMENT].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], names=["key", "n", "ids"])

    return read.select("doc_id", "ids").mapInArrow(run, "key long, n int, ids binary").select(F.xxhash64("key", "n", "ids").alias("r"), "ids")


def _in_parts(batches: Iterator[pa.RecordBatch], windows: int) -> Iterator[np.ndarray]:
    """The windows of rows of ids, about so many at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, step := max(1, windows // SEGMENT)):
            data = b"".join(batch.column(0).slice(low, step).to_pylist())
            yield np.frombuffer(data, dtype="<i4").reshape(-1, WINDOW + 1).astype(np.int64)


class Units:
    """Words as ids: frequent words by an id of their own, after those of the vocabulary."""

    def __init__(self, vocabulary: str, own: dict[int, int]) -> None:
        self.sub, self.own = subwords(vocabulary), own
        self.size = self.sub.end + 1 + len(own)

    def many(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words one after another; of each word how many they are, its hash, and whether it has an id of its own. Empty: the end."""
        hashes = _word_hashes(found)
        owned = np.fromiter(map(self.own.get, hashes.tolist(), repeat(-1)), dtype=np.int64, count=len(found))
        own = owned >= 0
        spelt = ~own & (np.fromiter(map(len, found), dtype=np.int64, count=len(found)) > 0)
        pieces, lengths = self.sub.many(list(compress(found, spelt.tolist())))
        sizes = np.ones(len(found), dtype=np.int64)
        sizes[spelt] = lengths
        ids = np.full(sizes.sum(), self.sub.end, dtype=np.int64)
        ids[(np.cumsum(sizes) - 1)[own]] = owned[own]
        ids[np.repeat(spelt, sizes)] = pieces
        return ids, sizes, hashes, own


def _groups(windows: DataFrame, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each id's leader (the commonest ids are leaders), and the group of each leader."""
    leader = np.full(len(counts) + 2, LEADERS, dtype=np.int64)
    leading = np.argsort(-counts, kind="stable")[:LEADERS]
    leader[leading] = np.arange(len(leading))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention.keep_freed()
        total = np.zeros((LEADERS, LEADERS))
        for part in _in_parts(batches, COUNTED_AT_ONCE):
            x = (attention.leaders_in(part[:, 1:], leader) > 0).astype(np.float32)
            total += x.T @ x
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "n"])

    together = np.zeros((LEADERS, LEADERS))
    for r in windows.select("ids").mapInArrow(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # pairs of leaders
        together[r["i"], r["j"]] = together[r["j"], r["i"]] = r["n"]
    return leader, attention.group_leaders(together)


def _tables(windows: DataFrame, counts: np.ndarray, role: np.ndarray) -> Tables:
    """The model's tables, from counts over all windows."""
    leader, groups = _groups(windows, counts)
    ids, names = len(role), [f"g{g}" for g in range(GROUPS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention.keep_freed()
        counts = attention.Counts(leader, groups, role)

        def rows(kind: int, keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            for low in range(0, len(keys), ROWS_AT_ONCE):
                part = values[low : low + ROWS_AT_ONCE].astype(np.float64)
                columns = [np.full(len(part), kind, dtype=np.int32), keys[low : low + ROWS_AT_ONCE], *(part[:, g] if g < part.shape[1] else np.zeros(len(part)) for g in range(GROUPS))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", *names])

        for part in _in_parts(batches, COUNTED_AT_ONCE):
            counts.add(part)
            if counts.full():
                yield from rows(1, *counts.pairs())
        found = np.flatnonzero(counts.by_group.any(0))
        yield from rows(0, found, counts.by_group[:, found].T)
        yield from rows(1, *counts.pairs())
        follows = counts.follows.reshape(ids, attention.ROLES)
        after = np.flatnonzero(follows.any(1))
        yield from rows(2, after, follows[after])

    sums = windows.select("ids").mapInArrow(run, "kind int, key long, " + ", ".join(f"{g} double" for g in names))
    sums = written(sums.groupBy("kind", "key").agg(*(F.sum(g).alias(g) for g in names)).withColumn("n", sum(F.col(g) for g in names)), "lm_tables")
    all_pairs = sums.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    # rows for ids, which are bounded, and for pairs that make up one in PAIR_PARTS of them
    kept = sums.where((F.col("kind") != 1) | ((F.col("n") >= 1.5) & (F.col("n") * PAIR_PARTS >= all_pairs))).drop("n").toArrow()
    kind, key = kept["kind"].to_numpy(), kept["key"].to_numpy()
    values = np.stack([kept[g].to_numpy() for g in names], axis=1)
    by_group, follows = np.zeros((ids, GROUPS)), np.zeros((ids, attention.ROLES))
    by_group[key[kind == 0]] = values[kind == 0]
    follows[key[kind == 2]] = values[kind == 2][:, : attention.ROLES]
    order = np.argsort(key[kind == 1])
    return Tables.of(role, by_group, follows, key[kind == 1][order], values[kind == 1][order])


def train(windows: DataFrame, shared: Broadcast) -> Gate:
    """windows: r, ids; shared: the tables."""
    gate = Gate.new()
    for number in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], start=gate, number=number) -> Iterator[pa.RecordBatch]:
            attention.keep_freed()
            own = Trainer(start, shared.value, attention.RATE / (1 + number))
            own.run(_in_parts(batches, 64 * SEGMENT))
            if own.windows:
                yield pa.RecordBatch.from_arrays([pa.array([own.gate.flat()], pa.list_(pa.float32())), pa.array([own.windows], pa.int64())], names=["weights", "n"])

        part = windows.where(F.pmod(F.col("r"), F.lit(ROUNDS)) == number).select("ids")
        ended = part.mapInArrow(run, "weights array<float>, n long").select("n", F.posexplode("weights"))
        mean = ended.groupBy("pos").agg((F.sum(F.col("col") * F.col("n")) / F.sum("n")).alias("w")).collect()  # one row for each weight of the model
        if mean:
            flat = np.zeros(len(mean))
            for r in mean:
                flat[r["pos"]] = r["w"]
            gate = gate.like(flat)
    return gate


class Grown:
    """An array that grows at its end; room doubles, so that what is there is seldom copied."""

    def __init__(self, dtype: type) -> None:
        self.room, self.size = np.zeros(1 << 12, dtype=dtype), 0

    def extend(self, more: np.ndarray) -> None:
        if (need := self.size + len(more)) > len(self.room):
            room = np.zeros(max(need, 2 * len(self.room)), dtype=self.room.dtype)
            room[: self.size] = self.values
            self.room = room
        self.room[self.size : need] = more
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class Words:
    """Words by number, with what is known of each in arrays; a bounded store."""

    def __init__(self, units: Units) -> None:
        self.units = units
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # numbers in the order in which words came
        # ids of all words one after another; of each word the number of units, where they start, the hash, and its own id or -1
        self.ids, self.sizes, self.starts, self.hashes, self.own = (Grown(t) for t in (np.int32, np.int32, np.int32, np.int64, np.int32))
        self.known[b""] = 0  # the end
        self._learn([b""])

    def _learn(self, new: list[bytes]) -> None:
        """Tables of new words, in the order of their numbers."""
        ids, sizes, hashes, own = self.units.many(new)
        first = np.cumsum(sizes) - sizes
        self.starts.extend(first + self.ids.size)
        self.ids.extend(ids)
        self.sizes.extend(sizes)
        self.hashes.extend(hashes)
        self.own.extend(np.where(own, ids[first], -1))

    def read(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """All words of the texts and their ends, one after another: (ends of the texts in words, numbers of words, units of each, ids of all)."""
        if len(self.known) > WORD_STORE:
            self._forget()
        lists = _split(texts)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.known.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        if len(missing := np.flatnonzero(numbers < 0)):
            new = list(map(distinct.__getitem__, missing.tolist()))
            numbers[missing] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(new, numbers[missing].tolist(), strict=True))
            self._learn(new)
        found, end = numbers[coded.indices.to_numpy()], self.known[b""]
        there = found != end
        many = np.bincount(np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())[there], minlength=len(texts))
        ends = np.cumsum(many + 1)
        inside = np.ones(ends[-1], dtype=bool)
        inside[ends - 1] = False
        at = np.full(ends[-1], end)
        at[inside] = found[there]
        size = self.sizes.values[at]
        stops = np.cumsum(size)
        return ends, at, size, self.ids.values.take(np.arange(stops[-1]) + np.repeat(self.starts.values[at] - stops + size, size))


class Scorer:
    """Scores sequences of ids with a trained model."""

    def __init__(self, tables: Tables, gate: Gate) -> None:
        self.tables, self.gate = tables, gate

    def scores(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 P(ids) of each sequence."""
        blocks = np.array([-(-len(t) // STRIDE) for t in sequences])
        # all sequences one after another, each with room for what comes before its first block
        room = WINDOW - STRIDE + blocks * STRIDE + 1
        begin = np.cumsum(room) - room
        padded = np.full(room.sum(), NONE, dtype=np.int64)
        for at, t in zip((begin + WINDOW - STRIDE).tolist(), sequences, strict=True):
            padded[at] = self.tables.start
            padded[at + 1 : at + 1 + len(t)] = t
        view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 1)
        owner = np.repeat(np.arange(len(sequences)), blocks)
        places = np.repeat(begin, blocks) + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        out = np.zeros(len(sequences))
        for low in range(0, len(places), SCORED_AT_ONCE):
            part = slice(low, low + SCORED_AT_ONCE)
            w = view[places[part]]
            y = w[:, WINDOW - STRIDE + 1 :]
            lp = np.where(y != NONE, attention.log_probs(self.gate, self.tables, w[:, :-1], np.where(y == NONE, 0, y)), 0).sum(1, dtype=np.float64)
            out += np.bincount(owner[part], lp, minlength=len(out))
        return out / np.log(10)


def score_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    training = rows.where(~held_out(F.col("doc_id")))
    seen = _word_counts(training).groupBy(F.xxhash64("word").alias("h")).agg(F.sum("n").alias("c"))
    counts = written(seen, "lm_words")
    sums = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    total, distinct = sums["n"] or 0, sums["v"]
    whole = total + 0.5 * (distinct + 1)
    least = max(2, -(-total // OWN_PARTS))
    often = F.col("c") >= least
    own = sorted((r["h"], r["c"]) for r in counts.where(often).select("h", "c").collect())  # OWN_PARTS at most
    sub = subwords(vocabulary)
    first = sub.end + 1
    own_ids = spark.sparkContext.broadcast({h: first + i for i, (h, _) in enumerate(own)})
    logs = spark.sparkContext.broadcast(np.log10((np.array([c for _, c in own], dtype=np.float64) + 0.5) / whole))
    # texts are cut into ids once; training and scoring take these
    read = written(_read(rows, vocabulary, own_ids, logs).withColumn("row", F.monotonically_increasing_id()), "lm_read")
    trained = read.where(~held_out(F.col("doc_id")))
    by_id = np.zeros(first + len(own))
    for r in _id_counts(trained, len(by_id)).groupBy("id").agg(F.sum("n").alias("n")).collect():  # as many rows as there are ids
        by_id[r["id"]] = r["n"]
    role = np.concatenate([np.where(sub.begins, attention.BEGINS, attention.GOES_ON), np.full(1 + len(own), attention.WORD)])
    tasks = max(1, int(-(-by_id.sum() // (WINDOW * TASK_WINDOWS))))
    windows = written(_cut(trained, len(by_id)).repartition(tasks, "r"), "lm_windows")
    tables = _tables(windows, by_id, role)
    shared = spark.sparkContext.broadcast(tables)
    gate = train(windows, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention.keep_freed()
        scorer = Scorer(shared.value, gate)
        for batch in batches:
            for low in range(0, batch.num_rows, READ_AT_ONCE):
                part = batch.slice(low, READ_AT_ONCE)
                scores = scorer.scores([unpacked(d) for d in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(scores)], names=[*kept, "score"])

    kept = ["row", "doc_id", "n_tokens", "hot_known", "hot_sum"]
    scored = read.select("ids", *kept).mapInArrow(run, "row long, doc_id long, n_tokens long, hot_known long, hot_sum double, score double")
    scored = written(scored.withColumn("held_out", held_out(F.col("doc_id"))), "lm_scored")
    rare = counts.where(~often).select("h", F.log10((F.col("c") + 0.5) / F.lit(whole)).alias("log")).hint("shuffle_hash")  # a hash has one row, so the shares of tasks are even
    found = _rare(read).join(rare, "h", "left").groupBy("row").agg(
        F.sum(F.when(F.col("log").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.coalesce("log", F.log10(F.lit(0.5) / F.lit(whole)))).alias("rare_sum"),
    )
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0))).alias("base_score"),
        "score",
    )
