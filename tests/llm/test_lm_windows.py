"""The language model: its windows, its distribution, its gradient, and its scores recomputed one token at a time."""

import math
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.test_operators import prose

from flowloom.llm import attention, lm

NAME = "byte_bpe_50k.tiktoken"


def test_windows_cover_every_id_of_every_text_once(spark):
    texts = [None, "", "one", prose(31, 1), prose(63, 2), prose(64, 2), prose(9000, 3), "unsplittablewordwithmanypieces " * 70]
    own = {int(h): 50257 + i for i, h in enumerate(lm._word_hashes(lm.words(prose(900, 3))[:20]))}
    units, got = lm.Units(NAME, own), {}
    for i, t in enumerate(texts):
        docs = spark.createDataFrame([(i, t)], "doc_id long, text string")
        parts = [np.frombuffer(r["ids"], dtype="<i4").reshape(-1, lm.WINDOW + 1) for r in lm._windows(docs, NAME, SimpleNamespace(value=own)).collect()]
        got[i] = np.concatenate(parts)  # one task gives them in order
        assert max(map(len, parts)) <= lm.SEGMENT
    for i, t in enumerate(texts):
        want = units.many([*lm.words(t), b""])[0].tolist()
        targets = got[i][:, 1:]
        assert targets[targets >= 0].tolist() == want
        assert got[i][:, :-1].ravel()[: len(want)].tolist() == [units.size, *want[:-1]]


def small_model(seed=0, pieces=9, words=6, start_even=False):
    """Tables over a few ids, counted in random windows, and a gate."""
    r = np.random.default_rng(seed)
    ids = pieces + words
    role = np.concatenate([np.arange(pieces) % 2, np.full(words, attention.WORD)])
    windows = np.concatenate([attention.windows_of(r.integers(0, ids, r.integers(1, 200)), ids) for _ in range(30)])
    leader = np.full(ids + 2, attention.LEADERS)
    leader[:ids] = np.arange(ids)
    counts = attention.Counts(leader, r.integers(0, attention.GROUPS, attention.LEADERS), role)
    counts.add(windows)
    pairs, paired = counts.pairs()
    keep = np.arange(len(pairs)) % 3 > 0
    tables = attention.Tables.of(role, counts.by_group.T, counts.follows.reshape(ids, 3), pairs[keep], paired[keep])
    gate = attention.Gate.new(seed)
    return tables, gate.like(gate.flat() + 0.3 * r.normal(size=len(gate.flat()))), windows


def test_counts_are_of_every_target_once(monkeypatch):
    monkeypatch.setattr(attention, "PAIRS_AT_ONCE", 10)
    tables, _, windows = small_model()
    ids = tables.start
    leader = np.full(ids + 2, attention.LEADERS)
    leader[:ids] = np.arange(ids)
    counts = attention.Counts(leader, np.zeros(attention.LEADERS, dtype=int), tables.role)
    taken = []
    for part in np.array_split(windows, 4):
        counts.add(part)
        if counts.full():
            taken.append(counts.pairs())
    assert taken
    taken.append(counts.pairs())
    pairs, paired = attention._sums(np.concatenate([k for k, _ in taken]), np.concatenate([v for _, v in taken]))
    target = windows[:, 1:][windows[:, 1:] >= 0]
    assert np.allclose(counts.by_group.sum(0), np.bincount(target, minlength=ids))
    plain = {}
    for w in windows:
        for a, b in zip(w, w[1:], strict=False):
            if b >= 0 and a < ids and tables.role[b] == attention.GOES_ON:
                plain[a * ids + b] = plain.get(a * ids + b, 0) + 1
    assert dict(zip(pairs.tolist(), np.round(paired.sum(1)).astype(int).tolist(), strict=True)) == plain
    assert counts.follows.sum() == sum((w[1:] >= 0).sum() - ((w[:-1] == ids) & (w[1:] >= 0)).sum() for w in windows)


def test_probabilities_sum_to_one_and_look_back_only():
    tables, gate, _ = small_model()
    r, ids = np.random.default_rng(1), tables.start
    for seen in (r.integers(0, ids, (1, lm.WINDOW)), np.array([[attention.NONE] * 40 + [ids] + r.integers(0, ids, lm.WINDOW - 41).tolist()])):
        every = np.concatenate([attention.log_probs(gate, tables, seen, np.full((1, 1), y)) for y in range(ids)])
        assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)
    seen, target = r.integers(0, ids, (1, lm.WINDOW)), r.integers(0, ids, (1, lm.WINDOW))
    other = seen.copy()
    other[0, 40:] = 3
    a, b = attention.log_probs(gate, tables, seen, target), attention.log_probs(gate, tables, other, target)
    assert np.allclose(a[0, :40], b[0, :40], atol=1e-5) and not np.allclose(a[0, 40:], b[0, 40:], atol=1e-5)


def test_unseen_ids_have_probabilities_too():
    tables = attention.Tables.of(np.array([0, 1, 2, 2]), np.zeros((4, attention.GROUPS)), np.zeros((4, 3)), np.zeros(0, dtype=np.int64), np.zeros((0, attention.GROUPS)))
    seen = np.array([[attention.NONE] * 63 + [4]])
    every = [attention.log_probs(attention.Gate.new(), tables, seen, np.full((1, 1), y))[0, 0] for y in range(4)]
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-5) and min(every) > -20


def test_gradient_and_training():
    tables, gate, windows = small_model(2)
    w = windows[:6].copy()
    w[2, 30:] = attention.NONE
    loss = lambda q: -(attention.log_probs(q, tables, w[:, :-1], np.maximum(w[:, 1:], 0)) * (w[:, 1:] >= 0)).sum(dtype=np.float64) / (w[:, 1:] >= 0).sum()
    g, flat = attention.gradient(gate, tables, w[:, :-1], w[:, 1:]).flat(), gate.flat().astype(np.float64)
    sizes = np.cumsum([0, *(a.size for a in gate.arrays())])
    for low, high in zip(sizes, sizes[1:], strict=False):
        for i in low + np.argsort(-np.abs(g[low:high]))[:4]:
            up, down = flat.copy(), flat.copy()
            up[i] += 1e-2
            down[i] -= 1e-2
            assert (loss(gate.like(up)) - loss(gate.like(down))) / 2e-2 == pytest.approx(g[i], rel=0.05, abs=2e-5)
    trainer = attention.Trainer(attention.Gate.new(), tables)
    trainer.run([windows[:20], windows[20:]])
    assert trainer.windows == len(windows) and trainer.steps >= attention.MIN_STEPS
    assert loss(trainer.gate) < loss(attention.Gate.new())


def by_hand(gate, tables, sequence):
    """log10 P of a sequence, one token at a time, as the formulas read."""
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    e, total = np.concatenate([tables.embedded[:, :]], axis=0).astype(float), 0.0
    before = [tables.start, *sequence[:-1]]
    for t, y in enumerate(sequence):
        block = t // lm.STRIDE * lm.STRIDE  # each block of targets sees the window that ends with it
        first = max(0, block + lm.STRIDE - lm.WINDOW)
        seen = before[first : t + 1]
        q = e[seen[-1]] @ gate.q
        scores = np.array([q @ (e[s] @ gate.k) / math.sqrt(attention.KEY_DIM) + gate.far[len(seen) - 1 - i] for i, s in enumerate(seen)])
        context = soft(np.minimum(scores, attention.BOUND)) @ e[seen]
        g = soft(context @ gate.mix + tables.follows[seen[-1]] @ gate.after + gate.bias).reshape(4, attention.GROUPS)
        p = g[tables.role[y]] @ tables.emitted[y]
        if tables.role[y] == attention.GOES_ON:
            at = np.flatnonzero(tables.pairs == seen[-1] * tables.start + y)
            often = tables.paired[at[0]] if len(at) else 0
            p += g[3] @ ((often + attention.BACK_OFF * tables.emitted[y]) / (tables.leads[seen[-1]] + attention.BACK_OFF))
        total += math.log10(p)
    return total


def test_scores_of_blocks_equal_scores_by_hand():
    tables, gate, _ = small_model(3)
    s = lm.Scorer.__new__(lm.Scorer)
    s.tables, s.gate = tables, gate
    r = np.random.default_rng(3)
    sequences = [r.integers(0, tables.start, n) for n in (1, 31, 32, 33, 64, 65, 200)]
    assert np.allclose(s.scores(sequences), [by_hand(gate, tables, t.tolist()) for t in sequences], rtol=1e-4)


def test_score_documents_equals_scores_by_hand(spark, monkeypatch):
    caught = {}
    real = lm.train

    def train(windows, shared):
        caught["tables"], caught["gate"] = shared.value, real(windows, shared)
        return caught["gate"]

    monkeypatch.setattr(lm, "train", train)
    texts = [prose(80, i % 11) for i in range(60)] + [None, "", "A  B\ta", prose(700, 50), "zzyzx" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()}
    held = {r["doc_id"] for r in docs.where(lm.held_out(docs.doc_id)).collect()}
    words = {}
    for i, t in enumerate(texts):
        if i not in held:
            for w in [*lm.words(t), b""]:
                words[w] = words.get(w, 0) + 1
    own = sorted(int(lm._word_hashes([w])[0]) for w, n in words.items() if n >= 2)
    units = lm.Units(NAME, {h: 50257 + i for i, h in enumerate(own)})
    for i in (0, 7, 60, 61, 62, 63, 64):
        ids = units.many([*lm.words(texts[i]), b""])[0].tolist()
        assert got[i] == pytest.approx(by_hand(caught["gate"], caught["tables"], ids), rel=1e-4)


def test_texts_are_read_once(spark, monkeypatch):
    plans, real = {}, lm.written

    def written(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(lm, "written", written)
    docs = spark.createDataFrame([(i, prose(40, i % 5)) for i in range(30)], "doc_id long, text string")
    assert lm.score_documents(docs).count() == 30
    assert {name for name, plan in plans.items() if "text#" in plan} == {"lm_words", "lm_read"}  # training and scoring take ids


TASK = """
import resource
from types import SimpleNamespace
from unittest.mock import MagicMock
import numpy as np
from flowloom.llm import lm
from tests.llm.test_lm_windows import small_model

tables, _, windows = small_model()
windows = np.tile(windows, (100, 1))[:2048]
lm.F, lm._in_parts = MagicMock(), lambda batches, many: iter([windows])

def pages_of(run, schema):
    taken = []
    for _ in range(4):
        taken.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
        next(run(iter([])))
    print(max(np.diff(taken)[1:]))
    raise SystemExit

part = SimpleNamespace(mapInArrow=pages_of)
lm.train(SimpleNamespace(where=lambda *_: SimpleNamespace(select=lambda *_: part)), SimpleNamespace(value=tables))
"""


def test_training_keeps_its_memory():
    """In a new process, as a task's is: arrays of one step are there for the next, so that no page is asked for again."""
    top = str(Path(lm.__file__).parents[2])
    out = subprocess.run([sys.executable, "-c", TASK], cwd=top, capture_output=True, text=True, timeout=120, check=True)
    assert int(out.stdout) < 2000  # pages in the worst of three runs of 100 steps


def test_words_of_odd_texts():
    texts = [None, "", " ", " a  B\x0b\x0cb\r\n", "x\x1cy\x85z\xa0Ä　É a", "ÀÉ zZ\tzz", "a" * 5000 + " b", "b\x00 \x00"]
    store = lm.Words(lm.Units(NAME, {int(lm._word_hashes([b"a"])[0]): 50257}))
    for _ in range(2):  # words that are new, and known ones
        for size in (1, 3, 10_000):
            got = []
            for run in lm._runs(pa.array(texts, pa.string()), size):
                ends, at, sizes, ids = store.read(run)
                by_number, stops = list(store.known), np.cumsum(sizes)
                for low, high in zip([0, *ends[:-1]], ends, strict=True):
                    own = [by_number[i] for i in at[low:high]]
                    got.append(own)
                    part = ids[stops[low] - sizes[low] : stops[high - 1]]
                    assert part.tolist() == store.units.many(own)[0].tolist()
                    assert lm.unpacked(lm.packed(part + 500_000)).tolist() == (part + 500_000).tolist()
            assert got == [[*lm.words(t), b""] for t in texts]
