"""A causal self-attention model over ids, in numpy: what a task computes for the language model.

    P(next | window) = sum over components of P(component | window) * P(next | component, current id)

sums up to one over all ids exactly, at the cost of a few numbers for each target. Ids have roles: pieces that begin a word,
pieces that go on, whole words. A component is a role in a group, a group being ids that occur together. It gives an id by how
often that id stands in windows of the group; pieces that go on have a second component in each group, which gives them by how
often they stand there after the current piece.

    P(component | window) = softmax(context M + roles that follow the current id R + b)

The context comes from causal self-attention over the window, with the share of each group and role of an id as its embedding.
The tables are counted over all training ids, each once; the weights of attention and softmax are trained by gradient steps (Adam).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

WINDOW, STRIDE = 64, 32
GROUPS, LEADERS = 8, 128
BEGINS, GOES_ON, WORD, ROLES = 0, 1, 2, 3
COMPONENTS, EMBEDDED = (ROLES + 1) * GROUPS, GROUPS + ROLES + 1  # the last number of an embedding is 1; component = role * GROUPS + group; the last ones depend on the current piece
KEY_DIM, RATE, BATCH, MIN_STEPS = 8, 0.02, 64, 100
SHOWN = EMBEDDED + ROLES + 1  # of an id: its embedding, the roles that follow it, 1
BLOCK = 32  # queries of a window that are computed together: products of so small matrices cost by the call
BOUND = np.float32(30)  # of scores before the exponential, in training and in scoring
LEAST = np.float32(1e-20)  # added to P(component) times its sum
NONE = -1  # in windows: nothing there
KEPT = 16 << 20  # see keep_freed
PAIRS_AT_ONCE = 1_000_000
BACK_OFF = 2.0  # how often the group's own pieces count beside those seen after a piece


@dataclass
class Gate:
    """The trained weights."""

    q: np.ndarray
    k: np.ndarray
    far: np.ndarray
    mix: np.ndarray
    after: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, seed: int = 11) -> Gate:
        rng = np.random.default_rng(seed)
        n = lambda *s: (0.1 * rng.normal(size=s)).astype(np.float32)
        mix, after = n(EMBEDDED, COMPONENTS), n(ROLES, COMPONENTS)
        mix[:GROUPS] += 3 * np.tile(np.eye(GROUPS, dtype=np.float32), ROLES + 1)
        after += np.repeat(np.eye(ROLES, dtype=np.float32)[[BEGINS, GOES_ON, WORD, GOES_ON]], GROUPS, 0).T
        return cls(n(EMBEDDED, KEY_DIM), n(EMBEDDED, KEY_DIM), n(WINDOW), mix, after, n(COMPONENTS))

    def arrays(self) -> list[np.ndarray]:
        return [self.q, self.k, self.far, self.mix, self.after, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def like(self, flat: np.ndarray) -> Gate:
        out, at = [], 0
        for a in self.arrays():
            out.append(np.asarray(flat[at : at + a.size], dtype=np.float32).reshape(a.shape))
            at += a.size
        return Gate(*out)


@dataclass
class Tables:
    """Rows of the ids. After the ids come the start and nothing."""

    role: np.ndarray
    pieces: int  # ids from here on are whole words
    shown: np.ndarray  # SHOWN numbers of each, in one row: what is taken together lies together
    emitted: np.ndarray  # P(id | role, group)
    pairs: np.ndarray  # current id * ids + next id, ascending; the last one is no pair
    paired: np.ndarray  # how often, by group; the last row is zero
    leads: np.ndarray  # how often each id comes before a piece that goes on, by group

    @classmethod
    def of(cls, role: np.ndarray, by_group: np.ndarray, follows: np.ndarray, pairs: np.ndarray, paired: np.ndarray) -> Tables:
        """role: of the ids; by_group: how often each stands in each group; follows: how often each role comes after each id; paired: how often pairs stand in each group."""
        ids = len(role)
        words = np.flatnonzero(role == WORD)
        pieces = int(words[0]) if len(words) else ids
        by_group = by_group.astype(np.float64)
        usual = (by_group.sum(0) + 1e-3) / (by_group.sum(0) + 1e-3).sum()
        given = (by_group + 0.5 * usual) / (by_group.sum(1, keepdims=True) + 0.5)
        of_role = np.eye(ROLES)[role]
        count = by_group.sum(1)
        base = (0.99 * (count + 1e-9) / max(1.0, count.sum()) + 0.01 / ids)[:, None] * of_role
        base /= base.sum(0) + 1e-300
        per = of_role.T @ by_group  # (ROLES, GROUPS)
        mass = 1 + 0.002 * per
        emitted = (by_group + base.sum(1, keepdims=True) * mass[role]) / (per + mass)[role]
        told = follows.astype(np.float64)
        told[pieces:] = (given[pieces:, :, None] * (given[pieces:].T @ told[pieces:])[None]).sum(1) if len(words) else 0  # words share what follows by group
        often = (told.sum(0) + 1) / (told.sum() + ROLES)
        told = np.log((told + 5 * often) / (told.sum(1, keepdims=True) + 5))
        leads = np.zeros((ids, GROUPS))
        if len(pairs):
            np.add.at(leads, pairs // ids, paired)
        two, shown = np.zeros((2, GROUPS)), np.zeros((ids + 2, SHOWN), dtype=np.float32)
        shown[:ids, :EMBEDDED] = np.concatenate([given, of_role, np.ones((ids, 1))], axis=1)
        shown[ids, EMBEDDED - 1] = 1  # the start is there, what is nothing is not
        shown[:, EMBEDDED:-1] = np.concatenate([told, np.log(np.repeat(often[None], 2, 0))])
        shown[:, -1] = 1
        return cls(
            role, pieces, shown, emitted.astype(np.float32), np.append(pairs, np.iinfo(np.int64).max),
            np.concatenate([paired, two[:1]]).astype(np.float32), np.concatenate([leads, two]).astype(np.float32),
        )

    @property
    def start(self) -> int:
        return len(self.emitted)

    @property
    def embedded(self) -> np.ndarray:
        return self.shown[:, :EMBEDDED]

    @property
    def follows(self) -> np.ndarray:
        """ln P(role of the next id | id)."""
        return self.shown[:, EMBEDDED:-1]

    def known(self, windows: np.ndarray) -> np.ndarray:
        """What the model sees of windows of ids."""
        return self.shown.take(windows, 0, mode="wrap")

    def likely(self, current: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """P(target | component) of rows of current and target ids: role of each, by group, and where pieces go on, by group after the current piece."""
        role, first = self.role.take(target), self.emitted.take(target, 0)
        on = np.flatnonzero(role == GOES_ON)
        now = current[on]
        key = now * self.start + target[on]
        at = np.searchsorted(self.pairs, key)
        at[self.pairs.take(at) != key] = len(self.pairs) - 1
        second = first.take(on, 0)
        second *= np.float32(BACK_OFF)
        second += self.paired.take(at, 0)
        second /= self.leads.take(now, 0, mode="wrap") + np.float32(BACK_OFF)
        return role, first, on, second


@lru_cache
def _blocks(asked: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of the last `asked` positions of a window: first and end position, distances to all positions before the end, and which of these are allowed.

    A block of queries looks at no more keys than its last one may see.
    """
    out = []
    for low in range(WINDOW - asked, WINDOW, BLOCK):
        high = min(WINDOW, low + BLOCK)
        far = np.arange(low, high)[:, None] - np.arange(high)[None]
        out.append((low, high, np.clip(far, 0, WINDOW - 1), far >= 0))
    return out


def attend(gate: Gate, shown: np.ndarray, asked: int) -> tuple[np.ndarray, ...]:
    """At the last positions of windows: (P(component) times a sum, this sum, context and what follows the current id, the context's sum, attention by block, queries and keys).

    Embeddings of nothing are zero, so they add neither to the context nor to the sum, which is the context's last number.
    """
    n, start, x = len(shown), WINDOW - asked, shown[:, :, :EMBEDDED]
    asks = np.concatenate([gate.q / np.float32(KEY_DIM**0.5), gate.k], axis=1)
    asks = (shown.reshape(-1, SHOWN)[:, :EMBEDDED] @ asks).reshape(n, WINDOW, 2 * KEY_DIM)
    q, keys = asks[:, start:, :KEY_DIM], asks[:, :, KEY_DIM:].transpose(0, 2, 1)
    context, attention = shown[:, start:].copy(), []
    for low, high, far, allowed in _blocks(asked):
        a = q[:, low - start : high - start] @ keys[:, :, :high]
        a += np.where(allowed, gate.far[far], np.float32(-1e4))
        _bounded(a)
        np.exp(a, out=a)
        np.matmul(a, x[:, :high], out=context[:, low - start : high - start, :EMBEDDED])
        attention.append(a)
    context = context.reshape(-1, SHOWN)
    total = context[:, EMBEDDED - 1] + np.float32(1e-20)
    context[:, :EMBEDDED] *= np.repeat(np.reciprocal(total), EMBEDDED).reshape(-1, EMBEDDED)
    g = context @ np.concatenate([gate.mix, gate.after, gate.bias[None]])
    _bounded(g)
    np.exp(g, out=g)
    return g, g @ np.ones(COMPONENTS, dtype=np.float32) + COMPONENTS * LEAST, context, total, attention, asks


def keep_freed() -> None:
    """The process keeps arrays of up to KEPT bytes that it frees, for the next ones.

    Before it has freed a large one, the C library gives arrays of more than 128 KB back at once, and the steps of training and scoring get their
    pages anew from the system each time. At most twice KEPT stay unused.
    """
    np.empty(KEPT, dtype=np.uint8)


def _bounded(a: np.ndarray) -> None:
    """No number of a above BOUND; to look is cheaper than to write them all."""
    if a.max(initial=0) > BOUND:
        np.minimum(a, BOUND, out=a)


def _parts_of(g: np.ndarray, role: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(component) times a sum, by group: (places of the target's role, then of the last role where pieces go on, the components there)."""
    rows = np.concatenate([np.arange(0, len(role) * (ROLES + 1), ROLES + 1) + role, on * (ROLES + 1) + ROLES])
    return rows, g.reshape(-1, GROUPS).take(rows, 0) + LEAST


def _summed(parts: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The sum of each target's parts; those of `on` come after the others."""
    each = parts @ np.ones(GROUPS, dtype=np.float32)
    many = len(each) - len(on)
    each[on] += each[many:]
    return each[:many]


def log_probs(gate: Gate, tables: Tables, seen: np.ndarray, target: np.ndarray) -> np.ndarray:
    """ln P(target) at the last positions of windows of ids; target has a row for each window."""
    asked = target.shape[1]
    g, whole = attend(gate, tables.known(seen), asked)[:2]
    role, first, on, second = tables.likely(seen[:, WINDOW - asked :].ravel(), target.ravel())
    parts = _parts_of(g, role, on)[1]
    parts *= np.concatenate([first, second])
    return np.log(_summed(parts, on) / whole).reshape(target.shape)


def gradient(gate: Gate, tables: Tables, seen: np.ndarray, target: np.ndarray) -> Gate:
    """Of the mean negative log-likelihood over the targets. Targets of NONE do not count; nothing is NONE before a target."""
    n, asked = target.shape
    start, shown = WINDOW - asked, tables.known(seen)
    g, whole, context, total, attention, asks = attend(gate, shown, asked)
    live = target.ravel() != NONE
    role, first, on, second = tables.likely(seen[:, start:].ravel(), np.where(live, target.ravel(), 0))
    rows, parts = _parts_of(g, role, on)
    given = parts * np.concatenate([first, second])
    over = whole / _summed(given, on)
    given *= np.concatenate([over, over[on]])[:, None]
    d = g  # (P(component | window) less P(component | window, target), which is zero for other roles) times whole
    d.reshape(-1, GROUPS)[rows] = parts - given
    each = live / np.float32(max(1, live.sum())) / whole
    dc = d @ np.concatenate([gate.mix, np.zeros((SHOWN - EMBEDDED, COMPONENTS), dtype=np.float32)]).T
    dc *= np.repeat(each / total, SHOWN).reshape(-1, SHOWN)
    dc[:, EMBEDDED - 1] -= (dc * context) @ np.ones(SHOWN, dtype=np.float32)  # by way of the sum; embeddings end with 1
    context *= np.repeat(each, SHOWN).reshape(-1, SHOWN)
    d_out = (context.reshape(n, asked, SHOWN).transpose(0, 2, 1) @ d.reshape(n, asked, COMPONENTS)).sum(0)
    dc, d_asks, dfar = dc.reshape(n, asked, SHOWN)[:, :, :EMBEDDED], np.zeros_like(asks), np.zeros(WINDOW)
    columns, q, k, dq, dk = shown[:, :, :EMBEDDED].transpose(0, 2, 1), asks[:, start:, :KEY_DIM], asks[:, :, KEY_DIM:], d_asks[:, start:, :KEY_DIM], d_asks[:, :, KEY_DIM:]
    for (low, high, far, _), a in zip(reversed(_blocks(asked)), reversed(attention), strict=True):
        part = slice(low - start, high - start)
        da = dc[:, part] @ columns[:, :, :high]
        da *= a
        np.matmul(da, k[:, :high], out=dq[:, part])
        if high == WINDOW:
            np.matmul(da.transpose(0, 2, 1), q[:, part], out=dk)
        else:
            dk[:, :high] += da.transpose(0, 2, 1) @ q[:, part]
        dfar += np.bincount(far.ravel(), da.sum(0).ravel(), minlength=WINDOW)
    d_asks = shown.reshape(-1, SHOWN)[:, :EMBEDDED].T @ d_asks.reshape(-1, 2 * KEY_DIM)
    return Gate(d_asks[:, :KEY_DIM] / np.float32(KEY_DIM**0.5), d_asks[:, KEY_DIM:], dfar.astype(np.float32), d_out[:EMBEDDED], d_out[EMBEDDED:-1], d_out[-1])


class Trainer:
    """One task's share of a round: gradient steps on windows of WINDOW + 1 ids."""

    def __init__(self, gate: Gate, tables: Tables, rate: float = RATE) -> None:
        self.gate, self.tables, self.rate = gate, tables, rate
        self.flat = gate.flat().astype(np.float64)
        self.m, self.v, self.steps, self.windows = np.zeros_like(self.flat), np.zeros_like(self.flat), 0, 0

    def step(self, w: np.ndarray) -> None:
        g, self.steps = gradient(self.gate, self.tables, w[:, :-1], w[:, 1:]).flat(), self.steps + 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.02 * (g * g - self.v)
        self.flat -= self.rate * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.98**self.steps)) + 1e-8)
        self.gate = self.gate.like(self.flat)

    def run(self, parts: Iterable[np.ndarray]) -> None:
        """One pass over the windows of all parts; where they make few steps, several passes."""
        first: list[np.ndarray] | None = []
        for part in parts:
            self.windows += len(part)
            if first is not None:
                first.append(part)
                if sum(map(len, first)) < MIN_STEPS * BATCH:
                    continue
                part, first = np.concatenate(first), None
            self._pass(part)
        if first:
            part = np.concatenate(first)
            for _ in range(-(-MIN_STEPS * BATCH // len(part))):
                self._pass(part)

    def _pass(self, part: np.ndarray) -> None:
        for low in range(0, len(part), BATCH):
            self.step(part[low : low + BATCH])


# ---- what is counted


def leaders_in(windows: np.ndarray, leader: np.ndarray) -> np.ndarray:
    """How often each leader occurs in each window. leader: the number of each id's leader, LEADERS for none; so for the start and for nothing."""
    at = np.arange(len(windows))[:, None] * (LEADERS + 1) + leader[windows]
    return np.bincount(at.ravel(), minlength=len(windows) * (LEADERS + 1)).reshape(len(windows), LEADERS + 1)[:, :LEADERS]


def group_leaders(together: np.ndarray) -> np.ndarray:
    """A group for each leader, from how many windows hold both of two leaders: k-means on the main axes of their associations."""
    c = together.astype(np.float64)
    np.fill_diagonal(c, 0)
    rows = c.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        near = np.log(c * c.sum() / np.outer(rows, rows))
    near = np.where(np.isfinite(near), np.maximum(near, 0), 0)
    u, s, _ = np.linalg.svd(near)
    x = u[:, :GROUPS] * np.sqrt(s[:GROUPS])
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
    centres = [x[0]]
    while len(centres) < GROUPS:  # the farthest from those there are
        centres.append(x[np.argmin((x @ np.stack(centres).T).max(1))])
    middle = np.stack(centres)
    for _ in range(30):
        own = (x @ middle.T).argmax(1)
        for g in range(GROUPS):
            if (own == g).any():
                middle[g] = x[own == g].mean(0)
                middle[g] /= np.linalg.norm(middle[g]) + 1e-12
    return (x @ middle.T).argmax(1)


def shares(windows: np.ndarray, leader: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """How far each window belongs to each group: as its leaders do."""
    votes = leaders_in(windows, leader) @ np.eye(GROUPS, dtype=np.float32)[groups]
    votes = ((votes + np.float32(0.5)) / WINDOW) ** 8
    return votes / votes.sum(1, keepdims=True)


class Counts:
    """What Tables are made of, over windows of WINDOW + 1 ids."""

    def __init__(self, leader: np.ndarray, groups: np.ndarray, role: np.ndarray) -> None:
        self.leader, self.groups, self.role, self.ids = leader, groups, role, len(role)
        self.by_group = np.zeros((GROUPS, self.ids))
        self.follows = np.zeros(self.ids * ROLES, dtype=np.int64)
        self.open: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, windows: np.ndarray) -> None:
        seen, target = windows[:, :-1], windows[:, 1:]
        live = np.flatnonzero(target.ravel() != NONE)
        y, before = target.ravel()[live], seen.ravel()[live]
        share = shares(target, self.leader, self.groups)
        of = live // WINDOW
        for g, column in enumerate(np.ascontiguousarray(share.T, dtype=np.float64)):
            self.by_group[g] += np.bincount(y, column.take(of), minlength=self.ids)
        kind, told = self.role[y], before < self.ids
        self.follows += np.bincount(before[told] * ROLES + kind[told], minlength=len(self.follows))
        on = np.flatnonzero((kind == GOES_ON) & told)
        self.open.append(_sums(before[on] * self.ids + y[on], share[of[on]]))

    def full(self) -> bool:
        """Whether there are so many pairs that they should be taken."""
        if sum(len(k) for k, _ in self.open) > PAIRS_AT_ONCE:
            self.open = [self.pairs()]
        return sum(len(k) for k, _ in self.open) > PAIRS_AT_ONCE // 2

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys as in Tables, how often each pair stands in each group), which are forgotten."""
        if not self.open:
            return np.zeros(0, dtype=np.int64), np.zeros((0, GROUPS))
        keys, rows = zip(*self.open, strict=True)
        self.open = []
        return _sums(np.concatenate(keys), np.concatenate(rows))


def _sums(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sum of the rows of each."""
    if not len(keys):
        return keys, np.zeros((0, rows.shape[1]), dtype=np.float64)
    found, at = np.unique(keys, return_inverse=True)
    return found, np.stack([np.bincount(at, column) for column in np.ascontiguousarray(rows.T)], axis=1)


def windows_of(sequence: np.ndarray, start: int) -> np.ndarray:
    """Windows of WINDOW + 1 ids in which each id of the sequence is a target once; NONE after the end."""
    many = max(1, -(-len(sequence) // WINDOW))
    padded = np.full(many * WINDOW + 1, NONE, dtype=np.int64)
    padded[0], padded[1 : len(sequence) + 1] = start, sequence
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 1)[::WINDOW]
