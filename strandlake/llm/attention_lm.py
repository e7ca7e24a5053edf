"""A causal self-attention model on subword ids, in numpy.

Units are ids of a public byte-level vocabulary, each with whether it ends its word, so
that unit sequences of words are free of prefixes and word probabilities sum to at most
one.  The model keeps the ids that are frequent in its sample; any other id is spelt as
half bytes.  One block of masked attention and a small ReLU layer predict the next
unit, in two steps: its class, then the unit in the class.

Texts are read in windows of WINDOW units of which the first CONTEXT repeat the end of
the window before: each unit is scored once, with at least CONTEXT units before it
(fewer only at the start of a text), many windows in one batched product.
"""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np

from strandlake.llm.words import byte_letters

CLASSES = 32
PER_CLASS = 32
UNITS = CLASSES * PER_CLASS
DIM = 24
HIDDEN = 48
WINDOW = 32
CONTEXT = 8
SCORED = WINDOW - CONTEXT
STEPS = 1500
BATCH = 128
RATE = 0.01
#: Windows that are scored in one product.
CHUNK = 256
#: Beginnings and ends of words whose units a worker remembers, each.
CACHE_WORDS = 300_000

_MARKS = ".,;:?!\"()[]{}<>|/\\*$%&#@+=-_~^`"
_MARK_BYTES = _MARKS.encode()
END = 0  # the unit that ends a text; also stands before its first unit
_HIGH, _LOW, _LAST = 1, 17, 33  # half bytes: high, low, low at the end of a word
_FREE = 49


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Units:
    """Words as unit sequences."""

    def __init__(self, path: str, chosen: list[tuple[int, bool]]):
        self.path, self.chosen = path, chosen
        self._open()

    def _open(self):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.tokenizer.encode_special_tokens = True
        self.place = {pair: _FREE + i for i, pair in enumerate(self.chosen)}
        self.letters = byte_letters()
        self.signs = {b: c for c, b in self.letters.items()}
        self.merges = self.tokenizer.model
        self.spelt: dict[tuple[int, bool], tuple[int, ...]] = {}
        self.begins: dict[bytes, bytes] = {}
        self.ends: dict[bytes, bytes] = {}
        self.begin_codes: dict[bytes, bytes] = {}
        self.end_codes: dict[bytes, bytes] = {}

    def __getstate__(self):
        return self.path, self.chosen

    def __setstate__(self, state):
        self.path, self.chosen = state
        self._open()

    @staticmethod
    def _halves(word: str) -> tuple[str, str]:
        """Letters and the marks after them, which never merge here; any other word whole, as the second."""
        core = word.rstrip(_MARKS)
        return (core, word[len(core) :]) if len(core) < len(word) and core.isalpha() else ("", word)

    def _ids(self, part: str) -> list[int]:
        if part.isalpha() and len(part) <= 64:  # letters go straight to the merges
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.signs)
            return [t.id for t in self.merges.tokenize(shown)]
        return self.tokenizer.encode(part, add_special_tokens=False).ids

    def ids(self, word: str) -> list[int]:
        core, rest = self._halves(word)
        return (self._ids(core) if core else []) + self._ids(rest)

    def _spell(self, pair: tuple[int, bool]) -> tuple[int, ...]:
        if pair in self.place:
            return (self.place[pair],)
        raw = [self.letters[c] for c in self.tokenizer.id_to_token(pair[0])]
        out = [u for b in raw for u in (_HIGH + (b >> 4), _LOW + (b & 15))]
        if pair[1]:
            out[-1] += _LAST - _LOW
        return tuple(out)

    def _units(self, part: str, ends: bool) -> bytes:
        units: list[int] = []
        ids = self._ids(part)
        last = len(ids) - 1
        for i, x in enumerate(ids):
            pair = (x, ends and i == last)
            found = self.spelt.get(pair)
            if found is None:
                found = self.spelt[pair] = self._spell(pair)
            units.extend(found)
        return array("h", units).tobytes()

    def _packed(self, words: list[bytes], begins: dict[bytes, bytes], ends: dict[bytes, bytes], make) -> list[bytes]:
        """What ``make`` gives for the parts of each word, joined.  Beginnings and ends of words are remembered."""
        out = []
        for held in (begins, ends):
            if len(held) > CACHE_WORDS:
                held.clear()
        for raw in words:
            found = ends.get(raw)
            if found is None:
                core = raw.rstrip(_MARK_BYTES)
                head, tail = begins.get(core), ends.get(raw[len(core) :])
                if head is None or tail is None:
                    core, rest = self._halves(raw.decode())
                    core, rest, begin, end = core.encode(), rest.encode(), core, rest
                    tail = ends.get(rest)
                    if tail is None:
                        tail = ends[rest] = make(end, True)
                    head = begins.get(core) if core else b""
                    if head is None:
                        head = begins[core] = make(begin, False)
                found = head + tail
            out.append(found)
        return out

    def of(self, words: list[bytes]) -> list[bytes]:
        """Each word's units as packed int16."""
        return self._packed(words, self.begins, self.ends, self._units)

    def _codes(self, part: str, ends: bool) -> bytes:
        codes = [2 * x for x in self._ids(part)]
        if ends and codes:
            codes[-1] += 1
        return array("i", codes).tobytes()

    def counted(self, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct units of words with these counts, as 2 * id + whether it ends its word, and how often each occurs."""
        found = self._packed(words, self.begin_codes, self.end_codes, self._codes)
        flat = np.frombuffer(b"".join(found), np.int32)
        times = np.repeat(np.asarray(counts, np.int64), [len(x) // 4 for x in found])
        total = np.bincount(flat, weights=times) if len(flat) else np.zeros(0)
        used = np.flatnonzero(total)
        return used, total[used].astype(np.int64)


def choose(path: str, counts: Counter) -> Units:
    """The units that occur most in words with these counts, ties by id."""
    words = sorted(counts)
    codes, totals = Units(path, []).counted(words, np.array([counts[w] for w in words], np.int64))
    return chosen(path, codes, totals)


def chosen(path: str, codes: np.ndarray, totals: np.ndarray) -> Units:
    """The units (as ``Units.counted`` gives them) that occur most, ties by id."""
    top = codes[np.lexsort((codes, -totals))][: UNITS - _FREE].tolist()
    return Units(path, [(c >> 1, bool(c & 1)) for c in top])


def windows(seq: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (n, WINDOW), targets (n, SCORED) and which windows begin a text, for texts that begin at starts of seq."""
    lengths = np.diff(np.append(starts, len(seq)))
    per = -(-lengths // SCORED)
    text = np.repeat(np.arange(len(starts)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    at = number[:, None] * SCORED + np.arange(-CONTEXT, SCORED)[None, :]  # place of the target in its text
    inside = (at >= 1) & (at < lengths[text][:, None])
    shown = np.where(inside, seq[np.where(inside, starts[text][:, None] + at - 1, 0)], END)
    target = at[:, CONTEXT:]
    real = target < lengths[text][:, None]
    goal = np.where(real, seq[np.where(real, starts[text][:, None] + target, 0)], -1)
    return shown, goal, number == 0


#: Units of a text that come before a stretch of it, and what fills the window that holds them.
_BEFORE = CONTEXT + 1
_FILL = np.full(SCORED - _BEFORE, END, np.int64)


def stretch_windows(before: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As windows, for a stretch of a text: ``before`` ends with at least _BEFORE units before it, or is empty where the text begins."""
    if not len(before):
        return windows(seq, np.array([0]))
    shown, goal, first = windows(np.concatenate([_FILL, before[-_BEFORE:], seq]), np.array([0]))
    return shown[1:], goal[1:], first[1:]


class Attention:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "embed": normal(UNITS, DIM, scale=0.3), "place": normal(WINDOW, DIM, scale=0.1),
            "q": normal(DIM, DIM, scale=DIM**-0.5), "k": normal(DIM, DIM, scale=DIM**-0.5), "v": normal(DIM, DIM, scale=DIM**-0.5),
            "o": normal(DIM, DIM, scale=DIM**-0.5), "w1": normal(DIM, HIDDEN, scale=DIM**-0.5), "b1": np.zeros(HIDDEN, np.float32),
            "w2": normal(HIDDEN, DIM, scale=HIDDEN**-0.5), "b2": np.zeros(DIM, np.float32),
            "class": normal(DIM, CLASSES, scale=0.1), "class_b": np.zeros(CLASSES, np.float32),
            "unit": normal(CLASSES, DIM, PER_CLASS, scale=0.1), "unit_b": np.zeros((CLASSES, PER_CLASS), np.float32),
        }
        at = np.arange(WINDOW)
        self.held: dict[str, np.ndarray] = {}
        self.mask = np.where(at[None, :] <= at[CONTEXT:, None], 0, -1e9).astype(np.float32)
        self.first = self.mask + np.where(at[None, :] < CONTEXT, -1e9, 0).astype(np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "held"}

    def __setstate__(self, state):
        self.__dict__.update(state, held={})

    def _room(self, name: str, *shape: int, kind=None) -> np.ndarray:
        """An array that is used again for each batch: fresh ones of this size come from the system page by page, which took half of the time."""
        kind, size = np.dtype(kind or self.p["embed"].dtype), int(np.prod(shape))
        held = self.held.get(name)
        if held is None or held.size < size or held.dtype != kind:
            held = self.held[name] = np.empty(size, kind)
        return held[:size].reshape(shape)

    def _body(self, shown: np.ndarray, first: np.ndarray):
        """What the output layer reads, and what the gradient needs; all stand in arrays that the next batch overwrites."""
        p, n, room = self.p, len(shown), self._room
        rows = n * SCORED
        x = np.take(p["embed"], shown, axis=0, out=room("x", n, WINDOW, DIM), mode="clip")
        x += p["place"]
        xq = room("xq", rows, DIM)
        xq.reshape(n, SCORED, DIM)[:] = x[:, CONTEXT:]
        flat = x.reshape(-1, DIM)
        q = np.matmul(xq, p["q"], out=room("q", rows, DIM)).reshape(n, SCORED, DIM)
        kv = np.matmul(flat, np.concatenate([p["k"], p["v"]], 1), out=room("kv", n * WINDOW, 2 * DIM)).reshape(n, WINDOW, 2 * DIM)
        s = np.matmul(q, kv[:, :, :DIM].transpose(0, 2, 1), out=room("s", n, SCORED, WINDOW))
        s *= DIM**-0.5
        s += self.mask
        some = np.flatnonzero(first)
        if len(some):
            s[some] += self.first
        np.minimum(s, 30, out=s)
        np.exp(s, out=s)
        s /= (s.reshape(-1, WINDOW) @ np.ones(WINDOW, s.dtype)).reshape(n, SCORED, 1)
        a = np.matmul(s, kv[:, :, DIM:], out=room("a", n, SCORED, DIM)).reshape(-1, DIM)
        g = np.matmul(a, p["o"], out=room("g", rows, DIM))
        g += xq
        r = np.matmul(g, p["w1"], out=room("r", rows, HIDDEN))
        r += p["b1"]
        np.maximum(r, 0, out=r)
        h = np.matmul(r, p["w2"], out=room("h", rows, DIM))
        h += g
        h += p["b2"]
        return h, (x, xq, flat, q, kv, s, a, g, r)

    def log_probs(self, shown: np.ndarray, goal: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of each target, in the order of the windows; 0 where there is none."""
        out = np.zeros(goal.shape, np.float32)
        scorer = _Scorer(self)
        for at in range(0, len(shown), CHUNK):
            scorer.into(out[at : at + CHUNK], shown[at : at + CHUNK], goal[at : at + CHUNK], first[at : at + CHUNK])
        return out

    def gradients(self, shown: np.ndarray, goal: np.ndarray, first: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, n, room = self.p, len(shown), self._room
        h, (x, xq, flat, q, kv, s, a, g, r) = self._body(shown, first)
        k, v = kv[:, :, :DIM], kv[:, :, DIM:]
        want = goal.astype(np.int16).ravel()
        order = np.argsort(want, kind="stable")  # a radix sort; places without a target come first
        order = order[np.count_nonzero(want < 0) :]
        want = want[order].astype(np.intp)
        at, total = np.arange(len(want)), max(1, len(want))
        bounds = np.searchsorted(want, np.arange(CLASSES + 1) * PER_CLASS)
        of_class = [(c, int(bounds[c]), int(bounds[c + 1])) for c in range(CLASSES) if bounds[c + 1] > bounds[c]]
        d: dict[str, np.ndarray] = {}
        value = 0.0
        ones = np.ones(max(len(want), WINDOW, n * SCORED, CLASSES, PER_CLASS), h.dtype)  # sums as products, which take less time

        def soft(z, pick):
            nonlocal value
            if z.size and (z.max() > 60 or z.min() < -60):
                z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            z /= (z @ ones[: z.shape[1]])[:, None]
            value -= float(np.log(z[at, pick] + 1e-30).sum())
            z[at, pick] -= 1
            z *= h.dtype.type(1 / total)

        ho = np.take(h, order, axis=0, out=room("ho", len(want), DIM), mode="clip")
        dz = np.matmul(ho, p["class"], out=room("dz", len(want), CLASSES))
        dz += p["class_b"]
        soft(dz, want // PER_CLASS)
        d["class"], d["class_b"] = ho.T @ dz, ones[: len(dz)] @ dz
        dho = np.matmul(dz, p["class"].T, out=room("dho", len(want), DIM))
        d["unit"], d["unit_b"] = np.zeros_like(p["unit"]), np.zeros_like(p["unit_b"])
        du = room("du", len(want), PER_CLASS)
        for c, i, j in of_class:
            np.matmul(ho[i:j], p["unit"][c], out=du[i:j])
            du[i:j] += p["unit_b"][c]
        soft(du, want % PER_CLASS)
        back = room("back", len(want), DIM)
        for c, i, j in of_class:
            own = du[i:j]
            np.matmul(ho[i:j].T, own, out=d["unit"][c])
            np.matmul(ones[: j - i], own, out=d["unit_b"][c])
            np.matmul(own, p["unit"][c].T, out=back[i:j])
        dho += back
        dh = room("dh", *h.shape)
        dh[:] = 0
        dh[order] = dho
        rows = ones[: len(dh)]
        d["w2"], d["b2"] = r.T @ dh, rows @ dh
        dr = np.matmul(dh, p["w2"].T, out=room("dr", *r.shape))
        dr *= np.greater(r, 0, out=room("above", *r.shape, kind=bool))
        d["w1"], d["b1"] = g.T @ dr, rows @ dr
        dg = np.matmul(dr, p["w1"].T, out=room("dg", *h.shape))
        dg += dh
        d["o"] = a.T @ dg
        da = np.matmul(dg, p["o"].T, out=room("da", *h.shape)).reshape(n, SCORED, DIM)
        dkv = room("dkv", *kv.shape)
        np.matmul(s.transpose(0, 2, 1), da, out=dkv[:, :, DIM:])
        ds = np.matmul(da, v.transpose(0, 2, 1), out=room("ds", *s.shape))
        ds -= np.einsum("nij,nij->ni", da, a.reshape(n, SCORED, DIM))[:, :, None]  # the row sums of ds * s
        ds *= s
        ds *= h.dtype.type(DIM**-0.5)
        dq = np.matmul(ds, k, out=room("dq", *q.shape)).reshape(-1, DIM)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :DIM])
        dkv = dkv.reshape(-1, 2 * DIM)
        both = flat.T @ dkv
        d["q"], d["k"], d["v"] = xq.T @ dq, both[:, :DIM], both[:, DIM:]
        dx = np.matmul(dkv, np.concatenate([p["k"], p["v"]], 1).T, out=room("dx", *flat.shape)).reshape(x.shape)
        dg += np.matmul(dq, p["q"].T, out=room("back of q", *h.shape))
        dx[:, CONTEXT:] += dg.reshape(n, SCORED, DIM)
        d["place"] = (ones[:n] @ dx.reshape(n, -1)).reshape(WINDOW, DIM)
        d["embed"] = np.zeros_like(p["embed"])
        units = shown.astype(np.int16).ravel()
        order = np.argsort(units, kind="stable")
        sizes = np.bincount(units, minlength=UNITS)
        used = np.flatnonzero(sizes)
        d["embed"][used] = np.add.reduceat(np.take(dx.reshape(-1, DIM), order, axis=0, out=room("by unit", *flat.shape), mode="clip"), (np.cumsum(sizes) - sizes)[used], axis=0)
        return value / total, d

    def train(self, shown: np.ndarray, goal: np.ndarray, first: np.ndarray, steps: int = STEPS, seed: int = 11, *, rate: float = RATE, fresh: bool = True) -> list[float]:
        """Adam on batches drawn anew each time round, the last one shorter; the rate falls to nothing over the steps.  A net that isn't fresh goes on from its weights."""
        if not len(shown):
            return []
        if fresh:
            self._frequencies(goal)
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        u = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, order, at = [], rng.permutation(len(shown)), 0
        for step in range(1, steps + 1):
            if at >= len(order):
                order, at = rng.permutation(len(shown)), 0
            rows = order[at : at + BATCH]
            at += BATCH
            loss, d = self.gradients(shown[rows], goal[rows], first[rows])
            losses.append(loss)
            now = rate * min(1, step / 50) * (1 - step / (steps + 1))
            for k, grad in d.items():
                m[k] += 0.1 * (grad - m[k])
                u[k] += 0.01 * (grad * grad - u[k])
                self.p[k] -= (now / (1 - 0.9**step)) * m[k] / (np.sqrt(u[k] / (1 - 0.99**step)) + 1e-8)
        return losses

    def _frequencies(self, goal: np.ndarray) -> None:
        """Output biases begin at the units' frequencies."""
        counts = np.bincount(goal[goal >= 0], minlength=UNITS).astype(np.float64) + 0.1
        table = counts.reshape(CLASSES, PER_CLASS)
        self.p["class_b"] = np.log(table.sum(1) / table.sum()).astype(np.float32)
        self.p["unit_b"] = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


class _Scorer:
    """The net's forward pass over CHUNK windows at a time, in arrays that are used again.

    What depends on one unit or one place alone (its projections to query, key and
    value) comes from tables instead of a product for each window.
    """

    def __init__(self, net: Attention):
        p, self.net = net.p, net
        scale = np.float32(DIM**-0.5)
        self.ahead, self.ahead_place = (np.concatenate([x, x @ p["q"] * scale], 1) for x in (p["embed"], p["place"][CONTEXT:]))
        self.around, self.around_place = (np.concatenate([x @ p["k"], x @ p["v"]], 1) for x in (p["embed"], p["place"]))
        rows = CHUNK * SCORED

        def room(*shape):
            return np.empty(shape, np.float32)

        self.xq, self.kv, self.kt = room(CHUNK, SCORED, 2 * DIM), room(CHUNK, WINDOW, 2 * DIM), room(CHUNK, DIM, WINDOW)
        self.s, self.a, self.g, self.h = room(CHUNK, SCORED, WINDOW), room(CHUNK, SCORED, DIM), room(rows, DIM), room(rows, DIM)
        self.r, self.ho, self.z, self.u = room(rows, HIDDEN), room(rows, DIM), room(rows, CLASSES), room(rows, PER_CLASS)
        self.window, self.of_class = np.ones(WINDOW, np.float32), np.ones(max(CLASSES, PER_CLASS), np.float32)

    def _hidden(self, shown: np.ndarray, first: np.ndarray) -> np.ndarray:
        p, n = self.net.p, len(shown)
        rows = n * SCORED
        xq, kv, kt, s, a = self.xq[:n], self.kv[:n], self.kt[:n], self.s[:n], self.a[:n]
        g, r, h = self.g[:rows], self.r[:rows], self.h[:rows]
        np.take(self.ahead, shown[:, CONTEXT:], axis=0, out=xq, mode="clip")
        xq += self.ahead_place
        np.take(self.around, shown, axis=0, out=kv, mode="clip")
        kv += self.around_place
        kt[:] = kv[:, :, :DIM].transpose(0, 2, 1)
        np.matmul(xq[:, :, DIM:], kt, out=s)
        s += self.net.mask
        some = np.flatnonzero(first)
        if len(some):
            s[some] += self.net.first
        np.minimum(s, 30, out=s)
        np.exp(s, out=s)
        np.matmul(s, kv[:, :, DIM:], out=a)
        a /= (s.reshape(-1, WINDOW) @ self.window).reshape(n, SCORED, 1)
        np.matmul(a.reshape(-1, DIM), p["o"], out=g)
        g += xq[:, :, :DIM].reshape(-1, DIM)
        np.matmul(g, p["w1"], out=r)
        r += p["b1"]
        np.maximum(r, 0, out=r)
        np.matmul(r, p["w2"], out=h)
        h += g
        h += p["b2"]
        return h

    def into(self, out: np.ndarray, shown: np.ndarray, goal: np.ndarray, first: np.ndarray) -> None:
        p = self.net.p
        h = self._hidden(shown, first)
        want = goal.astype(np.int16).ravel()
        order = np.argsort(want, kind="stable")  # a radix sort; places without a target come first
        want = want[order]
        order = order[np.searchsorted(want, 0) :]
        want = want[len(want) - len(order) :].astype(np.intp)
        n = len(want)
        ho, z, u = self.ho[:n], self.z[:n], self.u[:n]
        np.take(h, order, axis=0, out=ho, mode="clip")
        np.matmul(ho, p["class"], out=z)
        z += p["class_b"]
        np.minimum(z, 60, out=z)
        bounds = np.searchsorted(want, np.arange(CLASSES + 1) * PER_CLASS)
        for c in range(CLASSES):
            i, j = bounds[c], bounds[c + 1]
            if j > i:
                np.matmul(ho[i:j], p["unit"][c], out=u[i:j])
                u[i:j] += p["unit_b"][c]
        np.minimum(u, 60, out=u)
        at = np.arange(n)
        value = z[at, want // PER_CLASS] + u[at, want % PER_CLASS]
        for x, width in ((z, CLASSES), (u, PER_CLASS)):
            np.exp(x, out=x)
            value -= np.log(x @ self.of_class[:width])
        found = np.zeros(out.size, np.float32)
        found[order] = value
        out[:] = found.reshape(out.shape)
