"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

The patterns give the base findings, which always stay.  Candidates are their values and every other
token of at least ``TOKEN`` code points, whatever its alphabet: a run without white space, quotes,
brackets, commas, semicolons, colons and equals signs, less signs at its ends.  All are scored, those
of base findings for information.  The network, all in numpy: character classes are embedded, one
convolution runs once over the whole text, its outputs are pooled over the whole candidate (largest
and mean) and over ``BEFORE`` and ``AFTER`` characters around it, and a hidden and a logistic layer
tell secrets from other tokens.  A candidate may be of any length; a text is taken in slices.

The network is trained on a bounded sample of labelled findings: ``FIT_ROWS`` values of base
findings against four times as many tokens drawn evenly and twice as many hard ones (next to findings,
or with digits or signs in them), ``PER_TEXT`` of a sort at most from a text, each with its first ``FIT_CHARS``
characters.  Every labelled
finding comes with varied copies, ``VARIED`` times ``FIT_ROWS`` in all: of other length and alphabet, parted by signs, in the
context of an ordinary token or in none; a quarter of the other tokens stand in the context of a
finding, and three in ten are in capitals or several joined by signs, as paths and names are.  Three tenths of the sample, parted before that, aren't trained on.  Everything that isn't, in all documents, calibrates the
scores: every other finding with varied copies and every other token, counted by logit in bins of ``1 / _FINE``.  The threshold
is the highest bin's edge at which ``RECALL`` of all these findings and copies are kept.

Rows: null text is empty; null and repeated doc_id values pass through, one row each; without any
labelled finding nothing is added to the base; an empty table gives an empty result; other columns
are ignored (by ``redact``: kept).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled findings of the sample, at most; four times as many other tokens, and twice as many hard ones.
FIT_ROWS = 3000
FIT_CHARS = 256
PER_TEXT = 5
VARIED = 3
RECALL = 0.99
#: Shortest further candidate.
TOKEN = 8
BEFORE, AFTER = 24, 8
KINDS = ("assign", "access", "hex", "network")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    """Findings of the patterns, by start, then kind.  The patterns with a least length find the same
    as a whole run that is then measured, since a run's other matches are shorter."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def value_start(text: str, span: Span) -> int:
    """Where the value of a base finding begins: an assignment's name is left out."""
    a, kind, b = span
    return _ASSIGN.match(text, a, b).start(2) if kind == 0 else a


# -- characters and candidates --------------------------------------------------------------------

_CLASSES = 64
_DIGIT, _SIGN, _OTHER = 53, 62, 63


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point (larger ones as the last): class of a character, whether it parts tokens, and
    whether it is left out at a token's ends.  Classes: 0 blank, a-z, A-Z, digits, signs, the rest."""
    kind = np.full(0x10001, _OTHER, np.uint8)
    kind[:128] = _SIGN
    parts = np.zeros(0x10001, bool)
    for c in map(chr, range(0x10000)):
        if c.isspace() or ord(c) < 32:
            kind[ord(c)] = 0
            parts[ord(c)] = True
    for k in range(26):
        kind[ord("a") + k], kind[ord("A") + k] = 1 + k, 27 + k
    kind[ord("0") : ord("9") + 1] = _DIGIT
    for k, signs in enumerate(("=", ":", "\"'`", "+/", "_", "-", ".", "@")):
        kind[[ord(s) for s in signs]] = _DIGIT + 1 + k
    parts[[ord(s) for s in "\"'`,;<>()[]{}=:"]] = True
    edge = np.zeros(0x10001, bool)
    edge[:128] = (kind[:128] == _SIGN) | (np.arange(128) == ord("."))
    return kind, parts, edge


_KIND, _PARTS, _EDGE = _tables()


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x10000)


def tokens(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the candidates among characters that end with a parting one."""
    inner = ~_PARTS[codes]
    core = np.flatnonzero(inner & ~_EDGE[codes])
    if not len(core):
        return core, core
    run = np.cumsum(~inner, dtype=np.int32)[core]  # the same within a run
    turn = np.flatnonzero(run[1:] != run[:-1])
    a, b = core[np.r_[0, turn + 1]], core[np.r_[turn, len(core) - 1]] + 1
    keep = b - a >= TOKEN
    return a[keep], b[keep]


class Block:
    """Texts side by side, far enough apart not to see each other: classes, and candidates as
    positions in them, with the text each is of and whether it is a base finding's value."""

    _GAP = BEFORE + AFTER

    def __init__(self, texts: list[str], bases: list[list[Span]]):
        gap = " " * self._GAP
        codes = _codes(gap + gap.join(texts) + gap)
        self.offset = np.cumsum([self._GAP, *[len(t) + self._GAP for t in texts]])[:-1]
        a, b = tokens(codes)
        self.classes = _KIND[codes]
        of = np.searchsorted(self.offset, a, "right") - 1
        found = [(self.offset[k] + s, self.offset[k] + e, self.offset[k] + value_start(texts[k], (s, kind, e)), k) for k, own in enumerate(bases) for s, kind, e in own]
        if found:
            s, e, value, text = np.array(sorted(found)).T
            end = np.maximum.accumulate(e)
            before = np.searchsorted(s, b, "left") - 1  # last finding that starts before the candidate's end
            touched = (before >= 0) & (end[before] > a)
            a, b, of = np.r_[a[~touched], value], np.r_[b[~touched], e], np.r_[of[~touched], text]
            self.base = np.r_[np.zeros(int((~touched).sum()), bool), np.ones(len(s), bool)]
            order = np.argsort(a, kind="stable")
            a, b, of, self.base = a[order], b[order], of[order], self.base[order]
        else:
            self.base = np.zeros(len(a), bool)
        self.a, self.b, self.of = a, b, of


# -- the network ----------------------------------------------------------------------------------

_WIDTH = 4
#: Characters that are convolved at a time.
_SLICE = 1 << 14
#: Logits are counted in bins of 1 / _FINE; the first and last of the 2 * _BINS hold what lies beyond.
_FINE, _BINS = 64, 4096


class Network:
    """Embedding, one convolution, pooling over candidate and context apart, two layers."""

    def __init__(self, seed: int = 7, size: int = 8, filters: int = 8, hidden: int = 16):
        r = np.random.default_rng(seed)
        self.filters = filters
        self.p = {
            "e": r.normal(0, 0.5, (_CLASSES, size)),
            "w": r.normal(0, (_WIDTH * size) ** -0.5, (_WIDTH, size, filters)),
            "c": np.zeros(filters),
            "u": r.normal(0, (4 * filters) ** -0.5, (4 * filters, hidden)),
            "d": np.zeros(hidden),
            "v": r.normal(0, hidden**-0.5, hidden),
            "b": np.zeros(1),
        }
        self.slope, self.shift, self.threshold = 1.0, 0.0, 2.0
        self._pairs = None

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def _convolved(self, classes: np.ndarray) -> np.ndarray:
        """Outputs for all but the last three characters, by tables of pairs of classes."""
        if self._pairs is None:
            t = np.einsum("cs,jsf->jcf", self.p["e"], self.p["w"])
            first, second = (t[j][:, None] + t[j + 1][None] for j in (0, 2))
            self._pairs = [(first + self.p["c"]).reshape(-1, self.filters).astype(np.float32), second.reshape(-1, self.filters).astype(np.float32)]
        pair = classes[:-1].astype(np.int32) * _CLASSES + classes[1:]
        out = self._pairs[0][pair[:-2]]
        out += self._pairs[1][pair[2:]]
        return np.maximum(out, 0, out=out)

    def pooled(self, classes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pooled outputs of candidates in order of start: before, inside (largest, mean), after."""
        f = self.filters
        out = np.empty((len(a), 4 * f), np.float32)
        k = 0
        while k < len(a):
            n = int(np.searchsorted(a, a[k] + _SLICE, "right"))
            large = np.flatnonzero(b[k:n] - a[k] > 4 * _SLICE)
            n = max(k + 1, k + int(large[0])) if len(large) else n
            if b[k] - a[k] > 4 * _SLICE:  # a very long candidate by itself
                lo, hi = int(a[k]), int(b[k])
                h = self._convolved(classes[lo - BEFORE : lo + _WIDTH - 1])
                out[k, :f] = h.max(0)
                out[k, 3 * f :] = self._convolved(classes[hi - _WIDTH + 1 : hi + AFTER - 1]).max(0)
                top, total, count = np.zeros(f, np.float32), np.zeros(f), hi - lo - _WIDTH + 1
                for s in range(lo, lo + count, _SLICE):
                    h = self._convolved(classes[s : min(s + _SLICE, lo + count) + _WIDTH - 1])
                    top, total = np.maximum(top, h.max(0)), total + h.sum(0)
                out[k, f : 2 * f], out[k, 2 * f : 3 * f] = top, total / count
                k += 1
                continue
            lo = int(a[k]) - BEFORE
            h = self._convolved(classes[lo : int(b[k:n].max()) + AFTER])
            s, e = a[k:n] - lo, b[k:n] - lo - _WIDTH + 1
            most = np.maximum.reduceat(h, np.stack([s - BEFORE, s, e, e + AFTER - 1], 1).ravel(), axis=0).reshape(-1, 4 * f)
            out[k:n, : 2 * f], out[k:n, 3 * f :] = most[:, : 2 * f], most[:, 2 * f : 3 * f]
            out[k:n, 2 * f : 3 * f] = np.add.reduceat(h, np.stack([s, e], 1).ravel(), axis=0)[::2] / (e - s)[:, None]
            k = n
        return out

    def logits(self, classes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.pooled(classes, a, b) @ self.p["u"].astype(np.float32) + self.p["d"].astype(np.float32), 0)
        return (hidden @ self.p["v"] + self.p["b"][0]).astype(float)

    def scores(self, classes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(classes, a, b) + self.shift, -40, 40)))

    def _gradients(self, classes: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of rows side by side, each a field of its own: before, inside, after, and what sees the next field."""
        p, f, n = self.p, self.filters, len(a)
        t = np.einsum("cs,jsf->jcf", p["e"], p["w"]).astype(np.float32)
        steps = len(classes) - _WIDTH
        h = t[0][classes[:steps]] + p["c"].astype(np.float32)
        for j in range(1, _WIDTH):
            h += t[j][classes[j : j + steps]]
        np.maximum(h, 0, out=h)
        e = b - _WIDTH + 1
        edges = np.stack([a - BEFORE, a, e, e + AFTER - 1], 1).ravel()
        size = np.diff(np.r_[edges, steps])
        most = np.maximum.reduceat(h, edges, axis=0)
        mean = np.add.reduceat(h, edges, axis=0).reshape(n, 4, f)[:, 1] / (e - a)[:, None]
        parts = most.reshape(n, 4, f)
        x = np.concatenate([parts[:, 0], parts[:, 1], mean, parts[:, 2]], 1)
        g = np.maximum(x @ p["u"] + p["d"], 0)
        dz = (1 / (1 + np.exp(-np.clip(g @ p["v"] + p["b"][0], -40, 40))) - y) / n
        dg = dz[:, None] * p["v"] * (g > 0)
        dx = (dg @ p["u"].T).reshape(n, 4, f)
        top = (h == np.repeat(most, size, axis=0)).astype(np.float32)
        to = np.zeros((n, 4, f), np.float32)
        to[:, 0], to[:, 1], to[:, 2] = dx[:, 0], dx[:, 1], dx[:, 3]
        even = np.zeros((n, 4, f), np.float32)
        even[:, 1] = dx[:, 2] / (e - a)[:, None]
        dh = top * np.repeat(to.reshape(-1, f) / np.maximum(1, np.add.reduceat(top, edges, axis=0)), size, axis=0)
        dh += np.repeat(even.reshape(-1, f), size, axis=0)
        dh *= h > 0
        dt = np.zeros_like(t)
        for j in range(_WIDTH):
            for k in range(f):
                dt[j, :, k] = np.bincount(classes[j : j + steps], dh[:, k], _CLASSES)
        return {
            "e": np.einsum("jcf,jsf->cs", dt, p["w"]), "w": np.einsum("cs,jcf->jsf", p["e"], dt), "c": dh.sum(0),
            "u": x.T @ dg, "d": dg.sum(0), "v": g.T @ dz, "b": np.array([dz.sum()]),
        }

    def train(self, rows: list[tuple[str, str, str]], y: np.ndarray, seed: int = 7, rounds: int = 10, batch: int = 256, rate: float = 0.02) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for turn in range(rounds):
            order = r.permutation(len(rows))
            now = rate * 0.75**turn
            for k in range(0, len(rows), batch):
                own = order[k : k + batch]
                t += 1
                for name, g in self._gradients(*side_by_side([rows[i] for i in own]), y[own]).items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    s[name] = 0.999 * s[name] + 0.001 * g * g
                    self.p[name] = self.p[name] - now * (m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.999**t)) + 1e-8)
        self._pairs = None

    def calibrate(self, rows: list[tuple[str, str, str]], y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling, and the highest threshold that keeps ``recall`` of the findings."""
        if not len(rows) or not y.any():
            return
        where = side_by_side(rows)
        self._platt(self.logits(*where), y, np.ones(len(y)))
        found = np.sort(self.scores(*where)[y == 1])
        self.threshold = float(found[int((1 - recall) * len(found))])

    def calibrate_counts(self, good: np.ndarray, bad: np.ndarray, recall: float = RECALL) -> None:
        """The same by numbers of findings and of other tokens in bins of logits."""
        edges = np.arange(-_BINS, _BINS) / _FINE
        middle = np.r_[edges, edges] + 0.5 / _FINE
        n = np.r_[good, bad].astype(float)
        self._platt(middle[n > 0], np.repeat([1.0, 0.0], 2 * _BINS)[n > 0], n[n > 0])
        lost = int((1 - recall) * good.sum())
        least = edges[np.searchsorted(np.cumsum(good), lost, "right")]
        self.threshold = float(1 / (1 + np.exp(-np.clip(self.slope * least + self.shift, -40, 40))))

    def _platt(self, logits: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        z = np.stack([logits, np.ones(len(y))], 1)
        found, bad = (n * y).sum(), (n * (1 - y)).sum()
        w = np.array([1.0, 0.0])
        goal = np.where(y == 1, (found + 1) / (found + 2), 1 / (bad + 2))  # Platt's targets, short of 0 and 1
        for _ in range(25):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            w = w - np.linalg.solve((z * (n * (p * (1 - p) + 1e-6))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (n * (p - goal)) + 1e-3 * (w - [1.0, 0.0]))
        if w[0] > 0 and np.isfinite(w).all():
            self.slope, self.shift = map(float, w)


def side_by_side(rows: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of (before, candidate, after) in fields of their own, and where the candidates are."""
    before, inside, after = zip(*rows, strict=True)
    text = "".join(f"{p[-BEFORE:]:>{BEFORE}}{t}{q[:AFTER]:<{AFTER}}" for p, t, q in rows) + " " * _WIDTH
    size = np.array([len(t) for t in inside])
    a = np.cumsum(size + BEFORE + AFTER) - size - AFTER
    return _KIND[_codes(text)], a, a + size


# -- the sample -----------------------------------------------------------------------------------

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALPHABETS = ("abcdef" + _DIGITS, _LOWER + _DIGITS, _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "-_", _LOWER + _UPPER + _DIGITS + "+/", _LOWER + _UPPER + _DIGITS + "!@#$%&*?")


def varied(value: str, r: np.random.Generator) -> str:
    """Another secret after a labelled one: characters redrawn, of other length and alphabet, in parts."""
    alphabet = _ALPHABETS[r.integers(len(_ALPHABETS))]
    size = int(r.integers(10, max(11, len(value) + 1)))
    out = ""
    while sum(map(str.isdigit, out)) < 2:  # letters alone may be a word
        out = "".join(alphabet[k] for k in r.integers(len(alphabet), size=size))
    if r.random() < 0.15:
        out = "".join(_LOWER[k] for k in r.integers(26, size=int(r.integers(2, 5)))) + "_" + out
        size = len(out)
    if size >= 16 and r.random() < 0.4:
        sign = "._-"[r.integers(3)]
        cuts = sorted(r.choice(np.arange(2, size - 2), int(r.integers(1, 3)), replace=False))
        out = sign.join(out[i:j] for i, j in zip([0, *cuts], [*cuts, size], strict=True))
    return out.strip("!#$%&*?.") or value


def number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


def some(rows: np.ndarray, pick: int) -> set[int]:
    """``PER_TEXT`` at most, by the text's hash."""
    return {int(rows[(pick >> s) % len(rows)]) for s in range(0, 8 * PER_TEXT, 8)} if len(rows) else set()


def labelled(docs: DataFrame) -> DataFrame:
    """y (1: value of a base finding, 0: any token, 2: a hard one; 3: a further finding of the text), its context and
    itself, and an order.  All findings are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in batches:
            out = []
            for t in batch.column(0):
                text = t.as_py()
                spans = base_spans(text)
                pick = number(text)
                block = Block([text], [spans])
                at, end = block.a - Block._GAP, block.b - Block._GAP
                for y, rows in ((1, np.flatnonzero(block.base)), (0, np.flatnonzero(~block.base))):
                    chosen = some(rows, pick)
                    out += [(y, int(at[k]), int(end[k]), text, pick) for k in chosen]
                    out += [(3, int(at[k]), int(end[k]), text, pick) for k in rows if y and int(k) not in chosen]
                near = np.zeros(len(at), bool)
                for k in np.flatnonzero(block.base):
                    near[max(0, k - 2) : k + 3] = True
                hard = np.flatnonzero(near & ~block.base)
                if not len(hard) and len(at):
                    odd = np.add.reduceat((block.classes >= _DIGIT) & (block.classes < _OTHER), np.stack([block.a, block.b], 1).ravel())[::2] > 0
                    hard = np.flatnonzero(odd & ~block.base)
                out += [(2, int(at[k]), int(end[k]), text, pick) for k in some(hard, pick)]
            rows = [(y, t[max(0, a - BEFORE) : a], t[a : min(b, a + FIT_CHARS)], t[b : b + AFTER], p) for y, a, b, t, p in out]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["y", "before", "token", "after", "pick"])

    return docs.select(common.text_of().alias("text")).mapInArrow(run, "y int, before string, token string, after string, pick long")


def sampled(rows: DataFrame, fit_rows: int = FIT_ROWS) -> list[tuple[int, str, str, str]]:
    """The bounded sample of labelled rows: y, before, token, after."""
    sample = None
    for y in (1, 0, 2):
        own = rows.where(F.col("y") == y).groupBy("y", "before", "token", "after").agg(F.min("pick").alias("pick"))
        own = own.orderBy("pick", "token", "before", "after").limit(fit_rows * (4, 1, 2)[y])
        sample = own if sample is None else sample.unionByName(own)
    got = sample.select("y", "before", "token", "after").toPandas()
    return list(got.itertuples(index=False, name=None))


def examples(sample: list[tuple[int, str, str, str]], seed: int = 7) -> tuple[list[tuple[str, str, str]], np.ndarray]:
    """Findings with their varied copies, and other tokens, some in the context of a finding."""
    r = np.random.default_rng(seed)
    found = [row[1:] for row in sample if row[0] == 1]
    other = [row[1:] for row in sample if row[0] != 1]
    rows, y = [], []
    copies = -(-VARIED * FIT_ROWS // max(1, len(found)))
    for before, value, after in found:
        rows.append((before, value, after))
        for _ in range(copies):
            new = varied(value, r)
            place = r.integers(3)
            p, _, q = other[r.integers(len(other))] if place == 1 and other else ("", "", "") if place == 2 else (before, value, after)
            rows.append((p, new, q))
    y += [1.0] * len(rows)
    for before, token, after in other:
        place = r.integers(4)
        p, _, q = found[r.integers(len(found))] if place == 1 and found else ("", "", "") if place == 2 else (before, token, after)
        form = r.random()
        if form < 0.05:
            token = token.upper()
        elif form < 0.3:
            words = [other[k][1] for k in r.integers(len(other), size=int(r.integers(2, 5)))]
            token = "".join(map(str.capitalize, words)) if form < 0.08 else "/_-."[r.integers(4)].join(words)
        rows.append((p, token, q))
    y += [0.0] * len(other)
    return rows, np.array(y)


def parted(sample: list[tuple[int, str, str, str]], seed: int = 7) -> tuple[list, list]:
    """The part that is trained on, and the part that calibrates."""
    order = np.random.default_rng(seed).permutation(len(sample))
    cut = len(sample) * 7 // 10
    return [sample[k] for k in order[:cut]], [sample[k] for k in order[cut:]]


def trained_on(train: list[tuple[int, str, str, str]]) -> Network | None:
    """A network that isn't calibrated yet; None without rows of both kinds."""
    rows, y = examples(train)
    if not y.any() or y.all():
        return None
    net = Network()
    net.train(rows, y)
    return net


def binned(logits: np.ndarray) -> np.ndarray:
    return np.bincount(np.clip(np.floor(logits * _FINE), -_BINS, _BINS - 1).astype(int) + _BINS, minlength=2 * _BINS)


def _counts(total: np.ndarray) -> pa.RecordBatch:
    (at,) = np.nonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bin", "n"])


def _summed(counts: DataFrame) -> np.ndarray:
    rows = counts.groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # a row a bin at most
    out = np.zeros(2 * _BINS, np.int64)
    out[rows["bin"].to_numpy(int)] = rows["n"].to_numpy(np.int64)
    return out


def finding_counts(rows: DataFrame, net: Network, train: list, check: list) -> np.ndarray:
    """Logits of all labelled findings that weren't trained on, and of varied copies of each, counted in bins."""
    known = {row[1:] for row in train if row[0] == 1}
    other = [row[1:] for row in check if row[0] != 1]
    found = rows.where(F.col("y").isin(1, 3)).select("before", "token", "after").distinct()
    n = found.count()
    held = n > len(known)  # else there are none but those that were trained on
    copies = max(VARIED, -(-VARIED * FIT_ROWS // max(1, n - len(known) if held else n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros(2 * _BINS, np.int64), []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row in known:
                    continue
                before, value, after = row
                own.append(row)
                r = np.random.default_rng(number("\0".join(row)))
                for _ in range(copies):
                    new = varied(value, r)
                    place = r.integers(3)
                    p, _, q = other[r.integers(len(other))] if place == 1 and other else ("", "", "") if place == 2 else row
                    own.append((p, new, q))
                if len(own) > 2000:
                    total += binned(net.logits(*side_by_side(own)))
                    own = []
        if own:
            total += binned(net.logits(*side_by_side(own)))
        yield _counts(total)

    return _summed(found.mapInArrow(run, "bin int, n long"))


def token_counts(docs: DataFrame, net: Network, train: list) -> np.ndarray:
    """Logits of every token of every text that is no finding and wasn't trained on, counted in bins."""
    sent = docs.sparkSession.sparkContext.broadcast((net, {row[1:] for row in train if row[0] != 1}))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        own, known = sent.value
        first = {row[1][:TOKEN] for row in known}
        total = np.zeros(2 * _BINS, np.int64)
        for batch in batches:
            for texts in side_by_side_texts(batch.column(0).to_pylist()):
                block = Block(texts, [base_spans(t) for t in texts])
                if not len(block.a):
                    continue
                keep = ~block.base
                shift = block.offset[block.of]
                for k, (of, a, b) in enumerate(zip(block.of.tolist(), (block.a - shift).tolist(), (block.b - shift).tolist(), strict=True)):
                    text = texts[of]
                    if text[a : a + TOKEN] in first and (text[max(0, a - BEFORE) : a], text[a : min(b, a + FIT_CHARS)], text[b : b + AFTER]) in known:
                        keep[k] = False
                total += binned(own.logits(block.classes, block.a, block.b)[keep])
        yield _counts(total)

    return _summed(docs.select(common.text_of().alias("text")).mapInArrow(run, "bin int, n long"))


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Network:
    common.shared_folder(docs.sparkSession)
    rows = labelled(docs).checkpoint()
    train, check = parted(sampled(rows, fit_rows))
    net = trained_on(train)
    if net is None:
        return Network()
    net.calibrate_counts(finding_counts(rows, net, train, check), token_counts(docs, net, train))
    return net


# -- scanning -------------------------------------------------------------------------------------

#: Code points of texts that are scanned side by side; a longer text is by itself.
_BLOCK = 1 << 17


def side_by_side_texts(texts: list[str]) -> Iterator[list[str]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _BLOCK):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def scored_spans(texts: list[str], net: Network) -> list[list[tuple[int, int, int, float]]]:
    """Base findings and the candidates that the network adds, by start, then kind, with scores."""
    out: list[list[tuple[int, int, int, float]]] = []
    for own in side_by_side_texts(texts):
        bases = [base_spans(t) for t in own]
        block = Block(own, bases)
        score = net.scores(block.classes, block.a, block.b) if net.threshold <= 1 and len(block.a) else np.zeros(len(block.a))
        known = {}
        for k in np.flatnonzero(block.base):
            known[int(block.of[k]), int(block.a[k] - block.offset[block.of[k]]), int(block.b[k] - block.offset[block.of[k]])] = float(score[k])
        rows = [[(s, kind, e, known[k, value_start(t, (s, kind, e)), e]) for s, kind, e in b] for k, (t, b) in enumerate(zip(own, bases, strict=True))]
        for k in np.flatnonzero(~block.base & (score >= net.threshold)):
            shift = block.offset[block.of[k]]
            rows[block.of[k]].append((int(block.a[k] - shift), 3, int(block.b[k] - shift), float(score[k])))
        out += [sorted(r) for r in rows]
    return out


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id and spans, an array of kind, start, end (code points) and score by start, then kind."""
    net = net or fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a network of fixed size
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scored_spans(batch.column(1).to_pylist(), sent.value)
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in row] for row in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by a mark, and n_chars, if there, counted anew."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = scored_spans([t or "" for t in texts], sent.value)
            new = pa.array([t if not s else without(t, s, mark) for t, s in zip(texts, found, strict=True)], pa.string())
            cols = [new if k == text else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def without(text: str, spans: list, mark: str) -> str:
    out, at = [], 0
    for a, _, b, *_ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))

    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind: str):
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"] != "network")
    sizes = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *sizes[:3], F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), sizes[3])
