"""Classification by compressed size: zstandard dictionaries of both classes, windows compressed with each, scores.

A dictionary holds the segments of a class's texts that set it apart from the other class: word beginnings, whole words
and short character runs, kept by how much more often documents of the class have them. (Dictionaries of the library's
own trainer hold what is frequent in both classes; on the test tables they reached an area under the curve of 0.81 for
toxicity.) With ``rate_z`` there is a second pair of dictionaries: the first holds what documents of label 1 have and others
don't, the second what they have more of for their length, which any long document may hold by chance. Windows are
compressed with literals left as they are, so a size tells how much of a window a dictionary covers.

Features of a text are the differences of both sizes over its windows: the largest and least, their share, their sum,
normalised by the text's length and by its own compressed size (and, for ``whole``, so is the difference of the whole text's
sizes). No feature is a length or a size alone. A logistic regression, fitted on labelled texts that the dictionaries
haven't seen, turns them into a score, moved so that 0.5 is where the weighted rates of both classes' errors are least
together: a score orders texts and 0.5 decides, but it isn't a probability.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np

_WORD = re.compile(rb"[^\s.,;:!?\"()|]+")


@dataclass(frozen=True)
class Settings:
    window: int = 160
    dictionary_bytes: int = 12288
    min_match: int = 5
    lower: bool = True
    codes: bool = False  # windows of three-character codes, see encoded()
    level: int = -1
    runs: int = 0  # length of character runs among the segments; 0: none
    least_docs: int = 3
    min_gain: float = 2.0
    chance: float = 0.0  # of one wrong segment of label 1 in all, families counted once; 0: each segment by its own z
    rate_z: float = 0.0  # second pair: least z of the difference of rates; 0: no second pair
    rate_bytes: int = 1500
    whole: bool = False  # whether the difference of the whole text's sizes is a feature
    folds: int = 2  # of the calibration
    cost_one: float = 1.0  # of a missed label 1, against a missed label 0
    cost_zero: float = 1.0


def windows(text: bytes, size: int) -> list[bytes]:
    """The text in pieces of ``size`` bytes at most, cut at blanks where there is one in the second half."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            blank = text.rfind(b" ", at + size // 2, end)
            end = blank if blank > 0 else end
        out.append(text[at:end])
        at = end
    return out


_RNG = np.random.default_rng(77)
_T = [_RNG.integers(0, 1 << 24, 256, dtype=np.uint32) for _ in range(3)]
_CARRIER = bytes(_RNG.integers(0, 256, 48, dtype=np.uint8))


def encoded(text: bytes) -> bytes:
    """Three bytes for each run of three characters: a code that has no statistics of single characters to compress.

    A match then saves three bytes for each character after its second, so that one telling word outweighs what zstandard
    spends on naming a match, and a match needs five characters to exist (seven bytes is the least length of a match).
    """
    c = np.frombuffer(text, dtype=np.uint8)
    if len(c) < 3:
        return b""
    h = _T[0][c[2:]] ^ (_T[1][c[1:-1]] * np.uint32(3)) ^ (_T[2][c[:-2]] * np.uint32(5))
    h = (h ^ (h >> np.uint32(11))) * np.uint32(0x9E3779B1)
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()


def overlapping(text: bytes, size: int, shared: int) -> list[bytes]:
    return [text[at : at + size] for at in range(0, max(1, len(text) - shared), size - shared)]


_BEGINNINGS = (4, 5, 6, 7)


def _tallies(text: bytes, runs: int) -> dict[bytes, int]:
    """How often each segment stands in the text; runs of characters as often as they begin."""
    out: Counter[bytes] = Counter()
    for w, n in Counter(_WORD.findall(text)).items():
        if len(w) > 3:
            out[b" " + w] += n
        for k in _BEGINNINGS:
            if len(w) > k:
                out[b" " + w[:k]] += n
    if runs:
        out.update(text[i : i + runs] for i in range(len(text) - runs + 1))
    return out


class Families:
    """Texts as sets of segment numbers with tallies, and for each its family: texts that share half of their segments, and
    those that share it with them."""

    BANDS, ROWS = 20, 3

    def __init__(self, texts: list[bytes], runs: int):
        number: dict[bytes, int] = {}
        self.sets, self.shares = [], []  # of each text its segments, and how often it has each for its length in words
        for t in texts:
            tally = _tallies(t, runs)
            own = np.fromiter((number.setdefault(k, len(number)) for k in tally), dtype=np.int32, count=len(tally))
            order = np.argsort(own)
            self.sets.append(own[order])
            self.shares.append((np.fromiter(tally.values(), dtype=np.float64, count=len(tally)) / (len(t.split()) + 30))[order])
        self.names = list(number)
        hashes = np.fromiter(map(zlib.crc32, self.names), dtype=np.uint64, count=len(self.names))
        factors = np.random.default_rng(11).integers(1, 2**63, self.BANDS * self.ROWS, dtype=np.uint64) | np.uint64(1)
        self.family, buckets = list(range(len(texts))), {}
        for i, own in enumerate(self.sets):
            if not len(own):
                continue
            least = np.array([((hashes[own] + np.uint64(1)) * f >> np.uint64(20)).min() for f in factors]).reshape(self.BANDS, self.ROWS)
            for b in range(self.BANDS):
                firsts = buckets.setdefault((b, *least[b].tolist()), [])  # one text a family, as far as is known
                if not any(self._joined(i, j) for j in firsts):
                    firsts.append(i)
        self.family = [self._root(i) for i in range(len(texts))]

    def _root(self, i: int) -> int:
        while self.family[i] != i:
            i = self.family[i]
        return i

    def _joined(self, i: int, j: int) -> bool:
        a, b = self._root(i), self._root(j)
        if a != b:
            shared = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
            if 3 * shared < len(self.sets[i]) + len(self.sets[j]):  # a Jaccard similarity below a half
                return False
            self.family[max(a, b)] = min(a, b)
        return True

    def counts(self, rows: list[int]) -> tuple[int, np.ndarray]:
        """(number of families of the rows, for each segment the number of them that have it)."""
        groups: dict[int, list[int]] = {}
        for i in rows:
            groups.setdefault(self.family[i], []).append(i)
        out = np.zeros(len(self.names), dtype=np.int64)
        for own in groups.values():
            out[self.sets[own[0]] if len(own) == 1 else np.unique(np.concatenate([self.sets[i] for i in own]))] += 1
        return len(groups), out


    def rates(self, rows: list[int]) -> tuple[int, np.ndarray, np.ndarray]:
        """(number of families of the rows, for each segment the mean and variance of its share in a family's first text)."""
        first: dict[int, int] = {}
        for i in rows:
            first.setdefault(self.family[i], i)
        total, square = np.zeros(len(self.names)), np.zeros(len(self.names))
        for i in first.values():
            total[self.sets[i]] += self.shares[i]
            square[self.sets[i]] += self.shares[i] ** 2
        n = max(1, len(first))
        return n, total / n, np.maximum(0.0, square / n - (total / n) ** 2)


def _evidence(c: np.ndarray, n: int, d: np.ndarray, m: int) -> np.ndarray:
    """Minus the logarithm of the likelihood that one share explains c of n and d of m, against a share for each."""

    def part(x, total, share):
        return np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(total * share, 1e-300)), 0.0)

    r = (c + d) / (n + m)
    return part(c, n, r) + part(n - c, n, 1 - r) + part(d, m, r) + part(m - d, m, 1 - r)


def telling(texts: Families, ones: list[int], zeros: list[int], s: Settings) -> bytes:
    """Dictionary content as ``contrast`` gives it, of the segments whose excess in ``ones`` isn't chance, however rare they are."""
    (n, c), (m, d) = texts.counts(ones), texts.counts(zeros)
    at = np.flatnonzero(c >= s.least_docs)
    found = _evidence(c[at], n, d[at], m)
    fit = (c[at] / n > s.min_gain * (d[at] + 0.5) / (m + 1)) & (found > np.log(max(1, len(at)) / s.chance))
    here = {texts.names[k]: int(c[k]) for k in at[fit]}
    return _content([(float(v), texts.names[k]) for v, k in zip(found[fit], at[fit], strict=True)], here, s)


def frequent(texts: Families, ones: list[int], zeros: list[int], s: Settings) -> bytes:
    """Dictionary content of the segments that texts of ``ones`` have more often for their length."""
    (n, m1, v1), (m, m0, v0), (_, c) = texts.rates(ones), texts.rates(zeros), texts.counts(ones)
    z = (m1 - m0) / np.sqrt(v1 / n + v0 / m + 1e-12)
    at = np.flatnonzero((c >= s.least_docs) & (z > s.rate_z) & (m1 > s.min_gain * (m0 + 1e-5)))
    return _content([(float(z[k]), texts.names[k]) for k in at], {texts.names[k]: int(c[k]) for k in at}, replace(s, dictionary_bytes=s.rate_bytes))


def ordinary(texts: Families, zeros: list[int], ones: list[int], s: Settings, size: int) -> bytes:
    """Dictionary content: the commonest segments of ``zeros`` that aren't commoner in ``ones``, ``size`` bytes at most.

    Ordinary text has hardly any segment that toxic text lacks, so what is frequent stands for it. As large as the other
    dictionary, it leaves the difference of sizes to what the words say.
    """
    (n, c), (m, d) = texts.counts(zeros), texts.counts(ones)
    at = np.flatnonzero((c >= s.least_docs) & (c / max(1, n) > (d + 0.5) / (m + 1)))
    at = at[np.argsort(-c[at], kind="stable")][: max(64, size)]  # no segment is shorter than four bytes, some are passed over
    return _content([(float(c[k]), texts.names[k]) for k in at], {texts.names[k]: int(c[k]) for k in at}, replace(s, dictionary_bytes=size))


def contrast(texts: list[bytes], others: list[bytes], s: Settings) -> bytes:
    """Dictionary content: segments of ``texts``, those that set them apart most last (nearest to what is compressed)."""
    here, there = Counter(), Counter()
    for t in texts:
        here.update(_tallies(t, s.runs).keys())
    here = Counter({k: c for k, c in here.items() if c >= s.least_docs})
    for t in others:
        there.update(here.keys() & _tallies(t, s.runs).keys())
    n, m = max(1, len(texts)), max(1, len(others))
    ranked = []
    for k, c in here.items():
        p, q = c / n, (there[k] + 0.5) / (m + 1)
        z = (p - q) / np.sqrt((p * (1 - p) + 1 / n) / n + q * (1 - min(q, 0.999)) / m)
        if p > s.min_gain * q and z > 2:
            ranked.append((z, k))
    return _content(ranked, here, s)


def _content(ranked: list[tuple[float, bytes]], here, s: Settings) -> bytes:
    ranked.sort(key=lambda x: (-round(x[0], 6), -len(x[1]), x[1]))
    kept, size, body = [], 0, b""
    for _, k in ranked:
        # A beginning says all that its rarer continuations say, and these have endings that any word may have.
        if not s.runs and any(here[k] < 0.9 * here[k[:j]] for j in range(4, len(k)) if k[:j] in kept):
            continue
        if size + len(k) > s.dictionary_bytes:
            break
        if k not in body:
            if not s.runs:  # nor is a beginning kept beside a longer one that is as frequent
                kept = [x for x in kept if not (k.startswith(x) and here[k] >= 0.9 * here[x])]
            kept.append(k)
            size += len(k)
            body += k + b"\x00"
    if s.codes:
        kept = [encoded(k) for k in kept]
    return b"".join(reversed(kept)).rjust(64, b"\x00")


class Sizes:
    """Compressed sizes of short texts under one dictionary."""

    def __init__(self, content: bytes, min_match: int, level: int, carrier: bytes = b""):
        import zstandard as z

        self._carrier = carrier
        held = z.ZstdCompressionDict(content + carrier, dict_type=z.DICT_TYPE_RAWCONTENT)
        params = z.ZstdCompressionParameters.from_level(level, min_match=min_match, write_content_size=0, write_checksum=0, write_dict_id=0)
        self._compress = z.ZstdCompressor(dict_data=held, compression_params=params).compress

    def __call__(self, text: bytes) -> int:
        # The carrier ends every window: its match pays for the block's headers, and no word is too near the end to match.
        return len(self._compress(text + self._carrier))


def differences(text: bytes, parts: list[bytes], pos: Sizes, neg: Sizes, alone: int) -> list[float]:
    """What the differences of the windows' sizes under a pair of dictionaries say of a text; ``alone`` is its own size."""
    gains = sorted(((neg(w) - pos(w)) for w in parts), reverse=True)
    n, total = len(text), sum(gains)
    return [gains[0], sum(gains[:3]) / 3, 100.0 * total / n, 100.0 * sum(g for g in gains if g >= 3) / n, sum(g >= 3 for g in gains) / len(gains), float(np.log1p(max(0, total))), float(gains[-1]), 100.0 * total / alone]


class Model:
    """contents: the dictionaries of label 1 and 0, and those of the second pair, if there is one."""

    def __init__(self, s: Settings, *contents: bytes):
        import zstandard as z

        self.s, self.contents = s, contents
        carrier = _CARRIER if s.codes else b""
        sizes = [Sizes(c, s.min_match, s.level, carrier) for c in contents]
        self.pairs = list(zip(sizes[::2], sizes[1::2], strict=True))
        self.alone = z.ZstdCompressor(level=1, write_content_size=False).compress
        self.weights: np.ndarray | None = None
        self.center = self.scale = None

    def __reduce__(self):
        return _revive, (self.s, self.contents, self.weights, self.center, self.scale)

    @property
    def width(self) -> int:
        return 8 * len(self.pairs) + int(self.s.whole)

    def features(self, text: bytes) -> list[float]:
        """0.0 throughout for an empty text."""
        text = text.lower() if self.s.lower else text
        if not text:
            return [0.0] * self.width
        parts = overlapping(encoded(b" " + text), 3 * self.s.window, 36) if self.s.codes else windows(text, self.s.window)
        alone = len(self.alone(text)) + 20
        out = [x for pos, neg in self.pairs for x in differences(text, parts, pos, neg, alone)]
        if self.s.whole:
            pos, neg = self.pairs[0]
            out.append(100.0 * (neg(text) - pos(text)) / alone)
        return out

    def fit(self, raw: np.ndarray, labels: list[int], rounds: int = 30) -> None:
        """Logistic regression with a little ridge, on standardised features and their squares."""
        x = np.hstack([raw, raw**2])
        self.center, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.hstack([np.ones((len(x), 1)), (x - self.center) / self.scale])
        y, w = np.array(labels, dtype=float), np.zeros(x.shape[1])
        ridge = np.full(x.shape[1], 0.5)
        ridge[0] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        z = x @ w
        order = np.argsort(z, kind="stable")
        z, y = z[order], y[order]
        # The score is 0.5 where the rates of both classes' errors, weighted, are least together.
        missed = np.concatenate(([0], np.cumsum(y))) / max(1, y.sum())
        taken = (1 - y).sum() - np.concatenate(([0], np.cumsum(1 - y)))
        cost = missed * self.s.cost_one + taken / max(1, (1 - y).sum()) * self.s.cost_zero
        best = np.flatnonzero(cost <= cost.min() + 1e-12)
        k = int(best[len(best) // 2])
        w[0] -= float(np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))[k])
        self.weights = w

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        raw = np.array([self.features(t) for t in texts], dtype=float)
        x = (np.hstack([raw, raw**2]) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + np.clip(x, -20, 20) @ self.weights[1:], -30, 30)))


def _revive(s, contents, weights, center, scale):
    out = Model(s, *contents)
    out.weights, out.center, out.scale = weights, center, scale
    return out


def train(texts: list[bytes], labels: list[int], s: Settings) -> Model:
    """Dictionaries from all texts; the calibration sees each text through dictionaries made without its fold."""
    read = [t.lower() for t in texts] if s.lower else texts
    families, folds = Families(read, s.runs) if s.chance else None, s.folds

    def model(rows: list[int]) -> Model:
        own, others = [i for i in rows if labels[i]], [i for i in rows if not labels[i]]
        if not families:
            ones, zeros = [read[i] for i in own], [read[i] for i in others]
            return Model(s, contrast(ones, zeros, s), contrast(zeros, ones, s))
        contents = [telling(families, own, others, s)] + ([frequent(families, own, others, s)] if s.rate_z else [])
        return Model(s, *(x for c in contents for x in (c, ordinary(families, others, own, s, len(c) // (3 if s.codes else 1)))))

    raw: np.ndarray | None = None
    for f in range(folds):
        part = model([i for i in range(len(texts)) if i % folds != f])
        raw = np.zeros((len(texts), part.width)) if raw is None else raw
        for i in range(f, len(texts), folds):
            raw[i] = part.features(texts[i])
    out = model(list(range(len(texts))))
    out.fit(raw, labels)
    return out
