"""Tokenizing with a public vocabulary file, fast enough for whole corpora, and id for id as the library does it.

Both vocabularies cut a text before any merge: a single blank or line break between two other characters always starts a
new unit. So texts are cut there first, in windows of bytes; a unit is known by two independent 64-bit hashes of its bytes,
computed for a window at once, and each different unit is encoded by the library once and its ids are kept. A document's
ids are its units' ids, gathered. A text where that rule isn't plain (runs of white space, for bytes) or that holds the
string of a special token, which the library by its default settings makes that token, goes to the library whole.
"""

from __future__ import annotations

import re
import sys

import numpy as np

from .common import mix64

_RUN = re.compile(r"\s\s")
_KEPT = 1_000_000  # units in memory for each worker
_SLOTS = 1 << 21
_WINDOW = 1 << 17  # bytes looked at at once; a longer unit has a window of its own
_ENCODERS: dict = {}
_MARKS = ".,;:!?"
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_RNG = np.random.default_rng(1861)
#: For each of two hashes: a random word for each byte, an odd base and its inverse.
_VALUES = _RNG.integers(1, 2**63, (2, 256), dtype=np.uint64)
_BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
assert sys.byteorder == "little"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Hashes:
    """The two hashes of any stretch of a window of bytes."""

    _powers: list[tuple[np.ndarray, np.ndarray]] = []

    def __init__(self, raw: np.ndarray, values: np.ndarray):
        n = len(raw)
        if not self._powers or len(self._powers[0][0]) <= n:
            _Hashes._powers = [tuple(self._power(b, n + 1) for b in (base, pow(base, -1, 2**64))) for base in _BASES]
        self.sums = []
        for own, (up, _) in zip(values, self._powers, strict=True):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(own[raw] * up[:n], out=sums[1:])
            self.sums.append(sums)

    @staticmethod
    def _power(base: int, n: int) -> np.ndarray:
        out = np.full(max(n, _WINDOW + 1024), base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def keys(self, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> list[np.ndarray]:
        more = ((ends - starts) * 2 + kinds).astype(np.uint64)
        return [mix64((s[ends] - s[starts]) * down[starts] + more) for s, (_, down) in zip(self.sums, self._powers, strict=True)]


class _Table:
    """Ids by pairs of keys: open addressing over numbered entries, whose ids lie end to end."""

    def __init__(self):
        self.slots = np.full(_SLOTS, -1, dtype=np.int32)
        self.k1, self.k2 = np.empty(1024, dtype=np.uint64), np.empty(1024, dtype=np.uint64)
        self.starts, self.ids = np.zeros(1025, dtype=np.int64), np.empty(4096, dtype=np.uint32)
        self.n = 0

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The number of each key's entry, or -1."""
        out, todo, slot = np.full(len(k1), -1, dtype=np.int32), np.arange(len(k1)), (k1 & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(todo):
            e = self.slots[slot]
            there = e >= 0
            same = there & (self.k1[e] == k1) & (self.k2[e] == k2)
            out[todo[same]] = e[same]
            on = there & ~same
            todo, k1, k2, slot = todo[on], k1[on], k2[on], (slot[on] + 1) & (_SLOTS - 1)
        return out

    def add(self, k1: np.ndarray, k2: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        """New entries with different keys; ``ids`` end to end."""
        lo, hi, at = self.n, self.n + len(k1), int(self.starts[self.n])
        for name, need in (("k1", hi), ("k2", hi), ("starts", hi + 1), ("ids", at + len(ids))):
            old = getattr(self, name)
            if len(old) < need:
                new = np.empty(max(need, 2 * len(old)), dtype=old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.k1[lo:hi], self.k2[lo:hi], self.ids[at : at + len(ids)] = k1, k2, ids
        np.cumsum(lens, out=self.starts[lo + 1 : hi + 1])
        self.starts[lo + 1 : hi + 1] += at
        self.n = hi
        self._place(lo, hi)

    def _place(self, lo: int, hi: int) -> None:
        todo = np.arange(lo, hi, dtype=np.int32)
        slot = (self.k1[lo:hi] & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            left = self.slots[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & (_SLOTS - 1)

    def shrink(self, kept: int) -> None:
        """Keeps the first ``kept`` entries: frequent units come early."""
        self.n = min(self.n, kept)
        self.slots[:] = -1
        self._place(0, self.n)

    def gather(self, entries: np.ndarray, spare: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids end to end) of entries, with ``spare`` places after each."""
        starts, lens = self.starts[entries], self.starts[entries + 1] - self.starts[entries]
        ends = np.cumsum(lens + spare)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens - spare), lens + spare)
        return lens, self.ids[np.minimum(at, max(0, len(self.ids) - 1))]


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers, without special tokens."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.added = [a["content"] for a in added]
        kinds = [spec["pre_tokenizer"]["type"], (spec.get("normalizer") or {}).get("type")]
        #: Bytes keep their blanks; words drop white space; any other kind is never cut.
        self.mode = {("ByteLevel", None): "bytes", ("Sequence", "Sequence"): "words"}.get(tuple(kinds), "whole")
        if any(a.get("normalized") for a in added):  # found in what the normaliser makes of a text, not in the text
            self.mode = "whole"
        self.table = _Table()
        self.values = _VALUES.copy()
        if self.mode == "words":  # which lower-cases, so that letters that differ in case only hash alike
            self.values[:, 0x41:0x5B] = self.values[:, 0x61:0x7B]
        vocabulary = self.tokenizer.get_vocab()
        #: Whether a token begins a unit of letters (bytes) or ends one (words).
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if self.mode == "bytes" else t.endswith("</w>"))]] = True
        self.newline = self._ids(["\n"])[0] if self.mode == "bytes" else np.empty(0, dtype=np.uint32)
        marks = {m: ids for m, ids in zip(_MARKS, self._ids(list(_MARKS)), strict=True) if len(ids) == 1}
        self.marks = np.zeros(256, dtype=bool)
        self.mark_ids = np.zeros(256, dtype=np.uint32)
        for m, ids in marks.items():
            self.marks[ord(m)], self.mark_ids[ord(m)] = True, ids[0]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids end to end) of units of plain letters, which are encoded as one text and told apart by its tokens."""
        if not words:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint32)
        lead = ("\n" if kind else " ") if self.mode == "bytes" else ""
        ids = self._ids([lead + (lead or " ").join(words)])[0]
        at = np.flatnonzero(ids == self.newline[0] if kind else self.edge[ids])
        edges = np.append(at, len(ids)) if self.mode == "bytes" else np.append(0, at + 1)
        if len(edges) != len(words) + 1 or edges[0] != 0 or edges[-1] != len(ids):
            each = self._ids([lead + w for w in words])
            return np.array([len(x) for x in each]), np.concatenate(each)
        return np.diff(edges), ids

    def _learn(self, data: bytes, raw: np.ndarray, hashes: _Hashes, starts, ends, kinds, k1, k2) -> None:
        """Makes entries of units that have none. A mark after a letter or digit is a unit of its own to the library, so
        "word," and "word." share the work for "word"; after any other character ("...", "?!", ").") it is not."""
        last = raw[ends - 1]
        mark = (ends - starts > 1) & self.marks[last]
        before = raw[ends - 2]
        for i in np.flatnonzero(mark & (before >= 0x80)).tolist():
            c = data[ends[i] - 3 : ends[i] - 1].decode(errors="ignore")
            mark[i] = c.isalpha() and c < "ɐ" and c != "İ"
        mark &= (before >= 0x80) | _ALNUM[before]
        cores = ends - mark
        c1, c2 = hashes.keys(starts, cores, kinds)
        core = self.table.find(c1, c2)
        _, first = np.unique(c1[core < 0], return_index=True)
        new = np.flatnonzero(core < 0)[first]
        plain = np.zeros(len(new), dtype=bool)
        texts = []
        for i, (lo, hi) in enumerate(zip(starts[new].tolist(), cores[new].tolist(), strict=True)):
            t = data[lo:hi].decode()
            texts.append(t)
            plain[i] = t.isalpha() and (t.isascii() or max(t) < "ɐ" and "İ" not in t)
        for kind in (0, 1):
            own = np.flatnonzero(plain & (kinds[new] == kind))
            lens, ids = self._letters([texts[i] for i in own], kind)
            self.table.add(c1[new[own]], c2[new[own]], lens, ids)
        core = self.table.find(c1, c2)
        marked = np.flatnonzero(mark & (core >= 0))
        lens, ids = self.table.gather(core[marked], 1)
        ids[np.cumsum(lens + 1) - 1] = self.mark_ids[last[marked]]
        self.table.add(k1[marked], k2[marked], lens + 1, ids)
        rest = np.flatnonzero(core < 0)
        if len(rest):
            lead = " " if self.mode == "bytes" else ""
            each = self._ids([("" if kind else lead) + data[lo:hi].decode() for lo, hi, kind in zip(starts[rest].tolist(), ends[rest].tolist(), kinds[rest].tolist(), strict=True)])
            each = [np.concatenate([self.newline, x]) if kind else x for x, kind in zip(each, kinds[rest].tolist(), strict=True)]
            self.table.add(k1[rest], k2[rest], np.array([len(x) for x in each], dtype=np.int64), np.concatenate(each))

    def _window(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where units are led in, their numbers of ids, the ids) of bytes that begin with a blank or line break."""
        raw = np.frombuffer(data, dtype=np.uint8)
        seps = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
        starts, ends = seps + 1, np.append(seps[1:], len(raw))
        kinds = (raw[seps] == 0x0A).astype(np.int64) if self.mode == "bytes" else np.zeros(len(seps), dtype=np.int64)
        hashes = _Hashes(raw, self.values)
        k1, k2 = hashes.keys(starts, ends, kinds)
        if self.table.n > _KEPT:
            self.table.shrink(_KEPT // 2)
        entries = self.table.find(k1, k2)
        while len(late := np.flatnonzero(entries < 0)):
            _, first = np.unique(k1[late], return_index=True)
            own = late[first]
            self._learn(data, raw, hashes, starts[own], ends[own], kinds[own], k1[own], k2[own])
            entries[late] = self.table.find(k1[late], k2[late])
        lens, ids = self.table.gather(entries)
        return seps, lens, ids

    def _cut(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts that may be cut at every blank and line break."""
        data, out = b"".join([b"\n" + t for t in texts]), [[] for _ in texts]
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        lo = 0
        while lo < len(data):
            hi = len(data)
            if hi - lo > _WINDOW:
                hi = max(data.rfind(b" ", lo + 1, lo + _WINDOW), data.rfind(b"\n", lo + 1, lo + _WINDOW))
                if hi < 0:
                    after = [x for x in (data.find(b" ", lo + 1), data.find(b"\n", lo + 1)) if x > 0]
                    hi = min(after, default=len(data))
            seps, lens, ids = self._window(data[lo:hi])
            upto = np.append(0, np.cumsum(lens))
            first, last = np.searchsorted(bounds, lo, side="right") - 1, np.searchsorted(bounds, hi, side="left") - 1
            edges = upto[np.searchsorted(seps, np.maximum(bounds[first : last + 2] - lo, 0))]
            for k in range(first, last + 1):
                out[k].append(ids[edges[k - first] : edges[k - first + 1]].tobytes())
            lo = hi
        skip = 4 * len(self.newline)
        return [b"".join(x)[skip:] for x in out]

    def encode(self, texts: list[str]) -> list[bytes]:
        runs, every, added = self.mode == "bytes", self.mode == "whole", self.added
        odd = [every or bool(runs and _RUN.search(t)) or any(a in t for a in added) for t in texts]
        whole = iter(self._ids([t for t, x in zip(texts, odd, strict=True) if x]))
        cut = iter(self._cut([t.encode() for t, x in zip(texts, odd, strict=True) if not x]))
        return [next(whole).tobytes() if x else next(cut) for x in odd]


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def in_parts(texts: list, limit: int = 2 << 20):
    """Runs of ``texts`` of about ``limit`` characters, so that what a batch needs at once is bounded."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part
