"""Byte-pair encoding by speculation: propose, verify, and merge exactly only where that fails.

Greedy longest match over a trie proposes the tokens of every distinct word at
once. A proposal is right exactly if each pair of neighbouring tokens is its own
encoding, so all neighbouring pairs are looked up together in a table of pairs
whose compatibility is known; a pair that is new is merged exactly once and
remembered. Only the words with an incompatible pair go through the ranked
merges, again many words at a time. All steps are array operations; words that
hold characters outside a plain range, or a special token's text, are given to
the ``tokenizers`` library one by one.

Vocabulary files are read where they are installed; nothing is trained or copied.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import regex

from .common import _LOWER, _SPACE, LONG, WORD_MASK, release, span_hashes, words_at

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Words and pairs that a worker remembers at most; beyond it units that weren't asked for again, and all pairs, are
#: forgotten; results don't change.
MEMORY = 300_000
_NONE = np.int64(1 << 40)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Table:
    """An open-addressing hash table from int64 keys to int64 values, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0):
        self.bits = max(4, int(max(len(keys), room) * 2 - 1).bit_length())
        self.room = 1 << (self.bits - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        self.add(keys, values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that aren't in the table yet."""
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            at = left[free]
            self.keys[slot[at]] = keys[at]
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


class _Packed:
    """The same for keys below 2**43 and values below 2**20, one word to a slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        word, slot, left = keys << 20 | values, self._slot(keys), np.arange(len(keys))
        while len(left):
            at = left[self.slots[slot[left]] == -1]
            self.slots[slot[at]] = word[at]
            left = left[self.slots[slot[left]] != word[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        word = self.slots[slot]
        hit = word >> 20 == keys
        out = np.where(hit, word & 0xFFFFF, -1)
        left = np.flatnonzero(~hit & (word != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            word = self.slots[slot[left]]
            hit = word >> 20 == keys[left]
            out[left[hit]] = word[hit] & 0xFFFFF
            left = left[~hit & (word != -1)]
        return out


class _Grown:
    """An array that grows at its end; zeros stand behind it, eight at least."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        to = self.n + len(more)
        if to + 8 > len(self.held):
            held = np.zeros(to + to // 2 + 8, self.held.dtype)
            held[: self.n] = self.all
            self.held = held
        self.held[self.n : to] = more
        self.n = to

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class SpeculativeBpe:
    """Encodes distinct pre-tokens (byte strings) of one vocabulary; see the module's text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        raw = {c: b for b, c in letters.items()}
        self.end = bool(self.suffix)
        self.first = np.full(256, -1, np.int64)
        self.last = np.full(256, -1, np.int64)
        for b, c in letters.items():
            self.first[b] = self.vocab.get(c, -1)
            self.last[b] = self.vocab.get(c + self.suffix, -1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([self.vocab[a] << 20 | self.vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.ranks = _Packed(key, np.arange(len(pairs), dtype=np.int64))
        # Tokens as symbol lists: bytes, then 256 as the end of a word.
        self.spelled: list[tuple[bytes, bool]] = [(b"", False)] * (max(self.vocab.values()) + 1)
        edges: dict[int, int] = {}
        node_token = [-1]
        for t, i in self.vocab.items():
            ends = self.end and t.endswith(self.suffix)
            body = bytes(raw[c] for c in (t[: -len(self.suffix)] if ends else t))
            self.spelled[i] = (body, ends)
            node = 0
            for s in [*body, 256] if ends else body:
                k = node << 9 | s
                if (nxt := edges.get(k)) is None:
                    nxt = edges[k] = len(node_token)
                    node_token.append(-1)
                node = nxt
            node_token[node] = i
        self.edges = _Packed(np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges)))
        self.node_token = np.array(node_token, np.int64)
        self.known = np.zeros(0, np.int64)
        self.fits = np.zeros(0, bool)
        self.counts = {"words": 0, "merged": 0}
        everything = np.arange(len(self.spelled))
        again, n = self._merge(*self._spell(everything))
        single = n == 1
        self.own = np.zeros(len(self.spelled), bool)  # tokens that are their own encoding
        start = np.cumsum(n) - n
        self.own[single] = again[start[single]] == everything[single]

    def _symbols(self, parts: list[bytes], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(parts), np.uint8)
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        out = self.first[data]
        closing = (np.cumsum(n) - 1)[(n > 0) & ends]
        out[closing] = self.last[data[closing]]
        return out, n

    def _spell(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.spelled[t] for t in tokens.tolist()]
        return self._symbols([p[0] for p in parts], np.array([p[1] for p in parts], bool))

    def _merge(self, symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranked merges of many words at once: in each round, every word applies its best pair everywhere."""
        word = np.repeat(np.arange(len(n), dtype=np.int32), n)
        if len(symbols) and symbols.min() < 0:  # bytes that the vocabulary lacks are dropped
            keep = symbols >= 0
            symbols, word = symbols[keep], word[keep]
        out_w, out_s = [], []
        rank = np.full(len(symbols), _NONE, np.int64)  # of each symbol with the next one of its word
        self._rank(rank, np.arange(len(symbols)), symbols, word)
        while len(symbols):
            start = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1))
            size = np.diff(start, append=len(word))
            best = np.minimum.reduceat(rank, start)
            ended = best == _NONE
            stay = np.ones(len(symbols), bool)
            if ended.any():
                best[ended] = -1
                stay = ~np.repeat(ended, size)
                over = np.flatnonzero(~stay)
                out_w.append(word[over])
                out_s.append(symbols[over])
            at = np.flatnonzero(rank == np.repeat(best, size))
            run = np.ones(len(at), bool)  # of neighbouring equal pairs (aaa) every second, from the left
            run[1:] = at[1:] != at[:-1] + 1
            if not run.all():
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(run, k, 0))) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            stay[at + 1] = False
            left = np.flatnonzero(stay)
            symbols, word, rank = symbols[left], word[left], rank[left]
            at = (np.cumsum(stay) - 1)[at]
            self._rank(rank, np.concatenate((at, at[at > 0] - 1)), symbols, word)
        if not out_w:
            return np.zeros(0, np.int64), np.zeros(len(n), np.int64)
        w, s = np.concatenate(out_w), np.concatenate(out_s)
        order = np.argsort(w, kind="stable")
        return s[order], np.bincount(w, minlength=len(n)).astype(np.int64)

    def _rank(self, rank: np.ndarray, at: np.ndarray, symbols: np.ndarray, word: np.ndarray) -> None:
        rank[at] = _NONE
        at = at[at + 1 < len(word)]
        at = at[word[at] == word[at + 1]]
        got = self.ranks.get(symbols[at] << 20 | symbols[at + 1])
        rank[at] = np.where(got >= 0, got, _NONE)

    def _propose(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match: (tokens, number for each word, words without a full match)."""
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        if self.end:
            data = np.insert(data, np.cumsum(n), 256)
            n = n + 1
        stop = np.cumsum(n)
        cur = stop - n
        data = np.append(data, 511)
        count = len(parts)
        word = np.arange(count)
        bad = np.zeros(count, bool)
        node = np.zeros(count, np.int64)
        best_end, best = np.full(count, -1, np.int64), np.full(count, -1, np.int64)
        limit = stop.copy()
        out_w, out_t = [], []
        while len(word):
            child = np.where(cur < limit, self.edges.get(node << 9 | data[cur]), -1)
            go = child >= 0
            token = self.node_token[np.where(go, child, 0)]
            cur = cur + go
            if self.end:  # a token before the last letter's end mark would leave the mark alone
                token = np.where(cur == limit - 1, -1, token)
            hit = go & (token >= 0)
            best = np.where(hit, token, best)
            best_end = np.where(hit, cur, best_end)
            node = np.where(go, child, 0)
            if go.all():
                continue
            stuck = ~go
            lost = stuck & (best < 0)
            bad[word[lost]] = True
            told = stuck & (best >= 0)
            out_w.append(word[told])
            out_t.append(best[told])
            cur = np.where(told, best_end, cur)
            best = np.where(stuck, -1, best)
            live = ~(lost | (told & (cur >= limit)))
            word, node, cur, best, best_end, limit = word[live], node[live], cur[live], best[live], best_end[live], limit[live]
        w = np.concatenate(out_w) if out_w else np.zeros(0, np.int64)
        t = np.concatenate(out_t) if out_t else np.zeros(0, np.int64)
        order = np.argsort(w, kind="stable")
        return t[order], np.bincount(w, minlength=count).astype(np.int64), bad

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is its own encoding; new pairs are merged exactly once."""
        key = a << 20 | b
        asked, back = np.unique(key, return_inverse=True)
        at = np.searchsorted(self.known, asked)
        here = at < len(self.known)
        here[here] = self.known[at[here]] == asked[here]
        fits = np.zeros(len(asked), bool)
        fits[here] = self.fits[at[here]]
        if not here.all():
            new = asked[~here]
            x, y = new >> 20, new & ((1 << 20) - 1)
            both = [(self.spelled[p][0] + self.spelled[q][0], self.spelled[q][1]) for p, q in zip(x.tolist(), y.tolist(), strict=True)]
            got, n = self._merge(*self._symbols([p[0] for p in both], np.array([p[1] for p in both], bool)))
            two = n == 2
            start = np.cumsum(n) - n
            ok = np.zeros(len(new), bool)
            ok[two] = (got[start[two]] == x[two]) & (got[start[two] + 1] == y[two])
            fits[~here] = ok
            if len(self.known) > MEMORY:
                self.known, self.fits = new, ok
            else:
                known = np.concatenate((self.known, new))
                order = np.argsort(known)
                self.known, self.fits = known[order], np.concatenate((self.fits, ok))[order]
        return fits[back]

    def encode(self, parts: list[bytes]) -> list[bytes]:
        """Each pre-token's ids as little-endian unsigned 32-bit integers."""
        if not parts:
            return []
        t, n, bad = self._propose(parts)
        word = np.repeat(np.arange(len(parts)), n)
        alone = word[~self.own[t]]
        bad[alone] = True
        pair = np.flatnonzero(word[:-1] == word[1:])
        wrong = pair[~self._compatible(t[pair], t[pair + 1])]
        bad[word[wrong]] = True
        self.counts["words"] += len(parts)
        self.counts["merged"] += int(bad.sum())
        out = self._cut(t, n)
        failing = np.flatnonzero(bad).tolist()
        if failing:
            for i, ids in zip(failing, self.merge([parts[i] for i in failing]), strict=True):
                out[i] = ids
        return out

    def merge(self, parts: list[bytes]) -> list[bytes]:
        """The same by the ranked merges alone."""
        return self._cut(*self._merge(*self._symbols(parts, np.full(len(parts), self.end)))) if parts else []

    @staticmethod
    def _cut(tokens: np.ndarray, n: np.ndarray) -> list[bytes]:
        ids = tokens.astype("<u4").tobytes()
        to = np.cumsum(n) * 4
        return [ids[a:b] for a, b in zip((to - n * 4).tolist(), to.tolist(), strict=True)]


#: Classes of bytes: ASCII letters, digits and marks other than the apostrophe; 0 for all others.
_CLASS = np.zeros(256, np.int8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = 3


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... n[0] of them, and so on."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def class_cuts(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where, before a byte, the class changes between two that are letters, digits or marks: no pre-token lies across.

    A contraction begins with an apostrophe, so none is cut; where "<|" may begin a special token's text, the bytes up to the
    next white space on either side stay together.
    """
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    if len(special):
        blank = np.concatenate(([-1], np.flatnonzero(_SPACE[data] | (data < 33)), [len(data)]))
        after = np.searchsorted(blank, special)
        for lo, hi in sorted(set(zip(blank[after - 1].tolist(), blank[after].tolist(), strict=True))):
            cut[lo + 1 : hi] = False
    return cut


class _Encoder:
    """Whole texts to ids through a memory of units (words) whose encodings don't depend on what stands around them."""

    #: Stands between units while many are split into pre-tokens at once; ids below 2**24 never hold it.
    mark, gap = "", b"\xff\xff\xff\xff"
    odd: re.Pattern
    parts_of: regex.Pattern
    #: Whether a unit holds the space before it.
    spaced = False
    #: Whether new pre-tokens are encoded by proposal and check, or merged at once.
    speculates = True
    #: How many times MEMORY units are remembered.
    kept = 1

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.bpe = SpeculativeBpe(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.new = self.bpe.encode if self.speculates else self.bpe.merge
        self.parts: dict[str, bytes] = {self.mark: self.gap}
        self.by_library = 0
        self.forget()

    def normal(self, text: str) -> str:
        return text

    def units_of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the units in the bytes of several texts, each of which stands before one of ``ends``."""
        raise NotImplementedError

    def learn_plain(self, data: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number for each unit) of units that are one pre-token each; ``data``: their bytes, ``n`` of each."""
        raw, to = data.tobytes(), np.cumsum(n)
        told = self.new([raw[i:j] for i, j in zip((to - n).tolist(), to.tolist(), strict=True)])
        return np.frombuffer(b"".join(told), "<u4"), np.fromiter(map(len, told), np.int64, len(told)) // 4

    def learn(self, missing: list[bytes]) -> list[bytes]:
        """Encodes units that aren't remembered: plain ones by proposal and check, all others by the library."""
        text = self.mark.encode().join(missing).decode("utf-8", "replace")
        plain = missing
        if self.odd.search(text) or text.count(self.mark) != len(missing) - 1:
            plain = [u for u in missing if not self.odd.search(t := u.decode("utf-8", "replace")) and self.mark not in t]
            text = self.mark.encode().join(plain).decode()
        found: dict[bytes, bytes] = {}
        if plain:
            parts = self.parts_of.findall(self.normal(text))
            names = list(set(parts).difference(self.parts))
            if len(self.parts) + len(names) > MEMORY:
                self.parts = {self.mark: self.gap}
                names = list(set(parts).difference(self.parts))
            self.parts.update(zip(names, self.new([p.encode() for p in names]), strict=True))
            told = b"".join(map(self.parts.__getitem__, parts)).split(self.gap)
            if plain is missing:
                return told
            found.update(zip(plain, told, strict=True))
        if rest := [u for u in missing if u not in found]:
            self.by_library += len(rest)
            for unit, e in zip(rest, self.library.encode_batch_fast([u.decode("utf-8", "replace") for u in rest], add_special_tokens=False), strict=True):
                found[unit] = np.array(e.ids, "<u4").tobytes()
        return [found[u] for u in missing]

    def forget(self) -> None:
        self.twins: dict[bytes, int] = {}  # units whose hash another unit has
        self.known = _Table(np.zeros(0, np.int64), np.zeros(0, np.int64), self.kept * MEMORY)
        self.keys, self.used = _Grown(np.int64), _Grown(bool)  # a twin's key is -1; used: asked for since it was remembered
        self.start, self.size, self.ids = _Grown(np.int64), _Grown(np.int64), _Grown(np.uint32)
        self.byte_start, self.byte_size, self.bytes = _Grown(np.int64), _Grown(np.int64), _Grown(np.uint8)

    def forget_unused(self) -> None:
        """Keeps the units that were asked for again, the later half of the memory's room at most."""
        old = {name: getattr(self, name) for name in ("keys", "used", "start", "size", "ids", "byte_start", "byte_size", "bytes")}
        left = np.flatnonzero(old["used"].all & (old["keys"].all >= 0))[-max(1, self.kept * MEMORY // 2) :]
        self.forget()
        self.keys.add(old["keys"].all[left])
        self.used.add(np.zeros(len(left), bool))
        for whole, start, size in (("ids", "start", "size"), ("bytes", "byte_start", "byte_size")):
            n = old[size].all[left]
            getattr(self, whole).add(old[whole].all[_spread(old[start].all[left], n)])
            getattr(self, start).add(np.cumsum(n) - n)
            getattr(self, size).add(n)
        self.known.add(self.keys.all, np.arange(len(left)))

    def encode(self, rows: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        All units of the texts are looked up at once: those of up to seven bytes by these bytes, longer ones by 64-bit hashes
        of theirs, where every hit is compared byte by byte; units that share another one's hash are looked up by their bytes.
        """
        data = np.frombuffer(b"".join(rows), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))
        begin, end = self.units_of(data, ends)
        n, words = end - begin, words_at(data)
        key = (words[begin] & WORD_MASK[np.minimum(n, 7)] | n.astype(np.uint64) << np.uint64(56)).view(np.int64)
        long = np.flatnonzero(n > 7)
        key[long] = (span_hashes(data, begin[long], end[long]) >> np.uint64(2) | np.uint64(1 << 62)).view(np.int64)
        entry = self.known.get(key)
        new = np.flatnonzero(entry < 0)
        if len(new):
            keys, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            if self.keys.n + len(keys) > self.kept * MEMORY:
                self.forget_unused()
                entry = self.known.get(key)
                new = np.flatnonzero(entry < 0)
                keys, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            if self.keys.n + len(keys) > self.known.room:
                filled = self.known.keys >= 0
                self.known = _Table(self.known.keys[filled], self.known.values[filled], 2 * (self.keys.n + len(keys)))
            self.used.all[entry[entry >= 0]] = True
            first = new[first]
            told = self._remember(data, begin[first], end[first], keys)
            self.known.add(keys, told)
            entry[new] = told[back]
        else:
            self.used.all[entry] = True
        other = long[~self._equal(data, begin[long], end[long], entry[long])]
        if len(other):
            units = [data[i:j].tobytes() for i, j in zip(begin[other].tolist(), end[other].tolist(), strict=True)]
            at = {u: k for k, u in zip(other.tolist(), units, strict=True) if u not in self.twins}
            places = np.array(list(at.values()), np.int64)
            self.twins.update(zip(at, self._remember(data, begin[places], end[places]).tolist(), strict=True))
            entry[other] = [self.twins[u] for u in units]
        size = self.size.all[entry]
        upto = np.concatenate(([0], np.cumsum(size)))
        flat = self.ids.all[np.repeat(self.start.all[entry] - upto[:-1], size) + np.arange(upto[-1])].astype("<u4", copy=False).tobytes()
        to = 4 * upto[np.searchsorted(begin, ends, side="left")]
        return [flat[i:j] for i, j in zip([0, *to.tolist()], to.tolist(), strict=False)]

    def kinds(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte."""
        return _CLASS[data]

    def plain(self, data: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which units, of ``n`` bytes each in ``data``, are one pre-token: a run of letters, digits or marks, after a space or not."""
        kind = self.kinds(data)
        begin = np.cumsum(n) - n
        odd = kind == 0
        odd[1:] |= kind[1:] != kind[:-1]
        odd[begin] = kind[begin] == 0
        if self.spaced:
            space = data[begin] == 32
            odd[begin[space]] = False
            odd[begin[space & (n > 1)] + 1] = kind[begin[space & (n > 1)] + 1] == 0
        odd[: len(data) - 1] |= (data[:-1] == 60) & (data[1:] == 124)  # may begin a special token's text
        return ~np.logical_or.reduceat(odd, begin)

    def _remember(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
        """Encodes units and keeps their ids and bytes; their numbers in the memory. ``keys``: none for twins."""
        if not len(begin):
            return np.zeros(0, np.int64)
        n = end - begin
        data = data[_spread(begin, n)]
        begin = np.cumsum(n) - n
        plain = self.plain(data, n)
        whole = np.repeat(plain, n)
        ids, size = self.learn_plain(data[whole], n[plain]) if plain.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        # Plain units' ids stand first, all others' after them; the numbers keep the units' order.
        sizes, starts = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        sizes[plain], starts[plain] = size, np.cumsum(size) - size
        if not plain.all():
            raw, rest = data.tobytes(), np.flatnonzero(~plain)
            told = self.learn([raw[i:j] for i, j in zip(begin[rest].tolist(), (begin + n)[rest].tolist(), strict=True)])
            size = np.fromiter(map(len, told), np.int64, len(told)) // 4
            sizes[rest], starts[rest] = size, len(ids) + np.cumsum(size) - size
            ids = np.concatenate((ids, np.frombuffer(b"".join(told), "<u4")))
        number = np.arange(self.keys.n, self.keys.n + len(n))
        self.keys.add(np.full(len(n), -1) if keys is None else keys)
        self.used.add(np.zeros(len(n), bool))
        self.start.add(self.ids.n + starts)
        self.size.add(sizes)
        self.ids.add(ids)
        self.byte_start.add(self.bytes.n + begin)
        self.byte_size.add(n)
        self.bytes.add(data)
        return number

    def _equal(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Whether each unit has the bytes of the entry found for it."""
        n = end - begin
        here, there = self.byte_start.all[entry], begin
        same = n == self.byte_size.all[entry]
        for k in np.flatnonzero(same & (n > LONG)).tolist():
            same[k] = np.array_equal(data[begin[k] : end[k]], self.bytes.all[here[k] : here[k] + n[k]])
        at = np.flatnonzero(same & (n <= LONG))
        one, two, left = words_at(data), self.bytes.held, n[at]
        two = np.ndarray((len(two) - 7,), "<u8", two, strides=(1,))
        here, there = here[at], there[at]
        while len(at):  # eight bytes at a time
            differs = np.flatnonzero((one[there] ^ two[here]) & WORD_MASK[np.minimum(left, 8)])
            same[at[differs]] = False
            more = np.flatnonzero(left > 8)
            at, here, there, left = at[more], here[more] + 8, there[more] + 8, left[more] - 8
        return same


class WordEncoder(_Encoder):
    """The lower-casing vocabulary with word ends. Units are separated by white space, which no pre-token and no normal form
    crosses, and where the class of ASCII characters changes."""

    mark = "\n"
    odd = re.compile("[^\n!-~\xa1-\xac\xae-\u024f]|<\\|")
    parts_of = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    ascii_parts = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

    def normal(self, text: str) -> str:
        return text.lower()

    def units_of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)  # where a text begins
        edge[ends] = True
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.kinds(data)
        digit = kind == 2
        edge |= class_cuts(data, kind)
        edge[1:-1] |= digit[1:] & digit[:-1]  # each digit is a pre-token
        begin = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])) | word & edge[:-1])
        end = np.flatnonzero(word & (np.concatenate((~word[1:], [True])) | edge[1:])) + 1
        return begin, end

    def learn_plain(self, data: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return super().learn_plain(_LOWER[data], n)

    def decode_table(self) -> list[str]:
        size = self.library.get_vocab_size(with_added_tokens=True)
        return [self.library.id_to_token(i) or "" for i in range(size)]


class ByteEncoder(_Encoder):
    """The byte-level vocabulary. Units begin at white space, after a single white space other than a space, and where the
    class of characters changes. It has few new pre-tokens that a proposal gets right, so they are merged at once."""

    mark = "\x01"
    spaced = True
    speculates = False
    kept = 2
    odd = re.compile("[^\x01\t\n\r -~\xa1-\xac\xae-\u024f]|<\\||\\s\\s|\\s(?:\x01|\\Z)")
    parts_of = regex.compile(r"\x01|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+(?!\S)|\s+")
    wide = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a|\xe2\x80|\xe2\x81|\xe3\x80")  # bytes of white space beyond ASCII
    space = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])

    def kinds(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte; the letters from U+00C0 to U+00FF are two bytes of the class of letters."""
        kind = _CLASS[data]
        at = np.flatnonzero(data[:-1] == 0xC3)
        then = data[at + 1]
        at = at[(then >> 6 == 2) & (then != 0x97) & (then != 0xB7)]
        kind[at] = kind[at + 1] = 1
        return kind

    def learn_plain(self, data: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.bpe._merge(self.bpe.first[data], n)

    def units_of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blank = self.space[data]
        cut = class_cuts(data, self.kinds(data))
        white = np.flatnonzero(_SPACE[data[1:-1]] & ~blank[:-2]) + 1  # begins white space
        cut[white] = True
        cut[white[(data[white] != 32) & ~blank[white + 1]] + 1] = True  # one pre-token of its own
        if ((data - np.uint8(0xE1) < 3) | (data == 0xC2)).any():
            for m in self.wide.finditer(data):  # a text's part around such bytes stays whole
                cut[max(0, m.start() - 2) : m.end() + 3] = False
        cut[0] = True
        cut[ends] = True
        at = np.flatnonzero(cut)
        return at[:-1], at[1:]


_KINDS = {"word": (WordEncoder, WORD_BPE), "byte": (ByteEncoder, BYTE_BPE)}


@lru_cache(maxsize=2)
def encoder(kind: str, path: str | None = None) -> WordEncoder | ByteEncoder:
    """One encoder for each worker process; its memory is bounded and only speeds it up."""
    make, name = _KINDS[kind]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    made = make(path or default_path(name))
    release()  # what reading the vocabulary has left behind
    return made
