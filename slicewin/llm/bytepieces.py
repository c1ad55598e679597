"""Token ids of whole texts from the ids of their distinct pieces, for byte-level BPE tokenizers.

The pre-tokenizer of such a tokenizer cuts a text into pieces that are encoded apart from each other. Here the cuts
of many texts are found at once over their bytes, each distinct piece is encoded by the library once, and its
ids are put in wherever it stands. Kept pieces are found by 128 bits of hash; at most KEPT are kept in a worker,
then it starts anew. Pieces of more than LONG bytes are encoded each time.

How the library takes a character (letter, number, space, other) is asked of the library itself when the
character is met for the first time. Texts with the string of an added token, and all texts of tokenizers of
another kind, are encoded whole by the library.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa

from slicewin.llm.textscan import stretches

KEPT, LONG = 1 << 20, 256
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
#: The endings that the pre-tokenizer cuts off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
_BYTES = [np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for seed in (7, 8)]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        up, down = np.full(max(n, 1 << 19), _STEP), np.full(max(n, 1 << 19), U(pow(int(_STEP), -1, 2**64)))
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"][:n], _powers["down"][:n]


class Encoder:
    held: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        cut = own.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        added = own.get("added_tokens") or []
        self.by_piece = bool(plain and not own.get("normalizer") and not own.get("truncation") and not own["model"].get("dropout") and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added))
        self.added = [t["content"].encode() for t in added]
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.kinds[:128] = [self.kind(chr(c)) for c in range(128)]
        self.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each file and worker."""
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def clear(self) -> None:
        self.keys, self.checks, self.places = np.zeros(2 * KEPT, U), np.zeros(2 * KEPT, U), np.full(2 * KEPT, -1, np.int32)
        self.starts, self.ids, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint32), 0

    def kind(self, c: str) -> int:
        for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.coder.pre_tokenizer.pre_tokenize_str(before + c)) == 1:
                return kind
        return SPACE

    def kinds_of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first byte and the kind of each character."""
        if not len(data) or data.max() < 128:
            return np.arange(len(data)), self.kinds[data]
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        code = data[at].astype(np.int32)
        big = np.flatnonzero(code >= 128)
        p, c = at[big], code[big]
        size = 1 + (c >= 0xC0) + (c >= 0xE0) + (c >= 0xF0)
        wide = np.append(data, np.zeros(3, np.uint8)).astype(np.int32) & 0x3F
        value = c & np.choose(size - 2, [0x1F, 0x0F, 0x07])
        for j in range(1, 4):
            value = np.where(size > j, value << 6 | wide[p + j], value)
        code[big] = value
        kinds = self.kinds[code]
        new = np.unique(code[kinds == UNKNOWN])
        if len(new):
            self.kinds[new] = [self.kind(chr(x)) for x in new]
            kinds = self.kinds[code]
        return at, kinds

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The first byte of each piece of the texts."""
        at, kind = self.kinds_of(data)
        n = len(at)
        if not n:
            return at
        first = np.zeros(n, bool)
        texts = np.searchsorted(at, offsets[:-1])
        first[texts[texts < n]] = True
        starts = first.copy()
        starts[1:] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        # The last of several spaces before a word leaves the others; a blank joins the word.
        last = space.copy()
        last[:-1] &= ~space[1:] & ~first[1:]
        last[-1] = False
        last = np.flatnonzero(last)
        starts[last] = True
        joins = last[data[at[last]] == 32]
        starts[joins + 1] = False
        # An apostrophe that begins a piece, with letters behind it that are an ending.
        quote = np.flatnonzero((data[at[:-1]] == 39) & starts[:-1])
        quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
        if len(quote):
            open_ = np.ones(len(quote), bool)
            pad = np.append(data, np.zeros(2, np.uint8))
            for e in ENDINGS:
                hit = open_ & np.logical_and.reduce([pad[at[quote] + 1 + j] == ord(c) for j, c in enumerate(e)])
                if len(e) == 2:
                    hit &= ~np.append(first, True)[np.minimum(quote + 2, n)]
                open_ &= ~hit
                after = quote[hit] + 1 + len(e)
                starts[quote[hit] + 1] = False
                starts[after[after < n]] = True
        return at[starts]

    def learn(self, pieces: list[bytes]) -> None:
        """Appends the ids of ``pieces``. Words with a blank before them are encoded in one text, which is cut before each blank."""
        words = [i for i, p in enumerate(pieces) if p[:1] == b" " and p[1:].isalpha()]
        found: list[list[int]] = [[]] * len(pieces)
        if words:
            e = self.coder.encode(b"".join(pieces[i] for i in words).decode(), add_special_tokens=False)
            ids, of = e.ids, np.array(e.word_ids, np.int64)
            ends = np.searchsorted(of, np.arange(len(words)), "right").tolist()
            for i, a, b in zip(words, [0, *ends], ends, strict=False):
                found[i] = ids[a:b]
        held = set(words)
        rest = [i for i in range(len(pieces)) if i not in held]
        for i, e in zip(rest, self.coder.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        first, more = int(self.starts[self.n]), np.cumsum([len(x) for x in found])
        total, n = first + int(more[-1]), self.n + len(found)
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(2 * total - len(self.ids), np.uint32)])
        if n >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(2 * n - len(self.starts), np.int64)])
        self.ids[first:total] = np.fromiter(chain.from_iterable(found), np.uint32, total - first)
        self.starts[self.n + 1 : n + 1], self.n = first + more, n

    def look_up(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The places of pieces, -1 for those not kept."""
        mask = U(len(self.keys) - 1)
        slot, place, open_ = key & mask, np.full(len(key), -1, np.int32), np.arange(len(key))
        while len(open_):
            s = slot[open_]
            found = self.places[s]
            same = (self.keys[s] == key[open_]) & (self.checks[s] == check[open_]) & (found >= 0)
            place[open_[same]] = found[same]
            open_ = open_[~same & (found >= 0)]
            slot[open_] = (slot[open_] + U(1)) & mask
        return place

    def keep(self, key: np.ndarray, check: np.ndarray, place: np.ndarray) -> None:
        mask = len(self.keys) - 1
        for k, c, p in zip(key.tolist(), check.tolist(), place.tolist(), strict=True):
            s = k & mask
            while self.places[s] >= 0:
                s = (s + 1) & mask
            self.keys[s], self.checks[s], self.places[s] = k, c, p

    def stretch(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        starts = self.cuts(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        up, down = _power(len(data))
        sums = []
        for table in _BYTES:
            s = np.zeros(len(data) + 1, U)
            np.cumsum(table[data] * up, out=s[1:])
            sums.append((s[ends] - s[starts]) * down[starts])
        size = (ends - starts).astype(U)
        key, check = sums[0] + size * _STEP, sums[1]
        key = (key ^ (key >> U(31))) * U(0xBF58476D1CE4E5B9)
        key ^= key >> U(29)
        place = self.look_up(key, check)
        new = np.flatnonzero(place < 0)
        if len(new):
            _, one, back = np.unique(np.stack([key[new], check[new]], axis=1), axis=0, return_index=True, return_inverse=True) if len(new) < 64 else self.distinct(key[new], check[new])
            if self.n + len(one) > KEPT:
                self.clear()
                if len(new) < len(key):
                    return self.stretch(data, offsets)
            base = self.n
            raw = data.tobytes()
            self.learn([raw[a:b] for a, b in zip(starts[new[one]].tolist(), ends[new[one]].tolist(), strict=True)])
            place[new] = base + back.ravel()
            short = np.flatnonzero((ends - starts)[new[one]] <= LONG)
            if self.n <= KEPT:
                self.keep(key[new[one[short]]], check[new[one[short]]], base + short)
        begin = self.starts[place]
        length = self.starts[place + 1] - begin
        stop = np.cumsum(length)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.ids[np.repeat(begin - stop + length, length) + np.arange(total)]
        bound = np.concatenate([[0], stop])[np.searchsorted(starts, offsets)]
        if self.n > KEPT:
            self.clear()
        return [ids[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]

    @staticmethod
    def distinct(key: np.ndarray, check: np.ndarray) -> tuple[None, np.ndarray, np.ndarray]:
        order = np.lexsort((check, key))
        first = np.ones(len(order), bool)
        first[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(first) - 1
        return None, order[first], back

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        whole = lambda t: np.array(self.coder.encode(t or "", add_special_tokens=False).ids, np.uint32)
        if not self.by_piece:
            return [whole(t) for t in texts.to_pylist()]
        out = []
        for first, data, offsets in stretches(texts):
            found = self.stretch(data, offsets)
            raw = data.tobytes()
            for t in self.added:
                at = raw.find(t)
                while at >= 0:
                    i = int(np.searchsorted(offsets, at, "right")) - 1
                    found[i] = whole(texts[first + i].as_py())
                    at = raw.find(t, at + 1)
            out += found
        return out
