"""Token ids of many texts, through a cache of word pieces.

A byte-level BPE works on each pre-token by itself, so ids of a pre-token can be kept.
Pre-tokens of a batch are cut with array operations by the pattern that the vocabulary
is made for:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

and only those not seen before go to the tokenizer.  Texts with characters that were
not assigned alike in an early and in the present Unicode version, or with the content of a special token, go there whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from quillmask.llm import _kernels as K

U = np.uint64
OTHER, LETTER, NUMBER, SPACE, BREAK, UNSURE = range(6)
# White space of Unicode.
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings that the pattern splits off after an apostrophe.
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


def _classes() -> np.ndarray:
    out = np.zeros(0x110000, dtype=np.uint8)
    early = unicodedata.ucd_3_2_0.category
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        out[c] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
        if c > 0x7F and early(chr(c))[0] != kind[0]:
            out[c] = UNSURE
    out[_SPACES] = SPACE
    return out


class TokenIds:
    """``ids(texts)``: an array of ids for each text."""

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self.known: dict[int, bytes] = {}
        self.kind = _classes()
        self.weight = K.mix(np.arange(1, 0x110001, dtype=U) * U(0xD6E8FEB86659FD93))

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32).tobytes() for e in found]

    def ids(self, texts: list[str], limit: int = 1 << 20) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        some: list[str] = []
        size = 0
        for t in texts:
            if some and size + len(t) > limit:
                out += self._some(some)
                some, size = [], 0
            some.append(t)
            size += len(t) + 1
        return out + (self._some(some) if some else [])

    def _starts(self, cps: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin; a break is one of its own."""
        first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        end = np.append(first[1:], len(kind))
        what = kind[first]
        plain = cps == 0x20
        is_space = what == SPACE
        after = np.append(what[1:], BREAK)
        before_plain = np.zeros(len(first), dtype=bool)
        before_plain[1:] = is_space[:-1] & plain[first[1:] - 1]
        solid = ~is_space
        starts = first - (solid & (what != BREAK) & before_plain)
        # an apostrophe by itself, not joined with a blank, and one of the endings: cut after the ending
        lone = np.flatnonzero((what == OTHER) & (end - first == 1) & (cps[first] == 0x27) & (after == LETTER) & ~before_plain)
        drop = np.zeros(len(first), dtype=bool)
        moved = starts.copy()
        pad = np.append(cps, [0, 0, 0])
        for ending in _ENDINGS:
            at = lone
            for j, c in enumerate(ending):
                at = at[pad[first[at] + 1 + j] == ord(c)]
            at = at[end[at + 1] - first[at + 1] >= len(ending)]
            moved[at + 1] = first[at + 1] + len(ending)
            drop[at + 1] |= moved[at + 1] >= end[at + 1]
            lone = np.setdiff1d(lone, at, assume_unique=True)
        parts = [moved[solid & ~drop]]
        # white space: whole before a break or the end, else all but its last character, which stands alone unless a blank
        closing = is_space & (after == BREAK)
        parts.append(first[closing])
        open_ = is_space & ~closing
        parts.append(first[open_ & (end - first >= 2)])
        parts.append(end[open_ & ~plain[end - 1]] - 1)
        return np.sort(np.concatenate(parts))

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\0".join(texts) + "\0"
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = self.kind[cps]
        stop = np.cumsum([len(t) + 1 for t in texts]) - 1
        special = [d for d, t in enumerate(texts) if any(c in t for c in self.special)]
        unsure = K.distinct(np.append(np.searchsorted(stop, np.flatnonzero(kind == UNSURE)), special).astype(np.int64))
        kind[stop] = BREAK
        starts = self._starts(cps, kind)
        p, inv = K._upto(len(cps))
        acc = np.zeros(len(cps) + 1, dtype=U)
        np.cumsum(self.weight[cps] * p, out=acc[1:])
        ends = np.append(starts[1:], len(cps))
        real = kind[starts] != BREAK
        starts, ends = starts[real], ends[real]
        h = K.mix((acc[ends] - acc[starts]) * inv[starts] + (ends - starts).astype(U))
        order = np.argsort(h)
        sorted_ = h[order]
        new = np.concatenate((np.ones(min(1, len(h)), dtype=bool), sorted_[1:] != sorted_[:-1]))
        at = order[new]
        which = np.empty(len(h), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        keys = sorted_[new].tolist()
        known = self.known
        held = [known.get(k) for k in keys]
        missing = [i for i, b in enumerate(held) if b is None]
        if missing:
            a, b = starts[at].tolist(), ends[at].tolist()
            if len(known) + len(missing) > self.most:
                known.clear()
            for i, ids in zip(missing, self._encode([joined[a[i] : b[i]] for i in missing]), strict=True):
                held[i] = known[keys[i]] = ids
        n = np.array([len(b) // 4 for b in held], dtype=np.int64)
        flat = np.frombuffer(b"".join(held), dtype=np.uint32)
        own = np.cumsum(n) - n
        count = n[which]
        ahead = np.cumsum(count) - count
        ids = flat[np.repeat(own[which] - ahead, count) + np.arange(int(count.sum()))]
        # ids of text d: those of the pre-tokens that begin before its break
        upto = np.append(0, np.append(ahead, int(count.sum()))[np.searchsorted(starts, stop)])
        out = [ids[upto[d] : upto[d + 1]] for d in range(len(texts))]
        if len(unsure):
            for d, b in zip(unsure.tolist(), self._encode([texts[d] for d in unsure.tolist()]), strict=True):
                out[d] = np.frombuffer(b, dtype=np.uint32)
        return out
