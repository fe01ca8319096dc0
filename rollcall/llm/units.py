"""Texts cut into units that a tokenizer encodes alike alone and in place, and a bounded memory of encoded units.

A unit boundary is set only where no token and no pre-token can lie across it,
told from the bytes next to it; where that isn't certain (other scripts' spaces
and marks, apostrophes), neighbours stay in one unit, which the tokenizer then
sees whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from . import textbytes as tb
from .prefix_tree import _spread

#: Units that a tokenizer is given at a time.
UNITS = 4096
_PUNCTUATION = (np.arange(256) > 32) & (np.arange(256) < 127) & ~tb.LETTER & ~tb.byte_set(b"0123456789'")


def _before(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte but the first: whether a Latin letter, and whether any certain non-space, ends before it."""
    prev = data[:-1]
    latin = np.zeros(len(prev), dtype=bool)
    # U+00C0 to U+00FF are two bytes after 0xC3, and letters but for U+00D7 and U+00F7
    latin[1:] = (prev[:-1] == 0xC3) & (prev[1:] != 0x97) & (prev[1:] != 0xB7)
    letter = tb.LETTER[prev] | latin
    solid = (prev < 128) & ~tb.SPACE[prev] & (prev >= 32)
    solid[1:] |= prev[:-1] == 0xC3
    return letter, solid


def _starts(data: np.ndarray, off: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Where units begin, if cut[i] says whether one begins at byte i + 1."""
    flag = np.zeros(len(data) + 1, dtype=bool)
    flag[1:-1] = cut
    flag[off] = True
    return np.flatnonzero(flag[:-1])


def _ends(starts: np.ndarray, size: int) -> np.ndarray:
    out = np.empty_like(starts)
    if len(starts):
        out[:-1] = starts[1:]
        out[-1] = size
    return out


def spaced_units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokenizers whose words carry the space before them, and are letters or are not."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    letter, solid = _before(data)
    here = data[1:]
    starts = _starts(data, off, (tb.SPACE[here] & solid) | (letter & _PUNCTUATION[here]) | (_PUNCTUATION[data[:-1]] & tb.LETTER[here]))
    return starts, _ends(starts, len(data))


def bare_units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokenizers that drop white space; units have none of U+0009 to U+000D and U+0020."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    letter, _ = _before(data)
    here = data[1:]
    word = ~tb.SPACE[data]
    cut = (tb.SPACE[data[:-1]] != tb.SPACE[here]) | (letter & _PUNCTUATION[here]) | (_PUNCTUATION[data[:-1]] & tb.LETTER[here])
    starts = _starts(data, off, cut)
    ends = _ends(starts, len(data))
    keep = word[starts]
    return starts[keep], ends[keep]


def piece_units(data: np.ndarray, off: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For piece models in which only a leading space is part of a word; apart: ASCII bytes that are in no piece."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    solid = _before(data)[1] | apart[data[:-1]]
    here = data[1:]
    starts = _starts(data, off, ((here == 32) & solid) | apart[here] | apart[data[:-1]])
    return starts, _ends(starts, len(data))


def lowered_safely(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case unless a character outside Latin-1 follows, which might join it to another one."""
    low = tb.UPPER[data]
    low[:-1] &= (data[1:] < 128) | (data[1:] == 0xC3)
    return data + (low.view(np.uint8) << np.uint8(5))


class UnitMemory:
    """What units encode to, by their 64-bit hash.

    encode: byte strings to the number of ids of each, and all ids one after the
    other. At most ``limit`` units and ``8 * limit`` ids are held, beside those of one call; when it is
    full, the given ones stay and half of it goes to the units that were looked up most often, of late
    above all. The rest is forgotten, and encoded again where it recurs.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 1_000_000, given: tuple[np.ndarray, np.ndarray] | None = None):
        self.encode, self.limit = encode, limit
        self._given = given or (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32))
        keys, ids = self._given
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array(ids, dtype=np.int32)
        self.at = order.astype(np.int32)
        self.lens = np.ones(len(keys), dtype=np.int32)
        #: calls that asked for the unit, halved at each forgetting
        self.calls = np.zeros(len(keys), dtype=np.int32)
        self.full = len(ids)

    def _forget(self) -> None:
        given = len(self._given[0])
        learnt = np.flatnonzero((self.at >= given) & (self.calls > 1))
        best = learnt[np.argsort(-self.calls[learnt], kind="stable")][: max(0, self.limit - given) // 2]
        best = best[np.cumsum(self.lens[best], dtype=np.int64) <= 4 * self.limit]
        keep = self.at < given
        keep[best] = True
        learnt = keep & (self.at >= given)
        lens = self.lens[learnt].astype(np.int64)
        self.ids = np.concatenate([self.ids[:given], self.gather(self.at[learnt], lens)])
        self.full = len(self.ids)
        self.at[learnt] = given + np.cumsum(lens) - lens
        self.keys, self.at, self.lens, self.calls = self.keys[keep], self.at[keep], self.lens[keep], self.calls[keep] >> 1

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, prefix: Callable[[int], bytes] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """For each unit the place of its ids in ``ids`` and their number; how many different units had to be encoded."""
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.limit or self.full > 8 * self.limit:
            self._forget()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            which = first[new]
            units = [raw[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist())]
            if prefix is not None:
                units = [prefix(i) + u for i, u in zip(which.tolist(), units)]
            lens, ids = self.encode(units)
            need = self.full + len(ids)
            if need > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.full], np.zeros(max(need, len(self.ids)), dtype=np.int32)])
            self.ids[self.full : need] = ids
            at = self.full + np.cumsum(lens) - lens
            self.full = need
            self.keys = np.insert(self.keys, place[new], distinct[new])
            self.at = np.insert(self.at, place[new], at.astype(np.int32))
            self.lens = np.insert(self.lens, place[new], lens.astype(np.int32))
            self.calls = np.insert(self.calls, place[new], 0)
            place = np.searchsorted(self.keys, distinct)
        self.calls[place] += 1
        return self.at[place][inverse], self.lens[place][inverse], len(new)

    def gather(self, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The ids of the units, one after the other."""
        return self.ids[_spread(at.astype(np.int64), lens.astype(np.int64))]


def plain_words(tokenizer) -> tuple[re.Pattern, dict[int, str]] | None:
    """Which units the tokenizer hands to its model as one pre-token and unchanged, and how it writes their characters there.

    They are words of Latin letters that the normalizer leaves alone, with a space before
    them where that is part of a word. A word of all those letters is tried first; if it isn't
    one pre-token, there are no such units.
    """
    same = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
    letters = [c for c in map(chr, range(65, 256)) if c.isalpha() and c not in "ªµº" and same(c) == c]
    cut = tokenizer.pre_tokenizer.pre_tokenize_str if tokenizer.pre_tokenizer else lambda text: [(text, None)]
    written = {ord(c): cut(c)[0][0] for c in [*letters, " "] if cut(c)}
    word = "".join(letters)

    def unchanged(text: str) -> bool:
        return same(text) == text and [x for x, _ in cut(text)] == [text.translate(written)]

    if not word or not unchanged(word):
        return None
    return re.compile(f"{' ?' if unchanged(' ' + word) else ''}[{word}]+"), written


def encoder(tokenizer) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """``encode`` of a UnitMemory by a tokenizers.Tokenizer, without added tokens; the library's large results are held for few units at a time.

    Plain words go to the tokenizer's model at once, past the steps that leave them as they are.
    """
    model, plain = tokenizer.model, plain_words(tokenizer)

    def alone(text: str) -> list[int] | None:
        return [x.id for x in model.tokenize(text.translate(plain[1]))] if plain and plain[0].fullmatch(text) else None

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lens, ids = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        for lo in range(0, len(units), UNITS):
            texts = [u.decode() for u in units[lo : lo + UNITS]]
            out = [alone(x) for x in texts]
            rest = [i for i, x in enumerate(out) if x is None]
            for i, x in zip(rest, tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
                out[i] = x.ids
            lens.append(np.array([len(x) for x in out], dtype=np.int64))
            ids.append(np.array([i for x in out for i in x], dtype=np.int32))
        return np.concatenate(lens), np.concatenate(ids)

    return encode


def special_strings(tokenizer) -> list[bytes]:
    return [x.content.encode() for x in tokenizer.get_added_tokens_decoder().values()]


def texts_with(data: np.ndarray, off: np.ndarray, strings: list[bytes]) -> list[int]:
    """The texts in which one of the strings stands."""
    found: set[int] = set()
    for s in strings:
        head = np.flatnonzero(data[: max(0, len(data) - len(s) + 1)] == s[0]) if len(data) >= len(s) else np.zeros(0, dtype=np.int64)
        for k in range(1, len(s)):
            head = head[data[head + k] == s[k]]
        of = tb.text_of(head, off)
        found.update(of[head + len(s) <= off[of + 1]].tolist())
    return sorted(found)
