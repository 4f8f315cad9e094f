"""Token ids by the tokenizers library, with what it does repeatedly done once.

Pieces of words recur, so texts are split into the pieces that the tokenizer's own splitting
makes (by classes of characters, for many texts at once), the library's model is asked for each
distinct piece, and the answers are put together by index. This is exact because white space and
piece boundaries depend on nothing but the characters themselves. Where a text holds characters
whose case or composition could depend on their neighbours, or could spell a special token, the
library gets the unchanged words or the unchanged text.

A worker remembers at most REMEMBERED pieces, as Arrow and numpy arrays (some 30 bytes each), and
forgets those that it hasn't met for longest. Long texts are cut at white space, so that memory follows
AT_ONCE and the longest word, not the longest text.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers between two groups of texts.
REMEMBERED = 400_000
#: Bytes of text split at a time.
AT_ONCE = 4 << 20

#: Characters for which lower case and composition depend on nothing around them.
_PLAIN = r"\t-\r -~\x{A1}-\x{FF}"
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _classes() -> np.ndarray:
    """The class of each character up to U+00FF."""
    out = np.full(256, _OTHER, np.uint8)
    for k in range(256):
        c = chr(k)
        out[k] = _SPACE if c.isspace() else _LETTER if c.isalpha() else _NUMBER if unicodedata.category(c)[0] == "N" else _OTHER
    return out


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _split(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of plain UTF-8 texts that begin at begins: where each starts, its end in the bytes without blanks, those bytes.

    A piece is a run of letters, one number, a run of others, or an apostrophe that stands alone
    before s, t, re, ve, m, ll or d, together with those.
    """
    data = _LOWER[data]
    kind = _CLASS[data]
    two = np.flatnonzero(data >= 0xC2)  # first bytes of characters from U+0080 to U+00FF
    if len(two):
        low = data[two + 1]
        data[two + 1] = low = low + np.uint8(32) * ((data[two] == 0xC3) & (low <= 0x9E) & (low != 0x97)).astype(np.uint8)
        kind[two] = kind[two + 1] = _CLASS[((data[two] & 3) << 6) | (low & 0x3F)]
    edge = np.empty(len(data), bool)
    edge[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge |= kind == _NUMBER
    edge[two + 1] = False
    edge[begins[begins < len(data)]] = True
    at = np.flatnonzero(data == ord("'"))
    at = at[(at + 1 < len(data)) & edge[at]]
    if len(at):
        first = np.zeros(len(data) + 3, bool)
        first[begins] = True
        padded = np.concatenate((data, np.zeros(3, np.uint8)))
        a, b = padded[at + 1], padded[at + 2]
        one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        more = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        more &= ~first[at + 2]
        some = (one | more) & ~first[at + 1]
        at, size = at[some], np.where(one, 1, 2)[some]
        edge[at + 1] = False
        after = at + 1 + size
        edge[after[after < len(data)]] = True
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, len(data)))
    solid = kind[start] != _SPACE
    return start[solid], np.cumsum(size[solid]), data[kind != _SPACE]


def _gathered(pool: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """pool[first : first + many] of every one, on end."""
    ends = np.cumsum(many)
    return pool[np.repeat(first - (ends - many), many) + np.arange(ends[-1])] if len(ends) and ends[-1] else pool[:0]


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte as itself where that prints, else as one of the letters from U+0100 on."""
    out, spare = {}, 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or (0xA1 <= b and b != 0xAD):
            out[b] = b
        else:
            out[b], spare = spare, spare + 1
    return out


class Encoder:
    """Encodes batches of texts with one vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        steps = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
        self.by_piece = all(x in steps for x in ('"NFC"', '"Lowercase"', "'s|'t|'re|'ve|'m|'ll|'d|", '"ByteLevel"')) and spec["model"]["type"] == "BPE"
        self.specials = tuple(x["content"] for x in spec.get("added_tokens", ()))
        self.model, self.letters = self.library.model, _byte_letters()
        self.known = pa.array([], pa.binary())
        self.size, self.pool, self.used, self.now = np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int64), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _ask(self, pieces: pa.Array) -> tuple[np.ndarray, list[int]]:
        """The ids of all pieces on end, and each one's number of ids."""
        ids: list[int] = []
        ends = [0]
        for piece in pieces.to_pylist():
            shown = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.model.tokenize(shown)]
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(ends)

    def _forget(self) -> None:
        """Leaves the half of the pieces that was used last."""
        stays = np.sort(np.argsort(-self.used, kind="stable")[: REMEMBERED // 2])
        first = np.cumsum(self.size) - self.size
        self.known, self.used = self.known.take(pa.array(stays)), self.used[stays]
        self.pool, self.size = _gathered(self.pool, first[stays], self.size[stays]), self.size[stays]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each piece's begin and how many they are."""
        if len(self.known) > REMEMBERED:
            self._forget()
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = at < 0
        if new.any():
            at[new] = len(self.known) + np.arange(int(new.sum()))
            asked = pieces.filter(pa.array(new))
            ids, size = self._ask(asked)
            self.known = pa.concat_arrays([self.known, asked])
            self.pool, self.size = np.concatenate((self.pool, ids)), np.concatenate((self.size, size))
            self.used = np.concatenate((self.used, np.zeros(len(size), np.int64)))
        self.now += 1
        self.used[at] = self.now
        return self.pool, (np.cumsum(self.size) - self.size)[at], self.size[at]

    def _odd(self, text: str) -> np.ndarray:
        """Of a text with other characters: the library gets its words as they are, or all of it."""
        if any(x in text for x in self.specials):
            return self._ids(text)
        words = text.encode().split()  # at ASCII white space only
        known = {w: self._ids(w.decode()) for w in dict.fromkeys(words)}
        return np.concatenate([known[w] for w in words]) if words else np.empty(0, np.uint32)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        begins = offsets - offsets[0]
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(begins), np.int64)
        start, end, solid = _split(data, begins)
        bounds = np.zeros(len(end) + 1, np.int32)
        bounds[1:] = end
        coded = pa.Array.from_buffers(pa.binary(), len(end), [None, pa.py_buffer(bounds), pa.py_buffer(solid)]).dictionary_encode()
        pool, first, size = self._pieces(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False)
        many = size[which]
        ids = _gathered(pool, first[which], many)
        ends = np.concatenate(([0], np.cumsum(many)))
        return ids, ends[np.searchsorted(start, begins)]

    def _some(self, texts: pa.Array) -> list[np.ndarray]:
        if not self.by_piece:
            return [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        odd = pc.match_substring_regex(texts, rf"[^{_PLAIN}]")
        for x in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, x, ignore_case=True))
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        out: list = [None] * len(texts)
        plain = np.flatnonzero(~odd)
        if len(plain):
            ids, ends = self._plain(texts if len(plain) == len(texts) else texts.take(pa.array(plain)))
            for k, row in enumerate(plain.tolist()):
                out[row] = ids[ends[k] : ends[k + 1]]
        for row in np.flatnonzero(odd).tolist():
            out[row] = self._odd(texts[row].as_py())
        return out

    def _long(self, text: str) -> np.ndarray:
        """Of a long text: cut at white space, unless it could spell a special token across that."""
        if not self.by_piece or any(x in text for x in self.specials):
            return self._ids(text)
        out, data, at = [], text.encode(), 0
        while at < len(data):
            end = min(at + AT_ONCE, len(data))
            while end < len(data) and data[end] not in b" \t\n\v\f\r":
                end += 1
            out += self._some(pa.array([data[at:end].decode()], pa.large_string()))
            at = end
        return np.concatenate(out)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """A uint32 array for each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out: list[np.ndarray] = []
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // AT_ONCE
        edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(texts)])) if len(texts) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            out += [self._long(texts[int(a)].as_py())] if b - a == 1 and size[a] > AT_ONCE else self._some(texts.slice(a, b - a))
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's own encoder: the vocabulary, and a bounded number of pieces."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
