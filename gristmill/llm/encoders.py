"""Fast exact encoding with the tokenizers library: text is cut where no token can span, and the library is asked once for a piece.

A tokenizer's pre-tokenizer never joins what stands on both sides of such a cut, so the ids of a text are the ids of its
pieces in a row. Pieces repeat a lot: their ids are kept in a table of bounded size, looked up by 64-bit hash for a whole
batch of texts at once. Texts in which the cuts aren't safe or that hold the string of a special token, and very long
pieces, are encoded whole by the library, as it is: a special token's string is that token.
"""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

from .wordhash import hashes

#: Pieces of more bytes aren't kept.
LONGEST = 64
SPACE, FEED = 0x20, 0x0A


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable Latin-1, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return table


LETTERS = byte_letters()


class Encoder:
    """Encodes batches of UTF-8 texts; subclasses say where to cut. Holds at most `keep` pieces, then starts anew."""

    def __init__(self, path: str, keep: int = 1_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.keep = keep
        self.reset()

    def reset(self) -> None:
        self.slots = 1 << int(np.ceil(np.log2(self.keep * 2)))
        self.keys = np.zeros(0, np.uint64)
        self.hash = np.zeros(self.slots, np.uint64)
        self.entry = np.full(self.slots, -1, np.int32)
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, self.dtype)
        self.entries = self.used = 0

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def piece(self, piece: str) -> list[int]:
        raise NotImplementedError

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces."""
        raise NotImplementedError

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """cuts(), but texts with a special token's string are one piece each."""
        starts, ends = self.cuts(data, offsets)
        raw, whole = data.tobytes(), set()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                t = int(np.searchsorted(offsets, at, "right")) - 1
                whole.add(t)
                at = raw.find(s, int(offsets[t + 1]))
        if whole:
            texts = np.array(sorted(whole))
            keep = ~np.isin(np.searchsorted(offsets, starts, "right") - 1, texts)
            starts, ends = np.sort(np.concatenate([starts[keep], offsets[texts]])), np.sort(np.concatenate([ends[keep], offsets[texts + 1]]))
        return starts, ends

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        mask = self.slots - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        out = self.entry[slot]
        rest = np.flatnonzero((out >= 0) & (self.hash[slot] != keys))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & mask
            out[rest] = self.entry[slot[rest]]
            rest = rest[(out[rest] >= 0) & (self.hash[slot[rest]] != keys[rest])]
        return out

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        n = len(keys)
        sizes = np.fromiter(map(len, ids), np.int32, n)
        flat = np.fromiter((x for y in ids for x in y), self.dtype, int(sizes.sum()))
        while self.entries + n > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(flat)] = flat
        self.at[self.entries : self.entries + n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.entries : self.entries + n] = sizes
        self.keys = np.concatenate([self.keys, keys])
        fresh = np.arange(self.entries, self.entries + n, dtype=np.int32)
        self.entries, self.used = self.entries + n, self.used + len(flat)
        if 2 * self.entries > self.slots:  # one batch may hold more pieces than are kept
            while 2 * self.entries > self.slots:
                self.slots *= 2
            self.hash, self.entry = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32)
            fresh = np.arange(self.entries, dtype=np.int32)
        self.insert(self.keys[fresh], fresh)

    def insert(self, keys: np.ndarray, entry: np.ndarray) -> None:
        mask = self.slots - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            free = rest[self.entry[slot[rest]] < 0]
            self.entry[slot[free]] = entry[free]  # of those for one slot, one gets it
            got = free[self.entry[slot[free]] == entry[free]]
            self.hash[slot[got]] = keys[got]
            rest = rest[self.entry[slot[rest]] != entry[rest]]
            slot[rest] = (slot[rest] + 1) & mask

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        if self.entries > self.keep:
            self.reset()
        starts, ends = self.pieces(data, offsets)
        short = ends - starts <= LONGEST
        entry = np.full(len(starts), -1, np.int64)
        keys = hashes(data, starts[short], ends[short])
        found = self.find(keys)
        if (new := np.flatnonzero(found < 0)).size:
            fresh, first = np.unique(keys[new], return_index=True)
            where = np.flatnonzero(short)[new[first]]
            raw = data.tobytes()
            self.add(fresh, [self.piece(raw[a:b].decode()) for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            found[new] = self.find(keys[new])
        entry[short] = found
        size = np.zeros(len(starts), np.int64)
        at = np.zeros(len(starts), np.int64)
        size[short], at[short] = self.size[found], self.at[found]
        pool = self.pool
        if len(rare := np.flatnonzero(~short)):
            more = [np.array(self.whole(data[a:b].tobytes().decode()), self.dtype) for a, b in zip(starts[rare].tolist(), ends[rare].tolist(), strict=True)]
            size[rare] = [len(x) for x in more]
            at[rare] = self.used + np.cumsum(size[rare]) - size[rare]
            pool = np.concatenate([self.pool[: self.used], *more])
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        ids = pool[np.repeat(at - before[:-1], size) + np.arange(before[-1])]
        return ids, np.diff(before[np.searchsorted(starts, offsets)])


def odd_spaces(data: np.ndarray) -> np.ndarray:
    """Where white space other than space and line feed starts."""
    found = [np.flatnonzero(((data >= 0x09) & (data <= 0x0D) & (data != FEED)) | ((data >= 0x1C) & (data <= 0x1F)))]
    for lead, rest in ((0xC2, ((0x85,), (0xA0,))), (0xE1, ((0x9A, 0x80),)), (0xE2, (*((0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F))), (0xE3, ((0x80, 0x80),))):
        at = np.flatnonzero(data == lead)
        at = at[at + len(rest[0]) < len(data)]
        for tail in rest if len(at) else ():
            found.append(at[np.logical_and.reduce([data[at + i + 1] == x for i, x in enumerate(tail)])])
    return np.concatenate(found)


class ByteLevelEncoder(Encoder):
    """For byte-level BPE with the usual pattern: cut before each single space and around each single line feed.

    A text with other white space, two in a row, or one at either end is one piece.
    """

    def piece(self, piece: str) -> list[int]:
        body = piece[1:] if piece[0] == " " else piece
        if body.isalpha():
            letters = "Ġ" * (piece[0] == " ") + body if body.isascii() else piece.encode().decode("latin-1").translate(LETTERS)
            return [t.id for t in self.model.tokenize(letters)]
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return self.piece(piece[:-1]) + self.whole(body[-1])
        return self.whole(piece)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = offsets[:-1][np.diff(offsets) > 0]
        feed = data == FEED
        white = feed | (data == SPACE)
        start = white.copy()
        start[1:] |= feed[:-1]
        start[first] = True
        head, last = np.zeros(len(data), bool), offsets[1:][np.diff(offsets) > 0] - 1
        head[first] = True
        twice = np.flatnonzero(white[1:] & white[:-1] & ~head[1:]) + 1
        odd = np.concatenate([twice, first[white[first]], last[white[last]], odd_spaces(data)])
        if len(odd):
            texts = np.unique(np.searchsorted(offsets, odd, "right") - 1)
            for t in texts.tolist():
                start[offsets[t] + 1 : offsets[t + 1]] = False
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        return starts, ends


class WordEndEncoder(Encoder):
    """For BPE with word ends, lower case, white space dropped: cut at every space and line feed."""

    def piece(self, piece: str) -> list[int]:
        if piece.isascii() or max(piece) <= "\xff":  # already NFC, and lower case goes letter by letter
            if piece.isalpha():
                low = piece.lower()
                return [t.id for t in self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(LETTERS))]
            if piece[-1] in ".," and piece[:-1].isalpha():
                return self.piece(piece[:-1]) + self.whole(piece[-1])
        return self.whole(piece)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        from .wordhash import words

        breaks = np.zeros(256, bool)
        breaks[[SPACE, FEED]] = True
        return words(data, offsets, breaks)


_encoders: dict[tuple, Encoder] = {}


def encoder(kind: type[Encoder], path: str) -> Encoder:
    """One for each worker process."""
    key = (kind.__name__, path)
    if key not in _encoders:
        _encoders[key] = kind(path)
    return _encoders[key]
