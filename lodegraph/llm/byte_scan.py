"""A table-driven transducer over UTF-8 bytes, and hashes of the words that it finds.

The state after a byte is the byte's class, so what a byte emits is one entry of a table: the class of the byte before
it against its own.  All bytes of a block are looked up at once.  Blocks are bounded, whatever the length of a text.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Classes of bytes, which are the states of the transducer.
SPACE, OTHER, CAPITAL, SYMBOL, LEAD, TRAIL = range(6)
#: What a byte emits.
STARTS, ENDS, POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16
BLOCK = 1 << 20
_ODD = 0x9E3779B97F4A7C15


def _classes(symbols: bytes) -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[[32, *range(9, 14)]] = SPACE
    table[ord("A") : ord("Z") + 1] = CAPITAL
    table[0x80:0xC0] = TRAIL
    table[0xC0:] = LEAD
    table[list(symbols)] = SYMBOL
    return table


def _emissions() -> np.ndarray:
    table = np.zeros((6, 6), np.uint8)
    for now in range(6):
        table[:, now] = (now != TRAIL) * POINT | (now == CAPITAL) * IS_CAPITAL | (now == SYMBOL) * IS_SYMBOL
    table[SPACE, 1:] |= STARTS
    table[1:, SPACE] |= ENDS
    return table


_EMIT = _emissions().ravel()
CLASSES = {symbols: _classes(symbols) for symbols in (b"", b"#$%&*|")}


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts one after another, a space behind each, and where each begins."""
    sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    return b"".join(part for x in texts for part in (x, b" ")), np.cumsum(sizes) - sizes


def blocks(text: bytes, symbols: bytes = b"#$%&*|"):
    """(place, emissions) of each block of a text that ends with a space."""
    data, before = np.frombuffer(text, np.uint8), SPACE
    for at in range(0, len(data), BLOCK):
        states = CLASSES[symbols][data[at : at + BLOCK]]
        moves = states.copy()
        moves[0] += 6 * before
        moves[1:] += 6 * states[:-1]
        yield at, _EMIT[moves]
        before = states[-1]


def spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text that ends with a space begin and end."""
    found: tuple[list, list] = ([], [])
    for at, emitted in blocks(text):
        for places, flag in zip(found, (STARTS, ENDS), strict=True):
            places.append(np.flatnonzero(emitted & flag) + at)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found[0]]), np.concatenate([none, *found[1]])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers of an odd number modulo 2^64 and of its inverse, for hashes of runs from prefix sums.
POWERS = np.cumprod(np.full(BLOCK + 1, _ODD, np.uint64))
INVERSES = np.cumprod(np.full(BLOCK + 1, pow(_ODD, -1, 1 << 64), np.uint64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def _hashes(own: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * POWERS[: len(own)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * INVERSES[starts] + (ends - starts).astype(np.uint64))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs [start, end) of bytes or of other hashes; neither starts nor ends ever decrease.

    Equal runs have equal hashes, wherever they lie.
    """
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        first = int(starts[at])
        to = int(np.searchsorted(ends, first + BLOCK, "right"))
        if to == at:  # a run longer than a block
            out[at] = xxhash.xxh64_intdigest(values[first : int(ends[at])].tobytes())
            to += 1
        else:
            own = values[first : int(ends[to - 1])]
            own = _BYTES[own] if own.dtype == np.uint8 else own
            out[at:to] = _hashes(own, starts[at:to] - first, ends[at:to] - first)
        at = to
    return out


def word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return run_hashes(np.frombuffer(text, np.uint8), starts, ends)


class WordTable:
    """Open addressing over (document, word), with many words put in at once.

    A slot keeps the place of the word that took it.  A word that meets a taken slot is the same one only if document,
    hash, length and bytes agree; otherwise it goes on to the next slot.
    """

    def __init__(self, text: bytes):
        self.text = text
        # eight bytes from any place, read as a number
        self.eight = np.ndarray((len(text),), "<u8", text + bytes(8), strides=(1,))
        self.held, self.slots = 0, 0
        self._make(1 << 12)

    def _make(self, slots: int) -> None:
        self.place = np.full(slots, -1, np.int64)
        self.size, self.owner = np.empty(slots, np.int64), np.empty(slots, np.int64)
        self.print = np.empty(slots, np.uint64)
        self.slots = slots

    def insert(self, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Which of the words are new in the table."""
        room = 2 * (self.held + len(starts))
        if room > self.slots:
            taken = np.flatnonzero(self.place >= 0)
            old = [x[taken] for x in (self.owner, self.place, self.size, self.print)]
            self._make(1 << int(room).bit_length())
            self._put(old[0], old[1], old[2], old[3])
        new = self._put(owner, starts, ends - starts, prints)
        self.held += int(new.sum())
        return new

    def _put(self, owner: np.ndarray, place: np.ndarray, size: np.ndarray, prints: np.ndarray) -> np.ndarray:
        new, left = np.zeros(len(place), bool), np.arange(len(place))
        at = mix(prints + owner.astype(np.uint64) * np.uint64(_ODD)).astype(np.int64)
        while len(left):
            slot = at[left] & (self.slots - 1)
            free = self.place[slot] < 0
            self.place[slot[free]] = place[left[free]]  # of several words the last one stays
            won = self.place[slot] == place[left]
            mine, winners = slot[won], left[won]
            self.size[mine], self.owner[mine], self.print[mine] = size[winners], owner[winners], prints[winners]
            new[winners] = True
            lost = ~won
            slot, left = slot[lost], left[lost]
            same = self.print[slot] == prints[left]
            same &= (self.owner[slot] == owner[left]) & (self.size[slot] == size[left])
            same[same] = self._equal(self.place[slot[same]], place[left[same]], size[left[same]])
            left = left[~same]
            at[left] += 1
        return new

    def _equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes agree: the first and last eight, and in words over 16 bytes all of them."""
        short = np.minimum(size, 8)
        mask = np.where(short == 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * (short % 8)).astype(np.uint64)) - np.uint64(1))
        same = ((self.eight[a] ^ self.eight[b]) & mask) == 0
        tail = np.maximum(size - 8, 0)
        same &= ((self.eight[a + tail] ^ self.eight[b + tail]) & mask) == 0
        for i in np.flatnonzero(same & (size > 16)).tolist():
            n, x, y = int(size[i]), int(a[i]), int(b[i])
            same[i] = self.text[x : x + n] == self.text[y : y + n]
        return same
