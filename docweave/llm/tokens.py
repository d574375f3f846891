"""Token ids of whole texts, encoded word by word with a bounded cache.

The vocabulary's normaliser and splitter never look across a space or a line
feed: white space only separates, and neither composition nor lower-casing
crosses it.  So the ids of a text are the ids of its space-separated pieces in
order.  Each Python worker keeps where the ids of the pieces it has met lie (at
most ``CACHE`` pieces).  A piece of up to 16 bytes is looked up by its bytes,
two 64-bit words filled up with spaces, in arrays, all of a batch at once; a
longer piece by its bytes in a dictionary.  A new piece is reduced before it goes
to the tokenizer: Latin-1 letters to lower case, as the normaliser does, and a
full stop or comma after a letter at its end apart, as the splitter does; so
most new pieces are spellings of a word that is known already.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from .common import mixed, utf8_parts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Pieces whose ids a worker keeps; beyond that it starts anew with the next texts.
CACHE = 1_200_000
#: Words, and characters in them, that it keeps by name to recognise new spellings of them.
WORDS = 300_000
WORD_CHARS = 6_000_000
#: Bytes and texts that are worked on at once (arrays that stay in a core's cache).
STRETCH = 1 << 19
STRETCH_TEXTS = 1 << 12
#: Longer texts are encoded on their own, without the cache.
LONG = 1 << 19
#: Bytes of a piece that fit into a key, and a word of spaces.
SHORT = 16
_SPACES = np.uint64(0x2020202020202020)
#: Element i keeps the first i bytes of a little-endian word.
_FIRST = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def piece_keys(padded: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words that name each piece of at most ``SHORT`` bytes: equal only for equal pieces.

    No piece holds a space, so spaces fill it up; 16 bytes must follow each
    begin.  The first word is mixed with the second one, which can be undone.
    """
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    first, second = _FIRST[np.minimum(length, 8)], _FIRST[np.maximum(length - 8, 0)]
    a = words[begin] & first | _SPACES & ~first
    b = words[begin + 8] & second | _SPACES & ~second
    return mixed(a ^ mixed(b)), b


class HashTable:
    """128-bit keys to numbers, by open addressing; all operations take arrays."""

    def __init__(self, slots: int):
        self.mask = np.uint64(slots - 1)
        self.key = np.zeros((2, slots), np.uint64)
        self.number = np.full(slots, -1, np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of the keys (a, b); -1 where there is none."""
        slot = (a & self.mask).astype(np.int64)
        out = self.number[slot]
        todo = np.flatnonzero((out >= 0) & ((self.key[0, slot] != a) | (self.key[1, slot] != b)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(self.mask)
            at = slot[todo]
            out[todo] = self.number[at]
            todo = todo[(out[todo] >= 0) & ((self.key[0, at] != a[todo]) | (self.key[1, at] != b[todo]))]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, number: np.ndarray) -> None:
        """Store keys that are distinct and not there yet."""
        slot = (a & self.mask).astype(np.int64)
        todo = np.arange(len(a))
        while len(todo):
            taken = self.number[slot[todo]] >= 0
            free = todo[~taken]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.key[0, slot[put]], self.key[1, slot[put]] = a[put], b[put]
            self.number[slot[put]] = number[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & int(self.mask)


class PieceEncoder:
    """Ids of texts; the ids of known pieces lie in one growing array."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), np.bool_)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.table = HashTable(1 << max(10, (CACHE * 5 // 4).bit_length()))
        self.longer: dict[bytes, int] = {}
        self.kept = 0  # pieces in the table, and those that are longer
        self.number: dict[str, int] = {}  # of a word
        self.known = 0  # numbers given out
        self.chars = 0
        self.begin = np.zeros(1 << 16, np.int64)  # of number i: ids[begin[i]:begin[i + 1]]
        self.ids = np.zeros(1 << 18, np.uint32)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each)."""
        if all(map(str.isalpha, pieces)):
            # runs of letters stay whole, so each ends with its one word-ending id
            joined = self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0]
            ids = np.array(joined.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(pieces):
                return ids, np.diff(ends, prepend=0)
        each = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((i for ids in each for i in ids), np.uint32, int(lengths.sum())), lengths

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Append ids; the numbers under which they are found."""
        first, need = self.known, self.known + len(lengths) + 1
        if need > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros(max(need, len(self.begin)), np.int64)])
        self.begin[first + 1:need] = self.begin[first] + np.cumsum(lengths)
        end = int(self.begin[need - 1])
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end, len(self.ids)), np.uint32)])
        self.ids[self.begin[first]:end] = ids
        self.known = need - 1
        return np.arange(first, self.known)

    def _learn(self, words: set[str]) -> None:
        """Encode words that are not known yet; runs of letters together."""
        letters = [w for w in words if w.isalpha()]
        others = [w for w in words if not w.isalpha()]
        for part in (letters, others):
            if part:
                self.number.update(zip(part, self._store(*self._encoded(part)).tolist(), strict=True))
                self.chars += sum(map(len, part))

    def _add(self, pieces: list[str]) -> np.ndarray:
        """The numbers of new pieces."""
        words, closing = [], []
        for piece in pieces:
            sign = ""
            if "<|" not in piece:  # special tokens are matched before lower-casing
                if piece[-1] in ".," and piece[-2:-1].isalpha():
                    piece, sign = piece[:-1], piece[-1]
                if piece.isascii() or _latin(piece):
                    piece = piece.lower()
            words.append(piece)
            closing.append(sign)
        self._learn({*words, ".", ","}.difference(self.number))
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        closed = np.array([bool(c) for c in closing], np.bool_)
        if closed.any():
            signs = np.array([self.number[c] for c in closing if c], np.int64)
            ids, lengths = self._gather(np.stack([out[closed], signs], axis=1).ravel())
            out[closed] = self._store(ids, lengths.reshape(-1, 2).sum(axis=1))
        return out

    def _gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces with these numbers in order, number of ids of each)."""
        begin = self.begin[number]
        lengths = self.begin[number + 1] - begin
        # each id's place: its piece's begin plus its place within the piece
        shift = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
        shift += np.arange(len(shift))
        return self.ids[shift], lengths

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts between ``bounds`` in order as uint32, number of ids of each text)."""
        if self.kept > CACHE:
            self.clear()
        if len(self.number) > WORDS or self.chars > WORD_CHARS:
            self.number, self.chars = {}, 0  # the ids of known pieces stay
        n_rows = len(bounds) - 1
        # a space before each text and at the end, where a key's words may be read beyond it
        padded = np.full(len(data) + n_rows + 1 + SHORT, 0x20, np.uint8)
        row_of = np.repeat(np.arange(n_rows, dtype=np.int32), np.diff(bounds))
        padded[np.arange(1, len(data) + 1) + row_of] = data
        apart = (padded == 0x20) | (padded == 0x0A)
        change = np.diff(apart.view(np.int8))
        begin, end = np.flatnonzero(change == -1) + 1, np.flatnonzero(change == 1) + 1
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(n_rows, np.int64)
        length = end - begin
        short = np.flatnonzero(length <= SHORT)
        number = np.full(len(begin), -1, np.int64)
        a, b = piece_keys(padded, begin[short], length[short])
        number[short] = self.table.find(a, b)
        unknown = np.flatnonzero(number[short] < 0)
        whole = padded.tobytes()
        if len(unknown):
            order = unknown[np.lexsort((b[unknown], a[unknown]))]
            new = np.ones(len(order), np.bool_)
            new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
            first = order[new]
            added = self._add([whole[x:y].decode() for x, y in
                               zip(begin[short[first]].tolist(), end[short[first]].tolist(), strict=True)])
            number[short[order]] = added[np.cumsum(new) - 1]
            self.table.add(a[first], b[first], added)
            self.kept += len(first)
        long = np.flatnonzero(length > SHORT)
        if len(long):
            pieces = [whole[x:y] for x, y in zip(begin[long].tolist(), end[long].tolist(), strict=True)]
            fresh = list(set(pieces).difference(self.longer))
            if fresh:
                self.longer.update(zip(fresh, self._add([f.decode() for f in fresh]).tolist(), strict=True))
                # the table may hold so many short ones; a long one counts by its size
                self.kept += sum(1 + len(f) // 64 for f in fresh)
            number[long] = np.fromiter(map(self.longer.__getitem__, pieces), np.int64, len(pieces))
        ids, lengths = self._gather(number)
        row = np.searchsorted(bounds[:-1] + np.arange(n_rows) + 1, begin, side="right") - 1
        return ids, np.bincount(row, lengths, minlength=n_rows).astype(np.int64)

    def encode_alone(self, text: str) -> np.ndarray:
        """The ids of one very long text; its different pieces are encoded some at a time."""
        pieces = text.replace("\n", " ").split(" ")
        number = {piece: i for i, piece in enumerate(dict.fromkeys(pieces))}
        each, lengths = [], []
        different = list(number)
        for at in range(0, len(different), 10_000):
            ids, n = self._encoded([p or " " for p in different[at:at + 10_000]])
            each.append(ids)
            lengths.append(n)
        size = np.concatenate(lengths)
        begin = np.cumsum(size) - size
        order = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        taken = size[order]
        shift = np.repeat(begin[order] - (np.cumsum(taken) - taken), taken)
        return np.concatenate(each)[shift + np.arange(len(shift))]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> PieceEncoder:
    """The worker's encoder of a vocabulary file."""
    return PieceEncoder(vocabulary)


def encoded(column: pa.Array, vocabulary: str = VOCABULARY) -> Iterator[np.ndarray]:
    """The ids of each text of an Arrow string column; null counts as empty."""
    data, bounds = utf8_parts(column)
    known, at = encoder(vocabulary), 0
    while at < len(bounds) - 1:
        if bounds[at + 1] - bounds[at] > LONG:
            yield known.encode_alone(data[bounds[at]:bounds[at + 1]].tobytes().decode())
            at += 1
            continue
        end = int(np.searchsorted(bounds, bounds[at] + STRETCH, side="right")) - 1  # as many texts as fit
        end = max(at + 1, min(end, at + STRETCH_TEXTS))
        ids, lengths = known.encode(data[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at])
        yield from np.split(ids, np.cumsum(lengths)[:-1])
        at = end


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
