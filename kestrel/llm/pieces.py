"""A public SentencePiece BPE vocabulary inside a task: the file is read from
a path that the caller gives (on a cluster each node has it installed), once
for a worker process."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import sentencepiece

from kestrel.llm.kernels import mix

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_OPEN: dict[str, "Pieces"] = {}


def model_path(name: str = MODEL) -> str:
    return public_tokenizers.path(name)


class Pieces:
    """The normal pieces with their merge ranks (small ranks merge first)."""

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.scores = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def pieces(path: str) -> Pieces:
    if path not in _OPEN:
        _OPEN[path] = Pieces(path)
    return _OPEN[path]


def marked(text: str) -> str:
    """The model's own form of a text: spaces become marks, one is put before."""
    return SPACE + text.replace(" ", SPACE)


class Matcher:
    """All places where pieces stand in a text, found for all positions at
    once: a window grows by a character while it begins some piece."""

    #: Places of a level's table for each key, as a power of two.
    SPARE_BITS = 2

    def __init__(self, vocabulary: Pieces):
        self.longest = vocabulary.longest
        begins: dict[str, int] = {}
        for p, i in vocabulary.ids.items():
            for n in range(1, len(p)):
                begins.setdefault(p[:n], -1)
            begins[p] = i
        keys = np.array([self._hash(codes(p))[0] for p in begins], np.uint64)
        values = np.array(list(begins.values()), np.int32)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces with one hash")
        self.levels = []
        while len(keys):  # keys that meet at a place of one table go to the next
            bits = len(keys).bit_length() + self.SPARE_BITS
            slot = self._slot(keys, len(self.levels), bits)
            _, first = np.unique(slot, return_index=True)
            held, value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32)
            held[slot[first]], value[slot[first]] = keys[first], values[first]
            self.levels.append((bits, held, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    @staticmethod
    def _letter(c: np.ndarray, at: int) -> np.ndarray:
        return mix(c.astype(np.uint64) + np.uint64(0x51ED270B)) * np.uint64((0x9E3779B97F4A7C15 * (2 * at + 1) ** 5) % (1 << 64) | 1)

    def _hash(self, c: np.ndarray) -> np.ndarray:
        return sum((self._letter(c[j:j + 1], j) for j in range(len(c))), np.zeros(1, np.uint64))

    def _slot(self, keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(keys + np.uint64(level)) >> np.uint64(64 - bits)).astype(np.int64)

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        bits, held, value = self.levels[0]
        slot = self._slot(keys, 0, bits)
        out = value[slot]
        other = held[slot] != keys
        left = np.flatnonzero(other & (out > -2))  # the keys of a free place are nowhere
        out[other] = -2
        for n, (bits, held, value) in enumerate(self.levels[1:], 1):
            slot = self._slot(keys[left], n, bits)
            found, hit = value[slot], held[slot] == keys[left]
            out[left[hit]] = found[hit]
            left = left[~hit & (found > -2)]
        return out

    def edges(self, c: np.ndarray, ends: np.ndarray):
        """``(start, length, piece id)`` of all pieces in the code points
        ``c``; ``ends`` holds for each position where its unit ends."""
        letters = mix(c.astype(np.uint64) + np.uint64(0x51ED270B))
        at, key = np.arange(len(c)), np.zeros(len(c), np.uint64)
        starts, lengths, ids = [], [], []
        for n in range(self.longest):
            at, key = at[(go := at + n < ends[at])], key[go]
            if not len(at):
                break
            key = key + letters[at + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * n + 1) ** 5) % (1 << 64) | 1)
            found = self._look_up(key)
            hit = found >= 0
            starts.append(at[hit])
            ids.append(found[hit])
            lengths.append(np.full(len(ids[-1]), n + 1, np.int16))
            at, key = at[(go := found > -2)], key[go]
        none = [np.zeros(0, np.int64)]
        return np.concatenate(starts or none), np.concatenate(lengths or none), np.concatenate(ids or none)


def codes(text: str) -> np.ndarray:
    """Code points; lone surrogates, which no UTF-8 text has, pass as such."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_MATCHERS: dict[str, Matcher] = {}


def matcher(path: str) -> Matcher:
    if path not in _MATCHERS:
        _MATCHERS[path] = Matcher(pieces(path))
    return _MATCHERS[path]
