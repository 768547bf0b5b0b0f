"""SentencePiece encoding by sampling without replacement, and decoding.

A text's segmentations into pieces of a public vocabulary get probabilities in
proportion to the product of their pieces' weights (a power law of the
piece's rank in the vocabulary file; nothing is trained). Gumbel top-k draws
``k`` distinct segmentations without replacement (Kool et al., 2019): each
segmentation's log-probability gets Gumbel noise, and the ``k`` largest
perturbed values win. An A* search finds them without listing the others: a
subtree's best perturbed value is a Gumbel variable of the subtree's own
probability, so the search keeps a queue of subtrees by that value, takes the
best, walks its best child to the leaf and queues the siblings passed on the
way, their values truncated at their parent's.

Two facts make it fast on whole texts: the best children of a walk are a plain
sample from the lattice's conditional probabilities, drawn for all units
(spaces and what follows them) of all texts of a slice at once over one lattice
for each distinct unit; and a
sibling's value cannot exceed its log-probability plus 22.9 (noise comes from
32-bit numbers), so siblings below the queue's k-th best by that bound are
not drawn. The noise is a hash of seed, row key, sample and place: a rerun
task gives the same rows.

``log_inclusion`` is the log of the sample's inclusion probability given the
threshold, the (k+1)-th perturbed value; 0 if there is no such value.

Defined results: NULL and empty texts have one segmentation, the empty one;
a text with fewer than ``k`` segmentations gives all of them; a character of
no piece is its UTF-8 bytes; a text's own "lower one eighth block" mark
decodes as a space, as the library has it; NULL keys are one key; repeated
rows get equal samples; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.kernels import mix
from kestrel.llm.pieces import SPACE, codes, marked, matcher, model_path, pieces
from kestrel.llm.prefix_tokens import parts_of
from kestrel.llm.tables import texts

SAMPLES = 2
LONG_UNIT = 300
NOISE_BOUND = 22.9
_BLOCK = 64
#: Characters of the texts drawn at once, over one lattice.
SLICE_CHARS = 1 << 17
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Nats a character that keep the masses of short units near 1.
SCALE = 2.0


def piece_logs(path: str) -> tuple[np.ndarray, float]:
    """Log-weights by piece id, and that of a byte."""
    v = pieces(path)
    size = v.model.get_piece_size()
    rank = np.full(size, float(size))
    for p, i in v.ids.items():
        rank[i] = min(size, -v.scores[p])
    logs = -np.log(rank + 10.0)
    total = np.log(np.exp(logs).sum())
    return logs - total, -np.log(size + 10.0) - total


class Lattice:
    """The lattices of distinct units, side by side. Places are positions in the
    units joined together; the edges of a place are neighbours. ``piece`` is an
    edge's piece id, or minus the number of bytes of a character of no piece."""

    def __init__(self, path: str, units: list[str]):
        self.path = path
        if path not in _LOGS:
            logs, byte_log = piece_logs(path)
            sizes = np.array([len(pieces(path).model.id_to_piece(i)) for i in range(len(logs))])
            _LOGS[path] = logs, np.exp(logs + SCALE * sizes), byte_log
        self.logs, scaled, self.byte_log = _LOGS[path]
        self.code = c = codes("".join(units))
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))]).astype(np.int64)
        self.units = bounds[:-1]
        self.ends = np.repeat(bounds[1:], np.diff(bounds))
        start, length, piece = matcher(path).edges(c, self.ends)
        lone = np.ones(len(c), bool)
        lone[start[length == 1]] = False
        lone = np.flatnonzero(lone)
        utf8 = 1 + (c[lone] >= 0x80).astype(np.int32) + (c[lone] >= 0x800) + (c[lone] >= 0x10000)
        counts = np.bincount(start, minlength=len(c) + 1)[:len(c) + 1]
        counts[lone] += 1
        self.first = np.concatenate([[0], np.cumsum(counts[:len(c)])]).astype(np.int64)
        n = int(self.first[-1])
        self.length, self.piece, self.scaled = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
        free = self.first[:-1].copy()  # the places' next edges
        at = free[lone]
        self.length[at], self.piece[at], self.scaled[at] = 1, -utf8, np.exp(self.byte_log * utf8 + SCALE)
        free[lone] += 1
        steps = np.searchsorted(length, np.arange(1, (int(length[-1]) if len(length) else 0) + 2))
        for a, b in zip(steps[:-1], steps[1:], strict=True):  # the places of one length differ
            at = free[start[a:b]]
            free[start[a:b]] = at + 1
            self.length[at], self.piece[at], self.scaled[at] = length[a:b], piece[a:b], scaled[piece[a:b]]
        self.start = np.repeat(np.arange(len(c)), np.diff(self.first))
        self.share = self._shares()
        self.rising = np.concatenate([[0.0], np.cumsum(self.share)])  # before each edge

    def _shares(self) -> np.ndarray:
        """Each edge's conditional probability at its place."""
        end = self.start + self.length
        inner = end < self.ends[self.start]
        size = self.ends - np.arange(len(self.code))  # characters to the unit's end
        unit_size = self.ends - np.repeat(self.units, np.diff(np.append(self.units, len(self.code))))
        long_ = unit_size > LONG_UNIT
        any_long = bool(long_.any())
        scaled = self.scaled
        if any_long:
            weight = np.where(self.piece < 0, -self.byte_log * self.piece, self.logs[self.piece])
            scaled = np.where(long_[self.start], weight, scaled)
        mass, share = np.zeros(len(self.code) + 1), np.empty(len(scaled))
        most = int(size.max()) if len(size) else 0
        by = np.argsort(size.astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")  # 16 bits: a radix sort
        groups = np.searchsorted(size[by], np.arange(1, most + 2))
        for a, b in zip(groups[:-1], groups[1:], strict=True):
            for log_domain in (False, True) if any_long else (False,):
                at = by[a:b][long_[by[a:b]] == log_domain] if any_long else by[a:b]
                if not len(at):
                    continue
                n = self.first[at + 1] - self.first[at]
                seg = np.concatenate([[0], np.cumsum(n)[:-1]])
                e = np.repeat(self.first[at] - seg, n) + np.arange(int(n.sum()))
                if log_domain:
                    x = scaled[e] + np.where(inner[e], mass[end[e]], 0.0)
                    mass[at] = total = np.logaddexp.reduceat(x, seg)
                    share[e] = np.exp(x - np.repeat(total, n))
                else:
                    x = scaled[e] * np.where(inner[e], mass[end[e]], 1.0)
                    mass[at] = total = np.add.reduceat(x, seg)
                    share[e] = x / np.repeat(total, n)
        return share

    def walk(self, at: np.ndarray, keys: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each place to its unit's end by the conditional probabilities:
        the edges taken, one walk after the other, and each walk's number of
        edges. ``keys`` seed the walks, ``place + shift`` is a place's noise."""
        live, steps = np.arange(len(at)), []
        n = np.zeros(len(at), np.int64)
        at = at.copy()
        while len(live):
            here = at[live]
            lo, hi = self.first[here], self.first[here + 1]
            base = self.rising[lo]
            to = base + uniform(keys[live], here + shift[live]) * (self.rising[hi] - base)
            e = hi - 1  # the longest pieces are last and likeliest
            back = np.flatnonzero(e > lo)
            while len(back := back[self.rising[e[back]] > to[back]]):
                e[back] -= 1
                back = back[e[back] > lo[back]]
            steps.append((live, e))
            n[live] += 1
            at[live] = here + self.length[e]
            live = live[at[live] < self.ends[here]]
        first = np.cumsum(n) - n
        taken = np.zeros(int(n.sum()), np.int64)
        for k, (who, e) in enumerate(steps):
            taken[first[who] + k] = e
        return taken, n


_LOGS: dict[str, tuple[np.ndarray, np.ndarray, float]] = {}


def uniform(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 (neither included), 32 bits, by key and place."""
    return ((mix(keys + mix(at.astype(np.uint64) + np.uint64(1))) >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32


def sample_slice(path: str, values: list[str], keys: np.ndarray, k: int):
    """Per text a list of ``(ids, log_prob, perturbed, log_inclusion)`` in the
    order of the draw."""
    split = [_UNIT.findall(marked(t)) if t else [] for t in values]
    number: dict[str, int] = defaultdict(count().__next__)  # of the distinct units, as they come
    of = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64)
    lat = Lattice(path, list(number))
    doc = np.concatenate([[0], np.cumsum([len(u) for u in split])]).astype(np.int64)  # texts' first units
    start = lat.units[of]
    size = np.append(lat.units, len(lat.code))[of + 1] - start if len(of) else start
    shift = np.cumsum(size) - size - start  # from a place to where it stands in the slice
    n_docs = len(values)
    text_of = np.repeat(np.arange(n_docs), np.diff(doc))
    base = np.concatenate([[0], np.cumsum(size)])[doc]
    shift -= np.repeat(base[:-1], np.diff(doc))  # and in its text
    root = -np.log(-np.log(uniform(mix(keys), np.zeros(n_docs, np.int64))))
    queue: list[list] = [[] for _ in range(n_docs)]  # (-value, sample it leaves, step, edge)
    out: list[list] = [[] for _ in range(n_docs)]
    live = [(d, float(root[d]), None, 0, 0) for d in range(n_docs)]  # text, value, sample left, step, edge
    for rank in range(k):
        seeds, noise = mix(keys + np.uint64(2 * rank + 2)), mix(keys + np.uint64(2 * rank + 3))
        at, which, heads = [], [], []
        for d, _, left, step, edge in live:
            first = doc[d]
            head = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if left is not None:
                edges, units = out[d][left][:2]
                head = np.append(edges[:step], edge), units[:step + 1]
                first = units[step] + 1
                to = lat.start[edge] + lat.length[edge]
                if to < lat.ends[lat.start[edge]]:
                    at.append(np.array([to]))
                    which.append(units[step:step + 1])
            at.append(start[first:doc[d + 1]])
            which.append(np.arange(first, doc[d + 1]))
            heads.append(head)
        if not live:
            break
        at, which = np.concatenate(at), np.concatenate(which)
        taken, n = lat.walk(at, seeds[text_of[which]], shift[which])
        units_taken = np.repeat(which, n)
        cuts = np.searchsorted(units_taken, doc)
        parts = [(np.concatenate([h, taken[cuts[d]:cuts[d + 1]]]), np.concatenate([u, units_taken[cuts[d]:cuts[d + 1]]])) for (d, *_), (h, u) in zip(live, heads, strict=True)]
        edges, units = (np.concatenate(x) for x in zip(*parts, strict=True))
        bounds = np.concatenate([[0], np.cumsum([len(e) for e, _ in parts])]).astype(np.int64)
        shares = np.log(lat.share[edges])
        after = np.empty_like(shares)
        for (d, value, *_), (e, u), lo, hi in zip(live, parts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            np.cumsum(shares[lo:hi], out=after[lo:hi])
            out[d].append((e, u, float(after[hi - 1]) if hi > lo else 0.0, value))
        texts_ = np.array([x[0] for x in live])
        values_ = np.array([x[1] for x in live])
        place = bounds[:-1] + np.array([0 if left is None else step + 1 for _, _, left, step, _ in live])  # the next edge whose siblings are due
        need = k - rank
        due = np.flatnonzero(place < bounds[1:])
        while len(due := _open(due, place, after, shares, [queue[d] for d in texts_[due]], need)):
            m = np.minimum(place[due] + _BLOCK, bounds[due + 1]) - place[due]
            i = _ranges(place[due], m)
            owner = np.repeat(due, m)
            nodes = lat.start[edges[i]]
            m = lat.first[nodes + 1] - lat.first[nodes]
            e = _ranges(lat.first[nodes], m)
            other = e != np.repeat(edges[i], m)
            e, i, owner = e[other], np.repeat(i, m)[other], np.repeat(owner, m)[other]
            phi = after[i] - shares[i] + np.log(lat.share[e])
            where = (lat.start[e] + shift[units[i]]) * 64 + lat.length[e]
            lowered = phi - np.log(np.exp(np.minimum(phi - values_[owner], 700.0)) - np.log(uniform(noise[texts_[owner]], where)))
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            for _ in range(need if len(first) else 0):  # each text's best ones
                best = np.maximum.reduceat(lowered, first)
                hit = np.flatnonzero((lowered == np.repeat(best, np.diff(first, append=len(owner)))) & (lowered > -np.inf))
                for d, v, step, edge in zip(texts_[owner[hit]].tolist(), lowered[hit].tolist(), (i[hit] - bounds[owner[hit]]).tolist(), e[hit].tolist(), strict=True):
                    heapq.heappush(queue[d], (-v, rank, step, edge))
                lowered[hit] = -np.inf
            place[due] = np.minimum(place[due] + _BLOCK, bounds[due + 1])
            due = due[place[due] < bounds[due + 1]]
        live = []
        for d in texts_.tolist() if rank + 1 < k else ():
            if queue[d]:
                g, left, step, edge = heapq.heappop(queue[d])
                live.append((d, -g, left, step, edge))
    ids = _ids(lat, [s[0] for got in out for s in got])
    for d in range(n_docs):
        threshold = -queue[d][0][0] if queue[d] and len(out[d]) == k else None
        out[d] = [(next(ids), p, g, 0.0 if threshold is None else log_inclusion(p, threshold)) for _, _, p, g in out[d]]
    return out


def _open(due: np.ndarray, place: np.ndarray, after: np.ndarray, shares: np.ndarray, queues: list[list], need: int) -> np.ndarray:
    """Those whose next siblings may still be among their text's ``need`` best."""
    at = place[due]
    bound = (after[at] - shares[at] + NOISE_BOUND).tolist()
    return due[[len(q) < need or b >= -heapq.nsmallest(need, q)[-1][0] for q, b in zip(queues, bound, strict=True)]] if len(due) else due


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + n - 1`` of each pair, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def log_inclusion(log_prob: float, threshold: float) -> float:
    """log(1 - exp(-exp(log_prob - threshold)))."""
    x = log_prob - threshold
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))


def _ids(lat: Lattice, runs: list[np.ndarray]):
    """Yield the piece ids of each run of edges."""
    counts = np.array([len(r) for r in runs], np.int64)
    ids = lat.piece[np.concatenate(runs)] if runs else np.zeros(0, np.int32)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    lone = np.flatnonzero(ids < 0)
    if len(lone):
        byte_ids = pieces(lat.path).byte_ids
        places = lat.start[np.concatenate(runs)[lone]]
        raw = [byte_ids[b] for c in lat.code[places].tolist() for b in chr(c).encode()]
        n = np.where(ids < 0, -ids, 1)
        cuts = np.concatenate([[0], np.cumsum(n)])[cuts]
        ids = np.repeat(ids, n)
        ids[ids < 0] = raw
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield ids[a:b]


_SPELLING: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def spelled(path: str, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The UTF-8 bytes that lists of ids stand for (``counts`` ids each, side by
    side in ``flat``); the first mark is dropped."""
    if path not in _SPELLING:
        v = pieces(path)
        names = [v.model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(v.model.get_piece_size())]
        for b, i in enumerate(v.byte_ids):
            names[i] = bytes([b])
        size = np.array([len(n) for n in names])
        _SPELLING[path] = size, np.cumsum(size) - size, np.frombuffer(b"".join(names), np.uint8)
    size, place, data = _SPELLING[path]
    n = size[flat]
    end = np.concatenate([[0], np.cumsum(n)])
    out = data[np.repeat(place[flat] - end[:-1], n) + np.arange(int(end[-1]))].tobytes()
    ends = end[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)].tolist()
    return [out[x + (y > x):y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def sample_segmentations(df: DataFrame, samples: int = SAMPLES, seed: int = 0, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each sample: ``doc_id, sample, ids, log_prob, perturbed,
    log_inclusion, round_trip``; ``round_trip``: the ids decode to the text (its
    marks as spaces), looked at in the task that drew them."""
    path = model or model_path()

    def rows(batches):
        for b in batches:
            values = [t or "" for t in b.column(1).to_pylist()]
            ids = b.column(0).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
            keys = mix(ids.view(np.uint64) + mix(np.array([seed], np.int64).view(np.uint64)))
            for lo, hi in parts_of(values, SLICE_CHARS):
                found = sample_slice(path, values[lo:hi], keys[lo:hi], samples)
                flat = [(lo + i, j, *s) for i, got in enumerate(found) for j, s in enumerate(got)]
                at, rank, pieces_, logp, value, inclusion = zip(*flat, strict=True)
                counts = np.array([len(p) for p in pieces_])
                joined = np.concatenate(pieces_)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                want = [t.replace(SPACE, " ").encode() for t in values[lo:hi]]
                same = [x == want[i - lo] for i, x in zip(at, spelled(path, joined, counts), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(rank, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined)), pa.array(logp), pa.array(value), pa.array(inclusion), pa.array(same)],
                                                 ["doc_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion", "round_trip"])

    return texts(df, id_col, text_col).mapInArrow(rows, "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean")


def decode(df: DataFrame, model: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids`` replaced by the ``text`` they stand for (NULL ids:
    NULL). Pieces' bytes are put side by side; the first mark is dropped."""
    path = model or model_path()

    def rows(batches):
        for b in batches:
            ids = b.column(b.num_columns - 1)
            got = []
            for lo in range(0, b.num_rows, 256):
                part = ids.slice(lo, 256)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                texts_ = spelled(path, flat, part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                got += [None if null else t.decode("utf-8", "replace") for t, null in zip(texts_, part.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.string())], [*b.schema.names[:-1], "text"])

    rest = [f for f in df.schema.fields if f.name != ids_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return df.select(*[f"`{f.name}`" for f in rest], f"`{ids_col}`").mapInArrow(rows, (schema + ", " if schema else "") + "text string")


def checked_digest(df: DataFrame, samples: int = SAMPLES, seed: int = 0) -> DataFrame:
    """``sample_segmentations`` with the ids as number and hash."""
    rows = sample_segmentations(df, samples, seed)
    return rows.select("doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "log_inclusion", "round_trip")
