"""Dealt operators against versions that try everything."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kestrel.llm import decontaminate, fertility, kernels as K, minmax_dedup, piece_sampling, toxicity
from kestrel.llm.pieces import model_path


# --- op1: greedy string tiling ------------------------------------------------

def plain_tiles(doc, item, least):
    """Mark the longest match of unmarked words, again and again."""
    used_d, used_t, tiles = set(), set(), []
    while True:
        best = None
        for a, b in itertools.product(range(len(doc)), range(len(item))):
            n = 0
            while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in used_d and b + n not in used_t:
                n += 1
            if n >= least and (best is None or (-n, a, b) < best):
                best = (-n, a, b)
        if best is None:
            return tiles
        n, a, b = -best[0], best[1], best[2]
        tiles.append((a, b, n))
        used_d.update(range(a, a + n))
        used_t.update(range(b, b + n))


@pytest.mark.parametrize("seed", range(12))
def test_tiles_equal_plain_greedy(seed):
    rng = np.random.default_rng(seed)
    words = "abc"[: 2 + seed % 2]
    doc, item = ("".join(rng.choice(list(words), n)) for n in (40, 25))
    least = 3
    at = [(a, b) for a in range(len(doc) - least + 1) for b in range(len(item) - least + 1) if doc[a:a + least] == item[b:b + least]]
    got = decontaminate.tile(np.array([x[0] for x in at]), np.array([x[1] for x in at]), least)
    assert got == plain_tiles(doc, item, least)


# --- op9: the decoder reads the best of all readings ---------------------------

def decoder():
    rng = np.random.default_rng(5)
    return toxicity.Decoder(rng.integers(0, 50, (27, 27, 27)).astype(float))


def path_score(d, letters, cost):
    a, b, total = toxicity.EDGE, toxicity.EDGE, cost
    for c in letters:
        x = ord(c) - 97
        total += d.log[a][b][x]
        a, b = b, x
    return total + d.log[a][b][toxicity.EDGE]


@pytest.mark.parametrize("token", ["id1ot", "f00l", "h@t3", "baaad", "s7up1d", "x#y&z", "4$$", "ooo0", "a!|b"])
def test_reading_is_the_best_of_all(token):
    d = decoder()
    best: dict[str, float] = {}
    for choice in itertools.product(*d.options(token)):
        letters = "".join(c for c, _ in choice)
        value = path_score(d, letters, sum(c for _, c in choice))
        best[letters] = max(best.get(letters, -np.inf), value)
    assert abs(best[d.read(token)] - max(best.values())) < 1e-9


def test_slices_skip_no_run_of_single_letters():
    rng = np.random.default_rng(6)
    chars = np.array(list("abZ1@$! \n\t.-_*éx日"))
    texts = ["".join(rng.choice(chars, rng.integers(0, 40))) for _ in range(4000)] + ["a b c d", "a.b-c_d", "KKa k K k", "", "ab c d e f"]
    marked = 0
    for col in (pa.array(texts), pa.array(texts[7:3000])):
        for lo, hi, data, off in K.text_slices(col, 3000):
            flags = toxicity.may_be_spaced(data, off)
            for i in range(hi - lo):
                found = toxicity._SPACED.search(col[lo + i].as_py().lower())
                assert flags[i] or not found
                marked += bool(found)
    assert marked > 50


def test_token_scores_equal_text_by_text():
    counts = np.ones((27, 27, 27))
    texts = ["You 1d1ot you", "fine words", "", "id10t!  idiot  x", "zzz " * 50, "f00l　fool a b c d"]
    strengths = {"idiot": 0.9, "fool": 0.6, "you": 0.1, "zzz": 0.2, "z": 0.3}
    restore, best = toxicity.Restorer(counts), {}
    for lo, _, data, off in K.text_slices(pa.array(texts), 30):
        top, _ = toxicity._slice_scores(K.lower(data), off, restore, strengths, best)
        for i, got in enumerate(top):
            words = {w for t in set(toxicity._TOKEN.findall(texts[lo + i].lower())) for w in restore.readings(t)}
            assert got == max([0.0, *(strengths.get(f, 0.0) for w in words for f in toxicity.features(w))])


# --- op8: all segmentations of short texts --------------------------------------

def segmentations(text):
    """Every path of the text's lattice with its probability."""
    path = model_path()
    units = piece_sampling._UNIT.findall(piece_sampling.marked(text))
    assert len(units) == 1
    lat = piece_sampling.Lattice(path, units)
    end = int(lat.ends[0])
    found, todo = [], [(0, (), 1.0)]
    while todo:
        node, edges, p = todo.pop()
        if node == end:
            found.append((edges, p))
            continue
        for e in range(int(lat.first[node]), int(lat.first[node + 1])):
            todo.append((node + int(lat.length[e]), (*edges, e), p * float(lat.share[e])))
    ids = list(piece_sampling._ids(lat, [np.array(e) for e, _ in found]))
    return {tuple(int(x) for x in i): p for i, (_, p) in zip(ids, found, strict=True)}


@pytest.mark.parametrize("text", ["the", "cat", "ab"])
def test_samples_are_of_the_lattice_without_repeats(text):
    every = segmentations(text)
    assert abs(sum(every.values()) - 1) < 1e-6
    k, n = min(len(every), 4), 3000
    keys = K.mix(np.arange(n, dtype=np.uint64))
    got = piece_sampling.sample_slice(model_path(), [text] * n, keys, k)
    first, either = Counter(), Counter()
    for draws in got:
        ids = [tuple(int(x) for x in d[0]) for d in draws]
        assert len(set(ids)) == len(ids) == k  # distinct
        assert all(a[2] >= b[2] for a, b in itertools.pairwise(draws))
        for i, (_, log_prob, *_rest) in zip(ids, draws, strict=True):
            assert abs(log_prob - np.log(every[i])) < 1e-6
        first[ids[0]] += 1
        either.update(ids[:2])
    for i, p in every.items():
        assert abs(first[i] / n - p) < 4 * np.sqrt(p * (1 - p) / n) + 1e-3
        if k >= 2:  # of two draws without replacement
            both = p + sum(q * p / (1 - q) for j, q in every.items() if j != i and q < 1)
            assert abs(either[i] / n - both) < 4 * np.sqrt(max(both * (1 - both), 0) / n) + 2e-3


def test_all_segmentations_come_out(text="at"):
    every = segmentations(text)
    got = piece_sampling.sample_slice(model_path(), [text], K.mix(np.arange(1, dtype=np.uint64)), len(every) + 3)[0]
    assert {tuple(int(x) for x in d[0]) for d in got} == set(every)


# --- extra columns of any name ---------------------------------------------------

def test_stages_take_columns_of_any_name(spark):
    rows = [(i, f"some plain words of document number {i} " * 12, i, "h", i, "x", i) for i in range(12)] + [(12, None, 0, "h", 0, "x", 0)]
    names = "doc_id long, text string, _id long, _hash string, bad_id long, gone_hash string, leaked_row long"
    df = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of that kind here at all")], "item_id long, text string")
    for out in (toxicity.keep_clean(df, labels), fertility.keep_good(df), minmax_dedup.one_of_each(df), decontaminate.clean_documents(df, bench)):
        assert out.columns == df.columns
        assert out.count() <= df.count()
