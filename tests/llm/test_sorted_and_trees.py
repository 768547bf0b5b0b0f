"""Line bitmaps, prefix trie and hard negatives against plain versions."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from kestrel.llm import hard_negatives, line_dedup, prefix_trie

DOCS = "doc_id long, text string, keep string, n_dropped string"
TURNS = "conv_id long, turn long, role string, text string, path string, depth string"
VECS = "vec_id long, embedding array<float>, label int, rank string, leaf string"


# --- lines ------------------------------------------------------------------

def key(line: str) -> str:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return line.strip(" \t\n\v\f\r").translate(lower)


def plain_lines(rows, min_docs, min_chars=1, keep_first=False):
    docs = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    held, first = defaultdict(set), {}
    for d in docs:
        for line in d[2].split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(d)
                first.setdefault(key(line), d)
    out = []
    for r in rows:
        d, seen, kept = (r[0] is not None, r[0] or 0, r[1] or ""), set(), []
        lines = (r[1] or "").split("\n")
        for line in lines:
            k = key(line)
            common = len(k) >= min_chars and len(held[k]) >= min_docs
            if not common or (keep_first and first[k] == d and k not in seen):
                kept.append(line)
            seen.add(k)
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def line_rows():
    rng = np.random.default_rng(3)
    pool = ["Shared Footer ", "\tshared footer", "", "  ", "a", "é", "rare one", "twice", "ÄÖ", "日本　", "x" * 500, " nbsp"]
    rows = [(int(i), "\n".join(str(x) for x in rng.choice(pool, rng.integers(1, 12))), "k", "n") for i in range(60)]
    rows += [(None, "Shared Footer\nno id", "k", "n"), (None, "Shared Footer\nno id", "k", "n"), (None, "other\nshared footer", "k", "n")]
    rows += [(70, None, None, None), (71, "", "k", "n"), (72, "only\n" * 5000 + "end", "k", "n"), (73, "all\r\nshared footer\r", "k", "n")]
    rows += [(80, "hot row\nshared footer", "k", "n")] * 40  # repeats of one row are one document
    return rows


@pytest.mark.parametrize(("min_docs", "min_chars", "keep_first"), [(10, 1, False), (3, 2, False), (1, 1, False), (2, 1, True), (1, 1, True), (10, 1, True)])
def test_lines(spark, line_rows, min_docs, min_chars, keep_first):
    df = spark.createDataFrame(line_rows, DOCS).repartition(7)
    got = line_dedup.drop_common_lines(df, min_docs, min_chars, keep_first).collect()
    want = plain_lines(line_rows, min_docs, min_chars, keep_first)
    if keep_first:  # NULL ids come first, and are told apart by a hash of the text
        got = [r for r in got if r.doc_id is not None]
        want = [w for w in want if w[0] is not None]
        assert [r[:3] for r in want if r[1] == 5001] == [(r.doc_id, r.n_lines, r.n_dropped) for r in got if r.n_lines == 5001]
    if not keep_first or min_docs > 3:
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=repr) == want


def test_lines_hot_key_over_many_partitions(spark):
    """One key in every document: its rows lie in many ranges, and every border
    is settled; the first line stays once."""
    rows = [(i, f"own {i}\nCommon line\nown {i}", "k", "n") for i in range(600)] + [(1000 + i, f"pair {i % 300}", "k", "n") for i in range(600)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for keep_first in (False, True):
            got = line_dedup.drop_common_lines(df, 2, 1, keep_first).collect()
            common = sum("Common line" in r.text for r in got)
            pairs = sum(r.text.startswith("pair") for r in got)
            assert (common, pairs) == ((1, 300) if keep_first else (0, 0))
            assert all(r.text.count("own") == 2 for r in got if r.doc_id < 600)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_bitmaps(spark):
    df = spark.createDataFrame([(i, f"x\ncommon\n{i}\n\ncommon", "k", "n") for i in range(12)] + [(50, "clean", "k", "n")], DOCS)
    maps = line_dedup.keep_bitmaps(df).collect()
    assert {r.doc_id for r in maps} == set(range(12))
    assert all(line_dedup.kept_lines(f"x\ncommon\n{r.doc_id}\n\ncommon".encode(), bytes(r.keep)) == f"{r.doc_id}\n".encode() for r in maps)
    empty = spark.createDataFrame([], DOCS)
    assert line_dedup.drop_common_lines(empty).count() == 0 and line_dedup.keep_bitmaps(empty).count() == 0
    with pytest.raises(ValueError, match="min_docs"):
        line_dedup.keep_bitmaps(df, 0)


# --- trie -------------------------------------------------------------------

def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + mine[h:]
    nodes = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[tuple(built[c][:d])].append(c)
    words = lambda p: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", p[-1][1])]) if p else 0
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        leaves = sum(not any(len(x) == len(q) + 1 and x[:len(q)] == q for x in below) for q in below)
        ends = ",".join(str(c) for c in members if len(built[c]) == len(p))
        out.append((members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), leaves,
                    sum((len(nodes[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(seed: int, n: int = 90):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(n), -5, -20, -7, 407, 1003]:
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t, str(rng.choice(["user", "assistant"])), str(rng.choice(["a", "a b", "hello  there you", ""], p=[0.5, 0.3, 0.15, 0.05])), "p", "d"))
    rows += [(500, None, None, None, "p", "d"), (500, 3, "user", "a", "p", "d"), (500, 3, "user", "b", "p", "d"), (500, 3, "user", "b", "p", "d"), (None, 1, "user", "x", "p", "d")]
    rows += [(600 + i, 0, "user", "same first turn", "p", "d") for i in range(60)]  # one conversation many times
    rows += [(700, t, "user", f"turn {t}", "p", "d") for t in range(300)] + [(701, t, "user", f"turn {t}", "p", "d") for t in range(250)]
    return rows


@pytest.mark.parametrize("shards", [1, 2, 9, 40])
def test_trie(spark, shards):
    rows = trie_rows(shards, 60)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    got = [tuple(r) for r in prefix_trie.trie_nodes(df, shards).collect()]
    assert sorted(got, key=repr) == plain_trie(rows)


def test_trie_splitters_and_chunks(spark, monkeypatch):
    a, b, c = (bytes([x]) * 16 for x in (1, 2, 3))
    w = np.array([5, 6, 7], "<i4").tobytes()
    assert prefix_trie.shared_turns(a + b + c, a + b + b) == 2 and prefix_trie.shared_turns(b"", a) == 0
    sample = [(a + b + c, 1, w), (a + c + c, 2, w), (a + c + c, 3, w), (b + b + b, 4, w)]
    cuts = prefix_trie.choose_splitters(sample, 4)
    assert [(p, i) for p, i, _ in cuts] == [(a + c, prefix_trie._FIRST_ID), (a + c + c, 3), (b, prefix_trie._FIRST_ID)]
    assert prefix_trie.choose_splitters(sample, 4, max_bytes=40) == [cuts[1]] or len(prefix_trie.choose_splitters(sample, 4, max_bytes=40)) < 3
    sk = prefix_trie.Skeleton(cuts)
    assert sk.parent.tolist() == [-1, 0, 1, 2, 0] and sk.children.tolist() == [2, 1, 1, 0, 0] and sk.tokens.tolist() == [23, 18, 13, 7, 5]
    assert prefix_trie.trie_nodes(spark.createDataFrame([], TURNS)).count() == 0
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 12)
    rows = [(i * 20, 0, "user", "same", "p", "d") for i in range(200)]
    got = [tuple(r) for r in prefix_trie.trie_nodes(spark.createDataFrame(rows, TURNS), 6).collect()]
    assert sorted(got, key=repr) == plain_trie(rows)


# --- hard negatives ---------------------------------------------------------

def plain_mine(rows):
    kept = {}
    for i, vec, label, *_ in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        kept[i, label, tuple(math.floor(256 * float(np.float32(x))) for x in vec)] = None
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, label, vec in kept:
        if i is None or i % 100:
            continue
        scores = [(dot(vec, v), j, other == label) for j, other, v in kept]
        near = sorted((x for x in scores if x[2] and x[1] != i), key=order)[:5]
        for ps, p, _ in near:
            hard = sorted((x for x in scores if not x[2] and 80 * ps <= 100 * x[0] <= 100 * ps), key=order)[:5]
            out.extend((i, p, rank, n, ps, ns) for rank, (ns, n, _) in enumerate(hard, 1))
    return sorted(out, key=repr)


def vector_rows(n: int, dim: int = 6, centres: int = 5):
    rng = np.random.default_rng(n)
    mid = rng.normal(size=(centres, dim))
    rows = [(i, [float(x) for x in (mid[rng.integers(centres)] + 0.3 * rng.normal(size=dim)).astype(np.float32)], int(rng.integers(0, 4)), "r", "l") for i in range(n)]
    same = rows[3][1]
    rows += [(10_000 + 50 * i, same, 2, "r", "l") for i in range(60)]  # copies, anchors among them
    rows += [(20_000 + i, same, 1, "r", "l") for i in range(30)]
    rows += [(None, same, 1, "r", "l"), (300, None, 1, "r", "l"), (400, [1.0] * dim, None, "r", "l"), (500, [1.0, None] + [0.0] * (dim - 2), 1, "r", "l"),
             (600, [float("nan")] + [0.0] * (dim - 1), 1, "r", "l"), (601, [float("inf")] + [0.0] * (dim - 1), 1, "r", "l"), (900, [], 3, "r", "l"), (901, [0.5] * (dim - 2), 3, "r", "l")]
    return rows + rows[:20]


@pytest.mark.parametrize(("sample", "leaf", "block"), [(16_384, 48, 1024), (100, 8, 20), (40, 2, 7)])
def test_hard_negatives(spark, sample, leaf, block):
    rows = vector_rows(400)
    df = spark.createDataFrame(rows, VECS).repartition(5)
    got = hard_negatives.mine(df, sample_rows=sample, leaf_rows=leaf, block_rows=block).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_mine(rows)


def test_tree_eliminates_and_keeps_all_in_window():
    rng = np.random.default_rng(8)
    rows = np.floor(256 * np.concatenate([c + 0.05 * rng.normal(size=(200, 3)) for c in rng.normal(size=(12, 3))]))
    tree = hard_negatives.Tree(rows[::3], ways=4, leaf_rows=8)
    ranges, leaf = {}, None
    for node, at, d, side in tree.walk(rows):
        if node is None:
            leaf = at
            continue
        norms = (rows**2).sum(axis=1)
        for j in np.unique(side):
            mine = side == j
            for i in range(d.shape[1]):
                ranges[node, i, int(j)] = (d[mine, i].min(), d[mine, i].max(), norms[at[mine]].min(), norms[at[mine]].max())
    tree.with_ranges([(*k, *v) for k, v in ranges.items()])
    anchors = rows[::40]
    scores = hard_negatives.products(anchors, rows)
    low = np.quantile(scores, 0.97, axis=1)
    high = np.quantile(scores, 0.99, axis=1)
    reached = tree.reached(anchors, low, high)
    visits = 0
    for q in range(len(anchors)):
        inside = set(leaf[(scores[q] >= low[q]) & (scores[q] <= high[q])].tolist())
        seen = {x for x, at in reached.items() if q in at}
        assert inside <= seen
        visits += len(seen)
    assert visits < 0.6 * tree.leaves * len(anchors)


def test_hard_negatives_edges(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECS)).count() == 0
    big = [(i * 100, [1e300 if i % 2 else 3e4, -1e300], i % 3, "r", "l") for i in range(9)]  # held at LARGEST
    assert hard_negatives.mine(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int, rank string, leaf string")).count() > 0
    a = np.array([[1 << 27, 1 << 27]], float)
    assert hard_negatives.products(a, a).tolist() == [[1 << 55]]
