"""The training-data operators against plain versions on small tables."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kestrel.llm import backoff, decontaminate, fertility, jump_shards, licences, minmax_dedup, piece_sampling, prefix_tokens, snapshots, toxicity
from kestrel.llm.components import components
from kestrel.llm.kernels import mix
from kestrel.llm.pieces import model_path, pieces

DOCS = "doc_id long, text string, lang string, component_id string, n long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    base = sentence(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (0, base, "en", "x", 1), (1, base, "en", "x", 1), (2, " ".join(near), "en", "x", 1), (3, sentence(2, 90), "en", "x", 1),
        (4, None, None, None, None), (5, "", "en", "", 0), (6, "Two words", "de", "x", 1), (7, "two  WORDS", "de", "x", 1),
        (8, " \n\t ", "fr", "x", 1), (9, "no " * 30_000, "en", "x", 1), (None, sentence(3, 70), "xx-unknown", "x", 1),
        (11, "Ähnlich über 日本 😀\n" * 9, "de", "x", 1), (11, "Ähnlich über 日本 😀\n" * 9, "de", "x", 1),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = split(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates_match_all_pairs(docs, rows, empty):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            group = [group[i] if g == group[j] else g for g in group]
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        c = min(ids, default=None) if sets[i] else r[0]
        want[r[0], len(sets[i]), c, r[0] == c] += 1
    assert Counter(map(tuple, minmax_dedup.near_duplicates(docs).collect())) == want
    assert minmax_dedup.near_duplicates(empty).count() == 0
    kept = minmax_dedup.one_of_each(docs).select("doc_id").collect()
    assert sorted(r[0] if r[0] is not None else -1 for r in kept) == [-1, 0, 3, 4, 5, 6, 8, 9, 11]


def test_one_row_of_each_component_by_id_and_text(spark):
    """NULL and repeated ids: only near copies go, and one row of each stays."""
    near = lambda text, at: " ".join("changed" if i == at else w for i, w in enumerate(text.split()))
    a, b, c, d = (sentence(40 + i, 120) for i in range(4))
    clean = [(None, sentence(50, 80)), (None, sentence(51, 80)), (7, sentence(52, 80))]
    rows = [(1, a), (None, near(a, 60)), *clean, (7, near(a, 30)), (3, b), (3, c), (2, near(c, 50)), (None, d), (None, near(d, 70)), (None, None), (None, "")]
    kept = [(r.doc_id, r.text) for r in minmax_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    lone = [r for r in kept if r in ((None, d), (None, near(d, 70)))]
    assert len(lone) == 1
    assert Counter(kept) == Counter([(1, a), *clean, (3, b), (2, near(c, 50)), (None, None), (None, ""), *lone])


def test_members_outside_the_largest_component_meet_all(spark):
    """A chain of edits: ends far from each other are linked by the middle."""
    base = sentence(5, 200).split()
    texts = []
    for step in range(12):
        w = list(base)
        for i in range(step):
            w[10 + 12 * i] = f"edit{i}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minmax_dedup.near_duplicates(df).collect()}
    sets = [shingles(t) for t in texts]
    far = len(sets[0] & sets[11]) / len(sets[0] | sets[11])
    assert far < 0.75 and set(got.values()) == {0}


def test_pairs_meet_once_in_the_prefix_join(spark):
    pick = random.Random(11)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for node in range(12):  # near copies that differ in a few words
        words = list(base)
        for at in pick.sample(range(400), 1 + node % 5 * 4):
            words[at] = f"x{node}_{at}"
        rows.append((node, node, " ".join(words)))
    nodes = spark.createDataFrame(rows, "node long, root long, text string")
    counts = spark.sparkContext.broadcast(minmax_dedup.shingle_counts(nodes))
    met = [tuple(sorted(r)) for r in minmax_dedup._prefix_meetings(minmax_dedup.prefix_rows(nodes, counts)).collect()]
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for _, _, t in rows]
    similar = {(a, b) for a in range(12) for b in range(a + 1, 12) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(similar) >= 10 and similar <= set(met) and len(met) <= 3 * len(set(met))


def test_prefix_join_loses_no_link(spark):
    """Families that share most words, edits at every distance: the candidates
    hold all similar pairs, and the members of a family that are just not
    similar are no candidates."""
    rng = np.random.default_rng(4)
    rows = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(60)]
        for i in range(25):
            w = list(base)
            for at in rng.choice(60, int(rng.integers(0, 6)), replace=False):
                w[at] = f"e{rng.integers(0, 9)}"
            rows.append(" ".join(w[int(rng.integers(0, 3)):]))
    boiler = [f"b{i}" for i in range(160)]
    rows += [" ".join(boiler + [f"own{k}x{i}" for i in range(40)]) for k in range(60)]
    nodes = spark.createDataFrame([(i, i, t) for i, t in enumerate(rows)], "node long, root long, text string")
    sets = [shingles(t) for t in rows]
    similar = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    for bits in (18, 3, 0):
        counts = spark.sparkContext.broadcast(minmax_dedup.shingle_counts(nodes, bits))
        pairs = {(r.node, r.centre) for r in minmax_dedup._prefix_pairs(minmax_dedup.prefix_rows(nodes, counts)).collect()}
        assert similar <= pairs
        if bits == 18:
            assert not any(i >= 100 and j >= 100 for i, j in pairs)


def test_bits_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(12)
    base = mix(np.arange(500, dtype=np.uint64))
    sets = [np.unique(rng.choice(base, int(rng.integers(1, 300)), replace=False)) for _ in range(40)]
    sets += [np.unique(np.concatenate([x[int(rng.integers(0, 12)):], mix(rng.integers(0, 1 << 60, int(rng.integers(0, 12))).astype(np.uint64))])) for x in sets if len(x) > 12]
    words = minmax_dedup.parity_bits(sets)
    pairs = [(i, j, len(sets[i]), words[i].tolist(), len(sets[j]), words[j].tolist()) for i, j in itertools.combinations(range(len(sets)), 2)]
    df = spark.createDataFrame(pairs, "i int, j int, n long, b array<long>, cn long, cb array<long>")
    kept = {(r.i, r.j) for r in df.where(minmax_dedup._may_be_similar("n", "b", "cn", "cb")).collect()}
    similar = {(i, j) for i, j, *_ in pairs if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert similar and similar <= kept and len(kept) < 3 * len(similar)


def test_min_max_values_estimate_similarity():
    a, b = mix(np.arange(0, 900, dtype=np.uint64)), mix(np.arange(300, 1200, dtype=np.uint64))
    s = minmax_dedup.min_max_signatures([a, b])
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.12


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (20, 8)] + [(100, i) for i in range(101, 140)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 20: 8} | {i: 100 for i in range(100, 140)}


def test_tiles_cover_reordered_passages(spark, empty):
    item = [f"w{i}" for i in range(24)]
    text = " ".join(["x", *item[12:], "y", "z", *item[:12], "x"])
    near = " ".join(item[:6] + ["q"] + item[7:9])
    docs = spark.createDataFrame([(1, text, "a"), (2, near, "a"), (3, None, "a"), (4, "", "a"), (5, text, "a"), (6, "Short ITEM x", "a")], "doc_id long, text string, item string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "short item"), (9, None), (10, ""), (11, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.tiled_words, r.n_tiles) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(d, i): (24, 2) for d in (1, 5) for i in (7, 11)} | {(6, 8): (2, 1)}
    assert [r.doc_id for r in decontaminate.clean_documents(docs, bench).orderBy("doc_id").collect()] == [2, 3, 4]
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0


def test_longest_tile_is_marked_first():
    doc, item = "a b c d e f g a b c d e".split(), "a b c d e a b c d e f g".split()
    seeds = [(i, j) for i in range(len(doc) - 2) for j in range(len(item) - 2) if doc[i:i + 3] == item[j:j + 3]]
    tiles = decontaminate.tile(np.array([s[0] for s in seeds]), np.array([s[1] for s in seeds]), 3)
    assert tiles == [(0, 5, 7), (7, 0, 5)]


def test_fertility_base_counts(docs, rows, empty):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in fertility.judged(docs).collect())
    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
        lines = t.split("\n")
        dup = sum(1 for i, line in enumerate(lines) if split(line) and line in set(lines[:i]))
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
    assert got == want
    assert fertility.judged(empty).count() == 0


def test_fertility_rejects_odd_tokens(spark):
    good = [(i, sentence(100 + i, 80 + i), "en") for i in range(60)]
    odd = [(900, " ".join(f"{chr(0x1F300 + i)}{chr(0x12000 + i)}" for i in range(90)), "en")]
    df = spark.createDataFrame(good + odd, "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in fertility.judged(df).collect()}
    assert not rows[900].kept and rows[900].byte_share > 0.5
    assert sum(rows[i].kept for i in range(60)) >= 59
    words = good[0][1].split()
    model = pieces(model_path()).model
    assert rows[0].piece_chars == pytest.approx(sum(map(len, words)) / sum(len(model.encode(w)) for w in words))


def test_snapshots(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", None), (4, 0, "user", "hi"),
             (4, 1, "bot", "yo"), (4, 2, "user", ""), (5, 0, "user", "ho"), (6, 0, "user", "ho"), (6, 0, "user", "ho"), (None, 0, None, "x"), (3, 2, "user", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as copies", "2 as block")
    got = Counter((r.conv_id, r.pos, r.n_turns, r.copies) for r in snapshots.collapse_and_render(df).collect())
    assert got == Counter({(3, 1, 3, 1): 1, (3, 2, 3, 1): 1, (3, 3, 3, 1): 1, (4, 1, 3, 1): 1, (4, 2, 3, 1): 1, (4, 3, 3, 1): 1, (5, 1, 1, 2): 1, (None, 1, 1, 1): 1})
    long_ = spark.range(3000).selectExpr("id % 2 as conv_id", "floor(id / 2) as turn", "'u' as role", "cast(floor(id / 2) as string) as text").where("conv_id = 0 or turn < 1400")
    assert {r.conv_id for r in snapshots.collapse_and_render(long_).select("conv_id").distinct().collect()} == {0}
    assert snapshots.collapse_and_render(df.where("false")).count() == 0


def test_prefix_counts_are_the_librarys(docs, rows, empty):
    model = pieces(model_path()).model
    got = prefix_tokens.prefix_table(docs).collect()
    for r, want in zip(got, rows, strict=True):
        text = want[1] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(model.encode(text)))
    texts = ["a  b   c\n\nd▁e ", "<s>日本</s> ﬁ x" + " " * 20, "Hello\tworld!!"] + [r[1][:120] for r in rows if r[1]]
    for text, table in zip(texts, prefix_tokens.unit_counts(model_path()).tables(texts), strict=True):
        assert np.cumsum(np.frombuffer(table, np.int8)).tolist() == [len(model.encode(text[:i + 1])) for i in range(len(text))]
    long_ = prefix_tokens.prefix_table(docs.where("doc_id = 9")).select(prefix_tokens.longest_prefix("changes", 100).alias("n"), "changes").first()
    assert len(model.encode(rows[9][1][:long_.n])) <= 100 < len(model.encode(rows[9][1][:long_.n + 1]))
    assert prefix_tokens.prefix_table(empty).count() == 0


def plain_jump(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_shards(docs, rows, empty):
    got = jump_shards.assign_shards(docs, 8, rows_per_cell=1).collect()
    assert Counter((r.key, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for r in got:
        key = jump_shards.NULL_KEY if r.key is None else r.key
        assert (r.shard, r.grown_shard) == (plain_jump(key, 8), plain_jump(key, 9)) and r.grown_shard in (r.shard, 8)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert jump_shards.assign_shards(empty, 8).count() == 0
    keys = np.arange(-500, 5000)
    assert jump_shards.jump(keys, 1000).tolist() == [plain_jump(int(k), 1000) for k in keys]


def test_licence_scan(spark):
    apache = licences.TEMPLATES[5][1]
    texts = ["Released under the MIT License.", "x " + apache.upper() + " y", "mit\nlicense and MIT-License, general public license", None, "", "the mit of license", "über MIT LICENSE" + " z" * 500,
             " ".join(apache.split()[:12]), licences.TEMPLATES[10][1]]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as score")).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        w = licences.split_words(text or "")
        at = [(i, label) for p, label in licences.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((a[0] for a in at), default=None), max((a[0] for a in at), default=None))
        assert r.base_labels == ",".join(sorted({a[1] for a in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[8].labels == "bsd" and got[8].score == 1.0 and got[3].labels == ""


def test_matching_statistics():
    seqs = [[0, 1, 2, 0, 1], [1, 2, 3], [2, 0, 1, 2]]
    runs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    a = licences.Automaton(seqs)
    words = np.random.default_rng(0).integers(0, 4, 300).tolist()
    for i, (state, n) in enumerate(a.statistics(words)):
        assert n == max((k for k in range(1, i + 2) if tuple(words[i + 1 - k:i + 1]) in runs), default=0)
        if n:
            assert {(k, e) for k, s in enumerate(seqs) for e in range(n, len(s) + 1) if s[e - n:e] == words[i + 1 - n:i + 1]} == a.places[state]


def test_gumbel_samples(spark, docs, rows, empty):
    path = model_path()
    n = 4000
    drawn = piece_sampling.sample_slice(path, ["abca"] * n, mix(np.arange(n, dtype=np.uint64)), 3)
    for got in drawn[:200]:
        assert len({tuple(s[0]) for s in got}) == 3 and got[0][2] >= got[1][2] >= got[2][2]
    probs = {tuple(s[0]): math.exp(s[1]) for got in drawn for s in got}
    first = Counter(tuple(got[0][0]) for got in drawn)
    for s, c in first.items():
        assert abs(c / n - probs[s]) < 0.01 + 4 * math.sqrt(probs[s] / n)
    assert np.mean([sum(math.exp(s[1] - s[3]) for s in got) for got in drawn]) == pytest.approx(1, abs=0.02)
    digest = piece_sampling.checked_digest(docs).collect()
    assert all(r.round_trip for r in digest)
    assert Counter(r.doc_id for r in digest)[4] == 1 and Counter(r.doc_id for r in digest)[0] == 2
    again = {(r.doc_id, r.sample, r.ids_hash) for r in piece_sampling.checked_digest(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.sample, r.ids_hash) for r in digest}
    assert piece_sampling.checked_digest(empty).count() == 0
    long_unit = "ab" * 400
    assert piece_sampling.decode(piece_sampling.sample_segmentations(spark.createDataFrame([(1, long_unit)], "doc_id long, text string"))).first().text == long_unit


def test_toxicity_reads_disguises(spark, empty):
    clean = [(i, sentence(i, 30)) for i in range(300)]
    bad = [(1000 + i, sentence(1000 + i, 20) + " moronic " + sentence(2000 + i, 10)) for i in range(60)]
    hidden = [(5000, sentence(7, 12) + " m0r0n1c " + sentence(8, 9)), (5001, sentence(7, 12) + " moroooonic " + sentence(9, 9)), (5002, sentence(7, 12) + " m.o.r.o.n.i.c " + sentence(9, 9)),
              (5003, sentence(11, 25)), (5004, None), (5005, ""), (None, "moronic")]
    docs = spark.createDataFrame(clean + bad + hidden, "doc_id long, text string").selectExpr("*", "1 as toxic", "2 as score")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in bad] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert [got[i].predicted for i in (5000, 5001, 5002, 5003, 5004, 5005, None)] == [1, 1, 1, 0, 0, 0, 1]
    held = [r for i, r in got.items() if i is not None and toxicity.is_held_out(i) and i < 5000]
    assert all(r.held_out for r in held) and all(r.predicted == (r.doc_id >= 1000) for r in held)
    assert toxicity.score(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.score(docs, labels.where("false")).collect()} == {0}
    assert toxicity.keep_clean(docs, labels).where("doc_id >= 1000 and doc_id < 5000").count() == 0


def test_toxicity_reads_long_runs_and_symbols_at_ends(spark):
    """Words behind others in a spaced run, runs and tokens of any length."""
    clean = [(i, sentence(i, 30)) for i in range(300)] + [(400 + i, "fine words") for i in range(60)]
    bad = [(1000 + i, sentence(1000 + i, 20) + " moronic " + sentence(2000 + i, 10)) for i in range(60)] + [(1100 + i, f"asshat{'abcdefghij'[i % 10]} {WORDS[i % 24]}") for i in range(60)]
    far = " ".join(sentence(31, 120).replace(" ", ""))
    hidden = ["a l p h a m o r o n i c", "a l p h a   b e t a   m o r o n i c", far + "   m o r o n i c", "m" + "o" * 80 + "ronic", "moroni(", "(moronic", "a l p h a b e t a g a m m a", far, "alpha! (beta"]
    docs = spark.createDataFrame(clean + bad + [(5000 + i, t) for i, t in enumerate(hidden)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in bad], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(far) > 512
    assert [got[5000 + i].predicted for i in range(len(hidden))] == [1, 1, 1, 1, 1, 1, 0, 0, 0]
    assert all(got[i].predicted for i, _ in bad)  # texts of two words are not one copy


def test_decoder_sets_words_apart():
    counts = np.zeros((27, 27, 27))
    for w in ["you", "idiot"] * 50:
        c = [26, 26, *(ord(x) - 97 for x in w), 26]
        for t in zip(c, c[1:], c[2:]):
            counts[t] += 1
    restore = toxicity.Restorer(counts)
    assert restore.decoder.read("youidiot", edges=True) == "you idiot"
    assert {"you", "idiot"} <= restore.words("y o u   i d i o t") and {"you", "idiot"} <= restore.words("y o u i d i o t")
    assert "idiot" in restore.words("y0u 1d10t!") and "idiot" in restore.words("!diot")
    assert restore.decoder.read("a" * 100_000) == "a"


def test_backoff_matches_plain_counts(spark, docs, rows, empty):
    for order in (1, 2, 3):
        got = Counter((r.doc_id, r.n_words, r.n_backoff, None if r.log_score is None else round(r.log_score, 6)) for r in backoff.score(docs, order, block_bytes=500, part_bytes=300).collect())
        assert got == plain_backoff(rows, order)
    assert backoff.score(empty).count() == 0


def plain_backoff(rows, order):
    grams = {(r[0], r[1]): [Counter(tuple(w[i:i + k]) for w in [split(r[1])] for i in range(len(w) - k + 1)) for k in range(1, order + 1)] for r in rows}
    total = [sum((g[k] for g in grams.values()), Counter()) for k in range(order)]
    want = Counter()
    for r in rows:
        w, own = split(r[1]), grams[r[0], r[1]]
        others = max(1, sum(total[0].values()) - len(w))
        s, back = 0.0, 0
        for i in range(len(w)):
            for k in range(order, 0, -1):
                g = tuple(w[i + 1 - k:i + 1]) if i + 1 >= k else None
                c = total[k - 1][g] - own[k - 1][g] if g else 0
                if c > 0 or k == 1:
                    context = others if k == 1 else total[k - 2][g[:-1]] - own[k - 2][g[:-1]]
                    s += math.log(c or backoff.UNSEEN) - math.log(context) + (order - k) * math.log(backoff.ALPHA)
                    back += k < order or c <= 0
                    break
        want[r[0], len(w), back, round(s, 6) if w else None] += 1
    return want
