"""Plain words that begin like no feature are passed over, with the same scores."""

import random

import numpy as np
import pyarrow as pa

from kestrel.llm import kernels as K
from kestrel.llm import toxicity as T

COUNTS = np.random.default_rng(3).integers(1, 9, (27, 27, 27)).astype(float)


def _texts():
    pick = random.Random(4)
    made = ["".join(pick.choice("aabbk .,!?@0é\n") for _ in range(pick.randrange(30))) for _ in range(400)]
    return [*made, "", "a", "aaa", "baaa", "aab\n", "aa aa. a.a b,, c?", "abcé", "KaKa", "\x00ab ab\x1fcd", None]


def _scores(texts, strengths, restore):
    got = [T._slice_scores(K.lower(data), off, restore, strengths, {}) for _, _, data, off in K.text_slices(pa.array(texts, pa.string()))]
    return [np.concatenate(x).tolist() for x in zip(*got, strict=True)]


def test_scores_are_those_of_all_tokens():
    strengths = {f: 0.1 + i % 9 / 10 for i, w in enumerate(["ab", "aab", "baka", "abbab", "kab", "é"]) for f in T.features(w)}
    restore = T.Restorer(COUNTS)
    top, changed = [], []
    for text in _texts():
        tokens = {t for word in set(K_words(text or "")) for t in T._TOKEN.findall(word.lower())}
        top.append(max([0.0, *(strengths.get(f, 0.0) for t in tokens for w in restore.readings(t) for f in T.features(w))]))
        changed.append(sum(restore.readings(t) != (T._TRIM.sub("", t),) for word in set(K_words(text or "")) for t in T._TOKEN.findall(word.lower())))
    assert _scores(_texts(), strengths, T.Restorer(COUNTS)) == [top, changed]


def K_words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return [w for w in low.translate({ord(c): " " for c in "\t\n\v\f\r"}).split(" ") if w]


def test_plain_words_are_not_read():
    read = []

    class Watched(T.Restorer):
        def readings(self, token):
            read.append(token)
            return super().readings(token)

    words = " ".join(f"{a}{b}word, {a}x{b}." for a in "abcdef" for b in "ghijkl")
    assert _scores([words + " ba@d toxin"], {"toxin": 0.8}, Watched(COUNTS)) == [[0.8], [1]]
    assert sorted(read) == ["ba@d", "toxin"]


def test_words_that_only_begin_like_a_feature_are_not_read():
    read = []

    class Watched(T.Restorer):
        def readings(self, token):
            read.append(token)
            return super().readings(token)

    strengths = {"toxin": 0.8, "çauxé-": 0.7, "一丁": 0.6}
    assert _scores(["toxicology toxins, toxi çauxa 一丂 éa", "çauxéta. 一丁 ab", "Éa toxin"], strengths, Watched(COUNTS)) == [[0.0, 0.7, 0.8], [0, 0, 0]]
    assert sorted(read) == ["toxin", "çauxéta.", "éa", "一丁"]
    assert _scores(["ab çb"], {}, Watched(COUNTS)) == [[0.0], [0]]


def test_bytes_of_letters():
    text = "aZ1éÉ×жЖ一€\U00010428"
    raw = np.frombuffer(text.encode() + b"\xc3" + b"\xe4\xb8", np.uint8)
    want = b"".join((b"\1" if c in "aéж一" else b"\0") * len(c.encode()) for c in text) + b"\0\0\0"
    assert T.letter_bytes(raw).astype(np.uint8).tobytes() == want


def test_kept_ends_are_read_as_in_whole_tokens():
    pick, decoder, searched = random.Random(6), T.Decoder(COUNTS), []
    tokens = ["".join(pick.choice("abckeé01!@$*x") for _ in range(pick.randrange(1, 9))) for _ in range(400)]
    assert [decoder.read(t) for t in tokens] == [decoder._search(T.EDGE, T.EDGE, "", t) for t in tokens]
    search = decoder._search
    decoder._search = lambda *x: searched.append(x) or search(*x)
    assert {decoder.read(f"{a}{b}word!!")[:6] for a in "abc" for b in "ghi"} == {f"{a}{b}word" for a in "abc" for b in "ghi"}
    assert len(searched) == 1
