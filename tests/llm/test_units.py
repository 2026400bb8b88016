"""Kernels of the operators against brute force; no Spark."""

from __future__ import annotations

import os
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqlake.llm import gif, hnsw, packing, suffix_array, token_counts, toxicity
from seqlake.llm.language_id import UNKNOWN, Classifier
from seqlake.llm.ngram_join import Words, linked_edges, prefix_size

TEXTS = st.text(st.sampled_from("ab cZ  \n▁é한<s>'9.!0\t"), max_size=60)
LENGTHS = token_counts.Lengths(open(P.path("piece_bpe_32k.model"), "rb").read())
IDS = packing.WordIds(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_token_counts_equal_the_library(text):
    assert LENGTHS.count(text) == len(LENGTHS.encoder.encode(text))


@settings(max_examples=150, deadline=None)
@given(TEXTS | st.text(max_size=20))
def test_packed_ids_equal_the_library(text):
    want = IDS.whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(IDS.text(text), "<u4").tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=50))
def test_suffix_array_is_sorted(symbols):
    s = np.array(symbols, np.uint8)
    assert suffix_array.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: symbols[i:])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x & 1 for x in b)), max_size=6))
def test_repeated_starts(parts):
    n = 9
    count = Counter(p[i : i + n] for p in parts for i in range(len(p) - n + 1))
    assert [x.tolist() for x in suffix_array.repeated_starts(parts, n)] == [[i for i in range(len(p) - n + 1) if count[p[i : i + n]] > 1] for p in parts]


@pytest.mark.parametrize("blocks", [1, 2, 17])
def test_gif_round_trip(blocks):
    for payload in (os.urandom(576 * blocks), b"abcab" * 116 * blocks, b"\xff" * 576 * blocks):
        payload = payload[: 576 * blocks].ljust(576 * blocks, b"x")
        assert gif.read_payload(gif.decode_gif(gif.encode_gif(payload))) == payload


def frame(index: bytes, box: tuple, disposal: int, clear: int | None, interlaced: bool = False) -> bytes:
    codes = gif.lzw_encode(index, 2)
    control = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 5, 0, clear or 0, 0])
    place = b"\x2c" + b"".join(v.to_bytes(2, "little") for v in box) + bytes([0x40 if interlaced else 0])
    return control + place + b"\x02" + bytes([len(codes)]) + codes + b"\0"


def test_gif_disposal_transparency_and_interlace():
    head = b"GIF89a" + (2).to_bytes(2, "little") + (2).to_bytes(2, "little") + bytes([0xF1, 0, 0]) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    data = head + frame(b"\1\1\1\1", (0, 0, 2, 2), 1, None) + frame(b"\2\3", (0, 0, 2, 1), 3, 3) + frame(b"\3", (1, 1, 1, 1), 2, None) + frame(b"\2\1\2\1", (0, 0, 2, 2), 0, 1, True) + b"\x3b"
    first, second, third, fourth = gif.decode_gif(data)
    red, green, blue = [255, 0, 0], [0, 255, 0], [0, 0, 255]
    assert first.rgb.tolist() == [[red, red], [red, red]]
    assert second.rgb.tolist() == [[green, red], [red, red]]  # index 3 is clear there
    assert third.rgb.tolist() == [[red, red], [red, blue]]  # the second frame was taken back
    assert fourth.shown.tolist() == [[True, True], [True, False]]  # the third left a hole that index 1 doesn't fill
    assert first.delay_ms == 50 and int(first.histogram().sum()) == 4
    with pytest.raises(ValueError):
        gif.decode_gif(b"no image")


def test_patterns_place_every_piece():
    rng = random.Random(1)
    histogram = dict(Counter(rng.randint(1, 64) for _ in range(3000)))
    found = packing.plan(histogram, 64)
    placed = Counter()
    for pattern, times in found:
        assert sum(k * v for k, v in pattern.items()) <= 64
        for k, v in pattern.items():
            placed[k] += v * times
    assert placed == Counter(histogram)
    assert sum(t for _, t in found) <= 1.02 * sum(k * v for k, v in histogram.items()) / 64 + 2
    assert packing.plan({}, 64) == []


def test_links_are_found_with_few_verifications():
    words, rng = Words(), random.Random(2)
    base = [[f"w{rng.randint(0, 300)}" for _ in range(60)] for _ in range(6)]
    texts = [" ".join(w if rng.random() > 0.02 else "x" for w in b) for b in base for _ in range(8)]
    sets = [words.shingles(t, 3) for t in texts]
    sizes = np.array([len(s) for s in sets])
    edges = linked_edges(sets, sizes, np.zeros(len(sets), int), 80, np.zeros(16, np.uint32))

    def labels(pairs):
        label = list(range(len(sets)))
        for _ in sets:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    both = lambda a, b: len(set(a.tolist()) & set(b.tolist()))
    every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * both(sets[i], sets[j]) >= 80 * (len(sets[i]) + len(sets[j]) - both(sets[i], sets[j]))]
    assert labels(edges) == labels(every)
    assert prefix_size(0, 80) == 0 and len(words.shingles("", 3)) == 0 and len(words.shingles("One", 3)) == 1


@pytest.mark.parametrize("clustered", [False, True])
def test_graph_recall(clustered):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 16))
    if clustered:
        v = v * 0.01 + rng.normal(size=(20, 16))[rng.integers(0, 20, 1500)]
    g = hnsw.build(v)
    graph, hit = hnsw.Graph(v, g["level"], g["neighbours"]), 0
    assert len(g["neighbours"]) == sum((hnsw.LINKS if k else hnsw.LINKS0) * int((g["level"] >= k).sum()) for k in range(g["level"].max() + 1))
    for q, nodes in zip(v[:50], graph.search(v[:50], hnsw.SEARCH)[0], strict=True):
        want = set(np.argsort(((v - q) ** 2).sum(1), kind="stable")[:10].tolist())
        hit += len(want & set(nodes[:10].tolist()))
    assert hit >= 0.95 * 500
    assert (hnsw.Graph(np.zeros((0, 4)), np.zeros(0, np.int32), np.zeros(0, np.int32)).search(np.zeros((1, 4)), 5)[0] < 0).all()


def test_positive_unlabelled_learning():
    rng, places = random.Random(3), toxicity.Places()
    make = lambda bad: " ".join([f"w{rng.randint(0, 400)}" for _ in range(40)] + (["vile"] if bad else []))
    model = toxicity.train([places.of(make(True)) for _ in range(60)], [places.of(make(i % 8 == 0)) for i in range(800)], 1 / 8)
    assert all(model.score(places.of(make(True))) > 0.5 for _ in range(40))
    assert sum(model.score(places.of(make(False))) > 0.5 for _ in range(200)) <= 4
    assert toxicity.train([], [], 0.0).score(places.of("")) < 0.5


def test_languages_by_compression():
    model = {"a": b"the cat and the dog went to the market " * 60, "b": b"der hund und die katze gehen zum markt " * 60}
    classify = Classifier(model)
    assert classify("The dog and the cat")[0] == "a" and classify("die katze und der hund " * 40)[0] == "b"
    assert classify(None)[0] == classify("")[0] == classify("123 !?")[0] == UNKNOWN
    assert Classifier({})("text")[0] == UNKNOWN
