"""Best-fit packing: ids by the library, sequences by their rules, the search against plain best fit."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemo.llm import packing

from .conftest import texts

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tool():
    return Tokenizer.from_file(FILE)


def best_fit_decreasing(lengths, capacity=1024):
    rooms = []
    for size in sorted(lengths, reverse=True):
        at = min((r, i) for i, r in enumerate(rooms + [capacity]) if r >= size)[1]
        rooms[at : at + 1] = [(rooms[at] if at < len(rooms) else capacity) - size]
    return len(rooms)


@pytest.mark.parametrize("which", ["sample", "odd", "empty"])
def test_pieces_are_whole_and_sequences_are_gapless(which, tool, request):
    docs = request.getfixturevalue(which)
    rows = packing.pack(docs).collect()
    wanted = Counter()
    for doc_id, text in texts(docs):
        ids = [*tool.encode(text, add_special_tokens=False).ids, 2]
        at, stop, piece = 0, (len(ids) - 1) % 1024 + 1, 0
        while at < len(ids):
            wanted[doc_id, piece, at, stop - at, zlib.crc32(np.array(ids[at:stop], "<u4").tobytes())] += 1
            at, stop, piece = stop, stop + 1024, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = [r.length for r in rows]
    assert -(-sum(lengths) // 1024) <= len(by) <= best_fit_decreasing(lengths)


def test_many_tasks_number_the_pieces_without_clashes(spark):
    rows = [(i, "word " * (i % 7) + "x") for i in range(3000)] + [(i, "word " * 600) for i in range(3000, 3300)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(13)).collect()
    places = Counter((r.sequence_id, r.offset) for r in out)
    assert len(out) == len(rows) and max(places.values()) == 1


PARTS = ["a", "word", "don't", "it's", " ", "  ", "\n", "\t", " \n ", " ", " ", "\x1c", "\x85", "é", "Straße", "😀", "12", "3.5", "...", "'s", "▁", "<|endoftext|>", "<|endof", "中文", "\x00", "a" * 60, "‍", "﻿"]


def test_texts_cut_before_spaces_give_the_ids_of_whole_texts(tool):
    rng = random.Random(3)
    some = ["".join(rng.choices(PARTS, k=rng.randrange(12))) for _ in range(4000)] + ["", " ", "  ", "a ", " a", "a  b", "a   b", "\n a", "a \n b", "x\t y"]
    encoder = packing.Encoder(tool.to_str())
    for text in some * 2:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_character_has_the_ids_of_the_library(tool):
    encoder = packing.Encoder(tool.to_str())
    for start in range(0, 0x3000, 7):
        text = " ".join(f"a{chr(c)}b {chr(c)}{chr(c)}'s" for c in range(start, start + 7))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids, start


def test_other_tokenizers_encode_whole_texts():
    file = public_tokenizers.path("word_bpe_49k.json")
    tool = Tokenizer.from_file(file)
    text = "Hello  the World's\n end"
    assert np.frombuffer(packing.Encoder(tool.to_str()).encode(text), "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("low,high,times", [(250, 500, 1), (300, 420, 1), (170, 400, 1), (1, 1023, 1), (250, 500, 1000)])
def test_exchanges_empty_sequences(low, high, times):
    rng = random.Random(low)
    counts = {s: n * times for s, n in Counter(rng.randint(low, high) for _ in range(1500)).items()}
    first = packing.best_fit(counts)
    if times == 1:
        assert sum(first.values()) == best_fit_decreasing(Counter(counts).elements())
    last = packing.improve(first)
    held = Counter()
    for contents, n in last.items():
        assert n > 0 and 0 < packing._fill(contents) <= 1024
        for size, each in contents:
            held[size] += each * n
    assert held == counts
    assert sum(last.values()) < sum(first.values()) or low == 1


def test_places_are_distinct_for_every_number():
    classes = {((3, 2), (5, 1)): 4, ((3, 1),): 2, ((5, 1),): 1}
    keys, runs = packing.places(classes)
    seen = set()
    for size, n in ((3, 10), (5, 5)):
        for number in range(n):
            first, base, each, offset = runs[np.searchsorted(keys, size << 44 | number, "right") - 1]
            at = number - first
            seen.add((base + at // each, offset + at % each * size))
    assert len(seen) == 15 and {s for s, _ in seen} == set(range(7))


def test_an_exchange_that_only_two_for_one_gives():
    # 600 + 300 + 124 and 500 + 524: none fits otherwise
    start = {((300, 1), (600, 1)): 1, ((500, 1),): 1, ((124, 1), (524, 1)): 1}
    assert sum(packing.improve(start).values()) == 2
