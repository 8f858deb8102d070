import hashlib
import struct

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from mnemo.llm import pieces, token_counts

from .conftest import texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("which", ["sample", "odd", "empty"])
def test_round_trip(which, request):
    docs = request.getfixturevalue(which)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t in texts(docs):
        ids = library.encode(t)
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = pieces.round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_spans_cover_the_bytes(odd):
    raw = dict(texts(odd.filter("doc_id IS NOT NULL")))
    codec = pieces.codec(pieces.read_model())
    for r in pieces.encode(odd.filter("doc_id IS NOT NULL")).collect():
        data = raw[r.doc_id].encode()
        assert r.begins[1:] == r.ends[:-1] and (not r.ids or (r.begins[0], r.ends[-1]) == (0, len(data)))
        for i, b, e in zip(r.ids, r.begins, r.ends, strict=True):
            piece = codec.library.id_to_piece(i)
            if not codec.library.is_byte(i) and b > 0:
                assert data[b:e].decode().replace(" ", "▁") == piece


def test_decode(sample):
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(sample)).collect()}
    assert all(back[i] == t for i, t in texts(sample))


def charsmap(rules):
    """A compiled map with a trie laid out by hand: every node's children at an offset of their own."""
    strings, where, trie = b"", {}, {}
    for old, new in rules.items():
        where[old] = len(strings)
        strings += new + b"\0"
        node = trie
        for c in old:
            node = node.setdefault(c, {})
        node[None] = where[old]
    units, free = {0: 0}, [256]

    def place(node, at):
        base = free[0]
        free[0] += 512
        low = at ^ base
        assert low < 1 << 21
        units[at] = units.get(at, 0) | low << 10 | ((None in node) << 8)
        for c, child in node.items():
            if c is None:
                units[base] = child | 1 << 31
            else:
                units[base ^ c] = units.get(base ^ c, 0) | c
                place(child, base ^ c)

    place(trie, 0)
    size = max(units) + 1
    flat = [units.get(i, 0x7FFFFFFF & ~0xFF | 0xFE) if i in units else 0xFE for i in range(size)]
    return struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *flat) + strings


def test_longest_prefix_of_a_character_map():
    n = pieces.Normaliser(charsmap({b"ab": b"X", b"abc": b"YZ", "ä".encode(): b"ae", b"\t": b" ", b"z": b""}), True, True, True)
    text, source = n.normal("  abcab ä\t\tzq ")
    assert text == "▁YZX▁ae▁q"
    #  the dummy prefix, then where each byte began: abc at 2, ab at 5, the space at 7, ä at 8, a tab at 10, q at 13
    assert source.tolist() == [2, 2, 2, 2, 2, 5, 7, 7, 7, 8, 8, 10, 10, 10, 13, 14]
    plain = pieces.Normaliser(b"", True, False, True)
    slow = pieces.Normaliser(b"", True, False, True)
    slow.plain = False
    for t in ("", " ", "a b", "é 😀  x", "▁ "):
        a, b = plain.normal(t), slow.normal(t)
        assert a[0] == b[0] and a[1].tolist() == b[1].tolist() or not t


@pytest.mark.parametrize("which", ["sample", "odd", "empty"])
def test_counts(which, request, tmp_path):
    docs = request.getfixturevalue(which)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted(((i, len(t.encode()), n := len(library.encode(t)), n > 100) for i, t in texts(docs)), key=str)
    cache = str(tmp_path / "cache")
    assert sorted((tuple(r) for r in token_counts.token_counts(docs, cache=cache, limit=100).collect()), key=str) == want
    before = docs.sparkSession.read.parquet(cache).count()
    assert before == len({t for _, t in texts(docs)})
    assert sorted((tuple(r) for r in token_counts.token_counts(docs, cache=cache, limit=100).collect()), key=str) == want
    assert docs.sparkSession.read.parquet(cache).count() == before  # all found, nothing stored anew
    docs.sparkSession.read.parquet(cache).write.mode("append").parquet(cache)  # as after two runs at once
    assert sorted((tuple(r) for r in token_counts.token_counts(docs, cache=cache, limit=100).collect()), key=str) == want


def test_other_libraries(spark, sample, tmp_path):
    cache = str(tmp_path / "cache")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(sample, public_tokenizers.path("byte_bpe_50k.json"), cache).collect()}
    assert all(got[i] == len(t.encode(x, add_special_tokens=False).ids) for i, x in texts(sample))
    import base64

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(sample, path, cache).collect()}
    assert all(got[i] == len(e.encode_ordinary(x)) for i, x in texts(sample))
    assert spark.read.parquet(cache).select("version").distinct().count() == 2
