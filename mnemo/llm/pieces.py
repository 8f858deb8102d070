"""Operator 1, SentencePiece encoding and decoding with byte offsets.

The text is normalised here: the compiled character map (a double-array trie over UTF-8 prefixes with their
replacements) is applied by longest prefix, and for every byte of the result the source byte it came from is recorded.
The library then segments the normalised text (a copy of the model without a normaliser of its own), and because the
pieces spell the normalised text, their lengths project through that record to spans of original bytes.

One pass, no shuffle; tasks hold one chunk of texts at a time. Defined cases: a null text is empty and has no tokens;
null ids and further columns pass; rows that repeat are encoded each; a very long text is encoded whole, alone in its chunk; an empty table gives
an empty result; nothing is ordered, so there are no ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemo.llm.common import chunks, text_of, tidy

SPACE = "▁"


class CharMap:
    """The compiled character map: uint32 size of the trie, its units, then replacements that end in a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that data has at this place, and its replacement."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._child(0)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.texts[start : self.texts.index(b"\0", start)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)

    def _child(self, node: int) -> int:
        return node ^ self._offset(self.units[node])


class Normaliser:
    """What the model's normaliser does, with alignment: normal(text) gives the bytes and, for each of them and for the
    end, the original byte it starts at."""

    def __init__(self, charmap: bytes, dummy_prefix: bool, squeeze: bool, escape: bool, suffix: bool = False):
        self.map, self.dummy, self.squeeze, self.suffix = CharMap(charmap), dummy_prefix, squeeze, suffix
        self.space = (SPACE if escape else " ").encode()
        self.plain = not charmap and not squeeze and not suffix

    def normal(self, text: str) -> tuple[str, np.ndarray]:
        if not text:
            return "", np.zeros(1, np.int64)
        return self._plain(text) if self.plain else self._mapped(text.encode())

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        """No character map: only spaces change, so the record is their running count."""
        raw = np.frombuffer(text.encode(), np.uint8)
        source = np.repeat(np.arange(raw.size), np.where(raw == 32, len(self.space), 1))
        lead = self.dummy * len(self.space)
        out = (self.space.decode() if self.dummy else "") + text.replace(" ", self.space.decode())
        return out, np.concatenate((np.zeros(lead, np.int64), source, [raw.size]))

    def _mapped(self, data: bytes) -> tuple[str, np.ndarray]:
        out, source, at, gap = bytearray(), [], 0, self.squeeze
        if self.squeeze:
            while at < len(data) and (step := self._step(data, at))[1] == b" ":
                at += step[0]
            if at == len(data):
                return "", np.array([len(data)])
        lead = self.space if self.dummy and not self.suffix else b""
        out += lead
        source += [at] * len(lead)
        while at < len(data):
            n, new = self._step(data, at)
            if gap:
                new = new.lstrip(b" ")
            if new:
                shown = new.replace(b" ", self.space)
                out += shown
                source += range(at, at + n) if shown == data[at : at + n] else [at] * len(shown)
                gap = self.squeeze and new.endswith(b" ")
            at += n
        while self.squeeze and out.endswith(self.space):
            del out[-len(self.space) :]
            at = source[len(out)]
            del source[len(out) :]
        if self.dummy and self.suffix:
            out += self.space
            source += [at] * len(self.space)
        return out.decode(), np.array([*source, at])

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        if found := self.map.longest(data, at):
            return found
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, data[at : at + n]


class Codec:
    """A model: encode with spans, decode."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.normaliser = Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec.Clear()
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.unknown = self.library.unk_id()
        n = self.library.get_piece_size()
        self.width = np.array([1 if self.library.is_byte(i) else len(self.library.id_to_piece(i).encode()) for i in range(n)])
        self.names = [str(i) for i in range(n)]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """For each text its ids and the original byte at which each piece begins, then the end."""
        normal = [self.normaliser.normal(t) for t in texts]
        for (text, source), ids in zip(normal, self.bare.encode([t for t, _ in normal], num_threads=1), strict=True):
            width = self.width[ids] if ids else np.zeros(0, np.int64)
            if self.unknown in ids:  # an unknown piece is as long as what it stands for
                width = np.array([len(p.encode()) if i == self.unknown else w for p, i, w in zip(self.bare.encode(text, out_type=str), ids, width, strict=True)])
            yield ids, source[np.concatenate(([0], np.cumsum(width)))] if ids else source[-1:]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids) if ids else []


@lru_cache(maxsize=4)
def codec(model: bytes) -> Codec:
    return Codec(model)


def read_model(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, begins, ends: the pieces of every text with the half-open spans of original bytes they cover."""
    tidy(docs.sparkSession)
    blob = read_model(model)

    def work(batches):
        tool = codec(blob)
        for part in chunks(batches):
            found = list(tool.encode(part.column("text").to_pylist()))
            ids = pa.array([x for x, _ in found], pa.list_(pa.int32()))
            begins = pa.array([s[:-1] for _, s in found], pa.list_(pa.int64()))
            ends = pa.array([s[1:] for _, s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, begins, ends], ["doc_id", "ids", "begins", "ends"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, begins array<bigint>, ends array<bigint>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text for rows of doc_id, ids."""
    tidy(encoded.sparkSession)
    blob = read_model(model)

    def work(batches):
        tool = codec(blob)
        for batch in batches:
            texts = tool.decode([x or [] for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Digests of both directions in one pass: n_tokens, ids_sha256, decoded_sha256, spans_sha256 (of the borders of the
    pieces in original bytes, as decimals joined by commas). keep_ids: the ids as well."""
    tidy(docs.sparkSession)
    blob = read_model(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        tool = codec(blob)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for part in chunks(batches):
            found = list(tool.encode(part.column("text").to_pylist()))
            texts = tool.decode([ids for ids, _ in found])
            columns = [
                part.column("doc_id"),
                pa.array([len(ids) for ids, _ in found], pa.int64()),
                pa.array([sha(",".join([tool.names[i] for i in ids]).encode()) for ids, _ in found]),
                pa.array([sha(t.encode()) for t in texts]),
                pa.array([sha(",".join(map(str, spans.tolist())).encode()) for _, spans in found]),
            ] + [pa.array([ids for ids, _ in found], pa.list_(pa.int32()))] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"] + ["ids"] * keep_ids)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(work, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string" + ", ids array<int>" * keep_ids)
