"""Operator 11, best-fit packing improved by swaps.

Documents become pieces of at most `capacity` tokens, and pieces go into sequences of that capacity. Which piece of a length goes where makes no
difference to how many sequences there are, so what has to be solved is how many pieces of each length there are: at most `capacity` counts, whatever
the size of the corpus. Spark encodes the documents, counts the lengths, numbers the pieces of each length across all tasks, and puts each piece at its
place; the counts alone are packed on the driver, where sequences of equal contents are one class with a multiplicity.

* Best fit, longest first: the pieces of a length go to the sequences with the least room that holds them, class by class.
* Local search between classes of underfull sequences: a piece moves, one is exchanged for one, two for one or one for two, wherever that fills the
  fuller sequence further. Each step increases the sum of squared fills and is done in all sequences of the two classes at once. It ends when the
  number of sequences meets the least possible (tokens / capacity), when no exchange is left, or after `effort` of them; emptied sequences go.

A piece is numbered among those of its length by its task as it is written; the counts by task and length, summed in the order of tasks, give the offset of each
task. So nothing is sorted, no length is a hot group (there is one row a task and length), and a third of all pieces of one length costs nothing.

Texts are cut where the tokenizer's own pattern always cuts, before a space with a character after it. Tasks keep the ids of short parts and, below them, of
pre-tokens; the library's model encodes each that is new. Texts with the tokenizer's special strings are encoded whole.

Defined cases: a null or empty text is its end token alone; null ids are kept; repeated rows are packed each; a long text is whole, in pieces; an empty
table gives an empty result; ties are decided by task and order of reading; further columns are left aside."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch, chunks, text_of, tidy

CAPACITY = 1024
#: Exchanges that the local search looks for, at most.
EFFORT = 10_000
#: Parts of texts that a task keeps encoded, and how long they are at most.
HELD, SHORT = 700_000, 48
# The characters that stand for bytes in byte-level vocabularies. Printable Latin-1 stands for itself, the others follow at 256.
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: Before a space that any character but white space follows; then nothing depends on what comes before.
CUT = re.compile(r" (?=\S)")
ODD = re.compile(r" (?:\s|$)")
Contents = tuple[tuple[int, int], ...]
Classes = dict[Contents, int]


class _Parts(dict):
    """Ids of parts of texts, met lately; with `after`, of parts that follow a space, which the keys leave out. A part of several pre-tokens is put together from
    theirs, and the library's own model encodes a pre-token. So it is within the letters whose kind no version of Unicode disputes; other parts are encoded as they are."""

    def __init__(self, tool, pattern: regex.Pattern, after: _Parts | None = None):
        self.tool, self.model, self.pattern = tool, tool.model, pattern
        self.lead, self.plain = "" if after is None else " ", self if after is None else after
        self.mark = self.lead.translate(BYTES)

    def __missing__(self, part: str) -> bytes:
        if len(self) > HELD:
            self.clear()
        if part.isascii() and part.isalpha():
            ids = self._ids(self.mark + part)
        elif part and max(part) >= "\u0250":
            ids = np.array(self.tool.encode(self.lead + part, add_special_tokens=False).ids, "<u4").tobytes()
        elif (word := part.rstrip(".,;:!?")).isalpha() and len(word) < len(part):
            ids = self[word] + self.plain[part[len(word) :]]
        else:
            first, *rest = self.pattern.findall(self.lead + part) or [""]
            ids = self._one(first) + b"".join(map(self.plain.__getitem__, rest)) if rest else self._one(first)
        if len(part) <= SHORT:
            self[part] = ids
        return ids

    def _one(self, word: str) -> bytes:
        return self._ids(word.encode().decode("latin-1").translate(BYTES))

    def _ids(self, marked: str) -> bytes:
        return struct.pack(f"<{len(found := self.model.tokenize(marked))}I", *[t.id for t in found])


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers, just as the tokenizers library gives them."""

    def __init__(self, blob: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_str(blob)
        self.tool.no_truncation()
        self.tool.no_padding()
        added = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        spec = json.loads(blob)
        kind = spec["pre_tokenizer"] or {}
        # only this kind cuts by the pattern and before spaces; texts are encoded whole for any other
        self.by_parts = kind.get("type") == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"] and not spec["normalizer"] and spec["model"]["type"] == "BPE"
        pattern = regex.compile(public_tokenizers.PATTERN)
        self.first = _Parts(self.tool, pattern)
        self.known = _Parts(self.tool, pattern, self.first)

    def encode(self, text: str) -> bytes:
        if not self.by_parts or self.special.search(text):
            return np.array(self.tool.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = CUT.split(text) if ODD.search(text) else text.split(" ")
        return self.first[first] + b"".join(map(self.known.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(blob: str) -> Encoder:
    return Encoder(blob)


def pieces(docs: DataFrame, blob: Broadcast, end: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with the task that made it and its number among that task's pieces of its length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, task = encoder(blob.value), TaskContext.get().partitionId()
        seen, last = [0] * (capacity + 1), np.array([end], "<u4").tobytes()
        for part in chunks(batches):
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                ids = tool.encode(text) + last
                n = len(ids) // 4
                at, stop = 0, (n - 1) % capacity + 1
                while at < n:
                    size = stop - at
                    row.append(i)
                    piece.append(-(-at // capacity))
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * stop]))
                    rank.append(seen[size])
                    seen[size] += 1
                    at, stop = stop, stop + capacity
            columns = [part.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)] + [pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(work, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint")


def _fill(contents: Contents) -> int:
    return sum(size * n for size, n in contents)


def _with(contents: Contents, size: int, n: int) -> Contents:
    """contents with n more (or fewer) pieces of a size."""
    have = dict(contents)
    have[size] = have.get(size, 0) + n
    return tuple(sorted((s, k) for s, k in have.items() if k))


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Classes:
    """Longest first, each piece into the sequence with the least room that holds it; sequences of equal contents are one class."""
    rooms: list[Classes] = [{} for _ in range(capacity + 1)]

    def put(contents: Contents, room: int, n: int) -> None:
        if n:
            rooms[room][contents] = rooms[room].get(contents, 0) + n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = next((r for r in range(size, capacity) if rooms[r]), capacity)
            contents, there = rooms[room].popitem() if rooms[room] else ((), left)
            each = room // size
            full = min(there, left // each)
            put(_with(contents, size, each), room - each * size, full)
            left -= full * each
            there -= full
            if there and 0 < left < each:
                put(_with(contents, size, left), room - left * size, 1)
                there, left = there - 1, 0
            if contents:
                put(contents, room, there)
    return {contents: n for room in rooms for contents, n in room.items()}


@lru_cache(maxsize=200_000)
def _takes(contents: Contents) -> tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]:
    """What can leave a sequence, by its tokens: nothing, one piece or two; and how many pieces that is."""
    sizes = [s for s, _ in contents]
    sets: list[tuple[int, ...]] = [(), *((s,) for s in sizes), *((a, b) for i, a in enumerate(sizes) for b in sizes[i + 1 :]), *((s, s) for s, n in contents if n > 1)]
    return np.array([sum(x) for x in sets]), np.array([len(x) for x in sets]), sets


def improve(classes: Classes, capacity: int = CAPACITY, effort: int = EFFORT) -> Classes:
    """Local search: sweeps over the underfull sequences, the emptiest first; each class takes the exchange with a fuller one (or its like) that
    adds most to the squared fills of all sequences of the two. Empty sequences go."""
    bins = dict(classes)
    total, fewest = sum(bins.values()), -(-sum(_fill(c) * n for c, n in bins.items()) // capacity)

    def add(contents: Contents, n: int) -> None:
        bins[contents] = bins.get(contents, 0) + n
        if not bins[contents]:
            del bins[contents]

    moved = True
    while moved and total > fewest and effort > 0:
        moved = False
        under = sorted((c for c in bins if _fill(c) < capacity), key=lambda c: (_fill(c), c))
        takes = [_takes(c) for c in under]
        of = np.repeat(np.arange(len(under)), [len(t[0]) for t in takes])
        nth = np.concatenate([np.arange(len(t[0])) for t in takes]) if takes else of
        back, n_back = (np.concatenate([t[i] for t in takes]) if takes else of for i in (0, 1))
        fill, many = np.array([_fill(c) for c in under], np.int64), np.array([bins[c] for c in under], np.int64)
        room, fuller = (capacity - fill)[of], fill[of]
        for d, donor in enumerate(under):
            if total <= fewest or effort <= 0:
                break
            if not many[d]:
                continue
            effort -= 1
            out, n_out, outs = takes[d]
            both = np.minimum(many, many[d])
            both[d] = many[d] // 2
            own = fill[d]
            gain = out[:, None] - back[None, :]
            fits = (gain > 0) & (gain <= room) & (fuller >= own) & (n_out[:, None] + n_back[None, :] <= 3)
            worth = np.where(fits, gain * (fuller - own + gain).astype(np.float64) * both[of], 0)
            i, j = divmod(int(worth.argmax()), len(of))
            if not worth[i, j]:
                continue
            r = int(of[j])
            receiver, n = under[r], int(both[r])
            new_donor, new_receiver = donor, receiver
            for size in outs[i]:
                new_donor, new_receiver = _with(new_donor, size, -1), _with(new_receiver, size, 1)
            for size in takes[r][2][int(nth[j])]:
                new_donor, new_receiver = _with(new_donor, size, 1), _with(new_receiver, size, -1)
            for contents, at in ((donor, d), (receiver, r)):
                add(contents, -n)
                many[at] -= n
            add(new_receiver, n)
            if new_donor:
                add(new_donor, n)
            else:
                total -= n
            moved = True
    return bins


def places(classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of each length go, in runs: (length << 44 | first number), sorted; and by run the first number, the first sequence, how many
    go to each sequence, and the offset of the first there."""
    runs, taken, base = [], {}, 0
    for contents, n in sorted(classes.items()):
        offset = 0
        for size, each in contents:
            first = taken.get(size, 0)
            runs.append((size << 44 | first, first, base, each, offset))
            taken[size] = first + n * each
            offset += size * each
        base += n
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return table[:, 0].copy(), table[:, 1:].copy()


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 2, capacity: int = CAPACITY, effort: int = EFFORT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    tidy(spark)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer, encoding="utf-8") as f:
        blob = spark.sparkContext.broadcast(f.read())
    scratch = Scratch(spark, "packing")
    made = scratch.put("pieces", pieces(docs, blob, end, capacity))
    counts = scratch.put("counts", made.groupBy("length", "task").agg(F.count("*").alias("n")))
    # one row a length: at most `capacity` rows
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, runs = places(improve(best_fit(lengths, capacity), capacity, effort))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("number").to_numpy()
            run = np.searchsorted(keys, batch.column("length").to_numpy() << 44 | number, "right") - 1
            first, base, each, offset = runs[run].T
            at = number - first
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(base + at // each), pa.array(offset + at % each * batch.column("length").to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = made.join(offsets, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("number"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(work, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
