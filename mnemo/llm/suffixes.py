"""Operator 3, suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts earlier are removed.

Which suffixes. Suffixes start at anchors: tokens of K bytes whose hash is the least in some window of LENGTH bytes, so equal windows have
an anchor at the same place in them, and about one byte in 30 starts a suffix. A suffix is ordered by its leading tokens:
the anchor's token, then its context, which is all that windows around the anchor can hold (LENGTH - K bytes on either side, as far
as the text goes).

Sorting. Splitters come from a sample of documents. A suffix goes to the bucket between splitters that it falls in, by token,
context, document and place, so a token of a third of all suffixes is cut like any other. Each bucket is sorted by multikey quicksort:
by the first token column, then runs of equals by the next. Buckets compare across their boundary through the splitter: one that repeats
the tokens of the splitter before it says that the bucket's first run began in an earlier bucket.

Marking. In a run of equal token and context all but the first are copies, and their whole context goes. Where a token has several
contexts, the first of each may share windows with the others: these fetch their texts again, and all windows there that no copy
covers (suffixes at every byte, the whole window as leading token) are sorted and marked in the same way. Tokens and contexts, or
windows, are compared by 128 bits of hash.

Shuffles: about 20 bytes an anchor; the texts twice, to meet their marks; as many a window near places where copies differ. Every step ends in a
table in the shared folder, and its shuffle files go when it ends. A task holds one bucket of fixed-size records.

Defined cases: null and empty texts and those shorter than LENGTH keep all bytes; rows with a null id have no place in the order, keep all
bytes and remove nothing from others; rows that repeat an id and its text are one document met twice and get the same result (an id has one
text); an empty table gives an empty result; further columns are left aside."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch, chunks, text_of, tidy

LENGTH, K = 100, 40
SIDE = LENGTH - K
#: One document in SHARE is read for splitters where the corpus has more than SMALL bytes and a hundred times as many documents; about SAMPLE of its suffixes are kept, or PER a bucket
#: if that is more (2 million records at most).
SHARE, SMALL, SAMPLE, PER = 64, 50_000_000, 100_000, 10
#: Records that a bucket is meant to hold, and that a task gathers before it deals them out; buckets at most. Up to 80 billion records (2.5 TB of text)
#: the first holds, beyond that buckets grow: at 100 TB to 16 million records of 28 bytes. Splitters, 28 bytes each, stay below 6 MB.
BUCKET, GATHER, MOST = 400_000, 1_000_000, 200_000
#: Long texts are hashed in stretches of so many bytes, each with what windows need around it.
STRETCH = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xD6E8FEB86659FD93)
POWERS: dict[tuple[int, bool], np.ndarray] = {}

Records = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # two token columns, document, place


def _powers(which: int, n: int, inverse: bool) -> np.ndarray:
    if len(POWERS.get((which, inverse), ())) < n:
        out = np.full(max(n, 1 << 15), pow(BASES[which], -1 if inverse else 1, 1 << 64), np.uint64)
        out[0] = 1
        POWERS[which, inverse] = np.multiply.accumulate(out)
    return POWERS[which, inverse][:n]


class Hashes:
    """64-bit hashes of any stretch of data from prefix sums of byte * base**place, brought to place 0 by the inverse power."""

    def __init__(self, data: np.ndarray, which: int):
        self.back = _powers(which, len(data) + 1, True)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(which, len(data), False), out=self.sums[1:])

    def between(self, start, end) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        h = (h ^ (h >> np.uint64(32))) * MIX
        return h ^ (h >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """pick (minimum or maximum) of each `width` in a row."""
    n, span = len(values) - width + 1, 1
    while span * 2 <= width:
        values, span = pick(values[:-span], values[span:]), span * 2
    return pick(values[:n], values[width - span : width - span + n])


def _stretches(n: int) -> Iterator[tuple[int, int, int, int]]:
    """Begin and end of data to hash, first and last + 1 of the windows in question."""
    for s in range(0, n - LENGTH + 1, STRETCH):
        e = min(s + STRETCH, n - LENGTH + 1)
        yield max(0, s - LENGTH), min(n, e + 2 * LENGTH), s, e


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, token and context of each anchor of a text."""
    raw, found = np.frombuffer(data, np.uint8), []
    for begin, end, first, last in _stretches(len(raw)):
        token, context = (Hashes(raw[begin:end], i) for i in (0, 1))
        n, w = end - begin - K + 1, SIDE + 1
        h = token.between(slice(0, n), slice(K, K + n))
        low = _sliding(h, w, np.minimum)
        low[: first - begin] = 0
        low[last - begin :] = 0
        # a token is the least of some window that has it if its hash is the greatest of the least of these windows
        pad = np.zeros(w - 1, np.uint64)
        p = np.flatnonzero(_sliding(np.concatenate((pad, low, pad)), w, np.maximum) == h)
        left, right = np.maximum(p - SIDE, -begin), np.minimum(p + LENGTH, len(raw) - begin)
        c = context.between(left, right) + (p - left).astype(np.uint64) * MIX + (right - p).astype(np.uint64)
        found.append((p + begin, h[p], c))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    place, token, context = (np.concatenate(x) for x in zip(*found, strict=True))
    place, once = np.unique(place, return_index=True)
    return place, token[once], context[once]


def windows(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of the windows of a text that start there (in order)."""
    raw, found = np.frombuffer(data, np.uint8), []
    for begin, end, first, last in _stretches(len(raw)):
        s = starts[np.searchsorted(starts, first) : np.searchsorted(starts, last)] - begin
        found.append([Hashes(raw[begin:end], i).between(s, s + LENGTH) for i in (0, 1)])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def multikey_order(*columns: np.ndarray) -> np.ndarray:
    """Order by the columns: quicksort by the first, then only the runs of equals by the next, and so on."""
    order = np.argsort(columns[0])
    run = np.zeros(len(order), np.int64)
    run[1:] = np.cumsum(columns[0][order][1:] != columns[0][order][:-1])
    for column in columns[1:]:
        same = run[1:] == run[:-1] if len(run) else np.zeros(0, bool)
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if not len(tied):
            break
        own = order[tied]
        own = own[np.lexsort((column[own], run[tied]))]
        order[tied] = own
        new = np.ones(len(order), bool)
        new[0] = False
        new[1:] = run[1:] != run[:-1]
        new[tied[1:]] |= column[own[1:]] != column[own[:-1]]
        run = np.cumsum(new)
    return order


@dataclass
class Splitters:
    """The least records of buckets 1, 2, ...; whole: cut inside a run of equal tokens, so the bucket's first run began before."""

    a: np.ndarray
    c: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    whole: np.ndarray

    @classmethod
    def choose(cls, sample: Records, buckets: int) -> Splitters:
        order = multikey_order(*sample)
        picks = order[np.unique(np.linspace(0, len(order), buckets + 1).astype(int)[1:-1])] if len(order) else order
        a, c, doc, at = (x[picks].copy() for x in sample)
        whole = np.zeros(len(picks), bool)
        for i in range(len(picks)):
            j = picks[i - 1] if i else None
            whole[i] = i > 0 and sample[0][j] == a[i] and sample[1][j] == c[i]
            if not whole[i]:  # from the start of the run, of the token's if no other splitter has it
                doc[i], at[i] = np.iinfo(np.int64).min, -1
                c[i] = c[i] if i and sample[0][j] == a[i] else 0
        keep = np.ones(len(picks), bool)
        for i in range(1, len(picks)):
            keep[i] = (a[i], c[i], doc[i], at[i]) != (a[i - 1], c[i - 1], doc[i - 1], at[i - 1])
        return cls(a[keep], c[keep], doc[keep], at[keep], whole[keep])

    def bucket(self, records: Records) -> np.ndarray:
        """How many splitters are not above each record."""
        a, c, doc, at = records
        out = np.searchsorted(self.a, a, "left")
        end = np.searchsorted(self.a, a, "right")
        close = np.flatnonzero(end > out)
        for value in np.unique(a[close]):
            own = close[a[close] == value]
            i, j = int(out[own[0]]), int(end[own[0]])
            rank = np.lexsort((np.append(np.zeros(j - i), np.ones(len(own))), np.append(self.at[i:j], at[own]), np.append(self.doc[i:j], doc[own]), np.append(self.c[i:j], c[own])))
            below = np.empty(len(rank), np.int64)
            below[rank] = np.cumsum(rank < j - i)
            out[own] = i + below[j - i :]
        return out


def mark(records: Records, bucket: int, cuts: Splitters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket: document, place, and 0 for a copy, 1 for the first of a context whose token may have others."""
    if not len(records[0]):
        return records[2], records[3], np.zeros(0, np.int8)
    a, c, doc, at = (x[o] for o in [multikey_order(*records)] for x in records)
    token = np.append(True, a[1:] != a[:-1])
    run = token | np.append(True, c[1:] != c[:-1])
    head = np.flatnonzero(run)[np.cumsum(run) - 1]  # the first of each record's run
    copy = (doc != doc[head]) | (at != at[head])
    begun = bucket > 0 and cuts.whole[bucket - 1] and (a[0], c[0]) == (cuts.a[bucket - 1], cuts.c[bucket - 1])
    if begun:
        copy[head == 0] = True
    group = np.cumsum(token) - 1
    contexts = np.bincount(group, run)
    # a token that a boundary cuts may have other contexts beyond it
    cut = np.zeros(len(contexts), bool)
    cut[0] = bucket > 0 and cuts.a[bucket - 1] == a[0] and (cuts.c[bucket - 1] != 0 or cuts.whole[bucket - 1])
    cut[-1] |= bucket < len(cuts.a) and cuts.a[bucket] == a[-1]
    several = ((contexts > 1) | cut)[group] & run & ~copy
    kept = copy | several
    return doc[kept], at[kept], np.where(copy, 0, 1).astype(np.int8)[kept]


def _blob(records: Records) -> bytes:
    """By column; documents and places as differences, which compress well, tokens (hashes) as they are."""
    a, c, doc, at = records
    slim = np.concatenate((np.diff(doc, prepend=0).view(np.uint8), np.diff(at.astype(np.int64), prepend=0).astype("<i4").view(np.uint8)))
    head = np.array([len(a)], "<i8").tobytes()
    return b"".join((head, a.tobytes(), c.tobytes(), pa.compress(slim, codec="zstd", asbytes=True)))


def _unblob(blobs: list[bytes]) -> Records:
    parts = []
    for b in blobs:
        n = int.from_bytes(b[:8], "little")
        slim = pa.decompress(b[8 + 16 * n :], decompressed_size=12 * n, codec="zstd", asbytes=True)
        doc, at = np.cumsum(np.frombuffer(slim, "<i8", n)), np.cumsum(np.frombuffer(slim, "<i4", n, 8 * n).astype(np.int64)).astype(np.int32)
        parts.append((np.frombuffer(b, "<u8", n, 8), np.frombuffer(b, "<u8", n, 8 + 8 * n), doc, at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, t) for t in ("<u8", "<u8", "<i8", "<i4"))


def _dealt(cuts: Splitters, source: Iterator[Records]) -> Iterator[pa.RecordBatch]:
    """Gathers records and deals them to buckets, packed by column."""
    held, n = [], 0

    def out():
        records = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        b = cuts.bucket(records)
        order = np.argsort(b, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(b[order]) > 0))
        for s, e in zip(first, np.append(first[1:], len(order)), strict=True):
            own = order[s:e]
            yield pa.RecordBatch.from_arrays([pa.array([int(b[own[0]])], pa.int32()), pa.array([_blob(tuple(x[own] for x in records))], pa.binary())], ["bucket", "records"])

    for records in source:
        held.append(records)
        n += len(records[0])
        if n >= GATHER:
            yield from out()
            held, n = [], 0
    if n:
        yield from out()


def _sorted(dealt: DataFrame, cuts: Splitters) -> DataFrame:
    """doc, at, kind as mark() says."""

    def work(batches):
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, x in zip(batch.column("bucket").to_pylist(), batch.column("records").to_pylist(), strict=True):
                blobs.setdefault(b, []).append(x)
        for b in sorted(blobs):
            doc, at, kind = mark(_unblob(blobs.pop(b)), b, cuts)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(kind, pa.int8())], ["doc", "at", "kind"])

    return dealt.repartitionById(len(cuts.a) + 1, F.col("bucket")).mapInArrow(work, "doc bigint, at int, kind tinyint")


def _documents(batches) -> Iterator[tuple[int, bytes, list]]:
    for part in chunks(batches):
        marks = part.column("marks").to_pylist() if "marks" in part.schema.names else [None] * part.num_rows
        for doc, text, m in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), marks, strict=True):
            yield doc, text.encode(), m


def _covered(n: int, places: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which bytes of a text of n bytes marks remove: 0 an anchor's context, 2 a window."""
    begin = np.where(kinds == 2, places, np.maximum(places - SIDE, 0))
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, np.minimum(places + LENGTH, n), -1)
    return np.cumsum(change[:n]) > 0


def _apart(n: int, marks: list[tuple[int, int]]) -> np.ndarray:
    """Starts of the windows that have an anchor of kind 1 and that no copy covers."""
    at, kind = np.array(marks, np.int64).reshape(-1, 2).T
    low, high = np.maximum(at[kind == 1] - SIDE, 0), np.minimum(at[kind == 1], n - LENGTH)
    inside = np.zeros(n + 2, np.int64)
    np.add.at(inside, low, 1)
    np.add.at(inside, high + 1, -1)
    # windows inside one copied context are copies already
    a, b = np.maximum(at[kind == 0] - SIDE, 0), np.minimum(at[kind == 0] + LENGTH, n) - LENGTH
    known = np.zeros(n + 2, np.int64)
    np.add.at(known, a, 1)
    np.add.at(known, np.maximum(b + 1, a), -1)
    return np.flatnonzero((np.cumsum(inside) > 0) & (np.cumsum(known) <= 0))


def duplicate_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    return _result(docs, keep=False)


def without_duplicates(docs: DataFrame) -> DataFrame:
    """As duplicate_bytes, and kept: the bytes that stay."""
    return _result(docs, keep=True)


def _result(docs: DataFrame, keep: bool) -> DataFrame:
    spark = docs.sparkSession
    tidy(spark)
    scratch = Scratch(spark, "suffixes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    able = rows.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    there = able.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("rows")).first()
    total = there["bytes"] or 0
    share = SHARE if total > SMALL and there["rows"] > 100 * SHARE else 1
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of = lambda n: max(least, min(MOST, -(-n // BUCKET)))

    anchors_there = int(total * 2 / (SIDE + 2))
    wanted = max(SAMPLE, PER * of(anchors_there))
    thin = [max(1, int(x / share / wanted)) for x in (anchors_there, total)]

    def sample(batches):
        for doc, data, _ in _documents(batches):
            at, a, c = anchors(data)
            every = np.arange(len(data) - LENGTH + 1)
            for level, (place, *tokens) in enumerate(((at, a, c), (every, *windows(data, every)))):
                pick = ((place + doc * 7919).astype(np.uint64) * MIX >> np.uint64(20)) % np.uint64(thin[level]) == 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(pick.sum(), level), pa.int32()), *(pa.array(t[pick].view(np.int64)) for t in tokens), pa.array(np.full(pick.sum(), doc), pa.int64()), pa.array(place[pick], pa.int32())], ["level", "a", "c", "doc", "at"])

    # about `wanted` records of either kind, whatever the size of the corpus
    drawn = able.filter(F.crc32(F.col("doc_id").cast("string")) % share == 0).mapInArrow(sample, "level int, a bigint, c bigint, doc bigint, at int").toPandas()
    samples = []
    for level in (0, 1):
        s = drawn[drawn.level == level]
        samples.append((s.a.to_numpy().view(np.uint64), s.c.to_numpy().view(np.uint64), s.doc.to_numpy(), s["at"].to_numpy()))

    cuts = Splitters.choose(samples[0], of(anchors_there))

    def deal(batches):
        def source():
            for doc, data, _ in _documents(batches):
                at, a, c = anchors(data)
                yield a, c, np.full(len(at), doc), at.astype(np.int32)

        yield from _dealt(cuts, source())

    schema = "bucket int, records binary"
    first = scratch.put("first", _sorted(able.mapInArrow(deal, schema), cuts))
    per = lambda df: df.groupBy("doc").agg(F.collect_list(F.struct(F.col("at"), F.col("kind").cast("int").alias("kind"))).alias("marks"))

    apart = first.filter("kind = 1").count()
    seconds = Splitters.choose(samples[1], of(apart * SIDE))

    def deal_windows(batches):
        def source():
            for doc, data, marks in _documents(batches):
                at = _apart(len(data), [(m["at"], m["kind"]) for m in marks])
                if len(at):
                    a, c = windows(data, at)
                    yield a, c, np.full(len(at), doc), at.astype(np.int32)

        yield from _dealt(seconds, source())

    some = per(first.join(first.filter("kind = 1").select("doc").distinct(), "doc", "left_semi"))
    met = able.join(some.hint("shuffle_hash"), able.doc_id == some.doc).select("doc_id", "text", "marks")
    second = scratch.put("second", _sorted(met.mapInArrow(deal_windows, schema), seconds).filter("kind = 0").select("doc", "at", F.lit(2).cast("tinyint").alias("kind")))

    def finish(batches):
        for part in chunks(batches):
            out = []
            for data, marks in zip((t.encode() for t in part.column("text").to_pylist()), part.column("marks").to_pylist(), strict=True):
                gone = _covered(len(data), *np.array([(m["at"], m["kind"]) for m in marks], np.int64).T) if marks else np.zeros(len(data), bool)
                left = np.frombuffer(data, np.uint8)[~gone].tobytes() if marks else data
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left))
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns[: 4 + keep]], names[: 5 + keep])

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    marks = per(first.filter("kind = 0").unionByName(second))
    joined = rows.join(marks.hint("shuffle_hash"), rows.doc_id == marks.doc, "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep)
