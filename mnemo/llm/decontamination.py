"""Operator 7, benchmark decontamination: the q-gram lemma over overlapping diagonal bands, then banded alignment.

Texts and items are lower-cased, white space runs made one space, and compared as UTF-8 bytes. Items are cut into pieces of PIECE bytes that begin every
STEP bytes (a shorter item is one piece), so an unedited excerpt of EXCERPT = PIECE + STEP - 1 bytes or more holds a whole piece wherever it begins.
A region of a text matches a piece of length L if it is at most k = floor(ERROR * L) edits away. Each edit spoils at most q of the piece's
L - q + 1 q-grams, so a match shares at least L - q + 1 - k*q of them with the piece, and all lie on diagonals less than k + 1 apart. Therefore:
1. places whose q-gram the benchmark has are marked (a bitmap of hashes, then the exact key); a window as long as a match must have
   enough marks, or nothing in it is looked up;
2. the marks left are counted in overlapping bands of diagonals for each piece; bands with enough are regions;
3. each region is verified by semi-global alignment in a band of that width.
Items of less than SHORT bytes are too short for edits: they match where their words (runs of letters, digits and other non-ASCII bytes) follow one
another in a text, whole and in order.

Items are cut into sections of SECTION bytes that overlap by a piece, and the sections dealt by hash to blocks of about BLOCK bytes, so neither long
nor repeated items make a block large. A block's index is broadcast and takes about a hundred bytes a byte while a task holds it. Where there are several
blocks, texts first pass by a sieve: bitmaps of a fixed size of all q-grams and short items, which tell the texts that have a window with enough marks. Only
these are written, and read again for each block, so what is read and written of the corpus doesn't grow with the benchmark. They pass by one block at a
time, each in a job of its own whose result is written, so a task never holds two. There is no shuffle of texts. Tasks hold one chunk of texts; long
texts are whole; q-grams that many pieces share are looked up in slices.

Defined cases: null and empty texts match nothing, nor do null and empty items and items without a word that are shorter than SHORT; null ids pass; repeated
rows give their hits each (those of items of several sections once), repeated items one; empty tables give an empty result; of equal alignments the first is told; further columns are left aside."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mnemo.llm.common import Scratch, chunks, text_of, tidy

Q, PIECE, STEP, ERROR = 8, 64, 16, 0.08
#: The least excerpt that is found wherever it begins in a longer item.
EXCERPT = PIECE + STEP - 1
#: Items with fewer bytes are matched by their words.
SHORT = 40
#: Bytes of benchmark text in a block and in a section.
BLOCK, SECTION = 1_000_000, 50_000
#: Marks and pieces looked up at once.
SLICE = 1 << 20
#: Cells of each bitmap that stands for a benchmark of several blocks (32 MB).
CELLS = 1 << 28
#: The fewest shared q-grams that a match of any piece has, and the longest match of one.
LEAST = min(max(n - Q + 1 - int(ERROR * n + 1e-9) * Q, 1) for n in range(SHORT, PIECE + 1))
REACH = PIECE + int(ERROR * PIECE + 1e-9)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def normalised(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def qgrams(data: bytes) -> np.ndarray:
    """The q-gram at each place, its eight bytes as a number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for o in range(min(Q, n)):
        m = (n - o + Q - 1) // Q
        out[o::Q] = np.frombuffer(data, "<u8", m, o)
    return out


def _hash(grams: np.ndarray, size: int) -> np.ndarray:
    """Places in a bitmap of `size` (a power of two)."""
    return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def crowded(at: np.ndarray, need: int, reach: int) -> np.ndarray:
    """Of marks at places in order those that lie in a window of `reach` bytes with the number of marks that a match needs."""
    dense = np.zeros(len(at), int)
    if len(at) >= need:
        first = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < reach)
        np.add.at(dense, first, 1)
        np.add.at(dense, first[first + need < len(at)] + need, -1)
    return np.cumsum(dense) > 0


Section = tuple[object, int, int, bytes]  # item_id, bytes of the item, where the section begins in it, its bytes


def sections(item_id: int, text: str | None, length: int = SECTION) -> list[Section]:
    """Of an item; they overlap by a piece, so each piece of the item is in one. An item that is not much longer is one section."""
    data = normalised(text or "")
    starts = range(0, max(1, len(data) - PIECE), length)
    return [(item_id, len(data), s, data[s : s + length + PIECE]) for s in starts]


@dataclass
class Index:
    items: list[int]  # item_id of each section
    sizes: np.ndarray  # bytes of the item of each section
    short: dict[tuple[bytes, ...], list[int]]  # by their words, sections of short items
    spans: dict[bytes, list[int]]  # by the first word, how many words such items have
    texts: list[bytes]  # distinct pieces
    owners: list[list[tuple[int, int]]]  # of each piece the sections that have it, and where in the item
    budget: np.ndarray  # k of each piece
    least: np.ndarray  # shared q-grams that a match has
    grams: np.ndarray  # distinct q-grams in order
    first: np.ndarray  # of each q-gram in the two below
    piece: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def build(cls, rows: list[Section]) -> Index:
        items, sizes, pieces = [], [], {}
        short: dict[tuple[bytes, ...], list[int]] = {}
        for item_id, size, begin, data in rows:
            k = len(items)
            if size < SHORT:
                words = tuple(WORD.findall(data))
                if not words:
                    continue
                short.setdefault(words, []).append(k)
            else:
                last = max(0, len(data) - PIECE)
                for s in sorted({*range(0, last, STEP), last}):
                    pieces.setdefault(data[s : s + PIECE], []).append((k, begin + s))
            items.append(item_id)
            sizes.append(size)
        texts = list(pieces)
        length = np.array([len(t) for t in texts], int)
        budget = np.floor(ERROR * length + 1e-9).astype(int)
        each = [qgrams(t) for t in texts]
        flat = np.concatenate(each) if each else np.zeros(0, np.uint64)
        piece = np.repeat(np.arange(len(texts)), [len(g) for g in each]).astype(np.int32)
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in each]) if each else np.zeros(0, np.int32)
        order = np.argsort(flat, kind="stable")
        grams, first = np.unique(flat[order], return_index=True)
        bitmap = np.zeros(1 << max(20, (16 * len(grams)).bit_length()), bool)  # a sixteenth full at most
        bitmap[_hash(grams, len(bitmap))] = True
        spans: dict[bytes, set[int]] = {}
        for words in short:
            spans.setdefault(words[0], set()).add(len(words))
        return cls(items, np.array(sizes, int), short, {w: sorted(n) for w, n in spans.items()}, texts, list(pieces.values()), budget, np.maximum(length - Q + 1 - budget * Q, 1), grams, np.append(first, len(flat)), piece[order], place[order], bitmap)

    def whole(self, data: bytes) -> list[tuple[int, int, int, int, int]]:
        """The short items found, as hits() gives them: at each word one look for each number of words (20 at most) that items have which begin with it."""
        words, found = [(m[0], m.start(), m.end()) for m in WORD.finditer(data)], {}
        plain = tuple(w for w, *_ in words)
        for at, (word, start, _) in enumerate(words):
            for n in self.spans.get(word, ()):
                for k in self.short.get(plain[at : at + n], ()):
                    if k not in found:
                        found[k] = (k, start, words[at + n - 1][2], 0, int(self.sizes[k]))
        return [found[k] for k in sorted(found)]

    def hits(self, data: bytes) -> list[tuple[int, int, int, int, int]]:
        """section, start, end, edits, matched bytes of the item: for each section the places in data found for its pieces, joined."""
        return (self.whole(data) if self.short else []) + self.alike(data)

    def alike(self, data: bytes) -> list[tuple[int, int, int, int, int]]:
        grams = qgrams(data)
        if not len(self.grams) or len(grams) < int(self.least.min()):
            return []
        at = np.flatnonzero(self.bitmap[_hash(grams, len(self.bitmap))])
        row = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        real = self.grams[row] == grams[at]
        at, row = at[real], row[real]
        keep = crowded(at, int(self.least.min()), PIECE + int(self.budget.max()))
        at, row = at[keep], row[keep]
        if not len(at):
            return []
        n = self.first[row + 1] - self.first[row]
        ends = np.cumsum(n)
        span, pair = 2 * (len(data) + 4 * PIECE), np.zeros(0, int)
        for cut in np.split(np.arange(len(at)), np.searchsorted(ends, np.arange(SLICE, int(ends[-1]), SLICE))):
            if not len(cut):
                continue
            m = n[cut]
            source = np.repeat(self.first[row[cut]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            piece, place = self.piece[source].astype(int), self.place[source].astype(int)
            diagonal = np.repeat(at[cut], m) - place
            width = 2 * (self.budget[piece] + 1)
            low = diagonal + self.budget[piece] + PIECE  # never negative
            bands = np.concatenate((low // width * 2, (low + width // 2) // width * 2 + 1))
            key = np.concatenate((piece, piece)) * span + bands
            # distinct q-grams of the piece in a band
            pair = np.union1d(pair, key * PIECE + np.concatenate((place, place)))
        regions, count = np.unique(pair // PIECE, return_counts=True)
        enough = count >= self.least[regions // span]
        found: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for r in regions[enough].tolist():
            p, band = divmod(r, span)
            k, w = int(self.budget[p]), 2 * (int(self.budget[p]) + 1)
            d = band // 2 * w - (w // 2 if band % 2 else 0) - k - PIECE  # lowest diagonal of the band
            if hit := align(self.texts[p], data, d - k, d + w + k, k):
                s, e, edits = hit
                for item, start in self.owners[p]:
                    found.setdefault(item, []).append((s, e, edits, start, start + len(self.texts[p])))
        out = []
        for i, parts in sorted(found.items()):
            covered, upto, edits = 0, 0, {}
            for _, _, n_, a, b in sorted(parts, key=lambda p: p[3]):
                edits[a] = min(n_, edits.get(a, n_))
                covered += max(0, b - max(a, upto))
                upto = max(upto, b)
            out.append((i, min(p[0] for p in parts), max(p[1] for p in parts), max(edits.values()), covered))
        return out


def align(piece: bytes, data: bytes, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """start, end in data and edits of the best match of the whole piece on diagonals low to high (place in data less place in the
    piece), if it has at most so many edits."""
    a, n = np.frombuffer(piece, np.uint8), len(piece)
    for d in range(max(low, 0), min(high, len(data) - n) + 1):  # no edits at all
        if data.startswith(piece, d):
            return d, d + n, 0
    width = high - low + 1
    text = np.full(n + width, 256, np.int16)
    s, e = max(0, low), min(len(data), low + n + width)
    if e <= s:
        return None
    text[s - low : e - low] = np.frombuffer(data[s:e], np.uint8)
    big = 1 << 20
    at = np.arange(width)
    inside = (at + low >= 0) & (at + low <= len(data))
    cost, start = np.where(inside, 0, big), at + low  # row 0: a match may start anywhere
    for i in range(n):
        # place j in data is low + i + at; from (i, j): step to (i + 1, j + 1) keeps the diagonal, a deletion moves one left
        step = cost + (text[i : i + width] != a[i])
        up = np.append(cost[1:], big) + 1
        best = np.minimum(step, up)
        origin = np.where(step <= up, start, np.append(start[1:], 0))
        # insertions run to the right: prefix minimum of best - at
        run = np.minimum.accumulate(best - at)
        src = np.maximum.accumulate(np.where(best - at == run, at, 0))
        cost, start = run + at, origin[src]
        cost = np.where((at + low + i + 1 >= 0) & (at + low + i + 1 <= len(data)), cost, big)
    k = int(cost.argmin())
    return (int(start[k]), low + n + k, int(cost[k])) if cost[k] <= most else None


@dataclass
class Sieve:
    """Of a benchmark of any size, in bitmaps of a fixed size: which texts no block has to look at. It never refuses a text in which something is found."""

    grams: np.ndarray  # where the q-grams of longer items fall
    words: np.ndarray  # where the words of short items fall
    spans: list[int]  # how many words short items have

    @classmethod
    def of(cls, parts: DataFrame) -> Sieve:
        """parts: the sections of all items. Cells are marked by Spark; what comes to the driver has the size of the bitmaps."""

        def cells(batches):
            for batch in batches:
                kind, cell = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
                for size, data in zip(batch.column("size").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    if size < SHORT:
                        words = WORD.findall(data)
                        mine = np.array([_word_cell(words)] if words else [], np.int64)
                        kind.append(np.full(len(mine), len(words), np.int32))
                    else:
                        mine = np.unique(_hash(qgrams(data), CELLS))
                        kind.append(np.zeros(len(mine), np.int32))
                    cell.append(mine)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kind)), pa.array(np.concatenate(cell))], ["n_words", "cell"])

        made = parts.select("size", "data").mapInArrow(cells, "n_words int, cell bigint")
        at = F.col("cell") + 1
        bits = made.groupBy((F.col("n_words") > 0).alias("short"), F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"), F.collect_set("n_words").alias("spans"))
        maps, spans = np.zeros((2, CELLS // 8), np.uint8), set()
        for r in bits.toLocalIterator():
            maps[int(r["short"]), (r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
            spans |= set(r["spans"]) - {0}
        return cls(maps[0], maps[1], sorted(spans))

    def maybe(self, data: bytes) -> bool:
        at = _hash(qgrams(data), CELLS)
        marked = np.flatnonzero(self.grams[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        if crowded(marked, LEAST, REACH).any():
            return True
        words = WORD.findall(data) if self.spans else []
        for n in self.spans:
            for i in range(len(words) - n + 1):
                c = _word_cell(words[i : i + n])
                if self.words[c >> 3] >> (c & 7) & 1:
                    return True
        return False


def _word_cell(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words)) % CELLS


def _blocks(items: DataFrame, block: int) -> tuple[list[DataFrame], Sieve | None]:
    """The sections of the items, once each, dealt by hash."""

    def cut(batches):
        for batch in batches:
            rows = [x for i, t in zip(*(batch.column(c).to_pylist() for c in ("item_id", "text")), strict=True) for x in sections(i, t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, (batch.schema.field("item_id").type, pa.int64(), pa.int64(), pa.binary()), strict=True)], ["item_id", "size", "begin", "data"])

    kind = items.schema["item_id"].dataType.simpleString()
    parts = items.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, size bigint, begin bigint, data binary").distinct()
    parts = Scratch(items.sparkSession, "benchmark").put("sections", parts)
    total = parts.agg(F.sum(F.octet_length("data")).alias("n")).first()["n"] or 0
    blocks = int(total // block) + 1
    sieve = parts.sparkSession.sparkContext.broadcast(Sieve.of(parts)) if blocks > 1 else None
    return [parts.filter(F.pmod(F.xxhash64("item_id", "begin", "data"), F.lit(blocks)) == b) for b in range(blocks)], sieve


def _sieved(docs: DataFrame, sieve: Broadcast, marked: bool) -> DataFrame:
    """The rows that a block has to look at, or the others."""

    def work(batches):
        for batch in chunks(batches):
            yield batch.filter(pa.array([sieve.value.maybe(normalised(t or "")) == marked for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def _index(part: DataFrame):
    return part.sparkSession.sparkContext.broadcast(Index.build([(r.item_id, r["size"], r.begin, bytes(r.data)) for r in part.collect()]))  # bounded by the block


def matches(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start, end (bytes of the normalised text), edits (of the worst piece), coverage (matched share of the item); a row for
    each pair of a text and an item found in it."""
    spark = docs.sparkSession
    tidy(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row bigint, item_id {items.schema['item_id'].dataType.simpleString()}, start bigint, end bigint, edits bigint, matched bigint, size bigint"
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    rows = docs.select("doc_id", text_of().alias("text"))
    scratch, (parts, sieve) = Scratch(spark, "matches"), _blocks(items, block)
    rows = rows.select("doc_id", F.xxhash64("text").alias("row"), "text")
    if sieve is not None:
        rows = scratch.put("marked", _sieved(rows, sieve, True))

    for b, part in enumerate(parts):
        index = _index(part)

        def work(batches, index=index):
            tool = index.value
            for batch in chunks(batches):
                out = []
                for i, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                    out += [(i, row, tool.items[j], s, e, n, c, int(tool.sizes[j])) for j, s, e, n, c in tool.hits(normalised(text))]
                columns = zip(*out, strict=True) if out else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field("doc_id").type, pa.int64(), item_type, *[pa.int64()] * 5), strict=True)], ["doc_id", "row", "item_id", "start", "end", "edits", "matched", "size"])

        # rows of one id are told apart by their texts
        found = scratch.put(f"found-{b}", rows.mapInArrow(work, schema))
        index.destroy()
        every = every.unionByName(found) if b else found
    columns = ["doc_id", "item_id", "start", "end", "edits", (F.col("matched") / F.col("size")).alias("coverage")]
    one = F.col("size") <= SECTION + PIECE
    # sections overlap by a piece at most
    met = every.filter(~one).distinct().groupBy("doc_id", "row", "item_id", "size")
    joined = met.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("edits").alias("edits"), F.least(F.sum("matched"), F.col("size")).alias("matched"))
    return every.filter(one).select(*columns).unionByName(joined.select(*columns))


def decontaminated(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs in which no item is found, whole and unchanged."""
    spark = docs.sparkSession
    tidy(spark)
    scratch, (parts, sieve) = Scratch(spark, "decontaminated"), _blocks(items, block)
    clean = None
    if sieve is not None:
        clean, docs = _sieved(docs, sieve, False), scratch.put("marked", _sieved(docs, sieve, True))
    for b, part in enumerate(parts):
        index = _index(part)

        def work(batches, index=index):
            for batch in chunks(batches):
                yield batch.filter(pa.array([not index.value.hits(normalised(t or "")) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
        if b + 1 < len(parts):  # the last is written by who asked
            docs = scratch.put(f"left-{b}", docs)
            scratch.drop(f"left-{b - 1}")
    return docs if clean is None else clean.unionByName(docs)
