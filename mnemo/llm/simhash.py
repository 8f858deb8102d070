"""Operator 10, SimHash near-dedup with pigeonring filtering.

Words are runs outside [\\x20\\x09-\\x0D] after lower-casing A-Z, shingles three words (repeats included; fewer words: the
whole sequence). A bit of the 64-bit fingerprint is 1 if over half of the shingles' XXH64 (seed 42) have it.

Links (at most `budget` differing bits) are searched among distinct fingerprints. The 64 bits form a ring of `segments`
segments. If two fingerprints differ in at most t bits, some segment begins a chain whose first l segments differ in at most
l*t/m bits together, for every l. While that bound is below one the segments are equal, which gives the keys to join on;
the rest of the chain is checked before the full distance. Where a key has more than `crowd` fingerprints the chain goes on: with a budget of two its
next 32 bits differ in one bit at most, so one half of them is equal and one half of the other half, which gives four keys of 24 more bits (48 for
eight segments; 2**48 keys tell more fingerprints apart than any corpus has). Fingerprints crowded even there are near copies of one another: they meet
through all values one bit away, where two share a value exactly if they differ in at most two bits, and a value has 65 members at
most. The ways together find every link; the cost is linear at every size.

near_links() has a wider budget, for operators that confirm on the texts what it finds; its ring has two segments.

Defined cases: null, empty and blank texts have no shingles and fingerprint zero, linked like any other; rows with a null id
get a fingerprint, and the component of the other rows that have it, null if there are none; repeated rows each get a row; equal
fingerprints are one node; long texts are whole, their shingles taken in blocks; an empty table gives an empty result; further columns are left aside."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch, chunks, text_of, tidy
from mnemo.llm.components import components

SEED = 42
#: Shingles whose bits are spread out at once.
BLOCK = 1 << 16
#: Of near_links: bits in which a pair may differ, and how many nodes of a value all meet.
WIDE, CROWD = 8, 8


def fingerprint(text: str, width: int = 3) -> int:
    """Of one text, unsigned."""
    return int(_fingerprints([text], width)[0])


def _hashes(text: str, width: int) -> list[int]:
    import xxhash

    digest, words = xxhash.xxh64_intdigest, text.encode().lower().split()
    if len(words) < width:
        return [digest(b" ".join(words), SEED)] if words else []
    return [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(width)), strict=False)]


def _fingerprints(texts: list[str], width: int) -> np.ndarray:
    each = [_hashes(t, width) for t in texts]
    sizes = np.array([len(h) for h in each])
    return of_hashes(np.fromiter((x for h in each for x in h), "<u8", int(sizes.sum())), sizes)


def of_hashes(flat: np.ndarray, sizes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Fingerprints, unsigned, of texts with so many of the hashes each, in turn; the bits of `block` hashes are spread out at once."""
    counts = np.zeros((len(sizes), 64), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(flat), block):
        bits = np.unpackbits(flat[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + block]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        counts[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row."""
    tidy(docs.sparkSession)

    def work(batches):
        for part in chunks(batches):
            fp = _fingerprints(part.column("text").to_pylist(), width).view("<i8")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _rotate(value: Column, by: int) -> Column:
    """To the right, around the ring."""
    return value if by == 0 else F.shiftrightunsigned(value, by).bitwiseOR(F.shiftleft(value, 64 - by))


def _low(value: Column, bits: int) -> Column:
    return value if bits == 64 else value.bitwiseAND(F.lit((1 << bits) - 1))


def _quarters(ring: Column, equal: int, size: int) -> Column:
    """The four keys by which a chain goes on, for a budget of two: of the 32 bits after `equal` a half, and a half of the other half."""
    middle = F.shiftrightunsigned(ring, equal * size)
    part = lambda at, bits: _low(F.shiftrightunsigned(middle, at), bits)
    keys = []
    for half in (0, 16):
        for quarter in (0, 8):
            keys.append(F.struct(F.lit(half + quarter).alias("j"), F.shiftleft(part(half, 16), 8).bitwiseOR(part(16 - half + quarter, 8)).alias("more")))
    return F.explode(F.array(*keys))


def links(nodes: DataFrame, scratch: Scratch, budget: int = 2, segments: int = 8, crowd: int = 64) -> DataFrame:
    """u, v: nodes (columns node, fp; one row per fp) that differ in at most `budget` bits; for keys that stay crowded, pairs that
    connect the same nodes. The budget is 2 at most."""
    if 64 % segments or budget >= segments or budget > 2:
        raise ValueError("segments must divide 64 and exceed the budget, which is 2 at most")
    size = 64 // segments
    equal = (segments - 1) // budget if budget else segments  # segments of a chain that must be equal: l * budget < segments
    turned = F.explode(F.array([F.struct(F.lit(i).alias("i"), _rotate(F.col("fp"), i * size).alias("ring")) for i in range(segments)]))
    keyed = nodes.select("node", turned.alias("x")).select("node", "x.i", "x.ring", _low(F.col("x.ring"), equal * size).alias("key"))
    apart = F.col("ring").bitwiseXOR(F.col("turn"))
    chain = F.lit(True)
    for n in range(equal + 1, segments + 1):
        chain &= F.bit_count(_low(apart, n * size)) <= n * budget // segments

    def paired(rows: DataFrame, key: list[str], name: str) -> tuple[DataFrame, DataFrame]:
        """Links inside keys of few rows, and the rows of the others."""
        sizes = scratch.put(name, rows.groupBy(*key).count().filter("count > 1"))
        few, many = (sizes.filter(f"count {op} {crowd}").select(*key) for op in ("<=", ">"))
        a = rows.join(few, key, "left_semi")
        b = a.select(*key, F.col("node").alias("other"), F.col("ring").alias("turn"))
        near = a.join(b, key).filter((F.col("node") < F.col("other")) & chain).select(F.col("node").alias("u"), F.col("other").alias("v"))
        return near, rows.join(many, key, "left_semi")

    near, hot = paired(keyed, ["i", "key"], "keys")
    if budget == 2:
        hot = scratch.put("crowded", hot)
        more, hot = paired(hot.select("*", _quarters(F.col("ring"), equal, size).alias("y")).select("node", "i", "ring", "key", "y.*"), ["i", "key", "j", "more"], "longer-keys")
        near = near.unionByName(more)
    back = F.coalesce(*[F.when(F.col("i") == i, _rotate(F.col("ring"), (64 - i * size) % 64)) for i in range(segments)])
    hot = scratch.put("hot", hot.select("node", back.alias("fp")).distinct())
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)])
    met = hot.select("node", F.explode(around).alias("value"), *["fp"] * (budget == 1)).groupBy("value")
    every = F.sort_array(F.collect_set("node")).alias("all")  # 65 at most
    if budget == 1:  # one bit: both share the value that is one of them
        star = met.agg(every, F.max(F.when(F.col("fp") == F.col("value"), F.col("node"))).alias("u")).filter("u IS NOT NULL")
    else:
        star = met.agg(every).withColumn("u", F.col("all")[0])
    return near.unionByName(star.filter(F.size("all") > 1).select("u", F.explode("all").alias("v")).filter("u <> v")) if budget else near


def near_links(nodes: DataFrame, scratch: Scratch, budget: int = WIDE, crowd: int = CROWD) -> DataFrame:
    """u, v: pairs of nodes (columns node, fp; several may have one fp) that differ in at most `budget` bits: all those up to five bits, and of the others
    those of which a half differs in two at most.

    On a ring of two segments, a chain of fingerprints t bits apart begins with a half that differs in t/2 bits at most, two for a budget of five. Two halves
    are that near exactly if they share a value one bit away from both, so each half is dealt out under 33 values of 32 bits. Where more than `crowd` nodes have a value they
    don't all meet: each meets the least node of its crowded values that is nearest, so rows grow with the nodes. The caller needs an exact way for what is left."""
    half = [F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)]
    values = [half[i].bitwiseXOR(F.lit(flip).cast("bigint")) + F.lit(i << 32) for i in (0, 1) for flip in (0, *(1 << b for b in range(32)))]
    # a few bytes of a node become 66 rows, so they are dealt out first
    dealt = nodes.select("node", "fp").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    keyed = dealt.select("node", "fp", F.explode(F.array(*values)).alias("key"))
    sizes = scratch.put("sizes", keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1"))
    met = scratch.put("values", keyed.join(sizes.hint("merge"), "key"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("turn")))
    few, hot = met.filter(F.col("n") <= crowd), met.filter(F.col("n") > crowd)
    other = few.select("key", F.col("node").alias("other"), F.col("fp").alias("turn"))
    near = few.join(other.hint("merge"), "key").filter((F.col("node") < F.col("other")) & (apart <= budget))
    least = hot.filter("node = least").select("key", F.col("fp").alias("turn")).distinct()
    tried = hot.filter("node <> least").join(least.hint("merge"), "key").filter(apart <= budget)
    nearest = tried.groupBy("node").agg(F.min(F.struct(apart.alias("apart"), F.col("least").alias("v"))).alias("x"))
    pairs = near.select(F.col("node").alias("u"), F.col("other").alias("v")).unionByName(nearest.select(F.least("node", "x.v").alias("u"), F.greatest("node", "x.v").alias("v")))
    pairs = scratch.put("near-links", pairs.distinct())
    scratch.drop("sizes", "values")
    return pairs


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2, segments: int = 8, crowd: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable over links) for every row."""
    spark = docs.sparkSession
    tidy(spark)
    scratch = Scratch(spark, "simhash")
    found = scratch.put("prints", fingerprints(docs, width))
    nodes = scratch.put("nodes", found.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node IS NOT NULL"))
    joined = components(links(nodes, scratch, budget, segments, crowd), scratch)
    named = nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return found.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the smallest id, and rows with a null id. An id that several
    texts have goes only if each of them is a near copy of a smaller id."""
    found = near_duplicates(docs, width, budget).groupBy(F.col("doc_id").alias("_gone"))
    gone = found.agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("_all")).filter("_all").select("_gone")
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["_gone"], "left_anti")
