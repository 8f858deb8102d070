import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mnemo.llm import components, exact_dedup, simhash, suffixes
from mnemo.llm.common import Scratch

from .conftest import texts


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    out = []
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["sample", "odd", "empty"])
def test_exact_groups(which, request):
    docs = request.getfixturevalue(which)
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(docs).collect()), key=str)
    assert got == brute_exact(texts(docs))


def test_colliding_hashes_are_told_apart(odd):
    got = exact_dedup.exact_groups(odd, digest=F.unhex(F.lit("00")))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_exact(texts(odd))


def test_exact_dedup_keeps_one_row_of_each_text(odd):
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    want = {(i, norm(t)) for i, t in texts(odd)} & {(keep, norm(t)) for (_, t), keep in zip(texts(odd), [{sha: k for _, k, _, _, sha in brute_exact(texts(odd))}[hashlib.sha256(norm(t).encode()).hexdigest()] for _, t in texts(odd)], strict=True)}
    got = [(i, norm(t)) for i, t in texts(kept)]
    assert sorted(got, key=str) == sorted(want, key=str) and len({t for _, t in got}) == len(got)


def brute_suffixes(rows):
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None}):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i, t] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return sorted(((i, *out.get((i, t), (len(t.encode()), 0, 0, hashlib.sha256(t.encode()).hexdigest()))) for i, t in rows), key=str)


@pytest.mark.parametrize("which", ["sample", "odd", "empty"])
def test_suffixes(which, request):
    docs = request.getfixturevalue(which)
    assert sorted((tuple(r) for r in suffixes.duplicate_bytes(docs).collect()), key=str) == brute_suffixes(texts(docs))


@pytest.mark.parametrize("seed", range(3))
def test_suffixes_on_copies_that_differ(spark, seed):
    r = random.Random(seed)
    base = "".join(r.choice("ab cd") for _ in range(400))
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice("xyz")
        rows.append((i, "".join(t[r.randint(0, 150) :]) + "".join(r.choice("pq ") for _ in range(r.randint(0, 200))) + base[: r.randint(0, 300)]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(x) for x in suffixes.duplicate_bytes(docs).collect()), key=str) == brute_suffixes(rows)


def test_buckets_cut_inside_a_run():
    n = 1000
    rng = np.random.default_rng(0)
    a, c = rng.integers(0, 3, n).astype(np.uint64), rng.integers(0, 2, n).astype(np.uint64)
    records = a, c, np.arange(n), np.zeros(n, np.int32)
    cuts = suffixes.Splitters.choose(records, 16)
    bucket = cuts.bucket(records)
    marked = set()
    for b in range(len(cuts.a) + 1):
        own = bucket == b
        doc, _, kind = suffixes.mark(tuple(x[own] for x in records), b, cuts)
        marked |= {int(d) for d, k in zip(doc, kind, strict=True) if k == 0}
    first = {}
    for i in range(n):
        first.setdefault((a[i], c[i]), i)
    assert marked == set(range(n)) - set(first.values())


def test_stretches_of_long_texts_join_up(monkeypatch):
    r = random.Random(4)
    data = "".join(r.choice("abc ") for _ in range(6000)).encode()
    whole = suffixes.anchors(data), suffixes.windows(data, np.arange(0, 5901, 7))
    monkeypatch.setattr(suffixes, "STRETCH", 700)
    parts = suffixes.anchors(data), suffixes.windows(data, np.arange(0, 5901, 7))
    assert all((a == b).all() for w, p in zip(whole, parts, strict=True) for a, b in zip(w, p, strict=True))


def test_multikey_order():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 4, 500) for _ in range(4)]
    order = suffixes.multikey_order(*columns)
    assert sorted(zip(*columns, strict=True)) == [tuple(c[i] for c in columns) for i in order]


def brute_simhash(rows, width=3, budget=2):
    prints = []
    for _, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
        shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [i for i in range(len(rows)) if rows[i][0] is not None]
    for i in known:
        for j in known:
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                parent[root(i)] = root(j)
    least = {}
    for i in known:
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    by_print = {prints[i]: least[root(i)] for i in known}
    return sorted(((i, format(p, "016x"), by_print.get(p)) for (i, _), p in zip(rows, prints, strict=True)), key=str)


@pytest.mark.parametrize("which", ["sample", "odd", "empty"])
@pytest.mark.parametrize("crowd", [64, 1])
def test_simhash(which, crowd, request):
    docs = request.getfixturevalue(which)
    got = simhash.near_duplicates(docs, crowd=crowd)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_simhash(texts(docs))


@pytest.mark.parametrize(("segments", "crowd", "budget"), [(4, 64, 2), (8, 64, 2), (16, 64, 2), (8, 1, 2), (8, 1, 1), (8, 64, 0), (8, 1, 0)])
def test_links_lose_none(spark, segments, crowd, budget):
    r = random.Random(segments)
    prints = {r.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for p in list(prints):
        for _ in range(4):
            q = p
            for _ in range(r.randint(0, 3)):
                q ^= 1 << r.randrange(64)
            prints.add(q)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    nodes = spark.createDataFrame(rows, "node bigint, fp bigint")
    found = {(x.u, x.v) for x in simhash.links(nodes, Scratch(spark, "t"), budget, segments, crowd).collect()}
    want = {(i, j) for i, p in rows for j, q in rows if i < j and ((p ^ q) & (1 << 64) - 1).bit_count() <= budget}
    if crowd == 64:
        assert found == want
    groups = lambda links: sorted((x.node, x.component) for x in components.components(spark.createDataFrame(sorted(links), "u bigint, v bigint"), Scratch(spark, "t")).collect())
    assert groups(found) == groups(want)


def test_crowded_keys_chain_on(spark):
    """Many fingerprints share the first key; the longer keys tell them apart or, crowded too, the values one bit away do."""
    r = random.Random(17)
    low = r.getrandbits(24)
    prints = {r.getrandbits(40) << 24 | low for _ in range(300)}
    prints |= {p ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for p in list(prints)[:100]}
    centre = r.getrandbits(64)
    prints |= {centre ^ 1 << a ^ 1 << b for a in range(0, 64, 3) for b in range(1, 64, 5)}
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    nodes = spark.createDataFrame(rows, "node bigint, fp bigint")
    want = {(i, j) for i, p in rows for j, q in rows if i < j and ((p ^ q) & (1 << 64) - 1).bit_count() <= 2}
    groups = lambda links: sorted((x.node, x.component) for x in components.components(spark.createDataFrame(sorted(links), "u bigint, v bigint"), Scratch(spark, "t")).collect())
    for segments in (4, 8, 16):
        found = {(x.u, x.v) for x in simhash.links(nodes, Scratch(spark, "t"), 2, segments).collect()}
        assert groups(found) == groups(want)


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    got = components.components(edges, Scratch(spark, "t"))
    assert got.count() == 300 and got.agg(F.max("component")).first()[0] == 0


def test_near_dedup_keeps_one_of_each(odd):
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns
    want = {i for i, _, c in brute_simhash(texts(odd)) if i == c or i is None}
    assert {r.doc_id for r in kept.collect()} == want


def test_an_id_of_two_texts_is_no_near_copy(spark):
    rows = [(1, "one two three four"), (5, "one two three four"), (5, "quite another text of words"), (7, "one two three four"), (7, "one two three four")]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(texts(kept)) == sorted(rows[:3])
