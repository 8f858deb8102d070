"""The near-duplicate stage against brute force over sets of five-word shingles."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemo.llm import near_copies, simhash
from mnemo.llm.common import Scratch

from .conftest import SF, texts


def brute_near(rows):
    """Ids that stay."""
    sets = []
    for _, text in rows:
        words = text.encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [i for i in range(len(rows)) if rows[i][0] is not None]
    for i in known:
        for j in known:
            if j < i and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0):
                parent[root(i)] = root(j)
    least = {}
    for i in known:
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return {rows[i][0] for i in known if least[root(i)] == rows[i][0]} | {r[0] for r in rows if r[0] is None}


def stage(docs):
    return dict(corpus_pipeline.STAGES)["simhash_near_dedup"](docs.sparkSession, docs, SF)


def edited(spark):
    """Copies with more and more words replaced, long and short, and a line that many texts have."""
    rng, rows = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(500)]
    for base in range(12):
        text = rng.choices(vocabulary, k=rng.choice((4, 8, 30, 200, 900))) + "this line is in all of the texts and tells nothing".split()
        for edits in range(8):
            words = list(text)
            for _ in range(edits * max(1, len(text) // 150)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((base + 100 * edits, " ".join(words), base))
    return spark.createDataFrame(rows, "doc_id bigint, text string, n int")


@pytest.mark.parametrize("which", ["documents", "edited", "odd", "empty"])
def test_stage_keeps_one_of_all_near_copies(which, spark, request):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if which == "documents" else edited(spark) if which == "edited" else request.getfixturevalue(which)
    kept = stage(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == brute_near(texts(docs))


def test_an_id_of_two_texts_stays_if_one_is_no_copy(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, long), (5, long + " end"), (5, "quite another text of words"), (7, long + " close")]
    assert sorted(texts(stage(spark.createDataFrame(rows, "doc_id bigint, text string")))) == sorted(rows[:3])


def test_texts_that_share_a_line_do_not_meet_in_it(spark, monkeypatch):
    """Twice the texts with one line in common give about twice the rows that meet in a key, not four times."""
    monkeypatch.setattr(near_copies, "SAMPLE", 40)
    line = " ".join(f"common{i}" for i in range(30))

    def met(n):
        rng = random.Random(n)
        # every tenth text has the line, and is like none of the others
        rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) + (" " + line if i % 10 == 0 else "")) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        keys = near_copies.prefixes(docs, near_copies.frequent(docs)).select(F.explode("keys").alias("key")).groupBy("key").count()
        return keys.filter("count > 1").agg(F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0))).first()[0], docs

    some, _ = met(2000)
    more, docs = met(4000)
    assert more <= 2 * some + 1000 and more < 10_000  # 160,000 and more by key if the line's shingles were keys
    assert near_copies.near_dedup(docs).count() == 4000


def test_ids_may_be_text(spark):
    long = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([("a", long), ("b", long + " end"), ("c", "other")], "doc_id string, text string")
    assert sorted(r.doc_id for r in near_copies.near_dedup(docs).collect()) == ["a", "c"]
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()} >= {("c", "c")}


def near_pairs(texts):
    """Index pairs with five-word Jaccard coefficients of 0.8 or more."""
    sets = [{tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} for words in (t.split() for t in texts)]
    return {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a != b and 5 * len(a & b) >= 4 * len(a | b)}


def copies(n):
    """n texts and two edited copies of each, near and less near."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    for _ in range(n):
        text = rng.choices(vocabulary, k=rng.randrange(60, 600))
        yield " ".join(text)
        for share in (100, 50):
            words = list(text)
            for _ in range(max(1, len(words) // share)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            yield " ".join(words)


def test_simhash_alone_finds_nine_tenths_and_the_rest_comes_exactly(spark, monkeypatch):
    """The stage goes through SimHash: without the pass by prefixes it still joins most near copies, and that pass adds all others."""
    rows = list(enumerate(copies(60)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = near_pairs([t for _, t in rows])
    found = near_copies.prefixes(docs, near_copies.frequent(docs)).select(F.col("doc_id").alias("node"), "fp")
    got = {(r.u, r.v) for r in simhash.near_links(found, Scratch(spark, "t")).collect()}
    assert len(want) > 100 and len(want & got) >= 0.9 * len(want)
    seen = []
    real = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda nodes, scratch: seen.append(1) or real(nodes, scratch))
    assert {r.doc_id for r in stage(docs).collect()} == brute_near(rows)
    assert seen
    # no keys: nothing but SimHash can join texts
    whole = near_copies.prefixes
    monkeypatch.setattr(near_copies, "prefixes", lambda *a: whole(*a).withColumn("keys", F.expr("cast(array() as array<bigint>)")))
    alone = {r.doc_id for r in stage(docs).collect()}
    assert alone >= brute_near(rows) and len(rows) - len(alone) >= 0.9 * (len(rows) - len(brute_near(rows)))
    # no links by SimHash: nothing is lost
    monkeypatch.undo()
    monkeypatch.setattr(simhash, "near_links", lambda nodes, scratch: real(nodes, scratch, -1))
    assert {r.doc_id for r in stage(docs).collect()} == brute_near(rows)


def test_what_crowded_values_leave_out_comes_by_prefixes(spark):
    """Sixty texts of the same words, so of one fingerprint: by bits each meets one other, and still each is joined to its own near copy and to no other."""
    rng, words, rows = random.Random(8), [f"w{i}" for i in range(60)], []
    for i in range(30):
        rng.shuffle(words)
        rows += [(i, " ".join(words)), (100 + i, " ".join([*words[:-2], words[-1], words[-2]]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = near_copies.prefixes(docs, near_copies.frequent(docs)).select(F.col("doc_id").alias("node"), "fp")
    got = {(r.u, r.v) for r in simhash.near_links(found, Scratch(spark, "t")).collect()}
    assert len(got & {(i, 100 + i) for i in range(30)}) <= 1
    assert {r.doc_id for r in stage(docs).collect()} == brute_near(rows) == set(range(30))


def test_wide_links_find_all_of_five_bits(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    for p in list(prints):
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(0, 9)):
                p ^= 1 << b
            prints.append(p)

    def found(prints, crowd):
        rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
        got = [(r.u, r.v) for r in simhash.near_links(spark.createDataFrame(rows, "node bigint, fp bigint"), Scratch(spark, "t"), crowd=crowd).collect()]
        assert len(got) == len(set(got)) and all((prints[i] ^ prints[j]).bit_count() <= 8 for i, j in got)
        return set(got)

    far = {(i, j): (prints[i] ^ prints[j]).bit_count() for j in range(len(prints)) for i in range(j)}
    assert {pair for pair, bits in far.items() if bits <= 5} <= found(prints, 1000)
    # many of one value meet in one of them
    same = [prints[0]] * 100
    assert found(same, 16) == {(0, i) for i in range(1, 100)}
