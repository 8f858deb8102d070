import random
import re

import duckdb
import pytest

from mnemo.llm import decontamination, licenses, pii

from .conftest import SF, texts


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    r = random.Random(3)
    bits = ["a@b.c", "@", "x.y@z", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "+1 (171) 555-2028", "+49", "1", ".", " ", "-", "é", "a@@b.c.", "4111111111111112", "%", "(0)", "0010.001.1.1"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
        assert pii.base_spans(t) == brute_spans(t), t


@pytest.mark.parametrize("which", ["sample", "odd", "empty"])
def test_pii_query(which, request):
    docs = request.getfixturevalue(which)
    import hashlib

    want = []
    for i, t in texts(docs):
        b = brute_spans(t)
        want.append((i, *[sum(k == kind for k, *_ in b) for kind in pii.KINDS], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()))
    got = pii.find(docs).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    base = {r[0]: r for r in want}
    for r in got:
        for k, s, e in brute_spans(dict(texts(docs)).get(r.doc_id, "")) if r.doc_id in base else []:
            assert r.doc_id is None or f"{k}:{s}:{e}" in r.spans


def test_trees_add_secrets_and_written_out_addresses():
    tool = pii.trained()
    text = 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and write to bob (at) example (dot) com about the therewithallandmoreofit 7'
    found = [(k, text[s:e]) for k, s, e in tool.choose(text, pii.base_spans(text))]
    assert found == [("email", "bob (at) example (dot) com"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    # neither a digit elsewhere nor the length matters
    for secret in ("aQzXkLmNpRsTuVwYbCdEfGhJ", "a1B2c3D4" * 26, "a1B2c3D4" * 50):
        for lead in ("", "7 "):
            text = f'{lead}token = "{secret}"'
            assert [(k, text[s:e]) for k, s, e in tool.choose(text, [])] == [("secret", secret)], text


def test_recall_and_precision_of_added_spans():
    """On texts from another generator than the one the trees were fitted to."""
    r = random.Random(21)
    words = "when then some more about river stone their house bright over under seven paper quite never always Straße élan".split()
    prose = lambda: " ".join(r.choice(words) for _ in range(r.randint(3, 12)))
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    name = lambda: pick("bcdfghklmnprst", 1) + pick("aeiou", 1) + pick("bcdlmnrst", 2) + pick("aeiou", 1)
    b64 = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    good = [
        lambda: f"{name()}.{name()} at {name()} dot org", lambda: f"{name()} (at) {name()} (dot) net", lambda: f"{name()}[at]{name()}[dot]com",
        lambda: pick(b64, 32), lambda: pick("0123456789abcdef", 40), lambda: "ghp_" + pick(b64, 36),
    ]
    bad = [lambda: "-".join(name() for _ in range(5)), lambda: "/".join(name() for _ in range(6)), lambda: "-" * r.randint(16, 80), lambda: f"{name()} at {name()}. {name()}", lambda: "".join(name() for _ in range(5))]
    tool, hit, wrong, n = pii.trained(), 0, 0, 400
    for k in range(n):
        span = r.choice(good)() if k % 2 else r.choice(bad)()
        lead = prose() + (r.choice([" token: ", " key=", " "]) if k % 2 else " ")
        text = lead + span + ", " + prose()
        found = {(s, e) for _, s, e in tool.choose(text, pii.base_spans(text))}
        hit += k % 2 and (len(lead), len(lead) + len(span)) in found
        wrong += not k % 2 and bool(found)
    assert hit >= 0.9 * n / 2 and wrong <= 0.1 * hit, (hit, wrong)


def test_planted_secrets_are_found():
    import pandas as pd

    tool, hit, every = pii.trained(), 0, 0
    for text in pd.read_parquet("/root/testdata/sf0.1/documents.parquet").text.dropna():
        planted = [m.span(1) for m in re.finditer('token = "([0-9a-f]{40})"', text)]
        if planted:
            found = {(s, e) for k, s, e in tool.choose(text, pii.base_spans(text)) if k == "secret"}
            hit, every = hit + sum(p in found for p in planted), every + len(planted)
    assert every > 100 and hit >= 0.9 * every


def test_many_spans_take_linear_time():
    import time

    took = []
    for n in (4000, 32000):
        text = "+1 (171) 555-2028 " * n
        began = time.perf_counter()
        assert len(pii.trained().choose(text, pii.base_spans(text))) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]
    assert pii.redact("a b@c.de f", [("email", 2, 8)]) == "a [email] f"


def test_spans_stay_linear():
    assert pii.base_spans("1" * 300_000 + ("a" * 50_000 + "@ ") * 5 + "2.3." * 3 + "x" * 300_000) == [("ip", 550_010, 550_017)]


@pytest.mark.parametrize("which", ["sample", "odd", "empty"])
def test_licenses(which, request):
    docs = request.getfixturevalue(which)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    columns = "doc_id", "license", "dice", "n_matches", "licenses"
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({licenses.ORACLE})").fetchall()
    norm = lambda rows: sorted(((None if a is None or a != a else int(a), b, c, d, e) for a, b, c, d, e in rows), key=str)
    assert norm(tuple(r) for r in licenses.scan(docs).select(*columns).collect()) == norm(want)


def test_licenses_of_repeated_notices(spark):
    notice = "Released under the MIT License."
    rows = [(1, " ".join([notice] * 60)), (2, "\n".join([notice] * 60)), (3, "plain text " * 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    columns = "doc_id", "license", "dice", "n_matches", "licenses"
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({licenses.ORACLE}) ORDER BY doc_id").fetchall()
    got = [tuple(r) for r in licenses.scan(docs).select(*columns).orderBy("doc_id").collect()]
    assert got == want
    assert got[0][1] == "MIT" and got[1][3] > 60 and got[2][1] is None


def test_license_of_a_bare_reservation(spark):
    rows = [(1, "a text\nAll rights reserved.\nmore of it"), (2, "all rights of way are reserved for walkers")]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "proprietary", 2: None}


def test_license_paragraphs(spark):
    split = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License."
    rows = [(1, "intro\n\n" + split + "\n\nmore"), (2, "Licensed under CC BY-NC 4.0."), (3, "released under no licence at all")]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "Apache-2.0", 2: "CC-BY-NC-4.0", 3: None}


def edits(a, b):
    """Fewest edits of a to some substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_is_exact():
    r = random.Random(5)
    for _ in range(300):
        a = bytes(r.choice(b"abc ") for _ in range(r.randint(1, 30)))
        b = bytearray(bytes(r.choice(b"abc ") for _ in range(r.randint(0, 20))) + a + bytes(r.choice(b"abc ") for _ in range(r.randint(0, 20))))
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(b))
            b[k : k + r.randint(0, 2)] = bytes(r.choice(b"xyz") for _ in range(r.randint(0, 2)))
        want = edits(a, bytes(b))
        got = decontamination.align(a, bytes(b), -len(a), len(b), len(a))
        assert got is not None and got[2] == want
        assert edits(a, bytes(b)[got[0] : got[1]]) == want


def test_decontamination_finds_edited_passages(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["an", "the", "re", "ti", "on", "ou", "é"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(30)) for i in range(12)]
    docs, want = [], set()
    for i in range(80):
        t = prose(r.randint(0, 200))
        if i % 2:
            j = r.randrange(12)
            p = list(items[j][1])
            for _ in range(r.randint(0, int(0.03 * len(p)))):
                p[r.randrange(len(p))] = "x"
            t = t + " " + "".join(p).upper().replace(" ", "\n") + " " + prose(20)
            want.add((i, j))
        docs.append((i, t))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in decontamination.matches(d, b).collect()} == want
    # the benchmark in several blocks gives the same
    assert {(x.doc_id, x.item_id) for x in decontamination.matches(d, b, block=700).collect()} == want
    assert {x.doc_id for x in decontamination.decontaminated(d, b, block=700).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_region_filter_loses_nothing():
    """Every piece within its budget of some substring is found: the lemma, the windows and the bands against brute force."""
    r = random.Random(2)
    for _ in range(60):
        item = "".join(r.choice("ab") for _ in range(r.randint(40, 70)))  # two letters: q-grams repeat much
        index = decontamination.Index.build(decontamination.sections(1, item))
        t = list(item)
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(t))
            t[k : k + r.randint(0, 1)] = [r.choice("ab")] * r.randint(0, 1)
        text = ("".join(r.choice("ab") for _ in range(50)) + "".join(t) + "".join(r.choice("ab") for _ in range(50))).encode()
        assert bool(index.hits(text)) == any(edits(p, text) <= k for p, k in zip(index.texts, index.budget, strict=True))


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_decontamination_of_odd_rows(which, spark, request):
    docs = request.getfixturevalue(which)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, "plain words of a text that goes on for more than one hundred bytes")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, items).collect()}
    assert got == {(i, None) for i, t in texts(docs) if b"plain words of a text that goes on" in decontamination.normalised(t)}
    clean = decontamination.decontaminated(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, t in texts(docs) if "plain" not in t.lower()}
    assert decontamination.matches(docs, items.filter("false")).count() == 0


def test_every_excerpt_is_found(spark):
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))
    item = prose(60)
    n = decontamination.EXCERPT
    docs = [(s, f"{prose(20)} {item[s : s + n]} {prose(20)}") for s in range(0, len(item) - n, 3)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert {x.doc_id for x in decontamination.matches(d, b).collect()} == {i for i, _ in docs}


def test_short_items_match_whole_words(spark):
    items = [(1, "The cat sat."), (2, "of"), (3, "!?"), (4, "x" * 39), (5, "é")]
    docs = [(1, "see: THE cat\nsat there"), (2, "the cat satin"), (3, "off of it"), (4, "!?"), (5, "x" * 40), (6, "a " + "x" * 39), (7, "café É")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in decontamination.matches(d, b).collect()} == {(1, 1), (3, 2), (6, 4), (7, 5)}
    assert {x.doc_id for x in decontamination.decontaminated(d, b).collect()} == {2, 4, 5}


def test_sections_of_long_items_join_up(spark, monkeypatch):
    r = random.Random(8)
    item = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(400))
    monkeypatch.setattr(decontamination, "sections", lambda i, t, cut=decontamination.sections: cut(i, t, 300))
    monkeypatch.setattr(decontamination, "SECTION", 300)
    d = spark.createDataFrame([(1, "head " + item + " tail"), (2, item[500:900]), (3, "none of it")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, item), (1, item)], "item_id bigint, text string")
    for block in (600, 1_000_000):
        got = {x.doc_id: x for x in decontamination.matches(d, b, block=block).collect()}
        assert set(got) == {1, 2} and (got[1].start, got[1].end, got[1].edits, got[1].coverage) == (5, 5 + len(item), 0, 1.0) and got[2].coverage < 0.3


def test_a_gram_that_everything_shares():
    index = decontamination.Index.build(decontamination.sections(1, "ab" * 400))
    assert [h[0] for h in index.hits(b"ab" * 600)] == [0] and index.hits(b"ba cd" * 100) == []


def test_benchmark_passages_of_the_sample(spark, sample):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    norm = [(r.item_id, decontamination.normalised(r.text)) for r in items.collect()]
    want = {(i, j) for i, t in texts(sample) for j, b in norm if b in decontamination.normalised(t)}
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(sample, items).collect()} >= want


def test_the_email_gate_passes_every_proposal():
    rng = random.Random(6)
    for n in (1, 40, 61, 62, 63):
        for dot in (".", " (dot) ", "(dot)", " [dot]", " dot "):
            text = f"bob at {'h' * n}{dot}com"
            assert [m for p in pii.PROPOSE["email"] for m in p.finditer(text)] and pii.HINT["email"].search(text), text
    parts = ["bob", " at ", "@", "(at)", " ", "host", ".", " dot ", "(dot)", "[dot]", "com", "x" * 63, "\n"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randrange(3, 9)))
        if any(p.search(text) for p in pii.PROPOSE["email"]):
            assert pii.HINT["email"].search(text), text


def test_items_may_have_text_ids(spark):
    docs = spark.createDataFrame([("d1", "see the quick brown fox here"), ("d2", "nothing")], "doc_id string, text string")
    items = spark.createDataFrame([("i-1", "quick brown fox")], "item_id string, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.matches(docs, items).collect()] == [("d1", "i-1")]
    assert [r.doc_id for r in decontamination.decontaminated(docs, items).collect()] == ["d2"]


def test_short_items_with_one_first_word_are_looked_up_by_their_words():
    index = decontamination.Index.build([(i, 20, 0, f"the {i} of".encode()) for i in range(3000)])
    assert index.spans == {b"the": [3]} and len(index.short) == 3000
    assert [k for k, *_ in index.whole(b"at the 7 of the 7 of the 9 x")] == [7]


def test_blocks_look_at_marked_texts_only(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 9)))
    items = [(i, " ".join(word() for _ in range(60))) for i in range(20)] + [(100 + i, f"{word()} {word()} {word()}") for i in range(10)]
    docs = [(i, " ".join(word() for _ in range(80)) + (" " + items[i][1][20:200] if i < 10 else "") + (" " + items[20 + i % 10][1] if 10 <= i < 15 else "")) for i in range(200)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one, many = ({tuple(r) for r in decontamination.matches(d, b, block=n).collect()} for n in (10**6, 800))
    assert one == many and {r[0] for r in one} == set(range(15))
    assert {r.doc_id for r in decontamination.decontaminated(d, b, block=800).collect()} == set(range(15, 200))
    parts, sieve = decontamination._blocks(b, 800)
    assert len(parts) > 5 and decontamination._sieved(d, sieve, True).count() == 15
