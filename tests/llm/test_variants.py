"""Spelling variants against brute force and SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from mnemo.llm import variants

from .conftest import SF


def brute(rows):
    """rows: doc_id, text (None: null)."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by_rest = {}
    for w in known:
        for i in range(len(w)):
            by_rest.setdefault(w[:i] + w[i + 1 :], set()).add((i, w))
    near = {w: set() for w in known}
    for rest, group in by_rest.items():
        for i, w in group:
            near[w] |= {v for j, v in group if j == i and v != w}
            if rest in known:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best is not None and known[best] >= 2 * known[w] else None
    out = {}
    for w, n in known.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), known[form[w]] if form[w] else None)
    return out


def found(docs):
    rows = variants.variants(docs).collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def edits(spark):
    """Chains of variants, anagrams, ties, letters beyond ASCII, and long words."""
    rng, rows = random.Random(2), []
    for _ in range(60):
        word = "".join(rng.choices("abcdeéßÿ", k=rng.choice((5, 6, 9, 14))))
        for _ in range(9):
            rows.append(" ".join([word] * rng.choice((3, 3, 4, 7, 20, 100))))
            at, letter = rng.randrange(len(word)), rng.choice("abcdeéßÀ")
            word = rng.choice((word[:at] + letter + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + word[at + 1 :] or word, "".join(rng.sample(word, len(word)))))
    rows += [" ".join("".join(p) for p in __import__("itertools").permutations("abcde")) for _ in range(4)] + ["x" * 3000 + " "] * 3 + ["x" * 3001 + " "] * 8 + ["ÀÉ×÷ÿ àé×÷ÿ"] * 3
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")


@pytest.mark.parametrize("which", ["documents", "edits", "odd", "empty"])
def test_equals_brute_force(which, spark, request):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if which == "documents" else edits(spark) if which == "edits" else request.getfixturevalue(which)
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = [c[0] for c in con.execute(variants.ORACLE).description]
    rows = [dict(zip(names, r, strict=True)) for r in con.execute(variants.ORACLE).fetchall()]
    assert {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in rows} == found(spark.read.parquet(f"{SF}/documents.parquet"))


def test_every_single_edit_meets_in_a_slot():
    rng = random.Random(4)
    for _ in range(2000):
        word = "".join(rng.choices("abcé", k=rng.randrange(1, 9)))
        at, letter = rng.randrange(len(word) + 1), rng.choice("abcéx")
        for other in (word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]):
            if other != word:
                mine = dict.fromkeys(variants.slots(word))
                theirs = {}
                for slot, c in variants.slots(other):
                    theirs.setdefault(slot, set()).add(c)
                assert any(theirs.get(slot, {c}) - {c} for slot, c in mine), (word, other)


def test_rows_of_a_word_grow_with_its_length():
    assert all(len(list(variants.slots(w))) <= 2 * len(w) + 2 for w in ("a", "abcde", "z" * 50, "abcdefghijklmnopqrstuvwxyz"))
