"""Operator 12, spelling variants by anagram hashing.

The key of a word is the sum of its letters' code points, each to the fifth power. Two words that differ by one letter added, removed or exchanged
have keys that differ by one letter's power, or by that of one letter less that of another; so either key, less the power of some letter of the word
or less nothing, meets the other key, less that of another letter or less nothing. Each word is therefore dealt out under its key less each of its
letters (and under the key itself), a number of rows linear in its length, and rows with equal remainders and different letters are joined.
A remainder alone would bring all anagrams together. What one edit leaves untouched is either what comes before the middle or what comes after it, so the
part before and the part after are keys too, one row for each: that settles the letter order of one half in the join itself. What is left is
verified by edit distance. Where only the order within one half differs, candidates are the anagrams of the other half that occur as words.

Words are counted by task before they are shuffled, and nothing but words, their counts and pairs of words moves. A word has at most about
(letters of the alphabet) * (2 * length + 1) near words, which bounds every group. Forms have at least twice the occurrences of the word, so chains to the
root halve at each step: roots are found by pointer jumping in a number of rounds logarithmic in the logarithm of the largest count.

Defined cases: null and empty texts have no words; a null id counts as an empty one in the rule for deletions; repeated rows count each time;
long texts and long runs are whole; an empty table gives an empty result; ties between forms go to the smaller word; further columns are left aside."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch, chunks, text_of, tidy

#: A run of letters, once A-Z are in lower case.
RUN = re.compile("[a-zÀ-ÿ]+")
POWER = 5
#: Words that a task counts before it hands the counts on.
HELD = 400_000
WRAP = 1 << 64


def spelt(doc_id: object, runs: Counter[str], every: int = 97) -> Iterator[tuple[str, int]]:
    """The words of a document with their counts: one run in `every` has lost a letter, as a checksum of id and run says."""
    start = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def words(docs: DataFrame, least_length: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """word, n: words of at least `least_length` letters that occur at least `least` times."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for part in chunks(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                for word, n in spelt(doc_id, Counter(RUN.findall(text.encode().lower().decode())), every):
                    if len(word) >= least_length:
                        counts[word] += n
            if len(counts) >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
                counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    counted = docs.select("doc_id", text_of().alias("text")).mapInArrow(work, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def slots(word: str) -> Iterator[tuple[int, int]]:
    """Where a word meets those one edit away: a hash of its key less one letter (or none) and of what stands before, or after, the middle; and that letter.

    A remainder of r letters has its middle after r // 2. Words of r + 1 letters lose one, words of r letters none; the last r - r // 2 letters of either are what comes after."""
    powers = {ord(c): ord(c) ** POWER for c in set(word)}
    key = sum(powers[ord(c)] for c in word)
    n = len(word)
    for r, letters in ((n - 1, powers), (n, {0: 0})):
        middle = r // 2
        halves = xxhash.xxh64_intdigest(word[:middle].encode(), 1), xxhash.xxh64_intdigest(word[n - (r - middle) :].encode(), 2)
        for letter, power in letters.items():
            left = (key - power) * 0x9E3779B97F4A7C15
            for half in halves:
                yield ((left ^ half) * 0xD6E8FEB86659FD93 + r) % WRAP - (WRAP >> 1), letter


def near(known: DataFrame, scratch: Scratch) -> DataFrame:
    """word, other, other_n: pairs of words one edit apart, both ways. known: word, n."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                slot, letter, row = [], [], []
                for i, word in enumerate(batch.column("word").to_pylist()):
                    for s, c in slots(word):
                        slot.append(s)
                        letter.append(c)
                        row.append(i)
                take = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(letter, pa.int32()), batch.column("word").take(take), batch.column("n").take(take)], ["slot", "letter", "word", "n"])

    dealt = scratch.put("dealt", known.mapInArrow(work, "slot bigint, letter int, word string, n bigint"))
    other = dealt.select("slot", F.col("letter").alias("letter_2"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = dealt.join(other, "slot").filter(F.col("letter") < F.col("letter_2"))
    pairs = met.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct()
    return pairs.select("word", "other", "other_n").unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of every word that has a form; forms: word, form, acyclic."""
    now = scratch.put("roots-0", forms.select("word", F.col("form").alias("root")))
    for k in range(1, 64):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.put(f"roots-{k}", now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(f"roots-{k - 1}")
        now = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return now
    raise ValueError("forms go round in a circle")


def variants(docs: DataFrame, least_length: int = 5, least: int = 3, every: int = 97, times: int = 2) -> DataFrame:
    """word, n, form, form_n, root, n_near of every word."""
    spark = docs.sparkSession
    tidy(spark)
    scratch = Scratch(spark, "variants")
    known = scratch.put("words", words(docs, least_length, least, every))
    met = scratch.put("near", near(known, scratch).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")))
    scratch.drop("dealt")
    best = known.join(met, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))
    good = F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))
    chosen = scratch.put("forms", best.select("word", "n", "n_near", F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
    scratch.drop("words", "near")
    root = roots(chosen.filter("form IS NOT NULL"), scratch)
    return chosen.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _oracle(least_length: int = 5, least: int = 3, every: int = 97, times: int = 2) -> str:
    """The same in DuckDB's SQL: a checksum table and a fold for crc32; near words share what is left when a letter goes."""
    utf8 = "flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END))"
    step = "lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS INTEGER) + 1])"
    halve = "lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    ctes = [
        f"crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda x: CAST(x AS BIGINT))), {halve}) ORDER BY i) AS t FROM range(256) r(i))",
        "runs AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)",
        "dealt AS MATERIALIZED (SELECT run, id || ':' || run AS s, count(*) AS n FROM runs GROUP BY id, run)",
        f"hashed AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform({utf8}, lambda x: CAST(x AS BIGINT))), {step}), 4294967295) AS h FROM dealt, crc)",
        f"spelt AS (SELECT CASE WHEN h % {every} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed)",
        f"known AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= {least_length} GROUP BY word HAVING sum(n) >= {least})",
        "less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM known))",
        "apart AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word"
        " UNION SELECT a.word, b.word, b.n FROM less a JOIN known b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN known b ON a.rest = b.word)",
        "best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -other_n, other := other)) AS m FROM apart GROUP BY word)",
        f"chosen AS MATERIALIZED (SELECT k.word, k.n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.less >= {times} * k.n THEN m.other END AS form, CASE WHEN -m.less >= {times} * k.n THEN -m.less END AS form_n FROM known k LEFT JOIN best USING (word))",
        "up AS (SELECT word, word AS root, 0 AS depth FROM chosen UNION ALL SELECT up.word, c.form, depth + 1 FROM up JOIN chosen c ON up.root = c.word WHERE c.form IS NOT NULL)",
        "last AS (SELECT word, arg_max(root, depth) AS root FROM up GROUP BY word)",
    ]
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT word, form, root, n, n_near, form_n FROM chosen JOIN last USING (word)"


ORACLE = _oracle()
