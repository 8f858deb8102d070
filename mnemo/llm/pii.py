"""Operator 8, personal data: fixed base patterns, and candidates chosen by boosted trees.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always stay. Besides, generators of high recall propose
overlapping spans: runs of digits and separators, things around "@" or " at ", quoted and bare strings of letters and digits after a
key-like word. Boosted trees score each by its format (length, digits, separators, entropy, checksums) and context (characters and key
words around); a span whose score reaches the threshold of its kind is added unless a better or a base one overlaps it. The
trees are fitted to examples generated from format grammars with a fixed seed (there are no labels of personal data), and
the thresholds are calibrated on examples set aside, at a given precision.

One pass, no shuffle. Defined cases: null and empty texts have no spans; null ids pass; repeated rows each get a row; an empty table gives
an empty result; further columns are left aside; of equally good overlapping spans the first, then the shorter one is added. Texts are whole; work grows
with their length and, by the sorting of spans, little more."""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemo.llm.boosting import Boosted
from mnemo.llm.common import chunks, text_of, tidy
from mnemo.llm.training import platt

KINDS = ("email", "ip", "card", "phone")
ADDED = ("email", "ip", "card", "phone", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits that doesn't match from its start doesn't match from later on either, and giving digits back never helps.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each "@" outwards."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[Span]:
    """By kind, then by start."""
    found: list[Span] = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        found += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


PROPOSE = {
    "email": [re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}+(?: ?(?:@|\(at\)|\[at\]) ?| at )[\w-]{1,63}+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?| dot )[\w-]{1,63}+){1,4}")],
    "phone": [re.compile(r"(?<![\w.])\+?[0-9]{0,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?!\w)"), re.compile(r"(?<![\w.+-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){2,4}(?!\w)")],
    "card": [re.compile(r"(?<![0-9])[0-9]{4}(?:[ . -]?[0-9]{2,7}){2,4}(?![0-9])")],
    "ip": [re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![\w:])")],
    "secret": [re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+={0,2}")],
}
#: Tests that are quick on a whole text and that every proposal of the kind passes; spans have any length.
HINT = {
    "email": re.compile(r"@|\(at\)|\[at\]| at [\w-]{1,63}+(?:\.| ?(?:\(dot\)|\[dot\])| dot )"),
    "phone": re.compile(r"[0-9]{2,4}[ .)-]"),
    "card": re.compile(r"[0-9]{4}"),
    "ip": re.compile(r"[0-9A-Fa-f]:"),
    "secret": re.compile(r"[A-Za-z0-9_/+-]{16}"),
}
CONTEXT = {
    "email": re.compile(r"mail|contact|write|reach", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobil|handy|número|teléf", re.I),
    "card": re.compile(r"card|visa|credit|pay|konto|carte|tarjeta", re.I),
    "ip": re.compile(r"\bip\b|host|addr|server|ping", re.I),
    "secret": re.compile(r"key|token|secret|passw|auth|cred|api", re.I),
}


#: Ends of the names of hosts that are met most.
ENDS = re.compile(r"\b(com|org|net|edu|gov|info|io|eu|de|fr|es|uk)$")


def proposals(text: str) -> list[Span]:
    """Spans of every kind, overlapping ones too."""
    found = []
    for kind, patterns in PROPOSE.items():
        if HINT[kind].search(text):
            found += [(kind, *m.span()) for p in patterns for m in p.finditer(text)]
    return found


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    s = text[start:end]
    digits = _digits(s)
    counts = Counter(s)
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in counts.values())
    before, after = text[max(0, start - 24) : start], text[end : end + 24]
    groups = re.findall(r"[0-9]+", s)
    return [
        ADDED.index(kind), len(s), len(digits), len(digits) / len(s), entropy,
        sum(c.isupper() for c in s) / len(s), sum(c.islower() for c in s) / len(s), sum(c in " .-()" for c in s),
        len(groups), max((len(g) for g in groups), default=0), float(13 <= len(digits) <= 19 and luhn(digits)),
        float("@" in s), float("(" in s), float(s.startswith("+")), float(set(s) <= set("0123456789abcdefABCDEF")),
        float(bool(CONTEXT[kind].search(before))), float(before[-1:] in "\"'=:"), float(after[:1] in "\"'"),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(bool(re.search(r"\bdot\b|\(dot\)|\[dot\]", s))),
        float(bool(ENDS.search(s))), float(" at " in s),
    ]


def examples(seed: int = 11, n: int = 400) -> list[tuple[str, Span, int]]:
    """Generated texts with a span and whether it is personal data: n of either label for each kind."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "the", "re", "ti", "on", "sch", "que", "ll", "in", "mo"]) for _ in range(r.randint(1, 4)))
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))

    def card(good: bool) -> str:
        x = d(15)
        x += next(c for c in "0123456789" if luhn(x + c) == good)
        return r.choice(["", " ", "-", "."]).join(x[i : i + 4] for i in range(0, 16, 4))

    hexes, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    make = {
        ("email", 1): lambda: f"{word()}{r.choice(['', '', f'.{word()}', f'_{word()}', d(2)])}{r.choice([' at ', '@', ' (at) ', '[at]'])}{word()}{r.choice([' dot ', '.', ' (dot) ', '[dot]'])}{r.choice(['com', 'org', 'net', 'de', 'io', 'edu'])}",
        ("email", 0): lambda: f"{word()} at {word()}. {word()}" if r.random() < 0.7 else f"{word()} at {word()}.{word()}",
        ("phone", 1): lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"0{d(3)}-{d(3)}-{d(3)}", f"{d(3)}-{d(3)}-{d(4)}"]),
        ("phone", 0): lambda: r.choice([f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{d(2)}.{d(2)}.{r.randint(1900, 2030)}", f"{d(2)} {d(2)} {d(2)}", f"{d(4)} {d(3)} {d(2)} {d(4)} {d(3)}"]),
        ("card", 1): lambda: card(True),
        ("card", 0): lambda: r.choice([card(False), d(r.randint(9, 12)), f"{d(4)} {d(4)} {d(4)}"]),
        ("ip", 1): lambda: ":".join(pick(hexes, r.randint(1, 4)) for _ in range(8)),
        ("ip", 0): lambda: ":".join(d(2) for _ in range(r.randint(4, 5))),
        ("secret", 1): lambda: r.choice([pick(hexes, 40), pick(hexes, 32), pick(b64, r.randint(24, 48)), "sk_live_" + pick(b64, 24)]),
        ("secret", 0): lambda: r.choice([*("".join(word() for _ in range(12))[: r.randint(16, 28)] for _ in range(3)), word().title() + "".join(word() for _ in range(12))[:18], "-".join(word() for _ in range(8)), "/".join(word() for _ in range(r.randint(5, 9))), "-" * r.randint(16, 60), d(r.randint(16, 20)), f"{word()}_{word()}_{word()}_{word()}_{word()}_{word()}"]),
    }
    cue = {"email": "mail: ", "phone": "tel: ", "card": "card ", "ip": "host ", "secret": 'token = "'}
    found = []
    for (kind, y), f in make.items():
        made = 0
        while made < n:
            s = f()
            hint = r.random() < (0.75 if kind == "secret" and y else 0.3 if y else 0.05)
            lead = f"{word()} {word()} " + (cue[kind] if hint else "")
            text = lead + s + ('" ' if hint and kind == "secret" else r.choice([" ", ". ", ", "])) + f"{word()} {word()} {d(1)}"
            mine = [p for p in proposals(text) if p[0] == kind and p[1] < len(lead) + len(s) and p[2] > len(lead)]
            exact = [p for p in mine if p[1:] == (len(lead), len(lead) + len(s))]
            if not mine or y and not exact:
                made += 1  # the generators don't propose this one
                continue
            found.append((text, (exact or mine)[0], y))
            made += 1
    return found


class Taken:
    """Stretches of a text that spans have, apart from one another and in order."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):  # base spans of several kinds may overlap
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)  # those before begin ahead of the end; the last of them reaches farthest
        return at == 0 or self.ends[at - 1] <= start

    def add(self, start: int, end: int) -> None:
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


@dataclass
class Selector:
    model: Boosted
    scale: tuple[float, float]
    thresholds: dict[str, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.model.margins(x) + b, -30, 30)))

    def choose(self, text: str, base: list[Span]) -> list[Span]:
        """Base spans and what is added, by kind, then by start."""
        known = set(base)
        offered = [p for p in proposals(text) if p not in known]
        if not offered:
            return base
        score = self.scores(np.array([features(text, p) for p in offered]))
        taken = Taken((s, e) for _, s, e in base)
        kept = []
        for k in np.lexsort(([p[2] for p in offered], [p[1] for p in offered], -score)):
            kind, s, e = offered[k]
            if score[k] >= self.thresholds[kind] and taken.free(s, e):
                taken.add(s, e)
                kept.append(offered[k])
        return sorted([*base, *kept], key=lambda p: (ADDED.index(p[0]), p[1]))


@lru_cache(maxsize=2)
def trained(precision: float = 0.99, seed: int = 11) -> Selector:
    rows = examples(seed)
    x, y = np.array([features(t, s) for t, s, _ in rows]), np.array([y for *_, y in rows])
    aside = np.random.default_rng(seed).permutation(len(y)) % 4 == 0
    model = Boosted.fit(x[~aside], y[~aside])
    made = Selector(model, platt(model.margins(x[aside]), y[aside]), {})
    score = made.scores(x[aside])
    for i, kind in enumerate(ADDED):
        own = x[aside][:, 0] == i
        s, t = score[own], y[aside][own]
        # the least score from which on, upwards, the precision holds
        order = np.argsort(-s, kind="stable")
        ok = np.flatnonzero(np.cumsum(t[order]) >= precision * np.arange(1, len(t) + 1))
        made.thresholds[kind] = max(0.5, float(s[order][ok.max()])) if len(ok) else 1.1
    return made


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, precision: float = 0.99) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans (kind:start:end in code points, all of them)."""
    tidy(docs.sparkSession)
    selector = docs.sparkSession.sparkContext.broadcast(trained(precision))  # a few dozen small trees

    def work(batches):
        tool = selector.value
        for part in chunks(batches):
            base = [base_spans(t) for t in part.column("text").to_pylist()]
            every = [tool.choose(t, b) for t, b in zip(part.column("text").to_pylist(), base, strict=True)]
            n = [Counter(k for k, *_ in b) for b in base]
            columns = [pa.array([c[k] for c in n], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]), pa.array([_joined(s) for s in every])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(work, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(text: str, spans: list[Span], mask: str = "[{}]") -> str:
    """The text with each span replaced by its kind; of spans that overlap, the one that starts first."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda p: (p[1], -p[2])):
        if s >= at:
            out += [text[at:s], mask.format(kind)]
            at = e
    return "".join([*out, text[at:]])
