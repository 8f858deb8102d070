"""English word forms: stop words, and the stemmer of the Snowball project known as Porter 2."""

from __future__ import annotations

import re

# The words that the English full-text configuration drops.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
# Fixed values of the algorithm: words with a stem of their own, words that are done after the plural step, beginnings with a region of their own, suffix rules.
OWN = dict(zip("skis skies dying lying tying idly gently ugly early only singly sky news howe atlas cosmos bias andes".split(), "ski sky die lie tie idl gentl ugli earli onli singl sky news howe atlas cosmos bias andes".split(), strict=True))
DONE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
BEGINNINGS = re.compile("gener|commun|arsen")
SECOND = "ization>ize ational>ate fulness>ful ousness>ous iveness>ive tional>tion biliti>ble lessli>less entli>ent ation>ate alism>al aliti>al ousli>ous iviti>ive fulli>ful enci>ence anci>ance abli>able izer>ize ator>ate alli>al bli>ble"
THIRD = "ational>ate tional>tion alize>al icate>ic iciti>ic ical>ic ness> ful>"
FOURTH = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()

VOWEL, REGION = re.compile("[aeiouy]"), re.compile("[aeiouy][^aeiouy]")
SHORT = re.compile("(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")


def _after(word: str, start: int) -> int:
    """Behind the first other letter that follows a vowel."""
    found = REGION.search(word, start)
    return found.end() if found else len(word)


def _rules(word: str, rules: str, r1: int) -> str | None:
    """The word with its longest listed suffix exchanged, if that stands in the region; None where no suffix is listed."""
    for rule in rules.split():
        old, _, new = rule.partition(">")
        if word.endswith(old):
            return word[: -len(old)] + new if len(word) - len(old) >= r1 else word
    return None


def stem(word: str) -> str:
    """The stem of a word in lower case; words with anything but letters are their own."""
    if len(word) < 3 or not word.isalpha():
        return word
    if word in OWN:
        return OWN[word]
    w = re.sub("(^|[aeiouy])y", r"\1Y", word)
    begun = BEGINNINGS.match(w)
    r1 = begun.end() if begun else _after(w, 0)
    r2 = _after(w, r1)

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in DONE:
        return w

    if w.endswith(("eed", "eedly")):
        at = w.rindex("eed")
        w = w[: at + 2] if at >= r1 else w
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if VOWEL.search(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                        w = w[:-1]
                    elif len(w) <= r1 and SHORT.match(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    if (changed := _rules(w, SECOND, r1)) is not None:
        w = changed
    elif w.endswith("ogi"):
        w = w[:-1] if len(w) - 3 >= r1 and w[-4:-3] == "l" else w
    elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
        w = w[:-2]
    if w.endswith("ative"):
        w = w[:-5] if len(w) - 5 >= r2 else w
    else:
        changed = _rules(w, THIRD, r1)
        w = w if changed is None else changed
    for end in FOURTH:
        if w.endswith(end):
            w = w[: -len(end)] if len(w) - len(end) >= r2 else w
            break
    else:
        if w.endswith("ion") and w[-4:-3] in ("s", "t") and len(w) - 3 >= r2:
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not SHORT.match(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


class Stems(dict):
    """Lexemes of tokens, as a task meets them: None for a stop word."""

    def __missing__(self, token: str) -> str | None:
        if len(self) > 300_000:
            self.clear()
        made = self[token] = None if token in STOP else stem(token)
        return made
