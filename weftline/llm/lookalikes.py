"""Texts that look the same but differ in their characters, brought to one plain form.

A text is in plain form if its letters are composed, characters have ordinary width, letters are single,
the ordinary blank is the only space, nothing is invisible, no sign stands for a letter that looks the
same, and every word (a run of letters) is of one script, kanji and kana counting as one.

A word that isn't is first walked through a trie of known spellings by an edit automaton to which look-alikes
and invisible characters cost nothing and other edits one each; a single cheapest spelling within
``max_cost`` decides. With the default of 0 nothing but look-alikes is forgiven, so no text changes its look.
Only words that no spelling matches, and signs outside of words, are normalised by a table that is derived
from the Unicode database. The two differ where a word's letters alone don't tell its script: a table
takes it for Latin, the trie knows that it is the Russian or Greek word of the vocabulary.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Letters of other scripts and the Latin letter that each looks like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮаеѕіјкорсухһԁԛԝ", "ABESIJKMHOPCTYXYaesijkopcyxhdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχϲ", "ABEZHIKMNOPTYXaikvopuxc"))
ARMENIAN = dict(zip("ՕՍԼօսհոցզ", "OULouhngq"))
# Signs that look the same as a usual letter or hyphen, beside those that Unicode itself composes.
SIGNS = {"µ": "μ", "∆": "Δ", "∑": "Σ", "∏": "Π", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "﹘": "–"}
# Invisible characters outside the category of format characters.
INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
SCRIPTS = frozenset("LATIN GREEK CYRILLIC ARMENIAN HEBREW ARABIC SYRIAC DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU KANNADA MALAYALAM SINHALA THAI LAO TIBETAN MYANMAR GEORGIAN ETHIOPIC CHEROKEE KHMER MONGOLIAN HIRAGANA KATAKANA CJK HANGUL BOPOMOFO".split())
JOINING = frozenset("ARABIC SYRIAC DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU KANNADA MALAYALAM SINHALA KHMER MYANMAR MONGOLIAN".split())
LOOKS = {"CYRILLIC": CYRILLIC, "GREEK": GREEK, "ARMENIAN": ARMENIAN}
BACK = {s: {v: k for k, v in reversed(m.items())} for s, m in LOOKS.items()}
SKELETON = {k: v for m in LOOKS.values() for k, v in m.items()} | {k: v for k, v in SIGNS.items() if v.isascii()}
JOINERS = "‌‍"


@lru_cache(maxsize=None)
def script(c: str) -> str | None:
    """The script of a letter, kanji and kana as one; None for signs, marks and letters of all scripts."""
    if not c.isalpha() or unicodedata.category(c) == "Lm" or c in "ªº":
        return None
    first = unicodedata.name(c, "").split(" ")[0].split("-")[0]
    if first in ("HIRAGANA", "KATAKANA", "CJK", "KANGXI"):
        return "CJK"
    return first if first in SCRIPTS else None


@lru_cache(maxsize=None)
def invisible(c: str) -> bool:
    return unicodedata.category(c) in ("Cf", "Cc") and c not in "\t\n\v\f\r\x85" or ord(c) in INVISIBLE


@lru_cache(maxsize=None)
def plain_char(c: str) -> str:
    """What the table puts in place of a character of a composed text."""
    if c in SIGNS:
        return SIGNS[c]
    if c.isspace() or c == "\x85" or unicodedata.category(c) in ("Zs", "Zl", "Zp"):
        return " "
    if invisible(c):
        return ""
    how = unicodedata.decomposition(c).split(" ")[0]
    if how in ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>"):
        return "".join(" " if x.isspace() else x for x in unicodedata.normalize("NFKC", c))
    if how == "<compat>" and unicodedata.category(c) in ("Ll", "Lu", "Lt", "Lo", "Nl"):
        to = unicodedata.normalize("NFKC", c)
        if to.isalpha() and (len(to) > 1 or unicodedata.category(c) == "Nl"):
            return to
    return c


def _in_word(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c)[0] == "M"


def scripts_of(word: str) -> set[str]:
    return {s for s in map(script, word) if s}


def one_script(word: str) -> str:
    """A word of mixed scripts with look-alikes turned into the script that holds its own letters.

    That is the script with most letters that no other one here has a look-alike for; of equals the one
    with most letters, then Latin. Letters without a look-alike in it stay.
    """
    have = scripts_of(word)
    if len(have) < 2:
        return word
    n, own = Counter(), Counter()
    for c in word:
        if s := script(c):
            n[s] += 1
            latin = SKELETON.get(c, c) if s != "LATIN" else c
            own[s] += not (c in LOOKS.get(s, ()) if s != "LATIN" else any(latin in BACK[o] for o in have if o in BACK))
    to = max(have, key=lambda s: (own[s], s == "LATIN" if own[s] == 0 else n[s], n[s], s == "LATIN", s))
    out = []
    for c in word:
        s = script(c)
        if s and s != to:
            latin = c if s == "LATIN" else LOOKS.get(s, {}).get(c)
            c = (latin if to == "LATIN" else BACK.get(to, {}).get(latin)) or c
        out.append(c)
    return "".join(out)


class Spellings:
    """A trie of known words, and the automaton that walks it."""

    def __init__(self, words: Iterable[str], max_cost: int = 0):
        self.max_cost = max_cost
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in unicodedata.normalize("NFC", w):
                node = node.setdefault(c, {})
            node[""] = w

    def nearest(self, word: str) -> str | None:
        """The one cheapest spelling within max_cost, else None."""
        if not self.root:
            return None
        states: list[tuple[int, dict]] = self._skip([(0, self.root)])
        for c in word:
            if invisible(c):
                continue
            for x in plain_char(c):
                look, to = SKELETON.get(x, x), {}
                for cost, node in states:
                    if cost < self.max_cost:
                        self._put(to, cost + 1, node)
                    for y, child in node.items():
                        if y:
                            step = 0 if x == y or look == SKELETON.get(y, y) else 1
                            if cost + step <= self.max_cost:
                                self._put(to, cost + step, child)
                states = self._skip(list(to.values()))
                if not states:
                    return None
        ends: dict[str, int] = {}
        for cost, node in states:
            if "" in node:
                ends[node[""]] = min(cost, ends.get(node[""], cost))
        if not ends:
            return None
        least = min(ends.values())
        best = [w for w, cost in ends.items() if cost == least]
        return best[0] if len(best) == 1 else None

    @staticmethod
    def _put(to: dict, cost: int, node: dict) -> None:
        if id(node) not in to or cost < to[id(node)][0]:
            to[id(node)] = (cost, node)

    def _skip(self, states: list[tuple[int, dict]]) -> list[tuple[int, dict]]:
        """With the states that leaving out letters of a spelling reaches."""
        if not self.max_cost:
            return states
        to: dict = {}
        todo = list(states)
        while todo:
            cost, node = todo.pop()
            if id(node) in to and to[id(node)][0] <= cost:
                continue
            to[id(node)] = (cost, node)
            if cost < self.max_cost:
                todo += [(cost + 1, child) for y, child in node.items() if y]
        return list(to.values())


def spellings(names: Iterable[str | None], max_cost: int = 0) -> Spellings:
    """The words of canonical names in small, capital and title case."""
    found = set()
    for name in names:
        word = ""
        for c in unicodedata.normalize("NFC", name or "") + " ":
            if _in_word(c):
                word += c
            elif word:
                found |= {word.lower(), word.upper(), word.lower().capitalize()}
                word = ""
    return Spellings(sorted(found), max_cost)


def plain_word(word: str) -> bool:
    """Whether a composed word has nothing to be replaced and letters of one script at most."""
    return all(plain_char(c) == c for c in word) and len(scripts_of(word)) < 2


def by_table(word: str) -> str:
    """The plain form of a word that is no known spelling."""
    return one_script(unicodedata.normalize("NFC", "".join(map(plain_char, word))))


def _keep_joiners(text: str) -> set[int]:
    """Places of joiners and selectors that belong to an emoji or to a script that needs them."""
    keep = set()
    for n, c in enumerate(text):
        if c in JOINERS or c == "️":
            before, after = text[n - 1] if n else "", text[n + 1] if n + 1 < len(text) else ""
            sign = lambda x: bool(x) and (unicodedata.category(x) in ("So", "Sk") or x == "️")
            if c == "️" and sign(before) or c == "‍" and sign(before) and sign(after):
                keep.add(n)
            elif c in JOINERS and before and after and (_base_script(text, n) in JOINING):
                keep.add(n)
    return keep


def _base_script(text: str, n: int) -> str | None:
    while n and not text[n - 1].isalpha():
        n -= 1
    return script(text[n - 1]) if n else None


def plain(text: str | None, known: Spellings | None = None) -> str | None:
    """The plain form of a text; null stays null, and a text that has it comes back as it is."""
    if text is None or text.isascii() and text.isprintable():
        return text
    text = unicodedata.normalize("NFC", text)
    keep = _keep_joiners(text)
    out, run = [], []

    def flush() -> None:
        if run:
            word = "".join(run)
            run.clear()
            out.append(word if plain_word(word) else (known and known.nearest(word)) or by_table(word))

    for n, c in enumerate(text):
        if n in keep:
            flush()
            out.append(c)
        elif _in_word(c) or invisible(c) or plain_char(c).isalpha():
            run.append(c)
        else:
            flush()
            out.append(plain_char(c))
    flush()
    return unicodedata.normalize("NFC", "".join(out))


def is_plain(text: str | None, known: Spellings | None = None) -> bool:
    """Whether a text is in plain form: it is its own plain form and no word in it mixes scripts."""
    if text is None or text.isascii() and text.isprintable():
        return True
    if plain(text, known) != text:
        return False
    word = ""
    for c in text + " ":
        if _in_word(c):
            word += c
        elif word:
            if len(scripts_of(word)) > 1:
                return False
            word = ""
    return True


def with_plain(df: DataFrame, id_column: str, text_column: str, names: list[str], max_cost: int = 0) -> DataFrame:
    """``record_id, text, plain, is_plain`` of every row; other columns are left out.

    One pass in Arrow batches without a shuffle; texts of printable ASCII take no more than a check.
    ``names`` are the canonical names whose words are known spellings, a list of bounded size that goes
    to the workers with the function. Null texts have a null plain form and count as plain; empty ones too.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spellings(names, max_cost)
        seen: dict[str, tuple[str, bool]] = {}
        for b in batches:
            texts = b.column(1).to_pylist()
            forms, good = [], []
            for t in texts:
                if t is None or t.isascii() and t.isprintable():
                    forms.append(t), good.append(True)
                    continue
                if t not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[t] = (plain(t, known), is_plain(t, known))
                forms.append(seen[t][0]), good.append(seen[t][1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(forms, pa.string()), pa.array(good, pa.bool_())], names=["record_id", "text", "plain", "is_plain"])

    rows = df.select(F.col(id_column).cast("bigint").alias("record_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(convert, "record_id bigint, text string, plain string, is_plain boolean")
