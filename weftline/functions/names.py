"""Freely typed names and the entry of a canonical list that each means.

First a multi-pattern automaton over the canonical names and their aliases looks for mentions that start
and end at word borders; of overlapping ones the longest wins. A name that consists of one entry's
mention and decoration (numbers, units, table prefixes) means that entry. What is left goes to
token-set similarity: words are paired off, each with the one it equals, abbreviates or mistypes, and a name
means the entry whose words it shares, if they are the same set, or alike to ``least_similarity`` or more.
Names without borders between words are compared as a whole: cut short, or mistyped. Only a single best entry
is an answer; a name that fits several equally well means nothing definite.

No step walks over all entries: each has an index (sorted texts for prefixes, initial letters of words for
abbreviations, parts of texts for typing errors, words for similarity) that gives the few that can fit.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from itertools import permutations

import ahocorasick
import regex

NOTHING = 0
# Words around a name that don't change what it means.
DECORATION = frozenset(["f", "tbl", "fld", "col", "dim", "fact", "src", "raw"])
# Customary short forms that aren't made of the word's own letters in order.
SHORT_FORMS = {"pax": "passenger", "no": "number", "nr": "number", "temp": "temperature", "avg": "mean", "veh": "vehicle"}

_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}")
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})")
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")


def fold(text: str) -> str:
    """Case folded, without marks: Ä, ä and a are one."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def words(name: str) -> list[str]:
    """The folded words of a name, bracketed units left out unless nothing else is there."""
    name = unicodedata.normalize("NFKC", name)
    bare = _BRACKETS.sub(" ", name)
    found = [fold(w) for part in _WORD.findall(bare) for w in _CAMEL.split(part)]
    return [w for w in found if w]


def edits(a: str, b: str, most: int) -> int:
    """Edits from a to b (insert, delete, replace, swap of neighbours), or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = before[j - 1] if x == y else 1 + min(before[j - 1], before[j], row[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, last[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return row[-1]


def shortens(short: str, word: str) -> bool:
    """Whether ``short`` abbreviates ``word``: a prefix, or its first letter and some later ones in order."""
    if word.startswith(short) or SHORT_FORMS.get(short) == word:
        return True
    if len(short) < 2 or short[0] != word[0] or len(short) >= len(word):
        return False
    at = iter(word)
    return all(c in at for c in short)


class TermResolver:
    """``resolve(name)`` gives the id of the entry that a name means, or 0.

    ``terms``: (id, canonical name, aliases). ``max_edits`` is the most typing errors, ``least_prefix`` the
    least share of an entry's letters that a name cut short must have, ``least_similarity`` the least share of
    words that a name and an entry must have in common. Null and blank names mean nothing.
    """

    def __init__(self, terms: list[tuple[int, str, list[str] | None]], max_edits: int = 2, least_prefix: float = 0.5, least_similarity: float = 0.8):
        self.max_edits, self.least_prefix, self.least_similarity = max_edits, least_prefix, least_similarity
        self.exact = {t: n for n, t, _ in terms}
        self.compact: dict[str, set[int]] = defaultdict(set)
        self.orders: dict[str, set[int]] = defaultdict(set)
        self.bags: dict[tuple[str, ...], set[int]] = defaultdict(set)
        self.canon: list[tuple[int, list[str]]] = []
        self.parts: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        for n, term, aliases in terms:
            for k, text in enumerate([term, *(a for a in aliases or [] if a)]):
                w = words(text)
                if not w:
                    continue
                self.compact["".join(w)].add(n)
                self.parts["".join(w)].append(tuple(w))
                self.bags[tuple(sorted(w))].add(n)
                if k == 0:
                    self.canon.append((n, w))
                if len(w) <= 4:
                    for p in permutations(w):
                        self.orders["".join(p)].add(n)
                        self.parts["".join(p)].append(p)
        self.automaton = ahocorasick.Automaton()
        for text, ids in self.compact.items():
            self.automaton.add_word(text, (len(text), ids))
        if self.compact:
            self.automaton.make_automaton()
        self.sorted = sorted(self.compact)
        self.initials: dict[tuple[str, ...], list[tuple[int, list[str]]]] = defaultdict(list)
        self.heads: dict[str, list[tuple[int, list[str]]]] = defaultdict(list)
        for n, w in self.canon:
            self.initials[tuple(sorted(x[0] for x in w))].append((n, w))
            if len(w) > 1:
                self.heads[w[0][0]].append((n, w))
        self.segments: dict[tuple[int, int, str], list[str]] = defaultdict(list)
        for text in self.orders.keys() | self.compact.keys():
            for k, (a, b) in enumerate(self._cuts(len(text))):
                self.segments[len(text), k, text[a:b]].append(text)
        self.sets: dict[int, set[tuple[str, ...]]] = defaultdict(set)
        self.having: dict[str, set[int]] = defaultdict(set)
        for bag, ids in self.bags.items():
            for n in ids:
                self.sets[n].add(bag)
                for x in bag:
                    self.having[x].add(n)

    def _cuts(self, length: int) -> list[tuple[int, int]]:
        """A text in more parts than ``max_edits`` edits, each of at most two neighbouring letters, can touch."""
        many = 2 * self.max_edits + 1
        return [(length * k // many, length * (k + 1) // many) for k in range(many)]

    def resolve(self, name: str | None) -> int:
        if name is None:
            return NOTHING
        if name in self.exact:
            return self.exact[name]
        w = words(name)
        text = "".join(w)
        if not text or not self.compact:
            return NOTHING
        if (found := self._mentioned(w, text)) is not None:
            return found
        core = [x for x in w if not x.isdigit()]
        while core and core[0] in DECORATION and len(core) > 1:
            core = core[1:]
        return self._similar(core) if core else NOTHING

    def mentions(self, text: str) -> list[tuple[int, int, set[int]]]:
        """(start, end, ids) of the longest non-overlapping mentions in a compact text."""
        found = [(end - n + 1, end + 1, ids) for end, (n, ids) in self.automaton.iter(text)]
        found.sort(key=lambda m: (m[0] - m[1], m[0]))
        kept: list[tuple[int, int, set[int]]] = []
        for m in found:
            if all(m[1] <= k[0] or m[0] >= k[1] for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m[0])

    def _mentioned(self, w: list[str], text: str) -> int | None:
        borders, at = {0}, 0
        for x in w:
            at += len(x)
            borders.add(at)
        kept = [m for m in self.mentions(text) if m[0] in borders and m[1] in borders]
        ids = {n for m in kept for n in m[2]}
        if not kept:
            return None
        at, rest = 0, []
        for x in w:
            if not any(m[0] <= at and at + len(x) <= m[1] for m in kept):
                rest.append(x)
            at += len(x)
        if all(x.isdigit() or x in DECORATION for x in rest):
            return ids.pop() if len(ids) == 1 else NOTHING
        return None

    def _similar(self, w: list[str]) -> int:
        text = "".join(w)
        # the same words in any order, however many; permutations find short names without borders
        for found in (lambda: self.bags.get(tuple(sorted(w)), set()) | self.orders.get(text, set()), lambda: self._cut(text), lambda: self._abbreviated(w), lambda: self._mistyped(text, w), lambda: self._sharing(w)):
            if ids := found():
                return next(iter(ids)) if len(ids) == 1 else NOTHING
        return NOTHING

    def _cut(self, text: str) -> set[int]:
        out: set[int] = set()
        for k in range(bisect_left(self.sorted, text), len(self.sorted)):
            full = self.sorted[k]
            if not full.startswith(text):
                break
            if len(text) >= max(4, self.least_prefix * len(full)):
                out |= self.compact[full]
        return out

    def _abbreviated(self, w: list[str]) -> set[int]:
        """Entries of which each word is abbreviated by one word of the name, or by a part of its one word."""
        out = set()
        firsts = {()}
        for x in w:
            firsts = {(*f, c) for f in firsts for c in {x[0], SHORT_FORMS.get(x, x)[0]}}
        if max(map(len, w)) >= 2:
            for n, full in {n: full for f in firsts for n, full in self.initials.get(tuple(sorted(f)), ())}.items():
                if paired([[b for b, y in enumerate(full) if shortens(x, y)] for x in w]) == len(w):
                    out.add(n)
        if len(w) == 1:
            out |= {n for n, full in self.heads.get(w[0][0], ()) if self._runs(w[0], full)}
        return out

    def _sharing(self, w: list[str]) -> set[int]:
        """Entries with the highest token-set similarity to the name: twice the common words over all words."""
        known = [x for x in set(w) if x in self.having]
        best, ids = self.least_similarity, set()
        for n in {n for x in known for n in self.having[x]}:
            for bag in self.sets[n]:
                s = 2 * len(set(w) & set(bag)) / (len(set(w)) + len(set(bag)))
                if s >= best:
                    ids = {n} | (ids if s == best else set())
                    best = s
        return ids

    def _runs(self, text: str, full: list[str]) -> bool:
        """Whether a text without borders is one abbreviation of each word in turn."""
        if len(text) < max(6, 2 * len(full)) and len(text) != len(full):
            return False
        if len(text) == len(full):
            return len(full) > 2 and all(a == b[0] for a, b in zip(text, full))
        if len(full) == 1:
            return shortens(text, full[0])
        ends = {k for k in range(2, min(len(text) - 1, len(full[0])) + 1) if shortens(text[:k], full[0])}
        for word in full[1:]:
            ends = {b for a in ends for b in range(a + 1, min(len(text), a + len(word)) + 1) if shortens(text[a:b], word)}
        return len(text) in ends

    @staticmethod
    def _spread(w: list[str], full: tuple[str, ...]) -> bool:
        """Whether, of two words, each keeps half of its letters, so that none is another word altogether."""
        return len(w) != len(full) or len(w) != 2 or all(edits(a, b, k) <= k for a, b in zip(w, full) for k in [max(1, len(b) // 2)])

    def _mistyped(self, text: str, w: list[str]) -> set[int]:
        most = min(self.max_edits, max(1, len(text) // 4)) if len(text) >= 5 else 0
        if not most:
            return set()
        near = set()
        for n in range(max(1, len(text) - most), len(text) + most + 1):
            for k, (a, b) in enumerate(self._cuts(n)):
                for shift in range(-most, most + 1):
                    if 0 <= a + shift and b + shift <= len(text):
                        near.update(self.segments.get((n, k, text[a + shift : b + shift]), ()))
        best, ids = most, set()
        letters = set(text)
        for full in sorted(near, key=lambda x: (len(x), x)):
            if len(letters ^ set(full)) > 2 * most:
                continue
            d = edits(text, full, best)
            if 1 < d <= best and not any(self._spread(w, p) for p in self.parts[full]):
                continue
            if d < best:
                best, ids = d, set()
            if d == best and d > 0:
                ids |= self.orders.get(full, set()) | self.compact.get(full, set())
        return ids


def paired(options: list[list[int]]) -> int:
    """How many of the left sides can each have one of their right sides for themselves."""
    of: dict[int, int] = {}

    def give(left: int, seen: set[int]) -> bool:
        for r in options[left]:
            if r not in seen:
                seen.add(r)
                if r not in of or give(of[r], seen):
                    of[r] = left
                    return True
        return False

    return sum(give(k, set()) for k in range(len(options)))
