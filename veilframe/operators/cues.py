"""What a text must hold for a pattern to match at all: a set of words of which one stands in every match, read from the pattern
itself. All words of all patterns are looked for in one pass of an automaton, so most patterns never run on most texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

def fold(text: str) -> str:
    """A text as it is compared where case does not count; letters that match each other then are alike here."""
    return text.replace("\u0130", "i").replace("\u0131", "i").casefold()


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The set whose shortest word is the longer, then the smaller one."""
    if a is None or b is None:
        return a if b is None else b
    rank = lambda s: (-min(map(len, s)), len(s))
    return min(a, b, key=rank)


def _words(nodes: Sequence) -> frozenset[str] | None:
    """Words of which every match of a parsed sequence holds one; None where there is no such set."""
    best, run = None, ""
    for op, arg in [*nodes, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        if run:
            best, run = _better(best, frozenset({fold(run)})), ""
        if name == "BRANCH":
            sets = [_words(b) for b in arg[1]]
            if all(s is not None for s in sets):
                best = _better(best, frozenset().union(*sets))
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            best = _better(best, frozenset(fold(chr(v)) for _, v in arg))
        elif name == "SUBPATTERN":
            best = _better(best, _words(arg[3]))
        elif name == "ATOMIC_GROUP":
            best = _better(best, _words(arg))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            best = _better(best, _words(arg[2]))
    return best


def words_of(pattern: str) -> frozenset[str] | None:
    """Words of which one stands, folded, in every text that the pattern matches; None where single letters or digits are all there is."""
    found = _words(re._parser.parse(pattern))
    if found is None or any(len(w) < 2 and w.isalnum() for w in found) or "" in found:
        return None
    return found


#: An unbounded stretch of blanks, dots and dashes in a pattern is taken as this wide; texts that hold a longer one are read whole.
BLANKS = 16
_DIGITS = re.compile(r"\d+")
_LONG = re.compile(r"[\s.\-]{%d}" % (BLANKS + 1))


class _Open(Exception):  # noqa: N818
    """A pattern whose matches have no greatest width, or that looks beyond them."""


def _of_digits(name: str, arg) -> bool:
    if name == "LITERAL":
        return 48 <= arg <= 57
    digit = lambda o, v: (o == "RANGE" and 48 <= v[0] and v[1] <= 57) or (o == "LITERAL" and 48 <= v <= 57) or (o == "CATEGORY" and str(v) == "CATEGORY_DIGIT")
    return name == "IN" and all(digit(str(o), v) for o, v in arg)


def _of_blanks(nodes: Sequence) -> bool:
    blank = lambda o, v: (o == "CATEGORY" and str(v) == "CATEGORY_SPACE") or (o == "LITERAL" and chr(v) in ".-")
    return len(nodes) == 1 and str(nodes[0][0]) == "IN" and all(blank(str(o), v) for o, v in nodes[0][1])


def _shape(nodes: Sequence) -> tuple[int | None, int, int, bool]:
    """(how many digits a match has if it has nothing else, digits that surely stand in a row, greatest width, whether that leans on BLANKS)."""
    only, best, run, width, blanks = 0, 0, 0, 0, False
    for op, arg in nodes:
        name = str(op)
        if name == "AT":
            continue
        if name in ("LITERAL", "NOT_LITERAL", "ANY", "IN"):
            o, b, w = (1, 1, 1) if _of_digits(name, arg) else (None, 0, 1)
        elif name == "BRANCH":
            parts = [_shape(x) for x in arg[1]]
            o = None if any(p[0] is None for p in parts) else min(p[0] for p in parts)
            b, w, blanks = min(p[1] for p in parts), max(p[2] for p in parts), blanks or any(p[3] for p in parts)
        elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
            o, b, w, more = _shape(arg[3] if name == "SUBPATTERN" else arg)
            blanks = blanks or more
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            o, b, w, more = _shape(inner)
            if str(most) != "MAXREPEAT":
                w *= most
            elif _of_blanks(inner):
                w, more = BLANKS, True
            else:
                raise _Open
            o, b, blanks = None if o is None else o * least, b if least else 0, blanks or more
        else:
            raise _Open
        run = 0 if o is None else run + o
        only = None if only is None or o is None else only + o
        best, width = max(best, b, run), width + w
    return only, best, width, blanks


def digits_of(pattern: str) -> tuple[int, int, bool] | None:
    """(digits that stand in a row in every match, greatest width of a match, whether that leans on BLANKS); None where there is no such bound."""
    try:
        _, k, width, blanks = _shape(re._parser.parse(pattern))
    except _Open:
        return None
    return (k, 1 << (width - 1).bit_length(), blanks) if k and width else None


class Zones:
    """Where in a text a pattern that needs digits can match: around runs of enough of them, a match's width to both sides and one sign more.
    Every match lies within, and what decides on it as well, so a search of the zones alone finds what a search of the text does."""

    def __init__(self, text: str):
        self.runs, self.size, self.known, self._blanks, self.text = [m.span() for m in _DIGITS.finditer(text)], len(text), {}, None, text

    def of(self, need: tuple[int, int, bool] | None) -> list[tuple[int, int]]:
        if need is None:
            return [(0, self.size)]
        if need[2] and self._blanks is None:
            self._blanks = _LONG.search(self.text) is not None
        if need[2] and self._blanks:
            return [(0, self.size)]
        found = self.known.get(need[:2])
        if found is None:
            found, (k, width) = [], need[:2]
            for a, b in self.runs:
                if b - a >= k:
                    a, b = max(0, a - width - 1), min(self.size, b + width + 1)
                    if found and a <= found[-1][1]:
                        found[-1] = (found[-1][0], b)
                    else:
                        found.append((a, b))
            self.known[need[:2]] = found
        return found


class Cues:
    """For patterns in order, which of them may match a text."""

    def __init__(self, patterns: Sequence[str | None]):
        import ahocorasick

        self.always, masks = 0, {}
        for i, p in enumerate(patterns):
            words = words_of(p) if p else None
            if words is None:
                self.always |= 1 << i
            for w in words or ():
                masks[w] = masks.get(w, 0) | 1 << i
        # single signs stand in most texts, and many times: each is looked for by itself
        self.signs = [(w, mask) for w, mask in masks.items() if len(w) == 1]
        words = {w: mask for w, mask in masks.items() if len(w) > 1}
        self.automaton = ahocorasick.Automaton() if words else None
        for w, mask in words.items():
            self.automaton.add_word(w, mask)
        if words:
            self.automaton.make_automaton()

    def of(self, text: str) -> int:
        """Bits of the patterns that may match."""
        seen, text = self.always, fold(text)
        for sign, mask in self.signs:
            if sign in text:
                seen |= mask
        if self.automaton is not None:
            for _, mask in self.automaton.iter(text):
                seen |= mask
        return seen
