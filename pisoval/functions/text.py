"""Text normalisation and windowed pattern matching as Column expressions."""
from __future__ import annotations

import re
import string
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, functions as F

from ..fixed_values import TEXT_WINDOW


@lru_cache
def _ascii_tables() -> tuple[str, str, dict[str, str]]:
    """What each non-ASCII code point leaves after compatibility decomposition.

    Decomposition acts per code point and combining marks are dropped, so the
    whole rule is a table: single replacements, and longer expansions.
    """
    source, target, longer = [], [], {}
    for point in range(128, sys.maxunicode + 1):
        left = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if len(left) == 1:
            source.append(chr(point))
            target.append(left)
        elif left:
            longer[chr(point)] = left
    return "".join(source), "".join(target), longer


def _ranges(points: list[int]) -> str:
    """The code points as ranges of a Java character class."""
    ranges: list[list[int]] = []
    for point in points:
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


@lru_cache
def _longer_class() -> str:
    """Characters that expand; a coarse test in front spares plain letters the many ranges."""
    points = sorted(map(ord, _ascii_tables()[2]))
    latin = [p for p in points if p < 256]
    coarse = _ranges(latin) + f"\\x{{{min(p for p in points if p > 255):x}}}-\\x{{10ffff}}"
    return f"[{coarse}&&[{_ranges(points)}]]"


def _expand(c: Column) -> Column:
    """Replace the characters that become several, looking up only those characters."""
    longer = _ascii_tables()[2]
    table = F.map_from_arrays(F.split(F.lit("\x01".join(longer)), "\x01"), F.split(F.lit("\x01".join(longer.values())), "\x01"))
    pieces = F.split(c, _longer_class(), -1)
    found = F.regexp_extract_all(c, F.lit(_longer_class()), F.lit(0))
    joined = F.zip_with(pieces, found, lambda p, f: F.concat(p, F.coalesce(F.try_element_at(table, f), F.lit(""))))
    return F.when(c.rlike(_longer_class()), F.array_join(joined, "")).otherwise(c)


def _fold(c: Column) -> Column:
    """ASCII form of a text; only its non-ASCII runs go through the tables."""
    source, target, _ = _ascii_tables()
    other = r"[^\x00-\x7F]+"
    runs = F.array_join(F.regexp_extract_all(c, F.lit(other), F.lit(0)), "\x00")
    folded = F.regexp_replace(F.translate(_expand(runs), source, target), other, "")
    joined = F.zip_with(F.split(c, other, -1), F.split(folded, "\x00", -1),
                        lambda plain, run: F.concat(plain, F.coalesce(run, F.lit(""))))
    return F.array_join(joined, "")


@lru_cache
def _plain_table() -> tuple[str, str]:
    """Every character that one lower-case ASCII character replaces, capitals and white space among them."""
    source, target, _ = _ascii_tables()
    spaces = "".join(map(chr, (*range(9, 14), *range(28, 32))))
    return source + string.ascii_uppercase + spaces, target.lower() + string.ascii_lowercase + " " * len(spaces)


@lru_cache
def _latin_table() -> tuple[str, str]:
    """The part of that table for characters of one or two octets that are usual in Western texts: a small map to look in, and to compare."""
    pairs = [(a, b) for a, b in zip(*_plain_table()) if a < "\u0100"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that it names more than once, the value being computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _single_spaces(t: Column) -> Column:
    """Runs of spaces become one; a pattern looks only at texts with runs of three or more."""
    return _named(F.replace(t, F.lit("  "), F.lit(" ")), lambda s: F.when(s.contains("  "), F.regexp_replace(s, " {2,}", " ")).otherwise(s))


def normalize_text(c: Column) -> Column:
    """Unaccented lower-case ASCII with single spaces; NULL becomes ''.

    A small table serves most texts, the whole one others. Those left with characters that become several, or none, are longer in octets than
    in characters.
    """
    def unless_ascii(s: Column, change: Callable[[Column], Column]) -> Column:
        return F.when(F.octet_length(s) > F.char_length(s), change(s)).otherwise(s)
    plain = _named(F.translate(c, *_latin_table()), lambda s: unless_ascii(s, lambda o: _named(
        F.translate(o, *_plain_table()), lambda r: unless_ascii(r, lambda x: F.lower(_fold(x))))))
    return F.coalesce(_single_spaces(plain), F.lit(""))


def contains_any(t: Column, words: tuple[str, ...]) -> Column:
    """Plain substring test, far cheaper than a pattern."""
    return reduce(lambda a, b: a | b, [t.contains(w) for w in words])


def mentions(t: Column, pattern: str, cancelled_by: str, words: tuple[str, ...]) -> Column:
    """The text has the pattern and nowhere the cancelling one; `words` are those no match can lack."""
    return contains_any(t, words) & t.rlike(pattern) & ~t.rlike(cancelled_by)


def mentions_part(t: Column, parts: list[tuple[str, str | None]], cancelled_by: str) -> Column:
    """The text has some part and nowhere the cancelling pattern; a part is a word and, unless the word says all, a pattern that no text
    without the word has."""
    found = [t.contains(word) & t.rlike(pattern) if pattern else t.contains(word) for word, pattern in parts]
    return reduce(lambda a, b: a | b, found) & ~t.rlike(cancelled_by)


class Windows:
    """All non-overlapping matches of a pattern with the text around each.

    One regular expression carries the look-around windows as capture groups, so
    every array costs one linear scan however many matches the text holds.
    Patterns must not use back-references or named groups.  `starts` lists the
    letters a match can begin with, so that other positions are passed over fast.
    """

    def __init__(self, t: Column, pattern: str, width: int = TEXT_WINDOW, starts: str = ""):
        groups = re.compile(pattern).groups
        self._t = t
        first = f"(?=[{starts}])" if starts else ""
        # A look-behind of one length is tried once; one of many lengths walks the window anew for each. So full windows and those
        # that the text's beginning cuts short are two groups, of which the other one is empty.
        self._regex = (rf"(?s){first}(?=(?:{pattern}))(?:(?<=(.{{{width}}}))|(?<=(^.{{0,{width - 1}}})))"
                       rf"(?:{pattern})(?=(.{{0,{width}}}))")
        self.before = F.zip_with(self._all(groups + 1), self._all(groups + 2), lambda full, short: F.concat(full, short))
        self.match = self._all(0)
        self.after = self._all(2 * groups + 3)

    def _all(self, group: int) -> Column:
        return F.regexp_extract_all(self._t, F.lit(self._regex), F.lit(group))

    def structs(self) -> Column:
        return F.arrays_zip(self.before.alias("before"), self.match.alias("match"), self.after.alias("after"))
