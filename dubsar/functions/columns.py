"""Small builders of Column expressions. All built-in functions; absent is '' and never null."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(term: str) -> str:
    """A term as a literal piece of a Java or Python pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def any_of(terms: Iterable[str]) -> str:
    """A group of alternatives, longest first."""
    return "(?:" + "|".join(q(t) for t in sorted(terms, key=len, reverse=True)) + ")"


#: Control characters that part the entries of a literal and the two sides of one.
_PAIR, _SIDE = "\x1e", "\x1f"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Every character that counts as white space.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.btrim(c, F.lit(WHITE))


def words(c: Column) -> Column:
    """Pieces between white space, none empty."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def has(c: Column, *parts: str) -> Column:
    """Whether any part occurs."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def starts(c: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.startswith(c, F.lit(p))
    return out


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, '' without one."""
    return F.regexp_extract(c, pattern, group)


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def chain(pairs: Iterable[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first condition that holds."""
    out = None
    for cond, value in pairs:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return default if out is None else out.otherwise(default)


def lookup(c: Column, table: Mapping[str, object], default: object = "") -> Column:
    """table[c], else default. The table is one literal, folded to a map when the plan is made."""
    if not table:
        return F.lit(default)
    pairs = F.str_to_map(F.lit(_PAIR.join(f"{k}{_SIDE}{v}" for k, v in table.items())), F.lit(_PAIR), F.lit(_SIDE))
    value = pairs[c] if isinstance(default, str) else pairs[c].cast("int")
    return F.coalesce(value, F.lit(default))


def group_of(c: Column, groups: Mapping[str, list[str]], default: str = "other") -> Column:
    """The first group of which some substring occurs."""
    return chain(((has(c, *parts), F.lit(name)) for name, parts in groups.items()), F.lit(default))


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def strings(values: Iterable[str]) -> Column:
    """An array of fixed strings: one literal, folded when the plan is made."""
    return F.split(F.lit(_PAIR.join(values)), _PAIR)


def listed(c: Column, lower: bool = False) -> Column:
    """The parts of a field that ';' separates, trimmed, none empty."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip), lambda x: x != "")
    return F.transform(parts, F.lower) if lower else parts


def whole(c: Column) -> Column:
    """An integer written in a string, 0 if it is none."""
    return F.coalesce(F.when(matches(c, r"^\s*[+-]?\d+\s*$"), c.try_cast("long")), F.lit(0).cast("long"))


def total(items: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + of(x))
