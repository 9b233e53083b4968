"""Naming conventions for columns. Names are driver-side metadata only."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase, digits

def words_of(name: str) -> list[str]:
    """The name cut into words.

    A word starts at an ASCII capital ahead of a small letter, and at one behind
    a small letter or a digit. Other characters start no word.
    """
    words, start = [], 0
    for at in range(1, len(name)):
        before, here, after = name[at - 1], name[at], name[at + 1 : at + 2]
        begins = after and after in ascii_lowercase or before in ascii_lowercase + digits
        if here in ascii_uppercase and begins:
            words.append(name[start:at])
            start = at
    return [*words, name[start:]]


def snake_case(name: str) -> str:
    return "_".join(words_of(name)).lower()


def camel_case(name: str) -> str:
    """Words, and what underscores and spaces part, with a capital each but the first."""
    parts = [p for word in words_of(name) for p in word.replace(" ", "_").split("_")]
    joined = "".join(p.lower().title() for p in parts)
    return joined[:1].lower() + joined[1:]


# The names of the conventions in specs.
CONVENTIONS: dict[str, Callable[[str], str]] = {
    "to_lowercase": str.lower,
    "to_uppercase": str.upper,
    "to_snake_case": snake_case,
    "to_camel_case": camel_case,
    "trim_spaces": str.strip,
}


def check_names(names: list[str]) -> list[str]:
    """Reject empty and repeated names, which a table cannot hold."""
    if not all(names):
        raise ValueError("a column would get an empty name")
    repeated = sorted(n for n, k in Counter(names).items() if k > 1)
    if repeated:
        raise ValueError(f"columns would share a name: {', '.join(repeated)}")
    return names


def distinct_header(cells: list[str | None]) -> list[str]:
    """Header cells as unique names: ``a, a`` becomes ``a, a.1``."""
    names: list[str] = []
    for position, cell in enumerate(cells):
        base = cell if cell else f"Unnamed: {position}"
        name, copy = base, 0
        while name in names:
            copy += 1
            name = f"{base}.{copy}"
        names.append(name)
    return names
