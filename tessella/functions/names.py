"""Names for helper columns."""

from __future__ import annotations


def free(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
