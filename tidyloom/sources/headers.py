"""Column names fit to be referred to: none empty, none twice."""

from __future__ import annotations

from collections.abc import Iterable

# Name given to a column without one, and the mark of such columns.
UNNAMED = "Coluna {number}"
UNNAMED_MARK = "__unnamed"


def normalize_headers(names: Iterable[str | None]) -> list[str]:
    """Strip names, number the nameless, and tell repeats apart as ``name (2)``."""
    plain = []
    for number, raw in enumerate(names, start=1):
        name = "" if raw is None else str(raw).strip()
        blank = not name or name.lower().startswith(UNNAMED_MARK)
        plain.append(UNNAMED.format(number=number) if blank else name)
    taken: set[str] = set()
    result = []
    for name in plain:
        candidate, copy = name, 1
        while candidate in taken:
            copy += 1
            candidate = f"{name} ({copy})"
        taken.add(candidate)
        result.append(candidate)
    return result
