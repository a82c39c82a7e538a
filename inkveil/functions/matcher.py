"""Detection in plain Python, for callers that have one text at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

from .catalogue import Pattern
from .config import Config

_WEIGHTS = (3, 7, 1)


def digits(s: str) -> list[int]:
    return [int(c) for c in s if c.isdigit()]


def luhn(s: str) -> bool:
    found = digits(s)
    doubled = [d if i % 2 == len(found) % 2 else 0 for i, d in enumerate(found)]
    return 13 <= len(found) <= 19 and (sum(found) + sum(doubled) - 9 * sum(d > 4 for d in doubled)) % 10 == 0


def aba(s: str) -> bool:
    found = digits(s)
    total = sum(d * _WEIGHTS[i % 3] for i, d in enumerate(found))
    return len(found) == 9 and total > 0 and total % 10 == 0


CHECKS = {"luhn": luhn, "aba": aba}


@lru_cache(1024)
def _compiled(p: Pattern) -> re.Pattern:
    return re.compile(p.body, re.I if p.any_case else 0)


def _candidates(text: str, patterns: tuple[Pattern, ...]) -> Iterator[tuple[Pattern, str]]:
    """What each pattern finds in a text and in its copy with white space squeezed."""
    sources = dict.fromkeys((text, " ".join(text.split())))
    for p, source in product(patterns, sources):
        yield from ((p, m[p.group].strip()) for m in _compiled(p).finditer(source))


def _stands(p: Pattern, s: str, exclude: tuple[str, ...]) -> bool:
    low = s.lower()
    return bool(s) and len(digits(s)) >= p.digits and (p.check is None or CHECKS[p.check](s)) and not any(x in low for x in exclude)


def find(text: str | None, config: Config) -> list[tuple[str, str]]:
    """Distinct (category, match), longest first; null finds nothing."""
    kept = ((p.category, s) for p, s in _candidates(text or "", config.patterns) if _stands(p, s, config.exclude))
    return sorted(dict.fromkeys(kept), key=lambda x: -len(x[1]))
