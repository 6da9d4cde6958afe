"""Instants of queries: absolute text in five forms (Asia/Shanghai unless an offset is given) and
relative tokens that need a fixed now."""

from __future__ import annotations

import re
from datetime import datetime
from zoneinfo import ZoneInfo

ZONE = ZoneInfo("Asia/Shanghai")
# The accepted forms.
FORMS = ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d")
RELATIVE = re.compile(r"(?:last_|-)(\d+)([dh])|p(\d+)(d)|pt(\d+)(h)|now")
UNIT_MS = {"d": 86_400_000, "h": 3_600_000}


class NeedNow(ValueError):
    """A relative instant was given without a fixed now."""


def parse_absolute(text: str) -> int:
    """Epoch milliseconds; ValueError if no form fits."""
    for form in FORMS:
        try:
            found = datetime.strptime(text.strip(), form)
        except ValueError:
            continue
        return round((found if found.tzinfo else found.replace(tzinfo=ZONE)).timestamp() * 1000)
    raise ValueError(f"not an instant: {text!r}")


def parse_instant(text: str | None, now_ms: int | None = None) -> int:
    """An absolute instant, or now, last_<n>d, last_<n>h, -<n>d, -<n>h, p<n>d, pt<n>h before now."""
    if not text or not text.strip():
        raise ValueError("an instant is missing")
    m = RELATIVE.fullmatch(text.strip().lower())
    if not m:
        return parse_absolute(text)
    if not now_ms or now_ms <= 0:
        raise NeedNow(f"relative instant {text.strip()!r} needs a fixed now")
    n, unit = next(((m[i], m[i + 1]) for i in (1, 3, 5) if m[i]), ("0", "d"))
    return now_ms - int(n) * UNIT_MS[unit]
