"""Times at which a task is due: six cron fields (second first), @every with a span, or a named schedule."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

#: Named schedules and the names of months and days.
NAMED = {"@yearly": "0 0 0 1 1 *", "@annually": "0 0 0 1 1 *", "@monthly": "0 0 0 1 * *", "@weekly": "0 0 0 * * 0", "@daily": "0 0 0 * * *", "@midnight": "0 0 0 * * *", "@hourly": "0 0 * * * *"}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = "sun mon tue wed thu fri sat".split()
_LIMITS = ((0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 6))
_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600}


@dataclass(frozen=True)
class Every:
    span: timedelta

    def after(self, t: datetime) -> datetime:
        return (t + self.span).replace(microsecond=0)


@dataclass(frozen=True)
class Cron:
    """Allowed seconds, minutes, hours, days, months and weekdays; with both kinds of days restricted, either will do."""

    fields: tuple[frozenset[int], ...]
    any_day: bool
    any_weekday: bool

    def _day(self, t: datetime) -> bool:
        day, weekday = t.day in self.fields[3], (t.weekday() + 1) % 7 in self.fields[5]
        return day and weekday if self.any_day or self.any_weekday else day or weekday

    def after(self, t: datetime) -> datetime:
        t = t.replace(microsecond=0) + timedelta(seconds=1)
        last = t.year + 5
        while t.year <= last:
            if t.month not in self.fields[4]:
                t = (t.replace(day=1, hour=0, minute=0, second=0) + timedelta(days=32)).replace(day=1)
            elif not self._day(t):
                t = t.replace(hour=0, minute=0, second=0) + timedelta(days=1)
            elif t.hour not in self.fields[2]:
                t = t.replace(minute=0, second=0) + timedelta(hours=1)
            elif t.minute not in self.fields[1]:
                t = t.replace(second=0) + timedelta(minutes=1)
            elif t.second not in self.fields[0]:
                t += timedelta(seconds=1)
            else:
                return t
        raise ValueError("no such time within five years")


def _field(text: str, low: int, high: int, names: list[str]) -> frozenset[int]:
    out: set[int] = set()
    for part in text.lower().split(","):
        m = re.fullmatch(r"(\*|\?|\w+)(?:-(\w+))?(?:/(\d+))?", part)
        if not m:
            raise ValueError(f"bad cron field {text!r}")

        def number(x: str) -> int:
            n = names.index(x) + low if x in names else int(x) if x.isdigit() else -1
            if not low <= n <= high:
                raise ValueError(f"{x!r} is outside of {low} to {high}")
            return n

        first = low if m[1] in "*?" else number(m[1])
        last = number(m[2]) if m[2] else high if m[1] in "*?" or m[3] else first
        step = int(m[3] or 1)
        if last < first or not step:
            raise ValueError(f"bad cron field {text!r}")
        out.update(range(first, last + 1, step))
    return frozenset(out)


def parse(text: str) -> Cron | Every:
    text = NAMED.get(text.strip().lower(), text.strip())
    if text.lower().startswith("@every "):
        parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h)", text[7:])
        if not parts or "".join(a + b for a, b in parts) != text[7:].strip():
            raise ValueError(f"bad span in {text!r}")
        return Every(max(timedelta(seconds=1), timedelta(seconds=sum(float(a) * _UNITS[b] for a, b in parts))))
    fields = text.split()
    if len(fields) == 5:  # without day of the week
        fields.append("*")
    if len(fields) != 6:
        raise ValueError(f"{text!r} has not six fields")
    sets = tuple(_field(f, *limits, names) for f, limits, names in zip(fields, _LIMITS, ([], [], [], [], MONTHS, DAYS), strict=True))
    return Cron(sets, fields[3][0] in "*?", fields[5][0] in "*?")
