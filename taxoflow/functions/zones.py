"""Zone transition tables, taken from one release of the IANA database and handed to all workers."""

from __future__ import annotations

import importlib.resources
import os
import re
import struct
import zoneinfo
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np

#: Years that the rule at the end of a zone's data is applied to; text dates have four-figure years.
LAST_YEAR = 9999
_EPOCH = date(1970, 1, 1).toordinal()


@dataclass(frozen=True)
class ZoneTable:
    """Per zone the wall times from which an offset holds, and the offsets in seconds.

    ``walls[z][i]`` is the wall second at which ``offsets[z][i + 1]`` begins to hold. It is the later of
    the two wall readings at a change, so that a wall time occurring twice takes the earlier instant and
    one skipped takes the offset from before the change.
    """

    version: str
    walls: dict[str, np.ndarray]
    offsets: dict[str, np.ndarray]

    def offset(self, zone: str, wall_seconds: np.ndarray) -> np.ndarray:
        return self.offsets[zone][np.searchsorted(self.walls[zone], wall_seconds, side="right")]


def database_version() -> str:
    """Release of the IANA data in use, such as 2025b; 'system' where the platform does not tell."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "system"


def _data(zone: str) -> bytes:
    """The compiled data of a zone, from the system's folders or else the ``tzdata`` package."""
    if not re.fullmatch(r"[A-Za-z0-9_+\-]+(/[A-Za-z0-9_+\-]+)*", zone):
        raise zoneinfo.ZoneInfoNotFoundError(zone)
    for folder in zoneinfo.TZPATH:
        path = os.path.join(folder, *zone.split("/"))
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read()
    try:
        return importlib.resources.files("tzdata.zoneinfo").joinpath(*zone.split("/")).read_bytes()
    except (ModuleNotFoundError, FileNotFoundError, IsADirectoryError, NotADirectoryError) as e:
        raise zoneinfo.ZoneInfoNotFoundError(zone) from e


def _parsed(data: bytes) -> tuple[list[int], list[int], str]:
    """Instants of change, the offsets before and after them, and the closing rule of compiled zone data."""

    def header(at: int) -> tuple[int, list[int]]:
        if data[at : at + 4] != b"TZif":
            raise ValueError("no zone data")
        return data[at + 4], list(struct.unpack(">6l", data[at + 20 : at + 44]))

    version, (utc, std, leap, times, kinds, chars) = header(0)
    at, width = 44, 4
    if version >= 50:
        at += times * 5 + kinds * 6 + chars + leap * 8 + std + utc
        _, (utc, std, leap, times, kinds, chars) = header(at)
        at, width = at + 44, 8
    instants = list(struct.unpack(f">{times}{'q' if width == 8 else 'l'}", data[at : at + times * width]))
    at += times * width
    index = list(data[at : at + times])
    at += times
    info = [struct.unpack(">lBB", data[at + 6 * i : at + 6 * i + 6]) for i in range(kinds)]
    at += kinds * 6 + chars + leap * (width + 4) + std + utc
    first = next((off for off, summer, _ in info if not summer), info[0][0])
    return instants, [first, *[info[i][0] for i in index]], data[at:].decode("ascii").strip("\n") if width == 8 else ""


def _seconds(text: str) -> int:
    sign, h, m, s = re.fullmatch(r"([+-]?)(\d+)(?::(\d+))?(?::(\d+))?", text).groups()
    return (-1 if sign == "-" else 1) * (int(h) * 3600 + int(m or 0) * 60 + int(s or 0))


def _day(rule: str, year: int) -> int:
    """Day number, from 1970 on, that a rule names in a year: Mm.w.d, Jn (without leap days) or n (with them)."""
    first = date(year, 1, 1).toordinal() - _EPOCH
    if rule[0] == "M":
        month, week, weekday = (int(x) for x in rule[1:].split("."))
        start = date(year, month, 1)
        ahead = (weekday - start.isoweekday()) % 7 + 7 * (week - 1)
        while (start + timedelta(days=ahead)).month != month:
            ahead -= 7
        return start.toordinal() - _EPOCH + ahead
    if rule[0] == "J":
        leap = date(year, 12, 31).toordinal() - _EPOCH - first == 365
        return first + int(rule[1:]) - 1 + (leap and int(rule[1:]) > 59)
    return first + int(rule)


def _ruled(rule: str, first_year: int) -> list[tuple[int, int]]:
    """Instants of change and offsets after them by a closing rule such as CET-1CEST,M3.5.0,M10.5.0/3."""
    name = r"(?:[A-Za-z]+|<[^>]+>)"
    found = re.fullmatch(rf"{name}([+-]?[\d:]+)(?:{name}([+-]?[\d:]+)?,([^,/]+)(?:/([+-]?[\d:]+))?,([^,/]+)(?:/([+-]?[\d:]+))?)?", rule)
    if not found or not found[3]:
        return []
    winter = -_seconds(found[1])
    summer = -_seconds(found[2]) if found[2] else winter + 3600
    begins, ends = _seconds(found[4] or "2"), _seconds(found[6] or "2")
    once = []
    for year in range(first_year, first_year + 400):
        once.append((_day(found[3], year) * 86400 + begins - winter, summer))
        once.append((_day(found[5], year) * 86400 + ends - summer, winter))
    # The calendar repeats itself every 400 years.
    return [(at + k * 146_097 * 86400, offset) for k in range((LAST_YEAR - first_year) // 400 + 1) for at, offset in sorted(once)]


def _transitions(zone: str) -> tuple[np.ndarray, np.ndarray]:
    """Wall times from which an offset holds, and the offsets: the first, and one for each of them."""
    instants, offsets, rule = _parsed(_data(zone))
    last = instants[-1] if instants else -(1 << 62)
    year = max(1970, (date(1970, 1, 1) + timedelta(seconds=max(0, last))).year)
    for at, offset in _ruled(rule, year):
        if at > last:
            instants.append(at)
            offsets.append(offset)
    if rule and not instants:
        offsets = [-_seconds(re.match(r"(?:[A-Za-z]+|<[^>]+>)([+-]?[\d:]+)", rule)[1])]
    walls = [at + max(before, after) for at, before, after in zip(instants, offsets, offsets[1:])]
    # Changes that leave the offset as it is are none; a wall time is never before an earlier one's.
    kept = [i for i in range(len(walls)) if offsets[i] != offsets[i + 1]]
    return np.maximum.accumulate(np.array([walls[i] for i in kept], dtype=np.int64)), np.array([offsets[0], *[offsets[i + 1] for i in kept]], dtype=np.int64)


_TABLES: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}


def zone_table(zones: list[str]) -> ZoneTable:
    """Table of the given zones that exist; others are left out. Cached per release within the process."""
    version, walls, offsets = database_version(), {}, {}
    for zone in zones:
        key = (version, zone)
        if key not in _TABLES:
            try:
                _TABLES[key] = _transitions(zone)
            except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
                continue
        walls[zone], offsets[zone] = _TABLES[key]
    return ZoneTable(version, walls, offsets)
