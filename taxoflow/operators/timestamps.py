"""Timestamps in many notations and zones, brought to instants in UTC.

Each value is reduced to a shape mask by character class (digits, letters, the rest as it is). The few
hundred distinct masks are read by a grammar once each; the values of a mask then share all positions, so
numbers are cut out of a code-point matrix and converted by array arithmetic. Wall times become instants
through the transition tables of ``taxoflow.functions.zones``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflow.functions.zones import ZoneTable, database_version, zone_table

# Words in dates and what they stand for.
MONTHS = [
    "jan january januar",
    "feb february februar",
    "mar march mär märz",
    "apr april",
    "may mai",
    "jun june juni",
    "jul july juli",
    "aug august",
    "sep sept september",
    "oct october okt oktober",
    "nov november",
    "dec december dez dezember",
]
WEEKDAYS = "mon tue wed thu fri sat sun monday tuesday wednesday thursday friday saturday sunday"
MERIDIEMS = {"am": 0, "pm": 12, "오전": 0, "오후": 12}
MARKS = {"t": "T", "w": "W", "st": "O", "nd": "O", "rd": "O", "th": "O", "uhr": "U", "년": "Y", "월": "X", "일": "K", "시": "H", "분": "I", "초": "S"}

#: Most zone labels that are handed to the workers as a dictionary; a table of labels beyond it is an error.
MAX_LABELS = 10_000

# The grammar reads signatures: d for a digit, a capital letter for a class of word, ? for any other word.
_DATES = [
    r"(?P<y>dddd)(?P<s1>[-/.])(?P<m>dd?)(?P=s1)(?P<d>dd?)",
    r"(?P<y>dddd)(?P<m>dd)(?P<d>dd)",
    r"(?P<y>dddd)-?W(?P<w>dd)-?(?P<k>d)",
    r"(?P<y>dddd)Y ?(?P<m>dd?)X ?(?P<d>dd?)K",
    r"(?P<a>dd?)(?P<s1>[-/.])(?P<b>dd?)(?P=s1)(?P<c>dddd|dd)",
    r"(?:D\.?,? )?(?P<d>dd?)(?:O|\.)?[ -]?(?P<M>M)\.?,?[ -](?P<y>dddd|dd)",
    r"(?:D\.?,? )?(?P<M>M)\.? (?P<d>dd?)O?,? (?P<y>dddd)",
]
_TIMES = [
    r"(?P<h>dd?):(?P<i>dd)(?::(?P<s>dd)(?:[.,](?P<f>d+))?)?(?: ?(?P<p>P))?",
    r"(?P<h>dd)(?P<i>dd)(?P<s>dd)?(?:[.,](?P<f>d+))?",
    r"(?P<h>dd?)\.(?P<i>dd) ?U",
    r"(?P<p>P) ?(?P<h>dd?)H(?: ?(?P<i>dd?)I)?(?: ?(?P<s>dd?)S)?",
]
_ZONE = r"(?: ?(?:\[(?P<z1>Z)\]|\((?P<z2>Z)\)|(?P<z3>Z)|(?P<g>[+-])(?P<oh>dd):?(?P<om>dd)?|\[?(?P<r>[A-Z?](?:[/_+-][A-Z?])+)\]?))?"
_FORMS = [re.compile(f"{d}(?:(?:T|,? ){t})?{_ZONE}") for d in _DATES for t in _TIMES]
_TOKENS = re.compile(r"9+|a+|[^9a]")
_ASCII = bytes.maketrans(
    bytes(range(128)),
    bytes(57 if 48 <= c <= 57 else 97 if chr(c).isalpha() else 33 if c in (57, 97) else c for c in range(128)),
)
_NONE = np.iinfo(np.int64).min
#: Offsets further from UTC than this, in seconds, are impossible.
_MAX_OFFSET = 18 * 3600


def _mask(value: str) -> str:
    """Digits as 9, letters as a, all else itself."""
    try:
        return value.encode("ascii").translate(_ASCII).decode("ascii")
    except UnicodeEncodeError:
        return "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else "#" if c.isdigit() else c for c in value)


def _lexicon(labels: dict[str, int]) -> dict[str, tuple[str, int]]:
    """Word (lower case) to its class letter and number. Months and the like win over labels."""
    words = {label.lower(): ("Z", int(minutes) * 60) for label, minutes in labels.items()}
    words |= {w: ("D", 0) for w in WEEKDAYS.split()}
    words |= {w: ("M", n) for n, names in enumerate(MONTHS, 1) for w in names.split()}
    words |= {w: ("P", n) for w, n in MERIDIEMS.items()}
    return words | {w: (c, 0) for w, c in MARKS.items()}


@lru_cache(maxsize=4096)
def _tokens(mask: str) -> list[tuple[str, int, int]]:
    return [(m[0][0], m.start(), m.end()) for m in _TOKENS.finditer(mask)]


@lru_cache(maxsize=65536)
def _form(mask: str, classes: str) -> dict[str, tuple[int, int]] | None:
    """Positions in the value of every part that the grammar finds, or None."""
    signature, spans, words = [], [], iter(classes)
    for kind, start, end in _tokens(mask):
        if kind == "9":
            signature += "d" * (end - start)
            spans += [(i, i + 1) for i in range(start, end)]
        else:
            signature.append(next(words) if kind == "a" else kind)
            spans.append((start, end))
    text = "".join(signature)
    if text in ("d" * 10, "d" * 13, "d" * 16):
        return {"epoch": (spans[0][0], spans[-1][1])}
    for form in _FORMS:
        if m := form.fullmatch(text):
            return {k: (spans[m.start(k)][0], spans[m.end(k) - 1][1]) for k, v in m.groupdict().items() if v}
    return None


class Parsed:
    """Parts of distinct values, as arrays; ``_NONE`` where a part is missing."""

    def __init__(self, n: int):
        self.year, self.month, self.day, self.a, self.b, self.c = (np.full(n, _NONE) for _ in range(6))
        self.wide = np.zeros(n, dtype=bool)  # c has four figures
        self.clock = np.zeros(n, dtype=np.int64)  # microseconds into the day
        self.offset, self.epoch = np.full(n, _NONE), np.full(n, _NONE)
        self.region = np.full(n, -1, dtype=np.int64)
        self.regions: list[str] = []
        self.fine = np.zeros(n, dtype=bool)


def _parse(values: list[str | None], words: dict[str, tuple[str, int]]) -> Parsed:
    """Read distinct values by the grammar, mask by mask."""
    out = Parsed(len(values))
    by_mask: dict[str, list[int]] = {}
    stripped = [None if v is None else v.strip() for v in values]
    for i, v in enumerate(stripped):
        if v:
            by_mask.setdefault(_mask(v), []).append(i)
    regions: dict[str, int] = {}
    for mask, at in by_mask.items():
        places = [(s, e) for kind, s, e in _tokens(mask) if kind == "a"]
        groups: dict[str, list[int]] = {}
        if places:
            for i in at:
                v = stripped[i]
                classes = "".join([words.get(v[s:e].lower(), "??")[0] for s, e in places])
                groups.setdefault(classes, []).append(i)
        else:
            groups[""] = at
        for classes, rows in groups.items():
            if (form := _form(mask, classes)) is not None:
                _convert(out, form, [stripped[i] for i in rows], np.array(rows), words, regions)
    out.regions = list(regions)
    return out


def _convert(out: Parsed, form: dict, texts: list[str], rows: np.ndarray, words: dict, regions: dict[str, int]) -> None:
    """Values of one form, by array arithmetic on their code points."""
    n = len(texts)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).reshape(n, -1).astype(np.int64) - 48

    def number(part: str, default: int = 0) -> np.ndarray:
        if part not in form:
            return np.full(n, default, dtype=np.int64)
        s, e = form[part]
        return codes[:, s:e] @ (10 ** np.arange(e - s - 1, -1, -1, dtype=np.int64))

    def word(part: str) -> np.ndarray:
        s, e = form[part]
        return np.array([words[t[s:e].lower()][1] for t in texts], dtype=np.int64)

    if "epoch" in form:
        s, e = form["epoch"]
        out.epoch[rows] = number("epoch") * {10: 1_000_000, 13: 1000, 16: 1}[e - s]
        out.fine[rows] = True
        return
    fine = np.ones(n, dtype=bool)
    if "w" in form:
        year, week, weekday = number("y"), number("w"), number("k")
        fourth = (year - 1970).astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64) + 3
        monday = fourth - (fourth + 3) % 7 + (week - 1) * 7
        fine &= (weekday >= 1) & (weekday <= 7) & (week >= 1)
        fine &= (monday + 3).astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64) + 1970 == year
        day = (monday + weekday - 1).astype("datetime64[D]")
        month = day.astype("datetime64[M]")
        out.year[rows] = day.astype("datetime64[Y]").astype(np.int64) + 1970
        out.month[rows] = month.astype(np.int64) % 12 + 1
        out.day[rows] = (day - month.astype("datetime64[D]")).astype(np.int64) + 1
    elif "a" in form:
        out.a[rows], out.b[rows], out.c[rows] = number("a"), number("b"), number("c")
        out.wide[rows] = form["c"][1] - form["c"][0] == 4
    else:
        out.year[rows] = number("y") + (2000 if form["y"][1] - form["y"][0] == 2 else 0)
        out.month[rows] = word("M") if "M" in form else number("m")
        out.day[rows] = number("d")
    hour, minute, second = number("h"), number("i"), number("s")
    if "p" in form:
        fine &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + word("p")
    fine &= (hour <= 23) & (minute <= 59) & (second <= 59)
    micros = np.zeros(n, dtype=np.int64)
    if "f" in form:
        s, e = form["f"]
        kept = min(e, s + 6)
        micros = codes[:, s:kept] @ (10 ** np.arange(5, 5 - (kept - s), -1, dtype=np.int64))
    out.clock[rows] = ((hour * 60 + minute) * 60 + second) * 1_000_000 + micros
    if "g" in form:
        minutes = number("om")
        sign = np.where(codes[:, form["g"][0]] == ord("-") - 48, -1, 1)
        off = sign * (number("oh") * 3600 + minutes * 60)
        fine &= (minutes <= 59) & (np.abs(off) <= _MAX_OFFSET)
        out.offset[rows] = off
    elif label := next((z for z in ("z1", "z2", "z3") if z in form), None):
        out.offset[rows] = word(label)
    elif "r" in form:
        s, e = form["r"]
        out.region[rows] = [regions.setdefault(t[s:e], len(regions)) for t in texts]
    out.fine[rows] = fine


def to_micros(values: pa.Array, orders: pa.Array, zones: pa.Array, words: dict, tables: dict[str, ZoneTable | None]) -> np.ndarray:
    """Microseconds since 1970 UTC of each value, ``_NONE`` where it names no full, possible day."""

    def encoded(x: pa.Array) -> tuple[list, np.ndarray]:
        x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        d = x.dictionary_encode(null_encoding="encode")
        return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False)

    def table(zone: str | None) -> ZoneTable | None:
        if zone not in tables:
            found = zone_table([zone]) if zone and not zone.startswith(("/", ".")) else None
            tables[zone] = found if found and zone in found.walls else None
        return tables[zone]

    distinct, at = encoded(values)
    p = _parse(distinct, words)
    order_names, order_at = encoded(orders)
    zone_names, zone_at = encoded(zones)
    year, month, day = p.year[at], p.month[at], p.day[at]
    figures = p.a[at] != _NONE
    if figures.any():
        a, b, c, wide = p.a[at], p.b[at], p.c[at], p.wide[at]
        code = np.array([{"DMY": 0, "MDY": 1, "YMD": 2}.get((o or "").upper(), 3) for o in order_names] or [3])[order_at]
        full = np.where(wide, c, c + 2000)
        last = figures & (code != 2)
        year = np.where(last, full, np.where(figures, a + 2000, year))
        month = np.where(figures, np.where(code == 1, a, b), month)
        day = np.where(last, np.where(code == 1, b, a), np.where(figures, c, day))
        # A year of four figures can only stand last; a desk that puts it first then means day and month in its order backwards.
        turned = figures & (code == 2) & wide
        year, month, day = np.where(turned, c, year), np.where(turned, b, month), np.where(turned, a, day)
        year = np.where(figures & (code == 3), _NONE, year)
    epoch = p.epoch[at]
    fine = p.fine[at] & (epoch == _NONE) & (year >= 1) & (year <= 9999) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31)
    y, m, d = np.where(fine, year, 1970), np.where(fine, month, 1), np.where(fine, day, 1)
    first = ((y - 1970) * 12 + m - 1).astype("datetime64[M]")
    start = first.astype("datetime64[D]").astype(np.int64)
    fine &= d <= (first + 1).astype("datetime64[D]").astype(np.int64) - start
    wall = (start + d - 1) * 86_400_000_000 + p.clock[at]
    seconds = wall // 1_000_000
    offset = p.offset[at].copy()
    open_ = fine & (offset == _NONE)
    region = p.region[at]
    for names, index, which in ((p.regions, region, open_ & (region >= 0)), (zone_names, zone_at, open_ & (region < 0))):
        for k in np.unique(index[which]):
            rows = np.flatnonzero(which & (index == k))
            if (found := table(names[k])) is not None:
                offset[rows] = found.offset(names[k], seconds[rows])
    fine &= offset != _NONE
    return np.where(fine, wall - np.where(fine, offset, 0) * 1_000_000, epoch)


def normalise_timestamps(
    df: DataFrame, key: str, fields: list[str], desks: DataFrame, desk_key: str, labels: DataFrame, zone: str = "time_zone", order: str = "date_order"
) -> DataFrame:
    """One row (``key``, ``field``, ``utc``) per value of ``fields`` that names a full, possible calendar day.

    ``utc`` is text like 2024-05-06T07:08:09.000000Z. A zone, offset or label within a value counts, else the
    zone of the row's desk; all-figure dates not beginning with a four-figure year follow the desk's order of
    day, month and year. No clock time means 00:00; digits past microseconds are cut off; ten, thirteen or
    sixteen figures alone count seconds, milliseconds or microseconds since 1970 UTC. A wall time that occurs
    twice means the earlier instant, one that is skipped takes the offset from before the change.

    Null, blank, incomplete and impossible values, clock times beyond 23:59:59, unknown zone names, and values
    that need a desk which is unknown or has no zone or order, give no row. Repeated rows give repeated
    results, an empty table an empty one; other columns are not read. ``desks`` and ``labels`` are lookup
    tables: desks are joined (Catalyst broadcasts them where they are small), labels may have up to
    ``MAX_LABELS`` rows, or an error is raised. A label given twice counts with its smallest offset.
    """
    spark = df.sparkSession
    found = labels.select("label", "utc_offset_minutes").dropna().limit(MAX_LABELS + 1).collect()
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} zone labels")
    words = _lexicon({r[0]: r[1] for r in sorted(found, key=lambda r: (r[0], -r[1]))})
    version = database_version()
    desk = desks.select(F.col(desk_key).alias("__desk"), F.col(zone).alias("__zone"), F.col(order).alias("__order")).dropna(subset=["__desk"]).dropDuplicates(["__desk"])
    rows = df.select(F.col(key).alias("__key"), F.col(desk_key).alias("__of"), *[F.col(f).cast("string").alias(f"__f{i}") for i, f in enumerate(fields)])
    rows = rows.join(desk, rows["__of"] == desk["__desk"], "left").drop("__of", "__desk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if database_version() != version:
            raise RuntimeError(f"zone data {database_version()} here, {version} on the driver")
        tables: dict[str, ZoneTable | None] = {}
        for batch in batches:
            for i, name in enumerate(fields):
                micros = to_micros(batch.column(f"__f{i}"), batch.column("__order"), batch.column("__zone"), words, tables)
                kept = np.flatnonzero((micros >= -62_135_596_800_000_000) & (micros < 253_402_300_800_000_000))
                if len(kept):
                    utc = pc.strftime(pa.array(micros[kept], type=pa.timestamp("us")), format="%Y-%m-%dT%H:%M:%SZ")
                    yield pa.RecordBatch.from_arrays([batch.column("__key").take(pa.array(kept)), pa.array([name] * len(kept), pa.string()), utc.cast(pa.string())], names=["__key", "field", "utc"])

    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(run, f"__key {kind}, field string, utc string").withColumnRenamed("__key", key)
