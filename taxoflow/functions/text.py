"""Text, date and conversion expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """Trimmed, runs of white space as one blank; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def filled(x: Column) -> Column:
    """The trimmed text, null where it is blank; a text of no-break spaces alone is blank, too."""
    return F.nullif(F.trim(F.regexp_replace(x, " ", " ")), F.lit(""))


def first_filled(*xs: Column) -> Column:
    """The first text that is not blank."""
    return F.coalesce(*[filled(x) for x in xs])


def tokens(x: Column) -> Column:
    """Lower-case runs of a-z and 0-9, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def title_key(x: Column) -> Column:
    """Tokens joined by blanks: the form in which titles are compared."""
    return F.array_join(tokens(x), " ")


def fingerprint(title: Column, date: Column, entities: Column, digits: int = 20) -> Column:
    """Leading hex digits of the SHA-256 of title key, cleaned day and entities' key, joined by bars."""
    parts = F.concat_ws("|", title_key(title), F.substring(clean(date), 1, 10), title_key(entities))
    return F.substring(F.sha2(parts, 256), 1, digits)


def year_of(x: Column) -> Column:
    """The first year of 1900 to 2099 that stands alone in a text."""
    return F.regexp_extract(F.coalesce(x, F.lit("")), r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int")


def month_of(x: Column) -> Column:
    """The first seven characters of an ISO date."""
    return F.substring(x, 1, 7)


def truthy(x: Column) -> Column:
    """True for yes, true and 1 in any case, false for all else."""
    return F.coalesce(F.lower(F.trim(x)).isin("yes", "true", "1"), F.lit(False))


def number(x: Column) -> Column:
    """The text as a double, null where it is none."""
    return F.trim(x).try_cast("double")


def list_of(x: Column) -> Column:
    """Elements of a JSON list, a list in single quotes, or the text itself; none for blank text and nan."""
    t = F.trim(x)
    double = F.from_json(t, "array<string>")
    # Only the quotes around the items of a list in single quotes are changed, so that those inside items stay.
    outer = F.regexp_replace(F.replace(t, F.lit('"'), F.lit('\\"')), r"(?<=[\[,])\s*'|'\s*(?=[,\]])", '"')
    single = F.from_json(outer, "array<string>")
    none = F.lower(F.coalesce(t, F.lit(""))).isin("", "nan", "none")
    return F.when(none, F.array().cast("array<string>")).when(t.startswith("["), F.coalesce(double, single, F.array(t))).otherwise(F.array(t))


def host_of(x: Column) -> Column:
    """Host of a web address without user and port, in lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(x, F.lit("")), r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def without_tags(x: Column) -> Column:
    """Text of a page: tags become blanks, white space is collapsed."""
    return clean(F.regexp_replace(x, "<[^>]*>", " "))


def escaped(x: Column) -> Column:
    """Text safe to stand in HTML."""
    out = F.replace(x, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def shortened(x: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where text was cut."""
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.substring(x, 1, n - 1)), F.lit("…"))).otherwise(x)


def wrapped(x: Column, width: int) -> Column:
    """Lines of at most so many characters, broken at blanks; a longer word stays whole."""
    return F.regexp_replace(F.regexp_replace(x, f"(.{{1,{width}}})( +|$)", "$1\n"), "\n+$", "")


def domain_label(x: Column) -> Column:
    """Label without its number; labels of excluded entries get one name."""
    return F.when(F.trim(x).startswith("X."), F.lit("Uncoded or excluded")).otherwise(F.regexp_replace(F.trim(x), r"^[^.]*\.\s*", ""))


def joined(parts: list[Column], separator: str, most: int) -> Column:
    """Non-blank parts joined, cut at a length."""
    return F.substring(F.concat_ws(separator, *[filled(p) for p in parts]), 1, most)


def flags(named: dict[str, Column], separator: str = "; ") -> Column:
    """Names of the true flags, joined in order."""
    return F.concat_ws(separator, *[F.when(c, F.lit(n)) for n, c in named.items()])
