"""One consistent form for texts that look alike but differ in their characters."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflow.session import checkpointed

# Letters of other alphabets, each before the Latin letter of the same shape. They come before what
# the public table of confusables (``public_prototypes``) has for them.
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX νv οo ρp ϲc ϳj ϹC ͿJ"
CYRILLIC = "ЅS ІI ЈJ АA ВB ЕE КK МM НH ОO РP СC ТT ХX аa еe оo рp сc уy хx ѕs іi јj ҮY ӀI һh ӏl ԁd ԌG ԚQ ԛq ԜW ԝw"
ARMENIAN = "ՕO ՏS հh յj ոn սu օo"
LATIN_FORMS = "ɡg ɑa"
PROTOTYPES = {pair[0]: pair[1] for pair in f"{GREEK} {CYRILLIC} {ARMENIAN} {LATIN_FORMS}".split()}
#: Hyphens of one length; en and em dashes, the minus and the figure dash are longer and stay.
HYPHENS = "\u2010\u2011\ufe63"
#: Characters without ink or width that are neither format characters nor variation selectors.
FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f"


def _prototype(ch: str, public: dict[str, str]) -> str:
    """What stands for one decomposed character: nothing, a blank, a hyphen, a look-alike or itself."""
    if unicodedata.category(ch) == "Cf" or ch in FILLERS or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if ch.isspace():
        return " "
    if ch in HYPHENS:
        return "-"
    kind, *parts = unicodedata.decomposition(ch).split() or [""]
    width = kind in ("<wide>", "<narrow>")
    joined = kind == "<compat>" and ("\ufb00" <= ch <= "\ufb17" or "\u3131" <= ch <= "\u318e" or unicodedata.category(ch) == "Nl")
    if width or joined:
        return "".join(_prototype(chr(int(p, 16)), public) for p in parts)
    return PROTOTYPES.get(ch) or public.get(ch, ch)


def public_prototypes(spark: SparkSession) -> dict[str, str]:
    """Letters of other alphabets by the Latin letter of the same shape, by the public table of confusables.

    The table is that of the ICU release in the session's JVM. Of it are taken the letters of alphabets other than
    Latin whose skeleton is that of an ASCII letter of the same case, since case and Latin letters of other shapes
    do make a difference; I and l, which share a skeleton, are told apart by case. A few hundred entries.
    """
    latin = [*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
    kinds = ("Lu", "Ll", "Lt", "Lo")
    others = [c for c in map(chr, [*range(0x80, 0x3000), *range(0xA000, 0xAC00), *range(0x10000, 0x1D400), *range(0x1E000, 0x20000)]) if unicodedata.category(c) in kinds and not unicodedata.name(c, "LATIN").startswith("LATIN") and not unicodedata.decomposition(c)]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    found = dict(zip([*latin, *others], checker.getSkeleton("\n".join([*latin, *others])).split("\n"), strict=True))
    by_shape: dict[str, str] = {}
    for c in latin:
        by_shape[found[c]] = by_shape.get(found[c], "") + c

    def same_case(c: str) -> str:
        able = by_shape.get(found[c], "")
        if c.isupper() or unicodedata.name(c).startswith("LISU"):
            return "".join(x for x in able if x.isupper())
        return "".join(x for x in able if x.islower() or not c.islower())[-1:]

    return {c: same_case(c) for c in others if same_case(c)}


class _Table(dict):
    """Prototypes by code point, worked out when first met."""

    def __init__(self, public: dict[str, str]):
        self.public = public

    def __missing__(self, code: int) -> str:
        self[code] = found = _prototype(chr(code), self.public)
        return found


_TABLE = _Table({})


def skeleton(text: str | None, table: _Table = _TABLE) -> str | None:
    """Decompose, replace every character by its prototype, decompose again, compose; blanks at the ends go.

    Two texts look alike exactly if their skeletons are equal. Null stays null; a text of nothing visible
    becomes the empty text.
    """
    if text is None:
        return None
    if text.isascii():
        return text.translate(table).strip(" ")
    plain = unicodedata.normalize("NFD", text).translate(table)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", plain)).strip(" ")


def consistent_form(text: Column, spark: SparkSession) -> Column:
    """Column of skeletons, computed on Arrow batches, once wherever the column is used."""
    public = public_prototypes(spark)
    tables: list[_Table] = []

    def skeletons(texts: pa.Array) -> pa.Array:
        if not tables:
            tables.append(_Table(public))
        return pa.array([skeleton(t, tables[0]) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(skeletons, "string").asNondeterministic()(text)


def forms(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(``field``, key, ``value``, ``form``) for every stored value that is neither null nor blank.

    A repeated row gives a repeated result, an empty table an empty one; values of any length are read whole;
    columns other than the key and the fields are not read.
    """
    values = df.select(F.col(key).alias("__key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("__v"))
    values = values.select(F.col("__v.field").alias("field"), "__key", F.col("__v.value").alias("value")).where("value IS NOT NULL")
    return values.withColumn("form", consistent_form(F.col("value"), df.sparkSession)).where("form <> ''").withColumnRenamed("__key", key)


def lookalike_pairs(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(``field``, ``<key>_a`` < ``<key>_b``): rows whose values of the field differ but look alike.

    Only groups with at least two different stored values are joined, by the digest of the form. Rows whose
    values are equal are no pair; null and blank values and null keys never count; repeated rows give each
    pair once.
    """
    rows = forms(df, key, fields).where(F.col(key).isNotNull())
    rows = checkpointed(rows.select("field", F.col(key).alias("id"), F.md5(F.col("form").cast("binary")).alias("form"), F.md5(F.col("value").cast("binary")).alias("value")).distinct())
    several = rows.groupBy("field", "form").agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low <> high")
    rows = rows.join(several.select("field", "form"), ["field", "form"], "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.field") == F.col("b.field")) & (F.col("a.form") == F.col("b.form")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.value") != F.col("b.value")))
    return pairs.select("a.field", F.col("a.id").alias(f"{key}_a"), F.col("b.id").alias(f"{key}_b")).distinct()
