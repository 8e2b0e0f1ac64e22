"""Long texts cut into pieces at natural boundaries, with overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflow.llm.bpe import DEFAULT_VOCABULARY, encoder

#: Pieces whose sizes are summed up in one run, and bytes of a text that may be copied for each piece.
RUN, COPIED = 1000, 1 << 16
# Marks of what a token's end is, strongest first; x is inside a character, where nothing is ever cut.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER, INSIDE = (ord(c) for c in "PLSCWKx")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
_PAUSE = np.zeros(256, dtype=bool)
_PAUSE[list(b",;:")] = True
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[list(b"\"')]}")] = True
# Full stops, question and exclamation marks, commas and colons of full width, which no blank follows.
_WIDE_STOPS, _WIDE_PAUSES = "。！？｡", "、，；："


def marks(text: str, raw: bytes, sizes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, bytes]:
    """One mark per token of the text, from its bytes and those of each token; up to each token's end the bytes, on to
    the next whole character, and the characters begun; and the text's bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    ends = np.cumsum(sizes, dtype=np.int64)
    padded = np.concatenate([[10, 10, 10], data, [10, 10, 10, 10]]).astype(np.uint8)
    before2, before, last, following = (padded[ends + i] for i in range(4))
    spaced = _SPACE[following]
    out = np.full(len(ends), CHARACTER, dtype=np.uint8)
    out[spaced | _SPACE[last]] = WORD
    out[spaced & _PAUSE[last]] = CLAUSE
    out[spaced & (_STOP[last] | (_CLOSING[last] & _STOP[before]))] = SENTENCE
    for characters, mark in ((_WIDE_PAUSES, CLAUSE), (_WIDE_STOPS, SENTENCE)):
        for one in filter(text.__contains__, characters):
            x, y, z = one.encode()
            out[(before2 == x) & (before == y) & (last == z)] = mark
    out[last == 10] = LINE
    out[(last == 10) & (before == 10)] = PARAGRAPH
    inside = (following & 0xC0) == 0x80
    out[inside] = INSIDE
    if len(out):
        out[-1] = PARAGRAPH
    characters = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)[ends - 1]
    whole = ends.copy()
    while inside.any():
        whole += inside
        inside = inside & ((padded[whole + 3] & 0xC0) == 0x80)
    return out.tobytes(), whole.astype(np.int32), characters, raw


def _pattern(most: int, overlap: int) -> str:
    """A run of marks that ends at the strongest boundary in its second half, else at the last one before that lies
    beyond the overlap, else at the last character."""
    least, natural = most // 2, ["P", "L", "S", "C", "W"]
    runs = [f".{{{least},{most - 1}}}{m}" for m in natural]
    if overlap < least:
        runs.append(f".{{{overlap},{least - 1}}}[PLSCW]")
    return "|".join([f".{{1,{most}}}\\z", *runs, f".{{0,{most - 1}}}[PLSCWK]", f".{{1,{most}}}"])


def split_long(df: DataFrame, key: str, text: str, limit: int = 512, overlap: int = 64, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Ordered pieces of every text of more than ``limit`` tokens.

    Columns: key, ``piece`` (from 0), ``start_token``, ``end_token``, ``tokens`` (at most ``limit``),
    ``start_char``, ``end_char`` and ``text``. Each piece after the first begins exactly ``overlap`` tokens
    before the end of the one before; what it adds ends at the strongest boundary in the second half of what
    fits (paragraph, line, sentence, clause, word), or at the last boundary before that, as far as it lies beyond
    the overlap, or at the last whole character where there is none. A
    piece that begins inside a character, as 64 tokens back may, has its text from the next whole one on.
    The new parts of the pieces, one after the other, are the whole text.

    Null, empty and shorter texts give no piece; repeated rows give repeated pieces; other columns are not
    read. Texts of any length are read whole.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    def scan(texts: pa.Array) -> pa.Array:
        enc, found = encoder(vocabulary), []
        for t in texts.to_pylist():
            # A text of at most `limit` bytes cannot have more tokens.
            one = (None, None, None, None)
            if t and len(t) * 4 > limit and len(raw := t.encode()) > limit and len(sizes := enc.sizes(t)) > limit:
                one = marks(t, raw, sizes)
                one = (one[0].decode("ascii"), *one[1:])
            found.append(one)
        kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
        return pa.StructArray.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*found), kinds)] if found else [pa.array([], kind) for kind in kinds], names=["marks", "bytes", "chars", "data"])

    # Not deterministic, so that the filter on its result doesn't have it computed a second time.
    marked = F.arrow_udf(scan, "struct<marks: string, bytes: array<int>, chars: array<int>, data: binary>").asNondeterministic()
    rows = df.select(F.col(key).alias("k"), marked(text).alias("m")).where("m.marks IS NOT NULL").select("k", "m.*")
    rows = rows.withColumn("head", F.regexp_extract("marks", f"\\A(?:{_pattern(limit, overlap)})", 0))
    rows = rows.withColumn("fresh", F.concat(F.array("head"), F.regexp_extract_all(F.expr("substring(marks, length(head) + 1)"), F.lit(_pattern(limit - overlap, overlap)), F.lit(0))))
    # Ends of the pieces: sums within runs of RUN pieces, and of the runs before, so that no long list is copied often.
    rows = rows.select("k", "bytes", "chars", "data", F.expr("transform(fresh, p -> length(p))").alias("sizes"))
    rows = rows.withColumn("runs", F.expr(f"transform(sequence(0, (size(sizes) - 1) div {RUN}), b -> aggregate(slice(sizes, int(b) * {RUN} + 1, {RUN}), array(0), (a, n) -> concat(a, array(element_at(a, -1) + n))))"))
    rows = rows.withColumn("before", F.expr("aggregate(runs, array(0), (a, r) -> concat(a, array(element_at(a, -1) + element_at(r, -1))))"))
    end = f"runs[int((i - 1) div {RUN})][int((i - 1) % {RUN}) + 1] + before[int((i - 1) div {RUN})]"
    last = end.replace("i - 1", "i - 2")
    spans = F.expr(f"transform(sequence(1, size(sizes)), i -> struct(i - 1 AS piece, IF(i = 1, 0, greatest(0, {last} - {overlap})) AS s, {end} AS e))")
    rows = rows.select("k", "data", "bytes", "chars", spans.alias("spans"))
    where = "transform(spans, x -> struct(x.piece AS piece, x.s AS start_token, x.e AS end_token, x.e - x.s AS tokens, IF(x.s = 0, 0, chars[x.s - 1]) AS start_char, chars[x.e - 1] AS end_char, IF(x.s = 0, 0, bytes[x.s - 1]) AS low, bytes[x.e - 1] AS high))"
    rows = rows.select("k", "data", F.expr(where).alias("pieces"))

    def cut(data: pa.Array, pieces: pa.Array) -> pa.Array:
        flat = pieces.flatten()
        low, high, ends = flat.field("low").to_numpy(), flat.field("high").to_numpy(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        texts = []
        for i, (first, last) in enumerate(zip(ends[:-1], ends[1:])):
            if last > first:
                whole = memoryview(data[i].as_buffer())
                texts += [whole[x:y].tobytes() for x, y in zip(low[first:last], high[first:last])]
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string()))
        return pc.if_else(pieces.is_valid(), found, pa.scalar(None, found.type))

    # Every piece takes its own bytes only. An expression copies the whole text for each of them, so it cuts texts of at
    # most COPIED bytes, whose copies are as good as free; longer ones are cut in one go.
    long_ = F.octet_length("data") > COPIED
    cuts = F.arrow_udf(cut, "array<string>").asNondeterministic()(F.when(long_, F.col("data")), F.when(long_, F.col("pieces")))
    rows = rows.withColumn("cuts", cuts)
    texts = F.coalesce("cuts", F.transform("pieces", lambda x: F.substring(F.col("data"), x["low"] + 1, x["high"] - x["low"]).cast("string")))
    rows = rows.select("k", "pieces", texts.alias("texts"))
    out = rows.select("k", F.inline(F.zip_with("pieces", "texts", lambda x, t: F.struct(*[x[c].alias(c) for c in ("piece", "start_token", "end_token", "tokens", "start_char", "end_char")], t.alias("text")))))
    return out.withColumnRenamed("k", key)
