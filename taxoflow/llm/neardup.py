"""Groups of records that share most of their words, by R-trees over count vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflow.llm.rtree import planes, similar
from taxoflow.operators.components import connected_components
from taxoflow.session import checkpointed, written

#: Word groups of a count vector.
GROUPS = 64
#: Frequencies are counted in so many hashed buckets, whatever the vocabulary.
BUCKETS = 1 << 18
#: Records of one block in one task; larger blocks become pairs of parts.
PART = 1 << 15
#: Rows that a worker joins together, at block boundaries; classes of a component that are compared together.
ROWS, TOGETHER = 100_000, 512
#: Words whose codes stand for them where whole word lists are shuffled, the most frequent; others stay as they are.
CODED = 1 << 15
#: Distinct words that a worker remembers the hashes of.
MEMO = 1 << 20
_WORD = re.compile("[a-z0-9]+")


class _Hashes(dict):
    """64-bit hashes of words, worked out when first met."""

    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers stirred, so that sums and low bits of them are good hashes again."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All hashes, the row of each, and the rows' sizes."""
    size = np.diff(column.offsets.to_numpy()).astype(np.int64)
    return column.flatten().to_numpy(), np.repeat(np.arange(len(size)), size), size


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> 16) & (BUCKETS - 1)


def word_sets(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """The columns ``keep`` with ``w``, hashes of the distinct runs of a-z and 0-9 in the lower-cased columns
    joined by blanks (null is empty), and ``c``, a hash of that set."""
    rows = df.select(*keep, F.concat_ws(" ", *[F.col(c) for c in columns]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            sets = [set(_WORD.findall(t.lower())) for t in batch.column("x").to_pylist()]
            size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            w = np.fromiter(map(known.__getitem__, chain.from_iterable(sets)), dtype=np.uint64, count=int(size.sum()))
            if len(known) > MEMO:
                known.clear()
            ends = np.concatenate([[0], np.cumsum(size)])
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(w))])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(w.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], lists, pa.array((total[ends[1:]] - total[ends[:-1]]).view(np.int64))], names=[*keep, "w", "c"])

    kept = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{kept}, w array<long>, c long")


def frequencies(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of column ``w`` hold a word of each bucket, never fewer than hold the word; and the most
    frequent words, at most ``CODED``, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = np.unique(_flat(batch.column("w"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], names=["w", "n"])

    counted = checkpointed(words.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    # The least power of two from which on at most CODED words occur, by the number of words between any two.
    least, held = 63, 0
    for row in counted.groupBy((F.length(F.bin("n")) - 1).alias("power")).agg(F.count("*").alias("words")).orderBy(F.desc("power")).collect():
        held += row["words"]
        if held > CODED:
            break
        least = row["power"]
    often = counted.where(F.col("n") >= F.lit(2).cast("double") ** least).select("w").toArrow().column("w").to_numpy()
    by_bucket = counted.groupBy(F.shiftright("w", 16).bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[by_bucket.column("b").to_numpy()] = by_bucket.column("n").to_numpy()
    return out, np.sort(often)


def _prefixes(df: DataFrame, frequency: np.ndarray, threshold: float) -> DataFrame:
    """Per row the class, its size, the count vector and the prefix: hashes of the rarest words with their places.

    Two sets of sizes m and n match only if they share t / (1 + t) of m + n words, which is at least t of n. So
    their first shared word, from the rarest on, is among the n - ceil(t n) + 1 first of either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, row, size = _flat(batch.column("w"))
            ends = np.cumsum(size)
            counts = np.bincount(row * GROUPS + (_mixed(w) >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=len(size) * GROUPS).reshape(-1, GROUPS)
            low, high = planes(counts)
            often = frequency[_bucket(w)]
            order = np.lexsort((w >> 16, often, row))
            place = np.arange(len(w)) - np.repeat(ends - size, size)
            # A word of frequency 1 has a place, but no other record in its block.
            chosen = (place <= (size - np.ceil(threshold * size - 1e-9))[row]) & (often[order] > 1)
            entry = (w[order[chosen]] >> 16 << 16) | np.minimum(place[chosen], 0xFFFF)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(row[chosen], minlength=len(size)))]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(cuts), pa.array(entry))
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(size.astype(np.int32)), pa.array(low.view(np.int64).ravel()), pa.array(high.view(np.int64).ravel()), prefix], names=["c", "n", "low", "high", "prefix"])

    return df.mapInArrow(run, "c long, n int, low long, high long, prefix array<long>")


def _blocks(frequency: np.ndarray, threshold: float):
    """One row per class and word of its prefix, or per pair of parts of that word's block.

    With the first shared word at place p, n - p words can be shared at most, which bounds the other's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, row, _ = _flat(batch.column("prefix"))
            n, c = batch.column("n").to_numpy().astype(np.int64), batch.column("c").to_numpy()
            place, word = entry & 0xFFFF, (entry >> 16).astype(np.uint64)
            reach = np.floor(np.minimum((n[row] - place) * (1 + threshold) / threshold - n[row], n[row] / threshold) + 1e-9).astype(np.int64)
            parts = -(-frequency[_bucket(entry)] // PART)
            mine = (_mixed(c[row].view(np.uint64) ^ word) % parts.astype(np.uint64)).astype(np.int64)
            again = np.repeat(np.arange(len(entry)), parts)
            other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
            low, high = np.minimum(mine[again], other), np.maximum(mine[again], other)
            key = _mixed(word[again] * np.uint64(1_000_003) + (low * 7919 + high).astype(np.uint64))
            block = ((key & ~np.uint64(1)) | ((mine[again] == high) & (low != high)).astype(np.uint64)).view(np.int64)
            at = pa.array(row[again])
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array((n[row] << 32 | reach)[again]), batch.column("c").take(at), batch.column("low").take(at), batch.column("high").take(at)], names=["block", "bounds", "c", "low", "high"])

    return run


def _join(threshold: float):
    """Candidate pairs of classes from rows sorted by block, joined at block boundaries."""

    def joined(block: np.ndarray, bounds: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, reach = bounds >> 32, bounds & 0xFFFFFFFF
        # Like sizes and like reaches lie together, so that nodes bound them well.
        order = np.lexsort((reach, n // 8, block))
        block, n, reach, c = block[order], n[order], reach[order], c[order]
        low, high = (x[order].view(np.uint64).reshape(-1, GROUPS // 64) for x in (low, high))
        for a, b in similar(block >> 1, block & 1, low, high, n, threshold, reach):
            fine = c[a] != c[b]
            pairs = np.unique(np.stack([np.minimum(c[a], c[b])[fine], np.maximum(c[a], c[b])[fine]]), axis=1)
            if pairs.size:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([batch.column(x).to_numpy() for x in ("block", "bounds", "c", "low", "high")])
            if sum(len(h[0]) for h in held) >= ROWS:
                whole = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.searchsorted(whole[0] >> 1, whole[0][-1] >> 1, side="left"))
                if cut:
                    yield from joined(*(x[:cut] for x in whole))
                held = [[x[cut:] for x in whole]]
        if held:
            yield from joined(*(np.concatenate(x) for x in zip(*held)))

    return run


def _coded(df: DataFrame, often: np.ndarray) -> DataFrame:
    """(``c``, ``packed``): the word set in as few bytes as its frequent words allow, two bytes each.

    After four bytes with their number come the frequent words' codes, then the other words' hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, row, size = _flat(batch.column("w"))
            code = np.searchsorted(often, w)
            known = (often[np.minimum(code, len(often) - 1)] == w) if len(often) else np.zeros(len(w), dtype=bool)
            short = np.bincount(row[known], minlength=len(size))
            codes, rest = code[known].astype(np.uint16), w[~known]
            at, to = np.concatenate([[0], np.cumsum(short)]), np.concatenate([[0], np.cumsum(size - short)])
            packed = [short[i : i + 1].astype(np.int32).tobytes() + codes[at[i] : at[i + 1]].tobytes() + rest[to[i] : to[i + 1]].tobytes() for i in range(len(size))]
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(packed, pa.binary())], names=["c", "packed"])

    return df.mapInArrow(run, "c long, packed binary")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of packed sets, codes and hashes numbered together, and the sets' sizes."""
    codes, rest, short, long_ = [], [], [], []
    for x in column.to_pylist():
        n = int.from_bytes(x[:4], "little")
        codes.append(x[4 : 4 + 2 * n])
        rest.append(x[4 + 2 * n :])
        short.append(n)
        long_.append((len(x) - 4 - 2 * n) // 8)
    short, long_ = np.array(short, dtype=np.int64), np.array(long_, dtype=np.int64)
    _, other = np.unique(np.frombuffer(b"".join(rest), dtype=np.int64), return_inverse=True)
    words = np.concatenate([np.frombuffer(b"".join(codes), dtype=np.uint16).astype(np.int64), other + CODED])
    row = np.concatenate([np.repeat(np.arange(len(short)), short), np.repeat(np.arange(len(long_)), long_)])
    return words[np.argsort(row, kind="stable")], short + long_


def _settle(threshold: float):
    """Exact comparison of all classes of each component, over rows sorted by component."""

    def groups(w: np.ndarray, size: np.ndarray, c: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(size)
        _, word = np.unique(w, return_inverse=True)
        held = np.zeros((m, word.max() + 1 if len(word) else 1), dtype=np.float32)
        held[np.repeat(np.arange(m), size), word] = 1
        shared = np.rint(held @ held.T).astype(np.int64)
        alike = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
        links = (alike * copies[None, :]).sum(axis=1) - 1
        label = np.arange(m)
        while True:
            least = np.where(alike, label[None, :], m).min(axis=1)
            if (least == label).all():
                return c[label], links
            label = least

    def twos(w: np.ndarray, row: np.ndarray, size: np.ndarray, c: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many components of two classes: rows 2i and 2i + 1."""
        order = np.lexsort((w, row // 2))
        w, pair = w[order], row[order] // 2
        shared = np.bincount(pair[1:][(w[1:] == w[:-1]) & (pair[1:] == pair[:-1])], minlength=len(size) // 2)
        alike = shared >= threshold * (size[::2] + size[1::2] - shared) - 1e-9
        links = copies.reshape(-1, 2) - 1 + np.where(alike[:, None], copies.reshape(-1, 2)[:, ::-1], 0)
        return np.stack([c[::2], np.where(alike, c[::2], c[1::2])], axis=1).ravel(), links.ravel()

    def settled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        component, c, copies = (table.column(x).to_numpy() for x in ("component", "c", "copies"))
        w, size = _unpacked(table.column("packed").combine_chunks())
        ends = np.concatenate([[0], np.cumsum(size)])
        first = np.flatnonzero(np.r_[True, component[1:] != component[:-1]])
        many = np.diff(np.r_[first, len(c)])
        group, links = c.copy(), np.zeros(len(c), dtype=np.int64)
        double = (first[many == 2][:, None] + np.arange(2)).ravel()
        if len(double):
            place = np.full(len(c), -1)
            place[double] = np.arange(len(double))
            row = np.repeat(place, size)
            group[double], links[double] = twos(w[row >= 0], row[row >= 0], size[double], c[double], copies[double])
        for low, n in zip(first[many > 2], many[many > 2]):
            part = slice(low, low + n)
            group[part], links[part] = groups(w[ends[low] : ends[low + n]], size[part], c[part], copies[part])
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(group), pa.array(links)], names=["c", "g", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            component = rest.column("component").to_numpy()
            cut = int(np.searchsorted(component, component[-1], side="left")) if len(component) else 0
            if cut:
                yield from settled(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield from settled(rest)

    return run


def _verified(threshold: float):
    """Rows of pairs whose two packed word sets match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w, size = _unpacked(pa.concat_arrays([batch.column("p_a"), batch.column("p_b")]))
            row = np.repeat(np.r_[np.arange(batch.num_rows), np.arange(batch.num_rows)], size)
            order = np.lexsort((w, row))
            w, row = w[order], row[order]
            shared = np.bincount(row[1:][(w[1:] == w[:-1]) & (row[1:] == row[:-1])], minlength=batch.num_rows)
            alike = shared >= threshold * (size[: batch.num_rows] + size[batch.num_rows :] - shared) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(alike)) for x in ("a", "b", "m_a", "m_b")], names=["a", "b", "m_a", "m_b"])

    return run


def near_duplicates(df: DataFrame, key: str, version: str, columns: list[str], threshold: float) -> DataFrame:
    """(key, ``group``, ``links``) for every key that has at least one similar other.

    Each key counts with its latest version. Two records match if the words they share are at least
    ``threshold`` of the words of either; matches chain into groups, named by their smallest key; ``links``
    is the number of records that a record matches. Records without any word match nothing; null columns are
    empty, null keys are left out; records written twice count once, and of different rows of one version one
    is taken by its words; texts are read whole; other columns are not read.

    Records of equal words are one class; words and sets of words are told apart by 64-bit hashes. A class goes to
    the blocks of its rarest words, in one order by frequencies counted over all records, and of so many that
    every two that match share one. In each block the classes' count vectors (words hashed into groups) form a
    packed R-tree, joined with itself: pairs of nodes whose summed coordinate minima or sizes cannot reach the
    threshold are left out, the rest come down to pairs of classes. These are joined into components, in which
    all classes are compared word for word; in components of more than ``TOGETHER`` classes the found pairs are,
    which hold every match as well, in a join. Blocks of more than ``PART`` records are joined part by part. The
    work grows with the squares of the blocks: linearly in rare words, quadratically in words of a fixed share.
    """
    named = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(version).alias("version"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(columns)])
    sets = written(word_sets(named, ["id", "version"], [f"x{i}" for i in range(len(columns))]))
    frequency, often = frequencies(sets.select("w"))
    latest = sets.groupBy("id").agg(F.max(F.struct("version", F.size("w").alias("n"), "c")).alias("r"))
    records = written(latest.where("r.n > 0").select("id", F.col("r.c").alias("c")))
    classes = records.groupBy("c").agg(F.count("*").alias("copies"))
    held = _prefixes(sets.select("c", "w"), frequency, threshold).groupBy("c").agg(F.any_value(F.struct("n", "low", "high", "prefix")).alias("r"))
    members = held.join(classes, "c", "left_semi").select("c", "r.*").mapInArrow(_blocks(frequency, threshold), "block long, bounds long, c long, low long, high long")
    by_block = members.repartition(F.shiftright("block", 1)).sortWithinPartitions("block")
    pairs = checkpointed(by_block.mapInArrow(_join(threshold), "a long, b long").distinct())
    component = connected_components(pairs, "a", "b")
    sizes = component.groupBy("component").agg(F.count("*").alias("many"))
    held = checkpointed(component.withColumnRenamed("node", "c").join(classes, "c").join(sizes, "component").select("c", "component", "copies", "many"))
    packed = _coded(sets.select("c", "w"), often).groupBy("c").agg(F.any_value("packed").alias("packed"))
    worded = packed.join(held, "c")
    small = worded.where(F.col("many") <= TOGETHER).select("component", "c", "copies", "packed").repartition("component").sortWithinPartitions("component")
    grouped = small.mapInArrow(_settle(threshold), "c long, g long, links long")
    if (held.agg(F.max("many")).first()[0] or 0) > TOGETHER:
        big = checkpointed(worded.where(F.col("many") > TOGETHER).select("c", "copies", "packed"))
        a, b = (big.select(F.col("c").alias(x), F.col("copies").alias(f"m_{x}"), F.col("packed").alias(f"p_{x}")) for x in ("a", "b"))
        edges = checkpointed(pairs.join(a, "a").join(b, "b").select("a", "b", "m_a", "m_b", "p_a", "p_b").mapInArrow(_verified(threshold), "a long, b long, m_a long, m_b long"))
        label = connected_components(edges, "a", "b")
        degree = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("m_b").alias("m")), F.struct(F.col("b").alias("node"), F.col("m_a").alias("m"))))).groupBy("node").agg(F.sum("m").alias("m"))
        large = big.select("c", "copies").join(label, big.c == label.node, "left").join(degree, big.c == degree.node, "left")
        grouped = grouped.unionByName(large.select("c", F.coalesce("component", "c").alias("g"), (F.coalesce("m", F.lit(0)) + F.col("copies") - 1).alias("links")))
    grouped = checkpointed(grouped)
    copied = classes.where("copies > 1").select("c", F.col("c").alias("g"), (F.col("copies") - 1).alias("links")).join(grouped, "c", "left_anti")
    labelled = records.join(grouped.unionByName(copied).where("links > 0"), "c")
    names = labelled.groupBy("g").agg(F.min("id").alias("group"))
    return labelled.join(names, "g").select(F.col("id").alias(key), "group", "links")


def pairs_within(groups: DataFrame, key: str) -> DataFrame:
    """All pairs of keys of one group, once: (``uid_a`` < ``uid_b``)."""
    a, b = groups.select("group", F.col(key).alias("uid_a")), groups.select("group", F.col(key).alias("uid_b"))
    return a.join(b, "group").where("uid_a < uid_b").select("uid_a", "uid_b")
