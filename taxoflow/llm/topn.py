"""The N best items of every group by secondary sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stream(n: int, ranked: bool):
    """Over batches sorted by group, score and item: the first ``n`` distinct items of each group.

    Between batches only the last group's name and its at most ``n`` items are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group, open_items = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, items = batch.column("g").dictionary_encode(), batch.column("i")
            carried = open_items if groups.dictionary[groups.indices[0].as_py()].as_py() == open_group else []
            items = pa.chunked_array([pa.array(carried, items.type), items]).combine_chunks().dictionary_encode()
            g = groups.indices.to_numpy()
            g = np.concatenate([np.full(len(carried), g[0]), g]).astype(np.int64)
            i = items.indices.to_numpy().astype(np.int64)
            _, first = np.unique(g * len(items.dictionary) + i, return_index=True)
            first.sort()
            gk = g[first]
            starts = np.flatnonzero(np.r_[True, gk[1:] != gk[:-1]])
            rank = np.arange(len(gk)) - np.repeat(starts, np.diff(np.r_[starts, len(gk)]))
            first, gk, rank = first[rank < n], gk[rank < n], rank[rank < n]
            last = first[gk == g[-1]]
            open_group, open_items = groups.dictionary[int(g[-1])].as_py(), [items.dictionary[int(i[k])].as_py() for k in last]
            new = first >= len(carried)
            rows = pa.array(first[new] - len(carried))
            if len(rows):
                out = {"g": batch.column("g").take(rows), "i": batch.column("i").take(rows)}
                out |= {"r": pa.array((rank[new] + 1).astype(np.int32))} if ranked else {"s": batch.column("s").take(rows)}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(``group``, ``top_rank`` from 1, ``item``): the ``n`` best distinct items of each group.

    An item counts once per group, with its highest score; order is by score descending, then item ascending.
    Rows with a null group or item and rows with a null or NaN score do not count; groups with fewer items
    give fewer rows; an empty table gives an empty result; other columns are not read.

    Every input partition is sorted and streamed first, leaving at most ``n`` rows of a group in each, so the
    shuffle by group stays small whatever part of the rows a group holds. No group is ever buffered.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), (F.col(score).cast("double") + F.lit(0.0)).alias("s")).where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    order = [F.col("g"), F.col("s").desc(), F.col("i")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    local = rows.sortWithinPartitions(*order).mapInArrow(_stream(n, ranked=False), f"g {kinds['g']}, i {kinds['i']}, s double")
    best = local.repartition("g").sortWithinPartitions(*order).mapInArrow(_stream(n, ranked=True), f"g {kinds['g']}, i {kinds['i']}, r int")
    return best.select(F.col("g").alias(group), F.col("r").alias("top_rank"), F.col("i").alias(item))
