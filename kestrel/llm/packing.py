"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted.  A sequence of c tokens costs
c + c * c / ``ATTENTION`` + ``OVERHEAD``: work that follows its tokens, attention that
follows their square, and what every sequence costs besides.  So a long sequence is
filled to the brim easily but costs more a token, a short one leaves room.

Items come in decreasing length; each goes into the open bin with the least room that
still holds it (best fit).  If none does, a bin is opened: for every permitted length
that holds the item, the bin is filled on trial from the items still to come (longest
first), and the length that costs least for each token so carried is taken.  When all
items are placed, every bin is downsized to the smallest permitted length that holds it.

Documents longer than the longest permitted length are cut into pieces: nothing is
dropped or shortened.  Only (id, length) pairs move.  They are dealt by a hash into
groups of about ``group_items``, each packed on its own, so no task's work or memory
grows with the input; a group leaves at most a few open bins part-filled.

Defined results: documents without a word (or null) have no piece; a null id is
packed like any other; repeated rows are packed each; ties (equal lengths) go by row;
a very long text becomes many pieces, of one group or several; an empty table gives
no rows; other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.rows import WORD
from kestrel.storage import materialize

#: Permitted sequence lengths, in words; the length at which attention costs as much as
#: all else; and the cost of a sequence besides its length.
CAPACITIES = (512, 1024, 2048, 4096)
ATTENTION, OVERHEAD = 16_384, 32


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / ATTENTION + OVERHEAD


def carried(capacity: int, negative: list[int], first: int) -> int:
    """Tokens of a bin of ``capacity`` filled with item ``first`` and then, longest first, with those after it.

    ``negative`` holds the items' lengths, negated, ascending.
    """
    room, at = capacity + negative[first], first + 1
    while room and (at := bisect_left(negative, -room, at)) < len(negative):
        # As many of this length as fit, at once.
        n = negative[at]
        count = min(room // -n, bisect_right(negative, n, at) - at)
        room += count * n
        at = bisect_right(negative, n, at) if room >= -n else at + count
    return capacity - room


def best_fit(
    lengths: list[int], capacities: tuple[int, ...], price: Callable[[int], float] = cost
) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset in the bin) of each item, and the capacity of each bin."""
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    negative = [-lengths[i] for i in order]
    owner, offset = [0] * len(lengths), [0] * len(lengths)
    room: list[int] = []  # of each bin
    size: list[int] = []
    open_bins: list[tuple[int, int]] = []  # (room, bin), ascending
    for k, i in enumerate(order):
        n = lengths[i]
        at = bisect_left(open_bins, (n, -1))
        if at < len(open_bins):
            left, b = open_bins.pop(at)
        else:
            left = min((c for c in sizes if c >= n), key=lambda c: (price(c) / carried(c, negative, k), c))
            b = len(size)
            size.append(left)
            room.append(left)
        owner[i], offset[i] = b, size[b] - left
        room[b] = left - n
        if room[b]:
            insort(open_bins, (room[b], b))
    final = [next(c for c in sizes if c >= s - r) for s, r in zip(size, room, strict=True)]
    return owner, offset, final


def n_words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
    capacities: tuple[int, ...] = CAPACITIES,
    price: Callable[[int], float] = cost,
    group_items: int = 16_384,
) -> DataFrame:
    """Pieces: id, piece, start, length, bin_id, bin_offset, capacity.

    ``length`` measures a document (default: its words; pass a token count if known).
    A piece is items [start, start + length) of its document; it fills
    [bin_offset, bin_offset + length) of sequence ``bin_id``.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    most = max(capacities)
    lengths = docs.select(F.col(id_col).alias("id"), (n_words(text_col) if length is None else length).alias("n"))
    pieces = lengths.where("n > 0").select(
        "id", F.explode(F.expr(f"sequence(0L, (n - 1) div {most})")).alias("piece"), "n"
    )
    pieces, _ = materialize(
        pieces.select(
            "id",
            F.col("piece").cast("int").alias("piece"),
            (F.col("piece") * most).alias("start"),
            F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("int").alias("length"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "pieces",
    )
    groups = max(1, -(-pieces.count() // group_items))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        owner, offset, final = best_fit(group.column("length").to_pylist(), capacities, price)
        at = np.array(owner, dtype=np.int64)
        return (
            group.drop_columns(["row", "grp"])
            .append_column("bin_id", pa.array((np.int64(key[0].as_py()) << np.int64(32)) + at))
            .append_column("bin_offset", pa.array(offset, pa.int32()))
            .append_column("capacity", pa.array(np.array(final, dtype=np.int32)[at]))
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length int, bin_id long, bin_offset int, capacity int"
    return dealt.groupBy("grp").applyInArrow(run, schema).withColumnRenamed("id", id_col)
