"""Fingerprints that a wording shares with every text that contains it, so that such pairs are met by a join and not among all pairs.

A wording is known by its first stretch, whose length (one of ``_SPANS``) follows from the wording's own; the fingerprint is the
least hash of the grams in it. A text has the fingerprints of all its stretches, of which neighbours mostly agree. All is done
on UTF-8 bytes. Equal fingerprints prove nothing: a pair that they bring together has still to be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

#: The length of a stretch and the number of grams in it, a power of 2; a gram has the remaining bytes and one more.
_SPANS = [(window * half // 2, window) for window in (16 << j for j in range(10)) for half in (5, 7)]
#: Bytes of the shortest wording that has a fingerprint, and of the longest stretch.
SHORTEST, _LONGEST = _SPANS[0][0], _SPANS[-1][0]
#: Bytes that are hashed at once; a longer text comes in pieces, such that each of its stretches lies in one.
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.RandomState(1).randint(0, 1 << 64, 256, dtype=np.uint64)


def _powers(base: int) -> np.ndarray:
    """Powers modulo 2^64 from the power 0."""
    steps = np.full(_BLOCK + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _blocks(column: pa.Array, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bounds, sums) of the texts that are long enough, of each at most the first ``most`` bytes, the longest first, by blocks.

    A text or piece of one lies between two bounds. ``sums`` are those of the weighted bytes before each place; the difference of
    two, shifted to the power 0, is the hash of the bytes between them.
    """
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    sizes = np.minimum(np.diff(offsets), most or offsets[-1])
    step = _BLOCK - _LONGEST + 1
    pieces = 1 + np.maximum(0, -((_BLOCK - sizes) // step))
    rows = np.repeat(np.arange(len(sizes)), pieces)
    skipped = (np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * step
    starts, sizes = offsets[rows] + skipped, np.minimum(sizes[rows] - skipped, _BLOCK)
    order = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes >= SHORTEST)]
    ends, at = np.concatenate([[0], np.cumsum(sizes[order])]), 0
    while at < len(order):
        stop = int(np.searchsorted(ends, ends[at] + _BLOCK, "right")) - 1
        mine, data = order[at:stop], np.frombuffer(column.buffers()[2], np.uint8)
        data = np.concatenate([data[s : s + n] for s, n in zip(starts[mine], sizes[mine])])
        yield rows[mine], ends[at : stop + 1] - ends[at], np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * _UP[: len(data)])])
        at = stop


def of_texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, fingerprint) of all stretches of the texts, by blocks; equal neighbours are given once."""
    for rows, bounds, sums in _blocks(column):
        sizes = np.diff(bounds)
        found = []
        for span, window in _SPANS:
            count = np.count_nonzero(sizes >= span)
            if not count:
                break
            end, gram = bounds[count], span - window + 1
            least = (sums[gram : end + 1] - sums[: end + 1 - gram]) * _DOWN[: end + 1 - gram]
            width = 1
            while width < window:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            new = np.concatenate([[True], least[1:] != least[:-1]])
            new[bounds[:count]] = True
            at = np.flatnonzero(new)
            text = np.searchsorted(bounds, at, "right") - 1
            inside = at + span <= bounds[text + 1]
            found.append((rows[text[inside]], least[at[inside]]))
        row, value = (np.concatenate(x) for x in zip(*found))
        yield row, value


def of_wordings(column: pa.Array) -> np.ndarray:
    """The fingerprint of each wording; one that is too short is refused."""
    result, done = np.zeros(len(column), np.uint64), 0
    for rows, bounds, sums in _blocks(column, _LONGEST):
        which = np.searchsorted([span for span, _ in _SPANS], np.diff(bounds), "right") - 1
        for k in np.unique(which):
            (span, window), mine = _SPANS[k], which == k
            at, gram = bounds[:-1][mine, None] + np.arange(window), span - window + 1
            result[rows[mine]] = ((sums[at + gram] - sums[at]) * _DOWN[at]).min(axis=1)
        done += len(rows)
    if done < len(column):
        raise ValueError(f"a wording of less than {SHORTEST} bytes has no fingerprint")
    return result


def _seeded(batch: pa.RecordBatch, values: np.ndarray, rows: np.ndarray | slice) -> pa.Array:
    """The fingerprints, told apart by the key's hash in column ``_seed``."""
    return pa.array(values.view(np.int64) ^ batch.column("_seed").to_numpy()[rows])


def with_fingerprint(wordings: DataFrame, wording: str) -> DataFrame:
    """``wordings`` with ``_mark``; the column ``_seed`` (bigint) is the hash of the key within which texts are looked for."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _seeded(batch, of_wordings(batch.column(wording)), slice(None))
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=[*batch.schema.names, "_mark"])

    return wordings.mapInArrow(mark, StructType([*wordings.schema, StructField("_mark", LongType())]))


def text_fingerprints(texts: DataFrame, row: str, text: str) -> DataFrame:
    """(row, _mark) of all stretches; ``row`` is a bigint that stands for the text, ``_seed`` as above."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in of_texts(batch.column(text)):
                yield pa.RecordBatch.from_arrays([batch.column(row).take(pa.array(rows)), _seeded(batch, values, rows)], names=[row, "_mark"])

    return texts.select("_seed", row, text).mapInArrow(mark, f"{row} bigint, _mark bigint")
