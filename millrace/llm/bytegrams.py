"""Counts of byte n-grams over a corpus, as 64-bit keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, groups_of, serve, slices, texts

#: Stands before and after each text; no UTF-8 text holds this byte.
EDGE = 0xFF

#: Distinct keys that a task holds before it passes its counts on.
TASK_KEYS = 500_000


def framed(data: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of the texts, each with `order` edges before and one after, and each text's first byte in it, with one end."""
    before, after = bytes([EDGE]) * order, bytes([EDGE])
    buf = np.frombuffer(b"".join([x for d in data for x in (before, d, after)]), np.uint8)
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(d) + order + 1 for d in data], out=starts[1:])
    return buf, starts


def gram_keys(buf: np.ndarray, size: int) -> np.ndarray:
    """Keys of all `size` bytes in a row (8 at most); the last byte is the lowest."""
    have, out = 1, buf.astype(np.uint64)
    parts = {1: out}
    while have * 2 <= size:
        out = (out[:-have] << np.uint64(8 * have)) | out[have:]
        have *= 2
        parts[have] = out
    rest = size - have
    for p in sorted(parts, reverse=True):
        if rest >= p:
            more = parts[p][have:]
            n = min(len(out), len(more))
            out = (out[:n] << np.uint64(8 * p)) | more[:n]
            have += p
            rest -= p
    return out


def _runs(sorted_keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return sorted_keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    n = np.diff(np.append(at, len(sorted_keys))) if weights is None else np.add.reduceat(weights, at)
    return sorted_keys[at], n.astype(np.int64)


def count_grams(df: DataFrame, size: int, tags: int = 0, groups: bool = False, tag_of: Callable[[list[bytes]], np.ndarray] | None = None) -> DataFrame:
    """key and n: how often each `size`-gram ends at a byte, or at the end, of a text of df.

    df has columns text and, if tags > 0, tag (0 to tags - 1), which goes into the key's bits above
    the gram's; or tag_of gives the tags of some texts, a negative one for those that are passed over.
    With groups, df has a column grp, any long, and so has the result, which then is not yet summed: a
    task's counts are, and the caller groups them.  Else counts are summed in each task before the shuffle.
    """
    if groups and 8 * size + tags.bit_length() > 44:
        raise ValueError("too little room for groups beside a gram")
    bits = 8 * size + (tags - 1).bit_length() if tags else 8 * size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("counting")
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0
        numbers: dict[int, int] = {}  # of the groups that this task has met

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            by = np.argsort(keys, kind="stable")
            return _runs(keys[by], n[by])

        def out(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            met = np.array(list(numbers), np.int64)
            for i in range(0, len(keys), 100_000):
                part, each = keys[i : i + 100_000], pa.array(n[i : i + 100_000])
                if groups:
                    yield pa.RecordBatch.from_arrays([pa.array(met[(part >> np.uint64(bits)).astype(np.int64)]), pa.array((part & np.uint64((1 << bits) - 1)).view(np.int64)), each], names=["grp", "key", "n"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), each], names=["key", "n"])

        for b in slices(batches, 4 * SLICE_ROWS):
            data = [t.encode() for t in texts(b)]
            above = np.zeros(len(data), np.uint64)
            if groups:
                met, which = np.unique(b.column(b.schema.get_field_index("grp")).to_numpy(zero_copy_only=False), return_inverse=True)
                if len(numbers) + len(met) > 1 << 19:
                    if held:
                        yield from out(*merged())
                    held, total = [], 0
                    numbers.clear()
                above = np.array([numbers.setdefault(g, len(numbers)) for g in met.tolist()], np.uint64)[which] << np.uint64(bits)
            if tags and tag_of is None:
                above |= b.column(b.schema.get_field_index("tag")).to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(8 * size)
            for lo, hi in groups_of(data):
                part, top = data[lo:hi], above[lo:hi]
                if tag_of is not None:
                    tag = tag_of(part)
                    part, top = [d for d, t in zip(part, tag.tolist()) if t >= 0], (top | (tag.astype(np.int64).view(np.uint64) << np.uint64(8 * size)))[tag >= 0]
                if not part:
                    continue
                buf, starts = framed(part, size - 1)
                keys = gram_keys(buf, size)
                # the last size - 1 places of each text but the last begin grams that run into the next text
                ok = np.ones(len(keys), bool)
                for j in range(1, size):
                    ok[starts[1:-1] - j] = False
                keys = keys | np.repeat(top, np.diff(starts))[: len(keys)]
                held.append(_runs(np.sort(keys[ok])))
                total += len(held[-1][0])
                if total > 2 * TASK_KEYS:
                    held = [merged()]
                    total = len(held[0][0])
                    if total > TASK_KEYS:
                        yield from out(*held[0])
                        held, total = [], 0
        if held:
            yield from out(*merged())

    if groups:
        return df.mapInArrow(work, "grp long, key long, n long")
    return df.mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
