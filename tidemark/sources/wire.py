"""Decoders of a quote protocol's numbers: signed integers of variable length, running deltas, and a float of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the longest number that fits in 64 bits with its sign: 6 bits and eight times 7.
LONGEST = 9


def decode_numbers(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all rows of bytes at once: values, the n + 1 offsets of rows in them, and which rows are sound.

    The first byte of a number holds its lowest 6 bits, the sign at 0x40, and at 0x80 whether more bytes follow; each of these
    holds 7 bits and the same mark. A row that ends within a number, or has one that is too long, is unsound and has none.
    """
    n = len(offs) - 1
    last = (data & 0x80) == 0
    size = np.diff(offs)
    sound = np.ones(n, bool)
    filled = size > 0
    sound[filled] = last[offs[1:][filled] - 1]
    # a row that is cut off must not run into the next one
    stop = last.copy()
    stop[offs[1:][filled] - 1] = True
    ends = np.flatnonzero(stop) + 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    row = np.repeat(np.arange(n), size)[starts] if len(ends) else np.zeros(0, np.int64)
    sound[row[ends - starts > LONGEST]] = False
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    shift = np.where(place == 0, 0, np.minimum(6 + 7 * (place - 1), 62))
    bits = np.where(place == 0, data & 0x3F, data & 0x7F).astype(np.int64) << shift
    values = np.add.reduceat(bits, starts) if len(ends) else np.zeros(0, np.int64)
    values = np.where((data[starts] & 0x40) > 0, -values, values) if len(ends) else values
    keep = sound[row]
    return values[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=n))]), sound


def numbers(df: DataFrame, column: str, out: str = "numbers") -> DataFrame:
    """df with an array of the numbers that a binary column holds, and <out>_problem.

    Null bytes give null, no bytes an empty array; a row that ends within a number, or has one of more than 9 bytes, gives
    null and a problem. Arrow batches are decoded as a whole.
    """
    schema = df.select("*", F.lit(None).cast("array<bigint>").alias(out), F.lit(None).cast("string").alias(f"{out}_problem")).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches):
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(column))
            here = col.is_valid().to_numpy(zero_copy_only=False)
            parts = col.cast(pa.large_binary()).fill_null(b"")
            offs = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
            data = np.frombuffer(parts.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(parts) and parts.buffers()[2] is not None else np.zeros(0, np.uint8)
            values, at, sound = decode_numbers(data, offs - offs[0])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int64()), mask=pa.array(~(here & sound)))
            bad = pa.array(["cut off or too long" if h and not s else None for h, s in zip(here, sound, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, bad], names=schema.names)

    return df.mapInArrow(run, schema)


def encode_numbers(values: list[int]) -> bytes:
    """The bytes of numbers, as decode_numbers() reads them."""
    out = bytearray()
    for v in values:
        rest = abs(v)
        out.append(rest & 0x3F | (0x40 if v < 0 else 0) | (0x80 if rest >> 6 else 0))
        rest >>= 6
        while rest:
            out.append(rest & 0x7F | (0x80 if rest >> 7 else 0))
            rest >>= 7
    return bytes(out)


def running(values: Column) -> Column:
    """Sums so far of an array of deltas."""
    start = F.array().cast("array<bigint>")
    return F.aggregate(values, start, lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0).cast("long")) + x)))


def price_bars(values: Column) -> Column:
    """Array of (open, close, high, low) from four deltas a bar: open from the last close, the others from open.

    Numbers left over at the end are no bar.
    """
    bar = "struct<open: bigint, close: bigint, high: bigint, low: bigint>"
    four = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / 4).cast("int") - 1), lambda k: F.slice(values, k * 4 + 1, F.lit(4)))
    four = F.when(F.size(values) >= 4, four).otherwise(F.array().cast("array<array<bigint>>"))

    def step(s: Column, x: Column) -> Column:
        first = F.coalesce(F.try_element_at(s, F.lit(-1))["close"], F.lit(0).cast("long")) + x[0]
        return F.concat(s, F.array(F.struct(first.alias("open"), (first + x[1]).alias("close"), (first + x[2]).alias("high"), (first + x[3]).alias("low"))))

    return F.aggregate(four, F.array().cast(f"array<{bar}>"), step)


def volume(raw: Column) -> Column:
    """The number that 32 bits stand for: an exponent byte (times 2, less 127) and three bytes of fraction with a leading 1.

    The fraction's first bit is the exponent's last. No bits at all are 0, not the smallest power. Where the first byte of the
    fraction is at most 0x80 and its power is negative, that byte is divided by the power instead of multiplied: so the
    format's readers have it, and some values below 65 differ from a plain float.
    """
    raw = raw.cast("long")
    byte = lambda k: F.shiftright(raw, 8 * k).bitwiseAND(F.lit(255).cast("long"))
    e, hi, mid, lo = byte(3) * 2 - 127, byte(2), byte(1), byte(0)
    two = lambda x: F.pow(F.lit(2.0), x)
    first = F.when(hi > 128, two(e - 7) * 128 + hi.bitwiseAND(F.lit(127).cast("long")) * two(e - 6)).when(e >= 7, hi * two(e - 7)).otherwise(hi / two(e - 7))
    rest = (mid * two(e - 15) + lo * two(e - 23)) * F.when(hi >= 128, 2.0).otherwise(1.0)
    return F.when(raw == 0, 0.0).otherwise(two(e) + first + rest)
