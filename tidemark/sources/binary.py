"""Readers of fixed-width binary bar files, one Spark row for each record.

Files are read whole by Spark's binaryFile source (they are small: one security's history each), and decoded with
numpy in tasks. The code comes from the file's name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Record layouts of the supported formats.
DAY = np.dtype([("date", "<u4"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("amount", "<f4"), ("vol", "<u4"), ("rest", "<u4")])
MINUTE_FLOAT = np.dtype([("day", "<u2"), ("minute", "<u2"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"), ("close", "<f4"), ("amount", "<f4"), ("vol", "<u4"), ("rest", "<u4")])
MINUTE_INT = np.dtype([("day", "<u2"), ("minute", "<u2"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("amount", "<f4"), ("vol", "<u4"), ("rest", "<u4")])
EXT_DAY = np.dtype([("date", "<u4"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"), ("close", "<f4"), ("amount", "<u4"), ("vol", "<u4"), ("settle", "<f4")])
BLOCK = np.dtype([("name", "S9"), ("n", "<u2"), ("kind", "<u2"), ("codes", "S7", 400)])
BLOCK_HEAD = 384
BARS = "code string, ts timestamp_ntz, open double, high double, low double, close double, vol double, amount double"


def _code(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _decode(kind: np.dtype, scale: float, content: bytes, code: str) -> pd.DataFrame:
    a = np.frombuffer(content[: len(content) // kind.itemsize * kind.itemsize], kind)  # a torn last record is left out
    if "date" in kind.names:
        d = a["date"].astype(int)
        ok = (d // 10000 > 1900) & (d // 100 % 100 >= 1) & (d // 100 % 100 <= 12) & (d % 100 >= 1) & (d % 100 <= 31)
        a, d = a[ok], d[ok]
        ts = pd.to_datetime(pd.Series(d.astype(str)), format="%Y%m%d", errors="coerce")
    else:
        n, m = a["day"].astype(int), a["minute"].astype(int)
        y, md = n // 2048 + 2004, n % 2048
        ts = pd.to_datetime(pd.DataFrame({"year": y, "month": md // 100, "day": md % 100, "hour": m // 60, "minute": m % 60}), errors="coerce")
    out = pd.DataFrame({"code": code, "ts": ts.to_numpy(), **{c: a[c].astype(float) * scale for c in ("open", "high", "low", "close")}, "vol": a["vol"].astype(float), "amount": a["amount"].astype(float)})
    return out[out["ts"].notna()]


def _read(spark: SparkSession, path: str, kind: np.dtype, scale: float, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                yield _decode(kind, scale, c, _code(p))

    return files.mapInPandas(run, BARS)


def read_day(spark: SparkSession, path: str, scale: float = 0.01) -> DataFrame:
    """Daily bars of `.day` files; prices are integers in units of `scale`."""
    return _read(spark, path, DAY, scale, "*.day")


def read_minute_float(spark: SparkSession, path: str) -> DataFrame:
    """Minute bars with float prices and packed day and minute (`.lc1`, `.lc5`)."""
    return _read(spark, path, MINUTE_FLOAT, 1.0, "*.lc[15]")


def read_minute_int(spark: SparkSession, path: str, scale: float = 0.01) -> DataFrame:
    """Minute bars with integer prices (`.1`, `.5`)."""
    return _read(spark, path, MINUTE_INT, scale, "*.[15]")


def read_ext_day(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars of extended markets (`.day`): float prices, a settlement price, and the amount also read as a float."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.day").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                a = np.frombuffer(c[: len(c) // EXT_DAY.itemsize * EXT_DAY.itemsize], EXT_DAY)
                ts = pd.to_datetime(pd.Series(a["date"].astype(str)), format="%Y%m%d", errors="coerce")
                out = pd.DataFrame({"code": _code(p), "ts": ts, **{k: a[k].astype(float) for k in ("open", "high", "low", "close", "vol", "amount", "settle")}})
                out["amount_float"] = a["amount"].copy().view("<f4").astype(float)
                yield out[out["ts"].notna()]

    return files.mapInPandas(run, f"{BARS}, settle double, amount_float double")


def read_blocks(spark: SparkSession, path: str, glob: str = "block*.dat") -> DataFrame:
    """(file, block, kind, seq, code): the codes of each block of block files; torn blocks at the end are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                said = int.from_bytes(c[BLOCK_HEAD : BLOCK_HEAD + 2], "little")
                whole = max(0, len(c) - BLOCK_HEAD - 2) // BLOCK.itemsize
                blocks = np.frombuffer(c, BLOCK, min(said, whole), BLOCK_HEAD + 2) if min(said, whole) else []
                rows = [(_code(p), b["name"].decode("gbk", "ignore"), int(b["kind"]), k, b["codes"][k].decode("utf-8", "ignore")) for b in blocks for k in range(min(int(b["n"]), len(b["codes"])))]
                yield pd.DataFrame(rows, columns=["file", "block", "kind", "seq", "code"])

    return files.mapInPandas(run, "file string, block string, kind long, seq long, code string")
