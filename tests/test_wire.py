"""Readers of archives and wire numbers: round trips, literals, and what is torn."""

import math
import random
import struct
import zipfile

import numpy as np
from pyspark.sql import functions as F

from tidemark.sources import archive, wire


def member(date, rows, cut=None):
    """A report file: rows of (code, values)."""
    size = 4 * max((len(v) for _, v in rows), default=0)
    head = struct.pack("<hIH3I", 1, date, len(rows), 0, size, 0)
    at = len(head) + 11 * len(rows)
    index = b"".join(struct.pack("<6scI", c.encode(), b"\0", at + k * size) for k, (c, _) in enumerate(rows))
    return (head + index + b"".join(struct.pack(f"<{len(v)}f", *v) for _, v in rows))[:cut]


def test_archive_is_read_back_and_torn_members_are_named(spark, tmp_path):
    rows = [("600000", [1.5, -2.0, float("nan")]), ("000001", [0.25, 1e9, 7.0])]
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a1.dat", member(20231231, rows))
        z.writestr("a2.dat", member(20230930, rows, -4))
        z.writestr("a3.dat", member(20230630, rows, 25))
        z.writestr("a4.dat", b"short")
        z.writestr("readme.txt", b"no data")
    (tmp_path / "b.dat").write_bytes(member(20220331, []))
    (tmp_path / "c.zip").write_bytes(b"no archive at all")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("x.txt", b"")
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("torn.dat", member(20211231, rows))
    raw = bytearray((tmp_path / "e.zip").read_bytes())
    raw[60] ^= 0xFF
    (tmp_path / "e.zip").write_bytes(bytes(raw))
    got = archive.read_reports(spark, str(tmp_path), {"third": 3, "first": 1, "beyond": 9}).collect()
    by = {}
    for r in got:
        by.setdefault((r.file.rsplit("/", 1)[1], r.member), []).append((r.report_date, r.code, r.first, r.third, r.beyond, r.problem))
    assert by.pop(("a.zip", "a1.dat")) == [(20231231, "600000", 1.5, None, None, None), (20231231, "000001", 0.25, 7.0, None, None)]
    assert by.pop(("a.zip", "a2.dat")) == [(20230930, "600000", 1.5, None, None, None), (20230930, "000001", None, None, None, "short record")]
    assert by.pop(("a.zip", "a3.dat")) == [(20230630, None, None, None, None, "short index")]
    assert by.pop(("a.zip", "a4.dat")) == [(None, None, None, None, None, "short header")]
    assert {k: v[0][-1] for k, v in by.items()} == {("c.zip", None): "not an archive", ("d.zip", None): "no data member", ("e.zip", "torn.dat"): "torn member"}


def test_numbers_round_trip_and_literals(spark):
    rng = random.Random(8)
    lists = [[], [0], [63], [64], [-1], [-64], [8191, -8192, 2**61 - 1, -(2**61)]] + [[rng.randint(-(10 ** rng.randint(1, 17)), 10 ** rng.randint(1, 17)) for _ in range(rng.randint(0, 30))] for _ in range(60)]
    rows = [(i, wire.encode_numbers(x)) for i, x in enumerate(lists)]
    assert wire.encode_numbers([1, -1, 64]) == bytes([0x01, 0x41, 0x80, 0x01])
    bad = [(900, None), (901, bytes([0x80])), (902, bytes([0x05, 0xFF])), (903, bytes([0x80] * 9 + [0x01]))]
    df = spark.createDataFrame(rows + bad, "k int, raw binary").repartition(3)
    got = {r.k: (r.numbers, r.numbers_problem) for r in wire.numbers(df, "raw").collect()}
    assert {k: v for k, v in got.items() if k < 900} == {i: (x, None) for i, x in enumerate(lists)}
    assert got[900] == (None, None) and all(got[k][0] is None and got[k][1] for k in (901, 902, 903))


def test_running_sums_and_bars(spark):
    df = spark.createDataFrame([(1, [5, -2, 10]), (2, []), (3, [100, 5, 8, -3, 1, -1, 2, -4, 99])], "k int, v array<bigint>")
    got = {r.k: (r.s, [tuple(x) for x in r.b]) for r in df.select("k", wire.running(F.col("v")).alias("s"), wire.price_bars(F.col("v")).alias("b")).collect()}
    assert got[1] == ([5, 3, 13], []) and got[2] == ([], [])
    assert got[3][1] == [(100, 105, 108, 97), (106, 105, 108, 102)]


def test_volumes(spark):
    """From 65 on the bits are those of a plain float; none are zero."""
    big = [70.0, 100.0, 12345.0, 65536.0, 1.5e6, 987654.25, 3.0e9, 200.5]
    raw = [struct.unpack("<I", struct.pack("<f", x))[0] for x in big]
    got = [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate([*raw, 0, 0x42480000])], "i int, x long").orderBy("i").select(wire.volume(F.col("x")).alias("v")).collect()]
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got, [float(np.float32(x)) for x in big], strict=False))
    assert got[-2] == 0.0 and got[-1] == 32 + 4 * 0x48
