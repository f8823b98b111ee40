"""Reader of zipped archives of financial reports: members with an index of offsets and records of 32-bit floats.

Files come through Spark's binaryFile source, so any store that Spark reads will do; each is one row, unpacked member by
member in its task, and only the wanted fields of a record are taken out of the bytes.
"""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The header of a member, and an entry of its index.
HEADER = np.dtype([("kind", "<i2"), ("report_date", "<u4"), ("count", "<u2"), ("rest", "<u4"), ("size", "<u4"), ("rest2", "<u4")])
ENTRY = np.dtype([("code", "S6"), ("flag", "S1"), ("at", "<u4")])


def members(path: str, content: bytes):
    """(name, bytes or None, problem) of the `.dat` members of an archive, or of a plain `.dat` file."""
    if not path.endswith(".zip"):
        yield path.rsplit("/", 1)[-1], content, None
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        yield None, None, "not an archive"
        return
    names = [n for n in archive.namelist() if n.endswith(".dat")]
    if not names:
        yield None, None, "no data member"
    for n in names:
        try:
            yield n, archive.read(n), None
        except (zipfile.BadZipFile, EOFError, OSError, ValueError):
            yield n, None, "torn member"


def decode(data: bytes, fields: list[int]) -> tuple[int, list[str], np.ndarray, np.ndarray, str | None]:
    """Report date, codes, values (rows, fields), which rows are whole, and what is wrong with the member as a whole.

    fields are numbers from 1; one beyond the record's size is NaN. The bytes of each wanted field are gathered for all rows
    at once.
    """
    none = np.zeros((0, len(fields)))
    if len(data) < HEADER.itemsize:
        return 0, [], none, np.zeros(0, bool), "short header"
    head = np.frombuffer(data, HEADER, 1)[0]
    n, size = int(head["count"]), int(head["size"])
    there = min(n, (len(data) - HEADER.itemsize) // ENTRY.itemsize)
    index = np.frombuffer(data, ENTRY, there, HEADER.itemsize)
    at = index["at"].astype(np.int64)
    whole = at + size <= len(data)
    raw = np.frombuffer(data, np.uint8)
    out = np.full((there, len(fields)), np.nan)
    for k, f in enumerate(fields):
        if 1 <= f <= size // 4:
            spot = at[whole, None] + 4 * (f - 1) + np.arange(4)
            out[whole, k] = np.ascontiguousarray(raw[spot]).view("<f4")[:, 0]
    codes = [c.decode("ascii", "replace") for c in index["code"]]
    return int(head["report_date"]), codes, out, whole, "short index" if there < n else None


def read_reports(spark: SparkSession, path: str, fields: dict[str, int]) -> DataFrame:
    """(file, member, report_date, code, <fields>, problem): a row for each record; fields: column names by number, from 1.

    What cannot be read is named: a row of its own, without a code, for a file or member that is no archive, has no data,
    is torn, or has a short header or index; `short record` at a code whose record lies beyond the member's end. Fields that
    a record does not have are NULL, as are values that are no numbers. A file without records gives no row.
    """
    names, numbers = list(fields), list(fields.values())
    schema = "file string, member string, report_date long, code string, " + "".join(f"`{n}` double, " for n in names) + "problem string"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{zip,dat}").load(path).select("path", "content")

    def rows(file, member, date, codes, values, problems):
        n = len(codes)
        cols = [pa.array([file] * n, pa.string()), pa.array([member] * n, pa.string()), pa.array([date] * n, pa.int64()), pa.array(codes, pa.string())]
        cols += [pa.array(values[:, k], pa.float64(), mask=np.isnan(values[:, k])) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(problems, pa.string())], names=["file", "member", "report_date", "code", *names, "problem"])

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for member, data, problem in members(file, content.as_py()):
                    date = None
                    if data is not None:
                        date, codes, values, whole, problem = decode(data, numbers)
                        yield rows(file, member, date, codes, values, [None if w else "short record" for w in whole])
                    if problem:
                        yield rows(file, member, date or None, [None], np.full((1, len(names)), np.nan), [problem])

    return files.mapInArrow(run, schema)
