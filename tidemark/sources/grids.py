"""Tables drawn with box characters in plain text, taken apart cell by cell.

A table begins with a top rule and ends with a bottom one; rules between name the columns below them. Columns are places
on a screen, where wide characters take two, so a line is cut at its bars, and where these do not tell the columns (a bar
within a cell, or one left out) at the places of the rule above.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# Rules of a table and the bars of its lines.
TOP, MID, BOTTOM = re.compile(r"^\s*┌[─┬]*┐\s*$"), re.compile(r"^\s*├[─┼┬┴]*┤\s*$"), re.compile(r"^\s*└[─┴]*┘\s*$")
BARS = "│|｜"
JOINTS = {"┌", "┬", "┐", "├", "┼", "┤"}
CELLS = "grid int, band int, line int, col int, cell string, problem string"


def places(line: str) -> list[int]:
    """Where each character of a line begins on the screen, and where the line ends."""
    out = [0]
    for c in line:
        out.append(out[-1] + (0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1))
    return out


def joints(rule: str) -> list[int]:
    """Places of a rule's joints, which bound its columns. Box characters are of one place here, whatever the font."""
    return [k for k, c in enumerate(rule.rstrip()) if c in JOINTS]


def cut(line: str, bounds: list[int]) -> list[str] | None:
    """Cells of a line, as many as the rule above has columns; None if neither bars nor places give them."""
    n = len(bounds) - 1
    body = line.strip()
    if not body or body[0] not in BARS or body[-1] not in BARS or len(body) < 2:
        return None
    cells = re.split(f"[{BARS}]", body[1:-1])
    if len(cells) == n:
        return [c.strip() for c in cells]
    at = places(line.rstrip())
    where = {p: k for k, p in enumerate(at[:-1])}
    spots = [where.get(b) for b in bounds]
    if any(s is None for s in spots):
        return None
    return [line[a:b].strip().strip(BARS).strip() for a, b in zip(spots[:-1], spots[1:], strict=True)]


def cells(text: str | None) -> Iterator[tuple[int, int, int, int, str | None, str | None]]:
    """(grid, band, line, col, cell, problem) of every table of a text, counted from 1; see text_cells()."""
    grid, bounds, band, line = 0, None, 0, 0
    for raw in (text or "").split("\n"):
        raw = raw.rstrip("\r ")
        if TOP.match(raw):
            if bounds is not None:
                yield grid, band, line, 0, None, "not closed"
            grid, bounds, band, line = grid + 1, joints(raw), 1, 0
        elif bounds is None or not raw.strip():
            continue
        elif BOTTOM.match(raw):
            bounds = None
        elif MID.match(raw):
            lower = [k for k, c in enumerate(raw.rstrip()) if c in "├┼┬┤"]
            bounds, band, line = lower, band + 1, 0
        else:
            line += 1
            found = cut(raw, bounds)
            if found is None:
                yield grid, band, line, 0, raw, "no line of the table"
            else:
                for k, c in enumerate(found, 1):
                    yield grid, band, line, k, c, None
    if bounds is not None:
        yield grid, band, line, 0, None, "not closed"


@udtf(returnType=CELLS)
class TextCells:
    """The cells of one text as rows, for LATERAL joins in SQL."""

    def eval(self, text: str):
        yield from cells(text)


def text_cells(df: DataFrame, column: str) -> DataFrame:
    """df with grid, band, line, col, cell and problem: a row for each cell of each table that a text column holds.

    grid numbers the tables of a text, band what stands between two rules, line its lines and col its columns, all from 1. A
    line that is no line of its table is a row with col 0, its text and a problem; so is a table that another one or the text's
    end breaks off. Blank lines count for nothing. Texts without tables (null and empty ones too) give no rows. Columns of df keep their names.
    """
    spark, name, view = df.sparkSession, f"text_cells_{uuid.uuid4().hex}", f"texts_{uuid.uuid4().hex}"
    spark.udtf.register(name, TextCells)
    df.createOrReplaceTempView(view)
    try:
        return spark.sql(f"SELECT t.*, c.* FROM {view} t, LATERAL {name}(t.`{column}`) c")
    finally:
        spark.catalog.dropTempView(view)


def banded(found: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the lines of one band as one: a cell that goes on below is joined in the order of its lines, without a space."""
    good = found.filter("problem IS NULL")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line", "cell"))), lambda x: x["cell"])
    return good.groupBy(*keys, "grid", "band", "col").agg(F.array_join(parts, "").alias("cell"))


def records(found: DataFrame, keys: list[str], first: str) -> DataFrame:
    """(keys, grid, row, name, value): data cells under the name of their column, for tables of one line a row.

    The line whose first cell is `first` names the columns of what follows in its table; a line with an empty first cell goes
    on with the row above, value by value. Lines above the header belong to none.
    """
    good = found.filter("problem IS NULL")
    w = W.partitionBy(*keys, "grid").orderBy("band", "line")
    lines = good.groupBy(*keys, "grid", "band", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "cell"))), lambda x: x["cell"]).alias("cells"))
    lines = lines.withColumn("_head", F.when(F.col("cells")[0] == first, F.col("cells"))).withColumn("head", F.last("_head", True).over(w))
    data = lines.filter("head IS NOT NULL AND _head IS NULL").withColumn("row", F.sum(F.when(F.col("cells")[0] != "", 1).otherwise(0)).over(w)).filter("row > 0")
    each = data.select(*keys, "grid", "row", "band", "line", F.posexplode(F.arrays_zip(F.col("head").alias("name"), F.col("cells").alias("value"))).alias("pos", "x"))
    each = each.filter("x.name IS NOT NULL AND x.value <> ''").groupBy(*keys, "grid", "row", F.col("x.name").alias("name")).agg(F.array_sort(F.collect_list(F.struct("band", "line", F.col("x.value").alias("v")))).alias("v"))
    return each.select(*keys, "grid", F.col("row").cast("long").alias("row"), "name", F.array_join(F.transform("v", lambda y: y["v"]), "").alias("value"))
