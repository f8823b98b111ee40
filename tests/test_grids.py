"""Box-drawing tables on literals: wide characters, continued cells, bars within cells, broken tables."""

from tidemark.sources import grids

HOLDERS = """股东研究
┌────────────┬────────┬────┐
│股东名称    │持股数  │比例│
├────────────┼────────┼────┤
│香港中央结算│1234    │5.1 │
│有限公司    │        │    │
├────────────┼────────┼────┤
│A|B fund    │99      │0.1 │
└────────────┴────────┴────┘
between
┌──┬──┐
│a │b │
│ not a line
├──┴──┤
│wide │
┌──┐
│x │
"""


def test_cells_by_bars_and_places(spark):
    df = spark.createDataFrame([(1, HOLDERS), (2, None), (3, ""), (4, "no table\n│a│b│"), (5, "┌┐\n└┘")], "id int, text string")
    got = {}
    for r in grids.text_cells(df, "text").collect():
        got.setdefault((r.id, r.grid), []).append((r.band, r.line, r.col, r.cell, r.problem))
    assert set(got) == {(1, 1), (1, 2), (1, 3)}
    assert [c[3] for c in got[1, 1]] == ["股东名称", "持股数", "比例", "香港中央结算", "1234", "5.1", "有限公司", "", "", "A|B fund", "99", "0.1"]
    assert got[1, 1][-3][:3] == (3, 1, 1)
    assert got[1, 2] == [(1, 1, 1, "a", None), (1, 1, 2, "b", None), (1, 2, 0, "│ not a line", "no line of the table"), (2, 1, 1, "wide", None), (2, 1, 0, None, "not closed")]
    assert got[1, 3] == [(1, 1, 1, "x", None), (1, 1, 0, None, "not closed")]


def test_bands_join_what_goes_on_below(spark):
    found = grids.text_cells(spark.createDataFrame([(1, HOLDERS)], "id int, text string"), "text").drop("text").filter("grid = 1")
    got = {(r.band, r.col): r.cell for r in grids.banded(found, ["id"]).collect()}
    assert got[2, 1] == "香港中央结算有限公司" and got[2, 2] == "1234" and got[3, 1] == "A|B fund"


def test_records_by_header(spark):
    text = "┌──┬──┐\n│title│\n│名│数│\n│甲│1 │\n│  │2 │\n│乙│  │\n└──┴──┘"
    found = grids.text_cells(spark.createDataFrame([(7, text)], "id int, text string"), "text").drop("text")
    got = sorted((r.row, r.name, r.value) for r in grids.records(found, ["id"], "名").collect())
    assert got == [(1, "名", "甲"), (1, "数", "12"), (2, "名", "乙")]


def test_places_count_wide_characters_twice():
    assert grids.places("a股b") == [0, 1, 3, 4] and grids.joints("┌──┬─┐") == [0, 3, 5]
