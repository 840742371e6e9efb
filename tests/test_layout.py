"""Zones of pages: columns, headers, pages that only look like two columns, and odd input."""

import numpy as np
import pytest

from lodestone.operators import layout as P


def column(x0, x1, y, n, step=20.0):
    return [(x0, x1, y + i * step, y + i * step + 10.0) for i in range(n)]


def zones(*blocks, width=600.0, height=800.0):
    z, confidence, split = P.page_zones(np.array([b for k in blocks for b in k]), width, height)
    return [int((z == k).sum()) for k in ("header", "body", "left", "right")], confidence, split


def test_one_column_and_few_lines():
    assert zones(column(50, 550, 40, 12)) == ([0, 12, 0, 0], 1.0, None)
    assert zones(column(50, 250, 40, 2), column(330, 550, 40, 3)) == ([0, 5, 0, 0], 1.0, None)


def test_header_and_columns():
    assert zones(column(150, 450, 40, 2), column(50, 250, 120, 8), column(330, 550, 130, 8))[0] == [2, 0, 8, 8]


def test_stacked_sides_are_one_column():
    assert zones(column(50, 250, 40, 8), column(330, 550, 300, 8))[0] == [0, 16, 0, 0]


def test_narrow_gutter_is_none():
    assert zones(column(50, 290, 40, 8), column(305, 550, 40, 8))[0] == [0, 16, 0, 0]


def test_lines_across_lower_confidence():
    plain = zones(column(50, 250, 40, 10), column(330, 550, 40, 10))
    crossed = P._free_share(np.array(column(50, 250, 40, 10) + [(50, 550, 100, 120), (50, 550, 110, 130)]), 291.0)
    assert plain[1] == 1.0 and crossed == pytest.approx(1 - 30 / 190)


def test_three_zones_are_unsure():
    assert zones(*[column(x, x + 120, 40, 10, 30.0) for x in (40, 240, 420)])[1] == 0.5


def test_clusters():
    assert P.clusters(np.array([100.0, 10.0, 60.0, 200.0]), 55).tolist() == [0, 0, 0, 1]
    assert P.clusters(np.array([]), 55).tolist() == []


def test_blank_null_and_empty(spark):
    kind = "doc_id bigint, page int, x0 double, x1 double, y0 double, y1 double, text string, page_width double, page_height double"
    rows = [(1, 1, 0.0, 9.0, 5.0, 6.0, "b", 600.0, 800.0), (1, 1, 0.0, 9.0, 5.0, 6.0, "a", 600.0, 800.0), (1, 1, 0.0, 9.0, 5.0, 6.0, " ", 600.0, 800.0), (1, 1, None, 9.0, 5.0, 6.0, "x", 600.0, 800.0), (2, 1, 0.0, 9.0, 5.0, 6.0, None, 600.0, 800.0)]
    lines = spark.createDataFrame(rows, kind)
    assert [(r.place, r.text) for r in P.page_layouts(lines).orderBy("place").collect()] == [(0, "a"), (1, "b")]
    assert P.page_layouts(lines.limit(0)).count() == 0


def test_pages_share_batches(spark):
    """Many pages in one batch get what each gets alone, and no page is a group of its own in Python (F1)."""
    rng = np.random.default_rng(7)
    kind = "doc_id bigint, page int, x0 double, x1 double, y0 double, y1 double, text string, page_width double, page_height double"
    pages = {}
    for i in range(60):
        blocks = [column(*x, float(rng.integers(30, 200)), int(rng.integers(1, 14))) for x in [(50, 250), (330, 550), (40, 560)][: int(rng.integers(1, 4))]]
        pages[i] = [(float(a), float(b), float(c), float(d)) for k in blocks for a, b, c, d in k]
    rows = [(i, 1, *b, f"t{j}", 600.0, 800.0) for i, boxes in pages.items() for j, b in enumerate(boxes)]
    out = P.page_layouts(spark.createDataFrame(rows, kind))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    got = {}
    for r in out.orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append((r.place, r.zone, r.text, r.confidence, r.split_x))
    for i, boxes in pages.items():
        zone, confidence, split = P.page_zones(np.array(boxes), 600.0, 800.0)
        order = sorted(range(len(boxes)), key=lambda j: (P._ORDER[zone[j]], round(boxes[j][2], 1), boxes[j][0], f"t{j}"))
        assert got[i] == [(k, zone[j], f"t{j}", confidence, split) for k, j in enumerate(order)]
