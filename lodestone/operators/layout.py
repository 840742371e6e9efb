"""Layout of document pages from the boxes of their lines: header band, gutter, columns, and how sure that is."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..storage import ship


@dataclass(frozen=True)
class Rules:
    """Lengths in points, and shares of the page or of its lines."""

    least_lines: int = 6
    band: tuple[float, float] = (0.25, 0.75)
    step: float = 3.0
    crossing_lines: int = 2
    crossing_share: float = 0.08
    rough_header: float = 0.12
    start_window: float = 0.075
    header_gap: float = 4.0
    header_reach: float = 0.42
    header_wide: float = 0.52
    header_centred: float = 0.18
    side_lines: int = 3
    side_share: float = 0.15
    gutter: float = 24.0
    clean: float = 0.62
    interleaved: float = 0.30
    edge_gap: float = 55.0
    zone_share: float = 0.20
    zone_span: float = 0.30
    unsure: float = 0.5


RULES = Rules()


def clusters(x: np.ndarray, gap: float) -> np.ndarray:
    """Number of the cluster of each value: a step of more than ``gap`` between sorted neighbours starts one."""
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x), dtype=np.int64)
    out[order] = np.concatenate([[0], np.cumsum(np.diff(x[order]) > gap)]) if len(x) else []
    return out


def _zones(b: np.ndarray, height: float, r: Rules) -> int:
    """Clusters of left edges with enough lines over enough of the page's height."""
    c = clusters(b[:, 0], r.edge_gap)
    spans = [(b[c == k, 3].max() - b[c == k, 2].min()) / max(1.0, height) for k in range(c.max() + 1)]
    return sum(n / len(b) >= r.zone_share and s >= r.zone_span for n, s in zip(np.bincount(c), spans, strict=True))


def _crossed(b: np.ndarray, x: np.ndarray | float) -> np.ndarray:
    return (b[:, :1] < np.atleast_1d(x) - 1) & (b[:, 1:2] > np.atleast_1d(x) + 1)


def _gutter(b: np.ndarray, width: float, r: Rules) -> float | None:
    """The middle of the widest stretch (the first of equals) that the fewest lines cross; None if those are many."""
    low, high = r.band[0] * width, r.band[1] * width
    xs = low + r.step * np.arange(int((high - low) // r.step) + 1)
    n = _crossed(b, xs).sum(axis=0)
    if n.min() > max(r.crossing_lines, int(r.crossing_share * len(b))):
        return None
    at = np.flatnonzero(n == n.min())
    run = max(np.split(at, np.flatnonzero(np.diff(at) > 1) + 1), key=len)
    return float(xs[run[len(run) // 2]])


def _header(b: np.ndarray, split: float, width: float, height: float, r: Rules) -> np.ndarray:
    """Lines above the place where both columns have begun, if they look like a header."""
    none = np.zeros(len(b), dtype=bool)
    left, right = np.sort(b[b[:, 1] <= split, 2]), np.sort(b[b[:, 0] >= split, 2])
    near = np.abs(left[:, None] - right[None, :]) <= r.start_window * height
    if not near.any():
        return none
    i = int(near.any(axis=1).argmax())
    start, top = min(left[i], right[near[i].argmax()]), b[:, 2].min()
    above = b[:, 2] < start - 1.0
    if not r.header_gap <= start - top <= r.header_reach * height or not above.any() or (~above).sum() < r.least_lines:
        return none
    h = b[above]
    wide = h[:, 1] - h[:, 0] >= r.header_wide * width
    centred = np.abs(h[:, :2].mean(axis=1) - width / 2) < r.header_centred * width
    return above if (wide | centred | ((h[:, 0] < split) & (split < h[:, 1]))).any() else none


def _free_share(b: np.ndarray, split: float) -> float:
    """Share of the lines' height over which none crosses ``split``."""
    inside = b[_crossed(b, split)[:, 0]]
    inside = inside[np.argsort(inside[:, 2], kind="stable")]
    covered = 0.0
    if len(inside):
        reached = np.maximum.accumulate(inside[:, 3])
        begin = np.maximum(inside[1:, 2], reached[:-1])
        covered = reached[0] - inside[0, 2] + np.maximum(0.0, inside[1:, 3] - begin).sum()
    return float(np.clip(1.0 - covered / max(1.0, b[:, 3].max() - b[:, 2].min()), 0.0, 1.0))


def page_zones(b: np.ndarray, width: float, height: float, r: Rules = RULES) -> tuple[np.ndarray, float, float | None]:
    """(zone of each line, confidence, gutter) for boxes (x0, x1, y0, y1); zones are header, body, left and right.

    Two columns need a gutter that few lines cross and none bridges, enough lines on either side and ranges of height that
    overlap; everything else is one column.  Three or more text columns make any result unsure.
    """
    zones = np.full(len(b), "body", dtype=object)
    if len(b) < r.least_lines:
        return zones, 1.0, None
    sure = r.unsure if _zones(b, height, r) >= 3 else 1.0
    rough = b[b[:, 2] > b[:, 2].min() + r.rough_header * height]
    split = _gutter(rough if len(rough) >= r.least_lines else b, width, r)
    header = _header(b, width / 2 if split is None else split, width, height, r)
    zones[header] = "header"
    body = b[~header]
    split = _gutter(body, width, r) if len(body) >= r.least_lines else None
    if split is None:
        return zones, sure, None
    on_left = body[:, :2].mean(axis=1) < split
    small, large = sorted((int(on_left.sum()), int((~on_left).sum())))
    if small < r.side_lines or small / len(body) < r.side_share:
        return zones, sure, None
    a, c = body[on_left], body[~on_left]
    ranges = [(s[:, 2].min(), s[:, 3].max()) for s in (a, c)]
    overlap = max(0.0, min(e for _, e in ranges) - max(s for s, _ in ranges))
    shortest = min(e - s for s, e in ranges)
    clean, inter = _free_share(body, split), overlap / shortest if shortest > 0 else 0.0
    if c[:, 0].min() - a[:, 1].max() < r.gutter or clean < r.clean or inter < r.interleaved:
        return zones, sure, None
    zones[~header] = np.where(on_left, "left", "right")
    return zones, min(sure, round(0.5 * clean + 0.3 * min(1.0, 1.6 * inter) + 0.2 * min(1.0, 2.2 * small / large), 3)), split


LINES = "doc_id bigint, page int, place int, zone string, text string, confidence double, split_x double"
_ORDER = {"header": 0, "body": 1, "left": 1, "right": 2}
_BOX = ["x0", "x1", "y0", "y1"]


def _laid_out(batches):
    """Rows (doc_id, page, page_width, page_height, lines): the zones of each page, and one sort for all lines of a batch."""
    for batch in batches:
        lists = batch.column(4)
        owner = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(lists)))
        line = lists.flatten()
        boxes = np.stack([np.asarray(line.field(c), dtype=float) for c in _BOX], axis=1).reshape(-1, len(_BOX))
        ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        sizes = zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        pages = [page_zones(boxes[a:b], width, height) for a, b, width, height in sizes]
        zone = np.concatenate([z for z, _, _ in pages]) if pages else np.array([], dtype=object)
        keys = {"owner": owner, "rank": np.array([_ORDER[z] for z in zone], dtype=np.int64), "y": np.round(boxes[:, 2], 1), "x0": boxes[:, 0], "text": line.field("text")}
        order = np.asarray(pc.sort_indices(pa.table(keys), [(k, "ascending") for k in keys]))
        of_page = lambda values: pa.array(values, pa.float64()).take(pa.array(owner))
        out = [batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(np.arange(len(owner)) - ends[owner], pa.int32()), pa.array(zone[order], pa.string()), line.field("text").take(pa.array(order))]
        yield pa.RecordBatch.from_arrays([*out, of_page([c for _, c, _ in pages]), of_page([s for _, _, s in pages])], ["doc_id", "page", "place", "zone", "text", "confidence", "split_x"])


def page_layouts(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, x0, x1, y0, y1, text, page_width, page_height) in reading order with their zone and the page's confidence.

    Header first, then the left and then the right column, each from top to bottom.  Blank lines and lines without a box go;
    of equal boxes the text decides.  A page is one row of an Arrow batch, which bounds it; many pages share a batch.
    """
    ship(lines.sparkSession)
    fine = lines.where("trim(text) != ''").dropna(subset=[*_BOX, "page_width", "page_height"])
    line = F.struct(*(F.col(c).cast("double").alias(c) for c in _BOX), F.col("text"))
    size = lambda c: F.first(F.col(c).cast("double")).alias(c)
    pages = fine.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page").cast("int").alias("page")).agg(size("page_width"), size("page_height"), F.collect_list(line).alias("lines"))
    return pages.mapInArrow(_laid_out, LINES)
