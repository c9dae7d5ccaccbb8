"""A self-contained HTML report of survey quality, and summaries in words."""

from __future__ import annotations

import base64
import html
import math
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.formats import area_text, count_text, height_text, share_text
from ..operators.quality import Frame

#: Pixels along the longer side of an overview.
PIXELS = 1_200


def png(rgb: np.ndarray) -> bytes:
    """A PNG of an array (rows, cols, 4)."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[i].astype("u1").tobytes() for i in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">2I5B", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 9)) + part(b"IEND", b"")


def overview(density: DataFrame, median: float, frame: Frame, pixels: int = PIXELS) -> tuple[DataFrame, int]:
    """py, px, r, g, b, a (0 to 255) of an image of a density grid (row, col, value; null or absent cells are clear), and the cells along a pixel.

    The colours of all cells of a pixel are averaged, a is the share of them that have one, so the image has at
    most ``pixels`` x ``pixels`` rows, whatever the grid's size.
    """
    step = max(1, -(-max(frame.rows, frame.cols) // pixels))
    own = density.select("row", "col", G.density_rgb(F.col("value").cast("double"), F.lit(float(median))).alias("c")).filter("c IS NOT NULL")
    at = [F.floor(F.col(k) / step).cast("int").alias(p) for k, p in (("row", "py"), ("col", "px"))]
    mean = [G.js_round(F.avg(F.col("c")[i])).cast("int").alias(k) for i, k in enumerate("rgb")]
    out = own.groupBy(*at).agg(*mean, F.count("*").alias("n"))
    inside = F.least(F.lit(step), F.lit(frame.rows) - F.col("py") * step) * F.least(F.lit(step), F.lit(frame.cols) - F.col("px") * step)
    return out.select("py", "px", *"rgb", G.js_round(F.col("n") * 255.0 / inside).cast("int").alias("a")), step


def heatmap(density: DataFrame, median: float, frame: Frame, pixels: int = PIXELS) -> str:
    """A data URL of a density grid, averaged down to at most ``pixels`` along its longer side."""
    image, step = overview(density, median, frame, pixels)
    out = np.zeros((max(1, -(-frame.rows // step)), max(1, -(-frame.cols // step)), 4), "u1")
    t = image.toPandas()
    out[t["py"], t["px"]] = t[["r", "g", "b", "a"]].to_numpy()
    return "data:image/png;base64," + base64.b64encode(png(out)).decode()


def quality_html(name: str, checks: list[dict], density: dict, strips: list[dict], image: str | None = None) -> str:
    """One page; all texts are escaped."""
    e = lambda v: html.escape("–" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v))

    def grid(rows: list[dict]) -> str:
        if not rows:
            return "<p>none</p>"
        head = "".join(f"<th>{e(k)}</th>" for k in rows[0])
        return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{e(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"

    verdict = "fail" if any(c["verdict"] == "fail" for c in checks) else "pass"
    picture = f'<img alt="density" src="{image}">' if image else ""
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 8px}img{image-rendering:pixelated;max-width:100%}"
    return f"<!doctype html><html><head><meta charset=utf-8><title>{e(name)}</title><style>{style}</style></head><body><h1>{e(name)}</h1><p>Verdict: <b>{verdict}</b></p><h2>Checks</h2>{grid(checks)}<h2>Density</h2>{grid([density])}{picture}<h2>Strips</h2>{grid(strips)}</body></html>"


def noise_summary(stats: dict) -> str:
    """stats: n, and the stray points found low and high."""
    found = stats["low"] + stats["high"]
    if not found:
        return "No noise found."
    parts = [f"{count_text(stats[k])} {w}" for k, w in (("high", "stray above the surface"), ("low", "stray at or below it")) if stats[k]]
    return f"{count_text(found)} points are noise ({share_text(found, stats['n'])}): {', '.join(parts)}."


def ground_summary(stats: dict) -> str:
    return f"{share_text(stats['ground'], stats['n'])} of points are ground."


def quality_summary(level: str | None, checks: list[dict]) -> str:
    """level: the best quality level met; checks: rows with a verdict."""
    failed, review = (sum(c["verdict"] == v for c in checks) for v in ("fail", "review"))
    verdict = f"{failed} check{'' if failed == 1 else 's'} failed" if failed else f"{review} to review" if review else "every check passed"
    return f"Meets {level or 'below QL3'}; {verdict}."


def terrain_summary(stats: dict, interval: float, major: float) -> str:
    """stats: lowest and highest elevation, cell, and the cells measured and covered."""
    cell = f"{stats['cell']:.1f}" if stats["cell"] < 10 else str(math.floor(stats["cell"] + 0.5))
    return (
        f"Ground from {height_text(stats['low'])} to {height_text(stats['high'])} on a {cell} m grid; {share_text(stats['measured'], stats['covered'])} measured, "
        f"the rest filled in under buildings and trees. Contours every {interval:g} m, bold every {major:g} m."
    )


def inventory_summary(inv: dict) -> str:
    """inv: a row of :func:`objects.inventory`."""
    houses = f"Footprints cover {area_text(inv['built_area'])}, the tallest building rising {height_text(inv['tallest_building'])}." if inv["buildings"] else "No buildings found."
    low, high = inv["shortest_tree"], inv["tallest_tree"]
    trees = "No trees found." if not inv["trees"] else f"The tree stands {height_text(high)} tall." if inv["trees"] == 1 else f"Trees stand {height_text(low)} to {height_text(high)} tall."
    return f"{houses} {trees}"
