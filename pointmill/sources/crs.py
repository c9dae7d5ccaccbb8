"""Coordinate reference systems as scans carry them: WKT text or GeoTIFF keys."""

from __future__ import annotations

import re
import struct

#: Record ids that describe a reference system (fixed values of the LAS and GeoTIFF formats).
GEO_KEYS, GEO_DOUBLES, GEO_ASCII, WKT_MATH, WKT_CRS = 34735, 34736, 34737, 2111, 2112
RECORDS = (GEO_KEYS, GEO_DOUBLES, GEO_ASCII, WKT_MATH, WKT_CRS)
PROJECTED_KEY, GEOGRAPHIC_KEY, NOT_SET, USER_DEFINED = 3072, 2048, 0, 32767

_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z0-9_]*)|([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)|([\[\](),]))')


def parse_wkt(text: str) -> tuple[str, list] | None:
    """(keyword, items) with nested nodes as tuples; None if it is no WKT."""
    tokens = [m.lastindex and (m.lastindex, m.group(m.lastindex)) for m in _TOKEN.finditer(text)]
    tokens = [t for t in tokens if t]
    stack: list[tuple[str, list]] = []
    name = None
    for kind, value in tokens:
        if kind == 2:
            if name is not None and stack:
                stack[-1][1].append(name)
            name = value
        elif value in "[(" and kind == 4:
            if name is None:
                return None
            stack.append((name.upper(), []))
            name = None
        elif value in "])" and kind == 4:
            if not stack:
                return None
            if name is not None:
                stack[-1][1].append(name)
                name = None
            node = stack.pop()
            if not stack:
                return node
            stack[-1][1].append(node)
        elif kind in (1, 3) and stack:
            stack[-1][1].append(value.replace('""', '"') if kind == 1 else value)
        elif value == "," and name is not None and stack:
            stack[-1][1].append(name)
            name = None
    return None


def epsg_of_wkt(text: str | None) -> int | None:
    """The EPSG code of the root's own authority; of a compound system that of its horizontal part."""
    node = parse_wkt(text or "")
    if node is None:
        return None
    key, items = node
    if key in ("COMPD_CS", "COMPOUNDCRS"):
        node = next((x for x in items if isinstance(x, tuple) and x[0] not in ("AUTHORITY", "ID")), None)
        if node is None:
            return None
        items = node[1]
    for x in items:
        if isinstance(x, tuple) and x[0] in ("AUTHORITY", "ID") and len(x[1]) > 1 and str(x[1][0]).upper() == "EPSG":
            try:
                return int(float(x[1][1]))
            except (TypeError, ValueError):
                return None
    return None


def epsg_of_keys(data: bytes | None) -> int | None:
    """The code of the projected system, else of the geographic one."""
    if not data or len(data) < 8:
        return None
    n = struct.unpack_from("<H", data, 6)[0]
    found = {}
    for i in range(min(n, (len(data) - 8) // 8)):
        key, place, _, value = struct.unpack_from("<4H", data, 8 + 8 * i)
        if place == 0 and value not in (NOT_SET, USER_DEFINED):
            found[key] = value
    return found.get(PROJECTED_KEY, found.get(GEOGRAPHIC_KEY))


def reference_of(records: list[dict]) -> dict:
    """epsg and wkt of the records (user_id, record_id, description, data); WKT comes before keys."""
    wkt = next((r["data"].split(b"\0")[0].decode("utf-8", "replace") for r in records if r["record_id"] == WKT_CRS), None) or None
    epsg = epsg_of_wkt(wkt) if wkt else epsg_of_keys(next((r["data"] for r in records if r["record_id"] == GEO_KEYS), None))
    return {"wkt": wkt, "epsg": epsg}
