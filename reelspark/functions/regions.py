"""Regions of a gray picture that keep their area over many tones, from the tree of its components; what is found near corners hints at text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import corner_marks

REGIONS = "array<struct<x:int,y:int,w:int,h:int,area:int,tone:int,dark:boolean>>"


def component_trees(grays: list[np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Components (4 neighbours) of the pixels not brighter than a tone, one row for each tone at which one has grown, by tone; and the picture of each row.

    Columns: tone, area, x1, y1, x2, y2 (inclusive) and parent, the row of the component it becomes next, or -1. Pixels
    are joined tone by tone; of each tone all edges of all pictures at once, by hooking roots to smaller ones until no edge joins two.
    """
    none = np.zeros(0, np.int64)
    sizes = np.array([g.size for g in grays], np.int64)
    begin = np.cumsum([0, *sizes])
    tones = np.concatenate([g.ravel() for g in grays] or [np.zeros(0, np.uint8)])
    places = [np.arange(n).reshape(g.shape) for g, n in zip(grays, sizes)]
    a = np.concatenate([none, *(x + s for p, s in zip(places, begin) for x in (p[:, :-1].ravel(), p[:-1].ravel()))])
    b = np.concatenate([none, *(x + s for p, s in zip(places, begin) for x in (p[:, 1:].ravel(), p[1:].ravel()))])
    heavy = np.maximum(tones[a], tones[b])
    by_edge, by_pixel = np.argsort(heavy, kind="stable"), np.argsort(tones, kind="stable")
    edges, pixels = np.searchsorted(heavy[by_edge], np.arange(257)), np.searchsorted(tones[by_pixel], np.arange(257))
    total = int(begin[-1])
    root, node, area = np.arange(total), np.full(total, -1), np.ones(total, np.int64)
    x, y = (np.concatenate([none, *(part(p, max(1, g.shape[1])) for p, g in zip(places, grays))]) for part in (lambda p, w: p.ravel() % w, lambda p, w: p.ravel() // w))
    low, high = [x.copy(), y.copy()], [x, y]
    picture = np.repeat(np.arange(len(grays)), sizes)
    rows, parent = [], []

    def find(x: np.ndarray) -> np.ndarray:
        r = root[x]
        while (up := root[r]).tobytes() != r.tobytes():
            r = up
        root[x] = r
        return r

    count = 0
    for tone in range(256):
        new, own = by_pixel[pixels[tone] : pixels[tone + 1]], by_edge[edges[tone] : edges[tone + 1]]
        if not len(new):
            continue
        p, q = a[own], b[own]
        before = np.unique(np.concatenate([new, find(p), find(q)]))
        while len(p):
            r, s = find(p), find(q)
            apart = r != s
            p, q = p[apart], q[apart]
            np.minimum.at(root, np.maximum(r[apart], s[apart]), np.minimum(r[apart], s[apart]))
        after = find(before)
        moved = after != before
        np.add.at(area, after[moved], area[before[moved]])
        for k in (0, 1):
            np.minimum.at(low[k], after[moved], low[k][before[moved]])
            np.maximum.at(high[k], after[moved], high[k][before[moved]])
        tops, place = np.unique(after, return_inverse=True)
        known = node[before] >= 0
        parent.append((node[before[known]], count + place[known]))
        node[tops] = count + np.arange(len(tops))
        count += len(tops)
        rows.append(np.stack([np.full(len(tops), tone), area[tops], low[0][tops], low[1][tops], high[0][tops], high[1][tops], picture[tops]]))
    made = dict(zip(("tone", "area", "x1", "y1", "x2", "y2", "picture"), np.concatenate(rows, axis=1) if rows else [none] * 7))
    made["parent"] = np.full(count, -1)
    for child, up in parent:
        made["parent"][child] = up
    return made, made.pop("picture")


def component_tree(gray: np.ndarray) -> dict[str, np.ndarray]:
    """The rows of one picture."""
    return component_trees([gray])[0]


def stable(tree: dict[str, np.ndarray], delta: int = 5, least: int = 60, most: int = 5000, change: float = 0.25, apart: float = 0.2) -> np.ndarray:
    """Rows of the tree that are maximally stable.

    The change of a component is its growth over the next `delta` tones, over its area; the whole picture, which
    cannot grow, is no region and bounds no other. The change must be below `change`, no larger than that of what it becomes next and smaller than that of each it was made of; the area lies
    in least..most. Of what is left, a region is dropped if the next larger one around it that is left has less than `apart` of its area besides.
    """
    tone, area, parent = tree["tone"], tree["area"], tree["parent"]
    later = np.arange(len(tone))
    while True:
        up = parent[later]
        go = (up >= 0) & (tone[up] <= tone + delta)
        if not go.any():
            break
        later = np.where(go, up, later)
    has = parent >= 0
    growth = np.where(has, (area[later] - area) / np.maximum(area, 1), np.inf)
    from_below = np.full(len(tone), np.inf)
    np.minimum.at(from_below, parent[has], growth[has])
    good = (growth < change) & (area >= least) & (area <= most) & (growth < from_below) & ~(has & (growth > growth[parent]))
    around = parent.copy()  # the next good one upwards; those that are not good pass on what is above them, twice as far each time
    over = np.where(good, np.arange(len(tone)), parent)
    while True:
        go = (around >= 0) & ~good[around]
        if not go.any():
            break
        around = np.where(go, over[around], around)
        over = np.where(good | (over < 0), over, np.where(over >= 0, over[over], over))
    return np.flatnonzero(good & ~((around >= 0) & ((area[around] - area) < apart * area[around])))


def regions(gray: np.ndarray, **limits) -> list[dict]:
    """Stable regions darker than what surrounds them, then brighter ones (their tone is counted from white)."""
    return regions_of_all([gray], **limits)[0]


def regions_of_all(grays: list[np.ndarray], **limits) -> list[list[dict]]:
    """The regions of each picture; their trees grow side by side."""
    found = [[] for _ in grays]
    for dark in (True, False):
        tree, picture = component_trees([g if dark else 255 - g for g in grays])
        chosen = stable(tree, **limits)
        t = {c: tree[c][chosen].tolist() for c in ("tone", "area", "x1", "y1", "x2", "y2")}
        for i, n in enumerate(picture[chosen].tolist()):
            found[n].append({"x": t["x1"][i], "y": t["y1"][i], "w": t["x2"][i] - t["x1"][i] + 1, "h": t["y2"][i] - t["y1"][i] + 1, "area": t["area"][i], "tone": t["tone"][i], "dark": dark})
    return found


def stable_regions(pictures: DataFrame, keep: list[str], pixels_at_once: int = 1 << 18, **limits) -> DataFrame:
    """keep, w, h and the stable regions of gray pictures (pixels, w, h; one byte a pixel). A null or short picture gets null, a flat one none.

    Small pictures are looked at together, up to pixels_at_once, as most of the time goes into steps, not pixels.
    """
    kind = pa.list_(pa.struct([(c, pa.bool_() if c == "dark" else pa.int32()) for c in ("x", "y", "w", "h", "area", "tone", "dark")]))

    def look(batches):
        for batch in batches:
            made, held = [None] * batch.num_rows, {}
            for i, (raw, w, h) in enumerate(zip(*(c.to_pylist() for c in batch.columns[-3:]))):
                if raw and w and h and w > 0 and h > 0 and len(raw) >= w * h:
                    held[i] = np.frombuffer(raw, np.uint8, w * h).reshape(h, w)
                if held and (i == batch.num_rows - 1 or sum(g.size for g in held.values()) >= pixels_at_once):
                    for k, found in zip(held, regions_of_all(list(held.values()), **limits)):
                        made[k] = found
                    held = {}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *batch.columns[-2:], pa.array(made, kind)], [*keep, "w", "h", "regions"])

    given = pictures.select(*keep, "pixels", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-3])
    return given.mapInArrow(look, f"{kinds}w int, h int, regions {REGIONS}")


def corner_score(found: Column, width: Column, height: Column) -> Column:
    """How much of a picture's corners looks like text, 0 to 1; 0 where no regions are known."""
    marks = F.filter(found, lambda r: corner_marks(r["x"], r["y"], r["w"], r["h"], width, height))
    return F.when(found.isNotNull(), F.least(F.lit(1.0), F.size(marks) / 25)).otherwise(0.0)
