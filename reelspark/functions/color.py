"""Transfer curves and colour matrices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import clamp

#: Constants of SMPTE ST 2084, ARIB STD-B67 and the Hable curve (fixed values).
PQ = {"m1": 2610 / 16384, "m2": 2523 / 32, "c1": 3424 / 4096, "c2": 2413 / 128, "c3": 2392 / 128}
HLG = {"a": 0.17883277, "b": 0.28466892, "c": 0.55991073}
HABLE = {"a": 0.15, "b": 0.50, "c": 0.10, "d": 0.20, "e": 0.02, "f": 0.30}


def pq_to_linear(v: Column) -> Column:
    p = F.pow(v, F.lit(1 / PQ["m2"]))
    return F.pow(F.greatest(p - PQ["c1"], F.lit(0.0)) / F.greatest(PQ["c2"] - PQ["c3"] * p, F.lit(1e-6)), F.lit(1 / PQ["m1"]))


def hlg_to_linear(v: Column) -> Column:
    return F.when(v <= 0.5, v * v / 3).otherwise((F.exp((v - HLG["c"]) / HLG["a"]) + HLG["b"]) / 12)


def hable(v: Column) -> Column:
    k = HABLE
    return (v * (k["a"] * v + k["c"] * k["b"]) + k["d"] * k["e"]) / (v * (k["a"] * v + k["b"]) + k["d"] * k["f"]) - k["e"] / k["f"]


def limited_to_rgb(y: Column, u: Column, v: Column) -> list[Column]:
    """8-bit limited-range BT.709 to red, green and blue of 0 to 255."""
    luma, cb, cr = (y - 16) * 1.16438356, u - 128, v - 128
    return [F.floor(clamp(c, 0.0, 255.0)) for c in (luma + 1.79274107 * cr, luma - 0.21324861 * cb - 0.53290933 * cr, luma + 2.11240179 * cb)]


def p010_to_rgb(y: Column, u: Column, v: Column) -> list[Column]:
    """16-bit words with 10-bit limited-range BT.2020 samples on top, to red, green and blue of 0 to 1."""
    ten = lambda c: F.shiftright(c, 6)
    luma, cb, cr = clamp((ten(y) - 64) / 876.0, 0.0, 1.0), (ten(u) - 512) / 896.0, (ten(v) - 512) / 896.0
    return [clamp(c, 0.0, 1.0) for c in (luma + 1.4746 * cr, luma - 0.164553 * cb - 0.571353 * cr, luma + 1.8814 * cb)]


def bt709(v: Column) -> Column:
    return clamp(F.when(v < 0.018, 4.5 * v).otherwise(1.099 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(0.45)) - 0.099), 0.0, 1.0)


#: Share of red, green and blue in BT.2020 luminance, and the white point of the Hable curve (fixed values).
LUMA = (0.2627, 0.6780, 0.0593)
HABLE_WHITE = 11.2


def tone_mapped(r: Column, g: Column, b: Column, peak_nits: float = 1000.0, target_nits: float = 200.0) -> list[Column]:
    """Linear light (1.0 is 10,000 nits) to 8-bit blue, green and red, scaled by luminance along the Hable curve."""
    nits = [clamp(c, 0.0, 1.0) * 10000.0 for c in (r, g, b)]
    luma = LUMA[0] * nits[0] + LUMA[1] * nits[1] + LUMA[2] * nits[2]
    k = HABLE
    white = (HABLE_WHITE * (k["a"] * HABLE_WHITE + k["c"] * k["b"]) + k["d"] * k["e"]) / (HABLE_WHITE * (k["a"] * HABLE_WHITE + k["b"]) + k["d"] * k["f"]) - k["e"] / k["f"]
    scale = clamp(hable(luma / max(peak_nits, 1e-3)) / white, 0.0, 1.0) * target_nits / F.greatest(luma, F.lit(1e-6))
    shown = lambda c: F.floor(bt709(clamp(clamp(c * scale, 0.0, target_nits) / 100.0, 0.0, 1.0)) * 255.0 + 0.5)
    return [shown(c) for c in reversed(nits)]
