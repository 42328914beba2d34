"""Rules over the metadata of video streams: HDR signals, colour range, choice of a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STREAMS = "struct<streams: array<struct<index: int, codec_tag_string: string, color_transfer: string, color_primaries: string, color_space: string, matrix_coefficients: string, color_range: string, pix_fmt: string, bits_per_raw_sample: string, avg_frame_rate: string, side_data_list: array<struct<side_data_type: string>>>>>"
FRAMES = "struct<frames: array<struct<stream_index: int, color_transfer: string, side_data_list: array<struct<side_data_type: string>>>>>"
#: Transfer functions and side data that mark HDR, and names of deep pixel formats (fixed values).
HDR_TRANSFERS = ["smpte2084", "arib-std-b67", "hlg", "bt2020-10", "bt2020-12"]
HDR_SIDE_DATA = ["dolby vision", "dovi", "hdr10+", "mastering display metadata", "content light level", "cta 861-3"]
DEEP_FORMATS = ["p10", "p12", "p14", "p16"]


def plain_name(text: Column) -> Column:
    """The last part of a dotted enum name in lower case; empty for unknown."""
    name = F.lower(F.trim(F.substring_index(F.coalesce(text, F.lit("")), ".", -1)))
    return F.when(name == "unknown", "").otherwise(name)


def _any(text: Column, parts: list[str]) -> Column:
    return F.coalesce(text.rlike("|".join(p.replace("+", r"\+") for p in parts)), F.lit(False))


def hdr_reason(s: Column, place: Column) -> Column:
    """Why a stream counts as HDR, by the first rule that holds; null if none does."""
    low = lambda k: F.lower(F.coalesce(s[k], F.lit("")))
    head = F.concat(F.lit("v:"), F.coalesce(s["index"], place).cast("string"), F.lit(" "))
    side = F.get(F.filter(F.transform(s["side_data_list"], lambda d: F.lower(d["side_data_type"])), lambda t: _any(t, HDR_SIDE_DATA)), F.lit(0))
    deep = _any(s["pix_fmt"], DEEP_FORMATS) | F.coalesce(F.trim(s["bits_per_raw_sample"]).try_cast("int") >= 10, F.lit(False))
    wide = F.concat_ws(" ", low("color_primaries"), low("color_space"), low("matrix_coefficients")).contains("2020")
    return (
        F.when(low("codec_tag_string").startswith("dvh") | low("codec_tag_string").contains("dvhe"), F.concat(head, F.lit("dolby-vision tag="), low("codec_tag_string")))
        .when(low("color_transfer").isin(HDR_TRANSFERS), F.concat(head, F.lit("transfer="), low("color_transfer")))
        .when(side.isNotNull(), F.concat(head, F.lit("hdr side-data ("), side, F.lit(")")))
        .when(deep & wide, F.concat(head, F.lit("bt2020 "), F.coalesce(F.nullif(s["pix_fmt"], F.lit("")), s["bits_per_raw_sample"])))
    )


def first_hdr_reason(streams: Column) -> Column:
    reasons = F.filter(F.transform(streams, hdr_reason), lambda r: r.isNotNull())
    return F.coalesce(F.get(reasons, F.lit(0)), F.when(F.coalesce(F.size(streams), F.lit(0)) <= 0, "no streams").otherwise("no HDR signal across video streams"))


def colour_range(streams: Column) -> Column:
    return F.when(F.lower(F.get(streams, F.lit(0))["color_range"]).isin("pc", "jpeg", "full"), "full").otherwise("limited")


def reader(is_hdr: Column, forced: str = "") -> Column:
    """Which reader suits a file: tone mapping by filter or by pipe for HDR, the plain one otherwise."""
    return F.when(is_hdr, "pipe" if forced in ("zscale", "scale") else "filter").otherwise("plain")


def is_wide(text: Column) -> Column:
    return F.coalesce(F.lower(text).contains("2020"), F.lit(False))


def is_deep(pixel_format: Column, bits: Column) -> Column:
    return _any(F.lower(pixel_format), ["p10", "p012", "p016"]) | F.coalesce(bits >= 10, F.lit(False))


def is_hlg(transfer: Column) -> Column:
    return plain_name(transfer).isin("arib-std-b67", "hlg")


def passthrough(is_hdr: Column, has_pipe: Column) -> Column:
    """The reader that hands HDR samples on untouched; null where there is none."""
    return F.when(is_hdr & has_pipe, "p010 pipe")


def rate_and_total(rate: Column, frames: Column, other_rate: Column, other_frames: Column, seconds: Column, hint: float = 30.0) -> tuple[Column, Column]:
    """Frames a second and in all, from a first and, where that lacks one, a second probe; the total may come from the duration."""
    positive = lambda c: F.when(c > 0, c)
    second = F.coalesce(positive(other_frames), F.floor(positive(seconds) * positive(other_rate) + 0.5).cast("long"))
    return F.coalesce(F.when(rate > 1e-3, rate), positive(other_rate), F.lit(hint)), F.coalesce(positive(frames), second, F.lit(0).cast("long"))


def side_data(files: DataFrame, keep: list[str]) -> DataFrame:
    """keep, stream and kind: a row for each piece of side data of a file's frames, and one for a frame whose transfer is HDR."""
    each = files.select(*keep, F.explode("frames").alias("f")).select(*keep, F.col("f.stream_index").alias("stream"), F.col("f.side_data_list.side_data_type").alias("listed"), F.lower("f.color_transfer").alias("transfer"))
    own = F.when(F.col("transfer").isin(HDR_TRANSFERS), F.array(F.concat(F.lit("frame color_transfer "), F.col("transfer"))))
    none = F.array().cast("array<string>")
    return each.select(*keep, "stream", F.explode(F.concat(F.coalesce("listed", none), F.coalesce(own, none))).alias("kind"))
