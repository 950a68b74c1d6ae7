"""Scalar, time and geometry expressions.

Boxes are structs ``(x, y, w, h)`` unless stated otherwise; all functions
return Column expressions made of built-ins (no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Object label ids 1..80 in detector order.
CATEGORY_NAMES = [
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light",
    "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep", "cow",
    "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee",
    "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove", "skateboard", "surfboard",
    "tennis racket", "bottle", "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple",
    "sandwich", "orange", "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch",
    "potted plant", "bed", "dining table", "toilet", "tv", "laptop", "mouse", "remote", "keyboard",
    "cell phone", "microwave", "oven", "toaster", "sink", "refrigerator", "book", "clock", "vase",
    "scissors", "teddy bear", "hair drier", "toothbrush",
]
# Super categories 1..12 and the last label id of each.
SUPER_CATEGORY_NAMES = ["person", "vehicle", "outdoor", "animal", "accessory", "sports", "kitchen", "food",
                        "furniture", "electronic", "appliance", "indoor"]
SUPER_CATEGORY_LAST_LABEL = [1, 9, 14, 24, 29, 39, 46, 56, 62, 68, 73, 80]
# Processed-frame step (s) and the detector's frame side (px).
PROCESS_STEP_S = 0.2
DETECTOR_SIDE_PX = 300
# --------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(x) -> Column:
    """Round to 6 decimals as ``floor(x * 1e6 + 0.5) / 1e6``: plain IEEE steps,
    so equal inputs round equally on any engine (no half-way disagreements)."""
    return F.floor(_c(x) * 1e6 + 0.5) / 1e6


def clip_length_s(start_ms, end_ms) -> Column:
    """``round(end/1000 - start/1000)`` with half-even rounding (NumPy)."""
    return F.bround(_c(end_ms) / 1000 - _c(start_ms) / 1000, 0)


def n_pieces(length_s, piece_s: float = 15) -> Column:
    """Number of whole pieces of ``piece_s`` seconds."""
    return F.floor(_c(length_s) / piece_s)


def seconds_to_time(secs) -> Column:
    """struct(hrs, mins, secs, hundredths); ``mins`` are total minutes
    (not modulo 60) and every part truncates toward zero, as the original."""
    s = _c(secs)
    whole = s.cast("long")  # truncates toward zero, like int()
    return F.struct(
        (s / 3600).cast("long").alias("hrs"),
        (s / 60).cast("long").alias("mins"),
        F.pmod(whole, F.lit(60)).alias("secs"),
        (100 * (s - whole)).cast("long").alias("hundredths"),
    )


def dict_value(text, key: str) -> Column:
    """Value of ``key`` in a dict printed as text (single quotes allowed)."""
    m = F.from_json(_c(text), "map<string,string>", {"allowSingleQuotes": "true"})
    return F.try_element_at(m, F.lit(key))


def decode_utf8(binary) -> Column:
    """Bytes -> UTF-8 text."""
    return F.decode(_c(binary), "UTF-8")


def finite_or_null(x) -> Column:
    """NaN and +-Inf become null."""
    v = _c(x)
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None)).otherwise(v)


def to_decimal(x, precision: int = 7, scale: int = 5, strict: bool = False) -> Column:
    """Cast to DECIMAL(p, s) at the sink; null on overflow unless
    ``strict`` (then the ANSI cast raises NUMERIC_VALUE_OUT_OF_RANGE)."""
    t = f"decimal({precision},{scale})"
    return _c(x).cast(t) if strict else _c(x).try_cast(t)


def super_category(label) -> Column:
    """Label id (1-80) -> super category id (1-12); null outside 1..80."""
    lab = _c(label)
    e = None
    for i, last in enumerate(SUPER_CATEGORY_LAST_LABEL, start=1):
        cond = (lab >= 1) & (lab <= last)
        e = F.when(cond, F.lit(i)) if e is None else e.when(cond, F.lit(i))
    return e.cast("int")


def category_name(label) -> Column:
    """Label id -> name by position (a constant array, no join needed)."""
    return F.get(F.array(*[F.lit(n) for n in CATEGORY_NAMES]), _c(label).cast("int") - 1)


def rect_area(box) -> Column:
    """T24: "area" as the product of all four numbers (as the original does)."""
    b = _c(box)
    return b["x"] * b["y"] * b["w"] * b["h"]


def overlap_ratio(r1, r2) -> Column:
    """2 * intersection / (area1 + area2) for (x, y, w, h) boxes;
    null when both boxes have zero area."""
    a, b = _c(r1), _c(r2)
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    inter = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))
    return F.try_divide(2.0 * inter, a["w"] * a["h"] + b["w"] * b["h"])


def ltrb_to_xywh(box) -> Column:
    """Detector box (left, bottom, right, top) as the (x, y, w, h) struct the
    overlap test reads.  ``box_format='raw'`` in the object operators feeds the
    four numbers unchanged, as the original does (N19)."""
    b = _c(box)
    return F.struct(b["l"].alias("x"), b["b"].alias("y"), (b["r"] - b["l"]).alias("w"), (b["t"] - b["b"]).alias("h"))


def raw_as_xywh(box) -> Column:
    b = _c(box)
    return F.struct(b["l"].alias("x"), b["b"].alias("y"), b["r"].alias("w"), b["t"].alias("h"))


def angle_diff(a1, a2) -> Column:
    """``|a2 - a1|``, minus 360 when above 180 (as the original)."""
    d = F.abs(_c(a2) - _c(a1))
    return F.when(d > 180, d - 360).otherwise(d)
