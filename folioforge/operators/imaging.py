"""Arithmetic on page images and word confidences; recognition itself is a provider (see sources)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, OFFSET = 31, 11
OTSU_RANGE = (0.45, 0.98)
LEAST_SKEW, LEAST_FOREGROUND = 0.5, 100


def image_quality(pixels: Column) -> Column:
    """STRUCT<brightness, contrast> of an array of gray values: mean and population standard deviation."""
    values = F.transform(pixels, lambda x: x.cast("double"))
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    held = F.transform(F.array(F.struct(values.alias("v"), mean.alias("m"))), lambda s: F.struct(s["m"].alias("brightness"), F.sqrt(F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + (x - s["m"]) * (x - s["m"])) / n).alias("contrast")))
    return F.when(n > 0, held[0])


def page_confidence(words: DataFrame, keys: list[str], confidence_col: str = "confidence") -> DataFrame:
    """Mean of the confidences of 0 or more per page; text that is no number is passed over; 0.0 without any."""
    c = F.col(confidence_col).try_cast("double")
    return words.groupBy(*keys).agg(F.coalesce(F.avg(F.when(c >= 0, c)), F.lit(0.0)).alias("confidence"))


def threshold_method(white_ratio: Column) -> Column:
    """Global threshold where its share of white is plausible, else the adaptive one."""
    return F.when(white_ratio.between(*OTSU_RANGE), "otsu").otherwise("adaptive")


def skew_angle(rectangle_angle: Column, foreground: Column) -> Column:
    """The page's skew from the angle of the smallest rectangle around its foreground; 0 with too little of it."""
    turned = F.when(rectangle_angle < -45, -(rectangle_angle + 90)).otherwise(-rectangle_angle)
    return F.when(foreground < LEAST_FOREGROUND, 0.0).otherwise(turned)


def needs_deskew(angle: Column) -> Column:
    return F.abs(angle) >= LEAST_SKEW


def otsu_threshold(pixels: DataFrame, keys: list[str], value_col: str = "gray") -> DataFrame:
    """(keys, threshold, white_ratio) by the largest between-class variance over the histogram of gray values 0 to 255.

    The histogram has 256 rows for each image, however large the images are.
    """
    from pyspark.sql import Window

    bins = pixels.groupBy(*keys, F.col(value_col).cast("int").alias("gray")).agg(F.count("*").alias("n"))
    image = Window.partitionBy(*keys)
    upto = image.orderBy("gray").rowsBetween(Window.unboundedPreceding, 0)
    summed = bins.select("*", F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("gray")).over(upto).alias("s0"), F.sum("n").over(image).alias("total"), F.sum(F.col("n") * F.col("gray")).over(image).alias("s"))
    n1 = F.col("total") - F.col("n0")
    mean_gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / F.when(n1 > 0, n1)
    judged = summed.withColumn("spread", F.coalesce(F.col("n0") * n1 * mean_gap * mean_gap, F.lit(0.0)))
    best = judged.groupBy(*keys, "total").agg(F.max_by(F.struct("gray", "n0"), F.struct("spread", -F.col("gray"))).alias("b"))
    return best.select(*keys, F.col("b.gray").alias("threshold"), ((F.col("total") - F.col("b.n0")) / F.col("total")).alias("white_ratio"))


#: A gray page image: its pixels row by row, a byte each.
IMAGE = "struct<width: int, height: int, gray: binary>"
BINARISED = "struct<method: string, threshold: int, white_ratio: double, binary: binary>"


def _gray(width: int, height: int, data: bytes | None) -> np.ndarray | None:
    """The pixels as a matrix; None for a missing, empty or truncated image."""
    if not data or width is None or height is None or width * height == 0 or len(data) != width * height:
        return None
    return np.frombuffer(data, np.uint8).reshape(int(height), int(width))


def _gray_of_rgb(rgb: pd.Series) -> pd.Series:
    weights = np.array([9798, 19235, 3735])  # fixed values: shares of the three in 32768

    def one(data: bytes | None) -> bytes | None:
        if data is None or len(data) % 3:
            return None
        return ((np.frombuffer(data, np.uint8).reshape(-1, 3) @ weights + (1 << 14)) >> 15).astype(np.uint8).tobytes()

    return pd.Series([one(x) for x in rgb])


def gray_of_rgb(rgb: Column) -> Column:
    """Gray bytes of pixels of three bytes each (red, green, blue), in fixed point; null for null or an uneven number."""
    return F.pandas_udf(_gray_of_rgb, "binary")(rgb)


def best_threshold(gray: np.ndarray) -> int:
    """The gray value up to which pixels are dark: that of the largest between-class variance, of several the least."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    n0, s0 = n.cumsum(), (n * np.arange(256)).cumsum()
    n1 = n0[-1] - n0
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = n0 * n1 * (s0 / n0 - (s0[-1] - s0) / n1) ** 2
    spread = np.where((n > 0) & (n1 > 0), spread, 0.0)
    spread[n == 0] = -1.0
    return int(spread.argmax())


def local_means(gray: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Gaussian means of the block around each pixel, whole numbers; the edge's pixels go on beyond it. One pass along rows, one along columns."""
    half = block // 2
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    taps = np.exp(-((np.arange(block) - half) ** 2) / (2 * sigma**2))
    taps /= taps.sum()
    wide = np.pad(gray.astype(float), ((0, 0), (half, half)), "edge")
    across = sum(w * wide[:, k : k + gray.shape[1]] for k, w in enumerate(taps))
    tall = np.pad(across, ((half, half), (0, 0)), "edge")
    return np.rint(sum(w * tall[k : k + gray.shape[0]] for k, w in enumerate(taps)))


def _binarised(image: pd.DataFrame) -> pd.DataFrame:
    def one(width: int, height: int, data: bytes | None) -> tuple:
        gray = _gray(width, height, data)
        if gray is None:
            return None, None, None, None
        level = best_threshold(gray)
        white, method = gray > level, "otsu"
        if not OTSU_RANGE[0] <= white.mean() <= OTSU_RANGE[1]:
            white, method = gray - local_means(gray) > -OFFSET, "adaptive"
        return method, level, float(white.mean()), (white * np.uint8(255)).tobytes()

    rows = [one(*r) for r in zip(image["width"], image["height"], image["gray"], strict=True)]
    made = pd.DataFrame(rows, columns=["method", "threshold", "white_ratio", "binary"], dtype=object)
    return made.astype({"threshold": "Int32"})


def binarised(image: Column) -> Column:
    """Black and white of a gray image (IMAGE): by one threshold where its share of white is plausible, else by each pixel's surroundings.

    threshold is the global one in either case, white_ratio that of the result. Null for an
    image without pixels or with more or fewer bytes than pixels.
    """
    return F.pandas_udf(_binarised, BINARISED)(image)


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of whole-numbered points, in turn; points on its edges are none."""
    points = np.unique(points, axis=0)

    def chain(some: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1])) if len(points) > 2 else points


def rectangle_angle(points: np.ndarray) -> float:
    """Degrees, over 0 up to 90, from the first axis to a side of the smallest rectangle around the points.

    A side of it lies on an edge of the hull. Of several smallest ones, the least angle.
    """
    corners = hull(points).astype(float)
    edges = np.roll(corners, -1, axis=0) - corners
    angles = np.unique(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2)) if len(corners) > 1 else np.zeros(1)
    c, s = np.cos(angles)[:, None], np.sin(angles)[:, None]
    along, beside = corners[:, 0] * c + corners[:, 1] * s, corners[:, 1] * c - corners[:, 0] * s
    areas = np.ptp(along, axis=1) * np.ptp(beside, axis=1)
    best = angles[np.flatnonzero(areas <= areas.min() * (1 + 1e-12))[0]]
    return float(np.degrees(best)) or 90.0


def _text_rectangle(image: pd.DataFrame) -> pd.DataFrame:
    def one(width: int, height: int, data: bytes | None) -> tuple:
        gray = _gray(width, height, data)
        if gray is None:
            return 0.0, 0
        dark = gray <= best_threshold(gray)
        rows = np.flatnonzero(dark.any(axis=1))
        first, last = dark[rows].argmax(axis=1), dark.shape[1] - 1 - dark[rows, ::-1].argmax(axis=1)
        ends = np.stack([np.concatenate([rows, rows]), np.concatenate([first, last])], axis=1)
        return rectangle_angle(ends), int(dark.sum())

    return pd.DataFrame([one(*r) for r in zip(image["width"], image["height"], image["gray"], strict=True)], columns=["angle", "foreground"])


def text_rectangle(image: Column) -> Column:
    """Angle of the smallest rectangle around the dark pixels of a gray image (IMAGE), by row and column, and how many they are.

    Of each row of pixels only the first and last dark one can be a corner of the hull.
    """
    return F.pandas_udf(_text_rectangle, "struct<angle: double, foreground: long>")(image)


def page_skew(image: Column) -> Column:
    """The skew of a gray image (IMAGE), by ``skew_angle``; 0 without enough dark pixels or without an image."""
    found = text_rectangle(image)
    return skew_angle(found["angle"], found["foreground"])
