"""Measures of decoded pixels (decoding itself is left to the source)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASURES = ("lap_var", "sharp_max", "sharp_top3", "sharp_median", "luma", "clip_dark", "clip_bright", "contrast", "colorfulness")
#: Tiles per side; levels from which a pixel counts as clipped.
TILES, DARK, BRIGHT = 6, 8, 247
HASH_SIDE, HASH_SAMPLE = 8, 32


def laplacian(gray: np.ndarray) -> np.ndarray:
    p = np.pad(gray, 1, mode="reflect")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray


def resized(gray: np.ndarray, side: int) -> np.ndarray:
    """Means of side x side areas."""
    for axis in (0, 1):
        edge = np.linspace(0, gray.shape[axis], side + 1)
        total = np.concatenate([np.zeros_like(np.take(gray, [0], axis)), np.cumsum(gray, axis)], axis)
        low = np.floor(edge).astype(int).clip(0, gray.shape[axis])
        high = np.minimum(low + 1, gray.shape[axis])
        part = np.expand_dims(edge - low, 1 - axis)
        at = np.take(total, low, axis) * (1 - part) + np.take(total, high, axis) * part
        gray = np.diff(at, axis=axis) / (gray.shape[axis] / side)
    return gray


def perceptual_hash(gray: np.ndarray) -> int:
    """64 bits: which low frequencies of the cosine transform exceed their median."""
    n = HASH_SAMPLE
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ resized(gray, n) @ basis.T)[:HASH_SIDE, :HASH_SIDE]
    bits = (low > np.median(low)).ravel()
    return int("".join("1" if b else "0" for b in bits), 2)


def measure(rgb: np.ndarray) -> dict:
    """All measures of an array (height, width, 3) of 0..255."""
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    gray = 0.299 * r + 0.587 * g + 0.114 * b
    lap = laplacian(gray)
    at = [np.arange(TILES + 1) * n // TILES for n in gray.shape]
    tiles = [lap[y0:y1, x0:x1] for y0, y1 in zip(at[0], at[0][1:]) for x0, x1 in zip(at[1], at[1][1:])]
    tiles = sorted((t.var() for t in tiles if t.size), reverse=True)
    rg, yb = r - g, (r + g) / 2 - b
    return {
        "lap_var": lap.var(), "sharp_max": tiles[0], "sharp_top3": float(np.mean(tiles[:3])), "sharp_median": float(np.median(tiles)),
        "luma": gray.mean(), "clip_dark": (gray < DARK).mean(), "clip_bright": (gray > BRIGHT).mean(), "contrast": gray.std(),
        "colorfulness": float(np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())), "phash": f"{perceptual_hash(gray):016x}",
    }


def image_measures(pixels: Column, width: Column, height: Column) -> Column:
    """struct of MEASURES and ``phash`` of raw RGB bytes, row by row from the top; null if the size doesn't fit."""

    @F.pandas_udf(T.StructType([*[T.StructField(m, T.DoubleType()) for m in MEASURES], T.StructField("phash", T.StringType())]))
    def run(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = []
        for raw, x, y in zip(p, w, h):
            fits = raw is not None and x == x and y == y and x and y and len(raw) == int(x) * int(y) * 3
            out.append(measure(np.frombuffer(bytes(raw), dtype=np.uint8).reshape(int(y), int(x), 3)) if fits else {})
        return pd.DataFrame({m: [x.get(m) for x in out] for m in MEASURES}, dtype=float).assign(phash=pd.Series([x.get("phash") for x in out], dtype=object))

    return run(pixels, width, height)


# What a two-letter orientation code asks for, and the codes of the eight EXIF orientations.
TURNS = {"AB": "none", "BC": "clockwise", "CD": "half_turn", "DA": "counterclockwise", "BA": "mirror", "DC": "flip", "AD": "transpose", "CB": "transverse"}
EXIF_CODES = {1: "AB", 2: "BA", 3: "CD", 4: "DC", 5: "AD", 6: "BC", 7: "CB", 8: "DA"}


def turn(code: Column) -> Column:
    """The turn that an orientation code asks for; unknown codes ask for none."""
    table = F.create_map(*[F.lit(x) for kv in TURNS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.lit("none"))


def exif_code(number: Column) -> Column:
    """The orientation code of an EXIF orientation, 1..8; else the upright one."""
    table = F.create_map(*[F.lit(x) for kv in EXIF_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, number.cast("int")), F.lit("AB"))
