"""Degradation of page images held as raw RGB bytes, with numpy alone: no decoder is assumed.

An effect is a function of a page (height x width x 3 bytes) and a random generator. A ``Treatment`` lists effects by
phase and runs the phases in one order, whatever order it was written in: effects on ink and paper, marks, placement
(skew or warp), photometrics. The generator starts from the page's own seed, and integer or double arithmetic in a
fixed order makes the pixels, so any executor gives the same page. Rows whose bytes are null stay null; a page whose
bytes don't fill its height and width fails its task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

Effect = Callable[[np.ndarray, np.random.Generator], np.ndarray]


def to_bytes(page: np.ndarray) -> np.ndarray:
    """The nearest bytes, halves up."""
    return np.floor(np.clip(page, 0, 255) + 0.5).astype(np.uint8)


# random numbers and angles

#: Fixed value: how many uniform numbers a near-normal one is the sum of.
UNIFORMS = 6


def near_normal(rng: np.random.Generator, shape: tuple[int, ...], sigma: float) -> np.ndarray:
    """Sums of uniforms, shifted and scaled to mean 0 and deviation ``sigma``: additions alone, the same on any machine."""
    return (rng.random((UNIFORMS, *shape)).sum(axis=0) - UNIFORMS / 2) * (sigma * math.sqrt(12 / UNIFORMS))


def cos_sin(degrees: float) -> tuple[float, float]:
    """From power series at the angle's distance from the nearest quarter turn, so no mathematics library has a say."""
    quarter = round(degrees / 90)
    x = (degrees - 90 * quarter) * (math.pi / 180)
    cos = sin = 0.0
    for k in range(16, -1, -2):  # from the smallest terms on
        cos += (-1) ** (k // 2) * x**k / math.factorial(k)
        sin += (-1) ** (k // 2) * x ** (k + 1) / math.factorial(k + 1)
    return ((cos, sin), (-sin, cos), (-cos, -sin), (sin, -cos))[quarter % 4]


# blurs

def box_blur(plane: np.ndarray, radius: int) -> np.ndarray:
    """The exact mean of the square of 2 * radius + 1 pixels around each, edges repeated, halves up; from one summed table."""
    side = 2 * radius + 1
    padding = [(radius + 1, radius)] * 2 + [(0, 0)] * (plane.ndim - 2)
    table = np.pad(plane.astype(np.int64), padding, mode="edge").cumsum(axis=0).cumsum(axis=1)
    sums = table[side:, side:] - table[:-side, side:] - table[side:, :-side] + table[:-side, :-side]
    return ((2 * sums + side * side) // (2 * side * side)).astype(plane.dtype)


@lru_cache(64)
def kernel(sigma: float) -> np.ndarray:
    """Whole weights, 2**16 together, of a bell whose variance is sigma**2 as nearly as such weights allow.

    A sampled bell curve that is cut off has another variance than its formula says, so its width is searched (once a width).
    """
    reach = max(1, math.ceil(4 * sigma))
    at = np.arange(-reach, reach + 1)

    def bell(width: float) -> np.ndarray:
        w = np.exp(-(at**2) / (2 * width * width))
        return w / w.sum()

    low, high = 0.01, 4 * sigma + 1
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if (bell(middle) * at**2).sum() < sigma * sigma else (low, middle)
    weights = np.round(bell(low) * 65536).astype(np.int64)
    weights[reach] += 65536 - weights.sum()
    weights.flags.writeable = False
    return weights


@lru_cache(64)
def edge_weights(n: int, sigma: float) -> np.ndarray:
    """The kernel as a table: what each of n places takes of each, edges repeated. For sides no longer than some kernels."""
    weights = kernel(sigma)
    reach, table = len(weights) // 2, np.zeros((n, n))
    for k, w in enumerate(weights.tolist()):
        at = np.arange(n)
        table[at, np.clip(at + k - reach, 0, n - 1)] += w
    table.flags.writeable = False
    return table


def blur(plane: np.ndarray, sigma: float) -> np.ndarray:
    """A blur of variance sigma**2 in both directions, edges repeated, in whole numbers."""
    if sigma <= 0:
        return plane.copy()
    weights, out = kernel(sigma), plane.astype(np.int64)
    reach = len(weights) // 2
    for axis in (0, 1):
        if out.shape[axis] <= 2 * len(weights):  # doubles hold all these whole numbers, and so their sums, exactly
            sums = edge_weights(out.shape[axis], sigma) @ (out.reshape(len(out), -1) if axis == 0 else out.reshape(*out.shape[:2], -1)).astype(np.float64)
            out = (sums.reshape(out.shape).astype(np.int64) + 32768) >> 16
            continue
        padding = [(0, 0)] * out.ndim
        padding[axis] = (reach, reach)
        wide, n = np.pad(out, padding, mode="edge"), out.shape[axis]
        out = sum(w * wide.take(range(k, k + n), axis=axis) for k, w in enumerate(weights.tolist()) if w)
        out = (out + 32768) >> 16
    return out.astype(np.uint8)


# effects on ink and paper

@lru_cache(4)
def grid(height: int, width: int) -> np.ndarray:
    """The rows and columns of a page's pixels, from its middle."""
    places = np.mgrid[:height, :width] - np.array([(height - 1) / 2, (width - 1) / 2])[:, None, None]
    places.flags.writeable = False
    return places


def across(height: int, width: int, degrees: float) -> np.ndarray:
    """0 to 1 over the page in the direction of an angle, clockwise from the right."""
    dx, dy = cos_sin(degrees)
    along = np.add.outer(np.arange(height) * dy, np.arange(width) * dx)
    along -= along.min()
    return along / max(along.max(), 1e-12)


@lru_cache(4)
def light(brightness: int, degrees: float, falloff: float, height: int, width: int) -> np.ndarray:
    factors = (brightness / 255 * (1 - falloff * across(height, width, degrees)))[..., None]
    factors.flags.writeable = False
    return factors


def lighting(brightness: int, degrees: float, falloff: float = 0.22) -> Effect:
    """Light that comes from one side: ``brightness`` of 255 there, less by ``falloff`` at the far side."""

    def apply(page: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return to_bytes(page * light(brightness, degrees, falloff, *page.shape[:2]))

    return apply


def shadow(strength: tuple[float, float], softness: float = 0.15) -> Effect:
    """A shadow from a random side, its edge at a random place, its rim ``softness`` of the page wide."""

    def apply(page: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        side, edge, depth = 360 * rng.random(), 0.2 + 0.6 * rng.random(), rng.uniform(*strength)
        inside = np.clip((across(*page.shape[:2], side) - edge) / softness, 0, 1)
        return to_bytes(page * (1 - depth * inside * inside * (3 - 2 * inside))[..., None])

    return apply


def ink_bleed(amount: tuple[float, float], radius: float) -> Effect:
    """Ink that spreads into the paper around it: part of the way to the darkest pixel of a disc around each."""

    def apply(page: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        share, reach = rng.uniform(*amount), int(radius)
        wide, darkest = np.pad(page, [(reach, reach), (reach, reach), (0, 0)], constant_values=255), page
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                if dx * dx + dy * dy <= radius * radius:
                    darkest = np.minimum(darkest, wide[reach + dy : reach + dy + page.shape[0], reach + dx : reach + dx + page.shape[1]])
        return to_bytes(page - share * (page.astype(np.float64) - darkest))

    return apply


def thermal_fade(strength: tuple[float, float], bands: float = 0.05) -> Effect:
    """Print that has faded in bands across the roll: ink goes towards the paper's white, row by row."""

    def apply(page: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        depth, height = rng.uniform(*strength), len(page)
        grain = np.repeat(rng.random(2 + int(1 / bands)), max(1, math.ceil(height * bands)))[:height]
        rows = blur(to_bytes(255 * np.tile(grain[:, None], (1, 3))), max(0.5, height * bands / 2))[:, 0] / 255
        return to_bytes(255 - (255.0 - page) * (1 - depth * rows)[:, None, None])

    return apply


# marks on the paper

@dataclass(frozen=True)
class Mark:
    """A mark that some pages have. Its coin falls first and its parameters are drawn either way, so what comes after
    draws the same numbers on pages with and without it."""

    draw: Callable[[tuple[int, int], np.random.Generator], np.ndarray]
    prevalence: float = 1.0

    def __call__(self, page: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        there = rng.random() < self.prevalence
        change = self.draw(page.shape[:2], rng)
        return to_bytes(page + change[..., None]) if there else page


def folds(count: tuple[int, int], strength: tuple[float, float], prevalence: float = 1.0) -> Mark:
    """Creases across the page at even distances, give or take: one flank catches light, the other lies in shade."""

    def draw(shape: tuple[int, int], rng: np.random.Generator) -> np.ndarray:
        height, n = shape[0], int(rng.integers(count[0], count[1], endpoint=True))
        places = height * np.arange(1, n + 1) / (n + 1) + near_normal(rng, (n,), height * 0.02)
        depths, flank, rows = rng.uniform(*strength, size=n), max(1.5, height * 0.006), np.arange(height)
        away = (rows[:, None] - places[None, :]) / flank
        relief = -(away * np.exp((1 - away**2) / 2) * depths).sum(axis=1)  # each flank's extreme is its depth
        return np.tile(255 * relief[:, None], (1, shape[1]))

    return Mark(draw, prevalence)


def roller_streaks(count: tuple[int, int], strength: tuple[float, float], prevalence: float = 1.0) -> Mark:
    """Thin lines down the whole page, darker or lighter, where a roller was dirty or worn."""

    def draw(shape: tuple[int, int], rng: np.random.Generator) -> np.ndarray:
        width, n = shape[1], int(rng.integers(count[0], count[1], endpoint=True))
        at, depth = width * rng.random(n), rng.uniform(*strength, size=n) * np.where(rng.random(n) < 0.7, -1, 1)
        thin = 0.5 + 1.5 * rng.random(n)
        line = np.clip(1.5 - np.abs(np.arange(width)[:, None] - at) / thin, 0, 1)
        return np.tile(255 * (line * depth).sum(axis=1), (shape[0], 1))

    return Mark(draw, prevalence)


# placement: the page on the platen or before the camera

def sampled(page: np.ndarray, x: np.ndarray, y: np.ndarray, paper: int = 255) -> np.ndarray:
    """The page at fractional places, between its four neighbours; ``paper`` outside."""
    height, width = page.shape[:2]
    wide = np.full((height + 2, width + 2, *page.shape[2:]), paper, dtype=np.float64)
    wide[1:-1, 1:-1] = page
    x, y = np.clip(x, -1, width) + 1, np.clip(y, -1, height) + 1
    left, top = np.minimum(x.astype(int), width), np.minimum(y.astype(int), height)
    fx, fy = (x - left)[..., None], (y - top)[..., None]
    upper = wide[top, left] * (1 - fx) + wide[top, left + 1] * fx
    lower = wide[top + 1, left] * (1 - fx) + wide[top + 1, left + 1] * fx
    return to_bytes(upper * (1 - fy) + lower * fy)


def skew(most_degrees: float) -> Effect:
    """The page turned about its middle by a near-normal angle of at most ``most_degrees``."""

    def apply(page: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        turn = float(np.clip(near_normal(rng, (), most_degrees / 2), -most_degrees, most_degrees))
        cos, sin = cos_sin(turn)
        cy, cx = (page.shape[0] - 1) / 2, (page.shape[1] - 1) / 2
        y, x = grid(*page.shape[:2])
        return sampled(page, cos * x + sin * y + cx, cos * y - sin * x + cy)

    return apply


def warp(most: float) -> Effect:
    """The page seen aslant: each corner moved inwards by up to ``most`` of the page, straight lines kept straight."""

    def apply(page: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        height, width = page.shape[:2]
        corners = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], dtype=float)
        seen = corners + np.where(corners == 0, 1, -1) * rng.random((4, 2)) * most
        # the projection from seen places to page places, from its four corners
        rows = []
        for (u, v), (x, y) in zip(seen, corners):
            rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        a, b, c, d, e, f, g, h = np.linalg.solve(np.array(rows), corners.ravel())
        v, u = np.mgrid[:height, :width] / np.array([max(height - 1, 1), max(width - 1, 1)])[:, None, None]
        depth = g * u + h * v + 1
        return sampled(page, (a * u + b * v + c) / depth * (width - 1), (d * u + e * v + f) / depth * (height - 1))

    return apply


# photometrics

def brightness(factor: float) -> Effect:
    return lambda page, rng: to_bytes(page * factor)


def contrast(factor: float) -> Effect:
    """Away from, or towards, the page's mean grey."""
    return lambda page, rng: to_bytes(page.mean() + (page - page.mean()) * factor)


def soften(sigma: float) -> Effect:
    return lambda page, rng: blur(page, sigma)


def noise(sigma: float) -> Effect:
    return lambda page, rng: to_bytes(page + near_normal(rng, page.shape, sigma))


#: Fixed values of the JPEG standard (its example tables): steps of the 64 waves of brightness, and of colour.
JPEG_LUMA = (
    (16, 11, 10, 16, 24, 40, 51, 61), (12, 12, 14, 19, 26, 58, 60, 55), (14, 13, 16, 24, 40, 57, 69, 56), (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77), (24, 35, 55, 64, 81, 104, 113, 92), (49, 64, 78, 87, 103, 121, 120, 101), (72, 92, 95, 98, 112, 100, 103, 99),
)
JPEG_CHROMA = (
    (17, 18, 24, 47, 99, 99, 99, 99), (18, 21, 26, 66, 99, 99, 99, 99), (24, 26, 56, 99, 99, 99, 99, 99), (47, 66, 99, 99, 99, 99, 99, 99),
    (99,) * 8, (99,) * 8, (99,) * 8, (99,) * 8,
)
#: Fixed values of JPEG files: red, green and blue to brightness and two colour differences.
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def jpeg_round_trip(quality: int) -> Effect:
    """What a JPEG file of full colour resolution keeps: waves of 8 x 8 blocks rounded to the quality's steps. The coding of the rounded numbers loses nothing and is left out."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    steps = [np.clip(np.floor((np.array(t) * scale + 50) / 100), 1, 255) for t in (JPEG_LUMA, JPEG_CHROMA, JPEG_CHROMA)]
    k = np.arange(8)
    waves = np.cos((2 * k[None, :] + 1) * k[:, None] * math.pi / 16) * np.where(k == 0, math.sqrt(1 / 8), 0.5)[:, None]

    def apply(page: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        height, width = page.shape[:2]
        whole = np.pad(page, [(0, -height % 8), (0, -width % 8), (0, 0)], mode="edge") @ TO_YCC.T
        whole[..., 0] -= 128
        planes = []
        for plane, step in zip(np.moveaxis(whole, -1, 0), steps):
            tiles = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
            kept = np.round(waves @ tiles @ waves.T / step) * step
            planes.append((waves.T @ kept @ waves).swapaxes(1, 2).reshape(plane.shape))
        planes[0] += 128
        return to_bytes(np.stack(planes, axis=-1) @ np.linalg.inv(TO_YCC).T)[:height, :width]

    return apply


# treatments

PHASES = ("effects", "marks", "placement", "photometrics")


@dataclass(frozen=True)
class Step:
    """An effect with its name; where given, only for some document types or stems."""

    name: str
    effect: Effect
    doc_types: frozenset[str] | None = None
    stems: frozenset[str] | None = None

    def wanted(self, stem: str | None, doc_type: str | None) -> bool:
        return (self.doc_types is None or doc_type in self.doc_types) and (self.stems is None or stem in self.stems)


@dataclass(frozen=True)
class Treatment:
    """What is done to a page, by phase; at most one step places it."""

    effects: tuple[Step, ...] = ()
    marks: tuple[Step, ...] = ()
    placement: tuple[Step, ...] = ()
    photometrics: tuple[Step, ...] = ()

    def __post_init__(self):
        if len(self.placement) > 1:
            raise ValueError("a page is either skewed or warped")

    def states(self, page: np.ndarray, seed: int, stem: str | None = None, doc_type: str | None = None):
        """(phase, step, page) after each wanted step, in the order of the phases."""
        rng = np.random.default_rng(seed)
        for phase in PHASES:
            for step in getattr(self, phase):
                if step.wanted(stem, doc_type):
                    page = step.effect(page, rng)
                    yield phase, step.name, page


def pixels(raw: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(height, width, 3)


def pixel_text(width: int, height: int) -> bytes:
    """Fixed format: what stands before the pixels in their hash."""
    return f"RGB{width}x{height}".encode()


def pixel_sha256(page: Column, height: Column, width: Column) -> Column:
    """Identity of the image: SHA-256 of mode and size, then the pixels, in hex."""
    size = F.concat(F.lit("RGB"), width.cast("string"), F.lit("x"), height.cast("string"))
    return F.sha2(F.concat(F.encode(size, "UTF-8"), page), 256)


def degrade(page: Column, height: Column, width: Column, seed: Column, treatment: Treatment, stem: Column | None = None, doc_type: Column | None = None) -> Column:
    """Raw RGB bytes through a treatment."""

    @arrow_udf(BinaryType())
    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for raw, h, w, s, name, kind in _rows(columns):
            last = None if raw is None else pixels(raw, h, w)
            for _, _, last in treatment.states(last, s, name, kind) if raw is not None else ():
                pass
            out.append(None if last is None else last.tobytes())
        return pa.array(out, pa.binary())

    return run(page, height, width, seed, _or_null(stem), _or_null(doc_type))


def digests(page: Column, height: Column, width: Column, seed: Column, treatment: Treatment, stem: Column | None = None, doc_type: Column | None = None) -> Column:
    """(phase, step, sha256 of the pixels) after each step: where two runs part, the first difference shows."""
    kind = ArrayType(StructType([StructField(name, StringType()) for name in ("phase", "step", "sha256")]))

    @arrow_udf(kind)
    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for raw, h, w, s, name, doc in _rows(columns):
            states = () if raw is None else treatment.states(pixels(raw, h, w), s, name, doc)
            out.append(None if raw is None else [{"phase": a, "step": b, "sha256": hashlib.sha256(pixel_text(w, h) + p.tobytes()).hexdigest()} for a, b, p in states])
        return pa.array(out, pa.list_(pa.struct([(x, pa.string()) for x in ("phase", "step", "sha256")])))

    return run(page, height, width, seed, _or_null(stem), _or_null(doc_type))


def _or_null(column: Column | None) -> Column:
    return F.lit(None).cast("string") if column is None else column


def _rows(columns: tuple[pa.Array, ...]):
    """Row by row, so that one page at a time stands in memory as bytes."""
    return (tuple(x.as_py() for x in row) for row in zip(*columns))
