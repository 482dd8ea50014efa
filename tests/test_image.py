"""Effects on raw pixels against plain restatements and planted pages."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivana.functions import image


def page(height=40, width=30, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3)).astype(np.uint8)


def rng():
    return np.random.default_rng(7)


def test_box_blur_is_the_mean_of_the_square():
    plane = page()[:, :, 0]
    got = image.box_blur(plane, 2)
    for y, x in ((0, 0), (5, 7), (39, 29), (20, 0)):
        square = [int(plane[min(max(y + dy, 0), 39), min(max(x + dx, 0), 29)]) for dy in range(-2, 3) for dx in range(-2, 3)]
        assert got[y, x] == math.floor(sum(square) / 25 + 0.5)


@pytest.mark.parametrize("sigma", [0.6, 1.0, 2.3, 4.0, 7.5])
def test_blur_has_the_variance_it_says(sigma):
    weights = image.kernel(sigma)
    at = np.arange(len(weights)) - len(weights) // 2
    assert weights.sum() == 65536 and (weights == weights[::-1]).all()
    assert abs((weights * at**2).sum() / 65536 - sigma**2) < 0.02 * sigma**2 + 0.01
    flat = np.full((20, 20), 200, dtype=np.uint8)
    assert (image.blur(flat, sigma) == 200).all()


def test_angles():
    for degrees in (*range(-720, 721, 15), 0.37, 44.9, 45.1, 359.5):
        assert np.allclose(image.cos_sin(degrees), (math.cos(math.radians(degrees)), math.sin(math.radians(degrees))), atol=1e-12)
    assert image.across(3, 5, 180)[0, 0] == 1 and image.across(3, 5, 90)[2, 0] == 1 and image.across(3, 5, 0)[1, 4] == 1


def test_near_normal():
    x = image.near_normal(rng(), (200_000,), 2.0)
    assert abs(x.mean()) < 0.02 and abs(x.std() - 2) < 0.02 and abs(x).max() <= 6 / 2 * 2 * math.sqrt(2)


def test_ink_and_paper():
    white = np.full((60, 50, 3), 255, dtype=np.uint8)
    dot = white.copy()
    dot[30, 20] = 0
    bled = image.ink_bleed((1.0, 1.0), 2)(dot, rng())[:, :, 0]
    dark = {(y - 30, x - 20) for y, x in zip(*np.nonzero(bled == 0))}
    assert dark == {(a, b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4}
    assert (image.ink_bleed((0.5, 0.5), 1)(dot, rng())[29, 20] == 128).all()
    faded = image.thermal_fade((0.5, 0.5))(np.zeros((60, 50, 3), np.uint8), rng())
    assert (faded == faded[:, :1]).all() and 0 < faded.max() <= 128 and len(np.unique(faded)) > 5
    assert (image.thermal_fade((0.5, 0.5))(white, rng()) == 255).all()
    lit = image.lighting(255, 0, 0.2)(white, rng())
    assert (lit[:, 0] == 255).all() and (lit[:, -1] == 204).all()
    shade = image.shadow((0.4, 0.4))(white, rng())
    assert shade.max() == 255 and shade.min() == 153


def test_marks():
    grey = np.full((200, 80, 3), 128, dtype=np.uint8)
    folded = image.folds((2, 2), (0.2, 0.2))(grey, rng())
    assert (folded == folded[:, :1]).all() and 46 <= int(folded.max()) - 128 <= 52 and 46 <= 128 - int(folded.min()) <= 52
    streaked = image.roller_streaks((3, 3), (0.2, 0.2))(grey, rng())
    assert (streaked == streaked[:1]).all() and (streaked != 128).any() and (streaked[0, :, 0] == 128).mean() > 0.5
    with_, without = (np.random.default_rng(5) for _ in "ab")
    assert (image.folds((1, 3), (0.1, 0.3), 1.0)(grey, with_) != grey).any()
    assert (image.folds((1, 3), (0.1, 0.3), 0.0)(grey, without) == grey).all()
    assert with_.random() == without.random()  # the mark drew the same numbers either way


def test_placement():
    plain = page()
    assert (image.skew(0.0)(plain, rng()) == plain).all() and (image.warp(0.0)(plain, rng()) == plain).all()
    black = np.zeros((41, 41, 3), np.uint8)
    turned = image.skew(5.0)(black, rng())
    assert (turned[10:31, 10:31] == 0).all() and turned.max() > 100
    y, x = np.mgrid[:4, :6] + 0.0
    assert (image.sampled(plain[:4, :6], x, y) == plain[:4, :6]).all()
    half = image.sampled(plain[:4, :6], x[:, :5] + 0.5, y[:, :5])
    assert (half == image.to_bytes((plain[:4, :5].astype(float) + plain[:4, 1:6]) / 2)).all()
    small = image.warp(0.2)(black, rng())
    assert small[20, 20].max() == 0 and small[0, 0].min() > 0


def test_photometrics():
    plain = page()
    assert (image.brightness(0.5)(plain, rng()) == np.floor(plain * 0.5 + 0.5)).all()
    assert image.contrast(0.0)(plain, rng()).std() == 0 and (image.contrast(1.0)(plain, rng()) == plain).all()
    noisy = image.noise(5.0)(np.full((200, 200, 3), 128, np.uint8), rng())
    assert abs(noisy.mean() - 128) < 0.2 and abs(noisy.std() - 5) < 0.2
    assert (image.soften(1.0)(plain, rng()) == image.blur(plain, 1.0)).all()


def test_jpeg_round_trip():
    y, x = np.mgrid[:37, :51]
    smooth = np.stack([2 * x + y, 255 - 3 * x, 100 + y], axis=-1).astype(np.uint8)
    errors = [np.abs(image.jpeg_round_trip(q)(smooth, rng()).astype(int) - smooth).mean() for q in (100, 95, 50, 10)]
    assert errors[0] < 1 and errors == sorted(errors) and errors[-1] > 1.5
    grey = np.full((16, 16, 3), 77, np.uint8)
    assert np.abs(image.jpeg_round_trip(95)(grey, rng()).astype(int) - 77).max() <= 1


def test_treatments_keep_their_order(spark):
    def note(name):
        return image.Step(name, lambda p, r: p)

    all_ = image.Treatment(photometrics=(note("noise"),), placement=(note("skew"),), marks=(note("folds"),), effects=(note("bleed"), image.Step("thermal", lambda p, r: p, doc_types=frozenset({"receipts"})), image.Step("one", lambda p, r: p, stems=frozenset({"A"}))))
    assert [s for _, s, _ in all_.states(page(), 1, "A", "receipts")] == ["bleed", "thermal", "one", "folds", "skew", "noise"]
    assert [s for _, s, _ in all_.states(page(), 1, "B", "invoices")] == ["bleed", "folds", "skew", "noise"]
    with pytest.raises(ValueError, match="either"):
        image.Treatment(placement=(note("skew"), note("warp")))


def test_pages_in_spark(spark):
    treatment = image.Treatment(
        effects=(image.Step("bleed", image.ink_bleed((0.1, 0.5), 2)), image.Step("fade", image.thermal_fade((0.2, 0.4)), doc_types=frozenset({"receipts"}))),
        marks=(image.Step("folds", image.folds((1, 2), (0.1, 0.2), 0.5)),), placement=(image.Step("skew", image.skew(2.0)),), photometrics=(image.Step("jpeg", image.jpeg_round_trip(80)),),
    )
    rows = [(f"s{i}", bytearray(page(24, 16, i).tobytes()), 24, 16, 100 + i, "receipts" if i % 2 else "invoices") for i in range(4)] + [("none", None, 1, 1, 1, "receipts")]
    df = spark.createDataFrame(rows, "stem string, p binary, h int, w int, s long, t string")
    args = (F.col("p"), F.col("h"), F.col("w"), F.col("s"), treatment, F.col("stem"), F.col("t"))
    got = {r.stem: r for r in df.select("stem", image.degrade(*args).alias("page"), image.digests(*args).alias("digests"), image.pixel_sha256(F.col("p"), F.col("h"), F.col("w")).alias("plain")).collect()}
    assert got["none"].page is None and got["none"].digests is None and got["none"].plain is None
    for i in range(4):
        states = list(treatment.states(page(24, 16, i), 100 + i, f"s{i}", "receipts" if i % 2 else "invoices"))
        r = got[f"s{i}"]
        assert bytes(r.page) == states[-1][2].tobytes() and len(r.digests) == 4 + i % 2
        assert [(d.phase, d.step) for d in r.digests] == [s[:2] for s in states]
        assert r.digests[-1].sha256 == hashlib.sha256(b"RGB16x24" + bytes(r.page)).hexdigest()
        assert r.plain == hashlib.sha256(b"RGB16x24" + page(24, 16, i).tobytes()).hexdigest()
