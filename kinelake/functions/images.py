"""Images in array columns, by rows: resizing and colour changes as column expressions. Values lie in 0..1 for colour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let, total

#: fixed values: weights of red, green and blue in the grey value
GREY = (0.2989, 0.587, 0.114)


def resize_bilinear(pixels: Column, height: int, width: int, to_height: int, to_width: int) -> Column:
    """Bilinear resize without antialiasing: pixel centres are mapped, positions before the first centre are clamped,
    the last row and column repeat. NULL stays NULL."""

    def axis(k: Column, size: int, to: int) -> tuple[Column, Column, Column]:
        place = F.greatest((k + 0.5) * (size / to) - 0.5, F.lit(0.0))
        low = F.floor(place).cast("int")
        return low, F.least(low + 1, F.lit(size - 1)), place - low

    def value(k: Column) -> Column:
        top, bottom, v = axis(F.floor(k / to_width), height, to_height)
        left, right, u = axis(k % to_width, width, to_width)
        at = lambda y, x: F.get(pixels, y * width + x).cast("double")
        return (at(top, left) * (1 - u) + at(top, right) * u) * (1 - v) + (at(bottom, left) * (1 - u) + at(bottom, right) * u) * v

    return F.when(pixels.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(to_height * to_width - 1)), value))


def resize_nearest(pixels: Column, height: int, width: int, to_height: int, to_width: int) -> Column:
    """Resize that takes the pixel at the scaled place, rounded down; NULL stays NULL."""
    place = lambda k, size, to: F.floor(k * size / to)
    value = lambda k: F.get(pixels, (place(F.floor(k / to_width), height, to_height) * width + place(k % to_width, width, to_width)).cast("int")).cast("double")
    return F.when(pixels.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(to_height * to_width - 1)), value))


def crop(pixels: Column, width: int, top: Column, left: Column, to_height: int, to_width: int) -> Column:
    """A rectangle of the image."""
    row = lambda y: F.slice(pixels, ((top + y) * width + left + 1).cast("int"), to_width)
    return F.when(pixels.isNotNull(), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(to_height - 1)), row)))


def cropped_size(size: int, ratio: float) -> int:
    return max(1, int(size * ratio))


def crop_and_resize(pixels: Column, height: int, width: int, ratio: float, top: Column, left: Column, depth: bool = False) -> Column:
    """A rectangle of ``ratio`` of both sides, resized back: bilinear, or by the nearest pixel for depth, whose steps must
    not blend. All frames of a view, colour and depth, share one origin; a rectangle as large as the image changes nothing."""
    h, w = cropped_size(height, ratio), cropped_size(width, ratio)
    if (h, w) == (height, width):
        return pixels
    own = crop(pixels, width, top, left, h, w)
    return (resize_nearest if depth else resize_bilinear)(own, h, w, height, width)


def three_channels(pixels: Column, channels: Column) -> Column:
    """Interleaved pixels of three channels: one channel is repeated, of more than three the first three stay; any other
    number is an error."""
    starts = F.sequence(F.lit(0), F.floor(F.size(pixels) / channels).cast("int") - 1)
    taken = F.flatten(F.transform(starts, lambda k: F.slice(pixels, (k * channels + 1).cast("int"), 3)))
    repeated = F.flatten(F.transform(pixels, lambda v: F.array_repeat(v, 3)))
    return F.when(channels == 1, repeated).when(channels >= 3, taken).otherwise(F.raise_error(F.format_string("%d channels", channels)).cast("array<float>"))


def patches(pixels: Column, height: int, width: int, size: int) -> Column:
    """Pixels patch by patch, each by rows."""
    across = width // size
    at = lambda k: (F.floor(k / (size * size * across)) * size + F.floor(k % (size * size) / size)) * width + F.floor(k / (size * size)) % across * size + k % size
    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda k: F.get(pixels, at(k).cast("int")))


def unpatched(tokens: Column, height: int, width: int, size: int) -> Column:
    """The image whose patches these are."""
    across = width // size

    def at(k: Column) -> Column:
        y, x = F.floor(k / width), k % width
        return (F.floor(y / size) * across + F.floor(x / size)) * (size * size) + y % size * size + x % size

    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda k: F.get(tokens, at(k).cast("int")))


def side_by_side(views: list[Column], height: int, width: int) -> Column:
    """Views of one size as one image, row by row."""
    row = lambda y: F.concat(*(F.slice(v, (y * width + 1).cast("int"), width) for v in views))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), row))


def rgb(red: Column, green: Column, blue: Column) -> Column:
    """Three planes as one array of (r, g, b) pixels."""
    return F.arrays_zip(red.alias("r"), green.alias("g"), blue.alias("b"))


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _grey(p: Column) -> Column:
    return sum((p[c] * w for c, w in zip("gb", GREY[1:], strict=True)), p["r"] * GREY[0])


def _blend(p: Column, other: Column, factor: Column) -> Column:
    return F.struct(*(_clamp(p[c] * factor + other * (1 - factor)).alias(c) for c in "rgb"))


def brightness(image: Column, factor: Column) -> Column:
    return F.transform(image, lambda p: _blend(p, F.lit(0.0), factor))


def contrast(image: Column, factor: Column) -> Column:
    """Towards or away from the mean grey value of the image."""
    mean = total(F.transform(image, _grey)) / F.size(image)
    return let(mean, lambda m: F.transform(image, lambda p: _blend(p, m, factor)))


def saturation(image: Column, factor: Column) -> Column:
    """Towards or away from the grey value of each pixel."""
    return F.transform(image, lambda p: _blend(p, _grey(p), factor))


def hue(image: Column, turn: Column) -> Column:
    """Turns the colour circle by a part of 1. A channel of colour (h, s, v) at offset n is
    v - v s max(0, min(k, 4 - k, 1)) with k = (n + 6 h) mod 6 and n = 5, 3, 1 for red, green, blue."""

    def pixel(p: Column) -> Column:
        top, low = F.greatest(p["r"], p["g"], p["b"]), F.least(p["r"], p["g"], p["b"])
        gap = F.when(top == low, 1.0).otherwise(top - low)
        sector = F.when(top == low, 0.0).when(top == p["r"], (p["g"] - p["b"]) / gap).when(top == p["g"], 2 + (p["b"] - p["r"]) / gap).otherwise(4 + (p["r"] - p["g"]) / gap)
        turned = sector + 6 * turn

        def channel(n: int) -> Column:
            k = F.pmod(n + turned, F.lit(6.0))
            return top - (top - low) * _clamp(F.least(k, 4 - k))

        return F.struct(*(channel(n).alias(c) for c, n in zip("rgb", (5, 3, 1), strict=True)))

    return F.transform(image, pixel)


def jitter(image: Column, order: Column, factors: dict[str, Column]) -> Column:
    """Applies the four changes in the order of an array of their numbers (0 brightness, 1 contrast, 2 saturation,
    3 hue); a change without a factor is left out."""
    changes = [(n, f, factors[f.__name__]) for n, f in enumerate((brightness, contrast, saturation, hue)) if f.__name__ in factors]

    def change(now: Column, number: Column) -> Column:
        out = now
        for n, f, factor in changes:
            out = F.when(number == n, f(now, factor)).otherwise(out)
        return out

    same = F.transform(image, lambda p: F.struct(*(p[c].cast("double").alias(c) for c in "rgb")))
    return F.aggregate(order, same, change)
