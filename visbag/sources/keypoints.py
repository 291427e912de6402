"""Grey images and freely usable keypoints: what ``sources.envelope.extracted`` may take as its extractor.

``grey`` decodes binary PGM and PPM and plain PNG (8 bits, not interlaced); other formats are read by Spark's own
``format("image")``, see ``grey_images``. ``extract`` gives corners at three scales (local maxima of the smaller
eigenvalue of the gradient's second moments), each with the direction of its strongest gradients and 64 values: sums of
both derivatives, with and without sign, over 4 x 4 cells turned by it, of length 1.
"""

from __future__ import annotations

import math
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALES, NEAR, LEAST, HALF = (1.0, 2.0, 4.0), 4, 25.0, 10
WEIGHTS = (0.299, 0.587, 0.114)  # fixed values: red, green and blue in grey
_Y, _X = np.mgrid[-HALF:HALF, -HALF:HALF] + 0.5


def _pnm(data: bytes) -> np.ndarray:
    m = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not m or int(m[4]) > 255:
        raise ValueError("not a binary PGM or PPM of 8 bits")
    w, h, depth = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    return np.frombuffer(data, np.uint8, w * h * depth, m.end()).reshape(h, w, depth)


def _png(data: bytes) -> np.ndarray:
    at, packed = 8, []
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            w, h, bits, color, _, _, interlaced = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    depth = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if bits != 8 or interlaced or depth is None:
        raise ValueError("a PNG of another kind")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * depth)
    out = np.zeros((h, w, depth), np.uint8)
    above = np.zeros((w, depth), np.int64)
    for y in range(h):
        line = rows[y, 1:].reshape(w, depth).astype(np.int64)
        if rows[y, 0] == 1:
            line = np.cumsum(line, 0)
        elif rows[y, 0] == 2:
            line = line + above
        elif rows[y, 0] in (3, 4):
            left, corner = np.zeros(depth, np.int64), np.zeros(depth, np.int64)
            for x in range(w):
                up = above[x]
                guess = (left + up) // 2 if rows[y, 0] == 3 else left + up - corner
                if rows[y, 0] == 4:
                    a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (line[x] + guess) & 255, up
                line[x] = left
        above = line & 255
        out[y] = above
    return out[:, :, : depth - (depth in (2, 4))]


def grey(data: bytes) -> np.ndarray:
    """Rows of grey values; ValueError for what is no such image."""
    image = _png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else _pnm(data)
    return image[:, :, 0] if image.shape[2] == 1 else np.rint(image @ np.array(WEIGHTS)).astype(np.uint8)


def grey_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, height, width and values (rows in turn) of the images of a folder, decoded by Spark."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    weighed = "cast(round({} * {} + {} * {} + {} * {}) as int)"
    one = "cast(conv(hex(substring(data, cast(i as int) * nChannels + {k}, 1)), 16, 10) as double)"
    colors = [one.format(k=k) for k in (3, 2, 1)]
    many = weighed.format(*(x for pair in zip(WEIGHTS, colors) for x in pair))
    return rows.select("origin", "height", "width", F.expr(f"transform(sequence(0, height * width - 1), i -> case when nChannels = 1 then cast({one.format(k=1)} as int) else {many} end)").alias("values"))


def _mean(a: np.ndarray, r: int) -> np.ndarray:
    p = np.cumsum(np.cumsum(np.pad(a, ((r + 1, r), (r + 1, r)), mode="edge"), 0), 1)
    k = 2 * r + 1
    return (p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]) / (k * k)


def described(image: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """(x, y, size, angle, response, octave) of each keypoint, and its 64 values."""
    points, values = [], []
    for octave, scale in enumerate(SCALES):
        step = int(scale)
        a = _mean(image.astype(np.float64), step)[::step, ::step]
        if min(a.shape) < 2 * HALF + 4:
            continue
        gy, gx = np.gradient(a)
        xx, yy, xy = _mean(gx * gx, 2), _mean(gy * gy, 2), _mean(gx * gy, 2)
        force = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy**2)
        m = 2 * HALF
        inner = force[m:-m, m:-m] if min(force.shape) > 2 * m else np.zeros((0, 0))
        for y, x in zip(*np.nonzero(inner > LEAST)):
            y, x = y + m, x + m
            if force[y, x] < force[y - NEAR : y + NEAR + 1, x - NEAR : x + NEAR + 1].max():
                continue
            part = slice(y - HALF, y + HALF), slice(x - HALF, x + HALF)
            angle = math.atan2(gy[part].sum(), gx[part].sum())
            c, s = math.cos(angle), math.sin(angle)
            at_x = np.clip(np.rint(x + c * _X - s * _Y).astype(int), 0, a.shape[1] - 1)
            at_y = np.clip(np.rint(y + s * _X + c * _Y).astype(int), 0, a.shape[0] - 1)
            dx, dy = c * gx[at_y, at_x] + s * gy[at_y, at_x], -s * gx[at_y, at_x] + c * gy[at_y, at_x]
            cells = np.stack([dx, dy, abs(dx), abs(dy)]).reshape(4, 4, HALF // 2, 4, HALF // 2).sum((2, 4)).reshape(-1)
            points.append((float(x * step), float(y * step), 2.0 * HALF * step, math.degrees(angle) % 360, float(force[y, x]), float(octave)))
            values.append(cells / max(np.linalg.norm(cells), 1e-12))
    return points, np.array(values, np.float32).reshape(-1, 64)


def extract(data: bytes) -> tuple[list[tuple], np.ndarray]:
    """The keypoints of an encoded image."""
    return described(grey(data))
