"""Image operators in numpy: colours by k-means in LAB, decolouring, perspective, contrast, denoising, resizing, and PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def rgb_to_lab(rgb: np.ndarray) -> np.ndarray:
    c = np.asarray(rgb, float) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = c @ _TO_XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def lab_to_rgb(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], axis=-1)
    xyz = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) * _WHITE
    c = np.clip(xyz @ np.linalg.inv(_TO_XYZ).T, 0, 1)
    c = np.where(c > 0.0031308, 1.055 * c ** (1 / 2.4) - 0.055, 12.92 * c)
    return np.rint(np.clip(c, 0, 1) * 255).astype(int)


def k_means(points: np.ndarray, k: int, rounds: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels; k-means++ starts from a fixed seed."""
    rng = np.random.default_rng(seed)
    centres = [points[rng.integers(len(points))]]
    while len(centres) < k:
        far = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0)
        if far.sum() == 0:
            break
        centres.append(points[rng.choice(len(points), p=far / far.sum())])
    c = np.array(centres)
    for _ in range(rounds):
        label = ((points[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([points[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c, ((points[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)


def hex_color(rgb) -> str:
    return "#{:02x}{:02x}{:02x}".format(*(int(x) for x in rgb))


def dominant_color(pixels: np.ndarray) -> str:
    """Of RGB pixels: the centre of the largest of three clusters in LAB."""
    lab = rgb_to_lab(pixels.reshape(-1, 3))
    centres, label = k_means(lab, min(3, len(lab)), 5)
    return hex_color(lab_to_rgb(centres[np.bincount(label).argmax()]))


def color_grid(image: np.ndarray, cells: int = 10, least: int = 10) -> list[list[str]]:
    """Dominant colours of about cells x cells tiles of at least `least` pixels."""
    h, w = image.shape[:2]
    dy, dx = max(h // cells, least), max(w // cells, least)
    return [[dominant_color(image[y : y + dy, x : x + dx]) for x in range(0, w, dx)] for y in range(0, h, dy)]


def cell_colors(image: np.ndarray, boxes: list[list[tuple[int, int, int, int]]]) -> list[list[str]]:
    """The same at a table's own cell boxes (x0, y0, x1, y1)."""
    return [[dominant_color(image[y0:y1, x0:x1]) for x0, y0, x1, y1 in row] for row in boxes]


def main_colors(image: np.ndarray, k: int = 8) -> list[tuple[str, float]]:
    """Colours and shares of k clusters in LAB, most common first."""
    centres, label = k_means(rgb_to_lab(image.reshape(-1, 3)), k, 10)
    share = np.bincount(label, minlength=len(centres)) / label.size
    return [(hex_color(lab_to_rgb(centres[j])), float(share[j])) for j in np.argsort(-share, kind="stable")]


def to_gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.rint(image @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def binarized(image: np.ndarray, block: int = 31, c: int = 15) -> np.ndarray:
    """White where a pixel is over its neighbourhood's Gaussian mean less c, else black; gray or colour in."""
    g = to_gray(image).astype(float)
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    x = np.arange(block) - block // 2
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    padded = np.pad(g, block // 2, mode="edge")
    rows = sum(k * padded[:, i : i + g.shape[1]] for i, k in enumerate(kernel))
    mean = sum(k * rows[i : i + g.shape[0]] for i, k in enumerate(kernel))
    return np.where(g > np.rint(mean) - c, 255, 0).astype(np.uint8)


def ruled(image: np.ndarray, row_lines: list[int], column_lines: list[int]) -> np.ndarray:
    out = image.copy()
    h, w = out.shape[:2]
    out[[y for y in row_lines if 0 < y < h]] = 0
    out[:, [x for x in column_lines if 0 < x < w]] = 0
    return out


def ordered_corners(points: np.ndarray) -> np.ndarray:
    """Four points as top-left, top-right, bottom-right, bottom-left."""
    by_y = points[np.argsort(points[:, 1], kind="stable")]
    upper, lower = (p[np.argsort(p[:, 0], kind="stable")] for p in (by_y[:2], by_y[2:]))
    return np.array([upper[0], upper[1], lower[1], lower[0]])


def upscaled(image: np.ndarray, factor: int = 2) -> np.ndarray:
    """Cubic interpolation (a = -0.75), edge pixels repeated."""
    out = image.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        at = (np.arange(n * factor) + 0.5) / factor - 0.5
        base = np.floor(at).astype(int)
        total = 0.0
        for k in (-1, 0, 1, 2):
            d = np.abs(at - base - k)
            weight = np.where(d <= 1, 1.25 * d**3 - 2.25 * d**2 + 1, -0.75 * d**3 + 3.75 * d**2 - 6 * d + 3)
            shape = [1] * out.ndim
            shape[axis] = -1
            total = total + np.take(out, np.clip(base + k, 0, n - 1), axis) * weight.reshape(shape)
        out = total
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def gridded(image: np.ndarray, blocks: list[dict], offset: tuple[int, int]) -> np.ndarray:
    """A decoloured crop with lines midway between the runs of its blocks' centres; offset is the crop's corner on the page."""
    from pagemill.operators.backends import blocks_box

    box = blocks_box(blocks) - np.array([*offset, *offset])
    if not len(box):
        return binarized(image)
    high = np.sort(box[:, 3] - box[:, 1])[len(box) // 2]
    return ruled(binarized(image), between_runs((box[:, 1] + box[:, 3]) / 2, max(0.8 * high, 8)), between_runs((box[:, 0] + box[:, 2]) / 2, max(1.2 * high, 12)))


def between_runs(values: np.ndarray, gap: float) -> list[int]:
    """Whole midpoints between runs of values whose steps are at most gap."""
    v = np.sort(values)
    at = np.nonzero(np.diff(v) > gap)[0]
    return ((v[at] + v[at + 1]) / 2).astype(int).tolist()


# Perspective.


def _pieces(mask: np.ndarray) -> list[np.ndarray]:
    """Rows and columns of the connected pieces (8 neighbours) of a mask, by runs of each line joined to those of the line above."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    line, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    label = np.arange(line.size)

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    first = np.searchsorted(line, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] <= end[j] and start[j] <= end[i]:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(k) for k in range(line.size)], int)
    out = []
    for r in np.unique(roots):
        k = np.nonzero(roots == r)[0]
        out.append(np.concatenate([np.stack([np.concatenate([start[k], end[k] - 1]), np.concatenate([line[k], line[k]])], axis=1)]))
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    pts = np.unique(points, axis=0).tolist()
    if len(pts) < 3:
        return np.array(pts, float)

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def area(polygon: np.ndarray) -> float:
    x, y = polygon[:, 0], polygon[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def four_corners(polygon: np.ndarray, slack: float = 0.02) -> np.ndarray | None:
    """The hull's four corners where it is a quadrilateral: every other point within slack times the perimeter of its sides; else None."""
    if len(polygon) < 4:
        return None
    kept = list(range(len(polygon)))
    while len(kept) > 4:  # the corner whose triangle is smallest goes
        p = polygon[kept]
        a, b = np.roll(p, 1, axis=0), np.roll(p, -1, axis=0)
        kept.pop(int(np.argmin(abs((p[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1]) - (p[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])))))
    corners = polygon[kept]
    nxt = np.roll(corners, -1, axis=0)
    limit = slack * float(np.linalg.norm(nxt - corners, axis=1).sum())
    side = nxt - corners
    t = np.clip(((polygon[:, None] - corners) * side).sum(axis=2) / np.maximum((side**2).sum(axis=1), 1e-9), 0, 1)
    away = np.linalg.norm(polygon[:, None] - (corners + t[..., None] * side), axis=2).min(axis=1)
    return corners if away.max() <= limit else None


def document_corners(image: np.ndarray, least: float = 1000.0) -> np.ndarray | None:
    """Ordered corners of the largest bright quadrilateral of `least` pixels or more, or None."""
    best, most = None, least
    for piece in _pieces(binarized(image, 11, 2) > 0):
        polygon = hull(piece)
        if len(polygon) >= 4 and area(polygon) > most and (corners := four_corners(polygon)) is not None:
            best, most = corners, area(polygon)
    return None if best is None else ordered_corners(best)


def straightened(image: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The quadrilateral as a rectangle of the length of its top and left sides, bilinear."""
    width, height = int(np.linalg.norm(corners[0] - corners[1])), int(np.linalg.norm(corners[0] - corners[3]))
    if width < 2 or height < 2:
        return image
    target = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    rows, want = [], []
    for (x, y), (u, v) in zip(target, corners, strict=True):  # from target to source
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        want += [u, v]
    m = np.append(np.linalg.solve(np.array(rows), np.array(want)), 1.0).reshape(3, 3)
    ys, xs = np.mgrid[0:height, 0:width]
    at = m @ np.stack([xs.ravel(), ys.ravel(), np.ones(xs.size)])
    u, v = at[0] / at[2], at[1] / at[2]
    x0, y0 = (np.clip(np.floor(c).astype(int), 0, n - 2) for c, n in ((u, image.shape[1]), (v, image.shape[0])))
    fx, fy = np.clip(u - x0, 0, 1), np.clip(v - y0, 0, 1)
    if image.ndim == 3:
        fx, fy = fx[:, None], fy[:, None]
    a = image.astype(float)
    mixed = (a[y0, x0] * (1 - fx) + a[y0, x0 + 1] * fx) * (1 - fy) + (a[y0 + 1, x0] * (1 - fx) + a[y0 + 1, x0 + 1] * fx) * fy
    return np.rint(mixed).astype(np.uint8).reshape(height, width, *image.shape[2:])


# Contrast and noise.


def equalized(gray: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Histogram equalisation by tiles, contrast-limited, blended bilinearly between tile centres."""
    h, w = gray.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(gray, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if min(h, w) >= max(th, tw) else "edge")
    limit = max(1, int(clip * th * tw / 256))
    tables = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            rest = over % 256
            if rest:
                n[np.arange(rest) * (256 // rest)] += 1
            tables[i, j] = np.clip(np.rint(np.cumsum(n) * 255 / (th * tw)), 0, 255)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    at = lambda i, j: tables[np.clip(i, 0, tiles - 1)[:, None], np.clip(j, 0, tiles - 1)[None], gray]
    top, low = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx, at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def denoised(gray: np.ndarray, strength: float = 10.0, patch: int = 7, window: int = 21) -> np.ndarray:
    """Non-local means: each pixel as the mean of those in its window, weighted by how alike their patches are."""
    p, r = patch // 2, window // 2
    wide = np.pad(gray.astype(float), p + r, mode="reflect" if min(gray.shape) > p + r else "edge")
    h, w = gray.shape
    centre = wide[r : r + h + 2 * p, r : r + w + 2 * p]
    total, weights = np.zeros((h, w)), np.zeros((h, w))
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            other = wide[r + dy : r + dy + h + 2 * p, r + dx : r + dx + w + 2 * p]
            sums = np.pad(((centre - other) ** 2).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
            distance = (sums[patch:, patch:] - sums[:-patch, patch:] - sums[patch:, :-patch] + sums[:-patch, :-patch]) / patch**2
            weight = np.exp(-distance / strength**2)
            total += weight * other[p : p + h, p : p + w]
            weights += weight
    return np.clip(np.rint(total / weights), 0, 255).astype(np.uint8)


def prepared(image: np.ndarray, upscale: bool = True) -> dict:
    """A page for recognition: straightened where a document stands out, its colours noted, enlarged if wanted, then gray, equalised and denoised.  image is RGB."""
    corners = document_corners(image)
    straight = image if corners is None else straightened(image, corners)
    large = upscaled(straight) if upscale else straight
    return {"corners": None if corners is None else corners.tolist(), "corrected": straight, "colors": main_colors(straight), "enhanced": large, "final": denoised(equalized(to_gray(large)))}


def shrunk(image: np.ndarray, side: int) -> np.ndarray:
    """Made smaller by area means so that the longer side is `side` at most."""
    h, w = image.shape[:2]
    if max(h, w) <= side:
        return image
    out = image.astype(float)
    for axis, n in ((0, max(1, int(h * side / max(h, w)))), (1, max(1, int(w * side / max(h, w))))):
        size = out.shape[axis]
        edges = np.linspace(0, size, n + 1)
        sums = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis=axis)], axis=axis)
        low = np.minimum(edges.astype(int), size - 1)
        part = np.take(sums, low, axis) + np.take(out, low, axis) * (edges - low).reshape([-1 if k == axis else 1 for k in range(out.ndim)])
        out = np.diff(part, axis=axis) * n / size
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


# PNG, 8 bits a channel.


def png(image: np.ndarray) -> bytes:
    a = np.ascontiguousarray(image, np.uint8)
    h, w = a.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if a.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """What png() has written: gray or RGB without filters."""
    at, packed, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        head, packed = (struct.unpack(">IIBB", body[:10]), packed) if kind == b"IHDR" else (head, packed + body if kind == b"IDAT" else packed)
        at += 12 + n
    w, h, bits, color = head
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, -1)
    if bits != 8 or color not in (0, 2) or raw[:, 0].any():
        raise ValueError("only unfiltered 8-bit gray or RGB is read")
    return raw[:, 1:].reshape((h, w) if color == 0 else (h, w, 3))


def crops(image: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """PNG bytes of a part of an image struct (height, width, nChannels, data: BGR bytes)."""

    @F.pandas_udf("binary")
    def cut(images, boxes):
        out = []
        for (_, i), (_, b) in zip(images.iterrows(), boxes.iterrows(), strict=True):
            a = np.frombuffer(i["data"], np.uint8).reshape(i["height"], i["width"], i["nChannels"])
            a = a[b["y0"] : b["y1"], b["x0"] : b["x1"]]
            out.append(png(a[..., 2::-1] if a.shape[2] > 1 else a[..., 0]))
        return images.index.to_series().map(dict(zip(images.index, out, strict=True)))

    return cut(F.struct(*(image[c].alias(c) for c in ("height", "width", "nChannels", "data"))), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def color_grids(image: Column) -> Column:
    """array<array<string>> of an image struct (height, width, nChannels, data: BGR bytes)."""

    @F.pandas_udf("array<array<string>>")
    def grids(images):
        def one(height, width, channels, data):
            a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
            return color_grid(a[..., 2::-1] if channels > 1 else np.repeat(a, 3, axis=2))

        return images.apply(lambda r: one(r["height"], r["width"], r["nChannels"], r["data"]), axis=1)

    return grids(F.struct(*(image[c].alias(c) for c in ("height", "width", "nChannels", "data"))))


def page_colors(image: Column, k: int = 8) -> Column:
    """array<struct<color, share>> of main_colors() of an image struct, most common first."""

    @F.pandas_udf("array<struct<color:string,share:double>>")
    def colors(images):
        out = []
        for _, r in images.iterrows():
            a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
            out.append([{"color": c, "share": s} for c, s in main_colors(a[..., 2::-1] if r["nChannels"] > 1 else np.repeat(a, 3, axis=2), k)])
        return images.index.to_series().map(dict(zip(images.index, out, strict=True)))

    return colors(F.struct(*(image[c].alias(c) for c in ("height", "width", "nChannels", "data"))))
