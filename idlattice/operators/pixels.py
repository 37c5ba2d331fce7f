"""Measures of decoded images, block by block, in NumPy inside Arrow passes.

Images come from Spark's image source (``sources.files.read_pixels``): height, width, channels and BGR bytes. The
results are rows of numbers that the forensic and face operators work on; no pixels leave the pass. The
filters are plain NumPy; equality with an image library's last digit is not claimed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .images import BAND_RATIOS

BLOCK = 32
#: Where eyes, nose and mouth corners (right ones first) stand in an aligned face of 112 by 112.
ALIGNED = ((38.2946, 51.6963), (73.5318, 51.6963), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.3655))
ALIGNED_SIDE = 112
#: Skin in the YCrCb space (least and most Cr, Cb), and what a box of skin must be to count as a face.
SKIN, FACE_SIDE, FACE_ASPECT, SKIN_CONFIDENCE, MOST_FACES = ((130, 180), (70, 135)), 60, (0.65, 2.2), 0.88, 3
#: The luminance table of the JPEG standard, row by row.
LUMINANCE = (16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99)


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return pixels[:, :, 0] if channels == 1 else pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])


def _near(image: np.ndarray) -> list[np.ndarray]:
    """The nine shifts of an image by at most one pixel, its border repeated."""
    wide = np.pad(image, 1, mode="edge")
    h, w = image.shape
    return [wide[y : y + h, x : x + w] for y in range(3) for x in range(3)]


def laplacian(image: np.ndarray) -> np.ndarray:
    n = _near(image)
    return n[1] + n[3] + n[5] + n[7] - 4 * image


def gradient(image: np.ndarray) -> np.ndarray:
    """Length of the Sobel gradient."""
    n = _near(image)
    dx, dy = n[2] + 2 * n[5] + n[8] - n[0] - 2 * n[3] - n[6], n[6] + 2 * n[7] + n[8] - n[0] - 2 * n[1] - n[2]
    return np.hypot(dx, dy)


def noise(image: np.ndarray) -> np.ndarray:
    """What a 3 by 3 median takes away."""
    return image - np.median(np.stack(_near(image)), axis=0)


def recompression_error(image: np.ndarray, quality: int = 92) -> np.ndarray:
    """Absolute change of an image by 8 by 8 cosine coding with the standard table at a quality."""
    h, w = image.shape
    full = np.pad(image, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    table = np.clip(np.floor((np.array(LUMINANCE).reshape(8, 8) * scale + 50) / 100), 1, 255)
    tiles = full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).transpose(0, 2, 1, 3)
    coded = np.round(basis @ tiles @ basis.T / table) * table
    back = np.clip(np.round(basis.T @ coded @ basis) + 128, 0, 255).transpose(0, 2, 1, 3).reshape(full.shape)
    return np.abs(image - back[:h, :w])


def residuals(image: np.ndarray, quality: int = 90) -> tuple[float, float, float]:
    """Mean and standard deviation of the recompression error, and standard deviation of the noise, over a whole image."""
    error = recompression_error(image, quality)
    return float(error.mean()), float(error.std()), float(noise(image).std())


def otsu(image: np.ndarray) -> int:
    """The grey level that parts an image into its two most different classes."""
    counts = np.bincount(np.clip(np.round(image), 0, 255).astype(np.int64).ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.argmax(np.nan_to_num(between)))


def _box(image: np.ndarray, high: int, wide: int, pick) -> np.ndarray:
    padded = np.pad(image, ((high // 2, high // 2), (wide // 2, wide // 2)), mode="edge")
    rows = pick(np.lib.stride_tricks.sliding_window_view(padded, high, axis=0), axis=-1)
    return pick(np.lib.stride_tricks.sliding_window_view(rows, wide, axis=1), axis=-1)


def zone_variants(image: np.ndarray, window: int = 21, offset: float = 10.0) -> dict[str, np.ndarray]:
    """Black-and-white versions of a band for recognition: one level for all, a level for every place, dark strokes on any ground."""
    local = _box(image, window, window, np.mean)
    ground = _box(_box(image, 5, 13, np.max), 5, 13, np.min)
    strokes = ground - image
    return {"otsu": image > otsu(image), "adaptive": image > local - offset, "blackhat": strokes > otsu(strokes)}


def _sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between pixels, the border repeated."""
    x, y = np.clip(x, 0, image.shape[1] - 1.001), np.clip(y, 0, image.shape[0] - 1.001)
    i, j, fx, fy = y.astype(int), x.astype(int), x % 1, y % 1
    return image[i, j] * (1 - fx) * (1 - fy) + image[i, j + 1] * fx * (1 - fy) + image[i + 1, j] * (1 - fx) * fy + image[i + 1, j + 1] * fx * fy


def flattened(image: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """The page between four corners (top left, top right, bottom right, bottom left) as an upright image."""
    target = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    rows = []
    for (x, y), (u, v) in zip(target, np.asarray(corners, float), strict=True):  # from the upright page back to the picture
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    m = np.append(np.linalg.solve(np.array(rows), np.asarray(corners, float).ravel()), 1).reshape(3, 3)
    at = m @ np.stack([g.ravel() for g in np.meshgrid(np.arange(width), np.arange(height))] + [np.ones(width * height)])
    return _sampled(image, at[0] / at[2], at[1] / at[2]).reshape(height, width)


def aligned_face(image: np.ndarray, landmarks: np.ndarray | None, box: tuple[int, int, int, int] | None = None) -> np.ndarray | None:
    """A face of 112 by 112: turned, scaled and shifted so that its five landmarks fit best; without them its box with a tenth around."""
    grid = np.meshgrid(np.arange(ALIGNED_SIDE, dtype=float), np.arange(ALIGNED_SIDE, dtype=float))
    if landmarks is not None and len(landmarks) == 5:
        rows, right = [], []
        for (u, v), (x, y) in zip(ALIGNED, np.asarray(landmarks, float), strict=True):  # from the aligned face back to the picture
            rows += [[u, -v, 1, 0], [v, u, 0, 1]]
            right += [x, y]
        a, b, c, d = np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0]
        return _sampled(image, a * grid[0] - b * grid[1] + c, b * grid[0] + a * grid[1] + d)
    if box is None:
        return None
    x, y, w, h = box
    x1, y1 = max(0, x - int(w * 0.1)), max(0, y - int(h * 0.1))
    x2, y2 = min(image.shape[1], x + w + int(w * 0.1)), min(image.shape[0], y + h + int(h * 0.1))
    if x2 <= x1 or y2 <= y1:
        return None
    step = lambda a, b, g: a + (g + 0.5) * (b - a) / ALIGNED_SIDE - 0.5
    return _sampled(image, step(x1, x2, grid[0]), step(y1, y2, grid[1]))


def skin_boxes(pixels: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) of connected skin-coloured areas that could be faces, largest first: BGR pixels in, runs of rows joined where they touch."""
    blue, green, red = (pixels[:, :, k].astype(np.float64) for k in range(3))
    luma = 0.299 * red + 0.587 * green + 0.114 * blue
    cr, cb = (red - luma) * 0.713 + 128, (blue - luma) * 0.564 + 128
    mask = (cr >= SKIN[0][0]) & (cr <= SKIN[0][1]) & (cb >= SKIN[1][0]) & (cb <= SKIN[1][1])
    mask = _box(_box(mask, 5, 5, np.max), 5, 5, np.min)
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, begin = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    parent = list(range(len(y)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    first = np.searchsorted(y, np.arange(mask.shape[0] + 1))
    for line in range(1, mask.shape[0]):
        a, b = int(first[line - 1]), int(first[line])
        while a < first[line] and b < first[line + 1]:
            if begin[a] < end[b] and begin[b] < end[a]:
                parent[max(root(a), root(b))] = min(root(a), root(b))
            if end[a] < end[b]:
                a += 1
            else:
                b += 1
    found: dict[int, list[int]] = {}
    for k in range(len(y)):
        box = found.setdefault(root(k), [int(begin[k]), int(y[k]), int(end[k]), int(y[k]) + 1, 0])
        box[0], box[2], box[3] = min(box[0], int(begin[k])), max(box[2], int(end[k])), int(y[k]) + 1
        box[4] += int(end[k] - begin[k])
    boxes = [(x1, y1, x2 - x1, y2 - y1) for x1, y1, x2, y2, area in found.values() if area >= FACE_SIDE**2 * 0.4 and FACE_ASPECT[0] <= (y2 - y1) / max(1, x2 - x1) <= FACE_ASPECT[1]]
    return sorted(boxes, key=lambda b: -b[2] * b[3])[:MOST_FACES]


def block_rows(image: np.ndarray, size: int = BLOCK) -> list[tuple[int, int, int, float, float, float]]:
    """(block, x, y, mean recompression error, standard deviation of the noise, mean sharpness); noise off the edges where enough is left."""
    if min(image.shape) < size:
        return []
    error, rest, sharp, edges = recompression_error(image), noise(image), np.abs(laplacian(image)), gradient(image) > 60
    rows = []
    for n, (y, x) in enumerate((y, x) for y in range(0, image.shape[0] - size + 1, size) for x in range(0, image.shape[1] - size + 1, size)):
        cut = np.s_[y : y + size, x : x + size]
        calm = rest[cut][~edges[cut]]
        rows.append((n, x, y, float(error[cut].mean()), float((calm if calm.size >= 0.2 * size * size else rest[cut]).std()), float(sharp[cut].mean())))
    return rows


def with_blocks(images: DataFrame, size: int = BLOCK) -> DataFrame:
    """images (path, height, width, channels, data) -> path, block, x, y, ela, noise, sharpness, error. Images under a block have no rows.

    An image whose bytes can't be measured has one row of nulls with the error; the others go on.
    """
    names, kinds = ["block", "x", "y", "ela", "noise", "sharpness"], [*[pa.int32()] * 3, *[pa.float64()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                path, h, w, c, data = (batch.column(k)[r].as_py() for k in range(5))
                rows, error = [], None
                try:
                    rows = block_rows(grey(data, h, w, c), size) if data else []
                except (ValueError, TypeError, IndexError) as problem:
                    rows, error = [(None,) * len(names)], f"{type(problem).__name__}: {problem}"[:200]
                if rows:
                    columns = zip(zip(*rows, strict=True), kinds, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *[pa.array(v, kind) for v, kind in columns], pa.array([error] * len(rows), pa.string())], names=["path", *names, "error"])

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, block int, x int, y int, ela double, noise double, sharpness double, error string")


def with_face_measures(images: DataFrame) -> DataFrame:
    """images of cut-out faces -> path, sharpness (variance of the Laplacian), brightness, embedding (16 by 8 block means, unit length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in range(batch.num_rows):
                path, h, w, c, data = (batch.column(k)[r].as_py() for k in range(5))
                image = grey(data, h, w, c)
                rows, cols = np.array_split(np.arange(h), 16), np.array_split(np.arange(w), 8)
                vector = np.array([image[np.ix_(y, x)].mean() if len(y) and len(x) else 0.0 for y in rows for x in cols])
                vector /= max(1e-12, float(np.linalg.norm(vector)))
                out.append((path, float(laplacian(image).var()), float(image.mean()), vector.tolist()))
            if out:
                path, sharp, bright, vectors = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(sharp), pa.array(bright), pa.array(vectors, pa.list_(pa.float64()))], names=["path", "sharpness", "brightness", "embedding"])

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, sharpness double, brightness double, embedding array<double>")


def _each(images: DataFrame, rows_of, schema: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    """Rows that ``rows_of`` (pixels of height, width, channels) makes of every image, behind its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                path, h, w, c, data = (batch.column(k)[r].as_py() for k in range(5))
                rows = rows_of(np.frombuffer(data, np.uint8).reshape(h, w, c)) if data else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *[pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["path", *names])

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, f"path string, {schema}")


def with_zone_variants(images: DataFrame, ratios: tuple[float, ...] = BAND_RATIOS) -> DataFrame:
    """images -> path, ratio, filter, height, width, data: black-and-white bottom bands (bytes 0 and 255) for a recogniser."""

    def rows_of(pixels: np.ndarray) -> list[tuple]:
        image = grey(pixels.tobytes(), *pixels.shape)
        bands = [(r, image[max(0, min(int(image.shape[0] * (1 - r)), image.shape[0] - 10)) :]) for r in ratios]
        return [(r, name, *band.shape, (made * np.uint8(255)).astype(np.uint8).tobytes()) for r, band in bands if band.shape[0] >= 20 and band.shape[1] >= 50 for name, made in zone_variants(band).items()]

    return _each(images, rows_of, "ratio double, filter string, height int, width int, data binary", ["ratio", "filter", "height", "width", "data"], [pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.binary()])


def with_skin_faces(images: DataFrame) -> DataFrame:
    """images (three channels) -> path, ordinal, x, y, w, h, confidence: where skin suggests a face, for want of a detector."""

    def rows_of(pixels: np.ndarray) -> list[tuple]:
        return [(k, *box, SKIN_CONFIDENCE) for k, box in enumerate(skin_boxes(pixels))] if pixels.shape[2] >= 3 else []

    return _each(images, rows_of, "ordinal int, x int, y int, w int, h int, confidence double", ["ordinal", "x", "y", "w", "h", "confidence"], [*[pa.int32()] * 5, pa.float64()])


def synthetic_page(seed: int, k: int, height: int = 400, width: int = 600) -> np.ndarray:
    """The k-th invented page, BGR: of every four, the second bears a copied, the fourth a spliced patch."""
    rng = np.random.default_rng([seed, k])
    page = np.full((height, width), 245.0)
    for line in range(4):  # strokes like printed words
        for x in range(40, 300, 9):
            top = 50 + 50 * line + int(rng.integers(0, 4))
            page[top : top + 12, x : x + 4] = 30.0
    page += rng.normal(0, 3.0, page.shape)
    if k % 4 == 1:
        page[240:320, 340:500] = page[40:120, 40:200]
    elif k % 4 == 3:
        page[200:270, 350:510] = rng.integers(0, 255, (70, 160))
    return np.repeat(np.clip(page, 0, 255).astype(np.uint8)[:, :, None], 3, axis=2)


def synthetic_pages(spark: SparkSession, documents: int, seed: int = 7, height: int = 400, width: int = 600) -> DataFrame:
    """Invented pages for calibration: path, height, width, channels, data, tampered. Of every four, the second bears a copied, the fourth a spliced patch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                data = synthetic_page(seed, k, height, width).tobytes()
                yield pa.RecordBatch.from_pydict({"path": [f"synthetic/{k}"], "height": pa.array([height], pa.int32()), "width": pa.array([width], pa.int32()), "channels": pa.array([3], pa.int32()), "data": pa.array([data], pa.binary()), "tampered": [k % 2 == 1]})

    return spark.range(documents).select(F.col("id")).mapInArrow(run, "path string, height int, width int, channels int, data binary, tampered boolean")
