"""Per-slice operators on slice rows: one row holds the pixels of one image.

``to_slices`` gathers voxels once; ``voxtrace.sources.nifti.read_slices`` gives such rows as they
are. Every operator then works on whole images inside Arrow tasks, so its plan has no exchange,
and a task holds a few images at a time, whatever their number per volume.

A slice row has key columns, ``height``, ``width`` and row-major ``pixels``. A pixel that is null
or not a number takes no part in ranges, thresholds and tile means.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from voxtrace.operators.histogram import STRETCH_TOLERANCE, STRETCH_TOP
from voxtrace.operators.volume import SLICE, TYPE_MAX, gaussian_kernel, tile_size

IMAGE = ArrayType(DoubleType())
#: Bytes of pixels in an Arrow batch where the session sets no bound of its own.
BATCH_BYTES = 64 << 20

Kernel = Callable[[np.ndarray], dict[str, object]]


def _bounded(df: DataFrame) -> DataFrame:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int("".join(c for c in df.sparkSession.conf.get(key) if c.isdigit()) or 0)
    if not 0 < now <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def to_slices(
    voxels: DataFrame, value: str, height: int, width: int, keys: Sequence[str] = SLICE, empty: float = 0.0
) -> DataFrame:
    """Slice rows from voxel rows, with ``empty`` where a place has no voxel."""
    place = (F.col("y") * width + F.col("x")).cast("int")
    gathered = voxels.groupBy(*keys).agg(
        F.collect_list(place).alias("_places"),
        F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))).alias("_values"),
    )
    schema = StructType(
        [gathered.schema[k] for k in keys]
        + [StructField("height", LongType()), StructField("width", LongType()), StructField("pixels", IMAGE)]
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = batch.column("_places"), batch.column("_values")
            image = np.full(len(batch) * height * width, empty)
            row = np.repeat(np.arange(len(batch)), np.diff(places.offsets.to_numpy()))
            image[row * (height * width) + places.flatten().to_numpy()] = values.flatten().to_numpy()
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * (height * width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys]
                + [pa.array(np.full(len(batch), n)) for n in (height, width)]
                + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(image))],
                [*keys, "height", "width", "pixels"],
            )

    return _bounded(gathered).mapInArrow(fill, schema)


def _images(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    offsets = batch.column(column).offsets.to_numpy()
    flat = batch.column(column).flatten().cast(pa.float64())
    flat = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    for i, (h, w) in enumerate(zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)):
        yield flat[offsets[i] : offsets[i + 1]].reshape(h, w)


def map_slices(slices: DataFrame, kernel: Kernel, fields: Sequence[StructField], column: str = "pixels") -> DataFrame:
    """Add what ``kernel`` makes of each image: images as arrays, or single values."""
    schema = StructType([*slices.schema.fields, *fields])
    names = [f.name for f in fields]
    lists = [isinstance(f.dataType, ArrayType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, image in enumerate(_images(batch, column)):
                found = kernel(image)
                added = [
                    pa.ListArray.from_arrays(pa.array([0, found[n].size], pa.int32()), pa.array(found[n].ravel()))
                    if is_list
                    else pa.array([found[n]])
                    for n, is_list in zip(names, lists, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, 1).columns, *added], [*batch.schema.names, *names]
                )

    return _bounded(slices).mapInArrow(run, schema)


def explode_slices(slices: DataFrame, columns: Sequence[str], keys: Sequence[str] = SLICE) -> DataFrame:
    """Voxel rows (keys, y, x, columns) of image columns."""
    width = F.col("width")
    pixels = slices.select(*keys, "width", F.posexplode(F.arrays_zip(*columns)).alias("_place", "_p"))
    return pixels.select(
        *keys,
        F.floor(F.col("_place") / width).cast("bigint").alias("y"),
        F.pmod(F.col("_place"), width).cast("bigint").alias("x"),
        *[F.col(f"_p.{c}").alias(c) for c in columns],
    )


def _range(image: np.ndarray) -> tuple[float, float]:
    seen = image[~np.isnan(image)]
    return (float(seen.min()), float(seen.max())) if len(seen) else (float("nan"), float("nan"))


def scale(
    slices: DataFrame, out: str, low: float = 0.0, high: float = 1.0, dtype: str = "float32", column: str = "pixels"
) -> DataFrame:
    """Scale every slice to [low, high]; a constant slice becomes ``low``.

    Integer outputs are rounded half to even and clipped.
    """
    if dtype not in TYPE_MAX and dtype != "float32":
        raise ValueError(f"No rule to store scaled values as {dtype}")

    def kernel(image: np.ndarray) -> dict[str, object]:
        least, most = _range(image)
        if least == most:
            scaled = np.where(np.isnan(image), np.nan, float(low))
        else:
            scaled = (image - least) / (most - least) * (high - low) + low
        if dtype in TYPE_MAX:
            scaled = np.clip(np.rint(scaled), 0, TYPE_MAX[dtype])
        return {out: scaled}

    return map_slices(slices, kernel, [StructField(out, IMAGE)], column)


def smooth(
    slices: DataFrame, out: str, sigma: float, source_max: float | None = None, column: str = "pixels"
) -> DataFrame:
    """Separable Gaussian with mirrored borders, cut at four sigma, as sums of shifted images."""
    if not 0 <= sigma <= 100:
        raise ValueError("sigma must be within 0..100")
    weights = gaussian_kernel(sigma) if sigma > 0 else [1.0]
    radius = len(weights) // 2

    def along(image: np.ndarray) -> np.ndarray:
        n = len(image)
        padded = image[_mirrored(n, radius)]
        total = np.zeros_like(image)
        for k, weight in enumerate(weights):
            total += weight * padded[k : k + n]
        return total

    def kernel(image: np.ndarray) -> dict[str, object]:
        smoothed = along(along(image).T).T
        if source_max is not None:
            smoothed = np.clip(np.rint(smoothed), 0, source_max)
        return {out: np.ascontiguousarray(smoothed)}

    return map_slices(slices, kernel, [StructField(out, IMAGE)], column)


def _mirrored(n: int, radius: int) -> np.ndarray:
    """Places of a line and of ``radius`` more on either side, reflected at its ends."""
    place = np.arange(-radius, n + radius) % (2 * n)
    return np.where(place < n, place, 2 * n - 1 - place)


def otsu_of(image: np.ndarray, bins: int = 256) -> tuple[float, bool]:
    """Threshold and whether the image is constant: the centre of the first bin with the largest
    spread between both classes."""
    low, high = _range(image)
    if not low < high:
        return low, True
    seen = image[~np.isnan(image)]
    number = np.minimum(np.floor((seen - low) / (high - low) * bins), bins - 1).astype(np.int64)
    n = np.bincount(number, minlength=bins)
    first, moment = np.cumsum(n), np.cumsum(n * np.arange(bins))
    w1, w2 = first.astype(float), (first[-1] - first).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = moment / w1 - (moment[-1] - moment) / w2
        spread = w1 * w2 * gap * gap
    spread = np.where((n > 0) & (w2 > 0), spread, -1.0)
    return low + (int(spread.argmax()) + 0.5) * (high - low) / bins, False


def otsu(
    slices: DataFrame,
    out: str | None = None,
    mode: str = "binary",
    foreground: float = 1.0,
    background: float = 0.0,
    bins: int = 256,
    column: str = "pixels",
) -> DataFrame:
    """threshold, voxels, retained, constant and fraction of each slice, and the image ``out``:
    binary, or the intensity above the threshold and 0 elsewhere."""
    if mode not in {"binary", "masked"}:
        raise ValueError("mode must be binary or masked")

    def kernel(image: np.ndarray) -> dict[str, object]:
        threshold, constant = otsu_of(image, bins)
        above = image > threshold
        voxels, retained = int((~np.isnan(image)).sum()), int(above.sum())
        shown = np.where(above, foreground, background) if mode == "binary" else np.where(above, image, 0.0)
        return {
            "threshold": threshold,
            "voxels": voxels,
            "retained": retained,
            "constant": constant,
            "fraction": retained / voxels if voxels else None,
            out: shown,
        }

    fields = [
        StructField("threshold", DoubleType()),
        StructField("voxels", LongType()),
        StructField("retained", LongType()),
        StructField("constant", BooleanType()),
        StructField("fraction", DoubleType()),
    ]
    return map_slices(slices, kernel, fields + ([StructField(out, IMAGE)] if out else []), column)


def gradient(slices: DataFrame, out: str, column: str = "pixels") -> DataFrame:
    """Mean gradient magnitude of each slice: central differences, one-sided at the border."""

    def slope(image: np.ndarray) -> np.ndarray:
        return np.gradient(image, axis=0) if len(image) > 1 else np.zeros_like(image)

    def kernel(image: np.ndarray) -> dict[str, object]:
        down, across = slope(image), slope(image.T).T
        return {out: float(np.sqrt(down * down + across * across).mean())}

    return map_slices(slices, kernel, [StructField(out, DoubleType())], column)


def stretch(slices: DataFrame, out: str, column: str = "pixels") -> DataFrame:
    """Contrast stretch between the bins that hold one percent at either end; capped at the top."""

    def kernel(image: np.ndarray) -> dict[str, object]:
        seen = image[~np.isnan(image)]
        held = seen[(seen >= 0) & (seen <= STRETCH_TOP)]
        n = np.bincount(np.minimum(np.floor(held), STRETCH_TOP - 1).astype(np.int64), minlength=STRETCH_TOP)
        reached = np.where(n > 0, np.cumsum(n), -1)
        limits = []
        for percent in (STRETCH_TOLERANCE, 100 - STRETCH_TOLERANCE):
            places = np.flatnonzero(reached >= len(seen) * percent / 100)
            limits.append(float(places[0]) if len(places) else float(STRETCH_TOP))
        low, high = limits
        raised = np.where(image < low, 0.0, image - low)
        if high == low:
            stretched = np.where(raised > 0, float(STRETCH_TOP), 0.5)
        else:
            stretched = raised * (STRETCH_TOP / (high - low)) + 0.5
        return {out: np.minimum(np.where(np.isnan(image), np.nan, stretched), STRETCH_TOP)}

    return map_slices(slices, kernel, [StructField(out, IMAGE)], column)


def _tile_rows(slices: DataFrame, cut: Callable, column: str, threshold: bool) -> DataFrame:
    """A row for each tile that ``cut`` (height, width -> rows of number and origin, size) names."""
    kept = [f for f in slices.schema.fields if f.name not in {"height", "width", column}]
    added = [StructField(n, LongType()) for n in ("tile_row", "tile_col", "y0", "x0", "height", "width")]
    extra = [StructField("tissue", DoubleType())] if threshold else []
    schema = StructType([*kept, *added, *extra, StructField(column, IMAGE)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, image in enumerate(_images(batch, column)):
                places, size = cut(*image.shape)
                images = [image[y : y + size, x : x + size] for _, _, y, x in places]
                share = []
                if threshold:
                    limit, _ = otsu_of(image)
                    share = [float((t > limit).sum() / max(1, (~np.isnan(t)).sum())) for t in images]
                    keep = [k for k, s in enumerate(share) if s > 0]
                    places, images, share = ([x[k] for k in keep] for x in (places, images, share))
                if not places:
                    continue
                own = batch.slice(i, 1)
                columns = [pa.concat_arrays([own.column(n)] * len(places)) for n in names]
                columns += [pa.array(v, pa.int64()) for v in zip(*places, strict=True)]
                columns += [pa.array([size] * len(places), pa.int64())] * 2
                if threshold:
                    columns.append(pa.array(share))
                offsets = np.arange(len(places) + 1, dtype=np.int32) * size * size
                flat = np.concatenate([t.ravel() for t in images])
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return _bounded(slices).mapInArrow(run, schema)


def _grid(height: int, width: int, tiles: int) -> tuple[list[tuple[int, int, int, int]], int]:
    size = tile_size(height, width, tiles)
    return [(r, c, r * size, c * size) for r in range(height // size) for c in range(width // size)], size


def tile(slices: DataFrame, tiles: int, column: str = "pixels") -> DataFrame:
    """Full tiles of a regular grid as slice rows of their own; the remainder is dropped."""
    return _tile_rows(slices, lambda h, w: _grid(h, w, tiles), column, threshold=False)


def tissue(slices: DataFrame, tiles: int, column: str = "pixels") -> DataFrame:
    """Tiles with any pixel above the Otsu threshold of their slice, with the share of such pixels."""
    return _tile_rows(slices, lambda h, w: _grid(h, w, tiles), column, threshold=True)


def tile_overlapping(slices: DataFrame, size: int, overlap_percent: float, column: str = "pixels") -> DataFrame:
    """Tiles at every stride, clamped to end inside the image."""
    if overlap_percent >= 70:
        raise ValueError("Tiles overlap by 70 percent or more")
    stride = size - int(size * overlap_percent / 100)

    def cut(height: int, width: int) -> tuple[list[tuple[int, int, int, int]], int]:
        if size > min(height, width):
            raise ValueError("A tile must fit into the image")
        return [
            (r, c, min(r * stride, height - size), min(c * stride, width - size))
            for r in range(-(-height // stride))
            for c in range(-(-width // stride))
        ], size

    return _tile_rows(slices, cut, column, threshold=False)


def stitch_tiles(
    tiles: DataFrame, height: int, width: int, keys: Sequence[str] = SLICE, column: str = "pixels"
) -> DataFrame:
    """Slice rows from tile rows: floor of the mean over covering tiles, clipped to 0..255.

    The one exchange brings the tiles of a slice together; a slice whose largest stitched value
    is at most 1 is scaled by 255 instead.
    """
    gathered = tiles.groupBy(*keys).agg(
        F.collect_list(F.struct("y0", "x0", "height", "width", F.col(column).alias("p"))).alias("_tiles")
    )
    schema = StructType(
        [gathered.schema[k] for k in keys]
        + [StructField("height", LongType()), StructField("width", LongType()), StructField("stitched", ArrayType(LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                total, count = np.zeros((height, width)), np.zeros((height, width))
                for t in batch.column("_tiles")[i].values.to_pylist():
                    rows = slice(t["y0"], t["y0"] + t["height"])
                    columns = slice(t["x0"], t["x0"] + t["width"])
                    total[rows, columns] += np.array(t["p"], float).reshape(t["height"], t["width"])
                    count[rows, columns] += 1
                mean = np.floor(total / np.maximum(count, 1))
                peak = mean[count > 0].max(initial=0)
                shown = np.clip(mean, 0, 255) if peak > 1 else mean * 255
                flat = pa.array(shown.ravel().astype(np.int64), mask=count.ravel() == 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(i, 1) for k in keys]
                    + [pa.array([height]), pa.array([width])]
                    + [pa.ListArray.from_arrays(pa.array([0, height * width], pa.int32()), flat)],
                    [*keys, "height", "width", "stitched"],
                )

    return _bounded(gathered).mapInArrow(run, schema)
