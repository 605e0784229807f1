"""NIfTI-1 volumes as one row per z-slice.

Only headers are read to plan the work. Slices of an uncompressed file are then read by
offset, each by the task that owns it; a compressed file is streamed slice by slice. A file of
more than three axes holds one volume for each index of the others (the fourth axis fastest);
where there is more than one, its number from 0 follows the path in ``volume_id``, after ``#``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_SCHEMA = (
    "volume_id string, z bigint, height bigint, width bigint, dtype string, "
    "voxel_size array<double>, unit string, pixels array<float>"
)
HEADER_SCHEMA = (
    "path string, nx bigint, ny bigint, nz bigint, volumes bigint, dtype string, item_bytes bigint, "
    "data_offset bigint, big_endian boolean, voxel_size array<double>, unit string, "
    "slope double, intercept double"
)


def _header_reader():
    # Fixed values of the format: data type codes and spatial units.
    types = {2: "uint8", 4: "int16", 8: "int32", 16: "float32", 64: "float64",
             256: "int8", 512: "uint16", 768: "uint32"}
    units = {1: "meter", 2: "mm", 3: "micron"}

    def read(batches):
        import gzip
        import math
        import struct

        import numpy as np
        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path in batch["path"]:
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_file(inner) as raw:
                    source = gzip.GzipFile(fileobj=raw) if inner.endswith(".gz") else raw
                    head = source.read(348)
                order = "<" if struct.unpack("<i", head[:4])[0] == 348 else ">"
                dim = struct.unpack(order + "8h", head[40:56])
                code = struct.unpack(order + "h", head[70:72])[0]
                pixdim = struct.unpack(order + "8f", head[76:108])
                offset, slope, intercept = struct.unpack(order + "3f", head[108:120])
                if code not in types:
                    raise ValueError(f"Unsupported data type {code} in {path}")
                rows.append(
                    (
                        path, dim[1], dim[2], dim[3] if dim[0] > 2 else 1,
                        math.prod(max(1, n) for n in dim[4 : dim[0] + 1]), types[code],
                        np.dtype(types[code]).itemsize, int(offset), order == ">",
                        [float(v) for v in pixdim[1:4]], units.get(head[123] & 7, "unknown"),
                        slope or 1.0, intercept if slope else 0.0,
                    )
                )
            yield pd.DataFrame(
                rows,
                columns=["path", "nx", "ny", "nz", "volumes", "dtype", "item_bytes", "data_offset",
                         "big_endian", "voxel_size", "unit", "slope", "intercept"],
            )

    return read


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Shape, type, voxel size and data offset of every NIfTI file below ``path``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path")
        .where(F.col("path").endswith(".nii") | F.col("path").endswith(".nii.gz"))
    )
    return files.mapInPandas(_header_reader(), HEADER_SCHEMA)


def _slice_reader():
    def read(batches):
        import gzip

        import numpy as np
        import pandas as pd
        from pyarrow import fs

        def frame(item, place, raw):
            kind = np.dtype(item.dtype).newbyteorder(">" if item.big_endian else "<")
            values = np.frombuffer(raw, dtype=kind).astype(np.float32)
            volume, z = divmod(place, item.nz)
            name = f"{item.path}#{volume}" if item.volumes > 1 else item.path
            values = values * np.float32(item.slope) + np.float32(item.intercept)
            return pd.DataFrame(
                {
                    "volume_id": [name], "z": [z], "height": [item.ny], "width": [item.nx],
                    "dtype": [item.dtype], "voxel_size": [item.voxel_size], "unit": [item.unit],
                    "pixels": [values],
                }
            )

        for batch in batches:
            for item in batch.itertuples(index=False):
                system, inner = fs.FileSystem.from_uri(item.path)
                size = item.nx * item.ny * item.item_bytes
                with system.open_input_file(inner) as raw:
                    if inner.endswith(".gz"):
                        stream = gzip.GzipFile(fileobj=raw)
                        stream.read(item.data_offset)
                        for place in range(item.nz * item.volumes):
                            yield frame(item, place, stream.read(size))
                    else:
                        raw.seek(item.data_offset + item.place * size)
                        yield frame(item, item.place, raw.read(size))

    return read


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    """One row per (volume, z) with row-major (y, x) pixels."""
    headers = read_headers(spark, path)
    compressed = F.col("path").endswith(".gz")
    work = headers.withColumn(
        "place",
        F.explode(
            F.when(compressed, F.array(F.lit(0).cast("bigint"))).otherwise(
                F.sequence(F.lit(0).cast("bigint"), F.col("nz") * F.col("volumes") - 1)
            )
        ),
    )
    return work.repartition("path", "place").mapInPandas(_slice_reader(), SLICE_SCHEMA)


def slices_to_voxels(slices: DataFrame) -> DataFrame:
    """(volume_id, z, y, x, v) from row-major slices."""
    return slices.select(
        "volume_id", "z", "width", F.posexplode("pixels").alias("position", "v")
    ).select(
        "volume_id",
        "z",
        F.floor(F.col("position") / F.col("width")).cast("bigint").alias("y"),
        F.pmod(F.col("position"), F.col("width")).cast("bigint").alias("x"),
        F.col("v").cast("double").alias("v"),
    )
