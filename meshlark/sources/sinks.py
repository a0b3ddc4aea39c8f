"""Sinks: Parquet datasets of samplers and text meshes for viewers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_dataset(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table each; grids are split by mesh so that a mesh is read alone."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("mesh_id") if name in ("grid", "planes") else w).parquet(f"{path.rstrip('/')}/{name}")


def write_split(samplers: DataFrame, path: str) -> None:
    """Held-out rows next to the dataset, under ``_test``."""
    samplers.where("split = 'test'").write.mode("overwrite").parquet(f"{path.rstrip('/')}_test")


def obj_text(surfaces: DataFrame) -> DataFrame:
    """``mesh_id, obj``: Wavefront text of ``isosurface.isosurfaces`` rows."""
    v = F.transform("vertices", lambda p: F.concat(F.lit("v "), F.concat_ws(" ", F.transform(p, lambda c: c.cast("string")))))
    f = F.transform("faces", lambda t: F.concat(F.lit("f "), F.concat_ws(" ", F.transform(t, lambda c: c.cast("string")))))
    return surfaces.select("mesh_id", F.concat_ws("\n", F.concat(v, f)).alias("obj"))


def write_obj(surfaces: DataFrame, path: str) -> None:
    obj_text(surfaces).write.mode("overwrite").partitionBy("mesh_id").text(path)
