"""Mesh and table sources: STL (binary and text), delimited parameter tables, numbered folders."""

from __future__ import annotations

import re
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.operators.tables import integrity_join, parse_delimited, trailing_id

FACET = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])
NUMBER = rb"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
VERTEX = re.compile(rb"vertex\s+(%b)\s+(%b)\s+(%b)" % (NUMBER, NUMBER, NUMBER))


def decode_stl(data: bytes) -> np.ndarray:
    """Corners (T, 3, 3). A binary file is as long as its header announces, or longer (some writers add
    bytes) unless it reads as text, whose header may be that of either kind."""
    many = int.from_bytes(data[80:84], "little")
    rest = len(data) - 84 - 50 * many if len(data) >= 84 else -1
    text = data.lstrip().startswith(b"solid") and (VERTEX.search(data) or b"endsolid" in data)
    if rest == 0 or rest > 0 and not text:
        return np.frombuffer(data, FACET, many, 84)["corners"].astype(float)
    if not text:
        raise ValueError("not an STL file")
    found = np.array([[float(x) for x in v] for v in VERTEX.findall(data)]).reshape(-1, 3)
    if len(found) % 3:
        raise ValueError("an STL facet has three vertices")
    return found.reshape(-1, 3, 3)


def encode_stl(corners: np.ndarray) -> bytes:
    out = np.zeros(len(corners), FACET)
    out["corners"] = corners
    return b"\0" * 80 + len(corners).to_bytes(4, "little") + out.tobytes()


def read_stl(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Facet soup ``path, mesh_id, face_id, vertex_id, x, y, z``. The mesh id is the trailing number of
    the file's folder if ``folder`` (a pattern for folder names) is given, else of the file's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[sS][tT][lL]").load(path)
    parts = F.split("path", "/")
    owner = F.element_at(parts, -2 if folder else -1)
    if folder:
        files = files.where(owner.rlike(f"(?i)^{folder}$"))
    files = files.select("path", trailing_id(F.regexp_replace(owner, r"(?i)\.stl$", "")).cast("long").alias("mesh_id"), "content")

    def run(frames):
        for f in frames:
            for path, mesh, data in zip(f["path"], f["mesh_id"], f["content"]):
                c = decode_stl(data).reshape(-1, 3)
                k = np.arange(len(c))
                yield pd.DataFrame({"path": path, "mesh_id": mesh, "face_id": k // 3 + 1, "vertex_id": k + 1, "x": c[:, 0], "y": c[:, 1], "z": c[:, 2]})

    return files.mapInPandas(run, "path string, mesh_id long, face_id long, vertex_id long, x double, y double, z double")


def soup_tables(soup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``vertices`` and ``faces`` of a facet soup with three vertices of its own a face."""
    vertices = soup.select("mesh_id", "vertex_id", "x", "y", "z")
    return vertices, soup.select("mesh_id", "face_id").distinct().selectExpr("mesh_id", "face_id", "3*face_id - 2 as a", "3*face_id - 1 as b", "3*face_id as c")


def read_parameters(spark: SparkSession, path: str, sep: str | None = ",") -> DataFrame:
    """``mesh_id, p`` from a headerless text table; ``sep=None`` parts fields at runs of blanks."""
    return parse_delimited(spark.read.text(path).where("trim(value) <> ''"), "value", sep)


def read_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that ``sinks.write_dataset`` stored."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    return {s.getPath().getName(): spark.read.parquet(str(s.getPath())) for s in found if s.isDirectory()}


def read_batch(spark: SparkSession, table: str, meshes: str, folder: str, sep: str | None = ",") -> tuple[DataFrame, DataFrame]:
    """Facets and parameters of a batch. A folder without a row in the table is an error, rows without
    a folder are a warning; of folders with one number the last by name counts."""
    facets, params = read_stl(spark, meshes, folder), read_parameters(spark, table, sep)
    last = facets.select("mesh_id", "path").groupBy("mesh_id").agg(F.max("path").alias("_path"))
    facets = facets.join(last.withColumnRenamed("mesh_id", "_id"), (F.col("mesh_id") == F.col("_id")) & (F.col("path") == F.col("_path"))).drop("_id", "_path")
    spare = params.join(facets.select("mesh_id").distinct(), "mesh_id", "left_anti").count()
    if spare:
        warnings.warn(f"{spare} rows of the table have no mesh", stacklevel=2)
    lost = integrity_join(facets.select("mesh_id").distinct(), params, "mesh_id", "mesh_id").where("not matched").limit(5).collect()
    if lost:
        raise ValueError(f"no parameters for meshes {[r[0] for r in lost]}")
    return facets, params
