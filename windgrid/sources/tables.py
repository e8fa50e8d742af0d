"""Reading and writing tables: manifests, shards, frames, sparse fields, images, calibration files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windgrid.operators.ordering import keep_first


def diagonal_union(parts: list[DataFrame]) -> DataFrame:
    """All rows; a missing column is null, differing types widen as in any union."""
    if not parts:
        raise ValueError("nothing to read")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def resolve(spark: SparkSession, folder: str, paths: list[str]) -> list[str]:
    """Of each listed shard the first place that exists: as given, below folder, or by its last name in folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    exists = lambda p: (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)
    found = []
    for p in paths:
        places = ([p] if "://" in p or p.startswith("/") else []) + [f"{folder}/{p}", f"{folder}/{p.rsplit('/', 1)[-1]}"]
        found += [q for q in places if exists(q)][:1]
    return found


def read_manifest(spark: SparkSession, folder: str, name: str = "_manifest.json") -> DataFrame:
    """The shards that a manifest lists ({"shards": [path or {"path": ...}]}), as one table."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")  # Spark's readers pass over names with an underscore
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    shards = [s if isinstance(s, str) else s["path"] for s in json.loads(text)["shards"]]
    return diagonal_union([spark.read.parquet(p) for p in resolve(spark, folder, shards)])


def write_manifest(spark: SparkSession, folder: str, shards: list[str], name: str = "_manifest.json") -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps({"shards": shards}).encode()))
    out.close()


def workbook_kind(path: str) -> str:
    """What a workbook holds, by its name."""
    name = path.rsplit("/", 1)[-1].lower()
    return next((k for w, k in (("location", "location"), ("adsb", "location"), ("amdar", "amdar"), ("turb", "turb")) if w in name), "generic")


def read_csv_numbers(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A headed CSV, read as text; the listed columns are parsed and are null where that fails."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumns({c: F.col(c).try_cast("double") for c in numbers if c in df.columns})


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' rows by key; the new table's row replaces the old one's."""
    both = old.withColumn("__p", F.lit(1)).unionByName(new.withColumn("__p", F.lit(0)), allowMissingColumns=True)
    return keep_first(both, keys, ["__p"]).drop("__p")


def time_in_name(name: Column) -> Column:
    """The time in the eighth part of an underscore-split file name; null if it is none."""
    return F.try_to_timestamp(F.regexp_extract(F.try_element_at(F.split(name, "_"), F.lit(8)), r"^(\d{14})", 1), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, length of the files of a folder that match, without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length")


def image_blocks(pixels: DataFrame, factor: int, levels: int) -> DataFrame:
    """Mean, maximum and deviation of blocks of pixels (frame, y, x, value) with a positive maximum, on all levels."""
    g = pixels.groupBy("frame", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x"))
    g = g.agg(F.avg("value").alias("mean"), F.max("value").alias("top"), F.stddev_pop("value").alias("spread")).where("top > 0")
    return g.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))


def write_frames(df: DataFrame, path: str, frame: str = "frame") -> None:
    """One folder per frame value, zstd Parquet; a rerun replaces only the frames it has."""
    df.repartition(frame).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(frame).parquet(path)


def sparse(dense: DataFrame, value: str, fill: float) -> DataFrame:
    """Only the cells that differ from the fill."""
    return dense.where(F.col(value).isNotNull() & (F.col(value) != fill))


def densify(cells: DataFrame, frames: DataFrame, shape: tuple[int, int, int], value: str, fill: float) -> DataFrame:
    """All cells of the frames' grids, with the fill where a cell is missing."""
    axes = [F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in shape]
    grid = frames.withColumn("z", axes[0]).withColumn("y", axes[1]).withColumn("x", axes[2])
    return grid.join(cells, ["frame", "z", "y", "x"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def level_merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Levels of two payloads of one source; where both have a level the first counts."""
    return latest_wins(b, a, keys)


def nearest_cycle(ts: Column, hours: int = 6) -> tuple[Column, Column]:
    """Start of the nearest cycle of `hours`, and the hours from it to ts (rounded half up)."""
    seconds = F.unix_micros(ts.cast("timestamp")) / 1e6
    start = F.floor(seconds / (hours * 3600) + 0.5) * (hours * 3600)
    return start.cast("long"), F.round((seconds - start) / 3600).cast("long")


def byte_ranges(index: str, variables: set[str], levels: set[str]) -> list[tuple[int, int | None]]:
    """Ranges of the wanted records from an index text (number:offset:date:variable:level:...), last one open."""
    rows = [line.split(":") for line in index.splitlines() if line.count(":") >= 4]
    at = [int(r[1]) for r in rows]
    return [(at[k], at[k + 1] - 1 if k + 1 < len(rows) else None) for k, r in enumerate(rows) if r[3] in variables and r[4] in levels]


def rewrite_prefix(value, old: str, new: str):
    """A JSON value in which every string that begins with old begins with new instead."""
    if isinstance(value, str):
        return new + value[len(old) :] if value.startswith(old) else value
    if isinstance(value, list):
        return [rewrite_prefix(v, old, new) for v in value]
    if isinstance(value, dict):
        return {k: rewrite_prefix(v, old, new) for k, v in value.items()}
    return value
