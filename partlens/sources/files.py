"""Files in and out: listings, images, settings, archives."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.schemas import FRAMES

# Fixed value: names of image files.
IMAGE_NAME = r"^.+\.(gif|png|jpg|jpeg|tif|tiff)$"


def list_files(spark: SparkSession, folder: str, pattern: str | None = IMAGE_NAME, depth: int | None = None) -> DataFrame:
    """Path, length, modificationTime of the files below a folder whose names match; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    if pattern is not None:
        df = df.where(F.element_at(F.split("path", "/"), -1).rlike(pattern))
    if depth is not None:
        base = len(folder.split("://")[-1].rstrip("/").split("/"))
        df = df.where(F.size(F.split(F.regexp_replace("path", "^[a-z]+:/*", "/"), "/")) - base <= depth)
    return df


def filter_files(df: DataFrame, text: str, keep: bool = True) -> DataFrame:
    """Names that contain a text, or do not."""
    has = F.contains(F.col("path"), F.lit(text))
    return df.where(has if keep else ~has)


#: Fixed value: side of the blank that stands for what cannot be decoded.
BLANK = 50


def image_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images of the files below a folder; what cannot be decoded comes as a blank of 50 by 50 with bad = true."""
    df = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{gif,png,jpg,jpeg,tif,tiff,bmp}").load(folder)
    bad = F.coalesce(F.col("image.width") < 0, F.lit(True))
    side = lambda c: F.when(bad, BLANK).otherwise(F.col(f"image.{c}")).alias(c)
    blank = F.unhex(F.repeat(F.lit("00"), BLANK * BLANK))
    return df.select("image.origin", side("width"), side("height"), F.when(bad, 1).otherwise(F.col("image.nChannels")).alias("nChannels"), F.when(bad, blank).otherwise(F.col("image.data")).alias("data"), bad.alias("bad"))


def pixels_from_binary(images: DataFrame) -> DataFrame:
    """Cells of decoded images, origin as grid: the first channel's byte is the gray value."""
    at = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1))
    byte = F.conv(F.hex(F.substring("data", F.col("i") * F.col("nChannels") + 1, F.lit(1))), 16, 10).cast("int")
    df = images.select("origin", "bad", "width", "nChannels", "data", at.alias("i"))
    return df.select("origin", "bad", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), byte.alias("v"))


def _little(n: Column | int, bytes_: int = 4) -> Column:
    """A number as hexadecimal bytes, the smallest first."""
    h = F.lpad(F.hex(F.lit(n) if isinstance(n, int) else n.cast("long")), 2 * bytes_, "0")
    return F.concat(*[F.substring(h, 2 * i - 1, 2) for i in range(bytes_, 0, -1)])


def encode_bitmaps(cells: DataFrame, *more: str) -> DataFrame:
    """grid_id, content: each grid (cells from 0, without holes) as the bytes of an uncompressed bitmap of 24 bits a cell,
    put together by built-in functions; ``more`` columns that a grid has once come along. A grid is as large as its one payload."""
    gray = F.repeat(F.lpad(F.hex("v"), 2, "0"), 3)
    rows = cells.groupBy("grid_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", gray.alias("h")))).alias("r"), *[F.max(m).alias(m) for m in more])
    pad = F.repeat(F.lit("00"), F.pmod(-3 * F.size("r"), F.lit(4)))
    rows = rows.select("grid_id", "y", *more, F.size("r").alias("w"), F.concat(F.array_join("r.h", ""), pad).alias("h"))
    one = rows.groupBy("grid_id").agg(F.max("w").alias("w"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("y", "h")), asc=False).alias("r"), *[F.max(m).alias(m) for m in more])
    body = F.array_join("r.h", "")
    size = F.length(body) / 2
    # The format's header (magic, sizes, one plane of 24 bits, no compression)
    head = [F.lit("424D"), _little(size + 54), _little(0), _little(54), _little(40), _little(F.col("w")), _little(F.col("n")), _little(1, 2), _little(24, 2), _little(0), _little(size), *[_little(0)] * 4]
    return one.select("grid_id", *more, F.unhex(F.concat(*head, body)).alias("content"))


def save_frames(frames: DataFrame, folder: str) -> None:
    """A file for each row (name, content) below a folder that all executors can write to. A file is written beside its
    place and moved there, so a repeated task leaves whole files only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa_fs.FileSystem.from_uri(folder)
        n, made = 0, set()
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                above, file = f"{root}/{name}".rsplit("/", 1)
                if above not in made:
                    fs.create_dir(above, recursive=True)
                    made.add(above)
                part = f"{above}/.{file}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(content.as_buffer() or b"")
                fs.move(part, f"{above}/{file}")
                n += 1
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    frames.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def pixels_from_array(df: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """Cells of a flat array of values."""
    e = df.select(F.col(key).alias("grid_id"), F.posexplode(column).alias("pos", "v"))
    return e.select("grid_id", (F.col("pos") % width).alias("x"), F.floor(F.col("pos") / width).cast("int").alias("y"), "v")


def settings_lines(settings: DataFrame) -> DataFrame:
    """key=value lines in order."""
    return settings.select("line_no", F.concat_ws("=", "key", "value").alias("text"))


def save_settings(settings: DataFrame, path: str, comment: str) -> None:
    """The lines as text, the header as a line of its own first; one sorted write in ranges of line_no."""
    head = settings.sparkSession.createDataFrame([(-1, f"# {comment}")], "line_no long, text string")
    head.unionByName(settings_lines(settings)).orderBy("line_no").select("text").write.mode("overwrite").text(path)


def frame_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Frames as they arrive in a folder, with the camera from their path."""
    df = spark.readStream.format("binaryFile").schema(FRAMES).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).load(folder)
    return df.withColumn("camera_id", F.regexp_extract("path", r"camera=([^/]+)", 1))


#: Settings of frame streams whose files are many and small: a trigger's files are looked up by the driver instead of a task
#: each, they share tasks by their bytes, and the log of files that were seen is merged every hundredth trigger, not every tenth.
SMALL_FILES = {
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "1000",
    "spark.sql.files.minPartitionNum": "1",
    "spark.sql.files.openCostInBytes": "65536",
    "spark.sql.streaming.fileSource.log.compactInterval": "100",
}


def camera_folders(folder: str) -> list[str]:
    """Names of the cameras' folders (camera=...) in a folder."""
    fs, root = pa_fs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pa_fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pa_fs.FileType.Directory and f.base_name.startswith("camera="))


def archive(df: DataFrame, path: str, *partition: str, mode: str = "append") -> None:
    """Results laid out by part, run and camera; rows of a folder are gathered first, so it holds few files."""
    df.repartition(*partition).write.mode(mode).partitionBy(*partition).parquet(path)


def save_results(df: DataFrame, path: str) -> None:
    """Detections as JSON lines."""
    df.write.mode("append").json(path)


def is_empty_frame(content: Column) -> Column:
    """A payload of no bytes."""
    return content.isNull() | (F.length(content) == 0)
