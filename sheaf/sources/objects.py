"""Raw objects and questions as sources, extracted text and answers as sinks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.schemas import QUESTIONS


def read_objects(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files under ``root`` as ``(bucket, name, content, size, event_time)``.

    The folder itself stands for the bucket. Spark's file sources pass over empty
    files; ``contents_under`` starts from events and reports those.
    """
    return _as_objects(_files(spark.read, glob).load(root), root)


def stream_objects(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """New files under ``root`` as a stream of the same rows.

    The file source takes a path once. Where objects are overwritten, stream a
    table of upload events instead.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _as_objects(_files(spark.readStream.schema(schema), glob).load(root), root)


def _files(reader, glob: str):
    return (
        reader.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
    )


def _as_objects(files: DataFrame, root: str) -> DataFrame:
    folder = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    start = F.locate(folder, F.col("path")) + len(folder)
    return files.select(
        F.lit(folder.rstrip("/").rsplit("/", 1)[-1]).alias("bucket"),
        F.substring("path", start, F.length("path")).alias("name"),
        "content",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("event_time"),
    )


def contents_under(root: str, held_bytes: int = 32 << 20) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``content`` to events of objects stored under ``root``.

    Tasks open the files that their events name, by name, so nothing is listed, names may
    hold any characters, and a batch may have any size. Objects that are missing, empty
    or of another bucket get a null content. About ``held_bytes`` are held at once.
    """
    bucket = root.rstrip("/").rsplit("/", 1)[-1]

    def read(files: fs.FileSystem, base: str, of_bucket: str | None, name: str | None) -> bytes | None:
        if of_bucket != bucket or not name or ".." in name.split("/"):
            return None
        try:
            with files.open_input_stream(f"{base.rstrip('/')}/{name}", compression=None) as stream:
                return stream.read() or None
        except FileNotFoundError:
            return None

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            first, contents, size = 0, [], 0
            for i, named in enumerate(batch.select(["bucket", "name"]).to_pylist()):
                contents.append(read(files, base, named["bucket"], named["name"]))
                size += len(contents[-1] or b"")
                if size > held_bytes or i == batch.num_rows - 1:
                    part = batch.slice(first, len(contents))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(contents, pa.binary())], [*batch.schema.names, "content"]
                    )
                    first, contents, size = i + 1, [], 0

    return lambda events: events.mapInArrow(opened, events.select("*").schema.add("content", "binary"))


def split_empty(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects with content, and those without."""
    size = F.coalesce(F.length("content"), F.lit(0))
    return objects.filter(size > 0), objects.filter(size == 0)


def write_texts(texts: DataFrame, path: str) -> None:
    """Extracted text keyed by target name, replacing what ``path`` held."""
    texts.select("target_name", "text").write.mode("overwrite").parquet(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).json(path)


def write_answers(answers: DataFrame, path: str) -> None:
    answers.write.mode("overwrite").json(path)
