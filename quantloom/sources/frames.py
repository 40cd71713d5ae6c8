"""A push feed as a stream: frames recorded line by line in segment files.

A receiver appends each frame that it is sent to the newest segment of a folder
and now and then begins the next. The source reads the folder. Its offset is a
segment and a byte, so whatever is planned again after a failure is read again
alike: with Spark's checkpoint no frame is lost and none comes twice.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quantloom.sources import feeds
from quantloom.sources.shared import opened, ship

FRAMES = "segment string, at bigint, frame string"
PARTITION_BYTES, BLOCK = 64 << 20, 1 << 16


class Range(InputPartition):
    """The lines of a segment that begin from start to before end."""

    def __init__(self, segment: str, start: int, end: int):
        super().__init__((segment, start, end))


class Segments:
    """A folder of segments, in order of their names; all but the last are whole."""

    def __init__(self, options):
        if "path" not in options:
            raise ValueError("recorded_frames needs a path")
        self.path = options["path"]
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        if self.most < 1:
            raise ValueError("partitionBytes must be positive")

    def sizes(self) -> list[tuple[str, int]]:
        files, root = opened(self.path)
        found = files.get_file_info(filesystems.FileSelector(root, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")))

    def whole(self, segment: str, size: int) -> int:
        """The end of the last whole line of a segment's first size bytes."""
        files, root = opened(self.path)
        with files.open_input_file(f"{root}/{segment}") as f:
            while size > 0:
                start = max(0, size - BLOCK)
                f.seek(start)
                cut = f.read(size - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                size = start
        return 0

    def end(self) -> dict:
        """Behind the last whole line that there is."""
        found = self.sizes()
        return {"segment": found[-1][0], "byte": self.whole(*found[-1])} if found else {"segment": "", "byte": 0}

    def ranges(self, start: dict, end: dict) -> list[Range]:
        out = []
        for segment, size in self.sizes():
            if start["segment"] <= segment <= end["segment"]:
                a = start["byte"] if segment == start["segment"] else 0
                b = end["byte"] if segment == end["segment"] else size
                out += [Range(segment, x, min(x + self.most, b)) for x in range(a, b, self.most)]
        return out

    def lines(self, part: Range) -> Iterator[tuple]:
        """(segment, byte, frame) of a range; bytes that are no UTF-8 are replaced."""
        segment, start, end = part.value
        files, root = opened(self.path)
        with files.open_input_file(f"{root}/{segment}") as f:
            at = max(0, start - 1)
            f.seek(at)
            rest = b""
            skip = start > 0  # the line that holds the byte before start belongs to that
            while True:
                block = f.read(BLOCK)
                rest += block
                *whole, rest = rest.split(b"\n")
                if not block and rest:
                    whole, rest = [rest], b""
                for line in whole:
                    if skip:
                        skip = False
                    elif at < end:
                        if line:
                            yield segment, at, line.decode("utf-8", "replace")
                    else:
                        return
                    at += len(line) + 1
                if at >= end or not block:
                    return


class FramesReader(DataSourceReader):
    def __init__(self, options):
        self.log = Segments(options)

    def partitions(self):
        return self.log.ranges({"segment": "", "byte": 0}, self.log.end())

    def read(self, partition):
        return self.log.lines(partition)


class FramesStream(DataSourceStreamReader):
    def __init__(self, options):
        self.log = Segments(options)

    def initialOffset(self) -> dict:
        return {"segment": "", "byte": 0}

    def latestOffset(self) -> dict:
        return self.log.end()

    def partitions(self, start: dict, end: dict):
        return self.log.ranges(start, end)

    def read(self, partition):
        return self.log.lines(partition)


class RecordedFrames(DataSource):
    """Options: path of the folder, partitionBytes. A row a line; empty ones are
    left out, and an unfinished last line waits until it is whole."""

    @classmethod
    def name(cls) -> str:
        return "recorded_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> FramesReader:
        return FramesReader(self.options)

    def streamReader(self, schema) -> FramesStream:
        return FramesStream(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RecordedFrames)


def record(frames: DataFrame, frame: str, order: list, path: str) -> None:
    """Writes frames as segments, one a task, in order across them."""
    frames.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(frame).alias("value")).write.mode("append").text(path)


def tick_rows(recorded: DataFrame) -> DataFrame:
    """segment, at and the records of each sound frame; a frame that isn't sound
    is one row with its error."""
    parsed = feeds.frames(recorded)
    sound = feeds.ticks(parsed, ["segment", "at"]).withColumn("error", F.lit(None).cast("string"))
    return sound.unionByName(parsed.where("error is not null").select("segment", "at", "feed", "error"), allowMissingColumns=True)
