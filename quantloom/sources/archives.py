"""Zipped XML as a source: records of members, a broken one as a row of its error."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources.shared import opened, ship

BLOCK, MOST_RECORD, ROWS = 1 << 16, 1 << 20, 4096
RECORD = "archive string, member string, ordinal long, record string, error string"
#: Fixed fields of a record of the code catalogue.
CODES = "corp_code string, corp_name string, stock_code string, modify_date string"


def elements(blocks: Iterator[bytes], tag: str) -> Iterator[bytes]:
    """The elements of one name, whole, from blocks of XML; it holds one element and
    one block. Elements of a name don't nest."""
    name = re.escape(tag.encode())
    begins, ends = re.compile(rb"<" + name + rb"(?=[\s>])"), re.compile(rb"</" + name + rb"\s*>")
    held, inside = b"", False
    for block in blocks:
        held += block
        while True:
            if not inside:
                found = begins.search(held)
                if found is None:
                    held = held[-len(tag) - 2 :]
                    break
                held, inside = held[found.start() :], True
            found = ends.search(held)
            if found is None:
                if len(held) > MOST_RECORD:
                    raise ValueError("record too long")
                break
            yield held[: found.end()]
            held, inside = held[found.end() :], False
    if inside:
        raise ValueError("record without an end")


def blocks_of(archive: zipfile.ZipFile, member: str) -> Iterator[bytes]:
    with archive.open(member) as f:
        while block := f.read(BLOCK):
            yield block


def records_of(content: bytes, tag: str, suffix: str) -> Iterator[tuple]:
    """(member, ordinal, record, error) of an archive's first member of the suffix.
    The member is read once through before, against its checksum, so that a
    damaged one gives its error and nothing else."""
    member = None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            member = next((n for n in archive.namelist() if n.lower().endswith(suffix)), None)
            if member is None:
                yield None, None, None, f"no member {suffix}"
                return
            for _ in blocks_of(archive, member):
                pass
            for k, found in enumerate(elements(blocks_of(archive, member), tag)):
                yield member, k, found.decode("utf-8"), None
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
        yield member, None, None, f"bad archive: {type(e).__name__}"
    except ValueError as e:
        yield member, None, None, f"bad member: {e if not isinstance(e, UnicodeDecodeError) else 'not UTF-8'}"


def zipped_records(archives: DataFrame, tag: str, suffix: str = ".xml") -> DataFrame:
    """archive, member, ordinal, record, error: the elements `tag` of the first
    member with the suffix of each archive (path, content), in order.

    An archive that is broken, holds no such member, or whose member fails its
    checksum, isn't UTF-8 or ends within a record, gives one row with the error; of
    the last kind the whole records before come too. Null content is a broken
    archive. Memory: an archive's bytes as stored and one record.
    """
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["archive", "member", "ordinal", "record", "error"]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for found in records_of(content.as_py() or b"", tag, suffix):
                    rows.append((path.as_py(), *found))
                    if len(rows) >= ROWS:
                        yield give(rows)
                        rows = []
                if rows:
                    yield give(rows)

    return archives.select("path", "content").mapInArrow(run, RECORD)


def read_zipped(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The records of all archives (*.zip) under a path. Spark plans no read of a file
    without a byte, so such a one gives no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return zipped_records(files, tag)


def catalogue(records: DataFrame, latest: bool = True) -> tuple[DataFrame, DataFrame]:
    """(codes, errors) of the records of code catalogues: archive, stock_code,
    corp_code, corp_name, trimmed; entries without a stock code or a corporation
    code are left out, and of those with one stock code the last of the archive
    counts, or all of them do (latest=False). errors: archive, member, error, a row an archive that could not be read
    and a row a record that is no XML."""
    fields = F.from_xml("record", CODES, {"mode": "PERMISSIVE"})
    parsed = records.select("archive", "member", "ordinal", "error", "record", fields.alias("f"))
    text = lambda c: F.trim(F.coalesce(F.col(f"f.{c}"), F.lit("")))
    rows = parsed.where("error is null").select("archive", "ordinal", text("stock_code").alias("stock_code"), text("corp_code").alias("corp_code"), text("corp_name").alias("corp_name"))
    codes = rows.where("stock_code != '' and corp_code != ''")
    if latest:
        last = codes.groupBy("archive", "stock_code").agg(F.max_by(F.struct("corp_code", "corp_name"), "ordinal").alias("c"))
        codes = last.select("archive", "stock_code", "c.*")
    torn = F.col("error").isNull() & F.col("f.corp_code").isNull() & F.col("f.stock_code").isNull() & F.col("f.corp_name").isNull() & F.col("f.modify_date").isNull()
    errors = parsed.select("archive", "member", F.when(torn, "bad record").otherwise(F.col("error")).alias("error")).where("error is not null")
    return codes.select("archive", "stock_code", "corp_code", "corp_name"), errors


def write_zipped(rows: DataFrame, path: str) -> None:
    """Stores rows (archive, member, seq, element) as <archive>.zip, a member each,
    its elements by seq within <result>. Elements are streamed into the archive: a
    task holds one batch, and on disk one archive."""
    ship(rows.sparkSession)
    line = rows.select("archive", "member", "seq", "element").repartition("archive").sortWithinPartitions("archive", "member", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(path)
        files.create_dir(root)
        token = uuid.uuid4().hex
        now: list = [None, None, None, None]  # archive, member, file, zip

        def close_member() -> None:
            if now[1] is not None:
                now[1][1].write(b"</result>")
                now[1][1].close()
                now[1] = None

        def close_archive() -> None:
            close_member()
            if now[0] is not None:
                now[3].close()
                now[2].seek(0)
                # one rename makes the archive seen: a task that is run again replaces it whole
                with files.open_output_stream(f"{root}/.{now[0]}-{token}.part") as out:
                    while block := now[2].read(BLOCK):
                        out.write(block)
                files.move(f"{root}/.{now[0]}-{token}.part", f"{root}/{now[0]}.zip")
                now[2].close()
                now[0] = None

        for batch in batches:
            for archive, member, _, element in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != now[0]:
                    close_archive()
                    file = tempfile.TemporaryFile()
                    now[:] = [archive, None, file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)]
                if now[1] is None or now[1][0] != member:
                    close_member()
                    now[1] = (member, now[3].open(member, "w"))
                    now[1][1].write(b'<?xml version="1.0" encoding="UTF-8"?><result>')
                now[1][1].write((element or "").encode())
        close_archive()
        yield from ()

    line.mapInArrow(run, "archive string").count()
