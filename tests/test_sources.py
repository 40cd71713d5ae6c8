"""Recorded frames that are replayed, pages that are pruned, archives that break."""

import io
import os
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.sources import archives, frames, pages
from quantloom.sources.connectors import BARS

START = datetime(2024, 1, 1)


def write(path, text, mode="a"):
    with open(path, mode) as f:
        f.write(text)


def started(spark, log, root, name, most="40"):
    frames.register(spark)
    stream = spark.readStream.format("recorded_frames").option("path", str(log)).option("partitionBytes", most).load()
    return stream.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/{name}-checkpoint").trigger(availableNow=True).start()


def read_frames(spark, root, name="out"):
    return [r.frame for r in spark.read.parquet(f"{root}/{name}").orderBy("segment", "at").collect()]


def test_a_restarted_stream_loses_and_repeats_no_frame(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    write(log / "s1", "".join(f"frame {i}\n" for i in range(100)) + "half")
    started(spark, log, tmp_path, "out").awaitTermination()
    assert read_frames(spark, tmp_path) == [f"frame {i}" for i in range(100)]
    write(log / "s1", " and half\n\nünï\n")
    write(log / "s2", "one\ntw")
    started(spark, log, tmp_path, "out").awaitTermination()
    write(log / "s2", "o")  # sealed without an end of line
    write(log / "s3", "three\n")
    started(spark, log, tmp_path, "out").awaitTermination()
    started(spark, log, tmp_path, "out").awaitTermination()
    assert read_frames(spark, tmp_path) == [*(f"frame {i}" for i in range(100)), "half and half", "ünï", "one", "two", "three"]


def test_a_batch_that_fails_is_read_again_alike(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    write(log / "s1", "a\nb\nc\n")
    frames.register(spark)
    taken, broken = [], [True]

    def keep(df, number):
        rows = [r.frame for r in df.orderBy("segment", "at").collect()]
        if broken[0]:
            broken[0] = False
            write(log / "s1", "d\n")  # comes after the batch was planned
            raise ValueError("lost")
        taken.append(rows)

    def run():
        stream = spark.readStream.format("recorded_frames").option("path", str(log)).load()
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    run()
    assert taken == [["a", "b", "c"], ["d"]]


def test_frames_as_a_table(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    lines = [f"{'x' * (i % 7)}|{i}" for i in range(50)]
    write(log / "s1", "\n".join(lines) + "\n")
    frames.register(spark)
    for most in ("1", "3", "17", "100000"):
        df = spark.read.format("recorded_frames").option("path", str(log)).option("partitionBytes", most).load()
        assert [r.frame for r in df.orderBy("at").collect()] == lines
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("recorded_frames").load().collect()
    assert frames.tick_rows(df).where("error = 'ignored'").count() == 50


def counted():
    """A feed that leaves a mark for each page that is fetched."""

    class Counted(pages.Archive):
        def page(self, symbol, before):
            os.makedirs(f"{self.path}/../fetched", exist_ok=True)
            with open(f"{self.path}/../fetched/{symbol}-{before}".replace(":", ""), "a") as f:
                f.write("x")
            return pages.Archive.page(self, symbol, before)

    return Counted  # workers can't import a test's module, but take a class in a function along


def bars(spark, n=1000, symbols="AB"):
    rows = [(s, START + timedelta(hours=i), 1.0, 2.0, 0.5, float(i), i, "unadjusted", i) for s in symbols for i in range(n)]
    return spark.createDataFrame(rows, BARS)


def fetched(tmp_path):
    found = tmp_path / "fetched"
    n = sum(len((found / f).read_text()) for f in os.listdir(found)) if found.exists() else 0
    for f in os.listdir(found) if found.exists() else ():
        (found / f).unlink()
    return n


def test_filters_decide_which_pages_are_fetched(spark, tmp_path):
    root = str(tmp_path / "pages")
    pages.write_pages(bars(spark), root, 100)
    pages.register(spark, "counted_bars", counted())
    df = spark.read.format("counted_bars").option("path", root).load()
    want = bars(spark)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(df, want)
    assert fetched(tmp_path) == 20
    late = f"ts >= timestamp_ntz'{START + timedelta(hours=850)}'"
    for condition, most in (("symbol = 'A'", 10), (late, 4), (f"symbol = 'B' and {late}", 2), (f"symbol in ('B', 'Z') and ts < timestamp_ntz'{START + timedelta(hours=150)}'", 2), (f"symbol = 'A' and ts = timestamp_ntz'{START + timedelta(hours=500)}'", 1), ("symbol = 'Z'", 0), (f"ts > timestamp_ntz'{START + timedelta(hours=999)}' and ts < timestamp_ntz'{START}'", 0), ("close = 7 and symbol = 'A'", 10)):
        assert same(df.where(condition), want.where(condition))
        assert fetched(tmp_path) <= most, condition
    got = pages.last_bars(spark, root, "A", 150, "counted_bars").collect()
    assert [r.close for r in got] == [float(i) for i in range(850, 1000)]


def test_ranges_of_time_are_read_apart(spark, tmp_path):
    class Known(pages.Archive):
        def span(self, symbol):
            return START, START + timedelta(hours=999)

    root = str(tmp_path / "pages")
    pages.write_pages(bars(spark), root, 64)
    pages.register(spark, "known_bars", Known)
    df = spark.read.format("known_bars").option("path", root).option("slices", "5").option("symbols", "B").load()
    assert df.rdd.getNumPartitions() == 5
    assert sorted(r.close for r in df.collect()) == [float(i) for i in range(1000)]


def test_cursors_that_stand_or_repeat_end_the_walk():
    row = lambda i: ("A", START + timedelta(hours=i), 1.0, 1.0, 1.0, 1.0, 1, "x", i)

    class Stuck(pages.Feed):
        def symbols(self):
            return ["A"]

        def page(self, symbol, before):
            if before is None:
                return [row(5), row(6)], START + timedelta(hours=6)
            return [row(4), row(5)], START + timedelta(hours=6)

    reader = pages.PagedReader(Stuck(), {})
    (part,) = reader.partitions()
    assert [r[8] for r in reader.read(part)] == [6, 5, 4]


ENTRY = "<list><corp_code>{}</corp_code><corp_name> n{} </corp_name><stock_code>{}</stock_code><modify_date>20240101</modify_date></list>"


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


def test_catalogue_of_sound_and_broken_archives(spark, tmp_path):
    many = "".join(ENTRY.format(i, i, f"{i:06d}" if i % 3 else " ") for i in range(5000))
    good = zipped([("a.txt", "x"), ("CORPCODE.XML", f"<?xml version='1.0'?><result>\n{many}{ENTRY.format(9, 'new', '000001')}<list></list><lists/></result>")])
    spoiled = bytearray(good)
    spoiled[len(good) // 2] ^= 255
    found = {"good": good, "spoiled": bytes(spoiled), "cut": good[:-30], "junk": b"no zip", "none": zipped([("a.txt", "<list/>")]), "open": zipped([("a.xml", ENTRY.format(1, 1, "000007") + "<list><corp_code>")]), "latin": zipped([("a.xml", "<list><corp_name>ü</corp_name></list>".encode("latin-1"))]), "torn": zipped([("a.xml", "<list><corp_code>1</list>" + ENTRY.format(2, 2, "000002"))])}
    for name, body in found.items():
        (tmp_path / f"{name}.zip").write_bytes(body)
    codes, errors = archives.catalogue(archives.read_zipped(spark, str(tmp_path), "list"))
    name = F.regexp_extract("archive", r"([^/]+)\.zip$", 1)
    got = {}
    for r in codes.withColumn("archive", name).collect():
        got.setdefault(r.archive, {})[r.stock_code] = (r.corp_code, r.corp_name)
    want = {f"{i:06d}": (str(i), f"n{i}") for i in range(5000) if i % 3} | {"000001": ("9", "nnew")}
    assert got == {"good": want, "open": {"000007": ("1", "n1")}, "torn": {"000002": ("2", "n2")}}
    bad = {r.archive: r.error for r in errors.withColumn("archive", name).collect() if r.archive != "good"}
    assert set(bad) == {"spoiled", "cut", "junk", "none", "open", "latin", "torn"}
    assert bad["none"] == "no member .xml" and bad["open"] == "bad member: record without an end" and bad["latin"] == "bad member: not UTF-8" and bad["torn"] == "bad record"


def test_archives_without_content(spark):
    rows = spark.createDataFrame([("a", bytearray()), ("b", None)], "path string, content binary")
    assert [(r.archive, r.error) for r in archives.zipped_records(rows, "list").collect()] == [("a", "bad archive: BadZipFile"), ("b", "bad archive: BadZipFile")]


def test_elements_over_any_blocks():
    body = b"<r><list a='1'><x>1</x></list><listing/><list><x>2</x></list ></r>"
    for n in (1, 2, 5, 100):
        assert list(archives.elements((body[i : i + n] for i in range(0, len(body), n)), "list")) == [b"<list a='1'><x>1</x></list>", b"<list><x>2</x></list >"]
    with pytest.raises(ValueError, match="too long"):
        list(archives.elements(iter([b"<list>", b"x" * (archives.MOST_RECORD + 1)]), "list"))


def test_zip_that_is_written_is_read(spark, tmp_path):
    rows = spark.createDataFrame([("a", "m.xml", i, f"<list><corp_code>{i}</corp_code><stock_code>s{i}</stock_code></list>") for i in range(300)] + [("b", "m.xml", 0, None)], "archive string, member string, seq long, element string")
    root = f"{tmp_path}/z"
    archives.write_zipped(rows, root)
    codes, errors = archives.catalogue(archives.read_zipped(spark, root, "list"))
    assert sorted(r.corp_code for r in codes.collect()) == sorted(str(i) for i in range(300)) and errors.count() == 0
