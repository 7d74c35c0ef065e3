"""File readers.  Unparsable and NaN values become NULL; a file's name and folder are data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sensorframe import schema
from sensorframe.functions.columns import finite, is_digits, parse_stamp, part, strip_blanks
from sensorframe.plans.scan import number_rows


def _plain(c: Column) -> Column:
    """Undo the URL form in which Spark reports paths (a plus sign is itself there)."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _folder_stamp() -> Column:
    """Name of the file's folder, or what follows ``stamp=`` in its path."""
    path = _plain(F.col("_metadata.file_path"))
    named = F.nullif(F.regexp_extract(path, r"/stamp=([^/]+)/", 1), F.lit(""))
    return F.coalesce(named, F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def _file_name() -> Column:
    return _plain(F.col("_metadata.file_name"))


def _loop_name() -> Column:
    """The file's name, or what follows ``loop=`` in its path."""
    named = F.nullif(F.regexp_extract(_plain(F.col("_metadata.file_path")), r"/loop=([^/]+)/", 1), F.lit(""))
    return F.coalesce(named, _file_name())


def _number(c: Column) -> Column:
    return finite(F.trim(c).try_cast("double"))


def _cells(lines: DataFrame) -> DataFrame:
    """Rows of ``(stamp, loop, line, text)``."""
    cells = lines.filter(F.trim("text") != "").withColumn("_c", F.split("text", "\t"))
    head = F.get("_c", F.lit(0))
    return cells.select(
        parse_stamp(F.col("stamp")).alias("ts"),
        "loop",
        F.col("line").cast("long").alias("line"),
        F.trim(part(head, ",", 1)).alias("span"),
        F.trim(part(head, ",", 2)).alias("beam"),
        _number(part(head, ",", 3)).alias("coord"),
        _number(F.get("_c", F.lit(1))).alias("strain"),
        _number(F.get("_c", F.lit(4))).alias("temp"),
        _number(F.get("_c", F.lit(5))).alias("distance"),
        strip_blanks(head).alias("position"),
    )


def parse_snapshots(files: DataFrame) -> DataFrame:
    """Rows of whole snapshot files given as ``(stamp, loop, value)``.

    A line is ``Span, Beam, Coord<TAB>strain<TAB>..<TAB>..<TAB>temp<TAB>distance``.
    """
    return _cells(files.select("stamp", "loop", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")))


def _chosen(files: DataFrame, loops: Sequence[str] | None, start: str | None, stop: str | None) -> DataFrame:
    """Only some loops and stamps; the condition reads file names alone, so other files are never opened."""
    if loops is not None:
        files = files.filter(_loop_name().isin(list(loops)))
    if start is not None:
        files = files.filter(_folder_stamp() >= start)
    if stop is not None:
        files = files.filter(_folder_stamp() <= stop)
    return files


def _snapshot_files(reader, root: str, loops: Sequence[str] | None) -> DataFrame:
    """Whole files of a stream; each is one snapshot of one loop."""
    files = _chosen(reader.option("recursiveFileLookup", "true").text(root, wholetext=True), loops, None, None)
    return files.select(_folder_stamp().alias("stamp"), _loop_name().alias("loop"), "value")


def _snapshot_lines(
    spark: SparkSession, root: str, loops: Sequence[str] | None, start: str | None = None, stop: str | None = None
) -> DataFrame:
    """``(stamp, loop, line, text)``: lines of all snapshot files, numbered from 0 in each file.

    Files are read by line, so a large one is cut into several tasks; numbers come from counts per block of a file.
    """
    files = _chosen(spark.read.option("recursiveFileLookup", "true").text(root), loops, start, stop)
    lines = files.select(
        _folder_stamp().alias("stamp"),
        _loop_name().alias("loop"),
        F.col("value").alias("text"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return number_rows(lines, ["stamp", "loop"], ["_line"], "_block", out="line").drop("_block", "_line")


def read_raw_readings(
    spark: SparkSession, root: str, loops: Sequence[str] | None = None, start: str | None = None, stop: str | None = None
) -> DataFrame:
    """Readings of the snapshot files ``<root>/<stamp>/<loop>`` or ``<root>/stamp=<stamp>/loop=<loop>/*``.

    ``start`` and ``stop`` are 14-digit stamps, both included.
    """
    return _cells(_snapshot_lines(spark, root, loops, start, stop))


def read_distribution_values(spark: SparkSession, root: str, loop: str) -> DataFrame:
    """Second whitespace-separated token of every line but the first."""
    lines = _snapshot_lines(spark, root, [loop]).withColumn("ts", parse_stamp(F.col("stamp")))
    token = F.try_element_at(F.split(F.trim("text"), r"\s+"), F.lit(2))
    return lines.filter((F.col("line") > 0) & (F.trim("text") != "")).select("ts", "line", _number(token).alias("value"))


def read_series_csv(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.csv`` of a folder as readings; the sensor is the file name without its ending, or what follows ``sensor=`` in the path.

    ``rn`` is the position in the file, also of rows whose time cannot be read.  Files are numbered by
    block, so a long one is never sorted in one task.
    """
    reader = spark.read.schema(schema.SERIES_FILE).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true")
    named = F.nullif(F.regexp_extract(_plain(F.col("_metadata.file_path")), r"/sensor=([^/]+)/", 1), F.lit(""))
    rows = reader.csv(folder, header=True).select(
        F.coalesce(named, F.regexp_replace(_file_name(), r"\.csv$", "")).alias("sensor"),
        F.col("Time_index").alias("time_index"),
        F.try_to_timestamp(F.col("Time")).alias("time"),
        _number(F.col("Strain")).alias("strain"),
        _number(F.col("Temperature")).alias("temperature"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return number_rows(rows, ["sensor"], ["_line"], "_block").drop("_block", "_line")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """``start end loop span, beam, coord col`` per line; times stay text, the position has no blanks."""
    t = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(
        F.get(t, F.lit(0)).alias("start"),
        F.get(t, F.lit(1)).alias("end"),
        F.get(t, F.lit(2)).alias("loop"),
        strip_blanks(F.array_join(F.slice(t, 4, 3), "")).alias("position"),
        F.get(t, F.lit(6)).alias("col"),
    )


def read_name_list(spark: SparkSession, path: str, digits_only: bool = False) -> DataFrame:
    names = spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''")
    return names.filter(is_digits(F.col("name"))) if digits_only else names


def read_file_listing(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("stamp string, file_name string").csv(path)
    return rows.select(parse_stamp(F.col("stamp")).alias("ts"), "file_name")


def read_alarm_texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Whole alarm files (Latin-1) called ``name``, one per snapshot folder ``<stamp>`` or ``stamp=<stamp>``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    return files.load(root).select(
        parse_stamp(F.regexp_extract("path", r"(?:stamp=)?([^/=]+)/[^/]+$", 1)).alias("ts"),
        F.decode("content", "ISO-8859-1").alias("text"),
    )


def distribution_headers(spark: SparkSession, path: str) -> list[str]:
    """Header texts of a wide matrix file; repeats get ``.1``, ``.2``, ... appended."""
    seen: dict[str, int] = {}
    names = []
    for name in spark.read.text(path).first()[0].split(","):
        name = name.strip().strip('"')
        seen[name] = seen.get(name, -1) + 1
        names.append(name if not seen[name] else f"{name}.{seen[name]}")
    return names


def read_distribution_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Wide matrix file as ``(timestamp, profile)`` rows and the ``(pos, header)`` coordinates."""
    names = distribution_headers(spark, path)
    layout = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = spark.read.schema(layout).csv(path, header=True)
    profile = F.array(*[_number(F.col(f"c{i}")) for i in range(1, len(names))])
    coords = spark.createDataFrame(list(enumerate(names)), "pos long, header string")
    return rows.select(F.col("c0").alias("timestamp"), profile.alias("profile")), coords


def select_coords(matrix: DataFrame, kept: DataFrame) -> DataFrame:
    """Profiles reduced to the coordinates in ``kept`` (see ``filters.filter_coords``)."""
    positions = [r[0] for r in kept.filter("pos > 0").select("pos").orderBy("pos").collect()]
    return matrix.withColumn("profile", F.array(*[F.get("profile", F.lit(int(p) - 1)) for p in positions]))


def read_threshold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.THRESHOLD).json(path)
