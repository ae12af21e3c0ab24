"""Grids as text: climate classes from CSV, ASCII grids out; and the stores of the analysis."""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_classes(spark: SparkSession, path: str, missing: int = -9999, sheet: str = "map") -> DataFrame:
    """lat_idx, lon_idx, class from a sheet with a line for each row of the grid; the missing code becomes null.

    path: a workbook (.xlsx), of which the named sheet is read, its first cell with a number being the first of the
    grid; or the sheet as CSV, in one file.
    """
    if path.endswith(".xlsx"):
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_sheet_reader(sheet, missing), "lat_idx int, lon_idx int, class int")
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.length(x) > 0)).alias("lat_idx", "line"))
    cells = raw.select("lat_idx", F.posexplode(F.split("line", ",")).alias("lon_idx", "v"))
    return cells.select("lat_idx", "lon_idx", F.nullif(F.expr("try_cast(v AS double)").cast("int"), F.lit(missing)).alias("class"))


def _sheet_reader(sheet: str, missing: int):
    def numbers(content: bytes) -> list[tuple[int, int, float]]:
        """Row, column and value of every cell of the sheet that holds a number."""
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            tag = lambda e: e.tag.rpartition("}")[2]
            named = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if tag(e) == "sheet" and e.get("name") == sheet]
            if not named:
                raise ValueError(f"the workbook has no sheet {sheet}")
            link = next(v for k, v in named[0].attrib.items() if k.endswith("}id"))
            target = next(e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter() if e.get("Id") == link)
            out, row, column = [], -1, -1
            with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
                for event, e in ElementTree.iterparse(f, events=("start", "end")):
                    if tag(e) == "row" and event == "start":
                        row, column = int(e.get("r", row + 2)) - 1, -1
                    elif tag(e) == "row":
                        e.clear()
                    elif tag(e) == "c" and event == "end":
                        letters = (e.get("r") or "").rstrip("0123456789")
                        column = functools.reduce(lambda n, c: 26 * n + ord(c) - 64, letters, 0) - 1 if letters else column + 1
                        value = next((x.text for x in e if tag(x) == "v"), None)
                        if value is not None and e.get("t", "n") == "n":
                            out.append((row, column, float(value)))
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                found = numbers(content)
                known = {(r, c): None if int(v) == missing else int(v) for r, c, v in found}
                top, left = (min((x[i] for x in found), default=0) for i in range(2))
                bottom, right = (max((x[i] for x in found), default=-1) for i in range(2))
                cells = [(r, c) for r in range(top, bottom + 1) for c in range(left, right + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r - top for r, _ in cells], pa.int32()), pa.array([c - left for _, c in cells], pa.int32()), pa.array([known.get(x) for x in cells], pa.int32())], ["lat_idx", "lon_idx", "class"])

    return run


def dense(df: DataFrame, value: str, n_lat: int, n_lon: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each cell of the grid (and each combination of keys in df), null where df has none."""
    names = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    cells = names.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(n_lat * n_lon - 1))))
    grid = cells.select(*keys, F.floor(F.col("_cell") / n_lon).cast("int").alias("lat_idx"), (F.col("_cell") % n_lon).cast("int").alias("lon_idx"))
    return grid.join(df.select(*keys, "lat_idx", "lon_idx", value), [*keys, "lat_idx", "lon_idx"], "left")


def ascii_rows(df: DataFrame, value: str, n_lat: int, n_lon: int, keys: tuple[str, ...] = (), no_data: str = "-9999", decimals: int = 6, north_first: bool = True) -> DataFrame:
    """keys, row, line: the lines of an ASCII grid, the first one at the top. Rows of df count from the south."""
    filled = dense(df, value, n_lat, n_lon, keys)
    text = F.when(F.col(value).isNotNull(), F.format_string(f"%.{decimals}f", F.col(value))).otherwise(F.lit(no_data))
    lines = filled.groupBy(*keys, "lat_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lon_idx", text.alias("v")))), lambda x: x["v"]), " ").alias("line"))
    row = F.lit(n_lat - 1) - F.col("lat_idx") if north_first else F.col("lat_idx")
    return lines.select(*keys, row.alias("row"), "line")


def header(n_lat: int, n_lon: int, x0: float = -180.0, y0: float = -90.0, size: float = 0.5, no_data: str = "-9999") -> list[str]:
    return [f"ncols {n_lon}", f"nrows {n_lat}", f"xllcorner {x0:g}", f"yllcorner {y0:g}", f"cellsize {size:g}", f"NODATA_value {no_data}"]


def write_ascii(df: DataFrame, value: str, path: str, n_lat: int, n_lon: int, **options) -> None:
    """One grid as one text file in folder path: at most a line for each row of the grid goes through the one task."""
    head = {k: options[k] for k in ("x0", "y0", "size", "no_data") if k in options}
    body = {k: options[k] for k in ("no_data", "decimals", "north_first") if k in options}
    spark = df.sparkSession
    top = spark.createDataFrame([(i - 100, x) for i, x in enumerate(header(n_lat, n_lon, **head))], "row int, line string")
    top.unionByName(ascii_rows(df, value, n_lat, n_lon, **body)).coalesce(1).sortWithinPartitions("row").select("line").write.mode("overwrite").text(path)


def map_lines(df: DataFrame, metrics: tuple[str, ...], n_lat: int, n_lon: int, keys: tuple[str, ...], **options) -> DataFrame:
    """map (keys and metric), row, line: a grid with its header for each combination of keys and each metric."""
    head = {k: options[k] for k in ("x0", "y0", "size", "no_data") if k in options}
    body = {k: options[k] for k in ("no_data", "decimals", "north_first") if k in options}
    each = F.array(*[F.struct(F.concat_ws("_", *keys, F.lit(m)).alias("map"), F.col(m).cast("double").alias("value")) for m in metrics])
    long = df.select("lat_idx", "lon_idx", F.explode(each).alias("_m")).select("lat_idx", "lon_idx", "_m.map", "_m.value")
    lines = ascii_rows(long, "value", n_lat, n_lon, ("map",), **body)
    top = F.array(*[F.struct(F.lit(i - 100).alias("row"), F.lit(x).alias("line")) for i, x in enumerate(header(n_lat, n_lon, **head))])
    return lines.unionByName(long.select("map").distinct().select("map", F.explode(top).alias("_t")).select("map", "_t.row", "_t.line"))


def write_maps(df: DataFrame, metrics: tuple[str, ...], path: str, n_lat: int, n_lon: int, keys: tuple[str, ...], **options) -> None:
    """The grids of map_lines, all in one job: folders map=<keys>_<metric>, a file in each.

    A map's lines meet in one task, n_lat of them; the maps are spread over the tasks.
    """
    lines = map_lines(df, metrics, n_lat, n_lon, keys, **options)
    lines.repartition("map").sortWithinPartitions("map", "row").select("map", "line").write.mode("overwrite").partitionBy("map").text(path)


def write_soil(df: DataFrame, path: str) -> None:
    """Harmonised soil moisture: 32-bit values, a folder for each model and scenario."""
    df.withColumn("sm", F.col("sm").cast("float")).write.mode("overwrite").option("compression", "zstd").partitionBy("model", "climate", "soc").parquet(path)


def read_soil(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("sm", F.col("sm").cast("double"))
