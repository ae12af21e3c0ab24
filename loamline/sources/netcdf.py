"""NetCDF as a Spark source and sink: spark.read.format("netcdf").load(path) after register(spark), and write_series().

A Python data source with a partition for each file, band of rows of the grid and range of months, so neither a file nor a
band of it has to fit into one task; what a partition holds is given on as Arrow batches, a month of the band each. Classic
files (versions 1, 2 and 5 of the format) are read directly, a slab at a time; files in the HDF5 form need the netCDF4
package on the executors. Values equal to the fill value, and NaN, become null; times of any calendar become year and month.

Options: variable; band (rows of the grid in a partition, 30); months (in a partition, 120); lat, lon, time (names of the
dimensions). A variable without time has one month, of no year. Columns: lat_idx, lon_idx, lat, lon, year, month, t,
layers (top first; one entry for variables without layers).
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..params import LAYER_NAMES

#: numbers of types in classic files, as struct codes
TYPES = {1: "b", 2: "c", 3: "h", 4: "i", 5: "f", 6: "d", 7: "B", 8: "H", 9: "I", 10: "q", 11: "Q"}


class ClassicFile:
    """Header of a classic NetCDF file, and slices of its variables."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        magic = self.file.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError(f"{path} isn't a classic NetCDF file")
        self.version = magic[3]
        self.records = self._count()
        self.dims = [(self._name(), self._count()) for _ in range(self._list(10))]
        self.attrs = self._attrs()
        self.vars: dict[str, dict] = {}
        for _ in range(self._list(11)):
            name = self._name()
            dims = [self._count() for _ in range(self._count())]
            attrs, kind, size = self._attrs(), self._int(), self._count()
            begin = struct.unpack(">i" if self.version == 1 else ">q", self.file.read(4 if self.version == 1 else 8))[0]
            self.vars[name] = {"dims": [self.dims[d][0] for d in dims], "shape": [self.dims[d][1] for d in dims], "attrs": attrs, "type": TYPES[kind], "size": size, "begin": begin, "record": bool(dims) and self.dims[dims[0]][1] == 0}
        for v in self.vars.values():
            if v["record"]:
                v["shape"][0] = self.records
        own = [v for v in self.vars.values() if v["record"]]
        self.stride = sum(v["size"] for v in own) if len(own) != 1 else prod(own[0]["shape"][1:]) * struct.calcsize(own[0]["type"])

    def _int(self) -> int:
        return struct.unpack(">i", self.file.read(4))[0]

    def _count(self) -> int:
        return struct.unpack(">q", self.file.read(8))[0] if self.version == 5 else struct.unpack(">I", self.file.read(4))[0]

    def _name(self) -> str:
        n = self._count()
        return self.file.read(n + -n % 4)[:n].decode()

    def _list(self, tag: int) -> int:
        got, n = self._int(), self._count()
        if got not in (0, tag):
            raise ValueError("the header is damaged")
        return n

    def _attrs(self) -> dict:
        out = {}
        for _ in range(self._list(12)):
            name, kind, n = self._name(), TYPES[self._int()], self._count()
            size = n * struct.calcsize(kind)
            raw = self.file.read(size + -size % 4)[:size]
            out[name] = raw.decode() if kind == "c" else struct.unpack(f">{n}{kind}", raw)
        return out

    def read(self, name: str, first: int = 0, count: int | None = None) -> np.ndarray:
        """count values from the first on (by default all), in the file's order."""
        v = self.vars[name]
        kind = np.dtype(f">{v['type']}" if v["type"] != "c" else "S1")
        each = prod(v["shape"][1:]) if v["record"] else max(1, prod(v["shape"]))
        left = prod(v["shape"]) - first if count is None else count
        out = []
        while left:
            record, at = divmod(first, each) if v["record"] else (0, first)
            n = min(left, each - at)
            self.file.seek(v["begin"] + record * self.stride + at * kind.itemsize)
            out.append(np.frombuffer(self.file.read(n * kind.itemsize), dtype=kind))
            first, left = first + n, left - n
        return np.concatenate(out) if out else np.zeros(0, dtype=kind)

    # The same for both kinds of files.

    def shape(self, name: str) -> dict[str, int]:
        return dict(zip(self.vars[name]["dims"], self.vars[name]["shape"], strict=True))

    def attributes(self, name: str) -> dict:
        return {k: v.rstrip("\0") if isinstance(v, str) else v for k, v in self.vars[name]["attrs"].items()}

    def slab(self, name: str, before: tuple[int, ...], first: int, last: int) -> np.ndarray:
        """Rows of the grid from first to last at the given places in the dimensions before; missing ones are NaN."""
        shape = self.vars[name]["shape"]
        at = 0
        for place, size in zip(before, shape, strict=False):
            at = at * size + place
        rows, width = shape[-2:]
        values = self.read(name, (at * rows + first) * width, (last - first) * width).astype("f8")
        for fill in {x for k in ("_FillValue", "missing_value") for x in self.vars[name]["attrs"].get(k, ())}:
            values[values == fill] = np.nan
        return values.reshape(last - first, width)

    def close(self) -> None:
        self.file.close()


class Hdf5File:
    """The same over the netCDF4 package."""

    def __init__(self, path: str):
        import netCDF4

        self.data = netCDF4.Dataset(path)
        self.vars = self.data.variables

    def shape(self, name: str) -> dict[str, int]:
        return dict(zip(self.vars[name].dimensions, self.vars[name].shape, strict=True))

    def attributes(self, name: str) -> dict:
        return {k: self.vars[name].getncattr(k) for k in self.vars[name].ncattrs()}

    def read(self, name: str) -> np.ndarray:
        return np.ma.filled(self.vars[name][...].astype("f8"), np.nan).ravel()

    def slab(self, name: str, before: tuple[int, ...], first: int, last: int) -> np.ndarray:
        return np.ma.filled(self.vars[name][(*before, slice(first, last))].astype("f8"), np.nan)

    def close(self) -> None:
        self.data.close()


def open_file(path: str) -> ClassicFile | Hdf5File:
    with open(path, "rb") as f:
        classic = f.read(3) == b"CDF"
    return ClassicFile(path) if classic else Hdf5File(path)


def months_since(units: str, values: tuple, calendar: str) -> list[tuple[int, int]]:
    """Year and month of each time ("<unit> since <date>"), in the file's calendar."""
    unit, _, start = units.partition(" since ")
    y, m, d = (int(x) for x in start.split()[0].split("T")[0].split("-"))
    if unit.startswith("month"):
        return [((y * 12 + m - 1 + int(v)) // 12, (y * 12 + m - 1 + int(v)) % 12 + 1) for v in values]
    days = {"d": 1.0, "h": 1 / 24, "m": 1 / 1440, "s": 1 / 86400}[unit[0]]
    if calendar == "360_day":
        base = y * 360 + (m - 1) * 30 + d - 1
        return [(int(base + v * days) // 360, int(base + v * days) % 360 // 30 + 1) for v in values]
    if calendar in ("noleap", "365_day"):
        ends = (31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334, 365)
        base = y * 365 + (ends[m - 2] if m > 1 else 0) + d - 1
        return [(int(base + v * days) // 365, 1 + sum(int(base + v * days) % 365 >= e for e in ends)) for v in values]
    from datetime import datetime, timedelta

    return [((t := datetime(y, m, d) + timedelta(days=v * days)).year, t.month) for v in values]


def months_of(file: ClassicFile | Hdf5File, time: str) -> list[tuple[int, int]]:
    about = file.attributes(time)
    return months_since(about["units"], tuple(file.read(time).tolist()), about.get("calendar", "standard"))


def layer_bounds(path: str, variable: str = "depth_bnds") -> list[tuple[int, float, float]] | None:
    """layer, top and bottom of each layer, if the file tells them."""
    file = open_file(path)
    try:
        if variable not in file.vars:
            return None
        return [(k, float(top), float(bottom)) for k, (top, bottom) in enumerate(file.read(variable).reshape(-1, 2).tolist())]
    finally:
        file.close()


class Part(InputPartition):
    def __init__(self, path: str, rows: tuple[int, int], months: tuple[int, int]):
        self.path, self.rows, self.months = path, rows, months


class NetcdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.variable = options["path"], options.get("variable", "soilmoist")
        self.band, self.months = int(options.get("band", 30)), int(options.get("months", 120))
        self.lat, self.lon, self.time = options.get("lat", "lat"), options.get("lon", "lon"), options.get("time", "time")

    def _shape(self, file: ClassicFile | Hdf5File) -> tuple[dict[str, int], str | None]:
        """Sizes of the variable's dimensions, and the name of the one for layers."""
        if self.variable not in file.vars:
            raise ValueError(f"no variable {self.variable}")
        shape = file.shape(self.variable)
        layer = next((d for d in shape if d.lower() in LAYER_NAMES), None)
        if [d for d in shape if d not in (self.time, layer)] != [self.lat, self.lon] or list(shape)[-2:] != [self.lat, self.lon] or self.time in shape and next(iter(shape)) != self.time:
            raise ValueError(f"{self.variable} has dimensions {list(shape)}")
        return shape, layer

    def partitions(self) -> list[Part]:
        import glob

        out = []
        for path in sorted(glob.glob(self.path)) or [self.path]:
            file = open_file(path)
            shape, _ = self._shape(file)
            file.close()
            n, months = shape[self.lat], shape.get(self.time, 1)
            out += [Part(path, (i, min(i + self.band, n)), (t, min(t + self.months, months))) for t in range(0, months, self.months) for i in range(0, n, self.band)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        file = open_file(part.path)
        shape, layer = self._shape(file)
        (first, last), layers, width = part.rows, shape.get(layer, 1), shape[self.lon]
        lats, lons = (np.asarray(file.read(n)).astype("f8") for n in (self.lat, self.lon))
        months = months_of(file, self.time) if self.time in shape else [(None, None)]
        cells = (last - first) * width
        where = [pa.array(np.repeat(np.arange(first, last, dtype="i4"), width)), pa.array(np.tile(np.arange(width, dtype="i4"), last - first)), pa.array(np.repeat(lats[first:last], width)), pa.array(np.tile(lons, last - first))]
        ends = pa.array(np.arange(cells + 1, dtype="i4") * layers)
        for t in range(*part.months):
            before = [(t,) if self.time in shape else ()] * layers if layer is None else [((t,) if self.time in shape else ()) + (k,) for k in range(layers)]
            values = np.stack([file.slab(self.variable, b, first, last).ravel() for b in before], axis=1).ravel()
            same = [pa.array([v] * cells, pa.int32()) for v in (*months[t], t)]
            yield pa.RecordBatch.from_arrays([*where, *same, pa.ListArray.from_arrays(ends, pa.array(values, mask=np.isnan(values)))], ["lat_idx", "lon_idx", "lat", "lon", "year", "month", "t", "layers"])
        file.close()


class NetcdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        return "lat_idx int, lon_idx int, lat double, lon double, year int, month int, t int, layers array<double>"

    def reader(self, schema) -> NetcdfReader:
        return NetcdfReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NetcdfSource)


# Writing.


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 4)


def _named(name: str) -> bytes:
    return struct.pack(">i", len(name.encode())) + _padded(name.encode())


def _attributes(given: dict[str, str | float]) -> bytes:
    """Texts, and numbers as 32-bit values."""
    if not given:
        return b"\0" * 8
    out = struct.pack(">ii", 12, len(given))
    for name, value in given.items():
        raw = value.encode() if isinstance(value, str) else struct.pack(">f", value)
        out += _named(name) + (struct.pack(">ii", 2, len(raw)) if isinstance(value, str) else struct.pack(">ii", 5, 1)) + _padded(raw)
    return out


def classic_header(dims: dict[str, int], variables: list[tuple[str, list[str], dict, str]]) -> tuple[bytes, list[int]]:
    """Header of a classic file with 64-bit places, and where each variable (name, dimensions, attributes, f or d) begins."""
    places, codes = list(dims), {"f": 5, "d": 6}
    sizes = [prod(dims[d] for d in own) * struct.calcsize(kind) for _, own, _, kind in variables]
    out = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", 10, len(dims)) + b"".join(_named(n) + struct.pack(">i", size) for n, size in dims.items()) + b"\0" * 8
    heads = [_named(name) + struct.pack(f">i{len(own)}i", len(own), *(places.index(d) for d in own)) + _attributes(about) + struct.pack(">iI", codes[kind], min(size + -size % 4, 2**32 - 1)) for (name, own, about, kind), size in zip(variables, sizes, strict=True)]
    at, begins = len(out) + 8 + sum(len(h) + 8 for h in heads), []
    for size in sizes:
        begins.append(at)
        at += size + -size % 4
    return out + struct.pack(">ii", 11, len(variables)) + b"".join(h + struct.pack(">q", b) for h, b in zip(heads, begins, strict=True)), begins


def write_series(df: DataFrame, path: str, lats: list[float], lons: list[float], months: list[tuple[int, int]], name: str, about: dict[str, str | float], value: str = "sm", fill: float = -9999.0) -> str:
    """df (lat_idx, lon_idx, t, value) as one NetCDF file with 32-bit values, in a folder that driver and executors share.

    The driver writes the header; the tasks, a group for each row of the grid, write their values to their places in the file,
    the same bytes again if one is run twice. The file gets its name when all is written.
    """
    from datetime import date

    start = date(months[0][0], months[0][1], 1)
    times = [float((date(y, m, 1) - start).days) for y, m in months]
    dims = {"time": len(months), "lat": len(lats), "lon": len(lons)}
    clock = {"units": f"days since {start.isoformat()} 00:00:00", "calendar": "proleptic_gregorian", "standard_name": "time"}
    variables = [("time", ["time"], clock, "d"), ("lat", ["lat"], {}, "d"), ("lon", ["lon"], {}, "d"), (name, ["time", "lat", "lon"], {"_FillValue": fill} | about, "f")]
    head, begins = classic_header(dims, variables)
    unfinished, size = f"{path}.unfinished", begins[-1] + 4 * prod(dims.values())
    with open(unfinished, "wb") as f:
        f.write(head)
        for begin, values in zip(begins, (times, lats, lons), strict=False):
            f.seek(begin)
            f.write(np.array(values, dtype=">f8").tobytes())
        f.truncate(size)
    n_t, n_lat, n_lon, begin = *dims.values(), begins[-1]

    def write(t: pa.Table) -> pa.Table:
        row = t["lat_idx"][0].as_py()
        grid = np.full((n_t, n_lon), fill, dtype=">f4")
        values = t["v"].to_numpy()
        grid[t["t"].to_numpy(), t["lon_idx"].to_numpy()] = np.where(np.isnan(values), fill, values)
        file = os.open(unfinished, os.O_WRONLY)
        try:
            for k in range(n_t):
                os.pwrite(file, grid[k].tobytes(), begin + 4 * n_lon * (k * n_lat + row))
            os.fsync(file)
        finally:
            os.close(file)
        return pa.table({"lat_idx": pa.array([row], pa.int32())})

    every = df.sparkSession.range(n_lat).select(F.col("id").cast("int").alias("lat_idx"), F.lit(0).alias("lon_idx"), F.lit(0).alias("t"), F.lit(None).cast("float").alias("v"))  # rows of the grid without any value
    cells = df.select("lat_idx", "lon_idx", "t", F.col(value).cast("float").alias("v"))
    rows = cells.unionByName(every.join(cells.select("lat_idx").distinct(), "lat_idx", "left_anti"))
    done = {r[0] for r in rows.groupBy("lat_idx").applyInArrow(write, "lat_idx int").collect()}  # as many as the grid has rows
    if done != set(range(n_lat)):
        raise RuntimeError(f"{path}: rows of the grid are missing")
    os.replace(unfinished, path)
    return path
