"""Trip files by month: CSV, zipped CSV, directories, Parquet; their sinks and side-cars."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalar import no_nan
from ..spec import FileFormat

#: Fixed value: how the last backup's time is written.
BACKUP_FORMAT = "%Y%m%d_%H%M%S"
_SKIP = "__MACOSX"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def list_files(spark: SparkSession, root: str) -> list[str]:
    """All files under a folder of any file system, sorted, without archive litter."""
    fs, at = _path(spark, root)
    found, files = fs.listFiles(at, True), []
    while found.hasNext():
        files.append(found.next().getPath().toString())
    return sorted(f for f in files if _SKIP not in f)


def month_of(path: str) -> str | None:
    """YYYY-MM of .../2016/1_January/... or of a file name that begins with YYYYMM."""
    if m := re.search(r"/(\d{4})/(\d{1,2})_[A-Za-z]+(?:/|$)", f"/{path}"):
        year, month = m[1], int(m[2])
    elif m := re.match(r"(\d{4})(\d{2})(?!\d)", posixpath.basename(path.rstrip("/"))):
        year, month = m[1], int(m[2])
    else:
        return None
    return f"{year}-{month:02d}" if 1 <= month <= 12 else None


def discover(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Month to CSV and ZIP files, in order of months."""
    out: dict[str, list[str]] = {}
    for f in list_files(spark, root):
        if f.lower().endswith((".csv", ".zip")) and (m := month_of(f)):
            out.setdefault(m, []).append(f)
    return dict(sorted(out.items()))


def source_summary(spark: SparkSession, root: str) -> DataFrame:
    """month, source_count, csv_count (members of zips included)."""
    rows = []
    for month, files in discover(spark, root).items():
        zips = [f for f in files if f.lower().endswith(".zip")]
        inner = 0
        if zips:
            names = F.udf(lambda b: [n for n in zipfile.ZipFile(io.BytesIO(b)).namelist() if n.lower().endswith(".csv") and _SKIP not in n], "array<string>")
            inner = spark.read.format("binaryFile").load(zips).select(F.size(names("content")).alias("n")).agg(F.sum("n")).first()[0] or 0
        rows.append((month, len(files), len(files) - len(zips) + inner))
    return spark.createDataFrame(rows, "month string, source_count long, csv_count long")


def _not_utf8(spark: SparkSession, files: list[str]) -> set[str]:
    """Paths of the files that hold a line that isn't UTF-8."""
    raw = spark.read.text(files).where(~F.is_valid_utf8("value")).select(F.input_file_name().alias("f")).distinct()
    return {unquote(urlparse(r["f"]).path) for r in raw.collect()}  # files, not lines


def read_csv(spark: SparkSession, files: list[str] | str, *, multi_line: bool = False) -> DataFrame:
    """All columns as strings; each file that isn't UTF-8 is read as latin-1. Files may have their own columns: they are united by name.

    A doubled quote within quotes is a quote. multi_line: quoted fields can hold line ends, and a file is one task.
    """
    files = [files] if isinstance(files, str) else list(files)
    latin = _not_utf8(spark, files)
    reader = lambda e: spark.read.option("header", True).option("encoding", e).option("escape", '"').option("multiLine", multi_line)
    heads: dict[tuple, list[str]] = {}
    for f in files:
        encoding = "ISO-8859-1" if urlparse(f).path in latin else "UTF-8"
        heads.setdefault((encoding, *standard_names(reader(encoding).csv(f).columns)), []).append(f)
    out = None
    for (encoding, *names), some in heads.items():
        schema = StructType([StructField(n, StringType()) for n in names])
        one = reader(encoding).option("enforceSchema", True).schema(schema).csv(some)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_zipped_csv(spark: SparkSession, files: list[str] | str, chunk: int = 10_000) -> DataFrame:
    """CSV members of zip files, a file a task (zips can't be split), in chunks; UTF-8, else latin-1, decided before a row is given."""
    files = [files] if isinstance(files, str) else list(files)

    def members(content: bytes) -> Iterator[tuple[zipfile.ZipFile, str, str]]:
        z = zipfile.ZipFile(io.BytesIO(content))
        for n in sorted(z.namelist()):
            if n.lower().endswith(".csv") and _SKIP not in n:
                try:
                    with z.open(n) as f:
                        for _ in io.TextIOWrapper(f, "utf-8"):
                            pass
                    yield z, n, "utf-8"
                except UnicodeDecodeError:
                    yield z, n, "latin-1"

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                for z, n, enc in members(bytes(content)):
                    with z.open(n) as f:
                        yield pd.DataFrame({"name": standard_names(list(pd.read_csv(f, encoding=enc, nrows=0).columns))})

    raw = spark.read.format("binaryFile").load(files).select("content").repartition(len(files))
    names = sorted(r["name"] for r in raw.mapInPandas(heads, "name string").distinct().collect())  # column names

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                for z, n, enc in members(content):
                    with z.open(n) as f:
                        for part in pd.read_csv(f, encoding=enc, dtype=str, chunksize=chunk):
                            part.columns = standard_names(list(part.columns))
                            part = part.reindex(columns=names).astype(object)
                            yield part.where(part.notna(), None)

    return raw.mapInPandas(rows, StructType([StructField(n, StringType()) for n in names]))


def standard_names(columns: list[str]) -> list[str]:
    return [c.strip().lower() for c in columns]


def standardise(df: DataFrame, start_columns: tuple[str, ...] = ("starttime", "start_time", "started_at")) -> DataFrame:
    """Lower-case names; start columns as times, null where they aren't one; yearmonth of the first that is there; NaN as null."""
    df = df.toDF(*standard_names(df.columns))
    there = [c for c in start_columns if c in df.columns]
    times = {c: F.try_to_timestamp(F.col(c).cast("string")) for c in there}
    clean = {c: no_nan(F.col(c)) for c, t in df.dtypes if t in ("float", "double")}
    df = df.withColumns(times | clean) if times or clean else df
    return df.withColumn("yearmonth", F.date_format(there[0], "yyyy-MM")) if there else df


def load_months(spark: SparkSession, root: str, months: list[str] | None = None, *, sort: str | None = None, merge: bool = True) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Frames by month, or all of them under "all", and the errors of months that can't be read. Months asked for but absent are left out."""
    found = discover(spark, root)
    frames: dict[str, DataFrame] = {}
    errors: dict[str, str] = {}
    for month in found if months is None else [m for m in found if m in set(months)]:
        try:
            zips = [f for f in found[month] if f.lower().endswith(".zip")]
            plain = [f for f in found[month] if f not in zips]
            parts = ([read_csv(spark, plain)] if plain else []) + ([read_zipped_csv(spark, zips)] if zips else [])
            df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
            frames[month] = standardise(df)
        except Exception as e:  # one month's failure is told, the others are loaded
            errors[month] = str(e)[:500]
    if merge and frames:
        out = None
        for df in frames.values():
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        frames = {"all": out}
    return {k: df.orderBy(sort) if sort else df for k, df in frames.items()}, errors


def feature_path(horizon: int, window: int, prefix: str | None = None, suffix: str | None = None, ext: str = "") -> str:
    return f"{prefix + '_' if prefix else ''}h{horizon}_w{window}{'_' + suffix if suffix else ''}{'.' + ext if ext else ''}"


def load_features(spark: SparkSession, path: str, *, columns: list[str] | None = None, equals: dict | None = None, dropna: bool = False) -> DataFrame:
    """Parquet with pushed-down equalities, whose columns then go."""
    df = spark.read.parquet(path)
    for c, v in (equals or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    df = df.drop(*(equals or {}))
    df = df.select(*columns) if columns else df
    return df.na.drop("any") if dropna else df


def load_stations(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Station metadata with x and y of its WKT geometry; raises if there is none or a value isn't a point."""
    from ..operators.spatial import parse_point

    df = spark.read.option("header", True).csv(path)
    if "geometry" not in (columns or df.columns) or "geometry" not in df.columns:
        raise ValueError("station metadata needs a geometry column")
    df = df.select(*columns) if columns else df
    x, y = parse_point(F.col("geometry"))
    df = df.withColumnsRenamed({"StationId": "station_id", "GroupStationId": "group_id", "ExpectedStationSize": "capacity"}).withColumns({"x": x, "y": y})
    if not df.where("geometry IS NOT NULL AND x IS NULL").isEmpty():
        raise ValueError("a geometry isn't a WKT point")
    return df


def save_adjacency(lists: DataFrame, path: str) -> None:
    lists.write.mode("overwrite").json(path)


def load_adjacency(spark: SparkSession, path: str, id_col: str, id_type: str = "string") -> DataFrame:
    return spark.read.schema(f"{id_col} {id_type}, neighbours array<{id_type}>").json(path)


def numeric_if_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """String columns whose values are all whole numbers become longs; one pass looks at all of them."""
    text = [c for c in columns if dict(df.dtypes)[c] == "string"]
    if not text:
        return df
    bad = df.agg(*[F.count(F.when(F.col(c).isNotNull() & F.col(c).try_cast("long").isNull(), 1)).alias(c) for c in text]).first()
    return df.withColumns({c: F.col(c).cast("long") for c in text if not bad[c]})


def save(df: DataFrame, path: str, fmt: FileFormat | str = FileFormat.PARQUET, *, columns: list[str] | None = None, partition_by: tuple[str, ...] = (), compression: str | None = None, meta: dict | None = None) -> None:
    """Writes a table, and meta as JSON beside it under {path}_meta."""
    fmt = FileFormat(fmt)
    df = df.select(*columns) if columns else df
    w = df.write.mode("overwrite").format(fmt.value)
    if compression:
        w = w.option("compression", compression)
    if fmt is FileFormat.CSV:
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
    if meta is not None:
        df.sparkSession.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}_meta")


def load_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}_meta").first()[0])


def save_cleaned(df: DataFrame, path: str, fmt: FileFormat | str = FileFormat.PARQUET, *, columns: list[str] | None = None, original: dict[str, str] | None = None, partition_by: tuple[str, ...] = (), compression: str | None = "gzip") -> None:
    """Cleaned trips: a column subset, or original names (canonical to original), not both; station ids as numbers if all are."""
    if columns and original:
        raise ValueError("either a subset of columns or original names")
    df = numeric_if_all(df, [c for c in ("StartStationId", "EndStationId") if c in df.columns])
    meta = {"columns": df.columns, "saved": datetime.now(timezone.utc).isoformat()}
    df = df.withColumnsRenamed(original) if original else df
    save(df, path, fmt, columns=columns, partition_by=partition_by, compression=compression if FileFormat(fmt) is not FileFormat.ORC else None, meta=meta)


def panel_path(name: str, freq: str = "1h", compression: str = "gzip") -> str:
    return f"{name}_resampled_{freq}.parquet.{compression}"


def save_panel(df: DataFrame, root: str, name: str, freq: str = "1h", compression: str = "gzip") -> str:
    if compression not in ("gzip", "brotli", "lz4", "zstd", "snappy"):
        raise ValueError(f"unknown compression {compression!r}")
    path = f"{root.rstrip('/')}/{panel_path(name, freq, compression)}"
    save(df, path, compression=compression)
    return path


def write_backup_time(spark: SparkSession, path: str, when: datetime | None = None) -> None:
    text = (when or datetime.now(timezone.utc)).strftime(BACKUP_FORMAT)
    spark.createDataFrame([(text,)], "t string").coalesce(1).write.mode("overwrite").text(path)


def read_backup_time(spark: SparkSession, path: str) -> datetime | None:
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return None
    return datetime.strptime(spark.read.text(path).first()[0], BACKUP_FORMAT).replace(tzinfo=timezone.utc)
