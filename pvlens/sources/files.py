"""File sources and sinks (S1-S8, K1-K8, SC15).

Two layouts are read: the original yearly folders
``{year}...Data/{year}...{ROLE}.csv`` and ``{base}/{ROLE}/year=YYYY/part-*.csv``,
one folder per report part partitioned by year, as written here. Files are
listed and classified first, so only the files of wanted years are opened, and
columns are bound by each file's own header.
"""

from __future__ import annotations

import csv
import os
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvlens.functions.lexicons import DEFAULT_SYMPTOMS, NULL_TOKENS
from pvlens.functions.text import WHITESPACE_RUN, null_tokens_to_null
from pvlens.session import CLEANUP, session_setting

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# Folders that a task writes to at once; beyond them it sorts its rows by folder.
OPEN_FILES = 50

ANNOTATION_SCHEMA = T.StructType([
    T.StructField("data", T.StructType([T.StructField("text", T.StringType())])),
    T.StructField("result", T.ArrayType(T.StructType([
        T.StructField("value", T.StructType([
            T.StructField("labels", T.ArrayType(T.StringType())),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]))]))),
])


# ---------------------------------------------------------------- discovery

def list_files(spark: SparkSession, base: str, name_glob: str = "*.csv{,.gz}") -> DataFrame:
    """Paths of the files under ``base`` (any depth) whose name matches
    ``name_glob``. Only metadata is read — the binary source skips file
    contents when ``content`` is not selected — and the listing itself is
    distributed by Spark for large trees."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", name_glob).load(base).select(F.col("path")))


def role_of(key: Column) -> Column:
    """S3: role from a ``{folder}_{stem}`` key. The original sends anything
    that is neither SYMPTOMS nor DATA to VAX; we accept only a VAX suffix and
    flag the rest as OTHER (a deliberate deviation)."""
    return (F.when(key.endswith("SYMPTOMS"), F.lit("SYMPTOMS"))
             .when(key.endswith("DATA"), F.lit("DATA"))
             .when(key.endswith("VAX"), F.lit("VAX"))
             .otherwise(F.lit("OTHER")))


def classify_files(files: DataFrame) -> DataFrame:
    """S1 + S3: (path, folder, stem, key, year, role) per discovered file,
    for both the partitioned layout and the yearly ``*Data`` folders."""
    p = F.col("path")
    part_year = F.regexp_extract(p, r"/year=(\d{4})/", 1)
    folder_year = F.regexp_extract(p, r"/(\d{4})[^/]*Data/", 1)
    role_dir = F.regexp_extract(p, r"/([A-Za-z]+)/year=\d{4}/", 1)
    stem = F.regexp_replace(F.regexp_extract(p, r"([^/]+)\.csv/?[^/]*$", 1), r"\.csv$", "")
    folder = F.regexp_extract(p, r"/([^/]*Data)/", 1)
    year = F.when(part_year != "", part_year).otherwise(folder_year)
    key = F.when(role_dir != "", role_dir).otherwise(F.concat_ws("_", folder, stem))
    return files.select("path", folder.alias("folder"), stem.alias("stem"), key.alias("key"),
                        year.alias("year"), role_of(key).alias("role"))


def file_report(classified: DataFrame) -> DataFrame:
    """S3: the files that no blend can use, with the reason: ``stray`` (no part
    of a report), ``no year``, or ``doubled`` (a second file of the same part and
    year in the yearly layout, where a part is one file)."""
    yearly = F.col("folder") != ""
    first = F.min("key").over(Window.partitionBy("year", "role", yearly))
    problem = (F.when(F.col("role") == "OTHER", F.lit("stray"))
                .when(F.col("year") == "", F.lit("no year"))
                .when(yearly & (F.col("key") != first), F.lit("doubled")))
    return classified.select("path", "year", "role", problem.alias("problem")).where("problem is not null")


# ---------------------------------------------------------------- CSV (S2, S4, SC15, K1-K3, K8)

def read_header(spark: SparkSession, path: str, encoding: str = "UTF-8") -> tuple[str, ...]:
    """Column names of a CSV file: its first line, through Hadoop's file systems
    and the codec that the file's ending names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    data = p.getFileSystem(conf).open(p)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
        data if codec is None else codec.createInputStream(data), encoding))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return tuple(next(csv.reader([(line or "").lstrip("\ufeff")]), ()))


def read_csv_files(spark: SparkSession, paths: list[str], columns: list[str],
                   encoding: str = "UTF-8") -> DataFrame:
    """``columns`` of CSV files as text, by name, with the file's path as
    ``_path``; SC15 null tokens -> null.

    The first line of each file is read on the driver (one open for each file);
    files with the same header are one multi-file scan. A file that lacks a
    column is an error; further columns are not read. Multi-line quoted
    narratives are understood, which makes a file one task: convert large files
    to Parquet once."""
    groups: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda p: read_header(spark, p, encoding), paths))
    for path, header in zip(paths, headers):
        missing = [c for c in columns if c not in header]
        if missing:
            raise ValueError(f"{path}: no columns {missing}")
        groups.setdefault(header, []).append(path)
    frames = []
    for header, files in sorted(groups.items()):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        raw = spark.read.options(**CSV_OPTIONS).option("encoding", encoding).schema(schema).csv(files)
        frames.append(raw.select(*[null_tokens_to_null(F.col(f"`{c}`"), NULL_TOKENS).alias(c)
                                   for c in columns], F.col("_metadata.file_path").alias("_path")))
    if not frames:
        return spark.createDataFrame([], T.StructType(
            [T.StructField(c, T.StringType()) for c in [*columns, "_path"]]))
    return reduce(DataFrame.unionByName, frames)


def read_csv_raw(spark: SparkSession, path: str, columns: list[str],
                 encoding: str = "UTF-8") -> DataFrame:
    """``columns`` of all CSV files under ``path`` as text, by name."""
    paths = [r["path"] for r in list_files(spark, path).collect()]
    return read_csv_files(spark, sorted(paths), columns, encoding).drop("_path")


def apply_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Explicit types after a raw read; dirty values become null (try_cast)."""
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        out.append((c if isinstance(f.dataType, T.StringType) else
                    c.try_cast(f.dataType)).alias(f.name))
    return df.select(*out)


def read_report_part(spark: SparkSession, base: str, role: str, schema: T.StructType,
                     encoding: str = "ISO-8859-1", years: list[str] | None = None,
                     files: list[Row] | None = None) -> DataFrame:
    """One part of all (or the given) years, typed, with its ``year`` taken
    from the path. ``files`` are rows of :func:`classify_files`, if at hand. A year's
    files are a scan of their own with the year as a constant: searching each row's
    path for it took longer than reading the row."""
    if files is None:
        files = classify_files(list_files(spark, base)).collect()
    by_year: dict[str, list[str]] = {}
    for f in files:
        if f["role"] == role and f["year"] != "" and (years is None or f["year"] in years):
            by_year.setdefault(f["year"], []).append(f["path"])
    fields = [f for f in schema.fields if f.name != "year"]
    names = [f.name for f in fields]
    raw = [read_csv_files(spark, sorted(paths), names, encoding).withColumn("year", F.lit(year))
           for year, paths in sorted(by_year.items())]
    if not raw:
        raw = [read_csv_files(spark, [], names, encoding).withColumn("year", F.lit(""))]
    return apply_schema(reduce(DataFrame.unionByName, raw),
                        T.StructType([*fields, T.StructField("year", T.StringType())]))


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None,
              mode: str = "overwrite", encoding: str = "UTF-8", compression: str = "none") -> str:
    """K1/K2/K3/K8: header, doubled-quote escaping, spaces kept; nulls are
    written empty (read back as null). With ``compression="gzip"`` the files are
    ``.csv.gz``: a blended table repeats a report's values for each of its rows, and
    a file is one task with or without; at the fastest level, which leaves a blended
    table a quarter larger. Shuffle files of the write are dropped when it ends."""
    w = df.write.mode(mode).options(**CSV_OPTIONS).option("encoding", encoding).option("compression", compression)
    w = w.option("zlib.compress.level", "BEST_SPEED")
    if partition_by:
        w = w.partitionBy(*partition_by)
    # a task keeps a file open for each folder instead of sorting its rows by folder
    with session_setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)), \
            session_setting(df.sparkSession, CLEANUP, "true"):
        w.csv(path)
    return path


def write_report_parts(parts: dict[str, DataFrame], base: str, encoding: str = "UTF-8",
                       compression: str = "none") -> str:
    """K1: each part partitioned by year under ``{base}/{ROLE}``. A narrower
    encoding replaces what it lacks; only UTF-8 keeps every text."""
    for role, df in parts.items():
        write_csv(df, os.path.join(base, role), ["year"], encoding=encoding, compression=compression)
    return base


def write_yearly_files(parts: dict[str, DataFrame], base: str, years: list[str],
                       name: str = "VAERS", encoding: str = "UTF-8", compression: str = "none") -> str:
    """K1 in the original layout: ``{base}/{year}{name}Data/{year}{name}{ROLE}.csv``,
    each a folder of part files; one write for each year and part."""
    for role, df in parts.items():
        for year in years:
            write_csv(df.where(F.col("year") == year).drop("year"),
                      os.path.join(base, f"{year}{name}Data", f"{year}{name}{role}.csv"),
                      encoding=encoding, compression=compression)
    return base


# ---------------------------------------------------------------- text / JSON

def strip_unicode(c: Column) -> Column:
    """``str.strip()``: leading / trailing Unicode whitespace."""
    return F.regexp_replace(c, rf"^{WHITESPACE_RUN}|{WHITESPACE_RUN}$", "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped non-blank lines; ``line_no`` increases with the position
    in the input (partition index in the high bits), no single-task window."""
    df = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"),
        strip_unicode(F.col("value")).alias("text"))
    return df.filter(F.col("text") != "")


def load_symptom_dictionary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(term, priority) from a one-term-per-line file when it exists,
    else the built-in list. Terms match in any case and are kept in lower
    case, each once; priority keeps the alternation order."""
    if path and _exists(spark, path):
        lines = read_lines(spark, path)
        return lines.groupBy(F.lower("text").alias("term")).agg(F.min("line_no").alias("priority"))
    return spark.createDataFrame([(t.lower(), i + 1) for i, t in enumerate(DEFAULT_SYMPTOMS)],
                                 "term string, priority long")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def texts_frame(spark: SparkSession, texts: list[str] | str) -> DataFrame:
    """Inline text(s) as (text_id, text) rows."""
    if isinstance(texts, str):
        texts = [texts]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "text_id long, text string")


def read_annotations(spark: SparkSession, path: str, multiline: bool = True,
                     schema: T.StructType = ANNOTATION_SCHEMA) -> DataFrame:
    """An annotation export with an explicit schema: one JSON array a file,
    which one task reads (``multiline``; several files, as
    :func:`write_annotation_arrays` writes them, are read side by side), or JSON
    lines, which are split anywhere."""
    read = spark.read.schema(schema).option("multiLine", str(multiline).lower()).json(path)
    return read.select(*[F.col(f"`{c}`") for c in schema.fieldNames()])


def write_annotation_arrays(df: DataFrame, path: str, keys: list[str], rows_per_file: int = 50_000) -> str:
    """K5 as the labelling tool exchanges it: files that each hold one JSON array,
    ordered by ``keys``. Rows are dealt to files of about ``rows_per_file`` by a
    hash of ``keys``, so no task writes, or reads back, more than one file's worth;
    rows that share all keys share a file. An empty table writes no file."""
    files = max(1, -(-df.select(*keys).count() // rows_per_file))
    order = [F.col(f"`{k}`") for k in keys]
    dealt = df.select(F.pmod(F.xxhash64(*order), F.lit(files)).alias("file"), *order,
                      F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))
    w = Window.partitionBy("file").orderBy(*order, "json")
    lines = dealt.select("file", "json", F.row_number().over(w).alias("nth"),
                         F.lead(F.lit(True)).over(w).isNull().alias("last"))
    # sorted by file first, so that the writer keeps the order and one file open
    (lines.sortWithinPartitions("file", "nth")
          .select("file", F.concat(F.when(F.col("nth") == 1, "[").otherwise(","), "json",
                                   F.when(F.col("last"), "]").otherwise("")).alias("value"))
          .write.mode("overwrite").partitionBy("file").text(path))
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """K5/K6/K7: JSON lines. Map keys that are not strings (cluster ids) are
    written as strings, as ``json.dump`` does."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, T.MapType) and not isinstance(f.dataType.keyType, T.StringType):
            out = out.withColumn(f.name, F.map_from_entries(F.transform(
                F.map_entries(F.col(f.name)),
                lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value")))))
    out.write.mode(mode).json(path)
    return path


def write_ranked(df: DataFrame, path: str, order: list[Column], columns: list[str]) -> str:
    """K4: ``columns`` in global ``order`` (range-partitioned sort; part files
    are in order)."""
    df.orderBy(*order).select(*columns).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return path
