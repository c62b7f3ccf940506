"""Filing trees, flat filing files and ready tables, all to the corpus schema."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from filingloom.functions import text as X
from filingloom.runtime import durable, release
from filingloom.schemas import CORPUS, RAW_FILING, empty

SUBMISSION = "full-submission.txt"
# Files and bytes that a task reads, bytes that it hands on at once, rows of a listing at once.
TASK_FILES, TASK_BYTES = 20_000, 64 << 20
BATCH_BYTES, LISTED_ROWS = 4 << 20, 10_000

LISTED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])
CONTENTS = pa.schema([("path", pa.string()), ("value", pa.binary())])


def _corpus(df: DataFrame, doc_id: Column | str, *more: str) -> DataFrame:
    return df.select(
        (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("long").alias("doc_id"),
        "ticker",
        F.col("year").cast("int").alias("year"),
        "text",
        X.word_count("text").cast("int").alias("word_count"),
        *more,
    )


def _place(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """``(scheme and host, folder)`` where tasks can list and open files themselves."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(target).toString()
    if any(c in path for c in "*?[{"):
        return None
    if whole.startswith("file:"):
        return "file:", "/" + whole.removeprefix("file:").strip("/")
    start, folder = whole.split("/", 3)[:3], whole.split("/", 3)[3:]
    try:
        system, _ = fs.FileSystem.from_uri("/".join(start))
        system.get_file_info("/" + "".join(folder))
    except (OSError, ValueError, pa.ArrowException):
        return None
    return "/".join(start), "/" + "".join(folder)


def _system(start: str) -> fs.FileSystem:
    return fs.LocalFileSystem() if start == "file:" else fs.FileSystem.from_uri(start)[0]


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _listed(batches: Iterator[pa.RecordBatch], start: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Folders inside the given folders, and the files with content whose name fits."""
    system = _system(start)
    for batch in batches:
        out = []
        for folder in batch.column("path").to_pylist():
            for found in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                is_folder = found.type == fs.FileType.Directory
                if _hidden(found.base_name) or not is_folder and not (found.size and fnmatchcase(found.base_name, pattern)):
                    continue
                out.append({"path": found.path, "size": found.size or 0, "folder": is_folder})
                if len(out) == LISTED_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=LISTED)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema=LISTED)


def _contents(batches: Iterator[pa.RecordBatch], start: str) -> Iterator[pa.RecordBatch]:
    system = _system(start)
    for batch in batches:
        out, size = [], 0
        for path in batch.column("path").to_pylist():
            try:
                with system.open_input_stream(path, compression=None) as stream:
                    value = stream.read()
            except OSError:
                continue
            out.append({"path": f"{start}{path}", "value": value})
            size += len(value)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema=CONTENTS)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=CONTENTS)


def _file_table(spark: SparkSession, start: str, folder: str, pattern: str, recursive: bool) -> DataFrame:
    """``(path, size)`` of all files, listed by tasks folder by folder, one level after the other."""
    level = spark.createDataFrame([(folder,)], "path string")
    files, tables, schema = [], [], from_arrow_schema(LISTED)
    while True:
        found = durable(level.mapInArrow(lambda b: _listed(b, start, pattern), schema), "listing")
        tables.append(found)
        files.append(found.where("NOT folder").select("path", "size"))
        folders = found.where("folder").select("path")
        n = folders.count() if recursive else 0
        if not n:
            break
        level = folders.repartition(max(1, min(n, spark.sparkContext.defaultParallelism * 4, n // 100 + 1)))
    every = files[0]
    for more in files[1:]:
        every = every.union(more)
    every = durable(every, "files")
    release(*tables)
    return every


def _whole_files(spark: SparkSession, path: str, pattern: str, recursive: bool = False) -> DataFrame:
    """One row per file. A missing folder gives an empty table, an unreadable
    file is left out, and the job goes on.

    Tasks list the folders and open the files, so the driver never sees their names. Where only
    Spark can open them (other file systems, patterns in the path), its reader does both.
    """
    if place := _place(spark, path):
        start, folder = place
        files = _file_table(spark, start, folder, pattern, recursive)
        n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if n:
            cores = spark.sparkContext.defaultParallelism
            parts = max(min(n, cores), -(-n // TASK_FILES), -(-size // TASK_BYTES))
            read = files.select("path").repartition(parts).mapInArrow(lambda b: _contents(b, start), from_arrow_schema(CONTENTS))
            return read.select("path", F.col("value").cast("string").alias("value"))
        if _system(start).get_file_info(folder).type != fs.FileType.File:
            return empty(spark, RAW_FILING)
    reader = spark.read.option("ignoreCorruptFiles", "true").option("pathGlobFilter", pattern)
    try:
        files = reader.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, RAW_FILING)
    # the path comes percent-encoded, in which a plus sign stands for itself
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return files.select(F.url_decode(encoded).alias("path"), "value")


def read_filings(spark: SparkSession, path: str, pick: str = "first") -> DataFrame:
    """Corpus from ``{path}/**/{TICKER}/10-K/{ACCESSION}/full-submission.txt``."""
    raw = _whole_files(spark, path, SUBMISSION, recursive=True)
    return extract_filings(raw, pick=pick)


def extract_filings(raw: DataFrame, pick: str = "first") -> DataFrame:
    """Corpus from raw filings ``(path, value)``, with ``source_path`` as its order.

    A filing is dropped when its path has no 10-K folder, its header names no
    period, or its text has no Item 1A. An empty section is kept.
    """
    ticker = F.regexp_extract("path", "/([^/]+)/10-K/", 1)
    # exploding one element keeps the filters below from decoding each file again
    parsed = raw.where(ticker != "").select(
        "path", ticker.alias("ticker"), F.explode(F.array(X.decode("value"))).alias("body")
    )
    sections = parsed.where(X.has_risk_section("body")).select(
        F.col("path").alias("source_path"),
        "ticker",
        X.report_year("body").alias("year"),
        X.clean_markup(X.strip(X.risk_section("body", pick))).alias("text"),
    )
    return _corpus(sections.where("year IS NOT NULL"), F.xxhash64("source_path"), "source_path")


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """Corpus from ``{path}/{TICKER}_{YEAR}_risk_factors.txt``."""
    return flat_filings(_whole_files(spark, path, "*.txt"))


def flat_filings(raw: DataFrame) -> DataFrame:
    """Corpus from ready sections ``(path, value)`` whose file name holds ticker
    and year; a malformed name drops the file."""
    stem = F.replace(F.element_at(F.split("path", "/"), -1), F.lit(".txt"), F.lit(""))
    parts = F.split(stem, "_")
    named = raw.select(
        F.col("path").alias("source_path"),
        F.get(parts, F.lit(0)).alias("ticker"),
        F.get(parts, F.lit(1)).try_cast("int").alias("year"),
        X.decode("value").alias("text"),
    )
    return _corpus(named.where("year IS NOT NULL"), F.xxhash64("source_path"), "source_path")


def from_table(
    df: DataFrame, doc_id: str, ticker: str, year: Column | str, text: str
) -> DataFrame:
    """Corpus from a table that already has one row per filing."""
    year = F.col(year) if isinstance(year, str) else year
    named = df.select(
        F.col(doc_id).alias("doc_id"),
        F.col(ticker).alias("ticker"),
        year.cast("int").alias("year"),
        F.col(text).alias("text"),
    )
    return _corpus(named.where("year IS NOT NULL"), "doc_id")


def empty_corpus(spark: SparkSession) -> DataFrame:
    return empty(spark, CORPUS)
