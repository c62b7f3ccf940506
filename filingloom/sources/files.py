"""Filings as files: the sink behind a filing tree or a folder of flat files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from filingloom.sources.filings import SUBMISSION

WRITTEN = pa.schema([("path", pa.string()), ("bytes", pa.int64())])


def tree_name(ticker: Column | str, accession: Column | str) -> Column:
    """Place of a filing in a tree: ``{TICKER}/10-K/{ACCESSION}/full-submission.txt``."""
    return F.concat_ws("/", ticker, F.lit("10-K"), accession, F.lit(SUBMISSION))


def flat_name(ticker: Column | str, year: Column | str) -> Column:
    """Name of a flat file: ``{TICKER}_{YEAR}_risk_factors.txt``."""
    return F.concat(F.concat_ws("_", ticker, year), F.lit("_risk_factors.txt"))


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write each row ``(name, value)`` as a file below ``root``; returns ``(path, bytes)``.

    Tasks write side by side, each file under a name of its own first and moved into place when
    it is whole, so a task that is lost or repeated leaves whole files only. Names are distinct
    relative paths. Null contents give empty files. The files are there once the result has been
    computed; ``root`` is a folder that all executors share (``file:``, ``hdfs:``, ``s3:``, ``gs:``).
    """
    rows = files.select(F.col("name").cast("string").alias("name"), F.col("value").cast("string").alias("value"))
    return rows.mapInArrow(lambda batches: _write(batches, root.rstrip("/")), from_arrow_schema(WRITTEN))


def _write(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    system, base = fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
    for batch in batches:
        out = []
        for name, value in zip(batch.column("name"), batch.column("value"), strict=True):
            parts = (name.as_py() or "").split("/")
            if not all(parts) or ".." in parts:
                raise ValueError(f"not a relative path: {name}")
            content = (value.as_py() or "").encode()
            target = "/".join([base, *parts])
            folder = target.rsplit("/", 1)[0]
            system.create_dir(folder, recursive=True)
            unfinished = f"{folder}/_{uuid.uuid4().hex}"  # readers skip such names
            with system.open_output_stream(unfinished) as stream:
                stream.write(content)
            system.move(unfinished, target)
            out.append({"path": target, "bytes": len(content)})
        yield pa.RecordBatch.from_pylist(out, schema=WRITTEN)
