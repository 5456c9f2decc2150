"""Parser plug-ins: extra file formats as ``(path, bytes) -> [{"text", "location", "metadata"}]`` functions.

A registered parser runs inside one ``mapInArrow`` step over the files with its
extension and yields ``segments`` rows (line number 0, location as given);
searching, counting and views are then the usual DataFrame operators.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesift.functions.text import basename, extension

Parser = Callable[[str, bytes], list[dict]]
PLUGIN_SCHEMA = "file_path string, seq long, raw string, location_display string, metadata map<string,string>, error string, content binary"

_REGISTRY: dict[str, Parser] = {}


def register_parser(ext: str, parser: Parser) -> None:
    _REGISTRY[ext.lower() if ext.startswith(".") else "." + ext.lower()] = parser


def registered() -> dict[str, Parser]:
    return dict(_REGISTRY)


def _batches(it: Iterator, parsers: dict[str, Parser]) -> Iterator:
    import pyarrow as pa

    schema = pa.schema([("file_path", pa.string()), ("seq", pa.int64()), ("raw", pa.string()),
                        ("location_display", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())),
                        ("error", pa.string()), ("content", pa.binary())])
    for batch in it:
        rows = []
        for path, content in zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist()):
            ext = os.path.splitext(path.rsplit("/", 1)[-1])[1].lower()
            found, error = [], None
            try:
                for i, item in enumerate(parsers[ext](path, content) or []):
                    meta = [(str(k), str(v)) for k, v in (item.get("metadata") or {}).items()]
                    found.append((path, i, item.get("text", ""), item.get("location", "Unknown"), meta, None, None))
            except Exception as e:  # noqa: BLE001 - reported, the scan goes on
                found, error = [], f"Error parsing {path}: {e}"
            rows += found or [(path, None, None, None, None, error, content)]  # nothing found: read as text
        cols = list(zip(*rows)) if rows else [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def normalized(parsers: dict[str, Parser] | None) -> dict[str, Parser]:
    """Parsers by lower-case extension with its dot; ``None`` means the registered ones."""
    return registered() if parsers is None else {(e if e.startswith(".") else "." + e).lower(): p for e, p in parsers.items()}


def plugin_outputs(files: DataFrame, parsers: dict[str, Parser] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files with a parser's extension -> (segments, errors, files to be read as text since their parser gave nothing)."""
    ps = normalized(parsers)
    ext = extension(basename(F.col("file_path")))
    out = files.where(ext.isin(list(ps))).select("file_path", "content").mapInArrow(
        lambda it: _batches(it, ps), PLUGIN_SCHEMA
    )
    segs = out.where(F.col("seq").isNotNull()).select(
        "file_path", extension(basename(F.col("file_path"))).alias("ext"), "seq", "raw",
        F.lit(0).alias("line_number"), "location_display", "metadata",
    )
    errs = out.where(F.col("error").isNotNull()).select("file_path", F.lit("extract").alias("stage"), F.col("error").alias("message"))
    return segs, errs, out.where(F.col("seq").isNull()).select("file_path", "content")


def plugin_segments(files: DataFrame, parsers: dict[str, Parser] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files with a registered extension -> (segments, errors)."""
    return plugin_outputs(files, parsers)[:2]
