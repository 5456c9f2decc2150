"""Preset pattern dictionary: the shipped presets, and a loader for preset files.

``PRESETS`` is the dictionary the library ships.  ``presets_frame`` loads a
preset JSON file (``[{"category", "items": [[label, pattern, is_regex]]}]``)
with Spark's JSON reader; a missing or invalid file gives an empty frame.
``preset_list`` is the same data on the driver, used to build the one-pass
multi-pattern scan.  Files may lie in any store: the frame's in one that Spark
reads, the list's in one that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesift.sources.files import _open

# The shipped preset dictionary, in its original order:
# category, then (label, pattern, is_regex) per item.
PRESETS: list[tuple[str, list[tuple[str, str, bool]]]] = [
    ('Programming (Python)', [
        ('Python: Function', r'^def\s+\w+\(', True),
        ('Python: Class', r'^class\s+\w+[:\(]', True),
        ('Import statements', r'^import\s+|^from\s+', True),
        ('TODO / FIXME', '(TODO|FIXME|HACK|NOTE):', True),
    ]),
    ('Structure / Strings', [
        ('JSON Key', r'\"\w+\"\s*:', True),
        ('XML Tag', '<[^>]+>', True),
        ('Empty Line', r'^\s*$', True),
        ('Trailing Space', r'\s+$', True),
        ('UUID / GUID', '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', True),
        ('Hex Color', r'#(?:[0-9a-fA-F]{3}){1,2}\b', True),
    ]),
    ('Network / Web', [
        ('IPv4 Address', r'\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b', True),
        ('URL (HTTP/HTTPS)', r'https?://[\w/:%#\$&\?\(\)~\.=\+\-]+', True),
        ('Email Address', r'[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+', True),
    ]),
    ('Logs / Server', [
        ('HTTP Error (4xx/5xx)', r' [45]\d{2} ', True),
        ('Timestamp (YYYY-MM-DD)', r'\d{4}-\d{2}-\d{2}', True),
        ('Time (HH:MM:SS)', r'\d{2}:\d{2}:\d{2}', True),
    ]),
    ('Japanese / Multi-byte', [
        ('Full-width chars', r'[^\x01-\x7E]+', True),
        ('Hiragana', '[ぁ-ん]+', True),
        ('Katakana', '[ァ-ヶー]+', True),
        ('Kanji', r'[\u4E00-\u9FD0]+', True),
    ]),
    ('Other', [
        ('Phone Number (JP)', r'0\d{1,4}-\d{1,4}-\d{4}', True),
    ]),
]

PATTERNS_SCHEMA = "category string, ord int, label string, pattern string, is_regex boolean"


def preset_list(path: str | None = None) -> list[tuple[str, int, str, str, bool]]:
    """``(category, ord, label, pattern, is_regex)`` in order; from a JSON file if given (``[]`` when missing or invalid)."""
    if path is None:
        return [(cat, i, lbl, pat, r) for cat, items in PRESETS for i, (lbl, pat, r) in enumerate(items)]
    try:
        filesystem, place = _open(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
        with filesystem.open_input_stream(place) as f:
            data = json.loads(f.read())
        rows = []
        for cat in data:
            for i, (label, pattern, is_regex) in enumerate(cat.get("items", [])):
                rows.append((cat["category"], i, label, pattern, bool(is_regex)))
        return rows
    except (OSError, ValueError, TypeError, KeyError, AttributeError):
        return []


def write_presets_json(path: str) -> None:
    """The shipped presets as a preset file (the format ``presets_frame`` reads)."""
    data = [{"category": cat, "items": [list(item) for item in items]} for cat, items in PRESETS]
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2)


def by_label(label: str, path: str | None = None) -> tuple[str, bool]:
    """First preset with this label -> ``(pattern, is_regex)``; unknown -> ``("", False)``."""
    for _cat, _ord, lbl, pat, is_regex in preset_list(path):
        if lbl == label:
            return pat, is_regex
    return "", False


def presets_frame(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Presets -> ``patterns`` frame (``category, ord, label, pattern, is_regex``).

    Without ``path``: the shipped presets.  With ``path``: the file is read by
    Spark's JSON reader.  The JSON mixes strings and a boolean in one array, so
    Spark reads the items as ``array<array<string>>`` and ``is_regex`` arrives as
    ``"true"``; it is cast back.
    """
    if path is None:
        return spark.createDataFrame(preset_list(), PATTERNS_SCHEMA)
    empty = spark.createDataFrame([], PATTERNS_SCHEMA)
    try:
        raw = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    if "items" not in raw.columns or "category" not in raw.columns:
        return empty
    item = F.col("item")
    return raw.select("category", F.posexplode("items").alias("ord", "item")).select(
        "category",
        F.col("ord").cast("int").alias("ord"),
        item[0].alias("label"),
        item[1].alias("pattern"),
        (F.lower(item[2]) == "true").alias("is_regex"),
    )
