"""Exclusion configuration (``{"exclude_dirs": [...], "exclude_exts": [...]}``) read with Spark's JSON reader.

A value may be a list or a bare string (a one-item list); items are trimmed and
empties dropped, extensions get a leading dot and lower case.  A missing file,
invalid JSON or a non-object gives empty lists.  The file is configuration,
so its single row is brought to the driver.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from linesift.operators.prune import Exclusions, normalize_list_col


def load_exclusions(spark: SparkSession, path: str) -> Exclusions:
    try:
        raw = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return Exclusions()
    fields = {f.name: f.dataType for f in raw.schema.fields}
    cols = []
    for name, is_ext in (("exclude_dirs", False), ("exclude_exts", True)):
        t = fields.get(name)
        if isinstance(t, ArrayType):
            arr = F.col(name).cast("array<string>")
        elif isinstance(t, StringType):
            arr = F.array(F.col(name))
        else:
            arr = F.array().cast("array<string>")
        cols.append(normalize_list_col(F.coalesce(arr, F.array().cast("array<string>")), extensions=is_ext).alias(name))
    rows = raw.select(*cols).limit(1).collect()
    if not rows:
        return Exclusions()
    return Exclusions(tuple(rows[0]["exclude_dirs"]), tuple(rows[0]["exclude_exts"]), ())
