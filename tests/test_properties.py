"""Property tests (hypothesis): the line split equals Python's universal-newline reader."""

import io

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linesift.functions.text import line_pieces, rstrip_py, strip_py

TEXT = st.text(alphabet=st.sampled_from(list("ab \t\r\n \u0085　\x1cé")), max_size=30)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=1, max_size=40))
def test_lines_match_universal_newlines(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: list(r.l) for r in df.select("i", line_pieces(F.col("t")).alias("l")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == list(io.StringIO(t, newline=None)), repr(t)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=1, max_size=40))
def test_strip_matches_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", rstrip_py(F.col("t")).alias("r"), strip_py(F.col("t")).alias("s")).collect()
    for r in rows:
        assert (r.r, r.s) == (texts[r.i].rstrip(), texts[r.i].strip()), repr(texts[r.i])
