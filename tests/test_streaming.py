"""Streaming: the stream delivers the batch result (hits, running counts, newest-per-key history)."""

import shutil

from pyspark.sql import functions as F

from conftest import SF_SMALL
from linesift.operators import history
from linesift.operators.grep import search_corpus
from linesift.sources.tables import documents_path
from linesift.streaming import grep_stream as gs


def _copy_table(tmp_path, name, copies=3):
    d = tmp_path / name
    d.mkdir()
    for i in range(copies):  # several files -> several micro-batches
        shutil.copy(f"{SF_SMALL}/{name}.parquet", d / f"part-{i}.parquet")
    return str(d)


def test_stream_hits_equal_batch(spark, tmp_path):
    src = _copy_table(tmp_path, "documents", 1)
    schema = spark.read.parquet(src).schema
    stream = gs.table_stream(spark, src, schema, max_files_per_trigger=1)
    corpus = stream.select(documents_path().alias("file_path"), "text")
    hits = gs.stream_hits(corpus, "the", ignore_case=True, whole_word=True).select("file_path", "line_number", "line_content")
    q = gs.start(hits, "hits_eq", sink="memory", trigger={"availableNow": True})
    q.awaitTermination()
    assert q.lastProgress is not None and q.lastProgress["numInputRows"] >= 0
    got = sorted(tuple(r) for r in spark.table("hits_eq").collect())
    batch = search_corpus(spark.read.parquet(src).select(documents_path().alias("file_path"), "text"), "the",
                          ignore_case=True, whole_word=True).select("file_path", "line_number", "line_content")
    assert got == sorted(tuple(r) for r in batch.collect()) and len(got) > 0


def test_stream_counts_and_history(spark, tmp_path):
    src = _copy_table(tmp_path, "documents", 3)
    schema = spark.read.parquet(src).schema
    corpus = gs.table_stream(spark, src, schema, max_files_per_trigger=1).select(
        documents_path().alias("file_path"), "text")
    counts = gs.running_counts(gs.stream_hits(corpus, "and"))
    q = gs.start(counts, "counts_eq", output_mode="complete", sink="memory", trigger={"availableNow": True})
    q.awaitTermination()
    batch = search_corpus(spark.read.parquet(src).select(documents_path().alias("file_path"), "text"), "and")
    want = sorted(tuple(r) for r in batch.groupBy("file_path").count().collect())
    assert sorted(tuple(r) for r in spark.table("counts_eq").collect()) == want

    ev_src = _copy_table(tmp_path, "events", 2)
    ev_schema = spark.read.parquet(ev_src).schema
    ev = gs.table_stream(spark, ev_src, ev_schema, max_files_per_trigger=1)
    latest = gs.newest_per_key(ev, ["user_id", "event_type"], ["ts", "event_id"])
    kept = []

    def top(batch_df, _epoch):
        kept[:] = [tuple(r) for r in gs.top_recent(batch_df, ["ts", "event_id"]).collect()]

    q2 = gs.start(latest, "hist_eq", output_mode="complete", trigger={"availableNow": True}, foreach_batch=top)
    q2.awaitTermination()
    want2 = history.recent(spark.read.parquet(ev_src), ["user_id", "event_type"], ["ts", "event_id"])
    assert kept == [tuple(r) for r in want2.collect()] and len(kept) == 50


def test_file_stream(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("needle one\nno\n")
    (root / "b.txt").write_bytes(b"\xef\xbb\xbfneedle two\n")
    (root / "c.bin").write_bytes(b"needle\x00binary")
    (root / "d.txt").write_bytes("needle テスト\n".encode("cp932"))
    corpus = gs.text_corpus(gs.file_stream(spark, str(root), max_files_per_trigger=1))
    hits = gs.stream_hits(corpus, "needle").select(F.regexp_extract("file_path", "[^/]*$", 0).alias("f"), "line_number")
    q = gs.start(hits, "files_eq", sink="memory", trigger={"availableNow": True})
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("files_eq").collect()) == [("a.txt", 1), ("b.txt", 1), ("d.txt", 1)]


def test_office_files_in_micro_batches(spark, tmp_path):
    from linesift.sources.office_writer import docx_bytes

    root = tmp_path / "office"
    root.mkdir()
    (root / "a.docx").write_bytes(docx_bytes("x\nneedle in word", "s", "l"))
    (root / "b.txt").write_text("needle in text\n")
    (root / "c.xlsx").write_text("needle in a broken workbook\n")
    out = str(tmp_path / "hits")
    q = gs.scan_batches(gs.file_stream(spark, str(root), max_files_per_trigger=2), "needle", out, "office_batches",
                        trigger={"availableNow": True})
    q.awaitTermination()
    got = sorted((r.file_path.rsplit("/", 1)[-1], r.location_display) for r in spark.read.parquet(out).collect())
    assert got == [("a.docx", "Body P.2"), ("b.txt", ""), ("c.xlsx", "")]
    assert spark.read.parquet(out + "_errors").count() == 1


def test_errors_of_a_stream_and_one_reading(spark, tmp_path):
    """An undecodable file is an error row of its batch; hits and errors come from one tagged table."""
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("needle\nno\n")
    (root / "odd.txt").write_bytes(b"needle \x81\n" * 3)
    (root / "bin.txt").write_bytes(b"needle\x00")
    out = str(tmp_path / "hits")
    gs.scan_batches(gs.file_stream(spark, str(root), 10), "needle", out, "stream_errors", trigger={"availableNow": True}).awaitTermination()
    name = lambda r: r.file_path.rsplit("/", 1)[-1]
    assert [name(r) for r in spark.read.parquet(out).collect()] == ["a.txt"]
    assert [(name(r), r.stage) for r in spark.read.parquet(out + "_errors").collect()] == [("odd.txt", "decode")]
    assert sorted((name(r), r.kind) for r in spark.read.parquet(out + "_tagged").collect()) == [("a.txt", "file"), ("a.txt", "hit"), ("bin.txt", "skipped"), ("odd.txt", "error")]
    decoded = gs.decoded_files(gs.file_stream(spark, str(root)))
    q = gs.start(decoded, "stream_decoded", sink="memory", trigger={"availableNow": True})
    q.awaitTermination()
    assert sorted((name(r), r.stage) for r in spark.table("stream_decoded").collect()) == [("a.txt", None), ("odd.txt", "decode")]


def test_processing_time_trigger_and_progress(spark, tmp_path):
    """Bounded micro-batches on a processing-time trigger; progress reports the rows of each batch."""
    src = _copy_table(tmp_path, "documents", 2)
    schema = spark.read.parquet(src).schema
    corpus = gs.table_stream(spark, src, schema, max_files_per_trigger=1).select(documents_path().alias("file_path"), "text")
    hits = gs.stream_hits(corpus, "the").select("file_path", "line_number")
    q = gs.start(hits, "timed", sink="memory", trigger={"processingTime": "200 milliseconds"})
    try:
        q.processAllAvailable()
        progress = [p for p in q.recentProgress if p["numInputRows"] > 0]
        assert len(progress) == 2  # one file per trigger
        assert spark.table("timed").count() == 2 * search_corpus(
            spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(documents_path().alias("file_path"), "text"), "the"
        ).count()
    finally:
        q.stop()


def _log_files(spark, tmp_path, parts, per_part, hot=3):
    """A log of ``parts * per_part`` keys, one of which holds a third of all rows, in files of one micro-batch each."""
    src = str(tmp_path / "log")
    for p in range(parts):
        ids = spark.range(p * per_part, (p + 1) * per_part, 1, 4).withColumn("ts", F.timestamp_micros(F.col("id") * 1_000_000))
        key = F.when(F.col("id") % hot == 0, F.lit(None).cast("long")).otherwise(F.pmod(F.xxhash64("id"), F.lit(10 ** 15)))
        ids.select(key.alias("k"), "ts", F.col("id").alias("n"), F.array(F.col("id").cast("string")).alias("tags")).write.mode("append").parquet(f"{src}/p{p}")
    return src


def test_bounded_recent_keys(spark, tmp_path):
    """100,000 keys: a state of a packet per bucket, the result of the batch form, also after a restart."""
    from linesift.streaming import recent

    src = _log_files(spark, tmp_path, 4, 40_000)
    rows = spark.read.parquet(f"{src}/*")
    assert rows.select("k").distinct().count() > 100_000
    stream = gs.table_stream(spark, f"{src}/*", rows.schema, max_files_per_trigger=5)
    out = str(tmp_path / "recent")
    run = lambda: recent.recent_batches(stream, ["k"], ["ts", "n"], out, "recent_keys", ["tags"], trigger={"availableNow": True})
    want = [tuple(r) for r in history.recent(rows, ["k"], ["ts", "n"], ["tags"]).select("k", "ts", "n", "tags").collect()]
    for _ in range(2):  # the second run finds nothing new
        q = run()
        q.awaitTermination()
        assert q.exception() is None
        got = [tuple(r) for r in recent.read_recent(spark, out, rows, ["k"], ["ts", "n"], ["tags"]).collect()]
        assert got == want and len(got) == 50
    assert spark.read.parquet(out).select("batch_id").distinct().count() >= 3
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert all(n <= recent.BUCKETS for n in state)
    sizes = spark.read.parquet(out).agg(F.max(F.length("rows"))).first()[0]
    assert sizes < 50 * 200 + 2_000


def test_bounded_recent_keys_expire(spark, tmp_path):
    from linesift.streaming import recent

    src = _log_files(spark, tmp_path, 3, 100)  # a second a row
    rows = spark.read.parquet(f"{src}/*")
    out = str(tmp_path / "recent")
    for part in range(3):  # batch after batch, so that the watermark moves in between
        shutil.copytree(f"{src}/p{part}", tmp_path / "in", dirs_exist_ok=True)
        stream = gs.table_stream(spark, str(tmp_path / "in"), rows.schema)
        recent.recent_batches(stream, ["k"], ["ts", "n"], out, "recent_expire", buckets=3, expire="20 seconds", trigger={"availableNow": True}).awaitTermination()
    got = [r["n"] for r in recent.read_recent(spark, out, rows, ["k"], ["ts", "n"]).collect()]
    newest = [r["n"] for r in history.recent(rows, ["k"], ["ts", "n"]).collect()]
    assert got == [n for n in newest if n >= 299 - 20]


def test_bounded_recent_keys_of_nothing(spark, tmp_path):
    from linesift.streaming import recent

    none = spark.createDataFrame([], "k string, ts timestamp")
    assert recent.packets(none, ["k"], ["ts"]).count() == 0
    some = spark.createDataFrame([(None, None), ("a", None), ("a", None)], "k string, ts timestamp")
    assert sorted(str(r.k) for r in recent.unpacked(recent.packets(some, ["k"], ["ts"]), some, ["k"], ["ts"]).distinct().collect()) == ["None", "a"]
