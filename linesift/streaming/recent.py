"""The newest distinct keys of a stream, with state of constant size.

An entry among the newest ``cap`` distinct keys of everything is also among those of its record batch and of its bucket
of keys.  So each task reduces every record batch to ``cap`` entries at most before anything is shuffled, whatever key
is hot; a bucket's state holds ``cap`` entries; and the result is the newest ``cap`` of all buckets.  State and shuffle
don't grow with the number of keys.

Entries travel as Arrow bytes (``bucket, newest, rows``: a packet), so every type comes back as it was.

Defined results: a null in ``order`` counts as oldest; null keys are keys; entries of one key that tie in all of
``order`` are equal (either may stay); an empty stream gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linesift.operators.history import HISTORY_CAP

BUCKETS = 8
PACKET = "bucket int, newest timestamp, rows binary"


def _newest(table, keys: list[str], order: list[str], cap: int):
    """The newest ``cap`` distinct keys of an Arrow table, newest first."""
    import pyarrow as pa
    import pyarrow.compute as pc

    table = table.take(pc.sort_indices(table, sort_keys=[(c, "descending") for c in order], null_placement="at_end"))
    table = table.append_column("_at", pa.array(range(len(table)), pa.int64()))
    first = table.group_by(keys).aggregate([("_at", "min")])["_at_min"]
    return table.take(first.take(pc.sort_indices(first))[:cap]).drop_columns(["_at"])


def _pack(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpack(rows):
    import pyarrow as pa

    return pa.ipc.open_stream(pa.py_buffer(bytes(rows))).read_all()


def packets(log: DataFrame, keys: list[str], order: list[str], payload: list[str] = (), cap: int = HISTORY_CAP, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, newest, rows``: per record batch and bucket the newest ``cap`` distinct keys (narrow, no shuffle).

    ``order[0]`` is a timestamp; ``newest`` is the greatest one of the packet.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    keys, order = list(keys), list(order)
    wanted = list(dict.fromkeys([*keys, *order, *payload]))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for bucket in pc.unique(table["_bucket"]).to_pylist():
                kept = _newest(table.filter(pc.equal(table["_bucket"], bucket)).drop_columns(["_bucket"]), keys, order, cap)
                newest = pc.max(kept[order[0]]).cast(pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([newest.as_py()], pa.timestamp("us", "UTC")), pa.array([_pack(kept)], pa.binary())],
                    names=["bucket", "newest", "rows"],
                )

    rows = log.select(*wanted, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket"))
    return rows.mapInArrow(run, PACKET)


def unpacked(packed: DataFrame, like: DataFrame, keys: list[str], order: list[str], payload: list[str] = ()) -> DataFrame:
    """The entries of packets, in the columns that they have in ``like``."""
    columns = list(dict.fromkeys([*keys, *order, *payload]))

    def run(batches: Iterator):
        for batch in batches:
            for rows in batch.column(0).to_pylist():
                yield from _unpack(rows).select(columns).to_batches()

    return packed.select("rows").mapInArrow(run, like.select(*columns).schema)


def bounded_state(packed: DataFrame, keys: list[str], order: list[str], cap: int = HISTORY_CAP, expire: str | None = None) -> DataFrame:
    """The streaming state over packets: per changed bucket one packet with its newest ``cap`` keys so far (mode ``update``).

    ``expire`` ("1 hour"): entries are dropped once the stream's newest time is that far ahead of them, in buckets that
    get no more rows too.  A bucket without entries leaves an empty packet and no state.
    """
    import pandas as pd
    import pyarrow as pa
    import pyarrow.compute as pc

    keys, order = list(keys), list(order)
    timeout = GroupStateTimeout.EventTimeTimeout if expire else GroupStateTimeout.NoTimeout

    def merged(key: tuple, found: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [_unpack(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            # Folded frame by frame: never more than one frame's packets and ``cap`` entries are held.
            for frame in found:
                held = [_newest(pa.concat_tables(held + [_unpack(r) for r in frame["rows"]]), keys, order, cap)]
        table, times = held[0], None
        if expire:
            mark = state.getCurrentWatermarkMs()
            times = pc.cast(pc.cast(table[order[0]], pa.timestamp("ms"), safe=False), pa.int64())
            fresh = pc.fill_null(pc.greater_equal(times, mark), False)
            table, times = table.filter(fresh), times.filter(fresh)
        rows = _pack(table)
        if len(table):
            state.update((rows,))
            if expire:
                state.setTimeoutTimestamp(max(pc.min(times).as_py(), mark) + 1)
        elif state.exists:
            state.remove()
        newest = pc.max(table[order[0]]).as_py()
        yield pd.DataFrame({"bucket": [key[0]], "newest": [pd.Timestamp(newest) if newest else pd.NaT], "rows": [rows]})

    if expire:
        packed = packed.withWatermark("newest", expire)
    return packed.groupBy("bucket").applyInPandasWithState(merged, PACKET, "rows binary", "update", timeout)


def recent_batches(log: DataFrame, keys: list[str], order: list[str], out_path: str, name: str, payload: list[str] = (),
                   cap: int = HISTORY_CAP, buckets: int = BUCKETS, expire: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Keep the newest ``cap`` distinct keys of a streaming log below ``out_path`` (read them with :func:`read_recent`).

    Every micro-batch writes a snapshot, ``batch_id=<n>``: a packet for each bucket, those of the last snapshot where the
    batch changed nothing.  A retried batch replaces its own snapshot.
    """
    from linesift.streaming.grep_stream import start

    def run(batch: DataFrame, batch_id: int) -> None:
        now = batch
        if batch_id > 0:
            before = batch.sparkSession.read.schema(PACKET).parquet(f"{out_path}/batch_id={batch_id - 1}")
            batch = batch.persist()  # one packet a bucket: read twice, computed once
            now = batch.unionByName(before.join(batch.select("bucket"), "bucket", "left_anti"))
        now.coalesce(1).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        batch.unpersist()

    state = bounded_state(packets(log, keys, order, payload, cap, buckets), keys, order, cap, expire)
    return start(state, name, output_mode="update", trigger=trigger, foreach_batch=run)


def read_recent(spark: SparkSession, out_path: str, like: DataFrame, keys: list[str], order: list[str], payload: list[str] = (), cap: int = HISTORY_CAP) -> DataFrame:
    """The newest ``cap`` keys of the last snapshot, newest first; ``like`` has the log's columns."""
    snapshots = spark.read.schema(f"{PACKET}, batch_id long").parquet(out_path)
    last = snapshots.agg(F.max("batch_id").alias("last"))
    found = unpacked(snapshots.join(F.broadcast(last), F.col("batch_id") == F.col("last")), like, keys, order, payload)
    return found.orderBy(*[F.col(c).desc() for c in order]).limit(cap)
