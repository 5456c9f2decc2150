"""Token-id files: canonical, length-limited Huffman coding of ids from global counts.

Format.  A file set is a folder with a Parquet folder ``blocks`` and one row in ``code``: nothing else is needed to read
it.  A block holds whole documents in ascending key
order: their keys, their id counts, the bit stream, and a checkpoint (bit offset) every ``STRIDE`` ids.  The code is
canonical, so the table is just the code length of each id; lengths are limited to ``LIMIT`` bits by the package-merge
method, so decoding reads a table of 2**LIMIT entries.  A block is decoded from the table and its own row alone;
inside it all checkpoints are decoded side by side.

Defined results: a null text is an empty one and has only the end id; repeated keys stay in any order; rows with a
null key come first; an empty table gives empty files and an empty result.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linesift.llm.encoder import encoder
from linesift.llm.packing import text_batches
from linesift.llm.stage import shared_root, stage

#: Longest code in bits (18 bits hold any alphabet of up to 262,144 ids), ids per checkpoint, ids per block.
LIMIT, STRIDE, BLOCK_IDS = 18, 256, 1 << 19
#: Full blocks that a task writes, about.
BLOCKS_IN_TASK = 16
CODE_SCHEMA = "bits_limit int, stride int, lengths binary"
BLOCK_SCHEMA = "part int, block long, keys array<long>, counts array<long>, bits binary, checkpoints binary, n_ids long"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the ids with a count (0 for the others), by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.int64)
    n = len(coins)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([coins, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank)
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for rank in reversed(levels):
        chosen = rank[:take]
        coin = chosen[chosen < n]
        lengths[coin] += 1
        take = 2 * int((chosen >= n).sum())
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    size = lengths[ids].astype(np.int64)
    codes = np.zeros(len(lengths), np.uint32)
    if len(ids):
        top = int(size[-1])
        steps = np.left_shift(np.int64(1), top - size)
        starts = np.concatenate([[0], np.cumsum(steps)[:-1]])
        codes[ids] = starts >> (top - size)
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every value of the next ``limit`` bits."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    reach = np.left_shift(np.int64(1), limit - lengths[ids].astype(np.int64))
    table, size = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    n = int(reach.sum())
    table[:n] = np.repeat(ids, reach)
    size[:n] = np.repeat(lengths[ids], reach)
    return table, size


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
    """The bit stream of ``ids`` (first bit highest) and the bit offset of every ``stride``-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.uint64)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    code = codes[ids].astype(np.uint64)
    word, low = starts >> 6, 64 - (starts & 63) - size  # low < 0: the code runs into the next word
    here = np.where(low >= 0, code << np.maximum(low, 0).astype(np.uint64), code >> np.maximum(-low, 0).astype(np.uint64))
    out = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.add.reduceat(here, first)  # codes don't overlap: the sum is their union
    over = np.flatnonzero(low < 0)
    out[word[over] + 1] |= code[over] << (64 + low[over]).astype(np.uint64)  # one such code at most for each word
    return out.astype(">u8").tobytes()[: int(ends[-1] + 7) // 8], starts[::stride].astype(np.uint64)


def decode_bits(bits: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray, size: np.ndarray, stride: int = STRIDE, limit: int = LIMIT) -> np.ndarray:
    """The ids of a block: all checkpoints advance together, one table look-up per id."""
    lanes = len(checkpoints)
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint64)
    # The 32 bits from each byte on: any code of up to 25 bits lies inside, whatever its bit offset.
    near = ((raw[:-3] << np.uint64(24)) | (raw[1:-2] << np.uint64(16)) | (raw[2:-1] << np.uint64(8)) | raw[3:]).astype(np.uint32)
    last = len(near) - 1
    out = np.zeros((stride, lanes), np.uint32)
    pos = checkpoints.astype(np.int64)
    shift, mask = 32 - limit, np.uint32((1 << limit) - 1)
    for k in range(stride):
        at = np.minimum(pos >> 3, last)
        window = (near[at] >> (shift - (pos & 7)).astype(np.uint32)) & mask
        out[k] = table[window]
        pos = pos + size[window]
    return out.T.reshape(-1)[:n]


def staged_ids(docs: DataFrame, path: str, end_id: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text tokenised once: key, number of ids and compressed ids of a document; and a row (``id, n``) for each id of a task."""

    def run(batches):
        enc, tail, pack = encoder(path), b"" if end_id is None else int(end_id).to_bytes(4, "little"), zstandard.ZstdCompressor(level=1)
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            keys = batch.column(0)
            for lo, texts in text_batches(batch, "text"):
                found = [ids + tail for ids in enc.encode(texts)]
                flat = np.frombuffer(b"".join(found), "<u4")
                if len(flat):
                    seen = np.bincount(flat, minlength=len(total))
                    total = seen + (total if len(seen) == len(total) else np.pad(total, (0, len(seen) - len(total))))
                wide = len(flat) and int(flat.max()) >= 1 << 16
                packed = [pack.compress(ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()) for ids in found]
                yield _token_rows(keys.slice(lo, len(texts)), [len(ids) // 4 for ids in found], packed, None)
        used = np.flatnonzero(total)
        yield _token_rows(pa.nulls(len(used), pa.int64()), total[used], pa.nulls(len(used), pa.binary()), used)

    tokens = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, ids binary, id long")
    return stage(tokens, "token-ids", compression="none")


def _token_rows(keys, n, ids, id_) -> pa.RecordBatch:
    id_ = pa.nulls(len(keys), pa.int64()) if id_ is None else pa.array(id_, pa.int64())
    return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), id_], names=["doc_id", "n", "ids", "id"])


def _unpacked(ids: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(ids, max_output_size=4 * n + 8) if n else b""
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def global_counts(staged: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents.  One row per id and task is shuffled, one per id sent on."""
    rows = staged.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_files(staged: DataFrame, counts: np.ndarray) -> str:
    """Write the blocks in ascending key order, and the code table beside them; the folder's name."""
    spark = staged.sparkSession
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)

    def run(batches):
        part, block, keys, sizes, held, total = 0, 0, [], [], [], 0

        def flush():
            nonlocal block, keys, sizes, held, total
            bits, marks = encode_bits(np.concatenate(held), codes, lengths)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int64()), "keys": pa.array([keys], pa.list_(pa.int64())), "counts": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()), "checkpoints": pa.array([marks.astype("<u8").tobytes()], pa.binary()), "n_ids": pa.array([total], pa.int64())})
            block, keys, sizes, held, total = block + 1, [], [], [], 0
            return row

        for batch in batches:
            for part, key, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):  # noqa: B007
                keys.append(key)
                sizes.append(n)
                held.append(_unpacked(ids.as_py(), n))
                total += n
                if total >= BLOCK_IDS:
                    yield flush()
        if keys:
            yield flush()

    # A block's ids, again and again, make a task; a key that repeats is dealt by its rows' checksum as well.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // (BLOCKS_IN_TASK * BLOCK_IDS))
    rows = staged.where("id is null").select("doc_id", "n", "ids", F.xxhash64("ids").alias("_h"))
    rows = rows.repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "n", "ids")
    folder = f"{shared_root(spark)}/llm/token-files-{uuid.uuid4().hex}"
    rows.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{folder}/blocks")
    spark.createDataFrame([(LIMIT, STRIDE, bytearray(lengths.tobytes()))], CODE_SCHEMA).coalesce(1).write.parquet(f"{folder}/code")
    return folder


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, part, block``: documents as decoded from the files of a folder alone."""
    files = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    code = spark.read.schema(CODE_SCHEMA).parquet(f"{folder}/code").first()  # one row of at most 2**limit bytes
    limit, stride, lengths = code["bits_limit"], code["stride"], np.frombuffer(code["lengths"], np.uint8)
    heads = files.groupBy("part", "block").agg(F.sum("n_ids").alias("n_ids"))
    # One row for each block (half a million ids); summed by part first, so that no window holds all blocks.
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_in_part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    heads = heads.select("part", "block", (F.col("_part_start") + F.col("_in_part")).alias("_start"))

    def run(batches):
        table, size = decode_table(lengths, limit)
        for batch in batches:
            for part, block, keys, counts, bits, marks, total in zip(*(batch.column(i) for i in range(7)), strict=True):
                ids = decode_bits(bits.as_py(), np.frombuffer(marks.as_py(), "<u8"), total.as_py(), table, size, stride, limit).astype("<u4", copy=False)
                sizes = np.array(counts.as_py(), np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                k = len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(keys.as_py(), pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array([part.as_py()] * k, pa.int32()), pa.array([block.as_py()] * k, pa.int64())], names=["doc_id", "in_block", "n_tokens", "ids_crc32", "part", "block"])

    docs = files.select("part", "block", "keys", "counts", "bits", "checkpoints", "n_ids").mapInArrow(run, "doc_id long, in_block long, n_tokens long, ids_crc32 long, part int, block long")
    return docs.join(heads, ["part", "block"]).select("doc_id", (F.col("_start") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32", "part", "block")


def token_files(docs: DataFrame, path: str, end_id: int | None = 0) -> DataFrame:
    """Tokenise, count, write the files and read them back."""
    staged = staged_ids(docs, path, end_id)
    return read_files(docs.sparkSession, write_files(staged, global_counts(staged)))
