"""Token ids in files of a static range asymmetric numeral system (rANS).

Documents are written in ascending order of their id, part by part. One frequency table, counted
over all ids, is shared by all files and stands beside them (table.bin), with the list of their blocks
(blocks, a Parquet table), so that the folder alone can be read in any session. A file is a run of
blocks that decode independently; a block holds whole documents. Inside a block, ids are dealt over
interleaved lanes, each a rANS coder of its own (64-bit state, 32-bit words), and the lanes' states
are kept at checkpoints, from which all stretches of a block are decoded side by side. Payload and
decoded ids carry a CRC-32 each, and so does the table.

Block layout, little-endian: magic, counts (7 x u32), CRC of counts and payload, ids CRC (u32 each); document
ids (i64), null marks (u8), document lengths (u32); for each checkpoint the word offset (u32) and
the lanes' states (u64); words (u32).

Null and empty texts hold the end id alone; a very long text is a block of its own. Null ids come
first; rows with equal ids stand in the order of a hash of their token ids, and may be dealt over
several parts. Repeated rows are written once for each row. An empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, released, scratch_fs, shared_dir, stored
from .tokens import encoder, small_batches, tokenizer_path

MAGIC = b"RANSIDS1"
HEAD = struct.Struct("<8s7I2I")
TABLE_MAGIC, TABLE_HEAD = b"RANSTAB1", struct.Struct("<8s3I")
SCALE = 20
LOW = np.uint64(1 << 32)
#: Ids for which there is one file and one task, beyond the session's shuffle partitions.
RANGE_TOKENS = 16_000_000
WORD_BITS = np.uint64(32)


class Corrupt(ValueError):
    """A block whose checksum or layout doesn't fit."""


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE: every id that occurs keeps at least 1, and one slot
    past the last id stays unused, so that no id takes the whole range."""
    total = 1 << SCALE
    seen = np.flatnonzero(counts)
    if len(seen) >= total // 2:
        raise ValueError("too many different ids for the table")
    freq = np.zeros(len(counts) + 1, np.int64)
    freq[-1] = 1
    if not len(seen):
        freq[-1] = total
        return freq
    room = total - 1 - len(seen)
    share = counts[seen].astype(np.float64)
    freq[seen] = 1 + np.floor(share * (room / share.sum())).astype(np.int64)
    freq[seen[np.argmax(freq[seen])]] += total - int(freq.sum())
    return freq


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq, self.cuts = freq.astype(np.uint64), np.concatenate([[0], np.cumsum(freq)])
        self.first = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.most = self.freq << np.uint64(64 - SCALE)  # a state from here on gives off a word first
        self.of_slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int, every: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Checkpoints (word offset, states) in the order of decoding, and the words."""
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, LOW, np.uint64)
        chunks, marks, words = [], [], 0
        scale, mask = np.uint64(SCALE), np.uint64(0xFFFFFFFF)
        for step in range(steps - 1, -1, -1):
            now = ids[step * lanes : (step + 1) * lanes]
            x = state[: len(now)]
            f, out = self.freq[now], x >= self.most[now]
            if out.any():
                chunks.append((x[out] & mask).astype(np.uint32))
                words += len(chunks[-1])
                x = np.where(out, x >> WORD_BITS, x)
            q = x // f
            state[: len(now)] = (q << scale) + (x - q * f) + self.first[now]
            if step % every == 0:
                marks.append((words, state.copy()))
        stream = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
        return [(words - w, s) for w, s in reversed(marks)], stream

    def decode(self, n: int, lanes: int, every: int, at: np.ndarray, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        """All n ids: from the checkpoints (word offsets `at`, a row of states each) all stretches of
        `every` steps side by side."""
        marks = len(at)
        out = np.zeros((marks, every, lanes), np.uint32)
        slots, scale, state, at = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), state.copy(), at.astype(np.int64)
        words = np.append(words, np.zeros(1, words.dtype))
        left = n - (np.arange(marks) * every)[:, None] * lanes - np.arange(lanes)  # ids that a lane still has, counted in ids of its stretch
        for step in range(every):
            live = left > step * lanes
            if not live.any():
                break
            slot = state & slots
            sym = self.of_slot[slot]
            out[:, step] = sym
            x = self.freq[sym] * (state >> scale) + slot - self.first[sym]
            low = (x < LOW) & live
            place = at[:, None] + np.cumsum(low, axis=1) - 1  # a stretch's lanes take its words in order
            x = np.where(low, (x << WORD_BITS) | words[np.minimum(place, len(words) - 1)].astype(np.uint64), x)
            state = np.where(live, x, state)
            at += low.sum(axis=1)
        return out.reshape(-1)[:n]

    def save(self, uri: str) -> None:
        raw = np.diff(self.cuts).astype("<u4").tobytes()
        data = zlib.compress(raw, 6)
        files, name = scratch_fs(uri)
        files.create_dir(name.rpartition("/")[0], recursive=True)
        with files.open_output_stream(name) as f:
            f.write(TABLE_HEAD.pack(TABLE_MAGIC, SCALE, len(raw) // 4, zlib.crc32(raw)) + data)

    @staticmethod
    def load(uri: str) -> "Table":
        files, name = scratch_fs(uri)
        with files.open_input_file(name) as f:
            data = f.read()
        if len(data) < TABLE_HEAD.size:
            raise Corrupt("not a table")
        magic, scale, n, crc = TABLE_HEAD.unpack_from(data)
        try:
            raw = zlib.decompress(data[TABLE_HEAD.size :])
        except zlib.error as e:
            raise Corrupt("the table is damaged") from e
        if magic != TABLE_MAGIC or scale != SCALE or len(raw) != 4 * n or zlib.crc32(raw) != crc:
            raise Corrupt("the table's checksum or scale differs")
        return Table(np.frombuffer(raw, "<u4").astype(np.int64))


def write_block(table: Table, docs: list[int | None], lens: list[int], ids: np.ndarray, lanes: int, every: int) -> bytes:
    marks, words = table.encode(ids, lanes, every)
    body = b"".join([
        np.array([0 if d is None else d for d in docs], "<i8").tobytes(),
        np.array([d is None for d in docs], "u1").tobytes(),
        np.array(lens, "<u4").tobytes(),
        *(struct.pack("<I", at) + s.astype("<u8").tobytes() for at, s in marks),
        words.astype("<u4").tobytes(),
    ])
    counts = (MAGIC, len(body), len(docs), len(ids), lanes, every, len(marks), len(words))
    crc = zlib.crc32(body, zlib.crc32(HEAD.pack(*counts, 0, 0)))
    return HEAD.pack(*counts, crc, zlib.crc32(ids.astype("<u4").tobytes())) + body


def read_block(table: Table, block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, token ids); raises Corrupt."""
    if len(block) < HEAD.size or block[:8] != MAGIC:
        raise Corrupt("not a block")
    _, size, n_docs, n, lanes, every, n_marks, n_words, crc, ids_crc = HEAD.unpack_from(block)
    body = memoryview(block)[HEAD.size :]
    head = HEAD.pack(MAGIC, size, n_docs, n, lanes, every, n_marks, n_words, 0, 0)
    if len(body) != size or zlib.crc32(body, zlib.crc32(head)) != crc:
        raise Corrupt("the payload's checksum differs")
    docs, nulls, lens = np.frombuffer(body, "<i8", n_docs), np.frombuffer(body, "u1", n_docs, 8 * n_docs), np.frombuffer(body, "<u4", n_docs, 9 * n_docs)
    at, width = 13 * n_docs, 4 + 8 * lanes
    words = np.frombuffer(body, "<u4", n_words, at + n_marks * width)
    marks = np.frombuffer(body, np.dtype([("at", "<u4"), ("state", "<u8", (lanes,))]), n_marks, at)
    ids = table.decode(n, lanes, every, marks["at"], marks["state"].astype(np.uint64), words) if n_marks else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise Corrupt("the ids' checksum differs")
    return [None if z else d for d, z in zip(docs.tolist(), nulls.tolist(), strict=True)], lens, ids


def tokenized(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id, ids: one row per document, its ids as little-endian unsigned 32-bit integers."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(path)
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([narrow(enc.ids(x) + end) for x in batch.column(1).to_pylist()], pa.binary())], ["id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, ids binary")


def narrow(ids: bytes) -> bytes:
    """A mark and the ids, in 16 bits each where they fit."""
    wide = np.frombuffer(ids, "<u4")
    return b"2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"4" + ids


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"2" else "<u4", offset=1).astype(np.uint32)


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs, over all rows; what reaches the driver is bounded by the vocabulary."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.bincount(widened(data), minlength=size) if len(data) > size else 0
            short = [widened(x) for x in batch.column(0).to_pylist() if len(x) <= size]
            if short:
                total += np.bincount(np.concatenate(short), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token", "n"])

    counts = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r.token] = r.n
    return counts


BLOCKS = "part int, path string, at bigint, size bigint, n_docs bigint, n_tokens bigint, before bigint"
_BLOCKS = pa.schema([("part", pa.int32()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64())])


def write_files(docs: DataFrame, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 18, lanes: int = 1024, every: int = 64, parts: int | None = None) -> str:
    """Writes the files; the folder. Its table `blocks` lists (part, path, at, size, n_docs, n_tokens,
    before: ids of the part's earlier blocks)."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    tokens = stored(tokenized(docs, path, end_id, id_col, text_col).withColumn("hash", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id()), "tokens")
    size = max(encoder(path).tokenizer.get_vocab_size(), end_id + 1)
    counts = count_ids(tokens, size)
    freq = frequencies(counts)
    root, table_of = shared_dir(spark, "token-files"), {}
    Table(freq).save(f"{root}/table.bin")
    shared = spark.sparkContext.broadcast(freq)  # as large as the vocabulary

    def run(batches):
        part, table = TaskContext.get().partitionId(), table_of.setdefault("table", Table(shared.value))
        out, rows, hold, at, before = None, [], [], 0, 0
        uri = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.ids"  # a repeated task writes a file of its own

        def flush():
            nonlocal out, at, before
            if out is None:
                files, name = scratch_fs(uri)
                files.create_dir(name.rpartition("/")[0], recursive=True)
                out = files.open_output_stream(name)
            ids = np.concatenate([x for _, x in hold])
            block = write_block(table, [d for d, _ in hold], [len(x) for _, x in hold], ids, lanes, every)
            out.write(block)
            rows.append((part, uri, at, len(block), len(hold), len(ids), before))
            at, before = at + len(block), before + len(ids)
            hold.clear()

        held = 0
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hold.append((doc, widened(data)))
                held += len(hold[-1][1])
                if held >= block_tokens:
                    flush()
                    held = 0
        if hold:
            flush()
        if out is not None:
            out.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)

    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // RANGE_TOKENS))
    ordered = tokens.repartitionByRange(parts, "id", "hash", "row").sortWithinPartitions("id", "hash", "row")
    ordered.select("id", "ids").mapInArrow(run, BLOCKS).write.parquet(f"{root}/blocks")
    released(tokens)
    return root


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """id, start, ids: one row per document, from the folder's files. start counts the ids before it."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{root}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row per part
    begin, firsts = 0, []
    for r in totals:
        firsts.append((r.part, begin))
        begin += r.n
    starts = spark.createDataFrame(firsts, "part int, first bigint")

    def run(batches):
        table = Table.load(f"{root}/table.bin")
        for batch in batches:
            for r in batch.to_pylist():
                files, name = scratch_fs(r["path"])
                with files.open_input_file(name) as f:
                    f.seek(r["at"])
                    docs, lens, ids = read_block(table, f.read(r["size"]))
                ends = np.cumsum(lens, dtype=np.int64)
                starts = ends - lens + r["first"] + r["before"]
                data, cuts = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array([data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["id", "start", "ids"])

    rows = blocks.join(starts, "part").select("path", "at", "size", "before", "first")
    return rows.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "at").mapInArrow(run, "id bigint, start bigint, ids binary")


def op6_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(spark, write_files(documents(spark, sf_dir))).select(F.col("id").alias("doc_id"), "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
