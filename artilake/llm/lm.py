"""Language-model scores by deleted interpolation.

A token's probability mixes its maximum-likelihood estimate after the token before it, the one
without context, and the uniform one. The weights depend on the context's frequency bucket and are
learned by expectation-maximisation on held-out counts: each training event is deleted from the
counts that predict it. Counts and events cover all training documents.

Documents are tokenised once into chunk files in the shared folder. Tokens and pairs of tokens
travel as sorted blocks of hashes, one block for each chunk and hash range, to the task that adds up
the range; the sums travel back to the chunk in the same order. So a frequent token is one entry for
each chunk, and no task holds more than a range or a chunk; the number of ranges grows with the bytes
of text. Tokens and pairs are told apart by 64-bit hashes. Very long texts are one document of a chunk.

Null and empty texts hold the end token alone. The context of a document's first token is the end
token. A null id counts as the empty text for the split into training and held-out rows. Repeated
rows are counted and scored each. If nothing is learned from, base and model give every token the
probability 1 / (V + 1) = 1 / 1. An empty table gives an empty result. Other columns of the input
are ignored.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_remainder, ranges, scratch_fs, shared_dir, stored
from .words import by_bytes, word_codes

#: Bytes of text of a chunk, and of text for which there is one hash range and one task.
CHUNK_BYTES, RANGE_BYTES = 8_000_000, 32_000_000
SLICE_BYTES = 1_000_000
END = 0x9D8A7C6B5E4F3021  # stands for the end token; not the hash of a word in any likelihood
BUCKETS, STEPS = 24, 8  # context buckets by powers of two; histogram steps for a power of two
FLOOR = 1e-4  # of the uniform part's weight
ROUNDS = 60
BLOCK = "path string, shard int, codes binary, counts binary"
SUMS = "path string, shard int, sums binary, n_distinct bigint, n_total bigint"


def token_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words and, after each text's, the end token; number of tokens of each text)"""
    codes, n = word_codes(texts)
    return np.insert(codes, np.cumsum(n), np.uint64(END)), n + 1


def squeezed(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), a.nbytes) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def spread(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    kinds = [struct.unpack_from("<2sQ", raw, 4 + 10 * k) for k in range(n)]
    out, at = [], 4 + 10 * n
    for kind, size in kinds:
        dtype = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(raw, dtype, size // dtype.itemsize, at))
        at += size
    return out


def put(uri: str, data: bytes) -> None:
    files, name = scratch_fs(uri)
    files.create_dir(name.rpartition("/")[0], recursive=True)
    with files.open_output_stream(name) as f:
        f.write(data)


def get(uri: str) -> bytes:
    files, name = scratch_fs(uri)
    with files.open_input_file(name) as f:
        return f.read()


def blocks(path: str, codes: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """The sorted codes, cut into one block for each range of hashes."""
    shard = ((codes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    rows = [(path, k, squeezed(codes[a:b]), squeezed(counts[a:b].astype("<u4"))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    cols = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["path", "shard", "codes", "counts"])


def add_up(table: pa.Table) -> pa.Table:
    """One range of hashes: for each chunk's block the sums over all chunks, in the block's order."""
    codes = [spread(x)[0] for x in table["codes"].to_pylist()]
    counts = [spread(x)[0].astype(np.int64) for x in table["counts"].to_pylist()]
    values, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(values)).astype(np.int64)
    sums, begin = [], 0
    for c in codes:
        sums.append(squeezed(total[at[begin : begin + len(c)]]))
        begin += len(c)
    n = len(sums)
    first = [1] + [0] * (n - 1)
    return pa.table([table["path"], table["shard"], pa.array(sums, pa.binary()), pa.array([int((total > 0).sum()) * k for k in first], pa.int64()), pa.array([int(total.sum()) * k for k in first], pa.int64())], ["path", "shard", "sums", "n_distinct", "n_total"])


def sums_of(table: pa.Table) -> np.ndarray:
    """A chunk's sums, in the order of its sorted codes."""
    rows = sorted(zip(table["shard"].to_pylist(), table["sums"].to_pylist(), strict=True))
    return np.concatenate([spread(s)[0] for _, s in rows])


class Chunk:
    """Tokens of some documents: ids, null marks, training marks, lengths, and for each token its
    place in the sorted list of the chunk's codes."""

    def __init__(self, path: str):
        self.ids, self.null, self.train, self.lens, self.at, self.codes = spread(get(path))
        self.of = np.repeat(np.arange(len(self.lens)), self.lens)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct pair codes, place of each token's pair in them, each token's context)"""
        starts = np.cumsum(self.lens) - self.lens
        before = np.empty(len(self.at), self.at.dtype)
        before[1:] = self.at[:-1]
        before[starts] = np.searchsorted(self.codes, np.uint64(END))
        h = self.codes[before] * np.uint64(0x9E3779B97F4A7C15) + self.codes[self.at] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        values, at = np.unique(h, return_inverse=True)
        return values, at, before


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(context, 0) + 1.0).astype(np.int64), BUCKETS - 1)


def binned(p: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + the number of the histogram step below 1."""
    out = np.zeros(len(p), np.int64)
    some = p > 0
    out[some] = 1 + np.rint(-np.log2(p[some]) * STEPS).astype(np.int64)
    return out


def unbinned(b: np.ndarray) -> np.ndarray:
    return np.where(b == 0, 0.0, 2.0 ** (-(b - 1) / STEPS))


def learn_weights(hist: list[tuple[int, int, int, int]], v: int) -> np.ndarray:
    """Weights (pair, single, uniform) of each bucket, from (bucket, pair bin, single bin, events)."""
    out = np.tile([0.0, 1 - FLOOR, FLOOR], (BUCKETS, 1))
    h = np.array(hist, np.int64).reshape(-1, 4)
    for b in np.unique(h[:, 0]):
        own = h[h[:, 0] == b]
        p = np.stack([unbinned(own[:, 1]), unbinned(own[:, 2]), np.full(len(own), 1 / (v + 1))], 1)
        n, w = own[:, 3].astype(float), np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            post = p * w
            w = (post / post.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
        out[b] = w * (1 - FLOOR)
        out[b, 2] += FLOOR
    return out


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score: learned from the rows that aren't held out."""
    spark = docs.sparkSession
    shards = ranges(docs, text_col, RANGE_BYTES)
    root = shared_dir(spark, "lm-chunks")

    def tokenise(batches):
        hold, size = [], 0

        def flush():
            path = f"{root}/{uuid.uuid4().hex}"
            ids, null, train, lens, tokens = (np.concatenate(x) for x in zip(*hold, strict=True))
            codes, at = np.unique(tokens, return_inverse=True)
            put(path, squeezed(ids.astype("<i8"), null.astype("<u2"), train.astype("<u2"), lens.astype("<u4"), at.astype("<u4"), codes))
            counts = np.bincount(at[np.repeat(train, lens)], minlength=len(codes))
            hold.clear()
            return blocks(path, codes, counts, shards)

        for batch in by_bytes(batches, 2, min(SLICE_BYTES, chunk_bytes)):
            tokens, lens = token_codes(batch.column(2))
            ids = batch.column(0)
            hold.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), ~batch.column(1).to_numpy(zero_copy_only=False), lens, tokens))
            size += batch.column(2).nbytes
            if size >= chunk_bytes:
                yield flush()
                size = 0
        if hold:
            yield flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    single = stored(rows.mapInArrow(tokenise, BLOCK).repartition(shards, "shard").groupBy("shard").applyInArrow(add_up, SUMS), "lm-single")
    n, v = single.agg(F.coalesce(F.sum("n_total"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()

    def pair_blocks(table: pa.Table) -> pa.Table:
        path = table["path"][0].as_py()
        chunk = Chunk(path)
        put(path + ".single", squeezed(sums_of(table)))
        values, at, _ = chunk.pairs()
        counts = np.bincount(at[np.repeat(chunk.train.astype(bool), chunk.lens)], minlength=len(values))
        return pa.Table.from_batches([blocks(path, values, counts, shards)])

    pairs = stored(single.select("path", "shard", "sums").repartition(shards, "path").groupBy("path").applyInArrow(pair_blocks, BLOCK).repartition(shards, "shard").groupBy("shard").applyInArrow(add_up, SUMS).drop("n_distinct", "n_total"), "lm-pairs")

    def counted(table: pa.Table) -> tuple:
        """(chunk, count of each token, of its context, of its pair)"""
        path = table["path"][0].as_py()
        chunk, of_single, of_pair = Chunk(path), spread(get(path + ".single"))[0], sums_of(table)
        _, at, before = chunk.pairs()
        return chunk, of_single[chunk.at], of_single[before], of_pair[at]

    def events(table: pa.Table) -> pa.Table:
        chunk, c, h, both = counted(table)
        train = np.repeat(chunk.train.astype(bool), chunk.lens)
        c, h, both = c[train] - 1, h[train] - 1, both[train] - 1
        p2 = np.where(h > 0, both / np.maximum(h, 1), 0.0)
        key = (bucket(h) << 40) | (binned(np.minimum(p2, 1.0)) << 20) | binned(c / max(n - 1, 1))
        keys, m = np.unique(key, return_counts=True)
        return pa.table([pa.array(keys, pa.int64()), pa.array(m, pa.int64())], ["key", "n"])

    by_chunk = pairs.repartition(shards, "path").groupBy("path")
    hist = by_chunk.applyInArrow(events, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()  # bounded by buckets and steps
    weights = learn_weights([(r.key >> 40, r.key >> 20 & 0xFFFFF, r.key & 0xFFFFF, r.n) for r in hist], v)

    def scores(table: pa.Table) -> pa.Table:
        chunk, c, h, both = counted(table)
        w, docs_n = weights[bucket(h)], len(chunk.lens)
        p = w[:, 0] * np.where(h > 0, np.minimum(both / np.maximum(h, 1), 1.0), 0.0) + w[:, 1] * (c / max(n, 1)) + w[:, 2] / (v + 1)
        add = lambda x: np.bincount(chunk.of, x, docs_n)
        base = np.log10((c + 1.0) / (n + (v + 1.0)))
        ids = pa.array(chunk.ids, pa.int64(), mask=chunk.null.astype(bool))
        return pa.table(
            [ids, pa.array(chunk.train == 0), pa.array(chunk.lens.astype(np.int64)), pa.array(add(c > 0).astype(np.int64)), pa.array(np.full(docs_n, n, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return by_chunk.applyInArrow(scores, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), id_remainder("doc_id", 7) == 2).withColumnRenamed("id", "doc_id")
