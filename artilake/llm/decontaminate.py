"""Benchmark decontamination by the q-gram lemma.

Item and document are compared as normalised text: lower case, each run of characters that are
neither letters nor digits as one space. A region of a document matches an item of n characters
when one can be turned into the other with at most e = floor(BUDGET * n) edits. By the q-gram lemma
such a region shares at least n + 1 - q * (e + 1) q-grams with the item, on diagonals that differ
by e at most. q is Q, or for an item where that bound would not be positive the largest q with
q * (e + 1) <= n; items are indexed by their q, so that e is never cut. Shared q-grams are counted in diagonal bands of width 2 * (e + 1) that overlap by
half, so that every such set of diagonals lies whole in one band; bands below the bound are
dropped, and the others are verified by a banded semi-global alignment.

The items are sent to the executors in blocks of bounded size (BLOCK_CHARS): a stated query set
against all rows. Items too short to be allowed an edit are compared by equality of
their words in sequence. Very long texts are searched whole, in overlapping halves where they share
very many q-grams with the items. Null and empty texts and items match nothing. Repeated rows and repeated
items match each. An empty table on either side gives an empty result. Other columns of the inputs
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .tokens import small_batches

Q, BUDGET = 12, 0.07
BLOCK_CHARS = 4_000_000
#: Texts that share more q-grams with the items of one q are searched in overlapping halves.
MOST_HITS = 8_000_000
BETWEEN = re.compile(r"[\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def normal(text: str | None) -> str:
    return BETWEEN.sub(" ", text.lower()).strip() if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def grams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hashes of all q-grams; equal grams, equal hashes."""
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h *= BASE
        h += x[k : k + n]
    h ^= h >> np.uint64(29)
    return h


def edits(item: np.ndarray, text: np.ndarray, most: int, low: int = 0, high: int | None = None) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of the whole item inside text that begins at low to high;
    None beyond `most`.

    A row by item character; a column by diagonal (place in the text less place in the item), and only
    the diagonals that `most` edits can reach from where the match may begin. Columns are handled at
    once: the running minimum resolves the insertions of a row."""
    n, high = len(text), len(text) if high is None else min(high, len(text))
    diagonal = np.arange(low - most, high + most + 1)
    far, steps = len(item) + most + 1, np.arange(len(diagonal))
    cost = np.where((diagonal >= max(low, 0)) & (diagonal <= high), 0, far)
    begin = diagonal.copy()
    padded = np.concatenate([np.full(most + len(item) + max(0, -low) + 1, -1), text.astype(np.int64), np.full(most + len(item) + 1, -1)])
    shift = most + len(item) + max(0, -low) + 1
    for i, c in enumerate(item):
        at = diagonal + i  # the text's character that this diagonal sets against the item's
        inside = (at >= 0) & (at < n)
        across = np.where(inside, cost + (padded[at[0] + shift : at[-1] + shift + 1] != c), far)
        down = np.append(cost[1:], far) + 1  # the item's character has no counterpart
        best = np.minimum(across, down)
        came = np.where(across <= down, begin, np.append(begin[1:], 0))
        best = np.where((at + 1 >= 0) & (at < n), np.minimum(best, far), far)
        key = (best - steps) * (len(steps) + 1) + steps  # cost of coming from each column on the left, nearest last
        left = np.minimum.accumulate(key) % (len(steps) + 1)
        cost, begin = best[left] + steps - left, came[left]
        if cost.min() > most:
            return None
    ends = np.where(diagonal + len(item) <= n, cost, far)
    k = int(ends.argmin())
    return (int(ends[k]), int(begin[k]), int(diagonal[k]) + len(item)) if ends[k] <= most else None


class Grams:
    """The q-grams of the items of a block that share one q."""

    def __init__(self, items: list[tuple[int, np.ndarray, str, int]], q: int):
        self.q, self.items = q, items
        made = [grams(x, q) for _, x, _, _ in items]
        flat, n = np.concatenate(made), [len(g) for g in made]
        order = np.argsort(flat, kind="stable")
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.last = np.append(self.first[1:], len(flat))
        self.owner = np.repeat(np.arange(len(items)), n)[order]
        self.place = np.concatenate([np.arange(k) for k in n])[order]
        self.marks = np.zeros(1 << 22, bool)
        self.marks[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.budget = np.array([i[3] for i in items], np.int64)
        self.bound = np.array([len(i[1]) + 1 - q * (i[3] + 1) for i in items], np.int64)
        self.reach = max(len(i[1]) + i[3] for i in items)  # no region is longer

    def shared(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in g, its key, how often the items have it) of every q-gram that items have."""
        pos = np.flatnonzero(self.marks[(g >> np.uint64(42)).astype(np.int64)])
        k = np.searchsorted(self.keys, g[pos])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == g[pos]
        pos, k = pos[same], k[same]
        return pos, k, self.last[k] - self.first[k]

    def matches(self, text: str, g: np.ndarray, start: int = 0) -> Iterator[tuple[int, int, int, int]]:
        """(item id, start, end, edits) in the normalised text, whose q-grams from `start` on are g; one region per item and band."""
        pos, k, n = self.shared(g)
        if not len(pos):
            return
        if n.sum() > MOST_HITS and len(g) > 2 * self.reach:  # every region lies whole in one half
            middle = len(g) // 2
            yield from self.matches(text, g[: middle + self.reach], start)
            yield from self.matches(text, g[middle:], start + middle)
            return
        at = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pos, owner, place = np.repeat(pos, n) + start, self.owner[at], self.place[at]
        width = self.budget[owner] + 1
        diagonal = pos - place
        half = diagonal // width  # band k holds the diagonals of halves k and k + 1
        owner, band = np.concatenate([owner, owner]), np.concatenate([half, half - 1])
        order = np.lexsort((band, owner))
        o, b = owner[order], band[order]
        new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (b[1:] != b[:-1])])
        size = np.diff(np.r_[new, len(o)])
        enough = size >= self.bound[o[new]]
        for s in new[enough]:
            item, y, plain, e = self.items[o[s]]
            low, high = max(0, int(b[s]) * (e + 1) - e), min(len(text), (int(b[s]) + 2) * (e + 1) + len(y) + e)
            at = text.find(plain, low, high)
            if at >= 0:  # aligned without an edit
                yield item, at, at + len(plain), 0
            elif found := edits(y, codes(text[low:high]), e, int(b[s]) * (e + 1) - e - low, (int(b[s]) + 2) * (e + 1) + e - low):
                yield item, low + found[1], low + found[2], found[0]


class Index:
    """A block of items: short ones, and the others by their q."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, budget: float = BUDGET):
        if not 0 <= budget < 1:
            raise ValueError("budget: at least 0 and below 1")
        self.short, by_q = [], {}
        for item, text in items:
            plain = normal(text)
            if not plain:
                continue
            if int(budget * len(plain)) == 0:
                self.short.append((item, f" {plain} "))
                continue
            x = codes(plain)
            e = int(budget * len(x))
            by_q.setdefault(min(q, len(x) // (e + 1)), []).append((item, x, plain, e))
        self.parts = [Grams(part, n) for n, part in by_q.items()]

    def matches(self, text: str, at: int, made: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(item id, start, end, edits) in the normalised text; made: by part, the q-grams of texts of which this one begins at `at`."""
        padded = f" {text} "
        for item, plain in self.short:
            found = padded.find(plain)
            while found >= 0:
                yield item, found, found + len(plain) - 2, 0
                found = padded.find(plain, found + 1)
        for part, g in zip(self.parts, made, strict=True):
            yield from part.matches(text, g[at : at + max(0, len(text) - part.q + 1)])

    def scan(self, texts: list[str | None]) -> Iterator[Iterator[tuple[int, int, int, int]]]:
        """matches() of each text; the q-grams of all are made at once."""
        plain = [normal(x) for x in texts]
        joined, at = "\0".join(plain), 0
        made = [grams(codes(joined + "\0" * part.q), part.q) for part in self.parts]
        for text in plain:
            yield self.matches(text, at, made)
            at += len(text) + 1


def item_blocks(items: list[tuple[int, str | None]], chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for item, text in items:
        if block and size + len(text or "") > chars:
            yield block
            block, size = [], 0
        block.append((item, text or ""))
        size += len(text or "")
    if block:
        yield block


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, budget: float = BUDGET) -> DataFrame:
    """id, item_id, start, end, edits: the regions of the normalised documents that match an item."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    out = None
    wanted = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("text"))
    schema = "id bigint, item_id bigint, start bigint, end bigint, edits bigint"
    for block in item_blocks([(r.item, r.text) for r in wanted.toLocalIterator()]):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_CHARS and one item at most

        def run(batches, shared=shared):
            index = Index(shared.value, q, budget)
            for batch in small_batches(batches, 500):
                found = []
                for doc, regions in zip(batch.column(0).to_pylist(), index.scan(batch.column(1).to_pylist()), strict=True):
                    best: dict[tuple[int, int, int], int] = {}
                    for item, a, b, e in regions:
                        best[item, a, b] = min(e, best.get((item, a, b), e))
                    found += [(doc, item, a, b, e) for (item, a, b), e in best.items()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["id", "item_id", "start", "end", "edits"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = Q, budget: float = BUDGET) -> DataFrame:
    """The rows, all columns, that hold no item."""
    at, out = docs.columns.index(text_col), docs
    wanted = items.select(F.col("item_id").cast("bigint").alias("item"), F.col("text"))
    for block in item_blocks([(r.item, r.text) for r in wanted.toLocalIterator()]):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = Index(shared.value, q, budget)
            for batch in small_batches(batches, 500):
                clean = [not next(found, None) for found in index.scan(batch.column(at).to_pylist())]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op7_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")
