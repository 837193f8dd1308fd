"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of training texts. A text is
compressed (its words in lower case, one space between) once with each dictionary, and the language whose dictionary gives the smallest result
is chosen; a narrow margin marks the row as rejected (the choice stays in lang_pred).

Text that is null or has no letter: `und`, score 0, rejected. Equal sizes: the language with more
training documents, then the first by name. Rows with null text or null language are not learned
from. Repeated rows are scored each. Very long texts are compressed whole. If nothing was learned, every prediction is `und`. An empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, id_remainder
from .tokens import small_batches

LETTER = re.compile(r"[^\W\d_]")
BETWEEN = re.compile(r"[\W\d_]+")
#: Documented bounds of the sample that a dictionary is made of, for each language: documents, bytes,
#: and characters of one text, of which longer ones give PIECES pieces that lie evenly over them.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_CHARS, PIECES = 400, 1 << 18, 4000, 4
#: Rejected below this many saved bytes, or below this share of the text's compressed size.
MARGIN_BYTES, MARGIN_SHARE = 2, 0.002
LEVEL = 3


def plain(text: str) -> bytes:
    """Lower-case words with one space between."""
    return BETWEEN.sub(" ", text.lower()).encode()


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, normal=plain) -> list[tuple[str, bytes]]:
    """(language, dictionary content), most documents first. `sample_docs` documents of each language
    at most are drawn by a hash of their id and text; each adds its text, or pieces of it, until the bytes are full."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # one row per language
    text, n, size = F.col(text_col), F.length(text_col), SAMPLE_CHARS // PIECES
    parts = [F.substring(text, F.floor((n - size) * k / (PIECES - 1)).cast("int") + 1, F.lit(size)) for k in range(PIECES)]
    bounded = F.when(n > SAMPLE_CHARS, F.concat_ws(" ", *parts)).otherwise(text)
    # rows and bytes are bounded on the executors: a first draw by chance, then the exact number by rank
    known = F.broadcast(labelled.sparkSession.createDataFrame([(lang, 4 * sample_docs / m) for lang, m in sizes.items()] or [("", 0.0)], "_lang string, _chance double"))
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    drawn = rows.select(F.col(lang_col).alias("_lang"), bounded.alias("_text"), order.alias("_order")).join(known, "_lang").where(F.pmod("_order", F.lit(1 << 30)) < F.col("_chance") * float(1 << 30))
    by = Window.partitionBy("_lang").orderBy("_order", "_text")
    picked = drawn.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= sample_docs).select("_lang", "_text", "_k").collect()
    out = []
    for lang in sorted(sizes, key=lambda x: (-sizes[x], x)):
        content, room = [], sample_bytes
        for r in sorted((r for r in picked if r[0] == lang), key=lambda r: r[2]):
            data = normal(r[1])[:room]
            if data and data not in content:
                content.append(data)
                room -= len(data)
        out.append((lang, b"\n".join(content[::-1])))
    return out


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int = LEVEL, normal=plain):
        import zstandard as z

        self.normal = normal
        self.langs, self.coders = [], []
        for lang, content in dictionaries:
            known = z.ZstdCompressionDict(content or b"\n" * 8, dict_type=z.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.langs.append(lang)
            self.coders.append(z.ZstdCompressor(level=level, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = self.normal(text)
        return [len(c.compress(data)) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, bool, int]:
        """(language, score, rejected, margin in bytes)"""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, True, 0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        margin = min((s for k, s in enumerate(sizes) if k != best), default=sizes[best] + MARGIN_BYTES) - sizes[best]
        return self.langs[best], 1 - 0.5 * math.exp(-margin / 4), margin < max(MARGIN_BYTES, MARGIN_SHARE * sizes[best]), margin


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", level: int = LEVEL) -> DataFrame:
    """id, lang_pred, score, rejected, margin: learned from the rows where `train` holds."""
    learned = docs.sparkSession.sparkContext.broadcast(learn(docs.where(train), text_col, lang_col, id_col))  # SAMPLE_BYTES a language

    def run(batches):
        of = Classifier(learned.value, level)
        for batch in small_batches(batches):
            found = [of.predict(x) for x in batch.column(1).to_pylist()]
            langs, scores, rejected, margins = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores, pa.float64()), pa.array(rejected), pa.array(margins, pa.int64())], ["id", "lang_pred", "score", "rejected", "margin"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, lang_pred string, score double, rejected boolean, margin bigint")


def op8_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, id_remainder("doc_id", 5) != 0)
    return found.select(F.col("id").alias("doc_id"), (id_remainder("id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected", "margin")
