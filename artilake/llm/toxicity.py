"""Toxicity: a counterfactual-regularised classifier.

A logistic regression over how densely words and their beginnings stand in a text. During training, identity terms in labelled
sentences are swapped for other terms of their group, and the squared change of the sentence's
score is penalised, so that naming a group moves the score little by itself. The groups are a list
that the caller may give (IDENTITY) and groups found in the labelled rows themselves: words that
stand in documents of both classes about equally often, put together by the words around them.

The model is fitted on a bounded, documented sample of the labelled training rows (SAMPLE_DOCS of
each class at most, drawn by a hash of the id; of a text over SAMPLE_CHARS characters PIECES pieces
spread over it, of each text SWAPS sentences to swap); it scores every whole text, however long. Null and empty texts
have no words: their score is that of the intercept. A label that is null or neither 0 nor 1 is
not learned from. Where several labels exist for an id, each counts. If one class is missing the
score is the share of that class. Repeated rows are scored each. An empty table gives an empty
result. Other columns of the input are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_remainder
from .tokens import small_batches

#: Documented bounds of the fit: documents of each class, words of the model, characters of a text and pieces of longer ones.
SAMPLE_DOCS, WORDS, SAMPLE_CHARS, PIECES = 3000, 4000, 20_000, 5
#: Swap terms found in the rows: so many, in groups of so many, each in so many documents of either class,
#: so many times as often in one class as in the other at most, in this share of all documents at most.
TERMS, GROUP_SIZE, TERM_DOCS, SKEW, COMMON = 240, 8, 3, 3.0, 0.2
#: Sentences of a text that are swapped, and hashed places for the words before and after a term.
SWAPS, CONTEXTS = 4, 256
#: So many sampled (id, label) rows are broadcast, so that no text is shuffled; beyond it the texts are.
BROADCAST_ROWS = 100_000
RIDGE, SWAP_PENALTY, ROUNDS = 2e-4, 1.0, 300
#: The chance that any word of the model is unrelated to the label (chi-squared test, Bonferroni bound).
CHANCE = 0.05
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Identity terms, by group: a term is swapped for another of its group.
IDENTITY = (
    ("christian", "jewish", "muslim", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer", "transgender"),
    ("man", "woman", "male", "female", "men", "women", "boy", "girl"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish", "british"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young", "old"),
)
#: Lengths of the beginnings of words that are features too.
STEMS = (5, 6, 7)
#: One occurrence in so many words counts in full, sparser ones in proportion.
DENSE = 100


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def forms(words: Iterable[str]) -> set[str]:
    """The words and their longer beginnings, so that forms of one stem count together."""
    out = set(words)
    return out | {w[:n] + "-" for w in out for n in STEMS if len(w) > n}


def features(text: str | None, known: frozenset[str] | None = None) -> dict[str, float]:
    """The forms in the text (those known, if given), each with how dense it stands: 1 from one in DENSE words on."""
    words = Counter(WORD.findall(text.lower())) if text else Counter()
    size, out = DENSE / max(1, words.total()), Counter()
    for w, n in words.items():
        for form in (w, *(w[:k] + "-" for k in STEMS if len(w) > k)):
            if known is None or form in known:
                out[form] += n
    return {form: min(1.0, n * size) for form, n in out.items()}


def swapped(sentence: set[str], of: dict[str, Sequence[str]], rng: random.Random) -> set[str] | None:
    """The sentence's words with each term replaced by another of its group; None if it has none."""
    terms = sentence & of.keys()
    if not terms:
        return None
    return (sentence - terms) | {rng.choice([t for t in of[x] if t != x]) for x in sorted(terms)}


def swap_groups(texts: Sequence[str], labels: Sequence[int], terms: int = TERMS) -> list[tuple[str, ...]]:
    """Groups of words that both classes use alike: the commonest of them that are no words of every
    text, each group the words whose neighbours are most like those of its commonest word."""
    seen = [Counter(), Counter()]
    for text, label in zip(texts, labels, strict=True):
        seen[label].update(w for w in words_of(text) if len(w) > 3)
    n = [max(1, sum(1 for y in labels if y == k)) for k in (0, 1)]

    def alike(w: str) -> bool:
        a, b = seen[0][w] / n[0], seen[1][w] / n[1]
        return min(seen[0][w], seen[1][w]) >= TERM_DOCS and max(a, b) <= min(SKEW * min(a, b), COMMON)

    found = sorted((w for w in seen[1] if alike(w)), key=lambda w: (-seen[0][w] - seen[1][w], w))[:terms]
    place = {w: k for k, w in enumerate(found)}
    around = np.zeros((len(found), 2 * CONTEXTS))
    for text in texts:
        row = WORD.findall(text.lower())
        for k, w in enumerate(row):
            if w in place:
                for side, at in ((0, k - 1), (CONTEXTS, k + 1)):
                    if 0 <= at < len(row):
                        around[place[w], side + zlib.crc32(row[at].encode()) % CONTEXTS] += 1
    around = np.sqrt(around)
    around /= np.maximum(np.linalg.norm(around, axis=1, keepdims=True), 1e-9)
    like, free, out = around @ around.T, list(range(len(found))), []
    while len(free) > 1:
        head = free[0]
        near = sorted(free[1:], key=lambda k: (-like[head, k], k))[: GROUP_SIZE - 1]
        out.append(tuple(found[k] for k in (head, *near)))
        free = [k for k in free[1:] if k not in near]
    return out


class Model:
    def __init__(self, weights: dict[str, float], bias: float, pairs: int = 0, groups: Sequence[Sequence[str]] = ()):
        """pairs: swapped sentences of the fit; groups: what was swapped."""
        self.weights, self.bias, self.known, self.pairs, self.groups = weights, bias, frozenset(weights), pairs, groups

    def score(self, text: str | None) -> float:
        z = self.bias + sum(sorted(self.weights[form] * v for form, v in features(text, self.known).items()))
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))


def fit(texts: list[str], labels: list[int], prior: float, words: int = WORDS, ridge: float = RIDGE, penalty: float = SWAP_PENALTY, rounds: int = ROUNDS, chance: float = CHANCE, seed: int = 7, identity: Sequence[Sequence[str]] = IDENTITY, terms: int = TERMS) -> Model:
    """`prior`: the share of toxic documents among all labelled ones, of which the texts are a sample by class.
    `identity`: groups of terms to swap; up to `terms` terms more are found in the texts."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = min(max(prior, 1e-6), 1 - 1e-6)
        return Model({}, float(np.log(share / (1 - share))))
    of = [Counter(), Counter()]  # only dense forms are counted, and only the model's are held for each text
    for text, label in zip(texts, labels, strict=True):
        of[label].update(w for w, v in features(text).items() if v >= 0.5)
    n = [float((y == k).sum()) for k in (0, 1)]

    def gain(w: str) -> float:  # chi-squared of presence against class
        a, b = of[1][w], of[0][w]
        c, d = n[1] - a, n[0] - b
        return len(y) * (a * d - b * c) ** 2 / max(1.0, n[0] * n[1] * (a + b) * (c + d))

    often = [w for w in of[0].keys() | of[1].keys() if of[0][w] + of[1][w] >= 3]
    # chance alone lets a word pass in one fit of 1 / CHANCE: without this, rare words of few toxic documents drown the telling ones
    least = NormalDist().inv_cdf(1 - chance / (2 * max(1, len(often)))) ** 2
    telling = [w for w in often if gain(w) >= least]
    groups = [*identity, *swap_groups(texts, labels, terms)]
    group_of = {term: group for group in groups for term in group}
    vocab = {w: k for k, w in enumerate(sorted(telling, key=lambda w: (-gain(w), w))[:words])}
    vocab |= {w: len(vocab) + k for k, w in enumerate(sorted(group_of.keys() - vocab.keys()))}

    def matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
        cols = [[vocab[w] for w in s if w in vocab] for s in rows]
        return np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.array([c for x in cols for c in x], np.int64)

    rng = random.Random(seed)
    pairs = []
    for text in texts:
        some = [here for part in SENTENCE.split(text or "") if (here := words_of(part)) & group_of.keys()]
        for here in some if len(some) <= SWAPS else rng.sample(some, SWAPS):
            here, other = forms(here), forms(swapped(here, group_of, rng))
            pairs.append(((here - other) & vocab.keys(), (other - here) & vocab.keys()))
    sets = [features(t, frozenset(vocab)) for t in texts]
    rows, cols = matrix(sets)
    value = np.array([v for s in sets for w, v in s.items() if w in vocab], float)
    gone_r, gone_c = matrix([a for a, _ in pairs])
    come_r, come_c = matrix([b for _, b in pairs])
    w, bias, step = np.zeros(len(vocab)), 0.0, np.zeros(len(vocab) + 1)
    weight = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])  # the classes count alike
    second = np.full(len(vocab) + 1, 1e-8)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols] * value, len(y)) + bias, -40, 40)))
        r = weight * (p - y)
        grad = np.bincount(cols, r[rows] * value, len(w)) + ridge * w
        if pairs:
            move = (np.bincount(come_r, w[come_c], len(pairs)) - np.bincount(gone_r, w[gone_c], len(pairs))) * (penalty / len(pairs))
            grad += np.bincount(come_c, move[come_r], len(w)) - np.bincount(gone_c, move[gone_r], len(w))
        grad = np.append(grad, r.sum())
        step = 0.9 * step + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        change = 0.05 * (step / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        w, bias = w - change[:-1], bias - change[-1]
    return Model({t: float(w[k]) for t, k in vocab.items() if abs(w[k]) > 1e-4}, float(bias), len(pairs), groups)


def spread(text: Column) -> Column:
    """The text, or of one over SAMPLE_CHARS characters the PIECES pieces that lie evenly over it."""
    n, size = F.length(text), SAMPLE_CHARS // PIECES
    parts = [F.substring(text, F.floor((n - size) * k / (PIECES - 1)).cast("int") + 1, F.lit(size)) for k in range(PIECES)]
    return F.when(n > SAMPLE_CHARS, F.concat_ws("\n", *parts)).otherwise(text)


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, **options) -> Model:
    """options: of fit()."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
    ids = docs.where(train).select(F.col(id_col).alias("_id")).join(known, "_id")
    n = {r[0]: r[1] for r in ids.groupBy("_label").count().collect()}
    chance = F.when(F.col("_label") == 1, min(1.0, sample_docs / max(1, n.get(1, 0)))).otherwise(min(1.0, sample_docs / max(1, n.get(0, 0))))
    order = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30))
    picked = known.where(order < chance * float(1 << 30)).join(ids.select("_id").distinct(), "_id", "left_semi")
    if picked.count() <= BROADCAST_ROWS:  # else, as when few ids have very many labels, an ordinary join
        picked = F.broadcast(picked)
    rows = docs.where(train).select(F.col(id_col).alias("_id"), spread(F.col(text_col)).alias("_text")).join(picked, "_id")
    sample = []
    for label in (0, 1):  # rows and bytes are bounded before they leave the executors
        own = rows.where(F.col("_label") == label).withColumn("_order", order)
        sample += own.orderBy("_order", "_id", F.xxhash64("_text")).limit(sample_docs).collect()
    sample.sort(key=lambda r: (r["_id"], r["_label"], r["_text"] or ""))
    prior = n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0))
    return fit([r["_text"] or "" for r in sample], [r["_label"] for r in sample], prior, **options)


def swap_change(model: Model, texts: Iterable[str], seed: int = 3) -> tuple[float, int]:
    """(mean absolute change of a sentence's score when its terms are swapped, sentences with terms)"""
    of, rng, total, n = {t: g for g in model.groups for t in g}, random.Random(seed), 0.0, 0
    for text in texts:
        for part in SENTENCE.split(text or ""):
            here = words_of(part)
            if other := swapped(here, of, rng):
                total += abs(model.score(" ".join(sorted(here))) - model.score(" ".join(sorted(other))))
                n += 1
    return total / max(1, n), n


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score"""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # WORDS words at most

    def run(batches):
        of = Model(*shared.value)
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of.score(x) for x in batch.column(1).to_pylist()], pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, score double")


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index(text_col)

    def run(batches):
        of = Model(*shared.value)
        for batch in small_batches(batches):
            yield batch.filter(pa.array([of.score(x) < threshold for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def trained(spark: SparkSession, sf_dir: str) -> Model:
    return learn(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), id_remainder("doc_id", 3) != 1)


def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(documents(spark, sf_dir), trained(spark, sf_dir))
    return scored.select(F.col("id").alias("doc_id"), (id_remainder("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
