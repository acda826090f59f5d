"""How demanding a text is, on the scale of human grades.

Texts are typeset once: what they are counted and scored by is written. Features of the text as typeset - lexical diversity, rarity of its words in the corpus, connectives, a proxy of clause depth,
and lengths - go into a regularised ordinal regression (proportional odds) fitted to graded documents. The estimate is the
expected grade, so it is comparable with the grades themselves.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.llm.typeset import typeset
from braidlake.session import checkpointed

GRADES = 5
#: Graded documents that are fitted at most; beyond it those with the least hash of their id are taken.
MOST_GRADED = 50_000
#: A word in a smaller share of the documents is rare, and rare words are all equally so: then only the others need counts,
#: of which there are at most 1 / RARE times as many as a document has words, however large the corpus is.
RARE = 0.002
#: Words that a task counts before it passes the counts on.
HELD = 500_000
PENALTY = 1.0

# English connectives of one and of several words, and words that open a clause.
CONNECTIVES = frozenset(
    "accordingly additionally also although because besides but consequently conversely correspondingly furthermore hence however if instead likewise "
    "meanwhile moreover namely nevertheless nonetheless notwithstanding otherwise provided similarly since so then therefore though thus unless until whereas while yet".split()
)
PHRASES = (
    "as a consequence", "as a result", "as long as", "as opposed to", "as soon as", "as well as", "by contrast", "even if", "even though", "for example", "for instance", "for this reason",
    "in addition", "in contrast", "in fact", "in order to", "in other words", "in particular", "in spite of", "in that case", "on the contrary", "on the other hand", "on the one hand",
    "provided that", "rather than", "that is to say", "to this end", "with respect to",
)
SUBORDINATORS = frozenset("although as because before if insofar notwithstanding once provided since so that though unless until when whenever where whereas whether which while who whom whose why".split())
BASE = ("log_words", "word_length", "long_words", "vowel_groups", "diversity", "connectives", "clause_depth", "sentence_length", "punctuation")
FEATURES = (*BASE, "rarity", "rare_words")

_sentence = re.compile(r"[.!?]+(?:\s|$)|\n\s*\n")
_vowels = re.compile(r"[aeiouyàâäáéèêëíîïóôöúûùü]+")
_inner = re.compile(r"[,;:()]")
_letters = re.compile(r"[^\W\d_]+")
_phrase = re.compile(r"\b(?:" + "|".join(PHRASES) + r")\b")
# "so" and "as" open a clause only before its subject, and close nothing elsewhere
_weak = frozenset(("so", "as", "once", "before", "since", "until"))
_subject = frozenset("he her his i it its my no one our she that the their there these they this those we you your".split())


@dataclass
class Read:
    """A text's BASE features, its distinct words by hash, and how often it has each."""

    base: list[float]
    hashes: list[int]
    times: list[int]


def word_hash(word: str) -> int:
    """64 bits that stand for a word, as a signed number."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _clauses(found: list[str]) -> int:
    """Words that open a clause within the one before. Words that do so only now and then count where a subject follows."""
    return sum(1 for k, word in enumerate(found) if k and word in SUBORDINATORS and (word not in _weak or (k + 1 < len(found) and found[k + 1] in _subject)))


class _Known(dict):
    """Word to (hash, letters, vowel groups, long, connective), filled as words come."""

    def __missing__(self, word: str) -> tuple[int, int, int, bool, bool]:
        out = (word_hash(word), len(word), len(_vowels.findall(word)), len(word) >= 10, word in CONNECTIVES)
        if len(self) < 200_000:  # a memo only
            self[word] = out
        return out


def text_features(text: str, known: _Known | None = None) -> Read | None:
    """What a text is scored and counted by; None if it has no words."""
    known = _Known() if known is None else known
    printed = typeset(text).lower()
    found = _letters.findall(printed)
    n = len(found)
    if not n:
        return None
    sentences = max(1, len(_sentence.findall(printed)))
    # Share of distinct words in a window of 50, averaged over the text, so that it doesn't follow the length.
    if n <= 50:
        diversity = len(set(found)) / n
    else:
        windows = range(0, n - 49, 25)
        diversity = sum(len(set(found[i : i + 50])) for i in windows) / len(windows) / 50
    letters = vowels = long = connectives = 0
    hashes, times = [], []
    for word, k in Counter(found).items():
        h, a, v, is_long, connects = known[word]
        hashes.append(h)
        times.append(k)
        letters += a * k
        vowels += v * k
        long += is_long * k
        connectives += connects * k
    phrases = len(_phrase.findall(" ".join(found)))
    inner = len(_inner.findall(printed))
    base = [math.log1p(n), letters / n, long / n, vowels / n, diversity, (connectives + phrases) / n, _clauses(found) / sentences, math.log(n / sentences), inner / n]
    return Read(base, hashes, times)


def read_words(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, hashes, times) of all documents, written, so that each text is typeset once; null for those without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            read = [text_features(t.as_py(), known) if t.is_valid else None for t in batch.column("text")]
            part = lambda name, kind, read=read: pa.array([None if r is None else getattr(r, name) for r in read], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), part("base", pa.float64()), part("hashes", pa.int64()), part("times", pa.int32())], ["doc_id", "base", "hashes", "times"])

    named = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return checkpointed(named.mapInArrow(run, "doc_id bigint, base array<double>, hashes array<bigint>, times array<int>"))


def document_counts(read: DataFrame) -> tuple[dict[int, int], int]:
    """Documents by word, for the words that aren't rare, counted over all documents; and the number of documents with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["word", "n"])

        held, size = [], 0
        for batch in batches:
            keys, n = np.unique(batch.column("hashes").flatten().to_numpy(zero_copy_only=False), return_counts=True)
            held.append((keys, n))
            size += len(keys)
            if size > HELD:
                keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([c for _, c in held])).astype(np.int64)
                held, size = [(keys, n)], len(keys)
                if size > HELD // 2:
                    yield out(keys, n)
                    held, size = [], 0
        for keys, n in held:
            yield out(keys, n.astype(np.int64))

    filled = read.where("hashes is not null")
    total = filled.count()
    counted = filled.select("hashes").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= F.lit(RARE) * total).toPandas()
    return dict(zip(rows.word.tolist(), rows.n.tolist(), strict=True)), total


def document_features(read: DataFrame) -> DataFrame:
    """(doc_id, x array of FEATURES) of all documents; x is null for those without words.

    A word's rarity is the negative logarithm of the share of documents with it, the same for all rare words.
    """
    counts, n = document_counts(read)
    words = np.array(sorted(counts), dtype=np.int64)
    rarest = math.log((n + 1) / (RARE * n + 1))
    scores = np.minimum(np.log((n + 1) / (np.array([counts[w] for w in words.tolist()], dtype=float) + 1)), rarest)
    shared = read.sparkSession.sparkContext.broadcast((words, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, scores = shared.value
        for batch in batches:
            hashes, times = batch.column("hashes"), batch.column("times")
            lengths = np.nan_to_num(hashes.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            flat, k = hashes.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(words, flat), max(0, len(words) - 1))
            common = words[at] == flat if len(words) else np.zeros(len(flat), dtype=bool)
            score = np.where(common, scores[at] if len(words) else 0.0, rarest)
            which = np.repeat(np.arange(len(lengths)), lengths)
            sums = [np.bincount(which, weights=w, minlength=len(lengths)) for w in (k, score * k, (score >= rarest) * k)]
            x = [None if b is None else [*b, r / m, q / m] for b, m, r, q in zip(batch.column("base").to_pylist(), *(s.tolist() for s in sums), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return read.mapInArrow(run, "doc_id bigint, x array<double>")


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade, weight): the last valid grade of each rater of a document, a document's weights adding up to 1.

    Null and out-of-range grades and those without document are dropped; of grades given at the same time the highest stays.
    """
    valid = labels.where(F.col("grade").between(1, GRADES) & F.col("doc_id").isNotNull())
    last = valid.groupBy("doc_id", "rater").agg(F.max(F.struct("graded_at", "grade")).alias("g")).select("doc_id", F.col("g.grade").alias("grade"))
    return last.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("doc_id")))


class OrdinalModel:
    """P(grade > k) = sigmoid(b x - t_k), with a ridge penalty on b; features are standardised."""

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = PENALTY, steps: int = 60) -> OrdinalModel:
        self.mean, self.scale = np.average(x, axis=0, weights=w), x.std(axis=0) + 1e-9
        z = (x - self.mean) / self.scale
        above = np.stack([y > k for k in range(1, GRADES)], axis=1).astype(float)
        share = np.clip((above * w[:, None]).sum(axis=0) / w.sum(), 1e-3, 1 - 1e-3)
        # Each threshold is a logistic problem with common weights b; Newton steps on all of them at once.
        b, t = np.zeros(z.shape[1]), -np.log(share / (1 - share))
        d = len(b)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(z @ b)[:, None] + t))
            error, curve = (above - p) * w[:, None], p * (1 - p) * w[:, None]
            gradient = np.concatenate([z.T @ error.sum(axis=1) - penalty * b, -error.sum(axis=0)])
            hessian = np.zeros((d + GRADES - 1, d + GRADES - 1))
            hessian[:d, :d] = (z * curve.sum(axis=1)[:, None]).T @ z + penalty * np.eye(d)
            hessian[:d, d:] = -z.T @ curve
            hessian[d:, :d] = hessian[:d, d:].T
            hessian[d:, d:] = np.diag(curve.sum(axis=0)) + 1e-6 * np.eye(GRADES - 1)
            step = np.linalg.solve(hessian, gradient)
            step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
            b, t = b + step[:d], t + step[d:]
            if np.abs(step).max() < 1e-7:
                break
        self.b, self.t = b, np.sort(t)
        return self

    def expected(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return 1 + (1 / (1 + np.exp(-(z @ self.b)[:, None] + self.t))).sum(axis=1)


def graded_features(featured: DataFrame, labels: DataFrame, most: int = MOST_GRADED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, grade, weight) of at most `most` graded documents, for the fit. A document's grades are averaged by grade, so the driver gets at most GRADES rows each."""
    marked = grades(labels).groupBy("doc_id", "grade").agg(F.sum("weight").alias("weight"))
    chosen = checkpointed(marked.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    mine = featured.where("x is not null").join(F.broadcast(chosen), "doc_id", "left_semi")
    one = mine.groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = one.join(marked.join(F.broadcast(chosen), "doc_id", "left_semi"), "doc_id").select("x", "grade", "weight").toPandas()
    return np.array(rows.x.tolist(), dtype=float).reshape(-1, len(FEATURES)), rows.grade.to_numpy(dtype=int), rows.weight.to_numpy(dtype=float)


def estimated(featured: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, level): the expected grade of each document, 1 to 5; null where there are no words."""
    weights = F.array(*[F.lit(float(v)) for v in model.b / model.scale])
    offset = float((model.mean * model.b / model.scale).sum())
    linear = F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v) - F.lit(offset)
    level = F.lit(1.0)
    for t in model.t:
        level = level + 1 / (1 + F.exp(F.lit(float(t)) - F.col("_linear")))
    return featured.withColumn("_linear", linear).select("doc_id", level.alias("level"))


def reading_levels(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, level) for every row of `documents`, fitted to `labels` (doc_id, rater, grade, graded_at).

    Texts that are null, empty or without words have a null level. Without any valid grade there is nothing to compare
    with, and a ValueError says so.
    """
    featured = checkpointed(document_features(read_words(documents, doc_id, text)))
    x, y, w = graded_features(featured, labels)
    if not len(y):
        raise ValueError("no valid grade of a document with words")
    return estimated(featured, OrdinalModel().fit(x, y, w))
