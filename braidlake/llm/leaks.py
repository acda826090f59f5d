"""Held-out items that show in documents.

An inverted index of the items, with BM25 impacts and their maxima by block of items, is queried with every passage of every
document. A passage is a stretch of words that all occur in the items, as a run shared with an item can't reach over any
other word. An item's threshold is the least score of any run of its own text of the required length, so a passage with
such a run can't score below it. Blocks whose maxima can't reach the least threshold of their items are left out; items
that reach theirs are verified word by word, and so is whether the document shows the item's answer as well.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm.typeset import plain_words, words
from braidlake.session import checkpointed

#: Consecutive words of an item that a document must show.
LEAST_WORDS = 12
#: Items in a block of the index.
BLOCK = 16
#: Words in a passage at most; longer stretches are cut with enough overlap to hold every run whole.
PASSAGE = 96
#: Words of items in one index, which bounds what is broadcast to about 40 bytes each; more items take several indexes.
INDEX_WORDS = 2_000_000
K1, B = 1.2, 0.75
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _run_hashes(terms: np.ndarray, least: int) -> np.ndarray:
    """A hash of every `least` terms in a row."""
    n = max(0, len(terms) - least + 1)
    x, h = terms.astype(np.uint64) + np.uint64(1), np.zeros(n, dtype=np.uint64)
    for k in range(least):
        h = (h ^ (h >> np.uint64(31))) * _MULTIPLIER + x[k : k + n]
    return h


class ItemIndex:
    """Inverted index of items: list of (id, words) or (id, words, answer words). Only arrays are sent; the look-up of words is made by each worker."""

    def __init__(self, items: list[tuple], least: int = LEAST_WORDS):
        # Shorter items can't show a run of that length; near items side by side keep block maxima tight.
        items = sorted(((x[0], x[1], x[2] if len(x) > 2 else []) for x in items if len(x[1]) >= least), key=lambda x: (x[1], x[0], x[2]))
        self.least, self.ids = least, np.array([i for i, _, _ in items], dtype=np.int64)
        self.answers = [" ".join(a) for _, _, a in items]
        number: dict[str, int] = {}
        self.words = np.array([number.setdefault(t, len(number)) for _, w, _ in items for t in w], dtype=np.int32)
        self.at = np.cumsum([0, *(len(w) for _, w, _ in items)])
        self.names, self._number = pa.array(list(number), pa.string()), number
        found: Counter[str] = Counter(t for _, w, _ in items for t in set(w))
        idf = {t: math.log(1 + (len(items) - n + 0.5) / (n + 0.5)) for t, n in found.items()}
        mean = sum(len(w) for _, w, _ in items) / max(1, len(items))
        terms, holders, impacts, self.threshold = [], [], [], np.empty(len(items))
        for at, (_, w, _) in enumerate(items):
            norm = K1 * (1 - B + B * len(w) / mean)
            f = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in Counter(w).items()}
            terms += [number[t] for t in f]
            holders += [at] * len(f)
            impacts += f.values()
            # Least score of any run, less what adding in another order and rounding may lose.
            self.threshold[at] = min(sum(f[t] for t in set(w[k : k + least])) for k in range(len(w) - least + 1)) - 1e-3
        self._arrange(np.array(terms, dtype=np.int64), np.array(holders, dtype=np.int32), np.array(impacts, dtype=np.float32))
        hashes = [_run_hashes(self.words[a:b], least) for a, b in zip(self.at[:-1], self.at[1:], strict=True)]
        places = [np.arange(a, a + len(h)) for a, h in zip(self.at[:-1], hashes, strict=True)]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.run_hash, self.run_place = flat[order], (np.concatenate(places) if places else np.empty(0, np.int64))[order].astype(np.int32)

    def _arrange(self, terms: np.ndarray, holders: np.ndarray, impacts: np.ndarray) -> None:
        """Postings by term, and by term the blocks that have it with their greatest impact."""
        order = np.lexsort((holders, terms))
        terms, self.item, self.impact = terms[order], holders[order], impacts[order]
        n = len(self.names)
        self.start = np.searchsorted(terms, np.arange(n + 1))
        block = self.item // BLOCK
        first = np.flatnonzero((np.diff(terms, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.block, self.block_max = block[first], np.maximum.reduceat(self.impact, first) if len(first) else self.impact
        self.block_start = np.searchsorted(terms[first], np.arange(n + 1))
        self.block_threshold = np.minimum.reduceat(self.threshold, np.arange(0, len(self.threshold), BLOCK)) if len(self.threshold) else self.threshold

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_number"}

    @property
    def number(self) -> dict[str, int]:
        """Words to their numbers, made once by each worker."""
        if "_number" not in self.__dict__:
            self._number = {t: n for n, t in enumerate(self.names.to_pylist())}
        return self._number

    def passages(self, doc: list[str]) -> Iterator[np.ndarray]:
        """Stretches of the document's words that the items know, by number, at least as long as a run."""
        known = self.number
        numbers = np.fromiter((known.get(w, -1) for w in doc), dtype=np.int32, count=len(doc))
        gaps = np.flatnonzero(numbers < 0)
        begins, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(doc)]])
        for i in np.flatnonzero(ends - begins >= self.least):
            stretch = numbers[begins[i] : ends[i]]
            for k in range(0, len(stretch) - self.least + 1, PASSAGE - self.least + 1):
                yield stretch[k : k + PASSAGE]

    @staticmethod
    def _ranges(start: np.ndarray, terms: np.ndarray) -> np.ndarray:
        sizes = start[terms + 1] - start[terms]
        return np.arange(sizes.sum()) + np.repeat(start[terms] - (np.cumsum(sizes) - sizes), sizes)

    def scored(self, passage: np.ndarray) -> np.ndarray:
        """Items whose BM25 score for the passage's distinct words reaches their threshold."""
        terms = np.unique(passage)
        rows = self._ranges(self.block_start, terms)
        blocks, place = np.unique(self.block[rows], return_inverse=True)
        blocks = blocks[np.bincount(place, weights=self.block_max[rows]) >= self.block_threshold[blocks]]
        if not len(blocks):
            return np.empty(0, dtype=np.int64)
        rows = self._ranges(self.start, terms)
        block = self.item[rows] // BLOCK
        at = np.minimum(np.searchsorted(blocks, block), len(blocks) - 1)
        rows = rows[blocks[at] == block]
        items, place = np.unique(self.item[rows], return_inverse=True)
        return items[np.bincount(place, weights=self.impact[rows]) >= self.threshold[items]]

    def verified(self, passage: np.ndarray, reached: np.ndarray) -> Iterator[int]:
        """For each run of the passage, each item among those reached that has it word by word."""
        hashes = _run_hashes(passage, self.least)
        left, right = np.searchsorted(self.run_hash, hashes), np.searchsorted(self.run_hash, hashes, side="right")
        for k in np.flatnonzero(right > left):
            run, seen = passage[k : k + self.least], set()
            for place in self.run_place[left[k] : right[k]]:
                item = int(np.searchsorted(self.at, place, side="right")) - 1
                if item not in seen and item in reached and np.array_equal(self.words[place : place + self.least], run):
                    seen.add(item)
                    yield item

    def search(self, doc: list[str]) -> dict[int, tuple[int, bool | None]]:
        """Item id to the number of runs of the item that the document shows, for items with at least one, and whether it shows the answer too; None if there is none."""
        shown: Counter[int] = Counter()
        for passage in self.passages(doc):
            reached = set(self.scored(passage).tolist())
            if reached:
                shown.update(self.verified(passage, reached))
        if not shown:
            return {}
        text = f" {' '.join(doc)} "
        out: dict[int, tuple[int, bool | None]] = {}
        for at, n in shown.items():
            answer, key = self.answers[at], int(self.ids[at])
            before = out.get(key, (0, None))
            with_answer = f" {answer} " in text if answer else None
            out[key] = (max(n, before[0]), with_answer if before[1] is None else before[1] or bool(with_answer))
        return out


def _indexes(items: DataFrame, item_id: str, text: str, answer: str | None, least: int, index_words: int) -> Iterator[ItemIndex]:
    """Indexes over all items, each of a bounded number of words (one item more at most)."""
    part: list[tuple] = []
    n = 0
    columns = [F.col(item_id), F.col(text), F.col(answer) if answer else F.lit(None).cast("string")]
    for row in items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(*columns).distinct().toLocalIterator():
        if n >= index_words:
            yield ItemIndex(part, least)
            part, n = [], 0
        part.append((row[0], plain_words(row[1]), plain_words(row[2])))
        n += len(part[-1][1])
    yield ItemIndex(part, least)


def leaked(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str = "answer", index_words: int = INDEX_WORDS) -> DataFrame:
    """(doc_id, item_id, n_runs, answer_shown): documents that show at least `least` consecutive words of an item, with how many such runs.

    answer_shown says whether the words of the item's answer stand in the document too, in a row; null where the item has no
    answer or `items` no such column. Documents are read as typeset, items and answers as plain text. Null and empty texts show
    nothing, items shorter than `least` words are shown by nothing. Repeated documents and items count once, with the
    greatest number of runs. Whole texts are read, and typeset once: where items take several indexes, the words are written.
    """
    spark = documents.sparkSession
    indexes = list(_indexes(items, item_id, item_text, answer if answer in items.columns else None, least, index_words))
    bodies = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    several = len(indexes) > 1

    def typeset_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([" ".join(words(t.as_py())) for t in batch.column("text")], pa.string())], ["doc_id", "text"])

    if several:
        bodies = checkpointed(bodies.mapInArrow(typeset_all, "doc_id bigint, text string"))
    schema = "doc_id bigint, item_id bigint, n_runs bigint, answer_shown boolean"
    out = None
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                docs, found, n, answered = [], [], [], []
                for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    for item, (runs, with_answer) in index.search(body.as_py().split() if several else words(body.as_py())).items():
                        docs.append(doc)
                        found.append(item)
                        n.append(runs)
                        answered.append(with_answer)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64()), pa.array(n, pa.int64()), pa.array(answered, pa.bool_())], ["doc_id", "item_id", "n_runs", "answer_shown"])

        part = bodies.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_runs").alias("n_runs"), F.bool_or("answer_shown").alias("answer_shown"))


def leaked_items(found: DataFrame) -> DataFrame:
    """Per item the number of documents that show it, and of those that show its answer too: (item_id, n_documents, n_with_answer)."""
    with_answer = F.count_distinct(F.when(F.col("answer_shown"), F.col("doc_id")))
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), with_answer.alias("n_with_answer"))
