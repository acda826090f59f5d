"""Items of varying length put into containers under several limits at once.

Vector bin packing. An item is a vector of tokens, loss-bearing tokens and segments (one); a container has a limit for each.
Containers are filled one after another: of the items that still fit, the one with the greatest dot product with the
room left is taken. Items are spread over shards of bounded size by hash, and each shard is packed by itself, so room is lost
in about one container per shard.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.session import checkpointed

CAPACITY = 2048
#: Items in a shard, on average.
SHARD = 10_000
#: Items in a container at most.
MOST_SEGMENTS = 64
#: Loss-bearing tokens in a container at most. What a text opens with, its prompt, bears no loss.
MOST_LOSS = 2000
#: Copies of one row that are made at a time.
CHUNK = 10_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which the tokenizer's vocabulary splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes) -> Callable[[str], list[int]]:
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_heading = re.compile(r"\\(?:section|chapter|part)\b")
_blank = re.compile(r"\n[ \t]*\r?\n")


def prompt_length(text: str) -> int:
    """Letters that a text opens with before it bears loss: up to its first section, else its first paragraph; none if that is all there is."""
    found = _heading.search(text) or _blank.search(text)
    return found.start() if found and text[found.end() :].strip() else 0


def token_counts(texts: DataFrame, item_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(item_id, tokens, loss_tokens) of whole texts; null and empty texts have 0 tokens.

    Loss-bearing are the tokens after the prompt (see prompt_length). The tokenizer's file travels with the job.
    """
    spark = texts.sparkSession
    with open(tokenizer, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks.value)
        for batch in batches:
            tokens, loss = [], []
            for value in batch.column("text"):
                body = value.as_py() or ""
                tokens.append(len(encode(body)))
                # a prompt ends at a line's end or a command, where no token reaches over
                loss.append(max(0, tokens[-1] - len(encode(body[: prompt_length(body)]))))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(tokens, pa.int64()), pa.array(loss, pa.int64())], ["item_id", "tokens", "loss_tokens"])

    return texts.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).mapInArrow(run, "item_id bigint, tokens bigint, loss_tokens bigint")


def fill(vectors: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item and its place there; no item may exceed a limit.

    Items with equal vectors are alike and taken in the order given. Ties go to the vector with more of the earlier dimensions.
    """
    kinds, kind_of = np.unique(vectors, axis=0, return_inverse=True)
    waiting = [list(x[::-1]) for x in np.split(np.argsort(kind_of, kind="stable"), np.cumsum(np.bincount(kind_of))[:-1])]
    left = np.array([len(x) for x in waiting])
    shares = kinds / limits
    container, place = np.empty(len(vectors), dtype=np.int64), np.empty(len(vectors), dtype=np.int64)
    alive = np.arange(len(kinds))
    open_, at, room = 0, 0, limits.astype(np.float64).copy()
    n = len(vectors)
    while n:
        fits = alive[(kinds[alive] <= room).all(axis=1)]
        if not len(fits):
            open_, at, room = open_ + 1, 0, limits.astype(np.float64).copy()
            continue
        dots = shares[fits] @ (room / limits)
        best = fits[len(fits) - 1 - np.argmax(dots[::-1])]
        item = waiting[best].pop()
        container[item], place[item] = open_, at
        room, at, n = room - kinds[best], at + 1, n - 1
        left[best] -= 1
        if not left[best]:
            alive = alive[alive != best]
    return container, place


def packed(items: DataFrame, capacity: int = CAPACITY, max_segments: int = MOST_SEGMENTS, loss_capacity: int | None = None) -> DataFrame:
    """(item_id, copy, piece, container, place, start, tokens, loss): every item's containers and places.

    `items` is (item_id, tokens, loss_tokens); loss_tokens may be absent, then every token bears loss. An item is split only
    if it exceeds the capacity, into pieces that fill a container each and a rest that is packed like any item; loss is taken to
    be spread evenly over the pieces. A piece with more loss-bearing tokens than allowed has a container to itself.
    `start` is the piece's first token within its container. Repeated rows are items of their own, told apart by `copy`. Items
    without tokens, or with null tokens, come out with null container and place; an empty table gives no rows.
    """
    loss_capacity = loss_capacity or capacity
    loss = F.least(F.col("loss_tokens"), F.col("tokens")) if "loss_tokens" in items.columns else F.col("tokens")
    sized = items.select("item_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.coalesce(loss, F.lit(0)).cast("bigint").alias("loss"))
    alike = sized.groupBy("item_id", "tokens", "loss").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("item_id").orderBy("tokens", "loss").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = alike.withColumn("first", before + 1).withColumn("last", F.col("first") + F.col("n") - 1)
    # in two steps, as one row repeated very often would make one very long array
    chunks = ranged.withColumn("chunk", F.explode(F.sequence(F.col("first"), F.col("last"), F.lit(CHUNK).cast("bigint"))))
    # written once: what follows reads it several times, and making it may have read whole texts
    copies = checkpointed(chunks.withColumn("copy", F.explode(F.sequence(F.col("chunk"), F.least("last", F.col("chunk") + CHUNK - 1)))).select("item_id", "tokens", "loss", "copy"))
    pieces = copies.where("tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / capacity))))
    own = F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("piece") * capacity)
    own_loss = F.least(own, F.ceil(own * F.col("loss") / F.col("tokens")))
    # numbered where they are written, so the numbers are unique and stay the same when a task runs again
    pieces = pieces.select("item_id", "copy", "piece", own.alias("tokens"), own_loss.cast("bigint").alias("loss"), F.monotonically_increasing_id().alias("number"))
    pieces = checkpointed(pieces)
    alone = (F.col("tokens") >= capacity) | (F.col("loss") > loss_capacity)
    shards = max(1, -(-pieces.where(~alone).count() // SHARD))
    limits = np.array([capacity, loss_capacity, max_segments])

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("item_id", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        tokens = group.column("tokens").to_numpy()
        container, place = fill(np.column_stack([tokens, group.column("loss").to_numpy(), np.ones(len(tokens), dtype=np.int64)]), limits)
        order = np.lexsort((place, container))
        before = np.cumsum(tokens[order]) - tokens[order]
        first = np.maximum.accumulate(np.where(place[order] == 0, before, 0))
        start = np.empty_like(tokens)
        start[order] = before - first
        at = group.column("shard").to_numpy() + container * shards
        return pa.table({"item_id": group.column("item_id"), "copy": group.column("copy"), "piece": group.column("piece"), "container": pa.array(at), "place": pa.array(place), "start": pa.array(start), "tokens": pa.array(tokens), "loss": group.column("loss")})

    schema = "item_id bigint, copy bigint, piece bigint, container bigint, place bigint, start bigint, tokens bigint, loss bigint"
    shard = F.pmod(F.xxhash64("item_id", "copy", "piece"), F.lit(shards)).cast("bigint")
    # by range, so that each shard has a task of its own; hashes of few numbers would meet in some
    mixed = pieces.where(~alone).drop("number").withColumn("shard", shard).repartitionByRange(shards, "shard").groupBy("shard").applyInArrow(pack, schema)
    # A piece alone in its container needs no packing; negative numbers keep its container apart.
    zero = F.lit(0).cast("bigint")
    single = pieces.where(alone).select("item_id", "copy", "piece", (-1 - F.col("number")).alias("container"), zero.alias("place"), zero.alias("start"), "tokens", "loss")
    none = F.lit(None).cast("bigint")
    empty = copies.where("tokens = 0").select("item_id", "copy", zero.alias("piece"), none.alias("container"), none.alias("place"), none.alias("start"), "tokens", "loss")
    return mixed.unionByName(single).unionByName(empty)


def audited(rows: DataFrame, capacity: int = CAPACITY, max_segments: int = MOST_SEGMENTS, loss_capacity: int = MOST_LOSS) -> DataFrame:
    """One row on the result of `packed`: items and containers, what breaks a limit or leaves a gap, and the containers that the tightest limit would need at least.

    over_loss counts containers of several pieces only, as a single piece may bear more.
    """
    rows = checkpointed(rows)
    used = rows.where("container is not null").groupBy("container").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"), F.max("place").alias("last"), F.count_distinct("place").alias("places"))
    pieces = rows.groupBy("item_id", "copy").agg(F.count("*").alias("n"), F.max("piece").alias("last"), F.count_distinct("piece").alias("pieces"), F.sum((F.col("tokens") < capacity).cast("bigint")).alias("rests"))
    total = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    by_container = used.agg(
        F.count("*").alias("n_containers"), total(F.col("tokens") > capacity).alias("over_tokens"), total(F.col("n") > max_segments).alias("over_segments"), total((F.col("n") > 1) & (F.col("loss") > loss_capacity)).alias("over_loss"),
        total((F.col("last") != F.col("n") - 1) | (F.col("places") != F.col("n"))).alias("broken_places"),
        F.greatest(F.ceil(total(F.col("tokens")) / capacity), F.ceil(total(F.col("n")) / max_segments), F.ceil(F.coalesce(F.sum(F.least("loss", F.lit(loss_capacity))), F.lit(0)) / loss_capacity)).cast("bigint").alias("least_containers"),
    )
    by_item = pieces.agg(F.count("*").alias("n_items"), total((F.col("last") != F.col("n") - 1) | (F.col("pieces") != F.col("n")) | (F.col("rests") > 1)).alias("broken_pieces"))
    # two rows, of which each column has one value
    both = by_container.unionByName(by_item, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
