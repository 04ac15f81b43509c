"""Packing by cutting-stock column generation.

Documents are cut into full sequences and a tail. The histogram of the tails' lengths, in steps of STEP tokens, is the demand of a
cutting-stock problem: a linear program over patterns of lengths that fill a sequence, whose columns are priced by a
knapsack dynamic program. Its solution is rounded down, the rest is filled greedily, and tails, ranked within their
length, are dealt to the places of the patterns. Only the histogram, of bounded size, reaches the driver.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import segments
from .common import as_text, prepare

CAPACITY = 2048
#: Token that ends each document.
END_ID = 1
#: Tails are taken to fill whole steps of so many tokens.
STEP = 8
#: Tails of one length that are ranked together in a task.
BUCKET_ROWS = 50_000


def byte_ranks(serialized: str) -> dict[bytes, int] | None:
    """Ids of byte strings, where the tokenizer is byte-level BPE that merges in the order of its ids and has no other steps; else None."""
    spec = json.loads(serialized)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    steps = [spec.get(k) for k in ("normalizer", "truncation", "padding")]
    extras = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if model["type"] != "BPE" or not plain or any(steps) or any(extras):
        return None
    vocab, merges = model["vocab"], model["merges"]
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
    if [vocab.get(t) for t in made] != list(range(256, len(vocab))):
        return None
    # A byte is written as itself where that is a visible character, the others in order as the characters from 256 on.
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items()}


class Ids:
    """Ids as the tokenizers library gives them, special tokens within texts included.

    Byte-level BPE without further steps has the same ids in tiktoken, which makes them in a quarter of the time and keeps nothing
    between texts. Other tokenizers, and texts that hold a special token, go through tokenizers itself.
    """

    def __init__(self, serialized: str):
        self.tokenizer = Tokenizer.from_str(serialized)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = byte_ranks(serialized)
        self.ranked = ranks and tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if not self.ranked or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate([np.array(self.ranked.encode_ordinary(part), np.uint32) for part in segments(text)])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_IDS: dict[int, Ids] = {}


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document's ids, END_ID included: full sequences, and the rest."""
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = prepare(docs.sparkSession).sparkContext.broadcast(file.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _IDS:
            _IDS.clear()
            _IDS[key] = Ids(shared.value)
        tokenizer = _IDS[key]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate((tokenizer.encode(as_text(text.as_py())), [END_ID])).astype("<u4")
                data = ids.tobytes()
                for at in range(0, len(ids), capacity):
                    piece = data[4 * at : 4 * (at + capacity)]
                    rows.append((doc, at, len(piece) // 4, zlib.crc32(piece), len(ids)))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern worth most: how often each size (1 to capacity) fits in, and its worth; prices[s - 1] is that of size s."""
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        worth = best[c - 1 :: -1] + prices[:c]
        k = int(worth.argmax())
        if worth[k] > best[c - 1]:
            best[c], taken[c] = worth[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(capacity, np.int64), capacity
    while c:
        if taken[c]:
            pattern[taken[c] - 1] += 1
            c -= taken[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, rounds: int = 6000, gap: float = 2e-4) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, by the simplex method with generated columns: sum of use is minimal up to `gap`.

    demand[s - 1] is how many pieces have size s; the capacity is the length of demand. Begins with patterns of one
    size each; the inverse of the basis is updated for each column that enters.
    """
    capacity = len(demand)
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    fits = capacity // sizes
    columns = [np.where(np.arange(len(sizes)) == i, n, 0) for i, n in enumerate(fits)]
    inverse = np.diag(1.0 / fits)
    use = demand[sizes - 1] / fits
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        prices = np.zeros(capacity)
        prices[sizes - 1] = np.maximum(duals, 0)
        worth, pattern = knapsack(prices, capacity)
        if worth <= 1 + gap:  # use.sum() / worth bounds the optimum from below
            break
        column = pattern[sizes - 1]
        way = inverse @ column
        rising = way > 1e-10
        ratios = np.where(rising, use / np.where(rising, way, 1), np.inf)
        out = int(ratios.argmin())
        step = max(ratios[out], 0.0)
        use = np.maximum(use - step * way, 0)
        use[out] = step
        inverse[out] /= way[out]
        way[out] = 0
        inverse -= np.outer(way, inverse[out])
        columns[out] = column
    found = []
    for column, n in zip(columns, use):
        pattern = np.zeros(capacity, np.int64)
        pattern[sizes - 1] = column
        found.append((pattern, float(n)))
    return found


def plan(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole numbers of sequences that take all pieces: the program's solution rounded down, and the rest
    by first fit, largest first."""
    left, found = demand.astype(np.int64).copy(), []
    for pattern, use in solve(demand):
        own = np.flatnonzero(pattern)
        n = min(int(use + 1e-6), *(left[own] // pattern[own])) if len(own) else 0
        if n:
            found.append((pattern, n))
            left -= n * pattern
    while left.any():
        pattern, room = np.zeros(len(left), np.int64), len(left)
        for size in (np.flatnonzero(left) + 1)[::-1]:
            n = min(room // size, left[size - 1])
            pattern[size - 1] = n
            room -= n * size
        own = np.flatnonzero(pattern)
        n = int((left[own] // pattern[own]).min())
        found.append((pattern, n))
        left -= n * pattern
    return found


def places(patterns: list[tuple[np.ndarray, int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(size, first rank, rank after the last, first sequence, pieces of the size in a sequence) for each pattern and size, and the
    number of sequences."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in patterns:
        for size in (np.flatnonzero(pattern) + 1).tolist():
            low, many = ranks.get(size, 0), int(pattern[size - 1])
            ranks[size] = low + n * many
            rows.append((size, low, ranks[size], sequence, many))
        sequence += n
    return rows, sequence


def ranked(tails: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds rank, from 0 within each size. Each size is dealt to buckets whose number grows with the input, rows are ranked in
    their bucket, and the buckets' counts are added up."""
    buckets = max(1, -(-tails.count() // bucket_rows))
    dealt = tails.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("size", "bucket").count().select("size", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("size", "bucket").orderBy("doc_id", "start")
    return dealt.withColumn("own", F.row_number().over(own)).join(first, ["size", "bucket"]).withColumn(
        "rank", F.col("first") + F.col("own") - 1
    )


PACKED = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """One row per piece of a document: PACKED.

    Each id of each document, END_ID at its end included, lies in one piece, and no sequence has more than `capacity` ids. A null or
    empty text is the one id END_ID. Texts of any length are cut into as many pieces as they need. Repeated rows and null ids
    are packed like any other row. Other columns are not read. An empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    cut = pieces(docs, tokenizer_path, id_col, text_col, capacity).checkpoint()
    size = F.ceil(F.col("length") / step).cast("int")
    full = cut.filter(F.col("length") == capacity)
    tails = cut.filter(F.col("length") < capacity).withColumn("size", size)
    demand = np.zeros(capacity // step, np.int64)
    for row in tails.groupBy("size").count().collect():  # capacity / step rows at most
        demand[row["size"] - 1] = row["count"]
    slots, sequences = places(plan(demand))
    table = spark.createDataFrame(slots, "size int, low long, high long, sequence long, many int")
    at = ranked(tails).join(F.broadcast(table), "size").filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    dealt = at.withColumn("sequence_id", (F.col("sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("many"))).cast("long"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    packed = dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    alone = full.withColumn("sequence_id", F.monotonically_increasing_id() + sequences).withColumn("offset", F.lit(0).cast("long"))
    return packed.select(*PACKED).unionByName(alone.select(*PACKED))
