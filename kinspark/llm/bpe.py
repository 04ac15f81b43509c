"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash. Any other is merged with a
heap over its linked bytes. Both tiers see a pre-token once for each worker: results are kept for the
chunks that a worker has met, in a cache with a fixed number of entries that only saves work.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, prepare

#: Bounds of a worker's cache: entries, and characters of an entry.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
#: Very long texts are encoded in segments of about so many characters, so that one text's tokens needn't be held at once.
SEGMENT_CHARS = 1 << 20

#: A space before a character that isn't white space always starts a pre-token: the pattern lets a run of white space give
#: up its last space to the word after it, and no other part of the pattern has white space inside.
_START = re.compile(r" (?=\S)")
_RAGGED = re.compile(r" (?:\s|\Z)")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank; read on the driver."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """A minimal perfect hash of distinct keys: each bucket has a displacement that sends its keys to free slots.

    `ids(keys)` is vectorised: a key that isn't one of those the table was built from gives -1.
    """

    PER_BUCKET, TRIES = 3, 32

    def __init__(self, keys: list[bytes]):
        if len(set(keys)) < len(keys):
            raise ValueError("keys are equal: no perfect hash exists")
        self.keys, self.size = keys, len(keys)
        self.buckets = max(1, self.size // self.PER_BUCKET)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slots = np.full(self.size, -1, np.int64)
        bucket, first, step = self._parts(keys)
        order = np.argsort(bucket, kind="stable")
        members = np.split(order, np.cumsum(np.bincount(bucket, minlength=self.buckets))[:-1])
        taken = np.zeros(self.size, bool)
        tries = np.arange(self.TRIES)
        for own in sorted((m for m in members if len(m) > 1), key=len, reverse=True):
            for base in range(0, 1 << 40, self.TRIES):
                at = self._slot(first[own], step[own], (base + tries)[:, None])
                ordered = np.sort(at, axis=1)
                good = ~(taken[at].any(axis=1) | (ordered[:, 1:] == ordered[:, :-1]).any(axis=1))
                if good.any():
                    shift = int(good.argmax())
                    self.shift[bucket[own[0]]] = base + shift
                    self.slots[at[shift]] = own
                    taken[at[shift]] = True
                    break
        # A bucket of one key names its slot itself, as -1 - slot, so the last free slots need no search.
        for own, slot in zip((m[0] for m in members if len(m) == 1), np.flatnonzero(~taken)):
            self.shift[bucket[own]] = -1 - slot
            self.slots[slot] = own

    def _parts(self, keys: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), np.uint64).reshape(-1, 2)
        bucket = (hashes[:, 0] % np.uint64(self.buckets)).astype(np.int64)
        return bucket, hashes[:, 1], (hashes[:, 0] >> np.uint64(20)) | np.uint64(1)

    def _slot(self, first: np.ndarray, step: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
        mixed = first + step * np.asarray(shift, np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(11)) % np.uint64(self.size)).astype(np.int64)

    def ids(self, keys: list[bytes]) -> list[int]:
        if not keys or not self.size:
            return [-1] * len(keys)
        bucket, first, step = self._parts(keys)
        shift = self.shift[bucket]
        found = self.slots[np.where(shift < 0, -1 - shift, self._slot(first, step, np.maximum(shift, 0)))].tolist()
        own = self.keys
        return [i if own[i] == key else -1 for i, key in zip(found, keys)]


class Encoder:
    """Text to ids and back. Made on the driver; workers get a copy by broadcast, bounded by the vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.table = PerfectHash(tokens)
        self._start()

    def _start(self) -> None:
        self.rank = {token: i for i, token in enumerate(self.tokens) if token}
        self.names = [str(i) for i in range(len(self.tokens))]
        self.split = regex.compile(self.pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}  # of chunks
        self.words: dict[str, tuple[int, ...]] = {}  # of pre-tokens

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "pattern": self.pattern, "table": self.table}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def merge(self, piece: bytes) -> list[int]:
        """BPE of a piece that isn't a token: the pair of neighbours with the lowest rank, leftmost first, is merged until none
        is left. Bytes form a linked list; merges that are no longer possible stay in the heap and are skipped."""
        rank = self.rank
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []
        for i in range(len(parts) - 1):
            r = rank.get(piece[i : i + 2])
            if r is not None:
                heap.append((r, i))
        heapq.heapify(heap)
        end, tokens = len(parts), self.tokens
        while heap:
            r, i = heapq.heappop(heap)
            left = parts[i]
            if left is None or (j := after[i]) == end:
                continue
            whole = left + parts[j]
            if whole != tokens[r]:
                continue
            parts[i], parts[j] = whole, None
            after[i] = k = after[j]
            if k != end:
                before[k] = i
                if (s := rank.get(whole + parts[k])) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := rank.get(parts[h] + whole)) is not None:
                heapq.heappush(heap, (s, h))
        return [rank[p] for p in parts if p is not None]

    def learn(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """The ids of chunks: whole pre-tokens by the perfect hash, the rest by merging."""
        split = [self.split(c) for c in chunks]
        known = self.words
        new = [t for t in set(chain.from_iterable(split)) if t not in known]
        raw = [t.encode("utf-8", "surrogatepass") for t in new]
        found = {t: (i,) if i >= 0 else tuple(self.merge(b)) for t, b, i in zip(new, raw, self.table.ids(raw))}
        known.update((t, i) for t, i in found.items() if len(t) <= CACHE_CHARS)
        ids = known if all(len(t) <= CACHE_CHARS for t in new) else {**{t: known[t] for s in split for t in s if t in known}, **found}
        return [ids[s[0]] if len(s) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, s))) for s in split]

    def encode(self, text: str) -> list[int]:
        chunks = chunked(text)
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
            self.words.clear()
        cache = self.cache
        new = [c for c in set(chunks) if c not in cache]
        if new:
            learnt = dict(zip(new, self.learn(new)))
            long = {c: ids for c, ids in learnt.items() if len(c) > CACHE_CHARS}
            cache.update(learnt if not long else {c: ids for c, ids in learnt.items() if c not in long})
            if long:
                return list(chain.from_iterable(long[c] if c in long else cache[c] for c in chunks))
        return list(chain.from_iterable(map(cache.__getitem__, chunks)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def written(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


def chunked(text: str) -> list[str]:
    """The text cut before spaces that start a pre-token, so that no pre-token lies in two chunks."""
    if not text:
        return []
    if _RAGGED.search(text):
        cuts = [m.start() for m in _START.finditer(text) if m.start()]
        return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]
    first, *rest = text.split(" ")
    rest = [" " + part for part in rest]
    return [first, *rest] if first else rest


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """The text in order, cut where a pre-token starts."""
    at = 0
    while len(text) - at > size and (cut := _START.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, from encoding each text and decoding its ids.

    A null or empty text has no ids. Very long texts are encoded whole, in segments that end where a pre-token starts.
    Rows are independent: repeated rows give repeated results, null ids stay null, other columns aren't read.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Encoder(read_ranks(ranks_path), pattern))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            counts, written, decoded = [], [], []
            for text in batch.column(1):
                n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
                for part in segments(as_text(text.as_py())):
                    ids = encoder.encode(part)
                    if ids:
                        ids_sha.update((" " if n else "").encode() + encoder.written(ids).encode())
                        text_sha.update(encoder.decode(ids))
                        n += len(ids)
                counts.append(n)
                written.append(ids_sha.hexdigest())
                decoded.append(text_sha.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(written, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, ENCODED)


TOKENS = "doc_id long, ids array<int>"


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each text; nulls as in bpe_digests."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Encoder(read_ranks(ranks_path), pattern))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            ids = [list(chain.from_iterable(map(encoder.encode, segments(as_text(t.as_py()))))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, TOKENS)


def bpe_decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of each row's ids, as bpe_encode made them; null ids are the empty text."""
    shared = prepare(tokens.sparkSession).sparkContext.broadcast(Encoder(read_ranks(ranks_path), pattern))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            texts = [encoder.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, bytes binary")
