"""Substring deduplication by difference-cover anchors.

The positions of a document whose remainder modulo PERIOD is in COVER are hashed, ANCHOR words each. COVER holds every
difference modulo PERIOD, so for any two places there is a shift below PERIOD that takes both to cover positions: two equal windows
of ANCHOR + PERIOD - 1 words always share an aligned anchor. Only anchors that two documents share are extended, that
is, the windows around them are compared; all other windows are known to be in one document only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, join_groups, prepare

WINDOW = 50
#: A difference cover: the differences of COVER modulo PERIOD are all of 0 to PERIOD - 1.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Stands for a null id: no document is larger.
LAST = (1 << 63) - 1
#: Keys that a task remembers.
SLOTS = 1 << 20
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


class Roller:
    """Hashes of all runs of words of one width, modulo 2 to the 64th; the powers of the base are kept."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, codes: np.ndarray, width: int) -> np.ndarray:
        n = len(codes)
        if n < width:
            return np.empty(0, np.uint64)
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * self.up[:n], dtype=np.uint64)))
        mixed = (sums[width:] - sums[:-width]) * self.down[: n - width + 1]
        return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(BASES[0])


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of `width` that begins at one of starts."""
    marks = np.zeros(n + width + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + width, -1)
    return np.cumsum(marks)[:n] > 0


def _batch(parts: list[tuple[np.ndarray, ...]], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, t) for c, t in zip(columns, types)], names)


class Seen:
    """The last document known to hold a key, for a bounded number of keys (a power of 2); a key that is pushed out counts as new
    again."""

    def __init__(self, n_keys: int, n_slots: int):
        # at first each slot has a key that belongs elsewhere
        self.keys = [np.arange(n_slots, dtype=np.uint64) ^ np.uint64(1) for _ in range(n_keys)]
        self.id = np.full(n_slots, LAST, np.int64)
        self.shared = np.zeros(n_slots, bool)

    def at(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and whether they hold these keys."""
        slots = (keys[0] & np.uint64(len(self.id) - 1)).astype(np.int64)
        same = np.logical_and.reduce([own[slots] == k for own, k in zip(self.keys, keys)])
        return slots, same

    def put(self, slots: np.ndarray, keys: list[np.ndarray], doc: int) -> None:
        for own, k in zip(self.keys, keys):
            own[slots] = k
        self.id[slots], self.shared[slots] = doc, False


def _apart(key: np.ndarray, doc: int, at: np.ndarray) -> np.ndarray:
    """Keys that spread rows which need no comparison."""
    return (key ^ (at.astype(np.uint64) + np.uint64(doc & (1 << 63) - 1))) * np.uint64(BASES[1])


def anchors(batches: Iterator[pa.RecordBatch], n_slots: int = SLOTS) -> Iterator[pa.RecordBatch]:
    """(id, t1, text) to (hash, id, t1, at): the hashes at cover positions.

    Once two documents with a hash have been let through, later ones in this task are known to share it: their rows have
    at = -1 - position and a hash of their own. So a passage of very many documents makes few equal keys.
    """
    roll, cover, seen = Roller(BASES[0]), np.isin(np.arange(PERIOD), COVER), Seen(1, n_slots)
    names, types = ["hash", "id", "t1", "at"], [pa.int64()] * 3 + [pa.int32()]
    for batch in batches:
        parts = []
        for i, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = _words(as_text(text.as_py()))
            if len(words) < WINDOW:
                continue
            hashes = roll(_codes(words), ANCHOR)
            at = np.flatnonzero(np.resize(cover, len(hashes)))
            hashes = hashes[at]
            slots, same = seen.at([hashes])
            other = same & (seen.id[slots] != i)
            known = other & seen.shared[slots]
            seen.shared[slots[other]] = True
            seen.put(slots[~same], [hashes[~same]], i)
            hashes = np.where(known, _apart(hashes, i, at), hashes)
            parts.append((hashes, np.full(len(at), i), np.full(len(at), t), np.where(known, -1 - at, at)))
        yield _batch(parts, names, types)


def windows(batches: Iterator[pa.RecordBatch], n_slots: int = SLOTS) -> Iterator[pa.RecordBatch]:
    """(id, t1, text, at) to (h1, h2, id, t1, pos): the windows that hold an anchor of `at`, by two hashes.

    A window that this task has met in a document with a smaller id is decided: it has pos = -1 - position and hashes of its own.
    """
    rolls, seen = [Roller(b) for b in BASES], Seen(2, n_slots)
    names, types = ["h1", "h2", "id", "t1", "pos"], [pa.int64()] * 4 + [pa.int32()]
    for batch in batches:
        parts = []
        for i, t, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            words = _words(as_text(text.as_py()))
            at = np.array(at.as_py(), np.int64)
            at = np.sort(np.where(at < 0, -1 - at, at))
            codes = _codes(words)
            # window p holds anchor a if p <= a <= p + PERIOD - 1
            late = np.arange(len(words) - WINDOW + 1)
            following = at[np.minimum(np.searchsorted(at, late), len(at) - 1)]
            pos = np.flatnonzero((following >= late) & (following - late < PERIOD))
            keys = [roll(codes, WINDOW)[pos] for roll in rolls]
            slots, same = seen.at(keys)
            gone = same & (seen.id[slots] < i)
            new = ~gone
            seen.put(slots[new], [k[new] for k in keys], i)
            h1, h2 = (np.where(gone, _apart(k, i, pos), k) for k in keys)
            parts.append((h1, h2, np.full(len(pos), i), np.full(len(pos), t), np.where(gone, -1 - pos, pos)))
        yield _batch(parts, names, types)


CLEANED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _finisher(with_text: bool):  # noqa: ANN202
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, first, pos in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                words = _words(as_text(text.as_py()))
                n = len(words)
                if n >= WINDOW and first < i:
                    kept = []
                elif pos.is_valid:
                    starts = np.array(pos.as_py(), np.int64)
                    gone = _covered(np.where(starts < 0, -1 - starts, starts), WINDOW, n)
                    kept = [words[k] for k in np.flatnonzero(~gone).tolist()]
                else:
                    kept = words
                data = b" ".join(kept)
                rows.append((None if i == LAST else i, n, n - len(kept), hashlib.sha256(data).hexdigest(), data.decode("utf-8", "replace") if with_text else None))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], [c.split()[0] for c in CLEANED.split(", ")])

    return finish


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, slots: int = SLOTS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text (null unless with_text).

    A word goes if it lies in a window of WINDOW words that also starts in a document with a smaller id. A null text has no
    words; a text of fewer than WINDOW words stays whole. A null id is larger than any other. Rows that repeat
    an id, with the same text or another, never remove anything from each other. Exact copies are compared once: the copies with larger
    ids lose all they have. Other columns are not read, so their names cannot clash. A text of any length is compared whole. An empty
    table gives an empty result.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("t1"), text.alias("text"))
    keyed = rows.select("id", "t1", F.xxhash64(F.lit(1), "text").alias("t2")).distinct().checkpoint()
    first = keyed.groupBy("t1", "t2").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    classes = join_groups(keyed, first, ["t1", "t2"], "n").select("id", "t1", F.coalesce("first", "id").alias("first")).checkpoint()
    # The three uses below read one shuffle of the texts, as they need the same columns of it.
    dealt = rows.repartition("id", "t1")
    # Sorted rows make the tasks' output the same if they are run again.
    whole = dealt.join(classes.filter("id = first").select("id", "t1"), ["id", "t1"]).select("id", "t1", "text").sortWithinPartitions("id", "t1")
    found = whole.mapInArrow(partial(anchors, n_slots=slots), "hash long, id long, t1 long, at int")
    same = Window.partitionBy("hash")
    shared = found.select("id", "t1", "at", F.min("id").over(same).alias("low"), F.max("id").over(same).alias("high")).filter("at < 0 or low < high")
    marked = shared.groupBy("id", "t1").agg(F.collect_list("at").alias("at"))
    near = dealt.join(marked, ["id", "t1"]).select("id", "t1", "text", "at").sortWithinPartitions("id", "t1")
    near = near.mapInArrow(partial(windows, n_slots=slots), "h1 long, h2 long, id long, t1 long, pos int")
    gone = near.select("id", "t1", "pos", F.min("id").over(Window.partitionBy("h1", "h2")).alias("low")).filter("pos < 0 or low < id")
    gone = gone.groupBy("id", "t1").agg(F.collect_list("pos").alias("pos"))
    judged = dealt.join(classes, ["id", "t1"]).join(gone, ["id", "t1"], "left").select("id", "text", "first", "pos")
    return judged.mapInArrow(_finisher(with_text), CLEANED)
