"""Alignment of two tokenizers' ids on the same texts, and how often their ids meet in a corpus.

Both tokenizers cut the same bytes. Offsets where tokens of both end cut the two id lists into groups, and the tokens of a group
whose bytes overlap are linked. A text is taken apart where no token of either tokenizer can reach over, before a space that follows a word, and
a word's groups and links are kept, so that a word costs its alignment once. Corpus-wide counts of linked ids are added up by words,
by lots of documents, and by shuffles; each lot gets back the counts of its own pairs alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, batched, groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SEGMENT_CHARS
from .common import as_text, prepare, stored, unused
from .packing import byte_ranks

#: Characters of text of one lot, about; its pairs and their counts meet in one task.
LOT_CHARS = 16_000_000
#: A worker's kept words: at most so many entries, once the document at hand is done.
KEPT_WORDS = 300_000
#: Texts whose new words are learnt at once.
RUN_TEXTS = 40
#: Spaces before which a cut may be wrong: in runs of spaces, and among other white space.
_RAGGED = re.compile(r"\x20(?:\s|\Z)")
_CUT = re.compile(r"(?<=\S)(?=\x20)")


def words(text: str) -> list[str]:
    """A text that starts with a space, cut before spaces at which both tokenizers start anew; each part lacks its first space.

    A space starts a token of both where it follows other than white space, or, standing alone, comes before other than it.
    """
    if _RAGGED.search(text):
        return [part[1:] for part in _CUT.split(text)]
    return text.split(" ")[1:]


def common_ends(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of one, and of the other, end by each offset where tokens of both end, in order."""
    index_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))
    index_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(index_a.keys() & index_b.keys())
    return list(map(index_a.__getitem__, common)), list(map(index_b.__getitem__, common))


def group_links(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Ids of one group whose bytes overlap; both lists end at the same offset."""
    if len(a) == 1 or len(b) == 1:
        return [(x, y) for x in a for y in b]
    found, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        found.append((a[i], b[j]))
        one, two = ends_a[i], ends_b[j]
        i, j = i + (one <= two), j + (two <= one)
    return found


@dataclass
class Groups:
    """Id lists cut at common ends, and the linked ids."""

    groups: list[tuple[list[int], list[int]]]
    links: list[tuple[int, int]]


def align(a: list[int], b: list[int], length_a: list[int], length_b: list[int]) -> Groups:
    """a, b: ids of tokens of the given numbers of bytes, whose sums are equal."""
    ends_a, ends_b = list(accumulate(length_a)), list(accumulate(length_b))
    groups, links, i, j = [], [], 0, 0
    for to_i, to_j in zip(*common_ends(ends_a, ends_b)):
        groups.append((a[i:to_i], b[j:to_j]))
        links += group_links(*groups[-1], ends_a[i:to_i], ends_b[j:to_j])
        i, j = to_i, to_j
    return Groups(groups, links)


class Aligner:
    """The two tokenizers: one of byte-level BPE, on the text after a space, and a SentencePiece model that adds the space itself.
    Words that have been met are kept, by number: how many ids and groups they have, their groups as text, and their linked ids."""

    def __init__(self, serialized: str, model: bytes, pattern: str):
        ranks = byte_ranks(serialized)
        if ranks is None:
            raise ValueError("the first tokenizer must be byte-level BPE without further steps")
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # a piece that holds a space after another character would reach over the cuts
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        texts = lambda size, last: np.array([f"{i}{sign}" for i in range(size) for sign in (",", last)], object)
        self.text_a, self.text_b = texts(len(self.bytes_a), "|"), texts(len(self.bytes_b), ";")
        self.kept: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.kept.clear()
        #: n_a, n_b, n_groups, n_links, 1 where the bytes differ, and where the word's linked ids end
        self.counts = np.zeros((1 << 15, 6), np.int64)
        self.pairs = np.zeros(1 << 17, np.int64)
        self.written: list[str] = []

    def tokens(self, text: str) -> tuple[list[int], list[int], list[bytes], list[bytes]] | None:
        """Ids of a text after a space by both, and the ids' bytes; None if the joined bytes of either differ from the text's."""
        whole = (" " + text).encode()
        # the model adds no space to nothing; a space that ends a text is cut off it as any other
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text) if text else self.b.encode("a ")[len(self.b.encode("a")) :]
        part_a, part_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        return (a, b, part_a, part_b) if b"".join(part_a) == whole and b"".join(part_b) == whole else None

    def groups(self, text: str) -> Groups | None:
        found = self.tokens(text)
        return found and align(*found[:2], list(map(len, found[2])), list(map(len, found[3])))

    def keep(self, words: list[str]) -> None:
        """Keeps new words that have no white space at their ends, or a single one of any kind. They are aligned as one text, whose words end at
        common ends."""
        first, found = len(self.written), self.tokens(" ".join(words))
        if not found and len(words) > 1:
            for word in words:
                self.keep([word])
            return
        rows = np.zeros((len(words), 6), np.int64)
        end = int(self.counts[first - 1, 5]) if first else 0
        if not found:
            rows[0, 4:] = 1, end
            self.written.append("")
        else:
            a, b = (np.array(x, np.int64) for x in found[:2])
            ends_a, ends_b = (list(accumulate(map(len, x))) for x in found[2:])
            cut = [np.array(x, np.int64) for x in common_ends(ends_a, ends_b)]
            ends_a, ends_b = np.array(ends_a), np.array(ends_b)
            word_ends = np.cumsum([len(w.encode()) + 1 for w in words])
            # the links of all groups at once: one at each end of a token of either
            steps = np.union1d(ends_a, ends_b)
            links = a[np.searchsorted(ends_a, steps)] << 32 | b[np.searchsorted(ends_b, steps)]
            places = (np.searchsorted(ends, word_ends, "right") for ends in (ends_a, ends_b, ends_a[cut[0] - 1], steps))
            till = np.stack(list(places), axis=1)
            rows[:, :4] = np.diff(till, axis=0, prepend=0)
            rows[:, 5] = end + till[:, 3]
            while end + len(links) > len(self.pairs):
                self.pairs = np.concatenate((self.pairs, np.zeros_like(self.pairs)))
            self.pairs[end : end + len(links)] = links
            texts = self._texts(a, b, cut).tolist()
            self.written += ["".join(texts[x:y])[:-1] for x, y in zip([0, *(till[:-1, 0] + till[:-1, 1]).tolist()], (till[:, 0] + till[:, 1]).tolist())]
        while first + len(words) > len(self.counts):
            self.counts = np.concatenate((self.counts, np.zeros_like(self.counts)))
        self.counts[first : first + len(words)] = rows
        self.kept.update(zip(words, range(first, first + len(words))))

    def _texts(self, a: np.ndarray, b: np.ndarray, cut: list[np.ndarray]) -> np.ndarray:
        """Each id as text with the sign that follows it, a group's ids of one side before those of the other."""
        out = np.empty(len(a) + len(b), object)
        for ids, own, other, table in ((a, cut[0], np.concatenate(([0], cut[1][:-1])), self.text_a), (b, cut[1], cut[0], self.text_b)):
            at = np.arange(len(ids))
            group = np.searchsorted(own, at, "right")
            out[at + other[group]] = table[2 * ids + (at + 1 == own[group])]
        return out

    def learn(self, missed: list[str]) -> None:
        plain = [w for w in missed if w and not w[0].isspace() and not w[-1].isspace()] if self.cuts else []
        if plain:
            self.keep(plain)
        for word in missed:
            if word not in self.kept:
                self.keep([word])

    def parts(self, text: str) -> Iterator[list[str]]:
        """The text's words, some at a time."""
        if not self.cuts:
            yield [text]
            return
        whole, at = " " + text, 0
        while len(whole) - at > SEGMENT_CHARS and (cut := _CUT.search(whole, at + SEGMENT_CHARS)):
            yield words(whole[at : cut.start()])
            at = cut.start()
        yield words(whole[at:] if at else whole)

    def numbers(self, parts: list[list[str]]) -> list[list[int]]:
        """Of each part, a list of words."""
        found = [list(map(self.kept.get, part)) for part in parts]
        if any(None in numbers for numbers in found):
            self.learn(list(dict.fromkeys(w for part, numbers in zip(parts, found) if None in numbers for w, n in zip(part, numbers) if n is None)))
            found = [list(map(self.kept.get, part)) if None in numbers else numbers for part, numbers in zip(parts, found)]
        return found

    def of_texts(self, texts: list[str]) -> Iterator[Iterator[list[int]]]:
        """Words' numbers of each text, some at a time: short texts together, so that their new words are learnt together."""
        for many, run in groupby(texts, lambda t: self.cuts and len(t) <= SEGMENT_CHARS):
            for short in batched(run, RUN_TEXTS) if many else ():
                for numbers in self.numbers([words(" " + t) for t in short]):
                    yield iter([numbers])
            for text in () if many else run:
                yield (self.numbers([part])[0] for part in self.parts(text))


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(shared) -> Aligner:  # noqa: ANN001
    key = hash(shared.value)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*shared.value)
    return _ALIGNERS[key]


def _shared(docs: DataFrame, byte_path: str, piece_path: str, pattern: str):  # noqa: ANN202
    with open(byte_path, encoding="utf-8") as one, open(piece_path, "rb") as two:
        return prepare(docs.sparkSession).sparkContext.broadcast((one.read(), two.read(), pattern))


_COUNTED = ("n_a", "n_b", "n_groups", "n_links")
#: A row per document, and one per lot. Of a document: its words' numbers, and how often it has them. Of a lot, which has keys: its words' numbers,
#: where each word's pairs end among `places`, places in the keys, the pairs that it holds (two ids in one number), and how often.
LOTS = (
    "lot long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words array<int>, times array<int>, "
    "ends array<int>, places array<int>, keys array<long>, amounts array<long>"
)


class _Lot:
    """What a task gathers of the documents of one lot."""

    def __init__(self):
        self.id, self.chars = uuid.uuid4().int >> 65, 0
        self.words: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def row(self, aligner: Aligner) -> dict:
        used, at = np.unique(np.concatenate(self.words), return_inverse=True)
        times = np.zeros(len(used), np.int64)
        np.add.at(times, at, np.concatenate(self.times))
        ends, sizes = aligner.counts[used, 5], aligner.counts[used, 3]
        last = np.cumsum(sizes)
        keys, places = np.unique(aligner.pairs[np.arange(last[-1]) + np.repeat(ends - last, sizes)], return_inverse=True)
        amounts = np.zeros(len(keys), np.int64)
        np.add.at(amounts, places, np.repeat(times, sizes))
        return {"lot": self.id, "words": used, "ends": last, "places": places, "keys": keys, "amounts": amounts}


def lots(docs: DataFrame, byte_path: str, piece_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """LOTS. A lot has documents of one task that follow each other; its id is drawn anew at each run, so the rows are to be stored."""
    shared = _shared(docs, byte_path, piece_path, pattern)
    names = [c.split()[0] for c in LOTS.split(", ")]
    kinds = {"lot": pa.int64(), "doc_id": pa.int64(), "groups_sha256": pa.string(), **{c: pa.int64() for c in _COUNTED}}
    kinds |= {c: pa.list_(pa.int32()) for c in ("words", "times", "ends", "places")} | {c: pa.list_(pa.int64()) for c in ("keys", "amounts")}

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[c]) for c in names], names)

    def document(aligner: Aligner, parts: Iterator[list[int]]) -> dict:
        counts, sha, numbers = np.zeros(6, np.int64), hashlib.sha256(), []
        for k, part in enumerate(parts):
            numbers.append(np.array(part, np.int64))
            sha.update((";" * bool(k) + ";".join(map(aligner.written.__getitem__, part))).encode())
            counts += aligner.counts[numbers[-1]].sum(axis=0)
        if counts[4]:
            return {}
        found, times = np.unique(np.concatenate(numbers), return_counts=True)
        return {**dict(zip(_COUNTED, counts.tolist())), "groups_sha256": sha.hexdigest(), "words": found, "times": times}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, lot = _aligner(shared), _Lot()
        nothing = {**dict.fromkeys(_COUNTED, 0), "groups_sha256": "", "words": [], "times": []}
        for batch in batches:
            rows, texts = [], list(map(as_text, batch.column(1).to_pylist()))
            for doc, text, parts in zip(batch.column(0).to_pylist(), texts, aligner.of_texts(texts)):
                found = document(aligner, parts) if text else {}
                rows.append({**nothing, **found, "lot": lot.id, "doc_id": doc})
                lot.chars += len(text)
                if found:
                    lot.words.append(found["words"])
                    lot.times.append(found["times"])
            full = len(aligner.written) > KEPT_WORDS
            if lot.words and (full or lot.chars > LOT_CHARS):
                rows.append(lot.row(aligner))
                lot = _Lot()
            if full:
                aligner.forget()
            yield table(rows)
        if lot.words:
            yield table([lot.row(aligner)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, LOTS)


def lot_pairs(rows: DataFrame) -> DataFrame:
    """lot, place, key, amount: the pairs of the lots of stored rows."""
    each = rows.filter("keys IS NOT NULL").select("lot", F.posexplode(F.arrays_zip("keys", "amounts")).alias("place", "pair"))
    return each.select("lot", "place", F.col("pair.keys").alias("key"), F.col("pair.amounts").alias("amount"))


def totals(pairs: DataFrame) -> DataFrame:
    """key, count, and whether no other pair with the same second id has a larger count."""
    counts = pairs.groupBy("key").agg(F.sum("amount").alias("count")).withColumn("b", F.col("key").bitwiseAND(0xFFFFFFFF))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("key", "count", (F.col("count") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, count, best: how many links of all documents hold an id pair linked; nulls and empty texts have none."""
    found = totals(lot_pairs(stored(lots(docs, byte_path, piece_path, pattern, id_col, text_col))))
    return found.select(F.shiftright("key", 32).cast("int").alias("a"), F.col("key").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "count", "best")


GROUPS = "array<struct<a:array<int>,b:array<int>>>"


def aligned_groups(docs: DataFrame, byte_path: str, piece_path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", into: str = "groups") -> DataFrame:
    """The rows of docs and a column of groups: the ids of both tokenizers between offsets where tokens of both end. Empty for texts that are null or
    empty, or that the tokens do not spell out. A clashing name gets an underscore."""
    (into,), shared = unused(docs, into), _shared(docs, byte_path, piece_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            found = []
            for text in map(as_text, batch.column(batch.schema.get_field_index(text_col)).to_pylist()):
                own = [aligner.groups(w) for part in aligner.parts(text) for w in part] if text else []
                found.append([] if None in own else [{"a": a, "b": b} for g in own for a, b in g.groups])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, into])

    schema = docs.withColumn(into, F.lit(None).cast(GROUPS)).schema
    return docs.mapInArrow(run, schema)


DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and values, of a column of lists."""
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    return offsets.astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _weigh(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of a lot with the sums of their pairs' counts. rows: LOTS; pairs: place, count, best."""
    is_lot = np.array(rows.column("keys").is_valid())
    docs, lot = rows.filter(pa.array(~is_lot)), rows.filter(pa.array(is_lot))
    sums = np.zeros((2, docs.num_rows), np.int64)
    if lot.num_rows:
        words, ends, places = (lot.column(c)[0].values.to_numpy() for c in ("words", "ends", "places"))
        offsets, own = _lists(docs, "words")
        times, at = _lists(docs, "times")[1], np.searchsorted(words, own)
        order = np.argsort(pairs.column("place").to_numpy())
        for out, name in zip(sums, ("best", "count")):
            values = np.array(pairs.column(name)).astype(np.int64)[order]
            run = np.concatenate(([0], np.cumsum(values[places])))
            by_word = run[ends] - run[np.concatenate(([0], ends[:-1]))]
            run = np.concatenate(([0], np.cumsum(by_word[at] * times)))
            out[:] = run[offsets[1:]] - run[offsets[:-1]]
    columns = {c: docs.column(c) for c in ("doc_id", *_COUNTED)} | {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": docs.column("groups_sha256")}
    return pa.table(columns)


def alignment(docs: DataFrame, byte_path: str, piece_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: DIGESTS.

    Groups are cut where tokens of both end, links are pairs of tokens whose bytes overlap, and a pair of ids counts as often as it is linked in
    all documents; ties for the largest count of a second id all count as best. Texts that are null or empty, or that the joined
    tokens of either do not spell out, have zeros and an empty hash, and add to no count. Very long texts are taken whole, in
    runs of words. Repeated rows count each; null ids stay; other columns aren't read, so their names do not matter. An
    empty table gives an empty one.
    """
    rows = stored(lots(docs, byte_path, piece_path, pattern, id_col, text_col))
    pairs = lot_pairs(rows)
    counted = pairs.join(totals(pairs), "key").select(F.col("lot").alias("lot"), F.col("place").alias("place"), "count", "best")
    return rows.groupBy("lot").cogroup(counted.groupBy("lot")).applyInArrow(_weigh, DIGESTS)
