"""License scans: fuzzy search for short notices.

A notice of which at most k characters are wrong has one of its k + 1 pieces intact (pigeonhole). An Aho-Corasick automaton
finds the pieces of all notices in one pass; only the neighbourhood of each hit is given to the regex library, whose
bounded-error matching verifies the edits and gives the span. A notice starts and ends with a word of the text, so that the rest of a
word that holds one counts as edits, and another version's number is no damaged one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, prepare

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Notices that are also searched for with errors: words as normalised, label, characters that may be wrong.
NOTICES = (
    ("under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("apache license version 2", "apache-2", 2),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("mozilla public license version 2", "mpl-2", 2),
    ("creative commons attribution", "cc-by", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 3),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
    ("all rights reserved", "proprietary", 1),
)

#: Lower case for A-Z; digits, a-z and all that isn't ASCII stay; the rest separates words.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

_BLANK = re.compile(" ")


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 parts of the notice, of about equal length, with their offsets."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(i, notice[i:j]) for i, j in zip(cuts, cuts[1:])]


def _pattern(notice: str, errors: int) -> str:
    """The notice between blanks, with so many errors. Where it ends in a version, that or a damaged word may stand there, but no other number."""
    version = notice.rpartition(" ")[2]
    end = rf"(?:(?<= {version})|(?<! [0-9]+)(?! [0-9]+ ))" if version.isdigit() else ""
    return f"(?b)(?<= )(?:{regex.escape(notice)}){{e<={errors}}}{end}(?= )"


@dataclass
class Hit:
    """A place of a notice: words first to last, counted from 0."""

    first: int
    last: int
    label: str
    edits: int
    exact: bool
    likeness: float


@dataclass
class Scan:
    n_words: int
    hits: list[Hit] = field(default_factory=list)


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, notices: tuple = NOTICES):
        self.base, self.notices = base, notices
        # a match that runs forwards may miss words left out at its end, and one that runs backwards those at its start
        self.verify = [(regex.compile(_pattern(n, k)), regex.compile("(?r)" + _pattern(n, k))) for n, _, k in notices]
        entries: dict[str, list] = {}
        for phrase, label in base.items():
            entries.setdefault(f" {phrase} ", []).append((None, 0, label))
        for i, (notice, label, errors) in enumerate(notices):
            for at, piece in pieces(notice, errors):
                entries.setdefault(piece, []).append((i, at, label))
        self.seeds = ahocorasick.Automaton()
        for seed, uses in entries.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()

    def scan(self, text: str) -> Scan:
        words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
        if not words:
            return Scan(0)
        flat = b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass")
        found, near, blanks = Scan(len(words)), {}, []
        for end, (length, uses) in self.seeds.iter(flat):
            start = end + 1 - length
            blanks = blanks or [m.start() for m in _BLANK.finditer(flat)]
            for i, at, label in uses:
                if i is None:
                    first = bisect_left(blanks, start)
                    found.hits.append(Hit(first, bisect_left(blanks, end) - 1, label, 0, True, 1.0))
                else:
                    notice, _, errors = self.notices[i]
                    # a blank more on both sides, and the next word if it is a number
                    low, high = max(0, start - at - errors - 1), start - at + len(notice) + errors + 1
                    if notice[-1:].isdigit():
                        high = max(high, flat.find(" ", high) + 1)
                    near.setdefault(i, set()).add((low, min(high, len(flat))))
        for i, places in near.items():
            notice, label, _ = self.notices[i]
            for m in self._verified(i, flat, places):
                edits = sum(m.fuzzy_counts)
                inner = m.group().strip(" ")
                lead = m.start() + (len(m.group()) - len(m.group().lstrip(" ")))
                first = max(0, bisect_left(blanks, lead) - (0 if flat[lead : lead + 1] == " " else 1))
                found.hits.append(Hit(first, first + inner.count(" "), label, edits, False, 1 - edits / len(notice)))
        return found

    def _verified(self, i: int, flat: str, places: set[tuple[int, int]]) -> list[regex.Match]:
        """The best match of a notice at each candidate place, in order; of matches that overlap, the one with the fewest edits, or
        the first, stands."""
        edits = lambda m: sum(m.fuzzy_counts)
        both = ([m for way in self.verify[i] if (m := way.search(flat, low, high))] for low, high in sorted(places))
        matches = [min(found, key=edits) for found in both if found]
        kept: list[regex.Match] = []
        starts: list[int] = []
        for m in sorted(matches, key=lambda m: (sum(m.fuzzy_counts), m.start())):
            at = bisect_left(starts, m.start())
            if (at and kept[at - 1].end() > m.start()) or (at < len(kept) and starts[at] < m.end()):
                continue
            kept.insert(at, m)
            starts.insert(at, m.start())
        return kept

    def spans(self, text: str, scan: Scan) -> list[dict]:
        """The hits with their places in the text as it is, in code points."""
        if not scan.hits:
            return []
        at = [m.span() for m in _WORD.finditer(text)]
        return [
            {"start": at[h.first][0], "end": at[min(h.last, len(at) - 1)][1], "label": h.label, "edits": h.edits}
            for h in sorted(scan.hits, key=lambda h: (h.first, h.last, h.label, h.edits))
        ]


SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<start:long,end:long,label:string,edits:int>>"
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32())]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: tuple = NOTICES) -> DataFrame:
    """One row per input row, as in SCANNED.

    n_base, first_word and last_word are of the places where a base phrase's words stand consecutively, overlapping ones
    included; labels adds those of notices found with errors; spans has both, in code points of the text. score is the likeness
    of the best place: 1 for an intact phrase, 0 where nothing is found. A null or empty text, or one without words, has no
    places, empty labels, null first_word and last_word. Texts of any length are scanned whole. Rows are
    independent, repeated rows give repeated results, and no other column is read.
    """
    prepare(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = as_text(text.as_py())
                found = scanner.scan(text)
                starts = [h.first for h in found.hits if h.exact]
                rows.append((
                    found.n_words, len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({h.label for h in found.hits if h.exact})), ",".join(sorted({h.label for h in found.hits})),
                    max((h.likeness for h in found.hits), default=0.0), scanner.spans(text, found),
                ))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), _SPANS]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, SCANNED)
