"""Quality rules from tokeniser fertility.

A public vocabulary is a yardstick: prose of a language that it knows needs few tokens for its characters, seldom falls back
to bytes, and spreads over many tokens. A vocabulary of byte strings is a second one. Texts outside the bands of their language,
or else of their script, are rejected. Bands are learnt from all labelled documents, with exact medians; those in BANDS are for what has too few of them.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import segments
from .common import as_text, prepare, stored
from .quality_gbt import held_out

#: Bounds of a worker's cache of words: entries, and bytes of an entry.
CACHE_ENTRIES, CACHE_BYTES = 400_000, 48
_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Line:
    """Accepted: a measure from `low` to `high` off its usual value, which is linear in log2 of the tokens. Short texts may
    be further off, by `width`."""

    level: float
    slope: float
    low: float
    high: float

    def accepts(self, n: int, value: float) -> bool:
        return self.low <= (value - self.level - self.slope * np.log2(n)) / width(n) <= self.high


@dataclass(frozen=True)
class Band:
    """Accepted: characters per token, byte-fallback share at most, and token entropy (bits) over the most that as many tokens
    could have, at least. lines, where learnt: of characters per token, of that by the second vocabulary, and of entropy."""

    low: float
    high: float
    fallback: float
    spread: float
    lines: tuple[Line | None, ...] = ()


#: Bands by language, then by script; "" is for all else. They are wide, for languages and scripts without labelled documents.
BANDS = {
    "en": Band(1.6, 8.0, 0.10, 0.40),
    "de": Band(1.4, 8.0, 0.10, 0.40),
    "fr": Band(1.3, 8.0, 0.10, 0.40),
    "es": Band(1.3, 8.0, 0.10, 0.40),
    "Latin": Band(1.3, 8.0, 0.15, 0.38),
    "Cyrillic": Band(1.0, 8.0, 0.20, 0.40),
    "Greek": Band(0.8, 8.0, 0.40, 0.40),
    "Han": Band(0.3, 3.0, 0.60, 0.40),
    "Arabic": Band(0.7, 6.0, 0.40, 0.40),
    "": Band(0.2, 10.0, 0.90, 0.30),
}
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Han", "Arabic")
_SCRIPT = {name: regex.compile(rf"\p{{Script={name}}}") for name in SCRIPTS}
_ASCII, _ASCII_LETTERS = re.compile(r"[\x00-\x7f]+"), re.compile(r"[A-Za-z]+")
#: A verdict needs so many tokens; shorter texts are left to the base rules.
LEAST_TOKENS = 20
#: A band is learnt from so many documents at least, and reaches so many robust standard deviations off.
LEAST_DOCS, REACH = 20, 3.5
#: A text of so many tokens is as uncertain again as a very long one.
SHORT = 1000
#: Bytes of texts whose words are looked up together, about.
TEXT_BYTES = 1 << 20
#: Bins in which values are counted in one round of the search for a median.
BINS = 256


def width(n: np.ndarray | int) -> np.ndarray | float:
    return np.sqrt(1 + SHORT / n)


class Meter:
    """Tokens of words by a SentencePiece vocabulary, and their number by byte strings with ranks, kept for the words that a
    worker has met. The second vocabulary takes each word with a space before it."""

    def __init__(self, model: bytes, ranks: bytes | None = None, pattern: str = ""):
        self.second = None
        if ranks is not None:
            pairs = (line.split() for line in ranks.splitlines() if line)
            self.second = tiktoken.Encoding("second", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.cache: dict[bytes, bytes] = {}
        self.long: dict[bytes, bytes] = {}

    def learn(self, texts: Iterable[list[bytes]]) -> None:
        """Encodes the words that are new, all at once: the number of tokens by the second vocabulary, negative, if there is one, then the ids by the
        first. Long words are kept until the next call."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        self.long = {}
        new = list(set().union(*texts).difference(self.cache))
        if not new:
            return
        strings = [w.decode("utf-8", "replace") for w in new]
        encoded = self.model.encode(strings, num_threads=1)
        if self.second is not None:
            count = self.second.encode_ordinary
            encoded = [(-sum(len(count(s)) for s in segments(" " + t)), *ids) for t, ids in zip(strings, encoded)]
        for word, ids in zip(new, encoded):
            (self.cache if len(word) <= CACHE_BYTES else self.long)[word] = array("i", ids).tobytes()

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, int]:
        """Ids by the first vocabulary, and the number of tokens by the second, 0 without one."""
        try:
            joined = b"".join(map(self.cache.__getitem__, words))
        except KeyError:  # long words, or such as have not been learnt
            if not all(w in self.cache or w in self.long for w in words):
                self.learn([words])
            joined = b"".join([self.long[w] if w in self.long else self.cache[w] for w in words])
        found = np.frombuffer(joined, np.int32)
        if self.second is None:
            return found, 0
        marks = found < 0
        return found[~marks], -int(found[marks].sum(dtype=np.int64))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of eight words found twice or more, first ones included. Ranks of windows of 2, 4 and 8 words are
    built from those of half the length, so that equal ranks are equal windows."""
    if len(words) <= window:
        return 0
    known: dict[bytes, int] = {}
    ranks = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    width = 1
    while width < window:
        pairs = ranks[:-width] * np.int64(len(words) + 1) + ranks[width:]
        values, ranks, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(values) == len(pairs):
            return 0
        width *= 2
    starts = np.flatnonzero(counts[ranks] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def duplicate_lines(data: bytes) -> int:
    lines = [line for line in data.split(b"\n") if line.strip(_SPACE)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script that most letters have; "" if there are none."""
    if text.isascii():
        return "Latin"
    rest = _ASCII.sub("", text)
    counts = {name: len(p.findall(rest)) for name, p in _SCRIPT.items()}
    counts["Latin"] += len(text) - len(_ASCII_LETTERS.sub("", text))
    best = max(SCRIPTS, key=counts.__getitem__)
    return best if counts[best] else ""


def measures(meter: Meter, words: list[bytes], n_chars: int) -> tuple[int, float, float, float, float | None]:
    """n_tokens, characters per token, byte-fallback share, spread (token entropy over its maximum), and characters per token of
    the second vocabulary, if there is one."""
    ids, second = meter.tokens(words)
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0, None
    values, counts = np.unique(ids, return_counts=True)
    fallback = float(counts[meter.is_byte[values]].sum()) / n
    share = counts / n
    entropy = float(-(share * np.log2(share)).sum())
    most = np.log2(min(n, meter.size))
    return n, n_chars / n, fallback, float(entropy / most) if most > 0 else 0.0, n_chars / second if second else None


def accepts(band: Band, n: int, fertility: float, fallback: float, spread: float, second: float | None = None) -> bool:
    if n < LEAST_TOKENS:
        return True
    found = zip(band.lines, (fertility, second, spread))
    return (
        band.low <= fertility <= band.high and fallback <= band.fallback and spread >= band.spread
        and all(line is None or value is None or line.accepts(n, value) for line, value in found)
    )


RULED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_tokens long, chars_per_token double, fallback_share double, token_spread double, "
    "chars_per_byte_token double"
)
MEASURED = RULED.replace("kept boolean, ", "") + ", lang string, script string"


def yardsticks(docs: DataFrame, model_path: str, ranks_path: str | None, pattern: str):  # noqa: ANN201
    """The vocabularies as a broadcast."""
    with open(model_path, "rb") as file:
        model = file.read()
    ranks = None
    if ranks_path is not None:
        with open(ranks_path, "rb") as file:
            ranks = file.read()
    return prepare(docs.sparkSession).sparkContext.broadcast((model, ranks, pattern))


def parts_of(text: str) -> tuple[bytes, list[bytes], int, int, bool]:
    """Bytes, words, characters of the words, words in repeated windows, and whether the base rules fail."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    space = len(data) - len(data.translate(None, _SPACE))
    repeated = repeated_words(words)
    return data, words, len(text) - space, repeated, len(words) < 20 or 100 * repeated > 30 * len(words)


def measured(
    docs: DataFrame, model_path: str, ranks_path: str | None = None, pattern: str = "", id_col: str = "doc_id", text_col: str = "text",
    lang_col: str | None = "lang",
) -> DataFrame:
    """One row per input row, as in MEASURED: what the base rules and both vocabularies measure, the language and the script."""
    shared = yardsticks(docs, model_path, ranks_path, pattern)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = _meter(shared)
        for batch in batches:
            rows, held, size = [], [], 0
            for k, text in enumerate(batch.column(1)):
                text = as_text(text.as_py())
                held.append((text, *parts_of(text)))
                size += len(held[-1][1])
                if size < TEXT_BYTES and k + 1 < batch.num_rows:
                    continue
                meter.learn(words for _, _, words, *_ in held)
                for text, data, words, chars, repeated, failed in held:
                    rows.append((
                        len(words), chars, len(data) - len(data.translate(None, _SYMBOLS)), duplicate_lines(data), repeated, failed,
                        *measures(meter, words, chars), script_of(text),
                    ))
                held, size = [], 0
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.int64(), *[pa.float64()] * 4, pa.string()]
            *columns, script = (pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2), script], [c.split()[0] for c in MEASURED.split(", ")])

    lang = F.col(lang_col) if lang_col else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), lang.cast("string").alias("lang"))
    return rows.mapInArrow(measure, MEASURED)


def medians(rows: DataFrame) -> dict[str, float]:
    """Exact medians of rows (key, value), finite values, by key. Each round counts the values of a key in BINS bins and goes on in the bin that holds the
    middle, so that the driver sees counts alone."""
    spans = rows.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).collect()
    still, found = {r["key"]: (r["lo"], r["hi"], 0, r["n"]) for r in spans}, {}
    while still:
        edges = rows.sparkSession.createDataFrame([(key, lo, hi) for key, (lo, hi, *_) in still.items()], "key string, lo double, hi double")
        inside = rows.join(F.broadcast(edges), "key").filter("value BETWEEN lo AND hi")
        at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).otherwise(0)
        counted = inside.groupBy("key", F.least(at, F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        bins: dict[str, list] = {}
        for r in sorted(counted.collect(), key=lambda r: r["bin"]):
            bins.setdefault(r["key"], []).append(r)
        for key, (_, _, below, n) in list(still.items()):
            ends = below + np.cumsum([r["n"] for r in bins[key]])
            one, two = (bins[key][int(np.searchsorted(ends, rank, "right"))] for rank in ((n - 1) // 2, n // 2))
            if one is two and one["lo"] < one["hi"]:
                still[key] = (one["lo"], one["hi"], below + sum(r["n"] for r in bins[key] if r["bin"] < one["bin"]), n)
            else:
                found[key] = (one["hi"] + two["lo"]) / 2
                del still[key]
    return found


def learnt(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> dict[str, Band]:
    """BANDS with lines for the languages and scripts that have LEAST_DOCS documents labelled good. rows: as in MEASURED.

    Learns from every document that is labelled good (1), is outside the held-out fold and passes the base rules. A script's
    lines are those of all its documents, whatever their language. A repeated id counts once. The lines are least squares; their reach rests on the median
    deviation, so that a few wrong labels hardly move it. A few numbers for each language and script reach the driver.
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    usable = usable.filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~held_out("_id"))
    chosen = usable.groupBy(F.col("_id").cast("long").alias("doc_id")).agg(F.min("_label").alias("_label")).filter("_label = 1").select("doc_id")
    fit = rows.filter(~F.col("base_failed") & (F.col("n_tokens") >= LEAST_TOKENS)).join(chosen, "doc_id")
    seen = F.struct(F.col("n_tokens").alias("n"), F.col("chars_per_token").alias("a"), F.col("token_spread").alias("c"), "lang", "script", F.col("chars_per_byte_token").alias("b"))
    fit = fit.groupBy("doc_id").agg(F.max(seen).alias("r")).select("r.*")
    names = F.array_remove(F.array_distinct(F.array(F.coalesce("lang", F.lit("")), "script")), "")
    fit = fit.select(F.explode(names).alias("name"), "script", F.log2("n").alias("x"), F.sqrt(1 + SHORT / F.col("n")).alias("width"), "a", "b", "c").checkpoint()
    sums = [F.count("*").alias("n"), F.mode("script", True).alias("script"), F.avg("x").alias("x"), F.var_pop("x").alias("xx")]
    for k in "abc":
        sums += [F.count(k).alias(f"n{k}"), F.avg(k).alias(k), F.covar_pop("x", k).alias(f"x{k}")]
    groups = fit.groupBy("name").agg(*sums).filter(F.col("n") >= LEAST_DOCS).collect()
    lines = {}
    for r in groups:
        for k in "abc":
            if r[f"n{k}"] == r["n"]:
                slope = r[f"x{k}"] / r["xx"] if r["xx"] > 1e-9 else 0.0
                lines[r["name"], k] = (r[k] - slope * r["x"], slope)
    if not lines:
        return dict(BANDS)
    table = [(name, k, f"{k}:{name}", *line) for (name, k), line in lines.items()]
    table = fit.sparkSession.createDataFrame(table, "name string, k string, key string, level double, slope double")
    value = F.when(F.col("k") == "a", F.col("a")).when(F.col("k") == "b", F.col("b")).otherwise(F.col("c"))
    off = fit.join(F.broadcast(table), "name").select("key", ((value - F.col("level") - F.col("slope") * F.col("x")) / F.col("width")).alias("value")).checkpoint()
    middle = medians(off)
    centres = off.sparkSession.createDataFrame(list(middle.items()), "key string, middle double")
    apart = medians(off.join(F.broadcast(centres), "key").select("key", F.abs(F.col("value") - F.col("middle")).alias("value")))
    bands = dict(BANDS)
    for r in groups:
        name, found = r["name"], []
        for k in "abc":
            key, reach = f"{k}:{name}", REACH * 1.4826 * apart.get(f"{k}:{name}", 0.0)
            upper = middle[key] + reach if k in "ab" and key in middle else float("inf")
            found.append(Line(*lines[name, k], middle[key] - reach, upper) if key in middle else None)
        bands[name] = replace(BANDS.get(name) or BANDS[r["script"]], lines=tuple(found))
    return bands


def fit_bands(
    docs: DataFrame, labels: DataFrame, model_path: str, ranks_path: str | None = None, pattern: str = "", id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang", label_col: str = "quality",
) -> dict[str, Band]:
    """The bands that `learnt` makes of the labelled documents."""
    ids = labels.select(id_col).distinct()
    return learnt(measured(docs.join(ids, id_col, "left_semi"), model_path, ranks_path, pattern, id_col, text_col, lang_col), labels, id_col, label_col)


def judged(rows: DataFrame, bands: dict[str, Band]) -> DataFrame:
    """Rows as in MEASURED, with kept, as in RULED."""
    names = [c.split()[0] for c in RULED.split(", ")]
    read = ["lang", "script", "base_failed", "n_tokens", "chars_per_token", "fallback_share", "token_spread", "chars_per_byte_token"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for lang, script, failed, *found in zip(*(batch.column(c).to_pylist() for c in read)):
                kept.append(not failed and bool(accepts(bands.get(lang or "", None) or bands[script], *found)))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.bool_()) if c == "kept" else batch.column(c) for c in names], names)

    return rows.mapInArrow(judge, RULED)


def quality_rules(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
    bands: dict[str, Band] = BANDS, ranks_path: str | None = None, pattern: str = "",
) -> DataFrame:
    """One row per input row, as in RULED.

    base_failed: under 20 words, or over 30 % of them in repeated windows. kept: not base_failed, and inside the band of
    the language, or of the script where the language has no band or is null. A null or empty text has no words and
    fails. Texts are read whole whatever their length; rows are independent, so repeated rows give repeated
    results. Other columns aren't read. chars_per_byte_token is null without a second vocabulary (ranks_path, pattern).
    """
    return judged(measured(docs, model_path, ranks_path, pattern, id_col, text_col, lang_col), bands)


def learnt_rules(docs: DataFrame, labels: DataFrame, model_path: str, ranks_path: str | None = None, pattern: str = "") -> DataFrame:
    """`quality_rules` by the bands that all labelled documents give; texts are measured once, and their numbers stored."""
    rows = stored(measured(docs, model_path, ranks_path, pattern))
    return judged(rows, learnt(rows, labels))


_METERS: dict[int, Meter] = {}


def _meter(shared) -> Meter:  # noqa: ANN001
    """A worker's meter stays for its next tasks, with the words it has met."""
    key = hash(shared.value)
    if key not in _METERS:
        _METERS.clear()
        _METERS[key] = Meter(*shared.value)
    return _METERS[key]
