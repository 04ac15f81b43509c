"""Bands of the fertility rules against numpy over all labelled documents."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from kinspark.llm import fertility, quality_gbt

MODEL, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def line_of(n, values, upper):
    spot = np.stack((np.ones(len(n)), np.log2(n)), axis=1)
    level, slope = np.linalg.lstsq(spot, values, rcond=None)[0]
    off = (values - level - slope * np.log2(n)) / fertility.width(n)
    middle = np.median(off)
    reach = fertility.REACH * 1.4826 * np.median(np.abs(off - middle))
    return [level, slope, middle - reach, middle + reach if upper else np.inf]


def test_bands_learn_from_every_labelled_document(spark):
    """More labelled documents than 20,000, and an id that is repeated: the lines are those of all of them."""
    rng = random.Random(6)
    words = ["the", "model", "of", "a", "river", "stone", "Über", "naïve", "quick", "data", "z9q", "between", "letters"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(22, 40))), "en" if k % 3 else "xx") for k in range(27_000)] + [(7, "short", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    labels = spark.createDataFrame([(k, int(k % 50 > 0)) for k in range(27_000)], "doc_id long, quality int")
    bands = fertility.fit_bands(docs, labels, MODEL, RANKS, public_tokenizers.PATTERN)
    with open(MODEL, "rb") as model, open(RANKS, "rb") as ranks:
        meter = fertility.Meter(model.read(), ranks.read(), public_tokenizers.PATTERN)
    usable = {r.doc_id for r in labels.filter("quality = 1").filter(~quality_gbt.held_out("doc_id")).collect()}
    groups = {"en": [], "xx": [], "Latin": []}
    for i, text, lang in rows:
        _, found, chars, _, failed = fertility.parts_of(text)
        n, a, _, c, b = fertility.measures(meter, found, chars)
        if i in usable and not failed and n >= fertility.LEAST_TOKENS:
            groups[lang].append((n, a, b, c))
            groups["Latin"].append((n, a, b, c))
    assert len(groups["Latin"]) > 20_000
    for name, group in groups.items():
        n, *values = np.array(group).T
        for k, (line, v) in enumerate(zip(bands[name].lines, values)):
            assert np.allclose([line.level, line.slope, line.low, line.high], line_of(n, v, k < 2), rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("bins", [256, 3])
def test_medians(spark, bins, monkeypatch):
    monkeypatch.setattr(fertility, "BINS", bins)
    rng = np.random.default_rng(2)
    values = {"odd": rng.normal(size=501), "even": rng.normal(size=500) * 1e-9 + 5, "ties": rng.integers(0, 3, 40) / 7, "one": [2.5], "two": [1.0, 4.0], "far": [1e300, -1e290, 0, 1e-300, 3]}
    rows = spark.createDataFrame([(k, float(v)) for k, group in values.items() for v in group], "key string, value double")
    assert fertility.medians(rows) == {k: float(np.median(v)) for k, v in values.items()}
    assert fertility.medians(rows.filter(F.lit(False))) == {}


def test_words_and_scripts():
    """Long words leave the cache and count as any other; scripts are counted over all letters."""
    with open(MODEL, "rb") as model, open(RANKS, "rb") as ranks:
        meter = fertility.Meter(model.read(), ranks.read(), public_tokenizers.PATTERN)
    words = [b"stone", b"x" * 500, b"stone", "naïve".encode()]
    ids, second = meter.tokens(words)
    assert list(ids) == [i for w in words for i in meter.model.encode(w.decode())] and words[1] not in meter.cache
    assert second == sum(len(meter.second.encode_ordinary(" " + w.decode())) for w in words)
    for text in ("abc дом дома", "ab дом дома", "Ελλάδα xyz", "漢字漢字 abc", "12 ٣ é", "ªº²"):
        counts = {name: len(regex.findall(rf"\p{{Script={name}}}", text)) for name in fertility.SCRIPTS}
        best = max(fertility.SCRIPTS, key=counts.__getitem__)
        assert fertility.script_of(text) == (best if counts[best] else "")


@pytest.mark.parametrize("entries", [400_000, 2])
def test_words_learnt_together(entries, monkeypatch):
    """Words of many texts are encoded at once, whatever the cache holds: the tokens are those of each text by itself."""
    monkeypatch.setattr(fertility, "CACHE_ENTRIES", entries)
    with open(MODEL, "rb") as model, open(RANKS, "rb") as ranks:
        vocabularies = model.read(), ranks.read(), public_tokenizers.PATTERN
    texts = [[b"the", b"river", b"y" * 90], [], ["naïve".encode(), b"the"], [b"q" * 90, b"river"], [b"stone"]]
    meter = fertility.Meter(*vocabularies)
    meter.learn(texts[:3])
    for words in texts:
        ids, second = meter.tokens(words)
        alone, count = fertility.Meter(*vocabularies).tokens(words)
        assert list(ids) == list(alone) and second == count
