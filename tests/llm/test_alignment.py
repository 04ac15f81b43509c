"""Token alignment against a plain version over whole texts."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kinspark.llm import queries, token_alignment

SF = "/root/testdata/sf0.001"
ONE, TWO = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Plain:
    """Whole texts, by the libraries, offset by offset."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(ONE), sentencepiece.SentencePieceProcessor(model_file=TWO)
        self.a.encode_special_tokens = True
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [i for i in range(256) if i not in visible]
        self.byte = {chr(i): i for i in visible} | {chr(256 + k): i for k, i in enumerate(hidden)}
        self.spelt = {i: bytes(self.byte[c] for c in t) for t, i in json.load(open(ONE))["model"]["vocab"].items() if all(c in self.byte for c in t)}

    def piece(self, i):
        text = self.b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if self.b.is_byte(i) else text.replace("\u2581", " ").encode()

    def tokens(self, text):
        """(id, start, end) of both; nothing where the bytes differ."""
        out = []
        for ids, spelt in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.spelt.get), (self.b.encode(text), self.piece)):
            at, own = 0, []
            for i in ids:
                own.append((i, at, at + len(spelt(i))))
                at = own[-1][2]
            if b"".join(spelt(i) for i in ids) != (" " + text).encode():
                return [], []
            out.append(own)
        return out

    def groups(self, text):
        a, b = self.tokens(text) if text else ([], [])
        both, found = {e for *_, e in a} & {e for *_, e in b}, {}
        for side, own in enumerate((a, b)):
            group = 0
            for i, _, e in own:
                found.setdefault(group, ([], []))[side].append(i)
                group += e in both
        return [found[g] for g in sorted(found)]

    def links(self, text):
        a, b = self.tokens(text) if text else ([], [])
        ends_b, found, j = [e for *_, e in b], [], 0
        for i, s, e in a:
            while ends_b[j] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                found.append((i, b[k][0]))
                k += 1
        return found


def awkward():
    rng = random.Random(3)
    signs = ["a", "B", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u3000", "é", "漢字", "😀", "e\u0301", "'s", "12", "!?", "<|endoftext|>", "<s>", "the", "Überfluss"]
    texts = [None, "", " ", "  ", "\n", "a", " a", "a ", "two  spaces ", "\u2581", "x\u2581y", "<unk>", "nul\x00", "a \n b", "a\n b", "a \u3000b"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(3, "a"), (None, "again and again"), (None, None)]
    return rows


@pytest.fixture(scope="module", params=["awkward", "small", "empty"])
def docs(request, spark):
    if request.param == "small":
        return spark.read.parquet(f"{SF}/documents.parquet")
    frame = spark.createDataFrame(awkward() if request.param == "awkward" else [], "doc_id long, text string")
    return frame.selectExpr("*", *[f"'x' as {c}" for c in ("lot", "keys", "words", "key", "count", "groups", "n_a")])


def wanted(rows):
    plain = Plain()
    links = [plain.links(t) for _, t in rows]
    counts = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (i, t), own in zip(rows, links):
        groups = plain.groups(t)
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(own), sum(counts[p] == best[p[1]] for p in own),
            sum(counts[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out, counts, best


def same(found, expected):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("lot", [16_000_000, 300])
def test_digests_and_counts(docs, lot, monkeypatch):
    monkeypatch.setattr(token_alignment, "LOT_CHARS", lot)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected, counts, best = wanted(rows)
    same(token_alignment.alignment(docs, ONE, TWO).select("doc_id", *COLUMNS).collect(), expected)
    if lot == 300:
        found = token_alignment.pair_counts(docs, ONE, TWO).collect()
        same([(r.a, r.b, r["count"], r.best) for r in found], [(a, b, n, n == best[b]) for (a, b), n in counts.items()])


def test_groups(docs):
    plain = Plain()
    for r in token_alignment.aligned_groups(docs, ONE, TWO, into="kept").collect():
        assert [(g.a, g.b) for g in r.kept] == plain.groups(r.text)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(queries.op11_token_alignment(spark, SF).select("doc_id", *COLUMNS).collect(), wanted(rows)[0])


def test_long_text(spark):
    """Over two segments, and words of any length; kept words are forgotten between."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh .,\n") for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    text = " ".join(rng.choice(words) for _ in range(190_000)) + " " + "x" * 3000 + " end"
    assert len(text) > 1 << 20
    frame = spark.createDataFrame([(1, text), (2, "short"), (3, text[:1000])], "doc_id long, text string")
    same(token_alignment.alignment(frame, ONE, TWO).select("doc_id", *COLUMNS).collect(), wanted([(1, text), (2, "short"), (3, text[:1000])])[0])


def test_forgetting(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "KEPT_WORDS", 20)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same(token_alignment.alignment(frame, ONE, TWO).select("doc_id", *COLUMNS).collect(), wanted(rows)[0])
