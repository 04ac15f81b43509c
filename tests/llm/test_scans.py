"""Labels of fuzzy notices against edit distances of all word spans, and ownership of secrets."""

import random

import pytest

from kinspark.llm import bpe, license_scan, secret_scan
from kinspark.llm.license_scan import NOTICES, Scanner


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def labels_by_brute_force(text):
    """Of each notice the fewest edits over all spans of whole words, if they are few enough. Where the notice ends in a version, no other
    number may stand there."""
    words, found = text.split(), {}
    for notice, label, errors in NOTICES:
        version = notice.rpartition(" ")[2]
        for first in range(len(words)):
            for last in range(first + 1, min(len(words), first + len(notice.split()) + errors) + 1):
                span = " ".join(words[first:last])
                other = version.isdigit() and words[last - 1] != version and (words[last - 1].isdigit() or (words + [""])[last].isdigit())
                if abs(len(span) - len(notice)) <= errors and not other and (edits := distance(span, notice)) <= errors:
                    found[notice] = min(found.get(notice, 99), edits)
    return {label for notice, label, _ in NOTICES if notice in found}, max((1 - e / len(n) for n, e in found.items()), default=0.0)


def damaged(notice, rng):
    letters = list(notice)
    for _ in range(rng.randrange(5)):
        at = rng.randrange(len(letters))
        kind = rng.randrange(3)
        if kind == 0:
            letters[at] = rng.choice("abcdexyz 123")
        elif kind == 1:
            letters.insert(at, rng.choice("abcdexyz "))
        elif len(letters) > 1:
            del letters[at]
    return "".join(letters)


@pytest.mark.parametrize("seed", range(6))
def test_fuzzy_labels_by_brute_force(seed):
    rng, scanner = random.Random(seed), Scanner()
    words = "small the license version 1 2 3 reserved rights apache public x under general gnu by nc".split()
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += rng.choices(words, k=rng.randrange(6))
            parts.append(damaged(rng.choice(NOTICES)[0], rng))
        text = " ".join(" ".join(parts).split())
        hits = [h for h in scanner.scan(text).hits if not h.exact]
        labels, best = labels_by_brute_force(text)
        assert {h.label for h in hits} == labels, text
        assert max((h.likeness for h in hits), default=0.0) == pytest.approx(best), text


@pytest.mark.parametrize("text", ["small rights reserved", "apache license version 1", "apache license version 20", "mozilla public license version 1"])
def test_words_cut_and_other_versions_are_no_notices(text):
    assert not Scanner().scan(text).hits


def test_the_rest_of_a_word_counts_as_edits():
    (hit,) = Scanner().scan("under the mit licensee").hits
    assert (hit.label, hit.edits, hit.first, hit.last) == ("mit", 1, 0, 3)


def test_scan_of_awkward_rows(spark):
    long = "x " * 600_000 + "under the mit license"
    rows = [(1, None, "a"), (2, "", "a"), (3, "...", "a"), (4, long, "a"), (4, long, "a"), (None, "cc by nc", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    found = sorted(license_scan.license_scan(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.n_words, r.n_base, r.first_word, r.labels) for r in found] == [
        (0, 0, None, ""), (0, 0, None, ""), (0, 0, None, ""), (600_004, 1, 600_000, "mit"), (600_004, 1, 600_000, "mit"), (3, 1, 0, "cc-by-nc"),
    ]
    assert not license_scan.license_scan(docs.limit(0)).count()


def test_ownership_by_repositories(spark):
    example, own = "token=examplevalue1", "secret: ownvalue22"
    rows = [(k, f"{example} x" if k < 60 else f"{own} {example}", f"r{k % 7}", f"o{k % 5}" if k < 60 else "me") for k in range(63)]
    docs = spark.createDataFrame([*rows, (99, None, None, None)], "doc_id long, text string, repo string, owner string")
    found = {r.doc_id: r for r in secret_scan.secret_scan(docs).collect()}
    assert all((found[k].n_example, found[k].n_live, found[k].live_repos) == (1, 0, 0) for k in range(60))
    assert all((found[k].n_example, found[k].n_live, found[k].live_repos) == (1, 1, 3) for k in range(60, 63))
    assert (found[99].n_assign, found[99].live, found[99].live_repos) == (0, [], 0) and len(found) == 64


def test_equal_keys_have_no_perfect_hash():
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"", b""])
