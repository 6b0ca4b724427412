"""Phrase mining against plain counting; the query itself is held against its SQL."""

import collections
import re

import pytest

from plumbline.llm import collocations
from plumbline.llm.collocations import HatTrie, Node
from tests.llm.conftest import frame


def plain(rows, least, longest, top):
    count, totals = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    count[lang, tuple(words[i : i + size])] += 1
    frequent = {p: a for p, a in count.items() if a >= least and len(p[1]) > 1}
    rows = []
    for (lang, words), a in frequent.items():
        inside = any(
            f >= a and other == lang and len(longer) > len(words) and any(longer[i : i + len(words)] == words for i in range(len(longer)))
            for (other, longer), f in frequent.items()
        )
        if not inside:
            cuts = [(1000 * a * totals[lang] // (count[lang, words[:k]] * count[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            rows.append((lang, " ".join(words), a, count[lang, words[:k]], count[lang, words[k:]], totals[lang], score))
    rows.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = collections.Counter()
    out = []
    for row in rows:
        ranks[row[0]] += 1
        if ranks[row[0]] <= top:
            out.append((row[0], ranks[row[0]], *row[1:]))
    return out


ODD = [
    (1, "The cat, the CAT sat on the mat. the cat sat; on the mat\x0bthe cat", "en", "a"),
    (2, None, None, None),
    (3, "", "en", None),
    (4, "a a a a a a\ta a", None, "x"),
    (5, "a a a a b", "und", "x"),
    (6, "Größe und Maß und GRÖSSE ÄÖ \U0001F600 zählt . \U0001F600 zählt", "de", None),
    (7, " ,.;:!? \n", "en", None),
    (8, "x\x00y \x1c z x\x00y \x1c z", "en", None),
    (9, "the cat sat on the mat " * 400, "en", None),
    (9, "the cat sat on the mat " * 400, "en", None),
    (10, "odd names of languages, odd names", "x\n\x0b y", None),
]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("least,top", [(2, 2000), (3, 5)])
def test_against_plain_counting(spark, monkeypatch, least, top, small):
    if small:  # burst, spill and start over all the time
        for name, value in (("BURST", 2), ("TRIE_ENTRIES", 6), ("TASK_WORDS", 9), ("RUN_ROWS", 3), ("BATCH_CHARS", 30), ("BITS_PER_PHRASE", 1), ("CELL_BLOCK", 8), ("CHARS_PER_CELL", 1000), ("LEAST_PARTS", 3)):
            monkeypatch.setattr(collocations, name, value)
    found = collocations.collocations(frame(spark, ODD), least, 5, top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == sorted(plain(ODD, least, 5, top))


def test_empty(spark, odd, empty):
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(odd, least=10**6).collect() == []


def test_large_products(spark):
    """Products beyond 64 bits are exact: 1000 * a * n and l * r near 10**25."""
    a, l, r, n = 3_000_000_019, 3_100_000_003, 3_000_000_037, 9_999_999_999_971
    frequent = spark.createDataFrame([("en", "u v", 2, a), ("en", "u", 1, l), ("en", "v", 1, r)], "lang string, phrase string, size int, a long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    assert collocations.scored(frequent, totals).first()["score"] == 1000 * a * n // (l * r)


def test_trie_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 3)
    trie, truth = HatTrie(2), collections.Counter()
    for i in range(400):
        key = bytes(4 * [i % 3]) + bytes(4 * [i % 7]) + bytes(4 * [i % 11])
        trie.add([key], [i])
        truth[key] += i
    assert type(trie.root) is Node and any(type(t) is Node for t in trie.root.values())
    assert trie.entries == len(truth)
    first = [dict(zip(*tree, strict=True)) for tree in trie.spill(len(truth) // 2)]
    assert trie.entries <= len(truth) // 2
    rest = [dict(zip(*tree, strict=True)) for tree in trie.spill(0)]
    merged = collections.Counter()
    for tree in first + rest:
        assert len({key[:4] for key in tree}) == 1  # a whole subtree
        merged.update(tree)
    assert merged == truth and trie.entries == 0
