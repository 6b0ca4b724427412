import hashlib
import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from plumbline.functions import cells, ngrams, text
from plumbline.functions.patterns import any_phrase, any_regex, count_regex, unicode_regex
from plumbline.policy import DEFAULT_POLICY

TEXTS = [
    "plain words",
    "  tabs\tand\r\nlines \u00a0 no-break\u2003em ",
    "zero\u200bwidth\u2060joined\ufeff",
    "\uff11\uff12\uff13 full width \ufb01ne \u2460",
    "cafe\u0301 decomposed and café composed",
    "shop [dot] com (dot) org d0t net dot io",
    "It\u2019s curly, haven't been",
    "emoji \U0001f389\U0001f389 and ² ⅷ",
    "\x1cseparators\x1f\x85",
    "a b c",
    "ЖУК straße ΣΑΣ İstanbul",
    "",
    None,
]


def plain_norm(s, lower):
    """Written from the definition: compose, drop invisible, one space, trim, lower, dots."""
    s = unicodedata.normalize("NFKC", s or "")
    s = re.sub("[\u200b\u200c\u200d" + ("\u2060" if lower else "") + "\ufeff]", "", s)
    s = re.sub(r"\s+", " ", s).strip()
    if lower:
        s = s.lower().replace("[dot]", ".").replace("(dot)", ".")
        s = s.replace(" d0t ", ".").replace(" dot ", ".")
    return s


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def run(rows, column):
    return [r["x"] for r in rows.select("i", column.alias("x")).orderBy("i").collect()]


def test_normal_forms(rows):
    t = F.col("t")
    assert run(rows, text.norm_rules(t)) == [plain_norm(s, True) for s in TEXTS]
    assert run(rows, text.norm_clean(t)) == [plain_norm(s, False) for s in TEXTS]


def test_stable_characters_really_are():
    spans = re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", text.STABLE_CHARACTERS)
    for low, high in spans:
        for cp in range(int(low, 16), int(high or low, 16) + 1):
            for before in ("", "a", "가", "か", "א"):
                s = before + chr(cp)
                assert unicodedata.normalize("NFKC", s) == s, hex(cp)


def test_words_follow_unicode(rows):
    expected = [re.findall(r"\w\w+", (s or "").lower()) for s in TEXTS]
    assert [w or [] for w in run(rows, ngrams.words(F.col("t")))] == expected


def test_counts_follow_unicode(rows):
    for pattern in (r"\S+", r"\w+", r"\d", r"\b\S+\b"):
        found = run(rows, count_regex(text.blank(F.col("t")), unicode_regex(pattern)))
        assert found == [len(re.findall(pattern, s or "")) for s in TEXTS], pattern


def char_grams(s):
    out = []
    for word in s.lower().split():
        w = f" {word} "
        for n in (3, 4, 5):
            grams = [w[i : i + n] for i in range(max(len(w) - n, 0) + 1)]
            out += grams
            if len(grams) == 1:
                break
    return out


def test_char_ngrams(rows):
    found = run(rows, ngrams.char_ngrams(text.blank(F.col("t"))))
    # These use Java's lower case; the dotted capital I differs in length, so fold it first.
    assert [sorted(g) for g in found[:10]] == [sorted(char_grams(s)) for s in TEXTS[:10]]


@pytest.mark.parametrize(
    "review,hit",
    [
        ("50% off today", True),
        ("50 % off today", False),
        ("discounts everywhere", False),
        ("a DISCOUNT!", True),
        ("d\u0131scount", True),
        ("promo_code", False),
        ("call now", True),
        ("recall nowhere", False),
    ],
)
def test_keywords(spark, review, hit):
    df = spark.createDataFrame([(review.lower(),)], "t string")
    assert df.select(any_phrase(F.col("t"), DEFAULT_POLICY.keywords)).first()[0] is hit


@pytest.mark.parametrize(
    "review",
    ["+65 9123-4567", "on 2024-01-02 12", "12345678", "1234567", "é12345678", "x+6591234567", "(02) 9.9"],
)
def test_phone(spark, review):
    df = spark.createDataFrame([(review,)], "t string")
    expected = bool(re.search(DEFAULT_POLICY.phone_regex[0], review))
    assert df.select(any_regex(F.col("t"), DEFAULT_POLICY.phone_regex)).first()[0] is expected


def test_keys(spark):
    df = spark.createDataFrame([("u", "g", 5), ("", "", 0), ("é", "ß", 7)], "u string, g string, t long")
    got = [tuple(r) for r in df.select(
        cells.review_uuid(F.col("u"), F.col("g"), F.col("t")), cells.hash_business_id(F.col("u"))
    ).collect()]
    names = ["u_g_5", "u_g_t", "é_ß_7"]
    assert [g[0] for g in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert [g[1] for g in got] == [hashlib.md5(u.encode()).hexdigest()[:12] for u in ("u", "", "é")]


def test_cells(spark):
    values = ["4.7", "x", "", None, " 9 ", "-1", "true", "nan", "1e3"]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    stars = [r[0] for r in df.select(cells.coerce_stars(F.col("c"))).collect()]
    assert stars == [4, 0, 0, 0, 9, -1, 0, 0, 1000]
    labels = [r[0] for r in df.select(cells.coerce_label(F.col("c"))).collect()]
    assert labels == [1, 0, 0, 0, 1, 0, 1, 0, 1]
