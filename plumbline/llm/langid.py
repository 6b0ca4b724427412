"""Language identification by n-gram filters that answer with a bitmask of languages."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import MIX, batches, fold, scramble

GRAMS_PER_LANGUAGE = 6_000
SIZES = (2, 3, 4)
SLOTS = 1 << 18
PROBES = 2
CHUNK = 1 << 20
UNKNOWN = "und"
SHARE_STEPS = 1_000_000  # shares are counted in so many bins


def letter_table() -> np.ndarray:
    """For each code point: its lower-case letter, or 32 for what is not a letter."""
    table = np.full(0x110000, 32, np.uint32)
    for plane in (range(0x30000), range(0xE0000, 0xE0200)):
        for code in plane:
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                table[code] = ord(low) if len(low) == 1 else code
    return table


TABLE: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points of ``text`` with letters lower-cased, runs of all else as one space, a space at either end."""
    if not TABLE:
        TABLE.append(letter_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mapped = TABLE[0][codes]
    padded = np.concatenate([[np.uint32(32)], mapped, [np.uint32(32)]])
    gap = padded == 32
    keep = np.ones(len(padded), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return padded[keep]


def grams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams of SIZES, none of which has a space inside."""
    out = []
    wide = codes.astype(np.uint64) * MIX[0]
    gap = codes == 32
    for size in SIZES:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        h = np.full(n, size, np.uint64)
        inner = np.zeros(n, bool)
        for i in range(size):
            h = scramble(h + wide[i : i + n])
            if 0 < i < size - 1:
                inner |= gap[i : i + n]
        if size == 2:
            inner = gap[:n] & gap[1 : 1 + n]
        out.append(h[~inner])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def chunks(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a whole text, in parts of bounded size."""
    for begin in range(0, len(text), CHUNK):
        h = grams(letters(text[max(0, begin - max(SIZES)) : begin + CHUNK]))
        if len(h):
            yield h


def slots_of(h: np.ndarray, probe: int, slots: int) -> np.ndarray:
    return (scramble(h + MIX[probe]) & np.uint64(slots - 1)).astype(np.int64)


@dataclass(frozen=True)
class LanguageFilters:
    """``rows[probe, slot]`` is a bit row over ``languages``: bit l is set if language l put an n-gram there.

    The ``and`` of an n-gram's slots is the set of languages that hold it, wrongly a language l
    with probability ``false_rate[l]``: the share of set slots to the power of the probes.
    """

    languages: tuple[str, ...]
    rows: np.ndarray
    false_rate: np.ndarray

    def holders(self, h: np.ndarray) -> np.ndarray:
        """A 0/1 row over the languages for each n-gram."""
        mask = self.rows[0][slots_of(h, 0, self.rows.shape[1])]
        for probe in range(1, len(self.rows)):
            mask = mask & self.rows[probe][slots_of(h, probe, self.rows.shape[1])]
        return np.unpackbits(mask, axis=1, count=len(self.languages), bitorder="little")

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """How many n-gram places of the whole text each language holds, and how many there are."""
        total, n = np.zeros(len(self.languages)), 0
        for h in chunks(text):
            total += self.holders(h).sum(axis=0, dtype=np.int64)
            n += len(h)
        return total, n

    def corrected(self, total: np.ndarray, n: int) -> np.ndarray:
        """Each language's share of ``n`` places after taking off false positives."""
        return np.clip((total / max(1, n) - self.false_rate) / (1 - self.false_rate), 0, None)

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """The language with the largest corrected share of places, its score and that share.

        Score: the winner's share over the sum of all languages' shares.  Ties go to the first language by
        code point.  A text without a letter is ``und``; one without any n-gram that a language holds goes to the first
        language by code point with score 0.
        """
        if not text or not self.languages or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, 0.0
        share = self.corrected(*self.counts(text))
        best = int(np.argmax(share))
        if not share[best]:
            return self.languages[best], 0.0, 0.0
        return self.languages[best], float(share[best] / share.sum()), float(share[best])

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def gram_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, gram, n) combined per batch."""
    for frame in batches(frames, 500, 2_000_000):
        for lang, group in frame.groupby("lang"):
            found = [grams(letters(x[i : i + CHUNK])) for x in group["text"] for i in range(0, len(x), CHUNK)]
            gram, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), [])
            yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": np.asarray(n, np.int64)})


def labelled(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and text is not null").select("lang", "text")


def top_grams(docs: DataFrame, top: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Each language's ``top`` n-grams and their shares, counted over the whole texts of all labelled rows."""
    counts = labelled(docs).mapInPandas(gram_counts, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = {}
    languages = sorted(r["lang"] for r in labelled(docs).select("lang").distinct().collect())
    counts = counts.where("n > 1").persist()
    for lang in languages:  # a heap per task, then ``top`` rows: bounded by the parameter
        rows = counts.where(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(top).select("gram", "n").toPandas()
        kept[lang] = (rows["gram"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(float) / max(1, rows["n"].sum()))
    counts.unpersist()
    return kept


def filled(grams_of: dict[str, np.ndarray], slots: int) -> LanguageFilters:
    bits = np.zeros((PROBES, slots, len(grams_of)), np.uint8)
    for i, gram in enumerate(grams_of.values()):
        for probe in range(PROBES):
            bits[probe, slots_of(gram, probe, slots), i] = 1
    fill = bits.mean(axis=1)
    return LanguageFilters(tuple(grams_of), np.packbits(bits, axis=2, bitorder="little"), np.prod(fill, axis=0))


def two_largest(kept: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[float, float]]:
    """The largest and the second largest share of each n-gram over the languages."""
    largest: dict[int, tuple[float, float]] = {}
    for gram, share in kept.values():
        for g, x in zip(gram.tolist(), share.tolist(), strict=True):
            first, second = largest.get(g, (0.0, 0.0))
            largest[g] = (x, first) if x > first else (first, max(second, x))
    return largest


def strong_filters(kept: dict[str, tuple[np.ndarray, np.ndarray]], slots: int) -> LanguageFilters:
    """An n-gram counts for every language in whose top it is and that has at least a fifth of the largest share
    of it, so stray foreign words in a training text do not blur the filters.
    """
    largest = two_largest(kept)
    return filled({lang: gram[share * 5 >= np.array([largest[g][0] for g in gram.tolist()])] for lang, (gram, share) in kept.items()}, slots)


def fit_filters(docs: DataFrame, top: int = GRAMS_PER_LANGUAGE, slots: int = SLOTS) -> LanguageFilters:
    """Filters over each language's ``top`` n-grams, from all labelled rows."""
    return strong_filters(top_grams(docs, top), slots)


@dataclass(frozen=True)
class LeftOut:
    """What the filters would say of a language's texts had they not learned it.

    ``owner`` holds an n-gram for the language with the largest share of it, ``extra`` for those that are strong in
    it only when that language is left out.
    """

    filters: LanguageFilters
    owner: LanguageFilters
    extra: LanguageFilters

    def shares(self, text: str, lang: str) -> tuple[float, float, float]:
        """Corrected shares: of the language, the largest of the others with it left out, and the largest of all
        over the text's own letters in random order.
        """
        f, at = self.filters, self.filters.languages.index(lang)
        total, other, n = np.zeros(len(f.languages)), np.zeros(len(f.languages)), 0
        mixed, n_mixed = np.zeros(len(f.languages)), 0
        rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
        for h in chunks(text):
            held = f.holders(h)
            total += held.sum(axis=0, dtype=np.int64)
            other += (held | (self.extra.holders(h) & self.owner.holders(h)[:, at : at + 1])).sum(axis=0, dtype=np.int64)
            n += len(h)
        for begin in range(0, len(text), CHUNK):
            h = grams(rng.permutation(letters(text[begin : begin + CHUNK])))
            mixed += f.holders(h).sum(axis=0, dtype=np.int64)
            n_mixed += len(h)
        other[at] = 0
        return float(f.corrected(total, n)[at]), float(f.corrected(other, n).max()), float(f.corrected(mixed, n_mixed).max())


def left_out(kept: dict[str, tuple[np.ndarray, np.ndarray]], slots: int) -> LeftOut:
    largest = two_largest(kept)
    owner, extra = {}, {}
    for lang, (gram, share) in kept.items():
        first, second = np.array([largest[g] for g in gram.tolist()]).reshape(-1, 2).T
        owner[lang] = gram[share == first]
        extra[lang] = gram[(share * 5 < first) & (share * 5 >= second)]
    return LeftOut(strong_filters(kept, slots), filled(owner, slots), filled(extra, slots))


def share_bounds(docs: DataFrame, model: LeftOut) -> dict[str, float]:
    """The least corrected share a text of each language must have, from all labelled rows.

    Stray n-grams are what texts of a learned language give when it is left out, and what their letters give in
    random order.  The bound lies a quarter of the way from the 99th percentile of strays to the first percentile of
    the language's own texts, but not above the share of all but a thousandth of these, and not below the median of strays.  Shares are
    counted in bins of a millionth, by their lower ends, so what is held for a language does not grow with its rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, 500, 2_000_000):
            frame = frame[[any(c.isalpha() for c in x) for x in frame["text"]]]
            found = [shared.value.shares(x, lang) for x, lang in zip(frame["text"], frame["lang"], strict=True)]
            own, other, mixed = np.array(found).reshape(-1, 3).T
            yield pd.DataFrame({"lang": frame["lang"].to_numpy(), "own": own, "other": other, "mixed": mixed})

    rows = labelled(docs).mapInPandas(measure, "lang string, own double, other double, mixed double")
    kinds = [F.struct(F.lit(c).alias("kind"), F.floor(F.col(c) * SHARE_STEPS).alias("bin")) for c in ("own", "other", "mixed")]
    bins = rows.select("lang", F.explode(F.array(*kinds)).alias("x")).groupBy("lang", "x.kind", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.persist()
    at = F.expr("percentile(bin, array(0.001, 0.01, 0.5, 0.99), n)").alias("at")
    found = {(r["lang"], r["kind"]): np.array(r["at"]) / SHARE_STEPS for r in bins.groupBy("lang", "kind").agg(at).collect()}
    if not found:
        bins.unpersist()
        return {}
    languages = sorted({lang for lang, _ in found})
    cut = F.create_map(*[F.lit(x) for lang in languages for x in (lang, float(found[lang, "own"][0] * SHARE_STEPS))])
    # Of the two shares between which the thousandth lies, the lower.
    low = bins.where((F.col("kind") == "own") & (F.col("bin") <= cut[F.col("lang")] + 1e-6)).groupBy("lang").agg(F.max("bin").alias("bin"))
    least = {r["lang"]: r["bin"] / SHARE_STEPS for r in low.collect()}
    bins.unpersist()
    stray = [max(np.mean([found[lang, kind][i] for lang in languages]) for kind in ("other", "mixed")) for i in (2, 3)]
    own = {lang: found[lang, "own"][1] for lang in languages}
    return {lang: float(max(stray[0], min(stray[1] + (own[lang] - stray[1]) / 4, least[lang]))) for lang in languages}


def predictor(filters: LanguageFilters):
    spark_value = {}

    def predict(texts: pd.Series) -> pd.DataFrame:
        model = spark_value.setdefault("model", filters.value if hasattr(filters, "value") else filters)
        return pd.DataFrame([model.judge(x) for x in texts], columns=["lang_pred", "score", "share"])

    return predict


def language_of(spark, filters: LanguageFilters, text: Column) -> Column:
    """struct<lang_pred, score, share> from a whole text alone.

    Null texts and texts without a letter give ``und`` and 0, texts without a known n-gram the first language and 0.  The filters' size is fixed by their
    parameters (slots times languages bits), so they are broadcast.
    """
    shared = spark.sparkContext.broadcast(filters)
    return F.pandas_udf(predictor(shared), "lang_pred string, score double, share double")(text)


def training_rows(docs: DataFrame, folds: int, held: int) -> DataFrame:
    return docs.where(fold(F.col("doc_id"), folds) != held)


def identified(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row; learns from text and lang of rows outside the held-out fold.

    Rows with null lang or null text teach nothing; with nothing to learn from, every prediction is ``und``.  Null ids
    and repeated rows keep their rows.  Other columns are ignored.
    """
    filters = fit_filters(training_rows(docs, folds, held))
    found = language_of(docs.sparkSession, filters, F.col("text")).alias("found")
    rows = docs.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), found)
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")


def known_language(docs: DataFrame, folds: int = 4, held: int = 2, top: int = GRAMS_PER_LANGUAGE, slots: int = SLOTS) -> DataFrame:
    """``docs`` without those whose text is of no learned language; all columns stay.

    A text goes if its best language's corrected share of n-gram places is zero or lies under ``share_bounds``.  Null
    and letterless texts go, empty tables stay empty, and each of repeated rows is judged by itself.
    """
    training = training_rows(docs, folds, held)
    model = left_out(top_grams(training, top), slots)
    bounds = share_bounds(training, model)
    least = F.lit(None).cast("double")
    for lang, bound in bounds.items():
        least = F.when(F.col("found.lang_pred") == lang, float(bound)).otherwise(least)
    whole = docs.select(F.struct("*").alias("doc"))
    rows = whole.select("doc", language_of(docs.sparkSession, model.filters, F.col("doc.text")).alias("found"))
    return rows.where((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.share") > 0) & (F.col("found.share") >= least)).select("doc.*")
