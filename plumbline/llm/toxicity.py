"""Toxicity by a subsequence-kernel support vector machine on Nystroem landmarks.

The kernel counts common letter subsequences and discounts gaps, so an insult with letters inserted,
dropped or spaced out stays near to the plain one.  Landmarks are words of labelled texts that go with the
label.  A text's value for a landmark is the best match of any of its words, taken with and without cuts at punctuation; a
word too long to be weighed whole is weighed by all its windows.  The Nystroem map whitens these values by the landmarks' own kernel, and a linear machine is trained on the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import MIX, batches, hinted, scramble
from plumbline.session import materialize

LABELLED_SAMPLE = 12_000
LANDMARKS = 64
CANDIDATES = 400
LEAST_SEEN = 2
NEAR = 0.9
DECAY = 0.6
LONGEST = 24
SHORTEST = 3
FLOOR = 0.45
COST = 1.0
RIDGE = 1e-3
CACHED_WORDS = 600_000
BATCH_CHARS = 2_000_000
PAIRS = 4_000
BLOCKS = 4_000
WINDOWS = 100_000
CACHED_CHARS = 12_000_000
PARTS = (6, 12)

SPACED = re.compile(r"(?<!\w)(?:\w[^\w\n]{1,2}){3,}\w(?!\w)")
NOT_LETTER = re.compile(r"[\W_]+")


def plain(token: str) -> str:
    """A token without its punctuation."""
    return token if token.isalnum() else NOT_LETTER.sub("", token)


def tokens_of(text: str | None) -> list[str]:
    """Lower-cased runs between white space, and letters spaced out over a line as one more run each."""
    if not text:
        return []
    low = text.lower()
    return low.split() + ["".join(re.findall(r"\w", m)) for m in SPACED.findall(low)]


def runs_of(token: str) -> list[str]:
    """A token without its punctuation, and its parts between punctuation; none is shorter than SHORTEST."""
    parts = [token] if token.isalnum() else [plain(token), *NOT_LETTER.split(token)]
    return [w for w in dict.fromkeys(parts) if len(w) >= SHORTEST]


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points padded with 0, lengths) of words of at most LONGEST letters."""
    array = np.array([w[:LONGEST] for w in words], dtype=f"U{LONGEST}")
    return array.view(np.uint32).reshape(len(words), LONGEST).astype(np.int64), np.array([min(len(w), LONGEST) for w in words])


def subsequence_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernel of rows of ``a`` with rows of ``b``: common subsequences of two and three letters, each weighing
    DECAY to the power of the letters it spans in both words.
    """
    n, rows, cols = len(a), a.shape[1], b.shape[1]
    square = DECAY * DECAY
    total = np.zeros(n)
    left, right = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    same = [[(left[i] == right[j]) & (left[i] > 0) for j in range(cols)] for i in range(rows)]
    # inner[i][j]: weight of matches so far whose last letters lie before i and j, discounted up to there
    inner = [[np.ones(n)] * (cols + 1)] * (rows + 1)
    nothing = np.zeros(n)
    for length in (1, 2, 3):
        fresh = [[nothing] * (cols + 1)]
        for i in range(rows):
            run, row = nothing, [nothing]
            for j in range(cols):
                step = square * same[i][j] * inner[i][j]
                if length > 1:
                    total += step
                run = DECAY * run + step
                row.append(DECAY * fresh[i][j + 1] + run)
            fresh.append(row)
        inner = fresh
    return total


def own_kernel(codes: np.ndarray) -> np.ndarray:
    return paired_kernel(codes, codes)


def paired_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``subsequence_kernel`` in parts of bounded size, words of like length together so that little is padding."""
    out = np.zeros(len(a))
    order = np.lexsort(((a > 0).sum(1), (b > 0).sum(1)))
    for k in range(0, len(order), PAIRS):
        part = order[k : k + PAIRS]
        x, y = a[part], b[part]
        out[part] = subsequence_kernel(x[:, : max(1, (x > 0).sum(1).max())], y[:, : max(1, (y > 0).sum(1).max())])
    return out


def least_own(lengths: np.ndarray) -> np.ndarray:
    """The kernel with itself of a word of so many different letters: no word of that length has less."""
    square = DECAY * DECAY
    table = np.zeros(LONGEST + 1)
    for n in range(LONGEST + 1):
        pairs = sum((n - gap) * square ** (gap + 1) for gap in range(1, n))
        triples = sum((n - span + 1) * (span - 2) * square**span for span in range(3, n + 1))
        table[n] = pairs + triples
    return table[lengths]


def pair_masks(codes: np.ndarray, reach: int) -> np.ndarray:
    """256 bits a word: one for each ordered pair of letters at most ``reach`` apart."""
    out = np.zeros((len(codes), 4), np.uint64)
    row = np.arange(len(codes))
    for gap in range(1, reach + 1):
        for i in range(codes.shape[1] - gap):
            x, y = codes[:, i], codes[:, i + gap]
            bit = scramble(x.astype(np.uint64) * MIX[0] + y.astype(np.uint64)) >> np.uint64(56)
            value = np.where((x > 0) & (y > 0), np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
            out[row, (bit >> np.uint64(6)).astype(np.int64)] |= value
    return out


class Landmarks:
    """Similarity of words to landmark words: the normalized kernel, 0 below FLOOR."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes, self.lengths = coded(words)
        self.codes = self.codes[:, : max(1, int(self.lengths.max(initial=1)))]
        self.own = own_kernel(self.codes)
        self.masks = pair_masks(self.codes, 1)
        self.held = np.bitwise_count(self.masks).sum(1)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, similarity) of pairs above FLOOR.

        Pairs that share under three fifths of the landmark's neighbouring letters, even with two letters in between,
        are not weighed.
        """
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not words or not self.words:
            return empty
        codes, lengths = coded(words)
        codes = codes[:, : max(1, int(lengths.max()))]
        masks = pair_masks(codes, 3)
        found = []
        for j in range(len(self.words)):
            shared = np.bitwise_count(masks & self.masks[j]).sum(1)
            i = np.flatnonzero((5 * shared >= 3 * self.held[j]) & (lengths <= 3 * self.lengths[j]) & (2 * lengths >= self.lengths[j]))
            found.append(np.stack([i, np.full(len(i), j)]))
        i, j = np.concatenate(found, 1)
        if not len(i):
            return empty
        cross = paired_kernel(codes[i], self.codes[j])
        able = cross >= FLOOR * np.sqrt(least_own(lengths[i]) * self.own[j]) * (1 - 1e-9)
        i, j, cross = i[able], j[able], cross[able]
        used = np.unique(i)
        own = np.zeros(len(words))
        own[used] = own_kernel(codes[used])
        alike = cross / np.sqrt(np.maximum(own[i] * self.own[j], 1e-300))
        keep = alike >= FLOOR
        return i[keep], j[keep], alike[keep]


    def inside(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, similarity) of pairs where the word is too long to be weighed whole: the best of all its
        windows of one, two and three times the landmark's length that is above FLOOR.
        """
        parts = [np.zeros((3, 0))]
        long = [k for k, w in enumerate(words) if len(w) > min(LONGEST, 3 * int(self.lengths.min(initial=LONGEST)))]
        # Each window of at most LONGEST letters lies whole in a block of twice that.
        place = [(k, at) for k in long for at in range(0, max(1, len(words[k]) - LONGEST), LONGEST)]
        for begin in range(0, len(place), BLOCKS):
            parts.append(self.in_blocks(words, place[begin : begin + BLOCKS]))
        word, landmark, alike = np.concatenate(parts, 1)
        return word.astype(np.int64), landmark.astype(np.int64), alike

    def in_blocks(self, words: list[str], place: list[tuple[int, int]]) -> np.ndarray:
        width = 2 * LONGEST
        codes = np.array([words[k][at : at + width] for k, at in place], dtype=f"U{width}").view(np.uint32).reshape(len(place), width).astype(np.int64)
        word, size = np.array([k for k, _ in place]), np.array([len(words[k]) for k, _ in place])
        codes = codes[:, : int((codes > 0).sum(1).max())]
        masks = pair_masks(codes, 3)
        out, window, owner, mark = [], [], [], []
        held = 0
        for j, length in enumerate(self.lengths.tolist()):
            able = (5 * np.bitwise_count(masks & self.masks[j]).sum(1) >= 3 * self.held[j]) & (size > min(LONGEST, 3 * length))
            block = np.flatnonzero(able)
            for wide in sorted({min(LONGEST, times * length) for times in (1, 2, 3)}):
                if not len(block) or wide > codes.shape[1]:
                    continue
                view = np.lib.stride_tricks.sliding_window_view(codes[block], wide, axis=1)
                of, at = np.nonzero(view[:, :, -1] > 0)
                found = view[of, at]
                near = np.flatnonzero(5 * np.bitwise_count(pair_masks(found, 3) & self.masks[j]).sum(1) >= 3 * self.held[j])
                window.append(np.pad(found[near], ((0, 0), (0, LONGEST - wide))))
                owner.append(word[block[of[near]]])
                mark.append(np.full(len(near), j))
                held += len(near)
            if window and (held > WINDOWS or j == len(self.words) - 1):
                out.append(self.best(np.concatenate(window), np.concatenate(owner), np.concatenate(mark)))
                window, owner, mark, held = [], [], [], 0
        return np.concatenate([np.zeros((3, 0)), *out], 1)

    def best(self, codes: np.ndarray, owner: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The largest similarity of each (owner, landmark) that is above FLOOR."""
        cross = paired_kernel(codes, self.codes[mark])
        able = np.flatnonzero(cross >= FLOOR * np.sqrt(least_own((codes > 0).sum(1)) * self.own[mark]) * (1 - 1e-9))
        codes, owner, mark, cross = codes[able], owner[able], mark[able], cross[able]
        alike = cross / np.sqrt(np.maximum(own_kernel(codes) * self.own[mark], 1e-300))
        order = np.lexsort((-alike, mark, owner))
        order = order[alike[order] >= FLOOR]
        first = np.ones(len(order), bool)
        first[1:] = (owner[order][1:] != owner[order][:-1]) | (mark[order][1:] != mark[order][:-1])
        order = order[first]
        return np.stack([owner[order], mark[order], alike[order]])


class Matcher:
    """Values of texts for landmarks; words seen before come from a bounded cache."""

    def __init__(self, words: list[str]):
        self.landmarks = Landmarks(words)
        self.near: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.far: set[str] = set()
        self.chars = 0

    def values(self, texts) -> np.ndarray:
        cut = [tokens_of(x) for x in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        out = np.zeros((len(cut), len(self.landmarks.words)))
        if not sizes.sum():
            return out
        place, distinct = pd.factorize(np.array([t for tokens in cut for t in tokens], dtype=object))
        row = np.repeat(np.arange(len(cut)), sizes)
        unknown = [t for t in distinct.tolist() if t not in self.far and t not in self.near]
        runs = [(k, w) for k, t in enumerate(unknown) for w in runs_of(t)]
        words = [w for _, w in runs]
        short = [k for k, w in enumerate(words) if len(w) <= LONGEST]
        i, j, alike = self.landmarks.near([words[k] for k in short])
        fresh: dict[str, dict[int, float]] = {}
        for at, landmarks, values in ([short[k] for k in i.tolist()], j, alike), self.landmarks.inside(words):
            for k, landmark, value in zip(list(at), landmarks.tolist(), values.tolist(), strict=True):
                best = fresh.setdefault(unknown[runs[k][0]], {})
                best[landmark] = max(best.get(landmark, 0.0), value)
        if len(self.far) > CACHED_WORDS or self.chars > CACHED_CHARS:
            self.far.clear()
            self.chars = 0
            if self.near:
                self.near.clear()
                return self.values(texts)
        if len(self.near) > CACHED_WORDS // 4:
            self.near.clear()
            return self.values(texts)
        self.chars += sum(map(len, unknown))
        self.far.update(t for t in unknown if t not in fresh)
        self.near.update({t: (np.array(list(v)), np.array(list(v.values()))) for t, v in fresh.items()})
        hit = np.array([t in self.near for t in distinct.tolist()], bool)
        for at in np.flatnonzero(hit[place]):
            landmark, value = self.near[distinct[place[at]]]
            held = out[row[at]]
            held[landmark] = np.maximum(held[landmark], value)
        return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST, rounds: int = 50) -> np.ndarray:
    """Weights, the last one the offset, of a linear machine with squared hinge loss, by Newton's steps.  y is -1 or 1."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    keep = np.eye(z.shape[1])
    keep[-1, -1] = 1e-6
    loss = lambda w: 0.5 * w @ keep @ w + cost * (weight * np.maximum(0, 1 - y * (z @ w)) ** 2).sum()
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        active = y * (z @ w) < 1
        a = z[active]
        grad = keep @ w - 2 * cost * a.T @ (weight[active] * (y[active] - a @ w))
        hess = keep + 2 * cost * (a * weight[active, None]).T @ a
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset with P(1) = 1 / (1 + exp(-(slope * margin + offset))), the targets a little off 0 and 1."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    z = np.stack([margin, np.ones(len(margin))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - target) + 1e-6 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


@dataclass(frozen=True)
class ToxicityModel:
    """``words`` are the landmarks, ``whiten`` the Nystroem map, then a linear machine and its calibration."""

    words: tuple[str, ...]
    whiten: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def scores(self, values: np.ndarray) -> np.ndarray:
        margin = (values**2 @ self.whiten) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def sampled(labelled: DataFrame, most: int, *names: str) -> DataFrame:
    """About ``most`` rows at most, half for each label, drawn by the md5 of the columns ``names``."""
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in names])), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rate = F.lit(0.0)
    for label, n in sizes.items():
        rate = F.when(F.col("toxic") == label, min(1.0, most / 2 / n)).otherwise(rate)
    return labelled.where(draw < rate)


def landmark_parts(token: str) -> Iterator[str]:
    """What of a token may be a landmark: its runs, and for a run that is no word all its windows of PARTS letters."""
    for w in runs_of(token):
        if len(w) <= LONGEST:
            yield w
        else:
            yield from (w[i : i + size] for size in PARTS for i in range(len(w) - size + 1))


def distinct_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches(frames, 500, BATCH_CHARS):
        words = [{w for t in tokens_of(x) for w in landmark_parts(t)} for x in frame["text"]]
        out = pd.DataFrame({"word": words, "toxic": frame["toxic"].to_numpy()})
        out["word"] = out["word"].map(list)
        out = out.explode("word").dropna()
        yield out.groupby(["word", "toxic"]).size().rename("n").reset_index()


def landmark_words(sample: DataFrame, landmarks: int = LANDMARKS) -> list[str]:
    """Words that go with the label, by the likelihood-ratio statistic, none too near to one before it."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    up, down = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not up or not down:
        return []
    counts = sample.select("text", "toxic").mapInPandas(distinct_words, "word string, toxic int, n long").groupBy("word")
    counts = counts.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("u"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("d"))
    counts = counts.where((F.col("u") >= LEAST_SEEN) & (F.col("u") / up > F.col("d") / down))
    part = lambda n, of, share: n * F.log(F.greatest(n, F.lit(1e-9)) / (of * share))
    share = (F.col("u") + F.col("d")) / (up + down)
    u, d = F.col("u").cast("double"), F.col("d").cast("double")
    score = part(u, up, share) + part(d, down, share) + part(up - u, up, 1 - share) + part(down - d, down, 1 - share)
    best = [r["word"] for r in counts.orderBy(F.desc(score), "word").limit(CANDIDATES).collect()]
    chosen: list[str] = []
    for word in best:
        if len(chosen) == landmarks:
            break
        if not chosen or not len(far := Landmarks(chosen).near([word])[2]) or far.max() < NEAR:
            chosen.append(word)
    return chosen


def valued(words: list[str]):
    matchers: list[Matcher] = []

    def values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not matchers:
            matchers.append(Matcher(words))
        for frame in batches(frames, 500, BATCH_CHARS):
            yield pd.DataFrame({"toxic": frame["toxic"].to_numpy(), "x": list(matchers[0].values(frame["text"]))})

    return values


def fit_toxicity(labelled: DataFrame, most: int = LABELLED_SAMPLE) -> ToxicityModel | None:
    """Fit on at most about ``most`` rows (doc_id, text, toxic 0 or 1), half of each label; None without both labels."""
    sample = sampled(labelled, most, "doc_id", "text").persist()
    try:
        words = landmark_words(sample)
        if not words:
            return None
        rows = sample.select("text", "toxic").mapInPandas(valued(words), "toxic int, x array<double>").toPandas()
    finally:
        sample.unpersist()
    x = np.stack(rows["x"].to_numpy()) ** 2
    y = np.where(rows["toxic"].to_numpy() == 1, 1.0, -1.0)
    marks = Landmarks(words)
    kernel = np.zeros((len(words), len(words)))
    i, j, alike = marks.near(words)
    kernel[i, j] = alike**2
    kernel = (kernel + kernel.T) / 2
    value, vector = np.linalg.eigh(kernel)
    whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0) + RIDGE + 0.05)) @ vector.T
    z = x @ whiten
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    w = svm(z, y, weight)
    slope, offset = sigmoid_fit(z @ w[:-1] + w[-1], y)
    return ToxicityModel(tuple(words), whiten, w, slope, offset)


MATCHERS: dict[tuple[str, ...], Matcher] = {}


def scorer(shared):
    def score(texts: pd.Series) -> pd.Series:
        model: ToxicityModel = shared.value
        if model.words not in MATCHERS:
            MATCHERS.clear()
            MATCHERS[model.words] = Matcher(list(model.words))
        out = np.zeros(len(texts))
        frame, at = pd.DataFrame({"text": texts.to_numpy()}), 0
        for part in batches(iter([frame]), 500, BATCH_CHARS):
            out[at : at + len(part)] = model.scores(MATCHERS[model.words].values(part["text"]))
            at += len(part)
        return pd.Series(out)

    return score


def toxicity_score(spark, model: ToxicityModel | None, text: Column) -> Column:
    """Probability that a text is toxic, from the whole text; the model has a fixed size and is broadcast."""
    if model is None:
        return F.lit(0.0)
    udf = F.pandas_udf(scorer(spark.sparkContext.broadcast(model)), "double")
    return udf(text)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Learns from ``labels`` (doc_id, toxic) of rows outside the held-out fold, a bounded sample of them.  A doc_id labelled
    twice counts as toxic if one label says so; null ids and labels teach nothing.  Null and empty texts get the
    score of a text that matches nothing.  Without both labels all scores are 0.  Other columns are ignored.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    truth = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Ids are sampled before their texts are looked for, so texts need no shuffle.
    truth = materialize(truth.where(fold != held), "labelled")
    drawn = materialize(sampled(truth, LABELLED_SAMPLE, "doc_id"), "drawn")
    marked = docs.select("doc_id", "text").where((fold != held) & F.col("text").isNotNull()).join(hinted(drawn), "doc_id")
    model = fit_toxicity(marked)
    slim = docs.select("doc_id", (fold == held).alias("held_out"), "text")
    out = slim.select("doc_id", "held_out", toxicity_score(spark, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
