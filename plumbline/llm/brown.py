"""Language-model scores from Brown word classes: class transitions times word emissions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import batches, hashes, lowered_words
from plumbline.session import materialize

SEEDS = 600
CLASSES = 40
ROUNDS = 2
CHUNK = 50_000
SWEEPS = 12
SHARED_WORDS = 200_000
FLUSH = 400_000
BATCH_CHARS = 3_000_000
STRENGTH = 50.0
END = int(hashes([b""]).view(np.int64)[0])  # no word is empty, so this is the hash of none


def signed(words: list[bytes]) -> np.ndarray:
    return hashes(words).view(np.int64)


def word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, n) of words and ends, combined over as many texts as a bounded table holds."""
    found: Counter[bytes] = Counter()
    for frame in batches(frames, 2_000, BATCH_CHARS):
        for text in frame["text"]:
            found.update(lowered_words(text))
        found[b""] += len(frame)
        if len(found) > FLUSH:
            yield pd.DataFrame({"word": signed(list(found)), "n": np.fromiter(found.values(), np.int64)})
            found.clear()
    if found:
        yield pd.DataFrame({"word": signed(list(found)), "n": np.fromiter(found.values(), np.int64)})


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) over the whole corpus: every word's hash and its count, the end of text among them."""
    counted = docs.select("text").mapInPandas(word_counts, "word long, n long")
    return materialize(counted.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")


def most_frequent(words: DataFrame, most: int) -> pd.DataFrame:
    """The words whose counts lie above a bound that at most ``most`` words pass, by falling count."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("long")
    rows = sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True)
    left, bound = most, None
    for row in rows:
        left -= row["count"]
        if left < 0:
            break
        bound = row["level"]
    if bound is None:
        return pd.DataFrame({"word": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    top = words.where(level >= bound).toPandas()
    return top.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


class Lexicon:
    """Word hash to its place in a bounded list, or the list's length."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words, kind="stable")
        self.sorted = words[self.order]

    def __call__(self, found: np.ndarray) -> np.ndarray:
        n = len(self.sorted)
        if not n:
            return np.zeros(len(found), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, found), n - 1)
        return np.where(self.sorted[at] == found, self.order[at], n)


def token_stream(texts, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code of each token, distinct hashes, place of each distinct hash, tokens per text), ends included."""
    cut = [lowered_words(x) for x in texts]
    sizes = np.fromiter((len(x) + 1 for x in cut), np.int64, len(cut))
    found = signed([w for words in cut for w in (*words, b"")])
    code, distinct = pd.factorize(found)
    return code, distinct, lexicon(distinct), sizes


def pair_counter(shared):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        lexicon, width = Lexicon(words), len(words) + 1
        end = int(lexicon(np.array([END]))[0])
        total = np.zeros(width * width, np.int64)
        for frame in batches(frames, 2_000, BATCH_CHARS):
            code, _, place, sizes = token_stream(frame["text"], lexicon)
            now = place[code]
            before = np.concatenate([[end], now[:-1]])  # a text starts after the end of another
            total += np.bincount(before * width + now, minlength=width * width)
        cell = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cell, "n": total[cell]})

    return count


def pair_counts(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """Counts of neighbours among the given words; all other words are the last row and column."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    width = len(words) + 1
    counted = docs.select("text").mapInPandas(pair_counter(shared), "cell long, n long")
    rows = counted.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(width * width, np.int64)
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(width, width)


def x_log_x(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange_classes(pairs: np.ndarray, fixed: list[int], classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each word: words move one at a time to where the class bigram likelihood is greatest.

    Words in ``fixed`` have the last classes to themselves.  Sweeps end when no word moves.
    """
    n = len(pairs)
    free = [w for w in range(n) if w not in set(fixed)]
    classes = max(1, min(classes, len(free)))
    of = np.zeros(n, np.int64)
    for i, w in enumerate(free):
        of[w] = i % classes
    for i, w in enumerate(fixed):
        of[w] = classes + i
    k = classes + len(fixed)
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    table = member.T @ pairs @ member
    size = member.T @ pairs.sum(1).astype(float)
    weight = pairs.sum(1).astype(float)
    for _ in range(sweeps):
        moved = 0
        for w in free:
            was, own = of[w], float(pairs[w, w])
            right = pairs[w] @ member
            left = pairs[:, w] @ member
            right[was] -= own
            left[was] -= own
            table[was] -= right
            table[:, was] -= left
            table[was, was] -= own
            size[was] -= weight[w]
            t = table[:classes]
            gain = (x_log_x(t + right) - x_log_x(t)).sum(1)
            u = table[:, :classes].T
            gain += (x_log_x(u + left) - x_log_x(u)).sum(1)
            i = np.arange(classes)
            d = table[i, i]
            gain -= x_log_x(d + right[:classes]) + x_log_x(d + left[:classes]) - 2 * x_log_x(d)
            gain += x_log_x(d + right[:classes] + left[:classes] + own) - x_log_x(d)
            gain -= 2 * (x_log_x(size[:classes] + weight[w]) - x_log_x(size[:classes]))
            best = int(np.argmax(gain))
            best = was if gain[was] >= gain[best] - 1e-9 else best
            moved += best != was
            table[best] += right
            table[:, best] += left
            table[best, best] += own
            size[best] += weight[w]
            member[w, was], member[w, best], of[w] = 0, 1, best
        if not moved:
            break
    return of


def class_number(types: int) -> int:
    """How many classes a vocabulary gets: the cube root of its size, CLASSES at least."""
    return max(CLASSES, round(types ** (1 / 3)))


def all_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches(frames, 2_000, BATCH_CHARS):
        code, distinct, _, _ = token_stream(frame["text"], Lexicon(np.zeros(0, np.int64)))
        before = np.concatenate([code[-1:], code[:-1]])  # a batch ends with an end
        pair, n = np.unique(before * np.int64(len(distinct)) + code, return_counts=True)
        a, b = np.divmod(pair, len(distinct))
        yield pd.DataFrame({"a": distinct[a], "b": distinct[b], "n": n.astype(np.int32)})


def neighbours(docs: DataFrame) -> DataFrame:
    """(a, b, n): how often each word, or end, follows each other one, over the whole corpus."""
    found = docs.select("text").mapInPandas(all_pairs, "a long, b long, n int")
    return materialize(found.groupBy("a", "b").agg(F.sum("n").alias("n")), "neighbours")


def classed(rows: DataFrame, column: str, classes: DataFrame, frequent: int) -> DataFrame:
    """``rows`` with the class ``c_`` and the mark ``once_`` of the word in ``column``.

    Words of at least ``frequent`` occurrences are broadcast (a bounded number), so no other key of the join is hot.
    """
    marks = classes.select(F.col("word").alias(column), F.col("cls").alias(f"c_{column}"), (F.col("count") == 1).alias(f"once_{column}"), "count")
    top = F.broadcast(marks.where(F.col("count") >= frequent).drop("count"))
    rest = marks.where(F.col("count") < frequent).drop("count")
    return rows.join(top, column).unionByName(rows.join(top, column, "left_anti").join(rest, column))


def class_table(pairs: DataFrame, classes: DataFrame, k: int, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of class after class, of words seen once after a class, and of classes after a word seen once."""
    both = classed(classed(pairs, "a", classes, frequent), "b", classes, frequent)
    rows = both.groupBy("c_a", "c_b", "once_a", "once_b").agg(F.sum("n").alias("n")).toPandas()
    table, to_once, from_once = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    n = rows["n"].to_numpy(float)
    np.add.at(table, (rows["c_a"].to_numpy(int), rows["c_b"].to_numpy(int)), n)
    np.add.at(to_once, rows["c_a"].to_numpy(int), n * rows["once_b"].to_numpy(bool))
    np.add.at(from_once, rows["c_b"].to_numpy(int), n * rows["once_a"].to_numpy(bool))
    return table, to_once, from_once


def smoothed(table: np.ndarray) -> np.ndarray:
    mass = table.sum(0) + 1.0
    return np.log10((table + STRENGTH * mass / mass.sum()) / (table.sum(1, keepdims=True) + STRENGTH))


def best_class(shared):
    """Each word's class where its neighbours' classes are likeliest by the broadcast table; the end stays."""

    def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, size, end_class = shared.value
        for frame in frames:
            lengths = frame["near"].map(len).to_numpy()
            ends = np.cumsum(lengths)
            out, begin = [], 0
            while begin < len(frame):
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
                key, n = np.concatenate(frame["near"].to_numpy()[begin:end]), np.concatenate(frame["n"].to_numpy()[begin:end])
                start = ends[begin:end] - lengths[begin:end] - before
                gain = np.add.reduceat(weights[key] * n[:, None], start)
                # each occurrence has a neighbour on either side, so half the neighbours are the word's count
                out.append((gain - np.add.reduceat(n, start)[:, None] / 2 * size).argmax(1))
                begin = end
            cls = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pd.DataFrame({"word": frame["word"], "cls": np.where(frame["word"] == END, end_class, cls)})

    return move


def exchanged(pairs: DataFrame, classes: DataFrame, table: np.ndarray, free: int, frequent: int) -> DataFrame:
    """All words moved at once to their best classes against ``table``."""
    k = len(table)
    likely = smoothed(table)
    weights = np.concatenate([likely[:, :free], likely[:free].T])  # what stands before, then what stands after
    size = np.log10(np.maximum(table.sum(0)[:free], 1.0))
    shared = classes.sparkSession.sparkContext.broadcast((weights, size, free))
    after = classed(pairs, "b", classes, frequent).select(F.col("a").alias("word"), (F.col("c_b") + k).alias("key"), "n")
    before = classed(pairs, "a", classes, frequent).select(F.col("b").alias("word"), F.col("c_a").alias("key"), "n")
    near = before.unionByName(after).groupBy("word", "key").agg(F.sum("n").alias("n"))
    lists = near.groupBy("word").agg(F.collect_list(F.struct("key", "n")).alias("x")).select("word", F.col("x.key").alias("near"), F.col("x.n").alias("n"))
    moved = lists.mapInPandas(best_class(shared), "word long, cls int")
    return materialize(moved.join(classes.select("word", "count"), "word"), "classes")


@dataclass(frozen=True)
class ClassModel:
    """Parts of the model that go to all tasks: the frequent words (a bounded number) with counts, classes and emissions,
    and the class transitions, whose last class is that of words never seen.
    """

    words: np.ndarray
    counts: np.ndarray
    of: np.ndarray
    emission: np.ndarray
    transition: np.ndarray
    unseen: float
    tokens: int
    types: int
    end_class: int

    @property
    def base_divisor(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)


def fit_classes(docs: DataFrame, words: DataFrame, rounds: int = ROUNDS) -> tuple[ClassModel, DataFrame]:
    """The model, and (word, count, cls, emission) of every word of ``docs`` (text), whose counts are ``words``.

    The most frequent words get their classes by one-at-a-time exchange; from there every word moves in parallel rounds.
    """
    spark = docs.sparkSession
    tokens, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    shared = most_frequent(words, SHARED_WORDS)
    frequent = int(shared["n"].min()) if len(shared) else 1 << 62
    seeds = np.array([END, *[w for w in shared["word"].tolist() if w != END][:SEEDS]])
    of = exchange_classes(pair_counts(docs, seeds), [0, len(seeds)], class_number(types))
    k, free = int(of.max()) + 1, int(of[0])
    seeded = F.broadcast(spark.createDataFrame(pd.DataFrame({"word": seeds, "cls": of[:-1].astype(np.int32)}), "word long, cls int"))
    classes = words.join(seeded, "word", "left").select("word", F.coalesce("cls", F.lit(k - 1)).alias("cls"), F.col("n").alias("count"))
    classes = materialize(classes, "classes")
    pairs = neighbours(docs)
    table, to_once, from_once = class_table(pairs, classes, k, frequent)
    for _ in range(rounds if tokens else 0):
        classes = exchanged(pairs, classes, table, free, frequent)
        table, to_once, from_once = class_table(pairs, classes, k, frequent)
    # Words seen once tell where words never seen stand.
    table[:, -1], table[-1] = to_once, from_once
    table[-1, -1] = from_once.sum() * to_once.sum() / max(1, tokens)
    sums = classes.groupBy("cls").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum((F.col("count") == 1).cast("long")).alias("once"))
    rows = sums.toPandas()
    divisor = np.full(k, 0.5)
    divisor[rows["cls"].to_numpy(int)] = rows["total"].to_numpy(float) + 0.5 * rows["kinds"].to_numpy(float)
    by_class = F.broadcast(spark.createDataFrame([(i, float(x)) for i, x in enumerate(divisor)], "cls int, divisor double"))
    classes = classes.join(by_class, "cls").select("word", "count", "cls", F.log10((F.col("count") + 0.5) / F.col("divisor")).alias("emission"))
    top = classes.where((F.col("count") >= frequent) | (F.col("word") == END)).toPandas()
    if not (top["word"] == END).any():
        top = pd.concat([top, pd.DataFrame({"word": [END], "count": [0], "cls": [free], "emission": [0.0]})], ignore_index=True)
    unseen = -float(np.log10(1 + rows["once"].sum()))
    model = ClassModel(
        top["word"].to_numpy(np.int64), top["count"].to_numpy(np.int64), top["cls"].to_numpy(np.int64), top["emission"].to_numpy(float),
        smoothed(table), unseen, int(tokens), int(types), free,
    )
    return model, classes


MARK = "struct<doc_id:long,held_out:boolean,n_tokens:long,n_known:long,base:double,score:double>"


def scorer(shared):
    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: ClassModel = shared.value
        lexicon, n = Lexicon(m.words), len(m.words)
        base = np.append(np.log10((m.counts + 0.5) / m.base_divisor), 0.0)
        emission, known = np.append(m.emission, 0.0), np.append(m.counts > 0, False)
        of = np.append(m.of, -1)
        for frame in batches(frames, 2_000, BATCH_CHARS):
            code, distinct, place, sizes = token_stream(frame["text"], lexicon)
            spot = place[code]
            row = np.repeat(np.arange(len(frame)), sizes)
            kind = of[spot]
            last = np.concatenate([code[-1:], code[:-1]])  # each text ends with an end, so the first word follows one
            before = of[place[last]]
            near = (kind >= 0) & (before >= 0)
            step = np.where(near, m.transition[before, kind], 0.0)
            total = lambda x: np.bincount(row, weights=x, minlength=len(frame))
            sums = {"base": total(base[spot]), "score": total(emission[spot] + step), "n_known": total(known[spot]).astype(np.int64)}
            marks = pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "held_out": frame["held_out"].to_numpy(), "n_tokens": sizes, **sums})
            marks["doc_id"] = frame["doc_id"].astype("Int64").to_numpy()
            columns = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
            own = frame["row"].to_numpy()
            yield pd.DataFrame({"row": own, "a": own, "b": own, "c_a": 0, "c_b": 0, "n": 0, "mark": marks[columns].astype(object).where(marks[columns].notna(), None).to_dict("records")})
            far = np.flatnonzero(~near)
            if len(far):
                width = np.int64(len(distinct))
                pair, times = np.unique((row[far] * width + last[far]) * width + code[far], return_counts=True)
                pair, b = np.divmod(pair, width)
                r, a = np.divmod(pair, width)
                c_a, c_b = of[place[a]], of[place[b]]
                # a frequent word's class is known here; the row number stands for it, so that no key of the joins is hot
                yield pd.DataFrame({"row": own[r], "a": np.where(c_a < 0, distinct[a], own[r]), "b": np.where(c_b < 0, distinct[b], own[r]), "c_a": c_a, "c_b": c_b, "n": times, "mark": None})

    return score


def class_scores(docs: DataFrame, held: int = 1, folds: int = 5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, unigram base score and class-model score in log10.

    Learns from all rows outside the held-out fold.  Tokens are words between ASCII white space, A-Z in lower
    case, and one end per text.  ``score`` is the sum of log10 P(class | class before) + log10 P(word | class);
    ``perplexity`` is 10 ** (-score / n_tokens).  Every word of the learned rows has a class.  The most
    frequent words (a bounded number) are broadcast; others are joined by word, a row per document and pair of neighbours, so
    no key is frequent there.

    A null text is empty and has its end alone.  Null ids and repeated rows keep their rows.  With nothing to
    learn from, all counts are 0 and every token is unknown.  Other columns are ignored.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    training = docs.where(fold != held).select("text")
    words = vocabulary(training)
    model, classes = fit_classes(training, words)
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (fold == held).alias("held_out"), "text")
    parts = source.mapInPandas(scorer(shared), f"row long, a long, b long, c_a int, c_b int, n long, mark {MARK}")
    k = len(model.transition)
    cells = [(i * k + j, float(model.transition[i, j])) for i in range(k) for j in range(k)]
    cells = F.broadcast(spark.createDataFrame(pd.DataFrame(cells, columns=["cell", "step"]), "cell long, step double"))
    left = classes.select(F.col("word").alias("a"), F.col("cls").alias("far_a"))
    right = classes.select(F.col("word").alias("b"), F.col("cls").alias("far_b"), "count", "emission")
    kind = lambda x: F.when(F.col(f"c_{x}") >= 0, F.col(f"c_{x}")).otherwise(F.coalesce(f"far_{x}", F.lit(k - 1)))
    met = parts.join(left, "a", "left").join(right, "b", "left").withColumn("cell", (kind("a") * k + kind("b")).cast("long")).join(cells, "cell")
    rare = F.col("c_b") < 0
    seen = F.when(rare, F.coalesce("count", F.lit(0)))
    sums = met.groupBy("row").agg(
        F.max("mark.doc_id").alias("doc_id"),
        F.max("mark.held_out").alias("held_out"),
        F.max("mark.n_tokens").alias("n_tokens"),
        F.count("mark").alias("copies"),
        F.coalesce(F.sum("mark.n_known"), F.lit(0)).alias("near_known"),
        F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("far_known"),
        F.sum("mark.base").alias("near_base"),
        F.sum(F.when(rare, F.col("n") * F.log10((seen + 0.5) / F.lit(float(model.base_divisor)))).otherwise(0.0)).alias("far_base"),
        F.sum("mark.score").alias("near_score"),
        F.sum(F.col("n") * (F.col("step") + F.when(rare, F.coalesce("emission", F.lit(model.unseen))).otherwise(0.0))).alias("far_score"),
    )
    both = lambda name: (F.col(f"near_{name}") + F.col(f"far_{name}")) / F.col("copies")
    every = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    score = both("score")
    return every.select(
        "doc_id",
        "held_out",
        "n_tokens",
        both("known").cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        both("base").alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
