"""TF-IDF and logistic regression on Spark ML.

N-grams that occur in the same rows with the same counts have equal columns.  Under an L2 penalty ``m`` equal columns can be
replaced by one, ``sqrt(m)`` times as long: the best weights of the many are the weight of the one over ``sqrt(m)``, and
loss and penalty are the same.  So fits see one column per pattern, which is a fraction of the vocabulary, and the
weights are spread over the whole vocabulary afterwards; scoring uses every n-gram.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.common import _py2java
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import gramcounts
from plumbline.functions.ngrams import char_ngrams, spaced_words, word_ngrams, words
from plumbline.operators.clean import text_template
from plumbline.operators.features import META_FEATURES, add_meta_features
from plumbline.operators.metrics import Pair, avg_report, fold_macro, label_report
from plumbline.operators.sampling import class_weights
from plumbline.operators.similarity import term_rows
from plumbline.operators.solver import Counted, fit_together
from plumbline.schemas import LABELS, SCORES
from plumbline.session import materialize, tidied

# Vocabulary sizes and the strength of the classifier.
CHAR_VOCABULARY = 300_000
WORD_VOCABULARY = 200_000
INVERSE_REGULARIZATION = 1.5
MAX_ITERATIONS = 2_000
TOLERANCE = 1e-5  # of the slope of the mean loss

# From so many rows on, words and pairs that cannot be among the most frequent are told by cells before they are counted by name.
CELLS_FROM = 20_000
CELLS = 1 << 24
PATTERN = ("left", "right")
# The column of words each kind of n-gram is counted from.
MADE_OF = {"_char_grams": ("_char_words", gramcounts.CHARS), "_word_grams": ("_words", gramcounts.WORDS)}


def vocab_topk(df: DataFrame, grams: Column, k: int, min_df: int = 1) -> DataFrame:
    """``(term, cnt, df)`` of the ``k`` terms with the highest total count, ties by term.

    A histogram of counts (at most about a thousand bins) gives a cut that at least ``k`` terms
    reach, so the final ordering sees little more than ``k`` rows, not the whole vocabulary.
    """
    counts = [F.sum("cnt").cast("long").alias("cnt"), F.count(F.lit(1)).alias("df")]
    return _topk(term_rows(df, grams).groupBy("term").agg(*counts), k, min_df)


def _totals(df: DataFrame, grams: str, passing: Broadcast | None = None) -> DataFrame:
    """Counts of each n-gram, and ``left, right``: 128 bits that are equal for n-grams with equal columns.

    A pattern is the exclusive or of hashes of (row, count) pairs, so it is combined like any sum.  Tasks sum up what they
    read, so what is shuffled is a row for a distinct n-gram of a task, not one for each of each row.  ``passing`` tells cells of
    words and pairs that are counted; others are left out.
    """
    words, kind = MADE_OF[grams]
    rows = df.select(F.col(words).alias("_of"), F.monotonically_increasing_id().alias("_number"))
    sums = [F.sum(c).alias(c) for c in ("cnt", "df")] + [F.bit_xor(c).alias(c) for c in PATTERN]
    return rows.mapInArrow(gramcounts.totals(kind, passing=passing), gramcounts.TOTALS).groupBy("term").agg(*sums)


def gram_counts(df: DataFrame, words: Column, kind: str) -> DataFrame:
    """``(term, cnt, df)`` of the n-grams that rows' words make: how often each occurs, and in how many rows."""
    rows = df.select(words.alias("_of"))
    run = gramcounts.totals(kind, patterns=False)
    counted = rows.mapInArrow(run, "term string, cnt long, df long")
    return counted.groupBy("term").agg(F.sum("cnt").alias("cnt"), F.sum("df").alias("df"))


def _passing(df: DataFrame, grams: str, k: int, min_df: int) -> Broadcast | None:
    """Cells of words and pairs that may hold one of the ``k`` most frequent, of those in ``min_df`` rows or more.

    What tasks counted of their own most frequent terms, summed up, is a lower bound of a term's count, and the sum of its cell is an
    upper one.  So a cell below the ``k``-th largest lower bound holds none of them.
    """
    run = gramcounts.bounds(CELLS, k)
    found = materialize(df.select(F.col(MADE_OF[grams][0]).alias("_of")).mapInArrow(run, gramcounts.BOUNDS), "bounds")
    sure = found.filter("term is not null").groupBy("term").agg(F.sum("cnt").alias("cnt"), F.sum("df").alias("df"))
    reached, least = _level(sure.filter(F.col("df") >= min_df), k)
    if reached < k:
        return None
    cells = found.filter("slice is not null").groupBy("slice").applyInArrow(gramcounts.passing(least), "slice int, cells binary")
    bits = b"".join(r["cells"] for r in sorted(cells.collect(), key=lambda r: r["slice"]))
    return df.sparkSession.sparkContext.broadcast(np.frombuffer(bits, np.uint8))


def _level(totals: DataFrame, k: int) -> tuple[int, int]:
    """How many terms reach a count that at least ``k`` terms reach, if there are as many, and that count."""
    level = F.floor(F.log2("cnt") * 16)
    bins = totals.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.min("cnt").alias("cut")
    )
    reached, cut = 0, 0
    for row in sorted(bins.collect(), key=lambda r: -r["level"]):
        reached, cut = reached + row["n"], row["cut"]
        if reached >= k:
            break
    return reached, cut


def _topk(totals: DataFrame, k: int, min_df: int) -> DataFrame:
    totals = materialize(totals.filter(F.col("df") >= min_df), "vocabulary")
    return totals.filter(F.col("cnt") >= _level(totals, k)[1]).orderBy(F.desc("cnt"), "term").limit(k)


def add_grams(df: DataFrame) -> DataFrame:
    """Model text, its character and word n-grams as arrays, and the words they are made of, which are what is counted."""
    text = df.withColumn("_text", text_template())
    made_of = {"_char_words": spaced_words(F.col("_text")), "_words": words(F.col("_text"))}
    return text.withColumns(
        made_of | {"_char_grams": char_ngrams(F.col("_text")), "_word_grams": word_ngrams(F.col("_text"))}
    )


@dataclass
class Block:
    """One kind of n-gram: terms with their idf, and which terms have equal columns in the fitted rows."""

    grams: str
    out: str
    terms: pa.Array
    idf: np.ndarray
    group: np.ndarray  # number of each term's column among the distinct ones

    @classmethod
    def fit(cls, df: DataFrame, grams: str, out: str, vocabulary: int, min_df: int, n_docs: int) -> "Block":
        """Vocabulary, idf and patterns in one pass, or for words of many rows in two.  What reaches the driver is at most ``vocabulary`` terms."""
        many = n_docs >= CELLS_FROM and MADE_OF[grams][1] == gramcounts.WORDS
        passing = _passing(df, grams, vocabulary, min_df) if many else None
        # Written first: ordering at the driver would gather the best of every task there.
        best = materialize(_topk(_totals(df, grams, passing), vocabulary, min_df), "best")
        tidied(df.sparkSession)
        found = best.toArrow().sort_by([("cnt", "descending"), ("term", "ascending")])
        if passing:
            passing.destroy()
        if not len(found):
            raise ValueError(f"no term occurs in {min_df} or more rows")
        top = found.drop_columns("term").to_pandas()
        idf = np.log((n_docs + 1.0) / (top["df"].to_numpy(float) + 1.0)) + 1.0
        group = top.groupby([*PATTERN, "df", "cnt"], sort=False).ngroup().to_numpy()
        return cls(grams, out, found["term"].combine_chunks(), idf, group)

    def stages(self) -> list[Transformer]:
        """Counts, smooth idf and unit length over all terms."""
        return self._stages(self.terms, self.idf)

    def collapsed_stages(self) -> list[Transformer]:
        """The same over one term per distinct column, each as long as its equals together; lengths of rows stay."""
        return self._stages(*self.collapsed())

    def collapsed(self) -> tuple[pa.Array, np.ndarray]:
        first = np.unique(self.group, return_index=True)[1]
        return self.terms.take(pa.array(first)), self.idf[first] * np.sqrt(np.bincount(self.group))

    def spread(self, weights: np.ndarray) -> np.ndarray:
        """Weights of all terms from those of the distinct columns."""
        return (weights / np.sqrt(np.bincount(self.group)))[self.group]

    def _stages(self, terms: pa.Array, scale: np.ndarray) -> list[Transformer]:
        counter = _counter(terms).setInputCol(self.grams).setOutputCol(f"{self.out}_tf")
        scaled = ElementwiseProduct(
            scalingVec=Vectors.dense(scale), inputCol=f"{self.out}_tf", outputCol=f"{self.out}_raw"
        )
        return [counter, scaled, Normalizer(p=2.0, inputCol=f"{self.out}_raw", outputCol=self.out)]


def _counter(terms: pa.Array) -> CountVectorizerModel:
    """Vectorizer for a given vocabulary.

    ``from_vocabulary`` makes one call to the JVM per term, which takes minutes for a full-size
    vocabulary; splitting one long string there takes one call.  No term holds a line break.
    """
    jvm = SparkContext._active_spark_context._jvm
    array = jvm.java.util.regex.Pattern.compile("\n").split("\n".join(terms.to_pylist()))
    model = CountVectorizerModel._create_from_java_class(
        "org.apache.spark.ml.feature.CountVectorizerModel", array
    )
    model._terms = terms  # at hand, not to be fetched again
    return model


def _terms(model: CountVectorizerModel) -> pa.Array:
    found = getattr(model, "_terms", None)
    return pa.array(model.vocabulary, pa.string()) if found is None else found


def fit_blocks(
    df: DataFrame,
    min_df: int = 1,
    char_vocabulary: int = CHAR_VOCABULARY,
    word_vocabulary: int = WORD_VOCABULARY,
) -> list[Block]:
    """Both kinds of n-gram of rows from ``add_grams``."""
    n_docs = df.count()
    char = Block.fit(df, "_char_grams", "_char", char_vocabulary, min_df, n_docs)
    word = Block.fit(df, "_word_grams", "_word", word_vocabulary, min_df, n_docs)
    return [char, word]


def vectorizer(blocks: Sequence[Block], collapsed: bool = False) -> PipelineModel:
    """N-grams to ``tfidf``, over the whole vocabulary or over its distinct columns."""
    stages = [s for b in blocks for s in (b.collapsed_stages() if collapsed else b.stages())]
    return PipelineModel([*stages, VectorAssembler(inputCols=[b.out for b in blocks], outputCol="tfidf")])


def fit_tfidf(df: DataFrame, min_df: int = 1, **vocabularies: int) -> PipelineModel:
    """Vectorizer for rows from ``add_grams``; its output is ``tfidf``."""
    return vectorizer(fit_blocks(df, min_df, **vocabularies))


def apply_stages(df: DataFrame, stages: Sequence[Transformer], sizes: Mapping[str, int]) -> DataFrame:
    """Run fitted stages, keeping only the length of each vector as column metadata.

    By default every dimension is described by name; with hundreds of thousands of them these
    descriptions, shipped with each task, cost far more than the work itself.
    """
    for stage in stages:
        out = stage.getOutputCol()
        df = stage.transform(df).withMetadata(out, _only_length(sizes[out]))
    return df


def _only_length(n: int) -> dict:
    return {"ml_attr": {"num_attrs": n}}


def add_vectors(df: DataFrame, model: PipelineModel) -> DataFrame:
    """What ``model``, a ``vectorizer``, gives for rows from ``add_grams``: ``tfidf``, counted from words inside tasks."""
    counters = [s for s in model.stages if isinstance(s, CountVectorizerModel)]
    scales = [s.getScalingVec().toArray() for s in model.stages if isinstance(s, ElementwiseProduct)]
    books = df.sparkSession.sparkContext.broadcast([(_terms(c), s) for c, s in zip(counters, scales, strict=True)])
    columns, kinds = zip(*[MADE_OF[c.getInputCol()] for c in counters], strict=True)
    run = gramcounts.weighed(list(kinds), books)

    @F.arrow_udf(VectorUDT())
    def vectors(arrays: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return run(arrays)

    size = sum(map(len, scales))
    counted = df.withColumn("_counted", vectors(*columns)).withMetadata("_counted", _only_length(size))
    return apply_stages(counted, [VectorAssembler(inputCols=["_counted"], outputCol="tfidf")], {"tfidf": size})


def vector_sizes(stages: Sequence[Transformer]) -> dict[str, int]:
    """Length of every vector that the stages make, told by the idf weights."""
    sizes: dict[str, int] = {}
    for stage in stages:
        if isinstance(stage, ElementwiseProduct):
            size = len(stage.getScalingVec())
            sizes[stage.getInputCol()] = sizes[stage.getOutputCol()] = size
        elif isinstance(stage, Normalizer):
            sizes[stage.getOutputCol()] = sizes[stage.getInputCol()]
        elif isinstance(stage, VectorAssembler):
            sizes[stage.getOutputCol()] = sum(sizes[c] for c in stage.getInputCols())
    return sizes


def column_scales(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Population standard deviation of each column; 1 where it is 0."""
    row = df.agg(*[F.stddev_pop(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in columns]).first()
    return {c: row[c] or 1.0 for c in columns}


def scale_features(df: DataFrame, scales: Mapping[str, float]) -> DataFrame:
    """Divide by the scale, without centering; null counts as 0."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)).cast("double") / s for c, s in scales.items()}
    )


def fit_lr(
    df: DataFrame,
    labels: Sequence[str],
    features: str | Counted,
    size: int,
    dense: int = 0,
    c: float = INVERSE_REGULARIZATION,
    max_iter: int = MAX_ITERATIONS,
    tol: float = TOLERANCE,
) -> np.ndarray:
    """Class-balanced logistic regressions, a row of weights and intercept per label.

    ``c`` multiplies a sum of losses; here losses are averaged, so the penalty is ``1 / (c * n)``.  A label of which
    only one class occurs has no finite optimum: its weights are 0 and its intercept is infinite.  The last ``dense`` of ``size``
    columns are those that most rows have.  ``features`` is a column of vectors, or what they are made of.
    """
    n = max(df.count(), 1)
    found = {r["label"]: r for r in class_weights(df, labels).collect()}
    cost = np.array([[found[x]["weight_0"] or 0.0, found[x]["weight_1"] or 0.0] for x in labels])
    both = [i for i in range(len(labels)) if cost[i].all()]
    out = np.zeros((len(labels), size + 1))
    out[:, -1] = np.where(cost[:, 1] > 0, np.inf, -np.inf)
    if both:
        chosen = [labels[i] for i in both]
        out[both] = fit_together(df, features, chosen, size, dense, cost[both], 1.0 / (c * n), max_iter, tol)
    return out


def spread_weights(fitted: np.ndarray, blocks: Sequence[Block]) -> np.ndarray:
    """Weights over whole vocabularies that weights over distinct columns stand for."""
    parts = []
    for block in blocks:
        n = int(block.group.max()) + 1
        parts.append(block.spread(fitted[:n]))
        fitted = fitted[n:]
    return np.concatenate([*parts, fitted])


def classifier(fitted: np.ndarray) -> LogisticRegressionModel:
    """Spark ML's model with the given weights and, last, intercept."""
    context = SparkContext._active_spark_context
    java = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"lr_{uuid.uuid4().hex[:12]}", _py2java(context, Vectors.dense(fitted[:-1])), float(fitted[-1])
    )
    return LogisticRegressionModel(java)


@dataclass
class ReviewScorer:
    """A fitted vectorizer, optional feature scales, and one classifier per label."""

    tfidf: PipelineModel
    classifiers: dict[str, LogisticRegressionModel]
    scales: dict[str, float]

    @property
    def features(self) -> str:
        return "features" if self.scales else "tfidf"

    def vectorize(self, df: DataFrame) -> DataFrame:
        sizes = vector_sizes(self.tfidf.stages)
        wide = add_vectors(df, self.tfidf)
        return assemble_features(wide, self.scales, sizes["tfidf"]) if self.scales else wide

    def score(self, df: DataFrame) -> DataFrame:
        """Input columns plus ``ads_p, irrelevant_p, rant_no_visit_p``; not trained means 0."""
        source = add_grams(add_keep(df)) if self.scales else add_grams(df)
        vectors = self.vectorize(source)
        probabilities = {}
        for label, column in zip(LABELS, SCORES):
            model = self.classifiers.get(label)
            if model is None:
                probabilities[column] = F.lit(0.0)
                continue
            out = f"_{column}"
            single = model.copy()
            single.setFeaturesCol(self.features).setProbabilityCol(out)
            single.setRawPredictionCol("").setPredictionCol("")
            vectors = single.transform(vectors)
            probabilities[column] = F.get(vector_to_array(out), F.lit(1))
        return vectors.select(*df.columns, *[p.alias(c) for c, p in probabilities.items()])

    def save(self, path: str) -> None:
        """Spark ML's own format, one folder per part."""
        self.tfidf.write().overwrite().save(f"{path}/tfidf")
        for label, model in self.classifiers.items():
            model.write().overwrite().save(f"{path}/lr/{label}")
        about = json.dumps({"labels": list(self.classifiers), "scales": self.scales})
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ReviewScorer":
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        return cls(
            PipelineModel.load(f"{path}/tfidf"),
            {c: LogisticRegressionModel.load(f"{path}/lr/{c}") for c in about["labels"]},
            about["scales"],
        )


def add_keep(df: DataFrame) -> DataFrame:
    """Input columns plus the ten meta features under private names."""
    private = {c: f"_meta_{c}" for c in META_FEATURES}
    return add_meta_features(df).select(
        *df.columns, *[F.col(c).cast("double").alias(p) for c, p in private.items()]
    )


def assemble_features(df: DataFrame, scales: Mapping[str, float], tfidf_size: int) -> DataFrame:
    """``features``: the TF-IDF vector followed by the scaled meta features."""
    join = VectorAssembler(inputCols=["tfidf", *scales], outputCol="features")
    sizes = {"features": tfidf_size + len(scales)}
    return apply_stages(scale_features(df, scales), [join], sizes)


def train_scorer(
    df: DataFrame,
    labels: Sequence[str] = LABELS,
    min_df: int = 1,
    with_meta: bool = False,
    max_iter: int = MAX_ITERATIONS,
    tol: float = TOLERANCE,
    char_vocabulary: int = CHAR_VOCABULARY,
    word_vocabulary: int = WORD_VOCABULARY,
    collapse: bool = True,
) -> ReviewScorer:
    """Fit the vectorizer, then one independent classifier per label (labels may coincide).

    ``collapse=False`` fits over all n-grams, equal columns included; the optimum is the same.
    """
    rows = add_grams(add_keep(df) if with_meta else df)
    meta = [f"_meta_{c}" for c in META_FEATURES] if with_meta else []
    blocks = fit_blocks(rows, min_df, char_vocabulary, word_vocabulary)
    scales = column_scales(rows, meta) if with_meta else {}
    scorer = ReviewScorer(vectorizer(blocks), {}, scales)
    columns, kinds = zip(*[MADE_OF[b.grams] for b in blocks], strict=True)
    books = [b.collapsed() if collapse else (b.terms, b.idf) for b in blocks]
    size = sum(len(scale) for _, scale in books) + len(scales)
    scaled = scale_features(rows, scales) if scales else rows
    weights = fit_lr(scaled, labels, Counted(columns, kinds, books, list(scales)), size, len(scales), max_iter=max_iter, tol=tol)
    for label, fit in zip(labels, weights, strict=True):
        scorer.classifiers[label] = classifier(spread_weights(fit, blocks) if collapse else fit)
    return scorer


def decide(df: DataFrame, labels: Sequence[str] = LABELS) -> tuple[DataFrame, list[Pair]]:
    """Add ``<label>_hat``: strictly above one half, as holdout reports count it."""
    hats = {f"{c}_hat": (F.col(f"{c[6:]}_p") > 0.5).cast("int") for c in labels}
    return df.withColumns(hats), [Pair(c, c, f"{c}_hat") for c in labels]


def holdout_eval(split: DataFrame, **train_options) -> tuple[ReviewScorer, DataFrame, DataFrame]:
    """Fit on ``split = 'train'``, report on the rest: scorer, label report, averages."""
    scorer = train_scorer(split.filter("split = 'train'"), **train_options)
    scored, pairs = decide(scorer.score(split.filter("split = 'test'")))
    return scorer, label_report(scored, pairs), avg_report(scored, pairs)


def group_cv(
    folds: DataFrame, k: int, min_df: int = 2, with_meta: bool = True, **train_options
) -> tuple[DataFrame, DataFrame]:
    """Fit on all folds but one, score that one: held-out rows, and macro scores over folds.

    One fold after the other, its rows written before the next one's fit begins, so the driver and the workers hold one model at a time.
    """
    def held_out(i: int) -> DataFrame:
        scorer = train_scorer(
            folds.filter(F.col("fold") != i), min_df=min_df, with_meta=with_meta, **train_options
        )
        return materialize(scorer.score(folds.filter(F.col("fold") == i)), "held-out")

    decided, pairs = decide(reduce(DataFrame.unionByName, map(held_out, range(k))))
    return decided, fold_macro(decided, pairs)
