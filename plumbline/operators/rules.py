"""Policy rules: ads, irrelevant and rant without a visit."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ngrams import word_ngrams, words
from plumbline.functions.patterns import any_phrase, any_regex
from plumbline.functions.text import blank, norm_rules
from plumbline.operators.similarity import dictionary, dictionary_cosine, pair_cosine, text_key
from plumbline.policy import DEFAULT_POLICY, Policy
from plumbline.schemas import LABELS, REVIEW_COLUMNS, TASKS
from plumbline.session import materialize

BUSINESS_TEXTS = ("biz_name", "biz_cats", "biz_desc")
RULE_COLUMNS = (*TASKS, "relevant", "cosine_to_business", "offtopic", "reasons")


def url_hit(text: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return any_regex(text, policy.url_regex)


def phone_hit(text: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return any_regex(text, policy.phone_regex)


def keyword_hit(text: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return any_phrase(text, policy.keywords)


def ads_hit(text: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """Cheapest test first: the rest only runs where it has not decided yet."""
    return keyword_hit(text, policy) | url_hit(text, policy) | phone_hit(text, policy)


def rant_hit(text: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return any_phrase(text, policy.cues)


def offtopic_hit(text: Column, cats: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """A word that is foreign to the category; the category is a substring of ``cats``."""
    hits = [cats.contains(k) & any_phrase(text, ws) for k, ws in policy.off_topic.items()]
    return reduce(or_, hits) if hits else F.lit(False)


def _numbers(hits: list[Column]) -> Column:
    """Places in a list of conditions that hold, as an array."""
    return F.array_compact(
        F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(hits)]).cast("array<int>")
    )


def foreign_to(text: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """Numbers of the policy's categories to which a word of the text is foreign."""
    return _numbers([any_phrase(text, ws) for ws in policy.off_topic.values()])


def kinds_of(cats: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """Numbers of the policy's categories that are substrings of ``cats``."""
    return _numbers([cats.contains(k) for k in policy.off_topic])


def irrelevant_hit(cosine: Column, offtopic: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return (cosine < policy.min_cosine) | offtopic


def rule_reasons(policy: Policy = DEFAULT_POLICY) -> Column:
    """Reasons that fired, in fixed order; an off-topic hit reports the cosine text too."""
    return F.array_compact(
        F.array(
            F.when(F.col("ads") == 1, F.lit("ads: url/phone/promo")),
            F.when(F.col("rant_no_visit") == 1, F.lit("rant_no_visit: cue")),
            F.when(F.col("irrelevant") == 1, F.lit(f"irrelevant: cosine<{policy.min_cosine:.2f}")),
        )
    )


def render_reasons(df: DataFrame) -> DataFrame:
    """Text form of ``reasons``, for sinks."""
    return df.withColumn("reasons", F.array_join("reasons", "; "))


def normalize_for_rules(df: DataFrame, scope: str = "corpus") -> DataFrame:
    """Add ``norm_text``, ``norm_cats`` and ``norm_biz``.

    The corpus scope cleans the three business fields one by one and then joins them; the pair
    scope joins first.
    """
    name, cats, desc = F.col("biz_name"), F.col("biz_cats"), F.col("biz_desc")
    if scope == "pair":
        joined = norm_rules(F.concat_ws(" ", blank(name), blank(cats), blank(desc)))
        plain = F.lower(blank(cats))
        return df.select(
            "*",
            norm_rules(F.col("review_text")).alias("norm_text"),
            plain.alias("norm_cats"),
            joined.alias("norm_biz"),
        )
    cleaned = df.select(
        "*",
        norm_rules(F.col("review_text")).alias("norm_text"),
        norm_rules(name).alias("norm_name"),
        norm_rules(cats).alias("norm_cats"),
        norm_rules(desc).alias("norm_desc"),
    )
    biz = F.trim(F.concat_ws(" ", "norm_name", "norm_cats", "norm_desc"))
    return cleaned.withColumn("norm_biz", biz).drop("norm_name", "norm_desc")


def rules_label(
    df: DataFrame,
    policy: Policy = DEFAULT_POLICY,
    scope: str = "corpus",
    keep: tuple[str, ...] = ("review_id",),
) -> DataFrame:
    """Label every review; ``keep`` names the input columns to carry along.

    ``scope='corpus'`` fits idf on the whole input, ``scope='pair'`` on each review and its
    business alone.  Labels are columns of one plan.  The corpus scope numbers the cleaned rows where it
    writes them and works by that number, so two reviews under one key are two reviews.
    """
    if scope not in ("corpus", "pair"):
        raise ValueError(f"unknown scope: {scope}")
    if scope == "pair":
        clean = normalize_for_rules(df, scope)
        text = F.col("norm_text")
        flagged = clean.select(
            *keep,
            ads_hit(text, policy).alias("ads"),
            rant_hit(text, policy).alias("rant_no_visit"),
            offtopic_hit(text, F.col("norm_cats"), policy).alias("offtopic"),
            pair_cosine(text, F.col("norm_biz")).alias("cosine_to_business"),
        )
        return _finish(flagged, policy, keep)

    # Cleaning and cutting into words cost far more than writing their result, and two passes need it.
    text = F.col("_text")
    table = materialize(
        df.select("*", norm_rules(F.col("review_text")).alias("_text")).select(
            *keep,
            ads_hit(text, policy).alias("ads"),
            rant_hit(text, policy).alias("rant_no_visit"),
            foreign_to(text, policy).alias("_foreign"),
            words(text).alias("_words"),
            *[F.col(c).alias(f"_{c}") for c in BUSINESS_TEXTS],
            text_key(*BUSINESS_TEXTS).alias("_biz"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "cleaned",
    )
    texts = materialize(business_dictionary(table, policy), "dictionary")
    offtopic = F.coalesce(F.arrays_overlap("_foreign", "_kinds"), F.lit(False))
    scored = dictionary_cosine(
        table.select("_row", "_biz", "_words", "_foreign"), texts, "_row", carry={"offtopic": offtopic}
    )
    rows = table.select(*keep, "ads", "rant_no_visit", "_row")
    return _finish(rows.join(scored, "_row", "left").drop("_row"), policy, keep)


def business_dictionary(table: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """``(_biz, uses, _terms, _kinds)``: each distinct business text cleaned and cut into terms once."""
    names = [f"_{c}" for c in BUSINESS_TEXTS]
    clean = dictionary(table, *names).select(
        text_key(*names).alias("_biz"), "uses", *[norm_rules(F.col(n)).alias(n) for n in names]
    )
    joined = F.trim(F.concat_ws(" ", *names))
    return clean.select(
        "_biz", "uses", word_ngrams(joined).alias("_terms"), kinds_of(F.col("_biz_cats"), policy).alias("_kinds")
    )


def _finish(flagged: DataFrame, policy: Policy, keep: tuple[str, ...]) -> DataFrame:
    cosine = F.coalesce("cosine_to_business", F.lit(0.0))
    scored = flagged.select(
        *keep,
        F.col("ads").cast("int").alias("ads"),
        irrelevant_hit(cosine, F.col("offtopic"), policy).cast("int").alias("irrelevant"),
        F.col("rant_no_visit").cast("int").alias("rant_no_visit"),
        cosine.alias("cosine_to_business"),
        "offtopic",
    )
    return derive_relevant(scored).withColumn("reasons", rule_reasons(policy)).select(
        *keep, *RULE_COLUMNS
    )


def derive_relevant(
    df: DataFrame, irrelevant: str = "irrelevant", relevant: str = "relevant"
) -> DataFrame:
    return df.withColumn(relevant, F.lit(1) - F.col(irrelevant))


def rule_hit_counts(df: DataFrame, columns: tuple[str, ...] = LABELS) -> DataFrame:
    """``(label, count)`` of positives, in one global aggregation."""
    sums = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns])
    return sums.unpivot([], list(columns), "label", "count")


def pseudo_label(df: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Canonical review columns plus rule labels, cosine and reasons as text."""
    labeled = rules_label(df, policy, keep=REVIEW_COLUMNS)
    renamed = labeled.withColumnsRenamed({t: lab for t, lab in zip(TASKS, LABELS)})
    return render_reasons(renamed).select(
        *REVIEW_COLUMNS, *LABELS, "cosine_to_business", "reasons"
    )


def add_rule_labels(df: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """All input columns plus the four ``label_*`` columns, cosine and reasons as text."""
    labeled = rules_label(df, policy, keep=tuple(df.columns))
    names = {t: f"label_{t}" for t in (*TASKS, "relevant")}
    return render_reasons(labeled.withColumnsRenamed(names).drop("offtopic"))
