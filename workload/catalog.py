"""One Spark query per operator.  Each takes ``(spark, sf_dir)`` and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import cells, gramcounts, ngrams
from plumbline.functions import text as tx
from plumbline.operators import clean, ensemble, evaluate, ingest, metrics, rules, sampling
from plumbline.operators import features as feats
from plumbline.operators import modeling, phrases, similarity, thresholds, views as result_views
from plumbline.plans import jobs
from plumbline.schemas import (
    BUSINESS_ALIASES,
    LABELED_SCHEMA,
    LABELS,
    REVIEW_ALIASES,
    REVIEW_COLUMNS,
    REVIEW_SCHEMA,
    SCORES,
    TASKS,
)
from plumbline.session import fresh_path, materialize
from plumbline.sources import readers, sinks
from plumbline.streaming import label_stream as stream
from workload import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TUNED = {"ads": 0.4, "irrelevant": 0.55}
PAIRS = [metrics.Pair(c, c, f"{c}_hat") for c in LABELS]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def _texts(spark, sf):
    return views.reviews(spark, sf).select("review_id", "review_text", "biz_name", "biz_cats", "biz_desc")


def _norm(spark, sf):
    clean_rows = rules.normalize_for_rules(_texts(spark, sf))
    return clean_rows.select("review_id", "norm_text", "norm_cats", "norm_biz")


def _ruled(spark, sf, keep=("review_id",)):
    return rules.rules_label(views.reviews(spark, sf), keep=keep)


def _ruled_and_scored(spark, sf, keep=("review_id",)):
    return ensemble.attach_scores(_ruled(spark, sf, keep), views.scores(spark, sf))


def _oof(spark, sf) -> DataFrame:
    """Scores of all reviews with truth, in folds by business."""
    fold = views.reviews(spark, sf).select(
        "review_id", cells.md5_bucket(F.col("business_id"), 5).alias("fold")
    )
    wide = views.truth(spark, sf).join(views.scores(spark, sf), "review_id").join(fold, "review_id")
    entries = [
        F.struct(F.lit(t).alias("label"), F.col(f"label_{t}").alias("y"), F.col(f"{t}_p").alias("p"))
        for t in TASKS
    ]
    long = wide.select("review_id", "fold", F.explode(F.array(*entries)).alias("e"))
    return long.select("review_id", "fold", "e.*")


def _predictions(spark, sf) -> DataFrame:
    """Truth with predictions at one half, one row per review."""
    hats = views.scores(spark, sf).select(
        "review_id", *[(F.col(f"{t}_p") >= 0.5).cast("int").alias(f"label_{t}_hat") for t in TASKS]
    )
    return views.truth(spark, sf).join(hats, "review_id")


def _stage(df: DataFrame, fmt: str, name: str, **options) -> str:
    """Write a table as input files for a reader."""
    path = fresh_path(df.sparkSession, name)
    df.write.format(fmt).options(**options).save(path)
    return path


CSV = dict(
    header=True, quoteAll=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False,
    ignoreTrailingWhiteSpace=False, nullValue="", emptyValue="",
)


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.format("csv").options(**CSV).save(path)


def _stage_csv(df: DataFrame, name: str) -> str:
    return _stage(df, "csv", name, **CSV)


# ---- sources and sinks ----------------------------------------------------------------------


@query
def scan_reviews(spark, sf):
    path = _stage_csv(
        views.reviews(spark, sf).select("review_id", "review_text", "biz_name", "biz_cats",
                                        "biz_desc", "stars"), "reviews-csv")
    return readers.scan_reviews(spark, path, multi_line=True)


@query
def scan_typed(spark, sf):
    odd = F.when(F.col("stars") == 5, F.lit("x")).otherwise(F.concat(F.col("stars"), F.lit(".0")))
    source = views.reviews(spark, sf).withColumn("stars", odd).drop("lang", "price")
    typed = readers.scan_typed(spark, _stage_csv(source, "typed-csv"), multi_line=True)
    return typed.select("review_id", "stars", "time_ms", "lat", "price", "label_ads", "reasons")


def _stage_raw_reviews(spark, sf) -> str:
    """JSON lines with all spellings of the keys, and a broken line for every tenth review."""
    r = views.reviews(spark, sf)
    n = F.col("review_id").cast("long") % 3
    line = F.to_json(F.struct(
        F.when(n == 0, F.col("business_id")).alias("gmap_id"),
        F.when(n == 1, F.col("business_id")).alias("gmapid"),
        F.when(n == 2, F.col("business_id")).alias("gmapId"),
        F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit("u"), "review_id")).alias("user_id"),
        F.when(n == 0, F.concat(F.lit("v"), "review_id")).alias("uid"),
        F.col("stars").alias("rating"),
        F.col("review_text").alias("text"),
        F.when(n != 1, F.col("time_ms")).alias("time"),
        F.when(n == 1, F.col("time_ms").cast("string")).alias("timestamp"),
    ))
    broken = r.filter("CAST(review_id AS BIGINT) % 10 = 0").select(
        F.concat(F.lit('{"gmap_id": "'), "business_id", F.lit('", "text": ')).alias("value"))
    blank = r.filter("CAST(review_id AS BIGINT) % 10 = 1").select(F.lit("   ").alias("value"))
    lines = r.select(line.alias("value")).unionByName(broken).unionByName(blank)
    return _stage(lines, "text", "reviews-jsonl", compression="gzip")


def _stage_raw_businesses(spark, sf) -> str:
    """Two lines per business, of which the second counts; categories as list or as text."""
    b = views.table(spark, sf, "benchmark")
    even = F.col("item_id") % 2 == 0
    def line(version):
        return F.to_json(F.struct(
            F.concat(F.lit("src"), "item_id").alias("gmap_id"),
            F.concat(F.lit(f"Shop v{version} "), "item_id").alias("name"),
            F.when(even, F.to_json(F.array(F.lit("Park"), F.lit("Outdoor")))).alias("category"),
            F.when(~even, F.lit("Spa, Wellness")).alias("categories"),
            F.col("text").alias("description"),
            F.lit("ZZ").alias("province"),
            F.lit(0).alias("latitude"),
            F.col("item_id").alias("lat"),
            F.lit(version).alias("price"),
        ))
    both = [b.select("item_id", F.lit(v).alias("v"), line(v).alias("value")) for v in (1, 2)]
    lines = both[0].unionByName(both[1]).repartition(1).sortWithinPartitions("item_id", "v")
    # A list must be a JSON list, not text that holds one.
    unquoted = F.regexp_replace(
        "value", r'"category":"\[\\"Park\\",\\"Outdoor\\"\]"', '"category":["Park","Outdoor"]')
    return _stage(lines.select(unquoted.alias("value")), "text", "business-jsonl")


@query
def scan_jsonl(spark, sf):
    raw = readers.scan_jsonl(spark, _stage_raw_reviews(spark, sf), REVIEW_ALIASES, partitions=8)
    return raw.select(
        cells.first_truthy(*[F.get("business_id_raw", F.lit(i)) for i in range(3)]).alias("business_id"),
        cells.first_truthy(*[F.get("user_id_raw", F.lit(i)) for i in range(2)]).alias("user_id"),
        F.get("text_raw", F.lit(0)).alias("text"),
        F.get("rating_raw", F.lit(0)).alias("rating"),
        cells.first_truthy(*[F.get("time_raw", F.lit(i)) for i in range(2)]).alias("time"),
    )


@query
def union_shards(spark, sf):
    """A pattern over three shards: one as it is, one with its columns in another order, one without a column."""
    r = views.reviews(spark, sf).select("review_id", "business_id", "state", "price")
    root = fresh_path(spark, "shards")
    orders = {"CA": r.columns, "NY": r.columns[::-1], "TX": r.columns[:-1]}
    for state, columns in orders.items():
        _write_csv(r.filter(F.col("state") == state).select(*columns), f"{root}/{state}")
    return readers.union_shards(spark, f"{root}/*/*.csv")


@query
def scan_pruned(spark, sf):
    joined = views.reviews(spark, sf).join(views.truth(spark, sf), "review_id")
    return readers.scan_pruned(joined, ["label_irrelevant"])


@query
def sink_table(spark, sf):
    path = fresh_path(spark, "by-state")
    sinks.write_table(views.reviews(spark, sf), path)
    back = spark.read.schema(REVIEW_SCHEMA).parquet(path)
    return back.groupBy("state").agg(
        F.count("*").alias("n"), F.sum("time_ms").alias("time_sum"),
        F.sum(F.length("review_text").cast("long")).alias("chars"))


@query
def oof_store(spark, sf):
    path = fresh_path(spark, "oof")
    sinks.write_oof(_oof(spark, sf), path)
    return sinks.read_oof(spark, path).select("review_id", "fold", "label", "y", "p")


@query
def cap_rows(spark, sf):
    return clean.cap_rows(views.reviews(spark, sf).select("review_id", "business_id"), 100)


@query
def thresholds_table(spark, sf):
    path = fresh_path(spark, "thresholds")
    sinks.write_thresholds(thresholds.tune_oof(_oof(spark, sf)), path)
    return sinks.thresholds_table(spark, sinks.read_thresholds(spark, path))


# ---- cleaning and keys ----------------------------------------------------------------------


@query
def norm_rules(spark, sf):
    return _texts(spark, sf).select("review_id", tx.norm_rules(F.col("review_text")).alias("t"))


@query
def norm_clean(spark, sf):
    return _texts(spark, sf).select("review_id", tx.norm_clean(F.col("review_text")).alias("t"))


@query
def norm_ingest(spark, sf):
    return _texts(spark, sf).select("review_id", tx.norm_ingest(F.col("review_text")).alias("t"))


@query
def null_words(spark, sf):
    n = F.col("review_id").cast("long") % 6
    odd = F.when(n == 0, F.lit(" NaN ")).when(n == 1, F.lit("none")).when(n == 2, F.lit("Null\t"))
    cell = F.when(n == 3, F.lit(None)).otherwise(F.coalesce(odd, F.col("review_text")))
    return _texts(spark, sf).select("review_id", tx.blank_null_words(cell).alias("t"))


def _odd_number(c):
    n = F.col("review_id").cast("long") % 7
    text = c.cast("string")
    return (F.when(n == 0, F.lit("4.7")).when(n == 1, F.lit("x")).when(n == 2, F.lit(" 9 "))
            .when(n == 3, F.lit("-1")).when(n == 4, F.lit("")).otherwise(text))


@query
def coerce_stars(spark, sf):
    cell = _odd_number(F.col("stars"))
    return views.reviews(spark, sf).select(
        "review_id", cells.coerce_stars(cell).alias("stars"),
        cells.coerce_stars(cell, clip=True).alias("stars_clipped"))


@query
def coerce_label(spark, sf):
    n = F.col("review_id").cast("long") % 5
    cell = (F.when(n == 0, F.lit("True")).when(n == 1, F.lit("false")).when(n == 2, F.lit("oops"))
            .when(n == 3, F.lit("7")).otherwise(F.col("stars").cast("string")))
    return views.reviews(spark, sf).select("review_id", cells.coerce_label(cell).alias("y"))


@query
def keep_english(spark, sf):
    lang = F.when(F.col("lang") != "de", F.col("lang"))
    return clean.keep_english(views.reviews(spark, sf).withColumn("lang", lang)).select(
        "review_id", "lang")


@query
def synthesized_ids_differ(spark, sf):
    """One business-less upload of every review, twice: as many keys as rows."""
    r = views.reviews(spark, sf).select("review_text", "biz_name")
    out = clean.normalize_upload(r.unionByName(r))
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("review_id").alias("n_keys"))


@query
def dedup_null_keys(spark, sf):
    """Two thirds of the keys are missing; the cells of the kept row must not be."""
    key = F.when(F.col("stars") % 3 == 0, F.col("review_id"))
    r = views.reviews(spark, sf).select(key.alias("review_id"), "business_id", "state", "stars")
    return clean.dedup_reviews(r, ("business_id", "state"))


@query
def dedup_reviews(spark, sf):
    r = views.reviews(spark, sf).select("review_id", "business_id", "review_text", "stars")
    return clean.dedup_reviews(r)


@query
def hash_business_id(spark, sf):
    return views.reviews(spark, sf).select(
        "review_id", cells.hash_business_id(F.col("biz_name")).alias("business_id"))


@query
def uuid5_review_id(spark, sf):
    key = cells.review_uuid(F.nullif("city", F.lit("City de")), F.col("business_id"), F.col("time_ms"))
    return views.reviews(spark, sf).select("review_id", key.alias("uuid"))


@query
def synthesize_id(spark, sf):
    """Every review comes twice, so equal rows must get different keys."""
    r = views.reviews(spark, sf).select("business_id", "review_text", "time_ms")
    r = r.unionByName(r)
    return clean.synthesize_id(r).select("review_id", "business_id", "time_ms")


def _restaurants(spark, sf):
    return views.reviews(spark, sf).select(
        F.col("biz_name").alias("business_name"), F.col("city").alias("author_name"),
        F.col("review_text").alias("text"), F.lit("").alias("photo"),
        (F.col("stars") + 2).alias("rating"), F.col("state").alias("rating_category"))


@query
def map_source_schema(spark, sf):
    return clean.map_source_schema(_restaurants(spark, sf))


@query
def ensure_columns(spark, sf):
    r = views.reviews(spark, sf).select(
        "review_id", F.concat(F.col("stars"), F.lit(".0")).alias("stars"), "price", "lang")
    return clean.ensure_columns(r).select(*REVIEW_COLUMNS, "lang")


@query
def normalize_upload(spark, sf):
    r = views.reviews(spark, sf).select(
        "review_text", F.when(F.col("stars") > 2, F.col("biz_name")).otherwise("None").alias("biz_name"))
    return clean.normalize_upload(r).select("review_text", "biz_name", "biz_cats", "business_id")


@query
def first_truthy(spark, sf):
    n = F.col("review_id").cast("long")
    a = F.when(n % 3 == 0, F.lit("")).when(n % 3 == 1, F.col("state"))
    lat, alt = (n % 4).cast("string"), F.col("stars").cast("string")
    return views.reviews(spark, sf).select(
        "review_id", cells.first_truthy(a, F.col("price"), F.col("city")).alias("place"),
        cells.first_truthy(lat, alt, zero_is_empty=True).alias("lat"))


@query
def join_categories(spark, sf):
    listed = F.to_json(F.split("biz_cats", ", "))
    cell = F.when(F.col("stars") > 2, listed).when(F.col("stars") > 1, F.col("biz_cats"))
    return views.reviews(spark, sf).select("review_id", cells.join_categories(cell).alias("cats"))


@query
def text_template(spark, sf):
    return _texts(spark, sf).select(
        "review_id", clean.text_template().alias("long_form"),
        clean.text_template(short=True).alias("short_form"))


@query
def nonempty_text(spark, sf):
    """Every review also comes once without its text."""
    texts = _texts(spark, sf).select("review_id", "review_text")
    blank = texts.select(F.concat("review_id", F.lit("-blank")).alias("review_id"), F.lit("").alias("review_text"))
    return clean.nonempty_text(texts.unionByName(blank))


@query
def check_labels(spark, sf):
    return clean.check_labels(views.truth(spark, sf)).select(
        "review_id", "label_relevant", "label_irrelevant")


@query
def repair_labels(spark, sf):
    return clean.repair_labels(views.truth(spark, sf)).select(
        "review_id", "label_relevant", "label_irrelevant")


@query
def derive_relevant(spark, sf):
    t = views.truth(spark, sf).select("review_id", "label_irrelevant")
    return rules.derive_relevant(t, "label_irrelevant", "label_relevant")


@query
def fill_null_text(spark, sf):
    gaps = F.when(F.col("stars") > 2, F.col("review_text")).alias("review_text")
    r = views.reviews(spark, sf).select("review_id", gaps, "biz_name", "price")
    return clean.fill_null_text(r)


@query
def tag_state(spark, sf):
    r = views.reviews(spark, sf).select("review_id", "state")
    untagged = clean.tag_state(r, "").withColumnRenamed("state", "untagged")
    return clean.tag_state(r, "WA").join(untagged, "review_id")


@query
def pick_context(spark, sf):
    r = views.reviews(spark, sf).select(
        "review_id", F.col("business_id").alias("place_id"), F.col("biz_name").alias("name"),
        F.col("biz_cats").alias("category"), F.col("review_text").alias("comment"), "stars")
    return r.select(*clean.pick_context(r.columns))


# ---- joins ----------------------------------------------------------------------------------


@query
def enrich_business(spark, sf):
    out = jobs.ingest_job(
        spark, _stage_raw_reviews(spark, sf), _stage_raw_businesses(spark, sf), partitions=8)
    return out.select(*REVIEW_COLUMNS)


@query
def join_truth_preds(spark, sf):
    preds = views.scores(spark, sf).select(
        "review_id", (F.col("ads_p") >= 0.5).cast("int").alias("label_ads"), "irrelevant_p")
    return evaluate.join_truth_preds(
        views.truth(spark, sf).select("review_id", "label_ads", "label_irrelevant"), preds)


@query
def align_outputs(spark, sf):
    """Rule output, scores and input side by side, by key."""
    r = _ruled_and_scored(spark, sf, keep=("review_id", "business_id"))
    return rounded(r.select("review_id", "business_id", *TASKS, "cosine_to_business", *SCORES),
                   "cosine_to_business")


@query
def resolve_pred_columns(spark, sf):
    preds = views.scores(spark, sf).select(
        "review_id", *[(F.col(f"{t}_p") >= 0.5).alias(t) for t in TASKS])
    joined, pairs = evaluate.align_predictions(views.truth(spark, sf), preds)
    return metrics.label_report(joined, pairs).transform(rounded, "precision", "recall", "f1")


@query
def autolabel_truth(spark, sf):
    bare = views.reviews(spark, sf).select(
        "review_id", "review_text", "biz_name", "biz_cats", "biz_desc")
    return evaluate.autolabel_truth(bare).select("review_id", *LABELS)


# ---- rules ----------------------------------------------------------------------------------


def _flag(hit):
    def run(spark, sf):
        n = _norm(spark, sf)
        return n.select("review_id", hit(n).cast("int").alias("hit"))
    return run


QUERIES["url_hit"] = _flag(lambda n: rules.url_hit(n.norm_text))
QUERIES["phone_hit"] = _flag(lambda n: rules.phone_hit(n.norm_text))
QUERIES["keyword_hit"] = _flag(lambda n: rules.keyword_hit(n.norm_text))
QUERIES["ads_label"] = _flag(lambda n: rules.ads_hit(n.norm_text))
QUERIES["rant_label"] = _flag(lambda n: rules.rant_hit(n.norm_text))
QUERIES["offtopic_hit"] = _flag(lambda n: rules.offtopic_hit(n.norm_text, n.norm_cats))


@query
def irrelevant_label(spark, sf):
    return _ruled(spark, sf).select("review_id", "irrelevant", F.col("offtopic").cast("int").alias("offtopic"))


@query
def rules_label(spark, sf):
    return rounded(_ruled(spark, sf).select("review_id", *TASKS, "relevant", "cosine_to_business"),
                   "cosine_to_business")


@query
def rules_label_duplicates(spark, sf):
    """Two reviews to a key: each is labeled by itself."""
    r = views.reviews(spark, sf).withColumn("row_name", F.col("review_id"))
    r = r.withColumn("review_id", F.expr("concat('k', cast(cast(row_name as bigint) div 2 as string))"))
    out = rules.rules_label(r, keep=("review_id", "row_name"))
    return rounded(out.select("review_id", "row_name", *TASKS, "cosine_to_business"), "cosine_to_business")


def _large_policy(spark, sf):
    """Every run of two to eight words between punctuation in ``benchmark``: over 10,000 phrases at sf0.01."""
    text = F.regexp_replace(F.lower("text"), r"([^\p{L}\p{N}_ ])", " | ")
    tokens = views.table(spark, sf, "benchmark").select(F.split(text, " ").alias("w"))
    starts = tokens.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    runs = starts.select("i", "w", F.explode(F.sequence(F.lit(2), F.lit(8))).alias("n"))
    runs = runs.filter("i + n - 1 <= size(w)").select("n", F.slice("w", F.col("i"), F.col("n")).alias("run"))
    runs = runs.filter(F.forall("run", lambda t: ~t.isin("", "|")))
    pattern = F.array_join("run", " ")
    kind = F.expr("elt(1 + length(pattern) % 3, 'keyword', 'cue', 'off_topic')")
    category = F.expr("elt(1 + n % 4, 'restaurant', 'spa', 'electronics', 'park')")
    return runs.select("n", pattern.alias("pattern")).select(
        kind.alias("kind"), category.alias("category"), "pattern"
    )


@query
def phrase_policy(spark, sf):
    """A policy of thousands of phrases, as a table."""
    return phrases.phrase_counts(_texts(spark, sf), _large_policy(spark, sf))


@query
def phrase_policy_default(spark, sf):
    """The default policy as a table: the counts decide as the rules do."""
    policy = rules.DEFAULT_POLICY.to_table(spark)
    found = phrases.phrase_counts(_texts(spark, sf), policy)
    return found.select("review_id", *[
        (F.col(f"{c}_phrases") > 0).cast("int").alias("hit_" + c) for c in ("ads", "rant", "offtopic")])


@query
def rules_label_pair(spark, sf):
    r = rules.rules_label(views.reviews(spark, sf), scope="pair")
    return rounded(r.select("review_id", *TASKS, "relevant", "cosine_to_business"),
                   "cosine_to_business")


@query
def rule_reasons(spark, sf):
    return rules.render_reasons(_ruled(spark, sf)).select("review_id", "reasons")


@query
def rule_hit_counts(spark, sf):
    return rules.rule_hit_counts(_ruled(spark, sf), TASKS)


@query
def pseudo_label(spark, sf):
    return rounded(jobs.weak_label_job(views.reviews(spark, sf)), "cosine_to_business")


@query
def flagged_per_business(spark, sf):
    return jobs.flagged_per_business(views.reviews(spark, sf))


@query
def preprocess_restaurants(spark, sf):
    out = jobs.preprocess_job(_restaurants(spark, sf), label=True)
    return rounded(out.drop("rating_category", "author_name"), "cosine_to_business")


# ---- similarity -----------------------------------------------------------------------------


@query
def word_ngrams(spark, sf):
    return similarity.ngram_counts(_norm(spark, sf), "norm_text")


@query
def doc_freq(spark, sf):
    return similarity.doc_freq(_norm(spark, sf), "norm_text", shared=("norm_biz",))


@query
def idf_weights(spark, sf):
    return rounded(similarity.idf_weights(_norm(spark, sf), "norm_text", shared=("norm_biz",)), "idf")


@query
def corpus_cosine(spark, sf):
    return rounded(similarity.corpus_cosine(_norm(spark, sf), "norm_text", "norm_biz"),
                   "cosine_to_business")


@query
def pair_cosine(spark, sf):
    n = _norm(spark, sf)
    cosine = similarity.pair_cosine(n.norm_text, n.norm_biz)
    return rounded(n.select("review_id", cosine.alias("cosine_to_business")), "cosine_to_business")


@query
def char_ngrams(spark, sf):
    return modeling.gram_counts(_norm(spark, sf), ngrams.spaced_words(F.col("norm_text")), gramcounts.CHARS)


@query
def vocab_topk(spark, sf):
    grams = ngrams.word_ngrams(F.col("norm_text"))
    return modeling.vocab_topk(_norm(spark, sf), grams, k=5000, min_df=2)


@query
def cosine_sweep(spark, sf):
    labeled = _ruled(spark, sf).join(views.truth(spark, sf), "review_id")
    truths = {t: f"label_{t}" for t in (*TASKS, "relevant")}
    curve = thresholds.cosine_curve(labeled, truths)
    return rounded(curve, *curve.columns)


@query
def cosine_sweep_best(spark, sf):
    labeled = _ruled(spark, sf).join(views.truth(spark, sf), "review_id")
    truths = {t: f"label_{t}" for t in (*TASKS, "relevant")}
    best = thresholds.best_cosine(thresholds.cosine_curve(labeled, truths))
    return rounded(best.select("thr", "macro_f1"), "thr", "macro_f1")


# ---- features -------------------------------------------------------------------------------


@query
def featurize_metadata(spark, sf):
    r = views.reviews(spark, sf).select("review_id", "review_text", "time_ms")
    out = jobs.featurize_job(r).drop("review_text", "time_ms")
    return rounded(out, "feat_caps_ratio", "feat_digit_ratio", digits=5)


@query
def add_meta_features(spark, sf):
    r = views.reviews(spark, sf).select("review_id", "review_text")
    return rounded(feats.add_meta_features(r).drop("review_text"), "avg_word_len", "uppercase_ratio")


# ---- sampling and models --------------------------------------------------------------------


@query
def subsample(spark, sf):
    return sampling.subsample(views.reviews(spark, sf).select("review_id", "business_id"), 100)


@query
def sample_fraction(spark, sf):
    return sampling.sample_fraction(views.reviews(spark, sf).select("review_id"), 0.3)


@query
def stratified_split(spark, sf):
    return sampling.stratified_split(views.truth(spark, sf), LABELS).select("review_id", "split")


@query
def group_kfold(spark, sf):
    return sampling.group_kfold(views.reviews(spark, sf).select("review_id", "business_id"))


@query
def random_kfold(spark, sf):
    return sampling.random_kfold(views.reviews(spark, sf).select("review_id"))


@query
def class_weights(spark, sf):
    return rounded(sampling.class_weights(views.truth(spark, sf), LABELS), "weight_0", "weight_1")


@query
def pos_weight(spark, sf):
    return rounded(sampling.pos_weight(views.truth(spark, sf), LABELS), "pos_weight")


@query
def scale_features(spark, sf):
    r = feats.add_meta_features(views.reviews(spark, sf).select("review_id", "review_text"))
    scales = modeling.column_scales(r, feats.META_FEATURES)
    out = modeling.scale_features(r.drop("review_text"), scales)
    return rounded(out, *feats.META_FEATURES)


def _training(spark, sf):
    return views.reviews(spark, sf).join(views.truth(spark, sf), "review_id")


def _nonzero(df, column):
    x = F.unwrap_udt(column)
    length = F.aggregate(x["values"], F.lit(0.0), lambda acc, v: acc + v * v)
    out = df.select("review_id", F.size(x["indices"]).alias("nonzero"), length.alias("squared_length"))
    return rounded(out, "squared_length")


@query
def tfidf_features(spark, sf):
    rows = modeling.add_grams(_texts(spark, sf))
    scorer = modeling.ReviewScorer(modeling.fit_tfidf(rows), {}, {})
    return _nonzero(scorer.vectorize(rows), "tfidf")


@query
def assemble_features(spark, sf):
    rows = modeling.add_grams(modeling.add_keep(_texts(spark, sf)))
    meta = [c for c in rows.columns if c.startswith("_meta_")]
    scales = modeling.column_scales(rows, meta)
    scorer = modeling.ReviewScorer(modeling.fit_tfidf(rows, min_df=2), {}, scales)
    return _nonzero(scorer.vectorize(rows), "features")


@query
def lr_score(spark, sf):
    data = materialize(_training(spark, sf), "training")
    scorer = modeling.train_scorer(data)
    return scorer.score(data).select("review_id", *SCORES)


def _sound(report, *by):
    """What SQL can tell of a report: its support, and that its measures are shares."""
    shares = [F.col(c).between(0, 1) for c in ("precision", "recall", "f1")]
    return report.select(*by, "label", "support", (shares[0] & shares[1] & shares[2]).alias("in_range"))


@query
def lr_one_vs_rest(spark, sf):
    """At the optimum of a class-balanced fit with a free intercept, the mean score of the one class is
    what the mean score of the other lacks to 1: the gap is 0."""
    data = materialize(_training(spark, sf), "training")
    scored = modeling.train_scorer(data).score(data)
    rows = [F.struct(F.lit(label).alias("label"), F.col(label).alias("y"), F.col(p).alias("p")) for label, p in zip(LABELS, SCORES)]
    long = scored.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    low, high = F.avg(F.when(F.col("y") == 0, F.col("p"))), F.avg(F.when(F.col("y") == 1, 1 - F.col("p")))
    return long.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"),
        F.round(F.abs(low - high), 3).alias("gap"), F.max(~F.col("p").between(0, 1)).alias("out_of_range"))


@query
def holdout_eval(spark, sf):
    data = materialize(sampling.stratified_split(_training(spark, sf), LABELS), "training")
    return modeling.holdout_eval(data)[1]


@query
def holdout_support(spark, sf):
    return _sound(holdout_eval(spark, sf))


@query
def group_cv(spark, sf):
    data = materialize(sampling.group_kfold(_training(spark, sf)), "training")
    decided, _ = modeling.group_cv(data, 5)
    return metrics.label_report(decided, PAIRS, ["fold"])


@query
def group_cv_support(spark, sf):
    return _sound(group_cv(spark, sf), "fold")


@query
def score_table(spark, sf):
    r = views.reviews(spark, sf).select("review_id")
    return ensemble.attach_scores(r, views.scores(spark, sf))


# ---- ensemble -------------------------------------------------------------------------------


@query
def threshold_decide(spark, sf):
    found = sinks.thresholds_table(spark, TUNED)
    return ensemble.threshold_decide(views.scores(spark, sf), found).drop(*SCORES)


def _mode(mode):
    def run(spark, sf):
        out = ensemble.combine(_ruled_and_scored(spark, sf), mode, TUNED)
        return out.select("review_id", *LABELS, "label_relevant", "prob_irrelevant")
    return run


QUERIES["ens_precision"] = _mode("precision")
QUERIES["ens_recall"] = _mode("recall")
QUERIES["ens_balanced"] = _mode("balanced")
QUERIES["ens_rules_only"] = _mode("rules")
QUERIES["ens_model_only"] = _mode("model")


@query
def ens_reasons(spark, sf):
    return ensemble.ensemble_reasons(_ruled_and_scored(spark, sf), "precision", TUNED).select(
        "review_id", "reasons")


@query
def ens_score_note(spark, sf):
    ruled = rules.render_reasons(_ruled_and_scored(spark, sf))
    return ensemble.score_note(ruled, "tr").select("review_id", "reasons")


@query
def ens_output(spark, sf):
    return jobs.predict_job(views.reviews(spark, sf), views.scores(spark, sf), "recall", TUNED)


# ---- evaluation and thresholds --------------------------------------------------------------


@query
def confusion_counts(spark, sf):
    return metrics.confusion_counts(_predictions(spark, sf), PAIRS)


@query
def label_report(spark, sf):
    return rounded(metrics.label_report(_predictions(spark, sf), PAIRS), "precision", "recall", "f1")


@query
def avg_report(spark, sf):
    return rounded(metrics.avg_report(_predictions(spark, sf), PAIRS), "precision", "recall", "f1")


@query
def single_label_report(spark, sf):
    return rounded(metrics.single_label_report(_predictions(spark, sf), PAIRS[1]),
                   "precision", "recall", "f1")


@query
def fold_macro(spark, sf):
    fold = views.reviews(spark, sf).select(
        "review_id", cells.md5_bucket(F.col("business_id"), 5).alias("fold"))
    joined = _predictions(spark, sf).join(fold, "review_id")
    return rounded(metrics.fold_macro(joined, PAIRS), "precision", "recall", "f1")


@query
def error_slice(spark, sf):
    r = views.reviews(spark, sf)
    joined = _predictions(spark, sf).join(r, "review_id")
    context = [*clean.pick_context(r.columns), *LABELS]
    return metrics.error_slice(joined, PAIRS, context)


@query
def error_slice_all(spark, sf):
    return metrics.error_slice(_predictions(spark, sf), PAIRS, ["review_id"], all_labels=True)


@query
def resolve_pred_suffix(spark, sf):
    """Predictions whose columns end in ``_pred``."""
    hats = views.scores(spark, sf).select(
        "review_id", *[(F.col(f"{t}_p") >= 0.5).cast("int").alias(f"label_{t}_pred") for t in TASKS])
    joined, pairs = evaluate.align_predictions(views.truth(spark, sf), hats)
    return metrics.confusion_counts(joined, pairs)


@query
def rules_baseline_report(spark, sf):
    """The rules against truth on all four labels."""
    ruled = _ruled(spark, sf).select("review_id", *[F.col(t).alias(f"label_{t}_hat") for t in (*TASKS, "relevant")])
    joined = views.truth(spark, sf).join(ruled, "review_id")
    names = [f"label_{t}" for t in (*TASKS, "relevant")]
    report = metrics.label_report(joined, [metrics.Pair(c, c, f"{c}_hat") for c in names])
    return rounded(report, "precision", "recall", "f1")


@query
def fold_reports(spark, sf):
    """The report of each fold, not only their average."""
    fold = views.reviews(spark, sf).select(
        "review_id", cells.md5_bucket(F.col("business_id"), 5).alias("fold"))
    joined = _predictions(spark, sf).join(fold, "review_id")
    return rounded(metrics.label_report(joined, PAIRS, ["fold"]), "precision", "recall", "f1")


@query
def toxicity_report(spark, sf):
    """Rants against the given toxicity labels, on the reviews that have one."""
    truth = views.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("review_id"), F.col("toxic").alias("label_toxic"))
    hats = _texts(spark, sf).select("review_id", rules.rant_hit(tx.norm_rules(F.col("review_text"))).cast("int").alias("label_toxic_hat"))
    pair = metrics.Pair("label_toxic", "label_toxic", "label_toxic_hat")
    return rounded(metrics.label_report(truth.join(hats, "review_id"), [pair]), "precision", "recall", "f1")


@query
def evaluate_predictions(spark, sf):
    """The rules baseline judged against truth, end to end."""
    preds = _ruled(spark, sf).select("review_id", *TASKS)
    report = jobs.evaluate_job(views.truth(spark, sf), preds).labels
    return rounded(report, "precision", "recall", "f1")


@query
def tune_rules_or_ml(spark, sf):
    df = _ruled_and_scored(spark, sf).join(views.truth(spark, sf), "review_id")
    best = thresholds.tune_rules_or_ml(df, {t: f"label_{t}" for t in TASKS})
    return rounded(best, "thr", "f1")


@query
def rules_or_ml_curve(spark, sf):
    df = _ruled_and_scored(spark, sf).join(views.truth(spark, sf), "review_id")
    curve = thresholds.rules_or_ml_curve(df, {t: f"label_{t}" for t in TASKS})
    return rounded(curve, "thr", "f1")


@query
def tune_oof(spark, sf):
    return rounded(thresholds.tune_oof(_oof(spark, sf)), "thr", "f1")


@query
def oof_curve(spark, sf):
    return rounded(thresholds.oof_curve(_oof(spark, sf)), "thr", "f1")


# ---- result views and the stream ------------------------------------------------------------


@query
def search_reviews(spark, sf):
    return result_views.search_reviews(_texts(spark, sf), "IPHONE").select("review_id", "biz_name")


def _published(spark, sf):
    keep = ("review_id", "biz_name", "biz_cats", "review_text")
    return ensemble.combine(_ruled_and_scored(spark, sf, keep), "precision", TUNED)


@query
def flagged_only(spark, sf):
    return result_views.flagged_only(_published(spark, sf)).select("review_id", *LABELS)


@query
def sort_by_prob(spark, sf):
    out = result_views.sort_by_prob(_published(spark, sf))
    return out.select("review_id", "prob_irrelevant")


@query
def top_by_prob(spark, sf):
    scored = views.scores(spark, sf)
    return result_views.sort_by_prob(scored, "irrelevant_p", 50).select("review_id", "irrelevant_p")


@query
def prob_histogram(spark, sf):
    return rounded(result_views.prob_histogram(views.scores(spark, sf), "irrelevant_p"), "bin")


@query
def stream_label(spark, sf):
    r = views.reviews(spark, sf)
    arriving = r.select("review_id", "business_id", "review_text").repartition(32)
    source = _stage(arriving, "parquet", "arriving")
    businesses = materialize(
        r.select("business_id", *stream.BUSINESS_COLUMNS).distinct(), "businesses")
    reviews = stream.read_reviews(spark, source, arriving.schema, max_files=16)
    out = fresh_path(spark, "labels")
    labels = stream.label_stream(reviews, businesses)
    run = stream.write_labels(labels, out, fresh_path(spark, "stream-checkpoint"))
    run.awaitTermination()
    back = spark.read.schema(labels.schema).parquet(out)
    return rounded(back.select("review_id", *TASKS, "cosine_to_business", "reasons"),
                   "cosine_to_business")


@query
def stream_label_batches(spark, sf):
    r = views.reviews(spark, sf)
    arriving = r.select("review_id", "business_id", "review_text").repartition(32)
    source = _stage(arriving, "parquet", "arriving")
    businesses = materialize(
        r.select("business_id", *stream.BUSINESS_COLUMNS).distinct(), "businesses")
    reviews = stream.read_reviews(spark, source, arriving.schema, max_files=16)
    out = fresh_path(spark, "labels")
    stream.label_batches(reviews, businesses, out, fresh_path(spark, "stream-checkpoint")).awaitTermination()
    back = spark.read.parquet(out)
    return rounded(back.select("review_id", *TASKS, "cosine_to_business", "reasons"),
                   "cosine_to_business")
