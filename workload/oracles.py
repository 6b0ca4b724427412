"""The same questions in DuckDB's SQL, written independently of the Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence

from plumbline.operators.thresholds import COSINE_GRID, ENSEMBLE_GRID, OOF_GRID
from plumbline.policy import DEFAULT_POLICY
from workload.views import LIGATURE, REVIEWS, SCORES, TRUTH

SPACES = (
    r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
TASKS = ("ads", "irrelevant", "rant_no_visit")
TUNED = {"ads": 0.4, "irrelevant": 0.55, "rant_no_visit": 0.5}


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(by)}, 'g')"


def squash(x: str) -> str:
    return f"trim({sub(x, f'[{SPACES}]+', ' ')}, ' ')"


def strip(x: str) -> str:
    return sub(x, f"^[{SPACES}]+|[{SPACES}]+$", "")


def compose(x: str) -> str:
    """The only characters in the tables that composition changes."""
    return f"replace(coalesce({x}, ''), {quote(LIGATURE)}, 'fi')"


def norm_clean(x: str) -> str:
    return squash(sub(compose(x), r"[\x{200B}-\x{200D}\x{FEFF}]", ""))


def norm_ingest(x: str) -> str:
    return squash(sub(f"coalesce({x}, '')", r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", ""))


def norm_rules(x: str) -> str:
    text = f"lower({squash(sub(compose(x), r'[\x{200B}-\x{200D}\x{2060}\x{FEFF}]', ''))})"
    for a, b in (("[dot]", "."), ("(dot)", "."), (" d0t ", "."), (" dot ", ".")):
        text = f"replace({text}, {quote(a)}, {quote(b)})"
    return text


def ratio(x: str, y: str) -> str:
    return f"CASE WHEN ({y}) = 0 THEN 0.0 ELSE CAST({x} AS DOUBLE) / ({y}) END"


def grams(tokens: str) -> str:
    pairs = (
        f"list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1])"
    )
    return f"list_concat({tokens}, {pairs})"


def whole_words(text: str, phrases: Sequence[str]) -> str:
    """Regex engines without look-around: the neighbours are consumed instead."""
    parts = []
    for p in phrases:
        left = f"(?:^|{NOT_WORD})" if p[0].isalnum() else WORD
        right = f"(?:$|{NOT_WORD})" if p[-1].isalnum() else WORD
        parts.append(left + p + right)
    return f"regexp_matches({text}, {quote('|'.join(parts))})"


def shape(x: str) -> str:
    """Letters outside ASCII become x and spaces become plain, so that ASCII classes suffice."""
    return sub(sub(sub(x, r"[^\x00-\x7F\PL]", "x"), f"[{SPACES}]", " "), r"[^\x00-\x7F]", "#")


PHONE = r"\+?[0-9][0-9 ().-]{7,}"
NARROW_PHONE = r"\+?[0-9][0-9 -]{7,}"

ADS = " OR ".join([
    r"regexp_matches(t, 'https?://[^ ]|www\.[\p{L}\p{N}_.-]')",
    f"regexp_matches({shape('t')}, {quote(r'\b' + PHONE + r'\b')})",
    whole_words("t", DEFAULT_POLICY.keywords),
])
RANT = whole_words("t", DEFAULT_POLICY.cues)
OFFTOPIC = " OR ".join(
    f"(contains(cats, {quote(k)}) AND {whole_words('t', ws)})"
    for k, ws in DEFAULT_POLICY.off_topic.items()
)

MD5_NUMBER = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "reviews_v": ((), REVIEWS),
    "truth_v": ((), TRUTH),
    "scores_v": ((), SCORES),
    "norm_v": (("reviews_v",), f"""
        SELECT review_id, {norm_rules('review_text')} AS t, {norm_rules('biz_cats')} AS cats,
               trim({norm_rules('biz_name')} || ' ' || {norm_rules('biz_cats')} || ' '
                    || {norm_rules('biz_desc')}) AS biz
        FROM reviews_v"""),
    "docs_v": (("norm_v",), rf"""
        SELECT review_id, side, {grams('tokens')} AS terms FROM (
          SELECT review_id, 0 AS side, regexp_extract_all(t, '{WORD}{{2,}}') AS tokens FROM norm_v
          UNION ALL
          SELECT review_id, 1, regexp_extract_all(biz, '{WORD}{{2,}}') FROM norm_v)"""),
    "tf_v": (("docs_v",), """
        SELECT review_id, side, term, count(*) AS cnt
        FROM (SELECT review_id, side, unnest(terms) AS term FROM docs_v) GROUP BY ALL"""),
    "idf_v": (("tf_v", "reviews_v"), """
        SELECT term, count(*) AS df,
               ln((1.0 + 2 * (SELECT count(*) FROM reviews_v)) / (1.0 + count(*))) + 1.0 AS idf
        FROM tf_v GROUP BY term"""),
    "cos_v": (("tf_v", "idf_v", "reviews_v"), """
        SELECT r.review_id, coalesce(c.c, 0.0) AS cosine FROM reviews_v r LEFT JOIN (
          SELECT n.review_id, coalesce(d.dot, 0.0) / (sqrt(n.a) * sqrt(n.b)) AS c
          FROM (SELECT review_id, sum(CASE WHEN side = 0 THEN cnt * cnt * idf * idf END) AS a,
                       sum(CASE WHEN side = 1 THEN cnt * cnt * idf * idf END) AS b
                FROM tf_v JOIN idf_v USING (term) GROUP BY review_id) n
          LEFT JOIN (SELECT x.review_id, sum(x.cnt * y.cnt * idf * idf) AS dot
                     FROM tf_v x JOIN tf_v y ON x.review_id = y.review_id AND x.term = y.term
                     JOIN idf_v i ON i.term = x.term WHERE x.side = 0 AND y.side = 1
                     GROUP BY x.review_id) d USING (review_id)
          WHERE n.a IS NOT NULL AND n.b IS NOT NULL) c USING (review_id)"""),
    "pair_v": (("tf_v", "reviews_v"), """
        SELECT r.review_id, coalesce(c.c, 0.0) AS cosine FROM reviews_v r LEFT JOIN (
          SELECT review_id, sum(a * b) / (sqrt(sum(a * a * w * w)) * sqrt(sum(b * b * w * w))) AS c
          FROM (SELECT review_id, term, CASE WHEN count(*) = 2 THEN 1.0 ELSE ln(1.5) + 1.0 END AS w,
                       coalesce(sum(cnt) FILTER (side = 0), 0) AS a,
                       coalesce(sum(cnt) FILTER (side = 1), 0) AS b
                FROM tf_v GROUP BY review_id, term)
          GROUP BY review_id HAVING sum(a) > 0 AND sum(b) > 0) c USING (review_id)"""),
}
for scope in ("cos", "pair"):
    CTES["rules_v" if scope == "cos" else "rules_pair_v"] = (("norm_v", f"{scope}_v"), f"""
        SELECT *, 1 - irrelevant AS relevant, concat_ws('; ',
                 CASE WHEN ads = 1 THEN 'ads: url/phone/promo' END,
                 CASE WHEN rant_no_visit = 1 THEN 'rant_no_visit: cue' END,
                 CASE WHEN irrelevant = 1 THEN 'irrelevant: cosine<0.25' END) AS reasons
        FROM (SELECT review_id, cosine, CAST(({OFFTOPIC}) AS INTEGER) AS offtopic,
                     CAST(({ADS}) AS INTEGER) AS ads, CAST(({RANT}) AS INTEGER) AS rant_no_visit,
                     CAST((cosine < 0.25 OR {OFFTOPIC}) AS INTEGER) AS irrelevant
              FROM norm_v JOIN {scope}_v USING (review_id))""")
CTES["both_v"] = (("rules_v", "scores_v"), "SELECT * FROM rules_v JOIN scores_v USING (review_id)")
CTES["fold_v"] = (("reviews_v",), f"""
    SELECT review_id, CAST({MD5_NUMBER.format('business_id')} % 5 AS INTEGER) AS fold
    FROM reviews_v""")
CTES["oof_v"] = (("truth_v", "scores_v", "fold_v"), " UNION ALL ".join(
    f"SELECT review_id, fold, '{t}' AS label, label_{t} AS y, {t}_p AS p FROM truth_v "
    "JOIN scores_v USING (review_id) JOIN fold_v USING (review_id)" for t in TASKS))
CTES["hats_v"] = (("truth_v", "scores_v"), f"""
    SELECT truth_v.*, {', '.join(f'CAST({t}_p >= 0.5 AS INTEGER) AS hat_{t}' for t in TASKS)}
    FROM truth_v JOIN scores_v USING (review_id)""")


def long_form(source: str, hat: str, extra: str = "") -> str:
    """Rows ``(label, y, h)`` of the three tasks."""
    return " UNION ALL ".join(
        f"SELECT {extra} 'label_{t}' AS label, label_{t} AS y, {hat.format(t)} AS h FROM {source}"
        for t in TASKS)


CELLS = """CAST(sum(CASE WHEN y = 0 AND h = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
           CAST(sum(CASE WHEN y = 0 AND h = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
           CAST(sum(CASE WHEN y = 1 AND h = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
           CAST(sum(CASE WHEN y = 1 AND h = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp"""
PRF = f"""{ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall,
          {ratio('2 * tp', '2 * tp + fp + fn')} AS f1, tp + fn AS support"""
CTES["cells_v"] = (("hats_v",), f"""
    SELECT label, {CELLS} FROM ({long_form('hats_v', 'hat_{}')}) GROUP BY label""")
CTES["report_v"] = (("cells_v",), f"SELECT label, {PRF}, tp, fp, fn FROM cells_v")
SHOW = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


def with_ctes(sql: str, *roots: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for root in roots:
        visit(root)
    head = ", ".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    return f"WITH {head} {sql}"


ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, *roots: str) -> None:
    ORACLES[name] = with_ctes(sql, *roots)


# ---- sources and sinks ----------------------------------------------------------------------

oracle("scan_reviews", f"""
    SELECT review_id, {', '.join(f"{strip(f"coalesce({c}, '')")} AS {c}" for c in
           ('review_text', 'biz_name', 'biz_cats', 'biz_desc'))}, coalesce(stars, 0) AS stars
    FROM reviews_v""", "reviews_v")
oracle("scan_typed", """
    SELECT review_id, CASE WHEN stars = 5 THEN NULL ELSE stars END AS stars, time_ms, lat,
           CAST(NULL AS VARCHAR) AS price, CAST(NULL AS INTEGER) AS label_ads,
           CAST(NULL AS VARCHAR) AS reasons FROM reviews_v""", "reviews_v")
oracle("scan_jsonl", """
    SELECT business_id, CASE WHEN CAST(review_id AS BIGINT) % 3 = 0 THEN 'v' ELSE 'u' END
           || review_id AS user_id, review_text AS text, CAST(stars AS VARCHAR) AS rating,
           CAST(time_ms AS VARCHAR) AS time FROM reviews_v""", "reviews_v")
oracle("union_shards", """
    SELECT review_id, business_id, state, CASE WHEN state <> 'TX' THEN price END AS price
    FROM reviews_v""", "reviews_v")
oracle("scan_pruned", """
    SELECT review_text, biz_name, biz_cats, business_id, label_irrelevant
    FROM reviews_v JOIN truth_v USING (review_id)""", "reviews_v", "truth_v")
oracle("sink_table", """
    SELECT state, count(*) AS n, CAST(sum(time_ms) AS BIGINT) AS time_sum,
           CAST(sum(length(review_text)) AS BIGINT) AS chars FROM reviews_v GROUP BY state""",
       "reviews_v")
oracle("oof_store", "SELECT review_id, fold, label, y, p FROM oof_v", "oof_v")
oracle("cap_rows", "SELECT review_id, business_id FROM reviews_v ORDER BY review_id LIMIT 100",
       "reviews_v")


def grid_values(grid: Sequence[float]) -> str:
    return "(VALUES " + ", ".join(f"(CAST({g!r} AS DOUBLE))" for g in grid) + ") AS g(thr)"


def curve(source: str, flagged: str, grid: Sequence[float]) -> str:
    return f"""
        SELECT label, thr, tp, fp, fn, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (
          SELECT label, thr, {CELLS} FROM (
            SELECT label, thr, y, CASE WHEN {flagged} THEN 1 ELSE 0 END AS h
            FROM {source}, {grid_values(grid)}) GROUP BY label, thr)"""


def best(curve_sql: str) -> str:
    return f"""SELECT label, thr, f1 FROM (SELECT *, row_number() OVER
               (PARTITION BY label ORDER BY f1 DESC, thr) AS rn FROM ({curve_sql})) WHERE rn = 1"""


OOF_CURVE = curve("oof_v", "p >= thr", OOF_GRID)
BEST_OOF = best(OOF_CURVE)
oracle("thresholds_table", f"""
    SELECT task AS label, coalesce(b.thr, 0.5) AS thr
    FROM (VALUES ('ads'), ('irrelevant'), ('rant_no_visit')) AS t(task)
    LEFT JOIN ({BEST_OOF}) b ON b.label = task""", "oof_v")

# ---- cleaning and keys ----------------------------------------------------------------------

for name, form in (("norm_rules", norm_rules), ("norm_clean", norm_clean),
                   ("norm_ingest", norm_ingest)):
    oracle(name, f"SELECT review_id, {form('review_text')} AS t FROM reviews_v", "reviews_v")
oracle("null_words", """
    SELECT review_id, CASE WHEN CAST(review_id AS BIGINT) % 6 < 4 THEN ''
                           ELSE review_text END AS t FROM reviews_v""", "reviews_v")
oracle("coerce_stars", """
    SELECT review_id, s AS stars, greatest(0, least(5, s)) AS stars_clipped FROM (
      SELECT review_id, CASE CAST(review_id AS BIGINT) % 7 WHEN 0 THEN 4 WHEN 1 THEN 0 WHEN 2 THEN 9
             WHEN 3 THEN -1 WHEN 4 THEN 0 ELSE coalesce(stars, 0) END AS s FROM reviews_v)""",
       "reviews_v")
oracle("coerce_label", """
    SELECT review_id, CASE CAST(review_id AS BIGINT) % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0
           WHEN 3 THEN 1 ELSE least(coalesce(stars, 0), 1) END AS y FROM reviews_v""", "reviews_v")
oracle("keep_english", """
    SELECT review_id, CASE WHEN lang = 'en' THEN lang END AS lang FROM reviews_v
    WHERE lang IN ('en', 'de')""", "reviews_v")
oracle("dedup_reviews", """
    SELECT review_id, business_id, review_text, stars FROM (
      SELECT *, row_number() OVER (PARTITION BY business_id, review_text ORDER BY review_id) AS rn
      FROM reviews_v) WHERE rn = 1""", "reviews_v")
oracle("hash_business_id", """
    SELECT review_id, substr(md5(biz_name), 1, 12) AS business_id FROM reviews_v""", "reviews_v")
oracle("uuid5_review_id", """
    SELECT review_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
           || substr('89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1)
           || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
    FROM (SELECT review_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(
            CASE WHEN city = 'City de' THEN 'u' ELSE city END || '_' || business_id || '_'
            || coalesce(CAST(time_ms AS VARCHAR), 't'))) AS h FROM reviews_v)""", "reviews_v")


def content_key(*parts: str) -> str:
    cells = [f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts]
    return "md5(" + " || ".join(f"length({c}) || ':' || {c}" for c in cells) + ")"


oracle("synthesize_id", f"""
    SELECT {content_key('business_id', 'review_text', 'time_ms', 'k')} AS review_id, business_id, time_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY business_id, review_text, time_ms) AS k
          FROM (SELECT business_id, review_text, time_ms FROM reviews_v
                UNION ALL SELECT business_id, review_text, time_ms FROM reviews_v))""", "reviews_v")
oracle("synthesized_ids_differ", """
    SELECT 2 * count(*) AS n_rows, 2 * count(*) AS n_keys FROM reviews_v""", "reviews_v")
oracle("dedup_null_keys", """
    SELECT review_id, business_id, state, stars FROM (
      SELECT *, row_number() OVER (PARTITION BY business_id, state
                                   ORDER BY review_id NULLS LAST, stars NULLS FIRST) AS rn
      FROM (SELECT CASE WHEN stars % 3 = 0 THEN review_id END AS review_id, business_id, state, stars
            FROM reviews_v)) WHERE rn = 1""", "reviews_v")
oracle("map_source_schema", f"""
    SELECT {content_key('biz_name', 'city', 'review_text', 'stars + 2')} AS review_id,
           substr(md5(biz_name), 1, 12) AS business_id, {norm_clean('biz_name')} AS biz_name,
           'Restaurant' AS biz_cats, '' AS biz_desc, {norm_clean('review_text')} AS review_text,
           least(coalesce(stars + 2, 0), 5) AS stars, city AS author_name, state AS rating_category
    FROM reviews_v""", "reviews_v")
NULL_TEXT = {c: f"CAST(NULL AS VARCHAR) AS {c}" for c in (
    "business_id", "biz_name", "biz_cats", "biz_desc", "review_text", "state", "city")}
oracle("ensure_columns", f"""
    SELECT review_id, {', '.join(NULL_TEXT.values())}, stars, CAST(NULL AS BIGINT) AS time_ms,
           CAST(NULL AS FLOAT) AS lat, CAST(NULL AS FLOAT) AS lon, price, lang FROM reviews_v""",
       "reviews_v")
oracle("normalize_upload", """
    SELECT review_text, CASE WHEN stars > 2 THEN biz_name ELSE '' END AS biz_name,
           '' AS biz_cats, '' AS business_id FROM reviews_v""", "reviews_v")
oracle("first_truthy", """
    SELECT review_id, coalesce(CASE WHEN n % 3 = 1 THEN state END, price, city) AS place,
           CASE WHEN n % 4 <> 0 THEN CAST(n % 4 AS VARCHAR)
                WHEN stars <> 0 THEN CAST(stars AS VARCHAR) END AS lat
    FROM (SELECT *, CAST(review_id AS BIGINT) AS n FROM reviews_v)""", "reviews_v")
oracle("join_categories", """
    SELECT review_id, CASE WHEN stars > 1 THEN biz_cats ELSE '' END AS cats FROM reviews_v""",
       "reviews_v")
oracle("text_template", """
    SELECT review_id,
           review_text || ' [SEP] ' || biz_name || ' ' || biz_cats || ' ' || biz_desc AS long_form,
           review_text || ' [SEP] ' || biz_name || ' | ' || biz_cats AS short_form
    FROM reviews_v""", "reviews_v")
oracle("nonempty_text", "SELECT review_id, review_text FROM reviews_v WHERE review_text <> ''",
       "reviews_v")
oracle("check_labels", """
    SELECT review_id, label_relevant, label_irrelevant FROM truth_v
    WHERE label_relevant = label_irrelevant""", "truth_v")
oracle("repair_labels", """
    SELECT review_id, 1 - label_irrelevant AS label_relevant, label_irrelevant FROM truth_v""",
       "truth_v")
oracle("derive_relevant", """
    SELECT review_id, label_irrelevant, 1 - label_irrelevant AS label_relevant FROM truth_v""",
       "truth_v")
oracle("fill_null_text", """
    SELECT review_id, CASE WHEN stars > 2 THEN review_text ELSE '' END AS review_text, biz_name,
           price FROM reviews_v""", "reviews_v")
oracle("tag_state", "SELECT review_id, 'WA' AS state, state AS untagged FROM reviews_v", "reviews_v")
oracle("pick_context", """
    SELECT review_id, business_id AS place_id, biz_name AS name, biz_cats AS category,
           review_text AS comment FROM reviews_v""", "reviews_v")

# ---- joins ----------------------------------------------------------------------------------

oracle("enrich_business", f"""
    SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
           || substr('89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1)
           || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS review_id,
           business_id, 'Shop v2 ' || item_id AS biz_name,
           CASE WHEN item_id % 2 = 0 THEN 'Park, Outdoor' ELSE 'Spa, Wellness' END AS biz_cats,
           {norm_ingest('b.text')} AS biz_desc, {norm_ingest('review_text')} AS review_text,
           coalesce(stars, 0) AS stars, time_ms, 'ZZ' AS state, '' AS city,
           CAST(CASE WHEN item_id <> 0 THEN item_id END AS FLOAT) AS lat, CAST(NULL AS FLOAT) AS lon,
           '2' AS price
    FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(
            CASE WHEN CAST(review_id AS BIGINT) % 3 = 0 THEN 'v' ELSE 'u' END || review_id || '_'
            || business_id || '_' || coalesce(CAST(time_ms AS VARCHAR), 't'))) AS h
          FROM reviews_v) r
    JOIN benchmark b ON b.item_id = CAST(substr(business_id, 4) AS INTEGER)""", "reviews_v")
oracle("join_truth_preds", """
    SELECT review_id, t.label_ads AS label_ads_gt, label_irrelevant,
           CAST(ads_p >= 0.5 AS INTEGER) AS label_ads_pred, irrelevant_p
    FROM truth_v t JOIN scores_v USING (review_id)""", "truth_v", "scores_v")
oracle("align_outputs", """
    SELECT review_id, business_id, ads, irrelevant, rant_no_visit,
           round(cosine, 6) AS cosine_to_business, ads_p, irrelevant_p, rant_no_visit_p
    FROM both_v JOIN reviews_v USING (review_id)""", "both_v", "reviews_v")
oracle("resolve_pred_columns", f"SELECT label, {SHOW}, support FROM report_v", "report_v")
oracle("autolabel_truth", """
    SELECT review_id, ads AS label_ads, irrelevant AS label_irrelevant,
           rant_no_visit AS label_rant_no_visit FROM rules_v""", "rules_v")

# ---- rules ----------------------------------------------------------------------------------

for name, hit in {
    "url_hit": r"regexp_matches(t, 'https?://[^ ]|www\.[\p{L}\p{N}_.-]')",
    "phone_hit": f"regexp_matches({shape('t')}, {quote(r'\b' + PHONE + r'\b')})",
    "keyword_hit": whole_words("t", DEFAULT_POLICY.keywords),
    "ads_label": f"({ADS})",
    "rant_label": RANT,
    "offtopic_hit": f"({OFFTOPIC})",
}.items():
    oracle(name, f"SELECT review_id, CAST({hit} AS INTEGER) AS hit FROM norm_v", "norm_v")


def word_runs(text: str, source: str, key: str) -> str:
    """Runs of two to eight words with single spaces between them."""
    spaced = f"string_split(regexp_replace({text}, '([^\\p{{L}}\\p{{N}}_ ])', ' | ', 'g'), ' ')"
    runs, run = [], "x"
    for n in range(2, 9):
        run += f" || ' ' || lead(x, {n - 1}) OVER o"
        runs.append(f"{run} AS r{n}")
    pick = "[" + ", ".join(f"{{'n': {n}, 'p': r{n}}}" for n in range(2, 9)) + "]"
    return f"""SELECT DISTINCT {key}, u.n AS n, u.p AS p FROM (
        SELECT {key}, unnest({pick}) AS u FROM (
          SELECT {key}, {", ".join(runs)} FROM (
            SELECT {key}, i, CASE WHEN x NOT IN ('', '|') THEN x END AS x FROM (
              SELECT {key}, unnest(w) AS x, unnest(range(len(w))) AS i
              FROM (SELECT {key}, {spaced} AS w FROM {source})))
          WINDOW o AS (PARTITION BY {key} ORDER BY i)))
      WHERE u.p IS NOT NULL"""


oracle("phrase_policy", f"""
    SELECT review_id, count(*) FILTER (kind = 0 AND p IS NOT NULL) AS ads_phrases,
           count(*) FILTER (kind = 1) AS rant_phrases,
           count(*) FILTER (kind = 2 AND contains(
             cats, (['restaurant', 'spa', 'electronics', 'park'])[1 + n % 4])) AS offtopic_phrases
    FROM norm_v LEFT JOIN (
      SELECT r.review_id, r.n, r.p, length(r.p) % 3 AS kind
      FROM ({word_runs("t", "norm_v", "review_id")}) r
      SEMI JOIN ({word_runs("lower(text)", "benchmark", "item_id")}) b ON r.p = b.p) USING (review_id)
    GROUP BY review_id""", "norm_v")
oracle("phrase_policy_default", f"""
    SELECT review_id, CAST({whole_words("t", DEFAULT_POLICY.keywords)} AS INTEGER) AS hit_ads,
           CAST({RANT} AS INTEGER) AS hit_rant, CAST(({OFFTOPIC}) AS INTEGER) AS hit_offtopic
    FROM norm_v""", "norm_v")
oracle("irrelevant_label", "SELECT review_id, irrelevant, offtopic FROM rules_v", "rules_v")
for name, view in (("rules_label", "rules_v"), ("rules_label_pair", "rules_pair_v")):
    oracle(name, f"""
        SELECT review_id, ads, irrelevant, rant_no_visit, relevant,
               round(cosine, 6) AS cosine_to_business FROM {view}""", view)
oracle("rules_label_duplicates", """
    SELECT 'k' || CAST(CAST(review_id AS BIGINT) // 2 AS VARCHAR) AS review_id, review_id AS row_name,
           ads, irrelevant, rant_no_visit, round(cosine, 6) AS cosine_to_business FROM rules_v""",
       "rules_v")
oracle("rule_reasons", "SELECT review_id, reasons FROM rules_v", "rules_v")
oracle("rule_hit_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS label, CAST(sum({t}) AS BIGINT) AS count FROM rules_v" for t in TASKS),
       "rules_v")
oracle("pseudo_label", """
    SELECT review_id, business_id, biz_name, biz_cats, biz_desc, review_text, stars, time_ms, state,
           city, lat, lon, price, ads AS label_ads, irrelevant AS label_irrelevant,
           rant_no_visit AS label_rant_no_visit, round(cosine, 6) AS cosine_to_business, reasons
    FROM reviews_v JOIN rules_v USING (review_id)""", "rules_v", "reviews_v")
oracle("flagged_per_business", f"""
    SELECT business_id, count(*) AS n_reviews,
           CAST(sum(CASE WHEN {ADS} THEN 1 ELSE 0 END) AS BIGINT) AS n_ads,
           CAST(sum(CASE WHEN {RANT} THEN 1 ELSE 0 END) AS BIGINT) AS n_rants
    FROM norm_v JOIN reviews_v USING (review_id) GROUP BY business_id""", "norm_v", "reviews_v")

MAPPED = f"""
    SELECT * FROM (SELECT *, row_number() OVER
                     (PARTITION BY business_id, review_text ORDER BY review_id) AS rn FROM (
      SELECT {content_key('biz_name', 'city', 'review_text', 'stars + 2')} AS review_id,
             substr(md5(biz_name), 1, 12) AS business_id, {norm_clean('biz_name')} AS biz_name,
             'Restaurant' AS biz_cats, '' AS biz_desc, {norm_clean('review_text')} AS review_text,
             least(coalesce(stars + 2, 0), 5) AS stars FROM ({REVIEWS}))) WHERE rn = 1"""
oracle("preprocess_restaurants", """
    SELECT review_id, business_id, biz_name, biz_cats, biz_desc, review_text, stars,
           ads AS label_ads, irrelevant AS label_irrelevant, rant_no_visit AS label_rant_no_visit,
           relevant AS label_relevant, round(cosine, 6) AS cosine_to_business, reasons
    FROM reviews_v JOIN rules_v USING (review_id)""", "rules_v", "reviews_v")
ORACLES["preprocess_restaurants"] = ORACLES["preprocess_restaurants"].replace(
    f"reviews_v AS MATERIALIZED ({REVIEWS})", f"reviews_v AS MATERIALIZED ({MAPPED})")

# ---- similarity -----------------------------------------------------------------------------

oracle("word_ngrams", """
    SELECT review_id, term, CAST(cnt AS INTEGER) AS cnt FROM tf_v WHERE side = 0""", "tf_v")
oracle("doc_freq", "SELECT term, df FROM idf_v", "idf_v")
oracle("idf_weights", "SELECT term, df, round(idf, 6) AS idf FROM idf_v", "idf_v")
oracle("corpus_cosine", """
    SELECT review_id, round(cosine, 6) AS cosine_to_business FROM cos_v
    WHERE review_id IN (SELECT review_id FROM tf_v)""", "cos_v", "tf_v")
oracle("pair_cosine", "SELECT review_id, round(cosine, 6) AS cosine_to_business FROM pair_v",
       "pair_v")
oracle("char_ngrams", f"""
    SELECT term, count(*) AS cnt, count(DISTINCT review_id) AS df FROM (
      SELECT review_id, substr(w, i, n) AS term FROM (
        SELECT review_id, w, n, unnest(range(1, greatest(length(w) - n, 0) + 2)) AS i FROM (
          SELECT review_id, w, unnest(range(3, least(5, length(w)) + 1)) AS n FROM (
            SELECT review_id, ' ' || unnest(regexp_extract_all(t, '[^{SPACES}]+')) || ' ' AS w
            FROM norm_v)))) GROUP BY term""", "norm_v")
oracle("vocab_topk", """
    SELECT term, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS df FROM tf_v WHERE side = 0
    GROUP BY term HAVING count(*) >= 2 ORDER BY sum(cnt) DESC, term LIMIT 5000""", "tf_v")


def sweep_f1(task: str, flag: str) -> str:
    y = f"label_{task} = 1"
    tp, fp, fn = (f"count(*) FILTER ({c})" for c in (
        f"{y} AND {flag}", f"NOT {y} AND {flag}", f"{y} AND NOT {flag}"))
    return ratio(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}") + f" AS f1_{task}"


SWEEP = f"""SELECT *, (f1_ads + f1_irrelevant + f1_rant_no_visit + f1_relevant) / 4 AS macro_f1
  FROM (SELECT thr, {sweep_f1('ads', '(ads = 1)')},
               {sweep_f1('irrelevant', '(cosine < thr OR offtopic = 1)')},
               {sweep_f1('rant_no_visit', '(rant_no_visit = 1)')},
               {sweep_f1('relevant', '(NOT (cosine < thr OR offtopic = 1))')}
        FROM rules_v JOIN truth_v USING (review_id), {grid_values(COSINE_GRID)} GROUP BY thr)"""
oracle("cosine_sweep", f"""
    SELECT round(thr, 6) AS thr, round(f1_ads, 6) AS f1_ads, round(f1_irrelevant, 6) AS f1_irrelevant,
           round(f1_rant_no_visit, 6) AS f1_rant_no_visit, round(f1_relevant, 6) AS f1_relevant,
           round(macro_f1, 6) AS macro_f1 FROM ({SWEEP})""", "rules_v", "truth_v")
oracle("cosine_sweep_best", f"""
    SELECT round(thr, 6) AS thr, round(macro_f1, 6) AS macro_f1 FROM ({SWEEP})
    ORDER BY macro_f1 DESC, thr LIMIT 1""", "rules_v", "truth_v")

# ---- features -------------------------------------------------------------------------------


def hits(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {quote(pattern)})) AS INTEGER)"


SHAPED = "(SELECT *, " + shape("review_text") + " AS s, greatest(length(review_text), 1) AS n FROM reviews_v)"
URL = r"(?i)https?://[^ ]+|www\.[\p{L}\p{N}_.-]+"
oracle("featurize_metadata", f"""
    SELECT review_id, CAST(length(review_text) AS INTEGER) AS feat_len_chars,
           CAST(len(list_filter(string_split(s, ' '),
                lambda w: regexp_matches(w, '[0-9A-Za-z_]'))) AS INTEGER) AS feat_len_words,
           {hits('s', URL)} AS feat_url_count,
           {hits('s', r'\b' + NARROW_PHONE + r'\b')} AS feat_phone_count,
           {hits('s', '!')} AS feat_exclam, {hits('s', '!{2,}')} AS feat_multi_exclam,
           {hits('s', '[?]')} AS feat_question,
           round(CAST(CAST({hits('review_text', '[A-Z]')} AS DOUBLE) / n AS FLOAT)::DOUBLE, 5)
             AS feat_caps_ratio,
           round(CAST(CAST({hits('review_text', '[0-9]')} AS DOUBLE) / n AS FLOAT)::DOUBLE, 5)
             AS feat_digit_ratio,
           CAST(coalesce(hour(make_timestamp(time_ms * 1000)), -1) AS INTEGER) AS feat_hour,
           CAST(coalesce(isodow(make_timestamp(time_ms * 1000)) - 1, -1) AS INTEGER) AS feat_dow
    FROM {SHAPED}""", "reviews_v")
oracle("add_meta_features", f"""
    SELECT review_id, CAST(length(review_text) AS INTEGER) AS text_len, w AS word_count,
           round(CAST(length(review_text) AS DOUBLE) / greatest(w, 1), 6) AS avg_word_len,
           {hits('s', '!')} AS exclaim_count, {hits('s', '[?]')} AS question_count,
           round(CAST({hits('review_text', r'[\p{Lu}]')} AS DOUBLE) / n, 6) AS uppercase_ratio,
           {hits('s', URL)} AS url_count, {hits('s', r'\b' + PHONE + r'\b')} AS phone_count,
           {hits('s', r'\b[\w.-]+@[\w.-]+\.\w+\b')} AS email_count,
           {hits('review_text', r'[\x{1F300}-\x{1FAFF}]')} AS emoji_count
    FROM (SELECT *, {hits('s', '[^ ]+')} AS w FROM {SHAPED})""", "reviews_v")

# ---- sampling and models --------------------------------------------------------------------

oracle("subsample", """
    SELECT review_id, business_id FROM reviews_v ORDER BY md5('123:' || review_id), review_id
    LIMIT 100""", "reviews_v")
oracle("sample_fraction", f"""
    SELECT review_id FROM reviews_v
    WHERE {MD5_NUMBER.format("'123:' || review_id")} / 4294967296.0 < 0.3""", "reviews_v")
oracle("stratified_split", f"""
    SELECT review_id, CASE WHEN {MD5_NUMBER.format("'42:' || z || ':' || review_id")} / 4294967296.0
           < 0.2 THEN 'test' ELSE 'train' END AS split
    FROM (SELECT review_id, greatest(label_ads, label_irrelevant, label_rant_no_visit) AS z
          FROM truth_v)""", "truth_v")
ORACLES["group_kfold"] = with_ctes("""
    SELECT review_id, business_id, CAST(fold AS INTEGER) AS fold
    FROM reviews_v JOIN (
      SELECT business_id, fold FROM step JOIN ranked ON ranked.rn = step.rn) USING (business_id)""",
    "reviews_v").replace("WITH ", "WITH RECURSIVE ", 1).replace(") \n    SELECT review_id, business_id, CAST", """),
    ranked AS (SELECT business_id, count(*) AS n,
                      row_number() OVER (ORDER BY count(*) DESC, business_id) AS rn
               FROM reviews_v GROUP BY business_id),
    step(rn, loads, fold) AS (
      SELECT CAST(0 AS BIGINT), [0, 0, 0, 0, 0]::BIGINT[], CAST(-1 AS BIGINT)
      UNION ALL
      SELECT r.rn, list_transform(s.loads, lambda x, i:
                     CASE WHEN i = list_position(s.loads, list_min(s.loads)) THEN x + r.n ELSE x END),
             CAST(list_position(s.loads, list_min(s.loads)) - 1 AS BIGINT)
      FROM step s JOIN ranked r ON r.rn = s.rn + 1)
    SELECT review_id, business_id, CAST""", 1)
oracle("random_kfold", f"""
    SELECT review_id, CAST({MD5_NUMBER.format('review_id')} % 5 AS INTEGER) AS fold
    FROM reviews_v""", "reviews_v")
oracle("class_weights", " UNION ALL ".join(f"""
    SELECT 'label_{t}' AS label,
           round(count(*) / (2.0 * count(*) FILTER (label_{t} = 0)), 6) AS weight_0,
           round(count(*) / (2.0 * count(*) FILTER (label_{t} = 1)), 6) AS weight_1
    FROM truth_v""" for t in TASKS), "truth_v")
oracle("pos_weight", " UNION ALL ".join(f"""
    SELECT 'label_{t}' AS label, round(CASE WHEN sum(label_{t}) = 0 THEN 1.0
           ELSE CAST(count(*) - sum(label_{t}) AS DOUBLE) / sum(label_{t}) END, 6) AS pos_weight
    FROM truth_v""" for t in TASKS), "truth_v")
META = ("text_len", "word_count", "avg_word_len", "exclaim_count", "question_count",
        "uppercase_ratio", "url_count", "phone_count", "email_count", "emoji_count")
_meta = ORACLES["add_meta_features"]
for c in ("avg_word_len", "uppercase_ratio"):
    # Scaling works on unrounded values.
    _meta = _meta.replace(f", 6) AS {c}", f", 15) AS {c}")
ORACLES["scale_features"] = f"""
    SELECT review_id, {', '.join(f'''round({c} / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1
    ELSE stddev_pop({c}) END FROM m), 6) AS {c}''' for c in META)} FROM m"""
ORACLES["scale_features"] = f"WITH m AS MATERIALIZED ({_meta}) " + ORACLES["scale_features"]
oracle("score_table", """
    SELECT review_id, ads_p, irrelevant_p, rant_no_visit_p FROM scores_v""", "scores_v")

# Vocabulary sizes as the models use them; ties at the cut go by term.
CHAR_GRAMS = f"""
    SELECT review_id, 'char' AS kind, substr(w, i, n) AS term FROM (
      SELECT review_id, w, n, unnest(range(1, greatest(length(w) - n, 0) + 2)) AS i FROM (
        SELECT review_id, w, unnest(range(3, least(5, length(w)) + 1)) AS n FROM (
          SELECT review_id, ' ' || unnest(regexp_extract_all(t, '[^{SPACES}]+')) || ' ' AS w
          FROM texts)))"""
WORD_GRAMS = f"""
    SELECT review_id, 'word', unnest({grams('tokens')}) FROM (
      SELECT review_id, regexp_extract_all(t, '{WORD}{{2,}}') AS tokens FROM texts)"""
oracle("tfidf_features", f""", texts AS MATERIALIZED (
      SELECT review_id, lower(review_text || ' [SEP] ' || biz_name || ' ' || biz_cats || ' '
                              || biz_desc) AS t FROM reviews_v),
    tally AS MATERIALIZED (SELECT review_id, kind, term, count(*) AS cnt
      FROM ({CHAR_GRAMS} UNION ALL {WORD_GRAMS}) GROUP BY ALL),
    vocabulary AS (SELECT kind, term FROM (
      SELECT kind, term, row_number() OVER (PARTITION BY kind ORDER BY sum(cnt) DESC, term) AS rn
      FROM tally GROUP BY kind, term)
      WHERE rn <= CASE kind WHEN 'char' THEN 300000 ELSE 200000 END)
    SELECT review_id, CAST(count(*) AS INTEGER) AS nonzero,
           CAST(count(DISTINCT kind) AS DOUBLE) AS squared_length
    FROM tally JOIN vocabulary USING (kind, term) GROUP BY review_id""", "reviews_v")
ORACLES["tfidf_features"] = ORACLES["tfidf_features"].replace(") , texts AS", "), texts AS", 1)

# Terms of two rows or more, and the scaled meta features behind them.
_both = ORACLES["tfidf_features"].replace("GROUP BY kind, term)", "GROUP BY kind, term HAVING count(*) >= 2)")
ORACLES["assemble_features"] = (
    f"WITH t AS ({_both}), m AS MATERIALIZED ({_meta}), "
    + "s AS (SELECT " + ", ".join(f"CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS {c}" for c in META) + " FROM m) "
    + "SELECT review_id, CAST(coalesce(nonzero, 0) + "
    + " + ".join(f"CAST(m.{c} <> 0 AS INTEGER)" for c in META)
    + " AS INTEGER) AS nonzero, round(coalesce(squared_length, 0) + "
    + " + ".join(f"power(m.{c} / s.{c}, 2)" for c in META)
    + ", 6) AS squared_length FROM m CROSS JOIN s LEFT JOIN t USING (review_id)")

# ---- ensemble -------------------------------------------------------------------------------

oracle("threshold_decide", f"""
    SELECT review_id, {', '.join(f'CAST({t}_p >= {TUNED[t]} AS INTEGER) AS {t}_model'
                                 for t in TASKS)} FROM scores_v""", "scores_v")

MODEL = {t: f"{t}_p >= {TUNED[t]}" for t in TASKS}
IRRELEVANT = {
    "precision": f"irrelevant = 1 AND {MODEL['irrelevant']}",
    "recall": f"irrelevant = 1 OR {MODEL['irrelevant']}",
    "balanced": f"{MODEL['irrelevant']} AND (irrelevant = 1 OR irrelevant_p >= 0.6)",
    "rules_only": "irrelevant = 1",
    "model_only": MODEL["irrelevant"],
}


def ensemble(mode: str) -> str:
    either = {t: f"{t} = 1 OR {MODEL[t]}" for t in ("ads", "rant_no_visit")}
    if mode == "rules_only":
        either = {t: f"{t} = 1" for t in either}
    if mode == "model_only":
        either = {t: "FALSE" for t in either}
    irr = IRRELEVANT[mode]
    return f"""CAST(({either['ads']}) AS INTEGER) AS label_ads,
               CAST(({irr}) AS INTEGER) AS label_irrelevant,
               CAST(({either['rant_no_visit']}) AS INTEGER) AS label_rant_no_visit,
               1 - CAST(({irr}) AS INTEGER) AS label_relevant"""


for mode in IRRELEVANT:
    prob = "0.0::DOUBLE" if mode == "rules_only" else "irrelevant_p"
    oracle(f"ens_{mode}", f"""
        SELECT review_id, {ensemble(mode)}, {prob} AS prob_irrelevant FROM both_v""", "both_v")


def said(mode: str) -> str:
    both = "irr:rule+model" if mode == "precision" else "irr:rule|model"
    return f"""concat_ws('; ', CASE WHEN ads = 1 THEN 'ads:rule' END,
        CASE WHEN {MODEL['ads']} THEN 'ads:model' END,
        CASE WHEN rant_no_visit = 1 THEN 'rant:rule' END,
        CASE WHEN {MODEL['rant_no_visit']} THEN 'rant:model' END,
        CASE WHEN irrelevant = 1 THEN '{both}(p=' || printf('%.2f', irrelevant_p) || ')'
             WHEN {MODEL['irrelevant']}
             THEN 'irr:rule|model(p=' || printf('%.2f', irrelevant_p) || ')' END)"""


oracle("ens_reasons", f"SELECT review_id, {said('precision')} AS reasons FROM both_v", "both_v")
oracle("ens_score_note", """
    SELECT review_id, reasons || printf(' | tr_p={ads:%.2f, irr:%.2f, rant:%.2f}', ads_p,
           irrelevant_p, rant_no_visit_p) AS reasons FROM both_v""", "both_v")
oracle("ens_output", f"""
    SELECT review_id, business_id, biz_name, biz_cats, review_text, {ensemble('recall')},
           ads_p, irrelevant_p, rant_no_visit_p, {said('recall')} AS reasons
    FROM both_v JOIN reviews_v USING (review_id)""", "both_v", "reviews_v")

# ---- evaluation and thresholds --------------------------------------------------------------

oracle("confusion_counts", "SELECT label, tn, fp, fn, tp FROM cells_v", "cells_v")
oracle("label_report", f"SELECT label, {SHOW}, support FROM report_v", "report_v")


def samples(hat: str) -> tuple[str, str, str]:
    tp = " + ".join(f"label_{t} * {hat.format(t)}" for t in TASKS)
    y = " + ".join(f"label_{t}" for t in TASKS)
    h = " + ".join(hat.format(t) for t in TASKS)
    return (f"avg({ratio(tp, h)})", f"avg({ratio(tp, y)})", f"avg({ratio(f'2 * ({tp})', f'{y} + {h}')})")


P, R, F = samples("hat_{}")
oracle("avg_report", f"""
    SELECT average, round(precision, 6) AS precision, round(recall, 6) AS recall,
           round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
      SELECT 'micro avg' AS average, {ratio('sum(tp)', 'sum(tp) + sum(fp)')} AS precision,
             {ratio('sum(tp)', 'sum(tp) + sum(fn)')} AS recall,
             {ratio('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')} AS f1,
             sum(support) AS support FROM report_v
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM report_v
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
                sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)
                FROM report_v
      UNION ALL SELECT 'samples avg', {P}, {R}, {F}, (SELECT sum(support) FROM report_v)
                FROM hats_v)""", "report_v", "hats_v")
oracle("single_label_report", f"""
    SELECT label, {SHOW}, CAST(support AS BIGINT) AS support FROM (
      SELECT label, {PRF} FROM cells_v WHERE label = 'label_irrelevant'
      UNION ALL
      SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM (
        SELECT {PRF} FROM (
          SELECT tp, fp, fn FROM cells_v WHERE label = 'label_irrelevant'
          UNION ALL SELECT tn, fn, fp FROM cells_v WHERE label = 'label_irrelevant')))""", "cells_v")
oracle("fold_macro", f"""
    SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM (
      SELECT fold, avg(precision) AS p, avg(recall) AS r, avg(f1) AS f FROM (
        SELECT fold, label, {PRF} FROM (
          SELECT fold, label, {CELLS} FROM (
            {long_form('(SELECT * FROM hats_v JOIN fold_v USING (review_id))', 'hat_{}', 'fold,')})
          GROUP BY fold, label)) GROUP BY fold)""", "hats_v", "fold_v")
ERRORS = " UNION ALL ".join(
    f"SELECT review_id, {i} AS i, 'label_{t}' || CASE WHEN hat_{t} = 1 THEN '_FP' ELSE '_FN' END "
    f"AS error_type FROM hats_v WHERE hat_{t} <> label_{t}" for i, t in enumerate(TASKS))
oracle("error_slice", f"""
    SELECT review_id, business_id, biz_name, biz_cats, review_text, label_ads, label_irrelevant,
           label_rant_no_visit, error_type
    FROM ({ERRORS}) e JOIN hats_v USING (review_id) JOIN reviews_v USING (review_id)
    WHERE i = (SELECT min(i) FROM ({ERRORS}))""", "hats_v", "reviews_v")
oracle("error_slice_all", f"SELECT review_id, error_type FROM ({ERRORS})", "hats_v")
oracle("evaluate_predictions", f"""
    SELECT label, {SHOW}, support FROM (SELECT label, {PRF} FROM (
      SELECT label, {CELLS} FROM (
        {long_form('truth_v JOIN rules_v USING (review_id)', '{}')}) GROUP BY label))""",
       "truth_v", "rules_v")
oracle("resolve_pred_suffix", "SELECT label, tn, fp, fn, tp FROM cells_v", "cells_v")
FOUR_LABELS = " UNION ALL ".join(
    f"SELECT 'label_{t}' AS label, label_{t} AS y, {t} AS h FROM truth_v JOIN rules_v USING (review_id)"
    for t in (*TASKS, "relevant"))
oracle("rules_baseline_report", f"""
    SELECT label, {SHOW}, support FROM (SELECT label, {PRF} FROM (
      SELECT label, {CELLS} FROM ({FOUR_LABELS}) GROUP BY label))""", "truth_v", "rules_v")
oracle("fold_reports", f"""
    SELECT fold, label, {SHOW}, support FROM (SELECT fold, label, {PRF} FROM (
      SELECT fold, label, {CELLS} FROM (
        {long_form('(SELECT * FROM hats_v JOIN fold_v USING (review_id))', 'hat_{}', 'fold,')})
      GROUP BY fold, label))""", "hats_v", "fold_v")
oracle("toxicity_report", f"""
    SELECT label, {SHOW}, support FROM (SELECT label, {PRF} FROM (
      SELECT 'label_toxic' AS label, {CELLS} FROM (
        SELECT toxic AS y, rant_no_visit AS h FROM labels JOIN rules_v ON review_id = CAST(doc_id AS VARCHAR))))""",
       "rules_v")
ENSEMBLE_LONG = "(" + " UNION ALL ".join(
    f"SELECT '{t}' AS label, label_{t} AS y, {t} AS rule, {t}_p AS p FROM both_v "
    "JOIN truth_v USING (review_id)" for t in TASKS) + ")"
ENSEMBLE_CURVE = curve(
    ENSEMBLE_LONG, "CASE WHEN label = 'irrelevant' THEN rule = 1 AND p >= thr "
    "ELSE rule = 1 OR p >= thr END", ENSEMBLE_GRID)
oracle("rules_or_ml_curve", f"""
    SELECT label, round(thr, 6) AS thr, tp, fp, fn, round(f1, 6) AS f1 FROM ({ENSEMBLE_CURVE})""",
       "both_v", "truth_v")
oracle("tune_rules_or_ml", f"""
    SELECT label, round(thr, 6) AS thr, round(f1, 6) AS f1 FROM ({best(ENSEMBLE_CURVE)})""",
       "both_v", "truth_v")
oracle("oof_curve", f"""
    SELECT label, round(thr, 6) AS thr, tp, fp, fn, round(f1, 6) AS f1 FROM ({OOF_CURVE})""", "oof_v")
oracle("tune_oof", f"""
    SELECT task AS label, round(coalesce(b.thr, 0.5), 6) AS thr, round(b.f1, 6) AS f1
    FROM (VALUES ('ads'), ('irrelevant'), ('rant_no_visit')) AS t(task)
    LEFT JOIN ({BEST_OOF}) b ON b.label = task""", "oof_v")

_folds = ORACLES["group_kfold"]
SUPPORT = " UNION ALL ".join(
    f"SELECT {{0}} 'label_{t}' AS label, CAST(sum(label_{t}) AS BIGINT) AS support, TRUE AS in_range FROM {{1}}"
    for t in TASKS)
oracle("lr_one_vs_rest", " UNION ALL ".join(
    f"SELECT 'label_{t}' AS label, count(*) AS n, CAST(sum(label_{t}) AS BIGINT) AS positives, 0.0::DOUBLE AS gap, FALSE AS out_of_range FROM truth_v"
    for t in TASKS), "truth_v")
ORACLES["holdout_support"] = (
    "WITH s AS (" + ORACLES["stratified_split"] + f"), truth_v AS ({TRUTH}), t AS (SELECT truth_v.* FROM truth_v JOIN s USING (review_id) WHERE split = 'test') "
    + SUPPORT.format("", "t"))
ORACLES["group_cv_support"] = (
    f"WITH f AS ({_folds}), truth_v AS ({TRUTH}), t AS (SELECT truth_v.*, fold FROM truth_v JOIN f USING (review_id)) "
    + " UNION ALL ".join(x + " GROUP BY fold" for x in SUPPORT.format("fold,", "t").split(" UNION ALL ")))

# ---- result views and the stream ------------------------------------------------------------

oracle("search_reviews", """
    SELECT review_id, biz_name FROM reviews_v
    WHERE contains(lower(review_text), 'iphone') OR contains(lower(biz_name), 'iphone')
       OR contains(lower(biz_cats), 'iphone')""", "reviews_v")
oracle("flagged_only", f"""
    SELECT review_id, label_ads, label_irrelevant, label_rant_no_visit
    FROM (SELECT review_id, {ensemble('precision')} FROM both_v)
    WHERE label_ads + label_irrelevant + label_rant_no_visit > 0""", "both_v")
oracle("sort_by_prob", """
    SELECT review_id, irrelevant_p AS prob_irrelevant FROM scores_v
    ORDER BY irrelevant_p DESC, review_id""", "scores_v")
oracle("top_by_prob", """
    SELECT review_id, irrelevant_p FROM scores_v ORDER BY irrelevant_p DESC, review_id LIMIT 50""",
       "scores_v")
oracle("prob_histogram", """
    SELECT round(i / 10.0, 6) AS bin, count(review_id) AS count FROM range(10) AS r(i)
    LEFT JOIN scores_v ON least(floor(irrelevant_p * 10), 9) = i GROUP BY i""", "scores_v")
oracle("stream_label", """
    SELECT review_id, ads, irrelevant, rant_no_visit, round(cosine, 6) AS cosine_to_business, reasons
    FROM rules_pair_v""", "rules_pair_v")
ORACLES["stream_label_batches"] = ORACLES["stream_label"]
