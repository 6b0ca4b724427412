"""Secret scans: fixed forms, and runs of characters that a battery of randomness tests finds random.

Everything is a column expression; a document never leaves its row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base forms and the order of kinds.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"  # equal to AKIA[A-Z0-9]+ of 20 or more: what it skips lies inside no longer match
HEX = "[0-9a-f]{24,}"  # equal to [0-9a-f]+ of 24 or more
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-="
CLASSES = "d" * 10 + "l" * 26 + "u" * 26 + "s" * 5
#: Inferred encoding: the first whose letters cover a run, and how many letters it has.
ENCODINGS = (("[0-9]+", 10), ("[0-9a-f]+", 16), ("[0-9A-F]+", 16), ("[A-Z2-7]+=*", 32), ("[0-9a-z]+", 36), ("[0-9A-Z]+", 36), ("[0-9A-Za-z]+", 62), (".*", 66))
REJECT_Z = 3.3
SWITCH_RATE = 0.03
DISCOVERY_RATE = 0.01
BINS_PER_DECADE = 10
MAX_BIN = 300
BLOCK = 256
SPAN = "struct<start:int,kind:int,end:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running(numbers: Column) -> Column:
    """Running sums of an int array; sums of blocks keep a row with many numbers from quadratic work."""

    def with_sums(sums: Column) -> Column:
        before = F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
        return let(before, lambda held: F.transform(numbers, lambda _, i: F.get(held, (i / BLOCK).cast("int")) + inside(i)))

    def inside(i: Column) -> Column:
        return total(F.slice(numbers, i - i % BLOCK + 1, i % BLOCK + 1))

    blocks = F.sequence(F.lit(0), ((F.size(numbers) - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: total(F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK))))
    return let(sums, with_sums)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, found>>: leftmost non-overlapping matches in code points; ``found`` is a group."""

    def spans(gaps: Column, whole: Column, found: Column) -> Column:
        steps = F.transform(whole, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return let(
            steps,
            lambda step: let(
                running(step),
                lambda ends: F.transform(
                    whole,
                    lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), F.get(found, i).alias("found")),
                ),
            ),
        )

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    some = let(F.struct(F.split(text, pattern, -1).alias("g"), whole.alias("w"), found.alias("f")), lambda x: spans(x["g"], x["w"], x["f"]))
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def of_kind(spans: Column, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    spans = F.filter(spans, keep) if keep else spans
    shape = lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"))
    return F.transform(spans, shape)


def base_spans(text: Column) -> Column:
    """The fixed forms: assignments whose value has six characters or more, access keys, long lower-case hex."""
    assign = of_kind(matches(text, ASSIGN, 2), "assign", lambda x: F.length(x["found"]) >= ASSIGN_LEAST)
    return F.concat(assign, of_kind(matches(text, ACCESS), "access"), of_kind(matches(text, HEX), "hex"))


@dataclass(frozen=True)
class Written:
    """How letters of written words repeat: sums of squared and cubed letter frequencies."""

    squares: float = 0.068
    cubes: float = 0.0063


def letter_count(run: Column, letter: Column) -> Column:
    return F.length(run) - F.length(F.replace(run, letter, F.lit("")))


def battery(run: Column, written: Written) -> Column:
    """struct<random: boolean, z: double> for one candidate.

    ``random`` holds if none of three tests rejects that the run is drawn evenly from its encoding's letters:
    chi-squared over the letters, number of runs of one character class given the class counts, and
    lag-one correlation of letter positions.  ``z`` tells how far it is from written words, by the same
    letter repetitions and class changes under the frequencies of written words (Stouffer's sum of both).
    """

    def result(x: Column) -> Column:
        n, k = x["n"].cast("double"), x["k"].cast("double")
        pairs, classes, runs = x["pairs"].cast("double"), x["classes"], x["runs"].cast("double")
        chi = (k / n) * (pairs + n) - n
        chi_z = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        squares = F.aggregate(classes, F.lit(0.0), lambda a, c: a + F.pow(c.cast("double"), F.lit(2.0)))
        cubes = F.aggregate(classes, F.lit(0.0), lambda a, c: a + F.pow(c.cast("double"), F.lit(3.0)))
        mean = 1 + n - squares / n
        spread = (squares * (squares + n * (n + 1)) - 2 * n * cubes - F.pow(n, F.lit(3.0))) / (n * n * (n - 1))
        runs_z = F.when(spread > 1e-9, (runs - mean) / F.sqrt(spread)).otherwise(0.0)
        middle = x["sum"] / n
        variance = x["square"] / n - middle * middle
        serial = F.when(variance > 0, ((x["lag"] - (n - 1) * middle * middle - middle * (2 * middle - x["first"] - x["last"])) / (n * variance) + 1 / n) * F.sqrt(n)).otherwise(99.0)
        s2, s3 = written.squares, written.cubes
        apart = 2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)
        letters_z = (n * (n - 1) * s2 - pairs) / F.sqrt(apart)
        switch_z = (runs - 1 - (n - 1) * SWITCH_RATE) / F.sqrt((n - 1) * SWITCH_RATE * (1 - SWITCH_RATE))
        passes = (chi_z < REJECT_Z) & (runs_z > -REJECT_Z) & (F.abs(serial) < REJECT_Z)
        return F.struct(passes.alias("random"), ((letters_z + switch_z) / F.sqrt(F.lit(2.0))).alias("z"), n.cast("int").alias("n"))

    def measured(letters: Column) -> Column:
        at = F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c).cast("double"))
        shape = F.translate(run, ALPHABET, CLASSES)
        counts = F.transform(F.array_distinct(letters), lambda c: letter_count(run, c).cast("double"))
        k = F.lit(ENCODINGS[-1][1])
        for pattern, size in reversed(ENCODINGS[:-1]):
            k = F.when(run.rlike(f"^{pattern}$"), size).otherwise(k)
        add = lambda a, v: a + v
        return let(
            at,
            lambda place: F.struct(
                F.length(run).alias("n"),
                k.alias("k"),
                F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * (c - 1)).alias("pairs"),
                F.transform(F.array(*[F.lit(c) for c in "dlus"]), lambda c: letter_count(shape, c)).alias("classes"),
                F.regexp_count(shape, F.lit("d+|l+|u+|s+")).alias("runs"),
                F.aggregate(place, F.lit(0.0), add).alias("sum"),
                F.aggregate(place, F.lit(0.0), lambda a, v: a + v * v).alias("square"),
                F.aggregate(F.zip_with(place, F.slice(place, F.lit(2), F.size(place)), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), add).alias("lag"),
                F.get(place, F.lit(0)).alias("first"),
                F.element_at(place, -1).alias("last"),
            ),
        )

    return let(let(F.split(run, ""), measured), result)


def tail(z: Column) -> Column:
    """-log10 of the upper normal tail."""
    far = F.greatest(z, F.lit(0.0))
    log_p = -far * far / 2 - 0.5 * F.log(F.lit(2 * 3.141592653589793)) + F.log(2 / (far + F.sqrt(far * far + 8 / 3.141592653589793)))
    return F.when(z > 0, -log_p / F.log(F.lit(10.0))).otherwise(0.0)


def p_bin(z: Column) -> Column:
    return F.least(F.lit(MAX_BIN), F.floor(tail(z) * BINS_PER_DECADE)).cast("int")


def stratum(n: Column) -> Column:
    """Lengths are compared within half doublings."""
    return F.floor(F.log2(n.cast("double")) * 2).cast("int")


def candidates(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    some = docs.select(text.alias("text")).where(F.col("text").rlike(CANDIDATE))
    return some.select(F.explode(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).alias("run"))


def written_letters(runs: DataFrame) -> Written:
    """Letter frequencies over all candidates that are plain lower-case words; one row per letter."""
    words = runs.where(F.col("run").rlike("^[A-Z]?[a-z]+$")).select(F.explode(F.split(F.lower("run"), "")).alias("letter"))
    counts = [r["count"] for r in words.groupBy("letter").count().orderBy("letter").collect()]
    n = sum(counts)
    if n < 1000:
        return Written()
    return Written(sum((c / n) ** 2 for c in counts), sum((c / n) ** 3 for c in counts))


def discovery_bounds(runs: DataFrame, written: Written, rate: float = DISCOVERY_RATE) -> dict[int, int]:
    """For each length stratum the least bin of -log10 p at which the step-up rule of false-discovery control holds.

    All candidates of all documents count.  Their p-values are met in a histogram of bounded size.
    """
    met = runs.select(battery(F.col("run"), written).alias("b")).select(stratum(F.col("b.n")).alias("stratum"), p_bin(F.col("b.z")).alias("bin"))
    found: dict[int, dict[int, int]] = {}
    for row in met.groupBy("stratum", "bin").count().collect():
        found.setdefault(row["stratum"], {})[row["bin"]] = row["count"]
    bounds = {}
    for length, bins in found.items():
        m, above, bound = sum(bins.values()), 0, None
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if 10 ** (-b / BINS_PER_DECADE) <= rate * above / m:
                bound = b
        if bound is not None:
            bounds[length] = bound
    return bounds


def random_spans(text: Column, written: Written, bounds: dict[int, int]) -> Column:
    """Candidates that pass the battery and whose p-value is a discovery among those of their length."""
    if not bounds:
        return F.array().cast(f"array<{SPAN}>")
    least = F.create_map(*[F.lit(x) for pair in sorted(bounds.items()) for x in pair])

    def secret(x: Column) -> Column:
        return let(battery(x["found"], written), lambda b: b["random"] & (p_bin(b["z"]) >= F.coalesce(F.try_element_at(least, stratum(b["n"])), F.lit(MAX_BIN + 1))))

    return of_kind(matches(text, CANDIDATE), "random", secret)


def secret_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of (start, kind, end) sorted by start, then kind.

    Positions are code points of the whole text, ends exclusive; kind is a place in ``KINDS``.  ``spans`` holds all
    of ``base`` and the random runs.  Null and empty texts have none.  All rows and columns stay, but for earlier columns of
    these two names, which are replaced.
    """
    runs = candidates(docs)
    written = written_letters(runs)
    bounds = discovery_bounds(runs, written)
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    both = docs.select(F.struct("*").alias("doc")).withColumn("base", F.array_sort(base_spans(text)))
    both = both.withColumn("spans", F.array_sort(F.concat("base", random_spans(text, written, bounds))))
    kept = [F.col(f"doc.{c}").alias(c) for c in docs.columns if c not in ("base", "spans")]
    return both.select(*kept, "base", "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
