"""The moderation policy: what counts as an ad, off-topic, or a rant without a visit."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Policy:
    url_regex: tuple[str, ...]
    phone_regex: tuple[str, ...]
    keywords: tuple[str, ...]
    min_cosine: float
    off_topic: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    cues: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, doc: Mapping) -> "Policy":
        ads, irrelevant, rant = doc["ads"], doc["irrelevant"], doc["rant_no_visit"]
        off_topic = irrelevant.get("off_topic_keywords") or {}
        return cls(
            url_regex=tuple(ads["url_regex"]),
            phone_regex=tuple(ads["phone_regex"]),
            keywords=tuple(ads["keywords"]),
            min_cosine=float(irrelevant["min_cosine_to_business"]),
            off_topic={k.lower(): tuple(words) for k, words in off_topic.items() if words},
            cues=tuple(rant["positive_cues"]),
        )

    def to_table(self, spark: SparkSession) -> DataFrame:
        """The policy as rows ``(label, kind, category, pattern)``."""
        rows = [("ads", "url_regex", None, p) for p in self.url_regex]
        rows += [("ads", "phone_regex", None, p) for p in self.phone_regex]
        rows += [("ads", "keyword", None, p) for p in self.keywords]
        rows += [
            ("irrelevant", "off_topic", cat, w) for cat, ws in self.off_topic.items() for w in ws
        ]
        rows += [("rant_no_visit", "cue", None, p) for p in self.cues]
        rows += [("irrelevant", "min_cosine", None, repr(self.min_cosine))]
        return spark.createDataFrame(
            rows, "label string, kind string, category string, pattern string"
        )


# The default policy.  Labels depend on these exact patterns and words.
DEFAULT_POLICY = Policy.from_dict(
    {
        "ads": {
            "url_regex": [r"https?://\S+", r"www\.[\w.-]+"],
            "phone_regex": [r"\b\+?\d[\d\s().-]{7,}\b"],
            "keywords": [
                "promo", "discount", "% off", "coupon", "call now", "dm us", "book via",
            ],
        },
        "irrelevant": {
            "min_cosine_to_business": 0.25,
            "off_topic_keywords": {
                "restaurant": ["iphone", "laptop", "headphones", "delivery app bug"],
                "spa": ["motherboard", "ssd", "gpu"],
                "electronics": ["masseuse", "sauna", "facial"],
                "park": ["graphics card", "rtx", "motherboard"],
            },
        },
        "rant_no_visit": {
            "positive_cues": [
                "haven't been", "never been", "didn't try", "i heard", "people say",
                "someone told me",
            ],
        },
    }
)


def policy_from_table(table: DataFrame, most: int = 10_000) -> Policy:
    """The inverse of ``Policy.to_table``, for a table wherever Spark can read one.

    At most ``most`` rows come to the driver; beyond that, ``operators.phrases`` uses the table itself.
    """
    rows = table.select("kind", "category", "pattern").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: match the phrases with operators.phrases")
    of = lambda kind: tuple(sorted(r["pattern"] for r in rows if r["kind"] == kind and r["pattern"]))
    bounds = of("min_cosine")
    if len(bounds) != 1:
        raise ValueError("a policy table has one row of kind min_cosine")
    off_topic: dict[str, list[str]] = {}
    for r in sorted((r for r in rows if r["kind"] == "off_topic" and r["pattern"]), key=lambda r: r["pattern"]):
        off_topic.setdefault((r["category"] or "").lower(), []).append(r["pattern"])
    return Policy(
        of("url_regex"), of("phone_regex"), of("keyword"), float(bounds[0]),
        {k: tuple(v) for k, v in sorted(off_topic.items())}, of("cue"),
    )


def load_policy(path: str) -> Policy:
    """Read a policy file of the driver: JSON always, YAML where a YAML reader is installed.

    A policy on shared storage is a table: ``policy_from_table(spark.read.parquet(path))``.
    """
    with open(path, encoding="utf-8") as handle:
        if path.endswith(".json"):
            return Policy.from_dict(json.load(handle))
        try:
            import yaml
        except ImportError as exc:
            raise ValueError("no YAML reader here: give the policy as JSON") from exc
        return Policy.from_dict(yaml.safe_load(handle))
