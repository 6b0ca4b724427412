"""Queries that SQL cannot express, against plain Python over the whole small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import ann, base, jaccard, lines, mixing, queries, records, secrets, toxicity

SF = "/root/testdata/sf0.001"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def docs():
    table = pq.read_table(f"{SF}/documents.parquet").to_pandas().sort_values("doc_id")
    return table.assign(text=table["text"].fillna("")).set_index("doc_id")


def result(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


def test_nearest_recall(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    found = {k: v.sort_values("rank") for k, v in result(spark, "op1_nearest").groupby("query_id")}
    hits = 0
    asked = ids[ids % 20 == 0]
    assert sorted(found) == sorted(asked)
    for q in asked:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        got = found[q]
        assert list(got["rank"]) == list(range(1, 21))
        assert np.allclose(got["score"], score[np.searchsorted(ids, got["vec_id"])], atol=1e-12, rtol=0)
        hits += len(set(ids[best]) & set(got["vec_id"]))
    assert hits >= 0.9 * 20 * len(asked)


def test_boundary_vectors_are_copied():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    reach = float((x * x).sum(1).max())
    placed = np.concatenate([x, np.sqrt(np.maximum(reach - (x * x).sum(1), 0))[:, None]], 1)
    lists = ann.Lists(ann.CentroidGraph.build(ann.balanced_centroids(placed, 60)), reach)
    homes = lists.homes(x)
    assert 1.2 < np.mean([len(h) for h in homes]) <= ann.REPLICAS
    nearest = ann.distances(placed, lists.graph.centroids).argmin(1)
    assert np.mean([h[0] == n for h, n in zip(homes, nearest)]) > 0.97  # the graph finds nearly all


def test_secret_spans(spark, docs):
    assign = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found = result(spark, "op4_secrets").set_index("doc_id")
    for i, text in docs["text"].items():
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        row = found.loc[i]
        assert hashlib.sha256(said.encode()).hexdigest() == row["base_sha256"]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert set(filter(None, said.split(","))) <= set(filter(None, row["spans"].split(",")))


def test_random_runs_are_told_from_words(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    keys = ["".join(rng.choice(letters, 32)) for _ in range(20)]
    syllables = ["tion", "er", "an", "the", "ing", "re", "ou", "st", "ha", "en"]
    words = ["".join(rng.choice(syllables, 9)) for _ in range(2000)]
    tricks = ["abcdefghijklmnopqrstuvwxyz", "a" * 40, "12345678901234567890123456", "ab" * 20]
    rows = [(i, f"x {k} y") for i, k in enumerate(keys)] + [(100 + i, w) for i, w in enumerate(words + tricks)]
    found = secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    hit = {r.doc_id for r in found.where("size(spans) > 0").select("doc_id").collect()}
    assert len(hit & set(range(20))) >= 18 and len(hit) <= 20 + 10


def test_matches_at_odd_places(spark):
    rows = [(0, "token=secret=abcdefg"), (1, "secret=token:abcdefg"), (2, "\U0001F600 API_KEY: 'abcdef' x"), (3, "password=" + "a1" * 40_000)]
    found = secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {r.doc_id: [(s.start, s.end) for s in r.base if s.kind == 0] for r in found}
    assert spans == {0: [(0, 20)], 1: [], 2: [(2, 18)], 3: [(0, 80_009)]}


def test_many_matches_have_running_places(spark):
    text = "".join(f"{'-' * (i % 7)}x=" for i in range(3000))
    found = spark.createDataFrame([(text,)], "t string").select(secrets.matches(F.col("t"), "x=").alias("m")).first()["m"]
    assert [(s.start, s.end) for s in found] == [m.span() for m in re.finditer("x=", text)]


def test_token_records_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    folder = f"file://{tmp_path}/out"
    manifest = records.write_records(frame, folder, path, 2, shards=5)
    found = records.read_records(manifest, folder).toPandas().set_index("doc_id")
    start = 0
    for i, text in docs["text"].items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert tuple(found.loc[i]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shard = sorted(manifest.collect(), key=lambda r: r.shard)[1]
    doc, ids = records.fetch(folder, shard.path, 3)  # any record by its index alone
    assert (doc, list(ids)) == (doc, [*tokenizer.encode(docs.loc[doc, "text"], add_special_tokens=False).ids, 2])
    damaged = tmp_path / "out" / f"{shard.path}.rec"
    data = bytearray(damaged.read_bytes())
    data[40] ^= 1
    damaged.write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        records.read_records(manifest, folder).count()


def test_pieces_encode_as_whole_texts():
    path = queries.tokenizer_path()
    fast, plain = records.Encoder(path, True), records.Encoder(path, False)
    parts = [" ", "  ", "\n", "\t", " \n", "\n ", "'s", "don't", ".", ",", "a", "Wort", "été", "\xa0", " ", "12", "3.5", "<|endoftext|>", "&&", "日本", "\x00", "é.", ".,", "　 ", "x.\n", "a\nb", "÷.", "…. ", "\x01", "a,\x01"]
    rng = np.random.default_rng(2)
    for _ in range(400):
        texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(4)]
        for text, a, b in zip(texts, fast.encode(texts), plain.encode(texts)):
            assert list(a) == list(b), text


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.QUERIES["op6_toxicity"](spark, sf).toPandas()
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas()
    held = found[found["held_out"]].merge(labels, on="doc_id")
    assert (held["predicted"] == held["toxic"]).mean() > 0.85


def test_gapped_insults_stay_near():
    marks = toxicity.Landmarks(["idiot", "worthless"])
    near = {w: marks.near([w]) for w in ("idiot", "idxiot", "iddiot", "worthhless", "edition", "thereon")}
    value = {w: float(v[2].max(initial=0)) for w, v in near.items()}
    assert value["idiot"] == pytest.approx(1) and value["idxiot"] > 0.6 and value["iddiot"] > 0.7 and value["worthhless"] > 0.7
    assert value["thereon"] == 0 and value["edition"] < 0.6
    assert "idiot" in toxicity.tokens_of("you i d i o t there") and "idiot" in [toxicity.plain(t) for t in toxicity.tokens_of("an i.d.i.o.t")]


def brute_kernel(s, t, length, decay=toxicity.DECAY):
    import itertools

    weight = collections.Counter()
    for x, sign in ((s, 0), (t, 1)):
        for places in itertools.combinations(range(len(x)), length):
            weight[sign, "".join(x[p] for p in places)] += decay ** (places[-1] - places[0] + 1)
    return sum(v * weight[1, u] for (side, u), v in list(weight.items()) if side == 0)


def test_kernel_counts_subsequences():
    words = ["idiot", "iddiot", "clown", "cXlown", "tit"]
    codes, _ = toxicity.coded(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            got = toxicity.subsequence_kernel(codes[i : i + 1], codes[j : j + 1])[0]
            assert got == pytest.approx(brute_kernel(a, b, 2) + brute_kernel(a, b, 3))


def test_mixture_meets_targets(spark, docs):
    found = result(spark, "op7_mix_sources")
    size = docs["text"].map(lambda t: len(t.encode().split()))
    assert (found.set_index("doc_id")["size"].sort_index() == size).all()
    assert (found["taken"] % found["size"].clip(lower=1) == 0).all() and (found["taken"] <= 2 * found["size"]).all()
    by = found.assign(source=docs["source"].reindex(found["doc_id"]).to_numpy()).groupby("source")
    total, weights = size.sum(), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by.groups, key=lambda s: s.encode()))}
    left, capped = 1.5 * total, {}
    while True:
        share = {s: left * w / sum(v for k, v in weights.items() if k not in capped) for s, w in weights.items() if s not in capped}
        over = {s: 2.0 * by.get_group(s)["size"].sum() for s, t in share.items() if t > 2 * by.get_group(s)["size"].sum()}
        if not over:
            break
        capped |= over
        left -= sum(over.values())
    for source, rows in by:
        target = {**share, **capped}[source]
        assert rows["target"].iloc[0] == pytest.approx(target)
        assert abs(rows["taken"].sum() - target) <= rows["size"].max()


def test_newton_with_base_rates(spark):
    groups = spark.createDataFrame([("a", 0.5, 100.0), ("a", 1.5, 50.0), ("b", 1.0, 10.0)], "source string, base double, tokens double")
    targets = spark.createDataFrame([("a", 160.0), ("b", 20.0)], "source string, target double")
    rows = {(r.source, r.base): r.rate for r in mixing.balanced_rates(groups, targets, 2.0).collect()}
    assert 100 * rows["a", 0.5] + 50 * rows["a", 1.5] == pytest.approx(160)
    assert rows["a", 0.5] == pytest.approx(0.64) and rows["a", 1.5] == pytest.approx(1.92) and rows["b", 1.0] == pytest.approx(2.0, abs=1e-6)


def test_language_held_out(spark, docs):
    found = result(spark, "op9_language").set_index("doc_id")
    truth = docs["lang"].reindex(found.index)
    assert (found["held_out"] == [fold(i, 4) == 2 for i in found.index]).all()
    assert (found["lang_pred"] == truth)[found["held_out"]].mean() > 0.95


def test_class_scores(spark, docs):
    cut = {i: [*t.encode().lower().split(), b""] for i, t in docs["text"].items()}
    counts = collections.Counter(w for i, words in cut.items() if fold(i, 5) != 1 for w in words)
    n, v = sum(counts.values()), len(counts)
    found = result(spark, "op10_class_model").set_index("doc_id")
    for i, words in cut.items():
        row = found.loc[i]
        assert row["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
    held = found[found["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()  # classes tell more than counts alone


def near_rows(rng, n, group):
    base_text = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = list(base_text) if i < group else [f"v{rng.integers(4000)}" for _ in range(int(rng.integers(1, 60)))]
        for _ in range(int(rng.integers(0, 6)) if i < group else 0):
            words[int(rng.integers(len(words)))] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [jaccard.BLOCK, 16])
def test_jaccard_on_a_hot_group(spark, monkeypatch, block):
    """A third of the rows are near copies of one text, some too far from all others; small blocks split the group."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HOT_COUNT", 20 if block < 100 else jaccard.HOT_COUNT)
    rows = near_rows(np.random.default_rng(block), 240, 80)
    cut = [t.split() for _, t in rows]
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} for w in cut]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(label))


def test_lines_on_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_COUNT", 20)
    rows = near_rows(np.random.default_rng(3), 150, 60)
    cut = [t.split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in cut]
    gone = [any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(i)) for i in range(len(rows))]
    found = lines.deduplicated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in found.collect()} == {i: int(g) for i, g in enumerate(gone)}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)]
    found = base.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}


def test_pipeline(spark, docs):
    """Each stage against a plain version of it, over what the stage before kept."""
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, kept, SF)
    assert {r.doc_id for r in known.select("doc_id").collect()} == set(docs.index)
    single = stages["near_copies"](spark, known, SF)
    cut = {i: t.encode().lower().split() for i, t in docs["text"].items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in cut.items()}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = {k: min(a, b) if x in (a, b) else x for k, x in label.items()}
    left = {i for i, x in label.items() if i == x}
    assert {r.doc_id for r in single.select("doc_id").collect()} == left
    clean = stages["decontamination"](spark, single, SF)
    dirty = {r.doc_id for r in queries.QUERIES["op2_decontaminate"](spark, SF).where("contaminated").select("doc_id").collect()}
    assert {r.doc_id for r in clean.select("doc_id").collect()} == left - dirty
    mixed = stages["source_mix"](spark, clean, SF)
    taken = mixing.mixture(clean)
    copies = {r.doc_id: r.taken // r["size"] if r["size"] else 0 for r in taken.collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: c for i, c in copies.items() if c}
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, c in copies.items() for _ in range(c))
    assert [r.start for r in sorted(out, key=lambda r: r.start)][0] == 0

def test_tree_links_join_what_brute_force_joins():
    """Trees alone, without pivots: the components of a bucket are those of all its pairs, from fewer links than members."""
    rng = np.random.default_rng(3)
    sets = {}
    for cls in range(150):
        own = rng.choice(sets[int(rng.integers(0, cls))], 40, replace=False) if cls and rng.random() < 0.6 else []
        more = rng.integers(1, 1 << 60, int(rng.integers(2, 6)) if len(own) else 44)
        sets[cls] = np.unique(np.concatenate([np.asarray(own, np.int64), more]))
    cls, sizes = np.arange(150), np.array([len(sets[c]) for c in range(150)])
    token = np.concatenate([sets[c].view(np.uint64) for c in range(150)])
    for percent in (80, 85, 95):
        tree = jaccard.SignatureTree(cls, cls.copy(), sizes, jaccard.bitmaps(token, sizes))
        found = list(tree.links(sets, percent))
        linked = [(a, b) for a in sets for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]
        whole, mine = cls.copy(), cls.copy()
        for groups, pairs in ((whole, linked), (mine, found)):
            for a, b in pairs:
                groups[groups == groups[a]] = groups[b]
        same = lambda g: {frozenset(np.flatnonzero(g == x).tolist()) for x in g}
        assert same(whole) == same(mine) and len(found) == 150 - len(same(whole))
