"""Approximate nearest neighbours by balanced posting lists around centroids searched on a graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialize

SAMPLE = 40_000
MAX_CENTROIDS = 4_096
SWEEPS = 12
BALANCE = 0.3
DEGREE = 32
ENTRIES = 16
REPLICAS = 4
COPY_RATIO = 1.06
PROBE_RATIO = 1.25
PROBE_SHARE = 0.28
LEAST_PROBES = 96
ANCHOR = 7
CELL_ROWS = 2_000
QUERIES_PER_SALT = 1_000
GROUP_SALTS = 12


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def balanced_centroids(sample: np.ndarray, n: int, sweeps: int = SWEEPS) -> np.ndarray:
    """k-means whose assignment pays for crowded clusters, so that posting lists come out alike in length."""
    rng = np.random.default_rng(7)
    centroids = sample[rng.choice(len(sample), n, replace=False)].copy()
    share = len(sample) / n
    crowd = np.ones(n)
    for _ in range(sweeps):
        sizes, sums, scale = np.zeros(n), np.zeros_like(centroids), 0.0
        for begin in range(0, len(sample), 4096):
            part = sample[begin : begin + 4096]
            d = distances(part, centroids)
            scale = scale or float(d.min(1).mean())
            of = (d + BALANCE * scale * (crowd - 1)).argmin(1)
            sizes += np.bincount(of, minlength=n)
            np.add.at(sums, of, part)
        some = sizes > 0
        centroids[some] = sums[some] / sizes[some, None]
        lost = np.flatnonzero(~some)
        centroids[lost] = sample[rng.choice(len(sample), len(lost))]
        crowd = 0.5 * crowd + 0.5 * sizes / share
    return centroids


@dataclass(frozen=True)
class CentroidGraph:
    """Centroids with links to near ones that no nearer link already leads to, searched from a few entries."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, degree: int = DEGREE) -> CentroidGraph:
        n = len(centroids)
        near = min(n - 1, 3 * degree)
        links = np.full((n, 2 * degree), -1)
        chosen: list[list[int]] = [[] for _ in range(n)]
        for begin in range(0, n, 512):
            d = distances(centroids[begin : begin + 512], centroids)
            d[np.arange(len(d)), np.arange(begin, begin + len(d))] = np.inf
            order = np.argsort(d, axis=1)[:, :near]
            for i, row in enumerate(order):
                between = distances(centroids[row], centroids[row])
                kept: list[int] = []
                for j in range(len(row)):
                    if len(kept) < degree // 2 and all(between[j, k] > d[i, row[j]] for k in kept):
                        kept.append(j)
                kept += [j for j in range(len(row)) if j not in kept][: degree - len(kept)]
                chosen[begin + i] = [int(row[j]) for j in kept]
        back: list[list[int]] = [[] for _ in range(n)]
        for i, row in enumerate(chosen):
            for j in row:
                back[j].append(i)
        for i in range(n):
            row = list(dict.fromkeys(chosen[i] + back[i]))[: 2 * degree]
            links[i, : len(row)] = row
        entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(int))
        return cls(centroids, links, entries)

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) found nearest to each vector, nearest first; -1 and inf fill short rows."""
        m, n = len(vectors), len(self.centroids)
        beam = min(beam, n)
        seen = np.zeros((m, n + 1), bool)
        ids = np.full((m, beam), -1)
        dist = np.full((m, beam), np.inf)
        done = np.ones((m, beam), bool)
        new = np.broadcast_to(self.entries, (m, len(self.entries)))
        rows = np.arange(m)
        while True:
            live = new >= 0
            live &= ~seen[rows[:, None], new]
            diff = self.centroids[new] - vectors[rows][:, None]
            d = np.where(live, np.einsum("ijk,ijk->ij", diff, diff), np.inf)
            seen[rows[:, None], np.where(live, new, n)] = True
            all_ids = np.concatenate([ids[rows], np.where(live, new, -1)], 1)
            all_d = np.concatenate([dist[rows], d], 1)
            all_done = np.concatenate([done[rows], ~live], 1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            take = np.arange(len(rows))[:, None]
            ids[rows], dist[rows], done[rows] = all_ids[take, order], all_d[take, order], all_done[take, order]
            rows = np.flatnonzero((~done).any(1))
            if not len(rows):
                return ids, np.sqrt(dist)
            at = (~done[rows]).argmax(1)
            done[rows, at] = True
            new = self.links[ids[rows, at]]


@dataclass(frozen=True)
class Lists:
    """What assignment and search share.  ``reach`` is the largest squared length of an indexed vector.

    A vector x is placed at (x, sqrt(reach - |x|^2)), a query q at (q, 0): then the largest inner product is the
    smallest distance.
    """

    graph: CentroidGraph
    reach: float

    def placed(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.reach - (vectors * vectors).sum(1), 0))
        return np.concatenate([vectors, rest[:, None]], 1)

    def homes(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The nearest cluster of each vector, and for one near a boundary those about as near, COPY_RATIO at most."""
        out = []
        for begin in range(0, len(vectors), 256):
            ids, dist = self.graph.search(self.placed(vectors[begin : begin + 256]), 8 * REPLICAS)
            near = (ids[:, :REPLICAS] >= 0) & (dist[:, :REPLICAS] <= COPY_RATIO * dist[:, :1])
            out += [row[:REPLICAS][keep] for row, keep in zip(ids, near, strict=True)]
        return out

    def probes(self, queries: np.ndarray, ratio: float, share: float) -> list[np.ndarray]:
        """Clusters whose centroid is at most ``ratio`` times as far as a near one, the nearest few being always in.

        The near one is that of rank ANCHOR, so that a query on top of a lone centroid still looks around.
        """
        most = max(LEAST_PROBES, int(share * len(self.graph.centroids)))
        length = np.sqrt((queries * queries).sum(1, keepdims=True))
        scaled = queries * (np.sqrt(self.reach) / length)  # a query's length does not change its ranking
        flat = np.concatenate([scaled, np.zeros((len(queries), 1))], 1)
        out = []
        for begin in range(0, len(flat), 256):
            ids, dist = self.graph.search(flat[begin : begin + 256], most)
            bound = ratio * dist[:, min(ANCHOR, dist.shape[1] - 1)]
            bound = np.where(np.isfinite(bound), bound, np.inf)
            out += [row[(row >= 0) & (d <= b)] for row, d, b in zip(ids, dist, bound, strict=True)]
        return out


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows with an id and a vector of finite components, not all zero."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & fine).select(F.col(id_col).alias("id"), x.alias("vec"))


def grouped(df: DataFrame, k: int) -> DataFrame:
    """(rep, vec, ids): equal vectors as one, with a number of its own and their k + 1 smallest ids, all a top k can use.

    An id may own several vectors, so no id names one.  The number is fixed once the table is written.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(GROUP_SALTS))
    rows = df.distinct().withColumn("salt", salt)
    for keys in (["vec", "salt"], ["vec"]):
        rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("turn") <= k + 1)
    ids = rows.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return ids.select(F.monotonically_increasing_id().alias("rep"), "vec", "ids")


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def placer(shared, columns: list[str], probing: tuple[float, float] | None):
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = matrix(frame["vec"])
            found = shared.value.probes(x, *probing) if probing else shared.value.homes(x)
            at = np.repeat(np.arange(len(frame)), [len(f) for f in found])
            out = frame.iloc[at][columns].reset_index(drop=True)
            out.insert(0, "cluster", np.concatenate(found))
            yield out

    return place


def nearest_in_cell(k: int):
    def nearest(key, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"qrep": [], "rep": [], "score": [], "equal": [], "ids": []})
        q, v = matrix(queries["vec"]), matrix(vectors["vec"])
        rep = vectors["rep"].to_numpy()
        first = np.fromiter((x[0] for x in vectors["ids"]), np.int64, len(vectors))
        out = []
        for begin in range(0, len(q), 512):
            part = q[begin : begin + 512]
            rough = part @ v.T
            keep = min(len(v), k + 8)
            top = np.argpartition(-rough, keep - 1, axis=1)[:, :keep]
            # Every vector that ties with the last one kept stays in the running.
            edge = np.take_along_axis(rough, top, 1).min(1)
            row, col = np.nonzero(rough >= (edge - 1e-9 * np.abs(edge))[:, None])
            exact = (part[row] * v[col]).sum(1)
            order = np.lexsort((rep[col], first[col], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            turn = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, exact = (a[turn <= k] for a in (row, col, exact))
            equal = (part[row] == v[col]).all(1)
            found = {"qrep": queries["rep"].to_numpy()[begin + row], "rep": rep[col], "score": exact, "equal": equal}
            out.append(pd.DataFrame({**found, "ids": vectors["ids"].to_numpy()[col]}))
        return pd.concat(out)

    return nearest


def fit_lists(vectors: DataFrame, n: int, sample: int = SAMPLE) -> Lists:
    """Fit on at most about ``sample`` distinct vectors; all are indexed later."""
    reach = vectors.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0]
    drawn = vectors.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n)))
    x = drawn.orderBy(F.xxhash64("vec"), "vec").select("vec").toPandas()["vec"]
    x = matrix(x) if len(x) else matrix(vectors.limit(1).toPandas()["vec"])
    clusters = int(min(MAX_CENTROIDS, len(x), max(1, 2 * n**0.5)))
    rest = np.sqrt(np.maximum(reach - (x * x).sum(1), 0))
    placed = np.concatenate([x, rest[:, None]], 1)
    return Lists(CentroidGraph.build(balanced_centroids(placed, clusters)), reach)


def nearest_neighbours(
    base: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", ratio: float = PROBE_RATIO, share: float = PROBE_SHARE
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of ``base`` with the largest inner product found.

    Every distinct (id, vector) of ``queries`` is a query, so an id with two vectors has two lists of ranks.  A query does
    not find its own row; a row that shares its id but not its vector, or its vector but not its id, it does.  Scores are sums of products in double precision over the original
    vectors; ties go to smaller ids.  Rows with null id, and vectors that are null, empty, zero, or hold a null or
    non-finite component, take no part; nor do vectors of another length than most.  Repeated rows count once.
    With fewer than k other rows all are returned; without usable rows, none.  Other columns are ignored.

    Equal vectors are searched as one.  Posting lists are split into cells of bounded size, each met by the queries
    that probe its list, again in bounded parts.
    """
    spark = base.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    fine = usable(base, id_col, vec_col)
    lengths = fine.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    d = lengths[0]["d"]
    vectors = materialize(grouped(fine.where(F.size("vec") == d), k), "vectors")
    n = vectors.count()
    lists = fit_lists(vectors, n)
    shared = spark.sparkContext.broadcast(lists)
    kind = dict(vectors.dtypes)["vec"]
    postings = vectors.mapInPandas(placer(shared, ["rep", "vec", "ids"], None), f"cluster int, rep long, vec {kind}, ids array<long>")
    postings = materialize(postings, "postings")
    asked = usable(queries, id_col, vec_col).where(F.size("vec") == d).distinct()
    asked = materialize(asked.withColumn("qkey", F.xxhash64("vec")), "asked")
    reps = asked.groupBy("vec").agg(F.count(F.lit(1)).alias("n")).withColumn("rep", F.monotonically_increasing_id())
    reps = materialize(reps, "query-vectors")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    probes = reps.select("rep", "vec").repartition(tasks).mapInPandas(placer(shared, ["rep", "vec"], (ratio, share)), f"cluster int, rep long, vec {kind}")
    probes = materialize(probes, "probes")

    parts = lambda df, name: df.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias(name))
    cells = F.broadcast(parts(postings, "vparts").join(parts(probes, "qparts"), "cluster"))  # a row per centroid
    split = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(cells, "cluster").withColumn("qpart", split("rep", "qparts")).withColumn("vpart", every("vparts"))
    right = postings.join(cells, "cluster").withColumn("vpart", split("rep", "vparts")).withColumn("qpart", every("qparts"))
    key = ["cluster", "qpart", "vpart"]
    met = left.select(*key, "rep", "vec").groupBy(*key).cogroup(right.select(*key, "rep", "vec", "ids").groupBy(*key))
    found = met.applyInPandas(nearest_in_cell(k), "qrep long, rep long, score double, equal boolean, ids array<long>")
    best = lambda *by: F.row_number().over(Window.partitionBy("qrep").orderBy(F.desc("score"), *by))
    found = found.dropDuplicates(["qrep", "rep"]).withColumn("turn", best(F.get("ids", F.lit(0)), "rep")).where(F.col("turn") <= k + 1)
    named = found.select("qrep", "score", "equal", F.explode("ids").alias("vec_id"))
    named = named.withColumn("turn", best("vec_id")).where(F.col("turn") <= k + 1)
    answer = named.groupBy("qrep").agg(F.sort_array(F.collect_list(F.struct("turn", "vec_id", "score", "equal"))).alias("answer"))

    salts = F.ceil(F.col("n") / QUERIES_PER_SALT).cast("int")
    answer = reps.select(F.col("rep").alias("qrep"), "vec", salts.alias("salts")).join(answer, "qrep").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    sizes = reps.select(F.col("vec").alias("v"), salts.alias("s"))
    ids = asked.join(sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("s") - 1))), (F.col("vec") == F.col("v")) & (F.pmod(F.xxhash64("id"), F.col("s")) == F.col("salt")))
    ids = ids.select(F.col("id").alias("query_id"), "vec", "salt")
    others = F.slice(F.filter("answer", lambda x: ~x["equal"] | (x["vec_id"] != F.col("query_id"))), 1, k)
    out = ids.join(answer, ["vec", "salt"]).select("query_id", F.posexplode(others).alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
