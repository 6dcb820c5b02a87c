"""Operator 7: near-duplicate embeddings by product quantisation with inverted lists.

Unit vectors go to the list of their nearest coarse centroid; what is left
after the centroid is cut into subspaces and coded.  A vector probes every list whose
region begins within half the wanted distance: two vectors of different lists lie
on either side of the plane between their centroids, so if they are within the
distance, one of them is within half of it from that plane and probes the other's
list.  There, one table of its distances to the codebooks gives its approximate
distance to every coded vector.  Each code's own error is kept, so by the triangle
inequality the approximation rules out no pair within the wanted distance; what it
leaves is compared exactly, in double precision.  So no link is missed.

A vector is sent once to each group of near lists, however many of them it
probes.  Equal vectors are one class and enter once.  Each length of vectors has
lists of its own; rare lengths have a single one, in which all are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, table
from quire.llm.components import components

THRESHOLD = 0.95
#: Vectors that train centroids and codebooks, at most; vectors to a list on average; lists, at most.
SAMPLE, LIST_SIZE, MOST_LISTS = 20_000, 256, 4096
#: Lengths of vectors that have a trained index, at most: the most frequent ones.
TRAINED = 8
SUBSPACES, CODES, STEPS = 8, 256, 8
#: Lists to a group, which is searched together.
GROUP = 32
#: A quarter of the members or queries of a group that one task compares.
CHUNK = 2000
LAST_ID = (1 << 63) - 1


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, 1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = STEPS) -> np.ndarray:
    centroids = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        near = np.concatenate([_nearest(x[lo : lo + 4096], centroids) for lo in range(0, len(x), 4096)])
        count = np.bincount(near, minlength=len(centroids))
        sums = np.stack([np.bincount(near, x[:, d], len(centroids)) for d in range(x.shape[1])], 1)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return centroids


def _in_order(centroids: np.ndarray) -> np.ndarray:
    """An order in which near centroids are in the same group of GROUP, by halving along the widest direction."""
    if len(centroids) <= GROUP:
        return np.arange(len(centroids))
    away = centroids - centroids.mean(0)
    order = np.argsort(away @ np.linalg.svd(away, full_matrices=False)[2][0], kind="stable")
    half = (len(order) // GROUP + 1) // 2 * GROUP
    return np.concatenate([part[_in_order(centroids[part])] for part in (order[:half], order[half:])])


class Index:
    """Coarse centroids and a codebook for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centroids = k_means(sample, min(lists, len(sample)), rng)
        self.centroids = self.centroids[_in_order(self.centroids)]
        left = sample - self.centroids[_nearest(sample, self.centroids)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [k_means(left[:, c], min(CODES, len(left)), rng) for c in self.cuts]

    @classmethod
    def of_one_list(cls, size: int) -> Index:
        """An index of vectors of so many components that holds them all in one list and rules out none."""
        return cls(np.zeros((1, size)), 1)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's own list and all lists it probes, the own one among them.

        Of two vectors within the radius, one at least probes the other's own list.
        """
        far = (x**2).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        own = np.argmin(far, 1)
        norm = (self.centroids**2).sum(1)
        apart = np.sqrt(np.maximum(norm[own][:, None] + norm - 2 * self.centroids[own] @ self.centroids.T, 0))
        # The difference of squares is twice the centroids' distance times the distance from the plane between them.
        near = far - far[np.arange(len(x)), own][:, None] <= radius * apart + 1e-6
        return own, [np.flatnonzero(row) for row in near]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each vector is from what its code stands for."""
        left = x - self.centroids[own]
        codes = np.stack([_nearest(left[:, c], book) for c, book in zip(self.cuts, self.books)], 1)
        error = sum(((left[:, c] - book[codes[:, k]]) ** 2).sum(1) for k, (c, book) in enumerate(zip(self.cuts, self.books)))
        return codes.astype(np.uint8), np.sqrt(error)

    def near(self, queries: np.ndarray, which: int, codes: np.ndarray, error: np.ndarray, radius: float) -> np.ndarray:
        """Pairs (code of list which, query) that may be within the radius, by table look-ups.

        A query's distance to a code is -2 times their product, which is in the
        table, and its distance to the centroid, and a number of the code's own.
        """
        centre = self.centroids[which]
        fixed = sum(((book**2).sum(1) + 2 * book @ centre[c])[codes[:, k]] for k, (c, book) in enumerate(zip(self.cuts, self.books)))
        total = (fixed[:, None] + ((queries - centre) ** 2).sum(1)).astype(np.float32)
        doubled = (-2 * queries.T).astype(np.float32)
        for k, (c, book) in enumerate(zip(self.cuts, self.books)):
            # A row of the table per code, so that a look-up copies a row.
            total += (book.astype(np.float32) @ doubled[c])[codes[:, k]]
        return total <= ((radius + error + 1e-3) ** 2).astype(np.float32)[:, None]


def _unit(v: pa.Array) -> np.ndarray:
    x = np.array(v.to_pylist(), np.float64)
    return x / np.sqrt((x**2).sum(1))[:, None]


def _dealing(sent, radius: float, kind: pa.DataType):
    """Each class with its list, code, error and probes. Lists of one length are numbered after those of another."""
    schema = pa.schema([("class", pa.int64()), ("size", pa.int64()), ("v", pa.list_(kind)), ("own", pa.int32()), ("probes", pa.list_(pa.int32())), ("code", pa.binary()), ("error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = pc.list_value_length(whole.column("v")).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths):
                first, index = sent.value[int(length)]
                rows = np.flatnonzero(lengths == length)
                for lo in range(0, len(rows), 1024):
                    batch = whole.take(pa.array(rows[lo : lo + 1024]))
                    x = _unit(batch.column("v"))
                    own, probes = index.probes(x, radius)
                    codes, error = index.encode(x, own)
                    lists = pa.array([(p + first).astype(np.int32) for p in probes], pa.list_(pa.int32()))
                    columns = [batch.column("class"), batch.column("size"), batch.column("v").cast(pa.list_(kind)), pa.array((own + first).astype(np.int32)), lists, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component after a and b are connected; root holds the ones before."""
    while True:
        one, two = root[a], root[b]
        apart = one != two
        if not apart.any():
            return root
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root = root[root]


def _compare(sent, threshold: float):
    """Exact links of one task, queries against members of a group of lists: what they count, and the least class each is connected to."""
    radius = _radius(threshold)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # All vectors of a group of lists have one length.
        numbered, index = sent.value[len(pdf["v"].iloc[0])]
        member = pdf["as_member"].to_numpy()
        size, own = pdf["size"].to_numpy(), pdf["own"].to_numpy() - numbered
        classes, node = np.unique(pdf["class"].to_numpy(), return_inverse=True)
        links, root = np.zeros(len(classes), np.int64), np.arange(len(classes))
        queries = np.flatnonzero(~member)
        if len(queries) and member.any():
            raw = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            norm = np.sqrt((raw**2).sum(1))
            at = np.repeat(queries, [len(p) for p in pdf["probes"].iloc[queries]])
            probed = np.concatenate(pdf["probes"].iloc[queries].to_numpy()) - numbered
            unit = raw[queries] / norm[queries, None]
            for which in np.unique(own[member]):
                q, m = at[probed == which], np.flatnonzero(member & (own == which))
                if not len(q):
                    continue
                codes, error = np.array([np.frombuffer(c, np.uint8) for c in pdf["code"].iloc[m]]), pdf["error"].to_numpy()[m]
                # A member that doesn't probe the query's list can count the pair only here.
                back = np.zeros((len(m), len(index.centroids)), bool)
                for k, p in enumerate(pdf["probes"].iloc[m]):
                    back[k, p - numbered] = True
                for lo in range(0, len(q), 256):
                    part = q[lo : lo + 256]
                    places = np.searchsorted(queries, part)
                    b, a = np.nonzero(index.near(unit[places], which, codes, error, radius))
                    for k in range(0, len(a), 50_000):
                        one, two, of = part[a[k : k + 50_000]], m[b[k : k + 50_000]], b[k : k + 50_000]
                        cosine = np.einsum("ij,ij->i", raw[one], raw[two]) / (norm[one] * norm[two])
                        linked = (cosine >= threshold) & (node[one] != node[two])
                        one, two, of = one[linked], two[linked], of[linked]
                        np.add.at(links, node[one], size[two])
                        alone = (own[one] != which) & ~back[of, own[one]]
                        np.add.at(links, node[two[alone]], size[one[alone]])
                        root = _unite(root, node[one], node[two])
        some = (links > 0) | (root != np.arange(len(classes)))
        return pd.DataFrame({"class": classes[some], "links": links[some], "least": classes[root[some]]})

    return run


def _radius(threshold: float) -> float:
    """The distance of unit vectors whose cosine is the threshold."""
    return math.sqrt(max(2 - 2 * threshold, 0.0))


def _indexes(classes: DataFrame) -> dict[int, tuple[int, Index]]:
    """For each length of vectors, the number of its first list and its index."""
    # A row per length; a table of embeddings has few.
    lengths = classes.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").collect()
    many = [r["length"] for r in lengths if r["count"] >= 2 * LIST_SIZE][:TRAINED]
    out, first = {}, 0
    for r in lengths:
        index = Index.of_one_list(r["length"])
        if r["length"] in many:
            own = classes.filter(F.size("v") == r["length"])
            x = np.array(own.orderBy(F.xxhash64("class")).limit(SAMPLE // len(many)).select("v").toArrow().column("v").to_pylist(), np.float64)
            index = Index(x / np.sqrt((x**2).sum(1))[:, None], min(MOST_LISTS, r["count"] // LIST_SIZE))
        out[r["length"]] = (first, index)
        # Groups of lists hold one length each.
        first += math.ceil(len(index.centroids) / GROUP) * GROUP
    return out


def join(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links counts the other vectors of cosine threshold or more, component_id is
    the least vec_id reachable by links, and kept marks that vector.  Vectors that
    are null, empty or zero, or hold null or non-finite components, are linked
    with nothing.  Vectors of different length have no cosine and aren't linked.
    Rows that repeat are vectors linked with each other; a null vec_id counts as
    the largest.  Other columns are ignored; an empty table gives no rows.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.coalesce("vec_id", F.lit(LAST_ID)).cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = cut(rows.select("vec_id", F.when(fine, F.col("v")).alias("v")))
    classes = rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("size"))
    # Rows of one class may share the least id with another class's, so a class is named by its vector.
    classes = cut(classes.select(F.xxhash64("v").alias("class"), "*"))
    lone = rows.select("vec_id", F.xxhash64("v").alias("_class"), "v")
    sent = classes.sparkSession.sparkContext.broadcast(_indexes(classes))
    packed = classes.select("class", "size", "v")
    deal = _dealing(sent, _radius(threshold), pa.float32() if kind == "float" else pa.float64())
    dealt = cut(packed.mapInArrow(deal, f"class long, size long, v array<{kind}>, own int, probes array<int>, code binary, error double"))
    group_of = lambda p: F.floor(p / GROUP).cast("int")
    home = group_of(F.col("own"))
    visits = dealt.select("*", F.explode(F.array_distinct(F.transform("probes", group_of))).alias("group"))
    sizes = visits.groupBy("group").agg(F.ceil(F.count("*") / (4 * CHUNK)).cast("int").alias("q_chunks"), F.ceil(F.sum((F.col("group") == home).cast("int")) / (4 * CHUNK)).cast("int").alias("m_chunks"))
    # At most MOST_LISTS / GROUP rows.
    visits = visits.join(F.broadcast(sizes), "group").filter("m_chunks > 0")
    hashed = F.hash("class")
    to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    here = F.filter("probes", lambda p: group_of(p) == F.col("group"))
    queries = visits.withColumns({"probes": here, "code": F.lit(None).cast("binary"), "error": F.lit(None).cast("double")})
    queries = queries.select("*", F.lit(False).alias("as_member"), F.pmod(hashed, "q_chunks").alias("i"), to(F.col("m_chunks")).alias("j"))
    members = visits.filter(F.col("group") == home).select("*", F.lit(True).alias("as_member"), to(F.col("q_chunks")).alias("i"), F.pmod(hashed, "m_chunks").alias("j"))
    tasks = queries.unionByName(members.select(queries.columns)).drop("q_chunks", "m_chunks")
    found = cut(tasks.groupBy("group", "i", "j").applyInPandas(_compare(sent, threshold), "class long, links long, least long"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    whole = components(found.filter("class != least").select(F.col("class").alias("a"), F.col("least").alias("b")))
    joined = classes.select("class", "least_id", "size").join(links, "class", "left").join(whole.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    joined = joined.join(least, "component").select("class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    own = F.when(lone["v"].isNotNull(), lone["_class"])
    out = lone.select("vec_id", own.alias("_class")).join(joined, F.col("_class") == joined["class"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(F.nullif("vec_id", F.lit(LAST_ID)).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.nullif(component, F.lit(LAST_ID)).alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings: vec_id, n_links, component_id, kept."""
    return join(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT r, vec_id, x FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
link AS (SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM ok a, ok b WHERE a.r <> b.r AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT r AS a, r AS b FROM ok UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.r LEFT JOIN least ON least.a = v.r
"""
