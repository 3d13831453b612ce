"""Embedding near-duplicates by product quantisation.

Unit vectors lie in coarse inverted lists; a stored vector is its list and the codes of its residual in
each subspace. A query visits every list that can hold a vector within the radius, adds up table
lookups per stored code, and drops what is too far even if all of the code's own error helped; exact cosines
in double precision decide the rest. Both bounds are certain, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import components, cut_lineage, local_roots, named

# The quantiser is fitted on at most SAMPLE vectors; all vectors are indexed with it.
SAMPLE, SUBSPACES, CODES, ROUNDS = 4096, 8, 256, 8
# Stored vectors per list (the number of lists follows from it), per tile of a crowded list, and queries per tile.
LIST_ROWS, BASE_TILE, QUERY_TILE, QUERIES_AT_ONCE = 4096, 1024, 2048, 256
SLACK = 1e-3  # for single-precision tables


def k_means(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres after a fixed number of rounds from a seeded start."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(points, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * points @ centres.T, 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squares(points, centres).argmin(1)


def units(vectors: pd.Series, dims: int) -> np.ndarray:
    """Unit vectors in double precision, padded to ``dims``; scaled first, so that no square overflows."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        v = np.asarray(v, np.float64)
        out[i, : len(v)] = v / np.abs(v).max()
    return out / np.sqrt((out**2).sum(1, keepdims=True))


@dataclass
class Quantiser:
    centres: np.ndarray
    books: list[np.ndarray]

    def part(self, i: int) -> slice:
        width = -(-self.centres.shape[1] // len(self.books))
        return slice(i * width, (i + 1) * width)

    def probes(self, points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """The list of each point, and which lists can hold a point within the radius: those whose border is as near."""
        d2 = squares(points, self.centres)
        own = d2.argmin(1)
        between = np.sqrt(squares(self.centres, self.centres))
        border = np.full(d2.shape, -np.inf)
        # A point of another list lies beyond the borders towards all lists that are nearer to this point.
        for rival in np.argsort(d2, axis=1)[:, :4].T:
            gap = d2 - np.take_along_axis(d2, rival[:, None], 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                border = np.fmax(border, np.where(between[rival] > 0, gap / (2 * between[rival]), -np.inf))
        return own, border <= radius + 1e-9

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.stack([nearest(residuals[:, self.part(i)], book) for i, book in enumerate(self.books)], axis=1).astype(np.uint8)
        back = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((residuals - back) ** 2).sum(1))

    def lookups(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of query residuals to coded ones by tables."""
        out = np.zeros((len(residuals), len(codes)), np.float32)
        for i, book in enumerate(self.books):
            out += squares(residuals[:, self.part(i)], book).astype(np.float32)[:, codes[:, i]]
        return out


def fit(sample: np.ndarray, lists: int, seed: int = 5) -> Quantiser:
    dims = sample.shape[1]
    centres = k_means(sample, lists, seed)
    residuals = sample - centres[nearest(sample, centres)]
    count = min(SUBSPACES, dims)
    count = -(-dims // -(-dims // count))
    out = Quantiser(centres, [np.zeros((1, 1))] * count)
    out.books = [k_means(residuals[:, out.part(i)], CODES, seed + i) for i in range(count)]
    return out


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98
) -> DataFrame:
    """One row per vector: ``id, n_links, component_id, kept``.

    Vectors link if their labels and lengths are equal and their cosine is at least ``cosine``. One that is null, empty,
    zero, has a null or non-finite component or a null label links with nothing and is kept. Equal vectors of a label are
    stored once with their number, so copies are counted, not listed; the smallest id of a group is
    its ``component_id``, null only if it has no other. Repeated ids are vectors of their own.
    """
    spark = vectors.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    base = vectors.select(named(id_col).alias("id"), named(label_col).alias("label"), named(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    base = base.withColumn("valid", valid)
    classes = base.filter("valid").groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("v")))
    total, dims, groups = classes.agg(F.count(F.lit(1)), F.max("dims"), F.count_distinct("label", "dims")).first()
    if total:
        sample = classes.orderBy(F.xxhash64("v"), "node").limit(SAMPLE).select("v").toPandas()["v"]
        quantiser = fit(units(sample, dims), max(1, total // groups // LIST_ROWS + 1) * 4)
        found = cut_lineage(_links(classes, quantiser, dims, cosine, radius))
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        classes = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        classes = cut_lineage(classes.select("label", "v", "n", "least", "links", "root"))
        # Stored, so that a group of very many vectors can be split in the join.
        smallest = cut_lineage(classes.groupBy("root").agg(F.min("least").alias("component")))
        classes = classes.join(smallest, "root").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    else:
        classes = spark.createDataFrame([], base.select("label", "v", F.lit(0).cast("long").alias("links"), F.col("id").alias("component")).schema)
    out = base.filter("valid").join(classes, ["label", "v"]).select("id", "links", "component").union(
        base.filter("NOT valid").select("id", F.lit(0).cast("long"), "id")
    )
    return out.select("id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def _links(classes: DataFrame, quantiser: Quantiser, dims: int, cosine: float, radius: float) -> DataFrame:
    """``node, links, root``: partial link numbers of a node, and the first node it reaches, per tile of a list."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            points = units(f["v"], dims)
            own, probe = quantiser.probes(points, radius)
            codes, error = quantiser.encode(points - quantiser.centres[own])
            yield f[["node", "label", "dims", "v", "n"]].assign(
                own=own, probes=[np.flatnonzero(p) for p in probe], codes=[c.tobytes() for c in codes], error=error
            )

    label = classes.schema["label"].dataType.simpleString()
    placed = cut_lineage(classes.select("node", "label", "dims", "v", "n").mapInPandas(
        place, f"node bigint, label {label}, dims int, v array<double>, n bigint, own int, probes array<int>, codes binary, error double"
    ))
    lists = ["label", "dims", "list"]
    stored = placed.withColumnRenamed("own", "list").select("node", *lists, "v", "n", "codes", "error", F.lit(False).alias("query"))
    asking = placed.withColumn("list", F.explode("probes")).select(
        "node", *lists, "v", "n", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"), F.lit(True).alias("query")
    )
    sizes = stored.select(*lists, "query").union(asking.select(*lists, "query")).groupBy(*lists).agg(
        F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("query")) / BASE_TILE)).cast("int").alias("t"),
        F.greatest(F.lit(1), F.ceil(F.count_if("query") / QUERY_TILE)).cast("int").alias("u"),
    )
    rows = stored.union(asking).join(cut_lineage(sizes), lists)
    own_t, own_u = F.pmod(F.xxhash64("node"), F.col("t")).cast("int"), F.pmod(F.xxhash64("node"), F.col("u")).cast("int")
    # A stored vector stands in one row of tiles, a query in one column; each pair meets in one tile.
    tiles = F.when(F.col("query"), F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda x: x * 1_000_000 + own_u)).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("u") - 1), lambda x: own_t * 1_000_000 + x)
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        stored, asking = frame[~frame["query"]], frame[frame["query"]]
        if not len(stored) or not len(asking):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        x, y = units(stored["v"], dims), units(asking["v"], dims)
        centre = quantiser.centres[int(frame["list"].iloc[0])]
        codes = np.frombuffer(b"".join(stored["codes"]), np.uint8).reshape(len(stored), -1)
        reach = ((radius + stored["error"].to_numpy() + SLACK) ** 2).astype(np.float32)
        node_x, node_y, weight = stored["node"].to_numpy(), asking["node"].to_numpy(), stored["n"].to_numpy()
        links, pairs = np.zeros(len(y), np.int64), []
        for low in range(0, len(y), QUERIES_AT_ONCE):
            part = y[low : low + QUERIES_AT_ONCE]
            q, b = np.nonzero(quantiser.lookups(part - centre, codes) <= reach[None])
            # Exact cosines of the survivors, in double precision.
            near = np.concatenate([
                (part[q[i : i + 65536]] * x[b[i : i + 65536]]).sum(1) >= cosine for i in range(0, len(q), 65536)
            ] or [np.zeros(0, bool)])
            q, b = q[near] + low, b[near]
            other = node_y[q] != node_x[b]
            q, b = q[other], b[other]
            np.add.at(links, q, weight[b])
            pairs.append((q, b))
        q, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
        nodes, at = np.unique(np.concatenate([node_y, node_x]), return_inverse=True)
        root = nodes[local_roots(len(nodes), at[: len(y)][q], at[len(y) :][b])]
        total = np.zeros(len(nodes), np.int64)
        np.add.at(total, at[: len(y)], links)
        some = (total > 0) | (root != nodes)
        return pd.DataFrame({"node": nodes[some], "links": total[some], "root": root[some]})

    dealt = rows.select("node", *lists, "v", "n", "codes", "error", "query", F.explode(tiles).alias("tile"))
    return dealt.groupBy(*lists, "tile").applyInPandas(compare, "node bigint, links bigint, root bigint")
