"""Approximate nearest neighbours over balanced posting lists.

Equal vectors are one entry with its smallest vec_ids, so that copies are searched once.  Centroids
are fitted on a bounded sample: the sample is halved until the parts are small, and a few rounds of
k-means with a price on crowded parts keep the lists balanced.  Every entry is then put in the list
of its nearest centroid, and boundary entries, whose further centroids are nearer than a share of the
usual list radius beyond the nearest, in up to ``REPLICAS`` lists.  Lists that the sample leaves too
long are divided the same way, each by centroids fitted on a bounded sample of its own entries, level
by level, so that the number of lists grows with the table.  Centroids are found by an in-memory
graph: each is linked to its nearest neighbours, and a beam of all queries at once moves along the
links.  A query reads the lists whose centroid lies within a ratio of its nearest centroid's
distance.  Of the boundary shares, ratios and beams that reach the recall on the sample, by brute
force, those are taken that read the fewest entries.

Lists longer than ``BLOCK`` are cut into blocks, and their queries into blocks as well, so that no
task holds more than one block of each; distances are then exact, on the original vectors in double
precision.  A query that finds fewer than it asked for is compared with all entries, block by block,
and so are the vectors of other lengths than the most frequent one.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; only
vectors of a query's own length are its candidates; rows with the query's vec_id are its own; a vec_id
given to several rows is that many candidates; ties go to the smaller vec_id; an empty table gives no
rows; columns besides vec_id and embedding are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from terravane.llm.common import table, written
from terravane.llm.topk import usable

EVERY, BEST = 100, 10
#: Rows that centroids, graph, ratio and beam are fitted on, at most.
SAMPLE = 20_000
#: Entries that a list is meant to hold, lists of one level, and entries or queries of a block.
LIST_ROWS, MOST_LISTS, BLOCK = 100, 1_024, 1_024
#: A list is divided again if it holds more than SPLIT entries, by centroids from SPLIT_SAMPLE of them;
#: lists still longer after LEVELS divisions are read in blocks like all others.
SPLIT, SPLIT_SAMPLE, LEVELS = 1_000, 2_000, 4
REPLICAS = 4
#: Shares of the usual list radius by which a further centroid may be farther than the nearest.
BOUNDARIES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4)
LINKS, RECALL = 24, 0.97
RATIOS = tuple(1 + 0.02 * i for i in range(1, 31))
#: Rows that distances are computed for at a time; bounds memory.
AT_ONCE = 256


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _parts(rows: np.ndarray) -> list[np.ndarray]:
    return [rows[at : at + AT_ONCE] for at in range(0, len(rows), AT_ONCE)] or [rows]


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 4) -> np.ndarray:
    parts, leaf = [np.arange(len(sample))], max(1, len(sample) / lists)
    leaves = []
    while parts:
        part = parts.pop()
        if len(part) < 1.5 * leaf or len(part) < 2:
            leaves.append(part)
            continue
        rows = sample[part]
        a, b = rows[0], rows[((rows - rows[0]) ** 2).sum(1).argmax()]
        for _ in range(5):
            order = np.argsort(rows @ (a - b), kind="stable")
            half = len(part) // 2
            b, a = rows[order[:half]].mean(0), rows[order[half:]].mean(0)
        parts += [part[order[:half]], part[order[half:]]]
    centroids = np.array([sample[p].mean(0) for p in leaves])
    price = np.zeros(len(centroids))
    for _ in range(rounds):
        near = np.concatenate([(_distances(part, centroids) + price).argmin(1) for part in _parts(sample)])
        size = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
        price += 0.02 * (size / max(size.mean(), 1e-9) - 1)
    # a centroid of next to nothing would stand on its rows and hide the lists around it
    full = size >= size.mean() / 4
    return centroids[full] if full.any() else centroids


@dataclass
class Index:
    centroids: np.ndarray
    links: np.ndarray  # per centroid, the numbers of its neighbours
    beam: int
    ratio: float
    usual: float  # the middle distance of sample rows to their nearest centroid
    boundary: float = 0.0  # in units of that distance

    def search(self, rows: np.ndarray, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per row, numbers and distances of centroids found along the graph, nearest first."""
        beam = min(beam or self.beam, len(self.centroids))
        found = [_along_graph(part, self.centroids, self.links, beam) for part in _parts(rows)]
        return np.concatenate([n for n, _ in found]), np.concatenate([d for _, d in found])

    def homes(self, rows: np.ndarray) -> list[np.ndarray]:
        """Lists of every row: the nearest, and further ones almost as near."""
        numbers, distances = self.close(rows)
        near = distances <= distances[:, :1] + self.boundary * self.usual
        return [n[k] for n, k in zip(numbers, near)]

    def close(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers, distances = self.search(rows, max(32, 2 * REPLICAS))
        return numbers[:, :REPLICAS], distances[:, :REPLICAS]

    def probes(self, rows: np.ndarray) -> list[np.ndarray]:
        """Lists that each query reads."""
        numbers, distances = self.search(rows)
        near = distances <= self.ratio * np.maximum(distances[:, :1], self.usual)
        return [n[k] for n, k in zip(numbers, near)]


def _along_graph(rows, centroids, links, beam):
    many = len(centroids)
    if beam >= many:
        found = _distances(rows, centroids)
        order = np.argsort(found, axis=1, kind="stable")
        return order, np.take_along_axis(found, order, 1)
    count = len(rows)
    seeds = np.unique(np.linspace(0, many - 1, min(many, beam)).astype(int))
    numbers = np.tile(seeds, (count, 1))
    distances = _distances(rows, centroids[seeds])
    seen = np.zeros((count, many), bool)
    seen[:, seeds] = True
    spread = np.zeros((count, many), bool)
    each, length = np.arange(count)[:, None], (rows * rows).sum(1)
    squares = (centroids * centroids).sum(1)
    step = 4  # beam entries whose links are followed at a time
    while True:
        order = np.argsort(distances, axis=1, kind="stable")[:, :beam]
        numbers, distances = np.take_along_axis(numbers, order, 1), np.take_along_axis(distances, order, 1)
        done = spread[each, numbers] | ~np.isfinite(distances)
        rank = np.argsort(done, axis=1, kind="stable")[:, :step]
        if np.take_along_axis(done, rank, 1).all():
            return numbers, distances
        pick = np.take_along_axis(numbers, rank, 1)
        live = ~np.take_along_axis(done, rank, 1)
        spread[each, pick] = True
        nexts = links[pick].reshape(count, -1)
        fresh_ones = ~seen[each, nexts] & np.repeat(live, links.shape[1], axis=1)
        seen[each, nexts] |= fresh_ones
        dot = np.einsum("nd,nkd->nk", rows, centroids[nexts])
        away = np.sqrt(np.maximum(length[:, None] + squares[nexts] - 2 * dot, 0))
        away[~fresh_ones] = np.inf
        # the same centroid may be reached twice in one step: the later copies go
        first = np.argsort(nexts, axis=1, kind="stable")
        ordered = np.take_along_axis(nexts, first, 1)
        again = np.zeros_like(fresh_ones)
        np.put_along_axis(again, first[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
        away[again] = np.inf
        numbers, distances = np.hstack([numbers, nexts]), np.hstack([distances, away])


def fit(sample: np.ndarray, lists: int, best: int = BEST) -> Index:
    """Centroids and graph, with the boundary, ratio and beam that reach the recall on the sample by the fewest reads."""
    centroids = balanced_centroids(sample, lists)
    many = len(centroids)
    order = np.argsort(_distances(centroids, centroids), axis=1, kind="stable")
    links = order[:, 1 : LINKS + 1] if many > 1 else np.zeros((1, 1), int)
    usual = float(np.median(np.concatenate([_distances(part, centroids).min(1) for part in _parts(sample)])))
    index = Index(centroids, links, many, RATIOS[-1], usual, BOUNDARIES[-1])
    asked = sample[:: max(1, len(sample) // 200)]
    truth = np.concatenate(
        [np.argsort(_distances(part, sample), axis=1, kind="stable")[:, 1 : best + 1] for part in _parts(asked)]
    )
    if not truth.size or many == 1:
        return index
    homes, gaps = index.close(sample)
    gaps = gaps - gaps[:, :1]
    for beam in (64, 128, 256, 512, many):
        beam = min(beam, many)
        numbers, distances = index.search(asked, beam)
        near = distances / np.maximum(distances[:, :1], max(usual, 1e-300))
        # per query, the ratio at which each list is read
        at = np.full((len(asked), many), np.inf)
        np.put_along_axis(at, numbers, near, 1)
        fewest = np.inf
        for boundary in BOUNDARIES:
            held = gaps <= boundary * usual
            size = np.bincount(homes[held], minlength=many)
            # the ratio at which each true neighbour is met first
            lists_of = homes[truth]
            met = np.where(held[truth], np.take_along_axis(at[:, None, :], lists_of, 2), np.inf).min(2)
            for ratio in RATIOS:
                if (met <= ratio).mean() < RECALL:
                    continue
                reads = ((at <= ratio) * size).sum()
                if reads < fewest:
                    fewest, index = reads, Index(centroids, links, beam, ratio, usual, boundary)
                break
        if np.isfinite(fewest) or beam == many:
            break
    return index


def _rows(column) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    many = len(column)
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(many, len(flat) // max(many, 1))


def _own(frame: DataFrame) -> DataFrame:
    """The same rows with columns of their own, to be met with others of the same table."""
    return frame.select(*[F.col(c).alias(c) for c in frame.columns])


def _with_lists(frame: DataFrame, choose) -> DataFrame:
    """frame once per list chosen for its vectors."""

    def place(batches):
        for batch in batches:
            chosen = choose(_rows(batch.column("v"))) if batch.num_rows else []
            lists = pa.array([[str(n) for n in c] for c in chosen], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "lists"])

    schema = StructType([*frame.schema.fields, StructField("lists", ArrayType(StringType()))])
    placed = frame.mapInArrow(place, schema)
    return placed.select(*frame.columns, F.explode("lists").alias("list"))


def _blocks(frame: DataFrame, name: str) -> DataFrame:
    """list, and the number of blocks that its rows make."""
    many = F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("long")
    return _own(frame.groupBy("list").agg(many.alias(name)))


def _upto(count: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))


def entries(vectors: DataFrame, best: int) -> DataFrame:
    """did, v, dims, ids: distinct vectors with their smallest vec_ids and the rows each has.

    One id more than asked for is kept, as one may be the query's own.
    """
    counted = vectors.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("v").orderBy("vec_id")
    first = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best + 1)
    held = F.struct("vec_id", F.least("n", F.lit(best)).cast("long").alias("n"))
    single = first.groupBy("v").agg(F.sort_array(F.collect_list(held)).alias("ids"))
    return single.select(F.monotonically_increasing_id().alias("did"), "v", F.size("v").alias("dims"), "ids")


SUBS = "list string, dims int, centroids array<double>, links array<int>, beam int, ratio double, usual double, boundary double"


def _divided(held: DataFrame, asked: DataFrame, best: int) -> tuple[DataFrame, DataFrame]:
    """Long lists divided by centroids of their own, level by level."""
    for _ in range(LEVELS):
        counts = held.groupBy("list").agg(F.count(F.lit(1)).alias("many"))
        long = written(counts.where(F.col("many") > SPLIT), "long")
        if long.isEmpty():
            break
        order = Window.partitionBy("list").orderBy(F.xxhash64("did"), "did")
        drawn = held.join(_own(long), "list").withColumn("place", F.row_number().over(order))
        drawn = drawn.where(F.col("place") <= SPLIT_SAMPLE).select("list", "many", "v")

        def learn(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            sample, many = _rows(group.column("v")), group.column("many")[0].as_py()
            index = fit(sample, max(2, min(len(sample) // 8, many // LIST_ROWS)), best)
            row = {
                "list": key[0].as_py(),
                "dims": sample.shape[1],
                "centroids": index.centroids.ravel().tolist(),
                "links": index.links.ravel().tolist(),
                "beam": index.beam,
                "ratio": index.ratio,
                "usual": index.usual,
                "boundary": index.boundary,
            }
            kinds = [pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.int32()]
            kinds += [pa.float64()] * 3
            return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), kinds)})

        learned = written(drawn.groupBy("list").applyInArrow(learn, SUBS), "divisions")

        def moved(frame: DataFrame, key: str, choose) -> DataFrame:
            columns = [c for c in frame.columns if c != "list"]
            inside = frame.join(_own(long.select("list")), "list", "left_semi")
            parts = _blocks(inside, "parts")
            dealt = _own(inside.join(parts, "list").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts"))))
            offers = _own(learned.join(_own(parts), "list").withColumn("part", _upto("parts")))

            def place(left: pa.Table, right: pa.Table) -> pa.Table:
                if not left.num_rows:
                    return left.select([*columns, "list"])
                row = {c: right.column(c)[0].as_py() for c in right.column_names}
                centroids = np.array(row["centroids"]).reshape(-1, row["dims"])
                links = np.array(row["links"], int).reshape(len(centroids), -1)
                index = Index(centroids, links, row["beam"], row["ratio"], row["usual"], row["boundary"])
                chosen = choose(index, _rows(left.column("v")))
                rows = np.repeat(np.arange(left.num_rows), [len(c) for c in chosen])
                names = [f"{row['list']}/{n}" for c in chosen for n in c]
                return left.select(columns).take(pa.array(rows)).append_column("list", pa.array(names, pa.string()))

            schema = StructType([frame.schema[c] for c in [*columns, "list"]])
            keys = "list", "part"
            inside = dealt.groupBy(*keys).cogroup(offers.groupBy(*keys)).applyInArrow(place, schema)
            outside = frame.join(_own(long.select("list")), "list", "left_anti").select(*columns, "list")
            return written(outside.unionByName(inside), "divided")

        held = moved(held, "did", Index.homes)
        asked = moved(asked, "row", Index.probes)
    return held, asked


FOUND = "query_row long, query_id long, did long, vec_id long, copy long, score double"


def answers(asked: DataFrame, held: DataFrame, best: int) -> DataFrame:
    """The ``best`` rows for every query among the entries that its lists hold."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            dids, ids, vecs = right.column("did").to_pylist(), right.column("ids").to_pylist(), _rows(right.column("v"))
            # an entry all of whose rows carry one id is none for the query with that id
            only = np.array([i[0]["vec_id"] if len(i) == 1 else 0 for i in ids], np.int64)
            alone = np.array([len(i) == 1 for i in ids])
            queries = zip(left.column("row").to_pylist(), left.column("vec_id").to_pylist(), _rows(left.column("v")))
            for row, own, at in queries:
                away = np.sqrt(((vecs - at) ** 2).sum(axis=1))
                others = np.flatnonzero(~(alone & (only == own)))
                if len(others) > best:
                    bar = np.partition(away[others], best - 1)[best - 1]
                    others = others[away[others] <= bar]
                rows = sorted(
                    (away[e], i["vec_id"], dids[e], copy)
                    for e in others
                    for i in ids[e]
                    if i["vec_id"] != own
                    for copy in range(i["n"])
                )
                found += [(row, own, did, vec_id, copy, score) for score, vec_id, did, copy in rows[:best]]
        kinds = [pa.int64()] * 5 + [pa.float64()]
        names = ["query_row", "query_id", "did", "vec_id", "copy", "score"]
        columns = list(zip(*found)) if found else [()] * 6
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

    blocks, parts = _blocks(held, "blocks"), _blocks(asked, "parts")
    shape = written(blocks.join(parts, "list"), "shape")
    # every block of a list's entries meets every block of its queries once
    entry = held.join(_own(shape), "list").withColumn("block", F.pmod(F.xxhash64("did"), F.col("blocks")))
    entry = _own(entry.withColumn("part", _upto("parts")))
    question = asked.join(_own(shape), "list").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    question = _own(question.withColumn("block", _upto("blocks")))
    keys = "list", "block", "part"
    met = question.groupBy(*keys).cogroup(entry.groupBy(*keys)).applyInArrow(meet, FOUND)
    # an entry in several lists is found once for each
    single = met.groupBy("query_row", "query_id", "did", "vec_id", "copy").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "did", "copy")
    return single.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= best)


def nearest(embeddings: DataFrame, every: int = EVERY, best: int = BEST, sample_rows: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) for the rows whose vec_id ``every`` divides."""
    good = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        usable() & F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0)
    )
    vectors = written(
        good.select(
            F.monotonically_increasing_id().alias("row"),
            "vec_id",
            F.col("embedding").cast("array<double>").alias("v"),
        ),
        "vectors",
    )
    whole = written(entries(vectors, best), "entries")
    lengths = whole.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims, total = (lengths[0]["dims"], lengths[0]["count"]) if lengths else (0, 0)
    usual = F.col("dims") == dims
    drawn = whole.where(usual).select("v").orderBy(F.xxhash64("v"), "did").limit(sample_rows).toArrow()
    sample = _rows(drawn.column("v")) if drawn.num_rows else np.zeros((1, max(dims, 1)))
    index = fit(sample, max(1, min(MOST_LISTS, total // LIST_ROWS, len(sample) // 8)), best)

    questions = vectors.where(F.col("vec_id") % every == 0).withColumn("dims", F.size("v"))
    held = written(_with_lists(_own(whole.where(usual).select("did", "v", "ids")), index.homes), "postings")
    asked = written(_with_lists(_own(questions.where(usual).drop("dims")), index.probes), "asked")
    held, asked = _divided(held, asked, best)
    found = written(answers(asked, held, best), "found")

    # what no list could answer in full, and all vectors of other lengths, meet every entry of their length
    enough = found.where(F.col("rank") == best).select(F.col("query_row").alias("row"))
    short = written(questions.join(enough, "row", "left_anti"), "short")
    if not short.isEmpty():
        by_length = F.col("dims").cast("string")
        again = answers(
            short.withColumn("list", by_length).drop("dims"), whole.withColumn("list", by_length).drop("dims"), best
        )
        partial = _own(short.select(F.col("row").alias("query_row")))
        found = found.join(partial, "query_row", "left_anti").unionByName(again.select(*found.columns))
    return found.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
