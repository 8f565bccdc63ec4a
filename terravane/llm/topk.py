"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are dealt into blocks of bounded size and so are the queries; every block of queries
meets every block of candidates once.  A block keeps one sorted list per component, read from the
top for queries with a positive weight there and from the bottom for those with a negative one.
All lists are read to the same depth, in steps.  After each step a candidate's upper bound takes the
list's last read value for components not read yet, its lower bound the value at the list's far
end.  Once the outsiders' upper bounds lie below the k-th best lower bound, reading stops for a query
and the final scores of the candidates left are resolved.  The bounds of a step are matrix products
over clipped components, so all queries of a block read together.

The first block of candidates is read first.  A query's k-th best score there is a lower bound that
holds for the whole table; it is written and joined to the query in all other blocks, where only
candidates whose upper bound reaches it stay.

Defined cases: vectors that are null or hold null or non-finite components take no part; only vectors
of a query's own length are its candidates; rows with the query's vec_id are its own and no
candidates; a vec_id given to several rows is that many candidates, and each query row has its own
ranking; ties go to the smaller vec_id.  Numbers too large for exact doubles are computed as exact
integers; a score beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.llm.common import table, written

EVERY, BEST, SCALE = 50, 5, 256
#: Rows of a block; small tables are still dealt over LEAST_BLOCKS blocks of FEWEST rows or more.
CANDIDATE_BLOCK, QUERY_BLOCK, LEAST_BLOCKS, FEWEST = 4_096, 1_024, 24, 128
#: Shares of the lists read step by step.  In isotropic vectors bounds fall late, in clustered ones early.
DEPTHS = (0.05, 0.2, 0.5, 0.6, 0.7, 0.8, 0.9)
RESOLVE = 64  # candidates left per query at which reading on costs more than resolving them
RESULT = "query_row long, query_id long, vec_id long, score long"


def usable(vector: str = "embedding") -> Column:
    """True where the vector and all its components are there and finite."""
    whole = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    return F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False)) & (F.size(vector) > 0)


def scaled_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, dims, v: components as floor(scale * x)."""
    good = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        usable() & F.col("vec_id").isNotNull()
    )
    return good.select(
        F.monotonically_increasing_id().alias("row"),
        "vec_id",
        F.size("embedding").alias("dims"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )


def _matrix(found: pa.Table, column: str, dims: int) -> np.ndarray:
    flat = found.column(column).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dims)


def _exact(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, as integers."""
    largest = float(np.abs(queries.astype(float)).max()) * float(np.abs(candidates.astype(float)).max())
    if largest * queries.shape[1] < 2.0**53:
        return (queries.astype(float) @ candidates.astype(float).T).astype(np.int64)
    return queries.astype(object) @ candidates.astype(object).T


def block_top(
    query_ids: np.ndarray,
    queries: np.ndarray,
    ids: np.ndarray,
    candidates: np.ndarray,
    best: int,
    bars: np.ndarray | None = None,
    by_bounds: list[int] | None = None,
) -> list[tuple[int, int, int]]:
    """(query number, candidate number, score) of each query's best candidates of the block.

    Candidates below a query's bar, a lower bound for its k-th best score of the whole table, may be
    left out.  The numbers of queries settled by bounds before their lists' ends go to ``by_bounds``.
    """
    size, dims = candidates.shape
    own = query_ids[:, None] == ids[None, :]
    lists = np.sort(candidates.astype(float), axis=0)
    lowest, highest = lists[0], lists[-1]
    weights, values = queries.astype(float), candidates.astype(float)
    rising, falling = np.maximum(weights, 0), np.minimum(weights, 0)
    # room for the rounding of sums of doubles, nothing while sums are exact
    reach = float(np.abs(weights).max()) * float(np.abs(values).max()) * dims
    slack = 0.0 if reach < 2.0**53 else reach * dims * 2.0**-50
    carried = np.full(len(queries), -np.inf) if bars is None else bars - slack
    open_queries = np.arange(len(queries))
    found: list[tuple[int, int, int]] = []

    def resolve(number: int, left: np.ndarray) -> None:
        """Final scores of the candidates left, best first."""
        left = left[~own[number, left]]
        if not len(left):
            return
        scores = _exact(queries[number : number + 1], candidates[left])[0]
        order = sorted(range(len(left)), key=lambda i: (-scores[i], ids[left[i]]))[:best]
        found.extend((number, int(left[i]), int(scores[i])) for i in order)

    for depth in DEPTHS:
        read = int(size * depth)
        if read < 1 or size <= RESOLVE:
            continue
        top, bottom = lists[size - read], lists[read - 1]
        up, down = rising[open_queries], falling[open_queries]
        upper = up @ np.maximum(values, top).T + down @ np.minimum(values, bottom).T + slack
        upper[own[open_queries]] = -np.inf
        bar = carried[open_queries]
        bare = np.flatnonzero(np.isinf(bar))
        if len(bare) and size > best:
            lower = (
                up[bare] @ np.where(values >= top, values, lowest).T
                + down[bare] @ np.where(values <= bottom, values, highest).T
                - slack
            )
            lower[own[open_queries[bare]]] = -np.inf
            bar[bare] = np.partition(lower, size - best, axis=1)[:, size - best]
        possible = (upper >= bar[:, None]) & ~own[open_queries]
        settled = possible.sum(axis=1) <= RESOLVE
        if by_bounds is not None:
            by_bounds.extend(open_queries[settled].tolist())
        for place in np.flatnonzero(settled):
            resolve(int(open_queries[place]), np.flatnonzero(possible[place]))
        open_queries = open_queries[~settled]
        if not len(open_queries):
            return found
    # the lists are read to their ends: every bound is the score itself
    scores = _exact(queries[open_queries], candidates)
    for place, number in enumerate(open_queries):
        line = scores[place]
        mine = np.flatnonzero(~own[number])
        if not len(mine):
            continue
        if len(mine) > best:
            kept = line[mine]
            bar = np.sort(kept)[-best] if kept.dtype == object else np.partition(kept, -best)[-best]
            mine = mine[kept >= bar]
        order = sorted(mine, key=lambda i: (-line[i], ids[i]))[:best]
        found.extend((int(number), int(i), int(line[i])) for i in order)
    return found


def _dealt(rows: int, size: int, least: int) -> int:
    return max(-(-rows // size), min(least, rows // FEWEST), 1)


def top_inner_products(
    embeddings: DataFrame, every: int = EVERY, best: int = BEST, scale: int = SCALE
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id ``every`` divides."""
    vectors = written(scaled_vectors(embeddings, scale), "vectors")
    asked = vectors.where(F.col("vec_id") % every == 0)
    across = _dealt(vectors.count(), CANDIDATE_BLOCK, LEAST_BLOCKS)
    down = _dealt(asked.count(), QUERY_BLOCK, 1)

    def numbers(count: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    # every block of queries to every block of candidates, each pair one bounded group; the numbers
    # of blocks are long on both sides, as equal numbers of different types hash differently
    questions = asked.withColumn("q", F.pmod(F.xxhash64("row", F.lit("q")), F.lit(down).cast("long"))).withColumn(
        "c", numbers(across)
    )
    candidates = vectors.withColumn("c", F.pmod(F.xxhash64("row", F.lit("c")), F.lit(across).cast("long"))).withColumn(
        "q", numbers(down)
    )

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            columns = [[], [], [], []]
        else:
            dims = key[2].as_py()
            query_ids, ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            # scores and bars beyond exact doubles are bounds still: one step down is below them
            bars = left.column("bar").cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy()
            bars = np.where(np.abs(bars) < 2.0**53, bars, np.nextafter(bars, -np.inf))
            met = block_top(query_ids, _matrix(left, "v", dims), ids, _matrix(right, "v", dims), best, bars)
            rows = left.column("row").to_numpy()
            columns = [
                [rows[q] for q, _, _ in met],
                [query_ids[q] for q, _, _ in met],
                [ids[c] for _, c, _ in met],
                [s for _, _, s in met],
            ]
        names = ["query_row", "query_id", "vec_id", "score"]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")

    def ranked(met: DataFrame) -> DataFrame:
        return met.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= best)

    def against(asking: DataFrame, offered: DataFrame) -> DataFrame:
        keys = "q", "c", "dims"
        return ranked(asking.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(meet, RESULT))

    opening = F.col("c") == 0
    bare = questions.where(opening).withColumn("bar", F.lit(None).cast("long"))
    found = written(against(bare, candidates.where(opening)), "opening")
    if across > 1:
        # one row per query: the bar that its first block of candidates sets
        bars = found.where(F.col("rank") == best).select(F.col("query_row").alias("row"), F.col("score").alias("bar"))
        later = questions.where(~opening).join(bars, "row", "left")
        # columns of their own, as both sides come from one table
        later = later.select(*[F.col(c).alias(c) for c in later.columns])
        others = against(later, candidates.where(~opening))
        found = ranked(found.drop("rank").unionByName(others.drop("rank")))
    return found.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))


SQL = """
with v as (
  select vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] as c from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select q.vec_id as query_id, v.vec_id,
         list_dot_product(q.c::DOUBLE[], v.c::DOUBLE[])::BIGINT as score
  from v q, v where q.vec_id % 50 = 0 and v.vec_id <> q.vec_id and len(v.c) = len(q.c))
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::INT as rank from scored)
where rank <= 5
"""
