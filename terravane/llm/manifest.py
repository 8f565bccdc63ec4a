"""Merkle manifest of a dataset, and octopus multiproofs of its rows.

Every row is a leaf, the hash of its fields.  Per source the leaves ascend by id, and every ``FAN``
consecutive nodes of a level become their hash, until one remains; the sources' last nodes, in
order of source, are the leaves of the tree above.  One source may hold most rows: leaves are numbered
from a range-partitioned sort and offsets per partition, and trees are hashed in blocks of
``FAN ** BLOCK_LEVELS`` consecutive nodes, all blocks of all trees at once.

A proof is the list of a leaf's siblings from its run up to the root.  Proofs are made per leaf
partition, an aligned block of one source's leaves, for whatever rows of it are asked for: the
partition first works out the least set of node coordinates which its rows' proofs need and cannot be
derived from its own rows (the octopus), fetches each of these once by one join, derives the interior
nodes its rows share, and expands the proofs on its own.

Defined cases: null fields count as ``-``; rows without an id come first in their source, rows
without a source form a source of their own that comes first; rows that share an id are ordered by
leaf, and equal rows are leaves of their own; a lone leaf is its source's subroot; without rows there
are no nodes and no proofs; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.llm.common import LOWER, UPPER, table, written

FAN, BLOCK_LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def heights(size: int, fan: int = FAN) -> list[int]:
    """Number of nodes of each level, leaves first, one node last."""
    found = [size]
    while found[-1] > 1:
        found.append(-(-found[-1] // fan))
    return found


def missing(known: Sequence[int], size: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, index) of the fewest nodes that, with the known leaves, give all their proofs.

    Level by level, what is known is what was given or can be derived: a run's other nodes are needed
    only if nothing below them is known.
    """
    needed, here = [], np.unique(np.asarray(known, dtype=np.int64))
    for level, width in enumerate(heights(size, fan)[:-1]):
        runs = np.unique(here // fan)
        around = (runs[:, None] * fan + np.arange(fan)).ravel()
        needed += [(level, int(i)) for i in np.setdiff1d(around[around < width], here)]
        here = runs
    return needed


# --- leaves -----------------------------------------------------------------------------------


def _sized(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[_sized(v) for v in values]).cast("binary"), 256)


def leaves(rows: DataFrame) -> DataFrame:
    """row, doc_id, source, leaf and told: the leaf of what is presented for proof (here tampered)."""
    *others, text = [F.col(name) for name in FIELDS]
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changed = F.when(number % 5 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        leaf_hash(*others, text).alias("leaf"),
        F.when(number % 5 == 0, leaf_hash(*others, changed)).alias("told"),
    )


def ordered(frame: DataFrame, group: str, order: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """The rows sorted over all partitions and written, and where each group stands in each of them.

    The first has ``part`` and ``stand`` besides its columns; the second has, per group and part, the
    ``shift`` from ``stand`` to the row's number from 0 within its group, and the group's ``size``.
    A group has as many parts as there are partitions at most, however many rows it has.
    """
    rows = frame.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = written(
        rows.withColumns({"part": F.spark_partition_id(), "stand": F.monotonically_increasing_id()}), label
    )
    counted = placed.groupBy(F.col(group).alias("of"), F.col("part").alias("in_part")).agg(
        F.min("stand").alias("first"), F.count(F.lit(1)).alias("rows")
    )
    whole = Window.partitionBy("of")
    shift = F.sum("rows").over(whole.orderBy("in_part")) - F.col("rows") - F.col("first")
    return placed, counted.select("of", "in_part", shift.alias("shift"), F.sum("rows").over(whole).alias("size"))


# --- trees ------------------------------------------------------------------------------------

NODES = "tree long, level int, place long, node string, size long"


def _grow(level: int, fan: int, levels: int):
    """Nodes above one block of consecutive nodes, up to the block's top or the tree's."""

    def grow(block: pa.Table) -> pa.Table:
        places = block["place"].to_numpy()
        order = np.argsort(places, kind="stable")
        nodes = np.array(block["node"].to_pylist(), dtype=object)[order].tolist()
        tree, size, first = block["tree"][0].as_py(), block["size"][0].as_py(), int(places[order[0]])
        rows = []
        for step in range(1, levels + 1):
            if size == 1:
                break
            nodes = [digest(nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
            size, first = -(-size // fan), first // fan
            rows += [(level + step, first + i, node) for i, node in enumerate(nodes)]
        at, where, found = zip(*rows) if rows else ((), (), ())
        return pa.table(
            {
                "tree": pa.array([tree] * len(at), pa.int64()),
                "level": pa.array(at, pa.int32()),
                "place": pa.array(where, pa.int64()),
                "node": pa.array(found, pa.string()),
                "size": pa.array([block["size"][0].as_py()] * len(at), pa.int64()),
            }
        )

    return grow


def nodes_above(base: DataFrame, fan: int = FAN, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """All nodes above the (tree, place, node, size) of level 0, as one written table per step.

    A step hashes ``levels`` levels in blocks; the last of them is the base of the next step, so
    there are as many steps as the largest tree needs, each on a small part of the one before it.
    """
    found, level, block = [], 0, fan**levels
    most = base.agg(F.max("size")).first()[0] or 0
    while most > 1:
        grown = written(
            base.where("size > 1")
            .groupBy("tree", F.floor(F.col("place") / block).alias("block"))
            .applyInArrow(_grow(level, fan, levels), NODES),
            "tree-nodes",
        )
        found.append(grown)
        level += levels
        shrunk = F.col("size")
        for _ in range(levels):
            shrunk = F.ceil(shrunk / fan)
            most = -(-most // fan)
        base = grown.where(F.col("level") == level).select("tree", "place", "node", shrunk.alias("size"))
    return found


def _tops(base: DataFrame, above: list[DataFrame], fan: int) -> DataFrame:
    """(tree, top): the last node of each tree."""
    tops = base.where("size = 1").select("tree", F.col("node").alias("top"))
    for grown in above:
        highest = grown.groupBy("tree", "level").agg(
            F.count(F.lit(1)).alias("width"), F.min("node").alias("top")
        )
        tops = tops.union(highest.where("width = 1").select("tree", "top"))
    return tops


class Manifest:
    """The written levels of all trees: the sources' trees by number, and tree -1 of their subroots.

    ``leaves`` has row, doc_id, source, leaf, told, tree, place, size (of the tree) and trees (how many).
    """

    def __init__(self, rows: DataFrame, fan: int = FAN, levels: int = BLOCK_LEVELS):
        self.fan, self.levels = fan, levels
        told = written(leaves(rows), "leaves")
        placed, starts = ordered(told, "source", ["doc_id", "leaf", "row"], "sorted-leaves")
        starts = written(starts, "leaf-starts")
        names, name_starts = ordered(
            starts.select("of").distinct().withColumn("all", F.lit(0)), "all", ["of"], "sorted-sources"
        )
        trees = names.join(name_starts, names["part"] == name_starts["in_part"]).select(
            names["of"].alias("named"), (F.col("stand") + F.col("shift")).alias("tree"), F.col("size").alias("trees")
        )
        # the numbers of the trees join the few starts, so that a large source is no key of the leaves
        starts = starts.join(trees, starts["of"].eqNullSafe(trees["named"])).drop("named")
        same = placed["source"].eqNullSafe(starts["of"]) & (placed["part"] == starts["in_part"])
        self.leaves = written(
            placed.join(starts, same).select(
                "row", "doc_id", "source", "leaf", "told", "tree",
                (F.col("stand") + F.col("shift")).alias("place"), "size", "trees",
            ),
            "placed-leaves",
        )
        base = self.leaves.select("tree", "place", F.col("leaf").alias("node"), "size")
        above = nodes_above(base, fan, levels)
        counts = self.leaves.where("place = 0").select("tree", "trees")
        heads = written(
            _tops(base, above, fan).join(counts, "tree").select(
                F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("place"),
                F.col("top").alias("node"), F.col("trees").alias("size"),
            ),
            "subroots",
        )
        upper = nodes_above(heads, fan, levels)
        first = _tops(heads, upper, fan).first()
        self.root = first and first["top"]
        self.nodes = self._union([heads], [*above, *upper])

    @staticmethod
    def _union(bases: list[DataFrame], grown: list[DataFrame]) -> DataFrame:
        every = None
        for part in [b.withColumn("level", F.lit(0)) for b in bases] + grown:
            part = part.select("tree", "level", "place", "node")
            every = part if every is None else every.union(part)
        return every


# --- proofs -----------------------------------------------------------------------------------

PROOFS = (
    "row long, doc_id long, leaf string, subroot string, proof string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def _requests(fan: int):
    def ask(block: pa.Table) -> pa.Table:
        tree, trees = block["tree"][0].as_py(), block["trees"][0].as_py()
        own = missing(block["place"].to_numpy(), block["size"][0].as_py(), fan)
        above = missing([tree], trees, fan)
        coordinates = [(tree, *c) for c in own] + [(-1, *c) for c in above]
        at = list(zip(*coordinates)) or [(), (), ()]
        return pa.table(
            {
                "of_tree": pa.array([tree] * len(coordinates), pa.int64()),
                "block": pa.array([block["block"][0].as_py()] * len(coordinates), pa.int64()),
                "tree": pa.array(at[0], pa.int64()),
                "level": pa.array(at[1], pa.int32()),
                "place": pa.array(at[2], pa.int64()),
            }
        )

    return ask


def _climb(known: dict, tree: int, places: Iterable[int], size: int, fan: int) -> list[int]:
    """Derives the interior nodes above the places, each once, into ``known``; returns the levels' widths."""
    widths, here = heights(size, fan), sorted(set(places))
    for level, width in enumerate(widths[:-1]):
        here = sorted({p // fan for p in here})
        for run in here:
            if (tree, level + 1, run) not in known:
                members = range(run * fan, min((run + 1) * fan, width))
                known[tree, level + 1, run] = digest(known[tree, level, p] for p in members)
    return widths


def _path(known: dict, tree: int, place: int, widths: list[int], fan: int) -> list[tuple[list[str], int]]:
    """A node's siblings and its own position among them, for each level."""
    steps = []
    for level, width in enumerate(widths[:-1]):
        first = place // fan * fan
        run = range(first, min(first + fan, width))
        steps.append(([known[tree, level, p] for p in run if p != place], place - first))
        place //= fan
    return steps


def fold(leaf: str, steps: Iterable[tuple[list[str], int]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for siblings, position in steps:
        leaf = digest([*siblings[:position], leaf, *siblings[position:]])
    return leaf


def _expand(fan: int, root: str | None, whole: bool):
    def expand(block: pa.Table, fetched: pa.Table) -> pa.Table:
        known = {
            (t, level, p): node
            for t, level, p, node in zip(*(fetched[c].to_pylist() for c in ("tree", "level", "place", "node")))
        }
        tree, size, trees = (block[c][0].as_py() for c in ("tree", "size", "trees"))
        rows = block.select(["row", "doc_id", "place", "leaf", "told"]).to_pylist()
        known.update(((tree, 0, r["place"]), r["leaf"]) for r in rows)
        widths = _climb(known, tree, [r["place"] for r in rows], size, fan)
        known[-1, 0, tree] = subroot = known[tree, len(widths) - 1, 0]
        to_root = _path(known, -1, tree, _climb(known, -1, [tree], trees, fan), fan)
        found = []
        for r in rows:
            steps = _path(known, tree, r["place"], widths, fan) + to_root
            proof = "".join(s for siblings, _ in steps for s in siblings)
            folded = fold(r["told"] or r["leaf"], steps)
            found.append(
                (r["row"], r["doc_id"], r["leaf"], subroot, proof if whole else None, digest([proof]), folded, folded == root)
            )
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.bool_()]
        names = [column.split()[0] for column in PROOFS.split(", ")]
        return pa.table({n: pa.array(v, kind) for n, kind, v in zip(names, kinds, zip(*found))})

    return expand


def multiproofs(manifest: Manifest, wanted: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """Proofs of the wanted leaves (rows of ``manifest.leaves``; all, if none are named).

    row, doc_id, leaf, subroot, proof (the siblings' digests joined; null unless ``whole``),
    proof_sha256, folded_root, verified.
    """
    fan, block = manifest.fan, manifest.fan**manifest.levels
    asked, nodes = manifest.leaves, manifest.nodes
    if wanted is not None:
        # blocks of which all leaves are asked for need no leaf besides; others may need any
        nodes = nodes.union(asked.select("tree", F.lit(0).alias("level"), "place", F.col("leaf").alias("node")))
        asked = wanted
    asked = asked.withColumn("block", F.floor(F.col("place") / block))
    requests = asked.select("tree", "block", "place", "size", "trees").groupBy("tree", "block").applyInArrow(
        _requests(fan), "of_tree long, block long, tree long, level int, place long"
    )
    fetched = requests.join(nodes, ["tree", "level", "place"])
    return (
        asked.groupBy("tree", "block")
        .cogroup(fetched.groupBy("of_tree", "block"))
        .applyInArrow(_expand(fan, manifest.root, whole), PROOFS)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = Manifest(table(spark, sf_dir, "documents"))
    return multiproofs(manifest, whole=False).select(
        "doc_id", "leaf", "subroot", F.lit(manifest.root).alias("root"), "proof_sha256", "folded_root", "verified"
    )


def _levels_sql(name: str, group: str, count: int) -> str:
    """Level after level of the trees in ``name``_0 (group, place, node), each with its run's siblings."""
    parts = []
    for level in range(count):
        parts.append(f"""
{name}_{level}s as (
  select *, list(node order by place) over (partition by {group}, place // {FAN}
            order by place rows between unbounded preceding and unbounded following) as run,
         count(*) over (partition by {group}) as width
  from {name}_{level}),
{name}_{level + 1} as (
  select {group}, place // {FAN} as place, sha256(string_agg(node, '' order by place)) as node
  from {name}_{level}s where width > 1 group by all)""")
    return ",".join(parts)


def _climb_sql(name: str, group: str, level: int, source: str, target: str) -> str:
    """One step up for all rows of ``source``: siblings joined to the proof, the told node folded."""
    at = f"(t.place // {FAN**level})"
    return f"""
{target} as (
  select t.* exclude (proof, told, top),
         t.proof || case when s.width > 1 then array_to_string(list_concat(s.run[1 : {at} % {FAN}], s.run[{at} % {FAN} + 2 : {FAN}]), '') else '' end as proof,
         case when s.width > 1 then sha256(array_to_string(list_concat(list_append(s.run[1 : {at} % {FAN}], t.told), s.run[{at} % {FAN} + 2 : {FAN}]), ''))
              else t.told end as told,
         coalesce(s.node, t.top) as top
  from {source} t left join {name}_{level}s s on s.{group} = t.{group} and s.place = {at})"""


#: Levels the twin is written out for: sources of 16^5 rows, 16^3 sources.
SQL_LEVELS, SQL_UPPER = 5, 3


def _sql() -> str:
    sized = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    others = " || ".join(sized(c) for c in FIELDS[:-1])
    crc = (
        "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform("
        "string_split(doc_id::VARCHAR, ''), lambda c: [-2 - ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda a, b: case when b < -1 then xor(a, (-2 - b)::BIGINT) when a % 2 = 1 then xor(a // 2, 3988292384::BIGINT) "
        "else a // 2 end), 4294967295::BIGINT)"
    )
    steps, at = [], "t0"
    for level in range(SQL_LEVELS):
        steps.append(_climb_sql("n", "tree", level, at, f"t{level + 1}"))
        at = f"t{level + 1}"
    lower = ",".join(steps)
    steps, at = [], "u0"
    for level in range(SQL_UPPER):
        steps.append(_climb_sql("m", "one", level, at, f"u{level + 1}"))
        at = f"u{level + 1}"
    upper = ",".join(steps)
    return f"""
with hashed as (
  select doc_id, source, sha256({others} || {sized("text")}) as leaf,
         sha256({others} || {sized(f"translate(text, '{UPPER}', '{LOWER}')")}) as changed,
         case when doc_id is not null then {crc} % 5 = 0 else false end as tampered
  from documents),
placed as (
  select *, dense_rank() over (order by source nulls first) - 1 as tree,
         row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place
  from hashed),
n_0 as (select tree, place, leaf as node from placed),{_levels_sql("n", "tree", SQL_LEVELS)},
t0 as (select tree, place, doc_id, leaf, '' as proof, case when tampered then changed else leaf end as told, leaf as top
       from placed),{lower},
m_0 as (select distinct 0 as one, tree as place, top as node from t{SQL_LEVELS}),{_levels_sql("m", "one", SQL_UPPER)},
u0 as (select 0 as one, tree as place, doc_id, leaf, top as subroot, proof, told, top from t{SQL_LEVELS}),{upper}
select doc_id, leaf, subroot, top as root, sha256(proof) as proof_sha256, told as folded_root, told = top as verified
from u{SQL_UPPER}
"""


SQL = _sql()
