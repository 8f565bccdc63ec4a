"""Mix sources to target weights.

The size of every document is counted once, sizes are summed per source, and each source
gets a target: its weight's part of ``share`` times all words, at most ``most`` times its
own size, where what a full source cannot take is shared among the others by weight.  A
document is then emitted ``floor(rate)`` times, ``rate`` being target over source size, plus
once more if a coin seeded by its id falls below the fraction of the rate.

Defined cases: a null text has size 0; a null source is a source of its own and comes last;
sources without words get target 0 and emit nothing; rows with equal ids share one coin, rows
without an id are told apart by their text.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.llm.common import fresh, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED = 1.5, 2.0, "mix-1"
COIN_STEPS = float(16**13)


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """From (source, size) rows: source, source_size, target.

    The reshared targets are the water level of capped shares: sources ordered by cap per
    weight fill up first, and the level of the rest follows from what they leave.  Windows
    here see one row per source, never documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    everything = Window.partitionBy(F.lit(0))
    ranked = per_source.select(
        "source",
        "source_size",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]), ((dealt - 1) % len(weights) + 1).cast("int")
        ).alias("weight"),
        (F.lit(float(most)) * F.col("source_size")).alias("cap"),
        (F.lit(float(share)) * F.sum("source_size").over(everything)).alias("budget"),
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levelled = ranked.select(
        "*",
        (F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))).alias("left"),
        F.sum("weight").over(onward).alias("open"),
    ).withColumn("full", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
    level = levelled.select(
        "*",
        F.max(F.when(~F.col("full"), F.col("open"))).over(everything).alias("open_weight"),
        F.max(F.when(~F.col("full"), F.col("left"))).over(everything).alias("open_left"),
    )
    shared = F.col("open_left") * F.col("weight") / F.col("open_weight")
    return level.select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("cap")).otherwise(shared).alias("target"),
    )


def copies(rate: Column, key: Column, seed: str = SEED) -> Column:
    """floor(rate), plus one if the key's coin is below the fraction."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13)
    coin = F.conv(digest, 16, 10).cast("double") / COIN_STEPS
    return (F.floor(rate) + (coin < rate - F.floor(rate)).cast("long")).cast("long")


def _rated(documents: DataFrame, targets: DataFrame, names: Sequence[str], key: Column, seed: str):
    """Documents with source size, target and number of copies in the columns ``names``."""
    size, target, repeats, other = names
    # no hint: the table of sources is broadcast only where its measured size allows it
    plan = targets.select(
        F.col("source").alias(other), F.col("source_size").alias(size), F.col("target").alias(target)
    )
    rate = F.when(F.col(size) > 0, F.col(target) / F.col(size)).otherwise(F.lit(0.0))
    return (
        documents.join(plan, documents["source"].eqNullSafe(plan[other]), "left")
        .drop(other)
        .withColumn(repeats, copies(rate, key, seed))
    )


def _key(documents: DataFrame, id_column: str = "doc_id", text: Column | None = None) -> Column:
    ids = F.col(id_column).cast("string")
    return F.coalesce(ids, text if text is not None else F.lit("-"), F.lit("-"))


def mix(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, in the columns they came with."""
    sizes = documents.select("source", words_in().alias("size"))
    targets = written(source_targets(sizes, weights, share, most), "mix-targets")
    size, target, repeats, other, turn = fresh(documents, "size", "target", "repeats", "other", "turn")
    # without an id the text's digest seeds the coin, as in the report
    key = _key(documents, text=F.md5(F.col("text").cast("binary")))
    rated = _rated(documents, targets, (size, target, repeats, other), key, seed)
    return (
        rated.where(F.col(repeats) > 0)
        .withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(repeats).cast("int"))))
        .select(*[F.col(f"`{c}`") for c in documents.columns])
    )


def mix_report(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    sized = documents.select(
        "doc_id",
        "source",
        words_in().alias("size"),
        # the text itself is needed only where there is no id to seed the coin
        F.when(F.col("doc_id").isNull(), F.md5(F.col("text").cast("binary"))).alias("stand_in"),
    )
    sized = written(sized, "mix-sizes")
    targets = source_targets(sized.select("source", "size"), weights, share, most)
    targets = written(targets, "mix-targets")
    rated = _rated(
        sized,
        targets,
        ("source_size", "target", "repeats", "other"),
        _key(sized, text=F.col("stand_in")),
        seed,
    )
    return rated.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "repeats",
        (F.col("repeats") * F.col("size")).alias("taken"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT as size,
         coalesce(doc_id::VARCHAR, md5(text), '-') as coin_key
  from documents),
per_source as (select source, sum(size)::BIGINT as source_size from sized group by source),
ranked as (
  select source, source_size,
         ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::INT] as weight,
         2.0::DOUBLE * source_size as cap, 1.5::DOUBLE * (sum(source_size) over ())::DOUBLE as budget
  from per_source),
levelled as (
  select *, budget - coalesce(sum(cap) over (order by cap / weight, source asc nulls last
                              rows between unbounded preceding and 1 preceding), 0.0::DOUBLE) as room,
         sum(weight) over (order by cap / weight, source asc nulls last
                              rows between current row and unbounded following) as open
  from ranked),
flagged as (select *, cap * open <= room * weight as is_full from levelled),
targets as (
  select source, source_size,
         case when is_full then cap
              else max(case when not is_full then room end) over () * weight
                   / max(case when not is_full then open end) over () end as target
  from flagged),
rated as (
  select s.doc_id, s.source, s.size, t.source_size, t.target, s.coin_key,
         case when t.source_size > 0 then t.target / t.source_size else 0.0::DOUBLE end as rate
  from sized s left join targets t on s.source is not distinct from t.source),
counted as (
  select *, (floor(rate) + case when ('0x' || substr(md5('mix-1:' || coin_key), 1, 13))::BIGINT::DOUBLE
                                     / 4503599627370496.0::DOUBLE < rate - floor(rate) then 1 else 0 end)::BIGINT as repeats
  from rated)
select doc_id, source, size, source_size, target, repeats, repeats * size as taken from counted
"""
