"""Benchmark decontamination by winnowing: shared word windows of documents and benchmark items.

A window is ``SPAN`` consecutive words of an item; an item of fewer words is one window.  Every
window of words is represented by the least hash of its ``GRAM``-word runs, so a text's
fingerprints are the sliding minima over its windows, neighbours mostly sharing one.  Equal
windows have equal fingerprints, which guarantees that every shared span of a window or more is
found by joining fingerprints on equality.  Each hit is extended to the windows it stands for,
which are compared word by word, so that no hash decides what is reported.

Documents are cut into chunks of ``CHUNK`` window starts, whose last words overlap the next chunk;
a very long document is many rows.  Items are reduced to distinct windows, and windows
to classes held by the same items, so that a passage that many documents and items share is
never multiplied out: item lists are formed once per distinct set of classes.  All of it is
DataFrame functions, and sides are broadcast only where Spark's own size limit allows.

Defined cases: null and empty texts have no words and are clean; documents with equal or null
ids are rows of their own; items without an id mark words but are neither counted nor listed, rows
sharing an item id are one item; empty tables give no rows or clean rows; extra columns of either
table are not read, whatever their names.  The list of one document's items is one row of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.llm.common import LOWER, UPPER, table, written

SPAN, GRAM, CHUNK = 10, 5, 256
#: ASCII characters that stand between words.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column | str) -> Column:
    """Words of a text, A-Z in lower case; one pass over the characters."""
    column = F.col(text) if isinstance(text, str) else text
    spaced = F.translate(
        F.coalesce(column.cast("string"), F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN)
    )
    return F.array_remove(F.split(spaced, " "), "")


def _runs(values: Column, length: int, most: Column, combine) -> Column:
    """``combine`` of ``length`` neighbours, for the first ``most`` places at most."""
    places = F.least(F.size(values) - length, most - 1)
    none = F.array().cast("array<bigint>")
    return F.when(
        places >= 0,
        F.transform(
            F.sequence(F.lit(0), places), lambda i: combine(*[F.get(values, i + j) for j in range(length)])
        ),
    ).otherwise(none)


def _first(*values: Column) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def minima(frame: DataFrame, words: str, span: int, gram: int, starts: int, name: str) -> DataFrame:
    """Adds the fingerprint of each window of ``span`` words that begins at the first ``starts`` words."""
    run = min(gram, span)
    every = F.lit((1 << 31) - 1)
    return (
        frame.withColumn("hashes", F.transform(words, lambda word: F.xxhash64(word)))
        .withColumn("grams", _runs(F.col("hashes"), run, every, F.xxhash64))
        .withColumn(name, _runs(F.col("grams"), span - run + 1, F.lit(starts), _first))
        .drop("hashes", "grams")
    )


def chunks(documents: DataFrame, span: int = SPAN, chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, n_words, chunk, text: each document's words in overlapping pieces, at least one."""
    worded = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        words_of("text").alias("words"),
    )
    size = F.size("words")
    last = F.greatest(F.floor((size - 1) / chunk), F.lit(0)).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), last),
        lambda c: F.array_join(F.slice("words", c * chunk + 1, F.lit(chunk + span - 1)), " "),
    )
    return worded.select("row", "doc_id", size.cast("long").alias("n_words"), pieces.alias("pieces")).select(
        "row", "doc_id", "n_words", F.posexplode("pieces").alias("chunk", "text")
    )


def windows(benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(window, span, print, class) of the distinct windows of all items, and (class, items).

    A window's items are listed once per class of windows that the same items hold.
    """
    worded = benchmark.select(
        F.col("item_id").cast("string").alias("item"), words_of("text").alias("words")
    ).withColumn("span", F.least(F.size("words"), F.lit(span)))
    each = F.transform(
        F.sequence(F.lit(0), F.size("words") - F.col("span")),
        lambda i: F.array_join(F.slice("words", i + 1, F.col("span")), " "),
    )
    held = worded.where("span > 0").select("item", "span", F.explode(each).alias("window"))
    listed = held.groupBy("window", "span").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = written(listed, "item-windows")
    classes = written(
        listed.select("items").distinct().select(F.monotonically_increasing_id().alias("class"), "items"),
        "item-classes",
    )
    parts = []
    for length in sorted(r["span"] for r in listed.select("span").distinct().collect()):  # at most SPAN values
        of_length = listed.where(F.col("span") == length).withColumn("words", F.split("window", " "))
        parts.append(
            minima(of_length, "words", length, gram, 1, "prints").select(
                "window", "span", F.get("prints", F.lit(0)).alias("print"), "items"
            )
        )
    if not parts:
        return listed.selectExpr("window", "span", "0L print", "0L class").where("false"), classes
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return written(every.join(classes, "items").drop("items"), "windows"), classes


def shared_windows(
    documents: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, doc_id, n_words, chunk, text); the hits (row, start, span, class) in them; (class, items)."""
    if not 1 <= gram <= span or chunk < 1:
        raise ValueError("a gram has between one word and a window's words, a chunk one start at least")
    pieces = written(chunks(documents, span, chunk), "chunks")
    known, classes = windows(benchmark, span, gram)
    found = None
    for length in sorted(r["span"] for r in known.select("span").distinct().collect()):
        of_length = known.where(F.col("span") == length)
        prints = written(of_length.select("print").distinct(), "item-prints")
        marked = minima(
            pieces.where(f"n_words >= {length}").select("row", "chunk", F.split("text", " ").alias("words")),
            "words", length, gram, chunk, "minima",
        )
        hits = (
            marked.select("row", "chunk", F.explode(F.array_distinct("minima")).alias("print"))
            .join(prints, "print")
            .groupBy("row", "chunk")
            .agg(F.collect_set("print").alias("prints"))
        )
        hits = written(hits, "print-hits")
        again = minima(
            pieces.select("row", "chunk", F.split("text", " ").alias("words")).join(hits, ["row", "chunk"]),
            "words", length, gram, chunk, "minima",
        )
        starts = F.filter(
            F.sequence(F.lit(0), F.size("minima") - 1), lambda i: F.array_contains("prints", F.get("minima", i))
        )
        extended = F.transform(
            starts,
            lambda i: F.struct(
                (F.col("chunk").cast("long") * chunk + i).alias("start"),
                F.array_join(F.slice("words", i + 1, F.lit(length)), " ").alias("window"),
            ),
        )
        met = (
            again.select("row", F.inline(extended))
            .join(of_length.select("window", "span", "class"), "window")
            .select("row", "start", "span", "class")
        )
        found = met if found is None else found.union(met)
    if found is None:
        found = pieces.selectExpr("row", "0L start", "0 span", "0L class").where("false")
    return pieces, written(found, "window-hits"), classes


def contamination(
    documents: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, chunk: int = CHUNK
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated, for every document."""
    pieces, hits, classes = shared_windows(documents, benchmark, span, gram, chunk)
    # words covered: each hit adds what lies behind the furthest end before it
    earlier = Window.partitionBy("row").orderBy("start", "span").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("span")
    covered = (
        hits.select("row", "start", "span")
        .withColumn("reached", F.coalesce(F.max(end).over(earlier), F.lit(0)))
        .groupBy("row")
        .agg(F.sum(F.greatest(end - F.greatest("start", "reached"), F.lit(0))).alias("n_hit"))
    )
    sets = written(
        hits.select("row", "class").distinct().groupBy("row").agg(F.array_sort(F.collect_set("class")).alias("held")),
        "class-sets",
    )
    lists = (
        sets.select("held").distinct()
        .select("held", F.explode("held").alias("class"))
        .join(classes, "class")
        .select("held", F.explode("items").alias("item"))
        .groupBy("held")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    listed = sets.join(lists, "held", "left").select("row", "items")
    none = F.array().cast("array<string>")
    return (
        pieces.where("chunk = 0").select("row", "doc_id", "n_words")
        .join(covered, "row", "left")
        .join(listed, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
            F.coalesce("items", none).alias("items"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


SQL = f"""
with d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as words
  from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as words
  from benchmark),
iw as (
  select distinct item_id, span, array_to_string(words[s + 1 : s + span], ' ') as win
  from (select item_id, words, least(len(words), {SPAN}) as span,
               unnest(range(0, len(words) - least(len(words), {SPAN}) + 1)) as s
        from i where len(words) > 0)),
spans as (select distinct span from iw),
dw as (
  select rid, span, s, array_to_string(words[s + 1 : s + span], ' ') as win
  from (select rid, words, span, unnest(range(0, len(words) - span + 1)) as s
        from d, spans where len(words) >= span)),
hits as (
  select rid, s, dw.span, item_id from dw join iw on dw.span = iw.span and dw.win = iw.win),
hit_words as (
  select rid, count(distinct p)::BIGINT as n_hit
  from (select rid, unnest(range(s, s + span)) as p from (select distinct rid, s, span from hits)) group by rid),
hit_items as (
  select rid, count(distinct item_id)::BIGINT as n_items,
         string_agg(distinct item_id::VARCHAR, ',' order by item_id::VARCHAR) as listed
  from hits group by rid)
select doc_id, len(words)::BIGINT as n_words, coalesce(n_hit, 0)::BIGINT as n_hit,
       coalesce(n_items, 0)::BIGINT as n_items, sha256(coalesce(listed, '')) as items_sha256,
       n_hit is not null as contaminated
from d left join hit_words using (rid) left join hit_items using (rid)
"""
