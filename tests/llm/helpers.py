"""Small frames with the hard cases, and brute-force versions of the operators."""

from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None):
    """One document per text; ids from 0 in order."""
    sources = sources or ["a"] * len(texts)
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, (t, s) in enumerate(zip(texts, sources))]
    return spark.createDataFrame(rows, DOCUMENTS)


def hard_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and other scripts."""
    long = " ".join(f"word{i % 700} and so on." for i in range(30_000))
    rows = [
        (0, "one two three four five six seven", "en", "a", 33),
        (0, "one two three four five six seven", "en", "a", 33),
        (1, None, None, None, None),
        (2, "", "en", "b", 0),
        (3, " \t\n ", "en", "b", 4),
        (None, "a text without an id", "en", "b", 20),
        (None, None, None, None, None),
        (4, long, "en", "c", len(long)),
        (5, long + " end", "en", "c", len(long) + 4),
        (6, "Ünïcödé ΣΑΣ straße 数据 Licensed under CC BY-NC 4.0.\nAll rights reserved", "de", None, 60),
        (7, "x", "en", "d", 1),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


def clashing(frame, *names):
    """The frame with extra columns of the given names."""
    return frame.withColumns({name: F.lit("extra") for name in names})


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def classes_of(nodes, linked):
    """Smallest member reachable from each node, by repeated search."""
    left, found = set(nodes), {}
    while left:
        start = left.pop()
        group, queue = {start}, [start]
        while queue:
            at = queue.pop()
            near = {n for n in left if linked(at, n)}
            left -= near
            group |= near
            queue += near
        for node in group:
            found[node] = min(group)
    return found
