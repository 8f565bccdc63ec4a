import random
import zlib

import numpy as np
from helpers import clashing, documents, hard_documents

from terravane.llm import common, toxicity, training
from terravane.llm.toxicity import GRAMMAR, KINDS, Lexicon, Transducer, compose, match

LEXICON = Lexicon({"fool": 2.0, "grub-": 3.0})
LABELS = "doc_id long, quality int, toxic int"


def kinds(text):
    return {k: round(float(np.expm1(v)), 9) for k, v in zip(KINDS, match(text, LEXICON)) if v}


def test_clauses_are_scored_by_kind():
    assert kinds("A plain fool here.") == {"plain": 2.0}
    assert kinds("You are a fool") == {"aimed": 2.0}
    assert kinds("You left. A fool came") == {"plain": 2.0}
    assert kinds("you are not a fool") == {"negated": 2.0}
    assert kinds("not one of these is a fool") == {"plain": 2.0}
    assert kinds("she said he is a fool, fool") == {"reported": 2.0, "plain": 2.0}
    assert kinds("kill you") == {"threat": 1.0} and kinds("I will never kill you") == {}
    assert kinds("GRUBBIEST grub grubs, gru") == {"plain": 9.0}
    assert kinds("") == kinds(None) == kinds("foolish") == {}


def test_composition_equals_running_one_after_the_other():
    rng = random.Random(1)
    for _ in range(300):
        symbols = [rng.choice(toxicity.INPUT) for _ in range(12)]
        state, states, one, two = GRAMMAR.start, [0, 0, 0], [], []
        for symbol in symbols:
            state, out = GRAMMAR.step(state, symbol)
            one.append(out)
            for i, machine in enumerate((toxicity.NEGATION, toxicity.REPORT, toxicity.TARGET)):
                states[i], symbol = machine.step(states[i], symbol)
            two.append(symbol)
        assert one == two


def test_composed_arcs_cover_every_symbol():
    flip = Transducer(0, {(0, "x"): (1, "y"), (1, "x"): (0, "x")})
    both = compose(flip, flip, ["x", "y"])
    assert both.step(0, "x")[1] == "y" and len(both.arcs) == 2 * len({s for s, _ in both.arcs})


def corpus(spark, n=900):
    rng, texts, labels = random.Random(4), [], []
    words = "alba coru dene fito gamo hulu".split()
    for i in range(n):
        text = [rng.choice(words) for _ in range(60)]
        toxic = i % 7 == 0
        if toxic:
            text[rng.randrange(60)] = rng.choice(["zork", "bliptal", "blipton", "bliper"])
        texts.append(" ".join(text))
        labels.append((i, 1, int(toxic)))
    return documents(spark, texts), spark.createDataFrame(labels, LABELS)


def test_learns_words_and_beginnings_and_never_the_held_out_fold(spark):
    frame, labels = corpus(spark)
    rows = toxicity.score(frame, labels).collect()
    assert len(rows) == 900
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1)
        assert row["predicted"] == truth[row["doc_id"]] == int(row["score"] >= 0.7)
    turned = labels.withColumn("toxic", (1 - labels["toxic"]).cast("int")).where(toxicity.held_out())
    mixed = turned.union(labels.where(~toxicity.held_out()))
    assert sorted(map(tuple, toxicity.score(frame, mixed).collect())) == sorted(map(tuple, rows))


def test_hard_rows_and_missing_labels(spark):
    frame = clashing(hard_documents(spark), "score", "mark", "label", "toxic")
    none = spark.createDataFrame([], LABELS)
    rows = toxicity.score(frame, none).collect()
    assert len(rows) == frame.count() and all(r["score"] < 1e-6 and r["predicted"] == 0 for r in rows)
    labels = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (2, None, None), (None, 1, 1), (7, 1, 0), (4, 0, 0)], LABELS)
    kept = toxicity.keep_clean(frame, labels)
    assert kept.columns == frame.columns and kept.count() <= frame.count()
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(frame, labels).collect())
    assert toxicity.score(documents(spark, []), labels).count() == 0


def test_held_out_accuracy_on_the_tables(spark):
    folder = "/root/testdata/sf0.1"
    frame, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in toxicity.score(frame, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    caught = sum(r["predicted"] for r in rows if truth[r["doc_id"]] == 1)
    # some documents labelled toxic hold no insult at all, as their words were replaced by junk
    assert caught >= 0.9 * sum(truth[r["doc_id"]] == 1 for r in rows)
    assert sum(r["predicted"] for r in rows if truth[r["doc_id"]] == 0) <= 0.005 * len(rows)


def test_threats_quotations_and_negations_move_scores_though_no_label_shows_them(spark):
    frame, labels = corpus(spark)
    texts = ["", "alba coru", "i will kill you", "she said he is a zork", "this is not a zork", "a zork", "you are a zork"]
    asked = documents(spark, texts)
    asked = asked.withColumn("doc_id", asked["doc_id"] + 10_000)
    scores = {r["doc_id"] - 10_000: r["score"] for r in toxicity.score(frame.unionByName(asked), labels).collect()}
    empty, clean, threat, quoted, negated, plain, aimed = (scores[i] for i in range(7))
    assert empty == clean < quoted < negated < plain < aimed
    assert empty < threat and plain >= 0.7 > max(quoted, negated)


def test_a_sample_is_written_in_few_files_however_many_partitions_there_are(spark, monkeypatch):
    frame, labels = corpus(spark, 300)
    made = []

    def noted(frame, label):
        found = common.written(frame, label)
        made.append((label, len(found.inputFiles()), found.count()))
        return found

    monkeypatch.setattr(training, "written", noted)
    monkeypatch.setattr(toxicity, "written", noted)
    few = 20
    settings = {"spark.sql.shuffle.partitions": "80", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        toxicity.train(frame, labels)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    rows = labels.where(~toxicity.held_out()).count()
    assert [label for label, _, _ in made] == ["chosen", "sample", "distinct-sample"]
    assert made[1][2] == rows and all(files <= few for _, files, _ in made)


def test_only_unseen_kinds_get_the_stated_shares():
    x = np.zeros((4, len(KINDS)))
    x[:, KINDS.index("plain")], x[0, KINDS.index("negated")] = 1, 1
    weights = toxicity.with_unseen(np.array([2.0, 0.0, 0.7, 0.0, 0.0, -3.0]), x)
    assert np.allclose(weights, [2.0, 2.2, 0.7, 0.6, 2.4, -3.0])
