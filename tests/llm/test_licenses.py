import random
import re

from helpers import clashing, documents, hard_documents, rows_of

from terravane.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(doc_id, text):
    words, places, base = WORD.findall(lower(text)), [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        for at in range(len(words) - len(parts) + 1):
            if words[at : at + len(parts)] == parts:
                places.append(at)
                base.add(label)
    labels, best = set(base), 1.0 if base else 0.0
    for label, template in licenses.TEMPLATES.items():
        wanted, run = set(WORD.findall(lower(template))), licenses.run_length(template)
        for at in range(len(words)):
            shared = len(wanted & set(words[at : at + run]))
            if shared >= licenses.required(len(wanted)):
                labels.add(label)
                best = max(best, shared / len(wanted))
    return (
        doc_id, len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), best,
    )


def test_against_brute_force(spark):
    rng, texts = random.Random(3), []
    notices = list(licenses.TEMPLATES.values()) + ["All rights reserved.", "cc by cc by CC-BY", "general public license"]
    for _ in range(150):
        lines = []
        for _ in range(rng.randint(0, 4)):
            words = re.findall(r"\S+", rng.choice(notices)) * rng.randint(1, 2)
            for _ in range(rng.randint(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(["the", "of", "Zeta", "MIT", "É"])
            if rng.random() < 0.3:
                rng.shuffle(words)
            lines.append(rng.choice(["", "\t", "- "]) + " ".join(words))
        texts.append("\n".join(lines))
    frame = clashing(documents(spark, texts).union(hard_documents(spark)), "row", "label", "words", "block")
    assert rows_of(licenses.scan(frame)) == sorted((brute(r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


def test_only_built_in_functions_run(spark):
    plan = licenses.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_inputs(spark):
    assert licenses.scan(documents(spark, [])).count() == 0
    assert licenses.scan(documents(spark, ["All rights reserved"]), templates={}).first()["labels"] == "reserved"


WRAPPED = {
    "mit-permission": "Permission is hereby granted, free of charge, to any person\n// obtaining a copy of this software and",
    "bsd": "# Redistribution and use in source and binary\n# forms, with or without modification,\n# are permitted",
    "mpl-2.0": "This Source Code Form is subject to the\r\n * terms of the Mozilla Public License, v. 2.0. If",
    "isc": "Permission to use, copy, modify, and\n\n distribute this software for any\npurpose is hereby granted",
}


def test_wrapped_notices_are_found_and_scattered_words_are_not(spark):
    filler = [f"filler{i}" for i in range(3000)]
    texts = [f"{' '.join(filler[:n])} {text} {' '.join(filler[:50])}" for text in WRAPPED.values() for n in (0, 17, 200)]
    rng = random.Random(5)
    for template in licenses.TEMPLATES.values():
        words = filler[:]
        for word in WORD.findall(lower(template)):
            words.insert(rng.randrange(len(words)), word)
        texts.append(" ".join(words))
    rows = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts)).collect()}
    for i, label in enumerate(label for label in WRAPPED for _ in range(3)):
        assert label in rows[i]["labels"].split(",") and rows[i]["score"] >= 0.9
    assert all(rows[i]["labels"] == "" and rows[i]["score"] == 0.0 for i in range(3 * len(WRAPPED), len(texts)))
