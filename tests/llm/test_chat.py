import re

from helpers import clashing

from terravane.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    pairs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            key = (turn is not None, turn or 0, role or "", text or "", (role is None, text is None))
            pairs.setdefault(conv // 2, {0: [], 1: []})[conv % 2].append(key)
    found = {}
    for pair, sides in pairs.items():
        a, b = sorted(sides[0]), sorted(sides[1])
        common = 0
        while common < min(len(a), len(b)) and a[common][2:] == b[common][2:]:
            common += 1
        ends = []
        for side in (a, b):
            text, spans = "", []
            for _, _, role, said, _ in side[common:]:
                start = len(text) + len("<|im_start|>") + len(role) + 1
                text += f"<|im_start|>{role}\n{said}<|im_end|>\n"
                if role == "assistant":
                    spans.append(f"{start}:{len(text) - start}")
            ends += [text, ";".join(spans)] if side else [None, None]
        prompt = "".join(f"<|im_start|>{t[2]}\n{t[3]}<|im_end|>\n" for t in a[:common])
        found[pair] = (common, prompt, *ends)
    return found


def test_against_brute_force(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"),
        (2, 0, "system", None), (2, 1, "user", "é🙂"), (3, 0, "system", ""), (3, 1, "user", "é🙂"),
        (4, 0, "user", "same"), (5, 0, "user", "same"),
        (6, 0, "user", "only chosen"), (6, 1, "assistant", "x" * 50_000),
        (9, 0, None, "only rejected"),
        (10, None, "user", "a"), (10, 0, "assistant", "b"), (10, 0, "assistant", "b"),
        (11, None, "user", "a"), (11, 0, "assistant", "b"), (11, 7, "user", "c"), (11, 9, "assistant", "d"),
        (None, 0, "user", "nobody's"), (-2, 0, "user", "q"), (-1, 0, "user", "q"), (-1, 1, "assistant", "r"),
    ]
    frame = clashing(spark.createDataFrame(rows, SCHEMA), "pair_id", "side", "chosen", "prompt")
    found = {}
    for r in chat.format_preferences(chat.neighbours_as_pairs(frame)).collect():
        found[r["pair_id"]] = (
            r["n_common_turns"], r["prompt"], r["chosen_completion"], r["chosen_mask"],
            r["rejected_completion"], r["rejected_mask"],
        )
    assert found == brute(rows)


def test_masks_name_the_assistants_texts(spark):
    for r in chat.query(spark, "/root/testdata/sf0.001").collect():
        for side in ("chosen", "rejected"):
            text, mask = r[f"{side}_completion"], r[f"{side}_mask"]
            told = re.findall(r"<\|im_start\|>assistant\n(.*?<\|im_end\|>\n)", text or "", re.S)
            spans = [tuple(map(int, s.split(":"))) for s in (mask or "").split(";") if s]
            assert [text[a : a + n] for a, n in spans] == told


def test_only_built_in_functions_run(spark):
    plan = chat.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert chat.format_preferences(chat.neighbours_as_pairs(spark.createDataFrame([], SCHEMA))).count() == 0


def test_empty_table(spark):
    none = clashing(spark.createDataFrame([], SCHEMA), "side", "prompt")
    assert chat.format_preferences(chat.neighbours_as_pairs(none)).count() == 0
