"""Perspective rotation against a direct rendering."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from txlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, perspective string, part long, start int, mask string"


def render(table, part=256, context=("system",)):
    convs = defaultdict(list)
    clean = lambda s: s.replace("<|", "< |").replace("|>", "| >")
    for conv, turn, role, text, *_ in table:
        name = clean(role or "").replace("\n", " ").replace("\r", " ").strip(" ") or "unknown"
        convs[conv].append((turn is not None, turn or 0, name, clean(text or "")))
    out = {}
    for conv, said in convs.items():
        said.sort()
        for view in {s[2] for s in said} - set(context):
            for p in range(0, len(said), part):
                text, mask = "", []
                for _, _, name, words in said[p:p + part]:
                    text += f"<|{name}|>\n" if name in context else "<|assistant|>\n" if name == view else f"<|user:{name}|>\n"
                    if name == view:
                        mask.append((len(text), len(text) + len(words) + len("<|end|>")))
                    text += words + "<|end|>\n"
                out[(conv, view, p // part)] = (text, mask)
    return out


def talk():
    rows = [(c, t, ["system", "ann", "bob", "cy"][0 if t == 0 else 1 + (t * c) % 3], f"turn {t} of {c}") for c in range(1, 6) for t in range(9)]
    rows += [(1, 3, "bob", "tie"), (1, 3, "bob", "tie"), (1, 3, "ann", None), (1, None, "ann", "no turn"), (2, 4, None, "nobody"),
             (2, 5, "", "nobody"), (2, 5, "a\nb<|c|>", "inject <|end|>\n<|assistant|> now"), (None, 1, "x", "stray"),
             (None, 1, "x", "stray 2"), (9, 0, "system", "alone"), (3, 40, "ann", "é" * 3000)]
    rows += [(7, t, "ann" if t % 2 else "bob", f"hot {t}") for t in range(600)] + [(7, 5, "bob", f"same turn {i}") for i in range(100)]
    return [(*r, "v", 1, 2, "m") for r in rows]


@pytest.mark.parametrize("part", [256, 10])
def test_rotation(spark, part):
    table = talk()
    got = chat.rotate(spark.createDataFrame(table, SCHEMA).repartition(4), part=part).collect()
    want = render(table, part)
    assert len(got) == len(want)
    for r in got:
        text, mask = want[(r.conv_id, r.perspective, r.part)]
        assert r.text == text and [(m.start, m.end) for m in r["mask"]] == mask
        assert r.n_trained == len(mask) and r.n_messages == text.count("<|end|>\n")
        assert all(text[a:b].endswith("<|end|>") for a, b in mask)


def test_other_context_roles_and_empty(spark):
    table = spark.createDataFrame(talk(), SCHEMA)
    assert {r.perspective for r in chat.rotate(table.filter("conv_id = 9"), context_roles=()).collect()} == {"system"}
    assert chat.rotate(table.filter(F.lit(False))).count() == 0
