"""Hard negatives, the prefix trie and the quality rules against plain versions, and on awkward input."""

import os
import random
import sys
from dataclasses import astuple

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from plantmon.llm import hard_negatives, prefix_trie, quality  # noqa: E402

NAMES = ["row", "id", "score", "dim", "block", "scores", "conv", "pos", "depth", "n_words", "kept", "bucket", "rule"]


def widened(df):
    """Extra columns whose names clash with helper and result columns."""
    return df.withColumns({c: F.lit(f"x-{c}") for c in NAMES if c not in df.columns})


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, label int"
    return widened(spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v], b) for i, v, b in rows], schema))


def vector_rows(seed=5, n=260):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = draw.normal(size=6).astype(np.float32) / 3
        rows.append((int(i), [float(x) for x in v], int(draw.integers(0, 4))))
    same = rows[20][1]
    rows += [(300 + k, same, k % 3) for k in range(40)]  # many ties
    rows += [(20, rows[50][1], 1), (20, same, rows[20][2]), (40, same, 2)]  # rows that repeat an id
    rows += [(500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 6, 1), (503, [float("inf")] * 6, 2), (504, [0.5] * 6, None)]
    rows += [(None, [0.5] * 6, 1), (60, [1.0, 2.0], 1), (61, [1.0, 1.5], 1), (62, [0.75, 2.25], 2), (80, [], 1), (81, [], 1), (82, [], 3)]
    rows += [(100, [0.0] * 6, 1), (-20, [0.9] * 6, 3), (700, [-9.0] * 6, 9)]
    return rows


@pytest.mark.parametrize("least,anchors", [(1_024, 4_096), (16, 4)])
def test_hard_negatives(spark, monkeypatch, least, anchors):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", least)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    rows = vector_rows()
    out = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 20 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute.hard_negatives(rows, lambda i: i % 20 == 0)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert {r[0] for r in want} >= {-20, 20, 60, 80}


def test_hard_negatives_other_settings(spark):
    rows = vector_rows(9)
    out = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 7 == 0, positives=2, negatives=3, low=50, high=110, scale=64)
    assert sorted(map(tuple, out.collect())) == sorted(brute.hard_negatives(rows, lambda i: i % 7 == 0, 2, 3, 50, 110, 64))
    assert hard_negatives.hard_negatives(vectors(spark, rows).where("false"), F.lit(True)).count() == 0
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.hard_negatives(vectors(spark, [(0, [1e30, 1.0], 1)]), F.lit(True))


def test_scan_abandons_rows_and_keeps_the_right_ones():
    draw = np.random.default_rng(2)
    values = np.floor(256 * draw.normal(size=(2_000, 32)) * np.linspace(3, 0.05, 32)).astype(np.int64)
    import pyarrow as pa

    table = pa.table({"row": np.arange(2_000), "id": np.arange(2_000), "label": ["a"] * 2_000, "vec": pa.array(values.tolist())})
    block = hard_negatives.Block({k: v[0] for k, v in hard_negatives.Block.record(32, 0, table).items()})
    alive = []

    def shrink(low, high):
        exact = values[7] @ values.T
        alive.append(len(low))
        assert (low <= high).all()
        return high >= np.sort(low)[-5] if len(low) > 5 else np.ones(len(low), bool)

    rows, score = block.scan(values[7], np.arange(2_000), shrink)
    best = np.argsort(-(values @ values[7]), kind="stable")[:5]
    assert set(best) <= set(rows.tolist()) and (score == values[rows] @ values[7]).all()
    assert alive[0] == 2_000 and alive[2] < 1_000  # most rows go before half of the dimensions


def turns(spark, rows):
    return widened(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def turn_rows(seed=1, n=120, longest=12):
    draw = random.Random(seed)
    rows = []
    for c in range(0, 3 * n, 3):
        for t in range(draw.randint(1, longest)):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["hi", "é", "", "what now", "a" * 30]) if t else "start"))
    rows += [(300, t, "user", f"turn {t % 5}") for t in range(70)] + [(301, t, "user", f"turn {t % 5}") for t in range(69)]
    rows += [(c, t, "user", f"turn {t % 5}") for c in range(400, 460) for t in range(24)]  # copies
    rows += [(500, None, None, None), (500, 0, "user", None), (500, 0, "user", "b"), (500, 0, "user", "b"), (500, 0, None, "b")]
    rows += [(None, 0, "user", "x"), (-7, 0, "user", "neg"), (-100, 1, "user", "neg"), (10_007, 3, "user:", "1:"), (10_008, 3, "user", ":1:")]
    rows.append((20_000, 0, "user", "long " * 200_000))
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("width,span", [(8, 1_024), (3, 2)])
def test_prefix_trie(spark, monkeypatch, width, span):
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    rows = turn_rows()
    conv = F.col("conv")
    out = prefix_trie.conversation_trie(turns(spark, rows), conv - conv % 100, (F.crc32(conv.cast("string")) % 6).cast("int"), 5, width)
    assert out.columns == COLUMNS and [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, brute.prefix_trie(rows)))


def test_prefix_trie_as_given(spark):
    rows = turn_rows(2, 40)
    out = prefix_trie.conversation_trie(turns(spark, rows))
    want = brute.prefix_trie(rows, heads=lambda c: 0)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert prefix_trie.conversation_trie(turns(spark, rows[:1]).where("false")).count() == 0
    # A conversation that its base leaves without turns is a member of the root alone.
    one = turns(spark, [(c, 0, "user", "x") for c in range(105, 108)])
    root = prefix_trie.conversation_trie(one, F.col("conv") - F.col("conv") % 100, F.lit(2), 2).collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"]) for r in root] == [(105, 0, 3, 0, 1)]


def quality_rows(seed=4):
    draw = random.Random(seed)
    rows = []
    for i in range(500):
        lang, source = draw.choice(["en", "de", None]), draw.choice(["web", "code", "rare" if draw.random() < 0.1 else "web"])
        words = [draw.choice("abcdefgh") * draw.randint(2, 9 if lang == "de" else 5) + str(draw.randint(0, 60)) for _ in range(draw.randint(20, 160))]
        if source == "code":
            words = [w + draw.choice(["", "", "&", "<>"]) for w in words]
        elif i % 25 == 0:
            words = [w + draw.choice("#*$%") for w in words]
        elif i % 25 == 1:
            words = [w * 9 for w in words]
        text = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
        if i % 25 == 2:
            text += "\n" + text
        elif i % 25 == 3:
            text = "\n".join([text, *["one more line of it"] * 40])
        rows.append((i, text, lang, source))
    long = " ".join(f"w{k % 977}é" for k in range(300_000))
    rows += [(600, None, "en", "web"), (601, "", None, None), (602, " \n\t\n ", "en", "web"), (603, long, "xx", "web"), (3, *rows[3][1:]), (None, *rows[4][1:])]
    rows += [(604, "same " * 60, "en", "web"), (605, "x" * 200_000, "en", "web"), (606, "\n".join(f"a{k} b{k}  " for k in range(60)) + "\na1 b1  ", "en", None)]
    return rows


def test_quality_rules(spark):
    rows = quality_rows()
    docs = widened(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    out = quality.quality_rules(docs)
    assert set(docs.columns) <= set(out.columns)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted(map(repr, map(tuple, out.select(names).collect())))
    want = brute.quality(rows, [astuple(r) for r in quality.RULES])
    assert got == sorted(map(repr, want))
    judged = {r[0]: r for r in want}
    assert not any(judged[i][-1] for i in range(0, 500, 25) if rows[i][3] != "code" and not judged[i][6])
    code = [judged[i] for i in range(500) if rows[i][3] == "code" and not judged[i][6]]
    # What condemns a text elsewhere is usual here.
    assert sum(r[-1] for r in code) > 0.95 * len(code)
    assert out.where("doc_id = 5").first()["text"] == rows[5][1]
    assert quality.quality_rules(docs.where("false")).count() == 0
    assert not [r for r in quality.quality_rules(docs.where("doc_id >= 600 and doc_id <= 602")).collect() if r["kept"]]


def test_sketches_merge_and_keep_their_bound(spark):
    docs = spark.createDataFrame(quality_rows(), "doc_id long, text string, lang string, source string")
    measured = quality.measure(docs)
    whole = quality.sketch(measured, ["lang", "source"])
    parts = quality.sketch(measured.where("doc_id % 2 = 0"), ["lang", "source"]).unionByName(
        quality.sketch(measured.where("doc_id % 2 <> 0 or doc_id is null"), ["lang", "source"])
    )
    assert sorted(map(repr, quality.merge(parts, ["lang", "source"]).collect())) == sorted(map(repr, whole.collect()))
    values = spark.range(0, 1 << 20, 7).unionByName(spark.range(1 << 40, (1 << 40) + 1000)).select("id", quality.bucket(F.col("id")).alias("b"))
    assert values.where("b > id or id - b > b / 128").count() == 0
    assert isinstance(quality.sketch(measured, []).schema, T.StructType)
