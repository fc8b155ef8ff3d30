"""Every corpus operator against a plain version, and on awkward input."""

import collections
import math
import os
import pathlib
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import brute  # noqa: E402
from plantmon.llm import (  # noqa: E402
    components, decontaminate, html_text, jaccard, language_id, line_dedup, neighbours, packing, sharding,
    substring_dedup, suffix_tree,
)
from plantmon.plans.staging import staging_root  # noqa: E402

PATTERN = "tests pick few words so that repeats are common and runs of them recur often in here".split()
# Names that results and helper columns of the operators have as well.
EXTRA = ["_hash", "_id", "_lines", "n_words", "score", "size", "id", "n_chars", "rank", "_row", "key"]


def documents(spark, rows):
    """(doc_id, text) rows with extra columns whose names clash."""
    kinds = [T.StructField(c, T.StringType()) for c in EXTRA]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *kinds])
    return spark.createDataFrame([(i, t, *[f"{c}-{i}" for c in EXTRA]) for i, t in rows], schema)


def corpus(seed=3, n=60):
    """Random texts with copies, near copies and shared passages, then awkward rows."""
    draw = random.Random(seed)
    rows = []
    passage = " ".join(draw.choice(PATTERN) + str(draw.randint(0, 40)) for _ in range(30))
    for i in range(n):
        kind = draw.random()
        if rows and kind < 0.2:
            text = draw.choice(rows)[1]
        elif rows and kind < 0.5:
            w = draw.choice(rows)[1].split(" ")
            w[draw.randrange(len(w))] = "Changed" + str(i)
            text = " ".join(w)
        else:
            text = " ".join(draw.choice(PATTERN) + str(draw.randint(0, 400)) for _ in range(draw.randint(3, 120)))
            if kind > 0.8:
                text += "\n" + passage + "\n" + text[:40]
        rows.append((i, text))
    long = " ".join(draw.choice(PATTERN) for _ in range(30_000))
    rows += [
        (1000, None), (1001, ""), (1002, " \t\n "), (1003, long), (1004, long[: len(long) // 2]), (1005, "one"),
        (1006, "one"), (1007, "É é x   y"), (1008, "same " * 300), (1009, "same " * 280),
    ]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def empty(spark):
    return documents(spark, []).where("false")


def test_substring_dedup(spark, rows):
    awkward = [*rows, rows[5], (None, rows[5][1]), (None, rows[9][1])]
    for window, crowded in ((12, 2_000), (12, 1), (20, 3)):
        out = substring_dedup.drop_repeated_substrings(documents(spark, awkward), window, crowded=crowded)
        assert out.columns[:2] == ["doc_id", "text"] and "n_removed" in out.columns
        got = [(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out.select("doc_id", "n_words", "n_removed", "text").collect()]
        want = brute.substring_dedup(awkward, window)
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert any(r[2] for r in want)
    assert substring_dedup.drop_repeated_substrings(empty(spark)).count() == 0


def test_substring_dedup_keeps_extra_columns(spark, rows):
    out = substring_dedup.drop_repeated_substrings(documents(spark, rows), 12)
    row = out.where("doc_id = 7").first().asDict()
    assert (row["_hash"], row["key"], row["id"]) == ("_hash-7", "key-7", "id-7")
    assert isinstance(row["n_words"], int)


def test_line_dedup(spark):
    shared = "A line that is shared by many documents, in full"
    rows = [(i, f"own {i}\n  {shared.upper() if i % 2 else shared}\t\nshort\nshort") for i in range(7)]
    rows += [(7, f"{shared}\n{shared}"), (8, None), (9, ""), (10, "\n\n"), (None, shared), (3, rows[3][1])]
    rows += [(20 + i, f"É{shared}") for i in range(3)] + [(30, "x" * 200_000)]
    out = line_dedup.drop_repeated_lines(documents(spark, rows))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert sorted(got, key=repr) == sorted(brute.line_dedup(rows, 40, 5), key=repr)
    assert out.where("doc_id = 1").first()["_lines"] == "_lines-1"
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup.query(documents(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("block_windows", [100_000, 7])
def test_decontamination(spark, rows, block_windows):
    draw = random.Random(1)
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(i, " ".join(draw.choice(texts).split()[3 : 3 + draw.choice([1, 4, 10, 15])])) for i in range(8)]
    items += [(50, None), (51, ""), (None, texts[0]), (52, "one"), (53, "no such words at all 1 2 3 4 5 6 7"), (52, "same same"), (9, "É é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.search_benchmark(documents(spark, [*rows, rows[4]]), bench, block_windows=block_windows)
    got = [(r["doc_id"], r["n_words"], r["hit_words"], r["hit_items"]) for r in out.select("doc_id", "n_words", "hit_words", "hit_items").collect()]
    want = brute.decontaminate([*rows, rows[4]], items, 10)
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(r[2] for r in want)
    assert decontaminate.search_benchmark(empty(spark), bench).count() == 0
    none = decontaminate.search_benchmark(documents(spark, rows), bench.where("false"))
    assert none.where(F.size("hit_words") > 0).count() == 0


@pytest.mark.parametrize(("crowded", "chunk", "load"), [(2_000, 4_000, 4_000_000), (2, 3, 4_000_000), (100, 2, 200)])
def test_jaccard(spark, rows, crowded, chunk, load):
    table = documents(spark, [*rows, rows[5], (None, "x")])
    out = jaccard.near_duplicate_groups(table, crowded=crowded, chunk=chunk, load=load)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    want = brute.near_duplicates(rows)
    assert got == want and len({c for _, c in want.values()}) < len(want)
    assert out.count() == len(rows) + 1
    assert jaccard.near_duplicate_groups(empty(spark)).count() == 0


def test_jaccard_passage_of_many_makes_no_cluster(spark, monkeypatch):
    """Texts that share a passage and nothing else are not verified against each other."""
    draw = random.Random(8)

    def words(n):
        return " ".join(f"w{draw.randrange(10**9)}" for _ in range(n))

    passage = words(40)
    rows = [(i, f"{words(40)}\n{passage}\n{words(20)}") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)]
    sizes, verify = [], jaccard._verify

    def counted(members, *args):
        sizes.extend(r["count"] for r in members.groupBy("cluster").count().collect())
        return verify(members, *args)

    monkeypatch.setattr(jaccard, "_verify", counted)
    out = jaccard.near_duplicate_groups(documents(spark, rows), crowded=20, common=6)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == brute.near_duplicates(rows)
    assert sizes == [2] * 5


def test_jaccard_joins_what_one_id_holds(spark):
    import corpus_pipeline

    a, b, c = ("one text of seven plain words here", "quite another one with other words in", "the third text is like no other")
    table = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, c), (9, ""), (5, None), (None, a), (11, "alone among all of the rest")]
    docs = documents(spark, table).withColumns({k: F.lit(None).cast("string") for k in ("lang", "source")})
    out = jaccard.near_duplicate_groups(docs).where("n_shingles > 0")
    assert {(r["doc_id"], r["component_id"]) for r in out.collect()} == {(3, 3), (5, 3), (7, 3), (9, 9), (11, 11)}
    kept = corpus_pipeline.drop_near_copies(spark, docs.withColumn("n_chars", F.length("text").cast("long")), "")
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(3, a), (5, None), (9, c), (9, ""), (None, a), table[-1]], key=repr)


def test_rtree_loses_no_pair():
    draw = np.random.default_rng(5)
    sets = []
    for _ in range(400):
        if sets and draw.random() < 0.5:
            old = sets[draw.integers(len(sets))]
            keep = old[draw.random(len(old)) < draw.uniform(0.75, 1)]
            new = draw.integers(0, 1 << 63, max(1, int(len(keep) * draw.uniform(0, 0.15))), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([keep, new])))
        else:
            sets.append(np.unique(draw.integers(0, 1 << 63, draw.integers(1, 300), dtype=np.uint64)))
    sizes = np.asarray([len(s) for s in sets])
    found = set()
    for i, j in jaccard.vector_pairs([jaccard.count_vector(s) for s in sets], sizes, 80):
        found |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    true = set()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                true.add((a, b))
    assert len(true) > 50 and true <= found
    assert len(found) < len(sets) * (len(sets) - 1) / 8


def test_components(spark):
    chain = [(i + 1, i) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    none = spark.createDataFrame([], "a long, b long")
    assert components.connected(none, "a", "b").count() == 0


def test_neighbours(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(600, 12))
    base[100:140] = base[100]  # equal vectors: ties go to the smaller id
    vectors = [(i, v.tolist(), "x") for i, v in enumerate(base)]
    # Rows that repeat an id are rows of their own, vectors of another length meet each other.
    vectors += [(20, base[20].tolist(), "x"), (7, (3 * base[0]).tolist(), "x"), (40, draw.normal(size=12).tolist(), "x")]
    vectors += [(1120, [1.0, 2.0], "x"), (1121, [2.0, 1.0], "x"), (1122, [5.0, 1.0], "x")]
    used = [(i, np.array(v)) for i, v, _ in vectors]
    vectors += [
        (1000, None, "x"), (1020, [], "x"), (1040, [0.0] * 12, "x"), (1060, [float("nan")] * 12, "x"), (1080, [None] * 12, "x"),
        (1100, [float("inf")] + [1.0] * 11, "x"), (None, [1.0] * 12, "x"),
    ]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in neighbours.nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [*range(0, 600, 20), 1120]
    assert sorted(got[1120]) == [(1, 1122, 7.0), (2, 1121, 4.0)]
    assert [v for _, v, _ in sorted(got[0])][0] == 7 and len(got[20]) == len(got[40]) == 40
    hits = total = 0
    for q, found in got.items():
        want = []
        for a, (i, v) in enumerate(used):
            if i == q:
                mine = sorted((-float(w @ v), j) for b, (j, w) in enumerate(used) if b != a and len(w) == len(v))[:20]
                want += [(r + 1, j, -s) for r, (s, j) in enumerate(mine)]
        assert sorted(r for r, _, _ in found) == sorted(r for r, _, _ in want)
        near = {(j, round(s, 9)) for _, j, s in want}
        hits += sum((v, round(s, 9)) in near for _, v, s in found)
        total += len(found)
    assert hits >= 0.9 * total
    few = neighbours.nearest_neighbours(table.where("vec_id < 5"), F.col("vec_id") == 0)
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2, 3, 4]
    assert neighbours.nearest_neighbours(table.where("false"), F.col("vec_id") == 0).count() == 0


def test_neighbours_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 10)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 3)
    vectors = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 1.0, 2.0]) for i in range(200)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    out = neighbours.nearest_neighbours(table, F.col("vec_id") % 20 == 0, recall=1.0)
    full = np.asarray([v for _, v in vectors])
    for q in range(0, 200, 20):
        scores = full @ full[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(200), -scores))[:20].tolist()
        assert [r["vec_id"] for r in out.where(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_adaptive_scan_abandons_and_stays_right():
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(3000, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    index = neighbours.Index(1.0, np.linalg.qr(draw.normal(size=(65, 65)))[0], np.zeros((6, 65)))
    row, found, _ = neighbours.scan(
        index, vectors[:20], np.arange(20), [np.arange(6)] * 20, vectors, np.arange(3000), np.arange(3000), np.arange(3000) % 6, 20
    )
    hits = sum(
        len(set(found[row == i]) & set(np.argsort(-(vectors @ vectors[i]))[1:21])) for i in range(20)
    )
    assert hits >= 0.97 * 400


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy</div>{before}
<article><h1>Title &amp; more</h1><p><b>First  line.<br>
next<p>Second&nbsp;one.</p><div class="share-buttons">Share</div><ul><li>a<li>b</ul>
<section id="comments"><p>Reader</p></section></article><!-- <p>x</p> --><footer>&copy; {n}</footer></body></html>"""


def test_html_deep_nesting_is_linear():
    import time

    def took(n, tag):
        start = time.process_time()
        assert html_text.walk(f"<{tag}>" * n + "x")[1] == ["x"]
        return time.process_time() - start

    for tag in ("div", "b", "p", "section"):
        assert took(200_000, tag) < 60 * max(took(20_000, tag), 0.02)


def test_html_keeps_columns_of_its_helpers_names(spark):
    names = ["text", "n_chars", "_trees", "_host", "_drop", "_page", "_main", "_tree", "n"]
    rows = [(i, f"http://h.example/{i}", f"<main><p>body {i}</p></main>", *[f"{c}{i}" for c in names]) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, " + ", ".join(f"{c} string" for c in names))
    out = html_text.extract_main_text(df).orderBy("page_id").collect()
    for i, r in enumerate(out):
        assert r["text"] == f"body {i}" and r["n_chars"] == 6
        assert all(r[c] == f"{c}{i}" for c in names[2:])


def test_html(spark):
    pages = [(i, f"http://host.example/{i}", PAGE.format(before="", n=i)) for i in range(3)]
    plain = "<body><div><p>Site line</p></div><div><p>Own text {0} here</p><p>and {0} more</p></div>"
    pages += [(10 + i, f"https://Other.example:80/{i}", plain.format(i)) for i in range(6)]
    pages += [(20, "http://lone.example/", plain.format(20)), (21, None, plain.format(21)), (22, "http://x/", None), (23, "http://x/", ""),
              (24, "http://x/", "<p>cut &amp; off <b"), (25, "http://x/", "<div " * 3 + "<p title='a>b'>q</p>"), (None, None, "<p>id"),
              (26, "http://x/", "<div>" * 3000 + "deep"), (27, "http://x/", "just text"), (0, pages[0][1], pages[0][2])]
    schema = "page_id long, url string, html string"
    out = html_text.extract_main_text(spark.createDataFrame(pages, schema).withColumn("_page", F.lit("own")))
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got[0] == "Title & more\nFirst line. next\nSecond one.\na\nb"
    assert got[10] == "Own text 0 here\nand 0 more"
    assert got[20] == "Site line\nOwn text 20 here\nand 20 more" and got[21].startswith("Site line")
    assert (got[22], got[23], got[24], got[None], got[26], got[27]) == ("", "", "cut & off", "id", "deep", "just text")
    assert out.count() == len(pages) and {r["_page"] for r in out.collect()} == {"own"}
    assert out.where("n_chars <> length(text)").count() == 0
    assert html_text.extract_main_text(spark.createDataFrame([], schema)).count() == 0


def test_html_keeps_copies_of_one_page(spark):
    body = "<body><article><div class='entry-content'><p>Whole {0}</p><ul><li>a</ul></div><table><tr><td>b</table></article>"
    pages = [(i, f"http://copies.example/{i}", body.format("text")) for i in range(6)]
    pages += [(10 + i, f"http://plain.example/{i}", "<body><p>One</p><p>Two</p>") for i in range(6)]
    site = "<body><div><p>Site</p></div><article><p>Own {0}</p><ul><li>a</ul><div><p>Sign up</p></div></article>"
    pages += [(20 + i, f"http://site.example/{i}", site.format(i)) for i in range(40)]
    pages += [(60 + i, f"http://few.example/{i}", site.format(i % 4)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == "Whole text\na\nb" and got[10] == "One\nTwo"
    assert got[20] == "Own 0\na" and got[60] == "Own 0\na\nSign up"


@pytest.mark.parametrize(("page", "text"), [
    ("<div class='layout has-sidebar'><p>a</p><div class='post-sidebar'>b</div></div>", "a"),
    ("<div class='no-sidebar with-menu'><article><p>a</p></article></div>", "a"),
    ("<article class='post category-social comments-open'><p>a</p></article>", "a"),
    ("<article class='sponsored related'><p>a</p><div class='related'>b</div></article>", "a"),
    ("<div id='share-story'><p>b</p><main><p>a</p></main></div>", "a"),
    ("<div id='share-story'><article><p>a</p></article><article><p>c</p></article></div>", "a\nc"),
    ("<main><div id='share-story'><article><p>a</p></article></div></main>", "a"),
    ("<article><p>a</p></article><div id='comments'><article class='comment-body'>b</article></div>", "a"),
    ("<main><p>a</p><div class='comments'><article>b</article></div></main><nav><article>b</article></nav>", "a"),
])
def test_html_names_of_wrappers(page, text):
    assert "\n".join(html_text.walk(f"<body>{page}</body>")[1]) == text


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_packing_round_trip(spark, rows):
    from tokenizers import Tokenizer

    table = documents(spark, [*rows, rows[3], (None, "no id")])
    out = packing.pack_documents(table, tokenizer(), capacity=64, keep_ids=True).collect()
    plain = Tokenizer.from_file(tokenizer())
    want = {}
    for i, text in rows:
        want[i] = [*(plain.encode(text, add_special_tokens=False).ids if text else []), 0]
    pieces, bins = {}, {}
    for r in out:
        assert 0 < r["length"] <= 64 and len(r["ids"]) == r["length"]
        assert zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], {}).setdefault(r["piece"], (r["start"], r["ids"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in want.items():
        found = [pieces[i][p] for p in sorted(pieces[i])]
        assert [x for _, ids in found for x in ids] == text
        assert [s for s, _ in found] == np.cumsum([0, *[len(ids) for _, ids in found[:-1]]]).tolist()
        assert all(len(ids) == 64 for _, ids in found[1:])
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *[n for _, n in held[:-1]]]).tolist()
        assert sum(n for _, n in held) <= 64
    assert len(bins) <= 1.05 * sum(r["length"] for r in out) / 64 + 1
    assert packing.pack_documents(empty(spark), tokenizer()).count() == 0


def test_packing_stages_the_pieces_alone(spark, monkeypatch):
    staged = []
    real = packing.stage
    monkeypatch.setattr(packing, "stage", lambda frame, label="stage": staged.append(label) or real(frame, label))
    table = spark.createDataFrame([(i, "word " * (i % 50)) for i in range(200)], "doc_id long, text string")
    assert packing.pack_documents(table, tokenizer(), capacity=64).select("doc_id").distinct().count() == 200
    assert staged == ["pieces"]


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    draw = random.Random(seed)
    lengths = [min(2048, int(draw.choice([draw.expovariate(1 / 700), draw.uniform(1, 2047)])) + 1) for _ in range(draw.choice([1, 7, 4000]))]
    histogram = {}
    for x in lengths:
        histogram[x] = histogram.get(x, 0) + 1
    bins = packing.plan_packing(histogram, 2048)
    found = {}
    for b in bins:
        assert sum(b.lengths) + b.room == 2048 and b.room >= 0 and b.count > 0
        for x in b.lengths:
            found[x] = found.get(x, 0) + b.count
    assert found == histogram
    if len(lengths) > 100:
        assert sum(b.count for b in bins) <= 1.02 * max(sum(lengths) / 2048, sum(x > 1024 for x in lengths)) + 2


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    encode, plain = packing.Encoder(tokenizer()), Tokenizer.from_file(tokenizer())
    assert encode.fast is not None
    draw = random.Random(8)
    letters = [chr(c) for c in range(0x260)] + list("日本 <|endoftext|>") + ["<|endoftext|>", "'ll", "'s", "  ", "\n\n"]
    for _ in range(4000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(1, 16)))
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_sharding(spark, rows):
    hot = [(5000 + i, "a very common text") for i in range(60)]
    table = [*rows, *hot, rows[2], (None, "x"), (None, None)]
    out = sharding.shard_documents(documents(spark, table), shards=8).collect()
    assert len(out) == len(table)
    places = {}
    for r in out:
        places.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(places.get(s, [])) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    text = {i: t for i, t in table if i is not None}
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 for r in out if r["doc_id"] is not None)
    assert all(r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in out if r["doc_id"] is not None)
    groups = {}
    for r in out:
        if r["doc_id"] is not None and text[r["doc_id"]] is not None:
            groups.setdefault(text[r["doc_id"]], []).append(r["shard"])
    split = [t for t, s in groups.items() if len(s) > 1 and len(set(s)) > 1]
    assert len(split) <= 8  # the hot group, and at most the last group a full shard holds
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}
    assert sharding.shard_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("linked", [0.5, 0.96])
def test_no_group_that_fits_a_shard_is_cut(spark, linked):
    texts = [f"copy {i // 2}" for i in range(int(4000 * linked) - 330)]
    texts += [f"some {i // 3}" for i in range(30)] + ["many"] * 300
    texts += [f"alone {i}" for i in range(4000 - len(texts))]
    out = sharding.shard_documents(documents(spark, list(enumerate(texts))), shards=8).collect()
    places = {}
    for r in out:
        places.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert [t for t, p in places.items() if len(p) > 1] == []
    assert sorted(sum(r["shard"] == s for r in out) for s in range(8)) == [500] * 8


def test_quota_is_kept():
    flows = {(0, 1, 2): 50, (1, 0, 0): 10, (2, 1, 1): 30}
    share = sharding.admitted(flows, [100, 100, 100], 110)
    after = [100, 100, 100]
    for (a, b, _), n in flows.items():
        moved = round(share[(a, b, _)] * n)
        after[a] -= moved
        after[b] += moved
    assert max(after) <= 110 and any(share.values())


def test_every_language_is_learned_within_its_own_bound(spark):
    draw = random.Random(8)
    rows = [(i, " ".join(draw.choice(["lorem", "ipsum", "dolor"]) for _ in range(30)), "big") for i in range(500)]
    rows += [(1_000 + 10 * k + j, " ".join([chr(0x4E00 + 40 * k + j)] * 20), f"l{k}") for k in range(270) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    order = F.xxhash64("doc_id", "text")
    found = language_id.training_windows(docs, "text", "lang", order, 30, 2)
    texts = {lang: len([1 for x, _ in found if x == lang]) for lang in {x for x, _ in found}}
    assert len(texts) == 271 and 30 <= texts["big"] <= 90 and min(texts.values()) >= 2


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.query(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert held[0] >= 0.97 and held[1] > 200
    assert out.where("score < 0 or score > 1 or score is null").count() == 0
    wanted = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in out.collect()}
    assert {r["doc_id"]: r["held_out"] for r in out.collect()} == wanted
    network = language_id.fit_language_id(docs)
    odd = [(1, None), (2, ""), (3, "12 3!"), (None, "the"), (4, "é"), (5, "日本語"), (6, "the and of " * 30_000), (6, "the and of " * 30_000)]
    got = {}
    for r in language_id.predict_language(documents(spark, odd), network).collect():
        got[r["doc_id"]] = (r["lang_pred"], r["score"])
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[6][0] == "en" and all(got[i][0] in network.languages for i in (None, 4, 5))
    assert language_id.predict_language(empty(spark), network).count() == 0
    assert language_id.fit_language_id(docs.where("false")) is None
    assert language_id.predict_language(documents(spark, odd), None).where("lang_pred <> 'und'").count() == 0


def test_compiled_network_is_the_network():
    draw = np.random.default_rng(1)
    windows = draw.integers(0, 256, (40, language_id.WINDOW)).astype(np.uint8)
    net = language_id.train(windows, np.arange(40) % 3, ["a", "b", "c"], epochs=1)
    padded = np.zeros((40, language_id.WINDOW + 5), np.int64)
    padded[:, : language_id.WINDOW] = windows
    response = sum(net.embedding[padded[:, j : j + language_id.WINDOW]] @ net.filters[j] for j in range(5))
    plain = np.maximum(response.max(axis=1) + net.offset, 0)
    assert np.allclose(net.compiled().features(windows), plain, atol=1e-4)


def plain_tree(training, bounds):
    """The suffix tree from plain counts of tuples, and the log10 probability of a token list."""
    table = [[*brute.words((t or "").translate(brute.LOWER)), None] for t in training]
    grams = collections.Counter()
    for tokens in table:
        for n in range(1, bounds.depth + 2):
            grams.update(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))
    words = {g[0]: n for g, n in grams.items() if len(g) == 1}
    size, singles, doubles = sum(words.values()), *(sum(n == k for n in words.values()) for k in (1, 2))
    held_back = min(0.9, max(0.1, singles / (singles + 2 * doubles))) if singles else 0.5
    cost = 0.5 * math.log(max(2, size))
    follow = collections.defaultdict(dict)
    for g, n in grams.items():
        if len(g) > 1 and n >= bounds.pair and grams[g[:-1]] >= bounds.string:
            follow[g[:-1]][g[-1]] = n

    def chance(context, word, states):
        if not context:
            return (words[word] - held_back) / size if word in words else held_back * len(words) / size
        if context not in states:
            return chance(context[1:], word, states)
        n, total = follow[context].get(word, 0), grams[context]
        escape = 1 - sum(m - bounds.discount for m in follow[context].values()) / total
        return max(n - bounds.discount, 0) / total + escape * chance(context[1:], word, states)

    kept = set()
    for context, after in follow.items():
        total = grams[context]
        theirs = {w: chance(context[1:], w, follow) for w in after}
        gain = sum(n / total * math.log(n / total / theirs[w]) for w, n in after.items())
        rest = 1 - sum(after.values()) / total
        if rest > 1e-12:
            gain += rest * math.log(rest / max(1e-9, 1 - sum(theirs.values())))
        if total * gain > cost * (len(after) + 1):
            kept |= {context[i:] for i in range(len(context))}

    def score(tokens):
        out = 0.0
        for t, word in enumerate(tokens):
            context = ()
            for d in range(1, bounds.depth + 1):
                if t >= d and tuple(tokens[t - d : t]) in kept:
                    context = tuple(tokens[t - d : t])
            out += math.log10(chance(context, word, kept))
        return out

    return kept, words, lambda c, w: chance(c, w, kept), score


def test_suffix_tree(spark, rows):
    table = [*rows, *[(2000 + i, rows[1][1]) for i in range(30)], (None, "x y"), rows[4]]
    held = [r for r in table if r[0] is not None and r[0] % 3 == 0]
    training = [r for r in table if not (r[0] is not None and r[0] % 3 == 0)]
    out = suffix_tree.score_documents(documents(spark, table), documents(spark, training)).collect()
    counts = brute.word_counts([t for _, t in training])
    total, types = sum(counts.values()), len(counts)
    text = dict(table)
    assert len(out) == len(table)
    for r in out:
        tokens = [*brute.words((text[r["doc_id"]] or "").translate(brute.LOWER)), "\0end"]
        base = sum(np.log10((counts[w] + 1) / (total + types + 1)) for w in tokens)
        assert r["n_tokens"] == len(tokens) and r["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert r["train_tokens"] == total and abs(r["base_score"] - base) < 1e-6
        assert np.isfinite(r["score"]) and r["score"] <= 0
    assert {r["_row"] for r in out} >= {"_row-1"}
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert held
    assert suffix_tree.score_documents(empty(spark), documents(spark, training)).count() == 0
    for bounds in (None, suffix_tree.Bounds(held=-1)):
        blank = suffix_tree.score_documents(documents(spark, [(1, "a b"), (2, None)]), empty(spark), bounds).collect()
        assert [(r["base_score"], r["score"], r["n_known"], r["train_tokens"]) for r in blank] == [(0.0, 0.0, 0, 0)] * 2


@pytest.mark.parametrize("held", [1 << 23, 0])
def test_suffix_tree_equals_plain_counts(spark, rows, held):
    """Scores equal those of a tree built from tuples in plain Python, held by tasks or joined."""
    bounds = suffix_tree.Bounds(held=held)
    training = [*[r for r in rows if r[0] < 60] * 2, *[r for r in rows if r[0] % 2]]
    training += [(500 + k, f"start{k} common middle end{k}") for k in range(6) for _ in range(40)]
    kept, words, chance, score = plain_tree([t for _, t in training], bounds)
    assert {len(c) for c in kept} == {1, 2, 3} and len(kept) > 30
    for context in [*sorted(kept)[:5], max(kept, key=len)]:
        assert abs(sum(chance(context, w) for w in words) + chance(context, "\0unknown") - 1) < 1e-6
    table = [*rows, (900, None), (901, ""), (902, "of of zzzzz the　x"), (None, rows[1][1]), rows[1], training[-1]]
    got = suffix_tree.score_documents(documents(spark, table), documents(spark, training), bounds).collect()
    assert len(got) == len(table)
    text = dict(table)
    for r in got:
        tokens = [*brute.words((text[r["doc_id"]] or "").translate(brute.LOWER)), None]
        assert r["n_tokens"] == len(tokens) and r["score"] == pytest.approx(score(tokens), abs=1e-6)
        assert r["n_known"] == sum(w in words for w in tokens)


def test_suffix_tree_grows_with_the_corpus(spark):
    """Twice the material gives twice the states; a bitmap lets every key through that it was given."""
    sizes = []
    for n in (20, 40):
        texts = [(i, " ".join(f"w{i}x{j}" for j in range(6))) for i in range(n) for _ in range(10)]
        table = documents(spark, texts).select("text")
        counted = suffix_tree.word_counts(table)
        tree = suffix_tree.learn_tree(table, counted, suffix_tree.totals(counted), suffix_tree.Bounds())
        sizes.append(tree.where("escape IS NOT NULL").count())
    assert sizes[0] >= 20 and sizes[1] >= 2 * sizes[0]
    keys = spark.range(5000).selectExpr("shiftrightunsigned(xxhash64(id), 1) AS key")
    bitmap = suffix_tree.marks(keys)
    values = keys.toArrow().column("key").to_numpy()
    assert suffix_tree.marked(bitmap, values).all() and suffix_tree.marked(bitmap, values + 1).mean() < 0.01
    pairs = keys.selectExpr("key AS a", "key + 7 AS b").select("a", "b", suffix_tree._joined_key("a", "b").alias("c")).toArrow()
    a, b, c = (pairs.column(x).to_numpy() for x in "abc")
    assert (suffix_tree.joined_key(a, b) == c).all()
    places = suffix_tree.Lookup(np.sort(values))
    assert (places.keys[places.find(values)] == values).all() and (places.find(np.append(values + 1, -1)) == -1).all()
    assert (suffix_tree.Lookup(values[:0]).find(values) == -1).all()


def test_suffix_tree_leaves_only_the_tree(spark):
    """What the levels staged is gone when the tree is written, and the tree is whole."""
    table = documents(spark, [(i, "a b c d") for i in range(40)]).select("text")
    counted = suffix_tree.word_counts(table)
    folder = pathlib.Path(staging_root(spark).removeprefix("file:")) / "plantmon"
    before = set(folder.glob("*"))
    tree = suffix_tree.learn_tree(table, counted, suffix_tree.totals(counted), suffix_tree.Bounds())
    assert [p.name[:5] for p in set(folder.glob("*")) - before] == ["tree-"]
    assert tree.where("escape IS NOT NULL").count()


def test_suffix_tree_hands_on_small_batches():
    """A batch of long texts leaves in pieces, so its windows are never all in memory."""
    texts = pa.RecordBatch.from_arrays([pa.array(["word " * 40_000] * 20)], names=["text"])
    got = list(suffix_tree.by_words(texts, 0, lambda part: [pa.array([part.num_rows])], ["rows"]))
    assert [b.column(0)[0].as_py() for b in got] == [4] * 5


def test_suffix_tree_windows_end_at_the_last_state(spark):
    """A window is no longer than a state and the word after it."""
    words = np.arange(100, 112)
    levels = suffix_tree.string_keys(words, np.array([0, 6]), 4)
    cut, before = suffix_tree.reaching(levels, np.zeros(1 << 20, np.uint64))
    assert (np.stack([*cut[1:], *before]) == -1).all() and (cut[0] == words).all()
    keys = [int(levels[0][2]), int(levels[1][2]), int(levels[1][7])]
    bitmap = suffix_tree.marks(spark.createDataFrame([(k,) for k in keys], "key long"))
    cut, before = suffix_tree.reaching(levels, bitmap)
    assert [np.flatnonzero(level >= 0).tolist() for level in cut[1:]] == [[3], [3], []]
    assert [level[3] for level in before] == [keys[0], keys[1], -1]
    assert [level[3] for level in cut[:3]] == [level[3] for level in levels[:3]]


@pytest.mark.parametrize("seed", range(5))
def test_wu_manber_finds_what_a_scan_finds(seed):
    draw = np.random.default_rng(seed)
    ids = draw.integers(0, 4, 3_000)
    cuts = np.sort(draw.choice(np.arange(1, 3_000), 20, replace=False))
    starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [3_000]])
    for length in (1, 2, 3, 7):
        windows = np.unique(draw.integers(0, 4, (12, length)), axis=0)
        at, row = decontaminate.Patterns(windows).search(ids, starts, stops)
        want = {
            (p, r) for a, b in zip(starts, stops, strict=True) for p in range(a, b - length + 1)
            for r in range(len(windows)) if (ids[p : p + length] == windows[r]).all()
        }
        got = list(zip(at.tolist(), row.tolist(), strict=True))
        assert len(got) == len(want) and set(got) == want


def test_word_hashes_follow_the_words():
    from plantmon.llm.common import WordHasher

    import pyarrow as pa

    draw = random.Random(9)
    texts = ["".join(draw.choice("abAB é\t\n\x0b\x1c ") for _ in range(draw.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " ", "a" * 5_000, "the end"]
    column = pa.array(["skipped", *texts])[1:]
    for lower in (False, True):
        hashes, sizes = WordHasher(lower)(column)
        split = [brute.words(t.translate(brute.LOWER) if t and lower else t) for t in texts]
        assert sizes.tolist() == [len(w) for w in split]
        names = {}
        for word, value in zip([w for one in split for w in one], hashes.tolist(), strict=True):
            assert names.setdefault(word, value) == value
        assert len(set(names.values())) == len(names)
