"""Sources and sinks."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import functions as F

from plantmon.operators.labels import pair_labels, segment_frame, zip_series
from plantmon.plans.staging import new_path, stage
from plantmon.queries.registry import query
from plantmon.queries.views import proc_events, proc_wide, scores, table
from plantmon.sources import manifest, readers, sinks

WIDE = "SELECT episode, raw_index, x0, x1 FROM proc_wide"


def _wide(spark, sf):
    return proc_wide(spark, sf).select("episode", "raw_index", "x0", "x1")


@query("read_csv", WIDE, views=["proc_wide"])
def _csv(spark, sf):
    path = new_path(spark, "csv")
    _wide(spark, sf).write.option("header", True).csv(path)
    return readers.read_csv(spark, path, "episode bigint, raw_index bigint, x0 double, x1 double")


@query("read_csv_inferred", "SELECT count(*) AS n, sum(episode)::BIGINT AS e, sum(x0) AS x0 FROM proc_wide",
       views=["proc_wide"], rounded={"x0": 2})
def _csv_inferred(spark, sf):
    path = new_path(spark, "csv")
    _wide(spark, sf).write.option("header", True).csv(path)
    df = readers.read_csv(spark, path)
    return df.agg(F.count("*").alias("n"), F.sum("episode").alias("e"), F.sum("x0").alias("x0"))


@query("read_dat", WIDE, views=["proc_wide"])
def _dat(spark, sf):
    path = new_path(spark, "dat")
    _wide(spark, sf).select(F.concat(F.lit("  "), F.concat_ws("   ", *["episode", "raw_index", "x0", "x1"]))).write.text(path)
    df = readers.read_dat(spark, path, ["episode", "raw_index", "x0", "x1"])
    return df.select(F.col("episode").cast("long"), F.col("raw_index").cast("long"), "x0", "x1")


def _packs(spark, sf, rows=2048):
    """Recordings packed into ``.npz`` contents of a bounded number of rows."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("raw_index")
        buffer = io.BytesIO()
        np.savez(buffer, x=pdf[["episode", "raw_index", "x0"]].to_numpy(dtype=float), y=pdf[["x1"]].to_numpy())
        return pd.DataFrame({"name": [f"pack_{pdf.episode.iloc[0]}_{pdf.raw_index.iloc[0] // rows}"],
                             "content": [buffer.getvalue()]})

    block = F.expr(f"raw_index div {rows}").alias("block")
    return _wide(spark, sf).groupBy("episode", block).applyInPandas(pack, "name string, content binary")


@query("read_npy_npz", WIDE, views=["proc_wide"])
def _npz(spark, sf):
    files = _packs(spark, sf).select(F.concat("name", F.lit(".npz")).alias("path"), "content")
    df = readers.decode_arrays(files, 3, 1)
    return df.select(F.col("x0").cast("long").alias("episode"), F.col("x1").cast("long").alias("raw_index"),
                     F.col("x2").alias("x0"), F.col("y0").alias("x1"))


def _write_files(df, root):
    """(name, content) rows as files of their own; writing one again gives the same file."""
    def write(batches):
        store, folder = pyarrow.fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pyarrow.fs.LocalFileSystem(), root)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content)
            yield batch[["name"]]

    stage(df.select("name", F.col("content").cast("binary").alias("content")).mapInPandas(write, "name string"), "written")
    return root


@query("read_array_ranges", WIDE, views=["proc_wide"])
def _ranges(spark, sf):
    """A file of some hundred rows is read by several tasks."""
    root = _write_files(_packs(spark, sf, 1 << 20).withColumn("name", F.concat("name", F.lit(".npz"))), new_path(spark, "packs"))
    df = readers.read_arrays(spark, root, 3, 1, part_bytes=1 << 13)
    return df.select(F.col("x0").cast("long").alias("episode"), F.col("x1").cast("long").alias("raw_index"),
                     F.col("x2").alias("x0"), F.col("y0").alias("x1"))


@query("read_table", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _table(spark, sf):
    return readers.read_table(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 45")


CARD_SQL = """SELECT episode, raw_index, x0, x1,
    CASE WHEN raw_index % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM proc_wide"""


def _card_files(spark, sf):
    root = new_path(spark, "card")
    wide = _wide(spark, sf)
    wide.where("raw_index % 5 <> 0").write.option("header", True).csv(f"{root}/normal")
    wide.where("raw_index % 5 = 0").write.option("header", True).csv(f"{root}/faulty")
    return root


@query("read_card", CARD_SQL, views=["proc_wide"])
def _card(spark, sf):
    card = {"root": _card_files(spark, sf), "data": "normal/*.csv", "test": ["faulty/*.csv"]}
    schema = "episode bigint, raw_index bigint, x0 double, x1 double"
    df = readers.read_card(spark, card, lambda s, files: readers.read_csv(s, files, schema))
    return df.drop("source")


@query("registered_source", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def _registered(spark, sf):
    name = "positive_suppliers"
    if name not in readers.ADAPTERS:
        readers.register_source(name, lambda s, files: s.read.parquet(*files).where("s_acctbal > 0").select("s_suppkey", "s_acctbal"))
    card = {"root": sf, "data": "supplier.parquet", "adapter": name}
    return readers.read_card(spark, card).select("s_suppkey", "s_acctbal")


@query("resolve_paths", """SELECT CASE WHEN raw_index % 5 = 0 THEN 'faulty' ELSE 'normal' END AS folder, count(*) AS "rows", sum(x0) AS x0
    FROM proc_wide GROUP BY 1""", views=["proc_wide"], rounded={"x0": 2})
def _paths(spark, sf):
    root = _card_files(spark, sf)
    files = readers.resolve_paths(spark, root, ["normal/*.csv", "faulty/*.csv"])
    df = readers.read_csv(spark, files, "episode bigint, raw_index bigint, x0 double, x1 double")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(normal|faulty)/", 1)
    return df.select(folder.alias("folder"), "x0").groupBy("folder").agg(F.count("*").alias("rows"), F.sum("x0").alias("x0"))


@query("segment_frame", """SELECT episode, raw_index, x0, 'E' || episode AS segment, 0 AS label,
    row_number() OVER (PARTITION BY episode ORDER BY raw_index) - 1 AS time FROM proc_gaps""", views=["proc_gaps"])
def _segment(spark, sf):
    from plantmon.queries.views import proc_gaps

    df = proc_gaps(spark, sf).select("episode", "raw_index", "x0", F.concat(F.lit("E"), "episode").alias("segment"))
    return segment_frame(df, "segment", "raw_index", label=0)


@query("read_fault_dirs", """SELECT c_name, CASE WHEN d = '' THEN 0 ELSE right(d, 2)::BIGINT END AS fault_id FROM
    (SELECT c_name, regexp_replace(c_name, '[^0-9]', '', 'g') AS d FROM customer)""")
def _faults(spark, sf):
    return readers.fault_ids(table(spark, sf, "customer").select("c_name"), "c_name")


@query("select_stored_features", "SELECT l_orderkey, l_quantity AS Qc, l_tax AS Tc FROM lineitem")
def _stored(spark, sf):
    stored = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    df = table(spark, sf, "lineitem").select("l_orderkey", *stored)
    return readers.select_stored(df, stored, ["Qc", "Tc"], 4, [0, 3])


@query("paired_arrays", """SELECT d.doc_id, d.n_chars, (CASE WHEN l.toxic IS NULL THEN d.doc_id % 9 + 1
    WHEN l.toxic > 0 THEN d.doc_id % 9 + 1 ELSE 0 END)::BIGINT AS toxic
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _paired(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return pair_labels(docs, table(spark, sf, "labels"), ["doc_id"], "toxic", case=F.col("doc_id") % 9 + 1)


@query("zip_control_output", """SELECT w.episode, w.raw_index, w.x0 AS u, e.x0 AS y FROM proc_wide w
    JOIN proc_events e ON w.episode = e.episode AND w.raw_index = e.raw_index""", views=["proc_wide", "proc_events"])
def _zip(spark, sf):
    u = proc_wide(spark, sf).select("episode", "raw_index", F.col("x0").alias("u"))
    y = proc_events(spark, sf).select("episode", "raw_index", F.col("x0").alias("y"))
    return zip_series(u, y, ["episode", "raw_index"])


@query("prediction_csv", """SELECT o_totalprice AS y0, o_custkey::DOUBLE AS x0, o_orderkey::DOUBLE AS x1 FROM orders
    WHERE o_orderkey % 50 <> 0""")
def _prediction(spark, sf):
    price = F.when(F.col("o_orderkey") % 50 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    df = table(spark, sf, "orders").select("o_orderdate", price.alias("price"), "o_custkey", "o_orderkey")
    return readers.prediction_table(df, ["o_orderdate"], [])


@query("file_manifest")
def _manifest(spark, sf):
    return manifest.file_manifest(spark, sf, "*.parquet").select("name", "bytes", "sha256")


@query("content_manifest", """SELECT url AS name, strlen(html)::BIGINT AS bytes, sha256(html) AS sha256 FROM pages""")
def _content(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"))
    return manifest.content_manifest(pages).select(F.col("path").alias("name"), "bytes", "sha256")


@query("archive_profile", """SELECT episode, count(*) AS "rows", 4::BIGINT AS width, min(raw_index) AS index_start,
    max(raw_index) AS index_end FROM proc_wide GROUP BY episode""", views=["proc_wide"])
def _profile(spark, sf):
    return manifest.archive_profile(proc_wide(spark, sf), "episode", 4, "raw_index")


@query("archive_mismatches", """SELECT coalesce(w.episode, s.s_suppkey) AS episode,
    CASE WHEN s.s_suppkey IS NULL THEN 'unexpected' WHEN w.n IS NULL THEN 'missing' ELSE 'rows differ' END AS problem
    FROM (SELECT episode, count(*) AS n FROM proc_wide GROUP BY episode) w
    FULL JOIN (SELECT s_suppkey, 600 AS n FROM supplier WHERE s_suppkey % 7 <> 0) s ON w.episode = s.s_suppkey
    WHERE w.n IS NULL OR s.n IS NULL OR w.n <> s.n""", views=["proc_wide"])
def _mismatches(spark, sf):
    expected = table(spark, sf, "supplier").where("s_suppkey % 7 <> 0").select(
        F.col("s_suppkey").alias("episode"), F.lit(600).alias("rows"), F.lit(4).alias("width"))
    profile = manifest.archive_profile(proc_wide(spark, sf), "episode", 4, "raw_index")
    return manifest.profile_mismatches(profile, expected, "episode")


DECISIONS = """SELECT episode, raw_index, x0 AS score, x0 > 40 AS alarm FROM proc_wide"""


def _decisions(spark, sf):
    return proc_wide(spark, sf).select("episode", "raw_index", F.col("x0").alias("score"), (F.col("x0") > 40).alias("alarm"))


@query("write_pointwise", DECISIONS, views=["proc_wide"])
def _pointwise(spark, sf):
    path = new_path(spark, "pointwise")
    sinks.write_pointwise(_decisions(spark, sf), path)
    return spark.read.schema("episode bigint, raw_index bigint, score double, alarm boolean").json(path)


@query("write_report_csv", DECISIONS, views=["proc_wide"])
def _report_csv(spark, sf):
    path = new_path(spark, "report")
    sinks.write_report_csv(_decisions(spark, sf), path, ["episode", "raw_index", "score", "alarm"])
    return readers.read_csv(spark, path, "episode bigint, raw_index bigint, score double, alarm boolean")


@query("save_summaries", """SELECT 'labels' AS summary, count(*) AS n FROM (SELECT DISTINCT label FROM proc_wide)
    UNION ALL SELECT 'episodes', count(DISTINCT episode) FROM proc_wide""", views=["proc_wide"])
def _summaries(spark, sf):
    wide = proc_wide(spark, sf)
    paths = sinks.write_summaries(
        {"labels": wide.groupBy("label").count(), "episodes": wide.groupBy("episode").count()}, new_path(spark, "summaries"))
    parts = [spark.read.parquet(p).agg(F.count("*").alias("n")).select(F.lit(k).alias("summary"), "n") for k, p in paths.items()]
    return parts[0].unionByName(parts[1])


@query("write_scores", """SELECT score_name AS stage, count(*) AS n, max(score) AS top FROM scores WHERE score_name <> 'price'
    GROUP BY score_name""", views=["scores"])
def _write_scores(spark, sf):
    path = new_path(spark, "scores")
    sinks.write_scores(scores(spark, sf).withColumn("stage", F.col("score_name")), path, files_per_stage=4)
    back = spark.read.parquet(path).where(F.col("stage") != "price")
    return back.groupBy("stage").agg(F.count("*").alias("n"), F.max("score").alias("top"))


@query("metric_log", """SELECT o_orderpriority AS trial, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1""")
def _metric_log(spark, sf):
    path = new_path(spark, "log")
    events = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("trial"), F.col("o_totalprice").alias("v"), "o_orderkey")
    sinks.append_metrics(events.where("o_orderkey % 2 = 0"), path)
    sinks.append_metrics(events.where("o_orderkey % 2 <> 0"), path)
    return spark.read.parquet(path).groupBy("trial").agg(F.count("*").alias("n"), F.max("v").alias("top"))


@query("manifest_mismatches", """SELECT url AS name, CASE WHEN page_id % 5 = 0 THEN 'not indexed' WHEN page_id % 7 = 0 THEN 'changed' END AS problem
    FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0 UNION ALL SELECT url || '?gone', 'missing' FROM pages WHERE page_id % 11 = 0""")
def _mismatches(spark, sf):
    # Two pages may share a url; a file's name in the index is its own, so the number stands in front of it.
    path, content = F.concat_ws(" ", F.col("page_id").cast("string"), "url").alias("path"), F.coalesce("html", F.lit("")).alias("content")
    pages = table(spark, sf, "pages").select("page_id", path, content)
    have = manifest.content_manifest(pages.drop("page_id")).select(F.col("path").alias("name"), "sha256")
    # The index lacks some files, holds another hash for some, and names some that are gone.
    other = F.when(F.col("page_id") % 7 == 0, F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.sha2("content", 256))
    index = pages.where("page_id % 5 <> 0").select(F.col("path").alias("name"), other.alias("sha256"))
    gone = pages.where("page_id % 11 = 0").select(F.concat("path", F.lit("?gone")).alias("name"), F.lit("0").alias("sha256"))
    found = manifest.manifest_mismatches(have, index.unionByName(gone))
    return found.withColumn("name", F.regexp_replace("name", "^[^ ]* ", ""))


NATIONS = "(SELECT c_nationkey AS k, 'nation_' || c_nationkey || '.txt' AS name, string_agg(c_name, chr(10) ORDER BY c_custkey) AS content FROM customer GROUP BY c_nationkey)"


def _nation_files(spark, sf):
    """One text file for the customers of every nation, and its content as a table."""
    names = F.array_sort(F.collect_list(F.struct("c_custkey", "c_name")))
    files = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_join(names["c_name"], "\n").alias("content"))
    files = stage(files.withColumn("name", F.concat(F.lit("nation_"), F.col("k").cast("string"), F.lit(".txt"))), "nations")
    return files, _write_files(files, new_path(spark, "nations"))


@query("verify_outputs", f"""SELECT name, CASE WHEN k % 5 = 0 THEN 'not indexed' ELSE 'changed' END AS problem FROM {NATIONS} WHERE k % 5 = 0 OR k % 7 = 0
    UNION ALL SELECT 'gone_' || name, 'missing' FROM {NATIONS} WHERE k % 4 = 0
    UNION ALL SELECT NULL, 'row count differs'""")
def _verify(spark, sf):
    files, root = _nation_files(spark, sf)
    # The index lacks some files, holds another hash for some, and names some that are gone.
    digest = F.when(F.col("k") % 7 == 0, F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.sha2("content", 256))
    index = files.where("k % 5 <> 0").select("name", digest.alias("sha256"))
    gone = files.where("k % 4 = 0").select(F.concat(F.lit("gone_"), "name").alias("name"), F.lit("0").alias("sha256"))
    return manifest.verify_outputs(spark, root, index.unionByName(gone), "nation_*", rows=table(spark, sf, "customer").count() + 1)


@query("range_manifest", f"""SELECT name, length(content)::BIGINT AS bytes, part::BIGINT AS part, length(piece)::BIGINT AS length, sha256(piece) AS sha256 FROM (
    SELECT *, substr(content, part * 500 + 1, 500) AS piece FROM (SELECT *, unnest(generate_series(0, (length(content) - 1) // 500)) AS part FROM {NATIONS}))""")
def _range_manifest(spark, sf):
    _, root = _nation_files(spark, sf)
    return manifest.range_manifest(spark, root, "nation_*", 500).select("name", "bytes", "part", "length", "sha256")


@query("tree_digest", f"""SELECT name, count(*) AS parts, sha256(string_agg(sha256(piece), '' ORDER BY part)) AS tree FROM (
    SELECT *, substr(content, part * 500 + 1, 500) AS piece FROM (SELECT *, unnest(generate_series(0, (length(content) - 1) // 500)) AS part FROM {NATIONS})) GROUP BY name""")
def _tree(spark, sf):
    _, root = _nation_files(spark, sf)
    return manifest.tree_digest(manifest.range_manifest(spark, root, "nation_*", 500)).select("name", "parts", "tree")


@query("changed_ranges", f"""SELECT name, part::BIGINT AS part, 'changed' AS problem FROM (SELECT name, k, unnest(generate_series(0, (length(content) - 1) // 500)) AS part FROM {NATIONS})
    WHERE k % 3 = 0 AND part % 2 = 1""")
def _changed(spark, sf):
    _, root = _nation_files(spark, sf)
    have = manifest.range_manifest(spark, root, "nation_*", 500)
    number = F.regexp_extract("name", r"(\d+)", 1).cast("int")
    other = (number % 3 == 0) & (F.col("part") % 2 == 1)
    index = stage(have.withColumn("sha256", F.when(other, F.lit("0")).otherwise(F.col("sha256"))), "index")
    return manifest.changed_ranges(spark, root, index, "nation_*", 500, trust_times=False)
