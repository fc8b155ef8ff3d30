"""Readers, manifests, sinks and the live path on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantmon.operators import scale
from plantmon.plans import stage, staging_root
from plantmon.sources import arrays, manifest, readers, sinks
from plantmon.streaming import live


def test_array_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(3, 2))
    np.savez(tmp_path / "b.npz", x=np.ones((2, 2)), y=np.array([5.0, 6.0]))
    np.savez(tmp_path / "c.npz", other=np.zeros((4, 2)))
    plain = readers.read_arrays(spark, [str(tmp_path / "a.npy"), str(tmp_path / "c.npz")], 2, chunk=2)
    assert plain.count() == 7 and plain.where("key = 'other'").agg(F.max("raw_index")).first()[0] == 3
    both = readers.read_arrays(spark, str(tmp_path / "b.npz"), 2, 1).orderBy("raw_index").collect()
    assert [r.y0 for r in both] == [5.0, 6.0]
    with pytest.raises(Exception, match="differ from the declared"):
        readers.read_arrays(spark, str(tmp_path / "a.npy"), 3).collect()
    keyed = readers.read_keyed_arrays(spark, str(tmp_path / "b.npz"), 2)
    assert {r.key for r in keyed.collect()} == {"x", "y"}


def test_row_ranges_of_one_file_are_read_by_several_tasks(spark, tmp_path):
    draw = np.random.default_rng(0)
    x, y = draw.normal(size=(5_000, 3)).astype(np.float32), draw.integers(0, 99, 5_000)
    np.save(tmp_path / "rows.npy", x)
    np.save(tmp_path / "columns.npy", np.asfortranarray(x))
    np.savez(tmp_path / "open.npz", x=x, y=y)
    np.savez_compressed(tmp_path / "packed.npz", x=np.asfortranarray(x), y=y.astype(">i4"))
    np.save(tmp_path / "deep.npy", x.reshape(1_250, 2, 6)[:, :, :2])
    np.save(tmp_path / "none.npy", np.empty((0, 3)))
    for name, wide, parts in (("rows.npy", 0, 30), ("columns.npy", 0, 30), ("open.npz", 1, 50), ("packed.npz", 1, 1)):
        df = readers.read_arrays(spark, str(tmp_path / name), 3, wide, part_bytes=2_048, chunk=64)
        rows = df.withColumn("task", F.spark_partition_id()).orderBy("raw_index").collect()
        assert [r["raw_index"] for r in rows] == list(range(5_000))
        assert np.array_equal([[r["x0"], r["x1"], r["x2"]] for r in rows], x.astype(float))
        assert not wide or [r["y0"] for r in rows] == y.tolist()
        assert len({r["task"] for r in rows}) >= parts
        some = readers.read_arrays(spark, str(tmp_path / name), 3, wide, columns=["x2"], part_bytes=2_048)
        assert some.columns == ["source", "key", "raw_index", "x2"]
        assert some.agg(F.sum("x2")).first()[0] == pytest.approx(float(x[:, 2].astype(float).sum()))
    assert readers.read_arrays(spark, str(tmp_path / "deep.npy"), 4).count() == 1_250
    assert readers.read_arrays(spark, str(tmp_path / "none.npy"), 3).count() == 0


def test_many_ranges_share_tasks(spark, tmp_path, monkeypatch):
    x = np.arange(3_000.0).reshape(1_000, 3)
    for i in range(4):
        np.savez(tmp_path / f"f{i}.npz", x=x + i, y=x[:, 0])
    np.savez_compressed(tmp_path / "packed.npz", x=x, y=x[:, 0])
    np.savez(tmp_path / "none.npz", x=x[:0], y=x[:0, 0])

    def rows():
        df = readers.read_arrays(spark, str(tmp_path), 3, 1, columns=["x2", "y0"], part_bytes=512)
        return df.rdd.getNumPartitions(), sorted(map(tuple, df.collect()))

    parts, want = rows()
    monkeypatch.setattr(arrays, "RANGES", 20)
    fewer, got = rows()
    assert parts > 200 and fewer <= 20 and got == want and len(got) == 5_000


def test_array_reads_stay_small(tmp_path, monkeypatch):
    np.save(tmp_path / "c.npy", np.asfortranarray(np.arange(40_000.0).reshape(10_000, 4)))
    asked = []

    class Counting:
        def __init__(self, file):
            self.file = file

        def __getattr__(self, name):
            return getattr(self.file, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read_at(self, n, at):
            asked.append(n)
            return self.file.read_at(n, at)

    url = str(tmp_path / "c.npy")
    real = arrays.open_file
    monkeypatch.setattr(arrays, "open_file", lambda u: Counting(real(u)))
    reader = arrays.ArrayReader({"paths": f'["{url}"]', "x_width": "4", "chunk": "100"}, arrays.array_schema(4, 0, ["x1"]))
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(asked) == 800 and sum(asked) == 80_000  # one column of four, a hundred numbers at a time
    assert max(b.num_rows for b in batches) == 100
    assert np.concatenate([b.column(3).to_numpy() for b in batches]).tolist() == list(np.arange(1.0, 40_000.0, 4))


def test_bad_array_files_are_refused(spark, tmp_path):
    np.savez(tmp_path / "uneven.npz", x=np.ones((3, 1)), y=np.ones(2))
    np.savez(tmp_path / "two.npz", a=np.ones((3, 1)), b=np.ones(2))
    np.save(tmp_path / "objects.npy", np.array([{}], dtype=object), allow_pickle=True)
    (tmp_path / "text.npy").write_text("not an array")
    for name, wide, words in (("uneven.npz", 1, "differ in rows"), ("two.npz", 0, "exactly one"), ("objects.npy", 0, "objects"), ("text.npy", 0, "not an array")):
        with pytest.raises(Exception, match=words):
            readers.read_arrays(spark, str(tmp_path / name), 1, wide).collect()
    with pytest.raises(ValueError, match="x9"):
        readers.read_arrays(spark, str(tmp_path / "two.npz"), 1, columns=["x9"])


def test_pages_of_one_url_are_files_of_their_own(spark, tmp_path):
    from plantmon.queries import QUERIES

    pages = [(i, f"http://a.example/{i % 7}", f"text {i}") for i in range(40)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, QUERIES["manifest_mismatches"].run(spark, str(tmp_path)).select("name", "problem").collect()))
    want = [(u, "not indexed" if i % 5 == 0 else "changed") for i, u, _ in pages if i % 5 == 0 or i % 7 == 0]
    assert got == sorted(want + [(u + "?gone", "missing") for i, u, _ in pages if i % 11 == 0])


def test_hash_tree_finds_the_changed_range_and_rereads_no_more(spark, tmp_path, monkeypatch):
    (tmp_path / "a.bin").write_bytes(bytes(range(256)) * 40)
    (tmp_path / "b.bin").write_bytes(b"b" * 1_000)
    (tmp_path / "gone.bin").write_bytes(b"x")
    path = str(tmp_path)
    index = stage(manifest.range_manifest(spark, path, "*.bin", 1_024), "index")
    whole = {r["name"]: r for r in manifest.file_manifest(spark, path, "*.bin").collect()}
    import hashlib

    for name, r in whole.items():
        assert r["sha256"] == hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()
    tree = {r["name"]: (r["parts"], r["tree"]) for r in manifest.tree_digest(index).collect()}
    pieces = [hashlib.sha256((bytes(range(256)) * 40)[i : i + 1_024]).hexdigest() for i in range(0, 10_240, 1_024)]
    assert tree["a.bin"] == (10, hashlib.sha256("".join(pieces).encode()).hexdigest())
    assert manifest.changed_ranges(spark, path, index, "*.bin", 1_024).count() == 0
    data = bytearray((tmp_path / "a.bin").read_bytes())
    data[5_000] ^= 1
    (tmp_path / "a.bin").write_bytes(data + b"more" * 300)
    (tmp_path / "new.bin").write_bytes(b"n")
    (tmp_path / "gone.bin").unlink()
    (tmp_path / "b.bin").write_bytes(b"b" * 100)
    got = {(r["name"], r["part"], r["problem"]) for r in manifest.changed_ranges(spark, path, index, "*.bin", 1_024).collect()}
    assert got == {("a.bin", 4, "changed"), ("a.bin", 10, "added"), ("a.bin", 11, "added"), ("b.bin", 0, "changed"), ("new.bin", None, "not indexed"), ("gone.bin", None, "missing")}
    read = []
    real = manifest._hashed
    monkeypatch.setattr(manifest, "_hashed", lambda files: (read.append({r[0].rsplit("/", 1)[1] for r in files.select("path").collect()}), real(files))[1])
    manifest.changed_ranges(spark, path, index, "*.bin", 1_024).collect()
    assert read == [{"a.bin", "b.bin"}]


def test_text_readers(spark, tmp_path):
    (tmp_path / "t.dat").write_text("  1.0   2e3\n\n 3 4 \n")
    rows = readers.read_dat(spark, str(tmp_path / "t.dat"), ["a", "b"]).orderBy("a").collect()
    assert [(r.a, r.b) for r in rows] == [(1.0, 2000.0), (3.0, 4.0)]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    assert readers.read_csv(spark, str(tmp_path / "t.csv")).dtypes == [("a", "int"), ("b", "string")]


def test_cards_and_missing_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a\n1\n")
    (tmp_path / "f.csv").write_text("a,c\n2,3\n")
    card = readers.read_card(spark, {"root": str(tmp_path), "data": "n.csv", "test": ["f.csv"]})
    got = {r.split: (r.a, r.c) for r in card.collect()}
    assert got == {"train": (1, None), "test": (2, 3)}
    with pytest.raises(FileNotFoundError):
        readers.resolve_paths(spark, str(tmp_path), ["absent*.csv"])


def test_stored_answer_columns_never_become_features(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2, 9.0)], "id int, c0 double, c1 double, answer double")
    out = readers.select_stored(df, ["c0", "c1", "answer"], ["u", "y"], 3, [0, 1])
    assert out.columns == ["id", "u", "y"]
    with pytest.raises(ValueError):
        readers.select_stored(df, ["c0", "c1"], ["u", "y"], 3, [0, 1])
    with pytest.raises(ValueError):
        readers.select_stored(df, ["c0", "c1", "answer"], ["u"], 3, [7])


def test_fault_ids(spark):
    names = ["fault01", "case12b", "d3", "normal", "run104"]
    df = readers.fault_ids(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    assert {r.name: r.fault_id for r in df.collect()} == {"fault01": 1, "case12b": 12, "d3": 3, "normal": 0, "run104": 4}


def test_registered_sources(spark):
    readers.register_source("ones", lambda s: s.range(3))
    assert readers.ADAPTERS["ones"](spark).count() == 3
    with pytest.raises(ValueError):
        readers.register_source("ones", lambda s: s.range(1))


def test_cards_name_their_adapter(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "t"))
    card = readers.read_card(spark, {"root": str(tmp_path), "data": "t", "adapter": "table"})
    assert card.count() == 4 and card.first().split == "train"


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.range(3)
    sinks.write_pointwise(df, str(tmp_path / "p"))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_pointwise(df, str(tmp_path / "p"))
    sinks.write_report_csv(df, str(tmp_path / "c"), ["id"])
    with pytest.raises(Exception, match="already exists"):
        sinks.write_report_csv(df, str(tmp_path / "c"), ["id"])


def test_outputs_that_changed_are_found(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.range(10).coalesce(1).write.parquet(path)
    index = stage(manifest.file_manifest(spark, path, "part-*").select("name", "sha256"))
    assert manifest.verify_outputs(spark, path, index).count() == 0
    spark.range(3).coalesce(1).write.mode("append").parquet(path)
    assert [r.problem for r in manifest.verify_outputs(spark, path, index).collect()] == ["not indexed"]


def test_profile_mismatches(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "seg string, i bigint")
    want = spark.createDataFrame([("a", 2, 7), ("b", 5, 7), ("c", 1, 7)], "seg string, rows int, width int")
    found = manifest.profile_mismatches(manifest.archive_profile(df, "seg", 7, "i"), want, "seg")
    assert {r.seg: r.problem for r in found.collect()} == {"b": "rows differ", "c": "missing"}


def test_staging_uses_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert staging_root(spark) == root
    staged = stage(spark.range(2))
    assert staged.count() == 2 and all(f.startswith(f"file://{root}/plantmon/") for f in staged.inputFiles())


def test_a_live_feed_resumes_between_slices(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(30)], "episode bigint, raw_index bigint, x double").repartition(4)
    model = scale.fit_scaler(df.where("raw_index < 10"), ["x"], "minmax")
    replay = live.Replay(df, "raw_index", 3)
    out = live.drain(live.live_scale(replay.records, model), replay)
    assert sorted(r.x for r in out.collect()) == pytest.approx([i / 9 for i in range(30)])


def test_live_report_equals_the_batch_report(spark):
    from plantmon.operators.reports import episode_detection_report

    rows = [(e, i, (i * 7 + e) % 5 == 0) for e in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "episode bigint, raw_index bigint, alarm boolean").repartition(3)
    on = spark.createDataFrame([(1, 10, 3), (2, 25, 4)], "episode bigint, onset bigint, fault_id bigint")
    batch = episode_detection_report(df, on, "episode", "raw_index")
    stream = live.live_report(live.Replay(df, "raw_index", 3), on).select(*batch.columns)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


def test_live_report_never_broadcasts_records(spark, tmp_path):
    """Not even where they look smaller than the onsets."""
    spark.range(50).selectExpr("id % 5 AS episode", "id AS raw_index", "id % 3 = 0 AS alarm").write.parquet(str(tmp_path / "records"))
    records = spark.read.parquet(str(tmp_path / "records"))
    for many in (100, 150_000):
        on = spark.range(many).selectExpr("id AS episode", "10L AS onset", "1L AS fault_id", "id AS more").distinct()
        report = live.live_detection_report(records, on)
        plan = report._jdf.queryExecution().sparkPlan().toString()
        assert "BuildLeft" not in plan and ("BuildRight" in plan) == (many == 100)
        assert sorted(r["row_count"] for r in report.collect()) == [10] * 5
