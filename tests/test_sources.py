"""Captures, normalisation, flow nodes, sinks and manifests."""

import json

import pytest
from pyspark.sql import functions as F

from reactrix.operators import captures as CP
from reactrix.operators import catalog as K
from reactrix.sources import captures as C
from reactrix.sources import sinks as SK
from reactrix.streaming import feeds as ST


def write(path, *docs):
    path.write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs), encoding="utf-8")


def item(i, **stat):
    return {"item_id": i, "title": f"t{i}", "owner": {"mid": 7, "name": "n"}, "duration": 10, "stat": stat}


FULL = dict(view=100, coin=1, like=2, favorite=3)


def test_scan_accepts_documents_and_arrays_and_refuses_broken_json(spark, tmp_path):
    write(tmp_path / "capture_20240101.json", {"meta": {"arm": "a"}, "videos": [item("1", **FULL)]}, [item("2", **FULL)])
    got = {r["video"]["item_id"]: r["meta"] for r in C.scan_captures(spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "2"} and got["1"]["arm"] == "a" and got["2"] is None
    assert C.scan_captures(spark, str(tmp_path / "nothing"), optional=True).count() == 0
    with pytest.raises(Exception):
        C.scan_captures(spark, str(tmp_path / "nothing")).count()
    write(tmp_path / "bad.json", '{"videos": [')
    with pytest.raises(Exception):
        C.scan_captures(spark, str(tmp_path / "bad.json")).collect()


def test_normalise_never_invents_counters(spark, tmp_path):
    write(tmp_path / "c.json", [
        item("ok", **FULL), item("fav", view=5, coin=0, like=0, fav=4), item("missing", view=1, coin=1, like=1), item("null", **{**FULL, "coin": None}),
        item("bool", **{**FULL, "like": True}), item("negative", **{**FULL, "view": -1}), item("", **FULL), {**item("flat", coin=1, like=1, favorite=1), "view": 9, "owner": "me"}])
    got = {r["item_id"]: r for r in C.normalize(C.scan_captures(spark, str(tmp_path))).collect()}
    assert set(got) == {"ok", "fav", "flat"}
    assert got["fav"]["fav"] == 4 and got["flat"]["view"] == 9 and got["flat"]["owner"] == "me" and got["ok"]["owner_id"] == "7"


def test_capture_key(spark):
    names = spark.createDataFrame([("zz_20240102_030405.json",), ("a_20240102.json",), ("none.json",), ("x_20250101_analysis.json",)], "n string")
    got = {r["n"]: r["capture_key"] for r in C.keep_files(names, "n", None).collect()}
    assert got == {"zz_20240102_030405.json": "20240102030405", "a_20240102.json": "20240102000000", "none.json": "0" * 14}


def test_duration_text(spark):
    df = spark.createDataFrame([("1:59",), ("1:02:03",), ("75",), ("n/a",), ("1:x",), (None,)], "t string")
    assert [r[0] for r in df.select(C.duration_seconds(F.col("t"))).collect()] == [119, 3723, 75, 0, 0, 0]


NODE = "array<struct<nodes:array<struct<node_id:long,view:long,coin_rate:double,fav_rate:double,like_rate:double>>>>"


def test_partial_node_keeps_older_complete_counters(spark):
    old = ("20240101", [([(1, 100, 0.1, 0.2, 0.3), (2, 50, 0.1, 0.1, 0.1)],)], {})
    new = ("20240201", None, {"arm": ([([(1, 999, None, 0.9, 0.9)],)],)})
    newest = ("20240301", [([(2, 40, 0.2, 0.2, 0.2)],)], {})
    got = {r["node_id"]: r for r in C.flow_nodes(spark.createDataFrame([old, new, newest], f"snapshot string, flows {NODE}, arms map<string, struct<flows:{NODE}>>")).collect()}
    assert (got[1]["view"], got[1]["snapshot"], got[1]["first_seen"]) == (100, "20240101", "20240101")
    assert (got[2]["view"], got[2]["first_seen"]) == (40, "20240101")


CAPTURES = "item_id long, capture_id long, ts timestamp, counter double, complete boolean, extra long"


def capture_rows(spark, rows):
    return spark.createDataFrame(rows, "item_id long, capture_id long, d string, counter double, complete boolean, extra long").withColumn(
        "ts", F.col("d").cast("timestamp")).drop("d")


def test_newest_complete_capture_wins_even_if_counters_fall(spark):
    df = capture_rows(spark, [(1, 1, "2024-01-01", 9.0, True, 5), (1, 2, "2024-02-01", 3.0, True, None), (1, 3, "2024-03-01", 99.0, False, 8)])
    row = CP.latest_snapshot(df).first()
    assert (row["counter"], row["extra"], row["first_seen"], row["captures"]) == (3.0, 5, "20240101", 2)


def test_late_old_capture_fills_but_never_replaces(spark, tmp_path):
    first = capture_rows(spark, [(1, 5, "2024-03-01", 7.0, True, None), (2, 6, "2024-03-01", 1.0, True, 4)])
    late = capture_rows(spark, [(1, 1, "2024-01-01", 50.0, True, 3)])
    path = str(tmp_path / "in")
    first.coalesce(1).write.parquet(path)
    late.coalesce(1).write.mode("append").parquet(path)
    changes = ST.run_available(ST.snapshot_state(ST.file_stream(spark, path, first.schema, 1)), "update", "t")
    got = {r["item_id"]: r for r in ST.latest_rows(changes, ["item_id"]).collect()}
    want = {r["item_id"]: r for r in CP.latest_snapshot(first.unionByName(late)).collect()}
    assert got == want and got[1]["counter"] == 7.0 and got[1]["extra"] == 3 and got[1]["first_seen"] == "20240101"


def test_append_only(spark, tmp_path):
    df = spark.createDataFrame([(1, "20240101")], "a int, capture_day string")
    assert not SK.append_only(df.filter("a > 1"), str(tmp_path / "t")) and not (tmp_path / "t").exists()
    assert SK.append_only(df, str(tmp_path / "t"))
    with pytest.raises(Exception):
        SK.append_only(df, str(tmp_path / "t"))


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(500).withColumn("x", F.col("id") % 7)
    base = SK.fingerprint(df, ["id", "x"]).first()[0]
    assert base == SK.fingerprint(df.repartition(7).orderBy(F.desc("id")), ["id", "x"]).first()[0]
    assert base != SK.fingerprint(df.withColumn("x", F.when(F.col("id") == 3, 0).otherwise(F.col("x"))), ["id", "x"]).first()[0]
    assert base != SK.fingerprint(df.unionByName(df.limit(1)), ["id", "x"]).first()[0]


def test_pages_and_stale(spark):
    df = spark.range(200).select(F.col("id").alias("item_id"), F.lit("s").alias("stream"))
    pages = SK.pages(df, "stream", ["item_id"], ["item_id"])
    assert sorted((r["page"], r["n"]) for r in pages.collect()) == [(0, 96), (1, 96), (2, 8)]
    assert SK.stale_pages(pages, SK.pages(df.filter("item_id < 96"), "stream", ["item_id"], ["item_id"])).count() == 2


def test_manifest_detects_change(spark, tmp_path):
    write(tmp_path / "a.json", "[]")
    stored = spark.createDataFrame(C.manifest(spark, str(tmp_path)).collect(), "file string, sha256 string")
    C.check_manifest(C.manifest(spark, str(tmp_path)), stored)
    write(tmp_path / "b.json", "[]")
    with pytest.raises(ValueError):
        C.check_manifest(C.manifest(spark, str(tmp_path)), stored)


def test_hop_stops(spark):
    hops = spark.createDataFrame([(1, 0.25, 18), (2, 0.24, 18), (3, 0.20, 18), (4, 0.3, 18)], "hop long, rate double, n_seeds long")
    got = [(r["hop"], r["reason"]) for r in K.hop_stops(hops, 1).orderBy("hop").collect()]
    assert got == [(1, None), (2, None), (3, "ratio")]


def test_staging_needs_a_shared_folder_off_local_masters(monkeypatch):
    import pytest

    from reactrix import session

    class Conf:
        def get(self, name):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Fake())


def test_shared_tables_follow_their_input(spark, tmp_path):
    from reactrix.session import drop_stage, shared_table, stage

    folder = f"{tmp_path}/in"
    spark.range(3).write.parquet(f"{folder}/a.parquet")

    def read():
        return shared_table(spark, folder, "count_a", lambda: spark.read.parquet(f"{folder}/*")).count()

    assert read() == 3 and read() == 3
    spark.range(4).write.parquet(f"{folder}/b.parquet")
    assert read() == 7
    kept = stage(spark.range(5).toDF("id"), "gone")
    folders = {f.rsplit("/", 1)[0].removeprefix("file:").replace("///", "/") for f in kept.inputFiles()}
    drop_stage(kept)
    import os
    assert folders and not any(os.path.exists(f) for f in folders)
    outside = spark.read.parquet(f"{folder}/a.parquet")
    drop_stage(outside)
    assert outside.count() == 3


def test_files_after_the_cutoff_are_not_scanned(spark, tmp_path):
    for name in ("capture_20240101.json", "zz_20240102_120000.json", "capture_20240103.json", "capture_20240101_analysis.json", "merged_20240101.json", "bare.json"):
        write(tmp_path / name, {"videos": [item(name, **FULL)]})
    (tmp_path / "late_20240105.json").write_text("{broken", encoding="utf-8")

    def names(cutoff):
        return [p.rsplit("/", 1)[-1] for p in C.kept_paths(spark, str(tmp_path), cutoff)]

    assert names("20240102") == ["bare.json", "capture_20240101.json", "zz_20240102_120000.json"]
    assert len(names("20240101")) == 2 and names("20240103")[-1] == "capture_20240103.json"
    got = C.scan_captures_until(spark, str(tmp_path), "20240102")
    assert len(got.inputFiles()) == 3 and got.count() == 3  # the broken file is never opened
    assert C.scan_captures_until(spark, str(tmp_path), "2000").columns == got.columns


def test_captures_partitioned_by_name_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(1, "capture_20240101"), (2, "capture_20240201"), (3, "capture_20240101_analysis")], "a int, capture string")
    df.write.partitionBy("capture").parquet(str(tmp_path / "t"))
    kept = C.keep_files(spark.read.parquet(str(tmp_path / "t")), "capture", "20240115")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_analysis" in plan.split("PartitionFilters: [")[1].split("ReadSchema")[0]
    assert [r["a"] for r in kept.collect()] == [1]


def test_large_files_are_digested_in_pieces(spark, tmp_path):
    import hashlib

    data = {"a b.bin": b"x" * 10, "large.bin": bytes(range(256)) * 40_000, "empty.bin": b""}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    got = {r["file"]: r["sha256"] for r in C.manifest(spark, str(tmp_path), whole_bytes=1000).collect()}
    assert got == {n: hashlib.sha256(b).hexdigest() for n, b in data.items()}


def test_frozen_manifest_of_an_earlier_run(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for day in ("20240101", "20240102", "20240301"):
        write(folder / f"capture_{day}.json", "[]")
    with pytest.raises(ValueError, match="nothing"):
        C.check_frozen(spark, str(folder), store, "20240131")
    C.freeze(spark, C.manifest(spark, str(folder), cutoff="20240131"), store, "20240131")
    write(folder / "capture_20240401.json", "[]")  # after the cutoff: not part of the reference
    C.check_frozen(spark, str(folder), store, "20240131")
    with pytest.raises(ValueError, match="cutoff"):
        C.check_frozen(spark, str(folder), store, "20240228")
    write(folder / "capture_20240101.json", "[1]")
    (folder / "capture_20240102.json").unlink()
    write(folder / "capture_20240110.json", "[]")
    bad = C.manifest_problems(C.manifest(spark, str(folder), cutoff="20240131"), C.frozen(spark, store)[0])
    assert {r["file"]: r["problem"] for r in bad.collect()} == {
        "capture_20240101.json": "changed", "capture_20240102.json": "missing", "capture_20240110.json": "new"}
    with pytest.raises(ValueError, match="changed"):
        C.check_frozen(spark, str(folder), store, "20240131")
    C.freeze(spark, C.manifest(spark, str(folder), cutoff="20240131"), store, "20240131")
    C.check_frozen(spark, str(folder), store, "20240131")
    assert C.frozen(spark, store, 0)[0].count() == 2


def test_published_pages_are_written_once_and_purged(spark, tmp_path):
    store = str(tmp_path / "site")

    def publish(rows, **how):
        return SK.publish_pages(spark, SK.pages(rows, "stream", ["item_id"], ["item_id", "title"]), store, "stream", **how)

    def bodies():
        return {r["page"]: r["body"] for r in SK.read_pages(spark, store).collect()}

    rows = spark.range(300).select(F.col("id").alias("item_id"), F.lit("s").alias("stream"), F.lit("t").alias("title"))
    assert SK.read_pages(spark, store) is None
    assert publish(rows) == {"written": 4, "purged": 0}
    before = sorted(p for p in (tmp_path / "site").rglob("*"))
    assert publish(rows) == {"written": 0, "purged": 0}
    assert before == sorted(p for p in (tmp_path / "site").rglob("*"))
    changed = rows.withColumn("title", F.when(F.col("item_id") == 100, "new").otherwise(F.col("title")))
    assert publish(changed, keep_previous=True) == {"written": 1, "purged": 0}
    assert "100|new" in bodies()[1] and len(bodies()) == 4
    gone = changed.filter("item_id <> 200")  # this page and those after it
    assert publish(gone) == {"written": 2, "purged": 3}
    assert sum(b.count("\n") + 1 for b in bodies().values()) == 299
    texts = "\n".join(r["body"] for r in spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(
        *[str(p) for p in (tmp_path / "site" / "data").glob("bodies-*")]).collect())
    assert "200|t" not in texts and "100|t" not in texts.split("\n")
    assert publish(rows.filter("item_id < 0"))["written"] == 0 and bodies() == {}
