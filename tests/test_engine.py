import numpy as np
import pytest
from datetime import datetime

from pyspark.sql import functions as F

from kindred.config import EngineConfig, checked_mode
from kindred.engine import METRICS, Engine, Sources, UnknownModeError, backfill, update
from kindred.functions import columns as C
from kindred.operators import ann, counts, sgd, similarity, tags
from kindred.operators.store import Files, ModelNotLoaded, Snapshot, State, TopTagsStore, Writer, decode_top_tags, encode_top_tags, prune, version_name
from kindred.sources import scans
from plain import fold_loop

T0 = datetime(2024, 1, 1)


def posts(spark, rows):
    return spark.createDataFrame(rows, "id bigint, tag_string string, updated_at timestamp_ntz")


def meta(spark, rows):
    return spark.createDataFrame(rows, "name string, category int, post_count bigint")


def test_weights_order_defaults_and_exclusions(spark):
    p = posts(spark, [(1, " b a　a c bad gone new ", T0), (2, None, None), (3, "", T0)])
    w = tags.weighted(p, meta(spark, [("a", 4, 3), ("b", 1, 0), ("c", 2, 7), ("bad", 6, 1), ("gone", 0, 1)]), 9, frozenset({"gone"}))
    got = {r.tag: (r.category, r.n_occ, r.first_pos, r.weight) for r in w.collect()}
    assert set(got) == {"a", "b", "c", "new"}
    assert got["a"][3] == pytest.approx(2 * 2.5 * (np.log(10 / 4) + 1)) and got["b"][3] == pytest.approx(0.3 * (np.log(10) + 1))
    assert got["c"][3] == pytest.approx(np.log(10 / 8) + 1) and got["new"] == (0, 1, 6, pytest.approx(np.log(10 / 2) + 1))


def test_top_tags_keep_first_at_ties_and_vocabulary_is_contiguous(spark):
    p = posts(spark, [(2, "z y x", T0), (1, "y q", T0)])
    w = tags.weighted(p, meta(spark, []), 5)
    assert sorted(r.tag for r in tags.top_tags(w.where("post_id = 2"), 2).collect()) == ["y", "z"]
    vocab = {r.tag: r.tag_id for r in tags.vocabulary(w).collect()}
    assert vocab == {"y": 0, "q": 1, "z": 2, "x": 3}
    old = tags.vocabulary(w.where("post_id = 1"))
    grown = {r.tag: (r.tag_id, r.is_new) for r in tags.grow_vocabulary(old, w.where("post_id = 2"), ["post_id"]).collect()}
    assert grown == {"y": (0, False), "q": (1, False), "z": (2, True), "x": (3, True)}


@pytest.mark.parametrize(("a", "b", "m", "want"), [([], [(1, 1.0)], 3, []), ([(1, 2.0), (2, 1.0)], [(1, 1.0), (2, 1.0), (3, 9.0)], 3, [(1, 1.0), (2, 1.0)]), ([(1, 1.0), (2, 5.0), (3, 2.0)], [(1, 9.0), (2, 4.0), (3, 9.0)], 2, [(2, 4.0), (3, 2.0)]), ([(1, 1.0)], [(1, 1.0)], 0, []), ([(1, 1.0)], [(2, 1.0)], 3, [])])
def test_shared_pair(spark, a, b, m, want):
    kind = "array<struct<tag_id:int,weight:double>>"
    row = spark.createDataFrame([(a, b)], f"a {kind}, b {kind}").select(tags.shared_pair(F.col("a"), F.col("b"), m).alias("s")).first()
    assert [tuple(t) for t in row.s] == want


def test_vector_columns(spark):
    rows = [(0, [0.0, 0.0], [1.0, 0.0]), (1, [3.0, 4.0], [6.0, 8.0]), (2, [1.0, 0.0], [-1.0, 0.0]), (3, [float("nan"), 1.0], [1.0, 1.0]), (4, [1e20, 1e20], [0.0, 0.0])]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>")
    got = {r.i: r for r in df.select("i", C.l2_normalize(F.col("a")).alias("u"), C.cosine(F.col("a"), F.col("b")).alias("c"), C.clip_norm(F.col("a"), 2.5).alias("k"), C.blend(F.col("a"), F.col("b"), 1.0, 0.3).alias("h")).collect()}
    assert got[0].u == [0, 0] and got[0].c == 0 and got[1].u == [0.6, 0.8] and got[1].c == pytest.approx(1) and got[2].c == -1
    assert got[3].u == [0, 0] and got[1].k == pytest.approx([1.5, 2.0]) and got[2].k == [1, 0]
    assert np.isfinite(got[4].h).all() and np.linalg.norm(got[4].h) == pytest.approx(1) and got[0].h == [1, 0]


def test_f16_round_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.uniform(-1, 1, 500), 2.0 ** -np.arange(0, 26), [0.0, 1e-9, -(2.0**-24)]])
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(C.f16_round(F.col("x"))).collect()]
    assert np.array_equal(np.array(got), x.astype(np.float16).astype(float))


def test_clamped_counts_equal_the_loop(spark):
    rng = np.random.default_rng(3)
    ev = [(i, 0, int(rng.integers(5)), int(rng.choice([-1, 1]))) for i in range(400)]
    start = {0: 3, 1: 0, 9: 7}
    want = dict(start)
    for _, _, p, a in ev:
        want[p] = max(0, want.get(p, 0) + a)
    got = counts.clamped_counts(spark.createDataFrame(ev, "event_id bigint, user_id bigint, post_id bigint, action bigint"), spark.createDataFrame(list(start.items()), "post_id bigint, fav_count bigint"))
    assert {r.post_id: r.fav_count for r in got.collect()} == want


def test_wavefront_equals_the_loop():
    rng = np.random.default_rng(2)
    for most in (10.0, 0.05):
        u, p = (rng.normal(0, 0.1, (k, 6)).astype(np.float32) for k in (20, 15))
        users, items, act = rng.integers(0, 20, 800), rng.integers(0, 15, 800), rng.choice([-1, 1], 800)
        a, b, c, d = u.copy(), p.copy(), u.copy(), p.copy()
        sgd.fold_rows(a, b, users, items, act, 0.05, 0.01, most)
        fold_loop(c, d, users, items, act, 0.05, 0.01, most)
        assert np.array_equal(a, c) and np.array_equal(b, d)


def test_fold_in_two_steps_equals_one(spark):
    rng = np.random.default_rng(4)
    ev = [(i, int(rng.integers(6)), int(rng.integers(6)), 1) for i in range(60)]
    df = spark.createDataFrame(ev, "event_id bigint, user_id bigint, post_id bigint, action int")
    read = lambda x: {(r.kind, r.id): r.vec for r in x.collect()}
    whole = read(sgd.sgd_fold(df, dim=4))
    half = sgd.sgd_fold(df.where("event_id < 30"), dim=4)
    assert read(sgd.sgd_fold(df.where("event_id >= 30"), half, dim=4)) == whole


def test_similar_all_equals_similar_to(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(60, 5)))] + [(60, [0.0] * 5), (61, [1.0] * 5), (62, [1.0] * 5)]
    v = spark.createDataFrame(rows, "post_id bigint, vec array<float>")
    every = {(r.query_id, r["rank"]): (r.post_id, r.score) for r in similarity.similar_all(v, v, 4, 16).collect()}
    for q in (3, 60, 61):
        assert [every[q, k + 1] for k in range(4)] == [(r.post_id, r.score) for r in similarity.similar_to(v, q, 4).collect()]


def test_scans(spark):
    ev = spark.createDataFrame([(1, T0), (2, datetime(2023, 1, 1)), (3, datetime(2024, 1, 2))], "event_id bigint, created_at timestamp_ntz")
    assert [r.event_id for r in scans.events_after(ev, 0, T0).collect()] == [1, 3]
    assert scans.event_lag(ev, 9).first()[0] == 0 and scans.max_event_id(ev.where("event_id > 9")).first()[0] == 0
    p = posts(spark, [(1, "a", T0), (2, "b", None), (0, "c", datetime(2024, 5, 1))])
    assert sorted(r.id for r in scans.changed_posts(p, T0).collect()) == [0, 1] and scans.posts_watermark(p, T0).first()[0] == datetime(2024, 5, 1)
    scans.check_watermark_age(0, T0, datetime(2030, 1, 1))
    with pytest.raises(RuntimeError):
        scans.check_watermark_age(1, T0, datetime(2024, 1, 14))
    tries = []
    with pytest.raises(OSError):
        scans.with_retry(lambda: tries.append(1) or (_ for _ in ()).throw(OSError()), sleep=lambda s: None)
    assert len(tries) == 5


def test_codec_and_names():
    rows = [[(1, 0.5), (7, 2.0)], [], [(3, 1.0)]]
    offsets, payload = encode_top_tags(rows)
    assert offsets == [0, 16, 16, 24] and decode_top_tags(offsets, payload) == rows
    assert checked_mode("a-B_1") == "a-B_1" and version_name(T0) < version_name(datetime(2024, 1, 1, 0, 0, 1))
    for bad in ("", "a/b", "a b", "../x"):
        with pytest.raises(ValueError):
            checked_mode(bad)
    assert EngineConfig.from_env({"KINDRED_N_TOP_TAGS": "7", "KINDRED_EXCLUDED_TAGS": '["x"]'}).excluded_tags == {"x"}
    assert State.from_json(None) == State() and State.from_json('{"last_event_id": 4}').last_event_id == 4


def test_top_tags_store(spark, tmp_path):
    s = TopTagsStore.from_legacy_json(spark, '{"1": [[2, 0.5]], "2": []}')
    assert s[1] == [(2, 0.5)] and s[2] == [] and s.get(3) is None and not s.is_dirty
    with pytest.raises(KeyError):
        s[3]
    s[1], s[5] = [(4, 1.0)], [(1, 1.0)]
    s.save(str(tmp_path / "a"))
    again = TopTagsStore.load(spark, str(tmp_path / "a"))
    assert again[1] == [(4, 1.0)] and sorted(r.post_id for r in again.keys().collect()) == [1, 2, 5]
    assert {r.post_id: len(r.tags) for r in again.get_many(spark.createDataFrame([(1,), (9,)], "post_id bigint")).collect()} == {1: 1, 9: 0}
    assert TopTagsStore.load(spark, str(tmp_path / "none")).base.count() == 0


def test_backfill_update_and_queries(spark, tmp_path):
    p = posts(spark, [(i, f"t{i % 3} s{i % 2} only{i}", datetime(2024, 1, 1 + i)) for i in range(8)])
    t = meta(spark, [(f"t{k}", 4, 3) for k in range(3)] + [("s0", 0, 4), ("s1", 0, 4)])
    fav = spark.createDataFrame([(u, q) for u in range(4) for q in range(8) if (u + q) % 3 == 0], "user_id bigint, post_id bigint")
    ev = spark.createDataFrame([(k, 1, k % 8, 1 if k % 4 else -1, datetime(2024, 2, 1)) for k in range(1, 9)], "event_id bigint, user_id bigint, post_id bigint, action bigint, created_at timestamp_ntz")
    config = EngineConfig(model_dir=str(tmp_path), embedding_dim=8, keep_versions=2)
    engine = Engine.open(spark, config)
    assert engine.ready() is None
    with pytest.raises(ModelNotLoaded):
        engine.similar(1)
    sources = Sources(p, t, fav, ev.where("event_id <= 4"))
    backfill(spark, sources, config, version="v1")
    engine.refresh()
    rows = engine.similar(1, 3, explain=True).orderBy("rank").collect()
    assert len(rows) == 3 and all(r.post_id != 1 for r in rows) and rows[0].fav_query == fav.where("post_id = 1").count()
    assert all(r.shared_tags for r in rows if r.post_id % 3 == 1 or r.post_id % 2 == 1)
    assert engine.similar(99).count() == 0 and {r.score for r in engine.similar(1, include_scores=False).collect()} == {0.0}
    assert engine.similar_batch(spark.createDataFrame([(1,), (2,)], "post_id bigint"), 2).count() == 4
    with pytest.raises(UnknownModeError):
        engine.similar(1, mode="none")
    more = posts(spark, [(8, "t0 brandnew", datetime(2024, 3, 1))]).union(p)
    update(spark, Sources(more, t, fav, ev), config, version="v2")
    s = Snapshot(spark, str(tmp_path))
    assert s.version == "v2" and s.state == State(8, "2024-02-01T00:00:00", "2024-03-01T00:00:00", "v2")
    want = {q: fav.where(f"post_id = {q}").count() for q in range(8)} | {8: 0}
    for k in range(5, 9):
        want[k % 8] = max(0, want[k % 8] + (1 if k % 4 else -1))
    assert {r.post_id: r.fav_count for r in s.table("fav_count").collect()} == want
    assert s.table("tag_vocab").where("tag = 'brandnew'").count() == 1 and s.vectors("tags").count() == 9
    update(spark, Sources(more, t, fav, ev), config, now=datetime(2024, 2, 2), version="v3")
    assert {r.fav_count for r in Snapshot(spark, str(tmp_path)).table("fav_count").where("post_id = 5").collect()} == {want[5]}
    assert not (tmp_path / "versions" / "v1").exists()
    with pytest.raises(FileExistsError):
        update(spark, Sources(more, t, fav, ev), config, now=datetime(2024, 2, 2), version="v3")
    with pytest.raises(ValueError), Writer(spark, str(tmp_path)) as w:
        w.begin("v9", ["a"], 8, State(), fav_count=s.table("fav_count"))
        w.mode("a", spark.createDataFrame([(1, [1.0])], "post_id bigint, vec array<float>"))
    assert sorted(x.name for x in (tmp_path / "versions").iterdir()) == ["v2", "v3"]


def test_stream_folds_once(spark, tmp_path):
    from kindred.streaming.updates import event_stream, run_updates

    p = posts(spark, [(i, "a b", T0) for i in range(3)])
    fav = spark.createDataFrame([(1, 0)], "user_id bigint, post_id bigint")
    ev = spark.createDataFrame([(k, 1, k % 3, 1, datetime(2024, 2, 1)) for k in range(1, 6)], "event_id bigint, user_id bigint, post_id bigint, action bigint, created_at timestamp_ntz")
    config = EngineConfig(model_dir=str(tmp_path / "m"), embedding_dim=4)
    sources = Sources(p, meta(spark, []), fav, ev.where("event_id < 0"))
    backfill(spark, sources, config, version="v0")
    ev.write.parquet(str(tmp_path / "in"))
    for check in ("c1", "c2"):  # the second starts from scratch and finds everything folded
        run_updates(event_stream(spark, str(tmp_path / "in")), sources, config, str(tmp_path / check), now=lambda: datetime(2024, 2, 2), version=lambda b, c=check: f"v-{c}-{b}").awaitTermination(120)
    got = {r.post_id: r.fav_count for r in Snapshot(spark, config.model_dir).table("fav_count").collect()}
    assert got == {0: 2, 1: 2, 2: 2}


def test_reaction_only_post_is_explained(spark, tmp_path):
    """A post known by favorites alone has vectors but no tags: its neighbours come with empty shared tags."""
    p = posts(spark, [(i, f"t{i % 3} s{i % 2}", T0) for i in range(6)])
    fav = spark.createDataFrame([(u, q) for u in range(4) for q in (0, 1, 2, 77) if (u + q) % 2 == 0], "user_id bigint, post_id bigint")
    ev = spark.createDataFrame([], "event_id bigint, user_id bigint, post_id bigint, action bigint, created_at timestamp_ntz")
    config = EngineConfig(model_dir=str(tmp_path), embedding_dim=8)
    backfill(spark, Sources(p, meta(spark, []), fav, ev), config, version="v1")
    engine = Engine.open(spark, config)
    plain, told = (engine.similar(77, 3, explain=x).orderBy("rank").collect() for x in (False, True))
    assert [(r.post_id, r.score) for r in told] == [(r.post_id, r.score) for r in plain] and len(told) == 3
    assert all(r.shared_tags == [] and r.fav_query == 2 for r in told)
    assert engine.similar(78, 3, explain=True).count() == 0


def test_unreadable_base_is_not_saved_over(spark, tmp_path):
    (tmp_path / "base").mkdir()
    (tmp_path / "base" / "part-0.parquet").write_bytes(b"not a table")
    (tmp_path / "old.json").write_text('{"1": [[2, 0.5]]}')
    told = []
    s = TopTagsStore.load(spark, str(tmp_path / "base"), told.append)
    assert s.broken and len(told) == 1 and s.get(1) is None
    s[4] = [(1, 1.0)]
    with pytest.raises(RuntimeError):
        s.save(str(tmp_path / "out"))
    assert s[4] == [(1, 1.0)] and not (tmp_path / "out").exists()
    s = TopTagsStore.load(spark, str(tmp_path / "base"), told.append, legacy=str(tmp_path / "old.json"))
    assert s[1] == [(2, 0.5)] and not s.broken
    s.save(str(tmp_path / "out"))
    s = TopTagsStore.load(spark, str(tmp_path / "none"), legacy=str(tmp_path / "old.json"))
    assert s[1] == [(2, 0.5)]
    s = TopTagsStore.load(spark, str(tmp_path / "none"), told.append, legacy=str(tmp_path / "old.json"), most=5)
    assert s.get(1) is None and not s.broken and isinstance(told[-1], ValueError)
    s[1] = []
    s.save(str(tmp_path / "new"))
    assert TopTagsStore.load(spark, str(tmp_path / "new"))[1] == []


def test_pointer_is_replaced_in_one_step(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    for text in ("v1", "v2", "v3"):
        files.write("CURRENT", text)
        assert files.read("CURRENT") == text
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["CURRENT"]
    deleted, files.fs = [], type("Fs", (), {"__getattr__": lambda self, name, fs=files.fs: deleted.append(name) or getattr(fs, name)})()
    files.write("CURRENT", "v4")
    assert "delete" not in deleted and (tmp_path / "CURRENT").read_text() == "v4"


def test_prune_keeps_all_with_zero(spark, tmp_path):
    for v in ("a", "b", "c"):
        (tmp_path / "versions" / v).mkdir(parents=True)
    files = Files(spark, str(tmp_path))
    assert prune(files, 0) == [] and prune(files, 2) == ["a"] and files.names("versions") == ["b", "c"]


@pytest.mark.parametrize("block", [2048, 40])
def test_index_recall(spark, block):
    """The inverted file finds at least 0.9 of the exact neighbours, also where a third of all vectors are equal."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(30, 16))
    x = np.concatenate([centers[rng.integers(0, 30, 1000)] + 0.4 * rng.normal(size=(1000, 16)), np.tile(centers[:1], (500, 1)), np.zeros((1, 16))])
    df = spark.createDataFrame([(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)], "post_id bigint, vec array<float>").repartition(4)
    cells = ann.centroids(df, len(x))
    assert len(cells) == int(len(x) ** 0.5)
    index, asked = ann.celled(df, cells), df.where("post_id % 20 = 0 or post_id = 1500")
    got = {(r.query_id, r.post_id): r.score for r in ann.similar_approx(asked, index, cells, 5, 8, block).collect()}
    want = {(r.query_id, r.post_id): r.score for r in similarity.similar_all(asked, df, 5).collect()}
    assert index.count() == len(x) and len(got) == len(want)
    real = {k for k in want if k[0] != 1500}
    assert len(real & set(got)) >= 0.9 * len(real) and all(got[k] == want[k] for k in real & set(got))


def test_engine_searches_the_index(spark, tmp_path):
    p = posts(spark, [(i, f"t{i % 7} s{i % 5} u{i % 3}", T0) for i in range(60)])
    fav = spark.createDataFrame([(u, q) for u in range(9) for q in range(60) if (u * q) % 4 == 1], "user_id bigint, post_id bigint")
    ev = spark.createDataFrame([], "event_id bigint, user_id bigint, post_id bigint, action bigint, created_at timestamp_ntz")
    config = EngineConfig(model_dir=str(tmp_path), embedding_dim=8)
    backfill(spark, Sources(p, meta(spark, []), fav, ev), config, version="v1")
    engine = Engine.open(spark, config)
    ids = p.select(F.col("id").alias("post_id"))
    read = lambda df: {(r.query_id, r["rank"]): (r.post_id, r.score) for r in df.collect()}
    exact = read(engine.similar_batch(ids, 3, probes=None))
    assert read(engine.similar_batch(ids, 3, probes=7)) == exact and len(read(engine.similar_batch(ids, 3, probes=1))) <= len(exact)
    assert [(r.post_id, r.score) for r in engine.similar(5, 3, probes=7).orderBy("rank").collect()] == [exact[5, k] for k in (1, 2, 3)]
    assert engine.similar(999, 3, probes=2).count() == 0
    assert METRICS["api_model_version_info{v1}"] == 1 and METRICS["api_ann_index_size"] == 60 and METRICS["api_requests_total{/similar,200}"] >= 2
    before = METRICS.get("api_requests_total{/similar,422}", 0)
    with pytest.raises(ValueError):
        engine.similar(5, 21)
    assert METRICS["api_requests_total{/similar,422}"] == before + 1


def test_sources_of_a_database(spark, tmp_path):
    """The four tables by JDBC, in ranges of their keys (Derby, which Spark brings along)."""
    url = "jdbc:derby:memory:kindred;create=true"
    p = posts(spark, [(i, f"t{i % 3}", T0) for i in range(10)])
    tables = {"posts": p, "tags": meta(spark, [("t0", 4, 3)]), "favorites": spark.createDataFrame([(u, q) for u in range(4) for q in range(10) if (u + q) % 3 == 0], "user_id bigint, post_id bigint")}
    tables["favorite_events"] = spark.createDataFrame([], "event_id bigint, user_id bigint, post_id bigint, action bigint, created_at timestamp_ntz")
    for name, df in tables.items():
        df.write.option("createTableColumnTypes", "tag_string VARCHAR(99)" if name == "posts" else "name VARCHAR(99)" if name == "tags" else "post_id BIGINT").jdbc(url, name, mode="overwrite")
    sources = Sources.jdbc(spark, url, partitions=3)
    assert sources.favorites.rdd.getNumPartitions() == 3
    for name, got in zip(("posts", "tags", "favorites", "favorite_events"), (sources.posts, sources.tags, sources.favorites, sources.events)):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tables[name].collect()))
    config = EngineConfig(model_dir=str(tmp_path), embedding_dim=4)
    assert backfill(spark, sources, config, version="v1") == "v1" and Engine.open(spark, config).similar(1, 2).count() == 2


def test_command_line(spark, tmp_path, capsys):
    from kindred.__main__ import main

    posts(spark, [(i, f"t{i % 2}", T0) for i in range(4)]).write.parquet(str(tmp_path / "data" / "posts"))
    meta(spark, []).write.parquet(str(tmp_path / "data" / "tags"))
    spark.createDataFrame([(1, 0), (1, 2)], "user_id bigint, post_id bigint").write.parquet(str(tmp_path / "data" / "favorites"))
    spark.createDataFrame([], "event_id bigint, user_id bigint, post_id bigint, action bigint, created_at timestamp_ntz").write.parquet(str(tmp_path / "data" / "favorite_events"))
    assert main(["update", "--backfill", "--data", str(tmp_path / "data"), "--models", str(tmp_path / "m")]) == 0
    assert main(["similar", "--post", "0", "--explain", "--models", str(tmp_path / "m")]) == 0
    assert "shared_tags" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["update", "--backfill"])


def test_clamped_counts_of_many_ranges(spark, monkeypatch):
    """One post with most of the events, cut into ranges."""
    monkeypatch.setattr(counts, "RANGE", 16)
    rng = np.random.default_rng(6)
    ev = [(i, 0, int(rng.integers(3)) * int(rng.integers(2)), int(rng.choice([-1, -1, 1]))) for i in range(500)]
    want = {0: 2}
    for _, _, p, a in ev:
        want[p] = max(0, want.get(p, 0) + a)
    got = counts.clamped_counts(spark.createDataFrame(ev, "event_id bigint, user_id bigint, post_id bigint, action bigint"), spark.createDataFrame([(0, 2)], "post_id bigint, fav_count bigint"))
    assert {r.post_id: r.fav_count for r in got.collect()} == want


def test_counted_tags(spark):
    df = spark.createDataFrame([(1, "b a b  c a b"), (2, None), (3, " "), (4, "x")], "id bigint, tag_string string")
    got = sorted(tuple(r) for r in tags.counted_tags(df).collect())
    assert got == [(1, "a", 2, 1), (1, "b", 3, 0), (1, "c", 1, 3), (4, "x", 1, 0)]
