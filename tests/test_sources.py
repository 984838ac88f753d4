"""Sources, sinks, registry, feature tables and the streaming extension."""

import json

import pytest
from pyspark.sql import functions as F

from leakgauge import schemas, session
from leakgauge.operators import select as S
from leakgauge.plans import features as T
from leakgauge.plans import registry as G
from leakgauge.plans import reports as R
from leakgauge.sources import readers, sinks
from leakgauge.streaming import extracted


def test_csv_round_trip_with_line_breaks(spark, tmp_path):
    rows = [("n1", 'a "quoted"\n line, with comma '), ("n2", " x"), ("n3", "é")]
    df = spark.createDataFrame(rows, "note_id string, note string")
    sinks.csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, readers.csv(spark, str(tmp_path / "c"), "note_id string, note string").collect())) == rows
    assert readers.csv(spark, str(tmp_path / "c"), columns=["note", "gone"]).columns == ["note"]
    sinks.csv(df.limit(0), str(tmp_path / "c"), mode="ignore")
    assert readers.csv(spark, str(tmp_path / "c")).count() == 3


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    assert readers.any_format(spark, str(tmp_path / "a.json")).count() == 2
    text = sinks.json_report(spark.createDataFrame([("é", None)], "a string, b int"), str(tmp_path / "r.json"))
    assert json.loads(text) == [{"a": "é", "b": None}] and (tmp_path / "r.json").read_text() == text
    with pytest.raises(ValueError):
        sinks.json_report(spark.range(sinks.REPORT_ROWS + 1))


def test_configuration_and_names(spark):
    assert readers.config('{"path": "run_{model}", "list": ["{n}", 3]}', model="m", n=1) == {"path": "run_m", "list": ["1", 3]}
    df = spark.createDataFrame([("ds1_small_0.5_10_0",), ("nonsense",)], "f string").select(*[c.alias(k) for k, c in readers.run_columns(F.col("f")).items()])
    assert {tuple(r) for r in df.collect()} == {("ds1", "small", 0.5, 10, "0"), (None,) * 5}


def test_registry(spark):
    seeded = G.seed(spark)
    grown = G.with_new_row(seeded["datasets"], "dataset_id", {"status": "new"})
    assert grown.agg(F.max("dataset_id")).first()[0] == 1 and G.with_new_row(seeded["datasets"].limit(0), "dataset_id", {}).first().dataset_id == 0
    assert seeded["generated_notes"].count() == 0 and G.joined_models(seeded["models"], seeded["datasets"]).columns.count("status_dataset") == 1


def test_wide_features(spark):
    long = spark.createDataFrame([("v", "Name: ", -2.0), ("v", "Name: ", -2.0), ("v", "Dr. ", -3.0), ("w", "Name: ", None)], "value string, prompt string, ll double")
    wide = {r.value: r.asDict() for r in T.long_to_wide(long, ["value"], "prompt", "ll", ["Name: ", "Dr. "], "ft_", strict=True).collect()}
    assert wide["v"]["ft_Name: "] == -2.0 and wide["v"]["ft_Dr. "] == -3.0 and wide["w"]["ft_Name: "] is None
    p = T.to_probabilities(T.long_to_wide(long, ["value"], "prompt", "ll", ["Name: "], "ft_"), ["ft_Name: "])
    assert "p_ft_Name: " in p.columns
    with pytest.raises(Exception, match="two values"):
        T.long_to_wide(long.union(spark.createDataFrame([("v", "Name: ", -9.0)], long.schema)), ["value"], "prompt", "ll", ["Name: "], "ft_", strict=True).collect()
    frame = spark.createDataFrame([(-5.0, 0.5, "x")], "ft_a double, ll_b double, c string")
    assert S.ll_columns(frame) == ["ft_a"] and S.feature_columns(frame.select("ll_b", "c")) == ["ll_b"] and S.with_prefix(frame.select("c"), "q_", []).columns == ["q_c"]


def test_cache_and_pending(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("a",)], "value string")
    cache = spark.createDataFrame([("a", "1", 0.5)], "value string, version string, ll double")
    hit, miss = T.split_cached(asked, cache, "value", "1")
    assert [r.value for r in hit.collect()] == ["a"] and [r.value for r in miss.collect()] == ["b"]
    assert T.split_cached(asked, cache, "value", "2")[1].count() == 2


def test_latex():
    text = R.latex_table([{"a_b": 1234, "c": 0.5}, {"a_b": None, "c": 2.0}], ["a_b", "c"], "t")
    assert r"a\_b & c \\" in text and "1,234 & 0.50" in text and r"\toprule" in text


def test_schemas_parse(spark):
    for k, v in vars(schemas).items():
        if k.isupper():
            assert spark.createDataFrame([], v).columns


def test_streamed_candidates(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "Ada"), ("2024-01-01 00:02:00", "Ada"), ("2024-01-01 00:12:00", "Bo"), ("2024-01-01 00:13:00", None)]
    spark.createDataFrame(rows, "t string, value string").select(F.to_timestamp("t").alias("time"), "value").write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("Ada", 1)], "value string, label int")
    stream = spark.readStream.schema("time timestamp, value string").parquet(str(tmp_path / "in"))
    q = extracted.new_candidates(stream, "value", "time").writeStream.format("memory").queryName("fresh").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.value for r in spark.sql("select value from fresh").collect()) == ["Ada", "Bo"]
    q = extracted.window_counts(stream, known, "value", "time").writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.groundtruth, r.n) for r in spark.sql("select groundtruth, n from windows").collect()} == {("train", 1), ("other", 1)}


def test_csv_keeps_every_text(spark, tmp_path):
    rows = [("a", "x\r\ny"), ("b", ""), ("c", None), ("d", 'q"uo\\te"'), ("e", "\r"), ("f", " pad "), ("g", "\n"), ("h", "null"), ("i", "\\"), ("j", ","), ("k", '""')]
    sinks.csv(spark.createDataFrame(rows, "id string, note string"), str(tmp_path / "t"))
    assert {(r.id, r.note) for r in readers.csv(spark, str(tmp_path / "t"), "id string, note string").collect()} == set(rows)


def test_configuration_in_yaml_and_json(monkeypatch):
    text = "# c\npath: 'runs/{m}'\nrates: [0.1, 2]\nlist:\n  - name: x\n    on: true\n"
    want = {"path": "runs/s", "rates": [0.1, 2], "list": [{"name": "x", "on": True}]}
    assert readers.config('{"path": "runs/{m}", "n": [1, "{m}"]}', m="s") == {"path": "runs/s", "n": [1, "s"]}
    if readers.yaml is not None:
        got = readers.config(text, m="s")
        assert got["path"] == want["path"] and got["rates"] == want["rates"] and got["list"][0]["name"] == "x" and readers.config("", m=1) == {}
    monkeypatch.setattr(readers, "yaml", None)
    with pytest.raises(ImportError, match="YAML"):
        readers.config(text, m="s")


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark):
    assert session.is_local("local") and session.is_local("local[4]") and not session.is_local("local-cluster[3,2,1024]") and not session.is_local("spark://host:7077")

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session)
