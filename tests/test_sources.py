"""Files, crawl sources, sinks and streams."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, sinks, web
from tessera.streaming.collect import Progress, collect_until, distinct_stream, run_to_table


def test_corpora(spark, tmp_path):
    (tmp_path / "site_a_b_20250101to20250114.json").write_text(json.dumps(["x", "😀", None, "x"]))
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "notes.txt").write_text('["no"]')
    rows = files.read_corpora(spark, str(tmp_path)).orderBy("dataset", "idx").collect()
    assert [(r["idx"], r["text"]) for r in rows] == [(0, "x"), (1, "😀"), (2, None), (3, "x")]
    named = files.dataset_fields(files.read_corpora(spark, str(tmp_path))).first()
    assert (named["site"], named["variant"], str(named["start_date"])) == ("site", "a_b", "2025-01-01")


def test_preview_reports_types(spark, tmp_path):
    (tmp_path / "a.json").write_text('["x", 5, null, {"k": 1}, "long"]')
    (tmp_path / "b.json").write_text('{"no": "list"}')
    (tmp_path / "c.json").write_text("[broken")
    rows = {(r["dataset"], r["idx"]): (r["text"], r["length"], r["error"]) for r in files.preview_corpora(spark, str(tmp_path), 4).collect()}
    assert rows["a", 0] == ("x", 1, None)
    assert rows["a", 1][0] is None and rows["a", 1][2] == "BIGINT"
    assert rows["a", 2][2] == "VOID" and rows["a", 3][2].startswith("OBJECT") and ("a", 4) not in rows
    assert rows["b", None][2] == rows["c", None][2] == "no list"
    assert [r["text"] for r in files.read_corpora(spark, str(tmp_path)).orderBy("idx").collect()] == ["x", None, None, None, "long"]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(["b", 'q"\n', "é😀"])], "dataset string, idx int, text string")
    sinks.export_corpora(df, str(tmp_path / "out"))
    part = next((tmp_path / "out" / "dataset=d").glob("*.txt"))
    assert json.loads(part.read_text()) == ["b", 'q"\n', "é😀"]
    assert part.read_text().isascii()
    sinks.write_corpus(df, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3
    assert sinks.corpus_file_name("a.json.json") == "a.json"


def test_run_logs(spark, tmp_path):
    full = {"neg_log_prob_sum": 1.5, "avg tokens": 2.0, "model_args": {"a": True, "b": {"c": 1}}, "requirements": ["x"]}
    (tmp_path / "a.json").write_text(json.dumps(full, indent=2))
    (tmp_path / "b.json").write_text('{"neg_log_prob_sum": NaN, "data_path": "p"}')
    rows = files.read_run_logs(spark, str(tmp_path)).orderBy("data_path").collect()
    assert rows[0]["model_args"]["a"] == "true"
    assert rows[0]["avg bytes"] is None
    assert rows[1]["data_path"] == "p"
    sinks.write_run_logs(spark.createDataFrame([(1.0,), (3.0,)], "neg_log_prob_sum double").coalesce(1), str(tmp_path / "logs"))
    sinks.write_run_logs(spark.createDataFrame([(2.0,)], "neg_log_prob_sum double"), str(tmp_path / "logs"))
    assert spark.read.json(str(tmp_path / "logs")).select("run_id").distinct().count() == 2
    again = files.read_run_logs(spark, str(tmp_path / "logs"))
    assert sorted(r["neg_log_prob_sum"] for r in again.collect()) == [1.0, 2.0, 3.0]


def test_archives(spark, tmp_path):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        for name, body in (("../main.tex", b"\\documentclass"), ("x.png", b"1"), ("bad.tex", b"\xff")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    (tmp_path / "a.gz").write_bytes(data.getvalue())
    (tmp_path / "broken.gz").write_bytes(b"no archive")
    rows = files.read_archives(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["path"], r["content"]) for r in rows] == [("../main.tex", "\\documentclass"), ("bad.tex", None)]


def test_paged_source(spark):
    web.register(spark)
    pages = json.dumps({"english": [["a", "b"], [], ["c"]], "german": [], "french": [["d"], "the service failed"]})
    read = spark.read.format("paged").option("transport", "tessera.sources.web:fixture_pages").option("pages", pages)
    df = read.option("partitions", '["english", "german"]').load()
    assert sorted((r["partition"], r["value"]) for r in df.collect()) == [("english", "a"), ("english", "b"), ("english", "c")]
    with pytest.raises(Exception, match="service failed"):
        read.option("partitions", '["french"]').load().collect()


def test_helpers():
    answers = iter([(503, b""), (200, b"ok")])
    assert web.Retry(sleep=lambda _: None).call(lambda: next(answers)) == b"ok"
    assert web.Retry(total=2, sleep=lambda _: None).call(lambda: (500, b"")) is None
    assert web.Retry(sleep=lambda _: None).call(lambda: (404, b"x")) is None
    assert web.encyclopedia_host("german").startswith("https://de.")
    with pytest.raises(ValueError):
        web.encyclopedia_host("klingon")
    assert web.Proxies().choose() is None
    assert web.is_gzip({"content-type": "application/x-gzip"}) and not web.is_gzip({})
    assert web.rate_limit({"X-RateLimit-Limit": "60"}) == {"limit": 60, "remaining": None, "reset": None}
    assert sinks.as_map({"a": "x", "b": {1: 2}}) == {"a": "x", "b": '{"1": 2}'}


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 7} " + "z" * 10) for i in range(50)], "id long, text string")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert run_to_table(distinct_stream(read(), "text"), "t").count() == 7
    seen = Progress()
    spark.streams.addListener(seen)
    where = str(tmp_path / "kept")
    first = run_to_table(distinct_stream(read(), "text"), "t", 3, where)
    assert first.count() == 3
    assert run_to_table(distinct_stream(read(), "text"), "t", 3, where).exceptAll(first).count() == 0
    spark.streams.removeListener(seen)
    assert sum(seen.rows) > 0
    some = collect_until(read(), "text", 3, 8, 4, F.upper)
    assert some.count() == 4
    assert all(r["text"].startswith("TEXT ") and len(r["text"]) == 8 for r in some.select("text").collect())
