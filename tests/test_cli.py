"""The command line, end to end."""

import json

from tessera.__main__ import main


def test_collect_evaluate_report(spark, tmp_path, capsys):
    spark.createDataFrame([(i, f"text number {i % 3} " + "y" * 40) for i in range(9)], "id long, t string").write.parquet(str(tmp_path / "in"))
    specs = [
        {"input": str(tmp_path / "in"), "text": "t", "key": "id", "dataset": "site_a_20250101to20250114", "least": 10, "most": 30, "samples": 2},
        {"input": str(tmp_path / "none"), "text": "t", "key": "id", "dataset": "lost"},
    ]
    (tmp_path / "specs.json").write_text(json.dumps(specs))
    assert main(["collect", str(tmp_path / "specs.json"), str(tmp_path / "out"), "--attempts", "1"]) == 1
    err = capsys.readouterr().err
    assert "site_a_20250101to20250114: succeeded" in err and "lost: failed" in err
    part = next((tmp_path / "out").rglob("*.txt"))
    assert [len(t) for t in json.loads(part.read_text())] == [30, 30]
    corpora = tmp_path / "corpora"
    corpora.mkdir()
    (corpora / "site_a_20250101to20250114.json").write_text(part.read_text())
    assert main(["evaluate", str(corpora), str(tmp_path / "logs"), "--model-type", "repeat", "--chunk-size", "16"]) == 0
    capsys.readouterr()
    assert main(["report", str(tmp_path / "logs"), "--metric", "bpb", "--html"]) == 0
    assert "local/model" in capsys.readouterr().out
