"""Problem 3: signs of single files and shared trees."""

import pytest

from tessera.llm.foreign_code import foreign_files, merkle, nodes, reasons, signs

CODE = "import os\n\ndef run(path):\n    for name in os.listdir(path):\n        if name.endswith('.x'):\n            return open(name)\n    return None\n"
BLOB = "D = [\n" + "  0x16,0x8d,0xfd,0xb0,0x47,0x62,0xfd,0xae,\n" * 40 + "]\n"


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.py", CODE, []),
        ("a.py", "# Generated by xgen 1.7. DO NOT EDIT!\n" + CODE, ["tool"]),
        ("a.py", CODE + "# This file was automatically created from a.idl\n", ["tool"]),
        ("a.cpp", "/* Diese Datei wurde automatisch erzeugt (x) */\n" + CODE, ["tool"]),
        ("a.py", "# Helpers for generated route code. Written by hand, please keep it readable.\n" + CODE, []),
        ("a.py", "# Copyright (c) 2018 A\n# Licensed under the A terms.\n" + CODE, []),
        ("a.py", 'TEXT = "# Generated by xgen 1.7. DO NOT EDIT!"\n' + CODE, []),
        ("a.py", "# x 2.5.0\n# Bundled copy, unmodified. Upstream licence applies.\n" + CODE, ["origin"]),
        ("node_modules/x/a.js", CODE, ["place"]),
        ("extern/lib-7.17.1/a.js", CODE, ["place"]),
        ("vendor_portal/a.js", CODE, []),
        ("a.js", "var a=1;" * 200, ["minified"]),
        ("a.js", CODE + "x = '" + "y" * 300 + "'\n" + CODE * 5, []),
        ("a.py", BLOB, ["data", "repeated"]),
        ("a.py", CODE + "T = [\n  1, 2, 3,\n  4, 5, 6,\n]\n" + CODE, []),
        ("a.yml", "a_b: 1\n" * 50, []),
        (None, "", []),
        ("vendor/a.py", " \n", ["place"]),
    ],
)
def test_reasons(path, text, want):
    assert reasons(path, text) == want


def rows(spark, data):
    return spark.createDataFrame(data, "file_id long, html_url string, target_file string, content string, repo int")


def marked(spark, data):
    return {r["file_id"]: r["reasons"] for r in foreign_files(rows(spark, data)).collect()}


def test_shared_trees(spark):
    lib = [CODE.replace("os", f"m{i}") * 3 for i in range(4)]
    data = [
        (1, "h/z/r", "src/own.py", lib[2], 0),  # the original of what others vendor
        (2, "h/a/r", "vendor/x/one.py", lib[0], 0),
        (3, "h/b/r", "vendor/x/one.py", lib[0] + "  \n", 0),
        (4, "h/b/r", "vendor/y/two.py", lib[1], 0),
        (5, "h/e/r", "x.py", None, 0),
        (6, None, None, "var a=1;" * 200, 0),
        (7, "h/c/r", "third_party/z/own.py", lib[2], 0),
        (8, "h/d/r", "third_party/z/own.py", lib[2], 0),
        (9, "h/e/r", "lib/copied.py", lib[2], 0),  # without a place, later than the original
        (10, "h/f/r", "a.py", lib[3], 0),
        (11, "h/g/r", "b.py", lib[3], 0),  # copied between repositories, vendored by none
        (12, "h/a/r", "vendor/x/one.py", lib[0], 0),
    ]
    data += [(20 + 2 * k + j, f"h/o{k}/r", f"p{k}/lib/f{j}.py", CODE.replace("os", f"q{j}") * 3, 0) for k in range(3) for j in range(2)]
    assert marked(spark, data) == {
        2: ["place", "shared"], 3: ["place", "shared"], 4: ["place"], 6: ["minified"], 7: ["place", "shared"],
        8: ["place", "shared"], 9: ["shared"], 12: ["place", "shared"],
    }
    assert marked(spark, data[:0] or [(1, None, None, None, 0)]) == {}


def test_empty_and_tiny_files_say_nothing(spark):
    data = [(1, "h/a/r", "vendor/lib/__init__.py", "", 0), (2, "h/b/r", "vendor/lib/__init__.py", "", 0)]
    data += [(i, f"h/o{i}/r", "pkg/__init__.py", "", 0) for i in range(3, 8)]
    data += [(8, "h/a/r", "vendor/u/util.py", "x = 1\ny = 2\n", 0), (9, "h/b/r", "vendor/u/util.py", "x = 1\ny = 2\n", 0)]
    data += [(10, "h/c/r", "util.py", "x = 1\ny = 2\n", 0)]
    assert set(marked(spark, data)) == {1, 2, 8, 9}


def test_one_vendored_copy_leaves_the_original(spark):
    util = CODE * 3
    assert marked(spark, [(1, "h/a/r", "util.py", util, 0), (2, "h/b/r", "vendor/u/util.py", util, 0)]) == {2: ["place", "shared"]}
    assert marked(spark, [(1, "h/b/r", "vendor/u/util.py", util, 0), (2, "h/a/r", "util.py", util, 0)]) == {1: ["place", "shared"]}


def test_data_saved_as_configuration():
    assert reasons("a.json", "[" + "1.25, -3, 40," * 400 + "1]") == ["minified"]
    assert reasons("a.json", "[\n" + "1.25, -3, 40,\n" * 400 + "1]") == ["data"]
    assert reasons("a.json", "{\n" + '"name": "value", "port": 8080,\n' * 100 + "}") == []


def test_merkle(spark):
    lib = [CODE.replace("os", f"m{i}") * 3 for i in range(2)]
    data = [(1, "h/a/r", "x/b/one.py", lib[0], 0), (2, "h/a/r", "x/b/two.py", lib[1], 0), (3, "h/b/r", "q/one.py", lib[0], 0),
            (4, "h/b/r", "q/two.py", "older", 0), (5, "h/b/r", "q/two.py", lib[1], 0), (6, "h/c/r", "q/two.py", lib[0], 0)]
    trees = {r["node"]: r for r in merkle(signs(rows(spark, data))).collect()}
    at = lambda repo, path: trees[[n for n, _, _ in nodes(repo, path + "/_", 1)][1]]["hash"]
    assert at("h/a/r", "x/b") == at("h/b/r", "q") != at("h/c/r", "q")
    assert at("h/a/r", "x") != at("h/a/r", "x/b")
    assert len(trees) == 2 + 2 + 2 + 1 + 1 + 1
    deep = "/".join(f"d{i}" for i in range(300)) + "/f.py"
    assert len(nodes("r", deep, 5)) == 301
