"""Rule isolation, graphs without a closure, file sets of the adapters, import resolution, settings, the command line."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from strataspark import cli, config, engine
from strataspark.operators import graph, rules
from strataspark.parsers import python
from strataspark.session import shared_dir
from strataspark.sources import repo


def tree(folder, **files):
    for name, content in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(content)
    return str(folder)


def context(spark, pairs=(("a", "b"),)):
    edges = spark.createDataFrame(list(pairs), "src string, dst string")
    none = lambda schema: spark.createDataFrame([], schema)
    return rules.Context(spark, none("path string, content string"), none("path string, name string, line int, lines int"), none("dir string, file string, name string, line int, fields int"), none("dir string, name string"), edges)


def test_a_rule_that_raises_on_a_row_is_listed(spark):
    row = ("kept", "info", "size", "m", "f", 0, 0.0, None, None, None, None, None)
    good = rules.Rule("kept", "size", "info", lambda c: c.spark.createDataFrame([row], rules.SCHEMA))
    late = rules.Rule("late", "size", "info", lambda c: c.spark.createDataFrame([row], rules.SCHEMA).withColumn("message", F.raise_error(F.lit("on a row")).cast("string")))
    done = rules.Executor(rules.Registry([good, late]), budget=1e9).execute(context(spark))
    assert [r.rule_id for r in done.violations.collect()] == ["kept"] and list(done.failed) == ["late"] and done.executed == 2
    slow = rules.Executor(rules.Registry([good, rules.Rule("zz", "size", "info", lambda c: rules.none(c.spark))]), budget=0.0).execute(context(spark))
    assert slow.timed_out


def test_cycles_of_large_graphs(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("d", "e")]
    found = rules.cycles(spark.createDataFrame(pairs, "src string, dst string"), most=2).collect()
    assert sorted(list(r.related) for r in found) == [["a", "b", "c"], ["d"]] and {r.rule_id for r in found} == {"rule.circular-dependency"}


def test_strong_components_against_brute_force(spark):
    r = random.Random(5)
    pairs = {(r.randrange(24), r.randrange(24)) for _ in range(34)}
    reach = {i: {i} for i in range(24)}
    for _ in range(24):
        for a, b in pairs:
            reach[a] |= reach[b]
    wanted = {n: min(m for m in range(24) if m in reach[n] and n in reach[m]) for ab in pairs for n in ab}
    edges = spark.createDataFrame(sorted(pairs), "src int, dst int")
    assert {x.node: x.component for x in graph.strong_components(edges).collect()} == wanted
    on_cycle = {n for n in wanted if (n, n) in pairs or sum(c == wanted[n] for c in wanted.values()) > 1}
    assert {x.node for x in graph.cyclic(edges).collect()} == on_cycle


def test_imports_of_the_root_are_no_evidence(spark):
    files = spark.createDataFrame([("a.py", "from . import x\nfrom .b import y\nimport os\n"), ("b.py", "")], "path string, content string").withColumn("is_symlink", F.lit(False))
    assert sorted(r.weight for r in python.evidence(files).collect()) == [0.4, 2.1]


def test_each_adapter_has_its_own_files(spark, tmp_path):
    names = ["vendor/a.go", "build/b.go", ".git/c.go", "x_test.go", ".d.js", "dist/e.js", "f.js", "__pycache__/g.py", "h.py", "test_i.py"]
    files = repo.scan(spark, tree(tmp_path, **{n: "x" for n in names}), hidden=True)
    paths = lambda df: {r.path for r in df.collect()}
    assert paths(repo.go_files(files)) == {"vendor/a.go", "build/b.go"}
    assert paths(repo.script_files(files, "JavaScript")) == {".d.js", "f.js"}
    assert paths(repo.python_files(files)) == {"h.py"}
    assert paths(repo.detectable(files)) == {"x_test.go", "f.js", "h.py", "test_i.py"}


def test_python_imports_are_resolved(spark, tmp_path):
    files = {"app/__init__.py": "", "app/core/__init__.py": "", "app/core/run.py": "import app.util.text\nfrom ..util import text\nfrom . import other\nimport os.path\n", "app/core/other.py": "", "app/util/text.py": "from app.core.run import x\n"}
    done = engine.analyze(spark, tree(tmp_path, **files), resolve=True)
    found = {(r.src, r.dst) for r in done.edges.collect()}
    assert {("app/core/run.py", "app/util/text.py"), ("app/util/text.py", "app/core/run.py"), ("app/core/run.py", "os")} <= found
    assert [list(r.related) for r in done.violations.filter("rule_id = 'rule.circular-dependency'").collect()] == [["app/core/run.py", "app/util/text.py"]]


def test_script_imports_are_resolved(spark, tmp_path):
    files = {"src/a/one.js": "import x from './two';\nimport y from '../b';\nimport z from 'react';\n", "src/a/two.js": "import q from './one.js';\n", "src/b/index.js": ""}
    done = engine.analyze(spark, tree(tmp_path, **files), resolve=True)
    assert {(r.src, r.dst) for r in done.edges.collect()} == {("src/a/one.js", "src/a/two.js"), ("src/a/one.js", "src/b/index.js"), ("src/a/one.js", "react"), ("src/a/two.js", "src/a/one.js")}


def test_settings_act(spark, tmp_path):
    struct = "package p\n\ntype Big struct {\n" + "".join(f"\tF{i} int\n" for i in range(20)) + "}\n"
    folder = tree(tmp_path, **{"a.go": struct + "var x = 1\n" * 600, "internal/b.go": struct})
    ids = lambda cfg: sorted((r.rule_id, r.severity, r.file) for r in engine.analyze(spark, folder, config.completed(cfg)).violations.collect())
    assert ids({"god_object": {"exclude": ["internal/"]}, "size": {"severity": "error"}}) == [("rule.god-object", "warning", "a.go"), ("rule.size", "error", "a.go")]
    assert ids({"rules": {"enable_size_rule": False}, "god_object": {"enabled": False}}) == []


def test_command_line(spark, tmp_path, capsys):
    folder = tree(tmp_path / "r", **{"a.go": 'package a\n\nimport "example.com/é"\n'})
    assert cli.run_extract(cli.parser().parse_args(["extract", "-path", folder, "-json"]), spark) == 0
    assert [json.loads(x) for x in capsys.readouterr().out.splitlines()] == [{"path": "a.go", "package": "a", "import": "example.com/é"}]
    stopped = threading.Event()
    stopped.set()
    assert cli.run_watch(cli.parser().parse_args(["analyze", folder, "-watch", "-explain"]), spark, stopped) == 0
    said = capsys.readouterr()
    assert "Score" in said.out and "Score 100.0 of 100" in said.err


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        class _jsc:
            @staticmethod
            def sc():
                return Context._jsc

            @staticmethod
            def getCheckpointDir():
                return type("None", (), {"isDefined": staticmethod(lambda: False)})

    session = type("Session", (), {"sparkContext": Context(), "conf": {}})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)
