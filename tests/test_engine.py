import json
import os

import pytest

from strataspark import cli, config, engine, history, plugins, report
from strataspark.operators import detect, graph, rules, score
from strataspark.sources import repo


def tree(folder, **files):
    for name, content in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(content)
    return str(folder)


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def dominant(spark, folder, policy=detect.Policy()):
    return detect.dominant(engine.language_stats(repo.scan(spark, folder), policy), policy).first().language


BIG = "package repo\n\nimport (\n\t\"example.com/m/service\"\n\t\"fmt\"\n)\n\ntype Big struct {\n" + "".join(f"\tF{i} int\n" for i in range(20)) + "}\n" + "".join(f"func (b *Big) M{i}(a, c int) int {{ return a }}\n" for i in range(15))


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    files = {
        "go.mod": "module example.com/m\n",
        "repo/a.go": BIG,
        "service/b.go": 'package service\n\nimport "example.com/m/repo"\n\nfunc Long() {\n' + "\tx := 1\n" * 100 + "}\n",
        "cmd/main.go": "package main\n" + "var x = 1\n" * 600,
        "node_modules/x.go": "package x\n",
        ".hidden.go": "package y\n",
        "lib/__init__.py": "import os\n",
    }
    return tree(tmp_path_factory.mktemp("sample"), **files)


def test_analysis(spark, sample):
    done = engine.analyze(spark, sample, resolve=True)
    found = report.build(done.root, done.language, done.violations, done.score)
    assert done.language == "Go" and not done.outcome.failed
    assert [v["path"] for v in found["circular"]] == [["repo/a.go", "service/b.go"]]
    assert found["god_object"] == [{"struct": "Big", "file": "repo/a.go", "fields": 20, "methods": 15}]
    assert [(v["file"], v["function"], v["lines"]) for v in found["size"]] == [("cmd/main.go", "", 601), ("service/b.go", "Long", 102)]
    assert len(found["layer"]) == 2
    assert found["score"]["total"] == 100 - 10 - 2 * 5 - 2 * 3 - 5 and found["score"]["exit_code"] == 2
    assert json.loads(report.json_v1(found))["godObjectViolations"][0]["methods"] == 15
    assert list(json.loads(report.json_v2(found))) == sorted(json.loads(report.json_v2(found)))
    assert "⚠ Score: 69.0" in report.text(found)
    assert engine.totals(done).first().asDict() == {"files": 4, "lines": 44 + 106 + 601 + 1, "functions": 16, "structs": 1}, "Go sources below node_modules count, only the detector leaves them out"


def test_extract(spark, sample):
    rows = engine.extract(spark, sample, "example.com/m").orderBy("path").collect()
    assert [tuple(r) for r in rows] == [("cmd/main.go", "main", None), ("repo/a.go", "repo", "./service"), ("service/b.go", "service", "./repo")]
    assert engine.extract_totals(engine.extract(spark, sample)).first().files == 3


def test_scan(spark, sample, tmp_path):
    paths = {r.path for r in repo.scan(spark, sample).collect()}
    assert {"lib/__init__.py", "node_modules/x.go"} <= paths and ".hidden.go" not in paths
    assert "node_modules/x.go" not in {r.path for r in repo.detectable(repo.scan(spark, sample)).collect()}
    os.symlink("/etc/hostname", tmp_path / "link.py")
    assert repo.scan(spark, str(tmp_path)).first().is_symlink
    assert repo.within(sample, "../x") is None and repo.within(sample, "repo") is not None
    with pytest.raises(ValueError):
        repo.normalised_root("  ")
    assert repo.counts(repo.scan(spark, sample)).first().go_files == 4


def test_detection(spark, tmp_path):
    assert dominant(spark, tree(tmp_path / "tie", **{"a.go": "x", "a.py": "x"})) == "Python"
    assert dominant(spark, tree(tmp_path / "tools", **{"src/app.py": "a\nb", **{f"tools/{i}.go": "package x\n" * 3 for i in range(30)}})) == "Python"
    weighted = detect.Policy({"Go": 0.5, "TypeScript": 3.0}, segment_weights={"tools": 0.1, "apps": 1.2})
    assert dominant(spark, tree(tmp_path / "policy", **{"apps/frontend/main.ts": "let a = 1\n" * 30, **{f"tools/{i}.go": "package x\n" for i in range(20)}}), weighted) == "TypeScript"
    with pytest.raises(engine.Unsupported):
        engine.analyze(spark, tree(tmp_path / "none", **{"a.txt": "x"}))


def test_python_repository(spark, tmp_path):
    folder = tree(tmp_path, **{"app.py": "import util\nimport os\n", "util.py": "from . import x\n\ndef f(a, b):\n    pass\n", "helper.go": "package h\n"})
    done = engine.analyze(spark, folder)
    assert done.language == "Python" and {(r.src, r.dst) for r in done.edges.collect()} >= {("app.py", "util"), ("app.py", "os")}


def test_cycles(spark):
    walk = lambda *pairs: [list(r.path) for r in graph.back_edges(edges(spark, *pairs)).orderBy("cycle_id").collect()]
    assert walk(("A", "B"), ("B", "C")) == []
    assert walk(("A", "B"), ("B", "A")) == [["A", "B"]]
    assert walk(("A", "B"), ("B", "A"), ("C", "D"), ("D", "C")) == [["A", "B"], ["C", "D"]]
    assert walk(("A", "A")) == [["A"]]
    rings = rules.cyclic_components(edges(spark, ("A", "B"), ("B", "C"), ("C", "A"), ("C", "D")))
    assert [list(r.related) for r in rings.collect()] == [["A", "B", "C"]]
    with pytest.raises(ValueError):
        graph.back_edges(edges(spark, ("A", "B"), ("B", "C")), most=1)


def test_layers(spark):
    down = edges(spark, ("p/handler/a", "p/service/b"), ("p/service/b", "p/repo/c"))
    up = edges(spark, ("p/repo/c", "p/service/b"), ("p/service/b", "p/handler/a"), ("p/report/x", "p/service/b"))
    assert rules.upward_imports(down).count() == 0 and rules.upward_imports(up).count() == 2


def test_boundaries(spark):
    found = rules.boundaries(edges(spark, ("a", "b"), ("b", "a"), ("a", "os/exec"), ("a", "c")), {"a": ["b"], "b": []}, {"a": ["os/exec"]})
    assert {tuple(r.related) for r in found.collect()} == {("b", "a"), ("a", "os/exec")}


def test_registry_and_executor(spark):
    row = lambda i: lambda c: rules.none(c.spark).union(c.spark.createDataFrame([(i, "info", "size", "m", "f", 0, 0.0, None, None, None, None, None)], rules.SCHEMA))
    registry = rules.Registry([rules.Rule("zeta", "size", "info", row("zeta")), rules.Rule("alpha", "size", "info", row("alpha")), rules.Rule("beta", "testing", "info", lambda c: 1 / 0, languages=("Go",)), rules.Rule("py", "size", "info", row("py"), languages=("Python",))])
    assert registry.ids() == ["alpha", "beta", "py", "zeta"] and [r.id for r in registry.by_category("testing")] == ["beta"]
    with pytest.raises(ValueError):
        registry.register(rules.Rule("alpha", "size", "info", row("alpha")))
    nothing = rules.none(spark)
    context = rules.Context(spark, nothing, nothing, nothing, nothing, nothing, ("Go", "TypeScript"))
    done = rules.Executor(registry, float("inf")).execute(context)
    assert [r.rule_id for r in done.violations.collect()] == ["alpha", "zeta"] and done.executed == 3 and list(done.failed) == ["beta"]
    assert rules.Executor(registry).by_ids(context, ["zeta", "missing", "alpha"]).executed == 2
    assert rules.Executor(registry, budget=-1).execute(context).timed_out


def test_empty_score(spark):
    got = score.score(rules.none(spark)).first()
    assert got.total == 100.0 and got.exit_code == 0


def test_history(spark, tmp_path):
    folder = str(tmp_path / "history")
    assert history.load(spark, folder).count() == 0
    history.append(spark, folder, 75.0)
    assert history.summary(history.load(spark, folder), 80) == "No earlier score to compare with"
    history.append(spark, folder, 75.0)
    assert history.summary(history.load(spark, folder), 80) == "Current Score: 80.0\nPrevious Score: 75.0\nDelta: +5.0 (increased)"
    path = tmp_path / "h.json"
    path.write_text('[{"timestamp": "2024-01-01T00:00:00Z", "score": 82.5}, {"timestamp": "2024-01-02T00:00:00Z", "score": 85.0}]')
    assert json.loads(history.to_json(history.load_json(spark, str(path)))) == json.loads(path.read_text())
    path.write_text("{broken")
    assert history.load_json(spark, str(path)).count() == 0


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    assert config.load(str(path)) == config.DEFAULTS
    path.write_text("size:\n  max_file_lines: 10\n  max_function_lines: 0\n  enabled: false\nlanguage_detection:\n  weights: {Go: 2}\n")
    cfg = config.load(str(path))
    assert cfg["size"] == {"max_file_lines": 10, "max_function_lines": 80, "enabled": False, "severity": "warning"} and cfg["language_detection"]["weights"] == {"Go": 2}
    for bad in ("Size: {}\n", "x: 1\n", "weights: {circular: -1}\n", "language_detection: {Tie_Break_Order: [a]}\n", "language_detection: {weights: {Go: -1}}\n", "size: {severity: bad}\n", "a: [\n"):
        path.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(str(path))
    config.save(cfg, str(path))
    assert config.load(str(path)) == cfg


def test_plugins(tmp_path):
    registry = rules.Registry()

    class Own:
        name, version, description = "own", "1", ""

        def rules(self):
            return [rules.Rule("own.a", "size", "info", lambda c: None)]

    manager = plugins.PluginManager(str(tmp_path / "missing"), registry)
    manager.discover()
    manager.register(Own())
    assert len(registry) == 1 and len(manager.loaded()) == 1
    assert plugins.generate("  Large Interface  ", str(tmp_path / "rules"))[0].endswith("large_interface_rule.py")
    assert "LargeInterfaceRule" in (tmp_path / "rules/large_interface_rule.py").read_text()
    compile((tmp_path / "rules/large_interface_rule.py").read_text(), "x", "exec")
    with pytest.raises(ValueError):
        plugins.generate("invalid/rule", str(tmp_path))


def test_cli(tmp_path, capsys):
    args = cli.parser().parse_args(["analyze", "here", "-path=there", "-format", "text", "-json"])
    assert (args.path or args.place) == "there" and args.format == "json"
    assert cli.main(["anlyze"]) == 1 and "analyze" in capsys.readouterr().err
    assert cli.main(["version"]) == 0
    answers = iter(["3", "42", "1", "9", "4", "x", "7", "0"])
    args = cli.parser().parse_args(["interactive", "-config", str(tmp_path / "c.yaml")])
    assert cli.run_interactive(args, lambda _: next(answers)) == 0
    cfg = config.load(str(tmp_path / "c.yaml"))
    assert cfg["size"]["max_file_lines"] == 42 and cfg["size"]["enabled"] is False


def test_adapters(spark, tmp_path):
    import dataclasses

    from strataspark import adapters

    folder = tree(tmp_path, **{"a.go": "package a\n", "b.txt": "x"})
    files = repo.scan(spark, folder)
    detector = adapters.Detector()
    assert detector.supported() == ["Go", "JavaScript", "Python", "TypeScript"] and detector.detect(files).language == "Go"
    with pytest.raises(ValueError):
        detector.register(adapters.GO)
    bare = adapters.Detector([dataclasses.replace(adapters.GO, capabilities=frozenset({"graph"}))])
    with pytest.raises(adapters.Unsupported):
        bare.detect(files)
    with pytest.raises(adapters.Unsupported):
        adapters.Detector([adapters.PYTHON]).detect(files)
