import json

from strataspark.functions import text as T
from strataspark.parsers import golang, metadata, python, scripts
from pyspark.sql import functions as F


def files(spark, **contents):
    return spark.createDataFrame([(p.replace("__dot__", "."), c, False) for p, c in contents.items()], "path string, content string, is_symlink boolean")


def test_go():
    source = '''// comment
package p // more

import (
	"fmt"
	x "a/b"
	. "c"
)
import `d`

type (
	A struct { x, y int; B; *C; m map[string]struct{ z int } }
	E = int
)

type G[T any] struct { t T }

/* block
*/
func (a *A) One(x, y int, f func(int, string) error) (int, error) {
	type local struct { q int }
	s := "}"
	return 1, nil
}

func (g G[T]) Two() {}
func Three[T any](x ...T) { }
var f = func() { println("{") }
'''
    got = golang.parse(source)
    assert got["package"] == "p" and got["imports"] == ["fmt", "a/b", "c", "d"]
    assert [(f["name"], f["params"], f["lines"]) for f in got["functions"]] == [("One", 3, 5), ("Two", 0, 1), ("Three", 1, 1)]
    assert [(s["name"], s["fields"], s["exported"]) for s in got["structs"]] == [("A", 5, True), ("G", 1, True), ("local", 1, False)]
    assert [m["receiver"] for m in got["methods"]] == ["A", None]


def test_go_malformed():
    assert golang.parse("package p\nimport \"a\"\nfunc f() {\n")["imports"] == ["a"]
    assert golang.parse("package p\nimport \"a\"\nfunc f() {\n")["functions"] is None
    assert golang.parse("import \"a\"\n")["imports"] is None
    assert golang.parse("")["package"] is None and golang.parse(None)["imports"] is None


def test_python(spark):
    df = files(spark, a="import os.path, sys\n  from x.y import z\nimport numpy as np\n# import no\n", b="def f(self):\n  pass\nasync def g(): pass\nclass K(Base):\n def h(self, x): pass\n")
    assert {r.path: list(r.imports) for r in python.imports(df).collect()} == {"a": ["os", "x", "numpy"], "b": []}
    assert {r.path: (r.lines, r.imports, r.functions) for r in python.metrics(df).collect()} == {"a": (5, 3, 0), "b": (6, 0, 2)}
    assert [(r.name, r.params) for r in python.functions(df).orderBy("line").collect()] == [("f", 0), ("h", 2)]
    assert [(r.name, r.exported) for r in python.classes(df).collect()] == [("K", True)]
    long = files(spark, a="import os\n" + "#" * (64 << 10))
    assert python.imports(long).count() == 0


def test_python_evidence(spark):
    df = files(spark, **{"pkg/__init__.py": "", "pkg/app/__init__.py": "", "pkg/app/main.py": "from .service import a\nfrom ..shared import b\nimport os, sys as s\nfrom . import c\n"})
    rows = python.evidence(df).collect()
    assert sorted(r.weight for r in rows) == [0.4, 0.4, 2.1, 2.1, 2.1]
    roots = python.module_roots(df)
    assert {r.dir: r.root for r in roots.collect()} == {"pkg": ".", "pkg/app": "."}
    named = python.normalised(python.import_evidence(df), roots)
    assert sorted(r.module for r in named.collect()) == ["os", "pkg", "pkg", "pkg", "sys"]
    assert python.resolved(".", ".", "", 1) == ""


def test_scripts(spark):
    deep = 1
    for _ in range(9):
        deep = {"a": deep}
    df = files(spark, **{"package.json": "{}", "app.ts": "import a from 'react';\n import {b} from \"./x\"\nconst c = require('d')\n", "sub/tsconfig.json": "{", "sub/b.ts": "", "deep/package.json": json.dumps(deep), "deep/c.ts": ""})
    source = df.filter("path LIKE '%.ts'")
    assert {r.path: list(r.imports) for r in scripts.imports(source).collect()}["app.ts"] == ["react", "./x"]
    assert {r.path: (r.lines, r.imports) for r in scripts.metrics(source).collect()}["app.ts"] == (4, 3)
    signals = scripts.evidence(df, source, "TypeScript").collect()
    assert sorted((r.path, r.signal) for r in signals) == [("app.ts", "package_json"), ("app.ts", "source_file"), ("deep/c.ts", "source_file"), ("sub/b.ts", "source_file")]
    assert metadata.problem(json.dumps(deep)) == "nested too deep" and metadata.problem("[]") == "not an object" and metadata.problem('{"a": [1]}') is None
    assert metadata.problem(json.dumps({"é" * 65: 1})) == "key too long"


def test_import_names(spark):
    one = lambda c, x: spark.createDataFrame([(x,)], "x string").select(c(F.col("x"))).first()[0]
    assert one(T.go_import, " \t a/b ") == "a/b"
    assert one(T.python_import, " requests.sessions ") == "requests"
    assert [one(T.js_import, x) for x in (" @scope/pkg/utils ", " node:fs ", "./a/b", "react/dom", "@x")] == ["@scope/pkg", "fs", "./a/b", "react", "@x"]
    assert one(lambda c: T.path_role(c), "x/SRC/tests/a") == "product" and one(lambda c: T.path_role(c), "a") == "unknown"
    assert one(lambda c: T.is_go_stdlib(c), "net/http") is True and one(lambda c: T.is_go_stdlib(c), "github.com/a") is False
    assert [one(T.scanned_lines, x) for x in ("", "a", "a\n", "a\n\nb", "x" * (1 << 20) + "y")] == [1, 1, 1, 3, 0]
    assert [one(T.file_lines, x) for x in ("", "a\n", "a")] == [0, 1, 1]
    assert one(lambda c: T.layer(c), "a\\repo\\b") == "repo"


def test_python_warnings(spark):
    df = files(spark, a="x" * ((2 << 20) + 10), b="from . import\n")
    assert [(r.path, r.warning) for r in python.warnings(df).collect()] == [("a", "too large")]
    assert python.evidence(df).count() == 0
