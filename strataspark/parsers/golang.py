"""A parser for what the analyses need of Go: package, imports, functions, methods and structs.

It tokenises (comments, strings, runes, automatic semicolons) and follows declarations at the top level, and type
declarations within functions. A file is malformed if its package or import clauses are, or, for all but imports, if its
brackets don't match.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import bound_batches

TOKEN = re.compile(
    r"[ \t\r]*+(?:(?P<word>[^\W\d]\w*)|(?P<newline>\n[ \t\r\n]*)|(?P<line>//[^\n]*)|(?P<block>/\*[\s\S]*?\*/)|(?P<raw>`[^`]*`)|(?P<string>\"(?:[^\"\\\n]|\\.)*\")|(?P<rune>'(?:[^'\\\n]|\\.[^'\n]*)')"
    r"|(?P<number>\.?\d[\w.]*(?:[eEpP][+-]\d[\w.]*)?)|(?P<sign>\.\.\.|<-|[-+*/%&|^<>=!:]=|&&|\|\||\+\+|--|<<=?|>>=?|&\^=?|:=|[^\s\w]))"
)
KINDS = ("", *TOKEN.groupindex)
ENDS = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


class Malformed(ValueError):
    pass


def tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, line), with ``;`` where a line's end stands for one."""
    out: list[tuple[str, str, int]] = []
    at, line = 0, 1
    source = source.rstrip(" \t\r")
    for m in iter(TOKEN.scanner(source).match, None):
        at, group = m.end(), m.lastindex
        kind, text = KINDS[group], m[group]
        if kind == "newline" or (kind == "block" and "\n" in text):
            if out:
                last_kind, last, _ = out[-1]
                if last_kind in ("raw", "string", "rune", "number") or (last_kind == "word" and (last not in KEYWORDS or last in ENDS)) or (last_kind == "sign" and last in ENDS):
                    out.append(("sign", ";", line))
            line += text.count("\n")
        elif kind not in ("line", "block"):
            out.append((kind, text, line))
            if kind == "raw":
                line += text.count("\n")
    if at != len(source):
        raise Malformed(f"line {line}")
    out.append(("sign", ";", line))
    return out


class Parser:
    def __init__(self, source: str):
        self.toks, self.i = tokens(source.removeprefix("﻿")), 0

    def text(self, i: int) -> str:
        return self.toks[i][1] if i < len(self.toks) else ""

    def closing(self, i: int) -> int:
        """Where the bracket at ``i`` closes."""
        pairs, stack = {")": "(", "]": "[", "}": "{"}, []
        for j in range(i, len(self.toks)):
            kind, t, line = self.toks[j]
            if kind != "sign":
                continue
            if t in "([{" and t:
                stack.append(t)
            elif t in pairs:
                if not stack or stack.pop() != pairs[t]:
                    raise Malformed(f"line {line}")
                if not stack:
                    return j
        raise Malformed("an open bracket")

    def package(self) -> str:
        if self.text(0) != "package" or len(self.toks) < 2 or self.toks[1][0] != "word":
            raise Malformed("no package clause")
        self.i = 2
        if self.text(2) != ";":
            raise Malformed("package clause")
        return self.text(1)

    def imports(self) -> list[str]:
        out = []
        i = self.i
        while True:
            while self.text(i) == ";":
                i += 1
            if self.text(i) != "import":
                break
            i += 1
            if self.text(i) == "(":
                end = self.closing(i)
                j = i + 1
                while j < end:
                    if self.text(j) == ";":
                        j += 1
                        continue
                    j = self.spec(j, out)
                i = end + 1
            else:
                i = self.spec(i, out)
            if i < len(self.toks) and self.text(i) != ";":
                raise Malformed("import clause")
        self.i = i
        return out

    def spec(self, i: int, out: list[str]) -> int:
        if self.toks[i][0] == "word" or self.text(i) == ".":
            i += 1
        if i >= len(self.toks) or self.toks[i][0] not in ("string", "raw"):
            raise Malformed("import clause")
        out.append(self.text(i)[1:-1])
        return i + 1

    def fields(self, start: int, end: int) -> int:
        """How many fields, or parameters in brackets, there are; grouped names count each."""
        parts, depth, part = [], 0, []
        for j in range(start, end):
            t = self.text(j)
            sign = self.toks[j][0] == "sign"
            if sign and t in ("(", "[", "{"):
                depth += 1
            elif sign and t in (")", "]", "}"):
                depth -= 1
            if depth == 0 and sign and t in (",", ";"):
                parts.append((part, t))
                part = []
            else:
                part.append(j)
        parts.append((part, ";"))
        return sum(1 for p, _ in parts if p)

    def struct_fields(self, start: int, end: int) -> int:
        """Names of each line; an embedded type is one."""
        total, j = 0, start
        while j < end:
            if self.text(j) == ";":
                j += 1
                continue
            names, k = 0, j
            while self.toks[k][0] == "word" and k < end:
                names += 1
                if self.text(k + 1) != ",":
                    break
                k += 2
            total += max(1, names)
            depth = 0
            while j < end and not (depth == 0 and self.text(j) == ";"):
                if self.toks[j][0] == "sign":
                    depth += (self.text(j) in ("(", "[", "{")) - (self.text(j) in (")", "]", "}"))
                j += 1
        return total

    def type_specs(self, i: int, structs: list[dict]) -> int:
        """From after ``type``."""
        if self.text(i) == "(":
            end = self.closing(i)
            j = i + 1
            while j < end:
                j = j + 1 if self.text(j) == ";" else self.type_spec(j, structs)
            return end + 1
        return self.type_spec(i, structs)

    def type_spec(self, i: int, structs: list[dict]) -> int:
        name, line = self.text(i), self.toks[i][2]
        i += 1
        if self.text(i) == "[" and self.toks[i + 1][0] == "word" and self.text(i + 2) != "]":
            i = self.closing(i) + 1
        if self.text(i) == "=":
            i += 1
        if self.text(i) == "struct" and self.text(i + 1) == "{":
            end = self.closing(i + 1)
            structs.append({"name": name, "line": line, "fields": self.struct_fields(i + 2, end), "exported": name[:1].isupper()})
            i = end + 1
        depth = 0
        while i < len(self.toks) and not (depth == 0 and self.text(i) in (";", ")")):
            if self.toks[i][0] == "sign":
                depth += (self.text(i) in ("(", "[", "{")) - (self.text(i) in (")", "]", "}"))
            i += 1
        return i

    def function(self, i: int, out: dict) -> int:
        """From ``func`` at the top level."""
        first = i
        receiver = None
        i += 1
        if self.text(i) == "(":
            end = self.closing(i)
            inner = [self.text(j) for j in range(i + 1, end)]
            if "*" in inner:
                inner = inner[: inner.index("*")] + inner[inner.index("*") + 1 :]
            receiver = inner[-1] if inner and re.fullmatch(r"\w+", inner[-1]) else None
            i = end + 1
            method = True
        else:
            method = False
        name = self.text(i)
        i += 1
        if self.text(i) == "[":
            i = self.closing(i) + 1
        if self.text(i) != "(":
            raise Malformed("function clause")
        end = self.closing(i)
        params = self.fields(i + 1, end)
        last = i = end + 1
        last -= 1
        while i < len(self.toks) and self.text(i) not in (";", "{"):
            if self.text(i) in ("(", "["):
                i = self.closing(i)
            elif self.text(i) in ("struct", "interface") and self.text(i + 1) == "{":
                i = self.closing(i + 1)
            last, i = i, i + 1
        if self.text(i) == "{":
            end = self.closing(i)
            for j in range(i + 1, end):
                if self.toks[j][:2] == ("word", "type") and self.text(j - 1) in ("{", "}", ";", ":"):
                    self.type_specs(j + 1, out["structs"])
            last, i = end, end + 1
        line = self.toks[first][2]
        out["functions"].append({"name": name, "line": line, "lines": self.toks[last][2] + self.toks[last][1].count("\n") - line + 1, "params": params})
        if method:
            out["methods"].append({"receiver": receiver, "name": name})
        return i

    def declarations(self) -> dict:
        out: dict = {"functions": [], "structs": [], "methods": []}
        i = self.i
        while i < len(self.toks):
            t = self.text(i)
            if t == "func" and self.toks[i][0] == "word":
                i = self.function(i, out)
            elif t == "type" and self.toks[i][0] == "word":
                i = self.type_specs(i + 1, out["structs"])
            elif t in ("var", "const") and self.toks[i][0] == "word":
                i += 1
                while i < len(self.toks) and self.text(i) != ";":
                    i = self.closing(i) + 1 if self.toks[i][0] == "sign" and self.text(i) in ("(", "[", "{") else i + 1
            elif t == ";":
                i += 1
            else:
                raise Malformed(f"line {self.toks[i][2]}")
        return out


COLUMNS = {
    "package": "string", "imports": "array<string>", "functions": "array<struct<name:string,line:int,lines:int,params:int>>",
    "structs": "array<struct<name:string,line:int,fields:int,exported:boolean>>", "methods": "array<struct<receiver:string,name:string>>",
}


def parse(source: str | None, want: Iterable[str] = tuple(COLUMNS)) -> dict:
    """package, imports (both null if those clauses are malformed), functions, structs, methods (null if anything is). Declarations
    are followed only if ``want`` has any of the last three."""
    out = dict.fromkeys(COLUMNS)
    if source is None:
        return out
    head = source
    try:
        parser = Parser(source)
    except Malformed:
        # What follows the imports doesn't matter to them.
        cut = re.search(r"(?m)^(?:func|type|var|const)\b", source)
        try:
            parser, head = Parser(source[: cut.start()] if cut else source), None
        except Malformed:
            return out
    try:
        out["package"], out["imports"] = parser.package(), parser.imports()
        if head is not None and not {"functions", "structs", "methods"}.isdisjoint(want):
            out |= parser.declarations()
    except (Malformed, IndexError):
        if out["imports"] is None:
            out["package"] = None
    return out


def parsed(files: DataFrame, want: Iterable[str] = tuple(COLUMNS)) -> DataFrame:
    """The parse of files(path, content), a row each with the path and what is wanted of it, in batches bounded by their bytes."""
    bound_batches(files.sparkSession)
    want = tuple(want)
    schema = StructType.fromDDL(", ".join(["path string", *(f"{name} {COLUMNS[name]}" for name in want)]))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(c, want) for c in batch.column("content").to_pylist()]
            yield pa.record_batch([batch.column("path"), *(pa.array([r[name] for r in rows], arrow.field(name).type) for name in want)], arrow)

    return files.select("path", "content").mapInArrow(run, schema)
