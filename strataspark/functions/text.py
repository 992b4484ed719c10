"""Column expressions over file contents: trims, line counts, path segments, import names.

White space in trims is Unicode white space; ``\\s`` of Java leaves some of it out, so patterns carry ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAYER_WORDS = {"handler": 0, "service": 1, "repo": 2}
ROLE_OF_SEGMENT = {"src": "product", "app": "product", "pkg": "product", "test": "test", "tests": "test", "tools": "tooling", "scripts": "tooling", "hack": "tooling", "examples": "tooling", "third_party": "tooling"}
ROLE_WEIGHTS = {"product": "1.0", "test": "0.6", "tooling": "0.2", "unknown": "0.8"}
IGNORED_DIRS = tuple("vendor venv target out obj node_modules env dist build bower_components bin __pycache__ .vscode .vs .tox .svn .pytest_cache .npm .idea .hg .git .env".split())
MAX_LINE = 1 << 20  # a longer line makes the streamed count 0
NAMED_FIRST_PARTS = tuple("unsafe unicode time text testing syscall sync strings strconv sort runtime regexp reflect pprof plugin path os net mime math log io internal index image html hash go fmt flag errors encoding debug database crypto context container compress bytes bufio archive".split())
PYTHON_STDLIB = tuple("xml urllib unittest unicodedata typing time threading textwrap tempfile sys subprocess struct string socket re random pathlib os multiprocessing math logging json itertools io inspect http hashlib functools email datetime csv configparser collections codecs base64 asyncio argparse abc".split())
NODE_BUILTINS = tuple("util url path os https http fs".split())


def trim(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def split_lines(c: Column) -> Column:
    """Line ends plus one; 1 for an empty text."""
    return F.size(lines(c))


def scanned_lines(c: Column) -> Column:
    """Lines as a scanner sees them: a last empty line doesn't count, an empty text is 1, and a line over 1 MiB makes it 0."""
    count = F.size(lines(c)) - F.when(F.endswith(c, F.lit("\n")), 1).otherwise(0)
    too_long = F.when(F.octet_length(c) > MAX_LINE, F.exists(lines(c), lambda x: F.octet_length(x) > MAX_LINE)).otherwise(False)
    return F.when(too_long, 0).otherwise(F.greatest(count, F.lit(1)))


def filled_lines(c: Column) -> Column:
    """Lines with other than white space."""
    return F.size(F.filter(lines(c), lambda x: x.rlike(r"(?U)\S")))


def file_lines(c: Column) -> Column:
    """Line ends, and one more if the last line has none."""
    return F.size(lines(c)) - F.when(F.endswith(c, F.lit("\n")) | (c == ""), 1).otherwise(0)


def first_segment(path: Column, names) -> Column:
    """The first segment of a lower-cased path that is one of ``names``; null if none is."""
    return F.try_element_at(F.filter(F.split(F.lower(path), "/"), lambda s: s.isin(*names)), F.lit(1))


def path_role(path: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in ROLE_OF_SEGMENT.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, first_segment(path, ROLE_OF_SEGMENT)), F.lit("unknown"))


def role_weight(role: Column) -> Column:
    """Exact decimal weight of a role."""
    out = F.lit(ROLE_WEIGHTS["unknown"])
    for name, weight in ROLE_WEIGHTS.items():
        out = F.when(role == name, F.lit(weight)).otherwise(out)
    return out.cast("decimal(10,4)")


def segment_weight(path: Column, weights: dict[str, float]) -> Column:
    """The least positive weight among the policy's segments in the path, 1 where there is none."""
    hits = [F.when(F.contains(path, F.lit(f"/{s}/")) | F.endswith(path, F.lit(f"/{s}")), F.lit(str(w)).cast("decimal(10,4)")) for s, w in sorted(weights.items()) if w > 0]
    return F.coalesce(F.array_min(F.array(*hits)) if hits else F.lit(None).cast("decimal(10,4)"), F.lit("1").cast("decimal(10,4)"))


def language_weight(language: Column, weights: dict[str, float]) -> Column:
    out = F.lit("1")
    for name, w in weights.items():
        if w > 0:
            out = F.when(language == name, F.lit(str(w))).otherwise(out)
    return out.cast("decimal(10,4)")


def has_segment(path: Column, word: str) -> Column:
    """Whether ``word`` is a whole segment, bounded by slashes of either kind or the ends; case counts."""
    return path.rlike(rf"(^|[/\\]){word}($|[/\\])")


def layer(path: Column) -> Column:
    """handler before service before repo; service where there is none."""
    return F.when(has_segment(path, "handler"), "handler").when(has_segment(path, "service"), "service").when(has_segment(path, "repo"), "repo").otherwise("service")


def layer_order(name: Column) -> Column:
    return F.when(name == "handler", 0).when(name == "service", 1).when(name == "repo", 2)


def ignored(directory: Column, names=IGNORED_DIRS) -> Column:
    """Whether a segment of the path is one of the ignored names."""
    return F.exists(F.split(directory, "/"), lambda s: s.isin(*names))


def go_import(c: Column) -> Column:
    return trim(c)


def python_import(c: Column) -> Column:
    return F.split_part(trim(c), F.lit("."), F.lit(1))


def js_import(c: Column) -> Column:
    """Package of an import: relative ones as they are, ``@scope/name``, else the first part; ``node:`` dropped."""
    t = F.regexp_replace(trim(c), "^node:", "")
    scoped = F.concat_ws("/", F.split_part(t, F.lit("/"), F.lit(1)), F.nullif(F.split_part(t, F.lit("/"), F.lit(2)), F.lit("")))
    return F.when(t.startswith("./") | t.startswith("../"), t).when(t.startswith("@"), scoped).otherwise(F.split_part(t, F.lit("/"), F.lit(1)))


def module_import(c: Column, module: str) -> Column:
    """Imports of the module itself as paths from its root."""
    if not module:
        return c
    return F.when(c == module, F.lit("./")).when(c.startswith(f"{module}/"), F.concat(F.lit("./"), F.substr(c, F.lit(len(module) + 2)))).otherwise(c)


def is_go_stdlib(c: Column) -> Column:
    """First part without dot or dash, and one of the named ones."""
    first = F.split_part(c, F.lit("/"), F.lit(1))
    return ~first.contains(".") & ~first.contains("-") & first.isin(*NAMED_FIRST_PARTS)


def is_stdlib(c: Column, language: str) -> Column:
    if language == "Go":
        return ~c.contains(".")
    if language == "Python":
        return F.split_part(c, F.lit("."), F.lit(1)).isin(*PYTHON_STDLIB)
    return js_import(c).isin(*NODE_BUILTINS)


def parent(path: Column) -> Column:
    """Directory of a path, ``.`` at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def struct_key(path: Column, name: Column) -> Column:
    return F.concat_ws("#", parent(path), name)


def excluded(path: Column, patterns=("internal/",)) -> Column:
    """Whether any pattern is part of the path."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(path, F.lit(p))
    return out


def layer_message(source: Column, source_layer: Column, target: Column, target_layer: Column) -> Column:
    return F.format_string("%s (%s) -> %s (%s): upward import not allowed", source, source_layer, target, target_layer)


def cycle_text(path: Column) -> Column:
    """The nodes joined by arrows, closed with the first."""
    return F.concat(F.array_join(path, " → "), F.lit(" → "), F.element_at(path, 1))


def trend_text(delta: Column) -> Column:
    return F.when(delta.isNull(), "no previous data").when(delta > 0, "increased").when(delta < 0, "decreased").otherwise("unchanged")


def indicator(score: Column) -> Column:
    return F.when(score < 50, "✗").when(score < 70, "⚠").otherwise("✓")
