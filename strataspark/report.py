"""Reports of an analysis: text, JSON of versions 1 and 2."""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import DataFrame

from .operators import rules

VERSION, SCHEMA_VERSION = "0.1.0", "2.0"
SECTIONS = (("circular", "CIRCULAR DEPENDENCIES"), ("layer", "LAYER VIOLATIONS"), ("size", "SIZE VIOLATIONS"), ("god_object", "GOD OBJECTS"))
COLORS = {"error": "31", "success": "32", "warn": "33", "info": "36", "bold": "1"}


def wants_color(stream=sys.stdout, env=os.environ) -> bool:
    return "NO_COLOR" not in env and env.get("TERM") != "dumb" and hasattr(stream, "isatty") and stream.isatty()


def paint(kind: str, text: str, on: bool) -> str:
    return f"\033[{COLORS[kind]}m{text}\033[0m" if on else text


def bar(done: int, total: int, cells: int = 20) -> str:
    share = min(1.0, done / max(1, total))
    full = int(share * cells)
    return f"[{'█' * full}{'░' * (cells - full)}] {100 * share:3.0f}%"


def build(path: str, language: str, violations: DataFrame, score: DataFrame) -> dict:
    """What reports print. A report lists every violation, so all of them come to the driver."""
    rows = violations.collect()
    of = lambda rule: [r for r in rows if r.rule_id == rule]
    circular = [{"path": list(r.related), "severity": r.severity} for r in of("rule.circular-dependency")]
    layer = [{"from": r.related[0], "to": r.related[1], "message": r.message} for r in of("rule.layer-validation")]
    size = [{"file": r.file, "function": "" if r.subject == "file" else r.subject, "lines": r.actual, "threshold": r.threshold} for r in of("rule.size")]
    gods = [{"struct": r.struct, "file": r.file, "fields": r.fields, "methods": r.methods} for r in rules.merged_god_objects(violations).collect()]
    return {
        "version": VERSION,
        "path": path,
        "language": language,
        "score": score.first().asDict(),
        "total_violations": len(rows),
        "circular": sorted(circular, key=lambda x: "/".join(x["path"])),
        "layer": sorted(layer, key=lambda x: (x["from"], x["to"], x["message"])),
        "size": sorted(size, key=lambda x: (x["file"], x["function"], x["lines"])),
        "god_object": sorted(gods, key=lambda x: (x["file"], x["struct"])),
    }


def _line(kind: str, v: dict) -> str:
    if kind == "circular":
        return " → ".join([*v["path"], v["path"][0]])
    if kind == "layer":
        return v["message"]
    if kind == "size":
        name = f"Function '{v['function']}' in {v['file']}" if v["function"] else f"File {v['file']}"
        return f"{name}: {v['lines']} lines (threshold: {v['threshold']})"
    return f"Struct '{v['struct']}' in {v['file']}: {v['fields']} fields, {v['methods']} methods"


def text(report: dict, color: bool = False) -> str:
    total = report["score"]["total"]
    sign, tone = ("✗", "error") if total < 50 else ("⚠", "warn") if total < 70 else ("✓", "success")
    out = [paint("bold", "Structural analysis", color), f"Path: {report['path']}", f"Language: {report['language']}", "", paint(tone, f"{sign} Score: {total:.1f} / 100.0", color), "", f"Violations: {report['total_violations']}"]
    out += [f"  {title.capitalize()}: {report['score'][kind]}" for kind, title in SECTIONS]
    for kind, title in SECTIONS:
        if report[kind]:
            out += ["", paint("bold", title, color), *(f"[{i}] {_line(kind, v)}" for i, v in enumerate(report[kind], 1))]
    if report["score"]["exit_code"] == 0 and not report["total_violations"]:
        out += ["", paint("success", "No violations", color)]
    return "\n".join(out) + "\n"


def _penalties(report: dict) -> dict:
    s = report["score"]
    return {"total": s["total"], "max": 100.0, "circularPenalty": s["circular_penalty"], "layerPenalty": s["layer_penalty"], "sizePenalty": s["size_penalty"], "godObjectPenalty": s["god_object_penalty"]}


def json_v1(report: dict) -> str:
    """Keys in a fixed order, two decimals; strings are escaped, and the document is valid with god objects too."""
    q = lambda x: json.dumps(x, ensure_ascii=False)

    def block(name: str, rows: list[dict], order: tuple[str, ...], last: bool = False) -> list[str]:
        out = [f'  "{name}": [']
        for i, r in enumerate(rows):
            out.append("    {")
            out += [f'      "{k}": {q(r[k])}' + "," * (k != order[-1]) for k in order]
            out.append("    }" + "," * (i < len(rows) - 1))
        return [*out, "  ]" + "," * (not last)]

    scores = [f'    "{k}": {v:.2f}' for k, v in _penalties(report).items()]
    found = [f'    "{k}": {report["score"][n]}' for k, n in (("circular", "circular"), ("layer", "layer"), ("size", "size"), ("godObject", "god_object"))]
    lines = ["{", f'  "version": {q(report["version"])},', f'  "path": {q(report["path"])},', '  "score": {', ",\n".join(scores), "  },", '  "violations": {', ",\n".join(found), "  },"]
    lines += block("circularViolations", report["circular"], ("path", "severity"))
    lines += block("layerViolations", report["layer"], ("from", "to", "message"))
    lines += block("sizeViolations", report["size"], ("file", "function", "lines", "threshold"))
    lines += block("godObjectViolations", report["god_object"], ("struct", "file", "fields", "methods"), last=True)
    return "\n".join([*lines, "}"]) + "\n"


def relative(path: str) -> str:
    """Relative to the working directory if inside it, with slashes."""
    inside = os.path.relpath(os.path.abspath(path))
    return (path if inside.startswith("..") else inside).replace(os.sep, "/")


def json_v2(report: dict) -> str:
    """Keys in alphabetical order; empty lists are null, as in the format's other producers."""
    s = report["score"]
    named = {
        "circularViolations": [{"Path": v["path"], "Severity": v["severity"]} for v in report["circular"]],
        "layerViolations": [{"From": v["from"], "To": v["to"], "Message": v["message"]} for v in report["layer"]],
        "sizeViolations": [{"File": v["file"], "Function": v["function"], "Lines": v["lines"], "Threshold": v["threshold"]} for v in report["size"]],
        "godObjectViolations": [{"StructName": v["struct"], "File": v["file"], "FieldCount": v["fields"], "MethodCount": v["methods"]} for v in report["god_object"]],
    }
    body = {k: v or None for k, v in named.items()} | {
        "version": report["version"],
        "schemaVersion": SCHEMA_VERSION,
        "path": relative(report["path"]),
        "score": _penalties(report),
        "summary": {"totalViolations": report["total_violations"], "circular": s["circular"], "layer": s["layer"], "size": s["size"], "godObject": s["god_object"]},
        "language": {"detectedLanguage": report["language"], "confidence": 1.0},
    }
    return json.dumps(body, indent=2, sort_keys=True, ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026") + "\n"
