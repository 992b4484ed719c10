"""Plugins that bring rules, and templates of new ones."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from typing import Protocol

from .operators.rules import Registry, Rule


class Plugin(Protocol):
    name: str
    version: str
    description: str

    def rules(self) -> list[Rule]: ...


@dataclass
class PluginInfo:
    name: str
    version: str = ""
    description: str = ""
    loaded: bool = False
    error: str = ""


class PluginManager:
    def __init__(self, folder: str, registry: Registry):
        self.folder, self.registry, self.plugins, self.infos = folder, registry, {}, []

    def discover(self) -> None:
        """List rule files; code isn't run from a folder, so none is loaded. A missing folder has none."""
        for folder, folders, files in os.walk(self.folder):
            folders.sort()
            self.infos += [PluginInfo(f, error="plugins are registered in code") for f in sorted(files) if f.endswith((".py", ".yaml"))]

    def register(self, plugin: Plugin) -> None:
        if plugin.name in self.plugins:
            raise ValueError(f"plugin {plugin.name!r} is registered already")
        for rule in plugin.rules():
            self.registry.register(rule)
        self.plugins[plugin.name] = plugin
        self.infos.append(PluginInfo(plugin.name, plugin.version, plugin.description, True))

    def loaded(self) -> list[PluginInfo]:
        return [i for i in self.infos if i.loaded]


TEMPLATE = '''"""{title}."""

from pyspark.sql import functions as F

from strataspark.operators.rules import Context, Rule, _rows


def evaluate(context: Context):
    found = context.files.filter(F.lit(False))  # what breaks the rule
    return _rows(found, "rule.{name}", "warning", "maintainability", -1.0, F.lit("{title}"), file=F.col("path"))


{type_name} = Rule("rule.{name}", "maintainability", "warning", evaluate)
'''
TEST_TEMPLATE = '''from {module} import {type_name}


def test_is_named():
    assert {type_name}.id == "rule.{name}"
'''


def rule_name(raw: str) -> str:
    """Lower case with dashes; other than letters, digits and dashes is an error."""
    name = re.sub(r"[ _]", "-", raw.strip().lower()).strip("-")
    if not re.fullmatch(r"[a-z0-9-]+", name):
        raise ValueError(f"not a name for a rule: {raw!r}")
    return name


def type_name(name: str) -> str:
    return ("".join(p[:1].upper() + p[1:] for p in re.split("[-_]", name)) or "Custom") + "Rule"


def generate(raw: str, folder: str = "rules") -> list[str]:
    """Write a rule and its test; existing files aren't touched."""
    name = rule_name(raw)
    module = name.replace("-", "_") + "_rule"
    values = {"name": name, "title": name.replace("-", " ").capitalize(), "type_name": type_name(name), "module": module}
    os.makedirs(folder, exist_ok=True)
    paths = [os.path.join(folder, f"{module}.py"), os.path.join(folder, f"test_{module}.py")]
    if any(map(os.path.exists, paths)):
        raise FileExistsError(paths[0])
    for path, template in zip(paths, (TEMPLATE, TEST_TEMPLATE)):
        with open(path, "w", encoding="utf-8") as f:
            f.write(template.format(**values))
    return paths
