"""Main content of HTML pages by tag-path ratios.

A page's text nodes are grouped by their path of tags from the root. Over a path's nodes, two ratios are formed: text length
and punctuation, each a node; what the path holds inside links counts against it. The ratios, in the order of the nodes, are
smoothed by a Gaussian, fused as a product, and nodes above the threshold, a share of the standard deviation over the page,
are its content.

Script, style, title and similar elements and comments hold no text. Unclosed tags are closed where HTML says so; a link is an
anchor with an href, up to its end, to the next anchor, to the end of the element that it is in, or to the next block where
no end follows. The head's tags are optional and it is no part of a path. Work is linear in the page.

Defined results: a null or empty html, or one without text, has an empty text and no nodes; pages are read whole; of equal
ratios all nodes are content; repeated rows have repeated results; a null page_id is carried along; an empty table has an
empty result; a page_id that doesn't cast to bigint is an error; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from .textkit import map_batches


@dataclass(frozen=True)
class Params:
    sigma: float = 1.0  # of the smoothing, in nodes
    threshold: float = 1.0  # in standard deviations


NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
VALUE = re.compile(r"=\s*+([\"']?)")
HREF = re.compile(r"(?:^|[\s\"'/])href\s*+=", re.IGNORECASE)
ANCHOR = re.compile(r"<a(?=[\s/>])", re.IGNORECASE)
ANCHOR_END = re.compile(r"</a(?=[\s/>])", re.IGNORECASE)
#: Elements without text. The first end with the page where their end tag is missing; of the others only the tag is dropped then.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style", "textarea", "title", "noscript", "template", "svg", "select")}
TO_THE_END = frozenset(("script", "style", "textarea", "title"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var".split())
BLOCK = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?¡¿…。，、；：！？]")


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, is an end tag, name in lower case, attributes) of the tags; comments and elements without text have no name."""
    at, missing, length = 0, set(), len(page)

    def find(what: str, start: int) -> int:
        """Like str.find; what isn't there isn't looked for again."""
        if what in missing or (i := page.find(what, start)) < 0:
            missing.add(what)
            return -1
        return i

    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = find("-->", start + 4)
            at = length if end < 0 else end + 3
            yield start, at, False, "", ""
            continue
        if page[at : at + 1] in ("!", "?"):
            end = find(">", start)
            at = length if end < 0 else end + 1
            yield start, at, False, "", ""
            continue
        m = NAME.match(page, start)
        if m is None:
            continue
        end = first = m.end()
        while (end := find(">", end)) >= 0:
            equals = page.find("=", first, end)
            if equals < 0:
                break
            value = VALUE.match(page, equals)
            first = value.end()
            if value[1]:
                closed = find(value[1], first)
                first = first if closed < 0 else closed + 1
            end = max(first, equals)
        if end < 0:
            return  # no tag ends from here on
        name, at = m[2].lower(), end + 1
        if not m[1] and name in RAW and name not in missing:
            closing = RAW[name].search(page, at)
            if closing is not None or name in TO_THE_END:
                at = length if closing is None else (length if (stop := find(">", closing.end())) < 0 else stop + 1)
                yield start, at, False, "", ""
                continue
            missing.add(name)
        yield start, at, bool(m[1]), name, page[m.end() : end]


def _nodes(page: str) -> tuple[list[tuple[int, str, bool]], list[tuple[int, str]]]:
    """(path, text, in a link) of the blocks of text, and the paths as (parent, name), by number; 0 is the root."""
    paths: list[tuple[int, str]] = [(0, "")]
    number: dict[tuple[int, str], int] = {}
    stack: list[str] = []
    at_path = [0]
    opened: Counter[str] = Counter()
    nodes: list[tuple[int, str, bool]] = []
    parts: list[str] = []
    linked, link = 0, 0  # link: 0, or one more than the elements that were open at the anchor
    starts = [m.start() for m in ANCHOR.finditer(page)]
    ends = [m.start() for m in ANCHOR_END.finditer(page)]

    def flush():
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                nodes.append((at_path[-1], text, 2 * linked > sum(map(len, parts))))
            parts.clear()
        linked = 0

    def push(name: str):
        key = (at_path[-1], name)
        if key not in number:
            number[key] = len(paths)
            paths.append(key)
        stack.append(name)
        at_path.append(number[key])
        opened[name] += 1

    def pop(size: int):
        nonlocal link
        while len(stack) > size:
            opened[stack.pop()] -= 1
            at_path.pop()
        if link > size + 1:
            link = 0

    def ended_before_next(at: int) -> bool:
        i, j = bisect_left(ends, at), bisect_left(starts, at)
        return i < len(ends) and (j == len(starts) or ends[i] < starts[j])

    at = 0
    for start, end, closing, name, attributes in tags(page):
        if start > at:
            parts.append(page[at:start])
            linked += (start - at) * (link > 0)
        at = end
        if not name or name == "head":
            continue
        if name in INLINE:
            if name == "a":
                link = len(stack) + 1 if not closing and HREF.search(attributes) else 0
            continue
        if name == "br":
            parts.append("\n")
            continue
        flush()
        if closing:
            if opened[name]:
                size = len(stack) - 1
                while stack[size] != name:
                    size -= 1
                pop(size)
        elif name not in VOID and not attributes.endswith("/"):
            if name in CLOSES:
                closed, bounds = CLOSES[name]
                if any(opened[x] for x in closed):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i] in bounds:
                            break
                        if stack[i] in closed:
                            pop(i)
            elif name in BLOCK and stack and stack[-1] == "p":
                pop(len(stack) - 1)
            if link and not ended_before_next(end):
                link = 0
            push(name)
    if at < len(page):
        parts.append(page[at:])
        linked += (len(page) - at) * (link > 0)
    flush()
    return nodes, paths


def text_nodes(page: str) -> list[tuple[str, str, bool]]:
    """(path, text, in a link) of the blocks of text in order; inline tags don't part a text and aren't in its path."""
    nodes, paths = _nodes(page)

    def spelled(n: int) -> str:
        out = []
        while n:
            n, name = paths[n]
            out.append(name)
        return "/".join(reversed(out))

    return [(spelled(n), text, link) for n, text, link in nodes]


def smooth(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing; at the ends the kernel's remaining weights are scaled to one."""
    radius = math.ceil(3 * sigma)
    if not radius or len(values) < 2:
        return list(values)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - radius), min(len(values), i + radius + 1)
        weights = kernel[low - i + radius : high - i + radius]
        out.append(sum(w * v for w, v in zip(weights, values[low:high])) / sum(weights))
    return out


def extract(page: str | None, p: Params = Params()) -> tuple[str, int, int, float]:
    """(content, content nodes, nodes, threshold)."""
    nodes = _nodes(page)[0] if page else []
    if not nodes:
        return "", 0, 0, 0.0
    paths: dict[int, list[float]] = {}
    for path, text, link in nodes:
        sums = paths.setdefault(path, [0, 0, 0])
        sums[0] += 1
        if not link:
            sums[1] += len(text)
            sums[2] += len(PUNCTUATION.findall(text))
    lengths = smooth([paths[n[0]][1] / paths[n[0]][0] for n in nodes], p.sigma)
    signs = smooth([paths[n[0]][2] / paths[n[0]][0] for n in nodes], p.sigma)
    fused = [math.log1p(a) * math.log1p(b) for a, b in zip(lengths, signs)]
    mean = sum(fused) / len(fused)
    limit = p.threshold * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    kept = [n[1] for n, x in zip(nodes, fused) if x >= limit and paths[n[0]][1] and not n[2]]
    return "\n".join(kept), len(kept), len(nodes), limit


def content(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """(page_id, content, content_nodes, nodes, threshold) of each row."""
    bound_batches(pages.sparkSession)
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64()]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [extract(page, p) for page in batch.column(1).to_pylist()]
            return pa.record_batch([batch.column(0), *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], ["page_id", "content", "content_nodes", "nodes", "threshold"])

        return step

    return map_batches(pages.select(F.col("page_id").cast("bigint"), F.col("html").cast("string")), make, "page_id bigint, content string, content_nodes int, nodes int, threshold double")
