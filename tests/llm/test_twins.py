"""Whole queries over the test tables against naive versions: personal data, WARC files, tag paths. And linear work."""

import hashlib
import math
import os
import re
import struct
import time
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from strataspark.llm import html_paths, pii, warc
from strataspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# --- personal data: a character at a time, with the source span of each, and patterns by their definition

LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
AT = r"[ \t]*(?:[\[({<][ \t]*(?:at|@|arroba|ät|chez)[ \t]*[\])}>])[ \t]*"
DOT = r"[ \t]*(?:[\[({<][ \t]*(?:dot|punkt|point|punto|\.)[ \t]*[\])}>])[ \t]*"
WORD_AT, WORD_DOT = r"[ \t]+(?:at|arroba)[ \t]+", r"[ \t]+(?:dot|punkt|point|punto)[ \t]+"
ANY = rf"(?:{DOT}|{WORD_DOT}|\.)"
DISGUISED = re.compile(rf"(?<![\w.@])[A-Za-z0-9_%+-]+(?:{ANY}[A-Za-z0-9_%+-]+)*?(?:(?:{AT}|[ \t]*@[ \t]*){LABEL}|{WORD_AT}{LABEL}(?:\.{LABEL})*(?:{DOT}|{WORD_DOT}){LABEL})(?:{ANY}{LABEL})*", re.IGNORECASE)
SIGN = re.compile(rf"(?P<at>{AT}|{WORD_AT}|[ \t]*@[ \t]*)|(?P<dot>{DOT}|{WORD_DOT})", re.IGNORECASE)
EMAIL = re.compile(rf"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:{LABEL}\.)+[A-Za-z]{{2,24}}(?![A-Za-z0-9-])")


def replaced(chars, edits):
    """chars: (character, source start, source end); each [start, end) of the edits becomes characters of the edit's span."""
    for start, end, new in sorted(edits, reverse=True):
        chars[start:end] = [(c, chars[start][1], chars[end - 1][2]) for c in new]
    return chars


def naive_pii(text):
    chars = [(pii.LOOK_ALIKES.get(c, c), i, i + 1) for i, c in enumerate(text) if c not in pii.INVISIBLE]
    edits, spelled = [], False
    low = lambda: "".join(c for c, *_ in chars)
    for run in pii.SPELLED.finditer(low()):
        tokens = list(pii.DIGIT_TOKEN.finditer(run.string, run.start(), run.end()))
        if sum(len(t[0]) > 1 for t in tokens) >= 3 and len({pii.DIGIT_WORDS.get(t[0].lower(), t[0]) for t in tokens}) > 1:
            spelled = True
            edits += [(t.start(), t.end(), pii.DIGIT_WORDS.get(t[0].lower(), t[0])) for t in tokens]
            edits += [(a.end(), b.start(), "") for a, b in zip(tokens, tokens[1:]) if a.end() < b.start()]
    chars = replaced(chars, edits)
    edits = []
    for m in DISGUISED.finditer(low()):
        edits += [(s.start(), s.end(), "@" if s["at"] else ".") for s in SIGN.finditer(m.string, m.start(), m.end()) if s[0] not in "@."]
    chars = replaced(chars, edits)
    last, found = low(), []
    for line in re.finditer("[^\n]+", last):
        found += [("email", m.start(), m.end(), m[0].lower()) for m in EMAIL.finditer(last, *line.span())]
        found += [x for x in pii.detect(last) if x[0] != "email" and line.start() <= x[1] < line.end()]
    if spelled:
        for m in pii.BARE_PHONE.finditer(last):
            if sum(map(str.isalpha, text[chars[m.start()][1] : chars[m.end() - 1][2]])) >= 3:
                found.append(("phone", m.start(), m.end(), m[0]))
    out = []
    for kind, start, end, value in sorted(found, key=lambda x: (pii.KINDS.index(x[0]), x[1])):
        a, b = chars[start][1], chars[end - 1][2]
        if all(b <= x[1] or x[2] <= a for x in out):
            out.append((kind, a, b, value))
    return sorted(out)


@tables
def test_personal_data(spark):
    wanted = sorted((r.doc_id, *x) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() for x in naive_pii(r.text))
    got = sorted((r.doc_id, r.kind, r.start, r.end, r.value) for r in QUERIES["op1_pii"](spark, SF).collect())
    assert got == wanted and len({x[1] for x in wanted}) > 1


@pytest.mark.parametrize("text", ["john [at] example [dot] com, and mail anna dot maria at web punkt de", "a.b@c.org@d.org x@y.de..z@w.com", "é.john [at] x.com jane@ ex.org [dot] net", "x@b [dot] c at d dot ee", "a  @  b.com\nc (at) d.com", "one two three four five six seven at two dot com", ".a@b.com -a@b.com a..b@c.com"])
def test_personal_data_of_odd_texts(text):
    assert sorted(x[:4] for x in pii.find(text)) == naive_pii(text)


# --- WARC files: a reader that knows frames and header lines only


def naive_records(data):
    import zstandard

    magic, length = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    raw, at = zstandard.ZstdDecompressor().decompress(data[8 : 8 + length]), 8 + length
    while at < len(data):
        engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompressobj()
        record = engine.decompress(data[at:])
        at = len(data) - len(engine.unused_data)
        lines, payload, rest = [], b"", record
        while True:
            line, rest = rest.split(b"\r\n", 1)
            if not line:
                break
            lines.append(line)
        assert lines[0] == b"WARC/1.1"
        head = dict(x.split(b": ", 1) for x in lines[1:])
        size = int(head[b"Content-Length"])
        payload = rest[:size]
        assert rest[size:] == b"\r\n\r\n" and head[b"WARC-Payload-Digest"] == b"sha1:" + hashlib.sha1(payload).hexdigest().encode()
        yield int(head[b"X-Page-Id"]), head[b"WARC-Target-URI"].decode(), payload.decode()


@tables
def test_archive(spark):
    shards = defaultdict(list)
    for r in QUERIES["op2_warc"](spark, SF).collect():
        shards[r.shard].append((r.position, bytes(r.frame)))
    got = sorted(x for frames in shards.values() for x in naive_records(b"".join(f for _, f in sorted(frames))))
    assert got == sorted((r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect())


def test_dictionary_sees_whole_records():
    """What is common only to the ends of long records is in the dictionary."""
    import random

    import zstandard

    r = random.Random(1)
    tail = " ".join(str(r.random()) for _ in range(200)).encode()
    records = [r.randbytes(100_000) + tail for _ in range(60)]
    data = zstandard.ZstdCompressionDict(warc.dictionary(records, warc.Params()))
    one = zstandard.ZstdCompressor(level=3, dict_data=data).compress(tail)
    assert len(one) < 0.3 * len(zstandard.ZstdCompressor(level=3).compress(tail))


# --- tag paths: the table of paths by its definition, over another parser's events


class Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.nodes, self.parts, self.silent, self.link = [], [], [], None, False

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(t for t, _ in self.parts)).strip()
        if text:
            self.nodes.append(("/".join(self.stack), text, 2 * sum(len(t) for t, link in self.parts if link) > sum(len(t) for t, _ in self.parts)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if self.silent or tag == "head":
            return
        if tag in html_paths.RAW:
            self.silent = tag
        elif tag in html_paths.INLINE:
            if tag == "a":
                self.link = "href" in dict(attrs)
        elif tag == "br":
            self.parts.append(("\n", False))
        else:
            self.flush()
            if tag not in html_paths.VOID:
                if self.stack and self.stack[-1] == "p" and tag in html_paths.BLOCK:
                    self.stack.pop()
                self.stack.append(tag)

    def handle_endtag(self, tag):
        if self.silent:
            self.silent = None if tag == self.silent else self.silent
        elif tag == "a":
            self.link = False
        elif tag not in html_paths.INLINE and tag not in ("head", "br"):
            self.flush()
            if tag in self.stack:
                while self.stack.pop() != tag:
                    pass

    def handle_data(self, data):
        if not self.silent:
            self.parts.append((data, self.link))


def naive_content(page):
    parser = Blocks()
    parser.feed(page)
    parser.close()
    parser.flush()
    nodes = parser.nodes
    if not nodes:
        return "", 0, 0
    ratio = {}
    for path in {n[0] for n in nodes}:
        own = [n for n in nodes if n[0] == path]
        free = [n[1] for n in own if not n[2]]
        ratio[path] = (sum(map(len, free)) / len(own), sum(len(html_paths.PUNCTUATION.findall(t)) for t in free) / len(own))

    def smoothed(which, i):
        weights = {j: math.exp(-((i - j) ** 2) / 2) for j in range(len(nodes)) if abs(i - j) <= 3}
        return sum(w * ratio[nodes[j][0]][which] for j, w in weights.items()) / sum(weights.values())

    fused = [math.log1p(smoothed(0, i)) * math.log1p(smoothed(1, i)) for i in range(len(nodes))]
    mean = sum(fused) / len(fused)
    limit = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    kept = [n[1] for n, x in zip(nodes, fused) if x >= limit - 1e-12 and ratio[n[0]][0] and not n[2]]
    return "\n".join(kept), len(kept), len(nodes)


@tables
def test_tag_paths(spark):
    wanted = {r.page_id: naive_content(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: (r.content, r.content_nodes, r.nodes) for r in QUERIES["op9_html_paths"](spark, SF).collect()}
    assert {k for k in got if got[k] != wanted[k]} == set() and any(n for _, n, _ in wanted.values())


ARTICLE = "<p>First, a long sentence of the text; with signs, and more of it, to be sure.</p>" * 5


@pytest.mark.parametrize("page", [f'<body><a name="top"><div>nav</div>{ARTICLE}', f"<html><head><title>x</title><meta a=b>{ARTICLE}", f"<a href=x>{ARTICLE}", f"<div><a href=x>{'more '}</div>{ARTICLE}", f"<noscript>{ARTICLE}", f"<p title='>'>{ARTICLE}"])
def test_articles_behind_optional_tags(page):
    assert html_paths.extract(page)[0].count("First, a long sentence") == 5


@pytest.mark.parametrize("part", ['<a "', '<a x="', "<!--", "<svg>", "<a href=x>", "<div>t", "</x>", "<li><div>", "<script", "<p>a.", "<", "<a b=c "])
def test_pages_are_read_in_linear_time(part):
    began = time.time()
    html_paths.extract(part * (1_000_000 // len(part)))
    assert time.time() - began < 25  # takes 1 to 7 s; quadratic work takes hours


@pytest.mark.parametrize("part", ["a.1.", "a dot ", "one ", "a@", "[at]", " ", "( at ) ", "x at y dot z ", "1", "a [dot] ", "@ ", "a@b.co ", "x dot y at "])
def test_texts_are_read_in_linear_time(part):
    began = time.time()
    pii.find(part * (1_000_000 // len(part)))
    assert time.time() - began < 25
