"""Secret scans through nested encodings.

A worklist starts with the text itself. Each layer is scanned for secrets and searched for encoded parts: URL and Unicode
escapes are decoded in place over the whole layer, base64 tokens and compressed byte runs become layers of their own.
Every new layer joins the worklist until none is left. A layer equal to one of its ancestors is a cycle and isn't followed;
the same decoding of the same source characters is done once. Each layer maps its characters to its parent's, so a
finding in any layer has a span in the source text.

Work is linear in the text and what it decodes to. Escapes are decoded layer by layer twice; what is still escaped after
that is decoded to its fixpoint at once (step ``escapes``), so n-fold escapes don't make n layers. A decompressed layer of
more than ``piece`` bytes is decompressed as a stream and scanned in pieces that share ``overlap`` bytes; a single secret or
encoded part of more than ``overlap`` bytes across a border of pieces is seen in its parts only.

Encoded runs that are too short to hold any finding aren't decoded: no rule matches fewer than ``LEAST`` characters.

Defined results: null and empty texts have no findings; texts are scanned whole; spans are [start, end) in characters; of
the same span and kind the least deep finding is given; repeated rows have repeated findings; a null doc_id is carried
along; doc_id must be of a type that casts to bigint; redaction leaves null texts and texts without findings as they are, and
joins overlapping spans; empty tables give empty results; other columns are not looked at, and ``redact`` keeps them.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import io
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from .textkit import map_batches


@dataclass(frozen=True)
class Params:
    min_printable: float = 0.9
    piece: int = 64 << 20  # bytes of a decompressed layer that are scanned at a time
    overlap: int = 4 << 20


#: (kind, literals of which a text must hold one, lower-case, pattern); the group ``s`` is the secret where there is one.
RULES = [
    ("aws_access_key", ("akia", "asia"), r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})"),
    ("slack_token", ("xox",), r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"),
    ("google_api_key", ("aiza",), r"\bAIza[0-9A-Za-z_-]{35}"),
    ("stripe_key", ("k_live_", "k_test_"), r"\b[srp]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    ("private_key", ("-----begin ",), r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"),
    ("json_web_token", ("eyj",), r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}"),
    ("url_password", ("://",), r"(?<=[a-zA-Z0-9+.-])://[^\s:/@]+:(?P<s>[^\s:/@]{6,})@"),
    ("assigned_secret", ("key", "secret", "token", "passw", "pwd", "credential"), r"(?i)(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|(?:auth|access|refresh)?[_-]?token|passw(?:or)?d|pwd|credentials?)[\"']?\s*(?::=|=>|[:=])\s*[\"']?(?P<s>[A-Za-z0-9+/_.~-]{12,}={0,2})"),
]
COMPILED = [(kind, literals, re.compile(pattern)) for kind, literals, pattern in RULES]
KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
TOKEN_START = re.compile(r"(?<![A-Za-z0-9_])eyJ(?=[A-Za-z0-9_-]{8})")
#: No rule matches fewer characters (``s://u:secret@``, with the sign before it), in any layer. Nothing that compresses is shorter.
LEAST = 13
LEAST_BASE64, LEAST_PERCENT = -(-LEAST * 4 // 3), 3 * LEAST
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})")
#: The same, and URL escapes, at the end of a text.
ENDING = re.compile(r"(?:%(?P<p>[0-9A-Fa-f]{2})|\\u(?P<u>[0-9A-Fa-f]{4})|\\u\{(?P<b>[0-9A-Fa-f]{1,6})\}|\\U(?P<l>[0-9A-Fa-f]{8})|\\x(?P<x>[0-9A-Fa-f]{2}))\Z")
MAGIC = ((b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"\x78\x01", "zlib"), (b"\x78\x5e", "zlib"), (b"\x78\x9c", "zlib"), (b"\x78\xda", "zlib"))


class Layer:
    """A decoded text. pieces: (start, source start, source end, plain), sorted; plain pieces map character by character."""

    __slots__ = ("text", "parent", "path", "starts", "pieces", "digest")

    def __init__(self, text: str, parent: Layer | None, step: str, pieces: list[tuple[int, int, int, bool]]):
        self.text, self.parent, self.pieces = text, parent, pieces
        self.path = () if parent is None else (*parent.path, step)
        self.starts = [p[0] for p in pieces]
        self.digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def to_source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the root's characters that [start, end) was made of."""
        layer = self
        while layer.parent is not None:
            first = layer.pieces[bisect_right(layer.starts, start) - 1]
            last = layer.pieces[bisect_right(layer.starts, max(start, end - 1)) - 1]
            start, end = (first[1] + start - first[0] if first[3] else first[1]), (last[1] + end - last[0] if last[3] else last[2])
            layer = layer.parent
        return start, end

    def cyclic(self) -> bool:
        above = self.parent
        while above is not None:
            if above.digest == self.digest:
                return True
            above = above.parent
        return False


def kind_of(data: bytes) -> str | None:
    return next((kind for magic, kind in MAGIC if data.startswith(magic)), None)


class _Source(io.RawIOBase):
    """A file over an iterator of bytes."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.rest = chunks, b""

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        while not self.rest:
            if (more := next(self.chunks, None)) is None:
                return b""
            self.rest = more
        out, self.rest = (self.rest, b"") if size < 0 else (self.rest[:size], self.rest[size:])
        return out

    def readinto(self, into) -> int:
        data = self.read(len(into))
        into[: len(data)] = data
        return len(data)


def unpacked(chunks: Iterator[bytes], kind: str, size: int = 1 << 20) -> Iterator[bytes]:
    """What compressed bytes hold, all members of it, in chunks of at most ``size``; as far as it can be read."""
    try:
        if kind == "zstd":
            import zstandard

            reader = zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(_Source(chunks), read_across_frames=True)
            while data := reader.read(size):
                yield data
            return
        source, rest = _Source(chunks), b""
        while True:
            engine = zlib.decompressobj(47) if kind in ("gzip", "zlib") else bz2.BZ2Decompressor() if kind == "bzip2" else lzma.LZMADecompressor(memlimit=256 << 20)
            while not rest.lstrip(b"\0"):
                if not (rest := source.read(size)):
                    return
            rest = rest.lstrip(b"\0")
            while not engine.eof:
                if not rest and getattr(engine, "needs_input", True) and not (rest := source.read(size)):
                    return
                data = engine.decompress(rest, size)
                rest = getattr(engine, "unconsumed_tail", b"")
                if data:
                    yield data
            rest = engine.unused_data
    except Exception as error:  # each library has its own error for bytes that only look compressed
        if isinstance(error, MemoryError):
            raise


def decompressed(data: bytes, most: int) -> tuple[bytes | Callable[[], Iterator[bytes]] | None, list[str]]:
    """(content, methods) of data that is compressed, however often: bytes, or a function that streams more than ``most``
    bytes; None where it isn't compressed. A content that was met before, as of data that hold themselves, ends the chain."""
    seen, methods, content = {hashlib.sha256(data).digest()}, [], data
    stream: Callable[[], Iterator[bytes]] = lambda: iter([data])
    head = data[:8]
    while (kind := kind_of(head)) is not None:

        def inner(outer=stream, kind=kind) -> Iterator[bytes]:
            return unpacked(outer(), kind)

        digest, size, kept = hashlib.sha256(), 0, []
        for chunk in inner():
            digest.update(chunk)
            size += len(chunk)
            if size <= most:
                kept.append(chunk)
            elif len(kept) > 1:
                kept = [b"".join(kept)[:8]]
        if not size or digest.digest() in seen:
            break
        seen.add(digest.digest())
        methods.append(kind)
        head = b"".join(kept)[:8]
        if size <= most:
            content = b"".join(kept)
            stream = lambda content=content: iter([content])
        else:
            content = stream = inner
    return (content if methods else None), methods


def pieces_of(content: bytes | Callable[[], Iterator[bytes]], p: Params) -> Iterator[bytes]:
    """The whole of ``content``, in pieces that share ``overlap`` bytes where it is streamed."""
    if isinstance(content, bytes):
        yield content
        return
    held, fresh = bytearray(), 0
    for chunk in content():
        held += chunk
        fresh += len(chunk)
        if len(held) >= p.piece:
            yield bytes(held)
            held, fresh = held[-p.overlap :], 0
    if fresh:
        yield bytes(held)


def printable(data: bytes, least: float) -> str | None:
    """The text of bytes that are text."""
    for encoding in ("utf-8", "utf-16") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8",):
        try:
            text = data.decode(encoding)
        except UnicodeDecodeError:
            continue
        if text and sum(c.isprintable() or c in "\n\r\t" for c in text) >= least * len(text):
            return text
    return None


def _in_place(layer: Layer, step: str, runs: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer | None:
    """The layer with each run [start, end) replaced by its (characters, source start, source end)."""
    out, pieces, at, length = [], [], 0, 0
    for start, end, decoded in runs:
        if start > at:
            pieces.append((length, at, start, True))
            out.append(layer.text[at:start])
            length += start - at
        for piece, source, stop in decoded:
            pieces.append((length, source, stop, False))
            out.append(piece)
            length += len(piece)
        at = end
    if not out:
        return None
    if at < len(layer.text):
        pieces.append((length, at, len(layer.text), True))
        out.append(layer.text[at:])
    return Layer("".join(out), layer, step, pieces)


def url_layer(layer: Layer) -> Layer | None:
    """Percent escapes that are UTF-8 decoded in place; others stay."""
    runs = []
    for m in PERCENT.finditer(layer.text):
        data, at, decoded, changed = bytes.fromhex(m[0].replace("%", "")), 0, [], False
        while at < len(data):
            width = 1 if data[at] < 0x80 else 2 if data[at] >> 5 == 6 else 3 if data[at] >> 4 == 14 else 4 if data[at] >> 3 == 30 else 0
            source = m.start() + 3 * at
            try:
                piece = data[at : at + width].decode() if width else ""
            except UnicodeDecodeError:
                piece = ""
            if piece:
                changed = True
                decoded.append((piece, source, source + 3 * width))
                at += width
            else:
                decoded.append((layer.text[source : source + 3], source, source + 3))
                at += 1
        if changed:
            runs.append((m.start(), m.end(), decoded))
    return _in_place(layer, "url", runs) if runs else None


def unicode_layer(layer: Layer) -> Layer | None:
    """\\uXXXX (with surrogate pairs), \\u{X}, \\UXXXXXXXX and \\xXX decoded in place."""
    found = [(m.start(), m.end(), int(m[0][2:].strip("{}"), 16)) for m in ESCAPE.finditer(layer.text)]
    runs, i = [], 0
    while i < len(found):
        start, end, code = found[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(found) and found[i + 1][0] == end and 0xDC00 <= found[i + 1][2] < 0xE000:
            i, end, code = i + 1, found[i + 1][1], 0x10000 + ((code - 0xD800) << 10) + found[i + 1][2] - 0xDC00
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            runs.append((start, end, [(chr(code), start, end)]))
        i += 1
    return _in_place(layer, "unicode", runs) if runs else None


def escapes_layer(layer: Layer) -> Layer | None:
    """All URL and Unicode escapes, of escapes too, decoded to their fixpoint in one pass."""
    out: list[tuple[str | int, int, int, bool]] = []  # a character, or the value of a byte that may be part of one; its span; changed

    def tail(n: int) -> str:
        return "".join(x[0] if isinstance(x[0], str) else "\0" for x in out[-n:])

    def settle() -> None:
        """Decode what the last item completes."""
        while out:
            last = out[-1][0]
            if isinstance(last, int):
                for width in (2, 3, 4):
                    run = out[-width:]
                    if len(run) == width and all(isinstance(x[0], int) for x in run):
                        try:
                            made = bytes(x[0] for x in run).decode()
                        except UnicodeDecodeError:
                            continue
                        if len(made) == 1:
                            out[-width:] = [(made, run[0][1], run[-1][2], True)]
                            break
                return
            if 0xDC00 <= ord(last) < 0xE000 and len(out) > 1 and isinstance(out[-2][0], str) and 0xD800 <= ord(out[-2][0]) < 0xDC00:
                made = chr(0x10000 + ((ord(out[-2][0]) - 0xD800) << 10) + ord(last) - 0xDC00)
                out[-2:] = [(made, out[-2][1], out[-1][2], True)]
                return
            if last not in "0123456789abcdefABCDEF}":
                return
            m = ENDING.search(tail(12))
            if m is None:
                return
            code, width = int(m["p"] or m["u"] or m["b"] or m["l"] or m["x"], 16), m.end() - m.start()
            if code >= 0x110000 or m["p"] is None and m["l"] is not None and 0xD800 <= code < 0xE000:
                return
            out[-width:] = [(code if m["p"] and code >= 0x80 else chr(code), out[-width][1], out[-1][2], True)]

    for i, c in enumerate(layer.text):
        out.append((c, i, i + 1, False))
        settle()
    if not any(x[3] for x in out):
        return None
    text, pieces, length = [], [], 0
    for item, start, end, changed in out:
        if isinstance(item, int) or 0xD800 <= ord(item) < 0xE000:
            item, changed = layer.text[start:end], False
        if changed or not pieces or not pieces[-1][3] or pieces[-1][2] != start:
            pieces.append((length, start, end, not changed))
        else:
            pieces[-1] = (pieces[-1][0], pieces[-1][1], end, True)
        text.append(item)
        length += len(item)
    made = "".join(text)
    return Layer(made, layer, "escapes", pieces) if made != layer.text else None


class Scanner:
    def __init__(self, p: Params = Params()):
        self.p = p
        sign, n = "[A-Za-z0-9+/_-]", LEAST_BASE64
        self.base64 = re.compile(rf"(?<!{sign}){sign}{{{n},}}={{0,2}}")
        self.narrow = re.compile(rf"(?:[A-Za-z0-9+/]{{{n},}}|[A-Za-z0-9_-]{{{n},}})={{0,2}}")
        self.line = re.compile(rf"\r?\n[ \t]*({sign}+={{0,2}})(?!{sign})")

    def rules(self, text: str):
        low = text.lower()
        for kind, literals, pattern in COMPILED:
            if not any(x in low for x in literals):
                continue
            if kind == "private_key":
                ends = [m.end() for m in KEY_END.finditer(text)]
            for m in pattern.finditer(text):
                name = "s" if "s" in pattern.groupindex else 0
                start, end = m.span(name)
                if kind == "private_key" and (at := bisect_right(ends, end)) < len(ends):
                    end = ends[at]
                elif kind == "json_web_token":
                    yield from self._tokens(m[0], start)
                    continue
                value = text[start:end]
                if kind == "assigned_secret" and not (any(map(str.isdigit, value)) and len(set(value)) >= 6):
                    continue
                yield kind, start, end, value

    @staticmethod
    def _tokens(dotted: str, start: int):
        """Web tokens in parts joined by dots: two that begin with eyJ, and a third."""
        parts, at, i = dotted.split("."), [0], 0
        for x in parts:
            at.append(at[-1] + len(x) + 1)
        while i + 2 < len(parts):
            a, b, c = parts[i : i + 3]
            if b.startswith("eyJ") and len(b) >= 11 and len(c) >= 8 and (first := TOKEN_START.search(a)):
                begin, end = at[i] + first.start(), at[i + 3] - 1
                yield "json_web_token", start + begin, start + end, dotted[begin:end]
                i += 3
            else:
                i += 1

    def _of_bytes(self, data: bytes, layer: Layer, step: str, start: int, end: int, whole_only: bool, parts: list[tuple[int, int]] | None = None):
        """The layers of decoded bytes, if they are text or compress a text, however often; a span inside base64 text maps to
        its signs. What was compressed is a text in any case: bytes that aren't UTF-8 are read as Latin-1."""
        content, methods = decompressed(data, self.p.piece)
        if content is not None:
            step = "+".join([step, *methods])
            for piece in pieces_of(content, self.p):
                yield Layer(printable(piece, 0) or piece.decode("latin-1"), layer, step, [(0, start, end, False)])
            return
        if whole_only:
            return
        text = printable(data, self.p.min_printable)
        wide = data[:2] in (b"\xff\xfe", b"\xfe\xff")
        single = text is None
        if single:
            text = data.decode("latin-1")
            if sum(c.isprintable() or c in "\n\r\t" for c in text) < self.p.min_printable * len(text):
                return
        if wide and not single:
            yield Layer(text, layer, step, [(0, start, end, False)])
            return
        parts = parts or [(start, end)]
        firsts = [0]
        for a, b in parts:
            firsts.append(firsts[-1] + b - a)

        def source(sign: int) -> int:
            k = min(bisect_right(firsts, sign) - 1, len(parts) - 1)
            return parts[k][0] + sign - firsts[k]

        pieces, at = [], 0
        for i, c in enumerate(text):
            width = 1 if single else len(c.encode())
            pieces.append((i, source(at * 4 // 3), min(end, source(-(-(at + width) * 4 // 3) - 1) + 1), False))
            at += width
        yield Layer(text, layer, step, pieces)

    def children(self, layer: Layer):
        text = layer.text
        if "%" in text or "\\" in text:
            if sum(x in ("url", "unicode", "escapes") for x in layer.path[-2:]) == 2:
                yield escapes_layer(layer)
            else:
                yield url_layer(layer) if "%" in text else None
                yield unicode_layer(layer) if "\\" in text else None
        if "%" in text:
            for m in PERCENT.finditer(text):
                if m.end() - m.start() >= LEAST_PERCENT:
                    yield from self._of_bytes(bytes.fromhex(m[0].replace("%", "")), layer, "url", m.start(), m.end(), True)
        read = 0
        for m in self.base64.finditer(text):
            parts = self._lines(text, m) if m.start() >= read else []
            if len(parts) > 1:
                read = parts[-1][1]
                for first, last in self._blocks(text, parts):
                    yield from self._decoded(layer, parts[first:last])
            yield from self._decoded(layer, [m.span()])
            one = self.narrow.match(text, m.start())  # a token of one alphabet with a sign of the other behind it
            if one and one.end() != m.end():
                yield from self._decoded(layer, [one.span()])

    def _lines(self, text: str, m: re.Match) -> list[tuple[int, int]]:
        """Spans of the lines of a wrapped token: as long as the first, the last one as long at most."""
        parts, width = [m.span()], m.end() - m.start()
        while parts[-1][1] - parts[-1][0] == width and text[parts[-1][1] - 1] != "=" and (more := self.line.match(text, parts[-1][1])) and more.end(1) - more.start(1) <= width:
            parts.append(more.span(1))
        return parts

    def _blocks(self, text: str, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Which lines of a wrapped token may be decoded together: all; from one on that begins as compressed data do; and
        the longest runs of several that each decode to text."""
        out, run = [(0, len(parts))], None
        if (parts[0][1] - parts[0][0]) % 4:
            return out
        for i, (a, b) in enumerate([*parts, (0, 0)]):
            data = self._bytes(text[a:b]) or b""
            if i and kind_of(data):
                out.append((i, len(parts)))
            is_text = bool(data) and sum(32 <= c < 127 or c in b"\n\r\t" or c >= 0xA0 for c in data) >= self.p.min_printable * len(data)
            if is_text and run is None:
                run = i
            elif not is_text and run is not None:
                if i - run > 1 and (run, i) != out[0]:
                    out.append((run, i))
                run = None
        return out

    @staticmethod
    def _bytes(joined: str) -> bytes | None:
        joined = joined.rstrip("=").replace("-", "+").replace("_", "/")
        if len(joined) % 4 == 1:
            joined = joined[:-1]
        try:
            return base64.b64decode(joined + "=" * (-len(joined) % 4), validate=True)
        except (binascii.Error, ValueError):
            return None

    def _decoded(self, layer: Layer, parts: list[tuple[int, int]]):
        data = self._bytes("".join(layer.text[a:b] for a, b in parts))
        if data is not None:
            yield from self._of_bytes(data, layer, "base64", parts[0][0], parts[-1][1], False, parts)

    def __call__(self, text: str | None) -> list[tuple[str, int, int, int, str, str]]:
        """(kind, start, end, depth, path, digest of the secret), in order of start."""
        if not text:
            return []
        best: dict[tuple, tuple] = {}
        work, done = deque([Layer(text, None, "", [])]), set()
        while work:
            layer = work.popleft()
            for kind, start, end, value in self.rules(layer.text):
                key = (*layer.to_source(start, end), kind)
                best.setdefault(key, (len(layer.path), ">".join(layer.path), hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()))
            for child in self.children(layer):
                if child is None or child.cyclic():
                    continue
                key = (child.digest, child.to_source(0, len(child.text)))
                if key not in done:
                    done.add(key)
                    work.append(child)
        return [(kind, start, end, *rest) for (start, end, kind), rest in sorted(best.items())]


def redacted(text: str, found: list[tuple]) -> str:
    """``text`` with each span of findings, joined where they overlap, replaced by ``[SECRET]``."""
    out, at, spans = [], 0, []
    for _, start, end, *_ in found:
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    for start, end in spans:
        out += [text[at:start], "[SECRET]"]
        at = end
    return "".join([*out, text[at:]])


FINDINGS = "doc_id bigint, kind string, start int, end int, depth int, path string, digest string"


def scan(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """A row for each finding: kind, source span, how many decodings deep, which, and the SHA-256 of the secret."""
    bound_batches(docs.sparkSession)
    names = ["doc_id", "kind", "start", "end", "depth", "path", "digest"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def make():
        scanner = Scanner(p)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(doc, *found) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for found in scanner(text)]
            return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

        return step

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), make, FINDINGS)


def redact(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with secrets replaced in text; n_chars, where there is such a column, follows. All rows and columns stay."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def make():
        scanner = Scanner(p)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            changed = {i: redacted(t, found) for i, t in enumerate(texts) if (found := scanner(t))}
            if not changed:
                return batch
            columns = list(batch.columns)
            columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns[at].type)
            if length is not None:
                columns[length] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns[length].to_pylist())], columns[length].type)
            return pa.record_batch(columns, batch.schema.names)

        return step

    return map_batches(docs, make, docs.schema)
