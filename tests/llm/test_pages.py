"""WARC files, sharding and HTML extraction."""

import os
import random

import pytest

from strataspark.llm import html_paths, ring, warc

from . import edge

SF = "/root/testdata/sf0.01"


def pages(spark):
    rows = [(0, "http://a.example/x", "<p>Hello, world.</p>" * 50), (1, None, None), (None, "u\r\nX: y", ""), (3, "", "<b>é</b>"), (4, "http://b", "<p>" + "long text, " * 100_000 + "</p>")]
    return spark.createDataFrame([(*r, 0, b"") for r in [*rows, rows[0]]], "page_id bigint, url string, html string, shard int, frame binary")


def files(df):
    out: dict = {}
    for r in df.orderBy("shard", "position").collect():
        out.setdefault(r.shard, []).append(r)
    return out


def whole(rows):
    assert [r.position for r in rows] == list(range(len(rows))) and rows[0].page_id is None
    at = 0
    for r in rows:
        assert r.offset == at and r.length == len(r.frame)
        at += r.length
    return b"".join(bytes(r.frame) for r in rows)


@pytest.mark.parametrize("size", [1, 10_000, 64 << 20])
def test_round_trip(spark, size):
    p = warc.Params(shard_bytes=size)
    df = pages(spark)
    wanted = sorted(warc.record(r.page_id, r.url, r.html, p.date) for r in df.collect())
    got = [rec for rows in files(warc.frames(df, p)).values() for rec in warc.read(whole(rows))]
    assert sorted(got) == wanted
    assert warc.frames(edge.none(df)).count() == 0


def test_any_record_alone(spark):
    import zstandard

    rows = next(iter(files(warc.frames(pages(spark).coalesce(1))).values()))
    data = whole(rows)
    raw, first = warc.read_dictionary(data)
    assert first == rows[0].length and int.from_bytes(data[:4], "little") == 0x184D2A5D
    engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    for r in rows[1:]:
        record = engine.decompress(data[r.offset : r.offset + r.length])
        assert len(record) == r.record_bytes and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        head, _, rest = record.partition(b"\r\n\r\n")
        assert int(head.rpartition(b"Content-Length: ")[2]) == len(rest) - 4
        assert b"\r\nX: y" not in head


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_files_and_gain(spark, tmp_path):
    import zstandard

    df = spark.read.parquet(f"{SF}/pages.parquet")
    made = warc.write(df, str(tmp_path / "out")).collect()
    records = []
    for r in made:
        data = (tmp_path / "out" / f"{r.shard}.warc.zst").read_bytes()
        assert len(data) == r.bytes
        found = warc.read(data)
        assert len(found) == r.records
        records += found
    assert len(records) == df.count() and not [x for x in os.listdir(tmp_path / "out") if x.startswith(".")]
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert sum(r.bytes for r in made) < 0.8 * plain


def brute(keys, p):
    """One key after another in ring order, to the first node clockwise whose shard has room."""
    nodes, room = ring.node_slots(p), [ring.capacity(len(keys), p)] * p.shards
    out = []
    for slot, _ in sorted(keys):
        at = next((i for i, (s, _) in enumerate(nodes) if s >= slot), 0)
        while room[nodes[at][1]] == 0:
            at = (at + 1) % len(nodes)
        room[nodes[at][1]] -= 1
        out.append((slot, nodes[at][1]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ring_against_brute_force(seed):
    r = random.Random(seed)
    p = ring.Params(shards=r.randint(1, 9), virtual_nodes=r.randint(1, 6), slack=r.choice([0, 0.1, 0.5]), ring_bits=8)
    keys = [(r.randint(0, 255) if seed % 2 else min(255, int(r.expovariate(0.05))), i) for i in range(r.randint(1, 900))]
    counts: dict = {}
    for slot, _ in keys:
        counts[slot] = counts.get(slot, 0) + 1
    got = [(slot, part[2]) for slot, parts in sorted(ring.place(counts, p).items()) for part in parts for _ in range(part[1] - part[0] + 1)]
    assert got == brute(keys, p)


def test_ring_rows(spark):
    p = ring.Params(shards=7, virtual_nodes=5, slack=0.02, ring_bits=6)
    docs = spark.range(3000).selectExpr("id AS doc_id", "1 AS slot", "1 AS shard", "1 AS h", "1 AS home")
    rows = ring.assign(docs, p).collect()
    loads: dict = {}
    for r in rows:
        loads[r.shard] = loads.get(r.shard, 0) + 1
        assert (r.home == r.shard) or r.hops > 0
    assert sorted(r.doc_id for r in rows) == list(range(3000)) and max(loads.values()) <= ring.capacity(3000, p)
    again = {r.doc_id: r.shard for r in ring.assign(docs.repartition(5), p).collect()}
    assert again == {r.doc_id: r.shard for r in rows}
    wide = ring.Params(shards=8, virtual_nodes=64, slack=0.3)
    more = ring.Params(shards=9, virtual_nodes=64, slack=0.3)
    a, b = ({r.doc_id: r.shard for r in ring.assign(docs, x).collect()} for x in (wide, more))
    assert sum(a[i] != b[i] for i in a) < 0.3 * len(a), "a new shard moves about a ninth of the keys"


def test_ring_edges(spark):
    docs = edge.documents(spark)
    assert ring.assign(docs).count() == docs.count() and ring.assign(edge.none(docs)).count() == 0
    same = spark.createDataFrame([(5,)] * 100, "doc_id bigint")
    p = ring.Params(shards=4, virtual_nodes=8, slack=0.0, ring_bits=6)
    assert sorted(r["count"] for r in ring.assign(same, p).groupBy("shard").count().collect()) == [25] * 4


PAGE = "<html><head><title>no</title></head><body><nav><ul><li><a href='/'>Home, here</a></li><li><a href='/b'>Away, there</a></li></ul></nav><script>var t='</p>';</script><!-- x --><article><p>First, a <b>long</b> sentence of the text; with signs, and more.<p>Second, an equally long sentence of it; with signs, and more.</article><footer><p>fine</p><div>print</div><div>of</div><div>no</div><div>weight</div></footer></body></html>"


def test_paths():
    nodes = html_paths.text_nodes(PAGE)
    assert [n[0] for n in nodes] == ["html/body/nav/ul/li"] * 2 + ["html/body/article/p"] * 2 + ["html/body/footer/p"] + ["html/body/footer/div"] * 4
    assert [n[2] for n in nodes] == [True, True] + [False] * 7
    text, kept, total, limit = html_paths.extract(PAGE)
    lines = text.split("\n")
    assert lines[:2] == ["First, a long sentence of the text; with signs, and more.", "Second, an equally long sentence of it; with signs, and more."]
    assert total == 9 and kept == len(lines) and limit > 0 and not {"Home, here", "no", "weight"} & set(lines), "smoothing may keep the node beside the text"
    assert html_paths.smooth([1.0, 1.0, 1.0], 1.0) == pytest.approx([1, 1, 1])
    for bad in ("", None, "<", "<p", "<!-- open", "<script>open", "</p></p>", "<p>" * 5000):
        assert html_paths.extract(bad)[1] in (0, 1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_article_is_found(spark):
    import re
    from collections import Counter

    precision, recall = [], []
    df = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r.content for r in html_paths.content(df).collect()}
    for r in df.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)
        if body:
            wanted = Counter(html_paths.entities.unescape(re.sub("<[^>]+>", " ", body[1])).split())
            got = Counter(found[r.page_id].split())
            both = sum((wanted & got).values())
            precision.append(both / max(1, sum(got.values())))
            recall.append(both / sum(wanted.values()))
    assert sum(precision) / len(precision) > 0.88 and sum(recall) / len(recall) > 0.97


def test_html_edges(spark):
    df = pages(spark)
    rows = html_paths.content(df).collect()
    assert len(rows) == df.count() and sum(r.content == "" for r in rows) >= 2 and html_paths.content(edge.none(df)).count() == 0
