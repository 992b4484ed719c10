"""Personal data, secrets, classifier, rules and BPE."""

import base64
import bz2
import gzip
import os
import urllib.parse
import zlib

import numpy as np
import pytest

from strataspark.llm import bpe, pii, quality_fm, rules, secrets
from strataspark.llm.queries import ORACLES

from . import edge

SF = "/root/testdata/sf0.01"
TOKEN = "ghp_" + "a1B2c3" * 6


def spans(text):
    return [(kind, text[a:b], value, odd) for kind, a, b, value, odd in pii.find(text)]


@pytest.mark.parametrize(
    "text, kind, source, value",
    [
        ("und.34@mail7.example.com go", "email", "und.34@mail7.example.com", "und.34@mail7.example.com"),
        ("to john [at] example [dot] com now", "email", "john [at] example [dot] com", "john@example.com"),
        ("j.d(at)m(dot)example(dot)org", "email", "j.d(at)m(dot)example(dot)org", "j.d@m.example.org"),
        ("x jоhn＠exаmple。com", "email", "jоhn＠exаmple。com", "john@example.com"),
        ("a​b@ex​ample.com!", "email", "a​b@ex​ample.com", "ab@example.com"),
        ("call five five five one two three four five six seven ok", "phone", "five five five one two three four five six seven", "5551234567"),
        ("+1 (017) 555-7713", "phone", "+1 (017) 555-7713", "+10175557713"),
        ("٥٥٥-٨٦٧-٥٣٠٩", "phone", "٥٥٥-٨٦٧-٥٣٠٩", "5558675309"),
        ("at 96.153.118.61, ok", "ipv4", "96.153.118.61", "96.153.118.61"),
        ("4111 1111 1111 1111", "card", "4111 1111 1111 1111", "4111111111111111"),
        ("GB82 WEST 1234 5698 7654 32", "iban", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"),
        ("is 078-05-1120", "us_ssn", "078-05-1120", "078-05-1120"),
    ],
)
def test_identifiers(text, kind, source, value):
    assert [x[:3] for x in spans(text)] == [(kind, source, value)]


def test_clean_prose_has_none():
    for text in ("meet me at noon. Dot the i at the end", "one two three of us, at example level", "4111 1111 1111 1112", "look at example.com", "999.1.1.1", "una una una una una una una una"):
        assert spans(text) == []


def test_transducers_map_back():
    m = pii.plain_digits(pii.plain_characters(pii.Mapped("ａ​b five-five five five 1 two three x")))
    at = m.text.index("5555123")
    a, b = m.to_source(at, at + 7)
    assert "ａ​b five-five five five 1 two three x"[a:b] == "five-five five five 1 two three"
    assert m.to_source(0, 2) == (0, 3)


def test_pii_edges(spark):
    docs = edge.documents(spark, [*edge.TEXTS, "a@example.com " * 3, edge.LONG + "z@example.com"])
    rows = pii.scan(docs).collect()
    assert sorted((r.doc_id, r.kind) for r in rows) == [(11, "email")] * 3 + [(12, "email")] * 2  # the last row is there twice
    assert max(r.end for r in rows) == len(edge.LONG) + 13 and pii.scan(edge.none(docs)).count() == 0


def encodings(secret):
    b64 = lambda x: base64.b64encode(x).decode()
    raw = secret.encode()
    yield "url", urllib.parse.quote(secret.replace("_", "%5F")).replace("%25", "%")
    yield "unicode", "".join(f"\\u{ord(c):04x}" for c in secret)
    yield "base64", b64(b"the key is " + raw)
    yield "base64+gzip", b64(gzip.compress(b"the key is " + raw, mtime=0))
    yield "base64+zlib", b64(zlib.compress(b"the key is " + raw))
    yield "base64+bzip2", b64(bz2.compress(b"the key is " + raw))
    yield "base64>base64", b64(b"in: " + b64(b"the key is " + raw).encode())
    yield "url>base64+gzip>base64", urllib.parse.quote(b64(gzip.compress(b"in: " + b64(b"the key is " + raw).encode(), mtime=0)).replace("A", "%41"), safe="%")


@pytest.mark.parametrize("path, text", list(encodings(TOKEN)))
def test_nested_secrets(path, text):
    scanner = secrets.Scanner()
    found = [f for f in scanner(f"ünder {text} end") if f[0] == "github_token"]
    assert [f[4] for f in found] == [path]
    _, start, end, depth, *_ = found[0]
    assert depth == path.count(">") + 1 and 6 <= start < end <= 6 + len(text)
    cleaned = secrets.redacted(f"ünder {text} end", scanner(f"ünder {text} end"))
    assert not [f for f in scanner(cleaned) if f[0] == "github_token"] and cleaned.startswith("ünder ") and cleaned.endswith(" end")


def test_base64_span_is_exact():
    text = base64.b64encode(b"xyz " + TOKEN.encode() + b" abcdefg").decode()
    ((_, a, b, *_),) = [f for f in secrets.Scanner()(text) if f[0] == "github_token"]
    assert (a, b) == (4 * 4 // 3, -(-(4 + len(TOKEN)) * 4 // 3))


def test_cycles_and_bombs_end():
    scanner = secrets.Scanner(secrets.Params(piece=1000, overlap=100))
    assert scanner(base64.b64encode(gzip.compress(b"a" * 5000)).decode()) == []
    assert scanner("%25" * 2000 + " \\u005cu005c " * 50) == []
    layer = secrets.Layer("x", None, "", [])
    assert secrets.Layer("x", layer, "url", [(0, 0, 1, True)]).cyclic() and not secrets.Layer("y", layer, "url", [(0, 0, 1, True)]).cyclic()


def test_secret_edges(spark):
    docs = edge.documents(spark, [*edge.TEXTS, f"a {TOKEN} b {TOKEN}", edge.LONG + TOKEN])
    rows = secrets.scan(docs).collect()
    assert sorted((r.doc_id, r.start) for r in rows) == [(11, 2), (11, 5 + len(TOKEN)), *[(12, len(edge.LONG))] * 2]  # the last row is there twice
    done = secrets.redact(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    by = {r.doc_id: r for r in done.collect()}
    assert by[11].text == "a [SECRET] b [SECRET]" and by[11].n_chars == 21 and by[5].text == edge.TEXTS[5] and by[0].text is None
    assert secrets.scan(edge.none(docs)).count() == 0 == secrets.redact(edge.none(docs)).count()


@pytest.mark.skipif(not os.path.isdir(SF.replace("0.01", "0.1")), reason="no test tables")
def test_classifier_held_out(spark):
    folder = SF.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    train, rest = labels.filter("hash(doc_id) % 2 = 0"), labels.filter("hash(doc_id) % 2 <> 0")
    scored = quality_fm.score(docs, train).withColumnRenamed("quality", "score").join(rest, "doc_id").toPandas()
    clean = scored[(scored["quality"] == 1) & (scored["toxic"] == 0)]
    assert clean["keep"].mean() > 0.98
    assert scored[scored["quality"] == 0]["keep"].mean() < 0.05
    # about a fifth of the toxic labels are on texts without any sign of it
    assert (~scored[scored["toxic"] == 1]["keep"]).mean() > 0.7


def test_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    rows = np.arange(20, dtype=np.int32)
    model = quality_fm.Model(rows, np.array([0.1, -0.2]), rng.normal(size=(20, 2)), rng.normal(size=(20, 2, 4)), (None, None), 3, 1.0)
    lists = [[1, 4, 9], [], [2, 3, 5, 7, 11]]
    got = model.scores(lists)
    for d, xs in enumerate(lists):
        for h in range(2):
            pairs = sum(model.v[a, h] @ model.v[b, h] for i, a in enumerate(xs) for b in xs[i + 1 :])
            assert got[d, h] == pytest.approx(1 / (1 + np.exp(-(model.w0[h] + model.w[xs, h].sum() + pairs))), abs=1e-6)


def test_classifier_edges(spark):
    docs = edge.documents(spark)
    rows = quality_fm.score(docs, edge.labels(spark)).collect()
    assert len(rows) == docs.count() and all(0 <= r.quality <= 1 for r in rows)
    assert all(r.keep for r in quality_fm.score(docs, edge.none(edge.labels(spark))).collect())
    kept = quality_fm.keep(docs, edge.labels(spark))
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in rows)
    assert quality_fm.score(edge.none(docs), edge.labels(spark)).count() == 0
    sampled = quality_fm.Params(train_rows=5)
    assert quality_fm.score(docs, edge.labels(spark), sampled).count() == docs.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_rules_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    made = rules.ledger(spark.read.parquet(f"{SF}/documents.parquet"))
    for name, df in (("op8_quality_rules", made), ("quality_rules_ablation", rules.ablation(made, 2))):
        cursor = con.execute(ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(map(tuple, df.select(columns).collect())) == sorted(cursor.fetchall())


def test_rules_edges(spark):
    texts = [*edge.TEXTS, "%%% *** " * 30, "a | b | c |\n" * 9, "go go " * 40, "A!! B!! C!! D!!"]
    docs = edge.documents(spark, texts)
    rows = {r.doc_id: r for r in rules.ledger(docs).collect()}
    names = lambda r: {n for i, n in enumerate(rules.RULES) if r.failed >> i & 1}
    assert names(rows[0]) == names(rows[1]) == names(rows[2]) == {"no_words"} and rows[5].failed == 0 and rows[3].failed == 0
    assert "signs" in names(rows[11]) and "pipes" in names(rows[12]) and "repeated_words" in names(rows[13]) and "exclamations" in names(rows[14])
    assert rows[13].keep_v1 and not rows[13].keep_v2
    made = rules.ledger(docs)
    whole = rules.mask(2)
    for r in rules.ablation(made, 2).collect():
        bit = 1 << list(rules.RULES).index(r.rule)
        masks = [x.failed & whole for x in made.collect()]
        assert (r.fails, r.only, r.kept_without) == (sum(m & bit > 0 for m in masks), sum(m == bit for m in masks), sum(m & ~bit == 0 for m in masks))
    assert rules.ledger(edge.none(docs)).count() == 0 == rules.ablation(rules.ledger(edge.none(docs)), 1).count()


@pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary")
def test_bpe(spark):
    import tiktoken

    data = bpe.load_vocabulary()
    codec = bpe.Codec(data)
    judge = tiktoken.Encoding("judge", pat_str=bpe.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = [t for t in edge.TEXTS if t] + ["it's 12³ tokens\x1c  and\n\n more ", "Ⅷ 漢字かな العربية \U0001f469‍\U0001f680", "x" * 5000, "aaaa" * 300]
    for t in texts:
        ids = np.frombuffer(codec.encode(t), "<i4").tolist()
        assert ids == judge.encode_ordinary(t) and codec.decode(ids).decode() == t
    docs = edge.documents(spark)
    made = bpe.encode(docs)
    rows = {r.doc_id: r for r in made.collect()}
    assert rows[0].token_ids is None and rows[0].round_trip is None and rows[1].token_ids == [] and all(r.round_trip for i, r in rows.items() if i)
    back = {r.doc_id: r.text for r in bpe.decode(made).collect()}
    assert all(back[i] == t for i, t in enumerate(edge.TEXTS)) and bpe.encode(edge.none(docs)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_bpe_on_documents(spark):
    import tiktoken

    codec = bpe.Codec(bpe.load_vocabulary())
    judge = tiktoken.Encoding("judge", pat_str=bpe.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        assert np.frombuffer(codec.encode(r.text), "<i4").tolist() == judge.encode_ordinary(r.text)
