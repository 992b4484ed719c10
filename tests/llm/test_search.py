"""Near duplicates and decontamination against brute force."""

import os
from collections import Counter, defaultdict

import pytest

from strataspark.llm import decontaminate, near_dup
from strataspark.llm.queries import QUERIES
from strataspark.llm.textkit import WordHasher, batch_shingles, shingles

from . import edge

SF = "/root/testdata/sf0.01"


def test_thresholds():
    p = near_dup.Params()
    assert near_dup.jaccard_threshold(0.7, 1.0) == pytest.approx(0.7 / 1.3)
    least = min(max(0.7, 0.5 * r) / (1 + r - max(0.7, 0.5 * r)) for r in (1 + k / 1000 for k in range(1001)))
    assert near_dup.link_threshold(p, 1.0, 2.0) == pytest.approx(least, abs=1e-3)
    bands = near_dup.bandings(p)
    assert bands[0][0] == bands[1][0] == 3 and all(rows == 1 for rows, _ in bands[2:]) and bands[2][1] < bands[5][1] < bands[9][1]
    for d, (rows, count) in enumerate(bands):
        j = least if d < 2 else near_dup.jaccard_threshold(p.containment, p.size_ratio ** (d + 1))
        assert 1 - (1 - j**rows) ** count >= p.recall - 1e-9


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i != 100] + [(400, 401)], "a int, b int")
    roots = {r.id: r.root for r in near_dup.components(edges).collect()}
    assert {roots[i] for i in range(101)} == {0} and {roots[i] for i in range(101, 301)} == {101} and roots[401] == 400
    assert near_dup.components(edges.filter("a < 0")).count() == 0


def classes(rows):
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in rows:
        if r.kind != "contained":
            parent[find(r.doc_id)] = find(r.match_id)
    return find


@pytest.fixture(scope="module")
def searched(spark):
    """(parameters, documents, shingle sets, true pairs with both containments, links, class of a document) over a whole table."""
    p, docs = near_dup.Params(), spark.read.parquet(f"{SF}/documents.parquet")
    hasher = WordHasher()
    sets = {r.doc_id: set(shingles(hasher(r.text.lower().split()), p.k).tolist()) for r in docs.select("doc_id", "text").collect()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for v in s:
            holders[v].append(i)
    shared = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    size = lambda i: len(sets[i])
    truth = {ab: (n / min(map(size, ab)), n / max(map(size, ab))) for ab, n in shared.items() if n / min(map(size, ab)) >= p.containment}
    links = QUERIES["op6_near_duplicates"](spark, SF).collect()
    return p, docs, sets, truth, links, classes(links)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_links_are_true(searched):
    p, docs, sets, truth, links, find = searched
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in links:
        if r.kind == "copy":
            assert texts[r.doc_id] == texts[r.match_id] and r.doc_id > r.match_id
            continue
        both = len(sets[r.doc_id] & sets[r.match_id])
        assert both / len(sets[r.doc_id]) == pytest.approx(r.containment) and both / len(sets[r.match_id]) == pytest.approx(r.reverse)
        assert r.containment >= p.containment and (r.reverse >= p.mutual) == (r.kind == "near")
    copies = Counter(texts.values())
    assert sum(r.kind == "copy" for r in links) == sum(n - 1 for n in copies.values())
    assert all(find(r.group_id) == find(r.match_id) for r in links)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_of_links(searched):
    """Texts that cover each other are of one class."""
    p, docs, sets, truth, links, find = searched
    mutual = [ab for ab, (_, reverse) in truth.items() if reverse >= p.mutual]
    assert sum(find(a) == find(b) for a, b in mutual) >= 0.98 * len(mutual) > 0
    kept = {r.doc_id for r in near_dup.deduplicate(docs, p).select("doc_id").collect()}
    groups = defaultdict(set)
    for i in sets:
        groups[find(i)].add(i)
    assert all(len(g & kept) == 1 for g in groups.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_of_contained_texts(searched):
    """For every pair of a text and a far larger one that holds it, their classes are one, or a pair."""
    p, docs, sets, truth, links, find = searched
    pairs = {(find(r.doc_id), find(r.match_id)) for r in links if r.kind == "contained"}
    inside = [sorted(ab, key=lambda i: len(sets[i])) for ab, (_, reverse) in truth.items() if reverse < p.mutual]
    assert sum(find(a) == find(b) or (find(a), find(b)) in pairs for a, b in inside) >= 0.98 * len(inside) > 0


def test_planted_in_larger_texts(spark):
    """Texts of 100 words in texts of 4 and of 30 times as many, and of 5,000 words in one of 20,000."""
    made = lambda tag, n: " ".join(f"{tag}x{i}" for i in range(n))
    texts, wanted = [], []
    for k in range(40):
        small = made(f"s{k}", 100)
        wanted += [(len(texts), len(texts) + 1), (len(texts), len(texts) + 2)]
        texts += [small, made(f"a{k}", 150) + " " + small + " " + made(f"b{k}", 150), made(f"c{k}", 1500) + " " + small + " " + made(f"d{k}", 1400)]
    wanted.append((len(texts), len(texts) + 1))
    texts += [made("big", 5000), made("e", 10_000) + " " + made("big", 5000) + " " + made("f", 5000)]
    rows = near_dup.links(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    found = {(r.doc_id, r.match_id) for r in rows}
    assert {r.kind for r in rows} == {"contained"} and found <= set(wanted) and len(found) >= 0.97 * len(wanted)


def test_hot_passages_and_groups(spark):
    """A short text in 150 far larger ones, next to those of two such passages; 90 near copies, which are hot in each shingle,
    one of them and a part of it in larger texts. No pair of classes is left out."""
    short, other, base = edge.passage(1, 40), edge.passage(2, 30), [f"b{i}" for i in range(200)]
    filler = lambda tag, n: " ".join(f"{tag}w{i}" for i in range(n))
    texts = [short, other, short + " " + filler("tail", 9)]
    holders = [f"{filler(f'd{k}', 600)} {short} {filler(f'e{k}', 100)} {other if k % 2 else ''} {filler(f'f{k}', 100)}" for k in range(150)]
    near = [" ".join([*base[: 2 * k], f"changed{k}", *base[2 * k + 1 :]]) for k in range(90)]
    around = [f"{filler(f'g{k}', 500)} {near[k]} {filler(f'h{k}', 300)}" for k in range(3)]
    part = " ".join(base[60:130])
    texts += [*holders, *near, *around, part]
    rows = near_dup.links(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    find = classes(rows)
    pairs = {(find(r.doc_id), find(r.match_id)) for r in rows if r.kind == "contained"}
    first_near, first_around, at_part = 3 + 150, 3 + 150 + 90, len(texts) - 1
    assert find(0) == find(2) and len({find(first_near + k) for k in range(90)}) == 1
    wanted = {(find(0), 3 + k) for k in range(150)} | {(find(1), 3 + k) for k in range(1, 150, 2)}
    wanted |= {(find(first_near), first_around + k) for k in range(3)} | {(find(at_part), first_around + k) for k in range(3)} | {(find(at_part), find(first_near))}
    assert pairs == wanted


def test_containers_of_any_document_of_a_unit(spark):
    """Two linked texts with the same sample, all that larger texts have of it hot; only one of the two is in those."""
    import pyarrow as pa

    p = near_dup.Params()
    for seed in range(5000):
        made = lambda tag, n: " ".join(f"{tag}{seed}x{i}" for i in range(n))  # noqa: E731, B023
        passage = made("h", 218)
        whole = f"{passage} {made('x', 84)}"
        part = f"{' '.join(passage.split()[34:])} {made('x', 84)} {made('y', 31)}"
        one, other = batch_shingles(pa.array([whole, part]), p.k)
        if (one[: p.sample] == other[: p.sample]).all():
            break
    assert len(other) < len(one) and (one[: p.sample] == other[: p.sample]).all()
    texts = [part, whole, *(f"{made(f'd{k}', 200)} {passage} {made(f'e{k}', 200)}" for k in range(p.hot + 6))]
    rows = near_dup.links(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.match_id) for r in rows if r.kind == "near"} <= {(0, 1), (1, 0)} and any(r.kind == "near" for r in rows)
    assert {(r.doc_id, r.match_id) for r in rows if r.kind == "contained"} == {(1, k) for k in range(2, len(texts))}


def test_meeting_of_hot_units(spark):
    """All that brute force finds, in slices too; and of keys that all holders have, or holders too small, few lead to a query."""
    import numpy as np

    p, r = near_dup.Params(), np.random.default_rng(5)
    weight = 1 / np.arange(1, 301)
    draw = lambda size: r.choice(300, size, False, weight / weight.sum())
    queries = [(sorted(draw(k := int(r.integers(3, 25))).tolist(), reverse=True), max(1, int(k * 0.7)), int(r.integers(20, 300)), i % 20, i) for i in range(150)]
    holders = [(sorted(draw(int(r.integers(1, 120))).tolist()), 1000 + i % 250, f"s{i}", int(r.integers(30, 900)), 5000 + i) for i in range(300)]
    met = [(h, q, m) for h in holders for q in queries if (m := len({*h[0]} & {*q[0]})) >= q[1] and h[3] * p.mutual > q[2] * p.containment]
    best = {}
    for h, q, m in met:
        at = (h[4], q[3]) if q[2] <= p.whole else (h[4], q[3], q[4])
        best[at] = max(best.get(at, (-1, 0, 0)), (m / min(q[2], p.sample), q[4], m))
    wanted = {(at[0], q, m) for at, (_, q, m) in best.items()}
    assert len(wanted) > 300
    made = spark.createDataFrame([(q[0], q[1], q[3], 900 + q[4], (q[2], q[4])) for q in queries], "keys array<bigint>, need int, root_small bigint, q_sign bigint, q struct<n:int,id:bigint>")
    held = spark.createDataFrame([(h[0], h[1], h[2], (h[3], h[4])) for h in holders], "keys array<bigint>, root_large bigint, c_sign string, c struct<n:int,id:bigint>")
    rows = near_dup._met(made, held, p).collect()
    assert {(x.large, x.small, x.matches) for x in rows} == wanted and len(rows) == len(wanted)
    assert all((x.q_sign, x.root_small, x.c_sign, x.n_large) == (900 + x.small, x.small % 20, f"s{x.large - 5000}", holders[x.large - 5000][3]) for x in rows)
    assert {(x.large, x.small, x.matches) for x in near_dup._met(made, held, near_dup.Params(slice_keys=200)).filter("n_small > 96").collect()} == {x for x in wanted if queries[x[1]][2] > 96}
    assert near_dup._met(made.filter("need < 0"), held, p).count() == 0

    index = near_dup.query_index([np.array([*range(1000 + 10 * i, 1003 + 10 * i), *range(9)]) for i in range(200)], np.full(200, 9), np.full(200, 12), np.arange(200), np.arange(200))
    flat, at = np.tile(np.arange(9), 400), np.arange(0, 3601, 9)
    assert sum(near_dup.meet(index, flat, at, np.full(400, 16), np.full(400, -1), p)[i].size for i in range(3)) == 0
    h, q, matches, looked = near_dup.meet(index, flat, at, np.full(400, 17), np.full(400, -1), p)
    assert len(h) == 400 * 200 and (matches == 9).all() and looked == 400 * 200  # of 720,000 that share a key


def test_only_link_of_two_groups_of_hot_buckets(spark):
    """Groups of 40 and 121 near copies that share 0.66 of their shingles, and one document of each that are linked."""
    made = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    both, bridge, own, other = made("c", 264), made("z", 24), made("a", 136), made("b", 112)
    change = lambda words, k, at: [*words[:at], f"changed{k}", *words[at + 1 :]]
    texts = [change(both + own, k, 270 + 3 * k) for k in range(40)]
    texts += [change(both + [f"u{k}x{i}" if i % 5 == k % 5 else w for i, w in enumerate(bridge)] + other, k, 290 + k % 100) for k in range(120)]
    texts += [" ".join(both + bridge + own[24:]).split(), both + bridge + other]
    texts = [" ".join(t) for t in texts]
    p, hasher = near_dup.Params(), WordHasher()
    sets = [set(shingles(hasher(t.split()), p.k).tolist()) for t in texts]
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= max(p.containment * min(len(sets[i]), len(sets[j])), p.mutual * max(len(sets[i]), len(sets[j])))}
    group = lambda i: i < 40 or i == 160
    assert [(i, j) for i, j in linked if group(i) != group(j)] == [(160, 161)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    find = classes(near_dup.links(docs).collect())
    assert len({find(i) for i in range(len(texts))}) == 1
    assert near_dup.deduplicate(docs).count() == 1


def test_drop_contained(spark):
    texts = [edge.passage(1, 40), " ".join(f"w{i}" for i in range(300)) + " " + edge.passage(1, 40), "another text of its own"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ids = lambda p: sorted(r.doc_id for r in near_dup.deduplicate(docs, p).collect())
    assert ids(near_dup.Params()) == [0, 1, 2] and ids(near_dup.Params(drop_contained=True)) == [1, 2]


def test_no_search_of_containers_that_nothing_reads(spark, monkeypatch):
    def never(*_):
        raise AssertionError("containers are searched")

    monkeypatch.setattr(near_dup, "_containers", never)
    docs = edge.documents(spark)
    assert len({5, 6, 7} & {r.doc_id for r in near_dup.deduplicate(docs).collect()}) == 1
    with pytest.raises(AssertionError, match="containers"):
        near_dup.deduplicate(docs, near_dup.Params(drop_contained=True))


def test_clashing_names_string_ids_and_ties(spark):
    rows = [("b", "same text here", 2, 0), ("a", "same text here", 5, 0), ("a", "same text here", 3, 0), (None, "same text here", 1, 0), ("c", None, 9, 0)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id string, text string, __node int, __rule int, __NODE_ string")
    for order in (docs, docs.orderBy("__node")):
        out = near_dup.deduplicate(order)
        assert out.columns == docs.columns and sorted((r[0] or "", r[2]) for r in out.collect()) == [("a", 3), ("c", 9)]
    assert sorted((r.doc_id or "", r.match_id) for r in near_dup.links(docs).collect()) == [("", "a"), ("a", "a"), ("b", "a")]


def test_near_duplicates_edges(spark):
    docs = edge.documents(spark)
    found = {(r.doc_id, r.match_id, r.kind) for r in near_dup.links(docs).collect()}
    assert (6, 5, "copy") in found and any({a, b} == {5, 7} and k == "near" for a, b, k in found)
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and len({5, 6, 7} & set(ids)) == 1 and ids.count(None) == 1 and {1, 2, 3, 4, 8, 9, 10} <= set(ids)
    assert near_dup.links(edge.none(docs)).count() == 0 and near_dup.deduplicate(edge.none(docs)).count() == 0


def brute_coverage(item: str, text: str, least: int) -> float:
    """Greedy string tiling by the definition: the longest unmarked match first."""
    a, b = ([w for w in decontaminate.WORD.findall(x.lower())] for x in (item, text))
    used_a, used_b, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total / max(1, len(a))
        used_a[i : i + n] = used_b[j : j + n] = [True] * n
        total += n


def test_tiling_against_brute_force(spark):
    p = decontaminate.Params()
    items = [edge.passage(k, 40) for k in range(6)]
    parts = [x.split() for x in items]
    texts = [
        "intro words here " + items[0] + " outro",
        " ".join(parts[1][20:] + ["between"] + parts[1][:20]),
        " ".join(parts[2][30:] + parts[2][10:20] + parts[2][:10] + parts[2][20:30]),
        " ".join(parts[3][:12]),
        " ".join(w for x in zip(parts[4], parts[4]) for w in x),
        items[5].upper().replace(" ", ", "),
        " ".join(parts[0][:15] + parts[1][:15] + parts[0][25:]),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.matches(docs, bench, p).collect()}
    wanted = {(d, i): c for d, t in enumerate(texts) for i, x in enumerate(items) if (c := brute_coverage(x, t, p.min_match)) >= p.coverage}
    assert found == pytest.approx(wanted) and {(0, 0), (1, 1), (2, 2), (5, 5)} <= set(found)
    sliced = decontaminate.matches(docs, bench, decontaminate.Params(slice_items=2)).collect()
    assert {(r.doc_id, r.item_id): r.coverage for r in sliced} == pytest.approx(wanted)
    kept = decontaminate.decontaminate(docs.withColumn("__doc", docs.doc_id), bench, decontaminate.Params(slice_items=2))
    assert kept.columns == ["doc_id", "text", "__doc"] and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in found}


def test_decontamination_edges(spark):
    docs, bench = edge.documents(spark), edge.benchmark(spark)
    found = Counter((r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect())
    assert found[8, 0] == found[8, 5] == 1 and found[10, None] >= 1 and not any(d in (None, 0, 1, 2, 3) for d, _ in found)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and not {8, 10} & {r.doc_id for r in kept.collect()} and kept.count() == docs.count() - 3
    assert decontaminate.matches(edge.none(docs), bench).count() == decontaminate.matches(docs, edge.none(bench)).count() == 0
    assert decontaminate.decontaminate(docs, edge.none(bench)).count() == docs.count()
