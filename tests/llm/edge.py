"""Small tables with every awkward row, and other columns whose names the operators use themselves."""

EXTRA = ["node", "n", "keys", "key", "root", "gone", "set", "slot", "shard", "rank", "failed", "quality", "keep", "place", "small", "large", "count", "least_id", "rows", "rule", "w", "l", "t", "h"]
LONG = "alpha beta gamma delta " * 40_000
WORDS = [f"word{i}" for i in range(400)]


def passage(start: int, length: int = 60) -> str:
    return " ".join(WORDS[(start * 7 + i * (start % 5 + 1)) % 400] for i in range(length))


TEXTS = [None, "", " \n\t ", "one", LONG, passage(1), passage(1), passage(1) + " tail", passage(2), "ünïcödé 😀 text", passage(3) + "\n" + passage(3)]


def documents(spark, texts=TEXTS, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en" if k % 2 else None, f"src{k % 3}" if k % 4 else None, None if t is None else len(t), *[k] * len(EXTRA)) for k, (i, t) in enumerate(zip(ids, texts))]
    # a null doc_id, and a row twice
    rows += [(None, "a text without an id", None, None, None, *[0] * len(EXTRA)), rows[-1]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} int" for c in EXTRA))


def none(df):
    return df.filter("1 = 0")


def labels(spark):
    rows = [(i, i % 2, 0) for i in range(11)] + [(None, 1, 1), (3, None, None), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def benchmark(spark):
    rows = [(0, passage(2)), (1, None), (None, passage(3)), (3, ""), (4, "too short"), (5, passage(2))]
    return spark.createDataFrame([(*r, 0) for r in rows], "item_id bigint, text string, node int")
