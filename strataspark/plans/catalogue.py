"""Named queries over the driver's tables with their SQL twins.

``files`` are documents seen as repository files; the dependency graph is nations linked by what their suppliers ship.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import engine
from ..functions import text as T
from ..operators import detect, graph, rules, score
from ..parsers import golang, metadata, python, scripts
from ..session import materialise, spread, table
from ..streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; ``sql`` is its twin for DuckDB."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), "lang", "source", "doc_id")


FILES = "files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content, lang, source, doc_id FROM documents)"
SQL_LINES = "len(string_split(content, chr(10)))"
SQL_FILLED = r"len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')))"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, q): the three largest flows of each nation's suppliers, two to nations and one to the region of the third."""
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a"))
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("b"))
    items = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, d, "region").select("r_regionkey", "r_name")
    flows = (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("a", "b")
        .agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    )
    largest = Window.partitionBy("a").orderBy(F.desc("q"), "b")  # a row for each pair of nations
    ranked = flows.withColumn("r", F.row_number().over(largest)).filter("r <= 3")
    n1, n2 = nation.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("src")), nation.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("to"), "n_regionkey")
    named = ranked.join(n1, "a").join(n2, "b").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("src", F.when(F.col("r") <= 2, F.col("to")).otherwise(F.col("r_name")).alias("dst"), "q")


EDGES = """flows AS (
  SELECT s_nationkey AS a, c_nationkey AS b, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY q DESC, b) AS r FROM flows),
edges AS (
  SELECT n1.n_name AS src, CASE WHEN r <= 2 THEN n2.n_name ELSE r_name END AS dst, q
  FROM ranked JOIN nation n1 ON a = n1.n_nationkey JOIN nation n2 ON b = n2.n_nationkey JOIN region ON n2.n_regionkey = r_regionkey WHERE r <= 3)"""
CLOSURE = "closure AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM closure c JOIN edges e ON c.dst = e.src)"


@query(f"WITH {FILES} SELECT path, CAST({SQL_LINES} AS BIGINT) AS n_lines FROM files")
def line_counts(spark, d):
    return _files(spark, d).select("path", T.split_lines(F.col("content")).cast("bigint").alias("n_lines"))


@query(f"""WITH {FILES} SELECT path, CAST(CASE WHEN len(list_filter(string_split(content, chr(10)), lambda x: strlen(x) > 1048576)) > 0 THEN 0
  ELSE greatest(1, {SQL_LINES} - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END) END AS BIGINT) AS n_lines FROM files""")
def scanned_line_counts(spark, d):
    return _files(spark, d).select("path", T.scanned_lines(F.col("content")).cast("bigint").alias("n_lines"))


@query(f"WITH {FILES} SELECT path, CAST({SQL_LINES} - CASE WHEN content = '' OR ends_with(content, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS n_lines FROM files")
def file_line_counts(spark, d):
    return _files(spark, d).select("path", T.file_lines(F.col("content")).cast("bigint").alias("n_lines"))


@query(f"WITH {FILES} SELECT path, CAST({SQL_FILLED} AS BIGINT) AS n_lines FROM files")
def nonblank_lines(spark, d):
    return _files(spark, d).select("path", T.filled_lines(F.col("content")).cast("bigint").alias("n_lines"))


SIZE_SQL = f"WITH {FILES} SELECT path AS file, CAST(n AS BIGINT) AS actual, CAST(30 AS BIGINT) AS threshold FROM (SELECT path, {SQL_FILLED} AS n FROM files) WHERE n > 30"


def _oversized(spark, d) -> DataFrame:
    return rules.large_files(_files(spark, d), 30)


@query(SIZE_SQL)
def size_violations(spark, d):
    return _oversized(spark, d).select("file", F.col("actual").cast("bigint"), F.col("threshold").cast("bigint"))


@query(f"SELECT 'rule.size' AS rule_id, 'warning' AS severity, 'File ' || file || ' has ' || actual || ' lines (threshold: 30)' AS message, file, 0 AS line FROM ({SIZE_SQL})")
def size_messages(spark, d):
    return _oversized(spark, d).select("rule_id", "severity", "message", "file", "line")


@query("SELECT lang AS language, count(*) AS files, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1.35) AS DOUBLE) AS score FROM documents GROUP BY 1")
def language_stats(spark, d):
    files = _files(spark, d).select("path", F.col("lang").alias("language"), T.split_lines(F.col("content")).alias("lines"))
    return detect.language_stats(files, plain=True).select("language", F.col("count").alias("files"), F.col("score").cast("double"))


ROLE_SQL = "CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'tests' WHEN 2 THEN 'tools' ELSE 'misc' END"


def _repo_files(spark, d) -> DataFrame:
    """Files below src, tests, tools or misc by their source, with language and line count."""
    number = F.substring("source", 4, 9).cast("int") % 4
    top = F.when(number == 0, "src").when(number == 1, "tests").when(number == 2, "tools").otherwise("misc")
    return _files(spark, d).select(F.concat_ws("/", top, "path").alias("path"), F.col("lang").alias("language"), T.split_lines(F.col("content")).alias("lines"))


ROLE_STATS = f"""stats AS (
  SELECT lang AS language, count(*) AS files, CAST(sum(n) AS BIGINT) AS lines,
    CAST(sum((n + 0.35) * CASE role WHEN 'src' THEN 1.0 WHEN 'tests' THEN 0.6 WHEN 'tools' THEN 0.2 ELSE 0.8 END * CASE role WHEN 'tools' THEN 0.2 ELSE 1.0 END) AS DECIMAL(38,6)) AS score,
    CAST(sum(CASE WHEN role = 'src' THEN n + 0.35 ELSE 0 END) AS DECIMAL(38,6)) AS product
  FROM (SELECT lang, {ROLE_SQL} AS role, len(string_split(text, chr(10))) AS n FROM documents) GROUP BY 1)"""
POLICY = detect.Policy(segment_weights={"src": 1.0, "app": 1.0, "pkg": 1.0, "tools": 0.2, "scripts": 0.2})


def _prefixed(files: DataFrame) -> DataFrame:
    return files.withColumn("path", F.concat(F.lit("/"), "path"))  # segments are matched between slashes


@query(f"WITH {ROLE_STATS} SELECT language, files, lines, CAST(score AS DOUBLE) AS score, CAST(product AS DOUBLE) AS product FROM stats")
def role_weighted_stats(spark, d):
    stats = detect.language_stats(_prefixed(_repo_files(spark, d)), POLICY)
    return stats.select("language", F.col("count").alias("files"), "lines", F.col("score").cast("double"), F.col("product").cast("double"))


@query(f"WITH {ROLE_STATS} SELECT language FROM stats ORDER BY product DESC, score DESC, lines DESC, files DESC, language LIMIT 1")
def dominant_language(spark, d):
    return detect.dominant(detect.language_stats(_prefixed(_repo_files(spark, d)), POLICY), POLICY).select("language")


@query("""SELECT language, CAST(sum(w) AS DOUBLE) AS weight, count(*) AS signals FROM (
  SELECT lang AS language, 0.40 AS w FROM documents UNION ALL
  SELECT lang, CASE WHEN quality > 0 THEN 2.10 ELSE 1.20 END FROM labels JOIN documents USING (doc_id)) GROUP BY 1""")
def evidence_sum(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    first = docs.select(F.col("lang").alias("language"), F.lit("0.40").cast("decimal(10,4)").alias("weight"))
    second = labels.join(docs, "doc_id").select(F.col("lang").alias("language"), F.when(F.col("quality") > 0, "2.10").otherwise("1.20").cast("decimal(10,4)").alias("weight"))
    return detect.evidence_sums(first.unionByName(second)).select("language", F.col("weight").cast("double"), "signals")


@query("SELECT lang AS language, CAST(count(*) + CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 3 ELSE 0 END AS DOUBLE) AS score FROM documents GROUP BY lang")
def marker_boost(spark, d):
    stats = table(spark, d, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").cast("decimal(38,6)").alias("score"))
    boosts = spark.createDataFrame([("en", "5"), ("fr", "3"), ("xx", "9")], "language string, boost string")
    return detect.boosted(stats, boosts).select("language", F.col("score").cast("double"))


@query("SELECT count(DISTINCT lang) > 1 AS several, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents")
def multi_language(spark, d):
    found = detect.several(table(spark, d, "documents").select(F.col("lang").alias("language")))
    return found.select("several", F.array_join("languages", ",").alias("languages"))


@query(f"WITH {FILES} SELECT path FROM files WHERE source NOT IN ('src1', 'src3')")
def ignored_dirs(spark, d):
    return _files(spark, d).filter(~T.ignored(T.parent(F.col("path")), ("src1", "src3"))).select("path")


@query(f"WITH {EDGES} SELECT src, dst, CAST(q AS DOUBLE) AS q FROM edges")
def weighted_edges(spark, d):
    return _edges(spark, d).select("src", "dst", F.col("q").cast("double"))


@query("SELECT DISTINCT c_name AS src, o_orderpriority AS dst FROM orders JOIN customer ON o_custkey = c_custkey")
def dedup_edges(spark, d):
    """Each customer a file that imports the priorities of its orders, again and again."""
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("path"))
    rows = table(spark, d, "orders").select("o_custkey", F.array("o_orderpriority", "o_orderpriority").alias("imports")).join(customer, "o_custkey")
    return graph.edges_of(rows)


@query(f"WITH {EDGES} SELECT src AS node FROM edges UNION SELECT dst FROM edges")
def node_union(spark, d):
    return graph.nodes(_edges(spark, d))


@query(f"""WITH {EDGES}, ends AS (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges)
SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM ends GROUP BY 1""")
def degrees(spark, d):
    return graph.degrees(_edges(spark, d))


@query(f"WITH {EDGES} SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS nodes, (SELECT count(*) FROM edges) AS edges")
def graph_counts(spark, d):
    deg = graph.degrees(_edges(spark, d))
    return deg.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"))


@query(f"WITH {EDGES} SELECT src AS node, string_agg(dst, ',' ORDER BY dst) AS neighbours FROM edges GROUP BY 1")
def dependencies(spark, d):
    return graph.adjacency(_edges(spark, d)).select("node", F.array_join("neighbours", ",").alias("neighbours"))


@query(f"WITH {EDGES} SELECT dst AS node, string_agg(src, ',' ORDER BY src) AS neighbours FROM edges GROUP BY 1")
def dependents(spark, d):
    return graph.adjacency(_edges(spark, d), reverse=True).select("node", F.array_join("neighbours", ",").alias("neighbours"))


@query(f"WITH {EDGES} SELECT DISTINCT src AS node FROM edges WHERE src NOT IN (SELECT dst FROM edges)")
def roots(spark, d):
    return graph.roots(_edges(spark, d))


@query(f"WITH {EDGES} SELECT DISTINCT dst AS node FROM edges WHERE dst NOT IN (SELECT src FROM edges)")
def leaves(spark, d):
    return graph.leaves(_edges(spark, d))


@query(f"WITH {EDGES} SELECT a.src, a.dst FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src <= a.dst")
def mutual_cycles(spark, d):
    return graph.mutual(_edges(spark, d))


@query(f"WITH RECURSIVE {EDGES}, {CLOSURE} SELECT src, dst FROM closure")
def reachability(spark, d):
    return graph.reachability(_edges(spark, d))


@query(f"WITH RECURSIVE {EDGES}, {CLOSURE} SELECT src AS node FROM closure WHERE src = dst")
def on_cycle(spark, d):
    return graph.cyclic(materialise(_edges(spark, d), "edges")).select("node")


@query(f"""WITH RECURSIVE {EDGES}, {CLOSURE}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
SELECT node, coalesce((SELECT min(least(a.dst, node)) FROM closure a JOIN closure b ON a.src = b.dst AND a.dst = b.src WHERE a.src = node), node) AS component FROM nodes""")
def scc(spark, d):
    return graph.strong_components(materialise(_edges(spark, d), "edges"))


@query()
def dfs_back_edges(spark, d):
    return graph.back_edges(_edges(spark, d)).select("cycle_id", F.array_join("path", " -> ").alias("path"))


LAYER_PATH = "CASE n_regionkey WHEN 0 THEN 'app/handler/' WHEN 1 THEN 'app/service/' WHEN 2 THEN 'app/repo/' WHEN 3 THEN 'app/report/' ELSE 'handler/repo/' END || n_name"
LAYER_SQL = r"CASE WHEN regexp_matches({0}, '(^|[/\\])handler($|[/\\])') THEN 'handler' WHEN regexp_matches({0}, '(^|[/\\])service($|[/\\])') THEN 'service' WHEN regexp_matches({0}, '(^|[/\\])repo($|[/\\])') THEN 'repo' ELSE 'service' END"


def _layer_paths(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    k = F.col("n_regionkey")
    folder = F.when(k == 0, "app/handler/").when(k == 1, "app/service/").when(k == 2, "app/repo/").when(k == 3, "app/report/").otherwise("handler/repo/")
    return n.select(F.col("n_name").alias("name"), F.concat(folder, "n_name").alias("path"))


@query(f"SELECT path, {LAYER_SQL.format('path')} AS layer FROM (SELECT {LAYER_PATH} AS path FROM nation)")
def layer_tags(spark, d):
    return _layer_paths(spark, d).select("path", T.layer(F.col("path")).alias("layer"))


def _path_edges(spark, d) -> DataFrame:
    paths = _layer_paths(spark, d)
    a, b = paths.toDF("src", "src_path"), paths.toDF("dst", "dst_path")
    edges = _edges(spark, d).join(a, "src").join(b, "dst").select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))
    return materialise(edges, "edges")  # read by several rules, and again where violations are sorted


ORDER_SQL = "CASE {0} WHEN 'handler' THEN 0 WHEN 'service' THEN 1 ELSE 2 END"
LAYERED = f"""{EDGES}, paths AS (SELECT n_name AS name, {LAYER_PATH} AS path FROM nation),
tagged AS (SELECT path, name, {LAYER_SQL.format('path')} AS layer FROM paths),
upward AS (
  SELECT a.path AS src, a.layer AS src_layer, b.path AS dst, b.layer AS dst_layer FROM edges e JOIN tagged a ON e.src = a.name JOIN tagged b ON e.dst = b.name
  WHERE {ORDER_SQL.format('b.layer')} < {ORDER_SQL.format('a.layer')})"""


@query(f"WITH {LAYERED} SELECT 'rule.layer-validation' AS rule_id, src AS file, src || ' (' || src_layer || ') -> ' || dst || ' (' || dst_layer || '): upward import not allowed' AS message FROM upward")
def layer_violations(spark, d):
    return rules.upward_imports(_path_edges(spark, d)).select("rule_id", "file", "message")


GOD = """owners AS (SELECT s_name AS struct, CAST(s_suppkey % 23 AS INT) AS fields, s_suppkey FROM supplier),
god AS (SELECT struct, fields, count(l_orderkey) AS methods FROM owners LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2),
god_limits AS (SELECT CAST(quantile_disc(methods, 0.75) AS BIGINT) AS m FROM god)"""


def _owners(spark, d) -> tuple[DataFrame, DataFrame]:
    """(structs, methods): suppliers with a made-up number of fields, and their line items."""
    structs = table(spark, d, "supplier").select(F.lit("db").alias("dir"), F.col("s_name").alias("name"), F.concat(F.lit("db/"), "s_name").alias("file"), (F.col("s_suppkey") % 23).cast("int").alias("fields"), F.lit(1).alias("line"), "s_suppkey")
    methods = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")).join(structs.select("s_suppkey", "dir", "name"), "s_suppkey").select("dir", "name", F.lit("m").alias("method"))
    return structs.drop("s_suppkey"), methods


@query(f"WITH {GOD} SELECT struct, methods FROM god")
def method_counts(spark, d):
    return rules.with_methods(*_owners(spark, d)).select(F.col("name").alias("struct"), "methods")


GOD_ROWS = f"""{GOD}, god_rows AS (
  SELECT struct, 'fields' AS subject, CAST(fields AS BIGINT) AS actual FROM god WHERE fields > 15 UNION ALL
  SELECT struct, 'methods', methods FROM god WHERE methods > 600)"""


def _gods(spark, d) -> DataFrame:
    return rules.god_objects(*_owners(spark, d), most_fields=15, most_methods=600)


@query(f"WITH {GOD_ROWS} SELECT struct, subject, actual FROM god_rows")
def god_objects(spark, d):
    return _gods(spark, d).select(F.col("struct"), "subject", F.col("actual").cast("bigint"))


@query(f"WITH {GOD_ROWS} SELECT 'db/' || struct AS file, struct, CAST(sum(CASE subject WHEN 'fields' THEN actual ELSE 0 END) AS BIGINT) AS fields, CAST(sum(CASE subject WHEN 'methods' THEN actual ELSE 0 END) AS BIGINT) AS methods FROM god_rows GROUP BY struct")
def god_merge(spark, d):
    return rules.merged_god_objects(_gods(spark, d))


ALL_RULES = f"""{LAYERED}, {GOD_ROWS}, {FILES},
violations AS (
  SELECT 'rule.layer-validation' AS rule_id, 'error' AS severity, src || ' (' || src_layer || ') -> ' || dst || ' (' || dst_layer || '): upward import not allowed' AS message, src AS file, 0 AS line FROM upward UNION ALL
  SELECT 'rule.size', 'warning', 'File ' || path || ' has ' || n || ' lines (threshold: 30)', path, 0 FROM (SELECT path, {SQL_FILLED} AS n FROM files) WHERE n > 30 UNION ALL
  SELECT 'rule.god-object', 'warning', 'Struct ' || struct || ' has ' || actual || ' ' || subject || ' (threshold: ' || CASE subject WHEN 'fields' THEN 15 ELSE 600 END || ')', 'db/' || struct, 1 FROM god_rows)"""


def _violations(spark, d) -> DataFrame:
    return rules.union([rules.upward_imports(_path_edges(spark, d)), _oversized(spark, d), _gods(spark, d)])


@query(f"WITH {ALL_RULES} SELECT rule_id, severity, message, file, line FROM violations ORDER BY rule_id, file, line, message")
def rule_union_sorted(spark, d):
    return rules.in_order(_violations(spark, d)).select("rule_id", "severity", "message", "file", "line")


def _all_violations(spark, d) -> DataFrame:
    """_violations has what its SQL twin has; these have cycles as well, whose walk SQL can't follow."""
    return rules.union([_violations(spark, d), rules.cycles(_path_edges(spark, d))])


@query()
def all_violations(spark, d):
    return rules.in_order(_all_violations(spark, d)).select("rule_id", "severity", "message", "file", "line")


@query()
def all_violations_score(spark, d):
    return score.score(_all_violations(spark, d)).select("circular", "layer", "size", "god_object", "total", "exit_code")


@query()
def all_violations_summary(spark, d):
    return score.summary(_all_violations(spark, d))


ELIGIBLE = [("r1", True, False, ["Go"]), ("r2", True, False, ["Python", "Go"]), ("r3", False, False, []), ("r4", True, True, ["TypeScript"]), ("r5", True, False, ["JavaScript"])]


@query("SELECT rule_id FROM (VALUES ('r1', true, false, ['Go']), ('r2', true, false, ['Python', 'Go']), ('r3', false, false, []), ('r4', true, true, ['TypeScript']), ('r5', true, false, ['JavaScript'])) t(rule_id, aware, multi, languages) WHERE NOT aware OR multi OR list_has_any(languages, ['Python', 'en'])")
def rule_eligibility(spark, d):
    listed = spark.createDataFrame(ELIGIBLE, "rule_id string, aware boolean, multi boolean, languages array<string>")
    return rules.eligible(listed, ["Python", "en"]).select("rule_id")


COUNTS = "count(*) FILTER (rule_id = 'rule.circular-dependency') AS circular, count(*) FILTER (rule_id = 'rule.layer-validation') AS layer, count(*) FILTER (rule_id = 'rule.size') AS size, count(DISTINCT CASE WHEN rule_id = 'rule.god-object' THEN file END) AS god_object"


@query(f"WITH {ALL_RULES}, c AS (SELECT {COUNTS} FROM violations) SELECT *, CAST(greatest(0, 100 - 10 * circular - 5 * layer - 3 * size - 5 * god_object) AS DOUBLE) AS total, CASE WHEN circular + layer > 0 THEN 2 ELSE 0 END AS exit_code FROM c")
def structural_score(spark, d):
    return score.score(_violations(spark, d)).select("circular", "layer", "size", "god_object", "total", "exit_code")


@query("SELECT r_name AS name, count(*) FILTER (s_acctbal < 0) AS failing, CAST(greatest(0, 100 - 3 * count(*) FILTER (s_acctbal < 0)) AS DOUBLE) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def score_by_group(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    rows = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return score.by_group(rows.select(F.col("r_name").alias("name"), (F.col("s_acctbal") < 0).alias("failed")), 3)


@query(f"WITH {ALL_RULES} SELECT {COUNTS}, count(*) AS total, count(*) > 0 AS has_violations FROM violations")
def report_summary(spark, d):
    return score.summary(_violations(spark, d))


DAILY = "daily AS (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS score FROM events GROUP BY 1)"


def _daily(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("ts")).agg(F.round(F.avg("value"), 6).alias("score"))


@query(f"WITH {DAILY} SELECT CAST(day AS VARCHAR) AS day, score, round(score - lag(score) OVER (ORDER BY day), 4) AS delta FROM daily")
def trend(spark, d):
    return score.trend(_daily(spark, d)).select(F.col("ts").cast("string").alias("day"), "score", F.round("delta", 4).alias("delta"))


@query(f"WITH {DAILY}, x AS (SELECT day, score - lag(score) OVER (ORDER BY day) AS delta FROM daily) SELECT CAST(day AS VARCHAR) AS day, CASE WHEN delta IS NULL THEN 'no previous data' WHEN delta > 0 THEN 'increased' WHEN delta < 0 THEN 'decreased' ELSE 'unchanged' END AS trend FROM x")
def trend_label(spark, d):
    return score.trend(_daily(spark, d)).select(F.col("ts").cast("string").alias("day"), "trend")


@query(f"WITH {DAILY} SELECT CAST(max(day) AS VARCHAR) AS day, arg_max(score, day) AS score, count(*) AS entries FROM daily")
def history_last(spark, d):
    return score.last_entry(_daily(spark, d)).select(F.col("ts").cast("string").alias("day"), "score", "entries")


@query("""WITH g AS (SELECT ts, event_type, event_id, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) >= INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT epoch_us(min(ts)) AS started, count(*) AS events, max(event_id) FILTER (ts = last) AS last_event FROM (SELECT *, max(ts) OVER (PARTITION BY n) AS last FROM s) GROUP BY n""")
def debounce_batch(spark, d):
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.struct(F.col("ts"), F.col("event_id")).alias("k"), F.col("event_id").alias("name"))
    return watch.bursts(events, "5 minutes", order="k").select(F.unix_micros("started").alias("started"), "events", F.col("name").alias("last_event"))


EVENT_NAME = "CASE WHEN user_id % 3 = 0 THEN 'pkg/.f' || user_id || '.go' WHEN user_id % 3 = 1 THEN 'pkg/f' || user_id || '.go' ELSE 'pkg/f' || user_id || '.txt' END"
EVENT_OP = "CASE event_type WHEN 'view' THEN 'WRITE' WHEN 'signup' THEN 'CREATE' WHEN 'purchase' THEN 'CHMOD' WHEN 'click' THEN 'WRITE|CREATE' ELSE 'REMOVE' END"


@query(f"SELECT event_id, name, op FROM (SELECT event_id, {EVENT_NAME} AS name, {EVENT_OP} AS op FROM events) WHERE name LIKE '%.go' AND name NOT LIKE '%/.%' AND op IN ('WRITE', 'CREATE', 'REMOVE', 'RENAME')")
def event_filter(spark, d):
    events = table(spark, d, "events").select("event_id", F.expr(EVENT_NAME).alias("name"), F.expr(EVENT_OP).alias("op"))
    return events.filter(watch.wanted(F.col("name"), F.col("op")))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages")
def url_hosts(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host"))


HREFS = "hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)"


def _hrefs(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query(f"WITH {HREFS} SELECT page_id, href FROM hrefs")
def href_imports(spark, d):
    return _hrefs(spark, d)


@query(f"WITH {HREFS}, t AS (SELECT DISTINCT substr(href, 2) AS i FROM hrefs) SELECT i AS token, split_part(i, '.', 1) AS as_python, CASE WHEN i LIKE './%' OR i LIKE '../%' THEN i WHEN i LIKE '@%' THEN regexp_extract(i, '^[^/]*(/[^/]+)?') ELSE split_part(i, '/', 1) END AS as_js, CASE WHEN i = 'the' THEN './' WHEN i LIKE 'the/%' THEN './' || substr(i, 5) ELSE i END AS as_module FROM t")
def import_normalise(spark, d):
    t = _hrefs(spark, d).select(F.expr("substr(href, 2)").alias("token")).distinct()
    c = F.col("token")
    return t.select("token", T.python_import(c).alias("as_python"), T.js_import(c).alias("as_js"), T.module_import(c, "the").alias("as_module"))


@query(f"WITH {HREFS}, u AS (SELECT DISTINCT page_id, href FROM hrefs) SELECT count(DISTINCT page_id) AS files, count(*) AS imports, count(DISTINCT href) AS tokens FROM u")
def import_distinct_totals(spark, d):
    pairs = _hrefs(spark, d).distinct()
    totals = engine.extract_totals(pairs.select(F.col("page_id").alias("path"), F.col("href").alias("import")))
    return totals.crossJoin(pairs.agg(F.countDistinct("href").alias("tokens")))  # a row each


JSON_CASES = (("view", "props"), ("error", "substr(props, 1, length(props) - 1)"), ("click", "'[' || props || ']'"), ("signup", "repeat('{\"a\":', 9) || '1' || repeat('}', 9)"))
JSON_TEXT = "CASE event_type " + " ".join(f"WHEN '{kind}' THEN {text}" for kind, text in JSON_CASES) + " ELSE repeat('{\"a\":', 8) || '1' || repeat('}', 8) END"


@query(f"SELECT CAST(event_id AS VARCHAR) AS path, json_valid(t) AND coalesce(json_type(CASE WHEN json_valid(t) THEN t END) = 'OBJECT', false) AND length(t) - length(replace(t, '{{', '')) <= 8 AS ok FROM (SELECT event_id, {JSON_TEXT} AS t FROM events)")
def depth_guard(spark, d):
    events = table(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), F.expr(JSON_TEXT).alias("content"))
    return metadata.guarded(events).select("path", "ok")


PY_PATH, JS_PATH, GO_PATH = ("'p' || (c_nationkey % 5) || '/m' || c_custkey || '" + x + "'" for x in (".py", ".js", ".go"))
PY_LINES = (
    "'import os, ' || lower(c_mktsegment) || '.core as x, a.b'",
    "'from ' || repeat('.', CAST(c_nationkey % 3 AS INT)) || 'pkg' || (c_nationkey % 7) || '.mod import y'",
    "'# import nothing'",
    "'  import sub' || c_nationkey || '.deep'",
    "'class C' || c_custkey || '(Base): pass'",
    "'  class _low: pass'",
    "'def f' || c_custkey || '(self, a, b):'",
    "'    return ''import x'''",
    "'async def g(): pass'",
    "'  def h( self ): pass'",
)
JS_LINES = ("'import React from \"react\";'", "'  import { a } from ''./' || lower(c_mktsegment) || ''';'", "'import \"side\";'", "'const x = require(\"y' || c_custkey || '\");'", "'export * from \"z\";'")
GO_LINES = (
    "'package p' || (c_nationkey % 5)", "''", "'import ('", "'  \"fmt\"'", "'  x \"example.com/' || lower(c_mktsegment) || '/y\"'", "')'", "''",
    "'type T' || c_custkey || ' struct {'", "'  A, B int'", "'  Embedded'", "'}'",
    "'func (t *T' || c_custkey || ') M(a, b int) {'", "'}'", "'func f' || c_nationkey || '() {'", "'  x.Do()'", "'}'",
)


def _source(path: str, lines: tuple[str, ...]) -> str:
    """SQL, for both engines: (path, content) of a source file for each customer."""
    return f"SELECT {path} AS path, " + " || chr(10) || ".join(lines) + " AS content, c_custkey, c_nationkey, c_mktsegment FROM customer"


def _sources(spark: SparkSession, d: str, path: str, lines: tuple[str, ...]) -> DataFrame:
    customer = spread(table(spark, d, "customer"), "c_custkey")
    return customer.select(F.expr(path).alias("path"), F.expr(" || chr(10) || ".join(lines)).alias("content"))


PY, JS, GO = _source(PY_PATH, PY_LINES), _source(JS_PATH, JS_LINES), _source(GO_PATH, GO_LINES)
EACH_LINE = "SELECT path, i AS line, string_split(content, chr(10))[i] AS t FROM ({0}), unnest(range(1, len(string_split(content, chr(10))) + 1)) r(i)"


@query(f"WITH l AS ({EACH_LINE.format(PY)}), f AS (SELECT path, coalesce(nullif(regexp_extract(t, '^\\s*import\\s+([\\w.]+)', 1), ''), nullif(regexp_extract(t, '^\\s*from\\s+([\\w.]+)\\s+import', 1), '')) AS m FROM l) SELECT path, regexp_extract(path, '([^/]*)\\.py$', 1) AS package, split_part(m, '.', 1) AS import FROM f WHERE m IS NOT NULL")
def python_imports(spark, d):
    return python.imports(_sources(spark, d, PY_PATH, PY_LINES)).select("path", "package", F.explode("imports").alias("import"))


@query(f"""WITH l AS (SELECT path, trim(t) AS t FROM ({EACH_LINE.format(PY)})),
a AS (SELECT path, split_part(trim(unnest(string_split(substr(t, 8), ','))), ' ', 1) AS module, false AS relative, 0 AS level FROM l WHERE t LIKE 'import %'),
b AS (SELECT path, trim(split_part(substr(t, 6), ' import ', 1)) AS m FROM l WHERE t LIKE 'from %' AND t LIKE '% import %')
SELECT * FROM a UNION ALL SELECT path, ltrim(m, '.'), m LIKE '.%', CAST(length(m) - length(ltrim(m, '.')) AS INT) FROM b""")
def python_import_evidence(spark, d):
    return python.import_evidence(_sources(spark, d, PY_PATH, PY_LINES))


@query(f"""WITH l AS (SELECT path, trim(t) AS t FROM ({EACH_LINE.format(PY)})),
a AS (SELECT path, split_part(trim(unnest(string_split(substr(t, 8), ','))), ' ', 1) AS m FROM l WHERE t LIKE 'import %' UNION ALL SELECT path, trim(split_part(substr(t, 6), ' import ', 1)) FROM l WHERE t LIKE 'from %')
SELECT path, CASE WHEN m LIKE '.%' THEN split_part(path, '/', 1) ELSE split_part(m, '.', 1) END AS module, m LIKE '.%' AS relative FROM a""")
def python_normalised_imports(spark, d):
    files = _sources(spark, d, PY_PATH, PY_LINES)
    return python.normalised(python.import_evidence(files), python.module_roots(files))


@query(f"WITH l AS (SELECT path, trim(t) AS t FROM ({EACH_LINE.format(PY)})) SELECT path, CAST(count(*) AS INT) AS lines, CAST(count(*) FILTER (t LIKE 'import %' OR t LIKE 'from %') AS INT) AS imports, CAST(count(*) FILTER (t LIKE 'def %') AS INT) AS functions FROM l GROUP BY path")
def python_metrics(spark, d):
    return python.metrics(_sources(spark, d, PY_PATH, PY_LINES))


@query(f"WITH l AS (SELECT path, line, trim(t) AS t FROM ({EACH_LINE.format(PY)})) SELECT path, CAST(line AS INT) AS line, regexp_extract(t, '^def (\\w+)', 1) AS name, CASE WHEN trim(regexp_extract(t, '\\(([^)]*)', 1)) IN ('', 'self', 'cls') THEN 0 ELSE CAST(len(string_split(regexp_extract(t, '\\(([^)]*)', 1), ',')) AS INT) END AS params FROM l WHERE t LIKE 'def %'")
def python_functions(spark, d):
    return python.functions(_sources(spark, d, PY_PATH, PY_LINES))


@query(f"WITH l AS (SELECT path, line, trim(t) AS t FROM ({EACH_LINE.format(PY)})) SELECT path, CAST(line AS INT) AS line, regexp_extract(t, '^class (\\w+)', 1) AS name, regexp_matches(t, '^class [A-Z]') AS exported FROM l WHERE t LIKE 'class %'")
def python_classes(spark, d):
    return python.classes(_sources(spark, d, PY_PATH, PY_LINES))


@query(f"WITH l AS (SELECT path, trim(t) AS t FROM ({EACH_LINE.format(JS)})) SELECT path, trim(string_split(t, ' from ')[-1], ' \";''') AS import FROM l WHERE t LIKE 'import %' AND t LIKE '% from %'")
def script_imports(spark, d):
    return scripts.imports(_sources(spark, d, JS_PATH, JS_LINES)).select("path", F.explode("imports").alias("import"))


@query(f"SELECT path, CAST(len(string_split(content, chr(10))) AS INT) AS lines, CAST(len(string_split(content, 'import ')) + len(string_split(content, 'require(')) - 2 AS INT) AS imports FROM ({JS})")
def script_metrics(spark, d):
    return scripts.metrics(_sources(spark, d, JS_PATH, JS_LINES))


@query(f"WITH l AS ({EACH_LINE.format(GO)}) SELECT path, regexp_extract(path, '^(p\\d)', 1) AS package, regexp_extract(t, '\"(.*)\"', 1) AS import FROM l WHERE t LIKE '%\"%'")
def go_imports(spark, d):
    return golang.parsed(_sources(spark, d, GO_PATH, GO_LINES), ("package", "imports")).select("path", "package", F.explode("imports").alias("import"))


@query(f"WITH l AS ({EACH_LINE.format(GO)}), s AS (SELECT path, line, t FROM l WHERE t LIKE 'func %') SELECT s.path, regexp_extract(t, '(\\w+)\\([^()]*\\) \\{{', 1) AS name, CAST(line AS INT) AS line, CAST((SELECT min(line) FROM l WHERE l.path = s.path AND l.line > s.line AND l.t = '}}') - line + 1 AS INT) AS lines, CASE WHEN t LIKE '%(a, b int)%' THEN 2 ELSE 0 END AS params FROM s")
def go_functions(spark, d):
    return golang.parsed(_sources(spark, d, GO_PATH, GO_LINES), ("functions",)).select("path", F.explode("functions").alias("f")).select("path", "f.name", "f.line", "f.lines", "f.params")


@query(f"WITH l AS ({EACH_LINE.format(GO)}) SELECT path, regexp_extract(t, '^type (\\w+)', 1) AS name, CAST(line AS INT) AS line, 3 AS fields, true AS exported FROM l WHERE t LIKE 'type %'")
def go_structs(spark, d):
    return golang.parsed(_sources(spark, d, GO_PATH, GO_LINES), ("structs",)).select("path", F.explode("structs").alias("s")).select("path", "s.name", "s.line", "s.fields", "s.exported")


@query(f"WITH l AS ({EACH_LINE.format(GO)}) SELECT path, regexp_extract(t, '\\*(\\w+)', 1) AS receiver, regexp_extract(t, '\\) (\\w+)\\(', 1) AS name FROM l WHERE t LIKE 'func (t %'")
def go_methods(spark, d):
    methods = golang.parsed(_sources(spark, d, GO_PATH, GO_LINES), ("methods",)).select("path", F.explode("methods").alias("m")).select("path", "m.receiver", "m.name")
    return methods.filter("receiver IS NOT NULL")


STDLIB_SQL = ", ".join(f"'{x}'" for x in T.NAMED_FIRST_PARTS)


@query(f"WITH {HREFS} SELECT DISTINCT substr(href, 2) AS token FROM hrefs WHERE split_part(substr(href, 2), '/', 1) NOT IN ({STDLIB_SQL}, 'the', 'la')")
def stdlib_filter(spark, d):
    t = _hrefs(spark, d).select(F.expr("substr(href, 2)").alias("token")).distinct()
    return t.filter(~T.is_go_stdlib(F.col("token")) & ~F.split_part("token", F.lit("/"), F.lit(1)).isin("the", "la"))


@query(f"WITH {EDGES} SELECT src, dst FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nation a JOIN nation b ON a.n_regionkey <= b.n_regionkey WHERE a.n_name = e.src AND b.n_name = e.dst)")
def boundary_rule(spark, d):
    n = table(spark, d, "nation").select("n_name", "n_regionkey")
    allowed = n.toDF("src", "a").join(n.toDF("dst", "b"), F.expr("a <= b")).select("src", "dst")
    return rules.outside(_edges(spark, d), allowed).select("src", "dst")


@query(f"WITH {FILES} SELECT count(*) AS files, CAST(sum({SQL_LINES}) AS BIGINT) AS lines, CAST(sum(len(string_split(content, 'the ')) - 1) AS BIGINT) AS functions, (SELECT count(*) FROM supplier) AS structs FROM files")
def repository_totals(spark, d):
    metrics = _files(spark, d).select("path", T.split_lines(F.col("content")).alias("lines"), (F.size(F.split("content", "the ", -1)) - 1).alias("functions"))
    return engine.totals_of(metrics, _owners(spark, d)[0])
