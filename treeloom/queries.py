"""Registered queries: every relational step of the engine over the test tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom import views
from treeloom.catalog import query
from treeloom.functions import columns
from treeloom.operators import choose, clades, encode, rounds, sampling, substitution
from treeloom.operators.ranking import ranked
from treeloom.plans.durable import scratch, stored
from treeloom.sources import newick, trees
from treeloom.sources import edits as edit_lists
from treeloom.views import SQL_CAND, SQL_CLOSURE, SQL_COUNTS, SQL_EDITS, SQL_SEQ, SQL_TREE, table

# -- counting, roots, sampling, renaming ------------------------------------------


@query("count_per_source", "SELECT source, count(*) AS n, CAST(sum(length(text)) // count(*) AS BIGINT) AS mean_length FROM documents GROUP BY source")
def count_per_source(spark: SparkSession, d: str) -> DataFrame:
    """A1, A3: records and mean length by input."""
    return sampling.count_and_length(table(spark, d, "documents"), "source", "text")


@query("count_total", "SELECT count(*) AS n FROM documents")
def count_total(spark: SparkSession, d: str) -> DataFrame:
    """The sum of the inputs' counts."""
    return sampling.total(sampling.count_by(table(spark, d, "documents"), "source"))


_NAMES = "names AS (SELECT 'root' AS name UNION ALL SELECT lower(r_name) FROM region UNION ALL SELECT 'root_' || lower(n_name) FROM nation)"


def _names(spark: SparkSession, d: str) -> DataFrame:
    root = spark.createDataFrame([("root",)], "name string")
    return root.union(table(spark, d, "region").select(F.lower("r_name"))).union(table(spark, d, "nation").select(F.concat(F.lit("root_"), F.lower("n_name"))))


@query("root_lookup", f"WITH {_NAMES} SELECT name FROM names WHERE name = 'root'")
def root_lookup(spark: SparkSession, d: str) -> DataFrame:
    """D4."""
    return sampling.root_row(_names(spark, d))


@query("exclude_root", f"WITH {_NAMES} SELECT name FROM names WHERE name <> 'root'")
def exclude_root(spark: SparkSession, d: str) -> DataFrame:
    """F1."""
    return sampling.without_root(_names(spark, d))


@query("exclude_root_prefix", f"WITH {_NAMES} SELECT name FROM names WHERE NOT starts_with(name, 'root')")
def exclude_root_prefix(spark: SparkSession, d: str) -> DataFrame:
    """F5."""
    return sampling.without_root(_names(spark, d), prefix=True)


@query(
    "sample_without_replacement",
    "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('7|' || c_nationkey || '|' || c_custkey), c_custkey) AS k FROM customer) WHERE k <= 5",
)
def sample_without_replacement(spark: SparkSession, d: str) -> DataFrame:
    """Five customers of each nation."""
    return sampling.sample(table(spark, d, "customer"), "c_nationkey", "c_custkey", 5, 7).select("c_nationkey", "c_custkey")


@query("sample_tips", f"WITH {SQL_SEQ} SELECT name, seq FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('3|' || label || '|' || name), name) AS k FROM seqs) WHERE k <= 9 UNION ALL SELECT 'root', repeat('C', 33) || repeat('G', 31)")
def sample_tips(spark: SparkSession, d: str) -> DataFrame:
    """The root and z - 1 others of each clade."""
    root = spark.createDataFrame([("root", views.ROOT)], "name string, seq string")
    return sampling.sample(views.sequences(spark, d), "label", "name", 9, 3).select("name", "seq").union(root)


@query("dedup_exact_sequence", "SELECT text, min(doc_id) AS doc_id FROM documents WHERE text <> '' GROUP BY text")
def dedup_exact_sequence(spark: SparkSession, d: str) -> DataFrame:
    """the first document of each text, other than the (empty) root's."""
    return sampling.dedup_sequences(table(spark, d, "documents"), [], "text", "doc_id", root="")


_RENAME = "renamed AS (SELECT o_orderstatus, o_orderkey, 's' || (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) AS new_name FROM orders)"


def _renamed(spark: SparkSession, d: str) -> DataFrame:
    return sampling.dense_rename(table(spark, d, "orders"), ["o_orderstatus"], "o_orderkey").select("o_orderstatus", "o_orderkey", "new_name")


@query("dense_rename", f"WITH {_RENAME} SELECT * FROM renamed")
def dense_rename(spark: SparkSession, d: str) -> DataFrame:
    """P1, D5."""
    return _renamed(spark, d)


@query("rename_back", f"WITH {_RENAME} SELECT o_orderkey, CASE WHEN new_name = 's0' THEN 'root' ELSE new_name END AS name FROM renamed")
def rename_back(spark: SparkSession, d: str) -> DataFrame:
    """P2."""
    return _renamed(spark, d).select("o_orderkey", columns.rename_back(F.col("new_name")).alias("name"))


@query("leaf_tags", f"WITH {_RENAME} SELECT o_orderkey, CAST(substr(new_name, 2) AS BIGINT) AS tag FROM renamed")
def leaf_tags(spark: SparkSession, d: str) -> DataFrame:
    """P7, J7."""
    return _renamed(spark, d).select("o_orderkey", columns.leaf_tag(F.col("new_name")).alias("tag"))


@query("ref_query_split", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'ref' ELSE 'query' END AS part FROM documents")
def ref_query_split(spark: SparkSession, d: str) -> DataFrame:
    """J3, F3."""
    ref, rest = sampling.split_reference(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id")
    return ref.withColumn("part", F.lit("ref")).union(rest.withColumn("part", F.lit("query")))


@query("depth_limit", "SELECT source, count(*) AS n, CAST(greatest(floor(log2(count(*) / 10.0)) + 2, 2) AS INTEGER) AS depth FROM documents GROUP BY source")
def depth_limit(spark: SparkSession, d: str) -> DataFrame:
    """P8."""
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("depth", columns.depth_limit(F.col("n"), 10))


# -- edits and alignment columns ---------------------------------------------------

_VOCAB = "vocab AS (SELECT l_partkey AS edit, count(*) AS cnt FROM lineitem GROUP BY 1 HAVING count(*) / (SELECT count(DISTINCT l_orderkey) FROM lineitem) > 0.001 AND count(*) < (SELECT count(DISTINCT l_orderkey) FROM lineitem))"


@query("edit_vocabulary", f"WITH {_VOCAB} SELECT edit, cnt FROM vocab")
def edit_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """A4: parts as edits of orders."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_partkey").alias("edit"))
    total = li.agg(F.countDistinct("name").alias("n")).first().n  # one number
    return encode.vocabulary(li, total)


@query(
    "edit_vocabulary_sketched",
    "WITH w AS (SELECT unnest(string_split(text, ' ')) AS edit FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT edit, count(*) AS cnt FROM w WHERE edit <> '' GROUP BY edit HAVING count(*) / (SELECT n FROM n) > 0.001 AND count(*) < (SELECT n FROM n)",
)
def edit_vocabulary_sketched(spark: SparkSession, d: str) -> DataFrame:
    """A4 over very many edits, most of them rare (words of documents), through a sketch: only possible ones are shuffled."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("name"), "text")
    words = docs.select("name", F.explode(F.split("text", " ")).alias("edit")).where("edit <> ''")
    return encode.vocabulary_of_many(words, docs.count())


def _sql_encode(sampled: str) -> str:
    return f"""WITH {SQL_EDITS}, src AS ({sampled}), total AS (SELECT count(DISTINCT name) AS n FROM src),
v AS (SELECT list_sort(list(edit)) AS vocab FROM (SELECT edit FROM src GROUP BY edit HAVING count(*) / (SELECT n FROM total) > 0.001 AND count(*) < (SELECT n FROM total))),
t AS (SELECT name, list(DISTINCT edit) AS edits FROM edits GROUP BY name)
SELECT name, array_to_string(list_transform(vocab, lambda e, i: CASE WHEN i <= len(vocab) // 2 + 1 THEN CASE WHEN list_contains(edits, e) THEN 'T' ELSE 'C' END ELSE CASE WHEN list_contains(edits, e) THEN 'A' ELSE 'G' END END), '') AS seq FROM t, v"""


@query("edit_encode", _sql_encode("SELECT * FROM edits"))
def edit_encode(spark: SparkSession, d: str) -> DataFrame:
    """Every user over the vocabulary of all."""
    rows = views.user_edits(spark, d)
    return encode.encode(rows, encode.vocabulary(rows, rows.select("name").distinct().count()))


_TWENTY = "SELECT * FROM edits WHERE name IN (SELECT name FROM (SELECT DISTINCT name FROM edits) ORDER BY md5('5|0|' || name), name LIMIT 20)"


@query("edit_encode_unseen", _sql_encode(_TWENTY))
def edit_encode_unseen(spark: SparkSession, d: str) -> DataFrame:
    """P3 over the vocabulary of a sample of twenty: other users may have edits that it lacks."""
    rows = views.user_edits(spark, d)
    some = stored(sampling.sample(rows.select("name").distinct().withColumn("clade", F.lit(0)), "clade", "name", 20, 5).select("name"))
    return encode.encode(rows, encode.vocabulary(rows.join(F.broadcast(some), "name", "left_semi"), some.count()))


_GAPPED = f"{SQL_SEQ}, gapped AS (SELECT name, replace(seq, 'C', '-') AS seq FROM seqs)"
_FRACTION = "fraction AS (SELECT pos, avg(CASE WHEN substr(seq, pos + 1, 1) = '-' THEN 1.0 ELSE 0.0 END) AS gap_fraction FROM gapped, (SELECT CAST(unnest(range(64)) AS INTEGER) AS pos) GROUP BY pos)"


def _gapped(spark: SparkSession, d: str) -> DataFrame:
    return views.sequences(spark, d).select("name", F.translate("seq", "C", "-").alias("seq"))


@query("gap_fraction", f"WITH {_GAPPED}, {_FRACTION} SELECT pos, round(gap_fraction, 9) AS gap_fraction FROM fraction")
def gap_fraction(spark: SparkSession, d: str) -> DataFrame:
    """A10."""
    return encode.gap_fractions(_gapped(spark, d), "seq").select("pos", F.round("gap_fraction", 9).alias("gap_fraction"))


@query("select_columns", f"WITH {_GAPPED}, {_FRACTION}, keep AS (SELECT list(pos ORDER BY pos) AS ps FROM fraction WHERE gap_fraction <= 0.5) SELECT name, array_to_string(list_transform(ps, lambda p: substr(seq, p + 1, 1)), '') AS seq FROM gapped, keep")
def select_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns with gaps in half of the rows at most."""
    rows = _gapped(spark, d)
    return encode.select_columns(rows, encode.gap_fractions(rows, "seq").where("gap_fraction <= 0.5"), "seq").select("name", "seq")


@query("gap_normalize", "SELECT doc_id, replace(text, '.', '-') AS seq, replace(text, '.', 'N') AS masked FROM documents")
def gap_normalize(spark: SparkSession, d: str) -> DataFrame:
    """P4, P5."""
    return table(spark, d, "documents").select("doc_id", columns.normalize_gaps(F.col("text")).alias("seq"), columns.normalize_gaps(F.col("text"), "N").alias("masked"))


# -- choosing edges ----------------------------------------------------------------

_BEST = f"{SQL_CAND}, best AS (SELECT query, edge, lwr FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY lwr DESC, edge) AS k FROM cand) WHERE k = 1)"
_LCA = f"""{SQL_TREE}, {SQL_CLOSURE}, {SQL_CAND}, top AS (SELECT query, edge FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY lwr DESC, edge) AS k FROM cand) WHERE k <= 2),
depths AS (SELECT node, max(distance) AS depth FROM closure GROUP BY node), met AS (SELECT query, ancestor, count(*) AS m FROM top JOIN closure ON edge = node GROUP BY ALL),
lca AS (SELECT met.query, arg_max(met.ancestor, depth) AS lca FROM met JOIN (SELECT query, count(*) AS n FROM top GROUP BY query) s ON met.query = s.query AND m = n JOIN depths ON met.ancestor = depths.node GROUP BY met.query)"""


def _best(spark: SparkSession, d: str) -> DataFrame:
    return choose.best_edge(views.candidates(spark, d), ["query"], "lwr", "edge")


@query("best_edge", f"WITH {_BEST} SELECT * FROM best")
def best_edge(spark: SparkSession, d: str) -> DataFrame:
    """A7."""
    return _best(spark, d)


@query("best_edge_mp", f"WITH {SQL_CAND} SELECT query, arg_min(edge, md5('11|' || query || '|' || edge)) AS edge FROM cand GROUP BY query")
def best_edge_mp(spark: SparkSession, d: str) -> DataFrame:
    """A9."""
    return choose.best_edge_mp(views.candidates(spark, d), ["query"], 11)


@query("top_candidates", f"WITH {SQL_CAND} SELECT query, edge, lwr FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY lwr DESC, edge) AS k FROM cand) WHERE k <= 3")
def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """W9."""
    return choose.top_k(views.candidates(spark, d), ["query"], "lwr", "edge", 3)


def _lca(spark: SparkSession, d: str) -> DataFrame:
    two = choose.top_k(views.candidates(spark, d), ["query"], "lwr", "edge", 2)
    return choose.lowest_common_ancestor(two, ["query"], views.tree(spark, d))


@query("careful_lca", f"WITH RECURSIVE {_LCA} SELECT * FROM lca")
def careful_lca(spark: SparkSession, d: str) -> DataFrame:
    """A8, T10."""
    return _lca(spark, d)


@query("problematic", f"WITH RECURSIVE {_LCA} SELECT query, lca FROM lca WHERE lca = 'root'")
def problematic(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose candidates meet at the top only."""
    return choose.problematic(_lca(spark, d), "root", "lca")


_SAMPLED = "sampled AS (SELECT query FROM (SELECT l_returnflag, l_orderkey AS query, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('1|' || l_returnflag || '|' || l_orderkey), l_orderkey) AS k FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem)) WHERE k <= 10)"


@query("next_round_pool", f"WITH RECURSIVE {_LCA}, {_SAMPLED} SELECT query FROM sampled UNION ALL SELECT query FROM lca WHERE lca = 'root'")
def next_round_pool(spark: SparkSession, d: str) -> DataFrame:
    """F6, F7, F8."""
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("query")).distinct()
    some = sampling.sample(rows, "l_returnflag", "query", 10, 1).select("query")
    return choose.next_round_pool(some, choose.problematic(_lca(spark, d), "root", "lca").select("query"))


_BOUNDED = "bad AS (SELECT query FROM (SELECT l_returnflag, query, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('2|' || l_returnflag || '|' || query), query) AS k FROM (SELECT DISTINCT l_returnflag, l_orderkey AS query FROM lineitem) JOIN (SELECT query FROM lca WHERE lca = 'root') USING (query)) WHERE k <= 15)"


@query("next_round_pool_bounded", f"WITH RECURSIVE {_LCA}, {_SAMPLED}, {_BOUNDED} SELECT query FROM sampled UNION ALL SELECT query FROM bad")
def next_round_pool_bounded(spark: SparkSession, d: str) -> DataFrame:
    """At most fifteen problematic rows of each clade join the sample."""
    rows = stored(table(spark, d, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("query")).distinct())
    some = sampling.sample(rows, "l_returnflag", "query", 10, 1)
    bad = rows.join(choose.problematic(_lca(spark, d), "root", "lca").select("query"), "query")
    return choose.next_round_pool(some, bad.select("l_returnflag", "query"), "l_returnflag", "query", 15, 2).select("query")


@query("edge_multimap", f"WITH {_BEST} SELECT e.edge, count(b.query) OVER (PARTITION BY e.edge) AS n, b.query FROM (SELECT 's' || s_suppkey AS edge FROM supplier) e LEFT JOIN best b ON e.edge = b.edge")
def edge_multimap(spark: SparkSession, d: str) -> DataFrame:
    """J5."""
    edges = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("edge"))
    return choose.edge_members(edges, _best(spark, d), "edge", "query")


# -- tree tables -------------------------------------------------------------------

_SUB = f"{SQL_TREE}, {SQL_CLOSURE}, {SQL_COUNTS}, sub AS (SELECT ancestor AS node, CAST(sum(cnt) AS BIGINT) AS n FROM closure JOIN counts ON closure.node = counts.node GROUP BY 1)"


@query("ancestor_closure", f"WITH RECURSIVE {SQL_TREE}, {SQL_CLOSURE} SELECT node, ancestor, distance FROM closure")
def ancestor_closure(spark: SparkSession, d: str) -> DataFrame:
    """T10's table: paths double in length at each join."""
    return clades.closure(views.tree(spark, d))


@query("node_depth", f"WITH RECURSIVE {SQL_TREE}, {SQL_CLOSURE} SELECT node, CAST(max(distance) AS INTEGER) AS depth FROM closure GROUP BY node")
def node_depth(spark: SparkSession, d: str) -> DataFrame:
    """T11."""
    return clades.depths(views.tree(spark, d))


@query("subtree_counts", f"WITH RECURSIVE {_SUB} SELECT node, n FROM sub")
def subtree_counts(spark: SparkSession, d: str) -> DataFrame:
    """A6."""
    return clades.subtree_counts(views.tree(spark, d), views.counts(spark, d))


@query("largest_subclade", f"WITH RECURSIVE {_SUB} SELECT CAST(coalesce(max(n), 0) AS BIGINT) AS largest FROM sub WHERE node LIKE 'n%'")
def largest_subclade(spark: SparkSession, d: str) -> DataFrame:
    """Zero where nothing was classified."""
    n = clades.subtree_counts(views.tree(spark, d), views.counts(spark, d))
    return n.where(F.col("node").startswith("n")).agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("largest"))


@query(
    "clade_cut",
    f"""WITH RECURSIVE {SQL_TREE}, {SQL_CLOSURE}, {SQL_COUNTS}, sub AS (SELECT ancestor AS node, CAST(sum(cnt) AS BIGINT) AS n FROM closure JOIN counts ON closure.node = counts.node GROUP BY 1),
walk AS (
  SELECT t.node, 2 AS depth, coalesce(c.cnt, 0) > 0 OR 2 >= 3 AS stop FROM tree t LEFT JOIN counts c ON t.node = c.node WHERE t.parent = 'root'
  UNION ALL SELECT t.node, w.depth + 1, coalesce(c.cnt, 0) > 0 OR w.depth + 1 >= 3 FROM walk w JOIN tree t ON t.parent = w.node LEFT JOIN counts c ON t.node = c.node WHERE NOT w.stop
) SELECT w.node, CASE WHEN stop THEN 'cut' ELSE 'empty' END AS kind, CAST(coalesce(sub.n, 0) AS BIGINT) AS n FROM walk w LEFT JOIN sub ON w.node = sub.node WHERE stop OR w.node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)""",
)
def clade_cut(spark: SparkSession, d: str) -> DataFrame:
    """T4: regions hold nothing themselves, so the walk goes through them and cuts at nations, its depth limit."""
    return clades.clade_cut(views.tree(spark, d), views.counts(spark, d), "root", 3)


@query("route_sequences", "SELECT c_custkey, CAST(n_regionkey AS BIGINT) AS child_clade_id FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def route_sequences(spark: SparkSession, d: str) -> DataFrame:
    """J1, J2."""
    to = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("child_clade_id"))
    return clades.route(table(spark, d, "customer"), to, ["c_nationkey"]).select("c_custkey", "child_clade_id")


@query("count_per_clade", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def count_per_clade(spark: SparkSession, d: str) -> DataFrame:
    """A5, J6."""
    return sampling.count_by(table(spark, d, "customer"), "c_nationkey")


@query("empty_clades", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def empty_clades(spark: SparkSession, d: str) -> DataFrame:
    """Nations without suppliers get no job."""
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return clades.without_rows(table(spark, d, "nation").select("n_nationkey"), rows, ["n_nationkey"])


@query("clade_numbering", "SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) + 6 AS BIGINT) AS child_clade_id FROM nation")
def clade_numbering(spark: SparkSession, d: str) -> DataFrame:
    """T12."""
    return clades.number_tips(table(spark, d, "nation").select("n_name"), "n_name", 6)


@query("large_clade_routing", "SELECT o_orderstatus, count(*) AS n, CASE WHEN count(*) > 1000 THEN 'large' ELSE 'standard' END AS pool FROM orders GROUP BY 1")
def large_clade_routing(spark: SparkSession, d: str) -> DataFrame:
    """C7."""
    n = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return n.withColumn("pool", clades.pool_of(F.col("n"), 1000))


_KEEP = "keep AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_acctbal > 0)"


@query(
    "induced_subtree",
    f"""WITH RECURSIVE {SQL_TREE}, {SQL_CLOSURE}, {_KEEP}, alive AS (SELECT DISTINCT ancestor AS node FROM closure JOIN keep ON closure.node = keep.node),
whole AS (SELECT parent AS node, bool_and(node IN (SELECT node FROM alive)) AS w FROM tree WHERE parent IS NOT NULL GROUP BY parent),
stay AS (SELECT t.node FROM tree t LEFT JOIN whole ON t.node = whole.node WHERE t.node IN (SELECT node FROM alive) AND (coalesce(w, true) OR t.parent IS NULL))
SELECT s.node, arg_min(c.ancestor, c.distance) AS parent FROM stay s LEFT JOIN closure c ON s.node = c.node AND c.distance > 0 AND c.ancestor IN (SELECT node FROM stay) GROUP BY s.node""",
)
def induced_subtree(spark: SparkSession, d: str) -> DataFrame:
    """The tree of suppliers in credit."""
    keep = table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return clades.induced_subtree(views.tree(spark, d), keep)


@query("tiny_tree", "SELECT conv_id, CASE WHEN count(*) = 1 THEN min('t' || turn) || ';' ELSE '(' || string_agg('t' || turn, ',' ORDER BY 't' || turn) || ');' END AS newick FROM conversations GROUP BY conv_id HAVING count(*) <= 2")
def tiny_tree(spark: SparkSession, d: str) -> DataFrame:
    """T8."""
    rows = table(spark, d, "conversations").select("conv_id", F.concat(F.lit("t"), "turn").alias("name"))
    small = rows.groupBy("conv_id").count().where("count <= 2").select("conv_id")
    return clades.tiny_tree(rows.join(small, "conv_id", "left_semi"), "conv_id", "name")


@query(
    "tree_assembly",
    "SELECT 'root' AS node, CAST(NULL AS VARCHAR) AS parent UNION SELECT 'r' || r_regionkey, 'root' FROM region UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer",
)
def tree_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Levels of a forest joined by their global ids."""
    top = spark.createDataFrame([("root", None)], "node string, parent string")
    link = lambda t, a, x, b, y: table(spark, d, t).select(F.concat(F.lit(a), x).alias("node"), (F.lit(y) if b is None else F.concat(F.lit(b), y)).alias("parent"))
    return clades.graft([top, link("region", "r", "r_regionkey", None, "root"), link("nation", "n", "n_nationkey", "r", "n_regionkey"), link("customer", "c", "c_custkey", "n", "c_nationkey")])


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return views.tree(spark, d).select("node", "parent", F.col("node").alias("name"), F.lit(0.5).alias("length"))


@query(
    "newick_tokens",
    f"""WITH RECURSIVE {SQL_TREE}, walk AS (SELECT node, parent, [node] AS path, 0 AS nth FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.node, t.parent, list_append(w.path, t.node), t.nth FROM walk w JOIN (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY node) - 1 AS nth FROM tree) t ON t.parent = w.node),
inner_ AS (SELECT DISTINCT parent AS node FROM tree WHERE parent IS NOT NULL),
label AS (SELECT w.*, w.node || CASE WHEN w.parent IS NULL THEN ';' ELSE ':0.50000' END AS label, CASE WHEN nth > 0 THEN ',' ELSE '' END AS comma, i.node IS NOT NULL AS inside FROM walk w LEFT JOIN inner_ i ON w.node = i.node),
events AS (SELECT path AS k, comma || CASE WHEN inside THEN '(' ELSE label END AS text FROM label UNION ALL SELECT list_append(path, '~'), ')' || label FROM label WHERE inside)
SELECT row_number() OVER (ORDER BY k) - 1 AS at, text FROM events""",
)
def newick_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The text of a tree in pieces, each with its place."""
    return trees.newick_tokens(_nodes(spark, d))


@query("newick_roundtrip", f"WITH {SQL_TREE} SELECT node, parent FROM tree")
def newick_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A tree written as text and read back, both in pieces."""
    return _read_back(spark, _nodes(spark, d)).select(F.col("name").alias("node"), "parent")


def _read_back(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """A table of named nodes, written as Newick text and read again: (node_id, parent_id, name, branch_length, is_leaf, parent)."""
    path = scratch(spark)
    trees.write_newick(nodes, path)
    back = newick.read_newick(spark, path)
    return back.join(back.select(F.col("node_id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left")


@query(
    "newick_large_roundtrip",
    """SELECT 'top' AS name, CAST(NULL AS VARCHAR) AS parent, 0.0 AS branch_length, false AS is_leaf UNION ALL SELECT 'r' || r_regionkey, 'top', 0.25, false FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.5, false FROM nation UNION ALL SELECT 'Customer, ' || c_custkey, 'n' || c_nationkey, c_custkey % 64 / 32.0, true FROM customer""",
)
def newick_large_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as a leaf whose quoted name holds a comma, through files and back."""
    top = spark.createDataFrame([("top", None, 0.0)], "node string, parent string, length double")
    region = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("top"), F.lit(0.25))
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit(0.5))
    customer = table(spark, d, "customer").select(F.concat(F.lit("Customer, "), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.col("c_custkey") % 64 / F.lit(32.0))
    nodes = top.union(region).union(nation).union(customer)
    return _read_back(spark, nodes.select("node", "parent", F.col("node").alias("name"), "length")).select("name", "parent", "branch_length", "is_leaf")


@query("jplace_best_edge", f"WITH {_BEST} SELECT CAST(query AS VARCHAR) AS name, CAST(substr(edge, 2) AS INTEGER) AS edge FROM best")
def jplace_best_edge(spark: SparkSession, d: str) -> DataFrame:
    """Placements written as documents and read again."""
    cand = views.candidates(spark, d).select("query", F.substring("edge", 2, 20).cast("double").alias("edge"), F.col("edge").alias("tag"), "lwr")
    p = F.transform(F.array_sort(F.collect_list(F.struct("tag", "edge", "lwr"))), lambda x: F.array(x["edge"], F.lit(-1.0), x["lwr"]))
    docs = cand.groupBy("query").agg(p.alias("p")).select(F.to_json(F.struct(F.lit("(a{0},b{1});").alias("tree"), F.array(F.struct("p", F.array(F.col("query").cast("string")).alias("n"))).alias("placements"))).alias("value"))
    rows = trees.read_jplace(docs).select("name", F.posexplode("candidates").alias("ord", "c")).select("name", "ord", "c.edge", "c.lwr")
    return choose.best_edge(rows, ["name"], "lwr", "ord").select("name", "edge")


_TURNED = f"""{SQL_TREE}, t AS (SELECT node, parent, length(node) / 4.0 AS len FROM tree), gone AS (SELECT 's' || min(s_suppkey) AS node FROM supplier),
up AS (SELECT t.*, 0 AS step FROM t JOIN gone USING (node) UNION ALL SELECT t.*, up.step + 1 FROM up JOIN t ON t.node = up.parent)"""


@query(
    "reroot_outgroup",
    f"""WITH RECURSIVE {_TURNED} SELECT t.node, CASE WHEN u.step = 1 THEN NULL WHEN u.step > 1 THEN b.node ELSE t.parent END AS parent, CASE WHEN u.step > 0 THEN b.len ELSE t.len END AS length
FROM t LEFT JOIN up u ON t.node = u.node LEFT JOIN up b ON b.step = u.step - 1 WHERE coalesce(u.step, 1) > 0""",
)
def reroot_outgroup(spark: SparkSession, d: str) -> DataFrame:
    """The tree of suppliers seen from the first of them, which is left out."""
    first = table(spark, d, "supplier").agg(F.concat(F.lit("s"), F.min("s_suppkey")).alias("x")).first().x
    nodes = views.tree(spark, d).select("node", "parent", F.col("node").alias("name"), (F.length("node") / 4).alias("length"))
    return clades.reroot(stored(nodes), first).select("node", "parent", "length")


@query("deep_common_ancestor", "SELECT l_partkey, 'o' || min(l_orderkey) AS lca FROM lineitem GROUP BY l_partkey")
def deep_common_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """A8, T10 on a tree as deep as there are orders: each order lies under the one before, and a part's orders meet at the first."""
    order = ranked(table(spark, d, "orders").select("o_orderkey"), [], ["o_orderkey"], "place")
    before = order.select((F.col("place") + 1).alias("place"), F.col("o_orderkey").alias("up"))
    chain = stored(order.join(before, "place", "left").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.concat(F.lit("o"), "up").alias("parent")))
    cand = table(spark, d, "lineitem").select("l_partkey", F.concat(F.lit("o"), "l_orderkey").alias("edge"))
    return choose.lowest_common_ancestor(cand, ["l_partkey"], chain)


# -- rounds ------------------------------------------------------------------------


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("para"))
    return r.withColumn("prev", F.lag("para").over(Window.partitionBy("conv_id").orderBy("turn")))


@query(
    "accepted_round",
    "WITH r AS (SELECT conv_id, turn, length(text) AS para FROM conversations), p AS (SELECT *, lag(para) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM r) "
    "SELECT conv_id, CAST(coalesce(min(CASE WHEN prev IS NOT NULL AND para > prev THEN turn - 1 END), max(turn)) AS BIGINT) AS accepted FROM p GROUP BY conv_id",
)
def accepted_round(spark: SparkSession, d: str) -> DataFrame:
    """The round before the first that leaves more problematic rows than the one before, else the last."""
    r = _rounds(spark, d)
    return r.groupBy("conv_id").agg(F.coalesce(F.min(F.when(rounds.worse(F.col("para"), F.col("prev")), F.col("turn") - 1)), F.max("turn")).cast("long").alias("accepted"))


@query(
    "round_decision",
    "WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE length(text) % 7 END AS para, turn % 3 AS largest, CASE WHEN turn % 2 = 1 THEN 1 END AS good FROM conversations), "
    "f AS (SELECT *, para IS NULL OR para > 4 OR largest = 2 OR largest = 0 AS bad FROM r) "
    "SELECT conv_id, turn, CASE WHEN bad AND good IS NOT NULL THEN 'previous' WHEN bad THEN 'again' WHEN para = 0 THEN 'accept' ELSE 'retry' END AS early, CASE WHEN bad AND good IS NOT NULL THEN 'previous' WHEN bad THEN 'unresolved' ELSE 'accept' END AS late FROM f",
)
def round_decision(spark: SparkSession, d: str) -> DataFrame:
    """The engine's own expressions over every kind of outcome, before the last round and in it."""
    r = table(spark, d, "conversations")
    para = F.when(F.col("turn") % 5 != 4, F.length("text") % 7)
    good = F.when(F.col("turn") % 2 == 1, 1)
    fail = rounds.failed(para, F.lit(4), F.col("turn") % 3, F.lit(2))
    return r.select("conv_id", "turn", rounds.decision(fail, para, good, False).alias("early"), rounds.decision(fail, para, good, True).alias("late"))


@query("realign_needed", "SELECT conv_id, count(*) AS n, count(*) < max(turn) * 0.5 AS realign FROM conversations GROUP BY conv_id")
def realign_needed(spark: SparkSession, d: str) -> DataFrame:
    """Realign where fewer rows are left than half of those at the last alignment."""
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("at"))
    return n.select("conv_id", "n", rounds.realign(F.col("n"), F.col("at"), 0.5).alias("realign"))


@query(
    "pairwise_hamming",
    f"WITH {SQL_SEQ}, s AS (SELECT name, label, seq FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || label || '|' || name), name) AS k FROM seqs) WHERE k <= 10) "
    "SELECT a.label, a.name AS x, b.name AS y, CAST(hamming(a.seq, b.seq) AS BIGINT) AS distance FROM s a JOIN s b ON a.label = b.label AND a.name < b.name",
)
def pairwise_hamming(spark: SparkSession, d: str) -> DataFrame:
    """X2's input: distances within each clade's sample of ten."""
    s = sampling.sample(views.sequences(spark, d), "label", "name", 10, 0)
    other = s.select("label", F.col("name").alias("y"), F.col("seq").alias("seq2"))
    apart = F.aggregate(F.zip_with(F.split("seq", ""), F.split("seq2", ""), lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return s.join(other, "label").where("name < y").select("label", F.col("name").alias("x"), "y", apart.alias("distance"))


@query(
    "parsimony_cost",
    f"WITH {SQL_SEQ} SELECT label, CAST(sum(least(t, n - t)) AS BIGINT) AS cost FROM (SELECT label, pos, count(*) AS n, count(*) FILTER (substr(seq, pos + 1, 1) IN ('T', 'A')) AS t FROM seqs, (SELECT unnest(range(64)) AS pos) GROUP BY ALL) GROUP BY label",
)
def parsimony_cost(spark: SparkSession, d: str) -> DataFrame:
    """X9's cost on a star tree: at each site the rarer of the two states changes."""
    sites = views.sequences(spark, d).select("label", F.posexplode(F.split("seq", "")).alias("pos", "ch")).where("ch <> ''")
    per = sites.groupBy("label", "pos").agg(F.count("*").alias("n"), F.count_if(F.col("ch").isin("T", "A")).alias("t"))
    return per.groupBy("label").agg(F.sum(F.least("t", F.col("n") - F.col("t"))).alias("cost"))


_BASES = "b AS (SELECT label, pos, count(*) FILTER (ch = 'A') AS a, count(*) FILTER (ch = 'C') AS c, count(*) FILTER (ch = 'G') AS g, count(*) FILTER (ch = 'T') AS t FROM (SELECT label, pos, substr(seq, pos, 1) AS ch FROM seqs, (SELECT unnest(range(1, 65)) AS pos)) GROUP BY ALL)"


@query(
    "substitution_counts",
    f"""WITH {SQL_SEQ}, {_BASES}, s AS (SELECT *, (a > 0)::INT + (c > 0)::INT + (g > 0)::INT + (t > 0)::INT - 1 AS k FROM b)
SELECT label, CAST(sum(a * (a - 1) // 2) AS BIGINT) AS AA, CAST(sum(c * (c - 1) // 2) AS BIGINT) AS CC, CAST(sum(g * (g - 1) // 2) AS BIGINT) AS GG, CAST(sum(t * (t - 1) // 2) AS BIGINT) AS TT,
  CAST(sum(a * c) AS BIGINT) AS AC, CAST(sum(a * g) AS BIGINT) AS AG, CAST(sum(a * t) AS BIGINT) AS AT, CAST(sum(c * g) AS BIGINT) AS CG, CAST(sum(c * t) AS BIGINT) AS CT, CAST(sum(g * t) AS BIGINT) AS GT,
  count(*) AS sites, CAST(sum(k) AS BIGINT) AS changes, CAST(sum(k * k) AS BIGINT) AS changes2 FROM s GROUP BY label""",
)
def substitution_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows by their bases, over all sites of each clade."""
    return substitution.substitution_counts(views.sequences(spark, d), "label")


# -- text forms ----------------------------------------------------------------------


@query("fasta_lines", f"WITH {SQL_SEQ} SELECT name, '>' || name || chr(10) || seq AS line FROM seqs")
def fasta_lines(spark: SparkSession, d: str) -> DataFrame:
    """S9."""
    return views.sequences(spark, d).select("name", columns.fasta_line(F.col("name"), F.col("seq")).alias("line"))


@query("edit_lines", f"WITH {SQL_EDITS} SELECT name, list_sort(list_distinct(list(edit))) AS edits FROM edits GROUP BY name")
def edit_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lists joined to text and parsed again."""
    text = views.user_edits(spark, d).groupBy("name").agg(F.concat_ws(";", F.sort_array(F.collect_set("edit"))).alias("text"))
    return text.select("name", edit_lists.parse_edits(F.col("text")).alias("edits"))
