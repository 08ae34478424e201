"""Newick text in: trees of any size as tables of edges, parsed where the text lies.

The text is cut at its commas. What stands between two of them is always a run
of opening parentheses, one leaf, and a run of closing ones with the labels of
their nodes, so that each piece is parsed on its own. Running sums over the
pieces give the depth at which a piece starts and the number of its first node
(in preorder); a node's parent is then the last parenthesis opened one level
up, and a closing label belongs to the last one opened on its level. No task
holds a tree: a piece is as long as a label or, at most, as a run of
parentheses, which is the depth of the tree in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.operators.ranking import ranked, running
from treeloom.plans.durable import measured, stored, tables
from treeloom.plans.sizing import broadcast_if_small

EDGES = "tree_id long, node_id long, parent_id long, edge_num int, name string, branch_length double, is_leaf boolean"

#: A label with its length; quoted text may hold anything.
_QUIET = r"(?:'[^']*'|[^()';]+)*"


def _name(label: Column) -> Column:
    """Quoted, or up to a blank, colon or brace; an edge number in braces stays with it."""
    quoted = F.replace(F.regexp_extract(label, r"^\s*'((?:[^']|'')*)'", 1), F.lit("''"), F.lit("'"))
    name = F.when(label.rlike(r"^\s*'"), quoted).otherwise(F.concat(F.regexp_extract(label, r"^\s*([^:\s{]*)", 1), F.regexp_extract(label, r"(\{[^}]*\})", 1)))
    return F.nullif(name, F.lit(""))


def _length(label: Column) -> Column:
    bare = F.regexp_replace(label, r"'[^']*'", "")
    return F.coalesce(F.nullif(F.regexp_extract(bare, r":\s*([-+0-9.eE]+)", 1), F.lit("")).cast("double"), F.lit(0.0))


def _joined(records: DataFrame, by: list[str]) -> DataFrame:
    """(by, at, text): records cut at every comma and file end, put together where neither ends a piece.

    A comma inside quotes is part of a label, one inside brackets of a comment,
    and a tree goes on from one part file to the next. Only such records meet
    their neighbours.
    """
    bare = F.regexp_replace("text", "'[^']*'", "")
    count = lambda c, of: F.length(of) - F.length(F.replace(of, F.lit(c)))
    marks = {"_quotes": count("'", F.col("text")), "_open": count("[", bare) - count("]", bare)}
    rows, seen = measured(records.withColumns(marks), quotes=F.sum("_quotes"), brackets=F.sum(F.abs("_open")), files=F.count_if(F.col("starts")))
    if not seen["quotes"] and not seen["brackets"] and not seen["files"]:
        return rows.select(*by, "at", "text")
    if seen["files"]:  # a comma at a file's end leaves no record behind it, but a label or parenthesis that none can follow
        ends = rows.join(broadcast_if_small(rows.where("starts").select((F.col("at") - 1).alias("at"))), "at").select((F.col("at") + 1).alias("at"), F.col("text").alias("_end"))
        rows = rows.join(broadcast_if_small(ends, seen["files"]), "at", "left")
        full = F.col("_end").rlike(r"[^\s(;]\s*$") & F.col("text").rlike(r"^\s*[^\s);]")
        rows = rows.withColumn("starts", F.col("starts") & ~F.coalesce(full, F.lit(False))).drop("_end")
    inside = running(rows.withColumns({"_q": F.col("_quotes"), "_b": F.col("_open")}), by, ["at"], {k: F.col(k) for k in marks})
    inside = inside.withColumn("_soft", ((F.col("_quotes") - F.col("_q")) % 2 == 1) | (F.col("_open") - F.col("_b") > 0))
    piece = running(inside, by, ["at"], {"_piece": (~(F.col("_soft") | F.col("starts"))).cast("int")})
    text = F.concat(F.when(F.col("_soft") & ~F.col("starts"), ",").otherwise(""), "text")
    parts = F.sort_array(F.collect_list(F.struct("at", text.alias("text"))))  # a label's records, or the ends of neighbouring files
    whole = piece.groupBy(*by, "_piece").agg(parts.alias("_parts"))
    return whole.select(*by, F.col("_piece").alias("at"), F.array_join(F.transform("_parts", lambda x: x["text"]), "").alias("text"))


def _pieces(records: DataFrame, by: list[str]) -> DataFrame:
    """(by, at, part, opens, leaf, closes, ends): each piece's parentheses and labels, cut further where a tree ends."""
    plain = F.regexp_replace("text", r"('[^']*')|\[[^\]]*\]", "$1")  # without comments
    cut = F.regexp_extract_all(plain, F.lit(r"(?:'[^']*'|[^;']+)+;?|;"), F.lit(0))
    parts = records.select(*by, "at", F.posexplode(F.when(F.size(cut) == 0, F.array(F.lit(""))).otherwise(cut)).alias("part", "x"))
    parts = parts.where((F.col("part") == 0) | (F.trim(F.regexp_replace("x", r"\s+", " ")) != ""))  # a line end after a tree
    head = F.regexp_extract("x", r"^([\s(]*)", 1)
    body = F.expr(r"substring(x, length(head) + 1)")
    parts = parts.withColumn("head", head).withColumn("body", body).withColumn("leaf", F.regexp_extract("body", rf"^({_QUIET})", 1))
    after = F.expr("substring(body, length(leaf) + 1)")
    closes = F.regexp_extract_all(after, F.lit(rf"\){_QUIET}"), F.lit(0))
    opens = F.length("head") - F.length(F.replace("head", F.lit("(")))
    return parts.select(*by, "at", "part", opens.alias("opens"), "leaf", F.transform(closes, lambda c: F.substring(c, F.lit(2), F.length(c))).alias("closes"), F.col("x").rlike(r";\s*$").alias("ends"))


def _edges(records: DataFrame, by: list[str]) -> DataFrame:
    """EDGES from ordered records (by, at, text, starts); without ``by``, trees are numbered as they come."""
    spark = records.sparkSession
    with tables(spark) as work:
        shut = F.size("closes")
        net = F.col("opens") - shut
        sums = {"depth": net, "nodes": F.col("opens") + 1, "trees": F.col("ends").cast("int")}
        rows = running(_pieces(_joined(records, by), by), by, ["at", "part"], sums)
        # what was reached before each piece
        rows = rows.withColumns({"depth": F.col("depth") - net, "nodes": F.col("nodes") - F.col("opens") - 1, "trees": F.col("trees") - F.col("ends").cast("int")})
        odd = (F.col("depth") + net < 0) | (F.col("ends") & (F.col("depth") + net != 0))
        rows = rows.withColumn("depth", F.when(odd, F.raise_error(F.lit("a Newick text has parentheses without partners")).cast("long")).otherwise(F.col("depth")))
        if by:
            rows = stored(rows.where("trees = 0").withColumnRenamed(by[0], "tree_id"))
        else:
            rows = rows.withColumnRenamed("trees", "tree_id")
            first = rows.groupBy("tree_id").agg(F.min("nodes").alias("first"))
            rows = stored(rows.join(first, "tree_id").withColumn("nodes", F.col("nodes") - F.col("first")).drop("first"))
        node = lambda i, level, is_leaf: F.struct(F.col("nodes") + i, F.col("depth") + level, F.lit(is_leaf))
        zero = F.lit(0)
        opened = F.when(F.col("opens") > 0, F.transform(F.sequence(zero, F.col("opens") - 1), lambda i: F.struct((F.col("nodes") + i).alias("node"), (F.col("depth") + i).alias("level"))))
        opened = rows.select("tree_id", "at", "part", F.posexplode(opened).alias("sub", "o")).select("tree_id", "at", "part", "sub", "o.*")
        closed = rows.select("tree_id", "at", "part", F.posexplode("closes").alias("k", "label"), (F.col("depth") + F.col("opens")).alias("below"), "opens")
        leaf = rows.select("tree_id", "at", "part", F.col("opens").alias("sub"), (F.col("nodes") + F.col("opens")).alias("node"), (F.col("depth") + F.col("opens")).alias("level"), F.col("leaf").alias("label"))
        none = F.lit(None)
        form = lambda df, level, kind, source, node, label: df.select("tree_id", level.alias("level"), "at", "part", "sub", F.lit(kind).alias("kind"), source.cast("long").alias("source"), node.cast("long").alias("node"), label.cast("string").alias("label"))
        events = form(opened, F.col("level"), "open", F.col("node"), none, none)
        events = events.unionByName(form(opened, F.col("level") - 1, "inner", none, F.col("node"), none))
        events = events.unionByName(form(leaf, F.col("level") - 1, "leaf", none, F.col("node"), F.col("label")))
        closed = closed.withColumn("sub", F.col("opens") + 1 + F.col("k"))
        events = events.unionByName(form(closed, F.col("below") - 1 - F.col("k"), "close", none, none, F.col("label")))
        met = running(events, ["tree_id", "level"], ["at", "part", "sub"], last={"up": F.col("source")}).where("kind <> 'open'")
        own = F.when(F.col("kind") == "close", F.col("up")).otherwise(F.col("node"))
        known = met.select("tree_id", own.alias("node_id"), F.when(F.col("kind") != "close", F.col("up")).alias("parent_id"), "label", (F.col("kind") == "leaf").alias("is_leaf"))
        nodes = known.groupBy("tree_id", "node_id").agg(F.max("parent_id").alias("parent_id"), F.max("label").alias("label"), F.bool_or("is_leaf").alias("is_leaf"))
        label = F.coalesce("label", F.lit(""))
        out = stored(nodes.select(F.col("tree_id").cast("long").alias("tree_id"), "node_id", "parent_id", F.col("node_id").cast("int").alias("edge_num"), _name(label).alias("name"), _length(label).alias("branch_length"), "is_leaf"))
        work.keep(out)
    return out


def edges_of(trees: DataFrame) -> DataFrame:
    """EDGES of (tree_id, newick) rows (S6); a tree's nodes are numbered in preorder, its top has no parent.

    A null text has no edges; what follows the first ``;`` is no part of the tree.
    """
    records = trees.where("newick IS NOT NULL").select("tree_id", F.posexplode(F.split("newick", ",")).alias("at", "text"), F.lit(False).alias("starts"))
    return _edges(records, ["tree_id"])


def read_newick(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """EDGES of the trees in text files (S6), numbered from 0 on as they come.

    Trees end with ``;`` and may span lines and part files, which are read in the
    order of their names; a label ends with its file. A file is split at commas, so that one large tree is
    parsed by as many tasks as its bytes ask for.
    """
    lines = spark.read.option("lineSep", ",").text(path)
    meta = F.col("_metadata")
    lines = lines.select(F.col("value").alias("text"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))
    with tables(spark) as work:
        lines = stored(lines)
        first = lines.groupBy("file").agg(F.min(F.struct("block", "row")).alias("first"))
        rows = lines.join(first, "file").withColumn("starts", F.struct("block", "row") == F.col("first"))  # of its file
        out = _edges(ranked(rows, [], ["file", "block", "row"], "at").select("at", "text", (F.col("starts") & (F.col("at") > 0)).alias("starts")), [])
        work.keep(out)
    return out
