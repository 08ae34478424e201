"""Trees out as Newick text, and placement documents in; ``newick`` reads the text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.kernels.tree import Tree
from treeloom.operators.clades import folded_up
from treeloom.operators.ranking import ranked
from treeloom.plans.durable import stored

#: Nodes up to which a tree is put together as one text on the driver.
NEWICK_NODES = 1_000_000


def newick_tokens(nodes: DataFrame, lengths: bool = True) -> DataFrame:
    """(at, text): the Newick text (S7) of a (node, parent, name, length) table in pieces, ``at`` being their order from 0 on.

    The pieces form a list, each of which knows the next one: a node's opening is
    followed by its first child, its end by its next sibling's opening or its
    parent's end. How many pieces follow each is a sum along the list, by ranges
    of names (``clades.folded_up``), so that no task holds the tree, however
    deep or wide it is.
    """
    rows = stored(ranked(nodes.select("node", "parent", "name", "length"), ["parent"], ["node"], "nth"))
    kids = rows.where("parent IS NOT NULL").select(F.col("parent").alias("_of"), "nth", F.col("node").alias("_kid"))
    first = kids.where("nth = 0").select(F.col("_of").alias("_node"), F.col("_kid").alias("_first"))
    beside = kids.select(F.col("_of").alias("_parent"), (F.col("nth") - 1).alias("_nth"), F.col("_kid").alias("_next"))
    linked = rows.join(first, F.col("node") == F.col("_node"), "left").join(beside, (F.col("parent") == F.col("_parent")) & (F.col("nth") == F.col("_nth")), "left")
    odd = F.coalesce(F.col("name"), F.lit("")).rlike(r"[ ,():;'\[\]]")
    label = F.when(odd, F.concat(F.lit("'"), F.replace("name", F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(F.coalesce("name", F.lit("")))
    tail = F.concat(F.lit(":"), F.format_string("%.5f", F.coalesce("length", F.lit(0.0)))) if lengths else F.lit("")
    label = F.concat(label, F.when(F.col("parent").isNull(), ";").otherwise(tail))
    comma = F.when((F.col("nth") > 0) & F.col("parent").isNotNull(), ",").otherwise("")
    piece = lambda kind, c: F.concat(F.lit(kind), c)
    following = F.when(F.col("_next").isNotNull(), piece("o", F.col("_next"))).when(F.col("parent").isNotNull(), piece("c", F.col("parent")))
    linked = stored(linked.select("node", "_first", following.alias("next"), label.alias("label"), comma.alias("comma")))
    leaf = linked.where("_first IS NULL").select(piece("o", F.col("node")).alias("piece"), "next", F.concat("comma", "label").alias("text"))
    opens = linked.where("_first IS NOT NULL").select(piece("o", F.col("node")).alias("piece"), piece("o", F.col("_first")).alias("next"), F.concat("comma", F.lit("(")).alias("text"))
    ends = linked.where("_first IS NOT NULL").select(piece("c", F.col("node")).alias("piece"), "next", F.concat(F.lit(")"), "label").alias("text"))
    pieces = leaf.union(opens).union(ends).select(F.col("piece").alias("node"), F.col("next").alias("up"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("x"), "text")
    at = folded_up(pieces, "sum")  # how many pieces follow
    return at.select((F.lit(at.count() - 1) - F.col("all")).alias("at"), "text")


def write_newick(nodes: DataFrame, path: str, lengths: bool = True, compression: str = "none") -> None:
    """Part files that, one after the other, are the tree's text; a line end between pieces is white space there."""
    newick_tokens(nodes, lengths).orderBy("at").select("text").write.mode("overwrite").option("compression", compression).text(path)


_JPLACE = "tree string, placements array<struct<p array<array<double>>, n array<string>>>"


def read_jplace(docs: DataFrame, text: str = "value", edge: int = 0, weight: int = 2) -> DataFrame:
    """(name, candidates): a row for each placed name (S8); candidates in file order as (edge, loglik, lwr).

    Every name of a placement counts, also where a placer has put equal queries together.
    """
    one = F.from_json(F.col(text), _JPLACE)
    rows = docs.select(F.explode(one["placements"]).alias("x")).select(F.explode("x.n").alias("name"), F.col("x.p").alias("p"))
    cand = F.transform("p", lambda p: F.struct(p[edge].cast("int").alias("edge"), p[1].alias("loglik"), p[weight].alias("lwr")))
    return rows.select("name", cand.alias("candidates"))


def jplace_edges(docs: DataFrame, text: str = "value") -> DataFrame:
    """(edge_num, name) of the leaves in the documents' trees (P7, J7): edges carry their number in braces."""
    tree = F.get_json_object(F.col(text), "$.tree")
    pairs = F.regexp_extract_all(tree, F.lit(r"([^(),:;{}\s]+)(?::[0-9.eE+-]+)?\{(\d+)\}"), F.lit(0))
    one = F.explode(pairs).alias("x")
    return docs.select(one).select(F.regexp_extract("x", r"\{(\d+)\}", 1).cast("int").alias("edge_num"), F.regexp_extract("x", r"^([^:{]+)", 1).alias("name"))


def tree_from_rows(rows: Iterator[tuple[str, str | None, str | None, float]], prune: set[str] | None = None) -> Tree:
    """One tree from (node, parent, name, length) rows in any order; the one row without a parent is the top."""
    rows = sorted(rows, key=lambda r: r[0])
    at = {r[0]: i for i, r in enumerate(rows)}
    return Tree([at[r[1]] if r[1] is not None else -1 for r in rows], [r[2] for r in rows], [r[3] or 0.0 for r in rows])
