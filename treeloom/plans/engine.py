"""The level-synchronous engine: all clades of a level go through each step together.

A level is a frontier table (clade_id, name, seq or edits). Clades small enough
are solved directly. The others are sampled, a tree is built for each sample,
every row is placed on its clade's tree, and edge *counts*, never lists of
names, decide where the tree is cut. Rounds repeat for the clades whose cut is
not clean. Rows then take their child clade's id and form the next level. Rows
that no edge below their clade's top takes in any round (a star has many) become
leaves of that top; in the first clade, where only the root lies above, they are
left out.

Rows are never grouped by clade as a whole (the first clade is everything):
only samples, edge counts and clades under the threshold are. Every table that
a later step reads again is cut off in the shared folder.
"""

from __future__ import annotations

import logging
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.config import LineageConfig
from treeloom.kernels import align
from treeloom.kernels.sample_tree import Model, Placer, build_tree, child_id, cut, edit_vocabulary, encode_edits, upper_tree
from treeloom.kernels.tree import to_newick
from treeloom.operators import rounds
from treeloom.operators.choose import next_round_pool
from treeloom.operators.clades import induced_subtree, pool_of
from treeloom.operators.substitution import estimates
from treeloom.operators.sampling import count_by, draw, root_row, sample, without_root
from treeloom.plans.durable import counted, measured, stored, tables
from treeloom.plans.sizing import arrow_rows, broadcast_if_small
from treeloom.sources.trees import NEWICK_NODES, tree_from_rows

_log = logging.getLogger(__name__)

NODES = "node string, parent string, name string, length double"
_MODEL = "clade_id long, parent array<int>, label array<string>, length array<double>, names array<string>, seqs array<string>, root string, vocab array<string>, model array<double>, error string"
#: Bytes of sample trees that may be broadcast; beyond, rows and models meet in salted groups.
MODEL_BYTES = 64 << 20


@dataclass
class Lineage:
    """A finished run: the tree as a node table, what was left out, and figures by level."""

    nodes: DataFrame
    discarded: DataFrame
    metrics: list[dict]

    def newick(self, lengths: bool = True) -> str:
        """The tree as one text, put together on the driver: for trees up to NEWICK_NODES nodes."""
        if (n := self.nodes.count()) > NEWICK_NODES:
            raise ValueError(f"{n} nodes; read the node table instead")
        rows = ((r.node, r.parent, r.name, r.length) for r in self.nodes.toLocalIterator())
        return to_newick(tree_from_rows(rows), lengths)


class _Run:
    def __init__(self, config: LineageConfig, root: str | None) -> None:
        self.config, self.root, self.seed = config, root, config.seed_value()

    # -- kernels ---------------------------------------------------------------

    def _encoded(self, rows: pd.DataFrame) -> tuple[list[str], str, list[str] | None]:
        """A sample's aligned sequences, its root's, and its vocabulary."""
        if self.config.edits:
            lists = [list(x) for x in rows["edits"]]
            vocab = edit_vocabulary(lists, len(lists) + 1)  # the root has a row without edits
            return [encode_edits(x, vocab) for x in lists], encode_edits([], vocab), vocab
        if not self.config.unaligned:
            return list(rows["seq"]), self.root, None
        kept = [a if isinstance(a, str) else None for a in rows["aln"]]
        fresh = iter(align.align_all([s for s, a in zip(rows["seq"], kept, strict=True) if a is None], self.root))
        return [next(fresh) if a is None else a for a in kept], self.root, None

    def models(self, sampled: DataFrame) -> DataFrame:
        config, encoded = self.config, self._encoded

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_order")
            clade = int(pdf["clade_id"].iloc[0])
            blank = {"clade_id": clade, "parent": None, "label": None, "length": None, "names": None, "seqs": None, "root": None, "vocab": None, "model": None}
            try:
                seqs, root, vocab = encoded(pdf)
                names = list(pdf["name"])
                if len(names) < 2:
                    raise ValueError("a sample of one taxon has no edge to cut")
                model = pdf["model"].iloc[0] if "model" in pdf else None
                t = build_tree(names, seqs, root, config, model)
                row = blank | {"model": model, "parent": t.parent, "label": [n or "" for n in t.name], "length": [float(x) for x in t.length], "names": names, "seqs": seqs, "root": root, "vocab": vocab, "error": None}
            except Exception as e:  # the state machine decides what follows (C13)
                row = blank | {"error": f"{type(e).__name__}: {e}"}
            return pd.DataFrame([row])

        return sampled.groupBy("clade_id").applyInPandas(run, _MODEL)

    def _place_rows(self, rows: pd.DataFrame, placers: dict, model_of) -> pd.DataFrame:
        out = []
        for clade, part in rows.groupby("clade_id", sort=False):
            if clade not in placers:
                if len(placers) >= 64:
                    placers.clear()
                row = model_of(clade)
                placers[clade] = None if row is None else Placer(Model.of_row(row), self.config, int(clade), self.seed)
            placer = placers[clade]
            if placer is None:
                continue
            part = part.copy()
            if self.config.edits:
                seqs = [encode_edits(list(e), placer.model.vocab) for e in part["edits"]]
            elif self.config.unaligned:
                seqs = [a if isinstance(a, str) else placer.aligned(s) for s, a in zip(part["seq"], part["aln"], strict=True)]
                part["aln"] = seqs
            else:
                seqs = list(part["seq"])
            part["edge"] = placer.best(list(part["name"]), seqs)
            out.append(part)
        return pd.concat(out) if out else rows.iloc[:0].assign(edge=pd.Series(dtype="int32"))

    def place(self, rows: DataFrame, models: DataFrame, size: int | None = None) -> DataFrame:
        """``rows`` with the edge each belongs to (J4); ``size``: bytes of the models, if known."""
        names = rows.columns
        schema = rows.select(*names, F.lit(0).alias("edge")).schema
        sound = models.where("error IS NULL")
        if size is None:
            size = sound.agg(F.sum(F.length("root") * (F.size("names") + 1) + 64 * F.size("parent"))).first()[0] or 0
        place_rows = self._place_rows
        if size <= MODEL_BYTES:
            held = rows.sparkSession.sparkContext.broadcast({r["clade_id"]: r.asDict() for r in sound.collect()})

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                placers: dict = {}
                for b in batches:
                    yield place_rows(b, placers, held.value.get)[[*names, "edge"]]

            return rows.mapInPandas(run, schema)
        chunk = self.config.chunk
        salts = F.when(pool_of(F.col("n"), chunk) == "large", F.ceil(F.col("n") / chunk)).otherwise(F.lit(1).cast("long"))  # large clades are spread (C7)
        n = rows.groupBy("clade_id").agg(F.count("*").alias("n"))
        salted = rows.join(broadcast_if_small(stored(n)), "clade_id").withColumn("_salt", F.pmod(F.xxhash64("name"), salts)).drop("n")
        spread = sound.join(n, "clade_id").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("n")

        def both(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            row = None if right.empty else right.iloc[0]
            return place_rows(left, {}, lambda _: row)[[*names, "edge"]]

        return salted.groupBy("clade_id", "_salt").cogroup(spread.groupBy("clade_id", "_salt")).applyInPandas(both, schema)

    def cuts(self, counts: DataFrame, models: DataFrame, sizes: DataFrame, turn: int) -> DataFrame:
        """Per clade: para, largest and the rows of the cut: edges with their child clade, nodes of the upper tree."""
        threshold = self.config.threshold

        def run(key, cnt: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
            clade, blank = int(key[0]), pd.DataFrame({c: [] for c in ("clade_id", "edge", "child", "para", "largest", "node", "parent", "length")}, dtype=object)
            if model.empty or cnt.empty or model["error"].notna().iloc[0]:
                return blank
            m = Model.of_row(model.iloc[0])
            n = int(cnt["n"].iloc[0])
            limit = max(int(math.floor(math.log2(n / threshold))) + 2, 2)
            at = {int(e): int(c) for e, c in zip(cnt["edge"], cnt["cnt"], strict=True)}
            owner, owned, _ = cut(m.tree, at, limit)
            para, largest = at.get(0, 0), max(owned.values(), default=0)
            rows = [(clade, e, child_id(clade, turn, v), para, largest, None, None, None) for e, v in owner.items() if at.get(e)]
            rows += [(clade, None, None, para, largest, a, b, x) for a, b, x in upper_tree(m.tree, owned, clade, turn)]
            # 63-bit ids do not survive a column of floats
            kinds = {"edge": "Int32", "child": "Int64", "length": "Float64"}
            return pd.DataFrame({c: pd.array(list(x), kinds[c]) if c in kinds else list(x) for c, x in zip(blank.columns, zip(*rows, strict=True), strict=True)})

        return counts.join(sizes, "clade_id").groupBy("clade_id").cogroup(models.groupBy("clade_id")).applyInPandas(run, "clade_id long, edge int, child long, para long, largest long, node string, parent string, length double")

    def direct(self, rows: DataFrame) -> DataFrame:
        """NODES of the clades small enough for one tree."""
        config, encoded = self.config, self._encoded

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            clade = int(pdf["clade_id"].iloc[0])
            pdf = pdf.sort_values("name")
            top, names = f"c{clade}", list(pdf["name"])
            if len(names) == 1:
                rows = [(top, None, names[0], None)]
            elif len(names) == 2:
                rows = [(f"{top}.{i}", top, n, 0.0) for i, n in enumerate(names)]
            else:
                seqs, root, _ = encoded(pdf)
                t = build_tree(names, seqs, root, config)
                rows = [(f"{top}.{v}", top if t.parent[v] == 0 else f"{top}.{t.parent[v]}", t.name[v], t.length[v]) for v in range(1, len(t))]
            return pd.DataFrame(rows, columns=["node", "parent", "name", "length"]).astype({"length": float})

        return rows.groupBy("clade_id").applyInPandas(run, NODES)


def reconstruct(taxa: DataFrame, config: LineageConfig | None = None) -> Lineage:
    """The lineage tree of ``taxa``: (name, seq), with a row named ``root``, or (name, edits).

    Equal sequences are handled as one taxon and become sisters at the end.
    """
    config = config or LineageConfig()
    arrow_rows(taxa.sparkSession, 2000)
    payload = "edits" if config.edits else "seq"
    root = None
    if not config.edits:
        row = root_row(taxa).select(payload).first()
        if row is None:
            raise ValueError("no record is named root")
        root = row[0]
    run = _Run(config, root)
    spark = taxa.sparkSession
    rows = without_root(taxa.select("name", payload))
    key = F.array_join(F.sort_array("edits"), ";") if config.edits else F.col("seq")
    with tables(spark) as whole:
        first = rows.withColumn("_key", F.sha2(key, 256)).groupBy("_key").agg(F.min("name").alias("name"), F.min_by(payload, "name").alias(payload), F.count("*").alias("_n"))
        first, seen = measured(first, copies=F.count_if(F.col("_n") > 1))
        twins = None
        if seen["copies"]:
            named = rows.select(F.col("name").alias("twin"), F.sha2(key, 256).alias("_key"))
            again = first.where("_n > 1").select("_key", "name")
            twins = stored(named.join(broadcast_if_small(again, seen["copies"]), "_key").select("name", "twin"))
        frontier = first.select(F.lit(0).cast("long").alias("clade_id"), "name", payload)
        if config.unaligned:
            frontier = frontier.withColumns({"aln": F.lit(None).cast("string"), "aln_n": F.lit(None).cast("long")})
        nodes: list[DataFrame] = []
        lost: list[DataFrame] = []
        metrics: list[dict] = []
        clades, held = 1, first
        for level in range(10_000):
            began = time.time()
            with tables(spark) as work:
                sizes, figures = measured(count_by(frontier, "clade_id"), clades=F.count(F.lit(1)), taxa=F.sum("n"), open=F.count_if(F.col("n") > config.threshold))
                if not figures["clades"]:
                    break
                clades += figures["clades"]
                if clades > config.max_clades + 1 and figures["open"]:
                    raise RuntimeError(f"over {config.max_clades} clades: raise max_clades")
                metrics.append({"level": level, **figures, "rounds": 0, "discarded": 0})
                done = _level(run, frontier, sizes, figures, metrics[-1])
                work.keep(*done.kept)
            nodes += done.nodes
            lost += done.lost
            metrics[-1]["seconds"] = time.time() - began
            _log.info("%s", metrics[-1])
            if done.moved is None:
                break
            whole.drop(held)  # the level that has been divided
            held = done.moved
            frontier = held.where("child IS NOT NULL").withColumn("clade_id", F.col("child")).select(*frontier.columns)
        out = _assemble(nodes, lost, twins, taxa, metrics)
        whole.keep(out.nodes, out.discarded)
    return out


@dataclass
class _Level:
    """What a level leaves: pieces of the tree, taxa left out, its rows with their child clades (none: it was the last), and the tables that these read."""

    nodes: list[DataFrame] = field(default_factory=list)
    lost: list[DataFrame] = field(default_factory=list)
    moved: DataFrame | None = None
    kept: list[DataFrame] = field(default_factory=list)

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.append(table)
        return table


def _level(run: _Run, frontier: DataFrame, sizes: DataFrame, figures: dict, metrics: dict) -> _Level:
    """One level: small clades are solved, the others divided; counts come with the writes."""
    config, open_ = run.config, figures["open"]
    done = _Level()
    sized = frontier.join(broadcast_if_small(sizes, figures["clades"]), "clade_id")
    if open_ < figures["clades"]:
        done.nodes.append(done.keep(stored(run.direct(sized.where(F.col("n") <= config.threshold).drop("n")))))
    if not open_:
        return done
    active = sized.where(F.col("n") > config.threshold)
    if config.unaligned:  # keep an alignment while the clade is not much smaller than when it was made (X12)
        active = active.withColumn("aln", F.when(~rounds.realign(F.col("n"), F.col("aln_n"), config.realign_ratio), F.col("aln"))).withColumn("aln_n", F.when(F.col("aln").isNull(), F.col("n")).otherwise(F.col("aln_n")))
    active = active.drop("n")  # the frontier and a small join: read again rather than written
    state = sizes.where(F.col("n") > config.threshold).select("clade_id", "n", F.col("n").alias("prev"), F.lit(None).cast("int").alias("good"))
    left, pool, made, settled = open_, active, {}, []
    for turn in range(1, config.max_rounds):
        todo = active if turn == 1 else active.join(broadcast_if_small(state.select("clade_id"), left), "clade_id", "left_semi")
        drawn = sample(pool, "clade_id", "name", min(config.subsample, config.tip_sample), run.seed, F.lit(turn))
        drawn = drawn if run.root is None else drawn.where(F.col("seq") != run.root)
        if config.estimated():  # exchange rates of the clades' samples (X7)
            drawn = stored(drawn)
            drawn = drawn.join(broadcast_if_small(estimates(drawn), left), "clade_id", "left")
        drawn = drawn.withColumn("_order", draw(run.seed, "clade_id", "name"))
        models, seen = measured(run.models(drawn), bytes=F.sum(F.when(F.col("error").isNull(), F.length("root") * (F.size("names") + 1) + 64 * F.size("parent"))))
        placed = stored(run.place(todo, models, seen["bytes"] or 0))
        counts = placed.groupBy("clade_id", "edge").agg(F.count("*").alias("cnt"))
        cuts = stored(run.cuts(counts, models, state.select("clade_id", "n"), turn))
        made[turn] = (placed, cuts)
        got = cuts.groupBy("clade_id").agg(F.max("para").alias("para"), F.max("largest").alias("largest"))
        s = state.join(got, "clade_id", "left")
        fail = rounds.failed(F.col("para"), F.col("prev"), F.col("largest"), F.col("n"))
        action = rounds.decision(fail, F.col("para"), F.col("good"), turn == config.max_rounds - 1)
        s, seen = measured(s.withColumn("action", action), **{x: F.count_if(F.col("action") == x) for x in ("accept", "again", "retry", "unresolved")})
        settled.append(s.where("action IN ('accept', 'previous', 'unresolved')").select("clade_id", F.when(F.col("action") == "accept", turn).when(F.col("action") == "previous", F.col("good")).alias("turn")))
        state = s.where("action IN ('again', 'retry')").select("clade_id", "n", F.when(F.col("action") == "retry", F.col("para")).otherwise(F.col("prev")).alias("prev"), F.when(F.col("action") == "retry", turn).otherwise(F.col("good")).alias("good"), "action")
        left = seen["again"] + seen["retry"]
        metrics["rounds"] = turn
        if not left:
            break
        again = state.where("action = 'again'").select("clade_id")
        retry = state.where("action = 'retry'").select("clade_id")
        bad = placed.where("edge = 0").drop("edge")
        mixed = next_round_pool(drawn.drop("_order", "model"), bad, "clade_id", "name", config.retry_rows, run.seed).dropDuplicates(["clade_id", "name"]).join(broadcast_if_small(retry, seen["retry"]), "clade_id", "left_semi")
        pool = active.join(broadcast_if_small(again, seen["again"]), "clade_id", "left_semi").unionByName(mixed)
    ended = reduce(DataFrame.union, settled)
    ends = {turn: seen["accept"], None: seen["unresolved"]}
    if turn > 1:
        ended, n = measured(ended, stuck=F.count_if(F.col("turn").isNull()), **{str(k): F.count_if(F.col("turn") == k) for k in made})
        ends = {None: n["stuck"]} | {k: n[str(k)] for k in made}
    moved = None
    for turn, (placed, cuts) in made.items():
        if not (n := ends[turn]):
            continue
        if n < open_:
            mine = broadcast_if_small(ended.where(F.col("turn") == turn).select("clade_id"), n)
            cuts, placed = stored(cuts.join(mine, "clade_id", "left_semi")), placed.join(mine, "clade_id", "left_semi")
        done.keep(cuts)
        done.nodes.append(cuts.where("node IS NOT NULL").select("node", "parent", F.lit(None).cast("string").alias("name"), "length"))
        to = cuts.where("edge IS NOT NULL").select("clade_id", "edge", "child")
        part = placed.join(broadcast_if_small(to), ["clade_id", "edge"], "left").drop("edge")
        moved = part if moved is None else moved.unionByName(part)
    if moved is not None:
        first = F.col("clade_id") == 0
        done.moved, got = measured(moved, lost=F.count_if(F.col("child").isNull() & first), top=F.count_if(F.col("child").isNull() & ~first))
        done.keep(done.moved)
        if got["lost"]:  # of the first clade: nothing tells them from the root
            out = done.keep(stored(done.moved.where(F.col("child").isNull() & first).select("clade_id", "name")))
            done.lost.append(out.withColumn("reason", F.lit("problematic")))
            metrics["discarded"] += got["lost"]
        if got["top"]:  # the edge above their clade is theirs, and none below it: leaves of the clade's top
            on = F.concat(F.lit("c"), F.col("clade_id"))
            done.nodes.append(done.keep(stored(done.moved.where(F.col("child").isNull() & ~first).select(F.concat(on, F.lit("/"), F.col("name")).alias("node"), on.alias("parent"), "name", F.lit(0.0).alias("length")))))
    if ends[None]:
        stuck = active.join(broadcast_if_small(ended.where("turn IS NULL").select("clade_id"), ends[None]), "clade_id", "left_semi")
        stuck, n = counted(stuck.select("clade_id", "name"))
        done.keep(stuck)
        if config.unresolved == "polytomy":
            done.nodes.append(stuck.select(F.concat(F.lit("c"), F.col("clade_id"), F.lit("."), F.col("name")).alias("node"), F.concat(F.lit("c"), F.col("clade_id")).alias("parent"), "name", F.lit(0.0).alias("length")))
        else:
            done.lost.append(stuck.withColumn("reason", F.lit("unresolved")))
            metrics["discarded"] += n
    return done


def _assemble(nodes: list[DataFrame], lost: list[DataFrame], twins: DataFrame | None, taxa: DataFrame, metrics: list[dict]) -> Lineage:
    """The levels' pieces as one tree (T9): node names are global, so that pieces join where their names meet."""
    spark = taxa.sparkSession
    every = nodes[0] if nodes else spark.createDataFrame([], NODES)
    for piece in nodes[1:]:
        every = every.unionByName(piece)
    # a clade's top is a tip above and a top, or a taxon's name, below
    tree = every.groupBy("node").agg(F.max("parent").alias("parent"), F.max("name").alias("name"), F.max("length").alias("length"))
    tops = every.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    tree = stored(tree.join(tops.withColumn("_inner", F.lit(True)), "node", "full").select("node", "parent", "name", "length", F.coalesce("_inner", F.lit(False)).alias("_inner")))
    if not tree.where("name IS NULL AND NOT _inner AND parent IS NOT NULL").isEmpty():
        # tips of clades that gave up have no name, and may leave parents without tips
        shape = induced_subtree(tree.select("node", "parent"), tree.where("name IS NOT NULL").select("node"))
        tree = stored(shape.join(tree.drop("parent"), "node").select(*tree.columns))
    tree = tree.drop("_inner")
    if twins is not None:
        at = tree.where("name IS NOT NULL").select("node", "name").join(twins, "name")
        leaves = stored(at.select(F.concat_ws("+", "node", "twin").alias("node"), F.col("node").alias("parent"), F.col("twin").alias("name"), F.lit(0.0).alias("length")))
        bare = tree.join(leaves.select(F.col("parent").alias("node"), F.lit(True).alias("_bare")).distinct(), "node", "left")
        tree = bare.select("node", "parent", F.when(F.col("_bare").isNull(), F.col("name")).alias("name"), "length").union(leaves)
    discarded = spark.createDataFrame([], "clade_id long, name string, reason string")
    for part in lost:
        discarded = discarded.union(part)
    if twins is not None:
        discarded = discarded.join(twins, "name", "left").select("clade_id", F.coalesce("twin", "name").alias("name"), "reason")
    return Lineage(stored(tree), stored(discarded), metrics)
