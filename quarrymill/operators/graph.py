"""Graphs as two tables: edges (and nodes) in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import rates
from quarrymill.sources.tables import cut, dealt, shuffled


def one_edge_per_pair(edges: DataFrame, seq: str) -> DataFrame:
    """A directed graph keeps one edge for (src, dst): the last written wins."""
    return edges.groupBy("src", "dst").agg(F.max_by("type", seq).alias("type"))


def type_histogram(table: DataFrame, what: str = "type") -> DataFrame:
    """How many of each type, most frequent first."""
    return table.groupBy(what).agg(F.count("*").alias("n")).orderBy(F.desc("n"), what)


def successors(edges: DataFrame, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """src, dst of the out-neighbours of `nodes` (column id), of one edge type if given."""
    e = edges.where(F.col("type") == kind) if kind else edges
    return e.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6, cut_every: int = 5) -> DataFrame:
    """id, rank (adding up to 1) and centrality (rank / largest rank).

    nodes: id; edges: src, dst among them, parallel ones counted once. The mass of nodes without out-edges is
    spread evenly. Stops when the L1 change falls below n * tolerance (never, if None) or after `iterations`.
    Each step is one join and one group-by of the edges, which stay partitioned by src; lineage is cut
    every few steps.
    """
    nodes = cut(nodes.select("id").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0)).withColumn("centrality", F.lit(0.0))
    edges = edges.select("src", "dst").distinct()
    degree = edges.groupBy("src").agg(F.count("*").alias("d"))
    weighted = cut(edges.join(degree, "src").select("src", "dst", (F.lit(1.0) / F.col("d")).alias("w")))
    dangling = cut(nodes.join(degree, nodes["id"] == degree["src"], "left").select("id", F.col("d").isNull().alias("loose")))
    ranks = dangling.withColumn("rank", F.lit(1.0 / n))
    for step in range(1, iterations + 1):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("loose"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        sent = weighted.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("rank")).alias("got"))
        new = dangling.join(sent, "id", "left").crossJoin(F.broadcast(lost))  # one row: the lost mass
        new = new.select("id", "loose", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if step % cut_every == 0 or tolerance is not None:
            new = cut(new)
        if tolerance is not None:
            change = new.alias("x").join(ranks.alias("y"), "id").agg(F.sum(F.abs(F.col("x.rank") - F.col("y.rank"))).alias("c")).first()["c"]
            ranks = new
            if change < n * tolerance:
                break
        ranks = new
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.crossJoin(F.broadcast(top)).select("id", "rank", rates.guarded(F.col("rank"), F.col("top")).alias("centrality"))


def contextual_centrality(base: DataFrame, edges: DataFrame, relevant: DataFrame) -> DataFrame:
    """id, centrality raised by the share of out-neighbours that are relevant, lowered for hubs with few of them.

    base: id, centrality; relevant: id. + 0.5 * share, - 0.25 with more than 20 neighbours of which fewer than 3
    are relevant, clamped to [0, 1]. Without neighbours, the base stays.
    """
    marks = relevant.select(F.col("id").alias("dst")).distinct().withColumn("hit", F.lit(1))
    near = edges.select("src", "dst").distinct().join(marks, "dst", "left").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("r"))
    score = F.col("centrality") + 0.5 * rates.guarded(F.col("r"), F.col("n")) - F.when((F.col("n") > 20) & (F.col("r") < 3), 0.25).otherwise(0.0)
    return base.join(near, "id", "left").select("id", F.when(F.col("n").isNull(), F.col("centrality")).otherwise(rates.clamp(score)).alias("centrality"))


def first_dotted(names: DataFrame, defined: DataFrame) -> DataFrame:
    """Call resolution: call_id, file, name -> target. A function of that name in the same file, else of its base name
    (after the last dot) there, else the first of that name in another file.

    Definitions are brought down to what a call can meet - the first of each name in a file, and the first two files of
    each name - so a call meets four rows at most, however many definitions a name has.
    """
    base = F.element_at(F.split("name", r"\."), -1)
    calls = names.select("call_id", "file", "name", base.alias("base"))
    firsts = defined.groupBy(F.col("file").alias("dfile"), F.col("name").alias("dname")).agg(F.min("seq").alias("seq"))
    two = firsts.withColumn("k", F.row_number().over(Window.partitionBy("dname").orderBy("seq", "dfile"))).where("k <= 2").drop("k")

    def stage(n: int, found: DataFrame) -> DataFrame:
        return found.select("call_id", "dfile", "dname", F.lit(n).alias("stage"), "seq")

    own = stage(1, calls.join(shuffled(firsts), (F.col("file") == F.col("dfile")) & (F.col("name") == F.col("dname"))))
    near = stage(2, calls.join(shuffled(firsts), (F.col("file") == F.col("dfile")) & (F.col("base") == F.col("dname"))))
    far = stage(3, calls.join(shuffled(two), F.col("base") == F.col("dname")).where("file <> dfile"))
    best = own.union(near).union(far).groupBy("call_id").agg(F.min(F.struct("stage", "seq", "dfile", "dname")).alias("b"))
    return calls.select("call_id").join(shuffled(best), "call_id", "left").select("call_id", F.concat_ws(":", "b.dfile", "b.dname").alias("target"), F.col("b.stage").alias("stage"))


def attached_decorators(decorators: DataFrame, defined: DataFrame, reach: int = 100, parts: int | None = None) -> DataFrame:
    """file, decorator, target: the first function that starts less than `reach` bytes after a decorator's end, else the first class.

    decorators: file, name, stop; defined: file, name, type, start. A decorator with neither is left out. parts: into how
    many the rows are dealt (see `dealt`).
    """
    # a definition within reach starts in the stretch of `reach` bytes where the decorator ends, or in the next one
    stretch = lambda place: F.floor(F.col(place) / reach)
    d = decorators.select("file", F.col("name").alias("decorator"), "stop", F.explode(F.array(stretch("stop"), stretch("stop") + 1)).alias("stretch"))
    near = defined.where(F.col("type").isin("function", "class")).select("file", F.col("name").alias("target"), "type", "start", stretch("start").alias("stretch"))
    met = dealt(d, parts, "file", "stretch").join(shuffled(dealt(near, parts, "file", "stretch")), ["file", "stretch"])
    found = met.where((F.col("start") >= F.col("stop")) & (F.col("start") - F.col("stop") < reach))
    best = dealt(found, parts, "file", "decorator", "stop").groupBy("file", "decorator", "stop").agg(F.min(F.struct((F.col("type") != "function").alias("other"), "start", "target")).alias("b"))
    return best.select("file", "decorator", F.col("b.target").alias("target"))


def evidence_pairs(evidence: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """first, second, src, dst: of two pieces of evidence (pos, id), the edge from the earlier to the later, else the one back; the first `most` by place.

    Edges meet evidence by equality at both ends, so pairs without an edge are never made.
    """
    a = edges.select("src", "dst").distinct().join(evidence.select(F.col("id").alias("src"), F.col("pos").alias("p")), "src").join(evidence.select(F.col("id").alias("dst"), F.col("pos").alias("q")), "dst").where("p <> q")
    pairs = a.select(F.least("p", "q").alias("first"), F.greatest("p", "q").alias("second"), "src", "dst", (F.col("p") > F.col("q")).alias("back"))
    best = pairs.groupBy("first", "second").agg(F.min_by(F.struct("src", "dst"), F.struct("back", "src", "dst")).alias("e"))
    return best.orderBy("first", "second").limit(most).select("first", "second", "e.src", "e.dst")
