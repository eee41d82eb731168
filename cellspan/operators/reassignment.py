"""Hard reassignment of molecules to the cells around them, and the rules that the moves give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellspan.functions.columns import binomial_tail
from cellspan.operators import nearest
from cellspan.operators.staging import cut

#: Repeated numbers of molecules that are looked up by broadcast; beyond that all molecules shuffle by their number.
FEW = 100_000


def once(molecules: DataFrame) -> DataFrame:
    """Staged molecules with one row a number (mol), the least of every other column; only the numbers shuffle unless more than FEW are repeated."""
    least = lambda df: df.groupBy("mol").agg(*(F.min(c).alias(c) for c in df.columns if c != "mol"))
    twice = cut(molecules.groupBy("mol").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("mol").alias("again")), "twice")
    n = twice.count()
    if n > FEW:
        return cut(least(molecules), "molecules")
    if not n:
        return molecules
    same = F.col("mol").eqNullSafe(F.col("again"))
    merged = cut(least(molecules.join(F.broadcast(twice), same, "left_semi")), "merged")
    return molecules.join(F.broadcast(twice), same, "left_anti").unionByName(merged)


def moves(molecules: DataFrame, cells: DataFrame, radius: float = 8.0, most: int = 8, bonus: float = 2.0, full: int = 1024) -> DataFrame:
    """What reassigned() gives of staged molecules (mol, factor, cell, x, y) among their candidates() of cells (cell, x, y), by the cells' shares of them.

    Molecules go through one shuffle, to squares twice as wide as the radius.  A square has the cells within the radius of it, and those of its
    own molecules wherever they lie, as one array with their shares.  Molecules of squares with more than ``full`` cells and shares in their
    arrays take the way over candidates(), whose bins fit the density.
    """
    side, reach = 2 * radius, radius * 1.001
    gx, gy = (F.coalesce(F.floor(F.col(c) / side), F.lit(0)) for c in "xy")  # without a place: any square, nothing is near
    n = molecules.groupBy("cell", "factor").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(
        F.sum("n").alias("all"), F.collect_list(F.when(F.col("factor").isNotNull(), F.struct("factor", "n"))).alias("n")
    )
    shares = n.select("cell", F.map_from_entries(F.transform("n", lambda e: F.struct(e["factor"], e["n"] / F.col("all")))).alias("shares"))
    known = cut(cells.select("cell", "x", "y").join(shares, "cell", "full"), "shares")
    around = known
    for c in "xy":
        around = around.withColumn(f"g{c}", F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))))
    cover = cut(around.select("cell", "gx", "gy").unionByName(molecules.select("cell", gx.alias("gx"), gy.alias("gy"))).distinct(), "cover")
    size = F.sum(1 + F.coalesce(F.size("shares"), F.lit(0))).alias("size")
    dense = cut(cover.join(known.hint("shuffle_hash"), "cell").groupBy("gx", "gy").agg(size).where(F.col("size") > full).drop("size"), "dense")
    crowded = not dense.isEmpty()
    if crowded:
        cover = cover.join(dense, ["gx", "gy"], "left_anti")
    near = cover.join(known.hint("shuffle_hash"), "cell").groupBy("gx", "gy").agg(F.collect_list(F.struct("cell", "x", "y", "shares")).alias("near"))
    here = lambda squares: (gx == squares["gx"]) & (gy == squares["gy"])

    share = lambda b: F.coalesce(F.try_element_at(b["shares"], F.col("factor")), F.lit(0.0))
    d2 = lambda b: (F.col("x") - b["x"]) * (F.col("x") - b["x"]) + (F.col("y") - b["y"]) * (F.col("y") - b["y"])
    others = F.transform(F.filter("near", lambda b: (b["cell"] != F.col("was")) & (d2(b) <= radius * radius)), lambda b: F.struct(d2(b).alias("d2"), b["cell"].alias("cell"), share(b).alias("share")))
    m = molecules.where("mol is not null").withColumnRenamed("cell", "was").join(near.hint("shuffle_hash"), here(near))
    m = m.select(
        "mol", "factor", "was", share(F.get(F.filter("near", lambda b: b["cell"] == F.col("was")), F.lit(0))).alias("own"),
        F.slice(F.sort_array(others), 1, most - 1).alias("others"),
    )
    all_ = F.aggregate("others", F.col("own"), lambda s, b: s + b["share"])
    m = m.select("mol", "factor", "was", "own", all_.alias("all"), F.array_min(F.transform("others", lambda b: F.struct(F.round(-b["share"], 12).alias("w"), b["cell"].alias("cell"), b["share"].alias("share")))).alias("b"))
    m = m.withColumn("goes", F.coalesce(F.col("b.w") < F.round(-bonus * F.col("own"), 12), F.lit(False)))
    later = F.col("all") + (bonus - 1) * F.when(F.col("goes"), F.col("b.share")).otherwise(F.col("own"))
    out = m.select("mol", "factor", "was", F.when(F.col("goes"), F.col("b.cell")).otherwise(F.col("was")).alias("cell"), (F.col("all") + (bonus - 1) * F.col("own")).alias("first"), later.alias("later"))
    if crowded:
        hard = cut(molecules.join(dense, here(dense), "left_semi"), "crowded")
        fractions = known.select("cell", F.explode("shares").alias("factor", "share"))
        out = out.unionByName(reassigned(hard, candidates(hard, cells, radius, most), fractions, bonus))
    return out


def candidates(molecules: DataFrame, cells: DataFrame, radius: float = 8.0, most: int = 8) -> DataFrame:
    """(mol, cell): the own cell of each molecule (mol, cell, x, y), and of others (cell, x, y) the most - 1 nearest within radius (ties to the smaller)."""
    # Molecules and cells are numbered apart, so that no cell is taken for the molecule of its number.
    left = molecules.select((-1 - F.col("mol")).alias("cell_idx"), F.col("x").alias("centroid_x"), F.col("y").alias("centroid_y"))
    right = cells.select(F.col("cell").alias("cell_idx"), F.col("x").alias("centroid_x"), F.col("y").alias("centroid_y"))
    near = nearest.nearest(left, right, most, far=radius).select((-1 - F.col("src")).alias("mol"), F.col("dst").alias("cell"), "rank")
    own = molecules.select("mol", F.col("cell").alias("own"))
    # A molecule has ``most`` rows here: of them one too many is there where the own cell is not among them.
    others = near.join(own, "mol").withColumn("before", F.max(F.when(F.col("cell") == F.col("own"), F.col("rank"))).over(Window.partitionBy("mol")))
    others = others.where((F.col("cell") != F.col("own")) & (F.col("rank") - F.when(F.col("rank") > F.col("before"), 1).otherwise(0) < most))
    return own.select("mol", F.col("own").alias("cell")).unionByName(others.select("mol", "cell"))


def reassigned(molecules: DataFrame, near: DataFrame, fractions: DataFrame, bonus: float = 2.0) -> DataFrame:
    """(mol, factor, was, cell, first, later) of molecules (mol, factor, cell) among their candidates (mol, cell).

    A candidate's weight is its share (cell, factor, share; 0 where there is no row) of the molecule's factor, times bonus for the cell that holds it; the
    greatest wins, ties to the holder, then to the smaller cell.  One round is all there is: shares stay as they are, so the winner, which
    then has the bonus, wins every later round.  first and later are the sums of weights in the first round and in those after it.
    """
    c = near.join(molecules.select("mol", "factor", F.col("cell").alias("was")), "mol").join(fractions, ["cell", "factor"], "left")
    c = c.withColumn("share", F.coalesce("share", F.lit(0.0))).withColumn("w", F.col("share") * F.when(F.col("cell") == F.col("was"), bonus).otherwise(1.0))
    best = F.min_by(F.struct("cell", "share"), F.struct(F.round(-F.col("w"), 12), F.col("cell") != F.col("was"), "cell"))
    g = c.groupBy("mol", "factor", "was").agg(F.sum("w").alias("first"), F.sum("share").alias("all"), best.alias("b"))
    return g.select("mol", "factor", "was", F.col("b.cell").alias("cell"), "first", (F.col("all") + (bonus - 1) * F.col("b.share")).alias("later"))


def history(moves: DataFrame, rounds: int = 4) -> DataFrame:
    """(round, log_lik, n_moved) of reassigned(): the log-likelihood of every round, and the molecules that it moves."""
    ln = lambda c: F.sum(F.ln(F.greatest(F.col(c), F.lit(1e-30))))
    one = moves.agg(ln("first").alias("first"), ln("later").alias("later"), F.count_if(F.col("cell") != F.col("was")).alias("n"))
    rows = one.select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    begin = F.col("round") == 1
    return rows.select("round", F.when(begin, F.col("first")).otherwise(F.col("later")).alias("log_lik"), F.when(begin, F.col("n")).otherwise(0).alias("n_moved"))


def rules(moves: DataFrame, types: DataFrame, least: int = 30, rate: float = 0.05) -> DataFrame:
    """(factor, source, target, n_in_target, n_moved, rate, p): of the molecules of a factor in cells of a type (target), where most of those that moved went.

    types: (cell, cell_type); cells without a type count neither as targets nor as sources.  A rule needs ``least`` molecules in the target, another type as
    the most frequent goal (ties to the first type), and its share of all of them to be at least ``rate``; p is the tail of 0.05.
    """
    t = lambda c, n: types.where("cell_type is not null").select(F.col("cell").alias(c), F.col("cell_type").alias(n))
    m = moves.groupBy("factor", "was", "cell").agg(F.count(F.lit(1)).alias("k"))  # fewer to shuffle than moves
    m = m.join(t("was", "target").hint("shuffle_hash"), "was").join(t("cell", "source").hint("shuffle_hash"), "cell", "left")
    gone = F.col("cell") != F.col("was")
    n = m.groupBy("factor", "target", F.when(gone, F.col("source")).alias("source")).agg(F.sum("k").alias("k"))
    top = F.min_by(F.struct("source", "k"), F.when(F.col("source").isNotNull(), F.struct(-F.col("k"), "source")))
    g = n.groupBy("factor", "target").agg(F.sum("k").alias("n_in_target"), top.alias("top"))
    g = g.select("factor", F.col("top.source").alias("source"), "target", "n_in_target", F.col("top.k").alias("n_moved")).withColumn("rate", F.col("n_moved") / F.col("n_in_target"))
    kept = g.where((F.col("n_in_target") >= least) & (F.col("source") != F.col("target")) & (F.col("rate") >= rate))
    return kept.withColumn("p", F.greatest(binomial_tail(F.col("n_moved"), F.col("n_in_target"), F.lit(0.05)), F.lit(1e-300)))
