"""Code side: owners, labels, step resolution, grounding, interface methods, inheritance by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .graph import closure

#: Functions of one name and owner that travel as a row, of which a shorter list is repeated for each of another row (files
#: shrink short repeats to little), and pairs that a task makes, about.
BLOCK, TILE, MADE = 1 << 11, 1 << 8, 1 << 21


def owner_of(functions: DataFrame, contracts: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Functions with their owner: a contract if there is one, else an interface, else unknown."""
    both = contracts.select(F.col("id").alias("owner_id"), F.col("name").alias("owner"), F.lit("contract").alias("kind"), F.lit(0).alias("p")).unionByName(
        interfaces.select(F.col("id").alias("owner_id"), F.col("name").alias("owner"), F.lit("interface").alias("kind"), F.lit(1).alias("p"))
    )
    best = both.groupBy("owner_id").agg(F.min_by(F.struct("owner", "kind"), "p").alias("o"))
    out = functions.join(best, "owner_id", "left")
    return out.select(*functions.columns, F.coalesce("o.kind", F.lit("unknown")).alias("kind"), F.coalesce("o.owner", F.lit("?")).alias("owner"))


def label(owned: DataFrame) -> DataFrame:
    """``kind owner::name @ path``."""
    return owned.select("id", F.concat(F.col("kind"), F.lit(" "), F.col("owner"), F.lit("::"), F.col("name"), F.lit(" @ "), F.col("path")).alias("label"))


def resolve_steps(steps: DataFrame, owned: DataFrame) -> DataFrame:
    """Steps (id, contract, function) -> function_id: in the contract, else the interface, of that name,
    else any function of the name; of several the smallest id; null if none."""
    named = owned.select(F.col("id").alias("fid"), F.col("name").alias("function"), "owner", "kind")
    tier = F.when(F.col("kind") == "contract", 0).otherwise(1).alias("tier")
    first = named.groupBy("owner", "function").agg(F.min(F.struct(tier, "fid")).alias("first"))  # a row a name, however many functions have it
    exact = steps.join(first, (steps["contract"] == first["owner"]) & (steps["function"] == first["function"])).select(steps["id"], "first.tier", "first.fid")
    loose = steps.select("id", "function").join(named.groupBy("function").agg(F.min("fid").alias("fid")), "function").select("id", F.lit(2).alias("tier"), "fid")
    best = exact.unionByName(loose).groupBy("id").agg(F.min(F.struct("tier", "fid")).alias("best"))
    return steps.join(best, "id", "left").select("id", "contract", "function", F.col("best.fid").alias("function_id"), F.col("best.tier").alias("tier"))


def sequence_overlap(calls: Column, sequence: Column) -> Column:
    """Whether a counterexample shares a (contract, function) pair with a specification, else at least a
    function name; null where either is empty."""
    pair = F.arrays_overlap(calls, sequence)
    name = F.arrays_overlap(F.transform(calls, lambda c: c["function"]), F.transform(sequence, lambda c: c["function"]))
    return F.when((F.size(calls) == 0) | (F.size(sequence) == 0), F.lit(None)).when(pair, "pair").when(name, "function").otherwise("disjoint")


def ground(findings: DataFrame, contracts: DataFrame, functions: DataFrame) -> DataFrame:
    """External findings (pos, contract, function) anchored without regard to case; ``reason`` says why
    a finding isn't grounded.  No contract named means the whole project."""
    c = contracts.select(F.lower("name").alias("cname"), F.col("id").alias("contract_id")).groupBy("cname").agg(F.min("contract_id").alias("contract_id"))
    f = functions.select(F.lower("name").alias("fname"), "owner_id", F.col("id").alias("function_id")).groupBy("fname", "owner_id").agg(F.min("function_id").alias("function_id"))
    out = findings.join(c, F.lower("contract") == F.col("cname"), "left")
    out = out.join(f, (F.lower("function") == F.col("fname")) & (F.col("contract_id") == F.col("owner_id")), "left")
    reason = F.when(F.col("contract").isNotNull() & F.col("contract_id").isNull(), "unknown contract").when(
        F.col("contract").isNotNull() & F.col("function").isNotNull() & F.col("function_id").isNull(), "unknown function"
    )
    return out.select("pos", "contract_id", "function_id", reason.alias("reason"))


def interface_methods(functions: DataFrame, inherits: DataFrame, owners: DataFrame) -> DataFrame:
    """(id, target), each pair once: for each function the functions of its name in its owner, where concrete, and in
    all that inherit from it.  Ancestors are followed from owners of functions only.  Pairs of functions of one row
    each can't repeat, so only others are compared: what is shuffled is lists of functions, not pairs."""
    rows = functions.select("id", "owner_id", "name").distinct()
    rows = cut(rows.join(rows.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("again")), "id"))
    owning = rows.select(F.col("owner_id").alias("node")).distinct()
    down = closure(inherits, "contract_id", "inherited_id", owning).select(F.col("ancestor").alias("owner_id"), F.col("node").alias("impl"))
    own = owners.where("concrete").select(F.col("id").alias("owner_id"), F.col("id").alias("impl")).join(owning.select(F.col("node").alias("impl")), "impl", "left_semi")
    reach = cut(own.select("owner_id", "impl").unionByName(down).distinct())

    def pairs(of: DataFrame, to: DataFrame) -> DataFrame:
        target = to.select(F.col("id").alias("target"), F.col("owner_id").alias("impl"), "name")
        return of.join(reach, "owner_id").join(target, ["impl", "name"]).select("id", "target")

    once, again = rows.where("NOT again"), rows.where("again")
    return _crossed(once, reach).unionByName(pairs(again, rows).unionByName(pairs(once, again)).distinct())


def _crossed(rows: DataFrame, reach: DataFrame) -> DataFrame:
    """Pairs of functions by blocks: a row a pair of blocks is dealt out evenly and made into its pairs where it lies."""
    size = rows.groupBy("owner_id", "name").agg(F.count(F.lit(1)).alias("n"))
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).alias("block")
    blocks = cut(rows.join(size, ["owner_id", "name"]).groupBy("owner_id", "name", block).agg(F.collect_list("id").alias("ids")))
    target = blocks.select(F.col("owner_id").alias("impl"), "name", F.col("ids").alias("targets"))
    met = blocks.join(reach, "owner_id").join(target, ["impl", "name"]).select("ids", "targets")
    total = size.join(reach, "owner_id").join(size.select(F.col("owner_id").alias("impl"), "name", F.col("n").alias("m")), ["impl", "name"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    met = met.repartition(-(-(total or 1) // MADE))
    tiles = F.transform(F.sequence(F.lit(0), F.expr(f"(size(targets) - 1) div {TILE}").cast("int")), lambda i: F.slice("targets", i * TILE + 1, TILE))
    return met.select("ids", F.explode(tiles).alias("tile")).select(F.explode("ids").alias("id"), "tile").select("id", F.explode("tile").alias("target"))


def inherit_by_name(contracts: DataFrame, bases: DataFrame) -> DataFrame:
    """(contract_id, base) by name -> all contracts of that name but itself; unresolved bases stay with null."""
    named = contracts.select(F.col("name").alias("base"), F.col("id").alias("inherited_id"))
    hit = bases.join(named, "base").where("contract_id <> inherited_id").select("contract_id", "base", "inherited_id")
    return hit.unionByName(bases.join(hit, ["contract_id", "base"], "left_anti").select("contract_id", "base", F.lit(None).cast("int").alias("inherited_id")))


def in_scope(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """Wanted paths, each with whether it is available."""
    return wanted.join(available.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").select("path", F.coalesce("there", F.lit(False)).alias("available"))
