"""A Merkle manifest of a dataset: a root for all rows, one a group, and for each row the proof that it is under them.

Rows are leaves of their group's tree, in order; groups' roots are leaves of one tree above. The lowest levels are hashed
inside blocks of FANOUT ** LEVELS leaves. Above, blocks find their proofs by a butterfly exchange: round by round, the blocks under one node swap
its children's hashes with the partners in the sibling subtrees and all hash the parent themselves. So each block holds every hash
on its way to the root, and those beside them, when the last round ends: nothing is passed down again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmend.llm.common import settle, small, written
from pairmend.llm.order import placed

FANOUT, LEVELS = 3, 6
#: Rounds of exchange between two settled tables.
ROUNDS = 8

PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def leaf(*columns: Column) -> Column:
    """The hash of a row: each value as its bytes' count, a colon and itself, or - for a null."""
    texts = [c.cast("string") for c in columns]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the hashes beside its way up come to."""
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proof(path: Column) -> Column:
    """All hashes beside the way up, lowest first and left to right, as one text."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def _parents(nodes: Column, fanout: int) -> Column:
    n = ((F.size(nodes) - 1) / fanout).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.sha2(F.array_join(F.slice(nodes, i * fanout + 1, fanout), ""), 256))


def _depth(n: Column, fanout: int) -> Column:
    """How many levels bring n nodes down to one."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(39 if fanout > 2 else 62)), lambda k: F.pow(F.lit(float(fanout)), k) < n)
    return F.size(F.filter(steps, lambda x: x))


def _levels(leaves: Column, depth: Column, most: int, fanout: int) -> Column:
    """The nodes of each level of a block, from its leaves up, depth levels above them."""
    steps = F.slice(F.array(*[F.lit(k) for k in range(most)]), 1, depth)
    return F.aggregate(steps, F.array(leaves), lambda up, _: F.concat(up, F.array(_parents(F.element_at(up, -1), fanout))))


def _beside(levels: Column, at: Column, fanout: int) -> Column:
    """The path of the block's leaf at a place (from 0), up to the block's root."""

    def step(level: Column, k: Column) -> Column:
        own = F.floor(at / F.pow(F.lit(float(fanout)), k)).cast("int")
        first = own - own % fanout
        return F.struct(
            F.array_join(F.slice(level, first + 1, own - first), "").alias("left"),
            F.array_join(F.slice(level, own + 2, first + fanout - 1 - own), "").alias("right"),
        )

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def _round(units: DataFrame, bounds: Column, going: Column, fanout: int) -> DataFrame:
    """One exchange: units (at, node, path, ...) learn the hashes beside theirs and hash the parent.

    bounds says where the parent's children begin and end among the units, fanout + 1 places, in order. A unit sends its node to
    its partners, those at its own offset in each sibling subtree; one in a shorter subtree sends on to every offset
    that its own stands for, so that each unit hears each sibling once. Units that aren't going keep what they have.
    """
    rest = [c for c in units.columns if c != "at"]
    units = units.withColumn("__b", bounds).withColumn("__going", going)
    own = F.size(F.filter(F.slice("__b", 2, fanout), lambda x: x <= F.col("at")))
    units = units.withColumn("__p", own)
    begin, end = F.element_at("__b", F.col("__p") + 1), F.element_at("__b", F.col("__p") + 2)
    offset, size = F.col("at") - begin, end - begin

    def to(k: int) -> Column:
        first, last = F.element_at("__b", k + 1) + offset, F.element_at("__b", k + 2) - 1
        there = F.col("__going") & (F.col("__p") != k) & (first <= last)
        return F.when(there, F.sequence(first, last, size)).otherwise(F.array().cast("array<bigint>"))

    sent = F.transform(F.concat(*[to(k) for k in range(fanout)]), lambda x: F.struct(x.alias("at"), F.lit(False).alias("own")))
    sent = F.concat(F.array(F.struct(F.col("at").cast("bigint").alias("at"), F.lit(True).alias("own"))), sent)
    mail = units.withColumn("__m", F.explode(sent)).select(
        F.col("__m.at").alias("at"), F.struct(F.col("__p").alias("p"), F.col("node").alias("node")).alias("heard"),
        F.when(F.col("__m.own"), F.struct(F.col("__p").alias("p"), F.col("__going").alias("going"), *rest)).alias("kept"),
    )
    met = mail.groupBy("at").agg(F.array_sort(F.collect_list("heard")).alias("heard"), F.first("kept", ignorenulls=True).alias("kept"))
    side = lambda cmp: F.array_join(F.transform(F.filter("heard", cmp), lambda h: h["node"]), "")
    step = F.struct(side(lambda h: h["p"] < F.col("kept.p")).alias("left"), side(lambda h: h["p"] > F.col("kept.p")).alias("right"))
    goes = F.col("kept.going")
    new = {
        "node": F.when(goes, F.sha2(F.array_join(F.transform("heard", lambda h: h["node"]), ""), 256)).otherwise(F.col("kept.node")),
        "path": F.when(goes, F.concat("kept.path", F.array(step))).otherwise(F.col("kept.path")),
    }
    return met.select("at", *[new.get(c, F.col(f"kept.{c}")).alias(c) for c in rest])


def _spans(groups: DataFrame, n_groups: int, n_units: int, rounds: int, fanout: int) -> DataFrame:
    """groups (rank, first) with spans: for each level above the groups, where the children of the group's ancestor begin and end."""
    out = groups.withColumn("spans", F.array().cast("array<array<bigint>>"))
    for level in range(rounds):
        width = fanout**level
        run = F.floor(F.col("rank") / (width * fanout)).cast("long")
        of = groups.filter(F.col("rank") % width == 0).groupBy(run.alias("__run")).agg(F.array_sort(F.collect_list("first")).alias("__firsts"))
        last = F.array(F.lit(n_units).cast("bigint"))
        nexts = of.select((F.col("__run") - 1).alias("__run"), F.slice("__firsts", 1, 1).alias("__end"))
        of = of.join(nexts, "__run", "left").select("__run", F.concat("__firsts", F.coalesce("__end", last)).alias("__firsts"))
        # A run of fewer children than fanout ends early: the missing ones are empty.
        of = settle(of.select("__run", F.concat("__firsts", F.array_repeat(F.element_at("__firsts", -1), fanout + 1 - F.size("__firsts"))).alias("__span")))
        out = out.withColumn("__run", run).join(small(of), "__run").withColumn("spans", F.concat("spans", F.array("__span"))).drop("__run", "__span")
    return out


def manifest(rows: DataFrame, leaf_of: Column, group: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """group, order, leaf, subroot, root, path and the carried columns, for every row: rows' texts are read once and stay where they are.

    Leaves ascend by order within a group, groups by their values, nulls first. While more than one node of a group remains, every
    `fanout` consecutive ones (the last run may be shorter, even one) become the hash of them in order; what remains is the
    group's subroot, and subroots become the root likewise. path is what stands left and right of the way from the leaf to the root.

    Narrow rows are placed exactly by ranges, put together in blocks of fanout ** levels, and written to the shared folder. A round of the
    exchange is one shuffle of a row a block and a message a sibling; rounds grow with the logarithm of the groups' sizes and count.
    Defined results: null and repeated values of order are leaves like others, equal ones by leaf; a null group is a group; a group's
    only leaf is its subroot, and an only subroot is the root; other columns aren't read; no rows, no manifest.
    """
    carry, block = carry or {}, fanout**levels
    leaves = settle(rows.select(F.col(group).cast("string").alias("grp"), F.col(order).alias("ord"), leaf_of.alias("leaf"), *[c.alias(f"carry_{n}") for n, c in carry.items()]))
    carried = [f"carry_{n}" for n in carry]
    groups = leaves.groupBy("grp").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    groups = settle(placed(groups, F.asc("grp"), into="rank", sums={"begins": "n", "first": "blocks"}))
    shape = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("units"), F.coalesce(F.max("blocks"), F.lit(0)).alias("most")).first()
    depth = lambda n: next(k for k in range(100) if fanout**k >= max(n, 1))
    inner, outer = depth(shape["most"]), depth(shape["groups"])

    spread = placed(leaves.withColumn("__row", F.monotonically_increasing_id()), F.asc("grp"), F.asc("ord"), F.asc("leaf"), F.asc("__row"), into="place").drop("__row")
    here = spread.join(small(groups.select("grp", "begins", "first", "n").withColumnRenamed("grp", "__g")), F.col("grp").eqNullSafe(F.col("__g")))
    here = here.withColumn("place", F.col("place") - F.col("begins"))
    at = F.col("first") + F.floor(F.col("place") / block).cast("long")
    blocks = here.groupBy(at.alias("at")).agg(
        F.first("grp").alias("grp"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct((F.col("place") % block).cast("int").alias("k"), "leaf", F.col("ord"), *carried))).alias("rows"),
    )
    nodes = _levels(F.transform("rows", lambda r: r["leaf"]), F.least(F.lit(levels), _depth(F.col("n"), fanout)), levels, fanout)
    blocks = written(blocks.withColumn("node", F.element_at(F.element_at(nodes, -1), 1)), "blocks")

    units = blocks.select("at", "grp", "node", F.array().cast(PATH).alias("path"))
    spans = _spans(groups, shape["groups"], shape["units"], outer, fanout)
    spans = settle(spans.select(F.col("grp").alias("__g"), "first", F.col("blocks").alias("many"), "spans"))
    units = units.join(spans, F.col("grp").eqNullSafe(F.col("__g"))).drop("grp", "__g").withColumn("subroot", F.lit(None).cast("string"))
    for k in range(inner):
        # In a group, the children of a node are as wide as the round says, and the last ends with the group.
        own = F.floor((F.col("at") - F.col("first")) / fanout ** (k + 1)).cast("long") * fanout ** (k + 1)
        bounds = F.array(*[F.col("first") + F.least(F.col("many"), own + j * fanout**k) for j in range(fanout + 1)])
        units = _round(units, bounds, F.col("many") > fanout**k, fanout)
        units = settle(units) if k % ROUNDS == ROUNDS - 1 else units
    units = units.withColumn("subroot", F.col("node"))
    for k in range(outer):
        units = _round(units, F.element_at("spans", k + 1), F.lit(True), fanout)
        units = settle(units) if k % ROUNDS == ROUNDS - 1 else units
    proven = settle(units.select("at", F.col("node").alias("root"), "subroot", F.col("path").alias("above")))

    out = blocks.join(proven, "at").withColumn("levels", nodes)
    out = out.select("grp", "root", "subroot", "above", "levels", F.explode("rows").alias("r"))
    path = F.concat(_beside(F.col("levels"), F.col("r.k"), fanout), F.col("above"))
    return out.select(F.col("grp").alias(group), F.col("r.ord").alias(order), "r.leaf", "subroot", "root", path.alias("path"), *[F.col(f"r.carry_{n}").alias(n) for n in carry])


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def tamper_evidence(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, for documents of which some lost their line breaks.

    Documents whose decimal doc_id has an even CRC-32 are tampered with; folded_root is what their changed text and the
    original hashes beside it come to, and verified says whether that is the root. A null doc_id is left alone.
    """
    cut = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(cut, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    seen = leaf(*[F.col(c) for c in COLUMNS[:-1]], text)
    made = manifest(docs, leaf(*[F.col(c) for c in COLUMNS]), carry={"seen": seen})
    made = made.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(F.col("seen"), F.col("path")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))
