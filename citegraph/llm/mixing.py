"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes per source give targets: shares by weight, none above ``cap`` times the source, the excess shared anew by weight.
2. A target of f full passes and a remainder takes every document f times and, once more, documents of the remainder. Each
   source is cut by a keyed hash into ``BLOCKS`` blocks of ``BLOCKS`` cells; in the hash order of blocks, cells and documents
   the remainder takes what fits, so a running sum never covers more than ``BLOCKS`` rows or one cell. The same steps repeat on
   the free documents that are no longer than the rest until none is left, so a long document never ends the filling. A source
   that still misses its target exchanges copies: a dynamic programme over sums of a few short documents' copies.
3. Every source's block quota is split among the output shards by a binary tree of shards: at each node the left half of the
   shards receives a hypergeometric part of every source's blocks, the right half the rest. Leaves hold exact quotas, and
   each source's permuted blocks are dealt to the leaves by their running quotas, so shards are disjoint.
4. A shard orders its rows by a keyed hash.

All steps are DataFrame functions. Nothing but one row per source and 2 rows per tree node and source is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, numbered, split_by, table, text_of, unused

# Fixed values of the contract: weights by rank of the source, repeated, and the highest number of passes.
WEIGHTS = (5, 2, 1)
CAP = 3
BLOCKS = 256
LEVELS = 5
SEED = 17
# Sources that miss by a larger share exchange copies of documents of up to REACH words, TRADED from either end.
NEAR = 0.001
TRADED = 8
REACH = 4096


def words(text) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def part(parts: int, *keys) -> Column:
    """Keyed hash into ``parts`` numbers."""
    return F.pmod(F.xxhash64(*[F.lit(k) if isinstance(k, (int, str)) else k for k in keys]), F.lit(parts)).cast("int")


def uniform(*keys) -> Column:
    return part(2**31 - 1, *keys) / F.lit(float(2**31 - 1))


def block_of(seed: int, doc_id: Column) -> Column:
    return part(BLOCKS, seed, "block", doc_id)


def place_of(seed: int, doc_id: Column) -> Column:
    """Key that shuffles a shard."""
    return F.xxhash64(F.lit(seed), F.lit("place"), doc_id)


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, weight): min(cap * size, level * weight), summing to all sizes.

    The level is found in one pass over sources ordered by the level at which each reaches its
    cap: with those before it capped, the first source whose level does not exceed its own
    reach names the level of all. One row per source is ordered, never a document.
    """
    reach = F.col("source_size") * cap / F.col("weight")
    ordered = Window.orderBy("_reach", "source")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    onward = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    levels = sources.withColumn("_reach", reach).select(
        "*", F.sum("source_size").over(everything).alias("_total"),
        F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)).alias("_capped"),
        F.sum("weight").over(onward).alias("_open"),
    ).withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
    level = F.min(F.when(F.col("_level") <= F.col("_reach"), F.col("_reach"))).over(everything)
    first = F.min(F.when(F.col("_reach") == level, F.col("_level"))).over(everything)
    return levels.select(
        *sources.columns, F.least(F.col("source_size") * float(cap), F.coalesce(first, F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def weighted(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    return sizes.withColumn("weight", F.element_at(
        F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_code_point) - 1, F.lit(len(weights))) + 1).cast("int"),
    ))


def fitting(df: DataFrame, keys: list[str], order: list, size: str, room: Column) -> DataFrame:
    """Adds ``_before``, the sizes ahead within ``keys``, and ``_fits``: the row ends within ``room``."""
    ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(size).over(ahead), F.lit(0))).withColumn(
        "_fits", F.col("_before") + F.col(size) <= room)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(blocks: Column, left: Column, right: Column, u: Column) -> Column:
    """Of ``blocks`` blocks, how many of them fall into ``left`` of ``left + right`` places: inverse distribution at u.

    Weights follow the ratio of neighbouring terms from the lowest possible count, as running
    sums of logarithms, shifted by their largest value. The array is as long as the quota, which
    BLOCKS bounds.
    """
    def log_weights(low: Column, high: Column) -> Column:
        return F.aggregate(
            F.sequence(low, high), F.array(F.lit(0.0)),
            lambda acc, x: F.when(x == high, acc).otherwise(F.concat(acc, F.array(
                F.element_at(acc, -1)
                + F.log((blocks - x) * (left - x) * F.lit(1.0)) - F.log((x + 1) * (right - blocks + x + 1) * F.lit(1.0))
            ))),
        )

    def position(parts: Column, bound: Column) -> Column:
        return F.aggregate(
            parts, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
            lambda a, v: F.struct((a["sum"] + v).alias("sum"), (a["n"] + F.when(a["sum"] + v < bound, 1).otherwise(0)).alias("n")),
        )["n"]

    low, high = F.greatest(F.lit(0), blocks - right), F.least(blocks, left)
    return let(log_weights(low, high), lambda logs: let(F.array_max(logs), lambda most: let(
        F.transform(logs, lambda v: F.exp(v - most)), lambda parts: let(
            F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) * u, lambda bound: F.least(low + position(parts, bound), high)))))


def quotas(blocks: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """Rows (source, shard, quota) from (source, n_blocks): the leaves of the splitting tree.

    At a node holding T blocks the left child has T // 2 places. Sources are drawn one after
    the other, each from the places its predecessors left, which is the multivariate law; the
    predecessors' draws travel in the node's list of sources.
    """
    root = blocks.groupBy(F.lit(0).alias("shard")).agg(
        F.sort_array(F.collect_list(F.struct("source", F.col("n_blocks").cast("int").alias("n")))).alias("parts"))
    kind = "struct<left:int,right:int,draws:array<struct<source:string,n:int,l:int>>>"
    nodes = root
    for depth in range(levels):
        nodes = nodes.withColumn("depth", F.lit(depth))
        total = F.aggregate("parts", F.lit(0), lambda a, p: a + p["n"])
        start = F.struct(
            F.floor(total / 2).cast("int").alias("left"), (total - F.floor(total / 2)).cast("int").alias("right"),
            F.array().cast("array<struct<source:string,n:int,l:int>>").alias("draws"),
        ).cast(kind)

        def draw(acc, p):
            got = hypergeometric(p["n"], acc["left"], acc["right"], uniform(seed, F.col("depth"), F.col("shard"), p["source"])).cast("int")
            return F.struct(
                (acc["left"] - got).alias("left"), (acc["right"] - p["n"] + got).alias("right"),
                F.concat(acc["draws"], F.array(F.struct(p["source"].alias("source"), p["n"].alias("n"), got.alias("l")))).alias("draws"),
            ).cast(kind)

        drawn = F.aggregate("parts", start, draw)["draws"]
        nodes = nodes.select("shard", drawn.alias("d")).select(F.explode(F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.transform("d", lambda p: F.struct(p["source"].alias("source"), p["l"].alias("n"))).alias("parts")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), F.transform(
                "d", lambda p: F.struct(p["source"].alias("source"), (p["n"] - p["l"]).alias("n"))).alias("parts")),
        )).alias("c")).select("c.*")
    return nodes.select("shard", F.explode("parts").alias("p")).select("p.source", "shard", F.col("p.n").alias("quota"))


def filled(free: DataFrame, gaps: DataFrame, seed: int) -> DataFrame:
    """Rows (_row) of ``free`` (_row, key, source, block, cell, size) that fill the ``gap`` of their source, given by rows (source, gap).

    A round takes the documents no longer than the rest in the order of blocks, cells and documents up to the first that does
    not fit, which is longer than what is left then. Rounds end when no free document is as short as the rest of its source.
    Before each round and at the end the free document nearest to the rest could be the last one; of these endings the one
    nearest to the target is kept, so going on never makes a source miss by more.
    """
    def near(rows: DataFrame, gaps: DataFrame) -> DataFrame:
        gaps = gaps.withColumnRenamed("source", "g_source")
        return materialise(rows.join(gaps, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source").where("size > 0 and size < 2 * gap"))

    def endings(rows: DataFrame, gaps: DataFrame, number: int) -> DataFrame:
        alone = gaps.where("gap > 0").select("source", F.col("gap").alias("off"), F.lit(None).cast("long").alias("_row"))
        last = rows.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("_row"))).alias("p")).select("source", "p.*")
        return alone.unionByName(last).withColumn("round", F.lit(number))

    rows, number = near(free, gaps), 0
    ends, taken = endings(rows, gaps, 0), free.select("_row", "source", F.lit(0).alias("round")).limit(0)
    while not rows.where("size <= gap").isEmpty():
        longer, rows = rows.where("size > gap"), rows.where("size <= gap")
        cells = rows.groupBy("source", "block", "cell").agg(F.sum("size").alias("cell_size"), F.first("gap").alias("gap"))
        blocks = cells.groupBy("source", "block").agg(F.sum("cell_size").alias("block_size"), F.first("gap").alias("gap"))
        permuted = [uniform(seed, "order", F.col("source"), F.col("block")), F.col("block")]
        blocks = fitting(blocks, ["source"], permuted, "block_size", F.col("gap")).where(F.col("_before") < F.col("gap")).select(
            F.col("source").alias("b_source"), F.col("block").alias("b_block"), F.col("_fits").alias("block_fits"), (F.col("gap") - F.col("_before")).alias("b_room"))
        in_block = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block"))
        cells = cells.join(blocks, in_block)
        inner = fitting(cells.where("not block_fits"), ["source"], ["cell"], "cell_size", F.col("b_room")).where(F.col("_before") < F.col("b_room"))
        open_cells = cells.where("block_fits").select("source", "block", "cell", F.lit(True).alias("whole"), F.lit(0.0).alias("c_room")).unionByName(
            inner.select("source", "block", "cell", F.col("_fits").alias("whole"), (F.col("b_room") - F.col("_before")).cast("double").alias("c_room")))
        open_cells = open_cells.select(F.col("source").alias("c_source"), F.col("block").alias("c_block"), F.col("cell").alias("c_cell"), "whole", "c_room")
        placed = rows.join(open_cells, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("block") == F.col("c_block")) & (F.col("cell") == F.col("c_cell")), "left")
        placed = materialise(placed.select(*rows.columns, "whole", "c_room"))
        edge = fitting(placed.where("not whole"), ["source"], ["size", "key", "_row"], "size", F.col("c_room"))
        decided = materialise(placed.where("whole is null or whole").withColumn("hit", F.coalesce("whole", F.lit(False))).select(*rows.columns, "hit").unionByName(
            edge.select(*rows.columns, F.col("_fits").alias("hit"))))
        taken = taken.unionByName(decided.where("hit").select("_row", "source", F.lit(number).alias("round")))
        gaps = materialise(decided.groupBy("source").agg((F.first("gap") - F.sum(F.when(F.col("hit"), F.col("size")).otherwise(0))).alias("gap")))
        rows, number = near(decided.where("not hit").drop("hit", "gap").unionByName(longer.drop("gap")), gaps), number + 1
        ends = ends.unionByName(endings(rows, gaps, number))
    best = materialise(ends.groupBy("source").agg(F.min(F.struct("off", "round", "_row")).alias("e")).select(F.col("source").alias("e_source"), "e.round", "e._row"))
    before = taken.withColumnRenamed("round", "taken_in").join(best.drop("_row"), F.col("source").eqNullSafe(F.col("e_source"))).where("taken_in < round")
    return before.select("_row").unionByName(best.where("_row is not null").select("_row"))


def exchanges(rows: DataFrame, cap: int) -> DataFrame:
    """Rows (_row, change): copies to add or give back, from stored rows (_row, key, source, size, copies, target).

    Only sources that miss their target by more than ``NEAR`` of it take part, and of each at most 2 * ``TRADED`` documents: the
    shortest and those nearest in size to the gap, among up to eight of every size. Each may have 0 to ``cap`` copies. The sums that the first
    k documents can reach, at most 2 * ``REACH`` + 1 of them, form one array per k; the sum nearest to the gap is then traced
    back through the arrays, unchanged documents first. An exchange never makes a source miss by more.
    """
    gaps = rows.groupBy("source").agg(F.first("target").alias("g_target"), F.sum(F.col("copies") * F.col("size")).alias("g_taken"))
    gaps = materialise(gaps.select(F.col("source").alias("g_source"), (F.col("g_target") - F.col("g_taken")).alias("gap"), "g_target").where(
        F.abs("gap") > F.col("g_target") * NEAR).drop("g_target"))
    if gaps.isEmpty():
        return rows.select("_row", F.lit(0).alias("change")).limit(0)
    near = rows.where((F.col("size") > 0) & (F.col("size") <= REACH)).join(gaps, F.col("source").eqNullSafe(F.col("g_source")))
    one = F.struct("key", "_row", "copies")
    few = near.groupBy("source", "gap", "size", F.pmod("key", F.lit(4)).alias("slot")).agg(F.min(one).alias("a"), F.max(one).alias("b"))
    few = few.select("source", "gap", "size", F.explode(F.array_distinct(F.array("a", "b"))).alias("d"))
    own = Window.partitionBy("source")
    picked = few.withColumn("short", F.row_number().over(own.orderBy("size", "d"))).withColumn(
        "close", F.row_number().over(own.orderBy(F.abs(F.col("size") - F.abs("gap")), "d"))).where((F.col("short") <= TRADED) | (F.col("close") <= TRADED))
    items = picked.groupBy("source", "gap").agg(F.sort_array(F.collect_list(F.struct("size", "d._row", "d.copies")), asc=False).alias("items"))
    choices = lambda p: F.transform(F.array_sort(F.transform(
        F.sequence(-p["copies"], F.lit(cap) - p["copies"]), lambda c: F.struct(F.abs(c).alias("moved"), c.alias("c")))), lambda x: x["c"].cast("long"))
    sums = F.aggregate("items", F.array(F.array(F.lit(0).cast("long"))), lambda acc, p: F.concat(acc, F.array(F.array_distinct(F.filter(
        F.flatten(F.transform(choices(p), lambda c: F.transform(F.element_at(acc, -1), lambda x: x + c * p["size"]))), lambda x: F.abs(x) <= REACH)))))
    reached = items.withColumn("sums", sums).withColumn("goal", F.array_min(F.transform(
        F.element_at("sums", -1), lambda x: F.struct(F.abs(F.col("gap") - x).alias("off"), x.alias("x"))))["x"])
    kind = "struct<k:int,rest:long,changes:array<struct<_row:long,change:int>>>"

    def back(acc, p):
        change = F.filter(choices(p), lambda c: F.array_contains(F.element_at("sums", acc["k"]), acc["rest"] - c * p["size"]))[0]
        return let(change, lambda c: F.struct(
            (acc["k"] - 1).alias("k"), (acc["rest"] - c * p["size"]).alias("rest"),
            F.concat(acc["changes"], F.array(F.struct(p["_row"].alias("_row"), c.cast("int").alias("change")))).alias("changes")).cast(kind))

    start = F.struct(F.size("items").alias("k"), F.col("goal").alias("rest"), F.array().cast("array<struct<_row:long,change:int>>").alias("changes"))
    traced = reached.select(F.aggregate(F.reverse("items"), start.cast(kind), back)["changes"].alias("changes"))
    return traced.select(F.explode("changes").alias("x")).select("x._row", "x.change").where("change <> 0")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, levels: int = LEVELS, seed: int = SEED, row_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken, shard, place; _row if ``row_col`` numbers the rows.

    ``size`` counts words, a null text has none; a null source is a source of its own, ordered
    last. ``taken`` is copies times size; a source's sum misses its target by no
    more than what is open when no free document fits. Rows that repeat an id are
    decided one by one. ``shard`` and
    ``place`` say where a taken document goes: shard number, and a key that shuffles the shard;
    null where no copy is taken. An empty table gives no rows.
    """
    row = [F.col(row_col).alias("_row")] if row_col else []
    sized = (materialise if row_col else numbered)(docs.select(
        *row, F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"),
    ).withColumn("block", block_of(seed, F.col("doc_id"))).withColumn("cell", part(BLOCKS, seed, "cell", F.col("doc_id"))))
    cells = materialise(sized.groupBy("source", "block", "cell").agg(F.sum("size").alias("cell_size")))
    per_source = materialise(targets(weighted(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights), cap))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = per_source.withColumn("full", passes).withColumn("room", F.col("target") - F.col("full") * F.col("source_size"))
    plan = materialise(plan.select("source", "source_size", "target", "full", "room"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    # Running sums over blocks, then over the cells of the block where the room ends, then over that cell's documents.
    blocks = cells.groupBy("source", "block").agg(F.sum("cell_size").alias("block_size"))
    blocks = blocks.join(plan, same(blocks, plan)).drop(plan["source"])
    permuted = [uniform(seed, "order", F.col("source"), F.col("block")), F.col("block")]
    blocks = materialise(fitting(blocks, ["source"], permuted, "block_size", F.col("room")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("source").orderBy(*permuted)) - 1,
    ).withColumn("drawn", (F.col("full") > 0) | (F.col("_before") < F.col("room"))))
    edge = blocks.where(~F.col("_fits") & (F.col("_before") < F.col("room"))).select(
        F.col("source").alias("e_source"), F.col("block").alias("e_block"), (F.col("room") - F.col("_before")).alias("e_room"))
    inner = cells.join(edge, cells["source"].eqNullSafe(F.col("e_source")) & (F.col("block") == F.col("e_block")))
    inner = materialise(fitting(inner, ["source"], ["cell"], "cell_size", F.col("e_room")).select(
        "source", "block", "cell", "_fits", (F.col("e_room") - F.col("_before")).alias("c_room")))

    leaves = quotas(blocks.where("drawn").groupBy("source").agg(F.count(F.lit(1)).alias("n_blocks")), levels, seed)
    upto = Window.partitionBy("source").orderBy("shard")
    leaves = leaves.where("quota > 0").withColumn("to", F.sum("quota").over(upto)).withColumn("from", F.col("to") - F.col("quota"))
    placed = blocks.join(
        leaves.select(F.col("source").alias("l_source"), "shard", "from", "to"),
        F.col("source").eqNullSafe(F.col("l_source")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")), "left",
    ).select("source", "block", "source_size", "target", "full", F.col("_fits").alias("block_fits"), "shard")
    dealt = placed.join(
        inner.select(F.col("source").alias("i_source"), F.col("block").alias("i_block"), F.col("cell").alias("i_cell"), F.col("_fits").alias("cell_fits"), "c_room"),
        F.col("source").eqNullSafe(F.col("i_source")) & (F.col("block") == F.col("i_block")), "left",
    )
    # One small map per (source, block): the cells of the edge block, if it is one.
    dealt = dealt.groupBy("source", "block", "source_size", "target", "full", "block_fits", "shard").agg(
        F.collect_list(F.when(F.col("cell_fits"), F.col("i_cell"))).alias("whole_cells"),
        F.max(F.when(~F.col("cell_fits") & (F.col("c_room") > 0), F.struct("i_cell", "c_room"))).alias("edge_cell"),
    )
    dealt = materialise(dealt)
    rows = sized.join(dealt.withColumnRenamed("source", "d_source").withColumnRenamed("block", "d_block"),
                      F.col("source").eqNullSafe(F.col("d_source")) & (F.col("block") == F.col("d_block")))
    in_edge = F.coalesce(F.col("cell") == F.col("edge_cell.i_cell"), F.lit(False))
    settled = rows.where(~in_edge).withColumn(
        "extra", (F.col("block_fits") | F.array_contains("whole_cells", F.col("cell"))).cast("int"))
    last = fitting(rows.where(in_edge), ["source"], ["size", F.xxhash64("doc_id"), "_row"], "size", F.col("edge_cell.c_room"))
    last = last.withColumn("extra", F.col("_fits").cast("int")).drop("_before", "_fits")
    drawn = materialise(settled.unionByName(last).select(
        "doc_id", "source", "block", "cell", "size", "source_size", "target", "full", "extra", "shard", "_row",
        ((F.col("full") + F.col("extra")) * F.col("size")).alias("taken"),
    ))
    # What documents too long for the rest have left open goes to free documents that fit, and to the one nearest in size.
    gaps = materialise(drawn.groupBy("source").agg((F.first("target") - F.sum("taken")).alias("gap")))
    free = drawn.where("extra = 0 and full < " + str(cap)).select("_row", F.xxhash64("doc_id").alias("key"), "source", "block", "cell", "size")
    rows = drawn.join(filled(free, gaps, seed).select(F.col("_row").alias("_more")), F.col("_row") == F.col("_more"), "left")
    rows = materialise(rows.withColumn("copies", (F.col("full") + F.col("extra") + F.col("_more").isNotNull().cast("int")).cast("int")))
    traded = exchanges(rows.select("_row", F.xxhash64("doc_id").alias("key"), "source", "size", "copies", "target"), cap)
    rows = rows.join(traded.select(F.col("_row").alias("_traded"), "change"), F.col("_row") == F.col("_traded"), "left")
    copies = F.col("copies") + F.coalesce("change", F.lit(0))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).alias("taken"),
        F.when(copies > 0, F.coalesce(F.col("shard"), part(2**levels, seed, "spare", F.col("source"), F.col("block")))).alias("shard"),
        F.when(copies > 0, place_of(seed, F.col("doc_id"))).alias("place"), *(["_row"] if row_col else []),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rules) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their own columns and copies, shard and place.

    An output writer repeats a row ``copies`` times, sends it to its shard and orders the shard by place.
    """
    row, seed = unused(docs, "_row"), rules.get("seed", SEED)
    stored = numbered(docs, row)
    decided = materialise(mix(stored, id_col, text_col, source_col, row_col=row, **rules).select(
        "_row", "source", block_of(seed, F.col("doc_id")).alias("block"), "copies", "shard", "place"))
    # Nearly all documents of a block share copies and shard; only texts of the others are joined by row.
    usual = materialise(decided.groupBy("source", "block").agg(F.mode(F.struct("copies", "shard")).alias("usual")))
    of_source, of_block, u, number = (unused(stored, n) for n in ("_source", "_block", "_usual", "_taken"))
    usual = usual.select(F.col("source").alias(of_source), F.col("block").alias(of_block), F.col("usual").alias(u))
    in_block = lambda source, block: source.eqNullSafe(F.col(of_source)) & (block == F.col(of_block))
    differs = ~F.struct("copies", "shard").eqNullSafe(F.col(u))
    odd = materialise(decided.join(usual, in_block(F.col("source"), F.col("block"))).where(differs).select(
        F.col("_row").alias(number), F.struct("copies", "shard").alias("own")))
    own = unused(stored, "_own")
    odd = odd.withColumnRenamed("own", own)
    near, rest = split_by(stored, row, odd, number)
    found = near.join(odd, F.col(row) == F.col(number), "left").drop(number).unionByName(rest, allowMissingColumns=True)
    found = found.join(usual, in_block(F.col(source_col).cast("string"), block_of(seed, F.col(id_col))))
    said = F.coalesce(F.col(own), F.col(u))
    return found.where(said["copies"] > 0).select(
        *docs.columns, said["copies"].alias(unused(docs, "copies")), said["shard"].alias(unused(docs, "shard")),
        place_of(seed, F.col(id_col)).alias(unused(docs, "place")))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source_size", "target", "taken", "size", "copies", "shard")
