"""Mixing sources to target weights by a min-cost flow over membership patterns.

1. A document's pattern is the set of sources it belongs to. Documents are
   aggregated by pattern, so the flow sees patterns and never documents.
2. Targets share all words by weight; a target stops at ``repeats`` times its
   source's size and the excess is shared again by weight.
3. The flow routes words from patterns to source quotas. The k-th repetition
   of a pattern costs more than the one before, so no document is repeated
   while a fresh one would serve. Each connected group of sources that share
   documents is a flow of its own and is solved in a task.
4. A pattern's flow is so many whole copies and a rest. The rest goes to
   documents in the order of a seeded hash, up to the first that doesn't fit,
   then on to later ones that are small enough, then to some that fit well,
   fresh ones first, and last to one more that goes beyond the flow, if that is
   nearer. Cuts are found by sums of hash buckets, level by level, so no large
   source is ever gathered or sorted. A pattern of ``FEW`` documents or less
   gets the sum of copies that is nearest of all.

Tables of sources and patterns stay Spark tables, so there is no limit to
their number. A task holds the patterns (not the documents) of one connected
group of overlapping sources.

A null text has size 0; a null source is a source of its own and comes last.
Rows with equal id and text share their fate, as do ties of the hash.
Texts are counted whole. Further columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialize

#: Bits of the hash that each level of sums looks at; the last level looks at whole hashes.
LEVELS = (12, 12)
#: Cuts through the documents of a pattern, and single documents after them that fit the rest best.
CUTS, PICKS = 2, 4
#: Documents of a pattern whose copies are chosen together, and the steps in which their sizes are counted there.
FEW, STEPS = 64, 1 << 18
#: The share of a pattern's flow that is near enough.
NEAR = 0.0005
SEED = 17
TOP = (1 << 63) - 1


class Pattern(NamedTuple):
    key: str
    sources: tuple[str | None, ...]
    size: int


def n_words(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _sources(patterns: DataFrame, weights: Sequence[float], repeats: int) -> DataFrame:
    """(at, source, source_size, target) of every source, numbered by code point, null last."""
    sizes = patterns.select(F.explode(F.array_distinct("sources")).alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    local = F.monotonically_increasing_id()
    placed = materialize(sizes.repartitionByRange(order).sortWithinPartitions(order).select("source", "source_size", F.shiftright(local, 33).alias("part"), local.bitwiseAND(F.lit((1 << 33) - 1)).alias("k")), "sources")
    before, shift = 0, F.lit(0).cast("long")
    for r in placed.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        shift = F.when(F.col("part") == r["part"], F.lit(before).cast("long")).otherwise(shift)
        before += r["count"]
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("at") % len(weights) + 1).cast("int"))
    rows = materialize(placed.select((F.col("k") + shift).alias("at"), "source", "source_size").withColumn("weight", weight), "weighted")
    # The level to which all sources are filled, by weight, unless they are full before.
    full, total, level = repeats * F.col("source_size"), rows.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while total:
        over = full < level * F.col("weight")
        r = rows.agg(F.sum(F.when(over, full)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        new = (total - (r["full"] or 0)) / r["open"]
        if new <= level:
            break
        level = new
    return rows.select("at", "source", "source_size", F.least(full.cast("double"), level * F.col("weight")).alias("target"))


def min_cost_flow(patterns: Sequence[Pattern], quotas: dict[str | None, int], repeats: int) -> dict[str, int]:
    """Words to take of each pattern, all repetitions together, by successive cheapest paths.

    Repetition k of a pattern costs k * k for each word.
    """
    graph: dict[object, dict[object, list[list]]] = defaultdict(lambda: defaultdict(list))

    def arc(a, b, room, cost):
        there, back = [room, cost, None], [0, -cost, None]
        there[2], back[2] = back, there
        graph[a][b].append(there)
        graph[b][a].append(back)

    for p in patterns:
        for k in range(repeats):
            arc("from", ("pattern", p.key), p.size, k * k)
        for s in p.sources:
            arc(("pattern", p.key), ("source", s), repeats * p.size, 0)
    for s, quota in quotas.items():
        arc(("source", s), "to", quota, 0)
    while True:
        cost, before, queue = {"from": 0}, {}, ["from"]
        for node in queue:  # grows while it runs: cheapest paths by repeated relaxation
            for other, arcs in graph[node].items():
                for a in arcs:
                    if a[0] > 0 and cost[node] + a[1] < cost.get(other, float("inf")):
                        cost[other], before[other] = cost[node] + a[1], (node, a)
                        queue.append(other)
        if "to" not in cost:
            break
        path, node = [], "to"
        while node != "from":
            node, a = before[node]
            path.append(a)
        room = min(a[0] for a in path)
        for a in path:
            a[0] -= room
            a[2][0] += room
    taken: dict[str, int] = {}
    for p in patterns:
        taken[p.key] = sum(a[2][0] for a in graph["from"][("pattern", p.key)])
    return taken


def _key(sources: Column) -> Column:
    return F.to_json(F.sort_array(F.array_distinct(sources)), {"ignoreNullFields": "false"})


def _keyed(docs: DataFrame, sources: Column, id_col: str, text_col: str, seed: int) -> list[Column]:
    """The pattern, the size, and a hash of 63 bits that orders rows."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 1)
    return [_key(sources).alias("_mix_pattern"), n_words(F.col(text_col)).alias("_mix_size"), h.alias("_mix_h")]


def _flows(patterns: DataFrame, sources: DataFrame, repeats: int) -> DataFrame:
    """(pattern, size, taken) of every pattern: words to take, all repetitions together."""
    quota = sources.select("at", F.col("source"), F.round("target").cast("long").alias("quota"))
    members = patterns.select("_mix_pattern", "size", F.size("sources").alias("n"), F.explode("sources").alias("of")).join(quota, F.col("of").eqNullSafe(F.col("source"))).select("_mix_pattern", "size", "n", "at", "quota")
    shared = members.where("n > 1").groupBy("_mix_pattern").agg(F.collect_set("at").alias("ats"))
    edges = shared.select(F.array_min("ats").alias("a"), F.explode("ats").alias("b")).where("a <> b")
    alone = patterns.where(F.size("sources") == 0).select("_mix_pattern", "size", F.lit(0).cast("long").alias("taken"))
    groups = connected_components(edges).withColumnRenamed("id", "at")
    placed = members.join(groups, "at", "left").withColumn("component", F.coalesce("component", "at"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        found = [Pattern(key, tuple(rows["at"]), int(rows["size"].iloc[0])) for key, rows in part.sort_values("at").groupby("_mix_pattern", sort=True)]
        taken = min_cost_flow(found, dict(zip(part["at"].tolist(), part["quota"].tolist(), strict=True)), repeats)
        return pd.DataFrame({"_mix_pattern": [p.key for p in found], "size": [p.size for p in found], "taken": [taken[p.key] for p in found]})

    solved = placed.groupBy("component").applyInPandas(solve, "_mix_pattern string, size bigint, taken bigint")
    return alone.unionByName(solved)


def _cut(sized: DataFrame, state: DataFrame) -> DataFrame:
    """(pattern, upto, left): how far ``left`` reaches over hashes above ``after`` of rows up to size ``most``, from (pattern, left, after, most)."""
    state = state.select("_mix_pattern", "left", "most", (F.col("after") + 1).alias("low"), F.lit(TOP).alias("high"))
    shift = 63
    for bits in (*LEVELS, None):
        shift = shift - bits if bits else 0
        rows = sized.join(state, "_mix_pattern").where("_mix_size > 0 and _mix_size <= most and _mix_h between low and high")
        sums = rows.groupBy("_mix_pattern", "left", F.shiftright("_mix_h", shift).alias("by")).agg(F.sum("_mix_size").alias("size"))
        sums = sums.withColumn("total", F.sum("size").over(Window.partitionBy("_mix_pattern").orderBy("by")))
        fits = F.col("total") <= F.col("left")
        found = sums.groupBy("_mix_pattern").agg(F.max(F.when(fits, F.col("total"))).alias("fit"), F.min(F.when(~fits, F.col("by"))).alias("by"))
        first = F.call_function("shiftleft", F.col("by"), F.lit(shift))
        # Without a bucket that doesn't fit, the rest reaches to the end of the range.
        low = F.when(F.col("by").isNull(), F.when(F.col("high") == TOP, F.col("high")).otherwise(F.col("low"))).otherwise(F.greatest("low", first))
        high = F.when(F.col("by").isNull(), F.col("low") - 1).otherwise(F.least(F.col("high"), first + F.lit((1 << shift) - 1)))
        narrowed = state.join(found, "_mix_pattern", "left").select("_mix_pattern", (F.col("left") - F.coalesce("fit", F.lit(0))).alias("left"), "most", low.alias("low"), high.alias("high"))
        state = materialize(narrowed, "cut")
    return state.select("_mix_pattern", F.when(F.col("low") == TOP, F.col("low")).otherwise(F.col("low") - 1).alias("upto"), "left")


def nearest_copies(sizes: Sequence[int], goal: int, repeats: int, steps: int = STEPS) -> list[int]:
    """How often to take each document so that the sum of sizes comes nearest to ``goal``; repeats only where fresh ones don't do.

    Sums that can be reached are bits of a number, in units of the total over ``steps``.
    """
    unit = max(1, -(-repeats * sum(sizes) // steps))
    turns = [(k, max(1, round(s / unit))) for _ in range(repeats) for k, s in enumerate(sizes) if s > 0]
    reached = [1]
    for _, size in turns:
        reached.append(reached[-1] | reached[-1] << size)
    sums, want = reached[-1], round(goal / unit)
    below = sums & ((1 << (want + 1)) - 1)
    low = below.bit_length() - 1
    above = sums >> want
    high = want + (above & -above).bit_length() - 1 if above else None
    best = low if high is None or want - low <= high - want else high
    out = [0] * len(sizes)
    for n in range(len(turns), 0, -1):
        if not reached[n - 1] >> best & 1:  # without this turn the sum is out of reach
            k, size = turns[n - 1]
            out[k] += 1
            best -= size
    return out


def _picked(sized: DataFrame, chosen: DataFrame, repeats: int) -> DataFrame:
    """(pattern, picks) of the small patterns, chosen together."""
    small = chosen.where(F.col("few")).select("_mix_pattern", "taken")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        # Rows of equal hash go together, as one.
        units = group.groupby("_mix_h", sort=True)["_mix_size"].sum()
        copies = nearest_copies(units.tolist(), int(group["taken"].iloc[0]), repeats)
        return pd.DataFrame({"_mix_pattern": [group["_mix_pattern"].iloc[0]], "chosen": [[h for h, n in zip(units.index.tolist(), copies, strict=True) for _ in range(n)]]})

    return sized.join(small, "_mix_pattern").select("_mix_pattern", "_mix_h", "_mix_size", "taken").groupBy("_mix_pattern").applyInPandas(run, "_mix_pattern string, chosen array<bigint>")


def plan(sized: DataFrame, weights: Sequence[float], repeats: int) -> tuple[DataFrame, DataFrame]:
    """(pattern, copies, cuts, picks) and (source, source_size, target), from rows of pattern, sources, size and hash."""
    patterns = sized.groupBy("_mix_pattern").agg(F.array_distinct(F.first("_mix_sources")).alias("sources"), F.sum("_mix_size").alias("size"), (F.count("*") <= FEW).alias("few"))
    patterns = materialize(patterns.withColumn("sources", F.coalesce("sources", F.array().cast("array<string>"))), "patterns")
    sources = materialize(_sources(patterns, weights, repeats), "targets")
    whole = F.when(F.col("size") > 0, F.floor(F.call_function("try_divide", F.col("taken").cast("double"), F.col("size")))).otherwise(0).cast("long")
    chosen = _flows(patterns, sources, repeats).select("_mix_pattern", "taken", whole.alias("copies"), (F.col("taken") - whole * F.col("size")).alias("left"))
    chosen = materialize(chosen.select("*", F.array().cast("array<struct<after: bigint, upto: bigint, most: bigint>>").alias("cuts"), F.array().cast("array<bigint>").alias("picks")), "chosen")
    # Small patterns are chosen together, from nothing; the rest goes on by cuts.
    few = chosen.join(patterns.select("_mix_pattern", "few"), "_mix_pattern")
    picked = _picked(sized, few, repeats)
    small = few.where("few").join(picked, "_mix_pattern", "left").select("_mix_pattern", F.lit(0).cast("long").alias("copies"), "cuts", F.coalesce("chosen", "picks").alias("picks"))
    chosen = materialize(few.where("not few").drop("few"), "chosen")
    far = F.col("left") > NEAR * F.col("taken")
    for turn in range(CUTS):
        state = chosen.where(far & (F.col("copies") < repeats)).select("_mix_pattern", "left", F.lit(-1).cast("long").alias("after") if turn == 0 else F.get("cuts", F.lit(turn - 1))["upto"].alias("after"), F.lit(TOP).alias("most") if turn == 0 else F.col("left").alias("most"))
        state = materialize(state.where(F.col("after") < TOP), "rests")
        reached = _cut(sized, state).withColumnRenamed("left", "now").join(state.select("_mix_pattern", "after", "most"), "_mix_pattern")
        cut = F.struct("after", "upto", "most")
        chosen = materialize(chosen.join(reached, "_mix_pattern", "left").select("_mix_pattern", "taken", "copies", F.coalesce("now", "left").alias("left"), F.when(F.col("now").isNotNull(), F.concat("cuts", F.array(cut))).otherwise(F.col("cuts")).alias("cuts"), "picks"), "chosen")
    for turn in range(PICKS + 1):
        beyond = turn == PICKS  # the last one may go beyond the rest, if that is nearer
        rows = sized.join(chosen.where(far), "_mix_pattern").where("_mix_size > 0").withColumn("n", _copies()).where(F.col("n") < repeats)
        # Rows of equal hash go together, as one.
        units = rows.groupBy("_mix_pattern", "_mix_h", "left").agg(F.sum("_mix_size").alias("size"), F.max("n").alias("n")).where("size < 2 * left" if beyond else "size <= left")
        # One that fills half of the rest, a fresh one if possible; else the largest.
        rank = F.struct((-F.abs(F.col("left") - F.col("size"))).alias("near"), (-F.col("n")).alias("fresh"), "size", "_mix_h") if beyond else F.struct((2 * F.col("size") >= F.col("left")).alias("much"), F.when(2 * F.col("size") >= F.col("left"), -F.col("n")).alias("fresh"), "size", "_mix_h")
        best = units.groupBy("_mix_pattern").agg(F.max(rank).alias("best"))
        joined = chosen.join(best, "_mix_pattern", "left")
        chosen = materialize(joined.select("_mix_pattern", "taken", "copies", (F.col("left") - F.coalesce("best.size", F.lit(0))).alias("left"), "cuts", F.when(F.col("best").isNotNull(), F.concat("picks", F.array("best._mix_h"))).otherwise(F.col("picks")).alias("picks")), "chosen")
    chosen = chosen.select("_mix_pattern", "copies", "cuts", "picks").unionByName(small)
    return chosen.select(F.col("_mix_pattern").alias("_mix_of"), F.col("copies").alias("_mix_copies"), F.col("cuts").alias("_mix_cuts"), F.col("picks").alias("_mix_picks")), sources.select("source", "source_size", "target")


def _copies(copies: str = "copies", cuts: str = "cuts", picks: str = "picks") -> Column:
    """Copies of a row that is joined to its pattern's cuts."""
    h, size = F.col("_mix_h"), F.col("_mix_size")
    of_cuts = F.size(F.filter(cuts, lambda c: (h > c["after"]) & (h <= c["upto"]) & (size <= c["most"])))
    more = F.greatest(of_cuts, F.lit(0)) + F.greatest(F.size(F.filter(picks, lambda p: p == h)), F.lit(0))
    return F.when(size > 0, F.coalesce(F.col(copies) + more, F.lit(0))).otherwise(F.coalesce(copies, F.lit(0)))


_CHOSEN = ("_mix_copies", "_mix_cuts", "_mix_picks")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), repeats: int = 3, sources: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """One row per row of ``docs``: id, sources, size (words), copies and taken (copies times size); and the (source, source_size, target) of all sources.

    ``sources``: an array of the sources that a row belongs to; by default the one in ``source_col``.
    """
    sources = F.array(source_col) if sources is None else sources
    sized = materialize(docs.select(F.col(id_col).alias("_mix_id"), sources.alias("_mix_sources"), *_keyed(docs, sources, id_col, text_col, seed)), "sizes")
    copies, totals = plan(sized, weights, repeats)
    rows = sized.join(copies, sized["_mix_pattern"] == copies["_mix_of"], "left")
    n = _copies(*_CHOSEN)
    out = rows.select(F.col("_mix_id").alias(id_col), F.col("_mix_sources").alias("sources"), F.col("_mix_size").alias("size"), n.alias("copies"), (n * F.col("_mix_size")).alias("taken"))
    return out, totals


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns."""
    sources = F.array(source_col)
    keys = _keyed(docs, sources, id_col, text_col, seed)
    sized = materialize(docs.select(sources.alias("_mix_sources"), *keys), "sizes")
    copies, _ = plan(sized, weights, repeats)
    # Columns get plain names for the join, whatever they are called.
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), *keys)
    rows = plain.join(copies, plain["_mix_pattern"] == copies["_mix_of"]).withColumn("_n", _copies(*_CHOSEN))
    return rows.where("_n > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_doc.*")
