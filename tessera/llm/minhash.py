"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles. Register j of its sketch is the
exponentially spaced, truncated minimum of the set under hash j: with ``x``
the minimum of exponential variates of rate ``RATE``, it is
``clip(floor(1 - log_b(x)), 0, q + 1)``. Registers merge by maximum, and two
sets agree in a register about as often as their Jaccard similarity says.

1. Sketch every document in one pass; equal sets become one class.
2. Band the registers of class representatives; equal bands share a bucket.
3. Pair the members of a bucket with a hub; keep pairs whose sizes allow the
   threshold and whose joint likelihood doesn't rule it out; verify the rest
   on full sets. Components grow with each round of hubs.
4. Compare the sketches of what is left in different components of one bucket
   block by block inside tasks, each pair in the first bucket that it shares.
   Where many buckets hold the same large component, its members and all that
   meet them are sent once for all these buckets, if that takes fewer rows.
   The few pairs that stay possible are verified on full sets. A block pair
   with many of them is cut by the bytes of its sets and compared on full sets
   inside tasks, and a spanning forest of its links leaves the task. So no
   link between components is lost, and no group emits all its pairs.

With 315 registers in bands of 7, a pair at similarity 0.8 shares no bucket
with probability 2.5e-5 (0.85: 3e-8), and the likelihood test is almost five
standard errors off.

Null or empty texts, or texts without a word, have an empty set and link with
nothing. Fewer words than a shingle make one shingle. A repeated id is one
document with the links of all its rows, so its rows are in one component. A
row without id is a document of its own. One row represents each component:
that of the smallest id, rows without id last, the first one on ties. Texts
are read whole, whatever their length; at most two sets of a length beyond
``SHINGLES`` meet in a task. An empty table gives no rows. Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, materialize
from .textops import WORD, Chunk, chunks, map_batches, mix, pieces, windows

REGISTERS = 315
BAND = 7
BASE = 1.001
LIMIT = 65534
RATE = 20.0
#: Candidates are dropped if their likeliest similarity is this much below the threshold.
MARGIN = 0.11
#: Rows of one hub that share a copy of its set.
HUB_ROWS = 500
#: Members of a bucket that are compared with as many others in one task.
BLOCK = 256
#: Band of the buckets that stand for all buckets of a component.
JOINT = 63
#: Pairs for each row that a block pair may leave to be verified elsewhere, and shingles of a block whose full sets are compared inside a task.
LEFT, SHINGLES = 2, 1 << 20
#: Bits of the filter that keeps texts nobody asks for out of a shuffle; its size doesn't grow.
FILTER_BITS = 1 << 25

_rng = np.random.Generator(np.random.PCG64(7))
_FACTORS = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts of a chunk, one text after the other, and how many each has."""
    n = len(chunk.offsets) - 1
    words = pieces(chunk, WORD, fold=True)
    n_words = np.bincount(words.doc, minlength=n)
    h, first = windows(words, size)
    doc = words.doc[first]
    for short in range(1, size):
        if (n_words == short).any():
            hs, fs = windows(words, short)
            whole = n_words[words.doc[fs]] == short
            h, doc = np.concatenate([h, hs[whole]]), np.concatenate([doc, words.doc[fs][whole]])
    order = np.argsort(doc, kind="stable")
    h, bounds = h[order], np.searchsorted(doc[order], np.arange(n + 1))
    sets = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)


def registers(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SetSketch registers of sets laid end to end; rows of zeros for empty sets."""
    out = np.zeros((len(sizes), REGISTERS), np.uint16)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    begin = (np.cumsum(sizes) - sizes)[full]
    least = np.empty((len(full), REGISTERS), np.uint64)
    scaled = np.empty_like(hashes)
    for j in range(REGISTERS):
        np.multiply(hashes, _FACTORS[j], out=scaled)
        least[:, j] = np.minimum.reduceat(scaled, begin)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-52)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)
    return out


def sketch(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, digest, registers) of every row; equal sets have equal digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                h, sizes = shingle_sets(c, size)
                regs = registers(h, sizes)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))]) for salt in (0x1234567, 0x89ABCDEF01)]
                end = np.cumsum(sizes)
                digest = np.stack([*(s[end] - s[end - sizes] for s in sums), sizes.astype(np.uint64)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.last - c.first), pa.array(sizes), pa.array([d.tobytes() for d in digest], pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())], ["id", "n_shingles", "digest", "registers"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), text_col), run, "id bigint, n_shingles bigint, digest binary, registers binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _bands(reps: DataFrame) -> DataFrame:
    """(bucket, id) for every band of every representative; the last six bits of a bucket are its band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, regs, n = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)), REGISTERS // BAND
            bands = np.arange(n, dtype=np.uint64)
            h = np.tile(bands + np.uint64(1), (len(ids), 1))
            for k in range(BAND):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + regs[:, k::BAND])
            h = (h & ~np.uint64(63)) | bands
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64).ravel()), pa.array(np.repeat(ids, n))], ["bucket", "id"])

    return map_batches(reps.select("id", "registers"), run, "bucket bigint, id bigint")


def likely(equal: np.ndarray, more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, at: float) -> np.ndarray:
    """Whether the joint likelihood of two sketches peaks at a similarity of ``at`` or more.

    The likelihood in the similarity is concave, so the sign of its slope at
    ``at`` tells. ``more`` and ``less`` count registers where the first is larger or smaller.
    """
    u, v, c = na / (na + nb), nb / (na + nb), (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * c) / np.log(BASE)
    slope = lambda x: c / ((1 - np.maximum(x, 1e-12) * c) * np.log(BASE))
    x, y = u - v * at, v - u * at
    rest = np.maximum(1 - p(x) - p(y), 1e-12)
    return -more * v * slope(x) / p(x) - less * u * slope(y) / p(y) + equal * (v * slope(x) + u * slope(y)) / rest >= 0


def _named(pairs: DataFrame) -> DataFrame:
    """The ids of pairs (a, b), each side made distinct by itself, as a hub is in many pairs."""
    side = lambda c: pairs.select(F.col(c).alias("id")).distinct()
    return side("a").unionByName(side("b"))


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave possible."""
    asked = _asked(reps.select("id", "n_shingles", "registers"), _named(pairs))
    side = lambda c: asked.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (2, 3))
            ra, rb = _matrix(batch.column(4)), _matrix(batch.column(5))
            more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
            good = likely(REGISTERS - more - less, more, less, na, nb, percent / 100 - MARGIN)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    return map_batches(both.select("a", "b", "n_a", "n_b", "r_a", "r_b"), run, "a bigint, b bigint")


def _filter(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of an id, gathered in at most ``FILTER_BITS`` / 32 rows."""
    at = F.xxhash64("id").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = ids.groupBy(F.shiftright(at, 5).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(31)).cast("int"))).alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 32, np.uint32)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return np.unpackbits(words.view(np.uint8), bitorder="little")


def _wanted(rows: DataFrame, ids: DataFrame, names: list[str], run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``run`` over batches of those ``rows`` (columns ``names``) whose id is among ``ids``, and perhaps a few more; what nobody asks for stays out of shuffles."""
    wanted = rows.sparkSession.sparkContext.broadcast(np.packbits(_filter(ids)).tobytes())

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            yield from run(pa.RecordBatch.from_arrays(batch.columns[1:], names).filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)))

    return map_batches(rows.select(F.xxhash64("id").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("at"), *names), select, schema)


def _asked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose id is among ``ids``, and perhaps a few more."""
    return _wanted(rows, ids, rows.columns, lambda batch: iter([batch]), rows.schema)


def _sets(docs: DataFrame, ids: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles) of the documents named by ``ids``, and perhaps a few more, in a written table."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in chunks(batch.column(1)):
            h, sizes = shingle_sets(c, size)
            values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.last - c.first), values], ["id", "shingles"])

    key = F.col(id_col).cast("long")
    rows = docs.where(key.isNotNull()).select(key.alias("id"), F.col(text_col).alias("text"))
    return materialize(_wanted(rows, ids, ["id", "text"], run, "id bigint, shingles array<bigint>"), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose full sets reach the threshold. A hub of many pairs has its set copied, so no task gets all of them."""
    uses = pairs.groupBy("a").agg(F.count("*").alias("uses"))
    sets = _sets(docs, _named(pairs), size, id_col, text_col)
    copies = F.ceil(F.col("uses") / HUB_ROWS).cast("int")
    # Both joins begin with the sets dealt by id, so these are shuffled once.
    hubs = sets.join(uses.withColumnRenamed("a", "id"), "id").select(F.col("id").alias("a"), F.col("shingles").alias("s_a"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    salted = pairs.join(uses, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), copies).cast("int").alias("salt"))
    members = sets.join(salted, "id").select("a", "salt", F.col("id").alias("b"), F.col("shingles").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    found = members.join(hubs, ["a", "salt"]).where(100 * both >= percent * (F.size("s_a") + F.size("s_b") - both)).select("a", "b").distinct()
    links = materialize(found, "links")
    discard(sets)
    return links


def _keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a column that is unique and never null, and its name: the ids if they are so, else a key of each row in a written table."""
    odd = docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n")).where("id is null or n > 1")
    if odd.isEmpty():
        return docs, id_col
    key = "_key"
    while key in docs.columns:
        key = "_" + key
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _components(docs: DataFrame, key: str, size: int, percent: int, text_col: str) -> DataFrame:
    """(key, n_shingles, component) of every row of ``docs``; the component is the smallest linked key."""
    sketches = materialize(sketch(docs, size, key, text_col), "sketches")
    classes = materialize(sketches.where("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    reps = materialize(sketches.where("n_shingles > 0").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n_shingles", "registers"), "reps")
    sizes = materialize(sketches.select("id", "n_shingles", "digest"), "sizes")
    discard(sketches)
    found = _links(_bands(reps), reps, docs, size, percent, key, text_col)
    labels = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    full = sizes.where("n_shingles > 0").join(labels, "digest").select(F.col("id").alias("key"), "n_shingles", "component")
    return full.unionByName(sizes.where("n_shingles = 0").select(F.col("id").alias("key"), "n_shingles", F.col("id").alias("component")))


def _marked(docs: DataFrame, key: str, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(key, id, n_shingles, component_id, kept) of every row of ``docs``."""
    rows = _components(docs, key, size, percent, text_col)
    if key == id_col:
        return rows.select("key", F.col("key").alias("id"), "n_shingles", F.col("component").alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))
    ids = docs.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"))
    rows = materialize(rows.join(ids, "key"), "marked")
    # Components that share an id are one.
    named = materialize(rows.where("id is not null").select("id", "component").distinct(), "named")
    least = named.groupBy("id").agg(F.min("component").alias("b"))
    merged = connected_components(named.join(least, "id").select(F.col("component").alias("a"), "b"))
    rows = rows.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").withColumn("component", F.coalesce("to", "component"))
    rows = materialize(rows.select("key", "id", "n_shingles", "component"), "marked")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first"))
    return rows.join(first, "component").select("key", "id", "n_shingles", F.col("first.id").alias("component_id"), (F.col("key") == F.col("first.key")).alias("kept"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest linked id, null if no linked row has one) and kept (one row of each component).

    Links join documents whose shingle sets of ``size`` words have a Jaccard
    similarity of ``percent`` / 100 or more. See the module for the method.
    """
    rows, key = _keyed(docs, id_col)
    return _marked(rows, key, size, percent, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _possible(x: int, regs: np.ndarray, sizes: np.ndarray, others: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Those of ``others`` that sizes and sketches leave possible as partners of ``x`` and whose first common band with it is ``band`` (``JOINT``: any)."""
    others = others[100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x])]
    if not len(others):
        return others
    more, less = (regs[x] > regs[others]).sum(axis=1), (regs[x] < regs[others]).sum(axis=1)
    others = others[likely(REGISTERS - more - less, more, less, np.full(len(others), float(sizes[x])), sizes[others].astype(float), percent / 100 - MARGIN)]
    agree = (regs[others] == regs[x]).reshape(len(others), REGISTERS // BAND, BAND).all(axis=2)
    if not len(others):
        return others
    return others[agree.any(axis=1) if band == JOINT else agree.argmax(axis=1) == band]


def _rows(core, rest):
    """Rows that block pairs of a core and a rest of these sizes take."""
    return core * F.ceil(rest / BLOCK) + rest * F.ceil(core / BLOCK)


def _meetings(members: DataFrame, top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who meets the largest components of buckets: (largest, id, component) once for all buckets, and by component the rows that block pairs take.

    The second table has ``core`` and ``rest`` (members and others in all its
    buckets), ``apart`` and ``joint`` (rows of core and rest by bucket and
    once for all) and ``among`` (rows of rests with themselves).
    """
    kin = materialize(members.select("largest", "id", "component").distinct(), "kin")
    rest = F.col("n") - F.col("core")
    by_bucket = top.groupBy("largest").agg(F.sum(_rows(F.col("core"), rest)).alias("apart"), F.sum(F.when(rest > 1, rest * F.ceil(rest / BLOCK)).otherwise(0)).alias("among"))
    sizes = kin.groupBy("largest").agg(F.count_if(F.col("component") == F.col("largest")).alias("core"), F.count_if(F.col("component") != F.col("largest")).alias("rest"))
    return kin, materialize(sizes.join(by_bucket, "largest").withColumn("joint", _rows(F.col("core"), F.col("rest"))), "meetings")


def _blocks(members: DataFrame, kin: DataFrame, meetings: DataFrame) -> DataFrame:
    """(bucket, i, j, side, id, component) of the block pairs of each bucket, from (bucket, id, component, largest, core, n).

    The largest component of a bucket, its core, needs no comparing with itself.
    Core and rest are cut into blocks; a block of the rest meets each block of
    the core and of the rest. Cores meet rests once for all buckets of a
    component (a bucket of band ``JOINT``) where that takes fewer rows.
    """
    inner = F.col("component") == F.col("largest")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    own, each, none = F.col("own"), lambda n: F.sequence(F.lit(0), n - 1), F.array().cast("array<struct<i:int,j:int,side:int>>")
    of_core = lambda rests: F.transform(each(rests), lambda r: cell(-1 - own, r, F.lit(0)))
    to_core = lambda cores: F.transform(each(cores), lambda k: cell(-1 - k, own, F.lit(1)))
    among = lambda rests: F.transform(each(rests), lambda o: cell(F.least(own, o), F.greatest(own, o), F.when(own <= o, 0).otherwise(1)))
    block = lambda cores, rests: F.pmod(F.xxhash64("id", F.lit("block")), F.when(inner, cores).otherwise(rests)).cast("int")
    joint = meetings.where("joint < apart").select("largest", F.col("core").alias("all_core"), F.col("rest").alias("all_rest"))

    cores, rests = blocks(F.col("core")), blocks(F.col("n") - F.col("core"))
    tagged = members.join(joint.select("largest", F.lit(True).alias("once")), "largest", "left").withColumn("own", block(cores, rests))
    apart = F.when(F.col("once"), none).otherwise(F.when(inner, of_core(rests)).otherwise(to_core(cores)))
    cells = F.concat(apart, F.when(inner | (F.col("n") - F.col("core") < 2), none).otherwise(among(rests)))
    by_bucket = tagged.withColumn("cell", F.explode(cells)).select("bucket", "cell.i", "cell.j", "cell.side", "id", "component")

    cores, rests = blocks(F.col("all_core")), blocks(F.col("all_rest"))
    whole = kin.join(joint, "largest").withColumn("own", block(cores, rests)).withColumn("cell", F.explode(F.when(inner, of_core(rests)).otherwise(to_core(cores))))
    bucket = F.xxhash64("largest").bitwiseAND(F.lit(~JOINT).cast("long")).bitwiseOR(F.lit(JOINT).cast("long"))
    return by_bucket.unionByName(whole.select(bucket.alias("bucket"), "cell.i", "cell.j", "cell.side", "id", "component"))


def _apart(placed: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between different components within the block pairs ``placed``."""
    asked = _asked(reps, placed.select("id"))
    full = placed.join(asked, "id").select("bucket", "i", "j", "side", "id", "component", "n_shingles", "registers")

    def run(group: pa.Table) -> pa.Table:
        bucket, i, j = (group.column(c)[0].as_py() for c in (0, 1, 2))
        side, ids, component, sizes = (group.column(c).to_numpy() for c in (3, 4, 5, 6))
        regs, found = _matrix(group.column(7).combine_chunks()), []
        for x in np.flatnonzero(side == 0) if i != j else range(len(ids)):
            others = np.flatnonzero(((side == 1) if i != j else (ids > ids[x])) & (component != component[x]))
            found += [(min(ids[x], ids[y]), max(ids[x], ids[y])) for y in _possible(x, regs, sizes, others, bucket & 63, percent).tolist()]
            if len(found) > LEFT * len(ids):
                found = [(None, None)]
                break
        return pa.table({"bucket": pa.array([bucket] * len(found), pa.int64()), "i": pa.array([i] * len(found), pa.int32()), "j": pa.array([j] * len(found), pa.int32()), "a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    pairs = materialize(full.groupBy("bucket", "i", "j").applyInArrow(run, "bucket bigint, i int, j int, a bigint, b bigint"), "candidates")
    links = _verified(pairs.where("a is not null").select("a", "b").distinct(), docs, size, percent, id_col, text_col)
    dense = pairs.where("a is null").select("bucket", "i", "j")
    if dense.isEmpty():
        return links
    rows = materialize(placed.join(dense, ["bucket", "i", "j"]).join(reps, "id"), "dense")
    return links.unionByName(_inside(rows, docs, size, percent, id_col, text_col)).distinct()


def _inside(rows: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that join the components of dense block pairs, from (id, bucket, i, j, side, component, n_shingles, registers), on full sets inside tasks.

    Each side is cut so that a part has about ``SHINGLES`` shingles, or one set.
    """
    both = rows.where("i <> j").unionByName(rows.where("i = j").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))))
    parts = both.groupBy("bucket", "i", "j").agg(*(F.greatest(F.ceil(F.sum(F.when(F.col("side") == s, F.col("n_shingles"))) / SHINGLES), F.lit(1)).cast("int").alias(f"parts_{s}") for s in (0, 1)))
    own = F.pmod(F.xxhash64("id", F.lit("part")), F.when(F.col("side") == 0, F.col("parts_0")).otherwise(F.col("parts_1"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("parts_1")).otherwise(F.col("parts_0")) - 1)
    cells = both.join(parts, ["bucket", "i", "j"]).withColumn("own", own).withColumn("other", F.explode(other))
    cells = cells.withColumn("p", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))).withColumn("q", F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")))
    sets = _sets(docs, rows.select("id"), size, id_col, text_col)
    full = cells.join(sets, "id").select("bucket", "i", "j", "p", "q", "side", "id", "component", "n_shingles", "registers", "shingles")

    def run(group: pa.Table) -> pa.Table:
        band = group.column(0)[0].as_py() & 63
        side, ids, component, sizes = (group.column(c).to_numpy() for c in (5, 6, 7, 8))
        regs, lists = _matrix(group.column(9).combine_chunks()), group.column(10).combine_chunks()
        hashes, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        sets = np.split(hashes.view(np.uint64), ends[:-1])
        joined = {c: c for c in component.tolist()}

        def root(c):
            while joined[c] != c:
                joined[c] = c = joined[joined[c]]
            return c

        found = []
        for x in np.flatnonzero(side == 0):
            others = np.flatnonzero((side == 1) & (component != component[x]) & (ids != ids[x]))
            for y in _possible(x, regs, sizes, others, band, percent).tolist():
                cx, cy = root(int(component[x])), root(int(component[y]))
                if cx == cy:
                    continue
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * common >= percent * (sizes[x] + sizes[y] - common):
                    joined[cx] = cy
                    found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return full.groupBy("bucket", "i", "j", "p", "q").applyInArrow(run, "a bigint, b bigint")


def _links(bands: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, component) of the representatives that have a link."""
    verify = lambda pairs: _verified(materialize(pairs, "candidates"), docs, size, percent, id_col, text_col)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1")
    buckets = materialize(bands.join(shared, "bucket"), "buckets")
    first = buckets.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    labels = materialize(connected_components(verify(_estimated(first, reps, percent))), "labels")
    # Hubs go on while they find links and sending sketches to block pairs would cost more rows than there are representatives.
    enough, turn, unsettled = reps.count(), 0, buckets
    n_new = enough
    while True:
        turn += 1
        placed = materialize(unsettled.select("bucket", "id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
        # Buckets whose members are not all in one component yet; the others are done, as components only grow.
        parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        top = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
        top = materialize(top.select("bucket", "n", F.col("top.component").alias("largest"), F.col("top.n").alias("core")), "top")
        if top.isEmpty():
            return labels
        members = materialize(placed.join(top, "bucket"), "members")
        discard(placed)
        kin, meetings = _meetings(members, top)
        discard(top)
        last = not n_new or meetings.agg(F.sum(F.col("among") + F.least("apart", "joint"))).first()[0] <= enough
        if last:
            placed = materialize(_blocks(members, kin, meetings), "blocks")
            new = materialize(_apart(placed, reps, docs, size, percent, id_col, text_col), "links")
            discard(placed)
        else:
            hubs = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("o"), "id", "component")).alias("hub")).select("bucket", F.col("hub.id").alias("a"), F.col("hub.component").alias("ca"))
            # Written first, so that the join may split a large bucket.
            hubs = materialize(hubs, "hubs")
            new = verify(_estimated(members.join(hubs, "bucket").where("component <> ca").select("a", F.col("id").alias("b")).distinct(), reps, percent))
            discard(hubs)
        discard(kin)
        discard(meetings)
        n_new = new.count()
        if n_new:
            lifted = new.join(labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
            merged = connected_components(lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
            known = labels.unionByName(merged.select("id", F.col("id").alias("component"))).distinct()
            moved = known.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
            labels = materialize(moved.groupBy("id").agg(F.min(F.coalesce("to", "component")).alias("component")), "labels")
        discard(new)
        discard(unsettled)
        if last:
            discard(members)
            return labels
        unsettled = members


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of ``docs`` that represents each component, with all its columns."""
    rows, key = _keyed(docs, id_col)
    kept = _marked(rows, key, size, percent, id_col, text_col).where("kept").select(F.col("key").alias(key))
    found = rows.join(kept, key, "left_semi")
    return found if key == id_col else found.drop(key)
