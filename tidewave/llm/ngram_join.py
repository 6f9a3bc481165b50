"""N-gram Jaccard join as a metric-space join, exact for any threshold over one half.

The metric is the Jaccard distance d of shingle sets, the radius r = 1 - t.

1.  Shells and districts. Distance to the empty set bounds sizes: linked sets
    differ in size by a factor 1/t at most, so sets lie in size shells and those
    within that window of the next shell are copied to it. A shell cuts the hash
    space into m equal blocks. Sets of n shingles within r differ in at most
    D = floor(n(1-t)/t) shingles, each of which spoils one block, so linked sets
    share all their blocks but D. In one order of all block contents, by hash, the
    first D + k of each therefore have k in common, and of these, in another order,
    by rarity, the first D + 1 have one in common: each set is a member of the
    districts (block, content) of those D + 1 blocks only, and linked sets always
    meet. k depends on the shell alone; it is how many frequent blocks can be left
    out, and a set with fewer than k shared blocks links with nothing. A set whose
    shingles fill fewer than D + 1 blocks is also a member by its single shingles,
    under the same rule, which then always holds.
2.  Families. Sets that districts connect make a family; links never leave it, so
    each set moves to its family once, however many districts it shares.
3.  Recursion. A family too large for one task is divided. Pivots are chosen and
    each member's distance to them is computed. A member's home is the Voronoi
    region of its nearest pivot if that is within rho = 1 - 1.5 r, else the rest.
    A linked pair x, y with y at home in q has d(x,q) <= d(x,p) + 2r for x's
    nearest pivot p and d(x,q) <= rho + r, so x is a guest of each later region
    within both windows, and of the rest if d(x,p) > rho - r. Each pair of members
    meets in one region only. Pivots have met everyone and leave. Regions recurse;
    one whose windows would copy its members more than twice is not divided: its
    blocks by hash meet in pairs instead, each pair of blocks in a task of its own.
4.  A region of bounded size counts all its intersections in one task.

Plain pivots over the whole corpus would not divide it: unrelated texts all lie
at distance near 1 from every pivot, so the 2r window would copy every text into
every region. Hence steps 1 and 2 before the recursion.

Equal sets are one member throughout. A task holds REGION sets or WEIGHT shingles
at most, or a pair of longer sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, drop_since, mix, shingle_sets, written

#: Up to so many keys of texts with partners are sent to all executors (a long each); more are shuffled.
BROADCAST_NODES = 2_000_000
#: Sets with so many rows, and with a 1/HOT of all rows, take part in the exchange of blocks once.
MANY, HOT = 64, 100_000
#: Up to so many bytes of pivots' sets are sent to all executors; more are shuffled.
BROADCAST_PIVOTS = 32 << 20
#: Sets and shingles that one task compares at most.
REGION, WEIGHT = 1000, 2_000_000
#: Rounds of pivots before what is left is compared block by block.
DEPTH = 3
SLACK = 1.25
#: k is 2^-SPARE of a shell's blocks.
SPARE = 4
_SINGLE = 63


def spread(n: int, percent: int) -> int:
    """D: how many shingles a set of n and one within reach can differ in."""
    return n * (100 - percent) // percent


def shell(n: int, percent: int) -> int:
    return max(0, int(np.ceil(np.log2(SLACK * (spread(n, percent) + 1)))))


def districts(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """(family, block signatures) of one sorted set, a family for each shell it reaches: the first D + k by hash."""
    n, out, thin = len(s), [], False
    if not n:
        return out
    most, inner = spread(n, percent), mix(s + np.uint64(0xA0761D6478BD642F))
    for j in range(shell(n, percent), shell(n * 100 // percent, percent) + 1):
        block = (s >> np.uint64(64 - j)) if j else np.zeros(n, np.uint64)
        start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        total = np.add.reduceat(inner, start)
        sigs = mix(total + (block[start] * np.uint64(64) + np.uint64(j)) * np.uint64(0xE7037ED1A0B428DB))
        out.append((j, np.sort(sigs)[: most + max(1, (1 << j) >> SPARE)]))
        thin |= len(start) <= most
    if thin:
        out.append((_SINGLE, np.sort(mix(s + np.uint64(0x8EBC6AF09C88C6E3)))[: most + SPARE]))
    return out


def _signed(x: np.ndarray) -> int:
    return int(x.sum(dtype=np.uint64).view(np.int64))


def _summaries(k: int, percent: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                n, h1, h2, fams, sigs, inner, outer = [], [], [], [], [], [0], [0]
                for s in shingle_sets(b.column(1), k):
                    n.append(len(s)), h1.append(_signed(mix(s))), h2.append(_signed(mix(s ^ np.uint64(0x5851F42D4C957F2D))))
                    for f, v in districts(s, percent):
                        fams.append(f), sigs.append(v.view(np.int64)), inner.append(inner[-1] + len(v))
                    outer.append(len(fams))
                flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64))
                items = pa.StructArray.from_arrays([pa.array(fams, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), flat)], ["fam", "sigs"])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(pa.array(outer, pa.int32()), items)], ["doc_id", "text_key", "n", "h1", "h2", "fams"])

    return run


def _sets(k: int):
    """Batches with the text first; the set comes last in its place."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                sets = [s.view(np.int64) for s in shingle_sets(b.column(0), k)]
                offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], items], [*b.schema.names[1:], "items"])

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): each node's smallest reachable node, by alternating large and small stars.

    Both steps are aggregates and joins on the node; no task holds a component.
    """
    e = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # large star: every larger neighbour of u goes to the least neighbour of u
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours go to the least of them
        down = large.where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        near = down.join(least, "u")
        e2 = near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, e = e, cut(e2.select(F.col("v").alias("u"), F.col("u").alias("v")))
        drop(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("v").alias("node"), F.col("u").alias("comp"))
        before = now


def overlaps(items: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of a bounded number of sets.

    Shingles of few of the sets are counted pair by pair, the others as columns of a 0/1 matrix.
    """
    m = len(items)
    own = np.repeat(np.arange(m), [len(x) for x in items])
    _, inv, df = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    own = own[np.argsort(inv, kind="stable")]
    each = np.repeat(df, df)
    both, few = np.zeros(m * m, np.int64), max(2, m // 8)
    for size in np.unique(df[(df > 1) & (df <= few)]):
        x, y = np.triu_indices(size, 1)
        group = own[each == size].reshape(-1, size)
        step = max(1, 4_000_000 // len(x))
        for at in range(0, len(group), step):
            g = group[at : at + step]
            both += np.bincount((g[:, x] * m + g[:, y]).ravel(), minlength=m * m)
    both = both.reshape(m, m)
    both += both.T
    rest, often = own[each > few], df[df > few]
    column, start = np.repeat(np.arange(len(often)), often), np.concatenate([[0], np.cumsum(often)])
    for lo in range(0, len(often), 2048):
        a, b = start[lo], start[min(lo + 2048, len(often))]
        x = np.zeros((m, 2048), np.float32)
        x[rest[a:b], column[a:b] - lo] = 1
        both += (x @ x.T).astype(np.int64)
    return both


#: Rows that _compare takes; side is 0, or 1 and 2 for the two blocks of a pair, comp (or null) what is known to be linked.
_MEMBER = "region long, node long, home boolean, side int, comp long, copies long, items array<long>"


def _compare(percent: int, pairs: bool):
    """A region's rows -> (node, low, links): its least neighbour so far and how many rows it links with there; pairs: (a, b)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node").combine_chunks()
        node, copies, home, side = (t[c].to_numpy() for c in ("node", "copies", "home", "side"))
        column = t["items"].combine_chunks() if isinstance(t["items"], pa.ChunkedArray) else t["items"]
        flat, offs = column.flatten().to_numpy(), column.offsets.to_numpy()
        offs = offs - offs[0]
        n = np.diff(offs)
        both = overlaps([flat[a:b] for a, b in zip(offs[:-1], offs[1:])])
        linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        linked &= home[:, None] | home[None, :]
        np.fill_diagonal(linked, False)
        if side.any():
            linked &= side[:, None] != side[None, :]
        if not t["comp"].null_count:
            comp = t["comp"].to_numpy()
            linked &= comp[:, None] != comp[None, :]
        if pairs:
            i, j = np.nonzero(np.triu(linked))
            return pa.table({"a": pa.array(node[i], pa.int64()), "b": pa.array(node[j], pa.int64())})
        low = np.arange(len(node))
        while True:
            near = np.where(linked, low[None, :], len(node)).min(axis=1)
            new = np.minimum(low, near)
            new = new[new]
            if (new == low).all():
                break
            low = new
        some = linked.any(axis=1)
        links = linked @ copies
        return pa.table({"node": pa.array(node[some], pa.int64()), "low": pa.array(node[low][some], pa.int64()), "links": pa.array(links[some].astype(np.int64), pa.int64())})

    return run


def _found(rows: DataFrame, percent: int, pairs: bool) -> DataFrame:
    return rows.groupBy("region").applyInArrow(_compare(percent, pairs), "a long, b long" if pairs else "node long, low long, links long")


def _linked(percent: int) -> Column:
    return F.col("both") * 100 >= percent * (F.col("nx") + F.col("np") - F.col("both"))


def _summarised(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs with the hash of its text, and the summary of each row."""
    if not 50 < percent < 100:
        raise ValueError("percent must lie between 50 and 100")
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    flat = "doc_id long, text_key long, n long, h1 long, h2 long, fams array<struct<fam:int,sigs:array<long>>>"
    return docs, cut(docs.mapInArrow(_summaries(k, percent), flat).withColumn("row", F.monotonically_increasing_id()))


def _once(summary: DataFrame) -> DataFrame:
    """The rows of sets that are not empty, of much copied ones the first alone.

    A set is much copied from MANY rows on, and from a 1/HOT of all rows on: so there are
    HOT of them at most, which all tasks know, and no row moves. What copies of others
    add to a block is bounded by the same numbers.
    """
    some = summary.where("n > 0")
    bound = max(MANY, -(-some.count() // HOT))
    hot = some.groupBy("h1").agg(F.count(F.lit(1)).alias("c"), F.min("row").alias("first")).where(F.col("c") >= bound).select(F.col("h1").alias("hot"), "first")
    return some.join(F.broadcast(hot), F.col("h1") == F.col("hot"), "left").where("hot is null or row = first").select("h1", "n", "fams")


def _members(summary: DataFrame, percent: int) -> DataFrame:
    """(region, node) of every set's D + 1 rarest shared blocks."""
    entries = _once(summary).select(F.col("h1").alias("node"), "n", F.explode("fams").alias("f"))
    entries = entries.select("node", "n", F.col("node").bitwiseXOR(F.col("f.fam").cast("long")).alias("entry"), F.col("f.sigs").alias("sigs"))
    # one exchange of pairs of numbers serves the count of the blocks and the choice of the shared ones; the
    # copies that are left only raise a block's frequency, which every member sees alike
    rows = entries.select("entry", F.explode("sigs").alias("region")).repartition("region")
    often = rows.groupBy("region").agg(F.count(F.lit(1)).alias("freq"), F.min("entry").alias("lo"), F.max("entry").alias("hi")).where("lo < hi").select("region", "freq")
    shared = rows.join(often.hint("shuffle_hash"), "region").dropDuplicates(["region", "entry"])
    sizes = entries.select("entry", "node", F.size("sigs").alias("b"), F.floor(F.col("n") * (100 - percent) / percent).alias("spread")).dropDuplicates(["entry"])
    by = Window.partitionBy("entry")
    ranked = shared.join(sizes, "entry").select("region", "node", "b", "spread", F.row_number().over(by.orderBy("freq", "region")).alias("rank"), F.count(F.lit(1)).over(by).alias("cnt"))
    return cut(ranked.where("rank + b - cnt <= spread + 1").select("region", "node"))


def _families(summary: DataFrame, percent: int, most: int, weight: int) -> DataFrame:
    """(node, text_key, n, copies, region, small): the sets with possible partners, by family; the text that stands for each."""
    members = _members(summary, percent)
    least = members.groupBy("region").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").select("region", "a")
    labels = components(members.join(least, "region").select("a", F.col("node").alias("b")).where("a <> b").distinct())
    # a component's table has no row for its least node
    labels = labels.unionByName(labels.select(F.col("comp").alias("node"), "comp").distinct()).withColumnRenamed("comp", "region")
    nodes = summary.where("n > 0").groupBy(F.col("h1").alias("node")).agg(F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.join(labels, "node")
    sizes = nodes.groupBy("region").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    out = cut(nodes.join(sizes.select("region", ((F.col("c") <= most) & (F.col("w") <= weight)).alias("small")), "region"))
    drop(members)
    return out


def _neighbours(docs: DataFrame, summary: DataFrame, k: int, percent: int, pivots: int, most: int, weight: int, close: bool = False, pairs: bool = False) -> DataFrame:
    """(node, low, links) or pairs (a, b) of all sets with neighbours, written.

    low leads to the component's least node. close: links within a component are left out where they cost comparisons.
    """
    nodes = _families(summary, percent, most, weight)
    # texts without possible partners go before anything moves; of the others each text moves once
    keys = nodes.select("text_key")
    keys = F.broadcast(keys) if nodes.count() <= BROADCAST_NODES else keys
    texts = docs.select("text", "text_key").join(keys, "text_key", "left_semi").dropDuplicates(["text_key"])
    texts = texts.join(nodes.select("text_key", "region", "node", "n", "copies", "small"), "text_key").select("text", "region", "node", "n", "copies", "small")
    sets = texts.mapInArrow(_sets(k), "region long, node long, n long, copies long, small boolean, items array<long>")
    large = not nodes.where("not small").isEmpty()
    sets = cut(sets) if large else sets
    plain = sets.where("small").select("region", "node", F.lit(True).alias("home"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("comp"), "copies", "items")
    found = cut(_found(plain, percent, pairs))
    if not large:
        return found
    parts = _divided(nodes.where("not small"), sets.where("not small").select("node", "n", "copies", "items"), percent, pivots, most, weight, close, pairs)
    if pairs:
        return found.unionByName(parts)
    labels = components(parts, "node", "low")
    links = parts.groupBy("node").agg(F.sum("links").alias("links"))
    out = cut(found.unionByName(links.join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("low"), "links")))
    drop(found, parts, sets)
    return out


def _divided(nodes: DataFrame, sets: DataFrame, percent: int, pivots: int, most: int, weight: int, close: bool, pairs: bool) -> DataFrame:
    """What _compare would give for families larger than a task: pivots, Voronoi regions, windows, then pairs of blocks."""
    r = 1 - percent / 100
    rho = 1 - 1.5 * r
    live, left, found = nodes.select("region", "node", F.lit(True).alias("home"), "n"), None, None
    for turn in range(DEPTH):
        sizes = live.groupBy("region").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
        open_ = sizes.where((F.col("c") > most) | (F.col("w") > weight)).select("region", "c")
        if turn:  # families are large as they come
            left = _with(left, live.join(open_, "region", "left_anti").select("region", "node", "home"))
        live = live.join(open_, "region")
        order = Window.partitionBy("region").orderBy(F.xxhash64("node"), "node")
        chosen = cut(live.where("home").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pivots).select("region", F.col("node").alias("p"), "rank"))
        ip = chosen.join(sets.select(F.col("node").alias("p"), F.col("n").alias("np"), F.col("copies").alias("cp"), F.col("items").alias("ip")), "p")
        bytes_ = ip.agg(F.sum("np")).first()[0]
        if bytes_ is None:
            live = None
            break
        ip = F.broadcast(ip) if 8 * bytes_ <= BROADCAST_PIVOTS else ip
        own = chosen.select("region", F.col("p").alias("node"), F.col("rank").alias("own"))
        each = live.select("region", "c", "node", "home").join(own, ["region", "node"], "left").join(sets.select("node", F.col("n").alias("nx"), "copies", "items"), "node")
        far = each.join(ip, "region").where("own is null or own < rank").select("region", "c", "node", "home", "own", "p", "rank", "nx", "np", "copies", "cp", F.size(F.array_intersect("items", "ip")).cast("long").alias("both"))
        far = cut(far.withColumn("d", 1 - F.col("both") / (F.col("nx") + F.col("np") - F.col("both"))))
        hits = far.where(_linked(percent))
        if pairs:
            hits = hits.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))
        else:
            hits = hits.select("node", F.col("p").alias("low"), F.col("cp").alias("links")).unionByName(hits.select(F.col("p").alias("node"), F.col("node").alias("low"), F.col("copies").alias("links")))
        found = _with(found, hits)
        # 1e-9 covers the rounding of distances
        rest = far.where("own is null").withColumn("near", F.min(F.struct("d", "rank")).over(Window.partitionBy("region", "node")))
        inside = F.col("near.d") <= rho
        first = F.col("rank") == F.col("near.rank")
        to = lambda rank: F.xxhash64("region", rank).alias("child")
        base = ["region", "c", "node", F.col("nx").alias("n")]
        stay = rest.where(first & F.col("home")).select(*base, F.when(inside, F.xxhash64("region", "rank")).otherwise(F.xxhash64("region", F.lit(0))).alias("child"), F.lit(True).alias("home"))
        window = (F.col("d") <= F.col("near.d") + 2 * r + 1e-9) & (F.col("d") <= rho + r + 1e-9)
        visit = rest.where(window & (~F.col("home") | (inside & (F.col("rank") > F.col("near.rank")))))
        visit = visit.select(*base, to("rank"), F.lit(False).alias("home"))
        beyond = rest.where(first & (F.col("near.d") > rho - r - 1e-9) & (~F.col("home") | inside)).select(*base, to(F.lit(0)), F.lit(False).alias("home"))
        children = cut(stay.unionByName(visit).unionByName(beyond))
        apart = children.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.first("c").alias("c")).where("m <= 2 * c").select("region")
        whole = rest.where(first).join(apart, "region", "left_anti").select("region", "node", "home")
        left = _with(left, whole)
        live = children.join(apart, "region").select(F.col("child").alias("region"), "node", "home", "n")
    if live is not None:
        left = _with(left, live.select("region", "node", "home"))
    comp = None
    if close and found is not None:
        found = cut(found)
        comp = components(found, "node", "low")
        comp = comp.unionByName(comp.select(F.col("comp").alias("node"), "comp").distinct())
    blocks = _blocks(left, sets, comp, most, weight)
    return cut(_with(found, _found(blocks, percent, pairs)))


def _with(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _blocks(left: DataFrame, sets: DataFrame, comp: DataFrame | None, most: int, weight: int) -> DataFrame:
    """Rows for _compare: small regions whole, larger ones as pairs of blocks; blocks of one large component don't meet."""
    rows = left.join(sets.select("node", "n"), "node")
    rows = rows.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if comp is not None else rows.withColumn("comp", F.lit(None).cast("long"))
    rows = cut(rows)
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w")).select("region", ((F.col("c") <= most) & (F.col("w") <= weight)).alias("small"))
    crowds = rows.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") >= most // 2) & F.col("comp").isNotNull()).select("region", "comp", F.col("comp").alias("class"))
    rows = rows.join(sizes, "region").join(crowds, ["region", "comp"], "left")
    rows = rows.withColumn("class", F.when(F.col("small"), F.lit(None).cast("long")).otherwise(F.col("class")))
    kinds = rows.groupBy("region", "class").agg(F.first("small").alias("small"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    parts = F.when(F.col("small"), F.lit(1)).otherwise(F.greatest(F.ceil(F.col("c") / max(1, most // 2)), F.ceil(F.col("w") / max(1, weight // 2)))).cast("int")
    kinds = kinds.select("region", F.coalesce("class", F.lit(0)).alias("class"), F.col("class").isNotNull().alias("same"), parts.alias("nb"))
    slots = kinds.select("region", "class", "same", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"))
    two = slots.select("region", F.col("class").alias("class2"), F.col("same").alias("same2"), F.col("i").alias("i2"))
    place, place2 = F.struct("same", "class", "i"), F.struct("same2", "class2", "i2")
    met = slots.join(two, "region").where((place <= place2) & ~(F.col("same") & F.col("same2") & (F.col("class") == F.col("class2"))))
    met = cut(met.select("region", "class", "same", "i", "class2", "same2", "i2", F.xxhash64("region", "class", "same", "i", "class2", "same2", "i2").alias("task"), (place == place2).alias("one")))
    rows = rows.withColumn("same", F.col("class").isNotNull()).withColumn("class", F.coalesce("class", F.lit(0)))
    at = rows.join(kinds.select("region", "class", "same", "nb"), ["region", "class", "same"])
    at = at.select("region", "class", "same", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("i"), "node", "home", "comp")
    keep = ["task", "node", "home", "comp"]
    one = at.join(met, ["region", "class", "same", "i"]).select(*keep, F.when(F.col("one"), 0).otherwise(1).alias("side"))
    other = met.where("not one").select("region", F.col("class2").alias("class"), F.col("same2").alias("same"), F.col("i2").alias("i"), "task")
    both = one.unionByName(at.join(other, ["region", "class", "same", "i"]).select(*keep, F.lit(2).alias("side")))
    return both.join(sets.select("node", "copies", "items"), "node").select(F.col("task").alias("region"), "node", "home", "side", "comp", "copies", "items")


def jaccard_components(docs: DataFrame, k: int, percent: int, pivots: int = 16, most: int = REGION, weight: int = WEIGHT, close: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, n_links, class_h1, class_h2, component, text_key.

    A row for each input row. class_h1 and class_h2 name the set, component the
    component without regard to ids (null for empty sets), text_key is xxhash64 of
    the text. n_links is the number of other rows linked with it, copies included;
    close leaves it out, and with it the comparisons that components don't need.

    Linked: 100 * |A and B| >= percent * |A or B| over sets of k-word shingles.
    component_id is the smallest doc_id of the component. Null or wordless
    texts have n_shingles 0, no links, and their own doc_id. Repeated rows
    and repeated or null doc_ids stay as rows; null ids are never a
    component's name unless it has no other. An empty table gives no rows.
    Very long texts are rows like others; most and weight bound what a task compares.
    """
    docs, summary = _summarised(docs, k, percent)
    near = _neighbours(docs, summary, k, percent, pivots, most, weight, close)
    names = summary.where("n > 0").groupBy(F.col("h1").alias("node")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    names = names.join(near, "node", "left").withColumn("comp", F.coalesce("low", "node"))
    best = names.groupBy("comp").agg(F.min("least").alias("component_id"))
    names = names.join(best, "comp").select(F.col("node").alias("h1"), F.col("comp").alias("component"), F.col("component_id").alias("least"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = summary.drop("fams", "row").join(names, "h1", "left")
    some = F.col("n") > 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        *([] if close else [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]),
        F.col("h1").alias("class_h1"), F.col("h2").alias("class_h2"), F.when(some, F.col("component")).alias("component"), "text_key",
    )


def jaccard_links(docs: DataFrame, k: int, percent: int, pivots: int = 16, most: int = REGION, weight: int = WEIGHT) -> DataFrame:
    """The exact join: (a, b), a < b, class_h1 of every two distinct sets that are linked, each pair once.

    A group of g different sets that are all linked has g (g - 1) / 2 rows.
    """
    docs, summary = _summarised(docs, k, percent)
    return _neighbours(docs, summary, k, percent, pivots, most, weight, pairs=True)


def keep_one_each(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of docs that stay when each component keeps one, columns unchanged.

    The row with the smallest doc_id stays, null ids last; of rows with one id
    the one of smallest text hash, and one of identical rows. Wordless and null
    texts are no duplicates of each other and all stay.
    """
    before = written()
    labelled = cut(jaccard_components(docs, k, percent, close=True).select("doc_id", "text_key", "component").where("component is not null"))
    drop_since(before, labelled)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    best = labelled.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = labelled.join(best, "component").select("doc_id", "text_key", (order == F.col("best")).alias("best"))
    keys = cut(ranked.groupBy("doc_id", "text_key").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n")))

    def named(rows: DataFrame) -> DataFrame:
        """At most BROADCAST_NODES rows are sent to all executors; more are shuffled."""
        rows = rows.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
        return F.broadcast(rows) if rows.count() <= BROADCAST_NODES else rows

    # rows are packed, so that no name of theirs can clash
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))
    kept = keyed.join(named(keys.where("not best")), same, "left_anti")
    again = keys.where("best and n > 1")
    if not again.isEmpty():
        again = named(again)
        once = kept.join(again, same, "left_semi").dropDuplicates(["id", "key"])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.select("row.*")
