"""N-gram Jaccard self join by grouped prefixes, and the components of its links.

A document is its set of word shingles. One that links with another shares at least `similarity` of its own shingles,
so that only documents with so many shingles that occur elsewhere stay in (the screen of `blocks`). Documents with
equal sets become one. In the order of rising counts, two linked sets share a shingle among their first n - ceil(t n) + 1
(the prefix), with so many shingles from it to the end as the link needs. Documents with the same prefix and size are one group;
group pairs that share a prefix shingle are filtered by size and by what is left from the shingle on, then expanded to
members, which are verified.

Links are only wanted for components, so a pair that is already connected needs no look. First members meet the first of
their group, and each group the most central group of its prefix shingles. Then, turn by turn, what is left of a
group in a component (a cell) meets cells of other components: at each shingle all cells but those of its largest
component look for partners, among those of sizes that they can link with. A cell tries at most `tries` pairs in the first turn and `growth` times as many in each
further one, taken from all that it could try by hash, those with the most shingles left first; those that a link has joined meanwhile are out. After the
first turn a cell tries as many more as all cells together can in `spare` looks a document, so that few turns are made for little. The turn in
which no cell was held back has looked at every candidate pair of different components and is the last, so nothing is
missed; a class of N near copies costs about N pairs, not N^2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Block, BlockConfig, each_block, gram_hashes, hit_codes, is_hit, pack_blocks, repeated_keys
from .common import lasting, mix64, scratch, staged
from .lz_dedup import words_of


@dataclass(frozen=True)
class JoinConfig:
    """words: of a shingle. percent: 100 * intersection >= percent * union links. tries: pairs of a cell in the first turn,
    about. growth: of that number from turn to turn. spare: looks of cells at others, by the number of documents, that any but the first turn may take to try more than that; half as many pairs of
    members come of it, as these carry sets."""

    words: int = 5
    percent: int = 75
    tries: int = 4
    growth: int = 8
    spare: int = 8
    blocks: BlockConfig = field(default_factory=BlockConfig)


def shingles_of(block: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each document, by document and hash, and the document's number."""
    lower = block.data + np.where((block.data >= 65) & (block.data <= 90), np.uint8(32), np.uint8(0))
    found = words_of(lower, block.ends)
    sizes = np.diff(np.r_[np.int64(0), found.ends])
    h = gram_hashes(found.hashes, words)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = owner[: len(h)] == owner[words - 1 :][: len(h)]
    hashes, owners = [h[whole]], [owner[: len(h)][whole]]
    # fewer words: the sequence is the shingle, told apart from longer ones by its length
    for n in range(1, words):
        few = np.flatnonzero(sizes == n)
        if len(few):
            value = np.full(len(few), n, np.uint64)
            for j in range(n):
                value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + found.hashes[found.ends[few] - n + j])
            hashes.append(value)
            owners.append(few)
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])] if len(hashes) else np.zeros(0, bool)
    return hashes[new], owners[new]


_SETS = "doc_id long, n_shingles long, set_1 long, set_2 long, shared array<long>"


def _sets(config: JoinConfig, buckets: int):
    """Each document's size and set hash; of those that can link, the shared shingles by rising count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, block in enumerate(each_block(batch)):
                told = batch.column("found")[n]
                codes, counts = hit_codes(told if told.is_valid else ())
                hashes, owners = shingles_of(block, config.words)
                hit, at = is_hit(hashes, buckets, codes)
                size = np.bincount(owners, minlength=len(block.doc_ids))
                shared = np.bincount(owners[hit], minlength=len(block.doc_ids))
                stays = (size > 0) & (100 * shared >= config.percent * size)
                sums = [np.zeros(len(size), np.uint64) for _ in range(2)]
                for k, salt in enumerate((np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93))):
                    np.add.at(sums[k], owners, mix64(hashes * salt + np.uint64(k)))
                keep = hit & stays[owners]
                own, h, count = owners[keep], hashes[keep], counts[at[keep]] if len(counts) else np.zeros(0, np.uint32)
                order = np.lexsort((h, count, own))
                h = h[order].view(np.int64)
                offsets = np.r_[0, np.cumsum(np.where(stays, shared, 0))]
                ids = block.doc_ids
                for a in range(0, len(ids), 1024):
                    b = min(a + 1024, len(ids))
                    values = pa.array(h[offsets[a] : offsets[b]], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[a:b], pa.int64()),
                            pa.array(size[a:b].astype(np.int64), pa.int64()),
                            *(pa.array(s[a:b].view(np.int64), pa.int64()) for s in sums),
                            pa.ListArray.from_arrays(pa.array((offsets[a : b + 1] - offsets[a]).astype(np.int32)), values, mask=pa.array(~stays[a:b])),
                        ],
                        names=["doc_id", "n_shingles", "set_1", "set_2", "shared"],
                    )

    return run


def shingle_sets(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """doc_id, n_shingles, set_1, set_2, shared for each row of docs(doc_id, text) that has a doc_id; shared is null
    where a document has too few shingles that others have."""
    blocks = pack_blocks(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), config.blocks)
    buckets = blocks.screen_buckets(1 / 6)
    hits = repeated_keys(blocks, lambda block: shingles_of(block, config.words), buckets)
    return blocks.with_found(hits, all_blocks=True).mapInArrow(_sets(config, buckets), _SETS)


def _can_link(nx: Column, sx: Column, ny: Column, sy: Column, percent: int) -> Column:
    """Whether sets of sizes nx and ny can link whose first common shingle has sx and sy shingles from it to the end:
    so many they share at most, and a link needs percent * (nx + ny) / (100 + percent). Sizes allow it, too."""
    return (F.least(sx, sy) * (100 + percent) >= (nx + ny) * percent) & (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent)


def _verified(pairs: DataFrame, sets: DataFrame, config: JoinConfig) -> DataFrame:
    """Those of pairs(x, y) that link, by their sets."""
    sx = sets.select(F.col("doc_id").alias("x"), F.col("n_shingles").alias("nx"), F.col("shared").alias("sx"))
    sy = sets.select(F.col("doc_id").alias("y"), F.col("n_shingles").alias("ny"), F.col("shared").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    return pairs.join(sx, "x").join(sy, "y").where(both * 100 >= (F.col("nx") + F.col("ny") - both) * config.percent).select("x", "y")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links(x, y) reach from each node of theirs. Labels go along links and then
    jump to the label of their label, so that long chains take few rounds; every round is written out."""
    spark = links.sparkSession
    with scratch(spark):
        ways = F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("other")), F.struct(F.col("y").alias("node"), F.col("x").alias("other")))
        ends = staged(links.select(F.inline(ways)).distinct())
        labels = staged(ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
        while True:
            near = ends.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
            passed = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
            jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
            moved = staged(passed.join(jump, "low", "left").select("node", "label", F.least("low", "lower").alias("low")))
            labels = moved.select("node", F.col("low").alias("label"))
            if moved.where("low <> label").isEmpty():
                return lasting(labels)


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(doc_id, component) after further links(x, y): only components that they touch are looked at."""
    with scratch(links.sparkSession):
        of_x = labels.select(F.col("doc_id").alias("x"), F.col("component").alias("cx"))
        of_y = labels.select(F.col("doc_id").alias("y"), F.col("component").alias("cy"))
        edges = links.join(of_x, "x").join(of_y, "y").where("cx <> cy").select(F.col("cx").alias("x"), F.col("cy").alias("y"))
        moves = components(edges).withColumnRenamed("node", "component")
        return lasting(labels.join(moves, "component", "left").select("doc_id", F.coalesce("label", "component").alias("component")))


def _cells(index: DataFrame, members: DataFrame, labels: DataFrame, config: JoinConfig) -> tuple[DataFrame, DataFrame]:
    """Of index(shingle, group, n_shingles, left) the rows that can meet a row of another component, one for each cell, with its
    size and the least and greatest size of partners; and members(doc_id, group, n_shingles, component) with their
    place in their cell.

    Of a linked pair the smaller set has, by what is left at their first common shingle, room for partners of at least its own
    size (it is `open`), and its size is in the range that the larger one has room for; rows for which no other
    component has such a partner at the shingle go."""
    place = Window.partitionBy(*_CELL).orderBy("doc_id")
    placed = members.join(labels, "doc_id").withColumn("place", F.row_number().over(place) - 1)
    placed = staged(placed.withColumn("size", F.count("*").over(Window.partitionBy(*_CELL))))
    cells = placed.where("place = 0").select(*_CELL, "size")
    n, percent = F.col("n_shingles"), config.percent
    most = F.least(F.floor(F.col("left") * (100 + percent) / percent - n), F.floor(n * 100 / percent))
    at = index.join(cells, ["group", "n_shingles"]).withColumn("most", most).withColumn("open", F.col("most") >= n)
    at = staged(at.withColumn("least", F.ceil(n * percent / 100)).withColumn("high", F.least("most", n)))
    sizes = at.groupBy("shingle", "component").agg(F.min(F.when(F.col("open"), n)).alias("open_low"), F.max(F.when(F.col("open"), n)).alias("open_high"))
    probes = (F.col("open_low") <= F.col("high")) & (F.col("open_high") >= F.col("least"))
    at = at.join(_elsewhere(sizes, "open_low", "open_high"), ["shingle", "component"]).withColumn("probes", F.coalesce(probes, F.lit(False)))
    at = staged(at.drop("open_low", "open_high").where("probes or open"))
    sizes = at.groupBy("shingle", "component").agg(F.min(F.when(F.col("probes"), n)).alias("probe_low"), F.max(F.when(F.col("probes"), F.col("high"))).alias("probe_high"))
    wanted = F.col("open") & (F.col("probe_low") <= F.col("most")) & (F.col("probe_high") >= n)
    at = at.join(_elsewhere(sizes, "probe_low", "probe_high"), ["shingle", "component"]).where(F.col("probes") | wanted)
    return staged(at.select("shingle", *_CELL, "left", "size", "least", "most")), placed


def _elsewhere(sizes: DataFrame, low: str, high: str) -> DataFrame:
    """Of sizes(shingle, component, low, high) the least low and the greatest high of a shingle's other components."""
    ways = [Window.partitionBy("shingle").orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for order in (F.asc("component"), F.desc("component"))]
    lows, highs = [F.min(low).over(w) for w in ways], [F.max(high).over(w) for w in ways]
    return sizes.select("shingle", "component", F.least(*lows).alias(low), F.greatest(*highs).alias(high))


_CELL = ["group", "n_shingles", "component"]


def _widest(rows: DataFrame, cost: Callable[[int], Column], held: Callable[[int], Column], tries: int, budget: int, growth: int) -> tuple[int, bool]:
    """The most tries, `tries` at least, that cost all rows the budget at most; and whether they hold any row back."""
    steps = [tries]
    while growth > 1 and steps[-1] * growth < 2**60:
        steps.append(steps[-1] * growth)
    told = rows.agg(*(F.sum(cost(t).cast("double")) for t in steps), *(F.max(held(t)) for t in steps)).first()
    k = max((k for k in range(len(steps)) if (told[k] or 0) <= budget), default=0)
    return steps[k], bool(told[len(steps) + k])


def _candidates(at: DataFrame, placed: DataFrame, tries: int, budget: int, config: JoinConfig) -> tuple[DataFrame, bool]:
    """Pairs (x, y) of members of different components, at most about `tries` for each cell, or more if no more than
    `budget` looks and half as many pairs come of it; and whether any was held back."""
    # the cells of a shingle and a size stand in a row, one component after the other
    spot = ["shingle", "n_shingles"]
    counts = at.groupBy(*spot, "component").agg(F.count("*").alias("own"))
    before = Window.partitionBy(*spot).orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    runs = staged(counts.withColumn("first", F.coalesce(F.sum("own").over(before), F.lit(0))))
    inner = Window.partitionBy(*spot, "component").orderBy("group")
    others = at.join(runs.drop("own"), [*spot, "component"]).withColumn("spot", F.col("first") + F.row_number().over(inner) - 1)
    others = others.select("shingle", "spot", *(F.col(c).alias(f"o_{c}") for c in (*_CELL, "left", "size")))
    # all cells but those of a shingle's largest component look for partners, in the rows of sizes that they can link with
    largest = runs.groupBy("shingle", "component").agg(F.sum("own").alias("own")).groupBy("shingle").agg(F.max_by("component", F.struct("own", "component")).alias("largest"))
    rows = runs.groupBy("shingle", F.col("n_shingles").alias("o_n_shingles")).agg(F.sum("own").alias("all"))
    looks = at.join(largest, "shingle").where("component <> largest").join(rows, "shingle").where("o_n_shingles between least and most")
    own = runs.select("shingle", F.col("n_shingles").alias("o_n_shingles"), "component", "first", "own")
    looks = looks.join(own, ["shingle", "o_n_shingles", "component"], "left").na.fill(0, ["first", "own"]).withColumn("room", F.col("all") - F.col("own"))
    looks = staged(looks.where("room > 0").drop("all", "largest", "least", "most"))
    seeks, few = _widest(looks, lambda t: F.least("room", F.lit(t)), lambda t: F.col("room") > t, tries, budget, config.growth)
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.least("room", F.lit(seeks)) - 1))
    seekers = looks.withColumn("turn", turn).withColumn("spot", F.pmod(F.xxhash64("shingle", *_CELL) + F.col("turn"), F.col("room")))
    seekers = seekers.withColumn("spot", F.col("spot") + F.when(F.col("spot") >= F.col("first"), F.col("own")).otherwise(0)).drop("first", "own", "turn")
    met = seekers.join(others, ["shingle", "o_n_shingles", "spot"]).where(_can_link(F.col("n_shingles"), F.col("left"), F.col("o_n_shingles"), F.col("o_left"), config.percent))
    pair = [*_CELL, *(f"o_{c}" for c in _CELL)]
    pairs = met.groupBy(*pair).agg(F.first("size").alias("size"), F.first("o_size").alias("o_size"), F.max(F.col("o_left") / F.col("o_n_shingles")).alias("near"))
    own = Window.partitionBy(*_CELL)
    pairs = pairs.withColumn("rank", F.row_number().over(own.orderBy(F.desc("near"), F.xxhash64(*pair)))).withColumn("n", F.count("*").over(own))
    pairs = staged(pairs.withColumn("all", F.col("size") * F.col("o_size")))

    def share(t: int) -> Column:
        return F.ceil(F.lit(t) / F.least("n", F.lit(t)))

    tries, less = _widest(
        pairs, lambda t: F.when(F.col("rank") <= t, F.least("all", share(t))), lambda t: (F.col("rank") > t) | (F.col("all") > share(t)), tries, budget // 2, config.growth
    )
    # expanded to members: pair number k of a cell pair is member k div o_size of the one and k mod o_size of the other
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.least("all", share(tries)) - 1))
    drawn = pairs.where(F.col("rank") <= tries).withColumn("k", k).withColumn("k", F.pmod(F.xxhash64(*pair) + F.col("k"), F.col("all")))
    drawn = drawn.withColumn("place", F.floor((F.col("k") - F.col("k") % F.col("o_size")) / F.col("o_size")).cast("int")).withColumn("o_place", (F.col("k") % F.col("o_size")).cast("int"))
    one = placed.select(*_CELL, "place", F.col("doc_id").alias("x"))
    two = placed.select(*(F.col(c).alias(f"o_{c}") for c in (*_CELL, "place")), F.col("doc_id").alias("y"))
    found = drawn.join(one, [*_CELL, "place"]).join(two, [f"o_{c}" for c in (*_CELL, "place")])
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), few or less


def similarity_components(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text).

    component_id is the smallest doc_id that links reach. Documents without words or text have no shingles and stay by
    themselves. Rows with the same doc_id are one node of the graph; a row without a doc_id is left out of it and
    returned with a null component. Further columns are ignored; an empty table gives none.
    """
    with scratch(docs.sparkSession):
        return lasting(_components_of(docs, config))


def _components_of(docs: DataFrame, config: JoinConfig) -> DataFrame:
    sets = staged(shingle_sets(docs, config))
    able = sets.where(F.col("shared").isNotNull())
    key = ["n_shingles", "set_1", "set_2"]
    classes = able.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    member = staged(able.select("doc_id", *key).join(classes, key).select("doc_id", "rep", "n_shingles").distinct())
    reps = member.where("doc_id = rep").select("doc_id").distinct()
    own = staged(able.select("doc_id", "n_shingles", "shared").join(reps, "doc_id", "left_semi"))

    need = F.floor((F.col("n_shingles") * config.percent + 99) / 100)
    # of the prefix the shingles that no one shares come first
    unshared = F.col("n_shingles") - F.size("shared")
    prefix = F.slice("shared", F.lit(1), (F.col("n_shingles") - need + 1 - unshared).cast("int"))
    prefixes = own.select("doc_id", "n_shingles", unshared.alias("unshared"), prefix.alias("prefix")).where(F.size("prefix") > 0)
    prefixes = staged(prefixes.withColumn("group", F.xxhash64("n_shingles", "prefix")))
    members = prefixes.select("doc_id", "group", "n_shingles").distinct()
    groups = prefixes.groupBy("group", "n_shingles").agg(F.min("doc_id").alias("leader"), F.count("*").alias("members"), F.min("unshared").alias("unshared"), F.min_by("prefix", "doc_id").alias("prefix"))
    groups = staged(groups)
    left = F.col("n_shingles") - F.col("unshared") - F.col("place")  # shingles from this one to the end
    index = groups.select("leader", "group", "n_shingles", "unshared", F.posexplode("prefix").alias("place", "shingle"))
    index = staged(index.select("shingle", "leader", "group", "n_shingles", left.alias("left"), (F.col("unshared") / F.col("n_shingles")).alias("apart")))

    # members meet the first of their group; groups the most central one of their shingles: that with the least share of
    # shingles that no one else has, which the most others are like
    inside = prefixes.join(groups.where("members > 1").select("group", "n_shingles", "leader"), ["group", "n_shingles"]).where("doc_id <> leader").select(F.col("leader").alias("x"), F.col("doc_id").alias("y"))
    first = index.groupBy("shingle").agg(F.min(F.struct("apart", "leader", "n_shingles", "left")).alias("first"), F.count("*").alias("n")).where("n > 1")
    meets = index.join(first, "shingle").where((F.col("first.leader") != F.col("leader")) & _can_link(F.col("n_shingles"), F.col("left"), F.col("first.n_shingles"), F.col("first.left"), config.percent))
    meets = meets.groupBy("leader").agg(F.min("first").alias("first")).select(F.least("leader", "first.leader").alias("x"), F.greatest("leader", "first.leader").alias("y"))
    tried = staged(inside.unionByName(meets).distinct())
    nodes = own.select("doc_id", F.col("doc_id").alias("component")).distinct()
    labels = _merged(staged(nodes), _verified(tried, own, config))

    at, tries, budget, held = index.join(first.select("shingle"), "shingle", "left_semi"), config.tries, 0, True
    while held:
        at, placed = _cells(at.select("shingle", "group", "n_shingles", "left"), members, labels, config)
        pairs, held = _candidates(at, placed, tries, budget, config)
        pairs = staged(pairs.join(tried, ["x", "y"], "left_anti"))
        labels = _merged(labels, _verified(pairs, own, config))
        if held:
            at, tried, tries = at.dropDuplicates(["shingle", "group", "n_shingles"]), tried.unionByName(pairs), tries * config.growth
            budget = budget or config.spare * members.count()

    found = member.join(labels.withColumnRenamed("doc_id", "rep"), "rep").groupBy("doc_id").agg(F.min("component").alias("component"))
    rows = sets.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    rows = rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    without = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return rows.unionByName(without)
