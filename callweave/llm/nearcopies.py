"""Near copies of texts: five-word shingle sets of similarity 0.8 or more, all of them.

The SimHash blocks of simhash.py cannot find these: at similarity 0.8 a replaced stretch
changes a seventh of the bits of a fingerprint, so whole blocks that survive it are so
short that unrelated texts share them too. The pigeonhole is therefore applied to the
shingle sets themselves, where it is exact.

Two sets of similarity 0.8 share need(n) = ceil(0.8 n) of the larger one's n shingles at
least. In one order of all shingles (by hash) the first a - need(a) + slack(a) of the one
and the first b - need(b) + slack(b) of the other, a <= b, then share slack(a) at least.
These prefixes are the texts' signatures. A text with fewer than slack(need(n)) shingles
in its signature that others have in theirs has no near copy and goes (survivors()).

Of the texts that are left the whole sets are counted, and need(n) shingles of a text
must be met in others here as well. The order is now by rarity: the rarest n - need(n) + 1
shingles of either of two near copies have one in common. So a passage, a licence or a line
that very many texts share makes no block of its own, unless it is most of a text. What is
left are blocks of texts that share a shingle which is rare for both of them; every pair of
similarity 0.8 shares one, whatever its differences are. Pairs are decided on their whole
sets, after short parity prints of these have ruled out most of the others (near()).

A group of many near copies has far more pairs than links are needed. So the texts of a
block are compared with the block's hub first, the text whose shingles are the commonest
ones, as those of an original are among its copies. Blocks whose texts are all in one group
after that are settled; the others go through further rounds, in which a text that has
met all others of its block leaves it, until no block is open (settled()). The exact links
of the short fingerprints (simhash.links) are added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simhash
from .common import bounded_batches, intermediate, let_go, materialise, small_enough, without
from .graph import connected_components
from .suffixes import repeated, window_hashes, word_hashes

WORDS = 5
#: Least similarity, as a fraction, so that no rounding decides.
SIMILARITY = (4, 5)
#: Signature shingles that two near copies share at least, where their sets are this large, and
#: as a part of larger sets. More of them rule out more texts but are more rows to sort.
SLACK, SLACK_PART = 16, 8
#: Texts in a block up to which those that are still apart are compared with each other at once.
PAIRS_UP_TO = 8
#: How many times more hubs a larger block has in each round: fewer rounds, as each of them
#: costs some stages, for hardly more pairs, as the last round has most of these.
HUBS = 16


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles of a text, without regard to A-Z's
    case; of fewer words the whole sequence, of none an empty set."""
    words = word_hashes(text)
    return np.unique(window_hashes(words, min(WORDS, len(words)))) if len(words) else words


def need(n: int) -> int:
    """Shingles that a set of n shares at least with one that is no larger, if they are near copies."""
    return -(-n * SIMILARITY[0] // SIMILARITY[1])


def slack(n: int) -> int:
    return min(need(n), max(SLACK, -(-n // SLACK_PART)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, as signed numbers."""
    n = len(hashes)
    return hashes[: n - need(n) + slack(n)].view(np.int64)


def _need(n: Column) -> Column:
    return F.ceil(n * SIMILARITY[0] / SIMILARITY[1])


def _slack(n: Column) -> Column:
    return F.least(_need(n), F.greatest(F.lit(SLACK), F.ceil(n / SLACK_PART)))


def signatures(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, text_hash, fp (SimHash), n and keys (set size and signature) of each row.

    fp, n and keys are null where the same task has met the text before, which keeps copies
    from being worked out again and again.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_column).alias("id"), F.xxhash64(column).alias("text_hash"), F.col(column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        met: set[int] = set()
        for batch in batches:
            prints, sizes, keys = [], [], []
            for h, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if h in met:
                    prints.append(None), sizes.append(None), keys.append(None)
                    continue
                met.add(h)
                own = shingles(text)
                prints.append(simhash.fingerprint(text)), sizes.append(len(own)), keys.append(signature(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "text_hash", "fp", "n", "keys"]
            )

    return rows.mapInArrow(run, f"id {df.schema[id_column].dataType.simpleString()}, text_hash long, fp long, n int, keys array<long>")


def survivors(rows: DataFrame) -> DataFrame:
    """(text_hash) of the texts of rows (text_hash, n, keys) whose signatures meet enough others to have a near copy."""
    keyed = rows.where("keys is not null").select(F.explode("keys").alias("key"), F.col("text_hash").alias("id"), F.col("n").cast("long").alias("pos"))
    met = repeated(keyed).groupBy("id").agg(F.max("pos").alias("n"), F.count("*").alias("met"))
    return met.where(F.col("met") >= _slack(_need(F.col("n")))).select(F.col("id").alias("text_hash"))


def candidates(sets: DataFrame) -> DataFrame:
    """(key, text_hash, n, reach, mass) of the blocks of sets (text_hash, n, shingles): every pair of near copies meets in one.

    A key is one of the rarest n - need(n) + 1 shingles of a text; those that no other text
    has come first and make no row. mass is how many texts have a shingle of this one, on
    average. reach is the largest set that a near copy can have whose rarest shingle in
    common is the key: the two share at most what either has left from there on, and
    4 / 9 of their shingles, counted twice, at least.
    """
    keyed = sets.select("text_hash", "n", F.explode("shingles").alias("key"))
    heat = materialise(keyed.groupBy("key").agg(F.count("*").alias("heat")).where("heat > 1"), "heat")
    own = W.partitionBy("text_hash")
    ranked = keyed.join(heat, "key").withColumn("rank", F.row_number().over(own.orderBy("heat", "key")))
    ranked = ranked.withColumn("left", F.count("*").over(own) - F.col("rank") + 1).withColumn("mass", F.sum("heat").over(own) / F.col("n"))
    reach = F.floor(F.col("left") * sum(SIMILARITY) / SIMILARITY[0]) - F.col("n")
    return materialise(ranked.where(F.col("left") >= _need(F.col("n"))).select("key", "text_hash", "n", reach.cast("int").alias("reach"), "mass"), "candidates")


def blocks(found: DataFrame) -> DataFrame:
    """(key, text_hash, n, reach, hub, hub_n, hub_reach) of the blocks that several texts have.

    The hub of a block is its text that comes first in one order of all texts, by mass, so
    that the blocks of a group have few different hubs, and these are alike to most of it.
    """
    order = F.struct("mass", F.xxhash64("text_hash"))
    heads = found.groupBy("key").agg(F.count("*").alias("many"), F.max_by(F.struct("text_hash", "n", "reach"), order).alias("head")).where("many > 1")
    heads = materialise(heads.select("key", F.col("head.text_hash").alias("hub"), F.col("head.n").alias("hub_n"), F.col("head.reach").alias("hub_reach")), "heads")
    return materialise(found.drop("mass").join(heads, "key"), "blocks")  # from a table, the join can split a hot key


def like(n: str, reach: str, m: str, other: str) -> Column:
    """Whether sets of these sizes and reaches can be near copies at all, if the block's key is the rarest they share."""
    return (F.col(n) <= F.col(other)) & (F.col(m) <= F.col(reach))


def star_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each text of a block with its hub, if their sizes and reaches allow it."""
    return shared.where((F.col("text_hash") != F.col("hub")) & like("n", "reach", "hub_n", "hub_reach")).select(F.col("text_hash").alias("a"), F.col("hub").alias("b")).distinct()


def open_blocks(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, many, text_hash, n, reach, root) of the blocks that roots (node, root) has not brought
    into one group, without the texts that none of their block can be a near copy of."""
    own = shared.join(roots.select(F.col("node").alias("text_hash"), "root"), "text_hash", "left").select("key", "text_hash", "n", "reach", F.coalesce("root", "text_hash").alias("root"))
    own = materialise(own, "own")
    sizes = own.groupBy("key").agg(F.min("n").alias("small"), F.max("reach").alias("far"))
    some = materialise(own.join(materialise(sizes, "sizes"), "key").where("n <= far and small <= reach").drop("small", "far"), "some")
    apart = some.groupBy("key").agg(F.count("*").alias("many"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key", "many")
    return materialise(some.join(materialise(apart, "apart"), "key"), "open")


def drawn_hubs(many: DataFrame, turn: int) -> DataFrame:
    """(key, hub, hub_n, hub_reach, root_b): up to HUBS ** turn texts of each block, the least of each of so many slots."""
    order = F.xxhash64("text_hash", F.lit(turn))
    slots = many.groupBy("key", F.pmod(order, F.lit(HUBS**turn)).alias("slot"))
    drawn = slots.agg(F.min_by(F.struct("text_hash", "n", "reach", "root"), order).alias("h"))
    return materialise(drawn.select("key", F.col("h.text_hash").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.reach").alias("hub_reach"), F.col("h.root").alias("root_b")), "hubs")


def settled(shared: DataFrame, roots: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """roots (node, root) after each two texts of a block (key, text_hash, n, reach) are in one
    group, out of each other's reach, or compared by linked. Without reach, sizes alone tell.

    Small blocks compare all that are apart. In a larger one all texts meet some hubs,
    HUBS times as many in each round, and the hubs leave the block. So a block of n texts
    takes about log(n) / log(HUBS) rounds, fewer if its texts come together before.
    """
    if "reach" not in shared.columns:
        shared = shared.withColumn("reach", F.floor(F.col("n") * SIMILARITY[1] / SIMILARITY[0]).cast("int"))
    for turn in count(1):
        still = open_blocks(shared, roots)
        few = still.where(F.col("many") <= PAIRS_UP_TO).select("key", F.col("text_hash").alias("a"), "n", "reach", "root")
        other = few.select("key", F.col("a").alias("b"), F.col("n").alias("m"), F.col("reach").alias("reach_b"), F.col("root").alias("root_b"))
        pairs = few.join(other, "key").where((F.col("a") < F.col("b")) & (F.col("root") != F.col("root_b")) & like("n", "reach", "m", "reach_b")).select("a", "b")
        many = still.where(F.col("many") > PAIRS_UP_TO)
        hubs = drawn_hubs(many, turn)
        stars = many.join(hubs, "key").where((F.col("root") != F.col("root_b")) & like("n", "reach", "hub_n", "hub_reach")).select(F.col("text_hash").alias("a"), F.col("hub").alias("b"))
        pairs = materialise(pairs.union(stars).distinct(), "pairs")
        if not pairs.isEmpty():
            more = linked(pairs)
            if not more.isEmpty():
                roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        if hubs.isEmpty():
            return roots
        gone = hubs.select("key", F.col("hub").alias("text_hash"))
        shared = many.select("key", "text_hash", "n", "reach").join(gone, ["key", "text_hash"], "left_anti")
    raise AssertionError


def parities(hashes: np.ndarray) -> np.ndarray:
    """A set as 64-bit words, two bits and more a shingle: bit i is the parity of the number of hashes that are i modulo the bits."""
    room = 64 << max(0, (len(hashes) - 1).bit_length() - 5)
    counts = np.bincount((hashes & np.uint64(room - 1)).astype(np.int64), minlength=room)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def sets_of(wanted: DataFrame, docs: DataFrame, id_column: str, column: str) -> DataFrame:
    """(text_hash, n, shingles, bits) of the wanted (text_hash, id); one row of each text is read."""
    bounded_batches(docs.sparkSession)
    side = wanted.select("text_hash", F.col("id").alias("_id"))
    side = F.broadcast(side) if small_enough(side) else side
    rows = docs.select(F.col(id_column), F.xxhash64(column).alias("_hash"), F.col(column).alias("_text"))
    rows = rows.join(side, (F.col("_hash") == F.col("text_hash")) & F.col(id_column).eqNullSafe(F.col("_id"))).select("text_hash", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t) for t in batch.column(1).to_pylist()]
            sizes, bits = pa.array(map(len, made), pa.int32()), pa.array(map(parities, made), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([m.view(np.int64) for m in made], pa.list_(pa.int64())), bits], names=["text_hash", "n", "shingles", "bits"])

    return materialise(rows.mapInArrow(run, "text_hash long, n int, shingles array<long>, bits array<long>").dropDuplicates(["text_hash"]), "sets")


def near(n: Column, m: Column, x: Column, y: Column) -> Column:
    """Whether sets of n and m shingles and parities x and y may be near copies.

    Each shingle that only one set has changes one bit, so the bits that differ are no more
    than these, and near copies have (n + m) / 9 of them at most. The longer of two parities
    is folded in two first, as near copies are never further apart in size.
    """
    fold = lambda a, k: F.when(F.size(a) > k, F.zip_with(F.slice(a, F.lit(1), k), F.slice(a, k + 1, k), lambda p, q: p.bitwiseXOR(q))).otherwise(a)
    least = F.least(F.size(x), F.size(y))
    differ = F.aggregate(F.zip_with(fold(x, least), fold(y, least), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, b: s + b)
    return differ * (SIMILARITY[0] + SIMILARITY[1]) <= (n + m) * (SIMILARITY[1] - SIMILARITY[0])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the least similarity.

    Parities rule out most others before any set is moved. The set of a then travels with
    its pair, that of b, which is the hub of many pairs, does not: it meets them where they
    are, and a hub's pairs can be split over tasks.
    """
    side = lambda *names: sets.select(*[F.col(c).alias(name) for c, name in zip(("text_hash", "n", "bits"), names, strict=True)])
    close = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").where(near(F.col("n"), F.col("m"), F.col("x"), F.col("y")))
    close = materialise(close.select("a", "b"), "close")
    own = close.join(sets.select(F.col("text_hash").alias("a"), F.col("shingles").alias("sa")), "a")
    both = own.join(sets.select(F.col("text_hash").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    total = F.size("sa") + F.size("sb") - common
    return materialise(both.where(common * SIMILARITY[1] >= total * SIMILARITY[0]).select("a", "b"), "links")


def one_of_each(df: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """The rows of df without those that another document of their group stands for.

    A group is what links connect: equal texts, short fingerprints within two bits, and
    near copies. The document of the smallest id stays; ids that are null come after all
    others, and among equal ids the text of the smallest hash stays. Rows that repeat both
    id and text are one document and stay together. Texts without words are one group. An
    empty table stays empty; other columns, whatever their names, are kept.
    What goes is the smaller side by far, so it is what the texts are joined with:
    broadcast where its size allows, else by a shuffle.
    """
    with intermediate() as tables:
        gone = tables.keep(_copies(df, id_column, column))
    return without(df, gone, id_column, column)


def _copies(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, text_hash) of the rows that go."""
    rank = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("text_hash").alias("hash"))
    with intermediate() as tables:
        marked = materialise(signatures(df, id_column, column), "signatures")
        rows = tables.keep(materialise(marked.select("id", "text_hash"), "rows"))
        texts = tables.keep(materialise(marked.groupBy("text_hash").agg(F.min(rank).alias("winner"), F.max("fp").alias("fp")), "texts"))
        wanted = survivors(marked).join(texts, "text_hash").select("text_hash", F.col("winner.id").alias("id"))
        wanted = tables.keep(materialise(wanted, "wanted"))
    prints = materialise(texts.groupBy("fp").agg(F.min("text_hash").alias("node")), "nodes")
    same = texts.join(prints, "fp").select(F.col("text_hash").alias("a"), F.col("node").alias("b"))
    short = simhash.links(prints.select("fp"))
    of = lambda name: prints.select(F.col("fp").alias(name), F.col("node").alias(f"n{name}"))
    short = short.join(of("a"), "a").join(of("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))

    sets = sets_of(wanted, df, id_column, column)
    with intermediate() as tables:
        shared = tables.keep(blocks(candidates(sets)))
    linked = lambda pairs: verified(pairs, sets)
    roots = connected_components(same.union(short).union(linked(star_pairs(shared))))
    roots = settled(shared.where("text_hash <> hub").select("key", "text_hash", "n", "reach"), roots, linked)
    named = texts.join(roots, texts.text_hash == roots.node, "left").select("text_hash", "winner", F.coalesce("root", "text_hash").alias("root"))
    least = named.groupBy("root").agg(F.min("winner").alias("winner"))
    losing = named.select("text_hash", "root").join(least, "root").select("text_hash", "winner")
    stays = F.col("id").eqNullSafe(F.col("winner.id")) & (F.col("text_hash") == F.col("winner.hash"))
    return materialise(rows.join(losing, "text_hash").where(~stays).select("id", "text_hash").distinct(), "copies")
