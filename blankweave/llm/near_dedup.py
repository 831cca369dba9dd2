"""Near-duplicate documents by SuperMinHash.

A document is its set of distinct word shingles. Equal sets are one class, which its
smallest doc_id represents; only representatives go on, so copies never become pairs.

1. *Signature.* SuperMinHash: at level j every shingle draws the j-th place of its own
   random permutation and a rank in [j, j+1); a place keeps the least rank it is given.
   A document stops at the level where all its places have lower ranks already.
2. *Banding.* ROWS places make a band. Documents that share a band meet in a bucket.
   At similarity 0.8 all BANDS bands differ with probability (1 - 0.8^6)^42 = 3e-6.
3. *Grouping.* The member of a bucket that sits in the fullest buckets is its pivot.
   A document joins the group of each pivot of its buckets: rows in proportion to the
   documents, however large a bucket is. Groups are dealt out in blocks of BLOCK.
4. *Verification.* Each block compares its members with the pivot on their full sets,
   then those that the pivot doesn't link with all others that share a band. In groups
   of several blocks the members that stay apart from the pivot's component visit the
   other blocks too, two blocks at a time, so no pair of a bucket is left out. Pairs are made inside numpy;
   only links leave, and in a block never more than a spanning forest.
5. *Union-find* inside a block, connected components between blocks.

Defined results: null or empty text has an empty set, is in no link and stays; a text
with fewer words than a shingle has one shingle, all its words; repeated rows with one
doc_id each get the component of their own text, whatever texts share the id, because
classes are told apart by their sets and not by ids; a null doc_id never represents a
class that has another id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .components import components

BANDS, ROWS = 42, 6
PLACES = BANDS * ROWS
BLOCK = 128
#: Bits of the filter that keeps texts of documents in no bucket from being read into sets: 8 MB at most.
FILTER_BITS = 1 << 26
_RANK_BITS = np.uint32(24)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    data, offsets = shared.text_bytes(column)
    data = shared.LOWER[data]
    starts, ends, first = shared.word_bounds(data, offsets)
    words = shared.span_hashes(data, starts, ends)
    windows = shared.window_hashes(words, size)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        else:
            out.append(shared.window_hashes(words[a:b], int(b - a)) if b > a else np.empty(0, np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """One row of ``places`` ranks for each set; level in the high bits, the random part below."""
    sizes = np.array([len(s) for s in sets], np.int64)
    ranks = np.full((len(sets), places), np.iinfo(np.uint32).max, np.uint32)
    flat = ranks.reshape(-1)
    element = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = None
    for level in range(places):
        if not len(element):
            break
        draw = shared.mix(element + np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        chosen = (level + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(places - level) >> np.uint64(32))).astype(np.int64)
        rank = np.uint32(level << 24) | (draw >> np.uint64(40)).astype(np.uint32)
        if level == 0:
            place = chosen
        else:
            if order is None:
                # Level 0 swapped entry 0 with its choice; entry 0 is not looked at again.
                order = np.tile(np.arange(places, dtype=np.uint8), (len(element), 1))
                order[np.arange(len(element)), first_choice] = 0
            rows = np.arange(len(element))
            place = order[rows, chosen].astype(np.int64)
            order[rows, chosen] = order[:, level]
        np.minimum.at(flat, owner * places + place, rank)
        done = ranks.max(axis=1) < np.uint32(min((level + 1) << 24, (1 << 32) - 1))
        stay = ~done[owner]
        if order is None:
            element, owner, first_choice = element[stay], owner[stay], chosen[stay]
        elif stay.sum() < 0.7 * len(stay):
            element, owner, order = element[stay], owner[stay], order[stay]
    return ranks


def band_keys(ranks: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys; a key tells its band, too."""
    cells = ranks.reshape(len(ranks), BANDS, ROWS).astype(np.uint64)
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(ranks), axis=0)
    for i in range(ROWS):
        keys = shared.mix(keys ^ (cells[:, :, i] + np.uint64(i << 40)))
    return keys.view(np.int64)


def text_key(text: str) -> Column:
    """Tells rows that share a doc_id apart by their texts."""
    return F.xxhash64(shared.text_or_empty(text))


def signed(docs: DataFrame, size: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, n, key_a, key_b, bands) of every document; equal sets have equal keys."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_key(text).alias("text_key"), shared.text_or_empty(text).alias("text"))
    schema = shared.fields(("doc_id", T.LongType()), ("text_key", T.LongType()), ("n", T.LongType()), ("key_a", T.LongType()), ("key_b", T.LongType()), ("bands", T.ArrayType(T.LongType())))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches):
            sets = shingle_sets(part.column("text"), size)
            n = np.array([len(s) for s in sets], np.int64)
            keys = band_keys(super_minhash(sets))
            used = n > 0
            ends = np.concatenate(([0], np.cumsum(np.where(used, BANDS, 0)))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[used].reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(n), *class_keys(sets), bands], names=schema.names)

    return source.mapInArrow(sign, schema)


def texts_of(docs: DataFrame, wanted: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) for at least the documents whose id is in ``wanted`` (id).

    A fixed-size bit filter, built by aggregation, goes to all tasks, so that texts of
    other documents are neither shuffled nor cut into words.
    """
    place = lambda column: F.expr(f"pmod(xxhash64({column}), {FILTER_BITS}) + 1")
    bits = (
        wanted.select(place("id").alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    )
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), shared.text_or_empty(text).alias("text"))
    at = source.withColumn("p", place("doc_id")).withColumn("bucket", F.bitmap_bucket_number("p")).withColumn("bit", F.bitmap_bit_position("p"))
    # At most FILTER_BITS / 32768 rows of 4 KB each.
    return at.join(F.broadcast(bits), "bucket").where(
        F.expr("(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int) >> cast(bit % 8 as int)) & 1 = 1")
    ).select("doc_id", "text")


def class_keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two 64-bit sums over each set, which with its size tell the class."""
    salts = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)
    return [pa.array(np.array([shared.mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)) for salt in salts]


def node_of() -> Column:
    """A class as one number: node of groups and links."""
    return F.xxhash64("key_a", "key_b", "n")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, items): the shingle sets of ``texts_of``."""
    schema = shared.fields(("key_a", T.LongType()), ("key_b", T.LongType()), ("n", T.LongType()), ("items", T.ArrayType(T.LongType())))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches):
            sets = shingle_sets(part.column("text"), size)
            sizes = [len(s) for s in sets]
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*class_keys(sets), pa.array(sizes, pa.int64()), items], names=schema.names)

    return texts_of(docs, wanted).mapInArrow(read, schema).select(node_of().alias("node"), "items")


class _Block:
    """Members of a group in numpy: their sets end to end, sizes and bands."""

    def __init__(self, rows: pa.Table):
        self.ids = list(zip(rows["rep"].to_pylist(), rows["node"].to_pylist(), strict=True))
        items = rows["items"].combine_chunks()
        self.offsets = items.offsets.to_numpy() - items.offsets[0].as_py()
        self.items = items.flatten().to_numpy().view(np.uint64)
        self.sizes = np.diff(self.offsets)
        bands = rows["bands"].combine_chunks()
        self.bands = bands.flatten().to_numpy().reshape(len(self.ids), -1)

    def set(self, i: int) -> np.ndarray:
        return self.items[self.offsets[i] : self.offsets[i + 1]]

    def linked(self, other: np.ndarray, among: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``among`` whose set is linked with the sorted set ``other``."""
        among = among[(100 * np.minimum(self.sizes[among], len(other)) >= percent * np.maximum(self.sizes[among], len(other))) & (self.sizes[among] > 0)]
        if not len(among):
            return among
        mine = np.concatenate([self.set(i) for i in among])
        at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
        starts = np.concatenate(([0], np.cumsum(self.sizes[among])[:-1]))
        common = np.add.reduceat((other[at] == mine).astype(np.int64), starts)
        return among[100 * common >= percent * (self.sizes[among] + len(other) - common)]


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


#: A link: both ends with their smallest doc_id and their class.
_LINK = shared.fields(("a_id", T.LongType()), ("a_node", T.LongType()), ("b_id", T.LongType()), ("b_node", T.LongType()))


def _edges(found: list[tuple[tuple[int, int], tuple[int, int]]]) -> pa.Table:
    rows = [(*a, *b) for a, b in found]
    return pa.table({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(_LINK.names)})


def _joined(links: DataFrame) -> DataFrame:
    """(node, component_node, component): what the links connect. Nodes are ordered by doc_id first."""
    ends = links.select(F.struct(F.col("a_id").alias("id"), F.col("a_node").alias("node")).alias("a"), F.struct(F.col("b_id").alias("id"), F.col("b_node").alias("node")).alias("b"))
    found = components(ends)
    return found.select("node.node", F.col("component.node").alias("component_node"), F.col("component.id").alias("component"))


def _within(percent: int, kind: type[_Block]):
    def links(rows: pa.Table) -> pa.Table:
        """The links of one block: with the pivot, then between members in different trees that share a band."""
        block, found = kind(rows), []
        pivots = np.flatnonzero(rows["is_pivot"].to_numpy(zero_copy_only=False))
        n, parent = len(block.ids), list(range(len(block.ids)))
        if not len(pivots):
            return _edges(found)
        pivot = int(pivots[0])
        for j in block.linked(block.set(pivot), np.setdiff1d(np.arange(n), [pivot]), percent):
            parent[j] = pivot
            found.append((block.ids[pivot], block.ids[j]))
        open_to = np.arange(n) != pivot
        for i in range(n):
            if _find(parent, i) == _find(parent, pivot):
                continue
            open_to[i] = False
            roots = np.array([_find(parent, j) for j in range(n)])
            others = np.flatnonzero(open_to & (roots != roots[i]) & (block.bands == block.bands[i]).any(axis=1))
            for j in block.linked(block.set(i), others, percent):
                if (a := _find(parent, int(j))) != (b := _find(parent, i)):
                    parent[b] = a
                    found.append((block.ids[i], block.ids[j]))
        return _edges(found)

    return links


def _across(percent: int, kind: type[_Block]):
    def links(rows: pa.Table) -> pa.Table:
        """The links between visitors and the members of a block; one for each component a visitor meets."""
        found = []
        visiting = rows["visitor"].to_numpy(zero_copy_only=False)
        members, visitors = rows.filter(pa.array(~visiting)), rows.filter(pa.array(visiting))
        if members.num_rows and visitors.num_rows:
            block, guests = kind(members), kind(visitors)
            own, theirs = members["component"].to_numpy(), visitors["component"].to_numpy()
            for i in range(len(guests.ids)):
                others = np.flatnonzero((own != theirs[i]) & (block.bands == guests.bands[i]).any(axis=1))
                hits = block.linked(guests.set(i), others, percent)
                _, at = np.unique(own[hits], return_index=True)
                found += [(guests.ids[i], block.ids[j]) for j in hits[at]]
        return _edges(found)

    return links


def linked_classes(signatures: DataFrame, items_of: Callable[[DataFrame], DataFrame], percent: int, block: type[_Block] = _Block) -> tuple[DataFrame, DataFrame]:
    """(key_a, key_b, n, node, rep) of every class of equal documents, and (node, component) of the linked classes.

    ``items_of`` gives (node, items) at least for the documents whose ids are in a table (id); ``block`` decides which
    items are linked.
    """
    classes = shared.cut(
        signatures.where("n > 0").groupBy("key_a", "key_b", "n").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")).withColumn("node", node_of()), "classes"
    ).where("rep is not null")
    in_bands = classes.select("node", "n", F.explode("bands").alias("key"))
    full = in_bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = shared.cut(in_bands.join(full, "key"), "members")
    centrality = members.groupBy("node").agg(F.sum("members").alias("weight"))
    pivots = members.join(centrality, "node").groupBy("key").agg(F.max_by(F.col("node"), F.struct("weight", "node")).alias("pivot"))
    grouped = members.join(pivots, "key").select("pivot", "node").where("node <> pivot").distinct()
    grouped = shared.cut(grouped, "groups")
    shared.drop_cut(members)
    sizes = grouped.groupBy("pivot").agg(F.count("*").alias("group_size"))
    blocks = F.ceil(F.col("group_size") / BLOCK).cast("int")
    dealt = grouped.join(sizes, "pivot").withColumn("blocks", blocks).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    heads = sizes.withColumn("blocks", blocks).select("pivot", F.col("pivot").alias("node"), "group_size", "blocks", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    dealt = dealt.select("pivot", "node", "blocks", "block").unionByName(heads.select("pivot", "node", "blocks", "block"))
    wanted = grouped.select("node").union(grouped.select("pivot")).distinct().join(classes.select("node", "rep", "bands"), "node")
    sets = shared.cut(items_of(wanted.select(F.col("rep").alias("id"))).dropDuplicates(["node"]).join(wanted, "node"), "sets")
    rows = dealt.join(sets, "node").withColumn("is_pivot", F.expr("node = pivot"))
    links = shared.cut(rows.groupBy("pivot", "block").applyInArrow(_within(percent, block), _LINK), "pivot-links")
    found = _joined(links)

    split = dealt.where("blocks > 1")
    at = split.join(found, "node", "left").select(*split.columns, F.coalesce("component_node", "node").alias("component"))
    head = at.where("node = pivot").select("pivot", F.col("component").alias("pivot_component")).distinct()
    at = shared.cut(at.where("node <> pivot").join(head, "pivot"), "split-groups")
    guests = at.where("component <> pivot_component")
    if not guests.isEmpty():
        visits = guests.withColumn("own", F.col("block")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).where("block <> own")
        # The visitors of a block come by the block they are from, each time to a copy of its members: a group is two blocks.
        hosts = at.join(guests.select("pivot", F.col("block").alias("own")).distinct(), "pivot").where("block <> own")
        columns = ["pivot", "block", "own", "node", "component"]
        both = hosts.select(*columns, F.lit(False).alias("visitor")).union(visits.select(*columns, F.lit(True)))
        more = shared.cut(both.join(sets, "node").groupBy("pivot", "block", "own").applyInArrow(_across(percent, block), _LINK), "block-links")
        found = _joined(links.union(more))
    return classes, found.select("node", "component")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key) of every row of ``docs``; kept is the smallest doc_id of its component."""
    signatures = shared.cut(signed(docs, size, id_column, text), "signatures")
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    classes, found = linked_classes(signatures, lambda wanted: sets_of(named, wanted, size), percent)
    return labelled(signatures, classes, found, ("text_key",))


def labelled(signatures: DataFrame, classes: DataFrame, found: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) and the columns ``keep`` of every signed row."""
    labels = classes.select("key_a", "key_b", "n", "rep", "node").join(found, "node", "left").select("key_a", "key_b", "n", F.coalesce("component", "rep").alias("component_id"))
    rows = signatures.select("doc_id", "n", "key_a", "key_b", *keep).join(labels, ["key_a", "key_b", "n"], "left")
    label = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), label.alias("component_id"), label.eqNullSafe(F.col("doc_id")).alias("kept"), *keep)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that reach one of smaller doc_id.

    A row goes by its id and its text, so another text under the same id stays. Rows that repeat id and text of
    one that stays, stay with it; a row without id goes only if its class has a row with one.
    """
    spare = near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias("_spare_id"), F.col("text_key").alias("_spare_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_spare_id")) & (text_key("text") == F.col("_spare_key"))
    return docs.join(spare, same, "left_anti")
