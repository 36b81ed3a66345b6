"""Near-duplicate detection by DartMinHash and banded joining.

A document is the weighted set of its five-word shingles, weighted by count. Every unit
of a shingle's weight is a region into which darts fall at hashed ranks (a Poisson
process in rank, the same in every document that has the region) and at a hashed
coordinate. The earliest dart of each coordinate is kept, which gives a signature whose
coordinates agree with the probability of the weighted Jaccard similarity; a document
throws only about ``k ln k + 2 k`` darts, however long it is. Documents that have
coordinates left over throw on with a higher last rank.

Bands of the signature are bucket keys. Texts that are equal word for word are one node.
Within a bucket all members are compared with its least node first. Then all pairs of a
bucket that are not of one class yet meet: the members outside the bucket's largest class
ask all others, in salted blocks whose signatures are compared as arrays, and those that
agree are compared. A comparison is exact: shared regions over all regions, 64-bit hashes.
Only links that join something new in their block leave it. Classes are the connected
components of the links, found by alternating large-star and small-star steps on stored
edge tables, which are deleted once they are superseded.

Defined results: a text without words is like no other and is a class of its own; rows
with the same id are the same document, and of its different texts the least by hash is
compared; a null id can't be named, its class is null; a null text counts as empty; ties
go to the least id; texts of any length are compared whole; columns besides id and text
are not looked at, and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import stored, table, text_or_empty
from tidewater.llm.shingles import mix, shingle_hashes, text_bytes, times, unit_regions, word_hashes

WIDTH, THRESHOLD = 5, 0.8
#: 24 bands of 4 coordinates: a pair of similarity 0.8 is missed with probability 3e-6.
BANDS, ROWS = 24, 4
#: Coordinates of 96 that must agree for a pair of the second turn to be compared. At a
#: similarity of 0.8 fewer agree with probability 3e-6.
AGREE = 58
#: Members of a bucket on each side of a block, and sets that meet a lead in one cell.
BLOCK, CELL = 1024, 512
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def dart_signatures(regions: np.ndarray, owner: np.ndarray, texts: int, k: int) -> np.ndarray:
    """(texts, k) array of the earliest dart of each coordinate; rows of texts without regions are 0."""
    out = np.zeros((texts, k), np.uint64)
    weight = np.bincount(owner, minlength=texts)
    limit = (k * math.log(k) + 2 * k) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        own = todo[owner]
        region, text = regions[own], owner[own]
        rank = np.zeros(len(region))
        darts, ranks, places = [], [], []
        m = 0
        while len(region):
            m += 1
            dart = mix(region + times(m))
            rank = rank - np.log1p(-(dart >> np.uint64(11)).astype(np.float64) / float(1 << 53))
            keep = rank < limit[text]
            region, text, rank, dart = region[keep], text[keep], rank[keep], dart[keep]
            id_ = mix(dart ^ np.uint64(0xA0761D6478BD642F))
            darts.append(id_)
            ranks.append(rank)
            places.append(text * k + ((id_ >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64))
        dart, rank, place = np.concatenate(darts), np.concatenate(ranks), np.concatenate(places)
        order = np.lexsort((dart, rank, place))
        place = place[order]
        first = np.r_[True, place[1:] != place[:-1]] if len(place) else np.zeros(0, bool)
        seen = np.zeros(texts * k, bool)
        seen[place[first]] = True
        whole = seen.reshape(texts, k).all(axis=1) & todo
        flat = np.zeros(texts * k, np.uint64)
        flat[place[first]] = dart[order][first]
        out[whole] = flat.reshape(texts, k)[whole]
        todo &= ~whole
        limit[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    n, k = signatures.shape
    keys = np.zeros((n, k // rows), np.uint64)
    for j in range(rows):
        keys = mix(keys + signatures[:, j :: rows][:, : k // rows] + times(j + 1))
    return keys


def _slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of few enough bytes that the arrays over their bytes and words stay small."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False))
        start, held = 0, 0
        for i, e in enumerate(ends):
            if e - held > most and i > start:
                yield batch.slice(start, i - start)
                start, held = i, ends[i - 1]
        if batch.num_rows:
            yield batch.slice(start)


def _list_array(flat: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), flat)


def _sign(width: int, bands: int, rows: int):
    def run(batches):
        for batch in _slices(batches):
            n = batch.num_rows
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            words, text = word_hashes(data, offsets)
            count = np.bincount(text, minlength=n)
            # two hashes of the word sequence name equal texts
            place = np.arange(len(words)) - (np.cumsum(count) - count)[text]
            name = []
            for seed in (0x632BE59BD9B4E019, 0xDA942042E4DD58B5):
                part = mix(words + mix(place.astype(np.uint64) * _GOLD + np.uint64(seed)))
                sums = np.r_[np.uint64(0), np.cumsum(part)]
                ends = np.cumsum(count)
                name.append(mix(sums[ends] - sums[ends - count] + count.astype(np.uint64)).view(np.int64))
            regions, owner = unit_regions(*shingle_hashes(words, text, width))
            darts = dart_signatures(regions, owner, n, bands * rows)
            keys = band_keys(darts, rows).view(np.int64)
            short = darts.astype(np.uint8).astype(np.int32)  # the high bits hold the coordinate
            has = count > 0
            lists = _list_array(pa.array(keys[has].ravel()), np.where(has, bands, 0))
            signs = _list_array(pa.array(short[has].ravel()), np.where(has, bands * rows, 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(name[0]), pa.array(name[1]), pa.array(count), lists, signs],
                names=[*batch.schema.names[:-1], "nd_a", "nd_b", "nd_words", "nd_bands", "nd_sign"],
            )

    return run


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(nd_id, nd_a, nd_b, nd_words, nd_bands, nd_sign): name of the word sequence, keys of its bands, its signature in 8 bits a coordinate."""
    given = docs.select(F.col(id_col).alias("nd_id"), text_or_empty(text).alias("nd_text"))
    schema = given.drop("nd_text").schema.add("nd_a", "long").add("nd_b", "long").add("nd_words", "long").add("nd_bands", T.ArrayType(T.LongType())).add("nd_sign", T.ArrayType(T.IntegerType()))
    return given.mapInArrow(_sign(width, bands, rows), schema)


def _regions(width: int):
    def run(batches):
        for batch in _slices(batches):
            words, text = word_hashes(*text_bytes(batch.column(1)))
            regions, owner = unit_regions(*shingle_hashes(words, text, width))
            regions = regions[np.lexsort((regions, owner))]
            ends = np.cumsum(np.bincount(owner, minlength=batch.num_rows)) * 8
            sets = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(regions)])
            yield pa.RecordBatch.from_arrays([batch.column(0), sets.cast(pa.binary())], names=["nd_node", "nd_set"])

    return run


def region_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(nd_node, nd_set): the sorted regions of each node's text, 64 bits each. Of several texts of an id the least by hash counts."""
    given = docs.select(F.col(id_col).alias("nd_node"), text_or_empty(text).alias("nd_text")).join(nodes, "nd_node", "left_semi")
    one = given.groupBy("nd_node").agg(F.min_by("nd_text", F.struct(F.xxhash64("nd_text"), F.hash("nd_text"))).alias("nd_text"))
    return one.mapInArrow(_regions(width), one.drop("nd_text").schema.add("nd_set", T.BinaryType()))


def _members(nodes: DataFrame) -> DataFrame:
    """(nd_band, nd_key, nd_n, nd_lead, nd_node) of the buckets that have two nodes and more; nd_lead is the least node."""
    members = nodes.select("nd_node", F.posexplode("nd_bands").alias("nd_band", "nd_key"))
    shared = members.groupBy("nd_band", "nd_key").agg(F.count("*").alias("nd_n"), F.min("nd_node").alias("nd_lead"))
    return members.join(shared.filter("nd_n > 1"), ["nd_band", "nd_key"])


def _alike(threshold: float):
    """Rows of cells, each cell's sets before its pairs: the pairs whose similarity is ``threshold`` or more."""

    def whole(cells: pa.Table) -> pa.RecordBatch:
        is_set = pc.is_valid(cells.column("nd_set"))
        sets, pairs = cells.filter(is_set), cells.filter(pc.invert(is_set))
        sets_of: dict = {}
        for cell, node, raw in zip(sets.column("nd_cell").to_pylist(), sets.column("nd_low").to_pylist(), sets.column("nd_set").to_pylist()):
            sets_of.setdefault(cell, {})[node] = np.frombuffer(raw, np.uint64)
        low, high = [], []
        todo: dict = {}
        for cell, x, y in zip(*(pairs.column(c).to_pylist() for c in ("nd_cell", "nd_low", "nd_high"))):
            todo.setdefault((cell, x), []).append(y)
        for (cell, x), others in todo.items():
            nodes = sets_of[cell]
            mine = nodes[x]
            others = [y for y in others if threshold * max(len(nodes[y]), len(mine)) <= min(len(nodes[y]), len(mine))]
            if not others or not len(mine):
                continue
            sizes = np.array([len(nodes[y]) for y in others])
            values = np.concatenate([nodes[y] for y in others])
            both = np.add.reduceat((mine[np.minimum(np.searchsorted(mine, values), len(mine) - 1)] == values).astype(np.int64), np.cumsum(sizes) - sizes)
            for y, good in zip(others, both >= threshold * (sizes + len(mine) - both)):
                if good:
                    low.append(x)
                    high.append(y)
        kind = cells.schema.field("nd_low").type
        return pa.RecordBatch.from_arrays([pa.array(low, kind), pa.array(high, kind)], names=["nd_low", "nd_high"])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            cell = held.column("nd_cell").to_numpy()
            begin = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if len(cell) and cell[0] != cell[-1] else 0
            if begin:  # the last cell may go on in the next batch
                yield whole(held.slice(0, begin))
                held = held.slice(begin)
        if held is not None and held.num_rows:
            yield whole(held)

    return run


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(nd_low, nd_high): of ``pairs`` (+ nd_cell) those that are alike, by their whole sets of regions.

    A cell brings each of its sets once, however many pairs need it, and the caller keeps cells small.
    """
    ends = pairs.select("nd_cell", F.explode(F.array("nd_low", "nd_high")).alias("nd_node")).distinct()
    rows = ends.join(sets, "nd_node").select("nd_cell", F.col("nd_node").alias("nd_low"), F.lit(None).cast(pairs.schema["nd_high"].dataType).alias("nd_high"), "nd_set")
    asked = pairs.select("nd_cell", "nd_low", "nd_high", F.lit(None).cast("binary").alias("nd_set"))
    dealt = rows.unionByName(asked).repartition("nd_cell").sortWithinPartitions("nd_cell", F.col("nd_set").isNull())
    return dealt.mapInArrow(_alike(threshold), pairs.select("nd_low", "nd_high").schema)


def _meet(agree: int, threshold: float, tile: int = 256):
    """Links of a block of askers and others that join different classes.

    A pair is looked at in the first bucket that it shares, if its signatures agree in
    ``agree`` coordinates; links that join nothing new in the block are left out.
    """
    rows = lambda t, c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(t.num_rows, -1)

    def run(block: pa.Table) -> pa.Table:
        asks = block.column("nd_ask")
        asker, other = block.filter(asks), block.filter(pc.invert(asks))
        node, lead = (t.column("nd_node").to_pylist() for t in (asker, other))
        _, kinds = np.unique(np.r_[asker.column("nd_class").to_numpy(), other.column("nd_class").to_numpy()], return_inverse=True)
        mine, theirs = kinds[: len(node)], kinds[len(node) :]
        x, y = rows(asker, "nd_sign"), np.ascontiguousarray(rows(other, "nd_sign").T)
        keys = [np.array(t.column("nd_bands").to_pylist(), np.int64) for t in (asker, other)]
        sets = [np.frombuffer(v, np.uint64) for v in other.column("nd_set").to_pylist()]
        size = np.array([len(v) for v in sets])
        band = block.column("nd_band")[0].as_py()
        root = np.arange(kinds.max() + 1)  # classes that links of this block have joined
        low, high = [], []
        for a in range(0, len(node), tile):
            count = np.zeros((len(node[a : a + tile]), len(lead)), np.uint8)
            for c in range(len(y)):
                count += x[a : a + tile, c, None] == y[c]
            for i, same in enumerate(count, a):
                j = np.flatnonzero((same >= agree) & (root[theirs] != root[mine[i]]))
                own = np.frombuffer(asker.column("nd_set")[i].as_py(), np.uint64)
                j = j[(np.minimum(size[j], len(own)) >= threshold * np.maximum(size[j], len(own))) & (size[j] > 0)]
                j = j[(keys[0][i] == keys[1][j]).argmax(axis=1) == band]
                if not len(j):
                    continue
                values = np.concatenate([sets[k] for k in j])
                both = np.add.reduceat((own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values).astype(np.int64), np.cumsum(size[j]) - size[j])
                for k in j[both >= threshold * (size[j] + len(own) - both)]:
                    if root[theirs[k]] != root[mine[i]]:
                        root[root == root[theirs[k]]] = root[mine[i]]
                        low.append(min(node[i], lead[k]))
                        high.append(max(node[i], lead[k]))
        kind = block.schema.field("nd_node").type
        return pa.table({"nd_low": pa.array(low, kind), "nd_high": pa.array(high, kind)})

    return run


def meetings(rest: DataFrame, features: DataFrame, threshold: float, agree: int = AGREE) -> DataFrame:
    """(nd_low, nd_high): links between members of a bucket that are of different classes.

    Of two members of different classes one at least isn't of the bucket's largest class,
    and asks. Askers and members are dealt into blocks by hash, and every block of askers
    meets every block of members, so no task holds a bucket.
    """
    bucket = ["nd_band", "nd_key"]
    kinds = rest.groupBy(*bucket, "nd_class").agg(F.count("*").alias("nd_n"))
    mixed = kinds.groupBy(*bucket).agg(F.sum("nd_n").alias("nd_size"), F.count("*").alias("nd_kinds"), F.max(F.struct("nd_n", "nd_class")).alias("m")).filter("nd_kinds > 1")
    mixed = mixed.select(*bucket, F.col("m.nd_class").alias("nd_main"), F.ceil((F.col("nd_size") - F.col("m.nd_n")) / BLOCK).alias("nd_rows"), F.ceil(F.col("nd_size") / BLOCK).alias("nd_columns"))
    open_ = stored(rest.join(mixed, bucket))
    salt = lambda n: F.pmod(F.xxhash64("nd_node", F.lit(7)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = [*bucket, "nd_node", "nd_class"]
    rows = open_.filter("nd_class != nd_main").select(*kept, F.lit(True).alias("nd_ask"), salt("nd_rows").alias("nd_row"), every("nd_columns").alias("nd_column"))
    columns = open_.select(*kept, F.lit(False).alias("nd_ask"), every("nd_rows").alias("nd_row"), salt("nd_columns").alias("nd_column"))
    dealt = rows.unionByName(columns).join(features, "nd_node")
    id_ = open_.schema["nd_node"].dataType
    found = dealt.groupBy(*bucket, "nd_row", "nd_column").applyInArrow(_meet(agree, threshold), T.StructType().add("nd_low", id_).add("nd_high", id_))
    return stored(found.distinct(), open_)


def links(docs: DataFrame, signed: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(nd_low, nd_high): links of similarity ``threshold`` or more that connect the classes. A node is the least id of equal texts."""
    nodes = stored(nodes_of(signed))
    members = stored(_members(nodes))
    sets = region_sets(docs, members.select("nd_node").distinct(), id_col, text, width)
    # a byte a coordinate is compared: unequal ones look equal with 1/256, equal ones never unequal
    brief = F.unhex(F.concat_ws("", F.transform("s.nd_sign", lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit(255))), 2, "0"))))
    signs = nodes.groupBy("nd_node").agg(F.min(F.struct("nd_bands", "nd_sign")).alias("s")).select("nd_node", "s.nd_bands", brief.alias("nd_sign"))
    features = stored(sets.join(signs, "nd_node"), nodes)
    low, high = F.least("nd_node", "nd_lead").alias("nd_low"), F.greatest("nd_node", "nd_lead").alias("nd_high")
    cell = F.xxhash64("nd_lead", F.pmod(F.xxhash64("nd_node", F.lit(3)), F.ceil(F.col("nd_n") / CELL))).alias("nd_cell")
    led = members.filter("nd_node != nd_lead").select(low, high, cell).groupBy("nd_low", "nd_high").agg(F.min("nd_cell").alias("nd_cell"))
    found = stored(verified(led, features.select("nd_node", "nd_set"), threshold))
    classes = components(found)
    # the lead has met its whole bucket; the others have yet to meet those of other classes
    rest = members.filter("nd_node != nd_lead").select("nd_band", "nd_key", "nd_node").join(classes, "nd_node", "left")
    rest = stored(rest.withColumn("nd_class", F.coalesce("nd_class", "nd_node")), members, classes)
    more = meetings(rest, features, threshold)
    return stored(found.union(more), found, more, features, rest)


def nodes_of(signed: DataFrame) -> DataFrame:
    """(nd_a, nd_b, nd_node, nd_bands, nd_sign): the distinct texts with words, each named by its least id."""
    named = signed.filter(F.col("nd_id").isNotNull() & (F.col("nd_words") > 0))
    return named.groupBy("nd_a", "nd_b").agg(F.min("nd_id").alias("nd_node"), F.first("nd_bands").alias("nd_bands"), F.first("nd_sign").alias("nd_sign"))


def components(edges: DataFrame, low: str = "nd_low", high: str = "nd_high") -> DataFrame:
    """(nd_node, nd_class): each node of an edge that isn't the least of its component, and that least node.

    Alternating algorithm: the large-star step hangs a node's larger neighbours on its
    least neighbour, the small-star step its smaller ones, until nothing changes. Each
    step is a grouped minimum and an equi-join; tables are stored between rounds and
    deleted once they are superseded.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("u"), F.col("v")).union(e.select(F.col("v"), F.col("u"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        out = joined.filter("v > u").select("v", "m") if large else joined.select("v", "m").union(least.select("u", "m"))
        return out.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    current = stored(edges.select(F.col(high).alias("u"), F.col(low).alias("v")).distinct())
    before = None
    while (now := state(current)) != before and now[0]:
        before = now
        current = stored(star(star(current, True), False), current)
    return current.select(F.col("u").alias("nd_node"), F.col("v").alias("nd_class"))


def with_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id) for every row: class_id is the least id of the class."""
    signed = stored(signatures(docs, id_col, text, width))
    found = links(docs, signed, id_col, text, width, threshold)
    classes = components(found)
    named = signed.filter(F.col("nd_id").isNotNull() & (F.col("nd_words") > 0)).groupBy("nd_a", "nd_b").agg(F.min("nd_id").alias("nd_node"))
    # stored, so that the join below is one of two tables and a key of very many rows can be split
    placed = stored(named.join(classes, "nd_node", "left").select("nd_a", "nd_b", F.coalesce("nd_class", "nd_node").alias("nd_class")), classes)
    # equal texts may be very many: the classes are joined to rows, and skewed joins are split
    rows = signed.select("nd_id", "nd_a", "nd_b", "nd_words")
    full = rows.filter("nd_words > 0").join(placed, ["nd_a", "nd_b"], "left")
    class_ = F.when(F.col("nd_id").isNotNull(), F.coalesce("nd_class", "nd_id"))
    out = full.select(F.col("nd_id").alias(id_col), class_.alias("class_id"))
    out = out.union(rows.filter("nd_words = 0").select("nd_id", "nd_id"))
    return stored(out, signed, found, placed)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
