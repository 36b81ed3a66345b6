"""Removal of byte strings that repeat across documents, by suffix sorting of shards.

A string of ``LENGTH`` bytes goes if it also starts in a document of a smaller id. To
bring equal strings together without a row for every byte:

1. Anchors. The smallest hash among the k-grams of a string is its anchor, so equal
   strings have equal anchors. The strings that share one anchor place form a block of
   adjacent starts. One packed entry a block (anchor key, hash of the block's bytes,
   document, place) goes to the shard of its key.
2. Shards. Blocks that are equal byte for byte to one of a smaller document are removed
   whole. What is left of an anchor key that has different blocks, the edges of repeats,
   is looked at byte by byte.
3. Suffix order. The bytes of those edge blocks go to shards by anchor key, where their
   suffixes are ordered by induced sorting (tidewater.llm.induced) with queues that move
   to disk; runs of suffixes that share LENGTH bytes and more with the one before are
   equal strings, and each start in a document larger than the least of its run goes.
4. Spans of a document are merged, cut out and the rest is hashed.

Defined results: ids are whole numbers; a null text counts as empty; a null id is neither
smaller nor larger than another, so its text is left alone and removes nothing; rows with
the same id are the same document; texts under LENGTH bytes are left alone; texts of any
length are read whole; columns besides id and text are not looked at, and may have any
name; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import stored, table, text_or_empty
from tidewater.llm.induced import packed, same_prefix, suffix_order
from tidewater.llm.neardup import _slices
from tidewater.llm.shingles import _BACK, _BASE, _powers, mix, text_bytes

LENGTH, GRAM = 50, 18
#: Bytes of text whose blocks go to one shard.
SHARD = 32 << 20
#: Bytes of suffix queues that a task holds in memory.
MEMORY = 1 << 27
#: Bytes of text that are cut into blocks at once, and the bits of a place in up to twice as many.
PART, BITS = 1 << 17, 19


def blocks(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Blocks of starts that share an anchor: text number, first start, starts, anchor key, hash of the bytes."""
    n, wide = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    forth, back = _places(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forth, out=sums[1:])
    span = lambda a, b: mix((sums[b] - sums[a]) * back[a])
    m = n - gram + 1
    grams = mix((sums[gram:] - sums[:m]) * back[:m])
    bits = np.uint64(max(BITS, int(n).bit_length()))  # equal for all parts, so that equal strings have equal anchors
    least = grams >> bits << bits | np.arange(m, dtype=np.uint64)
    step = 1
    while step * 2 <= wide:
        least = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    starts = n - length + 1
    least = np.minimum(least[:starts], least[wide - step : wide - step + starts])
    anchor = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    # a block ends where the anchor changes, where a text begins and where a text has no more whole strings
    new = np.empty(starts, bool)
    new[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    edges = np.r_[offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1])]
    new[edges[edges < starts]] = True
    head = np.flatnonzero(new)
    count = np.diff(np.r_[head, starts])
    text = np.searchsorted(offsets, head, side="right") - 1
    inside = head + length <= offsets[text + 1]
    head, count, text = head[inside], count[inside], text[inside]
    spot = anchor[head]
    body = mix(span(head, head + count - 1 + length) + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (spot - head).astype(np.uint64))
    return text, head - offsets[text], count, grams[spot], body


@functools.lru_cache(maxsize=1)
def _kept_places(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(_BACK, n)


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for ``n`` places; those of usual sizes are kept."""
    forth, back = _kept_places(2 * PART) if n <= 2 * PART else (_powers(_BASE, n), _powers(_BACK, n))
    return forth[:n], back[:n]


def _blocks_by_part(data: np.ndarray, offsets: np.ndarray):
    """``blocks`` of PART bytes at a time, so that the arrays stay in the processor's cache.

    Short texts stay whole. A longer text is cut, and a block with it where a cut meets one; copies of
    that block are then edges, which are looked at byte by byte.
    """
    n, size = len(offsets) - 1, np.diff(offsets)
    long = np.flatnonzero(size > PART)
    cuts = np.unique(np.r_[0, np.searchsorted(offsets, np.arange(PART, offsets[-1], PART)), long, long + 1, n])
    parts = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        begin, end = int(offsets[a]), int(offsets[b])
        pieces = [(begin, offsets[a : b + 1] - begin)]  # of less than two parts
        if size[a] > PART:
            pieces = [(at, np.array([0, min(at + PART + LENGTH - 1, end) - at])) for at in range(begin, end, PART)]
        for at, here in pieces:
            text, head, *rest = blocks(data[at : at + here[-1]], here)
            parts.append((text + a, head + (at - begin), *rest))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else blocks(data[:0], offsets[:1])


def _planes(x: np.ndarray) -> bytes:
    """Bytes of numbers by place value: those that hardly change stand together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(parts: list[bytes], kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.concatenate([np.frombuffer(p, np.uint8).reshape(size, -1).T.copy().view(kind).ravel() for p in parts])


def _pack(shards: int):
    def run(batches):
        for batch in _slices(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            text, head, count, key, body = _blocks_by_part(*text_bytes(batch.column(1)))
            shard = (key % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) > 0]) if len(order) else []
            rows = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)])]
            of = lambda x, kind: pa.array([x[r].astype(kind).tobytes() for r in rows], pa.binary())
            planes = lambda x, kind: pa.array([_planes(x[r].astype(kind)) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(shard[r[0]]) for r in rows], pa.int64()), of(key >> np.uint64(32), "u4"), of(body, "u8"), planes(ids[text], "i8"), planes(head, "u4"), of(count, "u1")],
                names=["sd_shard", "sd_key", "sd_body", "sd_doc", "sd_head", "sd_count"],
            )

    return run


_FOUND = T.StructType().add("sd_doc", "long").add("sd_head", "long").add("sd_count", "integer").add("sd_key", "long").add("sd_edge", "boolean")


def _resolve(shard: pa.Table) -> pa.Table:
    """Blocks of one shard: whole ones to remove, and edges of repeats for the suffix order."""
    join = lambda c, kind: np.frombuffer(b"".join(shard.column(c).to_pylist()), kind)
    key, body, doc, head, count = join("sd_key", "u4"), join("sd_body", "u8"), _unplaned(shard.column("sd_doc").to_pylist(), "i8"), _unplaned(shard.column("sd_head").to_pylist(), "u4"), join("sd_count", "u1")
    order = np.lexsort((doc, body, key))
    key, body, doc, head, count = key[order], body[order], doc[order], head[order], count[order]
    new_key = np.r_[True, key[1:] != key[:-1]]
    new_body = new_key | np.r_[True, body[1:] != body[:-1]]
    group, bodies = np.cumsum(new_key) - 1, np.cumsum(new_body) - 1
    least = doc[np.flatnonzero(new_body)][bodies]  # least document of equal blocks
    whole = doc > least
    kinds = np.bincount(group, new_body)[group]
    low = np.minimum.reduceat(doc, np.flatnonzero(new_key))[group]
    high = np.maximum.reduceat(least, np.flatnonzero(new_key))[group]
    edge = ~whole & (kinds > 1) & (high > low)
    take = whole | edge
    name = (key.astype(np.int64) << 20) ^ shard.column("sd_shard")[0].as_py()
    return pa.table({"sd_doc": doc[take], "sd_head": head[take].astype(np.int64), "sd_count": count[take].astype(np.int32), "sd_key": name[take], "sd_edge": edge[take]})


def _flat(lists: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
    """The structs of a column of lists one after the other, and the row of each."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), size)


def _contexts(length: int):
    def run(batches):
        for batch in batches:
            edges, row = _flat(batch.column(1))
            head, count, key = (edges.field(c) for c in ("sd_head", "sd_count", "sd_key"))
            data, offsets = text_bytes(batch.column(2))
            size = count.to_numpy().astype(np.int64) + length - 1
            ends = np.cumsum(size)
            start = offsets[row] + head.to_numpy()
            for a, b in _runs(size, 1 << 22):
                base = ends[a] - size[a]
                at = np.repeat(start[a:b] - (ends[a:b] - size[a:b] - base), size[a:b]) + np.arange(ends[b - 1] - base)
                places = np.r_[0, ends[a:b] - base].astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(places), pa.py_buffer(data[at])])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[a:b])), *(x.slice(a, b - a) for x in (head, count, key)), raw], names=_CONTEXT.names)

    return run


def _runs(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Slices of about ``most`` bytes each."""
    part = (np.cumsum(size) - size) // most
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(size) else []
    return list(zip(cuts, [*cuts[1:], len(size)]))


_CONTEXT = T.StructType().add("sd_doc", "long").add("sd_head", "long").add("sd_count", "integer").add("sd_key", "long").add("sd_bytes", "binary")
_SPAN = T.StructType().add("sd_doc", "long").add("sd_from", "long").add("sd_to", "long")


def repeated_starts(raw: np.ndarray, offsets: np.ndarray, docs: np.ndarray, counts: np.ndarray, length: int = LENGTH, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(string number, start) of the strings of ``length`` bytes that start in the first ``counts`` places and are also in a smaller document."""
    n = len(counts)
    begin = offsets[:-1] + np.arange(n)
    sizes = np.diff(offsets) + 1
    data = np.zeros(len(raw) + n, np.int16)  # zeros: nothing goes on beyond a string
    owners = np.repeat(np.arange(n, dtype=np.int32), sizes)
    inner = np.ones(len(data), bool)
    inner[begin + sizes - 1] = False
    data[inner] = raw
    data[inner] += 1
    words = packed(data, length)
    order = suffix_order(data, length, memory, words)
    own = np.arange(len(data)) < (begin + counts)[owners]
    order = order[own[order]]  # equal strings stay side by side without what lies between them
    shared = same_prefix(data, order, length, words)
    owner = owners[order]
    place = order - begin[owner]
    if not len(order):
        return owner, place
    new = ~shared
    doc = docs[owner]
    least = np.minimum.reduceat(doc, np.flatnonzero(new))
    gone = doc > least[np.cumsum(new) - 1]
    return owner[gone], place[gone]


def _suffixes(length: int, memory: int):
    def run(shard: pa.Table) -> pa.Table:
        doc, head, count = (shard.column(c).to_numpy() for c in ("sd_doc", "sd_head", "sd_count"))
        owner, place = repeated_starts(*text_bytes(shard.column("sd_bytes").cast(pa.large_binary()).combine_chunks()), doc, count, length, memory)
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)]) if len(owner) else np.zeros(0, np.int64)
        last = np.r_[new[1:], len(owner)] - 1 if len(owner) else new
        at = head[owner[new]]
        return pa.table({"sd_doc": doc[owner[new]], "sd_from": at + place[new], "sd_to": at + place[last] + length})

    return run


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, shard: int = SHARD, memory: int = MEMORY) -> DataFrame:
    """(sd_doc, sd_from, sd_to): byte spans to remove; spans of a document may overlap."""
    given = docs.select(F.col(id_col).cast("long").alias("sd_doc"), text_or_empty(text).alias("sd_text")).filter("sd_doc is not null")
    total = given.agg(F.sum(F.octet_length("sd_text"))).first()[0] or 0
    shards = max(1, -(-total // shard))
    packed = T.StructType().add("sd_shard", "long")
    for c in ("sd_key", "sd_body", "sd_doc", "sd_head", "sd_count"):
        packed = packed.add(c, "binary")
    found = stored(given.mapInArrow(_pack(shards), packed).groupBy("sd_shard").applyInArrow(_resolve, _FOUND))
    edges = found.filter("sd_edge").groupBy("sd_doc").agg(F.collect_list(F.struct("sd_head", "sd_count", "sd_key")).alias("sd_edges"))
    cut = edges.join(given, "sd_doc").select("sd_doc", "sd_edges", "sd_text").mapInArrow(_contexts(length), _CONTEXT)
    spans = cut.groupBy(F.pmod("sd_key", F.lit(shards * 4)).alias("sd_shard")).applyInArrow(_suffixes(length, memory), _SPAN)
    whole = found.filter("not sd_edge").select("sd_doc", F.col("sd_head").alias("sd_from"), (F.col("sd_head") + F.col("sd_count") - 1 + length).alias("sd_to"))
    return whole.union(spans)


_RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def _merged(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and bounds of the maximal runs of spans that overlap or touch within a row."""
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    wide = int(end.max(initial=0)) + 2
    reach = np.maximum.accumulate(end + row * wide)  # a row's places are all beyond those of the row before
    new = np.flatnonzero(np.r_[True, begin[1:] + row[1:] * wide > reach[:-1]]) if len(row) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(row)] - 1 if len(row) else new
    return row[new], begin[new], reach[last] - row[new] * wide


def _cut(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.num_columns - 2))
        spans, row = _flat(batch.column(batch.num_columns - 1))
        row, begin, end = _merged(row, spans.field("f").to_numpy(), spans.field("t").to_numpy())
        runs = np.bincount(row, minlength=batch.num_rows)
        gone = np.bincount(row, end - begin, batch.num_rows).astype(np.int64)
        whole, start, stop = memoryview(data), (offsets[row] + begin).tolist(), (offsets[row] + end).tolist()
        digests, j = [], 0
        for n, at, to in zip(runs.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            digest = hashlib.sha256()
            for k in range(j, j + n):
                digest.update(whole[at : start[k]])
                at = stop[k]
            digest.update(whole[at:to])
            digests.append(digest.hexdigest())
            j += n
        made = [pa.array(np.diff(offsets)), pa.array(gone), pa.array(runs), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names=[*batch.schema.names[:-2], *_RESULT])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = removed_spans(docs).groupBy("sd_doc").agg(F.collect_list(F.struct(F.col("sd_from").alias("f"), F.col("sd_to").alias("t"))).alias("sd_spans"))
    both = docs.join(spans, F.col("doc_id") == F.col("sd_doc"), "left").select("doc_id", text_or_empty().alias("text"), "sd_spans")
    schema = both.select("doc_id").schema
    for name, kind in zip(_RESULT, ("long", "long", "long", "string")):
        schema = schema.add(name, kind)
    return both.mapInArrow(_cut, schema)
