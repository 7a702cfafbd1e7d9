"""Exact-substring dedup: bytes in any string of ``length`` bytes that also starts elsewhere are removed.

Every ``length``-byte string has an anchor, the smallest hash of its ``GRAM``-byte
parts at its first place there, that depends on its content alone; so equal
strings have equal anchors.  Neighbouring strings with one anchor at one place
form a segment.  Segments whose anchor
occurs once in the corpus hold no repeats.  The others are merged where they are
equal (with their number), and each distinct one goes to a shard by its anchor.

A shard of at most 2**21 bytes gets a suffix array by Larsson-Sadakane
refinement (ranks of prefixes of 5, 10, 20 ... bytes; groups of one are left
alone) and common prefixes by Kasai's rule, run in lanes side by side.
Neighbours with a common prefix of ``length`` bytes or more are one class; a
class with two strings, or one of a merged segment, is a repeat.  An anchor whose
segments have more bytes than half a shard is split: its shards also hand on one digest
for each class, and the sorted digests are merged across shards by binary search.

Inside a shard bytes are compared.  Elsewhere digests stand for them: 112 bits for
segments of one anchor, 128 bits for strings across shards of one anchor.  Of n
segments of an anchor two different ones are taken for equal with a chance below
n * n / 2**113, so below 1e-15 for a billion of them.  Memory is bounded by a
shard, a batch of texts or a single text.  A frequent anchor's rows meet its list
of marks in a plain join of two stored tables, which Spark splits where it is skewed.

Null texts count as empty.  Texts shorter than ``length`` are never changed.
Repeated rows remove each other.  Extra columns and null ids do not matter.  An
empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, materialise

GRAM = 32
#: Bits of a shard's positions: three of them fit a word.
POSITION_BITS = 21
SHARD_BYTES = (1 << POSITION_BITS) - 4096
#: Strings and bytes of texts looked at together.
BATCH_STARTS = 1 << 20
BATCH_BYTES = 1 << 22
#: Lanes in which common prefixes are found.
LANES = 8192
DEPTH = 5
#: Low bits of a segment's ``size`` that hold its number of strings; the others are part of its digest.
COUNT_BITS = 16


def _words(text: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte words at each position, zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(7, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8")[:, 0].astype(np.uint64)


def anchors(text: np.ndarray, length: int) -> np.ndarray:
    """For the string that starts at each position the least hash of its GRAM-byte parts (high bits) and the first place of it (low bits)."""
    n = len(text) - length + 1
    words = _words(text)
    m = len(text) - GRAM + 1
    h = words[:m] * np.uint64(0x9E3779B97F4A7C15)
    for i, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h = (h ^ (h >> np.uint64(31))) + words[i : i + m] * np.uint64(c)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h &= ~np.uint64((1 << POSITION_BITS) - 1)
    h |= np.arange(m, dtype=np.uint64)
    # least of each `width` neighbours, from running minima inside blocks of that width
    width = length - GRAM + 1
    blocks = -(-len(h) // width) + 1
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(h)] = h
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(grid, axis=1).reshape(-1)
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def _segments(texts: list[bytes], length: int):
    """(text number, h, first, starts) of the segments of some texts: neighbouring strings with one anchor at one place."""
    sizes = np.array([len(t) for t in texts])
    whole = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    for c in range(0, len(whole) - length + 1, BATCH_STARTS):
        least = anchors(whole[c : c + BATCH_STARTS + length - 1], length)
        first_text = int(np.searchsorted(ends, c, "right"))
        last_text = int(np.searchsorted(ends, c + len(least) - 1, "right"))
        for i in range(first_text, last_text + 1):
            begin, end = int(ends[i] - sizes[i]), int(ends[i]) - length + 1
            a, b = max(begin, c), min(end, c + len(least))
            if a >= b:
                continue
            own = least[a - c : b - c]
            edges = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
            yield i, own[edges[:-1]] >> np.uint64(POSITION_BITS), edges[:-1] + (a - begin), np.diff(edges)


def segments(base: DataFrame, length: int) -> DataFrame:
    """(h, dig, size, row, first) of every segment: ``dig`` and the high bits of ``size`` are its digest, the low bits its number of strings."""
    if length - GRAM >= 1 << COUNT_BITS:
        raise ValueError("strings are too long")
    low = (1 << 64 - COUNT_BITS) - 1

    def cut(batches):
        from xxhash import xxh3_128_intdigest

        names = ["h", "dig", "size", "row", "first"]
        for batch in batches:
            rows, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= BATCH_BYTES):
                    size += len(texts[b])
                    b += 1
                got = [[], [], [], [], []]
                for i, h, first, starts in _segments(texts[a:b], length):
                    view = memoryview(texts[a + i])
                    got[0].append(h.view(np.int64))
                    digests = [xxh3_128_intdigest(view[x : x + n + length - 1]) for x, n in zip(first.tolist(), starts.tolist(), strict=True)]
                    got[1].append(np.array([d >> 64 for d in digests], np.uint64).view(np.int64))
                    got[2].append((np.array([d & low for d in digests], np.uint64) << np.uint64(COUNT_BITS) | starts.astype(np.uint64)).view(np.int64))
                    got[3].append(np.full(len(h), rows[a + i], np.int64))
                    got[4].append(first)
                if got[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(g), pa.int64()) for g in got], names=names)
                a = b

    return base.select("row", "text").mapInArrow(cut, "h long, dig long, size long, row long, first long")


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes at least, each one's place, and whether a place's suffix differs there from the one before."""
    n = len(text)
    bits = np.uint64(POSITION_BITS)
    low = np.uint64((1 << POSITION_BITS) - 1)
    at = np.arange(n, dtype=np.uint64)
    order = np.sort((_words(text) >> np.uint64(64 - 8 * DEPTH)) << bits | at)
    sa = (order & low).astype(np.int64)
    new = np.concatenate([[True], order[1:] >> bits != order[:-1] >> bits])
    # a group's number is the place of its first suffix, counted from 1
    rank = np.zeros(2 * n + 2 * depth, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))
    h = DEPTH
    while h < depth:
        single = new & np.concatenate([new[1:], [True]])
        open_at = np.flatnonzero(~single)  # places in unsorted groups
        if not len(open_at):
            break
        own = sa[open_at]
        group = rank[own]
        # places of a group are next to each other, so sorting by group keeps groups in place
        key = np.sort(group.astype(np.uint64) << (bits + bits) | rank[own + h].astype(np.uint64) << bits | own.astype(np.uint64))
        own = (key & low).astype(np.int64)
        pair = key >> bits
        sa[open_at] = own
        differs = np.concatenate([[True], pair[1:] != pair[:-1]])
        new[open_at] = differs
        rank[own] = np.maximum.accumulate(np.where(differs, open_at + 1, 0))
        h *= 2
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    return sa, place, new


def common_prefixes(text: np.ndarray, sa: np.ndarray, place: np.ndarray, new: np.ndarray, enough: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the array, counted to ``enough`` at most.

    Kasai's rule: the suffix one byte on shares one byte less at least.  That
    holds after a suffix whose order is decided; those that the array leaves equal share enough, and the next one is
    compared from its first byte.  Lanes of neighbouring positions go on side by side.
    """
    n = len(text)
    words = np.concatenate([_words(text), np.zeros(enough + 16, np.uint64)])
    lcp = np.zeros(n, np.int64)
    step = max(1, -(-n // LANES))
    lanes = np.arange(0, n, step)
    held = np.zeros(len(lanes), np.int64)
    for k in range(step):
        i = lanes + k
        live = np.flatnonzero(i < n)
        i = i[live]
        p = place[i]
        j = np.where(p > 0, sa[np.maximum(p - 1, 0)], n)
        h = np.where(p > 0, np.maximum(held[live] - 1, 0), 0)
        room = np.minimum(n - np.maximum(i, j), enough)
        go = np.flatnonzero((h < room) & new[p])
        while len(go):
            x = words[i[go] + h[go]] ^ words[j[go] + h[go]]
            same = _equal_bytes(x)
            h[go] += same
            go = go[(same == 8) & (h[go] < room[go])]
        h = np.minimum(h, np.maximum(room, 0))
        held[live] = np.where(new[p], h, 0)
        lcp[p] = np.where(new[p], h, enough)
    return lcp


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 8-byte words."""
    out = np.zeros(len(x), np.int64)
    for shift in (32, 16, 8):
        high = x >> np.uint64(64 - shift) == 0
        out += np.where(high, shift // 8, 0)
        x = np.where(high, x << np.uint64(shift), x)
    return out + (x == 0)


def shard_repeats(parts: list[bytes], starts: np.ndarray, merged: np.ndarray, length: int):
    """For segments of a shard: repeated (each start of each segment), and a class number of each start.

    Starts of all segments are in one row, segment by segment.
    """
    text = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    sa, place, new = suffix_array(text, length)
    lcp = common_prefixes(text, sa, place, new, length)
    begin = np.repeat(np.cumsum(sizes) - sizes, starts)
    at = begin + np.arange(len(begin)) - np.repeat(np.cumsum(starts) - starts, starts)
    klass_of_place = np.cumsum(lcp < length)
    klass = klass_of_place[place[at]]
    weight = np.bincount(klass, np.where(np.repeat(merged, starts) > 1, 2, 1))
    return weight[klass] > 1, klass, at, text


def _intervals(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2)


def _repeats(pieces: DataFrame, length: int) -> DataFrame:
    """From (h, salt, split, dig, size, n, piece), dealt by (h, salt): marks (h, dig, size, lo, hi) of repeated starts, and of split anchors class digests with hi = lo + 1."""

    def work(batches):
        from xxhash import xxh3_128_digest

        held: list[tuple] = []
        size, last = 0, None

        def flush():
            keys = [x[:5] for x in held]
            parts = [x[6] for x in held]
            held.clear()
            starts = np.array([len(p) - length + 1 for p in parts])
            repeated, klass, at, text = shard_repeats(parts, starts, np.array([k[4] for k in keys]), length)
            out: list[tuple] = []
            ends = np.cumsum(starts)
            data = memoryview(text.tobytes())
            done: set[int] = set()
            for (h, split, dig, size, _), a, b in zip(keys, (ends - starts).tolist(), ends.tolist(), strict=True):
                for lo, hi in _intervals(repeated[a:b]).tolist():
                    out.append((h, dig, size, lo, hi, None, None))
                if split:
                    for s in range(a, b):
                        if (c := int(klass[s])) not in done:
                            done.add(c)
                            out.append((h, dig, size, s - a, s - a + 1, xxh3_128_digest(data[at[s] : at[s] + length]), bool(repeated[s])))
            for i in range(0, len(out), 50_000):
                cols = list(zip(*out[i : i + 50_000], strict=True))
                kinds = [pa.int64()] * 5 + [pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["h", "dig", "size", "lo", "hi", "digest", "known"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for h, salt, split, dig, own, n, piece in zip(*cols, strict=True):
                if held and ((h, salt) != last and size > SHARD_BYTES // 2 or size + len(piece) > SHARD_BYTES):
                    yield from flush()
                    size = 0
                last = (h, salt)
                held.append((h, split, dig, own, n, salt, piece))
                size += len(piece)
        if held:
            yield from flush()

    return pieces.mapInArrow(work, "h long, dig long, size long, lo long, hi long, digest binary, known boolean")


def _across(classes: DataFrame) -> DataFrame:
    """Marks of classes that another shard has too."""

    def merge(batches):
        held, last = [], None

        def flush(rows: list[pa.RecordBatch]):
            table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            digests = np.array(table.column(5).to_pylist(), "S16")  # the shards' classes in one sorted row
            others = np.searchsorted(digests, digests, "right") - np.searchsorted(digests, digests, "left") > 1
            return table.select(["h", "dig", "size", "lo", "hi"]).filter(pa.array(others & ~table.column(6).to_numpy(zero_copy_only=False)))

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and batch.column(5)[0].as_py() != last:
                yield flush(held)
                held = []
            held.append(batch)
            last = batch.column(5)[-1].as_py()
        if held:
            yield flush(held)

    dealt = classes.repartition("digest").sortWithinPartitions("digest")
    return dealt.mapInArrow(merge, "h long, dig long, size long, lo long, hi long")


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed spans (start, end) in bytes of the whole text, and the bytes that stay."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = materialise(base.withColumn("row", F.monotonically_increasing_id()), "texts")
    found = segments(base, length)
    often = materialise(found.groupBy("h").count().where("count > 1").select("h"), "often")
    found = materialise(found.join(often, "h", "left_semi"), "segments")
    discard(often)
    segment, starts = ["h", "dig", "size"], F.col("size").bitwiseAND((1 << COUNT_BITS) - 1)
    distinct = found.groupBy(*segment).agg(F.count("row").alias("n"), F.min(F.struct("row", "first")).alias("at"))
    distinct = materialise(distinct.select(*segment, "n", "at.*"), "distinct")
    total = distinct.agg(F.coalesce(F.sum(starts + length), F.lit(0))).first()[0]
    # a shard is begun at a new anchor once it is half full, so an anchor of half a shard at most is never cut
    half = SHARD_BYTES // 2
    split = distinct.groupBy("h").agg(F.sum(starts + (length - 1)).alias("bytes")).where(F.col("bytes") > half).select("h", F.ceil(F.col("bytes") / half).alias("parts"))
    split = materialise(split, "split")
    wanted = distinct.join(split, "h", "left").withColumns({"split": F.col("parts").isNotNull(), "salt": F.pmod("dig", F.coalesce("parts", F.lit(1)))})
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("h", "salt", "split", "dig", "size", "n", "first")).alias("parts"))

    def fetch(batches, most=(1 << COUNT_BITS) - 1):
        names = ["h", "salt", "split", "dig", "size", "n", "piece"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            for text, parts in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                out += [(*(p[k] for k in names[:6]), text[p["first"] : p["first"] + (p["size"] & most) + length - 1]) for p in parts]
            for i in range(0, len(out), 20_000):
                cols = list(zip(*out[i : i + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    pieces = base.select("row", "text").join(wanted, "row").select("text", "parts").mapInArrow(fetch, "h long, salt long, split boolean, dig long, size long, n long, piece binary")
    shards = max(1, -(-int(total) // (4 * SHARD_BYTES)))
    pieces = pieces.repartition(shards, "h", "salt").sortWithinPartitions("h", "salt")
    marks = materialise(_repeats(pieces, length), "marks")
    discard(distinct)
    discard(split)
    own = marks.where("digest is null").select(*segment, "lo", "hi")
    across = _across(marks.where("digest is not null"))
    each = materialise(own.union(across).groupBy(*segment).agg(F.collect_list(F.struct("lo", "hi")).alias("m")), "each")
    discard(marks)
    spans = found.join(each, segment).select("row", F.transform("m", lambda x: F.struct((F.col("first") + x["lo"]).alias("start"), (F.col("first") + x["hi"] + (length - 1)).alias("end"))).alias("s"))
    spans = spans.groupBy("row").agg(F.flatten(F.collect_list("s")).alias("s"))

    def remove(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, out, kept = as_bytes(batch.column(1)), [], []
            for text, marks in zip(texts, batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s, e in sorted((m["start"], m["end"]) for m in marks or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                edges = [0, *(x for m in merged for x in m), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                out.append([{"start": s, "end": e} for s, e in merged])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(out, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    whole = base.join(spans, "row", "left").select("doc_id", "text", "s")
    return whole.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
