"""Token ids in a compressed binary format: canonical length-limited Huffman code.

Format: Parquet rows of independent blocks in ascending doc_id order, written by
Spark so that any store works and lost tasks are redone.  A block holds
``doc_ids`` (signed 64-bit), ``doc_valid`` (a byte each), ``doc_tokens`` (signed
64-bit), ``payload`` (the code's bits, most significant first) and
``checkpoints`` (unsigned 64-bit bit offsets of every ``CHECKPOINT``-th token),
all little-endian.  (part, block) is the order.  The code itself is a table of
(id, bits): canonical codes follow from it.

Null and empty texts hold only the end id.  Rows with equal doc_id stay separate
rows, in the order of their first ids' bytes; null doc_ids come first.  An empty table
gives an empty file set.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, discard, materialise
from .tokens import LARGE_CACHE, default_tokenizer, encoder

CHECKPOINT = 128
BLOCK_TOKENS = 1 << 19
MAX_BITS = 18
FILE_TOKENS = 1 << 26
BLOCKS = "part int, block int, doc_ids binary, doc_valid binary, doc_tokens binary, n_tokens long, checkpoints binary, payload binary"


def id_type(tokenizer: str, end_id: int) -> str:
    """Little-endian unsigned 16-bit integers where every id fits, else 32-bit ones."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id) < 1 << 16 else "<u4"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, kind: str) -> DataFrame:
    """(doc_id, ids): ids as integers of type ``kind``, with the end id."""
    end = int(end_id).to_bytes(4, "little")

    def ids(batches):
        enc = encoder(tokenizer, LARGE_CACHE)
        for batch in batches:
            got = [np.frombuffer(enc.encode(t) + end, "<u4").astype(kind).tobytes() for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(ids, "doc_id long, ids binary")


def token_counts(encoded: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all documents, summed in each task first."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            c = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            if len(c) > len(total):
                c, total = total, c
            total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most ``max_bits`` by merging packages level by level."""
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    n = len(symbols)
    if n == 1:
        return {symbols[0]: 1}
    bits = max(max_bits, (n - 1).bit_length())
    weight = np.array([counts[s] for s in symbols], np.int64)
    # each level: sorted weights of leaves and packages, and which of them are leaves
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(bits):
        both = np.concatenate([weight, packages])
        leaf = np.concatenate([np.ones(n, bool), np.zeros(len(packages), bool)])
        order = np.argsort(both, kind="stable")
        both, leaf = both[order], leaf[order]
        levels.append(leaf)
        even = len(both) // 2 * 2
        packages = both[:even:2] + both[1:even:2]
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    return {s: int(k) for s, k in zip(symbols, length, strict=True)}


class Code:
    """Canonical code: shorter first, then by id."""

    def __init__(self, lengths: dict[int, int]):
        pairs = sorted((k, s) for s, k in lengths.items())
        self.bits = max(k for k, _ in pairs) if pairs else 1
        size = max(lengths, default=0) + 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
        self.symbol_of, self.length_of = np.zeros(1 << self.bits, "<u4"), np.ones(1 << self.bits, np.uint8)
        code = last = 0
        for k, s in pairs:
            code <<= k - last
            last = k
            self.code[s], self.length[s] = code, k
            at = code << (self.bits - k)
            self.symbol_of[at : at + (1 << (self.bits - k))] = s
            self.length_of[at : at + (1 << (self.bits - k))] = k
            code += 1

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Payload and checkpoints."""
        size = self.length[ids].astype(np.uint64)
        ends = np.cumsum(size)
        starts = ends - size
        total = int(ends[-1]) if len(ends) else 0
        word, room = (starts >> np.uint64(6)).astype(np.int64), np.uint64(64) - (starts & np.uint64(63))
        value = self.code[ids]
        over = size > room
        shift = np.where(over, np.uint64(0), room - size)
        head = np.where(over, value >> np.where(over, size - room, np.uint64(0)), value << shift)
        words = np.zeros(total // 64 + 2, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words[word[first]] = np.add.reduceat(head, first)
            at = np.flatnonzero(over)
            words[word[at] + 1] |= value[at] << (np.uint64(64) - (size[at] - room[at]))
        return words.astype(">u8").tobytes()[: (total + 7) // 8], starts[::CHECKPOINT].astype("<u8").tobytes()

    def unpack(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """All lanes between checkpoints step together, a table look-up each."""
        out = np.empty(n, "<u4")
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        shift, mask = 32 - self.bits, (1 << self.bits) - 1
        for k in range(min(CHECKPOINT, n)):
            lanes = (n - k + CHECKPOINT - 1) // CHECKPOINT
            pos = at[:lanes]
            byte = pos >> 3
            window = (raw[byte] << 24 | raw[byte + 1] << 16 | raw[byte + 2] << 8 | raw[byte + 3]).astype(np.int64)
            peek = ((window << (pos & 7)) >> shift) & mask
            out[k::CHECKPOINT] = self.symbol_of[peek]
            at[:lanes] += self.length_of[peek]
        return out


def write_blocks(encoded: DataFrame, code_table: DataFrame, lengths: dict[int, int], path: str, kind: str, files: int) -> None:
    """Range-partitions by doc_id into ``files`` and writes blocks and code table under ``path``."""

    def blocks(batches):
        code = Code(lengths)
        part, block, width = TaskContext.get().partitionId(), 0, int(kind[-1])
        docs: list[tuple] = []

        def close():
            ids = np.frombuffer(b"".join(d[1] for d in docs), kind)
            payload, marks = code.pack(ids)
            row = [part, block, np.array([d[0] or 0 for d in docs], "<i8").tobytes(), bytes(d[0] is not None for d in docs), np.array([len(d[1]) // width for d in docs], "<i8").tobytes(), len(ids), marks, payload]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            names = ["part", "block", "doc_ids", "doc_valid", "doc_tokens", "n_tokens", "checkpoints", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

        size = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append((doc_id, ids))
                size += len(ids) // width
                if size >= BLOCK_TOKENS:
                    yield close()
                    docs, size, block = [], 0, block + 1
        if docs:
            yield close()

    # rows of one doc_id, or of none, may be many: their first ids and a number tell them apart, so they lie in several files
    keys = ["doc_id", "head", "row"]
    ordered = encoded.withColumns({"head": F.substring("ids", 1, 16), "row": F.monotonically_increasing_id()}).repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    ordered.select("doc_id", "ids").mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    code_table.coalesce(1).write.parquet(f"{path}/code")


def read_code(spark: SparkSession, path: str) -> dict[int, int]:
    """The code table has a row per id of the vocabulary at most."""
    return {r["id"]: r["bits"] for r in spark.read.schema("id long, bits int").parquet(f"{path}/code").collect()}


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decodes the files: a row per document with its place in its part, count and crc32 (and its ids, if wanted)."""
    lengths = read_code(spark, path)

    def decode(batches):
        state: dict = {}
        for batch in batches:
            cols = batch.to_pydict()
            for part, block, doc_ids, valid, tokens, n, marks, payload in zip(*(cols[c] for c in ("part", "block", "doc_ids", "doc_valid", "doc_tokens", "n_tokens", "checkpoints", "payload")), strict=True):
                if "code" not in state:
                    state["code"] = Code(lengths)
                ids = state["code"].unpack(payload, marks, n).tobytes()
                counts = np.frombuffer(tokens, "<i8")
                ends = np.cumsum(counts)
                starts = ends - counts
                own = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                names = pa.array(np.frombuffer(doc_ids, "<i8"), mask=np.frombuffer(valid, np.uint8) == 0)
                m = len(own)
                out = [names, pa.array([part] * m, pa.int32()), pa.array([block] * m, pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                cols_out = ["doc_id", "part", "block", "start_in_block", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(own, pa.binary()))
                    cols_out.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=cols_out)

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    kind = "doc_id long, part int, block int, start_in_block long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    docs = blocks.mapInArrow(decode, kind)
    # a row per block: half a million tokens or more each, but for a file's last
    sizes = blocks.select("part", "block", "n_tokens")
    totals = sorted(map(tuple, sizes.groupBy("part").agg(F.sum("n_tokens")).collect()))  # a row per file
    before, run = [], 0
    for part, n in totals:
        before.append((part, run))
        run += n
    firsts = spark.createDataFrame(before, "part int, before long")
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.withColumn("earlier", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).join(firsts, "part")
    within = within.select("part", "block", (F.col("before") + F.col("earlier")).alias("first"))
    out = docs.join(within, ["part", "block"]).withColumn("start", F.col("first") + F.col("start_in_block"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Encode, count, build the code from the global counts and write."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    kind = id_type(tokenizer, end_id)
    encoded = materialise(encode_documents(docs, tokenizer, end_id, kind), "ids")
    counts = {r["id"]: r["n"] for r in token_counts(encoded, kind).collect()}  # at most the vocabulary
    lengths = code_lengths(counts) if counts else {}
    table = spark.createDataFrame(sorted(lengths.items()), "id long, bits int")
    # as many files as the session deals to, more where they would hold over FILE_TOKENS
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(counts.values()) // FILE_TOKENS))
    write_blocks(encoded, table, lengths, path, kind, files)
    discard(encoded)
