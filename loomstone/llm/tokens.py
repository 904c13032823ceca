"""Token-id output: whole texts encoded with a public tokenizer, written as range-coded files, read back.

A file row is a group of consecutive documents in ascending doc_id order (null first): its place (part, seq), the documents'
ids and token counts, and one payload of ``rangecoder`` blocks, each block independently
decodable and checksummed. Files are written by Spark, so a lost executor's task is simply repeated.

The tokenizers library encodes every distinct piece of a worker once: a text may be cut before each space
that a non-space follows, between ASCII letters or digits and punctuation, and round a single line feed, because the byte-level pattern
always starts a new token there; a test holds this against whole texts. Pieces met for the first time are encoded together and told
apart by their length in bytes.

Defined results: a null or empty text is its end id alone; null doc_ids come first; rows with equal
doc_id are ordered by their text's hash; an empty table gives an empty folder of files. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm import rangecoder
from loomstone.llm.scratch import scratch_dir, small_batches
from loomstone.llm.textcore import Words, first_bytes, kept, passes, release, releasing, string_bytes, word_hashes

END_ID = 2
#: Slots of the table of pieces, ids of pieces that a Python worker remembers before it starts anew, and bytes of
#: pieces that are encoded in one text. Results do not depend on them.
SLOTS = 1 << 22
POOL_IDS = 12 << 20
JOINED_BYTES = 20_000
_U = np.uint64

#: Bytes that are white space or may begin a character that is.
_MAYBE_SPACE = np.zeros(256, dtype=bool)
_MAYBE_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True

FILE_SCHEMA = "part int, seq int, n_tokens long, doc_ids array<long>, counts array<int>, payload binary"


def encoder_for(path: str) -> Encoder:
    """One encoder for each tokenizer file in a Python worker: later tasks find its pieces known, other operators' tasks drop it."""
    return kept(("encoder", path), lambda: Encoder(load_tokenizer(path)))


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    # A task has one core: the library's own threads would wait for each other on it.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


#: Kinds of bytes: letters and digits, punctuation, both, and punctuation that no letter joins (as in ``'s``).
_ALNUM, _PUNCTUATION, _GRAPH, _APART = 1, 2, 3, 4


def byte_kinds(added: Iterable[str] = ()) -> np.ndarray:
    """Kinds of all bytes; those of ``added`` tokens, which are found before all others, have none."""
    kinds = np.zeros(256, dtype=np.uint8)
    for i in range(0x21, 0x7F):
        kinds[i] = _ALNUM if chr(i).isalnum() else _PUNCTUATION | _APART if chr(i) != "'" else _PUNCTUATION
    kinds[list({i for token in added for i in token.encode()} - set(np.flatnonzero(kinds == _ALNUM).tolist()))] = 0
    return kinds


def piece_starts(raw: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Starts of the pieces of all texts: each text, cut where a token surely starts."""
    cut = np.zeros(len(raw), dtype=bool)
    cut[:-1] = (raw[:-1] == 32) & ~_MAYBE_SPACE[raw[1:]]
    cut[offsets[1:-1][offsets[1:-1] < len(raw)] - 1] = False  # what follows is another text
    kind = kinds[raw]
    before, here = kind[:-1], kind[1:]
    # Punctuation behind a letter or digit; one of these behind punctuation.
    cut[1:] |= (before & here >> 1 | before >> 2 & here) & _ALNUM > 0
    line = np.flatnonzero(raw == 10)
    line = line[(line > 0) & (line < len(raw) - 1)]
    line = line[(kind[line - 1] & _GRAPH > 0) & (kind[line + 1] & _GRAPH > 0)]
    cut[line] = cut[line + 1] = True
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Token ids of texts; remembers pieces in a table of one slot each, by hash.

    A piece is told by 64 bits of hash of its bytes and length, and by its bytes (up to eight) or 64 bits of hash more. A
    piece whose slot another one has taken, or that a worker meets first, is encoded (again).
    """

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        # Bytes of each token of a byte-level vocabulary: one character each.
        self.token_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        # A line feed is no place to cut where an added token has one.
        self.kinds = byte_kinds(added) if not any("\n" in t for t in added) else np.zeros(256, dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.uint64)
        self.start, self.size = np.zeros(SLOTS, dtype=np.int32), np.zeros(SLOTS, dtype=np.uint16)  # size 0: no piece
        self.pool, self.used = np.zeros(POOL_IDS, dtype=np.int32), 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool[: self.used], np.zeros(self.used + len(ids), dtype=np.int32))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces; begin and end are their places in ``buf``. Start and size of their ids in the pool."""
        lens = end - begin
        flat = buf[np.arange(lens.sum()) + np.repeat(begin - np.cumsum(lens) + lens, lens)]
        ends = np.cumsum(lens)
        special = np.add.reduceat(flat == ord("<"), ends - lens) > 0
        odd = special | _MAYBE_SPACE[buf[end - 1]]
        # A piece that starts with a space starts a token behind any other piece; so does one that starts with a
        # letter or such behind a line feed, which is a token of its own there. Both are encoded in
        # texts of some thousand bytes and told apart by the bytes of their tokens; the others alone.
        spaced = (buf[begin] == 32) & (lens > 1) & ~_MAYBE_SPACE[buf[np.minimum(begin + 1, len(buf) - 1)]] & ~odd
        bare = (self.kinds[buf[begin]] & _GRAPH > 0) & ~odd
        sizes, start = np.zeros(len(begin), dtype=np.int64), np.zeros(len(begin), dtype=np.int64)
        lonely = np.flatnonzero(~(spaced | bare))
        for i, ids in zip(lonely.tolist(), self._encode([buf[begin[i] : end[i]].tobytes().decode() for i in lonely.tolist()]), strict=True):
            start[i], sizes[i] = self.used, len(ids)
            self._keep(ids)
        for some, gap in ((spaced, 0), (bare, 1)):
            if some.any():
                start[some], sizes[some] = self._together(flat[np.repeat(some, lens)], lens[some], gap)
        return start, sizes

    def _together(self, flat: np.ndarray, lens: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces, whose bytes are ``flat``, with ``gap`` line feeds behind each. Start and size of their ids in the pool."""
        total = np.cumsum(lens + gap)
        joined = np.full(total[-1], 10, dtype=np.uint8)
        joined[np.arange(len(flat)) + np.repeat(np.arange(len(lens)) * gap, lens)] = flat
        edges = np.append(np.flatnonzero(np.diff(total // JOINED_BYTES, prepend=-1)), len(lens))
        at, joined = np.append(0, total)[edges].tolist(), joined.tobytes()
        ids = np.concatenate(self._encode([joined[a:b].decode() for a, b in zip(at, at[1:], strict=False)]))
        reached = np.cumsum(self.token_bytes[ids])
        first = np.searchsorted(reached, total - lens - gap, side="right")
        start, sizes = self.used + first, np.searchsorted(reached, total - gap, side="left") + 1 - first
        self._keep(ids)
        return start, sizes

    def encode(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each followed by ``end_id``, and their counts."""
        raw, offsets = string_bytes(texts)
        starts = piece_starts(raw, offsets, self.kinds) if len(raw) else np.zeros(0, dtype=np.int64)
        buf = np.zeros(len(raw) + 8, dtype=np.uint8)
        buf[: len(raw)] = raw
        ends = np.append(starts[1:], len(raw))[: len(starts)]
        lens = ends - starts
        key = word_hashes(_pieces(buf, starts, ends))
        # The bytes themselves, or 64 bits more: a hash of the bytes turned over.
        check = first_bytes(buf, starts, lens)
        long = np.flatnonzero(lens > 8)
        check[long] = word_hashes(_pieces(~buf, starts[long], ends[long]))
        if 4 * self.used > 3 * POOL_IDS:  # a pass has far fewer ids than the rest; a longer text's pool grows
            self._forget()
        slot = (key & _U(SLOTS - 1)).astype(np.int64)
        start, size = self.start.take(slot).astype(np.int64), self.size.take(slot).astype(np.int64)
        known = (self.keys.take(slot) == key) & (self.checks.take(slot) == check) & (size > 0)
        missed = np.flatnonzero(~known)
        if len(missed):
            # Equal pieces are encoded once; of several pieces of a slot, it keeps one.
            order = missed[np.lexsort((lens[missed], check[missed], key[missed]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (key[order[1:]] != key[order[:-1]]) | (check[order[1:]] != check[order[:-1]]) | (lens[order[1:]] != lens[order[:-1]])
            first = order[new]
            at, n = self._learn(buf, starts[first], ends[first])
            which = np.cumsum(new) - 1
            start[order], size[order] = at[which], n[which]
            first = first[size[first] < 1 << 16]
            _, one = np.unique(slot[first], return_index=True)
            spot, first = slot[first[one]], first[one]
            self.keys[spot], self.checks[spot] = key[first], check[first]
            self.start[spot], self.size[spot] = start[first], size[first]
        edges = np.append(0, np.cumsum(size))[np.searchsorted(starts, offsets)]
        counts = np.diff(edges) + 1
        out = np.full(int(counts.sum()), end_id, dtype=np.int32)
        body = np.ones(len(out), dtype=bool)
        body[np.cumsum(counts) - 1] = False
        total = int(size.sum())
        place = np.repeat((start - np.cumsum(size) + size).astype(np.int32), size)
        place += np.arange(total, dtype=np.int32)
        out[body] = self.pool.take(place, mode="clip")
        return out, counts


def _pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Words:
    return Words(buf, np.zeros(0, dtype=bool), starts, ends, np.zeros(1, dtype=np.int64))


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, group: int = rangecoder.GROUP, block: int = rangecoder.BLOCK) -> None:
    """Encode all texts and write the files below ``path``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = encoder_for(tokenizer_path), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([h[1] for h in held])
            names, counts = [d for h in held for d in h[0]], np.concatenate([h[2] for h in held])
            columns = [pa.array([x], type=t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (len(ids), pa.int64()), (names, pa.list_(pa.int64())), (counts.tolist(), pa.list_(pa.int32())), (rangecoder.encode(ids, block), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "n_tokens", "doc_ids", "counts", "payload"])

        size = 0
        for batch in batches:
            for some in passes(batch, "text", 1 << 19, keep=True):
                ids, counts = encoder.encode(some.column("text"), end_id)
                names, at, row = some.column("doc_id").to_pylist(), 0, 0
                for to, end in enumerate(np.cumsum(counts).tolist(), 1):
                    # A group ends with the document that fills it; a longer document is a group of its own.
                    if size + end - at >= group or to == len(counts):
                        held.append((names[row:to], ids[at:end], counts[row:to]))
                        size += end - at
                        at, row = end, to
                        if size >= group:
                            yield flush()
                            held, size, seq = [], 0, seq + 1
                            release()
        if held:
            yield flush()
            held = []
        release()

    # Equal doc_ids are dealt by their texts' hashes, equal rows by their place in the input: no key is hot.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    ordered = keyed.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place")
    ordered.select("doc_id", "text").mapInArrow(run, FILE_SCHEMA).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the files.

    start counts the ids of all documents before it in file order.
    """
    small_batches(spark)
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    schema = "part int, seq int, at long, doc_id long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, doc_ids, counts = (batch.column(c)[row].as_py() for c in ("part", "seq", "doc_ids", "counts"))
                ids = rangecoder.decode(batch.column("payload")[row].as_buffer().to_pybytes()).astype("<u4")
                ends = np.cumsum(np.array(counts, dtype=np.int64))
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise rangecoder.CorruptBlock("the documents' counts do not sum to the group's ids")
                begins = ends - counts
                data = memoryview(ids.tobytes())
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(counts)
                arrays = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.full(n, seq, dtype=np.int32)), pa.array(begins), pa.array(doc_ids, type=pa.int64()), pa.array(counts, type=pa.int64()), pa.array(crcs, type=pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(begins, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "seq", "at", "doc_id", "n_tokens", "ids_crc32", "ids"][: len(arrays)])
                release()

    # Ids before a group: groups of a part in order, parts in order (one row for each task that wrote).
    groups = files.select("part", "seq", "n_tokens")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = groups.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    bases = groups.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, "part").select("part", "seq", (F.col("own") + F.col("before")).alias("base"))
    documents = files.select("part", "seq", "doc_ids", "counts", "payload").mapInArrow(releasing(run), schema)
    out = documents.join(bases, ["part", "seq"])
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def encode_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """Write ``docs`` to a new folder in the shared scratch space and read the files back."""
    path = scratch_dir(docs.sparkSession, "tokens")
    write_ids(docs, path, tokenizer_path)
    return read_ids(docs.sparkSession, path, with_ids)
