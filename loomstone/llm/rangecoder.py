"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A group of ids is cut into blocks of ``block`` ids. Every block starts from the same fixed state, learns from
its own ids alone and can be decoded alone (``decode_block``): the group's head holds only lengths and
checksums. For each id, predictions of three orders are mixed into one code interval:

* order 2 and order 1: the id that last followed the same two ids, or the same id, in this block, each with
  a confidence that rises with hits and falls back with a miss;
* order 0: the ids of this block so far, each by how often it came. It is summed anew at steps 8, 16, 32 and so on,
  when it takes in all ids before;
* what none of these knows: all ids with equal shares.

The weights that share the interval among the four are learned in the block, too: how often each was right so far at this
pair of confidences. What was counted before the last of these steps counts half.

Blocks are coded side by side: one numpy step handles the i-th id of every block. All totals are powers of two, so
coding does without divisions and decoding takes two. Carries are added to the words at the end.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"LRC4"
BLOCK = 1024
#: Ids of one group at most: bounds memory, and gives one and a half thousand blocks side by side.
GROUP = 3 << 19
#: Ids are below 2^MAX_BITS.
MAX_BITS = 28
#: Order 0 knows at most the first 2^15 ids of a block.
_HISTORY_BITS = 15
#: Lines of a block's table, and entries of a line: one of order 1, the others of order 2.
_LINES, _ENTRIES = 1 << 9, 1 << 3
_U = np.uint64


def _constants(kind: type, *values: int) -> list[np.ndarray]:
    """Arrays without dimensions: numpy takes these faster than numbers."""
    return [np.array(v, dtype=kind) for v in values]


#: Shares of the interval are in 4096ths. Outcomes of an id: order 2, order 1, order 0, none of them.
_SHARE_BITS, _SHARES = 12, 1 << 12
#: Bits of an id that are coded at once where no order knows it; those above take a step of their own.
_LOW_BITS = 16
_L1, _L3, _L16, _L32, _LFIELD = _constants(np.int64, 1, 3, 16, 32, 0xFFFF)
_I1, _I2, _I3 = _constants(np.int32, 1, 2, 3)
_NO, _U4, _U5, _U12, _U16, _U32, _FIELD, _TOP = _constants(np.uint64, 0, 4, 5, _SHARE_BITS, 16, 32, 0xFFFF, 1 << 32)
#: A number in each of three 16-bit fields; the top bits of these; the largest share.
_THREE, _TOPS, _LAST_SHARE, _THREE_FIELDS = _constants(np.uint64, 0x0001_0001_0001, 0x8000_8000_8000, _SHARES - 1, (1 << 48) - 1)
_LINE, _SUB = _constants(np.int64, (_LINES - 1) * _ENTRIES, _ENTRIES - 1)
_TWO_OUTCOMES, _NONE = _constants(np.uint8, 2, 3)
_ONE = np.array(1, dtype=np.int64)


class CorruptBlock(ValueError):
    """A block or head whose checksum does not match."""


def _first_counts() -> np.ndarray:
    """Outcomes that a block starts with, by key (confidence of order 2 * 8 + of order 1 * 2 + same)."""
    q2, q1, same = (x.ravel() for x in np.meshgrid(np.arange(4), np.arange(4), np.arange(2), indexing="ij"))
    rate2, rate1 = np.array([0.0, 0.4, 0.7, 0.9])[q2], np.array([0.0, 0.25, 0.5, 0.8])[q1]
    two = np.where(same, 1 - (1 - rate2) * (1 - rate1), rate2)
    one = np.where(same, 0.0, (1 - two) * rate1)
    rest = 1 - two - one
    return np.rint(np.stack([two, one, rest / 2, rest / 2], axis=1) * 64).astype(np.int32)


#: An outcome counts 16.
_COUNT, _FIRST = 16, _first_counts()
_KEYS = len(_FIRST)


class _Orders:
    """Predictions of order 1 and order 2 of all blocks by hashed context, and the weights of the orders by confidences.

    An entry of the table is id * 4 + confidence. The last id's line has order 1's entry, then those of order 2, dealt by the id before.
    """

    def __init__(self, lanes: int, steps: int) -> None:
        self.base, self.at = np.arange(lanes, dtype=np.int64) * (_LINES * _ENTRIES), np.arange(lanes, dtype=np.int32) * np.int32(_KEYS)
        self.table = np.zeros(lanes * _LINES * _ENTRIES, dtype=np.int32)
        self.counts = np.tile(_FIRST.T, lanes)
        # Of every step: key and outcome. A shorter last block leaves its own first cell.
        self.keys, self.outcomes = np.full((steps, lanes), (lanes - 1) * _KEYS, dtype=np.int32), np.zeros((steps, lanes), dtype=np.uint8)
        self.slots, self.sub = np.append(self.base, self.base + 1), np.ones(lanes, dtype=np.int64)
        self._weigh()

    def shrink(self, m: int) -> None:
        """Go on with the first m blocks."""
        self.slots = self.slots.reshape(2, -1)[:, :m].ravel()
        self.base, self.at, self.sub = self.base[:m], self.at[:m], self.sub[:m]

    def refresh(self, begin: int, end: int) -> None:
        """Learn the weights from the steps since the last time."""
        cells = self.outcomes[begin:end] * np.int32(self.counts.shape[1])
        cells += self.keys[begin:end]
        self.counts >>= 1
        self.counts += np.bincount(cells.ravel(), minlength=self.counts.size).reshape(4, -1).astype(np.int32) * np.int32(_COUNT)
        self._weigh()

    def _weigh(self) -> None:
        """Ends of the intervals of each key as 16 bits each, at least one share for each."""
        share = (_SHARES - 4.0) / np.maximum(self.counts.sum(axis=0), 1)
        ends, end = np.full(len(share), _SHARES << 48, dtype=np.uint64), np.zeros(len(share), dtype=np.uint64)
        for outcome in range(3):
            end += (self.counts[outcome] * share).astype(np.uint64) + _U(1)
            ends |= end << _U(16 * outcome)
        self.ends = ends

    def look(self) -> np.ndarray:
        """Predicted ids (rows: order 1, order 2) and confidences; ends of the intervals."""
        entries = self.table.take(self.slots, mode="clip").reshape(2, -1)
        self.ids, self.sure = entries >> _I2, entries & _I3
        key = self.sure[1] << _I2
        key += self.sure[0]
        key <<= _I1
        key += self.ids[0] == self.ids[1]
        key += self.at
        self.key = key
        return self.ends.take(key, mode="clip")

    def learn(self, step: int, x: np.ndarray, narrow: np.ndarray, hit: np.ndarray, outcome: np.ndarray) -> None:
        """The id (``narrow``: in 32 bits) takes the place of what was predicted; the confidence rises with hits, up to 3, and is 1
        after a miss."""
        m = len(x)
        self.keys[step, :m], self.outcomes[step, :m] = self.key, outcome
        sure = np.minimum(self.sure, _I2)
        sure *= hit
        narrow = narrow << _I2
        narrow += _I1
        sure += narrow
        self.table[self.slots] = sure.ravel()
        line = x << _L3
        line &= _LINE
        np.add(line, self.base, out=self.slots[:m])
        np.add(self.slots[:m], self.sub, out=self.slots[m:])
        self.sub = np.maximum(x & _SUB, _L1)


def _phases(steps: int) -> Iterator[tuple[int, int, int]]:
    """Steps from and to which order 0 knows the first 2^k ids (k = 0: none), and k."""
    begin, k = 0, 0
    while begin < steps:
        end = min(8 if not begin else 2 * begin, steps) if k < _HISTORY_BITS else steps
        yield begin, end, k
        begin, k = end, end.bit_length() - 1


def _lengths(n: int, block: int) -> np.ndarray:
    """Ids of each block: all full but the last."""
    return np.minimum(np.arange(n, 0, -block), block) if n else np.zeros(0, dtype=np.int64)


class _Known:
    """What order 0 knows of all ids of blocks (rows of ``padded``), which the writer has from the start."""

    def __init__(self, padded: np.ndarray, bits: int) -> None:
        lanes, steps = padded.shape
        at_bits = max(steps - 1, 1).bit_length()
        kind = np.int32 if bits + at_bits < 32 else np.int64
        key = np.sort(padded.astype(kind) << at_bits | np.arange(steps, dtype=kind), axis=1)
        place = (key & ((1 << at_bits) - 1)).astype(np.int64) * lanes
        place += np.arange(lanes)[:, None]
        key >>= at_bits
        rank = np.zeros(key.shape, dtype=np.int32)
        np.cumsum(key[:, 1:] != key[:, :-1], axis=1, dtype=np.int32, out=rank[:, 1:])
        self.wide = int(rank[:, -1].max()) + 1
        rank += np.arange(lanes, dtype=np.int32)[:, None] * np.int32(self.wide)
        # Of each step: the id's number among its block's, in the order of ids.
        self.cells = np.empty((steps, lanes), dtype=np.int32)
        self.cells.reshape(-1)[place.ravel()] = rank.ravel()
        self.counts = np.zeros((lanes, self.wide), dtype=np.uint32)
        self.entries = self.counts.ravel()

    def refresh(self, begin: int, end: int) -> None:
        """Take in the steps since the last time: ids before each id << 16 | how often it came."""
        self.counts += np.bincount(self.cells[begin:end].ravel(), minlength=self.counts.size).reshape(self.counts.shape).astype(np.uint32)
        entries = np.cumsum(self.counts, axis=1, dtype=np.uint32)
        entries -= self.counts
        entries <<= np.uint32(16)
        entries |= self.counts
        self.entries = entries.ravel()


class _Writer:
    """Low ends and ranges of all blocks; a word leaves where a range falls below 2^32."""

    def __init__(self, lanes: int, rows: int) -> None:
        self.low, self.range = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
        self.out, self.sent, self.carry = np.zeros((rows, lanes), dtype=np.uint32), np.zeros((rows, lanes), dtype=bool), np.zeros((rows, lanes), dtype=bool)
        self.row = 0

    def move(self, by: np.ndarray, size: np.ndarray) -> None:
        """Move the low ends; the ranges become ``size``."""
        low, row, m = self.low, self.row, len(by)
        low += by
        np.less(low, by, out=self.carry[row, :m])
        self.out[row, :m] = low >> _U32
        gone = np.less(size, _TOP, out=self.sent[row, :m])
        shift = gone.astype(np.uint64)
        shift <<= _U5
        low <<= shift
        size <<= shift
        self.range = size
        self.row += 1

    def finish(self, m: int) -> None:
        """End all blocks but the first m: one word more tells a block's interval, since the reader sees zeros behind it."""
        ended, rest = slice(m, len(self.low)), self.low[m:] + _U((1 << 32) - 1)
        self.carry[self.row, ended], self.out[self.row, ended], self.sent[self.row, ended] = rest < self.low[m:], rest >> _U32, True
        self.low, self.range = self.low[:m], self.range[:m]

    def words(self) -> list[bytes]:
        sent, carry = self.sent.T.ravel(), self.carry.T.ravel()
        words = self.out.T.ravel()[sent]
        count = np.cumsum(sent, dtype=np.int32)
        at = np.flatnonzero(carry)
        add_carries(words, count[at] - sent[at] - 1)
        ends = count[len(self.sent) - 1 :: len(self.sent)].tolist()
        return [words[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]


def add_carries(words: np.ndarray, at: np.ndarray) -> None:
    """Add 1 to each of the words at ``at``; one that overflows carries into the word before it."""
    while len(at):
        words[at] += np.uint32(1)
        at = at[words[at] == 0] - 1


class _Reader:
    """Distances of the code from the low ends, and ranges, of all blocks, whose words are the rows of ``words``."""

    def __init__(self, words: np.ndarray) -> None:
        lanes, width = words.shape
        self.code, self.range = words[:, 0].astype(np.uint64) << _U32 | words[:, 1], np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
        self.flat, self.at = words.reshape(-1), np.arange(lanes, dtype=np.int64) * width + 2

    def move(self, size: np.ndarray) -> None:
        """The ranges become ``size``; a word enters where one falls below 2^32."""
        lane = (size < _TOP).nonzero()[0]
        spot = self.at[lane]
        self.code[lane] = self.code[lane] << _U32 | self.flat[spot]
        size[lane] <<= _U32
        self.at[lane] = spot + _L1
        self.range = size

    def shrink(self, m: int) -> None:
        self.code, self.range, self.at = self.code[:m], self.range[:m], self.at[:m]


def _narrow(ends: np.ndarray, outcome: np.ndarray, r: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Begin of the outcomes' intervals; ``r``, one share, becomes their size by their total."""
    shift = outcome.astype(np.uint64)
    shift <<= _U4
    begin = ends << _U16
    begin >>= shift
    begin &= _FIELD
    ends >>= shift
    ends &= _FIELD
    ends -= begin
    begin *= r
    r *= ends
    r >>= (totals >> shift) & _FIELD
    return begin


def _totals(k: int, bits: int) -> np.ndarray:
    """Bits of the total of each outcome's ids, as 16 bits each."""
    return np.array(k << 32 | min(bits, _LOW_BITS) << 48, dtype=np.uint64)


def _encode_blocks(ids: np.ndarray, block: int, bits: int) -> list[bytes]:
    lengths = _lengths(len(ids), block)
    lanes, steps, tail = len(lengths), int(lengths[0]), int(lengths[-1])
    padded = np.zeros((lanes, steps), dtype=np.int32)
    padded.reshape(-1)[: len(ids)] = ids
    columns = np.ascontiguousarray(padded.T)
    order0 = _Known(padded, bits)
    del padded
    high, m = max(bits - _LOW_BITS, 0), lanes
    orders, coder = _Orders(lanes, steps), _Writer(lanes, steps * (2 if high else 1) + 1)
    for begin, end, k in _phases(steps):
        totals = _totals(k, bits)
        if begin:
            orders.refresh(last, begin)
            order0.refresh(last, begin)
        last = begin
        for step in range(begin, end):
            if step == tail:
                m -= 1
                coder.finish(m)
                orders.shrink(m)
            narrow = columns[step, :m]
            x = narrow.astype(np.int64)
            ends = orders.look()
            hit = orders.ids == narrow
            known = hit[0] | hit[1]
            own = order0.entries.take(order0.cells[step, :m], mode="clip").astype(np.uint64)
            wide = own & _FIELD
            own >>= _U16
            outcome = (wide == _NO) + _TWO_OUTCOMES
            outcome *= ~known
            outcome += hit[0] > hit[1]
            r = coder.range >> _U12
            at = _narrow(ends, outcome, r, totals)
            lane = known.nonzero()[0]
            own[lane], wide[lane] = 0, 1
            lane = (outcome == _NONE).nonzero()[0]
            own[lane], wide[lane] = x[lane] & 0xFFFF, 1
            own *= r
            at += own
            r *= wide
            coder.move(at, r)
            if high:
                new = outcome == _NONE
                r = coder.range >> new * _U(high)
                coder.move(r * (new * (x >> _LOW_BITS)).view(np.uint64), r)
            orders.learn(step, x, narrow, hit, outcome)
    coder.finish(0)
    return coder.words()


def _history(columns: np.ndarray) -> np.ndarray:
    """Of every block, its ids so far (rows of ``columns``) in order, as id << 32 | ids before it << 16 | how often it came."""
    ids = np.sort(columns.T, axis=1)
    n = ids.shape[1]
    first = np.ones(ids.shape, dtype=bool)
    np.not_equal(ids[:, 1:], ids[:, :-1], out=first[:, 1:])
    starts = np.flatnonzero(first)
    size = np.diff(starts, append=ids.size)
    entry = ids.reshape(-1)[starts].astype(np.int64) << 32 | (starts & (n - 1)) << 16 | size
    return np.repeat(entry, size)


def _decode_blocks(words: np.ndarray, lengths: np.ndarray, block: int, bits: int) -> np.ndarray:
    """Ids of blocks, whose words are the rows of ``words``, one column each."""
    lanes, steps, tail = len(lengths), int(lengths[0]), int(lengths[-1])
    columns, high = np.zeros((steps, lanes), dtype=np.int32), max(bits - _LOW_BITS, 0)
    history = np.zeros(0, dtype=np.int64)
    orders, coder, m, ones = _Orders(lanes, steps), _Reader(words), lanes, np.ones(lanes, dtype=np.uint64)
    for begin, end, k in _phases(steps):
        totals = _totals(k, bits)
        if begin:
            orders.refresh(last, begin)
            history = _history(columns[: 1 << k])
        last = begin
        for step in range(begin, end):
            if step == tail:
                m -= 1
                orders.shrink(m)
                coder.shrink(m)
            ends = orders.look()
            code, r = coder.code, coder.range >> _U12
            # How many of the three ends are not above the share that the code lies in.
            share = np.minimum(code // r, _LAST_SHARE)
            share *= _THREE
            share |= _TOPS
            share -= ends & _THREE_FIELDS
            share &= _TOPS
            outcome = np.bitwise_count(share)
            code -= _narrow(ends, outcome, r, totals)
            v = code // r
            x, wide = v.astype(np.int64), ones[:m].copy()
            lane = (outcome < _TWO_OUTCOMES).nonzero()[0]
            x[lane] = orders.ids.ravel()[lane + (outcome[lane] ^ _ONE) * m]
            lane = (outcome == _TWO_OUTCOMES).nonzero()[0]
            if len(lane):
                entry = history[(lane << k) + x[lane]]
                x[lane], wide[lane] = entry >> _L32, entry & _LFIELD
                entry >>= _L16
                entry &= _LFIELD
                v[lane] = entry
            code -= r * v
            r *= wide
            coder.move(r)
            if high:
                new = outcome == _NONE
                r = coder.range >> new * _U(high)
                top = code // r
                code -= top * r
                x |= (top << _U(_LOW_BITS)).view(np.int64)
                coder.move(r)
            columns[step, :m] = x
            narrow = columns[step, :m]
            orders.learn(step, x, narrow, orders.ids == narrow, outcome)
    return columns


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Head (lengths and checksums of blocks) and words of a group of ids, each below 2^28."""
    n = len(ids)
    if n and (int(ids.min()) < 0 or int(ids.max()) >> MAX_BITS):
        raise ValueError(f"ids are from 0 to 2^{MAX_BITS} - 1")
    bits = int(ids.max()).bit_length() if n else 0
    words = _encode_blocks(ids, block, bits) if n else []
    table = np.array([(len(w) // 4, zlib.crc32(w)) for w in words], dtype="<u4")
    head = b"".join([MAGIC, struct.pack("<IIQ", bits, block, n), table.tobytes()])
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *words])


def _head(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Bits of an id, ids of a full block, and each block's ids, checksum and [from, to) in the data."""
    if data[:4] != MAGIC or len(data) < 24:
        raise CorruptBlock("not a group of coded ids")
    bits, block, n = struct.unpack_from("<IIQ", data, 4)
    end = 20 + 8 * -(-n // block) if block else 0
    if len(data) < end + 4 or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
        raise CorruptBlock("head")
    table = np.frombuffer(data, dtype="<u4", count=(end - 20) // 4, offset=20).reshape(-1, 2).astype(np.int64)
    ends = end + 4 + 4 * np.cumsum(table[:, 0])
    return bits, block, _lengths(n, block), table[:, 1], np.stack([ends - 4 * table[:, 0], ends], axis=1)


def _words(data: bytes, checks: np.ndarray, places: np.ndarray) -> np.ndarray:
    words = np.zeros((len(places), int((places[:, 1] - places[:, 0]).max()) // 4 + 2), dtype=np.uint32)
    for i, ((a, b), check) in enumerate(zip(places.tolist(), checks.tolist(), strict=True)):
        own = data[a:b]
        if len(own) != b - a or zlib.crc32(own) != check:
            raise CorruptBlock(f"block {i}")
        words[i, : len(own) // 4] = np.frombuffer(own, dtype="<u4")
    return words


def decode(data: bytes) -> np.ndarray:
    """All ids of a group; raises CorruptBlock where a checksum fails."""
    bits, block, lengths, checks, places = _head(data)
    if not len(lengths):
        return np.zeros(0, dtype=np.int32)
    return _decode_blocks(_words(data, checks, places), lengths, block, bits).T.reshape(-1)[: lengths.sum()]


def decode_block(data: bytes, number: int) -> np.ndarray:
    """The ids of one block, from its own words alone."""
    bits, block, lengths, checks, places = _head(data)
    one = slice(number, number + 1)
    return _decode_blocks(_words(data, checks[one], places[one]), lengths[one], block, bits)[:, 0]
