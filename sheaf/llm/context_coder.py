"""A context-mixing range coder for token ids, in independently reset, checksummed blocks.

A block is cut into stretches that numpy codes side by side: every operation works on one id of
each stretch. Two tables predict the next id: the one seen after the two ids before it (order 2)
and after the one before it (order 1), each with a confidence. For each pair of confidences
weights are learned for "order 2 is right", "order 1 is right" and the order-0 model, an
adaptive distribution of the ids seen in the block; an id that is new to it is escaped. The
three are mixed into one distribution, so an id takes one step of a range coder.

The stretches of a block share its model. It learns at the same steps in either direction, after
1, 2, 4, ... steps and then every ``EPOCH``; what follows is coded by what was learned before.
Blocks share nothing. Each stretch has its length, its number of code words and the CRC-32 of
its ids, and decoding fails if that doesn't match.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"CMX2"
SLOT_BITS, WEIGHT_BITS = 18, 8  # bits of an order-0 probability, and of a weight
BITS = SLOT_BITS + WEIGHT_BITS
ORDER1_BITS, ORDER2_BITS = 16, 18
TRUST_BITS = 2
TRUST = (1 << TRUST_BITS) - 1
EPOCH = 32
MOST_IDS = 1 << (SLOT_BITS - 1)  # that the order-0 model tells apart; others stay escaped
RAW = 16  # bits of an escaped id that are coded at once
U32, U64 = np.uint64(32), np.uint64
BIG, SMALL = U64(1 << 32), U64(1 << 30)


def epochs(steps: int) -> Iterator[tuple[int, int]]:
    """From where to where the model stays as it is."""
    at, width = 0, 1
    while at < steps:
        yield at, min(at + width, steps)
        at, width = at + width, min(2 * width, EPOCH)


class Model:
    def __init__(self, nibbles: int, ids: int):
        self.order2_bits = min(ORDER2_BITS, max(8, ids.bit_length()))
        self.raw_bits = range(0, 4 * nibbles, RAW)[::-1]
        self.order1, self.order2 = np.zeros(1 << ORDER1_BITS, np.int32), np.zeros(1 << self.order2_bits, np.int32)
        trust2, trust1, same = np.unravel_index(np.arange(2 << 2 * TRUST_BITS), (TRUST + 1, TRUST + 1, 2))
        right2, right1 = trust2 > 0, (trust1 > 0) & (same == 0)
        self.right = np.stack([np.ones(len(same)), right1, right2]).astype(np.int64)  # how often, by state
        self.number = np.zeros(1 << 4 * nibbles, np.int32)  # of each id in the order-0 model; 0: an escape
        self.names, self.counts = np.zeros(1, np.int32), np.ones(1, np.int64)
        self.refresh()

    def refresh(self) -> None:
        """Weights and order-0 distribution of what was learned."""
        total = self.right.sum(axis=0)
        one, two = ((self.right[i] * ((1 << WEIGHT_BITS) - 2)) // total + (self.right[i] > 0) for i in (1, 2))
        self.until2, self.until1 = two << SLOT_BITS, (two + one) << SLOT_BITS
        self.weight0 = (1 << WEIGHT_BITS) - two - one
        n, sums = len(self.counts), np.cumsum(self.counts)
        ends = np.arange(1, n + 1) + sums * ((1 << SLOT_BITS) - n) // sums[-1]
        self.size = np.diff(ends, prepend=0)
        self.start = ends - self.size

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)

    def look(self, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places and entries (id and confidence) in the two tables, and the state of the weights."""
        place1 = last & ((1 << ORDER1_BITS) - 1)
        mixed = before.view(np.uint32) * np.uint32(0x9E3779B1) + last.view(np.uint32) * np.uint32(0x85EBCA6B)
        place2 = mixed >> np.uint32(32 - self.order2_bits)
        entry1, entry2 = self.order1.take(place1), self.order2.take(place2)
        trust2 = entry2 & TRUST
        state = ((trust2 << TRUST_BITS | entry1 & TRUST) << 1) | ((entry1 ^ entry2 <= TRUST) & (trust2 > 0))
        return place1, place2, entry1, entry2, state

    def choices(self, entry1: np.ndarray, entry2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which ids order 1 and order 2 have right; where both, order 2 counts."""
        right2 = (entry2 >> TRUST_BITS == ids) & (entry2 & TRUST > 0)
        return (entry1 >> TRUST_BITS == ids) & (entry1 & TRUST > 0) & ~right2, right2

    def learn(self, seen: tuple[np.ndarray, ...], ids: np.ndarray) -> None:
        place1, place2, entry1, entry2, state = seen
        right1, right2 = self.choices(entry1, entry2, ids)
        choice = right1 + 2 * right2
        self.right += np.bincount((choice * self.right.shape[1] + state).ravel(), minlength=self.right.size).reshape(3, -1)
        missed = ids[choice == 0]
        new = np.unique(missed[self.number[missed] == 0])[: MOST_IDS - len(self.names)]
        if len(new):
            self.number[new] = np.arange(len(self.names), len(self.names) + len(new))
            self.names = np.concatenate([self.names, new])
            self.counts = np.concatenate([self.counts, np.zeros(len(new), np.int64)])
        self.counts += np.bincount(self.number[missed], minlength=len(self.counts))
        self.counts[0] = 1 + len(self.names) // 4
        for table, place, entry in ((self.order1, place1, entry1), (self.order2, place2, entry2)):
            trust = entry & TRUST
            right = entry >> TRUST_BITS == ids
            kept = entry - trust + np.where(right, np.minimum(trust + 1, TRUST), trust >> 1)
            table[place] = np.where(right | (trust > 1), kept, ids << TRUST_BITS | 1)  # of equal places the last counts
        self.refresh()


class Encoder:
    def __init__(self, lanes: int, capacity: int):
        self.low, self.range = np.zeros(lanes, U64), np.full(lanes, (1 << 64) - 1, U64)
        self.words, self.used = np.zeros((lanes, capacity), np.uint32), np.zeros(lanes, np.int64)

    def emit(self, lane: np.ndarray) -> None:
        if len(lane) and self.used[lane].max() + 1 >= self.words.shape[1]:
            self.words = np.pad(self.words, ((0, 0), (0, self.words.shape[1])))
        self.words[lane, self.used[lane]] = self.low[lane] >> U32
        self.used[lane] += 1
        self.low[lane] <<= U32

    def code(self, lane: np.ndarray | slice, start: np.ndarray, width: np.ndarray | np.uint64, bits: int) -> None:
        part = self.range[lane] >> U64(bits)
        low = self.low[lane] + part * start
        size = part * width
        self.low[lane], self.range[lane] = low, size
        few, size = narrow(low, size)
        if len(few):
            few = few if isinstance(lane, slice) else lane[few]
            self.emit(few)
            self.range[few] = size << U32

    def payloads(self) -> list[bytes]:
        everyone = np.arange(len(self.low))
        self.emit(everyone)
        self.emit(everyone)
        return [row[:n].astype("<u4").tobytes() for row, n in zip(self.words, self.used, strict=True)]


class Decoder:
    def __init__(self, payloads: list[bytes]):
        counts = [len(payload) // 4 for payload in payloads]
        self.words = np.zeros((len(payloads), max(counts, default=0) + 2), np.uint32)
        for row, payload, n in zip(self.words, payloads, counts, strict=True):
            row[:n] = np.frombuffer(payload, "<u4")
        self.low, self.range = np.zeros(len(payloads), U64), np.full(len(payloads), (1 << 64) - 1, U64)
        self.ahead = (self.words[:, 0].astype(U64) << U32) | self.words[:, 1]
        self.used = np.full(len(payloads), 2)

    def place(self, lane: np.ndarray | slice, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Where in the range the code words lie, and how large its parts are."""
        part = self.range[lane] >> U64(bits)
        return np.minimum((self.ahead[lane] - self.low[lane]) // part, U64((1 << bits) - 1)).view(np.int64), part

    def code(self, lane: np.ndarray | slice, start: np.ndarray, width: np.ndarray | np.uint64, part: np.ndarray) -> None:
        low = self.low[lane] + part * start
        size = part * width
        self.low[lane], self.range[lane] = low, size
        few, size = narrow(low, size)
        if len(few):
            few = few if isinstance(lane, slice) else lane[few]
            self.low[few] <<= U32
            self.range[few] = size << U32
            used = self.used[few]
            self.ahead[few] = (self.ahead[few] << U32) | self.words[few, np.minimum(used, self.words.shape[1] - 1)]
            self.used[few] = used + 1


def narrow(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ranges have their upper word settled, and the size that then remains."""
    few = np.flatnonzero(size < BIG)
    low, size = low[few], size[few]
    apart = (low ^ (low + size)) >= BIG
    full = np.flatnonzero(~apart | (size < SMALL))
    return few[full], np.where(apart, -low & (SMALL - U64(1)), size)[full]


def write(model: Model, coder: Encoder, seen: tuple[np.ndarray, ...], ids: np.ndarray) -> None:
    """Code the ids of one epoch, steps x lanes."""
    _, _, entry1, entry2, state = seen
    right1, right2 = model.choices(entry1, entry2, ids)
    symbol = model.number.take(ids)
    until2, until1, weight = model.until2.take(state), model.until1.take(state), model.weight0.take(state)
    start = np.where(right2, 0, np.where(right1, until2, until1 + weight * model.start.take(symbol))).view(U64)
    width = np.where(right2, until2, np.where(right1, until1 - until2, weight * model.size.take(symbol))).view(U64)
    escaped = (symbol == 0) & ~right1 & ~right2
    some = escaped.any(axis=1)
    for step in range(len(ids)):
        coder.code(slice(None), start[step], width[step], BITS)
        if some[step]:
            lane = np.flatnonzero(escaped[step])
            for shift in model.raw_bits:
                coder.code(lane, (ids[step, lane] >> shift & ((1 << RAW) - 1)).astype(U64), U64(1), RAW)


def read(model: Model, coder: Decoder, slots: np.ndarray, seen: tuple[np.ndarray, ...], out: np.ndarray) -> None:
    """Decode one id of each lane."""
    _, _, entry1, entry2, state = seen
    place, part = coder.place(slice(None), BITS)
    until2, until1, weight = model.until2.take(state), model.until1.take(state), model.weight0.take(state)
    over = place - until1
    right2, right1 = place < until2, over < 0
    symbol = slots.take(np.maximum(over, 0) // weight)
    start = np.where(right2, 0, np.where(right1, until2, until1 + weight * model.start.take(symbol))).view(U64)
    width = np.where(right2, until2, np.where(right1, until1 - until2, weight * model.size.take(symbol))).view(U64)
    coder.code(slice(None), start, width, part)
    out[:] = np.where(right2, entry2 >> TRUST_BITS, np.where(right1, entry1 >> TRUST_BITS, model.names.take(symbol)))
    lane = np.flatnonzero((symbol == 0) & ~right1)
    if len(lane):
        found = np.zeros(len(lane), np.int64)
        for _ in model.raw_bits:
            place, part = coder.place(lane, RAW)
            coder.code(lane, place.view(U64), U64(1), part)
            found = found << RAW | place
        out[lane] = found & (len(model.number) - 1)  # a damaged block may hold any bits


def run(coder: Encoder | Decoder, lanes: int, steps: int, nibbles: int, ids: np.ndarray | None) -> np.ndarray:
    """Code ``steps`` ids of each lane; the same model steps either way. ``ids``: steps x lanes."""
    model = Model(nibbles, lanes * steps)
    rows = np.zeros((steps + 2, lanes), np.int32)  # two zeros come before each stretch
    if ids is not None:
        rows[2:] = ids
    for at, end in epochs(steps):
        before, last, now = rows[at:end], rows[at + 1 : end + 1], rows[at + 2 : end + 2]
        if ids is None:
            slots = model.slots()
            for step in range(end - at):
                read(model, coder, slots, model.look(before[step], last[step]), now[step])
        seen = model.look(before, last)
        if ids is not None:
            write(model, coder, seen, now)
        if end < steps:
            model.learn(seen, now)
    return rows[2:]


def encode(ids: np.ndarray, block_ids: int = 1024, lanes: int = 4096, nibbles: int = 4) -> bytes:
    """Ids below 16 ** nibbles (7 at most) as blocks of up to ``lanes`` stretches of up to ``block_ids`` ids."""
    ids = np.asarray(ids, np.int32)
    blocks = []
    for at in range(0, len(ids), block_ids * lanes):
        group = ids[at : at + block_ids * lanes]
        n = -(-len(group) // block_ids)
        steps = -(-len(group) // n)
        n = -(-len(group) // steps)
        grid = np.zeros(n * steps, np.int32)
        grid[: len(group)] = group
        coder = Encoder(n, steps // 2 + 16)
        run(coder, n, steps, nibbles, grid.reshape(n, steps).T)
        payloads, heads = coder.payloads(), []
        for i, payload in enumerate(payloads):
            part = group[i * steps : (i + 1) * steps]
            heads.append((len(part), len(payload) // 4, zlib.crc32(part.astype("<u4").tobytes())))
        blocks += [struct.pack("<II", n, steps), np.array(heads, "<u4").tobytes(), *payloads]
    return MAGIC + struct.pack("<BI", nibbles, -(-len(ids) // (block_ids * lanes))) + b"".join(blocks)


def decode(data: bytes, lanes: int = 4096) -> np.ndarray:
    """The ids of ``encode``; raises ValueError if a block is damaged or has more than ``lanes`` stretches."""
    if data[:4] != MAGIC or len(data) < 9:
        raise ValueError("not a file of coded blocks")
    nibbles, count = struct.unpack_from("<BI", data, 4)
    if not 1 <= nibbles <= 7:
        raise ValueError("no ids have this many bits")
    at, parts = 9, []
    for _ in range(count):
        n, steps = struct.unpack("<II", data[at : at + 8].ljust(8, b"\0"))
        if not 0 < n <= lanes or len(data) < at + 8 + 12 * n:
            raise ValueError("a block is cut short or has too many stretches")
        heads = np.frombuffer(data, "<u4", 3 * n, at + 8).reshape(n, 3).tolist()
        at += 8 + 12 * n
        payloads = []
        for _, words, _ in heads:
            payloads.append(data[at : at + 4 * words])
            at += 4 * words
        lengths = [length for length, _, _ in heads]
        if len(data) < at or max(lengths) != steps or min(lengths[:-1], default=steps) != steps or not lengths[-1]:
            raise ValueError("a block is cut short or its stretches have other lengths")
        grid = np.ascontiguousarray(run(Decoder(payloads), n, steps, nibbles, None).T)
        for row, (length, _, crc) in zip(grid, heads, strict=True):
            if zlib.crc32(row[:length].astype("<u4").tobytes()) != crc:
                raise ValueError("a block's checksum does not match its ids")
            parts.append(row[:length])
    if at != len(data):
        raise ValueError("more follows than the blocks that the file should have")
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)
