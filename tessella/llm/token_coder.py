"""Token-id files: adaptive context-mixing range coder in independently reset, checksummed blocks.

Documents are dealt by ranges of doc_id, encoded, and gathered into segments of whole documents. A
segment has a header, the ids and lengths of its documents, and blocks of ``BLOCK`` token ids. Every
block starts from an empty model and carries a CRC of its own, so it can be decoded by itself and a
damaged one is found.

Within a block, three predictors name the next id: the one that last followed the same two ids (order 2),
the one that last followed the same id (order 1), and all ids of the block so far, by their counts (order 0).
Each guess of orders 2 and 1 has a count of how often it was right in a row. These counts select the weights
with which the three, and an id new to the block, are mixed; after every id its weights move towards the
predictor that named it. The counts of order 0 are renewed after 32, 48, 64, 96, ... ids, so that an id is one
step of the coder: its share of 4,096 slots. New ids have fixed shares that fall with the id, as the vocabulary
is numbered by frequency. All goes through one range coder.

Blocks are independent, so a task codes more than a thousand of them side by side, one id of each at a step,
with array operations. Ranges and bounds are whole numbers in float64, below 2**53 and so exact.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.bpe import default_vocabulary
from tessella.llm.common import documents, materialize
from tessella.llm.library_encoder import runs

END_ID = 2
MAGIC = b"TSID"
VERSION = 2
BLOCK = 4096
#: Blocks in a segment: what is coded side by side, and how much of a file is in memory at a time.
SEGMENT_BLOCKS = 2048
_HEADER = struct.Struct("<4sHHIIQ")  # magic, version, block size, documents, blocks, tokens
_BLOCK_HEADER = struct.Struct("<III")  # tokens, bytes, crc32 of the ids
_TABLE = 2048  # entries of a predictor's table
_TRUST = 7  # largest count of right predictions in a row
_TRUST_AFTER = np.array([*(t >> 1 for t in range(_TRUST + 1)), *(min(t + 1, _TRUST) for t in range(_TRUST + 1))], np.uint32)
_WHOLE, _LEAST = 1 << 15, 16  # total and least width of the weights
_SLOTS = 4096
_STRETCH = 16  # ids after which guesses and weights learn
_RENEWALS = [*(n << k for k in range(4, 11) for n in (2, 3)), BLOCK]
_RENEWED = dict(zip(_RENEWALS, _RENEWALS[1:]))  # position: the next
_NEW_SIZE = 1 + (1 << 16) // (np.arange(1 << 16) + 256)
_NEW_BEGIN = (np.cumsum(_NEW_SIZE) - _NEW_SIZE).astype(float)
_NEW_WHOLE = int(_NEW_SIZE.sum())
_NEW_AT = np.repeat(np.arange(1 << 16, dtype=np.uint16), _NEW_SIZE)
#: Range at the start, the range below which a word of 16 bits is put out, and the place of that word.
_FULL, _NARROW, _TOP, _WORD = 2.0**48, 2.0**36, 2.0**32, 65536.0


class _Frequencies:
    """Adaptive cumulative frequencies of four symbols, a row of 8 bytes for each context."""

    def __init__(self, rows: int):
        at, symbol = np.arange(4), np.arange(4)[:, None]
        aims = np.where(at < symbol, (at + 1) * _LEAST, _WHOLE - (3 - at) * _LEAST)
        self.aims = aims.astype(np.uint16).view(np.uint64).ravel()
        self.table = np.full(rows, ((at + 1) * (_WHOLE // 4)).astype(np.uint16).view(np.uint64)[0])

    def rows(self, at: np.ndarray) -> np.ndarray:
        return self.table.take(at, mode="clip")

    def bounds(self, rows: np.ndarray, symbols: np.ndarray, quads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bound and width of each row's symbol."""
        upper = rows.ravel().view(np.uint16)
        at = quads + symbols
        size = upper.take(at, mode="clip")
        at -= 1
        low = upper.take(at, mode="wrap")
        low &= _WHOLE - 1  # before the first symbol stands the end of another row
        size -= low
        return low, size

    def adapt(self, at: np.ndarray, symbols: np.ndarray, speed: int) -> None:
        """Moves the rows towards the symbols they gave; no width falls below the least."""
        rows = self.table.take(at.ravel(), mode="clip")
        own, step = rows.view(np.uint16), self.aims.take(symbols.ravel(), mode="clip").view(np.uint16)
        step -= own
        signed = step.view(np.int16)
        signed >>= speed
        own += step
        self.table.put(at, rows, mode="clip")


class _Model:
    """Adaptive state of ``lanes`` blocks: guesses of orders 2 and 1, and the weights of the predictors."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.quads, self.tables, self.contexts = lane * 4, lane * _TABLE, lane << 7
        self.guess2, self.guess1 = np.zeros((2, lanes * _TABLE), np.uint32)  # id and trust
        self.weights = _Frequencies(lanes << 7)

    def predict(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places in the guess tables, guesses, and the context of their weights, for the first lanes."""
        n = last.shape[-1]
        at1 = last * 40503
        at2 = before * 30011
        at2 += at1
        for at, shift in ((at1, 3), (at2, 4)):
            at >>= shift
            at &= _TABLE - 1
            at += self.tables[:n]
        v2, v1 = self.guess2.take(at2, mode="clip"), self.guess1.take(at1, mode="clip")
        p2, p1 = v2 >> 3, v1 >> 3
        v2 &= 7
        v1 &= 7
        v2 <<= 4
        v1 <<= 1
        v2 |= v1
        v2 |= p1 == p2
        return at2, at1, p2, p1, self.contexts[:n] + v2

    def learn(self, at2: np.ndarray, at1: np.ndarray, context: np.ndarray, flags: np.ndarray, ids: np.ndarray, t: int) -> None:
        """From the ids of a stretch, in order: where a place occurs again, its last id counts."""
        for guess, at in ((self.guess2, at2), (self.guess1, at1)):
            was = guess.take(at, mode="clip")
            right = (was >> 3) == ids
            trust = was & 7
            new = np.where(right | (trust > 1), was >> 3, ids)  # a trusted guess survives one miss
            new <<= 3
            trust += right.view(np.uint8) << 3
            new |= _TRUST_AFTER.take(trust, mode="clip")
            guess.put(at, new, mode="clip")
        self.weights.adapt(context, flags, 2 if t < 64 else 3)


def _begins(counts_before: np.ndarray, rank: np.ndarray, distinct: np.ndarray, t: int) -> np.ndarray:
    """Where an id's share of the slots begins: one slot for each id, the others by counts among ``t``."""
    return rank + counts_before * (_SLOTS - distinct) // t


class _Encoder:
    def __init__(self, lanes: int, capacity: int):
        self.low, self.range = np.zeros(lanes), np.full(lanes, _FULL)
        self.out = np.zeros((lanes, capacity), np.uint32)
        self.flat = self.out.ravel()
        self.start = np.arange(lanes) * capacity
        self.at = self.start.copy()

    @staticmethod
    def narrow(low: np.ndarray, wide: np.ndarray, whole: int, begin: np.ndarray, size: np.ndarray) -> None:
        wide *= 1 / whole
        np.floor(wide, out=wide)
        low += wide * begin
        wide *= size

    def settle(self, n: int) -> None:
        """Puts out words of lanes whose range is small. A carry stays in the word; ``finish`` hands it on."""
        low, wide, at = self.low[:n], self.range[:n], self.at[:n]
        go = wide < _NARROW
        word = low * (1 / _TOP)
        np.floor(word, out=word)
        self.flat.put(at, word.astype(np.uint32), mode="clip")  # stays where the place moves on
        word *= _TOP
        word *= go
        low -= word
        scale = np.where(go, _WORD, 1.0)
        low *= scale
        wide *= scale
        at += go
        more = np.flatnonzero(wide < _NARROW)
        while len(more):
            l, w, where = low.take(more), wide.take(more), at.take(more)
            word = np.floor(l * (1 / _TOP))
            self.flat[where] = word
            low[more], wide[more], at[more] = (l - word * _TOP) * _WORD, w * _WORD, where + 1
            more = more[w < _NARROW / _WORD]

    def finish(self) -> list[bytes]:
        for _ in range(3):
            word = np.floor(self.low * (1 / _TOP))
            self.flat[self.at] = word
            self.low = (self.low - word * _TOP) * _WORD
            self.at += 1
        sizes = self.at - self.start
        out = self.out[:, : sizes.max(initial=0)]
        out[np.arange(out.shape[1]) >= sizes[:, None]] = 0
        while (over := out >> 16).any():
            out &= 0xFFFF
            out[:, :-1] += over[:, 1:]
        return [out[i, :n].astype("<u2").tobytes() for i, n in enumerate(sizes.tolist())]


class _Decoder:
    def __init__(self, payloads: list[bytes]):
        width = max(map(len, payloads), default=0) // 2 + 4
        data = np.zeros((len(payloads), width), "<u2")
        for i, p in enumerate(payloads):
            data[i, : len(p) // 2] = np.frombuffer(p, "<u2", len(p) // 2)
        self.flat = data.ravel()
        self.at = np.arange(len(payloads)) * width
        self.value, self.range = np.zeros(len(payloads)), np.full(len(payloads), _FULL)
        for _ in range(3):
            self.value = self.value * _WORD + self.flat[self.at]
            self.at += 1

    @staticmethod
    def target(value: np.ndarray, wide: np.ndarray, whole: int) -> np.ndarray:
        """The place of ``value`` among ``whole`` equal parts of the range, which becomes one part."""
        wide *= 1 / whole
        np.floor(wide, out=wide)
        place = value / wide
        return np.minimum(place, whole - 1, out=place)  # a damaged file may be beyond

    @staticmethod
    def narrow(value: np.ndarray, wide: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        value -= wide * begin
        wide *= size

    def settle(self, n: int) -> None:
        value, wide, at = self.value[:n], self.range[:n], self.at[:n]
        go = wide < _NARROW
        scale = np.where(go, _WORD, 1.0)
        value *= scale
        wide *= scale
        value += self.flat.take(at, mode="clip") * go
        at += go
        more = np.flatnonzero(wide < _NARROW)
        while len(more):
            v, w, where = value.take(more), wide.take(more), at.take(more)
            value[more], wide[more], at[more] = v * _WORD + self.flat.take(where, mode="clip"), w * _WORD, where + 1
            more = more[w < _NARROW / _WORD]


def _lanes(sizes: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Blocks by falling size, so that lanes in use are always the first, and how many are in use at each step."""
    order = np.argsort(-sizes, kind="stable")
    return order, np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left").tolist()


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payload of each block of at most BLOCK ids below 65,536."""
    sizes = np.array([len(b) for b in blocks], np.int64)
    order, live = _lanes(sizes)
    most, sizes = len(live), sizes[order]
    ids = np.zeros((most, len(blocks)), np.uint16)
    # Numbers of the distinct ids of each lane, in order of lane and id: one sort of lane, id, position.
    keys = np.empty(int(sizes.sum()), np.uint64)
    at = 0
    for lane, i in enumerate(order.tolist()):
        b = blocks[i]
        ids[: len(b), lane] = b
        keys[at : at + len(b)] = (b.astype(np.uint64) << np.uint64(12)) + (np.arange(len(b), dtype=np.uint64) + np.uint64(lane << 28))
        at += len(b)
    keys.sort()
    entry = keys >> np.uint64(12)
    first = np.empty(len(keys), bool)
    first[:1] = True
    np.not_equal(entry[1:], entry[:-1], out=first[1:])
    number = np.zeros(ids.shape, np.int32)
    where = (keys & np.uint64(BLOCK - 1)).astype(np.int64)
    where *= len(blocks)
    where += (keys >> np.uint64(28)).astype(np.int64)
    number.ravel()[where] = np.cumsum(first) - 1
    lane_of = (entry[first] >> np.uint64(16)).astype(np.int64)
    del keys, entry, first, where

    model, coder = _Model(len(blocks)), _Encoder(len(blocks), 16 + 4 * most)
    begin = size = None
    counts, epoch = np.zeros(len(lane_of), np.int64), 0
    for t, n in enumerate(live):
        if t in _RENEWED:  # shares of the slots by the ids so far
            upto = int(np.searchsorted(lane_of, n))
            counts = counts[:upto] + np.bincount(number[epoch:t, :n].ravel(), minlength=upto)[:upto]
            known, lanes = np.flatnonzero(counts), lane_of[:upto]
            distinct = np.bincount(lanes[known], minlength=n)
            own = lanes[known]
            starts = np.cumsum(distinct) - distinct
            lows = _begins(np.cumsum(counts[known]) - counts[known] - own * t, np.arange(len(known)) - starts[own], distinct[own], t)
            parts = np.diff(lows, append=_SLOTS)
            parts[parts <= 0] += _SLOTS
            begins, widths = np.zeros(upto, np.uint16), np.zeros(upto, np.uint16)
            begins[known], widths[known] = lows, parts
            ahead = number[t : _RENEWED[t], :n]
            begin, size, epoch = begins.take(ahead), widths.take(ahead, mode="clip"), t
        if t % _STRETCH == 0:
            till = min(t + _STRETCH, most)
            now = ids[t:till, :n].astype(np.uint32)
            past = np.zeros((till - t + 1, n), np.int64)
            past[0 if t else 2 :] = ids[max(t - 2, 0) : till - 1, :n]
            at2, at1, p2, p1, context = model.predict(past[1:], past[:-1])
            if begin is None:
                listed = np.zeros(now.shape, bool)
            else:
                shares = size[t - epoch : till - epoch, :n]
                listed = shares > 0
            flags = np.where(p1 == now, np.uint8(1), np.uint8(3) - listed.view(np.uint8))
            flags *= p2 != now
            quads = np.arange(0, 4 * now.size, 4).reshape(now.shape)
            lows, wides = model.weights.bounds(model.weights.rows(context), flags, quads)
            lows, wides = lows.astype(float), wides.astype(float)
            if begin is not None:  # within the third part, the share of the id; else all slots
                listed &= flags == 2
                lows *= _SLOTS
                lows += wides * np.where(listed, begin[t - epoch : till - epoch, :n], 0)
                wides *= np.where(listed, shares, _SLOTS)
            model.learn(at2, at1, context, flags, now, t)
        k = t % _STRETCH
        low, wide = coder.low[:n], coder.range[:n]
        coder.narrow(low, wide, _WHOLE if begin is None else _WHOLE * _SLOTS, lows[k, :n], wides[k, :n])
        new = np.flatnonzero(flags[k, :n] == 3)
        if len(new):
            l, w, which = low.take(new), wide.take(new), now[k].take(new)
            coder.narrow(l, w, _NEW_WHOLE, _NEW_BEGIN.take(which), _NEW_SIZE.take(which))
            low[new], wide[new] = l, w
        coder.settle(n)
    made = coder.finish()
    out: list[bytes] = [b""] * len(blocks)
    for i, at in enumerate(order.tolist()):
        out[at] = made[i]
    return out


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    counts = np.array(sizes, np.int64)
    order, live = _lanes(counts)
    ids = np.zeros((len(live), len(sizes)), np.uint16)
    model, coder = _Model(len(sizes)), _Decoder([payloads[i] for i in order.tolist()])
    slots = None
    last = before = np.zeros(len(sizes), np.int64)
    at2s, at1s, contexts = np.zeros((3, _STRETCH, len(sizes)), np.int64)
    flags, nows = np.zeros((_STRETCH, len(sizes)), np.uint8), np.zeros((_STRETCH, len(sizes)), np.uint32)
    with np.errstate(over="ignore", invalid="ignore"):  # of damaged files
        for t, n in enumerate(live):
            if t in _RENEWED:
                keys = (ids[:t, :n].astype(np.uint32) + (np.arange(n, dtype=np.uint32) << np.uint32(16))).ravel()
                keys.sort()
                known = np.flatnonzero(np.diff(keys, prepend=np.uint32(0xFFFFFFFF)))
                own = (keys[known] >> np.uint32(16)).astype(np.int64)
                distinct = np.bincount(own, minlength=n)
                starts = np.cumsum(distinct) - distinct
                lows = _begins(known - own * t, np.arange(len(known)) - starts[own], distinct[own], t)
                shares = np.diff(lows, append=_SLOTS)
                shares[shares <= 0] += _SLOTS
                slots = np.repeat(np.arange(len(known), dtype=np.uint32), shares)
                listed_ids = (keys[known] & np.uint32(0xFFFF)).astype(np.uint64)
                entries = (listed_ids << np.uint64(32)) | (lows.astype(np.uint64) << np.uint64(16)) | shares.astype(np.uint64)
                slot_rows = np.arange(n) * _SLOTS
            k = t % _STRETCH
            at2, at1, p2, p1, context = model.predict(last[:n], before[:n])
            value, wide = coder.value[:n], coder.range[:n]
            rows = model.weights.rows(context)
            target = coder.target(value, wide, _WHOLE if slots is None else _WHOLE * _SLOTS)
            np.floor(target, out=target)
            upper, place = rows.view(np.uint16), target if slots is None else target * (1 / _SLOTS)
            flag = (upper[::4] <= place).view(np.uint8) + (upper[1::4] <= place)
            flag += upper[2::4] <= place
            begin, size = model.weights.bounds(rows, flag, model.quads[:n])
            now = np.where(flag == 0, p2, p1)
            if slots is not None:
                listed = flag == 2
                begin = begin * float(_SLOTS)
                target -= begin
                target /= size
                place = target.astype(np.int64)
                place += slot_rows[:n]
                entry = entries.take(slots.take(place, mode="clip"), mode="clip").view(np.uint16)
                begin += size * (entry[1::4] * listed).astype(float)
                size = size * np.where(listed, entry[::4], float(_SLOTS))
                now = np.where(listed, entry[2::4], now)
            coder.narrow(value, wide, begin, size)
            new = np.flatnonzero(flag == 3)
            if len(new):
                v, w = value.take(new), wide.take(new)
                which = _NEW_AT.take(coder.target(v, w, _NEW_WHOLE).astype(np.int64), mode="clip")
                coder.narrow(v, w, _NEW_BEGIN.take(which), _NEW_SIZE.take(which))
                value[new], wide[new], now[new] = v, w, which
            coder.settle(n)
            ids[t, :n] = now
            before, last = last, now.astype(np.int64)
            at2s[k, :n], at1s[k, :n], contexts[k, :n], flags[k, :n], nows[k, :n] = at2, at1, context, flag, now
            if k == _STRETCH - 1:
                model.learn(at2s[:, :n], at1s[:, :n], contexts[:, :n], flags[:, :n], nows[:, :n], t - k)
    ids = np.ascontiguousarray(ids.T)
    out: list[np.ndarray] = [ids[0, :0] if len(ids) else np.empty(0, np.uint16)] * len(sizes)
    for i, at in enumerate(order.tolist()):
        out[at] = ids[i, : counts[at]]
    return out


def pack(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """A segment of whole documents. A null doc_id has a flag of its own beside the ids."""
    tokens = np.concatenate(docs) if docs else np.empty(0, np.uint16)
    if len(tokens) and int(tokens.max()) > 0xFFFF:
        raise ValueError("ids must be below 65,536")
    blocks = [tokens[i : i + BLOCK] for i in range(0, len(tokens), BLOCK)]
    index = np.array([(d is not None, d or 0, len(t)) for d, t in zip(doc_ids, docs)], dtype=[("known", "u1"), ("id", "<i8"), ("n", "<i8")]).tobytes()
    parts = [_HEADER.pack(MAGIC, VERSION, BLOCK, len(docs), len(blocks), len(tokens)), struct.pack("<I", zlib.crc32(index)), index]
    payloads = [p for i in range(0, len(blocks), SEGMENT_BLOCKS) for p in encode_blocks(blocks[i : i + SEGMENT_BLOCKS])]
    for b, p in zip(blocks, payloads):
        parts += [_BLOCK_HEADER.pack(len(b), len(p), zlib.crc32(b.astype("<u2").tobytes())), p]
    return b"".join(parts)


def unpack(segment: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """doc_ids and token ids of a segment; ValueError if anything is damaged."""
    magic, version, _, n_docs, n_blocks, n_tokens = _HEADER.unpack_from(segment)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token-id segment")
    kind = np.dtype([("known", "u1"), ("id", "<i8"), ("n", "<i8")])
    at = _HEADER.size + 4
    raw = segment[at : at + n_docs * kind.itemsize]
    if zlib.crc32(raw) != struct.unpack_from("<I", segment, _HEADER.size)[0]:
        raise ValueError("damaged document index")
    index = np.frombuffer(raw, kind)
    at += len(raw)
    sizes, payloads, sums = [], [], []
    for _ in range(n_blocks):
        size, length, crc = _BLOCK_HEADER.unpack_from(segment, at)
        at += _BLOCK_HEADER.size
        sizes.append(size)
        sums.append(crc)
        payloads.append(segment[at : at + length])
        at += length
    groups = range(0, n_blocks, SEGMENT_BLOCKS)  # a long document may have more blocks than are coded at once
    blocks = [b for i in groups for b in decode_blocks(payloads[i : i + SEGMENT_BLOCKS], sizes[i : i + SEGMENT_BLOCKS])]
    for i, (b, crc) in enumerate(zip(blocks, sums)):
        if zlib.crc32(b.astype("<u2").tobytes()) != crc:
            raise ValueError(f"damaged block {i}")
    tokens = np.concatenate(blocks) if blocks else np.empty(0, np.uint16)
    if len(tokens) != n_tokens:
        raise ValueError("tokens are missing")
    cuts = np.cumsum(index["n"])[:-1] if n_docs else []
    return [int(d) if known else None for known, d in zip(index["known"], index["id"])], np.split(tokens, cuts) if n_docs else []


def write_tokens(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Segments of the ids of ``docs(doc_id, text, ...)``, written to the shared folder in ascending
    doc_id order: part, segment (numbers in that order), n_tokens, data.

    Ranges of doc_id are dealt by Spark and sorted; each document ends with ``end_id``. Null texts
    count as empty; a null doc_id comes first; rows with one doc_id follow each other by text. A text of
    any length is a document of one segment. Other columns are ignored. No rows give no segments.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = runs(path)
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        size, number = 0, 0

        def segment() -> pd.DataFrame:
            return pd.DataFrame({"segment": [number], "n_tokens": [size], "data": [pack(ids, held)]})

        for pdf in batches:
            flat, sizes = encode.batch(pdf["text"])
            ends = np.cumsum(sizes)
            flat = np.insert(flat, ends, end_id)
            for doc, tokens in zip(pdf["doc_id"], np.split(flat, (ends + np.arange(1, len(ends) + 1))[:-1])):
                if size and size + len(tokens) > SEGMENT_BLOCKS * BLOCK:
                    yield segment()
                    ids, held, size, number = [], [], 0, number + 1
                ids.append(None if pd.isna(doc) else int(doc))
                held.append(tokens)
                size += len(tokens)
        if held:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = dealt.mapInPandas(run, "segment bigint, n_tokens bigint, data binary")
    return materialize(made.select(F.spark_partition_id().alias("part"), "segment", "n_tokens", "data"))


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, in no set order.

    ``start`` is the number of ids in all documents before: a running sum over parts (one row each),
    then over the segments of a part, then within a segment.
    """
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_part_start"))
    within = Window.partitionBy("part").orderBy("segment")
    placed = segments.select("part", "segment", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("_start")).join(before, "part")
    placed = placed.select("part", "segment", (F.col("_start") + F.col("_part_start")).alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, data in zip(pdf["start"], pdf["data"]):
                ids, docs = unpack(data)
                sizes = np.array([len(d) for d in docs], np.int64)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(ids, dtype="Int64"),
                        "start": int(start) + np.cumsum(sizes) - sizes,
                        "n_tokens": sizes,
                        "ids_crc32": np.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], np.int64),
                    }
                )

    joined = segments.join(placed, ["part", "segment"])
    return joined.select("start", "data").mapInPandas(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(documents(spark, sf_dir)))
