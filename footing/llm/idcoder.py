"""Adaptive range coder for token ids, many blocks at a time.

A block of ids stands alone: its model starts anew, and it carries checksums of its bytes and of
its ids.  Each id is predicted by three orders:

* order 2: the id that last followed the two ids before,
* order 1: the id that last followed the one before,
* order 0: how often each id has been seen so far,

and, for ids not seen yet, a uniform distribution over the vocabulary.  The predictions are mixed: the
shares of the four in the whole are weights learned from how often each was right, a set for
every state of order 2's last three outcomes and of whether orders 1 and 2 agree.  An id is coded in the
first part that holds it.  Orders 2 and 1 learn with every id, order 0 and the weights whenever the block has
grown by half.  All arithmetic that counts is on whole numbers, so any machine decodes what another has written.

The decoder works on the same place of many blocks at a time.  The encoder knows all ids, so it
finds predictions, contexts and weights for whole blocks by sorting, and only the range coder itself goes place by
place.  The k-th id of a block depends on that block alone: it reads alike alone and among others.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np

MAGIC = b"FTB1"
#: magic, ids, vocabulary size, crc32 of the ids as unsigned 32-bit integers, crc32 of the words.
HEAD = struct.Struct("<4sIIII")
#: Blocks that are coded together, and those of them whose predictions are sought together.
LANES, SOUGHT = 2048, 128
TABLE_BITS = 11
MASK = (1 << TABLE_BITS) - 1
#: Mask of order 2's last three outcomes, and weight sets: by those outcomes and whether orders 1 and 2 agree.
OUTCOMES = 7
SETS = 2 * (OUTCOMES + 1)
#: Ids of a vocabulary at most, and the smallest part's share of ONE.
MOST_IDS, LEAST = 1 << 20, 64
ONE = 1 << 16
WORD, LOW = 16, (1 << 32) - 1
FULL, SMALL = 1 << 48, 1 << 32
ORDER0, NEW = 2, 3
#: Part by bits: order 2 holds, order 1 holds, seen before.
_PART = np.array([NEW, 0, 1, 0, ORDER0, 0, 1, 0], dtype=np.int64)
# Fixed values of the format: what each part counts at the start, by order 2's last outcomes (number of hits h) and agreement.
_START = np.array([(1 + 3 * (k >> 1).bit_count(), 2 * (1 - k % 2), 3, 4) for k in range(SETS)], dtype=np.int64)


def checkpoints(n: int) -> Iterator[tuple[int, int]]:
    """(at, until): order 0 and the weights count the first ``at`` ids for places at to until."""
    at = 0
    while at < n:
        until = min(n, max(16, at + at // 2))
        yield at, until
        at = until


def _second(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Order 2's place in its table: of the last id and the lower bits of the one before."""
    return ((last * 0x9E3B + before * 0x6F4F) >> 4) & MASK


def _ends(counts: np.ndarray) -> np.ndarray:
    """Ends of the four parts of ONE, a row for each row of counts."""
    share = LEAST + (ONE - 4 * LEAST) * counts // counts.sum(axis=1, keepdims=True)
    ends = np.cumsum(share, axis=1).astype(np.int32)
    ends[:, 3] = ONE
    return ends


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks that go together, the longest first, in groups of like size."""
    order = np.argsort(-lengths, kind="stable")
    yield from np.array_split(order, -(-len(order) // LANES)) if len(order) else ()


def _active(lengths: np.ndarray) -> list[int]:
    """By place: how many lanes reach it (lengths fall)."""
    n = int(lengths[0]) if len(lengths) else 0
    return (len(lengths) - np.cumsum(np.bincount(lengths, minlength=n + 1))).tolist()[:n]


def encode_blocks(blocks: Sequence[np.ndarray], vocabulary: int) -> list[bytes]:
    """The coded form of each block of ids below ``vocabulary`` (at most MOST_IDS); an empty block is its head alone."""
    if not 0 < vocabulary <= MOST_IDS:
        raise ValueError(f"no vocabulary of {vocabulary} ids")
    out: list[bytes] = [b""] * len(blocks)
    lengths = np.fromiter(map(len, blocks), dtype=np.int64, count=len(blocks))
    for lanes in _groups(lengths):
        for k, words in zip(lanes.tolist(), _encode([blocks[k] for k in lanes], vocabulary)):
            ids = np.asarray(blocks[k]).astype("<u4").tobytes()
            out[k] = HEAD.pack(MAGIC, len(blocks[k]), vocabulary, zlib.crc32(ids), zlib.crc32(words)) + words
    return out


def _followed(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """By row and place: the id at the last place before with the same key, 0 if none."""
    order = np.argsort(keys, axis=1, kind="stable")
    order += np.arange(len(keys), dtype=np.int64)[:, None] * keys.shape[1]
    flat = order.ravel()
    k, x = keys.ravel().take(flat), ids.ravel().take(flat)
    found = np.zeros(len(flat), dtype=ids.dtype)
    found[1:] = x[:-1] * (k[1:] == k[:-1])
    found[:: keys.shape[1]] = 0
    out = np.empty_like(found)
    out[flat] = found
    return out.reshape(ids.shape)


def _dense(ids: np.ndarray) -> np.ndarray:
    """Every row's ids numbered from 0, ascending."""
    order = np.argsort(ids, axis=1, kind="stable")
    order += np.arange(len(ids), dtype=np.int64)[:, None] * ids.shape[1]
    flat = order.ravel()
    ranked = ids.ravel().take(flat).reshape(ids.shape)
    steps = np.zeros(ids.shape, dtype=np.int32)
    np.cumsum(ranked[:, 1:] != ranked[:, :-1], axis=1, out=steps[:, 1:])
    out = np.empty(ids.size, dtype=np.int32)
    out[flat] = steps.ravel()
    return out.reshape(ids.shape)


def _plan(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, ...]:
    """By place and lane: start and share of the part of ONE; start, share and total of the id in its part (total 0: none)."""
    lanes, n = ids.shape
    last, low = np.zeros((lanes, n), dtype=np.int64), np.zeros((lanes, n), dtype=np.int64)
    last[:, 1:] = ids[:, :-1]
    first = last & MASK
    low[:, 1:] = first[:, :-1]
    e1, e2 = _followed(first.astype(np.uint16), ids), _followed(_second(last, low).astype(np.uint16), ids)
    del last, low, first
    hit = (e2 == ids).view(np.uint8)
    sets = (e1 == e2).astype(np.int64)
    for back in (1, 2, 3):
        sets[:, back:] += hit[:, :-back].astype(np.int64) << back
    sets += np.arange(lanes, dtype=np.int64)[:, None] * SETS
    right = hit | ((e1 == ids).view(np.uint8) << 1)
    dense = _dense(ids)
    wide = int(dense.max()) + 1
    dense += np.arange(lanes, dtype=np.int32)[:, None] * wide
    seen, rights = np.zeros(lanes * wide, dtype=np.int64), np.tile(_START, (lanes, 1))
    out = [np.zeros((n, lanes), dtype=np.int32) for _ in range(5)]
    for frm, until in checkpoints(n):
        own, here = dense[:, frm:until], sets[:, frm:until]
        times = seen.take(own)
        part = _PART.take(right[:, frm:until] | ((times > 0).view(np.uint8) << 2))
        ends, at = _ends(rights), here * 4 + part
        end = ends.ravel().take(at)
        start = ends.ravel().take(at - 1) & (ONE - 1)  # before a first part stands another set's last end, ONE
        grid = seen.reshape(lanes, wide)
        below = (np.cumsum(grid, axis=1) - grid).ravel().take(own)
        is0, new = part == ORDER0, part == NEW
        for o, v in zip(out, (start, end - start, below * is0 + ids[:, frm:until] * new, times * is0 + new, is0 * max(frm, 1) + new * vocabulary)):
            o[frm:until] = v.T
        rights += np.bincount(at.ravel(), minlength=lanes * SETS * 4).reshape(-1, 4)
        seen += np.bincount(own.ravel(), minlength=lanes * wide)
    return tuple(out)


def _encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    lanes, lengths = len(blocks), np.asarray([len(b) for b in blocks])
    n = int(lengths[0])
    if not n:
        return [b""] * lanes
    plan = [np.empty((n, lanes), dtype=np.uint16 if vocabulary < ONE and n < ONE else np.int32) for _ in range(5)]
    for k in range(0, lanes, SOUGHT):
        some = blocks[k : k + SOUGHT]
        ids = np.full((len(some), n), vocabulary, dtype=np.uint16 if vocabulary < ONE else np.int32)
        for row, b in zip(ids, some):
            row[: len(b)] = b
        for whole, own in zip(plan, _plan(ids, vocabulary)):
            whole[:, k : k + SOUGHT] = own
    active = _active(lengths)
    low, span = np.zeros(lanes, dtype=np.int64), np.full(lanes, FULL, dtype=np.int64)
    room = 3 * n + 2  # an id takes a word at most for its part and two for itself
    digits = np.zeros(lanes * room, dtype=np.int32)
    at = np.arange(lanes, dtype=np.int64) * room
    first = at.copy()

    def put(lo: np.ndarray, sp: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Write a word where the span has become small.  A word may hold a carry, which is settled at the end."""
        word = lo >> 32
        digits[spot] = word  # where no word is due, the next one overwrites it
        due = (sp < SMALL).astype(np.int64)
        shift = due << 4
        return (lo - (word << 32) * due) << shift, sp << shift, spot + due

    for frm in range(0, n, 64):
        rows = [p[frm : frm + 64].astype(np.int64) for p in plan]
        for k in range(len(rows[0])):
            a = active[frm + k]
            start, share, start2, share2, total = (x[k, :a] for x in rows)
            r = span[:a] >> 16
            lo, sp, spot = put(low[:a] + r * start, r * share, at[:a])
            rest = np.flatnonzero(total)
            if len(rest):
                r = (sp.take(rest) / total.take(rest)).astype(np.int64)  # exact: both below 2**53, see the tests
                own = put(lo.take(rest) + r * start2.take(rest), r * share2.take(rest), spot.take(rest))
                lo[rest], sp[rest], spot[rest] = put(*own) if vocabulary > ONE else own
            low[:a], span[:a], at[:a] = lo, sp, spot
    digits[at] = (low + LOW) >> 32  # one more word, rounded up, lies in what is left
    at += 1
    out = []
    for k in range(lanes):
        own = digits[k * room : k * room + int(at[k] - first[k])].astype(np.int64)
        while (over := own >> WORD).any():
            own &= ONE - 1
            own[:-1] += over[1:]
        out.append(own.astype("<u2").tobytes() if lengths[k] else b"")
    return out


def decode_blocks(coded: Sequence[bytes]) -> list[np.ndarray]:
    """The ids of each block, as unsigned 32-bit integers; ValueError where a checksum does not hold."""
    heads = []
    for b in coded:
        if len(b) < HEAD.size or b[:4] != MAGIC:
            raise ValueError("not a block of ids")
        head = HEAD.unpack_from(b)
        if zlib.crc32(memoryview(b)[HEAD.size :]) != head[4]:
            raise ValueError("a block's bytes do not match their checksum")
        if not 0 < head[2] <= MOST_IDS:
            raise ValueError(f"no vocabulary of {head[2]} ids")
        heads.append(head)
    out: list[np.ndarray] = [np.zeros(0, dtype="<u4")] * len(coded)
    lengths = np.asarray([h[1] for h in heads], dtype=np.int64)
    for lanes in _groups(lengths):
        sizes = {heads[k][2] for k in lanes}
        for vocabulary in sizes:
            mine = [k for k in lanes.tolist() if heads[k][2] == vocabulary]
            for k, ids in zip(mine, _decode([coded[k] for k in mine], lengths[mine], vocabulary)):
                if zlib.crc32(ids.tobytes()) != heads[k][3]:
                    raise ValueError("a block's ids do not match their checksum")
                out[k] = ids
    return out


def _decode(coded: list[bytes], lengths: np.ndarray, vocabulary: int) -> list[np.ndarray]:
    lanes, n = len(coded), int(lengths[0])
    if not n:
        return [np.zeros(0, dtype="<u4")] * lanes
    words = [np.frombuffer(b, dtype="<u2", offset=HEAD.size) for b in coded]
    ends = np.cumsum([len(w) + 3 for w in words])  # a reader may look three words beyond
    flat = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
    for w, end in zip(words, ends.tolist()):
        flat[end - 3 - len(w) : end - 3] = w
    at = ends - np.asarray([len(w) + 3 for w in words])
    value = (flat[at] << 32) | (flat[at + 1] << 16) | flat[at + 2]
    at += 3
    span = np.full(lanes, FULL, dtype=np.int64)
    lane = np.arange(lanes, dtype=np.int64)
    one, two = np.zeros(lanes << TABLE_BITS, dtype=np.int32), np.zeros(lanes << TABLE_BITS, dtype=np.int32)
    table, sets, quads = lane << TABLE_BITS, lane * SETS, lane * 4
    first, second, state = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    rights = np.tile(_START, (lanes, 1))
    found = np.zeros((n, lanes), dtype=np.int32)
    codes = np.zeros((n, lanes), dtype=np.int32)
    active = _active(lengths)

    def get(v: np.ndarray, sp: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        due = (sp < SMALL).astype(np.int64)
        shift = due << 4
        return (v << shift) | (flat.take(spot, mode="clip") * due), sp << shift, spot + due

    for frm, until in checkpoints(n):
        # order 0 by rows of sorted ids; behind them, for ids not seen, the vocabulary
        ranked = np.sort(np.ascontiguousarray(found[:frm].T).astype(np.uint16 if vocabulary < ONE else np.int32), axis=1, kind="stable")
        begin, times = _runs(ranked)
        every = np.arange(vocabulary, dtype=np.int32)
        named = np.concatenate([ranked.ravel().astype(np.int32), every])
        begin, times = np.concatenate([begin, every]), np.concatenate([times, np.ones_like(every)])
        base = np.stack([lane * frm, np.full(lanes, ranked.size)]).ravel()
        totals = np.array([0, 0, max(frm, 1), vocabulary], dtype=np.int64)
        rows = _ends(rights).view(np.complex128).ravel()
        for place in range(frm, until):
            a = active[place]
            i1, i2 = table[:a] + first[:a], table[:a] + second[:a]
            e1, e2 = one.take(i1), two.take(i2)
            s = state[:a] + (e1 == e2)
            s += sets[:a]
            row = rows.take(s).view(np.int32)
            v, sp = value[:a], span[:a]
            r = sp >> 16
            slot = (v / r).astype(np.int32)
            part = ((slot[:, None] >= row.reshape(a, 4)).view(np.uint32).ravel() * np.uint32(0x01010101) >> np.uint32(24)).astype(np.int64)
            codes[place, :a] = s * 4 + part
            end = quads[:a] + part
            start = row.take(end - 1) & (ONE - 1)
            v, sp, spot = get(v - r * start, r * (row.take(end) - start), at[:a])
            x = np.where(part == 0, e2, e1)
            rest = np.flatnonzero(part >= ORDER0)
            if len(rest):
                which, v2, sp2 = part.take(rest), v.take(rest), sp.take(rest)
                r = (sp2 / totals.take(which)).astype(np.int64)
                k = base.take((which - ORDER0) * lanes + rest) + (v2 / r).astype(np.int64)
                x[rest] = named.take(k, mode="clip")
                own = get(v2 - r * begin.take(k, mode="clip"), r * times.take(k, mode="clip"), spot.take(rest))
                v[rest], sp[rest], spot[rest] = get(*own) if vocabulary > ONE else own
            value[:a], span[:a], at[:a] = v, sp, spot
            found[place, :a] = x
            one[i1], two[i2] = x, x
            state[:a] = (((state[:a] & OUTCOMES - 1) | (x == e2)) << 1)
            x = x.astype(np.int64)
            second[:a] = _second(x, first[:a])
            first[:a] = x & MASK
        rights += np.bincount(codes[frm:until].ravel(), minlength=lanes * SETS * 4).reshape(-1, 4) if active[until - 1] == lanes else _counted(codes, active, frm, until, lanes)
    by_lane = np.ascontiguousarray(found.T).astype("<u4")
    return [by_lane[k, :m] for k, m in enumerate(lengths.tolist())]


def _counted(codes: np.ndarray, active: list[int], frm: int, until: int, lanes: int) -> np.ndarray:
    """The same where some lanes have ended; those do not count any more."""
    return sum(np.bincount(codes[k, : active[k]], minlength=lanes * SETS * 4) for k in range(frm, until)).reshape(-1, 4)


def _runs(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: by place, where its run of equal values begins, and how long it is."""
    lanes, n = ranked.shape
    if not n:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    new = np.ones((lanes, n), dtype=bool)
    np.not_equal(ranked[:, 1:], ranked[:, :-1], out=new[:, 1:])
    heads = np.flatnonzero(new.ravel())
    length = np.diff(np.append(heads, lanes * n))
    return np.repeat((heads % n).astype(np.int32), length), np.repeat(length.astype(np.int32), length)
