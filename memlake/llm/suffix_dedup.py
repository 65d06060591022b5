"""Suffix-array dedup of repeated passages by longest-previous-factor arrays.

A byte is repeated if a string of ``limit`` bytes that covers it also starts
somewhere else. The work goes from cheap to exact:

1. Winnowing: a string of ``limit`` bytes (a window) has one anchor, of its
   byte grams the first one with the least hash. Equal windows have their
   anchor at the same place within them, so windows are compared only where
   their anchors' grams are equal, and each window is judged at one anchor.
2. The windows of an anchor are neighbours; the text that they span is its
   cover. Shards of the anchors' hashes count covers (see slices.py). An
   anchor that occurs once has no repeated window; if all its covers are
   equal, all its windows are.
3. Covers of an anchor that differ are contested. Each goes once, with all
   others of its anchor, into a block of bounded size. The block's suffix
   array is sorted as deep as a window, and previous and next smaller text
   positions in suffix order give each window its longest previous and next
   factor, cut at ``limit``: a window with a previous factor of ``limit`` bytes
   is a later copy, one with either is repeated. The gram that all covers of
   an anchor share is one symbol there.
4. Anchors with more than ``group_covers`` covers would make a block too large.
   Their windows are cut into cells of WIDTHS windows; what all windows of a
   cell share is the anchor then, and steps 2 to 4 go on with it. Single
   windows are never contested.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shuffle_parts, written
from .slices import SLICE_BYTES, release, sliced, squeeze, squeeze_sorted, texts_of, unsqueeze, unsqueeze_sorted

LIMIT = 400
GRAM = 200
#: Covers of one anchor hash that a suffix array takes in.
GROUP_COVERS = 1024
#: Covers in a block of the suffix array, on average.
BLOCK_COVERS = 2048
#: Tasks that sort blocks, at most, where that is more than the session's shuffle partitions.
MOST_TASKS = 20_000
#: Windows in a cell, by level; 0: all windows of the anchor.
WIDTHS = (0, 26, 5, 1)
#: Bytes of text for which a shard of the anchors is meant.
SHARD_BYTES = 24 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes hashed at once; blocks overlap by limit bytes.
HASH_BLOCK = 1 << 18

#: Rows between the stages; ``n`` and ``m`` are numbers of entries that go on.
ROW = "kind int, shard int, slice long, level int, n long, m long, blob binary"
_ROW = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("slice", pa.int64()), ("level", pa.int32()), ("n", pa.int64()), ("m", pa.int64()), ("blob", pa.binary())])
QUESTION, ENTRIES, STATUS, TEXTS, RESULT, ANSWER, REST = range(7)
#: What a shard says of a cover: nothing is repeated, all is, it is contested (this slice sends it, or another one does), it has to be cut.
NONE, ALL, SEND, WAIT, CUT = range(5)
#: Added in the slice that has the cover's first place.
FIRST = 16


# ---------------------------------------------------------------- kernels


def suffix_array(codes: np.ndarray, width: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the suffixes of codes (whole numbers from 1), their ranks, and how many codes those compare.

    As many codes as fit into a key at first, then two or three times as many
    in each turn. With ``width`` they compare half of it at least and not more
    than it; without, the order is complete.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    bits = int(codes.max()).bit_length()
    reach = min(63 // bits, width or n)
    wide = np.zeros(n + reach, np.int64)
    wide[:n] = codes
    key = np.zeros(n, np.int64)
    for k in range(reach):
        key = (key << bits) | wide[k : k + n]
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (ranked[1:] != ranked[:-1]).astype(np.int64))))
        if rank[order[-1]] == n - 1 or (width is not None and 2 * reach >= width) or reach >= n:
            return order, rank, reach
        triple = n + 1 < 1 << 21 and (width is None or 3 * reach <= width)
        key = rank + 1
        for k in range(1, 3 if triple else 2):
            key <<= 21 if triple else 31
            if k * reach < n:
                key[: n - k * reach] |= rank[k * reach :] + 1
        reach *= 3 if triple else 2


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left, -1 if there is none; by pointer jumping."""
    n = len(values)
    at = np.arange(-1, n - 1)
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[values[at[open_]] >= values[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


def next_smaller(values: np.ndarray) -> np.ndarray:
    back = previous_smaller(values[::-1])[::-1]
    return np.where(back >= 0, len(values) - 1 - back, -1)


def longest_previous_factor(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each place: length of the longest string that starts there and also starts earlier, and where (-1: nowhere)."""
    codes = np.frombuffer(data, np.uint8).astype(np.int64) + 1
    n = len(codes)
    order, _, _ = suffix_array(codes)
    before, after = previous_smaller(order), next_smaller(order)
    length, source = np.zeros(n, np.int64), np.full(n, -1)
    for side in (before, after):
        has = np.flatnonzero(side >= 0)
        i, j = order[has], order[side[has]]
        common, going = np.zeros(len(has), np.int64), np.arange(len(has))
        while len(going):
            inside = (i[going] + common[going] < n) & (j[going] + common[going] < n)
            going = going[inside]
            going = going[codes[i[going] + common[going]] == codes[j[going] + common[going]]]
            common[going] += 1
        better = common > length[i]
        length[i[better]], source[i[better]] = common[better], j[better]
    return length, source


def anchors(data: np.ndarray, gram: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the grams that have the least hash of some ``run`` successive grams."""
    n = len(data) - gram + 1
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    powers = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[0][: len(data)], out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * powers[1][:n]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    least = _sliding(x, run, np.minimum, _MOST)
    # a gram is an anchor if the least hash of some run that holds it is its own
    edges = np.concatenate((np.zeros(run - 1, np.uint64), least, np.zeros(run - 1, np.uint64)))
    most = _sliding(edges, run, np.maximum, np.uint64(0))
    at = np.flatnonzero(most == x)
    return at, x[at]


def _powers(n: int, known: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  kept over calls
    if known.get("n", 0) < n:
        for k, base in ((0, _BASE), (1, _INVERSE)):
            known[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base))), dtype=np.uint64)
        known["n"] = n
    return known[0], known[1]


def _sliding(x: np.ndarray, run: int, pick, neutral) -> np.ndarray:
    """pick over each ``run`` successive values, by running values of blocks from both ends."""
    n = len(x)
    blocks = np.concatenate((x, np.full(-n % run, neutral))).reshape(-1, run)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - run + 1], ahead[run - 1 : n])


def document_anchors(raw: bytes, gram: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, last window) of the anchors of a whole document; each window has one.

    It is hashed in blocks that overlap so that each window is seen whole.
    """
    run, n = limit - gram + 1, len(raw) - limit + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    places, hashes, at = [], [], 0
    while True:
        end = min(len(raw), at + HASH_BLOCK + limit - 1)
        p, h = anchors(data[at:end], gram, run)
        places.append(p + at), hashes.append(h)
        if end == len(raw):
            break
        at += HASH_BLOCK
    p, first = np.unique(np.concatenate(places), return_index=True)
    h = np.concatenate(hashes)[first]
    # the anchor of a window is smaller than all grams before it and not larger than those after it
    rank = np.empty(len(h), np.int64)
    rank[np.argsort(h, kind="stable")] = np.arange(len(h))
    before, after = previous_smaller(rank), next_smaller(rank)
    lo = np.maximum(p - run + 1, np.where(before >= 0, p[before] + 1, 0))
    hi = np.minimum(np.minimum(p, n - 1), np.where(after >= 0, p[after] - run, n - 1))
    has = lo <= hi
    return p[has], h[has], lo[has], hi[has]


def block_repeats(lefts: list[bytes], rights: list[bytes], groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cover, place, earlier, any) of each window of the covers, which are in corpus order.

    A cover is what lies left and right of what its group has in common; its
    k-th window begins k bytes into the left part and has ``length`` bytes
    besides what is common. ``earlier``: the window equals one of an earlier
    cover of its group; ``any``: of any other cover of its group.
    """
    n_left, n_right = (np.array([len(x) for x in side]) for side in (lefts, rights))
    # one symbol for the group's common part and one for the end of a cover
    sizes = n_left + n_right + 2
    starts = np.cumsum(sizes) - sizes
    codes = np.frombuffer(b"".join(x + b"\0" + y + b"\0" for x, y in zip(lefts, rights, strict=True)), np.uint8).astype(np.int64) + 2
    codes[starts + n_left] = groups + 258
    codes[starts + sizes - 1] = 1
    width = length + 1
    _, rank, reach = suffix_array(codes, width)
    own = np.repeat(np.arange(len(lefts)), n_left + 1)
    place = np.arange(len(own)) - np.repeat(np.cumsum(n_left + 1) - (n_left + 1), n_left + 1)
    at = starts[own] + place
    fits = place + length <= (n_left + n_right)[own]
    own, place, at = own[fits], place[fits], at[fits]
    # two overlapping stretches of ranks make up a window, and the common symbol in it tells group and place
    same = rank[at] * len(codes) + rank[at + width - reach]
    order = np.argsort(same)
    same, by_place = same[order], at[order]

    def full(side: np.ndarray) -> np.ndarray:
        return (side >= 0) & (same == same[side])

    early = full(previous_smaller(by_place)) | full(next_smaller(by_place))
    later = full(next_smaller(-by_place)) | full(previous_smaller(-by_place))
    earlier, either = np.zeros(len(at), bool), np.zeros(len(at), bool)
    earlier[order], either[order] = early, early | later
    return own, place, earlier, either


def runs(own: np.ndarray, place: np.ndarray, mask: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many each of n covers has, first, last place) of the maximal runs where mask holds."""
    at = np.flatnonzero(mask)
    if not len(at):
        return np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], (np.diff(place[at]) != 1) | (np.diff(own[at]) != 0)))
    first = at[new]
    last = at[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1]))]
    return np.bincount(own[first], minlength=n), place[first], place[last]


def spans_of(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans: those of which no two touch or overlap, in order."""
    order = np.argsort(lo)
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(lo) - 1]))
    return lo[new], reach[last]


# ---------------------------------------------------------------- slices and shards


def pack(**arrays) -> bytes:
    """Arrays and lists of bytes as one blob; ``keys`` are sorted."""
    out = {}
    for name, x in arrays.items():
        if name == "keys":
            out[name] = squeeze_sorted(x)
        elif isinstance(x, list):
            out[name] = ([len(b) for b in x], zstandard.ZstdCompressor(1).compress(b"".join(x)))
        else:
            out[name] = (x.dtype.str, squeeze(x) if len(x) else b"")
    return pickle.dumps(out)


def unpack(blob: bytes) -> dict:
    out = {}
    for name, x in pickle.loads(blob).items():
        if name == "keys":
            out[name] = unsqueeze_sorted(x)
        elif isinstance(x[0], list):
            out[name] = texts_of(*x)
        else:
            out[name] = unsqueeze(x[1], np.dtype(x[0])) if x[1] else np.zeros(0, x[0])
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROW)], schema=_ROW)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _asked(number: int, level: int, key: np.ndarray, fp: np.ndarray, place: np.ndarray, at: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, shards: int) -> Iterator[tuple]:
    """The rows of a slice's entries, and its questions: distinct (key, fp) with their numbers and first places.

    An entry: key, fingerprint of the cover, place of the anchor in the
    slice's bytes and in the bytes at hand, document, first and last window
    beside the anchor.
    """
    order = np.lexsort((place, ids[doc], fp, key))
    key, fp, place, at, doc, lo, hi = (x[order] for x in (key, fp, place, at, doc, lo, hi))
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]))) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    yield ENTRIES, 0, number, level, len(key), 0, pack(new=new, place=place, at=at, doc=doc.astype(np.int32), lo=lo.astype(np.int32), hi=hi.astype(np.int32))
    copies = np.diff(np.concatenate((first, [len(key)])))
    shard = _shard_of(key[first], shards)
    edges = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if b > a:
            own = first[a:b]
            yield QUESTION, k, number, level, b - a, a, pack(keys=key[own], fp=fp[own], copies=copies[a:b].astype(np.int32), id=ids[doc[own]], place=place[own])


def slice_questions(number: int, texts: list[bytes], ids: np.ndarray, gram: int, limit: int, shards: int) -> Iterator[tuple]:
    """Level 0: an entry for each anchor of the slice's texts."""
    parts, fp, at = [], [], 0
    for d, raw in enumerate(texts):
        p, h, lo, hi = document_anchors(raw, gram, limit)
        for a, b, c in zip(lo.tolist(), hi.tolist(), p.tolist(), strict=True):
            fp.append(_digest(raw[a : b + limit] + bytes([(c - a) & 255, (c - a) >> 8])))
        parts.append((h, p + at, np.full(len(p), d), lo - p, hi - p))
        at += len(raw)
    key, place, doc, lo, hi = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64) for k in range(5))
    # anchors have small hashes; keys are to be even
    key = key.astype(np.uint64) * _BASE
    key = (key ^ (key >> np.uint64(32))) * _BASE
    yield from _asked(number, 0, key ^ (key >> np.uint64(29)), np.array(fp, np.uint64), place, place, doc, lo, hi, ids, shards)


def shard_status(shard: int, level: int, slices: list[int], blobs: list[bytes], group_covers: int) -> Iterator[tuple]:
    """For each slice what its covers of this shard are: one status a question, and of those to send the copies and the corpus order."""
    parts = [unpack(b) for b in blobs]
    key, fp, copies, ids, place = (np.concatenate([p[c] for p in parts]) for c in ("keys", "fp", "copies", "id", "place"))
    who = np.repeat(np.arange(len(parts)), [len(p["keys"]) for p in parts])
    number = np.array(slices, np.int64)[who]
    order = np.lexsort((place, number, ids, fp, key))
    same_key = np.concatenate(([False], key[order][1:] == key[order][:-1]))
    same = same_key & np.concatenate(([False], fp[order][1:] == fp[order][:-1]))
    pair, group = np.cumsum(~same) - 1, np.cumsum(~same_key) - 1
    total = np.bincount(pair, copies[order])[pair]
    kinds = np.bincount(group, ~same)[group]
    status = np.where(kinds == 1, np.where(total > 1, ALL, NONE), np.where(kinds > group_covers, CUT, np.where(same, WAIT, SEND)))
    if level == len(WIDTHS) - 1:  # one window: equal keys are equal windows
        status = np.where(kinds > 1, np.where(same, WAIT, SEND), status)
    out = np.empty(len(key), np.uint8)
    out[order] = status + np.where(same, 0, FIRST)
    sent = np.empty(len(key), np.int64)
    sent[order] = total
    for k, s in enumerate(slices):
        own = np.flatnonzero(who == k)
        send = own[out[own] % FIRST == SEND]
        yield STATUS, shard, s, level, len(send), int((out[own] % FIRST == CUT).sum()), pack(status=out[own], copies=sent[send], id=ids[send], place=place[send])


def _level_of(rows: list[dict], level: int) -> tuple[dict, np.ndarray, np.ndarray, dict] | None:
    """A slice's entries of a level, the status and shard of each of its questions, and what goes with those to send."""
    entries = [unpack(r["blob"]) for r in rows if r["kind"] == ENTRIES and r["level"] == level]
    if not entries:
        return None
    said = sorted(((r["shard"], r["blob"]) for r in rows if r["kind"] == STATUS and r["level"] == level), key=lambda r: r[0])
    parts = [unpack(b) for _, b in said]
    more = {c: np.concatenate([x[c] for x in parts]) if parts else np.zeros(0, np.int64) for c in ("status", "copies", "id", "place")}
    shard = np.repeat([k for k, _ in said], [len(x["status"]) for x in parts]) if parts else np.zeros(0, np.int64)
    return entries[0], more.pop("status").astype(np.uint8), shard, more


def _shared(lo: np.ndarray, level: int, gram: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end, beside the anchor, of what all windows of a group share; lo: a window of it."""
    if level == 0:
        return np.zeros(len(lo), np.int64), np.full(len(lo), gram)
    first = lo.astype(np.int64) // WIDTHS[level] * WIDTHS[level]
    return first + WIDTHS[level] - 1, first + limit


def _group_key(raw: bytes, place: int, first: int, last: int, level: int) -> int:
    """Key of a group: of the bytes that its windows share, and where those lie beside the anchor."""
    return _digest(raw[place + first : place + last] + b"%d %d" % (level, first))


def next_level(number: int, raw: bytes, ids: np.ndarray, rows: list[dict], level: int, gram: int, limit: int, shards: int, blocks: int) -> Iterator[tuple]:
    """The covers that this slice sends to the blocks, and the entries and questions of the next level for those to be cut.

    ``raw`` holds the bytes that the entries' ``at`` are places in: those of
    the slice, or, from level 1 on, the covers to be cut (row REST).
    """
    found = _level_of(rows, level)
    if found is None:
        return
    e, status, shard, sent = found
    question = np.cumsum(e["new"]) - 1
    kind = status[question] % FIRST
    at = np.flatnonzero(e["new"] & (kind == SEND))
    if len(at):
        p, lo, hi = e["at"][at], e["lo"][at], e["hi"][at]
        first, last = _shared(lo, level, gram, limit)
        cuts = [x.tolist() for x in (p + lo, p + first, p + last, p + hi + limit)]
        rest = {"left": [raw[a:b] for a, b in zip(cuts[0], cuts[1], strict=True)], "right": [raw[a:b] for a, b in zip(cuts[2], cuts[3], strict=True)]}
        rest["group"] = np.array([_group_key(raw, x, a, b, level) for x, a, b in zip(p.tolist(), first.tolist(), last.tolist(), strict=True)], np.uint64)
        rest |= {"lo": lo, "length": limit - (last - first), "question": question[at], "shard": shard[question[at]], **sent}
        block = (rest["group"] % np.uint64(blocks)).astype(np.int64)
        for k in np.unique(block).tolist():
            own = np.flatnonzero(block == k)
            yield TEXTS, k, number, level, len(own), 0, pack(**{c: [x[i] for i in own.tolist()] if isinstance(x, list) else x[own] for c, x in rest.items()})
    cut = np.flatnonzero(kind == CUT)
    if not len(cut):
        return
    if level == 0:
        # from here on only these covers are needed, each once
        once = cut[e["new"][cut]]
        begin, end = e["at"][once] + e["lo"][once], e["at"][once] + e["hi"][once] + limit
        offset = np.zeros(len(status), np.int64)
        offset[question[once]] = np.cumsum(end - begin) - (end - begin)
        raw = b"".join(raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True))
        yield REST, 0, number, 0, len(once), 0, pack(raw=[raw], ids=ids)
        moved = offset[question[cut]] - e["lo"][cut]
    else:
        moved = e["at"][cut]
    width = WIDTHS[level + 1]
    lo, hi = e["lo"][cut].astype(np.int64), e["hi"][cut].astype(np.int64)
    n = hi // width - lo // width + 1
    own = np.repeat(np.arange(len(cut)), n)
    cell = lo[own] // width + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    x, y = np.maximum(lo[own], cell * width), np.minimum(hi[own], cell * width + width - 1)
    place, doc, here = e["place"][cut][own], e["doc"][cut][own].astype(np.int64), moved[own]
    first, last = _shared(x, level + 1, gram, limit)
    key = np.array([_group_key(raw, p, a, b, level + 1) for p, a, b in zip(here.tolist(), first.tolist(), last.tolist(), strict=True)], np.uint64)
    fp = np.array([_digest(raw[p + a : p + b + limit] + b"%d" % a) for p, a, b in zip(here.tolist(), x.tolist(), y.tolist(), strict=True)], np.uint64)
    yield from _asked(number, level + 1, key, fp, place, here, doc, x, y, ids, shards)


def _ragged(count: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Places of the rows' entries in a flat array, for the rows ``pick`` of those with ``count`` entries each."""
    start, n = (np.cumsum(count) - count)[pick], count[pick]
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


RUNS = ("early", "either")


def block_results(level: int, blobs: list[tuple[int, bytes]]) -> Iterator[tuple]:
    """For each sending slice and shard the runs of windows, by question, that have an earlier copy and that are repeated at all."""
    parts = [(s, unpack(b)) for s, b in blobs]
    who = np.repeat(np.array([s for s, _ in parts], np.int64), [len(p["lo"]) for _, p in parts])
    ids, place, lo, question, shard, copies, length, group = (np.concatenate([p[c] for _, p in parts]) for c in ("id", "place", "lo", "question", "shard", "copies", "length", "group"))
    left, right = ([x for _, p in parts for x in p[c]] for c in ("left", "right"))
    # corpus order
    order = np.lexsort((place, who, ids))
    own, at, earlier, either = block_repeats([left[i] for i in order.tolist()], [right[i] for i in order.tolist()], np.unique(group, return_inverse=True)[1][order], int(length[0]))
    either |= (copies[order] > 1)[own]
    found = dict(zip(RUNS, (runs(own, at, earlier, len(order)), runs(own, at, either, len(order))), strict=True))
    base = lo[order].astype(np.int64)
    to = np.stack([who, shard], axis=1)[order]
    for s, k in np.unique(to, axis=0).tolist():
        mine = np.flatnonzero((to == (s, k)).all(axis=1))
        out = {"question": question[order][mine]}
        for name, (count, a, b) in found.items():
            flat, shift = _ragged(count, mine), np.repeat(base[mine], count[mine])
            out |= {name: count[mine].astype(np.int32), f"{name}_lo": (a[flat] + shift).astype(np.int32), f"{name}_hi": (b[flat] + shift).astype(np.int32)}
        yield RESULT, k, s, level, len(mine), 0, pack(**out)


def shard_answers(shard: int, level: int, asked: list[dict], results: list[dict]) -> Iterator[tuple]:
    """Each slice's contested questions with the runs that a block found for their cover, whichever slice had sent it."""
    if not results:
        return
    asked = sorted(asked, key=lambda r: r["slice"])
    parts = [unpack(r["blob"]) for r in asked]
    sizes = [len(p["keys"]) for p in parts]
    begin = {r["slice"]: (x - n, r["m"]) for r, x, n in zip(asked, np.cumsum(sizes).tolist(), sizes, strict=True)}
    pair = np.unique(np.stack([np.concatenate([p[c] for p in parts]) for c in ("keys", "fp")], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    found = [(r["slice"], unpack(r["blob"])) for r in results]
    row = np.full(int(pair.max()) + 1, -1)
    n = 0
    for s, f in found:
        x, offset = begin[s]
        row[pair[x + f["question"] - offset]] = n + np.arange(len(f["question"]))
        n += len(f["question"])
    flat = {c: np.concatenate([f[c] for _, f in found]) for name in RUNS for c in (name, f"{name}_lo", f"{name}_hi")}
    for r, size in zip(asked, sizes, strict=True):
        x, offset = begin[r["slice"]]
        own = row[pair[x : x + size]]
        has = np.flatnonzero(own >= 0)
        if len(has):
            out = {"question": has + offset}
            for name in RUNS:
                at = _ragged(flat[name], own[has])
                out |= {name: flat[name][own[has]], f"{name}_lo": flat[f"{name}_lo"][at], f"{name}_hi": flat[f"{name}_hi"][at]}
            yield ANSWER, shard, r["slice"], level, len(has), 0, pack(**out)


def slice_spans(texts: list[bytes], rows: list[dict], limit: int, keep: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of the maximal runs to remove, in order."""
    docs, lows, highs = [], [], []
    for level in range(len(WIDTHS)):
        found = _level_of(rows, level)
        if found is None:
            break
        e, status, _, _ = found
        question = np.cumsum(e["new"]) - 1
        kind, place, doc = status[question] % FIRST, e["place"], e["doc"].astype(np.int64)
        # the first place of a cover in the corpus: the earliest of its question, in the slice that has it
        origin = e["new"] & (status[question] >= FIRST) if keep == "first" else np.zeros(len(doc), bool)
        at = np.flatnonzero((kind == ALL) & ~origin)
        docs.append(doc[at]), lows.append(place[at] + e["lo"][at]), highs.append(place[at] + e["hi"][at] + limit)
        answers = [unpack(r["blob"]) for r in rows if r["kind"] == ANSWER and r["level"] == level]
        if answers:
            flat = {c: np.concatenate([x[c] for x in answers]) for c in answers[0]}
            row = np.full(len(status), -1)
            row[flat["question"]] = np.arange(len(flat["question"]))
            for name, chosen in (("either", ~origin), ("early", origin)):
                at = np.flatnonzero(chosen & (row[question] >= 0))
                own = row[question[at]]
                pick, n = _ragged(flat[name], own), flat[name][own]
                docs.append(np.repeat(doc[at], n)), lows.append(np.repeat(place[at], n) + flat[f"{name}_lo"][pick]), highs.append(np.repeat(place[at], n) + flat[f"{name}_hi"][pick] + limit)
    doc, lo, hi = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, lows, highs))
    if not len(doc):
        return doc, lo, hi
    # a gap between documents keeps their spans apart
    order = np.argsort(lo + doc, kind="stable")
    lo, hi = spans_of((lo + doc)[order], (hi + doc)[order])
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes + np.arange(len(sizes))
    doc = np.searchsorted(starts, lo, side="right") - 1
    return doc, lo - starts[doc], hi - starts[doc]


# ---------------------------------------------------------------- stages

SPAN = "array<struct<lo:int,hi:int>>"
_SPAN = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
OUT = f"doc_id long, n_bytes long, n_removed long, n_spans long, spans {SPAN}, kept_sha256 string, text_sha256 string"
LAST_ID = np.iinfo(np.int64).max


def _numbers(ids: list[int | None]) -> np.ndarray:
    """Ids by which places are ordered; a null id comes last."""
    return np.array([LAST_ID if i is None else i for i in ids], np.int64)


def _slices_of(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, list, list[bytes]]]:
    for number, ids, sizes, blob in zip(*(table.column(c).to_pylist() for c in ("slice", "ids", "sizes", "texts")), strict=True):
        yield number, ids, texts_of(sizes, blob)


def _rows(parts: Iterator[tuple]) -> pa.Table:
    batches = [_batch([row]) for row in parts]
    release()
    return pa.Table.from_batches(batches, schema=_ROW)


def _removed(ids: list, texts: list[bytes], rows: list[dict], limit: int, keep: str) -> pa.Table:
    doc, lo, hi = slice_spans(texts, rows, limit, keep)
    edges = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    sha = []
    for raw, a, b in zip(texts, edges[:-1], edges[1:], strict=True):
        ends = [0, *np.stack([lo[a:b], hi[a:b]], axis=1).ravel().tolist(), len(raw)]
        sha.append(hashlib.sha256(b"".join(raw[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True))).hexdigest())
    spans = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["lo", "hi"]))
    removed = np.bincount(doc, hi - lo, minlength=len(texts)).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    return pa.table([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed), pa.array(np.diff(edges), pa.int64()), spans, pa.array(sha, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "text_sha256"])


def repeated_passages(docs: DataFrame, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, gram: int = GRAM, group_covers: int = GROUP_COVERS, block_covers: int = BLOCK_COVERS, slice_bytes: int = SLICE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each row of docs: ``doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256, text_sha256``.

    ``spans`` are the maximal runs of bytes to remove, half-open and in order
    (``lo``, ``hi``). With ``keep`` 'none' each byte goes that is covered by a
    ``limit``-byte string which also starts anywhere else, in this document or
    another; with 'first' the earliest place of each such string (by id, then
    as the rows stand) stays. Matches never cross documents; strings are
    judged on the input, not on what is left. ``kept_sha256`` is of the bytes
    left.

    A null text is empty. Texts shorter than ``limit`` lose nothing. Rows are
    documents of their own, whether or not they repeat an id or a text or have
    no id (which comes last in order). An empty table gives no rows; other
    columns are not looked at.
    """
    slices = sliced(docs, F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), F.lit(False), "repeat-slices", slice_bytes)
    total = slices.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, texts in _slices_of(batch):
                for row in slice_questions(number, texts, _numbers(ids), gram, limit, shards):
                    yield _batch([row])
        release()

    def status(level: int):
        def run(key, table):
            table = table.sort_by("slice")
            return _rows(shard_status(key[0].as_py(), level, table.column("slice").to_pylist(), table.column("blob").to_pylist(), group_covers))

        return run

    def go_on(level: int, blocks: int):
        def run(left, right):
            found = right.to_pylist()
            if level == 0:
                parts = [(number, b"".join(texts), _numbers(ids)) for number, ids, texts in _slices_of(left)]
            else:
                parts = [(number, x["raw"][0], x["ids"]) for number, blob in zip(left.column("slice").to_pylist(), left.column("blob").to_pylist(), strict=True) for x in [unpack(blob)]]
            return _rows(r for number, raw, ids in parts for r in next_level(number, raw, ids, found, level, gram, limit, shards, blocks))

        return run

    def sort_block(level: int):
        def run(key, table):
            return _rows(block_results(level, list(zip(table.column("slice").to_pylist(), table.column("blob").to_pylist(), strict=True))))

        return run

    def answer(level: int):
        def run(key, left, right):
            return _rows(shard_answers(key[0].as_py(), level, left.to_pylist(), right.to_pylist()))

        return run

    def finish(left, right):
        found = right.to_pylist()
        return pa.concat_tables([_removed(ids, texts, found, limit, keep) for _, ids, texts in _slices_of(left)] or [_removed([], [], [], limit, keep)])

    rows = written(slices.mapInArrow(first, ROW), "repeat-0")
    made, said, texts = [rows], [], slices
    for level in range(len(WIDTHS)):
        own = rows.where(F.col("level") == level)
        asked = own.where(F.col("kind") == QUESTION)
        statuses = written(asked.groupBy("shard").applyInArrow(status(level), ROW), f"repeat-status-{level}")
        said.append(own.where(F.col("kind") == ENTRIES).unionByName(statuses))
        made.append(statuses)
        sends, cuts = statuses.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
        if not sends and not cuts:
            break
        blocks = max(1, -(-sends // block_covers))
        rows = written(texts.groupBy("slice").cogroup(said[-1].groupBy("slice")).applyInArrow(go_on(level, blocks), ROW), f"repeat-{level + 1}")
        made.append(rows)
        if level == 0:
            texts = rows.where(F.col("kind") == REST)
        # sorting takes long for few bytes: the number of tasks is set, so that they aren't coalesced
        sent = rows.where(F.col("kind") == TEXTS).repartition(max(shuffle_parts(docs.sparkSession), min(blocks, MOST_TASKS)), "shard")
        results = written(sent.groupBy("shard").applyInArrow(sort_block(level), ROW), f"repeat-results-{level}")
        answers = written(asked.groupBy("shard").cogroup(results.groupBy("shard")).applyInArrow(answer(level), ROW), f"repeat-answers-{level}")
        discard(results)
        said.append(answers)
        made.append(answers)
        if not cuts:
            break
    every = said[0]
    for more in said[1:]:
        every = every.unionByName(more)
    out = written(slices.groupBy("slice").cogroup(every.groupBy("slice")).applyInArrow(finish, OUT), "repeat-out")
    discard(slices, *made)
    return out


def without_passages(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans of ``repeats`` cut out of the text; all columns stay.

    A character that a span's edge splits is dropped whole. Spans belong to
    rows by id (null or not) and whole text, so rows that repeat an id with
    other texts lose their own passages; of rows equal in both, each is cut
    like the one that loses least.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = []
            for t, found in zip(batch.column(at), batch.column("_repeat_spans"), strict=True):
                if not found.as_py():
                    out.append(t.as_py())
                    continue
                raw = t.as_py().encode("utf-8")
                ends = [0, *(x for s in found.as_py() for x in (s["lo"], s["hi"])), len(raw)]
                out.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)).decode("utf-8", "ignore"))
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.string())).select([n for n in batch.schema.names if n != "_repeat_spans"])

    spans = repeats.where("n_bytes > 0").groupBy(F.col("doc_id").alias("_repeat_id"), F.col("text_sha256").alias("_repeat_text")).agg(F.min_by("spans", "n_removed").alias("_repeat_spans"))
    same = docs[id_col].cast("long").eqNullSafe(F.col("_repeat_id")) & (F.sha2(docs[text_col].cast("binary"), 256) == F.col("_repeat_text"))
    return docs.join(spans.where(F.size("_repeat_spans") > 0), same, "left").drop("_repeat_id", "_repeat_text").mapInArrow(cut, docs.schema)
