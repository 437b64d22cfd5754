"""Operator 10: near-duplicate passages by compact windows.

A text is a sequence of hashed 5-word shingles. For each of HASHES min-hash functions the Cartesian tree of the sequence
(root: the smallest value; subtrees: what lies left and right of it) groups all passages of at least MIN_SHINGLES shingles
by their minimum: a node with centre c and extent [l, r] stands for every passage [i, j] with l <= i <= c <= j <= r. Only
nodes with an extent of MIN_SHINGLES or more matter, about 2 in MIN_SHINGLES positions; these are the minima of sliding
windows of that length (found by doubling in numpy), and their extents follow from a stack over them alone, because the
nearest smaller value of such a node belongs to such a node again.

Of a compact window only the starts of its stretches of MIN_SHINGLES count: a range [lo, hi] of at most MIN_SHINGLES places.

1. Signatures: (hash function, minimum) keys with the packed place of the compact window, shuffled by key. Keys of a single
   text fall out. A key that many texts of one piece share is known to be shared; its further rows are dealt out by text.
2. Exact repeats: two equal stretches of MIN_SHINGLES shingles have equal minima under all hash functions, so only stretches
   are looked at whose HASHES minima are all shared. These are hashed as a whole and grouped by that hash: a group seen in
   two texts is a repeated passage of MIN_WORDS words in all its texts. No text is compared with another, so no pair is
   left out however many texts share the keys, and a group costs in proportion to its rows.
3. Near repeats, interval join: within a text the start ranges of two neighbouring hash functions are intersected; both minima
   together are a key that a common line alone rarely makes. Stretches that a smaller text repeats exactly are left to that
   text. In each key every text is paired with the smallest text there if SUPPORT functions agree. Once these pairs are verified,
   keys that still hold different classes are parted by every set of further functions that agree, and texts are paired
   with the smallest one there: a pair meets under all functions that it agrees on, whatever else shares some of them.
4. Verification on the whole texts: in a candidate, runs of shared shingles with gaps of at most GAP are passages if both
   sides have MIN_SHINGLES shingles and their shingle sets a Jaccard similarity of at least 0.8; a run that fails is parted
   at its largest gap and both parts are tried.
5. Classes: connected components of texts by exact and by verified passages.

Equal texts are one node (64-bit fingerprint of the words), so copies are not expanded. Defined results: null, empty and
short texts (under 50 words) have no passages and are their own class; passages repeated only within one text are not
reported; null doc_ids name a class only if it has no other; repeated rows give repeated results and count as copies; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, materialize, materialize_by, mix64, pieces, run_hashes, shingle_hashes, table, word_hashes
from .components import connected_components

SHINGLE, MIN_WORDS, SIMILARITY = 5, 50, 0.8
MIN_SHINGLES = MIN_WORDS - SHINGLE + 1
HASHES, SUPPORT, GAP, DRIFT = 6, 3, 10, 24
CHUNK = 1 << 17
HOT = 8  # texts of one piece with one key that go to the key's own partition; others are dealt out
BROADCAST_ROWS = 500_000


def shingle_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sequences of all texts one after another, and each text's first (one more than texts). Texts under SHINGLE
    words have none."""
    words, first = word_hashes(column)
    count = np.diff(first)
    room = np.repeat(first[1:], count) - np.arange(first[0] if len(first) else 0, len(words))  # words from here to the text's end
    runs = shingle_hashes(words, SHINGLE)
    return runs[room[: len(runs)] >= SHINGLE], np.concatenate(([0], np.cumsum(np.maximum(count - SHINGLE + 1, 0))))


def sequences(column: pa.Array) -> list[np.ndarray]:
    """The shingle sequence of every text."""
    runs, first = shingle_runs(column)
    return [runs[lo:hi] for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def fingerprints(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each sequence, order included: signed 64 bits."""
    n = np.diff(first)
    place = np.arange(len(runs), dtype=np.uint64) - np.repeat(first[:-1], n).astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(runs + place * U64(0x9E3779B97F4A7C15)), dtype=np.uint64)))
    return mix64(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)).view(np.int64)


def wide_minima(values: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the (first) minimum of some stretch of `width` values within one text."""
    ends = np.repeat(first[1:], np.diff(first))
    found = [np.zeros(0, np.int64)]
    for lo in range(0, len(values) - width + 1, CHUNK):
        part = values[lo : lo + CHUNK + width - 1]
        n = len(part) - width + 1
        low = (part & U64(0xFFFFFFFFFFC00000)) | np.arange(len(part), dtype=np.uint64)  # 42 bits of value, 22 of place
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:n], low[width - span : width - span + n])
        at = (low[:n] & U64(0x3FFFFF))[ends[lo : lo + n] - np.arange(lo, lo + n) >= width]
        if len(at):
            # the place of the minimum never moves back as the stretch moves on
            found.append(at[np.concatenate(([True], at[1:] != at[:-1]))].astype(np.int64) + lo)
    return found[-1] if len(found) == 2 else np.unique(np.concatenate(found))


def compact_windows(values: np.ndarray, first: np.ndarray, width: int = MIN_SHINGLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all nodes of the texts' Cartesian trees whose extent holds `width` values or more; ties go to the first.

    One stack serves all texts: a border between texts is lower than any value.
    """
    centres = wide_minima(values, first, width)
    at = np.concatenate((centres, first))
    # same order as in wide_minima: value without its low bits, then place
    keys = np.concatenate(((values[centres] >> U64(22)).astype(np.int64), np.full(len(first), -1, np.int64)))
    order = np.lexsort((keys, at))  # a border comes before the value at its place
    border = order >= len(centres)
    at, keys = at[order], keys[order].tolist()
    before, after = np.where(border, at - 1, at).tolist(), at.tolist()
    left, right, stack = [0] * len(keys), [len(values) - 1] * len(keys), []
    for i, v in enumerate(keys):
        while stack and keys[stack[-1]] > v:
            right[stack.pop()] = after[i] - 1
        left[i] = before[stack[-1]] + 1 if stack else 0
        stack.append(i)
    left, right = np.array(left, np.int64)[~border], np.array(right, np.int64)[~border]
    wide = right - left + 1 >= width
    return left[wide], centres[wide], right[wide]


def hashed(s: np.ndarray, f: int) -> np.ndarray:
    return mix64(s ^ U64((f + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


_PLACE = (1 << 31) - 1  # of a shingle in its text


def pack_place(lo: np.ndarray, centre: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """centre and how far before it the first and the last start of a stretch lie, both below MIN_SHINGLES."""
    return centre << 12 | (centre - lo) << 6 | (centre - hi)


def unpack_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, centre, hi)."""
    c = place >> 12
    return c - (place >> 6 & 63), c, c - (place & 63)


def start_ranges(left: np.ndarray, centre: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the stretches of MIN_SHINGLES within a compact window that hold its centre."""
    return np.maximum(left, centre - MIN_SHINGLES + 1), np.minimum(centre, right - MIN_SHINGLES + 1)


def _members(batches):
    for b in pieces(batches, "text"):
        runs, first = shingle_runs(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first)), pa.array(fingerprints(runs, first))], ["doc_id", "shingles", "node"])


def hot_rows(keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Whether a row's key has HOT other texts before it."""
    order = np.lexsort((nodes, keys))
    k, n = keys[order], nodes[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    new_node = new_key | np.concatenate(([True], n[1:] != n[:-1]))
    nth = np.cumsum(new_node)
    nth -= np.maximum.accumulate(np.where(new_key, nth, 0))
    out = np.empty(len(keys), bool)
    out[order] = nth >= HOT
    return out


def _signatures(batches):
    """(key, salt, node, place). Rows of a salt other than -1 belong to keys that are shared for certain."""
    seen: set[int] = set()  # a text that this task has entered is not entered again
    for b in pieces(batches, "text"):
        runs, first = shingle_runs(b.column("text"))
        nodes, n = fingerprints(runs, first), np.diff(first)
        fresh = np.zeros(len(nodes), bool)
        for i in np.flatnonzero(n >= MIN_SHINGLES).tolist():
            if (node := int(nodes[i])) not in seen:
                seen.add(node)
                fresh[i] = True
        if not fresh.any():
            continue
        runs, nodes, first = runs[np.repeat(fresh, n)], nodes[fresh], np.concatenate(([0], np.cumsum(n[fresh])))
        keys, places, owners = [], [], []
        for f in range(HASHES):
            left, centre, right = compact_windows(hashed(runs, f), first)
            owner = np.searchsorted(first, centre, side="right") - 1
            lo, hi = start_ranges(left, centre, right)
            # the key's low three bits name the hash function
            keys.append(hashed(runs[centre], f + HASHES) & U64(0xFFFFFFFFFFFFFFF8) | U64(f))
            places.append(pack_place(lo - first[owner], centre - first[owner], hi - first[owner]))
            owners.append(owner)
        key, node = np.concatenate(keys).view(np.int64), nodes[np.concatenate(owners)]
        salt = np.where(hot_rows(key, node), node & 1023, -1).astype(np.int16)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(salt), pa.array(node), pa.array(np.concatenate(places))], ["key", "salt", "node", "place"])


_FIELD = 10  # bits of a signature for each hash function


def composite_rows(keys: np.ndarray, places: np.ndarray, known_lo: np.ndarray, known_hi: np.ndarray):
    """(key, place, signature) of the ranges of starts in which two neighbouring hash functions have shared minima.

    Ranges within one of the known (ascending) ranges are left out. A key's low three bits name the first function. The signature holds _FIELD bits of each
    function's key in the middle of the range, 0 where that is not shared.
    """
    f = keys & 7
    by_hash = []
    for k in range(HASHES):
        key, place = keys[f == k], places[f == k]
        lo, centre, hi = unpack_place(place)
        order = np.argsort(lo, kind="stable")
        by_hash.append((key[order].view(np.uint64), lo[order], centre[order], hi[order]))
    out_key, out_place, out_sign = [], [], []
    for k in range(HASHES):
        (key_a, lo_a, centre, hi_a), (key_b, lo_b, _, hi_b) = by_hash[k], by_hash[(k + 1) % HASHES]
        begin, end = np.searchsorted(hi_b, lo_a), np.searchsorted(lo_b, hi_a, side="right")
        n = np.maximum(end - begin, 0)
        a = np.repeat(np.arange(len(lo_a)), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + begin[a]
        lo, hi = np.maximum(lo_a[a], lo_b[b]), np.minimum(hi_a[a], hi_b[b])
        if len(known_lo):
            at = np.searchsorted(known_lo, lo, side="right") - 1
            free = (at < 0) | (hi > known_hi[np.maximum(at, 0)])
            a, b, lo, hi = a[free], b[free], lo[free], hi[free]
        mid, sign = (lo + hi) // 2, np.zeros(len(a), np.uint64)
        for g, (key, first, _, last) in enumerate(by_hash):
            if len(first):
                at = np.maximum(np.searchsorted(first, mid, side="right") - 1, 0)
                field = np.where((first[at] <= mid) & (mid <= last[at]), (key[at] >> U64(3)) % U64((1 << _FIELD) - 1) + U64(1), U64(0))
                sign |= field << U64(_FIELD * g)
        out_key.append(mix64(key_a[a] + key_b[b] * U64(0x9E3779B97F4A7C15)) & U64(0xFFFFFFFFFFFFFFF8) | U64(k))
        out_place.append(pack_place(lo, centre[a], hi))
        out_sign.append(sign)
    return np.concatenate(out_key).view(np.int64), np.concatenate(out_place), np.concatenate(out_sign).view(np.int64)


def candidate_stretches(place_a: np.ndarray, place_b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Stretches (first, last of text a; least and greatest diagonal) of paired places, merged where they adjoin on about one
    diagonal."""
    (lo_a, c_a, hi_a), (lo_b, c_b, hi_b) = unpack_place(place_a), unpack_place(place_b)
    d = c_b - c_a
    begin, end = np.minimum(lo_a, lo_b - d), np.maximum(hi_a, hi_b - d) + MIN_SHINGLES - 1
    order = np.argsort(d, kind="stable")
    out = []
    for group in np.split(order, np.flatnonzero(np.diff(d[order]) > DRIFT) + 1):
        group = group[np.argsort(begin[group], kind="stable")]
        reach = np.maximum.accumulate(end[group])
        for part in np.split(np.arange(len(group)), np.flatnonzero(begin[group][1:] > reach[:-1] + MIN_SHINGLES) + 1):
            rows = group[part]
            out.append((int(begin[rows[0]]), int(reach[part[-1]]), int(d[rows].min()), int(d[rows].max())))
    return out


def _exact_runs(mine: np.ndarray, theirs: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Equal stretches of MIN_SHINGLES shingles or more, as many as cover all that have one (repeats on one side included).

    Every such stretch holds one of the seeds, so only diagonals of the seeds' places are compared.
    """
    order = np.argsort(theirs, kind="stable")
    diagonals = set()
    for seed in range(0, len(mine), MIN_SHINGLES // 2):
        lo, hi = np.searchsorted(theirs, mine[seed], "left", sorter=order), np.searchsorted(theirs, mine[seed], "right", sorter=order)
        diagonals.update((order[lo:hi] - seed).tolist())
    out, seen_a, seen_b = [], np.zeros(len(mine), bool), np.zeros(len(theirs), bool)
    for d in sorted(diagonals, key=abs):
        lo, hi = max(0, -d), min(len(mine), len(theirs) - d)
        if hi - lo < MIN_SHINGLES or seen_a[lo:hi].all() and seen_b[lo + d : hi + d].all():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], mine[lo:hi] == theirs[lo + d : hi + d], [False])))) + lo
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= MIN_SHINGLES and not (seen_a[s:e].all() and seen_b[s + d : e + d].all()):
                seen_a[s:e] = seen_b[s + d : e + d] = True
                out.append((s, e - 1, s + d, e - 1 + d, 1.0))
    return out


def _passage(mine: np.ndarray, theirs: np.ndarray, run: np.ndarray, ids: int) -> list[tuple[int, int, int, int, float]]:
    """Passages within a run of shared places of `mine`: the whole run, or else what is left and right of its largest gap.

    Of a run without gaps the exact repeats are taken, so these are never lost to what surrounds them. Values are below ids.
    """
    out, todo = [], [run]
    while todo:
        run = todo.pop()
        p, q = int(run[0]), int(run[-1])
        if q - p + 1 < MIN_SHINGLES:
            continue
        x, y = np.zeros(ids, bool), np.zeros(ids, bool)
        x[mine[p : q + 1]] = True
        back = np.flatnonzero(x[theirs])
        edges = np.concatenate(([0], np.flatnonzero(back[1:] - back[:-1] > GAP) + 1, [len(back)]))
        longest = int((edges[1:] - edges[:-1]).argmax())
        u, v = int(back[edges[longest]]), int(back[edges[longest + 1] - 1])
        y[theirs[u : v + 1]] = True
        sim = np.count_nonzero(x & y) / np.count_nonzero(x | y)
        if sim >= SIMILARITY and v - u + 1 >= MIN_SHINGLES:
            out.append((p, q, u, v, sim))
            continue
        gaps = run[1:] - run[:-1]
        if len(gaps) and gaps.max() > 1:
            cut = int(gaps.argmax()) + 1
            todo += [run[:cut], run[cut:]]
        else:
            out += [(p + s, p + e, c, d, sim) for s, e, c, d, sim in _exact_runs(mine[p : q + 1], theirs)]
    return out


def passages(sa: np.ndarray, sb: np.ndarray, stretches) -> list[tuple[int, int, int, int, float]]:
    """Verified (first, last in a; first, last in b; similarity), in shingles."""
    out = set()
    for lo, hi, d0, d1 in stretches:
        lo, hi = max(0, lo - MIN_SHINGLES), min(len(sa) - 1, hi + MIN_SHINGLES)
        b0, b1 = max(0, lo + d0 - DRIFT), min(len(sb), hi + d1 + DRIFT + 1)
        if b1 - b0 < MIN_SHINGLES or hi - lo + 1 < MIN_SHINGLES:
            continue
        values, ids = np.unique(np.concatenate((sa[lo : hi + 1], sb[b0:b1])), return_inverse=True)
        mine, theirs, known = ids[: hi - lo + 1], ids[hi - lo + 1 :], np.zeros(len(values), bool)
        known[theirs] = True
        shared = np.flatnonzero(known[mine])
        edges = np.concatenate(([0], np.flatnonzero(shared[1:] - shared[:-1] > GAP) + 1, [len(shared)]))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if j > i and shared[j - 1] - shared[i] + 1 >= MIN_SHINGLES:
                out |= {(lo + p, lo + q, b0 + u, b0 + v, round(sim, 6)) for p, q, u, v, sim in _passage(mine, theirs, shared[i:j], len(values))}
    return sorted(out)


_PASSAGES = "a long, b long, a_start long, a_end long, b_start long, b_end long, similarity double"


def _each(batch, side: str) -> list[np.ndarray]:
    """The sequence of every row's text, made once for each text of the batch."""
    _, first, at = np.unique(batch.column(side).to_numpy(), return_index=True, return_inverse=True)
    made = sequences(batch.column(f"text_{side}").take(pa.array(first)))
    return [made[i] for i in at]


def _verify(batches):
    for b in pieces(pieces(batches, "text_a"), "text_b"):
        rows = []
        sa, sb = _each(b, "a"), _each(b, "b")
        for i, (na, nb, pa_, pb_) in enumerate(zip(*(b.column(c).to_pylist() for c in ("a", "b", "places_a", "places_b")), strict=True)):
            found = candidate_stretches(np.array(pa_, np.int64), np.array(pb_, np.int64))
            rows += [(na, nb, x0, x1 + SHINGLE, y0, y1 + SHINGLE, sim) for x0, x1, y0, y1, sim in passages(sa[i], sb[i], found)]
        names = [x.split()[0] for x in _PASSAGES.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)


def shared_starts(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last starts of the stretches of MIN_SHINGLES whose minima under all hash functions are among the rows.

    Under one function every stretch has one minimum, so a start counts once for each function.
    """
    lo, _, hi = unpack_place(places)
    at, where = np.unique(np.concatenate((lo, hi + 1)), return_inverse=True)
    step = np.bincount(where, np.repeat((1, -1), len(lo)), len(at))
    whole = np.concatenate(([False], np.cumsum(step) > HASHES - 0.5, [False]))
    edges = np.flatnonzero(whole[1:] != whole[:-1])
    return at[edges[::2]], at[edges[1::2]] - 1


def _offsets(column: pa.ListArray) -> np.ndarray:
    """Of the flattened values."""
    return np.concatenate(([0], np.cumsum(np.asarray(column.value_lengths().fill_null(0), np.int64))))


def _windows_of(batch) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of all texts of a batch without repeated rows; a place's high bits are the number of the batch's row."""
    cut = _offsets(batch.column("keys"))
    keys, places = batch.column("keys").flatten().to_numpy(), batch.column("places").flatten().to_numpy()
    places = places + (np.repeat(np.arange(len(cut) - 1), np.diff(cut)) << 43)
    order = np.lexsort((keys, places))
    keys, places = keys[order], places[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])
    return keys[new], places[new]


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values))


def _shared_starts(batches):
    for b in batches:
        _, places = _windows_of(b)
        lo, hi = shared_starts(places)
        owner = lo >> 31
        nodes, owner = np.unique(owner, return_inverse=True)
        yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(nodes)), _lists(lo & _PLACE, owner, len(nodes)), _lists(hi & _PLACE, owner, len(nodes))], ["node", "lo", "hi"])


def _composites(batches):
    for b in batches:
        keys, places = _windows_of(b)
        row = np.repeat(np.arange(b.num_rows), np.diff(_offsets(b.column("lo")))) << 31
        lo, hi = (b.column(c).flatten().to_numpy() + row for c in ("lo", "hi"))
        order = np.argsort(lo, kind="stable")
        key, place, sign = composite_rows(keys, places, lo[order], np.maximum.accumulate(hi[order]))
        yield pa.RecordBatch.from_arrays([pa.array(key), b.column("node").take(pa.array(place >> 43)), pa.array(place & ((1 << 43) - 1)), pa.array(sign)], ["key", "node", "place", "sign"])


def _stretches(batches):
    """(stretch, node, start) of every stretch named by (node, lo, hi, text)."""
    for b in pieces(batches, "text", 1 << 20):
        hashes, nodes, starts = [], [], []
        for node, lo, hi, s in zip(*(b.column(c).to_pylist() for c in ("node", "lo", "hi")), sequences(b.column("text")), strict=True):
            at = np.concatenate([np.arange(x, y + 1) for x, y in zip(lo, hi, strict=True)])
            hashes.append(run_hashes(s, at, MIN_SHINGLES).view(np.int64))
            nodes.append(np.full(len(at), node, np.int64))
            starts.append(at)
        if hashes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, nodes, starts)], ["stretch", "node", "start"])


def _runs(batches):
    """(node, other, s, e, lo, hi): runs of words, from starts that adjoin or overlap in words, and the first and last of
    each row of starts without a gap."""
    for b in batches:
        rows = []
        for node, other, starts in zip(*(b.column(c).to_pylist() for c in ("node", "other", "starts")), strict=True):
            at = np.unique(np.array(starts, np.int64))
            for run in np.split(at, np.flatnonzero(np.diff(at) > MIN_WORDS) + 1):
                cut = np.flatnonzero(np.diff(run) > 1)
                rows.append((node, other, int(run[0]), int(run[-1]) + MIN_WORDS, run[np.concatenate(([0], cut + 1))], run[np.concatenate((cut, [len(run) - 1]))]))
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["node", "other", "s", "e", "lo", "hi"])


def exact_passages(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, other, s, e, lo, hi): the stretches of words that a text repeats exactly with others, and the smallest such
    text; lo and hi bound the starts of stretches of MIN_WORDS words in it.

    shared: (node, lo, hi). The smallest text has rows of itself.
    """
    rows = materialize(shared.join(texts, "node").select("node", "lo", "hi", "text").mapInArrow(_stretches, "stretch long, node long, start long"), "windows-stretches")
    heads = rows.groupBy("stretch").agg(F.min("node").alias("other"), F.max("node").alias("last")).where("other < last").drop("last")
    heads = materialize(heads, "windows-stretch-heads")  # a join of two exchanges, which Spark can split at hot stretches
    runs = rows.join(heads, "stretch").groupBy("node", "other").agg(F.collect_list("start").alias("starts"))
    return runs.mapInArrow(_runs, "node long, other long, s long, e long, lo array<long>, hi array<long>")


def _agree(a: str, b: str):
    """Number of hash functions with equal shared minima in two signatures."""
    same = F.lit(0)
    for k in range(HASHES):
        mask = F.lit(((1 << _FIELD) - 1) << (_FIELD * k))
        x, y = F.col(a).bitwiseAND(mask), F.col(b).bitwiseAND(mask)
        same = same + F.when((x == y) & (x != 0), 1).otherwise(0)
    return same


def _beside_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows with a key beside the fields of their key's head: a (its node), place_a, sign_a and so on."""
    named = [F.col(f"head.{c}").alias("a" if c == "node" else f"{c}_a") for c in heads.schema["head"].dataType.names]
    return rows.join(heads.select("key", *named), "key")


def _pairs(led: DataFrame) -> DataFrame:
    """Rows beside a head paired with it if SUPPORT functions agree: (a, b, places_a, places_b)."""
    pairs = led.where(_agree("sign", "sign_a") >= SUPPORT)
    pairs = pairs.groupBy("a", F.col("node").alias("b")).agg(F.collect_set(F.struct("place_a", "place")).alias("e"))
    return pairs.select("a", "b", F.col("e.place_a").alias("places_a"), F.col("e.place").alias("places_b"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The passages of pairs.

    A text b has few heads and meets its pairs in the bucket of texts. A head a may have any number of pairs: its join is
    one of two exchanges, which Spark can split, and only texts of heads are shuffled for it.
    """
    pairs = materialize(pairs, "windows-pairs")
    heads = materialize(texts.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("node", "text"), "windows-head-texts")
    wide = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(heads.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return wide.select("a", "b", "places_a", "places_b", "text_a", "text_b").mapInArrow(_verify, _PASSAGES)


def _parted(led: DataFrame, components: DataFrame) -> DataFrame:
    """(key, node, place, sign, component) of the rows beside the head of keys where these are of different classes, once for
    each set of further functions with shared minima; the key then stands for the old key and these minima."""
    told = led.select("key", "node", "place", "sign").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = materialize(told, "windows-told")
    mixed = told.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key")
    told = told.join(materialize(mixed, "windows-mixed"), "key")
    sets = []
    for bits in range(1, 1 << HASHES):
        own = [k for k in range(HASHES) if bits >> k & 1 and bits >> (k + 1) % HASHES & 1]
        if bits.bit_count() >= SUPPORT and own:
            masks = [((1 << _FIELD) - 1) << (_FIELD * k) for k in range(HASHES) if bits >> k & 1]
            whole = F.col("key").bitwiseAND(F.lit(7)).isin(own)
            for m in masks:
                whole = whole & (F.col("sign").bitwiseAND(F.lit(m)) != 0)
            sets.append(F.when(whole, F.xxhash64("key", F.lit(bits), F.col("sign").bitwiseAND(F.lit(sum(masks))))))
    return told.select(F.explode(F.array_compact(F.array(*sets))).alias("key"), "node", "place", "sign", "component")


def repeated_passages(docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact passages (node, other, s, e) and verified near passages (_PASSAGES); ends in words (one past the last)."""
    rows = docs.select("text").mapInArrow(_signatures, "key long, salt short, node long, place long").repartition("key", "salt")
    # both branches read the same columns, so that they share one exchange and signatures are made once
    shared = rows.groupBy("key", "salt").agg(F.min("node").alias("n0"), F.max("node").alias("n1"), F.max("place").alias("p")).where("(n0 < n1 OR salt >= 0) AND p >= 0").select("key", "salt")
    kept = rows.join(shared.hint("shuffle_hash"), ["key", "salt"])
    whole = kept.groupBy("node").agg(F.collect_list(F.struct("key", "place")).alias("e")).select("node", F.col("e.key").alias("keys"), F.col("e.place").alias("places"))
    whole = materialize_by(whole, "windows-kept", "node")
    starts = materialize(whole.mapInArrow(_shared_starts, "node long, lo array<long>, hi array<long>"), "windows-shared")

    needed = materialize(nodes.join(whole.select("node"), "node").select(F.col("doc_id").alias("_ax_id")), "windows-needed")
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    found = docs.join(needed, docs["doc_id"].eqNullSafe(F.col("_ax_id")), "left_semi")

    def named(batches):
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(fingerprints(*shingle_runs(b.column("text")))), b.column("text")], ["node", "text"])

    named_texts = found.select("text").mapInArrow(named, "node long, text string")
    # one text a node, also where doc_ids repeat
    texts = materialize_by(named_texts.groupBy("node").agg(F.min("text").alias("text")), "windows-texts", "node")
    exact = materialize(exact_passages(starts, texts), "windows-exact")

    known = exact.where("other <> node").groupBy("node").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))
    windows = whole.join(known, "node", "left").select("node", "keys", "places", "lo", "hi")
    windows = materialize(windows.mapInArrow(_composites, "key long, node long, place long, sign long"), "windows-composites")
    heads = windows.groupBy("key").agg(F.min(F.struct("node", "place", "sign")).alias("head"), F.max("node").alias("last")).where("head.node < last")
    heads = materialize(heads.select("key", "head"), "windows-heads")
    led = materialize(_beside_heads(windows, heads).where(F.col("node") != F.col("a")), "windows-led")
    near = materialize(_verified(_pairs(led), texts), "windows-near")

    linked = connected_components(near.select("a", "b").unionByName(exact.select(F.col("other").alias("a"), F.col("node").alias("b"))))
    parted = materialize(_parted(led, linked), "windows-parted")
    lead = parted.groupBy("key").agg(F.min(F.struct("node", "place", "sign", "component")).alias("head"), F.max("component").alias("c1"), F.min("component").alias("c0")).where("c0 < c1")
    lead = materialize(lead, "windows-lead")
    more = _verified(_pairs(_beside_heads(parted, lead).where(F.col("component") != F.col("component_a"))), texts)
    return exact.select("node", "other", "s", "e"), near.unionByName(materialize(more, "windows-more"))


def passage_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, words, component_id, links, spans, repeated_words), one row a document.

    links counts the other texts of the class, by their fingerprints (copies of one text are one); spans are stretches of words that occur in other
    documents, merged; a text with copies is one span.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    members = materialize(docs.mapInArrow(_members, f"doc_id {kind}, shingles long, node long"), "windows-members")
    nodes = materialize(members.where(F.col("shingles") >= MIN_SHINGLES).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("shingles").alias("shingles"), F.count("*").alias("copies")), "windows-nodes")
    exact, found = repeated_passages(docs, nodes)
    comps = connected_components(found.select("a", "b").unionByName(exact.select(F.col("other").alias("a"), F.col("node").alias("b"))))
    both = found.select(F.col("a").alias("node"), F.col("b").alias("other"), F.col("a_start").alias("s"), F.col("a_end").alias("e")).unionByName(
        found.select(F.col("b").alias("node"), F.col("a").alias("other"), F.col("b_start").alias("s"), F.col("b_end").alias("e"))).unionByName(exact)
    seen = W.partitionBy("node").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    starts = both.select("node", "s", "e").distinct().withColumn("new", (F.col("s") > F.coalesce(F.max("e").over(seen), F.lit(-1))).cast("int"))
    runs = starts.withColumn("run", F.sum("new").over(W.partitionBy("node").orderBy("s", "e").rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy("node", "run").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"))
    spans = spans.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("spans"))
    told = nodes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = told.groupBy("component").agg(F.min("doc_id").alias("component_id"), (F.count("*") - 1).alias("links"))
    told = told.join(smallest, "component").join(spans, "node", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start_word"), (F.col("shingles") + SHINGLE - 1).alias("end_word")))
    told = told.select("node", "component_id", "links", F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType))).alias("spans"))
    out = members.withColumn("node", F.when(F.col("shingles") >= MIN_SHINGLES, F.col("node"))).join(told, "node", "left")
    empty = F.array().cast(spans.schema["spans"].dataType)
    out = out.select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("spans", empty).alias("spans"))
    return out.withColumn("repeated_words", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end_word"] - s["start_word"]))


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their stretches of 50 words or more that other documents repeat, and their class."""
    return passage_classes(table(spark, sf_dir, "documents"))
