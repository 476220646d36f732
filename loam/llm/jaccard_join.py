"""Exact similarity join of documents by the Jaccard index of their word shingles.

One scan, then only packed arrays of token hashes move:

1. Scan. Tasks hash the shingles of their documents and send (token, document) arrays by token.
2. Where all occurrences of a token meet, its document frequency is known. Tokens that only one document has
   can't be shared, and go no further; the others return, with their frequency, to where their documents' arrays came from.
3. A document that has less than t*n shareable tokens is similar to nothing. Of the others, the shareable
   sets are kept: all that indexing and verification need.
4. Token-combination prefixes. The global order is: unshared tokens, then the others by rising frequency. Two
   similar sets share at least k tokens among the first n - ceil(t*n) + k of each. A document
   is indexed under every rare token of that extended prefix on its own, and under pairs of its frequent tokens.
   Frequent tokens are dealt into k - 1 groups by hash, so that k shared ones put two into one group:
   only pairs within a group are indexed, a number linear in the size of the set. k grows with the size class (a power
   of two) of the larger set; a document that may meet sets of the next class is indexed for that one too.
   So any similar pair meets under a shared rare token, or else under a pair of frequent ones.
5. A pair meets under many keys, but is a candidate only under the first one that both sets have, by hash. Each entry carries the ``LEAST`` first of its set's keys,
   so most repeats are known where they meet; the rest meet again when pairs are made distinct. A key whose own pairs are very many is cut into jobs for pairs of parts of its list.
6. Candidates are verified on their whole sets in blocks. A set's label is the least name among it and its candidates, and a
   pair's block both labels: near copies of one original share a label, so their sets go to one block, not to
   one per pair. Blocks of many sets or pairs are cut into a grid by both sides.
7. Where only groups are asked for (``similar_groups``), long lists aren't expanded into pairs: their members meet the lists' heads, and then,
   in families of connected lists, all sets that aren't in their group yet.

Documents with equal sets form one class, which is indexed and verified once; a class's links count with
the number of its documents. Tokens are 48-bit hashes: a collision within a pair of sets, which would
change its count by one, has odds below 1e-8. Keys are 48-bit hashes too: that two different first ones look alike, which
may lose a pair, has odds below 1e-13 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, distinct_sorted, freed, mix64, partitions, planes, release, table, text_rows, unplanes, with_ids, without_ids, word_hashes
from .graph import components

PERCENT = 70
FREQUENT = 32  # documents from which on a token counts as frequent
ID_BITS = 48
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
LEAST = 4  # first keys that an entry carries
_HOT_BLOCK = 250_000  # pairs of a block's cell, about
_BLOCK_BYTES = 32 << 20  # of the sets of a block's cell on one side
_HOT_KEY = 4_000_000  # pairs of one key that a task enumerates
_PART = 2_048  # members of a part of such a key's list
_LONG = 64  # members from which on a key's list is only linked to its heads at first, where groups are asked for
_HEADS = 4  # members of such a list that the others are compared with
_FAMILY_BYTES = 8 << 20  # of the sets of a part of a family
_HOT_TOKEN = 32  # documents of a flush from which on a token's owners stay with the flush


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the runs of ``width`` words; of fewer words, of the whole sequence."""
    if not text:
        return np.empty(0, np.uint64)
    w, _, _ = word_hashes(text)
    if not len(w):
        return np.empty(0, np.uint64)
    if len(w) < width:
        h = np.full(1, len(w), np.uint64)
        for x in w:
            h = mix64(h * _A + x)
        return h >> np.uint64(64 - ID_BITS)
    h = w[: len(w) - width + 1] * _A
    for i, m in zip(range(1, width), (_B, _C, _A ^ _B, _B ^ _C)):
        h = h + w[i : len(w) - width + 1 + i] * m
        h = h ^ (h >> np.uint64(29))
    return distinct_sorted(mix64(h) >> np.uint64(64 - ID_BITS))


def class_of(s: np.ndarray) -> int:
    """A 63-bit name of a set, from a sum over its mixed tokens and its size."""
    a = mix64(s * _B + _C).sum(dtype=np.uint64, keepdims=True)
    return int(mix64(a + np.full(1, len(s), np.uint64) * _A)[0] >> np.uint64(1))


def least_shared(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def size_class(n: int) -> int:
    return n.bit_length() - 1


def shared_needed(c: int, percent: int) -> int:
    """k of a size class: 1 for single tokens, else one more than its number of groups."""
    k = 1 if c == 0 else 1 + max(1, (1 << c) >> 4)
    return max(1, min(k, least_shared(1 << c, percent)))


def signatures(n: int, tokens: np.ndarray, df: np.ndarray, percent: int = PERCENT, frequent: int = FREQUENT) -> np.ndarray:
    """Index keys of a set of n tokens, in order.

    tokens, df: its shareable tokens in the global order; the n - len(tokens) others come before them.
    """
    own = size_class(n)
    levels = [own] + ([own + 1] if 100 * n >= percent * (2 << own) else [])
    spare = n - least_shared(n, percent) - (n - len(tokens))
    lengths = [max(0, min(len(tokens), spare + shared_needed(c, percent))) for c in levels]
    n_rare = int(np.searchsorted(df, frequent))
    singles = tokens[: min(n_rare, max(lengths))]
    out = [singles]
    for c, length in zip(levels, lengths):
        tail = tokens[n_rare:length]
        k = shared_needed(c, percent)
        if k == 1:
            out.append(tail)
            continue
        if len(tail) < 2:
            continue
        group = (tail * _C >> np.uint64(40)) % np.uint64(k - 1)
        order = np.lexsort((tail, group))
        tail, group = tail[order], group[order]
        for step in range(1, len(tail)):
            same = group[step:] == group[:-step]
            if not same.any():
                break
            u, v = tail[:-step][same], tail[step:][same]
            out.append(mix64(u * _A + v * _B + np.uint64(c)) >> np.uint64(64 - ID_BITS))
    return distinct_sorted(np.concatenate(out))


def first_keys(keys: np.ndarray) -> np.ndarray:
    """The ``LEAST`` least of a set's keys in order, filled up with 0."""
    out = np.zeros(LEAST, np.uint64)
    out[: min(LEAST, len(keys))] = keys[:LEAST]
    return out


TOKENS, MEMBERS, OWNERS, COUNTS = 0, 3, 2, 1  # rows of a flush go in falling order
_FLUSH = 1_000_000  # tokens, or
_FLUSH_DOCS = 30_000  # documents that a task gathers before it sends
_ROW = "g int, f long, kind byte, blob binary"


def _rows(rows):
    for at in range(0, len(rows), 32):
        part = rows[at : at + 32]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int8(), pa.binary()))], ["g", "f", "kind", "blob"])


def _bits(n: int) -> int:
    """Bits of a token that choose its group: at least four groups per task."""
    return max(8, (4 * n - 1).bit_length())


def _groups(tokens: np.ndarray, low: int, bits: int):
    """(g, slice) of each group that sorted tokens have."""
    cuts = np.searchsorted(tokens, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(low))
    for g in np.flatnonzero(np.diff(cuts)):
        yield int(g), slice(cuts[g], cuts[g + 1])


def _packed(tokens: np.ndarray, low: int) -> bytes:
    """Differences of the sorted tokens of one group."""
    return planes(np.diff(tokens & np.uint64((1 << low) - 1), prepend=np.uint64(0)), 5)


def _unpacked(raw: bytes, g: int, low: int) -> np.ndarray:
    return np.cumsum(unplanes(raw, 5), dtype=np.uint64) + (np.uint64(g) << np.uint64(low))


def _scan(batches, width: int, bits: int):
    """Per flush f: token rows of every group g, and one row of members (null, doc_id, class, n, number in f).

    Of a token that many sets of the flush have, the group only gets their number; one row keeps the owners for the flush.
    """
    low = ID_BITS - bits
    task = TaskContext.get().partitionId()
    flushes = 0

    def flush(sets, members):
        f = task << 24 | flushes
        rows = [(f % (1 << bits), f, MEMBERS, np.array(members, np.int64).tobytes())]
        if sets:
            tokens = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint64), [len(x) for x in sets])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            count = np.diff(np.append(start, len(tokens)))
            many = count >= _HOT_TOKEN
            if many.any():
                hot, times, inside = tokens[start[many]], count[many].astype(np.uint64), np.repeat(many, count)
                rows.append((rows[0][0], f, OWNERS, np.array([len(hot)], np.int64).tobytes() + planes(hot, 6) + planes(times, 4) + planes(owner[inside], 2)))
                for g, at in _groups(hot, low, bits):
                    rows.append((g, f, COUNTS, _packed(hot[at], low) + planes(times[at], 4)))
                tokens, owner = tokens[~inside], owner[~inside]
            for g, at in _groups(tokens, low, bits):
                rows.append((g, f, TOKENS, _packed(tokens[at], low) + planes(owner[at], 2)))
        yield from _rows(rows)

    sets, members, size, number = [], [], 0, {}
    for ids, texts in text_rows(batches):
        for i, t in zip(ids, texts):
            s = shingles(t, width)
            name = class_of(s) if len(s) else 0
            if len(s) and name not in number:
                number[name] = len(sets)
                sets.append(s)
                size += len(s)
            members.append((i is None, i or 0, name, len(s), number.get(name, -1)))
        if size > _FLUSH or len(members) > _FLUSH_DOCS:
            yield from flush(sets, members)
            flushes += 1
            sets, members, size, number = [], [], 0, {}
    if members:
        yield from flush(sets, members)
        sets, members = [], []
    release()


def _frequencies(batches, bits: int):
    """Of rows in order of g: members and owners pass; tokens in two or more sets go back to their flush, with their frequency."""
    low = ID_BITS - bits

    def solve(g, held):
        tokens, owner, times, flush = [], [], [], []
        for i, (_, kind, raw) in enumerate(held):
            width = 2 if kind == TOKENS else 4
            n = len(raw) // (5 + width)
            tokens.append(_unpacked(raw[: 5 * n], g, low))
            rest = unplanes(raw[5 * n :], width)
            owner.append(rest)
            times.append(np.ones(n, np.int64) if kind == TOKENS else rest.astype(np.int64))
            flush.append(np.full(n, i, np.int64))
        tokens, owner, times, flush = np.concatenate(tokens), np.concatenate(owner), np.concatenate(times), np.concatenate(flush)
        order = np.argsort(tokens, kind="stable")
        tokens, owner, times, flush = tokens[order], owner[order], times[order], flush[order]
        start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        df = np.repeat(np.add.reduceat(times, start), np.diff(np.append(start, len(tokens))))
        keep = df > 1
        tokens, owner, flush, df = tokens[keep], owner[keep], flush[keep], np.minimum(df[keep], 65535).astype(np.uint64)
        order = np.argsort(flush, kind="stable")
        tokens, owner, flush, df = tokens[order], owner[order], flush[order], df[order]
        cuts = np.searchsorted(flush, np.arange(len(held) + 1))
        rows = []
        for i in np.flatnonzero(np.diff(cuts)):
            at, (f, kind, _) = slice(cuts[i], cuts[i + 1]), held[i]
            rows.append((g, f, kind, _packed(tokens[at], low) + (planes(owner[at], 2) if kind == TOKENS else b"") + planes(df[at], 2)))
        yield from _rows(rows)

    now, held = None, []
    for batch in batches:
        for g, f, kind, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if g != now and held:
                yield from solve(now, held)
                held = []
            now = g
            if kind in (MEMBERS, OWNERS):
                yield from _rows([(g, f, kind, raw)])
            else:
                held.append((f, kind, raw))
    if held:
        yield from solve(now, held)
    release()


_SETS = "doc_id long, cls long, n long, whole binary"


def _sets(batches, percent: int, bits: int):
    """Of rows in order of f, members first: one row per member, with its shareable set if that is large enough to be similar to another.

    Of the members of one class only the first has the set. whole: tokens in the global order, then frequencies.
    """
    low = ID_BITS - bits

    def solve(members, blobs):
        rows = []
        sets = {}
        if blobs:
            tokens, owner, df, hot, hot_df = [], [], [], [], []
            for g, kind, raw in blobs:
                if kind == TOKENS:
                    k = len(raw) // 9
                    tokens.append(_unpacked(raw[: 5 * k], g, low))
                    owner.append(unplanes(raw[5 * k : 7 * k], 2))
                    df.append(unplanes(raw[7 * k :], 2))
                elif kind == COUNTS:
                    k = len(raw) // 7
                    hot.append(_unpacked(raw[: 5 * k], g, low))
                    hot_df.append(unplanes(raw[5 * k :], 2))
            for _, kind, raw in blobs:
                if kind == OWNERS:
                    k = int(np.frombuffer(raw, np.int64, 1)[0])
                    names, times = unplanes(raw[8 : 8 + 6 * k], 6), unplanes(raw[8 + 6 * k : 8 + 10 * k], 4).astype(np.int64)
                    known, counts = np.concatenate(hot), np.concatenate(hot_df)
                    order = np.argsort(known)
                    tokens.append(np.repeat(names, times))
                    owner.append(unplanes(raw[8 + 10 * k :], 2))
                    df.append(np.repeat(counts[order][np.searchsorted(known[order], names)], times))
            if not tokens:
                tokens, owner, df = ([np.empty(0, np.uint64)] for _ in range(3))
            tokens, owner, df = np.concatenate(tokens), np.concatenate(owner).astype(np.int64), np.concatenate(df)
            count = np.bincount(owner)
            size = np.zeros(len(count), np.int64)
            for m in members:
                if 0 <= m[4] < len(size):
                    size[m[4]] = m[3]
            enough = count * 100 >= percent * size
            keep = enough[owner]
            tokens, owner, df = tokens[keep], owner[keep], df[keep]
            order = np.lexsort((tokens, df, owner))
            tokens, owner, df = tokens[order], owner[order], df[order]
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else []
            for a, b in zip(start, np.append(start[1:], len(owner))):
                sets[int(owner[a])] = planes(tokens[a:b], 6) + planes(df[a:b], 2)
        for null, i, name, n, number in members.tolist():
            rows.append((None if null else i, name, n, sets.pop(number, None)))
        for at in range(0, len(rows), 1024):
            part = rows[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "cls", "n", "whole"])

    now, members, blobs = None, np.empty((0, 5), np.int64), []
    for batch in batches:
        for g, f, kind, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if f != now and now is not None:
                yield from solve(members, blobs)
                members, blobs = np.empty((0, 5), np.int64), []
            now = f
            if kind == MEMBERS:
                members = np.frombuffer(raw, np.int64).reshape(-1, 5)
            else:
                blobs.append((g, kind, raw))
    if now is not None:
        yield from solve(members, blobs)
    release()


def unpack(whole: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = len(whole) // 8
    return unplanes(whole[: 6 * k], 6), unplanes(whole[6 * k :], 2)


def _index(batches, percent: int, frequent: int, n: int):
    """(p, blob) rows: for every partition of keys the sets' entries."""

    def blob(entries: list[tuple[int, int, np.ndarray]]):
        keys = np.concatenate([e[2] for e in entries])
        owner = np.repeat(np.arange(len(entries)), [len(e[2]) for e in entries])
        where = (keys * _A >> np.uint64(33)) % np.uint64(n)
        order = np.argsort(where, kind="stable")
        keys, owner, where = keys[order], owner[order], where[order]
        names = np.array([e[0] for e in entries], np.uint64)
        sizes = np.array([e[1] for e in entries], np.uint64)
        firsts = np.stack([first_keys(e[2]) for e in entries])
        cuts = np.searchsorted(where, np.arange(n + 1))
        ps, blobs = [], []
        for p in np.flatnonzero(np.diff(cuts)):
            o = owner[cuts[p] : cuts[p + 1]]
            starts = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
            d = o[starts]
            counts = np.diff(np.append(starts, len(o))).astype(np.uint64)
            head = np.array([len(d), len(o)], np.uint64).tobytes()
            ps.append(int(p))
            blobs.append(head + planes(names[d], 8) + planes(sizes[d], 4) + planes(counts, 4) + planes(firsts[d].ravel(), 6) + planes(keys[cuts[p] : cuts[p + 1]], 6))
        for at in range(0, len(ps), 32):
            yield pa.RecordBatch.from_arrays([pa.array(ps[at : at + 32], pa.int32()), pa.array(blobs[at : at + 32], pa.binary())], ["p", "blob"])

    entries, size = [], 0
    for batch in batches:
        for name, m, whole in zip(*(batch.column(i).to_pylist() for i in range(3))):
            keys = signatures(m, *unpack(whole), percent, frequent)
            entries.append((name, m, keys))
            size += len(keys)
            if size > 2_000_000:
                yield from blob(entries)
                entries, size = [], 0
    if size:
        yield from blob(entries)
    release()


def _apart(x: np.ndarray, y: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of pairs with first keys x and y that share the key ``place``: whether they share no earlier one."""
    ok = np.ones(len(x), bool)
    for i in range(LEAST):
        mine = x[:, i]
        low = (mine > 0) & (mine < place)
        for j in range(LEAST):
            ok &= ~(low & (mine == y[:, j]))
    return ok


def _alike(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(na, nb) * 100 >= percent * np.maximum(na, nb)


def _kinds(first: np.ndarray, place: int) -> tuple[list[np.ndarray], list[int]]:
    """Members of a key's list by what earlier first keys they have in common with others: (members, bits) of each kind."""
    early = np.where((first > 0) & (first < place), first, 0)
    values, back, counts = np.unique(early, return_inverse=True, return_counts=True)
    back = back.reshape(early.shape)
    bit = np.full(len(values), -1)
    known = np.flatnonzero((counts > 1) & (values > 0))
    bit[known] = np.arange(len(known))
    row = np.sort(bit[back], axis=1)
    kinds, member = np.unique(row, axis=0, return_inverse=True)
    order = np.argsort(member.ravel(), kind="stable")
    cuts = np.searchsorted(member.ravel()[order], np.arange(len(kinds) + 1))
    return [order[cuts[i] : cuts[i + 1]] for i in range(len(kinds))], [sum(1 << int(b) for b in k if b >= 0) for k in kinds]


def _list_pairs(first: np.ndarray, place: int):
    """(i, j) arrays, i before j in the list, of the members of one key that share no earlier key; and how many in all.

    Kinds of members that share an earlier first key are passed over as a whole.
    """
    members, bits = _kinds(first, place)
    whole = [(i, j) for i in range(len(bits)) for j in range(i, len(bits)) if not bits[i] & bits[j]]
    return members, whole, sum(len(members[i]) * len(members[j]) if i != j else len(members[i]) * (len(members[i]) - 1) // 2 for i, j in whole)


def _blocks(x: np.ndarray, y: np.ndarray, same: bool, most: int = 1_000_000):
    """All pairs of x and y (or within x), in arrays of bounded length."""
    if same:
        for at in range(0, len(x) - 1, max(1, most // len(x))):
            i = np.arange(at, min(at + max(1, most // len(x)), len(x) - 1))
            many = len(x) - 1 - i
            a = np.repeat(i, many)
            yield x[a], x[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + a + 1]
        return
    for at in range(0, len(x), max(1, most // len(y))):
        part = x[at : at + max(1, most // len(y))]
        yield np.repeat(part, len(y)), np.tile(y, len(part))


def _stars(size: np.ndarray, percent: int):
    """Pairs of a list's heads, the first of their size, with the members of like size: as many as members, times ``_HEADS``."""
    rest = np.arange(len(size))
    while len(rest) > 1:
        like = _alike(size[rest], size[rest[0]], percent)
        near = rest[like]
        for i in range(min(_HEADS, len(near) - 1)):
            yield np.full(len(near) - 1 - i, near[i]), near[i + 1 :]
        rest = rest[~like]


def _candidates(key: np.ndarray, doc: np.ndarray, size: np.ndarray, first: np.ndarray, percent: int, long: int | None = None):
    """Pairs of documents (a, b) that share a key and no earlier first one; of too large keys, (its members, the key).

    key, doc: entries in order of (key, doc) without repeats. Sizes too far apart are dropped.
    long: of lists from that length on only pairs with heads, and (its members, ``LATER``).
    """
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    length = np.diff(start)
    place = key[start[:-1]]
    for m in np.unique(length):
        if m < 2:
            continue
        which = np.flatnonzero(length == m)
        if m <= 16 and (long is None or m < long):
            for at in range(0, len(which), 100_000):
                w = which[at : at + 100_000]
                r = start[w]
                for i in range(m - 1):
                    for j in range(i + 1, m):
                        a, b = doc[r + i], doc[r + j]
                        ok = np.flatnonzero(_alike(size[a], size[b], percent))
                        ok = ok[_apart(first[a[ok]], first[b[ok]], place[w[ok]])]
                        yield a[ok], b[ok], None
        else:
            for w in which:
                list_ = doc[start[w] : start[w] + m]
                if long is not None and m >= long:
                    for i, j in _stars(size[list_], percent):
                        a, b = list_[i], list_[j]
                        ok = np.flatnonzero(_apart(first[a], first[b], place[w]) & _alike(size[a], size[b], percent))
                        yield a[ok], b[ok], None
                    yield list_, None, LATER
                    continue
                members, whole, many = _list_pairs(first[list_], int(place[w]))
                if many > _HOT_KEY:
                    yield list_, None, int(place[w])
                    continue
                for i, j in whole:
                    for a, b in _blocks(list_[members[i]], list_[members[j]], i == j):
                        ok = _alike(size[a], size[b], percent)
                        yield np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok]), None


LATER = -1  # instead of a job's part: names of the members of long lists, and of the least that lists connect each with
_MET = "a long, b long, na int, nb int, i int, j int, job binary"


def _met_rows(a, b, na, nb):
    for at in range(0, len(a), 100_000):
        part = slice(at, at + 100_000)
        no, n = pa.nulls(len(a[part]), pa.int32()), len(a[part])
        yield pa.RecordBatch.from_arrays([pa.array(a[part].astype(np.int64)), pa.array(b[part].astype(np.int64)), pa.array(na[part].astype(np.int32)), pa.array(nb[part].astype(np.int32)), no, no, pa.nulls(n, pa.binary())], ["a", "b", "na", "nb", "i", "j", "job"])


def _job(i: int, j: int | None, raw: bytes) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, None, i, j, raw), types)], ["a", "b", "na", "nb", "i", "j", "job"])


def _roots(root: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        x, before = root[x], x
        if np.array_equal(x, before):
            return x


def _meet(batches, percent: int, long: int | None = None):
    """Of rows in order of p: the entries of one p are joined to candidate pairs (a, b, their sizes), or to jobs for pairs of parts."""

    def solve(blobs):
        cls, size, first, owner, key = [], [], [], [], []
        docs = 0
        for raw in blobs:
            d, e = (int(x) for x in np.frombuffer(raw, np.uint64, 2))
            at = 16
            got = []
            for w, k in ((8, d), (4, d), (4, d), (6, LEAST * d), (6, e)):
                got.append(unplanes(raw[at : at + w * k], w))
                at += w * k
            cls.append(got[0])
            size.append(got[1])
            first.append(got[3].reshape(-1, LEAST))
            owner.append(np.repeat(np.arange(docs, docs + d), got[2].astype(np.int64)))
            key.append(got[4])
            docs += d
        cls, size, first = np.concatenate(cls), np.concatenate(size).astype(np.int64), np.concatenate(first)
        owner, key = np.concatenate(owner), np.concatenate(key)
        u, at, back = np.unique(cls, return_index=True, return_inverse=True)
        doc = back[owner]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        key, doc = key[new], doc[new]
        size, first = size[at], first[at]
        held, count, root, late = [], 0, np.arange(len(u)), np.zeros(len(u), bool)

        def flush():
            both = np.unique(np.concatenate(held))
            a, b = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
            return _met_rows(u[a], u[b], size[a], size[b])

        for a, b, hot in _candidates(key, doc, size, first, percent, long):
            if hot == LATER:
                late[a] = True
                ends = _roots(root, a)
                root[ends] = ends.min()
            elif hot is not None:
                parts = [a[k : k + _PART] for k in range(0, len(a), _PART)]
                packed = [np.array([hot, len(x)], np.uint64).tobytes() + planes(u[x], 8) + planes(size[x].astype(np.uint64), 4) + planes(first[x].ravel(), 6) for x in parts]
                for i in range(len(parts)):
                    for j in range(i, len(parts)):
                        yield _job(i, j, packed[i] + (packed[j] if i < j else b""))
            elif len(a):
                held.append(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
                count += len(a)
                if count > 3_000_000:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()
        late = np.flatnonzero(late)
        for k in range(0, len(late), 100_000):
            part = late[k : k + 100_000]
            yield _job(LATER, None, np.concatenate((u[part], u[_roots(root, part)])).tobytes())

    now, blobs = None, []
    for batch in batches:
        for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if p != now and blobs:
                yield from solve(blobs)
                blobs = []
            now = p
            blobs.append(raw)
    if blobs:
        yield from solve(blobs)
    release()


def _work(batches, percent: int):
    """Jobs of too large keys: the candidate pairs of two parts of a key's list."""
    for batch in batches:
        for i, j, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
            parts, at = [], 0
            while at < len(raw):
                place, n = (int(x) for x in np.frombuffer(raw, np.uint64, 2, at))
                at += 16
                got = []
                for w, k in ((8, n), (4, n), (6, LEAST * n)):
                    got.append(unplanes(raw[at : at + w * k], w))
                    at += w * k
                parts.append((got[0], got[1].astype(np.int64), got[2].reshape(-1, LEAST)))
            own = len(parts[0][0])
            name, size, first = (np.concatenate([p[k] for p in parts]) for k in range(3))
            members, whole, _ = _list_pairs(first, place)
            for k, m in whole:
                for a, b in _blocks(members[k], members[m], k == m):
                    ok = _alike(size[a], size[b], percent)
                    if i < j:  # pairs within one part are another job's
                        ok &= (a < own) != (b < own)
                    a, b = a[ok], b[ok]
                    swap = name[a] > name[b]
                    a, b = np.where(swap, b, a), np.where(swap, a, b)
                    yield from _met_rows(name[a], name[b], size[a], size[b])
    release()


def _verify(batches, percent: int):
    """Of rows in order of (block, kind): sets first, then the pairs to check."""
    now, sets = None, {}
    for batch in batches:
        a_out, b_out = [], []
        rows = batch.to_pydict()
        for block, i, j, kind, a, b, raw in zip(rows["block"], rows["i"], rows["j"], rows["kind"], rows["a"], rows["b"], rows["whole"]):
            if (block, i, j) != now:
                now, sets = (block, i, j), {}
            if kind == 0:
                sets[a] = (b, np.sort(unpack(raw)[0]))
                continue
            (nx, x), (ny, y) = sets[a], sets[b]
            if len(x) > len(y):
                x, y = y, x
            if not len(x):
                continue
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            if 100 * both >= percent * (nx + ny - both):
                a_out.append(a)
                b_out.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])


def _merge(batches, percent: int):
    """Of rows in order of (family, i, j): the pairs of labels (a, b) of which similar sets are in the parts i and j of a family."""

    def solve(i, j, held):
        part, n, label, sets = (np.array([r[k] for r in held], np.int64) if k < 3 else [unpack(r[k])[0] for r in held] for k in range(4))
        values, back, counts = np.unique(label, return_inverse=True, return_counts=True)
        if len(values) < 2:
            return
        start = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), np.diff(start))[np.argsort(token, kind="stable")]
        begin = np.concatenate(([0], np.cumsum(np.bincount(token))))
        found = []
        # of two labels, one isn't the most frequent: its members look for others
        for x in np.flatnonzero(back != np.argmax(counts)):
            t = token[start[x] : start[x + 1]]
            many = begin[t + 1] - begin[t]
            at = np.arange(many.sum()) + np.repeat(begin[t] - np.cumsum(many) + many, many)
            both = np.bincount(owner[at], minlength=len(sets))
            ok = (100 * both >= percent * (n + n[x] - both)) & (label != label[x]) & (both > 0)
            if i < j:  # pairs within one part are another block's
                ok &= part != part[x]
            found += [(min(label[x], y), max(label[x], y)) for y in np.unique(label[ok])]
        found = sorted(set(found))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])

    now, held = None, []
    for batch in batches:
        for family, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (family, i, j) != now and held:
                yield from solve(*now[1:], held)
                held = []
            now = (family, i, j)
            held.append(row)
    if held:
        yield from solve(*now[1:], held)
    release()


def _kept(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(members, sets): members has doc_id, cls, n_shingles of every row; sets the shareable sets that may be similar to another."""
    n = partitions(docs)
    bits = _bits(n)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _scan(b, width, bits), _ROW)
    rows = rows.repartition(n, "g").sortWithinPartitions("g").mapInArrow(lambda b: _frequencies(b, bits), _ROW)
    found = checkpointed(rows.repartition(n, "f").sortWithinPartitions("f", F.desc("kind")).mapInArrow(lambda b: _sets(b, percent, bits), _SETS))
    del rows
    freed(docs.sparkSession)
    # a class may come from several flushes, with the same set
    return found.select("doc_id", "cls", F.col("n").alias("n_shingles")), found.where("whole is not null").select("cls", "n", "whole")


def _met(sets: DataFrame, percent: int, frequent: int, long: int | None = None) -> DataFrame:
    n = partitions(sets)
    index = sets.mapInArrow(lambda b: _index(b, percent, frequent, n), "p int, blob binary")
    met = checkpointed(index.repartition(n, "p").sortWithinPartitions("p").mapInArrow(lambda b: _meet(b, percent, long), _MET).distinct())
    del index
    freed(sets.sparkSession)
    return met


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidates (a, b) whose sets are similar."""
    n = partitions(sets)
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    named = pairs.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    named = named.select("a", "b", "na", "nb", F.xxhash64(F.least("la", "lb"), F.greatest("la", "lb")).alias("block"))
    # a block with many pairs or large sets is cut into a grid by both sides
    sides = named.select("block", F.col("a").alias("cls"), F.col("na").alias("n")).union(named.select("block", F.col("b").alias("cls"), F.col("nb").alias("n")))
    weight = sides.groupBy("block", "cls").agg(F.max("n").alias("n"), F.count("*").alias("c")).groupBy("block").agg(F.sum(8 * F.col("n")).alias("bytes"), (F.sum("c") / 2).alias("c"))
    side = F.ceil(F.greatest(F.sqrt(F.col("c") / _HOT_BLOCK), F.col("bytes") / _BLOCK_BYTES))
    hot = weight.where((F.col("c") > _HOT_BLOCK) | (F.col("bytes") > _BLOCK_BYTES)).select(F.col("block").alias("hot"), side.alias("side"))
    side = F.coalesce(F.col("side"), F.lit(1))
    placed = named.join(hot, F.col("block") == F.col("hot"), "left").select("a", "b", "block", F.pmod(F.xxhash64("a"), side).cast("int").alias("i"), F.pmod(F.xxhash64("b"), side).cast("int").alias("j"))
    placed = checkpointed(placed)
    needed = placed.select("block", "i", "j", F.col("a").alias("cls")).union(placed.select("block", "i", "j", F.col("b").alias("cls"))).distinct()
    paired = with_ids(sets, labels.select(F.col("node").alias("cls")), "cls")
    no = F.lit(None)
    rows = needed.join(paired, "cls").select("block", "i", "j", F.lit(0).alias("kind"), F.col("cls").alias("a"), F.col("n").alias("b"), "whole")
    rows = rows.unionByName(placed.select("block", "i", "j", F.lit(1).alias("kind"), "a", "b", no.cast("binary").alias("whole")))
    links = rows.repartition(n, "block", "i", "j").sortWithinPartitions("block", "i", "j", "kind").mapInArrow(lambda b: _verify(b, percent), "a long, b long")
    return checkpointed(links)


def similar_classes(docs: DataFrame, percent: int = PERCENT, width: int = 3, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has doc_id, cls, n_shingles of every row; links has the pairs (a, b) of similar classes."""
    members, sets = _kept(docs, percent, width)
    met = _met(sets, percent, frequent)
    pairs = met.where("job is null").select("a", "b", "na", "nb")
    jobs = met.where("job is not null").select("i", "j", "job")
    if not jobs.isEmpty():
        pairs = checkpointed(pairs.union(jobs.repartition(partitions(docs)).mapInArrow(lambda b: _work(b, percent), _MET).select("a", "b", "na", "nb")).distinct())
    return members, _links(pairs, sets, percent)


def similar_groups(docs: DataFrame, percent: int = PERCENT, width: int = 3, frequent: int = FREQUENT, long: int = _LONG) -> tuple[DataFrame, DataFrame]:
    """(members, groups): members as of ``similar_classes``; groups has node, component of classes, those that links connect.

    A group of m near copies has some m*m/2 links, but fewer connect it. So members of long lists are compared with their lists' heads
    first. Those whose lists connect them are a family; in it, each member is then compared with all that aren't in its group yet.
    """

    def connected(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                a, b = np.frombuffer(raw, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["cls", "head"])

    n = partitions(docs)
    members, sets = _kept(docs, percent, width)
    met = _met(sets, percent, frequent, long)
    groups = components(_links(met.where("job is null").select("a", "b", "na", "nb"), sets, percent))
    later = met.where("job is not null").select("job")
    if later.isEmpty():
        return members, groups
    family = components(later.mapInArrow(connected, "cls long, head long"), "cls", "head").select(F.col("node").alias("cls"), F.col("component").alias("family"))
    family = checkpointed(family.join(groups, F.col("cls") == F.col("node"), "left").select("cls", "family", F.coalesce("component", "cls").alias("label")))
    paired = with_ids(sets, family, "cls").dropDuplicates(["cls"]).join(family, "cls")
    # large families are cut into parts, and each pair of parts is a block
    open_ = paired.groupBy("family").agg(F.ceil(F.sum(F.length("whole")) / _FAMILY_BYTES).alias("side"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    rows = paired.join(open_.select("family", "side"), "family").withColumn("part", F.pmod(F.xxhash64("cls"), "side"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1))).select("family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "n", "label", "whole")
    merged = rows.repartition(n, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(lambda b: _merge(b, percent), "a long, b long")
    merged = components(merged).select(F.col("node").alias("component"), F.col("component").alias("into"))
    every = groups.union(family.where("cls = label").select("cls", "label")).distinct()
    return members, every.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))


def similar_documents(docs: DataFrame, percent: int = PERCENT, width: int = 3, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_similar, component_id.

    Documents without words (null, empty, blank) are linked with nothing. Rows with equal sets are
    linked with each other. Repeated ids are separate rows; a null id takes part in counts, but names no
    component (it stays null unless the group has another id). An empty table gives no rows.
    """
    members, links = similar_classes(docs, percent, width, frequent)
    classes = members.where("n_shingles > 0").groupBy("cls").agg(F.count("*").alias("size"), F.min("doc_id").alias("least"))
    classes = checkpointed(classes)
    both = links.select("a", "b").union(links.select("b", "a"))
    degree = both.join(classes.select(F.col("cls").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("others"))
    named = links.join(classes.select(F.col("cls").alias("a"), F.col("least").alias("la")), "a").join(classes.select(F.col("cls").alias("b"), F.col("least").alias("lb")), "b")
    groups = components(named, "la", "lb")
    facts = classes.join(degree.withColumnRenamed("a", "cls"), "cls", "left").join(groups.select(F.col("node").alias("least"), "component"), "least", "left")
    facts = facts.select("cls", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), F.coalesce("component", "least").alias("component_id"))
    joined = members.where("n_shingles > 0").join(facts, "cls").select("doc_id", "n_shingles", "n_similar", "component_id")
    return joined.unionByName(members.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id")))


SHINGLES_SQL = """
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s FROM w)
"""

ORACLE = f"""
WITH RECURSIVE {SHINGLES_SQL},
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
walk(node, seen) AS (SELECT doc_id, doc_id FROM sets UNION SELECT l.b, k.seen FROM walk k JOIN links l ON l.a = k.node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT count(*) FROM links l WHERE l.a = s.doc_id) AS n_similar,
  (SELECT min(seen) FROM walk k WHERE k.node = s.doc_id) AS component_id
FROM sets s
"""


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without those whose group has a lesser doc_id, all columns kept."""
    members, groups = similar_groups(docs, percent)
    classes = members.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = checkpointed(classes.join(groups, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("component", "cls").alias("component")))
    heads = named.groupBy("component").agg(F.min("least").alias("head"))
    removed = members.where("n_shingles > 0").join(named, "cls").join(heads, "component").where("head < doc_id").select("doc_id")
    return without_ids(docs, checkpointed(removed))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
