"""Exact removal of repeated substrings by bounded interval expansion on a Burrows-Wheeler transform.

A string of `size` bytes that occurs twice is found in four steps.
1. Anchors. Of the K-byte strings within each window of `size` bytes the one of least hash
   is its anchor, so equal windows have equal anchors at equal places. Anchors that occur
   once are of no use.
2. Contexts. For each anchor that repeats, the bytes of the windows that it is the anchor of
   are cut out, so each window is in one context. Equal contexts are merged and counted.
3. Contexts of one anchor meet in one task. A Burrows-Wheeler transform of many anchors'
   contexts is built; starting from the intervals of all 8-byte strings, intervals are
   extended backward, breadth first, by one byte a level. A boundary of suffixes that is
   first met at level l has a common prefix of l bytes. Levels end at `size`: boundaries
   not met by then have a longer common prefix, so their suffixes repeat.
   An anchor with more than MAX_CONTEXTS different contexts is split by the bytes that
   follow and precede it: its windows are taken in blocks of 8 offsets from the anchor, the
   windows of a block share size - 7 bytes, and contexts of a block meet only where these are
   equal. A block that is still too large is split into single windows, of which equal ones
   are one context. So no task takes more than MAX_CONTEXTS contexts of one anchor.
4. Windows found go back to their texts, whose covered bytes are removed.

Everything is keyed by 128 bits of the text, so repeated rows, null ids and ties are plain
copies: a text of `size` bytes or more that has a copy is removed whole. Null counts as
empty; an empty table gives no rows; other columns are kept, those with names of results
replaced. Very long texts are read whole; a long run of one byte has an anchor at each byte,
of which the context is carved once.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, mix, save, slices, text_bytes, with_text_id

#: Bytes of an anchor.
K = 32
#: Different contexts of one anchor that one task takes (up to 368 bytes each).
MAX_CONTEXTS = 8000
#: Bytes of contexts transformed at once.
CHUNK = 3 << 20


#: Offsets from the anchor that are taken together when a hot anchor is split, coarse to fine.
SPLITS = (8, 1)
#: Bits of an anchor's place; a text has fewer than 2^31 bytes.
_PLACE = np.uint64(32)


def anchors(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of the windows that each anchor owns, in the bytes of some texts, the anchor's place and its hash.

    The leftmost of equal hashes is a window's anchor; the windows of one anchor are neighbours.
    """
    n, z = len(raw), np.zeros(0, np.int64)
    if n < size:
        return z, z, z, z
    h, step = _BYTE[raw], 1
    while step < K:
        h = mix(h[:-step] * np.uint64(3) + h[step:])
        step *= 2
    key = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
    w, least, step = size - K + 1, key, 1
    while step * 2 <= w:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if w > step:
        least = np.minimum(least[: len(least) - (w - step)], least[w - step :])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    start = np.flatnonzero(doc[: len(least)] == doc[size - 1 : size - 1 + len(least)])
    if not len(start):
        return z, z, z, z
    at = (least[start] & np.uint64((1 << 32) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    stop = np.append(new[1:], len(at)) - 1
    return start[new], start[stop], at[new], h[at[new]].view(np.int64)


def repeated_starts(data: np.ndarray, ok: np.ndarray, size: int) -> np.ndarray:
    """Which of the places `ok` of data (byte 255 ends each context) start a string of `size` bytes that starts elsewhere too."""
    t = np.concatenate([data, np.full(264, 255, np.uint8)])
    n = len(data)
    v = np.zeros(n, np.uint64)
    for j in range(8):
        v = (v << np.uint64(8)) | t[j : n + j]
    sa = np.argsort(v, kind="stable")
    sorted_v = v[sa]
    new = np.concatenate([[True], sorted_v[1:] != sorted_v[:-1]])
    met = np.concatenate([new, [True]])  # boundaries with a common prefix below the level
    rank = np.empty(n, np.int64)
    rank[sa] = np.cumsum(new)
    h = 8
    while h < size and not new.all():
        second = np.zeros(n, np.int64)
        second[: n - h] = rank[h:]
        # only suffixes that still tie need sorting
        tie = ~new
        tie[:-1] |= ~new[1:]
        slots = np.flatnonzero(tie)
        own = sa[slots]
        key = rank[own] * np.int64(n + 1) + second[own]
        order = np.argsort(key, kind="stable")
        sa[slots] = own[order]
        key = key[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[slots] = fresh | new[slots]
        rank[sa] = np.cumsum(new)
        h *= 2
    last = data[sa - 1]  # the transform
    source = np.argsort(last, kind="stable")
    to = np.empty(n, np.int64)
    to[source] = np.arange(n)
    first = last[source]
    begin = np.concatenate([[True], first[1:] != first[:-1]])
    end = np.concatenate([begin[1:], [True]])
    cut = np.flatnonzero(met)
    lo, hi = cut[:-1], cut[1:]
    for _ in range(8, size):
        if not len(lo):
            break
        width = hi - lo
        p = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo, width)
        f = to[p]
        after = source[np.minimum(f + 1, n - 1)]
        before = source[np.maximum(f - 1, 0)]
        tail = np.sort(f[end[f] | (after >= np.repeat(hi, width))])
        head = np.sort(f[begin[f] | (before < np.repeat(lo, width))])
        fresh = ~met[tail + 1]
        met[tail[fresh] + 1] = True
        lo, hi = head[fresh], tail[fresh] + 1
    repeat = ~met[:-1] | ~met[1:]
    out = np.zeros(n, bool)
    out[sa[repeat]] = True
    return out & ok


def _masks(contexts: list[bytes], size: int) -> list[bytes]:
    """For each context a bit for each window start: whether the window repeats."""
    lengths = np.array([len(c) + 1 for c in contexts])
    data = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)
    start = np.cumsum(lengths) - lengths
    inner = np.arange(len(data)) - np.repeat(start, lengths)
    ok = inner <= np.repeat(lengths - 1 - size, lengths)
    found = repeated_starts(data, ok, size)
    return [np.packbits(found[s : s + max(0, n - size)]).tobytes() for s, n in zip(start, lengths, strict=True)]


def _parts(h: int, context: bytes, a: int, size: int, wide: int):
    """The context cut into blocks of windows whose offsets from the anchor (at a) have one quotient by wide: first window, key, anchor's place, bytes."""
    i, n = 0, len(context) - size + 1
    while i < n:
        block = (a - i) // wide
        last = min(n - 1, a - block * wide)  # offsets fall as windows start later
        shared = context[a - block * wide : a - block * wide - wide + 1 + size]  # in every window of the block
        key = hashlib.blake2b(b"%d %d %d " % (h, wide, block) + shared, digest_size=8).digest()
        yield i, int.from_bytes(key, "little", signed=True), a - i, context[i : last + size]
        i = last + 1


def _digest(context: bytes, a: int) -> int:
    return int.from_bytes(hashlib.blake2b(b"%d " % a + context, digest_size=8).digest(), "little", signed=True)


def _batch(rows: list[tuple], names: str, kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names.split())


def _flat(lists: pa.ListArray) -> tuple[pa.StructArray, list[int]]:
    """The structs of all lists in one array, and where each list begins and the last ends in it."""
    cut = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
    return lists.flatten(), cut.tolist()


_LONG, _INT, _BIN = pa.int64(), pa.int32(), pa.binary()


def window_masks(contexts: DataFrame, size: int, splits: tuple[int, ...] = SPLITS) -> DataFrame:
    """(h, c, i, mask, windows) of contexts (h, c, n, a, context): bits of the windows from the i-th on that repeat.

    h: the anchor, or what else the contexts of one group share; c: the context's own hash;
    n: how often it occurs in this row (rows of equal contexts are added up, and one of them
    has its bytes); a: the anchor's place in it. At the last of splits no group is too large.
    """
    merged = contexts.groupBy("h", "c").agg(F.sum("n").alias("n"), F.first("a").alias("a"), F.first("context", ignorenulls=True).alias("context"))
    few, hot = merged, None
    if splits:
        counts = contexts.select("h", "c").distinct().groupBy("h").agg(F.count("*").alias("different"))
        large = save(counts.where(F.col("different") > MAX_CONTEXTS).select("h"), "hot-anchors")
        if large.limit(1).count():
            few, hot = merged.join(large, "h", "left_anti"), contexts.join(large, "h", "left_semi")

    def transform(batches):
        held: list[tuple[int, int, int, bytes]] = []
        weight = 0

        def flush(rows):
            met = Counter(h for h, _, _, _ in rows)
            many = [x for x in rows if met[x[0]] > 1]  # a context without others of its anchor repeats only as a whole
            masks = {x[:2]: m for x, m in zip(many, _masks([x[3] for x in many], size), strict=True)} if many else {}
            out = []
            for h, c, n, x in rows:
                windows = len(x) - size + 1
                mask = b"\xff" * -(-windows // 8) if n > 1 else masks.get((h, c))
                if mask is not None and any(mask):
                    out.append((h, c, 0, mask, windows))
            return _batch(out, "h c i mask windows", [_LONG, _LONG, _INT, _BIN, _INT])

        for batch in batches:
            for h, c, n, x in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if weight > CHUNK and h != held[-1][0]:
                    yield flush(held)
                    held, weight = [], 0
                held.append((h, c, n, x))
                weight += len(x) + 1
        if held:
            yield flush(held)

    few = few.select("h", "c", "n", "context").repartition("h").sortWithinPartitions("h")
    out = save(few.mapInArrow(transform, "h long, c long, i int, mask binary, windows int"), "masks")
    if hot is None:
        return out
    wide = splits[0]

    def split(batches):
        for batch in batches:
            rows = []
            for h, c, n, a, x in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                rows += [(h, c, n, i, h2, _digest(part, a2), a2, part) for i, h2, a2, part in _parts(h, x, a, size, wide)]
                if len(rows) > 4000:
                    yield _batch(rows, "h c n i h2 c2 a context", [_LONG, _LONG, _LONG, _INT, _LONG, _LONG, _INT, _BIN])
                    rows = []
            yield _batch(rows, "h c n i h2 c2 a context", [_LONG, _LONG, _LONG, _INT, _LONG, _LONG, _INT, _BIN])

    fields = "h long, c long, n long, i int, h2 long, c2 long, a int, context binary"
    whole = hot.groupBy("h", "c").agg(F.sum("n").alias("n"), F.first("a").alias("a"), F.first("context", ignorenulls=True).alias("context"))
    parts = save(whole.select("h", "c", "n", "a", "context").mapInArrow(split, fields), "parts")
    inner = window_masks(parts.select(F.col("h2").alias("h"), F.col("c2").alias("c"), "n", "a", "context"), size, splits[1:]).select(F.col("h").alias("h2"), F.col("c").alias("c2"), F.col("i").alias("j"), "mask", "windows")
    lifted = parts.select("h", "c", "i", "h2", "c2").join(inner, ["h2", "c2"]).select("h", "c", (F.col("i") + F.col("j")).alias("i"), "mask", "windows")
    return out.unionByName(lifted)


def repeated_windows(identified: DataFrame, size: int, text: str) -> tuple[DataFrame, DataFrame]:
    """Of rows with __id: (k, text) of the texts with anchors that repeat, and (k, found: array of (s, mask, windows)): bits of repeated window starts from s on."""
    keyed = identified.select(F.col("__id").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def mark(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            for i, j in slices(off, 2 << 20):
                own = off[i : j + 1] - off[i]
                s, e, at, h = anchors(raw[off[i] : off[j]], own, size)
                d = np.searchsorted(own, s, "right") - 1
                # w: the context's length and, below size, the anchor's place in it
                cols = [(s - own[d]).astype(np.int32), ((e - s + size) * size + at - s).astype(np.int32), h]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].take(pa.array(d)), *map(pa.array, cols)], names=["k", "s", "w", "h"])

    marked = save(keyed.mapInArrow(mark, "k long, s int, w int, h long"), "anchors")
    again = marked.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    places = marked.join(again, "h").groupBy("k").agg(F.collect_set(F.struct("s", "w", "h")).alias("places"))  # no more than a text's anchors
    # each text with its places, so that texts move once before they are carved
    texts = save(keyed.dropDuplicates(["k"]).join(places, "k"), "anchored-texts")
    kinds = [_LONG, _INT, _LONG, _LONG, _INT, _BIN]

    def carve(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            data = raw.tobytes()
            flat, cut = _flat(batch.column(2))
            place, wide, anchor = (flat.field(x).to_pylist() for x in ("s", "w", "h"))
            for d, (k, begin) in enumerate(zip(batch.column(0).to_pylist(), off[:-1].tolist(), strict=True)):
                rows, seen = [], set()
                for x in range(cut[d], cut[d + 1]):
                    s, h, (n, a) = place[x], anchor[x], divmod(wide[x], size)
                    part = data[begin + s : begin + s + n]
                    c = _digest(part, a)
                    rows.append((k, s, h, c, a, None if (h, c) in seen else part))  # a text brings equal contexts once
                    seen.add((h, c))
                    if len(rows) > 4000:
                        yield _batch(rows, "k s h c a context", kinds)
                        rows = []
                yield _batch(rows, "k s h c a context", kinds)

    carved = texts.select("k", "text", "places").mapInArrow(carve, "k long, s int, h long, c long, a int, context binary")
    carved = save(carved, "contexts")
    masks = window_masks(carved.select("h", "c", F.lit(1).cast("long").alias("n"), "a", "context"), size)
    found = carved.select("k", "s", "h", "c").join(masks, ["h", "c"])
    return texts.select("k", "text"), found.groupBy("k").agg(F.collect_list(F.struct((F.col("s") + F.col("i")).alias("s"), "mask", "windows")).alias("found"))


def remove_repeats(docs: DataFrame, size: int = 200, text: str = "text", out: str | None = None) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_sha256; with `out`, also a column of the bytes that are left."""
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", out)]
    docs = with_text_id(docs, text)
    texts, found = repeated_windows(docs, size, text)

    def finish(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            removed, spans, sha, rest = [], [], [], []
            flat, cut = _flat(batch.column(2))
            place, masks, windows = (flat.field(x).to_pylist() for x in ("s", "mask", "windows"))
            for d in range(batch.num_rows):
                own = raw[off[d] : off[d + 1]]
                step = np.zeros(len(own) + 1, np.int32)
                for x in range(cut[d], cut[d + 1]):
                    bits = np.flatnonzero(np.unpackbits(np.frombuffer(masks[x], np.uint8))[: windows[x]]) + place[x]
                    step[bits] = 1
                starts = np.flatnonzero(step)
                level = np.zeros(len(own) + 1, np.int32)
                np.add.at(level, starts, 1)
                np.add.at(level, np.minimum(starts + size, len(own)), -1)
                gone = np.cumsum(level)[: len(own)] > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0)
                left = own[~gone].tobytes()
                sha.append(hashlib.sha256(left).hexdigest())
                rest.append(left if out else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(rest, pa.binary())], names=["k", "r", "sp", "sha", "rest"])

    done = texts.join(found, "k").select("k", "text", "found").mapInArrow(finish, "k long, r long, sp long, sha string, rest binary")
    done = save(done.where("r > 0"), "removed")
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(*names, F.col("__id").alias("__k"), F.length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("__sha"), *([whole.alias("__whole")] if out else []))
    copies = rows.where(f"n_bytes >= {size}").groupBy("__k").agg(F.count("*").alias("__n")).where("__n > 1")
    got = copies.join(done.withColumnRenamed("k", "__k"), "__k", "full_outer")
    rows = rows.join(got, "__k", "left")
    copy, zero = F.col("__n").isNotNull(), F.lit(0).cast("long")
    cols = [
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("r", zero)).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("sp", zero)).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("sha", "__sha")).alias("kept_sha256"),
    ]
    if out:
        cols.append(F.when(copy, F.lit(b"")).otherwise(F.coalesce("rest", "__whole")).alias(out))
    return rows.select(*names, *cols)
