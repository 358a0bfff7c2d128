"""Substring dedup: repeated paragraphs and passages by MinHash banding, exact checks and components.

A text is cut into paragraphs at places that its content names, so that a passage is cut
alike wherever it stands. Lines of min_words words or more begin and end paragraphs. Inside
them, and in runs of shorter lines, cuts are drawn by rank: line ends first, then sentence
ends, then the hash of the two words before; a place is a cut unless one of a better rank
is nearer than min_words. So a paragraph has at least min_words and, where places don't
run out, at most 2 min_words - 1 words, and a passage of 50 words that stands inside other
text holds whole paragraphs. Fewer words than min_words between fixed cuts are never a
repeat (their meeting again is chance). 8 bands of 2 registers let a pair of similarity 0.8
go with probability 3e-4, equal paragraphs never. Paragraphs that share none of the shingles
that an exact prefix filter looks at can't be similar to any other and get no bands. Paragraphs that collide are verified by exact
weighted Jaccard and clustered by components; in each class the first occurrence (by
doc_id, then place) stays and all others are removals.

Paragraphs are equal if 128 bits of their words are. Null counts as empty. Repeated rows
have the same occurrences, of which one stays (of equal ids and places, all do). Null
ids come last. Other columns are not read; an empty table gives no rows. Very long texts are
read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, mix, save, slices, span_hashes, text_bytes, words
from .near_dedup import _GOLD, bands_of, link, weighted_shingles

BANDS, ROWS = 8, 2
_END = np.isin(np.arange(256), list(b".!?"))


def spread(rank: np.ndarray, fixed: np.ndarray, apart: int) -> np.ndarray:
    """Mask of cuts: the fixed ones, and by rank (least first, then leftmost) all others that keep `apart` from every cut."""
    n, out = len(rank), fixed.copy()
    place = np.arange(n)
    before = np.maximum.accumulate(np.where(fixed, place, -1))
    after = np.minimum.accumulate(np.where(fixed, place, n + apart)[::-1])[::-1]
    at = np.flatnonzero((place - before >= apart) & (after - place >= apart))
    r = rank[at]
    for _ in range(24):
        if not len(at):
            return out
        best = np.ones(len(at), bool)
        for k in range(1, min(apart, len(at))):
            near = at[k:] - at[:-k] < apart
            if not near.any():
                break
            less = r[k:] < r[:-k]
            best[k:] &= ~near | less
            best[:-k] &= ~near | ~less
        won = at[best]
        out[won] = True
        k = np.searchsorted(won, at)
        free = (at - won[np.maximum(k - 1, 0)] >= apart) | (k == 0)
        free &= (won[np.minimum(k, len(won) - 1)] - at >= apart) | (k == len(won))
        at, r = at[free], r[free]
    # only long runs of equal or steadily falling ranks are left: from left to right
    last = -apart
    for x in at.tolist():
        if x - last >= apart:
            out[x] = True
            last = x
    return out


def cut(raw: np.ndarray, off: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Starts, ends (bytes), texts and two key hashes of the paragraphs of min_words words or more."""
    starts, ends, doc = words(raw, off, NOT_SPACE)
    z = np.zeros(0, np.int64)
    if not len(starts):
        return z, z, z, z, z
    h = span_hashes(raw, starts, ends)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    next_text = np.ones(len(starts), bool)
    next_text[:-1] = doc[1:] != doc[:-1]
    next_line = next_text.copy()
    next_line[:-1] |= lines[starts[1:]] != lines[starts[:-1]]
    line = np.flatnonzero(next_line)
    long = np.diff(line, prepend=-1) >= min_words
    fixed = next_text.copy()
    fixed[line[long]] = True
    fixed[line[:-1][long[1:]]] = True
    pair = mix(h + np.concatenate([[0], h[:-1]]).astype(np.uint64) * np.uint64(3))
    kind = np.where(next_line, 0, np.where(_END[raw[ends - 1]], 1, 2)).astype(np.uint64)
    last = np.flatnonzero(spread((kind << np.uint64(62)) | (pair >> np.uint64(2)), fixed, min_words))
    first = np.concatenate([[0], last[:-1] + 1])
    size = last - first + 1
    place = np.arange(len(h)) - np.repeat(first, size)
    step = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = mix(np.add.reduceat(mix(h + step), first))
    key2 = mix(np.add.reduceat(mix((h ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(3) + step), first))
    ok = size >= min_words
    return starts[first[ok]], ends[last[ok]], doc[first[ok]], key[ok].view(np.int64), key2[ok].view(np.int64)


def _each(docs: DataFrame, text: str, fields: str, make, extra: list[str] = []):  # noqa: B006
    def run(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(0))
            for i, j in slices(off, 2 << 20):
                yield make(batch, i, raw[off[i] : off[j]], off[i : j + 1] - off[i])

    return docs.select(text, *extra).mapInArrow(run, fields)


def _side_by_side(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the spans and n + 1 offsets into them, as texts of their own."""
    own = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int64)
    return raw[np.arange(int(own[-1])) + np.repeat(s - own[:-1], e - s)], own


def _first_ones(key: np.ndarray, key2: np.ndarray) -> np.ndarray:
    """Places of the first of each pair of keys."""
    order = np.lexsort((key2, key))
    a, b = key[order], key2[order]
    return np.sort(order[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])]) if len(key) else order


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 10) -> DataFrame:
    """doc_id, start (code points), length, key, key2 of each paragraph that may be a repeat, and its text, which copies near by need not have."""

    def make(batch, i, raw, off):
        s, e, d, key, key2 = cut(raw, off, min_words)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        at = chars[s] - chars[off[d]]
        copy = np.ones(len(key), bool)
        copy[_first_ones(key, key2)] = False
        size = np.where(copy, 0, e - s)
        part, own = _side_by_side(raw, s, s + size)
        texts = pa.Array.from_buffers(pa.string(), len(key), [pa.py_buffer(np.packbits(~copy, bitorder="little")), pa.py_buffer(own.astype(np.int32)), pa.py_buffer(part)])
        return pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(d + i)).cast(pa.int64()), pa.array(at), pa.array(chars[e] - chars[s]), pa.array(key), pa.array(key2), texts], names=["doc_id", "start", "length", "key", "key2", "text"])

    return _each(docs.withColumnRenamed(id_col, "doc_id"), text, "doc_id long, start long, length long, key long, key2 long, text string", make, ["doc_id"])


def may_be_similar(docs: DataFrame, text: str = "text", min_words: int = 10, similarity: float = 0.8, k: int = 5) -> DataFrame:
    """The keys of paragraphs that another one may reach the similarity with; no such paragraph is left out.

    Of n shingles, in the order of their hashes, a paragraph that reaches it shares at least
    ceil(similarity * n), so one of the first n - ceil(similarity * n) + 1 of both is the
    same. Paragraphs of which none of these recurs, nearly all, need no signature.
    """

    def make(batch, i, raw, off):
        s, e, _, key, key2 = cut(raw, off, min_words)
        pick = _first_ones(key, key2)
        d, h, w = weighted_shingles(*_side_by_side(raw, s[pick], e[pick]), k)
        # copies of a shingle are shingles of their own
        copy = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        d, h = np.repeat(d, w), np.where(copy, mix(np.repeat(h, w) + copy.astype(np.uint64) * _GOLD), np.repeat(h, w))
        order = np.lexsort((h, d)) if copy.any() else slice(None)  # they are in order without copies
        d, h = d[order], h[order]
        n = np.bincount(d, minlength=len(pick))
        first = np.arange(len(d)) - (np.cumsum(n) - n)[d] <= (n - np.ceil(similarity * n - 1e-9))[d]
        return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(key[pick][d[first]])], names=["e", "key"])

    each = _each(docs, text, "e long, key long", make)
    one = Window.partitionBy("e")
    met = each.withColumns({"a": F.min("key").over(one), "b": F.max("key").over(one)})
    return save(met.where("a <> b").select("key").distinct(), "paragraph-keys")


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 10, similarity: float = 0.8, k: int = 5) -> DataFrame:
    """Occurrences of paragraphs that occur again: doc_id, start, length, class_key, class_doc_id, class_start, removed."""
    near = may_be_similar(docs, text, min_words, similarity, k).withColumn("near", F.lit(True))
    # all occurrences of a paragraph meet once; what neither recurs nor may be similar ends there
    same, equal = Window.partitionBy("key"), Window.partitionBy("key", "key2")
    found = paragraphs(docs, id_col, text, min_words).repartition("key").sortWithinPartitions("key", "key2")
    found = found.withColumns({"least": F.min("key2").over(same), "most": F.max("key2").over(same)})
    found = found.withColumns({"n": F.count("*").over(equal), "first": F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "start")).over(equal)})
    found = found.join(near, "key", "left").withColumn("near", F.col("near").isNotNull() | (F.col("least") != F.col("most")))
    own = F.when(F.col("key2") == F.col("least"), F.col("key")).otherwise(F.xxhash64("key", "key2", F.lit("again")))  # different paragraphs of one key, hardly ever any
    found = save(found.where("n > 1 or near").select("doc_id", "start", "length", own.alias("id"), "n", "first", "near", F.when(F.col("near"), F.col("text")).alias("text")), "paragraphs")
    texts = save(found.where("text is not null").select("id", "text").dropDuplicates(["id"]), "paragraph-texts")
    roots = link(texts, save(bands_of(texts, BANDS, ROWS, k), "paragraph-buckets"), "paragraph", similarity, k)
    found = found.drop("text")
    linked = found.where("near").join(roots, "id", "left").where("n > 1 or root is not null").withColumn("class_key", F.coalesce("root", "id")).drop("root")
    least = linked.groupBy("class_key").agg(F.min("first").alias("least"))
    linked = linked.join(least, "class_key").withColumn("first", F.col("least")).drop("least")
    out = found.where("not near").withColumn("class_key", F.col("id")).unionByName(linked)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.start"))
    return out.select("doc_id", "start", "length", "class_key", F.col("first.doc_id").alias("class_doc_id"), F.col("first.start").alias("class_start"), (~stays).alias("removed"))
