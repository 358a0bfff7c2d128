"""Benchmark decontamination by a distributed positional inverted index.

Terms are lower-cased words. The index holds, for each term that anchors some benchmark
window, the documents and word positions where it occurs; documents without such terms are
not in it. A window of consecutive item words is looked up by its rarest terms (by their
count in the documents): their position lists, each shifted by the term's offset in the
window, are intersected. Where the shifted lists meet the window is compared word by word
(phrase match). Where they come within `slop` words of each other, and `share` of the
window's words stand around that place, the item is a proximity match; these are returned
beside the phrase matches and don't count as hits.

Rows are keyed by 128 bits of their text, not by doc_id, so repeated rows, null ids and
clashing ids make no difference. Null text has no words; an item without words has no
window; an item of fewer words than a window is one window; items without an id are
windows of no item. Items are sorted as strings, each once, so ties don't arise. With an
empty benchmark no word is hit; an empty document table gives no rows. Very long texts are
read whole, a text at a time. Columns of docs whose names are those of results are replaced;
all others are kept.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, save, slices, span_hashes, text_bytes, text_key, words

#: Distinct benchmark terms that are sent to every task (8 bytes each); beyond that the index keeps all terms and joins pick.
MAX_SENT_TERMS = 2_000_000
RESULTS = ("n_words", "n_hit", "items", "near_items", "contaminated")


def _terms(raw: np.ndarray, off: np.ndarray):
    starts, ends, doc = words(raw, off, ALNUM)
    return span_hashes(LOWER[raw] if len(raw) else raw, starts, ends).view(np.int64), doc


def _count_words(column: pa.Array) -> pa.Array:
    """Words of each text: a letter's byte begins one if none is before it in the text."""
    raw, off = text_bytes(column)
    n = np.zeros(len(off) - 1, np.int64)
    for i, j in slices(off):
        inside = ALNUM[raw[off[i] : off[j]]]
        own = off[i : j + 1] - off[i]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = own[:-1][own[1:] > own[:-1]]
        begins[first] = inside[first]
        n[i:j] = np.diff(np.searchsorted(np.flatnonzero(begins), own))
    return pa.array(n)


def item_windows(benchmark: DataFrame, size: int = 13) -> DataFrame:
    """item_id (string), phrase (128 bits of the window's words) and terms of each window of the items."""

    def run(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            for i, j in slices(off):
                h, doc = _terms(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                item, terms = [], []
                for d in range(j - i):
                    own = h[cut[d] : cut[d + 1]]
                    k = min(size, len(own))
                    if k:
                        found = np.lib.stride_tricks.sliding_window_view(own, k)
                        item += [i + d] * len(found)
                        terms += [x.tolist() for x in found]
                phrase = [hashlib.blake2b(np.array(x, np.int64).tobytes(), digest_size=16).digest() for x in terms]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(item, pa.int64())), pa.array(phrase, pa.binary()), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "phrase", "terms"]
                )

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, phrase binary, terms array<long>").distinct()


def _sorted_terms(df: DataFrame) -> np.ndarray | None:
    """The distinct terms of df, if no more than MAX_SENT_TERMS."""
    found = df.select("term").distinct().limit(MAX_SENT_TERMS + 1).toArrow().column("term").to_numpy()
    return None if len(found) > MAX_SENT_TERMS else np.sort(found)


def _member(h: np.ndarray, among: np.ndarray | None) -> np.ndarray:
    if among is None:
        return np.ones(len(h), bool)
    if not len(among) or not len(h):
        return np.zeros(len(h), bool)
    k = np.minimum(np.searchsorted(among, h), len(among) - 1)
    return among[k] == h


def term_counts(docs: DataFrame, terms: np.ndarray | None, text: str = "text") -> DataFrame:
    """How often each term occurs in the documents: (term, n); summed within each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        total: dict[int, int] = {}
        for batch in batches:
            raw, off = text_bytes(batch.column(0))
            for i, j in slices(off):
                h, _ = _terms(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                u, n = np.unique(h[_member(h, shared.value)], return_counts=True)
                for k, c in zip(u.tolist(), n.tolist(), strict=True):
                    total[k] = total.get(k, 0) + c
            if len(total) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])
                total = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    return docs.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def positional_index(docs: DataFrame, terms: np.ndarray | None, text: str = "text") -> DataFrame:
    """A row for each document that has any of the terms: k1, k2 (of its text) and postings, an array of (term, position)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    entry = pa.struct([("term", pa.int64()), ("position", pa.int32())])

    def run(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(2))
            for i, j in slices(off):
                h, doc = _terms(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                n = np.bincount(doc, minlength=j - i)
                position = np.arange(len(h)) - (np.cumsum(n) - n)[doc]
                m = _member(h, shared.value)
                per = np.bincount(doc[m], minlength=j - i)
                some = np.flatnonzero(per)
                values = pa.StructArray.from_arrays([pa.array(h[m]), pa.array(position[m].astype(np.int32))], fields=list(entry))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per[some])]).astype(np.int32)), values)
                keys = [batch.column(c).take(pa.array(some + i)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, lists], names=["k1", "k2", "postings"])

    k1, k2 = text_key(F.col(text))
    return docs.select(k1.alias("k1"), k2.alias("k2"), text).mapInArrow(run, "k1 long, k2 long, postings array<struct<term:long,position:int>>")


def rarest(windows: DataFrame, counts: DataFrame, anchors: int, share: float = 0.75) -> DataFrame:
    """phrase, need, rank, term, at: the rarest terms that occur of each window, if `share` of its terms or more occur."""
    each = windows.select("phrase", "terms").dropDuplicates(["phrase"]).select("phrase", F.size("terms").alias("width"), F.posexplode("terms").alias("at", "term"))
    ranked = each.join(counts, "term").groupBy("phrase", "width").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("all"))
    ranked = ranked.where(F.size("all") >= share * F.col("width"))  # at most a window's words each
    picked = ranked.select("phrase", F.least(F.size("all"), F.lit(anchors)).alias("need"), F.posexplode(F.slice("all", 1, anchors)).alias("rank", "a"))
    return picked.select("phrase", "need", "rank", "a.term", "a.at")


def phrase_starts(index: DataFrame, picked: DataFrame, slop: int = 4) -> DataFrame:
    """Where the shifted position lists of all anchors of a window come within slop words: k1, k2, phrase, starts (of the rarest anchor).

    Lists are cut into blocks of 2 * slop + 1 places. The rarest anchor's place is in one
    block, others' in the one or two that a place within reach may lie in, so a block holds
    a few places whatever the document's length.
    """
    wide = 2 * slop + 1
    posted = index.select("k1", "k2", F.explode("postings").alias("p")).select("k1", "k2", "p.term", "p.position")
    met = posted.join(picked, "term").withColumn("start", F.col("position") - F.col("at"))
    block = lambda x: F.floor(x / F.lit(wide))
    reach = F.when(F.col("rank") == 0, F.array(block(F.col("start")))).otherwise(F.sequence(block(F.col("start") - slop), block(F.col("start") + slop)))
    met = met.select("k1", "k2", "phrase", "need", "rank", "start", F.explode(reach).alias("block"))
    found = met.groupBy("k1", "k2", "phrase", "need", "block").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("ranks"), F.collect_set(F.struct("rank", "start")).alias("at"))
    found = found.where("ranks = shiftleft(1, need) - 1")
    near = f"transform(filter(at, x -> x.rank = 0 and forall(sequence(0, need - 1), r -> exists(at, y -> y.rank = r and abs(y.start - x.start) <= {slop}))), x -> x.start)"
    return found.select("k1", "k2", "phrase", F.expr(near).alias("starts")).where("size(starts) > 0").select("k1", "k2", "phrase", "starts")


def confirm(docs: DataFrame, places: DataFrame, windows: DataFrame, text: str = "text", slop: int = 4, share: float = 0.75) -> DataFrame:
    """k1, k2, n_words, n_hit, exact and near (phrases) of the documents of places, by comparing words."""
    keys = save(places.select("k1", "k2").distinct(), "matched-keys")
    terms = windows.select("phrase", "terms").dropDuplicates(["phrase"])
    each = places.join(terms, "phrase").groupBy("k1", "k2").agg(F.collect_list(F.struct("phrase", "terms", "starts")).alias("places"))  # no more than a text's places
    k1, k2 = text_key(F.col(text))
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text).alias("t")).join(keys, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])

    def run(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(2))
            n, hits, exact, near = [], [], [], []
            for d in range(batch.num_rows):
                h, _ = _terms(raw[off[d] : off[d + 1]], off[d : d + 2] - off[d])
                hit, found, close = np.zeros(len(h), bool), set(), set()
                for r in batch.column(3)[d].as_py():
                    want = np.array(r["terms"], np.int64)
                    w = len(want)
                    for s in set(r["starts"]):
                        for x in range(max(0, s - slop), min(s + slop, len(h) - w) + 1):
                            if h[x] == want[0] and (h[x : x + w] == want).all():
                                hit[x : x + w] = True
                                found.add(r["phrase"])
                        if r["phrase"] not in found and r["phrase"] not in close:
                            there = Counter(h[max(0, s - slop) : s + w + slop].tolist())
                            if sum((there & Counter(r["terms"])).values()) >= share * w:
                                close.add(r["phrase"])
                n.append(len(h))
                hits.append(int(hit.sum()))
                exact.append(sorted(found))
                near.append(sorted(close - found))
            kind = pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(exact, kind), pa.array(near, kind)], names=["k1", "k2", "n_words", "n_hit", "exact", "near"])

    return texts.join(each, ["k1", "k2"]).select("k1", "k2", "t", "places").mapInArrow(run, "k1 long, k2 long, n_words long, n_hit long, exact array<binary>, near array<binary>")


def matches(docs: DataFrame, benchmark: DataFrame, size: int = 13, anchors: int = 2, slop: int = 4, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Matched texts: (k1, k2, n_words, n_hit, exact, near), and the items of the phrases (phrase, item_id)."""
    windows = save(item_windows(benchmark, size), "windows")
    counts = term_counts(docs, _sorted_terms(windows.select(F.explode("terms").alias("term"))), text)
    picked = save(rarest(windows, counts, anchors), "anchors")
    index = save(positional_index(docs, _sorted_terms(picked), text), "index")
    places = save(phrase_starts(index, picked, slop), "places")
    return save(confirm(docs, places, windows, text, slop), "matches"), windows.where("item_id is not null").select("phrase", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, anchors: int = 2, slop: int = 4, share: int = 20, text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, items, near_items and contaminated (some word hit, and share * n_hit >= n_words).

    items: those with a phrase match, near_items: those with a proximity match alone.
    """
    found, items = matches(docs, benchmark, size, anchors, slop, text)
    one = lambda c, near: found.select("k1", "k2", F.explode(c).alias("phrase"), F.lit(near).alias("near"))
    named = one("exact", False).union(one("near", True)).join(items, "phrase").groupBy("k1", "k2")
    named = named.agg(*[F.array_sort(F.collect_set(F.when(F.col("near") == v, F.col("item_id")))).alias(c) for c, v in (("items", False), ("near_items", True))])
    facts = found.join(named, ["k1", "k2"], "left").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("n_hit").alias("__h"), F.col("items").alias("__i"), F.col("near_items").alias("__j"))
    names = [c for c in docs.columns if c not in RESULTS or c == text]
    k1, k2 = text_key(F.col(text))
    out = docs.select(*names, k1.alias("__k1"), k2.alias("__k2"), F.arrow_udf(_count_words, "long")(text).alias("__n")).join(save(facts, "facts"), ["__k1", "__k2"], "left")
    none = F.array().cast("array<string>")
    out = out.select(*names, F.col("__n").alias("n_words"), F.coalesce("__h", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("__i", none).alias("items"), F.array_except(F.coalesce("__j", none), F.coalesce("__i", none)).alias("near_items"))
    return out.withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, text: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated. Only the keys of contaminated texts are joined to docs."""
    found, _ = matches(docs, benchmark, size, text=text)
    bad = save(found.where(f"n_hit > 0 and {share} * n_hit >= n_words").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct(), "contaminated")
    k1, k2 = text_key(F.col(text))
    return docs.withColumns({"__k1": k1, "__k2": k2}).join(bad, ["__k1", "__k2"], "left_anti").select(*docs.columns)
