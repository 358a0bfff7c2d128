"""Near-duplicate documents by BagMinHash signatures of weighted word shingles.

A document is the multiset of its runs of five words; similarity is weighted Jaccard
(sum of minima over sum of maxima). Each shingle of count w owns a Poisson process over
weights [0, w): the weights are cut into blocks [0,1), [1,2), [2,4), [4,8), ...; a block's
process makes points in order of time at a rate equal to its width, each point at a random
level of the block; points above w don't exist for this document. Each register keeps the
earliest point it gets, so two documents agree in a register with the probability of their
weighted Jaccard similarity; points later than the latest register are never made.

Registers are banded. A band's bucket links its members to a random leader, and what then
still lies in different components of a bucket is compared too, so no pair of a bucket is
left out, while a group of copies costs links in proportion to its size. Every pair is
verified on the whole texts. Classes are the connected components of verified links.

Exact copies count once: they meet by 128 bits of their text. Null counts as empty. Rows are
known by their text, so repeated rows, null ids and ties are well defined: a class's
id is the least doc_id in it. Texts without words are classes of their own text. An empty
table gives no rows. Very long texts are read whole, a text at a time. Columns of docs whose
names are those of results are replaced; all others are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, components, mix, save, shingle_hashes, slices, span_hashes, text_bytes, with_text_id, words

#: 26 bands of 5 registers: a pair of similarity 0.8 shares no bucket with probability 3e-5.
BANDS, ROWS = 26, 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def weighted_shingles(raw: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text, hash, count; sorted by text, then hash."""
    starts, ends, doc = words(raw, off, NOT_SPACE)
    h, d = shingle_hashes(span_hashes(raw, starts, ends), doc, k)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(h)))
    return d[new], h[new], count


def bag_minhash(d: np.ndarray, h: np.ndarray, w: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n texts, m registers) of the weighted sets; texts without shingles get zeros."""
    best = np.full(n * m, np.inf)
    value = np.zeros(n * m, np.uint64)
    # blocks of weight: [0,1), then [2^(b-1), 2^b)
    block, low, width = 0, 0, 1
    live = np.arange(len(h))
    queue = []
    while len(live):
        queue.append((block, low, width, live))
        low, width, block = low + width, low + width, block + 1
        live = live[w[live] > low]
    for block, low, width, own in queue:
        state = mix(h[own] + np.uint64(int(_GOLD) * (block + 1) % 2**64))
        t = np.zeros(len(own))
        sub_d, sub_w = d[own], w[own]
        while len(state):
            state = mix(state + _GOLD)
            t = t - np.log(_unit(state)) / width
            where = (mix(state ^ _GOLD) % np.uint64(m)).astype(np.int64)
            slot = sub_d * m + where
            ok = np.ones(len(state), bool)
            if width > 1:
                level = low + (_unit(mix(state + np.uint64(77))) * width).astype(np.int64)
                ok = level < sub_w
            last = best.reshape(n, m).max(1)
            ok &= t < best[slot]
            if ok.any():
                s, tt, v = slot[ok], t[ok], state[ok]
                np.minimum.at(best, s, tt)
                won = best[s] == tt
                value[s[won]] = v[won]
                last = best.reshape(n, m).max(1)
            go = t < last[sub_d]
            state, t, sub_d, sub_w = state[go], t[go], sub_d[go], sub_w[go]
    return value.reshape(n, m)


def bands_of(texts: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = 5) -> DataFrame:
    """texts (id, text) to rows (id, bucket), a bucket being of one band; none for texts without words."""
    m = bands * rows

    def run(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            for i, j in slices(off, 2 << 20):
                d, h, w = weighted_shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                sig = bag_minhash(d, h, w, j - i, m)
                some = np.flatnonzero(np.bincount(d, minlength=j - i) > 0)
                ids = batch.column(0)[i:j].take(pa.array(np.repeat(some, bands)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(band_hashes(sig[some], bands, rows).reshape(-1))], names=["id", "bucket"])

    return texts.select("id", "text").mapInArrow(run, "id long, bucket long")


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sig.reshape(len(sig), bands, rows)
    acc = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        acc = mix(acc * np.uint64(3) + part[:, :, r])
    return acc.view(np.int64)


def _similarity(ra, oa, rb, ob, k: int) -> np.ndarray:
    """Weighted Jaccard of the pairs of texts at the same places."""
    n = len(oa) - 1
    da, ha, wa = weighted_shingles(ra, oa, k)
    db, hb, wb = weighted_shingles(rb, ob, k)
    d, h, w = np.concatenate([da, db]), np.concatenate([ha, hb]), np.concatenate([wa, wb])
    order = np.lexsort((h, d))
    d, h, w = d[order], h[order], w[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (d[1:] == d[:-1]))
    both = np.bincount(d[same], np.minimum(w[same], w[same + 1]), n)
    total = np.bincount(d, w, n) - both
    return both / np.maximum(total, 1)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = 0.8, k: int = 5) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity."""
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            ra, oa = text_bytes(batch.column(2))
            rb, ob = text_bytes(batch.column(3))
            keep = [np.zeros(0, bool)]
            for i, j in slices(oa + ob, 4 << 20):
                s = _similarity(ra[oa[i] : oa[j]], oa[i : j + 1] - oa[i], rb[ob[i] : ob[j]], ob[i : j + 1] - ob[i], k)
                keep.append(s >= similarity - 1e-12)
            keep = pa.array(np.concatenate(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def distinct_texts(identified: DataFrame, text: str = "text") -> DataFrame:
    """A row for each distinct text with words of rows with __id: id, text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return identified.select(F.col("__id").alias("id"), t.alias("text")).where(F.col("text").rlike(r"[^ \t-\r]")).dropDuplicates(["id"])


def prefix_pairs(texts: DataFrame, open_: DataFrame, similarity: float, k: int) -> DataFrame:
    """Pairs (a, b) of different roots that can reach the similarity; no such pair is left out.

    Shingles are ordered from rare to common. A pair that reaches the similarity shares a
    shingle early in both: at a place p of the longer text (n shingles) and q of the other (m)
    after which enough is left for the overlap that the two need, similarity / (1 + similarity)
    * (n + m). For the shorter text, which needs that with a partner of its own length at
    least, few places qualify; for the longer one each place bounds how long the partner may
    be. So texts that share a boilerplate and differ by words of their own, too many to be
    similar, never meet at it, however many they are. Shingles that only one component has
    are left out.
    """

    def run(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            for i, j in slices(off, 1 << 20):
                d, h, w = weighted_shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                copy = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                d, h = np.repeat(d, w), mix(np.repeat(h, w) + copy.astype(np.uint64) * _GOLD)
                n = np.bincount(d, minlength=j - i)[d]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].take(pa.array(d)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["id", "e", "n"])

    each = texts.join(open_.select("id"), "id", "left_semi").select("id", "text").mapInArrow(run, "id long, e long, n long")
    each = save(each.join(open_, "id").select("id", "root", "e", "n"), "elements")
    often = each.groupBy("e").agg(F.count("*").alias("f"), F.min("root").alias("least"), F.max("root").alias("most"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("f", "e"))  # no more than a text's shingles
    share = similarity / (1 + similarity)
    # longest partner for which enough is left after this place
    most = F.floor((F.col("n") - F.col("p") + 1 + 1e-6) / F.lit(share) - F.col("n"))
    ranked = each.join(often, "e").withColumn("p", place).where("least < most").withColumn("up", most)
    ranked = save(ranked.where(F.col("up") >= F.ceil(F.lit(similarity) * F.col("n") - 1e-9)).select("id", "root", "e", "n", "up"), "prefixes")
    longer = ranked.select("e", F.col("id").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("up").alias("ua"))
    shorter = ranked.where("up >= n").select("e", F.col("id").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("up").alias("ub"))
    met = longer.join(shorter, "e").where("ra <> rb and nb <= na and nb <= ua and na <= ub and (nb < na or b < a)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def link(texts: DataFrame, buckets: DataFrame, name: str, similarity: float = 0.8, k: int = 5, rounds: int = 3) -> DataFrame:
    """Components (id, root) of verified links among ids that share a bucket; ids without a link are absent.

    buckets: (id, bucket), ids being hashes. Every pair of a bucket is either compared or already in one component.
    """
    # a bucket's leader is that member whose id is least after a change of its own
    lead = F.min(F.col("id").bitwiseXOR(F.col("bucket"))).alias("x")
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"), lead).where("n > 1")
    shared = sizes.select("bucket", F.col("x").bitwiseXOR(F.col("bucket")).alias("lead"))
    members = save(buckets.join(shared, "bucket"), f"{name}-members")
    texts = save(texts.join(members.select("id").distinct(), "id", "left_semi"), f"{name}-candidates")
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    tried = save(members.where("id <> lead").select(*pair("id", "lead")).distinct(), f"{name}-pairs")
    links = save(verified(tried, texts, similarity, k), f"{name}-links")
    roots = components(links, name)
    for r in range(rounds):
        placed = members.join(roots, "id", "left").select("id", "bucket", F.coalesce("root", "id").alias("root"))
        parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
        main = parts.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("x"), F.count("*").alias("parts")).where("parts > 1")
        open_ = save(placed.join(main.select("bucket", F.col("x.root").alias("main")), "bucket"), f"{name}-open")
        if r + 1 < rounds:
            # new leaders for those outside a bucket's largest component, drawn from each of its components
            drawn = open_.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", "bucket", F.lit(r)), "id", "root")).alias("x"))
            drawn = drawn.select("bucket", F.col("x.id").alias("y"), F.col("x.root").alias("y_root"))
            pairs = open_.join(drawn, "bucket").where("root <> y_root").select(*pair("id", "y"))
        else:
            # whatever still lies in different components of a bucket: by an exact filter instead of all pairs
            pairs = prefix_pairs(texts, open_.select("id", "root").distinct(), similarity, k)
        pairs = save(pairs.distinct().join(tried, ["a", "b"], "left_anti"), f"{name}-pairs-{r}")
        if pairs.limit(1).count() == 0:
            continue
        more = save(verified(pairs, texts, similarity, k), f"{name}-links-{r}")
        tried = tried.union(pairs)
        if more.limit(1).count():
            known = roots.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
            roots = components(known.union(more), f"{name}-{r}")
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8, k: int = 5) -> DataFrame:
    """docs with class_key, class_id (least id of the class) and kept (whether the row has that id).

    A class whose ids are all null has the id null and its rows count as kept. keep_one()
    also settles rows of equal ids.
    """
    names = [c for c in docs.columns if c not in ("class_key", "class_id", "kept")]
    docs = with_text_id(docs.select(*names), text)
    texts = save(distinct_texts(docs, text), "texts")
    buckets = save(bands_of(texts, k=k), "buckets")
    roots = link(texts, buckets, "near", similarity, k)
    rows = docs.join(roots.select(F.col("id").alias("__id"), F.col("root").alias("__root")), "__id", "left")
    rows = rows.withColumn("class_key", F.coalesce("__root", "__id"))
    least = rows.groupBy("class_key").agg(F.min(id_col).alias("class_id"))
    return rows.join(least, "class_key").select(*names, "class_key", "class_id", F.col(id_col).eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8, k: int = 5) -> DataFrame:
    """One row of each class, that with the least id, with the columns of docs. Of rows of one text and equal ids any stays.

    Copies of a text are brought down to one row before anything else, within each task
    first; whole rows are shuffled there and once more, with what stays.
    """
    names, order = docs.columns, F.struct(F.col(id_col).isNull(), id_col)
    one = with_text_id(docs, text).groupBy("__id").agg(F.min_by(F.struct(*names), order).alias("__row"))
    one = save(one.select("__id", "__row.*"), "one-of-each-text")
    texts = one.select(F.col("__id").alias("id"), F.coalesce(text, F.lit("")).alias("text")).where(F.col("text").rlike(r"[^ \t-\r]"))
    roots = link(texts, save(bands_of(texts, k=k), "buckets"), "near", similarity, k)
    placed = one.select("__id", id_col).join(roots.select(F.col("id").alias("__id"), "root"), "__id", "left")
    kept = placed.groupBy(F.coalesce("root", "__id").alias("class_key")).agg(F.min_by("__id", F.struct(F.col(id_col).isNull(), id_col, "__id")).alias("__id"))
    return one.join(save(kept.select("__id"), "kept"), "__id", "left_semi").select(*names)
