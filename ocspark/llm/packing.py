"""Best-fit packing of token sequences by hierarchical residual packing.

Documents are tokenised where they lie; only lengths travel. Each partition (about
FIRST_TOKENS tokens) packs its pieces by best fit, decreasing. Bins that are nearly full
(`slack` free tokens or fewer) are done, and so are bins whose room is below what the
emptiest bin of all holds, as nothing fits them any more. The others become items of the
next round, in which the bins of fan_in partitions meet in one task and are packed again.

A merge needs a bin that is half full at most, and best fit leaves a task one of those at
most. So the number of such bins bounds what all further rounds can save; rounds end when
it is no more than `gain` of all bins (or one task is left). With each round it falls by
fan_in, so a few rounds do however large the input, and no task ever takes more than the
open bins of fan_in ** rounds partitions.

Null text counts as empty: a document of the end token alone. Repeated rows and rows without
an id are packed each on its own, spread over all partitions. Ties (equal lengths) keep the
order of the saved rows. An empty table gives no rows. Very long texts are encoded whole and
cut into pieces, which keep their document's own order in `start`. Columns sequence_id and
offset of the input are replaced; all others are kept.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, slices, span_hashes, text_bytes, words
from .common import byte_set

#: The tokenizer never joins characters across these bytes, so words between them are encoded once.
_GAP = byte_set(lambda b: b not in b" \t\n\r")
#: Tokens of a partition of the first round.
FIRST_TOKENS = 250_000
#: Distinct words remembered by a worker; beyond that it starts anew.
CACHE_WORDS = 2_000_000


class WordTokens:
    """Token ids of texts by way of their distinct words, each encoded once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, h: np.ndarray, texts: list[str]) -> None:
        lengths, ids = [], [self.ids]
        for k in range(0, len(texts), 2000):  # an encoding is large beside its ids
            part = [x.ids for x in self.tokenizer.encode_batch_fast(texts[k : k + 2000], add_special_tokens=False)]
            lengths += map(len, part)
            ids.append(np.fromiter(chain.from_iterable(part), np.uint32))
        length = np.array(lengths, np.int64)
        at = np.searchsorted(self.keys, h)  # h is in order, so this merges
        self.begin = np.insert(self.begin, at, len(self.ids) + np.cumsum(length) - length)
        self.length = np.insert(self.length, at, length)
        self.keys = np.insert(self.keys, at, h)
        self.ids = np.concatenate(ids)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and n + 1 offsets into them."""
        starts, ends, doc = words(raw, off, _GAP)
        h = span_hashes(raw, starts, ends)
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, u)
        known = np.zeros(len(u), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == u[inside]
        if not known.all():
            data = raw.tobytes()
            new = first[~known]
            self.learn(u[~known], [data[starts[i] : ends[i]].decode() for i in new])
            at = np.searchsorted(self.keys, u)
        n = self.length[at][inv]
        total = np.cumsum(n)
        inner = np.arange(int(n.sum())) - np.repeat(total - n, n)
        ids = self.ids[np.repeat(self.begin[at][inv], n) + inner] if len(n) else np.zeros(0, np.uint32)
        per_doc = np.bincount(doc, n, len(off) - 1).astype(np.int64) if len(n) else np.zeros(len(off) - 1, np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_doc)])


@lru_cache(maxsize=1)
def word_tokens(source: str | Callable[[], str]) -> WordTokens:
    return WordTokens(source() if callable(source) else source)


def pieces(docs: DataFrame, tokenizer: str | Callable[[], str], size: int = 2048, end: int = 0) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32. Narrow: no shuffle.

    tokenizer: the vocabulary file's path on every worker, or a function that finds it there.
    """

    def run(batches):
        model = word_tokens(tokenizer)
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            names = batch.column(0).to_numpy(zero_copy_only=False) if batch.column(0).null_count == 0 else None
            for i, j in slices(off):
                ids, at = model.encode(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                data, rows = ids.astype("<u4"), []
                for d in range(j - i):
                    own = np.append(data[at[d] : at[d + 1]], np.uint32(end)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), size)):
                        part = own[s : s + size]
                        rows.append((d + i, p, s, len(part), zlib.crc32(part.tobytes())))
                cols = list(zip(*rows, strict=True))
                which = np.array(cols[0])
                ident = pa.array(names[which]) if names is not None else batch.column(0).take(pa.array(which))
                yield pa.RecordBatch.from_arrays([ident.cast(pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, decreasing: bin and offset of each item, and what each bin holds."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, held = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    at_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms: list[int] = []  # rooms left that some bin has, sorted
    for i in order:
        n = int(lengths[i])
        k = bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = at_room[room].pop()
            if not at_room[room]:
                rooms.pop(k)
            offsets[i] = held[b]
            held[b] += n
        else:
            b = len(held)
            held.append(n)
        bins[i] = b
        room = size - held[b]
        if room:
            if not at_room[room]:
                insort(rooms, room)
            at_room[room].append(b)
    return bins, offsets, np.array(held, np.int64)


def pack(found: DataFrame, size: int = 2048, slack: int = 16, fan_in: int = 8, first: int | None = None, gain: float = 0.001) -> DataFrame:
    """found (with a column length) with sequence_id and offset.

    slack: a bin is done when no more than so many tokens are free. fan_in: partitions
    whose open bins meet in one task of the next round. first: partitions of the first
    round (default: by FIRST_TOKENS). gain: rounds end when they could save no more than
    this share of all bins.
    """
    names = [c for c in found.columns if c not in ("sequence_id", "offset")]
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    rows = save(found.select(*names, F.monotonically_increasing_id().alias("__row")), "pieces")
    total = rows.agg(F.sum("length")).first()[0] or 0
    parts = first or -(-total // FIRST_TOKENS) or 1
    spread = rows.withColumn("__part", F.pmod(F.xxhash64("__row"), F.lit(parts)).cast("int"))

    def local(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__row", ignore_index=True)  # the same bins if the task runs again
        b, o, held = best_fit(pdf["length"].to_numpy(), size)
        pdf["__bin"], pdf["offset"], pdf["__held"] = b + (int(key[0]) << 32), o, held[b]
        return pdf

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", __row long, __part int, __bin long, offset long, __held long"
    placed = save(spread.groupBy("__part").applyInPandas(local, schema).drop("__row"), "bins-0")
    heads = placed.where("offset = 0").dropDuplicates(["__bin"])  # a row for each bin
    bins = heads.count()
    # where (b, o) each open bin of the first round now lies
    opened = save(heads.where(F.col("__held") < size - slack).select("__bin", F.col("__bin").alias("b"), F.lit(0).cast("long").alias("o"), F.col("__held").alias("held"), "__part"), "open-0")
    done, level, width = [], 0, parts

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b", ignore_index=True)
        b, o, held = best_fit(pdf["held"].to_numpy(), size)
        top = pdf["b"].to_numpy()
        name = np.full(len(held), np.iinfo(np.int64).max)
        np.minimum.at(name, b, top)  # a new bin takes the least name of those in it
        return pd.DataFrame({"b": top, "b2": name[b], "add": o, "held2": held[b]})

    while width > 1:
        seen = opened.where("b = __bin").agg(F.min("held").alias("least"), F.coalesce(F.sum((F.col("held") * 2 <= size).cast("long")), F.lit(0)).alias("small")).first()
        if seen.small <= gain * bins:
            break
        can = F.col("held") <= size - seen.least
        done.append(opened.where(~can))
        opened = opened.where(can)
        level, width = level + 1, -(-width // fan_in)
        # the bin that gives a merged bin its name stands for it
        tops = opened.where("b = __bin").select("b", "held", F.floor(F.col("__part") / (fan_in**level)).cast("int").alias("__g"))
        moved = tops.groupBy("__g").applyInPandas(merge, "b long, b2 long, add long, held2 long")
        opened = opened.join(moved, "b").select("__bin", F.col("b2").alias("b"), (F.col("o") + F.col("add")).alias("o"), F.col("held2").alias("held"), "__part")
        opened = save(opened, f"open-{level}")
        done.append(opened.where(F.col("held") >= size - slack))
        opened = opened.where(F.col("held") < size - slack)
    where = opened
    for part in done:
        where = where.unionByName(part)
    where = where.where("b <> __bin or o <> 0").select("__bin", "b", "o")
    out = placed.join(where, "__bin", "left")
    return out.select(*names, F.coalesce("b", "__bin").alias("sequence_id"), (F.col("offset") + F.coalesce("o", F.lit(0))).alias("offset"))
