"""Helpers shared by the training-data operators: shared-folder tables, byte-level tokenising, components.

Texts reach Python as Arrow batches. A batch is cut into slices of a few MB so that the
numpy arrays made from it stay small; a longer text forms a slice of its own, whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import save

#: Bytes of text that are tokenised at once.
SLICE_BYTES = 4 << 20

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240601).integers(1, 2**64 - 1, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about limit bytes in all."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def byte_set(pattern: Callable[[int], bool]) -> np.ndarray:
    return np.array([bool(pattern(b)) for b in range(256)])


#: Bytes outside ASCII white space.
NOT_SPACE = byte_set(lambda b: b not in b" \t\n\x0b\x0c\r")
#: Letters, digits and all bytes of characters beyond ASCII.
ALNUM = byte_set(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: A-Z to a-z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def words(raw: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of bytes of the set `inside`, which never cross texts."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = inside[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    before = np.empty(len(m), bool)
    before[0] = False
    before[1:] = m[:-1]
    starts = np.flatnonzero(m & (~before | first[:-1]))
    after = np.empty(len(m), bool)
    after[-1] = False
    after[:-1] = m[1:]
    ends = np.flatnonzero(m & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 1024), _BASE | np.uint64(1), np.uint64)
        p[0] = 1
        _powers = np.cumprod(p)
    return _powers


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans must not overlap and must be in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    at = np.cumsum(n) - n
    inner = np.arange(int(n.sum())) - np.repeat(at, n)
    v = _BYTE[raw[inner + np.repeat(starts, n)]] * powers(int(n.max()) + 1)[inner]
    return mix(np.add.reduceat(v, at) + n.astype(np.uint64))


def word_counts(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def shingle_hashes(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words and their text numbers; fewer words, but not none, are one run."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(doc)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        part = np.zeros(n, np.uint64)
        part[: n - i] = h[i:]
        if i:
            inside = np.zeros(n, bool)
            inside[: n - i] = doc[i:] == doc[: n - i]
            part[~inside] = 0
        out = mix(out * np.uint64(3) + part + np.uint64(i))
    begin = np.cumsum(counts) - counts
    rank = np.arange(n) - begin[doc]
    whole = rank <= np.maximum(counts[doc] - k, 0)
    return out[whole], doc[whole]


def text_key(column) -> list:
    """Two columns that stand for a text: 128 bits, null as empty."""
    text = F.coalesce(column, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit("b"), text)]


def clashes(df: DataFrame, one: str, two: str) -> DataFrame:
    """The values of `one` that different values of `two` share, with the least of these. Hardly ever any."""
    found = df.groupBy(one).agg(F.min(two).alias("__least"), F.max(two).alias("__most"))
    return save(found.where("__least <> __most").select(one, "__least"), "clashes")


def settled(df: DataFrame, one: str, two: str, out: str, clash: DataFrame | None = None) -> DataFrame:
    """df with `out`, a 64-bit id that stands for the 128 bits of the columns one and two.

    It is `one` itself, but where different values of `two` share it (clash, by default
    looked for among all rows of df) all but the least get another.
    """
    clash = clashes(df, one, two) if clash is None else clash
    names = [c for c in df.columns if c != out]
    new = F.when(F.col("__least").isNull() | (F.col(two) == F.col("__least")), F.col(one)).otherwise(F.xxhash64(one, two, F.lit("again")))
    return df.join(clash, one, "left").select(*names, new.alias(out))


def with_text_id(docs: DataFrame, text: str = "text", out: str = "__id") -> DataFrame:
    """docs with `out`: an id of the text (null as empty), the same for equal texts alone."""
    k1, k2 = text_key(F.col(text))
    return settled(docs.withColumns({"__k1": k1, "__k2": k2}), "__k1", "__k2", out).drop("__k1", "__k2")


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (id, root), root the least id, for ids with an edge.

    Large-star and small-star contraction: each round is two shuffles with map-side
    minima, the number of rounds grows with the logarithm of a component's size, and
    nothing reaches the driver but a count and a fingerprint. Written to the shared folder each round.
    """
    spark = edges.sparkSession
    cur = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges")
    last = None  # rows and fingerprint of the round before
    for _ in range(rounds):
        both = cur.union(cur.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        new = save(small.where("a <> b").distinct(), f"{name}-round")
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        same, last = now == last, now
        cur = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = cur.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return save(roots.union(cur.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct(), f"{name}-roots")
