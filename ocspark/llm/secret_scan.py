"""Secrets: patterns, then ownership frequency over the corpus, which tells examples from live credentials.

Candidates are the values of assignments, access keys and long hexadecimal runs (base kinds,
fixed by pattern) and opaque tokens: runs of 20 or more characters with letters and digits
of many kinds, which might be credentials of any service. Each candidate's hash is counted
over the whole corpus by distinct repositories and distinct owners. What many owners have is
a copied example; what few have and looks random is live: owner-specific. Base spans always
stay; opaque tokens that are live are spans of their own ("live"), unless they meet a base span.

Offsets are code points, end exclusive. Null and empty texts have no spans. A null owner or
repository counts as one of its own. Copies within one repository count once. Rows with null or
repeated ids are treated row by row. Whole texts are scanned, in time proportional to
their length but for one factor of 20 for runs of token characters. No rows give no rows. Columns whose names clash with results (found)
are replaced; the text itself is not returned, as it isn't moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

# The patterns of the contract, with the least length of what they take.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "live")

#: Tokens that might be a credential of any service.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.string()), ("varied", pa.bool_())]))


def varied(value: str, kinds: int = 8) -> bool:
    """Whether a value looks random: letters, digits, and many different characters."""
    return len(set(value)) >= kinds and bool(re.search("[0-9]", value)) and bool(re.search("[A-Za-z]", value))


def candidates(text: str) -> list[tuple[int, int, int, str, bool]]:
    """(start, end, kind, value, varied) of a text's candidates by start, then kind; opaque tokens only where no base span is."""
    base = [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    base += [(m.start(), m.end(), i, m[0]) for i, p in ((1, ACCESS), (2, HEX)) for m in p.finditer(text)]
    base.sort()
    free, i, reach = [], 0, 0
    for m in OPAQUE.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][1])
            i += 1
        if reach <= m.start() and varied(m[0]):
            free.append((m.start(), m.end(), 3, m[0]))
    return [(*x, varied(x[3])) for x in sorted(base + free)]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with `found`: its candidates, values as hashes."""
    others = [c for c in docs.columns if c not in (text, "found")]
    raw = "array<struct<start:int,end:int,kind:int,value:string,varied:boolean>>"
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [f"found {raw}"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("start", "end", "kind", "value", "varied"), x, strict=True)) for x in candidates(t)] if t else [] for t in b.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(others))), pa.array(found, _TYPE)], [*others, "found"])

    hashed = F.transform("found", lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind"), F.xxhash64(x.value).alias("hash"), x.varied.alias("varied")))
    return docs.select(*others, F.col(text)).mapInArrow(each, schema).withColumn("found", hashed)


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """hash, n_owners, n_repositories, over all candidates; a repository has one owner."""
    each = found.select(F.col(owner).cast("string").alias("o"), F.col(repository).cast("string").alias("r"), F.explode("found.hash").alias("hash"))
    by = each.distinct().groupBy("hash", "o").agg(F.count("*").alias("k"))
    return by.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("k").alias("n_repositories"))


def find_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", text: str = "text", owners: int = 3) -> DataFrame:
    """docs without the text, with found: structs (start, end, kind, n_owners, n_repositories, verdict) by start, then kind.

    kind: a number in KINDS. verdict: example (at least `owners` owners have it), live (fewer
    do and it looks random) or weak. Opaque tokens that aren't live are left out.
    """
    rows = save(scan(docs.withColumn("__row", F.monotonically_increasing_id()), text), "candidates")
    some = rows.where(F.size("found") > 0)
    counts = save(ownership(some, repository, owner), "ownership")
    each = some.select("__row", F.explode("found").alias("x")).select("__row", "x.*").join(counts, "hash")
    verdict = F.when(F.col("n_owners") >= owners, "example").when(F.col("varied"), "live").otherwise("weak")
    each = each.withColumn("verdict", verdict).where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    judged = each.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repositories", "verdict"))).alias("found"))  # no more than a text's own
    out = rows.drop("found").join(judged, "__row", "left").drop("__row")
    return out.withColumn("found", F.coalesce("found", F.array().cast(judged.schema["found"].dataType)))


def listing(kinds: int = len(KINDS), found: str = "found") -> Column:
    """kind:start:end of the spans of the first kinds, by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.filter(found, lambda x: x.kind < kinds), lambda x: F.concat_ws(":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")


def count(kind: int | None = None, verdict: str | None = None, found: str = "found") -> Column:
    return F.size(F.filter(found, lambda x: (F.lit(kind is None) | (x.kind == kind)) & (F.lit(verdict is None) | (x.verdict == verdict)))).cast("long")
