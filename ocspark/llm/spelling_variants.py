"""Spelling variants: words at distance one, found by walking parts of the vocabulary's trie with active nodes.

Words are runs of letters, counted over all texts; a keyed hash deletes one letter of some
occurrences (planted slips). Two words are near if one inserted, deleted or replaced code
point makes one of the other. A word's form is its commonest near word, if that is much commoner.

The trie is partitioned by prefix. Words of c and c + 1 code points meet by windows of
positions [lo, hi) in which the edit falls: those that agree before lo and after hi hang
below one node, reached by the prefix and, from the other end, by the suffix. At first each
word has the two halves of both lengths it can meet, so an edit inside the prefix is met below
the suffix. A node with too many words is cut into its window's halves, again and again; a
window of one position holds only what one or two letters can spell. Each task builds the trie below a node
and walks it depth first: the active nodes of a child come from those of its parent
(a letter deleted, replaced, inserted or matched, at most one edit in all), and terminal
nodes among them are the pairs. A pair counts in the one window that has the first
position where its words differ.

Null text has no words; a null id is written as nothing in the hash; rows with equal ids or
texts count each. Of forms with equal counts the smallest in code-point order is taken. Very
long words take no special path: a node of one word makes no trie. No rows, or no word that is frequent enough,
give no rows. Columns of docs other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, n: the words of at least least_length code points and least_count occurrences.

    every: one in so many (id, run) pairs has a code point deleted.
    """
    lower = F.translate(F.col(text), _UPPER, _UPPER.lower())
    # a shorter run cannot make a word that is long enough
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    found = hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _placed(rows: DataFrame, windows: Column) -> DataFrame:
    """word, n, c, lo, hi and the node of each of the windows."""
    rows = rows.select("word", "n", "c", F.explode(windows).alias("x")).select("word", "n", "c", "x.lo", "x.hi")
    after = F.col("c") - F.col("hi")
    ends = F.concat(F.substring("word", F.lit(1), F.col("lo")), F.lit("\0"), F.substring("word", F.length("word") - after + 1, after))
    return rows.withColumn("node", F.concat_ws("\0", "c", "lo", "hi", ends))


def _halves(lo: Column, hi: Column) -> Column:
    mid = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))


def partition(words: DataFrame, most: int = 1000) -> DataFrame:
    """word, n, c, lo, hi, node: each word below the nodes where it can meet near words, at most about `most` words a node.

    Every pair of near words meets below the node of the window that holds their first difference.
    """
    length = F.length("word")
    least = words.agg(F.min(length)).first()[0] or 0
    each = words.withColumn("c", F.explode(F.array(length, length - 1))).where(F.col("c") >= least)  # words of c + 1 meet words of c, if there are any
    todo, done = _placed(each, _halves(F.lit(0), F.col("c"))), []
    while True:
        hot = save(todo.where("hi - lo > 1").groupBy("node").agg(F.count("*").alias("k")).where(F.col("k") > most).select("node"), "hot-nodes")
        n = hot.count()
        if n and n <= 10_000:  # names of hot nodes, a bounded number of them
            hot = F.broadcast(hot)
        done.append(todo.join(hot, "node", "left_anti") if n else todo)
        if not n:
            break
        todo = _placed(todo.join(hot, "node", "left_semi"), _halves(F.col("lo"), F.col("hi")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def below(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of different texts at distance one, each once: their trie, walked with active nodes."""
    child: list[dict[str, int]] = [{}]
    end = [-1]
    for i, text in enumerate(texts):
        at = 0
        for c in text:
            to = child[at].get(c)
            if to is None:
                to = child[at][c] = len(child)
                child.append({})
                end.append(-1)
            at = to
        end[at] = i
    todo: list[tuple[int, list[int]]] = [(0, list(child[0].values()))]  # a node and its active nodes at distance one
    while todo:
        at, active = todo.pop()
        if end[at] >= 0:
            yield from ((end[at], end[v]) for v in active if end[v] > end[at])
        for c, to in child[at].items():
            near = {at, *(v for k, v in child[at].items() if k != c), *child[to].values()}  # c deleted, replaced, or something inserted after it
            near.update(v for u in active if (v := child[u].get(c)) is not None)  # c matched
            near.discard(to)
            todo.append((to, list(near)))


def _pairs(c: int, lo: int, hi: int, words: list[str], counts: list[int]) -> Iterator[tuple[str, int, str, int]]:
    """The near pairs of a node that belong to its window."""
    if len(words) < 2 or min(map(len, words)) > c:
        return
    inner = [w[lo : len(w) - (c - hi)] for w in words]
    for i, j in below(inner):
        if min(len(words[i]), len(words[j])) == c and (hi == c or lo + len(commonprefix((inner[i], inner[j]))) < hi):
            yield words[i], counts[i], words[j], counts[j]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows that come sorted by node; a node may go on in the next batch."""
    node, words, counts, found = None, [], [], []

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.int64()) * 2, strict=True)], ["word", "n", "other", "n_other"])
        found.clear()
        return out

    def close():
        if node is not None:
            c, lo, hi, _ = node.split("\0", 3)
            found.extend(_pairs(int(c), int(lo), int(hi), words, counts))

    for b in batches:
        for x, w, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if x != node:
                close()
                node, words, counts = x, [], []
                if len(found) > 50_000:
                    yield flush()
            words.append(w)
            counts.append(n)
    close()
    if found:
        yield flush()


def near_words(words: DataFrame, most: int = 1000) -> DataFrame:
    """word, n, other, n_other: each pair of words (distinct, with n) at distance one, once."""
    rows = partition(words, most).select("node", "word", "n")
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(_walk, "word string, n long, other string, n_other long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of each word's forms. Chains double in each round; counts rise along them, so they end."""
    links = save(forms.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        to = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = save(links.join(to, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if links.where("moved").isEmpty():
            return links.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 5, most: int = 1000) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word. ratio: a form occurs at least so many times as often."""
    words = save(words.select("word", "n"), "words")
    pairs = near_words(words, most)
    both = pairs.select(F.explode(F.array(F.struct("word", F.struct((-F.col("n_other")).alias("m"), "other").alias("best")), F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("m"), F.col("word").alias("other")).alias("best")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    found = words.join(best, "word", "left").withColumn("form_n", -F.col("best.m"))
    good = F.col("form_n") >= ratio * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    found = save(found, "forms")
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
