"""The queries opN_<name> over the test tables, and their SQL for comparison where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, near_dedup, packing, paragraph_dedup, pii, quality_classifier, quality_rules, secret_scan, spelling_variants, substring_dedup, toxicity, whitening
from .common import save

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    weights, bias = quality_classifier.fit(documents, labels)
    out = quality_classifier.score_texts(documents.select("doc_id", "text"), weights, bias)
    return out.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = save(quality_rules.signals(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "signals")
    out = quality_rules.judge(found, quality_rules.fit(found))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    out = toxicity.score_toxicity(documents.select("doc_id", "text"), toxicity.fit(documents, labels))
    return out.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


#: Vocabulary of op8.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path)
    return packing.pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    out = out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near_items"))
    return out


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = pii.KINDS[:4]
    return found.select("doc_id", *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in base], F.sha2(pii.listing(base), 256).alias("base_sha256"), pii.listing(pii.KINDS).alias("spans"))


@query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its class, the least doc_id in it, and whether it stays."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


@query
def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each occurrence of a paragraph that repeats: where it is, its class by the place of the first, whether it goes."""
    out = paragraph_dedup.repeated_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "start", "length", "class_doc_id", "class_start", "removed")


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE["op4_decontamination"] = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bk as (select item_id, w, least(13, len(w)) as k from b where len(w) > 0),
bw as (select distinct item_id, k, list_slice(w, i, i + k - 1) as win from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from bk) x),
dw as (select doc_id, k, i, list_slice(w, i, i + k - 1) as win from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d cross join (select distinct k from bw) ks where len(w) >= k) x),
m as (select dw.doc_id, dw.i, dw.k, bw.item_id, bw.win from dw join bw on dw.k = bw.k and dw.win = bw.win),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from m) x group by doc_id),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from m group by doc_id),
pos as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
cnt as (select word, count(*) as n from pos group by word),
u as (select win, k, row_number() over () as wid from (select distinct win, k from bw) x),
at0 as (select wid, unnest(win) as word, unnest(range(0, k)) as ofs from u),
a as (select wid, word, ofs, row_number() over (partition by wid order by n, ofs) - 1 as rk from (select x.wid, x.word, x.ofs, c.n from at0 x join cnt c on c.word = x.word) y
  where wid in (select x.wid from at0 x left join cnt c on c.word = x.word group by x.wid having count(c.n) >= 0.75 * count(*))),
c0 as (select p.doc_id, a.wid, p.i - a.ofs as s from pos p join a on a.word = p.word where a.rk = 0),
c1 as (select p.doc_id, a.wid, p.i - a.ofs as s from pos p join a on a.word = p.word where a.rk = 1),
q as (select distinct c0.doc_id, c0.wid, c0.s from c0 join u on u.wid = c0.wid left join c1 on c1.doc_id = c0.doc_id and c1.wid = c0.wid and abs(c0.s - c1.s) <= 4 where u.k = 1 or c1.s is not null),
r as (select distinct q.doc_id, u.wid, u.win, u.k, list_slice(d.w, greatest(q.s - 4, 1), q.s + u.k + 3) as sl from q join u on u.wid = q.wid join d on d.doc_id = q.doc_id),
n as (select distinct doc_id, wid, win from r where list_sum(list_transform(list_distinct(win), lambda x : least(len(list_filter(win, lambda y : y = x)), len(list_filter(sl, lambda z : z = x))))) >= 0.75 * k),
ni as (select n.doc_id, count(distinct bw.item_id) as n_near from n join bw on bw.win = n.win
  where not exists (select 1 from m where m.doc_id = n.doc_id and m.item_id = bw.item_id) and not exists (select 1 from m where m.doc_id = n.doc_id and m.win = n.win) group by n.doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items, sha256(coalesce(t.items, '')) as items_sha256,
  coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(d.w) as contaminated, coalesce(ni.n_near, 0) as n_near_items
from d left join h on d.doc_id = h.doc_id left join t on d.doc_id = t.doc_id left join ni on ni.doc_id = d.doc_id
"""


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each word, with the number of words near it, its form and its root."""
    words = spelling_variants.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling_variants.group_variants(words)


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a repository of its source, which is the owner."""
    out = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    n = {f"n_{k}": secret_scan.count(i) for i, k in enumerate(secret_scan.KINDS)} | {f"n_{v}_values": secret_scan.count(verdict=v) for v in ("example", "live", "weak")}
    return out.select("doc_id", *[v.alias(k) for k, v in n.items()], F.sha2(secret_scan.listing(3), 256).alias("base_sha256"), secret_scan.listing().alias("spans"))


def _matches(kind: int, pattern: str, group: int) -> str:
    """Matches of a pattern with places, from what lies between them; v: the whole match or its group."""
    return f"""select r, doc_id, source, {kind} as kind, s, s + len(m) as e, v from (select r, doc_id, source, w[i] as m, g[i] as v, list_sum(list_transform(p[1:i], lambda x : len(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x : len(x))), 0) as s
      from (select r, doc_id, source, w, g, p, unnest(range(1, len(w) + 1)) as i from (select r, doc_id, source, regexp_extract_all(t, '{pattern}') as w, regexp_extract_all(t, '{pattern}', {group}) as g, string_split_regex(t, '{pattern}') as p from d where regexp_matches(t, '{pattern}')) x) y) z"""


_ANY_CASE = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api") + "_?[Kk][Ee][Yy]"
_ASSIGN = rf"""(?:{_ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ORACLE["op13_secret_scan"] = rf"""with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
b as (select * from ({_matches(0, _ASSIGN, 1)}) a where len(v) >= 6 union all {_matches(1, 'AKIA[A-Z0-9]{16,}', 0)} union all {_matches(2, '[0-9a-f]{24,}', 0)}),
c as (select *, len(list_distinct(string_split(v, ''))) >= 8 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') as varied
  from (select * from b union all select o.* from ({_matches(3, '[A-Za-z0-9+/_=-]{20,}', 0)}) o where not exists (select 1 from b where b.r = o.r and b.s < o.e and o.s < b.e)) q),
k as (select * from c where kind < 3 or varied),
n as (select v, count(distinct coalesce(source, chr(1))) as owners from k group by v),
j as (select k.*, case when n.owners >= 3 then 'example' when varied then 'live' else 'weak' end as verdict, concat(['assign', 'access', 'hex', 'live'][kind + 1], ':', s, ':', e) as span from k join n on n.v = k.v),
f as (select * from j where kind < 3 or verdict = 'live')
select d.doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, count(*) filter (kind = 3) as n_live, count(*) filter (verdict = 'example') as n_example_values,
  count(*) filter (verdict = 'live') as n_live_values, count(*) filter (verdict = 'weak') as n_weak_values, sha256(coalesce(string_agg(span, ',' order by s, kind) filter (kind < 3), '')) as base_sha256, coalesce(string_agg(span, ',' order by s, kind), '') as spans
from d left join f on f.r = d.r group by d.r, d.doc_id"""
