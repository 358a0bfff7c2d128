"""Personal data: base patterns, and terms that disclose the persons they stand by.

Base spans come from patterns and checks (Luhn, digits, ranges). The method then treats
every base match as a protected entity. Terms in a window around the matches are measured
on the whole corpus: n(t) the texts that have the term, n(e) those that have the entity,
n(e, t) those with both. A term discloses an entity as far as its pointwise mutual
information with it, log2(N n(e,t) / (n(e) n(t))), comes near the entity's own information,
log2(N / n(e)); beyond a threshold share of it, and with enough texts in support, the term
is a span of its own ("term"). Terms that give nearly all of it away are removed, the others
generalised to the class of word they are of. Keyed secrets (password=..., api_key: "...") are entities whose
value, quoted or bare, is protected itself ("secret"). Base spans always stay; a term span that meets one goes.

DataFrame and SQL functions only. Offsets are code points, end exclusive. Null text counts
as empty. Repeated rows and null ids are treated row by row; corpus counts are by distinct
text, so copies give no support. An empty table gives no rows. Ties don't arise, as a term
is judged by its largest share. Very long texts are read whole; lists of matches are built
in runs, so their cost is in proportion to their number. Columns whose names clash with
results (s_<kind>, term_share, __t) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, text_key

# The patterns of the contract. Runs are entered only where they begin, or
# where the match before ended, and never given back, which changes no match.
PATTERNS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
#: The whole value, however long: to its closing quotation mark on the line, else (none, or unclosed) to what cannot be in a bare value.
SECRET = (
    r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\\?[\"']?\s{0,3}[=:]\s{0,3}"
    r"(?:\"(?:[^\"\\\r\n]|\\[^\r\n]){4,}+\"|'(?:[^'\\\r\n]|\\[^\r\n]){4,}+'|\\?[\"']?[^\s\"'<>,;]{4,}+)"
)
KINDS = ("email", "ip", "card", "phone", "secret", "term")


_SPANS = "array<struct<s:int,e:int,v:string>>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(numbers: Column, op) -> Column:
    """Running totals by op, from 0 on, of an array of numbers.

    In blocks of about the cube root of its length n, so the cost is about n ** (4 / 3)
    scalar steps; an aggregate that grows an array would copy it at each step.
    """
    total = lambda part: F.aggregate(part, F.lit(0), op)
    block = lambda x, i: F.slice(x.l, i * x.w + 1, x.w)
    split = lambda n: F.struct(n.alias("l"), F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(n)))).cast("int").alias("w"))
    sums = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x.l) - 1) / x.w).cast("int"))), lambda i: total(block(x, i)))
    before = lambda s: F.transform(s, lambda _, i: total(F.slice(s, F.lit(1), i)))

    def each(x, p):
        def one(_, i):
            b = F.floor(i / x.w).cast("int")
            return op(F.get(p, b), total(F.slice(x.l, b * x.w + 1, i - b * x.w + 1)))

        return F.transform(x.l, one)

    return _let(numbers, lambda n: _let(split(n), lambda x: _let(sums(x), lambda s: _let(before(s), lambda p: each(x, p)))))


def _matches(text: str, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, from what lies between them."""
    values = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    between = F.split(F.col(text), pattern, -1)

    def ends(x):
        return _running(F.zip_with(F.slice(x.b, F.lit(1), F.size(x.v)), x.v, lambda b, v: F.length(b) + F.length(v)), lambda m, n: m + n)

    span = lambda v, e: F.struct((e - F.length(v)).alias("s"), e.alias("e"), v.alias("v"))
    return _let(F.struct(values.alias("v"), between.alias("b")), lambda x: F.zip_with(x.v, ends(x), span)).cast(_SPANS)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    d = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(d, lambda x, i: F.when(i % 2 == 0, x.try_cast("int")).otherwise(x.try_cast("int") * 2 - F.when(x.try_cast("int") > 4, 9).otherwise(0))),
        F.lit(0),
        lambda s, x: s + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    d = _digits(x.v)
    if kind == "ip":
        # leading zeros don't count towards a part's value
        return F.forall(F.split(x.v, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(p.try_cast("int"), F.when(F.regexp_replace(p, "^0+", "") == "", 0), F.regexp_replace(p, "^0+", "").try_cast("int")) <= 255))
    if kind == "card":
        return F.length(d).between(13, 19) & _luhn(d)
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda x: _valid(kind, x)


def _numbered(i: int):
    return lambda x: F.struct(F.lit(i).alias("k"), x.s.alias("s"), x.e.alias("e"), x.v.alias("v"))


def _written(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x.s.cast("string"), x.e.cast("string"))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __t (the text, null as empty) and an array column s_<kind> of (s, e, v) for each base kind and secrets."""
    d = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    none = F.array().cast(_SPANS)
    for kind, pattern, sign in PATTERNS:
        found = F.filter(_matches("__t", pattern), _checker(kind))
        may = F.col("__t").contains(sign) if sign else F.col("__t").rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
        d = d.withColumn(f"s_{kind}", F.when(may & F.col("__t").rlike("[0-9]|@"), found).otherwise(none))
    may = F.col("__t").rlike(r"(?i)(?:passw|pwd|secret|token|key)[a-z]{0,4}\\?[\"']?\s{0,3}[=:]")
    return d.withColumn("s_secret", F.when(may, _matches("__t", SECRET)).otherwise(none))


def _all(kinds: tuple[str, ...]) -> Column:
    return F.flatten(F.array(*[F.transform(f"s_{k}", _numbered(i)) for i, k in enumerate(kinds)]))


_WORD = r"[\p{L}\p{N}]+"


def disclosing_candidates(spans: DataFrame, window: int = 60, support: int = 3, least_length: int = 3) -> DataFrame:
    """entity, term, n_both, n_entity: terms that stand near an entity in `support` distinct texts or more.

    window: characters on either side of a match within which terms are looked for. Copies
    and near copies of one passage don't count as support: the words on both sides of a
    term must differ in most of the texts.
    """
    some = spans.select(F.xxhash64("__t").alias("key"), "__t", _all(KINDS[:5]).alias("found")).dropDuplicates(["key"])
    each = some.select("key", "__t", F.explode("found").alias("x")).select("key", "__t", F.lower("x.v").alias("entity"), "x.s", "x.e")
    before = F.expr(f"lower(substring(__t, greatest(s - {window}, 0) + 1, s - greatest(s - {window}, 0)))")
    after = F.expr(f"lower(substring(__t, e + 1, {window}))")
    near = F.concat(F.regexp_extract_all(before, F.lit(_WORD), F.lit(0)), F.array(F.lit("")), F.regexp_extract_all(after, F.lit(_WORD), F.lit(0)))
    # each word with its neighbours; the outermost may be cut by the window's edge and are neighbours only
    triples = F.transform(
        F.sequence(F.lit(1), F.size("near") - 2),
        lambda i: F.struct(F.get("near", i).alias("term"), F.xxhash64(F.get("near", i - 1), F.get("near", i + 1)).alias("place")),
    )
    each = each.select("key", "entity", near.alias("near")).where("size(near) >= 3")
    pairs = each.select("key", "entity", F.explode(triples).alias("x")).select("key", "entity", "x.*")
    pairs = pairs.where((F.length("term") >= least_length) & F.col("term").rlike(r"^\p{L}")).groupBy("key", "entity", "term").agg(F.min("place").alias("place"))
    joint = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.count_distinct("place").alias("places"))
    joint = joint.where((F.col("places") >= support) & (F.col("places") >= 0.6 * F.col("n_both")))
    entities = each.select("key", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    return joint.join(entities, "entity")


def term_places(spans: DataFrame, terms: DataFrame) -> DataFrame:
    """(k1, k2, term): which texts of the whole corpus have which of the terms, by distinct text."""
    k1, k2 = text_key(F.col("__t"))
    every = spans.select(k1.alias("k1"), k2.alias("k2"), F.explode(F.array_distinct(F.split(F.lower("__t"), r"[^\p{L}\p{N}]+"))).alias("term"))
    return every.join(terms.select("term").distinct(), "term", "left_semi").distinct()


def find(docs: DataFrame, text: str = "text", support: int = 3, share: float = 0.8) -> DataFrame:
    """docs with the column __t, array columns s_<kind> of (s, e, v) for all KINDS, and term_share (term, share).

    support: distinct texts in which entity and term must meet. share: the threshold of
    disclosure, as a share of the entity's own information. term_share: how much of an entity's
    information each term span gives away, at most 1.
    """
    spans = base_spans(docs, text)
    hot = spans.where("size(s_email) + size(s_ip) + size(s_card) + size(s_phone) + size(s_secret) > 0")
    hot = save(hot.select("__t", *[f"s_{k}" for k in KINDS[:5]]), "entities")
    joint = save(disclosing_candidates(hot, support=support), "joint")
    none = {"s_term": F.array().cast(_SPANS), "term_share": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))}
    if joint.limit(1).count() == 0:
        return spans.withColumns(none)
    total = spans.select(F.xxhash64("__t").alias("h")).distinct().count()

    def telling_of(counts: DataFrame) -> DataFrame:
        pmi = F.log2(F.lit(total) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
        known = joint.join(counts, "term").withColumn("share", pmi / F.log2(F.lit(total) / F.col("n_entity")))
        return known.where(F.col("share") >= share)

    # n(t) among the texts with entities is a lower bound of n(t): what fails by it fails, so common words never reach the corpus
    bound = term_places(hot.select("__t"), joint).groupBy("term").agg(F.count("*").alias("n_term"))
    joint = save(telling_of(bound).drop("n_term", "share"), "joint-bounded")
    if joint.limit(1).count() == 0:
        return spans.withColumns(none)
    places = save(term_places(spans.select("__t"), joint), "places")
    counts = places.groupBy("term").agg(F.count("*").alias("n_term"))
    telling = telling_of(counts).groupBy("term").agg(F.least(F.max("share"), F.lit(1.0)).alias("share"))
    told = places.join(telling, "term").groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("terms"))  # no more than a text's terms
    told = save(told.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("terms").alias("__terms")), "telling")
    k1, k2 = text_key(F.col("__t"))
    out = spans.withColumns({"__k1": k1, "__k2": k2}).join(told, ["__k1", "__k2"], "left")
    base = _all(KINDS[:5])
    marked = F.filter(_matches("__t", _WORD), lambda x: F.map_contains_key("__terms", F.lower(x.v)))
    free = F.filter(marked, lambda x: ~F.exists(base, lambda b: (b.s < x.e) & (x.s < b.e)))
    some = F.col("__terms").isNotNull()
    found = {"s_term": F.when(some, free).otherwise(none["s_term"]), "term_share": F.when(some, F.col("__terms")).otherwise(none["term_share"])}
    return out.withColumns(found).drop("__k1", "__k2", "__terms")


def listing(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans by kind, then start, comma-joined."""
    parts = [F.transform(f"s_{k}", _written(k)) for k in kinds]
    return F.array_join(F.flatten(F.array(*parts)), ",")


def _class(v: Column) -> Column:
    """What a term is generalised to: a number, a name (it begins with a capital letter) or a word."""
    return F.when(v.rlike(r"\p{N}"), "[NUMBER]").when(v.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")


def sanitise(found: DataFrame, text: str = "text", remove: float = 0.95) -> DataFrame:
    """Replaces `text`: each base span and secret by its kind in brackets; terms that disclose `remove` of an entity's
    information or more by [TERM], and those that disclose less by the class of word they are of.
    Of spans that overlap the first goes in, and the text of the others goes with it."""
    label = lambda k: lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.lit(f"[{k.upper()}]").alias("r"))
    gone = lambda x: F.try_element_at("term_share", F.lower(x.v)) >= remove
    terms = F.transform("s_term", lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.when(gone(x), "[TERM]").otherwise(_class(x.v)).alias("r")))
    spans = F.array_sort(F.flatten(F.array(*[F.transform(f"s_{k}", label(k)) for k in KINDS[:5]], terms)))

    def rest(x):
        """The text between spans that don't overlap, each with its replacement, and the text after the last."""
        part = lambda y, before: F.when(y.s >= before, F.concat(F.substr("__t", before + 1, y.s - before), y.r)).otherwise("")
        before = lambda m: F.concat(F.array(F.lit(0)), F.slice(m, F.lit(1), F.size(m) - 1))
        return F.concat(F.array_join(F.zip_with(x.l, before(x.m), part), ""), F.substr("__t", F.get(x.m, F.size(x.m) - 1) + 1))

    reach = lambda l: F.struct(l.alias("l"), _running(F.transform(l, lambda y: y.e), lambda m, n: F.greatest(m, n)).alias("m"))
    done = _let(spans, lambda l: F.when(F.size(l) > 0, _let(reach(l), rest)))
    return found.withColumn(text, F.coalesce(done, F.col(text)))
