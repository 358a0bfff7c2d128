"""The ten operators on small fixtures: brute force, round trips, and the cases that each docstring defines."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ocspark.llm import decontaminate, html_extract, near_dedup, packing, paragraph_dedup, pii, quality_rules, substring_dedup, toxicity
from ocspark.llm.common import components, settled
from ocspark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, n_words long, kept string, k1 string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split()
    near[3] = "changed"
    passage = words(rng, 60)
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, words(rng, 300) + " " + passage + ". " + words(rng, 50)), (5, words(rng, 40) + ". " + passage + ". " + words(rng, 9)),
        (6, None), (7, ""), (8, "é ü \n\t x"), (None, words(rng, 30)), (9, "dup row"), (9, "dup row"), (10, ("same line here\n" * 40)), (11, words(rng, 3000)),
        (12, "mail a.b@c.org or +1 (212) 555-0100, 10.0.0.256 10.0.0.7 card 4111 1111 1111 1111 password=hunter22x"),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 99, "x", "y") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_html():
    page = "<html><head><title>T</title></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>Head</h1><p>One &amp; two<br>three<p>four <b>five</b></article><section id=comments><p>nice post</section><footer>c</footer>"
    assert html_extract.main_text(page) == "Head One & two three four five"
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("<div class=sidebar>x</div><p>" + "plain text " * 30) == ("plain text " * 30).strip()
    assert html_extract.main_text("just words") == "just words"


def test_html_layout_names_and_open_head():
    body = "<h1>Head</h1><p>" + "plain text " * 30 + "</p>"
    text = "Head " + ("plain text " * 30).strip()
    for tag in ('article class="post has-sidebar"', 'main class="with-sidebar"', 'article class="comments-open"'):
        assert html_extract.main_text(f"<body><nav>x</nav><{tag}>{body}</{tag.split()[0]}><div class=sidebar>side</div>") == text
    side = "<div class=sidebar>side</div><section id=comments><article class=comment><p>nice post</article></section>"
    for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div class=content-no-sidebar><article>{body}</article></div>"):
        assert html_extract.main_text(f'<body><div id=page class="no-sidebar">{inner}{side}</div>') == text
        assert html_extract.main_text(f"<body>{inner}{side}") == text
    assert html_extract.main_text(f'<body><div id=page class="no-sidebar"><div>{body}</div><div class=ad>buy</div></div>') == text  # no article: from the heading of the first line that reaches the threshold
    assert html_extract.main_text(f"<article>{body}<article class=comment><p>nice</article></article>") == text
    assert html_extract.main_text(f"<html><head><title>T</title><meta charset=utf-8><body><article>{body}</article>") == text
    assert html_extract.main_text(f"<html><head><title>T</title><script>x()</script><article>{body}</article>") == text
    assert html_extract.main_text("<head><title>T</title>just words") == "just words"


def test_html_threshold_decides():
    """Boxes of links go by the smoothed ratios, and so does what lies around the text of a page without landmarks."""
    para = "<p>" + "plain text of the article " * 12 + "</p>"
    links = "<div class=x>" + "".join(f"<p><a href=#>more of this {i}</a></p>" for i in range(8)) + "</div>"
    page = f"<body><article><h1>Head</h1>{para * 3}{links}{para * 2}</article>"
    assert "more of this" not in html_extract.main_text(page) and "more of this" in html_extract.main_text(page, spread=0.0)
    assert html_extract.main_text(page) == " ".join(["Head", *[("plain text of the article " * 12).strip()] * 5])
    table = "<table>" + "".join(f"<tr><td>{i}</td><td>{i * i}</td></tr>" for i in range(9)) + "</table>"
    assert "8 64" in html_extract.main_text(f"<body><main>{para}{table}{para}</main>")  # short lines aren't links
    bare = f"<body><div><p>Start</p><p>Here</p><p>Now</p><p>Then</p></div><div>{para * 3}</div><div><p>End</p><p>of</p><p>all</p><p>that</p></div>"
    assert html_extract.main_text(bare) == " ".join([("plain text of the article " * 12).strip()] * 3)
    assert html_extract.main_text(bare, spread=0.0).startswith("Start")


def test_html_names_hidden_and_nesting():
    para = "<p>" + "plain text " * 30 + "</p>"
    for tag in ("class='siteNav'", "class='articleFooter'", f"class='{'x' * 90}-sidebar'", "hidden='hidden'", "hidden", "style='color:red; display: none'", "aria-hidden=true"):
        assert html_extract.main_text(f"<body><main>{para}<div {tag}>gone</div></main>") == ("plain text " * 30).strip(), tag
    began = time.time()
    assert html_extract.main_text("<div>" * 40000 + "text" + "</div></i>" * 40000) == "text"
    assert time.time() - began < 20


def test_html_names_of_parts_of_an_article():
    para, text = "<p>" + "plain text " * 30 + "</p>", ("plain text " * 30).strip()
    for inner in ('<div class="search-method">', '<div class="comments-open">', '<div class="related">', "<div id=form><div class=sidebar-left>"):
        assert html_extract.main_text(f"<body><main>{inner}{para}{para}</div></main>") == f"{text} {text}", inner
    for part in ('<section class="related-work">', '<div class="alert">', '<section id="search-results-discussion-of-method">', '<div class="notice">'):
        assert html_extract.main_text(f"<body><article>{para}{part}{para}</section></div></article>") == f"{text} {text}", part
    links = "".join(f"<li><a href=#>more {i}</a></li>" for i in range(9))
    for part in ('<div class="related-posts">', '<div class="alert">', '<section class="user-feedback"><h3>Comments</h3>', '<div class="newsletter-box">'):
        assert html_extract.main_text(f"<body><article>{para * 2}{part}<ul>{links}</ul></section></div></article>") == f"{text} {text}", part
    assert html_extract.main_text(f"<body><article>{para}<table>{'<tr><td>1</td><td>2</td></tr>' * 3}</table><ul><li>one</li><li>two</li></ul></article>").endswith("1 2 1 2 1 2 one two")
    assert html_extract.main_text(f"<body><div><h1>Title</h1><p>By me</p>{para}</div>") == f"Title By me {text}"
    assert html_extract.main_text(f"<body><div><p>x</p><h2>Title</h2>{para}</div>") == f"Title {text}"


def test_html_is_read_in_time():
    for make in (
        lambda n: "<div class=ad>" * n + "text", lambda n: "<main>" + "<div class=ad>" * n + "text", lambda n: "<i><article>" + "<div>" * n + "</i>" * n, lambda n: "<section>" * n + "</p></section><p>" * n, lambda n: "<p>" + "<b>" * n + "<li></li>" * n,
        lambda n: "<div class=sidebar></div>" * n + "<article>text</article>", lambda n: "<article>" * n + "text",
    ):
        began = time.time()
        html_extract.main_text(make(8000))
        assert time.time() - began < 1.5, make(1)


def test_html_table(spark):
    rows = [(1, "<p>one two", "x"), (1, "<p>one two", "x"), (None, None, "y"), (2, "", None), (3, "<p>é &lt; \n ü", "z"), (4, "<p>" + "long words " * 200_000, "w")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_extract.extract_main_text(pages).collect()
    assert sorted((r.page_id or 0, r.text[:20], len(r.text)) for r in got) == [(0, "", 0), (1, "one two", 7), (1, "one two", 7), (2, "", 0), (3, "é < ü", 5), (4, "long words long word", 2_199_999)]
    assert got[0].asDict().keys() == {"page_id", "html", "text"} and html_extract.extract_main_text(pages.limit(0)).count() == 0


def brute_classes(rows):
    def bag(t):
        w = (t or "").split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    bags, root = [bag(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, total = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or total and both >= 0.8 * total:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return {frozenset(i for i, r in enumerate(root) if r == x) for x in set(root)}


def test_near_duplicates(docs, empty, texts):
    got = near_dedup.near_duplicates(docs).collect()
    classes = {}
    for r in got:
        classes.setdefault(r.class_key, []).append(r.text or "")
    expected = sorted(sorted((texts[i][1] or "") for i in c) for c in brute_classes(texts))
    assert sorted(sorted(c) for c in classes.values()) == expected
    assert near_dedup.keep_one(docs).count() == len(expected)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_prefix_pairs_are_complete_and_leave_boilerplate_out(spark):
    rng = random.Random(9)
    base = [words(rng, 70).split() for _ in range(6)]
    rows = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 2)] = [words(rng, 1)] * rng.randint(0, 2)
        rows.append((i, " ".join(w)))
    roots = spark.createDataFrame([(i, i) for i, _ in rows], "id long, root long")
    got = {(r.a, r.b) for r in near_dedup.prefix_pairs(spark.createDataFrame(rows, "id long, text string"), roots, 0.8, 5).collect()}
    bags = [Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for _, t in rows]
    near = {(i, j) for j in range(60) for i in range(j) if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())}
    assert near and near <= got
    boiler = words(rng, 100)
    many = spark.createDataFrame([(i, f"{boiler} {words(rng, 22)}") for i in range(3000)], "id long, text string")
    assert near_dedup.prefix_pairs(many, many.selectExpr("id", "id as root"), 0.8, 5).count() == 0


def test_settled_ids_tell_clashing_hashes_apart(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (1, 4), (2, 5), (3, 3)], "a long, b long")
    got = {}
    for r in settled(rows, "a", "b", "id").collect():
        got.setdefault(r.id, set()).add((r.a, r.b))
    assert all(len(x) == 1 for x in got.values()) and len(got) == 5 and got[1] == {(1, 4)}


def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**63, 300).astype(np.uint64)
    wa, wb = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    sig = near_dedup.bag_minhash(np.repeat([0, 1], 300), np.concatenate([h, h]), np.concatenate([wa, wb]), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04


def test_components(spark):
    got = components(spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (2, 2)], "a long, b long"), "t").collect()
    assert {r.id: r.root for r in got} == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}


def test_places_beyond_256_mebibytes():
    """Hash and place share 64 bits; places of the longest strings fit, and order equal hashes."""
    place = np.array([2**28 - 1, 2**28, 2**31 - 1], np.uint64)
    h = np.uint64(0xABCDEF0123456789)
    key = (h >> substring_dedup._PLACE << substring_dedup._PLACE) | place
    assert ((key & np.uint64(2**32 - 1)) == place).all() and (np.diff(key.astype(object)) > 0).all()


def test_anchor_parts_cover_each_window_once():
    rng = random.Random(3)
    for wide in (8, 1):
        for _ in range(50):
            size, n = 60, rng.randint(1, 28)
            context = bytes(rng.randrange(97, 123) for _ in range(size + n - 1))
            a = rng.randint(n - 1, 28)
            seen = []
            for i, _, a2, part in substring_dedup._parts(7, context, a, size, wide):
                assert a2 == a - i and context[i : i + len(part)] == part
                seen += range(i, i + len(part) - size + 1)
            assert seen == list(range(n))


def test_lists_of_structs_are_read_as_arrays():
    """Also of a part of a batch, and with empty lists."""
    lists = [[{"s": 9}], [{"s": 1}, {"s": 2}], [], [{"s": 3}], [{"s": 8}]]
    flat, cut = substring_dedup._flat(pa.array(lists, pa.list_(pa.struct([("s", pa.int32())]))).slice(1, 3))
    assert cut == [0, 2, 2, 3] and flat.field("s").to_pylist() == [1, 2, 3]


@pytest.mark.parametrize("most", [8000, 2, 0])
def test_substrings(docs, empty, texts, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MAX_CONTEXTS", most)
    size, data = 60, [(t or "").encode() for _, t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    expected = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = True
        left = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        expected.append((len(d), int(gone.sum()), int((gone & ~np.append([False], gone[:-1])[: len(gone)]).sum()), hashlib.sha256(left).hexdigest()))
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, size).collect()]
    assert sorted(got) == sorted(expected)
    assert substring_dedup.remove_repeats(empty, size).count() == 0


def test_decontamination(spark, docs, empty, texts):
    body = texts[3][1].split()
    bench = spark.createDataFrame([(1, " ".join(body[100:130])), (2, None), (3, "dup row"), (4, " ".join(body[5:17]) + " zzz"), (3, "Dup, ROW")], "item_id long, text string")
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {}
    for r in bench.collect():
        ws = w(r.text)
        k = min(13, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            windows.setdefault(tuple(ws[i : i + k]), set()).add(str(r.item_id))
    expected = []
    for _, t in texts:
        ws, hit, items = w(t), set(), set()
        for win, ids in windows.items():
            for i in range(len(ws) - len(win) + 1):
                if tuple(ws[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    items |= ids
        expected.append((len(ws), len(hit), tuple(sorted(items)), bool(hit) and 20 * len(hit) >= len(ws)))
    got = [(r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.contamination(docs, bench).collect()]
    assert sorted(got) == sorted(expected)
    near = spark.createDataFrame([("n", " ".join([*body[200:206], "other", *body[207:213]])), ("far", " ".join(reversed(body[200:213]))), (None, " ".join(body[20:40]))], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, near).collect()}
    assert got[4].near_items == ["n"] and got[4]["items"] == [] and got[4].n_hit == 20 and got[11].near_items == []
    assert sorted(r.doc_id or 0 for r in decontaminate.drop_contaminated(docs, bench).collect()) == sorted(i or 0 for (i, _), e in zip(texts, expected, strict=True) if not e[3])
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count()


def test_words_are_counted_in_batches(spark):
    """By bytes, as the pattern has them: at the edges of texts and slices, beyond ASCII, null and empty."""
    texts = ["ab", "cd e", None, "", "-", "é ü\u3000x", "a_b@c[d{e`f\x7fg", "9:9", "tail ", " head", "x" * 5_000_000, "y z" * 2_000_000, "end"]
    expected = [len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for t in texts]
    column = pa.array(["skipped", *texts])
    assert decontaminate._count_words(column.slice(1)).to_pylist() == expected
    assert decontaminate._count_words(column.slice(0, 0)).to_pylist() == []
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:10])], "doc_id long, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame([(1, "cd e")], "item_id long, text string"))
    assert [r.n_words for r in got.orderBy("doc_id").collect()] == expected[:10]
    assert "regexp_count" not in got._jdf.queryExecution().toString()


def test_pii(docs, empty):
    found = pii.find(docs)
    r = next(x for x in found.collect() if x.doc_id == 12)
    assert [x.v for x in r.s_email] == ["a.b@c.org"] and [x.v for x in r.s_ip] == ["10.0.0.7"]
    assert [x.v for x in r.s_card] == ["4111 1111 1111 1111"] and [x.v for x in r.s_phone] == ["+1 (212) 555-0100"]
    assert len(r.s_secret) == 1
    clean = {x.doc_id: x.text for x in pii.sanitise(found).collect()}
    assert clean[12] == "mail [EMAIL] or [PHONE], 10.0.0.256 [IP] card [CARD] [SECRET]"
    assert clean[6] is None and clean[7] == ""
    assert pii.find(empty).count() == 0


def test_base_spans_are_those_of_the_patterns(spark):
    """The contract's patterns, read plainly by another engine of regular expressions."""
    rng = random.Random(6)
    bits = ["a.b@c.org", "x@y", "@", "a@b..c", "10.0.0.7", "1.2.3.4.5", "256.1.1.1", "010.0.0.007", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+", "+12", "555", "é", "日本", "\n", "..", "-"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ", ", "x"]) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", luhn), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
    }
    rows = pii.base_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        for kind, (pattern, ok) in plain.items():
            expected = [(m.start(), m.end()) for m in re.finditer(pattern, r.text) if ok(m.group())]
            assert [(x.s, x.e) for x in r[f"s_{kind}"]] == expected, (kind, r.text)


def luhn(v):
    d = [int(x) for x in v if x.isdigit()][::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_terms_that_disclose_an_entity(spark):
    """A term found with one entity alone goes, one found there mostly is generalised, others stay; copies give no support."""
    rng, rows = random.Random(1), []
    for i in range(40):
        if i < 6:
            rows.append((i, f"{words(rng, 8)} Zorblax {words(rng, 3)} jim@corp.example {words(rng, 2)} neutral {words(rng, 1)} partly {words(rng, 6)}"))
        else:
            rows.append((i, f"{words(rng, 9)} neutral {words(rng, 2)}{' partly ' if i < 8 else ' '}{words(rng, 9)}"))
    copied = f"{words(rng, 8)} Quuxify {words(rng, 2)} ann@corp.example {words(rng, 9)}"
    rows += [(100 + i, copied) for i in range(5)] + [(None, None), (99, "")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    clean = {r.doc_id: r for r in pii.sanitise(found).collect()}
    for i in range(6):
        assert [x.v for x in clean[i].s_term] == ["Zorblax", "partly"]
        text = rows[i][1].replace("Zorblax", "[TERM]").replace("jim@corp.example", "[EMAIL]").replace("partly", "[WORD]")
        assert clean[i].text == text
    assert clean[7].text == rows[7][1].replace("partly", "[WORD]") and clean[30].text == rows[30][1]
    assert clean[100].text == copied.replace("ann@corp.example", "[EMAIL]") and clean[None].text is None and clean[99].text == ""
    assert not pii.find(spark.createDataFrame(rows, "doc_id long, text string"), share=1.5).where("size(s_term) > 0").count()


def test_pii_of_very_long_texts(spark):
    """Running totals in blocks: the same as one by one, and a text of 200,000 words ends soon."""
    n = spark.range(1).select(pii._running(F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda x: x % 7), lambda a, b: a + b).alias("r")).first().r
    assert n == list(np.cumsum(np.arange(1, 5001) % 7))
    assert spark.range(1).select(pii._running(F.array().cast("array<int>"), lambda a, b: a + b).alias("r")).first().r == []
    text = "ab cd " * 100_000 + "a@b.org"
    row = spark.createDataFrame([(1, text)], "doc_id long, text string").select(F.size(pii._matches("text", r"[a-z]+")).alias("n"), F.element_at(pii._matches("text", r"[a-z]+"), -1).alias("x")).first()
    assert row.n == 200_003 and (row.x.s, row.x.e) == (600_004, 600_007)


def test_secrets(spark):
    """Quoted and very long values are spans to their ends."""
    jwt = ".".join("aZ09_-" * 400 for _ in range(3))
    cases = [
        ('x token = "04dbebab91abff02" y', "x [SECRET] y"), ("x api_key: 'k3y w1th, blanks' y", "x [SECRET] y"), (f"x token={jwt} y", "x [SECRET] y"), (f'x secret: "{jwt}", y', "x [SECRET], y"),
        ('{"password": "ab\\"cd;ef"}', '{"[SECRET]}'), ('x pwd="unclosed1 y', "x [SECRET] y"), ('x token = "" y, secret: no', 'x token = "" y, secret: no'), ("x password=hunter22x, y", "x [SECRET], y"),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(pii.find(rows)).collect()}
    assert [clean[i] for i in range(len(cases))] == [x for _, x in cases]


def test_paragraphs(docs, empty):
    got = paragraph_dedup.repeated_paragraphs(docs).collect()
    ids = {r.doc_id for r in got}
    assert {1, 2} <= ids and 11 not in ids and None not in ids
    assert {r.doc_id for r in got if not r.removed} <= {1, 4, 10}
    assert {4, 5} <= ids  # the passage they share
    assert paragraph_dedup.repeated_paragraphs(empty).count() == 0


def test_paragraph_classes_are_those_of_brute_force(spark):
    """All pairs of paragraphs compared: the same classes, first occurrences stay, ids that are null or repeat are last or alike."""
    rng = random.Random(12)
    base = [words(rng, 16).split() for _ in range(8)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(base)) if rng.random() < 0.6 else words(rng, 14).split()
            if rng.random() < 0.4:
                w[rng.choice([0, -1])] = words(rng, 1)
            lines.append(" ".join(w))
        rows.append((None if i == 39 else i % 38, "\n".join(lines)))
    rows += [rows[5], (50, None), (51, "")]
    found, bags = [], []
    for i, t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        for s, e, *_ in zip(*paragraph_dedup.cut(raw, np.array([0, len(raw)]), 10), strict=True):
            found.append((i, int(s), t[s:e]))
            w = t[s:e].split()
            bags.append(Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    root = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            if root[i] != root[j] and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    expected = Counter()
    for x in set(root):
        own = [found[k][:2] for k in range(len(found)) if root[k] == x]
        if len(own) > 1:
            first = min(own, key=lambda y: (y[0] is None, y))
            expected.update((y, first, y != first) for y in own)
    got = Counter(((r.doc_id, r.start), (r.class_doc_id, r.class_start), r.removed) for r in paragraph_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == expected and len(expected) > 20


def test_paragraphs_without_similar_ones_get_no_bands(spark, monkeypatch):
    """Signatures are made of those alone that an exact filter cannot rule out, and of all of these."""
    rng = random.Random(21)
    lines = [words(rng, 15).split() for _ in range(60)]
    near = [[*x[:-1], "other"] for x in lines[:5]] + [lines[5][:-2]] + [lines[6]]  # 10 of 12 shingles, 9 of 11, equal
    rows, seen = list(enumerate(map(" ".join, lines + near))), []

    def link(texts, buckets, *args):
        seen.append((Counter(r.text for r in texts.collect()), buckets.count()))
        return near_dedup.link(texts, buckets, *args)

    monkeypatch.setattr(paragraph_dedup, "link", link)
    got = {r.doc_id: r.class_doc_id for r in paragraph_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(7)} | {60 + i: i for i in range(7)}
    assert seen == [(Counter(t for i, t in rows if i < 6 or 60 <= i < 66), 12 * paragraph_dedup.BANDS)]


def test_paragraph_cuts_of_embedded_passages():
    """Passages inside other text, with no line break at their edges, hold whole paragraphs of their own."""
    rng = random.Random(7)

    def keys(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return set(paragraph_dedup.cut(raw, np.array([0, len(raw)]), 10)[3].tolist())

    def prose(n, sentence):
        return re.sub(r" ", lambda m: ". " if sentence and rng.random() < 1 / sentence else " ", words(rng, n))

    lost = Counter()
    for n in (50, 60, 100):
        for k in range(200):
            passage, sentence = prose(n, (0, 8, 15, 30)[k % 4]), (0, 8, 15, 30)[k % 4]
            a, b = (keys(f"{prose(60, sentence)} {passage} {prose(60, sentence)}") for _ in "ab")
            lost[n] += not a & b
    assert lost[50] <= 8 and lost[60] <= 4 and lost[100] == 0, lost
    # lines of fewer words are taken together; equal ranks without end are cut too
    verse = "\n".join(words(rng, 6) for _ in range(10))
    assert keys(f"{words(rng, 40)}\n{verse}\n{words(rng, 40)}") & keys(f"{words(rng, 30)}\n{verse}\n{words(rng, 30)}")
    raw = np.frombuffer(b"aa " * 5000, np.uint8)
    assert len(paragraph_dedup.cut(raw, np.array([0, len(raw)]), 10)[0]) == 500


def test_packing(docs, empty, texts):
    found = packing.pieces(docs, tokenizer_path(), size=64)
    rows = packing.pack(found, size=64, slack=0, first=5, fan_in=2, gain=0).collect()
    from tokenizers import Tokenizer

    t, expected = Tokenizer.from_file(tokenizer_path()), []
    for i, x in texts:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        expected += [(i or -1, p, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for p, s in enumerate(range(0, len(ids), 64))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in by.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= -(-sum(e[3] for e in expected) // 64) + 2
    assert packing.pack(packing.pieces(empty, tokenizer_path)).count() == 0


def test_packing_rounds_end_by_what_they_can_save(spark):
    """Bins of all lengths: places are gapless, and no more sequences than first fit on one machine, one in a hundred aside."""
    rng = random.Random(4)
    lengths = [rng.choice([rng.randint(1, 2048), rng.randint(1100, 1500), rng.randint(1, 90)]) for _ in range(12000)]
    found = spark.createDataFrame([(None if i % 3 else i, n, "x") for i, n in enumerate(lengths)], "doc_id long, length long, sequence_id string")
    rows = packing.pack(found).collect()
    assert len(rows) == len(lengths) and sorted(r.length for r in rows) == sorted(lengths)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in by.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= 1.01 * len(packing.best_fit(np.array(lengths), 2048)[2])


def test_quality_signals(docs, empty, texts):
    got = {}
    found = quality_rules.signals(docs)
    for r in found.collect():
        got[r.doc_id, r.text] = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    for i, t in texts:
        x = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        at = {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        rep = {p + j for v in at.values() if len(v) > 1 for p in v for j in range(8)}
        lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        assert got[i, t] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(rep))
    model = quality_rules.fit(found)
    assert not any(r.kept for r in quality_rules.judge(found, model).collect() if r.n_words < 20)
    assert quality_rules.judge(quality_rules.signals(empty), quality_rules.fit(quality_rules.signals(empty))).count() == 0


def test_quality_weights_come_from_the_votes(spark):
    """Planted behaviour of rules is found again; texts of one bad vote stay or go by whose vote it is."""
    rng = np.random.default_rng(8)
    k, n, share = len(quality_rules.RULES), 40000, 0.8
    rate = np.zeros((2, k, 3))
    rate[1] = [0.01, 0.09, 0.9]
    rate[0] = [0.5, 0.2, 0.3]
    rate[:, 0] = [[0.3, 0.1, 0.6], [0.25, 0.1, 0.65]]  # a rule that knows next to nothing
    rate[0, 1], rate[1, 1] = [0.95, 0.02, 0.03], [0.001, 0.009, 0.99]  # one that is nearly always right
    good = rng.random(n) < share
    draw = rng.random((n, k, 1))
    votes = (draw > np.cumsum(rate[good.astype(int)], 2)[:, :, :2]).sum(2) - 1
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality_rules.estimate(patterns, counts)
    assert abs(model["prior"] - share) < 0.01 and np.abs(model["rate"] - rate).max() < 0.03
    assert model["accuracy"][1] > 0.97 and model["accuracy"][0] < 0.8

    def posterior(*bad):
        v = np.where(np.isin(np.arange(k), bad), 0, 2)
        z = np.log(model["prior"] / (1 - model["prior"])) + sum(np.log(model["rate"][1, i, x] / model["rate"][0, i, x]) for i, x in enumerate(v))
        return 1 / (1 + np.exp(-z))

    assert posterior() > 0.99 and posterior(0) > 0.99 and posterior(2) > 0.5  # a filter that all must pass would drop the last two
    assert posterior(1, 2) < posterior(0, 2) and posterior(*range(1, 5)) < 0.01
    # the same through Spark, on texts: a rule that hits good texts at random is not believed, one that goes with others is
    texts = []
    for i in range(900):
        w = words(rng2, 60).split() if (rng2 := random.Random(i)) else []
        body = ". ".join(" ".join(w[j : j + 10]) for j in range(0, 60, 10)) + "."
        if i % 10 == 0:
            body = " ".join(f"{x}***" for x in w)
        elif i % 10 == 1:
            body = body + "\n" + "\n".join(["one same line"] * 3)  # repeated lines alone
        texts.append((i, body.capitalize()))
    found = quality_rules.signals(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {r.doc_id: r for r in quality_rules.judge(found, quality_rules.fit(found)).collect()}
    assert all(got[i].kept == (i % 10 != 0) for i in got)
    assert all(3 * got[i].n_dup_lines > got[i].n_lines for i in got if i % 10 == 1)


def distance(a, b):
    """Edits with swaps of neighbours."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_is_the_edit_distance():
    a, rng = toxicity.Automaton(["moron", "stupid"], ["lowei"]), random.Random(3)
    tried = ["moron", "mroon", "mornn", "moro", "morons", "oron", "stupid", "stuipd", "loweisch", "loweabc", "m"]
    for _ in range(300):
        w = list(rng.choice(["moron", "stupid"]))
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(1, len(w) - 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "o"])
        tried.append("".join(w))
    chars = np.concatenate([np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in tried])
    ends = np.cumsum([len(w) for w in tried])
    got = a.walk(chars, ends - [len(w) for w in tried], ends)
    for w, g in zip(tried, got, strict=True):
        near = min(distance(w, t) for t in ("moron", "stupid") if w[:1] == t[:1]) if w[:1] in "ms" else 9
        assert g == (1 if near == 0 else 2 if w.startswith("lowei") else 3 if near == 1 else 0), w


def accepted(a, words):
    chars = np.concatenate([np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words])
    ends = np.cumsum([len(w) for w in words])
    return a.walk(chars, ends - [len(w) for w in words], ends).tolist()


def test_lexicon_keeps_word_families_and_all_terms():
    rng = random.Random(2)
    forms = ["idiot", "idiotic", "idiocy", "idiots", "idioten"]
    insults = [*forms, "馬鹿", *("zq" + "".join(rng.choice("bcdfgh") for _ in range(5)) for _ in range(230))]
    toxic = [f"{words(rng, 3)} {w} {words(rng, 3)}" for w in insults for _ in range(25)]
    terms, stems = toxicity.learn_lexicon(toxic, [words(rng, 8) for _ in range(6000)])
    assert set(insults) <= set(terms) and any(x.startswith("idio") for x in stems)
    a = toxicity.Automaton(["idiot", "disgusting", "馬鹿"], ["idio", "pathet"], free=True)
    assert accepted(a, ["idoit", "idjot", "odiot", "diot", "xidiot", "idiocy", "patetic", "apthetic", "dizgustign", "馬鹿", "Idiot"]) == [3] * 5 + [2, 3, 3, 3, 1, 1]
    assert accepted(a, ["dizqustign", "馬", "鹿馬", "odjot", "patehcti"]) == [0] * 5
    chars, s, e, _ = toxicity.text_words(np.frombuffer(" 馬鹿。\u3000「馬鹿」".encode(), np.uint8), np.array([0, len(" 馬鹿。\u3000「馬鹿」".encode())]))
    assert [chars[x:y].tobytes().decode("utf-32-le") for x, y in zip(s, e, strict=True)] == ["馬鹿", "馬鹿"]


def test_quotation():
    assert toxicity.quoted('he said "you are a ', '" and left') and not toxicity.quoted("you are a ", " really")
