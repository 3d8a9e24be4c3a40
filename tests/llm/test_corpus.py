from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import components, decontaminate, embedding_dedup, html_extract, line_dedup, minhash_dedup, mixing, quality, suffix_dedup, token_counts, toxicity
from touchline.llm import kernels as K
from touchline.llm.common import numbered

SCHEMA = "doc_id long, text string, source string, row string, n int, size int, row_id string, id long, score string, kept string"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def word(rng):
    return "".join(rng.choice(["an", "er", "ti", "on", "ü", "es", "ha"]) for _ in range(rng.randint(1, 4)))


def corpus(seed=3, n=40):
    """Nulls, blanks, short and long texts, exact and near copies, a passage in many texts, many sources."""
    rng = random.Random(seed)
    passage = " ".join(word(rng) for _ in range(60))
    texts = [" ".join(word(rng) for _ in range(rng.randint(20, 120))) for _ in range(n)]
    texts += [texts[0], texts[1], texts[1] + " extra tail", texts[2].replace(" ", "  "), None, "", "   \n ", "one two", "One TWO", "two words more here"]
    texts += [f"{word(rng)} {passage} {word(rng)}" for _ in range(8)]
    texts += ["\n".join([texts[3], passage, texts[4]]), "\n".join(" ".join(word(rng) for _ in range(400)) for _ in range(5)), "É É é ß x " * 70]
    return [(k, t, [None, "a", "b", "ä"][k % 4], "r", 1, 2, "x", 3, "s", "k") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# Components and kernels


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 240)] + [(7, 7), (1, 2), (2, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: root(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_equal_runs_have_equal_hashes():
    data = np.frombuffer(b"xxabcdefyyabcdefzz", np.uint8)
    h = K.run_hashes(K.prefix_sums(data), np.array([2, 10, 3]), np.array([8, 16, 9]))
    assert h[0] == h[1] != h[2]


def test_row_numbers_for_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted(r["row_id"] is not None for r in numbered(df).collect()) == [True] * 3
    assert numbered(df).select("row_id").distinct().count() == 3


# 1 embeddings


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [base[k % 40] + (0 if k < 40 else 0.05) * rng.standard_normal(16) for k in range(120)]
    vectors = [(k, [float(x) for x in v]) for k, v in enumerate(rows)]
    vectors += [(200, vectors[0][1]), (201, [2 * x for x in vectors[0][1]]), (202, None), (203, []), (204, [0.0] * 16), (205, [float("nan")] * 16), (206, [None] * 16), (207, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("code", F.lit("x"))
    ok = {k: np.array(v) for k, v in vectors if k < 202}
    links = {k: [j for j in ok if j != k and v @ ok[j] / np.sqrt((v @ v) * (ok[j] @ ok[j])) >= 0.95] for k, v in ok.items()}
    part = {k: k for k, _ in vectors}
    for _ in range(len(ok)):
        part.update({k: min([part[k], *(part[j] for j in links[k])]) for k in ok})
    for block in (512, 8):  # the same with buckets cut into blocks
        got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df, embedding_dedup.Hyperplanes(block=block)).collect()}
        assert got == {k: (len(links.get(k, [])), part[k], part[k] == k) for k, _ in vectors}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_with_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect()), key=repr)
    assert sorted(x[3] for x in got) == [False, False, True, True] and [x[1] for x in got].count(2) == 3


# 2 lines


def brute_lines(rows):
    seen, out = [], {}
    for k, text in sorted((r[0], r[1]) for r in rows):
        kept, gone = [], 0
        for line in (text or "").split("\n"):
            w = frozenset(x for x in SPACES.split(line.lower()) if x)
            hit = bool(w) and any(100 * len(w & s) >= 75 * len(w | s) for s in seen)
            if w:
                seen.append(w)
            gone += hit
            kept += [] if hit else [line]
        out[k] = (None if text is None else "\n".join(kept), gone)
    return out


def test_lines_against_brute_force(docs, empty):
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.remove_lines(docs).collect()}
    want = brute_lines(corpus())
    assert got == want and sum(v[1] for v in want.values()) > 5
    assert set(docs.columns) <= set(line_dedup.remove_lines(docs).columns)
    assert line_dedup.remove_lines(empty).count() == 0


def test_long_lines_and_groups_of_near_copies_against_brute_force(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    stem, long_stem = rng.sample(words, 40), [f"w{k}" for k in range(300)]

    def near(base, share):
        return " ".join(x if rng.random() > share else rng.choice(words) for x in base)

    rows = [(k, near(stem, rng.choice([0.02, 0.08, 0.14]))) for k in range(150)] + [(200 + k, near(long_stem, rng.choice([0.05, 0.14]))) for k in range(30)]
    rows += [(300, "\n".join(rng.choice(words) for _ in range(3000))), (301, " ".join(rng.choice(words) for _ in range(30_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.remove_lines(df).collect()}
    assert got == brute_lines(rows)


def test_lines_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "A b c d e\nx"), (4, "x\nnew"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in line_dedup.remove_lines(df).where("text is not null").collect()) in (
        [(0, "", 1), (4, "A b c d e\nx", 0), (4, "new", 1)], [(0, "", 1), (4, "A b c d e", 1), (4, "x\nnew", 0)])


def test_short_lines_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(k, "\n".join(" ".join(rng.choice("aAbcde") for _ in range(rng.randint(0, 7))) for _ in range(6))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.remove_lines(df).collect()}
    assert got == brute_lines(rows)


def test_equal_rows_lose_their_lines_but_for_the_first(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3, "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup.remove_lines(df).collect()) == ["", "", "a b c d e f"]


# 3 tokens


def test_token_counts_add_up_and_follow_the_rule(spark, docs, empty):
    got = token_counts.count_tokens(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.sum("n_chars").alias("c"), F.count("*").alias("s")).collect()
    with open(token_counts.RANKS, "rb") as f:
        encode, _ = token_counts.encoder(f.read())
    want = {r[0]: (len(encode.encode_ordinary(r[1] or "")), len(r[1] or "")) for r in corpus()}
    assert {r["doc_id"]: (r["n"], r["c"]) for r in got} == want
    assert {r["doc_id"]: r["s"] for r in got}[next(r[0] for r in corpus() if r[1] is None)] == 1
    assert token_counts.count_tokens(empty).count() == 0
    with pytest.raises(ValueError, match="rule"):
        token_counts.count_tokens(docs, rule="x")


@pytest.mark.parametrize("rule, want", [("first", [0, 0, 1, -1]), ("last", [0, 1, 1, -1]), ("largest", [0, 1, 1, -1])])
def test_boundary_tokens(rule, want):
    section, crossing = token_counts.attribute(np.array([3, 8, 10, 14]), np.array([0, 4]), np.array([4, 10]), rule)
    assert list(section) == want and list(crossing) == [False, True, False, False]


def test_sections_in_a_column(spark):
    df = spark.createDataFrame([(1, "ab cd ef", [(3, 8)]), (2, "ab", None)], "doc_id long, text string, s array<struct<begin: int, end: int>>")
    got = {(r["doc_id"], r["section"]): r["n_chars"] for r in token_counts.count_tokens(df, "s").collect()}
    assert got == {(1, -1): 0, (1, 0): 5, (2, -1): 0}


# 4 pages


def page(title, body, chrome="Menu"):
    return (
        f'<html><head><title>x</title><script>var a="</p>";</script><style>p{{}}</style></head><body><div id="topNav"><a href="/">{chrome}</a></div>'
        f'<div class="content"><h1>{title}</h1>{body}<div class="share-buttons">Share</div></div><div class="user-comments"><p>me too</p></div>'
        f"<form>Mail <input></form><div class=box><p>One and the same notice</p></div><footer>end</footer></body></html>"
    )


def test_pages_lose_their_chrome(spark):
    rows = [(k, f"http://h.example/{k}", page(f"T{k} &amp; co", f"<p>First  <b>bold</b> {k}<p>Second\n line &lt;{k}<br>more<ul><li>item {k}</ul>")) for k in range(6)]
    rows += [(10, None, None), (11, "http://h.example/x", ""), (12, "nonsense", "<p>alone"), (13, "http://h.example/y", "<div><!-- no end"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("wrapper", F.lit(1))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.main_text(df).collect()]
    one = {k: t for k, t, _ in got}
    assert one[3] == "T3 & co\n\nFirst bold 3\n\nSecond line <3 more\n\nitem 3"
    assert (one[10], one[11], one[12], one[13]) == ("", "", "alone", "")
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_wrappers_have_slots_options_and_repetition():
    a = html_extract.tree(html_extract.parse("<ul><li>1<li>2</ul><p>x</p>"))
    b = html_extract.tree(html_extract.parse("<h1>t</h1><ul><li>1</ul><p>x</p>"))
    assert html_extract.expression(html_extract.merge(a, b)) == "<> (<h1> #text  </>)? <ul> (<li> #text  </>)+ </> <p> #text  </> </>"


def test_constant_slots_are_template_text():
    pages = [f"<section><div class=x>always here</div><p>text number {k} with words</p></section>" for k in range(6)]
    wrapper = None
    for p in pages:
        own = html_extract.tree(html_extract.parse(p))
        wrapper = html_extract.merge(wrapper, own) if wrapper else own
    assert html_extract.extract(pages[2], wrapper) == "text number 2 with words"
    assert html_extract.extract(pages[2]) == "always here\n\ntext number 2 with words"


def read_all(pages):
    """Every page read against the wrapper of all of them."""
    wrapper = None
    for p in pages:
        own = html_extract.tree(html_extract.parse(p))
        wrapper = html_extract.merge(wrapper, own) if wrapper else own
    return [html_extract.extract(p, wrapper) for p in pages]


@pytest.mark.parametrize("n", [4, 5, 50])
@pytest.mark.parametrize("box", ["article", "main", "section"])
def test_copies_of_a_page_on_one_host_keep_their_text(n, box):
    one = "<nav>Visit {k}</nav><{b}><h1>Title</h1><p>one text</p><pre>code</pre><blockquote>said</blockquote></{b}>"
    assert read_all([one.format(b=box, k=k) for k in range(n)]) == ["Title\n\none text\n\ncode\n\nsaid"] * n


def test_shared_headings_of_articles_stay():
    pages = [f"<div class=x>always here</div><article><p>text {k}</p>{'<h2>Summary</h2>' * (k < 5)}<p>more {k}</p></article>" for k in range(9)]
    assert read_all(pages) == [f"text {k}\n\n" + "Summary\n\n" * (k < 5) + f"more {k}" for k in range(9)]


@pytest.mark.parametrize(
    "tag",
    [
        '<div id="content" class="has-sidebar">', '<div class="single-post comments-open">', '<div class="layout no-sidebar"><article>', '<div class="sidebar-left"><article>',
        '<div class="layout-sidebar"><main>', '<div class="hasSidebar"><article>', '<article><div class="legal-analysis">', '<div class="share content">', '<td class="post side-effects">',
    ],
)
def test_marks_of_layouts_are_no_chrome(tag):
    page = f'<p>Menu</p>{tag}<div class="entry-header"><h1>Title</h1></div><p>all of the text</p><div class="post-comments"><p>me too</p></div>'
    assert html_extract.extract(page) == "Title\n\nall of the text"


def test_marks_of_chrome_still_go():
    for mark in ("share-buttons", "userComments", "site_footer", "ad-300", "related-posts", "sidebar left", "mainNav"):
        assert html_extract.extract(f'<p>all of the text is here</p><div class="{mark}"><p>a teaser</p></div>') == "all of the text is here"
    comments = '<ol class="comments"><li><article><p>me too</p></article></ol>'
    assert html_extract.extract(f"<p>all of the text is here</p>{comments}") == "all of the text is here"


def test_deep_and_wide_pages_end_and_keep_their_text():
    deep = "<div>" * 10_000 + "<p>far below</p>" + "</div>" * 10_000
    claimed = "<div class='content'>" * 3000 + "<p>far below</p><nav>menu</nav>" + "</div>" * 3000
    assert html_extract.extract(deep) == html_extract.extract(claimed) == "far below"
    own = html_extract.merge(html_extract.tree(html_extract.parse(deep)), html_extract.tree(html_extract.parse(claimed)))
    assert html_extract.extract(deep, own) == "far below"
    wide = ["".join(f"<p class='{x}{chr(97 + k % 26)}'>t</p>" for k in range(3000)) for x in "xy"]
    node = html_extract.merge(*(html_extract.tree(html_extract.parse(w)) for w in wide))
    assert len(node[html_extract.CHILDREN]) == 6000


@pytest.mark.parametrize("aside", ['<div class="box2">', '<section class="user-discussion">', "<div>", "<section>"])
@pytest.mark.parametrize("around", ["body", "main"])
def test_a_short_article_beside_a_long_text_is_the_text(aside, around):
    much = " ".join(f"word{k}" for k in range(200))
    end = aside[1:].split()[0].rstrip(">")
    assert html_extract.extract(f"<{around}><article><h1>T</h1><p>A short text.</p></article>{aside}<p>{much}</p></{end}></{around}>") == "T\n\nA short text."


def test_teasers_do_not_stand_for_the_text():
    much = " ".join(f"word{k}" for k in range(200))
    cards = "".join(f"<article class=card><p>teaser {k}</p></article>" for k in range(4))
    assert html_extract.extract(f"<body><div class=content><p>{much}</p></div><section>{cards}</section></body>") == much
    assert html_extract.extract(f"<body><article><p>{much}</p></article>{cards}</body>") == much
    assert html_extract.extract(f"<body><div class=text><p>few</p></div><div class=prose><p>{much}</p></div></body>") == f"few\n\n{much}"


def test_unclosed_markup_takes_linear_time():
    import time

    for page, want in (("<svg>" * 200_000 + "<p>x", "x"), ("<span>" * 50_000 + "</b>" * 50_000 + "y", "y"), ("<i><div>" + "<span>" * 50_000 + "</i>" * 50_000 + "z", "z"), ("<span>" * 20_000 + "<p>" * 20_000 + "w", "w")):
        began = time.perf_counter()
        assert html_extract.extract(page) == want
        assert time.perf_counter() - began < 20
    assert html_extract.extract("a<svg><p>gone</p></svg>b<select>c<noscript>gone</noscript>d") == "abcd"


def test_partial_wrappers_are_merged_in_one_order(spark):
    import itertools

    pages = ["<h1>t</h1><p>a</p><ul><li>1</ul>", "<p>a</p><h1>t</h1><div>x</div>", "<ul><li>1</ul><p>b</p><div>y</div>", "<div>z</div><h1>t</h1>"]
    found = set()
    for k, way in enumerate(itertools.permutations(range(4))):
        if k % 5:
            continue
        df = spark.createDataFrame([("http://h/", pages[i]) for i in way], "url string, html string").repartition(4, "html")
        found.add(html_extract.wrappers(df).first()["wrapper"])
    assert len(found) == 1


def test_inline_labels_and_formulas_are_text():
    assert html_extract.extract("<article><p>one <label>two</label> <math>x</math> three</p></article>") == "one two x three"


# 5 repeated byte strings


def test_repeats_against_brute_force(spark, docs, empty):
    size = 60
    texts = {r[0]: (r[1] or "").encode() for r in corpus()}
    seen, twice = set(), set()
    for b in texts.values():
        for i in range(len(b) - size + 1):
            s = b[i : i + size]
            (twice if s in seen else seen).add(s)
    want = {}
    for k, b in texts.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if b[i : i + size] in twice:
                gone[i : i + size] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        want[k] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, size, 20).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 2000
    large, suffix_dedup.LARGE_BUCKET = suffix_dedup.LARGE_BUCKET, 1
    try:
        assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, size, 20).collect()} == want
    finally:
        suffix_dedup.LARGE_BUCKET = large
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_periodic_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "ab" * 300), (None, "z" * 250), (None, "q" * 199)], "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(199, 0, 0), (250, 250, 1), (600, 600, 1)]


# 6 mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if weight[s] * level > 3 * sizes[s]]
        if not over:
            return {**fixed, **{s: weight[s] * level for s in rest}}
        fixed.update({s: 3.0 * sizes[s] for s in over})


def test_mix_meets_its_targets(spark, docs, empty):
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    again = [r.asDict() for r in mixing.mix(docs.repartition(5)).collect()]
    key = lambda r: r["doc_id"]
    assert sorted(rows, key=key) == sorted(again, key=key)
    source = {r[0]: r[2] for r in corpus()}
    words = {r[0]: len([w for w in SPACES.split(r[1] or "") if w]) for r in corpus()}
    sizes = {s: sum(words[k] for k in words if source[k] == s) for s in set(source.values())}
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (words[r["doc_id"]], sizes[s]) and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    assert mixing.mix(empty).count() == 0


def test_mix_of_one_size_and_a_full_source(spark):
    rows = [(k, "a b c", "big") for k in range(1300)] + [(2000 + k, "a b", "tiny") for k in range(3)] + [(3000, None, "none")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source_size").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("copies").alias("m")).collect()
    for r in got:
        assert abs(r["t"] - r["g"]) <= 3 and r["m"] <= 3
    assert {r["source_size"]: r["t"] for r in got}[6] == 18


# 7 contamination


def test_contamination_against_brute_force(spark, docs, empty):
    texts = {r[0]: r[1] for r in corpus()}
    passage = texts[50].split()
    items = [(1, " ".join(passage[5:30])), (2, "one TWO"), (2, "one two"), (3, None), (4, "..."), (10, " ".join(passage[40:58])), (5, "É"), (6, "x")]
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]
    win = {(i, tuple(w[k : k + 13])) for i, t in items if (w := split(t)) for k in range(max(1, len(w) - 12))}
    want = {}
    for k, t in texts.items():
        w, hit, ids = split(t), set(), set()
        for i, s in win:
            for p in range(len(w) - len(s) + 1):
                if tuple(w[p : p + len(s)]) == s:
                    hit |= set(range(p, p + len(s)))
                    ids.add(str(i))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        want[k] = (len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("shape", F.lit(1))
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == want and sum(v[4] for v in want.values()) > 5
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count()
    twice = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "two one")], "doc_id long, text string")
    assert sorted(r["n_hit"] for r in decontaminate.decontaminate(twice, bench).collect()) == [0, 2, 2]


# 8 near copies


def test_near_copies_against_brute_force(spark, docs, empty):
    sets = {}
    for r in corpus():
        w = [x for x in SPACES.split(lower(r[1])) if x]
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    part = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {k: (len(s), part[k], part[k] == k) for k, s in sets.items()}
    assert len(links) > 4 and minhash_dedup.near_duplicates(empty).count() == 0


def test_near_copies_with_repeated_ids(spark):
    df = spark.createDataFrame([(3, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (1, "other words that are here now")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df).collect())
    assert [x[1] for x in got] == [3, 1, 3, 3] and sum(x[2] for x in got) == 2


def made_by_joins(df):
    """The rows that each join of a plan has made when it ran."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        if "Join" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        plan += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_pairs_across_components_meet_once(spark, monkeypatch):
    rng = random.Random(11)
    texts = []
    for k in range(24):  # alike, so that pairs share many tables
        words = [f"w{x}" for x in range(80)]
        words[rng.randrange(80)] = f"v{k}"
        texts.append((k, " ".join(words)))
    banding = minhash_dedup.Banding()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sketch = minhash_dedup.sliced(minhash_dedup._sketch(banding))
    sketches = minhash_dedup.stored(numbered(docs).select("row_id", "text").mapInArrow(sketch, "row_id long, n long, s0 long, s1 long, left array<long>, right array<long>, bits array<long>"))
    members = minhash_dedup._members(sketches, banding, [])
    found = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (7, 7), (9, 7)], "node long, component long")
    component = {0: 0, 1: 0, 2: 0, 7: 7, 9: 7}
    met = members.alias("p").join(members.alias("q"), F.expr("p.key = q.key and p.row_id < q.row_id")).select("p.row_id", "q.row_id").distinct().collect()
    both = spark.createDataFrame([tuple(x) for x in met if component.get(x[0], x[0]) != component.get(x[1], x[1])], "a long, b long")
    placed = both.join(sketches.alias("x"), F.expr("a = x.row_id")).join(sketches.alias("y"), F.expr("b = y.row_id"))
    want = sorted(tuple(r) for r in placed.where(minhash_dedup._room(banding.percent)).select("a", "b").collect())
    monkeypatch.setattr(minhash_dedup, "stored", lambda df, *_: df)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = minhash_dedup._across(members, found, sketches, banding, [])
        made = made_by_joins(out)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(tuple(r) for r in out.collect()) == want and len(want) > 50
    assert made[0] == len(want)  # the topmost join: that of the buckets


# 9 and 10 classifiers


def labelled(spark, bad):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(300):
        y = k % 3 == 0
        rows.append((k, bad(rng) if y else " ".join(word(rng) for _ in range(40)) + "."))
        labels.append((k, int(y), 1 - int(y)))
    rows += [(1000, None), (1001, ""), (1002, " "), (None, "an er"), (1003, "an er ti " * 9000), (1003, "an er ti " * 9000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("y", F.lit(1)), spark.createDataFrame(labels + [(5000, None, None)], "doc_id long, toxic int, quality int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark, lambda r: " ".join(word(r) + r.choice(["###", "$$$"]) for _ in range(40)))
    out = quality.held_out(F.col("doc_id"), 3, 1)
    trees = quality.fit(docs, labels.where(~out))
    got = {r["doc_id"]: r for r in quality.score(docs, trees).select("doc_id", "score", "predicted", out.alias("h")).collect()}
    assert all(got[k]["h"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(300))
    assert np.mean([got[k]["predicted"] == (k % 3 != 0) for k in range(300) if got[k]["h"]]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 305
    none = quality.score(docs, quality.fit(docs, labels.limit(0)))
    assert none.where("score <> 0.5").count() == 0 and quality.score(docs.limit(0), trees).count() == 0


def test_flat_trees_match_a_walk_by_hand():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 4))
    t = quality.fit_trees(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float), n_trees=5, depth=3)
    for row, got in zip(x[:40], t.margin(x[:40]), strict=True):
        m = t.bias
        for at in t.roots:
            while t.left[at] != at:
                at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
            m += t.value[at]
        assert got == pytest.approx(m)


def test_toxicity_on_held_out_rows(spark):
    bad = ["scumbag", "worstling", "zonk"]
    docs, labels = labelled(spark, lambda r: " ".join(r.choice(bad) if i in (7, 21) else word(r) for i in range(40)))
    out = quality.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.fit(docs, labels.where(~out))
    rows = toxicity.score(docs, model).select("doc_id", "score", "predicted", "spans", out.alias("h")).collect()
    got = {r["doc_id"]: r for r in rows}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert np.mean([got[k]["predicted"] == (k % 3 == 0) for k in range(300) if got[k]["h"]]) > 0.97
    for k in range(0, 300, 3):
        assert {w for s in got[k]["spans"] for w in text[k][s["begin"] : s["end"]].split()} & set(bad)
    assert got[1000]["score"] == got[1001]["score"] == got[1002]["score"] == 0 and got[1003]["predicted"] == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("score > 0").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    f = toxicity.Field(np.zeros(4, np.float32), rng.standard_normal((2, 2)))
    docs = np.array([0, 0, 0, 0, 1, 2, 2])
    s = rng.standard_normal(7)
    got = f.marginals(s, docs)
    for d in (0, 1, 2):
        at = np.flatnonzero(docs == d)
        total, hit = 0.0, np.zeros(len(at))
        for code in range(2 ** len(at)):
            tags = [(code >> i) & 1 for i in range(len(at))]
            w = np.exp(sum(s[a] * t for a, t in zip(at, tags, strict=True)) + sum(f.moves[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            total += w
            hit += w * np.array(tags)
        assert got[at] == pytest.approx(hit / total)


def test_toxicity_with_fewer_toxic_documents_than_a_marker_asks_for(spark):
    plain = "the team ran a long way down the river and came home late in the rain".split()
    rng = random.Random(4)
    texts = [" ".join(rng.choices(plain, k=30)) for _ in range(60)]
    for k in range(3):
        words = texts[k].split()
        words[9:9] = ["you", "vile", "scumbag"]
        texts[k] = " ".join(words)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 3)) for k in range(60)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert min(got[k] for k in range(3)) > max(got[k] for k in range(3, 60))


# 1 again: magnitudes, and planes that follow the number of vectors


def test_extreme_magnitudes_link(spark):
    rows = [(1, [1e200, 1e200, 0.0]), (2, [2e200, 2e200, 0.0]), (3, [1e-200, 0.0, 0.0]), (4, [3e-200, 1e-203, 0.0]), (5, [0.0, 0.0, 5e-324]), (6, [0.0, 0.0, 1e300])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5)}


def test_planes_follow_the_number_of_vectors():
    base = embedding_dedup.Hyperplanes()
    for n in (0, 10, 10**6, 10**8, 10**10):
        spec = base.for_classes(n)
        assert spec.found() >= base.found() > 0.9995 and n / 2**spec.signs <= spec.block and spec.tables % spec.at_once == 0
    spec = base.for_classes(10**8)
    assert (spec.signs, spec.tables) == (18, 51)
    # pairs of cosine 0.95, by their buckets
    rng_ = np.random.default_rng(1)
    a = rng_.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng_.standard_normal((2000, 64))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    planes = np.random.default_rng(spec.seed).standard_normal((64, spec.tables * spec.signs))
    same = ((a @ planes > 0) == (b @ planes > 0)).reshape(2000, spec.tables, spec.signs).all(2).any(1)
    assert same.mean() > 0.995
