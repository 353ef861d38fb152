"""Url rules, chat formatting, page extraction, language, quality, repeats and benchmark passages."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.helpers import LONG, ODD, by_id, docs
from twinarm.llm import chat, decontaminate, html_text, jaccard, language, quality, substring, url_filter

# ---- urls

RULES = {"block": ["net/", "example.com/de/"], "allow": ["example.net/en/", "org/fr/"]}
URLS = [
    ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), ("https://b.net/", "b.net", "/", "net/", "block"),
    ("https://b.net", "b.net", "", None, "allow"), (None, "", "", None, "allow"), ("nonsense", "", "", None, "allow"), ("x://", "", "", None, "allow"),
    ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("ftp://w.org/fr/?a=//b", "w.org", "/fr/", "org/fr/", "allow"), ("http://a-spam.org/en", "a-spam.org", "/en", None, "block"),
    ("http://net/en/a://b", "net", "/en/a://b", "net/", "block"), ("http://ÄB.ORG#x", "Äb.org", "", None, "allow"), ("", "", "", None, "allow"),
]


def test_urls(spark):
    df = spark.createDataFrame([(u, "clash") for u, *_ in URLS], "url string, host string")
    out = url_filter.judge(df, RULES["block"], RULES["allow"])
    assert by_id(out, "url", "host", "path", "rule", "verdict") == sorted(URLS, key=repr)
    assert url_filter.judge(df.limit(0), [], []).count() == 0
    assert {r["rule"] for r in url_filter.judge(df, [], []).collect()} == {None}


def test_digests_that_collide_are_told_apart(tmp_path):
    path = str(tmp_path / "keys")
    keys = {f"key{i}": i for i in range(50)}
    url_filter.DigestIndex.write(path, keys, digest=lambda b: len(b))
    index = url_filter.DigestIndex(path)
    assert index.find([*keys, "key77", "other"], digest=lambda b: len(b)).tolist() == [*range(50), -1, -1]
    url_filter.DigestIndex.write(path, {})
    assert url_filter.DigestIndex(path).find(["a"]).tolist() == [-1]


# ---- chat

TALK = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nx", "a\\<|im_end|>\\\\n\\", "", None, "\n\n", LONG, "<<SYS>><s>"]
    rows = [(c, t, ("user", "assistant", None, "a\nb\\")[t % 4], nasty[(c + t) % len(nasty)]) for c in range(6) for t in range(1 + 3 * c)]
    rows += [(None, 0, "assistant", "z"), (77, None, "user", "first"), (77, 0, "assistant", "tie"), (77, 0, "assistant", "tie")]
    out = chat.format_trees(chat.chain(spark.createDataFrame(rows, TALK)))
    read = out.select(F.col("tree"), chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want: dict = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r["tree"]: [(x["role"], x["text"]) for x in r["t"]] for r in read} == want
    assert {r["tree"]: r["loss"] for r in read} == {c: "".join(x for role, x in turns if role == "assistant") for c, turns in want.items()}
    assert chat.format_trees(chat.chain(spark.createDataFrame([], TALK))).count() == 0


def test_branches_are_ranked_by_score(spark):
    nodes = spark.createDataFrame(
        [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "more", None),
         (2, 1, None, "user", "alone", 0.0), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0)],
        "tree long, node long, parent long, role string, text string, score double")
    best = {r["tree"]: [t["text"] for t in r["turns"]] for r in chat.format_trees(nodes).select("tree", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert best == {1: ["q", "good", "more"], 2: ["alone"]}
    assert chat.format_trees(nodes, branches=2).count() == 3


def test_long_conversations(spark):
    """Thousands of turns: every turn comes back in order, and no plan grows with them."""
    talk = spark.range(10_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    listed = chat.paths(chat.chain(talk.unionByName(talk.where("turn < 256").withColumn("conv_id", F.lit(2).cast("long")))))
    short = chat.paths(chat.chain(talk.where("turn < 256")))
    joins = [str(p._jdf.queryExecution().optimizedPlan()).count("Join") for p in (listed, short)]
    assert joins == [0, 0] and listed.count() == 10_256
    out = chat.format_trees(chat.chain(talk)).select(chat.read_turns(F.col("formatted")).alias("t"), F.size("loss_spans").alias("n")).first()
    assert [x["text"] for x in out["t"]] == [f"t{i}" for i in range(10_000)] and out["n"] == 5000


def test_deep_and_broken_trees(spark):
    """A deep tree with branches, a leaf that hangs on a cycle, a cycle, and a parent that is missing."""
    rows = [(1, i, i - 1 if i else None, "user", f"a{i}", 1.0) for i in range(300)] + [(1, 1000 + i, 10 * i, "assistant", f"b{i}", 0.0) for i in range(30)]
    rows += [(2, 1, 3, "user", "x", 0.0), (2, 2, 1, "user", "x", 0.0), (2, 3, 2, "user", "x", 0.0), (2, 4, 3, "user", "on a cycle", 0.0), (2, 5, 99, "user", "orphan", 0.0)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    found: dict = {}
    for r in chat.paths(nodes).collect():
        found.setdefault((r["_t"], r["leaf"]), {})[r["distance"]] = r["node"]
    want = {("=1", 299): list(range(299, -1, -1)), ("=2", 5): [5]} | {("=1", 1000 + i): [1000 + i, *range(10 * i, -1, -1)] for i in range(30)}
    assert {k: [v[d] for d in range(len(v))] for k, v in found.items()} == want


# ---- pages

def test_pages(spark):
    page = (
        '<html><head><title>T</title></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><div id="cookie-notice">We use <div>cookies</div></div>'
        '<main><article class="post with-sidebar"><h1>A &amp; b</h1><p>One <b>t</b>wo\n three.<div class="ad-slot">Buy <div>now</div></div><p>Four<br>five</p>'
        '<aside>Side</aside><script>if(a<b){"</p>"}</script><p>Six.</p></article></main><section class="comments"><p>I like this very much indeed</p></section>'
        "<form>Your mail <input></form><footer>&copy; me</footer></body></html>")
    df = spark.createDataFrame([(1, page, "u"), (2, None, "u"), (3, "", "u"), (4, "<p>" * 3, None), (5, "just words &lt;b", "u"), (None, page[:400], "u")], "page_id long, html string, text string")
    costs = html_text.learn(df)
    out = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(df, costs).collect()}
    assert out[1][0] == "A & b One two three. Four five Six."
    assert out[2] == out[3] == out[4] == ("", 0) and out[5] == ("just words <b", 13) and out[1][1] == len(out[1][0])
    assert html_text.extract(df.limit(0), html_text.learn(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["article", "main"])
def test_page_inside_a_form(name):
    page = f'<body><form id="aspnetForm"><div>Search <input></div><{name}><p>One two three four.</p><p>Five six.</p></{name}></form><footer>me</footer></body>'
    assert html_text.main_text(page, {}) == "One two three four. Five six."


@pytest.mark.parametrize("piece,count", [('"x" ', 250_000), ("<a ", 350_000), ('<a x=">" ', 110_000), ("<script ", 130_000), ("<", 1_000_000), ("<!--", 250_000), ("<div class='", 80_000),
                                         ("<b>x", 250_000), ("</div>", 160_000), ("<nav>", 200_000), ("&amp;", 200_000)])
def test_broken_pages_of_a_megabyte(piece, count):
    """Time grows with the length whatever is broken: tags, quotes, comments and elements that never end."""
    import time

    for page in ("<p>one two</p><a " + piece * count, piece * count + ">", "<p>one two</p>" + piece * count):
        start = time.perf_counter()
        html_text.main_text(page, {})
        assert time.perf_counter() - start < 20


def test_comments_and_elements_without_an_end():
    body = "<article><h1>Head</h1><p>One two three.</p>{}<p>Last.</p></article>"
    for name in ("post-comments", "comment-body", "newsletter-content", "comments main", "CommentList", "ad-slot"):
        for element in ("div", "li", "section"):
            page = body.format(f'<{element} class="{name}"><p>I like this very much, it is the best I have read.</p></{element}>')
            assert html_text.main_text(page, {}) == "Head One two three. Last.", name
    assert html_text.main_text(body.format('<div class="post-body has-sidebar">Four</div>'), {}) == "Head One two three. Four Last."
    for tag in ("<nav>", '<div class="menu">', "<form>", "<aside>"):
        assert html_text.main_text(f"{tag}<p>One two three four.</p><p>Five.</p>", {}) == "One two three four. Five."
    # Nothing of the article is lost behind tags that cost much.
    page = "<article><h1>A</h1>" + "<x><y>" * 40 + "<p>" + "word " * 50 + "</p>" + "<x><y>" * 40 + "<p>Z</p></article><p>out</p>"
    assert html_text.main_text(page, {"x": 8.0, "y": 8.0, "p": 3.0}) == "A " + "word " * 50 + "Z"


def test_region_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randint(1, 12)
        gains, costs = [rng.randint(1, 9) * 1.0 for _ in range(n)], [rng.randint(0, 12) / 2 for _ in range(n)]
        score = lambda a, b: sum(gains[a:b]) - sum(costs[a + 1:b])
        a, b = html_text.best_region(gains, costs)
        assert score(a, b) == max(score(x, y) for x in range(n) for y in range(x + 1, n + 1))
    assert html_text.best_region([], []) == (0, 0)


def test_pages_against_their_markup(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    import html

    def article(page):
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1])
        return " ".join(html.unescape(re.sub(r"<[^>]*>", " \n ", inner)).split())

    rows = html_text.extract(df.withColumn("raw", F.col("html")), html_text.learn(df)).select("raw", "text").collect()
    assert [r["text"] for r in rows] == [article(r["raw"]) for r in rows]


# ---- language

def test_language(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("clash"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.learn(df.where(~held))
    out = language.predict(df, model)
    assert out.where(held & (F.col("lang") == F.col("lang_pred"))).count() >= 0.97 * df.where(held).count()
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs(spark), model).collect()}
    assert odd[2] == odd[3] == odd[4] == ("und", 0.0) and odd[5][0] in model[0] and 0 < odd[8][1] <= 1
    assert language.predict(docs(spark, []), model).count() == 0
    none = language.learn(df.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs(spark), none).collect()} == {"und"}


def test_rare_and_many_languages(spark):
    rows = [(i, "the words of a language that is everywhere", "en") for i in range(2000)] + [(5000 + i, "zażółć gęślą jaźń", "pl") for i in range(3)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=50)
    assert model[0] == ["en", "pl"] and language.Labeller(*model).predict(["gęślą jaźń"])[0] == ["pl"]
    grams = [[0.0] * language.BUCKETS for _ in range(200)]
    grams[180] = [1.0] * language.BUCKETS
    import numpy as np

    tool = language.Labeller([f"l{k}" for k in range(200)], np.array(grams), np.ones((200, len(language.SCRIPTS) + 1)))
    assert tool.predict(["some words here"]) == (["l180"], [1.0])


def test_language_spans(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars between 600 and 3000").select("lang", "text").collect()
    model = language.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    first, second = (next(r["text"] for r in rows if r["lang"] == x and "|" not in r["text"] and "$" not in r["text"]) for x in ("en", "de"))
    a, b = first.split()[:60], second.split()[:60]
    spans = language.Labeller(*model).label_spans(" ".join([*a, *b, *a]))
    assert [s[0] for s in spans] == ["en", "de", "en"] and abs(spans[1][1] - 60) <= 3 and abs(spans[1][2] - 120) <= 3


def test_best_path_is_the_best_of_all():
    import itertools

    import numpy as np

    tool = language.Labeller(["x", "y"], np.zeros((2, language.BUCKETS)), np.ones((2, len(language.SCRIPTS) + 1)), switch=1.5)
    rng = np.random.default_rng(2)
    tool.table = rng.normal(size=(30, 2)).astype(np.float32)
    counts, ids = np.array([0, 7, 1, 9, 3]), rng.integers(0, 30, 20).astype(np.int32)
    got, at = tool.spans(ids, counts), 0
    for n in counts:
        part = tool.table[ids[at:at + n]]
        value = lambda path: sum(part[i, k] for i, k in enumerate(path)) - 1.5 * sum(p != q for p, q in zip(path, path[1:], strict=False))
        if n:
            assert value(got[at:at + n].tolist()) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=int(n)))))
        at += n


# ---- quality

def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice))


def test_quality_counts():
    rng = random.Random(3)
    made = ["", None, "a", "a b", "a b c", "a b c a b c", "\n\n a\n a\na", "x y\x0b\x0cz\u00a0w \u2003", *(
        "".join(rng.choice(["a ", "b ", "c\n", "d", "\t", "#", "é|", "\n", "\x85"]) for _ in range(rng.randint(0, 60))) for _ in range(150))]
    found = quality.base_counts(made)
    got = list(zip(*(found[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [plain_counts(t) for t in made]


def test_quality_model_on_unseen_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    model = quality.fit(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 0").select("doc_id", "quality"))
    out = quality.score(rows.where("doc_id % 2 = 1"), model).where("not base_failed")
    good, bad = out.where("quality = 1"), out.where("quality = 0")
    assert good.where("kept").count() >= 0.99 * good.count()
    assert bad.where("not kept").count() >= 0.97 * bad.count()


def test_quality_of_odd_rows(spark):
    labels = docs(spark).select("doc_id", F.lit(1).alias("quality"))
    out = quality.score(docs(spark, note="kept"), quality.fit(docs(spark), labels))
    assert by_id(out, "doc_id", "kept") == sorted(((i, i == 5) for i, _, _ in ODD), key=repr)
    assert out.columns[:2] == ["doc_id", "text"]
    assert quality.score(docs(spark, []), quality.fit(docs(spark), labels.limit(0))).count() == 0


# ---- alike texts

def test_links_of_large_groups_without_a_link_before(spark, monkeypatch):
    real, calls = jaccard._pairs, []

    def no_pairs_at_first(*args):
        calls.append(1)
        return real(*args) if len(calls) > 2 else real(*args).limit(0)

    monkeypatch.setattr(jaccard, "SMALL_GROUP", 1)
    monkeypatch.setattr(jaccard, "_pairs", no_pairs_at_first)
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words), None), (2, " ".join([*words[:-1], "x"]), None), (3, " ".join(words[:12]), None)]
    assert by_id(jaccard.join_alike(docs(spark, rows)), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 3)]


def test_one_of_alike_texts_with_one_id(spark):
    words = [[f"{c}{k}" for k in range(40)] for c in "abc"]
    near = lambda w: " ".join([*w[:-1], "x"])
    rows = [
        (1, " ".join(words[0]), None), (1, near(words[0]), None), (2, " ".join(words[1]), None), (3, near(words[1]), None), (3, " ".join(words[2]), None),
        (4, "", None), (4, None, None), (4, "", None), (None, near(words[0]), None)]
    out = by_id(jaccard.keep_one(docs(spark, rows)), "doc_id", "text")
    assert [i for i, _ in out] == [1, 2, 3, 4, 4, None]
    assert {(2, rows[2][1]), (3, rows[4][1]), (4, ""), (4, None), (None, rows[-1][1])} < set(out)


# ---- repeated passages

def test_repeats(spark):
    rng = random.Random(4)
    sentence = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(1, 6) + str(rng.randint(0, 999)) for _ in range(12)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(6))
    clean = [" ".join(sentence() for _ in range(5)) for _ in range(4)]
    rows = [
        (3, f"{clean[0]}\nwords before {passage} and after.", None), (2, f"Intro here {passage}\n{clean[1]}", None), (9, passage, None),
        (None, f"{clean[2]} {passage}", None), (4, clean[3], None), (5, f"{passage} {passage}", None), (6, None, None), (7, "", None), (8, "Short. Short. Short.", None)]
    out = {r["doc_id"]: r for r in substring.remove_repeats(docs(spark, rows, note="removed_starts")).collect()}
    original = {i: t for i, t, _ in rows}
    assert out[2]["text"] == original[2] and out[4]["text"] == original[4] and out[8]["text"] == original[8]
    assert out[9]["text"] == "" and out[5]["text"] == "" and out[6]["text"] is None and out[7]["text"] == ""
    assert out[3]["text"] == f"{clean[0]}\nwords before and after." or out[3]["text"] == f"{clean[0]}\nwords before\nand after." or "and after." in out[3]["text"]
    assert passage not in out[3]["text"] and clean[0] in out[3]["text"] and out[None]["text"] == clean[2]
    for i, row in out.items():
        cuts = list(zip(row["removed_starts"], row["removed_ends"], strict=True))
        kept = original[i] or ""
        for a, b in reversed(cuts):
            kept = kept[:a] + kept[b:]
        assert (row["text"] or "") == (kept.rstrip() if cuts else kept)
    assert substring.remove_repeats(docs(spark, [])).count() == 0


def cut_units(text, marked, min_words):
    """Character spans of the runs of marked units with enough words, up to the next unit."""
    places, flags, out, k = substring.units(text), set(marked), [], 0
    while k < len(places):
        if k not in flags:
            k += 1
            continue
        first, words = k, 0
        while k < len(places) and k in flags:
            words += len(text[places[k][0]:places[k][1]].split())
            k += 1
        if words >= min_words:
            out.append((places[first][0], places[k][0] if k < len(places) else len(text)))
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(rng.randint(1, 9))).capitalize() + "." for _ in range(25)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 8))), None) for i in range(60)]
    seen: set = set()
    want = []
    for i, text, _ in rows:
        parts = [" ".join(text[a:b].lower().split()) for a, b in substring.units(text)]
        marked = []
        for k, part in enumerate(parts):
            marked += [k] if part in seen or part in parts[:k] else []
        seen.update(parts)
        want.append((i, cut_units(text, marked, substring.MIN_WORDS)))
    got = [(r["doc_id"], list(zip(r["removed_starts"], r["removed_ends"], strict=True))) for r in substring.remove_repeats(docs(spark, rows)).orderBy("doc_id").collect()]
    assert got == want


def test_no_long_repeat_stays(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = [[word() for _ in range(300)] for _ in range(40)]
    for i in range(1, 40):
        a, b, source = rng.randrange(240), rng.randrange(300), rows[rng.randrange(i)]
        rows[i][b:b] = source[a:a + 60]
    rows.append([w if k % 75 else "edited" for k, w in enumerate(rows[0])])
    rows.append(rows[0][:100] + rows[1][:20] + rows[0][:100])
    out = [r["text"].split() for r in substring.remove_repeats(docs(spark, [(i, " ".join(w), None) for i, w in enumerate(rows)])).orderBy("doc_id").collect()]
    windows = [" ".join(words[k:k + 50]) for words in out for k in range(len(words) - 49)]
    assert len(windows) == len(set(windows))
    assert out[0] == rows[0] and sum(map(len, rows)) - sum(map(len, out)) >= 0.75 * (39 * 60 + 300 + 200)
    assert {w for words in out for w in words} >= {w for words in rows for w in words}
    assert all(len(rows[i]) - len(out[i]) <= 60 for i in range(40))


def test_repeats_without_spaces(spark):
    line = "".join(chr(0x4e00 + k * 7) for k in range(45)) + "。"
    rows = [(1, f"{line}\nfirst of all", None), (2, f"second\n{line}\nto come", None), (3, f"{line[:20]}", None), (4, f"{line[:20]}\nthird", None)]
    assert by_id(substring.remove_repeats(docs(spark, rows)), "doc_id", "text") == [
        (1, f"{line}\nfirst of all"), (2, "second\nto come"), (3, line[:20]), (4, f"{line[:20]}\nthird")]


def test_repeats_of_odd_rows(spark):
    out = substring.remove_repeats(docs(spark))
    assert out.count() == len(ODD) and out.columns == ["doc_id", "text", "note", "removed_starts", "removed_ends"]
    texts = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (1, ODD[0][1]) in texts and (6, "") in texts and (5, LONG) in texts


# ---- benchmark passages

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row


def least_edits(item, words):
    most = len(words)
    return min((min(edits(item, words[s:s + len(item) * 6 // 5 + 1])) for s in range(most)), default=len(item))


def changed(words, n, rng, other):
    words = list(words)
    for _ in range(n):
        k, how = rng.randrange(len(words)), rng.random()
        if how < 0.4:
            words[k] = rng.choice(other)
        elif how < 0.7:
            words.insert(k, rng.choice(other))
        elif len(words) > 1:
            del words[k]
    return words


def test_benchmark_against_brute_force():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + [f"r{i}" for i in range(400)]
    items = [[rng.choice(words) for _ in range(rng.randint(12, 40))] for _ in range(40)]
    finder = decontaminate.Finder([(i, " ".join(w)) for i, w in enumerate(items)])
    hit = total = 0
    for trial in range(60):
        k = rng.randrange(len(items))
        around = [rng.choice(words) for _ in range(40)]
        text = [*around, *changed(items[k], rng.randint(0, len(items[k]) // 5), rng, words), *around]
        want = {i for i, item in enumerate(items) if least_edits(item, text) <= len(item) // 5}
        got = {i for i, _, _ in finder.find([" ".join(text)])[0]}
        assert got <= want
        hit, total = hit + len(got), total + len(want)
    assert hit >= 0.97 * total


@pytest.mark.parametrize("size", [15, 60, 120, 250])
@pytest.mark.parametrize("kind", ["deleted", "inserted", "replaced", "mixed"])
def test_benchmark_passages_with_all_edits_allowed(size, kind):
    rng = random.Random(size)
    items = [[f"w{i}x{k}" for k in range(size)] for i in range(10)]
    finder = decontaminate.Finder([(i, " ".join(w)) for i, w in enumerate(items)])
    for i, item in enumerate(items):
        words = list(item)
        for k in sorted(rng.sample(range(1, size - 1), size // 5), reverse=True):
            how = rng.choice(["deleted", "inserted", "replaced"]) if kind == "mixed" else kind
            words[k:k + 1] = {"deleted": [], "inserted": [words[k], "other"], "replaced": ["other"]}[how]
        found = finder.find([" ".join(["before"] * 30 + words + ["after"] * 30)])[0]
        assert [(x, d <= size // 5) for x, _, d in found] == [(i, True)]


def test_benchmark_places_against_brute_force():
    rng = random.Random(16)
    items = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 16))] for _ in range(30)]
    finder = decontaminate.Finder([(i, " ".join(w)) for i, w in enumerate(items)])
    for _ in range(20):
        text = [rng.choice("abcdefghxyz") for _ in range(40)]
        told = [(i, min((min(edits(item, text[s:s + len(item) * 6 // 5])), s) for s in range(len(text)))) for i, item in enumerate(items)]
        assert finder.find([" ".join(text)])[0] == [(i, s, d) for i, (d, s) in told if d <= len(items[i]) // 5]


def test_benchmark_of_odd_rows(spark):
    items = spark.createDataFrame(
        [(1, "Alpha, beta gamma delta epsilon zeta."), (2, None), (3, ""), (4, "too short"), (5, "alpha BETA gamma delta epsilon zeta"), (None, "eta theta iota kappa lambda mu")],
        "item_id long, text string")
    rows = [*ODD, (20, "so alpha beta; gamma delta epsilon zeta! and", None), (21, "Alpha gamma delta epsilon zeta", None), (22, "eta theta iota kappa lambda mu", "n")]
    out = {(r["doc_id"], r["text"]): (r["leak_items"], r["leak_starts"], r["leak_edits"]) for r in decontaminate.find_items(docs(spark, rows, note="leak_items"), items).collect()}
    found = {k[0]: v for k, v in out.items() if v[0]}
    assert found == {20: ([1, 5], [1, 1], [0, 0]), 21: ([1, 5], [0, 0], [1, 1]), 22: ([None], [0], [0])}
    assert decontaminate.find_items(docs(spark, []), items).count() == 0
    assert decontaminate.find_items(docs(spark), items.limit(0)).where(F.size("leak_items") > 0).count() == 0


def test_benchmark_items_that_are_short_or_without_spaces():
    items = [(1, "Paris"), (2, "forty two"), (3, "one two, three four"), (4, "北京是中国的首都。"), (5, "กรุงเทพ")]
    texts = [
        "It is paris, not forty-two.", "Say forty two. One two three four!", "one two three five four", "我说：北京是中国旧的首都。好",
        "เมืองกรุงเทพ", "北京", None]
    assert decontaminate.Finder(items).find(texts) == [[(1, 2, 0)], [(2, 1, 0), (3, 3, 0)], [], [(4, 2, 1)], [(5, 4, 0)], [], []]


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = by_id(decontaminate.find_items(df, items), "doc_id", "leak_items")
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 15)
    assert by_id(decontaminate.find_items(df, items), "doc_id", "leak_items") == whole
    plain = [(r["item_id"], " ".join(decontaminate.plain_words(r["text"]))) for r in items.collect()]
    exact = {(r["doc_id"], i) for r in df.collect() for t in [" ".join(decontaminate.plain_words(r["text"]))] for i, p in plain if p in t}
    assert exact <= {(d, i) for d, found in whole for i in found}


def test_digest_of_turns_is_read_back(spark):
    from twinarm.llm.queries import op4_chat_format

    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    want: dict = {-7: ["user", "\n", "</s>[INST] ok [/INST]", "\n", "assistant", "\n", "</s>[INST] ok [/INST]", "\n"]}
    for r in rows:
        want.setdefault(r["conv_id"], []).extend([r["role"], "\n", r["text"] or "", "\n"])
    got = {r["conv_id"]: r["turns_sha256"] for r in op4_chat_format(spark, "/root/testdata/sf0.001").collect()}
    assert got == {c: hashlib.sha256("".join(parts).encode()).hexdigest() for c, parts in want.items()}
