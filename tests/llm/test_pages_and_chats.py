"""HTML extraction, URL cascades, chat formatting."""

import random

import pytest
from pyspark.sql import functions as F

from tangentia.llm import html_extract as H
from tangentia.llm.chat_format import Template, format_chats, learnt_text, read_turns
from tangentia.llm.html_extract import UNMARKED, extract_text, page_tree
from tangentia.llm.queries import ORACLE, QUERIES
from tangentia.llm.url_filter import build_cascade, filter_urls, url_parts


def text_of(page):
    return " ".join(b[1] for b in page_tree(page)[0] if b[3] == UNMARKED)


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<nav>menu</nav><article><h1>T</h1><p>a<b>b</b>c<br>d<p>e</article><footer>f</footer>", "T abc d e"),
    ("<script>if (a<b) '</p>'</script><p>x</p><style>p{}</style><!-- no <p>y</p> -->z", "x z"),
    ("<div class='side-bar'>s</div><div class=sidebar>s</div><div id='commentList'>c</div><p>keep", "s keep"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", "a b 1 2"),
    ("<article><p>in<div class=ad>no</div><aside>no</aside><header><h1>H</h1></header></article>out", "in H out"),
    ("<p hidden>no</p><p style='display: none'>no</p><div role=navigation>no</div>yes", "yes"),
    ("a < b <3 &lt;i&gt; &#233;&nbsp;x", "a < b <3 <i> é x"),
    ("<title>t</title><form>f<input></form><p>  much \n\t space </p>", "much space"),
    ("<p title='a > b'>q</p><script>never closed <p>x", "q"),
])
def test_page_text(page, text):
    assert text_of(page) == text


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_what_all_pages_share_goes(spark):
    rows = [(i, f"http://h.example/{i}", f"<div class=top>Welcome here</div><div class=body><p>Story {i} of many {i * 7}</p></div><div class=end>Same words below</div>") for i in range(30)]
    rows += [(100, "http://alone.example/", "<section class=top>Welcome here</section><p class=x>only page</p><footer>end</footer>"), (101, None, None), (102, "nohost", ""), (0, "http://h.example/0", rows[0][2])]
    out = {r["page_id"]: r for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    assert out[3]["text"] == "Story 3 of many 21" and out[3]["n_chars"] == 18
    assert out[100]["text"] == "Welcome here only page"
    assert out[101]["text"] == "" and out[102]["n_chars"] == 0
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_blocks_are_judged_in_articles_and_outside(spark):
    rows = [(i, f"http://teaser.example/{i}", f"<div>Our site</div><article><p>Teaser {i}</p></article><div><section><p>Main text {i} of {i * 7}</p></section></div>") for i in range(20)]
    rows += [(100 + i, f"http://notice.example/{i}", f"<article><section><p>The same notice</p></section><div><p>Story {i}</p></div></article>") for i in range(20)]
    assert extracted(spark, rows) == {i: f"Teaser {i} Main text {i} of {i * 7}" for i in range(20)} | {100 + i: f"Story {i}" for i in range(20)}


def site(seed, host, n, tag):
    """(rows, main texts) of pages whose menus, adverts and endings vary in words, but not in looks, under names that say nothing."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeioulnrst", k=rng.randint(2, 8)))
    say = lambda k: " ".join(word() for _ in range(k))
    rows, texts = [], {}
    for i in range(n):
        parts = [say(rng.choice([2, 5, 9, 20, 60, 150])) for _ in range(rng.randint(1, 14))]
        menu = "".join(f"<li><a href=/{k}>{word()}</a></li>" for k in range(rng.choice([5, 6, 7])))
        main = "".join(f"<p>{x}</p>" for x in parts)
        rows.append((seed * 10_000 + i, f"http://{host}/{i}", f"<ul>{menu}</ul><div class=x>{say(rng.randint(8, 14))}</div><{tag}><h1>{say(6)}</h1>{main}</{tag}><div class=y>{host} {say(rng.randint(8, 14))}</div>"))
        texts[rows[-1][0]] = rows[-1][2].split("<h1>")[1].split("</h1>")[0] + " " + " ".join(parts)
    return rows, texts


def test_trees_tell_texts_without_marks(spark):
    """No element or class here marks anything; a large host, small ones, and one of a single page, which the tree of all hosts judges."""
    rows, texts = [], {}
    for seed, (host, n) in enumerate([("large.example", 240), ("small.example", 30), ("four.example", 4), ("one.example", 1), ("", 3)]):
        r, t = site(seed, host, n, "div")
        rows += r
        texts |= t
    got = extracted(spark, rows)
    assert sum(got[i] == t for i, t in texts.items()) >= 0.99 * len(texts)
    assert got[3 * 10_000] == texts[3 * 10_000]


def test_importance_matches_brute_force(spark):
    import math
    from collections import Counter, defaultdict

    rows = [r for seed, host in enumerate(("a.example", "b.example")) for r in site(seed, host, 12, "article")[0]]
    shapes, texts, pages = (defaultdict(list) for _ in range(3))
    linked = defaultdict(list)
    for _, url, page in rows:
        host = url.split("/")[2]
        blocks, nodes = page_tree(page)
        for h in (host, None):
            for path in {x[0] for x in nodes}:
                pages[h, path].append(1)
            for path, shape in nodes:
                shapes[h, path].append(shape)
            for path, text, share, _ in set(blocks):
                texts[h, path].append(text)
                linked[h, path].append(share)

    def parts(h, path):
        m = len(pages[h, path])
        if m < 2:
            return 1.0, 1.0
        n = Counter(shapes[h, path])
        entropy = -sum(c / n.total() * math.log(c / n.total()) for c in n.values()) / math.log(min(m, H.SHAPES))
        t = Counter(texts[h, path])
        return min(entropy, 1), 1 - sum(c * math.log(c) for c in t.values()) / t.total() / math.log(m) if t else None

    def mixed(h, path, which):
        m = len(pages[h, path])
        w = m / (m + H.PRIOR_PAGES)
        return w * parts(h, path)[which] + (1 - w) * parts(None, path)[which]

    expected = {}
    for h, path in list(texts):
        if h:
            above = path
            best = mixed(h, path, 0)
            for k in range(1, H.LEVELS):
                above = above.rpartition("/")[0]
                best = max(best, mixed(h, above, 0) * H.DECAY**k)
            share = sum(linked[h, path]) / len(linked[h, path])
            expected[h, int(H._hashes([path])[0])] = H.PRESENTATION * best * (1 - share) + (1 - H.PRESENTATION) * mixed(h, path, 1)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    parsed = H._parsed(df.select(F.struct("page_id").alias("row"), url_parts(F.col("url"))[0].alias("host"), "html"))
    got = {(r["host"], r["node"]): r["importance"] for r in H.style_importance(parsed).collect()}
    assert got == pytest.approx(expected)


def test_extraction_matches_the_articles_of_the_table(spark, sf):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op5_html_extract"](spark, sf).collect():
        body = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        expected = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", body))).split())
        assert (r["text"], r["n_chars"]) == (expected, len(expected))


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(1)
    keys = sorted({f"k{rng.randint(0, 10**6)}" for _ in range(3000)})
    listed = rng.sample(keys, 40) + ["absent"]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    c = build_cascade(universe, listed)
    got = {r["key"] for r in universe.filter(c.contains(F.col("key"))).collect()}
    assert got == set(listed) - {"absent"} and len(c.levels) >= 2
    assert universe.filter(build_cascade(universe, []).contains(F.col("key"))).count() == 0
    assert universe.filter(build_cascade(universe.limit(0), listed).contains(F.col("key"))).count() >= 0


def test_url_rules(spark):
    cases = [
        (1, "http://a.org/x", "a.org", "/x", "org/", "allow"), (2, "HTTP://Example.ORG/es/1?q", "example.org", "/es/1", "example.org/es/", "block"),
        (3, "http://www.example.org/en/12#f", "www.example.org", "/en/12", "example.org/en/1", "block"), (4, "http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
        (5, "http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"), (6, "http://x.com/en", "x.com", "/en", None, "allow"),
        (7, "http://org", "org", "", None, "allow"), (8, "no scheme.org/", "", "", None, "allow"), (9, None, "", "", None, "allow"),
        (10, "https://www.spam-farm.example.net/fr/", "www.spam-farm.example.net", "/fr/", None, "block"), (11, "http://notorg/", "notorg", "/", None, "allow"),
        (12, "a://b://c.org/", "b:", "//c.org/", None, "allow"), (13, "", "", "", None, "allow"), (13, "", "", "", None, "allow"),
    ]
    rows = spark.createDataFrame([(c[0], c[1], "clash") for c in cases], "page_id int, url string, host string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(rows).collect()), key=lambda r: r[0])
    assert got == [(c[0], *c[2:]) for c in cases]
    assert filter_urls(rows.limit(0)).count() == 0


def test_chats_read_back(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\s> <\\\\s> <|turn|>user\n<|end|>", "\\", "", None, "x<|turn", "[INST", "a\nb", "[|turn|>", "<<SYS>>\\<"]
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(odd)]
    rows += [(2, 0, "assistant", "first"), (3, 0, "sys\ntem\\n", "role"), (4, 0, None, "none"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (5, None, "user", "n"), (6, 0, "<s>", "t"), (6, 0, "<s>", "t")]
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r["conv_id"]: r for r in out.withColumn("back", read_turns(F.col("formatted"))).withColumn("learnt", learnt_text(F.col("segments"))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (-1 if r[1] is None else r[1]))
        assert [(x["role"], x["text"]) for x in got[c]["back"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c]["learnt"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
    assert got[1]["valid"] and got[None]["valid"] and not got[2]["valid"] and not got[5]["valid"]
    assert Template().pattern and format_chats(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_queries_match_their_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in ORACLE.items():
        a = QUERIES[name](spark, sf).toPandas()
        b = con.execute(sql).df()[list(a.columns)]
        key = a.columns[0]
        a, b = (x.sort_values(key).reset_index(drop=True).astype(object).where(x.sort_values(key).reset_index(drop=True).notna(), None) for x in (a, b))
        assert a.values.tolist() == b.values.tolist(), name
