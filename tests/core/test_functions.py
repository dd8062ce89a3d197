"""Golden cases of the column logic."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gazetta.functions import balance, briefs, deltas, html, money, quantity, replies, text
from gazetta.operators import aggregates, filters, joins, windows
from gazetta.operators.slugs import free_slugs
from gazetta.sources import feeds


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_amounts(spark):
    said = ["47 dead", "$5M", "5 million", "20,000 acres", "40%", "no number", "-3.5bn", None, ""]
    got = values(spark, [(s,) for s in said], "s string", quantity.amount(F.col("s")), quantity.unit(F.col("s")))
    assert got == [(47.0, "dead"), (5e6, None), (5e6, None), (20000.0, "acres"), (40.0, "%"), (None, None), (-3.5e9, None), (None, None), (None, None)]
    odd = ["5 t of grain", "+7 up", "3 ft² wide", "12 k-pop", "about 1,200.50, then 9", "5mn people", "2 trillion", "-4%", "10\n km", "7k"]
    got = values(spark, [(s,) for s in odd], "s string", quantity.amount(F.col("s")), quantity.unit(F.col("s")))
    assert got == [(5.0, "t"), (7.0, "up"), (3.0, "ft²"), (12000.0, "-pop"), (1200.5, ","), (5e6, "people"), (2e12, None), (-4.0, "%"), (10.0, "km"), (7000.0, None)]


def test_material(spark):
    cases = [((2, 10), 0.15, 1, True), ((100, 101), 0.15, 5, False), ((0, 1), 0.15, 5, False), ((60000, 66000), 0.10, 0, True), ((60000, 65000), 0.10, 0, False)]
    for (a, b), rel, bar, want in cases:
        assert values(spark, [(float(a), float(b))], "a double, b double", quantity.material(F.col("a"), F.col("b"), rel, bar)) == [(want,)]


def test_deltas(spark):
    cases = [("magnitude", "2", "10", "magnitude"), ("tally", "12", "47", "tally"), ("tally", "47", "12", None), ("status", "proposed", "passed committee", "status"), ("status", "Same ", "same", None), ("magnitude", "many", "few", None)]
    for kind, old, new, want in cases:
        assert values(spark, [(kind, old, new)], "k string, a string, b string", deltas.classify(F.col("k"), F.col("a"), F.col("b"), F.col("k"))) == [(want,)], kind
    crossed = deltas.classify(F.lit("magnitude"), F.lit("1"), F.lit("9"), F.lit("status"))
    assert values(spark, [(1,)], "x int", crossed) == [(None,)]
    note = deltas.note(F.lit("Bitcoin"), F.lit("price"), F.lit("60000"), F.lit("66000"), F.lit("2026-06-15").cast("date"))
    assert values(spark, [(1,)], "x int", note) == [("Bitcoin: was $60K on 2026-06-15, now $66K (+10%)",)]


def test_humanise(spark):
    got = values(spark, [(x,) for x in (66000.0, 1500000.0, 47.0, -5000.0, 0.0, 2.5e12)], "x double", text.humanise(F.col("x")))
    assert [x for (x,) in got] == ["66K", "1.5M", "47", "-5K", "0", "2.5T"]


def test_week_key(spark):
    ts = ["2026-06-17 13:00:00", "2026-06-14 20:00:00", "2026-06-14 21:00:00"]
    got = values(spark, [(x,) for x in ts], "t string", quantity.week_key(F.col("t").cast("timestamp"), "Asia/Tokyo"))
    assert [x for (x,) in got] == [datetime.date(2026, 6, 15), datetime.date(2026, 6, 8), datetime.date(2026, 6, 15)]


def test_bias_and_skew(spark):
    got = values(spark, [("Lean Left",), ("Right-Center",), ("Middle",), ("odd",), (None,)], "b string", balance.normalise_bias(F.col("b")))
    assert [x for (x,) in got] == ["left", "right", "center", None, None]
    rows = [("a", 1, "s1", "Left"), ("a", 2, "s2", "Lean Left"), ("a", 3, "s3", "Left")] + [("b", i, f"s{i}", "Left" if i < 4 else "Center") for i in range(1, 6)] + [("c", i, f"s{i % 2}", "Left") for i in range(5)]
    df = spark.createDataFrame(rows, "theme string, id int, source_id string, bias string")
    got = {r.theme: (r.skew, r.coverage) for r in aggregates.source_balance(df, ["theme"]).collect()}
    assert got == {"a": ("left 3/3", "left"), "b": (None, None), "c": (None, "left")}


def test_cosine(spark):
    cases = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 1.0], [2.0, 2.0], 1.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [1.0], 0.0), ([], [], 0.0)]
    got = values(spark, [c[:2] for c in cases], "a array<double>, b array<double>", F.round(quantity.cosine(F.col("a"), F.col("b")), 9))
    assert [x for (x,) in got] == [c[2] for c in cases]


def test_phone_and_bare_urls(spark):
    got = values(spark, [("+81 90 1234 5678",), ("call +1-415-555-2671 now",), ("+12",)], "s string", text.phone(F.col("s")))
    assert [x for (x,) in got] == ["+819012345678", "+14155552671", None]
    assert values(spark, [("[a](https://x) http://y (https://z)",)], "s string", text.bare_urls(F.col("s"))) == [(2,)]


def test_labels_and_slugs(spark):
    long = "word " * 20
    got = values(spark, [("A  b\nc.",), (long,), (None,), ("x" * 60,)], "s string", text.clean_label(F.col("s")), text.slug(F.col("s")))
    assert got == [("A b c", "a-b-c"), (("word " * 9).strip(), "word-word-word-word"), ("story", "drop"), ("x" * 48, "x" * 40)]


def test_slug_cut(spark):
    title = "aaaaaaaaaa aaaaaaaaaa aaaaaaaaaaaaaaaaa bb"
    assert values(spark, [(title,)], "s string", text.slug(F.col("s"))) == [("aaaaaaaaaa-aaaaaaaaaa-aaaaaaaaaaaaaaaaa",)]


@pytest.mark.parametrize("seed", range(4))
def test_free_slugs(spark, seed):
    """Against the rule, title after title; numbers that others need are given and taken in any order."""
    rng = random.Random(seed)
    names = ["x", "x", "x", "x-2", "x-3", "x-2-2", "x-10", "y-1", "y-01", "y", "drop", "x-2-2-2", "7", "7-2"]
    rows = [(rng.choice(["s", "t", None]), i, rng.choice(names)) for i in rng.sample(range(1000), 150)]
    taken = [("s", "x"), ("s", "x-4"), ("t", "drop-2"), ("s", "x-2-3")] if seed % 2 else []
    got = free_slugs(spark.createDataFrame(rows, "scope string, id long, slug string"), "scope", "id", taken=spark.createDataFrame(taken, "scope string, slug string") if taken else None)
    used = {}
    for s, t in taken:
        used.setdefault(s, set()).add(t)
    want = {}
    for s, i, base in sorted(rows, key=lambda r: r[1]):
        mine = used.setdefault(s, set())
        made, n = base, 2
        while made in mine:
            made, n = f"{base}-{n}", n + 1
        mine.add(made)
        want[i] = made
    assert {r.id: r.slug for r in got.collect()} == want and got.columns == ["scope", "id", "slug"]


def test_feed_dates(spark):
    utc = datetime.UTC
    said = {
        "Wed, 03 May 2023 21:00:00 GMT": (2023, 5, 3, 21, 0), "3 May 2023 21:00 +0900": (2023, 5, 3, 12, 0), "Thu,  04 may 23 01:02:03 EST": (2023, 5, 4, 6, 2, 3), "04 May 2023 01:02:03": (2023, 5, 4, 1, 2, 3),
        "2023-05-03T21:00:00Z": (2023, 5, 3, 21, 0), "2023-05-03T21:00:00+02:00": (2023, 5, 3, 19, 0), "2023-05-03 21:00:00": (2023, 5, 3, 21, 0), "yesterday": None, "04 May 2023 01:02:03 XYZ": None, "": None, None: None,
    }
    got = values(spark, [(s,) for s in said], "s string", F.unix_seconds(feeds.feed_date(F.col("s"))))
    assert [g for (g,) in got] == [int(datetime.datetime(*t, tzinfo=utc).timestamp()) if t else None for t in said.values()]


def test_feed_entries(spark):
    now = F.lit(datetime.datetime(2023, 5, 4)).cast("timestamp")
    rows = [
        ("s", "<item><title>Old one</title><link>https://a/1</link><pubDate>Mon, 01 May 2023 21:00:00 GMT</pubDate></item>"),
        ("s", "<item><title>New one</title><link>https://a/2</link><pubDate>Wed, 03 May 2023 21:00:00 GMT</pubDate><description>d</description><content:encoded>c</content:encoded></item>"),
        ("s", '<entry xmlns="http://www.w3.org/2005/Atom"><title>Atom</title><link rel="self" href="https://a/f"/><link href="https://a/3"/><updated>2023-05-03T01:00:00Z</updated><content>body</content></entry>'),
        ("s", "<item><title>Undated</title><link>https://a/4</link></item>"),
        ("s", "<item><title>Prefixed</title><link>https://a/5</link><dc:date>2023-05-03T05:00:00Z</dc:date></item>"),
        ("s", "<item><title>Partner offer</title><link>https://a/6</link></item>"),
        ("s", "<item><title>No link</title></item>"),
        ("s", "broken <"),
        ("s", None),
    ]
    got = feeds.entries(spark.createDataFrame(rows, "source string, xml string"), "xml", "source", now, 48, 9).collect()
    assert {r.url: (r.title, r.published_at.isoformat(), r.body) for r in got} == {
        "https://a/2": ("New one", "2023-05-03T21:00:00", "d"), "https://a/3": ("Atom", "2023-05-03T01:00:00", "body"), "https://a/4": ("Undated", "2023-05-04T00:00:00", ""), "https://a/5": ("Prefixed", "2023-05-03T05:00:00", ""),
    }


def test_citations_by_surface(spark):
    brief = "## Top\n  [1] Big title — [Reuters](https://r.com/a)  \n[2] No link here\n- **Chips** – up 3% [Wire](http://w.com/b)\nplain [x](https://y.z) text"
    link, plain, none, bare = (briefs.cited(F.col("s"), *a) for a in (("hyperlink",), ("plain",), ("none",), ("none", False, False)))
    got = values(spark, [(brief,)], "s string", link, plain, none, bare, briefs.cited(F.col("s"), "plain", False))[0]
    rest = "\nplain [x](https://y.z) text"
    assert got[0] == "## Top\n  1. Big title — [Reuters](https://r.com/a)\n[2] No link here\n- **Chips** — up 3% [Wire](http://w.com/b)" + rest
    assert got[1] == "## Top\n  1. Big title — Reuters https://r.com/a\n[2] No link here\n- **Chips** — up 3% Wire http://w.com/b" + rest
    assert got[2] == "## Top\n  1. Big title — Reuters\n[2] No link here\n- **Chips** — up 3% Wire" + rest
    assert got[3] == "## Top\n  Big title\n[2] No link here\n- **Chips** — up 3%" + rest
    assert got[4] == "## Top\n  1. Big title — https://r.com/a\n[2] No link here\n- **Chips** — up 3% http://w.com/b" + rest
    assert values(spark, [("# One\n#no\n### \U0001f4c8 Two ",)], "s string", briefs.headings_to_bold(F.col("s"))) == [("**One**\n#no\n**\U0001f4c8 Two**",)]


def test_chat_text(spark):
    md = "## \U0001f4c8 What Changed \n- one **bold** and [Reuters](https://r.com/a)\n  * two\n*Articles:* list\ntext [a](x) **b** *c*"
    want = "*\U0001f4c8 What Changed*\n• one *bold* and Reuters\n• two\n*Articles:* list\ntext a *b* *c*"
    assert values(spark, [(md,)], "s string", briefs.plain_chat(F.col("s"))) == [(want,)]


def test_without_sources(spark):
    md = "Head [1]\n\n*Articles:*\n[1] One — [s](https://a)\n [2] Two\n\n[3] stays as text\nBody [s](https://b) end [2].\n*Articles:* x\n[4] gone\nnext\n[5] kept\n\n\n\nlast"
    want = "Head stays as text\nBody end.\nnext kept\n\nlast"
    rows = spark.createDataFrame([(1, md), (2, "*Articles:*"), (3, ""), (4, None)], "id int, s string")
    got = {r.id: r.text for r in briefs.without_sources(rows, "id", "s").collect()}
    assert got == {1: want, 2: "", 3: "", 4: ""}


def test_placed_sections(spark):
    foot, high = briefs.placed_section(F.col("t"), F.col("s")), briefs.placed_section(F.col("t"), F.col("s"), above_highlights=True)
    rows = [("a\n---\nb\n---\nfoot", "S"), ("a\n## Highlights\n- x\n---\nfoot", "S\n"), ("a\n---  \nb", "S"), ("a \n", "S"), ("a", ""), ("a", None)]
    got = values(spark, rows, "t string, s string", foot, high)
    assert got == [
        ("a\n---\nb\n\nS\n\n---\nfoot", "a\nS\n\n---\nb\n---\nfoot"),
        ("a\n## Highlights\n- x\n\nS\n\n\n---\nfoot", "a\nS\n\n## Highlights\n- x\n---\nfoot"),
        ("a\n---  \nb\n\nS\n", "a\nS\n\n---  \nb"),
        ("a\n\nS\n", "a\n\nS"),
        ("a", "a"),
        ("a", "a"),
    ]


def test_sign_ups_and_translations(spark):
    said = text.sign_up(F.col("s"), ["Crypto", "geo", ""], ["short", "long"])
    got = [r[0] for r in values(spark, [("+81 90 1234 5678, GEO and crypto, a Short one",), ("nothing",), (None,)], "s string", said)]
    assert [(r.phone, r.topics, r.length) for r in got] == [("+819012345678", ["Crypto", "geo"], "short"), (None, [], None), (None, [], None)]
    rows = [("سلام دنیا abc", 20), ("I need to clarify my role", 20), ("سلا", 40), ("123", 4), (None, 1)]
    good = text.in_script(F.col("s"), F.col("n"), "[\\x{0600}-\\x{06FF}]")
    assert [x for (x,) in values(spark, rows, "s string, n int", good)] == [True, False, False, False, False]
    assert [x for (x,) in values(spark, rows, "s string, n int", text.in_script(F.col("s"), F.col("n"), None))] == [True, True, False, True, False]


def test_markdown_links(spark):
    md = "[short](https://a) ![a picture of the day](https://i) [A title that is long enough](https://x/1) [A title that is long enough](https://x/1)\n[Another \\ long title here too](https://x/2)"
    got = html.markdown_links(spark.createDataFrame([(1, md)], "id int, md string"), "id", "md").collect()
    assert [(r.rank, r.url, r.title) for r in got] == [(1, "https://x/1", "A title that is long enough"), (2, "https://x/2", "Another long title here too")]


def test_junk(spark):
    pats = spark.createDataFrame([("/tag/", "url_contains", True, 1), (".pdf", "url_endswith", True, 2), ("live blog", "title_contains", True, 3), ("x", "url_contains", False, 4)], "pattern string, pattern_type string, active boolean, position int")
    url = "https://example.com/a/long/enough"
    rows = [(1, url, "A title that is fine"), (2, url + "/TAG/x", "A title that is fine"), (3, url + ".pdf", "A title that is fine"), (4, url, "The LIVE BLOG of today"), (5, "https://a.b", "A title that is fine"), (6, url, "short"), (7, "ftp" + url, "A title that is fine"), (8, None, "A title that is fine")]
    df = spark.createDataFrame(rows, "id int, url string, title string")
    assert [r.id for r in filters.drop_junk(df, pats).collect()] == [1]
    assert {r.id: r.signature for r in filters.junk_signature(df, pats).collect()} == {2: "/tag/", 3: ".pdf", 4: "live blog"}


def test_windows_of_sources(spark):
    got = values(spark, [(None,), (72,), (4,), (0,)], "h int", filters.freshness_window(F.col("h")), filters.freshness_window(F.col("h"), first_run=True), filters.freshness_window(F.col("h"), cap=6))
    assert got == [(24, 48, 6), (72, 72, 6), (4, 48, 4), (24, 48, 6)]


def test_replies(spark):
    raw = ["```json\n[{\"article_id\": \"1\", \"relevance_score\": 9, \"label\": \"IMMEDIATE\", \"actionability\": 1}]\n```", "text {\"article_id\": \"2\", \"relevance_score\": 11, \"label\": \"odd\"} more", "no json", "[broken", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string").select("i", F.explode_outer(replies.items(F.col("raw"))).alias("x")).select("i", replies.clean_score(F.col("x"), []).alias("s")).collect()
    by = {r.i: r.s for r in got if r.s is not None and r.s.article_id}
    assert (by[0].relevance, by[0].label, by[0].actionability, by[0].perspective) == (9, "IMMEDIATE", 2, True)
    assert (by[1].relevance, by[1].label) == (0, "NOISE") and set(by) == {0, 1}


def test_brief_text(spark):
    cut = "## Head\nA full line.\n\nhalf a line\n- cut"
    assert values(spark, [(cut,)], "s string", briefs.truncated_tail(F.col("s"))) == [("## Head\nA full line.",)]
    chunks = briefs.chunk_sections(F.col("s"), 12)
    assert values(spark, [("intro\n## a\n## b",), ("## a\n12\n## bb\n345\n## c\n0123456789012",), ("short",), ("",)], "s string", chunks) == [(["intro\n## a\n", "## b"],), (["## a\n12\n", "## bb\n345\n", "## c\n0123456", "789012"],), (["short"],), ([""],)]
    assert values(spark, [(9000,), (8800,)], "n int", briefs.over_cap(F.col("n"), 8000, 1.12)) == [(1000,), (None,)]


def test_money_in_a_section(spark):
    rows = [
        ("Deals totaling $1.2 billion: $300 million, $300M, $200 million and $148 mn.",),
        ("Deals totaling $948 million: $300 million, $300M, $200 million and $148 mn.",),
        ("Combined $9 million. $1 million and $2 million",),
        ("A total of many words and then a great deal more of them $9 million, $1 million",),
        ("Collectively $5. $1 million",),
        ("Altogether $5 million and a stray $5",),
        (None,),
    ]
    assert [r[0] for r in values(spark, rows, "s string", money.total_mismatch(F.col("s")))] == [True, False, True, False, False, False, False]
    pages = ["[s](https://a.jp/a) $5", "[s](https://a.com/doyen-b) $5", "[s](https://a.com/5-円-b) $5M", "[s](https://a.com/5-yen-b) $5", "[s](https://a.com/yen) no figure", "[s](https://a.com/yen_rate) $ 1,000"]
    assert [r[0] for r in values(spark, [(p,) for p in pages], "s string", money.currency_mismatch(F.col("s")))] == [False, False, True, True, False, True]


def test_coverage_cards(spark):
    html = """<a href="/article/1"><h4>Blindspot: Only</h4> <b>13%</b> Left 11 sources US denied a request Left 13 % Center 12 % Right 75 %</a>
    <a href="https://x.org/story/2">blindspot: 20% right 4 source Second one 3 hours ago</a><a href="/article/1">Blindspot: 5% Left 9 sources again</a>
    <a href="/topic/3">Blindspot: 5% Left 9 sources elsewhere</a><a href="/story/4">No card here</a><a href="/story/5">Blindspot: 7% Center 30 sources Third - Show more of it</a>"""
    pages = spark.createDataFrame([(1, html)], "id int, html string")
    got = [tuple(r)[2:] for r in money.coverage_cards(pages, "id", "html", most=9, base="https://b.org").orderBy("rank").collect()]
    assert got == [("https://b.org/article/1", "Left", 13, 11, "US denied a request"), ("https://x.org/story/2", "Right", 20, 4, "Second one"), ("https://b.org/story/5", "Center", 7, 30, "Third")]
    assert [r.sources for r in money.coverage_cards(pages, "id", "html", least_sources=10, most=0).collect()] == [11]


def test_overstated_highlights(spark):
    brief = "# Top\n- X has signed the deal [s](https://a/1)\n- Y signed too [t](https://a/2)\n- again [s](https://a/1)\n- Z may close [u](https://a/3)"
    rows = [("b", "https://a/1", "X plans\n to buy"), ("b", "https://a/2", "Y bought"), ("b", "https://a/3", "Z could"), ("b", "https://a/4", "could"), ("c", "https://a/1", "could")]
    h = spark.createDataFrame(rows, "id string, url string, title string").selectExpr("*", "null differentiator", "null reasoning", "null body")
    got = briefs.overstated(h, spark.createDataFrame([("b", brief)], "id string, content string"), "id", "content").collect()
    assert [r.url for r in got] == ["https://a/1"]


def test_gate(spark):
    b = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    f = spark.createDataFrame([(1, "minor"), (1, "critical"), (2, "minor"), (4, "odd")], "id int, severity string")
    got = {r.id: (r.faults, r.worst, r.alert) for r in briefs.gate(b, f, "id").collect()}
    assert got == {1: (2, "critical", True), 2: (1, "minor", False), 3: (0, None, False), 4: (1, None, False)}
    assert {r.id for r in briefs.gate(b, f, "id", "minor").collect() if r.alert} == {1, 2}


def test_cluster_summary(spark):
    t = datetime.datetime
    rows = [("p", 1, t(2026, 1, 1, 1), "Bitcoin surges", ""), ("p", 2, t(2026, 1, 1, 3), "BTC rally", ""), ("q", 3, t(2026, 1, 1, 1), "a", ""), ("q", 4, t(2026, 1, 1, 9), "b", ""), ("q", 5, None, "c", ""), ("r", 6, None, "alone", "")]
    m = spark.createDataFrame(rows, "cluster string, id int, published_at timestamp, title string, body string")
    e = spark.createDataFrame([("q", 0.88), ("q", 0.95)], "cluster string, similarity double")
    got = {r.cluster: r for r in aggregates.cluster_summary(m, e).collect()}
    assert set(got) == {"p", "q"}
    assert (got["p"].kind, got["p"].primary_id, got["p"].span_hours, got["p"].min_similarity, got["p"].review) == ("price_event", 2, 2.0, 1.0, False)
    assert (got["q"].kind, got["q"].primary_id, got["q"].min_similarity, got["q"].review) == ("analysis", 3, 0.88, True)


def test_cluster_category(spark):
    rows = [("a", "c", 1), ("a", "c", 2), ("a", "t", 3), ("b", "c", 1), ("b", "t", 2), ("d", None, 1), ("e", None, 1), ("e", "c", 2), ("e", "t", 3)]
    got = aggregates.cluster_category(spark.createDataFrame(rows, "g string, v string, rank int"), "g", "v", "rank").collect()
    assert {r.g: r.v for r in got} == {"a": "c", "b": "c", "d": None, "e": "c"}


def test_best_match(spark):
    s = spark.createDataFrame([(1, [0.99, 0.01]), (2, [0.7, 0.7])], "story_id long, vector array<double>")
    th = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "thread_id long, vector array<double>")
    got = {r.story_id: r.thread_id for r in joins.best_match(s, th, 0.95).collect()}
    assert got == {1: 1, 2: None}


@pytest.mark.parametrize("floors,want", [(True, [1, 3, 4]), (False, [3])])
def test_eligible(spark, floors, want):
    rows = [("x", 1, "crypto", 1), ("x", 2, "crypto", 1), ("x", 3, "crypto", 2), ("x", 4, "weekly", 1)]
    got = windows.eligible(spark.createDataFrame(rows, "b string, cluster_rank int, bundle string, size int"), "b", 2, floors)
    assert sorted(r.cluster_rank for r in got.collect()) == want


def test_merge_rows(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, name string, weight double")
    new = spark.createDataFrame([(2, "B", None), (3, "c", 3.0)], "k int, name string, weight double")
    assert sorted(tuple(r) for r in joins.merge_rows(new, old, "k").collect()) == [(1, "a", 1.0, "keep"), (2, "B", 2.0, "update"), (3, "c", 3.0, "insert")]
