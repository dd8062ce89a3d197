"""The selection jobs against sequential statements of their rules."""

import datetime as dt
import math
import random
from collections import Counter

from test_greedy import themes

from gazetta.plans.briefs import brief_selection, chat_selection

NOW = dt.datetime(2024, 1, 3, 21)
ARTICLE = "id long, category string, source_id string, story long, topics array<string>, relevance int, actionability int, published_at timestamp"


def articles(rng, n, categories):
    words = [f"t{i}" for i in range(14)]
    rows = []
    for i in range(n):
        topics = rng.choice([None, [], rng.sample(words, rng.randint(1, 4)), rng.sample(words, rng.randint(2, 5))])
        hours = rng.randint(0, 90) + rng.random() / 2
        rows.append((i, rng.choice(categories), f"s{rng.randint(0, 5)}", rng.choice([None, None, rng.randint(0, 9)]), topics, rng.choice([None, *range(11)]), rng.choice([None, 0, 0, 1, 2]), None if i % 29 == 7 else NOW - dt.timedelta(hours=hours)))
    return rows


def score(a):
    return 10 * (a[5] or 0) + 15 * (a[6] or 0)


def over(a, bar):
    return (a[6] or 0) >= 2 or ((a[5] or 0) >= 1 and a[5] >= bar)


def order(rows):
    return sorted(rows, key=lambda a: (-score(a), -a[7].timestamp(), a[0]))


def clustered(rows, most):
    """Clusters in order of their scores, members in rank order, and each one's category."""
    rows = order(rows)
    seed = themes([(a[0], k, list(dict.fromkeys(a[4] or []))) for k, a in enumerate(rows)], most)
    groups = {}
    for a in rows:
        groups.setdefault(seed[a[0]], []).append(a)
    found = sorted(groups.values(), key=lambda g: -sum(map(score, g)))

    def category(g):
        n = Counter(a[1] for a in g if a[1])
        lead = [c for c in n if n[c] == max(n.values())]
        return lead[0] if len(lead) == 1 else (g[0][1] or (lead[0] if lead else None))

    return [(g, category(g)) for g in found]


def thinned(left, in_theme, count, bar):
    best = [a for a in order(left) if (a[5] or 0) >= bar][:count]
    stories = {a[3] for a in in_theme if a[3] is not None}
    kept = []
    for h in best:
        if h[3] is not None and (h[3] in stories or any(k[3] == h[3] for k in kept)):
            continue
        mine = set(h[4] or [])
        if any(len(mine & set(k[4] or [])) >= 3 and mine == set(k[4] or []) for k in kept):
            continue
        kept.append(h)
    return kept


def one_brief(rows, account, now, had, scored, windows_, drop_cats):
    age = lambda a: (now - a[7]).total_seconds() / 3600 if a[7] else None
    mine = [a for a in rows if a[0] in scored and (account, a[0]) not in had and a[7] is not None and age(a) >= 0]
    news = [a for a in mine if a[1] not in drop_cats and age(a) <= windows_.get(a[1], 24)]
    for relax in range(3):
        gated = [a for a in news if over(a, 6 - relax)]
        if len(gated) >= 3:
            break
    if not gated:
        return [], "skip: quiet_day_no_articles"
    groups = clustered(gated, 6)
    first, eligible = set(), []
    for g, c in groups:
        if len(g) >= 2 or (c is not None and c not in first):
            eligible.append((g, c))
        first.add(c)
    active = {c for _, c in eligible if c}
    target = max(min(math.ceil(1.5 * len(active)), 10), len(active))
    taken, per = [], Counter()
    for k, (_, c) in enumerate(eligible):
        if c and per[c] < 1:
            taken.append(k)
            per[c] += 1
    for k, (_, c) in enumerate(eligible):
        if len(taken) < target and c and k not in taken and per[c] < 2:
            taken.append(k)
            per[c] += 1
    chosen = [eligible[k][0] for k in sorted(taken)]
    status = "skip: no_clusters" if len(chosen) < (3 if len(gated) >= 3 else 1) else "normal" if len(gated) >= 3 else "quiet"
    if status.startswith("skip"):
        return [], status
    in_theme = [a for g in chosen for a in g]
    lights = thinned([a for a in gated if a not in in_theme], in_theme, 8, 8)
    pool = order([a for a in mine if a[1] in drop_cats and age(a) <= 168])
    once, again = [], []
    for a in pool:
        (again if a[2] in [x[2] for x in once] else once).append(a)
    drops = (once + again)[:3]
    main = {t for a in chosen[0] for t in a[4] or []}
    woven = [a for a in drops if main & set(a[4] or [])]
    out = []
    for k, g in enumerate(chosen):
        out += [("theme", k + 1, a[0]) for a in g] + [("woven", 1, a[0]) for a in woven if k == 0]
    out += [("highlight", 0, h[0]) for h in lights] + [("drop", 0, a[0]) for a in drops if a not in woven]
    return out, status


def test_brief_selection(spark):
    rng = random.Random(21)
    cats = ["tech", "geo", "crypto", None, "probe"]
    rows = articles(rng, 260, cats)
    briefs = [(f"{a}/{d}", a, NOW - dt.timedelta(days=d)) for a in ("x", "y") for d in range(4)] + [("thin", "z", NOW - dt.timedelta(hours=88)), ("none", "z", NOW - dt.timedelta(days=30))]
    had = {(rng.choice("xy"), rng.randrange(260)) for _ in range(120)}
    scored = [i for i in range(260) if i % 6]
    windows_ = {"geo": 48}
    frames = (
        spark.createDataFrame(rows, ARTICLE),
        spark.createDataFrame(briefs, "brief string, account string, as_of timestamp"),
        spark.createDataFrame([(i, a) for a, i in had], "article_id long, account string"),
        spark.createDataFrame([(i,) for i in scored], "article_id long"),
        spark.createDataFrame(list(windows_.items()), "category string, window_hours int"),
    )
    selection, status = brief_selection(*frames, ["probe"])
    got, said = {}, {r.brief: r.status for r in status.collect()}
    for r in selection.orderBy("brief", "place").collect():
        got.setdefault(r.brief, []).append((r.role, r.cluster_rank, r.id))
    seen = set()
    for name, account, now in briefs:
        want, why = one_brief(rows, account, now, had, set(scored), windows_, {"probe"})
        assert got.get(name, []) == want and said[name] == why, name
        seen |= {x[0] for x in want} | {why}
    assert {"theme", "woven", "highlight", "drop", "normal", "skip: quiet_day_no_articles"} <= seen


def test_chat_selection(spark):
    rng = random.Random(4)
    rows = articles(rng, 200, ["tech", "geo", None])
    include = {"a": ["t1", "t2"], "b": ["t5", "t6", "t7"]}
    exclude = {"a": ["t9"], "b": [], "*": ["t13"]}
    lengths = {"short": (7, 5, 3, 2, 4), "long": (6, 4, 30, 5, 6)}
    chats = [(1, ["a"], "short"), (2, ["b", "a"], "long"), (3, ["a", "b", "a"], "long"), (4, ["b"], "short")]
    got = {}
    found = chat_selection(
        spark.createDataFrame(rows, ARTICLE),
        spark.createDataFrame(chats, "chat long, categories array<string>, length string"),
        spark.createDataFrame([(c, include.get(c, []), exclude[c]) for c in exclude], "category string, include array<string>, exclude array<string>"),
        spark.createDataFrame([(k, *v) for k, v in lengths.items()], "length string, bar int, floor int, least int, max_themes int, per_theme int"),
        __import__("pyspark.sql.functions", fromlist=["lit"]).lit(NOW),
        window=72,
    )
    for r in found.orderBy("chat", "place").collect():
        got.setdefault(r.chat, []).append((r.role, r.cluster_rank, r.id))
    for chat, categories, length in chats:
        bar, floor, least, max_themes, per_theme = lengths[length]
        age = lambda a: (NOW - a[7]).total_seconds() / 3600
        mine = []
        for a in rows:
            text = " ".join(a[4] or []).lower()
            if a[4] is not None and a[7] and age(a) <= 72 and any(any(w in text for w in include[c]) and not any(w in text for w in exclude[c] + exclude["*"]) for c in categories):
                mine.append(a)
        for b in range(bar, floor - 1, -1):
            enough = [a for a in mine if over(a, b)]
            if len(enough) >= least:
                break
        enough += [a for a in mine if a not in enough and age(a) <= 6 and over(a, floor)]
        groups = clustered(enough, per_theme)[:max_themes]
        per, chosen = Counter(), []
        for g, c in groups:
            per[c] += 1
            if c is None or per[c] <= 2:
                chosen.append(g)
        in_theme = [a for g in chosen for a in g]
        lights = thinned([a for a in enough if a not in in_theme], in_theme, 8, 8)
        assert got.get(chat, []) == [("theme", k + 1, a[0]) for k, g in enumerate(chosen) for a in g] + [("highlight", 0, h[0]) for h in lights], chat
    assert got[2] == got[3] and len(got[2]) > 10
