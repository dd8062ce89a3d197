"""Contextual patterns against a plain version; texts that could take quadratic time; odd rows."""

import random
import time
from collections import Counter, defaultdict

from gazetta.llm import contracts, pii

APART = set(pii.APART)


def tokens(t):
    return "".join(" " if c in APART else c.lower() for c in t).split(" ")


def plain(texts, rounds=3, least_seeds=3, accept=0.6):
    texts = [t or "" for t in texts]
    words = [[w for w in tokens(t) if w] for t in texts]
    single = Counter(w for ws in words for w in ws)
    pairs = Counter((a, c) for ws in words for a, _, c in zip(ws, ws[1:], ws[2:]))
    seen = []
    for i, t in enumerate(texts):
        base = pii.base_spans(t)
        every = base + [(a, -1, b) for a, b in pii.candidates(t, base)]
        for a, k, b in every:
            low, high = max([e for _, _, e in every if e <= a], default=0), min([s for s, _, _ in every if s >= b], default=len(t))
            left, right = (next((w for w in side if w), None) for side in (reversed(tokens(t[low:a])), tokens(t[b:high])))
            if left:
                seen.append((i, a, b, k, t[a:b].lower(), [left] + ([(left, right)] if right else [])))
    held, seeds = Counter(), defaultdict(set)
    for _, _, _, k, x, ps in seen:
        for p in ps:
            held[p, x, k] += 1
            if k >= 0:
                seeds[p, k].add(x)
    open_ = {p for (p, _, k) in held if k < 0}
    support = {(p, k) for (p, k), s in seeds.items() if len(s) >= least_seeds and p in open_}
    marked = Counter()
    for (p, _, _), n in held.items():
        marked[p] += n
    times = {p: max(marked[p], (single if isinstance(p, str) else pairs)[p]) for p, _ in support}
    fixed = {(x, k): 1.0 for _, _, _, k, x, _ in seen if k >= 0}
    scores = dict(fixed)
    for _ in range(rounds):
        confidence = {(p, k): sum(n * scores.get((x, k), 0) for (q, x, _), n in held.items() if q == p) / times[p] for p, k in support}
        scores = dict(fixed)
        for (p, x, own) in held:
            for k in range(4):
                if own < 0 and confidence.get((p, k), 0) > 0:
                    scores[x, k] = max(scores.get((x, k), 0), min(1.0, confidence[p, k]))
    out = [[] for _ in texts]
    for i, a, b, k, x, _ in seen:
        best = max(((scores.get((x, o), 0), -o) for o in range(4)), default=(0, 0))
        if k < 0 and best[0] >= accept:
            out[i].append((a, -best[1], b))
    return [sorted(x) for x in out]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_scores_match_a_plain_version(spark):
    rng = random.Random(9)
    cards = ["4539578763621486", "6011000990139424", "5500005555555559", "4111111111111111"]
    unseen = ["4539578763621487", "AB-99 12345", "77001234", "x@localhost"]
    texts = []
    for _ in range(120):
        lead = rng.choice(["cardno ", "cardno:", "cardno = ", "id=", "the ", "number (", "mail <"])
        what = rng.choice(cards + unseen + ["a.b@c.de", "10.1.2.3", "+1 (366) 555-9807", "word"])
        texts.append(" ".join(rng.choices(["some", "plain", "the", "number", "Words"], k=rng.randint(0, 5))) + " " + lead + what + rng.choice([" and more", ", then the end", ""]))
    texts += [None, "", texts[0], texts[0]]
    got = {r.doc_id: sorted(tuple(x) for x in r.added) for r in pii.extract_pii(frame(spark, texts)).collect()}
    want = plain(texts)
    assert got == dict(enumerate(want)) and any(want)


def test_glued_contexts_find_unseen_identifiers(spark):
    seeds = ("4539578763621486", "6011000990139424", "5500005555555559", "4111111111111111")
    for lead in ("cardno:", "id="):
        texts = [f"words {lead}{n} and more" for n in seeds] + [f"words {lead}{'4539578763621487' * 8} and more", "the year 19991999 was plain"]
        got = {r.doc_id: [tuple(x) for x in r.added] for r in pii.extract_pii(frame(spark, texts)).collect()}
        assert got[4] == [(6 + len(lead), 2, 6 + len(lead) + 128)] and not got[5]


def test_two_sided_contexts(spark):
    seeds = ("4539578763621486", "6011000990139424", "5500005555555559", "4111111111111111")
    texts = [f"pay by {n} today" for n in seeds] * 3 + ["pay by 4539578763621487 today", "by 12345678 nobody"] + ["by and by the road goes on by the sea"] * 40
    got = {r.doc_id: [tuple(x) for x in r.added] for r in pii.extract_pii(frame(spark, texts)).collect()}
    assert got[12] == [(7, 2, 23)] and not got[13]


def test_no_text_takes_quadratic_time():
    for t in ("1" * 80_000, "1." * 40_000, "+1" * 40_000, "+1(((" * 20_000, "a@" * 40_000, "a" * 80_000 + "@", "1.2.3.4 " * 20_000, "4111111111111111 x1234 " * 5_000, " " * 80_000 + "1.2.3.4", "x@" + "a-" * 40_000):
        began = time.time()
        pii.marks(t)
        assert time.time() - began < 1.5, t[:20]


def test_contract_columns(spark, tmp_path):
    import hashlib

    texts = ["mail a.b@c.de or 10.0.0.1", None, "", "mail a.b@c.de or 10.0.0.1"]
    frame(spark, texts).selectExpr("*", "'en' lang", "'s' source").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in contracts.personal_data(spark, str(tmp_path)).collect()}
    assert len(got) == 4 and got[0].spans == "email:5:13,ip:17:25" and got[1].spans == ""
    assert (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone) == (1, 1, 0, 0)
    assert got[0].base_sha256 == hashlib.sha256(b"email:5:13,ip:17:25").hexdigest() and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.extract_pii(frame(spark, texts).limit(0)).count() == 0
