"""Recall and precision of the spans that bootstrapping adds, on prose with identifiers in and out of contexts."""

import random

from gazetta.llm import pii


def luhn(rng):
    body = [rng.randint(0, 9) for _ in range(15)]
    total = sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(body))
    return "".join(map(str, body)) + str(-total % 10)


def test_unseen_identifiers_in_contexts(spark):
    rng = random.Random(14)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    # Contexts that hold base identifiers, and ones of which the base patterns know no form.
    seen = {"card": lambda: luhn(rng), "mailto": lambda: f"{prose(1)}.{rng.randint(1, 99)}@{prose(1)}.example", "hotline": lambda: f"+{rng.randint(10**10, 10**11)}"}
    unseen = {"card": lambda: str(rng.randint(10**11, 10**12)), "mailto": lambda: f"{prose(1)}{rng.randint(100, 999)}@{prose(1)}", "hotline": lambda: f"0{rng.randint(10**8, 10**9)}"}
    left = {"card": "cardno:", "mailto": "mailto:", "hotline": "hotline "}
    rows, want, decoys = [], set(), 0
    for i in range(900):
        kind = rng.choice(list(left))
        before = prose(rng.randint(3, 30)) + " "
        if i % 3 == 0:
            value = unseen[kind]()
            start = len(before) + len(left[kind])
            want.add((i, start, start + len(value)))
            text = f"{before}{left[kind]}{value} {prose(9)}"
        elif i % 3 == 1:
            text = f"{before}{left[kind]}{seen[kind]()} {prose(9)}"
        else:  # numbers and handles in plain prose
            decoys += 1
            text = f"{before}{rng.choice([str(rng.randint(1000, 10**9)), f'{prose(1)}@{prose(1)}', '2024-05-17'])} {prose(9)}"
        rows.append((i, text))
    got = {(r.doc_id, x.start, x.end) for r in pii.extract_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect() for x in r.added}
    hit = len(got & want)
    print(f"added {len(got)}, unseen {len(want)}, decoys {decoys}, recall {hit / len(want):.3f}, precision {hit / max(1, len(got)):.3f}")
    assert hit >= 0.95 * len(want) and hit >= 0.95 * len(got)
