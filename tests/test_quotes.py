import random

import pytest

from docloom.operators import quotes as qs

QUOTES, TEXTS = "doc_id long, quote_id int, quote string", "doc_id long, text string"


def table(quote, text):
    """Least distances of quote to substrings by where they end, by the plain table."""
    row = list(range(len(quote) + 1))
    for c in text:
        new = [0]
        for i, p in enumerate(quote):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        yield row[-1]


def brute(quote, text, most):
    """All passages: runs of ends within `most`, the least distance of each, its first end and last start."""
    q, t = qs.fold(quote), qs.fold(text)
    runs, before = [], None
    for end, d in enumerate(table(q, t), 1):
        if d <= most:
            if before != end - 1:
                runs.append((d, end))
            elif d < runs[-1][0]:
                runs[-1] = (d, end)
            before = end
    out = []
    for d, end in runs:
        start = max(s for s in range(end + 1) if list(table(q, t[s:end]))[-1:] == [d] or (s == end and len(q) == d))
        out.append((d, end, start))
    return sorted(out)


def spoil(rng, quote, errors):
    q = list(quote)
    for _ in range(errors):
        i = rng.randrange(len(q))
        kind = rng.randrange(3)
        q[i : i + (kind != 1)] = [] if kind == 0 and len(q) > 1 else [rng.choice("xyzé")]
    return "".join(q)


def test_columns_against_the_plain_table():
    rng = random.Random(1)
    for _ in range(300):
        q, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (90, 200))
        assert list(qs.column_ends(q, t)) == list(table(q, t))


@pytest.mark.parametrize("alphabet,threshold", [("ab", 0.2), ("abcdefghij ", 0.3), ("abcdefghij ", 0.45), ("aé😀 ", 0.1)])
def test_runs_against_brute_force(alphabet, threshold):
    rng = random.Random(alphabet)
    found = 0
    for _ in range(60):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 300)))
        at = rng.randrange(len(text))
        quote = spoil(rng, text[at : at + rng.randrange(5, 40)] or "q", rng.randrange(5))
        most = int(len(quote) * threshold)
        got = sorted((d, e, s) for _, _, d, s, e in qs.runs(qs.Index(text), text, quote, most))
        assert got == brute(quote, text, most)
        assert sorted((d, e, s) for _, _, d, s, e in qs.nearest(qs.Index(text), text, quote, most))[:1] == got[:1]
        found += len(got)
    assert found > 20


def test_slices_and_parts_change_nothing(spark):
    """Quotes with one, two and three errors from all over the texts; slices cut passages and runs; many quotes of a document are several tasks."""
    rng = random.Random(9)
    texts = {1: "".join(rng.choice("abcdefgh ") for _ in range(900)), 2: "ab" * 200, 3: "", 4: None, 5: "The Only Text"}
    quotes = [(1, i, spoil(rng, texts[1][i * 40 : i * 40 + 35], i % 4)) for i in range(22)] + [(2, 0, "abab"), (2, 1, "abXab"), (3, 0, "x"), (4, 0, "x"), (5, 0, "the 0nly text"), (5, 1, ""), (5, 2, None), (6, 0, "no such document")]
    t, q = spark.createDataFrame(list(texts.items()), TEXTS), spark.createDataFrame(quotes, QUOTES)
    want = sorted((d, i, r, *p) for d, i, x in quotes if x and texts.get(d) for r, p in enumerate(brute(x, texts[d], int(len(x) * 0.3))[:3], 1))
    for how in ({}, {"step": 64, "together": 3}):
        got = sorted((r["doc_id"], r["quote_id"], r["rank"], r["distance"], r["end_char"], r["start_char"]) for r in qs.approximate(q, t, 0.3, 3, **how).collect())
        assert got == want and len({g[1] for g in got if g[0] == 1}) == 22
    methods = {(r["doc_id"], r["quote_id"]): r["method"] for r in qs.locate(q, t).collect()}
    assert methods[5, 0] == "fuzzy" and methods[1, 0] == "exact" and methods[6, 0] == methods[5, 1] == "none" and len(methods) == len(quotes)
