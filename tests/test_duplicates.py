import random

from docloom.operators import duplicates as du


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_similar_names_against_all_pairs(spark):
    """Planted misspellings among names that share most of their grams; none is lost."""
    rng = random.Random(2)
    names = {"".join(rng.choice("abé ") for _ in range(rng.randrange(0, 26))) for _ in range(120)}
    for n in list(names)[:40]:
        m = list(n)
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(m) + 1)
            m[i : i + rng.randrange(2)] = rng.choice(["", "q", "ab"])
        names.add("".join(m))
    want = {(a, b, distance(a, b)) for a in names for b in names if a == b or distance(a, b) <= min(len(a), len(b)) // du.PER_EDIT}
    df = spark.createDataFrame([(n,) for n in names] + [(None,), ("",), ("",)], "name string")
    got = [tuple(r) for r in du.similar_names(df).collect()]
    assert set(got) - {("", "", 0)} == want - {("", "", 0)} and len(got) == len(set(got))
    assert sum(a != b for a, b, _ in want) > 40


def test_odd_studies_and_a_hot_centre(spark):
    rows = [(i, f"Author{i:03d} of house {chr(97 + i % 26) * 8}", "One Centre", 2000, 2005) for i in range(200)]
    rows += [(1000, "author007 OF house hhhhhhhh!", "one centre.", 2004, 2009), (1001, None, "One Centre", 2000, 2001), (1002, "", "One Centre", 2000, 2001), (1003, "x", "y", None, 2001), (1004, "x", "y", 2003, 2001), (1005, "x", "y", 2001, 2001), (1006, "X", "y", 2001, 2001)]
    df = spark.createDataFrame(rows, "study_id long, author string, centre string, year_from int, year_to int")
    pairs = {(r["a"], r["b"]): r for r in du.duplicate_studies(df).collect()}
    assert (pairs[7, 1000]["author_distance"], pairs[7, 1000]["shared_years"], pairs[7, 1000]["confidence"]) == (0, 2, "Medium")
    assert pairs[1005, 1006]["confidence"] == "High" and not any({1001, 1002, 1003, 1004} & {*p} for p in pairs)
    said = {r["study_id"]: r for r in du.assessment(df, du.duplicate_studies(df)).collect()}
    assert said[1000]["duplicate_of"] == 7 and said[1006]["duplicate_of"] == 1005 and not said[1001]["is_duplicate"] and len(said) == len(rows)
    assert du.duplicate_studies(df.limit(0)).count() == 0


def test_names_with_common_parts_meet_few(spark):
    """Names that share title, length and letters; as pairs of characters are all frequent, 350,000 of the 4.6 million pairs once went on to have their distance taken."""
    rng = random.Random(5)
    names = ["dr " + "".join(rng.choice("abcdefghijklmnop") for _ in range(10)) for _ in range(3000)]
    names += [n[:6] + n[7:] for n in names[:50]] + ["dr", "dr a", "dr ab", "dr xab", "abcde", "abcd", "bcde", "abcdef", "xbcde"]
    df = du.similar_names(spark.createDataFrame([(n,) for n in names], "name string")).where("x < y")
    got = {tuple(r) for r in df.collect()}
    assert {tuple(sorted((n, n[:6] + n[7:]))) for n in names[:50]} <= {(x, y) for x, y, _ in got}
    assert {("abcde", "abcdef", 1), ("abcde", "xbcde", 1), ("dr ab", "dr xab", 1)} <= got and not any("abcd" in (x, y) or "dr a" in (x, y) for x, y, _ in got)


def test_an_author_of_one_study_meets_no_centres(spark):
    """Studies whose author neither returns nor is misspelt are left before they are dealt to the names near their centre's; the figures stay."""
    rows = [(i, f"author {i * 7919 % 100000:05d} {i:04d}", f"centre of medicine {'abcdefghij'[i % 10]}", 2000, 2005) for i in range(300)]
    rows += [(1000, rows[5][1], "centre of medicine q", 2001, 2005), (1001, rows[7][1] + "x", "centre of medicine a", 2000, 2005)]
    df = du.duplicate_studies(spark.createDataFrame(rows, "study_id long, author string, centre string, year_from int, year_to int"))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and distance(a[1], b[1]) <= min(len(a[1]), len(b[1])) // du.PER_EDIT and distance(a[2], b[2]) <= 3}
    assert {(r["a"], r["b"]) for r in df.collect()} == want and {(5, 1000), (7, 1001)} <= want
    assert "LeftAnti" in df._jdf.queryExecution().optimizedPlan().toString()
