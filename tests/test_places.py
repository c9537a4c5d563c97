"""Places in texts and on pages against plain loops."""

import random

from pyspark.sql import functions as F

from docloom.operators import spans
from docloom.sources import files


def test_offsets_over_pages(spark):
    rng = random.Random(3)
    rows, texts = [], {}
    for doc in range(6):
        text, pages = "", rng.randrange(1, 6)
        for page in range(1, pages + 1):
            for pos in range(rng.randrange(0, 5) if page != 2 else 0):
                t = rng.choice(["", "a", "two words", "é😀", None])
                rows.append((doc, page, pos, t, len(text) if t else None))
                text += f"{t} " if t else ""
            text += "\n\n"
        texts[doc] = (pages, text)
    items = spark.createDataFrame(rows, "doc_id int, page int, pos int, text string, want long")
    got = spans.item_offsets(items.repartition(4))
    assert got.count() == sum(r[4] is not None for r in rows) and got.where("start_char <> want OR end_char - start_char <> length(text)").count() == 0
    pages = spark.createDataFrame([(d, p) for d, (p, _) in texts.items()], "doc_id int, n_pages int")
    assert {r[0]: r[1] for r in spans.whole_text(items, pages).collect()} == {d: t for d, (_, t) in texts.items()}


def test_rectangles_and_starts_by_cells(spark):
    rng = random.Random(4)
    words = [(d, p, i, rng.randrange(0, 500), rng.randrange(0, 500), rng.randrange(0, 200), rng.randrange(0, 40)) for d in range(2) for p in (1, 2) for i in range(60)]
    rects = [(d, r, p, x, y, x + w, y + h) for d in range(2) for p in (1, 2) for r in range(8) for x, y, w, h in [(rng.randrange(-50, 500), rng.randrange(-50, 500), rng.randrange(0, 300), rng.randrange(-5, 300))]]
    s = spark.createDataFrame(words, "doc_id int, page int, pos int, x int, y int, width int, height int")
    r = spark.createDataFrame(rects, "doc_id int, rect_id int, page int, x0 int, y0 int, x1 int, y1 int")
    want = sorted((d, rid, i) for d, p, i, x, y, w, h in words for e, rid, q, x0, y0, x1, y1 in rects if (d, p) == (e, q) and x < x1 and x + w > x0 and y < y1 and y + h > y0)
    got = spans.in_rectangle(s, r)
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 50
    assert "doc_id" in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("\n")[0]
    lines, cites = [], []
    for d in range(3):
        at = 0
        for i in range(80):
            n = rng.randrange(0, 700)
            lines.append((d, i, at, at + n, i // 10 + 1, i, 2 * i))
            at += n + rng.randrange(0, 3)
        cites += [(d, c, rng.randrange(0, at + 900), 0) for c in range(40)]
    ls = spark.createDataFrame(lines, "doc_id int, pos int, start_char long, end_char long, page int, x int, y int")
    cs = spark.createDataFrame(cites, "doc_id int, cite_id int, c_start long, c_end long")
    first = {(d, c): next(((p, x, y) for e, _, a, b, p, x, y in lines if e == d and a <= at <= b), (1, 0, 0)) for d, c, at, _ in cites}
    assert {(r["doc_id"], r["cite_id"]): (r["page"], r["x"], r["y"]) for r in spans.first_at(cs, ls).collect()} == first


def test_layout_without_words_or_xml(spark):
    xml = ["<doc><page><block><line><word xMin='1' yMin='2' xMax='3' yMax='4'>a</word></line></block></page></doc>", "<doc><page></page></doc>", "not xml", None, "<doc><page><block></block><block><line><word>b</word><word></word><word>c</word></line></block></page></doc>"]
    df = spark.createDataFrame(list(enumerate(xml)), "doc_id int, xml string")
    rows = sorted((r["doc_id"], r["block"], r["line"], r["word"], r["pos"], r["text"], r["x1"]) for r in files.layout_blocks(df).collect())
    assert rows == [(0, 1, 1, 1, 0, "a", 3.0), (4, 2, 1, 1, 0, "b", None), (4, 2, 1, 2, 1, "c", None)]
    assert files.layout_blocks(df.where(F.lit(False))).count() == 0
