"""Chunks of every document of the smallest tables against plain loops."""

import os
import re

import pytest

from docloom.functions import text as tx
from docloom.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
SPACE = " \t\n\r\f\v"


def tokens(t):
    return -(-len(t) // 4)


def paragraphs(t):
    return [p for p in (x.strip(SPACE) for x in re.split(r"\n\s*\n|\n(?=\s{2,})", t, flags=re.A)) if p]


def sentences(t):
    hidden = re.sub(tx._shielded(), "\x01", t)
    return [s for s in (x.replace("\x01", ".").strip(SPACE) for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])", hidden, flags=re.A)) if s]


def last_that_fit(parts, most):
    kept, n = [], 0
    for p in reversed(parts):
        n += tokens(p)
        if n > most:
            break
        kept.insert(0, p)
    return kept


def semantic(t, most, least, overlap):
    """Paragraphs, or sentences of those too long, into chunks; a chunk's text is joined as the unit that closes it is."""
    done, parts, n = [], [], 0

    def close(sep):
        nonlocal parts, n
        made = sep.join(parts)
        done.append((made, n))
        parts = [" ".join(last_that_fit(sentences(made), overlap))]
        parts = parts if parts[0] else []
        n = tokens(parts[0]) if parts else 0

    for p in paragraphs(t):
        long = tokens(p) > most
        if n + tokens(p) > most and parts:
            close("\n\n")
        for unit in sentences(p) if long else [p]:
            if long and n + tokens(unit) > most and parts:
                close(" ")
            parts.append(unit)
            n += tokens(unit)
    if parts and n >= least:
        done.append(("\n\n".join(parts), n))
    return done


def by_pages(pages, most, least, overlap):
    done, items = [], []
    size = lambda: sum(tokens(t) for t, _ in items)
    made = lambda: ("\n\n".join(t for t, _ in items), min(p for _, p in items), max(p for _, p in items))
    for page, text in pages:
        for p in paragraphs(text):
            if items and size() + tokens(p) > most:
                done.append(made())
                kept = len(last_that_fit([t for t, _ in items], overlap)) if overlap else 0
                items = items[len(items) - kept :] if kept else []
            items.append((p, page))
    if items and size() >= least:
        done.append(made())
    return done


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"] is not None}


def rows(df, *columns):
    out = {}
    for r in df.orderBy("doc_id", "chunk_idx").collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns))
    return out


def test_semantic_chunks(spark, texts):
    want = {d: c for d, t in texts.items() if (c := semantic(t.replace("\n", "\n\n"), 300, 100, 50))}
    assert rows(queries.f6_semantic_chunks(spark, SF), "text", "tokens") == want and max(map(len, want.values())) > 5


@pytest.mark.parametrize("name,overlap", [("f7_page_chunks", 0), ("w2_page_chunks_overlap", 60)])
def test_page_chunks(spark, texts, name, overlap):
    pages = {}
    for d, t in texts.items():
        lines = t.split("\n")
        pages[d] = [(i // 5 + 1, "\n\n".join(lines[i : i + 5])) for i in range(0, len(lines), 5)]
    least = 100
    want = {d: c for d, p in pages.items() if (c := by_pages(p, 400, least, overlap))}
    got = rows(queries.QUERIES[name](spark, SF), "text", "page_start", "page_end")
    if name == "f7_page_chunks":
        want = {d: c for d, p in pages.items() if (c := by_pages(p, 400, 100, 0))}
    assert got == want and max(map(len, want.values())) > 5
