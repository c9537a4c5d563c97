"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs the labelers, and a span classifier is trained on what they say.

Two passes over the texts. The first counts patterns of votes and features, of which there is a fixed number per kind whatever the corpus; the model is
fitted to those counts. The second finds the spans again and classifies them, so that no spans are stored or joined in between.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, release, shared_dir

KINDS = ("email", "ip", "card", "phone", "secret")
#: Fixed: the base patterns. The lookbehind, the possessive parts and the search from the at sign give the same matches as the plain patterns, in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Further candidates, looser than the base.
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]++)++", re.I)
_AT = re.compile(r"[\[(] ?at", re.I)
_NUMBER = re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9][0-9 ().-]{6,22}[0-9](?![0-9A-Za-z])")
_KEYED = re.compile(r"(?:token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key)[\x20\"']{0,2}[:=][\x20]{0,2}[\"']?([A-Za-z0-9_/+=-]{8,}+(?:\.[A-Za-z0-9_/+=-]++)*+)", re.I)
_KEY_HINT = re.compile(r"token|secret|passw|pwd|key", re.I)

#: Gazetteers and context words.
_TLD = frozenset("com org net edu gov int io co uk de fr es it nl be ch at pl pt se no dk fi eu us ca au nz jp cn in br mx ru info biz dev app".split())
_CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel", "schreib"),
    "ip": ("ip", "host", "server", "address", "adresse", "login"),
    "card": ("card", "visa", "master", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("tel", "phone", "call", "fax", "mobil", "ruf", "appel", "llama", "whatsapp"),
    "secret": ("token", "secret", "pass", "pwd", "key"),
}
_AGAINST = ("isbn", "issn", "version", "page", "vol", "section", "license", "$", "€", "£", "#")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in text.split(".")))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the four base kinds, in code points, by start and then by kind as listed."""
    out = []
    if "@" in text:
        out += [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further spans that may be personal data and overlap no base span and no candidate before them.

    Addresses and secrets have any length; numbers, whose longest kind has 19 digits, end after 24 characters. All patterns scan a run once.
    """
    found = []
    if ("[" in text or "(" in text) and _AT.search(text):
        found += [(m.start(), m.end(), "email") for m in _SPELT.finditer(text)]
    if _KEY_HINT.search(text):
        found += [(m.start(1), m.end(1), "secret") for m in _KEYED.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = len(_DIGIT.findall(m[0]))
            found.append((m.start(), m.end(), "card" if 14 <= n <= 19 else "phone"))
    out, end, k = [], 0, 0
    blocked = sorted((a, b) for a, b, _ in base)
    for a, b, kind in sorted(found):
        while k < len(blocked) and blocked[k][1] <= a:
            k += 1
        if a >= end and not (k < len(blocked) and blocked[k][0] < b):
            out.append((a, b, kind))
            end = b
    return out


def pattern(text: str, start: int, end: int, kind: str) -> str:
    """What labelers say of a span, then its features."""
    return votes(text, start, end, kind) + features(text[start:end])


def votes(text: str, start: int, end: int, kind: str) -> str:
    """One letter per labeler: + for personal, - against, 0 no opinion. Labelers: form, check, gazetteer, context for, context against, edges."""
    s = text[start:end]
    digits = "".join(_DIGIT.findall(s)) if kind in ("card", "phone") else ""
    before = text[max(0, start - 32) : start].lower()
    if kind == "email":
        form = "+" if _DOMAIN.search(s) or _AT.search(s) else "0"
        check = "0" if len(s) <= 254 else "-"
        gaz = "+" if re.split(r"[^A-Za-z]+", s.rstrip())[-1].lower() in _TLD else "-"
    elif kind == "ip":
        form, check = "+", "+" if _octets(s) else "-"
        gaz = "-" if s.startswith(("0.", "255.")) else "0"
    elif kind == "card":
        form = "+" if re.fullmatch(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}", s) else "-"
        check = "+" if luhn(digits) else "-"
        gaz = "+" if digits[:1] in "3456" else "-"
    elif kind == "phone":
        form = "+" if s.startswith("+") or re.fullmatch(r"\(?[0-9]{2,5}\)?[ .-][0-9]{2,4}[ .-][0-9]{2,6}(?:[ .-][0-9]{2,4})?", s) else "-"
        check = "0" if 7 <= len(digits) <= 15 else "-"
        gaz = "+" if s.startswith(("+", "(0", "0")) else "-" if re.match(r"(?:19|20)[0-9]{2}[.-]", s) else "0"
    else:
        form = "+" if re.search(r"[0-9]", s) and re.search(r"[A-Za-z]", s) else "-"
        check = "+" if len(set(s)) * 3 > min(len(s), 30) else "-"
        gaz = "+" if len(s) in (32, 40, 64) or s.startswith(("AKIA", "ghp_", "sk-", "xox")) else "0"
    for_ = "+" if any(w in before for w in _CONTEXT[kind]) else "0"
    against = "-" if any(w in before[-16:] for w in _AGAINST) else "0"
    edges = "-" if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum() else "0"
    return form + check + gaz + for_ + against + edges


#: Classes of each of a span's own features: length, share of digits, kinds of separators.
FEATURES = (5, 4, 3)
_SEPARATORS = re.compile(r"[^A-Za-z0-9]")


def features(span: str) -> str:
    """One digit per feature, its class."""
    n, digits = len(span), len(_DIGIT.findall(span))
    length = sum(n >= k for k in (8, 16, 32, 64))
    share = 0 if not digits else 1 if 2 * digits < n else 2 if digits < n else 3
    return f"{length}{share}{min(2, len(set(_SEPARATORS.findall(span))))}"


#: How often each labeler is thought to be right when it speaks, before any text is seen: form, check, gazetteer, context for, context against, edges.
BELIEF = (0.6, 0.9, 0.6, 0.8, 0.9, 0.85)


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier, per kind: a bias, one weight for each labeler's + and -, one for each class of each feature.

    right and share say what expectation-maximisation found: each labeler's reliability, and the share of candidates that are personal.
    """

    weights: dict[str, list[float]]
    right: dict[str, list[float]] = field(default_factory=dict)
    share: dict[str, float] = field(default_factory=dict)

    def chance(self, kind: str, pattern: str) -> float:
        w = self.weights.get(kind)
        if w is None:
            return 0.0
        x = float(np.dot(w, _inputs(pattern)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _inputs(pattern: str) -> list[float]:
    """What the classifier sees of a pattern, that is of votes and, if they follow, features."""
    out = [1.0]
    for v in pattern[: len(BELIEF)]:
        out += [float(v == "+"), float(v == "-")]
    said = pattern[len(BELIEF) :]
    for i, n in enumerate(FEATURES):
        out += [float(said != "" and int(said[i]) == k) for k in range(n)]
    return out


def fit(counts: list[tuple], rounds: int = 50, weight: float = 100.0, share: float = 0.35) -> Model:
    """Expectation-maximisation over the votes of (kind, pattern, count, whether base; False if left out), then logistic regression on its posteriors.

    Each labeler has, per kind, a chance of being right when it speaks, and each kind a share of personal ones among the candidates. Base spans are personal by
    definition, so they count with certainty and anchor the labelers. Beliefs, BELIEF and `share`, count as much as `weight` spans; agreement alone
    couldn't tell labelers that are all right from labelers that are all wrong. So little data leaves them as they are and much data moves them anywhere from 0.51 to 0.99.
    The regression sees each pattern once, weighted by the logarithm of its count, with a ridge; it starts at 0, so
    it doesn't depend on the order of counts. Kinds without candidates get no weights.
    """
    weights, found, shares = {}, {}, {}
    for kind in sorted({c[0] for c in counts}):
        rows = sorted((c[1], c[2], len(c) > 3 and bool(c[3])) for c in counts if c[0] == kind)
        v = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in p[: len(BELIEF)]] for p, _, _ in rows], dtype=float)
        n = np.array([c for _, c, _ in rows], dtype=float)
        sure = np.array([b for _, _, b in rows])
        open_ = np.where(sure, 0.0, n)
        belief = np.array(BELIEF)
        right, prior = belief.copy(), share
        for _ in range(rounds):
            odds = math.log(prior / (1 - prior)) + (v * np.log(right / (1 - right))).sum(axis=1)
            post = np.where(sure, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            agree = (n[:, None] * np.where(v > 0, post[:, None], np.where(v < 0, 1 - post[:, None], 0))).sum(axis=0)
            said = (n[:, None] * (v != 0)).sum(axis=0)
            right = np.clip((agree + belief * weight) / (said + weight), 0.51, 0.99)
            prior = min(0.99, max(0.01, float((open_ @ post + share * weight) / (open_.sum() + weight))))
        x, c = np.array([_inputs(p) for p, _, _ in rows]), np.log1p(n)
        w = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (c * (post - p)) - 0.1 * w)
            w += step
        weights[kind], found[kind], shares[kind] = w.tolist(), right.tolist(), prior
    return Model(weights, found, shares)


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """First pass: counts of vote patterns over all whole texts (combined before the shuffle), then fit(). Counts of at most 5 * 3^6 patterns of votes with 60 of features reach the driver, whatever the corpus; some hundreds in practice."""
    shared_dir(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str, bool], int] = {}
        for batch in batches:
            for cell in batch.column(0):
                if text := cell.as_py():
                    base = base_spans(text)
                    for sure, found in ((True, base), (False, candidates(text, base))):
                        for a, b, kind in found:
                            key = kind, pattern(text, a, b, kind), sure
                            seen[key] = seen.get(key, 0) + 1
        kinds, patterns, sures = zip(*seen) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(patterns, pa.string()), pa.array(sures, pa.bool_()), pa.array(list(seen.values()), pa.int64())], names=["kind", "pattern", "sure", "n"])
        release()

    made = docs.select(text_col).mapInArrow(run, "kind string, pattern string, sure boolean, n long")
    return fit([(r["kind"], r["pattern"], r["n"], r["sure"]) for r in made.groupBy("kind", "pattern", "sure").agg(F.sum("n").alias("n")).collect()])


def spans(text: str | None, model: Model) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: base and the candidates that the model takes for personal."""
    if not text:
        return [], []
    base = base_spans(text)
    more = [s for s in candidates(text, base) if model.chance(s[2], pattern(text, *s)) >= 0.5]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, all): arrays of struct<kind, start, end>, for every row. Null and empty texts have none."""
    prepare(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    listed = lambda s: [{"kind": k, "start": a, "end": b} for a, b, k in s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [spans(x.as_py(), model) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([listed(b) for b, _ in both], kind), pa.array([listed(a) for _, a in both], kind)], names=["doc_id", "base", "all"])

    arr = "array<struct<kind: string, start: int, end: int>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, f"doc_id long, base {arr}, all {arr}")


def mask(text: str, found: list[tuple[int, int, str]]) -> str:
    """text with each span replaced by its kind in angle brackets; spans that overlap are replaced as one, by the first one's kind."""
    out, end = [], 0
    for a, b, kind in found:
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, model: Model, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with spans masked in text_col; every row and column stays. length_col, if given, becomes the new text's length."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(at)]
            new = [mask(t, s) if t and (s := spans(t, model)[1]) else t for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        release()

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col else out
