"""Personal data by weak supervision.

Base spans (e-mail, IP address, card, phone) are exact patterns and always stay.  Further candidates - long
numbers, quoted credentials, disguised addresses, titled names - are voted on by regex, gazetteer and context
labelers.  Vote patterns of all candidates are counted on Spark; expectation-maximisation over those counts
(a table bounded by 3**labelers rows) estimates each labeler's reliability, the resulting posteriors train a
logistic span classifier, and the classifier decides which candidates become spans.

The classifier is fitted on at most ``FIT_ROWS`` candidates, those with the smallest hash of their feature
pattern and place; votes and reliabilities cover every candidate.

Defined cases: null and empty texts have no spans; repeated rows are each scanned; an empty table gives an
empty table; extra columns are ignored by ``find`` and kept by ``masked``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
MORE = ("account", "secret", "contact", "name")
ORDER = {k: i for i, k in enumerate(KINDS + MORE)}
FIT_ROWS = 20_000

# The four base patterns of the contract.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Candidates beyond the base patterns.
_NUMBER = re.compile(r"(?<![0-9A-Za-z.])[0-9](?:[ .()/-]?[0-9]){7,}(?![0-9A-Za-z])")
_QUOTED = re.compile(r"([A-Za-z_][A-Za-z_-]{1,30})\s{0,3}[=:]\s{0,3}[\"']([^\"'\s]{8,200})[\"']")
_DISGUISED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[(](?:at|AT)[\])]\s?[A-Za-z0-9-]{1,64}(?:\s?(?:\.|[\[(](?:dot|DOT)[\])])\s?[A-Za-z0-9-]{2,63})+")
_TITLED = re.compile(r"\b(?:Mrs?|Ms|Dr|Herr|Frau|Mme|Mlle|Sr|Sra|Señora?)\.? ([A-Z][a-zà-ÿ]{1,30}(?: [A-Z][a-zà-ÿ]{1,30})?)")

# Cue words near personal data, and words that make a number harmless.
CUES = frozenset(
    """phone tel telephone mobile call fax account iban card visa mastercard passport ssn customer contact email mail
    konto karte telefon handy kunde ausweis compte carte téléphone client cuenta tarjeta teléfono móvil cliente
    token secret password passwd api_key apikey key pwd credential auth""".split()
)
HARMLESS = frozenset("isbn doi page pages version vol no nr section chapter table fig figure eur usd price total patent".split())
SECRET_NAMES = frozenset("token secret password passwd api_key apikey key pwd credential auth access_key private_key secret_key".split())
FIRST_NAMES = frozenset("anna maria john james mary peter paul hans klaus jean pierre marie josé juan carmen luis ana".split())

LABELERS = ("regex_long", "regex_hex", "gazetteer_cue", "gazetteer_harmless", "gazetteer_name", "context_alone", "context_quoted", "context_repeats")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "@" in text:
        out += [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    out.sort(key=lambda s: (s[1], ORDER[s[0]]))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans worth a vote: none overlaps a base span or an earlier candidate."""
    found = []
    if _DIGIT.search(text):
        found += [("account", *m.span()) for m in _NUMBER.finditer(text)]
    if '"' in text or "'" in text:
        found += [("secret", *m.span(2)) for m in _QUOTED.finditer(text)]
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        found += [("contact", *m.span()) for m in _DISGUISED.finditer(text)]
    found += [("name", *m.span(1)) for m in _TITLED.finditer(text)]
    found.sort(key=lambda s: (s[1], ORDER[s[0]]))
    out, free, b = [], 0, 0
    for kind, start, end in found:
        while b < len(base) and base[b][2] <= start:
            b += 1
        if start >= free and not (b < len(base) and base[b][1] < end):
            out.append((kind, start, end))
            free = end
    return out


def votes(text: str, kind: str, start: int, end: int) -> tuple[list[int], list[float]]:
    """Each labeler's vote (1, 0 abstains, -1), and the features of the classifier."""
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    hexes = sum(c in "0123456789abcdefABCDEF" for c in span)
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    near = {w.strip(".,:;=\"'()").lower() for w in (before + " " + after).split()}
    quoted = before[-1:] in ("'", '"') and after[:1] in ("'", '"')
    name = re.findall(r"[A-Za-z_-]+", before)
    keyed = bool(name) and name[-1].lower().replace("-", "_") in SECRET_NAMES
    words = span.split()
    v = [
        (1 if 13 <= digits <= 19 else -1 if digits < 9 else 0) if kind == "account" else 0,
        (1 if hexes >= 0.9 * len(span) and len(span) >= 24 else 0) if kind == "secret" else 0,
        1 if keyed or near & CUES else 0,
        -1 if near & HARMLESS else 0,
        (1 if words and words[0].lower() in FIRST_NAMES else 0) if kind == "name" else 0,
        (1 if before[-1:] in ("", " ", "\n") and (after[:1] in ("", " ", "\n")) and digits >= 13 else 0) if kind == "account" else 0,
        (1 if quoted and keyed else -1 if quoted and "/" in span else 0) if kind == "secret" else 0,
        -1 if len(set(span)) <= 3 else 0,
    ]
    features = [
        1.0,
        float(kind == "account"),
        float(kind == "secret"),
        float(kind == "contact"),
        float(kind == "name"),
        digits / max(1, len(span)),
        hexes / max(1, len(span)),
        min(len(span), 64) / 64.0,
        float(13 <= digits <= 19),
        float(keyed),
        float(bool(near & CUES)),
        float(bool(near & HARMLESS)),
        len(set(span)) / max(1, len(span)),
    ]
    return v, features


_SCAN = "base array<struct<kind:string,s:bigint,e:bigint>>, more array<struct<kind:string,s:bigint,e:bigint,v:array<int>,x:array<double>>>"


def _scan(batches):
    import pyarrow as pa

    base_t = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64())]))
    more_t = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("v", pa.list_(pa.int32())), ("x", pa.list_(pa.float64()))]))
    for batch in batches:
        bases, mores = [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            bases.append([{"kind": k, "s": s, "e": e} for k, s, e in base])
            row = []
            for k, s, e in candidates(text, base):
                v, x = votes(text, k, s, e)
                row.append({"kind": k, "s": s, "e": e, "v": v, "x": x})
            mores.append(row)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, base_t), pa.array(mores, more_t)], names=["doc_id", "base", "more"])


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base spans, voted candidates) of every row."""
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(_scan, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {_SCAN}")


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """EM over counted vote patterns: the posterior that a candidate with such votes is personal data.

    Each labeler has a rate of voting 1, 0, -1 under either truth.  The start believes votes, so that the
    classes keep their meaning; a candidate that no labeler speaks for stays doubtful.
    """
    if not patterns:
        return {}
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    post = np.clip(0.35 + 0.3 * v.sum(1), 0.03, 0.97)
    for _ in range(rounds):
        logs = np.zeros((len(n), 2))
        for truth, weight in ((1, n * post), (0, n * (1 - post))):
            prior = (weight.sum() + 1) / (n.sum() + 2)
            logs[:, truth] = np.log(prior)
            for j in range(v.shape[1]):
                for vote in (-1, 0, 1):
                    believed = 4.0 if vote == (1 if truth else -1) else 2.0 if vote == 0 else 0.5
                    rate = (weight[v[:, j] == vote].sum() + believed) / (weight.sum() + 6.5)
                    logs[v[:, j] == vote, truth] += np.log(rate)
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    against = v.sum(1) <= 0
    return {tuple(map(int, p)): float(min(q, 0.4) if a else q) for p, q, a in zip(v, post, against, strict=True)}


def fitted(rows: list[tuple[list[float], float]], rounds: int = 25) -> list[float]:
    """Logistic regression by ridge-damped Newton steps on soft labels."""
    if not rows:
        return []
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w.tolist()


def learned(scan: DataFrame) -> list[float]:
    """Weights of the span classifier, learned from all votes."""
    each = scan.select(F.explode("more").alias("m")).select("m.*")
    counts = [(tuple(r["v"]), r["n"]) for r in each.groupBy("v").agg(F.count("*").alias("n")).collect()]
    truth = reliabilities(sorted(counts))
    rows = each.select("v", "x", F.xxhash64("kind", "s", "e", "x").alias("h")).orderBy("h", "x", "v").limit(FIT_ROWS).collect()
    return fitted([(r["x"], truth[tuple(r["v"])]) for r in rows])


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _decided(weights: list[float], row_base, row_more) -> tuple[list, list]:
    base = [(b["kind"], b["s"], b["e"]) for b in row_base]
    more = [(m["kind"], m["s"], m["e"]) for m in row_more if weights and float(np.dot(m["x"], weights)) > 0]
    return base, sorted(base + more, key=lambda s: (s[1], ORDER[s[0]]))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: counts and digest of the base spans, and all spans."""
    scan = written(scanned(docs, key, text), "pii")
    weights = learned(scan)

    def decide(batches):
        import pyarrow as pa

        for batch in batches:
            ids, out = batch.column(0), []
            for b, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                base, spans = _decided(weights, b, m)
                kinds = [k for k, _, _ in base]
                out.append([*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)])
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = scan.schema["doc_id"].dataType.simpleString()
    return scan.mapInArrow(decide, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str | None, weights: list[float]) -> str | None:
    if not text:
        return text
    base = base_spans(text)
    spans = list(base)
    for k, s, e in candidates(text, base):
        if weights and float(np.dot(votes(text, k, s, e)[1], weights)) > 0:
            spans.append((k, s, e))
    spans.sort(key=lambda s: (s[1], -s[2]))
    out, free = [], 0
    for kind, start, end in spans:
        if start >= free:
            out += [text[free:start], f"[{kind.upper()}]"]
        free = max(free, end)
    out.append(text[free:])
    return "".join(out)


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in brackets; all other columns unchanged."""
    weights = learned(written(scanned(docs.withColumn("__hl_one", F.lit(1)), "__hl_one", text).where(F.size("more") > 0), "pii-votes"))
    at, schema = docs.columns.index(text), docs.schema

    def cover(batches):
        import pyarrow as pa

        for batch in batches:
            column = pa.array([mask(t.as_py(), weights) for t in batch.column(at)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([column if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return docs.mapInArrow(cover, schema)
