"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, and a classifier learns from that.

Base spans are matches of four patterns (email, ip, card, phone) and always stay. Candidates are the base spans and wider matches: addresses
written out in words, numbers in groups without a plus sign, eight hexadecimal groups, card numbers that fail their check digit, names
after a form of address. Each labeler (regex, gazetteer or context) votes for, against, or not at all. Spark counts the patterns of votes
of all candidates; expectation-maximisation over these counts (at most kinds x 3^labelers of them, whatever the size of the corpus)
estimates each labeler's reliability and a probability for each pattern. A logistic span classifier is fitted to these probabilities on at
most FITTED candidates, drawn by hash, from features of the span and its surroundings; it sees no votes, and judges the candidates
that are not base spans. Those over THRESHOLD that overlap no base span are added.

Texts are read once: what is found in a document is written as one row, and the classifier reads that table.

Nulls and edges: null and empty texts have no spans (empty strings, the digest of the empty string). An empty table gives no rows. Without
candidates, or with candidates of one opinion only, nothing is added. Repeated rows and null ids get a row each, with the same spans.
Very long texts are read whole; every pattern takes time linear in the text. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import map_rows, saved

KINDS = ("email", "ip", "card", "phone", "name")
EMAIL, IP, CARD, PHONE, NAME = range(5)
#: Candidates that the classifier is fitted on, at most, and the probability from which a candidate is added.
FITTED, THRESHOLD, ROUNDS = 20_000, 0.5, 50

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if place % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ with a domain, back over the local part: a search from the left would try every character of a long word."""
    done = 0
    for m in _DOMAIN.finditer(text):
        at, width = m.start(), 64
        while True:
            low = max(done, at - width)
            start = low + len(text[low:at].rstrip(_LOCAL))
            if start > low or low == done:
                break
            width *= 8
        if start < at:
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in their order."""
    out = []
    if "@" in text:
        out += [(a, EMAIL, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p or 0) < 256 for p in (part.lstrip("0") for part in m.group().split("."))):
            out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            out.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), PHONE, m.end()))
    return sorted(out)


# ---- candidates beyond the base spans

_WRITTEN = re.compile(r"\b[A-Za-z0-9._%+-]{1,64}\s?[(\[]?(?:\bat\b|@)[)\]]?\s?[A-Za-z0-9-]{1,63}(?:\s?(?:[(\[]?\bdot\b[)\]]?)\s?[A-Za-z0-9-]{2,63}){1,4}")
_GROUPS = re.compile(r"(?<![0-9.+])\(?[0-9]{2,4}\)?(?:[\x20./-][0-9]{2,4}){1,4}(?![0-9])")
_HEXES = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
_TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\b\.?\s[A-ZÀ-Þ][a-zà-ÿ]{1,30}(?:\s[A-ZÀ-Þ][a-zà-ÿ]{1,30})?")


def wider(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that overlap neither a base span nor one another (the first by start, then the longest, stays)."""
    found = []
    if " dot " in text or "dot]" in text or "dot)" in text:
        found += [(m.start(), EMAIL, m.end()) for m in _WRITTEN.finditer(text)]
    if ":" in text:
        found += [(m.start(), IP, m.end()) for m in _HEXES.finditer(text)]
    for m in _GROUPS.finditer(text):
        if 7 <= len(_NOT_DIGIT.sub("", m.group())) <= 12:
            found.append((m.start(), PHONE, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(_NOT_DIGIT.sub("", m.group())) <= 19:
            found.append((m.start(), CARD, m.end()))
    found += [(m.start(), NAME, m.end()) for m in _TITLED.finditer(text)]
    out, ends, starts = [], 0, [s for s, _, _ in base]
    reach = np.maximum.accumulate([e for _, _, e in base]).tolist() if base else []
    for span in sorted(found, key=lambda s: (s[0], -s[2], s[1])):
        before = bisect.bisect_left(starts, span[2])  # base spans that start before its end
        if span[0] >= ends and not (before and reach[before - 1] > span[0]):
            out.append(span)
            ends = span[2]
    return out


# ---- labelers: gazetteers are fixed lists; every vote is +1, -1 or 0 (none)

NEAR = 32
_TOP = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "ch", "at", "it", "nl", "info", "example", "test", "dev", "co"}
_ABOUT = {
    EMAIL: {"email", "mail", "contact", "write", "correo", "kontakt", "courriel", "e-mail", "address"},
    IP: {"ip", "host", "server", "address", "client", "login", "adresse"},
    CARD: {"card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "credit", "account", "iban"},
    PHONE: {"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono", "cell", "ring", "text"},
    NAME: {"name", "by", "from", "dear", "signed", "sincerely", "author"},
}
_NOT_ABOUT = {"version", "page", "isbn", "issn", "order", "invoice", "seite", "página", "chapter", "section", "fig", "figure", "table", "id", "no", "nr", "doi", "build", "release", "year", "rfc", "ticket"}
_MONEY = set("$€£%¥")
_WORD = re.compile(r"[\w-]+")
LABELERS = 9


def votes(text: str, kind: int, start: int, end: int, base: bool) -> list[int]:
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    before = text[max(0, start - NEAR) : start]
    near = {w.lower() for w in _WORD.findall(before)[-4:]}
    left, right = text[start - 1 : start], text[end : end + 1]
    groups = re.findall("[0-9]+", span)
    numeric = kind in (CARD, PHONE)
    return [
        1 if base else 0,  # the kind's own pattern
        (1 if luhn(digits) else -1) if kind == CARD else (1 if 9 <= len(digits) <= 15 else -1) if kind == PHONE else 0,  # check digit, number of digits
        (1 if span.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].lower() in _TOP else -1) if kind == EMAIL else 0,  # gazetteer of top-level domains
        1 if near & _ABOUT[kind] else 0,  # gazetteer of words that announce the kind
        -1 if near & _NOT_ABOUT else 0,  # gazetteer of words that announce other numbers
        -1 if (left.isalnum() or left == "_" or right.isalnum() or right == "_") else 1,  # stands apart from words
        (1 if 2 <= len(groups) <= 5 and all(2 <= len(g) <= 4 for g in groups) else 0) if numeric else 0,  # written in groups
        -1 if numeric and (len(set(digits)) <= 2 or digits in "01234567890123456789" or digits in "98765432109876543210") else 0,  # made-up digits
        -1 if (left in _MONEY or right in _MONEY) and left + right else 0,  # amounts
    ]


# ---- features of a span and of what stands around it: no votes

FEATURES = 48
_SHAPED = 24


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end]
    n = len(span)
    digits = sum(c.isdigit() for c in span)
    x = [0.0] * FEATURES
    x[0] = 1.0
    x[1 + kind] = 1.0
    x[6], x[7], x[8] = min(n, 64) / 32, digits / n, min(digits, 20) / 10
    for place, c in enumerate(" -.()+@:"):
        x[9 + place] = min(span.count(c), 4) / 2
    left, right = text[start - 1 : start], text[end : end + 1]
    x[17], x[18], x[19], x[20] = float(left.isalnum()), float(right.isalnum()), float(left in _MONEY and left != ""), float(right in _MONEY and right != "")
    x[21] = len(set(span)) / n
    x[22] = float(any(c.isupper() for c in span))
    x[23] = float(luhn(_NOT_DIGIT.sub("", span))) if digits > 1 else 0.0
    for word in _WORD.findall(text[max(0, start - NEAR) : start])[-3:] + _WORD.findall(text[end : end + NEAR])[:2]:
        shape = word.lower() if word.isalpha() else re.sub("[0-9]+", "0", word)
        x[_SHAPED + int.from_bytes(hashlib.blake2b(shape.encode(), digest_size=2).digest()) % (FEATURES - _SHAPED)] += 0.5
    return x


# ---- aggregation and the classifier


def reliabilities(kinds: np.ndarray, votes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of counted patterns of votes (patterns x labelers): the probability that a pattern is personal data; for each labeler, class and
    vote the probability of that vote; and the share of personal data by kind. It starts from the votes' sums."""
    total = votes.sum(axis=1)
    p = 1 / (1 + np.exp(-total.astype(float)))
    said = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # patterns x labelers x vote
    for _ in range(ROUNDS):
        table = np.stack([np.einsum("i,ilv->lv", n * (1 - p), said), np.einsum("i,ilv->lv", n * p, said)], axis=1) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        share = np.array([(np.sum((n * p)[kinds == k]) + 1) / (n[kinds == k].sum() + 2) for k in range(len(KINDS))])
        ratio = np.log(table[:, 1] / table[:, 0])
        odds = np.einsum("ilv,lv->i", said, ratio) + np.log(share / (1 - share))[kinds]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, table, share


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the logistic model whose labels are probabilities, by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - q) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, candidates array<struct<kind:int,start:int,end:int,base:boolean,votes:string,x:array<float>>>"


def joined(spans: list[tuple[int, int, int]]) -> str:
    """(start, kind, end) as kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def found(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each document: its base spans, and all candidates with their votes and features."""

    def make():
        def work(batch):
            out = {c.split()[0]: [] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "candidates")}
            for key, body in zip(batch["doc_id"], batch["text"], strict=True):
                body = body or ""
                base = base_spans(body)
                both = [(*s, True) for s in base] + [(*s, False) for s in wider(body, base)]
                text_of_base = joined(base)
                for name, x in (("doc_id", key), ("base", text_of_base), ("base_sha256", hashlib.sha256(text_of_base.encode()).hexdigest())):
                    out[name].append(x)
                for k in range(4):
                    out[f"n_{KINDS[k]}"].append(sum(s[1] == k for s in base))
                out["candidates"].append([{"kind": k, "start": a, "end": b, "base": sure, "votes": "".join("-0+"[v + 1] for v in votes(body, k, a, b, sure)), "x": features(body, k, a, b)} for a, k, b, sure in both])
            return out

        return work

    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), FOUND, make)


def fitted(rows: DataFrame) -> np.ndarray | None:
    """The classifier's weights, from the rows of found()."""
    each = rows.select("doc_id", F.explode("candidates").alias("c"))
    counts = each.groupBy("c.kind", "c.votes").agg(F.count("*").alias("n")).toArrow()  # bounded: kinds x 3^LABELERS
    if not counts.num_rows:
        return None
    kinds, n, said = counts["kind"].to_numpy(), counts["n"].to_numpy().astype(float), counts["votes"].to_pylist()
    p, _, _ = reliabilities(kinds, np.array([["-0+".index(v) - 1 for v in s] for s in said]), n)
    of = {(int(k), s): float(q) for k, s, q in zip(kinds, said, p, strict=True)}
    # as many of the candidates that are not base spans as of those that are, if there are as many
    order = F.xxhash64("doc_id", "c.start", "c.end", "c.kind")
    draw = lambda some: each.where(some).orderBy(order).limit(FITTED // 2).select("c.kind", "c.votes", "c.x").toArrow()
    x, q = [], []
    for part in (draw(F.col("c.base")), draw(~F.col("c.base"))):
        x += part["x"].to_pylist()
        q += [of[k, s] for k, s in zip(part["kind"].to_pylist(), part["votes"].to_pylist(), strict=True)]
    return logistic(np.array(x), np.array(q))


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    rows = saved(found(docs, text, doc_id), "spans")
    weights = fitted(rows)
    keep = lambda c: c["base"]
    if weights is not None:
        w = F.array(*[F.lit(float(v)) for v in weights])
        line = lambda c: F.aggregate(F.zip_with(c["x"], w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
        keep = lambda c: c["base"] | (line(c) > float(np.log(THRESHOLD / (1 - THRESHOLD))))
    kept = F.filter("candidates", keep)
    name = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))
    spans = F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
    counts = [f"n_{k}" for k in KINDS[:4]]
    return rows.select("doc_id", *counts, "base_sha256", spans.alias("spans"), (F.size(kept) - sum((F.col(c) for c in counts), F.lit(0))).cast("bigint").alias("n_added"))
