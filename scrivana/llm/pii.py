r"""Personal data by weak supervision.

Four base kinds (email, ip, card, phone) are found by fixed rules and always stay. Looser patterns propose
further candidates: identity numbers, accounts, local phone numbers, secrets of any length (also assigned ones and
armoured keys), names after a title or a cue. Labelers vote on each candidate: a regex labeler on its form, a gazetteer
labeler on known words in or before it, a context labeler on the characters around it, a variety labeler on its
characters. Votes are +1, 0 or -1. Expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability and each kind's share of true spans. Its posteriors then train the final span classifier, a logistic
regression on hashed features of the span and the words around it. It sees no vote, so it can overrule the labelers,
and it decides.

Votes have few values, so the statistics of all documents are counts of patterns: the driver gets one row for each
pattern, however many documents there are. The classifier is fitted on at most ``sample`` candidates, those with the
smallest hash of document and place; every candidate is decided by it.

Offsets are code points, end exclusive. Null and empty texts have no spans; repeated rows are each searched; an
empty table gives an empty table; other columns are not read. No pattern backs up over more than it matched, so
very long texts take time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import Scratch, blocks

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "identity", "local_phone", "name", "secret")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A run of digits starts only where no digit stands before: what the plain pattern matches, without retrying inside runs.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: the local part begins where its characters begin, but not before the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done, at = at + 1, text.find("@", at + 1)


def base_spans(text: str, has_digits: bool) -> list[tuple[str, int, int]]:
    """Kind, start and end of the base spans, by start, then kind."""
    found = [("email", *x) for x in emails(text)]
    if has_digits:
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", *m.span()))
    found.sort(key=lambda x: (x[1], BASE.index(x[0])))
    return found


_TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Herr", "Frau", "Señor", "Señora", "Sr", "Sra", "Madame", "Monsieur", "Mme", "Mlle")
_NAME_CUES = ("name", "contact", "dear", "attn", "signed", "regards", "sincerely", "nombre", "nom", "kontakt", "gezeichnet", "firmado", "cordialement")
_SECRET_CUES = ("key", "token", "secret", "password", "passwd", "pwd", "credential", "passwort", "contraseña", "mot de passe")
_PART = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++"
_SPACE_BEFORE = 24


def _after(cues: tuple[str, ...], between: str) -> re.Pattern:
    """Whether a text ends with a cue."""
    return re.compile(r"(?<!\w)(?i:" + "|".join(cues) + rf"){between}\Z")


#: Kind, strings of which a text must hold one (None: digits), pattern, and what must stand before a match, if anything.
#: A group is the span, where there is one. Account numbers of ISO 13616 have 15 to 34 characters.
_CANDIDATES = (
    ("secret", ("-----BEGIN",), re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[^-]++-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----"), None),
    ("identity", None, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), None),
    ("local_phone", None, re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"), None),
    ("account", None, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"), None),
    ("secret", None, re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_/+-])"), None),
    ("secret", ("=", ":"), re.compile(r"[=:] ?[\"']?([^\s\"']{8,}+)"), _after(_SECRET_CUES, " ?")),
    ("name", _TITLES, re.compile(r"(?<!\w)(?:" + "|".join(_TITLES) + r")\.? " + _PART + r"(?:[ -]" + _PART + r")?+(?!\w)"), None),
    ("name", (" ", "\n", "\t"), re.compile(r"\s(?=(" + _PART + "[ -]" + _PART + r")(?!\w))"), _after(_NAME_CUES, "[:,]?")),
)
_CUES = {
    "identity": ("ssn", "social security", "identity", "passport", "id no", "tax", "dni", "nif", "ausweis"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "cell", "handy", "móvil", "portable"),
    "account": ("iban", "account", "konto", "compte", "cuenta", "bank", "swift"),
    "secret": (*_SECRET_CUES, "api", "auth", "bearer"),
    "name": (*_NAME_CUES, "from"),
}
_KNOWN_FORMS = re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_|sk[-_]|xox[abprs]-|AIza|eyJ)")


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in (text.count(x) for x in set(text)))


def iban_holds(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def form_vote(kind: str, s: str) -> int:
    if kind == "identity":
        a, b, c = s.split("-")
        return 1 if a not in ("000", "666") and a < "900" and b != "00" and c != "0000" else -1
    if kind == "local_phone":
        digits = _NOT_DIGIT.sub("", s)
        return 1 if digits[0] >= "2" and digits[3] >= "2" else -1
    if kind == "account":
        return 1 if iban_holds(s) else -1
    if kind == "secret":
        if _KNOWN_FORMS.match(s) or s.startswith("-----BEGIN"):
            return 1
        mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
        return -1 if not mixed else 1 if entropy(s) >= 3.2 else 0
    return 1 if s.count(" ") >= 2 else 0


def cue_vote(kind: str, before: str) -> int:
    low = before.lower()
    return int(any(cue in low for cue in _CUES[kind]))


def context_vote(before: str, after: str) -> int:
    if before[-1:] in "=:\"'" and before or before[-2:] in (": ", "= "):
        return 1
    return -1 if before[-1:].isalnum() or after[:1].isalnum() else 0


def variety_vote(kind: str, s: str) -> int:
    """Of the digits where a kind is written in digits, else of all characters."""
    kinds = len(set(_NOT_DIGIT.sub("", s) if kind in ("identity", "local_phone") else s))
    return -1 if kinds <= 2 else 1 if kinds >= 6 else 0


LABELERS = ("form", "gazetteer", "context", "variety")
#: Hashed features of the span classifier have so many places.
PLACES = 1 << 14
SAMPLE = 20_000
_CLASSES = str.maketrans({**{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "0" for c in "0123456789"}})
_WORDS = re.compile(r"\w+")


def place(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode()) % PLACES


def features(kind: str, s: str, before: str, after: str) -> list[int]:
    """Places of what the span and its surroundings look like: no vote is among them."""
    shape = s.translate(_CLASSES)
    steps = {a + b for a, b in zip(shape, shape[1:])}
    digits, capitals = shape.count("0") / len(s), shape.count("A") / len(s)
    words = _WORDS.findall(before.lower())[-3:]
    found = [kind, f"n {len(s).bit_length()}", f"0 {digits:.1f}", f"A {capitals:.1f}", f"k {len(set(s)).bit_length()}", f"h {entropy(s):.0f}", f"b {before[-1:].translate(_CLASSES)}", f"a {after[:1].translate(_CLASSES)}"]
    found += [f"w {w}" for w in words] + [f"s {x}" for x in sorted(steps)]
    return sorted({place(x) for f in found for x in (f, f"{kind} {f}")})


def candidates(text: str, has_digits: bool, taken: list[tuple[str, int, int]]) -> list[dict]:
    """Candidates that meet no base span nor one another, each with its votes and its features."""
    out: list[dict] = []
    covered = bytearray(len(text))
    for _, a, b in taken:
        covered[a:b] = b"\1" * (b - a)
    for kind, needs, pattern, cue in _CANDIDATES:
        if not (has_digits if needs is None else any(x in text for x in needs)):
            continue
        for m in pattern.finditer(text):
            if cue is not None and not cue.search(text[max(0, m.start() - _SPACE_BEFORE) : m.start()]):
                continue
            group = 1 if pattern.groups else 0
            a, s = m.start(group), m[group] if kind == "name" else m[group].rstrip(".,;:!?)]}")
            b = a + len(s)
            if kind == "secret" and needs is None and not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
                continue
            if covered.find(1, a, b) >= 0:
                continue
            covered[a:b] = b"\1" * (b - a)
            before, after = text[max(0, a - 32) : a], text[b : b + 2]
            votes = (form_vote(kind, s), cue_vote(kind, before), context_vote(before, after), variety_vote(kind, s))
            out.append({"kind": kind, "start": a, "end": b, "votes": "".join("-0+"[v + 1] for v in votes), "features": features(kind, s, before, after)})
    return out


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, candidates array<struct<kind:string,start:int,end:int,votes:string,features:array<int>>>"
_CANDIDATE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))


def find(docs: DataFrame) -> DataFrame:
    """Base spans and voted candidates of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "text", 2 << 20):
            base, more, counts = [], [], []
            for text in table.column("text").to_pylist():
                text = text or ""
                has_digits = _DIGIT.search(text) is not None
                spans = base_spans(text, has_digits)
                base.append(spans_text(spans))
                counts.append([sum(k == kind for k, _, _ in spans) for kind in BASE])
                more.append(candidates(text, has_digits, spans))
            columns = [table.column("doc_id").combine_chunks(), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE))), pa.array(base, pa.string()), pa.array(more, _CANDIDATE)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in BASE), "base", "candidates"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


class LabelModel:
    """Naive-Bayes mixture of true and false candidates, fitted to counts of (kind, votes) by EM."""

    def __init__(self, patterns: list[tuple[str, str]], counts: np.ndarray, rounds: int = 50):
        self.kinds = sorted({k for k, _ in patterns})
        kind = np.array([self.kinds.index(k) for k, _ in patterns], dtype=int)
        votes = np.array([["-0+".index(c) for c in v] for _, v in patterns], dtype=int).reshape(len(patterns), len(LABELERS))
        # the start: what most votes say
        p = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
        # a labeler is taken to be right more often than not before any count is seen
        prior = np.array([[2.0, 2.0, 1.0], [1.0, 2.0, 2.0]])
        for _ in range(rounds if len(patterns) else 0):
            both = np.stack([1 - p, p]) * counts
            share = np.array([(both[1][kind == k].sum() + 1) / (counts[kind == k].sum() + 2) for k in range(len(self.kinds))])
            table = np.array([[[both[y][votes[:, j] == v].sum() + prior[y][v] for v in range(3)] for j in range(votes.shape[1])] for y in range(2)])
            table /= table.sum(axis=2, keepdims=True)
            log = np.log([1 - share[kind], share[kind]]) + np.array([sum(np.log(table[y][j][votes[:, j]]) for j in range(votes.shape[1])) for y in range(2)])
            p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        self.posterior = p
        self.reliability = {} if not len(patterns) else {name: float(both[1][votes[:, j] == 2].sum() + both[0][votes[:, j] == 0].sum()) / max(1e-9, float(counts[votes[:, j] != 1].sum())) for j, name in enumerate(LABELERS)}


def loss_and_slope(w: np.ndarray, row: np.ndarray, what: np.ndarray, target: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Minus the mean log likelihood of soft labels, with a ridge, and its slope. w: PLACES weights and a constant."""
    score = np.bincount(row, weights=w[what], minlength=len(target)) + w[-1]
    loss = np.logaddexp(0, score) - target * score
    error = 1 / (1 + np.exp(-np.clip(score, -500, 500))) - target
    slope = np.append(np.bincount(what, weights=error[row], minlength=PLACES), error.sum()) / len(target)
    return float(loss.mean() + ridge / 2 * (w @ w)), slope + ridge * w


def fit_classifier(row: np.ndarray, what: np.ndarray, target: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on the posteriors, by full-batch AdaGrad."""
    w, seen = np.zeros(PLACES + 1), np.full(PLACES + 1, 1e-12)
    for _ in range(rounds if len(target) else 0):
        _, slope = loss_and_slope(w, row, what, target, ridge)
        seen += slope * slope
        w -= 0.5 * slope / np.sqrt(seen)
    return w


def personal_data(spark: SparkSession, docs: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, scratch: Scratch | None = None) -> DataFrame:
    """One row a document: counts of the base kinds, a digest of the base spans, and all spans."""
    scratch = scratch or Scratch(spark, "pii")
    found = scratch.put("found", find(docs))
    each = found.select("doc_id", F.explode("candidates").alias("c"))
    seen = sorted((r["kind"], r["votes"], r["n"]) for r in each.groupBy("c.kind", "c.votes").agg(F.count(F.lit(1)).alias("n")).collect())
    model = LabelModel([r[:2] for r in seen], np.array([r[2] for r in seen], dtype=float))
    posterior = {r[:2]: p for r, p in zip(seen, model.posterior)}
    order_ = (F.xxhash64("doc_id", "c.start", "c.kind"), "doc_id", "c.start", "c.votes")
    rows = each.orderBy(*order_).limit(sample).select("c.kind", "c.votes", "c.features").toArrow()
    lists = rows.column("features").to_pylist()
    row, what = np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.int64), np.array([x for f in lists for x in f], dtype=np.int64)
    w = fit_classifier(row, what, np.array([posterior[k] for k in zip(rows.column("kind").to_pylist(), rows.column("votes").to_pylist())]))
    sent, least = spark.sparkContext.broadcast(w.astype(np.float32)), math.log(threshold / (1 - threshold))
    order = {k: i for i, k in enumerate(BASE + ADDED)}

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            base, more = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            spans, added = [], []
            for b, cs in zip(base, more):
                new = [(c["kind"], c["start"], c["end"]) for c in cs if float(w[c["features"]].sum() + w[-1]) >= least]
                added.append(len(new))
                if new:
                    own = [(k, int(x), int(y)) for k, x, y in (s.split(":") for s in b.split(","))] if b else []
                    b = spans_text(sorted(own + new, key=lambda s: (s[1], order[s[0]])))
                spans.append(b)
            digests = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(digests), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"])

    return found.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
