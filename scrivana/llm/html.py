"""Main text of web pages by the maximum-scoring subsequence.

A page is a row of tags and blocks of words. Tags score negative and the words of a block positive where it looks like
main text, negative where it doesn't; a linear scan finds the contiguous region with the highest sum. Weights come from
labelled pages: a logistic model gives each tag, and the words of each block, the probability that it stands in main
text, from the marks around it (open elements and their names, share of links, lengths here and next to it) and not from
its words. Blocks inside the region that score negative (an advert, a form, a reader comment) are left out.

Labelled pages are those of ``labelled_pages`` (invented sites of many shapes), and up to ``SAMPLE`` pages of the table,
those of the least hashes among pages that name their article themselves by one plain ``<article>`` element. Each side
weighs the same. Only the fit uses a sample; all pages are read whole.

Character references are decoded after the tags are read, and white space inside a block becomes one space. What
browsers don't show (scripts, styles, templates, hidden elements) is no text. A null page, or one without main text,
has an empty text; pages without an id, or with a repeated one, are read one by one.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.labelled_pages import labelled_pages

LABELLED, SAMPLE = 600, 300
#: Pages of the sample are at most so long, so that what the fit gathers has a bound.
SAMPLE_CHARS = 100_000
#: What a tag costs that never stands in main text, in words of certain main text. On held-out labelled pages 0.5 found
#: 99% of the words, 4 found 97%, at the same precision.
TAG_COST = 0.5
NEAR = 12  # innermost open elements that a block looks at

# Elements by how browsers treat them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math object canvas select button audio video".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
ENDS_P = BLOCKS - {"body", "head", "html", "option"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": set()}

OPENS = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
TAG_PART = re.compile(r">|=\s*+([\"'])")
MARKS = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Scan:
    """Tags and texts of a page, in one pass whose time is linear in its length."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}

    def tag_end(self, at: int) -> int:
        """Where the tag ends that begins before ``at``: past its ``>``, which a quoted value may hold."""
        page = self.page
        while True:
            found = TAG_PART.search(page, at)
            if not found:
                return -1
            quote = found.group(1)
            if quote is None:
                return found.end()
            at = found.end()
            if at <= self.last[quote]:  # a value that no quote ends is none
                at = page.index(quote, at) + 1

    def parts(self) -> Iterator[tuple[str, str, str]]:
        """("text", text, ""), ("open", name, attributes) and ("close", name, "")."""
        page, at, text_from = self.page, 0, 0
        while found := OPENS.search(page, at):
            start, mark = found.start(), found.group()
            if mark == "<!--":
                end = page.find("-->", start + 2)
                end = len(page) if end < 0 else end + 3
            elif mark in ("<!", "<?"):
                end = page.find(">", start)
                end = len(page) if end < 0 else end + 1
            else:
                end = self.tag_end(NAME.match(page, start + 1).end())
            if end < 0:
                break  # a tag that never ends is text
            if start > text_from:
                yield "text", page[text_from:start], ""
            if mark not in ("<!--", "<!", "<?"):
                name = NAME.match(page, start + 1)
                kind, low = ("close" if mark[1] == "/" else "open"), name.group(1).lower()
                inside = page[name.end() : end - 1]
                if kind == "open" and low in RAW:
                    if not inside.endswith("/") or low in ("script", "style", "title", "textarea"):
                        end = self.past(low, end)
                else:
                    yield kind, low, inside
            at = text_from = end
        if text_from < len(page):
            yield "text", page[text_from:], ""

    def past(self, name: str, at: int) -> int:
        """Past the end tag of an element whose content isn't read; nested ones of its name belong to it."""
        depth, marks = 1, re.compile(rf"<(/?){name}(?=[\s/>])", re.I)
        while depth:
            found = marks.search(self.page, at)
            if not found:
                return len(self.page)
            at = found.end()
            depth += -1 if found.group(1) else name in ("object", "svg", "template")
        end = self.page.find(">", at)
        return len(self.page) if end < 0 else end + 1


def marks_of(name: str, attributes: str) -> tuple[frozenset[str], bool]:
    """Features of an element that its content looks at, and whether it is hidden."""
    out, hidden = {f"in:{name}"}, False
    if attributes and name not in ("html", "body"):
        for key, *values in MARKS.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and re.search(r"display\s*+:\s*+none", value, re.I)):
                hidden = True
            elif key == "role":
                out.add(f"role:{value.strip().lower()[:20]}")
            elif key in ("class", "id"):
                for token in value.split()[:20]:
                    if not re.match(r"(?:has|with|no|js|is)[-_]", token):
                        words = [w.lower() for w in PIECES.findall(token)[:8]]
                        out.update(f"c:{w}" for w in words if len(w) > 1)
                        out.update(f"c5:{w[:5]}" for w in words if len(w) > 4)
    return frozenset(out), hidden


class Block:
    __slots__ = ("text", "words", "linked", "marks", "near")

    def __init__(self, text: str, linked: int, marks: frozenset[str], near: str):
        self.text, self.linked, self.marks, self.near = text, linked, marks, near
        self.words = text.count(" ") + 1

    def share(self) -> int:
        """Fourths of the words that are links."""
        return min(4, 4 * self.linked // self.words)


def items_of(page: str) -> list[tuple[str, frozenset[str]] | Block]:
    """Tags (with the features of where they stand) and blocks, in page order."""
    out: list[tuple[str, frozenset[str]] | Block] = []
    stack: list[tuple[str, frozenset[str], bool]] = []
    names: Counter = Counter()
    pieces: list[str] = []
    state = {"linked": 0, "a": 0, "hidden": 0}
    seen: dict[tuple, frozenset[str]] = {}

    def context() -> frozenset[str]:
        inner = tuple(s[1] for s in stack[-NEAR:])
        if inner not in seen:
            if len(seen) > 5000:
                seen.clear()
            seen[inner] = frozenset().union(*inner) | {f"deep:{min(len(stack), 6)}"}
        return seen[inner]

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text and not state["hidden"]:
                near = next((s[0] for s in reversed(stack)), "")
                out.append(Block(text, state["linked"], context(), near))
            pieces.clear()
        state["linked"] = 0

    def pop() -> None:
        name, _, hidden = stack.pop()
        names[name] -= 1
        state["hidden"] -= hidden

    def shut(wanted: set[str], within: set[str]) -> None:
        """Ends the elements that a start tag ends by itself: down to the last wanted one, unless another scope is between."""
        for k in range(len(stack) - 1, max(-1, len(stack) - 40), -1):
            if stack[k][0] in within:
                return
            if stack[k][0] in wanted:
                while len(stack) > k:
                    pop()
                return

    for kind, name, attributes in Scan(page).parts():
        if kind == "text":
            pieces.append(name)
            if state["a"]:
                state["linked"] += len(name.split())
        elif name not in BLOCKS:
            out.append((f"{'/' if kind == 'close' else ''}{name}"[:12], context()))
            if name == "a":
                state["a"] = int(kind == "open")
            elif name == "br":
                pieces.append(" ")
            if kind == "open" and name not in VOID and name not in ("a", "b", "i", "em", "strong", "span", "u", "font", "small", "code", "sup", "sub"):
                marks, hidden = marks_of(name, attributes)
                if hidden or len(marks) > 1:
                    stack.append((name, marks, hidden))
                    names[name] += 1
                    state["hidden"] += hidden
            elif kind == "open" and name == "span" and attributes:
                marks, hidden = marks_of(name, attributes)
                if hidden:
                    stack.append((name, marks, hidden))
                    names[name] += 1
                    state["hidden"] += hidden
            elif kind == "close" and names[name]:
                flush() if state["hidden"] else None
                while stack and stack[-1][0] != name and stack[-1][0] not in BLOCKS:
                    pop()
                if stack and stack[-1][0] == name:
                    pop()
        else:
            flush()
            state["a"] = 0
            if kind == "open":
                if name in ENDS_P and names["p"]:
                    shut({"p"}, {"td", "th", "table", "button", "object"})
                if name in CLOSES:
                    shut(CLOSES[name], SCOPES[name])
                out.append((name, context()))
                if name not in VOID:
                    marks, hidden = marks_of(name, attributes)
                    stack.append((name, marks, hidden))
                    names[name] += 1
                    state["hidden"] += hidden
            else:
                if names[name]:
                    while stack[-1][0] != name:
                        pop()
                    pop()
                out.append((f"/{name}", context()))
    flush()
    return out


def size_of(n: int) -> int:
    return min(n.bit_length(), 7)


def block_features(blocks: list[Block], k: int) -> list[str]:
    """Features of a block beside those of its context."""
    b = blocks[k]
    size, linked = size_of(b.words), b.share()
    out = [f"size:{size}", f"linked:{linked}", f"near:{b.near}", f"near:{b.near} size:{size // 2} linked:{linked // 2}"]
    if b.text[-1] in ".!?…\"”:;":
        out.append("stop")
    if "©" in b.text[:80]:
        out.append("copyright")
    for side, at in (("before", k - 1), ("after", k + 1)):
        if 0 <= at < len(blocks):
            other = blocks[at]
            out.append(f"{side}:{size_of(other.words) // 2} {other.share() // 2}")
        else:
            out.append(f"{side}:none")
    return out


def tag_features(name: str) -> list[str]:
    """Features of a tag beside those of its context."""
    return ["tag", f"tag:{name}"]


def examples(page: str, main: Iterable[str]) -> Iterator[tuple[tuple[str, ...], bool, int]]:
    """Features of each tag and block of a labelled page, whether it is main text, and how often it counts.

    main: the blocks of the main text in order. A tag is main text if the blocks before and behind it are.
    """
    items, wanted = items_of(page), [w for w in (" ".join(m.split()) for m in main) if w]
    blocks = [x for x in items if isinstance(x, Block)]
    true, at = [], 0
    for b in blocks:
        hit = at < len(wanted) and b.text == wanted[at]
        true.append(hit)
        at += hit
    k = 0
    for x in items:
        if isinstance(x, Block):
            yield tuple(sorted(x.marks.union(block_features(blocks, k)))), true[k], 1
            k += 1
        else:
            yield tuple(sorted(x[1].union(tag_features(x[0])))), 0 < k < len(true) and true[k - 1] and true[k], 1


def article_blocks(page: str) -> list[str] | None:
    """The blocks of a page that names its article by one plain element; None for other pages."""
    low = page.lower()
    if low.count("<article") != 1 or low.count("</article") != 1:
        return None
    start, end = low.index("<article"), low.index("</article")
    inner = page[start:end]
    if end < start or re.search(r"<(?:aside|form|nav|footer|header|section|div)\b|class\s*=|id\s*=", inner[8:], re.I):
        return None
    return [x.text for x in items_of(inner) if isinstance(x, Block)]


class Model:
    """Weights of features; a logistic model fitted by Newton's method on counted examples."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    @staticmethod
    def fit(counted: dict[tuple[tuple[str, ...], bool], float], ridge: float = 1.0, rounds: int = 12) -> Model:
        seen = Counter(f for features, _ in counted for f in features)
        names = {f: k + 1 for k, f in enumerate(sorted(f for f, n in seen.items() if n > 1))}
        rows = [[0] + [names[f] for f in features if f in names] for features, _ in counted]
        y, n = np.array([label for _, label in counted], dtype=float), np.array(list(counted.values()), dtype=float)
        w, size = np.zeros(len(names) + 1), len(names) + 1
        flat, lengths = np.concatenate([np.array(r) for r in rows]), np.array([len(r) for r in rows])
        owner = np.repeat(np.arange(len(rows)), lengths)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[flat], len(rows)), -30, 30)))
            gradient = np.bincount(flat, (n * (y - p))[owner], size) - ridge * w
            hessian = np.zeros((size, size))
            for start in range(0, len(rows), 2000):
                x = np.zeros((min(2000, len(rows) - start), size))
                part = (owner >= start) & (owner < start + 2000)
                x[owner[part] - start, flat[part]] = 1
                hessian += (x * (n * p * (1 - p) + 1e-6)[start : start + 2000, None]).T @ x
            step = np.linalg.solve(hessian + ridge * np.eye(size), gradient)
            w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-3:
                break
        return Model({"": float(w[0])} | {f: float(w[k]) for f, k in names.items()})

    def logit(self, features: Iterable[str]) -> float:
        known = self.weights
        return sum([known[f] for f in features if f in known])

    def main_blocks(self, page: str) -> list[str]:
        items = items_of(page)
        blocks = [x for x in items if isinstance(x, Block)]
        scores: list[float] = []
        contexts: dict[frozenset[str], float] = {}
        tags: dict[tuple[str, frozenset[str]], float] = {}
        bias, k = self.weights.get("", 0.0), 0

        def context(marks: frozenset[str]) -> float:
            if marks not in contexts:
                contexts[marks] = bias + self.logit(marks)
            return contexts[marks]

        for x in items:
            if isinstance(x, Block):
                scores.append(x.words * (2 * probability(context(x.marks) + self.logit(block_features(blocks, k))) - 1))
                k += 1
            else:
                if x not in tags:
                    tags[x] = TAG_COST * (probability(context(x[1]) + self.logit(tag_features(x[0]))) - 1)
                scores.append(tags[x])
        start, end = best_region(scores)
        return [x.text for x, s in zip(items[start:end], scores[start:end]) if s > 0 and isinstance(x, Block)]


def probability(logit: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region of the highest positive sum, in one scan; of equal ones the first. Empty if there is none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, found = total, (start, k + 1)
    return found


def fit_model(sample: DataFrame | None, page: str = "html", n_labelled: int = LABELLED) -> Model:
    """sample: a bounded table of pages that name their article; their examples are counted in Spark."""
    counted: Counter = Counter()
    for html, main in labelled_pages(n_labelled):
        for features, label, n in examples(html, main):
            counted[features, label] += n
    if sample is None:
        return Model.fit(counted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for batch in batches:
            for html in batch.column(0):
                blocks = article_blocks(html.as_py())
                if blocks:
                    for features, label, n in examples(html.as_py(), blocks):
                        own["\n".join(features), label] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in own], pa.string()), pa.array([k[1] for k in own], pa.bool_()), pa.array(list(own.values()), pa.int64())], names=["features", "label", "n"])

    rows = sample.select(page).mapInArrow(count, "features string, label boolean, n long").groupBy("features", "label").agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in rows)
    if total:
        share = sum(counted.values()) / total
        for r in rows:
            counted[tuple(r.features.split("\n")), r.label] += r.n * share
    return Model.fit(counted)


def main_texts(spark: SparkSession, pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", n_labelled: int = LABELLED, n_sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    own = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).cast("string").alias("html"))
    plain = own.where((F.length("html") <= SAMPLE_CHARS) & F.regexp_like("html", F.lit("(?i)<article")))
    hashes = F.xxhash64("page_id", "html")
    sample = plain.select("html", hashes.alias("h")).orderBy("h").limit(n_sample).select("html")
    model = fit_model(sample, "html", n_labelled)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(model.main_blocks(h)) if (h := x.as_py()) else "" for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    types = dict(own.dtypes)
    return own.mapInArrow(extract, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
