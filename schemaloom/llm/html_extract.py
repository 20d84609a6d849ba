"""Main text of web pages by maximum-scoring subsequence segmentation (after Pasternack and Roth, 2009).

A page is a sequence of tags and words. Tags score below zero, words by where they stand: above zero in running text,
below in links' lists, menus, adverts and the like. One linear scan finds the contiguous run of tokens with the largest
sum. Parts of that run inside scripts, forms, menus, adverts, comments and so on are left out, the rest is the article.

Weights come from labelled pages: pages whose markup itself says where the article is (one <article> or <main>), of
which a bounded sample chosen by a hash of the page id (`sample`, 2,000 unless told otherwise) is counted by tag, block
and class name inside and outside the article. What these pages don't show keeps its prior, from the lists below.

Text: character references are decoded, inline tags vanish, every other tag ends a block, white space in a block becomes
one space, and blocks join in page order by one space. Nothing else is dropped or cut off.

Defined cases: a very long page is read whole, however deep. A null or empty html, or one without words outside markup, gives the empty text. Broken markup is read
as browsers do where that is simple: unknown end tags are passed over, li, dt, dd, option, tr, td,
th and p end where the next start tag implies it, an end tag finds its element at any depth, an unclosed tag or comment runs to the end.
Null ids and repeated rows come out as they are. Columns whose names clash with n_chars or text are not carried along.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# HTML's element kinds, and common names of page parts.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "object")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head form select button datalist dialog menu nav aside footer".split())
LANDMARKS = frozenset("article main nav header footer aside form dialog menu address".split())
JUNK = frozenset("ad ads adv advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot bottom sidebar aside side rail widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies respond discussion disqus search pagination pager toolbar copyright legal disclaimer".split())
CONTENT = frozenset("article content main post entry body story text maincontent".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z))|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<[!?/a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z]+")

SAMPLE, SEEN, CLIP = 2000, 5, 3.0
#: What one left-out part takes from a run's sum at most, so that a long list of comments doesn't part an article.
MOST_LOSS = 15.0


class Weights:
    """Log odds of being inside the article, by feature; names for an element's own, blocks for words in it, tags for tags."""

    def __init__(self, learned: dict[str, float] | None = None):
        self.learned = learned or {}

    def element(self, name: str, rest: str) -> float:
        """How much an element says that what is in it belongs to the article."""
        if name in ("html", "body"):
            return 0.0
        said = 0.0
        for label in labels(name, rest):
            known = self.learned.get("n:" + label)
            prior = 2.0 if label in ("article", "main") else -2.0 if label in DROPPED or label in JUNK else 1.0 if label in CONTENT else 0.0
            # What the prior says firmly, labelled pages can weaken but not turn round.
            one = prior if known is None else known if not prior or known * prior > 0 else prior / 2
            if abs(one) > abs(said):
                said = one
        return max(-CLIP, min(CLIP, said))

    def word(self, block: str, link: bool) -> float:
        known = self.learned.get(f"w:{block}{'+a' if link else ''}")
        prior = -0.5 if link else 0.5
        return prior if known is None else max(-1.0, min(1.0, (known + prior) / 2))

    def tag(self, name: str) -> float:
        known = self.learned.get("t:" + name)
        return -0.1 if known is None else -0.02 if known > 1 else -0.1 if known > -1 else -0.5


def labels(name: str, rest: str) -> set[str]:
    out = {name} & LANDMARKS
    if "=" in rest:
        for m in NAMES.finditer(rest):
            out.update(x for x in SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if x)
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text, tag starts and ends, in order; comments, declarations and raw elements are left out, the latter as a break."""
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m["name"]:
            yield ("end" if m["end"] else "start"), m["name"].lower(), m["rest"]
        elif m["raw"]:
            yield "break", m["raw"].lower(), ""
        elif not m[0].startswith("<!"):
            yield "break", "", ""
    if at < len(page):
        yield "text", page[at:], ""


#: By start tag: elements that it ends if they are open, and those beyond which it doesn't reach.
CELLS = frozenset(("table", "td", "th", "caption"))
OUTER = LANDMARKS - {"address"} | CELLS | {"section", "blockquote", "fieldset", "details", "body"}
IMPLIED = {
    "li": (("li",), OUTER | {"ul", "ol"}), "dt": (("dt", "dd"), OUTER | {"dl"}), "dd": (("dt", "dd"), OUTER | {"dl"}), "option": (("option",), frozenset(("select", "datalist"))),
    "tr": (("tr",), frozenset(("table",))), "td": (("td", "th"), frozenset(("table", "tr"))), "th": (("td", "th"), frozenset(("table", "tr"))),
}
IMPLIED |= {n: (("p",), CELLS | {"button"}) for n in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section ul".split()}


class Names:
    """Names of the open elements, and the places of each name, so that an end tag is found at once at any depth."""

    def __init__(self):
        self.open: list[str] = []
        self.at: dict[str, list[int]] = {}

    def push(self, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append(name)

    def last(self, name: str) -> int:
        """The place of the innermost of a name, -1 if none is open."""
        found = self.at.get(name)
        return found[-1] if found else -1

    def implied(self, name: str) -> int:
        """The place of the element that a start tag ends, or -1."""
        ends, stops = IMPLIED.get(name, ((), ()))
        k = max(map(self.last, ends), default=-1)
        return k if k >= 0 and all(self.last(x) < k for x in stops) else -1

    def cut(self, k: int) -> None:
        while len(self.open) > k:
            self.at[self.open.pop()].pop()


class Open:
    """The open elements, with what they say about their contents."""

    def __init__(self, weights: Weights):
        self.weights, self.stack = weights, [("", 0.0, 0, False, "body")]
        self.names = Names()

    def start(self, name: str, rest: str, number: int) -> None:
        if name in VOID or rest.endswith("/") and name in ("svg", "path"):
            return
        self.close(self.names.implied(name))
        _, said, junk, article, block = self.stack[-1]
        own = self.weights.element(name, rest)
        if name == "header" and article and own < 0:  # an article's own head holds its title
            own = 0.0
        if own <= -1 or name in DROPPED:
            junk = junk or number
        article = article or name in ("article", "main")
        self.stack.append((name, own if own else said, junk, article, block if name in INLINE else name))
        self.names.push(name)

    def close(self, k: int) -> None:
        if k >= 0:
            del self.stack[k + 1 :]  # the stack has one more, at its bottom
            self.names.cut(k)

    def end(self, name: str) -> None:
        self.close(self.names.last(name))

    @property
    def link(self) -> bool:
        return any(x[0] == "a" for x in self.stack[-4:])


def segment(page: str, weights: Weights) -> str:
    """The article of a page."""
    open_ = Open(weights)
    pieces: list[tuple[str, bool]] = []  # text, or "" for a break; and whether it is left out
    scores: list[float] = []
    lost: dict[int, float] = {}
    for number, (kind, name, rest) in enumerate(tokens(page), 1):
        if kind == "text":
            words = len(name.split())
            _, said, junk, article, block = open_.stack[-1]
            if not junk:
                score = words * (max(-1.0, min(1.0, weights.word(block, open_.link) + said / 2)) if said or words else 0.0)
            elif article:
                score = 0.0
            else:
                score = -min(float(words), MOST_LOSS - lost.get(junk, 0.0))
                lost[junk] = lost.get(junk, 0.0) - score
            pieces.append((name, bool(junk)))
            scores.append(score)
            continue
        if kind == "start":
            open_.start(name, rest, number)
        elif kind == "end":
            open_.end(name)
        if name not in INLINE:
            pieces.append(("", False))
            scores.append(0.0 if open_.stack[-1][2] else weights.tag(name))
    best = first = last = 0
    total, begin = 0.0, 0
    for k, s in enumerate(scores):
        total += s
        if total <= 0:
            total, begin = 0.0, k + 1
        elif total > best:
            best, first, last = total, begin, k + 1
    out = [(" " if not text else entities.unescape(text)) for text, junk in pieces[first:last] if not text or not junk]
    return " ".join("".join(out).split())


def counts_of(page: str) -> Counter:
    """Of a labelled page, how often each feature stands inside and outside the article; nothing if it isn't labelled."""
    lowered = page.lower()
    mark = next((t for t in ("article", "main") if lowered.count(f"<{t}>") + lowered.count(f"<{t} ") == 1), None)
    out: Counter = Counter()
    if not mark:
        return out
    names, inside = Names(), 0
    said: list[set[str]] = []  # what each open element is called

    def close(k: int) -> int:
        """How many of the marked elements end with the one at k."""
        gone = names.open[k:].count(mark) if k >= 0 else 0
        if k >= 0:
            names.cut(k)
            del said[k:]
        return gone

    for kind, name, rest in tokens(page):
        if kind == "text":
            if words := len(name.split()):
                block = next((n for n in reversed(names.open) if n not in INLINE), "body")
                link = "a" in names.open[-3:]
                out[f"w:{block}{'+a' if link else ''}", bool(inside)] += words
        elif kind == "start":
            if name not in VOID:
                inside -= close(names.implied(name))
            out["t:" + name, bool(inside)] += 1
            called = labels(name, rest) if name not in ("html", "body") else set()
            for label in called:
                out["n:" + label, bool(inside) or name == mark] += 1
            if name == mark and not inside:  # what holds the article is neither in it nor beside it
                for around in said:
                    for label in around:
                        out["n:" + label, False] -= 1
            if name not in VOID:
                names.push(name)
                said.append(called)
                inside += name == mark
        elif kind == "end":
            inside -= close(names.last(name))
    return out


def learn(pages: DataFrame, sample: int = SAMPLE, id_col: str = "page_id", html_col: str = "html", features: int = 5000) -> Weights:
    """Weights of the labelled pages in a bounded sample. Features are counted on the executors; the driver gets `features` of them at most."""
    total = pages.count()
    share = 1 << 20 if total <= sample else max(1, int((1 << 20) * sample / total))
    some = pages.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < share).select(F.col(html_col).cast("string").alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                all_.update(counts_of(page or ""))
        if all_:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in all_]), pa.array([i for _, i in all_]), pa.array(list(all_.values()), pa.int64())], names=["feature", "inside", "n"])

    found = some.mapInArrow(count, "feature string, inside boolean, n long").groupBy("feature").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("o"))
    rows = found.where(F.col("i") + F.col("o") >= SEEN).orderBy(F.desc(F.col("i") + F.col("o")), "feature").limit(features).collect()
    kinds = {k: (sum(r["i"] for r in rows if r["feature"][0] == k) + 1, sum(r["o"] for r in rows if r["feature"][0] == k) + 1) for k in "wtn"}
    return Weights({r["feature"]: max(-CLIP, min(CLIP, math.log((r["i"] + 0.5) / kinds[r["feature"][0]][0]) - math.log((r["o"] + 0.5) / kinds[r["feature"][0]][1]))) for r in rows})


def extracted(spark: SparkSession, pages: DataFrame, weights: Weights, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns `keep` of pages with text string and n_chars long, its code points."""
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    sent = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [segment(page, sent.value) if page else "" for page in batch.column("__html").to_pylist()]
            # A reference may decode to half of a surrogate pair, which no valid string holds.
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "text string, n_chars long"])
    return pages.select(*keep, F.col(html_col).cast("string").alias("__html")).mapInArrow(run, schema)
