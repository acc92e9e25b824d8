"""Main text of web pages by wrapper induction.

Each page becomes a tree of its block elements; consecutive siblings of one kind
fold into one repeating node. The trees of a host are aligned by simple tree
matching (the largest order-preserving mapping of children with equal labels) and
merged into the host's template, whose nodes are the slots. Templates are merged
inside tasks first, then per host over salted, distinct partial templates, so a hot
host never meets in one task page by page. Then each page is aligned with the
template and Spark counts, over the host's different pages, those that hold a slot
and those that hold one line in it. A line that stands on all pages of its slot, three
at least, is template, any other one content.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments are never content. Where a page marks its article (article or main
element), the text is that element's content; there, a line is template only if it
stands on four pages at least and on nine tenths of the host's, so that headings and
closing lines that some articles share stay. Otherwise it is the whole page's content. A
page without any (its host has one page, or copies of one) keeps all its lines.

Defined results: a null html counts as empty and gives an empty text; a null url
is a host of its own name; broken markup never fails (open elements close at the
end, stray ends are ignored, an inline advert that is never closed stays); elements
below depth ``DEEPEST`` are flattened into it; repeated rows are extracted each.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import small_batches
from daygrid.session import checked_broadcast, stable

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# Element names of the HTML standard.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "select", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label".split())
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head"}
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"ul", "ol", "dl", "table", "body", "article", "main", "div", "section"}
NOISE = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|reply|replies|disqus|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay"
    r"|nav\w*|menu|breadcrumbs?|sidebar|widget|related|recommend\w*|share|sharing|social|newsletter|subscribe|footer|header|masthead|login|signup|search)",
    re.I,
)
# Parts that make a class a statement about a part of the page, not its name.
MODIFIERS = set("has have no not with without hide hides hidden show shows is open opened closed enabled disabled allowed active on off layout".split())
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
SPACES = re.compile(r"\s+")
# Deeper elements add their lines to the element at this depth, as browsers flatten them too.
DEEPEST = 200
# A line is template from so many different pages on: where no article is marked, and inside a
# marked one, where it must also stand on this share of the host's pages.
CONSTANT_PAGES, FIRM_PAGES, FIRM_SHARE = 3, 4, 0.9
SALTS = 16
ARROW_LINES = pa.list_(pa.struct([("text", pa.string()), ("slot", pa.int64()), ("line", pa.int64()), ("inside", pa.bool_())]))


class Node:
    __slots__ = ("label", "noise", "article", "parts", "children")

    def __init__(self, label: str, noise: bool = False, article: bool = False):
        self.label, self.noise, self.article, self.parts, self.children = label, noise, article, [], []


def noise_marks(marks: str) -> bool:
    """Whether a class or id names a part that is never content by its first or last word."""
    for token in marks.split():
        words = [w for w in re.split(r"[_-]+", token.lower()) if w]
        if words and not MODIFIERS.intersection(words) and (NOISE.fullmatch(words[0]) or NOISE.fullmatch(words[-1])):
            return True
    return False


def attributes(text: str) -> dict[str, str]:
    """Attributes of a start tag by name; one without a value has an empty one."""
    return {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(text)} if text else {}


def is_noise(name: str, found: dict[str, str]) -> bool:
    """Whether an element is never content: by its name, by being hidden, or by its role, class or id."""
    if name in DROPPED or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in NOISE_ROLES:
        return True
    own = name in ("html", "body", "article", "main") or found.get("role") in ("main", "article")  # never noise by class
    return not own and noise_marks(f"{found.get('class', '')} {found.get('id', '')}")


def end_of(page: str, name: str, at: int) -> int | None:
    """Where the element ``name`` ends whose start tag ended at ``at``, if it is closed at all."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?![A-Za-z0-9:-])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return None


def parse(page: str) -> Node:
    """Tree of block elements; ``parts`` holds texts and child nodes in page order."""
    root = Node("page")
    stack, at, held = [root], 0, []

    def flush() -> None:
        text = SPACES.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text and not (len(stack) > DEEPEST and stack[-1].noise):
            stack[-1].parts.append(text)

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        held.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if not m[1] and m[3] and is_noise(name, attributes(m[3])):
                at = end_of(page, name, at) or at
            continue
        if name in VOID:
            held.append(" ")
            if name == "hr":
                flush()
            continue
        if not m[1]:
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, at)
                at = end.end() if end else n
                continue
            flush()
            if name in CLOSES_P and stack[-1].label.split(".")[0] == "p":
                stack.pop()
            for i in range(len(stack) - 1, 0, -1):
                own = stack[i].label.split(".")[0]
                if own in CLOSES_SELF.get(name, ()):
                    del stack[i:]
                    break
                if own in BOUNDS:
                    break
            found = attributes(m[3])
            noise = is_noise(name, found)
            if stack[-1].article and name == "header" and not noise_marks(f"{found.get('class', '')} {found.get('id', '')}"):  # its own heading group
                noise = "hidden" in found or found.get("aria-hidden") == "true"
            article = name in ("article", "main") or found.get("role") in ("main", "article") or stack[-1].article
            node = Node(f"{name}.{found.get('class', '').split(' ')[0]}", noise or stack[-1].noise, article and name not in ("html", "body"))
            if len(stack) < DEEPEST:
                stack[-1].parts.append(node)
                stack[-1].children.append(node)
            else:  # its lines join those of the element at the greatest depth
                node.parts, node.children = stack[-1].parts, stack[-1].children
            if not m[3].endswith("/"):
                stack.append(node)
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].label.split(".")[0] == name:
                    flush()
                    del stack[i:]
                    break
    flush()
    return root


def template_of(node: Node) -> list:
    """[label, children] with runs of one label folded."""
    children: list = []
    for c in node.children:
        if c.noise:
            continue
        made = template_of(c)
        if children and children[-1][0] == made[0]:
            children[-1] = merged(children[-1], made)
        else:
            children.append(made)
    return [node.label, children]


def matching(a: list, b: list) -> list[tuple[int, int]]:
    """Largest order-preserving mapping of two child lists by label, heavier subtrees first."""
    w = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            w[i + 1][j + 1] = max(w[i][j + 1], w[i + 1][j], w[i][j] + (1 + min(len(x[1]), len(y[1])) if x[0] == y[0] else 0))
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if w[i][j] == w[i - 1][j]:
            i -= 1
        elif w[i][j] == w[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def merged(a: list, b: list) -> list:
    """Template of two aligned trees; unmatched children stay, in order."""
    children, i, j = [], 0, 0
    for x, y in [*matching(a[1], b[1]), (len(a[1]), len(b[1]))]:
        children += a[1][i:x] + b[1][j:y]
        if x < len(a[1]):
            children.append(merged(a[1][x], b[1][y]))
        i, j = x + 1, y + 1
    folded: list = []
    for c in children:
        if folded and folded[-1][0] == c[0]:
            folded[-1] = merged(folded[-1], c)
        else:
            folded.append(c)
    return [a[0], folded]


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def lines_of(node: Node, template: list, slot: str = "") -> Iterator[tuple[str, str, bool]]:
    """(text, slot, whether in a marked article) of a page's lines in order; the slot is the path of the aligned template node."""
    folds, at = [], []
    for c in node.children:
        if not c.noise and (not folds or folds[-1][0] != c.label):
            folds.append([c.label, []])
        at.append(len(folds) - 1)
    place = dict(matching(folds, template[1])) if folds else {}
    fold = iter(at)
    for p in node.parts:
        if isinstance(p, str):
            yield p, slot, node.article
            continue
        i = next(fold)
        if not p.noise:
            j = place.get(i)
            yield from lines_of(p, template[1][j] if j is not None else [p.label, []], f"{slot}/{j if j is not None else p.label}")


def has_article(node: Node) -> bool:
    return any(not c.noise and (c.article or has_article(c)) for c in node.children)


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit("none"))


def merged_by_host(trees: Iterator[tuple[str, list]]) -> dict[str, list]:
    held: dict[str, list] = {}
    for host, tree in trees:
        held[host] = merged(held[host], tree) if host in held else tree
    return held


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) from (host, html): merged per task, per salted host, then per host."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        held = merged_by_host((h, template_of(parse(p))) for h, p in pairs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([json.dumps(t) for t in held.values()], pa.string())], names=["host", "template"]
        )

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("template", kind="stable")
        held = merged_by_host((h, json.loads(t)) for h, t in zip(rows["host"], rows["template"], strict=True))
        return pd.DataFrame({"host": list(held), "template": [json.dumps(t) for t in held.values()]}, dtype=object)

    kind = "host string, template string"
    first = stable(pages.mapInArrow(partial, kind), "partial_templates")
    salted = first.withColumn("salt", F.pmod(F.xxhash64("template"), F.lit(SALTS)))
    halves = salted.groupBy("host", "salt").applyInPandas(lambda rows: joined(rows[["host", "template"]]), kind)
    return stable(halves.groupBy("host").applyInPandas(joined, kind), "templates")


def constant_lines(aligned: DataFrame) -> DataFrame:
    """(host, constant, firm): lines on all different pages of their slot, and those of them on nearly all of the host's pages."""
    seen = aligned.select("host", "copy", F.explode("lines").alias("x")).select("host", "copy", "x.slot", "x.line").distinct()
    by_line = seen.groupBy("host", "slot", "line").agg(F.count("*").alias("n"))
    by_slot = seen.select("host", "copy", "slot").distinct().groupBy("host", "slot").agg(F.count("*").alias("n"))
    by_host = aligned.select("host", "copy").distinct().groupBy("host").agg(F.count("*").alias("n_pages"))
    same = by_line.filter(F.col("n") >= CONSTANT_PAGES).join(by_slot, ["host", "slot", "n"]).join(by_host, "host")
    nearly_all = (F.col("n") >= FIRM_PAGES) & (F.col("n") >= FIRM_SHARE * F.col("n_pages"))
    firm = F.collect_set(F.when(nearly_all, F.col("line"))).alias("firm")
    return stable(same.groupBy("host").agg(F.collect_set("line").alias("constant"), firm), "constant_lines")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    small_batches(pages.sparkSession, 500)
    own = pages.select(
        F.col(id_col).alias("page"), F.col(url_col).alias("address"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(url_col).alias("host")
    )
    known = checked_broadcast(templates(own.select("host", "html")))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, list] = {}
        for batch in batches:
            copies, marks, texts = [], [], []
            for page, template in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if template not in loaded:
                    if len(loaded) > 2000:
                        loaded.clear()
                    loaded[template] = json.loads(template)
                root = parse(page)
                found = list(lines_of(root, loaded[template]))
                marks.append(has_article(root))
                copies.append(digest("\n".join(f"{slot} {text}" for text, slot, _ in found)))
                texts.append([{"text": t, "slot": digest(s), "line": digest(f"{s} {t}"), "inside": inside} for t, s, inside in found])
            columns = [*batch.columns[:3], pa.array(copies, pa.int64()), pa.array(marks, pa.bool_()), pa.array(texts, ARROW_LINES)]
            yield pa.RecordBatch.from_arrays(columns, names=["page", "address", "host", "copy", "marked", "lines"])

    id_kind = pages.schema[id_col].dataType.simpleString()
    kind = f"page {id_kind}, address string, host string, copy long, marked boolean, lines array<struct<text:string,slot:long,line:long,inside:boolean>>"
    aligned = stable(own.join(known, "host").select("page", "address", "host", "html", "template").mapInArrow(align, kind), "aligned_pages")
    held = aligned.join(checked_broadcast(constant_lines(aligned)), "host", "left")
    own_lines = F.filter("lines", lambda x: ~F.col("marked") | x["inside"])
    none = F.array().cast("array<long>")
    varying = F.filter(
        own_lines,
        lambda x: ~F.array_contains(F.coalesce(F.when(F.col("marked"), F.col("firm")).otherwise(F.col("constant")), none), x["line"]),
    )
    kept = F.when(F.size(varying) > 0, varying).otherwise(own_lines)
    text = F.array_join(F.transform(kept, lambda x: x["text"]), " ").alias("text")
    return held.select(F.col("page").alias(id_col), F.col("address").alias(url_col), text).withColumn("n_chars", F.length("text").cast("long"))
