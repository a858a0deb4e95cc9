"""HTML to title, Markdown body and metadata: small composable steps that run in an Arrow UDF.

The tree builder covers well-formed pages and the usual omissions (html, head, body, unclosed p and li); full HTML5 error
recovery is out of scope. Selectors: tag, .class, #id, [attr], [attr=value], descendants and commas.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("title meta link base style script noscript".split())
BLOCK = frozenset("address article aside blockquote body div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section table tbody tfoot thead tr ul hr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
SPACES = re.compile(r"[\s\u00a0\u200b\u200c\u200d\ufeff]+")
#: Keys of page metadata that say nothing about its content (fixed values), and how others of that sort begin.
EXCLUDED_KEYS = frozenset(
    """viewport charset x_ua_compatible format_detection referrer color_scheme theme_color mobile_web_app_capable application_name
    handheldfriendly mobileoptimized robots googlebot bingbot google_site_verification yandex_verification
    facebook_domain_verification fb_app_id p_domain_verify norton_safeweb_site_verification generator""".split()
)
EXCLUDED_STARTS = ("apple_mobile_web_app_", "msapplication_", "msvalidate", "twitter_")


class Node:
    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.data, self.children, self.parent = tag, attrs or {}, text, [], None

    def add(self, child: Node, at: int | None = None) -> Node:
        child.parent = self
        self.children.insert(len(self.children) if at is None else at, child)
        return child

    def drop(self) -> None:
        if self.parent:
            self.parent.children.remove(self)

    def walk(self) -> Iterator[Node]:
        """Everything below, in the page's order; a page may be nested to any depth."""
        todo = self.children[::-1]
        while todo:
            n = todo.pop()
            yield n
            todo += n.children[::-1]

    def text(self) -> str:
        return self.data + "".join(c.data for c in self.walk())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.html = self.root.add(Node("html"))
        self.head, self.body = self.html.add(Node("head")), self.html.add(Node("body"))
        self.open = [self.head]

    def _content(self) -> None:
        if self.open[0] is self.head and len(self.open) == 1:
            self.open = [self.body]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "head", "body"):
            target = {"html": self.html, "head": self.head, "body": self.body}[tag]
            target.attrs = {**own, **target.attrs}
            if tag == "body":
                self._content()
            return
        if tag not in HEAD:
            self._content()
        ends = {"p"} if tag in BLOCK and tag not in ("html", "body", "li", "tr") and self.open[-1].tag == "p" else CLOSES.get(tag, ())
        if self.open[-1].tag in ends and len(self.open) > 1:
            self.open.pop()
        elif tag == "li" and any(n.tag == "li" for n in self.open):  # an unclosed item with inline content
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in ("ul", "ol"):
                    break
                if self.open[i].tag == "li":
                    del self.open[i:]
                    break
        node = self.open[-1].add(Node(tag, own))
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.open = [self.body]
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1] is self.head:
            if not data.strip():
                return
            self._content()
        last = self.open[-1].children[-1:]
        if last and last[0].tag == "#text":
            last[0].data += data
        else:
            self.open[-1].add(Node("#text", text=data))


def tree(html: str | None) -> Node:
    """The page's tree without scripts, styles, noscript and comments."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    for n in select(b.root, "script, style, noscript"):
        n.drop()
    return b.root


_PART = re.compile(r"([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[([\w:-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]")


def _fits(n: Node, simple: str) -> bool:
    for tag, cls, ident, attr, value in _PART.findall(simple):
        ok = (
            tag in ("*", n.tag) if tag else cls in n.attrs.get("class", "").split() if cls else n.attrs.get("id") == ident if ident
            else attr in n.attrs and (n.attrs[attr] == value if f"[{attr}=" in simple else True)
        )
        if not ok:
            return False
    return not n.tag.startswith("#")


def select(root: Node, selector: str) -> list[Node]:
    chains = [s.split() for s in selector.split(",")]

    def fits(n: Node, chain: list[str]) -> bool:
        if not _fits(n, chain[-1]):
            return False
        rest, up = chain[:-1], n.parent
        while rest and up:
            if _fits(up, rest[-1]):
                rest = rest[:-1]
            up = up.parent
        return not rest

    return [n for n in root.walk() if any(fits(n, c) for c in chains)]


class Page:
    def __init__(self, root: Node):
        self.root, self.title, self.body, self.metadata = root, None, None, {}

    def first(self, selector: str) -> Node | None:
        found = select(self.root, selector)
        return found[0] if found else None

    def first_text(self, selector: str) -> str:
        n = self.first(selector)
        return n.text().strip() if n else ""


Step = Callable[[Page], Page]


def extract_meta(only: list[str] | None = None, exclude: list[str] | None = None, extras: dict[str, str] | None = None) -> Step:
    """Named meta tags, html_title, language and canonical_url; extras are selectors that pass both lists."""
    barred = [re.compile(x) for x in exclude or []]

    def step(p: Page) -> Page:
        def put(key: str, value: str) -> None:
            if value and (only is None or key in only) and key not in EXCLUDED_KEYS and not key.startswith(EXCLUDED_STARTS) and not any(x.search(key) for x in barred):
                p.metadata[key] = value

        for m in select(p.root, "meta"):
            name = m.attrs.get("name", m.attrs.get("property"))
            if name and "content" in m.attrs:
                key, value = re.sub("[:-]", "_", name).lower(), m.attrs["content"].strip()
                put(key, value or " ")
                if p.metadata.get(key) == " ":
                    p.metadata[key] = ""
        put("html_title", p.first_text("title"))
        put("language", (p.first("html") or Node("html")).attrs.get("lang", ""))
        link = p.first("link[rel=canonical]")
        put("canonical_url", (link.attrs.get("href") if link else "") or p.metadata.get("og_url", ""))
        for key, selector in (extras or {}).items():
            n = p.first(selector)
            if n:
                value = next((n.attrs[a].strip() for a in ("content", "href") if a in n.attrs), n.text().strip())
                if value:
                    p.metadata[key] = value
        return p

    return step


def extract_title(selector: str | None = None, required: bool = False) -> Step:
    def step(p: Page) -> Page:
        p.title = p.first_text(selector) if selector else p.first_text("h1") or p.metadata.get("og_title") or p.metadata.get("html_title")
        p.title = p.title or None
        if p.title is None and required:
            raise ValueError("no title" + (f" at {selector}" if selector else ""))
        return p

    return step


def select_content(selector: str, required: bool = False) -> Step:
    def step(p: Page) -> Page:
        n = p.first(selector)
        if n:
            p.root = Node("#root")
            p.root.add(n)
        elif required:
            raise ValueError(f"nothing at {selector}")
        return p

    return step


def remove(selector: str) -> Step:
    def step(p: Page) -> Page:
        for n in select(p.root, selector):
            n.drop()
        return p

    return step


def unwrap(selector: str) -> Step:
    def step(p: Page) -> Page:
        for n in select(p.root, selector):
            at = n.parent.children.index(n)
            for c in reversed(n.children):
                n.parent.add(c, at)
            n.drop()
        return p

    return step


def clean_whitespace() -> Step:
    def step(p: Page) -> Page:
        for n in p.root.walk():
            if n.tag == "#text":
                n.data = SPACES.sub(" ", n.data)
                if len(n.parent.children) == 1:
                    n.data = n.data.strip()
        return p

    return step


def inject_into_body(key: str, position: str = "append") -> Step:
    def step(p: Page) -> Page:
        value = p.metadata.get(key)
        if isinstance(value, str) and value.strip():
            node = Node("p")
            node.add(Node("#text", text=value))
            (p.first("body") or p.root).add(node, 0 if position == "prepend" else None)
        return p

    return step


def markdown(root: Node) -> str:
    """Markdown of a node: ATX headings, '-' items, fenced code, inline links, GFM tables and strikethrough.

    Nodes are written after what is in them, from a list and not by calls, so a page may be nested to any depth.
    """
    order, todo = [], [(root, False)]
    while todo:
        n, raw = todo.pop()
        order.append((n, raw))
        if n.tag not in ("head", "title", "meta", "link", "pre"):
            todo += [(c, raw or n.tag == "code") for c in n.children]
    done: dict[int, str] = {}
    for n, raw in reversed(order):
        done[id(n)] = _written(n, raw, done)
    return done[id(root)]


def _written(n: Node, raw: bool, done: dict[int, str]) -> str:
    """Markdown of one node, from that of its children."""
    if n.tag == "#text":
        return n.data if raw else re.sub(r"([\\`*_\[\]])", r"\\\1", re.sub(r"[ \t\r\n]+", " ", n.data))
    if n.tag in ("head", "title", "meta", "link"):
        return ""
    if n.tag == "pre":
        return f"\n\n```\n{n.text().strip(chr(10))}\n```\n\n"
    inside = lambda x: "".join(done[id(c)] for c in x.children)
    if n.tag in ("ul", "ol"):
        return _list(n, inside)
    if n.tag == "table":
        return _table(n, inside)
    inner = inside(n)
    flat = re.sub(r"\n{3,}", "\n\n", inner)
    text = flat.strip()
    if re.fullmatch("h[1-6]", n.tag):
        return f"\n\n{'#' * int(n.tag[1])} {text}\n\n" if text else ""
    if n.tag == "blockquote":
        return "\n\n" + "\n".join("> " + x if x else ">" for x in text.split("\n")) + "\n\n"
    if n.tag == "br":
        return "  \n"
    if n.tag == "hr":
        return "\n\n* * *\n\n"
    if n.tag == "img":
        return f"![{n.attrs.get('alt', '')}]({n.attrs['src']})" if n.attrs.get("src") else ""
    around = {"strong": "**", "b": "**", "em": "_", "i": "_", "code": "`", "del": "~", "s": "~", "strike": "~"}.get(n.tag)
    if around:
        if not text:
            return inner and " "
        return (" " if flat[:1].isspace() else "") + around + text + around + (" " if flat[-1:].isspace() else "")
    if n.tag == "a":
        return f"[{text}]({n.attrs['href']})" if n.attrs.get("href") and text else inner
    if n.tag in BLOCK:
        return f"\n\n{text}\n\n" if text else ""
    return inner


def _list(n: Node, inside: Callable[[Node], str]) -> str:
    items = [c for c in n.children if c.tag == "li"]
    start = n.attrs.get("start", "")
    lines = []
    for i, item in enumerate(items):
        mark = f"{(int(start) if start.lstrip('-').isdigit() else 1) + i}. " if n.tag == "ol" else "- "
        body = re.sub(r"\n{3,}", "\n\n", inside(item)).strip()
        lines.append(mark + body.replace("\n", "\n" + " " * len(mark)))
    nested = n.parent is not None and n.parent.tag == "li"
    return ("\n" if nested else "\n\n") + "\n".join(lines) + ("\n" if nested else "\n\n")


def _table(n: Node, inside: Callable[[Node], str]) -> str:
    rows = [[re.sub(r"\s+", " ", inside(c)).strip().replace("|", r"\|") for c in r.children if c.tag in ("td", "th")] for r in select(n, "tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    head = ["| " + " | ".join(rows[0]) + " |", "| " + " | ".join("---" for _ in rows[0]) + " |"]
    return "\n\n" + "\n".join(head + ["| " + " | ".join(r) + " |" for r in rows[1:]]) + "\n\n"


def to_markdown() -> Step:
    def step(p: Page) -> Page:
        p.body = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n(?!\n)", lambda m: m[0] if m[0] == "  \n" else "\n", markdown(p.root))).strip()
        return p

    return step


def run(html: str | None, steps: tuple[Step, ...]) -> tuple[str, str, dict[str, str]]:
    p = Page(tree(html))
    for s in steps:
        p = s(p)
    return p.title or "", p.body or "", p.metadata


#: pages that a task's Python holds at once, with what is made of them
PAGES = 500


def small_batches(spark: SparkSession) -> None:
    """Lower Arrow's batch size to what suits whole pages: a large table would fill batches of 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= PAGES:
        spark.conf.set(key, str(PAGES))


def pipeline(*steps: Step) -> Callable[[Column], Column]:
    """A column function: html -> struct<title, body, metadata map, error>; a step that raises gives an error, not a failed job."""

    def parse(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for h in pages:
            try:
                rows.append((*run(h, steps), None))
            except Exception as e:  # noqa: BLE001  one bad page is a row with an error
                rows.append((None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["title", "body", "metadata", "error"])

    return F.pandas_udf(parse, "title string, body string, metadata map<string,string>, error string")


def kb_transform(articles, base_url: str, source: str):
    """id, title, url, last_published_at, content -> external_id, title, body, metadata, error; blank articles and tables are left out.

    An article that could not be parsed stays, with its error and no body, so that a run can count it as failed.
    """
    parsed = articles.withColumn("_p", pipeline(clean_whitespace(), remove("table"), to_markdown())(F.col("content")))
    meta = F.to_json(F.struct(F.lit(source).alias("source"), F.col("url").alias("source_slug"), F.concat(F.lit(base_url), "url").alias("source_url"), "last_published_at"))
    out = parsed.select(F.col("id").alias("external_id"), "title", F.col("_p.body").alias("body"), meta.alias("metadata"), F.col("_p.error").alias("error"))
    return out.filter("body <> '' OR error IS NOT NULL")
