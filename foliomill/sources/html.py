"""A small HTML tree with CSS selectors, and the joining of addresses.

Built on the standard library's tokenizer.  Void tags, implied ends (p, li, dt, dd, option, rows
and cells of tables) and unclosed tags are repaired; head and body are made where a page has
none.  Misnested formatting tags are closed in order, not cloned as browsers do.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta title".split())
HEAD_TOO = HEAD_ONLY | frozenset("script style noscript template".split())
TABLE_TAGS = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
#: A start tag on the left ends the open tags on the right, as far as the nearest of BARRIERS.
ENDS = {
    **dict.fromkeys("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("td", "th", "tr", "p", "li"), "td": ("td", "th", "p", "li"), "th": ("td", "th", "p", "li"),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ("td", "th", "tr", "thead", "tbody", "tfoot", "p", "li")),
}
BARRIERS = {"li": frozenset(("ul", "ol", "table", "td", "th")), "p": frozenset(("table", "td", "th", "button"))}


@dataclass(eq=False)
class Node:
    """An element; children are elements and strings."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        """The elements below, in the order of the page."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def texts(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            else:
                stack.extend(reversed(c.children))

    def text(self) -> str:
        return "".join(self.texts())

    def select(self, selector: Selector) -> Iterator[Node]:
        return (n for n in self.walk() if selector.fits(n))

    def first(self, selector: Selector) -> Node | None:
        return next(self.select(selector), None)

    def drop(self, selector: Selector) -> None:
        """Remove the elements below that the selector fits."""
        for n in list(self.select(selector)):
            n.parent.children = [c for c in n.parent.children if c is not n]

    def html(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            c = stack.pop()
            if isinstance(c, _Raw):
                out.append(c)
            elif isinstance(c, str):
                out.append(escape(c, quote=False))
            else:
                out.append("<" + c.tag + "".join(f' {k}="{escape(v)}"' for k, v in c.attrs.items()) + ">")
                if c.tag not in VOID:
                    stack.append(_Raw(f"</{c.tag}>"))
                    stack.extend(_Raw(x) if c.tag in ("script", "style") else x for x in reversed(c.children))
        return "".join(out)


class _Raw(str):
    """Markup that is written as it is."""


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.head: Node | None = None
        self.body: Node | None = None
        self.open = [self.root]
        self.count: Counter[str] = Counter()  # open elements by tag, so that what isn't open isn't looked for

    def _close(self, at: int) -> None:
        """Close the open elements from this one on."""
        self.count.subtract(n.tag for n in self.open[at:])
        del self.open[at:]

    def _add(self, node: Node) -> None:
        node.parent = self.open[-1]
        self.open[-1].children.append(node)

    def _into_body(self, attrs: dict[str, str] | None = None) -> None:
        if self.body is None:
            self._close(1)
            self.body = Node("body")
            self._add(self.body)
            self.open.append(self.body)
            self.count["body"] += 1
        for k, v in (attrs or {}).items():
            self.body.attrs.setdefault(k, v)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag == "html":
            for k, v in own.items():
                self.root.attrs.setdefault(k, v)
            return
        if tag == "body":
            self._into_body(own)
            return
        if tag == "head":
            if self.head is None and self.body is None:
                self.head = Node("head", own)
                self._close(1)
                self._add(self.head)
                self.open.append(self.head)
                self.count["head"] += 1
            return
        if self.body is None:
            if tag in HEAD_TOO and self.open[-1] in (self.root, self.head):
                if self.head is None:
                    self.head = Node("head")
                    self._add(self.head)
                self._close(1)
                self.open.append(self.head)
                self.count["head"] += 1
            elif self.head is None or self.head not in self.open or self.open[-1] is self.head:
                self._into_body()
        if ends := ENDS.get(tag):
            self._imply(tag, ends)
        node = Node(tag, own)
        self._add(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def _imply(self, tag: str, ends: tuple[str, ...]) -> None:
        """Close the outermost open element that `tag` ends, inside the nearest barrier."""
        if not any(self.count[e] > 0 for e in ends):
            return
        barriers = BARRIERS["li" if tag == "li" else "p"] if tag not in TABLE_TAGS or tag == "table" else frozenset(("table",))
        cut = None
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag in ends:
                cut = i
            if self.open[i].tag in barriers:
                break
        if cut is not None:
            self._close(cut)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if self.count[tag] <= 0:
            return
        stop = frozenset(("table",)) if tag in TABLE_TAGS else frozenset(("table", "td", "th"))
        for i in range(len(self.open) - 1, 0, -1):
            node = self.open[i]
            if node.tag == tag and node is not self.body:
                self._close(i)
                return
            if node.tag in stop or node is self.body:
                return

    def handle_data(self, data: str) -> None:
        if self.body is None and self.open[-1] in (self.root, self.head):
            if not data.strip():
                return
            self._into_body()
        here = self.open[-1].children
        if here and isinstance(here[-1], str):
            here[-1] += data
        else:
            here.append(data)


#: Comments and raw text, which stay as they are, and ampersands, with what makes them a closed reference.
_REFERENCE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1|\Z)|&(?P<to>#[0-9]+;|#x[0-9a-f]+;|[a-z][a-z0-9]*;)?", re.DOTALL | re.IGNORECASE)


def _closed_only(m: re.Match) -> str:
    to = m["to"] or ""
    return m[0] if m[0][0] == "<" or to.startswith("#") or to in html5 else "&amp;" + to


def parse(html: str, closed: bool = False) -> Node:
    """The tree of a page; null bytes and anything else that isn't markup are text.

    Browsers read some references without a semicolon (`&amp` as `&`); with `closed` those are text.
    """
    builder = _Builder()
    builder.feed(_REFERENCE.sub(_closed_only, html) if closed else html)
    builder.close()
    if builder.body is None:
        builder._into_body()
    return builder.root


_PART = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\]\s]+))\s*)?\]""")


@dataclass(frozen=True)
class Compound:
    """tag, #id, .class and [attribute] tests of one element."""

    tag: str | None
    tests: tuple[tuple[str, str, str], ...]

    def fits(self, n: Node) -> bool:
        if self.tag and self.tag != n.tag:
            return False
        for name, op, want in self.tests:
            have = n.attrs.get(name)
            if have is None:
                return False
            ok = {"": True, "=": have == want, "~=": want in have.split(), "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want),
                  "*=": bool(want) and want in have, "|=": have == want or have.startswith(want + "-")}[op]
            if not ok:
                return False
        return True


class Selector:
    """Tags, #ids, .classes, [attributes], blanks for descendants, `>` for children, commas for either."""

    def __init__(self, css: str):
        self.css = css
        self.chains = [self._chain(group.strip()) for group in css.split(",")]

    def _chain(self, group: str) -> list[tuple[str, Compound]]:
        out: list[tuple[str, Compound]] = []
        link, at = " ", 0
        while at < len(group):
            if m := re.compile(r"\s*>\s*|\s+").match(group, at):
                link, at = (">" if ">" in m[0] else " "), m.end()
                continue
            tag, tests, begin = None, [], at
            while m := _PART.match(group, at):
                if m["tag"]:
                    if at != begin:
                        break
                    tag = None if m["tag"] == "*" else m["tag"].lower()
                elif m["id"]:
                    tests.append(("id", "=", m["id"]))
                elif m["cls"]:
                    tests.append(("class", "~=", m["cls"]))
                else:
                    tests.append((m["name"].lower(), m["op"] or "", next((m[g] for g in "abc" if m[g] is not None), "")))
                at = m.end()
            if at == begin:
                raise ValueError(f"not a selector: {self.css!r}")
            out.append((link, Compound(tag, tuple(tests))))
        if not out or link == ">" and group.endswith(">"):
            raise ValueError(f"not a selector: {self.css!r}")
        return out

    def fits(self, n: Node) -> bool:
        return any(c[-1][1].fits(n) and self._above(c, len(c) - 1, n) for c in self.chains)

    def _above(self, chain: list[tuple[str, Compound]], i: int, n: Node) -> bool:
        if i == 0:
            return True
        link, up = chain[i][0], n.parent
        while up is not None:
            if chain[i - 1][1].fits(up) and self._above(chain, i - 1, up):
                return True
            if link == ">":
                return False
            up = up.parent
        return False


SPECIAL = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}


def join(base: str, href: str) -> str | None:
    """`href` against the page's address, as browsers write it; None where it can't be one.

    A broken base is none, so that only whole addresses can be joined with it.
    """
    try:
        base_scheme = urlsplit(base).scheme.lower()
    except ValueError:
        base = base_scheme = ""
    href = re.sub(r"[\t\n\r]", "", href).strip("".join(map(chr, range(33))))
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", href)
    if scheme and scheme[1].lower() not in SPECIAL:
        return scheme[1].lower() + quote(href[scheme.end() - 1 :], safe="!#$%&'()*+,/:;<=>?@[\\]^_`{|}~ \"")
    if not scheme and base_scheme in SPECIAL or scheme:
        cut = re.search(r"[?#]", href)
        head, tail = (href[: cut.start()], href[cut.start() :]) if cut else (href, "")
        href = head.replace("\\", "/") + tail
    try:
        parts = urlsplit(urljoin(base, href))
        host, port = (parts.hostname or "").lower(), parts.port
        if not host.isascii():
            host = host.encode("idna").decode()
    except (ValueError, UnicodeError):
        return None
    name = parts.scheme.lower()
    if not name or name in SPECIAL and (not host or re.search(r"[\s<>^|%#@\\]", host)):
        return None
    user = parts.netloc.rpartition("@")[0]
    place = (user + "@" if user else "") + (f"[{host}]" if ":" in host else host) + (f":{port}" if port is not None and port != SPECIAL.get(name) else "")
    path = quote(_no_dots(parts.path) or "/", safe="!$%&'()*+,/:;=@[\\]^_|~")
    whole = urljoin(base, href)
    query = "?" + quote(parts.query, safe="!$%&()*+,/:;=?@[\\]^_`{|}~") if parts.query or re.search(r"^[^#]*\?", whole) else ""
    fragment = "#" + quote(parts.fragment, safe="!#$%&'()*+,/:;=?@[\\]^_{|}~") if parts.fragment or href.endswith("#") else ""
    return f"{name}://{place}{path}{query}{fragment}"


def _no_dots(path: str) -> str:
    """The path without `.` and `..`."""
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        low = p.lower().replace("%2e", ".")
        if low == "..":
            if len(out) > 1:
                out.pop()
        elif low != ".":
            out.append(p)
        if low in (".", "..") and i == len(parts) - 1:
            out.append("")
    return "/".join(out)
