"""What a page shows and points to, read in one pass over its markup.

Tags are read as browsers do: quoted attribute values may hold ``>``, comments and raw elements end where they should, a tag cut
off by the page's end is none. A stack of open elements repairs what authors leave out: implied end tags, formatting that goes on
in the next block, links that cross blocks, table parts without their parents, text that strayed between table rows. No
tree is kept; an element is a range of the page's text.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

from sitefacts.functions.vocab import BLOCK_TAGS

# Element classes of the HTML standard's tree construction.
_VOID = frozenset("area base basefont bgsound br col embed hr img input keygen link meta param source track wbr".split())
_FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul "
    "h1 h2 h3 h4 h5 h6 pre listing form hr li dd dt xmp plaintext".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPECIAL = _CLOSES_P | frozenset(
    "applet area base basefont bgsound body br button caption col colgroup embed frame frameset head html iframe img input keygen link marquee meta noembed noframes noscript "
    "object param script select source style table tbody td template textarea tfoot th thead title tr track wbr".split()
)
_SCOPE = frozenset("applet caption body table td th marquee object template foreignobject desc".split())
_CELLS, _ROWS, _PARTS = ("td", "th", "caption"), ("tbody", "thead", "tfoot"), frozenset("caption col colgroup tbody td tfoot th thead tr".split())
_MARKED = frozenset("td th caption applet marquee object".split())
_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
_RAW = frozenset("script style noscript iframe noembed noframes xmp title textarea".split())
_DECODED, _HIDDEN = ("title", "textarea"), ("script", "style", "noscript")
_OUT_OF_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)

#: Attributes that name a link.
LINK_ATTRIBUTES = ("data-href", "data-url", "data-link", "data-page", "data-target-url")
_CLICK = re.compile(r"""['"]([^'"]+/[^'"]*)['"]""")

_BLANK = " \t\n\f"
_NAME = re.compile(r"</?([a-zA-Z][^ \t\n\f/>]*)")
_ATTRIBUTE = re.compile(r"""[ \t\n\f/]*([^ \t\n\f/>][^ \t\n\f/>=]*)(?:[ \t\n\f]*=[ \t\n\f]*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^ \t\n\f>"'][^ \t\n\f>]*))?)?""")
_TAG_END = re.compile(r"[ \t\n\f]*(/?)[ \t\n\f/]*")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z0-9]+;?(?!=))")
_WHITE = "[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
_EDGES = re.compile(rf"\A{_WHITE}|{_WHITE}\Z")


def _value(text: str) -> str:
    """An attribute's value; a name without semicolon that goes on as a word is none."""
    return _ENTITY.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text) if "&" in text else text


def _trim(text: str) -> str:
    return text.strip(" \t\n\x0b\f\r      　﻿" + "".join(map(chr, range(0x2000, 0x200B))))


class _Element:
    __slots__ = ("tag", "attrs", "start", "end", "open", "foreign", "place", "last", "before", "caption", "linked")

    def __init__(self, tag, attrs, start, foreign=False):
        self.tag, self.attrs, self.start, self.foreign = tag, attrs, start, foreign
        self.end, self.open, self.place, self.last, self.before, self.caption, self.linked = None, True, 0, None, None, None, ()


class Page:
    """Text, title, links, images and scripts of one page."""

    def __init__(self, html: str):
        self.raw: list[str] = []  # all text of the body, in order
        self.out: list[str] = []  # what shows
        self.body = _Element("body", {}, 0)
        self.stack: list[_Element] = [self.body]
        self.active: list = []  # formatting elements that go on; None marks a cell
        self.in_body, self.hidden, self.form = False, 0, None
        self.title: str | None = None
        self.named: dict[str, str] = {}
        self.records: list[tuple[_Element, int, list]] = []
        self.photos: list[dict] = []
        self.scripts: list[str] = []
        html = html.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
        self.quirks = not html.lstrip(_BLANK)[:15].lower().startswith("<!doctype html")
        self._read(html)
        while self.stack:
            self._pop()

    # Tags and text.

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self._text(unescape(html[at:]))
                return
            if lt > at:
                self._text(unescape(html[at:lt]))
            found = _NAME.match(html, lt)
            if found:
                at = self._tag(html, found, lt)
                if at < 0:
                    return
            elif html.startswith("<!--", lt):
                at = _COMMENT.match(html, lt).end()
            elif html.startswith("<![CDATA[", lt) and self.stack[-1].foreign:
                end = html.find("]]>", lt)
                self._text(html[lt + 9 : end if end >= 0 else n])
                at = end + 3 if end >= 0 else n
            elif html[lt + 1 : lt + 2] in ("!", "?") or html.startswith("</", lt) and lt + 2 < n:
                end = html.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:
                self._text("<")
                at = lt + 1

    def _tag(self, html: str, found: re.Match, lt: int) -> int:
        """Reads a tag; the place behind it, or -1 where the page ends in it."""
        name, at, attrs, n = found[1].lower(), found.end(), {}, len(html)
        while m := _ATTRIBUTE.match(html, at):
            at = m.end()
            value = next((v for v in m.groups()[1:] if v is not None), "")
            attrs.setdefault(m[1].lower(), _value(value))
        ending = _TAG_END.match(html, at)
        at = ending.end()
        if at >= n:
            return -1
        at += 1
        if html[lt + 1] == "/":
            self._end(name)
            return at
        foreign = self.stack[-1].foreign
        if name in _RAW and not foreign:
            close = re.compile(rf"</{name}(?=[ \t\n\f/>])", re.I).search(html, at)
            content = html[at : close.start() if close else n]
            self._raw(name, attrs, unescape(content) if name in _DECODED else content)
            if not close:
                return n
            end = html.find(">", close.end())
            return end + 1 if end >= 0 else n
        self._start(name, attrs, bool(ending[1]))
        if name in ("pre", "listing") and html.startswith("\n", at):
            at += 1
        return at

    def _text(self, text: str) -> None:
        if not self.in_body:
            text = text.lstrip(_BLANK)
            if not text:
                return
            self.in_body = True
        self._rebuild()
        self._say(text)

    def _say(self, text: str, shown: bool = True) -> None:
        self.raw.append(text)
        if shown and not self.hidden:
            self._show(text, text.strip(_BLANK) == "")

    def _show(self, text: str, blank: bool) -> None:
        """Adds to what shows; text between a table's rows goes before the table."""
        for node in reversed(self.stack):
            if node.tag in _CELLS:
                break
            if node.tag == "table":
                if blank and self.stack[-1].tag in ("table", "tr", "colgroup", *_ROWS):
                    break
                self.out.insert(node.place, text)
                node.place += 1
                return
        self.out.append(text)

    # The stack.

    def _push(self, tag: str, attrs: dict, foreign: bool = False) -> _Element:
        node = _Element(tag, attrs, len(self.raw), foreign)
        parent = self.stack[-1]
        node.before, parent.last = parent.last, node
        node.place = len(self.out)
        self.hidden += tag == "svg"
        if tag == "figcaption":
            for outer in self.stack:
                if outer.tag == "figure" and outer.caption is None:
                    outer.caption = node
        self.stack.append(node)
        self._record(node)
        return node

    def _record(self, node: _Element) -> None:
        attrs = node.attrs
        if not attrs:
            return
        found = []
        if node.tag == "a" and "href" in attrs:
            found.append((0, [attrs["href"]]))
        data = [attrs[k] for k in LINK_ATTRIBUTES if k in attrs]
        if data:
            found.append((1, data))
        if "onclick" in attrs:
            found.append((2, _CLICK.findall(attrs["onclick"])))
        node.linked = found
        self.records += [(node, kind, values) for kind, values in found]

    def _close(self, node: _Element) -> None:
        node.open, node.end = False, len(self.raw) if node.end is None else node.end
        self.hidden -= node.tag == "svg"
        if node.tag in _MARKED:
            while self.active and self.active.pop() is not None:
                pass

    def _pop(self) -> _Element:
        node = self.stack[-1]
        if node.tag == "tr" and not self.hidden:
            self.out.append("\n")
        elif node.tag in BLOCK_TAGS and not self.hidden:
            self._show("\n", False)
        self.stack.pop()
        self._close(node)
        return node

    def _pop_to(self, *tags: str) -> None:
        while len(self.stack) > 1 and self._pop().tag not in tags:
            pass

    def _back_to(self, tags) -> None:
        while len(self.stack) > 1 and self.stack[-1].tag not in tags:
            self._pop()

    def _within(self, tags, more=()) -> bool:
        for node in reversed(self.stack):
            if node.tag in tags:
                return True
            if node.tag in _SCOPE or node.tag in more:
                return False
        return False

    def _in_table(self, tag: str) -> bool:
        for node in reversed(self.stack):
            if node.tag == tag:
                return True
            if node.tag in ("table", "template"):
                return False
        return False

    def _imply(self, but: str = "") -> None:
        while self.stack[-1].tag in _IMPLIED and self.stack[-1].tag != but:
            self._pop()

    def _close_p(self) -> None:
        if self._within(("p",), ("button",)):
            self._imply("p")
            self._pop_to("p")

    def _rebuild(self) -> None:
        """Opens again the formatting elements that a block's end cut off."""
        k = len(self.active)
        while k and self.active[k - 1] is not None and not self.active[k - 1].open:
            k -= 1
        for i in range(k, len(self.active)):
            self.active[i] = self._push(self.active[i].tag, self.active[i].attrs)

    def _format(self, tag: str, attrs: dict) -> None:
        alike = []
        for node in reversed(self.active):
            if node is None:
                break
            if node.tag == tag and node.attrs == attrs:
                alike.append(node)
        if len(alike) > 2:
            self._forget(alike[-1])
        self.active.append(self._push(tag, attrs))

    def _forget(self, node: _Element) -> None:
        self.active = [x for x in self.active if x is not node]

    # Start tags.

    def _start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag == "meta":
            self._meta(attrs)
        if tag in ("html", "head", "frameset", "frame"):
            return
        if tag == "body":
            if not self.in_body:
                self.in_body, self.body.attrs = True, attrs
                self._record(self.body)
            return
        if not self.in_body:
            if tag in _HEAD and tag != "template":
                return
            self.in_body = True
        top = self.stack[-1]
        if top.foreign and (tag not in _OUT_OF_FOREIGN or top.tag in ("foreignobject", "desc", "title")):
            if top.tag not in ("foreignobject", "desc", "title"):
                node = self._push(tag, attrs, True)
                if closed:
                    self.stack.pop()
                    self._close(node)
                return
        elif top.foreign:
            while self.stack[-1].foreign:
                self._pop()
        if tag == "image":
            tag = "img"
        if self._within(("select",)) and not self._select(tag, attrs):
            return
        if tag in _PARTS:
            self._part(tag, attrs)
        elif tag == "table":
            if self._parted():
                self._pop_to("table")
            if not self.quirks:
                self._close_p()
            self._push(tag, attrs)
        elif tag in _CLOSES_P:
            self._block(tag, attrs)
        elif tag in _FORMAT:
            if tag in ("a", "nobr"):
                old = next((x for x in self._since_mark() if x.tag == tag), None)
                if old is not None:
                    self._adopt(tag)
                    self._forget(old)
            self._rebuild()
            self._format(tag, attrs)
        elif tag in ("svg", "math"):
            self._rebuild()
            node = self._push(tag, attrs, True)
            if closed:
                self.stack.pop()
                self._close(node)
        else:
            self._inline(tag, attrs)

    def _block(self, tag: str, attrs: dict) -> None:
        if tag == "form" and self.form is not None:
            return
        if tag in ("li", "dd", "dt"):
            own = ("li",) if tag == "li" else ("dd", "dt")
            for node in reversed(self.stack):
                if node.tag in own:
                    self._imply(node.tag)
                    self._pop_to(node.tag)
                    break
                if node.tag in _SPECIAL and node.tag not in ("address", "div", "p"):
                    break
        self._close_p()
        if tag in _HEADINGS and self.stack[-1].tag in _HEADINGS:
            self._pop()
        node = self._push(tag, attrs)
        if tag == "hr":
            self._pop()
        if tag == "form":
            self.form = node

    def _inline(self, tag: str, attrs: dict) -> None:
        if tag == "button" and self._within(("button",)):
            self._imply()
            self._pop_to("button")
        if tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self._pop()
        if tag in ("rb", "rtc", "rp", "rt") and self._within(("ruby",)):
            self._imply("rtc" if tag in ("rp", "rt") else "")
        if tag not in ("param", "source", "track", "base", "link", "meta", "template"):
            self._rebuild()
        if tag == "img":
            self._photo(attrs)
        self._push(tag, attrs)
        if tag in _VOID:
            self._pop()
        elif tag in _MARKED:
            self.active.append(None)

    def _select(self, tag: str, attrs: dict) -> bool:
        """A tag inside a list of choices; whether it is to be read on as usual."""
        if tag in ("option", "optgroup", "hr"):
            if self.stack[-1].tag == "option":
                self._pop()
            if tag != "option" and self.stack[-1].tag == "optgroup":
                self._pop()
            self._push(tag, attrs)
            if tag == "hr":
                self._pop()
            return False
        if tag in ("select", "input", "keygen", "table", *_PARTS):
            self._pop_to("select")
            return tag != "select"
        return tag == "template"

    def _parted(self) -> bool:
        """Whether the place is directly in a table's parts, not in a cell."""
        for node in reversed(self.stack):
            if node.tag in _CELLS or node.tag == "template":
                return False
            if node.tag == "table":
                return True
        return False

    def _part(self, tag: str, attrs: dict) -> None:
        if not self._in_table("table"):
            return
        if tag in ("td", "th"):
            self._back_to(("tr", "table", *_ROWS))
            if self.stack[-1].tag == "table":
                self._push("tbody", {})
            if self.stack[-1].tag != "tr":
                self._push("tr", {})
        elif tag == "tr":
            self._back_to(("table", *_ROWS))
            if self.stack[-1].tag == "table":
                self._push("tbody", {})
        elif tag == "col":
            self._back_to(("table", "colgroup"))
            return
        else:
            self._back_to(("table",))
        self._push(tag, attrs)
        if tag in _CELLS:
            self.active.append(None)

    def _raw(self, tag: str, attrs: dict, content: str) -> None:
        if tag == "title" and self.title is None:
            self.title = content
        if tag == "script" and attrs.get("type", "").strip().lower() == "application/ld+json":
            self.scripts.append(content)
        if not self.in_body:
            if tag in _HEAD:
                return
            self.in_body = True
        if self._within(("select",)):
            if tag == "textarea":
                self._pop_to("select")
            elif tag != "script":
                return
        if tag == "xmp":
            self._close_p()
        if tag not in _HEAD:
            self._rebuild()
        self._push(tag, attrs)
        if tag == "textarea" and content.startswith("\n"):
            content = content[1:]
        self._say(content, tag not in _HIDDEN)
        self._pop()

    # End tags.

    def _end(self, tag: str) -> None:
        if tag in ("body", "html", "head"):
            return
        if not self.in_body:
            if tag != "br":
                return
            self.in_body = True
        if self.stack[-1].foreign and tag not in ("br", "p"):
            for k in range(len(self.stack) - 1, 0, -1):
                node = self.stack[k]
                if not node.foreign:
                    break
                if node.tag == tag:
                    while node.open:
                        self._pop()
                    return
        if tag == "br":
            self._start("br", {}, False)
        elif self._within(("select",)) and tag not in _PARTS and tag != "table":
            if tag == "select":
                self._pop_to("select")
            elif tag == "optgroup" and [x.tag for x in self.stack[-2:]] == ["optgroup", "option"]:
                self._pop()
                self._pop()
            elif self.stack[-1].tag == tag and tag in ("option", "optgroup"):
                self._pop()
        elif tag == "p":
            if not self._within(("p",), ("button",)):
                self._push("p", {})
            self._close_p()
        elif tag == "table" or tag in _PARTS:
            if tag != "col" and self._in_table(tag):
                if tag in _CELLS:
                    self._imply()
                self._pop_to(tag)
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and node.open and self._within(("form",)):
                self._imply()
                if self.stack[-1] is node:
                    self._pop()
                else:
                    self.stack.remove(node)
                    self._close(node)
        elif tag in _HEADINGS:
            if self._within(_HEADINGS):
                self._imply()
                self._pop_to(*_HEADINGS)
        elif tag in _FORMAT:
            self._adopt(tag)
        elif tag in _CLOSES_P and tag != "hr" or tag in ("button", "applet", "marquee", "object"):
            if self._within((tag,), ("ol", "ul") if tag == "li" else ()):
                self._imply(tag if tag in ("li", "dd", "dt") else "")
                self._pop_to(tag)
        else:
            self._other_end(tag)

    def _other_end(self, tag: str) -> None:
        for node in reversed(self.stack):
            if node.tag == tag:
                self._imply(tag)
                while node.open:
                    self._pop()
                return
            if node.tag in _SPECIAL:
                return

    def _since_mark(self):
        for node in reversed(self.active):
            if node is None:
                return
            yield node

    def _adopt(self, tag: str) -> None:
        """Ends a formatting element; the blocks it crosses stay open, and each keeps the part of it that stands inside."""
        if self.stack[-1].tag == tag and self.stack[-1] not in self.active:
            self._pop()
            return
        node = next((x for x in self._since_mark() if x.tag == tag), None)
        if node is None:
            self._other_end(tag)
            return
        if not node.open:
            self._forget(node)
            return
        above = self.stack[self.stack.index(node) + 1 :]
        if any(x.tag in _SCOPE for x in above):
            return
        self._forget(node)
        crossed = [x for x in above if x.tag in _SPECIAL][:8]
        if not crossed:
            while node.open:
                self._pop()
            return
        while self.stack[-1].tag not in _SPECIAL:
            self._pop()
        edges = [*(x.start for x in crossed), len(self.raw)]
        node.end = edges[0]
        for a, b in zip(edges[:-1], edges[1:]):
            part = _Element(node.tag, node.attrs, a)
            part.end = b
            self.records += [(part, kind, values) for kind, values in node.linked]
        for x in [node, *(x for x in above if x.open and x.tag not in _SPECIAL and x not in self.active)]:
            self.stack.remove(x)
            self._close(x)

    # What is found.

    def _meta(self, attrs: dict) -> None:
        for name in ("og:title", "og:site_name"):
            if attrs.get("property") == name:
                self.named.setdefault(name, attrs.get("content", ""))
        if (attrs.get("property") == "og:image" or attrs.get("name") == "twitter:image") and attrs.get("content"):
            self.photos.append({"src": attrs["content"], "meta": True, "alt": "", "title": "", "figure": None, "before": None})

    def _photo(self, attrs: dict) -> None:
        if "src" not in attrs and "data-src" not in attrs:
            return
        listed = attrs.get("srcset", "").split(",")[0].split()
        src = listed[0] if listed else attrs.get("src") or attrs.get("data-src")
        if src:
            figure = next((x for x in reversed(self.stack) if x.tag == "figure"), None)
            before = self.stack[-1].before
            titled = before is not None and (before.tag in ("h1", "h2", "h3", "h4") or {"wp-caption-text", "caption"} & set(before.attrs.get("class", "").split()))
            self.photos.append({"src": src, "meta": False, "alt": attrs.get("alt", ""), "title": attrs.get("title", ""), "figure": figure, "before": before if titled else None})

    def _of(self, node: _Element | None) -> str:
        return _trim("".join(self.raw[node.start : node.end])) if node is not None else ""

    def visible(self) -> str:
        """Text that shows: a line end where a block ends, runs of blanks and of line ends shortened."""
        text = re.sub(r"[ \t\f\v]+", " ", "".join(self.out))
        return _trim(re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+", "\n", text)))

    def title_text(self) -> str:
        return _trim(self.title or "")

    def links(self) -> list[tuple[str, str]]:
        """Targets as written and the text of their elements: anchors, then data attributes, then quoted paths of click handlers."""
        ordered = sorted(range(len(self.records)), key=lambda k: (self.records[k][1], self.records[k][0].start, k))
        return [(value, self._of(node)) for node, _, values in map(self.records.__getitem__, ordered) for value in values]

    def images(self) -> list[tuple[str, str, str, str]]:
        """Source, alternative text, title and caption: metadata first, then image tags."""
        return [(x["src"], x["alt"], x["title"], self._of(x["figure"] and x["figure"].caption)[:400] or self._of(x["before"])[:200]) for x in sorted(self.photos, key=lambda x: not x["meta"])]
