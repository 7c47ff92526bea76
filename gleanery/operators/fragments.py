"""HTML of untrusted pages made safe to show, and the links that it holds."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.links import classified

SHAPE = "struct<safe:string,links:array<struct<href:string,label:string>>>"
LABEL = 200  # UTF-16 code units
DEEPEST = 512

# Elements that go with what they hold; attributes that load something or say where to; and rules of HTML
REMOVED = frozenset("audio base button embed form frame frameset iframe img input link meta object portal script select source style textarea track video".split())
LOADING = frozenset("action background cite data formaction longdesc manifest ping poster src srcdoc srcset usemap xlink:href".split())
OF_LINKS = frozenset("href target rel referrerpolicy download".split())
VOID = frozenset("area base br col embed frame hr img input link meta source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp".split())
TEXT_ONLY = RAW | {"textarea", "title"}
UNWRAPPED = frozenset("html head body noembed noframes xmp plaintext".split())
TABLE_PARTS = frozenset("table caption colgroup tbody thead tfoot tr td th".split())
BARRIERS = frozenset("applet caption html marquee object table td template th".split())
ENDS_PARAGRAPH = frozenset(
    """address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr li listing main menu nav ol p pre search section summary table ul""".split()
)
# what the start of an element ends, and what that end does not reach through
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "a": ({"a"}, set()), "tr": ({"tr", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "button": ({"button"}, set()), "option": ({"option"}, set()), "select": ({"select"}, set()),
}

_MARK = re.compile(r"<(?:!--|[!?]|/?[A-Za-z]|/)")
_NAME = re.compile(r"[^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"(=?[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)|(?=>)))?")
_REFERENCE = re.compile(r"&(?:(#[0-9]+;?|#[xX][0-9a-fA-F]+;?)|([A-Za-z][A-Za-z0-9]*)(;?)(=?))")
_FINE_NAME = re.compile(r"[a-z_:][a-z0-9_:.-]*")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in TEXT_ONLY}


def _plain(value: str) -> str:
    """An attribute's value with its references resolved; names without a semicolon stay before letters, digits and `=`."""

    def sign(found: re.Match) -> str:
        if found[1]:
            return unescape(found[1] and "&" + found[1])
        known = html5.get(found[2] + found[3])
        return found[0] if known is None or found[4] and not found[3] else known + found[4]

    return _REFERENCE.sub(sign, value)


def _shown(text: str, quoted: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;") if quoted else text


class Fragment:
    """One pass over a page: `safe`, its body with nothing in it that runs, loads or leads astray, and `links` to the web.

    Whatever is written is an element with attributes that passed, or text with its signs escaped, so that no reading of the page
    by other rules finds more in it. Elements are closed where HTML closes them; formatting that is left open is closed with the
    element around it and not opened again, stray ends are dropped, and nesting stops at 512. Comments and declarations go.
    """

    def __init__(self, html: str):
        self.out: list[str] = []
        self.links: dict[str, list[str]] = {}
        self._open: list[str] = []
        self._counts: Counter[str] = Counter()
        self._hidden: int | None = None  # where in `_open` the removed element is that holds the present place
        self._label: tuple[int, list[str]] | None = None
        self._body = False
        self._read(html)
        self._close(0)

    @property
    def safe(self) -> str:
        return "".join(self.out)

    def _read(self, html: str) -> None:
        at = 0
        while found := _MARK.search(html, at):
            self._text(unescape(html[at : found.start()]))
            start, mark = found.start(), found[0]
            if mark == "<!--":
                empty = re.compile(r"-?>").match(html, start + 4)
                end = re.compile(r"--!?>").search(html, start + 4) if empty is None else empty
                at = end.end() if end else len(html)
            elif mark[-1] in "!?/":
                end = html.find(">", start + 1)
                at = len(html) if end < 0 else end + 1
            else:
                at = self._tag(html, start + len(mark) - 1, mark[1] == "/")
        self._text(unescape(html[at:]))

    def _tag(self, html: str, at: int, closing: bool) -> int:
        """Read the tag whose name begins at `at`; where what follows it begins. A tag that the text ends in is dropped."""
        name, at = _NAME.match(html, at)[0].lower(), _NAME.match(html, at).end()
        attributes: dict[str, str] = {}
        while True:
            at = _GAP.match(html, at).end()
            if at == len(html):
                return at
            if html[at] == ">":
                break
            found = _ATTRIBUTE.match(html, at)
            after = _GAP.match(html, found.end()).end()
            if html[after : after + 1] == "=" and found[2] is None and found[3] is None and found[4] is None:
                value = re.compile(r"=\s*").match(html, after).end()
                if html[value : value + 1] in ("'", '"'):
                    return len(html)  # the quote is never closed
            attributes.setdefault(found[1].lower(), _plain(next((v for v in found.groups()[1:] if v is not None), "")))
            at = max(found.end(), at + 1)
        at += 1
        if closing:
            self._end(name)
            return at
        if name in TEXT_ONLY:
            end = _END[name].search(html, at)
            held, stop = html[at : end.start() if end else len(html)], html.find(">", end.start()) if end else -1
            self._text_only(name, attributes, held)
            return len(html) if stop < 0 else stop + 1
        self._start(name, attributes)
        if name == "plaintext":
            self._text(html[at:])
            return len(html)
        return at

    def _text(self, text: str) -> None:
        if not self._body and not (text := text.lstrip(" \t\n\r\f")):
            return
        self._body = True
        if self._label is not None:
            self._label[1].append(text)
        if self._hidden is None:
            self.out.append(_shown(text))

    def _text_only(self, name: str, attributes: dict[str, str], held: str) -> None:
        """An element that holds text alone. Titles before the body are no part of it; removed ones count in labels only."""
        text = held if name in RAW else unescape(held)
        if name in REMOVED:
            if self._label is not None:
                self._label[1].append(text)
        elif name == "title" and self._body:
            self._start(name, attributes)
            self._text(text)
            self._end(name)
        elif name != "title":
            self._text(text)

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        if name in UNWRAPPED:
            self._body = self._body or name in ("body", "plaintext")
            return
        self._body = self._body or name not in ("base", "link", "meta")
        if name in ENDS_PARAGRAPH:
            self._pop({"p"}, BARRIERS | {"button"})
        if name in ENDS:
            ended, apart = ENDS[name]
            self._pop(ended, apart | (BARRIERS - ended if name not in TABLE_PARTS else {"template", "object"}))
        if name == "a":
            self._link(attributes)
        if name in VOID:
            if self._hidden is None and name not in REMOVED:
                self.out.append(self._written(name, attributes))
            return
        if len(self._open) == DEEPEST:
            self._close(DEEPEST - 1)
        self._open.append(name)
        self._counts[name] += 1
        if self._hidden is None:
            if name in REMOVED or not _FINE_NAME.fullmatch(name):
                self._hidden = len(self._open) - 1
            else:
                self.out.append(self._written(name, attributes))

    def _link(self, attributes: dict[str, str]) -> None:
        kind, href = classified(attributes.get("href"))
        if kind == "external" and href not in self.links:
            self.links[href] = []
            self._label = len(self._open), self.links[href]

    def _written(self, name: str, attributes: dict[str, str]) -> str:
        kept = {n: v for n, v in attributes.items() if _FINE_NAME.fullmatch(n) and not n.startswith("on") and n != "style" and n not in LOADING}
        if name == "a":
            kind, href = classified(attributes.get("href"))
            kept = {n: v for n, v in kept.items() if n not in OF_LINKS}
            if kind == "external":
                kept |= {"href": href, "target": "_blank", "rel": "noopener noreferrer", "referrerpolicy": "no-referrer"}
            else:
                kept |= {"href": href} if kind == "fragment" else {"aria-disabled": "true"}
        elif "href" in kept:  # areas and parts of drawings lead somewhere as well
            href = classified(kept["href"])[1]
            kept = {n: v for n, v in kept.items() if n != "href"} | ({} if href is None else {"href": href})
        return f"<{name}{''.join(f' {n}="{_shown(v, True)}"' for n, v in kept.items())}>"

    def _end(self, name: str) -> None:
        self._pop({name}, {"table", "template"} - {name} if name in TABLE_PARTS else BARRIERS - {name})

    def _pop(self, names: set[str], barriers: set[str] | frozenset[str]) -> None:
        """Close the innermost open element of these names, with all that it holds, unless a barrier stands before it."""
        if not any(self._counts[n] for n in names):
            return
        for place in range(len(self._open) - 1, -1, -1):
            if self._open[place] in names:
                self._close(place)
                return
            if self._open[place] in barriers:
                return

    def _close(self, place: int) -> None:
        while len(self._open) > place:
            name = self._open.pop()
            self._counts[name] -= 1
            if self._hidden is None:
                self.out.append(f"</{name}>")
            elif self._hidden == len(self._open):
                self._hidden = None
        if self._label is not None and self._label[0] >= place:
            self._label = None


def label_of(parts: list[str], href: str) -> str:
    """A link's text on one line, 200 UTF-16 units of it at most and no half of a sign; its address where it has none."""
    text = re.sub(r"\s+", " ", "".join(parts)).strip()
    return text.encode("utf-16-le", "replace")[: 2 * LABEL].decode("utf-16-le", "ignore") or href


def previewed(html: Column) -> Column:
    """Of each page: `safe`, its body to be shown, and `links`, the different addresses of the web that it names, with the text of
    the first link to each. Null for a null page.
    """

    @F.pandas_udf(SHAPE)
    def preview(column: pd.Series) -> pd.DataFrame:
        rows = []
        for page in column:
            made = None if page is None else Fragment(page)
            rows.append((None, None) if made is None else (made.safe, [{"href": h, "label": label_of(p, h)} for h, p in made.links.items()]))
        return pd.DataFrame(rows, columns=["safe", "links"])

    return F.when(html.isNotNull(), preview(html))


def linked(html: Column) -> Column:
    """The links of `previewed` alone: a worker holds no page made safe."""

    @F.pandas_udf("array<struct<href:string,label:string>>")
    def found(column: pd.Series) -> pd.Series:
        return column.map(lambda page: None if page is None else [{"href": h, "label": label_of(p, h)} for h, p in Fragment(page).links.items()])

    return F.when(html.isNotNull(), found(html))
