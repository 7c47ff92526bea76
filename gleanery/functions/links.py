"""Where a link of a text may lead: to a place in the text, to the web, or nowhere."""

from __future__ import annotations

import re

DEFAULT_PORTS = {"http": "80", "https": "443"}
_WEB = re.compile(r"(?is)(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?")
# What addresses write as percent signs and hexadecimal digits in a path, a query and a fragment, beside controls and whatever is not ASCII
IN_PATH, IN_QUERY, IN_FRAGMENT, IN_USER = ' "#<>?^`{}', " \"#<>'", ' "<>`', " \"#<>?^`{}/:;=@[\\]|"
NO_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")


def _escaped(text: str, signs: str) -> str:
    return "".join(c if " " <= c <= "~" and c not in signs else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _path(path: str) -> str:
    made: list[str] = []
    parts = path.replace("\\", "/").split("/")[1:] or [""]
    for place, part in enumerate(parts):
        plain = re.sub("(?i)%2e", ".", part)
        if plain == "..":
            del made[-1:]
        elif plain != ".":
            made.append(_escaped(part, IN_PATH))
            continue
        if place == len(parts) - 1:
            made.append("")
    return "/" + "/".join(made)


def web_address(text: str) -> str | None:
    """The one spelling of an address of the web; None for what is none.

    Schema and host are small letters, other letters in a host are Punycode, the usual port goes, dot parts of the path are
    resolved. Hosts that are numbers stay as written; those with brackets (IPv6) are kept if they hold digits, colons and points.
    """
    clean = re.sub("[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    found = _WEB.fullmatch(clean)
    if found is None:
        return None
    scheme, authority, path, query, fragment = found[1].lower(), found[2], found[3], found[4], found[5]
    user, at, place = authority.rpartition("@")
    split = re.fullmatch(r"(\[[0-9A-Fa-f:.]+\]|[^:\[\]]*)(?::([0-9]*))?", place)
    if split is None or not split[1] or split[2] and int(split[2][-9:]) > 65535:
        return None
    host, port = split[1].lower(), str(int(split[2])) if split[2] else ""
    if not host.startswith("["):
        if not host.isascii():
            try:
                host = host.encode("idna").decode()
            except UnicodeError:
                return None
        if NO_HOST.search(host):
            return None
    name, colon, word = user.partition(":")
    user = _escaped(name, IN_USER) + (":" + _escaped(word, IN_USER) if word else "")
    port = "" if port == DEFAULT_PORTS[scheme] else port
    tail = (_escaped(query, IN_QUERY) if query else "") + ("#" + _escaped(fragment[1:], IN_FRAGMENT) if fragment else "")
    return f"{scheme}://{user + '@' if user else ''}{host}{':' + port if port else ''}{_path(path)}{tail}"


def classified(href: str | None) -> tuple[str, str | None]:
    """`fragment`, `external` or `blocked`, and where a link leads. Relative links are blocked: there is nothing they are relative to."""
    value = (href or "").strip()
    if re.fullmatch(r"#\S*", value):
        return "fragment", value
    address = web_address(value)
    return ("external", address) if address is not None else ("blocked", None)
