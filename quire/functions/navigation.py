"""Packages and navigation of merged books as documents. Plain Python over one book, for use inside Arrow functions."""

from __future__ import annotations

import re
from typing import NamedTuple
from xml.etree import ElementTree as ET

from quire.functions import grammar
from quire.functions.grammar import scan, shape_of, tidy

# Names and forms that readers of the formats expect.
OPF, DC, NCX = "http://www.idpf.org/2007/opf", "http://purl.org/dc/elements/1.1/", "http://www.daisy.org/z3986/2005/ncx/"
NCX_TYPE, PAGE_TYPE = "application/x-dtbncx+xml", "application/xhtml+xml"
MEDIA_TYPES = {".xhtml": PAGE_TYPE, ".html": PAGE_TYPE, ".htm": PAGE_TYPE, ".css": "text/css", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".svg": "image/svg+xml", ".ncx": NCX_TYPE, ".ttf": "font/ttf", ".otf": "font/otf"}
COVER, LANGUAGE, CONTENTS = "cover-image", "ko", "목차"
XHTML_HEAD = '<?xml version="1.0" encoding="utf-8"?><!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN" "http://www.w3.org/TR/xhtml11/DTD/xhtml11.dtd">'
STYLE = "body{{font-family:sans-serif;padding:2em;background:{bg};color:{text}}}h1{{font-size:1.3em;color:{accent};margin-bottom:1em}}ol{{padding-left:1.5em}}li{{margin:.5em 0}}ul{{padding-left:1.5em;list-style:disc}}a{{color:{accent};text-decoration:none}}a:hover{{text-decoration:underline}}"


class Entry(NamedTuple):
    """A point of the navigation; order is its place in reading order."""

    id: str
    label: str
    src: str
    order: int
    children: tuple = ()


class Item(NamedTuple):
    id: str
    href: str
    media_type: str


def media_type(name: str) -> str:
    return MEDIA_TYPES.get("." + name.rsplit(".", 1)[-1].lower(), "application/octet-stream")


def safe_id(text: str) -> str:
    """An id that XML allows."""
    return re.sub(r"[^A-Za-z0-9_.\-]", "_", text)


def _document(root: ET.Element) -> str:
    ET.indent(root, "    ")
    return '<?xml version="1.0" encoding="utf-8"?>\n' + ET.tostring(root, encoding="unicode")


def _element(parent: ET.Element, tag: str, text: str | None = None, **attributes: str) -> ET.Element:
    own = ET.SubElement(parent, tag, {k.rstrip("_").replace("_", "-"): v for k, v in attributes.items()})
    own.text = text
    return own


def series_of(title: str) -> str:
    """A title without a range or number of volumes at its end."""
    return grammar.without_tail(title or "", r" ?n ?[-~] ?n(?: ?[vep])?| ?n ?[vep]")


def creator_of(title: str, stem: str = "") -> str:
    """The author in brackets in front of a title, else between underscores in front of a file's name."""
    signed = re.match(r"_([^_]{1,10})__", stem)
    return grammar.tagged(title + " .")[0] if title.startswith("[") else signed[1] if signed else ""


def package(title: str, uid: str, items: list[Item], spine: list[str], creator: str = "", publisher: str = "", language: str = LANGUAGE) -> str:
    """An OPF package document; an item with the id of a cover is its cover."""
    root = ET.Element("package", {"xmlns": OPF, "version": "2.0", "unique-identifier": "uuid_id"})
    meta = _element(root, "metadata")
    meta.set("xmlns:dc", DC)
    for name, value in (("title", title), ("creator", creator), ("publisher", publisher), ("language", language or LANGUAGE)):
        if value or name == "title":
            _element(meta, f"dc:{name}", value)
    _element(meta, "dc:identifier", uid, id="uuid_id")
    covered = any(x.id == COVER for x in items)
    if covered:
        _element(meta, "meta", name="cover", content=COVER)
    if series_of(title):
        _element(meta, "meta", name="calibre:series", content=series_of(title))
        _element(meta, "meta", name="calibre:series_index", content="1")
    manifest = _element(root, "manifest")
    _element(manifest, "item", id="ncx", href="toc.ncx", media_type=NCX_TYPE)
    for x in items:
        _element(manifest, "item", id=safe_id(x.id), href=x.href, media_type=x.media_type)
    order = _element(root, "spine", toc="ncx")
    for x in spine:
        _element(order, "itemref", idref=safe_id(x))
    if covered:
        _element(_element(root, "guide"), "reference", type="cover", title="Cover", href=next(x.href for x in items if x.id == COVER))
    return _document(root)


def _point(parent: ET.Element, entry: Entry) -> None:
    own = _element(parent, "navPoint", id=entry.id, playOrder=str(entry.order))
    _element(_element(own, "navLabel"), "text", entry.label)
    _element(own, "content", src=entry.src)
    for child in entry.children:
        _point(own, child)


def navigation(title: str, uid: str, entries: list[Entry], depth: int = 2) -> str:
    """An NCX document with nested points."""
    root = ET.Element("ncx", {"xmlns": NCX, "version": "2005-1"})
    head = _element(root, "head")
    for name, content in (("uid", uid), ("depth", str(depth)), ("totalPageCount", "0"), ("maxPageNumber", "0")):
        _element(head, "meta", name=f"dtb:{name}", content=content)
    _element(_element(root, "docTitle"), "text", title)
    points = _element(root, "navMap")
    for entry in entries:
        _point(points, entry)
    return _document(root)


def _link(parent: ET.Element, entry: Entry) -> None:
    own = _element(parent, "li")
    _element(own, "a", entry.label, href=entry.src)
    if entry.children:
        inner = _element(own, "ul")
        for child in entry.children:
            _link(inner, child)


def contents_page(entries: list[Entry], bg: str = "#f4f6fb", text: str = "#1a2035", accent: str = "#2272d8") -> str:
    """A page that links to all points."""
    root = ET.Element("html", {"xmlns": "http://www.w3.org/1999/xhtml"})
    head = _element(root, "head")
    _element(head, "title", CONTENTS)
    _element(head, "style", STYLE.format(bg=bg, text=text, accent=accent))
    body = _element(root, "body")
    _element(body, "h1", f"📚 {CONTENTS}")
    links = _element(body, "ol")
    for entry in entries:
        _link(links, entry)
    return XHTML_HEAD + ET.tostring(root, encoding="unicode", short_empty_elements=False)


def volume_label(volume: int, sample: str) -> str:
    """A label for a volume, from one of its chapters' labels: without the episode, with the volume."""
    tokens = scan(tidy(sample))
    at = re.search(r"(?:w ?)?n ?e", shape_of(tokens))
    at = at if not at or shape_of(tokens)[at.start()] == "n" or tokens[at.start()].text == "제" else re.search(r"n ?e", shape_of(tokens))
    label = tidy(sample)[: tokens[at.start()].start].strip() if at else tidy(sample)
    if re.search(rf"(?<!\d){volume}\s*권", label):
        return label
    return f"{grammar.without_tail(label, ' ?n ?v')} {volume}권".strip()


def flat_label(label: str, chapter: int | None) -> str:
    """A label with the chapter of its file's name, if it has none."""
    return f"{label} {chapter}화".strip() if chapter is not None and not re.search(r"\d+\s*화", label or "") else label


def volume_entries(loose: list[tuple[str, str]], volumes: dict[int, list[tuple[int, str, str]]], order: int = 1, book: int = 0) -> list[Entry]:
    """Points of loose pages (label, src), then of each volume with its chapters (chapter, label, src) by number."""
    out = []

    def entry(label: str, src: str, children=None) -> Entry:
        nonlocal order, book
        book, place = book + 1, order
        order += 1
        name = f"book{book:03d}"
        return Entry(name, label, src, place, tuple(entry(f"{n}화", s) for n, _, s in children or ()))

    out += [entry(label, src) for label, src in loose]
    for volume in sorted(volumes):
        own = sorted(volumes[volume], key=lambda x: x[0])
        if own:
            out.append(entry(volume_label(volume, own[0][1]), own[0][2], own))
    return out


def book_entry(label: str, src: str, pages: list[tuple[str, str, str]], book: int, order: int = 1) -> Entry:
    """A point for one of several books, with its titled pages (id, src, title) below."""
    titled = [(i, s, t) for i, s, t in pages if t]
    return Entry(f"book{book:03d}", label, src, order, tuple(Entry(f"book{book:03d}_{i}", t, s, order + k) for k, (i, s, t) in enumerate(titled, 1)))
