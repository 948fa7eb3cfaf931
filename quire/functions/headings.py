"""Titles of pages: from their markup, file names and navigation labels. Plain Python over one page, for use inside Arrow functions.

A page is read once into blocks (paragraphs, divisions, headings), each with
its text, place and how it is set. Candidates for its title come from rules
over blocks, in order of how sure they are.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from typing import NamedTuple

from quire.functions import grammar
from quire.functions.grammar import OPENINGS, SIDE, collapse, scan, shape_of, tidy

# Words of labels, classes and sentences.
FORBIDDEN = '\\/:*?"<>|'
BLOCKS = ["p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "dd"]
PAIRED = [*OPENINGS[:2], *OPENINGS[4:6]]
SECTIONS = [*OPENINGS[:4], "prologue", "epilogue", "interlude"]
ALONE = [*SECTIONS, *SIDE[:3], "막간", "서막", "종막"]
TITLE_CLASSES = ["chapter", "chap", "title", "header", "heading", "np", "toc"]
SURE_CLASSES = ["box-line"]
TITLE_IDS = ["sigil_toc_id", "id_top"]
NOT_IN_TOC = "sigil_not_in_toc"
SENTENCE_ENDS = ["다", "요", "니다", "였다", "한다", "했다"]
GENERIC_LABELS = ["시작", "본문", "내용", "내용 시작", "무제", "책의 시작", "표지", "목차", "차례", "start", "begin", "content", "section", "chapter", "untitled"]
FILE_NOISE = ["정상", "수정", "epub", "txt"]
CREATOR_LABELS = ["지은이", "글쓴이", "저자", "작가", "원작", "author"]
IMPRINT_WORDS = ["발행", "출판", "지은이", "저자", "isbn", "http", "e-mail", "email", "주소", "전화", "무단", "저작권", "allrights"]
BOOK_TITLE_CLASSES = ["font6", "block_4", "titlee", "title"]
CONTINUED_TO = ["다음", "다음번", "차기", "차권", "다음권", "다음화", "다음장"]
CONTINUED = ["계속", "이어집니다", "이어짐", "계속됩니다", "계속됨"]
MEET = ["만나요"]
ON = ["에", "에서", "으로", ""]
UNITS = "화장권부편절막회"
QUOTE_BULLETS = "≫▶▷▸▹►»"
LONGEST = 80


class Block(NamedTuple):
    tag: str
    start: int
    end: int
    text: str
    bold: bool
    centred: bool
    name: str  # its class
    id: str


def label_text(text: str) -> str:
    """A title as it is shown: entities decoded, in NFKC, without characters that file names forbid."""
    return collapse("".join(" " if c in FORBIDDEN else c for c in tidy(html.unescape(text).replace("_", " "))))


class _Reader(HTMLParser):
    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.markup, self.found, self.open = markup, [], []
        self.lines = [0]
        for line in markup.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.hidden = 0
        self.feed(markup)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attributes):
        known = {k: v or "" for k, v in attributes}
        style = known.get("style", "").replace(" ", "").lower()
        bold = tag in ("b", "strong") or "font-weight:bold" in style
        if tag in BLOCKS:
            centred = "text-align:center" in style or known.get("align", "").lower() == "center"
            self.open.append({"tag": tag, "start": self._at(), "text": [], "bold": [], "depth": 0, "centred": centred, "name": known.get("class", ""), "id": known.get("id", "")})
            if bold:
                self.open[-1]["depth"] = 1
        elif self.open:
            own = self.open[-1]
            if tag == "br":
                own["text"].append(" ")
            elif tag == "span" and known.get("class"):
                own["name"] += " " + known["class"]
            if tag in ("b", "strong", "span"):
                own.setdefault("marks", []).append(bold)
                own["depth"] += bold
        if tag in ("style", "script"):
            self.hidden += 1

    def handle_endtag(self, tag):
        if tag in ("style", "script"):
            self.hidden = max(0, self.hidden - 1)
        if tag in ("b", "strong", "span") and self.open and self.open[-1].get("marks"):
            self.open[-1]["depth"] -= self.open[-1]["marks"].pop()
        if tag in BLOCKS and any(x["tag"] == tag for x in self.open):
            while self.open:
                own = self.open.pop()
                end = self.markup.find(">", self._at()) + 1
                plain, bold = "".join(own["text"]), "".join(own["bold"])
                self.found.append(Block(own["tag"], own["start"], end, label_text(plain), bool(bold.strip()) and collapse(bold) == collapse(plain), own["centred"], own["name"], own["id"]))
                if own["tag"] == tag:
                    break

    def handle_data(self, data):
        if self.open and not self.hidden:
            own = self.open[-1]
            own["text"].append(data)
            if own["depth"] > 0:
                own["bold"].append(data)


def blocks(markup: str) -> list[Block]:
    return sorted(_Reader(markup or "").found, key=lambda b: (b.start, -b.end))


def is_continuation_notice(text: str) -> bool:
    """`to be continued`, alone."""
    compact = re.sub(r"\s", "", re.sub(r"<[^>]+>", "", html.unescape(text or ""))).strip("「」『』[]()（）<>〈〉-–—_*·.。…!！~")
    compact = re.sub(r"^\d{1,3}[권화장부편]", "다음", compact)
    notices = {a + b + c for a in CONTINUED_TO for b in ON for c in CONTINUED} | {a + b + c for a in ("다음", "다음권") for b in ON for c in MEET}
    return compact in notices


def without_notices(markup: str) -> tuple[str, int]:
    """Markup without blocks and lines that only say that the story goes on, and how many went."""
    spans = [(b.start, b.end) for b in blocks(markup) if is_continuation_notice(b.text)]
    out, at, gone = [], 0, 0
    for start, end in spans:
        if start >= at:
            out.append(markup[at:start])
            at, gone = end, gone + 1
    lines = ("".join(out) + markup[at:]).split("\n")
    kept = [x for x in lines if "<" in x or not x.strip() or not is_continuation_notice(x)]
    return "\n".join(kept), gone + len(lines) - len(kept)


def is_chapterish(text: str) -> bool:
    """Whether a title is of a chapter or an episode."""
    t = tidy(text)
    return bool(re.search(r"(?:^|(?<![가-힣]))\s*제?\s*\d+\s*[화장권부식]|[#＃]\s*\d+", t)) or any(w in t for w in PAIRED[:2]) or bool(re.search(r"x ?n ?e", shape_of(scan(t))))


def is_primary(text: str) -> bool:
    t = tidy(text)
    return bool(re.search(rf"(?<![가-힣])제?\s*\d+\s*[{UNITS}]", t)) or bool(re.match(r"[#＃] ?\d|(?:chapter|ch\.?) ?\d", t, re.I))


def is_decimal(text: str) -> bool:
    return bool(re.match(r"n\.n(?:$| |m)", shape_of(scan(tidy(text)))))


def is_numbered(text: str) -> bool:
    """`N. title`, short and no sentence."""
    t = tidy(text)
    return bool(re.match(r"\d{1,4}\s*[.)]\s*\S", t)) and not is_decimal(t) and not re.search(r"[.!?…]$", t) and not t.endswith(tuple(SENTENCE_ENDS)) and 2 <= len(t) <= 70 and len(t.split()) <= 8


def is_list_item(text: str) -> bool:
    """`N. words` that names no chapter."""
    t = tidy(text)
    return bool(re.match(r"\d+\s*[.)]\s*\S", t)) and not re.search(rf"\d+\s*[{UNITS}]|(?:chapter|part|ch\.?) *\d", t, re.I)


def is_noise(text: str) -> bool:
    """Whether a set-off line is no title: a notice, a quote, a bare number, a list on one line, a book's own name."""
    t = tidy(text)
    bare = re.fullmatch(r"n ?[.m]?", shape_of(scan(t)))
    return not t or is_continuation_notice(t) or t[0] in QUOTE_BULLETS or bool(bare) or bool(re.search(r"\d+\s*[.)]\s*.+\d+\s*[.)]\s*.+", t)) or bool(re.match(r"\[[^\]]+\]\s*.+\d+\s*[권화장부편]$", t))


def is_sentence(text: str) -> bool:
    """Whether a line reads like one of the body."""
    t = tidy(text)
    if not t or is_chapterish(t) and not re.match(r"\[[^\]]+\]", t) or is_numbered(t):
        return False
    if is_decimal(t) or re.match(r"\d+\s*[.)]\s*\S", t) and (t.rstrip(".!?").endswith(tuple(SENTENCE_ENDS)) or len(t) >= 16):
        return True
    if re.match(r"\[[^\]]+\]\s*.+\d+\s*권$", t):
        return True
    return len(t) >= 25 and bool(re.search("[.!?…]$", t)) and len(t.split()) >= 5


def is_subheading(text: str) -> bool:
    """Whether a heading within a page may have a place of its own in the navigation."""
    t = tidy(text)
    if not 2 <= len(t) <= 70 or is_noise(t):
        return False
    if t.lower() in SECTIONS or is_numbered(t):
        return True
    if is_sentence(t) or is_list_item(t) or re.search("[.!?…]$", t) or re.match(r"\[[^\]]+\]\s*.+\d+\s*권$", t):
        return False
    return is_chapterish(t) or t.lower() in ALONE or bool(re.fullmatch(r"(?:chapter|ch\.?|part)\s*\d+", t, re.I)) or bool(re.match(r"n(?:[.\-]n)? +[^ ]", shape_of(scan(t))))


def _is_set_off(block: Block) -> bool:
    return block.tag.startswith("h") and NOT_IN_TOC not in block.name or block.bold and block.tag in ("p", "div")


def subheadings(markup: str) -> list[tuple[str, int, int]]:
    """Title, start and end of each heading within a page, in order: set off, and no noise. A prologue's name joins the one after it; where chapters have numbers, only those and sections count."""
    found = [(b.text, b.start, b.end) for b in blocks(markup) if _is_set_off(b) and 1 < len(b.text) < LONGEST and not is_noise(b.text)]
    # a block within another that says the same is one heading
    found = [x for i, x in enumerate(found) if not any(y[1] < x[1] and x[2] <= y[2] for y in found[:i])]
    merged, i = [], 0
    while i < len(found):
        title, start, end = found[i]
        after = found[i + 1] if i + 1 < len(found) else None
        if after and title.lower() in PAIRED and not is_primary(after[0]):
            title, end, i = f"{title} - {after[0]}", after[2], i + 1
        merged.append((title, start, end))
        i += 1
    if any(is_primary(t) for t, *_ in merged):
        merged = [x for x in merged if is_primary(x[0]) or x[0].lower() in SECTIONS]
    return merged


def anchored(markup: str, found: list[tuple[str, int, int]], prefix: str = "sub") -> tuple[str, list[tuple[str, str]]]:
    """Markup with an anchor before each heading, and the anchors' ids and titles."""
    out, at, ids = [], 0, []
    for k, (title, start, _) in enumerate(found, 1):
        ids.append((f"{prefix}_{k:03d}", title))
        out += [markup[at:start], f'<a id="{ids[-1][0]}"></a>']
        at = start
    return "".join(out) + markup[at:], ids


def _is_mark(text: str) -> bool:
    return len(text) <= 12 and bool(re.fullmatch(rf"제?\s*\d+\s*[{UNITS}]|[#＃]\s*\d+\s*화?", text) or text in ALONE)


def _marked_pair(found: list[Block]) -> str:
    """A bare mark and, in a paragraph set like it soon after, its title."""
    own = [b for b in found if b.tag == "p"]
    for i, b in enumerate(own):
        after = next((x for x in own[i + 1 : i + 4] if x.text), None)
        if _is_mark(b.text) and after and 2 <= len(after.text) <= 60 and not _is_mark(after.text) and not re.search('[.!?"”’]$', after.text):
            if b.centred and after.centred or b.name and b.name.lower() == after.name.lower():
                return f"{b.text}. {after.text}"
    return ""


def _opening_pair(found: list[Block]) -> str:
    own = [b for b in found if b.tag == "p" and b.text]
    for b, after in zip(own, own[1:], strict=False):
        if b.bold and after.bold and b.text.lower() in PAIRED and len(after.text) <= 60:
            return b.text if after.text.lower() == b.text.lower() else f"{b.text} - {after.text}"
    return ""


def _fits(text: str) -> bool:
    return 1 < len(text) < LONGEST and not is_sentence(text) and (not is_list_item(text) or is_numbered(text))


def page_title(markup: str) -> str | None:
    """The title of a page's chapter; None if it names none."""
    found = blocks(markup)
    for pair in (_marked_pair(found), _opening_pair(found)):
        if len(pair) > 2 and _fits(pair):
            return pair
    strong = lambda t: bool(re.search(r"\d+\s*[화권부]|^[#＃] ?\d", t)) or is_primary(t) or is_numbered(t)
    set_off = [t for t, *_ in subheadings(markup)]
    for text in [*set_off, *(b.text for b in found if b.centred and b.bold)]:
        if strong(text) and _fits(text):
            return text
    bold = [b.text for b in found if b.bold and not is_noise(b.text) and 1 < len(b.text) < LONGEST]
    named = lambda b, words: any(re.search(rf"(?:^|[\s_\-]){w}", b.name.lower()) for w in words)
    tiers = [
        [b.text for b in found if any(b.id.startswith(x) for x in TITLE_IDS[:1])],
        [b.text for b in found if b.tag.startswith("h") and NOT_IN_TOC not in b.name],
        [b.text for b in found if any(x in b.name for x in SURE_CLASSES) or b.id in TITLE_IDS],
        [b.text for b in found if named(b, TITLE_CLASSES)],
        [b.text for b in found if b.tag == "p" and (re.match(rf"제?\s*\d+(?:[-~]\d+)?\s*[{UNITS}]|[#＃] ?\d", b.text) or b.text in ALONE)],
        [b.text for b in found if b.tag == "p" and re.match(r"n ?[pv]? ?[.\-] ?[^ ]", shape_of(scan(b.text))) and len(b.text) <= 46],
        bold,
    ]
    for text in (t for tier in tiers for t in tier):
        if not is_noise(text) and _fits(text):
            return text
    whole = label_text(re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(style|head)\b.*?</\1>", "", markup or "")))
    return whole if 1 < len(whole) < 60 and not is_noise(whole) and _fits(whole) and not is_sentence(whole) else None


def file_label(name: str) -> str:
    """A label from a file's name: without its place in a list, an author in underscores and notes of its source."""
    stem = re.sub(r"(?<=.)\.[A-Za-z0-9]{1,5}$", "", re.split(r"[\\/]", name or "")[-1])
    text = "".join(c for c in stem if not 0x02B0 <= ord(c) <= 0x02FF and not 0x2070 <= ord(c) <= 0x209F and not 0x1D2C <= ord(c) <= 0x1D7F and c not in "︎️​")
    text = re.sub(r"^\s*\[\s*\d{1,5}\s*\]\s*", "", text.replace("_", " "))
    if not text.lstrip().startswith("["):
        text = re.sub(r"^\s*\S{1,6}\s{2,}", "", text)
        text = re.sub(r"\s*\[[^\]]{1,4}\]\s*", " ", text)
    words = text.split()
    while words and words[-1].lower() in FILE_NOISE:
        words.pop()
    return " ".join(words).rstrip(" .")


def _numbered_part(text: str) -> tuple[int | None, str]:
    """The episode of a label, and what comes after its number."""
    text = re.sub(r"^\s*\[\s*\d{1,5}\s*\]\s*", "", tidy(text))
    found = re.search(r"(?<!\d)(\d{1,5})\s*화", text)
    return (int(found[1]), text[found.end() :]) if found else (None, text)


def episode(text: str) -> int | None:
    return _numbered_part(text)[0]


def subtitle_size(text: str) -> int:
    """How much a label says after its episode."""
    return len(re.sub(r"\s", "", _numbered_part(text)[1].lstrip(" ._·:：-–—")))


def is_structured(label: str) -> bool:
    """`N화`, a mark, and a title."""
    number, rest = _numbered_part(label)
    return number is not None and bool(re.match(r"\s*[.:：,，\-–—]\s*\S", rest))


def are_consistent(labels: list[str]) -> bool:
    """Whether most file labels of a book are structured episodes."""
    known = [x for x in labels if x and x.strip()]
    return len(known) >= 5 and sum(map(is_structured, known)) >= max(3, int(len(known) * 0.6)) and sum(episode(x) is not None for x in known) >= max(4, int(len(known) * 0.75))


def is_generic_label(label: str) -> bool:
    """Whether a navigation label says nothing but a number, or that something begins."""
    text = (label or "").strip()
    shape = shape_of(scan(text)).replace(" ", "")
    return text.lower() in GENERIC_LABELS or bool(re.fullmatch(r"#?n|n\.|w?n[evp][.\-]?|n[evp]?", shape)) and ("w" not in shape or text[0] == "제") or bool(re.fullmatch(r"\d+\s*[.)]|chapter\s*\d*|제?\s*\d+\s*[화권]\s*_", text, re.I))


def _is_telling(label: str) -> bool:
    text = tidy(label)
    return len(text) > 1 and not re.fullmatch(r"\d+\s*[권화부]?", text) and bool(re.search("[A-Za-z가-힣]", text))


def choose_title(file_name: str, title: str | None, force: bool = False) -> str:
    """Of a file's label and a page's title, the one that says more: the file's where the numbers differ, or it is as full."""
    label, title = file_label(file_name), tidy(title)
    if not label or not title:
        return label or title
    if not _is_telling(label):
        return title
    own, other = episode(label), episode(title)
    if force:
        return label
    if own is None:
        return label if is_generic_label(title) else title
    same = other == own
    fuller = is_generic_label(title) or subtitle_size(label) >= subtitle_size(title) or is_structured(label)
    return title if same and not fuller else label


def clean_label(title: str, series: str = "") -> str:
    """A chapter's title in a merged book: `N화` for its forms, without the series' name and doubled numbers."""
    text = collapse(title or "")
    number = re.match(r"#\s*(\d+)\s*[.)]?\s*|제?\s*(\d+)\s*화(?:\s*#\s*\2\s*[.)]?)?(?![가-힣])\s*", text)
    if number and number.end():
        text = f"{number[1] or number[2]}화" + (" " if text[number.end() - 1 : number.end()] in (" ", ".", ")") and text[number.end() :] else "") + text[number.end() :]
    name = grammar.tagged(re.sub(r"(?i)\.epub$", "", series or "").strip())[1]
    name = grammar.without_tail(re.sub(r"\+.*$", "", name), r" n(?: ?[-~] ?n)?(?: ?[vep])?")
    if len(name) >= 3:
        rest = grammar.tagged(text)[1]
        text = rest[len(name) :].strip() if rest.startswith(name) else rest
    doubled = re.match(r"(\d+화)\s+\1(?![가-힣])", text)
    return collapse(text[doubled.end(1) :] if doubled else text)


def merged_title(markup: str, file_name: str = "", labels: dict[str, str] | None = None, book: str = "", series: str = "", override: str | None = None) -> str:
    """A page's title in a merged book: the user's, else its label in the navigation, else its own; a generic label gives way."""
    if override is not None:
        return clean_label(re.sub(r"\s*\(연재중?\)\s*", "", override).strip(), series)
    own = page_title(markup) or ""
    own = "" if is_continuation_notice(own) else own
    if not labels:
        chosen = own
    else:
        label = (labels.get(re.split(r"[\\/]", file_name)[-1].lower()) or "").strip()
        if not label:
            chosen = own if is_chapterish(own) else ""
        elif is_generic_label(label):
            chosen = book if book and not is_generic_label(book) and is_chapterish(book) else own or (label if is_chapterish(label) else "")
        else:
            chosen = own if own and is_chapterish(own) and not is_chapterish(label) else label
    if not chosen or is_continuation_notice(chosen):
        return ""
    return clean_label(re.sub(r"\s*\(연재중?\)\s*", "", chosen).strip(), series)


def duplicate_key(title: str) -> str:
    """What labels that say the same have in common."""
    text = grammar.tagged(collapse(title).lstrip("# "))[1]
    return collapse(re.sub("[.。．]", " ", text)).lower()


def _lines(markup: str) -> list[str]:
    return [b.text if b.text else "" for b in blocks(markup)] or [collapse(x) for x in re.sub(r"<[^>]+>", "\n", html.unescape(markup or "")).split("\n")]


def creator_of(markup: str) -> str:
    """The author that an imprint names: after a label, or a copyright sign."""
    for line in _lines(re.sub(r"[|｜￨]", "｜", markup)):
        said = re.match(r"\s*([가-힣A-Za-z ]{2,8}?)\s*[:：｜ ]\s*(.+)$", line)
        label = re.sub(r"\s", "", said[1]).lower() if said else ""
        name = re.split(r"[|｜:：]", said[2])[0].strip(" .,;") if said and label in CREATOR_LABELS else ""
        signed = re.search(r"[©ⓒ]\s*([A-Za-z가-힣][^\d,]{1,24}?)\s*,?\s*\d{4}", line)
        name = name or (signed[1].strip() if signed else "")
        if 1 < len(name) <= 20 and re.search("[A-Za-z가-힣]", name) and not any(w in name.lower() for w in IMPRINT_WORDS if w not in ("지은이", "저자")) and not re.search(r"\d{2}", name):
            return name
    return ""


def book_title_of(markup: str) -> str:
    """The title that an imprint shows: in a paragraph of a title's class, else in a large heading."""
    found = blocks(markup)
    tiers = [[b for b in found if b.tag == "p" and any(re.search(rf"(?:^|\s){c}", b.name.lower()) for c in BOOK_TITLE_CLASSES)], [b for b in found if b.tag in ("h1", "h2", "h3")]]
    for b in (b for tier in tiers for b in tier):
        compact = re.sub(r"\s", "", b.text).lower()
        if 2 < len(b.text) < 60 and re.search("[가-힣]{2}", b.text) and not any(w in compact for w in IMPRINT_WORDS) and not re.search(r"\d{3}", b.text) and not re.match(r"\d+\s*[화권편]|[#＃]\s*\d", b.text):
            return b.text
    return ""


def is_volume_heading(text: str) -> bool:
    """`Series N권` and nothing else."""
    t = collapse(re.sub(r"\(연재중?\)", "", tidy(text)))
    found = grammar.numbered(t, ("volume",))
    return bool(found and not found.part and 1 <= len(found.series) <= 46 and re.match("[가-힣A-Za-z]", t) and "v" in shape_of(scan(t)) and t.endswith("권") and not re.search(r"n ?[eq]|# ?n", shape_of(scan(found.series))) and not any(w in t for w in OPENINGS[:4]))


def volume_heading(pages: list[str]) -> str:
    """The first `Series N권` among the headings of a book's first pages."""
    for markup in pages:
        for b in blocks(markup):
            if (b.tag.startswith("h") or "title" in b.name.lower()) and is_volume_heading(b.text):
                found = grammar.numbered(b.text, ("volume",))
                return f"{found.series} {found.volume}"
    return ""


def series_title(title: str) -> str:
    """A book's title without episode, volume, part, side story, brackets and numbers: its series."""
    text = tidy(html.unescape(title or "").replace("_", " "))
    text = grammar.tagged(text)[1]
    text = re.sub(r"^제?\s*\d+\s*화\s*[._]?\s*|^[#＃]\s*\d+\s*", "", text)
    tokens = scan(text)
    shape, goes = shape_of(tokens), set()
    for found in re.finditer(r"(?:(?<![a-zA-Z])w ?)?n(?: ?[-~] ?n)? ?[vep]|[A-Z]", shape):
        if shape[found.start()] != "w" or tokens[found.start()].text == "제":
            goes |= set(range(*found.span()))
        else:
            goes |= set(range(shape.index("n", found.start()), found.end()))
    text = collapse("".join(" " if i in goes else t.text for i, t in enumerate(tokens)))
    return grammar.without_tail(text, r"(?: ?-)? ?x ?n?| n| ?-").strip(" .-·")


def folder_series(path: str) -> str:
    """A series from the name of the folder that a file lies in."""
    parts = [x for x in re.split(r"[\\/]", path or "") if x]
    text = re.sub(r"[_\s-]\d{9,}$", "", tidy(parts[-2])) if len(parts) > 1 else ""
    return grammar.without_tail(text, r" ?[A-Z]| ?f| n ?[-~] ?n").strip(" _-")


def tail_unit(pages: list[str], labels: list[str], number: int, serial: bool = False) -> str:
    """Whether the number at the end of a book's name is of a volume (권) or an episode (화): a book with two chapters or more is a volume."""
    chapters = sum(bool(re.search(r"\d+\s*[화장편회]", tidy(x))) for x in labels)
    titles = [page_title(x) or "" for x in pages]
    chapters = max(chapters, sum(bool(re.search(r"\d+\s*[화장편회]", t)) or t in OPENINGS[:4] for t in titles))
    if not serial and chapters >= 2:
        return "권"
    text = [re.sub(r"<[^>]+>", "", x) for x in pages]
    said = any(re.search(rf"(?<!\d){number}\s*화", x) for x in text) or any(episode(t) == number for t in titles)
    return "화" if said and (serial or any("연재" in x for x in text) or chapters == 1) else "권"
