"""Names and titles as tokens, and the shapes that their tokens make.

A text becomes tokens: numbers, words, blanks, marks and parts in brackets. A
letter for each token makes the text's shape, and a form is a pattern over
shapes, never over the text: `n ?v$` is a number and a volume unit at the end,
whatever number, blanks or script. Words get their letter from a vocabulary.
Plain Python, for use inside Arrow functions.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from typing import NamedTuple

# The vocabulary.
UNITS = {"권": "v", "화": "e", "장": "e", "회": "e", "부": "p", "편": "q"}
SIDE = ["외전", "번외", "특전", "특별외전", "특별편", "후일담"]
DONE = ["완결", "완", "完"]
UNDONE = ["미완", "미완결", "연중", "중단", "incomplete"]
BODY = ["본문", "본편"]
EDITIONS = ["개정판", "신장판", "증보판", "개정증보판", "완전판", "외전증보판"]
COLLECTIONS = ["단편집", "단편선", "작품집"]
ROLES = ["저", "역", "글", "지음", "지은이"]
GENERIC = ["책의 시작", "책의 끝", "목차", "차례", "저자 소개", "작가의 말", "판권", "copyright", "contents", "content", "table of contents", "start", "begin", "beginning", "end"]
OPENINGS = ["프롤로그", "에필로그", "서장", "종장", "prologue", "epilogue", "interlude"]
CHAPTER_WORDS = ["chapter", "ch"]
SECTION_WORDS = ["section", "chapter", "content", "body", "front", "text", "xhtml", "page"]
EXTENSIONS = ["txt", "epub", "zip", "pdf", "rar", "7z"]
BRACKETS = {"[": "]", "(": ")", "（": "）", "【": "】", "{": "}"}
#: Letters: n number, v volume, e episode, p part, q other unit, x side story, f finished, u unfinished, t body, w other word,
#: blank, - dash, ~ tilde, : colon, . dot, , comma, @ and m other marks;
#: in brackets F finished, U unfinished, X side story, P part, N number, S source mark, B anything else.
_MARKS = {"-": "-", "–": "-", "—": "-", "~": "~", ":": ":", "：": ":", ".": ".", "．": ".", "。": ".", ",": ",", "，": ",", "@": "@", "#": "#", "＃": "#"}
_PIECE = re.compile(r"\d+|[가-힣]+|[A-Za-z]+|[^\W\d_]|[\s_]+|.", re.DOTALL)
_WORDS = {**dict.fromkeys(SIDE, "x"), **dict.fromkeys(DONE, "f"), **dict.fromkeys(UNDONE, "u"), **dict.fromkeys(BODY, "t")}


class Token(NamedTuple):
    letter: str
    text: str
    start: int
    end: int


def _bracketed(inner: str) -> str:
    shape = shape_of(scan(inner)).replace(" ", "")
    if re.search("u", shape) or "연중" in inner:
        return "U"
    if re.fullmatch("xn?", shape):
        return "X"
    if shape == "np":
        return "P"
    if shape == "n":
        return "N"
    if inner in ("N", "n"):
        return "S"
    return "F" if shape == "f" or re.search("f$", shape) else "B"


@functools.lru_cache(1 << 13)
def scan(text: str) -> tuple[Token, ...]:
    out: list[Token] = []
    at = 0
    while at < len(text):
        close = BRACKETS.get(text[at])
        end = text.find(close, at + 1) if close else -1
        if end > 0 and text[at] not in text[at + 1 : end]:
            out.append(Token(_bracketed(text[at + 1 : end].strip()), text[at : end + 1], at, end + 1))
            at = end + 1
            continue
        piece = _PIECE.match(text, at)[0]
        if piece[0].isdigit():
            out.append(Token("n", piece, at, at + len(piece)))
        elif piece.isspace() or piece[0] in "_ \t\n":
            out.append(Token(" ", piece, at, at + len(piece)))
        elif piece[0].isalpha():
            out += _word(piece, at, [t.letter for t in out[-2:]])
        else:
            out.append(Token(_MARKS.get(piece, "m"), piece, at, at + len(piece)))
        at += len(piece)
    return tuple(out)


def _word(piece: str, at: int, before: list[str]) -> list[Token]:
    """A word; after a number, a unit at its start is a token of its own if the rest is known or nothing."""
    numbered = before[-1:] == ["n"] or before == ["n", " "]
    if numbered and piece[0] in UNITS and (len(piece) == 1 or piece[1:] in _WORDS):
        rest = [Token(_WORDS[piece[1:]], piece[1:], at + 1, at + len(piece))] if len(piece) > 1 else []
        return [Token(UNITS[piece[0]], piece[0], at, at + 1), *rest]
    return [Token(_WORDS.get(piece.lower(), "w"), piece, at, at + len(piece))]


def shape_of(tokens: tuple[Token, ...]) -> str:
    return "".join(t.letter for t in tokens)


def collapse(text: str) -> str:
    return " ".join(text.split())


def tidy(text: str | None) -> str:
    return collapse(unicodedata.normalize("NFKC", text or ""))


class Name(NamedTuple):
    """What a text says before its numbering, and the numbering."""

    series: str
    volume: str = ""
    part: str = ""
    episode: str = ""
    suffix: str = ""


_FORMS = [
    # number of the volume, of the part, what else
    ("volume", re.compile(r"(n) ?v[ \-]+(n)$")),
    ("marked", re.compile(r"(n) ?v ?([xfXFP]|n ?p|x ?x)$")),
    ("volume", re.compile(r"(n) ?v$")),
    ("subtitle", re.compile(r" (n) ?:(.+)$")),
    ("range", re.compile(r" (n) ?[-~] ?(n) ?e?[ fF]*$")),
    ("dashed", re.compile(r" (n) ?- ?(n)$")),
    ("joined", re.compile(r"(?<=w)(n)t$")),
    ("plain", re.compile(r" (n)$")),
]


def _series(text: str) -> str:
    """Without a number at its end; dashes between Hangul as blanks."""
    tokens = scan(collapse(text))
    cut = re.search(r" n$", shape_of(tokens))
    text = collapse(text)[: tokens[cut.start()].start] if cut else collapse(text)
    return collapse(re.sub(r"(?<=[가-힣]) ?[-–—] ?(?=[가-힣])", " ", text))


def numbered(text: str, forms: tuple[str, ...]) -> Name | None:
    """The first of the named forms that the end of a text has."""
    text = collapse(text)
    tokens = scan(text)
    shape = shape_of(tokens)
    for kind, form in _FORMS:
        found = form.search(shape) if kind in forms else None
        if not found or found.start() == 0:
            continue
        number = [int(tokens[found.start(k)].text) for k in range(1, (form.groups or 0) + 1) if tokens[found.start(k)].letter == "n"]
        lead = text[: tokens[found.start()].start]
        if kind in ("subtitle", "dashed", "plain") and any(n > 999 for n in number):
            continue
        if kind == "joined" and len(tokens[found.start() - 1].text) < 2:
            continue
        if kind == "range":
            if number[1] - number[0] < 10:
                continue
            return Name(collapse(lead), episode=f"{number[0]}-{number[1]}")
        volume = f"{number[0]}권"
        if kind == "subtitle":
            return Name(_series(lead), volume, suffix=collapse(text[tokens[found.start(2)].start :]))
        if kind == "marked":
            said = re.sub(r"[\s\W]", "", text[tokens[found.start(2)].start :])
            return Name(_series(lead), volume, suffix=said if said in SIDE[:4] else "")
        return Name(_series(lead), volume, str(number[1]) if len(number) > 1 else "")
    return None


def without_tail(text: str, tail: str) -> str:
    """Without what the end of its shape has, as often as it has it."""
    text = collapse(text)
    while True:
        tokens = scan(text)
        found = re.search(f"(?:{tail})$", shape_of(tokens))
        if not found or found.start() == found.end():
            return text
        text = text[: tokens[found.start()].start].rstrip()


def without_noise(text: str) -> str:
    """Without source marks and states at the end."""
    return without_tail(text, r" ?[SF]| f")


def tagged(text: str) -> tuple[str, str]:
    """What a bracket in front says, and the rest."""
    text = collapse(text)
    end = text.find("]")
    if text.startswith("[") and end > 1 and text[end + 1 :].strip():
        return collapse(text[1:end]), text[end + 1 :].strip()
    return "", text


def without_author(title: str, author: str) -> str:
    """Without the author's name in front, if something sets it apart."""
    rest = title[len(author) :]
    if author and title.lower().startswith(author.lower()) and rest[:1] and rest[0] in " _-–—:：":
        return rest.lstrip(" _-–—:：")
    return title


def displayed(title: str, author: str) -> str:
    """For display: no author in front, blanks for underscores, a hyphen in ranges."""
    title = collapse(title)
    if author.lower() not in ("", "unknown", "미상"):
        title = without_author(title, author)
    tokens = scan(title)
    shape, out = shape_of(tokens), [t.text for t in tokens]
    for found in re.finditer(r"(?<!n)n( ?[~\-] ?| )n(?!n)", shape):
        a, b = found.span(1)
        if any(c in "~-" or "_" in tokens[i].text for i, c in enumerate(shape[a:b], a)) and all(len(tokens[i].text) <= 5 for i in (found.start(), b)):
            out[a:b] = ["-"] + [""] * (b - a - 1)
    return collapse("".join(out).replace("_", " "))


def is_chapter_heading(text: str) -> bool:
    """Whether a heading names a chapter, not a book."""
    text = collapse(text)
    tokens = scan(text)
    shape = shape_of(tokens)
    opening = tokens[0].text.lower() if tokens else ""
    return bool(
        re.match(r"n(?:\.n)* ?\. ?[^ ]", shape)
        or re.search(r"第 ?\d+ ?[章節篇]", text)
        or re.match(r"(?:w )?(?:w ?)?n ?[epq](?![nw])", shape) and (shape[0] == "n" or opening in ("제", "시작"))
        or re.match(r"(?:w )?n ?v(?![nw])", shape) and (shape[0] == "n" or opening in ("제", "시작"))
        or re.match(r"#? ?n ?[.m] ?[^ ]", shape) and re.match(r"#?\s*\d{1,5}\s*[.)]", text)
        or opening in (*OPENINGS[4:], *CHAPTER_WORDS)
    )


def is_generic(text: str) -> bool:
    return collapse(text).lower().replace(" ", "") in {x.replace(" ", "") for x in GENERIC}


def best_heading(headings: list[str]) -> str:
    """The first that names something, and not a chapter."""
    for text in map(tidy, headings):
        if re.search(r"\w", text) and not is_generic(text) and not is_chapter_heading(text):
            return text
    return ""


def has_unit(text: str) -> bool:
    return bool(re.search(r"n ?[vepq](?![nw])", shape_of(scan(text))))


def with_editions(text: str, original: str) -> str:
    """With the edition marks of the original that it lacks."""
    found = [t.text.strip("[]()") for t in scan(original) if t.letter == "B" and t.text.strip("[]()") in EDITIONS]
    found += [t.text for t in scan(original) if t.letter == "w" and t.text in EDITIONS]
    return collapse(" ".join([text, *(f"[{x}]" for x in dict.fromkeys(found) if x not in text)]))


def is_side(text: str) -> bool:
    return bool(re.search(r"x(?: ?n)?$|X$", shape_of(scan(collapse(text)))))


def finished(text: str) -> bool:
    return any(t.letter in "fF" and t.text != "완" or t.letter == "w" and t.text.endswith("완결") for t in scan(text))


def parsed(name: str, title: str | None, creator: str | None, headings: list[str] | None) -> dict:
    """Author, series, numbering and state of a book, from its file name, package title, creator and headings.

    Each source is rated by how sure it is to name the book; the surest gives the series.
    """
    raw = tidy(re.sub(r"(?i)\.(?:epub|zip|7z|txt)$", "", re.split(r"[\\/]", name)[-1]))
    title, creator = tidy(title), without_noise(tidy(creator))
    last = creator.rsplit(" ", 1)
    creator = last[0] if len(last) == 2 and last[1] in ROLES else creator
    stem = without_noise(raw)
    tag, own = tagged(stem)
    author = creator if creator and (not tag or re.fullmatch("[A-Za-z0-9]", tag)) else tag
    lead = re.match(rf"([가-힣A-Za-z]{{2,12}}?) ?(?:{'|'.join(COLLECTIONS)})", title)
    author = lead[1] if lead else author
    file = displayed(without_noise(own), author)
    heading = best_heading(list(headings or []))
    sure = bool(title) and not is_chapter_heading(title) and not is_generic(title)
    section = re.sub(r"[\W\d_]", "", raw).lower() in SECTION_WORDS and bool(re.search(r"\d", raw))
    explicit = numbered(file, ("volume",))
    explicit = explicit if explicit and "v" in shape_of(scan(file)) else None
    rated = [(0.1, "file", own)]
    if title:
        rated.append((2.0 if sure else 1.5 if re.search(r"\d", title) else 0.5, "title", title))
    if heading:
        rated.append((2.5 if has_unit(heading) and section else 1.6 if has_unit(heading) and not sure else 1.0, "heading", heading))
    source = max(rated)[2]
    chosen = with_editions(tagged(source)[1], own)
    if explicit or is_side(own) and not is_side(chosen):
        chosen = file
    else:
        chosen = displayed(without_noise(chosen), author)
    rounds = [("volume", "marked"), ("subtitle",), ("range", "dashed"), ("joined",), ("plain",)]
    found = next((n for forms in rounds for text in (chosen, own) if (n := numbered(text, forms))), None)
    if not found:
        tokens = scan(chosen)
        at = re.search(r"n ?e(?![nw])", shape_of(tokens))
        filed = re.search(r"(?:^|_)(\d{1,5})$", raw) if "_" in raw else None
        series = without_tail(chosen, r"n ?e") or chosen
        found = Name(series, episode=str(int(tokens[at.start()].text)) if at else str(int(filed[1])) if filed else "")
    return {"stem": stem, "author": author, **found._asdict(), "completed": finished(raw) or finished(title)}


def series_key(series: str) -> str:
    """The loose form of a series' name: no part, episode, side story, number or state at its end."""
    return without_tail(series, r" n ?p| ?n ?e| ?[xX](?: ?n)?| ?N| [fF]| n(?: ?[-.~] ?n| n)*[ .]*| n ?v")


def duplicate_title(name: str) -> str:
    """A file name without author, ranges, states and extension, for comparing."""
    _, text = tagged(re.sub(r"(?:^|(?<=[\s_]))@[^@\[\](){},]{1,80}\s*$", " ", name).replace("_", " ") if "@" in name else name.replace("_", " "))
    tokens = scan(text)
    shape, goes = shape_of(tokens), set()
    for found in re.finditer(r"(?<![wn])n ?[-~] ?n(?: ?[vepq])?|(?<![wn])n n(?: ?[vepq])?(?=[ fF]*$)", shape):
        goes |= set(range(*found.span()))
    for i, t in enumerate(tokens):
        if t.letter in "fFuU" and t.text != "완" or t.text.lower() in EXTENSIONS or t.text.lower() == "fin":
            goes.add(i)
    text = collapse("".join(" " if i in goes else t.text for i, t in enumerate(tokens)))
    return collapse(re.sub(r"후기 ?포함", " ", text)).rstrip(" ,，")


def sort_parts(name: str) -> tuple[str, int, int, int, int, float, str, str]:
    """Series, then volume (or episode, or the number at the end), part, side stories and state, to sort by."""
    tag = re.match(r"\[[^\]]+\]\s*", name)
    bare = name[tag.end() :] if tag else name
    base = re.sub(r"\.[^.]+$", "", bare)
    tokens = scan(base)
    shape = shape_of(tokens)

    def first(letter: str) -> tuple[int, int]:
        """Number before the first such unit, and its place."""
        found = re.search(f"n {letter}|n{letter}", shape)
        return (int(tokens[found.start()].text), found.start()) if found else (0, -1)

    volume, volume_at = first("v")
    part, part_at = first("p")
    number = volume or first("e")[0]
    side = next((t for t in tokens if t.letter in "xX"), None)
    extra = re.search(r"\d+", side.text) if side and side.letter == "X" else None
    interview = "인터뷰" in name or "작가노트" in name
    state = 0.5 if any(x in name for x in DONE[:1]) else 0.0
    if not number and not part:
        ending = re.search(r"(n)(?: ?[A-Z])*$", shape)
        number = int(tokens[ending.start()].text) if ending else 0
    episodic = re.match(r"(?:w ?)?n ?e[ .m]", shape) and (shape[0] == "n" or tokens[0].text == "제")
    # the series is what stands before its first numbering, bracket, dash or side story
    cut = re.search(r" ?n ?[vep]| ?[A-Z]| ?x ?n?$| n ?$| ?- ", shape + " " * 0)
    series = "" if episodic else collapse(base[: tokens[cut.start()].start] if cut else base).rstrip(" ,")
    if not number and (interview or side):
        order = (2, int(extra[0]) if extra else 0, 0, 2 if interview else 1)
    elif number and part and -1 < part_at < volume_at:
        order = (0, part, number, 0)
    else:
        order = (1, number, part, 0)
    return series, *order, state, tag[0].strip() if tag else "", name
