"""Texts to chapters, and repair of their titles and numbering. Plain Python over one book, for use inside Arrow functions.

A chapter is a title and its lines, which are escaped. What makes a line a
heading is read off the shape of its tokens (quire.functions.grammar): each
kind of heading is a form over shapes, and a strength is a set of kinds.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

from quire.functions.grammar import OPENINGS, SIDE, collapse, scan, shape_of, tidy

# Words and endings of the vocabulary.
START, BODY = "시작", "본문"
ENGLISH = ["chapter", "ch", "part", "volume"]
#: How a sentence ends.
CLOSES = "다요죠까니데"
#: Particles that follow a number in a sentence.
PARTICLES = "은는이가을를의에와과도만"
MIDDLES = ["막간"]
WEAK = ["custom", "unit", "english", "side", "hash"]
NORMAL = [*WEAK, "opening", "angle", "part", "tail", "tail_dot", "dot"]
STRENGTHS = {"weak": WEAK, "normal": NORMAL, "strong": [*NORMAL, "split", "decimal", "markdown"]}
#: Kinds that stay whatever kind most headings of a book have.
EXEMPT = {"opening", "side", "angle", "dot"}
#: Numbers that may be missing between the neighbours of noise.
NEAR = 6

Chapter = tuple[str, list[str]]


class Heading(NamedTuple):
    kind: str
    title: str
    prefixed: bool = False


def marker(title: str) -> str:
    return f"<b>{html.escape(title)}</b>"


def is_sentence_end(text: str) -> bool:
    return bool(re.search(rf"[{CLOSES}][.!?。]?['\"‘’“”]?\s*$|[.!?]\s*$", text))


def is_prose(text: str) -> bool:
    """Too long for a heading that only a number marks."""
    return len(text) >= 40 and bool(re.search("[,.!?…“”\"'‘’]", text)) or len(text.split()) >= 8


def chapter_number(title: str) -> int | None:
    """The number that a title starts with: before a unit, a mark or a blank and something."""
    tokens = scan((title or "").strip())
    shape = shape_of(tokens)
    found = re.match(r"(?:# ?)?(?:w ?)?n(?= ?[vepq](?![nw])| ?[:)]| ?\.(?!n)| [^ ])", shape.replace("m", ")") if tokens and any(t.text == ")" for t in tokens) else shape)
    if not found or "w" in found[0] and not any(t.text == "제" for t in tokens[:2]):
        return None
    return int(next(t.text for t in tokens if t.letter == "n"))


def _inside_angles(line: str) -> tuple[str, str, str] | None:
    found = re.fullmatch(r"(.{0,120}?)[<＜〈]\s*([^<>＜＞〈〉]+?)\s*[>＞〉]\s*(.*)", line)
    return (found[1], found[2], found[3]) if found else None


def heading(line: str, kinds: list[str], custom: re.Pattern | None = None) -> Heading | None:
    """What kind of heading a line is, and the title in it; None for a line of the body."""
    line = collapse(re.sub("[​-‏⁠﻿]", "", line).replace(" ", " "))
    if not line:
        return None
    if custom and custom.match(line):
        return Heading("custom", line)
    if re.search(r"\d+\.\d+ ?%", line):
        return None
    found = next((h for h in _forms(line) if h.kind in kinds), None)
    if not found:
        return None
    if found.kind in ("dot", "split", "decimal") and is_prose(line) or found.kind == "dot" and re.match(r"0\d{3,} ?[.．] ?\S", line):
        return None
    if found.kind == "split" and (re.match(r"\d{4} ?- ?\d{4} ", line) or re.match(r"\d+(?: ?- ?\d+){2,} ?[가-힣]", line) or re.match(r"\d+ ?- ?\d+\) ?\S", line) or re.match(rf"\d+ ?- ?\d+ ?[{PARTICLES}](?![가-힣])", line)):
        return None
    said = re.match(r"(?:# ?)?(?:제 ?)?\d{1,5} ?[화장회] (?![.)：:\-])(.+)", line)
    if said and (len(said[1]) >= 18 and is_sentence_end(said[1]) or len(said[1].split()) >= 5):
        return None
    return found


def _forms(line: str):
    """All kinds of heading that a line could be, the surest first."""
    angles = _inside_angles(line)
    if angles:
        before, inner, after = angles
        shape = shape_of(scan(inner))
        if not before and shape in ("np", "n p") and after:
            yield Heading("part", f"{inner} {after}")
        if not after and re.match(r"(?:# ?)?n ?(?:e|[.,:])", shape):
            yield Heading("angle", inner, bool(before))
    bare = line.strip("[](){}【】『』「」<>＜＞〈〉 -–—·•")
    tokens = scan(bare)
    shape = shape_of(tokens)
    words = [t.text.lower() for t in tokens if t.letter != " "]
    first = words[0] if words else ""
    if re.match(r"n ?[vepq](?=[ .:)m]|$)", shape) and line[0].isdigit() or first == "제" and re.match(r"w ?n ?[vepq]", shape):
        yield Heading("unit", line)
    side = next((t.text for t in tokens if t.letter == "x"), "")
    if side in SIDE[:4] and (re.match(r"(?:w )?x ?n ?(?:e|\.)|(?:w ?)?n ?e ?x|x ?n|n ?x", shape) or first == side and shape[1:2] in ("", " ", "-", ":", ".")):
        yield Heading("side", bare)
    if first in OPENINGS or len(words) > 1 and words[0] == "특별" and words[1] in SIDE:
        yield Heading("opening", bare)
    if first in ENGLISH and re.match(r"w ?\.? ?n", shape):
        yield Heading("english", line)
    if re.match(r"# ?n", shape_of(scan(line))):
        yield Heading("hash", line)
    own = scan(line)
    shape = shape_of(own)
    if re.match(r"n ?\.(?:$| |(?!n).)", shape) or re.match(r"\d+ ?[:：)](?: |$)", line):
        yield Heading("dot", line)
    tail = re.search(r" (n ?[eq])(?: ?[A-Z])?$", shape)
    if tail and tail.start() > 0 and 2 <= own[tail.start()].start <= 80:
        yield Heading("tail", line[own[tail.start(1)].start :], True)
    dotted = re.search(r" (n ?\.)(?!n) ?[^ ]", shape)
    if dotted and 2 <= own[dotted.start()].start <= 120 and len(own[dotted.start(1)].text) <= 4 and not is_sentence_end(line) and not is_prose(line):
        yield Heading("tail_dot", line[own[dotted.start(1)].start :], True)
    if re.match(r"n ?- ?n", shape):
        yield Heading("split", line)
    if re.match(r"n\.n", shape):
        yield Heading("decimal", line)
    if re.match(r"#{1,3} \S", line):
        yield Heading("markdown", line)


def shown_title(title: str) -> str:
    """A heading for display: no decoration round it, a blank before a remark in brackets."""
    text = re.sub(r"(\d ?[화장편권부])([(（])", r"\1 \2", tidy(title))
    text = re.sub(r"^[│|┃┆┊]\s*", "", text)
    for a, b in ("[]", "()", "【】", "『』", "「」", "<>", "〈〉"):
        if text.startswith(a) and text.endswith(b) and a not in text[1:]:
            text = text[1:-1].strip()
    opening = re.match(rf"(?:{'|'.join([*OPENINGS[:4], *SIDE])})\b", text)
    if opening and text[-1:] in "])】』」" and not re.search(r"[\[(【『「]", text):
        text = text[:-1].rstrip()
    text = without_start(text)
    text = re.sub(r"^#\s*(?=(?:제\s*)?\d+\s*[화장편권부회])", "", text)
    wrapped = re.fullmatch(r"(\d{1,5}\s*[.)]\s*)?[<〈]\s*#?\s*(.*?)\s*[>〉]", text)
    return collapse(f"{wrapped[1] or ''}{wrapped[2]}") if wrapped else text


def without_start(title: str) -> str:
    """Without the name of an opening section before a number."""
    return re.sub(rf"^{START}\s+(?=(?:#\s*)?(?:제\s*)?\d{{1,5}}\s*[화장편권부회.):：])", "", title)


def _is_subtitle(line: str, marked: str) -> bool:
    """Whether the line after a bare mark goes on with its title: numbered itself, and no sentence."""
    bare = re.fullmatch(r"(?:제\s*)?\d{1,5}\s*[화장편권부회]\s*[.):：]?", tidy(marked))
    if not bare or not 2 <= len(line) <= 60 or line[0] in "([\"“「":
        return False
    if re.search(rf"[{CLOSES}][.!?。]?\s*$", line) or len(line) >= 14 and len(line.split()) >= 3:
        return False
    return bool(re.search(r"[-–—]\s*\d+\s*$|[(（]\d+[)）]\s*$|\+\d+\s*$", line))


def detect(text: str, strength: str = "normal", pattern: str = "", consistent: bool = True, subtitles: bool | None = None) -> tuple[list[Chapter], bool]:
    """A text's chapters, and whether titles go on in the line after them.

    What is before the first heading is a chapter of its own, joined to the
    first if it is a short line, left out if the text opens with title@author.
    """
    kinds = STRENGTHS.get(strength, NORMAL)
    custom = None
    if pattern:
        try:
            custom = re.compile(pattern)
        except re.error:
            pass
    lines = [x.strip() for x in (text or "").splitlines() if x.strip()]
    heads = [heading(x, kinds, custom) for x in lines]
    prefixed = [i for i, h in enumerate(heads) if h and h.prefixed]
    if subtitles is None:
        going_on = sum(i + 1 < len(lines) and len(lines[i + 1]) <= 30 and not heads[i + 1] for i in prefixed)
        subtitles = len(prefixed) >= 3 and going_on >= len(prefixed) / 2
    found: list[tuple[str, str, list[str]]] = [("", START, [])]
    skip = False
    for i, (line, head) in enumerate(zip(lines, heads, strict=True)):
        if skip:
            skip = False
            continue
        if not head or re.match(r"\d{1,5}\.\d", tidy(head.title)):
            found[-1][2].append(html.escape(line))
            continue
        title = head.title
        after = lines[i + 1] if i + 1 < len(lines) and not heads[i + 1] else ""
        if after and (head.prefixed and subtitles and len(after) <= 30 and after[0] not in "([\"“「" or not (head.prefixed and subtitles) and _is_subtitle(after, title)):
            title, skip = f"{title} {after}", True
        found.append((head.kind, shown_title(title) if head.kind != "custom" else title, []))
    opening = bool(lines) and bool(re.match(r"[^@\n]{1,80}?@[^\s@][^\n]{0,60}$", lines[0]))
    kinds_found = Counter(k for k, *_ in found[1:])
    if not found[0][2] or opening:
        found = found[1:]
    elif len(found) > 1 and len(found[0][2]) == 1 and len(re.sub(r"<[^>]+>", "", found[0][2][0])) <= 120:
        found[1][2][:0] = found[0][2]
        found = found[1:]
    if not found:
        return [(BODY, [])], subtitles
    found = _without_lists(found)
    if sum(kinds_found.values()) <= 2 and (numbered := _by_bare_numbers(lines)):
        return numbered, subtitles
    if not kinds_found:
        return [(BODY if lines and found[0][1] == START else found[0][1], found[0][2])], subtitles
    if consistent and sum(kinds_found.values()) > 1:
        main = kinds_found.most_common(1)[0][0]
        kept = [found[0]]
        for item in found[1:]:
            if item[0] == main or item[0] in EXEMPT:
                kept.append(item)
            else:
                kept[-1][2].extend([f"<b>{item[1]}</b>", *item[2]])
        found = kept
    return [(title, own) for _, title, own in found], subtitles


def _without_lists(found: list[tuple[str, str, list[str]]]) -> list[tuple[str, str, list[str]]]:
    """Numbers 1, 2, ... that interrupt numbered chapters, and after which a number not beyond them comes, are a list of the body."""
    out: list[tuple[str, str, list[str]]] = []
    i = 0
    while i < len(found):
        run = [i]
        while run[-1] + 1 < len(found) and found[run[-1] + 1][0] in ("dot", "hash", "split", "decimal") and chapter_number(found[run[-1] + 1][1]) == (chapter_number(found[run[-1]][1]) or 0) + 1:
            run.append(run[-1] + 1)
        end = run[-1] + 1
        after = chapter_number(found[end][1]) if end < len(found) else None
        first, last = chapter_number(found[i][1]), chapter_number(found[run[-1]][1])
        if len(found) >= 4 and out and found[i][0] == "dot" and len(run) >= 2 and first == 1 and chapter_number(out[-1][1]) is not None and after is not None and after <= last:
            for k in run:
                out[-1][2].extend([marker(found[k][1]), *found[k][2]])
            i = end
        else:
            out.append(found[i])
            i += 1
    return out


def _by_bare_numbers(lines: list[str]) -> list[Chapter] | None:
    """Chapters by lines that open with a number, if there are five or more and most of them ascend."""
    heads = []
    for i, line in enumerate(lines):
        found = re.match(r"(\d{1,5})(?:\s*[.)．。]\s*|\s+)(\S.+)$", line)
        if not found or len(tail := tidy(found[2])) > 90 or re.match(rf"(?:차|생|[{PARTICLES}])(?![가-힣])", tail) or len(tail) >= 35 and is_sentence_end(tail):
            continue
        heads.append((i, int(found[1])))
    rising = sum(b[1] > a[1] for a, b in zip(heads, heads[1:], strict=False))
    if len(heads) < 5 or len({n for _, n in heads}) < 5 or rising < 0.8 * (len(heads) - 1):
        return None
    ends = [i for i, _ in heads[1:]] + [len(lines)]
    return [(lines[i], [html.escape(x) for x in lines[i + 1 : end]]) for (i, _), end in zip(heads, ends, strict=True)]


def is_pure_marker(title: str) -> bool:
    """Whether a title is a bare mark, with nothing of its own."""
    text = tidy(title)
    shape = shape_of(scan(text)).replace(" ", "").rstrip(".")
    words = [t.text.lower() for t in scan(text) if t.letter in "wx"]
    if not text or re.fullmatch(r"n[vepq]|#n|n[:m]?", shape) and (len(shape) > 1 or text[-1] in ".:)"):
        return True
    if shape in ("wn[vepq]", "wn", "w.n", "w", "x") or re.fullmatch("wn[vepq]", shape):
        return words[0] == "제" and "n" in shape or words[0] in ENGLISH and "n" in shape or len(words) == 1 and "n" not in shape and words[0] in [*OPENINGS, "외전"]
    return bool(re.search(r"\b\d+\s*[화장편권부][ .]*$", text)) and bool(re.search(r"(?<![가-힣\w])\d", text))


def is_structured(title: str) -> bool:
    """Whether a title names its place among chapters."""
    return chapter_number(title) is not None or bool(re.match(r"(?:Chapter|Ch\.?)\s*\d{1,5}\b|(?:제\s*)?\d{1,5}\s*[화장편권부절막회차](?:\s|$|[.)：:\-–—])", tidy(title), re.I))


def _size(lines: list[str]) -> int:
    return sum(map(len, lines))


def _one_title(before: str, title: str) -> str:
    """Of a title without a body and the one after it; of two that say the same, the fuller."""
    a, b = collapse(before), collapse(title)
    if not a or not b:
        return a or b
    if chapter_number(a) is not None and chapter_number(a) == chapter_number(b):
        if is_pure_marker(b) or tidy(a).startswith(tidy(b)):
            return a
        if tidy(b).startswith(tidy(a)):
            return b
    return f"{a} {b}"


def short_plan(titles: list[str], sizes: list[int], least: int = 0) -> list[tuple[str, str]]:
    """For the chapters of a book in order: drop, keep or join (the one kept before), and the title to keep.

    Those without a body go: a bare mark for good, another title to the next
    one. Then those shorter than least, without a structured title, join the
    one before; a first one like that takes in the next, under both titles.
    """
    out: list[tuple[str, str]] = []
    pending = ""
    for title, size in zip(titles, sizes, strict=True):
        if size:
            out.append(("keep", _one_title(pending, title) if pending else title))
            pending = ""
        else:
            out.append(("drop", title))
            if not is_pure_marker(title):
                pending = f"{pending} {title}".strip()
    known = [i for i, (what, _) in enumerate(out) if what == "keep"]
    if not known:
        return [("keep", titles[0]), *out[1:]] if out else out
    if least <= 0:
        return out
    short = lambda i: sizes[i] < least and not is_structured(out[i][1])
    for i in known[1:]:
        if short(i):
            out[i] = ("join", out[i][1])
    left = [i for i in known if out[i][0] == "keep"]
    if len(left) > 1 and sum(sizes[i] for i in known if i < left[1]) < least and not is_structured(out[left[0]][1]):
        first, title = out[left[0]][1], out[left[1]][1]
        out[left[0]] = ("keep", title if not first or is_pure_marker(first) else f"{first} {title}".strip())
        out[left[1]] = ("join", title)
    return out


def merge_short(chapters: list[Chapter], least: int = 0) -> list[Chapter]:
    out: list[Chapter] = []
    for (_, lines), (what, title) in zip(chapters, short_plan([t for t, _ in chapters], [_size(x) for _, x in chapters], least), strict=True):
        if what == "keep":
            out.append((title, list(lines)))
        elif what == "join":
            out[-1][1].extend([f"<b>{title}</b>", *lines])
    return out


def low_runs(numbers: list[int | None]) -> list[bool]:
    """Which chapters are in a run of numbers that have passed already, and after which the next number follows on."""
    out, last, i = [False] * len(numbers), None, 0
    while i < len(numbers):
        end = i
        while len(numbers) > 3 and last is not None and end < len(numbers) and numbers[end] is not None and numbers[end] <= last:
            end += 1
        if i < end < len(numbers) and numbers[end] == last + 1:
            out[i:end] = [True] * (end - i)
            i = end
        else:
            last = numbers[i]
            i += 1
    return out


def ascending(numbers: list[int]) -> list[int]:
    """Indices of a longest strictly ascending sequence: of equal lengths the earliest end, and before it the earliest predecessor.

    In n log n: a Fenwick tree over ranks holds, for each prefix of values,
    the greatest length and the least index that reaches it.
    """
    ranks = {v: i + 1 for i, v in enumerate(sorted(set(numbers)))}
    tree: list[tuple[int, int]] = [(0, 0)] * (len(ranks) + 1)
    length, back = [], []
    for i, v in enumerate(numbers):
        at, best = ranks[v] - 1, (0, 0)
        while at:
            best = max(best, tree[at])
            at -= at & -at
        length.append(best[0] + 1)
        back.append(-best[1] if best[0] else -1)
        at = ranks[v]
        while at < len(tree):
            tree[at] = max(tree[at], (length[i], -i))
            at += at & -at
    at, out = max(range(len(numbers)), key=lambda i: (length[i], -i)), []
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def _embedded(text: str, before: int, after: int) -> str:
    """The last title with a number between two that stands inside a text."""
    tokens = scan(text)
    found = [t for t in re.finditer(r"n ?[vepq](?=[ .]|$)", shape_of(tokens)) if before < int(tokens[t.start()].text) < after]
    return text[tokens[found[-1].start()].start :] if found else ""


def _is_noise(title: str) -> bool:
    """Whether a title without a number, in the flow of numbered ones, is a line of the body."""
    text = tidy(title)
    return not text or bool(re.match(r"\d{1,3}[.,]\d+\s*%", text)) or bool(re.search(r"n ?[vepq](?![nw])", shape_of(scan(text)))) or len(text) >= 18 and bool(re.search("[.!?。,]", text))


def place_titles(titles: list[str]) -> list[str | None]:
    """For the titles of a book in order: the title to keep, or None for one that is a line of the chapter before.

    Kept are the longest ascending sequence of numbers, and special chapters.
    A title without a number between near neighbours is noise if it reads like
    a line of the body, unless a number between theirs stands inside it.
    """
    special = [any(w in (t or "").lower() for w in [*SIDE[:3], *OPENINGS[:4]]) for t in titles]
    numbers = [chapter_number(t or "") for t in titles]
    free = [i for i, n in enumerate(numbers) if n is not None and not special[i]]
    if len(titles) < 3 or len(free) < 3:
        return list(titles)
    kept = {free[k] for k in ascending([numbers[i] for i in free])}
    out: list[str | None] = [t if i in kept or special[i] else None for i, t in enumerate(titles)]
    last = None
    following: list[int | None] = [None] * len(titles)
    ahead = None
    for i in range(len(titles) - 1, -1, -1):
        following[i] = ahead
        if i in kept:
            ahead = numbers[i]
    for i, title in enumerate(titles):
        if i in kept:
            last = numbers[i]
        elif numbers[i] is None and not special[i]:
            between = last is not None and following[i] is not None and following[i] > last
            inside = _embedded(tidy(title), last, following[i]) if between else ""
            noise = between and following[i] - last <= NEAR and _is_noise(title)
            out[i] = inside or (None if noise else title)
    return out


def keep_ascending(chapters: list[Chapter]) -> list[Chapter]:
    out: list[Chapter] = []
    for (title, lines), new in zip(chapters, place_titles([t for t, _ in chapters]), strict=True):
        if new is not None or not out:
            out.append((title if new is None else new, list(lines)))
        else:
            out[-1][1].extend([marker(title), *lines])
    return out


def _plain(line: str) -> str:
    text = html.unescape(line).strip()
    angles = re.fullmatch(r"[<〈]\s*(.*?)\s*[>〉]", text)
    return re.sub(r"<[^>]+>", "", angles[1] if angles else text).strip()


def _list_numbers(plain: list[str], wanted: set[int]) -> set[int]:
    """Wanted numbers that are items of a list: runs n, n+1, ... on lines that follow each other, or with unwanted members."""
    items = [(i, int(m[1])) for i, x in enumerate(plain) if (m := re.match(r"(\d+)\s*[.:)](?:\s|$|(?=[A-Za-z가-힣'‘“]))", x))]
    runs: list[list[tuple[int, int]]] = []
    for item in items:
        if runs and item[1] == runs[-1][-1][1] + 1:
            runs[-1].append(item)
        else:
            runs.append([item])
    lists = [r for r in runs if len(r) > 1 and (all(b[0] == a[0] + 1 for a, b in zip(r, r[1:], strict=False)) or any(n not in wanted for _, n in r))]
    return {n for r in lists for _, n in r} & wanted


def fill_gaps(chapters: list[Chapter]) -> list[Chapter]:
    """Chapters whose numbers are missing between neighbours, from the lines of the body that name them."""
    numbers = [chapter_number(t) for t, _ in chapters]
    known = [n for n in numbers if n is not None]
    rising = sum(b > a for a, b in zip(known, known[1:], strict=False))
    if len(chapters) < 2 or len(known) < 2 or len(known) >= 3 and rising < 0.9 * len(known) - 1 or len(known) < 3:
        return list(chapters)
    out: list[Chapter] = []
    for k, (title, lines) in enumerate(chapters):
        after = next((n for n in numbers[k + 1 :] if n is not None), None)
        missing = set(range(numbers[k] + 1, after)) if numbers[k] is not None and after is not None else set()
        out.append((title, []))
        if not missing:
            out[-1][1].extend(lines)
            continue
        plain = [_plain(x) for x in lines]
        lists = _list_numbers(plain, missing)
        for line, text in zip(lines, plain, strict=True):
            headed = re.match(r"(?:#\s*)?(\d+)\s*[.:)](?:\s|$|(?=[A-Za-z가-힣'‘“]))", text)
            if headed and int(headed[1]) in missing - lists:
                missing.discard(int(headed[1]))
                out.append((text, []))
                continue
            tokens = scan(text)
            inside = [m.start() for m in re.finditer(r"(?<!n)n ?[vepq](?![nw])", shape_of(tokens)) if int(tokens[m.start()].text) in missing]
            if not inside:
                out[-1][1].append(line)
                continue
            at = tokens[inside[-1]]
            missing.discard(int(at.text))
            if text[: at.start].strip():
                out[-1][1].append(html.escape(text[: at.start].strip()))
            out.append((text[at.start :].strip(), []))
    return out


def one_marker_style(text: str) -> str:
    """Lines that are bare numbers, in brackets or with a unit, as N화, where most of three or more ascend."""
    lines = (text or "").splitlines()
    found = {}
    for i, line in enumerate(lines):
        own = re.fullmatch(r"(?:제\s*)?0*(\d{1,4})\s*[화회]|[<\[(【『「]?\s*0*(\d{1,4})\s*[>\])】』」]?", tidy(line))
        if own:
            found[i] = int(own[1] or own[2])
    numbers = list(found.values())
    rising = sum(b > a for a, b in zip(numbers, numbers[1:], strict=False))
    if len(lines) < 3 or len(set(numbers)) < 3 or rising < 0.6 * (len(numbers) - 1):
        return text
    return "\n".join(f"{found[i]}화" if i in found else line for i, line in enumerate(lines))


def _numbered_title(title: str) -> tuple[int, str, bool] | None:
    """Number, rest and whether a unit follows the number, of a title that begins with one."""
    text = without_start(tidy(title))
    angles = re.fullmatch(r"[<〈]\s*#\s*(\d{1,5})\s*[.):]?\s*(.*?)\s*[>〉]", text)
    if angles:
        return int(angles[1]), angles[2], False
    own = re.match(r"(?:제\s*)?(\d{1,5})\s*[화장편권부회]\s*(?:[.):\-]\s*)?(.*)$", text)
    if own:
        return int(own[1]), own[2].strip(), True
    own = re.match(r"(?:#\s*)?(\d{1,5})\s*[.):]\s*(.*)$", text)
    return (int(own[1]), own[2].strip(), False) if own else None


def numbered_titles(chapters: list[Chapter]) -> list[Chapter]:
    """Titles as `N. rest`; without a rest as N화 or N., as they were."""
    out = []
    for title, lines in chapters:
        text = without_start(tidy(title))
        lasting = re.search(r"(?<!\d)(\d{1,5})\s*화\s*$", text)
        found = _numbered_title(title)
        if lasting and re.search(r"\bLP\b", text, re.I):
            title = f"{int(lasting[1])}화"
        elif found:
            title = f"{found[0]}. {found[1]}" if found[1] else f"{found[0]}{'화' if found[2] else '.'}"
        out.append((title, lines))
    return out


def restored_titles(chapters: list[Chapter], source: str) -> list[Chapter]:
    """Titles with the rest that the first line of the source with their number and a unit gives them."""
    known: dict[int, str] = {}
    for line in (source or "").splitlines():
        found = _numbered_title(line)
        if not found or not found[2] or not 0 < len(found[1]) <= 120 or found[1][0] in PARTICLES or re.match(r"차(?![가-힣])", found[1]):
            continue
        if len(found[1]) < 18 or not is_sentence_end(found[1]):
            known.setdefault(found[0], f"{found[0]}. {found[1]}")
    out = []
    for title, lines in chapters:
        own = re.match(r"(?:#\s*)?(\d{1,5})(?!\d)\s*[.):]?", tidy(title))
        out.append((known.get(int(own[1]), title) if own else title, lines))
    return out


def without_angles(chapters: list[Chapter]) -> list[Chapter]:
    """Titles without decoration in angles, round all of it or what follows the number."""
    mark = r"(?:#\s*)?(?:제\s*)?\d{1,5}\s*(?:[화장편권부회](?![가-힣])|[.):])"
    out = []
    for title, lines in chapters:
        text = tidy(title)
        text = re.sub(rf"^({mark}\s*)[<〈]\s*(.*?)\s*[>〉]$", r"\1\2", text)
        out.append((re.sub(rf"^[<〈]\s*({mark}.*?)\s*[>〉]$", r"\1", text).strip() or title, lines))
    return out
