"""Titles of pages, as the reference's tests expect them."""

import pytest

from quire.functions import headings as h

PAIRED = '<html><body>\n <p style="text-align: center;">1화</p>\n<p style="text-align: center;">종남의 사파 천하제일 검수</p></body></html>'
RAW = "\n    <html><body>\n      <p><strong>2화. 복귀</strong></p>\n    </body></html>\n"
MARKED = '<html><body><p class="p00 center"><span class="fs12 kbb">248화</span></p><p>&#160;</p><p>본문</p></body></html>'


def test_file_labels():
    assert [h.file_label(x) for x in ("[유인] 외과의사 엘리제 4권.epub", "_도희채__가이드를_함부로_줍지_마세요__정상_.epub", "7.epub")] == ["[유인] 외과의사 엘리제 4권", "가이드를 함부로 줍지 마세요", "7"]
    assert [h.choose_title(*x) for x in (("34화. 작전 개시.xhtml", "34화"), ("35화. 귀환.xhtml", "34화"), ("권두부.xhtml", "프롤로그"))] == ["34화. 작전 개시", "35화. 귀환", "프롤로그"]
    assert h.episode("[0001] 12화. 시작") == 12 and h.are_consistent([f"{i}화. 제목 {i}" for i in range(1, 6)]) and not h.are_consistent(list("12345"))


def test_page_titles():
    assert [h.page_title(x) for x in (PAIRED, RAW, MARKED)] == ["1화. 종남의 사파 천하제일 검수", "2화. 복귀", "248화"]
    assert h.page_title('<p class="p00 center"><span class="fs12 kbb">262화</span><span>&#160;</span></p><p>본문</p>') == "262화"
    assert h.page_title("<p><b>8. 부부 싸움은 칼로 물 베기</b></p>") == "8. 부부 싸움은 칼로 물 베기"
    assert h.page_title(None) is None and h.page_title("") is None


@pytest.mark.parametrize("markup", ["<p>1. 원고의 청구를 기각한다.</p>", "<p>6.25 때의 난리는 난리도 아니다.</p>", "<p>[백산] 너희들은 변호됐다 1권</p>", '<p class="body"><b>≫ 최제호 진짜 신기한 사람……</b></p>', "<p><b>1.</b></p>", "<p>-2권에 계속-</p>"])
def test_no_title(markup):
    assert h.page_title(f"<html><body>{markup}</body></html>") is None


def test_subheadings():
    found = h.subheadings(RAW)
    assert [(t, RAW[a:b]) for t, a, b in found] == [("2화. 복귀", "<p><strong>2화. 복귀</strong></p>")]
    out, ids = h.anchored(RAW, found, "chap")
    assert ids == [("chap_001", "2화. 복귀")] and '<a id="chap_001"></a><p><strong>2화. 복귀</strong></p>' in out
    assert [t for t, *_ in h.subheadings("<p><b>Prologue</b></p><p>x</p><p><b>Chapter 1</b></p><p>y</p><p><b>Chapter 2</b></p>")] == ["Prologue", "Chapter 1", "Chapter 2"]
    assert h.is_subheading("8. 부부 싸움은 칼로 물 베기") and not h.is_subheading("≫ 최제호 진짜 신기한 사람……")


def test_merged_titles():
    book, series = "천하제일 당소예", "천하제일 당소예 1-323"
    assert h.merged_title(MARKED, "Section0242.xhtml", {"section0242.xhtml": "Start"}, book, series) == "248화"
    assert h.merged_title(MARKED, "Section0242.xhtml", override="248화 직접 수정") == "248화 직접 수정"
    assert h.merged_title(MARKED, "Text/Section0242.xhtml", {"section0242.xhtml": "658204 248"}, book, series) == "248화"
    assert h.merged_title(MARKED, "Text/Section0260.xhtml", {"coverpage.xhtml": "Start"}, book, series) == "248화"
    assert h.merged_title("<p>-2권에 계속-</p>", "continued.xhtml") == ""
    assert [h.clean_label(*x) for x in (("#12. 시작",), ("[작가] 천하제일 12화 x", "천하제일 1-300"), ("#7",))] == ["12화 시작", "12화 x", "7화"]
    assert h.duplicate_key("#[a] 1화. 시작") == "1화 시작"


def test_notices():
    cleaned, n = h.without_notices("<html><body><h2>8. 부제</h2><p>-2권에 계속-</p><p>본문</p></body></html>")
    assert n == 1 and "계속" not in cleaned and "본문" in cleaned and h.without_notices("") == ("", 0)


def test_imprints():
    markup = '<p class="block_4">탈옥한 천재마법사</p><p>지은이｜진설우</p><p>편집부｜유서영</p>'
    assert h.book_title_of(markup) == "탈옥한 천재마법사" and h.creator_of(markup) == "진설우"
    assert h.series_title("[현판] 제12화 작품명 12권") == h.series_title("작품명 3권") == "작품명"
    assert h.is_chapterish("제12화 귀환") and [h.is_generic_label(x) for x in ("제1화", "1.", "2", "658204 248", "Start", "1화 귀환")] == [True, True, True, False, True, False]
    assert h.volume_heading(["<h1>케이 18권</h1>"]) == "케이 18권" and h.volume_heading(["<h1>18화</h1>"]) == ""
    assert h.folder_series("/x/작품 1-444_1776657938080/7.epub") == "작품"
