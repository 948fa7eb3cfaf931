"""Detection and repair of chapters, as the reference's tests expect them."""

import pytest

from quire.functions import segmenting as s


def titles(lines, **options):
    found, _ = s.detect("\n".join(lines), **options)
    return [t for t, _ in found]


DETECTED = [
    (["작품명 1화", "첫 만남", "본문 1", "작품명 2화", "다음 이야기", "본문 2", "작품명 3화", "마지막 선택", "본문 3"], {}, ["1화 첫 만남", "2화 다음 이야기", "3화 마지막 선택"]),
    (["207 관정 선점(3)", "본문", "208 실버오크의 포도(1)", "본문", "209 실버오크의 포도(2)", "본문", "210 카스텔로 엠페러 (1)", "본문", "211 카스텔로 엠페러 (2)", "본문"], {}, ["207 관정 선점(3)", "208 실버오크의 포도(1)", "209 실버오크의 포도(2)", "210 카스텔로 엠페러 (1)", "211 카스텔로 엠페러 (2)"]),
    (["26화 Big Ass Park(2)", "본문", "3-5-2를 유지하는 알레띠.", "1931-1932 시즌.", "0.003%쯤 되는 무시무시한 노예왕이라는 뜻이다.", "1-1) 커피믹스에 골든타임 이외의 브랜드는 존재하지 않습니다.", "27화 Big Ass Park(3)", "본문"], {"strength": "strong", "consistent": False}, ["26화 Big Ass Park(2)", "27화 Big Ass Park(3)"]),
    (["120. before", "body120", "\t#121. 500원에 뚫린 만리장성 방화벽(1)", "body121", "      #180. 세상에 돈으로 안 되는 일이 어디 있어?(2)", "body180"], {"consistent": False}, ["120. before", "#121. 500원에 뚫린 만리장성 방화벽(1)", "#180. 세상에 돈으로 안 되는 일이 어디 있어?(2)"]),
    (["1화", "“그렇지. 15.4%였나? 이자소득세까지 나가.”", "-연이율 : 8.2% (복리)", "2화", "본문"], {"consistent": False}, ["1화", "2화"]),
    (["<1부> 열아홉", "첫 본문", "<2부> 스물하나", "둘째 본문", "<3부> 서른", "셋째 본문"], {}, ["1부 열아홉", "2부 스물하나", "3부 서른"]),
    (["1화", "본문", "[에필로그 1]", "후일담 1", "[에필로그 2]", "후일담 2"], {}, ["1화", "에필로그 1", "에필로그 2"]),
    (["60. before", "“택시 미터기로 칩시다. 1km당 100원이 올라가야 정상인데.”", "“그럼 우리 남은 돈 9.5조 원은 어디로 갈까요?”", "61. after", "body"], {"consistent": False}, ["60. before", "61. after"]),
    (["<1부> 열아홉", "첫 본문", "0805. 숫자 네 개를 찍어 누르며 히죽 웃던 스무 살의 강희백이 눈앞에 스쳐 지나갔다.", "이어지는 본문", "[에필로그 1]", "후일담"], {"consistent": False}, ["1부 열아홉", "에필로그 1"]),
    (["1화", "10화 정도 되는 분량을 하루에 다 썼다고 그는 말하곤 했다", "2화", "x"], {}, ["1화", "2화"]),
    (["1. a", "b", "2. c", "1. item", "2. item", "3. item", "3. d", "e", "4. f", "g"], {}, ["1. a", "2. c", "3. d", "4. f"]),
]


@pytest.mark.parametrize("lines, options, want", DETECTED)
def test_detect(lines, options, want):
    assert titles(lines, **options) == want


def test_custom_pattern():
    found = s.detect("막간\n소개\n@@ 1\n첫 본문\n@@ 2\n둘째 본문", pattern=r"^@@\s*\d+")
    assert found == ([("시작", ["막간", "소개"]), ("@@ 1", ["첫 본문"]), ("@@ 2", ["둘째 본문"])], False)


def test_gaps():
    got = s.fill_gaps([("196화 구도지설(2)", ["body", "프롤로그의 인트로가 흘러나왔다. 197화 아이돌의 밤(1)"]), ("198화 아이돌의 밤(2)", ["next"]), ("199화 아이돌의 밤(3)", ["end"])])
    assert [t for t, _ in got] == ["196화 구도지설(2)", "197화 아이돌의 밤(1)", "198화 아이돌의 밤(2)", "199화 아이돌의 밤(3)"] and got[0][1] == ["body", "프롤로그의 인트로가 흘러나왔다."]
    assert [t for t, _ in s.fill_gaps([("53. before", ["prev"]), ("54. title", ["body", "&lt; #55. hidden title &gt;", "next body"]), ("56. next", ["real"]), ("57. after", ["after"])])] == ["53. before", "54. title", "#55. hidden title", "56. next", "57. after"]
    assert [t for t, _ in s.fill_gaps([("174. first", ["body", "175.The Oprah Winfrey show (2)", "next body"]), ("176. next", ["real"]), ("177. after", ["after"])])] == ["174. first", "175.The Oprah Winfrey show (2)", "176. next", "177. after"]
    own = [("1.", ["body", "2. list item", "3. list item", "4. list item"]), ("5.", ["real"]), ("6.", ["x"])]
    assert s.fill_gaps(own) == own
    spaced = [("1. a", ["b"]), ("2. 기억(1)", ["body2", "3. 기억(2)", "body3", "4. 위기 (1)", "body4"]), ("5. 숲", ["c"]), ("6. 숲 (2)", ["d"])]
    assert [t for t, _ in s.fill_gaps(spaced)] == ["1. a", "2. 기억(1)", "3. 기억(2)", "4. 위기 (1)", "5. 숲", "6. 숲 (2)"]


def test_short():
    assert s.merge_short([("1.", []), ("First meeting", []), ("2.", ["body"])]) == [("First meeting 2.", ["body"])]
    assert s.merge_short([("7. Swing in Chicago (1) +20", []), ("7. Swing in Chicago (1) +20", ["body"]), ("8. Swing in Chicago (2) +20", []), ("8.", ["next"])]) == [("7. Swing in Chicago (1) +20", ["body"]), ("8. Swing in Chicago (2) +20", ["next"])]
    own = [("87.", ["body"]), ("88화", ["body88"]), ("89.", ["body"])]
    assert s.merge_short(own, 100) == own and s.merge_short([("a", []), ("b", [])]) == [("a", [])]


def test_titles():
    assert s.one_marker_style("1화\nbody1\n002\nbody2\n<003>\nbody3\n101\nbody4") == "1화\nbody1\n2화\nbody2\n3화\nbody3\n101화\nbody4"
    assert s.numbered_titles([("시작 001 : 친구 따라 남미 갔다", ["b"])]) == [("1. 친구 따라 남미 갔다", ["b"])]
    assert [s.chapter_number(x) for x in ("175.The Oprah", "3.6kg is body text", "제 3화 x", "#12. a", "12 a", "1) x", "abc 3화", "1화산")] == [175, None, 3, 12, 12, 1, None, None]
    assert [s.is_pure_marker(x) for x in ("1화", "제 2 장.", "Chapter 3", "#4", "5.", "Prologue", "1화 가", "서장 둘", "")] == [True, True, True, True, True, True, False, False, True]
