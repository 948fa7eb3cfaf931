"""Names of books, as the reference's tests expect them."""

import pytest

from quire.functions import names

CASES = [
    ("쾌도무적 1권 - 3.epub", "쾌도무적 1-3", "박성진(금시조)", None, "[박성진(금시조)] 쾌도무적 1권 - 3.epub", "[박성진(금시조)] 쾌도무적"),
    ("[박성진(금시조)] 쾌도무적 1 1권.epub", None, None, None, None, "[박성진(금시조)] 쾌도무적"),
    ("[간절히] 조선, 봉황이 포효한다 (2).epub", None, None, None, None, "[간절히] 조선, 봉황이 포효한다"),
    ("너희들은 변호됐다 17권(2부).epub", None, None, None, None, "너희들은 변호됐다"),
    ("너희들은 변호됐다 29권 (완결).epub", None, None, None, None, "너희들은 변호됐다"),
    ("홍등가의 소드마스터 17권 외전.epub", None, None, None, None, "홍등가의 소드마스터"),
    ("[망신창이] 홍등가의 소드마스터 17권 (외전).epub", None, None, None, "[망신창이] 홍등가의 소드마스터 17권 (외전).epub", None),
    ("[날아오르기] 킹방원 메이커 19권 외전.epub", None, None, None, "[날아오르기] 킹방원 메이커 19권 (외전).epub", None),
    ("[고담] 반 리로디드 [개정판] 06 (N).epub", None, None, None, "[고담] 반 리로디드 [개정판] 6권.epub", None),
    ("씨월드PK 08.epub", "씨월드PK 8(완결)", "김현준 저", None, "[김현준] 씨월드PK 8권 (완결).epub", None),
    ("이영도 단편선.epub", "이영도단편집", "김민영", None, "[이영도] 이영도단편집.epub", None),
    ("[고담] 반 리로디드 [개정판] 06 (N).epub", "반 리로디드 6", "고담", None, "[고담] 반 리로디드 [개정판] 6권.epub", None),
    ("section0001.epub", None, None, ["케이 18권"], "케이 18권.epub", "케이"),
    ("비포 더 던 1-1.epub", None, None, None, "비포 더 던 1권 - 1.epub", "비포 더 던"),
    ("작품 1-200.epub", None, None, None, "작품 1-200화.epub", "작품"),
    ("치우천왕기 1 : 형제.epub", None, None, None, None, "치우천왕기"),
]


@pytest.fixture(scope="module")
def rows(spark):
    own = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], "i int, name string, title string, creator string, headings array<string>")
    found = names.parsed(own)
    return {r["i"]: r for r in found.withColumn("new", names.rename(found)).withColumn("key", names.series_key()).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_names(rows, i):
    if CASES[i][4]:
        assert rows[i]["new"] == CASES[i][4]
    if CASES[i][5]:
        assert rows[i]["key"] == CASES[i][5]
