"""Captured pages and lists of a book store: image urls, covers of episodes, volumes, and the urls that they lead to. No network."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import meta
from quire.functions import text as T

# Names in the pages and lists.
BASE = "https://series.naver.com"
IMAGE_ATTRIBUTES = ["src", "data-src", "data-original", "data-lazy"]
PRODUCT_NAMES = ["originalproductid", "data-original-product-id"]
LIST_URL_NAMES, TOTAL_NAME, ALL = ["svolumelisturl", "volumelisturl"], "totalcount", "9999"
DETAIL_URLS = ["detailPCPageUrlByNstoreKey", "detailPageUrlByNstoreKey"]
ROW_IDS = ["productNo", "seriesNo", "volumeNo"]
CHOSEN = "선택 회차"
EXPIRED = "HTTP 403 — 쿠키가 만료됐거나 잘못되었습니다.\n🍪 쿠키 설정에서 NID_AUT / NID_SES를 갱신해주세요."
SUFFIXES = {"png": "png", "webp": "webp", "gif": "gif", "jpeg": "jpg", "jpg": "jpg"}
IMAGE_URL = r"(?i)https?://(?:[a-z0-9.-]+\.)?pstatic\.net/[^\s\"'<>\\)\]]+"


def _unslashed(text: Column) -> Column:
    """With the slashes that scripts escape."""
    return F.regexp_replace(F.replace(T.unescape_html(text), F.lit("\\/"), F.lit("/")), r"\\u002[fF]", "/")


def image_urls(pages: DataFrame, key: str = "key", markup: str = "markup") -> DataFrame:
    """key, pos, source, url: of each og:image and image attribute of tags in order, then of all urls in the text."""
    tags = F.filter(F.transform(meta.elements(F.col(markup)), lambda x: x["tag"]), lambda x: x != "")
    shared = lambda x: F.lower(x).startswith("meta") & (F.lower(F.coalesce(F.nullif(T.attribute(x, "property"), F.lit("")), T.attribute(x, "name"))) == "og:image")
    of_tag = lambda x: F.array(F.struct(F.lit("og:image").alias("source"), F.when(shared(x), T.attribute(x, "content")).alias("url")), *(F.struct(F.lit(a).alias("source"), F.regexp_extract(x, rf"(?i)(?<![\w-]){a}\s*=\s*[\"']([^\"']+)", 1).alias("url")) for a in IMAGE_ATTRIBUTES))
    raw = F.transform(F.regexp_extract_all(_unslashed(F.col(markup)), F.lit(IMAGE_URL), F.lit(0)), lambda x: F.struct(F.lit("raw").alias("source"), x.alias("url")))
    both = F.concat(F.filter(F.flatten(F.transform(tags, of_tag)), lambda x: F.coalesce(x["url"], F.lit("")) != ""), raw)
    return pages.select(key, F.posexplode(both).alias("pos", "x")).select(F.col(key).alias("key"), "pos", "x.source", "x.url")


def episode_covers(pages: DataFrame, key: str = "key", markup: str = "markup") -> DataFrame:
    """key, pos, title, url: of each image with a source; the title is its alternative text."""
    tags = F.filter(F.transform(meta.elements(F.col(markup)), lambda x: x["tag"]), lambda x: x.rlike(r"(?i)^img\b"))
    found = F.transform(tags, lambda x: F.struct(T.attribute(x, "alt").alias("title"), F.regexp_extract(x, r"(?i)(?:src|data-src)=[\"']([^\"']+)", 1).alias("url")))
    each = pages.select(F.col(key).alias("key"), F.posexplode(F.filter(found, lambda x: x["url"] != "")).alias("pos", "x"))
    return each.select("key", "pos", T.flat_text(F.col("x.title")).alias("title"), T.unescape_html(F.col("x.url")).alias("url"))


def _named_value(markup: Column, names: list[str], value: str) -> Column:
    """The first value that one of the names is given, with : or =, quoted or not."""
    return F.coalesce(*(F.nullif(F.regexp_extract(markup, rf"(?i)[\"']?\b{n}\b[\"']?\s*[:=]\s*[\"']?({value})", 1), F.lit("")) for n in names))


def original_product(markup: Column) -> Column:
    return _named_value(markup, PRODUCT_NAMES, r"\d+")


def absolute(url: Column) -> Column:
    own = T.unescape_html(url)
    return F.when(own.rlike("(?i)^https?://"), own).when(own.startswith("//"), F.concat(F.lit("https:"), own)).when(own.startswith("/"), F.concat(F.lit(BASE), own)).otherwise(F.concat(F.lit(BASE + "/"), own))


def with_parameter(url: Column, name: str, value: str) -> Column:
    """A url whose query has one such parameter, at its end."""
    address = F.substring_index(F.substring_index(url, "#", 1), "?", 1)
    query = F.when(F.contains(url, F.lit("?")), F.substring(F.substring_index(url, "#", 1), F.length(address) + 2, F.length(url))).otherwise("")
    kept = F.filter(F.split(query, "&"), lambda x: (F.substring_index(x, "=", 1) != name) & (x != ""))
    fragment = F.when(F.contains(url, F.lit("#")), F.concat(F.lit("#"), F.substring_index(url, "#", -1))).otherwise("")
    return F.concat(address, F.lit("?"), F.array_join(F.concat(kept, F.array(F.lit(f"{name}={value}"))), "&"), fragment)


def volume_list_url(markup: Column, category: Column, product: Column) -> Column:
    """Where a detail page's list of volumes is, in ascending order."""
    named = _named_value(markup, LIST_URL_NAMES, "[^'\"\\s,]+")
    total = F.coalesce(_named_value(markup, [TOTAL_NAME], r"\d+"), F.lit(ALL))
    made = F.concat(F.lit(BASE + "/"), category, F.lit("/volumeList.series?productNo="), product, F.lit("&totalCount="), total)
    return with_parameter(F.coalesce(absolute(named), made), "sortOrder", "ASC")


def volume_rows(lists: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """Captured lists (JSON) -> key, pos, row (JSON), number, label, product, detail: each volume once, by its first place."""
    own = lists.select(F.col(key).alias("key"), "category", F.posexplode(F.from_json(body, "resultData array<string>")["resultData"]).alias("pos", "row")).filter(F.col("row").startswith("{"))
    value = lambda k: F.nullif(F.nullif(F.get_json_object("row", f"$.{k}"), F.lit("")), F.lit("0"))
    own = own.withColumn("id", F.coalesce(*map(value, ROW_IDS))).withColumn("product", value("productNo")).withColumn("number", meta.episode_number(F.col("row")))
    first = F.row_number().over(Window.partitionBy("key", F.coalesce("id", F.concat(F.lit("#"), "pos"))).orderBy("pos"))
    label = F.coalesce(*map(value, meta.ROW_NAMES), F.concat(F.col("number").cast("string"), F.lit("화")), F.lit(CHOSEN))
    detail = F.coalesce(*(absolute(value(k)) for k in DETAIL_URLS), F.concat(F.lit(BASE + "/"), "category", F.lit("/volumeDetail.series?productNo="), "product"))
    return own.withColumn("first", first).filter("first = 1").select("key", "pos", "row", "number", label.alias("label"), "product", detail.alias("detail"))


def image_type(url: Column, content_type: Column) -> Column:
    """An image's suffix: by its url, else by its content type, else jpg."""
    path = F.lower(F.substring_index(F.substring_index(url, "#", 1), "?", 1))
    by_url = reduce(lambda rest, s: F.when(path.endswith(f".{s}"), SUFFIXES[s]).otherwise(rest), SUFFIXES, F.lit(None).cast("string"))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    by_type = F.when(F.contains(kind, F.lit("png")), "png").when(F.contains(kind, F.lit("webp")), "webp").when(F.contains(kind, F.lit("gif")), "gif").otherwise("jpg")
    return F.coalesce(by_url, by_type)


def fetch_error(code: Column, reason: Column) -> Column:
    """What to tell about a failed fetch."""
    return F.when(code == 403, EXPIRED).when(code.isNotNull(), F.concat(F.lit("HTTP 오류 "), code.cast("string"), F.lit(": "), reason)).otherwise(F.concat(F.lit("오류: "), reason))
