"""Text functions as expressions of columns; none runs Python on the executors."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that the source platform trims and collapses.
SPACE = r"[\s\x0B   -     　﻿]"
WHITE = "".join(c for c in map(chr, range(1 << 16)) if re.fullmatch(SPACE, c, re.ASCII))
#: What the SQL of queries collapses, and what it trims.
PLAIN_WHITE, BLANKS = "\t\n\f\r ", "".join(c for c in map(chr, range(1 << 16)) if unicodedata.category(c) == "Zs")
#: Routing tags in their order, and aliases.
TAGS = ["macro", "policy", "security", "funding", "yield", "token", "airdrop", "trading", "onchain", "tech", "exchange", "narrative", "other"]
ALIASES = {"market": "macro", "others": "other"}
#: Titles of sections by tag.
TITLES = {
    "policy": "政策 / 合规", "macro": "宏观 / 行情", "security": "安全 / 风险", "funding": "融资 / 资金", "yield": "收益 / 理财", "token": "代币 / 市场", "airdrop": "空投 / 福利",
    "trading": "交易机会", "onchain": "链上数据", "tech": "技术 / 升级", "exchange": "交易所 / 平台", "narrative": "叙事 / 主题", "other": "其他", "others": "其他", "defi": "DeFi",
    "infrastructure": "基础设施", "market": "宏观 / 行情", "community": "社区 / 生态", "governance": "治理", "ecosystem": "生态升级",
}
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Units of amounts and of time.
AMOUNT_UNIT = rf"(?i)%|{BEFORE}(?:usd|usdt|usdc|btc|eth|bnb|sol|m|b|k){AFTER}|美元|美金|亿|万"
TIME_UNIT = rf"(?i){BEFORE}(?:sec|second|minute|min|hour|day|week|month|year)s?{AFTER}|分钟|小时|天|周|月|年|UTC|GMT"


def once(x: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of x, which is worked out once however often fn names it."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def collapse(x: Column, white: str = WHITE) -> Column:
    """White space collapsed and trimmed; other blanks, if white lacks them, are trimmed only."""
    # a map of code points is several times faster than a class of as many
    spaced = F.translate(x, white, " " * len(white))
    single = once(spaced, lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t))
    return F.trim(single) if set(BLANKS) <= set(white) else F.trim(single, F.lit(BLANKS))


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def summary_text(x: Column) -> Column:
    """Links [a](b) become a: b, and a last [c] becomes Tags: c."""
    linked = F.regexp_replace(x, r"\[([^\]]+)\]\(([^)]+)\)", "$1: $2")
    return strip(F.regexp_replace(linked, r"\s*\[([^\]]+)\]\s*$", " Tags: $1"))


#: What a bullet loses, in this order: its number, links (and doubled space), counts in brackets, tags, a last word for a post.
BULLET_NOISE = [(r"^\s*[0-9]+\s*[.、:-]\s*", ""), (r"https?://\S+", ""), (f"{SPACE}+", " "), ("（[^）]*条[^）]*）", ""), (rf"(?i){BEFORE}Tags:.*$", ""), (r"(?i)(?:推文|tweet)\s*[:：]?\s*$", "")]


def bullet(x: Column, n: int = 48) -> Column:
    """A summary as a bullet of n code points at most."""
    bare = summary_text(x)
    for noise, instead in BULLET_NOISE:
        bare = strip(F.regexp_replace(bare, noise, instead))
    return truncate(bare, n)


def truncate(x: Column, n: int = 160) -> Column:
    """Collapsed text, cut to n code points with an ellipsis as the last."""
    return cut(collapse(x), n)


def cut(x: Column, n: int) -> Column:
    """The text, if longer than n code points cut to n with an ellipsis as the last."""
    return once(x, lambda short: F.when(F.length(short) <= n, short).otherwise(F.concat(F.substring(short, 1, n - 1), F.lit("…"))))


def utf16_length(x: Column) -> Column:
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def number_tokens(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"[0-9]+(?:[.,][0-9]+)?%?"))


def has_ticker(x: Column) -> Column:
    return x.rlike(rf"(?i)\$[a-z]{{2,6}}{AFTER}")


def view_count(x: Column) -> Column:
    """1234, 1,234, 1.2K, 3 m or digits within other text as a number; null if there are none."""
    text = F.trim(x)
    number = F.regexp_replace(F.regexp_extract(text, "^([0-9,.]+)", 1), ",", "")
    value = F.regexp_extract(number, r"^([0-9]*\.?[0-9]*)", 1).try_cast("double")
    last = F.upper(F.substring(text, -1, 1))
    unit = F.when(last == "K", 1e3).when(last == "M", 1e6).when(last == "B", 1e9).otherwise(1.0)
    digits = F.nullif(F.regexp_replace(x, "[^0-9]", ""), F.lit("")).try_cast("double")
    return F.when(text.rlike(r"^[0-9,.]+\s*[KMBkmb]?$"), value * unit).otherwise(digits)


def ascii_text(x: Column) -> Column:
    """The UTF-8 bytes of a text in base 64, on one line."""
    return F.translate(F.base64(F.encode(x, "UTF-8")), "\r\n", "")


def screen_name(x: Column) -> Column:
    return F.lower(collapse(F.regexp_replace(x, "^@", "")))


def tag_list(x: Column) -> Column:
    """Trimmed, lower-cased, without blanks, first of equals."""
    return F.array_distinct(F.filter(F.transform(x, lambda t: F.lower(collapse(t))), lambda t: t != ""))


def known_tag(x: Column) -> Column:
    """Tag by alias; anything unknown is other."""
    low = F.lower(collapse(x))
    for alias, tag in ALIASES.items():
        low = F.when(low == alias, tag).otherwise(low)
    return F.when(low.isin(TAGS), low).otherwise("other")


#: What a text to embed loses, in this order and with white space for WHITE: the mark of a repost with its author, that mark alone, links, mentions.  Without case the long s is an s, the sign of kelvins a k.
REPOST_BY, REPOST = r"(?i)^rt[WHITE]+@[A-Za-z0-9_\u017F\u212A]+:[WHITE]*", r"(?i)^rt[WHITE]+"
LINKS, MENTIONS = rf"(?i)http[s\u017F]?://[^WHITE]+|{BEFORE}t\.co/[^WHITE]+|{BEFORE}pic\.twitter\.com/[^WHITE]+", "@[A-Za-z0-9_]+"


def _without(x: Column, sign: str, pattern: str, instead: str) -> Column:
    """x with instead for what matches, which holds the sign."""
    return once(x, lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, instead)).otherwise(t))


def embedding_text(x: Column, white: str = WHITE) -> Column:
    """Without repost mark, links, mentions and hash signs; the collapsed text if nothing is left."""
    codes = "".join(rf"\x{{{ord(c):x}}}" for c in white)
    by, repost, links = (p.replace("WHITE", codes) for p in (REPOST_BY, REPOST, LINKS))
    bare = F.regexp_replace(F.regexp_replace(x, by, ""), repost, "")
    for noise in (("/", links, " "), ("@", MENTIONS, " "), ("#", r"#([\p{L}\p{N}_]+)", "$1")):
        bare = _without(bare, *noise)
    return once(collapse(bare, white), lambda found: F.when(found == "", collapse(x, white)).otherwise(found))


def language_lead(lang: Column) -> Column:
    """The mark of a language in front of a text; empty without a language."""
    return F.when(lang != "", F.concat(F.lit("[lang:"), lang, F.lit("] "))).otherwise("")


def embedding_input(x: Column, lang: Column, n: int = 320) -> Column:
    """The text to embed, with its language, if known, in front, cut to n code points."""
    return cut(F.trim(F.concat(once(F.lower(collapse(lang)), language_lead), embedding_text(x))), n)  # both parts are collapsed


def filter_tags(x: Column) -> Column:
    """Tags as filters know them: tag_list, with others as other."""
    return F.array_distinct(F.transform(tag_list(x), lambda t: F.when(t == "others", "other").otherwise(t)))


def author_title(name: Column, handle: Column) -> Column:
    """name (@handle); the name alone where it holds the handle, @handle without a name, Unknown without either."""
    n, h = F.nullif(strip(name), F.lit("")), F.nullif(strip(F.regexp_replace(handle, "^@", "")), F.lit(""))
    at = F.concat(F.lit("@"), h)
    return F.when(n.isNotNull() & h.isNotNull() & ~F.contains(F.lower(n), F.lower(h)), F.concat(n, F.lit(" ("), at, F.lit(")"))).otherwise(F.coalesce(n, at, F.lit("Unknown")))


def post_url(url: Column, handle: Column, post: Column) -> Column:
    """The url if it is one, else the address made of handle and id."""
    return F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit("https://twitter.com/"), F.coalesce(F.regexp_replace(handle, "^@", ""), F.lit("i/web")), F.lit("/status/"), post.cast("string")))


def lang_group(lang: Column) -> Column:
    low = F.lower(strip(lang))
    return F.when(F.startswith(low, F.lit("zh")), "zh").when(F.startswith(low, F.lit("en")), "en").otherwise("other")


def size_group(x: Column) -> Column:
    n = F.length(strip(x))
    return F.when(n < 80, "short").when(n <= 160, "medium").otherwise("long")


def json_text(x: Column) -> Column:
    """The JSON within an answer: what a ```json fence holds, else from the first { to the last }, else the text."""
    text = strip(x)
    fenced = F.nullif(strip(F.regexp_extract(text, r"(?is)```json\s*(.*?)```", 1)), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), text)


def listed(x: Column) -> Column:
    """The items of a list written with commas (either width) or on lines."""
    return F.filter(F.transform(F.split(x, "[,，\n]"), strip), lambda t: t != "")


def error_kind(x: Column) -> Column:
    low = F.lower(x)
    busy = F.contains(low, F.lit("503")) | F.contains(low, F.lit("too busy"))
    return F.when(F.contains(low, F.lit("content exists risk")), "content-risk").when(busy, "service-busy").otherwise("failed")


def thread_id(x: Column) -> Column:
    """A whole number above 0, or null."""
    number = F.when(strip(x).rlike("^[0-9]+$"), strip(x).try_cast("long"))
    return F.when(number > 0, number)


def local_minute(at: Column, zone: str) -> Column:
    """A UTC time as YYYY-MM-DD HH:mm of the zone."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm")


def raw_views(raw: Column) -> Column:
    """The view count of a raw JSON object; null where it is no object or its views are neither text nor number."""
    return view_count(F.when(raw.rlike(r"^\s*\{"), F.get_json_object(raw, "$.views")))


def length_bucket(n: Column) -> Column:
    out = F.when(n <= 40, "0-40")
    for label, top in (("41-80", 80), ("81-140", 140), ("141-200", 200), ("201-260", 260)):
        out = out.when(n <= top, label)
    return out.otherwise("261+")


def view_bucket(v: Column) -> Column:
    """Values between the bounds (999.5) and below 0 fall into the last bucket, as at the source."""
    return F.when(v.between(0, 999), "0-1k").when(v.between(1000, 4999), "1k-5k").when(v.between(5000, 9999), "5k-10k").otherwise("10k+")


#: What stands before and after a post's id that becomes a link, tried in this order, and where the link leads.
ID_PLACES = [(r"(\()", r"(\))"), (r"(（来源[:：]?\s*)", "(）)"), (r"(?m)(^-\s+)", r"(\s*)$"), (r"(?i)(tweet\s*id[:：]\s*)", "()")]
ID_LINK = "https://x.com/i/web/status/"


def linked_ids(markdown: Column) -> Column:
    """The text with links for ids (ten digits or more) in brackets, as sources, alone in a list's line, and after their name."""
    for before, after in ID_PLACES:
        markdown = F.regexp_replace(markdown, f"{before}([0-9]{{10,}}){after}", f"$1[$2]({ID_LINK}$2)$3")
    return markdown
