"""Text, titles, links and facts out of stored HTML, as Column expressions. Visible text needs a stack of open elements, and so
an Arrow batch function; all else is native. The accepted subset is pinned in tests."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .numbers import compact, scaled, users
from .text import squeeze, strip, text_or_blank

#: Entities that are decoded in short values (fixed values); the ampersand comes last. Visible text knows all of them.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
#: Elements whose content isn't shown, whose content is raw text, that have no content, and whose own text isn't part of a
#: page's text (fixed values).
HIDDEN = frozenset({"script", "style", "noscript", "svg", "iframe"})
RAW = frozenset({"script", "style"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset({"template", "rt", "rp"})
#: Open elements beyond which further ones, unless hidden, aren't told from the text around them, as in browsers.
DEPTH = 512
#: What an end tag can't close through: elements of a higher rank than its own (fixed values).
RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}
#: Schemes that don't lead to a web page (fixed values).
NOT_WEB = r"(?i)^(mailto|tel|sms|market|itms[a-z-]*|javascript|data|intent|about):"


def decoded(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


#: Comments, tags (attributes may hold > in quotes), declarations. Each alternative is linear: none gives back what it took.
_MARKUP = re.compile(
    r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?:(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*+)>|[^<>]*+(?:>|(?=<)|\Z))|<[!?/][^>]*+(?:>|\Z)""",
    re.DOTALL,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_BLANKS = (re.compile(r"\n{2,}"), re.compile(r"[ \t]{2,}"))


def text_nodes(page: str) -> list[str]:
    """The text nodes outside hidden elements, in order, with all entities decoded.

    One pass with a stack of open elements. An end tag closes the nearest open element of its name and all inside it, but not
    through an element of a higher rank; without such an element it is ignored, and the text goes on. Script and style end at
    their own end tag only. Elements that aren't closed end with the element around them.
    """
    out: list[str] = []
    held: list[str] = []
    stack: list[str] = []
    open_: Counter[str] = Counter()
    hidden = at = 0

    def flush() -> None:
        if held:
            text = unescape("".join(held))
            held.clear()
            if not hidden and text:
                out.append(text)

    def aside(name: str) -> bool:
        return name in HIDDEN or name in ASIDE

    while True:
        m = _MARKUP.search(page, at)
        held.append(page[at : m.start()] if m else page[at:])
        if m is None:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:  # a comment or a declaration parts texts
            flush()
        elif m["end"]:
            rank = RANK.get(name, 100)
            for i in range(len(stack) - 1, -1, -1) if open_[name] else ():
                if stack[i] == name:
                    flush()
                    hidden -= sum(map(aside, stack[i:]))
                    open_.subtract(stack[i:])
                    del stack[i:]
                    break
                if RANK.get(stack[i], 100) > rank:
                    break
        else:
            flush()
            if name in VOID or (m["rest"] or "").endswith("/"):
                continue
            if name in RAW:
                end = _RAW_END[name].search(page, at)
                at = end.start() if end else len(page)
            if aside(name) or len(stack) < DEPTH:
                stack.append(name)
                open_[name] += 1
                hidden += aside(name)
    flush()
    return out


def _visible(page: str | None) -> str:
    text = "\n".join(text_nodes(page or ""))
    return _BLANKS[1].sub(" ", _BLANKS[0].sub("\n\n", text)).strip()


@F.pandas_udf(StringType())
def _visible_texts(pages: pd.Series) -> pd.Series:
    return pages.map(_visible)


def visible_text(html: Column) -> Column:
    """The text outside hidden elements: its nodes joined by line breaks, at most one blank line in a row, single blanks."""
    return _visible_texts(html)


def page_title(html: Column) -> Column:
    return F.nullif(squeeze(decoded(F.regexp_extract(text_or_blank(html), r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def trimmed(c: Column, most: int = 100_000) -> Column:
    """Without blanks at the ends of lines, cut at ``most`` characters."""
    return F.substring(F.regexp_replace(text_or_blank(c), r"[ \t]+(?=\n|$)", ""), 1, most)


def web_url(c: Column) -> Column:
    """A usable web address, https by default; null for other schemes and for hosts without a dot."""
    u = strip(text_or_blank(c))
    full = F.when(u.rlike(r"(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    host = F.regexp_extract(full, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when((u != "") & ~u.rlike(NOT_WEB) & host.contains("."), full)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(text_or_blank(url), r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def links(html: Column) -> Column:
    """All targets of links, in order."""
    return F.regexp_extract_all(text_or_blank(html), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"'#]+)"""), F.lit(1))


def external_link(html: Column, own: str = r"(?i)^https?://([^/]*\.)?(google|gstatic|googleapis|chrome)\.[a-z.]+(/|$)") -> Column:
    """The first link to another site than the store's own."""
    return F.get(F.filter(links(html), lambda x: x.rlike(r"(?i)^https?://") & ~x.rlike(own)), F.lit(0))


def labelled_link(html: Column, *names: str) -> Column:
    """The target of the first link with one of these texts."""
    found = [F.nullif(F.regexp_extract(text_or_blank(html), rf"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"'#]+)["'][^>]*>(?:\s*<[^>]*>)*\s*{n}\b""", 1), F.lit("")) for n in names]
    return F.coalesce(*found)


def website(html: Column) -> Column:
    """The developer's site: a link named so, else the text of such an element, else the first link to another site."""
    return F.coalesce(web_url(labelled_link(html, "Visit website", "Website")), web_url(value_after(html, "Website")), external_link(html))


def play_id(link: Column) -> Column:
    return F.nullif(F.regexp_extract(link, r"[?&]id=([A-Za-z0-9._]+)", 1), F.lit(""))


def cws_id(link: Column) -> Column:
    return F.nullif(F.regexp_extract(link, r"/([a-p]{32})(?:[/?#]|$)", 1), F.lit(""))


def value_after(html: Column, name: str) -> Column:
    """The text of the element that follows the element with this text."""
    return F.nullif(squeeze(decoded(F.regexp_extract(text_or_blank(html), rf"(?is)>\s*{name}\s*:?\s*<(?:/[^>]*>\s*<)+[^>]*>\s*([^<]+?)\s*<", 1))), F.lit(""))


def section(text: Column, stops: tuple[str, ...] = ("Details", "Privacy", "Support")) -> Column:
    """The text before the first line that is one of the stop words."""
    return strip(F.get(F.split(text_or_blank(text), r"(?m)^(?:" + "|".join(stops) + r")\s*$", 2), F.lit(0)))


def rating(text: Column) -> tuple[Column, Column]:
    """(average, count) of a rating that is written out: "4.6 out of 5", "1.2K ratings"."""
    avg = F.regexp_extract(text_or_blank(text), r"(\d(?:\.\d+)?)\s*(?:out of 5|stars?\b|★|/\s*5)", 1).try_cast("double")
    count = F.nullif(F.regexp_extract(text_or_blank(text), r"(?i)([\d.,]+[km]?)\s+(?:ratings?|reviews?)\b", 1), F.lit(""))
    return avg, F.when(count.isNotNull(), F.when(count.rlike(r"(?i)[km]$"), scaled(count)).otherwise(compact(count)))


def user_count(text: Column) -> Column:
    return users(text)


def icon(html: Column) -> Column:
    t = text_or_blank(html)
    og = F.regexp_extract(t, r"""(?is)<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)""", 1)
    rel = F.regexp_extract(t, r"""(?is)<link[^>]+rel=["'][^"']*icon[^"']*["'][^>]+href=["']([^"']+)""", 1)
    img = F.regexp_extract(t, r"""(?is)<img[^>]+src=["']([^"']+)""", 1)
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (og, rel, img)))


def linked_data(html: Column) -> Column:
    """The page's first JSON-LD object as VARIANT."""
    raw = F.regexp_extract(text_or_blank(html), r"""(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>""", 1)
    v = F.try_parse_json(F.nullif(strip(raw), F.lit("")))
    return F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v)


def longer_of(first: Column, second: Column, least: int) -> Column:
    """The first text if it is long enough, else the longer of the two."""
    a, b = text_or_blank(first), text_or_blank(second)
    return F.when(F.length(a) >= least, a).when(F.length(b) > F.length(a), b).otherwise(a)
