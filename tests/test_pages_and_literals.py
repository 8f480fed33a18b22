"""Visible text of nested and broken pages, and lists written as literals, against tables written by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import html, text

PAGES = [
    ("<p>a</p><p>b</p>", "a\nb"),
    ("<svg><style>..</style><text>HID</text></svg>x", "x"),
    ("<svg><g><svg>a</svg>b</g></svg>c", "c"),
    ("<noscript><iframe src=a>in</iframe>t</noscript>y", "y"),
    ("<noscript><p>a<noscript>b</noscript>c</p></noscript>d", "d"),
    ("<iframe><p>a</iframe>b", "b"),
    ("<div><svg>a</div>b", "b"),  # the outer element's end closes what is open inside
    ("<svg><div>a</svg>b</div></svg>c", "c"),  # </svg> can't close through a block
    ("<svg>a", ""),
    ("a<svg/>b", "a\nb"),
    ("<iframe src='x'/>z", "z"),
    ("<script>if (a</b) '</p>' && \"<p>\"</script>k", "k"),
    ("<SCRIPT type=x>a</ScRiPt >k", "k"),
    ("<style>p{content:'</p>'}</style>k", "k"),
    ("<script>never closed <p>a</p>", ""),
    ("<script>a</scripture>b</script>c", "c"),
    ("&eacute;&#8217;&#x41;&hearts;", "é’A♥"),
    ("&amp;lt; &ampx &nosuch;", "&lt; &x &nosuch;"),
    ("a<!-- <p>c</p> -->b", "a\nb"),
    ("a<!-->b", "a\nb"),
    ("a<!-- never closed <p>b</p>", "a"),
    ("a < b > c", "a < b > c"),
    ("a</x>b", "ab"),  # an end tag without its beginning is nothing
    ("<p title=\"x>y\" alt='<p>'>q</p>", "q"),
    ("<a href=\"x>q</a><p>r</p>", "q\nr"),
    ("<p>a<br>b<br/>c<img src=x>d", "a\nb\nc\nd"),
    ("<td>a</b></td><b>c<td>d</b>e</td>f", "a\nc\nd\ne\nf".replace("d\ne", "de")),  # </b> can't close through a cell
    ("<!DOCTYPE html><?xml x?><html><head><title>T</title></head><body>b</body></html>", "T\nb"),
    ("<p>a</p>\n\n\n<p>b</p>\n<p> c  \t d </p>", "a\n\nb\n\n c d"),
    ("<template>a<p>b</p></template><ruby>x<rt>y</rt></ruby>", "x"),
    ("<p>end <b", "end"),
    ("", ""),
    (None, ""),
    ("日本<b>語</b> 😀", "日本\n語\n 😀"),
]


def test_visible_text_of_nested_and_broken_pages(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "i int, p string")
    got = {r.i: r.t for r in rows.select("i", html.visible_text(F.col("p")).alias("t")).collect()}
    assert [got[i] for i in range(len(PAGES))] == [want for _, want in PAGES]


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<!--", "<", "&", "<a b='", "</div>", "<b></i>", "<svg>", "<b>", "<![CDATA[", "<p x=y"])
def test_visible_text_takes_linear_time(piece):
    html._visible(piece * 100_000)


LITERALS = [
    ("""["it's", 'b']""", ["it's", "b"]),
    ("['A', ' b ']", ["a", "b"]),
    ("[]", []),
    ("[ ]", []),
    ("['a',]", ["a"]),
    ("""['say "x"', "y"]""", ['say "x"', "y"]),
    (r"['it\'s', 'a\\b']", ["it's", "a\\b"]),
    (r"['é', '\x41', '\n']", ["é", "a"]),
    ("['a', 1, None, True, 2.5, 'b']", ["a", "b"]),
    ("['a', ['b', 'c'], ('d',), {'e': 'f'}]", ["a"]),
    ('["a", null, true, "b"]', ["a", "b"]),
    ("['a' 'b', 'c']", ["ab", "c"]),
    ("['a', '']", ["a"]),
    ("['a, b', 'c]']", ["a, b", "c]"]),
    ("  ['a']  ", ["a"]),
    ("('a', 'b')", None),
    ("'a'", None),
    ("{'a': 1}", None),
    ("['a', 'b'", None),
    ("['a'; 'b']", None),
    ("[a, b]", None),
    ("['it's']", None),
    ("[open('x')]", None),
    ("['a\nb']", None),
    ("nonsense", None),
    ("", None),
    (None, None),
    ("[" * 5000, None),
    ("[,]", None),
    ("['a',,'b']", None),
]


def test_literal_lists(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(LITERALS)], "i int, p string")
    got = {r.i: r.t for r in rows.select("i", text.literal_list(F.col("p")).alias("t")).collect()}
    assert [(LITERALS[i][0], got[i]) for i in range(len(LITERALS))] == LITERALS


def test_long_literal_list(spark):
    rows = spark.range(1).select(F.concat(F.lit('["'), F.repeat(F.lit("it's\", '"), 1), F.lit("b']")).alias("p"), F.concat(F.lit("["), F.repeat(F.lit("'a', "), 200_000), F.lit("'b']")).alias("q"))
    got = rows.select(text.literal_list(F.col("p")).alias("p"), F.size(text.literal_list(F.col("q"))).alias("n")).first()
    assert got.p == ["it's", "b"] and got.n == 200_001
