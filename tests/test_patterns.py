import random
import re

import duckdb
import pytest

from quarry.functions import patterns as P


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("(Tram|night bus|ferry)", ["tram", "night bus", "ferry"]), ("rail.way", ["rail"]), ("(?i:car|cab)", ["car", "cab"]), (".*", None),
        ("(railway|.*)", None), (r"rail\.way", ["rail.way"]), ("x|y", ["x", "y"]), ("(u|v)(w|x)", ["u"]),
    ],
)
def test_prefilter_literals(pattern, want):
    assert P.prefilter_literals(pattern) == want


@pytest.mark.parametrize(("pattern", "want"), [("a.*long_literal", "long_literal"), (".*", ""), (r"abc\.def", "abc.def"), ("(foo)?bar", "foo"), (r"\bdeploy\b", "bdeployb"), ("ab.cd", "ab")])
def test_longest_literal(pattern, want):
    assert P.longest_literal(pattern) == want


@pytest.mark.parametrize(("pattern", "want"), [("(u|v)(w|x)", "(u|v)(w|x)"), ("(?:up|down)", "up|down"), ("(up|down)", "up|down"), ("(?i:up|down)", "up|down"), ("rail", "rail"), ("(", "(")])
def test_outer_group(pattern, want):
    assert P.strip_outer_group(pattern) == want


def test_small_rules():
    assert [P.is_match_all(x) for x in ("-", ".", "*", ".*", "deploy.*prod", "--flag")] == [True] * 4 + [False] * 2
    assert P.normalize_bre(r"\(a\|b\)") == "(a|b)"
    assert P.normalize_bre(r"open\.claw") == r"open\.claw"
    assert P.is_short("abc") and not P.is_short("abcd") and not P.is_short(".*")
    assert P.near_miss_literal("abc") is None and P.near_miss_literal("abcd.*x") == "abcd"
    assert P.split_alternatives("a|(b|c)|d") == ["a", "(b|c)", "d"]


@pytest.mark.parametrize("pattern", [r"(a)\1", "(?<=x)y", "(?=x)", "(?!x)", "(?>x)", "a++", "a**", "c++", "*a", "(", ")", "[a", r"\Z", r"\k<n>", "a{2,1}", "a{1001}", "x\\"])
def test_refused(pattern):
    with pytest.raises(P.PatternError):
        P.to_java(pattern)


CASES = [
    "É", "foo$", r"a\sb", r"\ba", r"a\b", r"\Ba", "[[:alpha:]]+x", "[a&&b]", "(?P<n>x)y", "x.y", "^foo", "a{2,3}", "a{", "[]a]", "[^a-c]$", r"\d+", r"\w\W", r"\pL\p{Lu}",
    r"\x41", r"\Qa.b\E", "(?s)a.b", "(?m)^b$", "a|b|", "(a|b)*?c", "[\\s]x", r"\.", "straße", r"[\w.-]+", "(?:ab)+", "a?b", r"\PL", r"[^\W_]x", r"[^\S\n]", r"[\W]", "[[:^digit:]]z", r"\141",
]


def test_translated_patterns_match_what_re2_matches(spark):
    rng = random.Random(5)
    alphabet = "aAbBcfoxyzéÉß .\n\r\t\x0b&-_19ſK{"
    texts = ["foo\n", "foo", "éa", "ÉA", "a\x0bb", "a b", "x\ry", "x\ny", "A", "a.b", "a\nb", "STRASSE", "Straße"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 7))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").cache()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, t VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    wrong = {}
    for p in CASES:
        mine = {r["i"] for r in df.where(df.t.rlike(P.to_java(p))).collect()}
        flags = "" if re.match(r"\(\?[sm]", p) else "i"
        theirs = {r[0] for r in con.execute("SELECT i FROM t WHERE regexp_matches(t, ?, 'i')", ["(?-s)" + p]).fetchall()} if flags else {r[0] for r in con.execute("SELECT i FROM t WHERE regexp_matches(t, ?)", ["(?i)" + p]).fetchall()}
        if mine != theirs:
            wrong[p] = [(texts[i], i in mine) for i in mine ^ theirs][:4]
    assert not wrong
