import pytest

from larder.llm import urls
from larder.llm.queries import RULES

PAGES = "page_id long, url string"


def judged(spark, rows, outcomes=(), **options):
    pages = spark.createDataFrame(rows, PAGES)
    known = spark.createDataFrame(list(outcomes), "page_id long, good int")
    return {r.page_id: r for r in urls.judge(pages, known, RULES, **options).collect()}


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "https://WWW.Example.org/es/1?x#y"),
        (2, "http://example.org/en/12"),
        (3, "http://example.org/en/2"),
        (4, "http://a.com/fr/x"),
        (5, "http://a.com/de/x"),
        (6, "http://notexample.org/es/1"),
        (7, None),
        (8, "no scheme/path"),
        (9, "http://a.com?q=/de/"),
        (10, "http://://x/y"),
        (11, "ftp://HOST.Éa/P#f"),
        (12, "http://org/"),
    ]
    found = judged(spark, rows)
    assert (found[1].host, found[1].path, found[1].rule) == ("www.example.org", "/es/1", "example.org/es/")
    assert [found[i].rule for i in (2, 3, 4, 5, 6)] == ["example.org/en/1", "org/", "com/fr/", "com/de/", "org/"]
    assert [found[i].verdict for i in (1, 2, 3, 4, 5)] == ["block", "block", "allow", "allow", "block"]
    assert [(found[i].host, found[i].path, found[i].rule) for i in (7, 8)] == [("", "", None)] * 2
    assert (found[9].host, found[9].path) == ("a.com", "")
    assert (found[10].host, found[10].path) == (":", "//x/y")
    assert (found[11].host, found[11].path) == ("host.Éa", "/P")
    assert found[12].rule == "org/"


def test_suffixes_by_the_longest_rule(spark):
    hosts = {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "uk": ("uk", "uk"), "x.gov.uk": ("gov.uk", "x.gov.uk"),
        "a.me.github.io": ("github.io", "me.github.io"), "github.io": ("github.io", "github.io"),
        "a.b.c.ck": ("c.ck", "b.c.ck"), "c.ck": ("c.ck", "c.ck"), "ck": ("ck", "ck"), "a.www.ck": ("ck", "www.ck"),
        "www.ck": ("ck", "www.ck"), "": ("", ""), "a..b": ("b", ".b"), "x" + ".y" * 5000 + ".net": ("net", "y.net"),
    }
    rows = spark.createDataFrame([(h, i) for i, h in enumerate(hosts)], "host string, n int")
    found = urls.with_domains(rows).collect()
    assert {r.host: (r.suffix, r.domain) for r in found} == hosts and sorted(r.n for r in found) == list(range(len(hosts)))
    plain = urls.with_domains(rows, suffixes=()).where("host = 'a.b.co.uk'").first()
    assert (plain.suffix, plain.domain) == ("uk", "co.uk")
    with pytest.raises(ValueError):
        urls.with_domains(rows, suffixes=["a"] * (urls.MOST_SUFFIXES + 1))


def test_clashing_columns_change_nothing(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.net/x", "h", "p", "s", 1.0), (2, None, None, None, None, None)],
        PAGES + ", host string, path string, suffix string, rate double",
    )
    outcomes = spark.createDataFrame([(1, 1, "z")], "page_id long, good int, host string")
    found = {r.page_id: (r.host, r.path) for r in urls.judge(pages, outcomes, RULES).collect()}
    assert found == {1: ("a.net", "/x"), 2: ("", "")}


def test_hosts_shrink_towards_their_domains(spark):
    rows, outcomes = [], []
    for i in range(400):
        rows.append((i, f"http://{'good' if i % 2 else 'bad'}.net/{i}"))
        outcomes.append((i, int(i % 2 or i % 10 == 0)))
    rows += [(1000, "http://new.good.net/"), (1001, "http://new.bad.net/"), (1002, "http://one.bad.net/")]
    outcomes.append((1002, 1))
    found = judged(spark, rows, outcomes)
    assert found[1].verdict == "allow" and found[0].verdict == "block"
    assert found[1000].rate == pytest.approx(found[1].rate, abs=0.1)
    # One good page moves a host up from its domain, but not to the rate it shows.
    assert found[1001].rate < found[1002].rate < 0.9
    assert all(0 <= r.rate <= 1 and r.bound <= r.rate for r in found.values())


def test_odd_outcomes_and_empty_tables(spark):
    rows = [(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://b.net/"), (2, None)]
    outcomes = [(1, None), (1, 7), (None, 1), (9, 0)]
    found = urls.judge(
        spark.createDataFrame(rows, PAGES), spark.createDataFrame(outcomes, "page_id long, good int"), RULES
    ).collect()
    assert len(found) == 4 and all(r.verdict == "block" for r in found)
    assert judged(spark, []) == {}


def test_too_many_rules_are_refused(spark):
    with pytest.raises(ValueError):
        urls.rule_verdict(None, None, [("allow", "a", "/")] * (urls.MOST_RULES + 1))
