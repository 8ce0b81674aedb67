import random
from collections import defaultdict

import pytest
from tierflow.llm.urls import DAMPING, host_links, judge, spread

PAGES = "page_id bigint, url string, html string"
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def judged(spark, rows, rules=RULES):
    return {r.page_id: r for r in judge(spark.createDataFrame(rows, PAGES), rules).collect()}


def test_hosts_paths_and_rules(spark):
    urls = [
        "HTTP://A.Example.NET/en/1?x=/de/#y",
        "https://example.net/EN/1",
        "https://notexample.net/en/",
        "x://example.com/de/1://z",
        "https://sub.example.com/fr/de/",
        "https://a.org/fr/",
        "https://a.org/fr",
        "https://net/x",
        "https://a.net",
        "https://a.net?q=/en/",
        "//no.net/scheme",
        "",
        None,
        "a\nb://h.net/\np?q",
    ]
    got = judged(spark, [(n, url, None) for n, url in enumerate(urls)])
    assert [(r.host, r.path, r.rule, r.verdict) for _, r in sorted(got.items())] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"),
        ("example.net", "/EN/1", "net/", "block"),
        ("notexample.net", "/en/", "net/", "block"),
        ("example.com", "/de/1://z", "example.com/de/", "block"),
        ("sub.example.com", "/fr/de/", None, "allow"),
        ("a.org", "/fr/", "org/fr/", "allow"),
        ("a.org", "/fr", None, "allow"),
        ("net", "/x", "net/", "block"),
        ("a.net", "", None, "allow"),
        ("a.net", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("h.net", "/\np", "net/", "block"),
    ]


def test_distrust_runs_against_links_and_trust_along(spark):
    def links(*hosts):
        return "".join(f'<A class="x" HREF="https://{h}/p">t</a>' for h in hosts)

    rows = [
        *((n, "https://bad.net/a", None) for n in (8, 9, 1)),
        (2, "https://farm.com/a", links("bad.net")),
        (3, "https://linked.com/a", None),
        (4, "https://second.com/a", links("farm.com")),
        (5, "https://saved.com/a", links("bad.net")),
        (6, "https://good.org/fr/", links("saved.com")),
        (7, "https://good.org/fr/2", "<a href='//saved.com/x'>x</a><a href=/own>o</a><a name=n>"),
    ]
    got = judged(spark, rows)
    assert {n: r.verdict for n, r in got.items() if n < 8} == {
        1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "allow",
    }


def test_spread_equals_a_sum_over_walks(spark):
    rng = random.Random(4)
    hosts = [f"h{n}" for n in range(40)]
    edges = {(rng.choice(hosts), rng.choice(hosts[:10] if rng.random() < 0.5 else hosts)) for _ in range(150)}
    edges = {(a, b) for a, b in edges if a != b}
    seeds = [(h, kind, float(rng.randint(1, 9))) for h in hosts[:9] for kind in ("trust", "distrust")]
    df = spread(
        spark.createDataFrame(seeds, "host string, kind string, mass double"),
        spark.createDataFrame(sorted(edges), "src string, dst string"),
    )
    got = {(r.host, r.kind): r.mass for r in df.collect()}
    total, last = defaultdict(float), {(h, k): m for h, k, m in seeds}
    for _ in range(25):
        for key, mass in last.items():
            total[key] += mass
        moved = defaultdict(float)
        for (host, kind), mass in last.items():
            out = [b for a, b in edges if a == host] if kind == "trust" else [a for a, b in edges if b == host]
            for other in out:
                moved[other, kind] += DAMPING * mass / len(out)
        last = {key: mass for key, mass in moved.items() if mass >= 1e-6}
    assert got.keys() == total.keys()
    assert all(got[key] == pytest.approx(total[key]) for key in got)


def test_distrust_of_many_pages_goes_down_a_long_chain(spark):
    rows = [(n, "https://h0.net/a", None) for n in range(1000)]
    rows += [(1000 + n, f"https://h{n}.com/a", f"<a href='https://h{n - 1}.{'com' if n > 1 else 'net'}/'>") for n in range(1, 31)]
    # 1000 * 0.85**30 is 7.6, more than half a page
    assert {r.verdict for r in judged(spark, rows).values()} == {"block"}


def test_mass_in_a_cycle_is_counted_to_the_end(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a", "trust", 1000.0)], "host string, kind string, mass double")
    got = {r.host: r.mass for r in spread(seeds, links, rest=50.0).collect()}
    whole = 1000 / (1 - DAMPING**2)
    assert whole - 50 < got["a"] <= whole and whole * DAMPING - 50 < got["b"] <= whole * DAMPING


def test_links_are_distinct_and_between_hosts(spark):
    html = "<a href=http://B.com/1><a href='http://b.com/2'><a href=\"https://a.com/x\"><a href=mailto:x@y>" * 50
    pages = spark.createDataFrame([("a.com", html), ("", html), ("c.com", None)], "host string, html string")
    assert [tuple(r) for r in host_links(pages).collect()] == [("a.com", "b.com")]


def test_repeated_rows_empty_table_and_clashes(spark):
    rows = [(1, "https://a.net/", None), (1, "https://a.net/", None), (None, "https://a.net/", None)]
    assert judge(spark.createDataFrame(rows, PAGES), RULES).count() == 3
    assert judge(spark.createDataFrame([], PAGES), RULES).count() == 0
    odd = spark.createDataFrame([(1, "u", "h", "x", "r")], PAGES + ", host string, rule string")
    assert judge(odd, RULES).columns == ["page_id", "host", "path", "rule", "verdict"]
    with pytest.raises(ValueError):
        judge(odd, {f"h{n}/": "block" for n in range(1001)})


def test_links_of_very_long_pages_are_found_in_time(spark):
    """A megabyte of tags that never end, and one long tag."""
    import time

    html = "<a " * 350_000 + "<a class=x href='http://b.net/'>" + "<a " + "x " * 300_000 + "href=http://c.net/>"
    pages = spark.createDataFrame([("a.net", html)], "host string, html string")
    began = time.time()
    assert {(r.src, r.dst) for r in host_links(pages).collect()} == {("a.net", "b.net"), ("a.net", "c.net")}
    assert time.time() - began < 60
