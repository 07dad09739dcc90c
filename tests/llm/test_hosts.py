import re

from nearfield.llm import hosts


def test_query_matches_sql(same_rows):
    same_rows(hosts.query, hosts.SQL)


def brute(url):
    m = re.search(r"://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in hosts.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.net/en/x?y#z", "http://a.Example.NET/fr", "http://net", "http://net/", "ftp://x.org/fr/", "http://org?a=/fr/", "http://ex.example.com/de/#", "://x.net/a", "http://É.net/é", "http://a.b://c.net/", "http://notnet/"]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_urls_and_rules(spark):
    got = hosts.judge(pages(spark, URLS), labels(spark, [])).orderBy("page_id").collect()
    for r, u in zip(got, URLS, strict=True):
        host, path, rule, verdict = brute(u)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), u


def test_bad_hosts_are_blocked_and_few_labels_are_not_enough(spark):
    urls = [f"http://bad.a.com/{i}" for i in range(60)] + [f"http://good.a.com/{i}" for i in range(60)] + ["http://new.a.com/1", "http://one.b.com/1"]
    rows = [(i, 0, 0) for i in range(50)] + [(60 + i, 1, 0) for i in range(50)] + [(121, 0, 0), (3, None, 0), (None, 0, 0), (999, 0, 0)]
    got = {r["page_id"]: r["verdict"] for r in hosts.judge(pages(spark, urls), labels(spark, rows)).collect()}
    assert len(got) == len(urls)
    assert {got[i] for i in range(60)} == {"block"} and {got[i] for i in range(60, 120)} == {"allow"}
    assert got[120] == "allow" and got[121] == "allow"


def test_empty_tables(spark):
    assert hosts.judge(pages(spark, []), labels(spark, [])).collect() == []


def test_suffixes_of_two_labels_part_unrelated_sites(spark):
    names = ["a.example.co.uk", "co.uk", "uk", "example.com", "www.b.example.com", "x.com.au", ""]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, host string")
    domain, suffix = hosts.domain_and_suffix(df["host"])
    got = df.select("i", domain.alias("d"), suffix.alias("s")).orderBy("i").collect()
    assert [(r["d"], r["s"]) for r in got] == [("example.co.uk", "co.uk"), ("co.uk", "co.uk"), ("uk", "uk"), ("example.com", "com"), ("example.com", "com"), ("x.com.au", "com.au"), ("", "")]


def test_a_hot_blocked_host_and_repeated_pages(spark):
    urls = ["http://bad.co.uk/x"] * 300 + ["http://fine.co.uk/x"] * 100
    rows = [(i, 0, 0) for i in range(200)] + [(300 + i, 1, 0) for i in range(100)]
    got = hosts.judge(pages(spark, urls).unionByName(pages(spark, urls)), labels(spark, rows)).groupBy("host", "verdict").count().collect()
    assert {(r["host"], r["verdict"], r["count"]) for r in got} == {("bad.co.uk", "block", 600), ("fine.co.uk", "allow", 200)}
