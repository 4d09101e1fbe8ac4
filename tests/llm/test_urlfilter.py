import datetime
import random

from pathlore.llm import urlfilter


def test_intervals_and_verdicts(spark):
    events = spark.createDataFrame(
        [("evil.com", 10, "block"), ("evil.com", 10, "block"), ("evil.com", 20, "remove"), ("evil.com", 30, "block"), ("ok.evil.com", 0, "allow"), ("tie.org", 5, "allow"), ("tie.org", 5, "block"), (None, 1, "block"), ("x.com", None, "block"), ("y.com", 1, "other")],
        "domain string, listed_at int, action string",
    )
    rows = [(1, "http://a.evil.com/x", 9), (2, "http://A.EVIL.com:80/x", 10), (3, "https://u@evil.com./", 19), (4, "http://evil.com", 20), (5, "http://evil.com", 99), (6, "http://ok.evil.com/", 15), (7, "http://notevil.com", 15), (8, "http://tie.org", 5), (9, None, 5), (10, "no url", 5), (11, "http://tie.org", None), (8, "http://tie.org", 5), (12, "http://x.com/" + "a" * 100_000, 3)]
    captures = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, fetched_at int, domain string")
    out = urlfilter.verdicts(captures, events).collect()
    assert sorted((r.page_id, r.matched_domain, r.blocked) for r in out if r.matched_domain) == [(2, "evil.com", True), (3, "evil.com", True), (5, "evil.com", True), (6, "ok.evil.com", False), (8, "tie.org", True), (8, "tie.org", True)]
    assert len(out) == len(rows)
    assert urlfilter.keep_allowed(captures, events.limit(0)).count() == len(rows)
    assert urlfilter.verdicts(captures.limit(0), events).count() == 0


def brute(captures, events):
    out = []
    for key, host, t in captures:
        best = None
        for i in range(host.count(".") + 1):
            domain = host.split(".", i)[-1]
            own = [(at, -urlfilter.ACTIONS.index(a), a) for d, at, a in events if d == domain and at <= t]
            if own and (last := max(own))[2] != "remove":
                best = best or (domain, last[2], last[0])
        out.append((key, *(best or (None, None, None))))
    return sorted(out)


def test_as_of_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.b.c", "b.c", "c", "x.b.c", "x.y.z", "z"]
    events = sorted({(rng.choice(hosts), rng.randrange(0, 40), rng.choice(urlfilter.ACTIONS)) for _ in range(40)})
    captures = [(i, rng.choice(hosts), rng.randrange(0, 45)) for i in range(400)]
    e = spark.createDataFrame(events, "domain string, listed_at long, action string")
    c = spark.createDataFrame([(i, f"http://{h}/p", t) for i, h, t in captures], "page_id long, url string, fetched_at long")
    want = brute(captures, events)
    got = sorted(tuple(r) for r in urlfilter.verdicts(c, e).select("page_id", "matched_domain", "list_action", "listed_at").collect())
    assert got == want
    points = c.select(urlfilter.host_of(c.url).alias("domain"), c.fetched_at.cast("double").alias("x")).distinct()
    many, one = (sorted(map(tuple, urlfilter.as_of(points, urlfilter.folded(e), b).collect())) for b in (7, 10**6))
    assert many == one and many


def test_clashing_columns_and_dates(spark):
    e = spark.createDataFrame([("evil.com", datetime.date(2024, 1, 5), "block")], "domain string, listed_at date, action string")
    row = (1, "http://evil.com", datetime.date(2024, 1, 5), "b", "h", True, "x", 4)
    c = spark.createDataFrame([row, (2, "http://evil.com", datetime.date(2024, 1, 4), "b", "h", True, "x", 4)], "page_id long, url string, fetched_at date, b string, _host string, blocked boolean, domain string, rank int")
    out = {r.page_id: r for r in urlfilter.verdicts(c, e).collect()}
    assert out[1].blocked and not out[2].blocked and out[1].b == "b" and out[1]._host == "h" and out[1].listed_at == datetime.date(2024, 1, 5)
    kept = urlfilter.keep_allowed(c, e)
    assert kept.columns == c.columns and [r.page_id for r in kept.collect()] == [2] and kept.first().blocked
    long = spark.createDataFrame([(1, "http://" + "a." * 50_000 + "evil.com/x", datetime.date(2024, 1, 5))], "page_id long, url string, fetched_at date")
    assert [r.blocked for r in urlfilter.verdicts(long, e).collect()] == [True]


def test_any_host(spark):
    e = spark.createDataFrame([(d, 0, "block") for d in ("evil.com", "2001:db8::1", "a.b.c.d.e", "1.2.3.4", "3.4")] + [("x." * 3000 + "org", 0, "block")], "domain string, listed_at int, action string")
    urls = {
        "http://" + "a" * 400 + ".evil.com/": "evil.com",
        "http://" + "y." * 40_000 + "x." * 3000 + "org": "x." * 3000 + "org",
        "http://" + "x." * 2999 + "org": None,
        "http://[2001:DB8::1]/": "2001:db8::1",
        "https://u@[2001:db8::1]:8080/x": "2001:db8::1",
        "http://[::ffff:9.9.3.4]/": None,
        "http://[2001:db8::1": None,
        "http://[]/": None,
        "//evil.com/x": None,
        "http:\\\\evil.com": None,
        "http://z.a.b.c.d.e:1?q": "a.b.c.d.e",
        "http://b.c.d.e": None,
        "http://1.2.3.4/": "1.2.3.4",
        "http://evil.com..:80/": "evil.com",
    }
    c = spark.createDataFrame([(i, u, 5) for i, u in enumerate(urls)], "page_id long, url string, fetched_at int")
    got = {r.page_id: r.matched_domain for r in urlfilter.verdicts(c, e).collect()}
    assert got == dict(enumerate(urls.values()))
