from itertools import combinations

from timberline.llm import url_filter as U

URLS = [f"http://{h}.example.{t}/{p}/{i}.html?utm={i}" for i, (h, t, p) in enumerate([("a", "com", "en"), ("spam", "com", "en"), ("b", "org", "de"), ("spam", "org", "fr")] * 15)]


def _host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path[:end]


def _fixed(host, path):
    best = None
    for h, p, v in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def test_fixed_rules(spark):
    urls = [
        "http://X.net/", "http://x.net", "http://example.net/en/1", "https://a.EXAMPLE.net/en/", "http://notexample.net/en/", "http://example.com/de/x?y", "http://example.com/de",
        "http://org/fr/", "http://b.org/fr/a", None, "", "x.net/", "a://b://c.net/x", "http://net:80/", "http://É.net/ü#x", "http://?x", "http://a.net\n/x",
    ]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in U.judge(pages, U.mine(pages.selectExpr("url", "cast(null as boolean) bad"))).collect()}
    for i, u in enumerate(urls):
        host, path = _host_path(u)
        rule = _fixed(host, path)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        assert (got[i]["rule"], got[i]["verdict"]) == (rule or (None, "allow")), u


def test_mined_rules_are_those_of_brute_force(spark):
    rows = [(u, "spam" in u or i % 13 == 0) for i, u in enumerate(URLS)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    got = {tuple(r["rule"]): (r["support"], r["confidence"]) for r in U.mine(labelled, min_support=0.2, min_confidence=0.6, min_rows=1).collect()}
    sets = [(set(r["t"]), b) for r, (_, b) in zip(labelled.select(U.tokens_of(labelled["url"]).alias("t")).collect(), rows)]
    least = 0.2 * len(rows)
    conf = {}
    items = sorted(set().union(*[s for s, _ in sets]))
    for n in range(1, 9):
        for c in combinations(items, n):
            if n > 1 and not all(p in conf for p in combinations(c, n - 1)):
                continue
            hits = [b for s, b in sets if set(c) <= s]
            if sum(hits) >= least:
                conf[c] = (sum(hits), sum(hits) / len(hits))
    want = {c: v for c, v in conf.items() if v[1] >= 0.6 and not any(p in conf and conf[p][1] >= v[1] for p in combinations(c, len(c) - 1) if p)}
    assert got == want and got


def test_judge_uses_mined_rules(spark):
    labelled = spark.createDataFrame([(u, "spam" in u) for u in URLS], "url string, bad boolean")
    rules = U.mine(labelled, min_support=0.1, min_confidence=0.9)  # half of the .com pages are bad
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, "http://spam.example.org/fr/new", None])], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in U.judge(pages, rules).collect()}
    for i, u in enumerate(URLS):
        rule = _fixed(*_host_path(u))
        assert got[i] == (rule[1] if rule else "block" if "spam" in u else "allow")
    assert got[len(URLS)] == "allow" and got[len(URLS) + 1] == "allow"  # a fixed rule wins
    assert U.judge(pages.limit(0), rules).count() == 0


def test_rules_in_parts_long_urls_and_repeated_rows(spark, monkeypatch):
    labelled = spark.createDataFrame([(u, "spam" in u) for u in URLS], "url string, bad boolean")
    rules = U.mine(labelled, min_support=0.1, min_confidence=0.9)
    long = "http://spam.example.com/" + "a/" * 20_000 + "?" + "&".join(f"k{i}={i}" for i in range(20_000))
    rows = [(i, u) for i, u in enumerate(URLS)] + [(7, URLS[7])] * 3 + [(None, URLS[1]), (None, URLS[0]), (900, long), (901, "http://" + "x" * 100_000), (902, "")]
    pages = spark.createDataFrame([(*r, "r", 0.5, "v") for r in rows], "page_id long, url string, row string, confidence double, token string")
    out = lambda: sorted(map(str, U.judge(pages, rules).collect()))
    whole = out()
    assert len(whole) == len(rows) and rules.count() > 1
    got = {r["page_id"]: r["verdict"] for r in U.judge(pages, rules).collect()}
    assert got[900] == "block" and got[901] == got[902] == "allow"
    monkeypatch.setattr(U, "SEND_RULES", 1)
    assert out() == whole
