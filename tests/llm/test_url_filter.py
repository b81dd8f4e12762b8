from treeledger.llm import url_filter as uf

URLS = [
    "http://a.example.org/es/1", "https://example.org/en/12?x", "https://notexample.org/es/1", "http://EXAMPLE.com/de/x", "http://x.com/fr/1#a", "http://com/fr/", "http://x.org", None, "", "no scheme",
    "://h/p", "http://h?q=/x", "http://h#f", "a://b://c/d", "http://ÉX.org/p", "http://y.net/a\nb", "https://casino-win.example.net/slots",
]


def rule_of(host, path):
    fits = [(len(h + p), h + p, a) for a, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_parts_rules_and_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    for r in uf.judge_urls(pages).collect():
        host, path = uf.split_url(URLS[r.page_id])
        rule, action = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        assert r.verdict == (action or ("block" if r.block_score >= 0.5 else "allow"))
    assert uf.judge_urls(pages.limit(0)).collect() == []


def test_longest_rule_wins():
    assert rule_of("www.example.org", "/es/x") == ("example.org/es/", "block")
    assert rule_of("org", "/") == ("org/", "allow") and rule_of("org", "") == (None, None)


def test_classifier_learns_its_table_and_the_like():
    weights, bias = uf.train(uf.labelled_urls())
    score = lambda u: (lambda g: 1 / (1 + 2.718281828 ** -(weights[g].sum() / len(g) ** 0.5 + bias)))(uf.buckets(*uf.split_url(u)))
    rows = uf.labelled_urls()
    assert sum((score(u) >= 0.5) == bool(y) for u, y in rows) / len(rows) > 0.95
    assert score("http://m.casino-win.example.org/en/5") > 0.5 > score("http://museum.example.org/en/5")
    assert uf.train([])[1] < 0
