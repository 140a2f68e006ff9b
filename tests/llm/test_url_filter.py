import pytest

from auditlake.llm import url_filter as uf


def frame(spark, urls):
    rows = list(enumerate(urls))
    return spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'x' AS host", "'y' AS verdict")


def judged(spark, urls, rules=uf.RULES):
    rows = uf.judged(frame(spark, urls), rules).collect()
    assert len(rows) == len(urls)
    return [r for _, r in sorted((r.page_id, r) for r in rows)]


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("no scheme.com/", "", "", None, "allow"),
        ("http://EXAMPLE.com/en/1?x#y", "example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("https://x.net/es/", "x.net", "/es/", "net/es/", "block"),
        ("https://x.net/es", "x.net", "/es", None, "allow"),
        ("https://com", "com", "", None, "allow"),
        ("https://com/a://b", "com", "/a://b", "com/", "allow"),
        ("x://h?/p", "h", "", None, "allow"),
        ("x://\u00c9H#://", "\u00c9h", "", None, "allow"),
    ],
)
def test_host_path_and_rules(spark, url, host, path, rule, verdict):
    (row,) = judged(spark, [url])
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_templates_take_over_what_rules_say_of_their_pages(spark):
    """One host: numbers are wildcards, a node with many children is one, like branches merge."""
    rules = (("block", "h.org/shop/a"), ("allow", "h.org/news/"))
    urls = [f"http://h.org/shop/a{k}word/item" for k in range(30)] + [f"http://h.org/shop/b{k}/item" for k in range(5)]
    urls += [f"http://h.org/news/{k}.html" for k in range(9)] + ["http://h.org/about", "http://other.org/shop/ax/item"]
    rows = judged(spark, urls, rules)
    assert {r.template for r in rows[:30]} == {"/shop/a{n}word/item"}
    assert {r.verdict for r in rows[:30]} == {"block"} and rows[0].purity > 0.9
    assert {(r.template, r.verdict) for r in rows[30:35]} == {("/shop/b{n}/item", "allow")}
    assert {r.template for r in rows[35:44]} == {"/news/{n}.html"}
    assert rows[44].verdict == rows[45].verdict == "allow"
    names = [f"http://h.org/shop/a{chr(97 + k // 5)}{chr(97 + k % 5)}x/item" for k in range(25)] + ["http://h.org/shop/zz/item"]
    rows = judged(spark, names, rules)
    assert {r.template for r in rows} == {"/shop/*/item"}
    assert (rows[-1].rule, rows[-1].verdict) == (None, "block")


def test_like_branches_merge(spark):
    rules = (("block", "h.org/x/1"), ("block", "h.org/y/1"))
    urls = [f"http://h.org/{b}/1{k}" for b in "xy" for k in range(20)] + ["http://h.org/x/2", "http://h.org/y/2"]
    urls += [f"http://h.org/z/{k}/deep/{k}" for k in range(9)]
    rows = judged(spark, urls, rules)
    assert {r.template for r in rows[:42]} == {"/x/{n}"}
    assert rows[40].verdict == rows[41].verdict == "block"
    assert rows[42].template == "/z/{n}/deep/{n}" and rows[42].verdict == "allow"


def test_deep_long_repeated_and_empty(spark):
    deep = "http://h.org/" + "/".join(f"s{k}" for k in range(300))
    rows = judged(spark, [deep, deep, "http://h.org/" + "a" * 50_000, None, None])
    assert rows[0].template == rows[1].template and rows[0].template.count("/") == 300
    assert uf.judged(frame(spark, []) if False else frame(spark, ["x"]).limit(0)).count() == 0
