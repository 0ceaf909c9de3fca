from hypothesis import given, settings
from hypothesis import strategies as st

from stratakv.llm.url_filter import DEFAULT_RULES, Trie, filter_urls, split_url


def brute(rules, host, path):
    """Longest host, then longest path; block before allow."""
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(h), len(p), verdict == "block", verdict, rule))
    return max(fits)[3:] if fits else None


HOST = st.lists(st.sampled_from(["a", "b", "net", "org"]), min_size=1, max_size=4).map(".".join)
PATH = st.text("/ab", max_size=6).map(lambda p: "/" + p)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.builds(str.__add__, HOST, PATH)), max_size=8), HOST, st.one_of(PATH, st.just("")))
def test_longest_rule_wins(rules, host, path):
    assert Trie(rules).match(host, path) == brute(rules, host, path)


def test_parts():
    assert split_url("HTTP://A.Example.NET/En/x?y#z") == ("a.example.net", "/En/x")
    assert split_url("http://a.net#top/x") == ("a.net", "")
    assert split_url("http://a.net?x=/b") == ("a.net", "")
    assert split_url("http://ÀB.net/") == ("Àb.net", "/")
    assert split_url("no scheme") == split_url(None) == split_url("") == ("", "")


def test_rows(spark):
    urls = [None, "", "x", "http://a.net/", "https://www.example.net/en/1", "http://example.com/de/2", "http://fr.org/fr/", "http://net", "http://xnet/", "http://a.net/"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_urls(df).collect()}
    for i, u in enumerate(urls):
        want = brute(DEFAULT_RULES, *split_url(u))
        assert got[i] == ((want[1], want[0]) if want else (None, "allow"))
    assert filter_urls(df.limit(0)).count() == 0
