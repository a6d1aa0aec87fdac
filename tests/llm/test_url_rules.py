import random
import re

from candlewick.llm import url_rules
from candlewick.llm.entries import URL_RULES


def brute(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3] if fit else None, max(fit)[4] if fit else default)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    urls = [None, "", "no scheme.org/x", "http://", "://ORG/", "a://b://c.org/de/", "http://Éx.ORG/es/", "http://example.org/es/?q=://z.com/", "http://x..org/en/1\nb", "http://notexample.org/es/", "http://u@example.org:80/es/"]
    for _ in range(300):
        host = ".".join(rng.choices(["www", "example", "org", "com", "Com", "net", ""], k=rng.randint(1, 4)))
        urls.append(rng.choice(["http://", "https://"]) + host + rng.choice(["", "/", "/es/", "/es", "/en/1", "/en/12?x", "/fr/#a", "/de/y", "?/de/"]))
    rows = [*enumerate(urls), (3, urls[3]), (None, "http://a.com/de/"), (None, "http://a.com/de/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "'r' as rule")
    more = [*URL_RULES, ("block", "www.example.com", ""), ("allow", "example.org", "/es/"), ("block", None, "/")]
    for rules, bound in ((URL_RULES, 10), (more, 10), (more, 1)):
        real = [r for r in rules if r[1]]
        got = url_rules.judge(df, url_rules.rule_table(spark, rules), broadcast_rules=bound).collect()
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *brute(u, real)) for i, u in rows), key=key)
    assert url_rules.judge(df.limit(0), url_rules.rule_table(spark, URL_RULES)).count() == 0
    assert {r.verdict for r in url_rules.judge(df, url_rules.rule_table(spark, URL_RULES).limit(0)).collect()} == {"allow"}
