import random

from docproof.llm import urls


def slow_judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in rules if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not fits:
        return host, path, None, "allow"
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2]))
    return host, path, best[0] + best[1], best[2]


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "", "block"),
         ("a.com", "/x", "allow"), ("b.a.com", "/", "block"), ("a.com", "/xy", "block"), ("a.com", "/xy", "allow")]
FIXED = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/?q", "http://example.org?x=/es/", "ftp://org/", "http://xorg/",
         "http://b.a.com/xyz#f", "http://a..com/x", "http://.org/", "http://example.org/en/1", "http://example.org/en/12/",
         "http://example.org/en", "x?u=http://Ä.org/en/", "http://org", "http://user@a.com:80/x", "a\nb://c.com/\nx", "http://" + "a." * 3000 + "com/" + "y" * 9000]


def test_verdicts_equal_a_plain_reading(spark):
    rnd = random.Random(8)
    made = ["http://" + ".".join(rnd.choice(["a", "b", "com", "org", "example", ""]) for _ in range(rnd.randint(1, 4)))
            + rnd.choice(["", "/", "/x", "/xy/z", "/es/1", "/en/12", "?q", "#f/x"]) for _ in range(400)]
    both = FIXED + made + made[:20]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(both)] + [(None, "http://a.com/x", "h", "r")],
                                  "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES + [(None, "/", "block"), ("", "/", "block"), ("org", None, "block"), ("org", "/", None)],
                                  "host string, path string, verdict string")
    rows = urls.judge_urls(pages, rules).collect()
    assert len(rows) == len(both) + 1
    for r in rows:
        url = "http://a.com/x" if r["page_id"] is None else both[r["page_id"]]
        assert tuple(r)[1:] == slow_judge(url, RULES), url


def test_no_pages_or_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert urls.judge_urls(pages, rules.limit(0), default="block").first()["verdict"] == "block"
