from pyspark.sql import functions as F

from ledgerlens.llm import host_rank as H


def brute(pages, rounds=H.ROUNDS):
    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
        path = rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path] + [len(path)])]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path

    def rule(h, p):
        fits = [r for r in H.RULES if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        return max(fits, key=lambda r: len(r.name)) if fits else None

    import re
    rows = [(i, *parts(u), re.findall(H.LINK, x or "")) for i, u, x in pages]
    links = {(h, d.lower()) for _, h, _, ds in rows for d in ds}
    hosts = {h for _, h, _, _ in rows if h}
    links |= {x for h in hosts for s in [h.partition(".")[2]] if s in hosts for x in ((h, s), (s, h))}
    links = {(a, b) for a, b in links if a and b and a != b}

    def spread(seeds, links):
        score = {h: H.UNIT for h in seeds}
        for _ in range(rounds):
            new = {h: H.UNIT * (100 - H.DAMPING) // 100 for h in seeds}
            for a, b in links:
                if a in score:
                    n = sum(x == a for x, _ in links)
                    new[b] = new.get(b, 0) + score[a] * H.DAMPING // (100 * n)
            score = {h: s for h, s in new.items() if s}
        return score

    seeds = lambda v: {h for _, h, p, _ in rows if h and (r := rule(h, p)) and r.verdict == v}
    trust, distrust = spread(seeds("allow"), links), spread(seeds("block"), {(b, a) for a, b in links})
    out = []
    for i, h, p, _ in rows:
        r = rule(h, p)
        method = "block" if distrust.get(h, 0) > trust.get(h, 0) * H.THRESHOLD else "allow"
        out.append((i, h, p, r.name if r else None, r.verdict if r else method, trust.get(h, 0), distrust.get(h, 0)))
    return out


PAGES = [(1, "http://a.example.org/es/1", '<a href="http://spam.com/x">'), (2, "HTTP://A.Example.ORG/en/2?x#y", "<a href='//rel'> src=https://c.net/"),
         (3, "https://spam.com/de/1", '<a href="https://c.net">'), (4, "https://c.net/", '<a href="http://spam.com/de/">'), (5, "c.net/no", None),
         (6, None, None), (7, "http://", "x"), (8, "http://x.com", None), (9, "http://x.com?a=/fr/", None), (10, "http://x.com/fr/", None),
         (11, "http://example.org/en/12", None), (12, "http://notexample.org/en/12", None), (13, "http://orgs/", None), (14, "x://y://z/", None),
         (15, "http://m.x.com/en", None), (16, "http://x.com/de/", None), (17, "http://b.net/1\n2", '<a HREF = "ftp://m.x.com:80/">'), (17, "http://b.net/1\n2", None),
         (None, "http://d.net/", '<a href="http://b.net">' * 50), (18, "http://ÉÀ.net/É", None), (19, "http://linker.net/1", '<a href="http://spam.com/">')]


def test_equals_brute_force(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("r", F.lit(1))
    got = sorted((tuple(r) for r in H.judge(pages).collect()), key=str)
    assert got == sorted(brute(PAGES), key=str)
    assert {"allow", "block"} == {r[4] for r in got if r[3] is None}


def test_hot_host_does_not_overflow(spark, monkeypatch):
    star = [(k, f"http://s{k}.hub.org/", None) for k in range(40)] + [(99, "http://hub.org/", None), (100, "http://x.net/", '<a href="http://y.net">')]
    for unit in (10**16, 10**18):  # 40 seeds as 400,000 and 40 million
        monkeypatch.setattr(H, "UNIT", unit)
        want = sorted(brute(star), key=str)
        pages = spark.createDataFrame(star, "page_id long, url string, html string")
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            try:
                got = sorted((tuple(r[:5]) + (int(r.trust), int(r.distrust)) for r in H.judge(pages).collect()), key=str)
            finally:
                spark.conf.unset("spark.sql.ansi.enabled")
            assert got == want and max(r[5] for r in got) * 85 > 2**63


def test_empty_table(spark):
    assert H.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
