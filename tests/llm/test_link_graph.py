import re
from collections import defaultdict

from maternis.llm import link_graph as L


#: Turns of the brute force: 0.85 ** 300 is nothing.
TURNS = 300


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path, rules=L.RULES):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def brute(pages):
    good, bad, edges, hosts, n = defaultdict(int), defaultdict(int), defaultdict(int), set(), defaultdict(int)
    for _, url, html in pages:
        h, p = split(url)
        if h:
            hosts.add(h)
            n[h] += 1
            r = rule_of(h, p)
            if r:
                (good if r.allow else bad)[h] += 1
        for m in re.finditer(r"""(?i:href|src)\s*=\s*["']?\s*((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^\s"'<>]+)""", html or ""):
            b, _ = split("x:" + m[1] if m[1].startswith("//") else m[1])
            if h and b and h != b:
                edges[h, b] += 1
                hosts.add(b)

    def spread(seed, flip):
        chosen = [h for h in n if 2 * seed.get(h, 0) >= n[h]]
        m = {h: 1 / len(chosen) for h in chosen}
        out = {h: 0.0 for h in hosts}
        e = {((b, a) if flip else (a, b)): c for (a, b), c in edges.items()}
        deg = defaultdict(int)
        for (a, _), c in e.items():
            deg[a] += c
        for k in range(TURNS + 1):
            for h, v in m.items():
                out[h] += (1 - L.DAMPING) * v
            new = defaultdict(float)
            for (a, b), c in e.items():
                new[b] += m.get(a, 0) * c / deg[a] * L.DAMPING
            m = new
        return out
    trust, distrust = spread(good, False), spread(bad, True)
    blocked = {h for h in hosts if distrust[h] - trust[h] > L.MARGIN / max(1, len(hosts))}
    out = []
    for k, url, _ in pages:
        h, p = split(url)
        r = rule_of(h, p)
        allow = r.allow if r else h not in blocked
        out.append((k or 0, h, p, r.name if r else "", "allow" if allow else "block"))
    return sorted(out)


def rows(df):
    return sorted((r.page_id or 0, r.host, r.path, r.rule or "", r.verdict) for r in df.collect())


def link(*urls):
    return "".join(f'<a class=x href="{u}">' for u in urls)


def test_propagation_against_brute_force(spark):
    pages = [(1, "http://bad.net/es/1", link("https://good.org/")), (2, "http://farm.org/x", link("http://bad.net/es/1", "//bad.net/")),
             (3, "http://farm2.org", link("http://farm.org/x", "http://bad.net/")), (4, "https://a.com/", link("http://ok.org/?q")),
             (5, "http://ok.org/y", link("http://farm.org/")), (6, "http://EXAMPLE.com/en/a", None), (7, "http://www.example.com/en/a", ""),
             (8, None, link("http://z.org")), (9, "nothing", None), (10, "http://x.example.com/en?x=1", "<img src='//ok.org/i.png'>"),
             (11, "://h.net/fr/é#z", ""), (12, "http://Q.NET/fr/?u=http://a.com/", None), (6, "http://EXAMPLE.com/en/a", None),
             (None, "http://com/", ""), (13, "http://a.com?x", ""), (14, "http://loner.org/", "href=rel"), (15, "a\n://b.com/c\nd", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got, want = rows(L.judge_urls(df)), brute(pages)
    assert got == want
    assert {r[4] for r in got if r[1] == "farm2.org"} == {"block"}
    assert {r[4] for r in got if r[1] == "loner.org"} == {"allow"}


def test_walks_go_on_until_no_verdict_can_change(spark):
    # a chain of hosts that leads to a blocked one, and a ring with a trusted one, among 1,000 hosts
    hops = 60
    pages = [(0, "http://bad.net/es/1", "")]
    pages += [(k, f"http://hop{k}.org/", link(f"http://hop{k - 1}.org/" if k > 1 else "http://bad.net/es/1")) for k in range(1, hops + 1)]
    pages += [(k, f"http://alone{k}.org/", "") for k in range(hops + 1, 998)]
    pages += [(998, "http://ring.com/", link("http://ring1.org/")), (999, "http://ring1.org/", link("http://ring.com/"))]
    got = {h: v for _, h, _, _, v in rows(L.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string")))}
    # the score of hop k is (1 - d) * d ** k, over 0.1 / 1000 up to hop 44
    over = [k for k in range(1, hops + 1) if 0.15 * 0.85 ** k > 0.1 / 1000]
    assert over[-1] == 44 and [k for k in range(1, hops + 1) if got[f"hop{k}.org"] == "block"] == over
    assert {v for h, v in got.items() if not h.startswith("hop") and h != "bad.net"} == {"allow"}


def test_walk_around_a_ring_is_converged(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("b", "a", 1), ("b", "c", 1)], "a string, b string, n bigint")
    hosts = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 0.0)], "host string, seed double")
    got = {r.host: r.score for r in L.spread(hosts, edges, "seed", "a", "b", 1e-6).collect()}
    d = L.DAMPING
    a = (1 - d) / (1 - d * d / 2)  # a = (1 - d) + d * b / 2, b = d * a, c = d * b / 2
    want = {"a": a, "b": d * a, "c": d * d * a / 2}
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) <= 1e-6 for h in want)


def test_many_host_links_against_converged_brute_force(spark, monkeypatch):
    pick = lambda salt: f"array('h', 'www.h')[pmod(xxhash64(id, {salt}), 2)] || pmod(xxhash64(id, {salt}), 97) || array('.org', '.org', '.org', '.com', '.net')[pmod(xxhash64(id, {salt}), 5)]"
    links = " || ".join(f"'<a href=\"http://' || {pick(k)} || '/\">'" for k in range(1, 5))
    df = spark.range(1500).selectExpr("id AS page_id", f"'http://' || {pick(0)} || '/es/' || id AS url", f"{links} AS html")
    pages = [tuple(r) for r in df.collect()]
    got = rows(L.judge_urls(df))
    assert got == brute(pages) and {r[4] for r in got if not r[3]} == {"allow", "block"}


def test_query_against_brute_force(spark):
    from maternis.llm.queries import op6_link_graph
    sf = "/root/testdata/sf0.01"
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = rows(op6_link_graph(spark, sf))
    assert got == brute(pages) and {r[4] for r in got} == {"allow", "block"}


def test_oracle_sql_against_brute_force():
    import duckdb

    from maternis.llm.oracles import link_graph_sql
    links = [(1, "http://bad.net/es/1", link("https://good.org/")), (2, "http://farm.org/x", link("http://bad.net/es/1", "//bad.net/")),
             (3, "http://farm2.org", link("http://farm.org/x", "http://bad.net/")), (4, "https://a.com/", link("http://ok.org/?q")),
             (5, "http://ok.org/y", link("http://farm.org/")), (8, None, link("http://z.org")), (9, "nothing", None)]
    # a chain of hosts that leads to a blocked one, much longer than 20 turns, and many hosts beside it
    chain = [(k, f"http://c{k}.org/", link(f"http://c{k + 1}.org/")) for k in range(44)] + [(44, "http://c44.org/", link("http://bad.net/"))]
    chain += [(45, "http://bad.net/es/1", "")] + [(k, f"http://o{k}.org/", "") for k in range(46, 1000)]
    for pages in (links, chain):
        con = duckdb.connect()
        con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
        got = con.execute(link_graph_sql()).fetchall()
        assert sorted((k, h, p, r or "", v) for k, h, p, r, v in got) == brute(pages)
    assert "block" in {r[4] for r in brute(chain)[:24]}  # more than 20 links away


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/", "", "x", "y")], "page_id bigint, url string, html string, host string, rule string")
    assert rows(L.judge_urls(df)) == [(1, "a.net", "/es/", "net/es/", "block")]
    assert L.judge_urls(df.limit(0)).collect() == []
