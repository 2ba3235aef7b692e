import random
import re

import pytest
from pyspark.sql import functions as F

from tensorloom.llm import urlrank


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def slow_rule(host, path):
    fits = [r for r in urlrank.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def slow_rank(seeds, edges, rounds=400):
    hosts = set(seeds) | {h for e in edges for h in e}
    out = {h: sum(w for (a, _), w in edges.items() if a == h) for h in hosts}
    score = {h: seeds.get(h, 0.0) for h in hosts}
    for _ in range(rounds):
        nxt = {h: 0.15 * seeds.get(h, 0.0) + 0.85 * (0.0 if out[h] else score[h]) for h in hosts}
        for (a, b), w in edges.items():
            nxt[b] += 0.85 * score[a] * w / out[a]
        score = nxt
    return score


URLS = ["https://A.Example.net/en/x", "http://b.example.net/", "http://b.example.net", "https://x.org/fr/", "https://x.org/de/?q=/fr/", "ftp://y.example.com/de/1#a", "http://y.example.com/en/", "net", None, "", "://", "http://", "http://notnet/", "http://evil-net/en/", "x://a?b://c/d", "http://É.ORG/fr/\nz", "http://z.test/a"]


def test_rules_against_brute_force(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(0, URLS[0], "<a href='//x.org'>"), (None, "http://q.net/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rule", F.lit("z"))
    found = urlrank.judge(pages).collect()
    assert len(found) == len(rows)
    url_of = {p: u for p, u, _ in rows}
    for r in found:
        host, path = slow_parts(url_of[r.page_id])
        rule = slow_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.name if rule else None)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    assert urlrank.judge(pages.limit(0)).collect() == []


def slow_shares(pages, rules=urlrank.RULES):
    """Trust and distrust shares by host, and the edges, from rows (page_id, url, html)."""
    allowed, blocked, of, edges = {}, {}, {}, {}
    for _, url, html in pages:
        host, path = slow_parts(url)
        rule = slow_rule(host, path)
        if host:
            of[host] = of.get(host, 0) + 1
            allowed[host] = allowed.get(host, 0) + (rule is not None and rule.verdict == "allow")
            blocked[host] = blocked.get(host, 0) + (rule is not None and rule.verdict == "block")
            for link in re.findall(r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)""", html or ""):
                if link.lower() != host:
                    edges[host, link.lower()] = edges.get((host, link.lower()), 0) + 1
    hosts = set(of) | {h for e in edges for h in e}
    out = []
    for seeds, way in ((allowed, edges), (blocked, {(b, a): w for (a, b), w in edges.items()})):
        own = {h: seeds.get(h, 0) / of.get(h, 1) for h in hosts}
        score, every = slow_rank(own, way), slow_rank(dict.fromkeys(hosts, 1.0), way)
        out.append({h: max(own[h], score[h] / every[h]) for h in hosts})
    return out


def generated(seed, hosts=40, pages=300):
    """Pages of few very large and many small hosts, linked across."""
    rng = random.Random(seed)
    names = [f"h{k}.{rng.choice(['test', 'test', 'net', 'org', 'example.com'])}" for k in range(hosts)]
    pick = lambda: names[min(int(rng.expovariate(0.12)), hosts - 1)]
    return [(i, f"http://{pick()}/{rng.choice(['fr', 'de', 'en'])}/{i}", " ".join(f'<a href="https://{pick()}/x">y</a>' for _ in range(rng.randint(0, 4)))) for i in range(pages)]


CHAIN = [(k, f"http://c{k}.test/", f"<a href='//c{k + 1}.test/'>x</a>" + f"<a href='//c{max(0, k - 1)}.test/'>x</a>" * (k % 3 == 0)) for k in range(25)] + [(25, "http://c25.test/", "<a href='http://bad.net/'>"), (26, "http://bad.net/", "<a href='//c25.test'>")]


@pytest.mark.parametrize("rows", [generated(1), CHAIN], ids=["linked", "chain"])
def test_propagation_against_brute_force(spark, rows):
    found = urlrank.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), tolerance=1e-4).collect()
    assert len(found) == len(rows)
    trust, distrust = slow_shares(rows)
    for r in found:
        assert r.trust_share == pytest.approx(trust[r.host], abs=5e-3) and r.distrust_share == pytest.approx(distrust[r.host], abs=5e-3)
        assert 0 <= r.distrust_share <= 1 + 1e-9
        if r.rule is None and abs(distrust[r.host] - 0.5) > 0.01 and abs(distrust[r.host] - trust[r.host]) > 0.01:
            assert r.verdict == ("block" if distrust[r.host] >= 0.5 and distrust[r.host] > trust[r.host] else "allow")
    # Links reach further than the hosts that rules name.
    assert any(r.distrust_share > 0.01 for r in found if r.rule is None)


def test_a_link_to_a_bad_host_does_not_clear_it(spark):
    rows = [(k, f"http://s.example.com/de/{k}", "") for k in range(9)] + [(20, "http://s.example.com/en/", "")]
    rows += [(30 + k, f"http://clean{k}.test/", '<a href="http://s.example.com/">x</a>' + "".join(f'<a href="http://ok{j}.test/">' for j in range(9))) for k in range(5)]
    found = {r.page_id: r.verdict for r in urlrank.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), tolerance=1e-4).collect()}
    assert found[20] == "block" and all(found[30 + k] == "allow" for k in range(5))


def test_registered_threshold_on_a_linked_graph(spark):
    rows = [
        (1, "http://bad.net/", "<a href='https://bad2.net/'>x</a>"),
        (2, "http://bad2.net/q", ""),
        (3, "http://farm.test/", "<a href='https://bad.net/'>x</a><a href='https://bad2.net/z'>y</a>"),
        (4, "http://far.test/", '<a href="http://farm.test/"><a href="http://b.test/"><a href="http://c.test/">'),
        (5, "http://b.test/", ""),
        (6, "http://linker.test/", "<a href='http://s.example.com/'>x</a>"),
    ]
    rows += [(10 + k, f"http://s.example.com/de/{k}", "") for k in range(9)] + [(20, "http://s.example.com/en/", "")]
    rows += [(30 + k, f"http://t.example.com/de/{k}", "") for k in range(9)] + [(40, "http://t.example.com/en/", "")]
    found = {r.page_id: r.verdict for r in urlrank.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), tolerance=1e-4).collect()}
    assert found[3] == "block" and found[5] == "allow"
    # One link to a host that is blocked by nine pages in ten leaves its verdict.
    assert found[20] == found[40] == "block"


@pytest.mark.parametrize("rows", [generated(1), generated(4), CHAIN], ids=["linked", "linked4", "chain"])
def test_sql_of_the_query_propagates_alike(rows):
    import duckdb

    from tensorloom.llm import queries

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    trust, distrust = slow_shares(rows)
    found = con.execute(queries.ORACLE_SQL["op6_link_graph_urls"]).fetchall()
    assert len(found) == len(rows)
    for _, host, _, _, _, t, d in found:
        assert t == pytest.approx(trust[host], abs=1e-4) and d == pytest.approx(distrust[host], abs=1e-4)
