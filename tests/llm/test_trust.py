import random
import re
from collections import defaultdict

import pytest

from scrubjay.llm import queries, url_trust
from scrubjay.llm.url_trust import Rule, Settings

SCHEMA = "page_id long, url string, html string, host string, rule string"
RULES = [Rule("allow", "good.org", "/"), Rule("block", "bad.net", "/"), Rule("block", "org", "/x/"), Rule("allow", "sub.bad.net", "/ok/")]


def by_hand(edges, allow, block, settings):
    """(trust, distrust) by personalised PageRank over plain dictionaries; every seed has the same mass, all of it comes back."""
    mass = 1 / max(1, len(allow) + len(block))

    def rank(pairs, seeds):
        out = defaultdict(list)
        for a, b in pairs:
            out[a].append(b)
        start = {h: (1 - settings.damping) * mass for h in seeds}
        score = dict(start)
        for _ in range(settings.rounds):
            new = defaultdict(float, start)
            for a, s in score.items():
                for b in out[a]:
                    new[b] += settings.damping * s / len(out[a])
            score = dict(new)
        held = sum(score.values())
        return {h: s * len(seeds) * mass / held for h, s in score.items()}

    return rank(edges, allow), rank([(b, a) for a, b in edges], block)


def plain_rule(host, path, rules):
    return next((r for r in url_trust.longest_first(rules) if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), None)


def test_scores_and_verdicts(spark):
    links = {"good.org": ["mid.com", "Other.com"], "mid.com": ["leaf.com", "bad.net"], "leaf.com": ["mid.com"], "spam.com": ["bad.net", "bad.net"], "other.com": [], "bad.net": ["spam.com"], "friend.com": ["spam.com"]}
    rows = [(i, f"http://{h}/p", "".join(f"<a class=x href='//{t}/y?z'>t</a>" for t in ts) + '<a href="/own">o</a>', "h", "r") for i, (h, ts) in enumerate(links.items())]
    settings = Settings(rounds=6, store_every=2)
    got = {r.host: r for r in url_trust.judge(spark, spark.createDataFrame(rows, SCHEMA), RULES, settings).collect()}
    edges = {(a, b.lower()) for a, bs in links.items() for b in bs}
    trust, distrust = by_hand(edges, ["good.org"], ["bad.net"], settings)
    for host, r in got.items():
        assert r.trust == pytest.approx(trust.get(host, 0)) and r.distrust == pytest.approx(distrust.get(host, 0))
        ruled = {"good.org": "allow", "bad.net": "block"}.get(host)
        assert r.verdict == (ruled or ("block" if distrust.get(host, 0) > trust.get(host, 0) else "allow"))
    assert got["spam.com"].verdict == got["friend.com"].verdict == "block" and got["other.com"].verdict == "allow"


def test_generated_graph_and_many_rules(spark):
    """Hundreds of hosts, thousands of links, 100,000 rules in a table, seeds that only links tell of; beside plain dictionaries."""
    rng = random.Random(4)
    hosts = [f"h{k}.{rng.choice(['a', 'b', 'c'])}.{rng.choice(['org', 'net', 'info'])}" for k in range(300)]
    rules = [Rule(rng.choice(["allow", "block"]), h, rng.choice(["/", "/", "/x/", "/xy"])) for h in rng.sample(hosts, 60)]
    rules += [Rule("block", "c.net", "/"), Rule("allow", "c.net", "/xy/z"), Rule("allow", "unseen.info", "/"), Rule("block", "unseen.net", "/")]
    many = rules + [Rule("block", f"site{k}.example", f"/p{k % 9}") for k in range(100_000)]
    pages = []
    for i in range(900):
        to = [rng.choice([*hosts, "unseen.info", "unseen.net", "Site7.example"]) for _ in range(rng.choice([0, 1, 3, 9]))]
        pages.append((i, f"http://{rng.choice(hosts[:250])}{rng.choice(['/', '/x/1', '/xy/z/q', ''])}", "".join(f"<a href=https://{t}/>" for t in to), "h", "r"))
    settings = Settings(rounds=9)
    got = url_trust.judge(spark, spark.createDataFrame(pages, SCHEMA), spark.createDataFrame(many, "verdict string, host string, path string"), settings).collect()
    split = {i: (u.split("/")[2], "/" + u.split("/", 3)[3] if u.count("/") > 2 else "") for i, u, *_ in pages}
    edges = {(split[i][0], t.lower()) for i, _, html, *_ in pages for t in re.findall(r"//([^/]+)/", html) if split[i][0] != t.lower()}
    verdicts = defaultdict(list)
    for h, p in split.values():
        verdicts[h].append(plain_rule(h, p, rules))
    for h in {x for e in edges for x in e} - verdicts.keys():
        verdicts[h] = [plain_rule(h, "/", rules)]
    seeds = {v: [h for h, rs in verdicts.items() if 2 * sum(r is not None and r.verdict == v for r in rs) >= len(rs)] for v in ("allow", "block")}
    trust, distrust = by_hand(edges, seeds["allow"], seeds["block"], settings)
    assert "unseen.net" in seeds["block"] and "unseen.info" in seeds["allow"]
    decided = set()
    for r in got:
        h, p = split[r.page_id]
        rule = plain_rule(h, p, rules)
        assert (r.host, r.path, r.rule) == (h, p, rule and rule.text)
        assert r.trust == pytest.approx(trust.get(h, 0)) and r.distrust == pytest.approx(distrust.get(h, 0))
        if abs(trust.get(h, 0) - distrust.get(h, 0)) > 1e-9 or rule:
            assert r.verdict == (rule.verdict if rule else "block" if distrust.get(h, 0) > trust.get(h, 0) else "allow")
            decided.add((rule is None, r.verdict))
    assert len(got) == len(pages) and len(decided) == 4


def test_equal_seeds_weigh_alike(spark):
    """A thousand trusted seeds take nothing from the weight of one blocked seed, or give it any."""
    rows = [(k, f"http://t{k}.good/", "<a href=//mixed.info/>" if k < 3 else "", "h", "r") for k in range(200)] + [(900, "http://mixed.info/", "<a href=//bad.net/>", "h", "r"), (901, "http://bad.net/", "", "h", "r")]
    got = {r.host: r for r in url_trust.judge(spark, spark.createDataFrame(rows, SCHEMA), [Rule("allow", "good", "/"), Rule("block", "bad.net", "/")]).collect()}
    assert got["mixed.info"].trust > got["mixed.info"].distrust and got["mixed.info"].verdict == "allow"


def test_rules_hosts_and_paths(spark):
    urls = ["HTTP://Sub.BAD.net/ok/1", "x://sub.bad.net/no", "x://notbad.net/", "x://a.org/x/", "x://good.org/x/", "x://a.org/X/", "x://bad.net", "x://bad.net?q=/", None, "no scheme", "x://É.org#f", "a://b://c/d", ""]
    rows = [(i, u, None, "h", "r") for i, u in enumerate(urls)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_trust.judge(spark, spark.createDataFrame(rows, SCHEMA), RULES).collect()}
    assert got[0] == ("sub.bad.net", "/ok/1", "sub.bad.net/ok/", "allow") and got[1][2:] == ("bad.net/", "block") and got[2][2:] == (None, "allow")
    assert got[3][2] == "org/x/" and got[4][2] == "good.org/" and got[5][2] is None
    assert got[6] == ("bad.net", "", None, "allow") and got[7][:3] == ("bad.net", "", None)
    assert got[8][:3] == got[9][:3] == got[12][:3] == ("", "", None) and got[10][0] == "É.org" and got[11][:2] == ("b:", "//c/d")


def test_repeated_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "x://a.b/", "<a href=http://c.d>", "h", "r")] * 3 + [(None, None, None, None, None)], SCHEMA)
    assert url_trust.judge(spark, rows, RULES).count() == 4
    assert url_trust.judge(spark, rows.limit(0), RULES).count() == 0


def test_query_has_only_native_nodes(spark, sf_dir):
    plan = queries.op4_url_trust(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
