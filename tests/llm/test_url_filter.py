"""URL verdicts against the same models in plain Python."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

from tidewatch.llm import url_filter as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((tail.index(c) for c in "?#" if c in tail), default=len(tail))
    return host.translate({k: k + 32 for k in range(65, 91)}), tail[:end]


def rule(host, path):
    best = None
    for h, p, v in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best or (None, None)


def brute(urls) -> dict:
    """Verdict and score of every (host, path)."""
    pages = {parts(u) for u in urls}
    order, known = U.ORDER, {}
    grams = {x: [("\2" * order + "".join(x) + "\3")[i : i + order + 1] for i in range(len("".join(x)) + 1)] for x in pages}
    trains = {x: zlib.crc32("".join(x).encode()) % 5 != 4 for x in pages}
    count = {v: [Counter() for _ in range(order + 2)] for v in ("allow", "block")}
    for x in pages:
        v = rule(*x)[1]
        if v and trains[x]:
            for g in grams[x]:
                for n in range(order + 2):
                    count[v][n][g[order + 1 - n :]] += 1
    held = {v: [Counter() for _ in range(order + 1)] for v in count}
    for v, levels in count.items():
        for n in range(1, order + 2):
            for g, c in levels[n].items():
                held[v][n - 1][g[:-1]] += c

    def p(v, g):
        out = 1 / 256
        for n in range(1, order + 2):
            s = g[order + 1 - n :]
            out = (count[v][n][s] + U.BACK * out) / (held[v][n - 1][s[:-1]] + U.BACK)
        return out

    score = {x: sum(math.log(p("allow", g)) - math.log(p("block", g)) for g in gs) / len(gs) for x, gs in grams.items()}
    bins = defaultdict(lambda: [0, 0])
    for x in pages:
        v = rule(*x)[1]
        if v and not trains[x]:
            bins[math.floor(score[x] * U.STEPS)][v == "block"] += 1
    na, nb = sum(a for a, _ in bins.values()), sum(b for _, b in bins.values())
    bound = 0.0
    if na and nb:
        rate = lambda k: sum(a for j, (a, _) in bins.items() if j >= k) / na + sum(b for j, (_, b) in bins.items() if j < k) / nb
        best = min(bins, key=lambda k: (-rate(k), k))
        bound = (best + max((k + 1 for k in bins if k < best), default=best)) / 2 / U.STEPS
    for x in pages:
        known[x] = rule(*x)[1] or ("allow" if score[x] >= bound else "block"), score[x], bound
    return known


def urls():
    r = random.Random(3)
    out = [None, "", "no scheme", "http://", "https://EXAMPLE.org/es/x?q#f", "x://a.com/de/://b", "http://org", "http://notexample.org/es/",
           "http://a.org?x=/y", "http://com/fr/#z", "http://é.net/ü/" + "long" * 3000, "http://a.example.org/en/12"]
    good, bad = ["garden", "music", "history"], ["casino", "pills", "loans"]
    for k in range(500):
        words = r.choice([good, bad])
        tail = "/fr/" if words is good else "/de/"
        tail = r.choice([tail, tail, "/en/"])
        out.append(f"http://{r.choice(words)}{r.randrange(9)}.com{tail}{r.choice(words)}{r.randrange(40)}?x={k}")
    return out


def test_verdicts(spark):
    all_urls = urls()
    want = brute(all_urls)
    df = spark.createDataFrame([(k, u, "x", 1.0) for k, u in enumerate(all_urls)] + [(None, all_urls[9], "x", 2.0)],
                               "page_id long, url string, host string, score double").repartition(4)
    got = U.judge(df).collect()
    assert len(got) == len(all_urls) + 1
    for r in got:
        url = all_urls[9] if r.page_id is None else all_urls[r.page_id]
        host, path = parts(url)
        assert (r.host, r.path, r.rule) == (host, path, rule(host, path)[0])
        verdict, score, bound = want[host, path]
        if r.rule is None:
            assert abs(r.score - score) < 1e-9
        if r.rule is not None or abs(score - bound) > 1e-9:
            assert r.verdict == verdict
    free = [(all_urls[r.page_id], r.verdict) for r in got if r.page_id and r.page_id > 11 and r.rule is None]
    right = [v == ("allow" if any(w in u for w in ("garden", "music", "history")) else "block") for u, v in free]
    assert sum(right) / len(right) > 0.9


def test_without_rules_or_pages(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert {(r.page_id, r.verdict, r.score) for r in U.judge(df).collect()} == {(1, "allow", 0.0), (2, "allow", 0.0)}
    assert U.judge(df.limit(0)).collect() == []
