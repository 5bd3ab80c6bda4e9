import math
import random
from collections import Counter

import numpy as np
import pytest

from leafclock.llm import url_filter
from leafclock.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    m = next((i for i, c in enumerate(rest) if i >= n and c in "?#"), len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:m]


def ruled(host, path):
    fit = [(len(r.name), r.name, r.verdict) for r in URL_RULES
           if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit)[1:] if fit else (None, None)


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(1)
    urls = [None, "", "no scheme", "http://", "https://NET/x", "http://a.net", "http://anet/", "http://x.example.net/en/a?b=://c",
            "http://EXAMPLE.net/en", "ftp://example.com/de/x#y/", "a://b.org/fr/?q", "http://É.net/É", "http://h.net:80/", "x" * 50_000 + "://a.org/en/z",
            "http://a.org/" + "y" * 50_000]
    for _ in range(300):
        host = r.choice(["www.", "m.", ""]) + r.choice(["good", "fine", "bad", "spam"]) + r.choice([".example.org", ".example.com", ".example.net"])
        urls.append(f"http://{host}/{r.choice(['en', 'de', 'fr'])}/{r.randrange(9999)}")
    urls += urls[-3:]
    return spark.createDataFrame([(i if i != 7 else None, u, "t", "rule", "v") for i, u in enumerate(urls)],
                                 "page_id long, url string, text string, rule string, verdict string"), urls


def test_parts_and_rules(pages):
    df, urls = pages
    got = url_filter.judge(df, URL_RULES).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = parts(urls[7 if r.page_id is None else r.page_id])
        assert (r.host, r.path) == (host, path)
        name, verdict = ruled(host, path)
        assert r.rule == name and r.verdict in ("allow", "block")
        if verdict:
            assert r.verdict == verdict and r.probability is None
        else:
            assert r.verdict == ("allow" if r.probability >= 0.5 else "block")
        if not host + path:
            assert r.difference == 0


def test_differences_equal_brute_force():
    """Witten-Bell by dictionaries, where no two contexts share a cell."""
    good, bad, asked = [b"abcab", b"abd"], [b"zzzab", b"b"], [b"abz", b"", b"q"]
    bits, order = 18, url_filter.ORDER
    tables = np.zeros((2, 3, 1 << bits), np.float32)
    models = []
    for t, texts in enumerate((good, bad)):
        grams = Counter()
        for x in texts:
            s = b"\x01" * order + x
            for i in range(order, len(s)):
                for k in range(order + 1):
                    grams[s[i - k:i], s[i:i + 1]] += 1
        models.append(grams)
        g, c, _ = url_filter.cells(texts, bits)
        codes, n = np.unique((c.ravel() << bits) | g.ravel(), return_counts=True)
        np.add.at(tables[t, 0], codes & ((1 << bits) - 1), n)
        np.add.at(tables[t, 1], codes >> bits, n)
        np.add.at(tables[t, 2], codes >> bits, 1)

    def log(x, grams):
        out, s = 0.0, b"\x01" * order + x
        for i in range(order, len(s)):
            p = 1 / 256
            for k in range(order + 1):
                own = {b: n for (a, b), n in grams.items() if a == s[i - k:i]}
                if own:
                    p = (own.get(s[i:i + 1], 0) + len(own) * p) / (sum(own.values()) + len(own))
            out += math.log(p)
        return out

    want = [(log(x, models[0]) - log(x, models[1])) / max(len(x), 1) for x in asked]
    assert np.allclose(url_filter.differences(asked, tables, bits), want)


def test_learns_the_difference(spark):
    r = random.Random(2)
    rows = [(i, f"http://{r.choice(['a', 'b'])}{i % 17}.net/{r.choice(['casino', 'pills'])}/{i}" if i % 2 else f"http://s{i % 19}.org/fr/{r.choice(['news', 'art'])}/{i}")
            for i in range(400)]
    rows += [(1000 + i, f"http://c.com/{w}/{i}") for i, w in enumerate(["casino", "pills", "news", "art"] * 5)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).where("page_id >= 1000").collect()
    right = sum(r.verdict == ("block" if r.path.split("/")[1] in ("casino", "pills") else "allow") for r in got)
    assert right >= 18


def test_one_sided_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.net/")], "page_id long, url string")
    block, allow = url_filter.rule("block", "net/"), url_filter.rule("allow", "net/")
    verdicts = lambda rules: [r.verdict for r in url_filter.judge(df, rules).orderBy("page_id").collect()]
    assert verdicts([block]) == ["block", "block"]
    assert verdicts([allow]) == ["allow", "allow"]
    assert verdicts([]) == ["allow", "allow"]
    assert url_filter.judge(df.limit(0), [block]).count() == 0


def test_counts_stay_exact_beyond_any_fixed_number_of_cells(spark):
    """Twenty thousand urls of random slugs have more grams than 2 ** 18."""
    r = random.Random(5)
    slug = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20))
    rows = [(i, f"a.{'org/fr' if i % 2 else 'net'}/{slug()}", "allow" if i % 2 else "block") for i in range(20_000)]
    df = spark.createDataFrame(rows, "page_id long, text string, verdict string")
    model = url_filter.fit(df)
    taught = df.withColumn("part", url_filter.fold("page_id", 5)).where("part > 0").collect()
    contexts = [Counter(), Counter()]
    for x in taught:
        s = b"\x01" * url_filter.ORDER + x.text.encode()
        for i in range(url_filter.ORDER, len(s)):
            contexts[x.verdict == "allow"][s[i - url_filter.ORDER:i]] += 1
    assert sum(map(len, contexts)) > 1 << 18
    asked = [b"a.org/fr/" + slug().encode() for _ in range(200)]
    _, cells, _ = url_filter.cells(asked, url_filter._BITS)
    for y, table in zip((1, 0), url_filter._tables(model.counts)):
        got = table[1][cells[url_filter.ORDER]]
        want = [contexts[y][(b"\x01" * url_filter.ORDER + x)[i:i + url_filter.ORDER]] for x in asked for i in range(len(x))]
        assert got.tolist() == want
