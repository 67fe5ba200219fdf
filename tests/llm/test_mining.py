"""URL verdicts, centroid clustering and collocations against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattsift.llm.centroids import Annulus, cluster_vectors
from wattsift.llm.collocations import collocations
from wattsift.llm.queries import ORACLE_SQL, QUERIES
from wattsift.llm.url_filter import HELD_OUT, RULES, markov_models, url_scores, url_verdicts


def order(x):
    return sorted(x, key=repr)


@pytest.mark.parametrize("name, tables", [("op11_url_filter", ["pages"]), ("op12_centroid_clustering", ["embeddings"]), ("op13_collocations", ["documents"])])
def test_sql(name, tables, spark, sf_dir):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    theirs = con.execute(ORACLE_SQL[name])
    ours = QUERIES[name](spark, sf_dir)
    assert sorted(d[0] for d in theirs.description) == sorted(ours.columns)
    columns = [d[0] for d in theirs.description]
    assert order(tuple(r) for r in ours.select(columns).collect()) == order(theirs.fetchall())


URLS = [
    None, "", "no scheme at all", "http://", "HTTP://Example.ORG/es/1?x=/en/", "https://a.example.org/en/1#top", "https://a.example.org/en/2", "https://anexample.org/es/1", "http://org/x", "http://org", "http://ORG?x", "ftp://x.com/fr/",
    "http://x.com/de/1", "http://x.com/DE/1", "http://com/fr", "http://x.com:80/fr/1", "http://É.net/fr/ÀB", "http://x.net/fr/1\x02\x03", "http://x.net/" + "a/" * 20_000, "x://y://z.org/a://b", "http://x.net/de/1", "http://x.net/de/1",
]


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(t), t, v) for v, t in RULES if (host == t.partition("/")[0] or host.endswith("." + t.partition("/")[0])) and path.startswith("/" + t.partition("/")[2])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def url_rows(spark):
    return spark.createDataFrame([(i, u, "h", "p", "r", 1) for i, u in enumerate(URLS)] + [(None, "http://x.org/a", "h", "p", "r", 1)], "page_id long, url string, host string, path string, u string, says long")


def test_url_rules(spark):
    found = url_verdicts(url_rows(spark)).collect()
    want = [(i, *brute_rule(u)) for i, u in enumerate(URLS)] + [(None, *brute_rule("http://x.org/a"))]
    assert order((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in found) == order(want)
    assert all(r["verdict"] in ("allow", "block") and (r["score"] is None) == (r["rule"] is not None) for r in found)


def test_urls_without_rules_or_rows(spark):
    assert url_verdicts(url_rows(spark).limit(0)).count() == 0
    assert {r["verdict"] for r in url_verdicts(url_rows(spark), rules=()).collect()} == {"allow"}


def brute_markov(texts, top, share, symbols=256):
    """log P of a text under one class's model, symbol by symbol."""
    n = Counter()
    for t in texts:
        x = f"\x02{t}\x03"
        n.update(x[i : i + k] for i in range(len(x)) for k in range(1, top + 2) if i + k <= len(x))
    total = sum(len(t) + 1 for t in texts)
    kept = {s: c for s, c in n.items() if c >= max(2, total * share)}
    follow = {}
    for s, c in kept.items():
        if s != "\x02":
            follow.setdefault(s[:-1], []).append(c)

    def p(x, c):
        if c is None:
            return 1 / symbols
        shorter = c[1:] if c else None
        if c not in follow:
            return p(x, shorter)
        at, t, m = (kept[c] if c else total), len(follow[c]), sum(follow[c])
        return (kept.get(c + x, 0) + (t + at - m) * p(x, shorter)) / (at + t)

    return lambda t: sum(math.log(p(x, f"\x02{t}"[max(0, i + 1 - top) : i + 1])) for i, x in enumerate(f"{t}\x03"))


@pytest.mark.parametrize("top, share", [(2, 0.01), (5, 2e-5)])
def test_markov_scores(spark, top, share):
    r = random.Random(3)
    text = lambda end: "".join(r.choice("abcde") for _ in range(r.randint(1, 6))) + end
    good, bad = sorted({text("x/fr") for _ in range(60)}), sorted({text("y/de/1") for _ in range(40)})
    asked = ["", "a", "abx/fr", "aby/de/1", "zzz", "é/fr", "ab" * 300]
    model, every = markov_models(spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "u string, accepted boolean"), top, share)
    found = {x["u"]: x["score"] for x in url_scores(spark.createDataFrame([(t,) for t in asked], "u string"), model, every, top).collect()}
    yes, no = brute_markov(good, top, share), brute_markov(bad, top, share)
    for t in asked:
        assert abs(found[t] - math.floor(1000 * (yes(t) - no(t)) / (len(t) + 1))) <= 1, t
    assert found["abx/fr"] > 0 > found["aby/de/1"]


def test_urls_held_out(spark):
    """On ruled URLs that neither the models nor the cut have seen, the verdicts are the rules'."""
    r = random.Random(5)
    host = lambda: "".join(r.choice(["ti", "on", "re", "th", "an"]) for _ in range(r.randint(2, 4)))
    rows = [(i, f"http://{host()}.example.{r.choice(['org', 'com'])}/{r.choice(['fr', 'de'])}/{r.randint(0, 999)}.html") for i in range(3000)]
    rules = (("allow", "com/fr/"), ("block", "com/de/"), ("block", "org/de/"), ("allow", "org/fr/"))
    hidden = [(i, u.replace(".org/", ".net/").replace(".com/", ".net/") if hashlib.md5(u.encode()).hexdigest() < "5" else u) for i, u in rows]
    found = {x["page_id"]: x["verdict"] for x in url_verdicts(spark.createDataFrame(hidden, "page_id long, url string"), rules=rules).collect()}
    unseen = [i for (i, u), (_, v) in zip(rows, hidden) if u != v]
    assert len(unseen) > 500
    assert sum(found[i] == ("allow" if "/fr/" in rows[i][1] else "block") for i in unseen) > 0.97 * len(unseen)
    assert HELD_OUT == "3"


def brute_clusters(rows, centroids=40, rounds=5, dims=64):
    x = [(i, [math.floor(256 * float(e)) for e in v]) for i, v in rows if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)]
    sha = lambda i: (i is None, "" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest())
    c = [v for _, v in sorted(x, key=lambda r: (sha(r[0]), r[1]))[:centroids]]
    d = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda v: min((d(v, o), k) for k, o in enumerate(c))
    for _ in range(rounds):
        members = {}
        for _, v in x:
            members.setdefault(near(v)[1], []).append(v)
        c = [[sum(e) // len(members[k]) for e in zip(*members[k])] if k in members else o for k, o in enumerate(c)]
    at = [(i, *near(v)[::-1]) for i, v in x]
    own = Counter()
    for _, k, e in at:
        own[k] += e
    return [(i, k, e, own[k], sum(own.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, e in at]


def test_clusters(spark):
    r = random.Random(9)
    v = lambda s: [r.gauss(0, s) for _ in range(64)]
    rows = [(i, v(r.choice([0.01, 0.1, 1, 9]))) for i in range(300)]
    rows += [(400 + i, [0.5] * 64) for i in range(30)] + [(7, rows[7][1]), (None, v(1)), (500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [None] + [1.0] * 63), (505, [math.nan] + [1.0] * 63), (506, [math.inf] + [1.0] * 63), (507, [20000.5] * 64)]
    df = spark.createDataFrame([(i, e, 3, 4, "v", "x") for i, e in rows], "vec_id long, embedding array<double>, cluster int, label int, v string, x string").repartition(5)
    assert order(tuple(r) for r in cluster_vectors(df).collect()) == order(brute_clusters(rows))
    few = rows[:7]
    assert order(tuple(r) for r in cluster_vectors(df.filter("vec_id < 7")).collect()) == order(brute_clusters(few))
    assert cluster_vectors(df.limit(0)).count() == 0


def test_annulus_prunes_and_keeps_ties():
    r = np.random.default_rng(2)
    c = r.integers(-50, 50, (30, 8)) * np.arange(1, 31)[:, None]
    c[5] = c[4] = c[17]
    x = np.vstack([c, (c[:-1] + c[1:]) // 2, r.integers(-1500, 1500, (500, 8)), np.full((1, 8), 1 << 26)])
    ring = Annulus(c)
    number, distance = ring.assign(x)
    near = Annulus(c)
    near.assign(c[r.integers(0, 30, 500)] + r.integers(-3, 4, (500, 8)))
    exact = np.array([[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in c] for a in x], object)
    assert (distance == exact.min(axis=1)).all() and (number == exact.argmin(axis=1)).all()
    assert ring.compared < len(x) * len(c) and near.compared < 0.2 * 500 * len(c)


def brute_collocations(rows, least, top, share):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w)) for k in range(1, 5) if i + k <= len(w))
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = {p[i : i + k] for p, a in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= share * c[p[i : i + k]]}
        rows = []
        for p, a in often.items():
            if p not in covered:
                s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((s, a, " ".join(p), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows, key=lambda x: (-x[0], -x[1], x[2].encode()))[:top], 1):
            out.append((lang, rank, p, a, l, r, n[lang], s))
    return out


#: Small parts everywhere; and keys of so few bits that different phrases share them.
TINY = {"bits": 1 << 18, "shard": 5, "rows_at_most": 8, "chunk": 400, "held": 20}


@pytest.mark.parametrize("sizes", [{}, TINY, {"width": 7}, {**TINY, "width": 5}])
def test_collocations(spark, sizes):
    r = random.Random(4)
    words = ["new", "York", "city", "of", "the", "Élan", "vital", "ÉLAN", "x\x01y", "a", "b", "\x1f", "你好", "state"]
    text = lambda: "".join(r.choice(words[:6] if r.random() < 0.6 else words) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(r.randint(0, 60)))
    rows = [(r.choice(["en", "en", "en", "de", None, ""]), text()) for _ in range(120)]
    rows += [("en", None), ("fr", ""), (None, " \t"), ("en", "word " * 300), ("en", "the new york city " * 50), ("zz", "one. two")] + [rows[0]] * 8
    df = spark.createDataFrame([(i, t, x, 1, "s", "p") for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, n long, shard string, phrase string").repartition(4)
    for least, top in ((3, 20), (30, 5)):
        found = collocations(df, least=least, top=top, **sizes)
        assert order(tuple(x) for x in found.collect()) == order(brute_collocations(rows, least, top, 80))


def test_collocations_of_long_texts_and_none(spark, empty):
    assert collocations(empty.withColumn("lang", F.lit(None).cast("string"))).count() == 0
    text = "alpha beta gamma " * 40_000
    found = collocations(spark.createDataFrame([(text, "en"), (text.replace(" ", ""), "en")], "text string, lang string"), chunk=10_000).collect()
    assert order(tuple(x) for x in found) == order(brute_collocations([("en", text), ("en", text.replace(" ", ""))], 30, 2000, 80))
