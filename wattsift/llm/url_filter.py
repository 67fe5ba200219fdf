"""URL verdicts from a rule list, and from two character language models where no rule fits.

Rules name a host and the beginning of a path; they fit that host and all its
subdomains, and the longest fitting rule decides.  The URLs that rules accept and
those that rules reject (each distinct host and path once) train two smoothed
variable-order Markov models:

* Contexts are the up to ORDER symbols before a symbol.  A string of symbols is
  kept only where its share of the class's symbols is LEAST_SHARE or more, so a
  model has at most (ORDER + 1) / LEAST_SHARE strings however many URLs there are.
* P(x | c) = (n(cx) + b(c) P(x | c less its first symbol)) / (n(c) + t(c)), where
  t(c) is the number of kept continuations, n(cx) counts for kept ones only, and
  b(c) = t(c) + n(c) - their sum (Witten-Bell); below order 0 lies 1 / SYMBOLS.

The logarithm of the probability of a URL is a sum over its substrings of up to
ORDER + 1 symbols: each kept string adds what it changes as the longest match,
and each kept context the weight of stepping back from it.  So scoring is one
broadcast join and one sum.  Values are kept in whole micro-nats; the sums are
exact and do not depend on the order of rows.

The score is the difference of the two log-likelihoods a symbol, in whole
milli-nats.  The cut is calibrated on three of 16 distinct ruled URLs (by hash), which the
models have not seen: it makes the rejected share of accepted ones plus the
accepted share of rejected ones least, and lies half way down to the next score.

Only DataFrame functions are used.  Defined results: a null URL or one without
``://`` has empty host and path, which no rule fits and the models judge by the
probability of ending at once; without accepted or without rejected URLs in the
models every difference is 0, and without either among the held-out ones the cut
is 0, so that nothing speaks against a URL; repeated rows are judged alike; a row
comes out for each row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ORDER, LEAST_SHARE, SYMBOLS = 5, 2e-5, 256
#: Ruled URLs are held out where the first hexadecimal digit of their SHA-256 is below this one (3 of 16).
HELD_OUT = "3"
#: Scores beyond this many milli-nats a symbol count as this many in the calibration, so its histogram has a bounded number of bins.
WIDEST = 4000
#: Distinct URLs that a task cuts into strings, about.
URLS_A_TASK = 4000
#: Symbols before and after each URL.
START, END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path; both empty for null and without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(slash + p))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def windows(urls: DataFrame, order: int) -> DataFrame:
    """``urls`` with a row for each symbol of u between START and END: w, the symbol and up to ``order`` after it."""
    symbols = F.split(F.concat(F.lit(START), "u", F.lit(END)), "")
    cut = F.expr(f"transform(sequence(1, size(__symbols)), p -> array_join(slice(__symbols, p, {order + 1}), ''))")
    return urls.withColumn("__symbols", symbols).select(*urls.columns, F.explode(cut).alias("w"))


def beginnings(rows: DataFrame) -> DataFrame:
    """``rows`` with a row for each beginning s of w."""
    return rows.select(*(c for c in rows.columns if c != "w"), F.explode(F.expr("transform(sequence(1, length(w)), k -> left(w, k))")).alias("s"))


def markov_models(ruled: DataFrame, order: int = ORDER, least_share: float = LEAST_SHARE) -> tuple[DataFrame, int]:
    """The models of (u, accepted): a table (s, accepted_micro, rejected_micro), and the difference that every symbol adds.

    Counts come from all rows.  The table has at most 2 (order + 1) / least_share
    rows and is written to the shared folder.
    """
    sizes = {r["accepted"]: r["n"] for r in ruled.groupBy("accepted").agg(F.sum(F.length("u") + 1).alias("n")).collect()}
    total = F.when(F.col("accepted"), F.lit(sizes.get(True, 0))).otherwise(F.lit(sizes.get(False, 0)))
    seen = beginnings(windows(ruled, order).groupBy("accepted", "w").agg(F.count(F.lit(1)).alias("n"))).groupBy("accepted", "s").agg(F.sum("n").alias("n"))
    kept = materialize(seen.filter(F.col("n") >= F.greatest(F.lit(2.0), total * least_share)), "url-strings")
    grams = kept.filter(F.col("s") != START).select("accepted", "s", "n", F.expr("left(s, length(s) - 1)").alias("c"))
    followed = grams.groupBy("accepted", "c").agg(F.count(F.lit(1)).alias("t"), F.sum("n").alias("m"))
    known = kept.select("accepted", F.col("s").alias("c"), F.col("n").alias("n_c")).union(kept.select("accepted").distinct().select("accepted", F.lit("").alias("c"), total.alias("n_c")))
    contexts = followed.join(known, ["accepted", "c"]).select("accepted", "c", (F.col("n_c") + F.col("t")).alias("of"), ((F.col("t") + F.col("n_c") - F.col("m")) / (F.col("n_c") + F.col("t"))).alias("back"))
    contexts = materialize(contexts, "url-contexts")
    steps = grams.join(contexts, ["accepted", "c"]).select("accepted", "s", (F.col("n") / F.col("of")).alias("own"), "back")
    ends = steps.select("accepted", F.col("s").alias("whole"), F.explode(F.expr("transform(sequence(1, length(s)), k -> right(s, k))")).alias("s"))
    chain = ends.join(steps, ["accepted", "s"]).groupBy("accepted", "whole").agg(F.sort_array(F.collect_list(F.struct(F.length("s").alias("k"), "own", "back"))).alias("chain"))
    fold = f"aggregate(chain, struct(cast(0 as double) as less, 1 / {float(SYMBOLS)}D as p), (a, x) -> struct(a.p as less, x.own + x.back * a.p as p))"
    change = chain.select("accepted", F.col("whole").alias("s"), F.expr(fold).alias("f"), F.element_at("chain", -1)["back"].alias("back")).select("accepted", "s", _micro(F.log("f.p") - F.log("f.less") - F.log("back")).alias("v"))
    every = {r["accepted"]: r["v"] for r in contexts.filter("c = ''").select("accepted", _micro(F.log("back")).alias("v")).collect()}
    values = change.union(contexts.filter("c != ''").select("accepted", F.col("c").alias("s"), _micro(F.log("back")).alias("v")))
    table = values.groupBy("s").agg(F.coalesce(F.sum(F.when(F.col("accepted"), F.col("v"))), F.lit(0)).alias("accepted_micro"), F.coalesce(F.sum(F.when(~F.col("accepted"), F.col("v"))), F.lit(0)).alias("rejected_micro"))
    if len(every) < 2:  # with one class only, nothing can be compared
        return materialize(table.limit(0), "url-models"), 0
    return materialize(table, "url-models"), every[True] - every[False]


def _micro(nats: Column) -> Column:
    return F.floor(nats * F.lit(1e6) + F.lit(0.5))


def url_scores(urls: DataFrame, model: DataFrame, every: int, order: int = ORDER) -> DataFrame:
    """``urls``, distinct in u, with the score: the difference of the log-likelihoods a symbol in whole milli-nats, rounded down."""
    parts = beginnings(windows(urls, order)).join(F.broadcast(model), "s", "left")
    sums = parts.groupBy(*urls.columns).agg(F.sum(F.coalesce(F.col("accepted_micro") - F.col("rejected_micro"), F.lit(0))).alias("micro"))
    symbols = (F.length("u") + 1).cast("long")
    return sums.select(*urls.columns, F.floor((F.col("micro") + F.lit(every) * symbols) / (F.lit(1000.0) * symbols)).alias("score"))


def calibrated_cut(held_out: DataFrame) -> int:
    """The least score that is accepted, from (score, accepted)."""
    clipped = F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.col("score")))
    bins = held_out.groupBy(clipped.alias("score")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).collect()  # 2 * WIDEST + 1 rows at most
    good, bad = sum(b["a"] for b in bins), sum(b["r"] for b in bins)
    if not good or not bad:
        return 0
    best, lost, passed, below = None, 0, bad, None
    for b in sorted(bins, key=lambda b: b["score"]):
        own = (passed * good + lost * bad, abs(b["score"]), b["score"], b["score"] if below is None else below)
        best = min(best or own, own)
        lost, passed, below = lost + b["a"], passed - b["r"], b["score"]
    return (best[2] + best[3] + 1) // 2


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", order: int = ORDER, least_share: float = LEAST_SHARE) -> DataFrame:
    """A row for each row: page_id, host, path, rule, verdict, score (null where a rule decides)."""
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    judged = rows.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"), F.translate(F.concat("host", "path"), START + END, "").alias("u"))
    distinct = materialize(judged.select("u", (F.col("says") == "allow").alias("accepted")).distinct(), "urls")
    distinct = distinct.repartition(max(1, -(-distinct.count() // URLS_A_TASK)), "u")  # each URL becomes some 300 rows
    held = F.sha2("u", 256) < HELD_OUT
    model, every = markov_models(distinct.filter(F.col("accepted").isNotNull() & ~held), order, least_share)
    scored = materialize(url_scores(distinct.filter(F.col("accepted").isNull() | held), model, every, order), "url-scores")
    cut = calibrated_cut(scored.filter(F.col("accepted").isNotNull()).select("score", "accepted"))
    free = scored.filter(F.col("accepted").isNull()).select("u", "score")
    by_model = judged.filter(F.col("rule").isNull()).join(free, "u").select("page_id", "host", "path", "rule", F.when(F.col("score") >= cut, "allow").otherwise("block").alias("verdict"), "score")
    by_rule = judged.filter(F.col("rule").isNotNull()).select("page_id", "host", "path", "rule", F.col("says").alias("verdict"), F.lit(None).cast("bigint").alias("score"))
    return by_rule.union(by_model)


def _sql() -> str:
    """SQL for the rows of ``url_verdicts`` on ``pages``."""
    h, p = "regexp_extract(rest, '^[^/?#]*', 0)", "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)"
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fits = lambda t: f"(host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}')"
    chain = lambda pick: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{pick(r)}'" for r in rules) + " END"
    micro = lambda x: f"CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)"
    levels = ", ".join(
        f"p{k} AS (SELECT g.a, g.s, g.own + g.back * {'l.p' if k > 1 else f'(1 / {float(SYMBOLS)})'} AS p, {'l.p' if k > 1 else f'(1 / {float(SYMBOLS)})'} AS less, g.back FROM steps g"
        + (f" JOIN p{k - 1} l ON l.a = g.a AND l.s = substr(g.s, 2)" if k > 1 else "") + f" WHERE length(g.s) = {k})"
        for k in range(1, ORDER + 2)
    )
    return rf"""
    WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate({h}, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, {p} AS path FROM cut),
    judged AS (SELECT *, {chain(lambda r: r[1])} AS rule, {chain(lambda r: r[0])} AS says, translate(host || path, chr(2) || chr(3), '') AS u FROM parts),
    urls AS MATERIALIZED (SELECT DISTINCT u, says = 'allow' AS a, sha256(u) < '{HELD_OUT}' AS held FROM judged),
    symbols AS (SELECT a, held, u, chr(2) || u || chr(3) AS x FROM urls),
    subs AS MATERIALIZED (SELECT a, held, u, substr(x, i, k) AS s FROM (SELECT *, unnest(range(1, length(x) + 1)) AS i FROM symbols), range(1, {ORDER + 2}) r(k) WHERE i + k <= length(x) + 1),
    sizes AS (SELECT a, sum(length(u) + 1) AS n FROM urls WHERE a IS NOT NULL AND NOT held GROUP BY a),
    kept AS MATERIALIZED (SELECT s.a, s, count(*) AS n FROM subs s JOIN sizes z ON z.a = s.a WHERE NOT held GROUP BY s.a, s, z.n HAVING count(*) >= greatest(2.0, z.n * {LEAST_SHARE!r}::DOUBLE)),
    grams AS (SELECT a, s, n, left(s, length(s) - 1) AS c FROM kept WHERE s != chr(2)),
    known AS (SELECT a, s AS c, n FROM kept UNION ALL SELECT a, '', n FROM sizes WHERE a IN (SELECT a FROM kept)),
    contexts AS MATERIALIZED (SELECT f.a, f.c, k.n + t AS o, (t + k.n - m)::DOUBLE / (k.n + t)::DOUBLE AS back FROM (SELECT a, c, count(*) AS t, sum(n) AS m FROM grams GROUP BY a, c) f JOIN known k ON k.a = f.a AND k.c = f.c),
    steps AS MATERIALIZED (SELECT g.a, g.s, g.n::DOUBLE / c.o::DOUBLE AS own, c.back FROM grams g JOIN contexts c ON c.a = g.a AND c.c = g.c),
    {levels},
    vals AS ({" UNION ALL ".join(f"SELECT a, s, {micro('ln(p) - ln(less) - ln(back)')} AS v FROM p{k}" for k in range(1, ORDER + 2))} UNION ALL SELECT a, c, {micro('ln(back)')} FROM contexts),
    two AS (SELECT count(DISTINCT a) = 2 AS paired FROM contexts WHERE c = ''),
    model AS MATERIALIZED (SELECT s, sum(CASE WHEN a THEN v ELSE -v END) AS v FROM vals WHERE (SELECT paired FROM two) GROUP BY s),
    scored AS MATERIALIZED (SELECT u.u, u.a, CAST(floor((coalesce(m.v, 0) + coalesce((SELECT v FROM model WHERE s = ''), 0) * (length(u.u) + 1))::DOUBLE / (1000.0::DOUBLE * (length(u.u) + 1))) AS BIGINT) AS score
        FROM urls u LEFT JOIN (SELECT u, sum(model.v) AS v FROM subs JOIN model USING (s) WHERE a IS NULL OR held GROUP BY u) m ON m.u = u.u WHERE u.a IS NULL OR u.held),
    bins AS (SELECT greatest(-{WIDEST}, least({WIDEST}, score)) AS score, count(*) FILTER (WHERE a) AS ok, count(*) FILTER (WHERE NOT a) AS bad FROM scored WHERE a IS NOT NULL GROUP BY 1),
    cuts AS (SELECT score, coalesce(lag(score) OVER w, score) AS below, coalesce(sum(ok) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost,
        sum(bad) OVER (ORDER BY score ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS passed, sum(ok) OVER () AS good, sum(bad) OVER () AS wrong FROM bins WINDOW w AS (ORDER BY score)),
    chosen AS (SELECT floor((score + below + 1) / 2.0) AS t FROM cuts WHERE good > 0 AND wrong > 0 ORDER BY passed * good + lost * wrong, abs(score), score LIMIT 1)
    SELECT page_id, host, path, rule, coalesce(says, CASE WHEN score >= coalesce((SELECT t FROM chosen), 0) THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN rule IS NULL THEN score END AS score
    FROM judged LEFT JOIN (SELECT u, score FROM scored WHERE a IS NULL) USING (u)"""


SQL = _sql()
