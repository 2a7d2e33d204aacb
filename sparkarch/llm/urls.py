"""URL filter: rules by host and path, and for the rest a naive Bayes score of host words and path tokens.

Hosts run words together; a unigram model splits them by Viterbi search. The model counts words of the pages' text; the
classifier learns from those urls that the rules decide. Neither has a limit of words, letters or tokens: counts stay tables, and
what a run of letters may hold is joined to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, spread_join, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Runs of a host: small letters, digits, or anything but those and ``.-_``; tokens of a path.
RUNS, TOKENS = r"([a-z]+|[0-9]+|[^a-z0-9._-]+)", r"([a-z0-9]+|[^\x00-\x7F]+)"
#: Added to every token's counts.
ALPHA = 0.5


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; of equally long ones the first; null if none does."""
    name = verdict = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def unigrams(pages: DataFrame, text: str = "html") -> DataFrame:
    """``word``, ``n``: counts of all words of a-z in the pages' text, tags left out."""
    body = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"<[^>]*>", " ")
    return pages.select(F.explode(F.split(body, r"[^a-z]+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def split_run(run: str, known: dict[str, int], total: int) -> list[str]:
    """The most probable split of a run of letters under a unigram model.

    A known word has its share of all ``total`` words (100 at least); an unknown stretch of k letters counts as 10 to the power 1 - k words. So
    two unknown stretches are never side by side, and one pass suffices that knows for every place the best split up to there and
    the best that ends in an unknown stretch. Of equal splits the one with the longer last part is taken.
    """
    total = max(total, 100)
    cost = {w: log(n / total) for w, n in known.items()}
    sizes = sorted({len(w) for w in cost}, reverse=True)
    unknown, letter = log(10 / total), log(10)
    best, start = [0.0], [0]
    open_cost, open_at = float("-inf"), 0
    for end in range(1, len(run) + 1):
        if best[-1] + unknown > open_cost:
            open_cost, open_at = best[-1] + unknown, end - 1
        open_cost -= letter
        top, at = open_cost, open_at
        for k in sizes:
            if k <= end and (c := cost.get(run[end - k : end])) is not None:
                c += best[end - k]
                if c > top or (c == top and end - k < at):
                    top, at = c, end - k
        best.append(top)
        start.append(at)
    out, end = [], len(run)
    while end:
        out.append(run[start[end] : end])
        end = start[end]
    return out[::-1]


def split_runs(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """``run``, ``words`` of each of the distinct runs of letters (column ``run``), under the stored counts of :func:`unigrams`.

    Of each run the parts of those lengths that words have are joined to the counts, so that a run comes with the words it may
    hold, however many words there are.
    """
    total, longest = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], runs.agg(F.coalesce(F.max(F.length("run")), F.lit(0))).first()[0]
    sizes = sorted(r[0] for r in counts.select(F.length("word")).distinct().filter(F.length("word") <= longest).collect())  # at most the longest run
    size = F.array(*[F.lit(k) for k in sizes]) if sizes else F.array().cast("array<int>")
    at = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    fits = F.filter(size, lambda k: F.col("i") + k - 1 <= F.length("run"))
    parts = at.select("run", F.explode(F.transform(fits, lambda k: F.substring(F.col("run"), F.col("i"), k))).alias("word")).distinct()
    held = spread_join(parts, counts, ["word"], ["run"]).groupBy("run").agg(F.collect_list("word").alias("known"), F.collect_list("n").alias("n"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("run", "known", "n")), strict=True)
            found = [split_run(run, dict(zip(known or [], n or [], strict=True)), total) for run, known, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(found, pa.list_(pa.string()))], ["run", "words"])

    return runs.join(held, "run", "left").mapInArrow(split, "run string, words array<string>")


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``host``, ``words``: the distinct hosts (column ``host``), their runs of letters split and the other runs as they are."""
    runs = cut(hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(RUNS), F.lit(1))).alias("pos", "run")))
    splits = cut(split_runs(runs.filter("run rlike '^[a-z]'").select("run").distinct(), counts))
    every = spread_join(runs, splits, ["run"], ["host", "pos"], "left").select("host", "pos", F.coalesce("words", F.array("run")).alias("words"))
    found = every.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("w"))
    return hosts.join(found, "host", "left").select("host", F.coalesce(F.flatten(F.transform("w", lambda x: x["words"])), F.array().cast("array<string>")).alias("words"))


def token_counts(learnt: DataFrame, hosts: DataFrame) -> DataFrame:
    """``token``, ``allow``, ``block``: how often the urls of ``learnt(host, path, decided)`` have each token; ``hosts(host, words)``.

    Urls of one host, or one path, and verdict are counted before their tokens are told apart.
    """
    of_host = learnt.groupBy("host", "decided").agg(F.count("*").alias("n")).join(hosts, "host").select("decided", "n", F.explode("words").alias("t"), F.lit("h ").alias("kind"))
    of_path = learnt.groupBy("path", "decided").agg(F.count("*").alias("n")).select("decided", "n", F.explode(path_tokens(F.col("path"))).alias("t"), F.lit("p ").alias("kind"))
    urls = lambda verdict: F.sum(F.when(F.col("decided") == verdict, F.col("n")).otherwise(0)).alias(verdict)
    return of_host.unionByName(of_path).groupBy(F.concat("kind", "t").alias("token")).agg(urls("allow"), urls("block"))


def path_tokens(path: Column) -> Column:
    return F.regexp_extract_all(F.translate(path, UPPER, LOWER), F.lit(TOKENS), F.lit(1))


def judge(pages: DataFrame, text: str = "html", rules=RULES) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` (of block, 0 to 1), ``host_words``.

    Counts cover all pages. Every url is judged, null and malformed ones too: they have no token and get the prior's verdict. A
    token that no decided url has says nothing. Without any url that a rule decides the verdict is ``allow``; an empty table
    gives no rows; repeated rows are judged each. Other columns of ``pages`` aren't read. Log-odds are added as decimals of 12
    places, so their order doesn't matter. Hosts, paths and tokens that very many urls share are split among tasks.
    """
    host, path = parse_url(F.col("url"))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    parsed = cut(parsed.withColumn("rule", rule).withColumn("decided", decided))
    hosts = cut(host_words(parsed.select("host").distinct(), cut(unigrams(pages, text))))
    learnt = parsed.filter("decided is not null")
    tokens = cut(token_counts(learnt, hosts))
    vocabulary, allow, block = tokens.agg(F.count("*"), F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()
    n_block, n = learnt.agg(F.count_if(F.col("decided") == "block"), F.count("*")).first()
    prior = log((n_block + 1) / (n - n_block + 1))
    share = lambda c, all_: F.log((F.col(c) + ALPHA) / (all_ + ALPHA * max(vocabulary, 1)))
    odds = cut(tokens.select("token", (share("block", block) - share("allow", allow)).cast("decimal(20,12)").alias("odds")))
    summed = lambda held, key: spread_join(held, odds, ["token"], [key]).groupBy(key).agg(F.sum("odds").alias(f"{key}_odds"))
    of_host = hosts.join(summed(hosts.select("host", F.explode("words").alias("w")).select("host", F.concat(F.lit("h "), "w").alias("token")), "host"), "host", "left")
    paths = parsed.select("path").distinct().select("path", F.explode(path_tokens(F.col("path"))).alias("w")).select("path", F.concat(F.lit("p "), "w").alias("token"))
    out = spread_join(parsed, cut(of_host), ["host"], ["page_id", "path"], "left")
    out = spread_join(out, cut(summed(paths, "path")), ["path"], ["page_id", "host"], "left")
    total = F.coalesce(F.col("host_odds"), F.lit(0)) + F.coalesce(F.col("path_odds"), F.lit(0))
    score = 1 / (1 + F.exp(-(F.lit(prior) + total.cast("double"))))
    by_score = F.when(score > 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", by_score).alias("verdict"), score.alias("score"), F.col("words").alias("host_words"))


def op3_host_words_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`judge` of all ``pages``; null and malformed urls get the prior's verdict, repeated rows one each."""
    return judge(table(spark, sf_dir, "pages"))
