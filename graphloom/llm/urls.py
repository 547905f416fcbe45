"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression over host + path (host in A-Z lower case) with
the literal tokens ([a-z0-9]+ of the lowered url) that any match must hold.
Each rule is filed under the rarest of its tokens, counted over all urls (ties:
the smaller token); a url's distinct tokens fetch the rules filed under them,
and only those run their regular expression.  Only DataFrame operations.

Of the rules that match, the lowest level and then the longest text wins; with
equal length block before allow, then the smaller text.  A rule without tokens is a candidate everywhere.

Where no domain rule fits, WORDS decide: general words of unwanted kinds of sites,
each a rule of a later level for hosts, some for paths too.

Defined cases: null url, or one without `://`: host and path are empty and no
rule fits.  Urls of any length are judged whole.  Repeated urls get a row each, no
rows none.  Columns of pages named like an added one are replaced, all others kept,
whatever their names.  Null ids are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fresh, named, small_table, without

BROADCAST_RULES = 100_000
ADDED = ("host", "path", "rule", "level", "verdict")

#: Words by which a site says that it is of an unwanted kind.  Those in HOST_WORDS
#: count in hosts only, since paths of other sites hold them too.
KINDS = {
    "gambling": ["casino", "casinos", "gambling", "roulette", "blackjack", "jackpot", "jackpots", "sportsbook", "bookmaker", "bookmakers"],
    "adult": ["porn", "porno", "xxx", "escort", "escorts", "hentai", "camgirl", "camgirls", "onlyfans", "milf"],
    "pharmacy": ["viagra", "cialis", "tramadol", "xanax", "kamagra", "levitra"],
    "malware": ["malware", "phishing", "ransomware", "trojan", "keylogger", "keygen", "warez", "nulled"],
    "spam": ["spam", "spammer", "scam", "scams", "clickbait", "popunder", "adserver", "adservice"],
}
HOST_WORDS = ["ads", "adx", "adult", "adults", "sex", "nude", "nudes", "bet", "bets", "betting", "poker", "slots", "lotto", "lottery", "pills", "pharmacy", "meds", "steroids", "banners", "tracker", "trackers", "doorway", "replica", "payday", "crack", "cracks", "free money", "get rich", "work from home"]
WORDS = [w for words in KINDS.values() for w in words]


@dataclass(frozen=True)
class Rule:
    text: str
    pattern: str  # over host + path
    tokens: tuple[str, ...]
    verdict: str
    level: int = 0  # a rule of a lower level goes before any of a higher one


def domain_rule(verdict: str, text: str) -> Rule:
    """`host/path`: that host and its subdomains, where the path starts so."""
    host, slash, rest = text.partition("/")
    tokens = re.findall("[a-z0-9]+", host.lower())
    # a path's last token may go on in the url, so it cannot be looked up whole
    whole = re.findall("[a-z0-9]+(?=[^a-z0-9])", rest.lower())
    start = re.escape(slash + rest) if slash else "(?=/|$)"
    return Rule(text, rf"^([^/]*\.)?{re.escape(host.lower())}{start}", (*tokens, *whole), verdict)


def word_rule(verdict: str, words: str, level: int = 1, path: bool = False) -> Rule:
    """`one two`: a host (path: or a path) with these words in a row, as whole tokens."""
    tokens = re.findall("[a-z0-9]+", words.lower())
    return Rule(words, ("(?s)^.*?" if path else "^[^/]*?") + "(?<![a-z0-9])" + "[^a-z0-9/]+".join(tokens) + "(?![a-z0-9])", tuple(tokens), verdict, level)


def general_rules() -> list[Rule]:
    return [word_rule("block", w, path=True) for w in WORDS] + [word_rule("block", w) for w in HOST_WORDS]


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; else empty."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """The columns of pages with host, path, rule and level (null: none fits) and verdict."""
    spark = pages.sparkSession
    kept = without(pages.columns, ADDED)
    tokens, token, found = fresh([*kept, *ADDED], "tokens", "token", "found")
    split = pages.select(*named(kept), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    words = F.array_distinct(F.regexp_extract_all(lowered(F.concat("host", "path")), F.lit("([a-z0-9]+)"), F.lit(1)))
    split = split.withColumn(tokens, words)
    literal = sorted({t for r in rules for t in r.tokens})
    asked = split.select(F.explode(tokens).alias("t")).where(F.col("t").isin(literal)).groupBy("t").agg(F.count("*").alias("n")) if literal else None
    seen = {r.t: r.n for r in asked.collect()} if literal else {}  # at most the rules' tokens
    index = [(min(r.tokens, key=lambda t: (seen.get(t, 0), t)) if r.tokens else "", r.text, r.pattern, r.verdict, r.level) for r in rules]
    table = small_table(spark, index, f"{token} string, text string, pattern string, said string, depth int")
    if len(rules) <= BROADCAST_RULES:  # else Spark shuffles both sides
        table = F.broadcast(table)
    # equal urls are judged once; the way back is a join that AQE can split
    once = split.where("host <> ''").groupBy("host", "path").agg(F.first(tokens).alias("t"))
    once = once.select("host", "path", lowered(F.concat("host", "path")).alias("low"), F.explode(F.concat("t", F.array(F.lit("")))).alias(token))
    # domain rules see the path as it is, word rules see it lowered
    fit = once.join(table, token).where(F.expr("if(depth = 0, concat(host, path), low) rlike pattern"))
    order = F.struct(F.col("depth").alias("level"), (-F.length("text")).alias("l"), (F.col("said") != "block").alias("v"), F.col("text").alias("rule"), F.col("said").alias("verdict"))
    best = fit.groupBy("host", "path").agg(F.min(order).alias(found))
    out = split.drop(tokens).join(best, ["host", "path"], "left")
    return out.select(*named(kept), "host", "path", F.col(f"{found}.rule").alias("rule"), F.col(f"{found}.level").alias("level"), F.coalesce(f"{found}.verdict", F.lit(default)).alias("verdict"))
