"""URL filter by pattern rules indexed by their rarest literal token.

Every rule is a regular expression over `host + path`, with the literal tokens that any fitting
URL must hold.  A rule is filed under the one of its tokens that is rarest in the URLs at hand;
the tokens of a URL fetch the rules filed under them, and only those rules are run.  Rules
without a literal token stand in a bucket of their own that every URL fetches.

Everything is one projection of DataFrame expressions.  The index is a literal array of buckets
addressed by a hash of the token, so a lookup costs the same however many rules there are.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"
NOT_TOKEN = r"[^a-z0-9]+"
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The index travels inside the plan; more rules than this belong in a table of their own.
MAX_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """rank: a larger one wins.  pattern: searched in host + path.  tokens: all in any fitting URL."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def host_path_rule(action: str, text: str) -> Rule:
    """A rule such as `example.com/en/7`: that host and its subdomains, paths that begin with /en/7.

    The last token of the path may go on in the URL, so it isn't one of the literal tokens
    unless something that isn't a letter or digit ends it.
    """
    host, slash, path = text.partition("/")
    whole = f"{host.lower()}{slash}{path}"
    closed = whole if not slash or not re.search(r"[A-Za-z0-9]$", path) else re.sub(r"[A-Za-z0-9]+$", "", whole)
    pattern = r"^([^/]*\.)?" + re.escape(host.lower()) + (re.escape(slash + path) if slash else r"(/|$)")
    return Rule(text, action, pattern, tuple(dict.fromkeys(re.findall(TOKEN, closed.lower()))), 1_000_000 + len(text))


def word_rule(action: str, words: str, where: str = "host") -> Rule:
    """A rule for tokens that stand side by side, joined by `-` or `_` or `.`, in the host or anywhere."""
    parts = words.lower().split()
    body = r"[-_.]".join(map(re.escape, parts))
    before = r"(^|[^A-Za-z0-9/][^/]*|[^/]*[^A-Za-z0-9])" if where == "host" else r"(^|[^A-Za-z0-9])"
    start = r"^([^/]*[^A-Za-z0-9/])?" if where == "host" else before
    return Rule("-".join(parts), action, f"(?i){start}{body}($|[^A-Za-z0-9])", tuple(parts), len(words))


#: The method's own rules, for URLs on which no host/path rule decides.
DEFAULT_WORD_RULES = [
    word_rule("block", w) for w in (
        "casino", "free bets", "sports bet", "poker", "jackpot", "adult", "porn", "xxx", "escort", "cheap pills",
        "viagra", "cialis", "replica watches", "payday loans", "spam farm", "link farm", "ads track", "adserver",
        "doubleclick", "popunder", "warez", "torrent", "keygen", "malware", "phishing",
    )
] + [word_rule("block", w, "anywhere") for w in ("adclick", "click tracker", "affiliate redirect")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    found = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(found > 0, F.substr(url, found + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, A_Z, a_z), path


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.concat(host, F.translate(path, A_Z, a_z)), NOT_TOKEN), lambda t: t != ""))


def rarest_tokens(urls: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """How many URLs hold each of the rules' literal tokens.

    One aggregate row comes back, with as many numbers as the rules have tokens.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    host, path = url_parts(F.col(f"`{url_col}`"))
    held = urls.select(F.explode(F.array_intersect(url_tokens(host, path), F.array(*map(F.lit, wanted)))).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def rule_index(rules: list[Rule], counts: dict[str, int]) -> Column:
    """Buckets of rules; bucket 0 has the rules without a token."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit into a plan")
    n = max(1, 2 * len(rules))
    filed: list[list[dict]] = [[] for _ in range(n + 1)]
    for rule in rules:
        token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        at = 1 + bucket_of(token, n) if token else 0
        filed[at].append({"token": token, "name": rule.name, "action": rule.action, "pattern": rule.pattern, "rank": rule.rank})
    return F.from_json(F.lit(json.dumps(filed)), "array<array<struct<token:string,name:string,action:string,pattern:string,rank:int>>>")


def bucket_of(token: str, n: int) -> int:
    import zlib

    return zlib.crc32(token.encode()) % n


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", counts: dict[str, int] | None = None,
          default: str = "allow") -> DataFrame:
    """Add host, path, rule, rule_rank and verdict to each row.

    Of the rules that fit, the one of the highest rank (the longest) decides, `block` before
    `allow` and then by name in a tie; no fitting rule: `default`, and a null rule.  A null URL or one without
    `://` has an empty host and path, so only rules that fit the empty text could decide.
    Columns of `pages` with the names of the outputs are replaced, others may have any name.
    Urls of any length are judged whole; rows are never dropped, joined or shuffled, repeated ones
    get equal verdicts, and an empty table gives an empty result.
    """
    counts = rarest_tokens(pages, rules, url_col) if counts is None else counts
    n = max(1, 2 * len(rules))
    host, path = url_parts(F.col(f"`{url_col}`"))
    outputs = ("host", "path", "rule", "rule_rank", "verdict")
    base = pages.select(F.struct("*").alias("__row"), host.alias("__host"), path.alias("__path"))  # so that no name clashes
    index = rule_index(rules, counts)

    def fetched(token: Column) -> Column:
        bucket = F.element_at(index, (F.lit(2) + F.crc32(token.cast("binary")) % n).cast("int"))
        return F.filter(bucket, lambda r: r["token"] == token)

    candidates = F.concat(F.element_at(index, 1), F.flatten(F.transform(url_tokens(F.col("__host"), F.col("__path")), fetched)))
    fitting = F.filter(candidates, lambda r: F.rlike(F.concat(F.col("__host"), F.col("__path")), r["pattern"]))
    ordered = F.transform(fitting, lambda r: F.struct(
        (-r["rank"]).alias("order"), (r["action"] != "block").alias("allows"), r["name"].alias("name"), r["action"].alias("action")))
    best = base.select("*", F.array_min(ordered).alias("__best"))
    kept = [F.col(f"__row.`{c}`").alias(c) for c in pages.columns if c not in outputs]
    return best.select(
        *kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.name").alias("rule"),
        (-F.col("__best.order")).alias("rule_rank"), F.coalesce(F.col("__best.action"), F.lit(default)).alias("verdict"),
    )
