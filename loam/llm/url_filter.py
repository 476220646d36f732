"""URL verdicts: explicit rules first, then naive Bayes over segmented host and path words.

Hosts often join words without a separator. A unigram model over known words, with a length penalty
for unknown stretches, gives the most probable split by the Viterbi recursion, in time linear in the name. The words of host and
path then go to a multinomial naive Bayes model. Both models are trained here. Unigram counts come from a built-in word list and from all
pages: a word counts once for each host that has it as a whole part of its name or of a path, so that one site's joined name is no word. The
classes of the Bayes model are weak labels, since no table labels urls: a host that holds a listed trigger word is bad. The model
goes beyond the list by the other words of such hosts' urls.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

TRIGGERS = (
    "casino poker slots slot bet bets betting win winner jackpot lottery roulette pills pill viagra cialis pharma meds drugs cheap free bonus "
    "porn sex xxx adult escort dating hot ads ad track tracker tracking click clicks popup banner affiliate spam malware phish warez crack keygen torrent loan loans payday replica"
).split()
COMMON = (
    "the and for with news blog shop store home mail web site page info data world life time book books food health travel music game games tech "
    "sport sports city school science art photo video online forum wiki docs help support about contact media press daily local best new my your our "
    "example com net org www m en de fr es html index search user item list view go get all one two top"
).split()
LEAST_HOSTS, LONGEST, MOST_WORDS = 3, 32, 50_000  # of the vocabulary that is learned
UNKNOWN_LETTER = 3.0
WORDS = re.compile(r"[^\W\d_]+|\d+")
NEUTRAL = frozenset("www m blog com net org example en de fr es html index".split())  # parts of most hosts and paths: no evidence


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null where none does. Rule sets are small literals."""
    rule = verdict = None
    for text, say in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        where, _, below = text.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith("/" + below)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


@dataclass
class UrlModel:
    """unigram: log probability of words. log_odds: word -> log P(word|block) - log P(word|allow)."""

    unigram: dict[str, float]
    unknown: float
    log_odds: dict[str, float]
    prior: float

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.unigram), default=0)

    def cost(self, part: str) -> float:
        """Log probability of one part; an unknown stretch costs ``unknown`` and more per character."""
        p = self.unigram.get(part)
        return p if p is not None else self.unknown - UNKNOWN_LETTER * len(part)

    def split(self, text: str) -> list[str]:
        """The most probable split of a joined name of any length. Ties go to the longer last part."""
        n = len(text)
        if n <= 1:
            return [text] if text else []
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        open_, begun = -math.inf, 0  # the best split that ends within an unknown stretch, and where that begins
        get = self.unigram.get
        for end in range(1, n + 1):
            if best[end - 1] + self.unknown > open_:
                open_, begun = best[end - 1] + self.unknown, end - 1
            open_ -= UNKNOWN_LETTER
            score, at = open_, begun
            for begin in range(max(0, end - self.longest), end):
                p = get(text[begin:end])
                if p is not None and best[begin] + p > score:
                    score, at = best[begin] + p, begin
            best[end], back[end] = score, at
        out, end = [], n
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        return [w for part in WORDS.findall(host) for w in self.split(part)] + [w for part in WORDS.findall(path.lower()) if not part.isdigit() for w in self.split(part)]

    def score(self, host: str, path: str) -> float:
        """P(block). Words outside the model have no say; an empty url scores the prior."""
        z = self.prior + sum(self.log_odds.get(t, 0.0) for t in self.tokens(host, path))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def counted(rows: list[tuple[str, str, int]]) -> tuple[dict[str, int], list[tuple[str, str, int]]]:
    """(hosts of each word, the rows) of (host, path, urls) rows on the driver; ``word_hosts`` does this for tables."""
    seen = {(w, host) for host, path, _ in rows for w in WORDS.findall(host) + WORDS.findall(path.lower()) if not w.isdigit()}
    return Counter(w for w, _ in seen), rows


def word_hosts(urls: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(word, hosts): on how many hosts each word of 3 to ``LONGEST`` letters is a whole part of host or path, over all pages; the ``most_words`` commonest on ``LEAST_HOSTS`` or more."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "host", "path")), F.lit(r"\p{L}+"), F.lit(0))
    rows = urls.where("host <> ''").select("host", F.explode(F.array_distinct(words)).alias("word")).where(f"length(word) between 3 and {LONGEST}").distinct()
    return rows.groupBy("word").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= LEAST_HOSTS).orderBy(F.desc("hosts"), "word").limit(most_words)


def composite(word: str, known) -> bool:
    """Whether a word is two or more known words of three letters or more: a name that many hosts share is still a joined one."""
    n = len(word)
    reached = [True] + [False] * n
    for end in range(3, n + 1):
        reached[end] = any(reached[b] and word[b:end] in known for b in range(end - 2) if (b, end) != (0, n))
    return reached[n]


def train(counts: dict[str, int], rows: list[tuple[str, str, int]]) -> UrlModel:
    """Fit on hosts of each word and rows of (host, path, urls). Works without any, from the word lists alone."""
    known = Counter({w: 400 for w in COMMON})
    known.update({w: 400 for w in TRIGGERS if len(w) > 2})
    known.update({w: 40 for w in TRIGGERS if len(w) <= 2})
    for w, n in sorted(counts.items(), key=lambda c: (len(c[0]), c[0])):
        if len(w) > 2 and n >= LEAST_HOSTS and (w in known or not composite(w, known)):
            known[w] += 10 * n
    total = sum(known.values())
    model = UrlModel({w: math.log(c / total) for w, c in known.items()}, math.log(0.5 / total), {}, 0.0)
    trigger = frozenset(TRIGGERS)
    seen = {True: Counter({w: 4 for w in TRIGGERS}), False: Counter({w: 4 for w in COMMON if w not in NEUTRAL})}
    sites = {True: 1.0, False: 3.0}
    for host, path, _ in rows:
        bad = any(w in trigger for w in model.tokens(host, ""))
        sites[bad] += 1
        seen[bad].update(w for w in model.tokens(host, path) if w not in NEUTRAL)
    vocabulary = seen[True].keys() | seen[False].keys()
    sums = {k: sum(c.values()) + len(vocabulary) for k, c in seen.items()}
    model.log_odds = {w: math.log((seen[True][w] + 1) / sums[True]) - math.log((seen[False][w] + 1) / sums[False]) for w in vocabulary}
    model.prior = math.log(sites[True] / sites[False])
    return model


def fit(urls: DataFrame, sample: int = 20_000) -> UrlModel:
    """Unigram counts over all rows; the Bayes model on at most ``sample`` labelled (host, path) pairs, those of least hash. ``urls`` has host and path."""
    counts = {r.word: r.hosts for r in word_hosts(urls).collect()}
    pairs = urls.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    rows = pairs.orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample).collect()
    return train(counts, [(r.host, r.path, r.n) for r in rows])


def judge(pages: DataFrame, rules=RULES, sample: int = 20_000, model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row; only the url is read.

    A null url, or one without ``://``, has empty host and path: no rule fits and the prior decides.
    Repeated rows and null ids are kept as they are.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    model = model or fit(parts, sample)

    def run(batches):
        score = lru_cache(50_000)(model.score)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([score(h, p) for h, p in zip(hosts, paths)], pa.float64())], [*batch.schema.names, "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    scored = parts.mapInArrow(run, f"page_id {kind}, host string, path string, score double")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judge(table(spark, sf_dir, "pages"))
