"""URL filter: host and path rules, else logistic regression on hashed character n-grams.

A small labelled URL table (at most MAX_LABELLED rows, the bound on what the driver reads) trains
the weights: n-grams of 3 to 5 characters of the host and of the path, hashed apart into BINS
weights of fixed size, so what executors receive never grows with the data. The built-in table is
made by rule of ordinary words, words of unwanted trades and made-up names; a word that it doesn't
have is mostly let pass. Host, path and rules are DataFrame expressions; only rows without a rule
reach the Python scorer, an Arrow map that remembers hosts and paths it has scored. No shuffle.

Defined results: a null url or one without `://` has empty host and path, no rule, and the
verdict of the model on two empty strings; page_id may be null or repeated, rows pass one to one;
other columns are ignored, whatever their names; of rules of equal length that fit, the later one in
alphabetical order wins; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 1 << 15
MAX_LABELLED = 20_000
DIGIT = re.compile("[0-9]")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Host and path rules, and whether a page they fit is allowed.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

# Words of the built-in labelled table. Names are made of them by rule, not taken from any pages.
PLAIN_WORDS = """academy airport architecture archive astronomy bakery bank biology books botany bridge camera castle charity chemistry choir church cinema city climate clinic coffee college computing concert
cooking council cricket cycling dance design dictionary economy education electronics encyclopedia energy engineering family farming fashion fishing football forest furniture gallery garden geography grammar
guitar harbour health history hospital hotel house island jazz journal kitchen lake language law library literature magazine maps market mathematics medicine mountain museum music nature news novels opera
orchestra painting parliament park philosophy photography physics poetry politics pottery railway radio recipes research river sailing school science sculpture software sports statistics students teacher
television tennis theatre tourism travel university vegetables village violin water weather weekly wildlife wine women world""".split()
UNWANTED_WORDS = """bet bets betting bookmaker bingo casino casinos gamble gambling jackpot lottery poker roulette slot-machine slots wager cialis diet-pills meds painkillers pharmacy pill pills steroids viagra
adult adults-only cams erotic escorts nude porn porno sex sexy xxx cash credit forex loan loans payday counterfeit fake replica crack cracked keygen malware phishing spyware torrent torrents trojan virus warez
adserver ads advert banners clicks popups tracker tracking backlinks bulk-mail junk-mail seo spam spambot spammer spamming""".split()
#: Words that go with either kind, so that they say nothing themselves.
EITHER_WORDS = "best big club daily deals direct easy first global home hot live max my new now online plus pro shop top zone".split()
#: Openings, vowels and endings of syllables of made-up names, which are wanted ones.
OPENINGS = "b c d f g h j k l m n p r s t v w y z bl br ch cl cr dr fl fr gl gr pl pr qu sh sl sp st th tr wh".split()
VOWELS = "a e i o u ai ea ee ie io oa oo ou".split()
CLOSINGS = ["", "", "", "n", "r", "s", "l", "t", "nd", "ng", "st", "ck"]
MADE_UP = 300
PLAIN_PATHS = "/ /about /en/123 /de/45.html /fr/678/ /es/9 /articles/item /2024/05/report /index.php".split()
AFFIXES = ["", "www.", "blog.", "m."]
ENDINGS = ["com", "net", "org"]


def labelled_hosts() -> list[tuple[str, str, int]]:
    """(word, host name, 1 for unwanted): each word alone and with words that go with either kind, and made-up names."""
    out = []
    for label, words in ((0, PLAIN_WORDS), (1, UNWANTED_WORDS)):
        for i, word in enumerate(words):
            out.append((word, word, label))
            for j in range(6 if label else 3):
                other = EITHER_WORDS[(5 * i + 7 * j) % len(EITHER_WORDS)]
                first, second = (word, other) if (i + j) % 2 else (other, word)
                out.append((word, f"{first}{'-' if j % 3 else ''}{second}", label))
    r = np.random.default_rng(0)
    for _ in range(MADE_UP):
        name = "".join(f"{r.choice(OPENINGS)}{r.choice(VOWELS)}{r.choice(CLOSINGS)}" for _ in range(r.integers(2, 5)))
        out.append((name, name, 0))
    return out


def labelled_urls(hosts: list[tuple[str, str, int]] | None = None) -> list[tuple[str, int]]:
    """(url, 1 for unwanted): hosts with paths, prefixes and endings in turn."""
    out = []
    for i, (_, name, label) in enumerate(labelled_hosts() if hosts is None else hosts):
        for j in range(2):
            place = ["", ".example"][(i + j) % 2]
            out.append((f"https://{AFFIXES[(i + j) % 4]}{name}{place}.{ENDINGS[(i + 2 * j) % 3]}{PLAIN_PATHS[(i + 4 * j) % len(PLAIN_PATHS)]}", label))
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url, both empty where there is no `://`."""
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return (m[1].translate(str.maketrans(UPPER, LOWER)), m[2]) if m else ("", "")


def grams(part: str, text: str) -> np.ndarray:
    """Hashed n-grams of a marked host ("h") or path ("p"); digits count as one character."""
    s = f"^{DIGIT.sub('0', text)}$"
    return np.array([crc32(f"{part}{s[i : i + n]}".encode()) % BINS for n in (3, 4, 5) for i in range(max(1, len(s) - n + 1))], np.int64)


def train(labelled: list[tuple[str, int]], steps: int = 400, rate: float = 8.0, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent; deterministic. Class weights are even."""
    rows = []
    for url, _ in labelled:
        host, path = split_url(url)
        rows.append([(g := grams(*x), np.full(len(g), len(g) ** -0.5)) for x in (("h", host), ("p", path))])
    at = np.concatenate([g for r in rows for g, _ in r])
    value = np.concatenate([v for r in rows for _, v in r])
    row = np.repeat(np.arange(len(rows)), [sum(len(g) for g, _ in r) for r in rows])
    y = np.array([label for _, label in labelled], float)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, bias = np.zeros(BINS), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, value * w[at], len(rows)) + bias)))
        error = (p - y) * share
        w -= rate * (np.bincount(at, value * error[row], BINS) + penalty * w)
        bias -= rate * error.sum()
    return w, bias


class Scorer:
    def __init__(self, w: np.ndarray, bias: float):
        self.w, self.bias, self.seen = w, bias, {}

    def part(self, part: str, text: str) -> float:
        found = self.seen.get((part, text))
        if found is None:
            g = grams(part, text)
            found = float(self.w[g].sum() * len(g) ** -0.5)
            if len(self.seen) >= 200_000:
                self.seen.clear()
            if len(text) <= 256:
                self.seen[part, text] = found
        return found

    def __call__(self, host: str, path: str) -> float:
        """Probability of an unwanted page."""
        return float(1 / (1 + np.exp(-(self.part("h", host) + self.part("p", path) + self.bias))))


def fitting_rule(host, path, rules: list[tuple[str, str]]) -> tuple:
    """(rule, verdict) columns: of the rules that fit, the longest; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later, longer ones win
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str]] | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the model's probability, null by rule.

    labelled: (url, label 0/1) rows, at most MAX_LABELLED; the built-in table where it is None.
    """
    spark: SparkSession = pages.sparkSession
    table = labelled_urls()
    if labelled is not None:
        table = [(r["url"], int(r["label"])) for r in labelled.select("url", "label").where("label is not null").limit(MAX_LABELLED + 1).collect()]
        if len(table) > MAX_LABELLED:
            raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    model = spark.sparkContext.broadcast(train(table))

    url, at = F.col(url_col), F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract("__rest", "^[^/?#]*", 0)
    parts = pages.select(F.col(id_col).alias("page_id"), rest.alias("__rest")).select("page_id", F.translate(host, UPPER, LOWER).alias("host"), F.regexp_extract(F.substr("__rest", F.length(host) + 1), "^[^?#]*", 0).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules if rules is not None else RULES)
    parts = parts.withColumns({"rule": rule, "verdict": verdict})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for b in batches:
            ids, hosts, paths, ruled, verdicts = b.columns
            score = [None if v else scorer(h, p) for h, p, v in zip(hosts.to_pylist(), paths.to_pylist(), verdicts.to_pylist(), strict=True)]
            said = [v or ("block" if s >= threshold else "allow") for v, s in zip(verdicts.to_pylist(), score, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, hosts, paths, ruled, pa.array(said, pa.string()), pa.array(score, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    return parts.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
