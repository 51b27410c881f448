"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, the posterior decides."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtok.llm.common import fresh, on_worker, settled, strings

STOP_WORDS = (
    "the of and to a in that is was for on with he be by at der die und das den ein eine zu von mit ist nicht auf im dem des sich "
    "auch als de la el que y en los las un una se por con para no le les et une du dans est pour qui sur par au pas avec"
).split()

#: Each rule's votes, from its value: against a document, and for it. Where neither holds, or the value is not a number, it abstains.
RULES = {
    "length": (lambda v, n, chars: n < 1, lambda v, n, chars: n >= 50),
    "capitals": (lambda v, n, chars: (v > 0.3) & (chars >= 20), lambda v, n, chars: (v < 0.1) & (chars >= 20)),
    "symbols": (lambda v, n, chars: v > 0.03, lambda v, n, chars: v < 0.004),
    "shouts": (lambda v, n, chars: v > 0.2, lambda v, n, chars: v == 0),
    "letters": (lambda v, n, chars: v > 0.35, lambda v, n, chars: v < 0.26),
    "unique": (lambda v, n, chars: (v < 0.7) & (n >= 20), lambda v, n, chars: (v > 0.8) & (n >= 20)),
    "repeats": (lambda v, n, chars: (v > 0.2) & (n >= 5), lambda v, n, chars: (v < 0.05) & (n >= 5)),
    "stops": (lambda v, n, chars: (v < 0.04) & (n >= 20), lambda v, n, chars: v > 0.12),
    "word_length": (lambda v, n, chars: ((v < 3) | (v > 8.5)) & (n >= 5), lambda v, n, chars: (v > 4.5) & (v < 7.2)),
}
CAPITAL, SYMBOL, SHOUT, LETTER = 1, 2, 4, 8


def character_kinds() -> np.ndarray:
    """The kinds of every code point as bits: a capital from A to Z or of Latin-1, a symbol, an exclamation mark, a letter or number."""
    table = np.fromiter((LETTER * (unicodedata.category(chr(c))[0] in "LN") for c in range(0x110000)), np.uint8, 0x110000)
    table[[*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] |= CAPITAL
    table[[ord(c) for c in "*#%&$|<>{}[]@~^=\\"]] |= SYMBOL
    table[ord("!")] |= SHOUT
    return table


def measure(text: str | None, kinds: np.ndarray, stop_words: frozenset[bytes]) -> tuple[int, ...]:
    """(words, characters, capitals, symbols, shouts, letters, distinct words, words like the one before, stop words).

    Words are lower case and what ASCII white space separates. All is 0 of a text without words.
    """
    words = text.lower().encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return (0,) * 9
    codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.bincount(kinds[codes], minlength=16)
    of = lambda bit: int(seen[[k for k in range(16) if k & bit]].sum())
    return len(words), len(text), of(CAPITAL), of(SYMBOL), of(SHOUT), of(LETTER), len(set(words)), sum(map(eq, words, islice(words, 1, None))), sum(map(stop_words.__contains__, words))


def votes_of(measures: np.ndarray) -> np.ndarray:
    """(texts, rules) of -1, 0 and 1, from rows of :func:`measure`."""
    n, chars, capitals, symbols, shouts, letters, distinct, repeats, stops = measures.astype(float).T
    with np.errstate(divide="ignore", invalid="ignore"):  # a share of nothing is not a number, which compares false
        values = {
            "length": n,
            "capitals": capitals / chars,
            "symbols": symbols / chars,
            "shouts": shouts / n,
            "letters": (chars - letters) / chars,
            "unique": np.where(n == 1, np.nan, np.log(distinct) / np.log(n)),  # falls little with the length of a text
            "repeats": repeats / n,
            "stops": stops / n,
            "word_length": chars / n,
        }
        out = np.zeros((len(n), len(RULES)), np.int8)
        for i, (name, (bad, good)) in enumerate(RULES.items()):
            v = values[name]
            out[:, i] = np.where(bad(v, n, chars), -1, np.where(good(v, n, chars), 1, 0))
    return out


#: A pattern of votes as one number: a digit of base 3 for each rule, the first one's leading, 0 against, 1 abstains, 2 for.
PLACES = [3 ** (len(RULES) - 1 - i) for i in range(len(RULES))]


def pattern(text: Column) -> Column:
    """The votes on a text as one smallint. Counting characters and words in numpy takes a quarter of the time that the
    like native expressions take, since these make an array of every match."""

    @F.arrow_udf("smallint")
    def voted(texts: pa.Array) -> pa.Array:
        kinds, stop_words = on_worker("quality", lambda: (character_kinds(), frozenset(w.encode() for w in STOP_WORDS)))
        rows = np.array([measure(t, kinds, stop_words) for t in strings(texts)], np.int64).reshape(-1, 9)
        return pa.array((votes_of(rows) + 1).astype(np.int64) @ np.array(PLACES), pa.int16())

    return voted(text)


def digit(code: Column, rule: int) -> Column:
    """The digit of a rule in a pattern: 0 against, 1 abstains, 2 for."""
    return F.floor(code / PLACES[rule]).cast("int") % 3


@dataclass(frozen=True)
class LabelModel:
    """P(vote | class, the rule votes) for each rule, class (bad, good) and vote (-1, 1), and the share of good documents."""

    prior: float
    tables: np.ndarray  # rules x 2 x 2

    def score(self, code: Column) -> Column:
        """Posterior probability of good quality, as an expression over a pattern: no join and no Python row by row. An abstention says nothing."""
        weights = np.log(self.tables[:, 1, :]) - np.log(self.tables[:, 0, :])
        logit = F.lit(float(np.log(self.prior) - np.log1p(-self.prior)))
        for i, w in enumerate(weights):
            logit = logit + F.get(F.array(*map(F.lit, map(float, (w[0], 0, w[1])))), digit(code, i))
        return 1 / (1 + F.exp(-logit))

    def accuracies(self) -> dict[str, float]:
        """Of each rule: how often its vote is right, were its votes spread over the classes as the documents are."""
        return dict(zip(RULES, (self.prior * self.tables[:, 1, 1] + (1 - self.prior) * self.tables[:, 0, 0]).tolist(), strict=True))


#: What is believed of a rule before any vote is seen: this accuracy, as firmly as after so many votes in each class.
BELIEF, FIRMNESS = 0.8, 10.0
#: EM ends after so many rounds, or when no posterior moves by this much any more.
ROUNDS, MOVED = 200, 1e-9


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns with their counts.

    It starts from votes against a document only: junk of one kind looks well to the rules for other kinds. Ends when the posteriors move by less than ``MOVED``. No pattern gives a model of the beliefs alone.
    """
    n_rules = patterns.shape[1]
    belief = np.array([[BELIEF, 1 - BELIEF], [1 - BELIEF, BELIEF]]) * FIRMNESS
    if not len(patterns):
        return LabelModel(0.5, np.tile(belief / FIRMNESS, (n_rules, 1, 1)))
    post = 1 / (1 + np.exp(2.5 * (patterns < 0).sum(1) - 3.0))
    hot = np.stack([patterns == v for v in (-1, 1)], 2).astype(float)  # patterns x rules x 2
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])  # 2 x patterns
        tables = np.einsum("cp,prv->rcv", weight, hot) + belief
        tables /= tables.sum(2, keepdims=True)
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        logs = np.einsum("prv,rcv->pc", hot, np.log(tables)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        if np.abs(new - post).max() < MOVED:
            break
        post = new
    return LabelModel(float(prior), tables)


def fit(voted: DataFrame, name: str) -> LabelModel:
    """EM over the whole table. Only distinct patterns, 3 ** 9 at most, come to the driver."""
    rows = voted.groupBy(name).count().orderBy(name).collect()
    codes, counts = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    return em(codes[:, None] // np.array(PLACES) % 3 - 1, counts.astype(float))


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, votes, posterior, keep) for each row of ``docs``.

    ``votes`` has a sign for each rule, in the order of ``RULES``: + good, - bad, 0 abstains. ``keep`` is
    posterior >= threshold. Null, empty or blank text has 0 words: the rule on length votes against it, all others abstain.
    Repeated rows count as often as they stand there and get the same result; a null doc_id stays null. Other
    columns are left out. An empty table gives an empty table.
    """
    voted = settled(docs.select("doc_id", pattern(F.col("text")).alias("v")))
    model, v = fit(voted, "v"), F.col("v")
    signs = F.concat(*(F.get(F.array(F.lit("-"), F.lit("0"), F.lit("+")), digit(v, i)) for i in range(len(RULES))))
    return voted.select("doc_id", signs.alias("votes"), model.score(v).alias("posterior")).withColumn("keep", F.col("posterior") >= threshold)


def stage(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that :func:`quality` keeps, with all their columns. They are written with their votes once, and nothing is shuffled."""
    (name,) = fresh(docs, "__quality_votes")
    voted = settled(docs.withColumn(name, pattern(F.col("text"))))
    return voted.where(fit(voted, name).score(F.col(name)) >= threshold).select(*docs.columns)


def _oracle() -> str:
    """The votes, and EM over their patterns as a recursive query: a step is a row of sums over all patterns."""
    rules = range(1, len(RULES) + 1)
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    sums = ", ".join(f"sum(cnt * {'post' if c else '(1 - post)'}) FILTER (WHERE v[{r}] = {s}) OVER () AS s{r}_{c}_{'p' if s > 0 else 'm'}" for r in rules for c in (0, 1) for s in (-1, 1))

    def table(r: int, c: int, s: str) -> str:
        weight = lambda k: f"(coalesce(s{r}_{c}_{k}, 0) + {(BELIEF if (k == 'p') == bool(c) else 1 - BELIEF) * FIRMNESS})"
        return f"{weight(s)} / ({weight('m')} + {weight('p')})"

    logit = " + ".join(f"CASE v[{r}] WHEN 1 THEN ln({table(r, 1, 'p')}) - ln({table(r, 0, 'p')}) WHEN -1 THEN ln({table(r, 1, 'm')}) - ln({table(r, 0, 'm')}) ELSE 0 END" for r in rules)
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS words FROM documents),
m AS (SELECT doc_id, CAST(len(words) AS DOUBLE) AS n, CAST(length(text) AS DOUBLE) AS chars, length(regexp_replace(text, '[^A-Z\\x{{c0}}-\\x{{d6}}\\x{{d8}}-\\x{{de}}]', '', 'g')) AS capitals,
 length(regexp_replace(text, '[^*#%&$|<>{{}}\\[\\]@~^=\\\\]', '', 'g')) AS symbols, length(regexp_replace(text, '[^!]', '', 'g')) AS shouts, length(regexp_replace(text, '[\\p{{L}}\\p{{N}}]', '', 'g')) AS other,
 len(list_distinct(words)) AS uniques, len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS repeats, len(list_filter(words, lambda w: w IN ({stops}))) AS stops FROM d),
s AS (SELECT doc_id, n, chars, capitals / chars AS capitals, symbols / chars AS symbols, shouts / n AS shouts, other / chars AS other, CASE WHEN n > 1 THEN ln(uniques) / ln(n) END AS uniques, repeats / n AS repeats, stops / n AS stops, chars / n AS mean FROM m),
r AS (SELECT doc_id, CASE WHEN n < 1 THEN [-1, 0, 0, 0, 0, 0, 0, 0, 0] ELSE [CASE WHEN n >= 50 THEN 1 ELSE 0 END,
 CASE WHEN chars < 20 THEN 0 WHEN capitals > 0.3 THEN -1 WHEN capitals < 0.1 THEN 1 ELSE 0 END, CASE WHEN symbols > 0.03 THEN -1 WHEN symbols < 0.004 THEN 1 ELSE 0 END,
 CASE WHEN shouts > 0.2 THEN -1 WHEN shouts = 0 THEN 1 ELSE 0 END, CASE WHEN other > 0.35 THEN -1 WHEN other < 0.26 THEN 1 ELSE 0 END,
 CASE WHEN n < 20 THEN 0 WHEN uniques < 0.7 THEN -1 WHEN uniques > 0.8 THEN 1 ELSE 0 END, CASE WHEN n < 5 THEN 0 WHEN repeats > 0.2 THEN -1 WHEN repeats < 0.05 THEN 1 ELSE 0 END,
 CASE WHEN stops < 0.04 AND n >= 20 THEN -1 WHEN stops > 0.12 THEN 1 ELSE 0 END, CASE WHEN (mean < 3 OR mean > 8.5) AND n >= 5 THEN -1 WHEN mean > 4.5 AND mean < 7.2 THEN 1 ELSE 0 END] END AS v FROM s),
p AS MATERIALIZED (SELECT v, CAST(count(*) AS DOUBLE) AS cnt FROM r GROUP BY v),
e(it, v, cnt, post, moved) AS (SELECT 0, v, cnt, 1 / (1 + exp(2.5 * len(list_filter(v, lambda x: x < 0)) - 3)), CAST(1 AS DOUBLE) FROM p UNION ALL
 SELECT it + 1, v, cnt, new, max(abs(new - post)) OVER () FROM (SELECT it, v, cnt, post, 1 / (1 + exp(least(greatest(-(ln(prior) - ln(1 - prior) + {logit}), -700), 700))) AS new FROM (
  SELECT *, (sum(cnt * post) OVER () + 1) / (sum(cnt) OVER () + 2) AS prior, {sums} FROM e WHERE it < {ROUNDS} AND moved >= {MOVED}))),
f AS (SELECT v, post FROM e WHERE it = (SELECT max(it) FROM e))
SELECT doc_id, array_to_string(list_transform(r.v, lambda x: CASE x WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '0' END), '') AS votes, round(post, 6) AS posterior, post >= 0.5 AS keep FROM r JOIN f ON r.v = f.v"""


ORACLE = _oracle()
