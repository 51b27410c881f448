"""The seed table of Unigram against a plain count of all substrings."""

import math
from collections import Counter

from loomtok import queries
from loomtok.operators import unigram

SMALL = "/root/testdata/sf0.001"


def test_unigram_seed_has_all_characters_and_the_best_substrings(spark):
    text = "low low lower lowest newer newest wide widest abcdefghijklmnop " * 3 + "rare zz zz"
    pieces = spark.createDataFrame(list(Counter(text.split()).items()), "piece string, freq bigint")
    freq = {w: f for w, f in Counter(text.split()).items() if f >= 2}
    chars, longer = Counter(), Counter()
    for w, f in freq.items():
        for i in range(len(w)):
            chars[w[i]] += f
            for j in range(i + 2, min(len(w), i + 16) + 1):
                longer[w[i:j]] += f
    for target, multiplier in ((5, 1), (30, 2), (1000, 4)):
        n = max(max(target, len(chars)) * multiplier, len(chars) + 32) - len(chars)
        best = sorted(longer.items(), key=lambda x: (-x[1], x[0]))[:n]
        got = unigram.seed(pieces, target, 2, 16, multiplier).collect()
        assert {(r.token, r.freq, r.required) for r in got} == {(c, f, True) for c, f in chars.items()} | {(t, f, False) for t, f in best} and len(got) == len(chars) + len(best)


def test_the_query_of_seeds_cuts_no_character(spark):
    words = {r.piece: r.freq for r in queries.min_freq_vocab(spark, SMALL).collect()}
    got = {r.token: r.logp for r in queries.unigram_seed_logp(spark, SMALL).collect()}
    freq = Counter()
    for w, f in words.items():
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 16) + 1):
                freq[w[i:j]] += f
    chars = {t for t in freq if len(t) == 1}
    longer = sorted((t for t in freq if len(t) > 1), key=lambda t: (-freq[t], t.encode()))[: 4 * 49_999 - len(chars)]
    total = math.fsum(freq[t] + 1e-6 for t in [*chars, *longer])
    assert set(got) == chars | set(longer)
    assert all(math.isclose(got[t], math.log((freq[t] + 1e-6) / total), abs_tol=2e-8) for t in got)
