"""The language models against interpolated Kneser-Ney as the textbook has it, and what they refuse."""

import math
from collections import Counter, defaultdict

import numpy as np

from brindle.llm import languages as L

CORPUS = {"aa": "the cat sat on the mat and the rat ran to that hat", "bb": "der hund und die katze sind in dem haus und der hut", "cc": "le chat et le chien sont dans la rue"}


def _plain(grams_of: dict[str, Counter], vocabulary: int):
    """log p(last character of a gram) by language: absolute discounts, counts at the highest order and numbers of different predecessors below."""
    levels = {}
    for lang, counts in grams_of.items():
        level, by = dict(counts), {}
        for order in range(L.ORDER, 0, -1):
            by[order] = level
            seen = defaultdict(set)
            for g in level:
                seen[g[1:]].add(g[0])
            level = {g: len(x) for g, x in seen.items()} if order > 1 else {}
        levels[lang] = by

    def p(lang, g):
        if not g:
            return 1 / vocabulary
        level = levels[lang][len(g)]
        same = [n for h, n in level.items() if h[:-1] == g[:-1]]
        if not same:
            return p(lang, g[1:])
        return max(level.get(g, 0) - L.DISCOUNT, 0) / sum(same) + L.DISCOUNT * len(same) / sum(same) * p(lang, g[1:])

    return p


def _cut(keys) -> list[tuple]:
    return [tuple(int(k) >> (16 * i) & 0xFFFF for i in range(L.ORDER - 1, -1, -1)) for k in keys]


def test_probabilities_are_those_of_kneser_ney():
    langs = sorted(CORPUS)
    rows, counts = [], {}
    for i, lang in enumerate(langs):
        keys, _ = L.grams(list(dict.fromkeys(L.words(CORPUS[lang]))))
        counts[lang] = Counter(_cut(keys))
        rows += [(i, k) for k in keys]
    lang, key = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64)
    models = L.build(langs, lang, key, np.ones(len(rows)))
    seen = {g[-1] for c in counts.values() for g in c}
    p = _plain(counts, len(seen) + 1)
    asked, _ = L.grams(["the", "hund", "chat", "xylophone", "zzz", "\u4f60\u597d", "qa\u0161", "hut"])
    got = models.score(asked)
    want = np.array([[math.log(p(x, g)) for x in langs] for g in _cut(asked)])
    assert np.allclose(got, want, atol=1e-4), np.abs(got - want).max()


def test_texts_of_no_known_language_are_refused(spark):
    rows = [(100 * i + j, " ".join(CORPUS[lang].split()[j % 5 :] + CORPUS[lang].split()[: j % 7 + 2]), lang) for i, lang in enumerate(sorted(CORPUS)) for j in range(90)]
    models = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    models.limits[:] = np.minimum(models.limits, 2.0)
    asked = spark.createDataFrame([(1, "the cat sat on that mat"), (2, "xqz wvk jjq zzx qqk"), (3, "12 34"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["accepted"]) for r in L.predict(asked, models).collect()}
    assert got[1] == ("aa", True) and not got[2][1] and got[3] == ("und", False) and got[4] == ("und", False)
