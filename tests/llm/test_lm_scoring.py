import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkprep.llm import lm_scoring
from sparkprep.llm.grams import Grams
from sparkprep.llm.lm_scoring import BASE_ADDED, CONCENTRATION, DISCOUNT

END = "</s>"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w] + [END]


class Plain:
    def __init__(self, texts, order):
        self.order = order
        self.counts = Counter()
        for text in texts:
            tokens = words(text)
            for k in range(1, order + 1):
                for i in range(len(tokens) - k + 1):
                    self.counts[tuple(tokens[i : i + k])] += 1
        singles = {g: c for g, c in self.counts.items() if len(g) == 1}
        self.total, self.distinct = sum(singles.values()), len(singles)

    def chance(self, history, word):
        c = self.counts[(*history, word)]
        if not history:
            if c:
                return (c - DISCOUNT) / self.total
            return DISCOUNT * self.distinct / self.total if self.total else 1.0
        shorter = self.chance(history[1:], word)
        return (c + CONCENTRATION * shorter) / (self.counts[history] + CONCENTRATION)

    def row(self, text):
        tokens = words(text)
        base = score = 0.0
        for i, w in enumerate(tokens):
            c = self.counts[(w,)]
            base += math.log10(
                (c + BASE_ADDED) / (self.total + BASE_ADDED * (self.distinct + 1))
            )
            score += math.log10(self.chance(tuple(tokens[max(0, i - self.order + 1) : i]), w))
        known = sum(self.counts[(w,)] > 0 for w in tokens)
        return len(tokens), known, self.total, base, score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_plain_model(docs, odd, texts, order):
    rows = odd + [(20 + i, t) for i, t in texts[:80]]
    learned = {i for i, _ in rows if i is not None and i % 4}
    found = lm_scoring.score(docs(rows), F.col("doc_id") % 4 != 0, order).collect()
    plain = Plain([t for i, t in rows if i in learned], order)
    wanted = sorted(((i, i in learned, *plain.row(t)) for i, t in rows), key=str)
    got = sorted((tuple(r) for r in found), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    for a, b in zip(got, wanted, strict=True):
        assert a[5:] == pytest.approx(b[5:])


def test_probabilities_add_up(texts):
    plain = Plain([t for _, t in texts[:10]], 2)
    known = [g[0] for g in plain.counts if len(g) == 1]
    for history in ((), (known[1],), (known[7],)):
        assert sum(plain.chance(history, w) for w in [*known, "never seen"]) == pytest.approx(1)


def test_held_out_texts_score_above_the_base(docs, texts):
    found = lm_scoring.score(docs(texts), F.col("doc_id") % 5 != 0).collect()
    held = [r for r in found if not r.learned]
    assert sum(r.score > r.base_score for r in held) == len(held) > 20


def test_empty_table_and_nothing_to_learn(docs):
    assert lm_scoring.score(docs([]), F.lit(True)).collect() == []
    (row,) = lm_scoring.score(docs([(1, "a b")]), F.lit(None).cast("boolean")).collect()
    assert tuple(row) == (1, False, 3, 0, 0, 0.0, 0.0)


def test_all_places_of_a_block_are_read_at_once(texts):
    # Python per word would take a loop over the tokens; a text twice scores the same.
    found = []
    for times in (1, 2):
        grams = Grams([t.encode() for _, t in texts[:20] * times], 3, lm_scoring.END)
        counts = [grams.counts(k, grams.tokens >= 0) // times for k in range(3)]
        automaton = lm_scoring.Automaton(grams, counts, len(grams.tokens) // times, len(grams.keys[0]))
        found.append(automaton.score(grams).tolist())
    assert len(found[0]) == 20 and found[1] == pytest.approx(found[0] * 2)
