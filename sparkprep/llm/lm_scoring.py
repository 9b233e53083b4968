"""Language-model scores from a weighted backoff automaton."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.blocks import (
    Block,
    Mail,
    Message,
    each_block,
    exchange,
    per_key,
    send,
    told,
    write_blocks,
)
from sparkprep.llm.grams import Grams

ORDER = 2
# Taken off every count of a word; what that leaves is the unknown word's.
DISCOUNT = 0.5
# Weight, in occurrences, of the shorter history against what a history has seen.
CONCENTRATION = 200.0
# Added to every count in the base model.
BASE_ADDED = 0.1
# No word has a space in it.
END = b" "

SCORES = (
    "doc_id string, learned boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
    " base_score double, score double"
)


class Automaton:
    """The part of the model that a block's documents can reach.

    States are histories seen in learning, the root the empty one. An arc reads a
    word that its state's history was followed by, weighs the log probability of
    the word after it, and leads to the longest known history. All else fails:
    the failure arc of a state leads to its history without the oldest word and
    weighs what the state leaves to shorter histories. At the root every word
    has an arc, the unknown ones the same weight.

    A word w after history h has probability (c(hw) + m p(w)) / (c(h) + m), p
    being that after the shorter history: smoothing that adds up to 1 over all
    known words and the unknown one.

    Arcs are numbered by level and n-gram, which stand for their state and word:
    an n-gram that was seen is an arc of its history's state.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, distinct: int) -> None:
        order = len(counts)
        own = grams.first[0]
        unknown = DISCOUNT * distinct / total if total else 1.0
        known = counts[0] > 0
        chance = np.full(len(own), unknown)
        chance[known] = (counts[0][known] - DISCOUNT) / total
        # State of each k-gram as a history, by level; a history never seen is
        # its longest suffix that was. The end is followed by nothing.
        known = known & (grams.tokens[own] != 0)
        states = [np.where(known, np.cumsum(known), 0)]
        number = 1 + int(known.sum())
        depths = [np.zeros(1, np.int64), np.ones(number - 1, np.int64)]
        fails = [np.zeros(number, np.int64)]
        spare = [np.zeros(1), np.log10(CONCENTRATION / (counts[0][known] + CONCENTRATION))]
        # Arcs by level and n-gram: whether there is one, its weight, and the state to
        # which reading the n-gram leads, by its arc or after failures. One of the
        # full length leads where its suffix does.
        self.arc = [np.ones(len(own), bool)]
        self.weight = [np.log10(chance)]
        self.target = [states[0] if order > 1 else np.zeros_like(states[0])]
        for level in range(1, order):
            ends = grams.first[level]
            seen = counts[level] > 0
            context = grams.which[level - 1][ends - 1]
            suffix = grams.which[level - 1][ends]
            past = counts[level - 1][context]
            chance = (counts[level] + CONCENTRATION * chance[suffix]) / (past + CONCENTRATION)
            if level < order - 1:
                longer = seen & (grams.tokens[ends] != 0)
                state = np.where(longer, number + np.cumsum(longer) - 1, states[-1][suffix])
                fails.append(states[-1][suffix][longer])
                spare.append(np.log10(CONCENTRATION / (counts[level][longer] + CONCENTRATION)))
                depths.append(np.full(int(longer.sum()), level + 1))
                number += int(longer.sum())
                self.target.append(state)
                states.append(state)
            self.arc.append(seen)
            self.weight.append(np.log10(chance))
        self.fail = np.concatenate(fails)
        self.spare = np.concatenate(spare)
        self.depth = np.concatenate(depths)

    def score(self, grams: Grams) -> np.ndarray:
        """Log10 probability of each document, all places read at once.

        The state before a place is known beforehand, as the longest n-gram that
        ends there leads to it. Places that have no arc from their state fail together.
        """
        state = np.zeros(len(grams.tokens), np.int64)
        for level, target in enumerate(self.target):
            at = np.flatnonzero(grams.which[level][:-1] >= 0)
            state[at + 1] = target[grams.which[level][at]]
        # Nothing goes on from one document to the next.
        state[grams.starts] = 0
        total = np.zeros(len(state))
        left = np.arange(len(state))
        while len(left):
            depth = self.depth[state[left]]
            failed = np.zeros(len(left), bool)
            for level, arc in enumerate(self.arc):
                mine = np.flatnonzero(depth == level)
                gram = grams.which[level][left[mine]]
                found = arc[gram]
                total[left[mine[found]]] += self.weight[level][gram[found]]
                failed[mine[~found]] = True
            left = left[failed]
            total[left] += self.spare[state[left]]
            state[left] = self.fail[state[left]]
        return np.add.reduceat(total, grams.starts)


def score(
    docs: DataFrame,
    learn: Column,
    order: int = ORDER,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Scores of every document under an n-gram model of those to learn from.

    (doc_id, learned, n_tokens, n_known, train_tokens, base_score, score). Words
    are lower-cased (A-Z); each text ends with an end token that counts as one; a
    null text counts as empty. ``n_known`` counts tokens that were learned,
    ``train_tokens`` all that were learned from. ``base_score`` is the log10
    probability under single words, 0.1 added to each count; ``score`` that of
    the automaton of n-grams up to ``order`` words. Without a document to learn
    from, all words are the unknown one and have probability 1.

    Nothing of the model goes to all tasks or the driver but its two sizes:
    blocks of documents tell the ranges of the n-gram space what they have, get
    back the counts of just those n-grams, and build the part of the automaton
    that they reach. Words and n-grams are told apart by 64 bits of their hash.
    """
    blocks = write_blocks(docs, id_column, text_column, learn)
    ranges = blocks.ranges

    def tell(block: Block, mail: Mail) -> Iterator[Message]:
        grams = Grams(block.texts(), order, END)
        learned = np.repeat(block.flags, grams.sizes)
        for level in range(order):
            counts = grams.counts(level, learned)
            yield from send(f"{level}", grams.keys[level], counts, ranges)

    def add(kind: str, keys: np.ndarray, values: np.ndarray, begins: np.ndarray):
        sums = np.add.reduceat(values, begins)
        sizes = (int((sums > 0).sum()), int(sums.sum())) if kind == "0" else None
        return per_key(sums, begins, len(values)), sizes

    answers = exchange(blocks, None, tell, add)
    distinct, total = told(answers, "0", 2)

    def judge(block: Block, mail: Mail) -> Iterator[pd.DataFrame]:
        grams = Grams(block.texts(), order, END)
        counts = [mail.answers(f"{k}").astype(np.int64) for k in range(order)]
        found = counts[0][grams.which[0]]
        base = np.log10((found + BASE_ADDED) / (total + BASE_ADDED * (distinct + 1)))
        automaton = Automaton(grams, counts, total, distinct)
        yield pd.DataFrame(
            {
                "doc_id": block.shown_ids(),
                "learned": block.flags,
                "n_tokens": grams.sizes,
                "n_known": np.add.reduceat((found > 0).astype(np.int64), grams.starts),
                "train_tokens": total,
                "base_score": np.add.reduceat(base, grams.starts),
                "score": automaton.score(grams),
            }
        )

    mail = answers.where(F.col("target") >= 0)
    return each_block(blocks, mail, judge, SCORES).withColumn(
        "doc_id", F.col("doc_id").cast("bigint")
    )
