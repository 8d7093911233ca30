"""Kind of a message by score: block fields plus strings that speak for the kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.functions import text as T

UNKNOWN = "unknown"


def score(kind: str, block: Column, strings: Column, joined: Column, lowered: Column, plain: Column, hits: dict[str, Column]) -> Column:
    """Fields of the block plus strings that speak for the kind.

    Tests on the joined strings, outside any lambda, say which tests strings need one by one. Neither keywords nor
    patterns span the joint. Where strings are ``plain``, ASCII text of one line each, lines are counted instead.
    """
    def count(test: Callable[[Column, str], Column], words: bool, shape: bool) -> Column:
        return F.when(plain, T.lines_with(lowered, kind, words, shape)).otherwise(F.size(F.filter(strings, lambda s: test(s, kind))))

    words, by_word = T.has_word(lowered, kind), count(T.text_has_word, True, False)
    if kind not in T.SIGNAL_FIELDS:
        return F.size(block) + F.when(words, by_word).otherwise(0)
    shape = T.may_match(joined, kind, hits)
    return F.size(block) + (F.when(words & shape, count(T.has_signal, True, True)).when(shape, count(T.has_shape, False, True))
                            .when(words, by_word).otherwise(0))


def winner(scores: dict[str, Column]) -> Column:
    """Best kind; ties go by fixed order, all zero is unknown."""
    best = F.greatest(*scores.values())
    choice = F.when(best == 0, UNKNOWN)
    for kind in V.TIE_ORDER:
        choice = choice.when(scores[kind] == best, kind)
    return choice
