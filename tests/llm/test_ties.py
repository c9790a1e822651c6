"""Turns that tie are ordered by their own text; more languages than a byte can number."""

import numpy as np
from pyspark.sql import functions as F

from kamishi.llm import chat, langid


def test_ties_of_a_turn(spark):
    """'###' comes before 'A', though its escaped form comes after; repeated rows stay; further columns are ignored."""
    rows = [(1, 0, "user", "A", 5), (1, 0, "user", "###", 6), (1, 0, "user", "</", 7), (1, 0, "b:", "x", 8), (1, 0, "b;", "y", 9), (1, 0, "user", "A", 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, ts int")
    back = chat.format_chats(turns).select(chat.read_turns(F.col("formatted")).alias("t")).first().t
    assert [(x.role, x.text) for x in back] == [("b:", "x"), ("b;", "y"), ("user", "###"), ("user", "</"), ("user", "A"), ("user", "A")]


def test_very_long_turns(spark):
    long = "### a\\b </ " * 100_000
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn int, role string, text string")
    done = chat.format_chats(turns)
    row = done.select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [x.text for x in row.t] == [long, long] and row.loss == long


def test_many_languages():
    scores = np.full((6, 300), -1.0, np.float32)
    scores[:, 150] = 0
    scores[3:, 150], scores[3:, 299] = -50, 0
    assert langid.viterbi(scores, np.array([0, 6]), 2.0).tolist() == [150] * 3 + [299] * 3
