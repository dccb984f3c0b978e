import hashlib
import math

import pytest
from pyspark.sql import functions as F

from proofgrid.functions import answers, keys
from proofgrid.functions.stem import stemmed


def value(spark, column, **row):
    columns = {k: F.lit(v) for k, v in row.items()}
    return spark.range(1).withColumns(columns).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "source, image, expected",
    [("a", "b", "a"), ("", "b", "b"), (None, "b", "b"), (None, None, "None"), ("", "", ""), ("0", "b", "0")],
)
def test_source_id_takes_the_first_that_is_not_empty(spark, source, image, expected):
    rows = spark.createDataFrame([((source, image),)], "metadata struct<source_img_id string, img_id string>")
    assert rows.select(keys.source_id()).first()[0] == expected


def test_question_text_and_canonical_text_know_all_white_space(spark):
    text = "<image>  What\tis <image>this? \n"
    assert value(spark, keys.question_text(F.col("t")), t=text) == "What\tis this?"
    assert value(spark, keys.canonical(F.col("t")), t=" A  b\tC\n") == "a b c"


def test_item_id_is_twenty_hex_digits_of_source_and_question(spark):
    made = value(spark, keys.item_id(F.col("s"), F.col("q")), s="img1", q="What is it?")
    assert made == hashlib.sha256(b"img1|What is it?").hexdigest()[:20]


def test_null_parts_stay_in_a_key(spark):
    assert value(spark, keys.joined(F.col("a"), F.col("b")), a=None, b="x") == "None|x"


def test_intervention_id_writes_the_fraction_with_six_digits(spark):
    lit = F.lit
    made = value(spark, keys.intervention_id(lit("i"), lit("m"), lit("deletion"), lit("gray"), lit(0.1), lit("random"), lit(3)))
    assert made == hashlib.sha256(b"i|m|deletion|gray|0.100000|random|3").hexdigest()[:24]


def test_stable_seed_writes_the_fraction_plainly(spark):
    made = value(spark, keys.stable_seed(F.lit(42), F.lit("abc"), F.lit("m"), F.lit(0.05), F.lit(3)))
    whole = int.from_bytes(hashlib.sha256(b"42|abc|m|0.05|3").digest()[:8], "big")
    assert made == whole % 2**32 == 3577696511


@pytest.mark.parametrize("text, n", [("", 0), ("   ", 0), ("one", 1), (" a  b c ", 3)])
def test_word_count(spark, text, n):
    assert value(spark, keys.word_count(F.col("t")), t=text) == n


def test_labels_or_default(spark):
    rows = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "i int, c array<string>")
    got = {r["i"]: r["l"] for r in rows.select("i", keys.labels_or_default(F.col("c")).alias("l")).collect()}
    assert got == {1: ["a", "None"], 2: ["unlabelled"], 3: ["unlabelled"]}


@pytest.mark.parametrize(
    "text, normal",
    [("  2.5   cm ", "2.5 cm"), ("10%", "10%"), ("ＡＢ１", "ab1"), ("ﬁne", "fine"), ("é", "é"),
     ("x²", "x2"), ("", ""), ("A B", "a b"), ("Été", "été"), (None, None)],
)
def test_normalised_answers(spark, text, normal):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(answers.normalised(F.col("t"))).first()[0] == normal


def test_confidence_uses_finite_logprobs_only(spark):
    rows = spark.createDataFrame(
        [(1, [-1.0, None, float("nan"), float("-inf"), -3.0]), (2, []), (3, [float("inf")]), (4, None)],
        "i int, l array<double>",
    )
    got = {
        r["i"]: (r["m"], r["c"])
        for r in rows.select(
            "i", answers.mean_logprob(F.col("l")).alias("m"), answers.sequence_confidence(F.col("l")).alias("c")
        ).collect()
    }
    assert got[1] == (-2.0, pytest.approx(math.exp(-2.0)))
    assert got[2] == got[3] == (None, None)
    assert got[4] == (None, None)


STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "adjustable": "adjust", "replacement": "replac",
    "adoption": "adopt", "communism": "commun", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control",
    "roll": "roll", "dying": "die", "died": "die", "news": "news", "enjoy": "enjoy", "by": "by", "polyps": "polyp",
}


def test_known_stems(spark):
    words = spark.createDataFrame([(w,) for w in STEMS], "word string")
    assert {r["word"]: r["stem"] for r in stemmed(words).collect()} == STEMS
