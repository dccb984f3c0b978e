"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import ascii_lower, stored

VALUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"  # whole runs only, so that a search never goes back
HELD = "[A-Za-z0-9]"  # what a value has at least one of; a rule of marks is none
KEYWORD = r"(?i)(?:secret|token|passw(?:or)?d|pwd|api|auth|bearer|credential|access|private|key)"
ASSIGNED = r"^[\"'`(\[<{]*(?:=|:|:=|=>|->)[\"'`(\[<{]*$"
OPENING = r"[\"'`(\[<{]*"
NAME = r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*?" + KEYWORD + r")[A-Za-z0-9_-]++"  # a whole name with a credential word in it
NAMED = NAME + rf"(?:(?<=-)>|[\"'`)\]]*+(?:=>|:=|->|=|:)){OPENING}"  # such a name, up to its value
NAMED_VALUE = NAMED + r"[^\s\"'`]"
VALUE_IN_URL = r"://[^\s/:@]*:([^\s/]+)@"  # what stands for the user in an address
MIN_DOCUMENTS = 3  # that a dictionary word stands in
MOST_LABELLED = 20_000  # labelled findings, chosen by hash, that the forest is fitted on
TREES, DEPTH, SEED = 20, 6, 11
FROM = 0.5

FEATURES = [
    "f_length", "f_transitions", "f_digits", "f_upper", "f_lower", "f_hex", "f_distinct", "f_vowel_turns", "f_runs",
    "f_dictionary", "f_path", "f_address", "f_keyword", "f_assigned", "f_quoted", "f_word_before", "f_word_after",
]


def _assigned(rest: Column) -> Column:
    """The value that ``rest``, the word after an assignment and opening marks, starts with.

    A long run that only marks follow is the value with all its own marks. Else the value goes up to the first quote,
    without closing marks, and without any marks if no letter or digit comes later. Each step reads the rest once.
    """
    run = F.regexp_extract(rest, r"^[A-Za-z0-9+/_=-]{16,}+", 0)
    after_run = F.substring(rest, F.length(run) + 1, F.length(rest))
    head = F.regexp_extract(rest, r"^[^\s\"'`]++", 0)
    tail = F.substring(rest, F.length(head) + 1, F.length(rest))
    last = F.regexp_replace(head, r"(?<![^A-Za-z0-9])[^A-Za-z0-9]++$", "")
    unclosed = F.regexp_replace(head, r"(?<![)\]>},;.])[)\]>},;.]++$", "")
    return F.when((run != "") & ~after_run.rlike(HELD), run).when(tail.rlike(HELD), unclosed).otherwise(last)


def candidates(texts: DataFrame, *others: str) -> DataFrame:
    """Rows of ``others, word_at, word, before, before2, after, value``: words that hold a candidate value.

    A value has 16 or more of letters, digits and ``+/_=-``; or it has any length and marks and is assigned
    to a credential word, in its word or by the words before, or stands in the user part of an address.
    Words are split at white space; ``word_at`` counts them from 0. Several values of a word are several
    rows, equal ones and those that are part of another are one. Only texts that match at all are split; a text is worked on in
    its row.
    """
    words = F.col("_words")
    near = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    named = lambda i: near(i - 1).rlike(NAMED + "$") | (near(i - 1).rlike(ASSIGNED) & near(i - 2).rlike(KEYWORD))
    held = F.filter(
        F.transform(
            words,
            lambda w, i: F.when(
                w.rlike(VALUE) | w.rlike(NAMED_VALUE) | w.rlike(VALUE_IN_URL) | named(i),
                F.struct(i.alias("word_at"), w.alias("word"), near(i - 1).alias("before"), near(i - 2).alias("before2"), near(i + 1).alias("after")),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    some = texts.filter(F.col("text").rlike(VALUE) | F.col("text").rlike(KEYWORD) | F.col("text").rlike(VALUE_IN_URL)).select(*others, F.split("text", r"\s+").alias("_words"))
    rows = some.select(*others, F.explode(held).alias("_c")).select(*others, "_c.*")
    after_name = F.col("before").rlike(NAMED + "$") | (F.col("before").rlike(ASSIGNED) & F.col("before2").rlike(KEYWORD))
    bare = _assigned(F.regexp_extract("word", f"(?s)^{OPENING}+(.*)$", 1))
    in_word = _assigned(F.regexp_extract("word", f"(?s){NAMED}+(.*)$", 1))
    special = F.array(
        F.regexp_extract("word", VALUE_IN_URL, 1), F.when(~F.col("word").contains("://"), in_word),
        F.when(after_name & ~F.col("word").rlike(NAMED_VALUE), bare),
    )
    special = F.array_distinct(F.filter(special, lambda v: v.isNotNull() & v.rlike(HELD)))
    runs = F.filter(F.regexp_extract_all("word", F.lit(f"({VALUE})")), lambda v: v.rlike(HELD))
    rows = rows.withColumn("_special", special)
    whole = F.filter(runs, lambda v: ~F.exists("_special", lambda s: s.contains(v)))
    return rows.withColumn("value", F.explode(F.concat("_special", whole))).drop("_special")


def dictionary(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of the letter runs in ``wanted`` (``run``), those that are words of at least ``MIN_DOCUMENTS`` texts."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(r"(?<![A-Za-z0-9+/_=-])([a-z]{3,})(?![A-Za-z0-9+/_=-])"))))
    return texts.select(words.alias("run")).join(wanted, "run", "left_semi").groupBy("run").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCUMENTS).select("run")


def _share(pattern: str, of: Column) -> Column:
    return F.regexp_count(of, F.lit(pattern)) / F.length(of)


def with_features(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates with the forest's features: length, character transitions, dictionary, path, neighbours.

    Dictionary coverage is the share of a value's characters in letter runs that are words of the
    corpus; it is joined on distinct values and on distinct runs, so no frequent value is a hot key of a
    wide row.
    """
    v = F.col("value")
    runs = found.select("value").distinct().select("value", F.explode(F.regexp_extract_all(ascii_lower(v), F.lit(r"([a-z]{3,})"))).alias("run"))
    words = dictionary(texts, runs.select("run").distinct())
    cover = runs.join(words, "run").groupBy("value").agg(F.sum(F.length("run")).alias("_covered"))
    cover = cover.select(F.col("value").alias("_value"), "_covered")
    turns = r"(?<=[a-z])(?=[A-Z0-9+/_=-])|(?<=[A-Z])(?=[a-z0-9+/_=-])|(?<=[0-9])(?=[A-Za-z+/_=-])|(?<=[+/_=-])(?=[A-Za-z0-9])"
    vowel = r"(?<=[aeiouAEIOU])(?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])|(?<=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])(?=[aeiouAEIOU])"
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    at = F.instr("word", F.col("value"))
    left = F.expr("substring(word, 1, instr(word, value) - 1)")
    right = F.expr("substring(word, instr(word, value) + length(value))")
    made = {
        "f_length": F.length(v).cast("double"),
        "f_transitions": _share(turns, v),
        "f_digits": _share("[0-9]", v),
        "f_upper": _share("[A-Z]", v),
        "f_lower": _share("[a-z]", v),
        "f_hex": _share("[0-9a-fA-F]", v),
        "f_distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(F.length(v), F.lit(64)),
        "f_vowel_turns": _share(vowel, v),
        "f_runs": _share("[A-Za-z]{3,}", v),
        "f_dictionary": F.coalesce(F.col("_covered") / F.length(v), F.lit(0.0)),
        "f_path": flag(v.contains("/") | left.endswith("/") | right.startswith("/")),
        "f_address": flag(left.contains("@") | right.startswith("@") | right.rlike(r"^\.[a-z]{2,}") | left.contains("://")),
        "f_keyword": flag(F.concat_ws(" ", "before2", "before", left).rlike(KEYWORD)),
        "f_assigned": flag(F.col("before").rlike(ASSIGNED) | F.col("before").rlike(NAMED + "$") | left.rlike(r"[=:][\"'`(\[<{]*$")),
        "f_quoted": flag(left.rlike(r"[\"'`]$") & right.rlike(r"^[\"'`]")),
        "f_word_before": flag(F.col("before").rlike(r"^\p{L}+[.,;:!?]?$")),
        "f_word_after": flag(F.col("after").rlike(r"^\p{L}+[.,;:!?]?$")),
    }
    return found.join(cover, F.col("value") == F.col("_value"), "left").withColumns(made).drop("_value", "_covered")


def decisive(featured: DataFrame) -> Column:
    """1 or 0 where a finding's outcome is plain, else null: the labels if a table has none.

    True: letters and digits mixed, assigned to a credential word. False: digits only, part of an
    address, or mostly dictionary words.
    """
    mixed = (F.col("f_digits") > 0.1) & (F.col("f_digits") < 0.9)
    true = mixed & (F.col("f_keyword") == 1) & (F.col("f_assigned") == 1) & (F.col("f_dictionary") < 0.3)
    false = (F.col("f_digits") == 1) | (F.col("f_address") == 1) | (F.col("f_dictionary") > 0.6)
    return F.when(true & ~false, 1.0).when(false & ~true, 0.0)


def judged(featured: DataFrame, labelled: DataFrame) -> DataFrame:
    """``featured`` with ``probability`` and ``is_secret``, by a forest fitted on ``labelled`` (``label`` 0 or 1).

    The forest sees about ``MOST_LABELLED`` distinct labelled findings, chosen by hash and put in a fixed
    order, so a rerun grows the same trees. Without findings of both labels nothing is removed: the
    probability is null and every candidate counts as a secret.
    """
    cells = labelled.filter("label is not null").select("label", *FEATURES).distinct()
    share = min(1.0, MOST_LABELLED / max(1, cells.count()))
    some = cells.filter(F.pmod(F.xxhash64("label", *FEATURES), F.lit(1 << 30)) < int(share * (1 << 30)))
    classes = [r["label"] for r in some.select("label").distinct().collect()]  # two at most
    if len(classes) < 2:
        return featured.withColumns({"probability": F.lit(None).cast("double"), "is_secret": F.lit(True)})
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_y", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    train = some.coalesce(1).sortWithinPartitions("label", *FEATURES)  # bounded above
    model = forest.fit(rows.transform(train))
    scored = model.transform(rows.transform(featured)).withColumn("probability", F.round(vector_to_array("_p")[1], 9))
    return scored.drop("_features", "_raw", "_p", "_y").withColumn("is_secret", F.col("probability") >= FROM)


def scan(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Findings of all texts: document, place, value, probability and whether it counts as a secret.

    ``labels`` may hold checked findings as ``value, label``; else the plain ones of the scan itself
    teach the forest (``decisive``). Null texts have no findings, empty ones neither; null ids are kept,
    repeated rows give repeated findings, and equal values tie: each is judged by its own place. Texts of any length
    are searched in time that grows with their length, also long rules of marks. Extra columns are not read.
    """
    texts = documents.select("doc_id", "text")
    # stored: values, dictionary runs and features read the same candidates; the forest, the labels and the result the same findings
    found = stored(candidates(texts, "doc_id"), "candidates")
    featured = stored(with_features(found, texts), "findings")
    if labels is None:
        labelled = featured.withColumn("label", decisive(featured))
    else:
        checked = labels.filter("value is not null").groupBy("value").agg(F.max("label").cast("double").alias("label"))
        labelled = featured.join(checked, "value")
    return judged(featured, labelled)


def query(documents: DataFrame) -> DataFrame:
    return scan(documents).select("doc_id", "word_at", "value", "probability", "is_secret", *FEATURES)
