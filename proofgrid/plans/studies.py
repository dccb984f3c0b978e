"""Catalogue: bootstrap intervals, ratings and human-study measures, document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.functions import answers, keys
from proofgrid.functions.keys import hash60, joined
from proofgrid.operators import calibration, pairing, ratings, sections, stats
from proofgrid.plans import inputs, sqltext
from proofgrid.plans.inputs import table
from proofgrid.plans.registry import query
from proofgrid.plans.scoring import _BIN
from proofgrid.plans.sqltext import canon, h60, words

N_BOOT = 2000
LOW, HIGH = stats.interval_positions(N_BOOT, 0.95)

# ---- intervals ---------------------------------------------------------------------


def _bootstrap_sql(cte: str, rows: str, cluster: str, values: list[str]) -> str:
    sums = ", ".join(f"sum({v}::DOUBLE) AS {v}" for v in values)
    means = ", ".join(f"sum({v}) / sum(n) AS {v}" for v in values)
    report = " UNION ALL ".join(
        f"""SELECT '{v}' AS measure, (SELECT sum({v}) / sum(n) FROM cl) AS estimate,
        (SELECT list({v} ORDER BY {v}) FROM reps)[{LOW + 1}] AS low, (SELECT list({v} ORDER BY {v}) FROM reps)[{HIGH + 1}] AS high,
        (SELECT CAST(sum(n) AS BIGINT) FROM cl) AS n_rows, (SELECT count(*) FROM cl) AS n_clusters, {N_BOOT} AS n_boot"""
        for v in values
    )
    return f"""WITH {cte},
cl AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS position
  FROM (SELECT CAST({cluster} AS VARCHAR) AS cluster, count(*) AS n, {sums} FROM {rows} GROUP BY 1)),
sz AS (SELECT count(*) AS c FROM cl),
draws AS (
  SELECT id // c AS replicate, {h60("'42|' || (id // c) || '|' || (id % c)")} % c AS position
  FROM sz, range(0, CAST({N_BOOT} * (SELECT count(*) FROM cl) AS BIGINT)) t(id)),
reps AS MATERIALIZED (SELECT replicate, {means} FROM draws JOIN cl USING (position) GROUP BY 1)
{report}"""


_INTERVAL = ("estimate", "low", "high")


@query(
    "l1_cluster_bootstrap", _bootstrap_sql(sqltext.CONFIDENT, "conf", "user_id", ["correct", "confidence"]), doubles=_INTERVAL
)
def cluster_bootstrap(spark, sf):
    """Mean accuracy and confidence with intervals that resample users."""
    return stats.cluster_bootstrap(inputs.confident(spark, sf), "user_id", ["correct", "confidence"], N_BOOT)


@query(
    "l1_split_bootstrap",
    f"""WITH {sqltext.CONFIDENT}, t AS (SELECT count(*) AS n, count(DISTINCT user_id) AS c, sum(correct) / count(*) AS a, sum(confidence) / count(*) AS b FROM conf)
    SELECT measure, estimate, n AS n_rows, c AS n_clusters, {N_BOOT} AS n_boot, TRUE AS covers, TRUE AS near
    FROM (SELECT 'correct' AS measure, a AS estimate, n, c FROM t UNION ALL SELECT 'confidence', b, n, c FROM t)""",
    doubles=("estimate",),
)
def split_bootstrap(spark, sf):
    """The same intervals with numbers of draws cut down a tree; they are as wide as the linear approximation says."""
    rows, values = inputs.confident(spark, sf), ["correct", "confidence"]
    found = stats.cluster_bootstrap(rows, "user_id", values, N_BOOT, draws="split")
    sums = rows.groupBy("user_id").agg(F.count("*").alias("n"), *[F.sum(F.col(v).cast("double")).alias(v) for v in values])
    mean = lambda v: (F.sum(v) / F.sum("n")).alias(f"mean_{v}")
    spread = sums.crossJoin(sums.agg(*[mean(v) for v in values]))  # one row
    error = lambda v: F.sqrt(F.sum(F.pow(F.col(v) - F.col(f"mean_{v}") * F.col("n"), F.lit(2)))) / F.sum("n")
    errors = spread.agg(F.array(*[F.struct(F.lit(v).alias("measure"), error(v).alias("error")) for v in values]).alias("e")).select(F.inline("e"))
    near = F.abs((F.col("high") - F.col("low")) / (2 * 1.959964 * F.col("error")) - 1) < 0.2
    covers = (F.col("low") <= F.col("estimate")) & (F.col("estimate") <= F.col("high"))
    return found.join(errors, "measure").select("measure", "estimate", "n_rows", "n_clusters", "n_boot", covers.alias("covers"), near.alias("near"))


_DIFFERENCES = f"""{sqltext.SCORED},
diff AS (
  SELECT a.source, a.exact_match - b.exact_match AS exact_match_difference, a.confidence - b.confidence AS confidence_difference
  FROM scored a JOIN scored b USING (item_id) WHERE a.condition = 'paired' AND b.condition = 'constant')"""


@query(
    "l2_paired_difference_interval",
    _bootstrap_sql(_DIFFERENCES, "diff", "source", ["exact_match_difference", "confidence_difference"]), doubles=_INTERVAL,
)
def paired_difference_interval(spark, sf):
    """Difference of two conditions with intervals that resample sources."""
    differences = pairing.paired_differences(
        inputs.scored_exact(spark, sf), "condition", "paired", "constant", ["exact_match", "confidence"]
    )
    return stats.cluster_bootstrap(differences, "source", ["exact_match_difference", "confidence_difference"], N_BOOT)


@query(
    "l3_calibration_error_interval",
    f"""WITH {sqltext.CONFIDENT},
    parts AS MATERIALIZED (
      SELECT CAST(user_id AS VARCHAR) AS cluster, {_BIN} AS bin, sum(confidence) AS p, sum(correct) AS y, count(*) AS n FROM conf GROUP BY ALL),
    cl AS MATERIALIZED (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS position FROM (SELECT DISTINCT cluster FROM parts)),
    sz AS (SELECT count(*) AS c FROM cl),
    draws AS (
      SELECT id // c AS replicate, {h60("'42|' || (id // c) || '|' || (id % c)")} % c AS position
      FROM sz, range(0, CAST({N_BOOT} * (SELECT count(*) FROM cl) AS BIGINT)) t(id)),
    times AS (SELECT replicate, position, count(*) AS times FROM draws GROUP BY ALL),
    pooled AS (
      SELECT replicate, bin, sum(p * times) AS p, sum(y * times) AS y, sum(n * times) AS n
      FROM times JOIN cl USING (position) JOIN parts USING (cluster) GROUP BY ALL),
    reps AS MATERIALIZED (SELECT replicate, sum(abs(p - y)) / sum(n) AS e FROM pooled GROUP BY 1),
    whole AS (SELECT sum(abs(p - y)) / sum(n) AS e FROM (SELECT bin, sum(p) AS p, sum(y) AS y, sum(n) AS n FROM parts GROUP BY 1))
    SELECT (SELECT e FROM whole) AS estimate, (SELECT list(e ORDER BY e) FROM reps)[{LOW + 1}] AS low,
      (SELECT list(e ORDER BY e) FROM reps)[{HIGH + 1}] AS high, (SELECT c FROM sz) AS n_clusters, {N_BOOT} AS n_boot""",
    doubles=_INTERVAL,
)
def calibration_error_interval(spark, sf):
    """Expected calibration error with an interval that resamples users."""
    rows = inputs.confident(spark, sf).select(
        "user_id", calibration.bin_index(F.col("confidence")).alias("bin"), F.col("confidence").alias("p"),
        F.col("correct").alias("y"), F.lit(1).alias("n"),
    )

    def ece(sums):
        return sums.groupBy("replicate").agg((F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("estimate"))

    return stats.cluster_bootstrap_statistic(rows, "user_id", ["bin"], ["p", "y", "n"], ece, N_BOOT)


@query(
    "j8_replicate_order_statistics",
    _bootstrap_sql(sqltext.CONFIDENT, "conf", "user_id", ["correct"]).split("SELECT 'correct' AS measure")[0]
    + f"""SELECT rn AS position, correct FROM (SELECT correct, row_number() OVER (ORDER BY correct) - 1 AS rn FROM reps)
    WHERE rn IN ({LOW}, {HIGH})""",
    doubles=("correct",),
)
def replicate_order_statistics(spark, sf):
    """The replicates at both ends of the interval, by place."""
    means, _, _ = stats.replicate_means(inputs.confident(spark, sf), "user_id", ["correct"], N_BOOT, 42)
    ordered = means.agg(F.sort_array(F.collect_list("correct")).alias("c"))  # N_BOOT numbers
    cells = [F.struct(F.lit(p).cast("bigint").alias("position"), F.get("c", F.lit(p)).alias("correct")) for p in (LOW, HIGH)]
    return ordered.select(F.inline(F.array(*cells)))


# ---- reliability and answers -------------------------------------------------------

_CLASS_ROWS = f"""{sqltext.SCORED},
cls AS (SELECT *, unnest(coalesce(classes, ['unlabelled'])) AS class, ih % 5 AS fold FROM scored)"""


def _class_rows(spark, sf):
    rows = inputs.scored_exact(spark, sf)
    return rows.withColumn("fold", F.col("ih") % 5).withColumn("class", F.explode(keys.labels_or_default(F.col("classes"))))


@query(
    "n2_fold_reliability",
    f"""WITH {_CLASS_ROWS}, p AS (SELECT class, fold, count(*) AS n, sum(exact_match) AS k FROM cls GROUP BY ALL)
    SELECT class, fold, CAST(sum(n) OVER w - n AS BIGINT) AS n_outside, (sum(k) OVER w - k) / (sum(n) OVER w - n) AS reliability
    FROM p WINDOW w AS (PARTITION BY class)""",
    doubles=("reliability",),
)
def fold_reliability(spark, sf):
    """Reliability of each class as the other folds show it."""
    return ratings.fold_reliability(_class_rows(spark, sf), "class", "fold", "exact_match")


@query(
    "n3_shrunken_reliability",
    f"""WITH {_CLASS_ROWS}, p AS (SELECT class, condition, count(*) AS n, sum(exact_match) AS k FROM cls GROUP BY ALL),
    c AS (SELECT class, sum(k) / sum(n) AS class_mean FROM p GROUP BY 1)
    SELECT class, condition, n, class_mean, (k + 4.0 * class_mean) / (n + 4.0) AS reliability FROM p JOIN c USING (class)""",
    doubles=("class_mean", "reliability"),
)
def shrunken_reliability(spark, sf):
    """Reliability per class and condition, drawn towards the class."""
    return ratings.shrunken_reliability(_class_rows(spark, sf), "class", "condition", "exact_match", 4.0)


def _series(terms: dict[int, float], y: str) -> str:
    return " + ".join(f"({c!r}::DOUBLE) / pow({y}, {p})" for p, c in terms.items())


def _digamma(x: str) -> str:
    return f"(ln({x} + {ratings.SHIFT}) + {_series(ratings.DIGAMMA, f'({x} + {ratings.SHIFT})')} - {' - '.join(f'1 / ({x} + {i})' for i in range(ratings.SHIFT))})"


def _trigamma(x: str) -> str:
    return f"({_series(ratings.TRIGAMMA, f'({x} + {ratings.SHIFT})')} + {' + '.join(f'1 / (({x} + {i}) * ({x} + {i}))' for i in range(ratings.SHIFT))})"


def _beta_sql(units: str, steps: int = 40) -> str:
    """``beta(class, units, kind, class_mean, strength)`` from ``units(class, n, k)``."""
    psi = lambda x, more: f"sum(w * ({_digamma(f'({x} + {more})')} - {_digamma(x)}))"
    tri = lambda x, more: f"sum(w * ({_trigamma(f'({x} + {more})')} - {_trigamma(x)}))"
    return f"""hist AS MATERIALIZED (SELECT class, n::DOUBLE AS n, k::DOUBLE AS k, count(*)::DOUBLE AS w FROM {units} WHERE n > 0 GROUP BY ALL),
    pool AS (SELECT class, sum(w) AS units, sum(w * k) / sum(w * n) AS m, sum(w * n) AS trials, bool_and(k = 0 OR k = n) AS split,
      sum(w) FILTER (WHERE k > 0) / sum(w) AS share FROM hist GROUP BY 1),
    slope AS (SELECT class, sum(w * (k * (k - 1) / m + (n - k) * (n - k - 1) / (1 - m) - n * (n - 1))) AS spread
      FROM hist JOIN pool USING (class) WHERE m > 0 AND m < 1 GROUP BY 1),
    known AS MATERIALIZED (SELECT pool.*, CASE WHEN m <= 0 OR m >= 1 THEN 'constant' WHEN spread <= 1e-9 * trials THEN 'pooled' WHEN split THEN 'separate' ELSE 'fitted' END AS kind
      FROM pool LEFT JOIN slope USING (class)),
    walk AS (
      SELECT 0 AS step, class, 2 * m AS a, 2 * (1 - m) AS b FROM known WHERE kind = 'fitted'
      UNION ALL
      SELECT step + 1, class, a * exp(greatest(-1, least(1, CASE WHEN ca < 0 AND ca * cb > cab * cab THEN (cab * sb - cb * sa) / (ca * cb - cab * cab) ELSE ln(ga / g) END))),
        b * exp(greatest(-1, least(1, CASE WHEN ca < 0 AND ca * cb > cab * cab THEN (cab * sa - ca * sb) / (ca * cb - cab * cab) ELSE ln(gb / g) END)))
      FROM (
        SELECT *, a * a * (qa + z) + sa AS ca, b * b * (qb + z) + sb AS cb, a * b * z AS cab
        FROM (
          SELECT *, a * (ga - g) AS sa, b * (gb - g) AS sb
          FROM (
            SELECT step, class, a, b, {psi('a', 'k')} AS ga, {psi('b', 'n - k')} AS gb, {psi('(a + b)', 'n')} AS g,
              {tri('a', 'k')} AS qa, {tri('b', 'n - k')} AS qb, -{tri('(a + b)', 'n')} AS z
            FROM walk JOIN hist USING (class) WHERE step < {steps} GROUP BY step, class, a, b)))),
    beta AS (
      SELECT class, units::BIGINT AS units, kind, CASE kind WHEN 'fitted' THEN a / (a + b) WHEN 'separate' THEN share ELSE m END AS class_mean,
        CASE kind WHEN 'fitted' THEN a + b WHEN 'separate' THEN 0 END AS strength
      FROM known LEFT JOIN (SELECT * FROM walk WHERE step = {steps}) USING (class))"""


_COARSE = ("class_mean", "strength", "reliability")  # a flat likelihood leaves the last digits open


def _coarse(df):
    return df.withColumns({c: F.round(c, 5) for c in _COARSE if c in df.columns})


@query(
    "n3_fitted_reliability",
    f"""WITH RECURSIVE {_CLASS_ROWS}, p AS (SELECT class, condition, count(*) AS n, sum(exact_match) AS k FROM cls GROUP BY ALL), {_beta_sql("p")}
    SELECT class, condition, n, kind, round(class_mean, 5) AS class_mean, round(strength, 5) AS strength,
      round(CASE WHEN strength IS NULL THEN class_mean ELSE (k + strength * class_mean) / (n + strength) END, 5) AS reliability
    FROM p JOIN beta USING (class)""",
)
def fitted_reliability(spark, sf):
    """Reliability per class and condition, drawn towards the class as far as the data say."""
    return _coarse(ratings.fitted_reliability(_class_rows(spark, sf), "class", "condition", "exact_match"))


_BOUGHT = "CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END"


@query(
    "n3_fitted_strength",
    f"""WITH RECURSIVE e AS (SELECT CAST(user_id % 4 AS INT) AS class, user_id, event_type,
        CASE CAST(user_id % 4 AS INT) WHEN 0 THEN {_BOUGHT} WHEN 1 THEN CAST(user_id % 3 = 0 AS INT) WHEN 2 THEN 1 ELSE CAST(value < user_id * 4 AS INT) END AS correct FROM events),
    p AS (SELECT class, user_id, count(*) AS n, sum(correct) AS k FROM e GROUP BY ALL), {_beta_sql("p")}
    SELECT class, units, kind, round(class_mean, 5) AS class_mean, round(strength, 5) AS strength FROM beta""",
)
def fitted_strength(spark, sf):
    """What users of four classes say about the spread of reliabilities: chance, all or nothing, constant, and fitted."""
    kind = (F.col("user_id") % 4).cast("int")
    correct = (
        F.when(kind == 0, F.expr(_BOUGHT)).when(kind == 1, (F.col("user_id") % 3 == 0).cast("int")).when(kind == 2, 1)
        .otherwise((F.col("value") < F.col("user_id") * 4).cast("int"))
    )
    rows = table(spark, sf, "events").select(kind.alias("class"), "user_id", correct.alias("correct"))
    units = rows.groupBy("class", "user_id").agg(F.count("*").alias("n"), F.sum("correct").alias("k"))
    return _coarse(ratings.beta_binomial(units, "class"))


@query(
    "n6_answer_changes",
    f"""WITH {sqltext.SCORED}
    SELECT a.item_id, CAST({canon('a.prediction')} <> {canon('b.prediction')} AS DOUBLE) AS flip,
      b.exact_match - a.exact_match AS correctness_change
    FROM scored a JOIN scored b USING (item_id) WHERE a.condition = 'paired' AND b.condition = 'constant'""",
    doubles=("flip", "correctness_change"),
)
def answer_changes(spark, sf):
    """Whether the answer flips under the constant image, and what that does to correctness."""
    rows = inputs.scored_exact(spark, sf).withColumn("answer", answers.normalised(F.col("prediction")))
    rows = rows.withColumnRenamed("exact_match", "correct")
    return ratings.answer_changes(rows.filter("condition = 'paired'"), rows.filter("condition = 'constant'"), ["item_id"])


@query(
    "n10_classification_quality",
    f"""WITH {_CLASS_ROWS}, b AS (
      SELECT condition, class, len({words('reference')}) > 60 AS t, len({words('prediction')}) > 60 AS g FROM cls)
    SELECT condition, class, count(*) AS n, count(*) FILTER (t = g) / count(*) AS accuracy,
      coalesce(count(*) FILTER (t AND g) / nullif(count(*) FILTER (g), 0), 0) AS precision,
      coalesce(count(*) FILTER (t AND g) / nullif(count(*) FILTER (t), 0), 0) AS recall,
      coalesce(2 * count(*) FILTER (t AND g) / nullif(count(*) FILTER (t) + count(*) FILTER (g), 0), 0) AS f1
    FROM b GROUP BY 1, 2""",
    doubles=("accuracy", "precision", "recall", "f1"),
)
def classification_quality(spark, sf):
    """How well a long answer predicts a long reference, per condition and class."""
    rows = _class_rows(spark, sf)
    long = lambda c: keys.word_count(F.col(c)) > 60
    return ratings.classification_quality(rows, ["condition", "class"], long("reference"), long("prediction"))


@query(
    "n11_answer_entropy",
    f"""WITH {sqltext.PRED}, c AS (SELECT item_id, {canon('prediction')} AS a, count(*) AS c FROM pred GROUP BY ALL),
    p AS (SELECT item_id, c / sum(c) OVER (PARTITION BY item_id) AS p FROM c)
    SELECT item_id, count(*) AS answers, -sum(p * ln(p)) AS entropy, 1 - max(p) AS disagreement FROM p GROUP BY 1""",
    doubles=("entropy", "disagreement"),
)
def answer_entropy(spark, sf):
    """Entropy and disagreement of an item's answers over the conditions."""
    rows = inputs.predictions(spark, sf).withColumn("normal", answers.normalised(F.col("prediction")))
    return ratings.answer_entropy(rows, "item_id", "normal")


# ---- people ------------------------------------------------------------------------

_RATED = f"rated AS (SELECT *, CASE WHEN {h60(chr(39) + 'arm|' + chr(39) + ' || doc_id')} % 2 = 0 THEN 'shown' ELSE 'hidden' END AS arm FROM labels)"


def _rated(spark, sf):
    arm = F.when(hash60(joined(F.lit("arm"), F.col("doc_id"))) % 2 == 0, "shown").otherwise("hidden")
    return table(spark, sf, "labels").withColumn("arm", arm)


@query(
    "n12_detection_rates",
    f"""WITH {_RATED} SELECT arm, count(*) AS errors, avg(toxic) AS detection_rate FROM rated WHERE quality = 0 GROUP BY 1""",
    doubles=("detection_rate",),
)
def detection_rates(spark, sf):
    """Share of errors that raters flagged, per arm."""
    return ratings.detection_rates(_rated(spark, sf), "arm", F.col("quality") == 0, F.col("toxic") == 1)


@query(
    "n12_detection_difference",
    f"""WITH {_RATED}, r AS (SELECT arm, avg(toxic) AS d FROM rated WHERE quality = 0 GROUP BY 1)
    SELECT (SELECT d FROM r WHERE arm = 'shown') AS first_rate, (SELECT d FROM r WHERE arm = 'hidden') AS second_rate,
      (SELECT d FROM r WHERE arm = 'shown') - (SELECT d FROM r WHERE arm = 'hidden') AS difference""",
    doubles=("first_rate", "second_rate", "difference"),
)
def detection_difference(spark, sf):
    """Difference of the detection rates of both arms."""
    rates = ratings.detection_rates(_rated(spark, sf), "arm", F.col("quality") == 0, F.col("toxic") == 1)
    return ratings.detection_difference(rates, "arm", "shown", "hidden")


_ERRORS = f"""{_RATED},
err AS (SELECT d.source, CAST(toxic AS DOUBLE) AS flagged FROM rated JOIN documents d USING (doc_id) WHERE quality = 0)"""


@query("n12_detection_interval", _bootstrap_sql(_ERRORS, "err", "source", ["flagged"]), doubles=_INTERVAL)
def detection_interval(spark, sf):
    """The detection rate with an interval that resamples sources."""
    errors = _rated(spark, sf).filter("quality = 0").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return stats.cluster_bootstrap(errors.select("source", F.col("toxic").alias("flagged")), "source", ["flagged"], N_BOOT)


@query(
    "n15_cohen_kappa",
    """WITH m AS (SELECT count(*)::DOUBLE AS n, avg(CAST(quality = toxic AS INT)) AS o,
      avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS e FROM labels)
    SELECT CAST(n AS BIGINT) AS n, o AS observed, e AS expected, (o - e) / (1 - e) AS kappa FROM m""",
    doubles=("observed", "expected", "kappa"),
)
def cohen_kappa(spark, sf):
    """Agreement of two raters beyond chance."""
    return ratings.cohen_kappa(table(spark, sf, "labels"), "quality", "toxic")


@query(
    "n16_contradictions",
    """WITH a AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_returnflag) > 1 AS c FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, count(*) AS attributes, count(*) FILTER (c) AS contradictions FROM a GROUP BY 1""",
)
def contradictions(spark, sf):
    """Per case, how many attributes have traces that disagree."""
    return ratings.contradictions(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


@query(
    "n17_leakage_inflation",
    f"""WITH {sqltext.SCORED}, seen AS (SELECT DISTINCT source FROM qa WHERE split = 'train'),
    t AS (SELECT confidence, source IN (FROM seen) AS s FROM scored WHERE split = 'test')
    SELECT count(*) FILTER (s) AS seen_rows, count(*) FILTER (NOT s) AS unseen_rows, avg(confidence) FILTER (s) AS seen_mean,
      avg(confidence) FILTER (NOT s) AS unseen_mean, avg(confidence) FILTER (s) - avg(confidence) FILTER (NOT s) AS inflation FROM t""",
    doubles=("seen_mean", "unseen_mean", "inflation"),
)
def leakage_inflation(spark, sf):
    """Mean confidence on test rows whose source is in train, against the others."""
    rows = inputs.scored_exact(spark, sf)
    train = inputs.qa(spark, sf).filter("split = 'train'").select("source").distinct().withColumn("_seen", F.lit(True))
    test = rows.filter("split = 'test'").join(train, "source", "left").withColumn("seen", F.coalesce("_seen", F.lit(False)))
    return ratings.leakage_inflation(test, "seen", "confidence")


# ---- documents ---------------------------------------------------------------------

_SECTIONS = f"""{sqltext.MARKED},
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM marked),
kd AS (
  SELECT *, CASE WHEN starts_with(l, '# ') THEN 1 WHEN starts_with(l, '## ') THEN 2 WHEN starts_with(l, '### ') THEN 3
    WHEN {sqltext.strip('l')} = '---' THEN 0 END AS lv FROM ln),
gr AS (SELECT *, sum(CASE WHEN lv IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM kd),
sec AS (
  SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, max(lv) AS lv, max(l) FILTER (lv IS NOT NULL) AS h,
    coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (lv IS NULL), '') AS content
  FROM gr WHERE section_no > 0 GROUP BY 1, 2),
sections AS (
  SELECT doc_id, section_no, CASE lv WHEN 0 THEN 'separator' WHEN 1 THEN 'title' ELSE 'heading' END AS type,
    CASE WHEN lv > 0 THEN lv END AS level, CASE WHEN lv > 0 THEN {sqltext.strip('substr(h, lv + 2)')} END AS text,
    CASE WHEN lv > 0 THEN content END AS content FROM sec)"""


def _sections(spark, sf):
    return sections.sections(inputs.marked_documents(spark, sf), "doc_id", "text")


@query("m1_sections", f"WITH {_SECTIONS} SELECT doc_id, section_no, type, CAST(level AS BIGINT) AS level, text, md5(content) AS content_md5 FROM sections")
def document_sections(spark, sf):
    """Sections and separators of every document."""
    return _sections(spark, sf).select(
        "doc_id", F.col("section_no").cast("bigint").alias("section_no"), "type", F.col("level").cast("bigint").alias("level"),
        "text", F.md5("content").alias("content_md5"),
    )


@query(
    "m2_content_lines",
    f"""WITH {_SECTIONS},
    cl AS (
      SELECT doc_id, section_no, {sqltext.strip('unnest(string_split(content, chr(10)))')} AS l,
        generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no
      FROM sections WHERE content IS NOT NULL),
    ck AS (
      SELECT *, CASE WHEN starts_with(l, '- ') THEN 'bullet'
        WHEN starts_with(l, '*') AND ends_with(l, '*') AND length(l) - length(replace(l, '*', '')) = 2 THEN 'italic'
        WHEN ends_with(l, ':') AND contains(l, '**') THEN 'subheading' ELSE 'paragraph' END AS kind FROM cl WHERE l <> ''),
    cb AS (SELECT *, CASE kind WHEN 'bullet' THEN substr(l, 3) WHEN 'italic' THEN substr(l, 2, length(l) - 2) ELSE l END AS body FROM ck)
    SELECT doc_id, section_no, line_no, kind, {sqltext.strip('body')} AS line,
      array_to_string(list_transform(regexp_extract_all(body, '\\*\\*.*?\\*\\*'), lambda s: substr(s, 3, length(s) - 4)), ' / ') AS bold
    FROM cb""",
)
def document_lines(spark, sf):
    """Lines of the sections by kind, with their bold spans."""
    lines = sections.content_lines(_sections(spark, sf).filter("content is not null"), ["doc_id", "section_no"])
    return lines.select(
        "doc_id", F.col("section_no").cast("bigint").alias("section_no"), F.col("line_no").cast("bigint").alias("line_no"),
        "kind", "line", F.array_join("bold", " / ").alias("bold"),
    )
