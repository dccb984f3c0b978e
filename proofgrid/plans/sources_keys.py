"""Catalogue: sources and sinks, key and answer functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.functions import answers, keys
from proofgrid.operators import gates, intervals
from proofgrid.plans import inputs, sqltext
from proofgrid.plans.inputs import table
from proofgrid.plans.registry import query
from proofgrid.plans.sqltext import canon, h60, seed32, strip
from proofgrid.session import shared_folder, together
from proofgrid.sources import files, records, shapes

_RECORD_SQL = f"""
WITH {sqltext.QA}
SELECT source AS img_id, '<image>' || (SELECT any_value(t.asked) FROM turns t
    WHERE CAST(t.conv_id AS VARCHAR) = q.source AND 'turn ' || t.turn = q.original) AS user_content,
  answer AS assistant_content, image, split AS official_split, complexity,
  array_to_string(classes, ',') AS classes, original, 'original' AS image_variant
FROM qa q"""


def _flat(nested):
    m = F.col("metadata")
    return nested.select(
        m["img_id"].alias("img_id"), F.col("messages")[0]["content"].alias("user_content"),
        F.col("messages")[1]["content"].alias("assistant_content"), F.col("images")[0].alias("image"),
        m["official_split"].alias("official_split"), m["complexity"].alias("complexity"),
        F.array_join(m["question_class"], ",").alias("classes"), m["original"].alias("original"),
        m["image_variant"].alias("image_variant"),
    )


@query("a1_a2_json_lines_round_trip", _RECORD_SQL)
def json_lines_round_trip(spark, sf):
    """Records written as JSON lines and read back with a fixed schema."""
    path = shared_folder(spark, "records")
    files.write_json_lines(inputs.qa_records(spark, sf), path)
    return _flat(files.read_json_lines(spark, path, shapes.QA_RECORD))


@query("a3_chat_records", _RECORD_SQL)
def chat_records(spark, sf):
    """Question, answer and id columns as nested chat records."""
    return _flat(inputs.qa_records(spark, sf))


_A4 = """
wanted AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"""


def _image_rows(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("img_id"), "l_linenumber", "l_partkey", "l_suppkey")


def _required(spark, sf):
    return table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("img_id"))


@query(
    "a4_first_image_per_id",
    f"""WITH {_A4}
    SELECT l_orderkey AS img_id, min(l_linenumber) AS l_linenumber,
      CAST(arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS BIGINT) AS l_partkey,
      CAST(arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS BIGINT) AS l_suppkey
    FROM lineitem WHERE l_orderkey IN (FROM wanted) GROUP BY 1""",
)
def first_image_per_id(spark, sf):
    """The first image row of each required id."""
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return records.one_image_per_id(_image_rows(spark, sf), _required(spark, sf), "img_id", order)


@query(
    "a4_required_ids_without_image",
    f"WITH {_A4} SELECT o_orderkey AS img_id FROM wanted WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def required_without_image(spark, sf):
    """Required ids that no image row has."""
    return records.missing_images(_image_rows(spark, sf), _required(spark, sf), "img_id")


def page_files(spark, sf):
    return table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"), "page_id")


@query(
    "a5_file_manifest",
    "SELECT url AS path, CAST(strlen(html) AS BIGINT) AS bytes, sha256(html) AS sha256, 'r1' AS revision FROM pages",
)
def file_manifest(spark, sf):
    """Length and sha256 of every page."""
    return files.manifest(page_files(spark, sf), "r1")


_PAGES = 50  # pages of a file
_LISTED = f"""
lines AS (SELECT page_id, CAST(page_id // {_PAGES} AS INT) AS bucket, page_id || ' ' || md5(html) AS line FROM pages),
old AS (SELECT bucket, sha256(string_agg(line, chr(10) ORDER BY page_id) || chr(10)) AS sha256 FROM lines GROUP BY 1),
new AS (
  SELECT bucket, sha256(string_agg(line, chr(10) ORDER BY page_id) || chr(10)) AS sha256, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes
  FROM lines WHERE bucket % 8 <> 2 AND bucket <> 3 AND NOT (bucket % 8 = 1 AND page_id % 3 = 0) GROUP BY 1
  UNION ALL SELECT 3, sha256(''), 0)"""


@query(
    "a5_c13_files_on_storage",
    f"""WITH {_LISTED}
    SELECT bucket, coalesce(new.bytes, -1) AS bytes, new.sha256,
      CASE WHEN old.sha256 IS NULL THEN 'new' WHEN new.sha256 IS NULL THEN 'gone' WHEN new.sha256 <> old.sha256 THEN 'changed' ELSE 'same' END AS state
    FROM old FULL JOIN new USING (bucket)""",
)
def files_on_storage(spark, sf):
    """Files written, listed and hashed; then written again with some changed, some gone and one empty, and compared."""
    lines = table(spark, sf, "pages").select(
        "page_id", F.expr(f"cast(page_id div {_PAGES} as int)").alias("bucket"), F.concat(F.col("page_id").cast("string"), F.lit(" "), F.md5("html")).alias("line")
    )

    def written(rows, name):
        folder = shared_folder(spark, name)
        dealt = together(rows, "bucket").sortWithinPartitions("bucket", "page_id")
        dealt.select("bucket", F.col("line").alias("value")).write.partitionBy("bucket").text(folder)
        return folder

    def manifest(folder):
        found = files.file_manifest(spark, folder, "*.txt", large=1800)  # about half of these files are hashed piece by piece
        return found.withColumn("path", F.regexp_extract("path", "bucket=([0-9]+)", 1))

    then = written(lines, "files-then")
    now = written(lines.filter("bucket % 8 <> 2 and bucket <> 3 and not (bucket % 8 = 1 and page_id % 3 = 0)"), "files-now")
    lines.filter("false").coalesce(1).select("line").write.text(f"{now}/bucket=3")
    current = manifest(now)
    compared = gates.compared_hashes(manifest(then), current).join(current.select("path", "bytes"), "path", "left")
    return compared.select(F.col("path").cast("int").alias("bucket"), F.coalesce("bytes", F.lit(-1)).alias("bytes"), F.col("current_sha256").alias("sha256"), "state")


@query(
    "a7_csv_round_trip",
    f"WITH {sqltext.TASKS} SELECT task, CAST(start AS VARCHAR) AS start, CAST(finish AS VARCHAR) AS finish, category, status FROM tasks",
)
def csv_round_trip(spark, sf):
    """The task table as CSV and back."""
    path = shared_folder(spark, "tasks")
    files.write_csv(inputs.tasks(spark, sf), path)
    back = files.read_csv(spark, path, shapes.TASK)
    return back.withColumns({c: F.col(c).cast("string") for c in ("start", "finish")})


@query(
    "a8_a9_outputs_per_condition",
    f"""WITH {sqltext.PRED} SELECT condition, item_id, md5(prediction) AS prediction_md5
    FROM pred WHERE split = 'train' AND condition <> 'paired'""",
)
def outputs_per_condition(spark, sf):
    """One write makes a folder per split and condition; reading some of them prunes the rest."""
    path = shared_folder(spark, "outputs")
    files.write_by_condition(inputs.predictions(spark, sf).select("split", "condition", "item_id", "prediction"), path, "scored")
    schema = "item_id string, prediction string, split string, condition string"
    stored = spark.read.schema(schema).json(f"{path}/scored")
    kept = stored.filter((F.col("split") == "train") & (F.col("condition") != "paired"))
    return kept.select("condition", "item_id", F.md5("prediction").alias("prediction_md5"))


@query(
    "a8_a9_files_by_name",
    f"""WITH {sqltext.PRED}
    SELECT kind, condition, count(*) AS rows, sum(CASE kind WHEN 'scored' THEN CAST({canon('prediction')} = {canon('reference')} AS INT) END)::BIGINT AS matches
    FROM pred, (VALUES ('predictions'), ('scored')) k(kind) WHERE split = 'train' GROUP BY ALL""",
)
def files_by_name(spark, sf):
    """Prediction files named by split and condition, scored files beside them, and both read back by name."""
    folder = shared_folder(spark, "predictions")
    files.write_named(inputs.predictions(spark, sf).select("split", "condition", "item_id", "prediction", "reference"), folder)
    read = lambda derived: files.read_predictions(spark, folder, "train", "item_id string, prediction string, reference string, matches int", derived)
    exact = (keys.canonical(F.col("prediction")) == keys.canonical(F.col("reference"))).cast("int")
    files.write_named(read(None).withColumns({"split": F.lit("train"), "matches": exact}), folder, "scored")
    kinds = read(None).withColumn("kind", F.lit("predictions")).unionByName(read("scored").withColumn("kind", F.lit("scored")))
    return kinds.groupBy("kind", "condition").agg(F.count("*").alias("rows"), F.sum("matches").cast("bigint").alias("matches"))


@query("a10_needed_columns_only", "SELECT vec_id, CAST(label AS VARCHAR) AS label FROM embeddings WHERE label = 3")
def needed_columns_only(spark, sf):
    """Projection and filter reach the scan; the vectors are not read."""
    return table(spark, sf, "embeddings").filter("label = 3").select("vec_id", F.col("label").cast("string").alias("label"))


def _partial_ids(spark, sf):
    turn = inputs.turns(spark, sf)
    ident = F.col("conv_id").cast("string")
    source = F.when(F.col("h") % 4 == 0, "").when(F.col("h") % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), ident))
    image = F.when(F.col("h") % 8 != 0, ident)
    return turn.select("conv_id", "turn", F.struct(source.alias("source_img_id"), image.alias("img_id")).alias("metadata"))


@query(
    "b1_source_id",
    f"""WITH {sqltext.QA}
    SELECT conv_id, turn, coalesce(nullif(CASE WHEN h % 4 = 0 THEN '' WHEN h % 4 = 1 THEN NULL ELSE 's' || conv_id END, ''),
      CASE WHEN h % 8 <> 0 THEN CAST(conv_id AS VARCHAR) END, 'None') AS source FROM turns""",
)
def source_ids(spark, sf):
    """Empty and null source ids fall back to the image id, then to 'None'."""
    return _partial_ids(spark, sf).select("conv_id", "turn", keys.source_id().alias("source"))


@query(
    "b2_question_text",
    f"""SELECT conv_id, turn, {strip("replace('<image>' || chr(10) || text || ' <image> ', '<image>', '')")} AS question
    FROM conversations""",
)
def question_texts(spark, sf):
    """Image tags removed, then stripped."""
    tagged = F.concat(F.lit("<image>\n"), F.col("text"), F.lit(" <image> "))
    return table(spark, sf, "conversations").select("conv_id", "turn", keys.question_text(tagged).alias("question"))


@query("b3_canonical_text", f"SELECT doc_id, md5({canon('text')}) AS canonical_md5 FROM documents")
def canonical_texts(spark, sf):
    """Canonical form of every document."""
    return inputs.documents(spark, sf).select("doc_id", F.md5(keys.canonical(F.col("text"))).alias("canonical_md5"))


@query(
    "b4_normalised_answer",
    f"SELECT doc_id, md5({canon('text')}) AS normal_md5, len({canon('text')}) AS characters FROM documents",
)
def normalised_answers(spark, sf):
    """Normalised form of every document; the given texts hold no compatibility characters."""
    return (
        inputs.documents(spark, sf).select("doc_id", answers.normalised(F.col("text")).alias("n"))
        .select("doc_id", F.md5("n").alias("normal_md5"), F.length("n").cast("bigint").alias("characters"))
    )


@query("b5_item_id", f"WITH {sqltext.QA} SELECT source, question, item_id FROM qa")
def item_ids(spark, sf):
    """Item ids of all QA records."""
    return inputs.qa(spark, sf).select("source", "question", "item_id")


_FRACTION = "[0.05, 0.1, 0.2, 0.3]::DOUBLE[]"


@query(
    "b6_intervention_id",
    f"""SELECT 'v' || vec_id AS item_id, f AS fraction,
      substr(sha256('v' || vec_id || '|m|deletion|gray|' || printf('%.6f', f) || '|random|' || label), 1, 24) AS intervention_id
    FROM embeddings, unnest({_FRACTION}) t(f)""",
    doubles=("fraction",),
)
def intervention_ids(spark, sf):
    """Ids from seven parts, the fraction with six digits."""
    levels = F.explode(F.array(*[F.lit(f) for f in (0.05, 0.1, 0.2, 0.3)])).alias("fraction")
    cells = table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("item_id"), "label", levels)
    ident = keys.intervention_id(
        F.col("item_id"), F.lit("m"), F.lit("deletion"), F.lit("gray"), F.col("fraction"), F.lit("random"), F.col("label")
    )
    return cells.select("item_id", "fraction", ident.alias("intervention_id"))


@query(
    "b7_stable_seed",
    f"""SELECT 'v' || vec_id AS item_id, f AS fraction,
      {seed32("'42|v' || vec_id || '|m|' || CAST(f AS VARCHAR) || '|' || label")} AS seed
    FROM embeddings, unnest({_FRACTION}) t(f)""",
    doubles=("fraction",),
)
def stable_seeds(spark, sf):
    """32-bit seeds from hashed parts."""
    levels = F.explode(F.array(*[F.lit(f) for f in (0.05, 0.1, 0.2, 0.3)])).alias("fraction")
    cells = table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("item_id"), "label", levels)
    seed = keys.stable_seed(F.lit(42), F.col("item_id"), F.lit("m"), F.col("fraction"), F.col("label"))
    return cells.select("item_id", "fraction", seed.alias("seed"))


@query("b8_word_count", f"SELECT doc_id, len({sqltext.words('text')}) AS words FROM documents")
def word_counts(spark, sf):
    """White-space words per document."""
    return inputs.documents(spark, sf).select("doc_id", keys.word_count(F.col("text")).cast("bigint").alias("words"))


@query(
    "b9_default_labels",
    f"WITH {sqltext.QA} SELECT item_id, array_to_string(coalesce(classes, ['unlabelled']), ',') AS labels FROM qa",
)
def default_labels(spark, sf):
    """Class lists, with a label for rows that have none."""
    return inputs.qa(spark, sf).select("item_id", F.array_join(keys.labels_or_default(F.col("classes")), ",").alias("labels"))


@query(
    "b10_question_only_copy",
    _RECORD_SQL.replace("image, split", "'images/constant.png' AS image, split").replace(
        "'original' AS image_variant", "'constant_training_control' AS image_variant"
    ),
)
def question_only_copy(spark, sf):
    """Records with one constant image and the variant named."""
    return _flat(records.question_only(inputs.qa_records(spark, sf), inputs.CONSTANT_IMAGE))


@query(
    "b11_finite_logprobs",
    f"""WITH {sqltext.SCORED} SELECT item_id, condition, len(token_logprobs) AS tokens, len(kept) AS finite_tokens,
      coalesce(list_sum(kept), 0) AS total FROM scored""",
    doubles=("total",),
)
def finite_logprobs(spark, sf):
    """Null and not-a-number log probabilities removed."""
    rows = inputs.scored_exact(spark, sf).withColumn("kept", answers.finite(F.col("token_logprobs")))
    return rows.select(
        "item_id", "condition", F.size("token_logprobs").cast("bigint").alias("tokens"),
        F.size("kept").cast("bigint").alias("finite_tokens"),
        F.aggregate("kept", F.lit(0.0), lambda a, x: a + x).alias("total"),
    )


@query(
    "b12_sequence_confidence",
    f"WITH {sqltext.SCORED} SELECT item_id, condition, mean_logprob, confidence FROM scored",
    doubles=("mean_logprob", "confidence"),
)
def sequence_confidences(spark, sf):
    """Mean log probability and geometric mean token probability."""
    return inputs.scored_exact(spark, sf).select("item_id", "condition", "mean_logprob", "confidence")


@query("b13_h1_exact_match", f"WITH {sqltext.SCORED} SELECT item_id, condition, exact_match FROM scored", doubles=("exact_match",))
def exact_matches(spark, sf):
    """Equality of normalised answers."""
    return inputs.scored_exact(spark, sf).select("item_id", "condition", "exact_match")


_COLOURS = ", ".join(f"('{c}', '{v}')" for c, v in intervals.CATEGORY_COLOURS.items())


@query(
    "b14_category_colour",
    f"""WITH {sqltext.TASKS}, colours(category, colour) AS (VALUES {_COLOURS})
    SELECT task, category, colour FROM tasks LEFT JOIN colours USING (category)""",
)
def category_colours(spark, sf):
    """Colour of each task's category, null where there is none."""
    coloured = intervals.with_lookup(inputs.tasks(spark, sf), intervals.colour_table(spark), "category")
    return coloured.select("task", "category", "colour")
