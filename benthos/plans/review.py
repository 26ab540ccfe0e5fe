"""Queries on the review chain, requeries, registries and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benthos.functions import text as T
from benthos.operators import evaluation as E
from benthos.operators import preparation as P
from benthos.operators import review as R
from benthos.plans import evaluation as PE
from benthos.plans.evaluation import LAST, MCQ, TASK
from benthos.plans.registry import query
from benthos.sources.tables import table


@query(MCQ + """, w AS (SELECT q.id, bool_or(ok) FILTER (model_id='naut7b-a') AS a, bool_or(ok) FILTER (model_id='baseline13') AS b, bool_or(letter = 'FAILED') FILTER (model_id='baseline13') AS bf, bool_or(ok) FILTER (model_id='naut7b-b') AS r, bool_or(letter = 'FAILED') FILTER (model_id='naut7b-b') AS rf FROM q JOIN s USING (id) GROUP BY q.id),
miss AS (SELECT q.id, p.id IS NULL AS missing FROM q LEFT JOIN lastp p ON p.id = q.id AND p.model_id = 'naut7b-b')
SELECT count(*) AS total, count(*) FILTER (missing) AS missing_requery, count(*) FILTER (bf) AS second_failed, count(*) FILTER (b) AS second_correct, count(*) FILTER (CASE WHEN bf THEN a ELSE b END) AS second_or_first_correct, count(*) FILTER (a) AS first_correct, count(*) FILTER (CASE WHEN rf THEN a ELSE r END) AS requery_correct, count(*) FILTER (a OR b) AS upper_bound FROM w JOIN miss USING (id)""")
def scienceqa_requery(spark: SparkSession, d: str) -> DataFrame:
    """Option questions answered by two models, and by a third on asking again: counted with the answers that are missing. An
    unreadable answer is wrong, and the first model's stands in for it."""
    of = lambda m, c: F.bool_or(F.when(F.col("model_id") == m, c))
    q = PE._mcq(spark, d)
    failed = F.col("letter") == "FAILED"
    w = q.groupBy("id").agg(of("naut7b-a", F.col("ok")).alias("a"), of("baseline13", F.col("ok")).alias("b"), of("baseline13", failed).alias("bf"), of("naut7b-b", F.col("ok")).alias("r"), of("naut7b-b", failed).alias("rf"))
    asked = E.last_predictions(table(spark, d, "predictions").select("model_id", "id", "answered_at", "pred_no")).where("model_id = 'naut7b-b'").select("id", F.lit(True).alias("hit"))
    t = w.join(asked, "id", "left")
    return t.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("hit").isNull()).alias("missing_requery"), F.count_if("bf").alias("second_failed"), F.count_if("b").alias("second_correct"), F.count_if(F.when(F.col("bf"), F.col("a")).otherwise(F.col("b"))).alias("second_or_first_correct"),
        F.count_if("a").alias("first_correct"), F.count_if(F.when(F.col("rf"), F.col("a")).otherwise(F.col("r"))).alias("requery_correct"), F.count_if(F.col("a") | F.col("b")).alias("upper_bound"),
    )


@query(MCQ + " SELECT model_id, id, letter, gt, ok AS correct FROM s")
def scienceqa_outputs(spark: SparkSession, d: str) -> DataFrame:
    """The lists of right and wrong answers, as one table."""
    return PE._mcq(spark, d).select("model_id", "id", "letter", "gt", F.col("ok").alias("correct"))


ASKED = "lower(CASE WHEN starts_with(prompt, 'OCR tokens: ') THEN regexp_extract(prompt, 'Question: (.*?) Short answer:', 1, 's') WHEN contains(prompt, 'Reference OCR token: ') AND len(string_split(prompt, E'\\n')) = 3 THEN CASE WHEN starts_with(prompt, 'Reference OCR token:') THEN string_split(prompt, E'\\n')[2] ELSE string_split(prompt, E'\\n')[1] END WHEN len(string_split(prompt, E'\\n')) = 2 THEN string_split(prompt, E'\\n')[1] END)"
SHAPED = """(SELECT p_partkey AS key, p_name, CASE p_partkey % 4 WHEN 0 THEN 'OCR tokens: a b Question: What is ' || p_name || '? Short answer:' WHEN 1 THEN 'Reference OCR token: x' || E'\\nWhat is ' || p_name || E'?\\nOne word.' WHEN 2 THEN 'What is ' || p_name || E'?\\nReference OCR token: x\\nOne word.' ELSE 'What is ' || p_name || E'?\\nOne word.' END AS prompt FROM part)"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """(key, p_name, prompt): a question on each part in one of the four shapes that prompts come in."""
    q, k = F.concat(F.lit("What is "), F.col("p_name"), F.lit("?")), F.col("p_partkey") % 4
    prompt = F.when(k == 0, F.concat(F.lit("OCR tokens: a b Question: "), q, F.lit(" Short answer:"))).when(k == 1, F.concat(F.lit("Reference OCR token: x\n"), q, F.lit("\nOne word."))).when(k == 2, F.concat(q, F.lit("\nReference OCR token: x\nOne word."))).otherwise(F.concat(q, F.lit("\nOne word.")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_name", prompt.alias("prompt"))


@query(f"WITH s AS {SHAPED}, q AS (SELECT key, {ASKED} AS question FROM s), a AS (SELECT key, lower('What is ' || p_name || '?') AS question, [p_name, upper(p_name), 'x'] AS answers FROM s) SELECT q.key, q.question, a.answers[1] AS answer FROM q JOIN a USING (key, question)")
def textvqa_join(spark: SparkSession, d: str) -> DataFrame:
    """Prompts joined to annotations by picture and question, the question recovered from the prompt; fails on a prompt without one."""
    s = _asked(spark, d)
    notes = s.select("key", F.lower(F.concat(F.lit("What is "), F.col("p_name"), F.lit("?"))).alias("question"), F.array("p_name", F.upper("p_name"), F.lit("x")).alias("answers"))
    joined = R.guarded(s.select("key", T.question_of_prompt(F.col("prompt")).alias("question")), notes, ["key", "question"])
    return joined.select("key", "question", F.col("answers")[0].alias("answer"))


@query(f"WITH s AS {SHAPED} SELECT key, {ASKED} AS question FROM s")
def prompt_questions(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("key", T.question_of_prompt(F.col("prompt")).alias("question"))


RULES = "(VALUES ('detail', 'Judge', 'On detail.'), ('conv', 'Judge', 'On talk.'), ('default', 'Reviewer', 'On all.')) r(category, role, rule)"


@query(f"SELECT review_no, v.category, r.role, r.rule, '[' || r.role || E']\\n' || r.rule AS prompt FROM reviews v JOIN {RULES} ON r.category = CASE WHEN v.category IN ('detail', 'conv') THEN v.category ELSE 'default' END")
def review_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rule of each review's category, or the default one."""
    rules = spark.createDataFrame([("detail", "Judge", "On detail."), ("conv", "Judge", "On talk."), ("default", "Reviewer", "On all.")], "category string, role string, rule string")
    j = R.with_default(table(spark, d, "reviews").select("review_no", "category"), rules, "category", "default")
    return j.select("review_no", "category", "role", "rule", F.concat(F.lit("["), F.col("role"), F.lit("]\n"), F.col("rule")).alias("prompt"))


@query("WITH c AS (SELECT stem, list(DISTINCT v ORDER BY v) AS captions FROM (SELECT unnest(image) AS stem, conversations[len(conversations)].value AS v FROM samples WHERE answer_form = 'caption') WHERE stem IS NOT NULL AND v IS NOT NULL GROUP BY 1), m AS (SELECT image, max(width) AS w, max(height) AS h FROM image_meta WHERE image IS NOT NULL GROUP BY 1) SELECT s.row_no, s.image_no::INT AS image_no, array_to_string(c.captions, E'\\n') || CASE WHEN m.w IS NOT NULL AND m.h IS NOT NULL THEN E'\\npicture: [0, 0, ' || m.w || ', ' || m.h || ']' ELSE '' END AS context FROM (SELECT row_no, image, unnest(range(1, len(image) + 1)) AS image_no FROM samples WHERE answer_form <> 'caption') s JOIN c ON c.stem = s.image[s.image_no] LEFT JOIN m ON m.image = c.stem")
def review_contexts(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each picture that a record shows: the captions of other records, and its frame as a labelled box."""
    s = table(spark, d, "samples")
    told = s.where("answer_form = 'caption'").select(F.explode("image").alias("picture"), F.try_element_at("conversations", F.lit(-1))["value"].alias("v")).where("picture is not null and v is not null")
    captions = told.groupBy("picture").agg(F.sort_array(F.collect_set("v")).alias("captions"))
    sizes = table(spark, d, "image_meta").where("image is not null").groupBy(F.col("image").alias("picture")).agg(F.max("width").alias("w"), F.max("height").alias("h"))
    label = F.when(F.col("w").isNotNull() & F.col("h").isNotNull(), F.array(F.format_string("picture: [0, 0, %d, %d]", "w", "h"))).otherwise(F.array().cast("array<string>"))
    shown = s.where("answer_form <> 'caption'").select("row_no", F.posexplode("image").alias("k", "picture"))
    return shown.join(captions, "picture").join(sizes, "picture", "left").select("row_no", (F.col("k") + 1).alias("image_no"), R.context_text(F.col("captions"), label).alias("context"))


PAGE_N = "(((review_no - 1) % 80) + 1)"


@query(
    f"""WITH lasta AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY pred_no DESC) rn FROM predictions WHERE answer_id IS NOT NULL) WHERE rn = 1),
n1 AS (SELECT *, CASE WHEN n <= 20 THEN n + 60 ELSE n - 20 END AS a FROM (SELECT *, {PAGE_N} AS n FROM reviews)), n2 AS (SELECT *, CASE WHEN a <= 50 THEN a + 10 WHEN a <= 60 THEN a - 50 ELSE a END AS b FROM n1), n3 AS (SELECT *, CASE WHEN b = 7 THEN 1 WHEN b < 7 THEN b + 1 ELSE b END AS no FROM n2)
SELECT r.no, r.review_no, coalesce(r.category, 'none') AS category, a.text AS first, b.text AS second, replace(replace(regexp_replace(trim(r.content), '^[0-9]+[, ]+[0-9]+[^\\n]*(\\n|$)', ''), 'Assistant 1', '**Assistant 1**'), 'Assistant 2', '**Assistant 2**') AS evaluation, r.score_pair AS scores FROM n3 r JOIN lasta a ON a.answer_id = r.answer1_id JOIN lasta b ON b.answer_id = r.answer2_id"""
)
def review_page(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the review page: question number, both answers, the cleaned review and its scores."""
    a = E.last_of(table(spark, d, "predictions").select("answer_id", "text", "pred_no"), ["answer_id"], ["pred_no"]).select("answer_id", "text")
    r = table(spark, d, "reviews").withColumn("no", R.renumbered((F.col("review_no") - 1) % 80 + 1))
    j = r.join(a.select(F.col("answer_id").alias("answer1_id"), F.col("text").alias("first")), "answer1_id").join(a.select(F.col("answer_id").alias("answer2_id"), F.col("text").alias("second")), "answer2_id")
    return j.select("no", "review_no", F.coalesce("category", F.lit("none")).alias("category"), "first", "second", R.marked_names(F.col("content")).alias("evaluation"), F.col("score_pair").alias("scores"))


@query("SELECT review_no, array_to_string(string_split(content, E'\\n')[2:], E'\\n') AS body, lower(question_id) AS key FROM reviews WHERE content IS NOT NULL")
def review_tail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reviews").where("content is not null").select("review_no", R.without_first_lines(F.col("content"), 1).alias("body"), F.lower("question_id").alias("key"))


LONG = f"""WITH {LAST}, q AS (SELECT p.model_id, {TASK.replace('id,', 'p.id,')} AS task, p.text, p.gt FROM lastp p)
SELECT model_id, task, unnest(['n_answers', 'n_empty', 'exact']) AS metric, unnest([count(*)::DOUBLE, count(*) FILTER (text IS NULL)::DOUBLE, avg((lower(text) = lower(gt))::INT)]) AS value FROM q WHERE task IN ('Image_caption', 'Grounding', 'VQA', 'Counting') GROUP BY model_id, task"""


@query(LONG)
def metric_registry(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of several tasks by a registry, as one long table."""

    def basic(df: DataFrame) -> DataFrame:
        return df.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_answers"), F.count_if(F.col("text").isNull()).alias("n_empty"), F.avg((F.lower("text") == F.lower("gt")).cast("int")).alias("exact"))

    registry = R.Metrics()
    tasks = ("Image_caption", "Grounding", "VQA", "Counting")
    for task in tasks:
        registry.register(task, basic)
    last = E.last_predictions(table(spark, d, "predictions").select("model_id", "id", "text", "gt", "answered_at", "pred_no"))
    return registry.run({t: last.where(F.col("task") == t) for t in tasks}, ["model_id"])


@query(f"WITH {LAST}, m AS (SELECT DISTINCT model_id FROM lastp), g AS (SELECT m.model_id, t.tag FROM m CROSS JOIN (VALUES ('0'),('1'),('2'),('3'),('4'),('5'),('6'),('7'),('8')) t(tag)) SELECT g.model_id, g.tag, count(p.id) AS n, CASE WHEN count(p.id) = 0 THEN 'no answers' END AS error FROM g LEFT JOIN lastp p ON p.model_id = g.model_id AND substr(p.id, 2, 1) = g.tag GROUP BY ALL")
def empty_groups(spark: SparkSession, d: str) -> DataFrame:
    """Answers by model and tag; a group without any has an error record in place of numbers."""
    last = E.last_predictions(table(spark, d, "predictions").select("model_id", "id", "answered_at", "pred_no"))
    groups = last.select("model_id").distinct().select("model_id", F.explode(F.array(*(F.lit(str(k)) for k in range(9)))).alias("tag"))
    counts = last.groupBy("model_id", F.substring("id", 2, 1).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return groups.join(counts, ["model_id", "tag"], "left").select("model_id", "tag", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n").isNull(), "no answers").alias("error"))


@query("SELECT model_id, count(*) AS n_pairs, -1.0::DOUBLE AS meteor, -1.0::DOUBLE AS spice FROM predictions WHERE answer_form = 'caption' AND text IS NOT NULL AND gt IS NOT NULL AND model_id IS NOT NULL GROUP BY 1")
def caption_external(spark: SparkSession, d: str) -> DataFrame:
    """The two caption metrics that need other software are -1, beside the pairs they would score."""
    p = table(spark, d, "predictions").where("answer_form = 'caption' and text is not null and gt is not null and model_id is not null")
    return p.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.lit(-1.0).alias("meteor"), F.lit(-1.0).alias("spice"))


NAMES = "SELECT run_no, trim(unnest(string_split(dataset_use, ','))) AS entry FROM data_arguments WHERE dataset_use IS NOT NULL"


@query(f"WITH n AS ({NAMES}), k AS (SELECT run_no, lower(trim(regexp_replace(entry, '%[0-9]*$', ''))) AS name FROM n WHERE entry <> '') SELECT run_no, name, r.dataset IS NULL AS missing FROM k LEFT JOIN (SELECT DISTINCT lower(trim(dataset)) AS dataset FROM dataset_registry) r ON r.dataset = name")
def registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each named dataset of a run, and whether the registry lacks it (P.named fails on these)."""
    p = table(spark, d, "data_arguments").select("run_no", F.explode(F.split("dataset_use", ",")).alias("p")).select("run_no", F.trim("p").alias("entry")).where("entry <> ''")
    names = p.select("run_no", F.lower(F.trim(F.regexp_replace("entry", "%[0-9]*$", ""))).alias("name"))
    known = table(spark, d, "dataset_registry").select(F.lower(F.trim("dataset")).alias("name"), F.lit(True).alias("hit")).distinct()
    return names.join(F.broadcast(known), "name", "left").select("run_no", "name", F.col("hit").isNull().alias("missing"))


@query("SELECT count(*) AS n_rows, count(DISTINCT row_no) AS n_records, sum(row_no)::BIGINT AS total, 0::BIGINT AS n_unsorted FROM samples")
def shuffle_all(spark: SparkSession, d: str) -> DataFrame:
    """A seeded shuffle of all records: nothing lost or doubled, and in the order of the seeded keys."""
    s = R.shuffled(table(spark, d, "samples").select("row_no"), "row_no", 7)
    placed = s.withColumn("_at", F.monotonically_increasing_id()).select("row_no", "shuffle_key", "_at", F.spark_partition_id().alias("_p"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("_p").orderBy("_at")
    falls = placed.withColumn("falls", (F.lag("shuffle_key").over(w) > F.col("shuffle_key")).cast("long"))
    return falls.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_no").alias("n_records"), F.sum("row_no").alias("total"), F.coalesce(F.sum("falls"), F.lit(0)).alias("n_unsorted"))


@query("SELECT row_no, 'first' AS part, dataset FROM samples WHERE split_name = 'train' UNION ALL SELECT row_no, 'second', dataset FROM samples WHERE split_name = 'val' UNION ALL SELECT row_no, 'third', NULL FROM samples WHERE split_name = 'test'")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    """Datasets put together; a column that one lacks is null."""
    s = table(spark, d, "samples")
    of = lambda split, part, *cols: s.where(F.col("split_name") == split).select("row_no", F.lit(part).alias("part"), *cols)
    return P.union_of([of("train", "first", "dataset"), of("val", "second", "dataset"), of("test", "third")])


@query("WITH a AS (SELECT DISTINCT id FROM samples WHERE id IS NOT NULL), b AS (SELECT DISTINCT id FROM predictions WHERE id IS NOT NULL) SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def id_sides(spark: SparkSession, d: str) -> DataFrame:
    """Ids of records and of answers: those of both, of records alone, of either."""
    a, b = (table(spark, d, t).where("id is not null").select("id") for t in ("samples", "predictions"))
    parts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n") for name, x in zip(("both", "first", "either"), R.sides(a, b))]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT review_no, question_id FROM reviews WHERE category LIKE '%e%' AND contains(question_id, 'D') AND (question_id NOT IN (SELECT question_id FROM reviews WHERE review_no <= 5 AND question_id IS NOT NULL))")
def review_selection(spark: SparkSession, d: str) -> DataFrame:
    """Reviews whose names have all wanted parts, without the questions to be ignored."""
    r = table(spark, d, "reviews")
    ignored = r.where("review_no <= 5").select("question_id").distinct()
    return r.where(F.col("category").contains("e") & F.col("question_id").contains("D")).join(ignored, "question_id", "left_anti").select("review_no", "question_id")


@query("SELECT pred_no, model_id FROM predictions ORDER BY pred_no LIMIT 25")
def first_cases(spark: SparkSession, d: str) -> DataFrame:
    """The first cases in order: where a run stops early."""
    return table(spark, d, "predictions").select("pred_no", "model_id").orderBy("pred_no").limit(25)


@query("SELECT image, CASE WHEN starts_with(s[-1], 'checkpoint-') THEN CASE WHEN len(s) > 1 THEN s[-2] || '_' ELSE '' END || s[-1] ELSE s[-1] END AS name FROM (SELECT image, string_split(trim(image || CASE WHEN length(image) % 2 = 0 THEN '/checkpoint-7/' ELSE '' END, '/'), '/') AS s FROM (SELECT DISTINCT image FROM image_meta WHERE image IS NOT NULL))")
def model_names(spark: SparkSession, d: str) -> DataFrame:
    """Names from paths, half of them of checkpoints."""
    p = table(spark, d, "image_meta").where("image is not null").select("image").distinct()
    return p.select("image", T.model_name(F.concat("image", F.when(F.length("image") % 2 == 0, "/checkpoint-7/").otherwise(""))).alias("name"))


KINDS = ("vision-v1.5-", "vision-llama-2-", "mpt-", "vision-mpt-", "Vision-v1.6-34b-", "vision-mistral-", "llama-2-", "other-")
TEMPLATE_RULES = [(("vision", "llama-2"), "llama"), (("vision", "mistral"), "llama"), (("vision", "v1.6-34b"), "bare"), (("vision", "v1"), "two"), (("vision", "mpt"), "bare"), (("vision",), "single"), (("mpt",), "bare"), (("llama-2",), "llama")]


@query(f"SELECT p_partkey, name, CASE {' '.join('WHEN ' + ' AND '.join(f'contains(lower(name), {x!r})' for x in parts) + f' THEN {v!r}' for parts, v in TEMPLATE_RULES)} ELSE 'two' END AS template FROM (SELECT p_partkey, {list(KINDS)}[p_partkey % 8 + 1] || p_size AS name FROM part)")
def model_templates(spark: SparkSession, d: str) -> DataFrame:
    """The template that a model's name calls for, by nested rules."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.get(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 8).cast("int")), F.col("p_size").cast("string")).alias("name"))
    return p.select("p_partkey", "name", R.first_rule(F.col("name"), TEMPLATE_RULES, "two").alias("template"))


@query("SELECT event_id, pos::INT AS pos, c[pos + 1] AS chunk, json_extract_string(c[pos + 1], '$.k') AS k FROM (SELECT event_id, c, unnest(range(0, len(c))) AS pos FROM (SELECT event_id, list_filter(string_split('{\"k\":\"' || event_type || '\"}' || chr(0) || chr(0) || '{\"k\":\"' || user_id || '\"}' || chr(0), chr(0)), lambda x: x <> '') AS c FROM events))")
def framed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The JSON chunks of a NUL-parted stream."""
    nul = F.char(F.lit(0))
    chunk = lambda c: F.concat(F.lit('{"k":"'), c, F.lit('"}'))
    e = table(spark, d, "events").select("event_id", F.concat(chunk(F.col("event_type")), F.lit("\x00\x00"), chunk(F.col("user_id").cast("string")), F.lit("\x00")).alias("s"))
    return e.select("event_id", F.posexplode(R.framed(F.col("s"))).alias("pos", "chunk")).withColumn("k", F.get_json_object("chunk", "$.k"))


@query("SELECT md5(text) || '.txt' AS name, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text")
def content_store(spark: SparkSession, d: str) -> DataFrame:
    """Contents by the md5 of what they hold, each once."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.groupBy(F.concat(F.md5(F.col("text").cast("binary")), F.lit(".txt")).alias("name")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT row_no, list_sort(list_distinct(list_transform(range(0, n), lambda k: floor(CASE WHEN n > 1 THEN k * (frames - 1)::DOUBLE / (n - 1) ELSE 0 END)::INT))) AS frames FROM (SELECT row_no, frames, greatest(4, least(8, round_even(frames / 25.0 / 2.0, 0)::INT))::BIGINT AS n FROM (SELECT row_no, coalesce(num_tokens, 0) * 3 + 1 AS frames FROM samples))")
def video_frames(spark: SparkSession, d: str) -> DataFrame:
    """The frames to look at of a clip of each record's length."""
    s = table(spark, d, "samples").select("row_no", (F.coalesce("num_tokens", F.lit(0)) * 3 + 1).alias("n"))
    return s.select("row_no", F.sort_array(R.frame_indices(F.col("n"), F.lit(25.0), 2.0, 4, 8)).alias("frames"))


@query("SELECT pred_no, (k * 7 + 5)::INT AS chunk_bytes, upper(to_base64(encode(t))) = upper(b) AS same FROM (SELECT pred_no, length(text) % 5 AS k, text AS t, to_base64(encode(text)) AS b FROM predictions WHERE text IS NOT NULL)")
def base64_round(spark: SparkSession, d: str) -> DataFrame:
    """Contents in base64 and back."""
    p = table(spark, d, "predictions").where("text is not null")
    return p.select("pred_no", (F.length("text") % 5 * 7 + 5).cast("int").alias("chunk_bytes"), (F.unbase64(F.base64(F.encode("text", "UTF-8"))) == F.encode("text", "UTF-8")).alias("same"))


@query("SELECT p_partkey, replace(k, 'pretrained.', '') AS name FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'pretrained.' ELSE '' END || 'blocks.' || p_size || '.weight' AS k FROM part) WHERE contains(k, 'pretrained.')")
def key_rename(spark: SparkSession, d: str) -> DataFrame:
    """The keys of one prefix, without it."""
    k = F.concat(F.when(F.col("p_partkey") % 3 == 0, "pretrained.").otherwise(""), F.lit("blocks."), F.col("p_size").cast("string"), F.lit(".weight"))
    return table(spark, d, "part").select("p_partkey", k.alias("k")).where(F.col("k").contains("pretrained.")).select("p_partkey", F.replace("k", F.lit("pretrained."), F.lit("")).alias("name"))


@query("SELECT event_type, user_id AS model, count(*) AS n, sum(value) AS queue FROM events GROUP BY ALL")
def worker_models(spark: SparkSession, d: str) -> DataFrame:
    """What the workers of a kind offer, each once, and the sum of its queues."""
    return table(spark, d, "events").groupBy("event_type", F.col("user_id").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("queue"))


@query("SELECT p.pred_no, c.category, p.question FROM (SELECT pred_no, id, CASE WHEN length(prompt) % 2 = 0 THEN 'popular' ELSE 'random' END AS category, prompt AS question FROM predictions WHERE prompt IS NOT NULL) p JOIN (VALUES ('popular'), ('adversarial')) c(category) ON c.category = p.category")
def category_filter(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the wanted categories, by the dimension of their questions."""
    p = table(spark, d, "predictions").where("prompt is not null").select("pred_no", F.when(F.length("prompt") % 2 == 0, "popular").otherwise("random").alias("category"), F.col("prompt").alias("question"))
    wanted = spark.createDataFrame([("popular",), ("adversarial",)], "category string")
    return p.join(F.broadcast(wanted), "category").select("pred_no", "category", "question")
