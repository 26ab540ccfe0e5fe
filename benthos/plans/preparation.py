"""Queries on instruction data: captions, short answers, conversations, batches, validation, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from benthos.functions import text as T
from benthos.operators import captions as C
from benthos.operators import conversations as V
from benthos.operators import evaluation as E
from benthos.operators import preparation as P
from benthos.plans.evaluation import LAST, STRIP
from benthos.plans.registry import query
from benthos.sources.files import metric_document, unseen
from benthos.sources.tables import table
from benthos.streaming import workers as W

#: White space of any script, for the SQL twins.
SPACES = r"[\s\p{Z}\x{0085}\x{000b}]+"

# --- captions ---------------------------------------------------------------------------------------------------------

CAPS = f"""WITH {LAST}, toks AS (SELECT model_id, id AS key, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}'']+', ' ', 'g'), ' '), lambda w: w <> '') AS hyp, list_filter(string_split(regexp_replace(lower(gt), '[^\\p{{L}}\\p{{N}}'']+', ' ', 'g'), ' '), lambda w: w <> '') AS ref FROM lastp WHERE answer_form='caption' AND text IS NOT NULL AND gt IS NOT NULL),
ks(n) AS (VALUES (1),(2),(3),(4)),
hg AS (SELECT model_id, key, n, gram, count(*) AS hyp_n FROM (SELECT model_id, key, n, unnest(list_transform(range(1, len(hyp)-n+2), lambda i: array_to_string(hyp[i:i+n-1], ' '))) AS gram FROM toks CROSS JOIN ks) GROUP BY ALL),
rg AS (SELECT model_id, key, n, gram, count(*) AS ref_n FROM (SELECT model_id, key, n, unnest(list_transform(range(1, len(ref)-n+2), lambda i: array_to_string(ref[i:i+n-1], ' '))) AS gram FROM toks CROSS JOIN ks) GROUP BY ALL),"""


def _captions(spark: SparkSession, d: str) -> DataFrame:
    """(model_id, key, hyp, ref): the words of last answers to captions, and of their truths."""
    p = table(spark, d, "predictions").where("answer_form = 'caption'")
    last = E.last_predictions(p.select("model_id", "id", "text", "gt", "answered_at", "pred_no")).where("text is not null and gt is not null")
    return last.select("model_id", F.col("id").alias("key"), C.words(F.col("text")).alias("hyp"), C.words(F.col("gt")).alias("ref"))


@query(CAPS + """sz AS (SELECT model_id, count(*) AS n_pairs, sum(len(hyp)) AS hl, sum(len(ref)) AS rl FROM toks GROUP BY 1),
cl AS (SELECT h.model_id, h.n, sum(least(hyp_n, coalesce(ref_n,0)))/sum(hyp_n) AS p FROM hg h LEFT JOIN rg r USING (model_id, key, n, gram) GROUP BY ALL),
wd AS (SELECT model_id, max(p) FILTER (n=1) AS p1, max(p) FILTER (n=2) AS p2, max(p) FILTER (n=3) AS p3, max(p) FILTER (n=4) AS p4 FROM cl GROUP BY 1),
bp AS (SELECT *, CASE WHEN hl<rl THEN exp(1-rl/hl) ELSE 1 END AS b FROM sz JOIN wd USING (model_id))
SELECT model_id, n_pairs, b*p1 AS bleu1, b*sqrt(p1*p2) AS bleu2, b*pow(p1*p2*p3,1/3) AS bleu3, b*pow(p1*p2*p3*p4,1/4) AS bleu4 FROM bp""")
def caption_bleu(spark: SparkSession, d: str) -> DataFrame:
    return C.bleu(_captions(spark, d), ["model_id"])


@query(CAPS + """sz AS (SELECT model_id, count(*) AS n_pairs FROM toks GROUP BY 1), dfr AS (SELECT model_id, n, gram, count(*) AS df FROM rg GROUP BY ALL),
al AS (SELECT model_id, key, n, gram, coalesce(hyp_n,0) AS hn, coalesce(ref_n,0) AS rn FROM hg FULL JOIN rg USING (model_id, key, n, gram)),
wt AS (SELECT al.*, coalesce(ln(n_pairs)-ln(df), ln(n_pairs)) AS w FROM al JOIN sz USING (model_id) LEFT JOIN dfr USING (model_id, n, gram)),
pr AS (SELECT model_id, key, n, sum(least(hn,rn)*w*rn*w) AS dot, sqrt(sum((hn*w)*(hn*w))) AS a, sqrt(sum((rn*w)*(rn*w))) AS b FROM wt GROUP BY ALL),
sc AS (SELECT model_id, sum(coalesce(dot/nullif(a*b,0),0)*exp(-((len(hyp)-len(ref))**2)/72.0)) AS s FROM pr JOIN toks USING (model_id, key) GROUP BY 1)
SELECT model_id, n_pairs, 10*coalesce(s,0)/4/n_pairs AS cider FROM sz LEFT JOIN sc USING (model_id)""")
def caption_cider(spark: SparkSession, d: str) -> DataFrame:
    return C.cider(_captions(spark, d), ["model_id"])


@query()
def caption_rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return C.rouge_l(_captions(spark, d), ["model_id"])


SIGNS = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+$', '')"


@query(f"SELECT model_id, answer_form, count(*) AS n, avg(({SIGNS.format('text')} = {SIGNS.format('gt')})::INT) AS exact FROM predictions WHERE text IS NOT NULL AND gt IS NOT NULL GROUP BY ALL")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predictions").where("text is not null and gt is not null")
    same = T.drop_trailing_signs(F.lower("text")) == T.drop_trailing_signs(F.lower("gt"))
    return p.groupBy("model_id", "answer_form").agg(F.count(F.lit(1)).alias("n"), F.avg(same.cast("int")).alias("exact"))


# --- ten answers: each user's first ten events ------------------------------------------------------------------------

TEN = "WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), t AS (SELECT user_id, list(event_type ORDER BY rn) FILTER (rn <= 10) AS answers, max(event_type) FILTER (rn = 11) AS answer FROM e GROUP BY 1 HAVING count(*) >= 11)"


def _ten(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, answers, answer): the types of a user's first ten events as people's answers, the eleventh as the prediction."""
    e = table(spark, d, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rn")).where("rn <= 11")
    g = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rn", "event_type"))).alias("a")).where("size(a) = 11")
    return g.select("user_id", F.transform(F.slice("a", 1, 10), lambda x: x["event_type"]).alias("answers"), F.col("a")[10]["event_type"].alias("answer"))


@query(TEN + ", k AS (SELECT user_id, len(list_filter(answers, lambda x: x = answer)) AS k, answer, list_contains(answers, answer) AS hit FROM t) SELECT answer, count(*) AS n, avg((k*least(1,(k-1)/3)+(10-k)*least(1,k/3))/10) AS soft, avg(hit::INT) AS exact FROM k GROUP BY 1")
def vqa_soft_accuracy(spark: SparkSession, d: str) -> DataFrame:
    t = _ten(spark, d).withColumn("k", F.size(F.filter("answers", lambda x: x == F.col("answer"))))
    return t.groupBy("answer").agg(F.count(F.lit(1)).alias("n"), F.avg(C.soft_score(F.col("k"))).alias("soft"), F.avg(F.array_contains("answers", F.col("answer")).cast("int")).alias("exact"))


# the twin's edit distance is of bytes, so each other character of a pair is first put into one of those that lower case leaves free
ONE_BYTE = "array_to_string([chr(i::INT) FOR i IN range(1, 9)] || [chr(i::INT) FOR i IN range(14, 32)] || [chr(i::INT) FOR i IN range(65, 91)], '')"


@query(f"""WITH p AS (SELECT model_id, lower({STRIP.format('text')}) AS a, lower({STRIP.format('gt')}) AS b FROM predictions WHERE answer_form='label' AND text IS NOT NULL AND gt IS NOT NULL),
m AS (SELECT *, array_to_string(list_sort(list_distinct(regexp_extract_all(a || b, '[^\\x00-\\x7F]'))), '') AS other FROM p),
t AS (SELECT model_id, translate(a, other, {ONE_BYTE}) AS a, translate(b, other, {ONE_BYTE}) AS b FROM m)
SELECT model_id, count(*) AS n, avg(CASE WHEN s >= 0.5 THEN s ELSE 0 END) AS anls FROM (SELECT model_id, coalesce(1-levenshtein(a, b)/nullif(greatest(length(a), length(b)),0), 1) AS s FROM t) GROUP BY 1""")
def vqa_anls(spark: SparkSession, d: str) -> DataFrame:
    """Every label answer with a truth, in whatever script and with white space around it or not."""
    p = table(spark, d, "predictions").where("answer_form = 'label' and text is not null and gt is not null")
    return p.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.avg(C.anls(F.col("text"), F.array("gt"))).alias("anls"))


@query()
def normal_answers(spark: SparkSession, d: str) -> DataFrame:
    """Free answers as the answer normaliser gives them."""
    return table(spark, d, "predictions").where("text is not null and answer_form in ('label', 'sentence', 'number', 'choice')").select("pred_no", T.normal_answer(F.col("text")).alias("answer"))


# --- conversations -----------------------------------------------------------------------------------------------------

TURNS = """WITH told AS (SELECT row_no, list_filter(conversations, lambda t: lower(trim(t.speaker)) IN ('human','user','gpt','assistant')) AS c FROM samples),
t AS (SELECT row_no, list_transform(c, lambda x: {'h': lower(trim(x.speaker)) IN ('human','user'), 'v': coalesce(x.value, '')}) AS t FROM told WHERE len(c) > 0 AND lower(trim(c[1].speaker)) IN ('human','user'))"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """(row_no, t) of conversations that a human turn begins."""
    s = table(spark, d, "samples").select("row_no", "conversations", V.rounds(F.col("conversations")).alias("t"))
    began = F.get(F.filter("conversations", lambda t: F.lower(F.trim(t["speaker"])).isin("human", "user", "gpt", "assistant")), F.lit(0))["speaker"]
    return s.where(F.lower(F.trim(began)).isin("human", "user")).select("row_no", "t")


def _prompts(style: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return _turns(spark, d).select("row_no", V.prompt(F.col("t"), V.TEMPLATES[style]).alias("prompt"))

    f.__name__ = f"conversation_prompts_{style}"
    return f


_EACH = "array_to_string(list_transform(range(1, len(t)+1), lambda i: {0}), '')"
_CASES = {
    "single": "'A chat.###' || " + _EACH.format("CASE WHEN t[i].v <> '' THEN CASE WHEN t[i].h THEN 'Human' ELSE 'Assistant' END || ': ' || t[i].v || '###' ELSE CASE WHEN t[i].h THEN 'Human' ELSE 'Assistant' END || ':' END"),
    "two": "'A chat. ' || " + _EACH.format("CASE WHEN t[i].v <> '' THEN CASE WHEN t[i].h THEN 'USER' ELSE 'ASSISTANT' END || ': ' || t[i].v || CASE WHEN i % 2 = 1 THEN ' ' ELSE '</s>' END ELSE CASE WHEN t[i].h THEN 'USER' ELSE 'ASSISTANT' END || ':' END"),
    "bare": "E'<|im_start|>system\\nA chat.<|im_end|>' || " + _EACH.format("CASE WHEN t[i].h THEN E'<|im_start|>user\\n' ELSE E'<|im_start|>assistant\\n' END || CASE WHEN t[i].v <> '' THEN t[i].v || '<|im_end|>' ELSE '' END"),
    "llama": "regexp_replace(" + _EACH.format("CASE WHEN t[i].v = '' THEN '' WHEN i % 2 = 1 THEN '<s>[INST] ' || CASE WHEN i = 1 THEN E'<<SYS>>\\nA chat.\\n<</SYS>>\\n\\n' ELSE '' END || t[i].v || ' [/INST]' ELSE ' ' || t[i].v || ' </s>' END") + ", '^[<s>]+', '')",
    "plain": _EACH.format("CASE WHEN t[i].v <> '' THEN t[i].v || E'\\n' ELSE '' END"),
}
for _style, _sql in _CASES.items():
    query(f"{TURNS} SELECT row_no, {_sql} AS prompt FROM t")(_prompts(_style))


@query(TURNS + ", m AS (SELECT row_no, t, list_transform(t, lambda x: len(list_filter(regexp_split_to_array(x.v, '@U@'), lambda w: w <> ''))) AS n FROM t) SELECT row_no, len(t) AS n_turns, list_sum(n)::BIGINT AS n_tokens, coalesce(list_sum(list_transform(range(1,len(t)+1), lambda i: CASE WHEN t[i].h THEN 0 ELSE n[i] END)),0)::BIGINT AS n_labels, coalesce(len(list_filter(range(1,len(t)+1), lambda i: t[i].h <> (i % 2 = 1))),0) = 0 AS alternates FROM m".replace("@U@", SPACES))
def target_masks(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each conversation, those that count as labels, and whether its turns alternate; white space of any script parts words."""
    m = _turns(spark, d).withColumn("l", V.labelled(F.col("t")))
    return m.select("row_no", F.size("t").cast("long").alias("n_turns"), F.size("l.ids").cast("long").alias("n_tokens"), F.size(F.filter("l.labels", lambda x: x != V.IGNORED)).cast("long").alias("n_labels"), V.alternates(F.col("t")).alias("alternates"))


@query("""WITH p AS (SELECT pred_no, string_split(coalesce(prompt, ''), '<image>') AS s FROM predictions), n AS (SELECT pred_no, len(s)-1 AS n_images, list_sum(list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '@U@'), lambda w: w <> ''))))::BIGINT AS n FROM p) SELECT pred_no, n_images, 1+n_images+n AS n_tokens, 1+2*n_images+n AS n_doubled FROM n""".replace("@U@", SPACES))
def image_splice(spark: SparkSession, d: str) -> DataFrame:
    """Prompts' tokens with an image token in place of each `<image>`; and with these doubled."""
    p = table(spark, d, "predictions").select("pred_no", V.splice_image(F.coalesce("prompt", F.lit(""))).alias("ids"))
    return p.select("pred_no", F.size(F.filter("ids", lambda x: x == V.IMAGE)).cast("long").alias("n_images"), F.size("ids").cast("long").alias("n_tokens"), F.size(V.double_images(F.col("ids"))).cast("long").alias("n_doubled"))


@query(r"SELECT pred_no, CASE WHEN contains(prompt, '<image>') THEN E'<image>\n' || " + STRIP.format("replace(prompt, '<image>', '')") + " ELSE prompt END AS prompt, ((length(prompt)-length(replace(prompt,'<image>','')))/7)::INT AS n_images FROM predictions WHERE prompt IS NOT NULL")
def prompt_image_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").where("prompt is not null").select("pred_no", T.with_image_first(F.col("prompt")).alias("prompt"), T.media_tokens(F.col("prompt")).alias("n_images"))


GRID = """WITH s AS (SELECT row_no, coalesce(num_tokens, 0) % 7 + 2 AS n, coalesce(num_tokens, 0) % 3 + 1 AS g FROM samples), e AS (SELECT row_no, n, g, unnest(range(0, n + 2*g*g + n)) AS k FROM s)
SELECT row_no, k::INT AS k, (CASE WHEN k < n THEN k WHEN k < n+2*g*g THEN n + (k-n)//(g*g) ELSE n + greatest(2, g) + k - n - 2*g*g END)::INT AS t, (CASE WHEN k < n THEN k WHEN k < n+2*g*g THEN n + (k-n)//g % g ELSE n + greatest(2, g) + k - n - 2*g*g END)::INT AS h, (CASE WHEN k < n THEN k WHEN k < n+2*g*g THEN n + (k-n) % g ELSE n + greatest(2, g) + k - n - 2*g*g END)::INT AS w FROM e"""


@query(GRID)
def grid_positions(spark: SparkSession, d: str) -> DataFrame:
    """Three-axis positions, one row each, of text, a picture of 2 x g x g cells, and text."""
    n, g = (F.coalesce("num_tokens", F.lit(0)) % 7 + 2).alias("n"), (F.coalesce("num_tokens", F.lit(0)) % 3 + 1).alias("g")
    s = table(spark, d, "samples").select("row_no", n, g)
    seg = lambda k, t, h, w: F.struct(k.cast("int").alias("n"), t.cast("int").alias("t"), h.cast("int").alias("h"), w.cast("int").alias("w"))
    zero = F.lit(0)
    p = V.grid_positions(F.array(seg(F.col("n"), zero, zero, zero), seg(zero, F.lit(2), F.col("g"), F.col("g")), seg(F.col("n"), zero, zero, zero)))
    return s.select("row_no", F.posexplode(p).alias("k", "p")).select("row_no", "k", "p.*")


@query("SELECT row_no, k::INT AS k, CASE WHEN k < n THEN ((row_no * 31 + k * 17) % 1000 + 1)::INT ELSE 0 END AS id, (k < n)::INT AS mask, CASE WHEN k < n THEN k ELSE 1 END::INT AS position FROM (SELECT row_no, coalesce(num_tokens, 1) AS n, unnest(range(0, 40)) AS k FROM samples) WHERE n > 0")
def pad_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Token lists cut or filled to 40: each id, its mask and its position counted over the mask (1 where it is filled)."""
    made = F.transform(F.sequence(F.lit(0), F.coalesce("num_tokens", F.lit(1)) - 1), lambda k: ((F.col("row_no") * 31 + k * 17) % 1000 + 1).cast("int"))
    s = table(spark, d, "samples").where("coalesce(num_tokens, 1) > 0").select("row_no", made.alias("ids"))
    p = s.select("row_no", V.padded(F.col("ids"), F.lit(40), 0).alias("p")).withColumn("m", F.transform("p", lambda x: (x != 0).cast("int")))
    rows = p.withColumn("q", V.positions(F.col("m"))).select("row_no", F.posexplode(F.arrays_zip("p", "m", "q")).alias("k", "z"))
    return rows.select("row_no", "k", F.col("z.p").alias("id"), F.col("z.m").alias("mask"), F.col("z.q").alias("position"))


# --- batches -----------------------------------------------------------------------------------------------------------

WORDS = r"coalesce(list_sum(list_transform(conversations, lambda t: len(list_filter(regexp_split_to_array(coalesce(t.value,''), '[\s\p{Z}\x{0085}\x{000b}]+'), lambda w: w <> '')))), 0)::INT"


@query(f"SELECT row_no, n_words, n_words + CASE WHEN has THEN 128 ELSE 0 END AS length, CASE WHEN has THEN n_words ELSE -n_words END AS modality_length, known_length FROM (SELECT row_no, {WORDS} AS n_words, coalesce(len(image) > 0, false) AS has, coalesce(num_tokens, 1) AS known_length FROM samples)")
def sample_lengths(spark: SparkSession, d: str) -> DataFrame:
    return P.lengths(table(spark, d, "samples"))


@query("SELECT row_no, (row_number() OVER (ORDER BY row_no) - 1) // ceil((SELECT count(*) FROM samples)/7)::BIGINT AS chunk FROM samples")
def chunk_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Seven chunks of equal size in order, the last one smaller."""
    s = table(spark, d, "samples").select("row_no")
    size = -(-s.count() // 7) or 1
    return V.chunk_places(s, "row_no").select("row_no", F.floor(F.col("place") / size).alias("chunk"))


@query("SELECT row_no, batch, (upto - n)::BIGINT AS from_token, upto::BIGINT AS to_token FROM (SELECT row_no, batch, n, sum(n) OVER (PARTITION BY batch ORDER BY row_no) AS upto FROM (SELECT row_no, coalesce(num_tokens,1) AS n, (row_number() OVER (ORDER BY row_no) - 1) // 8 AS batch FROM samples))")
def packing_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Batches of eight records in order, packed into one sequence each: where each record's tokens stand."""
    s = table(spark, d, "samples").select("row_no", F.coalesce("num_tokens", F.lit(1)).alias("n"))
    return V.pack_batches(s, "n", "row_no", 8).select("row_no", "batch", "from_token", "to_token")


@query("SELECT row_no, i AS copy_no FROM (SELECT row_no, unnest(range(0, CASE WHEN substr(id,2,1)='6' THEN 3 WHEN substr(id,2,1)='1' THEN 2 ELSE 1 END)) AS i FROM samples)")
def oversample_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return P.oversample(table(spark, d, "samples").select("row_no", "id"), {"6": 2, "1": 1}).select("row_no", F.col("copy_no").cast("long").alias("copy_no"))


@query("SELECT s.row_no, s.dataset, r.data_path, coalesce(r.sampling_rate, 1.0) AS rate FROM samples s JOIN dataset_registry r ON lower(trim(r.dataset)) = s.dataset WHERE s.split_name='train'")
def dataset_union(spark: SparkSession, d: str) -> DataFrame:
    """Train records of the registered datasets, with the data path and sampling rate of each."""
    r = table(spark, d, "dataset_registry").select(F.lower(F.trim("dataset")).alias("dataset"), "data_path", F.coalesce("sampling_rate", F.lit(1.0)).alias("rate"))
    return table(spark, d, "samples").where("split_name = 'train'").select("row_no", "dataset").join(r, "dataset")


@query("SELECT run_no, p AS entry, CASE WHEN regexp_matches(p, '%[0-9]+$') THEN CAST(regexp_extract(p, '%([0-9]+)$', 1) AS DOUBLE)/100 ELSE 1.0 END AS rate FROM (SELECT run_no, trim(unnest(string_split(dataset_use, ','))) AS p FROM data_arguments WHERE dataset_use IS NOT NULL) WHERE p <> ''")
def sampling_rates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "data_arguments").select("run_no", F.explode(F.split("dataset_use", ",")).alias("p")).select("run_no", F.trim("p").alias("entry")).where("entry <> ''")
    return p.select("run_no", "entry", P.rate(F.col("entry")).alias("rate"))


@query()
def exact_sample(spark: SparkSession, d: str) -> DataFrame:
    """The share of each dataset's train records that its sampling rate asks for, exactly, seeded."""
    return P.exact_sample(dataset_union(spark, d), "dataset", "row_no", "rate")


@query()
def length_grouped_batches(spark: SparkSession, d: str) -> DataFrame:
    return P.length_grouped(P.lengths(table(spark, d, "samples")), "row_no", "length", 16, 4)


VALID = """WITH r AS (SELECT row_no, coalesce(len(image),0) AS n_images, coalesce(list_sum(list_transform(list_filter(conversations, lambda t: lower(t.speaker) IN ('human','user')), lambda t: (length(coalesce(t.value,''))-length(replace(coalesce(t.value,''),'<image>','')))//7)),0)::INT AS n_tokens, coalesce(list_sum(list_transform(list_filter(conversations, lambda t: lower(t.speaker) IN ('gpt','assistant')), lambda t: (length(coalesce(t.value,''))-length(replace(coalesce(t.value,''),'<image>','')))//7)),0) AS told FROM samples),
m AS (SELECT row_no, count(*) AS n_missing FROM (SELECT row_no, unnest(image) AS i FROM samples) x WHERE i IS NULL OR NOT EXISTS (SELECT 1 FROM image_meta y WHERE y.image = x.i) GROUP BY 1),
v AS (SELECT row_no, n_images::INT AS n_images, n_tokens, coalesce(n_missing,0) AS n_missing, concat_ws(',', CASE WHEN n_missing > 0 THEN 'missing' END, CASE WHEN n_tokens <> n_images THEN 'mismatch' END, CASE WHEN told > 0 THEN 'answer_token' END) AS problems FROM r LEFT JOIN m USING (row_no))"""


@query(VALID + " SELECT * FROM v")
def validate_samples(spark: SparkSession, d: str) -> DataFrame:
    return P.validate(table(spark, d, "samples"), table(spark, d, "image_meta"))


@query(VALID + " SELECT count(*) AS n, count(*) FILTER (problems='') AS n_valid, count(*) FILTER (contains(problems,'missing')) AS n_missing, count(*) FILTER (contains(problems,'mismatch')) AS n_mismatch, count(*) FILTER (contains(problems,'answer_token')) AS n_answer_token, count(*) FILTER (n_images=0) AS n_text_only, count(*) FILTER (n_images>1) AS n_many FROM v")
def validate_summary(spark: SparkSession, d: str) -> DataFrame:
    return P.validation_summary(P.validate(table(spark, d, "samples"), table(spark, d, "image_meta")))


# --- tables, logs and state ---------------------------------------------------------------------------------------------


@query("SELECT image, width, height, rig FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY coalesce(width,-1) DESC, coalesce(height,-1) DESC, coalesce(rig,'') DESC) AS rn FROM image_meta WHERE image IS NOT NULL) WHERE rn=1")
def keyed_last(spark: SparkSession, d: str) -> DataFrame:
    """One row per picture, the greatest by size and rig standing for the last."""
    m = table(spark, d, "image_meta").withColumns({"w": F.coalesce("width", F.lit(-1)), "h": F.coalesce("height", F.lit(-1)), "r": F.coalesce("rig", F.lit(""))})
    return E.last_of(m, ["image"], ["w", "h", "r"]).select("image", "width", "height", "rig")


@query("SELECT DISTINCT id FROM samples WHERE split_name='test' AND id IS NOT NULL AND id NOT IN (SELECT id FROM predictions WHERE model_id='naut7b-a' AND id IS NOT NULL)")
def resume_unseen(spark: SparkSession, d: str) -> DataFrame:
    """Test records that a model hasn't answered yet."""
    done = table(spark, d, "predictions").where("model_id = 'naut7b-a' and id is not null")
    return unseen(table(spark, d, "samples").where("split_name = 'test' and id is not null").select("id").distinct(), done, "id")


@query("SELECT p.pred_no, s.image_no::INT AS image_no, s.image, m.width, m.height FROM predictions p JOIN (SELECT id, image_no, image[image_no] AS image FROM (SELECT id, image, unnest(range(1, len(image)+1)) AS image_no FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no DESC) rn FROM samples WHERE id IS NOT NULL) WHERE rn=1)) s USING (id) JOIN (SELECT image, max(width) AS width, max(height) AS height FROM image_meta WHERE image IS NOT NULL GROUP BY 1) m USING (image)")
def picture_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Each answer with the size of each of its record's pictures, numbered from 1; pictures without one are dropped."""
    s = E.last_of(table(spark, d, "samples").select("id", "row_no", "image"), ["id"], ["row_no"]).select("id", F.posexplode("image").alias("k", "image"))
    m = table(spark, d, "image_meta").where("image is not null").groupBy("image").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    return table(spark, d, "predictions").select("pred_no", "id").join(s, "id").join(m, "image").select("pred_no", (F.col("k") + 1).alias("image_no"), "image", "width", "height")


def _beats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("worker"), "ts")


@query("SELECT user_id AS worker, max(ts) AS last_beat, count(*) AS n_beats, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 30 SECOND AS is_alive FROM events GROUP BY 1")
def worker_states(spark: SparkSession, d: str) -> DataFrame:
    return W.alive(_beats(spark, d))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id AS worker, min(ts) AS up_at, max(ts) + INTERVAL 6 HOUR AS down_at, count(*) AS n_beats FROM s GROUP BY user_id, k")
def worker_sessions(spark: SparkSession, d: str) -> DataFrame:
    return W.sessions(_beats(spark, d), 6 * 3600)


@query("SELECT date_trunc('day', ts) AS window_start, event_type AS type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def vote_windows(spark: SparkSession, d: str) -> DataFrame:
    return W.vote_windows(table(spark, d, "events").select("ts", F.col("event_type").alias("type"), "value"))


@query("SELECT event_type, count(DISTINCT user_id) AS n_workers, sum(value) AS speed, min(user_id) FILTER (value = mv) AS least_loaded FROM (SELECT *, min(value) OVER (PARTITION BY event_type) AS mv FROM events) GROUP BY 1")
def worker_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Status of all workers by kind: their number, summed speed, and the one with the least load."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_workers"), F.sum("value").alias("speed"), F.min_by("user_id", F.struct("value", "user_id")).alias("least_loaded"))


@query()
def metric_documents(spark: SparkSession, d: str) -> DataFrame:
    """The counting metrics of each model as one JSON object."""
    from benthos.plans.evaluation import counting_metrics

    return metric_document(counting_metrics(spark, d), ["model_id"])


MCQ = r"""WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS hint, [p_brand, p_type, CASE WHEN p_partkey % 7 = 0 THEN 'nan' ELSE CAST(p_size AS VARCHAR) END, CASE WHEN p_partkey % 3 > 0 THEN p_name END] AS raw FROM part), o AS (SELECT p_partkey, p_name, hint, raw[1:coalesce(list_min(list_filter(range(1, 5), lambda i: raw[i] IS NULL OR lower(raw[i]) IN ('nan', 'none', ''))), 5)-1] AS o FROM p), r AS (SELECT *, unnest(range(0, len(o))) AS round_no FROM o)
SELECT p_partkey, round_no, CASE WHEN hint IS NULL THEN '' ELSE hint || E'\n' END || p_name || E'\n' || array_to_string(list_transform(range(1, len(o)+1), lambda i: chr((64+i)::INT) || '. ' || o[((i-1+round_no) % len(o)) + 1]), E'\n') || E'\nAnswer with the option’s letter from the given choices directly.' AS prompt, chr((65+(len(o)-round_no) % len(o))::INT) AS answer FROM r"""


@query(MCQ)
def mcq_rotations(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of every rotation of a question's options (hint, question, options up to the first null-like one, instruction),
    and where the first option now stands."""
    key = F.col("p_partkey")
    raw = F.array("p_brand", "p_type", F.when(key % 7 == 0, "nan").otherwise(F.col("p_size").cast("string")), F.when(key % 3 > 0, F.col("p_name")))
    p = table(spark, d, "part").select("p_partkey", "p_name", F.when(key % 5 != 0, F.col("p_type")).alias("hint"), T.until_null_like(raw).alias("o"))
    r = p.where("size(o) > 0").select("*", F.explode(F.sequence(F.lit(0), F.size("o") - 1)).alias("r"))
    return r.select("p_partkey", F.col("r").cast("long").alias("round_no"), T.mcq_prompt(F.col("hint"), F.col("p_name"), T.rotated(F.col("o"), F.col("r"))).alias("prompt"), F.char(65 + (F.size("o") - F.col("r")) % F.size("o")).alias("answer"))
